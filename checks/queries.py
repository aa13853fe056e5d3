"""One query per operator: ``name -> callable(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import inputs as src
from checks.inputs import table
from twinrun.functions import (
    html_to_text,
    norm_dir,
    norm_prefix,
    output_table,
    page_ref_id,
    pipeline_name,
    redact,
    redact_map,
    repo_slug,
)
from twinrun.operators import definitions, diff, schema, sections
from twinrun.plans import compare, context, discovery, examples, report
from twinrun.session import scratch_dir
from twinrun.sources import files, readers, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Report columns that hold one plain value each.
FLAT_REPORT = [
    "path", "status", "left_count", "right_count", "only_in_left", "only_in_right", "differing_rows",
    "schema_match", "comparable",
]


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def flat(rows: DataFrame, *keys: str) -> DataFrame:
    differences = F.array_join("schema_differences", "; ").alias("schema_differences")
    return rows.select(*keys, *FLAT_REPORT, differences, "error")


# ---------------------------------------------------------------- discovery


@query
def discover_runs(spark, sf):
    return discovery.discover_runs(src.feed_listing(spark, sf), prefix="/feed", max_runs=20)


@query
def runs_in_window(spark, sf):
    return discovery.runs_from_listing(src.mixed_listing(spark, sf), "feed/", "2024-01-05", "2024-01-20")


@query
def dropped_names(spark, sf):
    return discovery.dropped_names(src.mixed_listing(spark, sf), "feed/")


@query
def snapshot_folders(spark, sf):
    return discovery.snapshot_folders(src.history_listing(spark, sf))


@query
def latest_snapshot(spark, sf):
    return discovery.latest_snapshots(src.history_listing(spark, sf))


@query
def resolve_raw_path(spark, sf):
    runs = discovery.runs_from_listing(src.feed_listing(spark, sf), "feed/")
    snapshots = discovery.latest_snapshots(src.history_listing(spark, sf))
    return discovery.resolve_raw_paths(runs, snapshots, mount="/mnt/input")


@query
def resolve_raw_path_template(spark, sf):
    runs = discovery.runs_from_listing(src.feed_listing(spark, sf), "feed/")
    snapshots = discovery.latest_snapshots(src.history_listing(spark, sf))
    return discovery.resolve_raw_paths(runs, snapshots, "/mnt/input", template="/data/{run_id}/raw//")


@query
def norm_paths(spark, sf):
    """Paths of the page addresses, with one slash, several or none at their end."""
    pages = table(spark, sf, "pages")
    path = F.regexp_extract("url", r"^[a-z]+://[^/]*(.*)$", 1)
    path = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("//"), path, F.lit("//"))).otherwise(path)
    return pages.select("page_id", norm_prefix(path).alias("prefix"), norm_dir(path).alias("dir"))


# ---------------------------------------------------------------- relational steps


@query
def lit_columns(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.withColumns({"unit": F.lit("box"), "factor": F.lit(12)}).select("o_orderkey", "unit", "factor")


@query
def project(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_quantity")


@query
def filter_isin(spark, sf):
    return table(spark, sf, "part").filter(F.col("p_size").isin([7, 14, 28, 42])).select("p_partkey", "p_size")


@query
def left_join_using(spark, sf):
    customer = table(spark, sf, "customer").withColumn("o_custkey", F.col("c_custkey") + 100)  # some stay unmatched
    return table(spark, sf, "orders").join(customer, "o_custkey", "left").select("o_custkey", "o_orderkey", "c_name")


@query
def left_join_alias(spark, sf):
    customer = table(spark, sf, "customer").withColumn("c_custkey", F.col("c_custkey") + 100)
    o, c = table(spark, sf, "orders").alias("o"), customer.alias("c")
    both = o.join(c, F.col("o.o_custkey") == F.col("c.c_custkey"), "left")
    return both.select(F.col("o.o_orderkey"), F.col("o.o_custkey"), F.col("c.c_custkey"), F.col("c.c_name"))


@query
def left_join_chain(spark, sf):
    names = ("customer", "nation", "region")
    return examples.aliases_right({n: table(spark, sf, n) for n in names}, None)


@query
def group_count(spark, sf):
    return table(spark, sf, "part").groupBy("p_size").count()


@query
def group_count_alias(spark, sf):
    return examples.status_counts(table(spark, sf, "orders"))


@query
def row_counts(spark, sf):
    names = ("orders", "lineitem", "customer", "events")
    return diff.row_counts({f"$.{n}": table(spark, sf, n) for n in names})


# ---------------------------------------------------------------- multiset differences


def _order_pair(spark, sf):
    """Two columns with many equal rows. The seeded difference: the right side lacks some orders."""
    orders = table(spark, sf, "orders")
    pick = ("o_custkey", "o_orderstatus")
    return orders.select(*pick), orders.where("o_orderkey % 10 <> 3").select(*pick)


def _line_pair(spark, sf):
    """All columns of lineitem. The seeded difference: other discounts in some orders, and some orders twice."""
    left = table(spark, sf, "lineitem")
    changed = F.when(F.col("l_orderkey") % 97 == 0, 0.5).otherwise(F.col("l_discount"))
    copies = F.explode(F.expr("sequence(1, CASE WHEN l_orderkey % 101 = 0 THEN 2 ELSE 1 END)")).alias("copy")
    return left, left.withColumn("l_discount", changed).select("*", copies).drop("copy")


@query
def except_all_left(spark, sf):
    return diff.except_all(*_order_pair(spark, sf))


@query
def except_all_right(spark, sf):
    left, right = _line_pair(spark, sf)
    return diff.except_all(right, left)


@query
def except_all_map(spark, sf):
    """Rows with a MAP column, which the built-in operator refuses; its entries show in the result as text."""
    orders = table(spark, sf, "orders")

    def rows(df, swap):
        pairs = [F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority")]
        tags = F.create_map(*(pairs[2:] + pairs[:2] if swap else pairs))
        return df.select((F.col("o_custkey") % 50).alias("c"), tags.alias("tags"))

    found = diff.except_all(rows(orders, False), rows(orders.where("o_orderkey % 10 <> 3"), True))
    return found.select("c", F.col("tags")["status"].alias("status"), F.col("tags")["priority"].alias("priority"))


@query
def diff_counts(spark, sf):
    return diff.diff_counts(*src.run_pair(spark, sf))


@query
def wide_parity(spark, sf):
    return diff.diff_counts(*_line_pair(spark, sf))


@query
def hash_parity(spark, sf):
    """The same rows by sums of hashes, and exactly where these differ; and a side against itself in another order."""
    left, right = _line_pair(spark, sf)
    same = diff.diff_counts_by_hash(left, left.repartition(7), by=["l_returnflag"]).withColumn("pair", F.lit("equal"))
    return diff.diff_counts_by_hash(left, right, by=["l_returnflag"]).withColumn("pair", F.lit("changed")).unionByName(same)


@query
def bucketed_parity(spark, sf):
    """The same rows from tables that are bucketed by order."""
    names = [f"twinrun_{side}_{uuid.uuid4().hex}" for side in ("left", "right")]
    for name, df in zip(names, _line_pair(spark, sf)):
        sinks.save_bucketed(df, name, _folder(spark, name), "l_orderkey", 8)
    return diff.diff_counts(*[spark.table(n) for n in names], by=["l_linestatus"])


@query
def text_parity(spark, sf):
    """Whole documents as rows, long texts included. The seeded difference: a character more in some texts."""
    left = table(spark, sf, "documents")
    longer = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return diff.diff_counts(left, left.withColumn("text", longer), by=["lang"])


@query
def row_tally(spark, sf):
    return diff.tally(*_order_pair(spark, sf))


@query
def differing_rows(spark, sf):
    return diff.differing_rows(*_line_pair(spark, sf))


@query
def diff_sample(spark, sf):
    return diff.diff_sample(*_order_pair(spark, sf), n=20)


@query
def sample_by_group(spark, sf):
    left, right = src.run_pair(spark, sf)
    return diff.sample_by_group(left, right, by=["run_id"], n=3)


# ---------------------------------------------------------------- comparison of outputs


@query
def sample_of_clashing_names(spark, sf):
    """Data columns and a group named like the columns of the sample."""
    left, right = _order_pair(spark, sf)
    named = lambda df: df.toDF("copies", "side").withColumn("rank", F.col("copies") % 3)
    return diff.sample_by_group(named(left), named(right), by=["rank"], n=2)


@query
def run_parity(spark, sf):
    left, right = src.run_pair(spark, sf)
    return flat(compare.compare_runs(spark, left, right), "run_id")


def _run_report(spark, sf):
    runs = discovery.discover_runs(src.feed_listing(spark, sf), "feed/", max_runs=20)
    snapshots = discovery.latest_snapshots(src.history_listing(spark, sf))
    paths = discovery.resolve_raw_paths(runs, snapshots, "/mnt/input").select("run_id", "run_date", "raw_path")
    left, right = src.run_pair(spark, sf)
    return compare.compare_runs(spark, {"users": left}, {"users": right}, runs=paths)


@query
def run_report(spark, sf):
    return flat(_run_report(spark, sf), "run_id", "run_date", "raw_path")


@query
def report_summary(spark, sf):
    return report.summarise(_run_report(spark, sf))


@query
def report_failures(spark, sf):
    return report.failed_runs(_run_report(spark, sf))


@query
def report_rows(spark, sf):
    return report.count_text(_run_report(spark, sf)).select("run_id", "path", "counts", "details", "total")


@query
def report_text(spark, sf):
    return report.report_lines(_run_report(spark, sf))


@query
def tree_parity(spark, sf):
    """An output tree with equal, changed, missing, retyped and plain leaves."""
    orders, customer, line = (table(spark, sf, n) for n in ("orders", "customer", "lineitem"))
    left = {"same": customer, "list": [orders, line], "gone": orders, "flag": 1}
    right = {
        "same": customer.where("true"),
        "list": [orders.where("o_orderkey % 10 <> 3"), line.drop("l_tax")],
        "flag": 2,
    }
    return flat(compare.compare_outputs(spark, left, right))


@query
def tree_shapes(spark, sf):
    """Trees that differ in their shape alone, and trees whose keys look alike."""
    orders, part = table(spark, sf, "orders"), table(spark, sf, "part")
    left = {"extra": {}, "kind": {}, "a.b": orders, "a": {"b": part}, "keys": {1: 5, "1": 6}, "both": [], "list": [part]}
    right = {"kind": [], "a.b": orders.where("o_orderkey % 10 <> 3"), "a": {"b": part}, "keys": {1: 5, "1": 7}, "both": [], "list": [part, []]}
    return flat(compare.compare_outputs(spark, left, right))


@query
def broken_leaf(spark, sf):
    """Of three leaves one does not name its runs, and one names a column twice: the others are compared."""
    left, right = src.run_pair(spark, sf)
    runs = left.select("run_id").distinct()
    twice = lambda df: df.toDF("run_id", "x", "x")
    a = {"users": left, "lost": left.drop("run_id"), "twice": twice(left)}
    b = {"users": right, "lost": right.drop("run_id"), "twice": twice(left)}
    return flat(compare.compare_runs(spark, a, b, runs=runs), "run_id")


@query
def each_run_report(spark, sf):
    """A plan per run, several batches at a time: one run without outputs, one that fails, one that differs, and equal ones."""
    events = src.event_runs(spark, sf)
    runs = events.groupBy("run_id").agg(F.to_date(F.min("ts")).alias("run_date"), F.lit("/raw").alias("raw_path"))

    def read(_, run):
        return {"events": events.where(F.col("run_id") == run.run_id).select("user_id", "event_type")}

    def old(inputs, run):
        return {} if run.run_id.endswith("01") else {"users": inputs["events"]}

    def new(inputs, run):
        if run.run_id.endswith("02"):
            raise ValueError("no such version")
        out = old(inputs, run)
        return {k: df.where("user_id % 50 <> 7") for k, df in out.items()} if run.run_id.endswith("03") else out

    step = compare.Pipeline(read, old, new)
    found = compare.compare_each_run(spark, step, runs, _folder(spark, "each-run"), batch_size=10, parallel=3)
    return flat(found, "run_id", "run_date", "raw_path")


@query
def bad_lines_report(spark, sf):
    """Runs in delimited files, some lines of one run broken: that run has an error, and all are compared."""
    events = src.event_runs(spark, sf)
    folder = _folder(spark, "lines")
    broken = F.col("run_id").endswith("05") & (F.col("event_id") % 10 == 3)
    line = F.when(broken, F.concat(F.lit("?"), F.col("event_id"))).otherwise(F.concat_ws("|", "user_id", "event_type"))
    events.select("run_id", line.alias("line")).repartition("run_id").write.partitionBy("run_id").text(folder)
    runs = events.groupBy("run_id").agg(F.to_date(F.min("ts")).alias("run_date"), F.lit(None).cast("string").alias("raw_path"))

    def read(spark, run):
        at = f"{folder}/run_id={run.run_id}"
        return {"events": readers.read_delimited(spark, at, "user_id bigint, event_type string", "|", header=False, keep_bad_lines=True)}

    step = compare.Pipeline(read, lambda i, run: i["events"], lambda i, run: i["events"].where("user_id % 50 <> 7"))
    return flat(compare.compare_each_run(spark, step, runs, _folder(spark, "each-run"), batch_size=10, parallel=3), "run_id", "run_date")


@query
def asserted(spark, sf):
    """What the strict assertions say of an equal and an unequal pair and of two trees; the first line of each message."""
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    left, right = _order_pair(spark, sf)

    def said(check, *pair):
        try:
            check(*pair)
        except AssertionError as found:
            return str(found).splitlines()[0]
        return "equal"

    rows = [
        ("same", said(compare.assert_equal, orders, orders.where("true"))),
        ("rows", said(compare.assert_equal, left, right)),
        ("schema", said(compare.assert_equal, customer, customer.drop("c_name"))),
        ("tree", said(compare.assert_trees_equal, {"c": customer, "o": [left]}, {"c": customer, "o": [right]})),
        ("same tree", said(compare.assert_trees_equal, {"c": customer, "o": [left]}, {"c": customer, "o": [left]})),
    ]
    return spark.createDataFrame(rows, "pair string, said string")


# ---------------------------------------------------------------- sources and sinks


def _folder(spark, name):
    """A new folder in the session's shared one; without that, and on one machine only, a temporary one."""
    shared = scratch_dir(spark)
    if shared is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return f"{(shared or tempfile.mkdtemp()).rstrip('/')}/{name}-{uuid.uuid4()}"


@query
def named_table(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("twinrun_named_orders")
    return readers.read_named(spark, "twinrun_named_orders").select("o_orderkey", "o_orderstatus")


@query
def delimited_round_trip(spark, sf):
    """Documents without line ends as delimited text and back, compared with what they were."""
    docs = table(spark, sf, "documents").select("doc_id", F.translate("text", "\n\r", "  ").alias("text"), "lang")
    folder = _folder(spark, "delimited")
    docs.write.option("sep", "|").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(folder)
    return diff.diff_counts(docs, readers.read_delimited(spark, folder, docs.schema, "|", escape='"'), by=["lang"])


@query
def listed_files(spark, sf):
    """Events written by run, and orders below a folder that begins with ``_``: the names of all files, hidden ones too."""
    folder = _folder(spark, "store")
    src.event_runs(spark, sf).repartition("run_id").write.partitionBy("run_id").parquet(f"{folder}/feed")
    table(spark, sf, "orders").repartition(1).write.parquet(f"{folder}/_tmp/orders")
    names = files.list_files(spark, folder).where("NOT name LIKE '%.crc'")  # checksums of local file systems
    kind = F.regexp_replace("name", "part-[^/]*", "part")
    return names.groupBy(kind.alias("name")).agg(F.count("*").alias("files"), F.min(F.col("size") >= 0).alias("sized"))


@query
def corpus_lines(spark, sf):
    """All lines of the documents, written as text by language and read in ranges of 32 KB."""
    folder = _folder(spark, "corpus")
    table(spark, sf, "documents").select("lang", "text").write.partitionBy("lang").text(folder)
    corpus = files.read_corpus(spark, folder, "part-*.txt", range_bytes=32 << 10)
    lang = F.regexp_extract("path", "lang=([^/]*)/", 1)
    line = F.explode(F.split(F.regexp_replace("content", "\n$", ""), "\n")).alias("line")
    return corpus.select(lang.alias("lang"), line).groupBy("lang", "line").agg(F.count("*").alias("n"))


@query
def written_context(spark, sf):
    """Context documents as text files, read back."""
    parts = context.build_context(src.pipeline_config(spark, sf), src.wiki_pages(spark, sf), src.definition_files(spark, sf))
    folder = _folder(spark, "context")
    sinks.write_context(parts, folder)
    return sinks.read_context(spark, folder)


@query
def written_report(spark, sf):
    """The report stored and written as text: its lines, counted, as they stand in no order here."""
    stored, text = _folder(spark, "report"), _folder(spark, "text")
    sinks.write_report(_run_report(spark, sf), stored)
    sinks.write_stored_report_text(spark, stored, text)
    return spark.read.text(text).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query
def empty_differences(spark, sf):
    """Whether a difference has any rows, for an equal and an unequal pair."""
    left, right = _order_pair(spark, sf)
    pairs = {"unequal": (left, right), "equal": (left, left.where("true"))}
    return spark.createDataFrame([(k, diff.is_empty(diff.except_all(*p))) for k, p in pairs.items()], "pair string, empty boolean")


def _schema_trees(spark, sf):
    orders, customer, line = (table(spark, sf, n) for n in ("orders", "customer", "lineitem"))
    left = {"orders": orders, "customer": customer, "lines": line}
    right = {
        "orders": orders.withColumnsRenamed({"o_orderstatus": "o_status"}).withColumn(
            "o_custkey", F.col("o_custkey").cast("int")
        ),
        "customer": customer.select(*reversed(customer.columns)),
        "lines": line.withColumn("l_tax", F.coalesce("l_tax", F.lit(0.0))),
    }
    return left, right


@query
def schema_rows(spark, sf):
    """Columns of several tables next to their row counts."""
    left, _ = _schema_trees(spark, sf)
    rows = schema.schema_rows(spark, left).select("path", "ordinal", "name", "type", "nullable", "field")
    return rows.join(diff.row_counts({f"$.{k}": v for k, v in left.items()}), "path")


@query
def schema_diff(spark, sf):
    """Schema differences next to the row differences of the same leaves."""
    left, right = _schema_trees(spark, sf)
    counts = compare.compare_outputs(spark, left, right).select("path", "left_count", "only_in_left", "comparable")
    return schema.schema_diff(spark, left, right).join(counts, "path")


@query
def schema_side_by_side(spark, sf):
    left, right = _schema_trees(spark, sf)
    both = schema.match_by_position(schema.schema_rows(spark, left), schema.schema_rows(spark, right))
    counts = diff.row_counts({f"$.{k}": v for k, v in left.items()})
    return report.schema_table(both).join(counts, "path")


@query
def schema_columns(spark, sf):
    """Columns of each leaf that are on both sides, or on one only, next to the row count of the leaf."""
    left, right = _schema_trees(spark, sf)
    l, r = schema.schema_rows(spark, left), schema.schema_rows(spark, right)
    kinds = {
        "both": schema.columns_in_both(l, r),
        "left": schema.columns_only_in_left(l, r),
        "right": schema.columns_only_in_left(r, l),
    }
    parts = [rows.select("path", "name", F.lit(kind).alias("side")) for kind, rows in kinds.items()]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.join(diff.row_counts({f"$.{k}": v for k, v in left.items()}), "path")


def _pair(spark, sf, pipeline, *names):
    tables = {n: table(spark, sf, n) for n in names}
    left, right = (side(tables, None, **pipeline.options) for side in (pipeline.left, pipeline.right))
    return flat(compare.compare_outputs(spark, left, right))


@query
def pair_unused(spark, sf):
    return _pair(spark, sf, examples.unused_columns("EUR"), "orders")


@query
def pair_dead(spark, sf):
    return _pair(spark, sf, examples.dead_branches(), "orders", "customer", "part")


@query
def pair_alias(spark, sf):
    return _pair(spark, sf, examples.needless_aliases(), "customer", "nation", "region")


# ---------------------------------------------------------------- scalar functions over tables


@query
def html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", html_to_text("html").alias("text"))


@query
def page_ref(spark, sf):
    """References in the form of the page addresses, their language read as the folder of pages; some are bare ids."""
    bare = F.concat(F.lit(" "), F.col("page_id").cast("string"), F.lit(" "))
    ref = F.when(F.col("page_id") % 9 == 0, bare).otherwise(F.regexp_replace("url", "/(en|fr|de|es)/", "/pages/"))
    return table(spark, sf, "pages").select("page_id", page_ref_id(ref).alias("ref_id"))


@query
def repo_slugs(spark, sf):
    pid = F.col("page_id").cast("string")
    kind = F.col("page_id") % 6
    url = (
        F.when(kind == 0, F.concat(F.lit("https://github.com/acme/r"), pid, F.lit(".git/")))
        .when(kind == 1, F.concat(F.lit("git@github.com:acme/r"), pid, F.lit(".git")))
        .when(kind == 2, F.concat(F.lit("https://www.github.com/acme/r"), pid, F.lit("/tree/main?x=1")))
        .when(kind == 3, F.concat(F.lit("https://example.org/acme/r"), pid))
        .when(kind == 4, F.concat(F.lit("https://user@github.com/acme/r"), pid))
        .otherwise(F.lit("https://github.com/acme"))
    )
    return table(spark, sf, "pages").select("page_id", repo_slug(url).alias("slug"))


@query
def pipeline_names(spark, sf):
    pid = F.col("page_id").cast("string")
    kind = F.col("page_id") % 3
    path = (
        F.when(kind == 0, F.concat(F.lit("steps/pre_etl_p"), pid, F.lit(".py")))
        .when(kind == 1, F.concat(F.lit("/steps/p"), pid, F.lit(".v2.py")))
        .otherwise(F.concat(F.lit("p"), pid))
    )
    name = pipeline_name(path)
    return table(spark, sf, "pages").select("page_id", name.alias("pipeline"), output_table(name).alias("output"))


@query
def redacted_settings(spark, sf):
    return src.settings(spark, sf).select("s_suppkey", "key", redact("key", "value").alias("value"))


@query
def redacted_whole_words(spark, sf):
    keys = ["authToken", "dbPassword", "API_KEYS", "PASSWORDS", "author", "monkey", "keyboard", "my.key", "APIKey", "tokenizer"]
    rows = table(spark, sf, "supplier").select("s_suppkey", F.explode(F.array(*[F.lit(k) for k in keys])).alias("key"))
    value = redact("key", F.col("s_suppkey").cast("string"), whole_words=True)
    return rows.select("s_suppkey", "key", value.alias("value"))


@query
def redacted_map(spark, sf):
    settings = F.create_map(F.lit("db_token"), F.col("s_name"), F.lit("region"), F.col("s_suppkey").cast("string"))
    hidden = redact_map(settings)
    return table(spark, sf, "supplier").select("s_suppkey", F.explode(hidden).alias("key", "value"))


# ---------------------------------------------------------------- text sections


@query
def section_between(spark, sf):
    """The article of each page: the text between its first heading and its footer."""
    part = sections.section_between("html", r"<article>", r"</article>")
    return table(spark, sf, "pages").select("page_id", part.alias("article"))


@query
def page_parts(spark, sf):
    return context.page_parts(src.wiki_pages(spark, sf))


def _half(spark, sf, part):
    return context.page_parts(src.wiki_pages(spark, sf)).select("page_id", F.col(part).alias("text"))


@query
def named_blocks(spark, sf):
    return sections.named_blocks(_half(spark, sf, "inputs"), src.wiki_names(spark, sf))


@query
def marker_blocks(spark, sf):
    return sections.marker_blocks(_half(spark, sf, "logic"), src.wiki_names(spark, sf))


@query
def heading_blocks(spark, sf):
    return sections.heading_blocks(_half(spark, sf, "logic"), src.wiki_names(spark, sf))


@query
def logic_blocks(spark, sf):
    return sections.logic_blocks(_half(spark, sf, "logic"), src.wiki_names(spark, sf))


# ---------------------------------------------------------------- definition files and context


@query
def pick_file(spark, sf):
    return definitions.pick_file(src.definition_files(spark, sf), src.definition_keys(spark, sf))


@query
def key_blocks(spark, sf):
    return definitions.key_blocks(src.definition_files(spark, sf), src.definition_keys(spark, sf))


@query
def strip_keys(spark, sf):
    kept = definitions.strip_keys(src.definition_maps(spark, sf))
    attributes = kept.select("table", F.lit("").alias("column"), F.explode("attributes").alias("name", "value"))
    columns = kept.select("table", F.explode("columns").alias("column", "spec"))
    return attributes.unionByName(columns.select("table", "column", F.explode("spec").alias("name", "value")))


@query
def source_tables(spark, sf):
    return definitions.source_tables(src.pipeline_config(spark, sf))


@query
def tables_to_search(spark, sf):
    return definitions.tables_to_search(src.pipeline_config(spark, sf))


@query
def merge_definitions(spark, sf):
    """Definition of every source of every pipeline: from a file, else from its page, else a placeholder."""
    config = src.pipeline_config(spark, sf)
    blocks = definitions.key_blocks(src.definition_files(spark, sf), src.definition_keys(spark, sf))
    block = F.concat(F.lit("page of "), "pipeline").alias("block")
    explained = config.select("pipeline", F.col("pipeline").alias("table"), block)
    merged = context.merge_definitions(
        definitions.source_tables(config), blocks.withColumnRenamed("key", "table"), explained
    )
    return merged


@query
def strip_definition_text(spark, sf):
    """Definitions as text, with attributes that go and columns with and without a description."""
    text = F.format_string(
        "part_%d_feed:\n  description: %s\n  path: /x\n  primary_key:\n  - p_partkey\n  - x: y\n  storage_type: parquet\n"
        "  schema:\n    p_size:\n      type: int\n      description: size of\n        %s\n    p_brand:\n      type: string\n"
        "      format: %s\n\n  control_params: {a: 1}\n  owner: team",
        F.col("p_partkey"), F.col("p_name"), F.col("p_name"), F.col("p_brand"),
    )
    return table(spark, sf, "part").select("p_partkey", definitions.strip_definition_text(text).alias("text"))


@query
def assemble_context(spark, sf):
    parts = context.build_context(
        src.pipeline_config(spark, sf), src.wiki_pages(spark, sf), src.definition_files(spark, sf)
    )
    return context.assemble_context(parts)
