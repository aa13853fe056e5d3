"""Inputs of the registered queries, all derived from the given tables by Spark so that they grow with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- runs


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd")
    return table(spark, sf_dir, "events").withColumn("run_id", F.concat(F.lit("evt-"), day))


def run_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events by run. The seeded difference: the right side lacks some users."""
    left = event_runs(spark, sf_dir).select("run_id", "user_id", "event_type")
    return left, left.where("user_id % 50 <> 7")


def feed_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = ["feed/", "event_type", "/run_id=", "run_id", "/part-", "event_id % 4", ".parquet"]
    literal = {"feed/", "/run_id=", "/part-", ".parquet"}
    name = F.concat(*[F.lit(p) if p in literal else F.expr(p).cast("string") for p in parts])
    return event_runs(spark, sf_dir).select(name.alias("name"))


def mixed_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good names in both layouts, and every kind of bad one."""
    day = F.date_format("ts", "yyyy-MM-dd")
    kind = F.col("event_id") % 9
    name = (
        F.when(kind == 0, F.lit(None))
        .when(kind == 1, F.lit(""))
        .when(kind == 2, F.concat(F.lit("feed/no-date/part-"), F.col("event_type")))
        .when(kind == 3, F.concat(F.lit("feed/t/run_id=run_"), day, F.lit("/x")))
        .when(kind == 4, F.lit("feed/t/run_id=r-2024-13-45/x"))
        .when(kind == 5, F.concat(F.lit("feed//"), F.col("event_type"), F.lit("-"), day, F.lit("/x")))
        .when(kind == 6, F.concat(F.lit("other/t/run_id=o-"), day, F.lit("/x")))
        .when(kind == 7, F.concat(F.lit("feed/t/run_id=/run_id=late-"), day, F.lit("/x")))
        .otherwise(F.concat(F.lit("feed/t/run_id=r-"), day, F.lit("-a/x")))
    )
    return table(spark, sf_dir, "events").select(name.alias("name"))


def history_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot folders three days behind the events, so the last three days have none."""
    taken = F.expr("ts - INTERVAL 3 DAYS")
    folder = F.date_format(taken, "yyyy-MM-dd'T'HHmmss.SSS'Z'")
    return table(spark, sf_dir, "events").select(F.concat(F.lit("history/"), folder, F.lit("/store.csv")).alias("name"))


# ---------------------------------------------------------------- pages


def wiki_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page for ten customers each: ``page_id, html``, with input blocks, ``****`` sections and ``#`` sections."""
    customer = table(spark, sf_dir, "customer")
    name, seg, key = F.col("c_name"), F.col("c_mktsegment"), F.col("c_custkey")
    form = key % 3
    head = (
        F.when(form == 0, F.format_string("<p>%s:</p>", name))
        .when(form == 1, F.format_string("<p>  %s </p>", F.upper(name)))
        .otherwise(F.format_string("<div>%s : see below</div>", name))
    )
    again = F.when(key % 4 == 0, F.format_string("<li>%s:</li><li>again</li>", name)).otherwise("")
    about = F.concat(head, F.format_string("<p>segment %s &amp; more</p>", seg), again)
    marked = F.when(key % 2 == 0, F.format_string("<p>****</p><p>%s:</p><p>logic of <b>%s</b></p>", name, seg))
    headed = F.when(key % 2 == 1, F.format_string("<p># %s</p><p>rule of %s</p>", name, seg))
    rows = customer.select(
        F.expr("c_custkey div 10").alias("page_id"), key.alias("k"), about.alias("a"), marked.alias("m"), headed.alias("h")
    )
    ordered = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("k", "a", "m", "h"))).alias("all"))

    def joined(part: str):
        return F.array_join(F.transform("all", lambda x: F.coalesce(x[part], F.lit(""))), "")

    html = F.concat(
        F.lit("<h1>Wiki</h1><h2>Input Data  Explanations</h2>"),
        joined("a"),
        F.lit("<h2>Pre-ETL Business Logics</h2>"),
        joined("m"),
        F.lit("<p>****</p>"),
        joined("h"),
    )
    return ordered.select("page_id", html.alias("html"))


def wiki_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    return customer.select(F.expr("c_custkey div 10").alias("page_id"), F.col("c_name").alias("name"))


# ---------------------------------------------------------------- definition files


def definition_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for twenty parts each; all parts are defined once more in later files."""
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    trap = F.when(key % 5 == 0, F.format_string("blocked_part_%d_feed:\n  description: no\n", key)).otherwise("")
    entry = F.format_string(
        "part_%d_feed:\n  description: %s\n  schema:\n    p_size:\n      type: int\n\n", key, F.col("p_name")
    )
    indent = F.when(key % 7 == 0, "  ").otherwise("")
    first = part.select(F.format_string("defs/%05d.yml", F.expr("p_partkey div 20")).alias("path"), "p_partkey",
                        F.concat(trap, indent, entry).alias("text"))
    again = part.select(
        F.format_string("more/%05d.yml", F.expr("p_partkey div 200")).alias("path"), "p_partkey",
        F.format_string("part_%d_feed:\n  description: later\n", key).alias("text"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("p_partkey", "text")))
    content = F.array_join(F.transform(ordered, lambda x: x["text"]), "")
    return first.unionByName(again).groupBy("path").agg(F.concat(F.lit("# generated\n"), content).alias("content"))


def definition_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(F.format_string("part_%d_feed", "p_partkey").alias("key"))


def definition_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as parsed maps: ``table, attributes, columns``."""
    part = table(spark, sf_dir, "part")
    text = lambda c: F.col(c).cast("string")
    attributes = F.create_map(
        F.lit("description"), F.col("p_name"), F.lit("path"), F.lit("/x"), F.lit("primary_key"), text("p_partkey"),
        F.lit("storage_type"), F.lit("parquet"), F.lit("type"), F.col("p_type"),
    )
    described = F.create_map(F.lit("type"), F.lit("int"), F.lit("description"), F.concat(F.lit("size of "), "p_name"))
    bare = F.create_map(F.lit("type"), F.lit("string"), F.lit("format"), F.col("p_brand"))
    return part.select(
        F.format_string("part_%d_feed", "p_partkey").alias("table"),
        attributes.alias("attributes"),
        F.create_map(F.lit("p_size"), described, F.lit("p_brand"), bare).alias("columns"),
    )


# ---------------------------------------------------------------- pipelines


def pipeline_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pipeline, page_id, sources``: one pipeline per customer, with a shared table, one without a name, its own
    output table, a table only the page explains, and one nobody defines."""
    customer = table(spark, sf_dir, "customer")
    spec = lambda value: F.struct(value.alias("table_name"))
    sources = F.create_map(
        F.lit("shared"), spec(F.format_string("part_%d_feed", F.col("c_custkey") % 50)),
        F.lit("unnamed"), spec(F.lit(None).cast("string")),
        F.lit("own"), spec(F.concat("c_name", F.lit("_feed"))),
        F.lit("explained"), spec(F.col("c_name")),
        F.lit("ghost"), spec(F.lit("ghost_feed")),
    )
    return customer.select(
        F.col("c_name").alias("pipeline"), F.expr("c_custkey div 10").alias("page_id"), sources.alias("sources")
    )


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.explode(F.array(*[F.lit(k) for k in ("API_KEY", "author", "region", "db_password")])).alias("key")
    value = F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.concat(F.lit("v"), F.col("s_suppkey").cast("string")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", keys, value.alias("value"))
