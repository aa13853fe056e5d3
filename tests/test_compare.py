import os
import tempfile
import threading
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from twinrun.operators.tree import flatten
from twinrun.plans import compare, examples, report
from twinrun.plans.compare import Pipeline
from twinrun.sources import sinks

TESTDATA = "/root/testdata/sf0.001"


def fresh() -> str:
    return tempfile.mkdtemp(prefix="twinrun-") + "/out"


def status(rows, *keys):
    return {tuple(r[k] for k in (*keys, "path")): r.status for r in rows.collect()}


def test_flatten():
    assert flatten({"a": 1, "b": [2, (3,)]}) == {"$.a": 1, "$.b[0]": 2, "$.b[1][0]": 3}
    assert flatten(5) == {"$": 5}


def test_tree_statuses(spark):
    df = spark.range(3)
    left = {"same": df, "rows": df, "none": df, "short": [df, df], "plain": 1, "odd": "a", "both": None}
    right = {"same": df, "rows": df.limit(2), "none": None, "short": [df], "plain": 1, "odd": "b", "new": df, "both": None}
    assert status(compare.compare_outputs(spark, left, right)) == {
        ("$.same",): "PASS",
        ("$.rows",): "FAIL",
        ("$.none",): "MISSING_LEAF",
        ("$.short[0]",): "PASS",
        ("$.short[1]",): "MISSING_LEAF",
        ("$.plain",): "PASS",
        ("$.odd",): "FAIL",
        ("$.both",): "PASS",
        ("$.new",): "MISSING_LEAF",
    }


def test_schema_mismatch_fails_with_clean_rows(spark):
    row = compare.compare_outputs(spark, spark.sql("SELECT 1 AS a"), spark.sql("SELECT 1L AS a")).first()
    assert (row.status, row.only_in_left, row.schema_match, row.comparable) == ("FAIL", 0, False, False)
    assert row.error.startswith("Mismatch at $: schema differs: column 'a'")


def test_nested_nullability_is_named(spark):
    left = spark.sql("SELECT named_struct('x', 1) AS s")
    right = spark.sql("SELECT named_struct('x', CAST(NULL AS INT)) AS s")
    row = compare.compare_outputs(spark, left, right).first()
    assert "x:int not null" in row.schema_differences[0]


def test_other_column_counts_do_not_spoil_the_other_leaves(spark):
    df = spark.sql("SELECT 1 AS a, 2 AS b")
    rows = compare.compare_outputs(spark, [df, df], [df, df.select("a")])
    assert status(rows) == {("$[0]",): "PASS", ("$[1]",): "FAIL"}
    bad = rows.where("path = '$[1]'").first()
    assert (bad.left_count, bad.right_count, bad.only_in_left, bad.comparable) == (1, 1, None, False)


def test_assert_equal(spark):
    df = spark.sql("VALUES (1, 'a'), (1, 'a'), (2, NULL) AS t(k, v)")
    compare.assert_equal(df, df.orderBy("k"))
    with pytest.raises(AssertionError, match="only in left: 1, only in right: 0") as e:
        compare.assert_equal(df, df.distinct())
    assert "{'k': 1, 'v': 'a'}" in str(e.value)
    with pytest.raises(AssertionError, match="schema differs: column 'v' only in legacy"):
        compare.assert_equal(df, df.select("k"))


def test_assert_trees_equal_names_the_path(spark):
    df = spark.range(3)
    compare.assert_trees_equal({"a": [df]}, {"a": (df,)})
    with pytest.raises(AssertionError, match=r"Mismatch at \$\.a\[0\]: left has 3 rows, right 2"):
        compare.assert_trees_equal({"a": [df]}, {"a": [df.limit(2)]})
    with pytest.raises(AssertionError, match=r"Mismatch at \$\.b"):
        compare.assert_trees_equal({"a": df, "b": df}, {"a": df})


def runs_of(spark, *ids):
    rows = [Row(run_id=i, run_date=None, raw_path=f"/raw/{i}/") for i in ids]
    return spark.createDataFrame(rows, "run_id string, run_date date, raw_path string")


def test_compare_runs_reports_exactly_the_given_runs(spark):
    left = spark.sql("VALUES ('a', 1), ('b', 2), ('z', 9) AS t(run_id, x)")
    right = spark.sql("VALUES ('a', 1), ('b', 3) AS t(run_id, x)")
    rows = compare.compare_runs(spark, {"t": left, "n": 1}, {"t": right, "n": 1}, runs_of(spark, "a", "b", "empty"))
    assert status(rows, "run_id") == {
        ("a", "$.t"): "PASS",
        ("b", "$.t"): "FAIL",
        ("empty", "$.t"): "PASS",
        ("a", "$.n"): "PASS",
        ("b", "$.n"): "PASS",
        ("empty", "$.n"): "PASS",
    }
    empty = rows.where("run_id = 'empty' AND path = '$.t'").first()
    assert (empty.left_count, empty.raw_path) == (0, "/raw/empty/")
    without = compare.compare_runs(spark, left, right)
    assert status(without, "run_id") == {("a", "$"): "PASS", ("b", "$"): "FAIL", ("z", "$"): "FAIL"}


def test_compare_run_has_its_date(spark):
    row = compare.compare_run(spark, "evt-2024-01-02-a", spark.range(2), spark.range(2), "/raw/").first()
    assert (row.run_id, str(row.run_date), row.raw_path, row.status) == ("evt-2024-01-02-a", "2024-01-02", "/raw/", "PASS")


def pipeline():
    """Run ids choose what happens: 'bad' differs, 'boom' fails while it runs, 'early' while it is planned."""

    def read(spark, run):
        return {"in": spark.range(5).withColumn("p", F.lit(run.raw_path))}

    def left(inputs, run, factor):
        if run.run_id == "early":
            raise ValueError("no such input")
        return {"out": inputs["in"].withColumn("id", F.col("id") * factor)}

    def right(inputs, run, factor):
        out = left(inputs, run, factor)["out"]
        if run.run_id == "bad":
            out = out.where("id > 0")
        if run.run_id == "boom":
            out = out.withColumn("id", F.raise_error(F.lit("broken file")).cast("bigint"))
        if run.run_id == "wide":
            out = out.withColumn("more", F.lit(1))
        return {"out": out}

    return Pipeline(read, left, right, {"factor": 2})


@pytest.mark.parametrize("batch_size, parallel", [(1, 1), (4, 1), (50, 1), (1, 3), (2, 4)])
def test_each_run_isolates_failures(spark, batch_size, parallel):
    runs = runs_of(spark, "good", "bad", "boom", "early", "wide", "last")
    out = compare.compare_each_run(spark, pipeline(), runs, fresh(), batch_size=batch_size, parallel=parallel)
    got = {r.run_id: r for r in out.collect()}
    assert {k: r.status for k, r in got.items()} == {
        "good": "PASS",
        "bad": "FAIL",
        "boom": "ERROR",
        "early": "ERROR",
        "wide": "FAIL",
        "last": "PASS",
    }
    assert "broken file" in got["boom"].error and "no such input" in got["early"].error
    assert (got["bad"].only_in_left, got["bad"].raw_path) == (1, "/raw/bad/")
    assert report.summarise(out).first().asDict() == {"total": 6, "passed": 2, "failed": 4, "verdict": "FAIL"}
    assert sorted(r.run_id for r in report.passed_runs(out).collect()) == ["good", "last"]


def test_fail_fast_stops_after_the_batch_is_written(spark):
    path = fresh()
    with pytest.raises(AssertionError, match="bad"):
        compare.compare_each_run(spark, pipeline(), runs_of(spark, "a", "bad", "c"), path, batch_size=2, fail_fast=True)
    assert sorted(r.run_id for r in spark.read.parquet(path).collect()) == ["a", "bad"]


def test_no_runs_is_not_a_pass(spark):
    out = compare.compare_each_run(spark, pipeline(), runs_of(spark).limit(0), fresh())
    assert [r.status for r in out.collect()] == ["NO_RUNS"]
    assert report.summarise(out).first().asDict() == {"total": 0, "passed": 0, "failed": 0, "verdict": "NO_RUNS"}
    with pytest.raises(AssertionError, match="no runs"):
        compare.compare_each_run(spark, pipeline(), runs_of(spark).limit(0), fresh(), fail_fast=True)


def test_a_batch_written_twice_is_there_once(spark, monkeypatch):
    """The outcome of a commit gets lost after the rows are written: the batch is split and written again."""
    commit, lost = compare._commit, []

    def unlucky(rows, path):
        commit(rows, path)
        if len(lost) < 2:
            lost.append(path)
            raise ConnectionError("no answer")

    monkeypatch.setattr(compare, "_commit", unlucky)
    path = fresh()
    out = compare.compare_each_run(spark, pipeline(), runs_of(spark, "a", "b", "bad", "c"), path)
    assert sorted((r.run_id, r.status) for r in out.collect()) == [("a", "PASS"), ("b", "PASS"), ("bad", "FAIL"), ("c", "PASS")]
    assert len(lost) == 2
    again = compare.compare_each_run(spark, pipeline(), runs_of(spark, "a", "d"), path, resume=True)
    assert sorted(r.run_id for r in again.collect()) == ["a", "b", "bad", "c", "d"]


def test_run_ids_come_back_as_they_were(spark):
    """Ids that look like dates, numbers or paths stay text, in a report that is partitioned by run."""
    ids = ["2024-01-05", "007", "a/b=c", "x y%", "null", "__HIVE_DEFAULT_PARTITION__"]
    path = fresh()
    out = compare.compare_each_run(spark, pipeline(), runs_of(spark, *ids), path)
    assert out.columns == ["run_id", "run_date", "raw_path", *[n for n, _ in compare.REPORT]]
    assert sorted(r.run_id for r in out.collect()) == sorted(ids) == sorted(r.run_id for r in spark.read.parquet(path).collect())


def test_batches_run_side_by_side(spark):
    """Four batches that wait for each other: one after the other they would never end."""
    meet = threading.Barrier(4, timeout=60)
    pools = set()

    def read(spark, run):
        meet.wait()
        pools.add(spark.sparkContext.getLocalProperty("spark.scheduler.pool"))
        return {"in": spark.range(3)}

    same = lambda inputs, run: inputs["in"]
    out = compare.compare_each_run(spark, Pipeline(read, same, same), runs_of(spark, *"abcdefgh"), fresh(), batch_size=1, parallel=4)
    assert sorted((r.run_id, r.status) for r in out.collect()) == [(k, "PASS") for k in "abcdefgh"]
    assert pools == {f"twinrun-{n}" for n in range(4)} and spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None


def test_fail_fast_begins_no_more_batches(spark):
    path = fresh()
    ids = ["bad", *[f"r{n}" for n in range(8)]]
    with pytest.raises(AssertionError, match="bad"):
        compare.compare_each_run(spark, pipeline(), runs_of(spark, *ids), path, batch_size=1, fail_fast=True, parallel=2)
    written = {r.run_id for r in compare.read_report(spark, path).collect()}
    assert "bad" in written and len(written) < len(ids)


def test_timeout_reaches_all_threads(spark):
    def slow(inputs, run):
        return spark.range(200, numPartitions=1).select(F.expr("java_method('java.lang.Thread', 'sleep', 300L)").alias("x"))

    start = time.time()
    found = compare.compare_each_run(
        spark, Pipeline(lambda s, r: {}, slow, slow), runs_of(spark, *"abcde"), fresh(), timeout_minutes=0.05, batch_size=1, parallel=2
    )
    assert {(r.run_id, r.status, r.error) for r in found.collect()} == {(k, "ERROR", compare.OUT_OF_TIME) for k in "abcde"}
    assert time.time() - start < 40


def test_plain_leaves_of_any_kind(spark):
    import numpy as np

    class Odd:
        def __eq__(self, other):
            raise TypeError("cannot compare")

    left = {"a": np.arange(3), "b": np.arange(3), "c": Odd(), "d": 1}
    right = {"a": np.arange(3), "b": np.arange(3) + 1, "c": Odd(), "d": 1}
    got = {r.path: r.status for r in compare.compare_outputs(spark, left, right).collect()}
    assert got == {"$.a": "PASS", "$.b": "FAIL", "$.c": "ERROR", "$.d": "PASS"}


def test_timeout_cancels_the_jobs(spark):
    def slow(inputs, run):
        return spark.range(200, numPartitions=1).select(F.expr("java_method('java.lang.Thread', 'sleep', 300L)").alias("x"))

    step = Pipeline(lambda s, r: {}, slow, slow)
    start = time.time()
    found = compare.compare_each_run(spark, step, runs_of(spark, "a", "b", "c"), fresh(), timeout_minutes=0.05, batch_size=2)
    assert {(r.run_id, r.status, r.error) for r in found.collect()} == {(k, "ERROR", compare.OUT_OF_TIME) for k in "abc"}
    assert time.time() - start < 40
    assert spark.range(5).count() == 5  # the session goes on


@pytest.mark.parametrize(
    "pair, names",
    [
        (examples.unused_columns("EUR"), ["orders"]),
        (examples.dead_branches(), ["orders", "customer", "part"]),
        (examples.needless_aliases(), ["customer", "nation", "region"]),
    ],
)
def test_example_pairs_pass_and_mutations_fail(spark, pair, names):
    for name in names:
        spark.read.parquet(f"{TESTDATA}/{name}.parquet").createOrReplaceTempView(name)
    left, right = pair.outputs(spark)
    compare.assert_equal(left, right)
    with pytest.raises(AssertionError):
        compare.assert_equal(left, right.limit(100))
    with pytest.raises(AssertionError):
        compare.assert_equal(left, right.withColumn("extra", F.lit(1)))


def test_clutter_leaves_no_trace_in_the_plan(spark):
    spark.read.parquet(f"{TESTDATA}/orders.parquet").createOrReplaceTempView("orders")
    left, _ = examples.unused_columns("EUR").outputs(spark)
    optimized = left._jdf.queryExecution().optimizedPlan().toString()
    assert "rate" not in optimized and "gross" not in optimized and "1.19" not in optimized


def test_report_table_and_text(spark):
    left = spark.sql("VALUES ('a-2024-01-01', 1), ('b-2024-01-02', 2) AS t(run_id, x)")
    right = spark.sql("VALUES ('a-2024-01-01', 1), ('b-2024-01-02', 3) AS t(run_id, x)")
    runs = runs_of(spark, "a-2024-01-01", "b-2024-01-02").withColumn("run_date", F.to_date(F.substr("run_id", F.lit(3))))
    table, text = fresh(), fresh()
    sinks.write_report(compare.compare_runs(spark, left, right, runs), table)
    saved = spark.read.parquet(table)
    assert [(r.run_id, r.error) for r in report.failed_runs(saved).collect()] == [
        ("b-2024-01-02", "Mismatch at $: rows differ: 1 only in left, 1 only in right (duplicates count)")
    ]
    sinks.write_report_text(saved, text)
    lines = [r.value for r in spark.read.text(text).collect()]
    assert lines[:4] == ["comparison report", "=" * 60, "run_ids: 2", ""]
    assert lines[-1] == "Passed: 1 / 2"
    assert lines.index("run_id:     b-2024-01-02") < lines.index("run_id:     a-2024-01-01")


def test_an_existing_report_is_not_touched(spark):
    path = fresh()
    spark.range(1).write.parquet(path)
    with pytest.raises(ValueError, match="already"):
        compare.compare_each_run(spark, pipeline(), runs_of(spark, "a"), path)


def test_report_column_names_are_reserved(spark):
    df = spark.sql("SELECT 'a' AS run_id, 1 AS x")
    with pytest.raises(ValueError, match="status"):
        compare.compare_runs(spark, df, df, df.select("run_id").withColumn("status", F.lit("x")))


def test_fixed_inputs_are_read_once(spark, monkeypatch):
    """Random input differs from read to read; written once to the shared folder it is the same for both versions."""
    folder = tempfile.mkdtemp(prefix="twinrun-")
    monkeypatch.setattr("twinrun.session.scratch_dir", lambda spark: folder)
    same = lambda inputs, run: inputs["in"]
    read = lambda spark, run: {"in": spark.range(100).select(F.expr("uuid()").alias("x"))}
    left, right = Pipeline(read, same, same, fixed_inputs=True).outputs(spark)
    compare.assert_equal(left, right)


def test_trees_that_differ_in_shape(spark):
    df = spark.range(3)
    unequal = [
        ({"a": {}, "b": df}, {"b": df}),
        ({"a": {}}, {"a": []}),
        ({"b": df}, {"b": df, "c": []}),
        ({"a.b": df, "a": {"b": df}}, {"a.b": df.limit(1), "a": {"b": df}}),
        ({1: df}, {"1": df}),
        ([df], {0: df}),
        ({}, []),
    ]
    for left, right in unequal:
        with pytest.raises(AssertionError):
            compare.assert_trees_equal(left, right)
    for tree in ({}, [], {"a": {}}, {"a.b": df, "a": {"b": df}}):
        compare.assert_trees_equal(tree, tree)
    assert [(r.path, r.status) for r in compare.compare_outputs(spark, {}, {}).collect()] == [("$", "PASS")]


def test_resume_takes_the_runs_without_rows(spark):
    path, reads = fresh(), []

    def read(spark, run):
        reads.append(run.run_id)
        return {"in": spark.range(3)}

    same = lambda inputs, run: inputs["in"]
    step = Pipeline(read, same, same)
    compare.compare_each_run(spark, step, runs_of(spark, "a", "b"), path)
    found = compare.compare_each_run(spark, step, runs_of(spark, "a", "b", "c"), path, resume=True)
    assert sorted(r.run_id for r in found.collect()) == ["a", "b", "c"] and sorted(reads) == ["a", "b", "c"]


def test_inputs_are_fixed_once_and_removed(spark, monkeypatch):
    folder, reads = tempfile.mkdtemp(prefix="twinrun-"), []
    monkeypatch.setattr("twinrun.session.scratch_dir", lambda spark: folder)
    step = pipeline()

    def read(spark, run):
        reads.append(run.run_id)
        return step.read(spark, run)

    fixed = Pipeline(read, step.left, step.right, step.options, fixed_inputs=True)
    found = compare.compare_each_run(spark, fixed, runs_of(spark, "a", "boom", "b", "early"), fresh())
    assert sorted((r.run_id, r.status) for r in found.collect()) == [("a", "PASS"), ("b", "PASS"), ("boom", "ERROR"), ("early", "ERROR")]
    assert len(reads) == 4 and os.listdir(folder) == []


def test_schema_lines_in_the_text_report(spark):
    """Columns of both sides, also of leaves on one side; totals come with the write and are not worked out again."""
    left = {"t": spark.sql("SELECT 'a' AS run_id, 1 AS x"), "only": spark.sql("SELECT 'a' AS run_id, 1 AS y")}
    right = {"t": spark.sql("SELECT 'a' AS run_id, 2L AS x")}
    table, text = fresh(), fresh()
    found = compare.compare_runs(spark, left, right).withColumns({"run_date": F.lit(None).cast("date")})
    assert sinks.write_report(found, table) == {"total": 1, "passed": 0}
    sinks.write_stored_report_text(spark, table, text)
    lines = [r.value for r in spark.read.text(text).collect()]
    pair = "  " + "x: int (nullable=False)".ljust(52) + " | x: bigint (nullable=False)"
    alone = "  " + "y: int (nullable=False)".ljust(52) + " | (missing)"
    assert pair in lines and alone in lines and lines.index(pair) > lines.index("path:       $.t")
    assert lines[2] == "run_ids: 1" and lines[-1] == "Passed: 0 / 1"
    assert spark.read.parquet(table).columns == found.columns
    saved = spark.read.parquet(table)
    plan = report.report_lines(saved, spark.read.parquet(f"{table}/{sinks.TOTALS}"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("schema_columns#") > 0 and plan.count("Relation") == 3  # the report once, the totals for head and foot


def test_totals_are_counted_while_writing(spark):
    runs = runs_of(spark, "good", "bad", "wide", "last")
    out = compare.compare_each_run(spark, pipeline(), runs, fresh())
    assert sinks.write_report(out, fresh()) == {"total": 4, "passed": 2}
    none = compare.compare_each_run(spark, pipeline(), runs.limit(0), fresh())
    assert sinks.write_report(none, fresh()) == {"total": 0, "passed": 0}


def test_bad_lines_spoil_their_run_only(spark, tmp_path):
    from twinrun.sources.readers import read_delimited

    for run, text in {"a": "1|x\n2|y\n", "b": "1|x\nzwei|y\n3\n4|z|more\n", "c": "5|v\n"}.items():
        (tmp_path / f"{run}.csv").write_text(text)

    def read(spark, run):
        return {"in": read_delimited(spark, str(tmp_path / f"{run.run_id}.csv"), "n int, t string", "|", header=False, keep_bad_lines=True)}

    same = lambda inputs, run: {"out": inputs["in"].select("t")}
    out = compare.compare_each_run(spark, Pipeline(read, same, same), runs_of(spark, *"abc"), fresh())
    got = {(r.run_id, r.path): (r.status, r.left_count, r.error) for r in out.collect()}
    assert got == {
        ("a", "$.out"): ("PASS", 2, None), ("b", "$.out"): ("PASS", 1, None), ("c", "$.out"): ("PASS", 1, None),
        ("b", "inputs.in"): ("ERROR", None, "inputs.in: 3 lines cannot be read, such as: 3"),
    }
    assert [r.run_id for r in report.failed_runs(out).collect()] == ["b"]
    with pytest.raises(ValueError, match="bad lines"):
        Pipeline(read, same, same).outputs(spark, Row(run_id="a"))
