"""Multiset differences, against ``exceptAll`` and against hand-made cases."""

from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinrun.operators import diff


def counts(left, right, **kw):
    return [tuple(r) for r in diff.diff_counts(left, right, **kw).collect()]


cell = st.tuples(
    st.sampled_from([None, 0, 1, 2]),
    st.sampled_from([None, 0.0, -0.0, float("nan"), 1.5]),
    st.sampled_from([None, "", "a", "A"]),
)
SCHEMA = "i int, d double, s string"


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(cell, max_size=30), st.lists(cell, max_size=30))
def test_counts_equal_except_all(spark, a, b):
    left, right = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    expected = (len(a), len(b), left.exceptAll(right).count(), right.exceptAll(left).count())
    assert counts(left, right) == [expected]
    assert counts(left, right, keyed=True) == [expected]
    assert [tuple(r) for r in diff.diff_counts_by_hash(left, right, buckets=7).collect()] == [expected]
    grouped = [sorted(map(repr, f(left, right, by=["s"]).collect())) for f in (diff.diff_counts, diff.diff_counts_by_hash)]
    assert grouped[0] == grouped[1]


@pytest.mark.parametrize("keyed", [False, True])
def test_equal_values_with_other_bits(spark, keyed):
    """Zeros, NaNs, maps and collated text that are equal must meet in one task, at any depth."""
    n = "CAST('NaN' AS DOUBLE)"
    left = spark.sql(
        f"SELECT id, 0.0D AS z, {n} AS n, array(0.0D, {n}) AS a, struct(map('x', 0.0D, 'y', 1.0D) AS m) AS s, "
        "array(map('k', 0.0F)) AS am, 'ABC' COLLATE UTF8_LCASE AS t FROM range(50)"
    )
    right = spark.sql(
        f"SELECT id, -0.0D AS z, sqrt(-1.0D) AS n, array(-0.0D, -({n})) AS a, struct(map('y', 1.0D, 'x', -0.0D) AS m) AS s, "
        "array(map('k', -0.0F)) AS am, 'abc' COLLATE UTF8_LCASE AS t FROM range(50)"
    )
    assert counts(left, right, keyed=keyed) == [(50, 50, 0, 0)]
    for pair in ((left, right), (left.drop("t"), right.drop("t"))):  # with collated text, and without
        assert [tuple(r) for r in diff.diff_counts_by_hash(*pair).collect()] == [(50, 50, 0, 0)]


def test_equal_sides_by_hash_shuffle_no_rows(spark):
    left = spark.range(1000).select("id", F.concat(F.lit("long text "), "id").alias("t"))
    equal = diff.diff_counts_by_hash(left, left.orderBy(F.desc("id")))
    assert tuple(equal.first()) == (1000, 1000, 0, 0)
    assert "long text" not in equal._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[0]
    one = diff.diff_counts_by_hash(left, left.withColumn("t", F.when(F.col("id") == 7, "x").otherwise(F.col("t"))))
    assert tuple(one.first()) == (1000, 1000, 1, 1)
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "bucket" in plan and plan.count("Union") >= 2
    twice = diff.diff_counts_by_hash(left.union(left.where("id = 3")), left.union(left.where("id = 4")))
    assert tuple(twice.first()) == (1001, 1001, 1, 1)
    with pytest.raises(diff.NotComparable):
        diff.diff_counts_by_hash(left, left.select("id"))


def test_bucketed_sides_are_counted_where_they_lie(spark, tmp_path):
    from twinrun.sources.sinks import save_bucketed

    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    for name, df in {"bucketed_a": rows, "bucketed_b": rows.where("l_orderkey <> 1")}.items():
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        save_bucketed(df, name, str(tmp_path / name), "l_orderkey", 4)
    a, b = spark.table("bucketed_a"), spark.table("bucketed_b")
    for by in ([], ["l_returnflag"]):
        found = diff.diff_counts(a, b, by=by)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, diff.diff_counts(rows, rows.where("l_orderkey <> 1"), by=by).collect()))
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("Exchange") == 1 and "Exchange" not in plan[plan.index(", v9#") :]  # what moves are the sums
    for name in ("bucketed_a", "bucketed_b"):
        spark.sql(f"DROP TABLE {name}")


def test_null_nan_and_zero_are_equal_to_themselves(spark):
    left = spark.sql("VALUES (CAST('NaN' AS DOUBLE)), (0.0D), (NULL)")
    right = spark.sql("VALUES (NULL), (-0.0D), (CAST('NaN' AS DOUBLE))")
    assert counts(left, right) == [(3, 3, 0, 0)]


def test_empty_sides_count_zero(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert counts(empty, empty) == [(0, 0, 0, 0)]
    assert counts(empty, empty, by=["s"]) == []
    assert diff.is_empty(empty)


def test_comparison_is_by_position(spark):
    left, right = spark.sql("SELECT 1 AS a, 2 AS b"), spark.sql("SELECT 2 AS b, 1 AS a")
    assert counts(left, right) == [(1, 1, 1, 1)]
    assert counts(left, spark.sql("SELECT 1 AS x, 2 AS y")) == [(1, 1, 0, 0)]


def test_numeric_types_widen_and_text_compares_as_text(spark):
    number = spark.sql("SELECT 1 AS a")
    assert counts(number, spark.sql("SELECT 1L AS a")) == [(1, 1, 0, 0)]
    assert counts(number, spark.sql("SELECT '1' AS a")) == [(1, 1, 0, 0)]
    assert counts(spark.sql("SELECT 'x' AS a"), number) == [(1, 1, 1, 1)]


@pytest.mark.parametrize(
    "right", ["SELECT 1 AS a, 2 AS b", "SELECT struct(1) AS a", "SELECT array('1') AS a", "SELECT X'01' AS a"]
)
def test_sides_without_a_common_row_type(spark, right):
    with pytest.raises(diff.NotComparable):
        diff.diff_counts(spark.sql("SELECT '1' AS a"), spark.sql(right))


def test_nested_text_against_number_is_refused(spark):
    with pytest.raises(diff.NotComparable):
        diff.diff_counts(spark.sql("SELECT array('x') AS a"), spark.sql("SELECT array(1) AS a"))


def test_maps_at_any_depth(spark):
    left = spark.sql("SELECT map('a', 1, 'b', 2) AS m, array(struct(map('x', 0.0D) AS k)) AS n")
    right = spark.sql("SELECT map('b', 2, 'a', 1) AS m, array(struct(map('x', -0.0D) AS k)) AS n")
    assert counts(left, right) == [(1, 1, 0, 0)]
    assert counts(left, right.unionAll(right)) == [(1, 2, 0, 1)]


def test_variant_ignores_key_order(spark):
    left = spark.sql("""SELECT parse_json('{"a":1,"b":[1]}') AS v, array(struct(parse_json('1') AS x)) AS w""")
    right = spark.sql("""SELECT parse_json('{"b":[1],"a":1}') AS v, array(struct(parse_json('1') AS x)) AS w""")
    assert counts(left, right) == [(1, 1, 0, 0)]
    other = spark.sql("""SELECT parse_json('{"b":[2],"a":1}') AS v, array(struct(parse_json('1') AS x)) AS w""")
    assert counts(left, other) == [(1, 1, 1, 1)]


def test_repeated_column_names(spark):
    rows = spark.sql("SELECT 1 AS a, 2 AS a")
    assert counts(rows, rows.unionAll(rows)) == [(1, 2, 0, 1)]


def test_by_matches_by_name_and_the_rest_by_position(spark):
    left = spark.sql("VALUES ('r1', 1), ('r1', 1), ('r2', 2) AS t(run, x)")
    right = spark.sql("VALUES (1, 'r1'), (3, 'r2'), (9, 'r3') AS t(x, run)")
    got = sorted(counts(left, right, by=["run"]))
    assert got == [("r1", 2, 1, 1, 0), ("r2", 1, 1, 1, 1), ("r3", 0, 1, 0, 1)]
    with pytest.raises(ValueError):
        diff.diff_counts(left, right, by=["nope"])


def test_one_hot_row_and_one_hot_group(spark):
    left = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("r"), F.col("id") % 50)).alias("run"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("x"),
    )
    right = left.where("x <> 8")
    total = sorted(counts(left, right, by=["run"]))
    assert ("hot", 6667, 6667, 0, 0) in total
    assert sum(r[3] for r in total) == 1


def test_tally_and_differing_rows(spark):
    left = spark.sql("VALUES (1, 'a'), (1, 'a'), (2, 'b') AS t(k, v)")
    right = spark.sql("VALUES (1, 'a'), (3, 'c') AS t(k, v)")
    assert sorted(map(tuple, diff.tally(left, right).collect())) == [(1, "a", 2, 1), (2, "b", 1, 0), (3, "c", 0, 1)]
    rows = sorted(map(tuple, diff.differing_rows(left, right).collect()))
    assert rows == [(1, "a", "left", 1), (2, "b", "left", 1), (3, "c", "right", 1)]


def test_except_all_with_a_map_spells_out_all_copies(spark):
    left = spark.range(25_000).selectExpr("map('k', id % 2) AS m")
    right = spark.range(3).selectExpr("map('k', 0L) AS m")
    got = Counter(r.m["k"] for r in diff.except_all(left, right).collect())
    assert got == {0: 12_497, 1: 12_500}
    assert diff.except_all(right, left).count() == 0


@pytest.mark.parametrize("step", [2, 3, 10])
def test_repeat_is_exact_for_any_block_size(spark, step):
    rows = spark.sql("VALUES ('a', 1L), ('b', 5L), ('c', 16L) AS t(v0, copies)")
    got = Counter(r.v0 for r in diff._repeat(rows, ["v0"], step).collect())
    assert got == {"a": 1, "b": 5, "c": 16}


def test_sample_is_ordered_and_bounded(spark):
    left = spark.range(100).selectExpr("id % 10 AS x", "map('a', id % 2) AS m")
    right = left.where("x > 4")
    got = [(r.x, r.m["a"]) for r in diff.diff_sample(left, right, 12).collect()]
    assert got == [(0, 0)] * 10 + [(1, 1)] * 2
    assert diff.diff_sample(right, left, 12).count() == 0


def test_sample_by_group(spark):
    left = spark.range(40).selectExpr("concat('r', id % 2) AS run", "id AS x", "CAST(NULL AS INT) AS n")
    got = diff.sample_by_group(left, left.where("id % 2 = 0"), ["run"], 3).collect()
    assert [(r.run, r.side, r.copies) for r in got] == [("r1", "left", 1)] * 3
    assert got[0].row == '{"x":1,"n":null}'


def test_one_shuffle_of_the_rows(spark):
    left = spark.range(100).selectExpr("id % 10 AS x", "id AS y")
    plan = diff.diff_counts(left, left, ["x"])._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    )
    assert plan.count("Exchange hashpartitioning") == 2  # the rows, then the partial sums per group
    assert "SortAggregate" not in plan and "Join" not in plan
