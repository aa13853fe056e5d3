import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinrun.operators import schema


def found(spark, left, right, **kw):
    rows = schema.schema_diff(spark, left, right, **kw).orderBy("path", "pos").collect()
    return [(r.kind, r.name) for r in rows]


def frame(spark, ddl):
    return spark.createDataFrame([], T._parse_datatype_string(ddl))


@pytest.mark.parametrize(
    "left, right, expected",
    [
        ("a int, b string", "a int, b string", []),
        ("a int, b string", "a int, c string", [("left_only", "b"), ("right_only", "c")]),
        ("a int", "a bigint", [("changed", "a")]),
        ("a int not null", "a int", [("changed", "a")]),
        ("a struct<x: int not null>", "a struct<x: int>", [("changed", "a")]),
        ("a int, b string", "b string, a int", [("order", "")]),
        ("a int, b string, c int", "b string, a int", [("left_only", "c")]),
        ("z int, y int, x int", "x bigint, w int", [("left_only", "y"), ("left_only", "z"), ("right_only", "w"), ("changed", "x")]),
    ],
)
def test_differences(spark, left, right, expected):
    l, r = frame(spark, left), frame(spark, right)
    assert found(spark, l, r) == expected
    assert schema.same_schema(l.schema, r.schema) == (not expected)


def test_repeated_names_are_reported(spark):
    twice, once = spark.sql("SELECT 1 AS a, 'x' AS a"), spark.sql("SELECT 1 AS a")
    assert found(spark, twice, once) == [("duplicate", "a")]
    assert found(spark, twice, twice) == []
    assert found(spark, twice, spark.sql("SELECT 'x' AS a, 1 AS a")) == [("duplicate", "a")]


def test_metadata_counts_only_on_request(spark):
    plain = frame(spark, "a int")
    noted = plain.select(F.col("a").alias("a", metadata={"note": 1}))
    assert schema.same_schema(plain.schema, noted.schema)
    assert not schema.same_schema(plain.schema, noted.schema, check_metadata=True)
    assert found(spark, plain, noted) == []
    assert found(spark, plain, noted, check_metadata=True) == [("changed", "a")]


def test_wording(spark):
    l, r = frame(spark, "a int not null, b int"), frame(spark, "a bigint, c int")
    texts = [x.difference for x in schema.schema_diff(spark, l, r).orderBy("pos").collect()]
    assert texts == [
        "column 'b' only in legacy",
        "column 'c' only in refactored",
        "column 'a': legacy (int, nullable=False) vs refactored (bigint, nullable=True)",
    ]


def test_side_by_side_is_padded_with_missing(spark):
    l, r = schema.schema_rows(spark, frame(spark, "a int, b int")), schema.schema_rows(spark, frame(spark, "a int"))
    rows = schema.match_by_position(l, r).orderBy("ordinal").collect()
    assert [(x.left_field, x.right_field) for x in rows] == [
        ("a: int (nullable=True)", "a: int (nullable=True)"),
        ("b: int (nullable=True)", "(missing)"),
    ]
    assert [x.name for x in schema.columns_only_in_left(l, r).collect()] == ["b"]
    assert [x.name for x in schema.columns_in_both(l, r).collect()] == ["a"]


def test_trees_compare_common_paths(spark):
    a, b = frame(spark, "a int"), frame(spark, "b int")
    left, right = {"x": a, "y": [a, a]}, {"x": b, "y": [a]}
    rows = schema.schema_diff(spark, left, right).collect()
    assert {r.path for r in rows} == {"$.x"}
    assert sorted({r.path for r in schema.schema_rows(spark, left).collect()}) == ["$.x", "$.y[0]", "$.y[1]"]
