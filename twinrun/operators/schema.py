"""Schemas as rows, and their comparison.

The strict rule is: the same columns in the same order with the same names, types and nullability, at every level of
nesting. Field metadata counts only with ``check_metadata``.
"""

from __future__ import annotations

import json
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinrun.operators.tree import Tree, frames

# Names of the sides and the wording of a difference.
LEFT_NAME, RIGHT_NAME = "legacy", "refactored"
MISSING = "(missing)"
FIELD_TEXT = "%s: %s (nullable=%s)"
TYPE_TEXT = "(%s, nullable=%s)"
TYPE_METADATA_TEXT = "(%s, nullable=%s, metadata=%s)"
ORDER_DIFFERS = f"column order differs: {LEFT_NAME} order vs {RIGHT_NAME} order"

# Difference kinds in report order.
KINDS = ("left_only", "right_only", "changed", "duplicate", "order")

_ROWS = pa.schema(
    [
        pa.field("path", pa.string(), nullable=False),
        pa.field("ordinal", pa.int32(), nullable=False),
        pa.field("name", pa.string(), nullable=False),
        pa.field("type", pa.string(), nullable=False),
        pa.field("nullable", pa.bool_(), nullable=False),
        pa.field("metadata", pa.string(), nullable=False),
    ]
)


def type_text(dtype: T.DataType) -> str:
    """``simpleString`` with nested nullability spelled out, so types that differ only there read differently."""
    if isinstance(dtype, T.ArrayType):
        return f"array<{type_text(dtype.elementType)}{'' if dtype.containsNull else ' not null'}>"
    if isinstance(dtype, T.MapType):
        value = type_text(dtype.valueType) + ("" if dtype.valueContainsNull else " not null")
        return f"map<{type_text(dtype.keyType)},{value}>"
    if isinstance(dtype, T.StructType):
        fields = [f"{f.name}:{type_text(f.dataType)}{'' if f.nullable else ' not null'}" for f in dtype.fields]
        return f"struct<{','.join(fields)}>"
    return dtype.simpleString()


def _metadata(field: T.StructField) -> str:
    """All metadata of a field, nested fields included, as one text."""

    def walk(dtype):
        if isinstance(dtype, T.ArrayType):
            return walk(dtype.elementType)
        if isinstance(dtype, T.MapType):
            return [walk(dtype.keyType), walk(dtype.valueType)]
        if isinstance(dtype, T.StructType):
            return [[f.metadata or {}, walk(f.dataType)] for f in dtype.fields]
        return None

    return json.dumps([field.metadata or {}, walk(field.dataType)], sort_keys=True)


def field_rows(schema: T.StructType, path: str = "$") -> list[dict]:
    return [
        {
            "path": path,
            "ordinal": i,
            "name": f.name,
            "type": type_text(f.dataType),
            "nullable": f.nullable,
            "metadata": _metadata(f),
        }
        for i, f in enumerate(schema.fields)
    ]


def same_schema(left: T.StructType, right: T.StructType, check_metadata: bool = False) -> bool:
    """The strict rule on two schemas."""

    def key(schema):
        return [(r["name"], r["type"], r["nullable"], r["metadata"] if check_metadata else "") for r in field_rows(schema)]

    return key(left) == key(right)


def side_by_side(left: T.StructType | None, right: T.StructType | None) -> list[tuple[str, str]]:
    """The columns of two schemas by position, in words, padded with ``(missing)``; a side that is None has none."""
    texts = [[FIELD_TEXT % (r["name"], r["type"], r["nullable"]) for r in field_rows(s)] if s else [] for s in (left, right)]
    return list(zip_longest(*texts, fillvalue=MISSING))


def _field_text() -> Column:
    nullable = F.initcap(F.col("nullable").cast("string"))
    return F.format_string(FIELD_TEXT, "name", "type", nullable)


def leaf_rows(spark: SparkSession, leaves: dict[str, DataFrame]) -> DataFrame:
    """``schema_rows`` of leaves already flattened to a dict by path."""
    rows = [row for path, df in leaves.items() for row in field_rows(df.schema, path)]
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=_ROWS)).withColumn("field", _field_text())


def schema_rows(spark: SparkSession, tree: Tree) -> DataFrame:
    """One row per column of every DataFrame in an output tree: ``path, ordinal, name, type, nullable, metadata, field``."""
    return leaf_rows(spark, frames(tree))


def match_by_position(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two sets of schema rows side by side: ``path, ordinal, left_field, right_field``, padded with ``(missing)``."""
    l = left.select("path", "ordinal", F.col("field").alias("left_field"))
    r = right.select("path", "ordinal", F.col("field").alias("right_field"))
    return l.join(r, ["path", "ordinal"], "full").select(
        "path",
        "ordinal",
        F.coalesce("left_field", F.lit(MISSING)).alias("left_field"),
        F.coalesce("right_field", F.lit(MISSING)).alias("right_field"),
    )


def match_by_name(left: DataFrame, right: DataFrame, check_metadata: bool = False) -> DataFrame:
    """Columns matched on ``(path, name)``: ``path, name, left_defs, right_defs``, each a list in column order.

    A list is empty when the side lacks the column, and longer than one when the name is repeated. The two sides are
    tagged, united and grouped: a full outer join in one shuffle, by path, that the steps on top can share.
    """

    def side(rows: DataFrame, tag: str) -> DataFrame:
        nullable = F.initcap(F.col("nullable").cast("string"))
        text = F.format_string(TYPE_TEXT, "type", nullable)
        if check_metadata:
            plain = F.col("metadata") == _metadata(T.StructField("", T.NullType()))
            more = F.format_string(TYPE_METADATA_TEXT, "type", nullable, "metadata")
            text = F.when(plain, text).otherwise(more)
        return rows.select("path", "name", F.lit(tag).alias("side"), F.struct("ordinal", text.alias("text")).alias("d"))

    def defs(tag: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("side") == tag, F.col("d"))))

    both = side(left, "l").union(side(right, "r")).repartition("path")
    return both.groupBy("path", "name").agg(defs("l").alias("left_defs"), defs("r").alias("right_defs"))


def columns_only_in_left(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, ["path", "name"], "left_anti").select("path", "name")


def columns_in_both(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, ["path", "name"], "left_semi").select("path", "name").distinct()


def schema_diff_rows(left: DataFrame, right: DataFrame, check_metadata: bool = False) -> DataFrame:
    """Differences between two sets of schema rows: ``path, pos, kind, name, difference``.

    ``pos`` orders a path's differences: columns only on the left, only on the right, changed, repeated names, each by
    name. Another column order is reported only when nothing else differs.
    """
    both = match_by_name(left, right, check_metadata).selectExpr(
        "path", "name", "left_defs.text AS l", "right_defs.text AS r", "left_defs.ordinal AS lo", "right_defs.ordinal AS ro"
    )
    kind = """
        CASE WHEN size(r) = 0 THEN 'left_only' WHEN size(l) = 0 THEN 'right_only'
             WHEN l = r THEN NULL WHEN size(l) = 1 AND size(r) = 1 THEN 'changed' ELSE 'duplicate' END"""
    wording = f"""
        CASE WHEN size(r) = 0 THEN format_string("column '%s' only in {LEFT_NAME}", name)
             WHEN size(l) = 0 THEN format_string("column '%s' only in {RIGHT_NAME}", name)
             ELSE format_string("column '%s': {LEFT_NAME} %s vs {RIGHT_NAME} %s",
                                name, array_join(l, ', '), array_join(r, ', ')) END"""
    rank = f"array_position(array({', '.join(repr(k) for k in KINDS)}), kind)"
    found = f"CASE WHEN kind IS NOT NULL THEN struct({rank} AS rank, name, kind, {wording} AS difference) END"
    # With the same names on both sides, the order differs where a name stands at other positions.
    per_path = both.selectExpr("*", f"{kind} AS kind").groupBy("path").agg(
        F.expr(f"array_sort(collect_list({found})) AS found"), F.expr("bool_or(lo <> ro) AS moved")
    )
    order = f"array(struct({len(KINDS)}L AS rank, '' AS name, 'order' AS kind, '{ORDER_DIFFERS}' AS difference))"
    listed = F.expr(f"CASE WHEN size(found) = 0 AND moved THEN {order} ELSE found END")
    return per_path.select("path", F.posexplode(listed).alias("pos", "d")).select(
        "path", "pos", "d.kind", "d.name", "d.difference"
    )


def schema_diff(spark: SparkSession, left: Tree, right: Tree, check_metadata: bool = False) -> DataFrame:
    """``schema_diff_rows`` over the leaves two output trees have in common."""
    l, r = frames(left), frames(right)
    pick = lambda leaves: leaf_rows(spark, {p: df for p, df in leaves.items() if p in l and p in r})
    return schema_diff_rows(pick(l), pick(r), check_metadata)
