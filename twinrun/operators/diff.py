"""Exact multiset comparison of two DataFrames.

Rows are compared as wholes, by position, duplicates counting. NULL equals NULL, NaN equals NaN and -0.0 equals 0.0:
the rules of grouping, which ``exceptAll`` shares. Both sides are read once: each row is tagged with its side, identical
rows are counted (partly before the shuffle, so a row that makes up much of the data leaves each task as one record),
and the differences follow from the two counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinrun.session import computed_once

COUNTS = ("left_count", "right_count", "only_in_left", "only_in_right")

_TEXT_LIKE = (T.StringType, T.VarcharType, T.CharType)
_NOT_TEXT = (T.BinaryType, T.BooleanType, T.VariantType, T.ArrayType, T.MapType, T.StructType)


class NotComparable(ValueError):
    """The two sides have no common row type: other column counts, or types without a common one."""


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()


# ---------------------------------------------------------------- row values


def _holds_variant(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _holds_variant(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _holds_variant(dtype.valueType)
    if isinstance(dtype, T.StructType):
        return any(_holds_variant(f.dataType) for f in dtype.fields)
    return isinstance(dtype, T.VariantType)


def _groupable(value: Column, dtype: T.DataType) -> Column:
    """VARIANT has no grouping: its JSON text stands for it (object keys sorted; ``1`` and ``1.0`` are one value)."""
    if not _holds_variant(dtype):
        return value
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda x: _groupable(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(value, lambda _, x: _groupable(x, dtype.valueType))
    if isinstance(dtype, T.StructType):
        parts = [_groupable(value[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*parts))
    return F.to_json(value)


def _same_shape(left: T.DataType, right: T.DataType) -> bool:
    """No text meets another type anywhere inside; the remaining widening is left to the set operation."""
    if isinstance(left, T.ArrayType) and isinstance(right, T.ArrayType):
        return _same_shape(left.elementType, right.elementType)
    if isinstance(left, T.MapType) and isinstance(right, T.MapType):
        return _same_shape(left.keyType, right.keyType) and _same_shape(left.valueType, right.valueType)
    if isinstance(left, T.StructType) and isinstance(right, T.StructType):
        pairs = list(zip(left.fields, right.fields))
        return len(left) == len(right) and all(_same_shape(a.dataType, b.dataType) for a, b in pairs)
    return isinstance(left, _TEXT_LIKE) == isinstance(right, _TEXT_LIKE)


def _needs_text(left: T.DataType, right: T.DataType) -> bool:
    """A top-level column that is text on one side only is compared as text, so ``'1'`` equals ``1``.

    (The set operation would cast the text side to the other type, and fail at run time on text that does not parse.)
    """
    if _same_shape(left, right):
        return False
    if isinstance(left, _NOT_TEXT) or isinstance(right, _NOT_TEXT):
        raise NotComparable(f"no common type for {left.simpleString()} and {right.simpleString()}")
    return True


# ---------------------------------------------------------------- row counts per side


def position(df: DataFrame, name: str) -> int:
    """Where a column stands; a name that is not there or stands twice is an error."""
    found = [i for i, other in enumerate(df.columns) if other == name]
    if len(found) != 1:
        raise ValueError(f"column {name!r} must occur once in {df.columns}")
    return found[0]


def _split_columns(df: DataFrame, by: Sequence[str]) -> tuple[list[int], list[int]]:
    positions = [position(df, key) for key in by]
    return positions, [i for i in range(len(df.columns)) if i not in positions]


def _tagged(df: DataFrame, by: Sequence[str], as_text: Sequence[bool], left: bool) -> DataFrame:
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    keys, values = _split_columns(df, by)
    types = [f.dataType for f in df.schema.fields]
    picked: list[Column | str] = [f"c{i} AS by{n}" for n, i in enumerate(keys)]
    for n, i in enumerate(values):
        if _holds_variant(types[i]):
            picked.append(_groupable(F.col(f"c{i}"), types[i]).alias(f"v{n}"))
        else:
            picked.append(f"CAST(c{i} AS STRING) AS v{n}" if as_text[n] else f"c{i} AS v{n}")
    tags = [f"{int(left)}L AS n_left", f"{int(not left)}L AS n_right"]
    if all(isinstance(c, str) for c in picked):
        return flat.selectExpr(*picked, *tags)
    return flat.select(*[F.expr(c) if isinstance(c, str) else c for c in (*picked, *tags)])


def _union(left: DataFrame, right: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Both sides tagged and united by position, and the columns that make up a row."""
    l_types = [left.schema.fields[i].dataType for i in _split_columns(left, by)[1]]
    r_types = [right.schema.fields[i].dataType for i in _split_columns(right, by)[1]]
    if len(l_types) != len(r_types):
        raise NotComparable(f"{len(l_types)} columns against {len(r_types)}")
    as_text = [_needs_text(a, b) for a, b in zip(l_types, r_types)]
    try:  # analysis only: types without a common one are refused here
        both = _tagged(left, by, as_text, True).union(_tagged(right, by, as_text, False))
        return both, [c for c in both.columns if c not in ("n_left", "n_right")]
    except AnalysisException as refused:
        raise NotComparable(str(refused)) from refused


def _tally(left: DataFrame, right: DataFrame, by: Sequence[str], keyed: bool = False) -> DataFrame:
    """Distinct rows as ``by0.., v0..`` with ``n_left`` and ``n_right``. One shuffle of both sides.

    When most rows are unique (``keyed``) counting them before the shuffle finds little to merge, so the rows are
    shuffled first and counted once. Without that knowledge copies are merged first, so a hot row stays harmless. Sides
    that are bucketed alike by some of their columns (``save_bucketed``) are counted where they lie, without a shuffle.
    """
    both, keys = _union(left, right, by)
    try:  # analysis only: types without equality are refused here
        both = both.repartition(*keys) if keyed else both
        return both.groupBy(*keys).agg(F.expr("sum(n_left) AS n_left"), F.expr("sum(n_right) AS n_right"))
    except AnalysisException as refused:
        raise NotComparable(str(refused)) from refused


def _restore_names(df: DataFrame, left: DataFrame, by: Sequence[str], extra: Sequence[str]) -> DataFrame:
    values = _split_columns(left, by)[1]
    return df.toDF(*by, *[left.columns[i] for i in values], *extra)


def tally(left: DataFrame, right: DataFrame, by: Sequence[str] = (), keyed: bool = False) -> DataFrame:
    """Every distinct row with its number of copies on either side (``n_left``, ``n_right``).

    ``by`` columns are matched by name and come first; the others are matched by position and named as on the left.
    ``keyed`` says that rows are mostly unique; the result is the same either way.
    """
    return _restore_names(_tally(left, right, by, keyed), left, by, ("n_left", "n_right"))


def diff_counts(left: DataFrame, right: DataFrame, by: Sequence[str] = (), keyed: bool = False) -> DataFrame:
    """``left_count, right_count, only_in_left, only_in_right`` - one row, or one per group of ``by``.

    The second aggregation is over partial sums, so a group holding most of the data is no bottleneck. ``keyed`` as in
    ``tally``.
    """
    rows = _tally(left, right, by, keyed)
    sums = {
        "left_count": "n_left",
        "right_count": "n_right",
        "only_in_left": "greatest(n_left - n_right, 0L)",
        "only_in_right": "greatest(n_right - n_left, 0L)",
    }
    counts = rows.groupBy(*[f"by{i}" for i in range(len(by))]).agg(
        *[F.expr(f"coalesce(sum({value}), 0L) AS {name}") for name, value in sums.items()]
    )
    return counts.toDF(*by, *COUNTS)


# ---------------------------------------------------------------- proof by hashes

#: Buckets of the first pass, and the bits of the two 64-bit row hashes that are summed as one number each.
HASH_BUCKETS = 4096
_PIECES = ((0, 24), (24, 24), (48, 16))


def _hashable(value: Column, dtype: T.DataType) -> Column:
    """A value whose hash is equal for equal values: a MAP by its sorted entries."""
    if isinstance(dtype, T.MapType):
        entries = F.transform(
            F.map_entries(value),
            lambda e: F.struct(_hashable(e["key"], dtype.keyType).alias("k"), _hashable(e["value"], dtype.valueType).alias("v")),
        )
        return F.array_sort(entries)
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda x: _hashable(x, dtype.elementType))
    if isinstance(dtype, T.StructType):
        parts = [_hashable(value[f.name], f.dataType).alias(f"f{i}") for i, f in enumerate(dtype.fields)]
        return F.when(value.isNotNull(), F.struct(*parts))
    return value


def _collated(dtype: T.DataType) -> bool:
    """Text that is equal by a collation, which hashes do not know of."""
    if isinstance(dtype, T.ArrayType):
        return _collated(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _collated(dtype.keyType) or _collated(dtype.valueType)
    if isinstance(dtype, T.StructType):
        return any(_collated(f.dataType) for f in dtype.fields)
    return isinstance(dtype, T.StringType) and not dtype.isUTF8BinaryCollation()


def diff_counts_by_hash(left: DataFrame, right: DataFrame, by: Sequence[str] = (), buckets: int = HASH_BUCKETS) -> DataFrame:
    """``diff_counts`` for large sides that are equal for the most part: equality of a bucket is proved by hashes.

    The first pass, run at once, deals rows to buckets by their hash and sums 128 bits of hash over each bucket and side;
    a task sends one row for each bucket and group, no matter how long rows are. Where sums and counts are equal, rows are
    taken as equal. The rows of the other buckets are compared exactly, in a second pass that reads the rows of those
    alone into the shuffle. Two different multisets pass as equal with a chance of about 2**-128, unless somebody makes
    rows for that purpose; ``diff_counts`` is exact, and is what collated text gets. NULL, NaN, zeros, MAP and VARIANT are
    treated as there.
    """
    both, _ = _union(left, right, by)
    if _collated(both.schema):
        return diff_counts(left, right, by)
    groups = [f"by{i}" for i in range(len(by))]
    rows = [f for f in both.schema.fields if f.name not in ("n_left", "n_right")]
    values = [part for f in rows for part in (F.col(f.name).isNull(), _hashable(F.col(f.name), f.dataType))]
    # Of two seeds; the bucket is a hash of its own, or else the rows of a bucket would share bits of the sums.
    hashed = both.withColumns({f"h{n}": F.xxhash64(F.lit(n), *values) for n in range(2)})
    hashed = hashed.withColumn("bucket", F.pmod(F.hash("h0", "h1"), F.lit(buckets)))
    sums = [
        F.sum(F.shiftrightunsigned(f"h{n}", start).bitwiseAND((1 << bits) - 1) * (F.col("n_left") - F.col("n_right"))).alias(f"s{n}_{start}")
        for n in range(2)
        for start, bits in _PIECES
    ]
    proof = hashed.groupBy(*groups, "bucket").agg(F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right"), *sums)
    proof = computed_once(proof, "proof")
    equal = reduce(Column.__and__, [F.col(f"s{n}_{start}") == 0 for n in range(2) for start, _ in _PIECES])
    open_buckets = [r.bucket for r in proof.where(~(equal & (F.col("n_left") == F.col("n_right")))).select("bucket").distinct().collect()]

    named = [F.col(g) for g in groups]
    totals = proof.select(*named, "n_left", "n_right", F.lit(0).cast("bigint").alias("l"), F.lit(0).cast("bigint").alias("r"))
    if open_buckets:
        differ = hashed.where(F.col("bucket").isin(open_buckets)).groupBy(*[f.name for f in rows])
        tallied = differ.agg(F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right"))
        none = F.lit(0).cast("bigint")
        more = [F.greatest(F.col(a) - F.col(b), none) for a, b in (("n_left", "n_right"), ("n_right", "n_left"))]
        totals = totals.union(tallied.select(*named, none, none, *more))
    columns = ("n_left", "n_right", "l", "r")
    counts = totals.groupBy(*groups).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(n) for c, n in zip(columns, COUNTS)])
    return counts.toDF(*by, *COUNTS)


def side_counts(left: DataFrame, right: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The two row counts alone, for sides whose rows cannot be compared; the differences are NULL."""
    keys = [quoted(k) for k in by]
    both = left.selectExpr(*keys, "1L AS n_left", "0L AS n_right").union(
        right.selectExpr(*keys, "0L AS n_left", "1L AS n_right")
    )
    return both.groupBy(*keys).agg(
        F.expr("coalesce(sum(n_left), 0L) AS left_count"),
        F.expr("coalesce(sum(n_right), 0L) AS right_count"),
        F.expr("CAST(NULL AS BIGINT) AS only_in_left"),
        F.expr("CAST(NULL AS BIGINT) AS only_in_right"),
    )


def row_counts(leaves: dict[str, DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """Row count of every leaf of an output tree, in one job: ``path, *by, rows``. An empty leaf counts 0 (without ``by``)."""
    parts = []
    for path, df in leaves.items():
        counted = df.groupBy(*[F.col(quoted(k)) for k in by]).agg(F.count(F.lit(1)).alias("rows"))
        parts.append(counted.select(F.lit(path).alias("path"), *[quoted(k) for k in by], "rows"))
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------- the rows themselves


def except_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` beyond their number in ``right``, with duplicates: ``exceptAll`` that also takes MAP and VARIANT.

    Without such columns it is ``exceptAll`` itself. Otherwise every surplus copy is spelled out from ``tally`` in
    bounded steps; VARIANT values come back as their JSON text.
    """

    def plain(dtype: T.DataType) -> bool:
        if isinstance(dtype, T.ArrayType):
            return plain(dtype.elementType)
        if isinstance(dtype, T.StructType):
            return all(plain(f.dataType) for f in dtype.fields)
        return not isinstance(dtype, (T.MapType, T.VariantType))

    if plain(left.schema) and plain(right.schema):
        return left.exceptAll(right)
    surplus = _tally(left, right, ()).withColumn("copies", F.col("n_left") - F.col("n_right")).where("copies > 0")
    values = [c for c in surplus.columns if c.startswith("v")]
    return _restore_names(_repeat(surplus, values), left, (), ())


def _repeat(rows: DataFrame, keep: Sequence[str], step: int = 10_000) -> DataFrame:
    """Each row ``copies`` times. The copies are generated block by block, so no array holds more than ``step`` items."""
    rows = rows.select(*keep, "copies")
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for turn in range(3):  # step ** 4 copies of one row are within reach
        blocks = F.least(F.lit(step).cast("bigint"), F.col("copies"))
        part = F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("block")
        rows = rows.select(*keep, "copies", blocks.alias("blocks"), part)
        one_more = F.when(F.col("block") < F.col("copies") % F.col("blocks"), 1).otherwise(0)
        rows = rows.select(*keep, (F.expr("copies div blocks") + one_more).alias("copies"))
        if turn == 0:  # the blocks of one row go to different tasks
            rows = rows.repartition(spread)
    last = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy")
    return rows.select(*keep, last).select(*keep)


def differing_rows(left: DataFrame, right: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every distinct row whose copies differ: ``side`` ('left' or 'right'), the row, and the surplus ``copies``."""
    rows = _tally(left, right, by).where("n_left <> n_right")
    keep = [c for c in rows.columns if c not in ("n_left", "n_right")]
    rows = rows.select(
        *keep,
        F.when(F.col("n_left") > F.col("n_right"), "left").otherwise("right").alias("side"),
        F.abs(F.col("n_left") - F.col("n_right")).alias("copies"),
    )
    return _restore_names(rows, left, by, ("side", "copies"))


def diff_sample(left: DataFrame, right: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` rows (ordered by all columns) that ``left`` has beyond ``right``; swap the sides for the others.

    At most ``n`` copies of a row matter to the sample, so a row with many surplus copies is not spelled out in full.
    """
    rows = _tally(left, right, ()).where("n_left > n_right")
    values = [c for c in rows.columns if c.startswith("v")]
    wanted = F.least(F.col("n_left") - F.col("n_right"), F.lit(n).cast("bigint"))
    copies = rows.select(*values, F.explode(F.sequence(F.lit(1).cast("bigint"), wanted)).alias("copy"))
    top = copies.orderBy(*[_orderable(c, f.dataType) for c, f in zip(values, rows.schema.fields)]).limit(n)
    return _restore_names(top.select(*values), left, (), ())


def _orderable(name: str, dtype: T.DataType) -> Column:
    """A MAP has no order; its sorted entries stand for it (JSON text when the map is nested)."""
    if isinstance(dtype, T.MapType) and not isinstance(dtype.valueType, (T.MapType, T.ArrayType, T.StructType)):
        return F.array_sort(F.map_entries(name))
    if "map<" in dtype.simpleString():
        return F.to_json(F.struct(name))
    return F.col(name)


def sample_by_group(left: DataFrame, right: DataFrame, by: Sequence[str] = (), n: int = 20) -> DataFrame:
    """Up to ``n`` differing rows for each group of ``by`` and side, each as JSON: ``*by, side, row, copies``.

    The rank filter is pushed below the shuffle by Spark, so each task sends on at most ``n`` rows per group and side.
    """
    rows = differing_rows(left, right, by)
    groups, values = [f"by{i}" for i in range(len(by))], [f"v{i}" for i in range(len(rows.columns) - len(by) - 2)]
    names = rows.columns[len(by) : -2]
    flat = rows.toDF(*groups, *values, "side", "copies")  # names of the data come back at the very end
    shown = [F.col(v).alias(name) for v, name in zip(values, names)]
    text = F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}) if shown else F.lit("{}")
    flat = flat.select(*groups, "side", text.alias("row"), "copies")
    rank = F.row_number().over(Window.partitionBy(*groups, "side").orderBy("row"))
    top = flat.withColumn("rank", rank).where(F.col("rank") <= n).drop("rank")
    return top.toDF(*by, "side", "row", "copies")
