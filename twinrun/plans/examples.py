"""Three ready pairs of pipeline versions over a star schema that must prove equal.

The left version of each pair carries some clutter - constants nobody selects, branches nobody uses, aliases nobody
needs - and the right version does without. Catalyst drops the clutter from the plan; the comparison shows that the
data stays the same. Inputs are dicts of DataFrames (``orders``, ``customer``, ``nation``, ``region``, ``part``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from twinrun.plans.compare import Pipeline
from twinrun.sources.readers import read_named

# Fixed values of the pairs.
SIZES = [7, 14, 28, 42]

Inputs = dict[str, DataFrame]


def from_catalog(*names: str):
    """The ``read`` step of a pipeline whose inputs are catalog tables."""

    def read(spark: SparkSession, run: Row | None) -> Inputs:
        return {name: read_named(spark, name) for name in names}

    return read


def size_counts(part: DataFrame) -> DataFrame:
    """Parts per size, for a fixed list of sizes."""
    return part.filter(F.col("p_size").isin(SIZES)).groupBy("p_size").count()


def status_counts(orders: DataFrame) -> DataFrame:
    """Orders per status, with a name of its own for the count."""
    return orders.groupBy("o_orderstatus").agg(F.count("*").alias("order_count"))


# ---- constants that never reach the output


def constants_left(inputs: Inputs, run: Row | None, currency: str) -> DataFrame:
    """Prices with their currency; a rounding rule and a rate are set up, used for a total, and the total is dropped."""
    orders = inputs["orders"].select("*", F.lit(currency).alias("currency"), F.lit(1.19).alias("rate"))
    priced = orders.withColumn("digits", F.length("currency")).withColumn("gross", F.col("o_totalprice") * F.col("rate"))
    rounded = priced.withColumn("gross", F.round("gross", 2))
    return rounded.select("o_orderkey", "o_orderpriority", "o_totalprice", "currency")


def constants_right(inputs: Inputs, run: Row | None, currency: str) -> DataFrame:
    orders = inputs["orders"].select("o_orderkey", "o_orderpriority", "o_totalprice")
    return orders.withColumn("currency", F.lit(currency))


# ---- branches that lead nowhere, next to a left join


def branches_left(inputs: Inputs, run: Row | None) -> DataFrame:
    unused = size_counts(inputs["part"]), status_counts(inputs["orders"])
    assert all(isinstance(branch, DataFrame) for branch in unused)  # built, never run
    o, c = inputs["orders"], inputs["customer"]
    return o.join(c, o.o_custkey == c.c_custkey, "left").select(o.o_orderkey, c.c_name, o.o_totalprice)


def branches_right(inputs: Inputs, run: Row | None) -> DataFrame:
    customer = inputs["customer"].withColumnRenamed("c_custkey", "o_custkey")
    return inputs["orders"].join(customer, "o_custkey", "left").select("o_orderkey", "c_name", "o_totalprice")


# ---- two left joins, by qualified columns and by a common key name


def aliases_left(inputs: Inputs, run: Row | None) -> DataFrame:
    c, n, r = inputs["customer"].alias("c"), inputs["nation"].alias("n"), inputs["region"].alias("r")
    placed = c.join(n, F.col("c.c_nationkey") == F.col("n.n_nationkey"), "left")
    placed = placed.select(F.col("c.c_name"), F.col("n.n_name"), F.col("n.n_regionkey")).alias("p")
    both = placed.join(r, F.col("p.n_regionkey") == F.col("r.r_regionkey"), "left")
    return both.select(F.col("p.c_name"), F.col("p.n_name"), F.col("r.r_name"))


def aliases_right(inputs: Inputs, run: Row | None) -> DataFrame:
    nation = inputs["nation"].withColumnsRenamed({"n_nationkey": "c_nationkey", "n_regionkey": "r_regionkey"})
    placed = inputs["customer"].join(nation, "c_nationkey", "left").select("c_name", "n_name", "r_regionkey")
    return placed.join(inputs["region"], "r_regionkey", "left").select("c_name", "n_name", "r_name")


def unused_columns(currency: str, read=from_catalog("orders")) -> Pipeline:
    return Pipeline(read, constants_left, constants_right, {"currency": currency})


def dead_branches(read=from_catalog("orders", "customer", "part")) -> Pipeline:
    return Pipeline(read, branches_left, branches_right)


def needless_aliases(read=from_catalog("customer", "nation", "region")) -> Pipeline:
    return Pipeline(read, aliases_left, aliases_right)
