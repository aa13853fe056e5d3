"""What the operators of this subpackage share: tables, bindings inside an expression, keys, stored results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space that separates words and surrounds lines, [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value inside one expression, so that it is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(name: str) -> Column:
    """A text column; NULL reads as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def blank_pieces(text: Column) -> Column:
    """The text split at every single character of BLANKS; literal replacements and a literal split, no regex."""
    spaced = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), BLANKS[1:], text)
    return F.split(spaced, " ")


def row_key(*columns: Column) -> list[Column]:
    """A 128-bit key of a row as two longs; NULLs take part by their place."""
    marked = [x for c in columns for x in (c.isNull(), c)]
    return [F.xxhash64(F.lit(seed), *marked) for seed in (1, 2)]


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir`` of the session; a temporary one only where that is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp()
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a result to the shared folder and go on from the written table, so that lost executors cost no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/llm-{name}-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
