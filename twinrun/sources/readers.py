"""Sources: named tables, delimited files and saved listings. Folders of files are in ``files``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The column of lines that could not be read.
BAD_LINE = "_bad_line"


def read_named(spark: SparkSession, name: str) -> DataFrame:
    """A table of the catalog."""
    return spark.table(name)


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str,
    delimiter: str = ",",
    header: bool = True,
    keep_bad_lines: bool = False,
    **options: object,
) -> DataFrame:
    """Delimited text files. The schema is given, so no extra pass over the files infers one.

    A line with too few or too many fields, or with a value that is not of its column's type, is an error. With
    ``keep_bad_lines`` it is a row whose last column ``_bad_line`` holds the line; that is NULL for good lines, and all
    columns are read for every plan, so that a line is good or bad whatever columns are used. Further options are those
    of Spark's reader, such as ``escape``.
    """
    reader = spark.read.option("sep", delimiter).option("header", header).options(**options)
    if not keep_bad_lines:
        return reader.schema(schema).option("mode", "FAILFAST").csv(path)
    given = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    marked = T.StructType([*given.fields, T.StructField(BAD_LINE, T.StringType())])
    reader = reader.schema(marked).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD_LINE)
    rows = reader.option("columnPruning", False).csv(path)
    # Spark refuses plans that use this column alone, so it takes no character of another one along.
    other = F.substring(F.coalesce(F.col(f"`{given.names[0]}`").cast("string"), F.lit("")), 1, 0)
    return rows.withColumn(BAD_LINE, F.concat(BAD_LINE, other))


def read_listing(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A saved listing: objects of which only ``name`` is used.

    One JSON object per line, which Spark splits at will; ``multi_line=True`` reads one JSON array per file, each by one
    task.
    """
    return spark.read.schema("name string").option("multiLine", multi_line).json(path)
