"""Sinks: the report as a table or as text, and one document per pipeline."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from twinrun.plans.report import report_lines, with_run_marks
from twinrun.sources.files import local_folder, read_key_folders, write_key_folders


#: Beside a stored report, under a name that readers of the report pass over: one row with the number of runs.
TOTALS = "_totals"


def write_report(report: DataFrame, path: str, mode: str = "error") -> dict[str, int]:
    """The report table as parquet, and ``total`` and ``passed`` runs, counted by the job that writes it."""
    seen = Observation()
    counts = [F.count_if("counted").alias("total"), F.count_if(F.col("counted") & F.col("run_passed")).alias("passed")]
    with_run_marks(report).observe(seen, *counts).select(*report.columns).write.mode(mode).parquet(path)
    totals = {name: int(n) for name, n in seen.get.items()}
    spark = report.sparkSession
    row = spark.createDataFrame([(totals["total"], totals["passed"])], "total bigint, passed bigint")
    row.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{TOTALS}")
    return totals


def write_report_text(report: DataFrame, path: str, mode: str = "error", totals: DataFrame | None = None) -> None:
    """The text report of a stored report. Its lines are range-sorted, so the part files in name order read from top to
    bottom; a report that is not stored would be computed for each of the readings (see ``report_lines``)."""
    lines = report_lines(report, totals).orderBy("section", F.desc("run_date"), F.desc("run_id"), "path", "pos")
    lines.select("line").write.mode(mode).text(path)


def write_stored_report_text(spark: SparkSession, report_path: str, path: str, mode: str = "error") -> None:
    """The text of what ``write_report`` left at ``report_path``, its totals taken from there."""
    totals = spark.read.parquet(f"{report_path.rstrip('/')}/{TOTALS}")
    write_report_text(spark.read.parquet(report_path), path, mode, totals)


def save_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int, mode: str = "error") -> None:
    """A table of the catalog whose files at ``path`` are dealt by ``key``. Two sides saved with the same key and number of
    buckets are compared without a shuffle of their rows, as often as they are compared."""
    df.repartition(buckets, key).write.mode(mode).option("path", path).bucketBy(buckets, key).format("parquet").saveAsTable(name)


def write_context(parts: DataFrame, path: str, mode: str = "error", parts_per_volume: int | None = None) -> None:
    """Documents as ``pipeline=<name>/`` text folders from ``context_parts`` rows.

    The rows of a document are streamed to its file in order; the file equals the text ``assemble_context`` builds. With
    ``parts_per_volume`` every document, short or long, lies in ``pipeline=<name>/volume=<n>/`` folders of so many parts
    each, which different tasks write. A new folder that is local or mounted is written by the tasks themselves
    (``write_key_folders``), any other by Spark.
    """
    keys = ["pipeline"] if parts_per_volume is None else ["pipeline", "volume"]
    if parts_per_volume is not None:
        parts = parts.withColumn("volume", F.floor(F.col("pos") / parts_per_volume))
    spark = parts.sparkSession
    # A file costs more than its bytes, so a small result is spread as well.
    rows = parts.select(*keys, "pos", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)
    rows = rows.sortWithinPartitions(*keys, "pos").drop("pos")
    folder = local_folder(spark, path)
    if folder is None or os.path.lexists(folder):
        rows.write.mode(mode).partitionBy(*keys).text(path)
    else:
        write_key_folders(rows, folder, keys)


def read_context(spark: SparkSession, path: str) -> DataFrame:
    """``pipeline, document`` of what ``write_context`` wrote without volumes."""
    folder = local_folder(spark, path)
    if folder is None:
        found = spark.read.text(path, wholetext=True)
        return found.select(F.col("pipeline").cast("string").alias("pipeline"), F.col("value").alias("document"))
    return read_key_folders(spark, folder, "pipeline").select("pipeline", F.col("value").cast("string").alias("document"))
