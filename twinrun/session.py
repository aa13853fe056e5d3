"""Session settings the library is written for."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE splits hot join keys and sizes the shuffle partitions at run time; broadcast joins happen only below
# Spark's own size threshold, which is left at its default. Batches compared side by side share the cluster evenly.
SETTINGS = {
    "spark.scheduler.mode": "FAIR",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def get_session(app_name: str = "twinrun", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings above; further ones go in as ``**{"spark.key": value}``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str | None:
    """The shared folder for intermediate results by its full address: ``spark.checkpoint.dir`` of the session, else the
    context's own checkpoint folder, None when neither is set. A path without a scheme is in the default file system, as
    for Spark's writers. Whether all machines share that folder is known to who names it, as with ``file:``."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    folder = folder or context.getCheckpointDir()
    return full_address(spark, folder) if folder else None


def full_address(spark: SparkSession, path: str) -> str:
    """A path with the scheme of its file system."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(place).toString()


def computed_once(df: DataFrame, name: str, written: list[str] | None = None) -> DataFrame:
    """Write a result that several branches of a plan read to the shared folder, and go on from there.

    Lost executors then cost no recomputation. Without a shared folder the plan stays as it is. The folder's path is
    added to ``written``; ``remove`` deletes it when nothing reads it any more.
    """
    folder = scratch_dir(df.sparkSession)
    if folder is None:
        return df
    path = f"{folder.rstrip('/')}/twinrun-{name}-{uuid.uuid4()}"
    if written is not None:
        written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate result through the file system it was written to."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
