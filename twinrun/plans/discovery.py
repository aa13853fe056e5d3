"""From a storage listing to the runs to compare and the input folder of each."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinrun.functions.runs import (
    DISCOVERY_PREFIX,
    HISTORY_PREFIX,
    as_date,
    raw_path,
    run_date,
    run_date_text,
    run_id,
    snapshot_day,
    snapshot_folder,
)

FOUND, MISSING_SNAPSHOT = "FOUND", "MISSING"

Day = Column | str | date | datetime


def _normal(prefix: str) -> str:
    bare = prefix.strip("/")
    return bare + "/" if bare else ""


def names_below(listing: DataFrame, prefix: str) -> DataFrame:
    """Object names that are not empty and lie strictly below the prefix. Both tests reach the scan of a table."""
    name = F.col("name")
    return listing.select(name).where(
        name.isNotNull() & (name != "") & name.startswith(prefix) & (F.length(name) > len(prefix))
    )


def in_window(day: Column, start: Day | None, end: Day | None) -> Column:
    """Both ends belong to the window; an end that is None is open."""
    keep = F.lit(True)
    if start is not None:
        keep = keep & (day >= as_date(start))
    if end is not None:
        keep = keep & (day <= as_date(end))
    return keep


def runs_from_listing(
    listing: DataFrame,
    prefix: str = DISCOVERY_PREFIX,
    start: Day | None = None,
    end: Day | None = None,
) -> DataFrame:
    """Distinct ``run_id, run_date`` of the objects below a prefix, within a date window.

    Ids without a date, or with one the calendar does not have, are dropped (``dropped_names`` lists them). Repeated
    ids fall together within each task before the shuffle.
    """
    prefix = _normal(prefix)
    names = names_below(listing, prefix).select(run_id("name", prefix).alias("run_id"))
    ids = names.groupBy("run_id").agg(F.count("*").alias("names"))
    # Through the count the date tests stay above the grouping: they look at each id once, not at every object name.
    counted = F.when(F.col("names") > 0, F.col("run_id"))
    dated = ids.withColumn("run_date", run_date(counted))
    keep = F.col("run_date").isNotNull() & in_window(F.col("run_date"), start, end)
    return dated.where(keep).select("run_id", "run_date")


def dropped_names(listing: DataFrame, prefix: str = DISCOVERY_PREFIX) -> DataFrame:
    """What the discovery leaves out, counted by reason: ``reason, names``."""
    prefix = _normal(prefix)
    name = F.col("name")
    rid = run_id("name", prefix)
    reason = (
        F.when(name.isNull() | (name == ""), "empty name")
        .when(~name.startswith(prefix) | (F.length(name) <= len(prefix)), "outside prefix")
        .when(rid.isNull(), "no run id")
        .when(run_date_text(rid).isNull(), "no date")
        .when(run_date(rid).isNull(), "impossible date")
    )
    return (
        listing.select(reason.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("names"))
    )


def newest_runs(runs: DataFrame, max_runs: int | None = None) -> DataFrame:
    """Newest first, by date then id. ``None`` keeps all, 0 keeps none; Spark keeps the top N per task, not a full sort."""
    if max_runs is not None and max_runs < 0:
        raise ValueError("max_runs must not be negative")
    ordered = runs.orderBy(F.desc("run_date"), F.desc("run_id"))
    return ordered if max_runs is None else ordered.limit(max_runs)


def discover_runs(
    listing: DataFrame,
    prefix: str = DISCOVERY_PREFIX,
    max_runs: int | None = None,
    start: Day | None = None,
    end: Day | None = None,
) -> DataFrame:
    """The ``max_runs`` most recent runs of a listing: ``run_id, run_date``, newest first."""
    return newest_runs(runs_from_listing(listing, prefix, start, end), max_runs)


def snapshot_folders(listing: DataFrame, prefix: str = HISTORY_PREFIX) -> DataFrame:
    """Distinct snapshot folders: ``folder, day``."""
    folders = names_below(listing, prefix).select(snapshot_folder("name", prefix).alias("folder"))
    return folders.where("folder is not null").distinct().withColumn("day", snapshot_day("folder"))


def latest_snapshots(listing: DataFrame, prefix: str = HISTORY_PREFIX) -> DataFrame:
    """The last snapshot folder of each day: ``day, folder``. Folder names sort by time, so it is a plain maximum.

    The many files of a folder fall together by hashing first; the maximum is taken over the few folders left.
    """
    return snapshot_folders(listing, prefix).groupBy("day").agg(F.max("folder").alias("folder"))


def resolve_raw_paths(
    runs: DataFrame,
    snapshots: DataFrame,
    mount: str,
    override: str | None = None,
    template: str | None = None,
    strict: bool = False,
) -> DataFrame:
    """``run_id, run_date, raw_path, raw_status``: the input folder of every run.

    An override wins, then a template with ``{run_id}``, then the latest snapshot of the run's day. Without any of them
    the status is MISSING, or the query fails when ``strict``.
    """
    if override or template:
        paths = runs.withColumn("folder", F.lit(None).cast("string"))
    else:
        paths = runs.withColumn("day", F.date_format("run_date", "yyyy-MM-dd")).join(snapshots, "day", "left")
    path = raw_path("run_id", "folder", mount, override, template)
    if strict:
        text = F.format_string("no snapshot folder for run date %s (run %s)", F.col("run_date").cast("string"), "run_id")
        path = F.when(path.isNull(), F.raise_error(text)).otherwise(path)
    status = F.when(F.col("raw_path").isNull(), MISSING_SNAPSHOT).otherwise(FOUND)
    return paths.withColumn("raw_path", path).select("run_id", "run_date", "raw_path", status.alias("raw_status"))
