"""Column expressions over object names, run ids and storage paths."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinrun.functions.strings import blank_to_null, column, first_group

# Layout of the storage listings.
DISCOVERY_PREFIX = "feed/product/"
HISTORY_PREFIX = "history/"
RUN_ID_SEGMENT = "run_id="
RUN_ID_PLACEHOLDER = "{run_id}"
RUN_DATE_PATTERN = r"(?U)\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b"


def run_date_text(run_id: Column | str) -> Column:
    """First ``YYYY-MM-DD`` in a run id as text, NULL when there is none.

    Word boundaries apply: ``x-2024-01-02-y`` has a date, ``run_2024-01-02`` and ``2024-01-02T00`` have none.
    """
    return first_group(run_id, RUN_DATE_PATTERN)


def run_date(run_id: Column | str) -> Column:
    """The run date as DATE. A date the calendar does not have gives NULL; it does not stop the discovery."""
    return F.try_to_date(run_date_text(run_id), "yyyy-MM-dd")


def _first_segment(path: Column) -> Column:
    """First path segment that is not empty; plain string work, no regex."""
    return blank_to_null(F.substring_index(F.ltrim(path, F.lit("/")), "/", 1))


def run_id(name: Column | str, prefix: str = "") -> Column:
    """Run id of an object name below ``prefix``.

    The value of the first ``run_id=`` path segment that has one, else the first path segment that is not empty.
    """
    relative = F.substr(column(name), F.lit(len(prefix) + 1))
    tagged = first_group(relative, rf"(?:^|/){RUN_ID_SEGMENT}([^/]+)")
    return F.coalesce(tagged, _first_segment(relative))


def snapshot_folder(name: Column | str, prefix: str = HISTORY_PREFIX) -> Column:
    """First path segment below the history prefix, NULL for other names."""
    name = column(name)
    relative = F.substr(name, F.lit(len(prefix) + 1))
    return F.when(name.startswith(prefix), _first_segment(relative))


def snapshot_day(folder: Column | str) -> Column:
    """Day part of a snapshot folder: its first ten characters, as text."""
    return F.substr(column(folder), F.lit(1), F.lit(10))


def norm_prefix(prefix: Column | str) -> Column:
    """No leading slash, exactly one trailing slash; an empty prefix stays empty."""
    bare = F.trim(column(prefix), F.lit("/"))
    return F.when(bare == "", F.lit("")).otherwise(F.concat(bare, F.lit("/")))


def norm_dir(path: Column | str) -> Column:
    """Exactly one trailing slash."""
    return F.concat(F.rtrim(column(path), F.lit("/")), F.lit("/"))


def expand(template: Column | str, run: Column | str) -> Column:
    """Put the run id into a path template; ``template`` is a literal when given as text."""
    template = template if isinstance(template, Column) else F.lit(template)
    return F.replace(template, F.lit(RUN_ID_PLACEHOLDER), column(run))


def raw_path(
    run: Column | str,
    snapshot: Column | str,
    mount: str,
    override: str | None = None,
    template: str | None = None,
) -> Column:
    """Input folder of a run: the override, else the filled template, else the latest snapshot of the day."""
    choices = [
        F.lit(override) if override else None,
        expand(template, run) if template else None,
        F.concat(F.lit(mount.rstrip("/") + "/" + HISTORY_PREFIX), column(snapshot)),
    ]
    return norm_dir(F.coalesce(*[blank_to_null(c) for c in choices if c is not None]))


def as_date(value: Column | str | date | datetime) -> Column:
    """A DATE from text ``YYYY-MM-DD``, a date, a timestamp or a column. Bad text is an error."""
    if isinstance(value, Column):
        return value.cast("date")
    if isinstance(value, datetime):
        return F.lit(value.date())
    if isinstance(value, date):
        return F.lit(value)
    return F.lit(datetime.strptime(value, "%Y-%m-%d").date())
