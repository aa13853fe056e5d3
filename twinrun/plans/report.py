"""Reading a comparison report: totals, failures, and the lines of its text form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinrun.plans.compare import FAIL, NO_RUNS, PASS

# Layout and wording of the text report.
RULE_WIDTH = 60
SCHEMA_COLUMN_WIDTH = 52
COUNTS_TEXT = "%s: %s | %s"
DETAILS_TEXT = "left_count=%s, right_count=%s, only_in_left=%s, only_in_right=%s"
TOTAL_TEXT = "rows only in legacy: %s, only in refactored: %s, total differing rows: %s"
ROW_COUNTS_LABEL = "row counts (legacy | refactored): "
DIFFERENCES_LABEL = "row difference counts: "
DETAILS_LABEL = "  details: "
SCHEMA_LABEL = "schema match: "
RUNS_TEXT = "run_ids: %d"
PASSED_TEXT = "Passed: %d / %d"
SCHEMA_TABLE_LABEL = "schema (legacy | refactored):"


def run_status(report: DataFrame, key: str = "run_id") -> DataFrame:
    """One row per run: ``passed`` when every leaf passes, else the error of the first failing path."""
    bad = F.when(F.col("status") != PASS, F.struct("path", F.coalesce("error", "status").alias("error")))
    return report.groupBy(key).agg(
        F.max("run_date").alias("run_date"),
        F.min(F.col("status") == PASS).alias("passed"),
        F.min(bad)["error"].alias("error"),
    )


def summarise(report: DataFrame, key: str = "run_id") -> DataFrame:
    """``total, passed, failed, verdict``. A report without runs is no pass."""
    runs = report.where(F.col("status") != NO_RUNS).groupBy(key).agg(F.min(F.col("status") == PASS).alias("passed"))
    totals = runs.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"))
    failed = F.col("total") - F.col("passed")
    verdict = F.when(F.col("total") == 0, NO_RUNS).when(failed == 0, PASS).otherwise(FAIL)
    return totals.select("total", "passed", failed.alias("failed"), verdict.alias("verdict"))


def passed_runs(report: DataFrame, key: str = "run_id") -> DataFrame:
    return run_status(report, key).where("passed").select(key)


def failed_runs(report: DataFrame, key: str = "run_id") -> DataFrame:
    """``run_id, run_date, error`` of every run that did not pass."""
    return run_status(report, key).where(~F.col("passed")).select(key, "run_date", "error")


def count_text(report: DataFrame) -> DataFrame:
    """The report with its counts and differences as text: ``counts``, ``details`` and the one-line ``total``."""
    shown = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("?"))
    details = F.format_string(
        DETAILS_TEXT,
        *[shown(c) for c in ("left_count", "right_count", "only_in_left", "only_in_right")],
    )
    total = F.format_string(
        TOTAL_TEXT,
        *[shown(c) for c in ("only_in_left", "only_in_right", "differing_rows")],
    )
    counts = F.format_string(COUNTS_TEXT, "path", shown("left_count"), shown("right_count"))
    return report.withColumns({"counts": counts, "details": details, "total": total})


def _side_by_side(left: Column, right: Column) -> Column:
    padded = F.when(F.length(left) < SCHEMA_COLUMN_WIDTH, F.rpad(left, SCHEMA_COLUMN_WIDTH, " ")).otherwise(left)
    return F.concat(F.lit("  "), padded, F.lit(" | "), right)


def schema_table(matched: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """Side-by-side schema as text: ``*keys, ordinal, line`` from ``match_by_position`` rows, padded, never cut."""
    line = _side_by_side(F.col("left_field"), F.col("right_field"))
    return matched.select(*keys, "ordinal", line.alias("line"))


def report_blocks(report: DataFrame) -> DataFrame:
    """The text block of every run and leaf, line by line: ``run_date, run_id, path, pos, line``. The columns of both
    sides stand in it next to each other."""
    text = count_text(report)

    def label(name: str, value: Column) -> Column:
        return F.concat(F.rpad(F.lit(name + ":"), 12, " "), F.coalesce(value.cast("string"), F.lit("-")))

    raw = F.col("raw_path") if "raw_path" in report.columns else F.lit(None)
    lines = F.array(
        F.lit("-" * RULE_WIDTH),
        label("run_id", F.col("run_id")),
        label("run_date", F.col("run_date")),
        label("raw_data", raw),
        label("path", F.col("path")),
        label("status", F.col("status")),
        F.concat(F.lit(ROW_COUNTS_LABEL), F.col("counts")),
        F.concat(F.lit(DIFFERENCES_LABEL), F.col("total")),
        F.concat(F.lit(DETAILS_LABEL), F.col("details")),
        F.concat(F.lit(SCHEMA_LABEL), F.coalesce(F.col("schema_match").cast("string"), F.lit("?"))),
    )
    differences = F.coalesce("schema_differences", F.array().cast("array<string>"))
    lines = F.concat(lines, F.transform(differences, lambda d: F.concat(F.lit("    - "), d)))
    table = F.transform("schema_columns", lambda c: _side_by_side(c["left_field"], c["right_field"]))
    table = F.when(F.size("schema_columns") > 0, F.concat(F.array(F.lit(SCHEMA_TABLE_LABEL)), table))
    lines = F.concat(lines, F.coalesce(table, F.array().cast("array<string>")))
    lines = F.concat(lines, F.filter(F.array(F.concat(F.lit("error: "), F.col("error"))), lambda e: e.isNotNull()))
    return text.select("run_date", "run_id", "path", F.posexplode(lines).alias("pos", "line"))


def with_run_marks(report: DataFrame, key: str = "run_id") -> DataFrame:
    """The report with two columns more: ``counted`` in one row of each run, and ``run_passed``. Sums over them are the
    totals, so they can be taken while the rows pass by."""
    run = Window.partitionBy(key)
    first = F.row_number().over(run.orderBy("path")) == 1
    return report.withColumns({
        "counted": first & (F.col("status") != NO_RUNS),
        "run_passed": F.min(F.col("status") == PASS).over(run),
    })


def report_lines(report: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """The whole text report, newest run first: ``section, run_date, run_id, path, pos, line`` (not yet sorted).

    ``totals``: one row ``total, passed``, as ``write_report`` keeps it; the report is then read once. Without it they
    are worked out from the report, which is read twice more.
    """
    totals = summarise(report) if totals is None else totals
    rule = F.lit("=" * RULE_WIDTH)
    head = F.array(F.lit("comparison report"), rule, F.format_string(RUNS_TEXT, "total"), F.lit(""))
    foot = F.array(F.lit(""), rule, F.format_string(PASSED_TEXT, "passed", "total"))

    def framed(section: int, lines: Column) -> DataFrame:
        none = F.lit(None).cast("string")
        rows = totals.select(F.posexplode(lines).alias("pos", "line"))
        return rows.select(
            F.lit(section).alias("section"),
            none.cast("date").alias("run_date"),
            none.alias("run_id"),
            none.alias("path"),
            "pos",
            "line",
        )

    real = report.where(F.col("status") != NO_RUNS)
    blocks = report_blocks(real)
    blocks = blocks.select(F.lit(1).alias("section"), "*")
    return framed(0, head).unionByName(blocks).unionByName(framed(2, foot))
