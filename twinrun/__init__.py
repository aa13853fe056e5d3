"""Prove on Spark that two versions of a batch pipeline produce the same data."""

from twinrun.operators.diff import diff_counts, diff_counts_by_hash, diff_sample, differing_rows, except_all, tally
from twinrun.operators.schema import schema_diff, schema_rows
from twinrun.plans.compare import (
    Pipeline,
    assert_equal,
    assert_trees_equal,
    compare_each_run,
    compare_outputs,
    compare_run,
    compare_runs,
    read_report,
)
from twinrun.plans.discovery import discover_runs, latest_snapshots, resolve_raw_paths
from twinrun.plans.report import failed_runs, passed_runs, summarise
from twinrun.session import get_session

__all__ = [
    "Pipeline",
    "assert_equal",
    "assert_trees_equal",
    "compare_each_run",
    "compare_outputs",
    "compare_run",
    "compare_runs",
    "diff_counts",
    "diff_counts_by_hash",
    "diff_sample",
    "differing_rows",
    "discover_runs",
    "except_all",
    "failed_runs",
    "get_session",
    "latest_snapshots",
    "passed_runs",
    "read_report",
    "resolve_raw_paths",
    "schema_diff",
    "schema_rows",
    "summarise",
    "tally",
]
