"""Scalar functions, all of them column expressions."""

from twinrun.functions.redact import is_secret, redact, redact_map
from twinrun.functions.runs import (
    as_date,
    expand,
    norm_dir,
    norm_prefix,
    raw_path,
    run_date,
    run_id,
    snapshot_day,
    snapshot_folder,
)
from twinrun.functions.strings import strip
from twinrun.functions.text import (
    html_to_text,
    output_table,
    page_ref_id,
    page_ref_id_of,
    pipeline_name,
    repo_slug,
)

__all__ = [
    "as_date",
    "expand",
    "html_to_text",
    "is_secret",
    "norm_dir",
    "norm_prefix",
    "output_table",
    "page_ref_id",
    "page_ref_id_of",
    "pipeline_name",
    "raw_path",
    "redact",
    "redact_map",
    "repo_slug",
    "run_date",
    "run_id",
    "snapshot_day",
    "snapshot_folder",
    "strip",
]
