"""Comparison of the outputs of two pipeline versions, for one run or for many at once."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce
from itertools import islice
from queue import SimpleQueue
from threading import Event, Timer
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinrun.functions.runs import run_date
from twinrun.operators.diff import NotComparable, diff_counts, diff_sample, position, quoted, side_counts
from twinrun.operators.schema import leaf_rows, same_schema, schema_diff, schema_diff_rows, side_by_side
from twinrun.operators.tree import MISSING_LEAF, Pair, Tree, pair_leaves
from twinrun.session import computed_once, remove
from twinrun.sources.readers import BAD_LINE

PASS, FAIL, ERROR, MISSING, NO_RUNS = "PASS", "FAIL", "ERROR", "MISSING_LEAF", "NO_RUNS"

# Columns of a report, after the run columns.
REPORT = (
    ("path", "string"),
    ("status", "string"),
    ("left_count", "bigint"),
    ("right_count", "bigint"),
    ("only_in_left", "bigint"),
    ("only_in_right", "bigint"),
    ("differing_rows", "bigint"),
    ("schema_match", "boolean"),
    ("comparable", "boolean"),
    ("schema_differences", "array<string>"),
    ("error", "string"),
    ("schema_columns", "array<struct<left_field:string,right_field:string>>"),
)
_RUN = "__run"
OUT_OF_TIME = "not compared: out of time"
BAD_LINES_TEXT = "%s: %d lines cannot be read, such as: %s"
BAD_LINE_SHOWN = 200
_COUNTS = ("left_count", "right_count", "only_in_left", "only_in_right")


@dataclass(frozen=True)
class Pipeline:
    """Two versions of one step. ``read`` gives the inputs once; both versions get the same ones.

    ``read(spark, run)`` returns a dict of DataFrames, ``left(inputs, run, **options)`` and
    ``right(inputs, run, **options)`` an output tree. ``run`` is a Row with ``run_id``, ``run_date`` and ``raw_path``,
    or None when all runs are compared in one plan and the data carries its run id. With ``fixed_inputs`` the inputs are
    written once to the session's shared folder, so that both versions see the same rows even where reading them is not
    deterministic; without such a folder each version reads for itself.

    An input with a column ``_bad_line`` (``read_delimited(..., keep_bad_lines=True)``) is given without the rows where
    it is set and without the column; ``compare_each_run`` reports these rows as an error of the run.
    """

    read: Callable[[SparkSession, Row | None], dict[str, DataFrame]]
    left: Callable[..., Tree]
    right: Callable[..., Tree]
    options: dict[str, Any] = field(default_factory=dict)
    fixed_inputs: bool = False

    def outputs(
        self,
        spark: SparkSession,
        run: Row | None = None,
        written: list[str] | None = None,
        bad_lines: dict[str, DataFrame] | None = None,
    ) -> tuple[Tree, Tree]:
        """Both output trees; the folders of fixed inputs are added to ``written``, for whoever removes them, and the
        bad lines of inputs that may have some to ``bad_lines``. Without that, inputs with bad lines are refused."""
        inputs = self.read(spark, run)
        if self.fixed_inputs:
            inputs = {name: computed_once(df, name, written) for name, df in inputs.items()}
        marked = [name for name, df in inputs.items() if isinstance(df, DataFrame) and BAD_LINE in df.columns]
        if marked and bad_lines is None:
            raise ValueError(f"nobody asks for the bad lines of {marked}")
        for name in marked:
            bad_lines[name] = inputs[name].where(F.col(BAD_LINE).isNotNull())
            inputs[name] = inputs[name].where(F.col(BAD_LINE).isNull()).drop(BAD_LINE)
        return self.left(inputs, run, **self.options), self.right(inputs, run, **self.options)


# ---------------------------------------------------------------- one leaf


# Why a leaf fails, the first reason that applies; put after the path.
_REASON = """
CASE WHEN NOT schema_match THEN concat('schema differs: ', array_join(schema_differences, '; '))
     WHEN only_in_left IS NULL THEN 'the rows are of a type that cannot be compared'
     WHEN left_count <> right_count THEN format_string('row count differs: left=%d, right=%d', left_count, right_count)
     ELSE format_string('rows differ: %d only in left, %d only in right (duplicates count)', only_in_left, only_in_right)
END"""
_CLEAN = "coalesce(schema_match AND only_in_left = 0 AND only_in_right = 0, false)"


def _schema_differences(spark: SparkSession, pairs: Sequence[Pair], check_metadata: bool) -> dict[str, list[str]]:
    """The wording of the differences by path, of all leaves in one go; touches schemas only, no data."""
    frames = [p for p in pairs if isinstance(p.left, DataFrame) and isinstance(p.right, DataFrame)]
    bad = [p for p in frames if not same_schema(p.left.schema, p.right.schema, check_metadata)]
    out: dict[str, list[str]] = {p.path: [] for p in bad}
    if bad:
        left, right = (leaf_rows(spark, {p.path: getattr(p, side) for p in bad}) for side in ("left", "right"))
        for row in schema_diff_rows(left, right, check_metadata).orderBy("path", "pos").collect():
            out[row.path].append(row.difference)
    return out


def _same_types(left: DataFrame, right: DataFrame, by: Sequence[str]) -> bool:
    """Rows can be compared as they are, without a cast of any column."""

    def types(df: DataFrame) -> list[str]:
        return [f.dataType.simpleString() for f in df.schema.fields if f.name not in by]

    return types(left) == types(right)


def _compared(
    pair: Pair, by: Sequence[str], runs: DataFrame | None, differences: dict[str, list[str]], keyed: bool
) -> DataFrame:
    """Counts and verdict on two DataFrames at one path."""
    path, left, right = pair
    match, comparable = path not in differences, _same_types(left, right, by)
    try:
        counts, known = diff_counts(left, right, by, keyed), _COUNTS
    except NotComparable:
        counts, known = side_counts(left, right, by), _COUNTS[:2]
    if runs is not None:  # a run without rows on either side counts zero
        counts = runs.join(counts, list(by), "left").fillna(0, list(known))
    facts = counts.select(
        "*",
        F.lit(path).alias("path"),
        F.lit(match).alias("schema_match"),
        F.lit(comparable).alias("comparable"),
        F.lit(differences.get(path, [])).cast("array<string>").alias("schema_differences"),
    )
    status = f"CASE WHEN {_CLEAN} THEN '{PASS}' ELSE '{FAIL}' END AS status"
    error = f"CASE WHEN NOT ({_CLEAN}) THEN concat('Mismatch at ', path, ': ', {_REASON}) END AS error"
    return facts.selectExpr("*", status, error).withColumn("schema_columns", _columns(left.schema, right.schema))


def _columns(left: T.StructType | None, right: T.StructType | None) -> Column:
    """The columns of both sides as they stand in the report: one constant for each leaf."""
    both = [{"left_field": l, "right_field": r} for l, r in side_by_side(left, right)]
    return F.from_json(F.lit(json.dumps(both)), "array<struct<left_field:string,right_field:string>>")


def _one_sided(path: str, frame: DataFrame, left: bool, by: Sequence[str], runs: DataFrame | None) -> DataFrame:
    """A leaf only one version has: its rows are counted, the other side's count stays NULL."""
    side = "left_count" if left else "right_count"
    counts = frame.groupBy(*[quoted(k) for k in by]).agg(F.count(F.lit(1)).alias(side))
    if runs is not None:
        counts = runs.join(counts, list(by), "left").fillna(0, [side])
    return counts.withColumns(
        {
            "path": F.lit(path),
            "status": F.lit(MISSING),
            "error": F.lit(f"Mismatch at {path}: only in {'left' if left else 'right'}"),
            "schema_columns": _columns(frame.schema if left else None, None if left else frame.schema),
        }
    )


def _plain(spark: SparkSession, pair: Pair, runs: DataFrame | None) -> DataFrame:
    """Leaves that are plain values on both sides, or absent from one. They hold for every run."""
    if pair.left is MISSING_LEAF or pair.right is MISSING_LEAF:
        status, error = MISSING, f"Mismatch at {pair.path}: left={pair.left!r}, right={pair.right!r}"
    else:
        try:
            same = pair.left == pair.right
            status = PASS if (same if isinstance(same, bool) else bool(np.all(same))) else FAIL
            error = None if status == PASS else f"Mismatch at {pair.path}: value left={pair.left!r}, right={pair.right!r}"
        except Exception as problem:  # noqa: BLE001 - values of other libraries compare as they like; other leaves go on
            status, error = ERROR, f"Mismatch at {pair.path}: {type(problem).__name__}: {problem}"
    rows = spark.range(1, numPartitions=1).drop("id") if runs is None else runs
    return rows.withColumns({"path": F.lit(pair.path), "status": F.lit(status), "error": F.lit(error)})


def _leaf_error(
    spark: SparkSession, path: str, error: Exception, by: Sequence[str], runs: DataFrame | None
) -> DataFrame:
    """The row (one for each run asked for) of a leaf that cannot be compared at all; other leaves go on."""
    rows = spark.range(1, numPartitions=1).drop("id") if runs is None else runs
    text = f"Mismatch at {path}: {type(error).__name__}: {error}"
    rows = rows.withColumns({"path": F.lit(path), "status": F.lit(ERROR), "error": F.lit(text)})
    return _report_shape(rows, by if runs is None else runs.columns)


def _report_shape(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The report columns, after the run columns; what a row does not have is NULL."""
    there = set(rows.columns)
    runs = [quoted(k) if k in there else f"CAST(NULL AS STRING) AS {quoted(k)}" for k in keys]
    values = {name: name if name in there else "NULL" for name, _ in REPORT}
    if "only_in_left" in there:
        values["differing_rows"] = "only_in_left + only_in_right"
    return rows.selectExpr(*runs, *[f"CAST({values[name]} AS {kind}) AS {name}" for name, kind in REPORT])


def _pair_report(
    spark: SparkSession,
    pair: Pair,
    by: Sequence[str],
    runs: DataFrame | None,
    differences: dict[str, list[str]],
    keyed: bool = False,
) -> DataFrame:
    l_frame, r_frame = isinstance(pair.left, DataFrame), isinstance(pair.right, DataFrame)
    if l_frame and r_frame:
        rows = _compared(pair, by, runs, differences, keyed)
    elif l_frame or r_frame:
        rows = _one_sided(pair.path, pair.left if l_frame else pair.right, l_frame, by, runs)
    else:
        rows = _plain(spark, pair, runs)
    return _report_shape(rows, by if runs is None else runs.columns)


# ---------------------------------------------------------------- whole outputs


def compare_outputs(
    spark: SparkSession, left: Tree, right: Tree, check_metadata: bool = False, keyed: bool = False
) -> DataFrame:
    """One report row per leaf of two output trees, in a single job. ``keyed``: rows are mostly unique (see ``tally``)."""
    pairs = pair_leaves(left, right)
    differences = _schema_differences(spark, pairs, check_metadata)
    return reduce(DataFrame.unionByName, [_pair_report(spark, p, (), None, differences, keyed) for p in pairs])


def compare_run(
    spark: SparkSession,
    run_id: str,
    left: Tree,
    right: Tree,
    raw_path: str | None = None,
    check_metadata: bool = False,
) -> DataFrame:
    """The report of one run: ``run_id, run_date, raw_path`` and one row per leaf."""
    return compare_outputs(spark, left, right, check_metadata).select(
        F.lit(run_id).alias("run_id"),
        run_date(F.lit(run_id)).alias("run_date"),
        F.lit(raw_path).cast("string").alias("raw_path"),
        *[name for name, _ in REPORT],
    )


def compare_runs(
    spark: SparkSession,
    left: Tree,
    right: Tree,
    runs: DataFrame | None = None,
    by: str = "run_id",
    check_metadata: bool = False,
    keyed: bool = False,
) -> DataFrame:
    """All runs of two outputs whose rows carry their run id, in a single job: one row per run and leaf.

    The run id is part of the grouping key next to the row itself, so the rows of a run that holds most of the data are
    spread over all tasks. With ``runs`` (a DataFrame with the ``by`` column once per run, and whatever else is to show
    up in the report, such as ``run_date`` and ``raw_path``) exactly those are reported, a run without rows on either
    side as equal ones; other runs are dropped before any shuffle. For several leaves the list is worked out once, where
    the session names a shared folder. A leaf whose rows do not name their run gets ERROR rows; the other leaves are compared.
    """
    clash = {name for name, _ in REPORT} & set(runs.columns if runs is not None else [by])
    if clash:
        raise ValueError(f"the report has columns of its own named {sorted(clash)}")

    leaves = pair_leaves(left, right)
    if runs is not None and len(leaves) > 1:
        runs = computed_once(runs, "runs")

    def asked(leaf: Any) -> Any:
        if runs is None or not isinstance(leaf, DataFrame):
            return leaf
        flat, at = leaf.toDF(*[f"c{i}" for i in range(len(leaf.columns))]), f"c{position(leaf, by)}"
        kept = flat.join(runs.select(F.col(quoted(by)).alias(at)), at, "left_semi").select(*flat.columns)
        return kept.toDF(*leaf.columns)

    pairs, broken = [], {}
    for pair in leaves:
        try:
            for leaf in (pair.left, pair.right):
                if isinstance(leaf, DataFrame):
                    position(leaf, by)
            pairs.append(Pair(pair.path, asked(pair.left), asked(pair.right)))
        except ValueError as problem:
            broken[pair.path] = problem
    differences = _schema_differences(spark, pairs, check_metadata)
    parts = [_pair_report(spark, p, (by,), runs, differences, keyed) for p in pairs]
    parts += [_leaf_error(spark, path, problem, (by,), runs) for path, problem in broken.items()]
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------- strict assertions


def assert_equal(left: DataFrame, right: DataFrame, diff_rows: int = 20, check_metadata: bool = False) -> None:
    """Raise AssertionError unless schema and rows are the same. The message samples up to ``diff_rows`` rows a side."""
    if not same_schema(left.schema, right.schema, check_metadata):
        found = schema_diff(left.sparkSession, left, right, check_metadata).orderBy("pos").collect()
        raise AssertionError("schema differs: " + "; ".join(r.difference for r in found))
    n = diff_counts(left, right).first()
    if n.only_in_left or n.only_in_right:
        lines = [
            f"left has {n.left_count} rows, right {n.right_count}; "
            f"only in left: {n.only_in_left}, only in right: {n.only_in_right}"
        ]
        for side, a, b in (("left", left, right), ("right", right, left)):
            rows = [r.asDict(recursive=True) for r in diff_sample(a, b, diff_rows).collect()]
            lines.append(f"only in {side} (up to {diff_rows} rows): {rows}")
        raise AssertionError("\n".join(lines))


def assert_trees_equal(left: Tree, right: Tree, diff_rows: int = 20, check_metadata: bool = False) -> None:
    """``assert_equal`` over two output trees. All leaves are compared in one job; the first bad path is sampled."""
    pairs = {p.path: p for p in pair_leaves(left, right)}
    if not pairs:
        return
    order = F.array_position(F.array(*[F.lit(p) for p in pairs]), F.col("path"))
    spark = SparkSession.active()
    worst = compare_outputs(spark, left, right, check_metadata).where(F.col("status") != PASS).orderBy(order).first()
    if worst is None:
        return
    pair = pairs[worst.path]
    if worst.status == FAIL and isinstance(pair.left, DataFrame):
        try:
            assert_equal(pair.left, pair.right, diff_rows, check_metadata)
        except AssertionError as found:
            raise AssertionError(f"Mismatch at {worst.path}: {found}") from found
    raise AssertionError(worst.error)


# ---------------------------------------------------------------- one plan per run


@contextmanager
def deadline(spark: SparkSession, minutes: float | None) -> Iterator[Event]:
    """Cancel the Spark jobs started inside after some minutes; the event tells whether that happened."""
    expired, context = Event(), spark.sparkContext
    if not minutes:
        yield expired
        return
    tag = f"twinrun-{uuid.uuid4()}"

    def stop() -> None:
        expired.set()
        context.cancelJobsWithTag(tag)

    timer = Timer(minutes * 60, stop)
    timer.daemon = True
    context.addJobTag(tag)
    timer.start()
    try:
        yield expired
    finally:
        timer.cancel()
        context.removeJobTag(tag)


def compare_each_run(
    spark: SparkSession,
    pipeline: Pipeline,
    runs: DataFrame,
    report_path: str,
    batch_size: int = 50,
    fail_fast: bool = False,
    timeout_minutes: float | None = None,
    check_metadata: bool = False,
    keyed: bool = False,
    resume: bool = False,
    parallel: int = 1,
) -> DataFrame:
    """For pipelines whose data does not carry a run id: a plan per run, ``batch_size`` runs to a job.

    Equal leaves of a batch share one grouped comparison. The report at ``report_path`` (which must not exist yet, unless
    ``resume`` asks for the runs that have no rows there) has one partition for each run, and a batch replaces those of
    its runs: written twice, each row is there once. Every run gets at least one row. A run whose plan cannot be built
    gets an ERROR row at once; a job that fails is split, with the plans it has, until the run at fault is alone. Inputs
    that were fixed are removed when their batch is done.

    ``parallel`` batches are under way at a time, each in a thread and a scheduler pool of its own (pools share the
    cluster evenly where ``spark.scheduler.mode`` is FAIR, as in ``get_session``); the pipeline's functions have to bear
    being called from several threads then. Only so many runs are on the driver at a time.

    With ``timeout_minutes`` running jobs are then cancelled, and the runs not compared get ERROR rows that say so.
    ``fail_fast`` raises after the first batch with a run that does not pass, once its rows and those of batches that
    were under way are written; so does an empty list of runs, which proves nothing.
    """
    there = _is_table(spark, report_path)
    if there and not resume:
        raise ValueError(f"there is a report at {report_path} already")
    asked = runs.select("run_id", "run_date", "raw_path")
    if there:
        done = read_report(spark, report_path).where(F.col("status") != NO_RUNS).select("run_id").distinct()
        asked = asked.join(done, "run_id", "left_anti")
    listed, seen = asked.toLocalIterator(), there

    def compare(batch: Sequence[Row], expired: Event) -> Row | None:
        if expired.is_set():
            _commit(_error_rows(spark, batch, ERROR, OUT_OF_TIME), report_path)
        else:
            _compare_batch(spark, pipeline, batch, report_path, (check_metadata, keyed), expired)
        if not fail_fast:
            return None
        report = read_report(spark, report_path).where(F.col("run_id").isin([r.run_id for r in batch]))
        return report.where(F.col("status") != PASS).orderBy("run_id", "path").first()

    with deadline(spark, timeout_minutes) as expired:
        for bad in _side_by_side(spark, compare, iter(lambda: list(islice(listed, batch_size)), []), parallel, expired):
            seen = True
            if bad is not None:
                raise AssertionError(f"{bad.run_id}: {bad.error}")
    if not seen:
        _commit(_error_rows(spark, [Row(run_id=None, run_date=None, raw_path=None)], NO_RUNS, "no runs to compare"), report_path)
        if fail_fast:
            raise AssertionError("no runs to compare")
    return read_report(spark, report_path)


def _side_by_side(
    spark: SparkSession,
    work: Callable[[Sequence[Row], Event], Row | None],
    batches: Iterator[Sequence[Row]],
    parallel: int,
    expired: Event,
) -> Iterator[Row | None]:
    """What ``work`` returns for each batch, ``parallel`` of them at a time; batches are drawn as threads become free.

    Threads carry the tags and properties of this one, so a deadline reaches their jobs. When the caller stops or work
    raises, batches under way are finished, and no others are begun.
    """
    if parallel <= 1:
        for batch in batches:
            yield work(batch, expired)
        return
    context = spark.sparkContext
    free: SimpleQueue[int] = SimpleQueue()
    for lane in range(parallel):
        free.put(lane)

    def in_pool(batch: Sequence[Row]) -> Row | None:
        lane = free.get()
        try:
            context.setLocalProperty("spark.scheduler.pool", f"twinrun-{lane}")
            return work(batch, expired)
        finally:
            free.put(lane)

    def begun(n: int) -> set[Future]:
        # Wrapped anew for each batch: the copy of the properties is the thread's own, so its pool is too.
        return {threads.submit(inheritable_thread_target(spark)(in_pool), batch) for batch in islice(batches, n)}

    with ThreadPoolExecutor(parallel) as threads:
        waiting = begun(parallel)
        while waiting:
            done, waiting = wait(waiting, return_when=FIRST_COMPLETED)
            for future in done:
                yield future.result()
            waiting |= begun(len(done))


# A report in files has one more column, by which it is partitioned; it is text for every run id, also for none.
_PARTITION = "run"
_STORED = "run_id string, run_date date, raw_path string, " + ", ".join(f"{n} {k}" for n, k in REPORT)


def _commit(rows: DataFrame, report_path: str) -> None:
    """Write report rows in place of all that is stored of their runs; other runs stay as they are.

    The rows of a run must come in one commit. A commit that is repeated, because its outcome was lost, changes nothing.
    """
    keyed = rows.withColumn(_PARTITION, F.concat(F.lit("run-"), F.coalesce("run_id", F.lit(""))))
    writer = keyed.repartition(_PARTITION).write.partitionBy(_PARTITION).mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").parquet(report_path)


def read_report(spark: SparkSession, report_path: str) -> DataFrame:
    """The report that ``compare_each_run`` leaves."""
    return spark.read.schema(_STORED).parquet(report_path).drop(_PARTITION)


def _is_table(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True


def _run_rows(spark: SparkSession, batch: Sequence[Row]) -> DataFrame:
    rows = [r.asDict() for r in batch]
    kinds = pa.schema([("run_id", pa.string()), ("run_date", pa.date32()), ("raw_path", pa.string())])
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=kinds))


def _error_rows(spark: SparkSession, batch: Sequence[Row], status: str, error: str) -> DataFrame:
    rows = _run_rows(spark, batch).withColumns({"path": F.lit("$"), "status": F.lit(status), "error": F.lit(error)})
    return _report_shape(rows, ("run_id", "run_date", "raw_path"))


def _reason(problem: Exception) -> str:
    return f"{type(problem).__name__}: {problem}".split("\n\nJVM stacktrace")[0]


# A run, its leaves, and the bad lines of its inputs.
Planned = tuple[Row, list[Pair], dict[str, DataFrame]]


def _compare_batch(
    spark: SparkSession,
    pipeline: Pipeline,
    batch: Sequence[Row],
    report_path: str,
    settings: tuple[bool, bool],
    expired: Event,
) -> None:
    planned: list[Planned] = []
    written: list[str] = []
    try:
        for run in batch:
            try:
                bad: dict[str, DataFrame] = {}
                planned.append((run, pair_leaves(*pipeline.outputs(spark, run, written, bad)), bad))
            except Exception as problem:  # noqa: BLE001 - whatever a pipeline raises belongs into the report
                text = OUT_OF_TIME if expired.is_set() else _reason(problem)
                _commit(_error_rows(spark, [run], ERROR, text), report_path)
        if planned:
            _write_planned(spark, planned, report_path, settings, expired)
    finally:
        for path in written:
            remove(spark, path)


def _write_planned(
    spark: SparkSession,
    planned: Sequence[Planned],
    report_path: str,
    settings: tuple[bool, bool],
    expired: Event,
) -> None:
    runs = [run for run, *_ in planned]
    try:
        _commit(_batch_report(spark, planned, *settings), report_path)
    except Exception as problem:  # noqa: BLE001
        if expired.is_set():
            _commit(_error_rows(spark, runs, ERROR, OUT_OF_TIME), report_path)
        elif len(planned) > 1:
            half = len(planned) // 2
            _write_planned(spark, planned[:half], report_path, settings, expired)
            _write_planned(spark, planned[half:], report_path, settings, expired)
        else:
            _commit(_error_rows(spark, runs, ERROR, _reason(problem)), report_path)


def _batch_report(
    spark: SparkSession, planned: Sequence[Planned], check_metadata: bool, keyed: bool
) -> DataFrame:
    """One report plan for a batch: per path, runs whose outputs have the same two schemas are compared together."""
    groups: dict[tuple, list[tuple[Row, Pair]]] = {}
    for run, pairs, _ in planned:
        for pair in pairs:
            both = isinstance(pair.left, DataFrame) and isinstance(pair.right, DataFrame)
            key = (pair.path, pair.left.schema.json(), pair.right.schema.json()) if both else (pair.path, run.run_id)
            groups.setdefault(key, []).append((run, pair))

    def together(side: str, members: list[tuple[Row, Pair]]) -> Any:
        leaves = [(run, getattr(pair, side)) for run, pair in members]
        if not isinstance(leaves[0][1], DataFrame):
            return leaves[0][1]
        return reduce(DataFrame.union, [df.select("*", F.lit(run.run_id).alias(_RUN)) for run, df in leaves])

    # The schemas of all groups are compared in one go; paths repeat among groups, so their numbers stand for them.
    first = [Pair(str(n), *members[0][1][1:]) for n, members in enumerate(groups.values())]
    by_number = _schema_differences(spark, first, check_metadata)
    parts = []
    for n, ((path, *_), members) in enumerate(groups.items()):
        runs = _run_rows(spark, [run for run, _ in members]).withColumnRenamed("run_id", _RUN)
        differences = {path: by_number[str(n)]} if str(n) in by_number else {}
        pair = Pair(path, together("left", members), together("right", members))
        report = _pair_report(spark, pair, (_RUN,), runs, differences, keyed)
        parts.append(report.withColumnRenamed(_RUN, "run_id"))
    return reduce(DataFrame.unionByName, parts + _bad_line_rows(spark, planned))


def _bad_line_rows(spark: SparkSession, planned: Sequence[Planned]) -> list[DataFrame]:
    """An ERROR row for each run and input with bad lines, in the same job as the comparison; none where there are none."""
    found = [
        df.select(F.lit(run.run_id).alias("run_id"), F.lit(f"inputs.{name}").alias("path"), F.col(BAD_LINE).alias("line"))
        for run, _, bad in planned
        for name, df in bad.items()
    ]
    if not found:
        return []
    lines = reduce(DataFrame.union, found).groupBy("run_id", "path").agg(F.count("*").alias("n"), F.min("line").alias("line"))
    error = F.format_string(BAD_LINES_TEXT, F.col("path"), F.col("n"), F.substring("line", 1, BAD_LINE_SHOWN))
    rows = _run_rows(spark, [run for run, *_ in planned]).join(lines, "run_id")
    return [_report_shape(rows.withColumns({"status": F.lit(ERROR), "error": error}), ("run_id", "run_date", "raw_path"))]
