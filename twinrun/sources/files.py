"""Folders of files as tables: a data source that lists folders on the executors, and text read in ranges of lines.

File systems are opened by Arrow in the tasks themselves: local and mounted folders, and stores whose address Arrow knows
(``s3``, ``gs``, ``abfs``, ``hdfs``). Every name is listed, also those that Spark's own readers pass over.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fnmatch import fnmatchcase
from itertools import batched
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from twinrun.session import full_address

#: Folders that are opened while the listing is planned, until there are so many to hand out.
FOLDERS = 64
#: Rows of a listing that a task hands over at a time, and bytes of text in a range.
ROWS = 10_000
RANGE_BYTES = 8 << 20

_LISTED = pa.schema([("name", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", tz="UTC"))])


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and the folder's path there."""
    if root.startswith("/"):
        return fs.LocalFileSystem(), root.rstrip("/") or "/"
    scheme, _, rest = root.partition(":")
    if not rest:
        raise ValueError(f"give the folder as an absolute path or URI, not {root!r}")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.strip("/")
    try:
        system, path = fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}")
    except (pa.ArrowInvalid, OSError) as problem:
        raise ValueError(f"{root!r} is in no store that tasks can list; give a mounted folder, or a saved listing (read_listing)") from problem
    return system, path.rstrip("/")


@dataclass
class Folder(InputPartition):
    """A folder to list, with all below it or without."""

    path: str
    deep: bool


class FolderReader(DataSourceReader):
    def __init__(self, root: str, folders: int):
        self.root, self.folders = root, folders

    def partitions(self) -> list[Folder]:
        """A partition for each folder, level by level from the top until there are enough; the rest goes with its folder."""
        system, top = opened(self.root)
        if system.get_file_info(top).type != fs.FileType.Directory:
            raise FileNotFoundError(f"there is no folder {self.root}")
        alone: list[str] = []
        below = [top]
        while below and len(alone) + len(below) < self.folders:
            alone += below
            below = [x.path for path in below for x in system.get_file_info(fs.FileSelector(path)) if x.type == fs.FileType.Directory]
        return [Folder(path, False) for path in alone] + [Folder(path, True) for path in below]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        """One folder is in memory at a time."""
        system, top = opened(self.root)
        cut = len(top.rstrip("/")) + 1
        waiting = [partition.path]
        while waiting:
            inside = system.get_file_info(fs.FileSelector(waiting.pop()))
            if partition.deep:
                waiting += [x.path for x in inside if x.type == fs.FileType.Directory]
            files = [x for x in inside if x.type == fs.FileType.File]
            for at in range(0, len(files), ROWS):
                some = files[at : at + ROWS]
                rows = [[x.path[cut:] for x in some], [x.size for x in some], [x.mtime for x in some]]
                yield pa.record_batch([pa.array(r, t) for r, t in zip(rows, _LISTED.types)], schema=_LISTED)


class FolderSource(DataSource):
    """``spark.read.format("twinrun_files").option("root", folder).load()``."""

    @classmethod
    def name(cls) -> str:
        return "twinrun_files"

    def schema(self) -> str:
        return "name string, size bigint, modified timestamp"

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options["root"], int(self.options.get("folders", FOLDERS)))


def list_files(spark: SparkSession, root: str, folders: int = FOLDERS) -> DataFrame:
    """``name, size, modified`` of all files below a folder, names relative to it; no file is opened.

    The first levels are opened while the listing is planned, until there are ``folders`` of them; then each folder is
    listed by a task. Names that begin with ``_`` or ``.`` are rows like all others. For very large stores a saved
    listing is faster still (``read_listing``).
    """
    opened(root)
    spark.dataSource.register(FolderSource)
    return spark.read.format(FolderSource.name()).option("root", root).option("folders", folders).load()


# ---------------------------------------------------------------- text in ranges


def _range(file, size: int, start: int, end: int) -> bytes:
    """All lines that begin at ``start`` or later and before ``end``, whole."""
    file.seek(max(0, start - 1))
    if start and file.read(1) != b"\n":
        # In the middle of a line: it belongs to the range before.
        while file.tell() < end:
            at = file.tell()
            piece = file.read(min(1 << 20, end - at))
            found = piece.find(b"\n")
            if found >= 0:
                file.seek(at + found + 1)
                break
        if file.tell() >= end:
            return b""
    parts = [file.read(end - file.tell())]
    while parts[-1][-1:] != b"\n" and file.tell() < size:
        at = file.tell()
        piece = file.read(1 << 16)
        found = piece.find(b"\n")
        parts.append(piece if found < 0 else piece[: found + 1])
        file.seek(at + len(parts[-1]))
    return b"".join(parts)


def read_corpus(spark: SparkSession, root: str, pattern: str = "*", range_bytes: int = RANGE_BYTES, tasks: int | None = None) -> DataFrame:
    """``path, range, lines, content`` of the text files below a folder whose file name fits the pattern.

    A file of up to ``range_bytes`` is one row, its range 0. A longer one is several rows of whole lines, which different
    tasks read; in the order of ``range`` they are the file. A line is never cut, so one that is longer than a range is a
    longer row, and ranges without a beginning of a line have no row. ``lines`` counts line ends; ``first_lines`` gives
    the number of each row's first line, ``whole_files`` puts rows together. Bytes that are no UTF-8 become U+FFFD. An
    empty file is one row with an empty text; names that begin with ``_`` or ``.`` are read like all others.
    """
    files = list_files(spark, root).where(F.expr("size IS NOT NULL"))
    n = F.greatest(F.ceil(F.col("size") / range_bytes), F.lit(1))
    ranges = files.select("name", "size", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("range"))

    def fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = opened(root)
        for batch in batches:
            for name, size, k in zip(*(batch[c].to_pylist() for c in ("name", "size", "range"))):
                if not fnmatchcase(name.rsplit("/", 1)[-1], pattern):
                    continue
                with system.open_input_file(f"{top.rstrip('/')}/{name}") as file:
                    text = _range(file, size, k * range_bytes, min(size, (k + 1) * range_bytes)) if size else b""
                if text or not size:
                    content = text.decode("utf-8", "replace")
                    row = [[f"{root.rstrip('/')}/{name}"], [k], [text.count(b"\n")], [content]]
                    types = [pa.string(), pa.int32(), pa.int64(), pa.string()]
                    yield pa.record_batch([pa.array(v, t) for v, t in zip(row, types)], names=["path", "range", "lines", "content"])

    # Dealt by number: the rows are tiny, but each of them stands for a range of text.
    dealt = ranges.repartition(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")), "name", "range")
    return dealt.mapInArrow(fits, "path string, range int, lines bigint, content string")


def first_lines(corpus: DataFrame) -> DataFrame:
    """``path, range, first_line`` (from 1) of the rows of ``read_corpus``; no text is shuffled."""
    before = Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    number = F.coalesce(F.sum("lines").over(before), F.lit(0)) + 1
    return corpus.select("path", "range", "lines").select("path", "range", number.alias("first_line"))


def whole_files(corpus: DataFrame) -> DataFrame:
    """``path, content`` with the ranges of a file put together, for files that fit into a cell."""
    parts = F.array_sort(F.collect_list(F.struct("range", "content")))
    return corpus.groupBy("path").agg(F.array_join(F.transform(parts, lambda p: p["content"]), "").alias("content"))


# ---------------------------------------------------------------- many small texts in folders named by their keys

# Spark's name for a key that is NULL or empty, the characters it escapes, and its mark of a whole result.
NO_KEY = "__HIVE_DEFAULT_PARTITION__"
_ESCAPED = re.compile(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""")
SUCCESS = "_SUCCESS"


def local_folder(spark: SparkSession, path: str) -> str | None:
    """The path of a local or mounted folder; None for other file systems."""
    place = full_address(spark, path)
    return opened(place)[1] if place.startswith("file:") else None


def _key_folder(names: Sequence[str], values: Sequence[object]) -> str:
    escape = lambda value: _ESCAPED.sub(lambda c: f"%{ord(c[0]):02X}", str(value)) or NO_KEY
    return "/".join(f"{n}={NO_KEY if v is None else escape(v)}" for n, v in zip(names, values))


def write_key_folders(rows: DataFrame, folder: str, keys: Sequence[str]) -> None:
    """The ``text`` of sorted rows, which hold all of a key in one partition, as lines of one file for each key, below a
    local or mounted folder that does not exist: what Spark's ``partitionBy(*keys).text`` writes.

    Spark's writer starts two processes for each file there to set its permissions, writes a checksum beside it, and the
    driver moves one key after the other; here the tasks write files of certain names. A file is named when it is whole,
    and the folder when all are, so a task may be repeated, and a job that fails leaves no folder. What it leaves begins
    with ``_``.
    """
    parent, name = os.path.split(folder)
    job = uuid.uuid4()
    unfinished = f"{parent}/_{name}-{job}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        key = file = None
        n = 0

        def named() -> None:
            if file is not None:
                file.close()
                place, draft = os.path.split(file.name)
                # Empty keys share the folder of NULL.
                os.replace(file.name, f"{place}/part-{int('' in key):05d}-{job}.txt")

        for batch in batches:
            texts = batch["text"].to_pylist()
            for k, text in zip(zip(*(batch[c].to_pylist() for c in keys)), texts):
                if k != key or file is None:
                    named()
                    place = f"{unfinished}/{_key_folder(keys, k)}"
                    try:
                        os.mkdir(place)
                    except OSError:  # it is there, or deeper
                        os.makedirs(place, exist_ok=True)
                    key, file, n = k, open(f"{place}/.{attempt}-{int('' in k)}", "wb"), n + 1
                file.write((text or b"") + b"\n")
        named()
        yield pa.record_batch([pa.array([n], pa.int64())], names=["files"])

    os.makedirs(unfinished)
    rows.select(*keys, F.col("text").cast("binary").alias("text")).mapInArrow(write, "files bigint").agg(F.sum("files")).collect()
    with open(f"{unfinished}/{SUCCESS}", "wb"):
        pass
    os.rename(unfinished, folder)


def read_key_folders(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """``key, value`` (the whole text, as bytes) of each file in the ``key=...`` folders of a local or mounted folder.

    One task lists the folder as it is read; the folders in it are opened by all tasks. Names that begin with ``_`` or
    ``.`` and empty files are passed over, as by Spark's reader, which keeps all names on the driver and counts each file
    as megabytes.
    """
    if not os.path.isdir(folder):
        raise FileNotFoundError(f"there is no folder {folder}")
    start = f"{key}="

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            with os.scandir(folder) as found:
                for some in batched((x.name for x in found if x.name.startswith(start)), ROWS):
                    yield pa.record_batch([pa.array(some, pa.string())], names=["name"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, values, size = [], [], 0

        def full() -> pa.RecordBatch:
            return pa.record_batch([pa.array(names, pa.string()), pa.array(values, pa.binary())], names=[key, "value"])

        for batch in batches:
            for name in batch["name"].to_pylist():
                value = name[len(start) :]
                value = None if value == NO_KEY else unquote(value)
                for file in sorted(x for x in os.listdir(f"{folder}/{name}") if x[0] not in "_."):
                    with open(f"{folder}/{name}/{file}", "rb") as f:
                        text = f.read()
                    if text:
                        names.append(value)
                        values.append(text)
                        size += len(text)
                    if size >= RANGE_BYTES or len(names) >= ROWS:
                        yield full()
                        names, values, size = [], [], 0
        yield full()

    folders = spark.range(0, 1, 1, 1).mapInArrow(listed, "name string")
    dealt = folders.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "name")
    return dealt.mapInArrow(texts, f"`{key}` string, value binary")
