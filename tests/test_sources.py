import json
import random

import pytest
from pyspark.sql import functions as F

from twinrun.operators.diff import diff_counts
from twinrun.plans.context import assemble_context
from twinrun.sources import files, readers, sinks

TESTDATA = "/root/testdata/sf0.001"


def test_delimited_round_trip(spark, tmp_path):
    customer = spark.read.parquet(f"{TESTDATA}/customer.parquet")
    customer.write.option("sep", "|").option("header", True).csv(str(tmp_path / "c"))
    back = readers.read_delimited(spark, str(tmp_path / "c"), customer.schema, "|")
    assert tuple(diff_counts(customer, back).first()) == (150, 150, 0, 0)


def test_read_named(spark):
    spark.range(3).createOrReplaceTempView("some_table")
    assert readers.read_named(spark, "some_table").count() == 3


def _touch(root, *names):
    for name in names:
        target = root / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text("1")


def test_list_files_gives_names_below_the_root(spark, tmp_path):
    held = ["feed/run_id=a-2024-01-01/x.csv", "feed/y z.csv", "top.txt", "a/x.csv", "a/_SUCCESS", "_tmp/y.csv", "_tmp/b/c/d/z.csv", ".w/.v", "_k=1/x.csv"]
    _touch(tmp_path / "root", *held)
    (tmp_path / "root" / "empty").mkdir()
    for root in (str(tmp_path / "root"), f"file://{tmp_path}/root/", f"file:{tmp_path}/root"):
        for folders in (1, 3, 64):
            rows = files.list_files(spark, root, folders).collect()
            assert sorted(r.name for r in rows) == sorted(held)
            assert all(r.size == 1 and r.modified for r in rows)


def test_folders_are_listed_by_tasks(spark, tmp_path):
    """The plan opens the first levels alone; each folder is a partition, and those below go with theirs."""
    _touch(tmp_path, *[f"d{n}/e{m}/f/x" for n in range(5) for m in range(3)])
    reader = files.FolderReader(str(tmp_path), 6)
    assert sorted((len(p.path) - len(str(tmp_path)), p.deep) for p in reader.partitions()) == [(0, False)] + [(3, True)] * 5
    assert sorted(p.deep for p in files.FolderReader(str(tmp_path), 100).partitions()) == [False] * (1 + 5 + 15 + 15)
    listed = files.list_files(spark, str(tmp_path), 6)
    assert listed.select(F.spark_partition_id()).distinct().count() == 5 and listed.count() == 15


def test_folders_that_cannot_be_listed(spark, tmp_path):
    with pytest.raises(ValueError, match="absolute"):
        files.list_files(spark, "relative/folder")
    with pytest.raises(ValueError, match="read_listing"):
        files.list_files(spark, "viewfs://store/x")
    with pytest.raises(Exception, match="there is no folder"):
        files.list_files(spark, str(tmp_path / "none")).collect()
    assert files.list_files(spark, str(tmp_path)).collect() == []


def test_saved_listing(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps([{"name": "a", "size": 1}, {"name": None}, {"size": 2}, {"name": "b"}], indent=1))
    names = readers.read_listing(spark, str(tmp_path / "l.json"), multi_line=True)
    assert names.columns == ["name"] and [r.name for r in names.collect()] == ["a", None, None, "b"]


def test_saved_listing_by_line_holds_every_name(spark, tmp_path):
    held = ["feed/run_id=a/_SUCCESS", "feed/_tmp/x", ".hidden/y"]
    (tmp_path / "l.json").write_text("\n".join(json.dumps({"name": n, "size": 1}) for n in held))
    assert [r.name for r in readers.read_listing(spark, str(tmp_path / "l.json")).collect()] == held


def test_corpus_is_one_row_per_short_file(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.yml").write_text("x:\n  y: 1\n")
    (tmp_path / "d" / "_hidden.yml").write_text("z: 1")
    (tmp_path / "d" / "empty.yml").write_text("")
    (tmp_path / "b.txt").write_text("no")
    rows = {r.path.rsplit("/", 2)[1:][1]: (r.range, r.lines, r.content) for r in files.read_corpus(spark, str(tmp_path), "*.yml").collect()}
    assert rows == {"a.yml": (0, 2, "x:\n  y: 1\n"), "_hidden.yml": (0, 0, "z: 1"), "empty.yml": (0, 0, "")}


@pytest.mark.parametrize("range_bytes", [1, 2, 7, 64, 1000, 1 << 20])
def test_ranges_are_the_file(spark, tmp_path, range_bytes):
    r = random.Random(range_bytes)
    texts = {
        "a": "".join("é" * r.randrange(40) + r.choice(["\n", "\n\n", "\r\n"]) for _ in range(60)),
        "b": "one line without an end " * 30,
        "c": "\n" * 50,
        "d": "x" * 300_000 + "\n" + "y",
        "e": "",
    }
    if range_bytes < 64:
        texts.pop("d")
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    corpus = files.read_corpus(spark, str(tmp_path), range_bytes=range_bytes, tasks=3)
    rows = corpus.orderBy("path", "range").collect()
    assert {k: "".join(x.content for x in rows if x.path.endswith(f"/{k}")) for k in texts} == texts
    assert all(x.content.endswith("\n") for x, y in zip(rows, rows[1:]) if x.path == y.path)  # whole lines only
    assert all(len(x.content.split("\n")[0].encode()) + 1 >= 1 and (x.content or x.path.endswith("/e")) for x in rows)
    number = {(x.path, x.range): x.first_line for x in files.first_lines(corpus).collect()}
    done = {}
    for x in rows:
        assert number[x.path, x.range] == done.get(x.path, 0) + 1
        done[x.path] = done.get(x.path, 0) + x.content.count("\n")
    assert {x.path[-1]: x.content for x in files.whole_files(corpus).collect()} == texts


def test_broken_bytes_are_marked(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"ok\n\xff\xfe x\n")
    assert files.read_corpus(spark, str(tmp_path)).first().content == "ok\n\ufffd\ufffd x\n"


def test_written_context_equals_the_assembled_document(spark, tmp_path):
    ids = spark.range(4000).select(
        F.concat(F.lit("p"), F.col("id") % 3).alias("pipeline"), F.expr("CAST(id DIV 3 AS INT)").alias("pos"),
        F.concat(F.lit("line "), "id", F.lit("\n")).alias("text"),
    )
    parts = ids.orderBy(F.rand(7))
    sinks.write_context(parts, str(tmp_path / "ctx"))
    want = {r.pipeline: r.document for r in assemble_context(parts).collect()}
    for pipeline, document in want.items():
        files = list((tmp_path / "ctx" / f"pipeline={pipeline}").glob("part-*.txt"))
        assert len(files) == 1 and files[0].read_text() == document
    sinks.write_context(parts, str(tmp_path / "volumes"), parts_per_volume=500)
    for pipeline, document in want.items():
        folders = sorted((tmp_path / "volumes" / f"pipeline={pipeline}").glob("volume=*"), key=lambda f: int(f.name[7:]))
        assert len(folders) == 3 and "".join(next(f.glob("part-*.txt")).read_text() for f in folders) == document


def _tree(folder):
    """Bytes of the files that readers see, by folder."""
    files = [f for f in folder.rglob("*") if f.is_file() and f.name[0] not in "._"]
    return sorted((str(f.parent.relative_to(folder)), f.read_bytes()) for f in files)


def test_written_context_is_what_spark_writes(spark, tmp_path):
    names = ["a", "a/b=c%d", "é x", 'q"\'#*:?', "[x]{y}^\\", "\t\n\x7f", "%41", "C#000", " ", None]
    rows = [(name, pos, None if pos == 2 else f"{name} {pos}é\n") for name in names for pos in range(12)]
    parts = spark.createDataFrame(rows, "pipeline string, pos int, text string").orderBy(F.rand(3))
    for volumes, keys in ((None, ["pipeline"]), (5, ["pipeline", "volume"])):
        sinks.write_context(parts, str(tmp_path / f"mine{volumes}"), parts_per_volume=volumes)
        by_key = parts.withColumn("volume", F.floor(F.col("pos") / 5)).select(*keys, "pos", "text").repartition(*keys)
        by_key.sortWithinPartitions(*keys, "pos").drop("pos").write.partitionBy(*keys).text(str(tmp_path / f"spark{volumes}"))
        assert _tree(tmp_path / f"mine{volumes}") == _tree(tmp_path / f"spark{volumes}")
    assert not list(tmp_path.glob("_*")) and (tmp_path / "mineNone" / "_SUCCESS").exists()
    assert not list((tmp_path / "mineNone").rglob(".*.crc"))  # tasks wrote it, and no process for each file
    got = sinks.read_context(spark, str(tmp_path / "mineNone"))
    by_spark = spark.read.text(str(tmp_path / "sparkNone"), wholetext=True).selectExpr("pipeline", "value document")
    assert got.dtypes == by_spark.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, by_spark.collect())) and got.count() == len(names)


def test_written_context_of_empty_names_modes_and_drafts(spark, tmp_path):
    parts = spark.createDataFrame([("", 0, "e"), (None, 0, "n"), ("7", 0, "x"), ("7", 1, "y")], "pipeline string, pos int, text string")
    folder = tmp_path / "ctx"
    sinks.write_context(parts, f"file://{folder}/")
    want = [("7", "x\ny\n"), (None, "e\n"), (None, "n\n")]
    read = lambda: sorted(map(tuple, sinks.read_context(spark, str(folder)).collect()), key=repr)
    assert read() == sorted(want, key=repr)
    (folder / "pipeline=7" / ".9-0").write_text("of an attempt that was ended")
    assert read() == sorted(want, key=repr)
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        sinks.write_context(parts, str(folder))
    sinks.write_context(parts.where("pipeline = '7'"), str(folder), mode="append")
    assert read() == sorted([want[0], *want], key=repr)
    sinks.write_context(parts.where("pipeline = '7'"), str(folder), mode="overwrite")
    assert read() == want[:1]
    sinks.write_context(parts.limit(0), str(tmp_path / "none"))
    assert sinks.read_context(spark, str(tmp_path / "none")).count() == 0
    failing = parts.withColumn("text", F.when(F.col("pos") == 1, F.raise_error(F.lit("no text"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="no text"):
        sinks.write_context(failing, str(tmp_path / "failed"))
    assert not (tmp_path / "failed").exists()


def test_many_documents_are_read_by_few_tasks(spark, tmp_path):
    n = 5000
    parts = spark.range(n).selectExpr("concat('p', id) pipeline", "0 pos", "concat('text ', id) text")
    sinks.write_context(parts, str(tmp_path / "ctx"))
    got = sinks.read_context(spark, str(tmp_path / "ctx"))
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))  # 157 by Spark's reader
    assert {tuple(r) for r in got.collect()} == {(f"p{k}", f"text {k}\n") for k in range(n)}
