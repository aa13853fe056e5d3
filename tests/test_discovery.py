from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from twinrun import functions as fn
from twinrun.functions.runs import run_date_text
from twinrun.plans import discovery


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


@pytest.mark.parametrize(
    "run_id, expected",
    [
        ("x-2024-01-02-y", "2024-01-02"),
        ("2024-01-02", "2024-01-02"),
        ("run_2024-01-02", None),
        ("2024-01-02_x", None),
        ("2024-01-02T00", None),
        ("é2024-01-02", None),
        ("12024-01-02", None),
        ("a-2024-01-02-2023-05-06", "2024-01-02"),
        ("none", None),
        (None, None),
    ],
)
def test_run_date_text(spark, run_id, expected):
    assert one(spark, run_date_text(F.lit(run_id).cast("string"))) == expected


def test_impossible_date_is_null_and_not_an_error(spark):
    assert one(spark, fn.run_date(F.lit("r-2024-13-45"))) is None
    assert one(spark, fn.run_date(F.lit("r-2024-02-30"))) is None
    assert one(spark, fn.run_date(F.lit("r-2024-02-29"))) == date(2024, 2, 29)


@pytest.mark.parametrize(
    "name, expected",
    [
        ("feed/t/run_id=a/b", "a"),
        ("feed/run_id=a", "a"),
        ("feed/t/run_id=/run_id=b/c", "b"),
        ("feed/t/run_id=/x", "t"),
        ("feed//a//b", "a"),
        ("feed/xrun_id=a/b", "xrun_id=a"),
        ("feed/", None),
        ("feed///", None),
    ],
)
def test_run_id(spark, name, expected):
    assert one(spark, fn.run_id(F.lit(name), "feed/")) == expected


def test_paths(spark):
    assert [one(spark, fn.norm_prefix(F.lit(p))) for p in ("/feed", "feed//", "", "/", "a/b")] == [
        "feed/", "feed/", "", "", "a/b/",
    ]
    assert [one(spark, fn.norm_dir(F.lit(p))) for p in ("/a", "/a///", "a/")] == ["/a/", "/a/", "a/"]
    assert one(spark, fn.expand("/d/{run_id}/{run_id}.csv", F.lit("r"))) == "/d/r/r.csv"
    assert one(spark, fn.snapshot_folder(F.lit("history/2024-01-01T1Z/a.csv"))) == "2024-01-01T1Z"
    assert one(spark, fn.snapshot_folder(F.lit("other/2024-01-01T1Z/a.csv"))) is None


def test_dates(spark):
    for value in ("2024-01-02", date(2024, 1, 2), datetime(2024, 1, 2, 13)):
        assert one(spark, fn.as_date(value)) == date(2024, 1, 2)
    with pytest.raises(ValueError):
        fn.as_date("2024-13-45")


def listing(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "name string")


def ids(df):
    return [r.run_id for r in df.collect()]


def test_discovery_order_window_and_limits(spark):
    names = [f"feed/product/run_id=r-2024-01-{d:02d}{x}/p" for d in (1, 2, 3) for x in ("", "-b")]
    files = listing(spark, *names, *names, None, "", "feed/product/", "feed/other/run_id=q-2024-01-09/p")
    assert ids(discovery.discover_runs(files)) == [
        "r-2024-01-03-b", "r-2024-01-03", "r-2024-01-02-b", "r-2024-01-02", "r-2024-01-01-b", "r-2024-01-01",
    ]
    assert ids(discovery.discover_runs(files, max_runs=2)) == ["r-2024-01-03-b", "r-2024-01-03"]
    assert ids(discovery.discover_runs(files, max_runs=0)) == []
    assert ids(discovery.discover_runs(files, start="2024-01-02", end=datetime(2024, 1, 2, 8))) == [
        "r-2024-01-02-b", "r-2024-01-02",
    ]
    assert ids(discovery.discover_runs(files, prefix="/feed/other/")) == ["q-2024-01-09"]
    with pytest.raises(ValueError):
        discovery.discover_runs(files, max_runs=-1)


def test_raw_paths(spark):
    runs = spark.sql("VALUES ('a-2024-01-01', DATE'2024-01-01'), ('b-2024-01-02', DATE'2024-01-02') AS t(run_id, run_date)")
    files = listing(spark, "history/2024-01-01T09Z/x.csv", "history/2024-01-01T10Z/x.csv", "history/2024-01-03T09Z/x.csv")
    snapshots = discovery.latest_snapshots(files)
    rows = discovery.resolve_raw_paths(runs, snapshots, "/mnt/in/").orderBy("run_id").collect()
    assert [(r.raw_path, r.raw_status) for r in rows] == [("/mnt/in/history/2024-01-01T10Z/", "FOUND"), (None, "MISSING")]
    with pytest.raises(Exception, match="no snapshot folder for run date 2024-01-02"):
        discovery.resolve_raw_paths(runs, snapshots, "/mnt/in", strict=True).collect()
    both = discovery.resolve_raw_paths(runs, snapshots, "/mnt/in", override="/one", template="/t/{run_id}").collect()
    assert {r.raw_path for r in both} == {"/one/"}


def test_prefix_reaches_the_scan(spark, tmp_path):
    listing(spark, "feed/a", "x").write.parquet(str(tmp_path / "l"))
    plan = discovery.names_below(spark.read.parquet(str(tmp_path / "l")), "feed/")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(name,feed/)" in text
