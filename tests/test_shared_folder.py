"""Queries that write to the shared folder, on a cluster whose ``spark.checkpoint.dir`` is a path without a scheme."""

import pytest

from tests.test_queries import duck, test_query_equals_sql as equals_sql  # noqa: F401
from twinrun.session import scratch_dir

QUERIES = [
    "assemble_context", "bad_lines_report", "broken_leaf", "bucketed_parity", "corpus_lines", "delimited_round_trip",
    "each_run_report", "hash_parity", "listed_files", "written_report", "written_context",
]


@pytest.fixture
def on_cluster(spark, monkeypatch, tmp_path):
    """The master and the settings of the session as they are on a cluster; ``named`` sets another folder."""
    kind = type(spark.conf)
    get = kind.get

    def named(folder):
        monkeypatch.setattr(kind, "get", lambda self, key, *other: folder if key == "spark.checkpoint.dir" else get(self, key, *other))

    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    named(str(tmp_path))
    return named


def test_the_folder_has_its_full_address(spark, on_cluster, tmp_path):
    for given in (f"{tmp_path}", f"{tmp_path}/", f"file:{tmp_path}", f"file://{tmp_path}/"):
        on_cluster(given)
        assert scratch_dir(spark) == f"file:{tmp_path}"


@pytest.mark.parametrize("name", QUERIES)
def test_query_on_a_cluster(spark, duck, on_cluster, tmp_path, name):  # noqa: F811
    equals_sql(spark, duck, name)
    assert any(tmp_path.iterdir())
