import os
import pathlib
import subprocess
import sys

import pytest

from demandcast import session
from demandcast.session import materialize, shared_folder

REPO = str(pathlib.Path(__file__).parents[1])


@pytest.fixture
def cluster(spark, monkeypatch):
    """The session as if on a cluster whose `spark.checkpoint.dir` is a path without a scheme."""
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(session, "_checked", set(), raising=False)
    assert "://" not in spark.conf.get("spark.checkpoint.dir")
    return spark


def test_bare_path_on_a_cluster(cluster):
    folder = shared_folder(cluster)
    assert folder == "file:" + os.path.realpath(cluster.conf.get("spark.checkpoint.dir"))
    assert sorted(r.id for r in materialize(cluster.range(5), "five").collect()) == [0, 1, 2, 3, 4]
    assert not list(pathlib.Path(folder.removeprefix("file:")).glob("probe-*"))


def test_folder_that_executors_do_not_share(cluster, monkeypatch):
    monkeypatch.setattr(session, "_store", lambda df, path, by=None: df.limit(0))
    for _ in range(2):
        with pytest.raises(ValueError, match="executors share"):
            shared_folder(cluster)


@pytest.mark.parametrize("given", ["none", "context", "cluster"])
def test_without_checkpoint_dir(tmp_path, given):
    """Spark forbids to set the entry in a running session, so the folder is the context's."""
    (tmp_path / "conf").mkdir()
    code = f"""
import sys
from demandcast.session import build_session, materialize, scratch, shared_folder
spark = build_session("t", "local[2]", ui__enabled="false", sql__warehouse__dir={str(tmp_path / "tables")!r})
assert not spark.conf.get("spark.checkpoint.dir", None)
if {given!r} == "context":
    spark.sparkContext.setCheckpointDir({str(tmp_path / "own")!r})
if {given!r} == "cluster":
    spark.sparkContext.master = "spark://host:7077"
with scratch(spark) as store:
    assert store(spark.range(5), "five").count() == 5
assert materialize(spark.range(5), "five").count() == 5
print("FOLDER", shared_folder(spark), shared_folder(spark))
"""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path / "conf"), "TMPDIR": str(tmp_path), "PYTHONPATH": REPO}
    ran = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=180)
    assert ran.returncode == 0, ran.stderr[-2000:]
    first, second = ran.stdout.split("FOLDER ")[1].split()
    at = {"none": "demandcast-", "context": "own/", "cluster": "tables/demandcast/"}[given]
    assert first == second and first.startswith(f"file:{tmp_path}/{at}")
