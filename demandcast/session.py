"""Session settings and the shared folder for cut lineage."""

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name="demandcast", master=None, **conf):
    """A session with adaptive execution on; keyword `a__b` sets `spark.a.b`."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config("spark." + key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read: `spark.checkpoint.dir`, else the folder of `setCheckpointDir`.

    On a cluster a path without a scheme is one of the default file system, as Spark takes it. Without
    either, a local session gets a temporary folder and a cluster a folder in the warehouse.
    """
    context = spark.sparkContext
    one_process = re.match(r"local(\[|$)", context.master)
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(
                os.path.realpath(tempfile.mkdtemp(prefix="demandcast-"))
                if one_process
                else f"{spark.conf.get('spark.sql.warehouse.dir')}/demandcast"
            )
        folder = context.getCheckpointDir()
    if not one_process:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if folder.startswith("file:") and not context.master.startswith("local"):
        _check_shared(spark, folder)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


_checked = set()


def _check_shared(spark, folder):
    """Raise if rows that tasks write in `folder` don't come back: executors then have it on their own disks.

    One small job for each application and folder, with a task for every core known by then.
    """
    key = (spark.sparkContext.applicationId, folder)
    if key in _checked:
        return
    tasks, probe = spark.sparkContext.defaultParallelism, f"{folder}/probe-{uuid.uuid4().hex}"
    try:
        if _store(spark.range(0, tasks, 1, tasks), probe).count() < tasks:
            raise ValueError(f"set spark.checkpoint.dir to a folder all executors share, {folder} is none")
    finally:
        _remove(spark, probe)
    _checked.add(key)


def _store(df: DataFrame, path: str, by: str | None = None) -> DataFrame:
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write `df` once as parquet in the shared folder, in folders by `by`, and read it back.

    Cuts lineage in a way that outlives executors, and unlike an RDD
    checkpoint the result keeps column pruning, filter pushdown and known size
    (so later joins choose their strategy from real file sizes).
    """
    return _store(df, f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}", by)


def _remove(spark, folder):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession):
    """A `materialize` whose tables are removed at the end of the block."""
    folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    try:
        yield lambda df, label: _store(df, f"{folder}/{label}")
    finally:
        _remove(spark, folder)
