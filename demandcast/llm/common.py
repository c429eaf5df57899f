"""Helpers shared by the operators."""

import os
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space ones.
SPACES = " \t\n\x0b\x0c\r"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"

ARROW = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<bigint>": pa.list_(pa.int64()),
    "array<double>": pa.list_(pa.float64()),
    "array<int>": pa.list_(pa.int32()),
}


def arrow(schema: str, *columns) -> pa.RecordBatch:
    """A batch with the columns of a `name type, ...` schema."""
    fields = [part.split() for part in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(values, type=ARROW[kind]) for (_, kind), values in zip(fields, columns, strict=True)],
        names=[name for name, _ in fields],
    )


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned: crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(text, label) of at most about `rows` documents with a label that may be learned.

    The labels with the lowest hash of their id are taken, so the sample doesn't
    depend on order or partitions. Only their ids are sent to the tasks, and
    `rows` bounds them; the table of documents isn't shuffled. Labels of a
    repeated id count once, the greater one; null labels and ids are left out.
    """
    usable = labels.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("label"))
    usable = usable.where("label IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(usable), "doc_id").select("text", "label")


def slices(texts, budget: int):
    """Index ranges of `texts` with about `budget` characters each, one text at least."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > budget:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def workers_find_package(spark: SparkSession) -> None:
    """Put this package's folder on the Python workers' path.

    Enough where workers see the driver's folders; elsewhere pass the package
    with --py-files.
    """
    folder = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if folder not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [folder, known]))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    workers_find_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
