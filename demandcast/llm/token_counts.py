"""Token counts from a digest cache."""

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandcast.llm.common import arrow
from demandcast.llm.tokens import array_slices, encoder
from demandcast.session import materialize, shared_folder

CACHE = "text_digest binary, tokenizer string, n_tokens bigint"


def tokenizer_digest(path: str) -> str:
    """SHA-256 of the tokenizer's file, which stands for its version."""
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


def new_cache(spark: SparkSession) -> str:
    """The path of a cache that doesn't exist yet, in the shared folder."""
    return f"{shared_folder(spark)}/token-cache-{uuid.uuid4().hex}"


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """Stored counts; empty where nothing has been stored yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(cache)


def token_counts(docs: DataFrame, path: str, cache: str) -> DataFrame:
    """`docs` (doc_id, text) with n_bytes and n_tokens of every whole text.

    `path` is the tokenizer's file, `cache` a Parquet folder of counts by
    (digest of the text, digest of the tokenizer's file). Counts found there are
    joined; each distinct text that misses is encoded once and appended. The
    append is the only write: if it fails, a later run encodes those texts again.
    Runs that append the same text at the same time store it twice, with the same
    count; the join reads one of them.

    Null and empty texts have 0 bytes and 0 tokens. Equal texts share one
    encoding; rows with equal doc_id are kept as they are. Other columns of
    `docs` are left out. An empty table gives an empty one.

    Texts are encoded as they stand: no normalisation but null as empty leaves
    counts unchanged. A text travels in one shuffle, and only if it isn't
    cached. Copies collapse before it, so a text that is a third of all rows
    arrives once from each input task.
    """
    spark, version = docs.sparkSession, tokenizer_digest(path)
    keyed = docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text"))
    keyed = keyed.withColumn("text_digest", F.unhex(F.sha2("text", 256)))
    stored = read_cache(spark, cache).where(F.col("tokenizer") == version)
    missing = keyed.join(stored, "text_digest", "left_anti")
    distinct = missing.groupBy("text_digest").agg(F.first("text").alias("text"))

    def count(batches):
        encode = encoder(path)
        for batch in batches:
            for a, b in array_slices(batch.column("text")):
                part = batch.slice(a, b - a)
                _, n = encode(part.column("text"))
                yield arrow(CACHE, part.column("text_digest"), [version] * (b - a), n)

    distinct.mapInArrow(count, CACHE).write.mode("append").parquet(cache)
    counts = read_cache(spark, cache).where(F.col("tokenizer") == version)
    # Stored, so that the join has a plain exchange on both sides and a hot digest can be split.
    counts = materialize(counts.groupBy("text_digest").agg(F.min("n_tokens").alias("n_tokens")), "counts")
    sizes = keyed.select("doc_id", "text_digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return sizes.join(counts, "text_digest").select("doc_id", "n_bytes", "n_tokens")
