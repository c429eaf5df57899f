"""Documents to packed training sequences, stage by stage."""

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession

from demandcast.llm import decontaminate, near_duplicates, packing, quality_rules, secret_scan
from demandcast.llm.common import table, workers_find_package
from demandcast.session import materialize


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules (operator 4): rejected documents go, the others lose their failed lines."""
    return quality_rules.keep_clean(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicates (operator 7): the document with the least id of each class stays."""
    workers_find_package(spark)
    return near_duplicates.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decontamination (operator 3): documents with a benchmark passage go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scan (operator 9): secrets are replaced by a mark."""
    workers_find_package(spark)
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing (operator 1) of every remaining document."""
    workers_find_package(spark)
    return packing.packed_documents(docs, path("byte_bpe_50k.json"))


STAGES = [
    ("quality", clean),
    ("near_duplicates", without_copies),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: SQL can't express alignment, tokenizers or guess costs; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is stored before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
