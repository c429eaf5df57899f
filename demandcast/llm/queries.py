"""One query for each operator, over its whole table, with production parameters."""

from public_tokenizers import path
from pyspark.sql import functions as F

from demandcast.llm import decontaminate, language_id, line_dedup, near_duplicates, packing, periodic_runs, quality_classifier, quality_rules, secret_scan, token_counts, toxicity, url_filter, whitening
from demandcast.llm.common import table
from demandcast.llm.oracle import ORACLE  # noqa: F401

BYTE_BPE = path("byte_bpe_50k.json")


def op1_best_fit_packing(spark, folder):
    return packing.packed_documents(table(spark, folder, "documents"), BYTE_BPE)


def op10_token_counts(spark, folder):
    """Starts with a cache of its own, so every distinct text is encoded."""
    cache = token_counts.new_cache(spark)
    counts = token_counts.token_counts(table(spark, folder, "documents"), BYTE_BPE, cache)
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op4_line_quality(spark, folder):
    judged = quality_rules.quality(table(spark, folder, "documents"))
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept n_bad_lines kept_chars".split()
    return judged.select("doc_id", *(F.col(f"quality.{name}").alias(name) for name in names))


def op9_secret_scan(spark, folder):
    return secret_scan.find_secrets(table(spark, folder, "documents"))


#: The rules of the query.
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op6_url_equivalence(spark, folder):
    judged = url_filter.judge(table(spark, folder, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_toxicity_lexicon(spark, folder):
    docs = table(spark, folder, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels")))
    return scored.select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "matched", "n_words"
    )


def op8_subword_quality(spark, folder):
    docs = table(spark, folder, "documents")
    scored = quality_classifier.score(docs, quality_classifier.fit(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_benchmark_leaks(spark, folder):
    return decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op7_order_minhash(spark, folder):
    return near_duplicates.near_duplicates(table(spark, folder, "documents"))


def op2_language_evidence(spark, folder):
    """Pages and documents; the text model is counted on all documents."""
    docs, pages = table(spark, folder, "documents"), table(spark, folder, "pages")
    model = language_id.fit(docs)
    of_pages = language_id.identify(language_id.page_evidence(pages), model)
    of_docs = language_id.identify(language_id.document_evidence(docs), model)
    none = F.lit(None).cast("long")
    return of_pages.select(none.alias("doc_id"), F.col("id").alias("page_id"), "lang", "confidence").unionByName(
        of_docs.select(F.col("id").alias("doc_id"), none.alias("page_id"), "lang", "confidence")
    )


def op13_line_dedup(spark, folder):
    kept = line_dedup.drop_common_lines(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def planted_repeats(docs):
    """(doc_id, text): in a tenth of the ids, the text's words repeat from some word on, as op12's contract says."""
    h = F.crc32(F.col("doc_id").cast("string"))
    docs = docs.select("doc_id", "text", h.alias("h")).withColumn("g", F.expr("h div 10"))
    split = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    docs = docs.withColumn("words", F.when(F.col("h") % 10 == 0, split))
    docs = docs.withColumn("a", F.expr("g % nullif(size(words), 0)"))
    docs = docs.withColumn("p", F.expr("1 + (size(words) - a) div (3 + g % 8)"))
    repeated = F.expr("array_join(transform(words, (w, i) -> CASE WHEN i < a THEN w ELSE words[int(a + (i - a) % p)] END), ' ')")
    return docs.select("doc_id", F.when(F.col("a").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, folder):
    found = periodic_runs.collapse_runs(planted_repeats(table(spark, folder, "documents")))
    lines = F.expr("transform(arrays_zip(starts, lengths, periods), r -> concat_ws(',', r.starts, r.lengths, r.periods) || '\n')")
    return found.select(
        "doc_id",
        "n_runs",
        "start",
        "length",
        "period",
        F.expr("1000 * length div period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


OP11 = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def op11_embedding_whitening(spark, folder):
    rows = table(spark, folder, "embeddings")
    model, vectors = whitening.fit(rows, components=4)
    if model is None:
        return spark.createDataFrame([], OP11)
    error = whitening.identity_error(vectors, model)
    # Null where no vector differs from another.
    shares = F.array(*(F.lit(v / model.trace if model.trace else None).cast("double") for v in model.values.tolist()))
    found = whitening.whiten(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return found.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("place")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


QUERIES = {
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_line_dedup": op13_line_dedup,
    "op2_language_evidence": op2_language_evidence,
    "op7_order_minhash": op7_order_minhash,
    "op3_benchmark_leaks": op3_benchmark_leaks,
    "op8_subword_quality": op8_subword_quality,
    "op5_toxicity_lexicon": op5_toxicity_lexicon,
    "op6_url_equivalence": op6_url_equivalence,
    "op9_secret_scan": op9_secret_scan,
    "op4_line_quality": op4_line_quality,
    "op1_best_fit_packing": op1_best_fit_packing,
    "op10_token_counts": op10_token_counts,
}

