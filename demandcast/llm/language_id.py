"""Language of pages and documents: text, markup, address and host evidence in one posterior."""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandcast.llm.common import arrow, slices
from demandcast.llm.quality_classifier import features
from demandcast.llm.url_filter import host, path
from demandcast.session import materialize

BITS = 14
#: n-grams of a text overlap and repeat; each counts as this share of one observation.
TEMPER = 0.05
#: Observations that a prior of the level above is worth.
SMOOTHING = 5.0

TAGS = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>"
DECLARED = r"(?is)<html\b[^>]*?\blang\s*=\s*[\x22\x27]?([a-z]{2,3})"


@dataclass
class TextModel:
    """Log likelihoods of hashed words and character n-grams, one row for each language."""

    languages: list[str]
    weights: np.ndarray


COUNTS = "lang string, bucket int, n bigint"


def fit(docs: DataFrame) -> TextModel:
    """Counts over all documents with a language (text, lang), by grouped aggregation.

    Tasks count their rows; what reaches the driver is one number for each bucket
    and language, whatever the input. Null languages and texts teach nothing.
    """

    def count(batches):
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), np.array(batch.column("lang").to_pylist(), dtype=object)
            for a, b in slices(texts, 1_000_000):
                found, whose = features(texts[a:b], BITS)
                for lang in set(langs[a:b]):
                    mine = (langs[a:b] == lang)[whose]
                    seen[lang] = seen.get(lang, 0) + np.bincount(found[mine], minlength=1 << BITS)
        for lang, n in seen.items():
            used = np.flatnonzero(n)
            yield arrow(COUNTS, [lang] * len(used), used.astype(np.int32), n[used])

    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    rows = known.mapInArrow(count, COUNTS).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    lang, bucket, n = (rows.column(c).to_pylist() for c in ("lang", "bucket", "n"))
    languages = sorted(set(lang))
    total = np.full((max(len(languages), 1), 1 << BITS), 0.5)
    place = {name: i for i, name in enumerate(languages)}
    total[[place[x] for x in lang], bucket] += n
    return TextModel(languages, np.log(total / total.sum(axis=1, keepdims=True)))


def page_evidence(pages: DataFrame) -> DataFrame:
    """(id, text, declared, suffix, host, domain) of pages (page_id, url, html).

    The suffix is the two-letter first step of the path or the last label of the host if it
    has two letters; the domain is the host's last two labels. What is missing is empty.
    """
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    where = host(url)
    step = F.regexp_extract(path(url), r"^/([A-Za-z]{2})(/|$)", 1)
    country = F.regexp_extract(where, r"\.([a-z]{2})$", 1)
    return pages.select(
        F.col("page_id").alias("id"),
        F.regexp_replace(html, TAGS, " ").alias("text"),
        F.lower(F.regexp_extract(html, DECLARED, 1)).alias("declared"),
        F.lower(F.when(step != "", step).otherwise(country)).alias("suffix"),
        where.alias("host"),
        F.regexp_extract(where, r"([^.]+\.[^.]+)$", 1).alias("domain"),
    )


def document_evidence(docs: DataFrame) -> DataFrame:
    """The same of documents: the source stands for the host; there is no markup and no address."""
    source = F.coalesce("source", F.lit(""))
    empty = F.lit("")
    return docs.select(
        F.col("doc_id").alias("id"),
        F.coalesce("text", empty).alias("text"),
        empty.alias("declared"),
        empty.alias("suffix"),
        source.alias("host"),
        empty.alias("domain"),
    )


def _likelihoods(evidence: DataFrame, model: TextModel) -> DataFrame:
    names = [f"t{i}" for i in range(len(model.languages))]
    schema = "id bigint, declared string, suffix string, host string, domain string, " + ", ".join(f"{n} double" for n in names)

    def score(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in slices(texts, 1_000_000):
                found, whose = features(texts[a:b], BITS)
                part = batch.slice(a, b - a)
                sums = [TEMPER * np.bincount(whose, w[found], b - a) for w in model.weights[: len(names)]]
                rest = (part.column(n) for n in ("id", "declared", "suffix", "host", "domain"))
                yield arrow(schema, *rest, *sums)

    return evidence.mapInArrow(score, schema)


def _normal(logs: list[Column]) -> list[Column]:
    """Probabilities from log weights."""
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    total = sum((F.exp(x - top) for x in logs[1:]), F.exp(logs[0] - top))
    return [F.exp(x - top) / total for x in logs]


def _sums(scored: DataFrame, key: str, n: int, prefix: str) -> DataFrame:
    """Expected texts of each language for every value of `key`; partial sums come before the shuffle."""
    return scored.groupBy(key).agg(*(F.sum(f"p{i}").alias(f"{prefix}{i}") for i in range(n)))


def identify(evidence: DataFrame, model: TextModel) -> DataFrame:
    """(id, lang, confidence) of every row of `evidence`.

    log posterior = text + log P(declared | lang) + log P(suffix | lang) + log prior
    of the host. The tables behind the last three are grouped sums of the texts'
    own posteriors. The host's prior is its other rows' sums, smoothed towards its
    domain's shares, which are smoothed towards those of all rows. A value that is
    empty or never seen with a language says nothing against it beyond the smoothing.

    Null and empty texts rest on the other evidence; rows without any take the
    commonest language. Repeated rows give repeated rows, an empty table an empty
    one. Without a language in the model, lang is null.
    """
    n = len(model.languages)
    if not n:
        return evidence.select("id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"))
    scored = _likelihoods(evidence, model)
    posterior = _normal([F.col(f"t{i}") for i in range(n)])
    scored = materialize(scored.withColumns({f"p{i}": p for i, p in enumerate(posterior)}), "scored")
    everything = scored.agg(*(F.sum(f"p{i}").alias(f"a{i}") for i in range(n)))
    total = [float(x or 0.0) + 1.0 for x in everything.first()]
    share = [x / sum(total) for x in total]

    def smooth(prefix, above, less=None):
        own = [F.col(f"{prefix}{i}") - (F.col(f"{less}{i}") if less else F.lit(0.0)) for i in range(n)]
        own = [F.greatest(x, F.lit(0.0)) for x in own]
        size = sum(own[1:], own[0])
        return [(x + SMOOTHING * p) / (size + SMOOTHING) for x, p in zip(own, above, strict=True)]

    domains = _sums(scored, "domain", n, "d")
    rates = smooth("d", [F.lit(s) for s in share])
    domains = domains.select("domain", *(r.alias(f"r{i}") for i, r in enumerate(rates)))
    hosts = scored.groupBy("host", "domain").agg(*(F.sum(f"p{i}").alias(f"h{i}") for i in range(n)))
    hosts = materialize(hosts.join(domains, "domain").drop("domain"), "hosts")
    out = scored.join(hosts, "host")
    logs = [
        F.col(f"t{i}") + F.log(p)
        for i, p in enumerate(smooth("h", [F.col(f"r{i}") for i in range(n)], less="p"))
    ]
    for key in ("declared", "suffix"):
        seen = materialize(_sums(scored.where(F.col(key) != ""), key, n, key[0] + "_"), key)
        out = out.join(seen, key, "left")
        for i in range(n):
            likely = (F.col(f"{key[0]}_{i}") + SMOOTHING * share[i]) / total[i]
            logs[i] = logs[i] + F.coalesce(F.log(likely), F.lit(0.0))
    found = F.array(*_normal(logs))
    best = F.array_max(found)
    lang = F.element_at(F.array(*map(F.lit, model.languages)), F.array_position(found, best).cast("int"))
    return out.select("id", lang.alias("lang"), best.alias("confidence"))
