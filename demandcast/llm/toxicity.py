"""Toxicity from a weighted lexicon, matched after folding look-alike characters."""

import re
from collections import Counter
from dataclasses import dataclass
from math import exp, log, log1p, sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandcast.llm.common import arrow, held_out, labelled_sample

# Look-alikes of Latin letters in other scripts, then digits and signs that stand for letters.
LOOKALIKE = dict(zip("аеорсухіјѕһԁԛԝьαεικνορτυχ", "aeopcyxijshdqwbaeiknoptux", strict=True))
SUBSTITUTE = dict(zip("0134578@$€", "oieastbase", strict=True))
INVISIBLE = "​‌‍⁠﻿­"
WIDE = {chr(0xFF01 + i): chr(0x21 + i).lower() for i in range(94)}
FOLD = str.maketrans({**WIDE, **LOOKALIKE, **SUBSTITUTE, **{c: None for c in INVISIBLE}, "|": "l", "!": "i"})
BREAKS = re.compile(r"[\W_]+")
#: Signs at the end of a word are punctuation, not letters.
TAIL = re.compile(r"[!|]+(?=\s|$)")

#: Phrases in which a listed word is harmless.
EXCEPTIONS = (
    "trash can",
    "trash bin",
    "trash bag",
    "pond scum",
    "soap scum",
    "clown fish",
    "class clown",
    "sore loser",
    "stupid simple",
    "not stupid",
    "not worthless",
    "not an idiot",
    "useful idiot",
)
STEMS = range(4, 9)


def fold(text: str) -> str:
    """Lower case, look-alikes and substituted digits as letters, one space around each word."""
    words = BREAKS.sub(" ", TAIL.sub(" ", text.lower()).translate(FOLD)).strip()
    return f" {words} " if words else " "


@dataclass
class Lexicon:
    """Weights of folded entries. ` word ` is a whole word, ` stem` starts one."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    coefficients: tuple[float, float, float] = (-4.0, 1.0, 1.0)

    def automaton(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for phrase in self.exceptions:
            folded = fold(phrase)
            machine.add_word(folded, (len(folded), None))
        for entry, weight in self.weights.items():
            if entry not in machine:
                machine.add_word(entry, (len(entry), weight))
        if len(machine):
            machine.make_automaton()
        return machine


def matched(machine, folded: str) -> tuple[float, int]:
    """The sum of the weights found in a folded text and the number of its words.

    A word counts once, with its greatest weight; words inside an exception
    phrase don't count.
    """
    words = folded.count(" ") - 1
    if not len(machine) or words < 1:
        return 0.0, max(words, 0)
    best: dict[int, float] = {}
    safe: list[tuple[int, int]] = []
    for end, (size, weight) in machine.iter(folded):
        start = end - size + 1
        if weight is None:
            safe.append((start, end))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    for a, b in safe:
        for start in [s for s in best if a <= s < b]:
            del best[start]
    return sum(best.values()), words


def evidence(total: float, words: int) -> tuple[float, float]:
    """What a score is made of: the sum, and the sum for each hundred words, both damped."""
    return log1p(total), log1p(100.0 * total / max(words, 20))


def probability(coefficients, total: float, words: int) -> float:
    x = sum(c * v for c, v in zip(coefficients, (1.0, *evidence(total, words)), strict=True))
    return 1.0 / (1.0 + exp(-max(-30.0, min(30.0, x))))


def count_entries(sample: DataFrame) -> DataFrame:
    """(entry, toxic, clean): documents of `sample` (text, label) with each word and stem."""

    def count(batches):
        seen = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                words = set(fold(text).split())
                entries = {f" {w} " for w in words} | {" " + w[:n] for w in words for n in STEMS if len(w) > n}
                seen[1 if label else 0].update(entries)
        names = list(seen[0].keys() | seen[1].keys())
        yield arrow("entry string, toxic bigint, clean bigint", names, [seen[1][n] for n in names], [seen[0][n] for n in names])

    counted = sample.mapInArrow(count, "entry string, toxic bigint, clean bigint")
    return counted.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose(counts, toxic: int, clean: int, least_weight: float) -> dict[str, float]:
    """Weights from log odds; a stem replaces its longer forms unless they say clearly more."""
    found = {}
    for entry, pos, neg in counts:
        weight = log((pos + 0.5) / (toxic + 1)) - log((neg + 0.5) / (clean + 1))
        if weight >= least_weight and weight / sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5)) >= 2.5:
            found[entry] = (weight, pos)
    kept: dict[str, float] = {}
    for entry in sorted(found, key=len):
        word = entry.strip()
        shorter = [kept[" " + word[:n]] for n in range(min(STEMS), len(word)) if " " + word[:n] in kept]
        if not shorter or found[entry][0] > max(shorter) + 1.0:
            kept[entry] = found[entry][0]
    return kept


def fit(docs: DataFrame, labels: DataFrame, rows: int = 20_000, size: int = 2_000, least_weight: float = 2.5) -> Lexicon:
    """A lexicon and its scale, learned from at most `rows` labelled documents.

    Entries are counted by document in the tasks; the driver gets the `size`
    strongest, which at least one in a hundred toxic documents has, and for the
    scale two figures of each sampled document. Without labels of both kinds the
    lexicon is empty and every score is the same.
    """
    sample = labelled_sample(docs, labels, "toxic", rows)
    sizes = {bool(r["label"]): r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = sizes.get(True, 0), sizes.get(False, 0)
    if not toxic or not clean:
        return Lexicon({})
    odds = (F.col("toxic") + 0.5) / (F.col("clean") + 0.5)
    counts = count_entries(sample).where(F.col("toxic") >= max(2, toxic / 100)).where(odds * (clean + 1) / (toxic + 1) >= exp(least_weight))
    top = counts.orderBy(F.desc(odds), F.desc("toxic"), "entry").limit(size).collect()
    lexicon = Lexicon(choose([tuple(r) for r in top], toxic, clean, least_weight))

    def figures(batches):
        machine = lexicon.automaton()
        for batch in batches:
            found = [evidence(*matched(machine, fold(text))) for text in batch.column("text").to_pylist()]
            yield arrow("a double, b double, label int", [x[0] for x in found], [x[1] for x in found], batch.column("label"))

    rows_ = sample.withColumn("label", F.col("label").cast("int")).mapInArrow(figures, "a double, b double, label int").toPandas()
    lexicon.coefficients = logistic(rows_[["a", "b"]].to_numpy(), rows_["label"].to_numpy())
    return lexicon


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.5, steps: int = 50) -> tuple[float, ...]:
    """Logistic regression with an intercept by damped Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), penalty * np.eye(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


SCORED = "doc_id bigint, score double, matched double, n_words bigint"


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, held_out, score, matched, n_words) of every whole text.

    Null and empty texts have nothing matched and the least score. Repeated rows
    give repeated rows; an empty table gives an empty one; other columns are left
    out. Ids, languages and sources aren't read for a score.
    """

    def judge(batches):
        machine = lexicon.automaton()
        for batch in batches:
            found = [matched(machine, fold(text or "")) for text in batch.column("text").to_pylist()]
            scores = [probability(lexicon.coefficients, *x) for x in found]
            yield arrow(SCORED, batch.column("doc_id"), scores, [x[0] for x in found], [x[1] for x in found])

    scored = docs.select("doc_id", "text").mapInArrow(judge, SCORED)
    return scored.withColumn("held_out", held_out(F.col("doc_id")))
