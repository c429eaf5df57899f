"""Quality classifier on learned subword embeddings: averaged vectors, softmax, plain SGD in numpy."""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandcast.llm.common import arrow, held_out, labelled_sample, slices

GRAMS = (3, 4)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def features(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every word and character n-gram of the texts, and the text of each.

    A window of three words that its text has had before adds one common bucket.
    n-grams may touch the border of a word but not cross it. Words are hashed by
    the sum of their characters times powers of an odd number, modulo 2^64.
    """
    codes = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    owner = np.append(owner, max(len(texts) - 1, 0))[: len(codes)]
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    value = np.where(space, np.uint32(32), codes).astype(np.uint64)
    value = (value + np.uint64(1)) * _MIX
    value ^= value >> np.uint64(31)
    buckets, owners = [], []
    for n in GRAMS:
        hashed = np.full(len(codes) - n + 1, np.uint64(n), dtype=np.uint64)
        for k in range(n):
            hashed = hashed * _STEP + value[k : k + len(hashed)]
        inner = np.zeros(len(hashed), dtype=bool)
        for k in range(1, n - 1):
            inner |= space[k : k + len(hashed)]
        whole = ~inner & (owner[: len(hashed)] == owner[n - 1 :]) & ~(space[: len(hashed)] & space[n - 1 :])
        buckets.append(hashed[whole])
        owners.append(owner[: len(hashed)][whole])
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if len(start):
        first = np.zeros(len(codes), dtype=np.int64)
        first[start] = start
        at = np.arange(len(codes)) - np.maximum.accumulate(first)
        term = np.where(space, np.uint64(0), value * _POWERS[at & 255])
        word, whose = np.add.reduceat(term, start), owner[start]
        buckets.append(word)
        owners.append(whose)
        again = whose[:-2][_seen_before(word, whose)] if len(word) > 2 else whose[:0]
        buckets.append(np.full(len(again), AGAIN))
        owners.append(again)
    found, whose = np.concatenate(buckets), np.concatenate(owners)
    found = ((found ^ (found >> np.uint64(29))) * _MIX) >> np.uint64(64 - bits)
    return found.astype(np.int32), whose


#: Stands for a window of words that the text has had before.
AGAIN = np.uint64(0xA0761D6478BD642F)


def _seen_before(word: np.ndarray, whose: np.ndarray) -> np.ndarray:
    """For each window of three words, whether its text has had it before."""
    window = ((word[:-2] * _STEP + word[1:-1]) * _STEP + word[2:]) * _STEP + whose[:-2].astype(np.uint64)
    first = np.ones(len(window), dtype=bool)
    first[np.unique(window, return_index=True)[1]] = False
    return first & (whose[:-2] == whose[2:])


_POWERS = np.multiply.accumulate(np.full(256, _STEP, dtype=np.uint64))


@dataclass
class Model:
    """`vectors` by bucket, `output` by class; `weight` is what a bucket adds to the log odds of class 1."""

    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    @property
    def weight(self) -> np.ndarray:
        return (self.vectors @ (self.output[1] - self.output[0])).astype(np.float64)

    @property
    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


def train(rows, labels, bits: int, width: int, epochs: int, rate: float, seed: int = 1) -> Model:
    """Stochastic gradient descent over single documents, the rate falling to zero.

    `rows` are (buckets, shares) of each document; a document's vector is the sum
    of its buckets' vectors times their shares. Features that most documents have
    would drown in the average, so steps are scaled by the norm of the shares.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / width, 1 / width, (1 << bits, width)).astype(np.float32)
    output, bias = np.zeros((2, width), dtype=np.float32), np.zeros(2, dtype=np.float32)
    total, step = epochs * len(rows), 0
    target = np.eye(2, dtype=np.float32)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            buckets, shares = rows[i]
            now = np.float32(rate * (1 - step / total))
            step += 1
            own = vectors[buckets]
            hidden = shares @ own
            logit = output @ hidden + bias
            odds = np.exp(logit - logit.max())
            error = target[labels[i]] - odds / odds.sum()
            back = error @ output
            output += now * np.outer(error, hidden)
            bias += now * np.float32(0.1) * error
            vectors[buckets] = own + np.outer(now * shares / max(float(shares @ shares), 1e-6), back) * np.float32(0.2)
    return Model(vectors, output, bias)


COUNTED = "buckets array<int>, counts array<int>, label int"


def fit(
    docs: DataFrame, labels: DataFrame, rows: int = 4_000, bits: int = 16, width: int = 8, epochs: int = 5, rate: float = 0.5
) -> Model | None:
    """A model of `quality`, trained on at most `rows` labelled documents, whole texts.

    Features are counted in the tasks; the driver gets the counts of the sample,
    which `rows` bounds, and trains. None without labels of both kinds.
    """
    sample = labelled_sample(docs, labels, "quality", rows).withColumn("label", F.col("label").cast("int"))

    def count(batches):
        for batch in batches:
            texts, known = batch.column("text").to_pylist(), batch.column("label").to_pylist()
            for a, b in slices(texts, 1_000_000):
                found, whose = features(texts[a:b], bits)
                cut = np.searchsorted(whose[(order := np.argsort(whose, kind="stable"))], np.arange(b - a + 1))
                parts = [np.unique(found[order[cut[i] : cut[i + 1]]], return_counts=True) for i in range(b - a)]
                yield arrow(COUNTED, [x for x, _ in parts], [n.astype(np.int32) for _, n in parts], known[a:b])

    got = sample.mapInArrow(count, COUNTED).toArrow()
    y = np.array(got.column("label").to_pylist(), dtype=np.int64)
    if len(set(y.tolist())) < 2:
        return None
    x = []
    for buckets, counts in zip(got.column("buckets"), got.column("counts"), strict=True):
        n = counts.values.to_numpy().astype(np.float32)
        x.append((buckets.values.to_numpy(), n / max(n.sum(), 1)))
    return train(x, (y > 0).astype(int), bits, width, epochs, rate)


SCORED = "doc_id bigint, score double"


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, score) of every whole text; score is the softmax output of class 1.

    The average is linear, so a document's log odds are the mean of its buckets'
    weights. Null and empty texts have no features and get the bias alone; without
    a model every score is 0.5. Repeated rows give repeated rows, an empty table an
    empty one; other columns are left out.
    """
    weight = model.weight if model else np.zeros(2)
    offset = model.offset if model else 0.0
    bits = int(np.log2(len(weight)))

    def judge(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = batch.column("doc_id")
            for a, b in slices(texts, 1_000_000):
                found, whose = features(texts[a:b], bits)
                total = np.bincount(whose, weight[found], b - a)
                n = np.bincount(whose, minlength=b - a)
                odds = np.clip(total / np.maximum(n, 1) + offset, -30, 30)
                yield arrow(SCORED, ids[a:b], 1 / (1 + np.exp(-odds)))

    scored = docs.select("doc_id", "text").mapInArrow(judge, SCORED)
    return scored.withColumn("held_out", held_out(F.col("doc_id")))
