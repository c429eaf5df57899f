"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandcast.llm import common, periodic_runs, queries
from tests.llm.test_llm import ODD, documents

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def spark(request):
    session = request.getfixturevalue("spark")
    common.workers_find_package(session)
    return session


def plain_runs(words):
    """(start, length, period) of every run, by start, then period."""
    ids = {}
    codes = np.array([ids.setdefault(w, len(ids)) for w in words])
    found = {}
    for q in range(1, len(codes) // 3 + 1):
        same = np.concatenate([[0], codes[q:] == codes[:-q], [0]]).astype(int)
        edges = np.flatnonzero(np.diff(same))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a + q >= max(24, 3 * q):
                found.setdefault((a, b - a + q), q)  # the smallest period of a stretch comes first
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain(text):
    """Expected columns after doc_id."""
    words = WORDS.findall(text or "")
    runs = plain_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None, None, None)
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return len(words), len(runs), *best, *(list(x) for x in (zip(*runs) if runs else ([], [], []))), kept


def check(docs, rows):
    got = [tuple(r) for r in periodic_runs.collapse_runs(docs).collect()]
    assert sorted(got, key=str) == sorted(((d, *plain(t)) for d, t in rows), key=str)


def nested(draw):
    """Words with planted stretches of many periods, near octave borders too."""
    n, k = draw.choice([0, 23, 24, 25, 60, 400, 1500]), draw.choice([1, 2, 3, 2000])
    words = [str(draw.randrange(k)) for _ in range(n)]
    for _ in range(draw.randrange(4) if n >= 24 else 0):
        p = draw.choice([1, 2, 7, 8, 9, 15, 16, 17, 31, 32, 33, 64, max(1, n // 3), draw.randrange(1, n)])
        a = draw.randrange(n)
        for i in range(a + p, min(n, a + int(p * draw.choice([2.5, 2.99, 3, 3.3, 9])) + draw.choice([0, 1, 23]))):
            words[i] = words[i - p]
    return " ".join(words)


def test_random_nested_runs(spark):
    draw = random.Random(11)
    rows = [(i, nested(draw)) for i in range(400)]
    assert sum(len(plain_runs(t.split())) for _, t in rows) > 100
    check(spark.createDataFrame(rows, "doc_id bigint, text string"), rows)


def test_every_short_word_over_two_letters(spark):
    rows = [(i, " ".join(f"{i:08b}" * 4)) for i in range(256)]
    check(spark.createDataFrame(rows, "doc_id bigint, text string"), rows)


def test_only_ascii_space_parts_words(spark):
    rows = [(1, "a\x0bb\x0c" * 12 + "\x1c"), (2, "a\xa0b " * 24), (3, "é ü\n" * 30), (4, "A a " * 13)]
    check(spark.createDataFrame(rows, "doc_id bigint, text string"), rows)


def test_repeated_and_null_ids_odd_texts_clashing_columns_empty_table(spark):
    texts = [*ODD, *ODD, "x y " * 40]
    docs = documents(spark, texts)
    ids = [None if i % 4 == 0 else i % 3 for i in range(len(texts))]
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") % 3))
    for name in ("node", "octave", "starts", "period", "codes", "runs"):
        docs = docs.withColumn(name, F.lit("x"))
    check(docs, list(zip(ids, texts, strict=True)))
    assert periodic_runs.collapse_runs(docs.limit(0)).count() == 0


def test_a_very_long_repetitive_text_is_quick(spark):
    draw = random.Random(3)
    block = [f"w{draw.randrange(900)}" for _ in range(30_011)]
    texts = [" ".join(block * 5), "same " * 60_000]
    start = time.perf_counter()
    got = periodic_runs.collapse_runs(documents(spark, texts)).orderBy("doc_id").collect()
    assert [(r.start, r.length, r.period, r.n_runs) for r in got] == [(0, 150_055, 30_011, 1), (0, 60_000, 1, 1)]
    assert got[0].collapsed_text.split() == block and got[1].collapsed_text == "same"
    assert time.perf_counter() - start < 60


def test_planted_repeats_and_digests_of_the_query(spark, tmp_path):
    draw = random.Random(8)
    texts = [" ".join(str(draw.randrange(500)) for _ in range(draw.choice([0, 1, 2, 80, 300]))) for _ in range(120)] + [None]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()}
    planted = 0
    for doc, text in enumerate(texts):
        words, h = WORDS.findall(text or ""), zlib.crc32(str(doc).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        _, count, start, length, period, *runs, kept = plain(" ".join(words))
        planted += count
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in zip(*runs, strict=True))
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)]
        milli = 1000 * length // period if count else None
        assert got[doc] == (count, start, length, period, milli, *digests)
    assert planted
