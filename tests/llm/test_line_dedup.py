"""Common lines against a plain version; the perfect hash against a dictionary."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandcast.llm import common, line_dedup
from demandcast.llm.perfect_hash import LineIndex
from tests.llm.test_llm import ODD, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def spark(request):
    session = request.getfixturevalue("spark")
    common.workers_find_package(session)
    return session


def plain(rows, least=5, chars=40):
    """Expected rows of (doc_id, text) pairs."""

    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    holders = defaultdict(set)
    for at, (doc, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            if len(key(line)) >= chars:
                holders[key(line)].add((at, doc))
    owner = {}
    for k, held in holders.items():
        known = [doc for _, doc in held if doc is not None]
        if len(held) >= least and known:
            owner[k] = max(known)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if owner.get(key(x), doc) == doc]
        out.append((doc, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def check(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = line_dedup.drop_common_lines(docs, **options).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows, **options)


LONG = "A line that is certainly longer than forty code points, É."


def test_common_lines_stay_in_the_greatest_id_alone(spark):
    rows = [(i, f"own {i}\n  {LONG if i % 2 else LONG.lower().replace('é', 'É')} \t\nend\n{LONG}") for i in range(7)]
    rows += [(None, LONG), (3, LONG + "\n"), (3, LONG + "\n"), (99, None), (98, ""), (97, "\n\n")]
    check(spark, rows)


def test_borders_of_length_and_support(spark):
    rows = []
    for i in range(6):
        lines = ["é" * 40, "é" * 39, "x" * 40, "x" * 39, " " * 50, "\x0b" + "y" * 40 + "\x1c"]
        lines += [f"{'z' * 45}{k}" for k in range(6) if i < k]  # k of them hold line k
        rows.append((i, "\r\n".join(lines)))
    check(spark, rows)
    check(spark, rows, least=2, chars=1)


def test_lines_of_null_ids_alone_stay(spark):
    check(spark, [(None, LONG)] * 6 + [(1, "x")])


def test_random_texts(spark):
    draw = random.Random(4)
    lines = [f"line number {k} of a list that many documents quote at length" for k in range(60)]
    rows = [(draw.choice([None, *range(150)]), "\n".join(draw.choices(lines, k=draw.randint(0, 9)))) for _ in range(300)]
    check(spark, rows)


def test_odd_texts_clashing_columns_and_empty_tables(spark):
    docs = documents(spark, ODD)
    for name in ("row", "page", "drops", "shard", "digests", "n_lines"):
        docs = docs.withColumn(name, F.lit("x"))
    got = line_dedup.drop_common_lines(docs)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_text"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(list(enumerate(ODD)))
    assert line_dedup.drop_common_lines(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        line_dedup.drop_common_lines(docs, least=1)


def test_one_line_in_every_document_over_many_pages(spark):
    docs = spark.range(0, 3000, 1, 6).select(F.col("id").alias("doc_id"), F.concat(F.lit(LONG + "\n"), F.col("id")).alias("text"))
    got = line_dedup.drop_common_lines(docs)
    assert got.agg(F.sum("n_dropped")).first()[0] == 2999
    assert [r.doc_id for r in got.where("n_dropped = 0").collect()] == [2999]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_perfect_hash_finds_its_keys_and_no_others(n):
    rng = np.random.default_rng(n)
    one, two = rng.integers(0, 2**63, (2, n), dtype=np.uint64)
    one[: n // 2] = one[0] if n else 0  # equal first halves
    counts, owners = rng.integers(2, 2**40, n), rng.integers(-9, 9, n)
    index = LineIndex.from_bytes(LineIndex.build(one, two, counts, owners).to_bytes())
    slots = index.slots(one, two)
    assert sorted(slots.tolist()) == list(range(n))
    assert index.counts[slots].tolist() == np.minimum(counts, 2**32 - 1).tolist()
    assert index.owners[slots].tolist() == owners.tolist()
    other = rng.integers(0, 2**63, (2, 5000), dtype=np.uint64)
    assert (index.slots(*other) == -1).all()
    if n == 5000:
        assert len(index.bits) * 64 < 6 * n
