"""Whitening against numpy's eigenvectors and exact integers; spectral divide and conquer on hard spectra."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandcast.llm import common, queries, whitening
from demandcast.llm.spectral import eigenvectors, polar_factor

VECTORS = "vec_id bigint, embedding array<float>, label int"


@pytest.fixture(scope="module")
def spark(request):
    session = request.getfixturevalue("spark")
    common.workers_find_package(session)
    return session


def held(matrix):
    """Checks values, orthonormality and residuals; returns the vectors."""
    values, vectors = eigenvectors(matrix)
    size = max(np.linalg.norm(matrix), 1e-300)
    n = len(matrix)
    assert np.abs(values - np.linalg.eigvalsh(matrix)[::-1]).max(initial=0) <= 1e-14 * n * size
    assert np.abs(vectors.T @ vectors - np.eye(n)).max(initial=0) < 1e-14 * max(n, 4)
    assert np.abs(matrix @ vectors - vectors * values).max(initial=0) <= 1e-14 * n * size
    return vectors


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 17, 64, 130])
def test_components_of_random_matrices(n):
    rng = np.random.default_rng(n)
    g = rng.normal(size=(n, n))
    found, known = held(g @ g.T), np.linalg.eigh(g @ g.T)[1][:, ::-1]
    assert np.abs(np.abs((found * known).sum(axis=0)) - 1).max(initial=0) < 1e-9
    held((g + g.T) / 2)


def test_components_of_hard_spectra():
    rng = np.random.default_rng(5)
    turn = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    for values in (
        np.r_[np.full(10, 5.0), np.ones(30)],  # two values
        10.0 ** -np.arange(40),  # graded
        1 + 1e-10 * np.arange(40),  # close together
        np.r_[3.0, 2.0, np.zeros(38)],  # low rank
        np.r_[np.arange(20), -np.arange(20)],  # both signs, 0 among them
    ):
        held(turn @ np.diag(values) @ turn.T)
    held(np.eye(6) * 3)
    held(np.zeros((5, 5)))
    held(np.ones((6, 6)))
    held(np.kron(np.eye(3), np.array([[0.0, 1.0], [1.0, 0.0]])))


def test_polar_factor_is_the_sign_of_a_symmetric_matrix():
    rng = np.random.default_rng(2)
    turn = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    values = np.r_[1e-9, -1e-6, np.linspace(-3, 5, 10)]
    got = polar_factor(turn @ np.diag(values) @ turn.T)
    assert np.abs(got - turn @ np.diag(np.sign(values)) @ turn.T).max() < 1e-6


def plain(rows, components=4):
    """{vec_id: (n, deviation, |whitened|, explained)} by exact integers and numpy."""
    usable = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    numbers = [(i, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v in usable]
    fitted = sorted({x for _, x in numbers})
    n, sums = len(fitted), [sum(c) for c in zip(*fitted, strict=True)]
    centred = np.array([[float(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in fitted])
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = []
    for i, x in numbers:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        y = np.array([a - s / n for a, s in zip(x, sums, strict=True)])
        out.append((i, n, deviation, np.abs(y @ vectors) / np.sqrt(values), values / np.trace(covariance)))
    return out


def random_rows(n=300, size=6):
    rng = np.random.default_rng(1)
    turn = rng.normal(size=(size, size)) * np.arange(1, size + 1)
    rows = [(i, (rng.normal(size=size) @ turn).tolist()) for i in range(n)]
    return rows + [(500 + i, rows[7][1]) for i in range(40)]


def test_whitening_equals_the_plain_version(spark, tmp_path):
    rows = random_rows()
    odd = [(901, None), (902, []), (903, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (904, [float("nan")] * 6), (905, [float("inf")] * 6)]
    odd += [(7, rows[7][1]), (7, rows[7][1])]
    spark.createDataFrame([(*r, 1) for r in rows + odd], VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op11_embedding_whitening(spark, str(tmp_path)).collect()
    expected = plain(rows + odd)
    assert len(got) == 4 * len(expected)
    by_id = {}
    for r in got:
        by_id.setdefault((r.vec_id, r.component), []).append(r)
    for i, n, deviation, white, explained in expected:
        for k in range(4):
            for r in by_id[i, k + 1]:
                assert (r.n, r.deviation) == (n, deviation) and r.identity_error < 1e-9
                assert abs(abs(r.whitened) - white[k]) < 1e-7 and abs(r.explained / explained[k] - 1) < 1e-9
    assert n == 300
    ones = [r.whitened for r in got if r.component == 1 and r.vec_id < 300]
    assert min(ones) < 0 < max(ones)


def test_few_rows_short_vectors_several_lengths_and_empty_tables(spark):
    def run(rows):
        docs = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).withColumn("x", F.lit("x")).withColumn("size", F.lit(1))
        model, vectors = whitening.fit(docs)
        found = sorted(map(tuple, whitening.whiten(docs, model).collect()), key=str) if model else []
        return model, found, whitening.identity_error(vectors, model) if model else None

    assert run([(1, None)]) == (None, [], None)
    assert run([]) == (None, [], None)
    model, found, error = run([(1, [1.0, 2.0]), (2, [1.0, 2.0])])  # no variance
    assert model.n == 1 and error is None
    assert found == [(1, 0, [None, None]), (2, 0, [None, None])]
    model, found, error = run([(1, [1.0]), (2, [2.0]), (3, [1.0, 2.0]), (None, [3.0]), (4, [])])
    assert model.n == 3 and error < 1e-12 and [f[0] for f in found] == [1, 2, None]
    assert [f[1] for f in found] == [768**2, 0, 768**2]


def test_deviations_beyond_a_long_are_null(spark):
    rows = [(i, [float(i) * 2.0**20, 0.0]) for i in range(1000)] + [(2000, [1e30, 0.0])]
    docs = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    model, _ = whitening.fit(docs)
    found = {r.vec_id: r.deviation for r in whitening.whiten(docs, model).collect()}
    total = sum(i * 2**28 for i in range(1000))
    for i in range(1000):
        exact = (1000 * i * 2**28 - total) ** 2
        assert found[i] == (exact if exact < 2**63 else None)
    assert 2000 not in found and None in found.values()
