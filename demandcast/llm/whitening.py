"""Whitening of embeddings by the leading components of their covariance."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandcast.llm.common import arrow
from demandcast.llm.spectral import EPS, eigenvectors
from demandcast.session import materialize

#: A vector enters as whole numbers, floor(SCALE * entry); entries up to LIMIT / SCALE are taken.
SCALE, LIMIT = 256, 2**40
PACKED = "x binary, size int, rows bigint"
SUMS = "place int, total bigint"
CELLS = "cell int, total double"
WHITE = "vec_id bigint, deviation bigint, whitened array<double>"


def whole_numbers(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of the usable vectors of a batch: their places, and floor(SCALE * entry) as longs."""
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    entries = vectors.flatten()
    flat = entries.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    scaled = np.floor(SCALE * flat)
    bad = ~(np.abs(scaled) < LIMIT)
    first = np.cumsum(sizes) - sizes
    wrong = np.append(0, np.cumsum(bad))
    usable = (wrong[first + sizes] == wrong[first]) & (sizes > 0)
    out = {}
    for size in np.unique(sizes[usable]).tolist():
        rows = np.flatnonzero(usable & (sizes == size))
        out[size] = rows, scaled[first[rows, None] + np.arange(size)].astype(np.int64)
    return out


def _pack(x: np.ndarray) -> list[bytes]:
    """Bytes that equal vectors have in common, in as few bytes an entry as the vector needs."""
    top = np.abs(x).max(axis=1)
    out: list[bytes] = [b""] * len(x)
    for least, limit, kind in ((0, 2**7, "<i1"), (2**7, 2**15, "<i2"), (2**15, 2**31, "<i4"), (2**31, 2**63, "<i8")):
        rows = np.flatnonzero((top >= least) & (top < limit))
        for i, row in zip(rows.tolist(), x[rows].astype(kind), strict=True):
            out[i] = row.tobytes()
    return out


def _unpack(packed: pa.Array, size: int) -> np.ndarray:
    out = np.empty((len(packed), size), np.int64)
    for i, data in enumerate(packed.to_pylist()):
        out[i] = np.frombuffer(data, f"<i{len(data) // size}")
    return out


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """(x, size, rows): each distinct vector of whole numbers once, with the number of its rows."""

    def pack(batches):
        for batch in batches:
            for size, (_, x) in whole_numbers(batch.column(0)).items():
                x, count = np.unique(x, axis=0, return_counts=True)
                yield arrow(PACKED, _pack(x), [size] * len(x), count)

    return rows.select("embedding").mapInArrow(pack, PACKED).groupBy("x", "size").agg(F.sum("rows").alias("rows"))


@dataclass
class Whitening:
    """What a corpus of vectors says: `n` distinct ones, their sums, and components by falling eigenvalue."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def size(self) -> int:
        return len(self.sums)

    @property
    def usable(self) -> np.ndarray:
        """Components whose eigenvalue is more than rounding."""
        return self.values > self.size * EPS * self.values.max(initial=0.0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return x - np.array([s / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Projections over the root of the eigenvalue; NaN for components that aren't usable."""
        scale = np.where(self.usable, np.sqrt(np.where(self.usable, self.values, 1.0)), np.nan)
        return self.centred(x) @ (self.vectors / scale)

    def deviation(self, x: np.ndarray) -> list:
        """The exact sum of (n * x - S)**2 of each vector; None where a long can't hold it."""
        about = ((self.centred(x) * self.n) ** 2).sum(axis=1)
        wrap = np.array([(s + 2**63) % 2**64 - 2**63 for s in self.sums], np.int64)
        # Modulo 2**64, which is exact wherever the sum fits.
        exact = ((x * np.int64(self.n) - wrap) ** 2).sum(axis=1).tolist()
        for i in np.flatnonzero(about > 9e18).tolist():
            total = sum((self.n * v - s) ** 2 for v, s in zip(x[i].tolist(), self.sums, strict=True))
            exact[i] = total if total < 2**63 else None
        return exact


def fit(rows: DataFrame, components: int = 4) -> tuple[Whitening | None, DataFrame]:
    """The whitening of `rows` (embedding), and the distinct vectors that it was learned from.

    Three passes over the distinct vectors: count and exact sums, then the covariance
    of centred values, of which each task gives one triangle. Only sums by place
    and by pair of places reach the driver, whose size is the vectors' length squared
    whatever the number of rows. There, polar decompositions part the spectrum into
    components. None if no vector is usable.

    Vectors that are null, empty, hold null or non-finite entries, or entries of 2**32 and
    more, are left out; of several lengths the one with most rows (the longest of equal ones) counts.
    """
    kept = materialize(distinct_vectors(rows), "vectors")
    by_size = kept.groupBy("size").agg(F.sum("rows").alias("rows")).orderBy(F.desc("rows"), F.desc("size"))
    common = by_size.first()
    if common is None:
        return None, kept
    size = common["size"]
    kept = kept.where(F.col("size") == size)

    def add(batches):
        total, n = np.zeros(size, object), 0
        for batch in batches:
            x = _unpack(batch.column(0), size)
            total += x.sum(axis=0)
            n += len(x)
            if n >= 2**20:  # entries are under 2**40, so sums up to here fit a long
                yield arrow(SUMS, range(size + 1), [*total.tolist(), n])
                total, n = np.zeros(size, object), 0
        if n:
            yield arrow(SUMS, range(size + 1), [*total.tolist(), n])

    totals = kept.select("x").mapInArrow(add, SUMS).groupBy("place")
    found = {r["place"]: int(r["total"]) for r in totals.agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total")).collect()}
    n, sums = found[size], [found[k] for k in range(size)]
    known = Whitening(n, sums, np.zeros(0), np.zeros((size, 0)), 0.0)
    above = np.triu_indices(size)

    def multiply(batches):
        total, seen = np.zeros((size, size)), False
        for batch in batches:
            y = known.centred(_unpack(batch.column(0), size))
            total += y.T @ y
            seen = True
        if seen:
            yield arrow(CELLS, range(len(above[0])), total[above])

    cells = kept.select("x").mapInArrow(multiply, CELLS).groupBy("cell").agg(F.sum("total").alias("total"))
    covariance = np.zeros((size, size))
    for cell, total in cells.collect():
        i, j = above[0][cell], above[1][cell]
        covariance[i, j] = covariance[j, i] = total / n
    values, vectors = eigenvectors(covariance)
    values = np.maximum(values, 0.0)
    top = min(components, size)
    return Whitening(n, sums, values[:top], vectors[:, :top], float(np.trace(covariance))), kept


def identity_error(vectors: DataFrame, model: Whitening) -> float | None:
    """The largest absolute entry of the whitened vectors' covariance less the identity; None without components."""
    usable = np.flatnonzero(model.usable)
    if not len(usable):
        return None
    top = len(usable)
    sent = vectors.sparkSession.sparkContext.broadcast(model)

    def multiply(batches):
        total, plain = np.zeros((top, top)), np.zeros(top)
        for batch in batches:
            w = sent.value.whitened(_unpack(batch.column(0), sent.value.size))[:, usable]
            total += w.T @ w
            plain += w.sum(axis=0)
        yield arrow(CELLS, range(top * top + top), [*total.ravel(), *plain])

    cells = vectors.select("x").mapInArrow(multiply, CELLS).groupBy("cell").agg(F.sum("total").alias("total"))
    found = np.zeros(top * top + top)
    for cell, total in cells.collect():
        found[cell] = total / model.n
    mean = found[top * top :]
    covariance = found[: top * top].reshape(top, top) - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(top)).max())


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened) of every usable row of `rows` (vec_id, embedding) with the model's length.

    `whitened` has one entry for each component, null for components without
    variance; `deviation` is the exact sum of (n * x - S)**2, null where a long can't hold it.
    Unusable vectors (see fit) have no row. Repeated rows give repeated rows, null ids
    stay null, an empty table gives an empty one, other columns are left out. One
    pass; the mean and the components, of the vectors' length, are broadcast.
    """
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def project(batches):
        for batch in batches:
            found = whole_numbers(batch.column(1)).get(sent.value.size)
            if found is None:
                continue
            places, x = found
            white = [[None if v != v else v for v in row] for row in sent.value.whitened(x).tolist()]
            yield arrow(WHITE, batch.column(0).take(pa.array(places)), sent.value.deviation(x), white)

    return rows.select("vec_id", "embedding").mapInArrow(project, WHITE)
