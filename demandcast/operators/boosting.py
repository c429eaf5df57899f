"""Boosted regression trees on features that are binned once.

Histograms of gradients by (node, feature, bin) are added up in the tasks and merged by
feature; the driver sees one best split a node and holds trees, not rows. A search's models can grow in
tasks that have all rows, for some rounds at a time. Trees grow
leaf by leaf with penalised gains, or level by level with one split for a whole level.
"""

import heapq
import math
import pickle
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from demandcast.schema import FEATURES, SEED

#: Most bins of a feature; least and most rows of one task; rounds between two refreshes of the kept predictions.
BINS, FEW_ROWS, TASK_ROWS, REFRESH = 255, 100_000, 500_000, 10
#: Least sum of weights on either side of a split.
LEAST_WEIGHT = 1e-3
#: Sums on one side of borders that are made at once, and rows that walk down a tree at once.
AT_ONCE, WALKED = 1_000_000, 8_192
BINNED = "target double, bins binary, row_key bigint"


@dataclass(frozen=True)
class LeafWise:
    """Settings of trees that always split the leaf with the greatest gain next."""

    rounds: int = 40
    learning_rate: float = 0.1
    num_leaves: int = 31
    max_depth: int = 0  # 0: no limit
    min_data_in_leaf: int = 20
    lambda_l1: float = 0.0
    lambda_l2: float = 0.0
    min_gain_to_split: float = 0.0
    feature_fraction: float = 1.0
    bagging_fraction: float = 1.0
    bagging_freq: int = 0
    patience: int = 10
    seed: int = SEED


@dataclass(frozen=True)
class Symmetric:
    """Settings of trees with one split for each level (plain boosting, Bayesian row weights)."""

    rounds: int = 40
    learning_rate: float = 0.1
    depth: int = 6
    l2_leaf_reg: float = 3.0
    border_count: int = 254
    random_strength: float = 1.0
    bagging_temperature: float = 1.0
    patience: int = 10
    seed: int = SEED


@dataclass
class Tree:
    """Nodes as arrays; node 0 is the root. A leaf has feature -1. Rows with bin <= border go left."""

    feature: np.ndarray
    border: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row of `bins` (rows x features) ends in."""
        out = np.zeros(len(bins), np.int32)
        for a in range(0, len(bins), WALKED):
            some, ends = bins[a : a + WALKED], out[a : a + WALKED]
            node, rows = np.zeros(len(some), np.int32), np.arange(len(some))
            while len(rows):
                f = self.feature[node]
                inner = f >= 0
                if not inner.all():
                    ends[rows[~inner]] = node[~inner]
                    rows, node, f = rows[inner], node[inner], f[inner]
                node = np.where(some[rows, f] <= self.border[node], self.left[node], self.right[node])
        return out

    def __call__(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(bins)]


def feature_borders(rows: DataFrame, features, most: int = BINS - 1) -> list[np.ndarray]:
    """For each column ascending borders; a value's bin is the number of borders below it.

    Borders are quantiles from mergeable sketches of one pass, values of the data except
    the greatest. Columns must be free of nulls.
    """
    shares = [(k + 1) / (most + 1) for k in range(most)]
    # One aggregate by column, not one for each: the shares stand in the plan once, and sketches of many columns merge in many tasks.
    numbers = rows.select(F.posexplode(F.array(*[F.col(f).cast("double") for f in features])).alias("column", "number"))
    sketches = numbers.groupBy("column").agg(F.percentile_approx("number", shares, 2_000).alias("cuts"), F.max("number").alias("top"))
    found = {r.column: r for r in sketches.collect()}
    out = []
    for k in range(len(features)):
        values = np.unique(np.array((found[k].cuts if k in found else None) or [], float))
        out.append(values[values < found[k].top] if len(values) else values)
    return out


def bin_values(values: np.ndarray, borders: list[np.ndarray]) -> np.ndarray:
    """Bins (rows x features, one byte each) of a table of numbers."""
    out = np.empty(values.shape, np.uint8)
    for f, b in enumerate(borders):
        out[:, f] = np.searchsorted(b, values[:, f], "left")
    return out


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def bin_rows(rows: DataFrame, borders: list[np.ndarray], keep: tuple[str, ...] = ()) -> DataFrame:
    """(target, bins, row_key, *keep) of `rows` (target, features vector, *keep).

    `row_key` is a hash of the row's content, from which all sampling is drawn, so that it
    doesn't depend on order or partitions.
    """
    flat = rows.select("target", vector_to_array("features").alias("values"), *keep)
    flat = flat.withColumn("row_key", F.xxhash64("target", "values", *keep)).select("target", "values", "row_key", *keep)
    kinds = {name: flat.schema[name].dataType.simpleString() for name in keep}

    def convert(batches):
        for batch in batches:
            packed = bin_values(_matrix(batch.column(1), len(borders)), borders)
            columns = [batch.column(0), pa.array([r.tobytes() for r in packed], pa.binary()), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=["target", "bins", *batch.schema.names[2:]])

    return flat.mapInArrow(convert, ", ".join([BINNED, *(f"{n} {k}" for n, k in kinds.items())]))


def uniform(keys: np.ndarray, *salt: int) -> np.ndarray:
    """A number in (0, 1) for each key and salt."""
    x = keys.view(np.uint64) ^ np.uint64(np.random.default_rng(salt).integers(0, 1 << 63))
    for a, b in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(a))) * np.uint64(b)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def row_weights(spec, keys: np.ndarray, turn: int) -> np.ndarray | None:
    """Weights of training rows in a round; None where all are 1."""
    if isinstance(spec, Symmetric):
        if not spec.bagging_temperature:
            return None
        return (-np.log(uniform(keys, spec.seed, turn))) ** spec.bagging_temperature
    if not spec.bagging_freq or spec.bagging_fraction >= 1:
        return None
    return (uniform(keys, spec.seed, turn // spec.bagging_freq) < spec.bagging_fraction).astype(float)


def allowed_borders(spec, sizes: np.ndarray, turn: int) -> np.ndarray:
    """For each border of all features (one after the other) whether a tree of this round may split there."""
    if isinstance(spec, Symmetric):
        # Of more borders than wanted, evenly spaced ones.
        kept = []
        for n in sizes.tolist():
            mask = np.zeros(n, bool)
            mask[np.unique(np.linspace(0, n - 1, min(n, spec.border_count)).round().astype(int))] = True
            kept.append(mask)
        return np.concatenate(kept) if kept else np.zeros(0, bool)
    number = max(1, math.ceil(len(sizes) * spec.feature_fraction))
    chosen = np.random.default_rng((spec.seed, turn, 1)).permutation(len(sizes))[:number]
    return np.repeat(np.isin(np.arange(len(sizes)), chosen), sizes)


def split_gains(spec, left, right):
    """What each split (sums g, h, n of its sides, as arrays) gains over no split, and where it is allowed.

    Without n, sums are exact, a leaf-wise tree has h for it (its rows weigh 1), and a side of a symmetric one has rows as it has weight.
    """
    (gl, hl, *nl), (gr, hr, *nr) = left, right
    if isinstance(spec, Symmetric):
        l1, l2, least = 0.0, spec.l2_leaf_reg, 1
    else:
        l1, l2, least = spec.lambda_l1, spec.lambda_l2, max(1, spec.min_data_in_leaf)

    def score(g, h):
        over = np.maximum(np.abs(g) - l1, 0.0) if l1 else g
        return over * over / (h + l2 if l2 > 0 and not nl else np.maximum(h + l2, 1e-300))

    # Without n, sums have no rounding error: those of both sides are the same at every border.
    some = np.s_[..., :] if nl else np.s_[..., :1]
    gain = score(gl, hl) + score(gr, hr)
    gain -= score(gl[some] + gr[some], hl[some] + hr[some])
    weight = LEAST_WEIGHT if nl or isinstance(spec, Symmetric) else least
    fits = (hl >= weight) & (hr >= weight)
    if nl:
        fits &= (nl[0] >= least) & (nr[0] >= least)
    return gain, fits


def leaf_value(spec, g: float, h: float) -> float:
    l1, l2 = (0.0, spec.l2_leaf_reg) if isinstance(spec, Symmetric) else (spec.lambda_l1, spec.lambda_l2)
    pull = math.copysign(max(abs(g) - l1, 0.0), g)
    return -spec.learning_rate * pull / (h + l2) if h + l2 > 0 else 0.0


def best_splits(spec, sums: np.ndarray, sizes: np.ndarray, first: int, allowed: np.ndarray, noise: np.ndarray | None):
    """(node, feature, border, gain, g h n on the left, g h n in all) of each node from `sums` (nodes, 3, bins), the histograms g, h and n of some features.

    `sizes` are borders of those features, of which `first` is the first one's number;
    bins of a feature are one more. Symmetric trees get the same split for all nodes.
    `sums` are added up in place.
    """
    if not len(sizes) or not allowed.any():
        return []
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    running = np.cumsum(sums, axis=2, out=sums)
    before = np.where(starts > 0, running[:, :, starts - 1], 0.0)
    totals = running[:, :, ends[0] - 1]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    border = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = starts[owner] + border
    best, value, usable = np.zeros(len(sums), int), np.full(len(sums), -np.inf), False
    # Histograms of a deep level have hundreds of megabytes; what is made from them is made for some borders at a time.
    step = max(1, AT_ONCE // (3 * len(sums)))
    for a in range(0, len(owner), step):
        part = slice(a, a + step)
        left = running[:, :, place[part]] - before[:, :, owner[part]]
        right = totals[:, :, None] - left
        gain, fits = split_gains(spec, left.transpose(1, 0, 2), right.transpose(1, 0, 2))
        if isinstance(spec, Symmetric):
            # A border counts if it parts any node; nodes that it doesn't part gain nothing.
            shared = np.where(fits, gain, 0.0).sum(axis=0) + (noise[part] if noise is not None else 0.0)
            fits = allowed[part] & fits.any(axis=0)
            gain = np.where(fits, shared, -np.inf)[None]
            usable = usable or fits.any()
        else:
            gain = np.where(fits & allowed[part], gain, -np.inf)
        here = gain.argmax(axis=1)
        top = gain[np.arange(len(gain)), here]
        # The first of equal ones stays; as for argmax, no number is greater than NaN.
        better = ~np.isnan(value) & ~(top <= value)
        best, value = np.where(better, a + here, best), np.where(better, top, value)
    if isinstance(spec, Symmetric) and not usable:
        return []
    out = []
    for node, (k, v) in enumerate(zip(best.tolist(), value.tolist(), strict=True)):
        if isinstance(spec, Symmetric) or v > spec.min_gain_to_split:
            left = running[node, :, place[k]] - before[node, :, owner[k]]
            out.append((node, first + int(owner[k]), int(border[k]), v, *left.tolist(), *totals[node].tolist()))
    return out


@dataclass
class BoostedTrees:
    """A fitted model: the mean it starts from, its trees, and where features are cut."""

    base: float
    trees: list[Tree]
    borders: list[np.ndarray]
    column: str
    spec: object
    features: tuple[str, ...] = FEATURES
    #: Validation error of each round trained, empty without validation rows.
    curve: list[float] = field(default_factory=list)

    @property
    def rounds(self) -> int:
        return len(self.trees)

    def predict(self, values: np.ndarray) -> np.ndarray:
        bins, out = bin_values(values, self.borders), np.full(len(values), self.base)
        for tree in self.trees:
            out += tree(bins)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """Add the prediction of the `features` vector; only that column visits the Python workers."""
        sent = df.sparkSession.sparkContext.broadcast(replace(self, curve=[]))
        width = len(self.borders)

        @F.arrow_udf("double")
        def score(values: pa.Array) -> pa.Array:
            return pa.array(sent.value.predict(_matrix(values, width)))

        return df.withColumn(self.column, score(vector_to_array("features")))

    def nodes(self) -> list[tuple]:
        """(tree, node, feature, threshold, left, right, value, gain) of every node; a leaf has no feature."""
        out = []
        for t, tree in enumerate(self.trees):
            for k in range(len(tree.feature)):
                f = int(tree.feature[k])
                cut = (self.features[f], float(self.borders[f][tree.border[k]])) if f >= 0 else (None, None)
                sides = (int(tree.left[k]), int(tree.right[k])) if f >= 0 else (None, None)
                out.append((t, k, *cut, *sides, float(tree.value[k]), float(tree.gain[k])))
        return out

    def settings(self) -> dict:
        return asdict(self.spec)


@dataclass(frozen=True)
class Job:
    """One model to fit: rows with a lower `fold` train it, rows with that fold judge it, others are left out."""

    spec: object
    fold: int = 1


def _pack(batches):
    """Rows (target, bins, row_key, fold) in blocks, one pickled row for each batch."""
    for batch in batches:
        bins = b"".join(batch.column("bins").to_pylist())
        block = (bins, *(batch.column(c).to_numpy() for c in ("target", "row_key", "fold")))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], names=["block"])


class _Fits:
    """Models in the making over the same rows, in groups that different tasks work for.

    Blocks of rows are kept by the executors, with the predictions of the trees
    up to the last refresh; what is lost is computed again from the stored rows and
    the trees. A pass is one job over these blocks.
    """

    def __init__(self, rows: DataFrame, jobs: list[Job], borders, apart: bool = False):
        self.jobs, self.borders = jobs, borders
        self.sizes = np.array([len(b) for b in borders], np.int64)
        self.context = rows.sparkSession.sparkContext
        facts = rows.groupBy("fold").agg(F.count("*"), F.sum("target")).collect()
        self.bases = []
        for job in jobs:
            seen = [(n, t) for f, n, t in facts if f < job.fold]
            if not seen:
                raise ValueError("no training rows")
            self.bases.append(sum(t for _, t in seen) / sum(n for n, _ in seen))
        self.judged = [any(f == job.fold for f, _, _ in facts) for job in jobs]
        # Few models share the cores by rows, many by model; rows beyond a task's limit are always parted.
        n, share = sum(n for _, n, _ in facts), max(1, self.context.defaultParallelism // len(jobs))
        self.tasks = max(1, -(-n // TASK_ROWS), min(share, n // FEW_ROWS))
        blocks = rows.select("target", "bins", "row_key", "fold").repartition(self.tasks).mapInArrow(_pack, "block binary")
        self.blocks = blocks.rdd.map(lambda r: bytes(r.block)).persist(StorageLevel.MEMORY_AND_DISK)
        self.trees: list[list[Tree]] = [[] for _ in jobs]
        # Features whose histograms travel together: all of them where one task has all rows.
        step = max(1, len(borders)) if self.tasks == 1 else -(-len(borders) // self.context.defaultParallelism)
        self.chunks = [(a, min(len(borders), a + step)) for a in range(0, len(borders), step)]
        self.states: list = []
        self.stale: list = []
        #: Training rows of each job.
        self.learned = [sum(n for f, n, _ in facts if f < job.fold) for job in jobs]
        #: Whether each model grows in a task of its own.
        self.apart = apart and self.tasks == 1
        if not self.apart:
            self.refresh(list(range(len(jobs))))

    def close(self):
        for _, state in self.states + self.stale:
            state.unpersist()
        self.blocks.unpersist()

    def boost(self, alive: list[int], turn: int, until: int) -> dict[int, list[float]]:
        """Grow the trees of rounds `turn` to `until`, each model in a task of its own that has all rows.

        Returns the mean absolute errors on each model's judging rows after these trees. Tasks start from the rows and the
        trees so far, the longest first.
        """
        sizes, parts = self.sizes, []
        for m in sorted(alive, key=lambda m: -self.learned[m]):
            known = self.jobs[m], self.bases[m], list(self.trees[m])

            def grow(blocks, m=m, known=known):
                return [(m, *_boost(blocks, *known, range(turn, until), sizes))]

            parts.append(self.blocks.mapPartitions(grow))
        curves = {}
        for m, trees, errors in self.context.union(parts).collect():
            self.trees[m] += trees
            if errors:
                curves[m] = errors
        return curves

    def refresh(self, alive: list[int]):
        """Keep the predictions of all trees so far, from the rows on, for the models that go on."""
        width, number = len(self.borders), max(1, min(len(alive), self.context.defaultParallelism // self.tasks))
        states = []
        for g in range(number):
            members = alive[g::number]
            known = [(self.bases[m], list(self.trees[m])) for m in members]

            def start(block, known=known):
                raw, target, keys, fold = pickle.loads(block)
                bins = np.frombuffer(raw, np.uint8).reshape(-1, width)
                p = [base + sum((t(bins) for t in trees), np.zeros(len(bins))) for base, trees in known]
                return bins, target, keys, fold, p, [[] for _ in known]

            states.append((members, self.blocks.map(start)))
        self._keep(states)

    def advance(self):
        """Add the last tree of each model to the predictions, and note the errors on its judging rows."""
        states = []
        for members, state in self.states:
            last = [(self.jobs[m].fold, self.trees[m][-1]) for m in members]

            def add(block, last=last):
                *rows, p, errors = block
                p = [now + tree(rows[0]) for now, (_, tree) in zip(p, last, strict=True)]
                off = [np.abs(rows[1] - now)[rows[3] == own].sum() for now, (own, _) in zip(p, last, strict=True)]
                return *rows, p, [[*e, float(x)] for e, x in zip(errors, off, strict=True)]

            states.append((members, state.map(add)))
        self._keep(states)

    def _keep(self, states):
        # What the new state is made from goes once a pass has made it.
        for _, state in self.stale:
            state.unpersist()
        self.stale = self.states
        self.states = [(members, state.persist(StorageLevel.MEMORY_AND_DISK)) for members, state in states]

    def errors(self, alive: list[int]) -> dict[int, list[float]]:
        """Mean absolute errors on each model's judging rows after each tree since the refresh, in one pass."""
        parts = []
        for members, state in self.states:
            wanted = [(i, m, self.jobs[m].fold) for i, m in enumerate(members) if m in alive]

            def judge(block, wanted=wanted):
                return [(m, (np.array(block[5][i]), int((block[3] == own).sum()))) for i, m, own in wanted]

            parts.append(state.flatMap(judge))
        sums = self.context.union(parts).reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1]), max(1, len(parts))).collect()
        return {m: (total / n).tolist() for m, (total, n) in sums if n}

    def splits(self, asked: dict[int, tuple[Tree, list[int], int]], turn: int) -> dict[int, dict[int, tuple]]:
        """For each model the best splits of the nodes it asks for (tree so far, nodes, level)."""
        sizes, chunks, merged = self.sizes, self.chunks, self.tasks > 1
        needs = {m: (self.jobs[m].spec, level) for m, (_, _, level) in asked.items()}

        def choose(item):
            (m, c), (squares, sums) = item
            spec, level = needs[m]
            return [(m, *row) for row in _chosen(spec, sums, squares, sizes, chunks[c], turn, level)]

        parts = []
        for members, state in self.states:
            wanted = [(i, m, self.jobs[m], *asked[m]) for i, m in enumerate(members) if m in asked]
            if not wanted:
                continue

            def add(blocks, wanted=wanted):
                blocks = list(blocks)
                for i, m, job, tree, nodes, _ in wanted:
                    sums, squares = _histograms(blocks, i, job, tree, nodes, turn, sizes)
                    for c, (a, b) in enumerate(chunks):
                        yield (m, c), (squares, np.ascontiguousarray(sums[:, :, a + sizes[:a].sum() : b + sizes[:b].sum()]))
                    del sums  # else they stay while the next model's are made

            # Where one task has all rows, its histograms never leave it.
            parts.append(state.mapPartitions(add) if merged else state.mapPartitions(add).flatMap(choose))
        found = self.context.union(parts)
        if merged:
            found = found.reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1]), len(chunks)).flatMap(choose)
        out: dict[int, dict[int, tuple]] = {m: {} for m in asked}
        for m, node, *row in sorted(found.collect(), key=lambda r: (r[0], r[1], -r[4], r[2])):
            out[m].setdefault(asked[m][1][node], tuple(row))
        return out


def _histograms(blocks, i: int, job: Job, tree: Tree, nodes: list[int], turn: int, sizes):
    """Sums (node, g h n, bin) over the training rows of model `i` that are in the given nodes, and of squared gradients."""
    ends = np.cumsum(sizes + 1)
    place = np.full(len(tree.feature), -1)
    place[nodes] = np.arange(len(nodes))
    sums, squares = np.zeros((len(nodes), 3, int(ends[-1]) if len(ends) else 0)), np.zeros(2)
    for bins, target, keys, fold, p, _ in blocks:
        node = place[tree.leaves(bins)]
        weight = row_weights(job.spec, keys, turn)
        use = (node >= 0) & (fold < job.fold)
        use = use if weight is None else use & (weight > 0)
        node, some, g = node[use], bins[use], (p[i] - target)[use]
        # A leaf-wise tree leaves rows out, the others weigh 1.
        w = None if weight is None or not isinstance(job.spec, Symmetric) else weight[use]
        squares += (g * g).sum(), len(g)
        for column, end, size in zip(np.ascontiguousarray(some.T), ends, sizes + 1, strict=True):
            cell, part = node * size + column, np.s_[end - size : end]
            n = np.bincount(cell, None, len(nodes) * size).reshape(-1, size)
            sums[:, 0, part] += np.bincount(cell, g if w is None else g * w, len(nodes) * size).reshape(-1, size)
            sums[:, 1, part] += n if w is None else np.bincount(cell, w, len(nodes) * size).reshape(-1, size)
            sums[:, 2, part] += n
    return sums, squares


def _exact(x: np.ndarray) -> np.ndarray:
    """`x` on a grid so much finer than its sum of sizes that any sum or difference of its values has no rounding error."""
    shift = 52 - math.frexp(float(np.abs(x).sum()))[1]
    return np.ldexp(np.rint(np.ldexp(x, shift)), -shift)


def _boost(blocks, job: Job, base: float, trees: list[Tree], turns: range, sizes) -> tuple[list[Tree], list[float]]:
    """The trees of some rounds after `trees` from all rows, and the mean absolute error on the judging rows after each."""
    spec, width = job.spec, len(sizes)
    taken = [[], []]
    for block in blocks:
        raw, *columns, fold = pickle.loads(block)
        rows = [np.frombuffer(raw, np.uint8).reshape(-1, width), *columns]
        for part, use in zip(taken, (fold < job.fold, fold == job.fold), strict=True):
            part.append([x[use] for x in rows])
    (bins, target, keys), (own, true, _) = ([np.concatenate(x) for x in zip(*part, strict=True)] for part in taken)
    p, now = (base + sum((t(x) for t in trees), np.zeros(len(x))) for x in (bins, own))
    search, made, errors = _Search(spec, bins, sizes), [], []
    for turn in turns:
        weight = row_weights(spec, keys, turn)
        growing, found = _growth(spec), None
        search.start(p - target, weight, turn)
        while True:
            try:
                found = search.splits(*growing.send(found))
            except StopIteration as done:
                made.append(done.value)
                break
        p += made[-1](bins)
        if len(own):
            now += made[-1](own)
            errors.append(float(np.abs(true - now).sum() / len(own)))
    return made, errors


class _Search:
    """Best splits of a model's trees in a task that has all its training rows.

    Of two children only the one with fewer rows is added up: the other's sums are their parent's less these. Sums are kept as
    those on the left of each border, of features and borders in use alone.
    """

    def __init__(self, spec, bins: np.ndarray, sizes):
        self.spec, self.sizes = spec, sizes
        self.columns = np.ascontiguousarray(bins.T)
        self.first = np.cumsum(sizes) - sizes
        if isinstance(spec, Symmetric):
            # The borders in use are the same in all rounds; bins between them become one.
            mask = allowed_borders(spec, sizes, 0)
            for f, (a, n) in enumerate(zip(self.first, sizes, strict=True)):
                before = np.concatenate([[0], np.cumsum(mask[a : a + n])]).astype(np.uint8)
                self.columns[f] = before[self.columns[f]]

    def start(self, g: np.ndarray, weight: np.ndarray | None, turn: int):
        """A new tree, from the gradients and weights of its rows."""
        rows = np.arange(len(g)) if weight is None else np.flatnonzero(weight > 0)
        self.turn, squares = turn, _exact(g[rows] ** 2)
        self.spread = math.sqrt(squares.sum() / len(rows)) if len(rows) else 0.0
        # A leaf-wise tree leaves rows out, the others weigh 1.
        weighs = weight is not None and isinstance(self.spec, Symmetric)
        self.g, self.w = (np.zeros(len(g)), np.zeros(len(g)) if weighs else None)
        self.g[rows] = _exact(g[rows] * weight[rows] if weighs else g[rows])
        if weighs:
            self.w[rows] = _exact(weight[rows])
        #: Of each border in use its number among those of all features, and its feature.
        self.used = np.flatnonzero(allowed_borders(self.spec, self.sizes, turn))
        self.owner = np.searchsorted(self.first + self.sizes, self.used, "right")
        #: (feature, its borders in use from, to).
        features, starts = np.unique(self.owner, return_index=True)
        ends = np.append(starts, len(self.used))[1:]
        self.parts = [*zip(features.tolist(), starts.tolist(), ends.tolist(), strict=True)]
        self.starts = {f: a for f, a, _ in self.parts}
        #: Of each open node its rows, its sums on the left of borders, its sums in all, and where it is parted.
        self.open: dict[int, list] = {}
        if len(self.used) and len(rows):
            self._open([0], [rows])

    def _open(self, nodes: list[int], groups: list[np.ndarray]):
        """Add up g and h of groups of rows."""
        number, rows = len(groups), np.concatenate(groups)
        place = np.repeat(np.arange(number), [len(x) for x in groups])
        sides = self.g[rows], None if self.w is None else self.w[rows]
        left, total = np.empty((number, 2, len(self.used))), np.stack([np.bincount(place, x, number) for x in sides], 1)
        cell = np.empty(len(rows), np.int64)
        for f, a, b in self.parts:
            size = b - a + 1
            np.multiply(place, size, out=cell)
            cell += self.columns[f][rows]
            for k, x in enumerate(sides):
                sums = np.bincount(cell, x, number * size).reshape(number, size)
                np.cumsum(sums[:, :-1], axis=1, out=left[:, k, a:b])
        for i, node in enumerate(nodes):
            self.open[node] = [groups[i], left[i], total[i], None]

    def _part(self, tree: Tree, nodes: list[int]):
        """Open the asked children of the nodes that have been split."""
        small, large = [], []
        for node in [n for n in self.open if tree.feature[n] >= 0]:
            rows, left, total, k = self.open.pop(node)
            f = int(self.owner[k])
            goes = self.columns[f][rows] <= k - self.starts[f]
            sides = sorted(((int(tree.left[node]), rows[goes]), (int(tree.right[node]), rows[~goes])), key=lambda x: len(x[1]))
            if not any(child in nodes for child, _ in sides):
                continue
            if len(sides[0][1]):
                small.append(sides[0])
                large.append((*sides[1], left, total, sides[0][0]))
            else:
                self.open[sides[1][0]] = [sides[1][1], left, total, None]
        if small:
            self._open(*zip(*small, strict=True))
        for child, rows, left, total, other in large:
            left -= self.open[other][1]
            self.open[child] = [rows, left, total - self.open[other][2], None]
        self.open = {n: x for n, x in self.open.items() if n in nodes or x[3] is not None}

    def splits(self, tree: Tree, nodes: list[int], level: int) -> dict[int, tuple]:
        """As _Fits.splits() for this model."""
        spec = self.spec
        self._part(tree, set(nodes))
        asked = [n for n in nodes if n in self.open]
        if not asked:
            return {}
        chosen = {}
        if isinstance(spec, Symmetric):
            shared, usable = np.zeros(len(self.used)), np.zeros(len(self.used), bool)
            for n in asked:
                gain, fits = self._gains(n)
                np.add(shared, gain, out=shared, where=fits)
                usable |= fits
            if spec.random_strength:
                draw = np.random.default_rng((spec.seed, self.turn, level, 2)).standard_normal(int(self.sizes.sum()))
                # As large as the gradients' spread, whatever the unit of the target.
                shared += draw[self.used] * spec.random_strength * self.spread
            if not usable.any():
                return {}
            k = int(np.where(usable, shared, -np.inf).argmax())
            chosen = dict.fromkeys(nodes, (k, float(shared[k])))
        else:
            for n in asked:
                gain, fits = self._gains(n)
                gain[~fits] = -np.inf
                k = int(gain.argmax())
                if gain[k] > spec.min_gain_to_split:
                    chosen[n] = k, float(gain[k])
                else:
                    del self.open[n]
        out = {}
        for n, (k, gain) in chosen.items():
            f, sums = int(self.owner[k]), (0.0,) * 6
            if n in self.open:
                (g, h), (g_all, h_all) = self.open[n][1][:, k].tolist(), self.open[n][2].tolist()
                sums, self.open[n][3] = (g, h, h, g_all, h_all, h_all), k
            out[n] = f, int(self.used[k] - self.first[f]), gain, *sums
        return out

    def _gains(self, node: int):
        _, left, total, _ = self.open[node]
        return split_gains(self.spec, left, total[:, None] - left)


def _chosen(spec, sums, squares, sizes, chunk, turn: int, level: int) -> list[tuple]:
    """best_splits() of the features of a chunk."""
    a, b = chunk
    cut = slice(int(sizes[:a].sum()), int(sizes[:b].sum()))
    noise = None
    if isinstance(spec, Symmetric) and spec.random_strength and squares[1]:
        draw = np.random.default_rng((spec.seed, turn, level, 2)).standard_normal(int(sizes.sum()))
        # As large as the gradients' spread, whatever the unit of the target.
        noise = draw[cut] * spec.random_strength * math.sqrt(squares[0] / squares[1])
    return best_splits(spec, sums, sizes[a:b], a, allowed_borders(spec, sizes, turn)[cut], noise)


@dataclass
class _Grown:
    """A tree whose nodes are found one after the other."""

    feature: list[int] = field(default_factory=lambda: [-1])
    border: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    depth: list[int] = field(default_factory=lambda: [0])
    sums: list[tuple] = field(default_factory=lambda: [None])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, found: tuple) -> None:
        """Give `node` two children by a row of splits()."""
        feature, border, gain, *sums = found
        one, whole = tuple(sums[:3]), tuple(sums[3:])
        self.sums[node] = whole
        self.feature[node], self.border[node], self.gain[node] = feature, border, gain
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for part in (one, tuple(a - b for a, b in zip(whole, one, strict=True))):
            self.feature.append(-1)
            self.border.append(0)
            self.left.append(0)
            self.right.append(0)
            self.depth.append(self.depth[node] + 1)
            self.sums.append(part)
            self.gain.append(0.0)

    def as_found(self) -> Tree:
        """All nodes under their own numbers, without values."""
        kinds = [np.array(x, np.int32) for x in (self.feature, self.border, self.left, self.right)]
        return Tree(*kinds, np.zeros(0), np.zeros(0))

    def tree(self, spec, inner: set[int] | None = None) -> Tree:
        """As arrays; with `inner`, only those nodes are split and the others below them are left out."""
        order, place = [0], {0: 0}
        for node in order:
            if self.feature[node] >= 0 and (inner is None or node in inner):
                for child in (self.left[node], self.right[node]):
                    place[child] = len(order)
                    order.append(child)
        split = [self.feature[n] >= 0 and (inner is None or n in inner) for n in order]
        value = [0.0 if s or self.sums[n] is None else leaf_value(spec, *self.sums[n][:2]) for n, s in zip(order, split, strict=True)]
        return Tree(
            np.array([self.feature[n] if s else -1 for n, s in zip(order, split, strict=True)], np.int32),
            np.array([self.border[n] for n in order], np.int32),
            np.array([place[self.left[n]] if s else 0 for n, s in zip(order, split, strict=True)], np.int32),
            np.array([place[self.right[n]] if s else 0 for n, s in zip(order, split, strict=True)], np.int32),
            np.array(value),
            np.array([self.gain[n] if s else 0.0 for n, s in zip(order, split, strict=True)]),
        )


def _leafwise_tree(spec):
    """Best-first growth in waves: yields (tree so far, nodes, 0), is sent their best splits, returns the tree.

    A wave asks for the splits of all leaves that are open; while they are unknown, the
    best known ones are followed on trial. The tree is the one that splits one leaf at a
    time, once no choice depends on an unknown leaf.
    """
    grown = _Grown()
    known: dict[int, tuple | None] = {}
    while True:
        inner, unknown, on_trial = set(), [], False
        heap: list[tuple] = []
        open_leaves = [0]
        while True:
            for leaf in open_leaves:
                deep = spec.max_depth and grown.depth[leaf] >= spec.max_depth
                few = grown.sums[leaf] is not None and grown.sums[leaf][2] < 2 * max(1, spec.min_data_in_leaf)
                if deep or few:
                    continue
                if leaf not in known:
                    unknown.append(leaf)
                elif known[leaf]:
                    heapq.heappush(heap, (-known[leaf][2], leaf))
            open_leaves = []
            if not heap or len(inner) >= spec.num_leaves - 1:
                break
            on_trial |= bool(unknown)
            _, node = heapq.heappop(heap)
            inner.add(node)
            if grown.feature[node] < 0:
                grown.split(node, known[node])
            open_leaves = [grown.left[node], grown.right[node]]
        if not on_trial and (not unknown or len(inner) >= spec.num_leaves - 1):
            return grown.tree(spec, inner)
        found = yield grown.as_found(), unknown, 0
        for node in unknown:
            known[node] = found.get(node)


def _symmetric_tree(spec):
    """Growth by levels: yields (tree so far, nodes of the level, level), is sent their common split, returns the tree."""
    grown = _Grown()
    level = [0]
    for depth in range(spec.depth):
        found = yield grown.as_found(), level, depth
        if not found:
            break
        after = []
        for node in level:
            grown.split(node, found[node])
            after += [grown.left[node], grown.right[node]]
        level = after
    return grown.tree(spec)


def _growth(spec):
    return _symmetric_tree(spec) if isinstance(spec, Symmetric) else _leafwise_tree(spec)


def fit_boosted(rows: DataFrame, spec, borders: list[np.ndarray], column: str, features=FEATURES) -> BoostedTrees:
    """One model on binned rows (target, bins, row_key, valid): training rows are those that aren't `valid`."""
    folds = rows.select("target", "bins", "row_key", F.col("valid").cast("int").alias("fold"))
    return fit_many(folds, [Job(spec)], borders, [column], features)[0]


def fit_many(rows: DataFrame, jobs: list[Job], borders, columns: list[str], features=FEATURES, ended=None, apart: bool = False) -> list[BoostedTrees]:
    """Boost all jobs on binned rows (target, bins, row_key, fold), squared loss, side by side.

    A pass over the rows serves all models: each asks for the histograms its tree needs
    next. For many models that are `apart` each is a task that grows its trees instead, if one task can have all
    rows; of splits with equal gains the first is taken there, rounding errors decide in a pass. With judging rows, a model's training ends when the mean absolute error on
    them hasn't improved for `patience` rounds, and the model is the prefix of trees
    up to the best round. Errors are computed for REFRESH rounds in one pass, so up to
    that many rounds are trained in vain; they change nothing. `ended(turns, curves)`
    may name further jobs to end after each such pass. Fits are repeatable: sampling
    hangs on the rows' own keys.

    Null targets and bins aren't taken: drop them before. Without training rows it is a ValueError.
    """
    fits = _Fits(rows, jobs, borders, apart)
    try:
        curves: list[list[float]] = [[] for _ in jobs]
        alive = list(range(len(jobs)))
        turn = 0
        while alive:
            if fits.apart:
                until = max(turn + 1, min(turn - turn % REFRESH + REFRESH, *[jobs[m].spec.rounds for m in alive]))
                found = fits.boost(alive, turn, until)
                turn = until
            else:
                growing = {m: _growth(jobs[m].spec) for m in alive}
                answers: dict = dict.fromkeys(growing)
                while growing:
                    asked = {}
                    for m in list(growing):
                        try:
                            asked[m] = growing[m].send(answers[m])
                        except StopIteration as done:
                            fits.trees[m].append(done.value)
                            del growing[m]
                    if asked:
                        answers = fits.splits(asked, turn)
                turn += 1
                fits.advance()
            last = {m for m in alive if turn >= jobs[m].spec.rounds}
            if turn % REFRESH == 0 or last:
                judged = [m for m in alive if fits.judged[m]]
                if not fits.apart:
                    found = fits.errors(judged) if judged else {}
                for m, errors in found.items():
                    curves[m] += errors
                stop = last | {m for m in judged if stopped_at(curves[m], jobs[m].spec.patience)}
                stop |= set(ended(turn, curves)) if ended else set()
                alive = [m for m in alive if m not in stop]
                if alive and not fits.apart:
                    fits.refresh(alive)
        out = []
        for job, base, trees, curve, column in zip(jobs, fits.bases, fits.trees, curves, columns, strict=True):
            best = best_round(curve, job.spec.patience) if curve else len(trees)
            out.append(BoostedTrees(base, trees[:best], borders, column, job.spec, tuple(features), curve))
        return out
    finally:
        fits.close()


def stopped_at(curve: list[float], patience: int) -> int | None:
    """The number of rounds after which training ends: `patience` rounds without a lower error than before."""
    best = 0
    for k, error in enumerate(curve):
        if error < curve[best]:
            best = k
        if patience and k - best >= patience:
            return k + 1
    return None


def best_round(curve: list[float], patience: int) -> int:
    """How many trees serve: up to the first round with the least error before training ends."""
    seen = curve[: stopped_at(curve, patience) or len(curve)]
    return int(np.argmin(seen)) + 1


def gain_importance(model: BoostedTrees, spark) -> DataFrame:
    """(feature, importance): total gain of each feature's splits, most first; 0 for features without one."""
    nodes = spark.createDataFrame(
        model.nodes(),
        "tree int, node int, feature string, threshold double, left int, right int, value double, gain double",
    )
    names = spark.createDataFrame([(f,) for f in model.features], "feature string")
    total = nodes.where("feature IS NOT NULL").groupBy("feature").agg(F.sum("gain").alias("gain"))
    out = names.join(F.broadcast(total), "feature", "left").select("feature", F.coalesce("gain", F.lit(0.0)).alias("importance"))
    return out.orderBy(F.col("importance").desc(), "feature")
