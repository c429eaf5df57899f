"""Boosting against plain numpy versions on small data."""

import heapq
import tracemalloc
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from demandcast.operators import boosting
from demandcast.operators.boosting import LeafWise, Symmetric
from demandcast.session import materialize

NAMES = tuple("abcdef")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(600, 6)), 1)
    x[:, 4], x[:, 5] = 7.0, rng.integers(0, 2, 600)
    y = x[:, 0] * 3 + np.where(x[:, 1] > 0.3, 4, -1) * x[:, 5] + rng.normal(0, 0.3, 600)
    return x, y, rng.random(600) < 0.3


@pytest.fixture(scope="module")
def binned(spark, data):
    x, y, valid = data
    rows = [(float(t), v.tolist(), bool(k)) for t, v, k in zip(y, x, valid, strict=True)]
    df = spark.createDataFrame(rows, "target double, features array<double>, valid boolean")
    flat = df.select(*[F.col("features")[i].alias(n) for i, n in enumerate(NAMES)])
    borders = boosting.feature_borders(flat, NAMES, 20)
    stored = materialize(boosting.bin_rows(df.withColumn("features", array_to_vector("features")), borders, ("valid",)), "binned")
    return stored, borders


def plain_gain(spec, g, h, n, side):
    l1, l2 = (spec.lambda_l1, spec.lambda_l2) if isinstance(spec, LeafWise) else (0.0, spec.l2_leaf_reg)
    least = spec.min_data_in_leaf if isinstance(spec, LeafWise) else 1

    def score(m):
        return max(abs(g[m].sum()) - l1, 0) ** 2 / (h[m].sum() + l2)

    a, b = side & n, ~side & n
    if a.sum() < least or b.sum() < least:
        return None
    return score(a) + score(b) - score(n)


def plain_value(spec, g, h, m):
    l1, l2 = (spec.lambda_l1, spec.lambda_l2) if isinstance(spec, LeafWise) else (0.0, spec.l2_leaf_reg)
    return -spec.learning_rate * np.sign(g[m].sum()) * max(abs(g[m].sum()) - l1, 0) / (h[m].sum() + l2)


def plain_leafwise(spec, bins, g, h, borders):
    """{leaf rows: value} of one tree, grown one leaf at a time."""

    def best(rows):
        top = None
        for f in range(bins.shape[1]):
            for b in range(len(borders[f])):
                gain = plain_gain(spec, g, h, rows, bins[:, f] <= b)
                if gain is not None and gain > spec.min_gain_to_split and (top is None or gain > top[0] + 1e-9):
                    top = (gain, f, b)
        return top

    leaves, heap, count = {0: (np.ones(len(g), bool), 0)}, [], 1
    found = best(leaves[0][0])
    if found:
        heap.append((-found[0], 0, found))
    while heap and len(leaves) < spec.num_leaves:
        _, leaf, (_, f, b) = heapq.heappop(heap)
        rows, depth = leaves.pop(leaf)
        for side in (bins[:, f] <= b, bins[:, f] > b):
            leaves[count] = (rows & side, depth + 1)
            found = best(rows & side) if not spec.max_depth or depth + 1 < spec.max_depth else None
            if found:
                heapq.heappush(heap, (-found[0], count, found))
            count += 1
    out = np.zeros(len(g))
    for rows, _ in leaves.values():
        out[rows] = plain_value(spec, g, h, rows)
    return out


def plain_symmetric(spec, bins, g, h, borders):
    nodes = [np.ones(len(g), bool)]
    for _ in range(spec.depth):
        top = None
        for f in range(bins.shape[1]):
            for b in range(len(borders[f])):
                gains = [plain_gain(spec, g, h, n, bins[:, f] <= b) for n in nodes]
                if any(x is not None for x in gains):
                    total = sum(x or 0 for x in gains)
                    if top is None or total > top[0] + 1e-9:
                        top = (total, f, b)
        nodes = [n & s for n in nodes for s in (bins[:, top[1]] <= top[2], bins[:, top[1]] > top[2])]
    out = np.zeros(len(g))
    for n in nodes:
        if n.any():
            out[n] = plain_value(spec, g, h, n)
    return out


def plain_fit(spec, x, y, borders, grow):
    """Predictions of the training rows after all rounds."""
    bins = np.stack([np.searchsorted(b, x[:, f], "left") for f, b in enumerate(borders)], axis=1)
    p = np.full(len(y), y.mean())
    for _ in range(spec.rounds):
        p = p + grow(spec, bins, p - y, np.ones(len(y)), borders)
    return p


LEAF_SPECS = [
    LeafWise(rounds=3, num_leaves=6, min_data_in_leaf=5),
    LeafWise(rounds=2, num_leaves=31, min_data_in_leaf=20, lambda_l1=3.0, lambda_l2=5.0, min_gain_to_split=0.5),
    LeafWise(rounds=2, num_leaves=12, max_depth=3, min_data_in_leaf=1, learning_rate=0.5),
]


@pytest.mark.parametrize("tasks", [1, 3])
@pytest.mark.parametrize("spec", LEAF_SPECS)
def test_leafwise_trees_equal_plain_ones(binned, data, spec, tasks, monkeypatch):
    monkeypatch.setattr(boosting, "TASK_ROWS", 600 if tasks == 1 else 200)
    rows, borders = binned
    x, y, _ = data
    model = boosting.fit_boosted(rows.withColumn("valid", F.lit(False)), replace(spec, patience=0), borders, "p", NAMES)
    assert model.rounds == spec.rounds
    assert np.abs(model.predict(x) - plain_fit(spec, x, y, borders, plain_leafwise)).max() < 1e-6


@pytest.mark.parametrize("tasks", [1, 3])
def test_symmetric_trees_equal_plain_ones(binned, data, tasks, monkeypatch):
    monkeypatch.setattr(boosting, "TASK_ROWS", 600 if tasks == 1 else 200)
    rows, borders = binned
    x, y, _ = data
    spec = Symmetric(rounds=3, depth=3, random_strength=0.0, bagging_temperature=0.0, l2_leaf_reg=2.0, patience=0)
    model = boosting.fit_boosted(rows.withColumn("valid", F.lit(False)), spec, borders, "p", NAMES)
    expected = plain_fit(spec, x, y, borders, plain_symmetric)
    assert np.abs(model.predict(x) - expected).max() < 1e-6
    for tree in model.trees:  # one split for each level
        level = [0]
        while tree.feature[level[0]] >= 0:
            assert len({(tree.feature[n], tree.border[n]) for n in level}) == 1
            level = [c for n in level for c in (tree.left[n], tree.right[n])]


def test_rounds_and_curve_equal_a_plain_recomputation(binned, data):
    rows, borders = binned
    x, y, valid = data
    for spec in (LeafWise(rounds=60, learning_rate=0.5, num_leaves=15, min_data_in_leaf=5, patience=4), Symmetric(rounds=25, depth=4, patience=3)):
        model = boosting.fit_boosted(rows, spec, borders, "p", NAMES)
        p, errors, best, served = np.full(valid.sum(), y[~valid].mean()), [], np.inf, 0
        bins = boosting.bin_values(x[valid], borders)
        for k, error in enumerate(model.curve):
            if error < best:
                best, served = error, k + 1
            if k + 1 - served >= spec.patience:
                break
        assert model.rounds == served
        for tree in model.trees:
            p = p + tree(bins)
            errors.append(np.abs(p - y[valid]).mean())
        assert errors == pytest.approx(model.curve[: model.rounds])
        assert np.argmin(errors) == model.rounds - 1


def test_patience_rule():
    assert boosting.stopped_at([5, 4, 4, 4], 2) == 4 and boosting.best_round([5, 4, 4, 4, 1], 2) == 2
    assert boosting.stopped_at([5, 4, 3], 2) is None and boosting.best_round([5, 4, 3], 2) == 3
    assert boosting.stopped_at([1, 2, 3], 0) is None


def test_sampling_hangs_on_rows_not_on_partitions(binned, data):
    rows, borders = binned
    for spec in (
        LeafWise(rounds=4, feature_fraction=0.6, bagging_fraction=0.7, bagging_freq=2, patience=0),
        Symmetric(rounds=4, depth=3, patience=0),
    ):
        one = boosting.fit_boosted(rows, spec, borders, "p", NAMES)
        two = boosting.fit_boosted(rows.repartition(5), spec, borders, "p", NAMES)
        assert [t.feature.tolist() for t in one.trees] == [t.feature.tolist() for t in two.trees]
        assert one.predict(data[0]) == pytest.approx(two.predict(data[0]))
    keys = np.arange(100_000)
    u = boosting.uniform(keys, 1, 2)
    assert abs(u.mean() - 0.5) < 0.01 and 0 < u.min() and u.max() < 1
    assert abs(np.corrcoef(u, boosting.uniform(keys, 1, 3))[0, 1]) < 0.02


def test_transform_nodes_and_importance(spark, binned, data):
    rows, borders = binned
    x, y, _ = data
    model = boosting.fit_boosted(rows, LeafWise(rounds=5, patience=0), borders, "pred", NAMES)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, features array<double>")
    got = model.transform(df.withColumn("features", array_to_vector("features"))).orderBy("i").collect()
    assert [r.pred for r in got] == pytest.approx(model.predict(x).tolist())
    total = {r.feature: r.importance for r in boosting.gain_importance(model, spark).collect()}
    by_tree = sum(t.gain.sum() for t in model.trees)
    assert sum(total.values()) == pytest.approx(by_tree) and total["e"] == 0 and total["a"] > 0
    assert set(total) == set(NAMES)


def test_constant_features_and_few_rows(spark):
    df = spark.createDataFrame([(1.0, [1.0], False), (3.0, [1.0], False)], "target double, features array<double>, valid boolean")
    borders = boosting.feature_borders(df.select(F.col("features")[0].alias("a")), ("a",))
    rows = materialize(boosting.bin_rows(df.withColumn("features", array_to_vector("features")), borders, ("valid",)), "binned")
    for spec in (LeafWise(rounds=2), Symmetric(rounds=2)):
        assert boosting.fit_boosted(rows, spec, borders, "p", ("a",)).predict(np.array([[1.0], [9.0]])).tolist() == [2.0, 2.0]
        with pytest.raises(ValueError):
            boosting.fit_boosted(rows.limit(0), spec, borders, "p", ("a",))


@pytest.mark.parametrize("spec", [LeafWise(num_leaves=300, min_data_in_leaf=3), Symmetric(depth=10)])
def test_split_search_of_many_nodes_takes_little_memory(spec, monkeypatch):
    """In hyperparam_search, a level of 512 nodes took 5 times its histograms besides (1 GB a task)."""
    rng = np.random.default_rng(5)
    sizes = np.array([0, 254, 3, 120, 254, 1, 254])
    sums, node = np.zeros((256, 3, int((sizes + 1).sum()))), np.repeat(np.arange(256), 60)
    g = rng.normal(size=len(node))
    for end, n in zip(np.cumsum(sizes + 1), sizes, strict=True):
        at = end - 1 - rng.integers(0, n + 1, len(node))
        for k, x in enumerate((g, 1.0, 1.0)):
            np.add.at(sums, (node, k, at), x)
    allowed, noise = rng.random(sizes.sum()) < 0.9, rng.normal(size=sizes.sum())
    whole = boosting.best_splits(spec, sums.copy(), sizes, 7, allowed, noise)
    assert len(whole) == 256 and {w[0] for w in whole} == set(range(256))
    monkeypatch.setattr(boosting, "AT_ONCE", 10_000, raising=False)
    own = sums.copy()
    tracemalloc.start()
    parted = boosting.best_splits(spec, own, sizes, 7, allowed, noise)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert parted == whole
    assert peak < sums.nbytes / 2


GROWN = [
    LeafWise(rounds=6, num_leaves=12, min_data_in_leaf=4, lambda_l1=0.5, lambda_l2=1.0, patience=0),
    LeafWise(rounds=6, num_leaves=40, max_depth=5, min_data_in_leaf=9, feature_fraction=0.6, bagging_fraction=0.7, bagging_freq=2, patience=0),
    Symmetric(rounds=6, depth=4, border_count=9, patience=0),
    Symmetric(rounds=6, depth=7, bagging_temperature=0.0, random_strength=0.0, patience=0),
]


def test_many_rounds_of_many_models_are_few_jobs(spark, binned):
    """hyperparam_search ran a job for every level of every round and ended by time."""
    rows, borders = binned
    folds = rows.withColumn("fold", F.col("valid").cast("int"))
    context = spark.sparkContext
    context.setJobGroup("few-jobs", "few jobs")
    try:
        models = boosting.fit_many(folds, [boosting.Job(replace(s, rounds=20)) for s in GROWN], borders, list("abcd"), NAMES, apart=True)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert [m.rounds for m in models] == [int(np.argmin(m.curve)) + 1 for m in models] and {len(m.curve) for m in models} == {20}
    assert len(context.statusTracker().getJobIdsForGroup("few-jobs")) < 10


@pytest.mark.parametrize("spec", GROWN)
def test_a_task_with_all_rows_grows_the_trees_that_several_tasks_grow(binned, spec, monkeypatch):
    rows, borders = binned
    folds = rows.withColumn("fold", F.col("valid").cast("int"))
    alone = boosting.fit_many(folds, [boosting.Job(spec)], borders, ["p"], NAMES, apart=True)[0]
    monkeypatch.setattr(boosting, "TASK_ROWS", 200)
    shared = boosting.fit_many(folds, [boosting.Job(spec)], borders, ["p"], NAMES)[0]
    assert alone.curve == pytest.approx(shared.curve) and alone.rounds == shared.rounds
    for a, b in zip(alone.trees, shared.trees, strict=True):
        assert a.feature.tolist() == b.feature.tolist() and a.border.tolist() == b.border.tolist()
        assert a.value == pytest.approx(b.value) and a.gain == pytest.approx(b.gain)


def test_a_task_with_all_rows_grows_the_same_trees_in_any_order_of_rows():
    rng = np.random.default_rng(8)
    bins, y, keys = rng.integers(0, 4, (500, 6)).astype(np.uint8), rng.normal(0, 9, 500), rng.integers(0, 1 << 40, 500)
    bins[:, 3] = bins[:, 1]  # equal gains
    fold, sizes = rng.integers(0, 3, 500), np.full(6, 3)
    for spec in GROWN:
        found = []
        for order in (np.arange(500), rng.permutation(500)):
            blocks = [boosting.pickle.dumps((bins[o].tobytes(), y[o], keys[o], fold[o])) for o in np.array_split(order, 3)]
            trees, errors = boosting._boost(blocks, boosting.Job(spec, 2), 0.5, [], range(4), sizes)
            found.append([[getattr(t, c).tolist() for c in ("feature", "border", "left", "right", "value", "gain")] for t in trees])
        assert found[0] == found[1] and len(errors) == 4
        more = boosting._boost(blocks, boosting.Job(spec, 2), 0.5, trees[:2], range(2, 4), sizes)
        assert [t.feature.tolist() for t in more[0]] == [t.feature.tolist() for t in trees[2:]] and more[1] == pytest.approx(errors[2:])


def test_sums_of_rounded_gradients_have_no_error():
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1e3, 4000) ** 3
    y = boosting._exact(x)
    assert np.abs(y - x).max() <= 1e-12 * np.abs(x).sum()
    assert y.sum() == y[::-1].cumsum()[-1] == y[rng.permutation(4000)].cumsum()[-1] == boosting.math.fsum(y)
    assert boosting._exact(np.zeros(3)).tolist() == [0, 0, 0] and boosting._exact(np.zeros(0)).tolist() == []


def test_borders_of_many_columns_take_one_small_plan(spark, monkeypatch):
    """In hyperparam_search the shares of all quantiles stood 66 times in a plan of 1.3 MB of text, read twice."""
    rng = np.random.default_rng(4)
    values = np.round(rng.normal(size=(300, 20)), 1)
    values[:, 3] = 1.5
    names = [f"c{k}" for k in range(20)]
    df = spark.createDataFrame([tuple(v.tolist()) for v in values], ", ".join(f"{n} double" for n in names))
    plans = []
    collect, first = type(df).collect, type(df).first
    monkeypatch.setattr(type(df), "collect", lambda self: plans.append(self._jdf.queryExecution().toString()) or collect(self))
    monkeypatch.setattr(type(df), "first", lambda self: plans.append(self._jdf.queryExecution().toString()) or first(self))
    borders = boosting.feature_borders(df, names)
    assert len(plans) == 1 and sum(p.count("percentile_approx(") for p in plans) <= 8
    for column, got in zip(values.T, borders, strict=True):
        ranks = np.ceil(np.arange(1, 255) / 255 * 300).astype(int) - 1
        expected = np.unique(np.sort(column)[ranks])
        assert got.tolist() == expected[expected < column.max()].tolist()
    assert [b.tolist() for b in boosting.feature_borders(df.limit(0), names)] == [[]] * 20
