"""Boosted trees and grown forests against plain versions."""
import math

import numpy as np
import pytest

from terrapanel.operators import forests
from terrapanel.operators.boosting import DepthwiseBooster, LeafwiseBooster
from terrapanel.operators.forests import GrownForest, exact_tree
from terrapanel.operators.models import assemble, load_models, moisture_classifier, save_model

NAN = float("nan")


def table(n=400, seed=1, holes=True):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, (n, 3)).astype(float)
    y = np.sin(x[:, 0]) * 3 + (x[:, 1] > 5) * x[:, 2] + rng.normal(size=n)
    if holes:
        x[rng.random((n, 3)) < 0.08] = NAN
    return x, np.round(y, 3)


def frame(spark, x, y, parts=3):
    rows = [(*map(float, r), float(v)) for r, v in zip(x, y)]
    return assemble(spark.createDataFrame(rows, "a double, b double, c double, label double").repartition(parts), ["a", "b", "c"])


def scored(model, df, x):
    out = {}
    for r in model.transform(df).collect():
        out[tuple(str(v) for v in (r.a, r.b, r.c))] = r.prediction
    return np.array([out[tuple(str(float(v)) for v in r)] for r in x])


def plain_boost(x, y, rounds, depth, leaves, step, l2, least_hessian, least_rows):
    """One split at a time, every cut of every feature tried on the raw values."""
    cuts = []
    for f in range(x.shape[1]):
        v = np.unique(x[~np.isnan(x[:, f]), f])
        cuts.append((v[:-1] + v[1:]) / 2)
    margin = np.full(len(y), y.mean())

    def best(rows):
        g, out = (margin - y)[rows], None
        for f in range(x.shape[1]):
            v = x[rows, f]
            for c in cuts[f]:
                for missing_left in (False, True) if np.isnan(v).any() else (False,):
                    left = np.where(np.isnan(v), missing_left, v <= c)
                    n, m = left.sum(), (~left).sum()
                    if min(n, m) < max(least_hessian, least_rows, 1):
                        continue
                    gain = 0.5 * (g[left].sum() ** 2 / (n + l2) + g[~left].sum() ** 2 / (m + l2) - g.sum() ** 2 / (len(g) + l2))
                    if gain > 1e-6 and (out is None or gain > out[0] + 1e-7):
                        out = (gain, rows[left], rows[~left])
        return out

    for _ in range(rounds):
        open_, done = [(0, np.arange(len(y)), best(np.arange(len(y))))], []
        count = 1
        while True:
            able = [n for n in open_ if n[2] and n[0] < depth]
            if not able or count >= leaves:
                break
            node = max(able, key=lambda n: n[2][0])
            open_ = [n for n in open_ if n is not node]
            for rows in node[2][1:]:
                open_.append((node[0] + 1, rows, best(rows)))
            count += 1
        done = open_
        change = np.zeros(len(y))
        for _, rows, _ in done:
            change[rows] = -step * (margin - y)[rows].sum() / (len(rows) + l2)
        margin = margin + change
    return margin


@pytest.mark.parametrize("booster, plain", [
    (DepthwiseBooster(rounds=3, maxDepth=3, stepSize=0.3), dict(rounds=3, depth=3, leaves=math.inf, step=0.3, l2=1.0, least_hessian=1, least_rows=1)),
    (LeafwiseBooster(rounds=3, maxDepth=0, maxLeaves=7, stepSize=0.3), dict(rounds=3, depth=math.inf, leaves=7, step=0.3, l2=0.0, least_hessian=0, least_rows=20)),
    (LeafwiseBooster(rounds=2, maxDepth=2, maxLeaves=31, stepSize=0.5, leastRows=5), dict(rounds=2, depth=2, leaves=31, step=0.5, l2=0.0, least_hessian=0, least_rows=5)),
])
def test_boosters_equal_one_split_at_a_time(spark, booster, plain):
    x, y = table()
    df = frame(spark, x, y)
    assert np.allclose(scored(booster.fit(df), df, x), _by_vector(x, plain_boost(x, y, **plain)), atol=1e-6)


def _by_vector(x, values):
    of = {tuple(str(float(v)) for v in r): p for r, p in zip(x, values)}
    return np.array([of[tuple(str(float(v)) for v in r)] for r in x])


def test_the_two_boosters_differ_and_lower_the_error(spark):
    x, y = table(500, 3)
    df = frame(spark, x, y)
    a, b = DepthwiseBooster(rounds=12).fit(df), LeafwiseBooster(rounds=12, maxLeaves=8).fit(df)      # a written table after ten trees
    pa, pb = scored(a, df, x), scored(b, df, x)
    assert not np.allclose(pa, pb)
    assert ((pa - y) ** 2).mean() < 0.5 * y.var() and ((pb - y) ** 2).mean() < 0.6 * y.var()
    assert all(len([s for s in b.splits(t)]) <= 7 for t in range(12))


def test_boosters_do_not_depend_on_partitions(spark):
    x, y = table(300, 5)
    one, many = (DepthwiseBooster(rounds=4).fit(frame(spark, x, y, n)).getOrDefault("model") for n in (1, 6))
    assert one == many


def test_many_values_missing_rows_and_constant_labels(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 3))
    y = x[:, 0] + rng.normal(size=900) * 0.1
    df = frame(spark, x, y)
    model = DepthwiseBooster(rounds=20, stepSize=0.3).fit(df)
    assert len(model.parts()[1][0]) <= 254 and ((scored(model, df, x) - y) ** 2).mean() < 0.1 * y.var()
    flat = LeafwiseBooster(rounds=2).fit(frame(spark, x, np.full(900, 2.5)))
    assert np.allclose(scored(flat, df, x), 2.5)
    with pytest.raises(ValueError):
        DepthwiseBooster().fit(df.limit(0))
    nulls = df.withColumn("label", df.label * 0 + NAN)
    with pytest.raises(ValueError):
        LeafwiseBooster().fit(nulls)


def means(x, y):
    of = {}
    for r, v in zip(x, y):
        of.setdefault(tuple(str(float(k)) for k in r), []).append(v)
    return np.array([np.mean(of[tuple(str(float(k)) for k in r)]) for r in x])


@pytest.mark.parametrize("finish", [50_000, 40])
def test_a_tree_is_grown_to_purity(spark, finish):
    x, y = table(500, 7)
    df = frame(spark, x, y)
    model = GrownForest(trees=1, bootstrap=False, finishRows=finish).fit(df)
    assert np.allclose(scored(model, df, x), means(x, y), atol=1e-6)
    assert (model.subtrees(spark).count() > 1) == (finish == 40)


def test_a_node_that_its_bins_cannot_split_gets_its_own_cuts(spark):
    """Most values lie between two of the quantile cuts' distinct values."""
    rng = np.random.default_rng(6)
    x = np.column_stack([np.concatenate([rng.integers(0, 300, 300) * 1000.0, rng.random(2000)]), np.zeros(2300), np.zeros(2300)])
    y = x[:, 0] * 2
    df = frame(spark, x, y)
    model = GrownForest(trees=1, bootstrap=False, finishRows=100).fit(df)
    assert np.allclose(scored(model, df, x), means(x, y), atol=1e-5)


def test_a_vector_that_fills_a_third_of_the_table(spark):
    x, y = table(900, 8, holes=False)
    x[::3] = [1.0, 2.0, 3.0]
    df = frame(spark, x, y)
    assert np.allclose(scored(GrownForest(trees=1, bootstrap=False, finishRows=50).fit(df), df, x), means(x, y), atol=1e-6)


def test_nodes_of_one_vector_take_no_job_each(spark):
    """300 vectors of 20 rows in nodes of over 10 rows: what cannot be split is looked at together."""
    x = np.repeat(np.column_stack([np.arange(300.0) % 20, np.arange(300.0) // 20, np.zeros(300)]), 20, axis=0)
    y = np.arange(len(x)) % 7 + x[:, 0] * 3 + x[:, 1]
    df = frame(spark, x, y)
    tracker = spark.sparkContext.statusTracker()
    for bootstrap in (True, False):
        spark.sparkContext.setJobGroup(f"one vector {bootstrap}", "")
        model = GrownForest(trees=1, bootstrap=bootstrap, finishRows=10, seed=5).fit(df)
        assert len(tracker.getJobIdsForGroup(f"one vector {bootstrap}")) < 100
        assert len(model._flat_tops()[0].feature) > (100 if bootstrap else 30)
    assert np.allclose(scored(model, df, x), means(x, y), atol=1e-6)


def one_node_at_a_time(x, w, y):
    """Means by vector of a tree grown node by node, every cut of every feature tried."""
    out, todo = np.empty(len(x)), [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        best = None
        for f in range(x.shape[1]) if len(set((y[rows] / w[rows]).tolist())) > 1 else ():
            for v in np.unique(x[rows, f])[:-1]:
                left = x[rows, f] <= v
                gain = sum(y[rows][s].sum() ** 2 / w[rows][s].sum() for s in (left, ~left))
                if best is None or gain > best[0] * (1 + 1e-12):
                    best = gain, left
        if best is None:
            out[rows] = y[rows].sum() / w[rows].sum()
        else:
            todo += [rows[best[1]], rows[~best[1]]]
    return out


def test_the_nodes_of_a_level_are_split_together(monkeypatch):
    rng = np.random.default_rng(12)
    x, w = rng.integers(0, 9, (300, 3)).astype(float), rng.integers(1, 4, 300)
    x[rng.random((300, 3)) < 0.1] = np.inf
    y = rng.integers(0, 50, 300) * w
    t = exact_tree(x, w, y[:, None] << 20, 3, np.random.default_rng(0), 2.0 ** 20)
    assert np.allclose(t.value[t.leaves(x)][:, 0], one_node_at_a_time(x, w, y))
    x, calls, plain = rng.normal(size=(20_000, 6)), [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda *a, **b: calls.append(1) or plain(*a, **b))
    y = rng.integers(0, 1 << 40, (20_000, 1))
    t = exact_tree(x, np.ones(20_000, np.int64), y, 6, np.random.default_rng(1))
    assert np.allclose(t.value[t.leaves(x)], y)
    assert len(calls) < 100                                          # one for each of some 20,000 nodes before


def test_class_trees_are_the_same_with_and_without_arrays(monkeypatch):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 30, (2000, 5)).astype(float), np.eye(3, dtype=np.int64)[rng.integers(0, 3, 2000)]
    x, first = np.unique(x, axis=0, return_index=True)
    w = rng.integers(1, 4, len(x))
    trees = []
    for few in (0, 12):
        monkeypatch.setattr(forests, "FEW_ROWS", few)
        trees.append(exact_tree(x, w, y[first] * w[:, None], 2, np.random.default_rng(1)))
        assert np.allclose(trees[-1].value[trees[-1].leaves(x)], y[first])
    assert all(np.array_equal(getattr(trees[0], c), getattr(trees[1], c)) for c in ("feature", "threshold", "left", "right", "value"))
    assert set(trees[0].feature.tolist()) == {-1, 0, 1, 2, 3, 4}


def test_dealt_and_broadcast_scores_are_the_same(spark, monkeypatch):
    x, y = table(300, 9)
    df = frame(spark, x, y)
    model = GrownForest(trees=7, finishRows=60, seed=3).fit(df)
    a = scored(model, df, x)
    monkeypatch.setattr(forests, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(forests, "FINISH_ROWS", 30)
    assert np.allclose(scored(model, df, x), a)
    assert ((a - y) ** 2).mean() < 0.5 * y.var()


def test_weights_are_poisson_and_repeat():
    w = forests.row_weights(np.arange(200_000), 3, 42, True)
    assert abs(w.mean() - 1) < 0.01 and abs((w == 0).mean() - math.exp(-1)) < 0.005 and abs(w.var() - 1) < 0.02
    assert (w == forests.row_weights(np.arange(200_000), 3, 42, True)).all()
    assert (w != forests.row_weights(np.arange(200_000), 4, 42, True)).mean() > 0.4


def test_exact_tree_separates_what_one_split_cannot():
    """No single split gains here; a tree grown to its end still separates the rows."""
    x = np.array([[0.0, 0.0], [0.0, 1.0], [1.0, 0.0], [1.0, 1.0]])
    t = exact_tree(x, np.ones(4), np.array([[0.0], [1.0], [1.0], [0.0]]), 2, np.random.default_rng(0))
    assert t.value[t.leaves(x)][:, 0].tolist() == [0, 1, 1, 0]
    t = exact_tree(x[:1], np.ones(1), np.array([[3.0]]), 2, np.random.default_rng(0))
    assert t.leaves(x).tolist() == [0] * 4


def test_classes_by_majority_and_saved_forests(spark, tmpdir_path):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 3))
    names = np.where(x[:, 0] + x[:, 1] > 0.3, "High", np.where(x[:, 2] > 0, "Low", "Medium"))
    rows = [(*map(float, r), str(v)) for r, v in zip(x, names)] + [(0.0, 0.0, 0.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, moisture_class string")
    model = moisture_classifier(["a", "b", "c"], trees=25).fit(df)
    out = model.transform(df.where("moisture_class is not null")).collect()
    assert np.mean([r.prediction == r.label for r in out]) > 0.97
    save_model(model.stages[-1], f"{tmpdir_path}/m/forest")
    save_model(DepthwiseBooster(rounds=2).fit(frame(spark, *table(100))), f"{tmpdir_path}/m/boosted")
    loaded = load_models(spark, f"{tmpdir_path}/m")
    assert sorted(loaded) == ["boosted", "forest"]
    before = model.stages[1].transform(model.stages[0].transform(df.where("moisture_class is not null")))
    again = loaded["forest"].transform(before).select("a", "prediction").collect()
    assert sorted(map(tuple, again)) == sorted((r.a, r.prediction) for r in out)


@pytest.mark.parametrize("booster", [DepthwiseBooster, LeafwiseBooster])
def test_one_task_and_blocks_of_many_grow_equal_trees(spark, monkeypatch, booster):
    """A small table needs no job for each pass; blocks dealt to tasks, collected or added up on the way, give the same model."""
    from terrapanel.operators import boosting

    x, y = table(600, seed=5)
    df = frame(spark, x, y)
    fit = lambda: booster(rounds=12, maxDepth=3).fit(df).getOrDefault("model")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("one task", "")
    want = fit()
    assert len(tracker.getJobIdsForGroup("one task")) < 30                  # 36 passes
    spark.sparkContext.setJobGroup("blocks", "")
    monkeypatch.setattr(boosting, "HELD_ROWS", 200)
    assert fit() == want
    monkeypatch.setattr(boosting, "COLLECTED_BLOCKS", 1)
    assert fit() == want
