import math
import random
from collections import Counter

import numpy as np
import pytest

from terrapanel.llm import bond_negatives as bond

KIND = "vec_id long, embedding array<float>, label int, score double, rank int, place string, anchor string, vector string"


def brute(rows, least=80, k=5):
    """All scores of all anchors, sorted."""
    good = []
    for vec_id, e, label in rows:
        if label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        good.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in e], label))
    last = lambda i: (i is None, i or 0)
    out = []
    for a, e, label in good:
        if a is None or a % 100:
            continue
        scored = [(sum(x * y for x, y in zip(e, f)), i, m == label) for i, f, m in good if i != a]
        scored.sort(key=lambda x: (-x[0], last(x[1])))
        for ps, p, _ in [x for x in scored if x[2]][:k]:
            window = [x for x in scored if not x[2] and least * ps <= 100 * x[0] <= 100 * ps][:k]
            out += [(a, p, r + 1, n, ps, ns) for r, (ns, n, _) in enumerate(window)]
    return Counter(out)


def samples(n=900, dims=12, seed=5):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(dims)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i, [x + rng.gauss(0, 0.1) for x in c], rng.randrange(10)))
    hot = rows[3][1]
    rows = [(i, hot, label) if i % 3 == 1 else (i, e, label) for i, e, label in rows]        # a third are one vector
    rows[10] = (10, None, 1)
    rows[20] = (20, [None] * dims, 1)
    rows[30] = (30, [float("nan")] + [0.1] * (dims - 1), 1)
    rows[40] = (40, [float("inf")] + [0.1] * (dims - 1), 1)
    rows[50] = (50, rows[50][1], None)
    rows[300] = (300, None, 1)
    rows[60] = (60, [], 3)
    rows[61] = (61, rows[61][1][:5], 3)
    rows[200] = (200, [0.0] * dims, 3)
    rows[500] = (500, [-x for x in hot], 4)                                                  # negative scores: no window
    rows += [rows[4], rows[4], (None, hot, 2), (None, hot, 3), rows[400], (700, rows[5][1], 6)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1.0, 1, "p", "a", "v") for r in rows], KIND).repartition(3)


def mined(spark, rows, tmp_path, **how):
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    return Counter(tuple(r) for r in bond.op12_bond_negatives(spark, str(tmp_path)).collect())


def test_equals_all_scores(spark, tmp_path):
    rows = samples()
    want = brute(rows)
    assert len(want) > 50
    assert mined(spark, rows, tmp_path) == want


def test_small_blocks_and_batches_of_anchors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bond, "BLOCK", 64)
    rows = samples(1300, 20, 6)
    data = bond.usable(frame(spark, rows), "label")
    anchors = data.where("vec_id % 100 = 0")
    whole = Counter(tuple(r) for r in bond.mine(data, anchors).collect())
    assert Counter(tuple(r) for r in bond.mine(data, anchors, batch=4).collect()) == whole
    assert len(whole) > 50


def test_bounds_prune_and_stay_exact():
    """Rows leave the bitmap before all columns are read, and none that matters."""
    rng = np.random.default_rng(2)
    table = np.floor(rng.normal(0, 20, (3000, 64)))
    anchor = np.floor(rng.normal(0, 20, 64) * np.geomspace(10, 0.05, 64))
    block = bond.Block(np.arange(3000), np.zeros(3000, np.int64), table, 64)
    exact = table @ anchor
    best = np.sort(exact)[-5]
    sizes = []

    def matters(lower, upper):
        sizes.append(len(lower))
        return upper >= best

    found, score = block.scan(anchor, np.arange(3000), matters)
    assert sorted(found.tolist()) == np.flatnonzero(exact >= best).tolist()
    assert np.array_equal(score, exact[found])
    assert sizes[-2] < 100


@pytest.mark.parametrize("rows", [[], [(100, None, 1)], [(100, [0.5, 0.5], 1)], [(1, [0.5], 1), (2, [0.5], 1)],
                                  [(100, [0.5, 0.5], 1), (101, [0.5, 0.5], 1)]])
def test_no_results(spark, tmp_path, rows):
    assert mined(spark, rows, tmp_path) == Counter()


def test_wide_rows_and_narrow_anchors(spark, tmp_path):
    rows = [(100, [0.5], 1), (101, [0.5, 9.0], 1), (102, [0.5, -9.0, 3.0], 2), (103, [0.45], 2)]
    assert mined(spark, rows, tmp_path) == brute(rows)
