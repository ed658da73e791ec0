"""Random forests whose trees grow to purity, without a limit of depth (M5, M8).

A tree is grown in two parts:

* *Top.*  Nodes of more than ``finishRows`` rows are split by histograms over
  the whole table (rows stay where they lie; a pass sums weights and targets by
  node, feature and bin, for the nodes of all trees at once).  A node that its
  bins cannot split, but whose values differ, gets cuts of its own values and is
  tried again.
* *Rest.*  Rows travel packed to (tree, node): each smaller node is finished in
  a task of its own, by exact splits between neighbouring values, until a node's
  targets are equal or its feature vectors are.  A task of a regression tree splits
  all nodes of a level at once, in columns that are sorted once.  Equal feature
  vectors are summed before they are dealt, so a vector that fills a third of the
  table is a few rows; without draws they are summed over the whole table.

Regression splits lower the squared error; classes are one-of-n targets, for
which that is the Gini impurity.  A node looks at all features or at the square
root of their number (drawn by node; constant ones are passed over).  Every tree
draws rows with replacement by Poisson(1) weights, a hash of seed, tree and row;
``bootstrap=False`` takes each row once.  NaN is greater than any value.

The model is a table of subtrees, one row each, with the small tops beside it.
Where all subtrees together have at most ``BROADCAST_BYTES`` they are broadcast
to score; beyond it rows are dealt to the subtrees, packed, with as many copies of a
subtree as its rows need.  Rows with a null label are left out, a null vector
gives a null prediction, ties of classes go to the first.
"""

from __future__ import annotations

import itertools
import json
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import keyword_only
from pyspark.ml.base import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable, DefaultParamsWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.operators.boosting import BINS, _table, find_cuts
from terrapanel.session import checkpoint_dir, materialize

FINISH_ROWS = 50_000              # rows of a node that one task finishes
NODES_A_PASS = 1024               # histograms summed by one pass
FEW_ROWS = 12                     # rows of a node that is split without arrays
CHUNK_ROWS = 50_000               # rows that a task looks at together
SCORED_ROWS = 10_000              # rows whose scores by all trees are added up together
BROADCAST_BYTES = 128 << 20       # of all subtrees, to broadcast them for scoring

_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])


def _spread(x: np.ndarray) -> np.ndarray:
    """64-bit values spread over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def row_weights(ids: np.ndarray, tree: int, seed: int, bootstrap: bool) -> np.ndarray:
    """How often a tree draws each row."""
    if not bootstrap:
        return np.ones(len(ids), np.int64)
    start = _spread(np.array([(seed * 1_000_003 + tree + 1) & ((1 << 64) - 1)], np.uint64))
    u = _spread(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + start) >> np.uint64(11)
    return np.searchsorted(_POISSON, u / float(1 << 53), side="right")


class FlatTree:
    """Splits on values as arrays; feature -1: a leaf with a row of ``value``."""

    def __init__(self, feature, threshold, left, right, value):
        self.feature, self.threshold = np.asarray(feature, np.int32), np.asarray(threshold, np.float64)
        self.left, self.right, self.value = np.asarray(left, np.int32), np.asarray(right, np.int32), np.asarray(value, np.float64)

    def leaves(self, table: np.ndarray) -> np.ndarray:
        node = np.zeros(len(table), np.int32)
        active = np.arange(len(table)) if self.feature[0] >= 0 else np.empty(0, np.int64)
        while len(active):
            at = node[active]
            node[active] = np.where(table[active, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            active = active[self.feature[node[active]] >= 0]
        return node


def _between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The threshold that parts neighbouring values ``a`` and ``b``."""
    with np.errstate(invalid="ignore"):
        middle = np.where(np.isfinite(b), a + (b - a) / 2, a)
    return np.where((a <= middle) & (middle < b), middle, a)


def exact_tree(table: np.ndarray, weight: np.ndarray, target: np.ndarray, looked_at: int, rng, scale: float = 1.0) -> FlatTree:
    """Grow a tree to its end.  ``table``: feature vectors; ``weight`` and ``target``
    (rows x channels, times ``scale``): the sums over the rows with that vector."""
    values, ranks = zip(*(np.unique(c, return_inverse=True) for c in table.T), strict=True)
    ranks = [r.astype(np.int32) for r in ranks]
    if looked_at < table.shape[1]:
        return _by_node(values, np.column_stack(ranks), weight.astype(np.float64), target / scale, looked_at, rng)
    return _by_level(values, ranks, weight, target, scale)


def _best_of_few(rows: list, drawn: list, ranks: list, both: list, total: list):
    """(feature, rows in its order, rows to the left, sums there) of the best cut, as ``_by_node`` has it by arrays."""
    best, found = None, None
    for f in drawn:
        order = sorted(rows, key=lambda i: ranks[i][f])
        running = [0.0] * len(total)
        for n, (i, j) in enumerate(itertools.pairwise(order), 1):
            running = [x + y for x, y in zip(running, both[i])]
            if ranks[i][f] != ranks[j][f]:
                rest = [x - y for x, y in zip(total, running)]
                gain = sum([x * x for x in running[1:]]) / running[0] + sum([x * x for x in rest[1:]]) / rest[0]
                if best is None or gain > best:
                    best, found = gain, (f, order, n, running, rest)
    return found


def _by_node(values: tuple, ranks: np.ndarray, weight: np.ndarray, target: np.ndarray, looked_at: int, rng) -> FlatTree:
    """``exact_tree`` node by node, as each draws its features from one generator; the many
    nodes of few rows without arrays, whose calls would take longer than their work."""
    kind = np.unique(target / weight[:, None], axis=0, return_inverse=True)[1].ravel()
    both = np.column_stack([weight, target])
    ranks_of, both_of, kind_of = ranks.tolist(), both.tolist(), kind.tolist()
    feature, at_rank, nexts, left, right, sums = [-1], [0], [0], [-1], [-1], [both.sum(0).tolist()]
    todo = [(0, np.arange(len(ranks)))]
    while todo:
        at, rows = todo.pop()
        if len(rows) <= FEW_ROWS:
            rows = rows if isinstance(rows, list) else rows.tolist()
            if len({kind_of[i] for i in rows}) == 1:
                continue
            varies = [f for f, v in enumerate(zip(*[ranks_of[i] for i in rows])) if len(set(v)) > 1]
            if not varies:
                continue
            f, order, n_left, here, there = _best_of_few(rows, sorted(rng.permutation(varies)[:looked_at].tolist()), ranks_of, both_of, sums[at])
            below, above = ranks_of[order[n_left - 1]][f], ranks_of[order[n_left]][f]
            parts = [i for i in rows if ranks_of[i][f] <= below], [i for i in rows if ranks_of[i][f] > below]
        else:
            k = kind[rows]
            if (k == k[0]).all():
                continue
            x = ranks[rows]
            varies = np.flatnonzero((x != x[0]).any(0))
            if not len(varies):
                continue
            varies = np.sort(rng.permutation(varies)[:looked_at])
            x = x[:, varies]
            order = np.argsort(x, axis=0, kind="stable")
            xs = np.take_along_axis(x, order, 0)
            running = np.cumsum(both[rows[order]], 0)[:-1]
            rest = np.array(sums[at]) - running
            gain = (running[..., 1:] ** 2).sum(2) / running[..., 0] + (rest[..., 1:] ** 2).sum(2) / rest[..., 0]
            gain[xs[1:] == xs[:-1]] = -np.inf
            f, cut = divmod(int(gain.T.argmax()), len(rows) - 1)           # first feature, least value
            here, there, below, above = running[cut, f].tolist(), rest[cut, f].tolist(), int(xs[cut, f]), int(xs[cut + 1, f])
            goes_left = x[:, f] <= below
            f, parts = int(varies[f]), (rows[goes_left], rows[~goes_left])
        n = len(feature)
        feature[at], at_rank[at], nexts[at], left[at], right[at] = f, below, above, n, n + 1
        for lists, new in ((feature, (-1, -1)), (at_rank, (0, 0)), (nexts, (0, 0)), (left, (-1, -1)), (right, (-1, -1)), (sums, (here, there))):
            lists += new
        todo += [(child, part) for child, part in zip((n, n + 1), parts) if len(part) > 1]
    feature, at_rank, nexts, threshold = np.array(feature), np.array(at_rank), np.array(nexts), np.zeros(len(feature))
    for f, v in enumerate(values):
        split = feature == f
        threshold[split] = _between(v[at_rank[split]], v[nexts[split]])
    sums = np.array(sums)
    return FlatTree(feature, threshold, left, right, sums[:, 1:] / sums[:, :1])


def _by_level(values: tuple, ranks: list, weight: np.ndarray, target: np.ndarray, scale: float) -> FlatTree:
    """``exact_tree`` where every node looks at all features.

    All nodes of a level are split together: every feature keeps the rows of open nodes
    in order within each node, a node's rows are a stretch in all of them, and lie to
    the left and right halves of the next level in the same order."""
    features, unit = len(ranks), 1 / scale
    orders = [np.argsort(r, kind="stable").astype(np.int32) for r in ranks]
    weight, targets = weight.astype(np.float64), [np.ascontiguousarray(c) for c in target.T]
    means = [t * unit / weight for t in targets]
    to_left, to_right = np.zeros(len(weight), bool), np.zeros(len(weight), bool)
    nodes: list = [[], [], [], [], []]                 # feature, threshold, left, right and value of the nodes of each level

    def level(rows, sizes):
        """Adds nodes with these rows; the places of those that are not pure, their weights and sums."""
        starts = np.cumsum(sizes) - sizes
        w, sums = np.add.reduceat(weight[rows], starts), [np.add.reduceat(t[rows], starts) for t in targets]
        differs = np.zeros(len(sizes), bool)
        for m in means:
            m = m[rows]
            differs |= np.logical_or.reduceat(m != np.repeat(m[starts], sizes), starts)
        k = len(sizes)
        for x, new in zip(nodes, (np.full(k, -1, np.int32), np.zeros(k), np.full(k, -1, np.int32), np.full(k, -1, np.int32),
                                  np.column_stack([x * unit / w for x in sums])), strict=True):
            x.append(new)
        return np.flatnonzero(differs), w[differs], [x[differs] for x in sums]

    def keep(at) -> None:
        nonlocal open_, sizes, w, sums
        open_, sizes, w, sums = open_[at], sizes[at], w[at], [x[at] for x in sums]

    sizes, count = np.array([len(weight)]), 1
    open_, w, sums = level(orders[0], sizes)
    while len(open_):
        starts = np.cumsum(sizes) - sizes
        allowed = np.column_stack([r[o[starts]] != r[o[starts + sizes - 1]] for r, o in zip(ranks, orders, strict=True)])
        able = allowed.any(1)
        if not able.all():                             # equal vectors with other targets stay together
            kept = np.repeat(able, sizes)
            orders, allowed = [o[kept] for o in orders], allowed[able]
            keep(able)
            starts = np.cumsum(sizes) - sizes
            if not len(sizes):
                break
        best, at_feature = np.full(len(sizes), -np.inf), np.full(len(sizes), -1)
        tried: list = [None] * features
        for f in range(features):
            some = np.flatnonzero(allowed[:, f])
            if not len(some):
                continue
            o, own, first = orders[f], sizes, starts
            if len(some) < len(sizes):
                o, own = o[np.repeat(allowed[:, f], sizes)], sizes[some]
                first = np.cumsum(own) - own
            lw = weight[o]
            lw[first[1:]] -= w[some[:-1]]              # the running sum begins anew in each node
            lw = np.cumsum(lw)
            rw = np.repeat(w[some], own) - lw
            last = first + own - 1
            rw[last] = 1
            gain = other = None
            for t, node_sum in zip(targets, sums, strict=True):
                ls = t[o]
                ls[first[1:]] -= node_sum[some[:-1]]
                ls = np.cumsum(ls)
                rs = (np.repeat(node_sum[some], own) - ls) * unit
                ls = ls * unit
                ls *= ls
                rs *= rs
                gain, other = (ls, rs) if gain is None else (gain + ls, other + rs)
            gain /= lw
            other /= rw
            gain += other
            x = ranks[f][o]
            gain[:-1][x[1:] == x[:-1]] = -np.inf
            gain[last] = -np.inf
            most = np.maximum.reduceat(gain, first)
            new = most > best[some]                    # the first feature
            best[some[new]], at_feature[some[new]] = most[new], f
            tried[f] = (o, own, some, gain)
        cut, threshold, rows = np.zeros(len(sizes), np.int32), np.zeros(len(sizes)), orders[0]
        for f in np.unique(at_feature).tolist():
            o, own, some, gain = tried[f]
            won = at_feature[some] == f
            here = np.repeat(won, own)
            o, gain, own, some = o[here], gain[here], own[won], some[won]
            hit = np.flatnonzero(gain == np.repeat(best[some], own))
            of = np.repeat(np.arange(len(own)), own)[hit]
            hit = hit[np.flatnonzero(np.diff(of, prepend=-1))]         # the least value of each node
            cut[some] = ranks[f][o[hit]]
            threshold[some] = _between(values[f][cut[some]], values[f][ranks[f][o[hit + 1]]])
            r = rows[np.repeat(at_feature == f, sizes)]
            to_left[r] = ranks[f][r] <= np.repeat(cut[some], own)
        k = len(sizes)
        for x, new in zip(nodes, (at_feature, threshold, count + np.arange(k), count + k + np.arange(k))):
            x[-1][open_] = new
        count += 2 * k
        side = to_left[rows]
        lefts = np.add.reduceat(side, starts, dtype=np.int64)
        rows, sizes = np.concatenate([rows[side], rows[~side]]), np.concatenate([lefts, sizes - lefts])
        open_, w, sums = level(rows, sizes)
        kept = np.zeros(len(sizes), bool)
        kept[open_] = True
        kept, half = np.repeat(kept, sizes), int(lefts.sum())
        to_left[rows[:half]], to_left[rows[half:]] = kept[:half], False
        to_right[rows[:half]], to_right[rows[half:]] = False, kept[half:]
        sizes = sizes[open_]
        orders = [rows[kept], *(np.concatenate([o[to_left[o]], o[to_right[o]]]) for o in orders[1:])]
    return FlatTree(*(np.concatenate(x) for x in nodes))


class _Top:
    """The upper nodes of one tree as they grow."""

    def __init__(self):
        self.feature, self.threshold, self.left, self.right = [-1], [0.0], [-1], [-1]

    def split(self, at: int, feature: int, threshold: float) -> tuple:
        n = len(self.feature)
        self.feature[at], self.threshold[at], self.left[at], self.right[at] = feature, threshold, n, n + 1
        for x, y in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1)):
            x += [y, y]
        return n, n + 1

    def flat(self) -> FlatTree:
        return FlatTree(self.feature, self.threshold, self.left, self.right, np.zeros((len(self.feature), 1)))

    def as_lists(self) -> list:
        return [self.feature, self.threshold, self.left, self.right]


def _batch(batch, features: int) -> tuple:
    """(ids, table, weights, targets) of an Arrow batch (id, x, w, t); NaN and null become infinity."""
    table = _table(batch.column(1), features)
    targets = batch.column(3)
    channels = len(targets.flatten()) // max(batch.num_rows, 1)
    return (batch.column(0).to_numpy(zero_copy_only=False), np.where(np.isnan(table), np.inf, table),
            batch.column(2).to_numpy(zero_copy_only=False), targets.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, channels))


def _chunks(batches, rows: int):
    """Arrow batches put together, and cut, to ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            held.append(batch.slice(at, rows))
            n += held[-1].num_rows
            if n >= rows:
                yield pa.concat_batches(held)
                held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def _by_root(tree: int, root: np.ndarray, *columns) -> list:
    """(tree, root, rows, bytes of each column there) of one chunk; tables column by column."""
    order = np.argsort(root, kind="stable")
    root = root[order]
    starts = np.flatnonzero(np.diff(root, prepend=-1)).tolist()
    return [(tree, int(root[at]), to - at, *(np.ascontiguousarray(c[order[at:to]].T).tobytes() for c in columns))
            for at, to in zip(starts, [*starts[1:], len(root)], strict=True)]


def _column_wise(pieces: list, counts: list, width: int, kind) -> np.ndarray:
    """The tables of ``_by_root`` put together again: rows x width."""
    return np.concatenate([np.frombuffer(raw, kind).reshape(width, n).T for raw, n in zip(pieces, counts, strict=True)])


class _Grower:
    def __init__(self, rows: DataFrame, features: int, channels: int, p: dict):
        self.rows, self.features, self.channels, self.p = rows, features, channels, p
        self.tops = [_Top() for _ in range(p["trees"])]

    def looked_at(self) -> int:
        return max(1, int(math.sqrt(self.features))) if self.p["sqrt"] else self.features

    def grow_tops(self, n: int) -> None:
        """Split every node of more than ``finish`` rows, all trees at once."""
        if n <= self.p["finish"]:
            return
        cuts = find_cuts(self.rows.select("x"), self.features)
        todo = [(tree, 0, cuts, False) for tree in range(len(self.tops))]
        while todo:
            now, todo = todo[:NODES_A_PASS], todo[NODES_A_PASS:]
            stuck = []
            for (tree, at, own, again), (rows, weight, target) in zip(now, self._histograms(now), strict=True):
                if rows <= self.p["finish"]:
                    continue
                split = self._split(tree, at, own, weight, target)
                if split is None:
                    if not again:
                        stuck.append((tree, at))
                    continue
                for child in self.tops[tree].split(at, *split):
                    todo.append((tree, child, own, again))
            for tree, at in self._that_differ(stuck):
                finer = find_cuts(self._rows_of(tree, at), self.features)
                if any(len(c) for c in finer):
                    todo.append((tree, at, finer, True))

    def _that_differ(self, nodes: list) -> list:
        """Those of ``nodes`` (tree, node) whose rows are not all of one vector, by one pass."""
        if not nodes:
            return []
        features, p = self.features, self.p
        flats = {tree: self.tops[tree].flat() for tree, _ in nodes}
        of_tree: dict = {}
        for slot, (tree, at) in enumerate(nodes):
            of_tree.setdefault(tree, []).append((at, slot))

        def scan(batches):
            least, most = np.full((len(nodes), features), np.inf), np.full((len(nodes), features), -np.inf)
            for batch in _chunks(batches, CHUNK_ROWS):
                ids, table, _, _ = _batch(batch, features)
                for tree, wanted in of_tree.items():
                    slots = np.full(len(flats[tree].feature), -1)
                    slots[[at for at, _ in wanted]] = [slot for _, slot in wanted]
                    slot = slots[flats[tree].leaves(table)]
                    rows = np.flatnonzero((slot >= 0) & (row_weights(ids, tree, p["seed"], p["bootstrap"]) > 0))
                    if not len(rows):
                        continue
                    rows = rows[np.argsort(slot[rows], kind="stable")]
                    starts = np.flatnonzero(np.diff(slot[rows], prepend=-1))
                    here = slot[rows[starts]]
                    least[here] = np.minimum(least[here], np.minimum.reduceat(table[rows], starts))
                    most[here] = np.maximum(most[here], np.maximum.reduceat(table[rows], starts))
            n, some = np.nonzero(least <= most)
            yield pa.RecordBatch.from_arrays([pa.array(n * features + some, pa.int64()), pa.array(least[n, some]), pa.array(most[n, some])],
                                             names=["place", "least", "most"])

        found = self.rows.mapInArrow(scan, "place long, least double, most double").groupBy("place").agg(
            F.min("least").alias("least"), F.max("most").alias("most")).where("least <> most")
        differ = {r.slot for r in found.select(F.expr(f"place div {features}").alias("slot")).distinct().collect()}      # at most NODES_A_PASS
        return [node for slot, node in enumerate(nodes) if slot in differ]

    def _rows_of(self, tree: int, at: int) -> DataFrame:
        flat, features, p = self.tops[tree].flat(), self.features, self.p

        def scan(batches):
            for batch in batches:
                ids, table, _, _ = _batch(batch, features)
                here = (flat.leaves(table) == at) & (row_weights(ids, tree, p["seed"], p["bootstrap"]) > 0)
                yield pa.RecordBatch.from_arrays([batch.column(1).filter(pa.array(here))], names=["x"])

        return self.rows.mapInArrow(scan, "x array<double>")

    def _histograms(self, nodes: list) -> list:
        """(rows, weights: features x bins, targets: features x bins x channels) of each node."""
        features, channels, p = self.features, self.channels, self.p
        flats = {tree: self.tops[tree].flat() for tree, *_ in nodes}
        of_tree: dict = {}
        of_cuts = {id(own): own for _, _, own, _ in nodes}
        for slot, (tree, at, own, _) in enumerate(nodes):                    # nodes of a tree with the same cuts are summed together
            of_tree.setdefault(tree, {}).setdefault(id(own), []).append((at, slot))
        width = features * (BINS + 1)
        column = np.arange(features, dtype=np.int64) * (BINS + 1)

        def scan(batches):
            sums = np.zeros((channels + 1, len(nodes) * width), np.int64)
            entries = np.zeros(len(nodes), np.int64)
            for batch in _chunks(batches, CHUNK_ROWS):
                ids, table, own_weight, target = _batch(batch, features)
                bins = {key: np.column_stack([np.searchsorted(own[f], table[:, f], side="left") for f in range(features)]) + column
                        for key, own in of_cuts.items()}
                for tree, by_cuts in of_tree.items():
                    weight = row_weights(ids, tree, p["seed"], p["bootstrap"])
                    leaf = flats[tree].leaves(table)
                    for key, wanted in by_cuts.items():
                        slots = np.full(len(flats[tree].feature), -1)
                        slots[[at for at, _ in wanted]] = [slot for _, slot in wanted]
                        rows = np.flatnonzero((slots[leaf] >= 0) & (weight > 0))
                        slot, w = slots[leaf[rows]], weight[rows].astype(np.int64)
                        entries += np.bincount(slot, minlength=len(nodes))
                        place = (bins[key][rows] + (slot * width)[:, None]).ravel()
                        for c, values in enumerate([w * own_weight[rows], *[target[rows, c] * w for c in range(channels)]]):
                            np.add.at(sums[c], place, np.repeat(values, features))
            for slot in np.flatnonzero(entries).tolist():
                raw = np.ascontiguousarray(sums[:, slot * width:(slot + 1) * width])
                yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([entries[slot]], pa.int64()),
                                                  pa.array([zstandard.compress(raw.tobytes(), 1)], pa.binary())], names=["slot", "n", "sums"])

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(zstandard.decompress(raw), np.int64) for raw in table["sums"].to_pylist())
            return pa.table({"slot": table["slot"][:1], "n": pa.array([sum(table["n"].to_pylist())], pa.int64()),
                             "sums": pa.array([zstandard.compress(total.tobytes(), 1)], pa.binary())})

        kind = "slot int, n long, sums binary"
        none = np.zeros((channels + 1, features, BINS + 1), np.int64)
        out = [(0, none[0], np.moveaxis(none[1:], 0, 2))] * len(nodes)
        for r in self.rows.mapInArrow(scan, kind).groupBy("slot").applyInArrow(add, kind).toLocalIterator():    # at most NODES_A_PASS histograms
            x = np.frombuffer(zstandard.decompress(r.sums), np.int64).reshape(none.shape)
            out[r.slot] = (r.n, x[0], np.moveaxis(x[1:], 0, 2))
        return out

    def _split(self, tree: int, at: int, cuts: list, weight: np.ndarray, target: np.ndarray):
        usable = [f for f in range(self.features) if len(cuts[f]) and np.count_nonzero(weight[f]) > 1]
        if len(usable) > self.looked_at():
            rng = np.random.default_rng([self.p["seed"], tree, at])
            usable = sorted(rng.permutation(usable)[:self.looked_at()].tolist())
        best = None
        for f in usable:
            lw = np.cumsum(weight[f])[:len(cuts[f])].astype(np.float64)
            ls = np.cumsum(target[f], 0)[:len(cuts[f])].astype(np.float64)
            w, s = float(weight[f].sum()), target[f].sum(0).astype(np.float64)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = (ls ** 2).sum(1) / lw + ((s - ls) ** 2).sum(1) / (w - lw)
            gain[(lw == 0) | (lw == w)] = -np.inf
            i = int(np.argmax(gain))
            if np.isfinite(gain[i]) and (best is None or gain[i] > best[0] * (1 + 1e-12)):
                best = (float(gain[i]), f, float(cuts[f][i]))
        return best and best[1:]

    def finish(self) -> DataFrame:
        """(tree, root, feature, threshold, left, right, value): the subtree below each leaf of the tops."""
        features, channels, p, looked_at = self.features, self.channels, self.p, self.looked_at()
        flats = [top.flat() for top in self.tops]
        kind = pa.schema([("tree", pa.int32()), ("root", pa.int32()), ("n", pa.int32()), ("x", pa.binary()), ("w", pa.binary()), ("t", pa.binary())])

        def deal(batches):
            for batch in _chunks(batches, CHUNK_ROWS):
                ids, table, own_weight, target = _batch(batch, features)
                _, first, vector = np.unique(np.ascontiguousarray(table + 0.0).view(f"V{8 * features}").ravel(), return_index=True, return_inverse=True)
                order = np.argsort(vector, kind="stable")                   # rows of a vector together
                ids, own_weight, target, table = ids[order], own_weight[order], target[order], table[first]
                starts = np.flatnonzero(np.diff(vector[order], prepend=-1))
                for tree, flat in enumerate(flats):
                    draws = row_weights(ids, tree, p["seed"], p["bootstrap"])
                    weight = np.add.reduceat(own_weight * draws, starts)
                    rows = np.flatnonzero(weight)
                    if len(rows):
                        found = _by_root(tree, flat.leaves(table[rows]), table[rows], weight[rows],
                                         np.add.reduceat(target * draws[:, None], starts)[rows])
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), kind, strict=True)], schema=kind)

        dealt = self.rows.mapInArrow(deal, "tree int, root int, n int, x binary, w binary, t binary")

        def grow(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            counts = table["n"].to_pylist()
            x, w, t = (_column_wise(table[c].to_pylist(), counts, width, kind)
                       for c, width, kind in (("x", features, np.float64), ("w", 1, np.int64), ("t", channels, np.int64)))
            rng = np.random.default_rng([p["seed"], key[0].as_py(), key[1].as_py()])
            order = np.lexsort((t[:, 0], *x.T))                              # whatever the order in which the pieces came
            x, w, t = x[order], w[order, 0], t[order]
            first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]).any(1)))
            t = exact_tree(x[first], np.add.reduceat(w, first), np.add.reduceat(t, first), looked_at, rng, p["scale"])
            return pa.table({"tree": pa.array([key[0].as_py()], pa.int32()), "root": pa.array([key[1].as_py()], pa.int32()),
                             **{c: pa.array([getattr(t, c).tobytes()], pa.binary()) for c in ("feature", "threshold", "left", "right", "value")}})

        return dealt.groupBy("tree", "root").applyInArrow(
            grow, "tree int, root int, feature binary, threshold binary, left binary, right binary, value binary")


def _read(row, channels: int) -> FlatTree:
    return FlatTree(np.frombuffer(row["feature"], np.int32), np.frombuffer(row["threshold"], np.float64), np.frombuffer(row["left"], np.int32),
                    np.frombuffer(row["right"], np.int32), np.frombuffer(row["value"], np.float64).reshape(-1, channels))


class _ForestParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed):
    trees = Param(Params._dummy(), "trees", "number of trees", TypeConverters.toInt)
    classes = Param(Params._dummy(), "classes", "whether the label is a class index", TypeConverters.toBoolean)
    bootstrap = Param(Params._dummy(), "bootstrap", "whether a tree draws its rows", TypeConverters.toBoolean)
    finishRows = Param(Params._dummy(), "finishRows", "rows of a node that one task finishes", TypeConverters.toInt)


class GrownForest(Estimator, _ForestParams, DefaultParamsReadable, DefaultParamsWritable):
    """Regression looks at all features in every node, classification (``classes``) at
    the square root of their number."""

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", labelCol: str = "label", predictionCol: str = "prediction", seed: int = 42,
                 trees: int = 200, classes: bool = False, bootstrap: bool = True, finishRows: int = FINISH_ROWS):
        super().__init__()
        self._set(**{**dict(featuresCol=featuresCol, labelCol=labelCol, predictionCol=predictionCol, seed=seed, trees=trees, classes=classes,
                            bootstrap=bootstrap, finishRows=finishRows), **self._input_kwargs})

    def _fit(self, dataset: DataFrame) -> GrownForestModel:
        classes = self.getOrDefault("classes")
        rows = dataset.select(vector_to_array(self.getOrDefault("featuresCol")).alias("x"),
                              F.col(self.getOrDefault("labelCol")).cast("double").alias("y")).where("y is not null and not isnan(y)")
        n, low, high, features = rows.agg(F.count(F.lit(1)), F.min("y"), F.max("y"), F.max(F.size("x"))).first()
        if not n:
            raise ValueError("no rows with a label")
        channels = int(high) + 1 if classes else 1
        reach = max(abs(low), abs(high), 1e-9)
        # targets are integers, so that their sums are the same in any order
        scale = 1.0 if classes else 2.0 ** min(40, 60 - math.ceil(math.log2(reach)) - math.ceil(math.log2(n) + 2))
        target = F.array(*[(F.col("y") == i).cast("long") for i in range(channels)]) if classes else F.array(F.round(F.col("y") * scale).cast("long"))
        bootstrap = self.getOrDefault("bootstrap")
        entries = rows.select("x", F.lit(1).cast("long").alias("w"), target.alias("t"))
        if not bootstrap:                                                   # no draws tell equal vectors apart
            entries = entries.groupBy("x").agg(F.sum("w").alias("w"), F.array(*[F.sum(F.col("t")[i]) for i in range(channels)]).alias("t"))
        held = materialize(entries.select(F.monotonically_increasing_id().alias("id"), "x", "w", "t"))
        p = {"trees": self.getOrDefault("trees"), "seed": self.getOrDefault("seed") & ((1 << 32) - 1), "bootstrap": bootstrap,
             "finish": self.getOrDefault("finishRows"), "sqrt": classes, "scale": scale}
        grower = _Grower(held, features, channels, p)
        grower.grow_tops(n if bootstrap else held.count())
        path = f"{checkpoint_dir(dataset.sparkSession).rstrip('/')}/tables/{self.uid}-{np.random.default_rng().integers(1 << 62):x}"
        grower.finish().write.parquet(path)
        return GrownForestModel(tops=json.dumps([t.as_lists() for t in grower.tops]), path=path, channels=channels)._set(
            **{c: self.getOrDefault(c) for c in ("featuresCol", "labelCol", "predictionCol", "classes")})


class _ForestWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        self.instance.subtrees(self.sparkSession).write.parquet(f"{path.rstrip('/')}/subtrees")


class GrownForestModel(Model, _ForestParams, DefaultParamsReadable, DefaultParamsWritable):
    tops = Param(Params._dummy(), "tops", "upper nodes of each tree, as JSON", TypeConverters.toString)
    path = Param(Params._dummy(), "path", "table of subtrees", TypeConverters.toString)
    channels = Param(Params._dummy(), "channels", "targets: classes, or one", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, tops: str = "[]", path: str = "", channels: int = 1):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", classes=False)
        self._set(**self._input_kwargs)

    def write(self) -> DefaultParamsWriter:
        return _ForestWriter(self)

    @classmethod
    def load(cls, path: str) -> GrownForestModel:
        return cls.read().load(path)._set(path=f"{path.rstrip('/')}/subtrees")

    def setPredictionCol(self, value: str) -> GrownForestModel:
        return self._set(predictionCol=value)

    def subtrees(self, spark) -> DataFrame:
        return spark.read.parquet(self.getOrDefault("path"))

    def _flat_tops(self) -> list:
        return [FlatTree(f, t, le, r, np.zeros((len(f), 1))) for f, t, le, r in json.loads(self.getOrDefault("tops"))]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        table = self.subtrees(dataset.sparkSession)
        parts = ("feature", "threshold", "left", "right", "value")
        size = table.agg(F.sum(sum((F.octet_length(c) for c in parts), F.lit(0)))).first()[0] or 0
        means = self._broadcast_scores(dataset, table) if size <= BROADCAST_BYTES else self._dealt_scores(dataset, table)
        value = F.col("_means")[0]
        if self.getOrDefault("classes"):
            value = (F.array_position("_means", F.array_max("_means")) - 1).cast("double")
        return means.withColumn(self.getOrDefault("predictionCol"), value).drop("_means")

    def _broadcast_scores(self, dataset: DataFrame, table: DataFrame) -> DataFrame:
        channels, tops = self.getOrDefault("channels"), self._flat_tops()
        below: dict = {(r.tree, r.root): _read(r.asDict(), channels) for r in table.collect()}        # at most BROADCAST_BYTES
        shared = dataset.sparkSession.sparkContext.broadcast((tops, below))

        @F.pandas_udf("array<double>")
        def score(x: pd.Series) -> pd.Series:
            tops, below = shared.value
            out: list = [None] * len(x)
            some = np.flatnonzero(x.notna().to_numpy())
            if len(some):
                rows = np.stack(x.iloc[some].to_list()).astype(np.float64)
                rows = np.where(np.isnan(rows), np.inf, rows)
                total = np.zeros((len(some), channels))
                for tree, top in enumerate(tops):
                    root = top.leaves(rows)
                    for r in np.unique(root).tolist():
                        here = np.flatnonzero(root == r)
                        t = below[tree, r]
                        total[here] += t.value[t.leaves(rows[here])]
                for i, v in zip(some.tolist(), (total / len(tops)).tolist(), strict=True):
                    out[i] = v
            return pd.Series(out)

        return dataset.withColumn("_means", score(vector_to_array(self.getOrDefault("featuresCol"))))

    def _dealt_scores(self, dataset: DataFrame, table: DataFrame) -> DataFrame:
        channels, tops = self.getOrDefault("channels"), self._flat_tops()
        data = materialize(dataset.withColumn("_fid", F.monotonically_increasing_id()))
        rows = data.select("_fid", vector_to_array(self.getOrDefault("featuresCol")).alias("x")).where("x is not null")

        kind = pa.schema([("tree", pa.int32()), ("root", pa.int32()), ("n", pa.int32()), ("fid", pa.binary()), ("x", pa.binary()), ("block", pa.int64())])

        def place(with_rows):
            def scan(batches):
                for batch in _chunks(batches, SCORED_ROWS):
                    fid = batch.column(0).to_numpy(zero_copy_only=False)
                    x = _table(batch.column(1), len(batch.column(1).flatten()) // batch.num_rows)
                    x = np.where(np.isnan(x), np.inf, x)
                    for tree, top in enumerate(tops):
                        found = _by_root(tree, top.leaves(x), *((fid, x) if with_rows else ()))
                        found = [(*r, int(fid[0])) if with_rows else (*r, None, None, int(fid[0])) for r in found]
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), kind, strict=True)], schema=kind)

            return rows.mapInArrow(scan, "tree int, root int, n int, fid binary, x binary, block long")

        copies = materialize(place(False).groupBy("tree", "root").agg(F.ceil(F.sum("n") / F.lit(FINISH_ROWS)).cast("long").alias("copies")))
        salted = place(True).join(copies, ["tree", "root"]).withColumn("salt", F.pmod(F.xxhash64("block"), "copies")).drop("copies")
        trees = table.join(copies, ["tree", "root"]).withColumn("salt", F.explode(F.expr("sequence(0L, copies - 1)"))).drop("copies")

        def score(left: pa.Table, right: pa.Table) -> pa.Table:
            out = []
            if len(left):
                t = _read(right.to_pylist()[0], channels)
                for n, raw in zip(left["n"].to_pylist(), left["x"].to_pylist(), strict=True):
                    x = np.frombuffer(raw, np.float64).reshape(-1, n).T
                    out.append(t.value[t.leaves(x)].tobytes())
            return pa.table([left["block"], left["tree"], left["root"], left["fid"], pa.array(out, pa.binary())], names=["block", "tree", "root", "fid", "v"])

        def add(table: pa.Table) -> pa.Table:
            table = table.sort_by([("tree", "ascending"), ("root", "ascending")])
            fids = np.concatenate([np.frombuffer(raw, np.int64) for raw in table["fid"].to_pylist()])
            v = np.concatenate([np.frombuffer(raw, np.float64) for raw in table["v"].to_pylist()]).reshape(len(fids), channels)
            fid, row = np.unique(fids, return_inverse=True)
            total = np.column_stack([np.bincount(row, v[:, c], len(fid)) for c in range(channels)]) / len(tops)
            return pa.table({"_fid": pa.array(fid), "_means": pa.array(total.tolist(), pa.list_(pa.float64()))})

        key = ["tree", "root", "salt"]
        scored = salted.groupBy(*key).cogroup(trees.groupBy(*key)).applyInArrow(score, "block long, tree int, root int, fid binary, v binary")
        means = scored.groupBy("block").applyInArrow(add, "_fid long, _means array<double>")
        return data.join(means, "_fid", "left").drop("_fid")
