"""Boosted regression trees from distributed histograms (M6, M7).

``DepthwiseBooster`` grows level by level with second-order gains and Newton
leaves, ``LeafwiseBooster`` best first up to a number of leaves.  Both fit the
squared error (gradient: prediction minus label; hessian: 1) and learn the side
on which missing values go.  What is distributed:

* *Cuts.*  A feature with at most ``BINS`` distinct values is cut between any
  two neighbours; another at the quantiles of a sketch.  Rows are written once
  with one byte a feature and the margin so far.
* *Histograms.*  A pass over the rows sums gradients and hessians by (leaf,
  feature, bin): inside a task with numpy, over the tasks as one grouped sum, so
  what reaches the driver is leaves x features x bins, whatever the rows.  Of two
  siblings only the one with fewer rows is summed; the other is the parent's
  histogram less that one.
* *Growth.*  Both boosters keep a queue of leaves by gain.  A pass asks for the
  histograms of the children of all leaves that the queue would split as far as
  known, not of one leaf; a split is only made final when all that come before it
  are known, so the trees are those of one split at a time.

Gradients are rounded to multiples of a power of two and summed as integers: a
sum is the same in any order, so a task that runs again gives the same tree.
Ties take the first feature, then the least cut, then missing values to the right.

The binned rows lie as arrays in cached blocks, one a task; a pass is one job that
reads them and returns the tasks' sums.  Margins move on with each tree, inside the
next tree's first pass, and every ``KEPT_TREES`` trees the blocks are checkpointed.
At most ``HELD_ROWS`` rows, which are one block, are grown by the task that holds
them, without a job for each pass.  Rows with a null label are left out; no rows
are an error, as for other estimators; a constant label gives a constant model.
"""

from __future__ import annotations

import heapq
import json
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml.base import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.session import checkpoint_dir

BINS = 255                # bins of a feature; one more holds missing values
MISSING = 255
KEPT_TREES = 10           # trees from one checkpoint of the rows to the next
HELD_ROWS = 50_000        # rows of a block, at least; as many are grown in one task
BLOCK_ROWS = 1_000_000    # rows of a block, at most, about
COLLECTED_BLOCKS = 64     # blocks whose sums go to the driver as they are; of more, sums are added up on the way


# ---------------------------------------------------------------- cuts and bins

def find_cuts(rows: DataFrame, features: int) -> list:
    """Per feature the sorted cuts: a value goes left of a cut if it is not greater.
    ``rows``: x (array<double>; null and NaN are missing)."""

    def scan(batches):
        seen: list = [set() for _ in range(features)]
        for batch in batches:
            table = _table(batch.column(0), features)
            for f in range(features):
                if seen[f] is not None:
                    seen[f].update(np.unique(table[~np.isnan(table[:, f]), f]).tolist())
                    if len(seen[f]) > BINS:
                        seen[f] = None
        out = [(f, v) for f in range(features) for v in (sorted(seen[f]) if seen[f] is not None else [None])]
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in out], pa.int32()), pa.array([v for _, v in out], pa.float64())],
                                         names=["f", "v"])

    found = rows.select("x").mapInArrow(scan, "f int, v double").distinct()
    found = found.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("v").isNull().cast("int")).alias("many"),
                                   F.slice(F.sort_array(F.collect_list("v")), 1, BINS + 1).alias("v"))
    few = {r.f: r.v for r in found.where((F.col("many") == 0) & (F.col("n") <= BINS)).collect()}
    many = [f for f in range(features) if f not in few]
    cuts: list = [np.empty(0)] * features
    for f, values in few.items():
        v = np.array(values, float)
        cuts[f] = v[:-1] + (v[1:] - v[:-1]) / 2
    if many:
        ps = [i / BINS for i in range(1, BINS)]
        clean = [F.when(~F.isnan(F.col("x")[f]), F.col("x")[f]) for f in many]
        row = rows.agg(*[F.percentile_approx(c, ps, 10_000).alias(f"q{f}") for f, c in zip(many, clean, strict=True)],
                       *[F.max(c).alias(f"m{f}") for f, c in zip(many, clean, strict=True)]).first()
        for f in many:
            q = np.unique(np.array(row[f"q{f}"] or [], float))
            cuts[f] = q[q < row[f"m{f}"]] if len(q) else q
    return cuts


def _table(column, features: int) -> np.ndarray:
    """rows x features of an Arrow list column; null is NaN."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, features)


def binned(table: np.ndarray, cuts: list) -> np.ndarray:
    out = np.empty(table.shape, np.uint8)
    for f, c in enumerate(cuts):
        out[:, f] = np.searchsorted(c, table[:, f], side="left")
        out[np.isnan(table[:, f]), f] = MISSING
    return out


# ---------------------------------------------------------------- trees

class Tree:
    """Nodes as arrays; feature -1: a leaf.  ``cut``: the last bin that goes left."""

    def __init__(self, feature=(-1,), cut=(0,), missing_left=(False,), left=(-1,), right=(-1,), value=(0.0,)):
        self.feature, self.cut = np.array(feature, np.int32), np.array(cut, np.int32)
        self.missing_left = np.array(missing_left, bool)
        self.left, self.right, self.value = np.array(left, np.int32), np.array(right, np.int32), np.array(value, np.float64)

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        node = np.zeros(len(bins), np.int32)
        active = np.arange(len(bins)) if self.feature[0] >= 0 else np.empty(0, np.int64)
        while len(active):
            node[active] = self.down(node[active], bins, active)
            active = active[self.feature[node[active]] >= 0]
        return node

    def down(self, at: np.ndarray, bins: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The child of node ``at`` to which each of the ``rows`` goes."""
        b = bins[rows, self.feature[at]]
        goes_left = np.where(b == MISSING, self.missing_left[at], b <= self.cut[at])
        return np.where(goes_left, self.left[at], self.right[at])

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(bins)]

    def as_lists(self) -> list:
        return [x.tolist() for x in (self.feature, self.cut, self.missing_left, self.left, self.right, self.value)]


class _Node:
    def __init__(self, depth: int, g: float, h: int):
        self.depth, self.g, self.h = depth, g, h
        self.sums = None              # (gradients, hessians), features x (bins + missing)
        self.split = None             # (gain, feature, cut, missing left, left g, left h), None: no split
        self.known = False            # whether ``split`` is decided
        self.children = None


class _Block:
    """Binned rows of one task: column by column, with label and margin."""

    def __init__(self, bins: np.ndarray, y: np.ndarray, base: float, scale: float):
        self.bins, self.y, self.scale = np.ascontiguousarray(bins.T), y, scale
        self.margin = np.full(len(y), base)

    def summed(self, tree: Tree, wanted: list) -> tuple:
        """(place, gradients, hessians) of the ``wanted`` leaves of the growing tree: places of leaf, feature and bin with rows."""
        features, size = len(self.bins), len(wanted) * (BINS + 1)
        slot = np.full(len(tree.feature), -1)
        slot[wanted] = np.arange(len(wanted))
        at = slot[tree.leaves(self.bins.T)]
        g, h = np.zeros((features, size), np.int64), np.zeros((features, size), np.int64)
        rows = np.flatnonzero(at >= 0)
        for i in range(0, len(rows), 1 << 16):                               # the sums of a step are exact: below 2^53
            some = rows[i:i + (1 << 16)]
            start, gradient = at[some] * (BINS + 1), np.rint((self.margin[some] - self.y[some]) * self.scale)
            for f in range(features):
                place = start + self.bins[f, some]
                g[f] += np.bincount(place, gradient, minlength=size).astype(np.int64)
                h[f] += np.bincount(place, minlength=size)
        some = np.flatnonzero(h)
        return some, g.ravel()[some], h.ravel()[some]

    def histograms(self, tree: Tree, wanted: list) -> dict:
        return _by_leaf([self.summed(tree, wanted)], wanted, len(self.bins))

    def add(self, tree: Tree) -> _Block:
        """The block after one more tree."""
        new = _Block.__new__(_Block)
        new.bins, new.y, new.scale, new.margin = self.bins, self.y, self.scale, self.margin + tree.predict(self.bins.T)
        return new


def _by_leaf(sums: list, wanted: list, features: int) -> dict:
    """leaf -> (gradients, hessians), features x (bins + missing), of the tasks' sums."""
    shape = (features, len(wanted), BINS + 1)
    g, h = np.zeros(math.prod(shape), np.int64), np.zeros(math.prod(shape), np.int64)
    for place, their_g, their_h in sums:
        g[place] += their_g
        h[place] += their_h
    return {leaf: (x, y) for leaf, x, y in zip(wanted, g.reshape(shape).swapaxes(0, 1), h.reshape(shape).swapaxes(0, 1), strict=True)}


def _added(a: tuple, b: tuple) -> tuple:
    place, at = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    g, h = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    np.add.at(g, at, np.concatenate([a[1], b[1]]))
    np.add.at(h, at, np.concatenate([a[2], b[2]]))
    return place, g, h


def _dealt(rows: DataFrame, cuts: list, tasks: int) -> DataFrame:
    """(bins, y): the binned rows (x, y) dealt to ``tasks`` tasks."""
    features = len(cuts)

    def scan(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([_binary(binned(_table(batch.column(0), features), cuts)), batch.column(1)], names=["bins", "y"])

    return rows.select("x", "y").mapInArrow(scan, "bins binary, y double").repartition(tasks)


def _joined(bins: list, y: list, features: int, base: float, scale: float) -> _Block:
    return _Block(np.frombuffer(b"".join(bins), np.uint8).reshape(-1, features), np.frombuffer(b"".join(y), np.float64), base, scale)


class _Rows:
    """The blocks at the margins of the trees so far and the passes over them."""

    def __init__(self, rows: DataFrame, cuts: list, base: float, scale: float, tasks: int):
        features = self.features = len(cuts)
        self.scale, self.trees = scale, 0
        checkpoint_dir(rows.sparkSession)

        def pack(batches):
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"bins": [b"".join(batch.column(0).to_pylist())],
                                                  "y": [batch.column(1).to_numpy(zero_copy_only=False).tobytes()]})

        def block(packed):
            packed = list(packed)
            return [_joined([bytes(r.bins) for r in packed], [bytes(r.y) for r in packed], features, base, scale)]

        self.before = None
        self.blocks = _dealt(rows, cuts, tasks).mapInArrow(pack, "bins binary, y binary").rdd.mapPartitions(block)
        self.blocks.persist(StorageLevel.MEMORY_AND_DISK).checkpoint()

    def histograms(self, tree: Tree, wanted: list) -> dict:
        """leaf -> (gradients, hessians) of the ``wanted`` leaves of the growing tree."""
        sums = self.blocks.map(lambda block: block.summed(tree, wanted))
        found = sums.collect() if sums.getNumPartitions() <= COLLECTED_BLOCKS else [sums.treeReduce(_added)]     # leaves x features x bins a task
        if self.before is not None:
            self.before.unpersist()
            self.before = None
        return _by_leaf(found, wanted, self.features)

    def add(self, tree: Tree) -> _Rows:
        self.trees += 1
        self.before, self.blocks = self.blocks, self.blocks.map(lambda block: block.add(tree)).persist(StorageLevel.MEMORY_AND_DISK)
        if self.trees % KEPT_TREES == 0:
            self.blocks.checkpoint()
        return self

    def free(self) -> None:
        self.blocks.unpersist()
        if self.before is not None:
            self.before.unpersist()


def grow_in_task(rows: DataFrame, cuts: list, base: float, scale: float, p: dict, rounds: int) -> list:
    """The trees of all rounds, grown by the task that holds the one block (at most ``HELD_ROWS`` rows)."""
    features = len(cuts)

    def grow(batches):
        parts = [(b"".join(b.column(0).to_pylist()), b.column(1).to_numpy(zero_copy_only=False).tobytes()) for b in batches]
        trees = _grown(_joined([x for x, _ in parts], [y for _, y in parts], features, base, scale), cuts, p, rounds)
        yield pa.RecordBatch.from_pydict({"trees": [json.dumps([t.as_lists() for t in trees])]})

    return [Tree(*t) for t in json.loads(_dealt(rows, cuts, 1).mapInArrow(grow, "trees string").first().trees)]


def _grown(rows, cuts: list, p: dict, rounds: int) -> list:
    trees = []
    for _ in range(rounds):
        trees.append(_Growing(rows, cuts, p).grow())
        rows = rows.add(trees[-1])
    return trees


def _binary(bins: np.ndarray) -> pa.Array:
    n, width = bins.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, max(width, 1), dtype=np.int32)[:n + 1].tobytes()),
                                                  pa.py_buffer(np.ascontiguousarray(bins).tobytes())])


# ---------------------------------------------------------------- growth

def best_split(sums, cuts: list, scale: float, l2: float, least_hessian: float, least_rows: int, least_gain: float):
    """(gain, feature, cut, missing left, left gradient, left hessian) of a node's best split, or None."""
    g, h = sums[0].astype(np.float64) / scale, sums[1].astype(np.float64)
    total_g, total_h = g[0].sum(), h[0].sum()                # every feature's bins hold all rows
    best = None
    for f, c in enumerate(cuts):
        if not len(c):
            continue
        left_g, left_h = np.cumsum(g[f, :len(c)]), np.cumsum(h[f, :len(c)])
        for missing_left in (False, True) if h[f, MISSING] else (False,):
            lg, lh = (left_g + g[f, MISSING], left_h + h[f, MISSING]) if missing_left else (left_g, left_h)
            rg, rh = total_g - lg, total_h - lh
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = 0.5 * (lg ** 2 / (lh + l2) + rg ** 2 / (rh + l2) - total_g ** 2 / (total_h + l2))
            least = max(least_hessian, least_rows, 1)
            gain[(lh < least) | (rh < least)] = -np.inf
            at = int(np.argmax(gain))
            if gain[at] > least_gain and (best is None or gain[at] > best[0] * (1 + 1e-12)):
                best = (float(gain[at]), f, at, missing_left, float(lg[at]), float(lh[at]))
    return best


class _Growing:
    """One tree: a queue of leaves by gain, run again from the root after each pass."""

    def __init__(self, rows: _Rows | _Block, cuts: list, p: dict):
        self.rows, self.cuts, self.p = rows, cuts, p
        self.nodes: list = []

    def decide(self, node: _Node, sums) -> None:
        p = self.p
        node.sums, node.known = sums, True
        node.split = best_split(sums, self.cuts, self.rows.scale, p["l2"], p["least_hessian"], p["least_rows"], p["least_gain"])

    def order(self) -> tuple:
        """(nodes in the order in which the queue splits them, those of them whose children are not known yet)."""
        done, unknown = [], []
        queue = [(-self.nodes[0].split[0], 0)] if self.nodes[0].split else []
        while queue and len(done) < self.p["leaves"] - 1:
            _, i = heapq.heappop(queue)
            done.append(i)
            node = self.nodes[i]
            if node.children is None:
                gain, f, cut, missing_left, lg, lh = node.split
                node.children = (len(self.nodes), len(self.nodes) + 1)
                for g, h in ((lg, lh), (node.g - lg, node.h - lh)):
                    child = _Node(node.depth + 1, g, h)
                    child.known = child.depth == self.p["depth"]           # the last level is not split
                    self.nodes.append(child)
            for c in node.children:
                child = self.nodes[c]
                if not child.known:
                    unknown.append(i)
                elif child.split:
                    heapq.heappush(queue, (-child.split[0], c))
        return done, list(dict.fromkeys(unknown))

    def tree(self, done: list) -> Tree:
        """The nodes split so far as a tree whose leaves are numbered as the nodes are."""
        n = len(self.nodes)
        t = Tree(*[np.full(n, x) for x in (-1, 0, False, -1, -1, 0.0)])
        for i in done:
            _, t.feature[i], t.cut[i], t.missing_left[i], _, _ = self.nodes[i].split
            t.left[i], t.right[i] = self.nodes[i].children
        for i, node in enumerate(self.nodes):
            t.value[i] = -self.p["step"] * node.g / (node.h + self.p["l2"]) if node.h + self.p["l2"] else 0.0
        return t

    def grow(self) -> Tree:
        sums = self.rows.histograms(Tree(), [0])[0]
        root = _Node(0, float(sums[0][0].sum()) / self.rows.scale, float(sums[1][0].sum()))
        self.nodes = [root]
        if self.p["depth"] > 0:
            self.decide(root, sums)
        while True:
            done, unknown = self.order()
            if not unknown:
                return _without_unused(self.tree(done))
            fewer = {}
            for i in unknown:
                a, b = self.nodes[i].children
                fewer[i] = (a, b) if self.nodes[a].h <= self.nodes[b].h else (b, a)
            found = self.rows.histograms(self.tree(done), [fewer[i][0] for i in unknown])
            for i in unknown:
                small, large = fewer[i]
                parent = self.nodes[i].sums
                self.decide(self.nodes[small], found[small])
                self.decide(self.nodes[large], (parent[0] - found[small][0], parent[1] - found[small][1]))
                self.nodes[i].sums = None                                  # no one asks again


def _without_unused(t: Tree) -> Tree:
    """The reachable nodes, parents before children."""
    order, at = [0], 0
    while at < len(order):
        if t.feature[order[at]] >= 0:
            order += [int(t.left[order[at]]), int(t.right[order[at]])]
        at += 1
    new = {old: i for i, old in enumerate(order)}
    t2 = Tree(t.feature[order], t.cut[order], t.missing_left[order], [new.get(int(x), -1) if t.feature[o] >= 0 else -1 for o, x in zip(order, t.left[order])],
              [new.get(int(x), -1) if t.feature[o] >= 0 else -1 for o, x in zip(order, t.right[order])], t.value[order])
    return t2


# ---------------------------------------------------------------- estimators

class _BoosterParams(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    rounds = Param(Params._dummy(), "rounds", "trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits; 0: no limit", TypeConverters.toInt)
    maxLeaves = Param(Params._dummy(), "maxLeaves", "leaves of a tree; 0: no limit", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "share of a leaf's value that is added", TypeConverters.toFloat)
    l2 = Param(Params._dummy(), "l2", "added to the hessian of a leaf", TypeConverters.toFloat)
    leastHessian = Param(Params._dummy(), "leastHessian", "hessian of a leaf, at least", TypeConverters.toFloat)
    leastRows = Param(Params._dummy(), "leastRows", "rows of a leaf, at least", TypeConverters.toInt)
    leastGain = Param(Params._dummy(), "leastGain", "a split gains more than this", TypeConverters.toFloat)


class _Booster(Estimator, _BoosterParams, DefaultParamsReadable, DefaultParamsWritable):
    _own: dict = {}

    @keyword_only
    def __init__(self, **kwargs):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", **self._own)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> BoostedTrees:
        rows = dataset.select(vector_to_array(self.getOrDefault("featuresCol")).alias("x"),
                              F.col(self.getOrDefault("labelCol")).cast("double").alias("y")).where("y is not null and not isnan(y)")
        n, base, low, high, features = rows.agg(F.count(F.lit(1)), F.avg("y"), F.min("y"), F.max("y"), F.max(F.size("x"))).first()
        if not n:
            raise ValueError("no rows with a label")
        base = float(f"{base:.12g}")                     # the last digits of a mean depend on the order of the rows
        cuts = find_cuts(rows, features)
        reach = max(high - low, 1e-9) * 4
        scale = 2.0 ** min(40, 60 - math.ceil(math.log2(reach)) - math.ceil(math.log2(n)), 36 - math.ceil(math.log2(reach)))
        depth, leaves = self.getOrDefault("maxDepth"), self.getOrDefault("maxLeaves")
        p = {"depth": depth or math.inf, "leaves": leaves or math.inf, "step": self.getOrDefault("stepSize"), "l2": self.getOrDefault("l2"),
             "least_hessian": self.getOrDefault("leastHessian"), "least_rows": self.getOrDefault("leastRows"), "least_gain": self.getOrDefault("leastGain")}
        rounds = self.getOrDefault("rounds")
        if n <= HELD_ROWS:
            trees = grow_in_task(rows, cuts, base, scale, p, rounds)
        else:
            tasks = min(dataset.sparkSession.sparkContext.defaultParallelism, math.ceil(n / HELD_ROWS))
            held = _Rows(rows, cuts, base, scale, max(tasks, math.ceil(n / BLOCK_ROWS)))
            try:
                trees = _grown(held, cuts, p, rounds)
            finally:
                held.free()
        model = json.dumps({"base": base, "cuts": [c.tolist() for c in cuts], "trees": [t.as_lists() for t in trees]})
        return BoostedTrees(model=model)._set(**{c: self.getOrDefault(c) for c in ("featuresCol", "labelCol", "predictionCol")})


class DepthwiseBooster(_Booster):
    """M6: splits every leaf of a level that gains; L2-regularised Newton leaves."""

    _own = {"rounds": 200, "maxDepth": 6, "maxLeaves": 0, "stepSize": 0.1, "l2": 1.0, "leastHessian": 1.0, "leastRows": 1, "leastGain": 1e-6}


class LeafwiseBooster(_Booster):
    """M7: splits the leaf that gains most, up to ``maxLeaves`` leaves of at least ``leastRows`` rows."""

    _own = {"rounds": 200, "maxDepth": 6, "maxLeaves": 31, "stepSize": 0.1, "l2": 0.0, "leastHessian": 1e-3, "leastRows": 20, "leastGain": 1e-6}


class BoostedTrees(Model, HasFeaturesCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """The fitted trees; saved and loaded as a parameter.  Null or NaN features are missing; a null vector gives null."""

    model = Param(Params._dummy(), "model", "base margin, cuts and trees, as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, model: str = "{}"):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction")
        self._set(**self._input_kwargs)

    def setPredictionCol(self, value: str) -> BoostedTrees:
        return self._set(predictionCol=value)

    def parts(self) -> tuple:
        """(base, cuts, trees)"""
        m = json.loads(self.getOrDefault("model"))
        return m["base"], [np.array(c, float) for c in m["cuts"]], [Tree(*t) for t in m["trees"]]

    def splits(self, tree: int = 0) -> list:
        """(depth, feature, threshold, missing left) of a tree's splits, parents first."""
        _, cuts, trees = self.parts()
        t, out, todo = trees[tree], [], [(0, 0)]
        while todo:
            i, depth = todo.pop(0)
            if t.feature[i] >= 0:
                f = int(t.feature[i])
                out.append((depth, f, float(cuts[f][t.cut[i]]), bool(t.missing_left[i])))
                todo += [(int(t.left[i]), depth + 1), (int(t.right[i]), depth + 1)]
        return out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        base, cuts, trees = self.parts()
        shared = dataset.sparkSession.sparkContext.broadcast((base, cuts, trees))      # rounds x leaves, whatever the rows

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            base, cuts, trees = shared.value
            out = np.full(len(x), np.nan)
            some = np.flatnonzero(x.notna().to_numpy())
            if len(some):
                bins = binned(np.stack(x.iloc[some].to_list()).astype(np.float64), cuts)
                out[some] = base + sum((t.predict(bins) for t in trees), np.zeros(len(some)))
            return pd.Series(out).where(x.notna().to_numpy(), None)

        return dataset.withColumn(self.getOrDefault("predictionCol"), score(vector_to_array(self.getOrDefault("featuresCol"))))
