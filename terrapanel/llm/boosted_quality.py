"""Quality classifier: histogram gradient-boosted trees over document statistics.

One scan turns every whole text into ``FEATURES`` numbers, which are written
out.  Labelled rows that are not held out meet the labels by doc_id; about
``SAMPLE_ROWS`` of them at most, chosen by a hash of the id, come to the driver
(a bounded sample: 40,000 rows of some 30 numbers), where the trees are grown on
histograms of quantile bins.  The trees are complete, kept as three arrays
(feature, threshold, leaf), and every document is scored by walking all trees
level by level in numpy.

Nulls and odd rows: a null text is empty, and an empty text has statistics and
a score like any other.  Labels that are null, or of documents not there, are
not used; several labels of one document count as their mean.  Repeated rows
get equal scores.  Without any labelled row every score is 0.5.  Extra columns
are ignored (``keep_good`` keeps all columns).
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.common import slices, flagged, held_out, with_bytes
from terrapanel.session import materialize

SAMPLE_ROWS = 40_000
ROUNDS, DEPTH, BINS = 100, 4, 64
SHRINK, RIDGE, LEAST_WEIGHT = 0.1, 1.0, 5.0
CUTOFF = 0.3

_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789",
    "stop": b".!?", "pause": b",;:", "symbol": b"#*$%&|<>=+_~^@\\/", "bracket": b"()[]{}\"'`", "space": b" \t\x0b\x0c\r", "line": b"\n",
}
FEATURES = ["log_bytes", "log_words", *_CLASSES, "beyond_ascii", "control", "entropy", "top_byte", "word_length", "long_words",
            "short_words", "distinct_words", "top_word", "once_words", "plain_words", "repeat_windows", "log_lines", "line_words",
            "repeat_lines", "short_lines", "stopped_lines", "caps_words", "digit_words", "distinct_letters"]
_OF_BYTE = np.zeros((256, len(_CLASSES) + 2))
for _i, _members in enumerate(_CLASSES.values()):
    _OF_BYTE[list(_members), _i] = 1
_OF_BYTE[128:, -2] = 1
_OF_BYTE[[*range(9), *range(14, 32), 127], -1] = 1


def statistics(text: bytes) -> list:
    """The numbers of ``FEATURES``, of one whole text."""
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = counts / max(n, 1)
    seen = share[counts > 0]
    words = text.split()
    w = max(len(words), 1)
    lowered = text.lower().split()
    by_word = Counter(lowered)
    windows = Counter(zip(lowered, lowered[1:], lowered[2:], strict=False))
    repeated = sum(c for c in windows.values() if c > 1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    m = max(len(lines), 1)
    sizes = [len(x) for x in words]
    return [np.log1p(n), np.log1p(len(words)), *(share @ _OF_BYTE), -float((seen * np.log2(seen)).sum()), float(share.max()),
            sum(sizes) / w, sum(s > 12 for s in sizes) / w, sum(s < 3 for s in sizes) / w, len(by_word) / w,
            max(by_word.values(), default=0) / w, sum(c == 1 for c in by_word.values()) / w, sum(map(bytes.isalpha, words)) / w,
            repeated / max(sum(windows.values()), 1), np.log1p(len(lines)), len(words) / m, 1 - len(set(lines)) / m,
            sum(len(x) < 20 for x in lines) / m, sum(x.rstrip()[-1:] in b".!?" for x in lines) / m,
            sum(map(bytes.isupper, words)) / w, sum(any(48 <= c < 58 for c in x) for x in words) / w if counts[48:58].any() else 0.0,
            int((counts[97:123] > 0).sum())]


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` (any columns, text_bytes among them) with ``x``: array<float>."""
    carried = [c for c in docs.columns if c != "text_bytes"]

    def scan(batches):
        for batch in slices(batches):
            texts = batch.column(len(carried)).to_pylist()
            x = np.array([statistics(t) for t in texts], np.float32).reshape(-1)
            offsets = np.arange(len(texts) + 1, dtype=np.int32) * len(FEATURES)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(carried))),
                                              pa.ListArray.from_arrays(pa.array(offsets), pa.array(x))], names=[*carried, "x"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    return docs.select(*carried, "text_bytes").mapInArrow(scan, f"{kinds}, x array<float>")


# ------------------------------------------------------------------ trees

class Trees:
    """Complete trees of one depth, flattened: node i's children are 2i+1 and 2i+2."""

    def __init__(self, start: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.start, self.feature, self.threshold, self.leaf = start, feature, threshold, leaf

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Of label 1, for the rows of ``x``; all trees walk down together."""
        total = np.full(len(x), self.start)
        inner = self.feature.shape[1] if len(self.feature) else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            rows = np.arange(len(x))
            while node.size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boost on logistic loss; ``y`` in 0..1."""
    if not len(y):
        return Trees(0.0, np.zeros((0, 0), int), np.zeros((0, 0)), np.zeros((0, 0)))
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    total = np.full(len(y), np.log(rate / (1 - rate)))
    start, features = float(total[0]), x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(features)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    cell = binned + np.arange(features) * BINS
    inner = (1 << DEPTH) - 1
    all_features, all_thresholds, all_leaves = [], [], []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float64)
        for level in range(DEPTH):
            first, width = (1 << level) - 1, 1 << level
            at = ((node - first)[:, None] * (features * BINS) + cell).ravel()
            size = width * features * BINS
            gs = np.bincount(at, np.repeat(g, features), size).reshape(width, features, BINS)
            hs = np.bincount(at, np.repeat(h, features), size).reshape(width, features, BINS)
            gl, hl = gs.cumsum(2), hs.cumsum(2)
            ga, ha = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl ** 2 / (hl + RIDGE) + (ga - gl) ** 2 / (ha - hl + RIDGE) - ga ** 2 / (ha + RIDGE)
            gain[(hl < LEAST_WEIGHT) | (ha - hl < LEAST_WEIGHT)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                j, b = divmod(int(best[k]), BINS)
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    feature[first + k], threshold[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        g_leaf = np.bincount(node - inner, g, inner + 1)
        h_leaf = np.bincount(node - inner, h, inner + 1)
        leaf = -SHRINK * g_leaf / (h_leaf + RIDGE)
        total += leaf[node - inner]
        all_features.append(feature)
        all_thresholds.append(threshold)
        all_leaves.append(leaf)
    return Trees(start, np.array(all_features), np.array(all_thresholds), np.array(all_leaves))


# --------------------------------------------------------------- operator

def fit(stats: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Trees from rows of ``stats`` (doc_id, held_out, x) that have a label and are not held out."""
    labels = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    known = stats.where("not held_out").join(labels, "doc_id")
    there = known.count()
    if there > sample_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < int((1 << 20) * sample_rows / there))
    rows = known.select("x", "quality", F.xxhash64("doc_id", "x").alias("o")).toArrow()
    order = np.argsort(rows["o"].to_numpy(), kind="stable")           # the same trees however the rows were dealt
    x = np.array(rows["x"].combine_chunks().flatten(), np.float32).reshape(-1, len(FEATURES))
    return grow(x[order], rows["quality"].to_numpy().astype(np.float64)[order])


def score(docs: DataFrame, labels: DataFrame, carry: tuple = ()) -> DataFrame:
    """doc_id, held_out, score, predicted and the columns ``carry`` of every row of ``docs`` (doc_id, text)."""
    base = with_bytes(docs).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), *carry, "text_bytes")
    stats = materialize(with_statistics(base))
    trees = fit(stats.select("doc_id", "held_out", "x"), labels)

    def scan(batches):
        for batch in slices(batches):
            x = np.array(batch.column(0).flatten(), np.float32).reshape(-1, len(FEATURES))
            p = trees.probability(x)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(1, batch.num_columns)), pa.array(p),
                                              pa.array((p >= CUTOFF).astype(np.int32))], names=names)

    names = ["doc_id", "held_out", *carry, "score", "predicted"]
    kinds = [docs.schema["doc_id"].dataType.simpleString(), "boolean", *[docs.schema[c].dataType.simpleString() for c in carry], "double", "int"]
    return stats.select("x", "doc_id", "held_out", *carry).mapInArrow(
        scan, ", ".join(f"`{n}` {t}" for n, t in zip(names, kinds, strict=True)))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted 1, with all their columns.  Rows
    are told by id and text, so that a repeated id with another text keeps its
    own verdict."""
    keyed = docs.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    bad = score(keyed.select("doc_id", "text", "text_hash"), labels, carry=("text_hash",)).where("predicted = 0")
    bad = materialize(bad.select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct())
    split = flagged(keyed, bad.withColumnRenamed("bad_hash", "text_hash"), "text_hash")
    gone = split.where("hit").join(bad, F.expr("doc_id <=> bad_id and text_hash = bad_hash"), "left_anti")
    return split.where("not hit").unionByName(gone).select(*docs.columns)


def op3_boosted_quality(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
