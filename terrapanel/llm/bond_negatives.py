"""Hard negatives by a BOND vertical scan: exact inner-product search that reads
dimensions, not rows.

Every task lays its rows out in *blocks* of columns, one array a dimension, each
with its least and greatest value.  For an anchor the columns are read in
descending order of the anchor's magnitude there, a few at a time.  A row's
score so far, plus the least and the greatest that the unread columns can add,
bounds its score; rows whose bounds can no longer matter leave the candidate
bitmap, and when the columns are read the rest have exact scores.

Two scans for each batch of anchors:

1. *Positives*: the best rows of the anchor's own label.  A row leaves when its
   upper bound is below the k-th best score known, of this block's lower bounds
   or of the blocks before.
2. *Negatives*: for each positive the best rows of other labels inside the
   window of scores that it allows.  A row leaves when its bounds meet no window,
   or none that is not already full of better ones.

A task hands on the best rows of all its blocks, so a merge reads a few rows for
each anchor and task, whatever the number of rows or of equal vectors.  Anchors
are a share of the rows; they are read in batches of ``ANCHORS``, and only one
batch (at most 16,384 vectors) and its positives' scores are broadcast at a time.

Every anchor meets every row that no bound excludes: products grow with anchors
times rows, as for any exact search.

Defined results: rows with a null label, a null vector or a null or non-finite
component take no part; a vector shorter than another counts as zero beyond its
end.  A null vec_id is no anchor and comes last in ties (2^63 - 1 counts as
null).  Rows that share an anchor's vec_id are not its positives or negatives;
otherwise repeated rows count each, and a repeated anchor gives its rows again.
No anchors, or no rows in a window: no result rows.  Scores are exact up to
2^53.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrapanel.session import materialize

ANCHORS = 16_384          # anchors broadcast at once
BLOCK = 8192              # rows of a block of columns
STEP = 8                  # columns read between two looks at the bounds
TOP = 5                   # positives of an anchor, negatives of a positive
WINDOW = (80, 100)        # per cent of the positive's score that a negative may have
NO_ID = np.iinfo(np.int64).max


def usable(rows: DataFrame, label="label") -> DataFrame:
    """vec_id, label (long) and vector of the rows that may take part."""
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"),
                       F.col("embedding").cast("array<double>").alias("vector")).where("label is not null and vector is not null")


def _numbers(batch) -> tuple:
    """(ids, labels, table rows x dimensions of floor(256 * x)) of the rows of an Arrow batch
    (vec_id, label, vector) whose components are all finite."""
    ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
    labels = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
    vectors = batch.column(2)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    wide = int(sizes.max(initial=0))
    table = np.zeros((len(ids), wide))
    table[np.arange(wide) < sizes[:, None]] = flat                 # null components are NaN here
    good = np.isfinite(table).all(1)
    return ids[good], labels[good], np.floor(256.0 * table[good])


class Block:
    """Rows as columns, in the order of their ids."""

    def __init__(self, ids, labels, table, width: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels = ids[order], labels[order]
        self.columns = np.zeros((width, len(ids)))
        self.columns[:table.shape[1]] = table[order].T[:width]
        self.low, self.high = self.columns.min(1, initial=np.inf), self.columns.max(1, initial=-np.inf)

    def scan(self, anchor: np.ndarray, rows: np.ndarray, matters) -> tuple:
        """(rows, exact scores) of those of ``rows`` that ``matters(lower, upper)``
        keeps to the end; columns are read in the anchor's descending magnitude."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        order = order[anchor[order] != 0]
        ends = np.stack([anchor * self.low, anchor * self.high])[:, order]
        least = np.append(np.cumsum(ends.min(0)[::-1])[::-1], 0.0)          # what columns from here on can add
        most = np.append(np.cumsum(ends.max(0)[::-1])[::-1], 0.0)
        score = np.zeros(len(rows))
        at = 0
        while len(rows):
            stay = matters(score + least[at], score + most[at])
            if not stay.all():
                rows, score = rows[stay], score[stay]
            if at == len(order) or not len(rows):
                break
            dims = order[at:at + STEP]
            if 2 * len(rows) > len(self.ids):
                score = score + (anchor[dims] @ self.columns[dims])[rows]
            else:
                score = score + anchor[dims] @ self.columns[dims[:, None], rows]
            at += len(dims)
        return rows, score


def _blocks(batches, width: int):
    """Blocks of at most ``BLOCK`` rows of Arrow batches (vec_id, label, vector).  The
    rows come in one width; no anchor has a component beyond it."""
    held, count = [], 0

    def made():
        wide = max(t.shape[1] for _, _, t in held)
        table = np.zeros((count, wide))
        at = 0
        for _, _, t in held:
            table[at:at + len(t), :t.shape[1]] = t
            at += len(t)
        return Block(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), table, width)

    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = _numbers(batch.slice(at, BLOCK))
            if not len(part[0]):
                continue
            if held and count + len(part[0]) > BLOCK:
                yield made()
                held, count = [], 0
            held.append(part)
            count += len(part[0])
    if held:
        yield made()


def _best(score, ids, more_score, more_ids, k: int) -> tuple:
    """The k best of both: greater scores first, then smaller ids."""
    score, ids = np.concatenate([score, more_score]), np.concatenate([ids, more_ids])
    order = np.lexsort((ids, -score))[:k]
    return score[order], ids[order]


class Anchors:
    """One batch of anchors: ids, labels, vectors of one width."""

    def __init__(self, batch):
        self.ids, self.labels, self.vectors = _numbers(batch)

    def __len__(self):
        return len(self.ids)


def _positives(rows: DataFrame, anchors, count: int, k: int) -> DataFrame:
    """(anchor, place, vec_id, score): the k best rows of each anchor's label; anchor: its number in the batch."""

    def scan(batches):
        own = anchors.value
        score = np.full((len(own), k), -np.inf)
        ids = np.full((len(own), k), NO_ID)
        for block in _blocks(batches, own.vectors.shape[1]):
            of_label = {x: np.flatnonzero(block.labels == x) for x in np.unique(block.labels).tolist()}
            for a in range(len(own)):
                same = of_label.get(int(own.labels[a]))
                if same is None:
                    continue
                same = same[block.ids[same] != own.ids[a]]
                known = score[a, -1]

                def matters(lower, upper, known=known):
                    at_least = known
                    if len(lower) > k:
                        at_least = max(known, np.partition(lower, len(lower) - k)[len(lower) - k])
                    return upper >= at_least

                found, exact = block.scan(own.vectors[a], same, matters)
                if len(found):
                    s, i = _best(score[a], ids[a], exact, block.ids[found], k)
                    score[a, :], ids[a, :] = s, i
        who, place = np.nonzero(np.isfinite(score))
        for at in range(0, len(who), 10_000):
            w, p = who[at:at + 10_000], place[at:at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.int32()), pa.array(ids[w, p]), pa.array(score[w, p])],
                                             names=["anchor", "vec_id", "score"])

    found = rows.mapInArrow(scan, "anchor int, vec_id long, score double")
    first = Window.partitionBy("anchor").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k)


def _negatives(rows: DataFrame, anchors, positives, k: int, window: tuple) -> DataFrame:
    """Result rows for the anchors of one batch; ``positives``: (ids, scores, known) by anchor and place."""
    least, most = window

    def scan(batches):
        own, (good_id, good_score, known) = anchors.value, positives.value
        places = good_id.shape[1]
        score = np.full((len(own), places, k), -np.inf)
        ids = np.full((len(own), places, k), NO_ID)
        from_ = np.where(known, np.ceil(least * good_score / 100), np.inf)
        to = np.where(known, np.floor(most * good_score / 100), -np.inf)
        for block in _blocks(batches, own.vectors.shape[1]):
            of_label = {x: np.flatnonzero(block.labels != x) for x in np.unique(own.labels).tolist()}
            for a in range(len(own)):
                open_ = [(p, max(from_[a, p], score[a, p, -1]), to[a, p]) for p in range(places) if from_[a, p] <= to[a, p]]
                if not open_:
                    continue
                spans = {(f, t) for _, f, t in open_}

                def matters(lower, upper, spans=spans):
                    stay = np.zeros(len(lower), bool)
                    for f, t in spans:
                        stay |= (upper >= f) & (lower <= t)
                    return stay

                other = of_label[int(own.labels[a])]
                found, exact = block.scan(own.vectors[a], other[block.ids[other] != own.ids[a]], matters)
                if not len(found):
                    continue
                for p, f, t in open_:
                    inside = (exact >= f) & (exact <= t)
                    if inside.any():
                        s, i = _best(score[a, p], ids[a, p], exact[inside], block.ids[found[inside]], k)
                        score[a, p, :], ids[a, p, :] = s, i
        who, place, n = np.nonzero(np.isfinite(score))
        for at in range(0, len(who), 10_000):
            cut = slice(at, at + 10_000)
            w, p, i = who[cut], place[cut], n[cut]
            yield pa.RecordBatch.from_arrays(
                [pa.array(w, pa.int32()), pa.array(p, pa.int32()), pa.array(own.ids[w]), pa.array(good_id[w, p]),
                 pa.array(ids[w, p, i]), pa.array(good_score[w, p].astype(np.int64)), pa.array(score[w, p, i].astype(np.int64))],
                names=["anchor", "place", "anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    found = rows.mapInArrow(scan, "anchor int, place int, anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    first = Window.partitionBy("anchor", "place").orderBy(F.col("negative_score").desc(), "negative_id")
    ids = [F.when(F.col(c) != int(NO_ID), F.col(c)).alias(c) for c in ("positive_id", "negative_id")]
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select(
        "anchor_id", ids[0], "rank", ids[1], "positive_score", "negative_score")


SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _in_batches(anchors: DataFrame, size: int):
    """The anchors as Arrow batches of at most ``size`` rows, one at a time on the driver."""
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("vector", pa.list_(pa.float64()))])
    held: list = []
    for row in anchors.toLocalIterator():
        held.append({"vec_id": row.vec_id, "label": row.label, "vector": row.vector})
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def mine(rows: DataFrame, anchors: DataFrame, k: int = TOP, window: tuple = WINDOW, batch: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).
    ``rows`` and ``anchors``: vec_id, label, vector as of ``usable``."""
    spark = rows.sparkSession
    parts = []
    for taken in _in_batches(materialize(anchors), batch):
        own = spark.sparkContext.broadcast(Anchors(taken))
        if not len(own.value):
            continue
        good_id = np.full((len(own.value), k), NO_ID)
        good_score = np.zeros((len(own.value), k))
        known = np.zeros((len(own.value), k), bool)
        for r in _positives(rows, own, len(own.value), k).collect():          # at most k for each anchor of the batch
            good_id[r.anchor, r.place - 1], good_score[r.anchor, r.place - 1], known[r.anchor, r.place - 1] = r.vec_id, r.score, True
        good = spark.sparkContext.broadcast((good_id, good_score, known))
        parts.append(materialize(_negatives(rows, own, good, k, window)))
        own.unpersist()
        good.unpersist()
    if not parts:
        return spark.createDataFrame([], SCHEMA)
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def op12_bond_negatives(spark, sf_dir: str) -> DataFrame:
    """Anchors: ids divisible by 100, against all rows; where 7 divides the id the label is the next one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label)
    return mine(rows, rows.where("vec_id % 100 = 0"))


SQL = """
with v as (
  select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.r, a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_dot_product(a.e, b.e)::bigint as score
  from v a join v b on a.vec_id % 100 = 0 and b.vec_id is distinct from a.vec_id),
p as (
  select r, anchor_id, vec_id as positive_id, score as positive_score, row_number() over (partition by r order by score desc, vec_id) as place
  from s where same qualify place <= 5),
n as (
  select p.anchor_id, p.positive_id, cast(row_number() over (partition by p.r, p.place order by s.score desc, s.vec_id) as integer) as rank,
    s.vec_id as negative_id, p.positive_score, s.score as negative_score
  from p join s on s.r = p.r and not s.same and 80 * p.positive_score <= 100 * s.score and s.score <= p.positive_score)
select * from n where rank <= 5
"""
