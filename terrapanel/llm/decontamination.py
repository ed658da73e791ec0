"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. A fixed-size sketch of the corpus' word counts tells how often a run of
   benchmark words would occur by chance.  From every word of an item starts
   one seed: the shortest run of 2 to 8 words that by chance occurs at most
   ``BY_CHANCE`` times in the whole corpus.  The measure takes words one by
   one, so an item that has leaked into many documents keeps its seeds.
2. One scan looks all runs of a document up in a fixed-size bitmap of the
   seeds and cuts out the passages around hits, wide enough for the longest
   item.  Hits meet the seeds in a join on the run's hash, which gives
   (passage, item) pairs; a passage and an item are paired once.
3. Each pair is aligned locally, word by word (match 2, mismatch and gap -1).
   A pair counts as a leak when its score reaches ``LEAST`` of the item's own,
   or that of ``RUN`` matched words, which is part of a long item.

Words are lower-cased and freed from ASCII punctuation, so that an edited copy
differs by words only.

Nulls and odd rows: null or empty texts and items have no words and match
nothing.  Items are searched for by their text, whatever their ids: an item
without an id is reported as null, every text of a repeated item_id is searched
for (the best counts), and equal texts with two ids are two items.  An item of
fewer than ``LEAST_WORDS`` words is found whole or not at all, and only if by
chance the corpus would hold it at most ``BY_CHANCE`` times: "yes" in a text
is no leak.  Repeated rows of one doc_id give one row per item, the best; a null
doc_id is reported as null.  Extra columns are ignored (``keep_clean`` keeps all
columns).
"""

from __future__ import annotations

import itertools
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.common import (slices, BLOCK_SCHEMA, WordHashes, blocks_of, flagged, gather_blocks, key_bitmap, may_occur, runs_of,
                                   sum_blocks, window_hashes, with_bytes)
from terrapanel.session import materialize

SKETCH_BITS = 22
SHORTEST, LONGEST = 2, 8           # words of a seed
BY_CHANCE = 1.0                    # occurrences of a seed expected in the whole corpus
LEAST_WORDS = 4                    # of an item that may be found in part
LEAST = 0.5                        # of the item's own score
RUN = 50                           # matched words that are a leak of an item of any length
MATCH, MISMATCH, GAP = 2, -1, -1
LANES, CELLS = 64, 1 << 20         # pairs aligned at once; words of their passages, if there is more than one

_PLAIN = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def plain_words(text: bytes) -> list:
    return text.decode("utf-8", "replace").lower().encode().translate(_PLAIN).split()


# ------------------------------------------------------------------ seeds

def _word_sketch(docs: DataFrame) -> np.ndarray:
    """Counts of hashed words of the whole corpus: 2**SKETCH_BITS numbers."""

    def scan(batches):
        hashes, counts = WordHashes(), np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in slices(batches):
            some: list = []
            for text in batch.column(0).to_pylist():
                some += plain_words(text)
                if len(some) > 1_000_000:
                    np.add.at(counts, (hashes.of(some) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
                    some = []
            np.add.at(counts, (hashes.of(some) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        rows = list(blocks_of(counts))
        for tab, block, raw in rows:
            yield pa.RecordBatch.from_pydict({"tab": pa.array([tab], pa.int32()), "block": pa.array([block], pa.int32()),
                                              "counts": pa.array([raw], pa.binary())})

    return gather_blocks(sum_blocks(docs.select("text_bytes").mapInArrow(scan, BLOCK_SCHEMA), "int64"), 1, 1 << SKETCH_BITS, "int64")[0]


def item_seeds(hashes: np.ndarray, chance: np.ndarray, total: float) -> list:
    """(words, hash) of one item's seeds; ``chance``: log probability of each word."""
    m, out = len(hashes), []
    sums = np.concatenate([[0.0], np.cumsum(chance)])
    if m < LEAST_WORDS:
        rare = m and sums[m] + np.log(total) <= np.log(BY_CHANCE)
        return [(m, int(window_hashes(hashes, m).view(np.int64)[0]))] if rare else out
    n = np.full(m, min(LONGEST, m))
    for k in range(min(LONGEST, m), SHORTEST - 1, -1):
        at = np.arange(m - k + 1)
        rare = sums[at + k] - sums[at] + np.log(total) <= np.log(BY_CHANCE)
        n[at[rare]] = k
    for k in np.unique(n):
        runs = window_hashes(hashes, int(k))
        at = np.flatnonzero(n == k)
        out += [(int(k), int(h)) for h in runs[at[at < len(runs)]].view(np.int64)]
    return sorted(set(out))


def _seeds(items: DataFrame, sketch) -> DataFrame:
    def scan(batches):
        hashes, counts = WordHashes(), sketch.value
        total = max(float(counts.sum()), 1.0)
        for batch in slices(batches):
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = hashes.of(plain_words(text))
                chance = np.log((counts[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] + 1) / (total + 1))
                rows += [(item, k, s) for k, s in item_seeds(h, chance, total)]
            a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.int64())],
                                             names=["item", "n", "seed"])

    return items.select("item", "text_bytes").mapInArrow(scan, "item long, n int, seed long")


def _passages(docs: DataFrame, bitmap, lengths: list, reach: int) -> DataFrame:
    """(doc_id, start, words, seeds): passages with runs that may be seeds; ``reach``: words kept around a hit."""

    def scan(batches):
        hashes = WordHashes()
        for batch in slices(batches):
            words = [plain_words(t) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([len(w) for w in words])
            h = hashes.of(list(itertools.chain.from_iterable(words)))
            at, seed = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
            for k, runs in runs_of(h, lengths):
                hit = np.flatnonzero(may_occur(bitmap.value, runs))
                hit = hit[hit + k <= ends[np.searchsorted(ends, hit, side="right")]]     # not across documents
                at.append(hit)
                seed.append(runs[hit])
            at, seed = np.concatenate(at), np.concatenate(seed)
            order = np.argsort(at, kind="stable")
            at, seed = at[order], seed[order]
            of = np.searchsorted(ends, at, side="right")
            rows = []
            for some in np.split(np.arange(len(at)), np.flatnonzero((np.diff(at) > 2 * reach) | (np.diff(of) > 0)) + 1) if len(at) else ():
                doc = int(of[some[0]])
                begin = int(ends[doc]) - len(words[doc])
                lo, hi = max(0, int(at[some[0]]) - begin - reach), int(at[some[-1]]) - begin + reach
                rows.append({"doc_id": batch.column(0)[doc].as_py(), "start": lo, "words": b" ".join(words[doc][lo:hi]),
                             "seeds": np.unique(seed[some]).view(np.int64).tolist()})
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("words", pa.binary()), ("seeds", pa.list_(pa.int64()))])
    return docs.select("doc_id", "text_bytes").mapInArrow(scan, "doc_id long, start int, words binary, seeds array<long>")


# -------------------------------------------------------------- alignment

def align(passages: list, items: list) -> list:
    """(score, first word, word after the last) of the best local alignment of
    each passage with its item (arrays of word numbers), all pairs in step.

    A cell holds score * 2**32 + where its alignment starts in the passage, so
    the start travels with the score; gaps along the passage come from one
    running maximum per row."""
    lanes, width = len(passages), max(map(len, passages))
    text = np.full((lanes, width), -1, np.int64)
    for i, p in enumerate(passages):
        text[i, :len(p)] = p
    depth = max(map(len, items))
    other = np.full((lanes, depth), -2, np.int64)
    for i, m in enumerate(items):
        other[i, :len(m)] = m
    one = np.int64(1 << 32)
    fresh = np.arange(1, width + 1, dtype=np.int64)[None, :]       # nothing aligned yet: the next word would be first
    slide = -GAP * one * np.arange(width, dtype=np.int64)[None, :]
    row = np.broadcast_to(fresh, (lanes, width)).copy()
    best, end = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    pad = text < 0
    for j in range(depth):
        diagonal = np.concatenate([np.zeros((lanes, 1), np.int64), row[:, :-1]], 1)
        diagonal += np.where(text == other[:, j:j + 1], MATCH * one, MISMATCH * one)
        row = np.maximum(np.maximum(diagonal, row + GAP * one), fresh)
        row = np.maximum.accumulate(row + slide, 1) - slide
        row = np.where(pad | (row < one), fresh, row)
        top = row.argmax(1)
        value = row[np.arange(lanes), top]
        better = (value >> 32) > (best >> 32)
        best[better], end[better] = value[better], top[better] + 1
    return [(int(b >> 32), int(b & 0xFFFFFFFF), int(e)) for b, e in zip(best, end, strict=True)]


def least_score(words: int) -> float:
    """Of a leak of an item of so many words."""
    return MATCH * (words if words < LEAST_WORDS else min(LEAST * words, RUN))


def in_step(sizes: list):
    """Indices of pairs to align at once: at most ``LANES``, of like sizes, and no more than
    ``CELLS`` words when all are as long as the longest."""
    order, at = sorted(range(len(sizes)), key=sizes.__getitem__), 0
    while at < len(order):
        to = min(len(order), at + LANES)
        while to > at + 1 and (to - at) * sizes[order[to - 1]] > CELLS:
            to = at + max(1, (to - at) // 2)
        yield order[at:to]
        at = to


def _aligned(pairs: DataFrame) -> DataFrame:
    def scan(batches):
        for batch in slices(batches):
            rows = batch.to_pylist()
            found = []
            for group in in_step([r["words"].count(b" ") + 1 for r in rows]):
                some = [rows[i] for i in group]
                number: dict = {}
                split = [(r["words"].split(), plain_words(r["item_text"])) for r in some]
                passages = [np.array([number.setdefault(w, len(number)) for w in p], np.int64) for p, _ in split]
                items = [np.array([number.setdefault(w, len(number)) for w in m], np.int64) for _, m in split]
                for r, (score, first, last), m in zip(some, align(passages, items), items, strict=True):
                    if score >= least_score(len(m)):
                        found.append({"doc_id": r["doc_id"], "item": r["item"], "score": score,
                                      "similarity": score / (MATCH * len(m)), "first_word": r["start"] + first, "end_word": r["start"] + last})
            yield pa.RecordBatch.from_pylist(found, schema=out)

    out = pa.schema([("doc_id", pa.int64()), ("item", pa.int64()), ("score", pa.int64()), ("similarity", pa.float64()),
                     ("first_word", pa.int64()), ("end_word", pa.int64())])
    return pairs.mapInArrow(scan, "doc_id long, item long, score long, similarity double, first_word long, end_word long")


# --------------------------------------------------------------- operator

def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, similarity, first_word, end_word): the best
    alignment of each document and item that reaches the cutoff."""
    spark = docs.sparkSession
    raw = with_bytes(docs.select("doc_id", "text")).select("doc_id", "text_bytes")
    named = with_bytes(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")).withColumn("item", F.xxhash64("text_bytes"))
    items = named.groupBy("item").agg(F.min("text_bytes").alias("text_bytes"))          # one of each text, whatever its ids
    sketch = spark.sparkContext.broadcast(_word_sketch(raw))          # 2**SKETCH_BITS counters, whatever the input
    seeds = materialize(_seeds(items, sketch))
    lengths = sorted(r[0] for r in seeds.select("n").distinct().collect())         # 2 to 8
    longest = items.agg(F.max(F.size(F.split(F.col("text_bytes").cast("string"), r"[\s\p{Punct}]+")))).first()[0] or 0
    reach = LONGEST + longest + longest // 4
    if not lengths:
        return spark.createDataFrame([], "doc_id long, item_id long, score long, similarity double, first_word long, end_word long")
    passages = materialize(_passages(raw, key_bitmap(seeds, "seed"), lengths, reach)
                           .withColumn("key", F.xxhash64("doc_id", "start", "words")))
    hits = passages.select("key", F.explode("seeds").alias("seed"))
    pairs = hits.join(seeds.select("seed", "item"), "seed").select("key", "item").distinct()
    texts = items.withColumnRenamed("text_bytes", "item_text")
    whole = passages.dropDuplicates(["key"]).select("key", "doc_id", "start", "words")
    found = _aligned(pairs.join(whole, "key").join(texts, "item").select("doc_id", "start", "words", "item", "item_text"))
    found = found.join(named.select("item", "item_id").distinct(), "item")
    top = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "similarity", F.negative("first_word").alias("o"), "end_word")).alias("t"))
    return top.select("doc_id", "item_id", "t.score", "t.similarity", F.negative("t.o").alias("first_word"), "t.end_word")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; rows are told by id and text."""
    keyed = docs.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    bad = materialize(leaks(keyed.select(F.col("text_hash").alias("doc_id"), "text"), benchmark)
                      .select(F.col("doc_id").alias("text_hash")).distinct())
    split = flagged(keyed, bad, "text_hash")
    gone = split.where("hit").join(bad, "text_hash", "left_anti").select(*split.columns)
    return split.where("not hit").unionByName(gone).select(*docs.columns)


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
