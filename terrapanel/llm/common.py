"""Helpers shared by the operators of this folder: words and shingles of raw
bytes, fixed-size count sketches summed over partitions, and connected
components of an edge table."""

from __future__ import annotations

import ctypes

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.session import materialize

#: Words for Spark's and DuckDB's regular expressions.  ``bytes.split()`` cuts
#: at exactly the same characters, ``bytes.lower()`` lowers exactly A-Z.
WORD = r"[^\x20\x09-\x0D]+"

#: Words whose hash a task remembers; the table is emptied when it is full.
WORD_CACHE = 200_000


BATCH_ROWS = 1000


def short_batches(spark) -> None:
    """Let the session read at most ``BATCH_ROWS`` rows of a file and send as many to
    Python at a time: texts are long, and a batch is held by the JVM and by Python."""
    for conf in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        if int(spark.conf.get(conf)) > BATCH_ROWS:
            spark.conf.set(conf, str(BATCH_ROWS))


def give_back() -> None:
    """Memory that is free in this process goes back to the system: a Python worker
    runs task after task, and would keep the most that any of them took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc has it
    if trim is not None:
        trim(0)


def slices(batches, rows: int = 1000):
    """Arrow batches cut into short ones, so that Python objects exist for few rows
    at a time; unused memory goes back before them (that of the task before) and after."""
    give_back()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered up to ``WORD_CACHE`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_ODD = [int(x) | 1 for x in np.random.default_rng(5).integers(1 << 40, 1 << 62, 64)]


def window_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every run of ``k`` words."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total += word_hashes[i:i + n] * np.uint64(_ODD[i])
    return mix(total)


def runs_of(word_hashes: np.ndarray, lengths: list):
    """(k, ``window_hashes(word_hashes, k)``) for each of ``lengths``, from one running sum."""
    total = np.zeros(len(word_hashes), np.uint64)
    for k in range(1, max(lengths, default=0) + 1):
        if k > len(word_hashes):
            return
        total = total[:len(word_hashes) - k + 1] + word_hashes[k - 1:] * np.uint64(_ODD[k - 1])
        if k in lengths:
            yield k, mix(total)


def shingle_set(text: bytes | None, hashes: WordHashes, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's ``k``-word shingles; a shorter text
    is one shingle, a text without words has none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b"\x00".join(words), seed=len(words))], np.uint64)
    return np.unique(window_hashes(hashes.of(words), k))


def with_bytes(df: DataFrame, column: str = "text") -> DataFrame:
    """``text_bytes``: the UTF-8 bytes (null: empty)."""
    short_batches(df.sparkSession)
    return df.withColumn("text_bytes", F.coalesce(F.col(column).cast("binary"), F.lit(b"").cast("binary")))


def held_out(doc_id, modulus: int, remainder: int):
    """crc32 of the id's decimal text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def squeeze(numbers: np.ndarray) -> bytes:
    """Numbers packed, their first bytes together, then their second, and so on."""
    return zstandard.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T), 1)


def unsqueeze(raw: bytes, kind=np.uint32) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


# ---------------------------------------------------------------- sketches

BLOCK = 1 << 16


def blocks_of(array: np.ndarray, name: int = 0):
    """(table, block, packed bytes) of the blocks of a counter array that hold a count.
    Most counters of one task are small, so that a block is a fraction of its size."""
    for at in range(0, len(array), BLOCK):
        part = array[at:at + BLOCK]
        if part.any():
            yield name, at // BLOCK, zstandard.compress(part.tobytes(), 1)


BLOCK_SCHEMA = "tab int, block int, counts binary"


def sum_blocks(rows: DataFrame, dtype: str, parts: int = 32, add_up=np.add) -> DataFrame:
    """Add (or otherwise combine) the counter blocks of all partitions: rows of one block meet in one
    task, which adds them as they stream by (memory: the task's blocks)."""

    def add(batches):
        total: dict = {}
        for batch in batches:
            for tab, block, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                counts = np.frombuffer(zstandard.decompress(raw), dtype)
                if (tab, block) in total:
                    add_up(total[tab, block], counts, out=total[tab, block])
                else:
                    total[tab, block] = counts.copy()
        for (tab, block), counts in total.items():
            yield pa.RecordBatch.from_pydict({
                "tab": pa.array([tab], pa.int32()), "block": pa.array([block], pa.int32()),
                "counts": pa.array([zstandard.compress(counts.tobytes(), 1)], pa.binary())})
        give_back()

    return rows.select("tab", "block", "counts").repartition(parts, "tab", "block").mapInArrow(add, BLOCK_SCHEMA)


def gather_blocks(summed: DataFrame, tables: int, size: int, dtype: str) -> np.ndarray:
    """The summed counters on the driver: ``tables * size`` counters, whatever the input."""
    out = np.zeros((tables, size), dtype)
    for tab, block, raw in summed.toLocalIterator():
        counts = np.frombuffer(zstandard.decompress(raw), dtype)
        out[tab, block * BLOCK:block * BLOCK + len(counts)] = counts
    return out


DOC_BITS = 24             # bitmap of hashed keys, two bits for each key: 2 MB, at any size
_MASK = np.uint64((1 << DOC_BITS) - 1)


def key_bitmap(keys: DataFrame, column: str):
    """Broadcast bitmap of fixed size: which hashes (long, not null) may occur in ``column``."""

    def scan(batches):
        bits = np.zeros(1 << DOC_BITS, bool)
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            bits[key & _MASK] = True
            bits[(key >> np.uint64(DOC_BITS)) & _MASK] = True
        found = list(blocks_of(np.packbits(bits)))
        yield pa.RecordBatch.from_pydict({
            "tab": pa.array([r[0] for r in found], pa.int32()), "block": pa.array([r[1] for r in found], pa.int32()),
            "counts": pa.array([r[2] for r in found], pa.binary())})

    summed = sum_blocks(keys.select(column).where(F.col(column).isNotNull()).mapInArrow(scan, BLOCK_SCHEMA), "uint8", 8, np.bitwise_or)
    return keys.sparkSession.sparkContext.broadcast(gather_blocks(summed, 1, 1 << (DOC_BITS - 3), "uint8")[0])


def may_occur(bitmap: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether both bits of each key are set; the second is looked up for the few that have the first."""

    def is_set(at):
        return (bitmap[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1

    found = is_set(key & _MASK)
    some = np.flatnonzero(found)
    found[some] = is_set((key[some] >> np.uint64(DOC_BITS)) & _MASK)
    return found


def flagged(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``hit``: false where the hash in ``column`` (long) is
    surely not among that of ``keys``, by a bitmap of fixed size; spares most
    rows the shuffle of a join that follows."""
    shared = key_bitmap(keys, column)

    @F.pandas_udf("boolean")
    def hit(key: pd.Series) -> pd.Series:
        return pd.Series(may_occur(shared.value, key.to_numpy(np.int64).view(np.uint64)))

    return rows.withColumn("hit", hit(column))


# -------------------------------------------------------------- components

def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (u, v),
    for every node of an edge.

    Alternating large-star and small-star steps.  Each step is a minimum per
    node (combined before the shuffle) joined back to the edges, so a hub with
    many edges is summed map-side and its join partition can be split.  Every
    round is written out, so an executor loss repeats one round at most."""
    e = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                    .where("u <> v").distinct())
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select("u", F.col("m").alias("v")).unionByName(
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        e = materialize(small)
        state = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = state
