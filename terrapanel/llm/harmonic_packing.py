"""Harmonic packing: documents into sequences of at most ``CAPACITY`` tokens.

A piece of length L belongs to the class k = CAPACITY // L: k such pieces fill
a sequence, each losing less than CAPACITY / k / (k + 1) tokens.  Documents may
be cut, so most pieces are cut to lengths that lose nothing: whole sequences
first, then halves, quarters, ... down to ``CAPACITY / 16``; only the tail that
is left (fewer tokens than that) keeps its own length.  Every task (a
partition of the documents) fills the bins of its classes with their fixed
number of pieces, without a shuffle and without knowing other tasks.  The
fewer than k pieces that a class has over at a task's end are laid end to end,
cut at ``CAPACITY`` and, the last stretch, at powers of two, which need no
padding.

A sequence's id is the task's number times 2**33 plus the bin's number.  A
task that runs again reads the same rows in the same order and gives the same
ids.  Memory: one batch of documents, and fewer than k pieces (lengths, not
tokens) of each class.

Nulls and odd rows: a null or empty text is the end id alone.  Repeated rows,
null ids and extra columns are packed or carried like any other.
"""

from __future__ import annotations

import functools
import itertools
import operator
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.common import short_batches, slices

CAPACITY = 2048
SMALLEST = 128            # the least power of two that documents are cut to
END_ID = 1
ID_CACHE = 1_000_000        # words whose ids a Python worker remembers

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


_KEPT = "\x1c\x1d\x1e\x1f"      # white space to ``str.split``, not to the tokenizer
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class WordIds:
    """Token ids of texts.  The tokenizer never joins what white space parts, so
    the ids of a text are those of its words, which repeat: they are remembered.
    Words not met before are encoded many at a time, and their tokens told
    apart by their place.  ``str.split`` also cuts at four control characters
    that the tokenizer keeps; texts with those are encoded whole."""

    def __init__(self, path: str, cache: int = ID_CACHE):
        self.cache = cache
        os.environ["TOKENIZERS_PARALLELISM"] = "false"     # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # where the tokenizer lowers A-Z itself, words of ASCII texts that differ by case alone are one word
        self.lowers = self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str(_LETTERS) == _LETTERS.lower()
        self.known: dict = {}

    def _learn(self, words: list) -> None:
        groups = [words[at:at + 64] for at in range(0, len(words), 64)]
        for group, e in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            begin, at = [], 0
            for word in group:
                begin.append(at)
                at += len(word) + 1
            cut = [*map(e.char_to_token, begin)]
            if None in cut:                                    # a word whose first character gives no token
                cut = np.searchsorted(np.fromiter((o[0] for o in e.offsets), np.int64, len(e.ids)), begin).tolist()
            ids = e.ids
            raw = np.array(ids, "<u4").tobytes()
            self.known.update(zip(group, (raw[4 * a:4 * b] for a, b in zip(cut, [*cut[1:], len(ids)], strict=True)), strict=True))

    def __call__(self, texts: list) -> list:
        split = [None if any(c in t for c in _KEPT) else (t.lower() if self.lowers and t.isascii() else t).split() for t in texts]
        known = self.known
        ids = [words if words is None else [*map(known.get, words)] for words in split]
        # words are looked up once; those that were not known (their places are kept) again
        some = [(x, words, [*itertools.compress(itertools.count(), map(operator.is_, x, itertools.repeat(None)))])
                for x, words in zip(ids, split, strict=True) if x is not None and None in x]
        new = {words[i] for _, words, places in some for i in places}
        if len(known) + len(new) > self.cache:
            known.clear()
        self._learn(list(new))
        for x, words, places in some:
            for i in places:
                x[i] = known[words[i]]
        end = np.array([END_ID], "<u4").tobytes()
        return [np.frombuffer(b"".join([*x, end]), "<u4") if x is not None else
                np.array([*self.tokenizer.encode(t, add_special_tokens=False).ids, END_ID], "<u4")
                for t, x in zip(texts, ids, strict=True)]


@functools.cache
def word_ids(path: str, cache: int) -> WordIds:
    """One for each Python worker, whose tasks share it."""
    return WordIds(path, cache)


def cut_lengths(n: int, capacity: int = CAPACITY, smallest: int = SMALLEST) -> list:
    """Lengths of the pieces of a document of ``n`` tokens: whole sequences,
    then powers of two that divide them, then the tail."""
    out = [capacity] * (n // capacity)
    n %= capacity
    size = capacity // 2
    while size >= smallest:
        if n >= size:
            out.append(size)
            n -= size
        size //= 2
    return out + [n] * (n > 0)


class Bins:
    """The open bins of one task."""

    def __init__(self, task: int, capacity: int = CAPACITY):
        self.capacity, self.base, self.bins = capacity, task << 33, 0
        self.open: dict = {}

    def add(self, piece: list):
        """``piece``: [doc, start, length, ...]; yields (piece, sequence, offset) of a bin that it fills."""
        k = self.capacity // piece[2]
        mine = self.open.setdefault(k, [])
        mine.append(piece)
        if len(mine) == k:
            del self.open[k]
            yield from self._bin(mine)

    def _bin(self, pieces):
        offset = 0
        for piece in pieces:
            yield piece, self.base + self.bins, offset
            offset += piece[2]
        self.bins += 1

    def rest(self, ids_of):
        """What is over: laid end to end and cut where a sequence, and at the end a power of two, is full.
        ``ids_of(piece)``: the piece's ids, for the checksums of what is cut again."""
        left = [p for k in sorted(self.open) for p in self.open[k]]
        total = sum(p[2] for p in left)
        while total:
            room = self.capacity if total >= self.capacity else 1 << (total.bit_length() - 1)
            total -= room
            pieces = []
            while room:
                piece = left.pop(0)
                if piece[2] > room:
                    doc, start, length = piece[:3]
                    ids = ids_of(piece)
                    left.insert(0, [doc, start + room, length - room, ids[room:], piece[4]])
                    piece = [doc, start, room, ids[:room], piece[4]]
                room -= piece[2]
                pieces.append(piece)
            yield from self._bin(pieces)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, cached_words: int = ID_CACHE,
         shared: bool = True) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text).  The ids of ``cached_words``
    words (some 170 bytes each) are remembered: for all tasks of a Python
    worker if ``shared``, which keeps the tokenizer in its memory, else by each
    task for itself."""

    def scan(batches):
        from pyspark import TaskContext

        encode = (word_ids if shared else WordIds)(tokenizer_path, cached_words)
        bins = Bins(TaskContext.get().partitionId(), capacity)

        def rows(placed):
            cols = list(zip(*((p[0], p[1], p[2], zlib.crc32(p[3].astype("<u4").tobytes()), p[4], s, o) for p, s, o in placed), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        for batch in slices(batches):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            placed = []
            for at in range(0, len(ids), 500):
                for doc, tokens in zip(ids[at:at + 500], encode(texts[at:at + 500]), strict=True):
                    start = 0
                    for length in cut_lengths(len(tokens), capacity):
                        placed += bins.add([doc, start, length, tokens[start:start + length].copy(), len(tokens)])
                        start += length
                if len(placed) > 20_000:
                    yield rows(placed)
                    placed = []
            if placed:
                yield rows(placed)
        if placed := list(bins.rest(lambda piece: piece[3])):
            yield rows(placed)

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    short_batches(docs.sparkSession)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(scan, SCHEMA)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_harmonic_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
