"""LM scoring by online logistic context mixing.

A text (A-Z lowered) is coded byte by byte, then an end mark.  Each byte is a
path of binary decisions through a prefix code, one for each byte before it,
learned from the training bytes, so a common byte costs few decisions.  For every decision several
predictors, each a table addressed by a hash of (context, place in the code),
give the log odds of a one; the contexts are the last 3 and the last 5 bytes
and the letters of the current word.  The odds are added with weights from the set
that a gate names (how much the two longest contexts have to say).  The weights start equal for all texts, from fixed
values that are not learned, and are refined as a text is read, once per 256
bytes (1,024 after 2 KB), by the error of the decisions before: scores hang
on the trained tables and the text alone, not on partitions or order.

What is learned comes from all training documents: counts of byte pairs (257 x 257
numbers), one pair of counters per table slot, and exact word counts.  A table
has at least as many slots as the training texts have bytes (a power of two), so
it grows with the corpus; no process holds one.  A task lists the slots and the
words (64-bit hashes) that a chunk of documents meets, with the chunk's counts;
these lists, cut into groups of slots, meet those of the other chunks by group,
and the log odds of the sums, or the word counts, come back to the chunk, which
is scored with them.  The chunk's texts travel beside its lists, in groups of
their own, so that what is learned is read once and never written as a table.

Nulls and odd rows: a null or empty text is the end mark alone.  Rows are
scored one by one, so repeated rows get equal scores; a null doc_id is hashed
as empty text.  Without training rows the model is uniform and V = N = 0.
Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.automaton_dedup import word_hashes
from terrapanel.llm.common import held_out, slices, squeeze, unsqueeze, with_bytes
from terrapanel.session import materialize

ORDERS = (3, 5)                        # context bytes of the tables; one more holds the word so far
SLOT_BITS = (20, 22, 22)               # slots of each table, at least
END = 256                              # the end mark
WORDS = len(SLOT_BITS)                 # number of the list of words, beside those of the tables
TEXTS = WORDS + 1                      # and of the texts
TASK_BYTES = 56 << 20                  # text that a task learns from, at least
CHUNK_BYTES = 30 << 20                 # text whose words and slots a task lists at once
PART_BYTES = 1 << 19                   # text that is scored at once, about
STEP_BYTES = 1 << 14                   # and mixed at once
LIST_BYTES = 1 << 19                   # text whose contexts are listed at once
GROUP_BYTES = 26                       # a group of slots for so many training bytes (bits), 64 groups at least
CACHE_BITS = 20                        # paths through the code that a task remembers, of each table
PATH_ODDS = 1 << 22                    # and their log odds
NO_CHUNK = -1                          # chunk of the rows that hold totals
PAIR = np.uint64((1 << 17) - 1)        # bits of a context hash that are free for a pair of symbols
SCALE = 12.0                           # log odds are kept in steps of 1/12
GATES = 9
RATE = 0.001
STEP, LONG_STEP = 256, 1024            # bytes between two refinements, and after STEP * 8 bytes
# Weights that every text starts with, by gate: what the word's and the five
# bytes' predictors say (nothing, a little, much: 0, 1, 2), as 3 * word + five.
_START = np.array([[.6, .4, .4], [.6, .43, .4], [.65, .35, .4], [.5, .4, 0], [.3, .55, .13], [.5, .6, 0],
                   [.65, .4, .18], [.47, .39, .28], [.4, .53, .26]], np.float32)
_LEVEL = np.array([0] + [1] * 20 + [2] * 235, np.uint8)     # of |log odds| in steps
_LEVEL_OF = _LEVEL[np.abs(np.arange(256, dtype=np.uint8).view(np.int8).astype(np.int16))]     # of the byte that holds them
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


def prefix_code(counts: np.ndarray):
    """(length, first, place, bit) of a code for each symbol before: ``counts``
    is 257 x 257 (symbol before, symbol).  Of symbol s after r the decisions
    are entries ``first[257 r + s]`` and following of ``place`` (a hash of the
    place in the code) and ``bit``.  Rows without a count share one code."""
    length, first = np.zeros((END + 1) ** 2, np.int64), np.zeros((END + 1) ** 2, np.int64)
    places, bits, codes = [], [], 0
    every = counts.sum(0)
    common = None
    for before in range(END + 1):
        if counts[before].any():
            paths = _paths(counts[before] * 1000 + every // max(1, every.sum() // 1000))
        elif common is None:
            paths = _paths(every)
        else:
            paths = None
        row = slice(before * (END + 1), (before + 1) * (END + 1))
        if paths is None:
            length[row], first[row] = common
            continue
        for s, path in enumerate(paths):
            length[before * (END + 1) + s], first[before * (END + 1) + s] = len(path), len(places)
            places += [codes * (END + 1) + x for x, _ in path]
            bits += [x for _, x in path]
        if not counts[before].any():
            common = length[row].copy(), first[row].copy()
        codes += 1
    return length, first, np.array(places, np.uint32) * np.uint32(0x9E3779B1), np.array(bits, np.uint8)


def _paths(counts: np.ndarray) -> list:
    """Of each symbol the (inner node, bit) decisions of the code with the shortest mean length."""
    tie = itertools.count()
    heap = [(int(c) + 1, next(tie), s) for s, c in enumerate(counts)]
    heapq.heapify(heap)
    inner = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], next(tie), (inner, a[2], b[2])))
        inner += 1
    paths: list = [()] * len(counts)
    todo = [(heap[0][2], ())]
    while todo:
        at, path = todo.pop()
        if isinstance(at, tuple):
            todo += [(at[1], (*path, (at[0], 0))), (at[2], (*path, (at[0], 1)))]
        else:
            paths[at] = path
    return paths


def symbols(texts: list):
    """(bytes, symbols, the symbol before each, sizes): texts laid end to end, each with its end mark."""
    sizes = np.array([len(t) for t in texts], np.int64) + 1
    data = np.frombuffer(b"\x00".join(texts) + b"\x00", np.uint8)
    symbol = data.astype(np.uint16)
    symbol[np.cumsum(sizes) - 1] = END
    before = np.empty_like(symbol)
    before[0], before[1:] = END, symbol[:-1]
    return data, symbol, before, sizes


class Contexts:
    """Texts laid end to end as symbols, and each symbol's context hashes."""

    def __init__(self, texts: list):
        data, self.symbol, before, self.size = symbols(texts)
        self.pair = before.astype(np.int32) * (END + 1) + self.symbol
        self.end = np.cumsum(self.size)
        begin = self.end - self.size
        n = len(data)
        # the last 1, 2, 3, 5 bytes as numbers of nine bits a byte
        letter = data.astype(np.uint64) + np.uint64(1)
        one = np.zeros(n, np.uint64)
        one[1:] = letter[:-1]
        two = one.copy()
        two[1:] |= one[:-1] << np.uint64(9)
        three = two.copy()
        three[2:] |= one[:-2] << np.uint64(18)
        five = three.copy()
        five[3:] |= two[:-3] << np.uint64(27)
        self.hashes = []
        for packed, length, multiplier in zip((three, five), ORDERS, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), strict=True):
            for age in range(length):                    # nothing is seen across the start of a text
                packed[begin[self.size > age] + age] &= np.uint64((1 << 9 * age) - 1)
            packed *= np.uint64(multiplier)
            packed ^= packed >> np.uint64(29)
            packed &= ~PAIR
            self.hashes.append(packed)
        # the word so far: running sums modulo 2**64 of the word's letters times powers
        space = _SPACE[data]
        space[self.end - 1] = True
        until = np.flatnonzero(space) + 1                # words with the space after them
        size = np.diff(until, prepend=0)
        place = np.arange(n, dtype=np.int32) - np.repeat((until - size).astype(np.int32), size)
        powers = np.array([pow(0x100000001B3, i, 1 << 64) for i in range(32)], np.uint64)
        # letters further than 31 from the word's start share the last power
        np.minimum(place, 31, out=place)
        weighed = np.zeros(n + 1, np.uint64)
        np.cumsum(letter * powers[place], out=weighed[1:])
        word = weighed[:n] - np.repeat(weighed[until - size], size)
        word += place.astype(np.uint64)
        word *= np.uint64(0x9FB21C651E98DF25)
        word ^= word >> np.uint64(32)
        word &= ~PAIR
        self.hashes.append(word)

    def decisions(self, code, at, sizes=SLOT_BITS):
        """Of the symbols ``at``: (decisions of each symbol, bit, slots of each table)."""
        n, where = _decisions(code, self.pair[at])
        places = code[2][where]
        return n, code[3][where], [_slots(np.repeat(h[at], n), places, bits) for h, bits in zip(self.hashes, sizes, strict=True)]


def _decisions(code, pair: np.ndarray):
    """(number of decisions of each pair of symbols, their entries in the code)."""
    n = code[0][pair]
    until = np.cumsum(n)
    return n, np.arange(until[-1] if len(n) else 0) + np.repeat(code[1][pair] - until + n, n)


def _slots(context: np.ndarray, places: np.ndarray, bits: int) -> np.ndarray:
    x = context + places
    x *= np.uint64(0xD1342543DE82EF95)
    x >>= np.uint64(64 - bits)
    return x.astype(np.intp)


def _summed(keys: np.ndarray, counts: np.ndarray, kind: str = "stable"):
    """Equal keys once, in order, with the sum of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind=kind)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order], first)


def _merged(parts: list):
    """``_summed`` of (keys, counts) pieces, which are given up."""
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    parts.clear()
    return _summed(keys, counts)


def _slot_counts(keys: np.ndarray, counts: np.ndarray, code, bits: int):
    """(slots in order, counts of zero, of one) from (context hash and pair of symbols) keys and
    their counts, a sixteenth of the table at a time."""
    parts = []
    for at in range(0, len(keys), 1 << 18):              # a context's pairs lie together
        some = keys[at:at + (1 << 18)]
        n, where = _decisions(code, (some & PAIR).astype(np.int64))
        slot = _slots(np.repeat(some & ~PAIR, n), code[2][where], bits)
        parts.append(_summed(slot * 2 + code[3][where], np.repeat(counts[at:at + (1 << 18)], n), "quicksort"))
    if not parts:
        return
    for i in range(16):
        cuts = [np.searchsorted(k, [i << (bits - 3), (i + 1) << (bits - 3)]) for k, _ in parts]
        both, n = _merged([(k[a:b], c[a:b]) for (k, c), (a, b) in zip(parts, cuts, strict=True)])
        if len(both):
            slot, one = both >> 1, both & 1
            first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
            yield slot[first], np.add.reduceat(np.where(one, 0, n), first), np.add.reduceat(np.where(one, n, 0), first)


class Slots:
    """Log odds of the slots that a chunk meets, in their order: the top bits of
    a slot tell where to look, the low bits are compared.  Only slots that are
    there may be asked for."""

    def __init__(self, slots: np.ndarray, odds: np.ndarray, bits: int):
        self._fill([(slots, odds)], len(slots), bits)

    @classmethod
    def of_pieces(cls, pieces, n: int, bits: int):
        """From (slots, odds) pieces in order, ``n`` slots together."""
        made = cls.__new__(cls)
        made._fill(pieces, n, bits)
        return made

    def _fill(self, pieces, n, bits):
        self.bits, self.shift = bits, max(0, bits - max(4, n.bit_length()))
        self.low, self.odds = np.empty(n, np.uint32), np.empty(n, np.int8)
        self.first = np.zeros(1 << (bits - self.shift), np.int32)
        at, last = 0, -1
        for slots, odds in pieces:
            to = at + len(slots)
            self.low[at:to], self.odds[at:to] = slots & ((1 << self.shift) - 1), odds
            top = slots >> self.shift
            new = np.flatnonzero(np.diff(top, prepend=last))
            self.first[top[new]] = new + at
            at, last = to, top[-1] if len(top) else last

    def __len__(self):
        return 1 << self.bits

    def __getitem__(self, slots: np.ndarray) -> np.ndarray:
        at = self.first.take(slots >> self.shift, mode="clip")
        low = (slots & ((1 << self.shift) - 1)).astype(np.uint32)
        left = np.flatnonzero(self.low.take(at, mode="clip") != low)
        while len(left):
            at[left] += 1
            left = left[self.low[at[left]] != low[left]]
        return self.odds[at]


class Paths:
    """Log odds of the decisions that lead to a symbol, by (context hash and pair
    of symbols) key; positive where they speak for the decision that was taken.
    A key has one place in the cache; where another key holds it, the path is
    looked up in the table of slots again.  All paths go when they fill up."""

    def __init__(self, slots, code):
        self.slots, self.code, self.bits = slots, code, len(slots).bit_length() - 1
        self.keys, self.first = np.full(1 << CACHE_BITS, PAIR), np.zeros(1 << CACHE_BITS, np.int32)     # no key ends in PAIR
        self.odds, self.used = np.empty(PATH_ODDS, np.int8), 0

    def starts(self, keys: np.ndarray) -> np.ndarray:
        """Where in ``odds`` each key's path starts, until the next call."""
        at = keys * np.uint64(0xD1342543DE82EF95)
        at >>= np.uint64(64 - CACHE_BITS)
        at = at.view(np.intp)
        left = np.flatnonzero(self.keys.take(at, mode="clip") != keys)
        first = self.first.take(at, mode="clip")
        if not len(left):
            return first
        key, at, began = keys[left], at[left], self.used
        while len(key):
            # of the keys with one place the last gets it; equal keys share its path, others look again
            number = np.arange(len(key), dtype=np.int32)
            self.first[at] = number
            of = self.first[at]
            mine = np.flatnonzero(of == number)
            new = key[mine]
            n, where = _decisions(self.code, (new & PAIR).astype(np.int64))
            if self.used + len(where) > len(self.odds):
                if not began:                            # these keys alone need more room
                    self.odds = np.empty(2 * len(self.odds), np.int8)
                self.keys[:], self.used = PAIR, 0
                return self.starts(keys)
            odds = self.slots[_slots(np.repeat(new & ~PAIR, n), self.code[2][where], self.bits)]
            self.odds[self.used:self.used + len(odds)] = np.where(self.code[3][where] == 1, odds, -odds)
            self.keys[at[mine]], self.first[at[mine]] = new, np.cumsum(n) - n + self.used
            self.used += len(odds)
            same = self.keys[at] == key
            first[left[same]] = self.first[at[same]]
            left, key, at = left[~same], key[~same], at[~same]
        return first


# ----------------------------------------------------------------- passes

def byte_counts(docs: DataFrame) -> tuple:
    """(257 x 257 counts of symbol before and symbol in the training texts, bytes of all texts)."""

    def scan(batches):
        counts, size = np.zeros((END + 1) ** 2, np.int64), 0
        for batch in slices(batches):
            texts, outs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            size += sum(map(len, texts))
            if train := [t.lower() for t, out in zip(texts, outs, strict=True) if not out]:
                _, symbol, before, _ = symbols(train)
                counts += np.bincount(before.astype(np.int64) * (END + 1) + symbol, minlength=len(counts))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([*seen, -1], pa.int32()), pa.array([*counts[seen], size], pa.int64())], names=["s", "c"])

    got = dict(docs.select("text_bytes", "held_out").mapInArrow(scan, "s int, c long").groupBy("s").agg(F.sum("c")).collect())
    size = got.pop(-1, 0)
    counts = np.zeros((END + 1) ** 2, np.int64)
    counts[list(got)] = list(got.values())
    return counts.reshape(END + 1, END + 1), size


_DOCUMENTS = {"doc_ids": pa.list_(pa.int64()), "outs": pa.list_(pa.bool_()), "sizes": pa.list_(pa.int64()), "texts": pa.binary()}
_DOCUMENTS_SCHEMA = "doc_ids array<long>, outs array<boolean>, sizes array<long>, texts binary"


def _learn(docs: DataFrame, code, sizes: list, group_bits: int) -> DataFrame:
    """In one pass, of each chunk: its slots and counts, its words and their training
    counts (tab, group, chunk, slots, counts), its documents (tab: ``TEXTS``, a group
    for each piece, chunk, doc_ids, ...)."""
    kinds = {"tab": pa.int32(), "group": pa.int64(), "chunk": pa.int64(), "slots": pa.binary(), "counts": pa.binary(), **_DOCUMENTS}

    def rows(n, **given):
        return pa.RecordBatch.from_arrays([pa.array(given[c], t) if c in given else pa.nulls(n, t) for c, t in kinds.items()], names=list(kinds))

    def scan(batches):
        from pyspark import TaskContext

        seen, words, held = [[] for _ in sizes], [], []
        chunk_no, bytes_held, part_held = TaskContext.get().partitionId() << 32, 0, 0
        pieces = itertools.count(chunk_no)

        def grouped(tab, of, bits, kind, counts):
            """One row a group of ``of``, whose top bits of ``bits`` are the group."""
            group = (of >> of.dtype.type(bits - group_bits)).astype(np.int64)
            starts = np.flatnonzero(np.diff(group, prepend=-1))
            low = of & of.dtype.type((1 << (bits - group_bits)) - 1)
            cuts = [slice(a, b) for a, b in itertools.pairwise([*starts.tolist(), len(of)])]
            return rows(len(cuts), tab=[tab] * len(cuts), group=group[starts], chunk=[chunk_no] * len(cuts),
                        slots=[squeeze(np.diff(low[c], prepend=low.dtype.type(0)).astype(kind)) for c in cuts],
                        counts=[squeeze(np.concatenate([x[c] for x in counts]).astype(np.uint32)) for c in cuts])

        def chunk():
            for tab, (parts, bits) in enumerate(zip(seen, sizes, strict=True)):
                for slot, *counts in _slot_counts(*_merged(parts), code, bits):
                    yield grouped(tab, slot, bits, np.uint32, counts)
            if words:
                word, n = _merged(words)
                if len(word):
                    yield grouped(WORDS, word, 64, np.uint64, [n])

        def documents():
            ids, outs, texts = zip(*held, strict=True)
            held.clear()
            return rows(1, tab=[TEXTS], group=[next(pieces)], chunk=[chunk_no], doc_ids=[ids], outs=[outs], sizes=[[len(t) for t in texts]], texts=[zstandard.compress(b"".join(texts), 3)])

        def count(texts, train):
            c = Contexts(texts)
            pair = c.pair.astype(np.uint64)
            listed = [(parts, h | pair) for parts, h in zip(seen, c.hashes, strict=True)]
            for parts, every in [*listed, (words, word_hashes(texts)[0])]:
                keys, n = np.unique(every, return_counts=True)
                parts.append((keys, n.astype(np.uint32) * np.uint32(train)))
                if sum(len(k) for k, _ in parts[1:]) > max(1 << 20, len(parts[0][0])):
                    parts.append(_merged(parts))

        some, size = ([], []), [0, 0]
        for batch in slices(batches):
            for doc_id, out, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                text = text.lower()
                held.append((doc_id, out, text))
                bytes_held, part_held = bytes_held + len(text), part_held + len(text)
                some[out].append(text)
                size[out] += len(text)
                full = bytes_held >= CHUNK_BYTES
                for of in (0, 1):
                    if some[of] and (full or size[of] > LIST_BYTES):
                        count(some[of], not of)
                        some[of].clear()
                        size[of] = 0
                if full or part_held >= PART_BYTES or len(held) >= 2000:
                    yield documents()
                    part_held = 0
                if full:
                    yield from chunk()
                    chunk_no, bytes_held = chunk_no + 1, 0
        for of in (0, 1):
            if some[of]:
                count(some[of], not of)
        if held:
            yield documents()
        if any(seen):
            yield from chunk()

    return docs.select("doc_id", "held_out", "text_bytes").mapInArrow(
        scan, f"tab int, group long, chunk long, slots binary, counts binary, {_DOCUMENTS_SCHEMA}")


def _parts(sizes: list, most: int):
    """Slices of at most ``most`` texts and, but for a longer text alone, ``PART_BYTES``."""
    at = 0
    while at < len(sizes):
        to, size = at, 0
        while to < len(sizes) and to < at + most and (to == at or size + sizes[to] <= PART_BYTES):
            size += sizes[to]
            to += 1
        yield slice(at, to)
        at = to


_ODDS_SCHEMA = f"of_chunk long, tab int, group long, slots binary, odds binary, {_DOCUMENTS_SCHEMA}"


def slot_bits(trained: int) -> list:
    """Slots of each table (as a power of two) after so many training bytes."""
    return [max(bits, trained.bit_length()) for bits in SLOT_BITS]


def _sums(table: pa.Table):
    """Of one group of slots or words, from the lists of all chunks: (sizes of the lists, index
    of each entry among the different slots, sums of their counts)."""
    kind, rows = (np.uint64, 1) if table["tab"][0].as_py() == WORDS else (np.uint32, 2)
    slots = [np.cumsum(unsqueeze(raw, kind), dtype=np.uint64) for raw in table["slots"].to_pylist()]
    counts = np.concatenate([unsqueeze(raw).reshape(rows, -1) for raw in table["counts"].to_pylist()], axis=1)
    every = np.concatenate(slots)
    order = np.argsort(every, kind="stable")
    starts = np.diff(every[order], prepend=np.uint64(0)) > 0
    starts[0] = True
    index = np.empty(len(every), np.int64)
    index[order] = np.cumsum(starts) - 1
    return [len(x) for x in slots], index, np.add.reduceat(counts[:, order], np.flatnonzero(starts), axis=1, dtype=np.int64)


def _log_odds(table: pa.Table) -> pa.Table:
    """Of one group: each chunk's slots and their log odds, in steps, or its words and their counts;
    texts go on as they are."""
    if table["tab"][0].as_py() == TEXTS:
        return pa.table({"of_chunk": table["chunk"], "tab": table["tab"], "group": table["group"], "slots": table["slots"],
                         "odds": table["counts"], **{c: table[c] for c in _DOCUMENTS}})
    sizes, index, sums = _sums(table)
    if len(sums) == 2:
        values = np.clip(np.rint(np.log((sums[1] + 0.4) / (sums[0] + 0.4)) * SCALE), -127, 127).astype(np.int8)
    else:
        values = sums[0]
    lists = np.split(values[index], np.cumsum(sizes)[:-1])
    out = pa.table({"of_chunk": table["chunk"], "tab": table["tab"], "group": table["group"], "slots": table["slots"],
                    "odds": pa.array([squeeze(x) for x in lists], pa.binary()),
                    **{c: pa.nulls(len(lists), t) for c, t in _DOCUMENTS.items()}})
    if len(sums) == 2:
        return out
    # no chunk: mentions of the group's words in training texts, and how many words have one
    totals = [NO_CHUNK, WORDS, table["group"][0].as_py(), None, squeeze(np.array([sums.sum(), (sums > 0).sum()], np.int64)), *[None] * len(_DOCUMENTS)]
    return pa.concat_tables([out, pa.table([pa.array([x], f.type) for x, f in zip(totals, out.schema, strict=True)], schema=out.schema)])


def _logs(odds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of log(1 + odds) over stretches of these sizes (none empty): one logarithm for a
    product of at most 32 factors, each at most 1 + exp(12)."""
    n = (sizes + 31) // 32
    until = np.cumsum(n)
    starts = np.arange(until[-1]) * 32 + np.repeat(np.cumsum(sizes) - sizes - (until - n) * 32, n)
    return np.add.reduceat(np.log(np.multiply.reduceat(np.add(odds, 1, dtype=np.float64), starts)), until - n)


def text_scores(texts: list, code, tables: list) -> np.ndarray:
    """log2 probability of each (lowered) text and its end mark."""
    bits = np.zeros(len(texts))
    paths = [t if isinstance(t, Paths) else Paths(t, code) for t in tables]
    order = np.argsort([-len(t) for t in texts], kind="stable")
    for cut in _parts([len(texts[i]) for i in order], 1024):
        some = order[cut]
        c = Contexts([texts[i] for i in some])
        begin = c.end - c.size
        pair = c.pair.astype(np.uint64)
        firsts = [p.starts(h | pair) for p, h in zip(paths, c.hashes, strict=True)]
        lengths = code[0].astype(np.int32)[c.pair]
        # of each table; entry: text * GATES + gate
        weights = [np.tile(w, len(some)) for w in _START.T]
        lost = np.zeros(len(some))
        done, most = 0, int(c.size.max())
        while done < most:
            step = STEP if done < 8 * STEP else LONG_STEP
            live = int(np.searchsorted(-c.size, -done, side="left"))     # sizes fall: texts longer than done
            for group in range(0, live, STEP_BYTES // step):            # texts are independent: few enough for the caches
                to = min(live, group + STEP_BYTES // step)
                n = np.minimum(c.size[group:to] - done, step)
                where = np.arange(int(n.sum())) + np.repeat(begin[group:to] + done - np.cumsum(n) + n, n)
                decisions = lengths[where]
                until = np.cumsum(decisions)
                symbol = np.zeros(until[-1], np.int64)                   # every symbol has a decision
                symbol[until[:-1]] = 1
                np.cumsum(symbol, out=symbol)
                entry = np.arange(until[-1])
                before = until - decisions
                odds = [p.odds[(first[where] - before).take(symbol) + entry] for p, first in zip(paths, firsts, strict=True)]
                ends = until[np.cumsum(n) - 1]                           # decisions end, by text
                taken = np.diff(ends, prepend=0)
                gate = np.repeat(np.arange(0, (to - group) * GATES, GATES), taken)
                gate += _LEVEL_OF.take(odds[-1].view(np.uint8)) * np.uint8(3) + _LEVEL_OF.take(odds[-2].view(np.uint8))
                mine = [w[group * GATES:to * GATES] for w in weights]
                odds = [x.astype(np.float32) for x in odds]
                total = mine[0].take(gate, mode="clip") * odds[0]       # the fastest mode; no gate is out of range
                for w, x in zip(mine[1:], odds[1:], strict=True):
                    total += w.take(gate, mode="clip") * x
                total *= np.float32(-1 / SCALE)
                np.clip(total, -12, 12, out=total)
                wrong = np.exp(total, out=total)                         # odds of the other decision
                lost[group:to] -= _logs(wrong, taken)
                error = wrong / (1 + wrong) * np.float32(RATE / SCALE)
                for w, x in zip(mine, odds, strict=True):
                    w += np.bincount(gate, weights=error * x, minlength=len(w)).astype(np.float32)
            done += step
        bits[some] = lost / math.log(2)
    return bits


def _scores(learned: DataFrame, code, sizes: list, group_bits: int, ends: int) -> DataFrame:
    """Chunk by chunk, from its documents, the log odds of its slots and the counts of its words; log10_counts
    is the base score before the share of N and V.  One more row (``total``): N without the ends as n_tokens, and
    V as n_known."""

    def listed(right: pa.Table, tab: int, bits: int, kind, of, value):
        """A table's (slots or words, values), group by group, in order."""
        mine = right.filter(pc.equal(right["tab"], tab)).sort_by("group")

        def pieces():
            for i in range(mine.num_rows):
                base = of(mine["group"][i].as_py()) << of(bits - group_bits)
                yield np.cumsum(unsqueeze(mine["slots"][i].as_py(), kind), dtype=of) + base, unsqueeze(mine["odds"][i].as_py(), value)

        return pieces()

    def score(rows: pa.Table) -> pa.Table:
        is_text = pc.equal(rows["tab"], TEXTS)
        left = rows.select(list(_DOCUMENTS)).filter(is_text)
        right = rows.drop_columns(list(_DOCUMENTS)).filter(pc.invert(is_text))
        if rows["of_chunk"][0].as_py() == NO_CHUNK:
            n, v = np.sum([unsqueeze(raw, np.int64) for raw in right["odds"].to_pylist()], axis=0).tolist()
            return pa.table([pa.array([x], f.type) for x, f in zip([None, None, n, v, None, None, None, True], schema, strict=True)], schema=schema)
        tables = []
        for tab, bits in enumerate(sizes):
            n = sum(len(odds) for _, odds in listed(right, tab, bits, np.uint32, np.int64, np.int8))
            tables.append(Paths(Slots.of_pieces(listed(right, tab, bits, np.uint32, np.int64, np.int8), n, bits), code))
        none = np.empty(0, np.uint64), np.empty(0, np.int64)
        words, counts = map(np.concatenate, zip(none, *listed(right, WORDS, 64, np.uint64, np.uint64, np.int64), strict=True))
        value, of_end = np.log10(counts + 0.1), math.log10(ends + 0.1)
        out = {name: [] for name in schema.names}
        for i in range(left.num_rows):                  # half a MB of text at a time
            row = left.slice(i, 1).to_pylist()[0]
            whole, until = zstandard.decompress(row["texts"]) if row["texts"] else b"", np.cumsum(row["sizes"]).tolist()
            texts = [whole[b - n:b] for b, n in zip(until, row["sizes"], strict=True)]
            out["log2"] += text_scores(texts, code, tables).tolist()
            hashes, stops = word_hashes(texts)
            at = np.searchsorted(words, hashes)
            stops = np.concatenate([[0], stops])
            known = np.concatenate([[0], np.cumsum(counts[at] > 0)])
            out["n_tokens"] += (np.diff(stops) + 1).tolist()
            out["n_known"] += (np.diff(known[stops]) + (ends > 0)).tolist()
            out["log10_counts"] += [float(value[at[a:b]].sum()) + of_end for a, b in itertools.pairwise(stops.tolist())]
            out["doc_id"] += row["doc_ids"]
            out["held_out"] += row["outs"]
            out["n_bytes"] += row["sizes"]
            out["total"] += [False] * len(texts)
        return pa.table(out, schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("log10_counts", pa.float64()), ("n_bytes", pa.int64()), ("log2", pa.float64()), ("total", pa.bool_())])

    odds = learned.groupBy("tab", "group").applyInArrow(_log_odds, _ODDS_SCHEMA)
    return odds.groupBy("of_chunk").applyInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, log10_counts double, n_bytes long, log2 double, total boolean")


# ---------------------------------------------------------------- operator

def score_texts(docs: DataFrame, modulus: int = 10, remainder: int = 0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    n_bytes, bits_per_byte for every row of ``docs`` (doc_id, text); learned
    from the rows that are not held out.  Scores are log10 probabilities."""
    docs = with_bytes(docs).select("doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), "text_bytes")
    counts, size = byte_counts(docs)
    code = prefix_code(counts)
    trained = int(counts.sum())
    sizes, group_bits = slot_bits(trained), max(6, (trained >> GROUP_BYTES).bit_length())
    # a task works chunk by chunk; few tasks, so that chunks are full
    learned = _learn(docs.coalesce(max(1, math.ceil(size / TASK_BYTES))), code, sizes, group_bits)

    ends = int(counts[:, END].sum())                      # the end is a token like a word
    scored = materialize(_scores(learned, code, sizes, group_bits, ends))
    n_words, n_distinct = scored.where("total").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_known"), F.lit(0))).first()
    total, distinct = n_words + ends, n_distinct + (ends > 0)
    below = math.log10(total + 0.1 * (distinct + 1))
    return scored.where("not total").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        (F.col("log10_counts") - below * F.col("n_tokens")).alias("base_score"), (F.col("log2") * math.log10(2)).alias("score"), "n_bytes",
        (-F.col("log2") / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))


def op1_context_mixing(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
