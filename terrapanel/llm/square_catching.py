"""Periodic runs of words, found by online dyadic square catching.

A *run* is a longest stretch of consecutive words with smallest period q: words
q apart are equal.  The catcher reads a stream of words, a stride at a time;
what it reports does not depend on how the stream is cut (one word a stride
gives the same runs; tested).

1. *Blocks.*  At level l the stream is cut into blocks of m = 2**l words.  Every
   place has the name (64-bit hash) of the m words that start there; a level's
   names are made from two of the level below.
2. *Catchers.*  A completed block at b waits for squares of periods q in [m, 2m):
   the word that completes the m words at b + q advances its comparison of
   these with the block.  At one place a level has one waiting block, so one
   comparison a word and level, done as a vector over the stride.  A run of at
   least three periods holds an aligned block with its copy, so it is caught.
3. *Suffix comparisons.*  A caught (b, q) is followed to the left over what is
   known and to the right; one still equal at the end of the stream stays open,
   and the words of the next stride advance it.  The same period caught again
   inside is the same run, and squares merge into it.
4. *Smaller periods.*  A copy that lies inside a stretch of a lower level, whose
   period r is below m, has length >= q + r; q is then a multiple of r and
   the square is that stretch's, so it is not followed.  One that was caught
   before the lower level's stretch was long enough is told by the run of the
   smaller period that holds it.

Time is the words times the levels (periods up to n / 4) and the lengths of
the runs; memory is the texts since the last word that ended all, times the
levels: a task's stride of short texts, or one long text.

Defined results: a null text has no words; without words or runs the four
columns of the greatest run are null and the digests are those of what there is
(no run: of nothing; all words are kept).  Rows that repeat an id or a whole
row are scored one by one; a null id counts as the empty text in the crc32.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terrapanel.llm.common import WordHashes, mix, slices, with_bytes

LEAST_LENGTH = 6          # words of a run, at least
LEAST_EXPONENT = 4        # periods of a run, at least
STRIDE = 1 << 16          # words appended at once
BATCH_BYTES = 1 << 22     # text bytes of one stream of texts

_ODD = np.uint64(0x9E3779B97F4A7C15)


class SquareCatcher:
    """Runs of at least ``exponent`` (three or more) periods in a stream of word
    numbers (uint64; equal words, equal numbers).

    ``append`` takes the next words; ``runs()`` are the (start, end, period)
    of all runs so far, one that still holds at the end of the stream with the
    end it has now."""

    def __init__(self, exponent: int = LEAST_EXPONENT):
        if exponent < 3:
            raise ValueError("squares are caught by aligned blocks of runs of three periods or more")
        self.exponent = exponent
        self.words = np.empty(0, np.uint64)
        self.size = 0
        self.names: list = []         # level -> names of the places, filled up to size - m
        self.done: list = []          # closed runs (start, end, period)
        self.open: dict = {}          # period -> start of the stretch that holds to the end of the stream
        self.reached: dict = {}       # period -> end of its last stretch, however short

    def _room_for(self, n: int) -> None:
        if n > len(self.words):
            words = np.zeros(max(n, 2 * len(self.words)), np.uint64)
            words[:self.size] = self.words[:self.size]
            self.words = words

    def append(self, words: np.ndarray) -> None:
        before = self.size
        self._room_for(before + len(words))
        self.size += len(words)
        self.words[before:self.size] = words
        for q, start in list(self.open.items()):
            end = self._right(before, q)
            self.reached[q] = end
            if end < self.size:
                del self.open[q]
                self._close(start, end, q)
        level, m = 0, 1
        while self.exponent * m <= self.size:
            self._level(level, m)
            level, m = level + 1, 2 * m

    def runs(self) -> list:
        found = self.done + [(start, self.size, q) for q, start in self.open.items() if self.size - start >= self.exponent * q]
        found.sort(key=lambda run: (run[0], -run[1], run[2]))
        out, holding = [], []                        # runs that may hold the next one
        for start, end, q in found:
            holding = [(e, r) for e, r in holding if e > start]
            if not any(e >= end and r < q for e, r in holding):
                out.append((start, end, q))
            holding.append((end, q))
        return sorted((s, e, q) for s, e, q in out)

    # ---- one level

    def _level(self, level: int, m: int) -> None:
        """Advance this level's catchers to the end of the stream."""
        if level == len(self.names):
            self.names.append((np.empty(0, np.uint64), 0))
        names, at = self.names[level]
        to = self.size - m + 1                       # places whose m words are known
        if to <= at:
            return
        if level == 0:
            names = self.words                       # grows with the words
        else:
            if to > len(names):
                wider = np.zeros(max(to, 2 * len(names)), np.uint64)
                wider[:at] = names[:at]
                names = wider
            below, half = self.names[level - 1][0], m // 2
            names[at:to] = mix(below[at:to] * _ODD + below[at + half:to + half])
        self.names[level] = (names, to)
        first = max(at, m)
        if first >= to:
            return
        place = np.arange(first, to)
        block = (place // m - 1) * m
        hit = np.flatnonzero(names[first:to] == names[block])
        if not len(hit):
            return
        place, block = place[hit], block[hit]
        place, block = self._not_covered(place, block, m)
        q = place - block
        alive = self._worth(place, q, m)
        for p, d in zip(place[alive].tolist(), q[alive].tolist(), strict=True):
            if d in self.open or p + m <= self.reached.get(d, 0):
                continue
            start, end = self._left(p, d) - d, self._right(p + m, d)
            self.reached[d] = end
            if end == self.size:
                self.open[d] = start
            else:
                self._close(start, end, d)

    def _not_covered(self, place, block, m):
        """Without the copies that lie inside a run of a period below m."""
        lower = [(s, e) for s, e, q in self.done if q < m and e >= block[0]]
        lower += [(s, self.size) for q, s in self.open.items() if q < m]
        if not lower:
            return place, block
        lower.sort()
        starts = np.array([s for s, _ in lower])
        ends = np.maximum.accumulate(np.array([e for _, e in lower]))
        # the furthest end among the runs that start at or before the block: the run holds both if it reaches so far
        at = np.searchsorted(starts, block, side="right") - 1
        inside = (at >= 0) & (ends[np.maximum(at, 0)] >= place + m)
        return place[~inside], block[~inside]

    def _worth(self, place, q, m) -> np.ndarray:
        """Which copies may become runs: those not yet known to end short.  A run's
        copies and their words one period before are equal over (exponent - 1) * q
        words; a few words each way are compared at once."""
        right, left = place + m, place - 1
        alive_r, alive_l = np.ones(len(place), bool), np.ones(len(place), bool)
        have = np.full(len(place), m, np.int64)
        need = (self.exponent - 1) * q
        for _ in range(8):
            inside = right < self.size
            same = np.zeros(len(place), bool)
            look = np.flatnonzero(alive_r & inside)
            same[look] = self.words[right[look]] == self.words[right[look] - q[look]]
            alive_r &= same | ~inside
            have += same
            right = right + same
            look = np.flatnonzero(alive_l & (left - q >= 0))
            same = np.zeros(len(place), bool)
            same[look] = self.words[left[look]] == self.words[left[look] - q[look]]
            alive_l &= same
            have += same
            left = left - same
            if not (alive_r | alive_l).any():
                break
        return alive_r | alive_l | (have >= need)

    def _right(self, at: int, q: int) -> int:
        """The first place from ``at`` on whose word differs from that q before, or the end."""
        words, step = self.words, 64
        while at < self.size:
            to = min(self.size, at + step)
            differ = words[at:to] != words[at - q:to - q]
            if differ.any():
                return at + int(differ.argmax())
            at, step = to, 4 * step
        return at

    def _left(self, at: int, q: int) -> int:
        """The first place of the stretch of words equal to those q before that ends at ``at``."""
        words, step = self.words, 64
        while at > q:
            to = max(q, at - step)
            differ = words[to:at] != words[to - q:at - q]
            if differ.any():
                return at - int(differ[::-1].argmax())
            at, step = to, 4 * step
        return at

    def _close(self, start: int, end: int, q: int) -> None:
        if end - start >= self.exponent * q:
            self.done.append((start, end, q))


def runs_of_words(words: np.ndarray, stride: int = STRIDE, least: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> list:
    """(start, length, period) of the runs of one text, by start, then period."""
    catcher = SquareCatcher(exponent)
    for at in range(0, len(words), stride):
        catcher.append(words[at:at + stride])
    return [(s, e - s, q) for s, e, q in catcher.runs() if e - s >= least]


def runs_of_texts(numbers: list, least: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> list:
    """The runs of each of several texts: short ones are one stream, between texts
    words that equal nothing."""
    out: list = [[] for _ in numbers]
    group: list = []

    def flush():
        starts, parts, at = [], [], 0
        for k, i in enumerate(group):
            starts.append(at)
            parts += [numbers[i], np.array([mix(np.array([k], np.uint64) + _ODD)[0]], np.uint64)]
            at += len(numbers[i]) + 1
        first = np.array(starts)
        for s, n, q in runs_of_words(np.concatenate(parts), STRIDE, least, exponent):
            k = int(np.searchsorted(first, s, side="right")) - 1
            out[group[k]].append((s - starts[k], n, q))
        group.clear()

    words = 0
    for i, x in enumerate(numbers):
        if len(x) < least:
            continue
        if group and words + len(x) > STRIDE:
            flush()
            words = 0
        group.append(i)
        words += len(x) + 1
    if group:
        flush()
    return out


def collapsed(n: int, runs: list) -> np.ndarray:
    """Which of n words stay: of every run its first period only."""
    gone = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        gone[start + q] += 1
        gone[start + length] -= 1
    return np.cumsum(gone[:n]) == 0


def repeat_tail(n: int, doc_id) -> np.ndarray | None:
    """Which original word stands at each place where a text's tail is made to
    repeat (one id in ten), None for the other ids."""
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def greatest(runs: list):
    """The run of the greatest exponent (ties: least start, then period), compared exactly."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


SCHEMA = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")


def find_runs(docs: DataFrame, change=None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the number of runs, the greatest run,
    a digest of all and one of the text without the repeated periods.

    ``change(n, doc_id)`` may give, for a text of n words, the original word at each place."""

    def scan(batches):
        hashes = WordHashes()
        for batch in slices(batches, 250):
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(ids):
                to, size = at, 0
                words = []
                while to < len(ids) and (to == at or size < BATCH_BYTES):
                    text = texts[to].as_py()
                    size += len(text)
                    words.append(text.split())
                    to += 1
                yield _rows(ids[at:to], words, hashes, change)
                at = to

    return with_bytes(docs).select("doc_id", "text_bytes").mapInArrow(scan, SCHEMA)


def _rows(ids: list, words: list, hashes: WordHashes, change) -> pa.RecordBatch:
    numbers = [hashes.of(w) for w in words]
    if change is not None:
        for k, doc_id in enumerate(ids):
            order = change(len(words[k]), doc_id)
            if order is not None:
                numbers[k] = numbers[k][order]
                words[k] = [words[k][i] for i in order.tolist()]
    columns: list = [[] for _ in range(7)]
    for w, runs in zip(words, runs_of_texts(numbers), strict=True):
        best = greatest(runs)
        kept = w
        if runs:
            stay = collapsed(len(w), runs).tolist()
            kept = [x for x, yes in zip(w, stay, strict=True) if yes]
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        row = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
               hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())
        for column, value in zip(columns, row, strict=True):
            column.append(value)
    kinds = [pa.int64()] * 5 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                      names=[x.split()[0] for x in SCHEMA.split(", ")])


SQL = r"""
with told as (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w0,
    coalesce(doc_id::varchar, '') as id
  from documents),
hashed as (
  select r, doc_id, w0, len(w0) as n, xor(4294967295, list_reduce(
    list_concat([4294967295::bigint], list_transform(range(1, length(id) + 1), lambda i: ascii(substr(id, i::int, 1))::bigint)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384)))) as h
  from told),
shaped as (
  select *, case when n > 0 then (h // 10) % n end as a from hashed),
parts as (
  select *, 1 + (n - a) // (3 + (h // 10) % 8) as p from shaped),
texts as (
  select r, doc_id, n, case when h % 10 = 0 and n > 0
    then list_transform(range(n), lambda i: w0[1 + case when i < a then i else a + (i - a) % p end]) else w0 end as w
  from parts),
words as (select r, n, unnest(range(n)) as i, unnest(w) as word from texts),
pairs as (
  select y.r, y.i, y.i - x.i as q
  from words x join words y on x.r = y.r and x.word = y.word and y.i > x.i and 4 * (y.i - x.i) <= y.n),
marked as (select r, q, i, i - row_number() over (partition by r, q order by i) as stretch from pairs),
stretches as (
  select r, q, min(i) - q as s, count(*) + q as len from marked group by r, q, stretch having count(*) + q >= 4 * q),
runs as (
  select * from stretches c where len >= 6 and not exists (
    select 1 from stretches b where b.r = c.r and b.q < c.q and b.s <= c.s and b.s + b.len >= c.s + c.len)),
best as (
  select r, s, len, q from runs qualify row_number() over (
    partition by r order by len // q desc, ((len % q) * 1000000007) // q desc, s, q) = 1),
listed as (
  select r, count(*) as n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' order by s, q) as lines from runs group by r),
gone as (select distinct r, unnest(range(s + q, s + len)) as i from runs),
kept as (
  select w.r, string_agg(w.word, ' ' order by w.i) as txt
  from words w left join gone g on g.r = w.r and g.i = w.i where g.r is null group by w.r)
select t.doc_id, coalesce(l.n_runs, 0) as n_runs, b.s as start, b.len as length, b.q as period,
  1000 * b.len // b.q as exponent_milli, sha256(coalesce(l.lines, '')) as runs_sha256, sha256(coalesce(k.txt, '')) as collapsed_sha256
from texts t left join listed l on l.r = t.r left join best b on b.r = t.r left join kept k on k.r = t.r
"""


def op13_square_catching(spark, sf_dir: str) -> DataFrame:
    """Every tenth id's tail repeats, as the contract of this query says; the others are taken as they are."""
    return find_runs(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), repeat_tail)
