"""Suffix-array dedup: remove every byte covered by a repeated 400-byte string.

Sorting all suffixes of a corpus would move hundreds of bytes for each byte of
input.  Here only suffixes at content-chosen places are sorted, and the result
is the same, byte by byte:

1. *Anchors.*  In every ``length``-byte window the ``GRAM``-byte substring with
   the least hash is chosen (all, in a tie).  Equal windows choose equal
   substrings at equal offsets, so every repeated window holds an anchor whose
   gram occurs elsewhere; about one position in a hundred is an anchor.
2. An anchor's *context* is the union of all windows around its gram, cut at
   the document's ends.  Occurrences are counted by gram and by context.  A
   gram that occurs once proves its windows unique.  A context that occurs
   twice is repeated as a whole.  What is left are grams with several
   contexts: the edges of copies.
3. *Merge sort.*  One suffix of each such context is taken from its document.
   Every task sorts its suffixes into runs and front-codes them (length of the
   prefix shared with the one before, then the rest).  Runs are dealt out by
   ranges of the gram's hash; a task merges the runs of its range with a loser
   tree that keeps, for each loser, the prefix it shares with its winner, so
   that no known prefix is compared again.  The merge yields the sorted
   suffixes with their common prefixes (a suffix array with its LCP array).
4. From these, and from the same order over the reversed text before the
   anchors, each window offset's equal windows follow, hence the offsets at
   which a context's window occurs in another context.
5. Spans are gathered per document and removed.

A gram with more than ``HOT_CONTEXTS`` contexts never meets in one task: its
windows are counted by Spark, those of blocks that are shared as a whole one by
one, which gives the same offsets.

Nulls and odd rows: a null text is empty; a text shorter than ``length`` keeps
everything.  Rows that repeat a doc_id or a whole row are documents of their
own and copies of each other; a null doc_id is a row like any other.  Matches
never cross documents.  Extra columns are ignored (``dedup`` keeps those of
documents).
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.common import slices, flagged, mix, with_bytes
from terrapanel.session import materialize

LENGTH = 400              # a repeated string of this many bytes is removed
GRAM = 200                # length of an anchor's substring
SEGMENT = 1 << 16         # positions hashed at once
HOT_CONTEXTS = 50_000     # contexts of one gram that one task may sort
HOT_BLOCK = 15            # windows of a hot context that are first looked at as one
HOT_ROWS = 10_000         # contexts or windows of hot grams that a task holds, about
RANGE_SUFFIXES = 20_000   # suffixes merged by one task, about
RUN_SUFFIXES = 50_000     # suffixes of a run

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Grams:
    """Anchors of texts laid end to end.  Substrings are hashed from running
    sums modulo 2**64, a segment at a time."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram, self.reach = length, gram, length - gram
        most = SEGMENT + 4 * length + 8
        self.up, self.down = _powers(_BASE, most), _powers(_INVERSE, most)
        rng = np.random.default_rng(11)
        self.letter = rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)

    def anchors(self, data: np.ndarray, ends: np.ndarray):
        """(place, gram hash, context hash, bytes before, bytes from the anchor on) of each
        anchor; ``ends``: where each text ends.  One entry for each place."""
        found = [self._segment(data, ends, s) for s in range(0, max(0, len(data) - self.length + 1), SEGMENT)]
        found = [x for x in found if len(x[0])]
        if not found:
            return tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
        place, *rest = (np.concatenate(x) for x in zip(*found, strict=True))
        place, first = np.unique(place, return_index=True)
        return place, *(x[first] for x in rest)

    def _segment(self, data, ends, s):
        e = min(s + SEGMENT, len(data) - self.length + 1)          # windows that start in [s, e)
        lo, hi = max(0, s - self.reach), min(len(data), e + self.reach + self.length + 1)
        part = self.letter[data[lo:hi]]
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(part * self.down[:hi - lo], out=total[1:])
        n = e - s + self.reach                                     # grams that start in [s, s + n)
        at = s - lo
        gram = (total[at + self.gram:at + self.gram + n] - total[at:at + n]) * self.up[at:at + n]
        gram = mix(gram)
        short = (gram >> np.uint64(32)).astype(np.uint32)
        width, least = 1, short
        while 2 * width <= self.reach + 1:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        over = self.reach + 1 - width
        if over:
            least = np.minimum(least[:-over], least[over:])        # least of each window
        owner = np.searchsorted(ends, np.arange(s, e), side="right") if len(ends) < 64 else None
        if owner is not None:
            crosses = np.arange(s, e) + self.length > ends[owner]
        else:
            crosses = np.zeros(e - s, bool)
            for end in ends[(ends > s) & (ends < e + self.length)]:
                crosses[max(0, end - self.length + 1 - s):max(0, end - s)] = True
        least = np.where(crosses, np.uint32(0), least)
        most = np.concatenate([np.zeros(self.reach, np.uint32), least, np.zeros(self.reach, np.uint32)])
        width = 1
        while 2 * width <= self.reach + 1:
            most = np.maximum(most[:-width], most[width:])
            width *= 2
        if over:
            most = np.maximum(most[:-over], most[over:])           # of the windows that hold the gram
        place = np.flatnonzero((most == short) & (most > 0))
        fp = gram[place]
        place = place + s
        which = np.searchsorted(ends, place, side="right")
        end = ends[which]
        begin = np.where(which > 0, ends[which - 1], 0)
        before = np.minimum(self.reach, place - begin)
        after = np.minimum(self.length, end - place)
        a, b = place - before - lo, place + after - lo
        context = mix(mix((total[b] - total[a]) * self.up[a]) + before.astype(np.uint64) * np.uint64(1_000_003)
                      + after.astype(np.uint64))
        return place, fp, context, before, after


def _anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    schema = "doc_id long, doc_hash long, pos int, before short, after short, fp long, ctx long"

    def scan(batches):
        grams = Grams(length, gram)
        for batch in slices(batches):
            texts = batch.column(2).to_pylist()
            ends = np.cumsum([len(t) for t in texts])
            place, fp, ctx, before, after = grams.anchors(np.frombuffer(b"".join(texts), np.uint8), ends)
            which = np.searchsorted(ends, place, side="right")
            begin = np.concatenate([[0], ends[:-1]])[which] if len(ends) else place
            take = pa.array(which)
            for at in range(0, len(place), 100_000):
                cut = slice(at, at + 100_000)
                rows = take[cut]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(rows), batch.column(1).take(rows),
                    pa.array((place - begin)[cut], pa.int32()), pa.array(before[cut], pa.int16()),
                    pa.array(after[cut], pa.int16()), pa.array(fp[cut].view(np.int64)), pa.array(ctx[cut].view(np.int64))],
                    names=["doc_id", "doc_hash", "pos", "before", "after", "fp", "ctx"])

    return docs.select("doc_id", "doc_hash", "text_bytes").mapInArrow(scan, schema)


# ------------------------------------------------------------- the merge

def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    n = min(len(a), len(b))
    step = 32
    while known < n:
        if a[known:known + step] == b[known:known + step]:
            known = min(n, known + step)
            step = 256
        elif step == 1:
            return known
        else:
            step = max(1, step // 8)
            if step == 32:
                step = 16
    return known


def front_code(keys: list) -> tuple:
    """(shared, rest) of sorted strings: the prefix shared with the one before, and what follows it."""
    shared, rest, last = [], [], b""
    for key in keys:
        h = common_prefix(last, key, 0)
        shared.append(h)
        rest.append(key[h:])
        last = key
    return shared, rest


def merge_runs(runs: list):
    """Merge front-coded runs [(shared, rest)]: yields (run, index in run, key,
    prefix shared with the key before), in order.

    A loser tree whose losers keep the prefix they share with the last winner
    that passed them: a longer one wins unseen, and only equal ones are
    compared, from there on."""
    k = 1
    while k < max(1, len(runs)):
        k *= 2
    key: list = [None] * k
    shared = [0] * k
    index = [-1] * k

    def advance(r: int) -> None:
        index[r] += 1
        if r < len(runs) and index[r] < len(runs[r][0]):
            h = runs[r][0][index[r]]
            key[r] = (key[r][:h] if h else b"") + runs[r][1][index[r]]
            shared[r] = h
        else:
            key[r], shared[r] = None, -1

    def play(a: int, b: int) -> tuple:
        """(winner, loser); an ended run always loses."""
        if key[a] is None or key[b] is None:
            return (b, a) if key[a] is None else (a, b)
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        h = common_prefix(key[a], key[b], shared[a])
        if key[a][h:h + 1] <= key[b][h:h + 1]:
            shared[b] = h
            return a, b
        shared[a] = h
        return b, a

    for r in range(k):
        advance(r)
    losers = [0] * k
    winners = [0] * (2 * k)
    winners[k:] = range(k)
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1] if k > 1 else 0
    while key[top] is not None:
        yield top, index[top], key[top], shared[top]
        advance(top)
        node = (top + k) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


def repeated_offsets(shared: np.ndarray, before: list, length: int, gram: int) -> np.ndarray:
    """For sorted suffixes (``shared``: prefix shared with the one above, the
    text before each): a boolean row per suffix; column o: the window that
    starts o bytes before the anchor equals another suffix's."""
    m, reach = len(shared), length - gram
    order = sorted(range(m), key=lambda i: before[i][::-1])
    width = max(1, reach)
    left = np.zeros((m, width), np.uint8)
    sizes = np.array([len(before[i]) for i in order])
    for row, i in enumerate(order):
        left[row, :len(before[i])] = np.frombuffer(before[i][::-1], np.uint8)
    same = np.zeros(m, np.int64)
    if m > 1:
        differ = left[1:] != left[:-1]
        same[1:] = np.minimum(np.where(differ.any(1), differ.argmax(1), width), np.minimum(sizes[1:], sizes[:-1]))
    rank = np.empty(m, np.int64)
    rank[np.array(order, np.int64)] = np.arange(m)
    out = np.zeros((m, reach + 1), bool)
    for o in range(reach + 1):
        right_class = np.cumsum(shared < length - o)
        left_class = np.cumsum(same < o)[rank] if o else np.zeros(m, np.int64)
        _, group, count = np.unique(right_class * (m + 1) + left_class, return_inverse=True, return_counts=True)
        out[:, o] = count[group] > 1
    return out


def _spans_of(offsets: np.ndarray, length: int) -> list:
    """(start, end) relative to the anchor of the bytes covered by windows at these offsets."""
    at = np.flatnonzero(offsets)
    if not len(at):
        return []
    cuts = np.flatnonzero(np.diff(at) > 1)
    first, last = at[np.concatenate([[0], cuts + 1])], at[np.concatenate([cuts, [len(at) - 1]])]
    return [(-int(b), length - int(a)) for a, b in zip(first, last, strict=True)]


_RUNS = ("rng int, shared array<int>, rest array<binary>, before array<binary>, doc_id array<long>, "
         "doc_hash array<long>, pos array<int>, n array<long>")


def _runs(taken: DataFrame, ranges: int, length: int, reach: int) -> DataFrame:
    """Sorted, front-coded runs of the suffixes of this task, one for each range."""

    def blocks(entries):
        entries.sort(key=lambda x: (x[0], x[1]))
        at = 0
        while at < len(entries):
            rng, to = entries[at][0], at
            while to < len(entries) and entries[to][0] == rng:
                to += 1
            part = entries[at:to]
            shared, rest = front_code([x[1] for x in part])
            yield pa.RecordBatch.from_pylist([{
                "rng": rng, "shared": shared, "rest": rest, "before": [x[2] for x in part], "doc_id": [x[3] for x in part],
                "doc_hash": [x[4] for x in part], "pos": [x[5] for x in part], "n": [x[6] for x in part]}], schema=out)
            at = to

    out = pa.schema([("rng", pa.int32()), ("shared", pa.list_(pa.int32())), ("rest", pa.list_(pa.binary())),
                     ("before", pa.list_(pa.binary())), ("doc_id", pa.list_(pa.int64())), ("doc_hash", pa.list_(pa.int64())),
                     ("pos", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])

    def scan(batches):
        entries = []
        for batch in slices(batches):
            for row in batch.to_pylist():
                text = row["text_bytes"]
                for c in row["contexts"]:
                    a = c["pos"]
                    entries.append(((c["fp"] & ((1 << 63) - 1)) % ranges, text[a:a + length], text[max(0, a - reach):a],
                                    row["doc_id"], row["doc_hash"], a, c["n"]))
                if len(entries) >= RUN_SUFFIXES:
                    yield from blocks(entries)
                    entries = []
        yield from blocks(entries)

    return taken.mapInArrow(scan, _RUNS)


def _merged_spans(runs: DataFrame, length: int, gram: int) -> DataFrame:
    """Spans of contexts that occur once, from the merged runs of each range."""

    def merge(table: pa.Table) -> pa.Table:
        cols = {c: table[c].to_pylist() for c in table.column_names}
        order, shared = [], []
        for run, i, _, h in merge_runs(list(zip(cols["shared"], cols["rest"], strict=True))):
            order.append((run, i))
            shared.append(h)
        found: list = []
        if order:
            before = [cols["before"][r][i] for r, i in order]
            offsets = repeated_offsets(np.array(shared), before, length, gram)
            for (r, i), row in zip(order, offsets, strict=True):
                if cols["n"][r][i] == 1 and row.any():
                    found += [(cols["doc_id"][r][i], cols["doc_hash"][r][i], cols["pos"][r][i] + s, cols["pos"][r][i] + e)
                              for s, e in _spans_of(row, length)]
        a, b, c, d = zip(*found, strict=True) if found else ((), (), (), ())
        return pa.table({"doc_id": pa.array(a, pa.int64()), "doc_hash": pa.array(b, pa.int64()),
                         "start": pa.array(c, pa.int32()), "end": pa.array(d, pa.int32())})

    return runs.groupBy("rng").applyInArrow(merge, "doc_id long, doc_hash long, start int, end int")


def _hot_contexts(taken: DataFrame, length: int, reach: int) -> DataFrame:
    """(doc_id, doc_hash, n, pos, before, after) of each context: its text up to the anchor, and from there on."""

    def scan(batches):
        for batch in slices(batches):
            which, found = [], []

            def out():
                rows = pa.array(which, pa.int64())
                n, pos, before, after = zip(*found, strict=True)
                return pa.RecordBatch.from_arrays([
                    batch.column(0).take(rows), batch.column(1).take(rows), pa.array(n, pa.int64()), pa.array(pos, pa.int32()),
                    pa.array(before, pa.binary()), pa.array(after, pa.binary())], names=["doc_id", "doc_hash", "n", "pos", "before", "after"])

            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py()
                for c in batch.column(3)[i].as_py():
                    a = c["pos"]
                    which.append(i)
                    found.append((c["n"], a, text[max(0, a - reach):a], text[a:a + length]))
                if len(found) >= HOT_ROWS:
                    yield out()
                    which, found = [], []
            if found:
                yield out()

    return taken.select("doc_id", "doc_hash", "text_bytes", "contexts").mapInArrow(
        scan, "doc_id long, doc_hash long, n long, pos int, before binary, after binary")


def _hot_spans(taken: DataFrame, length: int, reach: int) -> DataFrame:
    """The same spans for grams with very many contexts: rows counted by Spark.

    First what all windows of a block have in common is a row, for blocks of
    ``HOT_BLOCK`` neighbouring windows; a block whose core occurs in no other
    context holds no repeated window.  Then every window of the others is a row."""
    contexts = materialize(_hot_contexts(taken, length, reach).withColumn("cid", F.monotonically_increasing_id()))

    def cores(batches):
        for batch in slices(batches):
            cid, block, w = [], [], []
            for i, before, after in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                for at in range(0, min(reach, len(before)) + 1, HOT_BLOCK):
                    least = length - min(at + HOT_BLOCK - 1, reach)          # bytes from the anchor on in all windows of the block
                    if least <= len(after):
                        cid.append(i)
                        block.append(at)
                        w.append(xxhash.xxh3_64_intdigest(before[len(before) - at:] + after[:least], at) - (1 << 63))
            yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array(block, pa.int32()), pa.array(w, pa.int64())],
                                             names=["cid", "block", "w"])

    blocks = materialize(contexts.select("cid", "before", "after").mapInArrow(cores, "cid long, block int, w long"))
    shared = blocks.groupBy("w").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("w")
    open_ = blocks.join(shared, "w", "left_semi").groupBy("cid").agg(F.collect_list("block").alias("blocks"))   # at most one of each block

    def scan(batches):
        for batch in slices(batches):
            which, start, w = [], [], []

            def out():
                rows = pa.array(which, pa.int64())
                return pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in range(3)), pa.array(start, pa.int32()), pa.array(w, pa.binary())],
                                                  names=["doc_id", "doc_hash", "n", "start", "w"])

            for i, (pos, before, after, found) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3, 7)), strict=True)):
                text, a = before + after, len(before)
                for at in found:
                    for o in range(at, min(at + HOT_BLOCK - 1, reach) + 1):
                        if o <= a and length - o <= len(after):
                            which.append(i)
                            start.append(pos - o)
                            w.append(hashlib.blake2b(text[a - o:a - o + length], digest_size=16).digest() + o.to_bytes(2, "big"))
                if len(w) >= HOT_ROWS:
                    yield out()
                    which, start, w = [], [], []
            if w:
                yield out()

    windows = materialize(contexts.join(open_, "cid").select("doc_id", "doc_hash", "n", "pos", "before", "after", "blocks").mapInArrow(
        scan, "doc_id long, doc_hash long, n long, start int, w binary"))
    often = windows.groupBy("w").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("w")
    return windows.where("n = 1").join(often, "w").select(
        "doc_id", "doc_hash", "start", (F.col("start") + length).alias("end"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int | None = None) -> DataFrame:
    """(doc_id, doc_hash, spans: array<struct<start, end>>) of the documents that
    hold bytes of a repeated string; spans overlap and are in no order.
    ``docs``: doc_id, doc_hash, text_bytes."""
    gram = gram or (GRAM if length == LENGTH else length // 2)
    reach = length - gram
    anchors = materialize(_anchor_rows(docs, length, gram))
    classes = anchors.groupBy("fp", "ctx").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "doc_hash", "pos")).alias("rep"))
    of_gram = classes.groupBy("fp").agg(F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("all"))
    classes = materialize(classes.join(of_gram.where("all > 1"), "fp").where("n > 1 or contexts > 1"))
    whole = anchors.join(classes.where("n > 1").select("fp", "ctx"), ["fp", "ctx"], "left_semi").select(
        "doc_id", "doc_hash", (F.col("pos") - F.col("before")).alias("start"), (F.col("pos") + F.col("after")).alias("end"))

    mixed = classes.where("contexts > 1").select(F.col("rep.doc_id").alias("doc_id"), F.col("rep.doc_hash").alias("doc_hash"),
                                                 F.struct(F.col("rep.pos").alias("pos"), "fp", "n").alias("c"), "contexts")
    sizes = mixed.agg(F.sum((F.col("contexts") <= HOT_CONTEXTS).cast("long")), F.sum((F.col("contexts") > HOT_CONTEXTS).cast("long"))).first()
    parts = [whole]
    for few, n in ((True, sizes[0] or 0), (False, sizes[1] or 0)):
        if not n:
            continue
        per_doc = mixed.where((F.col("contexts") <= HOT_CONTEXTS) == F.lit(few)).groupBy("doc_id", "doc_hash").agg(
            F.collect_list("c").alias("contexts"))       # at most one entry for each byte of the document
        taken = (flagged(docs, per_doc, "doc_hash").where("hit").alias("d").join(per_doc.alias("p"), F.expr("d.doc_id <=> p.doc_id and d.doc_hash = p.doc_hash"))
                 .select("d.doc_id", "d.doc_hash", "d.text_bytes", "p.contexts").dropDuplicates(["doc_id", "doc_hash"]))
        parts.append(_merged_spans(_runs(taken, math.ceil(n / RANGE_SUFFIXES), length, reach), length, gram) if few
                     else _hot_spans(taken, length, reach))
    spans = parts[0]
    for more in parts[1:]:
        spans = spans.unionByName(more)
    return spans.groupBy("doc_id", "doc_hash").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def union_spans(spans, n: int) -> list:
    """Sorted disjoint (start, end), spans that touch joined."""
    out: list = []
    for s, e in sorted(spans):
        s, e = max(0, s), min(n, e)
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def removal(docs: DataFrame, length: int = LENGTH, gram: int | None = None, carry: tuple = (),
            keep_text: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans,
    kept_sha256, the columns ``carry`` and, if asked, ``kept``: the bytes left,
    as text (a character of which a part went, goes)."""
    docs = with_bytes(docs).withColumn("doc_hash", F.xxhash64("text_bytes"))
    spans = materialize(repeated_spans(docs.select("doc_id", "doc_hash", "text_bytes"), length, gram))
    split = flagged(docs.select("doc_id", "doc_hash", "text_bytes", *carry), spans, "doc_hash")
    kind = "array<struct<start:int,end:int>>"
    hit = split.where("hit").alias("d").join(spans.alias("p"), F.expr("d.doc_id <=> p.doc_id and d.doc_hash = p.doc_hash"), "left")
    rows = hit.select("d.doc_id", "d.text_bytes", F.col("p.spans").cast(kind).alias("spans"), *[f"d.{c}" for c in carry]).unionByName(
        split.where("not hit").select("doc_id", "text_bytes", F.lit(None).cast(kind).alias("spans"), *carry))

    def scan(batches):
        for batch in slices(batches):
            size, gone, count, digest, left = [], [], [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                cut = union_spans([(x["start"], x["end"]) for x in found or ()], len(text))
                at, parts = 0, []
                for s, e in cut:
                    parts.append(text[at:s])
                    at = e
                parts.append(text[at:])
                kept = b"".join(parts)
                size.append(len(text))
                gone.append(len(text) - len(kept))
                count.append(len(cut))
                digest.append(hashlib.sha256(kept).hexdigest())
                left.append(kept.decode("utf-8", "ignore") if keep_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()),
                 pa.array(digest, pa.string()), *[batch.column(3 + i) for i in range(len(carry))]]
                + [pa.array(left, pa.string())] * keep_text, names=names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *carry] + ["kept"] * keep_text
    kinds = ["long", "long", "long", "long", "string", *[docs.schema[c].dataType.simpleString() for c in carry]] + ["string"] * keep_text
    return rows.mapInArrow(scan, ", ".join(f"`{n}` {t}" for n, t in zip(names, kinds, strict=True)))


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` (doc_id, text, lang, source, n_chars) with the repeated bytes
    taken out of ``text``; ``n_chars`` follows.  Every row stays."""
    out = removal(docs.select("doc_id", "text", "lang", "source"), length, carry=("lang", "source"), keep_text=True)
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return removal(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
