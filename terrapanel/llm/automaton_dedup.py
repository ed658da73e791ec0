"""Substring dedup with suffix automata of reference shards.

A *window* is 13 consecutive words of one document.  Every word covered by a
window whose words also start in a document with a smaller id goes; windows are
judged on the input.

1. *Passages.*  Each window is named by the 5-word gram in it with the least
   hash (the first of equals), so equal windows have equal grams at equal
   offsets.  The windows of one gram in one place form a passage of 13 to 21
   words: every window lies in one passage, and two equal windows lie in
   passages of the same gram.
2. *Reference.*  Grams are reduced to the least and greatest id that hold them;
   only those of two ids go on.  Their passages are counted by gram and words,
   however often they occur, with the least id of each: the reference holds
   every repeated passage once.
3. *Shards.*  A gram deals its passages to a shard of some ``SHARD`` passages.
   The shard's suffix automaton keeps in every state the least id in which the
   state's word strings occur.  It goes to the one task that streams this
   shard's passages, not to all: the reference grows with the corpus, so
   sending every automaton to every task would cost shards times documents.
4. *Matching statistics.*  The automaton reads each passage word by word and
   keeps the longest match that ends there, cut to 13 words; at 13 or more, the
   state's least id is that of the window.
5. Documents take the windows whose id is smaller than their own; spans that
   touch are joined, and their words removed.

A gram with more than ``CROWDED`` different passages never meets in one task:
its passages are cut into their windows, which are reduced to one row each and
dealt by their own hash; results are the same.

Words are compared by 64-bit hashes.  Nulls and odd rows: a null text has no
words; a text of fewer than 13 words keeps all.  A null doc_id comes after all
others: its windows go where a document with an id holds them, and it takes
none from others.  Rows of one id never lose words to each other; repeated rows
are each their own row of the result.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.common import (BLOCK_SCHEMA, blocks_of, flagged, gather_blocks, mix, slices, sum_blocks,
                                   window_hashes, with_bytes)
from terrapanel.session import materialize

WINDOW = 13               # words of a window
GRAM = 5                  # words of the gram that names a window
SHARD = 2000              # passages of a shard, about
CROWDED = 2000            # passages of one gram that one shard may hold
MOST_BITS = 27            # of the bitmap of grams: at most 16 MB, whatever the corpus
NO_ID = np.iinfo(np.int64).max

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_LETTERS = np.random.default_rng(13).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
SEGMENT = 1 << 20         # bytes hashed at once; a longer word is hashed whole


def word_hashes(texts: list) -> tuple:
    """(64-bit hashes of the words of all texts, end to end; where each text ends among them)."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    size = np.cumsum([len(t) + 1 for t in texts])
    found, starts, at = [], [], 0
    while at < len(data):
        to = min(len(data), at + SEGMENT)
        while to < len(data) and not (spaces := np.flatnonzero(_SPACE[data[at:to]])).size:
            to = min(len(data), to + SEGMENT)
        if to < len(data):
            to = at + int(spaces[-1]) + 1                        # a segment ends after a space
        part = data[at:to]
        edge = np.flatnonzero(np.diff(_SPACE[part], prepend=True, append=True))
        first, end = edge[::2], edge[1::2]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_LETTERS[part] * _powers(_INVERSE, len(part)), out=total[1:])
        found.append(mix((total[end] - total[first]) * _powers(_BASE, len(part) + 1)[first] + (end - first).astype(np.uint64)))
        starts.append(first + at)
        at = to
    if not found:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    return np.concatenate(found), np.searchsorted(np.concatenate(starts), size)


class Words:
    """The word hashes of texts laid end to end, and their passages."""

    def __init__(self, texts: list):
        self.hashes, self.ends = word_hashes(texts)
        self.sums: tuple | None = None

    def strings(self, first: np.ndarray, size) -> np.ndarray:
        """Hashes of the strings of ``size`` words that start at ``first``."""
        if self.sums is None:
            n = len(self.hashes)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(self.hashes * _powers(_INVERSE, n), out=total[1:])
            self.sums = total, _powers(_BASE, n + 1)
        total, up = self.sums
        return mix((total[first + size] - total[first]) * up[first])

    def passages(self, window: int, gram: int, keep=None, named: bool = True):
        """(text, start in the text, windows, gram hash, passage hash) of every passage whose
        gram ``keep`` does not exclude; without ``named`` the last is left out."""
        none = np.empty(0, np.int64)
        n = len(self.hashes) - window + 1
        if n <= 0:
            return none, none, none, none, none
        start = np.arange(n)
        text = np.searchsorted(self.ends, start, side="right")
        inside = np.flatnonzero(start + window <= self.ends[text])
        if not len(inside):
            return none, none, none, none, none
        grams = window_hashes(self.hashes, gram)
        least, at, span, width = grams, np.arange(len(grams)), window - gram + 1, 1
        while width < span:
            step = min(width, span - width)
            later = least[step:] < least[:-step]                  # the first of equals stays
            at = np.where(later, at[step:], at[:-step])
            least = np.where(later, least[step:], least[:-step])
            width += step
        at = at[inside]
        new = np.ones(len(inside), bool)
        new[1:] = (at[1:] != at[:-1]) | (text[inside[1:]] != text[inside[:-1]])
        cuts = np.flatnonzero(new)
        first, count = inside[cuts], np.diff(np.append(cuts, len(inside)))
        anchor = at[cuts]
        if keep is not None:
            stay = keep(grams[anchor])
            first, count, anchor = first[stay], count[stay], anchor[stay]
        name = mix(self.strings(first, count + window - 1) + (anchor - first).astype(np.uint64) * np.uint64(1_000_003)
                   + count.astype(np.uint64)) if named else none
        text = text[first]
        begin = np.concatenate([[0], self.ends[:-1]])[text]
        return text, first - begin, count, grams[anchor], name


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _scan(docs: DataFrame, schema: str, window: int, gram: int, columns, keep=None) -> DataFrame:
    """``columns(batch rows, passages)`` of every passage of ``docs`` (doc_key, doc_hash,
    text_bytes) that the bitmap ``keep`` does not exclude; without one passages have no names."""
    names = [x.split()[0] for x in schema.split(", ")]

    def scan(batches):
        for batch in slices(batches, 250):
            found = Words(batch.column(2).to_pylist()).passages(window, gram, keep, keep is not None)
            for at in range(0, len(found[0]), 100_000):
                cut = tuple(x[at:at + 100_000] for x in found)
                yield pa.RecordBatch.from_arrays(columns(batch, *cut), names=names)

    return docs.mapInArrow(scan, schema)


def _gram_bitmap(grams: DataFrame):
    """A function of gram hashes: false for those surely not among ``grams`` (g, long).  Eight
    to sixteen bits a gram, up to ``MOST_BITS``; two are set for each."""
    spark = grams.sparkSession
    size = max(1, grams.count())
    bits = min(MOST_BITS, max(20, math.ceil(math.log2(8 * size))))
    mask = np.uint64((1 << bits) - 1)

    def both(g):
        return (g & mask).astype(np.int64), ((g >> np.uint64(64 - bits)) & mask).astype(np.int64)

    def scan(batches):
        table = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            for place in both(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)):
                np.bitwise_or.at(table, place >> 3, (1 << (place & 7)).astype(np.uint8))
        found = list(blocks_of(table))
        yield pa.RecordBatch.from_pydict({
            "tab": pa.array([x[0] for x in found], pa.int32()), "block": pa.array([x[1] for x in found], pa.int32()),
            "counts": pa.array([x[2] for x in found], pa.binary())})

    summed = sum_blocks(grams.select("g").mapInArrow(scan, BLOCK_SCHEMA), "uint8", 8, np.bitwise_or)
    shared = spark.sparkContext.broadcast(gather_blocks(summed, 1, 1 << (bits - 3), "uint8")[0])

    def keep(g: np.ndarray) -> np.ndarray:
        one, two = both(g)
        table = shared.value
        return ((table[one >> 3] >> (one & 7).astype(np.uint8)) & (table[two >> 3] >> (two & 7).astype(np.uint8)) & 1).astype(bool)

    return keep


# ------------------------------------------------------------- the automaton

class SuffixAutomaton:
    """All substrings of some word strings; each state knows the least id of a
    string in which its substrings occur (after ``settle``)."""

    def __init__(self):
        self.next: list = [{}]
        self.link, self.length, self.least = [-1], [0], [NO_ID]

    def _state(self, length: int, link: int, moves: dict) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.least.append(NO_ID)
        return len(self.link) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The state of the strings that end in p's longest and ``word``, cut off from q."""
        move, link = self.next, self.link
        copy = self._state(self.length[p] + 1, link[q], dict(move[q]))
        link[q] = copy
        while p != -1 and move[p].get(word) == q:
            move[p][word] = copy
            p = link[p]
        return copy

    def add(self, words: list, doc: int) -> None:
        move, link, length, least = self.next, self.link, self.length, self.least
        last = 0
        for word in words:
            q = move[last].get(word)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, word, q)
            else:
                now = self._state(length[last] + 1, 0, {})
                p = last
                while p != -1 and word not in move[p]:
                    move[p][word] = now
                    p = link[p]
                if p != -1:
                    q = move[p][word]
                    link[now] = q if length[q] == length[p] + 1 else self._split(p, word, q)
                last = now
            if doc < least[last]:
                least[last] = doc

    def settle(self) -> None:
        """Hand the least ids down the suffix links, longest strings first."""
        link, least = self.link, self.least
        for v in np.argsort(-np.array(self.length), kind="stable").tolist():
            up = link[v]
            if up > 0 and least[v] < least[up]:
                least[up] = least[v]

    def windows(self, words: list, size: int) -> list:
        """For every run of ``size`` words the least id that holds it (``NO_ID``: none), from
        the longest match at each word, cut to ``size``."""
        move, link, length, least = self.next, self.link, self.length, self.least
        out, v, matched = [], 0, 0
        for at, word in enumerate(words):
            while v and word not in move[v]:
                v = link[v]
                matched = length[v]
            q = move[v].get(word)
            if q is not None:
                v, matched = q, matched + 1
                while length[link[v]] >= size:
                    v = link[v]
                    matched = length[v]
            if at >= size - 1:
                out.append(least[v] if matched >= size else NO_ID)
        return out


def _stream(passages: DataFrame, shards: int, window: int, most: int) -> DataFrame:
    """(g, c, w0, w1, ...): the least id of each window of the passages (g, c, words, least)."""
    kind = "g long, c long, " + ", ".join(f"w{i} long" for i in range(most))

    def build(table: pa.Table) -> pa.Table:
        automaton = SuffixAutomaton()
        words = [np.frombuffer(x, np.int64).tolist() for x in table["words"].to_pylist()]
        for w, doc in zip(words, table["least"].to_pylist(), strict=True):
            automaton.add(w, doc)
        automaton.settle()
        found = [automaton.windows(w, window) for w in words]
        return pa.table([table["g"], table["c"], *[pa.array([x[i] if i < len(x) else None for x in found], pa.int64()) for i in range(most)]],
                        names=["g", "c", *[f"w{i}" for i in range(most)]])

    dealt = passages.withColumn("shard", F.pmod(F.xxhash64("g"), F.lit(shards)))
    return dealt.select("g", "c", "words", "least", "shard").groupBy("shard").applyInArrow(build, kind)


def _words_of(docs: DataFrame, chosen: DataFrame, window: int, each: bool) -> DataFrame:
    """(g, c, w, key, least, words) of the passages ``chosen`` (g, c, least, n, rep: where one is); with
    ``each``, of each of their windows: w is its place, key its hash."""
    per_doc = chosen.groupBy(F.col("rep.doc_key").alias("doc_key"), F.col("rep.doc_hash").alias("doc_hash")).agg(
        F.collect_list(F.struct(F.col("rep.start").alias("start"), "n", "g", "c", "least")).alias("taken"))      # within one document
    schema = "g long, c long, w int, key long, least long, words binary"

    def scan(batches):
        for batch in slices(batches, 250):
            texts = Words(batch.column(0).to_pylist())
            begin = np.concatenate([[0], texts.ends[:-1]]) if len(texts.ends) else texts.ends
            lists = batch.column(1)
            rows = lists.flatten()
            if not len(rows):
                continue
            start, n, g, c, least = (rows.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5))
            start = start + np.repeat(begin, lists.value_lengths().to_numpy(zero_copy_only=False))
            if each:
                which = np.repeat(np.arange(len(n)), n)
                w = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                start, g, c, least, size = start[which] + w, g[which], c[which], least[which], np.full(len(which), window)
                key = texts.strings(start, size)
            else:
                w, key, size = np.zeros(len(n), np.int64), g, n + window - 1
            raw = texts.hashes.tobytes()
            for at in range(0, len(start), 20_000):
                cut = slice(at, at + 20_000)
                words = [raw[8 * s:8 * e] for s, e in zip(start[cut].tolist(), (start + size)[cut].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g[cut]), pa.array(c[cut]), pa.array(w[cut], pa.int32()), _signed(key[cut]), pa.array(least[cut]), pa.array(words, pa.binary())],
                    names=["g", "c", "w", "key", "least", "words"])

    rows = flagged(docs, per_doc, "doc_hash").where("hit").alias("d").join(
        per_doc.alias("p"), F.expr("d.doc_key = p.doc_key and d.doc_hash = p.doc_hash")).select("d.doc_key", "d.doc_hash", "d.text_bytes", "p.taken")
    return rows.dropDuplicates(["doc_key", "doc_hash"]).select("text_bytes", "taken").mapInArrow(scan, schema)


def first_holders(docs: DataFrame, occurrences: DataFrame, window: int, gram: int) -> DataFrame:
    """(g, c, w0, w1, ...) of the passages of ``occurrences`` that lose a window in some document:
    the least id of a document that holds each window."""
    most = window - gram + 1
    classes = materialize(occurrences.groupBy("g", "c").agg(
        F.min("doc_key").alias("least"), F.max("doc_key").alias("most"), F.first("n").alias("n"),
        F.min(F.struct("doc_key", "doc_hash", "start")).alias("rep")))
    of_gram = classes.groupBy("g").agg(F.min("least").alias("g_least"), F.max("most").alias("g_most"), F.count(F.lit(1)).alias("kinds"))
    classes = materialize(classes.join(of_gram.where("g_least < g_most"), "g").select("g", "c", "least", "most", "n", "rep", "kinds"))
    few, many = classes.agg(F.count_if(F.col("kinds") <= CROWDED), F.count_if(F.col("kinds") > CROWDED)).first()
    names = [f"w{i}" for i in range(most)]
    parts = []
    if few:
        passages = _words_of(docs, classes.where(F.col("kinds") <= CROWDED), window, False)
        parts.append(_stream(passages, math.ceil(few / SHARD), window, most))
    if many:
        each = materialize(_words_of(docs, classes.where(F.col("kinds") > CROWDED), window, True))
        single = each.groupBy("key").agg(F.min("least").alias("least"), F.min("words").alias("words")).select(
            F.col("key").alias("g"), F.lit(0).cast("long").alias("c"), "words", "least")
        shards = math.ceil(many * most / SHARD)
        found = _stream(single, shards, window, 1).select(F.col("g").alias("key"), F.col("w0").alias("holder"))
        parts.append(each.join(found, "key").groupBy("g", "c").agg(
            *[F.min(F.when(F.col("w") == i, F.col("holder"))).alias(x) for i, x in enumerate(names)]))
    if not parts:
        return classes.select("g", "c", *[F.lit(None).cast("long").alias(x) for x in names]).limit(0)
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    losing = out.join(classes.select("g", "c", "most"), ["g", "c"])
    return materialize(losing.where(F.least(*names, F.lit(NO_ID)) < F.col("most")).drop("most"))


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_key, doc_hash, spans): of the documents that lose words; each span is
    ``start << 16 | bits`` of the windows that go among those from start on.
    ``docs``: doc_key, doc_hash, text_bytes."""
    most = window - gram + 1
    held = _scan(docs, "g long, doc_key long", window, gram, lambda batch, text, start, n, g, c: [_signed(g), batch.column(0).take(pa.array(text))])
    twice = held.groupBy("g").agg(F.min("doc_key").alias("a"), F.max("doc_key").alias("b")).where("a < b").select("g")
    keep = _gram_bitmap(materialize(twice))
    occurrences = materialize(_scan(
        docs, "doc_key long, doc_hash long, start int, n int, g long, c long", window, gram,
        lambda batch, text, start, n, g, c: [batch.column(0).take(pa.array(text)), batch.column(1).take(pa.array(text)),
                                             pa.array(start, pa.int32()), pa.array(n, pa.int32()), _signed(g), _signed(c)], keep))
    found = first_holders(docs, occurrences, window, gram)
    bits = sum((F.when(F.col(f"w{i}") < F.col("doc_key"), F.lit(1 << i)).otherwise(F.lit(0)) for i in range(most)), F.lit(0))
    losing = occurrences.join(found, ["g", "c"]).withColumn("bits", bits).where("bits > 0")
    return losing.groupBy("doc_key", "doc_hash").agg(
        F.collect_set(F.shiftleft(F.col("start").cast("long"), 16).bitwiseOR(F.col("bits").cast("long"))).alias("spans"))   # within one document


def covered(n: int, spans: list, window: int) -> np.ndarray:
    """Which of n words lie in a window that goes."""
    change = np.zeros(n + window + 1, np.int64)
    packed = np.array(spans, np.int64)
    start, bits = packed >> 16, packed & 0xFFFF
    for i in range(16):
        at = start[(bits >> i) & 1 == 1] + i
        np.add.at(change, at, 1)
        np.add.at(change, at + window, -1)
    return np.cumsum(change[:n]) > 0


def removal(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256 and,
    if asked, ``kept``: the words left, joined by one space."""
    if not 0 < gram <= window or window - gram >= 16:
        raise ValueError("a gram is part of its window, and a passage holds at most 16 windows")
    docs = with_bytes(docs).select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_key"),
                                   F.xxhash64("text_bytes").alias("doc_hash"), "text_bytes")
    keyed = docs.select("doc_key", "doc_hash", "text_bytes")
    spans = materialize(repeated_windows(keyed, window, gram))
    split = flagged(docs, spans, "doc_hash")
    hit = split.where("hit").alias("d").join(spans.alias("p"), F.expr("d.doc_key = p.doc_key and d.doc_hash = p.doc_hash"), "left")
    rows = hit.select("d.doc_id", "d.text_bytes", "p.spans").unionByName(
        split.where("not hit").select("doc_id", "text_bytes", F.lit(None).cast("array<long>").alias("spans")))

    def scan(batches):
        for batch in slices(batches, 250):
            size, gone, digest, left = [], [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.split()
                kept = words
                if found:
                    out = covered(len(words), found, window).tolist()
                    kept = [w for w, x in zip(words, out, strict=True) if not x]
                size.append(len(words))
                gone.append(len(words) - len(kept))
                joined = b" ".join(kept)
                digest.append(hashlib.sha256(joined).hexdigest())
                left.append(joined.decode("utf-8") if keep_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())]
                + [pa.array(left, pa.string())] * keep_text, names=names)

    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * keep_text
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text)


def op11_automaton_dedup(spark, sf_dir: str) -> DataFrame:
    return removal(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = r"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
x as (select r, doc_id, w, unnest(range(1, len(w) - 11)) as i from d),
y as (select r, doc_id, i, array_to_string(w[i:i + 12], ' ') as k from x),
m as (select k, min(doc_id) as least from y group by k),
h as (select distinct y.r, unnest(range(y.i, y.i + 13)) as i from y join m on m.k = y.k
  where m.least < y.doc_id or (y.doc_id is null and m.least is not null)),
n as (select r, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from d),
kept as (select n.r, string_agg(n.word, ' ' order by n.i) as txt, count(*) as c
  from n left join h on h.r = n.r and h.i = n.i where h.r is null group by n.r)
select d.doc_id, len(w)::bigint as n_words, len(w) - coalesce(k.c, 0) as n_removed, sha256(coalesce(k.txt, '')) as kept_sha256
from d left join kept k on k.r = d.r
"""
