"""Language ID with hyperdimensional profiles.

Every letter (and the gap between words) has a random vector of ``DIMENSIONS``
plus and minus ones, drawn from its code point.  A trigram is bound by
multiplying its letters' vectors, each permuted (rotated) by its place; a text
is the sum (bundle) of its trigrams' vectors, a language's prototype the sum of
its training texts'.  A text gets the language whose prototype has the
greatest cosine with it, after the mean direction that all prototypes share is
taken out of both; the score is that cosine, 0 at least.

Bundles are sums of whole numbers, so prototypes do not hang on how rows were
dealt.  Every task adds up its own prototypes; what comes to the driver is one
vector for each language (distinct ``lang`` values).

Nulls and odd rows: a text that is null or has no letter is ``und`` with score
0; so is every text if no row can be learned from.  Rows with a null lang or
without letters are not learned from.  Ties go to the language that sorts
first.  Repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.common import held_out, short_batches, slices

DIMENSIONS = 1024
BATCH_CHARS = 2_000_000      # text whose trigrams a task holds at once
BATCH_TEXTS = 1000


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)], bool)


@functools.lru_cache(100_000)
def letter_vector(code: int) -> np.ndarray:
    """Plus and minus ones of a code point (0: the gap)."""
    return (np.random.default_rng([17, code]).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1)


def trigram_counts(texts: list):
    """(text, trigram, count) arrays and the code points of each trigram, of lower-cased letters and gaps."""
    texts = [(t or "").lower() for t in texts]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    code = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    code = np.where(_letters()[code], code, 0)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] > 0) | (code[:-1] > 0)
    code, owner = code[keep], owner[keep]
    code, owner = np.concatenate([[0], code, [0]]), np.concatenate([[0], owner, [0]])
    alphabet = np.flatnonzero(np.bincount(code))
    place = np.zeros(alphabet[-1] + 1, np.int64)
    place[alphabet] = np.arange(len(alphabet))
    small, n = place[code], len(alphabet)
    middle = np.flatnonzero(code[1:-1] > 0) + 1
    gram = (small[middle - 1] * n + small[middle]) * n + small[middle + 1]
    key = np.sort(owner[middle] * n ** 3 + gram)                     # alphabets of up to some thousand letters
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    text, gram = np.divmod(key[first], n ** 3)
    grams, gram = np.unique(gram, return_inverse=True)
    points = np.stack([alphabet[grams // (n * n)], alphabet[grams // n % n], alphabet[grams % n]], 1)
    return text, gram, count, points


def trigram_vectors(points: np.ndarray) -> np.ndarray:
    """Bound vectors: the first letter's rotated by two places, the second's by one, the third's as it is."""
    if not len(points):
        return np.zeros((0, DIMENSIONS), np.float32)
    used, at = np.unique(points, return_inverse=True)
    base = np.stack([letter_vector(int(c)) for c in used])
    at = at.reshape(points.shape)
    return (np.roll(base, 2, 1)[at[:, 0]] * np.roll(base, 1, 1)[at[:, 1]] * base[at[:, 2]]).astype(np.float32)


def bundles(texts: list) -> np.ndarray:
    """One vector per text; no row's sums reach the 2**24 that float32 keeps whole, for texts of under 16 million letters."""
    text, gram, count, points = trigram_counts(texts)
    table = np.zeros((len(texts), len(points)), np.float32)
    table[text, gram] = count
    return table @ trigram_vectors(points)


def _cuts(texts: list):
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and to - at < BATCH_TEXTS and (to == at or size + len(texts[to] or "") <= BATCH_CHARS):
            size += len(texts[to] or "")
            to += 1
        yield slice(at, to)
        at = to


def prototypes(docs: DataFrame) -> tuple:
    """(languages in order, one bundle each) learned from all rows of ``docs`` (text, lang)."""

    def scan(batches):
        total: dict = {}
        for batch in slices(batches):
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for cut in _cuts(texts):
                text, gram, count, points = trigram_counts(texts[cut])
                names, number = np.unique(np.array(langs[cut], object).astype(str), return_inverse=True)
                table = np.bincount(number[text] * len(points) + gram, weights=count, minlength=len(names) * len(points))
                sums = np.rint(table.reshape(len(names), -1) @ trigram_vectors(points).astype(np.float64)).astype(np.int64)
                for name, vector in zip(names.tolist(), sums, strict=True):
                    total[name] = total.get(name, 0) + vector
        yield from _rows(total)

    def add(batches):
        total: dict = {}
        for batch in slices(batches):
            for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[lang] = total.get(lang, 0) + np.frombuffer(raw, np.int64)
        yield from _rows(total)

    def _rows(total):
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tobytes() for v in total.values()], pa.binary())],
                                         names=["lang", "vector"])

    schema = "lang string, vector binary"
    rows = docs.select("text", "lang").mapInArrow(scan, schema).repartition(8, "lang").mapInArrow(add, schema).collect()
    found = sorted((r["lang"], np.frombuffer(bytes(r["vector"]), np.int64)) for r in rows)
    found = [(lang, v) for lang, v in found if v.any()]
    return [lang for lang, _ in found], np.array([v for _, v in found], np.float64).reshape(len(found), DIMENSIONS)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (doc_id, text, lang)."""
    short_batches(docs.sparkSession)
    docs = docs.withColumn("held_out", held_out("doc_id", 3, 1))
    names, sums = prototypes(docs.where("not held_out and lang is not null and text is not null"))
    units = _unit(sums)
    mean = units.mean(0, keepdims=True) if len(names) else np.zeros((1, DIMENSIONS))
    shared_part = _unit(mean) if len(names) > 1 else np.zeros((1, DIMENSIONS))

    def apart(x):
        return _unit(x - (x @ shared_part.T) @ shared_part)

    profile = apart(units) if len(names) else units

    def scan(batches):
        for batch in slices(batches):
            texts = batch.column(2).to_pylist()
            best, score = [], []
            for cut in _cuts(texts):
                vectors = bundles(texts[cut])
                seen = vectors.any(1) & bool(names)
                near = apart(_unit(vectors.astype(np.float64))) @ profile.T if names else np.zeros((len(vectors), 1))
                best += [names[k] if s else "und" for k, s in zip(near.argmax(1), seen, strict=True)]
                score += np.where(seen, np.clip(near.max(1), 0, 1), 0.0).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best, pa.string()), pa.array(score, pa.float64())],
                                             names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(scan, "doc_id long, held_out boolean, lang_pred string, score double")


def op4_hyperdimensional_language(spark, sf_dir: str) -> DataFrame:
    return predict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
