import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terrapanel.llm.square_catching import SquareCatcher, collapsed, find_runs, greatest, repeat_tail, runs_of_texts, runs_of_words


def brute(w, least=6, exponent=4):
    """Every stretch of every period, those held by a stretch of a smaller period left out."""
    found = []
    for q in range(1, len(w) // exponent + 1):
        s = 0
        while s + q < len(w):
            e = s + q
            while e < len(w) and w[e] == w[e - q]:
                e += 1
            if e - s >= exponent * q:
                found.append((s, e, q))
            s = max(s + 1, e - q + 1)
    return sorted((s, e - s, q) for s, e, q in found
                  if e - s >= least and not any(r < q and a <= s and b >= e for a, b, r in found))


def numbered(w):
    return np.array([hash(x) & (1 << 63) - 1 for x in w], np.uint64)


def samples():
    rng = random.Random(3)
    out = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 300, list("ab") * 70, list("aab") * 40 + list("ab") * 40, list("aaaaaab") * 20,
           list("ab") * 4 + list("b") * 9 + list("ab") * 4]
    for n in (20, 60, 150, 400):
        for letters in ("ab", "abc"):
            out.append([rng.choice(letters) for _ in range(n)])
    for _ in range(40):
        w = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(1, 3)):
            u = [rng.choice("abcd") for _ in range(rng.randint(1, 30))]
            w += (u * 9)[:rng.randint(1, 9 * len(u))] + [rng.choice("abcdefgh") for _ in range(rng.randint(0, 5))]
        out.append(w)
    fib = ["a", "ab"]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    return [*out, list(fib[-1])]


def test_against_every_stretch():
    for w in samples():
        assert runs_of_words(numbered(w)) == brute(w), w
        assert runs_of_words(numbered(w), exponent=3) == brute(w, exponent=3), w


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=80), st.integers(1, 90))
def test_the_cut_into_strides_does_not_matter(w, stride):
    assert runs_of_words(numbered(w), stride, 1) == brute(w, 1)


def test_word_by_word_reports_what_holds_so_far():
    for w in samples()[:20]:
        catcher = SquareCatcher()
        for i, x in enumerate(numbered(w)):
            catcher.append(np.array([x], np.uint64))
            if i % 17 == 0:
                assert [(s, e - s, q) for s, e, q in catcher.runs()] == brute(w[:i + 1], 1)
        assert [(s, e - s, q) for s, e, q in catcher.runs()] == brute(w, 1)


def test_texts_in_one_stream_do_not_touch():
    texts = [["a"] * 5, ["a"] * 5, ["a"] * 7, list("ab") * 3, list("ab") * 3, list("ab") * 30]
    assert runs_of_texts([numbered(w) for w in texts]) == [brute(w) for w in texts]
    assert runs_of_texts([]) == []


def test_long_texts():
    assert runs_of_words(np.full(300_000, 7, np.uint64)) == [(0, 300_000, 1)]
    rng = np.random.default_rng(4)
    period = rng.integers(0, 1 << 60, 40_000).astype(np.uint64)
    w = np.concatenate([rng.integers(0, 1 << 60, 5_000).astype(np.uint64), np.tile(period, 5)[:190_001], np.zeros(70_000, np.uint64)])
    assert runs_of_words(w) == [(5_000, 190_001, 40_000), (195_001, 70_000, 1)]


def test_small_rules():
    assert greatest([]) is None
    assert greatest([(0, 9, 2), (3, 9, 2), (5, 45, 10)]) == (0, 9, 2)
    assert greatest([(0, 8, 2), (3, 9, 2)]) == (3, 9, 2)
    assert collapsed(10, [(1, 8, 2)]).tolist() == [True] * 3 + [False] * 6 + [True]
    with pytest.raises(ValueError):
        SquareCatcher(2)
    ten = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    assert repeat_tail(0, ten) is None and len(repeat_tail(50, ten)) == 50


def expected(doc_id, text, change):
    w = (text or "").encode().split()
    order = change(len(w), doc_id) if change else None
    if order is not None:
        w = [w[i] for i in order.tolist()]
    runs = brute(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


@pytest.mark.parametrize("change", [None, repeat_tail])
def test_rows(docs, change):
    """Null, empty and long texts, repeated rows and ids, null ids, clashing columns."""
    want = sorted((expected(r.doc_id, r.text, change) for r in docs.select("doc_id", "text").collect() if len((r.text or "").split()) < 2000), key=str)
    got = find_runs(docs, change)
    long = {r.doc_id for r in docs.select("doc_id", "text").collect() if len((r.text or "").split()) >= 2000}
    assert got.count() == docs.count()
    assert sorted((tuple(r) for r in got.collect() if r.doc_id not in long), key=str) == want


def test_no_rows(no_docs):
    assert find_runs(no_docs).count() == 0
