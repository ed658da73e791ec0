import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from terrapanel.llm import automaton_dedup as dedup


def brute(rows, window=13):
    """Every window of every text, with the least id that holds it (a null last)."""
    last = lambda i: (i is None, i or 0)
    least: dict = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for s in range(len(w) - window + 1):
            key = tuple(w[s:s + window])
            least[key] = min(least.get(key, (True, 1)), last(i))
    out = []
    for i, w in split:
        gone = set()
        for s in range(len(w) - window + 1):
            if least[tuple(w[s:s + window])] < last(i):
                gone.update(range(s, s + window))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return Counter(out)


def result(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())


def test_automaton_finds_the_least_id_of_every_window():
    rng = random.Random(1)
    for size in (1, 2, 3, 5):
        strings = [[rng.randrange(3) for _ in range(rng.randint(0, 14))] for _ in range(60)]
        automaton = dedup.SuffixAutomaton()
        for doc, s in enumerate(strings):
            automaton.add(s, doc + 7)
        automaton.settle()
        for s in [*strings, [0, 9, 0, 1, 2, 0, 0, 1, 9, 2]]:
            want = []
            for at in range(len(s) - size + 1):
                part = s[at:at + size]
                held = [d + 7 for d, t in enumerate(strings) if any(t[i:i + size] == part for i in range(len(t) - size + 1))]
                want.append(min(held, default=dedup.NO_ID))
            assert automaton.windows(s, size) == want


def test_word_hashes_are_those_of_split_words(monkeypatch, texts):
    rng = random.Random(6)
    raw = [(t or "").encode() for t in texts] + [b"\x1c a\x1db \x85\xa0 \x00", b"\x0b\x0c", b"x" * 500]
    raw += ["".join(rng.choice("ab \t\n\r\x0b\x0cé") for _ in range(rng.randint(0, 40))).encode() for _ in range(50)]
    split = [t.split() for t in raw]
    for segment in (1 << 20, 64):
        monkeypatch.setattr(dedup, "SEGMENT", segment)
        found, ends = dedup.word_hashes(raw)
        assert ends.tolist() == np.cumsum([len(w) for w in split]).tolist()
        of = dict(zip([x for w in split for x in w], found.tolist(), strict=True))
        assert [of[x] for w in split for x in w] == found.tolist() and len(set(of.values())) == len(of)
    assert dedup.word_hashes([])[0].size == 0 and dedup.word_hashes([b"", b" "])[1].tolist() == [0, 0]


def test_passages_hold_every_window_once():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdef") for _ in range(n)).encode() for n in (0, 5, 12, 13, 14, 60, 300, 0, 40)]
    words = dedup.Words(texts)
    text, start, count, _, _ = words.passages(13, 5)
    held = Counter((t, s + i) for t, s, n in zip(text.tolist(), start.tolist(), count.tolist(), strict=True) for i in range(n))
    assert held == Counter((t, s) for t, x in enumerate(texts) for s in range(len(x.split()) - 12))
    assert count.max() <= 9


def test_equal_windows_have_equal_grams():
    rng = np.random.default_rng(2)
    shared = [f"w{i}" for i in rng.integers(0, 50, 30)]
    texts = [" ".join([f"a{i}" for i in rng.integers(0, 50, k)] + shared + [f"b{i}" for i in rng.integers(0, 50, k)]).encode() for k in (0, 7, 30)]
    grams: dict = {}
    for x in texts:
        words = dedup.Words([x])
        _, start, count, gram, _ = words.passages(13, 5)
        split = x.split()
        for s, n, g in zip(start.tolist(), count.tolist(), gram.tolist(), strict=True):
            for i in range(s, s + n):
                grams.setdefault(tuple(split[i:i + 13]), set()).add(g)
    assert all(len(g) == 1 for g in grams.values())


def test_equals_brute_force(docs):
    """Null, empty and long texts, repeated rows and ids, null ids, clashing columns."""
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows)
    assert sum(n * k[2] for k, n in want.items()) > 1000
    assert result(dedup.removal(docs)) == want
    kept = dedup.removal(docs, keep_text=True).collect()
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in kept)


def texts_of_few_words(n=60):
    rng = random.Random(8)
    return [(i if i % 9 else None, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))) for i in range(n)]


def test_short_windows(spark):
    rows = texts_of_few_words()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for window, gram in ((5, 2), (4, 4), (1, 1)):
        assert result(dedup.removal(df, window, gram)) == brute(rows, window)
    with pytest.raises(ValueError):
        dedup.removal(df, 5, 6)


def test_crowded_grams_are_cut_into_windows(spark, docs, monkeypatch):
    monkeypatch.setattr(dedup, "CROWDED", 1)
    rows = texts_of_few_words()
    assert result(dedup.removal(spark.createDataFrame(rows, "doc_id long, text string"), 5, 2)) == brute(rows, 5)
    assert result(dedup.removal(docs)) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_a_passage_in_a_third_of_the_texts(spark):
    """One passage with another word after it in each text: one gram, very many passages."""
    rng = random.Random(4)
    shared = [f"s{i}" for i in range(16)]
    rows = []
    for i in range(300):
        own = [f"x{rng.randrange(10 ** 6)}" for _ in range(40)]
        rows.append((i, " ".join(own[:20] + shared * (i % 3 == 0) + own[20:])))
    got = result(dedup.removal(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    assert got == brute(rows)
    assert sum(k[2] for k in got) == 99 * 16


def test_no_rows(no_docs, spark):
    assert dedup.removal(no_docs).count() == 0
    assert result(dedup.removal(spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string"))) == brute([(1, None), (2, "a b")])
