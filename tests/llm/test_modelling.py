"""LM scoring, packing, quality classifier, language ID, quality rules."""
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from terrapanel.llm import boosted_quality, context_mixing, harmonic_packing, hyperdimensional_language, risk_rules
from tests_paths import SF


def crc(i):
    return zlib.crc32(b"" if i is None else str(i).encode())


# ------------------------------------------------------------ LM scoring

def test_base_scores_equal_a_plain_count(docs):
    rows = docs.select("doc_id", "text").collect()
    got = context_mixing.score_texts(docs).collect()
    assert len(got) == len(rows)
    tokens = {(r.doc_id, r.text): [*(r.text or "").encode().lower().split(), None] for r in rows}
    train = Counter(t for r in rows if crc(r.doc_id) % 10 for t in tokens[r.doc_id, r.text])
    n, v = sum(train.values()), len(train)
    want = Counter()
    for r in rows:
        t = tokens[r.doc_id, r.text]
        want[r.doc_id, crc(r.doc_id) % 10 == 0, len(t), sum(x in train for x in t), n,
             round(sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t), 6)] += 1
    assert want == Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert all(r.score < 0 for r in got)


def test_scores_do_not_hang_on_partitions(docs):
    a = context_mixing.score_texts(docs).collect()
    b = context_mixing.score_texts(docs.repartition(1)).collect()

    def key(rows):
        return sorted((str(r.doc_id), r.n_bytes, round(r.score, 4)) for r in rows)

    assert key(a) == key(b)


def test_no_rows_and_no_training_rows(spark, no_docs):
    assert context_mixing.score_texts(no_docs).collect() == []
    held = [i for i in range(100) if crc(i) % 10 == 0][:3]
    got = context_mixing.score_texts(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score < 0 for r in got)


def test_code_and_decisions_give_a_distribution():
    counts = np.zeros((257, 257), np.int64)
    counts[256, [97, 98]], counts[97, [97, 98, 256]] = (900, 90), (9, 800, 70)
    code = context_mixing.prefix_code(counts)
    assert np.allclose((2.0 ** -code[0].reshape(257, 257)).sum(1), 1.0)
    # the chances of all texts of no or one byte and of the longer rest add up to one: sum over first symbols
    tables = [np.random.default_rng(1).integers(-30, 30, 1 << b).astype(np.int8) for b in context_mixing.SLOT_BITS]
    total = 0.0
    for s in range(257):
        text = [] if s == 256 else [bytes([s])]
        one = context_mixing.text_scores(text or [b""], code, tables)[0]
        if s != 256:                       # the text is s and the end: divide by the end's chance after s
            c = context_mixing.Contexts([bytes([s])])
            n, bit, slots = c.decisions(code, np.array([1]))
            odds = [t[x] for t, x in zip(tables, slots, strict=True)]
            gate = context_mixing._LEVEL[np.abs(odds[-1])] * 3 + context_mixing._LEVEL[np.abs(odds[-2])]
            z = sum(context_mixing._START[gate, i] * odds[i] for i in range(3)) / context_mixing.SCALE
            p = 1 / (1 + np.exp(-np.clip(z * (bit * 2.0 - 1), -12, 12)))
            one -= np.log2(p).sum()
        total += 2.0 ** one
    assert abs(total - 1) < 1e-3


def test_tables_grow_with_the_training_text(docs, monkeypatch):
    assert all(b >= 40 for b in context_mixing.slot_bits(1 << 40))
    monkeypatch.setattr(context_mixing, "SLOT_BITS", (8, 8, 8))
    rows = docs.select("doc_id", "text").collect()
    texts = [(r.text or "").encode().lower() for r in rows]
    train = [t for r, t in zip(rows, texts, strict=True) if crc(r.doc_id) % 10]
    _, symbol, before, _ = context_mixing.symbols(train)
    counts = np.bincount(before.astype(int) * 257 + symbol, minlength=257 * 257).reshape(257, 257)
    code, bits = context_mixing.prefix_code(counts), context_mixing.slot_bits(int(counts.sum()))
    assert min(bits) > 14
    c = context_mixing.Contexts(train)
    _, bit, slots = c.decisions(code, np.arange(len(c.symbol)), bits)
    tables = []
    for b, s in zip(bits, slots, strict=True):
        n = np.bincount(s * 2 + bit, minlength=2 << b)
        tables.append(np.clip(np.rint(np.log((n[1::2] + 0.4) / (n[::2] + 0.4)) * context_mixing.SCALE), -127, 127).astype(np.int8))
    want = Counter((r.doc_id, round(x * math.log10(2), 4)) for r, x in zip(rows, context_mixing.text_scores(texts, code, tables), strict=True))
    assert want == Counter((r.doc_id, round(r.score, 4)) for r in context_mixing.score_texts(docs).collect())


def test_texts_and_lists_are_not_written_as_a_table(docs, monkeypatch):
    written = []
    whole = context_mixing.materialize
    monkeypatch.setattr(context_mixing, "materialize", lambda df: written.append(set(df.columns)) or whole(df))
    monkeypatch.setattr(context_mixing, "PART_BYTES", 1 << 12)     # several pieces of texts a chunk
    monkeypatch.setattr(context_mixing, "CHUNK_BYTES", 1 << 14)
    got = context_mixing.score_texts(docs).select("doc_id", "n_bytes").collect()
    assert Counter(map(tuple, got)) == Counter((r.doc_id, len((r.text or "").encode())) for r in docs.select("doc_id", "text").collect())
    assert written and not any(c & {"texts", "slots", "counts"} for c in written)


def test_slots_of_a_chunk_keep_their_odds():
    rng = np.random.default_rng(2)
    slots = np.unique(rng.integers(0, 1 << 45, 50_000))
    odds = rng.integers(-127, 128, len(slots)).astype(np.int8)
    some = rng.integers(0, len(slots), 100_000)
    assert np.array_equal(context_mixing.Slots(slots, odds, 45)[slots[some]], odds[some])
    for n, bits in ((0, 20), (1, 33), (10, 26), (300, 9), (50_000, 30)):
        slots = np.unique(rng.integers(0, 1 << bits, n))
        odds = rng.integers(-127, 128, len(slots)).astype(np.int8)
        cuts = np.searchsorted(slots, np.arange(65) << (bits - 6))
        pieces = [(slots[a:b], odds[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        assert np.array_equal(context_mixing.Slots.of_pieces(pieces, len(slots), bits)[slots[::-1]], odds[::-1])


def test_paths_are_the_slots_odds_whatever_the_cache_holds(monkeypatch):
    counts = np.random.default_rng(3).integers(0, 50, (257, 257))
    code = context_mixing.prefix_code(counts)
    table = np.random.default_rng(4).integers(-127, 128, 1 << 16).astype(np.int8)
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 40, 3000).astype(np.uint64) << np.uint64(40) | rng.integers(0, 257 * 257, 3000).astype(np.uint64)
    for cache, room in ((16, 1 << 20), (4, 1 << 20), (6, 100), (12, 20_000)):
        monkeypatch.setattr(context_mixing, "CACHE_BITS", cache)
        monkeypatch.setattr(context_mixing, "PATH_ODDS", room)
        paths = context_mixing.Paths(table, code)
        for some in (keys[:700], keys[:700], keys[500:], keys):
            first = paths.starts(some)
            for key, at in zip(some.tolist(), first.tolist(), strict=True):
                n, where = context_mixing._decisions(code, np.array([key & 0x1FFFF]))
                slots = context_mixing._slots(np.repeat(np.uint64(key & ~0x1FFFF), n), code[2][where], 16)
                want = table[slots].astype(int) * np.where(code[3][where] == 1, 1, -1)
                assert paths.odds[at:at + n[0]].tolist() == want.tolist()


def test_sums_of_logarithms():
    rng = np.random.default_rng(6)
    sizes = np.array([1, 31, 32, 33, 1, 700, 64, 2])
    for odds in (np.exp(rng.uniform(-12, 12, sizes.sum())), np.full(sizes.sum(), np.exp(12)), np.full(sizes.sum(), np.exp(-12))):
        odds = odds.astype(np.float32)
        want = [np.log1p(x.astype(float)).sum() for x in np.split(odds, np.cumsum(sizes)[:-1])]
        assert np.allclose(context_mixing._logs(odds, sizes), want, rtol=1e-10, atol=0)


def test_mixing_beats_the_base_on_held_out_texts(spark):
    got = context_mixing.op1_context_mixing(spark, SF).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > got["sum(base_score)"]


# --------------------------------------------------------------- packing

def check_pieces(rows, pieces):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(harmonic_packing.tokenizer_path())
    t.encode_special_tokens = True
    ids = {(r.doc_id, r.text): np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in rows}
    want = Counter((d, len(x)) for (d, _), x in ids.items() for _ in range(sum(r.doc_id == d and r.text == _t for r in rows for _t in [_])))
    assert sum(p.length for p in pieces) == sum(len(ids[r.doc_id, r.text]) for r in rows)
    assert Counter((p.doc_id, p.doc_tokens) for p in pieces if p.start == 0) == want
    by_tokens = {}
    for (d, _), x in ids.items():
        by_tokens.setdefault((d, len(x)), []).append(x)
    for p in pieces:
        assert any(p.ids_crc32 == zlib.crc32(x[p.start:p.start + p.length].tobytes()) for x in by_tokens[p.doc_id, p.doc_tokens])
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
    waste = 0
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
        waste += 0 if at & (at - 1) == 0 else 2048 - at
    return waste / max(1, waste + sum(p.length for p in pieces))


def test_words_that_are_known_are_looked_up_once():
    class Counting(dict):
        asked = 0

        def get(self, word):
            self.asked += 1
            return super().get(word)

    encode = harmonic_packing.WordIds(harmonic_packing.tokenizer_path(), 50)
    texts = ["Some words are known some are NEW", "known words and Ünknown ones, Known KNOWN", "a\x1cb known", "", "İstanbul ΣΑΣ ǅ known"]
    for _ in range(2):
        encode.known = Counting(encode.known)
        got = encode(texts)
        assert encode.known.asked == sum(len(t.split()) for t in texts if "\x1c" not in t)
        assert [x.tolist() for x in got] == [[*encode.tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert "NEW" not in encode.known and "new" in encode.known
    encode.cache = 3                                      # emptied before each call that meets new words
    texts = [f"one {w} two ThreE" for w in ("x1", "y2", "z3")] + ["one two"]
    for i in range(3):
        got = encode(texts[i:] + texts[:i])
        assert [x.tolist() for x in got] == [[*encode.tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts[i:] + texts[:i]]


def test_pieces_rebuild_every_document(docs):
    rows, pieces = docs.select("doc_id", "text").collect(), harmonic_packing.pack(docs, harmonic_packing.tokenizer_path()).collect()
    assert check_pieces(rows, pieces) < 0.02


def test_pack_no_documents(no_docs):
    assert harmonic_packing.pack(no_docs, harmonic_packing.tokenizer_path()).collect() == []


def test_cut_lengths_cover():
    for n in [1, 5, 127, 128, 2047, 2048, 2049, 5000, 12345]:
        parts = harmonic_packing.cut_lengths(n)
        assert sum(parts) == n and all(p == 2048 or p < 128 or (p & (p - 1)) == 0 for p in parts)


# ---------------------------------------------------- quality classifier

def test_trees_walk_like_plain_trees():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] > 0)).astype(float)
    trees = boosted_quality.grow(x, y)
    assert ((trees.probability(x) > 0.5) == y).mean() > 0.95

    def plain(row):
        total = trees.start
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            total += leaf[node - len(f)]
        return 1 / (1 + math.exp(-total))

    assert np.allclose(trees.probability(x[:40]), [plain(r) for r in x[:40]])


def test_quality_learns_held_out_labels(spark):
    scored = boosted_quality.op3_boosted_quality(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = scored.where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_on_odd_rows(docs, labels, no_docs, no_labels):
    got = boosted_quality.score(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) for r in got)
    assert {r.score for r in boosted_quality.score(docs, no_labels).collect()} == {0.5}
    assert boosted_quality.score(no_docs, labels).collect() == []


def test_keep_good_drops_what_is_predicted_bad(docs, labels):
    key = docs.select("doc_id", "text").collect()
    scores = boosted_quality.score(docs, labels, carry=("text",)).collect()
    bad = {(r.doc_id, r.text) for r in scores if r.predicted == 0}
    kept = boosted_quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((r.doc_id, r.text) for r in key if (r.doc_id, r.text) not in bad)


# ----------------------------------------------------------- language ID

def test_language_held_out_accuracy(spark):
    rows = hyperdimensional_language.op4_hyperdimensional_language(spark, SF).join(
        spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_bundles_equal_a_plain_sum():
    texts = ["Ab, cd é", "aaa bbb", "", "12"]
    got = hyperdimensional_language.bundles(texts)
    v = hyperdimensional_language.letter_vector
    for text, vector in zip(texts, got, strict=True):
        codes = [0]
        for c in text.lower():
            code = ord(c) if c.isalpha() else 0
            if code or codes[-1]:
                codes.append(code)
        codes += [0] * (codes[-1] > 0)
        want = np.zeros(hyperdimensional_language.DIMENSIONS)
        for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
            if b:
                want += np.roll(v(a), 2) * np.roll(v(b), 1) * v(c)
        assert np.array_equal(vector, want)


def test_language_on_odd_rows(docs, no_docs):
    rows = docs.select("doc_id", "text").collect()
    got = hyperdimensional_language.predict(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    und = Counter(r.doc_id for r in rows if not any(c.isalpha() for c in r.text or ""))
    assert Counter(r.doc_id for r in got if r.lang_pred == "und") == und
    assert hyperdimensional_language.predict(no_docs).collect() == []


# --------------------------------------------------------- quality rules

def plain_counts(text):
    words = (text or "").encode().split()
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>") if words else 0,
            len(lines) - len(set(lines)), len(covered))


def test_rule_counts_equal_plain_counts(docs, labels):
    rows = docs.select("doc_id", "text").collect()
    got = risk_rules.apply_rules(docs, labels).collect()
    want = Counter()
    for r in rows:
        c = plain_counts(r.text)
        want[(r.doc_id, *c, c[0] < 50 or 100 * c[4] > 50 * c[0])] += 1
    assert want == Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    assert all(not (r.kept and r.base_failed) for r in got)


def test_rules_without_rows_or_labels(docs, no_docs, labels, no_labels):
    assert risk_rules.apply_rules(no_docs, labels).collect() == []
    assert all(r.kept != r.base_failed for r in risk_rules.apply_rules(docs, no_labels).collect())


@pytest.mark.parametrize("k,n,p", [(0, 10, 0.1), (3, 40, 0.05), (40, 40, 0.2), (7, 500, 0.02)])
def test_binomial_sum(k, n, p):
    want = sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))
    assert math.isclose(risk_rules.binomial_at_most(k, n, p), min(1, want), rel_tol=1e-9)


def test_chosen_cutoffs_hold_their_risk():
    good, bad = np.array([0, 1, 2, 30]), np.array([5, 9, 9, 50])
    assert risk_rules.choose(good, bad, 1000, 0.02, 0.01) == 1       # as many bad as the next, fewer good
    assert risk_rules.choose(good, bad, 20, 0.02, 0.01) is None      # too few labels to be sure
    assert risk_rules.choose(good, np.zeros(4, int), 1000, 0.02, 0.01) is None
    # over many draws a rule with a true rate above the risk is admitted at most as often as the level allows
    rng = np.random.default_rng(0)
    wrong = sum(risk_rules.choose(rng.binomial(800, [0.021]), np.array([1]), 800, 0.02, 0.05) is not None for _ in range(400))
    assert wrong <= 400 * 0.05 + 15


def test_rules_use_a_planted_signal(spark):
    rows = [(i, " ".join(["word%d" % (j * 7 + i) for j in range(60)]) + (" |" * 60 if i % 5 == 0 else ""), "en", "s", 0) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(6000)], "doc_id long, quality int, toxic int")
    got = risk_rules.apply_rules(docs, labels).collect()
    assert all(r.kept == (r.doc_id % 5 > 0) for r in got)


def test_small_strata_get_rules_and_others_are_reported(spark):
    rows, labels = [], []
    for lang, n in (("a", 420), ("b", 420), ("c", 420), ("d", 420), ("e", 60)):
        for i in range(n):
            rows.append((len(rows), " ".join("word%d" % (j * 7 + i) for j in range(60)) + (" |" * 60 if i % 5 == 0 else ""), lang))
            labels.append((len(labels), int(i % 5 > 0)))
    got = risk_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"),
                                 spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    bad = {i for i, quality in labels if not quality}
    assert all(r.kept == (r.doc_id not in bad) and r.n_rules > 0 for r in got if r.stratum != "e")
    assert all(r.kept and r.n_rules == 0 for r in got if r.stratum == "e")


def test_rule_sets_grow_and_hold_their_risk():
    rng = np.random.default_rng(1)
    sizes = [len(grid) for grid in risk_rules.GRID.values()]
    first = np.stack([rng.integers(0, n + 1, 500) for n in sizes], axis=1)
    good = rng.integers(0, 2, 500)
    last = np.zeros(500, bool)
    for cuts in risk_rules.ordered_sets(first, good, 1 - good):
        now = np.any([first[:, r] <= c for r, c in enumerate(cuts) if c is not None], axis=0)
        assert (now >= last).all() and now.sum() > last.sum()
        last = now
    assert risk_rules.tested_strata({"a": 217, "b": 217, "c": 217, "d": 217, "e": 50}) == dict.fromkeys("abcd", 217)
    assert risk_rules.tested_strata({"a": 148}) == {} and risk_rules.tested_strata({}) == {}
