"""N-gram Jaccard join, suffix dedup, decontamination."""
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np

from tests_paths import SF

from terrapanel.llm import common, decontamination, ngram_jaccard, suffix_dedup

# ------------------------------------------------------------ components


def plain_components(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def test_counters_of_a_task_travel_packed(spark):
    counts = np.random.default_rng(3).poisson(0.2, (3, 1 << 18)).astype(np.uint32)
    sent = [[(tab, block, bytearray(raw)) for tab, block, raw in common.blocks_of(x)] for x in counts]
    assert sum(len(raw) for part in sent for _, _, raw in part) < counts.nbytes / 4
    rows = spark.createDataFrame([r for part in sent for r in part], common.BLOCK_SCHEMA)
    assert (common.gather_blocks(common.sum_blocks(rows, "uint32"), 1, 1 << 18, "uint32")[0] == counts.sum(0)).all()


def test_texts_are_read_few_rows_at_a_time(spark, docs):
    common.with_bytes(docs)
    for conf in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        assert int(spark.conf.get(conf)) <= common.BATCH_ROWS


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 260)] + [(5, 5), (7, 8), (8, 7)]
    edges += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(70)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = plain_components([e for e in edges if e[0] != e[1]])
    assert got == want
    assert common.components(spark.createDataFrame([], "u long, v long")).collect() == []


# --------------------------------------------------------------- Jaccard

def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i:i + 5]) for i in range(len(w) - 4)])


def plain_jaccard(rows):
    """(doc_id, n, component id) by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    edges = []
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                edges.append((i, j))
    root = plain_components(edges)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root.get(i, i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return Counter((d, len(s), least.get(root.get(i, i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def test_jaccard_equals_all_pairs(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = ngram_jaccard.jaccard_components(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_jaccard(rows)


def near_copies(n, words=60, seed=4):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(i % 3):
            w[rng.randrange(words)] = f"n{rng.randrange(10 ** 6)}"
        out.append((i, " ".join(w)))
    return out


def test_jaccard_with_small_blocks_and_hot_shingles(spark, monkeypatch):
    rows = near_copies(150) + [(1000 + i, f"plain text number {i} without any copy of it at all {i}") for i in range(30)]
    monkeypatch.setattr(ngram_jaccard, "BLOCK_SETS", 16)
    monkeypatch.setattr(ngram_jaccard, "HOT", 20)
    monkeypatch.setattr(ngram_jaccard, "DENSE", 7)
    got = ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_jaccard(rows)


def test_jaccard_prefixes_travel_packed(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(" ".join(f"v{rng.randrange(10 ** 6)}" for _ in range(120)).encode(),) for _ in range(600)]
    monkeypatch.setattr(ngram_jaccard, "PACK_ROWS", 10_000)
    docs = spark.createDataFrame(rows + rows[:40], "text_bytes binary").coalesce(1)
    counts = spark.sparkContext.broadcast(np.zeros(1 << ngram_jaccard.SKETCH_BITS, np.uint32))
    packed = ngram_jaccard._prefixes(docs, 5, 75, counts, 4)
    got = packed.collect()
    entries = 600 * (116 - 87 + 1 + 19)
    assert sum(len(common.unsqueeze(r.owners)) for r in got) == entries and {r.rng for r in got} == {0, 1, 2, 3}
    assert sum(len(r.shingles) + len(r.owners) + len(r.sigs) for r in got) < 11 * entries      # 24 bytes as rows
    assert ngram_jaccard._with_neighbours(packed).count() == 0
    again = packed.unionByName(ngram_jaccard._prefixes(spark.createDataFrame(
        [(a.replace(b"v", b"u", 40),) for a, in rows[:5]], "text_bytes binary"), 5, 75, counts, 4))
    held = ngram_jaccard._with_neighbours(again).collect()
    sigs = defaultdict(set)
    for r in held:
        sigs[r.shingle].add(r.sig)
    assert sigs and all(len(x) == 2 for x in sigs.values()) and len(held) == sum(map(len, sigs.values()))


def test_jaccard_rows_shared_with_many_others_are_no_candidates(spark):
    """Every shingle of a patchwork occurs in some other text, but no other text holds more than a few of them;
    copies that link stay, also where a shingle has more classes than are listed."""
    rng = random.Random(5)
    others = [[f"v{rng.randrange(10 ** 6)}" for _ in range(120)] for _ in range(60)]
    patchwork = [w for t in others for w in t[40:48]]
    near = [[f"u{i}" for i in range(100)] + [f"x{k}y{i}" for i in range(3)] for k in range(20)]
    texts = [" ".join(t) for t in [*others, patchwork, *near]]
    docs = spark.createDataFrame([(t.encode(),) for t in texts], "text_bytes binary").repartition(3)
    counts = spark.sparkContext.broadcast(np.zeros(1 << ngram_jaccard.SKETCH_BITS, np.uint32))
    held = ngram_jaccard._with_neighbours(ngram_jaccard._prefixes(docs, 5, 75, counts, 4))
    hashes = common.WordHashes()
    sig = [ngram_jaccard.set_digest(common.shingle_set(t.encode(), hashes)) for t in texts]
    assert sig[60] in {r.sig for r in held.collect()}
    left = ngram_jaccard._shared_enough(held, 4).collect()
    assert {r.sig for r in left} == set(sig[61:])
    rows = list(enumerate(texts))
    got = ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_jaccard(rows)


def test_jaccard_no_rows_or_no_words(spark, no_docs):
    assert ngram_jaccard.jaccard_components(no_docs).collect() == []
    got = ngram_jaccard.jaccard_components(spark.createDataFrame([(1, None), (2, ""), (3, " ")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(1, 0, 1), (2, 0, 2), (3, 0, 3)}


def test_block_links_keep_the_links_connected():
    rng = random.Random(1)
    sets = []
    for text in [t for _, t in near_copies(80, seed=9)]:
        s = common.shingle_set(text.encode(), common.WordHashes())
        sets.append(s)
    sigs = np.arange(len(sets)) + 10
    side = np.array([rng.randrange(2) for _ in sets])
    pairs = [(i, j) for i in range(len(sets)) for j in range(i)
             if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))]
    across = plain_components([(sigs[i], sigs[j]) for i, j in pairs if side[i] != side[j]])
    assert plain_components(ngram_jaccard.block_links(sigs, sets, side, 75)) == across
    all_pairs = plain_components([(sigs[i], sigs[j]) for i, j in pairs])
    assert plain_components(ngram_jaccard.block_links(sigs, sets, np.zeros(len(sets), int), 75)) == all_pairs


def test_keep_one_of_each_group(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    kept = ngram_jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    want = Counter()
    sets = [shingles(t) for _, t in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i)
             if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    root, groups = plain_components(edges), defaultdict(list)
    for i in range(len(rows)):
        groups[root.get(i, i)].append(i)
    least = 0
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        choices = {rows[i] for i in members if (rows[i][0] == min(ids) if ids else True)}
        mine = sum(got[c] for c in choices if c in got)
        assert mine >= 1
        least += 1
        want += Counter(next(iter(choices & set(got))) for _ in range(1))
    assert sum(got.values()) == least


# ---------------------------------------------------------------- suffix

def plain_repeats(texts, length):
    seen = Counter(t[p:p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if seen[t[p:p + length]] > 1:
                gone[p:p + length] = True
        out.append(gone)
    return out


def expected(rows, length):
    out = Counter()
    texts = [(t or "").encode() for _, t in rows]
    for (d, _), t, gone in zip(rows, texts, plain_repeats(texts, length), strict=True):
        kept = bytes(np.frombuffer(t, np.uint8)[~gone]) if t else b""
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[d, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_removal_equals_every_window_counted(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = suffix_dedup.removal(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == expected(rows, 400)


def test_removal_of_short_strings_on_both_paths(spark, monkeypatch):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(60)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    base, texts = [prose(200) for _ in range(3)], []
    for _ in range(50):
        b = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(b))
            b[k:k + rng.randint(0, 3)] = prose(1)
        a = rng.randrange(len(b))
        texts.append(prose(rng.randint(0, 40)) + "".join(b[a:rng.randrange(a, len(b) + 1)]) + prose(rng.randint(0, 30)))
    texts += ["", "x" * 39, "x" * 40, "x" * 41, "ab" * 200, "é" * 90, texts[3], texts[3]]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for hot in (50_000, 1):
        monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", hot)
        got = suffix_dedup.removal(df, 40, 20).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == expected(rows, 40)


def test_hot_windows_are_rows_in_short_batches_of_shared_blocks_only(spark, monkeypatch):
    """A line that 40 texts of other words hold: most windows around it reach far into words of one text."""
    rng = random.Random(2)
    line = "".join(rng.choice("abcdefgh ") for _ in range(45))
    texts = ["".join(rng.choice("stuvwxyz ") for _ in range(30)) + line + "".join(rng.choice("stuvwxyz ") for _ in range(30)) for _ in range(40)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", 1)
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", 50)
    monkeypatch.setattr(suffix_dedup, "HOT_BLOCK", 4)
    written, plain = [], suffix_dedup.materialize

    def kept(df):
        written.append(plain(df))
        return written[-1]

    monkeypatch.setattr(suffix_dedup, "materialize", kept)
    got = suffix_dedup.removal(df, 40, 20).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == expected(rows, 40)
    windows, = (t for t in written if t.columns == ["doc_id", "doc_hash", "n", "start", "w"])
    anchors, = (t for t in written if {"ctx", "before"} <= set(t.columns))
    hot = anchors.groupBy("fp").count().where("count > 1")
    every = sum(r.before + r.after - 40 + 1 for r in anchors.join(hot, "fp").collect())
    assert 0 < windows.count() < every / 2


def test_anchors_do_not_hang_on_segments(monkeypatch, texts):
    raw = [(t or "").encode() for t in texts]
    ends = np.cumsum([len(t) for t in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    whole = suffix_dedup.Grams(40, 20).anchors(data, ends)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 64)
    cut = suffix_dedup.Grams(40, 20).anchors(data, ends)
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut, strict=True))
    places, at = set(whole[0].tolist()), 0
    for t in raw:                       # every window holds an anchor
        assert all(any(at + p + d in places for d in range(21)) for p in range(len(t) - 39))
        at += len(t)


def test_merge_keeps_order_and_common_prefixes():
    rng = random.Random(3)
    keys = [["".join(rng.choice("ab") for _ in range(rng.randint(0, 60))).encode() for _ in range(rng.randint(0, 50))] for _ in range(7)]
    got = list(suffix_dedup.merge_runs([suffix_dedup.front_code(sorted(k)) for k in keys]))
    assert [k for _, _, k, _ in got] == sorted(x for k in keys for x in k)
    for (_, _, a, _), (_, _, b, h) in zip(got, got[1:], strict=False):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert h == n
    assert list(suffix_dedup.merge_runs([])) == []


def test_dedup_keeps_rows_and_columns(docs, no_docs):
    out = suffix_dedup.dedup(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and out.count() == docs.count()
    assert all(r.n_chars == len(r.text) for r in out.collect())
    assert suffix_dedup.removal(no_docs).collect() == []


# -------------------------------------------------------- decontamination

def plain_align(p, m):
    best, h = 0, np.zeros((len(p) + 1, len(m) + 1), int)
    for i in range(1, len(p) + 1):
        for j in range(1, len(m) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if p[i - 1] == m[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
            best = max(best, h[i, j])
    return best


def test_alignment_equals_the_plain_table():
    rng = np.random.default_rng(5)
    passages = [rng.integers(0, 6, rng.integers(1, 40)) for _ in range(30)]
    items = [rng.integers(0, 6, rng.integers(1, 20)) for _ in range(30)]
    for (score, first, last), p, m in zip(decontamination.align(passages, items), passages, items, strict=True):
        assert score == plain_align(p.tolist(), m.tolist())
        if score:
            assert plain_align(p[first:last].tolist(), m.tolist()) == score and p[first] in m and p[last - 1] in m


def test_leaks_and_edited_leaks_are_found(spark, docs):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(3, 7))) for _ in range(900)]

    def prose(n):
        return [rng.choice(words) for _ in range(n)]

    items = [(i, " ".join(prose(rng.randint(12, 40)))) for i in range(12)]
    rows, want = [], set()
    for i in range(120):
        w, d = prose(rng.randint(30, 120)), i
        if i % 3 == 0:
            item, text = rng.choice(items)
            m = text.split()
            for _ in range(len(m) // 6 if i % 2 else 0):
                m[rng.randrange(len(m))] = rng.choice(words)
            if i % 4 == 0:
                m.insert(len(m) // 2, "inserted")
            w[10:10] = m
            want.add((d, item))
        rows.append((d, " ".join(w).upper() if i % 5 == 0 else ", ".join(w)))
    extra = [(None, None), (200, ""), (201, None), (0, rows[0][1])]
    bench = spark.createDataFrame(items + [(50, None), (51, "too short"), (None, "no id for this item of several words"), (52, items[0][1])], "item_id long, text string")
    df = spark.createDataFrame(rows + extra, "doc_id long, text string").repartition(4)
    got = decontamination.leaks(df, bench).collect()
    pairs = {(r.doc_id, r.item_id) for r in got if r.item_id != 52}
    assert pairs == want and len(got) == len({(r.doc_id, r.item_id) for r in got})
    assert {r.doc_id for r in got if r.item_id == 52} == {d for d, i in want if i == 0}
    kept = decontamination.keep_clean(df, bench)
    leaking = {rows[d][1] for d, _ in want}
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(r for r in rows + extra if r[1] not in leaking)
    assert decontamination.leaks(docs, bench.limit(0)).collect() == []


def test_decontamination_of_nothing(no_docs, spark):
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert decontamination.leaks(no_docs, bench).collect() == []
    assert decontamination.keep_clean(no_docs, bench).columns == no_docs.columns


def test_exact_leaks_in_the_tables(spark):
    got = {(r.doc_id, r.item_id) for r in decontamination.op8_decontamination(spark, SF).collect()}
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    assert {(d.doc_id, b.item_id) for d in docs for b in items if b.text in d.text} <= got


def test_no_item_is_left_out(spark):
    """Items without an id, of a repeated id, of few words and half of a long one; common short items are no leak."""
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(7)) for _ in range(4000)]

    def prose(n):
        return [rng.choice(words) for _ in range(n)]

    long, nameless, first, second, short, tail = prose(450), prose(20), prose(20), prose(25), ["Zanzibar,", "quokka!", "Ultima"], prose(300)
    texts = {1: prose(50) + long[100:300] + prose(40), 2: prose(30) + nameless + prose(9), 3: prose(5) + first + prose(70), 4: prose(60) + second,
             5: prose(10) + ["zanzibar", "quokka", "ultima"] + prose(10), 6: prose(200), 7: prose(10) + long[10:40] + prose(100), 8: ["yes"] * 50 + prose(40),
             9: prose(10) + ["zanzibar", "quokka"] + prose(30), 10: prose(5) + tail[:60]}
    items = [(7, long), (None, nameless), (9, first), (9, second), (11, short), (12, ["Yes"]), (13, nameless), (14, tail), (15, []), (None, None)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, t and " ".join(t)) for i, t in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench).collect()}
    assert got == {(1, 7), (2, None), (2, 13), (3, 9), (4, 9), (5, 11), (10, 14)}
    assert {r.doc_id for r in decontamination.keep_clean(docs, bench).collect()} == {6, 7, 8, 9}


def test_pairs_in_step_are_bounded():
    for sizes in ([5, 1, 900_000, 3], [10 ** 7], list(range(1, 300)), [40_000] * 100, []):
        groups = list(decontamination.in_step(sizes))
        assert sorted(i for g in groups for i in g) == list(range(len(sizes)))
        assert all(len(g) <= 64 and (len(g) == 1 or len(g) * max(sizes[i] for i in g) <= decontamination.CELLS) for g in groups)


def window_removal(texts, length=400):
    """(bytes, removed, spans, digest of the rest) of each text, from the hashes of all its windows."""
    data = [t.encode() for t in texts]
    base = np.uint64(0x9E3779B97F4A7C15 | 1)
    letters = np.random.default_rng(1).integers(1, 1 << 62, 256).astype(np.uint64)
    every = []
    for t in data:
        h = np.zeros(max(0, len(t) - length + 1), np.uint64)
        raw = letters[np.frombuffer(t, np.uint8)]
        for i in range(length if len(h) else 0):
            h = h * base + raw[i:i + len(h)]
        every.append(h)
    _, at, n = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    again = np.split(n[at] > 1, np.cumsum([len(h) for h in every])[:-1])
    out = []
    for t, hits in zip(data, again, strict=True):
        change = np.zeros(len(t) + 1, np.int64)
        starts = np.flatnonzero(hits)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + length, -1)
        gone = np.cumsum(change[:-1]) > 0
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup_of_the_given_table_equals_all_windows(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = Counter((r.doc_id, *x) for r, x in zip(rows, window_removal([r.text or "" for r in rows]), strict=True))
    assert Counter(tuple(r) for r in suffix_dedup.op10_suffix_dedup(spark, SF).collect()) == want


def test_planted_passages_go_and_clean_texts_stay(spark):
    rng = random.Random(31)
    words = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(4, 9))) for _ in range(3000)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(75, 120))) for _ in range(12)]
    texts = []
    for i in range(90):
        own = [" ".join(rng.choice(words) for _ in range(rng.randint(20, 200))) for _ in range(2)]
        texts.append(own[0] + " # " + (passages[i % 12] + " # " if i % 3 == 0 else "") + own[1])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in suffix_dedup.removal(df).collect()}
    for i in range(90):
        if i % 3:
            assert got[i].n_removed == 0
        else:
            assert got[i].n_removed >= len(passages[i % 12])
