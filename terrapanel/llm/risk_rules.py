"""Quality rules with risk-controlled thresholds.

Every whole text gets the base counts, and from them a few ratios.  A rule
rejects a text whose ratio exceeds a cutoff.  Cutoffs are chosen from fixed
grids, for each stratum (language) by itself, as one ordered sequence of rule
sets: a quarter of the labelled rows that pass the base rules (by a hash of
doc_id) orders them, from no rule on, each set being the one before with the
next cutoff that rejects most more bad rows (quality 0) for the good ones
(quality 1) it rejects.  The good rows of the other three quarters test the sets
in that order, until the first that fails: a set is admitted only if the exact
binomial upper bound of its false rejection rate is at most ``RISK``, at an
error level of ``LEVEL / strata``.  Neither the sequence nor the rules of a set
need a correction, as rows of the test had no say in the order.  So with
probability 1 - ``LEVEL``, all rules together falsely reject at most ``RISK`` of
the good texts of every stratum.  Of the admitted sets, the one that rejects
most of the bad texts is used, the gentlest of equals.

A stratum whose test has fewer than log(``LEVEL / strata``) / log(1 - ``RISK``)
good rows (149 for one, 217 for four: some 290 with the ordering quarter) can
admit nothing, however well the rules do; it takes no part, does not raise the
need of the others, and only the base rules decide there.  ``n_rules`` is the
number of rules in use in a row's stratum: 0 names the strata without one.

Nulls and odd rows: a null or empty text has no words and fails the base.  A
null lang is the stratum ``none``.  Labels that are null, or of documents not
there, are not used; a document with labels that differ counts by their least.
Repeated rows get equal results and count as rows of their own.  Without labels only
the base rules decide.  Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.common import held_out, slices, WordHashes, window_hashes, with_bytes
from terrapanel.session import materialize

LEAST_WORDS = 50
MOST_REPEATED = 50            # percent of words in repeated 3-word windows
RISK, LEVEL = 0.02, 0.05
#: ratio -> cutoffs, from the gentlest on
GRID = {
    "symbols_per_word": [1.0, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05],
    "repeated_lines": [0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05],
    "repeated_words": [0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1],
    "chars_per_word": [30.0, 20.0, 15.0, 12.0, 11.0, 10.0, 9.0, 8.0],
    "short_words": [-1.5, -2.0, -2.5, -3.0, -3.5, -4.0, -4.5],       # minus the characters of a word
    "same_words": [0.98, 0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65],    # 1 - distinct share
}
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct"]


def text_counts(text: bytes, hashes: WordHashes) -> list:
    """The numbers of ``COUNTS``; lines without a word do not count."""
    words = text.split()
    if not words:
        return [0] * len(COUNTS)
    by_byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = len(text) - int(by_byte[128:192].sum()) - int(by_byte[9:14].sum()) - int(by_byte[32])
    lines = [x for x in text.split(b"\n") if x.strip()]
    h = hashes.of(words)
    repeated = 0
    if len(words) > 3:
        _, kind, count = np.unique(window_hashes(h, 3), return_inverse=True, return_counts=True)
        often = count[kind] > 1
        if often.any():
            covered = np.zeros(len(words), bool)
            for i in range(3):
                covered[i:len(words) - 2 + i] |= often
            repeated = int(covered.sum())
    return [len(words), chars, int(by_byte[_SYMBOLS].sum()), len(lines) - len(set(lines)), repeated, len(lines), len(np.unique(h))]


def with_counts(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and ``COUNTS`` of every row of ``docs`` (doc_id, text, lang)."""

    def scan(batches):
        hashes = WordHashes()
        for batch in slices(batches):
            rows = np.array([text_counts(t, hashes) for t in batch.column(2).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(rows[:, i]) for i in range(len(COUNTS)))],
                                             names=["doc_id", "stratum", *COUNTS])

    rows = with_bytes(docs).select("doc_id", F.coalesce("lang", F.lit("none")).alias("stratum"), "text_bytes")
    return rows.mapInArrow(scan, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in COUNTS))


def ratios() -> dict:
    words = F.greatest("n_words", F.lit(1))
    return {"symbols_per_word": F.col("n_symbols") / words, "repeated_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
            "repeated_words": F.col("n_repeat_words") / words, "chars_per_word": F.col("word_chars") / words,
            "short_words": -F.col("word_chars") / words, "same_words": 1 - F.col("n_distinct") / words}


def binomial_at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial, summed exactly in logarithms."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    log = np.array([math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) for j in i])
    log += i * math.log(p) + (n - i) * math.log1p(-p)
    top = log.max()
    return float(min(1.0, math.exp(top) * np.exp(log - top).sum()))


def choose(good: np.ndarray, bad: np.ndarray, n_good: int, risk: float, level: float):
    """Index of the cutoff to use, or None: ``good`` and ``bad``: rejected rows per cutoff, gentlest first.
    The upper bound is at most ``risk`` where so few rejections have at most chance ``level``."""
    admitted = []
    for i, k in enumerate(good):
        if not n_good or binomial_at_most(int(k), n_good, risk) > level:
            break
        admitted.append(i)
    best = max(admitted, key=lambda i: (bad[i], -i), default=None)
    return best if best is not None and bad[best] else None


def ordered_sets(first: np.ndarray, good: np.ndarray, bad: np.ndarray) -> list:
    """Rule sets, each stricter than the one before: of each rule the index of its cutoff, or None.
    ``first``: the gentlest cutoff that rows of a kind exceed, by rule; ``good`` and ``bad``: such rows."""
    sizes = [len(grid) for grid in GRID.values()]
    chosen, out, held = [None] * len(sizes), [], np.ones(len(first), bool)
    while True:
        best = None
        for rule, size in enumerate(sizes):
            # a cutoff stricter than the one in use
            for cut in range(0 if chosen[rule] is None else chosen[rule] + 1, size):
                more = held & (first[:, rule] <= cut)
                gain = int(bad[more].sum())
                if gain:
                    # most bad rows for a good one; the gentlest of equals
                    rank = (gain / (int(good[more].sum()) + 0.5), -cut, -rule)
                    if best is None or rank > best[0]:
                        best = (rank, rule, cut, more)
        if best is None:
            return out
        _, rule, cut, more = best
        chosen[rule] = cut
        held &= ~more
        out.append(tuple(chosen))


def tested_strata(n_good: dict) -> dict:
    """stratum -> good rows of its test, of the strata that can admit a set at all; the number of
    rows alone decides, so that leaving out the others needs no correction."""
    most = sorted(n_good.items(), key=lambda x: (-x[1], x[0]))
    for m in range(len(most), 0, -1):
        if binomial_at_most(0, most[m - 1][1], RISK) <= LEVEL / m:
            return dict(most[:m])
    return {}


def thresholds(counted: DataFrame, labels: DataFrame) -> list:
    """(stratum, rule, cutoff, n_good, falsely rejected by the stratum's set) of the rules in use; counts
    per stratum and combination of grid cells come to the driver (their number is bounded by the grids)."""
    labels = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    joined = counted.where("not base_failed").join(labels, "doc_id")
    cells = [sum((F.col(rule) <= cut).cast("int") for cut in grid).alias(f"cut_{rule}") for rule, grid in GRID.items()]
    table = (joined.select("stratum", (F.col("quality") > 0).cast("int").alias("good"), held_out("doc_id", 4, 0).cast("int").alias("orders"), *cells)
             .groupBy("stratum", "good", "orders", *[f"cut_{rule}" for rule in GRID]).agg(F.count(F.lit(1)).alias("n")).collect())
    by_stratum: dict = {}
    for row in sorted(map(tuple, table)):
        by_stratum.setdefault(row[0], []).append(row[1:])
    by_stratum = {stratum: np.array(rows, np.int64) for stratum, rows in by_stratum.items()}
    tests = tested_strata({stratum: int(x[(x[:, 0] == 1) & (x[:, 1] == 0), -1].sum()) for stratum, x in by_stratum.items()})
    out = []
    for stratum in sorted(tests):
        x = by_stratum[stratum]
        good, orders, first, n = x[:, 0] == 1, x[:, 1] == 1, x[:, 2:-1], x[:, -1]
        sets = ordered_sets(first[orders], (n * good)[orders], (n * ~good)[orders])
        rejected = [np.any([first[:, r] <= cut for r, cut in enumerate(cuts) if cut is not None], axis=0) for cuts in sets]
        false = np.array([int(n[r & good & ~orders].sum()) for r in rejected], np.int64)
        best = choose(false, np.array([int(n[r & ~good].sum()) for r in rejected], np.int64), tests[stratum], RISK, LEVEL / len(tests))
        if best is not None:
            out += [(stratum, rule, GRID[rule][cut], tests[stratum], int(false[best]))
                    for rule, cut in zip(GRID, sets[best], strict=True) if cut is not None]
    return out


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept, stratum, ``rules`` (those that reject, joined by
    commas) and n_rules (those in use in the stratum)."""
    spark = docs.sparkSession
    counted = with_counts(docs)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    counted = materialize(counted.withColumn("base_failed", failed).withColumns(ratios()))
    chosen = thresholds(counted, labels)
    cutoffs: dict = {}
    for stratum, rule, cut, *_ in chosen:
        cutoffs.setdefault(stratum, {})[rule] = cut
    table = spark.createDataFrame([(s, {r: float(c) for r, c in by.items()}) for s, by in sorted(cutoffs.items())],
                                  "stratum string, cutoffs map<string,double>")
    joined = counted.join(table, "stratum", "left")
    hits = F.array_join(F.array_compact(F.array(*[F.when(F.col(rule) > F.try_element_at("cutoffs", F.lit(rule)), rule) for rule in GRID])), ",")
    return joined.withColumn("rules", F.coalesce(hits, F.lit(""))).select(
        "doc_id", *COUNTS[:5], "base_failed", (~F.col("base_failed") & (F.col("rules") == "")).alias("kept"), "stratum", "rules",
        F.coalesce(F.size("cutoffs"), F.lit(0)).alias("n_rules"))


def op7_risk_rules(spark, sf_dir: str) -> DataFrame:
    return apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
