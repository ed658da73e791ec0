"""Exact linear-interpolated quantiles, selected without sorting.

Spark's exact ``percentile`` keeps every distinct value of a group in one
aggregation buffer, which fails for a large group.  Here a wanted rank is
enclosed by two values of the data, and counting narrows them:

1. ``percentile_approx`` brackets each rank: the sketch is off by at most
   n / ``ACCURACY`` ranks, the bracket is three times as wide either way.
2. One grouped count tells how many values are below, at either end of and
   inside each bracket, for all groups and ranks at once, and a small sketch of the
   inside cuts it at ``GRID`` places.  Ranks at an end are found; as long as some
   inside holds more than ``LIMIT`` values, its bracket becomes the two cuts
   around the rank, and is counted again.  A bracket that misses its rank
   (which the sketch rules out) would start again from the extremes.
3. What is left inside, at most ``LIMIT`` values, is taken in order.
4. Interpolate ``lo + (hi - lo)·(h - floor(h))`` with ``h = (n-1)·p`` — NumPy's
   default rule.

Groups of at most ``LIMIT`` values take the exact ``percentile`` in the last
count (a bounded buffer); where all groups are that small it is the only one.
The narrow (group, value) rows are written once and read by every count; no
value is shuffled but by partial aggregates.  ``approx=True`` stops at the sketch.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.operators.lookup import small_side
from terrapanel.session import materialize


def _pname(p: float) -> str:
    s = f"{p * 100:g}".replace(".", "_")
    return f"p{s}"


ACCURACY = 10_000         # of the sketch that brackets a rank
GRID = 64                 # cuts of the inside of a bracket
LIMIT = 50_000            # values that one buffer may hold


def _ends(ps: Sequence[float], accuracy: int) -> list:
    wide = 3.0 / accuracy
    return [x for p in ps for x in (max(0.0, p - wide), min(1.0, p + wide))]


def _tally(v, lo, hi, i: int) -> list:
    """Counts of values around bracket ``i`` and the cuts of its inside."""
    inside = (v > lo) & (v < hi)
    return [F.count_if(v < lo).alias(f"_lt{i}"), F.count_if(v == lo).alias(f"_lo{i}"), F.count_if(inside).alias(f"_in{i}"),
            F.count_if(v == hi).alias(f"_hi{i}"),
            F.percentile_approx(F.when(inside, v), [j / GRID for j in range(GRID + 1)], 50 * GRID).alias(f"_cut{i}")]


def narrow_values(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """The groups and ``_v``, the present values as double, written once; rows with a null
    group key are left out (as by pandas groupby)."""
    keep = F.col(value).isNotNull()
    for g in group:
        keep = keep & F.col(g).isNotNull()
    return materialize(df.where(keep).select(*group, F.col(value).cast("double").alias("_v")))


def grouped_quantiles(df: DataFrame, group: Sequence[str], value: str, ps: Sequence[float],
                      names: Sequence[str] | None = None, approx: bool = False,
                      accuracy: int = ACCURACY, extra_aggs: Sequence | None = None,
                      narrow: DataFrame | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per group with one column per probability (and ``n``); rows with
    a null value or a null group key are left out.

    ``extra_aggs`` (aggregate Columns over the same groups, e.g. mean and std,
    seeing the value as ``_v``) ride along; ``narrow`` may hold what
    ``narrow_values`` has written."""
    group = list(group)
    names = list(names or [_pname(p) for p in ps])
    extra_aggs = list(extra_aggs or [])
    v = F.col("_v")
    present = narrow if narrow is not None else narrow_values(df, group, value)
    n = F.count(F.lit(1)).alias("n")
    if approx:
        agg = present.groupBy(*group).agg(n, F.percentile_approx("_v", list(ps), accuracy).alias("_q"))
        return agg.select(*group, "n", *[F.col("_q")[i].alias(x) for i, x in enumerate(names)])

    exact = F.percentile(v, F.array(*[F.lit(float(p)) for p in ps]))
    largest = present.groupBy(*group).agg(n).agg(F.max("n")).first()[0] or 0
    if largest <= limit:
        agg = present.groupBy(*group).agg(n, exact.alias("_q"), *extra_aggs)
        extra = [c for c in agg.columns if c not in {*group, "n", "_q"}]
        return agg.select(*group, "n", *[F.col("_q")[i].alias(x) for i, x in enumerate(names)], *extra)

    first = present.groupBy(*group).agg(n, F.min("_v").alias("_min"), F.max("_v").alias("_max"),
                                        F.percentile_approx("_v", _ends(ps, accuracy), accuracy).alias("_e"), *extra_aggs)
    extra = [c for c in first.columns if c not in {*group, "n", "_e", "_min", "_max"}]
    h = [(F.col("n") - 1) * F.lit(float(p)) for p in ps]
    first = first.select(*group, "n", "_min", "_max", *extra, *[c for i, x in enumerate(h) for c in (
        F.floor(x).cast("long").alias(f"_k{i}"), F.ceil(x).cast("long").alias(f"_j{i}"), (x - F.floor(x)).alias(f"_f{i}"),
        F.when(F.lit(ps[i] * accuracy <= 3), F.col("_min")).otherwise(F.col("_e")[2 * i]).alias(f"_a{i}"),
        F.when(F.lit((1 - ps[i]) * accuracy <= 3), F.col("_max")).otherwise(F.col("_e")[2 * i + 1]).alias(f"_b{i}"))])
    state, some = small_side(first), range(len(ps))
    while True:
        of = state.select(*[F.col(g).alias(f"_of_{g}") for g in group], *[f"_{x}{i}" for x in "ab" for i in some], F.col("n").alias("_n"))
        joined = present.join(of, [F.col(g) == F.col(f"_of_{g}") for g in group])
        value_in = [F.when(F.col("_n") > limit, v) for _ in some]                    # the small groups need no counts
        counted = small_side(joined.groupBy(*group).agg(*[c for i in some for c in _tally(value_in[i], F.col(f"_a{i}"), F.col(f"_b{i}"), i)]))
        state = state.join(counted, group)
        wide = materialize(state.where(F.col("n") > limit).select(F.max(F.greatest(F.lit(0), *[_left_inside(i) for i in some])).alias("m"))).first()[0] or 0
        if wide <= limit:
            break
        new = []
        for i in some:
            a, b = _narrower(i)
            new += [a.alias(f"_a{i}"), b.alias(f"_b{i}")]
        state = small_side(state.select(*group, "n", "_min", "_max", *extra, *[f"_{x}{i}" for x in "kjf" for i in some], *new))
    state = small_side(state)
    of = state.select(*[F.col(g).alias(f"_of_{g}") for g in group], *[f"_{x}{i}" for x in "ab" for i in some], F.col("n").alias("_n"))
    joined = present.join(of, [F.col(g) == F.col(f"_of_{g}") for g in group])
    small = F.col("_n") <= limit
    last = joined.groupBy(*group).agg(
        F.percentile(F.when(small, v), F.array(*[F.lit(float(p)) for p in ps])).alias("_q"),
        *[F.sort_array(F.collect_list(F.when(~small & (v > F.col(f"_a{i}")) & (v < F.col(f"_b{i}")), v))).alias(f"_s{i}") for i in some])
    found = state.join(last, group)
    out = []
    for i, x in enumerate(names):
        lo, hi = _at_rank(i, "k"), _at_rank(i, "j")
        out.append(F.when(F.col("n") <= limit, F.get("_q", F.lit(i))).otherwise(lo + (hi - lo) * F.col(f"_f{i}")).alias(x))
    return found.select(*group, "n", *out, *extra)


def _position(i: int, rank: str):
    """Of a wanted rank among the values inside bracket ``i``."""
    return F.col(f"_{rank}{i}") - F.col(f"_lt{i}") - F.col(f"_lo{i}")


def _missed(i: int):
    below, inside = F.col(f"_lt{i}"), F.col(f"_lt{i}") + F.col(f"_lo{i}") + F.col(f"_in{i}")
    same = F.col(f"_a{i}") == F.col(f"_b{i}")
    return (F.col(f"_k{i}") < below) | (F.col(f"_j{i}") >= inside + F.when(same, F.lit(0)).otherwise(F.col(f"_hi{i}")))


def _left_inside(i: int):
    """Values that the last step would have to hold for bracket ``i``."""
    at_an_end = (_position(i, "j") < 0) | (_position(i, "k") >= F.col(f"_in{i}"))
    return F.when(_missed(i), F.lit(1 << 62)).when(at_an_end, F.lit(0)).otherwise(F.col(f"_in{i}"))


def _narrower(i: int) -> tuple:
    """The cuts of the inside around both ranks; of a bracket that is done, one value."""
    at, m = _position(i, "k"), F.col(f"_in{i}")
    cuts = F.col(f"_cut{i}")
    low = F.floor(at * GRID / m).cast("int") - 2
    high = F.ceil((_position(i, "j") + 1) * GRID / m).cast("int") + 2
    # ranks at an end keep that end; the inside is needed no more
    a = F.when(_missed(i), F.col("_min")).when(_left_inside(i) == 0, F.col(f"_a{i}")).when((at < 0) | (low < 0), F.col(f"_a{i}")).otherwise(F.get(cuts, low))
    b = F.when(_missed(i), F.col("_max")).when(_left_inside(i) == 0, F.col(f"_b{i}")).when(high > GRID, F.col(f"_b{i}")).otherwise(F.get(cuts, high))
    return a, b


def _at_rank(i: int, rank: str):
    at = _position(i, rank)
    return F.when(at < 0, F.col(f"_a{i}")).when(at >= F.col(f"_in{i}"), F.col(f"_b{i}")).otherwise(F.get(f"_s{i}", at.cast("int")))


def column_quantiles(df: DataFrame, columns: Sequence[str], ps: Sequence[float], accuracy: int = ACCURACY,
                     limit: int = LIMIT) -> dict:
    """column -> (n, quantiles) of the present values of several columns of one table, all
    columns and ranks by the same counts over the table as it is; without values (0, [None, ...]).
    Only counts, cuts and at most ``limit`` values a rank come to the driver."""
    value = {c: F.col(c).cast("double") for c in columns}
    head = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    n = {c: head[f"n{i}"] for i, c in enumerate(columns)}
    out: dict = {c: (0, [None] * len(ps)) for c in columns if not n[c]}
    small = [c for c in columns if 0 < n[c] <= limit]
    big = [c for c in columns if n[c] > limit]
    if small:
        row = df.agg(*[F.percentile(value[c], F.array(*[F.lit(float(p)) for p in ps])).alias(f"q{i}") for i, c in enumerate(small)]).first()
        out |= {c: (n[c], list(row[f"q{i}"])) for i, c in enumerate(small)}
    if not big:
        return out
    row = df.agg(*[x for i, c in enumerate(big) for x in (
        F.min(value[c]).alias(f"min{i}"), F.max(value[c]).alias(f"max{i}"), F.percentile_approx(value[c], _ends(ps, accuracy), accuracy).alias(f"e{i}"))]).first()
    brackets: dict = {}
    for i, c in enumerate(big):
        for j, p in enumerate(ps):
            brackets[c, j] = (row[f"min{i}"] if p * accuracy <= 3 else row[f"e{i}"][2 * j], row[f"max{i}"] if (1 - p) * accuracy <= 3 else row[f"e{i}"][2 * j + 1])
    ranks = {(c, j): (math.floor((n[c] - 1) * p), math.ceil((n[c] - 1) * p)) for c in big for j, p in enumerate(ps)}
    found: dict = {}                                           # (column, rank) -> value

    def settle(key, tally, inside) -> bool:
        """Take the ranks that the counts give away; whether some are still inside."""
        below, at_lo, m, at_hi = tally
        a, b = brackets[key]
        open_ = False
        for k in set(ranks[key]):
            at = k - below - at_lo
            if at < 0:
                found[key, k] = a
            elif at >= m:
                found[key, k] = b
            elif inside is not None:
                found[key, k] = inside[at]
            else:
                open_ = True
        return open_

    todo, collect = list(brackets), False
    while todo:
        aggs = []
        for i, key in enumerate(todo):
            v, (a, b) = value[key[0]], brackets[key]
            aggs += _tally(v, F.lit(a), F.lit(b), i)
            if collect:
                aggs.append(F.sort_array(F.collect_list(F.when((v > a) & (v < b), v))).alias(f"_s{i}"))
        row = df.agg(*aggs).first()
        again, collect = [], True
        for i, key in enumerate(todo):
            below, at_lo, m, at_hi = (row[f"_{x}{i}"] for x in ("lt", "lo", "in", "hi"))
            a, b = brackets[key]
            k, j = ranks[key]
            if k < below or j >= below + at_lo + m + (at_hi if a != b else 0):
                first = big.index(key[0])
                ends = df.agg(F.min(value[big[first]]), F.max(value[big[first]])).first()
                brackets[key] = (ends[0], ends[1])
            elif not settle(key, (below, at_lo, m, at_hi), row[f"_s{i}"] if f"_s{i}" in row else None):
                continue
            elif m > limit:
                cuts = row[f"_cut{i}"]
                low = math.floor((k - below - at_lo) * GRID / m) - 2
                high = math.ceil((j - below - at_lo + 1) * GRID / m) + 2
                brackets[key] = (a if k < below + at_lo or low < 0 else cuts[low], b if high > GRID else cuts[high])
                collect = False
            again.append(key)
        todo = again
    for c in big:
        got = []
        for j, p in enumerate(ps):
            k, i = ranks[c, j]
            lo, hi = found[(c, j), k], found[(c, j), i]
            h = (n[c] - 1) * p
            got.append(lo + (hi - lo) * (h - math.floor(h)))
        out[c] = (n[c], got)
    return out


def quantiles(df: DataFrame, value: str, ps: Sequence[float], names: Sequence[str] | None = None,
              approx: bool = False, narrow: DataFrame | None = None) -> DataFrame:
    """Global (ungrouped) form: one row, none without values."""
    names = list(names or [_pname(p) for p in ps])
    if approx:
        keyed = df.withColumn("_all", F.lit(0))
        return grouped_quantiles(keyed, ["_all"], value, ps, names, approx).drop("_all")
    narrow = narrow if narrow is not None else narrow_values(df, [], value)
    n, got = column_quantiles(narrow, ["_v"], ps)["_v"]
    rows = [(n, *got)] if n else []
    return df.sparkSession.createDataFrame(rows, "n long, " + ", ".join(f"`{x}` double" for x in names))
