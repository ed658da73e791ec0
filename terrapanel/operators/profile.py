"""Profiling aggregations.

Every profile is one or two aggregation passes with partial (map-side)
aggregation; nothing collects rows.  Exact quantiles go through
``grouped_quantiles`` (selection by counts, skew safe).
"""

from __future__ import annotations

import itertools
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.functions.calendar import log1p_clipped
from terrapanel.operators.lookup import month_spine_fill, small_side
from terrapanel.operators.quantiles import grouped_quantiles, narrow_values, quantiles


def mean_by(df: DataFrame, keys: Sequence[str], value: str, out: str = "mean_value") -> DataFrame:
    """A1: mean of ``value`` by keys; rows with a null key are dropped."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.avg(value).alias(out))


def adjusted_skewness(c) -> F.Column:
    """Bias-adjusted Fisher–Pearson G1 from Spark's population g1."""
    col = F.col(c) if isinstance(c, str) else c
    n = F.count(col).cast("double")
    return F.when(n > 2, F.skewness(col) * F.sqrt(n * (n - 1)) / (n - 2))


def describe(df: DataFrame, value: str, approx: bool = False) -> DataFrame:
    """A7 (+A8): count, mean, sample std, min, 25/50/75 %, max, adjusted skew."""
    values = narrow_values(df, [], value)              # read by the moments and by every count
    moments = values.agg(F.count("_v").cast("long").alias("count"), F.avg("_v").alias("mean"),
                         F.stddev_samp("_v").alias("std"), F.min("_v").alias("min"),
                         F.max("_v").alias("max"), adjusted_skewness("_v").alias("skew"))
    q = quantiles(values, "_v", [0.25, 0.5, 0.75], ["p25", "p50", "p75"], approx=approx, narrow=values).first()
    return moments.select("count", "mean", "std", "min", *[F.lit(q[c] if q else None).cast("double").alias(c) for c in ("p25", "p50", "p75")],
                          "max", "skew")


def histogram(df: DataFrame, value: str, bins: int = 60, log1p: bool = False) -> DataFrame:
    """Equal-width bins between min and max; the max lands in the last bin."""
    v = log1p_clipped(value) if log1p else F.col(value).cast("double")
    vals = df.select(v.alias("_x")).where(F.col("_x").isNotNull())
    ends = vals.select(F.struct(F.min("_x").alias("mn"), F.max("_x").alias("mx"))).scalar()    # one pass
    mn, mx = ends["mn"], ends["mx"]
    width = (mx - mn)
    b = F.when(width > 0, F.least(F.floor((F.col("_x") - mn) * F.lit(bins) / width).cast("int") + 1,
                                  F.lit(bins))).otherwise(F.lit(1))
    counts = vals.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).cast("long").alias("n"))
    return counts.select("bin", "n", (mn + (F.col("bin") - 1) * width / F.lit(bins)).alias("bin_lo"),
                         (mn + F.col("bin") * width / F.lit(bins)).alias("bin_hi"))


def correlation_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A10: all pairwise Pearson correlations (pairwise-complete) in one pass,
    returned as (col_a, col_b, corr) with both orders and the diagonal."""
    pairs = list(itertools.combinations(cols, 2))
    wide = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    parts = []
    for i, (a, b) in enumerate(pairs):
        parts += [f"'{a}', '{b}', c{i}", f"'{b}', '{a}', c{i}"]
    for c in cols:
        parts.append(f"'{c}', '{c}', CAST(1.0 AS DOUBLE)")
    stack = ", ".join(parts)
    return wide.selectExpr(f"stack({len(parts)}, {stack}) AS (col_a, col_b, corr)")


def monthly_resample(df: DataFrame, keys: Sequence[str], date_col: str, value: str,
                     out: str = "mean_value") -> DataFrame:
    """Month-start buckets, mean, empty months kept as null rows."""
    keys = list(keys)
    m = df.dropna(subset=keys + [date_col]).withColumn(
        "month_start", F.trunc(F.col(date_col), "month"))
    if not keys:                       # one global series
        m = m.withColumn("_series", F.lit(0))
        agg = m.groupBy("_series", "month_start").agg(F.avg(value).alias(out))
        return month_spine_fill(agg, ["_series"], "month_start", [out], full_year=False).drop("_series")
    agg = m.groupBy(*keys, "month_start").agg(F.avg(value).alias(out))
    return month_spine_fill(agg, keys, "month_start", [out], full_year=False)


def box_stats(df: DataFrame, group: str, value: str, approx: bool = False) -> DataFrame:
    """Quartiles and whiskers (most extreme values inside 1.5·IQR)."""
    values = narrow_values(df, [group], value)
    q = grouped_quantiles(df, [group], value, [0.25, 0.5, 0.75], ["q1", "median", "q3"],
                          approx=approx, narrow=values)
    q = small_side(q.withColumn("iqr", F.col("q3") - F.col("q1")))     # one row per group
    fences = q.select(group, (F.col("q1") - 1.5 * F.col("iqr")).alias("_lof"),
                      (F.col("q3") + 1.5 * F.col("iqr")).alias("_hif"))
    j = values.join(fences, group, "inner")
    wh = j.groupBy(group).agg(
        F.min(F.when(F.col("_v") >= F.col("_lof"), F.col("_v"))).alias("whisker_lo"),
        F.max(F.when(F.col("_v") <= F.col("_hif"), F.col("_v"))).alias("whisker_hi"))
    return q.join(wh, group, "inner")


def month_mean_std(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per group mean and population std."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(
        F.count(value).cast("long").alias("n"), F.avg(value).alias("hist_mean"),
        F.stddev_pop(value).alias("hist_std"))


def pivot_month_year(df: DataFrame, keys: Sequence[str], value: str, years: Sequence[int],
                     month_col: str = "Month_num", year_col: str = "Year") -> DataFrame:
    """Mean pivot Month × Year with explicit year values; all 12 months
    present per group (J7 over 1..12)."""
    keys = list(keys)
    piv = (df.dropna(subset=keys + [month_col, year_col])
             .groupBy(*keys, month_col).pivot(year_col, list(years)).agg(F.avg(value)))
    year_cols = [str(y) for y in years]
    return month_spine_fill(piv, keys, month_col, year_cols, full_year=True)


def sample_complete_rows(df: DataFrame, cols: Sequence[str], n: int = 2000, seed: int = 42,
                         id_col: str | None = None) -> DataFrame:
    """T5: n pseudo-random complete rows, those with the least hash of the seed
    and the id (or all columns).  Each task keeps its n least and they are
    merged, so the sample is the same however the rows lie, that of two tables is the
    sample of their samples, and SQL can draw it."""
    base = df.select(*cols, *([id_col] if id_col and id_col not in cols else [])).dropna(subset=list(cols))
    own = [id_col] if id_col else list(cols)
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in own]))
    return base.withColumn("_h", key).orderBy("_h", *own).limit(n).drop("_h")
