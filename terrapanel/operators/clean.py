"""Row cleaning, set operations and data checks."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def drop_any_null(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with any null (in ``subset`` when given)."""
    return df.dropna(how="any", subset=list(subset) if subset else None)


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    """P5."""
    return df.dropna(subset=[target])


def apply_null_policy(df: DataFrame, policy: str, target: str) -> DataFrame:
    """L19: 'any' (drop rows with any null), 'target' (drop null targets), 'none'."""
    if policy == "any":
        return drop_any_null(df)
    if policy == "target":
        return drop_null_target(df, target)
    if policy == "none":
        return df
    raise ValueError(f"unknown null policy {policy!r}")


def add_column_if_missing(df: DataFrame, name: str, dtype: T.DataType | str = "string") -> DataFrame:
    """P13."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(dtype))


def select_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = (),
                    fill_missing: bool = True) -> DataFrame:
    """P10: listed features that exist, in the listed order; absent ones are
    null columns (``fill_missing``) or skipped."""
    cols = [F.col(c) for c in keep]
    for f in features:
        if f in df.columns:
            cols.append(F.col(f).cast("double").alias(f))
        elif fill_missing:
            cols.append(F.lit(None).cast("double").alias(f))
    return df.select(*cols)


def filter_month(df: DataFrame, month: int | Column, month_col: str = "Month_num") -> DataFrame:
    """P11."""
    return df.where(F.col(month_col) == (month if isinstance(month, Column) else F.lit(month)))


def region_filter(df: DataFrame, state: str, district: str, state_col: str = "state",
                  district_col: str = "district") -> DataFrame:
    """Exact upper-case match; when nothing matches, literal substring
    match on both names (can hit several districts).  One pass: the
    fallback rows are kept only when the exact set is empty, decided by a
    scalar subquery (a global count; no single-partition window)."""
    s, d = state.upper(), district.upper()
    su, du = F.upper(F.col(state_col).cast("string")), F.upper(F.col(district_col).cast("string"))
    exact = (su == F.lit(s)) & (du == F.lit(d))
    loose = su.contains(F.lit(s)) & du.contains(F.lit(d))
    n_exact = df.where(exact).select(F.count(F.lit(1))).scalar()   # scalar subquery
    return df.where(exact | ((n_exact == 0) & loose))


def union_by_name(dfs: Sequence[DataFrame]) -> DataFrame:
    """Concat by column name; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def dedupe(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Exact-row dedupe (partial aggregation collapses copies map-side)."""
    return df.dropDuplicates(list(subset)) if subset else df.dropDuplicates()


def duplicate_groups(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Every member of a duplicated group (left-semi join on the groups
    with count > 1).  Callers add ``limit`` for a preview."""
    cols = list(cols or df.columns)
    dup = df.groupBy(*cols).count().where(F.col("count") > 1).drop("count")
    return df.join(dup, [df[c].eqNullSafe(dup[c]) for c in cols], "left_semi")


def distinct_sorted(df: DataFrame, col: str, where: Column | None = None) -> DataFrame:
    """U4: sorted distinct non-null values (optionally of a filtered set)."""
    src = df.where(where) if where is not None else df
    return src.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)


def value_counts(df: DataFrame, col: str, out: str = "count") -> DataFrame:
    """A2: counts per value, null included, descending."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(out)).orderBy(F.desc(out), F.col(col))


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A4: one row, one column per input column with its null count."""
    cols = list(cols or df.columns)
    return df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in cols])


def null_counts_long(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A4 as (column, nulls) rows — one aggregation pass, then unpivot."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).cast("long").alias(f"n{i}")
                    for i, c in enumerate(cols)])
    stack = ", ".join(f"'{c}', n{i}" for i, c in enumerate(cols))
    return wide.selectExpr(f"stack({len(cols)}, {stack}) AS (column_name, null_count)")


def basic_checks(df: DataFrame) -> DataFrame:
    """Rows, columns, total nulls and duplicate rows (rows beyond the
    first copy); the distinct count is a scalar subquery."""
    cols = df.columns
    nulls = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in cols), F.lit(0))
    n_distinct = df.distinct().select(F.count(F.lit(1))).scalar()   # scalar subquery
    return df.agg(F.count(F.lit(1)).alias("n_rows"), nulls.alias("n_nulls")).select(
        F.col("n_rows").cast("long"), F.lit(len(cols)).cast("long").alias("n_columns"),
        F.col("n_nulls").cast("long"),
        (F.col("n_rows") - n_distinct).cast("long").alias("n_duplicates"))


def select_numeric(df: DataFrame) -> DataFrame:
    """Numeric columns only (schema metadata, no data pass)."""
    numeric = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
    return df.select(*[F.col(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, numeric)])
