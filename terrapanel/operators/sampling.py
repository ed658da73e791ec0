"""Deterministic splits and samples per class.

The reference drew splits from the listing order and a random generator;
here every row gets a reproducible order key (a hash, or any SQL-expressible
key) and its 1-based position inside its class; rows whose class is null are a
class like any other.  Positions come from
``group_rank`` — the range-partitioned global rank minus the class's first
rank — so one huge class is still spread over many tasks (a
``row_number`` window per class would put it into one task).
Split sizes follow ``int(n·ratio)`` per class.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapanel import fixed_values as FV
from terrapanel.operators.lookup import small_side
from terrapanel.operators.windows import global_rank


def hash_key(id_col: str, seed: int = 42) -> Column:
    return F.xxhash64(F.col(id_col), F.lit(seed))


def group_rank(df: DataFrame, group: Sequence[str], order: Sequence, out: str = "pos") -> DataFrame:
    """1-based position of each row inside its group by ``order`` (unique); a
    null group value is a group.  The table of groups is broadcast after a
    count of its rows, so a large group is not moved into one partition."""
    group = list(group)
    ranked = global_rank(df, [*group, *order], out="_gr")
    first = small_side(ranked.groupBy(*[F.col(g).alias(f"_of_{g}") for g in group]).agg(
        F.min("_gr").alias("_g0"), F.count(F.lit(1)).alias("group_size")))
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    return (ranked.join(first, same, "inner")
                  .withColumn(out, F.col("_gr") - F.col("_g0") + 1)
                  .drop("_gr", "_g0", *[f"_of_{g}" for g in group]))


def split_by_ratios(df: DataFrame, label: str, order: Sequence, ratios: Sequence[float],
                    names: Sequence[str], out: str = "split") -> DataFrame:
    """Per class the first int(n·r1) rows go to names[0], the next
    int(n·r2) to names[1], …, the rest to the last name.  Ratios must sum to 1."""
    if abs(sum(ratios) - 1.0) > 1e-9:
        raise ValueError("split ratios must sum to 1")
    if len(names) != len(ratios):
        raise ValueError("one name per ratio")
    ranked = group_rank(df, [label], order, out="_pos")
    n = F.col("group_size")
    expr = None
    cum = F.lit(0)
    for r, name in zip(ratios[:-1], names[:-1]):
        cum = cum + F.floor(n * F.lit(float(r))).cast("long")
        cond = F.col("_pos") <= cum
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    expr = expr.otherwise(F.lit(names[-1])) if expr is not None else F.lit(names[-1])
    return ranked.withColumn(out, expr).drop("_pos", "group_size")


def stratified_split(df: DataFrame, label: str, order: Sequence, train_ratio: float = 0.8) -> DataFrame:
    """Train / test by class."""
    return split_by_ratios(df, label, order, [train_ratio, 1 - train_ratio], ["train", "test"])


def split_70_10_20(df: DataFrame, label: str, order: Sequence) -> DataFrame:
    """M15."""
    return split_by_ratios(df, label, order, [0.7, 0.1, 0.2], ["train", "val", "test"])


def sample_per_class(df: DataFrame, label: str, order: Sequence, k: int) -> DataFrame:
    """The first k rows of each class in the order (a hash gives a
    repeatable random sample); a null class is a class.  The cap is the feature
    itself: a window limited to k rows keeps k rows per class in each task
    before anything is shuffled."""
    w = Window.partitionBy(label).orderBy(*order)
    return df.withColumn("_pos", F.row_number().over(w)).where(F.col("_pos") <= k).drop("_pos")


def exclude_class(df: DataFrame, label: str, value) -> DataFrame:
    """P14."""
    return df.where(F.col(label).isNull() | (F.col(label) != F.lit(value)))


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """Count per class (descending), imbalance ratio max/min and
    class weight 1/(count+eps); the ratio uses scalar subqueries."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).cast("long").alias("count"))
    mx = c.select(F.max("count")).scalar()
    mn = c.select(F.min("count")).scalar()
    return (c.withColumn("class_weight", 1.0 / (F.col("count") + F.lit(FV.CLASS_WEIGHT_EPS)))
             .withColumn("imbalance_ratio", mx / mn)
             .orderBy(F.desc("count"), F.col(label)))


def split_counts(split_df: DataFrame, label: str, split_col: str = "split",
                 splits: Sequence[str] = ("train", "val", "test"), total_label: str = "ALL") -> DataFrame:
    """Per class Total/Train/Val/Test plus a grand-total row (rollup); the
    row of the null class keeps a null label."""
    piv = split_df.rollup(label).agg(F.grouping(label).alias("_all"),
                                     *[F.count_if(F.col(split_col) == F.lit(s)).alias(s) for s in splits])
    total = sum((F.col(s) for s in splits), F.lit(0))
    return piv.select(F.when(F.col("_all") == 1, F.lit(total_label)).otherwise(F.col(label).cast("string")).alias(label),
                      total.cast("long").alias("Total"),
                      *[F.col(s).cast("long").alias(s.capitalize()) for s in splits])
