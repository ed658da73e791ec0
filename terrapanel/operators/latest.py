"""The latest non-null value of each feature in a group's most recent year.

First the latest year of each group (an aggregation of one integer, combined
before its shuffle; one row per group, broadcast after a count of its rows),
then only the rows of that year go through ``max_by``.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BIG = 2_147_483_647


def latest_non_null(df: DataFrame, group: Sequence[str], features: Sequence[str],
                    year: str = "Year", within_year: Sequence[str] = ("Month_num", "Day"),
                    tiebreak: str = "row_id", suffix: str = "") -> DataFrame:
    """One row per group: ``max_year`` and the last non-null value of each feature
    (row order = within-year columns nulls last, then ``tiebreak``)."""
    from terrapanel.operators.lookup import small_side

    years = small_side(df.where(F.col(year).isNotNull()).groupBy(*[F.col(c).alias(f"_of_{c}") for c in group])
                       .agg(F.max(year).alias("_latest")))
    same = F.col(year) == F.col("_latest")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    recent = df.join(years, same, "inner")
    order = F.struct(*[F.coalesce(F.col(c).cast("long"), F.lit(_BIG)).alias(f"o{i}")
                       for i, c in enumerate(within_year)],
                     F.col(tiebreak).alias("t"))
    aggs = [F.max(year).alias("max_year")]
    for f in features:
        aggs.append(F.max_by(f, F.when(F.col(f).isNotNull(), order)).alias(f"_lb_{f}"))
    agg = recent.groupBy(*group).agg(*aggs)
    return agg.select(*[F.col(c) for c in group], "max_year", *[F.col(f"_lb_{f}").alias(f + suffix) for f in features])
