"""Minimum slice: rank districts inside each state by latest smoothed moisture.

readings → lag_1 / rolling_3 (skew-safe panel window) → latest non-null value
in each district's most recent year (A16) → rank inside the state (W7).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.operators.latest import latest_non_null
from terrapanel.operators.windows import panel_lookback, rank_within


def latest_smoothed_rank(readings: DataFrame, value: str = "moisture") -> DataFrame:
    feats = panel_lookback(readings.select("state", "district", "Year", "Month_num", "Day",
                                           "row_id", value),
                           value, lags=(1,), means=(3,))
    latest = latest_non_null(feats, ["state", "district"], ["lag_1", "rolling_3"])
    ranked = rank_within(latest, ["state"], "rolling_3", ["district"], out="district_rank")
    return ranked.select(
        "state", "district", F.col("max_year").cast("long").alias("max_year"),
        F.round(F.col("lag_1") + F.lit(1e-9), 4).alias("latest_lag_1"),
        F.round(F.col("rolling_3") + F.lit(1e-9), 4).alias("latest_rolling_3"),
        F.col("district_rank").cast("long").alias("district_rank"))
