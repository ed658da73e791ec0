"""Q4: the EDA profile as a set of small result tables (chart drawing is
not built; these are the tables behind the charts)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from terrapanel.operators.clean import basic_checks, select_numeric
from terrapanel.operators.profile import (box_stats, correlation_long, describe, histogram, mean_by,
                                          monthly_resample, sample_complete_rows)
from terrapanel.sources.files import write_table


def eda_profile(df: DataFrame, target: str = "moisture", season: str = "Season") -> dict[str, DataFrame]:
    num = select_numeric(df).columns
    out = {
        "checks": basic_checks(df),
        "describe": describe(df, target),
        "histogram": histogram(df, target, 60),
        "histogram_log1p": histogram(df, target, 60, log1p=True),
        "month_year_mean": mean_by(df, ["Month_num", "Year"], target),
        "state_mean": mean_by(df, ["state"], target).orderBy("mean_value"),
        "month_mean": mean_by(df, ["Month_num"], target),
        "correlation": correlation_long(df, num),
        "monthly_resample": monthly_resample(df, [], "reading_date", target)
        if "reading_date" in df.columns else None,
        "sample": sample_complete_rows(df, [c for c in ["Year", "Month_num", "Day", target] if c in df.columns]),
    }
    if season in df.columns:
        out["season_box"] = box_stats(df, season, target)
    return {k: v for k, v in out.items() if v is not None}


def save_group_summaries(df: DataFrame, path: str, target: str = "moisture") -> None:
    """State-mean and month-mean summary tables (small; one file each)."""
    write_table(mean_by(df, ["state"], target).coalesce(1), f"{path}/state_mean_summary",
                partition_by=None, fmt="csv")
    write_table(mean_by(df, ["Month_num"], target).coalesce(1), f"{path}/month_mean_summary",
                partition_by=None, fmt="csv")
