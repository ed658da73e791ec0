"""Q6–Q10: batch "predict & analyze" for every (state, district, month).

The interactive app answered one district per click and looped over every
district of a state to rank them (one table scan per district).  Here each
answer is one batch job over all districts and all months; a single request
is a filter on the result.

* priors (A16) — one aggregation over the feature table;
* scoring grid (J8/M3) — priors × months by ``explode(sequence)``, no join;
* predictors (M9) — each adds one column; ``ensemble`` (M10) averages the
  valid ones when more than one is valid;
* ranking (W7), projection (M11), profile/heatmap (A1/A15/T3), farmer
  summary (A13/A14/F9–F18/J4), year plots (P6/A1).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapanel import fixed_values as FV
from terrapanel.functions import advice as A
from terrapanel.functions.calendar import month_abbr_title, month_cos, month_sin, season_from_month
from terrapanel.operators.latest import latest_non_null
from terrapanel.operators.lookup import month_offsets_grid, varieties_lookup
from terrapanel.operators.profile import pivot_month_year
from terrapanel.operators.quantiles import grouped_quantiles
from terrapanel.operators.windows import rank_within

KEYS = ["state", "district"]


# ---------------------------------------------------------------- predictors

@dataclass
class Predictor:
    """A named model: ``apply(df)`` returns ``df`` plus a column ``name``."""
    name: str
    apply: Callable[[DataFrame], DataFrame]


def column_predictor(name: str, expr: Column) -> Predictor:
    """Closed-form model given as an expression of the feature row."""
    return Predictor(name, lambda df: df.withColumn(name, expr))


def lookup_predictor(name: str, table: DataFrame, keys: Sequence[str], value: str) -> Predictor:
    """Model learnt as a keyed table (e.g. the district's mean for a month)."""
    t = table.select(*keys, F.col(value).alias(name))
    return Predictor(name, lambda df: df.join(t, list(keys), "left"))


def seasonal_mean_predictor(readings: DataFrame, name: str = "Seasonal",
                            value: str = "moisture") -> Predictor:
    """Mean of the district's readings in the target month (all years)."""
    tbl = (readings.dropna(subset=KEYS + ["Month_num"]).groupBy(*KEYS, "Month_num")
                   .agg(F.avg(value).alias("_m")))
    return lookup_predictor(name, tbl, KEYS + ["Month_num"], "_m")


def ml_predictor(name: str, model, features: Sequence[str], prep: DataFrame | None = None) -> Predictor:
    """A fitted ``pyspark.ml`` regression model (M9); ``prep`` is the one-row
    imputer/scaler statistics from ``models.fit_preprocessing``."""
    from terrapanel.operators.models import apply_preprocessing, assemble

    stats = prep.first() if isinstance(prep, DataFrame) else prep

    def run(df: DataFrame) -> DataFrame:
        zcols = [f"_z_{c}" for c in features]
        if stats is not None:
            x = apply_preprocessing(df, features, stats, prefix="_z_")
        else:
            x = df.select("*", *[F.col(c).cast("double").alias(z) for c, z in zip(features, zcols)])
        fcol = model.getOrDefault("featuresCol")
        scored = model.copy().setPredictionCol(name).transform(assemble(x, zcols, out=fcol))
        return scored.drop(fcol, *zcols)
    return Predictor(name, run)


def check_predictor(df: DataFrame, p: Predictor) -> str | None:
    """M9: why a predictor cannot score ``df``, or None.  It is applied to the plan and
    analysed against the schema, nothing runs; its column must be there and a number."""
    try:
        out = p.apply(df)
        kind = out.schema[p.name].dataType if p.name in out.columns else None
    except Exception as e:                      # whatever a caller's model raises is its reason
        condition = e.getCondition() if isinstance(e, PySparkException) else None
        return condition or type(e).__name__
    if kind is None:
        return "no prediction column"
    return None if isinstance(kind, T.NumericType) else "prediction is not a number"


def predict_all(df: DataFrame, predictors: Sequence[Predictor], ensemble: str | None = "Ensemble") -> DataFrame:
    """M9 + M10: one column per model; the ensemble is the mean of the valid
    predictions when more than one is valid.  A model that cannot score the
    table is a column of nulls, and a row without a finite prediction is null;
    ``prediction_failures`` counts both."""
    for p in predictors:
        if check_predictor(df, p) is None:
            scored = p.apply(df)
            value = F.col(p.name).cast("double")
            df = scored.withColumn(p.name, F.when(F.abs(value) < float("inf"), value))    # NaN is greater
        else:
            df = df.withColumn(p.name, F.lit(None).cast("double"))
    if ensemble:
        vals = F.filter(F.array(*[F.col(p.name).cast("double") for p in predictors]),
                        lambda x: x.isNotNull())
        mean = F.aggregate(vals, F.lit(0.0), lambda a, x: a + x) / F.size(vals)
        df = df.withColumn(ensemble, F.when(F.size(vals) > 1, mean))
    return df


def prediction_failures(df: DataFrame, predictors: Sequence[Predictor]) -> DataFrame:
    """M9: (model, reason, n) — the rows that a model gives no prediction for: all, where it
    cannot score the table; else those without a value or with one that is not finite."""
    counts = [F.count(F.lit(1)).alias("_all")]
    reasons, scored = {}, df
    for i, p in enumerate(predictors):
        reasons[i] = check_predictor(df, p)
        if reasons[i] is None:
            scored = p.apply(scored)
            value = F.col(p.name).cast("double")
            counts += [F.count_if(value.isNull()).alias(f"_none{i}"),
                       F.count_if(~(F.abs(value) < float("inf"))).alias(f"_odd{i}")]
    found = scored.agg(*counts)
    parts = []
    for i, p in enumerate(predictors):
        if reasons[i] is not None:
            parts.append(F.struct(F.lit(p.name).alias("model"), F.lit(reasons[i]).alias("reason"), F.col("_all").alias("n")))
        else:
            parts += [F.struct(F.lit(p.name).alias("model"), F.lit("no value").alias("reason"), F.col(f"_none{i}").alias("n")),
                      F.struct(F.lit(p.name).alias("model"), F.lit("not finite").alias("reason"), F.col(f"_odd{i}").alias("n"))]
    return found.select(F.explode(F.array(*parts)).alias("r")).select("r.*").where("n > 0")


def primary_value(names: Sequence[str]) -> Column:
    """Mean of the valid predictions among ``names`` (one when only one is valid)."""
    vals = F.filter(F.array(*[F.col(n).cast("double") for n in names]), lambda x: x.isNotNull())
    return F.when(F.size(vals) > 0, F.aggregate(vals, F.lit(0.0), lambda a, x: a + x) / F.size(vals))


# ---------------------------------------------------------------- grid

def district_priors(features: DataFrame, prior_cols: Sequence[str] = FV.PRIOR_FEATURES) -> DataFrame:
    """A16 over the feature table, matched on the name columns (L8 intent)."""
    present = [c for c in prior_cols if c in features.columns]
    return latest_non_null(features, KEYS, present)


def feature_rows(priors: DataFrame, month_col: str = "Month_num",
                 season: DataFrame | None = None,
                 prior_cols: Sequence[str] = FV.PRIOR_FEATURES) -> DataFrame:
    """M3: month features + season number + priors (missing priors -> 0.0).
    With a season calendar (state, Month_num, Season_num) the state season is
    used (L16), otherwise the month-only rule (F6)."""
    out = priors.withColumn("month_sin", month_sin(month_col)).withColumn("month_cos", month_cos(month_col))
    if season is not None:
        out = out.join(season, ["state", month_col], "left")
    else:
        out = out.withColumn("Season_num", season_from_month(month_col))
    for c in prior_cols:
        out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in out.columns
                             else F.lit(0.0))
    return out.withColumn(month_col, F.col(month_col).cast("int"))


def scoring_grid(priors: DataFrame, months: Sequence[int] = range(1, 13)) -> DataFrame:
    """Every district × every requested month (generate, not a join)."""
    arr = F.array(*[F.lit(int(m)) for m in months])
    return feature_rows(priors.withColumn("Month_num", F.explode(arr)))


# ---------------------------------------------------------------- queries

def district_ranking(scored: DataFrame, model_names: Sequence[str]) -> DataFrame:
    """Rank of each district inside its state for each month, by the
    mean of the valid predictions (descending, nulls last)."""
    s = scored.withColumn("pred_moisture", primary_value(model_names))
    return rank_within(s, ["state", "Month_num"], "pred_moisture", ["district"], out="rank")


def projection(priors: DataFrame, predictors: Sequence[Predictor], horizon: int = 3,
               months: Sequence[int] = range(1, 13)) -> DataFrame:
    """For every start month, predictions for m, m+1, … with priors held."""
    start = priors.withColumn("start_month", F.explode(F.array(*[F.lit(int(m)) for m in months])))
    grid = month_offsets_grid(start, "start_month", horizon, out_offset="step", out_month="Month_num")
    rows = feature_rows(grid)
    out = predict_all(rows, predictors)
    return out.withColumn("month", month_abbr_title("Month_num"))


def month_profile(readings: DataFrame, value: str = "moisture") -> DataFrame:
    """Q8 profile: mean per district and calendar month, Jan..Dec order."""
    prof = (readings.dropna(subset=KEYS + ["Month_num"]).groupBy(*KEYS, "Month_num")
                    .agg(F.avg(value).alias("mean_moisture")))
    return prof.withColumn("Month", month_abbr_title("Month_num")).orderBy(*KEYS, "Month_num")


def heatmap(readings: DataFrame, years: Sequence[int], value: str = "moisture") -> DataFrame:
    """Q8 heatmap: Month × Year mean pivot, 12 rows per district."""
    return pivot_month_year(readings, KEYS, value, years)


def year_plot_data(readings: DataFrame, years: Sequence[int], value: str = "moisture") -> DataFrame:
    """Q10: mean per (district, year, month) for the chosen years (P6 prunes
    partitions when the table is partitioned by Year)."""
    sel = readings.where(F.col("Year").isin(list(years)))
    return (sel.dropna(subset=KEYS + ["Month_num"]).groupBy(*KEYS, "Year", "Month_num")
               .agg(F.avg(value).alias("mean_moisture"), F.count(F.lit(1)).alias("n_rows")))


def farmer_summary(scored: DataFrame, readings: DataFrame, varieties_dim: DataFrame,
                   pred_col: str, value: str = "moisture", automatic: bool = True,
                   low_pct: float = 25, high_pct: float = 75,
                   manual_low: float = FV.MANUAL_LOW_THRESHOLD,
                   manual_high: float = FV.MANUAL_HIGH_THRESHOLD,
                   approx: bool = False) -> DataFrame:
    """Q9: the whole farmer summary for every scored (state, district, month)."""
    # month mean / population std ride in the same grouped pass as the month
    # percentiles (all over the present values of the district-month)
    month_stats = grouped_quantiles(readings, KEYS + ["Month_num"], value,
                                    [0.10, 0.25, 0.50, 0.75, 0.90],
                                    ["p10", "p25", "p50", "p75", "p90"], approx=approx,
                                    extra_aggs=[F.avg("_v").alias("hist_mean"),
                                                F.stddev_pop("_v").alias("hist_std")]).drop("n")
    district_pcts = grouped_quantiles(readings, KEYS, value, [low_pct / 100.0, high_pct / 100.0],
                                      ["auto_low", "auto_high"], approx=approx).drop("n")
    s = (scored.join(month_stats, KEYS + ["Month_num"], "left")
               .join(district_pcts, KEYS, "left"))
    s = varieties_lookup(s, varieties_dim, "state", out="varieties")
    low_thr, high_thr = A.thresholds("auto_low", "auto_high", automatic, manual_low, manual_high)
    p = F.col(pred_col)
    s = (s.withColumn("low_thresh", low_thr).withColumn("high_thresh", high_thr)
          .withColumn("category", A.moisture_category(p, "p25", "p75", "low_thresh", "high_thresh"))
          .withColumn("above_below_pct", A.abnormal_pct(p, "hist_mean"))
          .withColumn("stress", A.stress_level(p, "p10", "p25", "hist_mean"))
          .withColumn("moisture_group", A.moisture_group(p)))
    label, text = A.crop_suggestion("moisture_group", "varieties")
    s = (s.withColumn("crop_suggestion", label).withColumn("crop_explanation", text)
          .withColumn("irrigation_advice", A.irrigation_advice("stress"))
          .withColumn("uncertainty", A.uncertainty_flag("hist_std", "hist_mean"))
          .withColumn("volatility", A.volatility("hist_std", "hist_mean"))
          .withColumn("volatility_label", A.volatility_label("volatility")))
    return s.withColumn("summary", A.summary_text(p, "category", "above_below_pct", "stress",
                                                  "crop_suggestion", "crop_explanation", "uncertainty"))
