"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the driver tables (or data Spark derives from them) in full;
none is limited to a subset of ids or rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrapanel.plans.ranking import latest_smoothed_rank
from terrapanel.sources.tables import readings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Output formatting for cross-engine comparison: engines disagree on exact
# half-way cases of round() (decimal vs binary half-up) and on the sign of
# zero; a 1e-9 nudge before rounding to 4 places gives one answer in both.
ROUND_NUDGE = 1e-9


def r4(c, name: str | None = None):
    from pyspark.sql import functions as F

    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col + F.lit(ROUND_NUDGE), 4)
    return out.alias(name or (c if isinstance(c, str) else "value"))


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


@register("rank_latest_smoothed")
def q_rank_latest_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_smoothed_rank(readings(spark, sf_dir))


# ---------------------------------------------------------------- Q1–Q3
from pyspark.sql import functions as F  # noqa: E402

from terrapanel import fixed_values as FV  # noqa: E402

from terrapanel.operators.clean import basic_checks, duplicate_groups, null_counts_long  # noqa: E402
from terrapanel.operators.lookup import season_calendar  # noqa: E402
from terrapanel.operators.windows import panel_lookback  # noqa: E402
from terrapanel.plans.features import clean_merge, ml_ready, season_summary, tag_seasons  # noqa: E402
from terrapanel.sources.tables import events_panel  # noqa: E402

# Season calendar for the driver binding (states = region names).  A query
# parameter, passed in as data like any calendar; EUROPE lacks NOV on
# purpose so that the Unknown branch is exercised.
BINDING_CALENDAR = {
    "AFRICA": {"Winter": ["DEC", "JAN", "FEB"], "Summer": ["MAR", "APR", "MAY"],
               "Monsoon": ["JUN", "JUL", "AUG", "SEP"], "Post-monsoon": ["OCT", "NOV"]},
    "AMERICA": {"Winter": ["JAN", "FEB"], "Summer": ["MAR", "APR", "MAY"],
                "Monsoon": ["JUN", "JUL", "AUG", "SEP"], "Post-monsoon": ["OCT", "NOV", "DEC"]},
    "ASIA": {"Winter": ["DEC", "JAN", "FEB"], "Summer": ["MAR", "APR"],
             "Monsoon": ["MAY", "JUN", "JUL", "AUG", "SEP", "OCT"], "Post-monsoon": ["NOV"]},
    "EUROPE": {"Winter": ["DEC", "JAN"], "Summer": ["FEB", "MAR", "APR"],
               "Monsoon": ["MAY", "JUN", "JUL", "AUG", "SEP"], "Post-monsoon": ["OCT"]},
    "MIDDLE EAST": {"Winter": ["NOV", "DEC", "JAN", "FEB"], "Summer": ["MAR", "APR", "MAY"],
                    "Monsoon": ["JUN", "JUL", "AUG", "SEP"], "Post-monsoon": ["OCT"]},
}
NULL_BELOW = 0.1   # readings under this level are treated as missing sensor values


def readings_with_gaps(spark, sf_dir):
    """readings with missing values (level < NULL_BELOW) — the null fixture."""
    r = readings(spark, sf_dir)
    return r.withColumn("moisture", F.when(F.col("moisture") >= NULL_BELOW, F.col("moisture")))


def tagged_readings(spark, sf_dir):
    return tag_seasons(readings(spark, sf_dir), season_calendar(spark, BINDING_CALENDAR))


@register("clean_merge_readings")
def q_clean_merge(spark, sf_dir):
    r = readings_with_gaps(spark, sf_dir)
    merged = clean_merge([r, r], null_policy="any")      # a file and its byte-identical copy
    return merged.select("state", "district", F.col("reading_date").cast("string").alias("reading_date"),
                         "Year", "Month_num", "Day", r4("moisture"), "row_id")


@register("data_checks")
def q_data_checks(spark, sf_dir):
    r = readings_with_gaps(spark, sf_dir)
    return basic_checks(r.unionByName(r))


@register("null_counts")
def q_null_counts(spark, sf_dir):
    return null_counts_long(readings_with_gaps(spark, sf_dir))


@register("duplicate_members")
def q_duplicate_members(spark, sf_dir):
    """Members of duplicated groups over (state, district, reading date)."""
    r = readings(spark, sf_dir).select("state", "district", "reading_date")
    d = duplicate_groups(r)
    return d.groupBy("state", "district").agg(F.count(F.lit(1)).cast("long").alias("dup_rows"))


@register("season_counts")
def q_season_counts(spark, sf_dir):
    return season_summary(tagged_readings(spark, sf_dir))


FEATURE_OUT = ["lag_1", "lag_7", "rolling_3", "rolling_6", "state_freq", "month_sin",
               "month_cos", "target_log1p"]


@register("features_panel")
def q_features_panel(spark, sf_dir):
    f = ml_ready(tagged_readings(spark, sf_dir))
    return f.select("state", "district", "row_id", "Month_num", "Month_name", "Season",
                    "Season_up", "Season_num", "district_id", "moisture_class",
                    *[r4(c) for c in FEATURE_OUT])


@register("events_lookback")
def q_events_lookback(spark, sf_dir):
    ev = events_panel(spark, sf_dir)
    out = panel_lookback(ev, "moisture", exclude_current=True)
    return out.select(F.col("state").alias("event_type"), F.col("district").alias("user_id"),
                      F.col("row_id").alias("event_id"),
                      *[r4(c) for c in ["lag_1", "lag_7", "rolling_3", "rolling_6"]])


# ---------------------------------------------------------------- Q4 profile
from terrapanel.operators.profile import (box_stats, correlation_long, describe, histogram,  # noqa: E402
                                          mean_by, monthly_resample, sample_complete_rows)


@register("eda_describe")
def q_eda_describe(spark, sf_dir):
    d = describe(readings(spark, sf_dir), "moisture")
    return d.select("count", *[r4(c) for c in ["mean", "std", "min", "p25", "p50", "p75", "max", "skew"]])


@register("eda_histogram")
def q_eda_histogram(spark, sf_dir):
    h = histogram(readings(spark, sf_dir), "moisture", bins=60)
    return h.select("bin", "n", r4("bin_lo"), r4("bin_hi"))


@register("eda_histogram_log1p")
def q_eda_histogram_log1p(spark, sf_dir):
    h = histogram(readings(spark, sf_dir), "moisture", bins=60, log1p=True)
    return h.select("bin", "n", r4("bin_lo"), r4("bin_hi"))


@register("eda_month_year_mean")
def q_eda_month_year_mean(spark, sf_dir):
    return mean_by(readings(spark, sf_dir), ["Month_num", "Year"], "moisture").select(
        "Month_num", "Year", r4("mean_value"))


@register("eda_state_mean")
def q_eda_state_mean(spark, sf_dir):
    return mean_by(readings(spark, sf_dir), ["state"], "moisture").orderBy("mean_value").select(
        "state", r4("mean_value"))


@register("eda_month_mean")
def q_eda_month_mean(spark, sf_dir):
    return mean_by(readings(spark, sf_dir), ["Month_num"], "moisture").select("Month_num", r4("mean_value"))


LINEITEM_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("eda_correlation")
def q_eda_correlation(spark, sf_dir):
    from terrapanel.sources.tables import table
    c = correlation_long(table(spark, sf_dir, "lineitem"), LINEITEM_NUMERIC)
    return c.select("col_a", "col_b", r4("corr"))


@register("eda_monthly_resample")
def q_eda_monthly_resample(spark, sf_dir):
    m = monthly_resample(readings(spark, sf_dir), ["district"], "reading_date", "moisture")
    return m.select("district", F.col("month_start").cast("string").alias("month_start"), r4("mean_value"))


@register("eda_season_box")
def q_eda_season_box(spark, sf_dir):
    b = box_stats(tagged_readings(spark, sf_dir), "Season", "moisture")
    return b.select("Season", F.col("n").cast("long").alias("n"),
                    *[r4(c) for c in ["q1", "median", "q3", "iqr", "whisker_lo", "whisker_hi"]])


@register("eda_sample_rows")
def q_eda_sample_rows(spark, sf_dir):
    """T5: 2000 hash-chosen complete rows."""
    return sample_complete_rows(readings(spark, sf_dir), ["Year", "Month_num", "Day", "moisture"],
                                n=2000, seed=42, id_col="row_id").withColumn("moisture", r4("moisture"))


# ---------------------------------------------------------------- Q6–Q10 serving
from terrapanel.operators.lookup import varieties_dimension  # noqa: E402
from terrapanel.plans import serve as S  # noqa: E402

TRAIN_YEAR, TEST_YEAR = 1999, 2000          # year split of the driver binding
MODELS = ["Seasonal", "Persistence"]


def serving_inputs(spark, sf_dir):
    r = readings(spark, sf_dir)
    feats = ml_ready(tagged_readings(spark, sf_dir))       # the Q3 feature table
    priors = S.district_priors(feats)
    predictors = [S.seasonal_mean_predictor(r, "Seasonal"),
                  S.column_predictor("Persistence", F.col("rolling_3"))]
    return r, priors, predictors


def scored_grid(spark, sf_dir):
    r, priors, predictors = serving_inputs(spark, sf_dir)
    return r, S.predict_all(S.scoring_grid(priors), predictors)


@register("serve_priors")
def q_serve_priors(spark, sf_dir):
    _, priors, _ = serving_inputs(spark, sf_dir)
    return priors.select("state", "district", F.col("max_year").cast("long").alias("max_year"),
                         *[r4(c) for c in ["lag_1", "lag_7", "rolling_3", "rolling_6", "state_freq"]],
                         F.col("district_id").cast("long").alias("district_id"))


@register("serve_ranking")
def q_serve_ranking(spark, sf_dir):
    _, scored = scored_grid(spark, sf_dir)
    ranked = S.district_ranking(scored, MODELS)
    return ranked.select("state", "district", "Month_num", *[r4(c) for c in MODELS + ["Ensemble", "pred_moisture"]],
                         F.col("rank").cast("long").alias("rank"))


@register("serve_projection")
def q_serve_projection(spark, sf_dir):
    _, priors, predictors = serving_inputs(spark, sf_dir)
    pr = S.projection(priors, predictors, horizon=3)
    return pr.select("state", "district", "start_month", "step", "Month_num", "month",
                     *[r4(c) for c in MODELS + ["Ensemble"]])


@register("serve_profile")
def q_serve_profile(spark, sf_dir):
    return S.month_profile(readings(spark, sf_dir)).select(
        "state", "district", "Month_num", "Month", r4("mean_moisture"))


@register("serve_heatmap")
def q_serve_heatmap(spark, sf_dir):
    r = readings(spark, sf_dir)
    years = sorted(row.Year for row in r.where("Year is not null").select("Year").distinct().collect())   # one per column
    return S.heatmap(r, years).select("state", "district", "Month_num", *[r4(str(y)) for y in years])


@register("serve_year_plots")
def q_serve_year_plots(spark, sf_dir):
    y = S.year_plot_data(readings(spark, sf_dir), [TRAIN_YEAR, TEST_YEAR])
    return y.select("state", "district", "Year", "Month_num", r4("mean_moisture"),
                    F.col("n_rows").cast("long").alias("n_rows"))


@register("serve_farmer_summary")
def q_serve_farmer_summary(spark, sf_dir):
    r, scored = scored_grid(spark, sf_dir)
    scored = scored.withColumn("primary", S.primary_value(MODELS))
    fs = S.farmer_summary(scored, r, varieties_dimension(spark), "primary")
    return fs.select("state", "district", "Month_num",
                     *[r4(c) for c in ["primary", "hist_mean", "hist_std", "p10", "p25", "p50", "p75", "p90",
                                       "low_thresh", "high_thresh", "above_below_pct", "volatility"]],
                     "category", "stress", "moisture_group", "crop_suggestion", "crop_explanation",
                     "irrigation_advice", "uncertainty", "volatility_label", "summary")


# ---------------------------------------------------------------- evaluation
import uuid  # noqa: E402

from terrapanel.functions.advice import confidence_flag, moisture_group  # noqa: E402
from terrapanel.functions.scores import argmax_class, softmax, top_k_classes  # noqa: E402
from terrapanel.operators import evaluate as EV  # noqa: E402
from terrapanel.session import checkpoint_dir  # noqa: E402
from terrapanel.sources.metrics import compare_models, scan_metrics, write_metrics  # noqa: E402
from terrapanel.sources.tables import table  # noqa: E402

FORECASTS = ["Persistence", "Mean3", "Mean6"]


def forecasts(spark, sf_dir):
    """Closed-form forecasters of each reading from the readings before it:
    previous value, mean of the previous 3 and of the previous 6 rows."""
    r = readings(spark, sf_dir)
    f = panel_lookback(r, "moisture", lags=(1,), means=(3, 6), exclude_current=True,
                       lag_names=["Persistence"], mean_names=["Mean3", "Mean6"])
    long = f.select("state", "district", "Year", "Month_num", "row_id", "moisture", F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(m).alias("pred")) for m in FORECASTS])).alias("mp"))
    return f, long.select("*", "mp.*").drop("mp")


@register("eval_regression")
def q_eval_regression(spark, sf_dir):
    _, long = forecasts(spark, sf_dir)
    m = EV.regression_metrics(long.where(F.col("Year") == TEST_YEAR), "moisture", "pred", ["model"])
    return m.select("model", "n", r4("MAE"), r4("RMSE"), r4("R2"))


@register("eval_metrics_roundtrip")
def q_eval_metrics_roundtrip(spark, sf_dir):
    """S7 → S8 → E6: metrics per (year, model) written as one JSON document per
    year, read back, flattened, deduplicated and sorted by RMSE."""
    _, long = forecasts(spark, sf_dir)
    m = EV.regression_metrics(long, "moisture", "pred", ["Year", "model"])
    m = m.withColumn("source", F.concat(F.lit("regression_results_"), F.col("Year").cast("string"), F.lit(".json")))
    path = f"{checkpoint_dir(spark).rstrip('/')}/metrics-{uuid.uuid4().hex}"
    write_metrics(m, path, "source")
    back = compare_models(scan_metrics(spark, path, source_col="source"))
    return back.select("source_file", "model", r4("MAE"), r4("RMSE"), r4("R2"))


def voted_groups(spark, sf_dir):
    """Three rule classifiers of the moisture group and their majority vote."""
    r = readings(spark, sf_dir)
    f, _ = forecasts(spark, sf_dir)
    seasonal = S.seasonal_mean_predictor(r, "Seasonal")
    g = seasonal.apply(f)
    return (g.withColumn("truth", moisture_group("moisture"))
             .withColumn("by_last", moisture_group("Persistence"))
             .withColumn("by_mean3", moisture_group("Mean3"))
             .withColumn("by_season", moisture_group("Seasonal"))
             .withColumn("vote", EV.majority_vote(["by_last", "by_mean3", "by_season"])))


@register("eval_vote_report")
def q_eval_vote_report(spark, sf_dir):
    rep = EV.classification_report(voted_groups(spark, sf_dir), "truth", "vote")
    return rep.select("label", r4("precision"), r4("recall"), r4("f1"), "support")


@register("eval_vote_confusion")
def q_eval_vote_confusion(spark, sf_dir):
    return EV.confusion_matrix(voted_groups(spark, sf_dir), "truth", "vote")


@register("eval_vote_class_accuracy")
def q_eval_vote_class_accuracy(spark, sf_dir):
    cm = EV.confusion_matrix(voted_groups(spark, sf_dir), "truth", "vote")
    return EV.per_class_accuracy(cm).select("truth", "n", r4("class_accuracy"))


@register("eval_labels_by_lang")
def q_eval_labels_by_lang(spark, sf_dir):
    """J9 + E3: predictions (toxic) aligned with truth (quality) by document id,
    accuracy per language."""
    lab = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    j = lab.join(docs, "doc_id", "inner")
    return EV.accuracy(j, "quality", "toxic", ["lang"]).select("lang", "n", r4("accuracy_pct"))


@register("eval_labels_report")
def q_eval_labels_report(spark, sf_dir):
    rep = EV.classification_report(table(spark, sf_dir, "labels"), "quality", "toxic")
    return rep.select("label", r4("precision"), r4("recall"), r4("f1"), "support")


# ---------------------------------------------------------------- Q12 score vectors
#: Three heads of ten class scores; each sums all 64 elements, dealt to the classes in its own way.
HEADS = {"head_a": lambda i: i % 10, "head_b": lambda i: i // 7, "head_c": lambda i: (7 * i + 3) % 10}


def class_scores(deal):
    """Ten sums over the whole embedding; element i counts for class ``deal(i)``."""
    return F.array(*[sum((F.col("embedding")[i].cast("double") for i in range(64) if deal(i) == c), F.lit(0.0)) for c in range(10)])


def scored_heads(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    out = e.select("vec_id", "label", *[class_scores(deal).alias(h) for h, deal in HEADS.items()])     # summed once a row
    out = out.select("vec_id", "label", *[softmax(F.col(h)).alias(h) for h in HEADS])
    for h in HEADS:
        out = out.withColumn(f"{h}_best", argmax_class(h))
    return out


@register("scores_topk")
def q_scores_topk(spark, sf_dir):
    s = scored_heads(spark, sf_dir)
    top = top_k_classes("head_a", 3)
    return s.select(
        "vec_id", F.col("label").cast("string").alias("truth"),
        F.col("head_a_best.label").alias("pred_label"),
        r4(F.col("head_a_best.confidence_pct"), "confidence_pct"),
        confidence_flag("head_a_best.confidence_pct", 50.0).alias("confidence_flag"),
        F.concat_ws(",", F.transform(top, lambda x: x["label"])).alias("top3"),
        EV.topk_hit(F.transform(top, lambda x: x["label"]), F.col("label").cast("string")).alias("top3_hit"))


@register("scores_model_summary")
def q_scores_model_summary(spark, sf_dir):
    """E3 + E8 + M12: per head accuracy and cross-entropy loss, plus the
    majority vote of the three heads."""
    s = scored_heads(spark, sf_dir)
    truth = F.col("label").cast("string")
    parts = []
    for h in HEADS:
        p_true = F.element_at(F.col(h), F.col("label") + 1)
        parts.append(s.select(F.lit(h).alias("model"),
                              (F.col(f"{h}_best.label") == truth).cast("double").alias("hit"),
                              (-F.log(p_true)).alias("loss")))
    votes = s.select("label", *[F.col(f"{h}_best.label").alias(f"v_{h}") for h in HEADS])
    voted = votes.select(F.lit("vote").alias("model"),
                         (EV.majority_vote([f"v_{h}" for h in HEADS]) == truth).cast("double").alias("hit"),
                         F.lit(None).cast("double").alias("loss"))
    allm = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(voted)
    agg = allm.groupBy("model").agg(F.avg("hit").alias("acc"), F.avg("loss").alias("loss"))
    return agg.select("model", F.round(F.col("acc") + F.lit(1e-9), 3).alias("test_accuracy"),
                      r4("loss", "test_loss"))


# ---------------------------------------------------------------- Q11 collection audit and splits
from terrapanel.operators import sampling as SP  # noqa: E402

def split_order():
    """SQL-expressible deterministic order of the items inside a class."""
    return [F.pmod(F.col("doc_id") * 7919, F.lit(10007)), F.col("doc_id")]


def listing(spark, sf_dir):
    """The item listing: id, class label (language), size."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("label"), "n_chars")


@register("images_class_counts")
def q_images_class_counts(spark, sf_dir):
    c = SP.class_counts(listing(spark, sf_dir), "label")
    return c.select("label", "count", F.col("class_weight"), r4("imbalance_ratio"))


@register("images_split_counts")
def q_images_split_counts(spark, sf_dir):
    sp = SP.split_70_10_20(listing(spark, sf_dir), "label", split_order())
    return SP.split_counts(sp, "label")


@register("images_split_excluding")
def q_images_split_excluding(spark, sf_dir):
    sp = SP.split_70_10_20(SP.exclude_class(listing(spark, sf_dir), "label", "de"), "label", split_order())
    return SP.split_counts(sp, "label")


@register("images_stratified_split")
def q_images_stratified_split(spark, sf_dir):
    sp = SP.stratified_split(listing(spark, sf_dir), "label", split_order(), 0.8)
    return sp.select("doc_id", "label", "split")


@register("images_sample_per_class")
def q_images_sample_per_class(spark, sf_dir):
    s = SP.sample_per_class(listing(spark, sf_dir), "label", split_order(), 5)
    return s.select("doc_id", "label")


# ---------------------------------------------------------------- Q5 models
from terrapanel.operators.boosting import DepthwiseBooster, LeafwiseBooster  # noqa: E402
from terrapanel.operators.forests import GrownForest  # noqa: E402
from terrapanel.operators.linear import NormalLinear  # noqa: E402
from terrapanel.operators.models import assemble, fit_preprocessing  # noqa: E402
from terrapanel.plans import modeling as MD  # noqa: E402


def feature_table(spark, sf_dir):
    return ml_ready(tagged_readings(spark, sf_dir))


@register("model_prep_stats")
def q_model_prep_stats(spark, sf_dir):
    """M1/M2: exact train-year medians, and mean / population std of the
    imputed features (the scaler's statistics)."""
    train = feature_table(spark, sf_dir).where(F.col("Year") == TRAIN_YEAR)
    prep = fit_preprocessing(train, FV.FEATURES)
    long = prep.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"med_{f}").alias("median"),
                 F.col(f"mean_{f}").alias("mean"), F.col(f"std_{f}").alias("std")) for f in FV.FEATURES]))
        .alias("s")).select("s.*")
    return long.select("feature", r4("median"), r4("mean"), r4("std"))


def _model_query(name):
    def q(spark, sf_dir):
        """M4–M7 + E1 for one regressor at the reference configuration
        (rows-only check: a fitted model)."""
        feats = feature_table(spark, sf_dir)
        models, _, scored = MD.train_and_score(feats, TRAIN_YEAR, TEST_YEAR, key=f"{sf_dir}:features",
                                               only=[name])
        rep = MD.regression_report(scored, list(models))
        return rep.select("model", "n", r4("RMSE"), r4("MAE"), r4("R2"))
    return q


for _qname, _model in [("model_linear", "Linear"), ("model_random_forest", "RandomForest"),
                       ("model_gbt_a", "GBT_A"), ("model_gbt_b", "GBT_B")]:
    register(_qname)(_model_query(_model))


#: Features of few values for the boosted trees that SQL can follow; the third has missing values.
STEP_FEATURES = ["Month_num", "Season_num", "day_step", "district_id"]


def step_rows(spark, sf_dir):
    """Training rows of ``STEP_FEATURES`` and the target as ``label``."""
    rows = feature_table(spark, sf_dir).where(F.col("Year") == TRAIN_YEAR).where("moisture is not null")
    rows = rows.withColumn("day_step", F.when(F.col("Month_num") != 3, F.col("Day") % 7))
    return assemble(rows.select(*STEP_FEATURES, F.col("moisture").alias("label")), STEP_FEATURES)


def _leaf_rows(model, rows):
    """What a fitted booster predicts: rows and mean label by predicted value."""
    return model.transform(rows).groupBy(r4("prediction").alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"), (F.round(F.avg("label") + 1e-9, 4)).alias("mean_label"))


@register("model_depthwise_stump")
def q_model_depthwise_stump(spark, sf_dir):
    """M6 at one round and one level: the split by second-order gain, the side of
    the missing values and the Newton leaves."""
    rows = step_rows(spark, sf_dir)
    model = DepthwiseBooster(rounds=1, maxDepth=1, stepSize=0.3).fit(rows)
    (_, feature, threshold, missing_left), = model.splits()
    return _leaf_rows(model, rows).select(
        F.lit(STEP_FEATURES[feature]).alias("feature"), F.round(F.lit(threshold) + 1e-9, 4).alias("threshold"),
        F.lit(missing_left).alias("missing_left"), "prediction", "n", "mean_label")


@register("model_leafwise_tree")
def q_model_leafwise_tree(spark, sf_dir):
    """M7 at one round and three leaves: the second split is that of the leaf which gains more."""
    rows = step_rows(spark, sf_dir)
    model = LeafwiseBooster(rounds=1, maxDepth=0, maxLeaves=3, stepSize=0.3).fit(rows)
    second = [s for s in model.splits() if s[0] == 1][0]
    return _leaf_rows(model, rows).select(
        F.lit(STEP_FEATURES[second[1]]).alias("second_feature"), F.round(F.lit(second[2]) + 1e-9, 4).alias("second_threshold"),
        F.lit(second[3]).alias("missing_left"), "prediction", "n", "mean_label")


@register("model_linear_normal")
def q_model_linear_normal(spark, sf_dir):
    """M4: coefficients by normal equations; the third feature repeats the first and is left out."""
    rows = feature_table(spark, sf_dir).where(F.col("Year") == TRAIN_YEAR).where("moisture is not null")
    rows = rows.withColumn("again", F.col("Month_num") * 2 + 1)
    names = ["Month_num", "Day", "again"]
    model = NormalLinear().fit(assemble(rows.select(*names, F.col("moisture").alias("label")), names))
    terms = [*zip(names, model.getOrDefault("coefficients")), ("intercept", model.getOrDefault("intercept"))]
    scored = model.transform(assemble(rows.select(*names, F.col("moisture").alias("label")), names))
    error = scored.agg(F.sqrt(F.avg((F.col("label") - F.col("prediction")) ** 2)).alias("rmse"))
    return error.select(F.explode(F.array(*[F.struct(F.lit(n).alias("term"), F.round(F.lit(v) + 1e-9, 4).alias("value")) for n, v in terms],
                                          F.struct(F.lit("rmse").alias("term"), r4("rmse").alias("value")))).alias("t")).select("t.*")


@register("model_pure_tree")
def q_model_pure_tree(spark, sf_dir):
    """M5 with one tree over all rows: grown to its end, so every feature vector has its
    own mean.  Nodes of over 500 rows are split by histograms, the rest in their tasks."""
    rows = step_rows(spark, sf_dir)
    model = GrownForest(trees=1, bootstrap=False, finishRows=500).fit(rows)
    return model.transform(rows).groupBy(*STEP_FEATURES).agg(
        F.round(F.min("prediction") + 1e-9, 4).alias("prediction"), F.round(F.max("prediction") + 1e-9, 4).alias("same_prediction"),
        F.count(F.lit(1)).alias("n"))


@register("model_classifier_report")
def q_model_classifier_report(spark, sf_dir):
    """M8 + E2 (rows-only check: fitted model)."""
    rep = MD.classifier_report(feature_table(spark, sf_dir), TRAIN_YEAR, TEST_YEAR)
    return rep.select("label", r4("precision"), r4("recall"), r4("f1"), "support")


@register("model_ranking")
def q_model_ranking(spark, sf_dir):
    """Q6 with fitted boosted-tree models as the predictors (M9/M10/W7;
    rows-only check)."""
    feats = feature_table(spark, sf_dir)
    models, prep, _ = MD.train_and_score(feats, TRAIN_YEAR, TEST_YEAR, key=f"{sf_dir}:features",
                                         only=["GBT_A", "GBT_B"])
    priors = S.district_priors(feats)
    grid = S.scoring_grid(priors)
    preds = [S.ml_predictor(name, models[name], FV.FEATURES, prep) for name in ("GBT_A", "GBT_B")]
    scored = S.predict_all(grid, preds)
    ranked = S.district_ranking(scored, ["GBT_A", "GBT_B"])
    return ranked.select("state", "district", "Month_num", r4("GBT_A"), r4("GBT_B"), r4("Ensemble"),
                         F.col("rank").cast("long").alias("rank"))


# ---------------------------------------------------------------- more P/T/U operators
from terrapanel.operators.clean import distinct_sorted, region_filter, select_numeric  # noqa: E402
from terrapanel.plans.features import unknown_season_sample  # noqa: E402


@register("unknown_season_sample")
def q_unknown_season_sample(spark, sf_dir):
    """P12 + T4: the first 10 rows (panel order) whose season is Unknown."""
    s = unknown_season_sample(tagged_readings(spark, sf_dir), 10)
    return s.select("state", "district", "row_id", "Month", "Season")


@register("distinct_states")
def q_distinct_states(spark, sf_dir):
    """U4: sorted distinct states, and districts per state."""
    r = readings(spark, sf_dir)
    states = distinct_sorted(r, "state")
    per = r.groupBy("state").agg(F.count_distinct("district").cast("long").alias("n_districts"))
    return states.join(per, "state", "inner")


@register("region_month_stats")
def q_region_month_stats(spark, sf_dir):
    """P7 (+A14): exact state/district match, else substring match on both
    names — here 'asia' / 'nation' has no exact match, so every ASIA district
    whose name contains NATION is kept."""
    sel = region_filter(readings(spark, sf_dir), "asia", "nation")
    stats = sel.groupBy("state", "Month_num").agg(
        F.count(F.lit(1)).cast("long").alias("n"), F.avg("moisture").alias("hist_mean"),
        F.stddev_pop("moisture").alias("hist_std"))
    return stats.select("state", "Month_num", "n", r4("hist_mean"), r4("hist_std"))


@register("numeric_correlation")
def q_numeric_correlation(spark, sf_dir):
    """P9 + A10 over every numeric column of the reading panel."""
    r = readings(spark, sf_dir)
    c = correlation_long(r, select_numeric(r).columns)
    return c.select("col_a", "col_b", r4("corr"))


@register("panel_lookback_split")
def q_panel_lookback_split(spark, sf_dir):
    """W1–W4 with every panel cut into pieces of a few rows, whose halos come
    from the pieces before; must equal the plain window's result."""
    r = readings(spark, sf_dir)
    out = panel_lookback(r, "moisture", pieces=2000, samples=4)
    return out.select("state", "district", "row_id",
                      *[r4(c) for c in ["lag_1", "lag_7", "rolling_3", "rolling_6"]])


@register("panel_lookback_hot_day")
def q_panel_lookback_hot_day(spark, sf_dir):
    """W1–W4 where all rows are one panel and one day: cut by row id."""
    one = F.concat(F.lit("P"), F.col("Year") - F.col("Year"))          # a column, not a literal: the cuts are joined by key
    r = readings(spark, sf_dir).withColumns({"state": one, "district": one, "Year": F.lit(1999), "Month_num": F.lit(7), "Day": F.lit(1)})
    out = panel_lookback(r, "moisture")
    return out.select("row_id", *[r4(c) for c in ["lag_1", "lag_7", "rolling_3", "rolling_6"]])


# ---------------------------------------------------------------- sources, cleaning and orders, end to end

from terrapanel.functions.calendar import numeric_coerce, parse_date  # noqa: E402
from terrapanel.operators.clean import (add_column_if_missing, drop_null_target, filter_month,  # noqa: E402
                                        select_features)
from terrapanel.operators.windows import global_rank  # noqa: E402
from terrapanel.plans.features import ingest_files  # noqa: E402
from terrapanel.sources.files import load_table, write_table  # noqa: E402


def scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}/{uuid.uuid4().hex}"


@register("images_split_null_class")
def q_images_split_null_class(spark, sf_dir):
    """M15 + A19 where many items have no class: the label is missing for most documents."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("of"), F.col("quality").alias("label"))
    docs = table(spark, sf_dir, "documents").select("doc_id")
    items = docs.join(labels, F.col("doc_id") == F.col("of"), "left").select("doc_id", "label")
    return SP.split_counts(SP.split_70_10_20(items, "label", split_order()), "label")


@register("ingest_files_merged")
def q_ingest_files_merged(spark, sf_dir):
    """Q1 from files (S1, S2, S3, P1, P2, P4, U1, U2): the readings written as CSV in
    two layouts with other column orders and header spellings, and a copy."""
    r = readings(spark, sf_dir).where("reading_date is not null")
    root = scratch(spark, "csv")
    date = F.date_format("reading_date", "yyyy/MM/dd")
    first = r.select(date.alias("Date"), F.col("state").alias("State Name"), F.col("district").alias("DistrictName"),
                     F.col("moisture").cast("string").alias("Average Soilmoisture Level (at 15cm)"))
    other = r.select(F.date_format("reading_date", "yyyy-MM-dd").alias("date"),
                     F.col("moisture").cast("string").alias("average_soilmoisture_level_(at_15cm)"),
                     F.col("district").alias("district_name"), F.lower("state").alias("state_name"))
    for name, df in (("first", first), ("copy", first), ("other", other)):
        df.write.option("header", True).csv(f"{root}/{name}")
    merged = ingest_files(spark, root)
    return merged.select("state", "district", F.col("reading_date").cast("string").alias("reading_date"),
                         "Year", "Month", "Month_num", "Day", r4("moisture"))


@register("parsed_dates")
def q_parsed_dates(spark, sf_dir):
    """Dates written in known and unknown forms, numbers in good and bad text."""
    o = table(spark, sf_dir, "orders")
    d, form = F.to_date("o_orderdate"), F.col("o_orderkey") % 5
    text = (F.when(form == 0, F.date_format(d, "yyyy/MM/dd")).when(form == 1, F.date_format(d, "yyyy-MM-dd"))
             .when(form == 2, F.date_format(d, "dd/MM/yyyy")).when(form == 3, F.lit("no date")))
    number = F.when(form == 0, F.concat(F.col("o_totalprice").cast("string"), F.lit("x"))).otherwise(F.col("o_totalprice").cast("string"))
    parsed = o.select(form.cast("long").alias("form"), parse_date(text).alias("d"), numeric_coerce(number).alias("n"))
    return parsed.groupBy("form").agg(F.count(F.lit(1)).alias("n_rows"), F.count("d").alias("n_dates"),
                                      F.max("d").cast("string").alias("last_date"), F.count("n").alias("n_numbers"))


@register("july_features")
def q_july_features(spark, sf_dir):
    """Target present, one month, listed features in order with an absent one as null."""
    df = add_column_if_missing(drop_null_target(readings_with_gaps(spark, sf_dir), "moisture"), "volume", "double")
    out = select_features(filter_month(df, 7), ["moisture", "volume", "lag_1"], keep=["state", "row_id"])
    return out.select("state", "row_id", r4("moisture"), "volume", "lag_1")


@register("panel_positions")
def q_panel_positions(spark, sf_dir):
    """Every row's place in the panel order."""
    ordered = global_rank(readings(spark, sf_dir), ["state", "district", "Year", "Month_num", "Day", "row_id"], out="position")
    return ordered.select("position", "state", "district", "row_id")


@register("region_month_stats_exact")
def q_region_month_stats_exact(spark, sf_dir):
    """P7 with an exact match, whose name is also part of other names."""
    sel = region_filter(readings(spark, sf_dir), "america", "nation_1")
    return sel.groupBy("state", "district", "Month_num").agg(
        F.count(F.lit(1)).alias("n"), F.avg("moisture").alias("mean_moisture")).select(
        "state", "district", "Month_num", "n", r4("mean_moisture"))


@register("month_season_rows")
def q_month_season_rows(spark, sf_dir):
    """A feature row per district and month, with the season by month alone."""
    priors = readings(spark, sf_dir).groupBy("state", "district").agg(F.avg("moisture").alias("rolling_3"))
    rows = S.scoring_grid(priors)
    return rows.select("state", "district", "Month_num", "Season_num", r4("month_sin"), r4("month_cos"), r4("rolling_3"))


@register("stored_panel")
def q_stored_panel(spark, sf_dir):
    """The panel written by year, a second write that must not replace it, and read back."""
    path = scratch(spark, "stored")
    r = readings(spark, sf_dir)
    write_table(r, path, partition_by=["Year"], sort_within=["state", "district", "Month_num", "Day", "row_id"])
    write_table(r.where("Year < 0"), path, partition_by=["Year"], mode="ignore")
    back = load_table(spark, path)
    return back.groupBy("Year", "state").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("row_id").alias("sum_row_id"))


# ---------------------------------------------------------------- rejects, failing models, images, saved models, orders
from terrapanel.plans.eda import save_group_summaries  # noqa: E402
from terrapanel.operators.models import load_models, save_model  # noqa: E402
from terrapanel.sources.files import export_csv, rejected_dates, scan_readings, scan_rejects, standardize  # noqa: E402
from terrapanel.sources.images import scan_image_folder, score_images  # noqa: E402


def ragged_files(spark, sf_dir) -> str:
    """The readings as CSV lines of 60 columns, the measure in the 44th; by row id some
    have a cell too many, a quote that never closes, or end before the measure."""
    r = readings(spark, sf_dir).where("reading_date is not null")
    root = scratch(spark, "ragged")
    names = [f"c{i}" for i in range(60)]
    names[2], names[3], names[43], names[59] = "state name", "district name", "Average Soilmoisture Level (at 15cm)", "Date"
    cells = {2: F.col("state"), 3: F.concat(F.lit('"'), "district", F.lit(', \"\"D\"\""')), 43: F.col("moisture").cast("string"),
             59: F.date_format("reading_date", "yyyy-MM-dd")}
    kind = F.col("row_id") % 10
    line = F.concat_ws(",", *[cells.get(i, F.lit(str(i))) for i in range(60)])
    line = (F.when(kind == 1, F.concat(line, F.lit(",one more"))).when(kind == 2, F.concat(F.lit('"'), line))
             .when(kind == 3, F.concat_ws(",", *[cells.get(i, F.lit("")) for i in range(5)])).otherwise(line))
    body = r.select(line.alias("value"))

    def with_header(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"value": [",".join(names)]})
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"])

    body.mapInArrow(with_header, "value string").write.text(root, compression="none")
    return root


@register("ingest_rejects")
def q_ingest_rejects(spark, sf_dir):
    """Lines kept and rejected, by reason; no column is too far right and short lines keep what they have."""
    root = ragged_files(spark, sf_dir)
    rows = standardize(scan_readings(spark, root, glob="*.txt"))
    kept = rows.agg(F.count(F.lit(1)).alias("kept"), F.count("moisture").alias("with measure"),
                    F.count_if(F.col("district").contains(', "D"')).alias("quoted"))
    long = kept.select(F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("n")) for c in kept.columns])).alias("x")).select("x.*")
    return long.unionByName(scan_rejects(spark, root, glob="*.txt").groupBy(F.col("reason").alias("kind")).agg(F.count(F.lit(1)).alias("n")))


def failing_predictors(spark, sf_dir):
    """Two sound models, one that asks for a column which is not there, one that is not finite for some rows."""
    _, priors, predictors = serving_inputs(spark, sf_dir)
    odd = F.when(F.col("Month_num") % 4 == 0, F.lit(float("nan"))).when(F.col("Month_num") % 4 == 1, F.lit(float("inf"))).otherwise(F.col("rolling_3"))
    return S.scoring_grid(priors), [*predictors, S.column_predictor("Broken", F.col("no_such_feature") * 2), S.column_predictor("Odd", odd)]


@register("serve_failing_models")
def q_serve_failing_models(spark, sf_dir):
    """Null where a model has no finite prediction; the ensemble goes on with the others."""
    grid, predictors = failing_predictors(spark, sf_dir)
    return S.predict_all(grid, predictors).select("state", "district", "Month_num", *[r4(c) for c in [*MODELS, "Broken", "Odd", "Ensemble"]])


@register("serve_failure_counts")
def q_serve_failure_counts(spark, sf_dir):
    return S.prediction_failures(*failing_predictors(spark, sf_dir))


@register("images_scored")
def q_images_scored(spark, sf_dir):
    """Every embedding as a small raw image below its class folder (every tenth
    is cut off), listed, decoded, scored by a closed-form model and summed up by class."""
    e = table(spark, sf_dir, "embeddings")
    pixels = F.concat_ws(",", F.transform("embedding", lambda x: F.floor(x.cast("double") * 100).cast("string")))
    image = F.concat_ws(";", F.col("vec_id").cast("string"), F.when(F.col("vec_id") % 10 == 3, F.substring(pixels, 1, 9)).otherwise(pixels))
    root = scratch(spark, "images")
    e.select(image.alias("value"), F.col("label").alias("folder")).write.option("maxRecordsPerFile", 1).partitionBy("folder").text(root)
    images = scan_image_folder(spark, root, glob="*.txt", with_content=True)

    def decode(raw: bytes):
        values = [int(x) for x in raw.decode().strip().split(";")[1].split(",")]
        if len(values) != 64:
            raise ValueError("cut off")
        return values

    def predict(model, pdf):
        return [[float(sum(p[i] for i in range(64) if i % model == c)) for c in range(model)] for p in pdf["content"]]

    scored = score_images(images, lambda: 4, predict, "quarters", decode=decode, batch_bytes=2000)
    return scored.groupBy(F.regexp_replace("label", "folder=", "").alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.count("scores").alias("n_scored"),
        *[F.sum(F.col("scores")[c]).cast("long").alias(f"score_{c}") for c in range(4)])


@register("model_saved_scores")
def q_model_saved_scores(spark, sf_dir):
    """Models saved, loaded by folder and scored; sums by district."""
    rows = step_rows(spark, sf_dir)
    root = scratch(spark, "models")
    save_model(GrownForest(trees=1, bootstrap=False).fit(rows), f"{root}/tree")
    save_model(DepthwiseBooster(rounds=1, maxDepth=0, maxLeaves=1).fit(rows), f"{root}/mean")
    scored = rows
    for name, model in load_models(spark, root).items():
        scored = model.setPredictionCol(name).transform(scored)
    return scored.groupBy("district_id").agg(F.round(F.sum("tree") + 1e-9, 3).alias("tree"), F.round(F.avg("mean") + 1e-9, 4).alias("mean"))


@register("exported_ranking")
def q_exported_ranking(spark, sf_dir):
    """Month means as a sorted CSV export, read again; the place of each line in its file."""
    r = readings(spark, sf_dir)
    means = mean_by(r, ["state", "Month_num"], "moisture").select("state", "Month_num", r4("mean_value"))
    root = scratch(spark, "export")
    export_csv(means, f"{root}/means", order_by=["state", "Month_num"])
    lines = spark.read.option("header", True).csv(f"{root}/means")
    placed = lines.withColumn("place", F.monotonically_increasing_id() + 1)          # one file: the order of its lines
    return placed.select("state", F.col("Month_num").cast("int").alias("Month_num"), F.col("mean_value").cast("double").alias("mean_value"), "place")


@register("saved_summaries")
def q_saved_summaries(spark, sf_dir):
    """The state and month summaries as written, read again."""
    root = scratch(spark, "summaries")
    save_group_summaries(readings(spark, sf_dir), root)
    read = spark.read.option("header", True)
    parts = [read.csv(f"{root}/{name}_mean_summary").select(F.lit(name).alias("summary"), F.col(key).alias("key"),
                                                            F.col("mean_value").cast("double").alias("mean_value"))
             for name, key in (("state", "state"), ("month", "Month_num"))]
    return parts[0].unionByName(parts[1]).withColumn("mean_value", r4("mean_value"))


@register("profile_positions")
def q_profile_positions(spark, sf_dir):
    """The month profile in its order, as a rank from the sorted rows."""
    prof = S.month_profile(readings(spark, sf_dir))
    return global_rank(prof, ["state", "district", "Month_num"], out="place").select("state", "district", "Month", r4("mean_moisture"), "place")


@register("path_years")
def q_path_years(spark, sf_dir):
    """The year from the file's folder, where the date has another or none."""
    r = readings(spark, sf_dir).where("reading_date is not null")
    root = scratch(spark, "years")
    date = F.when(F.col("row_id") % 3 == 0, F.lit("no date")).otherwise(F.date_format("reading_date", "yyyy/MM/dd"))
    r.select(date.alias("date"), F.col("state"), F.col("district"), F.col("moisture").cast("string").alias("moisture level"),
             (F.col("Year") + 2).alias("folder")).write.partitionBy("folder").option("header", True).csv(f"{root}/raw")
    read = scan_readings(spark, f"{root}/raw").withColumn("source_file", F.regexp_replace("source_file", "folder=", ""))
    out = standardize(read, year_from_path=True)
    return out.groupBy("Year").agg(F.count(F.lit(1)).alias("n"), F.count("reading_date").alias("n_dates"), r4(F.sum("moisture"), "moisture"))


@register("serve_manual_thresholds")
def q_serve_manual_thresholds(spark, sf_dir):
    """F12 in manual mode: the farmer summary under the fixed thresholds."""
    r, scored = scored_grid(spark, sf_dir)
    fs = S.farmer_summary(scored.withColumn("primary", S.primary_value(MODELS)), r, varieties_dimension(spark), "primary", automatic=False)
    return fs.select("state", "district", "Month_num", r4("primary"), r4("low_thresh"), r4("high_thresh"), "category")
