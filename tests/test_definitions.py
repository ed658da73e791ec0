"""Definition tests on literal micro-fixtures (expected values from
pandas / NumPy semantics, stated as literals)."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrapanel.functions import advice as A
from terrapanel.functions.calendar import (clean_text, log1p_clipped, month_add, month_name, month_num,
                                           parse_date, season_from_month, season_num)
from terrapanel.functions.scores import argmax_class, softmax, top_k_classes
from terrapanel.operators import evaluate as EV
from terrapanel.operators.latest import latest_non_null
from terrapanel.operators.lookup import (category_code, frequency_encode, season_calendar, season_lookup,
                                         varieties_dimension, varieties_lookup)
from terrapanel.operators.profile import adjusted_skewness, histogram
from terrapanel.operators.quantiles import grouped_quantiles, quantiles
from terrapanel.operators.windows import panel_lookback, tercile_class


def _panel(spark, values, state="S", district="D"):
    rows = [(state, district, 2020, 1, i + 1, i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "state string, district string, Year int, Month_num int, Day int, "
                                       "row_id long, moisture double")


@pytest.mark.parametrize("how", [{}, {"pieces": 1000, "samples": 1}])
def test_rolling_mean_skips_null(spark, how):
    df = _panel(spark, [1.0, None, 3.0])
    out = panel_lookback(df, "moisture", lags=(1,), means=(3,), **how)
    got = [r.rolling_3 for r in out.orderBy("row_id").collect()]
    assert got == [1.0, 1.0, 2.0]
    lags = [r.lag_1 for r in out.orderBy("row_id").collect()]
    assert lags == [None, 1.0, None]


@pytest.mark.parametrize("n,expected", [
    (5, ["Low", "Low", "Medium", "High", "High"]),
    (4, ["Low", "Medium", "High", "High"]),
    (3, ["Low", "Medium", "High"]),
])
def test_tercile_cut(spark, n, expected):
    df = _panel(spark, [float(i) for i in range(1, n + 1)])
    out = tercile_class(df, "moisture", ["row_id"])
    assert [r.moisture_class for r in out.orderBy("row_id").collect()] == expected


def test_tercile_matches_pandas_qcut(spark):
    rng = np.random.default_rng(7)
    vals = rng.integers(0, 5, size=101).astype(float)          # many ties
    pdf = pd.DataFrame({"v": vals})
    exp = pd.qcut(pdf["v"].rank(method="first"), q=3, labels=["Low", "Medium", "High"]).astype(str).tolist()
    df = _panel(spark, vals.tolist())
    got = [r.moisture_class for r in tercile_class(df, "moisture", ["row_id"]).orderBy("row_id").collect()]
    assert got == exp


def test_category_code(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",)], "d string")
    out = category_code(df, "d", "code")
    assert sorted((r.d, r.code) for r in out.collect() if r.d) == [("a", 0), ("b", 1)]
    assert [r.code for r in out.collect() if r.d is None] == [-1]


def test_percentile_linear(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,)], "v double")
    q = quantiles(df, "v", [0.25, 0.5], ["p25", "p50"]).first()
    assert q.p25 == pytest.approx(1.75)
    assert q.p50 == pytest.approx(3.0)


def test_grouped_quantiles_vs_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(x)) for g in "abc" for x in rng.normal(size=37 if g != "b" else 1)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.p10, r.p90, r.n) for r in grouped_quantiles(df, ["g"], "v", [0.1, 0.9], ["p10", "p90"]).collect()}
    for g in "abc":
        vals = np.array([v for k, v in rows if k == g])
        assert got[g][0] == pytest.approx(np.percentile(vals, 10))
        assert got[g][1] == pytest.approx(np.percentile(vals, 90))
        assert got[g][2] == len(vals)


def test_month_add(spark):
    df = spark.createDataFrame([(11, 0), (11, 1), (11, 2)], "m int, i int")
    assert [r.x for r in df.select(month_add("m", "i").alias("x")).collect()] == [11, 12, 1]


def test_strict_date_and_month_parts(spark):
    df = spark.createDataFrame([("2020/01/06",), ("06/01/2020",), ("junk",)], "d string")
    out = df.select(parse_date("d").alias("x")).collect()
    assert str(out[0].x) == "2020-01-06"
    assert out[1].x is None and out[2].x is None


def test_month_num_and_name(spark):
    df = spark.createDataFrame([("January", None), (" jan ", None), ("3", None), (None, "2020-07-04"),
                                ("nan", None)], "m string, d string")
    out = df.select(month_num("m", F.to_date("d")).alias("n"), month_name("m", month_num("m", F.to_date("d"))).alias("nm")).collect()
    assert [r.n for r in out] == [1, 1, 3, 7, None]
    assert out[3].nm == "JUL"


def test_season_codes(spark):
    df = spark.createDataFrame([("Winter",), ("post_monsoon",), ("Post-monsoon",), ("Unknown",), (None,)], "s string")
    assert [r.x for r in df.select(season_num("s").alias("x")).collect()] == [1, 4, 4, None, None]
    m = spark.createDataFrame([(m,) for m in range(1, 13)], "m int")
    assert [r.x for r in m.select(season_from_month("m").alias("x")).collect()] == [1, 1, 2, 2, 2, 3, 3, 3, 3, 4, 4, 1]


def test_season_lookup_unknown(spark):
    cal = season_calendar(spark)
    df = spark.createDataFrame([("goa", "FEB"), ("GOA", "JUN"), ("NOWHERE", "JAN"), (None, "JAN")], "state string, Month string")
    got = [r.Season for r in season_lookup(df, cal).collect()]
    assert sorted(got) == sorted(["Summer", "Monsoon", "Unknown", "Unknown"])


def test_clean_text_and_log1p(spark):
    df = spark.createDataFrame([(" x ", -2.0), ("NaN", 1.0), ("", None)], "t string, v double")
    out = df.select(clean_text("t").alias("t"), log1p_clipped("v").alias("l")).collect()
    assert [r.t for r in out] == ["X", None, None]
    assert out[0].l == 0.0 and out[1].l == pytest.approx(math.log(2)) and out[2].l is None


def test_abnormal_pct_mean_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (3.0, 2.0)], "p double, m double")
    assert [r.x for r in df.select(A.abnormal_pct("p", "m").alias("x")).collect()] == [None, None, 50.0]


def test_frequency_null_key(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",)], "k string")
    out = frequency_encode(df, "k", "f").collect()
    assert {r.k: r.f for r in out} == {"a": 1.0, None: None}


def test_skewness_matches_pandas(spark):
    vals = [1.0, 2.0, 2.0, 3.0, 10.0, 4.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    assert df.select(adjusted_skewness("v")).first()[0] == pytest.approx(pd.Series(vals).skew())


def test_histogram_matches_numpy(spark):
    vals = np.random.default_rng(1).gamma(2.0, size=500)
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    got = {r.bin: r.n for r in histogram(df, "v", bins=60).collect()}
    exp, _ = np.histogram(vals, bins=60)
    assert [got.get(i + 1, 0) for i in range(60)] == exp.tolist()


def test_latest_non_null(spark):
    rows = [("S", "D", 2019, 12, 31, 1, 5.0), ("S", "D", 2020, 1, 1, 2, 7.0), ("S", "D", 2020, 1, 2, 3, None)]
    df = spark.createDataFrame(rows, "state string, district string, Year int, Month_num int, Day int, row_id long, f double")
    r = latest_non_null(df, ["state", "district"], ["f"]).first()
    assert r.max_year == 2020 and r.f == 7.0


def test_majority_vote_ties_smallest(spark):
    df = spark.createDataFrame([("b", "a", "c"), ("b", "b", "a"), (None, "z", None)], "x string, y string, z string")
    assert [r.v for r in df.select(EV.majority_vote(["x", "y", "z"]).alias("v")).collect()] == ["a", "b", "z"]


def test_scores(spark):
    df = spark.createDataFrame([([1.0, 3.0, 2.0, 3.0],)], "s array<double>")
    p = df.select(softmax("s").alias("p")).first().p
    assert sum(p) == pytest.approx(1.0)
    best = df.select(argmax_class(softmax("s")).alias("b")).first().b
    assert best.label == "1"
    top = df.select(top_k_classes(softmax("s"), 3).alias("t")).first().t
    assert [t.label for t in top] == ["1", "3", "2"]


def test_classification_report(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "y string, p string")
    rep = {r.label: r for r in EV.classification_report(df, "y", "p").collect()}
    assert rep["a"].precision == 1.0 and rep["a"].recall == 0.5
    assert rep["b"].precision == pytest.approx(1 / 3) and rep["b"].recall == 1.0
    assert rep["c"].precision == 0.0 and rep["c"].f1 == 0.0
    assert rep["accuracy"].f1 == 0.5 and rep["accuracy"].support == 4


def test_confusion_dense(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b")], "y string, p string")
    cm = {(r.truth, r.predicted): r["count"] for r in EV.confusion_matrix(df, "y", "p").collect()}
    assert cm == {("a", "a"): 1, ("a", "b"): 1, ("b", "a"): 0, ("b", "b"): 0}
    acc = {r.truth: r.class_accuracy for r in EV.per_class_accuracy(EV.confusion_matrix(df, "y", "p")).collect()}
    assert acc == {"a": 0.5, "b": 0.0}


def test_varieties_default_and_squash(spark):
    dim = varieties_dimension(spark)
    df = spark.createDataFrame([("GUJARAT",), ("TAMILNADU",), ("MARS",)], "state string")
    exact = {r.state: r.varieties for r in varieties_lookup(df, dim).collect()}
    assert exact["GUJARAT"][0] == "Pearl millet (bajra) hybrids"
    assert len(exact["TAMILNADU"]) == 3 and len(exact["MARS"]) == 3
    squashed = {r.state: r.varieties for r in varieties_lookup(df, dim, squash_spaces=True).collect()}
    assert squashed["TAMILNADU"] == ["Finger millet (ragi) varieties"]


def test_advice_rules(spark):
    df = spark.createDataFrame([(3.0, 4.0, 5.0, 6.0, 1.0), (9.0, None, None, 10.0, 5.0)],
                               "p double, p10 double, p25 double, mean double, std double")
    out = df.select(A.stress_level("p", "p10", "p25", "mean").alias("s"),
                    A.uncertainty_flag("std", "mean").alias("u"),
                    A.volatility("std", "mean").alias("v"), A.moisture_group("p").alias("g")).collect()
    assert out[0].s == "Severe" and out[1].s == "None"
    assert out[0].u == "" and out[1].u == " (high uncertainty)"
    assert out[0].v == pytest.approx(1 / 6) and out[1].v == pytest.approx(0.5)
    assert out[0].g == "very_low" and out[1].g == "moderate_high"
    label, text = A.crop_suggestion(F.lit("very_low"), F.array(F.lit("A"), F.lit("B"), F.lit("C")))
    r = df.select(label.alias("l"), text.alias("t")).first()
    assert r.l == "Drought-tolerant millets"
    assert r.t == "A, B — recommended in very low soil moisture conditions."


def test_summary_text(spark):
    df = spark.createDataFrame([(6.126, -12.4)], "p double, a double")
    s = df.select(A.summary_text("p", F.lit("LOW"), "a", F.lit("None"), F.lit("X"), F.lit("Y."),
                                 F.lit("")).alias("s")).first().s
    assert s == ("Predicted moisture: 6.13 • Category: LOW • 12% below normal • "
                 "No severe water stress predicted • X: Y.")


@pytest.mark.parametrize("how", [{}, {"pieces": 1000, "samples": 1}])
def test_null_key_rows_get_null_features(spark, how):
    rows = [("S", "D", 2020, 1, 1, 1, 1.0), ("S", "D", 2020, 1, 2, 2, 3.0),
            (None, "D", 2020, 1, 3, 3, 5.0), ("S", None, 2020, 1, 4, 4, 7.0), ("", "D", 2020, 1, 5, 5, 9.0)]
    df = spark.createDataFrame(rows, "state string, district string, Year int, Month_num int, Day int, "
                                     "row_id long, moisture double")
    out = {r.row_id: (r.lag_1, r.rolling_3) for r in
           panel_lookback(df, "moisture", lags=(1,), means=(3,), **how).collect()}
    assert out[1] == (None, 1.0) and out[2] == (1.0, 2.0)
    assert out[3] == (None, None) and out[4] == (None, None)
    assert out[5] == (None, 9.0)        # the empty-string state is a real key, not a null
