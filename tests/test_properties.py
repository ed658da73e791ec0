"""Property tests: invariants that must hold for any input."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrapanel.operators import sampling as SP
from terrapanel.operators.clean import dedupe
from terrapanel.operators.windows import global_rank, panel_lookback, tercile_class
from terrapanel.plans.serve import column_predictor, predict_all

panel_rows = st.lists(
    st.tuples(st.sampled_from(["A", "B"]), st.sampled_from(["x", "y", "z"]),
              st.integers(2019, 2020), st.integers(1, 3), st.integers(1, 3),
              st.one_of(st.none(), st.floats(0, 20, allow_nan=False))),
    min_size=1, max_size=40)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=panel_rows, samples=st.integers(1, 4))
def test_cut_panels_equal_plain(spark, rows, samples):
    data = [(s, d, y, m, day, i, v) for i, (s, d, y, m, day, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "state string, district string, Year int, Month_num int, Day int, "
                                     "row_id long, moisture double")
    cols = ["lag_1", "lag_7", "rolling_3", "rolling_6"]
    plain = {r.row_id: tuple(r[c] for c in cols) for r in panel_lookback(df, "moisture").collect()}
    chunk = {r.row_id: tuple(r[c] for c in cols)
             for r in panel_lookback(df, "moisture", pieces=100, samples=samples).collect()}
    assert plain.keys() == chunk.keys()
    for k in plain:
        for a, b in zip(plain[k], chunk[k]):
            assert (a is None and b is None) or a == pytest.approx(b)


def test_rolling_window_one_is_value(spark):
    df = spark.createDataFrame([("S", "D", 2020, 1, d, d, float(d) * 1.5) for d in range(1, 9)],
                               "state string, district string, Year int, Month_num int, Day int, row_id long, moisture double")
    out = panel_lookback(df, "moisture", lags=(1,), means=(1,))
    assert all(r.rolling_1 == r.moisture for r in out.collect())


def test_tercile_sizes_balanced(spark):
    vals = np.random.default_rng(5).normal(size=301)
    df = spark.createDataFrame([(int(i), float(v)) for i, v in enumerate(vals)], "row_id long, moisture double")
    counts = {r.moisture_class: r["count"] for r in
              tercile_class(df, "moisture", ["row_id"]).groupBy("moisture_class").count().collect()}
    assert max(counts.values()) - min(counts.values()) <= 1


def test_global_rank_is_permutation(spark):
    df = spark.range(0, 997).withColumn("v", (F.col("id") * 7919) % 101)
    r = global_rank(df, ["v", "id"], out="rk", num_partitions=7)
    ranks = sorted(x.rk for x in r.select("rk").collect())
    assert ranks == list(range(1, 998))
    ordered = [x.id for x in r.orderBy("rk").collect()]
    expect = [x.id for x in df.orderBy("v", "id").collect()]
    assert ordered == expect


def test_split_counts_follow_int_ratio(spark):
    n_per = {"a": 37, "b": 10, "c": 1}
    rows = [(i, k) for k, n in n_per.items() for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, label string")
    out = SP.split_70_10_20(df, "label", [F.xxhash64("doc_id"), F.col("doc_id")])
    got = {(r.label, r.split): r["count"] for r in out.groupBy("label", "split").count().collect()}
    for k, n in n_per.items():
        tr, va = int(n * 0.7), int(n * 0.1)
        assert got.get((k, "train"), 0) == tr
        assert got.get((k, "val"), 0) == va
        assert got.get((k, "test"), 0) == n - tr - va
    # stable under repartitioning
    again = SP.split_70_10_20(df.repartition(5), "label", [F.xxhash64("doc_id"), F.col("doc_id")])
    a = sorted((r.doc_id, r.split) for r in out.collect())
    b = sorted((r.doc_id, r.split) for r in again.collect())
    assert a == b


def test_union_copy_dedupe_is_identity(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    once = dedupe(df)
    twice = dedupe(df.unionByName(df))
    assert sorted(once.collect()) == sorted(twice.collect())


def test_ensemble_between_min_and_max(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, None), (None, None)], "a double, b double")
    out = predict_all(df, [column_predictor("A", F.col("a")), column_predictor("B", F.col("b"))]).collect()
    assert out[0].Ensemble == 2.0
    assert out[1].Ensemble is None and out[2].Ensemble is None


@pytest.mark.parametrize("samples", [1, 3, 20])
@pytest.mark.parametrize("exclude", [False, True])
def test_cut_panels_equal_plain_on_driver_tables(spark, samples, exclude):
    from terrapanel.sources.tables import readings
    from sample_paths import SF_SMALL

    r = readings(spark, SF_SMALL)
    r = r.unionByName(r.where("row_id % 3 = 0"))               # exact duplicates
    cols = ["lag_1", "lag_7", "rolling_3", "rolling_6"]
    a, b = ({x.row_id: tuple(x[c] for c in cols) for x in panel_lookback(r, "moisture", dedupe=True, exclude_current=exclude, **how).collect()}
            for how in ({}, {"pieces": 5000, "samples": samples}))
    assert a.keys() == b.keys() and len(a) > 1000
    for k in a:
        for u, v in zip(a[k], b[k]):
            assert (u is None and v is None) or u == pytest.approx(v)


def test_one_panel_of_one_day_is_cut_by_row(spark):
    """The largest window partition holds a few pieces' share of the rows, and null keys are spread."""
    import pandas as pd
    from pyspark.sql import Window
    from terrapanel.operators.windows import _panel_cuts

    n = 4000
    rng = np.random.default_rng(1)
    v = [None if x < 0.1 else float(x) for x in rng.random(n)]
    rows = [("S" if i % 4 else None, "D", 2020, 1, 1, i, v[i]) for i in range(n)]
    df = spark.createDataFrame(rows, "state string, district string, Year int, Month_num int, Day int, row_id long, moisture double")
    out = panel_lookback(df, "moisture", pieces=16)
    got = {r.row_id: r for r in out.collect()}
    own = pd.Series([v[i] if v[i] is not None else np.nan for i in range(n) if i % 4])
    ids = [i for i in range(n) if i % 4]
    for name, want in (("lag_1", own.shift(1)), ("lag_7", own.shift(7)), ("rolling_3", own.rolling(3, min_periods=1).mean()),
                       ("rolling_6", own.rolling(6, min_periods=1).mean())):
        for i, x in zip(ids, want):
            assert (got[i][name] is None and np.isnan(x)) or got[i][name] == pytest.approx(x)
    assert all(got[i][c] is None for i in range(0, n, 4) for c in ("lag_1", "rolling_3"))
    order = ["Year", "Month_num", "Day", "row_id"]
    cuts = _panel_cuts(df.where("state is not null").select("state", "district", *order), ["state", "district"], order, 16, 64).first()
    starts = [0] + [c.k3.v for c in cuts["_cuts"]] + [n]
    assert len(starts) > 12 and max(b - a for a, b in zip(starts, starts[1:])) < 3 * n / 16


def test_hash_samples_merge(spark):
    from terrapanel.operators.windows import sample_rows

    df = spark.range(0, 1000).selectExpr("id", "id % 7 as k", "if(id % 5 = 0, null, 'x') as t")
    a = sorted(sample_rows(df, 50).collect(), key=str)
    assert a == sorted(sample_rows(df.repartition(13), 50).collect(), key=str) and len(a) == 50
    parts = sample_rows(df.where("k < 3"), 50).unionByName(sample_rows(df.where("k >= 3"), 50))
    assert sorted(sample_rows(parts, 50).collect(), key=str) == a
    assert sample_rows(df, 50, seed=7).subtract(spark.createDataFrame(a, df.schema)).count() > 30
    assert sample_rows(df, 2000).count() == 1000 and sample_rows(df.limit(0), 5).count() == 0


@pytest.mark.parametrize("accuracy, limit", [(10_000, 50_000), (10_000, 300), (60, 10), (60, 300), (20, 3)])
def test_quantiles_of_small_and_narrowed_groups(spark, accuracy, limit):
    from terrapanel.operators.quantiles import column_quantiles, grouped_quantiles

    rng = np.random.default_rng(11)
    rows = [(g, float(x)) for g, n in (("a", 25), ("b", 400), ("c", 1), ("d", 5000)) for x in rng.integers(0, 6 * n, size=n)]
    rows += [("e", 3.0)] * 500 + [("e", 4.0)] * 501          # ties across a bracket
    rows += [("f", 7.0)] * 900 + [("f", float(x)) for x in rng.normal(size=300)] + [("g", float(x)) for x in np.exp(rng.normal(size=2000) * 8)]
    df = spark.createDataFrame(rows + [("a", None), (None, 5.0)], "g string, v double").repartition(5)
    ps, names = [0.0, 0.25, 0.5, 0.9, 1.0], ["p0", "p25", "p50", "p90", "p100"]
    got = {r.g: tuple(r[c] for c in names) for r in
           grouped_quantiles(df, ["g"], "v", ps, names, accuracy=accuracy, limit=limit, extra_aggs=[F.avg("_v").alias("m")]).collect()}
    for g in "abcdefg":
        vals = np.array([v for k, v in rows if k == g])
        assert got[g] == pytest.approx(tuple(np.percentile(vals, [0, 25, 50, 90, 100])))
    wide = df.select("v", (-F.col("v")).alias("w"), F.when(F.col("g") == "c", F.col("v")).alias("few"), F.lit(None).cast("double").alias("none"))
    cols = column_quantiles(wide, wide.columns, ps, accuracy, limit)
    v = np.array([x for _, x in rows] + [5.0])
    assert cols["v"] == (len(v), pytest.approx(np.percentile(v, [0, 25, 50, 90, 100]).tolist()))
    assert cols["w"][1] == pytest.approx(np.percentile(-v, [0, 25, 50, 90, 100]).tolist())
    assert cols["few"][0] == 1 and cols["none"] == (0, [None] * 5)


def test_tercile_equals_pandas(spark):
    import pandas as pd

    vals = np.random.default_rng(2).integers(0, 4, size=64).astype(float)
    df = spark.createDataFrame([(int(i), float(v)) for i, v in enumerate(vals)], "row_id long, moisture double")
    exp = pd.qcut(pd.Series(vals).rank(method="first"), q=3, labels=["Low", "Medium", "High"]).astype(str).tolist()
    got = [r.moisture_class for r in
           tercile_class(df, "moisture", ["row_id"]).orderBy("row_id").collect()]
    assert got == exp
