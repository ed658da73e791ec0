"""Image listing + batch scoring on a tiny folder, metric documents, and the
driver contract (entry / queries / oracle on the smallest tables)."""

import json
import os

import duckdb
import pytest

import __spark_entry__ as E
from terrapanel.sources.images import scan_image_folder, score_images
from terrapanel.sources.metrics import scan_metrics

from sample_paths import SF_SMALL


def test_image_folder_and_scoring(spark, tmpdir_path):
    for label, n in [("dry", 3), ("wet", 2)]:
        os.makedirs(os.path.join(tmpdir_path, label))
        for i in range(n):
            with open(os.path.join(tmpdir_path, label, f"img{i}.png"), "wb") as fh:
                fh.write(b"\x89PNG\r\n\x1a\n" + bytes([i]) * (10 + i))
    with open(os.path.join(tmpdir_path, "dry", "notes.txt"), "w") as fh:
        fh.write("not an image")
    imgs = scan_image_folder(spark, tmpdir_path, with_content=True)
    assert sorted((r.label, r.length) for r in imgs.collect()) == \
        [("dry", 18), ("dry", 19), ("dry", 20), ("wet", 18), ("wet", 19)]

    def load():
        return {"scale": 0.1}

    def predict(model, pdf):
        return [[len(c) * model["scale"], 1.0] for c in pdf["content"]]

    scored = score_images(imgs, load, predict, "toy").collect()
    assert len(scored) == 5 and all(len(r.scores) == 2 and r.model == "toy" for r in scored)


def test_broken_images_have_null_scores_and_batches_are_bounded(spark):
    rows = [(i, None if i == 3 else bytes([i]) * (40 if i == 5 else 10)) for i in range(12)]
    df = spark.createDataFrame(rows, "image_id long, content binary").coalesce(1)

    def decode(raw):
        if raw[0] == 7:
            raise ValueError("broken")
        return raw[0]

    def predict(model, pdf):
        return [[float(c), float(len(pdf))] for c in pdf["content"]]

    got = {r.image_id: r.scores for r in score_images(df, lambda: None, predict, "m", keep=("image_id",), decode=decode, batch_bytes=30).collect()}
    assert got[3] is None and got[7] is None and len(got) == 12
    assert all(got[i][0] == i and got[i][1] <= 4 for i in got if i not in (3, 7))
    assert score_images(df.limit(0), lambda: None, predict, "m", keep=("image_id",)).count() == 0


def test_models_that_cannot_score_are_null_and_counted(spark):
    from terrapanel.plans.serve import column_predictor, predict_all, prediction_failures
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1.0, "x"), (2.0, "y"), (None, "z")], "a double, t string")
    models = [column_predictor("Good", F.col("a") + 1), column_predictor("Gone", F.col("b")), column_predictor("Text", F.col("t")),
              column_predictor("Odd", F.when(F.col("a") == 2, F.lit(float("inf"))).otherwise(F.col("a")))]
    out = predict_all(df, models).orderBy("t").select("Good", "Gone", "Text", "Odd", "Ensemble").collect()
    assert [tuple(r) for r in out] == [(2.0, None, None, 1.0, 1.5), (3.0, None, None, None, None), (None,) * 5]
    assert {(r.model, r.reason): r.n for r in prediction_failures(df, models).collect()} == {
        ("Good", "no value"): 1, ("Gone", "UNRESOLVED_COLUMN.WITH_SUGGESTION"): 3, ("Text", "prediction is not a number"): 3,
        ("Odd", "no value"): 1, ("Odd", "not finite"): 1}


def test_flat_and_nested_metric_files(spark, tmpdir_path):
    with open(os.path.join(tmpdir_path, "regression_results.json"), "w") as fh:
        json.dump({"Linear": {"RMSE": 0.31, "MAE": 0.2, "R2": 0.94}}, fh)
    with open(os.path.join(tmpdir_path, "regression_metrics.json"), "w") as fh:
        json.dump({"RMSE": 0.3, "MAE": 0.11, "R2": 0.95}, fh)
    rows = {(r.source_file, r.model) for r in scan_metrics(spark, tmpdir_path + "/*.json", source_from="file").collect()}
    assert rows == {("regression_results.json", "Linear"), ("regression_metrics.json", "regression_metrics")}
    assert scan_metrics(spark, tmpdir_path + "/missing").count() == 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 25
    assert df.columns == ["state", "district", "max_year", "latest_lag_1", "latest_rolling_3", "district_rank"]


def test_every_query_has_oracle_or_is_model_fit():
    from terrapanel.plans.catalog import QUERIES as qs
    from terrapanel.plans.oracle_sql import SQL as sql

    missing = sorted(set(qs) - set(sql))
    assert all(m.startswith("model_") or m == "eda_sample_rows" for m in missing), missing
    assert set(sql) <= set(qs)


FAST = ["rank_latest_smoothed", "season_counts", "eda_histogram", "serve_heatmap", "eval_labels_report",
        "scores_topk", "images_split_counts", "serve_farmer_summary"]


@pytest.mark.parametrize("name", FAST)
def test_oracle_match_small(spark, name):
    con = duckdb.connect()
    for t in ["region", "nation", "customer", "orders", "lineitem", "events", "documents", "labels",
              "embeddings"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    sdf = E.queries()[name](spark, SF_SMALL)
    srows = sorted(tuple("∅" if v is None else str(v) for v in r) for r in sdf.select(*sorted(sdf.columns)).collect())
    res = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    drows = sorted(tuple("∅" if r[i] is None else str(r[i]) for i in order) for r in res.fetchall())
    assert sorted(sdf.columns) == sorted(cols)
    assert len(srows) == len(drows)
    assert srows == drows


def test_profile_and_sinks(spark, tmpdir_path):
    from pyspark.sql import functions as F

    from terrapanel.operators.clean import region_filter
    from terrapanel.plans.eda import eda_profile, save_group_summaries
    from terrapanel.plans.features import tag_seasons
    from terrapanel.operators.lookup import season_calendar
    from terrapanel.sources.files import export_csv, load_table
    from terrapanel.sources.tables import readings

    r = readings(spark, SF_SMALL)
    prof = eda_profile(tag_seasons(r, season_calendar(spark)))
    assert {"checks", "describe", "histogram", "correlation", "season_box", "monthly_resample"} <= set(prof)
    assert prof["checks"].first().n_rows == r.count()
    save_group_summaries(r, tmpdir_path)
    assert spark.read.option("header", True).csv(f"{tmpdir_path}/state_mean_summary").count() == 5
    export_csv(prof["state_mean"], f"{tmpdir_path}/export", order_by=["mean_value"])
    assert len([f for f in os.listdir(f"{tmpdir_path}/export") if f.endswith(".csv")]) == 1
    assert load_table(spark, f"{tmpdir_path}/nothing-here") is None
    exact = region_filter(r, "asia", r.select("district").where(F.col("state") == "ASIA").first()[0].lower())
    assert exact.select("district").distinct().count() == 1
