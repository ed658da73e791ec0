"""Rows must not disappear, and stages must not go stale, without a word."""
import os

import pytest
from pyspark.sql import functions as F

from terrapanel.operators import sampling as SP
from terrapanel.operators.evaluate import confusion_matrix, per_class_accuracy
from terrapanel.plans.features import clean_merge, ingest_files
from terrapanel.session import materialize, reuse_stage
from terrapanel.sources.files import rejected_dates, scan_readings, standardize
from terrapanel.streaming.ingest import ingest_new_files


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)


def test_stage_sees_appended_files(spark, tmpdir_path):
    path = f"{tmpdir_path}/t"
    spark.range(5).coalesce(1).write.parquet(path)
    first = reuse_stage("n", spark.read.parquet(path), (), lambda: materialize(spark.read.parquet(path)))
    again = reuse_stage("n", spark.read.parquet(path), (), lambda: pytest.fail("unchanged files build nothing"))
    assert first.count() == again.count() == 5
    spark.range(2).coalesce(1).write.mode("append").parquet(path)
    assert reuse_stage("n", spark.read.parquet(path), (), lambda: materialize(spark.read.parquet(path))).count() == 7


def test_ingest_finds_its_checkpoint_again(spark, tmpdir_path):
    header = "date,state,district,moisture,volume,agg_pct,vol_pct\n"
    src, target = f"{tmpdir_path}/src", f"{tmpdir_path}/target"
    write(f"{src}/a.csv", header + "2020/01/31,GOA,SOUTH GOA,0.5,1.0,0,2.0\n")
    ingest_new_files(spark, src, target)
    assert os.path.isdir(f"{target}-ingest-checkpoint")        # nothing in the path hangs on the process
    write(f"{src}/b.csv", header + "2020/02/01,GOA,SOUTH GOA,0.6,1.0,0,2.0\n")
    ingest_new_files(spark, src, target)
    assert spark.read.parquet(target).count() == 2


BAD = ("date,state,district,moisture,volume\n2020/01/31,GOA,SOUTH GOA,0.5,1\n2020/01/31,GOA,\"SOUTH, GOA\",0.6,\"1\"\n"
       "2020/01/31,GOA,A,0.5,1,7\n2020/01/31,GOA,\"B,0.5,1\n2020/01/31,GOA,C,0.7\n\n \n2020/01/31,GOA,\"D \"\"x\"\"\",0.8,\n2020/01/31,GOA,E,0.5,1,\n")


def test_lines_that_do_not_fit_are_rejected_and_counted(spark, tmpdir_path):
    from terrapanel.sources.files import scan_rejects
    from terrapanel.streaming.ingest import reject_counts

    src, target = f"{tmpdir_path}/src", f"{tmpdir_path}/target"
    write(f"{src}/a.csv", BAD)
    wide = [f"c{i}" for i in range(60)]
    wide[5], wide[43], wide[50], wide[59] = "district_name", "average soilmoisture level (at 15cm)", "State Name", "DATE"
    write(f"{src}/b.csv", ",".join(wide) + "\n" + ",".join("2020-03-01" if i == 59 else "GOA" if i == 50 else "W" if i == 5 else str(i) for i in range(60)) + "\n")
    rows = {(r.district, r.moisture) for r in standardize(scan_readings(spark, src)).collect()}
    assert rows == {("SOUTH GOA", 0.5), ("SOUTH, GOA", 0.6), ("C", 0.7), ('D "X"', 0.8), ("W", 43.0)}
    rejects = scan_rejects(spark, src)
    assert sorted((r.reason, r.line.split(",")[2]) for r in rejects.collect()) == [("cells", "A"), ("cells", "E"), ("quote", '"B')]
    ingest_new_files(spark, src, target)
    write(f"{src}/c.csv", "no header\n1,2\n")
    ingest_new_files(spark, src, target)
    table = spark.read.parquet(target)
    assert {(r.district, r.moisture) for r in table.collect()} == rows and "volume" in table.columns
    counts = {(r.source_file.rsplit("/", 1)[1], r.reason): r.n for r in reject_counts(spark, target).collect()}
    assert counts == {("a.csv", "cells"): 2, ("a.csv", "quote"): 1, ("c.csv", "header"): 2}


def test_null_class_keeps_its_rows(spark):
    df = spark.createDataFrame([(i, "a" if i % 4 else None) for i in range(40)], "id int, label string")
    split = SP.split_70_10_20(df, "label", ["id"])
    assert split.count() == 40
    rows = {r.label: (r.Total, r.Train, r.Val, r.Test) for r in SP.split_counts(split, "label").collect()}
    assert rows == {None: (10, 7, 1, 2), "a": (30, 21, 3, 6), "ALL": (40, 28, 4, 8)}
    assert SP.sample_per_class(df, "label", ["id"], 3).count() == 6


def test_columns_are_found_by_header(spark, tmpdir_path):
    write(f"{tmpdir_path}/a.csv", "District_Name,Volume,state name,Date,Moisture Level\nSOUTH GOA,9,GOA,2020-01-06,5\n")
    write(f"{tmpdir_path}/b.csv", "﻿date,state,district,average_soilmoisture_level_(at_15cm)\n2020/01/07,Goa,North Goa,6\nbad date,GOA,X,7\n")
    df = standardize(scan_readings(spark, tmpdir_path))
    rows = {(r.state, r.district, str(r.reading_date), r.moisture) for r in df.collect()}
    assert rows == {("GOA", "SOUTH GOA", "2020-01-06", 5.0), ("GOA", "NORTH GOA", "2020-01-07", 6.0), ("GOA", "X", "None", 7.0)}
    assert tuple(rejected_dates(df).first()) == (3, 1)
    write(f"{tmpdir_path}/c.csv", "1,2,3\n")
    with pytest.raises(ValueError, match="1 files have no header"):
        scan_readings(spark, tmpdir_path)


def test_absent_measures_and_copies(spark, tmpdir_path):
    one = "date,state,district,moisture\n2020/01/06,GOA,SOUTH GOA,5\n"
    write(f"{tmpdir_path}/a.csv", one.replace("moisture", "average_soilmoisture_level_(at_15cm)"))
    write(f"{tmpdir_path}/a 2.csv", one.replace("moisture", "average_soilmoisture_level_(at_15cm)"))
    merged = ingest_files(spark, tmpdir_path)
    assert merged.count() == 1 and "volume" not in merged.columns
    full = merged.drop("row_id").withColumn("volume", F.lit(1.0))
    assert clean_merge([merged.drop("row_id"), full]).count() == 2


def test_row_ids_do_not_hang_on_files(spark, tmpdir_path):
    lines = [f"2020/01/06,GOA,SOUTH GOA,{i}" for i in range(20)]
    head = "date,state,district,average_soilmoisture_level_(at_15cm)\n"
    write(f"{tmpdir_path}/x/all.csv", head + "\n".join(lines))
    for i in range(4):
        write(f"{tmpdir_path}/y/{i}.csv", head + "\n".join(lines[i::4]))
    a, b = ({(r.moisture, r.row_id) for r in ingest_files(spark, f"{tmpdir_path}/{d}").collect()} for d in "xy")
    assert a == b and len({i for _, i in a}) == 20


def test_missing_predictions_count_as_wrong(spark):
    df = spark.createDataFrame([("a", "a"), ("a", None), ("b", "b")], "y string, p string")
    acc = {r.truth: (r.n, r.class_accuracy) for r in per_class_accuracy(confusion_matrix(df, "y", "p")).collect()}
    assert acc == {"a": (2, 0.5), "b": (1, 1.0)}


def test_saved_models_load_and_score_alike(spark, tmpdir_path):
    from terrapanel.operators.models import load_models, predict, regressors, save_model

    df = spark.createDataFrame([(float(i), float(i % 7), 2.0 * i + i % 7) for i in range(60)], "x double, z double, label double")
    from terrapanel.operators.models import assemble
    fitted = {n: e.fit(assemble(df, ["x", "z"])) for n, e in regressors(trees=3, rounds=2).items()}
    for n, m in fitted.items():
        save_model(m, f"{tmpdir_path}/models/{n}")
    loaded = load_models(spark, f"{tmpdir_path}/models")
    assert sorted(loaded) == sorted(fitted)
    a, b = (predict(m, df, ["x", "z"]).orderBy("x").select(*sorted(fitted)).collect() for m in (fitted, loaded))
    assert a == b


def test_no_local_folder_on_a_cluster(monkeypatch):
    from terrapanel import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()
        conf = Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())


def test_headers_are_looked_for_in_lines_that_may_be_one(spark):
    """A header is found whatever its case, quotes and byte order mark; a data line with both words is none."""
    from terrapanel.sources.files import _headers

    lines = [("ï»¿STATE NAME,\"DistrictName\",Date", "a"), ("state of X,district of Y,2020-01-01", "a"), ("x,y,z", "a"),
             ("state,town", "b"), ("p,q", "b")]
    tagged, placed = _headers(spark.createDataFrame(lines, "line string, source_file string"))
    assert sorted(r.line for r in tagged.where("_is_head").collect()) == [lines[0][0]]
    assert {(r.source_file, r._no_head, r._at_state, r._at_district) for r in placed.collect()} == {("a", False, 1, 2), ("b", True, None, None)}
