"""Metric documents.

A metrics document is JSON ``{model: {RMSE, MAE, R2}}`` (or one flat
``{RMSE, MAE, R2}`` object).  ``write_metrics`` builds one document per
source with ``to_json`` and writes it as text, partitioned by source;
``scan_metrics`` reads every document in one ``wholetext`` scan, parses it
with ``from_json`` and explodes it to (source_file, model, MAE, RMSE, R2).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = ["RMSE", "MAE", "R2"]
_STRUCT = "struct<RMSE: double, MAE: double, R2: double>"


def metrics_document(metrics: DataFrame, source_col: str, model_col: str = "model",
                     cols: Sequence[str] = METRICS) -> DataFrame:
    """(source, json) with one JSON object per source (models are few per
    source, so the per-source list is bounded)."""
    entry = F.struct(F.col(model_col).alias("key"),
                     F.struct(*[F.col(c).cast("double").alias(c) for c in cols]).alias("value"))
    return metrics.groupBy(source_col).agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("json"))


def write_metrics(metrics: DataFrame, path: str, source_col: str, model_col: str = "model",
                  mode: str = "overwrite") -> None:
    """One document per source under ``path/<source_col>=<value>/``."""
    doc = metrics_document(metrics, source_col, model_col)
    doc.write.mode(mode).partitionBy(source_col).text(path)


def scan_metrics(spark: SparkSession, path: str, source_from: str = "partition",
                 source_col: str = "source") -> DataFrame:
    """S8/E6 input: (source_file, model, MAE, RMSE, R2), one row per model,
    flat documents give one row named after the file; duplicates dropped.
    Missing paths yield an empty table."""
    schema = "source_file string, model string, MAE double, RMSE double, R2 double"
    try:
        raw = spark.read.option("wholetext", True).text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    fp = F.col("_metadata.file_path")
    if source_from == "partition":
        src = F.url_decode(F.regexp_extract(fp, rf"{source_col}=([^/]+)/", 1))
    else:
        src = F.regexp_extract(fp, r"([^/]+)$", 1)
    stem = F.regexp_replace(src, r"\.[^.]*$", "")
    docs = raw.select(src.alias("source_file"), stem.alias("_stem"), F.col("value").alias("_doc"))
    as_map = F.from_json("_doc", f"map<string, {_STRUCT}>")
    as_flat = F.from_json("_doc", _STRUCT)
    nested = (docs.select("source_file", F.explode_outer(as_map).alias("model", "m"), as_flat.alias("flat"))
                  .where(F.col("m").isNotNull()))
    flat = (docs.select("source_file", "_stem", as_map.alias("mm"), as_flat.alias("flat"))
                .where(F.col("mm").isNull() & F.col("flat").isNotNull())
                .select("source_file", F.col("_stem").alias("model"), F.col("flat").alias("m")))
    nested_rows = nested.where(F.col("m.RMSE").isNotNull() | F.col("m.MAE").isNotNull() |
                               F.col("m.R2").isNotNull()).select("source_file", "model", "m")
    rows = nested_rows.unionByName(flat)
    return rows.select("source_file", "model", F.col("m.MAE").alias("MAE"),
                       F.col("m.RMSE").alias("RMSE"), F.col("m.R2").alias("R2")).dropDuplicates()


def compare_models(metrics: DataFrame) -> DataFrame:
    """Deduplicated comparison sorted by RMSE."""
    return metrics.dropDuplicates().orderBy("RMSE", "source_file", "model")
