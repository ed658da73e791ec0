"""Feature preparation and models (M1–M9, S9) on ``pyspark.ml``.

* M1/M2 — exact median imputation and population-std scaling learnt on the
  train year.  ``ml.feature.Imputer`` uses approximate quantiles and
  ``StandardScaler`` the sample std, so the statistics are built from
  aggregates (exact medians selected by counts), one row.
  A feature that is entirely null in the train year is imputed with 0.0 and
  reported in ``all_null`` (ledger L3).
* M4–M8 — least squares of ``linear`` (normal equations), a forest of ``forests``
  (200 trees grown to purity, seed 42), two boosted models of ``boosting``
  (200 rounds, depth 6, step 0.1, on all rows and features: level by level, and
  best leaf first up to 31 leaves) and a forest on the tercile class with
  alphabetical label indexing (High=0, Low=1, Medium=2).
* Models persist with ``write().overwrite().save`` (S9).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.operators.boosting import DepthwiseBooster, LeafwiseBooster
from terrapanel.operators.forests import GrownForest
from terrapanel.operators.linear import NormalLinear
from terrapanel.operators.quantiles import column_quantiles


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(df)


def fit_preprocessing(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """M1+M2 statistics as one row (fitted once per session for a given
    training set; the fitted row is kept as a one-row literal table)."""
    from terrapanel.operators.lookup import literal_table
    from terrapanel.session import reuse_stage

    def build():
        stats = _fit_preprocessing(train, features)
        row = stats.first()
        types = [f.dataType.simpleString() for f in stats.schema.fields]
        return literal_table(train.sparkSession, [tuple(row)], stats.columns, types)
    return reuse_stage("fit_preprocessing", train, tuple(features), build)


def _fit_preprocessing(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """M1+M2 statistics as one row: ``med_<f>``, ``mean_<f>``, ``std_<f>``.

    Medians are exact, selected by counts over the wide table for all features
    at once.  Mean and population std are of the *imputed* column, as a scaler
    fitted after the imputer sees it."""
    feats = list(features)
    found = column_quantiles(train, feats, [0.5])
    meds = {f: F.lit(found[f][1][0] if found[f][0] else 0.0).cast("double") for f in feats}
    imputed = train.select(*[F.coalesce(F.col(f).cast("double"), meds[f]).alias(f) for f in feats])
    stats = imputed.agg(*[F.avg(f).alias(f"mean_{f}") for f in feats], *[F.stddev_pop(f).alias(f"std_{f}") for f in feats])
    none = [f for f in feats if not found[f][0]]
    return stats.select(*[meds[f].alias(f"med_{f}") for f in feats], *[F.col(f"mean_{f}") for f in feats], *[F.col(f"std_{f}") for f in feats],
                        F.lit(none).cast("array<string>").alias("all_null") if none else F.array().cast("array<string>").alias("all_null"))


def apply_preprocessing(df: DataFrame, features: Sequence[str], prep,
                        scale: bool = True, prefix: str | None = None) -> DataFrame:
    """Impute with train medians, then (x - mean) / std (std 0 -> 1).

    ``prep`` is the fitted one-row statistics table (3 numbers per feature);
    like any fitted model's parameters it is read once and applied as
    literals, which keeps the scoring plan independent of the training plan."""
    if isinstance(prep, DataFrame):
        prep = prep.first()
    row = prep.asDict() if hasattr(prep, "asDict") else dict(prep)
    cols = []
    for f in features:
        x = F.coalesce(F.col(f).cast("double"), F.lit(row[f"med_{f}"]).cast("double"))
        if scale:
            mean, std = row[f"mean_{f}"], row[f"std_{f}"]
            std = 1.0 if (std is None or std == 0) else std
            x = (x - F.lit(mean).cast("double")) / F.lit(std)
        cols.append(x.alias(f"{prefix}{f}" if prefix else f))
    if prefix:
        return df.select("*", *cols)
    others = [F.col(c) for c in df.columns if c not in set(features)]
    return df.select(*others, *cols)


def regressors(seed: int = 42, trees: int = 200, rounds: int = 200, depth_b: int = 6) -> dict:
    """M4–M7 with the reference configurations; no rows or features are left out of any round."""
    return {
        "Linear": NormalLinear(),
        "RandomForest": GrownForest(trees=trees, seed=seed),
        "GBT_A": DepthwiseBooster(rounds=rounds, maxDepth=6, stepSize=0.1),
        "GBT_B": LeafwiseBooster(rounds=rounds, maxDepth=depth_b, stepSize=0.1),
    }


def fit_regressors(train: DataFrame, features: Sequence[str], target: str,
                   models: dict | None = None) -> dict:
    """Fit each estimator on (features, target) rows with a present target (P5)."""
    data = assemble(train.where(F.col(target).isNotNull()).withColumn("label", F.col(target).cast("double")),
                    features).select("features", "label").persist()
    try:
        return {name: est.fit(data) for name, est in (models or regressors()).items()}
    finally:
        data.unpersist()


def predict(models: dict, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """M9: one prediction column per model; a model that cannot score is an error."""
    out = assemble(df, features, out="features")
    for name, m in models.items():
        out = m.copy().setPredictionCol(name).transform(out)       # the fitted model may be shared
    return out.drop("features")


def moisture_classifier(features: Sequence[str], label: str = "moisture_class", trees: int = 200,
                        seed: int = 42) -> Pipeline:
    """M8: alphabetical label index (High=0, Low=1, Medium=2) + random forest."""
    idx = StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc",
                        handleInvalid="skip")
    asm = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    rf = GrownForest(trees=trees, seed=seed, classes=True)
    return Pipeline(stages=[idx, asm, rf])


def decode_prediction(model: PipelineModel, df: DataFrame, out: str = "predicted_class") -> DataFrame:
    labels = model.stages[0].labels
    return IndexToString(inputCol="prediction", outputCol=out, labels=labels).transform(df)


def save_model(model, path: str) -> None:
    """S9."""
    model.write().overwrite().save(path)


def load_models(spark, folder: str) -> dict:
    """Name -> fitted model, for every model saved in a subfolder of ``folder``."""
    from pyspark.ml.util import DefaultParamsReader

    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(path)
    names = sorted(f.getPath().getName() for f in found if f.isDirectory())
    return {n: DefaultParamsReader.loadParamsInstance(f"{folder.rstrip('/')}/{n}", spark) for n in names}
