"""Least squares by normal equations (M4).

One aggregate over the rows gives the Gram matrix of the features, the label and
a constant: sums of products, combined map-side, whatever the rows.  It is
centred and scaled to unit diagonal, and solved by a Cholesky factorisation that
takes the column with the most variance left at each step; a column of which the
ones taken leave less than ``TOLERANCE`` is collinear with them and gets
coefficient 0.  Ties take the first column.  Products are summed around the
first row's values, so a large mean does not cost digits.

Rows with a null label, or a null or NaN feature, are left out; no rows are an error.
"""

from __future__ import annotations

import numpy as np
from pyspark import keyword_only
from pyspark.ml.base import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-9          # of a column's variance that must be left


def pivoted_solve(gram: np.ndarray, right: np.ndarray, tolerance: float = TOLERANCE) -> np.ndarray:
    """x with ``gram @ x = right`` for a positive semidefinite ``gram``; columns that others determine get 0."""
    n = len(right)
    scale = np.sqrt(np.diag(gram))
    scale[scale == 0] = 1.0
    a, b = gram / np.outer(scale, scale), right / scale
    left = np.diag(a).copy()
    lower = np.zeros((n, n))
    taken: list = []
    for k in range(n):
        rest = [i for i in range(n) if i not in taken]
        most = max(left[i] for i in rest)
        if most < tolerance:
            break
        p = next(i for i in rest if left[i] >= most * (1 - 1e-12))
        taken.append(p)
        lower[p, k] = np.sqrt(left[p])
        for i in rest:
            if i != p:
                lower[i, k] = (a[i, p] - lower[i, :k] @ lower[p, :k]) / lower[p, k]
                left[i] -= lower[i, k] ** 2
    m = len(taken)
    if not m:
        return np.zeros(n)
    low = lower[taken, :m]
    z = np.zeros(m)
    for i in range(m):
        z[i] = (b[taken[i]] - low[i, :i] @ z[:i]) / low[i, i]
    for i in reversed(range(m)):
        z[i] = (z[i] - low[i + 1:, i] @ z[i + 1:]) / low[i, i]
    out = np.zeros(n)
    out[taken] = z
    return out / scale


class NormalLinear(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, featuresCol: str = "features", labelCol: str = "label", predictionCol: str = "prediction"):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> NormalLinearModel:
        rows = dataset.select(vector_to_array(self.getOrDefault("featuresCol")).alias("x"),
                              F.col(self.getOrDefault("labelCol")).cast("double").alias("y"))
        rows = rows.where("y is not null and not isnan(y) and not exists(x, v -> v is null or isnan(v))")
        first = rows.first()
        if first is None:
            raise ValueError("no rows with a label and all features")
        origin = [*first.x, first.y]
        n = len(origin)
        at = [F.col("x")[i] - F.lit(origin[i]) for i in range(n - 1)] + [F.col("y") - F.lit(origin[-1])]
        pairs = [(i, j) for i in range(n) for j in range(i, n)]
        row = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(at)],
                       *[F.sum(at[i] * at[j]).alias(f"p{i}_{j}") for i, j in pairs]).first()
        sums = np.array([row[f"s{i}"] for i in range(n)]) / row["n"]
        gram = np.zeros((n, n))
        for i, j in pairs:
            gram[i, j] = gram[j, i] = row[f"p{i}_{j}"] / row["n"] - sums[i] * sums[j]
        np.fill_diagonal(gram, np.maximum(np.diag(gram), 0.0))
        own = gram[:-1, :-1]
        # what rounding alone leaves of a constant column's variance is none
        noise = np.diag(own) <= 1e-14 * np.array([row[f"p{i}_{i}"] / row["n"] for i in range(n - 1)])
        own[noise, :] = own[:, noise] = 0.0
        right = np.where(noise, 0.0, gram[:-1, -1])
        slope = pivoted_solve(own, right)
        means = sums + np.array(origin)
        return NormalLinearModel(coefficients=[float(x) for x in slope], intercept=float(means[-1] - slope @ means[:-1]))._set(
            **{c: self.getOrDefault(c) for c in ("featuresCol", "labelCol", "predictionCol")})


class NormalLinearModel(Model, HasFeaturesCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    coefficients = Param(Params._dummy(), "coefficients", "one for each feature; 0: left out", TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "at zero features", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, coefficients: list | None = None, intercept: float = 0.0):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction")
        self._set(**self._input_kwargs)

    def setPredictionCol(self, value: str) -> NormalLinearModel:
        return self._set(predictionCol=value)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        x = vector_to_array(self.getOrDefault("featuresCol"))
        out = F.lit(self.getOrDefault("intercept"))
        for i, c in enumerate(self.getOrDefault("coefficients")):
            if c:
                out = out + F.lit(c) * x[i]
        return dataset.withColumn(self.getOrDefault("predictionCol"), F.when(F.col(self.getOrDefault("featuresCol")).isNotNull(), out))
