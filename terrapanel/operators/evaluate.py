"""Evaluation.

Metrics are single aggregations with partial aggregation; per-class reports
are built from the confusion counts (a table of #classes² rows), never from
collected predictions.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.session import materialize


def regression_metrics(df: DataFrame, y: str, pred: str, group: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, R² (over rows where both values exist), per group."""
    ok = df.where(F.col(y).isNotNull() & F.col(pred).isNotNull())
    e = F.col(pred).cast("double") - F.col(y).cast("double")
    agg = ok.groupBy(*group).agg(
        F.count(F.lit(1)).cast("long").alias("n"),
        F.avg(F.abs(e)).alias("MAE"),
        F.sqrt(F.avg(e * e)).alias("RMSE"),
        F.sum(e * e).alias("_sse"),
        (F.var_pop(F.col(y).cast("double")) * F.count(F.lit(1))).alias("_sst"))
    return agg.withColumn("R2", F.when(F.col("_sst") > 0, 1 - F.col("_sse") / F.col("_sst"))) \
              .drop("_sse", "_sst")


def confusion_counts(df: DataFrame, y: str, pred: str, group: Sequence[str] = ()) -> DataFrame:
    """(y, pred, n) over rows with a truth value; a null prediction counts as
    its own (null) class and is never correct."""
    return (df.where(F.col(y).isNotNull())
              .groupBy(*group, F.col(y).alias("y"), F.col(pred).alias("p"))
              .agg(F.count(F.lit(1)).cast("long").alias("n")))


def classification_report(df: DataFrame, y: str, pred: str,
                          labels: Sequence | None = None) -> DataFrame:
    """precision/recall/F1/support per class (zero when undefined), then
    accuracy, macro and weighted averages, as rows (like the text report).

    Classes are the union of truth and prediction values unless ``labels``
    is given (L26)."""
    # the confusion counts (classes² rows) feed five small aggregations:
    # written once so the scored input is evaluated once
    cc = materialize(confusion_counts(df, y, pred).where(F.col("p").isNotNull() | F.col("y").isNotNull()))
    if labels is None:
        classes = cc.select(F.col("y").alias("c")).union(cc.select(F.col("p").alias("c"))) \
                    .where(F.col("c").isNotNull()).distinct()
    else:
        classes = cc.sparkSession.createDataFrame([(str(c),) for c in labels], "c string")
    cc = cc.withColumn("y", F.col("y").cast("string")).withColumn("p", F.col("p").cast("string"))
    classes = classes.withColumn("c", F.col("c").cast("string"))
    sup = cc.groupBy(F.col("y").alias("c")).agg(F.sum("n").alias("support"))
    prd = cc.where(F.col("p").isNotNull()).groupBy(F.col("p").alias("c")).agg(F.sum("n").alias("predicted"))
    tp = cc.where(F.col("y") == F.col("p")).groupBy(F.col("y").alias("c")).agg(F.sum("n").alias("tp"))
    per = (classes.join(sup, "c", "left").join(prd, "c", "left").join(tp, "c", "left")
                  .fillna(0, ["support", "predicted", "tp"]))
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    per = per.withColumn("precision", prec).withColumn("recall", rec)
    per = per.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                      2 * F.col("precision") * F.col("recall")
                                      / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0)))
    rows = per.select(F.col("c").alias("label"), "precision", "recall", "f1",
                      F.col("support").cast("long").alias("support"))
    total = per.agg(F.sum("support").alias("s"), F.sum("tp").alias("t"),
                    F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                    (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
                    (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
                    (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"))
    summary = total.selectExpr(
        "stack(3, 'accuracy', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), t / s, s,"
        " 'macro avg', mp, mr, mf, s, 'weighted avg', wp, wr, wf, s)"
        " AS (label, precision, recall, f1, support)")
    return rows.unionByName(summary.withColumn("support", F.col("support").cast("long")))


def accuracy(df: DataFrame, y: str, pred: str, group: Sequence[str] = ()) -> DataFrame:
    """Share correct ×100 (rows with a truth value)."""
    ok = df.where(F.col(y).isNotNull())
    hit = F.coalesce((F.col(y) == F.col(pred)).cast("double"), F.lit(0.0))
    return ok.groupBy(*group).agg(F.count(F.lit(1)).cast("long").alias("n"),
                                  (F.avg(hit) * 100).alias("accuracy_pct"))


def confusion_matrix(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Dense (truth, prediction, count) including zero cells; classes =
    union of both columns.  The dense grid is generated from the (small)
    class array, not joined.  Rows without a prediction are counted in rows
    with a null ``predicted``, so a truth class keeps its full row sum."""
    allc = materialize(confusion_counts(df, y, pred))     # classes² rows, evaluated once
    cc = allc.where(F.col("p").isNotNull())
    classes = (allc.select(F.col("y").alias("c")).union(cc.select(F.col("p").alias("c")))
                   .agg(F.array_sort(F.collect_set("c")).alias("cs")))
    grid = classes.select(F.explode("cs").alias("y"), "cs").select("y", F.explode("cs").alias("p"))
    filled = grid.join(cc, ["y", "p"], "left").fillna(0, ["n"])
    return (filled.unionByName(allc.where(F.col("p").isNull()).select("y", "p", "n"))
                .select(F.col("y").alias("truth"), F.col("p").alias("predicted"), F.col("n").alias("count")))


def per_class_accuracy(confusion: DataFrame) -> DataFrame:
    """E5: diagonal / row sum per truth class, 0 when the row is empty."""
    return confusion.groupBy("truth").agg(
        F.sum("count").alias("n"),
        F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("count")).otherwise(0)).alias("hit")
    ).select("truth", F.col("n").cast("long").alias("n"),
             F.coalesce(F.try_divide(F.col("hit"), F.col("n")), F.lit(0.0)).alias("class_accuracy"))


def majority_vote(cols: Sequence[str]) -> Column:
    """The most frequent value among the given columns (row-wise, no
    shuffle); ties go to the smallest value; nulls do not vote."""
    votes = F.filter(F.array(*[F.col(c) for c in cols]), lambda x: x.isNotNull())
    scored = F.transform(votes, lambda v: F.struct(
        (-F.size(F.filter(votes, lambda w: w == v))).alias("neg"), v.alias("v")))
    return F.when(F.size(votes) > 0, F.array_min(scored)["v"])


def topk_hit(topk: Column, truth: Column) -> Column:
    """True label among the k best."""
    return F.array_contains(topk, truth)


def model_summary(df: DataFrame, model_col: str, acc_col: str, loss_col: str) -> DataFrame:
    """Model, test accuracy rounded to 3, loss rounded to 4 (nulls kept)."""
    return df.select(model_col, F.round(acc_col, 3).alias("test_accuracy"),
                     F.round(loss_col, 4).alias("test_loss"))
