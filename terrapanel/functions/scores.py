"""Class-score vector functions (F19, T7, T8) as higher-order array
expressions — no Python in the row path."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def softmax(scores) -> Column:
    """numerically stable softmax of an array of scores."""
    s = _c(scores).cast("array<double>")
    m = F.array_max(s)
    ex = F.transform(s, lambda x: F.exp(x - m))
    tot = F.aggregate(ex, F.lit(0.0), lambda a, x: a + x)
    return F.transform(ex, lambda x: x / tot)


def argmax_class(probs, labels: Sequence[str] | None = None) -> Column:
    """struct(label, confidence_pct) of the best class (first on ties)."""
    p = _c(probs)
    best = F.array_max(p)
    idx = F.array_position(p, best) - 1
    label = F.element_at(F.array(*[F.lit(x) for x in labels]), (idx + 1).cast("int")) if labels \
        else idx.cast("string")
    return F.struct(label.alias("label"), (best * 100).alias("confidence_pct"))


def top_k_classes(probs, k: int = 3, labels: Sequence[str] | None = None) -> Column:
    """The k best classes as array<struct<label, prob_pct>>, best first,
    equal probabilities ordered by class index."""
    p = _c(probs)
    ranked = F.array_sort(F.transform(p, lambda x, i: F.struct((-x).alias("neg"), i.alias("idx"))))
    top = F.slice(ranked, 1, k)
    lab_arr = F.array(*[F.lit(x) for x in labels]) if labels else None

    def to_out(e):
        lab = F.element_at(lab_arr, (e["idx"] + 1).cast("int")) if labels else e["idx"].cast("string")
        return F.struct(lab.alias("label"), (-e["neg"] * 100).alias("prob_pct"))
    return F.transform(top, to_out)
