"""Image collections (S12) and batch scoring.

* ``scan_image_folder`` — one ``binaryFile`` scan of ``root/<class>/<file>``;
  the class is the parent folder (``regexp_extract`` on the path).  Content
  is only read when a later step selects it (column pruning).
* ``score_images`` — ``mapInPandas`` over Arrow batches: the caller's
  ``load_model()`` runs once per Python worker and ``predict(model, batch)``
  returns one score vector per image.  This is the only Python data path in
  the library; the network itself is the caller's (no trainer is built).
"""

from __future__ import annotations

from typing import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGE_GLOB = "*.{jpg,jpeg,png,JPG,JPEG,PNG}"


def scan_image_folder(spark: SparkSession, root: str, glob: str = IMAGE_GLOB,
                      with_content: bool = False) -> DataFrame:
    df = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
          .option("recursiveFileLookup", True).load(root))
    out = df.select(
        F.col("path"), F.col("length"),
        F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("label"),
        *([F.col("content")] if with_content else []))
    return out.withColumn("image_id", F.xxhash64("path"))


BATCH_BYTES = 32 << 20     # of the images that a model gets at once


def score_images(images: DataFrame, load_model: Callable[[], object],
                 predict: Callable[[object, pd.DataFrame], Sequence[Sequence[float]]],
                 model_name: str, keep: Sequence[str] = ("image_id", "label"),
                 content_col: str = "content", decode: Callable[[bytes], object] | None = None,
                 batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(image_id, label, model, scores array<double>) per image; the model
    is loaded once per task, so a retrained one is never confused with an old one.

    ``predict`` gets frames of at most ``batch_bytes`` of content (or one image);
    with ``decode`` their content column holds what it returns.  An image that is
    null or that ``decode`` cannot read has null scores and does not reach the model."""
    keep = list(keep)

    def readable(raw):
        if raw is None or decode is None:
            return raw
        try:
            return decode(bytes(raw))
        except Exception:                       # a broken image is a result, not a failure of the job
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for pdf in batches:
            sizes = pdf[content_col].map(lambda c: 0 if c is None else len(c)).cumsum()
            for _, part in pdf.groupby((sizes - 1).clip(lower=0) // batch_bytes, sort=False):
                content = [readable(c) for c in part[content_col]]
                good = [i for i, c in enumerate(content) if c is not None]
                scores: list = [None] * len(part)
                if good:
                    given = part.iloc[good].copy()
                    given[content_col] = pd.Series([content[i] for i in good], index=given.index, dtype=object)
                    for i, s in zip(good, predict(model, given), strict=True):
                        scores[i] = [float(x) for x in s]
                out = part[keep].copy()
                out["model"] = model_name
                out["scores"] = pd.Series(scores, index=out.index, dtype=object)
                yield out

    schema_fields = [f"{c} {images.schema[c].dataType.simpleString()}" for c in keep]
    schema = ", ".join(schema_fields + ["model string", "scores array<double>"])
    return images.select(*keep, content_col).mapInPandas(run, schema)
