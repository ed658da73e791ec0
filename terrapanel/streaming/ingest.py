"""Incremental ingest of new reading files (S1 + S6, re-aimed).

The reference re-read every file of a year and skipped stages whose output
already existed.  Here new CSV files dropped into a folder are picked up by
Structured Streaming's file source, which remembers processed files in the
checkpoint.  A file is in one micro-batch as a whole, so a batch finds each
file's columns by its own header, like the batch scan; rows are standardised and
written to ``target/ingest=<batch>/Year=...``, the lines that do not fit to
``<target>-rejects/ingest=<batch>`` with file and reason.  A batch that runs again
overwrites its own folder, so both tables hold every line once.
``trigger(availableNow=True)`` processes what is there and stops, so
the same call serves scheduled batch runs; a processing-time trigger turns
it into a continuous job.  Exact-row dedupe stays in Q1 (``clean_merge``),
because a copy of a file under another name is a new file to the source.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapanel.operators.clean import add_column_if_missing
from terrapanel.sources.files import MEASURES, read_lines, standardize, text_lines

REQUIRED = ["state", "district", "date_text", "moisture"]


def rejects_path(target_path: str) -> str:
    return f"{target_path.rstrip('/')}-rejects"


def ingest_new_files(spark: SparkSession, source_dir: str, target_path: str,
                     checkpoint: str | None = None, glob: str = "*.csv",
                     max_files_per_trigger: int | None = None, available_now: bool = True,
                     processing_time: str | None = None):
    """Start (and, with ``available_now``, finish) the ingest; returns the query."""
    reader = spark.readStream.option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    target = target_path.rstrip("/")
    # beside the target: the next process finds what this one has read
    ckpt = checkpoint or f"{target}-ingest-checkpoint"
    mark = f"{zlib.crc32(ckpt.encode()):08x}"              # batches of another checkpoint are other batches

    def write(lines: DataFrame, batch: int) -> None:
        lines.persist()
        try:
            rows, rejects = read_lines(lines)
            for c in REQUIRED:
                rows = add_column_if_missing(rows, c, "string")
            out = standardize(rows)
            for c in MEASURES:
                out = add_column_if_missing(out, c, "double")       # one schema for all batches
            out.write.mode("overwrite").partitionBy("Year").parquet(f"{target}/ingest={mark}-{batch}")
            rejects.write.mode("overwrite").parquet(f"{rejects_path(target)}/ingest={mark}-{batch}")
        finally:
            lines.unpersist()

    writer = text_lines(reader, source_dir).writeStream.foreachBatch(write).option("checkpointLocation", ckpt)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    q = writer.start()
    if available_now:
        q.awaitTermination()
    return q


def reject_counts(spark: SparkSession, target_path: str) -> DataFrame:
    """(source_file, reason, n) of what the ingest has rejected so far."""
    rejects = spark.read.parquet(rejects_path(target_path))
    return rejects.groupBy("source_file", "reason").agg(F.count(F.lit(1)).alias("n"))
