"""WARC archives with revisit resolution.

Headers (digest, size, id, url) are shuffled by payload digest: an aggregate
per digest, combined before its shuffle, names the response of each digest
that occurs more than once.  A bitmap of those digests lets all other pages
pass without a shuffle; the rest join their response, and a frequent digest's
rows can be split there.  Every payload is then written once, with fresh
headers, through Spark's text writer: a record is one value, and the writer's
line end is the blank line that ends a WARC record.  Files are compressed and
hold about ``FILE_BYTES`` of records.  Reading takes whole files, cuts records
by their ``Content-Length`` and recomputes every digest, so a payload may hold
anything that looks like a header.

Nulls and odd rows: a null html is an empty payload, and always a response.
Rows that repeat the largest page_id with its payload are all responses; a
null page_id counts as less than any, and is a response only where all ids of
its payload are null.  A null url is written as ``urn:none``, white space and
control characters in one as ``%20``.  Extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.common import flagged
from terrapanel.session import checkpoint_dir

LEAST_BYTES = 1000             # smaller payloads are never revisits
FILE_BYTES = 32 << 20          # records of a file, before compression, on average
DATE = "2024-01-01T00:00:00Z"  # the tables have no capture time
_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def resolve(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) as page_id, url, payload, payload_bytes,
    payload_digest, record_type, refers_to, refers_url."""
    known = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("urn:none")), r"[\x00-\x20\x7F]", "%20").alias("url"),
                         F.coalesce("html", F.lit("")).alias("payload"))
    known = known.withColumns({"payload_bytes": F.octet_length("payload").cast("long"),
                               "payload_digest": F.sha1(F.col("payload").cast("binary"))})
    several = (known.where(F.col("payload_bytes") >= LEAST_BYTES).groupBy("payload_digest")
               .agg(F.max(F.struct("page_id", "url")).alias("latest"), F.count(F.lit(1)).alias("copies"))
               .where("copies > 1").select("payload_digest", "latest", F.xxhash64("payload_digest").alias("key")))
    split = flagged(known.withColumn("key", F.xxhash64("payload_digest")), several, "key")
    joined = split.where("hit").join(several.drop("key"), "payload_digest", "left").select(*known.columns, "latest").unionByName(
        split.where("not hit").select(*known.columns, F.lit(None).cast(several.schema["latest"].dataType).alias("latest")))
    revisit = (F.col("payload_bytes") >= LEAST_BYTES) & F.col("latest.page_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("latest.page_id"))
    return joined.select(*known.columns, F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                         F.when(revisit, F.col("latest.page_id")).alias("refers_to"),
                         F.when(revisit, F.col("latest.url")).alias("refers_url"))


def _record_id(page_id, digest):
    """One id per page and payload: the same when a task is run again."""
    h = F.md5(F.concat_ws("/", page_id.cast("string"), digest).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Write the records of ``pages`` to gzip files below ``path``."""
    resolved = resolve(pages)
    mean = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 0
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(_END))
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(""))
    block = F.concat(http, body)
    revisit = F.col("record_type") == "revisit"
    header = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("payload_digest"))),
        F.lit(f"WARC-Date: {DATE}"), F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.when(F.col("page_id").isNotNull(), F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string"))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("refers_to"), F.col("payload_digest")))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To-Target-URI: "), F.col("refers_url"))),
        F.when(revisit, F.lit(f"WARC-Refers-To-Date: {DATE}")),
        F.when(revisit, F.lit(f"WARC-Profile: {_PROFILE}")),
        F.when(revisit, F.concat(F.lit("X-Refers-To-Page-ID: "), F.col("refers_to").cast("string"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    (resolved.select(F.concat(header, F.lit(_END), block).alias("value")).write
     .option("lineSep", _END).option("compression", "gzip")
     .option("maxRecordsPerFile", max(1, int(FILE_BYTES / (mean + 600)))).text(path))


def read_records(stream):
    """(headers, block) of each record of a binary stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.partition(b":")
            headers[name.decode().lower()] = value.strip().decode()
        block = stream.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]) or stream.read(4) != _END.encode():
            raise ValueError("a record is cut off")
        yield headers, block


def read_archives(spark, path: str) -> DataFrame:
    """One row per record below ``path``: page_id, url, payload_bytes,
    payload_digest, record_type, refers_to, payload (null for revisits).  Digests
    of responses are computed from what is read, and must be the header's."""

    def scan(batches):
        for batch in batches:
            for raw in batch.column(0):
                rows, size = [], 0
                with gzip.open(io.BytesIO(raw.as_py())) as stream:
                    for h, block in read_records(stream):
                        payload = block.partition(b"\r\n\r\n")[2] if h["warc-type"] == "response" else None
                        digest = h["warc-payload-digest"].removeprefix("sha1:")
                        if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"wrong payload digest in {h['warc-record-id']}")
                        page, refers = h.get("x-page-id"), h.get("x-refers-to-page-id")
                        rows.append({"page_id": int(page) if page else None, "url": h["warc-target-uri"],
                                     "payload_bytes": len(payload) if payload is not None else int(h["x-payload-length"]),
                                     "payload_digest": digest, "record_type": h["warc-type"],
                                     "refers_to": int(refers) if refers else None, "payload": payload})
                        size += len(block) + 500
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=out)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=out)

    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                     ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(scan, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
                                  "refers_to long, payload binary")


def op6_warc_revisits(spark, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark).rstrip('/')}/warc/{uuid.uuid4().hex}"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
d AS (SELECT payload_digest, max(page_id) AS latest FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> latest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> latest THEN latest END AS refers_to
FROM p LEFT JOIN d USING (payload_digest)
"""
