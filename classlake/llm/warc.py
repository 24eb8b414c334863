"""Web archives (WARC 1.1) with revisit records for repeated payloads.

Headers only (digest, length, page_id) are shuffled by payload digest to find each
payload's original, the record with the largest page_id; its copies become revisit
records without a payload.  The pages are then joined with their role and written
by Spark's text sink, one record a value: a record ends with two line breaks, which
is the sink's separator.  Archives hold at most ``per_file`` records each, so one
fits in a task's memory when it is read back.

Reading joins revisit records to the responses they refer to, by record id, which
gives them the length of the payload they stand for.

Defined results: a null payload is empty; payloads of fewer than ``least`` bytes are
always responses; rows equal in page_id and payload have the same role and record
id; a null page_id is the smallest, is written without the field and read as null;
line breaks and other control characters in a URL are percent-encoded, a null URL
is ``urn:none``; an empty table writes no record; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from classlake.llm.shared import bounded_batches, tidied, written

LEAST = 1000
PER_FILE = 5000
DATE = "2025-01-01T00:00:00Z"
CRLF = "\r\n"
#: Fixed value: the profile URI of revisits with an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page: F.Column, digest: F.Column) -> F.Column:
    h = F.md5(F.concat_ws("/", F.coalesce(page.cast("string"), F.lit("-")), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _plain(url: F.Column) -> F.Column:
    for c in [*range(33), 127]:
        url = F.replace(url, F.lit(chr(c)), F.lit(f"%{c:02X}")) if c in (0, 9, 10, 13, 32, 127) else url
    return F.coalesce(url, F.lit("urn:none"))


def with_roles(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html",
               least: int = LEAST) -> DataFrame:
    """(page_id, url, payload, digest, n, original, original_url): ``original`` is null for responses."""
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), _plain(F.col(url).cast("string")).alias("url"),
        F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"),
    ).withColumn("digest", F.sha1(F.col("payload").cast("binary"))).withColumn("n", F.octet_length("payload"))
    heads = rows.filter(F.col("n") >= least).select("page_id", "url", "digest", "n")
    last = heads.groupBy("digest", "n").agg(
        F.max(F.struct("page_id", "url")).alias("o"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    again = heads.select("page_id", "digest", "n").distinct().join(last, ["digest", "n"]).filter(
        "o.page_id is not null and (page_id is null or page_id <> o.page_id)").select(
        F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), F.col("o.page_id").alias("original"),
        F.col("o.url").alias("original_url"))
    return rows.join(again, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")),
                     "left").drop("_page", "_digest")


def records(rows: DataFrame, date: str = DATE) -> DataFrame:
    """One text value for each row of :func:`with_roles`: a record without its two closing line breaks."""
    revisit = F.col("original").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("n").cast("string"), F.lit(CRLF + CRLF))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))
    fields = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("digest"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string")),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("original"), F.col("digest")))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To-Target-URI: "), F.col("original_url"))),
        F.when(revisit, F.lit(f"WARC-Refers-To-Date: {date}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), length.cast("string")),
    ]
    head = F.concat(F.concat_ws(CRLF, *fields), F.lit(CRLF + CRLF))
    return rows.select(F.concat(head, http, F.when(revisit, "").otherwise(F.col("payload"))).alias("value"))


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html",
                   least: int = LEAST, date: str = DATE, per_file: int = PER_FILE) -> None:
    """Deduplicated, compressed archives in the folder ``path``."""
    out = records(with_roles(pages, page_id, url, payload, least), date)
    (out.write.option("lineSep", CRLF + CRLF).option("compression", "gzip")
     .option("maxRecordsPerFile", per_file).text(path))


def parse(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """(fields, block) of each record of an uncompressed archive."""
    at, view = 0, memoryview(data)
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        block = view[end + 4:end + 4 + size]
        if len(block) < size:
            raise ValueError(f"record at byte {at} is cut off")
        yield fields, block
        at = end + 4 + size + 4


READ = T.StructType([T.StructField(n, T.StringType()) for n in ("record_id", "record_type", "refers_to_id", "url",
                                                                 "digest")]
                    + [T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()),
                       T.StructField("payload_sha1", T.StringType()), T.StructField("payload", T.BinaryType())])


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of all archives in ``path``; a revisit's payload, length and computed digest are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                try:
                    data = zlib.decompress(content.as_py(), 47)
                    rows = []
                    for f, block in parse(data):
                        raw = bytes(block)
                        payload = raw[raw.index(b"\r\n\r\n") + 4:] if f["warc-type"] == "response" else None
                        rows.append({
                            "record_id": f["warc-record-id"], "record_type": f["warc-type"],
                            "refers_to_id": f.get("warc-refers-to"), "url": f.get("warc-target-uri"),
                            "digest": f.get("warc-payload-digest", "").removeprefix("sha1:"),
                            "page_id": int(f["x-page-id"]) if "x-page-id" in f else None,
                            "payload_bytes": None if payload is None else len(payload),
                            "payload_sha1": None if payload is None else hashlib.sha1(payload).hexdigest(),
                            "payload": payload if payloads else None})
                except (ValueError, KeyError, zlib.error) as e:
                    raise ValueError(f"{name.as_py()}: {e}") from e
                for at in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_pylist(rows[at:at + 1000], schema=_ARROW)

    bounded_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(tidied(run), READ)


_ARROW = pa.schema([(f.name, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[
    f.dataType.simpleString()]) for f in READ])


HOT = 64  # a response with more than one revisit in so many is hot, so there are fewer hot ones


def resolved(read: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to (page_id of the original).

    A revisit takes length and digest of the response it refers to; only
    revisits are joined.  Responses that very many refer to, of which there are
    fewer than ``HOT``, come by a broadcast, so their revisits stay where they are.
    """
    heads = written(read.drop("payload"))
    original = heads.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"),
        F.col("payload_bytes").alias("o_bytes"), F.col("payload_sha1").alias("o_sha1")).dropDuplicates(["refers_to_id"])
    revisits = heads.filter("record_type <> 'response' and refers_to_id is not null")
    often = revisits.groupBy("refers_to_id").agg(F.count(F.lit(1)).alias("n"))
    often = written(often)
    total = often.agg(F.sum("n")).first()[0] or 0
    hot = often.filter(F.col("n") * HOT > total).select("refers_to_id")
    few = F.broadcast(original.join(F.broadcast(hot), "refers_to_id"))
    near = revisits.join(few, "refers_to_id")
    rest = revisits.join(F.broadcast(few.select("refers_to_id")), "refers_to_id", "left_anti").join(original, "refers_to_id", "left")
    alone = heads.filter("record_type = 'response' or refers_to_id is null").select(
        "*", F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("long").alias("o_bytes"),
        F.lit(None).cast("string").alias("o_sha1"))
    return alone.unionByName(near).unionByName(rest).select(
        "page_id", F.coalesce("payload_bytes", "o_bytes").alias("payload_bytes"),
        F.coalesce("payload_sha1", "o_sha1").alias("payload_digest"), "record_type", "refers_to")
