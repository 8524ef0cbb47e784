"""WARC archives without repeated payloads: revisit resolution by payload digest.

Only headers (id, digest, size, address) are grouped by digest. Among payloads of at
least ``LEAST`` bytes that are equal, the row with the largest page_id becomes the
response and the others revisit it; smaller payloads are always responses. The
resolved headers go back to their pages by row key, which spreads a payload that many
pages share (here payloads are shuffled, unless the revisits are few enough to broadcast), and
each page becomes one record with fresh headers.

Archives are written by Spark's text writer: a record is a row, and the two line ends
that close a WARC record are the row separator; files are gzip-compressed as a whole
and hold at most ``FILE_RECORDS`` records. ``read`` parses the files alone, one record
in memory at a time beside the compressed file; what a revisit needs of its payload it takes
from the response that it refers to.

Defined cases: null html is an empty payload; a null page_id is never a response that
others refer to, unless all of a group lack one; repeated rows that all hold the largest
page_id are all responses; a null address becomes ``urn:page:<id>`` and control
characters in it are escaped; an empty table gives an archive without records.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from itertools import islice
from typing import BinaryIO

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.llm.common import SLICE_ROWS, _schema, as_batch, take, to_arrow_schema
from tidewatch.session import materialise, scratch_path

LEAST = 1000
FILE_RECORDS = 500
#: Fixed values of the format.
END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}{END}"
READ = ("page_id bigint, record_id string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string")


def payloads(pages: DataFrame) -> DataFrame:
    """page_id, address, payload, digest, bytes and the row's key."""
    rows = take(pages, page_id="bigint", url="string", html="string")
    address = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    payload = F.coalesce("html", F.lit(""))
    rows = rows.select("page_id", F.coalesce(address, F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))).alias("address"), payload.alias("payload"))
    return rows.select("*", F.sha1(F.col("payload").cast("binary")).alias("digest"), F.octet_length("payload").cast("bigint").alias("bytes"),
                       F.xxhash64("page_id", "address", "payload").alias("_k"))


def resolved(pages: DataFrame) -> DataFrame:
    """Every page with original_id and original_address, null for responses."""
    rows = payloads(pages)
    headers = rows.select("page_id", "address", "digest", "bytes", "_k").where(F.col("bytes") >= LEAST)
    originals = headers.groupBy("digest", "bytes").agg(F.max(F.struct("page_id", "address")).alias("o"), F.count("*").alias("n")).where("n > 1")
    revisits = (headers.join(originals, ["digest", "bytes"]).where("not (page_id <=> o.page_id)")
                .select("digest", "_k", F.col("o.page_id").alias("original_id"), F.col("o.address").alias("original_address")).distinct())
    return rows.join(revisits, ["digest", "_k"], "left")


def record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("none")), digest))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def record(date: str) -> Column:
    """A page's record without the two line ends that close it."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    revisit = F.col("original_id").isNotNull()
    only = lambda text: F.when(revisit, text).otherwise(F.lit(""))
    size = F.lit(len(HTTP)) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))
    return F.concat(
        F.lit(f"WARC/1.1{END}"), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_id(F.col("page_id"), F.col("digest"))), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("address")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.coalesce(line("X-Page-ID", F.col("page_id").cast("string")), F.lit("")),
        only(line("WARC-Profile", F.lit(PROFILE))), only(line("WARC-Refers-To", record_id(F.col("original_id"), F.col("digest")))),
        only(line("WARC-Refers-To-Target-URI", F.col("original_address"))), only(line("WARC-Refers-To-Date", F.lit(date))),
        only(line("X-Refers-To-Page", F.col("original_id").cast("string"))),
        line("Content-Type", F.lit("application/http;msgtype=response")), line("Content-Length", size.cast("string")),
        F.lit(END), F.lit(HTTP), F.when(revisit, F.lit("")).otherwise(F.col("payload")))


def write(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> None:
    (resolved(pages).select(F.coalesce(record(date), F.lit("")).alias("value")).write.option("maxRecordsPerFile", FILE_RECORDS)
     .text(folder, compression="gzip", lineSep=END + END))


def parsed(data: bytes | BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers (lower-case names) and the payload of every record; a stream is read one record at a time."""
    stream = io.BytesIO(data) if isinstance(data, bytes) else data
    while first := stream.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {first[:40]!r}")
        lines = iter(stream.readline, b"\r\n")
        head = {name.lower(): value for name, _, value in (x.decode().rstrip("\r\n").partition(": ") for x in lines)}
        block = stream.read(int(head["content-length"]))
        yield head, block[block.index(b"\r\n\r\n") + 4:]
        stream.read(len(END + END))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row a record; size and digest of a response are taken from its payload, of a revisit left to ``followed``."""
    arrow = to_arrow_schema(_schema(READ))

    def row(head, payload):
        response, page, to = head["warc-type"] == "response", head.get("x-page-id"), head.get("x-refers-to-page")
        digest = hashlib.sha1(payload).hexdigest() if response else None
        if response and head["warc-payload-digest"] != f"sha1:{digest}":
            raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
        return (int(page) if page else None, head["warc-record-id"] if response else head["warc-refers-to"], head["warc-type"],
                int(to) if to else None, len(payload) if response else None, digest)

    def run(batches):
        names = arrow.names
        for batch in batches:
            for content in batch.column(0):
                with gzip.open(io.BytesIO(content.as_py())) as stream:
                    found = (row(*one) for one in parsed(stream))
                    while rows := list(islice(found, SLICE_ROWS)):
                        yield as_batch(dict(zip(names, zip(*rows))), arrow)

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(run, READ)


def followed(records: DataFrame) -> DataFrame:
    """Revisits get size and digest of the response that they refer to."""
    responses = records.where("record_type = 'response'")
    held = responses.select("record_id", F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d")).distinct()
    revisits = (records.where("record_type = 'revisit'").join(held, "record_id", "left")
                .select("page_id", F.col("b").alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type", "refers_to"))
    return responses.select(*revisits.columns).unionByName(revisits)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives and return page_id, payload_bytes, payload_digest, record_type, refers_to as read back."""
    spark = pages.sparkSession
    folder = scratch_path(spark)
    write(pages, folder)
    return followed(materialise(read(spark, folder)))
