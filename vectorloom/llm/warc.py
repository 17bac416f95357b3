"""WARC archives: one transaction of request, response and metadata records per page.

Writing. The text writer's line separator is the blank line pair that ends a WARC record, so a
row of the writer is exactly one record and each part file is a valid gzip-compressed archive of
``PART`` records at most (one gzip member, so it is read from its start).
Pages with equal payloads are found by digest (a map-side combined minimum, written before the
pages meet it, so that the pages of one digest can be split) and written as ``revisit`` records
that refer to the first page's response.

Reading. The text reader splits on the same blank lines; as gzip files aren't split, one task
sees a file's pieces in order and joins them again up to ``Content-Length``. It holds one
record, never a file. Request and metadata records then meet their response through
``WARC-Concurrent-To`` in a hash-partitioned aggregate on the transaction's record id, of which
each key has three rows, and leave as one nested row per capture.

Defined cases: a null html is an empty payload; payloads under 100 bytes are never revisits;
rows with a null ``page_id`` are archived as responses and are never referred to; pages that
repeat a ``page_id`` stay apart by a row number within the id; other columns are not carried.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import map_arrow, shared_dir, spool

CRLF = "\r\n"
END = "\r\n\r\n"
#: Equal payloads of fewer bytes are stored again.
LEAST = 100
DATE = "2024-01-01T00:00:00Z"
#: Records of a part file, which one task reads.
PART = 30_000


def _urn(kind: str, key: Column) -> Column:
    h = F.md5(F.concat(F.lit(kind + ":"), key))
    at = lambda i, n: F.substring(h, i, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", at(1, 8), at(9, 4), at(13, 4), at(17, 4), at(21, 12)), F.lit(">"))


def _clean(x: Column) -> Column:
    """A header value: no line ends, which would end the header."""
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"[\r\n]+", "%0A")


def with_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, bytes, digest, txn, refers_to and refers_txn (of the page that it refers to)."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), _clean(F.col("url")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.select("*", F.octet_length("html").cast("long").alias("bytes"), F.sha2("html", 256).alias("digest"))
    # Unique also among rows with one page_id: it is a digest of the whole row and its place.
    key = F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "url", "digest", F.monotonically_increasing_id().cast("string"))
    p = p.withColumn("txn", F.md5(key))
    groups = p.filter((F.col("bytes") >= least) & F.col("page_id").isNotNull()).groupBy("digest")
    first = groups.agg(F.min(F.struct("page_id", "txn")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = spool(first.select("digest", F.col("first.page_id").alias("first_id"), F.col("first.txn").alias("first_txn")), "payloads")
    again = (F.col("bytes") >= least) & (F.col("first_id") < F.col("page_id"))
    out = p.join(first, "digest", "left")
    return out.select("page_id", "url", "html", "bytes", "digest", "txn", F.when(again, F.col("first_id")).alias("refers_to"), F.when(again, F.col("first_txn")).alias("refers_txn"))


def records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """The text of each record up to its ending blank lines: three rows per page."""
    p = with_revisits(pages, least)
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(END)
    )
    revisit = F.col("refers_to").isNotNull()
    response_id = _urn("response", F.col("txn"))

    def record(kind: Column, rid: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
        head = [F.lit(f"WARC/1.1{CRLF}WARC-Type: "), kind, F.lit(f"{CRLF}WARC-Record-ID: "), rid]
        head += [F.lit(f"{CRLF}WARC-Date: {DATE}{CRLF}WARC-Target-URI: "), F.col("url")]
        head += [F.lit(f"{CRLF}WARC-Page-ID: "), F.coalesce(F.col("page_id").cast("string"), F.lit(""))]
        for name, value in headers:
            head.append(F.coalesce(F.concat(F.lit(f"{CRLF}{name}: "), value), F.lit("")))
        return F.concat(*head, F.lit(f"{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)

    response = record(
        F.when(revisit, "revisit").otherwise("response"),
        response_id,
        [
            ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
            ("WARC-Refers-To", F.when(revisit, _urn("response", F.col("refers_txn")))),
            ("WARC-Refers-To-Page-ID", F.col("refers_to").cast("string")),
            ("Content-Type", F.lit("application/http;msgtype=response")),
        ],
        F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html"))),
    )
    to_response = ("WARC-Concurrent-To", response_id)
    request = record(
        F.lit("request"),
        _urn("request", F.col("txn")),
        [to_response, ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), F.col("url"), F.lit(f" HTTP/1.1{END}")),
    )
    metadata = record(
        F.lit("metadata"),
        _urn("metadata", F.col("txn")),
        [to_response, ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("payloadLength: "), F.col("bytes").cast("string"), F.lit(CRLF)),
    )
    return p.select(F.explode(F.array(request, response, metadata)).alias("value"))


def write(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Part files of gzip-compressed WARC records under ``path``."""
    records(pages, least).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", PART).text(path)


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {k.strip().lower().decode(): v.strip().decode() for k, _, v in pairs}


class _Assembler:
    """Pieces between blank lines, in file order, to (headers, block); blocks may hold blank lines."""

    def __init__(self) -> None:
        self.head: dict[str, str] | None = None
        self.buffer = bytearray()

    def feed(self, piece: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self.buffer += piece
        self.buffer += END.encode()
        while True:
            if self.head is None:
                at = self.buffer.find(END.encode())
                if at < 0 or not self.buffer.startswith(b"WARC/"):
                    return
                self.head = _fields(bytes(self.buffer[:at]))
                del self.buffer[: at + len(END)]
            need = int(self.head["content-length"])
            if len(self.buffer) < need + len(END):
                return
            head, self.head = self.head, None
            block = bytes(self.buffer[:need])
            del self.buffer[: need + len(END)]
            yield head, block


RECORD = (
    "type string, record_id string, concurrent_to string, url string, page_id long, refers_to long,"
    " declared_digest string, payload_bytes long, payload_digest string, block_bytes long, payload binary"
)


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``; payload digests are computed anew."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        names = [c.strip().split()[0] for c in RECORD.split(",")]
        asm, file, rows, held = _Assembler(), None, [], 0
        flush = lambda r: pa.RecordBatch.from_arrays([pa.array([x[i] for x in r], k) for i, k in enumerate(kinds)], names)
        for b in batches:
            for piece, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if name != file:
                    asm, file = _Assembler(), name
                for head, block in asm.feed(piece):
                    kind = head["warc-type"]
                    n = digest = payload = None
                    if kind in ("response", "revisit"):
                        http, _, body = block.partition(END.encode())
                        n = int(_fields(http).get("content-length", len(body)))
                        digest = hashlib.sha256(body).hexdigest() if kind == "response" else head["warc-payload-digest"].partition(":")[2]
                        payload = body if with_payload and kind == "response" else None
                    num = lambda k: int(head[k]) if head.get(k) else None  # noqa: E731, B023
                    rows.append((kind, head["warc-record-id"], head.get("warc-concurrent-to"), head.get("warc-target-uri"), num("warc-page-id"), num("warc-refers-to-page-id"), head.get("warc-payload-digest", "").removeprefix("sha256:") or None, n, digest, len(block), payload))
                    held += len(payload or b"") + 500
                if held > 8 << 20:
                    yield flush(rows)
                    rows, held = [], 0
        if rows:
            yield flush(rows)

    pieces = spark.read.option("lineSep", END).text(path).select(F.col("value").cast("binary").alias("value"), F.input_file_name().alias("file"))
    return map_arrow(pieces, parse, RECORD)


def assemble(recs: DataFrame) -> DataFrame:
    """One nested row per capture: its response, and what is concurrent to it."""
    key = F.when(F.col("type").isin("response", "revisit"), F.col("record_id")).otherwise(F.col("concurrent_to"))
    own = F.col("type").isin("response", "revisit")
    one = lambda cond, cols: F.max_by(F.struct(*cols), F.when(cond, 1))
    r = ["type", "url", "page_id", "refers_to", "declared_digest", "payload_bytes", "payload_digest", "payload"]
    return (
        recs.withColumn("transaction", key)
        .filter("transaction IS NOT NULL")
        .groupBy("transaction")
        .agg(
            one(own, r).alias("response"),
            one(F.col("type") == "request", ["record_id", "url", "block_bytes"]).alias("request"),
            one(F.col("type") == "metadata", ["record_id", "block_bytes"]).alias("metadata"),
        )
        .filter("response IS NOT NULL")
    )


def query(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    got = assemble(read_records(spark, path, with_payload=False))
    return got.select(
        F.col("response.page_id").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.col("response.refers_to").alias("refers_to"),
    )


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN first_id END AS refers_to
FROM f
"""
