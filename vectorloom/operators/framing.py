"""Record framing of the three streams, one file in and its records out."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K


class Record(NamedTuple):
    seq: int
    off: int
    rtype: int
    flags: int
    size: int
    data: int
    data_size: int


def emf_records(b: bytes, most: int = K.MAX_RECORDS) -> Iterator[Record]:
    """Through EMR_EOF, the first malformed size, or ``most`` records."""
    off = seq = 0
    while off + 8 <= len(b) and seq < most:
        rtype, size = struct.unpack_from("<II", b, off)
        if size < 8 or off + size > len(b):
            return
        yield Record(seq, off, rtype, 0, size, off + 8, size - 8)
        if rtype == 14:
            return
        off, seq = off + size, seq + 1


def plus_records(b: bytes, off: int, end: int, most: int = K.MAX_PLUS_RECORDS) -> Iterator[Record]:
    """The EMF+ records of one comment; the cap holds per comment."""
    seq = 0
    while off + 12 <= end and seq < most:
        rtype, flags, size, data_size = struct.unpack_from("<HHII", b, off)
        if size < 12 or off + size > end:
            return
        yield Record(seq, off, rtype, flags, size, off + 12, min(data_size, size - 12))
        if rtype == 0x4002:
            return
        off, seq = off + size, seq + 1


def plus_comment(b: bytes, r: Record) -> tuple[int, int] | None:
    """The span of the EMF+ stream in a comment record, if it has one."""
    if r.rtype != 70 or r.size < 16:
        return None
    data_size, signature = struct.unpack_from("<II", b, r.data)
    if signature != K.EMFPLUS_SIGNATURE or data_size <= 4:
        return None
    return r.data + 8, min(r.data + 4 + data_size, r.off + r.size)


def wmf_records(b: bytes, off: int, most: int = K.MAX_RECORDS) -> Iterator[Record]:
    seq = 0
    while off + 6 <= len(b) and seq < most:
        words, rtype = struct.unpack_from("<IH", b, off)
        size = 2 * words
        if size < 6 or off + size > len(b) or rtype == 0:
            return
        yield Record(seq, off, rtype, 0, size, off + 6, size - 6)
        off, seq = off + size, seq + 1


SCHEMA = "path string, stream string, seq int, parent_seq int, off long, rtype int, flags int, size long, data_off long, data_size long"


def records(files: DataFrame, max_records: int | None = None) -> DataFrame:
    """(path, content, kind, header_size) to the rows of all streams; a null content has none.

    ``max_records`` bounds each stream, where an EMF+ stream is the part in one comment.
    """
    most, most_plus = max_records or K.MAX_RECORDS, max_records or K.MAX_PLUS_RECORDS

    def frame(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            rows: list[tuple] = []
            for path, content, kind, head in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                b = content or b""
                if kind == "wmf":
                    rows += [(path, "wmf", r.seq, None, *r[1:]) for r in wmf_records(b, head, most)]
                    continue
                for r in emf_records(b, most):
                    rows.append((path, "emf", r.seq, None, *r[1:]))
                    if span := plus_comment(b, r):
                        rows += [(path, "emfplus", p.seq, r.seq, *p[1:]) for p in plus_records(b, *span, most_plus)]
            for lo in range(0, len(rows), 50_000):
                part = list(zip(*rows[lo : lo + 50_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(part, kinds, strict=True)], names)

    return files.select("path", "content", "kind", "header_size").mapInArrow(frame, SCHEMA)


def histogram(recs: DataFrame) -> DataFrame:
    return recs.groupBy("path", "stream", "rtype").agg(F.count("*").alias("n"))


def names(spark) -> DataFrame:
    """stream, rtype, name of every handled record type: 138 rows."""
    rows = [(s, k, v) for s, t in (("emf", K.EMF), ("emfplus", K.EMFPLUS), ("wmf", K.WMF)) for k, v in t.items()]
    return spark.createDataFrame(rows, "stream string, rtype int, name string")


def unhandled(recs: DataFrame) -> DataFrame:
    """Records of unknown types; the handled ones are a fixed table, small enough to broadcast."""
    return recs.join(F.broadcast(names(recs.sparkSession)), ["stream", "rtype"], "left_anti")


def dispatched(recs: DataFrame) -> DataFrame:
    return recs.filter(~((F.col("stream") == "emf") & F.col("rtype").isin(*K.EMF_SKIPPED)))
