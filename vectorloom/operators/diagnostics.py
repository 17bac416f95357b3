"""What went wrong or was left out, by file: rows instead of log lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .embedded import lost
from .framing import records, unhandled
from .replay import display_list


def diagnostics(files: DataFrame, max_records: int | None = None) -> DataFrame:
    """(path, stream, seq, level, message) of files with headers; unknown WMF records are ignored silently."""
    recs = records(files, max_records)
    none = F.lit(None).cast("int")
    bad = files.filter("bounds IS NULL").select("path", F.col("kind").alias("stream"), none.alias("seq"), F.lit("warn").alias("level"), F.lit("no renderable header").alias("message"))
    odd = unhandled(recs).filter("stream <> 'wmf'").select("path", "stream", "seq", F.lit("warn").alias("level"), F.concat(F.lit("unhandled record type "), F.col("rtype")).alias("message"))
    # The cap of an EMF+ stream holds per comment; its row names the comment's record.
    full = recs.groupBy("path", "stream", F.col("parent_seq").alias("seq")).agg(F.count("*").alias("n"))
    most = F.when(F.col("stream") == "emfplus", max_records or K.MAX_PLUS_RECORDS).otherwise(max_records or K.MAX_RECORDS)
    full = full.filter(F.col("n") >= most).select("path", "stream", "seq", F.lit("warn").alias("level"), F.lit("record limit reached").alias("message"))
    return bad.unionByName(odd).unionByName(full).unionByName(lost_images(files, max_records))


def lost_images(files: DataFrame, max_records: int | None = None) -> DataFrame:
    """Images of EMF+ that no decoder here can draw or that are nested too deep, one row each."""
    ops = display_list(files, max_records=max_records).filter("op = 'image' AND phase = 1 AND image_w IS NULL")
    bare = ops.select("path", "seq", "image", "is_metafile")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = [lost(x, m) for x, m in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(kinds, pa.list_(pa.string()))], ["path", "seq", "kinds"])

    gone = bare.mapInArrow(judge, "path string, seq int, kinds array<string>").select("path", "seq", F.explode("kinds").alias("kind"))
    return gone.select("path", F.lit("emfplus").alias("stream"), "seq", F.lit("warn").alias("level"), F.concat(F.lit("image not drawn: "), "kind").alias("message"))
