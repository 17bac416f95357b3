"""Queries over the driver's tables that exercise the operators, with their SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.replay import display_list
from ..sources import encode
from ..sources.metafiles import with_headers
from . import drawings, drawings_plus, streams
from .registry import QUERIES, SQL, dealt, query, t
from .render import render

__all__ = ["QUERIES", "SQL", "drawings", "drawings_plus", "streams"]

# Metafiles made from rows, and read back


def order_files(spark: SparkSession, d: str) -> DataFrame:
    """One EMF per order: a brush by its key, and a rectangle per line item."""
    lines = dealt(t(spark, d, "lineitem"), "l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q")))).alias("x"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, items in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                recs = [encode.brush(1, key & 0xFFFFFF), encode.select(1), encode.select(0x80000008)]
                out.append(encode.emf([*recs, *[encode.rectangle(0, i["l_linenumber"], i["q"], i["l_linenumber"] + 1) for i in items], encode.eof()], (0, 0, 64, 8)))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array(out, pa.binary())], ["path", "content"])

    return lines.mapInArrow(build, "path string, content binary")


@query("""SELECT l_orderkey, count(*) AS n_rects, sum(floor(l_quantity))::DOUBLE AS area,
  printf('#%02x%02x%02x', l_orderkey & 255, (l_orderkey >> 8) & 255, (l_orderkey >> 16) & 255) AS fill FROM lineitem GROUP BY l_orderkey""")
def metafile_roundtrip_area(spark, d):
    ops = display_list(with_headers(order_files(spark, d))).filter("op = 'fill'")
    p = F.col("geom")[0]["p"]
    return ops.groupBy(F.col("path").cast("long").alias("l_orderkey")).agg(F.count("*").alias("n_rects"), F.sum(p[2] * p[3]).alias("area"), F.first("fill").alias("fill"))


@query("""SELECT l_orderkey, 64 AS width, 8 AS height, sum(q)::BIGINT AS painted
  FROM (SELECT l_orderkey, l_linenumber, max(floor(l_quantity)) AS q FROM lineitem GROUP BY ALL) GROUP BY l_orderkey""")
def raster_pixel_area(spark, d):
    """Lines with one number overlap, so the widest counts."""
    return render(order_files(spark, d)).select(F.col("path").cast("long").alias("l_orderkey"), "width", "height", "painted")


@query("SELECT s_nationkey, printf('#%02x%02x%02x', s_suppkey & 255, (s_suppkey >> 8) & 255, 7) AS fill, count(*) AS n FROM supplier GROUP BY ALL")
def wmf_slot_reuse(spark, d):
    """One WMF per nation and 64 keys; each supplier's brush takes the slot that the one before it freed."""
    import struct

    path = F.concat_ws("/", "s_nationkey", F.expr("s_suppkey div 64"))
    sup = t(spark, d, "supplier").groupBy(path.alias("path")).agg(F.sort_array(F.collect_list("s_suppkey")).alias("x"))

    def build(batches):
        for b in batches:
            out = []
            for keys in b.column(1).to_pylist():
                recs = []
                for k in keys:
                    recs += [encode.wmf_record(0x2FC, struct.pack("<HIH", 0, (k & 0xFFFF) | 7 << 16, 0)), encode.wmf_record(0x12D, struct.pack("<H", 0))]
                    recs += [encode.wmf_record(0x41B, struct.pack("<4h", 20, 20, 10, 10)), encode.wmf_record(0x1F0, struct.pack("<H", 0))]
                out.append(encode.wmf(recs))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array(out, pa.binary())], ["path", "content"])

    ops = display_list(with_headers(sup.mapInArrow(build, "path string, content binary"))).filter("op = 'fill'")
    return ops.groupBy(F.substring_index("path", "/", 1).cast("int").alias("s_nationkey"), "fill").agg(F.count("*").alias("n"))


@query("SELECT p_brand, count(*) AS n, sum(p_size * 2)::DOUBLE AS area FROM part GROUP BY p_brand")
def emfplus_roundtrip(spark, d):
    """An EMF+ stream per brand and 64 keys: scaled FillRects with an inline colour."""
    import struct

    path = F.concat_ws("/", "p_brand", F.expr("p_partkey div 64"))
    parts = t(spark, d, "part").groupBy(path.alias("path")).agg(F.collect_list("p_size").alias("x"))

    def build(batches):
        for b in batches:
            out = []
            for sizes in b.column(1).to_pylist():
                recs = [encode.plus_record(0x402E, 0, struct.pack("<ff", 2.0, 1.0))]
                recs += [encode.plus_record(0x400A, 0x8000, struct.pack("<II4f", 0xFF102030, 1, 0, 0, s, 1)) for s in sizes]
                out.append(encode.emf([encode.plus_comment(recs), encode.eof()]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["path", "content"])

    ops = display_list(with_headers(parts.mapInArrow(build, "path string, content binary")))
    p, m = F.col("geom")[0]["p"], F.col("transform")
    return ops.groupBy(F.substring_index("path", "/", 1).alias("p_brand")).agg(F.count("*").alias("n"), F.sum(p[2] * m[0] * p[3] * m[3]).alias("area"))


# Scalars


@query("""SELECT p_partkey, greatest(1, least(8192, floor(w1 * f2 + 0.5)))::BIGINT AS w, greatest(1, least(8192, floor(h1 * f2 + 0.5)))::BIGINT AS h FROM (
  SELECT *, CASE WHEN h1 > 900 THEN 900 / h1 ELSE 1.0 END AS f2 FROM (
  SELECT *, floor(cw * f1 + 0.5) AS w1, floor(ch * f1 + 0.5) AS h1 FROM (
  SELECT *, CASE WHEN cw > 4000 THEN 4000 / cw ELSE 1.0 END AS f1 FROM (
  SELECT p_partkey, floor(p_size * 100 * s + 0.5)::DOUBLE AS cw, floor(p_retailprice * s + 0.5)::DOUBLE AS ch FROM (SELECT *, greatest(1.0, least(4.0, p_size / 10.0)) AS s FROM part)))))""")
def canvas_fit(spark, d):
    w, h = S.canvas_size(F.col("p_size") * 100, F.col("p_retailprice"), F.lit(4000), F.lit(900), F.col("p_size") / 10.0)
    return t(spark, d, "part").select("p_partkey", w.alias("w"), h.alias("h"))


@query("SELECT item_id, 'data:image/png;base64,' || base64(encode(text)) AS url FROM benchmark")
def data_url(spark, d):
    return t(spark, d, "benchmark").select("item_id", S.data_url(F.encode("text", "UTF-8")).alias("url"))


@query("SELECT 'emf' AS stream, 'unhandled record type ' || (200 + n_regionkey) AS message, count(*) AS n FROM nation GROUP BY ALL")
def diagnostics_by_message(spark, d):
    """One EMF per nation with a record of an unknown type, numbered by its region."""
    from ..operators.diagnostics import diagnostics

    def build(batches):
        for b in batches:
            out = [encode.emf([encode.emf_record(200 + k), encode.eof()]) for k in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array(out, pa.binary())], ["path", "content"])

    files = t(spark, d, "nation").select("n_nationkey", "n_regionkey").mapInArrow(build, "path string, content binary")
    return diagnostics(with_headers(files)).groupBy("stream", "message").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '1.0' ELSE p_size || '.0' END || ',0.0,' || CASE WHEN p_size % 3 = 0 THEN '0.0' ELSE '2.5' END || ',1.0,' || p_size || '.5,0.0' AS m FROM part")
def finite_matrices(spark, d):
    """Transforms with numbers that aren't finite, or missing."""
    z = F.col("p_size")
    bad = lambda c, v, other: F.when(c, F.lit(float(v))).otherwise(other)
    m = F.array(bad(z % 5 == 0, "nan", z.cast("double")), F.lit(0.0), bad(z % 3 == 0, "-inf", F.lit(2.5)), F.lit(None).cast("double"), z + 0.5, F.lit(float("inf")))
    return t(spark, d, "part").select("p_partkey", F.array_join(S.finite_matrix(m), ",").alias("m"))
