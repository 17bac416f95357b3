"""Queries on framing, headers, diagnostics and rendered files, with their SQL."""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators.diagnostics import diagnostics
from ..operators.framing import dispatched, histogram, names, records, unhandled
from ..operators.replay import inverted
from ..sources import encode as E
from ..sources.metafiles import Options, with_headers
from .drawings import files, parts
from .drawings_plus import V, obj, plus
from .registry import query, t
from .render import render

# Streams of a user's events, a record per event; a file has at most BLOCK of them, so no file grows with the table

BLOCK = 512
#: SQL: the events with their file, their place in it, and the number of their record type.
_EVENTS = f"""(SELECT *, row_number() OVER (PARTITION BY path ORDER BY event_id) AS i FROM (SELECT event_id, event_type, user_id || '/' || event_id // {BLOCK} AS path,
  CASE event_type WHEN 'view' THEN 27 WHEN 'click' THEN 54 WHEN 'purchase' THEN 70 ELSE 200 END AS rtype FROM events))"""


def _event(kind: str) -> bytes:
    """A view moves, a click draws, a purchase is a comment with two EMF+ records, an error is a record of an unknown type."""
    moves = {"view": E.emf_record(27, bytes(8)), "click": E.emf_record(54, bytes(8)), "purchase": plus(E.plus_record(0x401E), E.plus_record(0x4FFF))}
    return moves.get(kind, E.emf_record(200))


def event_files(spark: SparkSession, d: str, end: bool = False) -> DataFrame:
    """One EMF per user and block of event ids, its events in order; with ``end``, an error ends the stream."""
    x = F.sort_array(F.collect_list(F.struct("event_id", "event_type")))
    path = F.concat_ws("/", "user_id", F.expr(f"event_id div {BLOCK}"))
    users = t(spark, d, "events").groupBy(path.alias("path")).agg(F.transform(x, lambda e: e["event_type"]).alias("x"))
    stop = E.eof()
    return files(users, lambda r: E.emf([stop if end and e == "error" else _event(e) for e in r["x"]] + [stop]))


_ENDS = f"SELECT path, 'emf' AS stream, unnest([1, 14]) AS rtype, 1 AS n FROM (SELECT DISTINCT path FROM {_EVENTS})"
_INNER = f"SELECT path, 'emfplus' AS stream, unnest([16414, 20479]) AS rtype, count(*) AS n FROM {_EVENTS} WHERE event_type = 'purchase' GROUP BY path"


@query(f"""SELECT path, stream, rtype, n::BIGINT AS n FROM (
  SELECT path, 'emf' AS stream, rtype, count(*) AS n FROM {_EVENTS} GROUP BY ALL UNION ALL {_ENDS} UNION ALL {_INNER})""")
def stream_histogram(spark, d):
    """Records by file, stream and type; EMF+ records are found in comments."""
    return histogram(records(with_headers(event_files(spark, d))))


@query(f"""SELECT path, stream, rtype, n::BIGINT AS n FROM (
  SELECT path, 'emf' AS stream, rtype, count(*) AS n FROM {_EVENTS} WHERE rtype = 200 GROUP BY ALL
  UNION ALL SELECT path, 'emfplus' AS stream, 20479 AS rtype, count(*) AS n FROM {_EVENTS} WHERE event_type = 'purchase' GROUP BY path)""")
def stream_unhandled(spark, d):
    """Records of types that nothing handles."""
    return histogram(unhandled(records(with_headers(event_files(spark, d)))))


_CAP = 4


@query(f"""SELECT path, stream, level, message, count(*) AS n FROM (
  SELECT path, 'emf' AS stream, 'warn' AS level, 'record limit reached' AS message FROM {_EVENTS} GROUP BY path HAVING count(*) + 2 >= {_CAP}
  UNION ALL SELECT path, 'emf', 'warn', 'unhandled record type 200' FROM {_EVENTS} WHERE rtype = 200 AND i < {_CAP}
  UNION ALL SELECT path, 'emfplus', 'warn', 'unhandled record type 20479' FROM {_EVENTS} WHERE event_type = 'purchase' AND i < {_CAP}) GROUP BY ALL""")
def stream_caps(spark, d):
    """Diagnostics of streams cut at four records; the EMF+ stream of a comment has two and isn't cut."""
    out = diagnostics(with_headers(event_files(spark, d)), max_records=_CAP)
    return out.groupBy("path", "stream", "level", "message").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey::BIGINT AS k, 2 AS n_emf, least(2 + p_size % 5, 3) AS n_plus, CASE WHEN 2 + p_size % 5 >= 3 THEN 1 ELSE 0 END AS n_limit FROM part""")
def stream_cap_of_comments(spark, d):
    """The cap of three also bounds the EMF+ records of one comment, and its row names the comment."""

    def build(r):
        return E.emf([plus(*[E.plus_record(0x401E)] * (2 + r["z"] % 5))])

    made = with_headers(files(parts(spark, d), build))
    n = records(made, 3).groupBy("path").agg(F.count_if(F.col("stream") == "emf").alias("n_emf"), F.count_if(F.col("stream") == "emfplus").alias("n_plus"))
    cut = diagnostics(made, 3).filter("stream = 'emfplus' AND seq = 1 AND message = 'record limit reached'").groupBy("path").agg(F.count("*").alias("n_limit"))
    out = n.join(cut, "path", "left")
    return out.select(F.col("path").cast("long").alias("k"), F.col("n_emf").cast("int").alias("n_emf"), F.col("n_plus").cast("int").alias("n_plus"), F.coalesce("n_limit", F.lit(0)).cast("int").alias("n_limit"))


@query(f"SELECT path, (coalesce(min(CASE WHEN event_type = 'error' THEN i END), max(i) + 1) + 1)::BIGINT AS n FROM {_EVENTS} GROUP BY path")
def stream_terminator(spark, d):
    """Framing stops at the first end record."""
    return records(with_headers(event_files(spark, d, end=True))).filter("stream = 'emf'").groupBy("path").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey::BIGINT AS k, (2 + p_size % 4)::BIGINT AS n, CASE p_partkey % 3 WHEN 0 THEN 3 ELSE 2 END::BIGINT AS n_wmf FROM part""")
def stream_malformed(spark, d):
    """Framing stops at a size under the header's or past the file's end, and at a WMF record of type 0."""

    def build(r):
        return E.emf([E.emf_record(27, bytes(8))] * (1 + r["z"] % 4) + [struct.pack("<II", 27, 4 if r["k"] % 2 else 4000), E.emf_record(54, bytes(8))])

    def build_wmf(r):
        bad = {0: E.wmf_record(0x1E), 1: struct.pack("<IH", 1, 0x1E), 2: struct.pack("<IH", 900, 0x1E)}[r["k"] % 3]
        return E.wmf([E.wmf_record(0x1E), E.wmf_record(0x127), bad])

    count = lambda made, c: records(with_headers(made)).groupBy(F.col("path").cast("long").alias("k")).agg(F.count("*").alias(c))
    return count(files(parts(spark, d), build), "n").join(count(files(parts(spark, d), build_wmf), "n_wmf"), "k")


@query("SELECT k AS rtype, v AS name FROM (SELECT unnest([" + ", ".join(str(k) for k in sorted(K.EMF) if k not in K.EMF_SKIPPED) + "]) AS k, unnest([" + ", ".join(f"'{K.EMF[k]}'" for k in sorted(K.EMF) if k not in K.EMF_SKIPPED) + "]) AS v)")
def stream_names(spark, d):
    """Every EMF type in one file: all are named, none is unhandled, and the skipped ones aren't dispatched."""
    one = t(spark, d, "region").filter("r_regionkey = 0").select("r_regionkey")
    made = with_headers(files(one, lambda r: E.emf([E.emf_record(k) for k in sorted(K.EMF) if k not in (1, 14)] + [E.eof()])))
    recs = records(made)
    known = dispatched(recs).join(F.broadcast(names(spark)), ["stream", "rtype"])
    return known.join(unhandled(recs).select("path").distinct(), "path", "left_anti").select("rtype", "name").distinct()


# Headers and canvas sizes


def _header(r: dict) -> bytes:
    k, z = r["k"], r["z"]
    if k % 4 == 3:
        placeable = struct.pack("<IH4hHIH", K.PLACEABLE, 0, 1, 2, 1 + z, 2 + k % 50, z % 3 * 96, 0, 0)
        return (placeable if k % 8 == 3 else b"") + struct.pack("<HHHIHIH", 1 + z % 3, 9, 0x300, 0, 0, 0, 0) + E.wmf_record(0)
    bounds = (z, 1, z + 40, 1 + k % 30) if k % 4 else (5, 5, 5, 5)
    return E.emf([E.eof()], bounds, (10, 10, 10 + k % 5 * 100, 300))


@query("""SELECT id, kind, "left", "right", bottom, CASE WHEN "right" > "left" AND bottom > top THEN header_size END AS header_size,
    CASE WHEN "right" > "left" AND bottom > top THEN floor(floor((("right" - "left") * 2)::DOUBLE * f1 + 0.5) * f2 + 0.5)::BIGINT END AS w,
    CASE WHEN "right" > "left" AND bottom > top THEN greatest(1, floor(floor(((bottom - top) * 2)::DOUBLE * f1 + 0.5) * f2 + 0.5))::BIGINT END AS h FROM (
  SELECT *, CASE WHEN floor(((bottom - top) * 2)::DOUBLE * f1 + 0.5) > 50 THEN 50 / floor(((bottom - top) * 2)::DOUBLE * f1 + 0.5) ELSE 1.0 END AS f2 FROM (
  SELECT *, CASE WHEN ("right" - "left") * 2 > 70 THEN 70.0::DOUBLE / (("right" - "left") * 2) ELSE 1.0::DOUBLE END AS f1 FROM (
  SELECT p_partkey::BIGINT AS id, CASE WHEN k % 8 = 3 THEN 'wmf' ELSE 'emf' END AS kind, 0::BIGINT + CASE WHEN k % 8 = 3 THEN 18 ELSE 0 END + CASE WHEN k % 8 = 3 THEN 22 ELSE 0 END AS header_size,
    CASE WHEN k % 8 = 3 AND z % 3 < 2 THEN 1 WHEN k % 4 IN (1, 2) AND k % 30 > 0 THEN z WHEN k % 4 < 3 AND k % 5 > 0 THEN 0 END::BIGINT AS "left",
    CASE WHEN k % 8 = 3 AND z % 3 < 2 THEN 2 WHEN k % 4 IN (1, 2) AND k % 30 > 0 THEN 1 WHEN k % 4 < 3 AND k % 5 > 0 THEN 0 END::BIGINT AS top,
    CASE WHEN k % 8 = 3 AND z % 3 < 2 THEN 1 + z WHEN k % 4 IN (1, 2) AND k % 30 > 0 THEN z + 40 WHEN k % 4 < 3 AND k % 5 > 0 THEN k % 5 * 100 END::BIGINT AS "right",
    CASE WHEN k % 8 = 3 AND z % 3 < 2 THEN 2 + k % 50 WHEN k % 4 IN (1, 2) AND k % 30 > 0 THEN 1 + k % 30 WHEN k % 4 < 3 AND k % 5 > 0 THEN 290 END::BIGINT AS bottom
  FROM (SELECT p_partkey, p_partkey AS k, p_size AS z FROM part)))) WHERE "right" > "left" AND bottom > top""")
def headers_and_canvas(spark, d):
    """Kinds, bounds with the frame as fallback, header sizes, and canvases fitted to the options."""
    h = with_headers(files(parts(spark, d), _header), Options(max_width=70, max_height=50, dpi_scale=2)).filter("bounds IS NOT NULL")
    return h.select(F.col("path").cast("long").alias("id"), "kind", F.col("bounds.left").alias("left"), F.col("bounds.right").alias("right"), F.col("bounds.bottom").alias("bottom"),
                    F.col("header_size").cast("long").alias("header_size"), F.col("canvas_w").cast("long").alias("w"), F.col("canvas_h").cast("long").alias("h"))


# Rendered files


def _hex(png) -> F.Column:
    return F.lower(F.hex(F.unbase64(F.substring_index(png, ",", -1))))


@query("""SELECT p_partkey::BIGINT AS id, 'data:image/png;base64' AS head, printf('89504e470d0a1a0a0000000d49484452%08x%08x0806000000', w, 9) AS png, (least(p_size, w) * 4)::BIGINT AS painted
  FROM (SELECT *, 20 + p_partkey % 7 AS w FROM part)""")
def png_bytes(spark, d):
    """Signature and header of the PNG inside the data URL, and the painted pixels."""

    def build(r):
        return E.emf([E.brush(1, 255), E.select(1), E.select(0x80000008), E.rectangle(0, 2, r["z"], 6), E.eof()], (0, 0, 20 + r["k"] % 7, 9))

    out = render(files(parts(spark, d), build))
    return out.select(F.col("path").cast("long").alias("id"), F.substring_index("data_url", ",", 1).alias("head"), F.substring(_hex(F.col("data_url")), 1, 58).alias("png"), "painted")


@query("""SELECT p_partkey::BIGINT AS id, (w * 5 - greatest(0, least(w, 4) - 2) * 2 + CASE WHEN p_partkey % 2 = 1 THEN 3 ELSE 0 END)::BIGINT AS painted
  FROM (SELECT p_partkey, p_size % 16 AS w FROM part)""")
def painted_clips(spark, d):
    """Painted pixels under GDI clips that intersect and exclude, and beside them those under an EMF+ clip with a gradient."""

    def build(r):
        gradient = V + struct.pack("<IIIffffII8x", 4, 0, 0, 16, 6, 4, 2, 0xFF000000, 0xFFFFFFFF)
        use = plus(obj(1, 1, gradient), E.plus_record(0x4032, 0, struct.pack("<4f", 16, 6, 3, 1)), E.plus_record(0x400A, 0, struct.pack("<II4f", 1, 1, 16, 6, 4, 2)))
        clips = [E.emf_record(30, struct.pack("<4i", 0, 0, r["z"] % 16, 5)), E.emf_record(29, struct.pack("<4i", 2, 1, 4, 3))]
        return E.emf([E.select(0x80000008), *clips, E.rectangle(0, 0, 20, 8), *([use] if r["k"] % 2 else []), E.eof()], (0, 0, 20, 8))

    return render(files(parts(spark, d), build)).select(F.col("path").cast("long").alias("id"), "painted")


@query("SELECT n_nationkey::BIGINT AS id, 800 AS width, 600 AS height, (10 * (n_nationkey + 1))::BIGINT AS painted FROM nation")
def plain_wmf(spark, d):
    """WMFs without a placeable header, known by their names, on the default canvas."""
    named = t(spark, d, "nation").select(F.concat(F.col("n_nationkey").cast("string"), F.lit(".WMF")).alias("path"), "n_nationkey")
    head = struct.pack("<HHHIHIH", 1, 9, 0x300, 0, 0, 0, 0)

    def build(r):
        pens = E.wmf_record(0x2FA, struct.pack("<HhhI", 5, 0, 0, 0)) + E.wmf_record(0x12D, struct.pack("<H", 0))
        return head + pens + E.wmf_record(0x41B, struct.pack("<4h", 10, r["n_nationkey"] + 1, 0, 0)) + E.wmf_record(0)

    return render(files(named, build)).select(F.regexp_extract("path", r"\d+", 0).cast("long").alias("id"), "width", "height", "painted")


def _png(w: int, h: int) -> bytes:
    """An opaque grey PNG, its rows filtered by their differences."""
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    rows = (b"\x01\x50" + bytes(w - 1)) * h
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def _nested(depth: int, w: int) -> bytes:
    out = E.emf([E.select(0x80000008), E.rectangle(0, 0, w, 2), E.eof()], (0, 0, w, 2))
    for _ in range(depth):
        out = E.emf([plus(obj(5, 5, V + struct.pack("<III", 2, 0, len(out)) + out), _show(w)), E.eof()], (0, 0, w, 2))
    return out


def _show(w: int) -> bytes:
    return E.plus_record(0x401A, 5, bytes(24) + struct.pack("<4f", 0, 0, w, 2))


def _pictures(r: dict) -> bytes:
    """By key: a PNG, a bitmap file, metafiles nested to a depth of up to five, a plain WMF, and a JPEG."""
    k, w = r["k"], 1 + r["z"] % 9
    if k % 9 < 5:
        return _nested(1 + k % 9, w)
    bmp = b"BM" + struct.pack("<I4xI", 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, 2, 1, 24, 0, 0, 0, 0, 0, 0) + bytes(2 * ((3 * w + 3) // 4 * 4))
    plain = struct.pack("<HHHIHIH", 1, 9, 0x300, 0, 0, 0, 0) + E.wmf_record(0x41B, struct.pack("<4h", 600, 800, 0, 0)) + E.wmf_record(0)
    body = {5: V + struct.pack("<IiiiiI", 1, 0, 0, 0, 0, 1) + _png(w, 2), 6: V + struct.pack("<IiiiiI", 1, 0, 0, 0, 0, 1) + bmp, 7: V + struct.pack("<III", 2, 0, len(plain)) + plain,
            8: V + struct.pack("<IiiiiI", 1, 0, 0, 0, 0, 1) + b"\xff\xd8\xff\xe0" + bytes(20)}[k % 9]
    return E.emf([plus(obj(5, 5, body), _show(w)), E.eof()], (0, 0, 20, 2))


@query("SELECT p_partkey::BIGINT AS id, CASE WHEN p_partkey % 9 IN (3, 4, 8) THEN 0 ELSE 2 * (1 + p_size % 9) END::BIGINT AS painted, CASE WHEN p_partkey % 9 IN (3, 4) THEN 'image not drawn: metafile' WHEN p_partkey % 9 = 8 THEN 'image not drawn: jpeg' ELSE '' END AS message FROM part")
def embedded_images(spark, d):
    """Painted pixels of embedded pictures of each kind, metafiles up to three deep, and a row for each that isn't drawn."""
    made = files(parts(spark, d), _pictures)
    lost = diagnostics(with_headers(made)).filter("message LIKE 'image not drawn%'").select("path", "message")
    out = render(made).join(lost, "path", "left")
    return out.select(F.col("path").cast("long").alias("id"), "painted", F.coalesce("message", F.lit("")).alias("message"))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN printf('#%02x%02x%02x', 255 - (c_custkey & 255), 255 - ((c_custkey >> 4) & 255), 255 - c_nationkey)
  WHEN 1 THEN printf('rgba(%d,%d,%d,0.500)', 255 - (c_custkey & 255), 255 - ((c_custkey >> 4) & 255), 255 - c_nationkey) WHEN 2 THEN printf('rgb(%d,0,255)', 255 - c_nationkey)
  WHEN 3 THEN printf('#%02x00ff', 255 - 17 * (c_nationkey % 10)) ELSE 'red' END AS css FROM customer""")
def inverted_colors(spark, d):
    """The inverse of every form of a colour: channels are cut off at 255, letters may be of either case."""
    r, g, b, k = F.col("c_custkey").bitwiseAND(F.lit(255)), F.shiftright("c_custkey", 4).bitwiseAND(F.lit(255)), F.col("c_nationkey"), F.col("c_custkey") % 5
    css = F.when(k == 0, F.upper(F.format_string("#%02x%02x%02x", r, g, b))).when(k == 1, F.format_string("RGBA( %d, %d,%d , 0.500)", r, g, b)).when(k == 2, F.format_string("rgb(%d,300,0)", b))
    css = css.when(k == 3, F.format_string("#%dF0", b % 10)).otherwise("red")

    def run(batches):
        for x in batches:
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array([inverted(c) for c in x.column(1).to_pylist()], pa.string())], ["c_custkey", "css"])

    own = t(spark, d, "customer").select("c_custkey", css.alias("css"))
    return own.mapInArrow(run, f"c_custkey {dict(own.dtypes)['c_custkey']}, css string")
