"""Queries that put rows through the whole engine: rows become records of metafiles, the files are
replayed, and each operation of the display list is compared as a line of text with SQL.

A line has the operation, its path (numbers in thousandths) and its attributes by letter: f fill,
r rule, s stroke, w width, d dash, g composite operation, t transform, c clip, e=0 an inexact clip,
x text, n font, a alignment, b baseline, i size and pixels of an image, and k a gradient.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.replay import display_list
from ..sources import encode as E
from ..sources.metafiles import with_headers
from .registry import dealt, query, t

# Files from rows


def files(df: DataFrame, build: Callable[[dict], bytes]) -> DataFrame:
    """One file per row, by its first column."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [build(dict(zip(names, row, strict=True))) for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array(out, pa.binary())], ["path", "content"])

    return dealt(df).mapInArrow(run, "path string, content binary")


GEOM = "array_join(transform({0}, c -> concat_ws(' ', array(c.cmd), transform(c.p, v -> cast(cast(round(v * 1000) AS bigint) AS string)))), ' ')"
GRADIENT = """transform(array(from_json(gradient, 'type string, x0 double, y0 double, x1 double, y1 double, cx double, cy double, r double, stops array<struct<offset:double,color:string>>')), g ->
  concat(g.type, ':', concat_ws(',', transform(array(g.x0, g.y0, g.x1, g.y1, g.cx, g.cy, g.r), v -> cast(cast(round(v * 1000) AS bigint) AS string))),
  array_join(transform(g.stops, s -> concat(';', cast(round(s.offset * 1000) AS bigint), '@', s.color)), '')))[0]"""
NUMBERS = "array_join(transform({0}, v -> cast(cast(round(v * 1000) AS bigint) AS string)), ',')"
LINE = f"""concat_ws(' ', op, {GEOM.format("geom")}, 'f=' || fill, CASE WHEN op = 'fill' THEN 'r=' || fill_rule END, 's=' || stroke,
  'w=' || cast(round(line_width * 1000) AS bigint), CASE WHEN size(dash) > 0 THEN 'd=' || {NUMBERS.format("dash")} END,
  CASE WHEN gco <> 'source-over' THEN 'g=' || gco END, CASE WHEN transform IS NOT NULL THEN 't=' || {NUMBERS.format("transform")} END,
  CASE WHEN clip IS NOT NULL THEN 'c=' || array_join(transform(clip, z -> z.rule || ':' || {GEOM.format("z.cmds")}), '/') END, CASE WHEN NOT clip_exact THEN 'e=0' END,
  'x=' || text, 'n=' || font, 'a=' || align, 'b=' || baseline, CASE WHEN image_w IS NOT NULL THEN concat('i=', image_w, 'x', image_h, ':', lower(hex(image))) END,
  CASE WHEN gradient IS NOT NULL THEN 'k=' || {GRADIENT} END)"""


def lines(made: DataFrame, **options) -> DataFrame:
    """id, i (from 1) and the line of each operation."""
    ops = display_list(with_headers(made), **options)
    return ops.select(F.col("path").cast("long").alias("id"), (F.col("ord") + 1).cast("long").alias("i"), F.expr(LINE).alias("line"))


def parts(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select(F.col("p_partkey").cast("long").alias("k"), F.col("p_size").cast("long").alias("z"))


# SQL of lines


def n(x) -> str:
    """A number, or SQL of one, in thousandths."""
    return str(math.floor(x * 1000 + 0.5)) if isinstance(x, int | float) else f"round(({x}) * 1000)::BIGINT"


def want(op: str, *geom, **attrs) -> str:
    """SQL of a line: upper-case letters are commands, all else numbers; attributes are SQL of their text."""
    path = [f"'{g}'" if isinstance(g, str) and len(g) == 1 and g.isupper() else n(g) for g in geom]
    return f"concat_ws(' ', '{op}', " + ", ".join([*path, *(f"'{k}=' || ({v})" for k, v in attrs.items())]) + ")"


def fill(*geom, f: str = "'#ffffff'", r: str = "'nonzero'", **more) -> str:
    return want("fill", *geom, f=f, r=r, **more)


def stroke(*geom, s: str = "'#000000'", w="1000", **more) -> str:
    return want("stroke", *geom, s=s, w=w, **more)


def both(*geom, r: str = "'nonzero'", **more) -> list[str]:
    return [fill(*geom, r=r, **more), stroke(*geom, **more)]


def expected(rows: list[str], source: str = "part", key: str = "p_partkey", more: str = "p_partkey::BIGINT AS k, p_size::BIGINT AS z") -> str:
    """One row per line and part; null lines aren't drawn."""
    listed = ",\n".join(rows)
    return f"SELECT k AS id, i, x[i] AS line FROM (SELECT k, list_filter([{listed}], lambda y: y IS NOT NULL) AS x FROM (SELECT {more} FROM {source})), range(1, {len(rows) + 1}) AS g(i) WHERE i <= len(x)"


def hex_color(v: str) -> str:
    """SQL of the text of a colour reference."""
    return f"printf('#%02x%02x%02x', ({v}) & 255, (({v}) >> 8) & 255, (({v}) >> 16) & 255)"


def argb(v: str) -> str:
    return f"printf('rgba(%d,%d,%d,%.3f)', (({v}) >> 16) & 255, (({v}) >> 8) & 255, ({v}) & 255, ((({v}) >> 24) & 255) / 255.0)"


def rec(rtype: int, fmt: str = "", *v, tail: bytes = b"") -> bytes:
    return E.emf_record(rtype, struct.pack("<" + fmt, *v) + tail)


def drawing(*records: bytes, bounds=(0, 0, 64, 64)) -> bytes:
    return E.emf([*records, E.eof()], bounds)


NULL_PEN, NULL_BRUSH = E.select(0x80000008), E.select(0x80000005)

# GDI state

LEVELS = (-1, 1, -2, 7, 0, -9)


def _saved(r: dict) -> bytes:
    k, z = r["k"], r["z"]
    line = lambda x, y: rec(54, "ii", x, y)
    return drawing(
        E.pen(1, 0, 3, k & 0xFFFFFF), E.select(1), line(z, 0), rec(33), E.pen(2, 1, 5, 255), E.select(2), line(z, 1), rec(33), E.pen(3, 0, 2, 0xFF00), E.select(3),
        line(5, 5), rec(34, "i", LEVELS[k % 6]), line(0, k % 7), rec(34, "i", -1), line(1, 1),
    )


_A, _B, _C = {"s": hex_color("k"), "w": "3000"}, {"s": "'#ff0000'", "w": "5000", "d": "'8000,4000'"}, {"s": "'#00ff00'", "w": "2000"}


def _restored(last: str, first: str, none: str) -> str:
    return f"CASE WHEN k % 6 IN (0, 3) THEN {last} WHEN k % 6 IN (1, 2) THEN {first} ELSE {none} END"


@query(expected([
    stroke("M", 0, 0, "L", "z", 0, **_A), stroke("M", "z", 0, "L", "z", 1, **_B), stroke("M", "z", 1, "L", 5, 5, **_C),
    _restored(stroke("M", "z", 1, "L", 0, "k % 7", **_B), stroke("M", "z", 0, "L", 0, "k % 7", **_A), stroke("M", 5, 5, "L", 0, "k % 7", **_C)),
    _restored(stroke("M", "z", 0, "L", 1, 1, **_A), stroke("M", 0, "k % 7", "L", 1, 1, **_A), stroke("M", 0, "k % 7", "L", 1, 1, **_C)),
]))
def gdi_save_restore(spark, d):
    """SaveDC and RestoreDC by level: the last, the first, beyond the stack, and before it."""
    return lines(files(parts(spark, d), _saved))


def _logfont(handle: int, height: int, weight: int, italic: int, underline: int, strike: int, face: str) -> bytes:
    return rec(82, "Ii12xi4B", handle, height, weight, italic, underline, strike, 1, tail=face.encode("utf-16-le").ljust(64, b"\0") + bytes(240))


def _out(x: int, y: int, s: str) -> bytes:
    return rec(84, "16xIffiiIII16xI", 1, 1.0, 1.0, x, y, len(s), 76, 0, 0, tail=s.encode("utf-16-le"))


def _texts(r: dict) -> bytes:
    k, z = r["k"], r["z"]
    return drawing(
        rec(24, "I", k & 0xFFFFFF), rec(25, "I", 0x102030), rec(18, "I", 1 + k % 2), rec(22, "I", (0, 2, 6, 8, 24)[k % 5]),
        _logfont(1, -z, z * 23, k % 2, 0, 0, ("Arial", "Times New Roman")[k % 2]), E.select(1), _out(z, 3, f"é{k}\0junk"),
        _logfont(2, 10, 400, 0, 1, 1, ""), E.select(2), rec(18, "I", 1), rec(22, "I", 0), _out(1, 2, "ab"), E.select(0x8000000A), _out(0, 0, "c"), rec(40, "I", 2), E.select(2), _out(0, 1, "d"),
    )


_SIZE, _TEXT, _R = "greatest(z, 8)", "chr(233) || k", "(floor(z * 23 / 100.0 + 0.5) * 100)::BIGINT"
_WEIGHT = f"CASE WHEN z = 0 OR {_R} = 400 THEN '' WHEN {_R} = 700 OR {_R} > 900 THEN 'bold ' WHEN {_R} >= 100 THEN {_R} || ' ' ELSE '' END"


@query(expected([
    f"CASE WHEN k % 2 = 1 THEN {fill('R', 'z', f'3 - {_SIZE}', f'0.6 * {_SIZE} * length({_TEXT})', _SIZE, f=hex_color(str(0x102030)))} END",
    want("text", "M", "z", 3, f=hex_color("k"), x=_TEXT, n=f"CASE WHEN k % 2 = 1 THEN 'italic ' ELSE '' END || {_WEIGHT} || {_SIZE} || 'px ' || CASE WHEN k % 2 = 1 THEN '\"Times New Roman\"' ELSE 'Arial' END",
         a="CASE WHEN k % 5 IN (1, 2) THEN 'right' ELSE 'left' END", b="CASE k % 5 WHEN 3 THEN 'bottom' WHEN 4 THEN 'alphabetic' ELSE 'top' END"),
    want("text", "M", 1, 2, f=hex_color("k"), x="'ab'", n="'10px sans-serif'", a="'left'", b="'top'"), fill("R", 1, 3, 12, 1, f=hex_color("k")), fill("R", 1, -1, 12, 1, f=hex_color("k")),
    want("text", "M", 0, 0, f=hex_color("k"), x="'c'", n="'12px monospace'", a="'left'", b="'top'"), want("text", "M", 0, 1, f=hex_color("k"), x="'d'", n="'12px monospace'", a="'left'", b="'top'"),
]))
def gdi_text(spark, d):
    """Text colours, background, alignment, fonts with weights and decorations, a stock font, and a deleted one."""
    return lines(files(parts(spark, d), _texts))


# GDI mapping


def _mapped(r: dict) -> bytes:
    k, z = r["k"], r["z"]
    box = E.rectangle(z, 2, z + 8, 6)
    return drawing(
        NULL_PEN, box, rec(17, "I", 8 if k % 2 else 1), rec(10, "ii", k % 9, 1), rec(9, "ii", 32, 16), box, rec(12, "ii", 1, 2), rec(11, "ii", 64, 32), box,
        rec(31, "4i", 1, 2, 3, 1), box, rec(32, "4i", 2, 1, 1, 4), box, rec(9, "ii", 0, 0), box,
    )


def _box(x: Callable[[str], str], y: Callable[[str], str]) -> str:
    return fill("R", x("z"), y("2"), f"({x('z + 8')}) - ({x('z')})", f"({y('6')}) - ({y('2')})")


def _axis(org: str, ext: int, to: int, view: int) -> Callable[[str], str]:
    return lambda v: f"(({v}) - ({org})) / {ext}::DOUBLE * {to} + {view}"


@query(expected([
    _box(lambda v: v, lambda v: v), _box(_axis("k % 9", 32, 64, 0), _axis("1", 16, 64, 0)), _box(_axis("k % 9", 32, 64, 1), _axis("1", 16, 32, 2)),
    _box(_axis("k % 9", 32, 32, 1), _axis("1", 16, 96, 2)), _box(_axis("k % 9", 64, 32, 1), _axis("1", 4, 96, 2)), _box(_axis("k % 9", 1, 32, 1), _axis("1", 1, 96, 2)),
]))
def gdi_mapping(spark, d):
    """Window and viewport origins and extents, their scaling, map modes, and extents of zero."""
    return lines(files(parts(spark, d), _mapped))


def _worlds(r: dict) -> bytes:
    k, z = r["k"], r["z"]
    return drawing(rec(35, "6f", 2, 0, 0, 0.5, 3, k % 4), rec(54, "ii", z, 2), rec(36, "6fI", 2, 0, 0, 1, 2, 2, 1 + k % 4), rec(54, "ii", 8, z), NULL_BRUSH, E.rectangle(z, 2, z + 1, 3))


#: By mode: reset, the new transform applied last, the new one first, neither; as factors and shifts of x and y.
_WORLD = "CASE k % 4 WHEN 0 THEN {0} WHEN 1 THEN {1} WHEN 2 THEN {2} ELSE {3} END"
_X = lambda v: f"({v}) * {_WORLD.format(1, 4, 4, 2)} + {_WORLD.format(0, 8, 7, 3)}"
_Y = lambda v: f"({v}) * {_WORLD.format(1, 0.5, 0.5, 0.5)} + {_WORLD.format(0, 3, 3, 3)}"


@query(expected([
    stroke("M", 3, "k % 4", "L", "2 * z + 3", "1 + k % 4"), stroke("M", _X("z"), _Y("2"), "L", _X("8"), _Y("z")),
    stroke("R", _X("z"), _Y("2"), f"({_X('z + 1')}) - ({_X('z')})", f"({_Y('3')}) - ({_Y('2')})"),
]))
def gdi_world(spark, d):
    """The world transform set, and modified in each mode."""
    return lines(files(parts(spark, d), _worlds))


# GDI objects


def _objects(r: dict) -> bytes:
    k, z = r["k"], r["z"]
    return drawing(
        E.pen(1, z % 6, z, k & 0xFFFFFF), E.select(1), E.brush(2, (k * 7) & 0xFFFFFF, z % 2), E.select(2), E.rectangle(0, 0, 1, 1),
        rec(95, "I8xII4xI16x", 3, 1 + z % 4, 4, 0x0A0B0C), E.select(3), E.rectangle(0, 0, 2, 1), rec(40, "I", 2), E.select(2), E.rectangle(0, 0, 3, 1),
        E.select(0x80000000 + z % 9), E.rectangle(0, 0, 4, 1), E.select(77), E.rectangle(0, 0, 5, 1),
    )


_DASH = "CASE {0} WHEN 1 THEN ' d=8000,4000' WHEN 2 THEN ' d=2000,2000' WHEN 3 THEN ' d=8000,4000,2000,4000' WHEN 4 THEN ' d=8000,4000,2000,4000,2000,4000' ELSE '' END"
_GREYS = "CASE z % 9 WHEN 0 THEN '#ffffff' WHEN 1 THEN '#c0c0c0' WHEN 2 THEN '#808080' WHEN 3 THEN '#404040' WHEN 4 THEN '#000000' ELSE " + hex_color("k * 7") + " END"


def _stock(x: int) -> list[str]:
    """A rectangle after a stock object was selected: brushes 0 to 5, of which 5 is hollow, and pens 6 to 8, of which 8 is null."""
    ext = stroke("R", 0, 0, x, 1, s=hex_color(str(0x0A0B0C)), w="4000") + " || " + _DASH.format("1 + z % 4")
    plain = stroke("R", 0, 0, x, 1, s="CASE z % 9 WHEN 6 THEN '#ffffff' ELSE '#000000' END")
    return [
        f"CASE WHEN z % 9 <> 5 AND (z % 9 < 5 OR z % 2 = 0) THEN {fill('R', 0, 0, x, 1, f=_GREYS)} END",
        f"CASE WHEN z % 9 < 6 THEN {ext} WHEN z % 9 < 8 THEN {plain} END",
    ]


@query(expected([
    f"CASE WHEN z % 2 = 0 THEN {fill('R', 0, 0, 1, 1, f=hex_color('k * 7'))} END",
    f"CASE WHEN z % 6 < 5 THEN {stroke('R', 0, 0, 1, 1, s=hex_color('k'), w='greatest(z, 1) * 1000')} || {_DASH.format('z % 6')} END",
    *[x for i in (2, 3) for x in (f"CASE WHEN z % 2 = 0 THEN {fill('R', 0, 0, i, 1, f=hex_color('k * 7'))} END", stroke("R", 0, 0, i, 1, s=hex_color(str(0x0A0B0C)), w="4000") + " || " + _DASH.format("1 + z % 4"))],
    *_stock(4), *_stock(5),
]))
def gdi_objects(spark, d):
    """Pens, extended pens and brushes created, selected and deleted; stock objects; a handle of nothing."""
    return lines(files(parts(spark, d), _objects))


def _rops(r: dict) -> bytes:
    return drawing(rec(20, "I", r["k"] % 18), E.brush(1, 0x302010), E.select(1), E.pen(2, 0, 1, 0x0C0B0A), E.select(2), E.rectangle(0, 0, r["z"], 1), rec(54, "ii", 1, 1))


def _modes(keep: str, turned: str, kind: str) -> str:
    """SQL of the composite operation or the colour of each of the sixteen raster operations."""
    colors = {1: "#000000", 2: turned, 3: turned, 4: turned, 6: "#ffffff", 8: turned, 10: turned, 11: "transparent", 12: turned, 16: "#ffffff"}
    gcos = {2: "darken", 3: "darken", 5: "difference", 6: "difference", 7: "difference", 8: "lighten", 9: "darken", 10: "difference", 12: "lighten", 14: "lighten", 15: "lighten"}
    table, other = (colors, f"'{keep}'") if kind == "color" else ({k: f" g={v}" for k, v in gcos.items()}, "''")
    return "CASE k % 18 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in table.items()) + f" ELSE {other} END"


_GCO = _modes("", "", "gco")


@query(expected([
    fill("R", 0, 0, "z", 1, f=_modes("#102030", "#efdfcf", "color")) + " || " + _GCO, stroke("R", 0, 0, "z", 1, s=_modes("#0a0b0c", "#f5f4f3", "color")) + " || " + _GCO,
    stroke("M", 0, 0, "L", 1, 1, s=_modes("#0a0b0c", "#f5f4f3", "color")) + " || " + _GCO,
]))
def gdi_raster_operations(spark, d):
    """All binary raster operations, known and unknown, on fills and strokes."""
    return lines(files(parts(spark, d), _rops))


# GDI shapes


def _shapes(r: dict) -> bytes:
    k, z = r["k"], r["z"]
    arc = (0, 0, 40, 20, z, k % 97, k % 89, z)
    return drawing(
        rec(21, "I", 3), rec(58, "I", 10), rec(15, "iiI", z, 1, k & 0xFFFFFF), rec(27, "ii", 3, z), rec(54, "ii", z, 4), E.rectangle(z, 1, 2, k % 5), rec(44, "6i", 30, 20, 0, 0, z, 8), rec(42, "4i", 0, 0, z, 9),
        rec(45, "8i", *arc), rec(46, "8i", *arc), rec(47, "8i", *arc), rec(55, "8i", *arc), rec(54, "ii", 0, 0),
    )


_START, _END = "atan2((k % 97 - 10) / 10.0, (z - 20) / 20.0)", "atan2((z - 10) / 10.0, (k % 89 - 20) / 20.0)"
_STOP = f"({_END} + CASE WHEN {_END} < {_START} THEN 2 * pi() ELSE 0 END)"
_FROM = (f"20 + 20 * cos({_START})", f"10 + 10 * sin({_START})")
_ARC = ("A", 20, 10, 20, 10, _START, _STOP, 1)
_RADIUS, _Q = "least(z / 2.0, 4.0)", math.pi / 2


@query(expected([
    fill("R", "z", 1, 1, 1, f=hex_color("k")), stroke("M", 3, "z", "L", "z", 4), *both("R", "z", 1, "2 - z", "k % 5 - 1"),
    *both("M", _RADIUS, 0, "A", f"30 - {_RADIUS}", _RADIUS, _RADIUS, _RADIUS, -_Q, 0, 1, "A", f"30 - {_RADIUS}", f"20 - {_RADIUS}", _RADIUS, _RADIUS, 0, _Q, 1,
          "A", _RADIUS, f"20 - {_RADIUS}", _RADIUS, _RADIUS, _Q, 2 * _Q, 1, "A", _RADIUS, _RADIUS, _RADIUS, _RADIUS, 2 * _Q, 3 * _Q, 1, "Z"),
    *both("A", "z / 2.0", 4.5, "z / 2.0", 4.5, 0, 4 * _Q, 0, "Z"), stroke("M", *_FROM, *_ARC), *both("M", *_FROM, *_ARC, "Z"), *both("M", 20, 10, "L", *_FROM, *_ARC, "Z"),
    stroke("M", *_FROM, *_ARC), stroke("M", "k % 89", "z", "L", 0, 0),
]))
def gdi_shapes(spark, d):
    """Pixels, lines, rectangles, rounded ones, ellipses and the four kinds of arcs, after state that changes nothing."""
    return lines(files(parts(spark, d), _shapes))


def _poly(rtype: int, fmt: str, *v: int) -> bytes:
    return rec(rtype, f"16xI{len(v)}{fmt}", len(v) // 2, *v)


def _polys(r: dict) -> bytes:
    k, z = r["k"], r["z"]
    fmt = "ih"[k % 2]
    number = lambda long, short: (long, short)[k % 2]
    pts = (z, 1, 9, 2, 3, k % 11)
    pair = struct.pack("<2I", 2, 3) + struct.pack(f"<10{fmt}", 0, 0, z, z, *pts)
    return drawing(
        rec(19, "I", 1 + k % 2), _poly(number(3, 86), fmt, *pts), _poly(number(4, 87), fmt, *pts), _poly(number(2, 85), fmt, 0, 0, *pts), _poly(number(6, 89), fmt, *pts),
        _poly(number(5, 88), fmt, *pts), rec(54, "ii", 0, 0), rec(number(8, 91), "16xII", 2, 5, tail=pair), *([] if k % 2 else [rec(7, "16xII", 2, 5, tail=pair)]), rec(8, "16xII", 0, 0),
    )


_P = ("z", 1, 9, 2, 3, "k % 11")
_LINES = ("M", *_P[:2], "L", *_P[2:4], "L", *_P[4:])
_RULE = "CASE WHEN k % 2 = 0 THEN 'evenodd' ELSE 'nonzero' END"


@query(expected([
    *both(*_LINES, "Z", r=_RULE), stroke(*_LINES), stroke("M", 0, 0, "C", *_P), stroke("M", *_P[:2], "L", *_LINES[1:]), stroke("M", *_P[:2], "C", *_P), stroke("M", 3, "k % 11", "L", 0, 0),
    *both("M", 0, 0, "L", "z", "z", "Z", *_LINES, "Z", r=_RULE), f"CASE WHEN k % 2 = 0 THEN {stroke('M', 0, 0, 'L', 'z', 'z', *_LINES)} END",
]))
def gdi_polys(spark, d):
    """Polygons, polylines and curves with long and short points, lists of them, and the fill mode."""
    return lines(files(parts(spark, d), _polys))


def _paths(r: dict) -> bytes:
    k, z = r["k"], r["z"]
    return drawing(
        rec(59), rec(27, "ii", 0, 0), rec(54, "ii", z, 0), _poly(89, "h", 5, 5, k % 9, 6), _poly(88, "h", 1, 1, 2, 2, 3, z), rec(61), E.rectangle(1, 1, 3, 3), rec(55, "8i", 0, 0, 40, 20, 40, 10, 20, 20), rec(60),
        rec((62, 63, 64)[k % 3]), rec(67, "I", 5), rec(59), rec(27, "ii", 2, 2), rec(54, "ii", 3, z), rec(60), rec(64),
    )


_PATH = ("M", 0, 0, "L", "z", 0, "L", 5, 5, "L", "k % 9", 6, "C", 1, 1, 2, 2, 3, "z", "Z", "R", 1, 1, 2, 2, "L", 40, 10, "A", 20, 10, 20, 10, 0, _Q, 1)


@query(expected([
    f"CASE WHEN k % 3 < 2 THEN {fill(*_PATH, r=chr(39) + 'evenodd' + chr(39))} END", f"CASE WHEN k % 3 > 0 THEN {stroke(*_PATH)} END",
    stroke("M", 2, 2, "L", 3, "z", c="'evenodd:' || concat_ws(' ', " + ", ".join(f"'{g}'" if isinstance(g, str) and len(g) == 1 and g.isupper() else n(g) for g in _PATH) + ")"),
]))
def gdi_paths(spark, d):
    """A path bracket with lines, curves, shapes and arcs, painted in each way, then as the clip."""
    return lines(files(parts(spark, d), _paths))


# GDI clips


def _quad(x0, y0, x1, y1) -> tuple:
    return ("M", x0, y0, "L", x1, y0, "L", x1, y1, "L", x0, y1, "Z")


def _shape(rule: str, *geom) -> str:
    """SQL of one shape of a clip."""
    return f"'{rule}:' || concat_ws(' ', " + ", ".join(f"'{g}'" if isinstance(g, str) and len(g) == 1 and g.isupper() else n(g) for g in geom) + ")"


def _and(*shapes: str) -> str:
    return " || '/' || ".join(shapes)


_HUGE = 1 << 24
_AROUND = _quad(-_HUGE, -_HUGE, _HUGE, _HUGE)
_MARK = ("M", 0, 0, "L", 1, 1)


def _region(mode: int, *boxes: tuple) -> bytes:
    body = struct.pack("<4I16x", 32, 1, len(boxes), 16 * len(boxes)) + b"".join(struct.pack("<4i", *b) for b in boxes)
    return rec(75, "II", len(body), mode, tail=body)


def _clips(r: dict) -> bytes:
    k, z = r["k"], r["z"]
    mark = [rec(27, "ii", 0, 0), rec(54, "ii", 1, 1)]
    return drawing(
        rec(30, "4i", 0, 0, z, 9), *mark, rec(29, "4i", 1, 1, 3, k % 5), *mark, rec(26, "ii", 2, 3), *mark, rec(75, "II", 0, 5), *mark,
        _region(5, (0, 0, z, 8)), _region(1 + k % 4, (2, 2, 6, 6)), *mark, _region(5), *mark, _region(5, (0, 0, 2, 2), (4, 4, z, 6)), _region(3, (1, 1, 2, 2)), *mark, rec(33), rec(75, "II", 0, 5), rec(34, "i", -1), *mark,
    )


_FIRST, _OTHER = _quad(0, 0, "z", 8), _quad(2, 2, 6, 6)
_TWO = _shape("nonzero", *_quad(0, 0, 2, 2), *_quad(4, 4, "z", 6))
_COMBINED = f"""CASE k % 4 WHEN 0 THEN {stroke(*_MARK, c=_and(_shape("nonzero", *_FIRST), _shape("nonzero", *_OTHER)))}
  WHEN 1 THEN {stroke(*_MARK, c=_shape("nonzero", *_FIRST, *_OTHER))} || ' e=0' WHEN 2 THEN {stroke(*_MARK, c=_shape("evenodd", *_FIRST, *_OTHER))}
  ELSE {stroke(*_MARK, c=_and(_shape("nonzero", *_FIRST), _shape("evenodd", *_AROUND, *_OTHER)))} END"""
_XOR_TWO = stroke(*_MARK, c=_and(_TWO, _shape("evenodd", *_AROUND, *_quad(1, 1, 2, 2)))) + " || ' e=0'"


@query(expected([
    stroke(*_MARK, c=_shape("nonzero", *_quad(0, 0, "z", 9))), stroke(*_MARK, c=_and(_shape("nonzero", *_quad(0, 0, "z", 9)), _shape("evenodd", *_AROUND, *_quad(1, 1, 3, "k % 5")))),
    stroke(*_MARK, c=_and(_shape("nonzero", *_quad(2, 3, "z + 2", 12)), _shape("evenodd", *_quad(2 - _HUGE, 3 - _HUGE, _HUGE + 2, _HUGE + 3), *_quad(3, 4, 5, "k % 5 + 3")))),
    stroke(*_MARK), _COMBINED, stroke(*_MARK, c=_shape("nonzero", *_quad(0, 0, 0, 0))), _XOR_TWO, _XOR_TWO,
]))
def gdi_clips(spark, d):
    """Rectangles and regions in every mode, moved, reset, saved and restored, with what isn't exact."""
    return lines(files(parts(spark, d), _clips))


# Bitmaps


def _dib(w: int, h: int, bpp: int, comp: int, extra: bytes, bits: bytes, used: int = 0) -> bytes:
    head = struct.pack("<IiiHHIIiiII", 40, w, h, 1, bpp, comp, len(bits), 0, 0, used, 0) + extra
    return rec(81, "16xiiiiiiIIIIIIii", 3, 4, 0, 0, w, abs(h), 80, len(head), 80 + len(head), len(bits), 0, 0, 5, 6, tail=head + bits)


def _bitmaps(r: dict) -> bytes:
    k, z = r["k"], r["z"]
    pal = bytes([1, 2, 3, 0, 4, 5, z, 0])
    return drawing(
        _dib(2, 1, 24, 0, b"", bytes([k & 255, 2, z, 9, 8, 7, 0, 0])), _dib(1, -2, 32, 0, b"", bytes([1, 2, 3, 0, 4, 5, 6, z])), _dib(3, 1, 1, 0, pal, bytes([0b01000000, 0, 0, 0])),
        _dib(3, 1, 4, 0, pal, bytes([0x01, 0x20, 0, 0]), 2), _dib(2, 2, 8, 0, pal, bytes([0, 1, 0, 0, 1, 0, 0, 0]), 2), _dib(1, 1, 16, 0, b"", struct.pack("<HH", k & 0x7FFF, 0)),
        _dib(1, 1, 16, 3, struct.pack("<3I", 0xF800, 0x7E0, 0x1F), struct.pack("<HH", k & 0xFFFF, 0)),
        _dib(4, 2, 8, 1, pal, bytes([2, 1, 0, 0, 1, 0, 0, 3, 1, 0, 1, 0, 0, 1]), 2), _dib(2, 2, 8, 1, pal, bytes([0, 3, 1, 0, 1, 0, 0, 0, 1, 1, 0, 1]), 2),
        _dib(4, 1, 4, 2, pal, bytes([3, 0x01, 0, 1]), 2), _dib(4, 1, 4, 2, pal, bytes([0, 2, 1, 0, 0, 3, 0x10, 0x10, 0, 1]), 2),
        rec(76, "16xiiiiI28x4I12x", 1, 2, z, 3, 0x00F00021, 0, 0, 0, 0), _dib(2, 1, 24, 0, b"", b""),
    )


def _image(w: int, h: int, *px) -> str:
    """SQL of an image line; pixels are four numbers each, or SQL of them."""
    return want("image", "R", 3, 4, 5, 6, i=f"'{w}x{h}:' || " + " || ".join(f"'{v:02x}'" if isinstance(v, int) else f"printf('%02x', ({v})::BIGINT)" for v in px))


def _scaled(shift: int, top: int) -> str:
    return f"floor(((k >> {shift}) & {top}) * 255 / {top}.0 + 0.5)"


_P0, _P1, _NONE = (3, 2, 1, 255), ("z", 5, 4, 255), (0, 0, 0, 0)


@query(expected([
    _image(2, 1, "z", 2, "k & 255", 255, 7, 8, 9, 255), _image(1, 2, 3, 2, 1, 255, 6, 5, 4, "CASE WHEN z = 0 THEN 255 ELSE z END"), _image(3, 1, *_P0, *_P1, *_P0), _image(3, 1, *_P0, *_P1, 0, 0, 0, 255),
    _image(2, 2, *_P1, *_P0, *_P0, *_P1), _image(1, 1, _scaled(10, 31), _scaled(5, 31), _scaled(0, 31), 255), _image(1, 1, _scaled(11, 31), _scaled(5, 63), _scaled(0, 31), 255),
    _image(4, 2, *_P1, *_P1, *_NONE, *_NONE, *_P0, *_P1, *_P0, *_P1), _image(2, 2, *_P1, *_P0, *_NONE, *_NONE),
    _image(4, 1, *_P0, *_P1, *_P0, *_NONE), _image(4, 1, *_NONE, *_P1, *_P0, *_P1), fill("R", 1, 2, "z", 3),
]))
def gdi_bitmaps(spark, d):
    """Bitmaps of every depth, with masks, palettes and run lengths that meet the right edge, and a pattern copy."""
    return lines(files(parts(spark, d), _bitmaps))
