"""EMF+ and WMF queries in the manner of ``drawings``."""

from __future__ import annotations

import struct

from ..sources import encode as E
from .drawings import _AROUND, _ARC, _FROM, _Q, _and, _quad, _shape, argb, drawing, expected, files, fill, hex_color, lines, n, parts, stroke, want
from .registry import query

V = struct.pack("<I", 0xDBC01002)
INK = 0x80FF8040


def plus(*records: bytes) -> bytes:
    return E.plus_comment(list(records))


def rec(rtype: int, flags: int = 0, fmt: str = "", *v, tail: bytes = b"") -> bytes:
    return E.plus_record(rtype, flags, struct.pack("<" + fmt, *v) + tail)


def obj(kind: int, ident: int, data: bytes, flags: int = 0) -> bytes:
    return E.plus_record(0x4008, kind << 8 | ident | flags, data)


def solid(color: int) -> bytes:
    return V + struct.pack("<II", 0, color)


def pen(width: float, color: int, style: int | None = None) -> bytes:
    return V + struct.pack("<IIIf", 0, 0 if style is None else 32, 0, width) + (b"" if style is None else struct.pack("<I", style)) + solid(color)


def path(points: list[tuple], types: list[int], short: bool) -> bytes:
    flat = [x for p in points for x in p]
    raw = struct.pack(f"<{len(flat)}{'h' if short else 'f'}", *flat)
    return V + struct.pack("<II", len(points), 0x4000 if short else 0) + raw + bytes(types)


BOX = rec(0x400A, 0x8000, "II4f", INK, 1, 0, 0, 1, 2)


def moved(*m) -> str:
    """SQL of a transform's six numbers."""
    return " || ',' || ".join(n(v) if not isinstance(v, int | float) else f"'{n(v)}'" for v in m)


SAME = moved(1, 0, 0, 1, 0, 0)
INKED = {"f": f"'rgba(255,128,64,0.502)'", "t": SAME}  # noqa: F541


def inked(*geom, t: str = SAME, f: str = "'rgba(255,128,64,0.502)'", **more) -> str:
    return fill(*geom, f=f, t=t, **more)


def _plus_shapes(r: dict) -> bytes:
    k, z = r["k"], r["z"]
    short = 0x4000 if k % 2 else 0
    c = "h" if short else "f"
    color = (k * 2654435761) & 0xFFFFFFFF
    figure = [(0, 0), (z, 0), (9, 3), (4, 4), (k % 7, 8), (1, 1)]
    return drawing(plus(
        obj(1, 1, solid(color)), obj(2, 2, pen(z, color, z % 5)), obj(3, 3, path(figure, [0, 1, 3, 3, 0x83, 0], bool(short))),
        rec(0x400A, short | 0x8000, f"II8{c}", color, 2, z, 1, 2, 3, 0, 0, k % 9, 4), rec(0x400B, short | 2, f"I4{c}", 1, 0, 0, z, 2), rec(0x400C, short, f"II6{c}", 1, 3, 0, 0, z, 1, 2, 3),
        rec(0x400D, short | 2 | (0x2000 if z % 2 else 0), f"I6{c}", 3, 0, 0, z, 1, 2, 3), rec(0x400E, short, f"I4{c}", 1, 0, 0, z, 4), rec(0x400F, short | 2, f"4{c}", 2, 2, z, 6),
        rec(0x4010, short | 0x8000, f"Iff4{c}", INK, 0, 90, 0, 0, z, 4), rec(0x4011, short | 2, f"ff4{c}", 90, -90, 0, 0, z, 4), rec(0x4012, short | 2, f"ff4{c}", 0, 180, 0, 0, 4, z),
        rec(0x4014, 3, "I", 1), rec(0x4015, 3, "I", 2), rec(0x400A, 0, "II4f", 9, 1, 0, 0, 1, 1), rec(0x400B, 7, "I4f", 1, 0, 0, 1, 1),
    ))


_COLOR = argb("(k * 2654435761) % 4294967296")
_WIDTH = "CASE WHEN z = 0 THEN 1 ELSE z END"
_PLUS_DASH = f"""CASE z % 5 WHEN 1 THEN concat(' d=', 3000 * {_WIDTH}, ',', 1000 * {_WIDTH}) WHEN 2 THEN concat(' d=', 1000 * {_WIDTH}, ',', 1000 * {_WIDTH})
  WHEN 3 THEN concat(' d=', 3000 * {_WIDTH}, ',', 1000 * {_WIDTH}, ',', 1000 * {_WIDTH}, ',', 1000 * {_WIDTH})
  WHEN 4 THEN concat(' d=', 3000 * {_WIDTH}, ',', 1000 * {_WIDTH}, ',', 1000 * {_WIDTH}, ',', 1000 * {_WIDTH}, ',', 1000 * {_WIDTH}, ',', 1000 * {_WIDTH}) ELSE '' END"""


def _brushed(*geom) -> str:
    return inked(*geom, f=_COLOR)


def _penned(*geom) -> str:
    return want("stroke", *geom, s=_COLOR, w=f"1000 * {_WIDTH}") + f" || {_PLUS_DASH} || ' t=' || {SAME}"


_POLY = ("M", 0, 0, "L", "z", 1, "L", 2, 3)
_FIGURE = ("M", 0, 0, "L", "z", 0, "C", 9, 3, 4, 4, "k % 7", 8, "Z", "M", 1, 1)


@query(expected([
    _brushed("R", "z", 1, 2, 3), _brushed("R", 0, 0, "k % 9", 4), _penned("R", 0, 0, "z", 2), _brushed(*_POLY, "Z"), f"CASE WHEN z % 2 = 1 THEN {_penned(*_POLY, 'Z')} ELSE {_penned(*_POLY)} END",
    _brushed("A", "z / 2.0", 2, "z / 2.0", 2, 0, 4 * _Q, 0, "Z"), _penned("A", "2 + z / 2.0", 5, "z / 2.0", 3, 0, 4 * _Q, 0, "Z"), inked("M", "z / 2.0", 2, "A", "z / 2.0", 2, "z / 2.0", 2, 0, _Q, 1, "Z"),
    _penned("A", "z / 2.0", 2, "z / 2.0", 2, _Q, 0, 0), _penned("A", 2, "z / 2.0", 2, "z / 2.0", 0, 2 * _Q, 0), _brushed(*_FIGURE), _penned(*_FIGURE), inked("R", 0, 0, 1, 1, f="'rgba(0,0,0,1.000)'"),
]))
def plus_shapes(spark, d):
    """Every EMF+ shape with long and short numbers, brushes, dashed pens and paths, and objects that are missing."""
    return lines(files(parts(spark, d), _plus_shapes))


def _plus_worlds(r: dict) -> bytes:
    k, z = r["k"], r["z"]
    late = 0x2000 * (k % 2)
    return drawing(
        plus(
            rec(0x402A, 0, "6f", 2, 0, 0, 4, 1, z), BOX, rec(0x402D, late, "ff", 3, 5), BOX, rec(0x4025, 0, "I", k), rec(0x402E, late, "ff", 0.5, 2), BOX, rec(0x4028, 0, "I", k + 1),
            rec(0x402F, 0, "f", 90), BOX, rec(0x4029, 0, "I", k + 1), BOX, rec(0x4026, 0, "I", k), BOX, rec(0x4026, 0, "I", k + 1), BOX, rec(0x402B), rec(0x402C, 0, "6f", 1, 0, 0, 1, z, 0), BOX,
            rec(0x4030, 4 if k % 2 else 2, "f", 0.5), BOX, rec(0x401E, 1), rec(0x4002),
        ),
        plus(BOX),
    )


_T1 = ("2", "0", "0", "4", "1", "z")
_T2 = ("2", "0", "0", "4", "1 + CASE WHEN k % 2 = 1 THEN 6 ELSE 3 END", "z + CASE WHEN k % 2 = 1 THEN 20 ELSE 5 END")
_T3 = ("1", "0", "0", "8", f"({_T2[4]}) * CASE WHEN k % 2 = 1 THEN 1 ELSE 0.5 END", f"({_T2[5]}) * CASE WHEN k % 2 = 1 THEN 1 ELSE 2 END")
_T4 = ("0", "1", "-8", "0", f"-({_T3[5]})", _T3[4])
_UNIT = "CASE WHEN k % 2 = 1 THEN 48 ELSE 0.5 END"


def _boxed(m) -> str:
    return inked("R", 0, 0, 1, 2, t=moved(*m))


@query(expected([
    _boxed(_T1), _boxed(_T2), _boxed(_T3), _boxed(_T4), _boxed(_T3), _boxed(_T2), _boxed(_T2), _boxed(("1", "0", "0", "1", "z", "0")),
    _boxed((_UNIT, "0", "0", _UNIT, f"z * {_UNIT}", "0")), _boxed(("1", "0", "0", "1", "z", "0")),
]))
def plus_transforms(spark, d):
    """World transforms in both orders, saves and containers by id, and the page transform of one comment."""
    return lines(files(parts(spark, d), _plus_worlds))


def _plus_clips(r: dict) -> bytes:
    k, z = r["k"], r["z"]
    mode = k % 6
    box = lambda x, y, w, h: struct.pack("<I4f", 0x10000000, x, y, w, h)
    shape = path([(0, 0), (z, 0), (0, 9)], [0, 1, 0x81], False)
    nodes = [struct.pack("<I", 1) + box(0, 0, z, 4) + box(1, 1, 2, 2), struct.pack("<I", 4) + box(0, 0, z, 4) + struct.pack("<I", 0x10000002), struct.pack("<I", 0x10000003),
             struct.pack("<II", 0x10000001, len(shape)) + shape][k % 4]
    return drawing(
        plus(
            obj(8, 5, V + struct.pack("<I", 2) + nodes), obj(3, 6, shape), rec(0x402E, 0, "ff", 2, 2), rec(0x4032, 0, "4f", 0, 0, z, 3), BOX, rec(0x4032, mode << 8, "4f", 1, 1, 2, 2), BOX, rec(0x4035, 0, "ff", 1, 2), BOX,
            rec(0x4031), BOX, rec(0x4033, 6), BOX, rec(0x4033, 4 << 8 | 6), BOX, rec(0x4034, 5), BOX,
        ),
        E.select(0x80000005), E.rectangle(0, 0, 1, 1), plus(BOX),
    )


_TWICE = moved(2, 0, 0, 2, 0, 0)
_ONE, _TWO, _SLANT = _quad(0, 0, "2 * z", 6), _quad(2, 2, 6, 6), ("M", 0, 0, "L", "2 * z", 0, "L", 0, 18, "Z")


def _clipped(c: str, dx: int = 0, dy: int = 0, loose: bool = False) -> str:
    return inked("R", 0, 0, 1, 2, t=_TWICE, **({"c": c} if c else {})) + (" || ' e=0'" if loose else "")


def _shift(geom: tuple, dx: int, dy: int) -> tuple:
    out, axis = [], 0
    for g in geom:
        if isinstance(g, str) and g.isupper():
            out.append(g)
        else:
            out.append(g + (dy if axis % 2 else dx) if isinstance(g, int) else f"({g}) + {dy if axis % 2 else dx}")
            axis += 1
    return tuple(out)


def _modes(dx: int, dy: int) -> str:
    a, b, around = _shift(_ONE, dx, dy), _shift(_TWO, dx, dy), _shift(_AROUND, dx, dy)
    plain = lambda g: _shape("nonzero", *g)
    return f"""CASE k % 6 WHEN 0 THEN {_clipped(plain(b))} WHEN 1 THEN {_clipped(_and(plain(a), plain(b)))} WHEN 2 THEN {_clipped(plain(a + b), loose=True)}
      WHEN 3 THEN {_clipped(_shape("evenodd", *a, *b))} WHEN 4 THEN {_clipped(_and(plain(a), _shape("evenodd", *around, *b)))} ELSE {_clipped(_and(plain(b), _shape("evenodd", *around, *a)))} END"""


_REGION = f"""CASE k % 4 WHEN 0 THEN {_clipped(_and(_shape("nonzero", *_quad(0, 0, "2 * z", 8)), _shape("nonzero", *_TWO)))}
  WHEN 1 THEN {_clipped(_and(_shape("nonzero", *_quad(0, 0, "2 * z", 8)), _shape("evenodd", *_AROUND, *_quad(0, 0, 0, 0))))} WHEN 2 THEN {_clipped("")} ELSE {_clipped(_shape("nonzero", *_SLANT))} END"""


@query(expected([
    _clipped(_shape("nonzero", *_ONE)), _modes(0, 0), _modes(2, 4), _clipped(""), _clipped(_shape("nonzero", *_SLANT)),
    _clipped(_and(_shape("nonzero", *_SLANT), _shape("nonzero", *_SLANT)), loose=True), _REGION, stroke("R", 0, 0, 1, 1), _REGION,
]))
def plus_clips(spark, d):
    """EMF+ clips in every mode, moved and reset; paths that can't be inverted; regions; GDI's own clip beside them."""
    return lines(files(parts(spark, d), _plus_clips))


def _plus_brushes(r: dict) -> bytes:
    k, z = r["k"], r["z"]
    stops = struct.pack("<I3f3I", 3, 1.0, 0.25, 0.0, 0xFF0000FF, 0xFF00FF00, 0xFF000000 | k & 0xFF)
    blend = struct.pack("<I2f2f", 2, 0.0, 1.0, 0.25, 1.5)
    linear = lambda flags, tail: V + struct.pack("<IIIffffII8x", 4, flags, 0, z, 2, 8, 4, 0xFF000000, 0x80FF8000 | k & 0x7F) + tail
    ring = struct.pack("<II4f", 0xFFFF0000, 2, z, 0, 3, 4)
    radial = V + struct.pack("<IIIIffI", 3, 0, 0, 0xFF0000FF, 0, 0, 1) + ring
    square = path([(1, 0), (z, 0)], [0, 1], False)
    by_path = V + struct.pack("<IIIIffI", 3, 1, 0, 0xFF0000FF, 0, 0, 1) + struct.pack("<II", 0xFFFF0000, len(square)) + square
    whole = solid(0xFF010203)
    total = struct.pack("<I", len(whole))
    cut = 4 * (z % 3)
    use = rec(0x400A, 0, "II4f", 1, 1, 0, 0, 1, 2)
    shown = [V + struct.pack("<III", 1, 5, 0xFF0A0B0C), linear(0, b""), linear(4, stops), linear(8, blend), linear(2, struct.pack("<6f", 2, 0, 0, 2, 1, 1)), radial, by_path, V + struct.pack("<I", 2), solid(k & 0xFFFFFF)]
    return drawing(plus(*[x for b in shown for x in (obj(1, 1, b), use)], obj(1, 1, total + whole[:cut], 0x8000), obj(1, 1, whole[cut:8], 0x8000), obj(1, 1, whole[8:]), use))


def _lerped(t: str) -> str:
    """SQL: the colour between the two ends."""
    u = f"least(1.0, {t})"
    ch = [f"floor({a} + ({b} - {a}) * {u} + 0.5)" for a, b in ((0, "255"), (0, "128"), (0, "(k & 127)"), (255, "128"))]
    return f"printf('rgba(%d,%d,%d,%.3f)', {ch[0]}::BIGINT, {ch[1]}::BIGINT, {ch[2]}::BIGINT, {ch[3]} / 255.0)"


_ENDS = ("'rgba(0,0,0,1.000)'", argb("2164228096 | (k & 127)"))


def _graded(f: str, *text: str) -> str:
    return inked("R", 0, 0, 1, 2, f=f, k="concat(" + ", ".join(text) + ")")


def _linear(x0, y0, x1, *stops) -> str:
    return _graded(_ENDS[0], "'linear:'", n(x0), "','", n(y0), "','", n(x1), "','", n(y0), *[x for o, c in stops for x in (f"';{o}@'", c)])


_TWO_STOPS = [(0, _ENDS[0]), (1000, _ENDS[1])]
_RINGS = ["';0@rgba(0,0,255,1.000);1000@rgba(255,0,0,1.000)'"]


@query(expected([
    inked("R", 0, 0, 1, 2, f="'rgba(10,11,12,1.000)'"), _linear("z", 4, "z + 8", *_TWO_STOPS),
    _linear("z", 4, "z + 8", (0, argb("4278190080 | (k & 255)")), (250, "'rgba(0,255,0,1.000)'"), (1000, "'rgba(0,0,255,1.000)'")), _linear("z", 4, "z + 8", (0, _lerped("0.25")), (1000, _lerped("1.5"))),
    _linear("2 * z + 1", 9, "2 * z + 17", *_TWO_STOPS), _graded("'rgba(0,0,255,1.000)'", "'radial:0,0,'", n("greatest(z, 5)"), *_RINGS), _graded("'rgba(0,0,255,1.000)'", "'radial:0,0,'", n("greatest(z, 1)"), *_RINGS),
    inked("R", 0, 0, 1, 2, f="'rgba(0,0,0,1.000)'"), inked("R", 0, 0, 1, 2, f=argb("k & 16777215")), inked("R", 0, 0, 1, 2, f="'rgba(1,2,3,1.000)'"),
]))
def plus_brushes(spark, d):
    """Hatches, linear gradients with preset colours, blends and transforms, path gradients, unknown kinds, continued objects."""
    return lines(files(parts(spark, d), _plus_brushes))


def _plus_texts(r: dict) -> bytes:
    k, z = r["k"], r["z"]
    face = ("Arial", "My Font")[k % 2]
    font = lambda size, style, name: V + struct.pack("<fIiII", size, 0, style, 0, len(name)) + name.encode("utf-16-le") + bytes(4)
    s = f"ä{k}".encode("utf-16-le")
    raw = lambda fmt, stride, px: V + struct.pack("<IiiiII", 1, 2, 1, stride, fmt, 0) + px
    a = k % 256
    images = [raw(0x21808, 8, bytes([1, 2, z, 4, 5, 6, 0, 0])), raw(0x22009, 8, bytes([1, 2, 3, 0, 4, 5, 6, z])), raw(0x26200A, -8, bytes([1, 2, 3, a, 4, 5, 6, z])), raw(0xE200B, 8, bytes([z, 0, 0, a, 0, z, 0, 255]))]
    draw = lambda i: [obj(5, 5, images[i]), rec(0x401A, 5, "24x4f", z, 0, 2, 3)]
    return drawing(plus(
        obj(6, 1, font(z + 0.5, k % 8, face)), obj(7, 2, V + struct.pack("<3I", 0, 0, k % 4)), rec(0x401C, 0x8001, "IIIffff", INK, 2, len(s) // 2, z, 3, 0, 0, tail=s),
        obj(6, 1, font(0, 0, "")), rec(0x4036, 0x8001, "IIIIHH2f", INK, 0, 0, 2, 65, 66, 5, z), *draw(0), *draw(1), *draw(2), *draw(3), rec(0x401B, 0x4005, "24xI6h", 3, 1, 1, 4, 5, 1, 1 + z),
        E.plus_record(0x400A, 0x8000, struct.pack("<II4f", INK, 1, 0, 0, 1, 2)),
    ))


_FONT_SIZE = "printf('%.1f', z + 0.5)"
_ADVANCE = "0.6 * (z + 0.5) * length('x' || k)"
_LEFT = f"z - CASE k % 4 WHEN 1 THEN {_ADVANCE} / 2 WHEN 2 THEN {_ADVANCE} ELSE 0 END"
_THICK = "greatest(1, floor((z + 0.5) / 14 + 0.5))"


def _pixels(*px) -> str:
    return " || ".join(f"'{v:02x}'" if isinstance(v, int) else f"printf('%02x', ({v})::BIGINT)" for v in px)


def _late(px: str, *box) -> str:
    return want("image", "R", *box, t=SAME, i=f"'2x1:' || {px}")


_PM = "CASE WHEN k % 256 = 0 THEN 0 ELSE least(255, floor(z * 255.0 / (k % 256) + 0.5)) END"
_LAST = _pixels(0, 0, _PM, "k % 256", 0, "z", 0, 255)


@query(expected([
    want("text", "M", "z", 3, f=INKED["f"], t=SAME, x="chr(228) || k", n=f"CASE WHEN k & 2 = 2 THEN 'italic ' ELSE '' END || CASE WHEN k & 1 = 1 THEN 'bold ' ELSE '' END || {_FONT_SIZE} || 'px ' || CASE WHEN k % 2 = 1 THEN '\"My Font\"' ELSE 'Arial' END",
         a="CASE k % 4 WHEN 1 THEN 'center' WHEN 2 THEN 'right' ELSE 'left' END", b="'top'"),
    f"CASE WHEN k & 4 = 4 THEN {inked('R', _LEFT, '3 + floor(0.12 * (z + 0.5) + 0.5)', _ADVANCE, _THICK)} END",
    want("text", "M", 5, "z", f=INKED["f"], t=SAME, x="'AB'", n="'12px sans-serif'", a="'left'", b="'alphabetic'"), inked("R", 0, 0, 1, 2),
    _late(_pixels("z", 2, 1, 255, 6, 5, 4, 255), "z", 0, 2, 3), _late(_pixels(3, 2, 1, 255, 6, 5, 4, 255), "z", 0, 2, 3), _late(_pixels(3, 2, 1, "k % 256", 6, 5, 4, "z"), "z", 0, 2, 3),
    _late(_LAST, "z", 0, 2, 3), _late(_LAST, 1, 1, 5, "z"),
]))
def plus_text_and_images(spark, d):
    """Strings with formats and decorations, driver strings, raw bitmaps of every format, and images that come last."""
    return lines(files(parts(spark, d), _plus_texts))


# WMF


def wmf(rtype: int, fmt: str = "", *v, tail: bytes = b"") -> bytes:
    return E.wmf_record(rtype, struct.pack("<" + fmt, *v) + tail)


def _use(slot: int) -> bytes:
    return wmf(0x12D, "H", slot)


def _wmf_file(r: dict) -> bytes:
    k, z = r["k"], r["z"]
    name = b"Arial\0junk"
    arc = (0, 0, 40, 20, z, k % 97, k % 89, z)[::-1]
    pts = struct.pack("<6h", z, 1, 9, 2, 3, k % 11)
    box = wmf(0x41B, "4h", 9, z, 2, 1)
    return E.wmf([
        wmf(0x2FA, "HhhI", z % 6, z, 0, k & 0xFFFFFF), wmf(0x2FC, "HIH", z % 2, (k * 7) & 0xFFFFFF, 0), wmf(0x2FB, "hhhhhBBB5x", -z, 0, 0, 0, 700, 1, 1, 1, tail=name), _use(0), _use(1), box, wmf(0x1E), wmf(0x1F0, "H", 0),
        wmf(0x2FA, "HhhI", 0, 0, 0, 0xFF), _use(0), wmf(0x214, "hh", 4, z), wmf(0x213, "hh", 7, 8), wmf(0x127), wmf(0x213, "hh", z, 1), wmf(0x20B, "hh", 2, 1), wmf(0x20C, "hh", 32, 128), box,
        wmf(0x20B, "hh", 0, 0), wmf(0x20C, "hh", 64, 64), wmf(0x2FA, "HhhI", 0, 2, 0, 0), _use(3), wmf(0x2FC, "HIH", 0, 0xFF00, 0), _use(4), wmf(0x418, "4h", 9, z, 0, 0), wmf(0x61C, "6h", 8, z, 0, 0, 20, 30),
        wmf(0x817, "8h", *arc), wmf(0x81A, "8h", *arc), wmf(0x830, "8h", *arc), wmf(0x106, "H", 1 + k % 2), wmf(0x324, "h", 3, tail=pts), wmf(0x325, "h", 3, tail=pts),
        wmf(0x538, "3H", 2, 2, 3, tail=struct.pack("<4h", 0, 0, z, z) + pts), wmf(0x104, "H", 4), wmf(0x213, "hh", 0, 0), wmf(0x209, "I", k & 0xFFFFFF), wmf(0x201, "I", 5), wmf(0x102, "H", 2), wmf(0x12E, "H", 6), _use(2),
        wmf(0x521, "h", 3, tail=b"abc\0" + struct.pack("<hh", 3, z)), wmf(0xA32, "hhhH", 1, 2, 2, 4, tail=bytes(8) + b"de"), wmf(0xA32, "hhhH", z, 2, 2, 0, tail=b"fg"),
    ])


_WMF_DASH = "CASE z % 6 WHEN 1 THEN ' d=8000,4000' WHEN 2 THEN ' d=2000,2000' WHEN 3 THEN ' d=8000,4000,2000,4000' WHEN 4 THEN ' d=8000,4000,2000,4000,2000,4000' ELSE '' END"


def _first(op: str, *geom) -> str:
    """A line by the first brush, which may be hollow, or the first pen, which may be null."""
    if op == "fill":
        return f"CASE WHEN z % 2 = 0 THEN {fill(*geom, f=hex_color('k * 7'))} END"
    return f"CASE WHEN z % 6 < 5 THEN {stroke(*geom, s=hex_color('k'), w='greatest(z, 1) * 1000')} || {_WMF_DASH} END"


def _green(*geom, r: str = "'nonzero'") -> list[str]:
    return [fill(*geom, f="'#00ff00'", r=r), stroke(*geom, w="2000")]


_WP = ("M", "z", 1, "L", 9, 2, "L", 3, "k % 11")
_SPLIT = "CASE WHEN k % 2 = 0 THEN 'evenodd' ELSE 'nonzero' END"
_RAD = "least(z / 2.0, 4.0)"
_SAID = {"f": hex_color("k"), "n": "'italic bold ' || greatest(z, 8) || 'px Arial'", "a": "'left'", "b": "'top'"}


@query(expected([
    _first("fill", "R", 1, 2, "z - 1", 7), _first("stroke", "R", 1, 2, "z - 1", 7), stroke("M", "z", 4, "L", 8, 7, s="'#ff0000'"), _first("stroke", "M", 0, 0, "L", 1, "z"),
    _first("fill", "R", 0, 0, "(z - 1) * 0.5", 14), _first("stroke", "R", 0, 0, "(z - 1) * 0.5", 14), *_green("A", "z / 2.0", 4.5, "z / 2.0", 4.5, 0, 4 * _Q, 0, "Z"),
    *_green("M", _RAD, 0, "A", f"30 - {_RAD}", _RAD, _RAD, _RAD, -_Q, 0, 1, "A", f"30 - {_RAD}", f"20 - {_RAD}", _RAD, _RAD, 0, _Q, 1, "A", _RAD, f"20 - {_RAD}", _RAD, _RAD, _Q, 2 * _Q, 1, "A", _RAD, _RAD, _RAD, _RAD, 2 * _Q, 3 * _Q, 1, "Z"),
    stroke("M", *_FROM, *_ARC, w="2000"), *_green("M", 20, 10, "L", *_FROM, *_ARC, "Z"), *_green("M", *_FROM, *_ARC, "Z"), *_green(*_WP, "Z", r=_SPLIT), stroke(*_WP, w="2000"),
    *_green("M", 0, 0, "L", "z", "z", "Z", *_WP, "Z", r=_SPLIT), stroke("M", 1, "z", "L", 0, 0, s="'#ffffff'", w="2000"),
    want("text", "M", "z", 3, f=_SAID["f"], x="'abc'", n=_SAID["n"], a="'left'", b="'top'"), want("text", "M", 2, 1, f=_SAID["f"], x="'de'", n=_SAID["n"], a="'left'", b="'top'"),
    want("text", "M", 2, "z", f=_SAID["f"], x="'fg'", n=_SAID["n"], a="'left'", b="'top'"),
]))
def wmf_drawings(spark, d):
    """WMF state, objects in the lowest free slots, windows, every shape, text with and without a rectangle."""
    made = files(parts(spark, d), _wmf_file)
    return lines(made)


