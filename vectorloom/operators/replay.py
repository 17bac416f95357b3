"""Ordered replay of one file's records to its display list.

The records of a file mutate one drawing state, so a file is folded sequentially; files are
independent, so ``display_list`` folds each where it was read and shuffles nothing. Handlers are
registered by record number with the least record size they need. Drawing handlers append rows;
nothing is rasterised here. A handler that meets malformed bytes skips its record.
"""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame

from .. import constants as K
from . import bitmaps, clip, glyphs, plus
from .framing import emf_records, plus_comment, plus_records, wmf_records
from .plus import IDENTITY, Cursor, at, times


@dataclass(frozen=True)
class State:
    """What SaveDC keeps. Frozen, so a saved state is the state itself."""

    pen_style: int = 0
    pen_width: float = 1.0
    pen_color: str = "#000000"
    brush_style: int = 0
    brush_color: str = "#ffffff"
    text_color: str = "#000000"
    bk_color: str = "#ffffff"
    bk_mode: int = 1
    font: tuple = (12, 400, False, False, False, "sans-serif")
    rop2: int = 13
    x: float = 0.0
    y: float = 0.0
    fill_mode: int = 1
    align: int = 0
    world: tuple = IDENTITY


def colorref(v: int) -> str:
    return f"#{v & 255:02x}{v >> 8 & 255:02x}{v >> 16 & 255:02x}"


def inverted(color: str) -> str:
    """The inverse of #rgb, #rrggbb, rgb() and rgba(), channels cut off at 255; other strings unchanged."""
    c = color.strip().lower()
    if c.startswith("#") and len(c) in (4, 7):
        digits = c[1:] if len(c) == 7 else "".join(x * 2 for x in c[1:])
        try:
            return "#" + bytes(255 - v for v in bytes.fromhex(digits)).hex()
        except ValueError:
            return color
    name, _, rest = c.partition("(")
    parts = [x.strip() for x in rest.removesuffix(")").split(",")]
    if name in ("rgb", "rgba") and rest.endswith(")") and len(parts) in (3, 4) and all(x.isdecimal() for x in parts[:3]):
        flipped = [str(255 - min(255, int(x))) for x in parts[:3]]
        return f"rgba({','.join([*flipped, parts[3]])})" if len(parts) == 4 else f"rgb({','.join(flipped)})"
    return color


def rop_color(mode: int, color: str) -> str:
    kind = K.ROP2.get(mode, K.ROP2[13])[1]
    if kind == "invert":
        return inverted(color)
    return {"black": "#000000", "white": "#ffffff", "transparent": "transparent"}.get(kind, color)


EMF_HANDLERS: dict[int, tuple[int, Callable]] = {}
WMF_HANDLERS: dict[int, tuple[int, Callable]] = {}
PLUS_HANDLERS: dict[int, Callable] = {}


def emf(*numbers: int, least: int = 8):
    return lambda f: [EMF_HANDLERS.__setitem__(n, (least, f)) for n in numbers] and f


def wmf(*numbers: int, least: int = 6):
    return lambda f: [WMF_HANDLERS.__setitem__(n, (least, f)) for n in numbers] and f


def on_plus(*numbers: int):
    return lambda f: [PLUS_HANDLERS.__setitem__(n, f) for n in numbers] and f


class Replay:
    """Drawing state and display list of one file."""

    def __init__(self, bounds: tuple[int, int, int, int], canvas: tuple[int, int], dpi: float = 1.0, fonts: dict[str, str] | None = None, most_plus: int = K.MAX_PLUS_RECORDS):
        left, top, right, bottom = bounds
        self.left, self.top = left, top
        w, h = right - left, bottom - top
        self.canvas, self.dpi, self.most_plus = canvas, dpi, most_plus
        self.fonts = {k.lower().strip(): v for k, v in (fonts or {}).items()}
        self.sx, self.sy = (canvas[0] / w if w else 1.0), (canvas[1] / h if h else 1.0)
        self.s, self.saved = State(), []
        self.window, self.extent, self.view, self.view_extent = (left, top), (w, h), (0, 0), canvas
        self.mapping = False
        self.objects: dict[int, tuple] = {}
        self.clip: clip.Region = None
        self.exact = True
        self.path: list[clip.Command] = []
        self.in_path = False
        self.ops: list[dict] = []
        self.late: list[dict] = []
        self.seq = 0
        self.gco, self.dash = "source-over", []
        self.plus_objects: dict[int, dict] = {}
        self.plus_world, self.plus_clip, self.plus_saved = IDENTITY, (None, True), []
        self.unit = 1.0
        self.partial: tuple | None = None
        self.unhandled: list[int] = []

    # Coordinates

    def gx(self, x: float) -> float:
        p = self.s.world[0] * x + self.s.world[4]
        return (p - self.window[0]) / (self.extent[0] or 1) * (self.view_extent[0] or 1) + self.view[0] if self.mapping else (p - self.left) * self.sx

    def gy(self, y: float) -> float:
        p = self.s.world[3] * y + self.s.world[5]
        return (p - self.window[1]) / (self.extent[1] or 1) * (self.view_extent[1] or 1) + self.view[1] if self.mapping else (p - self.top) * self.sy

    def gw(self, w: float) -> float:
        return self.s.world[0] * w * ((self.view_extent[0] or 1) / (self.extent[0] or 1) if self.mapping else self.sx)

    def gh(self, h: float) -> float:
        return self.s.world[3] * h * ((self.view_extent[1] or 1) / (self.extent[1] or 1) if self.mapping else self.sy)

    def pt(self, x: float, y: float) -> list[float]:
        return [float(self.gx(x)), float(self.gy(y))]

    # Display list

    def emit(self, op: str, geom: list[clip.Command], **more) -> None:
        self.ops.append({"seq": self.seq, "op": op, "geom": geom, "gco": self.gco, "clip": self.clip, "exact": self.exact} | more)

    def rule(self) -> str:
        return "evenodd" if self.s.fill_mode == 1 else "nonzero"

    def fill(self, geom: list[clip.Command], rule: str = "nonzero") -> None:
        if self.s.brush_style != 1:
            self.gco = K.ROP2.get(self.s.rop2, K.ROP2[13])[0]
            self.emit("fill", geom, fill=rop_color(self.s.rop2, self.s.brush_color), fill_rule=rule)

    def stroke(self, geom: list[clip.Command]) -> None:
        if self.s.pen_style != 5:
            self.gco, self.dash = K.ROP2.get(self.s.rop2, K.ROP2[13])[0], [float(v) for v in K.GDI_DASH.get(self.s.pen_style, [])]
            self.emit("stroke", geom, stroke=rop_color(self.s.rop2, self.s.pen_color), line_width=float(max(self.s.pen_width, 1)), dash=self.dash)

    def draw(self, geom: list[clip.Command], filled: bool = True, rule: str = "nonzero") -> None:
        """Into the open path bracket, or onto the canvas."""
        if self.in_path:
            self.path += geom
            return
        if filled:
            self.fill(geom, rule)
        self.stroke(geom)

    def text(self, s: str, x: float, y: float, size: float, align: str, baseline: str, color: str, font: tuple, transform=None) -> None:
        _, weight, italic, underline, strike, family = font
        r = math.floor(weight / 100 + 0.5) * 100
        bold = "" if r == 400 or weight == 0 else "bold" if r == 700 or r > 900 else str(r) if r >= 100 else ""
        name = self.fonts.get(family.lower().strip(), family)
        name = f'"{name}"' if any(c in name for c in " ,\t") and name[:1] not in "\"'" else name
        css = " ".join(v for v in ("italic" if italic else "", bold, f"{size:g}px", name) if v)
        more = {"transform": transform} if transform else {}
        self.emit("text", [("M", [x, y])], fill=color, text=s, font=css, align=align, baseline=baseline, size=size, bold=weight >= 600, **more)
        thick = max(1, math.floor(size / 14 + 0.5))
        width = glyphs.width(s, size)
        left = x - {"center": width / 2, "right": width}.get(align, 0)
        for on, dy in ((underline, math.floor(0.12 * size + 0.5)), (strike, -math.floor(0.3 * size + 0.5))):
            if on:
                self.emit("fill", [("R", [left, y + dy, width, thick])], fill=color, fill_rule="nonzero", **more)

    def pixels(self, image, x: float, y: float, w: float, h: float) -> None:
        if image is not None:
            self.emit("image", [("R", [x, y, w, h])], pixels=image)

    def change_clip(self, region: clip.Region, op: str) -> None:
        self.clip, ok = clip.combine_regions(self.clip, region, op)
        self.exact = ok and (self.exact or op == "replace")

    # Streams

    def run_emf(self, b: bytes, most: int) -> None:
        for r in emf_records(b, most):
            self.seq = r.seq
            if span := plus_comment(b, r):
                self.run_plus(b, *span)
            elif r.rtype in EMF_HANDLERS:
                least, f = EMF_HANDLERS[r.rtype]
                if r.size >= least:
                    self.guard(f, Cursor(b, r.data, r.off + r.size), r)
            elif r.rtype not in (14, 70, *K.EMF_SKIPPED):
                self.unhandled.append(r.rtype)

    def run_wmf(self, b: bytes, off: int, most: int) -> None:
        w, h = self.extent
        self.window, self.view_extent, self.mapping = (self.left, self.top), self.canvas, True
        self.extent = (w, h)
        for r in wmf_records(b, off, most):
            self.seq = r.seq
            if r.rtype in WMF_HANDLERS:
                least, f = WMF_HANDLERS[r.rtype]
                if r.size >= least:
                    self.guard(f, Cursor(b, r.data, r.off + r.size), r)

    def run_plus(self, b: bytes, off: int, end: int) -> None:
        """Page transform and an unfinished object last for one comment; all else carries on."""
        self.unit, self.partial = 1.0, None
        gdi, (self.clip, self.exact) = (self.clip, self.exact), self.plus_clip
        for r in plus_records(b, off, end, self.most_plus):
            if r.rtype == 0x4008:
                self.guard(_object, Cursor(b, r.data, r.data + r.data_size), r)
                continue
            if (f := PLUS_HANDLERS.get(r.rtype)) is not None:
                self.guard(f, Cursor(b, r.data, r.data + r.data_size), r)
            elif r.rtype not in K.EMFPLUS:
                self.unhandled.append(r.rtype)
        self.plus_clip, (self.clip, self.exact) = (self.clip, self.exact), gdi

    def guard(self, f: Callable, c: Cursor, r) -> None:
        try:
            f(self, c, r)
        except (struct.error, ValueError, IndexError, OverflowError, ZeroDivisionError):
            return

    @property
    def plus_matrix(self) -> tuple:
        k = self.unit * self.dpi
        return tuple(v * k for v in self.plus_world)


# GDI state


def _set(field: str, read: Callable[[Cursor], object]):
    def f(d: Replay, c: Cursor, r) -> None:
        d.s = replace(d.s, **{field: read(c)})

    return f


for _n, _field, _read in (
    (24, "text_color", lambda c: colorref(c.take("I"))), (25, "bk_color", lambda c: colorref(c.take("I"))), (18, "bk_mode", lambda c: c.take("I")),
    (19, "fill_mode", lambda c: c.take("I")), (20, "rop2", lambda c: c.take("I")), (22, "align", lambda c: c.take("I")),
):
    EMF_HANDLERS[_n] = (12, _set(_field, _read))
for _n, _field, _read, _least in (
    (0x209, "text_color", lambda c: colorref(c.take("I")), 10), (0x201, "bk_color", lambda c: colorref(c.take("I")), 10), (0x102, "bk_mode", lambda c: c.take("H"), 8),
    (0x106, "fill_mode", lambda c: c.take("H"), 8), (0x104, "rop2", lambda c: c.take("H"), 8), (0x12E, "align", lambda c: c.take("H"), 8),
):
    WMF_HANDLERS[_n] = (_least, _set(_field, _read))
for _n in (21, 58):
    EMF_HANDLERS[_n] = (8, lambda d, c, r: None)


@emf(33)
@wmf(0x1E)
def save(d: Replay, c: Cursor, r) -> None:
    d.saved.append((d.s, d.clip, d.exact))


@emf(34, least=12)
def restore(d: Replay, c: Cursor, r) -> None:
    """To a level counted from 1, or back from the last; one past the stack is the last, one before it empties the stack."""
    level = c.take("i")
    del d.saved[max(0, len(d.saved) + level + 1 if level < 0 else level) :]
    if d.saved:
        d.s, d.clip, d.exact = d.saved.pop()


@wmf(0x127)
def restore_one(d: Replay, c: Cursor, r) -> None:
    if d.saved:
        d.s = d.saved.pop()[0]


def _place(field: str, fmt: str, swap: bool = False):
    def f(d: Replay, c: Cursor, r) -> None:
        v = c.take(fmt)
        setattr(d, field, v[::-1] if swap else v)
        d.mapping = True

    return f


for _n, _field in ((9, "extent"), (10, "window"), (11, "view_extent"), (12, "view")):
    EMF_HANDLERS[_n] = (16, _place(_field, "ii"))
WMF_HANDLERS[0x20B], WMF_HANDLERS[0x20C] = (10, _place("window", "hh", True)), (10, _place("extent", "hh", True))


@emf(17, least=12)
def map_mode(d: Replay, c: Cursor, r) -> None:
    d.mapping = d.mapping or c.take("I") in (7, 8)


@emf(31, 32, least=24)
def scale_extent(d: Replay, c: Cursor, r) -> None:
    v, field = c.take("4i"), "view_extent" if r.rtype == 31 else "extent"
    part = lambda e, n, q: math.floor(e * n / q + 0.5) if q else e
    w, h = getattr(d, field)
    setattr(d, field, (part(w, v[0], v[1]), part(h, v[2], v[3])))
    d.mapping = True


@emf(35, least=32)
def set_world(d: Replay, c: Cursor, r) -> None:
    d.s = replace(d.s, world=c.take("6f"))


@emf(36, least=36)
def modify_world(d: Replay, c: Cursor, r) -> None:
    m, mode = c.take("6f"), c.take("I")
    new = {1: lambda: IDENTITY, 2: lambda: times(m, d.s.world), 3: lambda: times(d.s.world, m)}.get(mode)
    if new:
        d.s = replace(d.s, world=new())


# GDI objects: (kind, fields of the state that selecting it sets)


def _pen(style: int, width: float, color: str) -> tuple:
    return ("pen", {"pen_style": style, "pen_width": width, "pen_color": color})


def _brush(style: int, color: str) -> tuple:
    return ("brush", {"brush_style": style, "brush_color": color})


@emf(38, least=28)
def create_pen(d: Replay, c: Cursor, r) -> None:
    handle, style, width, _, color = c.take("IIiiI")
    d.objects[handle] = _pen(style & 255, width, colorref(color))


@emf(95, least=52)
def ext_create_pen(d: Replay, c: Cursor, r) -> None:
    # style, width and colour at 12, 16 and 24
    handle, style, width, color = struct.unpack_from("<I8xII4xI", c.b, c.pos)
    d.objects[handle] = _pen(style & 255, width, colorref(color))


@emf(39, least=24)
def create_brush(d: Replay, c: Cursor, r) -> None:
    handle, style, color = c.take("III")
    d.objects[handle] = _brush(style, colorref(color))


@emf(82, least=332)
def create_font(d: Replay, c: Cursor, r) -> None:
    b = c.raw(c.pos)
    handle, height, weight = struct.unpack_from("<Ii12xi", b)
    name = b[28:92].decode("utf-16-le", "replace").split("\0")[0]  # four bytes early, which results must equal
    d.objects[handle] = ("font", {"font": (abs(height), weight, bool(b[24]), bool(b[25]), bool(b[26]), name or "sans-serif")})


@emf(40, least=12)
def delete(d: Replay, c: Cursor, r) -> None:
    d.objects.pop(c.take("I"), None)


@emf(37, least=12)
def select(d: Replay, c: Cursor, r) -> None:
    handle = c.take("I")
    if handle >= 0x80000000:
        kind, style, value = K.STOCK.get(handle & 0x7FFFFFFF, ("", 0, ""))
        found = {"pen": _pen(style, 1, value), "brush": _brush(style, value), "font": ("font", {"font": (12, 400, False, False, False, value)})}.get(kind)
    else:
        found = d.objects.get(handle)
    if found:
        d.s = replace(d.s, **found[1])


def _slot(d: Replay, thing: tuple) -> None:
    d.objects[next(i for i in range(len(d.objects) + 1) if i not in d.objects)] = thing


@wmf(0x2FA, least=16)
def wmf_pen(d: Replay, c: Cursor, r) -> None:
    style, width, _, color = c.take("HhhI")
    _slot(d, _pen(style & 255, width, colorref(color)))


@wmf(0x2FC, least=14)
def wmf_brush(d: Replay, c: Cursor, r) -> None:
    style, color = c.take("HI")
    _slot(d, _brush(style, colorref(color)))


@wmf(0x2FB, least=24)
def wmf_font(d: Replay, c: Cursor, r) -> None:
    height, _, _, _, weight, italic, underline, strike = c.take("hhhhhBBB")
    name = c.raw(c.pos + 5).split(b"\0")[0].decode("latin-1")
    _slot(d, ("font", {"font": (abs(height), weight, bool(italic), bool(underline), bool(strike), name or "sans-serif")}))


@wmf(0x12D, least=8)
def wmf_select(d: Replay, c: Cursor, r) -> None:
    if found := d.objects.get(c.take("H")):
        d.s = replace(d.s, **found[1])


@wmf(0x1F0, least=8)
def wmf_delete(d: Replay, c: Cursor, r) -> None:
    d.objects.pop(c.take("H"), None)


# GDI shapes; WMF stores operands in reverse


def _box(d: Replay, l, t, r, b) -> tuple[float, float, float, float]:  # noqa: E741
    return (*d.pt(l, t), *d.pt(r, b))


@emf(15, least=20)
def pixel(d: Replay, c: Cursor, r) -> None:
    x, y, color = c.take("iiI")
    d.emit("fill", [("R", [*d.pt(x, y), 1.0, 1.0])], fill=colorref(color), fill_rule="nonzero")


def _move(d: Replay, x, y) -> None:
    d.s = replace(d.s, x=x, y=y)
    if d.in_path:
        d.path.append(("M", d.pt(x, y)))


def _line(d: Replay, x, y) -> None:
    if d.in_path:
        d.path.append(("L", d.pt(x, y)))
    else:
        d.stroke([("M", d.pt(d.s.x, d.s.y)), ("L", d.pt(x, y))])
    d.s = replace(d.s, x=x, y=y)


def _rectangle(d: Replay, l, t, r, b) -> None:  # noqa: E741
    x0, y0, x1, y1 = _box(d, l, t, r, b)
    d.draw([("R", [x0, y0, x1 - x0, y1 - y0])])


def _round(d: Replay, l, t, r, b, w, h) -> None:  # noqa: E741
    x0, y0, x1, y1 = _box(d, l, t, r, b)
    k = min(abs(d.gw(w)) / 2, abs(d.gh(h)) / 2, abs(x1 - x0) / 2, abs(y1 - y0) / 2)
    (x0, x1), (y0, y1), q = sorted((x0, x1)), sorted((y0, y1)), math.pi / 2
    corners = [(x1 - k, y0 + k, -q), (x1 - k, y1 - k, 0.0), (x0 + k, y1 - k, q), (x0 + k, y0 + k, 2 * q)]
    d.draw([("M", [x0 + k, y0]), *[("A", [cx, cy, k, k, a, a + q, 1.0]) for cx, cy, a in corners], ("Z", [])])


def _ellipse(d: Replay, l, t, r, b) -> None:  # noqa: E741
    x0, y0, x1, y1 = _box(d, l, t, r, b)
    d.draw([("A", [(x0 + x1) / 2, (y0 + y1) / 2, abs(x1 - x0) / 2, abs(y1 - y0) / 2, 0.0, 2 * math.pi, 0.0]), ("Z", [])])


def _arc(d: Replay, kind: str, l, t, r, b, sx, sy, ex, ey) -> None:  # noqa: E741
    ox, oy, w, h = (l + r) / 2, (t + b) / 2, abs(r - l) / 2, abs(b - t) / 2
    # Angles are taken before mapping, and arcs run clockwise.
    a, z = (math.atan2((y - oy) / (h or 1), (x - ox) / (w or 1)) for x, y in ((sx, sy), (ex, ey)))
    z += 2 * math.pi if z < a else 0
    cx, cy, rx, ry = d.gx(ox), d.gy(oy), abs(d.gw(w)), abs(d.gh(h))
    start, arc = [cx + rx * math.cos(a), cy + ry * math.sin(a)], ("A", [cx, cy, rx, ry, a, z, 1.0])
    if kind == "to":
        geom = [("L" if d.in_path else "M", start), arc]
        d.s = replace(d.s, x=ex, y=ey)
    elif kind == "pie":
        geom = [("M", [cx, cy]), ("L", start), arc, ("Z", [])]
    else:
        geom = [*([] if d.in_path else [("M", start)]), arc, *([("Z", [])] if kind == "chord" else [])]
    d.draw(geom, filled=kind in ("pie", "chord"))


EMF_HANDLERS |= {
    27: (16, lambda d, c, r: _move(d, *c.take("ii"))),
    54: (16, lambda d, c, r: _line(d, *c.take("ii"))),
    43: (24, lambda d, c, r: _rectangle(d, *c.take("4i"))),
    44: (32, lambda d, c, r: _round(d, *c.take("6i"))),
    42: (24, lambda d, c, r: _ellipse(d, *c.take("4i"))),
    45: (40, lambda d, c, r: _arc(d, "arc", *c.take("8i"))),
    55: (40, lambda d, c, r: _arc(d, "to", *c.take("8i"))),
    46: (40, lambda d, c, r: _arc(d, "chord", *c.take("8i"))),
    47: (40, lambda d, c, r: _arc(d, "pie", *c.take("8i"))),
}
WMF_HANDLERS |= {
    0x214: (10, lambda d, c, r: _move(d, *c.take("hh")[::-1])),
    0x213: (10, lambda d, c, r: _line(d, *c.take("hh")[::-1])),
    0x41B: (14, lambda d, c, r: _rectangle(d, *c.take("4h")[::-1])),
    0x61C: (18, lambda d, c, r: (lambda v: _round(d, v[5], v[4], v[3], v[2], v[1], v[0]))(c.take("6h"))),
    0x418: (14, lambda d, c, r: _ellipse(d, *c.take("4h")[::-1])),
    0x817: (22, lambda d, c, r: _arc(d, "arc", *c.take("8h")[::-1])),
    0x81A: (22, lambda d, c, r: _arc(d, "pie", *c.take("8h")[::-1])),
    0x830: (22, lambda d, c, r: _arc(d, "chord", *c.take("8h")[::-1])),
}

# Polygons and paths


def _poly(d: Replay, pts: list, kind: str, to: bool) -> None:
    p = [d.pt(*q) for q in pts]
    # Outside a bracket there is no current figure to continue, so one starts at the first point.
    head: list[clip.Command] = [] if to and d.in_path else [("M", p[0])]
    body = p if to else p[1:]
    if kind == "bezier":
        body_cmds = [("C", [v for q in body[i : i + 3] for v in q]) for i in range(0, len(body) - 2, 3)]
    else:
        body_cmds = [("L", q) for q in body]
    geom = [*head, *body_cmds, *([("Z", [])] if kind == "polygon" else [])]
    d.draw(geom, kind == "polygon", d.rule())
    d.s = replace(d.s, x=pts[-1][0], y=pts[-1][1])


#: Kind, whether it continues from the current position, and the record numbers with long and short points.
POLYS = (("polygon", False, 3, 86), ("line", False, 4, 87), ("bezier", False, 2, 85), ("bezier", True, 5, 88), ("line", True, 6, 89))


def _read_points(c: Cursor, n: int, fmt: str) -> list:
    v = c.take(f"{2 * n}{fmt}")
    return list(zip(v[::2], v[1::2], strict=True))


def _emf_poly(kind: str, to: bool, fmt: str):
    def f(d: Replay, c: Cursor, r) -> None:
        c.pos += 16
        if n := c.take("I"):
            _poly(d, _read_points(c, n, fmt), kind, to)

    return f


for _kind, _to, _long, _short in POLYS:
    EMF_HANDLERS[_long], EMF_HANDLERS[_short] = (28, _emf_poly(_kind, _to, "i")), (28, _emf_poly(_kind, _to, "h"))


def _polypoly(closed: bool, fmt: str):
    def f(d: Replay, c: Cursor, r) -> None:
        c.pos += 16
        polys, points = c.take("II")
        if not 0 < polys < K.MAX_POLYS or not 0 < points < K.MAX_POINTS:
            return
        counts = [c.take("I") for _ in range(polys)]
        geom: list[clip.Command] = []
        for n in counts:
            p = [d.pt(*q) for q in _read_points(c, n, fmt)]
            geom += [("M" if i == 0 else "L", q) for i, q in enumerate(p)] + ([("Z", [])] if closed and p else [])
        d.draw(geom, closed, d.rule())

    return f


EMF_HANDLERS |= {7: (28, _polypoly(False, "i")), 8: (28, _polypoly(True, "i")), 91: (28, _polypoly(True, "h"))}


@wmf(0x324, 0x325, least=10)
def wmf_poly(d: Replay, c: Cursor, r) -> None:
    if (n := c.take("h")) > 0:
        p = [d.pt(*q) for q in _read_points(c, n, "h")]
        d.draw([("M" if i == 0 else "L", q) for i, q in enumerate(p)] + ([("Z", [])] if r.rtype == 0x324 else []), r.rtype == 0x324, d.rule())


@wmf(0x538, least=10)
def wmf_polypoly(d: Replay, c: Cursor, r) -> None:
    counts = [c.take("H") for _ in range(c.take("H"))]
    geom: list[clip.Command] = []
    for n in counts:
        geom += [("M" if i == 0 else "L", d.pt(*q)) for i, q in enumerate(_read_points(c, n, "h"))] + [("Z", [])]
    d.draw(geom, True, d.rule())


@emf(59)
def begin_path(d: Replay, c: Cursor, r) -> None:
    d.in_path, d.path = True, []


@emf(60)
def end_path(d: Replay, c: Cursor, r) -> None:
    d.in_path = False


@emf(61)
def close_figure(d: Replay, c: Cursor, r) -> None:
    d.path.append(("Z", []))


@emf(62, 63, 64)
def paint_path(d: Replay, c: Cursor, r) -> None:
    if r.rtype != 64:
        d.fill(list(d.path), d.rule())
    if r.rtype != 62:
        d.stroke(list(d.path))


@emf(67)
def clip_path(d: Replay, c: Cursor, r) -> None:
    mode = c.take("I") if r.size >= 12 else 5
    if mode in RGN:
        d.change_clip([clip.Shape(list(d.path), d.rule(), False)], RGN[mode])


#: Region modes of GDI.
RGN = {1: "intersect", 2: "union", 3: "xor", 4: "exclude", 5: "replace"}


@emf(29, 30, least=24)
def clip_rect(d: Replay, c: Cursor, r) -> None:
    d.change_clip([clip.rect(*_box(d, *c.take("4i")))], "exclude" if r.rtype == 29 else "intersect")


@emf(75, least=16)
def clip_region(d: Replay, c: Cursor, r) -> None:
    size, mode = c.take("II")
    if mode not in RGN:
        return
    if size < 32:
        if mode == 5:
            d.clip, d.exact = None, True
        return
    n = struct.unpack_from("<I", c.b, c.pos + 8)[0]
    c.pos += 32
    d.change_clip([clip.rects([_box(d, *c.take("4i")) for _ in range(n)]) if n else clip.empty()], RGN[mode])


@emf(26, least=16)
def offset_clip(d: Replay, c: Cursor, r) -> None:
    x, y = c.take("ii")
    d.clip = clip.translate(d.clip, d.gw(x), d.gh(y))


# Text and bitmaps


@emf(84, least=76)
def text_out(d: Replay, c: Cursor, r) -> None:
    x, y, n, off = struct.unpack_from("<iiII", c.b, r.off + 36)
    s = c.raw(r.off + off, r.off + off + 2 * n).decode("utf-16-le", "replace").split("\0")[0]
    if not s:
        return
    size = max(d.s.font[0] * (abs(d.gh(1)) or 1), 8)
    align = "right" if d.s.align & 2 else "center" if d.s.align & 6 else "left"
    baseline = {0x18: "alphabetic", 0x08: "bottom"}.get(d.s.align & 0x18, "top")
    px, py = d.pt(x, y)
    if d.s.bk_mode == 2:
        d.emit("fill", [("R", [px, py - size, glyphs.width(s, size), size])], fill=d.s.bk_color, fill_rule="nonzero")
    d.text(s, px, py, size, align, baseline, d.s.text_color, d.s.font)


def _wmf_text(d: Replay, s: bytes, x: int, y: int) -> None:
    if s:
        size = max(d.s.font[0] * (abs(d.gh(1)) or 1), 8)
        d.text(s.split(b"\0")[0].decode("latin-1"), *d.pt(x, y), size, "left", "top", d.s.text_color, (*d.s.font[:3], False, False, d.s.font[5]))


@wmf(0x521, least=12)
def wmf_text_out(d: Replay, c: Cursor, r) -> None:
    n = c.take("h")
    s = c.raw(c.pos, c.pos + n)
    c.pos += n + n % 2
    y, x = c.take("hh")
    _wmf_text(d, s, x, y)


@wmf(0xA32, least=14)
def wmf_ext_text_out(d: Replay, c: Cursor, r) -> None:
    y, x, n, opts = c.take("hhhH")
    c.pos += 8 if opts & 4 else 0
    _wmf_text(d, c.raw(c.pos, c.pos + n), x, y)


@emf(76, least=96)
def bit_blt(d: Replay, c: Cursor, r) -> None:
    x, y, w, h, rop = struct.unpack_from("<4iI", c.b, r.off + 24)
    header, header_size, bits, bits_size = struct.unpack_from("<4I", c.b, r.off + 84)
    px, py = d.pt(x, y)
    if not bits_size:
        if rop == 0x00F00021 and d.s.brush_style != 1:
            d.emit("fill", [("R", [px, py, d.gw(w), d.gh(h)])], fill=d.s.brush_color, fill_rule="nonzero")
        return
    d.pixels(_dib(c, r, header, bits, bits_size), px, py, d.gw(w), d.gh(h))


def _dib(c: Cursor, r, header: int, bits: int, bits_size: int):
    return bitmaps.dib(c.raw(r.off, r.off + r.size), header, bits, bits_size) if bits_size else None


@emf(81, least=80)
def stretch_dib(d: Replay, c: Cursor, r) -> None:
    x, y = struct.unpack_from("<ii", c.b, r.off + 24)
    header, _, bits, bits_size = struct.unpack_from("<4I", c.b, r.off + 48)
    w, h = struct.unpack_from("<ii", c.b, r.off + 72)
    d.pixels(_dib(c, r, header, bits, bits_size), *d.pt(x, y), d.gw(w), d.gh(h))


# EMF+


def _object(d: Replay, c: Cursor, r) -> None:
    """Continued objects gather their parts until the last one, or one of another id."""
    ident, kind, data = r.flags & 0xFF, r.flags >> 8 & 0x7F, c.raw(c.pos)
    if r.flags & 0x8000:
        if d.partial and d.partial[:2] == (ident, kind):
            d.partial[3].append(data)
        else:
            total = struct.unpack_from("<I", data)[0]
            d.partial = (ident, kind, total, [data[4:]]) if total <= K.MAX_OBJECT else None
        return
    if d.partial and d.partial[:2] == (ident, kind):
        data = b"".join([*d.partial[3], data])[: d.partial[2]].ljust(d.partial[2], b"\0")
        d.partial = None
    if kind in plus.PARSERS and (got := plus.PARSERS[kind](data)) is not None:
        d.plus_objects[ident] = got


def _paint(d: Replay, flags: int, value: int) -> dict:
    if flags & 0x8000:
        return {"fill": plus.rgba(value)}
    b = d.plus_objects.get(value & 0xFF)
    if not b or b["kind"] != "brush":
        return {"fill": "rgba(0,0,0,1.000)"}
    return {"fill": b["color"]} | ({"gradient": json.dumps(b["gradient"])} if b["gradient"] else {})


def _plus_fill(d: Replay, geom, flags: int, value: int) -> None:
    d.emit("fill", geom, fill_rule="nonzero", transform=list(d.plus_matrix), **_paint(d, flags, value))


def _plus_stroke(d: Replay, geom, ident: int, dashed: bool = True) -> None:
    p = d.plus_objects.get(ident)
    if p and p["kind"] == "pen":
        if dashed:
            d.dash = [float(v * p["width"]) for v in K.PLUS_DASH.get(p["style"], [])]
        d.emit("stroke", geom, stroke=p["color"], line_width=float(p["width"]), dash=d.dash, transform=list(d.plus_matrix))


def _round_box(v) -> list[clip.Command]:
    x, y, w, h = v
    return [("A", [x + w / 2, y + h / 2, abs(w) / 2, abs(h) / 2, 0.0, 2 * math.pi, 0.0]), ("Z", [])]


@on_plus(0x400A, 0x400B)
def plus_rects(d: Replay, c: Cursor, r) -> None:
    short = bool(r.flags & 0x4000)
    value = c.take("I") if r.rtype == 0x400A else 0
    for _ in range(c.take("I")):
        geom = [("R", list(c.rect(short)))]
        _plus_fill(d, geom, r.flags, value) if r.rtype == 0x400A else _plus_stroke(d, geom, r.flags & 0xFF)


@on_plus(0x400E, 0x400F)
def plus_ellipse(d: Replay, c: Cursor, r) -> None:
    value = c.take("I") if r.rtype == 0x400E else 0
    geom = _round_box(c.rect(bool(r.flags & 0x4000)))
    _plus_fill(d, geom, r.flags, value) if r.rtype == 0x400E else _plus_stroke(d, geom, r.flags & 0xFF)


@on_plus(0x4010, 0x4011, 0x4012)
def plus_pie(d: Replay, c: Cursor, r) -> None:
    value = c.take("I") if r.rtype == 0x4010 else 0
    start, sweep = (math.radians(v) for v in c.take("ff"))
    x, y, w, h = c.rect(bool(r.flags & 0x4000))
    arc = [x + w / 2, y + h / 2, abs(w) / 2, abs(h) / 2, start, start + sweep]
    if r.rtype == 0x4010:
        _plus_fill(d, [("M", arc[:2]), ("A", [*arc, 1.0]), ("Z", [])], r.flags, value)
    else:
        _plus_stroke(d, [("A", [*arc, 0.0])], r.flags & 0xFF)


@on_plus(0x400C, 0x400D)
def plus_lines(d: Replay, c: Cursor, r) -> None:
    value = c.take("I") if r.rtype == 0x400C else 0
    pts = c.points(c.take("I"), bool(r.flags & 0x4000))
    closed = r.rtype == 0x400C or bool(r.flags & 0x2000)
    geom = [("M" if i == 0 else "L", list(p)) for i, p in enumerate(pts)] + ([("Z", [])] if closed and pts else [])
    _plus_fill(d, geom, r.flags, value) if r.rtype == 0x400C else _plus_stroke(d, geom, r.flags & 0xFF)


@on_plus(0x4014, 0x4015)
def plus_path(d: Replay, c: Cursor, r) -> None:
    p, value = d.plus_objects.get(r.flags & 0xFF), c.take("I")
    if p and p["kind"] == "path":
        geom = plus.path_commands(p)
        _plus_fill(d, geom, r.flags, value) if r.rtype == 0x4014 else _plus_stroke(d, geom, value & 0xFF, dashed=False)


def _plus_text(d: Replay, s: str, x: float, y: float, r, value: int, align: str, baseline: str) -> None:
    f = d.plus_objects.get(r.flags & 0xFF)
    if s and f and f["kind"] == "font":
        font = (f["size"], 700 if f["bold"] else 400, f["italic"], f["underline"], f["strike"], f["family"])
        d.text(s, x, y, f["size"], align, baseline, _paint(d, r.flags, value)["fill"], font, list(d.plus_matrix))


@on_plus(0x401C)
def plus_string(d: Replay, c: Cursor, r) -> None:
    value, fmt, n, x, y, w, h = c.take("IIIffff")
    s = c.raw(c.pos, c.pos + 2 * n).decode("utf-16-le", "replace").split("\0")[0]
    f = d.plus_objects.get(fmt & 0xFF, {})
    align = {1: "center", 2: "right"}.get(f.get("align", 0) if f.get("kind") == "format" else 0, "left")
    _plus_text(d, s, x, y, r, value, align, "top")


@on_plus(0x4036)
def plus_glyphs(d: Replay, c: Cursor, r) -> None:
    value, _, _, n = c.take("IIII")
    if not 0 < n < K.MAX_POINTS:
        return
    s = c.raw(c.pos, c.pos + 2 * n).decode("utf-16-le", "replace")
    c.pos = (c.pos + 2 * n + 3) & ~3
    _plus_text(d, s, *c.take("ff"), r, value, "left", "alphabetic")


def _plus_image(d: Replay, r, x: float, y: float, w: float, h: float) -> None:
    o = d.plus_objects.get(r.flags & 0xFF)
    if o and o["kind"] == "image":
        d.late.append({"seq": d.seq, "op": "image", "geom": [("R", [x, y, w, h])], "gco": "source-over", "clip": None, "exact": True, "transform": list(d.plus_matrix), "pixels": o["pixels"], "data": o["data"], "metafile": o["metafile"]})


@on_plus(0x401A)
def plus_draw_image(d: Replay, c: Cursor, r) -> None:
    c.pos += 24
    _plus_image(d, r, *c.rect(bool(r.flags & 0x4000)))


@on_plus(0x401B)
def plus_draw_image_points(d: Replay, c: Cursor, r) -> None:
    c.pos += 24
    n = c.take("I")
    if n >= 3:
        (x, y), b, e = c.points(3, bool(r.flags & 0x4000))
        _plus_image(d, r, x, y, math.hypot(b[0] - x, b[1] - y), math.hypot(e[0] - x, e[1] - y))


@on_plus(0x402A, 0x402B, 0x402C, 0x402D, 0x402E, 0x402F)
def plus_transform(d: Replay, c: Cursor, r) -> None:
    kind = r.rtype & 0xF
    if kind == 0xB:
        d.plus_world = IDENTITY
        return
    if kind in (0xA, 0xC):
        m = c.take("6f")
    elif kind == 0xD:
        m = (1.0, 0.0, 0.0, 1.0, *c.take("ff"))
    elif kind == 0xE:
        x, y = c.take("ff")
        m = (x, 0.0, 0.0, y, 0.0, 0.0)
    else:
        a = math.radians(c.take("f"))
        m = (math.cos(a), math.sin(a), -math.sin(a), math.cos(a), 0.0, 0.0)
    d.plus_world = m if kind == 0xA else times(d.plus_world, m) if r.flags & 0x2000 else times(m, d.plus_world)


@on_plus(0x4025, 0x4028)
def plus_save(d: Replay, c: Cursor, r) -> None:
    d.plus_saved.append((c.take("I"), d.plus_world))


@on_plus(0x4026, 0x4029)
def plus_restore(d: Replay, c: Cursor, r) -> None:
    """By the caller's id; newer saves are dropped. Only the transform comes back."""
    ident = c.take("I")
    for i in range(len(d.plus_saved) - 1, -1, -1):
        if d.plus_saved[i][0] == ident:
            d.plus_world = d.plus_saved[i][1]
            del d.plus_saved[i:]
            return


@on_plus(0x4030)
def plus_page(d: Replay, c: Cursor, r) -> None:
    d.unit = K.PAGE_UNIT.get(r.flags & 0xFF, 1.0) * c.take("f")


def _plus_clip(d: Replay, region: clip.Region, flags: int) -> None:
    mode = flags >> 8 & 0xF
    d.change_clip(region, plus.CLIP_OPS[mode] if mode < 6 else "intersect")


@on_plus(0x4031)
def plus_reset_clip(d: Replay, c: Cursor, r) -> None:
    d.clip, d.exact = None, True


@on_plus(0x4032)
def plus_clip_rect(d: Replay, c: Cursor, r) -> None:
    x, y, w, h = c.take("4f")
    m = d.plus_matrix
    _plus_clip(d, [clip.Shape(clip.quad([at(m, *p) for p in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]))], r.flags)


@on_plus(0x4033)
def plus_clip_path(d: Replay, c: Cursor, r) -> None:
    p = d.plus_objects.get(r.flags & 0xFF)
    if p and p["kind"] == "path":
        _plus_clip(d, [clip.Shape(plus.path_commands(p, d.plus_matrix), simple=False)], r.flags)


@on_plus(0x4034)
def plus_clip_region(d: Replay, c: Cursor, r) -> None:
    o = d.plus_objects.get(r.flags & 0xFF)
    if o and o["kind"] == "region":
        shapes, exact = plus.region_shapes(o["nodes"], d.plus_matrix)
        _plus_clip(d, shapes, r.flags)
        d.exact = d.exact and exact


@on_plus(0x4035)
def plus_offset_clip(d: Replay, c: Cursor, r) -> None:
    dx, dy = c.take("ff")
    m = d.plus_matrix
    d.clip = clip.translate(d.clip, m[0] * dx + m[2] * dy, m[1] * dx + m[3] * dy)


def replay(content: bytes, kind: str, bounds, canvas, header_size: int = 0, dpi: float = 1.0, most: int | None = None, fonts=None) -> list[dict]:
    """Display list in painting order: images of EMF+ come after all else. ``most`` records of each stream, if given."""
    d = Replay(bounds, canvas, dpi, fonts, most or K.MAX_PLUS_RECORDS)
    most = most or K.MAX_RECORDS
    d.run_wmf(content, header_size, most) if kind == "wmf" else d.run_emf(content, most)
    return [*({"phase": 0} | o for o in d.ops), *({"phase": 1} | o for o in d.late)]


SCHEMA = (
    "path string, phase int, ord int, seq int, op string, geom array<struct<cmd:string,p:array<double>>>, fill string, gradient string, fill_rule string,"
    " stroke string, line_width double, dash array<double>, gco string, transform array<double>, clip array<struct<rule:string,cmds:array<struct<cmd:string,p:array<double>>>>>,"
    " clip_exact boolean, text string, font string, align string, baseline string, image binary, is_metafile boolean, image_w int, image_h int"
)


def _cmds(cmds) -> list[dict]:
    return [{"cmd": c, "p": [float(v) for v in p]} for c, p in cmds]


def row(path: str, i: int, o: dict) -> tuple:
    px = o.get("pixels")
    return (
        path, o["phase"], i, o["seq"], o["op"], _cmds(o["geom"]), o.get("fill"), o.get("gradient"), o.get("fill_rule"), o.get("stroke"), o.get("line_width"), o.get("dash"),
        o["gco"], o.get("transform"), None if o["clip"] is None else [{"rule": s.rule, "cmds": _cmds(s.cmds)} for s in o["clip"]], o["exact"], o.get("text"), o.get("font"),
        o.get("align"), o.get("baseline"), px.tobytes() if px is not None else o.get("data"), o.get("metafile"), None if px is None else px.shape[1], None if px is None else px.shape[0],
    )


def display_list(files: DataFrame, dpi: float = 1.0, max_records: int | None = None, fonts: dict[str, str] | None = None) -> DataFrame:
    """Files with headers to display list rows; files that can't be rendered have none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow_schema()
        image = schema.get_field_index("image")
        rows: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for path, content, kind, b, head, w, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if content is None or b is None:
                    continue
                ops = replay(content, kind, (b["left"], b["top"], b["right"], b["bottom"]), (w, h), head, dpi, max_records, fonts)
                for i, o in enumerate(ops):
                    rows.append(row(path, i, o))
                    held += len(rows[-1][image] or b"")
                    if len(rows) >= 5000 or held > 16 << 20:
                        yield out()
                        rows, held = [], 0
        if rows:
            yield out()

    return files.select("path", "content", "kind", "bounds", "header_size", "canvas_w", "canvas_h").mapInArrow(run, SCHEMA)


def _arrow_schema() -> pa.Schema:
    num, txt = pa.float64(), pa.string()
    cmds = pa.list_(pa.struct([("cmd", txt), ("p", pa.list_(num))]))
    kinds = {
        "path": txt, "phase": pa.int32(), "ord": pa.int32(), "seq": pa.int32(), "op": txt, "geom": cmds, "fill": txt, "gradient": txt, "fill_rule": txt, "stroke": txt,
        "line_width": num, "dash": pa.list_(num), "gco": txt, "transform": pa.list_(num), "clip": pa.list_(pa.struct([("rule", txt), ("cmds", cmds)])), "clip_exact": pa.bool_(),
        "text": txt, "font": txt, "align": txt, "baseline": txt, "image": pa.binary(), "is_metafile": pa.bool_(), "image_w": pa.int32(), "image_h": pa.int32(),
    }
    return pa.schema(list(kinds.items()))
