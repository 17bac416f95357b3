"""EMF+ objects and records. Objects are dicts with a ``kind``; None where a payload is malformed."""

from __future__ import annotations

import math
import struct
from typing import Any

from .. import constants as K
from . import bitmaps, clip

IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
CLIP_OPS = ("replace", "intersect", "union", "xor", "exclude", "complement")


def rgba(argb: int) -> str:
    return f"rgba({argb >> 16 & 255},{argb >> 8 & 255},{argb & 255},{(argb >> 24 & 255) / 255:.3f})"


def times(a, b):
    """The transform that applies b, then a."""
    return (
        a[0] * b[0] + a[2] * b[1], a[1] * b[0] + a[3] * b[1], a[0] * b[2] + a[2] * b[3], a[1] * b[2] + a[3] * b[3],
        a[0] * b[4] + a[2] * b[5] + a[4], a[1] * b[4] + a[3] * b[5] + a[5],
    )


def at(m, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


class Cursor:
    """Checked little-endian reads up to ``end``; struct.error past it."""

    def __init__(self, b: bytes, pos: int = 0, end: int | None = None):
        self.b, self.pos = memoryview(b)[:end], pos

    def raw(self, a: int, b: int | None = None) -> bytes:
        return bytes(self.b[a:b])

    def take(self, fmt: str) -> Any:
        v = struct.unpack_from("<" + fmt, self.b, self.pos)
        self.pos += struct.calcsize("<" + fmt)
        return v[0] if len(v) == 1 else v

    def points(self, n: int, short: bool) -> list[tuple[float, float]]:
        v = self.take(f"{2 * n}{'h' if short else 'f'}") if n else ()
        return [(float(v[i]), float(v[i + 1])) for i in range(0, 2 * n, 2)]

    def rect(self, short: bool) -> tuple[float, ...]:
        return tuple(float(v) for v in self.take("4h" if short else "4f"))


def versioned(v: int) -> bool:
    return v >> 12 == 0xDBC01


def lerp(a: int, b: int, t: float) -> str:
    t = max(0.0, min(1.0, t))
    mixed = [math.floor((a >> s & 255) + ((b >> s & 255) - (a >> s & 255)) * t + 0.5) for s in (24, 16, 8, 0)]
    return rgba(mixed[0] << 24 | mixed[1] << 16 | mixed[2] << 8 | mixed[3])


def _stops(c: Cursor, flags: int, start: int, end: int) -> list[dict]:
    """Preset colours (flag 4), blend factors (flag 8), or the two ends."""
    if flags & 12:
        n = c.take("I")
        if not 1 <= n <= K.MAX_STOPS:
            raise ValueError(n)
        offs = [c.take("f") for _ in range(n)]
        if flags & 4:
            colors = [rgba(c.take("I")) for _ in range(n)]
        else:
            colors = [lerp(start, end, c.take("f")) for _ in range(n)]
        return sorted(({"offset": max(0.0, min(1.0, o)), "color": x} for o, x in zip(offs, colors, strict=True)), key=lambda s: s["offset"])
    return [{"offset": 0.0, "color": rgba(start)}, {"offset": 1.0, "color": rgba(end)}]


def brush(b: bytes) -> dict | None:
    try:
        c = Cursor(b)
        kind = c.take("I")
        if versioned(kind):
            kind = c.take("I")
        solid = lambda x: {"kind": "brush", "color": x, "gradient": None}
        if kind == 0:
            return solid(rgba(c.take("I")))
        if kind == 1:
            _, fore = c.take("II")
            return solid(rgba(fore))
        if kind == 4:
            flags, _, x, y, w, h, start, end = c.take("IIffffII")
            c.take("II")
            m = c.take("6f") if flags & 2 else IDENTITY
            (x0, y0), (x1, y1) = at(m, x, y + h / 2), at(m, x + w, y + h / 2)
            try:
                stops = _stops(c, flags, start, end)
            except (struct.error, ValueError):
                stops = _stops(c, 0, start, end)
            return {"kind": "brush", "color": rgba(start), "gradient": {"type": "linear", "x0": x0, "y0": y0, "x1": x1, "y1": y1, "stops": stops}}
        if kind == 3:
            flags, _, centre, cx, cy, n = c.take("IIIffI")
            ring = [c.take("I") for _ in range(n)] or [centre]
            if flags & 1:
                size = c.take("I")
                shape = path(b[c.pos : c.pos + size])
                c.pos += size
                edge = shape["points"] if shape else []
            else:
                edge = c.points(min(c.take("I"), K.MAX_POINTS), False)
            m = c.take("6f") if flags & 2 else IDENTITY
            (px, py), edge = at(m, cx, cy), [at(m, *p) for p in edge]
            r = max((math.hypot(x - px, y - py) for x, y in edge), default=0.0)
            if not r:
                return solid(rgba(centre))
            try:  # positions run from the boundary inwards
                stops = _stops(c, flags, ring[0], centre)
            except (struct.error, ValueError):
                stops = _stops(c, 0, ring[0], centre)
            stops = sorted(({"offset": 1 - s["offset"], "color": s["color"]} for s in stops), key=lambda s: s["offset"])
            return {"kind": "brush", "color": rgba(centre), "gradient": {"type": "radial", "cx": px, "cy": py, "r": r, "stops": stops}}
        return solid("rgba(0,0,0,1.000)")
    except struct.error:
        return None


#: Optional pen fields by flag, in order: format of each; dashes, compounds and caps have lengths of their own.
PEN_FIELDS = ((1, "6f"), (2, "I"), (4, "I"), (8, "I"), (16, "f"), (32, "I"), (64, "I"), (128, "f"), (256, "dashes"), (512, "I"), (1024, "floats"), (2048, "blob"), (4096, "blob"))


def pen(b: bytes) -> dict | None:
    if len(b) < 20:
        return None
    try:
        # Without a version word the flags come first; the width keeps its place.
        flags, c = struct.unpack_from("<I", b, 8 if versioned(struct.unpack_from("<I", b)[0]) else 4)[0], Cursor(b, 16)
        width = c.take("f")
        style = 0
        for bit, fmt in PEN_FIELDS:
            if not flags & bit:
                continue
            if fmt in ("dashes", "floats"):
                c.pos += 4 * c.take("I")
            elif fmt == "blob":
                c.pos += c.take("I")
            else:
                v = c.take(fmt)
                style = v if bit == 32 else style
        own = brush(b[c.pos :])
        return {"kind": "pen", "width": width or 1.0, "color": own["color"] if own else "rgba(0,0,0,1.000)", "style": style}
    except struct.error:
        return None


def path(b: bytes) -> dict | None:
    try:
        c = Cursor(b, 4)
        n, flags = c.take("II")
        if not 0 < n <= K.MAX_POINTS:
            return None
        pts = c.points(n, bool(flags & 0x4000))
        c.pos = (c.pos + 3) & ~3
        return {"kind": "path", "points": pts, "types": list(c.take(f"{n}s"))}
    except struct.error:
        return None


def path_commands(p: dict, m=IDENTITY) -> list[clip.Command]:
    """Point types: 0 starts a figure, 1 is a line, 3 a third of a curve; bit 7 closes."""
    out: list[clip.Command] = []
    pts, types, i = [at(m, *q) for q in p["points"]], p["types"], 0
    while i < len(pts):
        kind, last = types[i] & 7, i
        if kind == 3 and i + 2 < len(pts):
            last = i + 2
            out.append(("C", [v for q in pts[i : i + 3] for v in q]))
        elif kind != 3:
            out.append(("M" if kind == 0 else "L", list(pts[i])))
        if types[last] & 0x80:
            out.append(("Z", []))
        i = last + 1
    return out


def image(b: bytes) -> dict | None:
    try:
        c = Cursor(b, 4)
        kind = c.take("I")
        if kind == 1:
            w, h, stride, fmt, coded = c.take("iiiII")
            return {"kind": "image", "metafile": False, "data": b[c.pos :], "pixels": bitmaps.plus_pixels(b[c.pos :], w, h, stride, fmt) if not coded or coded == 1 and fmt in (bitmaps.RGB24, bitmaps.RGB32, bitmaps.ARGB32, bitmaps.PARGB32) and w > 0 else None}
        if kind == 2:
            _, size = c.take("II")
            return {"kind": "image", "metafile": True, "data": b[c.pos : c.pos + size], "pixels": None}
        return None
    except struct.error:
        return None


def font(b: bytes) -> dict | None:
    if len(b) < 28:
        return None
    size, _, style, _, n = struct.unpack_from("<fIiII", b, 4)
    name = b[24 : 24 + 2 * n].decode("utf-16-le", "replace").split("\0")[0]
    return {"kind": "font", "size": size or 12.0, "bold": bool(style & 1), "italic": bool(style & 2), "underline": bool(style & 4), "strike": bool(style & 8), "family": name or "sans-serif"}


def string_format(b: bytes) -> dict | None:
    if len(b) < 16:
        return None
    return {"kind": "format", "flags": struct.unpack_from("<I", b, 4)[0], "align": struct.unpack_from("<I", b, 12)[0]}


def region(b: bytes) -> dict | None:
    """Nodes in postfix order: ('rect', l, t, r, b), ('path', commands), ('empty',), ('infinite',) or an operation."""
    c, nodes = Cursor(b, 8), []

    def node(depth: int) -> None:
        if depth > K.MAX_REGION_DEPTH:
            raise ValueError(depth)
        kind = c.take("I")
        if kind <= 5:
            node(depth + 1)
            node(depth + 1)
            nodes.append((CLIP_OPS[kind],))
        elif kind == 0x10000000:
            x, y, w, h = c.take("4f")
            nodes.append(("rect", x, y, x + w, y + h))
        elif kind == 0x10000001:
            size = c.take("I")
            p = path(b[c.pos : c.pos + size])
            c.pos += size
            nodes.append(("path", path_commands(p) if p else []))
        elif kind in (0x10000002, 0x10000003):
            nodes.append(("empty",) if kind == 0x10000002 else ("infinite",))
        else:
            raise ValueError(kind)

    try:
        node(0)
        return {"kind": "region", "nodes": nodes}
    except (struct.error, ValueError):
        return None


PARSERS = {1: brush, 2: pen, 3: path, 4: lambda b: {"kind": "attributes"}, 5: image, 6: font, 7: string_format, 8: region}


def region_shapes(nodes: list[tuple], m) -> tuple[clip.Region, bool]:
    """Device-space region of postfix nodes, and whether it is exact."""
    move = lambda cmds: [(k, [v for i in range(0, len(p), 2) for v in at(m, p[i], p[i + 1])]) for k, p in cmds]
    stack: list[clip.Region] = []
    exact = True
    for kind, *v in nodes:
        if kind == "rect":
            stack.append([clip.Shape(move(clip.rect(*v).cmds))])
        elif kind == "path":
            stack.append([clip.Shape(move(v[0]), simple=False)])
        elif kind == "empty":
            stack.append([clip.empty()])
        elif kind == "infinite":
            stack.append(None)
        else:
            b, a = stack.pop(), stack.pop()
            r, ok = clip.combine_regions(a, b, kind)
            exact &= ok
            stack.append(r)
    return stack[-1], exact
