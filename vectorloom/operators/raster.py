"""Display lists to RGBA arrays and PNG.

A canvas has four bytes a pixel. Each operation touches the box it covers, in strips of bounded
size, so work follows the painted area and memory the canvas.
"""

from __future__ import annotations

import json
import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np

from . import glyphs
from .clip import flatten

#: Pixels that are blended at once.
STRIP = 1 << 20

BLEND = {
    "difference": lambda s, d: np.abs(d - s),
    "darken": np.minimum,
    "lighten": np.maximum,
}


def png(rgba: np.ndarray) -> bytes:
    h, w, _ = rgba.shape
    pack, parts = zlib.compressobj(6), []
    for y in range(0, h, max(1, STRIP // w)):
        part = rgba[y : y + max(1, STRIP // w)]
        raw = np.zeros((len(part), 1 + 4 * w), np.uint8)
        raw[:, 1:] = part.reshape(len(part), 4 * w)
        parts.append(pack.compress(raw))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", b"".join([*parts, pack.flush()])) + chunk(b"IEND", b"")


def css(color: str | None) -> tuple[float, float, float, float] | None:
    if not color or color == "transparent":
        return None
    if color[0] == "#" and len(color) == 7:
        return (*bytes.fromhex(color[1:]), 1.0)
    if m := re.fullmatch(r"rgba?\(([\d.]+),([\d.]+),([\d.]+)(?:,([\d.]+))?\)", color.replace(" ", "")):
        return (*[float(x) for x in m.groups()[:3]], float(m[4] or 1))
    return None


def strips(polys, rule: str, w: int, h: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, first column, mask) of the pixels whose centre is inside, over the box that the polygons cover."""
    polys = [p for p in polys if all(math.isfinite(v) for q in p for v in q)]
    if not polys:
        return
    side = lambda v, most: min(max(math.ceil(v - 0.5), 0), most)
    xs, ys = [q[0] for p in polys for q in p], [q[1] for p in polys for q in p]
    left, right, top, bottom = side(min(xs), w), side(max(xs), w), side(min(ys), h), side(max(ys), h)
    if left >= right or top >= bottom:
        return
    # A single upright rectangle is its box.
    if len(polys) == 1 and len(xs) in (4, 5) and len(set(zip(xs, ys, strict=True))) == 4 and len(set(xs)) == len(set(ys)) == 2 and xs[0] != xs[2] and ys[0] != ys[2]:
        for y in range(top, bottom, rows := max(1, STRIP // (right - left))):
            yield y, left, np.ones((min(rows, bottom - y), right - left), bool)
        return
    edges = [(*a, *b) for p in polys for a, b in zip(p, [*p[1:], p[0]], strict=True) if a[1] != b[1]]
    for y in range(top, bottom, rows := max(1, STRIP // (right - left))):
        stop = min(y + rows, bottom)
        delta = np.zeros((stop - y, right - left + 1), np.int32)
        for x0, y0, x1, y1 in edges:
            lo, hi, sign = (y0, y1, 1) if y0 < y1 else (y1, y0, -1)
            a, b = max(y, math.ceil(lo - 0.5)), min(stop, math.ceil(hi - 0.5))
            if a < b:
                line = np.arange(a, b)
                x = x0 + (line + 0.5 - y0) * (x1 - x0) / (y1 - y0)
                np.add.at(delta, (line - y, np.clip(np.ceil(x - 0.5), left, right).astype(int) - left), sign)
        n = np.cumsum(delta, 1, out=delta)[:, :-1]
        yield y, left, n % 2 != 0 if rule == "evenodd" else n != 0


def outline(polys, width: float, dash: list[float]) -> list:
    """Strokes as one quadrilateral per segment, cut by the dash."""
    out = []
    for poly in polys:
        at, on, left = 0, True, dash[0] if dash else float("inf")
        for (x0, y0), (x1, y1) in zip(poly[:-1], poly[1:], strict=True):
            n = math.hypot(x1 - x0, y1 - y0)
            if n == 0:
                continue
            ux, uy, done = (x1 - x0) / n, (y1 - y0) / n, 0.0
            px, py = -uy * width / 2, ux * width / 2
            while done < n:
                step = min(left, n - done)
                if on:
                    a, b = (x0 + ux * done, y0 + uy * done), (x0 + ux * (done + step), y0 + uy * (done + step))
                    out.append([(a[0] + px, a[1] + py), (b[0] + px, b[1] + py), (b[0] - px, b[1] - py), (a[0] - px, a[1] - py)])
                done, left = done + step, left - step
                if left <= 1e-9 and dash:
                    at = (at + 1) % len(dash)
                    on, left = not on, max(dash[at], 1e-6)
    return [q if _turn(q) > 0 else q[::-1] for q in out]


def _turn(q) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(q, [*q[1:], q[0]], strict=True))


def gradient_colors(g: dict, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    if g["type"] == "linear":
        dx, dy = g["x1"] - g["x0"], g["y1"] - g["y0"]
        t = ((x - g["x0"]) * dx + (y - g["y0"]) * dy) / ((dx * dx + dy * dy) or 1)
    else:
        t = np.hypot(x - g["cx"], y - g["cy"]) / (g["r"] or 1)
    stops = [(s["offset"], css(s["color"]) or (0, 0, 0, 0)) for s in g["stops"]]
    return np.stack([np.interp(t, [o for o, _ in stops], [c[i] for _, c in stops]) for i in range(4)], -1)


def apply(m, x, y):
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def paint(box: np.ndarray, mask: np.ndarray, color, gco: str) -> None:
    """color: (r, g, b, a) or an array of them over the mask's pixels."""
    if gco == "source-over" and isinstance(color, tuple) and color[3] == 1:
        box[mask] = [math.floor(v + 0.5) for v in (*color[:3], 255)]
        return
    dst = box[mask].astype(np.float32)
    src = np.broadcast_to(np.asarray(color, np.float32), dst.shape)
    a, da = src[:, 3:], dst[:, 3:] / 255
    rgb = src[:, :3]
    if gco in BLEND:
        rgb = (1 - da) * rgb + da * BLEND[gco](rgb, dst[:, :3])
    oa = a + da * (1 - a)
    with np.errstate(invalid="ignore", divide="ignore"):
        out = np.where(oa > 0, (rgb * a + dst[:, :3] * da * (1 - a)) / oa, 0)
    box[mask] = np.clip(np.floor(np.concatenate([out, oa * 255], 1) + 0.5), 0, 255).astype(np.uint8)


def render(ops: list[dict], w: int, h: int) -> np.ndarray:
    """A replay's operations, in painting order."""
    canvas = np.zeros((h, w, 4), np.uint8)
    region, clipped = None, None

    def over(polys, rule: str, gco: str, color) -> None:
        """color: a tuple, or a function of the pixels' columns and rows."""
        for y, x, mask in strips(polys, rule, w, h):
            box = canvas[y : y + mask.shape[0], x : x + mask.shape[1]]
            if clipped is not None:
                mask = mask & clipped[y : y + mask.shape[0], x : x + mask.shape[1]]
            if callable(color):
                yy, xx = np.nonzero(mask)
                paint(box, mask, color(xx + x, yy + y), gco)
            else:
                paint(box, mask, color, gco)

    for op in ops:
        if op["clip"] is not region:
            region, clipped = op["clip"], None
            for s in region or ():
                own = np.zeros((h, w), bool)
                for y, x, mask in strips(flatten(s.cmds), s.rule, w, h):
                    own[y : y + mask.shape[0], x : x + mask.shape[1]] = mask
                clipped = own if clipped is None else clipped & own
        gco, t = op["gco"] or "source-over", op.get("transform")
        moved = lambda polys, t=t: [[apply(t, *q) for q in p] for p in polys] if t else polys
        t = t or (1, 0, 0, 1, 0, 0)
        det = t[0] * t[3] - t[1] * t[2]

        def back(x, y, t=t, det=det):
            """Pixel centres before the transform."""
            px, py = x + 0.5 - t[4], y + 0.5 - t[5]
            return (t[3] * px - t[2] * py) / (det or 1), (t[0] * py - t[1] * px) / (det or 1)

        if op["op"] == "image":
            img, (x, y, iw, ih) = op.get("pixels"), op["geom"][0][1]
            if img is None or not det or not iw or not ih:
                continue

            def sample(xx, yy, img=img, x=x, y=y, iw=iw, ih=ih, back=back):
                u, v = back(xx, yy)
                cols = np.clip(((u - x) / iw * img.shape[1]).astype(int), 0, img.shape[1] - 1)
                rows = np.clip(((v - y) / ih * img.shape[0]).astype(int), 0, img.shape[0] - 1)
                c = img[rows, cols].astype(np.float32)
                c[:, 3] /= 255
                return c

            over(moved([[(x, y), (x + iw, y), (x + iw, y + ih), (x, y + ih)]]), "nonzero", gco, sample)
            continue
        scale = math.sqrt(abs(det)) or 1.0
        if op["op"] == "text":
            if (c := css(op.get("fill"))) is not None:
                x, y = op["geom"][0][1]
                lines = flatten(glyphs.strokes(op["text"], x, y, op["size"], op["align"], op["baseline"]))
                over(outline(moved(lines), max(op["size"] * (0.14 if op.get("bold") else 0.09) * scale, 1.0), []), "nonzero", gco, c)
            continue
        polys = moved(flatten(op["geom"]))
        rule = op.get("fill_rule") or "nonzero"
        if op.get("gradient"):
            g = json.loads(op["gradient"])
            over(polys, rule, gco, lambda xx, yy, g=g, back=back: gradient_colors(g, *back(xx, yy)))
        elif (c := css(op.get("fill"))) is not None:
            over(polys, rule, gco, c)
        if (c := css(op.get("stroke"))) is not None:
            over(outline(polys, (op.get("line_width") or 1) * scale, op.get("dash") or []), "nonzero", gco, c)
    return canvas
