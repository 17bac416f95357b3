"""Images inside a file: bitmap files, PNG, and metafiles up to a depth.

JPEG, GIF and TIFF have no decoder here; ``diagnostics`` has a row for each image that isn't drawn.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .. import constants as K
from . import bitmaps, raster
from .replay import replay

#: First bytes of image files.
MAGIC = {b"\x89PNG\r\n\x1a\n": "png", b"\xff\xd8\xff": "jpeg", b"GIF8": "gif", b"BM": "bmp", b"II*\0": "tiff", b"MM\0*": "tiff"}
#: Samples of a pixel by colour type; first column and row, and steps, of the seven passes.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def image_kind(b: bytes | None) -> str:
    return next((name for magic, name in MAGIC.items() if b and b.startswith(magic)), "metafile" if header(b or b"") else "unknown")


def _unfiltered(raw: bytes, at: int, rows: int, line: int, step: int) -> tuple[np.ndarray, int]:
    """Rows of ``line`` bytes; ``step`` is the distance to the same sample of the pixel before."""
    out = np.zeros((rows + 1, line), np.uint8)
    for y in range(1, rows + 1):
        kind, row, up = raw[at], np.frombuffer(raw, np.uint8, line, at + 1), out[y - 1]
        at += 1 + line
        if kind == 0:
            out[y] = row
        elif kind == 2:
            out[y] = row + up
        elif kind == 1:
            for k in range(step):
                out[y, k::step] = np.cumsum(row[k::step], dtype=np.uint8)
        elif kind in (3, 4):
            now, above, got = row.tolist(), up.tolist(), [0] * line
            for i, v in enumerate(now):
                a, b = (got[i - step] if i >= step else 0), above[i]
                if kind == 3:
                    got[i] = v + (a + b) // 2 & 255
                else:
                    c = above[i - step] if i >= step else 0
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    got[i] = v + (a if pa <= pb and pa <= pc else b if pb <= pc else c) & 255
            out[y] = got
        else:
            raise ValueError(kind)
    return out[1:], at


def png_pixels(b: bytes) -> np.ndarray | None:
    """Any PNG to RGBA; None where it is damaged or larger than the limits."""
    try:
        at, data, palette, clear = 8, [], None, None
        w, h, depth, kind, _, _, laced = struct.unpack_from(">IIBBBBB", b, 16)
        while at + 8 <= len(b):
            size, name = struct.unpack_from(">I4s", b, at)
            body = b[at + 8 : at + 8 + size]
            at += 12 + size
            if name == b"IDAT":
                data.append(body)
            elif name == b"PLTE":
                palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
            elif name == b"tRNS":
                clear = body
            elif name == b"IEND":
                break
        n = SAMPLES[kind]
        if not 0 < w <= K.MAX_SIDE or not 0 < h <= K.MAX_SIDE or depth not in (1, 2, 4, 8, 16) or kind == 3 and palette is None:
            return None
        raw, pos = zlib.decompress(b"".join(data)), 0
        values = np.zeros((h, w, n), np.uint16)
        for x0, y0, dx, dy in PASSES if laced else ((0, 0, 1, 1),):
            pw, ph = -(-(w - x0) // dx), -(-(h - y0) // dy)
            if pw <= 0 or ph <= 0:
                continue
            rows, pos = _unfiltered(raw, pos, ph, (pw * n * depth + 7) // 8, max(1, n * depth // 8))
            if depth == 16:
                px = rows.view(">u2")
            elif depth == 8:
                px = rows
            else:
                px = np.unpackbits(rows, axis=1).reshape(ph, -1, depth) @ (1 << np.arange(depth)[::-1])
            values[y0::dy, x0::dx] = px[:, : pw * n].reshape(ph, pw, n)
        out = np.full((h, w, 4), 255, np.uint8)
        if kind == 3:
            alpha = np.full(len(palette), 255, np.uint8)
            alpha[: len(clear or b"")] = np.frombuffer((clear or b"")[: len(palette)], np.uint8)
            index = np.minimum(values[..., 0], len(palette) - 1)
            out[..., :3], out[..., 3] = palette[index], alpha[index]
            return out
        top = (1 << depth) - 1
        level = (values * np.uint32(255) // top).astype(np.uint8) if depth != 16 else (values >> 8).astype(np.uint8)
        out[..., :3] = level[..., :3] if n >= 3 else level[..., :1]
        if n in (2, 4):
            out[..., 3] = level[..., -1]
        elif clear:
            out[..., 3] = np.where((values == np.array(struct.unpack(f">{n}H", clear[: 2 * n]), np.uint16)).all(-1), 0, 255)
        return out
    except (struct.error, ValueError, IndexError, KeyError, zlib.error):
        return None


def header(b: bytes) -> tuple[str, tuple, int] | None:
    """Kind, bounds and size of the header of a metafile given as bytes: EMF first, then placeable or plain WMF."""
    if len(b) >= 88 and struct.unpack_from("<I", b)[0] == 1:
        bounds, frame = struct.unpack_from("<4i", b, 8), struct.unpack_from("<4i", b, 24)
        if bounds[2] <= bounds[0] or bounds[3] <= bounds[1]:
            bounds = (0, 0, frame[2] - frame[0], frame[3] - frame[1])
        if bounds[2] > bounds[0] and bounds[3] > bounds[1]:
            return "emf", bounds, 0
    off = 22 if len(b) >= 22 and struct.unpack_from("<I", b)[0] == K.PLACEABLE else 0
    if len(b) < 22 or len(b) < off + 4:
        return None
    kind, words = struct.unpack_from("<HH", b, off)
    bounds = struct.unpack_from("<4h", b, 6) if off else (0, 0, 800, 600)
    return ("wmf", bounds, off + 2 * words) if kind in (1, 2) and bounds[2] > bounds[0] and bounds[3] > bounds[1] else None


def embedded(data: bytes | None, metafile: bool, depth: int) -> np.ndarray | None:
    """Pixels of an image object that isn't raw: a metafile up to MAX_DEPTH deep, a bitmap file, a PNG, or None."""
    if not data:
        return None
    if metafile:
        return draw_bytes(data, depth + 1)
    kind = image_kind(data)
    if kind == "png":
        return png_pixels(data)
    return bitmaps.dib(data, 14, struct.unpack_from("<I", data, 10)[0]) if kind == "bmp" and len(data) > 54 else None


def lost(data: bytes | None, metafile: bool, depth: int = 0) -> list[str]:
    """The kinds of the images in an image object, itself or nested, that aren't drawn."""
    if not metafile or not data:
        return [] if embedded(data, False, depth) is not None else [image_kind(data)]
    found = header(data) if depth < K.MAX_DEPTH else None
    if found is None:
        return [image_kind(data)]
    kind, bounds, size = found
    ops = replay(data, kind, bounds, (bounds[2] - bounds[0], bounds[3] - bounds[1]), size)
    return [x for o in ops if o["op"] == "image" and o.get("pixels") is None for x in lost(o.get("data"), bool(o.get("metafile")), depth + 1)]


def draw_bytes(b: bytes, depth: int = 0, dpi: float = 1.0) -> np.ndarray | None:
    """A metafile given as bytes at its own size."""
    found = header(b) if depth <= K.MAX_DEPTH else None
    if found is None:
        return None
    kind, bounds, size = found
    w, h = min(bounds[2] - bounds[0], K.MAX_SIDE), min(bounds[3] - bounds[1], K.MAX_SIDE)
    return draw(replay(b, kind, bounds, (w, h), size, dpi), w, h, depth)


def draw(ops: list[dict], w: int, h: int, depth: int = 0) -> np.ndarray:
    """A file's display list as pixels, its images decoded first."""
    for o in ops:
        if o["op"] == "image" and o.get("pixels") is None:
            o["pixels"] = embedded(o.get("data"), bool(o.get("metafile")), depth)
    return raster.render(ops, w, h)
