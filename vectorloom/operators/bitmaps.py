"""Bitmap decoders to RGBA arrays; None where a bitmap can't be decoded."""

from __future__ import annotations

import struct

import numpy as np

from ..constants import MAX_SIDE

RGB24, RGB32, ARGB32, PARGB32 = 0x21808, 0x22009, 0x26200A, 0xE200B


def dib(b: bytes, header: int = 0, bits: int | None = None, bits_size: int | None = None) -> np.ndarray | None:
    """A device-independent bitmap: header, masks and palette at ``header``, ``bits_size`` bytes of pixels at ``bits``."""
    if len(b) < header + 40 or bits is not None and len(b) < bits + (bits_size or 0):
        return None
    size, w, h, planes, bpp, comp = struct.unpack_from("<IiiHHI", b, header)
    used = struct.unpack_from("<I", b, header + 32)[0]
    down, h = h < 0, abs(h)
    if size < 40 or planes != 1 or not 0 < w <= MAX_SIDE or not 0 < h <= MAX_SIDE or bpp not in (1, 4, 8, 16, 24, 32):
        return None
    if comp not in (0, 1, 2, 3) or comp == 1 and bpp != 8 or comp == 2 and bpp != 4 or comp == 3 and bpp not in (16, 32):
        return None
    at = header + size
    if len(b) < at:
        return None
    masks = (0x7C00, 0x3E0, 0x1F)
    if comp == 3:
        if len(b) < at + 12:  # also behind a header that has masks of its own
            return None
        masks = struct.unpack_from("<3I", b, at)
        at += 12
    palette = np.zeros((0, 4), np.uint8)
    if bpp <= 8:
        n = min(used or 1 << bpp, 1 << bpp)
        if len(b) < at + 4 * n:
            return None
        palette = np.frombuffer(b, np.uint8, 4 * n, at).reshape(n, 4)[:, [2, 1, 0, 3]].copy()
        palette[:, 3] = 255
        at += 4 * n
    first = at if bits is None else bits
    pixels = b[first : None if bits_size is None else first + bits_size]
    if comp in (1, 2):
        return _rle(pixels, w, h, palette, comp == 2)
    return _rows(pixels, w, h, bpp, masks, palette, down)


def _lookup(index: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """Indexes past the palette are opaque black."""
    full = np.zeros((256, 4), np.uint8)
    full[:, 3] = 255
    full[: len(palette)] = palette
    return full[index]


def _rows(pixels: bytes, w: int, h: int, bpp: int, masks, palette: np.ndarray, down: bool) -> np.ndarray:
    stride = (w * bpp + 31) // 32 * 4
    need = (w * bpp + 7) // 8
    out = np.zeros((h, w, 4), np.uint8)
    for k in range(h):
        row = np.frombuffer(pixels[k * stride : k * stride + need], np.uint8)
        if len(row) < need:  # rows past the end stay transparent
            break
        y = k if down else h - 1 - k
        if bpp <= 8:
            index = row if bpp == 8 else (np.unpackbits(row).reshape(-1, bpp) @ (1 << np.arange(bpp)[::-1])).astype(np.uint8)
            out[y] = _lookup(index[:w], palette)
        elif bpp == 16:
            v = row.view("<u2").astype(np.int64)
            for c, m in enumerate(masks):
                shift = (m & -m).bit_length() - 1 if m else 0
                top = m >> shift
                out[y, :, c] = np.floor(((v & m) >> shift) * 255 / top + 0.5) if top else 0
            out[y, :, 3] = 255
        else:
            px = row.reshape(w, bpp // 8)
            out[y, :, :3] = px[:, 2::-1]
            out[y, :, 3] = 255 if bpp == 24 else np.where(px[:, 3] == 0, 255, px[:, 3])
    return out


def _rle(b: bytes, w: int, h: int, palette: np.ndarray, four: bool) -> np.ndarray:
    """Run lengths; the first encoded line is the top row, as in the files' readers that this matches.

    A run ends at the right edge. What is left of an absolute run of bytes there is read as codes.
    """
    out = np.zeros((h, w, 4), np.uint8)
    x = line = i = 0

    def put(index: np.ndarray, known_only: bool) -> None:
        at = x + np.arange(len(index))
        ok = at < w
        if known_only:
            ok &= index < len(palette)
        if line < h:
            out[line, at[ok]] = _lookup(index[ok], palette)

    while i + 1 < len(b) and line < h:
        n, v = b[i], b[i + 1]
        i += 2
        if n:
            n = min(n, max(0, w - x))
            put(np.resize(np.array([v >> 4, v & 15] if four else [v], np.uint8), n), four)
            x += n
        elif v == 0:
            x, line = 0, line + 1
        elif v == 1:
            break
        elif v == 2:
            if i + 1 >= len(b):
                break
            x, line, i = x + b[i], line + b[i + 1], i + 2
        elif four:
            size = (v + 1) // 2
            data = np.frombuffer(b[i : i + size], np.uint8)
            index = np.stack([data >> 4, data & 15], 1).reshape(-1)[:v]
            put(index, True)
            x, i = x + len(index), i + size + size % 2
        else:
            data = np.frombuffer(b[i : i + min(v, max(0, w - x))], np.uint8)
            put(data, True)
            x, i = x + len(data), i + len(data) + v % 2
    return out


def plus_pixels(b: bytes, w: int, h: int, stride: int, fmt: int) -> np.ndarray | None:
    """Raw EMF+ pixels; a negative stride means bottom-up."""
    size = 3 if fmt == RGB24 else 4
    step = abs(stride) or w * size
    if fmt not in (RGB24, RGB32, ARGB32, PARGB32) or not 0 < w <= MAX_SIDE or not 0 < h <= MAX_SIDE or step < w * size or len(b) < step * (h - 1) + w * size:
        return None
    raw = np.frombuffer(b + bytes(step), np.uint8)[: step * h].reshape(h, step)[:, : w * size].reshape(h, w, size)
    out = np.full((h, w, 4), 255, np.uint8)
    out[..., :3] = raw[..., 2::-1]
    if fmt in (ARGB32, PARGB32):
        out[..., 3] = raw[..., 3]
    if fmt == PARGB32:
        a = raw[..., 3:].astype(float)
        out[..., :3] = np.where(a > 0, np.minimum(255, np.floor(out[..., :3].astype(float) * 255 / np.maximum(a, 1) + 0.5)), 0)
    return out[::-1].copy() if stride < 0 else out
