"""Scalar operators of the metafile model as Catalyst expressions; none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(x: Column) -> Column:
    """Halves go up, as JavaScript rounds."""
    return F.floor(x + 0.5)


def canvas_size(w: Column, h: Column, max_w: Column, max_h: Column, dpi: Column, cap: int = 8192) -> tuple[Column, Column]:
    """Scale by dpi in 1..4, fit to the maxima keeping the aspect, clamp each side."""
    s = F.greatest(F.lit(1.0), F.least(F.lit(4.0), dpi))
    cw, ch = js_round(w * s), js_round(h * s)
    f1 = F.when(max_w.isNotNull() & (cw > max_w), max_w / cw).otherwise(1.0)
    w1, h1 = js_round(cw * f1), js_round(ch * f1)
    f2 = F.when(max_h.isNotNull() & (h1 > max_h), max_h / h1).otherwise(1.0)
    clamp = lambda x: F.greatest(F.lit(1), F.least(F.lit(cap), x)).cast("long")
    return clamp(js_round(w1 * f2)), clamp(js_round(h1 * f2))


def finite_matrix(m: Column) -> Column:
    """Six numbers of a transform; what isn't finite becomes the identity's."""
    same = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)])
    return F.transform(m, lambda v, i: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.get(same, i)).otherwise(v))


def u_le(content: Column, offset: int, size: int) -> Column:
    """Unsigned little-endian integer at a byte offset, as long; null past the end."""
    h = [F.hex(F.substring(content, offset + i + 1, 1)) for i in reversed(range(size))]
    return F.when(F.length(content) >= offset + size, F.conv(F.concat(*h), 16, 10).cast("long"))


def i_le(content: Column, offset: int, size: int) -> Column:
    u = u_le(content, offset, size)
    return F.when(u >= 1 << (8 * size - 1), u - (1 << 8 * size)).otherwise(u)


def data_url(png: Column) -> Column:
    return F.concat(F.lit("data:image/png;base64,"), F.translate(F.base64(png), "\r\n", ""))  # Spark breaks lines
