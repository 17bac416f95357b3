"""Metafiles as DataFrames: one row per file, with kind, header, bounds and canvas size."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.scalars import canvas_size, i_le, u_le


@dataclass(frozen=True)
class Options:
    """Limits and mappings of a conversion; None leaves a side unlimited, and the records of a stream at the defaults."""

    max_width: int | None = None
    max_height: int | None = None
    dpi_scale: float = K.DEFAULT_DPI_SCALE
    max_canvas_dimension: int = K.MAX_SIDE
    max_records: int | None = None
    font_family_map: dict[str, str] = field(default_factory=dict)


def read(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path and content of binary files; content isn't read where it isn't selected."""
    r = spark.read.format("binaryFile")
    return (r.option("pathGlobFilter", glob) if glob else r).load(path).select("path", "content")


def kind(content: Column, path: Column) -> Column:
    """emf by signature, else wmf by placeable magic or name, else emf."""
    return (
        F.when(u_le(content, 40, 4) == K.EMF_SIGNATURE, "emf").when((u_le(content, 0, 4) == K.PLACEABLE) | F.lower(path).endswith(".wmf"), "wmf").otherwise("emf")
    )


def emf_header(content: Column) -> Column:
    """Bounds and frame; null under 88 bytes or where the first record isn't a header."""
    b, f = [i_le(content, o, 4) for o in (8, 12, 16, 20)], [i_le(content, o, 4) for o in (24, 28, 32, 36)]
    ok = (F.length(content) >= 88) & (u_le(content, 0, 4) == 1)
    names = ("left", "top", "right", "bottom")
    bounds = F.struct(*[c.alias(n) for c, n in zip(b, names, strict=True)])
    return F.when(ok, F.struct(bounds.alias("bounds"), (f[2] - f[0]).alias("frame_w"), (f[3] - f[1]).alias("frame_h")))


def renderable(header: Column) -> Column:
    """The bounds if they have an area, else the frame's size, else null."""
    b = header["bounds"]
    zero = F.lit(0).cast("long")
    frame = F.struct(zero.alias("left"), zero.alias("top"), header["frame_w"].alias("right"), header["frame_h"].alias("bottom"))
    return F.when((b["right"] > b["left"]) & (b["bottom"] > b["top"]), b).when((header["frame_w"] > 0) & (header["frame_h"] > 0), frame)


def wmf_header(content: Column) -> Column:
    """Bounds, units per inch and size of the header in bytes; null where it isn't a WMF header."""
    placeable = u_le(content, 0, 4) == K.PLACEABLE
    pick = lambda o, n: F.when(placeable, u_le(content, o + 22, n)).otherwise(u_le(content, o, n))
    sides = [F.when(placeable, i_le(content, o, 2)).otherwise(F.lit(d)).cast("long") for o, d in ((6, 0), (8, 0), (10, 800), (12, 600))]
    inch = F.when(placeable, F.when(u_le(content, 14, 2) == 0, 96).otherwise(u_le(content, 14, 2))).otherwise(96)
    bounds = F.struct(*[c.alias(n) for c, n in zip(sides, ("left", "top", "right", "bottom"), strict=True)])
    size = pick(2, 2) * 2 + F.when(placeable, 22).otherwise(0)
    return F.when((F.length(content) >= 22) & pick(0, 2).isin(1, 2), F.struct(bounds.alias("bounds"), inch.alias("inch"), size.alias("header_size")))


def with_headers(files: DataFrame, options: Options | None = None) -> DataFrame:
    """Adds kind, bounds, header_size, canvas_w and canvas_h; null bounds where a file can't be rendered."""
    o = options or Options()
    # Generators of one row keep the header's byte reads from being copied into every later expression.
    one = lambda df, *keep, **c: df.select(*keep, F.inline(F.array(F.struct(*[v.alias(k) for k, v in c.items()]))))
    content = F.col("content")
    f = one(files, "path", "content", kind=kind(content, F.col("path")))
    f = one(f, "path", "content", "kind", emf=F.when(F.col("kind") == "emf", emf_header(content)), wmf=F.when(F.col("kind") == "wmf", wmf_header(content)))
    bounds = F.when(F.col("kind") == "emf", renderable(F.col("emf"))).otherwise(F.col("wmf.bounds"))
    f = one(f, "path", "content", "kind", b=bounds, header_size=F.coalesce("wmf.header_size", F.lit(0)))
    w, h = F.col("b.right") - F.col("b.left"), F.col("b.bottom") - F.col("b.top")
    f = one(f, "path", "content", "kind", "header_size", bounds=F.when((w > 0) & (h > 0), F.col("b")), w=w, h=h)
    cw, ch = canvas_size(F.col("w"), F.col("h"), F.lit(o.max_width), F.lit(o.max_height), F.lit(float(o.dpi_scale)), o.max_canvas_dimension)
    return f.select("path", "content", "kind", "bounds", "header_size", cw.alias("canvas_w"), ch.alias("canvas_h"))
