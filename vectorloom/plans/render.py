"""From files to PNG data URLs: headers, replay, embedded images, raster, encoding.

One ``mapInArrow`` per file set does replay and raster where the file was read, so rendering
shuffles nothing; the display list is available on its own from ``operators.replay``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import data_url
from ..operators import raster
from ..operators.embedded import draw
from ..operators.replay import replay
from ..sources.metafiles import Options, with_headers


SCHEMA = "path string, width int, height int, painted long, png binary"


def render(files: DataFrame, options: Options | None = None) -> DataFrame:
    """(path, content) to path, width, height, painted pixels and the PNG data URL; null where a file can't be converted."""
    o = options or Options()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "width", "height", "painted", "png"]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                rows = []
                for path, content, kind, b, head, w, h in zip(*(c.to_pylist() for c in batch.slice(lo, 64).columns), strict=True):
                    done = None
                    if content is not None and b is not None:
                        try:
                            done = draw(replay(content, kind, (b["left"], b["top"], b["right"], b["bottom"]), (w, h), head, o.dpi_scale, o.max_records, o.font_family_map), w, h)
                        except (struct.error, ValueError, IndexError, OverflowError):
                            done = None  # a bad file is a null, not a failed job
                    rows.append((path, w, h, None, None) if done is None else (path, w, h, int((done[..., 3] > 0).sum()), raster.png(done)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    f = with_headers(files, o).select("path", "content", "kind", "bounds", "header_size", "canvas_w", "canvas_h")
    return f.mapInArrow(run, SCHEMA).select("path", "width", "height", "painted", F.when(F.col("png").isNotNull(), data_url(F.col("png"))).alias("data_url"))
