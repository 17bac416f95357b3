"""New metafiles in a folder, converted as they arrive."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.render import render
from ..sources.metafiles import Options


#: Columns of the binary file source; a stream can't infer them from an empty folder.
FILE = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, options: Options | None = None, glob: str = "*.[ew]mf") -> StreamingQuery:
    """Each file once, into Parquet under ``out``; stops when all present files are done."""
    new = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", glob).load(folder).select("path", "content")
    return render(new, options).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
