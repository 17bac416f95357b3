"""Tables that cut lineage, in the folder that every executor and the driver share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Bytes of an Arrow batch that a Python function gets.
BATCH = 4 << 20
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, or else given to ``setCheckpointDir``.

    Without either a local master (tests) gets a folder of our own; on a cluster, where executors
    share no local folder, that is an error.
    """
    context = spark.sparkContext
    if conf := context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None):
        return conf.rstrip("/")
    if given := context.getCheckpointDir():
        return given.rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir("/tmp/checkpoints/vectorloom")
    return context.getCheckpointDir()


def map_arrow(df: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` over batches bounded by bytes, so that long texts don't make large ones.

    The bound is a setting of the session; one that differs from Spark's default is left alone.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_KEY).rstrip("b") == str(64 << 20):
        conf.set(BATCH_KEY, str(BATCH))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Freed memory to the system: a worker stays alive after its task, beside an executor that may need it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def quoted(name: str) -> str:
    """A column's name as an expression refers to it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(docs: DataFrame) -> Column:
    """All columns of a row as one struct, so that names of new columns can't clash with them."""
    return F.struct(*[F.col(quoted(c)).alias(c) for c in docs.columns])


def without(docs: DataFrame, gone: DataFrame, **keys: Column) -> DataFrame:
    """The rows of ``docs``, with their own columns, whose ``keys`` are in no row of ``gone``, which has them by the same names."""
    row = docs.select(whole_row(docs).alias("row"), *[c.alias(k) for k, c in keys.items()])
    return row.join(gone, [row[k].eqNullSafe(gone[k]) for k in keys], "left_anti").select("row.*")


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Later steps then start from replicated files, so a lost executor costs a reread and
    not a recomputation. The files belong to the run; whoever owns the folder purges it.
    Shuffle files of finished steps go once the driver collects its garbage, so it is asked to.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    schema = df.schema
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def once(df: DataFrame, *keep: str, **columns: Column) -> DataFrame:
    """``keep`` and new ``columns`` that are evaluated once per row.

    The optimizer copies a column's expression into later expressions and filters, even into
    lambdas, which run it per element. It doesn't look through a generator, and one of a single
    row costs next to nothing.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
