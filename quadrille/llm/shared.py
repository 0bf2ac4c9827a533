"""Intermediate tables in the folder that driver and executors share.

Tables written here cut lineage: a lost executor costs a re-read, not a
recomputation of everything before.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes and rows of an Arrow batch at most; a longer text is a batch of its own.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset and there is one machine, as in tests, a local one is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        path = f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def give_back() -> None:
    """Return freed memory to the system: workers are used again, and what they keep adds to the next task's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def bound_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of the session are bounded; smaller bounds of its own stay."""
    conf = spark.conf
    for key, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        now = int(conf.get(f"spark.sql.execution.arrow.{key}").rstrip("b"))
        if not 0 < now <= most:
            conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with batches of bounded size, whose workers keep no freed memory after a task."""
    bound_batches(df.sparkSession)

    def tidy(batches):
        yield from run(batches)
        give_back()

    return df.mapInArrow(tidy, schema)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.deleteOnExit(where)
    # with its scheme, so that it names one place for Spark and for pyarrow
    full = store.makeQualified(where).toString()
    return f"file://{full[5:]}" if full.startswith("file:/") and not full.startswith("file://") else full


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of ``df`` (or name given earlier) has."""
    used = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def dealt_anew(df: DataFrame, key: str) -> DataFrame:
    """Aggregated rows without the partitioning that the aggregation left.

    A join on ``key`` then shuffles both sides, and adaptive execution may
    split a key that very many rows of the other side share.
    """
    again = F.unhex(F.hex(key)) if dict(df.dtypes)[key] == "binary" else F.col(key).cast("string").cast("long")
    return df.withColumn(key, again)
