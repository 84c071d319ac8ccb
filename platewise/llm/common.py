"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where unset in local mode (tests), a fresh local one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="platewise-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python tasks in batches of at most ``BATCH_ROWS`` rows and about ``BATCH_BYTES``."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def release() -> None:
    """At the end of a Python task: give free memory back, since the worker lives on beside the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def keep(df: DataFrame, name: str, codec: str = "snappy") -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back, which cuts the lineage.

    Returns the reread frame and the path, for :func:`drop`.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables written by :func:`keep` that nothing reads any more.

    Shuffle files of the steps before go when the driver has collected the frames that used them.
    """
    gc.collect()
    spark._jvm.System.gc()
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


BUCKETS = 1 << 20  # hash buckets of ids that a broadcast may hold: at most this many rows


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS))


def _against(df: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    name = "_bucket"
    while name in df.columns:
        name += "_"
    buckets = F.broadcast(ids.select(_bucket(key).alias(name)).distinct())
    return df.withColumn(name, _bucket(key)).join(buckets, name, how).drop(name)


def maybe_in(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key may be in ``ids``: all that are, and few others.

    The broadcast side holds hash buckets and has at most ``BUCKETS`` rows whatever the size of
    ``ids``; a full one only filters less.
    """
    return _against(df, ids, key, "left_semi")


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is not in ``ids``; rows with a null key stay.

    Most rows are surely not in the set and stay where they are; only the others are joined.
    """
    sure = _against(df, ids, key, "left_anti")
    checked = maybe_in(df, ids, key).join(ids.select(key).distinct(), key, "left_anti")
    return sure.select(df.columns).unionByName(checked.select(df.columns))
