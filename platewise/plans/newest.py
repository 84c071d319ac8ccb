"""The newest child of each parent (a dish's newest photo), kept in a stored table instead of aggregated for each request.

The table has one row a parent: key, child id and the child's time, in folders by hash of the key. A batch of
new children rewrites the folders of its own parents only, merging it again changes nothing, and
batches may come in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64  # folders; a table keeps the number that it was begun with


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str) -> None:
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def _stored(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _newest(ts: str, child_id: str):
    """The newest child of a group: a row without a child (all were taken out) is older than any."""
    return F.max_by(F.struct(child_id, ts), F.struct(F.col(child_id).isNotNull(), ts, child_id)).alias("c")


def build_newest(children: DataFrame, path: str, key: str, ts: str, child_id: str, buckets: int = BUCKETS) -> None:
    """Write the table anew from all children; they are aggregated before the shuffle."""
    new = children.where(F.col(key).isNotNull()).withColumn("bucket", _bucket(key, buckets))
    rows = new.groupBy("bucket", key).agg(_newest(ts, child_id)).select(key, "c.*", "bucket")
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def merge_newest(children: DataFrame, path: str, key: str, ts: str, child_id: str, buckets: int = BUCKETS) -> int:
    """Merge children into the table at ``path``; returns how many folders were written.

    Of equal times the greatest id is the newest; a null time is older than any. Children without a parent
    are left out.
    """
    spark = children.sparkSession
    new = children.where(F.col(key).isNotNull()).select(key, child_id, ts).withColumn("bucket", _bucket(key, buckets))
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most ``buckets``
    if not touched:
        return 0
    if _stored(spark, path):
        new = new.unionByName(spark.read.schema(new.schema).parquet(path).where(F.col("bucket").isin(touched)))
    _write(new.groupBy("bucket", key).agg(_newest(ts, child_id)).select(key, "c.*", "bucket"), path)
    return len(touched)


def forget_children(gone: DataFrame, children: DataFrame, path: str, key: str, ts: str, child_id: str, buckets: int = BUCKETS) -> int:
    """Take children (key, child id) out of the table at ``path``; returns how many folders were written.

    ``children`` are all that are left. Only parents whose stored newest child is gone are looked up
    in it; a parent with no child left keeps its row, with nulls.
    """
    spark = gone.sparkSession
    if not _stored(spark, path):
        return 0
    gone = gone.select(key, child_id).distinct().withColumn("bucket", _bucket(key, buckets))
    touched = [r.bucket for r in gone.select("bucket").distinct().collect()]
    types = children.select(key, child_id, ts).withColumn("bucket", F.lit(0)).schema
    old = spark.read.schema(types).parquet(path).where(F.col("bucket").isin(touched))
    hit = old.join(gone, ["bucket", key, child_id], "left_semi").select("bucket", key)
    left = children.join(hit, key, "left_semi").join(gone, [key, child_id], "left_anti")
    again = left.groupBy(key).agg(_newest(ts, child_id)).select(key, "c.*")
    again = hit.join(again, key, "left").select(key, child_id, ts, "bucket")
    kept = old.join(hit, ["bucket", key], "left_anti").select(key, child_id, ts, "bucket")
    _write(kept.unionByName(again), path)
    return len(touched)


def newest(spark: SparkSession, path: str, key: str, child_id: str) -> DataFrame:
    """(key, child id) of the parents that have a child: a scan of two columns, one row a parent."""
    return spark.read.parquet(path).select(key, child_id).where(F.col(child_id).isNotNull())
