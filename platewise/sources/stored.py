"""Tables that a job stores for itself in a folder that all executors see."""

from __future__ import annotations

import hashlib
import tempfile

from pyspark.sql import SparkSession


def stored_path(spark: SparkSession, name: str, of: str) -> str:
    """A path for table ``name`` made from ``of``: below ``spark.checkpoint.dir``, which is set to a local folder only where a local session has none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="platewise-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{hashlib.md5(of.encode()).hexdigest()}"
