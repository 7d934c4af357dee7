"""Intermediate tables that are read more than once: written to the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame

_folders: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """Write once below ``spark.checkpoint.dir`` and read back. A cluster has to name that folder; only where driver and
    executors are one machine a temporary one stands in for it."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewrit-")
        spark.conf.set("spark.checkpoint.dir", base)
    at = os.path.join(base, f"tidewrit-{uuid.uuid4().hex}")
    _folders.append(at)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def tidy(spark) -> None:
    """Delete what queries of this process have written; their results can't be read after that."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _folders:
        path = jvm.org.apache.hadoop.fs.Path(_folders.pop())
        path.getFileSystem(conf).delete(path, True)
