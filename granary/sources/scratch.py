"""Tables that cut lineage: written below the folder that driver and executors share, and deleted once they are no longer read."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, or below the context's own checkpoint folder.

    Where neither is set a temporary folder is taken, but only if the session runs in one process; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), f"checkpoints-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df and read it back: lineage ends there, and a lost executor loses nothing."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def dealt(rows: DataFrame, at_once: int, *by: str) -> DataFrame:
    """rows dealt by columns over tasks of some at_once rows each, so that both the tasks and the size of one are set by the rows, not by how they lie in files.

    It is for narrow rows that a step makes much of; what is grouped or joined by the columns afterwards stays in its task.
    """
    return rows.repartition(max(1, -(-rows.count() // at_once)), *by)


def forget(*tables: DataFrame) -> None:
    """Delete what materialize wrote for these tables; nothing that still has to run may read them."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
