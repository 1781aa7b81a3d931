"""Folders that driver and executors share, for streams' checkpoints, sinks and tables that several steps read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under spark.checkpoint.dir; under a temporary one where that is unset and everything runs in one process."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="leafmill-")
    return f"{base.rstrip('/')}/leafmill/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in a new folder, so that steps that read it several times work it out once."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of input files for each partition that `spread` makes, and from which on a size is Spark's sign for one that it doesn't know.
SPREAD_BYTES, UNKNOWN = 2 << 20, 1 << 60


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to as many partitions as its tables ask for, so that what a task holds doesn't grow with them; small ones and those of unknown size are left to Spark."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    n = -(-sum(s for s in sizes if s < UNKNOWN) // SPREAD_BYTES)
    return df.repartition(n, *keys) if n > 1 else df
