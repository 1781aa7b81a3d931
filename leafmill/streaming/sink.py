"""A sink that takes each batch of a stream exactly once, whatever stops it.

A batch goes to a folder of its own, named by query and batch, replacing what a stopped attempt at
the same batch has left; then its entry in the log is put in place by one rename. Readers take only batches with
an entry. A query that starts again from its checkpoint gives a batch the same rows and the same number, so a
batch whose entry stands is passed over. Queries with checkpoints of their own don't get in each
other's way.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.types import StructType


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    where, fs = _files(spark, path)
    return fs.exists(where)


def _commit(spark: SparkSession, folder: str, name: str, entry: dict) -> None:
    beside, fs = _files(spark, f"{folder}/log/.{name}.next")
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    if not fs.rename(beside, _files(spark, f"{folder}/log/{name}")[0]):
        raise OSError(f"batch {name} can't be committed")


def taker(folder: str, commit: Callable = _commit) -> Callable[[DataFrame, int], None]:
    """The function for foreachBatch."""

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        name = f"{query}-{number:012d}"
        if _exists(spark, f"{folder}/log/{name}"):
            return
        seen = Observation()
        batch.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{folder}/data/{name}")
        commit(spark, folder, name, {"query": query, "batch": number, "rows": seen.get["rows"]})

    return take


def write(rows: DataFrame, folder: str, checkpoint: str, mode: str = "append", commit: Callable = _commit) -> StreamingQuery:
    """Starts a stream into a folder, over what is there now; the checkpoint lets a later start go on where this one ends."""
    return rows.writeStream.foreachBatch(taker(folder, commit)).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def log(spark: SparkSession, folder: str) -> DataFrame:
    """Committed batches: query, batch, rows."""
    schema = "query string, batch long, rows long"
    return spark.read.schema(schema).json(f"{folder}/log") if _exists(spark, f"{folder}/log") else spark.createDataFrame([], schema)


def read(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """Rows of the committed batches; one entry a batch is read on the driver, as a list of files is."""
    names = [f"{folder}/data/{r['query']}-{r['batch']:012d}" for r in log(spark, folder).select("query", "batch").toLocalIterator()]
    return spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)


class LateRows(StreamingQueryListener):
    """Counts the rows that each query's watermark drops; added by spark.streams.addListener."""

    def __init__(self):
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        n = sum(int(s.numRowsDroppedByWatermark) for s in event.progress.stateOperators)
        self.dropped[str(event.progress.id)] = self.dropped.get(str(event.progress.id), 0) + n

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
