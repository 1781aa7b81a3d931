"""What the operators of this package share: shared-folder tables, Arrow maps, prefix sums, graph components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir; a temporary one where that is unset and everything runs in one process."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="leafmill-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


_scope: ContextVar[list | None] = ContextVar("leafmill_scope", default=None)


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Removes, at its end, all tables that operators called inside have left: for callers that have written the result by then."""
    opened: list[Scratch] = []
    token = _scope.set(opened)
    try:
        yield
    finally:
        _scope.reset(token)
        for s in opened:
            s.remove(s.folder)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Removes the shuffle files of each statement inside as it ends, not when the driver's garbage is collected: for writes, whose result is read from then on."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Tables of one operator's run, in the shared folder.

    A table cuts the lineage with files that survive the loss of any executor, and gives the
    reader real sizes for its join choice. `drop` removes tables that no later step reads; those
    that the operator's own result reads stay until a scratch_scope around it ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_dir(spark)}/leafmill/{name}-{uuid.uuid4().hex}"
        self.made: list[str] = []
        if (opened := _scope.get()) is not None:
            opened.append(self)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{len(self.made):03d}-{name}"
        with shuffles_removed(self.spark):
            df.write.parquet(path)
        self.made.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._leafmill_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self.remove(t._leafmill_path)

    def keep_only(self, *tables: DataFrame) -> None:
        """Drops all other tables."""
        for path in {*self.made} - {t._leafmill_path for t in tables}:
            self.remove(path)

    def remove(self, path: str) -> None:
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


#: Bits of the bitmaps that thin out rows before a join, as a power of two.
BITS = 24


def maybe_in(rows: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """Adds `maybe` to rows: false only where the id isn't in the one column of `ids`.

    The ids become a bitmap of fixed size, 2^BITS bits in at most 2^BITS / 64 rows, which is
    broadcast. So only few rows that a join wouldn't find have to be shuffled to it.
    """
    spot = lambda c: F.pmod(F.xxhash64(F.lit(3), c), F.lit(1 << BITS))
    word = lambda c: F.shiftright(spot(c), 6).cast("int")
    bit = lambda c: F.pmod(spot(c), F.lit(64)).cast("int")
    own = F.col(ids.columns[0])
    bits = ids.groupBy(word(own).alias("_w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(own))).alias("_bits"))
    found = F.call_function("shiftrightunsigned", F.col("_bits"), bit(F.col(id_col))).bitwiseAND(F.lit(1)) == 1
    return rows.join(F.broadcast(bits), word(F.col(id_col)) == F.col("_w"), "left").withColumn("maybe", F.coalesce(found, F.lit(False))).drop("_w", "_bits")


def without(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows of df whose id isn't in the one column of `ids`, a table; only rows whose id may be there are shuffled. Rows without an id stay."""
    rows = maybe_in(df.select(F.col(id_col).alias("id"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")), "id", ids)
    checked = rows.where("maybe").join(ids.select(F.col(ids.columns[0]).alias("gone")).hint("merge"), F.col("id") == F.col("gone"), "left_anti")
    return rows.where("NOT maybe").unionByName(checked).select(*[F.col("row")[c].alias(c) for c in df.columns])


#: Bytes of an Arrow batch of texts, and the setting that bounds it.
BATCH_BYTES, _BATCH = 1 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session hands Python batches of at most about BATCH_BYTES, or of one longer row.

    Spark's own bound, 10,000 rows, is none for texts: a batch is held several times, by the
    executor outside its heap and by the worker. The bound is read when a statement runs, so it
    stays set for the results that callers write later; a smaller one of theirs is kept.
    """
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH)) > BATCH_BYTES:
        spark.conf.set(_BATCH, BATCH_BYTES)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: StructType | str) -> DataFrame:
    """Maps each Arrow batch to a dict of columns; all columns of `schema`, in any order. Arrow columns are passed on as they are."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)

        def column(x: object, kind: pa.DataType) -> pa.Array:
            return x.cast(kind) if isinstance(x, pa.Array) else pa.array(x, type=kind)

        for batch in batches:
            out = fn(batch)
            if out is not None:
                yield pa.RecordBatch.from_arrays([column(out[n], arrow.field(n).type) for n in names], schema=arrow)

    return df.mapInArrow(run, schema)


def text_or_empty(column: pa.Array) -> list[str]:
    """Python strings of an Arrow text column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def prefix_sums(df: DataFrame, keys: list[str], order: list[str], amount: str, out: str, scratch: Scratch) -> DataFrame:
    """Adds `out`: the sum of `amount` over the rows before this one, among equal `keys`, in the order of `order`.

    df is a table of the caller's own columns, so that names never clash, and slim: its rows are
    range-partitioned on keys and order together, so that a key with a third of all rows spreads
    over many partitions. Each sorted partition adds up its own rows in one pass, and the totals
    of partitions and keys are added up once more. `order` has to be unique within a key for a
    result that reruns repeat.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    dealt = scratch.table(_running(dealt.withColumn("_part", F.spark_partition_id()), keys, amount), "ranges")
    totals = dealt.groupBy("_part", *keys).agg(F.sum(amount).alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    starts = scratch.table(starts, "starts")
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    # a row for each key and partition that has it: Spark broadcasts it below its own limit and else splits the join
    joined = dealt.join(starts, same, "left")
    return joined.select(*df.columns, (F.col("_inside") + F.col("_before")).alias(out))


def _running(df: DataFrame, keys: list[str], amount_col: str) -> DataFrame:
    """Adds `_inside`, the sum of the amounts of earlier rows of the partition with equal keys; rows come sorted by keys."""
    schema = StructType.fromJson(df.schema.jsonValue()).add("_inside", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, 0
        for batch in batches:
            inside = []
            rows = zip(*(batch.column(k).to_pylist() for k in keys))
            for key, amount in zip(rows, batch.column(amount_col).to_pylist()):
                if key != last:
                    last, total = key, 0
                inside.append(total)
                total += amount
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(inside, type=pa.int64())], names=[*batch.schema.names, "_inside"])

    return df.mapInArrow(run, schema)


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node reachable.

    Alternates large-star and small-star steps until the edges form stars, that is until no node
    has two edges upwards, or edges both ways; the number of rounds grows with the logarithm of the longest path. Every step is a combining
    aggregation and a merge join of two tables, which adaptive execution may split where one
    node has very many edges; neither is broadcast, as the driver would hold it whole. Edges from a node to itself don't count.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = scratch.table(e, "edges")

    def open_nodes(x: DataFrame) -> int:
        ends = x.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(x.select("b", F.lit(0), F.lit(1)))
        return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up > 0 AND down > 0").count()

    while open_nodes(e):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = scratch.table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "large")
        wide = scratch.table(both.join(large.hint("merge"), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        scratch.drop(e, large)
        small = scratch.table(wide.groupBy("a").agg(F.min("b").alias("m")), "small")
        moved = wide.join(small.hint("merge"), "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = scratch.table(moved.unionAll(small.select("a", F.col("m").alias("b"))).distinct(), "edges")
        scratch.drop(wide, small)
    found = e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    out = scratch.table(found, "components")
    scratch.drop(e)
    return out
