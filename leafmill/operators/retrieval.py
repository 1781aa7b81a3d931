"""Vector rows, exact nearest chunks, hybrid reranking, evidence and citations."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T


def cosine_distance2(vector: Column, query: Column) -> Column:
    """Squared distance of unit vectors, in doubles."""
    return F.aggregate(F.zip_with(vector, query, lambda a, b: F.pow(a.cast("double") - b.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x)


def nearest(rows: DataFrame, query: list[float], k: int, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """The k nearest rows of one query by squared distance: a combining top-k, no shuffle of rows."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.withColumn("distance", cosine_distance2(F.col(vector), q)).orderBy("distance", id_col).limit(k)


#: Queries and rows that one task compares, and distances that it holds at a time.
QUERY_BLOCK, ROW_BLOCK, HELD = 1000, 10_000, 1 << 20


def _block_best(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The k nearest rows of a block for each query of a block: candidates by products of matrices, distances of those one by one."""
    q, x = (np.array(t["vector"].combine_chunks().flatten(), dtype=np.float64).reshape(len(t), -1) for t in (queries, rows))
    sizes, n, step = (x * x).sum(1), min(k, len(x)), max(1, HELD // len(x))
    ids, out = rows["id"].to_numpy(), {"query_id": [], "id": [], "distance": []}
    for i, query_id in enumerate(queries["query_id"].to_numpy()):
        if i % step == 0:
            some = q[i : i + step]
            rough = some @ x.T
            rough *= -2
            rough += (some * some).sum(1)[:, None]
            rough += sizes
        limit = np.partition(rough[i % step], n - 1)[n - 1]
        near = np.flatnonzero(rough[i % step] <= limit + 1e-9 * (1 + abs(limit)))
        exact = ((x[near] - q[i]) ** 2).sum(1)
        best = np.lexsort((ids[near], exact))[:n]
        out["query_id"].append(np.full(n, query_id))
        out["id"].append(ids[near][best])
        out["distance"].append(exact[best])
    return pa.table({c: np.concatenate(v) for c, v in out.items()})


def nearest_each(rows: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(query_id, rank, id, distance): the k nearest rows of each query (id, vector) by squared distance, ties to the smaller id.

    Queries and rows meet in blocks of bounded size, each pair of blocks a task of its own that gives k rows a query; of
    these the k best are kept, and Spark keeps no more than k of a query on the way. A query finds itself where it is
    among the rows. Ids are numbers and should be unique; rows without an id or a vector take no part, nor do those of another length than
    most queries have.
    """
    pick = lambda df, name: df.where(F.col(id_col).isNotNull() & (F.size(vector) > 0)).select(F.col(id_col).cast("long").alias(name), F.col(vector).cast("array<double>").alias("vector"))
    q, x = pick(queries, "query_id"), pick(rows, "id")
    sizes = q.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return q.select("query_id", F.lit(1).alias("rank"), F.col("query_id").alias(id_col), F.lit(0.0).alias("distance"))
    q, x = (t.where(F.size("vector") == sizes["d"]) for t in (q, x))
    of_q, of_x = (max(1, -(-n // block)) for n, block in ((sizes["n"], QUERY_BLOCK), (x.count(), ROW_BLOCK)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = q.select("*", own("query_id", of_q).alias("a"), every(of_x).alias("b"))
    right = x.select("*", own("id", of_x).alias("b"), every(of_q).alias("a"))

    def compare(asked: pa.Table, found: pa.Table) -> pa.Table:
        if not len(asked) or not len(found):
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        return _block_best(asked, found, k)

    best = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(compare, "query_id long, id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "distance")


def hybrid(rows: DataFrame, query_vector: list[float], query: str, k: int) -> DataFrame:
    """Over-fetches min(max(4k, k), 50) rows by distance, then ranks by distance and coverage, one row per text."""
    probe = nearest(rows, query_vector, min(max(4 * k, k), 50))
    scored = probe.withColumn("score", T.hybrid_score(F.col("distance"), T.tokens(F.lit(query)), T.tokens(F.col("content"))))
    first = Window.partitionBy("content").orderBy(F.desc("score"), "distance", "vec_id")
    return scored.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k").orderBy(F.desc("score"), "distance", "vec_id").limit(k)


def number_duplicates(rows: DataFrame, hash_col: str, order: list[str]) -> DataFrame:
    """Row ids: the hash, and for its later occurrences the hash with -1, -2, ..."""
    n = F.row_number().over(Window.partitionBy(hash_col).orderBy(*order)) - 1
    return rows.withColumn("_n", n).withColumn("row_id", F.when(F.col("_n") == 0, F.col(hash_col)).otherwise(F.concat(hash_col, F.lit("-"), F.col("_n")))).drop("_n")


def to_metadata(pages: Column, section: Column, tokens: Column) -> Column:
    """Scalar form of a chunk's metadata."""
    return F.struct(F.array_join(F.transform(pages, lambda p: p.cast("string")), ",").alias("page_numbers"), section.alias("section_context"), tokens.alias("token_count"))


def from_metadata(pages: Column) -> Column:
    """Positive page numbers of a comma-separated text; [1] without any."""
    read = F.filter(F.transform(F.split(pages, ","), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull() & (x > 0))
    return F.when(F.size(read) > 0, read).otherwise(F.array(F.lit(1)))


def citation(content: Column, content_hash: Column, page: Column) -> Column:
    return F.concat(F.lit("- "), content, F.lit(" (content_hash="), content_hash, F.lit(", page="), page.cast("string"), F.lit(")"))


def evidence(content: Column, content_hash: Column, page: Column) -> Column:
    """A chunk as a line of evidence for a prompt."""
    return F.concat(F.lit("[hash="), content_hash, F.lit(" page="), page.cast("string"), F.lit("] "), content)


def latest(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """Number and folder of a versioned table's last committed version; 0 and None before the first."""
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/log")
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
    # an entry's name is its version's number and folder, so that one rename commits
    found = max((n for n in names if n[0].isdigit()), default=None)
    return (int(found.split("-")[0]), f"{path}/versions/{found}") if found else (0, None)


def versioned(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The last committed version of a table that upsert writes."""
    _, folder = latest(spark, path)
    return spark.read.schema(schema).parquet(folder) if folder else spark.createDataFrame([], schema)


def upsert(rows: DataFrame, path: str, key: str = "row_id") -> None:
    """Replaces rows of a table by key and adds the others, as a new version; the first call makes the table.

    Of rows with one key the greatest by all columns counts. A version is written to a folder of its own and
    counts from the one rename that puts its entry into the log, so readers see the old table or the new one,
    wherever a call stops. One call at a time: one that finds another's new version fails. Versions before the last two go.
    """
    spark = rows.sparkSession
    jvm = spark._jvm
    number, folder = latest(spark, path)
    columns = rows.columns
    rows = rows.groupBy(key).agg(F.max(F.struct(*columns)).alias("r")).select("r.*")
    if folder:
        old = spark.read.schema(rows.schema).parquet(folder)
        rows = rows.unionByName(old.join(rows.select(key), key, "left_anti").select(*columns))
    name = f"{number + 1:010d}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/versions/{name}")
    commit(spark, path, number, name)
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for entry in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/versions")):
        if int(entry.getPath().getName().split("-")[0]) < number:
            fs.delete(entry.getPath(), True)


def commit(spark: SparkSession, path: str, after: int, name: str) -> None:
    """Puts a version's entry into the log, if `after` is still the last one."""
    if latest(spark, path)[0] != after:
        raise RuntimeError(f"another call has written version {after + 1}")
    at = lambda x: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/log/{x}")
    fs = at("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.create(at(f".{name}"), True).close()
    if not fs.rename(at(f".{name}"), at(name)):
        raise OSError(f"version {name} can't be committed")


def add_new(known: DataFrame, found: DataFrame) -> DataFrame:
    """Known rows and those found rows whose hash isn't known."""
    return known.unionByName(found.join(known.select("content_hash"), "content_hash", "left_anti").select(*known.columns))
