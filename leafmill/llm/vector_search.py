"""Nearest neighbours by an inverted file with product-quantised residuals.

Coarse centroids divide the rows into lists; what a row's centroid leaves over is stored as one
byte per subspace. A query scores the rows of its nearest lists by asymmetric distance tables
(its products with every codeword), and the best of them are reranked exactly on the original
vectors, in double precision; so is every other row of these lists whose score and quantisation
error leave it a chance, so that codes lose no neighbour, whatever the rows. Centroids, codewords
and the number of lists to probe come from bounded samples of distinct vectors and of queries, the
last such that these queries meet a recall on the sample; every row is indexed.

The index is dealt to shards by list: neighbouring small lists share a shard, large ones have
several, with a part of their rows each. A query goes only to shards with a list that it probes,
once to each, and scores only the lists it probes there. Queries of a shard come in blocks of
bounded size, for each of which the shard's rows are sent once.

Inputs with defined results: vectors that are null, empty, zero, of unusual length or with null
or non-finite components take no part, nor do rows without id; rows with one id count as one
vector (see valid_vectors); equal vectors are searched as one, which stands for its smallest k + 1
ids (no query needs more of them), so that ties go to the smaller id; fewer candidates than k give them all; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_map
from .vectors import matrix, sample, valid_vectors


@dataclass(frozen=True)
class IvfPq:
    """Coarse centroids (lists x dim), codewords (subspaces x 256 x width), and how many lists to probe."""

    coarse: np.ndarray
    words: np.ndarray
    probes: int


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    half = (centers**2).sum(1) / 2
    return np.concatenate([(x[i : i + 4096] @ centers.T - half).argmax(1) for i in range(0, len(x), 4096)] or [np.zeros(0, dtype=np.int64)])


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        at = _nearest(x, centers)
        n = np.bincount(at, minlength=len(centers))
        sums = np.stack([np.bincount(at, x[:, d], len(centers)) for d in range(x.shape[1])], axis=1)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    return centers


def _subspaces(x: np.ndarray, width: int) -> np.ndarray:
    """(subspaces, rows, width), the last one padded with zeros."""
    short = -x.shape[1] % width
    return np.pad(x, ((0, 0), (0, short))).reshape(len(x), -1, width).transpose(1, 0, 2)


def fit(points: np.ndarray, total: int, k: int, recall: float = 0.97, width: int = 2, seed: int = 3, asked: np.ndarray | None = None) -> IvfPq:
    """Fits on a sample that stands for `total` rows; `asked` are queries to calibrate on, the sample's own points without any."""
    rng = np.random.default_rng(seed)
    lists = int(np.clip(2 * np.sqrt(total), 1, min(1024, max(1, len(points) // 20))))
    coarse = _kmeans(points, lists, 8, rng)
    at = _nearest(points, coarse)
    words = []
    for part in _subspaces(points - coarse[at], width):
        found = _kmeans(part, 256, 6, rng)
        words.append(np.pad(found, ((0, 256 - len(found)), (0, 0)), constant_values=1e30))
    # searches of the sample: in which of its nearest lists a query finds its neighbours
    asked = points if asked is None or not len(asked) else asked
    q = asked[rng.choice(len(asked), min(200, len(asked)), replace=False)]
    scores = q @ points.T
    for i, v in enumerate(q):
        scores[i, (points == v).all(1)] = -np.inf
    best = np.argsort(-scores, axis=1)[:, : min(k, max(1, len(points) - 1))]
    to_coarse = q @ coarse.T
    place = np.empty(to_coarse.shape, dtype=np.int64)
    np.put_along_axis(place, np.argsort(-to_coarse, axis=1), np.arange(len(coarse))[None, :], axis=1)
    needed = np.sort(np.take_along_axis(place, at[best], axis=1).ravel())
    return IvfPq(coarse, np.stack(words), int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1)


def tables(model: IvfPq, q: np.ndarray) -> np.ndarray:
    """A query's products with every codeword: subspaces x queries x 256."""
    words = np.where(model.words > 1e29, 0, model.words)
    return np.stack([p @ w.T for p, w in zip(_subspaces(q, model.words.shape[2]), words)]).astype(np.float32)


def _lost(model: IvfPq, x: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """How far each row is from what its list and codes say of it."""
    left = _subspaces(x - model.coarse[lists], model.words.shape[2])
    return np.sqrt(sum(((p - w[codes[:, j]]) ** 2).sum(1) for j, (p, w) in enumerate(zip(left, model.words))))


def encode(model: IvfPq, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The list and the codes (rows x subspaces) of each row."""
    at = _nearest(x, model.coarse)
    parts = _subspaces(x - model.coarse[at], model.words.shape[2])
    return at, np.stack([_nearest(p, w) for p, w in zip(parts, model.words)], axis=1).astype(np.uint8)


def probed_lists(model: IvfPq, q: np.ndarray) -> np.ndarray:
    """Queries x lists: whether a query probes a list."""
    to_coarse = q @ model.coarse.T
    probes = min(model.probes, len(model.coarse))
    out = np.zeros(to_coarse.shape, dtype=bool)
    np.put_along_axis(out, np.argpartition(-to_coarse, probes - 1, axis=1)[:, :probes], True, axis=1)
    return out


def deal(coarse: np.ndarray, sizes: np.ndarray, shard_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each list its first shard and how many it has: large lists several of their own, small ones share one with their neighbours."""
    first, parts = np.zeros(len(sizes), dtype=np.int64), np.maximum(1, -(-sizes // shard_rows))
    left, at, shard, held = np.ones(len(sizes), dtype=bool), 0, 0, 0
    for _ in range(len(sizes)):
        left[at] = False
        if held and (held + sizes[at] > shard_rows):
            shard, held = shard + 1, 0
        first[at] = shard
        if parts[at] > 1:
            shard, held = shard + int(parts[at]), 0
        else:
            held += sizes[at]
        if left.any():
            at = int(np.where(left, ((coarse - coarse[at]) ** 2).sum(1), np.inf).argmin())
    return first, parts


def _search(model: IvfPq, queries: pa.Table, rows: pa.Table, k: int, rerank: int) -> pa.Table:
    """The k best rows of a shard for each query of a block: lists probed, tables added up, the best reranked exactly.

    A row is a vector with the ids that it stands for. A score is off by at most the query's length times what the row's
    code lost, so rows of probed lists that may still be among the k best by that are reranked too, however many they are.
    """
    q, ids = matrix(queries["vec"]), queries["id"].to_numpy()
    if not len(q) or not rows.num_rows:
        return pa.table({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
    x, row_ids, lists = matrix(rows["vec"]), rows["ids"].to_pylist(), rows["list"].to_numpy()
    codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), dtype=np.uint8).reshape(len(x), -1)
    order = np.argsort(lists, kind="stable")
    x, row_ids, lists, codes = x[order], [np.array(row_ids[i]) for i in order], lists[order], codes[order]
    edges = np.searchsorted(lists, np.arange(len(model.coarse) + 1))
    to_coarse, probed = q @ model.coarse.T, probed_lists(model, q)
    by_word = tables(model, q)
    # with room for the rounding of scores to single precision
    lost = _lost(model, x, lists, codes) + 1e-5 * (np.sqrt((x**2).sum(1)) + np.sqrt((model.coarse**2).sum(1))[lists])
    lengths = np.sqrt((q**2).sum(1))
    out = []
    step = max(1, (1 << 23) // len(x))
    for start in range(0, len(q), step):
        block = slice(start, min(len(q), start + step))
        scores = np.full((block.stop - start, len(x)), -np.inf, dtype=np.float32)
        for c in np.flatnonzero(edges[1:] > edges[:-1]):
            rows_in, asking = slice(edges[c], edges[c + 1]), np.flatnonzero(probed[block, c])
            if len(asking):
                near = np.repeat(to_coarse[block][asking, c].astype(np.float32)[:, None], rows_in.stop - rows_in.start, axis=1)
                for j in range(len(by_word)):
                    near += by_word[j, start + asking][:, codes[rows_in, j]]
                scores[asking, rows_in] = near
        depth = min(rerank + 1, len(x))  # one more, as the query's own vector may be among them
        last = -np.partition(-scores, depth - 1, axis=1)[:, depth - 1]
        for i, low in enumerate(last):
            at = np.flatnonzero((scores[i] >= low) & (scores[i] > -np.inf))
            exact = x[at] @ q[start + i]
            if len(at) > k:  # the query's own row may be one of k + 1
                least = -np.partition(-exact, k)[k]
                more = np.flatnonzero((scores[i] < low) & (scores[i] > -np.inf) & (scores[i] + lengths[start + i] * lost >= least))
                at, exact = np.concatenate([at, more]), np.concatenate([exact, x[more] @ q[start + i]])
            kept = np.argsort(-exact, kind="stable")
            kept = kept[exact[kept] >= exact[kept[min(k, len(kept) - 1)]]] if len(kept) else kept
            each = [row_ids[j] for j in at[kept]]
            found = np.concatenate([*each, np.zeros(0, np.int64)])
            score = np.repeat(exact[kept], [len(e) for e in each])
            found, score = found[found != ids[start + i]], score[found != ids[start + i]]
            first = np.lexsort((found, -score))[:k]
            out.append((np.full(len(first), ids[start + i]), found[first], score[first]))
    return pa.table({n: np.concatenate([o[i] for o in out]) for i, n in enumerate(("query_id", "vec_id", "score"))})


def _distinct(rows: DataFrame, most: int) -> DataFrame:
    """(ids, vec): each vector once, with at most its `most` smallest ids; many copies are ranked in parts first."""
    vec = F.transform("vec", lambda x: x + F.lit(0).cast(dict(rows.dtypes)["vec"][6:-1]))  # -0.0 is 0.0
    least = lambda ids: F.slice(F.array_sort(ids), 1, most)
    parts = rows.groupBy(vec.alias("vec"), F.pmod(F.xxhash64("id", F.lit(5)), F.lit(256)).alias("_part")).agg(least(F.collect_list("id")).alias("ids"))
    return parts.groupBy("vec").agg(least(F.flatten(F.collect_list("ids"))).alias("ids")).select("ids", "vec")


def nearest(df: DataFrame, queries: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, rerank: int = 100, shard_rows: int = 8192, block_queries: int = 4096, max_sample: int = 20_000) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found for each row that `queries` selects."""
    spark = df.sparkSession
    scratch = Scratch(spark, "search")
    rows = scratch.table(valid_vectors(df, id_col, vec_col), "vectors")
    asking = rows.withColumnRenamed("id", id_col).where(queries).withColumnRenamed(id_col, "id").select("id", "vec")
    distinct = scratch.table(_distinct(rows, k + 1), "distinct")
    points, total = sample(distinct.select(F.col("ids")[0].alias("id"), "vec"), max_sample)
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    model = spark.sparkContext.broadcast(fit(points, total, k, asked=sample(asking, 1000)[0]))

    def index(batch: pa.RecordBatch) -> dict | None:
        if not batch.num_rows:
            return None
        at, codes = encode(model.value, matrix(batch.column(1)))
        return {"ids": batch.column(0), "vec": batch.column(1), "list": at, "codes": [c.tobytes() for c in codes]}

    kinds = dict(rows.dtypes)
    indexed = scratch.table(arrow_map(distinct, index, f"ids array<{kinds['id']}>, vec {kinds['vec']}, list int, codes binary"), "index")
    scratch.drop(distinct)
    sizes = np.zeros(len(model.value.coarse), dtype=np.int64)
    for r in indexed.groupBy("list").count().collect():  # a row for each list, at most 1,024
        sizes[r[0]] = r[1]
    first, parts = deal(model.value.coarse, sizes, shard_rows)
    dealt = spark.createDataFrame([(i, int(f), int(p)) for i, (f, p) in enumerate(zip(first, parts))], "list int, first long, parts long")

    def route(batch: pa.RecordBatch) -> dict | None:
        if not batch.num_rows:
            return None
        at, shard = [], []
        for i, lists in enumerate(probed_lists(model.value, matrix(batch.column(1)))):
            own = np.unique(np.concatenate([np.arange(first[c], first[c] + parts[c]) for c in np.flatnonzero(lists)]))
            at.append(np.full(len(own), i))
            shard.append(own)
        taken = batch.take(pa.array(np.concatenate(at)))
        return {"id": taken.column(0), "vec": taken.column(1), "shard": np.concatenate(shard)}

    asked = scratch.table(arrow_map(asking, route, f"id {kinds['id']}, vec {kinds['vec']}, shard long"), "asked")
    loads = asked.groupBy("shard").agg(F.ceil(F.count("*") / block_queries).alias("blocks")).select(F.col("shard").alias("of"), "blocks")
    loads = scratch.table(loads, "loads")
    left = asked.join(loads, F.col("shard") == F.col("of")).select("id", "vec", "shard", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).alias("block"))
    placed = indexed.join(F.broadcast(dealt), "list")  # a row for each list
    placed = placed.select("ids", "vec", "list", "codes", (F.col("first") + F.pmod(F.xxhash64(F.col("ids")[0], F.lit(2)), F.col("parts"))).alias("shard"))
    right = placed.join(loads, F.col("shard") == F.col("of")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("of", "blocks")
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(lambda a, b: _search(model.value, a, b, k, rerank), "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
