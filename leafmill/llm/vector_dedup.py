"""Embedding near-dedup by a random-projection tree forest.

Each tree halves the space at the median projection on a random direction, again and again
until a leaf is expected to hold few enough rows; rows within a margin of a cut go to both
sides (spill). Pairs are compared only within leaves, by cosine in double precision, and links
of all trees are united. Cuts are fitted on a bounded sample; every row is routed. Where the
sample was too small to cut a leaf down to size, a tree is grown for that leaf from a sample of
its own rows, in a task, and its rows are routed on, for as many levels as LEVELS.

A pair that shares several leaves counts in the first of them, so link counts need no table
of pairs; for components a leaf reports, for each row, the smallest row it reaches there. Equal
vectors are one row with a weight. Leaves that stay large, as of one vector's near copies, are
compared in blocks, each pair of blocks a group of its own.

Inputs with defined results: rows with a null label, and vectors that are null, empty, zero,
of unusual length or with null or non-finite components, link with nothing and are kept; rows
with one id count as one vector (see valid_vectors); a row without id keeps a row without
component; an empty table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Scratch, arrow_map, connected_components
from .vectors import matrix, sample, valid_vectors


#: Further levels of trees for large leaves, the rows of one that its tree is grown from, and those routed in one task.
LEVELS, LEAF_SAMPLE, PART = 3, 4096, 50_000


@dataclass(frozen=True)
class Forest:
    """Nodes as (direction, cut, left, right), or a leaf number; and the roots."""

    nodes: tuple[tuple | int, ...]
    roots: tuple[int, ...]
    margin: float

    def leaves(self, x: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """(rows, leaf) for each leaf that rows of x reach."""
        out, todo = [], [(r, np.arange(len(x))) for r in self.roots]
        while todo:
            at, rows = todo.pop()
            node = self.nodes[at]
            if not len(rows):
                continue
            if isinstance(node, int):
                out.append((rows, node))
                continue
            direction, cut, left, right = node
            p = x[rows] @ direction
            todo += [(left, rows[p <= cut + self.margin]), (right, rows[p >= cut - self.margin])]
        return out


def grow(points: np.ndarray, total: int, trees: int, leaf_rows: int, margin: float, seed: int) -> Forest:
    """Grows trees on unit vectors that stand for `total` rows."""
    rng = np.random.default_rng(seed)
    nodes: list = []
    leaf, roots, scale = 0, [], total / max(1, len(points))
    for _ in range(trees):
        roots.append(len(nodes))
        nodes.append(None)
        todo = [(roots[-1], np.arange(len(points)))]
        while todo:
            at, rows = todo.pop()
            split = None
            if len(rows) * scale > leaf_rows and len(rows) >= 8:
                for _ in range(3):
                    d = rng.standard_normal(points.shape[1])
                    d /= np.linalg.norm(d)
                    p = points[rows] @ d
                    cut = float(np.median(p))
                    sides = rows[p <= cut + margin], rows[p >= cut - margin]
                    if max(map(len, sides)) < 0.8 * len(rows):
                        split = d, cut, sides
                        break
            if split is None:
                nodes[at] = leaf
                leaf += 1
                continue
            d, cut, sides = split
            nodes[at] = (d, cut, len(nodes), len(nodes) + 1)
            todo += [(len(nodes), sides[0]), (len(nodes) + 1, sides[1])]
            nodes += [None, None]
    return Forest(tuple(nodes), tuple(roots), margin)


def _split_large(routed: DataFrame, leaf_rows: int, margin: float, seed: int, scratch: Scratch) -> DataFrame:
    """Routes the rows of leaves over twice their size on, by a tree for each such leaf; leaves that no cut divides, as of near copies, stay as they are."""
    schema, names = routed.schema, [c for c in routed.columns if c not in ("leaf", "leaves")]
    tried = None
    for level in range(LEVELS):
        large = routed.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > 2 * leaf_rows).select(F.col("leaf").alias("big"), "n")
        large = scratch.table(large if tried is None else large.join(tried, F.col("big") == F.col("uncut"), "left_anti"), "large")
        if large.isEmpty():
            break
        inside = routed.join(large, F.col("leaf") == F.col("big"))
        drawn = inside.where(F.pmod(F.xxhash64("id", F.lit(17 + level)), F.lit(1 << 30)) < F.least(F.lit(1.0), LEAF_SAMPLE / F.col("n")) * (1 << 30)).select("leaf", "vec", "n")

        def grown(group: pa.Table) -> pa.Table:
            x = matrix(group["vec"])
            tree = grow(x / np.linalg.norm(x, axis=1, keepdims=True), group["n"][0].as_py(), 1, leaf_rows, margin, seed + level)
            return pa.table({"leaf": group["leaf"][:1], "tree": pa.array([pickle.dumps(tree)], pa.binary())})

        def route(rows: pa.Table, trees: pa.Table) -> pa.Table:
            kept = rows.select(["leaf", *names])
            if not rows.num_rows or not trees.num_rows:
                return kept.add_column(1, "piece", pa.array(np.zeros(rows.num_rows, np.int64)))
            x = matrix(rows["vec"])
            found = pickle.loads(trees["tree"][0].as_py()).leaves(x / np.linalg.norm(x, axis=1, keepdims=True))
            at = np.concatenate([i for i, _ in found])
            return kept.take(pa.array(at)).add_column(1, "piece", pa.array(np.concatenate([np.full(len(i), n) for i, n in found]), pa.int64()))

        trees = drawn.groupBy("leaf").applyInArrow(grown, "leaf long, tree binary")
        parts = F.ceil(F.col("n") / PART)
        left = inside.withColumn("part", F.pmod(F.xxhash64("id"), parts)).select("leaf", "part", *names)
        right = trees.join(large, F.col("leaf") == F.col("big")).select("leaf", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), "tree")
        flat = StructType([schema["leaf"], StructField("piece", LongType()), *[schema[c] for c in names]])
        split = scratch.table(left.groupBy("leaf", "part").cogroup(right.groupBy("leaf", "part")).applyInArrow(route, flat), "pieces")
        # numbers of new leaves: one for each piece, negative, and apart from those of other levels
        number = -1 - level - LEVELS * F.monotonically_increasing_id()
        numbers = scratch.table(split.select(F.col("leaf").alias("of"), F.col("piece").alias("p")).distinct().withColumn("number", number), "numbers")
        split = split.join(numbers, (F.col("leaf") == F.col("of")) & (F.col("piece") == F.col("p"))).select(F.col("number").alias("leaf"), *names)
        following = scratch.table(routed.join(large, F.col("leaf") == F.col("big"), "left_anti").select("leaf", *names).unionByName(split), "split")
        # one piece of a tree is the leaf that it was
        uncut = numbers.groupBy("of").agg(F.count("*").alias("c"), F.min("number").alias("uncut")).where("c = 1").select("uncut")
        tried = scratch.table(uncut if tried is None else uncut.unionByName(tried), "uncut")
        lists = following.groupBy("id").agg(F.array_sort(F.collect_set("leaf")).alias("leaves"))
        routed = scratch.table(following.join(lists, "id").select(*schema.names), "routed")
        scratch.drop(following)
    return routed


def _first_shared(a: list[list[int]], b: list[list[int]], leaf: int) -> np.ndarray:
    """Whether rows of a and b share a leaf before this one."""
    earlier = {x: i for i, x in enumerate(sorted({x for row in a for x in row if x < leaf} & {x for row in b for x in row if x < leaf}))}
    if not earlier:
        return np.zeros((len(a), len(b)), dtype=bool)

    def table(rows: list[list[int]]) -> np.ndarray:
        out = np.zeros((len(rows), len(earlier)), dtype=np.float32)
        for i, row in enumerate(rows):
            for x in row:
                if x in earlier:
                    out[i, earlier[x]] = 1
        return out

    return table(a) @ table(b).T > 0


def _compare(group: pa.Table, threshold: float) -> pa.Table:
    """Links within one leaf or between two blocks of it: for each linked row its links' weight and the smallest row reached."""
    label, side = group["label"].to_numpy(), group["side"].to_numpy()
    ids, weight, vecs, leaves = group["id"].to_numpy(), group["weight"].to_numpy(), matrix(group["vec"]), group["leaves"].to_pylist()
    lo, hi, leaf = group["lo"][0].as_py(), group["hi"][0].as_py(), group["leaf"][0].as_py()
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for value in np.unique(label):
        a, b = np.flatnonzero((label == value) & (side == lo)), np.flatnonzero((label == value) & (side == hi))
        close = vecs[a] @ vecs[b].T >= threshold
        if lo == hi:
            np.fill_diagonal(close, False)
        keep_a, keep_b = close.any(1), close.any(0)
        if not keep_a.any():
            continue
        a, b, close = a[keep_a], b[keep_b], close[np.ix_(keep_a, keep_b)]
        new = close & ~_first_shared([leaves[i] for i in a], [leaves[i] for i in b], leaf)
        reach_a, reach_b = ids[a].copy(), ids[b].copy()
        big = np.iinfo(np.int64).max
        while True:
            next_a = np.minimum(reach_a, np.where(close, reach_b[None, :], big).min(1))
            next_b = np.minimum(reach_b, np.where(close, next_a[:, None], big).min(0))
            if (next_a == reach_a).all() and (next_b == reach_b).all():
                break
            reach_a, reach_b = next_a, next_b
        out.append((ids[a], new @ weight[b], reach_a))
        if lo != hi:
            out.append((ids[b], weight[a] @ new, reach_b))
    parts = [np.concatenate(x).astype(np.int64) if out else np.zeros(0, dtype=np.int64) for x in (zip(*out) if out else ((), (), ()))]
    return pa.table({"id": parts[0], "links": parts[1], "root": parts[2]})


def vector_groups(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, trees: int = 4, leaf_rows: int = 1500, margin: float = 0.015, max_sample: int = 20_000, seed: int = 5) -> DataFrame:
    """One row per id: id, n_links (other vectors linked directly), component_id and kept (whether it is its component's smallest)."""
    spark = df.sparkSession
    scratch = Scratch(spark, "vectors")
    rows = valid_vectors(df.where(F.col(label_col).isNotNull()), id_col, vec_col, label_col)
    rows = rows.withColumnRenamed(label_col, "label").withColumns({"d1": F.xxhash64("label", "vec"), "d2": F.xxhash64(F.lit(1), "label", "vec")})
    rows = scratch.table(rows, "vectors")
    # equal vectors of a label are one row with a weight, known by 128 bits of hashes
    alone = rows.groupBy("d1", "d2").agg(F.min(F.struct("id", "vec", "label")).alias("r"), F.count("*").alias("weight")).select("r.*", "weight", "d1", "d2")
    alone = scratch.table(alone, "distinct")
    points, total = sample(alone, max_sample)
    points = points / np.linalg.norm(points, axis=1, keepdims=True) if len(points) else points
    forest = spark.sparkContext.broadcast(grow(points, total, trees, leaf_rows, margin, seed))

    def route(batch: pa.RecordBatch) -> dict | None:
        if not batch.num_rows:
            return None
        x = matrix(batch.column(2))
        found = forest.value.leaves(x / np.linalg.norm(x, axis=1, keepdims=True))
        own: list[list[int]] = [[] for _ in range(len(x))]
        for at, leaf in found:
            for i in at.tolist():
                own[i].append(leaf)
        every = np.repeat(np.arange(len(x)), [len(o) for o in own])
        taken = batch.take(pa.array(every))
        return {"leaf": [leaf for o in own for leaf in o], "leaves": [sorted(own[i]) for i in every.tolist()]} | {n: taken.column(i) for i, n in enumerate(("id", "weight", "vec", "label"))}

    kinds = dict(alone.dtypes)
    routed = arrow_map(alone.select("id", "weight", "vec", "label"), route, f"leaf long, leaves array<long>, id {kinds['id']}, weight long, vec {kinds['vec']}, label {kinds['label']}")
    routed = _split_large(scratch.table(routed, "routed"), leaf_rows, margin, seed, scratch)
    large = routed.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > 2 * leaf_rows)
    large = scratch.table(large.select(F.col("leaf").alias("_leaf"), F.ceil(F.col("n") / leaf_rows).cast("int").alias("_blocks")), "large")
    blocks = F.coalesce("_blocks", F.lit(1))
    dealt = routed.join(large, F.col("leaf") == F.col("_leaf"), "left").withColumn("side", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("leaf", F.least("side", "_other").alias("lo"), F.greatest("side", "_other").alias("hi"), "side", "id", "weight", "vec", "label", "leaves")
    found = dealt.groupBy("leaf", "lo", "hi").applyInArrow(lambda g: _compare(g, threshold), "id long, links long, root long")
    found = scratch.table(found, "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), scratch)
    labels = alone.select("id", "weight", "d1", "d2").join(links, "id", "left").join(groups, F.col("id") == F.col("node"), "left")
    labels = labels.select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    labels = scratch.table(labels, "labels")
    known = scratch.table(rows.select("id", "d1", "d2").join(labels, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2"))).select("id", "n_links", "component_id"), "known")
    every = df.select(F.col(id_col).alias("_own")).distinct()
    out = every.join(known, F.col("_own") == F.col("id"), "left").select(
        F.col("_own").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "_own").alias("component_id")
    )
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
