"""Near-duplicate texts by the similarity of their shingle sets: SimHash balls first, an exact prefix filter for the rest.

Two texts are linked where the Jaccard similarity of their sets of five-word shingles reaches
the threshold. Candidates come from two searches, and all are verified on the sets:

* SimHash: texts whose fingerprints meet in a ball (see simhash.near_pairs), or are equal.
* A prefix filter, since fingerprints alone lose pairs: in one order of all shingles, two sets of
  that similarity share a shingle among the first n - ceil(similarity * n) + 1 of each. Any order
  finds every pair; shingles that are common over all texts come last, so that few texts meet.

A bucket's texts are first compared with one of them, its centre. In buckets that then still hold
texts of several components, those outside the largest are compared with all the others. So
groups of near copies cost what their texts do, however large they are. Shingles known to be
common have their centres found by a combining aggregation, the others by a window, whose
groups are small for that reason.

Before any set is written, candidate pairs have to pass exact bounds: sets of that similarity
differ in few shingles, so their sizes and the parities of their counts by hash value do too.

Tables with a row for each text, pair or bucket are merged, never broadcast: Spark decides by the
size of compressed files, and the driver would hold several times as much. Broadcast are bitmaps of fixed size and at most
MOST common shingles with their centres.

Inputs with defined results: a null text counts as empty, and texts without words are copies of
one another; texts shorter than a shingle have one shingle, their words; repeated rows are copies;
rows of one id are one node with several texts; rows with a null id have no component; an empty table gives an empty table; other columns of the
input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, bounded_batches, connected_components, maybe_in, without
from .simhash import fingerprint_of, near_pairs, shingle_hashes

#: Shingles that a task counts at a time, keeps, and hands over; and how many common ones there are at most.
SLICE, KEEP, HAND_OVER, MOST = 1 << 18, 1 << 19, 1 << 15, 1 << 18
#: Texts with a shingle from which on its bucket counts as hot.
HOT = 256


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The distinct hashes of each text's runs of `words` words, ascending."""
    for t in texts:
        yield np.unique(np.array(shingle_hashes(t.as_py(), words), dtype=np.uint64))


def common_shingles(df: DataFrame, text_col: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that most texts have, ascending, and in how many they were seen.

    Each task goes through all its texts and keeps the counts of at most KEEP shingles, dropping
    the rarer half when there are more; the counts of all tasks are added up. They decide
    nothing but the order of shingles, on which the time depends and no result does.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []
        waiting = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            found, at = np.unique(np.concatenate([known, *held]), return_inverse=True)
            n = np.bincount(at, np.concatenate([seen, np.ones(len(at) - len(seen), np.int64)]), len(found)).astype(np.int64)
            if len(found) > KEEP:
                top = np.sort(np.argpartition(-n, KEEP // 2)[: KEEP // 2])
                found, n = found[top], n[top]
            return found, n

        for batch in batches:
            for h in shingle_sets(batch.column(0), words):
                held.append(h)
                waiting += len(h)
                if waiting > SLICE:
                    known, seen = merged()
                    held.clear()
                    waiting = 0
        known, seen = merged()
        often = np.flatnonzero(seen > 1)
        if len(often) > HAND_OVER:
            often = often[np.argpartition(-seen[often], HAND_OVER)[:HAND_OVER]]
        yield pa.RecordBatch.from_arrays([pa.array(known[often].view(np.int64)), pa.array(seen[often])], names=["shingle", "n"])

    found = df.select(text_col).mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    counts = found.where("n > 2").orderBy(F.desc("n"), "shingle").limit(MOST).toArrow()  # at most MOST rows
    known = counts["shingle"].to_numpy().view(np.uint64)
    order = np.argsort(known)
    return known[order], counts["n"].to_numpy()[order]


def _parities(h: np.ndarray) -> np.ndarray:
    """Parity of the number of hashes by their low bits, as longs: 256 values, twice as many as often as sets of that size need."""
    bits = 256
    while len(h) > bits * 25 // 16:
        bits *= 2
    return np.packbits(np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).view(np.int64)


def _prefixes(df: DataFrame, id_col: str, text_col: str, similarity: float, words: int) -> DataFrame:
    """(id, words, check, n, o0 to o3, sketch, fp, prefix, hot): hashes of the words in order, the set's size, parities and fingerprint, and the shingles by which it meets others."""
    common = df.sparkSession.sparkContext.broadcast(common_shingles(df, text_col, words))

    def prefix(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, counts = common.value
        seen = np.zeros(len(h), dtype=np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            seen = np.where(known[at] == h, counts[at], 0)
        first = np.lexsort((h, seen))[: len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1]
        own, hot = h[first].view(np.int64), seen[first] >= HOT
        return own[~hot], own[hot]

    def prints(batch: pa.RecordBatch) -> dict:
        from xxhash import xxh64_intdigest

        rows = []
        for t, h in zip(batch.column(1), shingle_sets(batch.column(1), words)):
            joined = b" ".join((t.as_py() or "").encode("utf-8", "surrogatepass").lower().split())
            sketch = _parities(h)
            rows.append((xxh64_intdigest(joined, 7), xxh64_intdigest(joined, 8), len(h), np.bitwise_xor.reduce(sketch.reshape(-1, 4)), sketch, fingerprint_of(h), *prefix(h)))
        both, check, n, folded, sketch, fp, own, hot = zip(*rows) if rows else [()] * 8
        signed = lambda x: np.array(x, dtype=np.uint64).view(np.int64)
        table = np.array(folded, dtype=np.int64).reshape(-1, 4)
        out = {"id": batch.column(0), "words": signed(both), "check": signed(check), "n": n, "sketch": sketch, "fp": signed(fp), "prefix": own, "hot": hot}
        return out | {f"o{i}": table[:, i] for i in range(4)}

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, words long, check long, n long, o0 long, o1 long, o2 long, o3 long, sketch array<long>, fp long, prefix array<long>, hot array<long>"
    return arrow_map(df.select(id_col, text_col), prints, schema)


def _buckets(nodes: DataFrame) -> DataFrame:
    """(variant, node, centre): for each shingle in the prefixes of at least two nodes, these nodes and one of them."""
    least = F.min(F.struct(F.xxhash64("node").alias("h"), "node"))
    one = Window.partitionBy("variant")
    cold = nodes.select("node", F.explode("prefix").alias("variant"))
    cold = cold.select("variant", "node", F.count("*").over(one).alias("n"), least.over(one)["node"].alias("centre")).where("n > 1")
    hot = nodes.select("node", F.explode("hot").alias("variant"))
    centres = hot.groupBy("variant").agg(F.count("*").alias("n"), least["node"].alias("centre")).where("n > 1").select(F.col("variant").alias("v"), "centre")
    # a row for each common shingle: MOST at most
    hot = hot.join(F.broadcast(centres), F.col("variant") == F.col("v"))
    return cold.select("variant", "node", "centre").unionAll(hot.select("variant", "node", "centre"))


def _fold(longer: str, shorter: str) -> Column:
    """Parities by twice as many values as parities by as many."""
    half = F.size(shorter)
    return F.when(F.size(longer) > half, F.zip_with(F.slice(longer, F.lit(1), half), F.slice(longer, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(longer))


class _Search:
    """What the steps of similar_groups share."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, similarity: float, words: int):
        self.texts, self.similarity, self.words = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), similarity, words
        self.scratch = Scratch(df.sparkSession, "similar")
        self.kind = df.schema[id_col].dataType.simpleString()
        self.known: DataFrame | None = None

    def within(self, differ: Column, a: str, b: str) -> Column:
        """Whether sets of the similarity, of these sizes, may differ in so many shingles."""
        return differ <= (F.col(f"{a}n") + F.col(f"{b}n")) * F.lit((1 - self.similarity) / (1 + self.similarity)) + F.lit(1e-6)

    def alike(self, a: str, b: str) -> Column:
        differ = sum((F.bit_count(F.col(f"{a}o{i}").bitwiseXOR(F.col(f"{b}o{i}"))) for i in range(4)), F.lit(0))
        return self.within(F.abs(F.col(f"{a}n") - F.col(f"{b}n")), a, b) & self.within(differ, a, b)

    def wanted_texts(self, pairs: DataFrame) -> DataFrame:
        """The texts of nodes in pairs. A bitmap of fixed size thins them out, so that few others are shuffled to the join."""
        nodes = self.scratch.table(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted")
        thin = maybe_in(self.texts, "id", nodes).where("maybe")
        return thin.join(nodes.hint("merge"), F.col("id") == F.col("node"), "left_semi").select("id", "text")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of nodes whose shingle sets have the similarity."""
        scratch = self.scratch
        for side in "ab":
            pairs = pairs.join(self.known.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("n", "o0", "o1", "o2", "o3", "sketch")]).hint("merge"), side)
        differ = F.aggregate(F.zip_with(_fold("a_sketch", "b_sketch"), _fold("b_sketch", "a_sketch"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        near = scratch.table(pairs.where(self.alike("a_", "b_")).where(self.within(differ, "a_", "b_")).select("a", "b"), "near")

        words = self.words

        def sets_of(batch: pa.RecordBatch) -> dict:
            return {"node": batch.column(0), "shingles": [h.view(np.int64) for h in shingle_sets(batch.column(1), words)]}

        sets = scratch.table(arrow_map(self.wanted_texts(near), sets_of, f"node {self.kind}, shingles array<long>"), "sets")
        a, b = (sets.select(F.col("node").alias(side), F.col("shingles").alias(f"s{side}")) for side in "ab")
        shared = F.size(F.array_intersect("sa", "sb"))
        found = near.join(a.hint("merge"), "a").join(b.hint("merge"), "b").where(shared / (F.size("sa") + F.size("sb") - shared) >= self.similarity)
        found = scratch.table(found.select("a", "b"), "links")
        scratch.drop(near, sets)
        return found


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _ball_pairs(nodes: DataFrame, scratch: Scratch, radius: int) -> DataFrame:
    """Pairs of nodes whose fingerprints are equal, or within the radius for the first nodes of each."""
    first = scratch.table(nodes.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    same = nodes.select("fp", "node").join(first.hint("merge"), "fp").where("node != first").select(*_ordered("node", "first"))
    met = scratch.table(near_pairs(first, radius).withColumnsRenamed({"a": "fa", "b": "fb"}), "met")
    x, y = (first.select(F.col("fp").alias(fp), F.col("first").alias(node)).hint("merge") for fp, node in (("fa", "x"), ("fb", "y")))
    near = met.join(x, "fa").join(y, "fb")
    return same.unionAll(near.select(*_ordered("x", "y")))


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, words: int = 5, radius: int = 3) -> DataFrame:
    """One row per input row: id and component_id, the smallest id reachable by links between texts whose sets of
    `words`-word shingles have at least that Jaccard similarity. Texts of the same words are one node."""
    bounded_batches(df.sparkSession)
    search = _Search(df, id_col, text_col, similarity, words)
    scratch = search.scratch
    prints = scratch.table(_prefixes(search.texts, "id", "text", similarity, words), "prefixes")
    marks = ["n", "o0", "o1", "o2", "o3", "sketch"]
    nodes = prints.where("id IS NOT NULL").groupBy("words", "check").agg(F.min(F.struct("id", *marks, "fp", "prefix", "hot")).alias("x"))
    nodes = scratch.table(nodes.select("words", "check", F.col("x.id").alias("node"), *[f"x.{m}" for m in marks], "x.fp", "x.prefix", "x.hot"), "nodes")
    rows = scratch.table(prints.select("id", "words", "check"), "rows")
    scratch.drop(prints)
    search.known = scratch.table(nodes.select("words", "check", "node", *marks, "fp"), "known")
    buckets = scratch.table(_buckets(nodes), "buckets")
    scratch.drop(nodes)
    pairs = buckets.where("node != centre").select(*_ordered("node", "centre")).unionAll(_ball_pairs(search.known, scratch, radius))
    links = search.linked(scratch.table(pairs.distinct(), "pairs"))
    part = connected_components(links, scratch)
    placed = scratch.table(buckets.join(part.hint("merge"), "node", "left").select("variant", "node", F.coalesce("component", "node").alias("component")), "placed")
    scratch.drop(buckets, part)
    largest = placed.groupBy("variant", "component").agg(F.count("*").alias("k")).groupBy("variant").agg(F.max(F.struct("k", "component"))["component"].alias("main"), F.count("*").alias("parts"))
    mixed = scratch.table(largest.where("parts > 1").select("variant", "main"), "mixed")
    members = placed.join(mixed.hint("merge"), "variant").join(search.known.select("node", *marks[:-1]).hint("merge"), "node")
    members = scratch.table(members, "members")
    scratch.drop(placed, mixed)
    a, b = (members.select(F.col("variant").alias(f"{side}_variant"), *[F.col(c).alias(f"{side}_{c}") for c in ("node", "component", "main", *marks[:-1])]) for side in "ab")
    a = a.where("a_component != a_main")
    apart = (F.col("a_variant") == F.col("b_variant")) & (F.col("a_component") != F.col("b_component")) & ((F.col("b_component") == F.col("b_main")) | (F.col("a_node") < F.col("b_node")))
    rest = a.join(b.hint("merge"), apart & search.alike("a_", "b_")).select(*_ordered("a_node", "b_node")).distinct()
    links = links.unionByName(search.linked(scratch.table(rest, "rest")))
    part = connected_components(links, scratch)
    named = search.known.join(part.hint("merge"), "node", "left").select(F.col("words").alias("w"), F.col("check").alias("c"), F.coalesce("component", "node").alias("component_id"))
    out = rows.join(named.hint("merge"), (F.col("words") == F.col("w")) & (F.col("check") == F.col("c")), "left")
    out = scratch.table(out.select(F.col("id").alias(id_col), F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id")), "groups")
    scratch.keep_only(out)
    return out


def without_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, words: int = 5) -> DataFrame:
    """The rows of df without those of a group of similar texts other than the one with the smallest id.

    Rows with a null id name no group and stay; of rows with one id all stay if one of them is its
    group's first.
    """
    scratch = Scratch(df.sparkSession, "copies")
    groups = similar_groups(df, id_col, text_col, similarity, words).select(F.col(id_col).alias("id"), "component_id")
    gone = groups.where("id IS NOT NULL").groupBy("id").agg(F.max(F.col("id") == F.col("component_id")).alias("first")).where("NOT first").select("id")
    return without(df, id_col, scratch.table(gone, "gone"))
