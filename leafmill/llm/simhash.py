"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints of at most r differing bits differ in at most r // 2 bits of one of their
32-bit halves. So each fingerprint emits, for each half, all variants within r // 2 bits
(its ball); variants meet the halves that other fingerprints have themselves, and colliding
pairs are verified on all 64 bits. The search is exact. Balls over all 64 bits would need
2,081 + 65 rows a fingerprint for r = 3 in place of 66 + 2.

Copies with one fingerprint are one row during the search, so that groups of them cost
nothing, and a fingerprint has no more than the 43,744 others of a 3-bit ball as partners:
links stay in proportion to the fingerprints however large a group is.

Inputs with defined results: a null text counts as empty; texts without words have the zero
fingerprint and link with each other; repeated rows are copies; an empty table gives an empty
table; rows with a null id keep their row and never name a component unless alone; other
columns of the input are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, connected_components

#: Hash values that a worker turns into bits at a time.
BLOCK = 1 << 18


def shingle_hashes(text: str | None, shingle: int) -> list[int]:
    """XXH64 (seed 42) of each run of `shingle` words; of the whole sequence where it is shorter."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    if len(words) <= shingle:
        return [xxh64_intdigest(b" ".join(words), 42)]
    joined, starts, at = b" ".join(words), [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = [s - 1 for s in starts[shingle:]] + [len(joined)]
    return [xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts, ends)]


def fingerprint_of(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes; 0 without hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), BLOCK):
        rows = np.ascontiguousarray(hashes[i : i + BLOCK]).astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(rows, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the 64-bit fingerprint of each whole text as a signed long."""

    def prints(batch: pa.RecordBatch) -> dict:
        texts = batch.column(1)
        found = [fingerprint_of(np.array(shingle_hashes(t.as_py(), shingle), dtype=np.uint64)) for t in texts]
        return {id_col: batch.column(0), "fp": np.array(found, dtype=np.uint64).view(np.int64)}

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(id_col, text_col), prints, f"`{id_col}` {kind}, fp long")


def near_pairs(prints: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b), a < b: the pairs of distinct fingerprints in `fp` that differ in at most `radius` bits."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    masks = [sum(1 << i for i in bits) for n in range(radius // 2 + 1) for bits in combinations(range(32), n)]
    ball = F.array(*[F.lit(m).cast("long") for m in masks])
    side = F.lit(1 << 32)  # tells the halves apart
    own = prints.select(F.col("fp").alias("a"), F.explode(F.array(low, high.bitwiseOR(side))).alias("variant"))
    variants = prints.select(
        F.col("fp").alias("b"),
        F.explode(F.concat(F.transform(ball, lambda m: low.bitwiseXOR(m)), F.transform(ball, lambda m: high.bitwiseXOR(m).bitwiseOR(side)))).alias("variant"),
    )
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    # Spark takes the variants for as small as the fingerprints that they are spelled out from: never broadcast
    return own.hint("merge").join(variants.hint("merge"), (own["variant"] == variants["variant"]) & close).select("a", "b").distinct()


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row per input row: id, fp, fingerprint (16 hex digits) and component_id, the smallest id reachable by links."""
    scratch = Scratch(df.sparkSession, "simhash")
    prints = scratch.table(fingerprints(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text", shingle), "fingerprints")
    first = scratch.table(prints.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    found = connected_components(near_pairs(first, radius), scratch)
    named = scratch.table(first.join(found, first["fp"] == found["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("part")), "named")
    lowest = scratch.table(named.groupBy("part").agg(F.min("first").alias("component_id")), "lowest")
    labels = scratch.table(named.join(lowest, "part").select(F.col("fp").alias("of_fp"), "component_id"), "labels")
    scratch.drop(first, found, named, lowest)
    out = prints.join(labels, prints["fp"] == labels["of_fp"], "left")
    return out.select(F.col("id").alias(id_col), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "id").alias("component_id"))
