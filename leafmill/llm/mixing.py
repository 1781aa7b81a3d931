"""Mixing sources to target weights, in fixed-length blocks.

The words of each source, in the order of its documents' ids, are cut into blocks of
`block_words`, the last of them as short as what is left. The mix is a number of output shards
of equal size. For each shard, multinomial counts say how many block slots each source gets
there, drawn by what the source still lacks of its quota, so that all shards together bring every
source to its target. A source's slots run through its blocks by a keyed pseudorandom
permutation of the block indexes, epoch by epoch, and a shard's slots come in a permuted order
of their own. Slots meet blocks by a join on source and block index: that gives the mix as
(shard, position, piece of a document), from which counts by document, or their texts, are taken.

Sources are the components of a mix, and a table with a row for each of them is handled on the
driver: at most `max_sources`, more are an error. Shards are at most MAX_SHARDS (larger beyond).
Documents get their place in their source by range-partitioned prefix sums over ids and sizes
alone, which spread a source with a third of all rows; texts are stored with their number and shuffled once, to their
plan. Rows of one id stand in the order of a hash of all their columns, so the order of the input changes nothing.

Inputs with defined results: a null or empty text has size 0 and nothing taken; null is a
source of its own, last in order; a source without words has target 0; repeated rows are mixed
each; an empty table gives an empty table; the input's columns may have any names, and are kept
where documents are returned (one named `taken` is replaced) and ignored where counts are.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, MapType, StructField, StructType, VariantType

from .common import Scratch, arrow_map, bounded_batches, prefix_sums

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Slots of a shard where there are few shards, most shards, and slots that a row spells out at a time.
SHARD_SLOTS, MAX_SHARDS, RUN = 4096, 10_000, 1024


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0) -> list[float]:
    """Shares of the total by repeating weights, none above `most` times its size; the excess is shared again by weight."""
    total = float(sum(sizes))
    weight = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        share = left / sum(weight[i] for i in open_)
        full = [i for i in open_ if share * weight[i] > most * sizes[i]]
        for i in full or open_:
            out[i] = most * sizes[i] if full else share * weight[i]
        if not full:
            break
        left -= sum(out[i] for i in full)
        open_ -= set(full)
    return out


def draw_slots(quota: list[int], shards: int, seed: int) -> np.ndarray:
    """Block slots of each source by shard (shards x sources): multinomial by what each source still lacks of its quota."""
    left, rng = np.array(quota, dtype=np.int64), np.random.default_rng(seed)
    out = np.zeros((shards, len(left)), dtype=np.int64)
    for s in range(shards):
        n = -(-int(left.sum()) // (shards - s))
        while n and left.sum():
            drawn = np.minimum(rng.multinomial(n, left / left.sum()), left)
            out[s] += drawn
            left -= drawn
            n -= int(drawn.sum())
    return out


def permuted(index: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """The place of each index under a keyed permutation of range(n), or the index of each place: a four-round Feistel network, walked into the range."""
    if n <= 1:
        return np.zeros_like(index)
    half = (max(2, int(n - 1).bit_length()) + 1) // 2
    mask = np.uint64((1 << half) - 1)
    x = index.astype(np.uint64)
    todo = np.ones(len(x), dtype=bool)
    while todo.any():
        left, right = x[todo] >> np.uint64(half), x[todo] & mask
        for r in reversed(range(4)) if back else range(4):
            seen = left if back else right
            f = (seen + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            f = (f >> np.uint64(31)) & mask
            left, right = (right ^ f, left) if back else (right, left ^ f)
        x[todo] = (left << np.uint64(half)) | right
        todo &= x >= np.uint64(n)
    return x.astype(np.int64)


def _quota(aim: float, n: int, block: int, key: int) -> int:
    """The slots whose words come nearest to `aim`: whole epochs of n words, then blocks in permuted order, the last of which may be shorter."""
    if not n:
        return 0
    n_blocks = -(-n // block)
    epochs = int(aim / n + 1e-9)
    rest = max(0.0, aim - epochs * n)
    place, short = int(permuted(np.array([n_blocks - 1]), n_blocks, key, back=True)[0]), n_blocks * block - n
    some = range(int(rest / block), min(n_blocks, int(rest / block) + 2) + 1)
    return epochs * n_blocks + min(some, key=lambda k: abs(k * block - (short if k > place else 0) - rest))


def _key(seed: int, source: int) -> int:
    return seed * 1_000_003 + source


class _Plan:
    """Per source its number, name, size, target, block length and slots; and the slots of each shard by source."""

    def __init__(self, sums: list[tuple[str | None, int]], block_words: int, most: int, shards: int | None, seed: int):
        self.sources = sorted(sums, key=lambda x: (x[0] is None, str(x[0])))
        sizes = [n for _, n in self.sources]
        self.aims = targets(sizes, most=float(most))
        # small sources get smaller blocks, so that a block is under a thousandth of the target
        self.blocks = [max(1, min(block_words, int(a / 1000))) for a in self.aims]
        self.quota = [_quota(a, n, b, _key(seed, i)) for i, (a, b, n) in enumerate(zip(self.aims, self.blocks, sizes))]
        self.seed = seed
        self.draws = draw_slots(self.quota, shards or min(MAX_SHARDS, max(1, -(-sum(self.quota) // SHARD_SLOTS))), seed)

    def sources_table(self, spark) -> DataFrame:
        n = len(self.sources)
        columns = {"k": (range(n), pa.int32()), "name": ([s for s, _ in self.sources], pa.string()), "source_size": ([x for _, x in self.sources], pa.int64()), "target": (self.aims, pa.float64()), "block": (self.blocks, pa.int32())}
        # Arrow tables go to the JVM as they are; rows would start a second set of Python workers beside those of the maps
        return spark.createDataFrame(pa.table({c: pa.array(x, type=kind) for c, (x, kind) in columns.items()}))

    def slots(self, spark) -> DataFrame:
        """(k, block_no, shard, position, epoch): every slot of the mix and the block that stands there."""
        before = np.cumsum(self.draws, axis=0) - self.draws  # a source's slots in earlier shards
        inside = np.cumsum(self.draws, axis=1) - self.draws  # a shard's slots of earlier sources
        full = self.draws.sum(1)
        at = np.argwhere(self.draws)
        rows = pa.table({"shard": at[:, 0], "k": at[:, 1], "n": self.draws[tuple(at.T)], "first": before[tuple(at.T)], "place": inside[tuple(at.T)], "full": full[at[:, 0]]})
        runs = spark.createDataFrame(rows)
        runs = runs.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))))
        blocks = {i: (-(-n // b), _key(self.seed, i)) for i, ((_, n), b) in enumerate(zip(self.sources, self.blocks))}
        seed = self.seed

        def spell(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {c: [] for c in ("k", "block_no", "shard", "position", "epoch")}
            for r in batch.to_pylist():
                i = np.arange(r["from"], min(r["n"], r["from"] + RUN))
                n_blocks, key = blocks[r["k"]]
                epoch, rest = divmod(r["first"] + i, n_blocks)
                for c, x in zip(out, (np.full(len(i), r["k"]), permuted(rest, n_blocks, key), np.full(len(i), r["shard"]), permuted(r["place"] + i, r["full"], seed + 31 * r["shard"] + 17), epoch)):
                    out[c].append(x)
            return {c: np.concatenate([*x, np.zeros(0, np.int64)]) for c, x in out.items()}

        # as many partitions as shuffles have: one run may be a large part of the mix
        runs = runs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
        return arrow_map(runs, spell, "k int, block_no long, shard int, position long, epoch int")


def _numbered(df: DataFrame, id_col: str, text_col: str, source_col: str, kept: list[str] | None = None) -> DataFrame:
    """(row, h, id, source, size): a number for every row, to be stored, as it is another one each time; and a hash of the whole row, by which rows of one id come in an order of their own; with the columns `kept` as `document`."""
    whole = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
    return df.select(F.monotonically_increasing_id().alias("row"), F.xxhash64(*whole).alias("h"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *([F.struct(*[F.col(f"`{c}`") for c in kept]).alias("document")] if kept else []))


def _pieces(sized: DataFrame, source_col: str, scratch: Scratch, block_words: int, most: int, shards: int | None, max_sources: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """sized(row, h, id, source, size) to the mix's pieces (row, id, lo, hi, shard, position, epoch), and sources(k, name, ...)."""
    spark = sized.sparkSession
    sums = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(max_sources + 1).collect()
    if len(sums) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    plan = _Plan([(r[0], r["n"]) for r in sums], block_words, most, shards, seed)
    sources = plan.sources_table(spark)
    placed = prefix_sums(sized.where("size > 0"), ["source"], ["id", "h", "row"], "size", "at", scratch)
    placed = placed.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("name")))  # at most max_sources rows
    b = F.col("block").cast("long")
    first, last = F.floor(F.col("at") / b), F.floor((F.col("at") + F.col("size") - 1) / b)
    inside = placed.select("row", "id", "k", "at", "size", "block", F.explode(F.sequence(first, last)).alias("no"))
    start = F.col("no") * b - F.col("at")
    inside = inside.select("row", "id", F.col("k").alias("of_k"), "no", F.greatest(start, F.lit(0)).alias("lo"), F.least(start + b, F.col("size")).alias("hi"))
    # the slots grow with the words, though Spark takes them for as small as the runs that they are spelled out from: never broadcast
    slots = plan.slots(spark).hint("merge")
    joined = inside.join(slots, (F.col("of_k") == F.col("k")) & (F.col("no") == F.col("block_no")))
    return joined.select("row", "id", "lo", "hi", "shard", "position", "epoch"), sources


def mix_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = 256, most: int = 3, shards: int | None = None, max_sources: int = 100_000, seed: int = 7) -> DataFrame:
    """The mix itself: (shard, position, id, lo, hi, epoch), the words lo to hi of a document that stand in a slot; a slot holds one block, so pieces of documents that follow each other."""
    scratch = Scratch(df.sparkSession, "mix")
    sized = scratch.table(_numbered(df, id_col, text_col, source_col), "sizes")
    found, _ = _pieces(sized, source_col, scratch, block_words, most, shards, max_sources, seed)
    return found.select("shard", "position", F.col("id").alias(id_col), "lo", "hi", "epoch")


def mix_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = 256, most: int = 3, shards: int | None = None, max_sources: int = 100_000, seed: int = 7) -> DataFrame:
    """One row per input row: id, size, source_size, target (its source's), taken, the words that the mix takes, the slots that hold some of them, and the first of these by shard and position."""
    scratch = Scratch(df.sparkSession, "mix")
    sized = scratch.table(_numbered(df, id_col, text_col, source_col), "sizes")
    found, sources = _pieces(sized, source_col, scratch, block_words, most, shards, max_sources, seed)
    sums = found.groupBy("row").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"), F.count("*").alias("n_slots"), F.min(F.struct("shard", "position")).alias("first"))
    out = sized.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("name")))  # at most max_sources rows
    out = out.join(sums, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", zero("taken"), zero("n_slots"), F.col("first.shard").alias("first_shard"), F.col("first.position").alias("first_position"))


def _taken_text(text: str, pieces: list[dict]) -> str:
    """The taken runs of words in order, epoch after epoch, with the white space between them as it is; pieces come by epoch and place."""
    spans = [m.span() for m in _WORD.finditer(text)]
    out: list[str] = []
    run: list[int] | None = None
    for p in [*pieces, None]:
        if p and run and run[2] == p["epoch"] and run[1] == p["lo"]:
            run[1] = p["hi"]
            continue
        if run:
            out.append(text[spans[run[0]][0] : spans[run[1] - 1][1]])
        run = [p["lo"], p["hi"], p["epoch"]] if p else None
    return "\n".join(out)


def mix_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = 256, most: int = 3, shards: int | None = None, max_sources: int = 100_000, seed: int = 7) -> DataFrame:
    """The documents of the mix: those with words taken, their text the taken words (repeats after one another), and `taken`."""
    bounded_batches(df.sparkSession)
    scratch = Scratch(df.sparkSession, "mix")
    names = [c for c in df.columns if c != "taken"]
    stored = scratch.table(_numbered(df, id_col, text_col, source_col, names), "rows")
    found, _ = _pieces(stored.drop("document"), source_col, scratch, block_words, most, shards, max_sources, seed)
    # a document's own pieces: as many as it has blocks, times its epochs
    plan = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("epoch", "lo", "hi"))).alias("pieces"), F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    plan = scratch.table(plan, "plan")
    scratch.keep_only(plan, stored)
    # a row for each document, several times as large on the driver as in files: never broadcast
    joined = stored.join(plan.hint("merge"), "row")
    schema = StructType([*df.select(*names).schema.fields, StructField("taken", LongType())])
    at = names.index(text_col)

    def cut(batch: pa.RecordBatch) -> dict:
        rows, pieces = batch.column(0), batch.column(1)
        out = {n: rows.field(i) for i, n in enumerate(names)}
        return out | {text_col: [_taken_text(t.as_py(), p.as_py()) for t, p in zip(rows.field(at), pieces)], "taken": batch.column(2)}

    return arrow_map(joined.select("document", "pieces", "taken"), cut, schema)
