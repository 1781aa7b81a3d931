"""Line dedup by the distinct-site spread of lines.

A line that stands on many sites is boilerplate. Lines are keyed by 128 bits of hashes, so that
no text is shuffled; those with too few occurrences to be on `min_sites` sites drop out by a
combining count; for the rest HyperLogLog sketches of their sites merge by aggregation. Where
the estimate is within the sketch's error of the threshold, sites are counted exactly. A
boilerplate line stays once, in its first place (smallest id, then position), so that content
which every site copied whole isn't lost.

Inputs with defined results: a null text stays null; blank lines are never boilerplate; a null
site counts as one site of its own; a text all of whose lines go becomes empty; rows of
one id are told apart by their texts, and repeated rows are treated alike; an empty table
gives an empty table; all columns of the input are kept, whatever their names, but for one named
`lines_removed`, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Sketch size (2^10 registers) and the half-width of the band that is counted exactly: over 3 standard errors.
LG_K, BAND = 10, 0.15


def _lines(docs: DataFrame) -> DataFrame:
    """(h1, h2, id, doc, pos, site) of the non-blank lines without their outer spaces; the text itself isn't shuffled."""
    lines = docs.select("id", F.xxhash64("text").alias("doc"), F.xxhash64("site").alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    line = F.trim("raw")
    return lines.where(line != "").select(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"), "id", "doc", "pos", "site")


def spread_lines(docs: DataFrame, scratch: Scratch, min_sites: int) -> tuple[DataFrame, DataFrame]:
    """Of docs(id, text, site): the lines on at least `min_sites` distinct sites as (s1, s2, sites, first place), and where all often-seen lines stand."""
    lines = _lines(docs)
    often = lines.groupBy("h1").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites)
    often = scratch.table(often.select(F.col("h1").alias("o1")), "often")
    placed = scratch.table(lines.join(often, F.col("h1") == F.col("o1")).drop("o1"), "placed")
    sketches = placed.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min(F.struct("id", "doc", "pos")).alias("first"))
    estimated = scratch.table(sketches.select(F.col("h1").alias("s1"), F.col("h2").alias("s2"), "first", F.hll_sketch_estimate("sketch").cast("double").alias("estimate")), "spread")
    near = F.col("estimate").between(min_sites * (1 - BAND) - 1, min_sites * (1 + BAND) + 1)
    same = (F.col("h1") == F.col("s1")) & (F.col("h2") == F.col("s2"))
    counted = placed.groupBy("h1", "h2", "site").agg(F.lit(1).alias("one")).join(estimated.where(near).select("s1", "s2"), same, "left_semi")
    counted = counted.groupBy("h1", "h2").agg(F.count("*").cast("double").alias("exact"))
    both = estimated.join(counted, same, "left").withColumn("sites", F.coalesce("exact", "estimate"))
    found = scratch.table(both.where(F.col("sites") >= min_sites).select("s1", "s2", F.round("sites").cast("long").alias("sites"), "first"), "boilerplate")
    scratch.drop(often, estimated)
    return found, placed


def remove_spread_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 5) -> DataFrame:
    """The input with boilerplate lines removed from `text_col`, and `lines_removed`, their number, added or replaced."""
    names = [c for c in df.columns if c != "lines_removed"]
    scratch = Scratch(df.sparkSession, "lines")
    spread, placed = spread_lines(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(site_col).alias("site")), scratch, min_sites)
    hits = placed.join(spread, (F.col("h1") == F.col("s1")) & (F.col("h2") == F.col("s2")))
    first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("doc") == F.col("first.doc")) & (F.col("pos") == F.col("first.pos"))
    # the positions of one document: at most as many as it has lines
    gone = scratch.table(hits.where(~first).groupBy("id", "doc").agg(F.collect_set("pos").alias("gone")), "removed")
    scratch.keep_only(gone)
    # the caller's columns travel in one struct, so that no name clashes
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(id_col).alias("own_id"), F.xxhash64(text_col).alias("own_doc"))
    joined = rows.join(gone, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_doc") == F.col("doc")), "left")
    whole = F.col("row")[text_col]
    kept = F.array_join(F.filter(F.split(whole, "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(F.col("gone").isNull(), whole).otherwise(kept)
    removed = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long")
    return joined.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names], removed.alias("lines_removed"))
