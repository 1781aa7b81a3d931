"""Units to semantic chunks: table islands, sections, greedy packing, orphan merging.

Everything is keyed by document: one shuffle on doc_id serves the windows, and the fold that
packs sizes sees one segment's sizes at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text as T
from ..sources.shared import spread

ROOT = "Document Root"


def table_islands(units: DataFrame) -> DataFrame:
    """Adds `ord`, and `island`, one number for a run of tables and for every other unit."""
    doc = Window.partitionBy("doc_id").orderBy("page_number", "uid", "content")  # content only settles equal uids
    # each sort and window of the steps that follow holds a partition of these
    u = spread(units, "doc_id").withColumn("ord", F.row_number().over(doc))
    is_table = F.col("unit_type") == "table"
    joins = is_table & F.coalesce(F.lag("unit_type").over(doc) == "table", F.lit(False))
    return u.withColumn("_start", (~joins).cast("int")).withColumn("island", F.sum("_start").over(doc)).drop("_start")


def _style(raw: Column, *names: str) -> Column:
    """The first of the named values at the top level of a JSON object; null elsewhere."""
    return F.coalesce(*[F.get_json_object(F.when(F.trim(raw).rlike(r"(?s)^\{.*\}$"), raw), f"$.{n}") for n in names])


def styled_heading(raw: Column, config: Config) -> Column:
    """Whether a unit's own style, as its raw content says, is that of a heading: large, and bold or heavy."""
    size, weight, bold = (_style(raw, *names) for names in (("font_size", "size"), ("font_weight", "weight"), ("bold", "is_bold")))
    is_bold = bold.isNotNull() & ~F.lower(bold).isin("false", "0", "0.0", "")
    return F.coalesce((size.try_cast("double") >= config.min_font) & (F.coalesce(is_bold, F.lit(False)) | F.coalesce(weight.try_cast("double") >= config.bold_weight, F.lit(False))), F.lit(False))


def _static_boundary(units: DataFrame, config: Config) -> Column:
    """Header units, styled headings (by content_raw where units have it), and texts with a marker."""
    text = F.col("content")
    marked = F.lit(False)
    for m in config.markers:
        marked = marked | F.lower(text).contains(m.lower())
    return (F.col("unit_type") == "header") | styled_heading(F.col("content_raw") if "content_raw" in units.columns else text, config) | marked


def sections(units: DataFrame, config: Config) -> DataFrame:
    """Adds `section` and `is_boundary`; tables take the section before them and are no boundary."""
    u = table_islands(units)
    is_table = F.col("unit_type") == "table"
    text = F.trim("content")
    doc = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("_static", ~is_table & _static_boundary(u, config))
    candidate = F.col("_static") | (~is_table & text.startswith("#"))
    u = u.withColumn("section", F.coalesce(F.last(F.when(candidate, F.left(text, F.lit(200))), ignorenulls=True).over(doc), F.lit(ROOT)))
    before = F.coalesce(F.lag("section").over(Window.partitionBy("doc_id").orderBy("ord")), F.lit(ROOT))
    return u.withColumn("is_boundary", F.col("_static") | (~is_table & text.startswith("#") & (text != before))).drop("_static")


def merge_boxes(boxes: Column) -> Column:
    """Boxes (page_number, x1, y1, x2, y2) as one box a page, by page."""
    pages = F.array_sort(F.array_distinct(F.transform(boxes, lambda b: b["page_number"])))

    def of_page(page: Column) -> Column:
        own = F.filter(boxes, lambda b: b["page_number"].eqNullSafe(page))
        side = lambda name, pick: pick(F.transform(own, lambda b: b[name])).alias(name)
        return F.struct(page.alias("page_number"), side("x1", F.array_min), side("y1", F.array_min), side("x2", F.array_max), side("y2", F.array_max))

    return F.transform(pages, of_page)


def atomic_units(units: DataFrame, config: Config) -> DataFrame:
    """One row per island: joined content, pages, box, box of each page, section; blank ones go; long texts are split into `piece`s, each with the island's boxes."""
    u = sections(units, config).withColumn("_box", F.struct("page_number", "x1", "y1", "x2", "y2"))
    a = u.groupBy("doc_id", "island").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "content"))), lambda x: F.trim(x["content"])), "\n\n").alias("content"),
        F.array_sort(F.collect_set("page_number")).alias("pages"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
        F.min("section").alias("section"), F.max("is_boundary").alias("is_boundary"), F.max("unit_type").alias("unit_type"), merge_boxes(F.collect_list("_box")).alias("boxes"),
    )
    a = a.where(F.trim("content") != "").withColumn("_words", T.words(F.col("content")))
    n = F.size("_words")
    long = (n > config.max_chunk) & (F.col("unit_type") != "table")
    cuts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / config.max_chunk).cast("int")), lambda i: F.array_join(F.slice("_words", i * config.max_chunk + 1, F.lit(config.max_chunk)), " "))
    a = a.select("*", long.alias("_long"), F.posexplode(F.when(long, cuts).otherwise(F.array("content"))).alias("piece", "text"))
    return a.withColumn("is_boundary", F.col("is_boundary") & ~F.col("_long")).withColumn("tokens", T.token_count(F.col("text"))).drop("content", "_words", "_long")


def _pack_starts(sizes: Column, cap: int) -> Column:
    """Where packs start in an array of sizes: at 0, and wherever the next size would bring the pack over the cap."""
    zero = F.lit(0)
    start = F.struct(F.array().cast("array<int>").alias("starts"), zero.alias("held"), zero.alias("i"))

    def step(acc: Column, size: Column) -> Column:
        opens = (acc["i"] == 0) | (acc["held"] + size > cap)
        return F.struct(F.when(opens, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"]).alias("starts"), F.when(opens, size).otherwise(acc["held"] + size).alias("held"), (acc["i"] + 1).alias("i"))

    return F.aggregate(sizes, start, step, lambda acc: acc["starts"])


def pack(units: DataFrame, config: Config) -> DataFrame:
    """Chunks: boundaries start a segment, and a segment's units are packed greedily up to the size limit.

    The fold runs inside the segment's row; packs are slices of its units.
    """
    a = atomic_units(units, config)
    doc = Window.partitionBy("doc_id").orderBy("island", "piece").rowsBetween(Window.unboundedPreceding, 0)
    a = a.withColumn("segment", F.sum(F.col("is_boundary").cast("int")).over(doc))
    row = F.struct("island", "piece", "tokens", "text", "pages", "x1", "y1", "x2", "y2", "section", "boxes")
    s = a.groupBy("doc_id", "segment").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    s = s.withColumn("starts", _pack_starts(F.transform("rows", lambda r: r["tokens"]), config.max_chunk))
    s = s.select("doc_id", "segment", "rows", "starts", F.posexplode("starts").alias("pack", "start"))
    following = F.coalesce(F.get("starts", F.col("pack") + 1), F.size("rows"))
    s = s.select("doc_id", "segment", "pack", F.slice("rows", F.col("start") + 1, following - F.col("start")).alias("part"))
    all_of = lambda name: F.transform("part", lambda r: r[name])
    c = s.select(
        "doc_id", "segment", "pack", F.array_join(all_of("text"), "\n\n").alias("content"), F.array_sort(F.array_distinct(F.flatten(all_of("pages")))).alias("pages"),
        F.array_min(all_of("x1")).alias("x1"), F.array_min(all_of("y1")).alias("y1"), F.array_max(all_of("x2")).alias("x2"), F.array_max(all_of("y2")).alias("y2"),
        F.col("part")[0]["section"].alias("section"), F.aggregate(all_of("tokens"), F.lit(0), lambda x, y: x + y).alias("tokens"),
        merge_boxes(F.flatten(all_of("boxes"))).alias("boxes"),
    )
    return c.withColumn("chunk_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("segment", "pack")))


def merge_orphans(chunks: DataFrame, config: Config) -> DataFrame:
    """Chunks below the minimum join the next one, pair by pair; the last chunk of a document never starts a merge.

    In a run of orphans every second one is taken by the one before it, and a run of odd length
    takes the chunk after it: merges follow from positions in runs, without a fold.
    """
    doc = Window.partitionBy("doc_id").orderBy("chunk_no")
    whole = Window.partitionBy("doc_id")
    c = chunks.withColumn("_orphan", (F.col("tokens") < config.min_chunk) & (F.col("chunk_no") < F.max("chunk_no").over(whole)))
    turn = F.coalesce(F.lag("_orphan").over(doc) != F.col("_orphan"), F.lit(True)).cast("int")
    c = c.withColumn("_turn", turn).withColumn("_run", F.sum("_turn").over(doc))
    run = Window.partitionBy("doc_id", "_run").orderBy("chunk_no")
    c = c.withColumn("_pos", F.row_number().over(run) - 1)
    odd_orphan = F.col("_orphan") & (F.col("_pos") % 2 == 1)
    after_odd = ~F.col("_orphan") & (F.col("_pos") == 0) & F.coalesce(F.lag("_orphan").over(doc) & (F.lag("_pos").over(doc) % 2 == 0), F.lit(False))
    c = c.withColumn("merged_no", F.when(odd_orphan | after_odd, F.col("chunk_no") - 1).otherwise(F.col("chunk_no")))
    m = c.groupBy("doc_id", "merged_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "content"))), lambda x: x["content"]), "\n\n").alias("content"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
        F.min_by("section", "chunk_no").alias("section"), F.sum("tokens").cast("int").alias("tokens"), F.count("*").alias("parts"), merge_boxes(F.flatten(F.collect_list("boxes"))).alias("boxes"),
    )
    return m.withColumn("content_hash", T.content_hash(F.col("content"), F.col("pages")[0], F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))


def chunk_boxes(chunks: DataFrame) -> DataFrame:
    """A row for each chunk and page that it stands on, with its box there."""
    return chunks.select("doc_id", "merged_no", F.explode("boxes").alias("b")).select("doc_id", "merged_no", "b.*")


def page_index(chunks: DataFrame) -> DataFrame:
    """Chunks of each page, and the box around what they have there."""
    p = chunk_boxes(chunks)
    return p.groupBy("doc_id", "page_number").agg(F.count("*").alias("chunks"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
