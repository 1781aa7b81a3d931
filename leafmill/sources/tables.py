"""Inputs of the engine from the supplied tables: pages, units, chunks, attempts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def binary_pages(spark: SparkSession, path: str) -> DataFrame:
    """PDF files of a folder by name, for a parser plugged in through mapInPandas."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "length", "content")


def parse_files(files: DataFrame, parser: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Files through a plugged-in parser, batch by batch; `parser` yields rows of `schema` (pages, pieces or units)."""
    return files.mapInPandas(parser, schema)


def refined_units(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """Units of refined documents' JSON lines; lines that are no object have no units."""
    docs = spark.read.option("pathGlobFilter", pattern).schema("file_id string, units array<struct<page_number int, uid string, unit_type string, content string>>").json(path)
    return docs.select("file_id", F.explode("units").alias("unit")).select("file_id", "unit.*")


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five lines of a document are a page; its geometry follows from its number. No shuffle."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    n = F.ceil(F.size("lines") / 5).cast("int")
    pages = docs.where("lines IS NOT NULL").select("doc_id", "lines", F.explode(F.sequence(F.lit(1), n)).alias("page_number"))
    d, p = F.col("doc_id"), F.col("page_number")
    scan = (d * 7 + p * 3) % 11 < 3
    wide = (d + p) % 13 == 0
    joined = F.array_join(F.slice("lines", (p - 1) * 5 + 1, F.lit(5)), "\n")
    return pages.select(
        "doc_id", "page_number",
        F.when(scan, F.lit("")).otherwise(joined).alias("text"),
        F.when(wide, 792).otherwise(612).alias("width"),
        F.when(wide, 612).otherwise(792).alias("height"),
        ((d * 31 + p * 17) % 67).cast("int").alias("rect_count"),
        F.when(scan | ((d * 13 + p * 5) % 6 == 0), 1).otherwise(0).alias("image_count"),
    )


def line_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each non-blank line of a page is a text unit."""
    lines = doc_pages(spark, sf_dir).select("doc_id", "page_number", F.posexplode(F.split("text", "\n")).alias("n", "content"))
    lines = lines.where(F.trim("content") != "")
    box = [F.lit(v).cast("double").alias(k) for k, v in (("x1", 0), ("y1", 0), ("x2", 1), ("y2", 1))]
    return lines.select("doc_id", "page_number", F.concat(F.lit("p"), "page_number", F.lit("_"), "n").alias("uid"), F.lit("text").alias("unit_type"), "content", *box)


def order_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a document: a header, a text, and one table unit per line item."""
    orders = table(spark, sf_dir, "orders")
    head = orders.select(F.col("o_orderkey").alias("doc_id"), F.lit("a").alias("uid"), F.lit("header").alias("unit_type"), F.concat(F.lit("Order "), "o_orderkey").alias("content"), F.lit(0).alias("n"))
    text = orders.select(F.col("o_orderkey").alias("doc_id"), F.lit("b").alias("uid"), F.lit("text").alias("unit_type"), F.concat_ws(" ", F.lit("Status"), "o_orderstatus", F.lit("priority"), "o_orderpriority").alias("content"), F.lit(0).alias("n"))
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("c"), "l_linenumber").alias("uid"), F.lit("table").alias("unit_type"),
        F.concat(F.lit("| "), "l_partkey", F.lit(" | "), F.col("l_quantity").cast("long"), F.lit(" |")).alias("content"), F.col("l_linenumber").alias("n"),
    )
    box = [F.lit(0.0).alias("x1"), (F.col("n") * 0.125).alias("y1"), F.lit(1.0).alias("x2"), ((F.col("n") + 1) * 0.125).alias("y2")]
    return head.unionByName(text).unionByName(items).select("doc_id", F.lit(1).alias("page_number"), "uid", "unit_type", "content", *box)


def html_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a page's HTML: titles and headings are headers, paragraphs and list items text."""
    html = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", "")
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<(?:title|h1|p|li)\b[^>]*>.*?</(?:title|h1|p|li)>"), 0)
    found = table(spark, sf_dir, "pages").select("page_id", F.posexplode(blocks).alias("n", "block"))
    tag = F.lower(F.regexp_extract("block", "<([A-Za-z0-9]+)", 1))
    text = F.trim(F.regexp_replace(F.regexp_replace("block", "<[^>]*>", " "), r"\s+", " "))
    kind = F.when(tag.isin("title", "h1"), "header").otherwise("text")
    return found.select("page_id", "n", tag.alias("tag"), kind.alias("unit_type"), text.alias("content")).where("content <> ''")


def styled_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line units, some with a style as their raw content: sizes, weights and bold under either of their names."""
    kind = (F.col("doc_id") + F.col("page_number") + F.length("content")) % 9
    styles = ['{"font_size": 14, "bold": true}', '{"size": 12, "is_bold": true}', '{"font_size": 13.5, "font_weight": 700}', '{"size": 16, "weight": 400}', '{"font_size": 11, "bold": true}', '{"font_size": 18, "bold": false}', "not a style"]
    raw = F.element_at(F.array(*[F.lit(x) for x in styles]), (kind + 1).cast("int"))
    return line_units(spark, sf_dir).withColumn("content_raw", F.when(kind < len(styles), raw).otherwise(F.col("content")))


def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk per customer, in the section region > nation > segment."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    page = (F.col("c_custkey") % 40 + 1).cast("int")
    content = F.concat_ws(" ", F.lit("Customer"), "c_name", F.lit("of"), "n_name", F.lit("buys for"), F.concat("c_mktsegment", F.lit(".")))
    chunks = joined.select(F.concat_ws(" > ", "r_name", "n_name", "c_mktsegment").alias("section_context"), page.alias("page_number"), content.alias("content"))
    return chunks.withColumn("content_hash", T.content_hash(F.col("content"), F.col("page_number"), F.lit(0), F.lit(0), F.lit(1), F.lit(1)))


def fact_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence with an amount, a percentage and a year per line item."""
    items = table(spark, sf_dir, "lineitem")
    cents = F.col("l_extendedprice").cast("decimal(14,2)").cast("string")
    content = F.concat(F.lit("Order "), "l_orderkey", F.lit(" shipped in "), F.year("l_shipdate"), F.lit(" for $"), cents, F.lit(" at "), F.round(F.col("l_discount") * 100).cast("int"), F.lit("% discount."))
    chunks = items.select(F.concat(F.lit("Flag "), "l_returnflag").alias("section_context"), F.col("l_linenumber").alias("page_number"), content.alias("content"))
    return chunks.withColumn("content_hash", T.content_hash(F.col("content"), F.col("page_number"), F.lit(0), F.lit(0), F.lit(1), F.lit(1)))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction attempts from events: a user is a file, each three events a page, in the order of time."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("k", F.row_number().over(order) - 1)
    status = F.when(F.col("event_type") == "error", "fail").otherwise("success")
    no = F.col("k") % 3 + 1
    return e.select(
        F.col("user_id").alias("file_id"), (F.floor(F.col("k") / 3) + 1).cast("int").alias("page_number"), no.cast("int").alias("attempt_no"),
        F.element_at(F.array(*[F.lit(s) for s in ("STRATEGY_A", "STRATEGY_B", "STRATEGY_C")]), no.cast("int")).alias("strategy"),
        "event_type", status.alias("status"), (F.abs("value") % 1000 / 1000).alias("confidence"), F.abs("value").alias("processing_time_ms"), (F.abs("value") / 1000).alias("cost"), "ts", "event_id",
    )
