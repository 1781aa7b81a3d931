"""The batch run: documents to profiles, chunks, tree and facts, written as tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import chunking, facts, tree, triage
from ..sources import parsing

#: What a plugged-in parser yields: units with their page's measures.
PARSED = "page_number int, uid string, unit_type string, content string, x1 double, y1 double, x2 double, y2 double, width double, height double, rect_count int, image_count int"
#: Tables that a run leaves, and that questions need.
TABLES = ("page_profiles", "doc_profiles", "chunks", "nodes", "facts")


def refine(pages: DataFrame, units: DataFrame, config: Config) -> dict[str, DataFrame]:
    """All tables of a run, lazily."""
    chunks = chunking.merge_orphans(chunking.pack(units, config), config)
    flat = chunks.select("doc_id", F.col("section").alias("section_context"), F.col("pages")[0].alias("page_number"), "content", "content_hash", "tokens")
    return {"page_profiles": triage.page_profiles(pages, config), "doc_profiles": triage.doc_profiles(pages, config), "chunks": chunks, "nodes": tree.nodes(flat), "facts": facts.extract(flat)}


def write(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Writes each table as Parquet, replacing what an earlier run wrote; a table that fails leaves the others. Returns the failures by name."""
    failures: dict[str, str] = {}
    for name, df in tables.items():
        try:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
        except Exception as e:  # whatever a table's plug-ins raise
            failures[name] = str(e)
    return failures


def write_documents(units: DataFrame, folder: str) -> None:
    """A JSON line per document with its units in order, as sources.tables.refined_units reads them."""
    row = F.struct("page_number", "uid", "unit_type", "content")
    docs = units.groupBy(F.col("doc_id").cast("string").alias("file_id")).agg(F.array_sort(F.collect_list(row)).alias("units"))
    docs.write.mode("overwrite").json(folder)


def refine_files(files: DataFrame, parser: Callable[[str, bytes], Iterable[dict]], config: Config, folder: str) -> tuple[DataFrame, dict[str, str]]:
    """Parses files(path, content) and writes all tables of the run and its manifest under `folder`; the manifest and the failures by table.

    A file that can't be parsed is a row of the manifest, and the others go on.
    """
    rows, manifest = parsing.parse_to(files, parser, PARSED, f"{folder}/parsed")
    units = rows.withColumnRenamed("path", "doc_id")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("uid", "content"))), lambda x: x["content"]), "\n")
    measures = [F.max(c).alias(c) for c in ("width", "height", "rect_count", "image_count")]
    pages = units.groupBy("doc_id", "page_number").agg(text.alias("text"), *measures)
    failures = write({**refine(pages, units.select("doc_id", "page_number", "uid", "unit_type", "content", "x1", "y1", "x2", "y2"), config), "manifest": manifest}, folder)
    return files.sparkSession.read.schema(manifest.schema).parquet(f"{folder}/manifest"), failures


def finished(spark: SparkSession, folder: str, tables: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    """The tables of a run; an error that names all that are missing, as nothing can be asked without them. A table that was being written when its run stopped counts as missing."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    missing = [f"{folder}/{t}" for t in tables if not fs.exists(hadoop(f"{folder}/{t}/_SUCCESS"))]
    if missing:
        raise FileNotFoundError("These tables of a run are missing; run it first: " + ", ".join(missing))
    return {t: spark.read.parquet(f"{folder}/{t}") for t in tables}
