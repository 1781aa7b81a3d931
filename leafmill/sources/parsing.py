"""Files through plugged-in parsers, a file that can't be parsed being a row of its own, and the refined documents' JSON.

Parsers run inside tasks, a file at a time, on what Spark's reader gives them. What a parser raises,
whatever it is, becomes the file's error and none of its rows counts; the others go on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Rows of one batch that go to Spark together.
ROWS = 5000


def listing(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, length) of a folder's files, by name; an error where there is none. Contents aren't read; Spark's reader passes over files of no bytes."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length")
    if found.isEmpty():
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return found.orderBy("path")


def files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, content) of a folder's files, in partitions of Spark's own reader; an error where there is none."""
    listing(spark, folder, pattern)
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")


def parse(files_: DataFrame, parser: Callable[[str, bytes], Iterable[dict]], schema: StructType | str) -> DataFrame:
    """files(path, content) to (path, row, error): a row per row that `parser` yields, one with an error for a file that fails, one with neither for a file without rows.

    Values that don't fit the schema are the file's error too. A null content counts as empty.
    """
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    out = StructType([StructField("path", StringType()), StructField("row", kind), StructField("error", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        struct = arrow.field("row").type

        def table(path: str, rows: pa.Array, error: str | None) -> pa.RecordBatch:
            n = len(rows)
            return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), rows, pa.array([error] * n, pa.string())], schema=arrow)

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    rows = pa.array(list(parser(path, content.as_py() or b"")), struct)
                except Exception as e:  # whatever a plug-in raises
                    yield table(path, pa.nulls(1, struct), f"{type(e).__name__}: {e}")
                    continue
                if not len(rows):
                    yield table(path, pa.nulls(1, struct), None)
                for at in range(0, len(rows), ROWS):
                    yield table(path, rows.slice(at, ROWS), None)

    return files_.select("path", "content").mapInArrow(run, out)


def rows(parsed: DataFrame) -> DataFrame:
    """The parsed rows with their path."""
    return parsed.where("row IS NOT NULL").select("path", "row.*")


def dead_letters(parsed: DataFrame) -> DataFrame:
    """(path, error) of the files that failed."""
    return parsed.where("error IS NOT NULL").select("path", "error")


def manifest(parsed: DataFrame) -> DataFrame:
    """(path, status, n_rows, error): every file once, done or failed."""
    m = parsed.groupBy("path").agg(F.count("row").alias("n_rows"), F.max("error").alias("error"))
    return m.select("path", F.when(F.col("error").isNull(), "done").otherwise("failed").alias("status"), "n_rows", "error")


def parse_to(files_: DataFrame, parser: Callable[[str, bytes], Iterable[dict]], schema: StructType | str, folder: str) -> tuple[DataFrame, DataFrame]:
    """Parses each file once into a table at `folder`; its rows and its manifest."""
    parsed = parse(files_, parser, schema)
    parsed.write.mode("overwrite").parquet(folder)
    again = files_.sparkSession.read.schema(parsed.schema).parquet(folder)
    return rows(again), manifest(again)


def refined(spark: SparkSession, folder: str, pattern: str = "*_refined.json") -> tuple[DataFrame, DataFrame]:
    """Units and broken files (see refined_units) of a folder's JSON documents, one a file on any number of lines; an error where there is none."""
    listing(spark, folder, pattern)
    whole = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return refined_units(whole.select(F.col("_metadata.file_path").alias("path"), "value"))


def refined_units(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """documents(path, value) to units with their file_id and place, and (path, error) of texts that hold no JSON object.

    A document without a file_id has its file's name. A unit's content is its markdown, or else its raw content;
    units without any, or that are no object, are none. Pages come from the provenance, 1 where that has none; boxes
    are the whole page where they are missing. A unit's section is its document and kind.
    """
    read = documents.withColumn("v", F.try_parse_json("value"))
    error = F.when(F.col("v").isNull(), "no JSON").when(~F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), "no JSON object")
    name = F.element_at(F.split("path", "/"), -1)
    got = lambda path, kind, of="u": F.try_variant_get(of, path, kind)
    told = lambda c: F.nullif(F.trim(c), F.lit(""))
    good = read.where(error.isNull()).select("path", F.coalesce(told(got("$.file_id", "string", "v")), F.regexp_replace(name, r"\.[^.]*$", "")).alias("file_id"), got("$.units", "array<variant>", "v").alias("units"))
    each = good.select("file_id", F.posexplode("units").alias("n", "u"))
    page = got("$.provenance.page_number", "int")
    units = each.select(
        "file_id", "n", F.when(page > 0, page).otherwise(1).alias("page_number"), got("$.uid", "string").alias("uid"), F.coalesce(told(got("$.unit_type", "string")), F.lit("text")).alias("unit_type"),
        F.coalesce(told(got("$.content_markdown", "string")), told(got("$.content_raw", "string"))).alias("content"),
        *[F.coalesce(got(f"$.bbox.{k}", "double"), F.lit(v)).alias(k) for k, v in (("x1", 0.0), ("y1", 0.0), ("x2", 1.0), ("y2", 1.0))],
    )
    units = units.where("content IS NOT NULL").withColumn("section_context", F.concat_ws(" > ", "file_id", "unit_type"))
    return units, read.where(error.isNotNull()).select("path", error.alias("error"))
