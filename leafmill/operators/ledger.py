"""The ledger: costs taken from attempt chains before appending, and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EVENT_SCHEMA = "event_type string, file_name string, page_number int, strategy_selected string, confidence_score double, cost_estimate double, processing_time_ms double, logged_at timestamp"


def entries(results: DataFrame) -> DataFrame:
    """Ledger rows of page results, costs recomputed from the chain."""
    return results.select(
        F.lit("extraction_page_metrics").alias("event_type"), F.col("file_id").cast("string").alias("file_name"), "page_number", F.col("final_strategy").alias("strategy_selected"),
        F.lit(None).cast("double").alias("confidence_score"), F.round(F.greatest(F.lit(0.0), "total_cost"), 6).alias("cost_estimate"), F.col("total_time_ms").alias("processing_time_ms"), F.lit(None).cast("timestamp").alias("logged_at"),
    )


def with_progress(rows: DataFrame) -> DataFrame:
    """Adds `pages_processed`: a document's pages so far, in their order."""
    return rows.withColumn("pages_processed", F.row_number().over(Window.partitionBy("file_name").orderBy("page_number")))


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def run_totals(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("documents"), F.sum("pages").alias("pages"), F.round(F.sum(F.col("total_cost").cast("decimal(20,4)")), 2).cast("double").alias("total_cost"), F.sum("failed_pages").alias("failed_pages"))
