"""Constraints as reports of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bbox_ok(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Ordered corners, all in [0, 1] or all from 0 up."""
    return (x2 >= x1) & (y2 >= y1) & (F.least(x1, y1, x2, y2) >= 0)


CHECKS: dict[str, str] = {
    "page_number": "page_number > 0",
    "confidence": "confidence BETWEEN 0 AND 1",
    "cost": "cost >= 0",
    "processing_time_ms": "processing_time_ms >= 0",
    "status": "status IN ('success', 'fail')",
    "strategy": "strategy IN ('STRATEGY_A', 'STRATEGY_B', 'STRATEGY_C')",
    "content": "trim(content) <> ''",
    "token_count": "token_count > 0",
    "unit_type": "unit_type IN ('text', 'table', 'header', 'figure')",
}


#: Where rows may stand for a whole document, as in the ledger and the index, page 0 is one.
FROM_ZERO: dict[str, str] = {**CHECKS, "page_number": "page_number >= 0"}


def violations(df: DataFrame, checks: dict[str, str] = CHECKS) -> DataFrame:
    """Rows and violating rows for each check whose column the table has; null violates. One aggregation."""
    names = [c for c in checks if c in df.columns]
    agg = df.agg(F.count("*").alias("_n"), *[F.count_if(~F.coalesce(F.expr(checks[c]), F.lit(False))).alias(c) for c in names])
    pairs = F.array(*[F.struct(F.lit(c).alias("check_name"), F.col("_n").alias("row_count"), F.col(c).alias("bad_rows")) for c in names])
    return agg.select(F.explode(pairs).alias("r")).select("r.*")


def all_ok(*tests: Column) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))
