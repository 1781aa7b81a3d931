"""What the two vector operators share: valid rows, bounded samples, arrays from Arrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_vectors(df: DataFrame, id_col: str, vec_col: str, *more: str) -> DataFrame:
    """(id, vec, more): rows with an id whose vector is finite, without nulls and not zero.

    Of rows with one id, the least by the other columns and components counts. Vectors of
    another length than most have (the shorter on a tie) take no part.
    """
    ok = F.col(id_col).isNotNull() & (F.size(vec_col) > 0) & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec_col, lambda x: x != 0)
    rows = df.where(F.coalesce(ok, F.lit(False))).select(F.col(id_col).alias("id"), F.struct(*[F.col(c).alias(f"m{i}") for i, c in enumerate(more)], F.col(vec_col).alias("v")).alias("_row"))
    sizes = rows.groupBy(F.size("_row.v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    rows = rows.where(F.size("_row.v") == (sizes["n"] if sizes else 0)).groupBy("id").agg(F.min("_row").alias("_row"))
    return rows.select("id", F.col("_row.v").alias("vec"), *[F.col(f"_row.m{i}").alias(c) for i, c in enumerate(more)])


def sample(rows: DataFrame, most: int) -> tuple[np.ndarray, int]:
    """At most about `most` vectors, drawn by a hash of their ids with one rate for all, as a matrix in id order; and the number of rows."""
    n = rows.count()
    rate = min(1.0, most / max(1, n))
    drawn = rows if rate == 1 else rows.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) < int(rate * (1 << 30)))
    found = drawn.select("id", "vec").orderBy("id").limit(2 * most).toArrow()
    return matrix(found["vec"]), n


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths as a matrix of doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(flat):
        return np.zeros((0, 0))
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
