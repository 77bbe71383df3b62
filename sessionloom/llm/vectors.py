"""What the vector searches share: rows that take part, and meetings of blocks of candidates with blocks of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scale import written


def valid(embeddings: DataFrame, nonzero: bool, component=lambda x: x, also: dict[str, Column] | None = None) -> DataFrame:
    """(row_no, vec_id, v), written: v as doubles, each passed through `component`; rows whose id is not null and whose
    vector has components, all of them finite (and one that is not zero). row_no tells rows of one id apart. also: further
    columns, none of them null."""
    v = F.col("embedding").cast("array<double>")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    also = also or {}
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), *[c.alias(k) for k, c in also.items()]).where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~odd).dropna(subset=list(also))
    if nonzero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    return written(rows.select(F.monotonically_increasing_id().alias("row_no"), "vec_id", F.transform("v", component).alias("v"), *also))


def width(rows: DataFrame) -> int:
    """Components of the longest vector; shorter ones count as followed by zeros."""
    return rows.agg(F.max(F.size("v"))).first()[0] or 0


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Vectors as the rows of a matrix, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(column.value_lengths()).astype(np.int64)
    flat = np.asarray(column.flatten(), np.float64)
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def block(number: Column | int) -> Column:
    """The block that a row belongs to, of so many, by a hash of its row_no."""
    return F.pmod(F.xxhash64("row_no"), F.lit(number) if isinstance(number, int) else number).cast("int")


def copies(number: Column | int) -> Column:
    """The numbers of so many blocks, for a copy of the row in each."""
    return F.sequence(F.lit(0), (F.lit(number) if isinstance(number, int) else number).cast("int") - 1)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query row (query_row, query_id, vec_id, score): largest score first, ties to the smaller id."""
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def kth_scores(found: DataFrame, k: int) -> DataFrame:
    """(bound_of, kth): the k-th best score of each query row that has found so many."""
    return ranked(found, k).where(F.col("rank") == k).select(F.col("query_row").alias("bound_of"), F.col("score").alias("kth"))
