"""Exact top-k search over an impact-ordered index, score at a time.

Vectors of integers are documents, their components terms. In a block of vectors a posting's impact is how far its
component lies from the term's centre, a whole number near the mean; impacts are quantised to levels of about equal
numbers of postings. A segment holds the postings of one term and level. A block of queries takes the segments in
descending level and adds weight times impact to the sums of the segment's vectors alone. What the levels left can still
add to a vector is at most the length of its impacts left times the query's length. A query stops only on proof: vectors
that can't reach the k-th best score known so far are out, and once scoring the others exactly costs less than the next
level's postings, they are scored anew, exactly.

Each query first meets one block of candidates, where the k vectors with the best sums are scored exactly for a bound;
with the k-th best score of that block it goes to the others, at once past a block that can't reach the bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scale import written
from .vectors import block, copies, kth_scores, matrix, ranked, valid, width

#: Levels of quantised impact; rows of a block of candidates, and of queries; queries that share a pass.
LEVELS, BLOCK, QUERIES, TOGETHER = 8, 8_192, 65_536, 256
#: Doubles hold integers up to this exactly, longs up to the other.
EXACT, LONG = 2.0**53, 2.0**63


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of x with q, whole numbers held as doubles; an OverflowError beyond a long."""
    if not len(x):
        return np.empty(0, np.int64)
    bound = float((np.abs(x) @ np.abs(q)).max())
    if bound < EXACT:
        return (x @ q).astype(np.int64)
    if max(np.abs(x).max(), np.abs(q).max()) < LONG and 2 * bound < LONG:
        return x.astype(np.int64) @ q.astype(np.int64)
    weights = [int(w) for w in q]
    out = [sum(int(v) * w for v, w in zip(row, weights, strict=True)) for row in x.tolist()]
    if any(not -(1 << 63) <= s < 1 << 63 for s in out):
        raise OverflowError("an inner product exceeds a long")
    return np.array(out, np.int64)


class Block:
    """The impact-ordered index of a block of vectors (rows) of whole numbers, held as doubles."""

    def __init__(self, x: np.ndarray):
        self.x, (self.n, self.dim), self.largest = x, x.shape, np.abs(x).max(0)
        self.centre = np.round((x / self.n).sum(0))
        away = x - self.centre
        impact = np.abs(away)
        cuts = np.unique(np.quantile(impact, np.arange(1, LEVELS) / LEVELS))
        level = np.searchsorted(cuts, impact, side="right")
        self.levels = len(cuts) + 1
        # left[i]: the length of each vector's impacts below level i, with what rounding may take from it
        scale = np.maximum(impact.max(1), 1.0)
        shares = [np.where(level == i, (impact / scale[:, None]) ** 2, 0.0).sum(1) for i in range(self.levels)]
        self.left = np.sqrt(np.concatenate([np.zeros((1, self.n)), np.cumsum(shares, 0)])) * scale * (1 + 1e-9)
        flat = level.T.ravel()
        order = np.argsort(-flat, kind="stable")  # by level, then term, then vector
        order = order[impact.T.ravel()[order] > 0]
        self.rows, self.signed = order % self.n, away.T.ravel()[order]
        self.starts = np.searchsorted((self.levels - 1 - flat[order]) * self.dim + order // self.n, np.arange(self.levels * self.dim + 1))
        self.finished = np.zeros(self.levels + 1, np.int64)  # queries that stopped after so many levels
        self.work = 0  # multiply-adds

    def segments(self, level: int) -> np.ndarray:
        """Where the segments of a level's terms start, and where the last one ends."""
        at = (self.levels - 1 - level) * self.dim
        return self.starts[at : at + self.dim + 1]

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        self.work += len(rows) * self.dim
        if np.abs(q) @ self.largest < EXACT:
            return (self.x[rows] @ q).astype(np.int64)
        return products(self.x[rows], q)

    def search(self, q: np.ndarray, own: list[np.ndarray], k: int, bound: np.ndarray) -> list[np.ndarray]:
        """For each query the rows that may be among its k best, its own left out: all that aren't proven worse.

        bound: a score that k other vectors of the query are known to reach.
        """
        base, length = q @ self.centre, np.sqrt((q**2).sum(1)) * (1 + 1e-9)
        # what rounding may add to a sum: none while all of its terms and sums are exact
        whole = np.abs(q) @ self.largest
        doubt = np.where(6 * whole < EXACT, 0.0, 6 * whole * 4 * (self.dim + LEVELS) * 2.0**-53)
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(q)
        floor, unknown = bound.copy(), np.isneginf(bound)
        live = np.flatnonzero(~(base + self.left[-1].max() * length + doubt < bound))  # the others stop before the first level
        self.finished[0] += len(q) - len(live)
        sums, weight = np.tile(base[live], (self.n, 1)), np.ascontiguousarray(q[live].T)
        for i, query in enumerate(live):
            sums[own[query], i] = -np.inf
        for level in range(self.levels - 1, -1, -1):
            if not len(live):
                break
            starts = self.segments(level)
            for term, (i, j) in enumerate(zip(starts, starts[1:], strict=False)):
                sums[self.rows[i:j]] += self.signed[i:j, None] * weight[term]
            self.work += int(starts[-1] - starts[0]) * len(live)
            for i in np.flatnonzero(unknown[live]):
                query = live[i]
                if self.n - len(own[query]) >= k:
                    best = np.argpartition(-sums[:, i], k - 1)[:k]
                    kth = float(self.scores(best, q[query]).min())
                    floor[query] = max(floor[query], kth if abs(kth) < EXACT else kth - abs(kth) * 2.0**-52)
            possible = ~(sums < floor[live] - doubt[live] - self.left[level][:, None] * length[live])
            for i, query in enumerate(live):
                possible[own[query], i] = False
            many, following = possible.sum(0), self.segments(level - 1) if level else starts
            done = (many * self.dim <= following[-1] - following[0]) | (level == 0)
            for i in np.flatnonzero(done):
                out[live[i]] = np.flatnonzero(possible[:, i])
            self.finished[self.levels - level] += int(done.sum())
            sums, live, weight = sums[:, ~done], live[~done], weight[:, ~done]
        return out


def top_products(embeddings: DataFrame, is_query, k: int = 5, factor: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (long) for each query (a condition on vec_id) among all rows but its own.

    Components become floor(factor * x), exactly. Rows that are null or not finite or have a null id take no part; each
    row of a repeated id is a candidate (and a query) of its own; shorter vectors count as followed by zeros; vectors
    without components take no part; other columns are ignored; an empty table gives an empty result. A score that
    exceeds a long raises an OverflowError.
    """
    spark = embeddings.sparkSession
    # beyond 2 ** 53 a double is whole as it is
    rows = valid(embeddings, nonzero=False, component=lambda x: F.when(F.abs(x) < EXACT / factor, F.floor(x * factor).cast("double")).otherwise(x * factor))
    total = rows.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, asking = width(rows), rows.where(is_query(F.col("vec_id")))
    c_blocks, q_blocks = -(-total // BLOCK), max(1, -(-asking.count() // QUERIES))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            ids, rows, x, q = left["vec_id"].to_numpy(), left["row_no"].to_numpy(), matrix(left["v"], dim), matrix(right["v"], dim)
            held, q_ids, q_rows = Block(x), right["vec_id"].to_numpy(), right["row_no"].to_numpy()
            kth = right["kth"].to_numpy().astype(np.float64)
            bound = np.where(np.isnan(kth), -np.inf, np.where(np.abs(kth) < EXACT, kth, kth - np.abs(kth) * 2.0**-52))
            order = np.argsort(rows)
            for at in range(0, len(q), TOGETHER):
                some = slice(at, at + TOGETHER)
                first, last = (np.searchsorted(rows, q_rows[some], side, sorter=order) for side in ("left", "right"))
                own = [order[i:j] for i, j in zip(first, last, strict=True)]
                for q_row, q_id, v, near in zip(q_rows[some], q_ids[some], q[some], held.search(q[some], own, k, bound[some]), strict=True):
                    score = held.scores(near, v)
                    best = np.lexsort((ids[near], -score))[:k]
                    for part, got in zip(out, (np.full(len(best), q_row), np.full(len(best), q_id), ids[near[best]], score[best]), strict=True):
                        part.append(got)
        names = ("query_row", "query_id", "vec_id", "score")
        return pa.table({name: pa.array(np.concatenate(part) if part else np.empty(0), pa.int64()) for name, part in zip(names, out, strict=True)})

    candidates = rows.select("row_no", "vec_id", "v", block(c_blocks).alias("cb"), F.explode(copies(q_blocks)).alias("qb"))

    def found(queries: DataFrame) -> DataFrame:
        renamed = queries.select(*[F.col(c).alias(c) for c in queries.columns], block(q_blocks).alias("qb"))  # both sides come from one table
        sides = candidates.groupBy("cb", "qb").cogroup(renamed.groupBy("cb", "qb"))
        return sides.applyInArrow(search, "query_row long, query_id long, vec_id long, score long")

    near = written(found(asking.withColumns({"kth": F.lit(None).cast("double"), "cb": block(c_blocks)})))
    if c_blocks > 1:
        bounds = kth_scores(near, k)
        others = asking.join(bounds, F.col("row_no") == F.col("bound_of"), "left").drop("bound_of").withColumn("kth", F.col("kth").cast("double"))
        near = near.unionByName(found(others.withColumn("own", block(c_blocks)).select("row_no", "vec_id", "v", "kth", "own", F.explode(copies(c_blocks)).alias("cb")).where("cb <> own").drop("own")))
    return ranked(near, k).select("query_id", "rank", "vec_id", "score")


def top_products_sql(modulus: int = 50, k: int = 5, factor: int = 256) -> str:
    """DuckDB SQL for top_products() with queries whose id the modulus divides, over vectors of one length."""
    return f"""
WITH v AS (
  SELECT vec_id, row_number() OVER () AS row_no, list_transform(embedding, lambda x: floor({factor} * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.row_no, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.row_no <> c.row_no WHERE q.vec_id % {modulus} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""
