"""Hard negatives by a vertical scan of columns with bounds on what is left (BOND).

A block of vectors is kept by column. An anchor reads the columns in descending order of its own components' magnitude and
adds up partial products. What the columns left can still add lies between sums of products with each column's least and
greatest component, and within the product of the lengths that are left; so each candidate's score lies in a shrinking range.
A candidate stays in the anchor's bitmap only while its range meets a window of scores it is asked for, above the k-th best
score known inside that window. Survivors are scored exactly.

Positives are the best of the anchor's own label, one window without ends; each positive's score then gives a window for the rows of
other labels. An anchor meets the blocks of its label in the first scan and all blocks in the second.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .impacts import EXACT, products
from .scale import written
from .vectors import block, copies, matrix, ranked, valid, width

#: Rows of a block of candidates, anchors that share a task, and columns read between two looks at the bounds.
BLOCK, ANCHORS, COLUMNS = 8_192, 65_536, 4
#: Parts of the alive below which the bitmap is packed into a list of places, and candidates scored early for each one asked for.
DENSE, EARLY = 0.9, 2


class Columns:
    """A block of vectors of whole numbers (rows, held as doubles), by column."""

    def __init__(self, x: np.ndarray):
        self.x, self.n = x, len(x)
        self.columns = np.ascontiguousarray(x.T)
        self.least, self.most = x.min(0), x.max(0)
        self.length = np.sqrt((x**2).sum(1))
        self.work = 0  # multiply-adds

    def exact(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        self.work += len(at) * len(q)
        return products(self.x[at], q)

    def scan(self, q: np.ndarray, alive: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
        """Places, of those alive, that may be among the k best of a window (low to high, both inside) of scores."""
        places = np.flatnonzero(alive)
        if not len(places) or not len(low):
            return places[:0]
        order = np.argsort(-np.abs(q), kind="stable")
        ends = np.stack([q * self.least, q * self.most])
        left = lambda a: np.append(np.cumsum(a[order][::-1])[::-1], 0.0)
        down, up, rest = left(ends.min(0)), left(ends.max(0)), np.sqrt(left(q * q))
        slack = float(np.abs(q) @ np.maximum(np.abs(self.least), np.abs(self.most))) * 1e-12
        floor = low.copy()
        early = EARLY * k * len(low)
        partial, length = np.zeros(len(places)), self.length[places]
        packed = len(places) < DENSE * self.n
        for t in range(0, len(q), COLUMNS):
            some = order[t : t + COLUMNS]
            at = min(t + COLUMNS, len(q))
            if packed:
                partial += q[some] @ self.columns[some[:, None], places[None]]
            else:
                partial += (q[some] @ self.columns[some])[places]
            self.work += len(some) * (len(places) if packed else self.n)
            reach = rest[at] * length
            most = partial + np.minimum(up[at], reach) + slack
            least = partial + np.maximum(down[at], -reach) - slack
            if at in (4 * COLUMNS, 8 * COLUMNS) and len(places) > 4 * early:  # some exact scores raise the floors
                likely = np.argpartition(-partial, early)[:early]
                got = self.exact(places[likely], q).astype(np.float64)
                for w in range(len(low)):
                    inside = np.sort(got[(got >= low[w]) & (got <= high[w])])
                    if len(inside) >= k:
                        floor[w] = max(floor[w], inside[-k])
            on = np.zeros(len(places), bool)
            for w in range(len(low)):
                on |= (most >= floor[w]) & (least <= high[w])
            if not on.any():
                return places[:0]
            if on.sum() < DENSE * len(on) or packed:
                places, partial, length, packed = places[on], partial[on], length[on], True
        return places


def best_of(held: Columns, places: np.ndarray, ids: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and exact scores of the k best in each window, ties to the smaller id."""
    score = held.exact(places, q)
    out = []
    for a, b in zip(low, high, strict=True):
        inside = np.flatnonzero((score >= a) & (score <= b))
        best = inside[np.lexsort((ids[places[inside]], -score[inside]))[:k]]
        out.append((places[best], score[best]))
    return out


def whole(x: Column, factor: int) -> Column:
    """floor(factor * x); beyond 2 ** 53 a double is whole as it is."""
    return F.when(F.abs(x) < EXACT / factor, F.floor(x * factor).cast("double")).otherwise(x * factor)


def hard_negatives(embeddings: DataFrame, is_anchor, label: Column | None = None, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, factor: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score (longs) for each anchor (a condition
    on vec_id), each of its best positives (other rows of its label) and the best rows of other labels whose score, times
    100, lies from low to high times the positive's score.

    Components become floor(factor * x), exactly. label: the column `label` unless an expression is given. Rows with a null id,
    label or vector, no component, or a null or non-finite one take no part; each row of a repeated id is a candidate and an anchor of its
    own; higher scores come first, ties go to the smaller vec_id; shorter vectors count as followed by zeros; other columns are ignored; an
    empty table, or anchors without positives, give no rows. A score that exceeds a long raises an OverflowError.
    """
    spark = embeddings.sparkSession
    rows = valid(embeddings, nonzero=False, component=lambda x: whole(x, factor), also={"label": F.col("label") if label is None else label})
    total, asking = rows.count(), rows.where(is_anchor(F.col("vec_id")))
    asked = asking.count()
    if not asked:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    dim, c_blocks, a_blocks = width(rows), -(-total // BLOCK), -(-asked // ANCHORS)

    def anew(df: DataFrame) -> DataFrame:
        """The same columns under new identities, as both sides of a cogroup come from one table."""
        return df.select(*[F.col(c).alias(c) for c in df.columns])

    def table(parts: list[list[np.ndarray]], names: tuple[str, ...]) -> pa.Table:
        return pa.table({name: pa.array(np.concatenate(part) if part else np.empty(0), pa.int64()) for name, part in zip(names, parts, strict=True)})

    def pick_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            held, ids, c_rows = Columns(matrix(left["v"], dim)), left["vec_id"].to_numpy(), left["row_no"].to_numpy()
            ends = np.array([-np.inf]), np.array([np.inf])
            for row, a_id, q in zip(right["row_no"].to_numpy(), right["vec_id"].to_numpy(), matrix(right["v"], dim), strict=True):
                near = held.scan(q, c_rows != row, *ends, positives)
                ((at, score),) = best_of(held, near, ids, q, *ends, positives)
                for part, got in zip(out, (np.full(len(at), row), np.full(len(at), a_id), ids[at], score), strict=True):
                    part.append(got)
        return table(out, ("query_row", "query_id", "vec_id", "score"))

    def pick_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            held, ids = Columns(matrix(left["v"], dim)), left["vec_id"].to_numpy()
            kinds = left["label"].combine_chunks().dictionary_encode()
            code, place_of = kinds.indices.to_numpy(), {v: i for i, v in enumerate(kinds.dictionary.to_pylist())}
            for row, kind, q, scores in zip(right["row_no"].to_numpy(), right["label"].to_pylist(), matrix(right["v"], dim), right["scores"].to_pylist(), strict=True):
                wanted = [s for s in sorted(set(scores), reverse=True) if s >= 0]  # below zero a window is empty
                a = np.array([-(-low * s // 100) for s in wanted], np.float64)
                b = np.array([high * s // 100 for s in wanted], np.float64)
                near = held.scan(q, code != place_of.get(kind, -1), a, b, negatives)
                for s, (at, score) in zip(wanted, best_of(held, near, ids, q, a, b, negatives), strict=True):
                    for part, got in zip(out, (np.full(len(at), row), np.full(len(at), s), ids[at], score), strict=True):
                        part.append(got)
        return table(out, ("query_row", "window", "vec_id", "score"))

    # first scan: blocks of one label
    sizes = rows.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).withColumnRenamed("label", "of_label")
    dealt = rows.join(sizes, F.col("label") == F.col("of_label")).drop("of_label").withColumn("cb", block(F.col("blocks"))).withColumn("qb", F.explode(copies(a_blocks)))
    sent = asking.join(sizes, F.col("label") == F.col("of_label")).drop("of_label").select("*", F.explode(copies(F.col("blocks"))).alias("cb")).withColumn("qb", block(a_blocks))
    keys = ("label", "cb", "qb")
    found = dealt.groupBy(*keys).cogroup(anew(sent).groupBy(*keys)).applyInArrow(pick_positives, "query_row long, query_id long, vec_id long, score long")
    pairs = written(ranked(found, positives))

    # second scan: blocks of any labels, the label in the first bitmap
    scores = pairs.groupBy("query_row").agg(F.collect_set("score").alias("scores"))  # at most `positives` of them
    ready = asking.join(scores, F.col("row_no") == F.col("query_row")).select("row_no", "label", "v", "scores", block(a_blocks).alias("qb"))
    sent = ready.withColumn("cb", F.explode(copies(c_blocks)))
    dealt = rows.withColumn("cb", block(c_blocks)).withColumn("qb", F.explode(copies(a_blocks)))
    found = dealt.groupBy("cb", "qb").cogroup(anew(sent).groupBy("cb", "qb")).applyInArrow(pick_negatives, "query_row long, window long, vec_id long, score long")
    best = Window.partitionBy("query_row", "window").orderBy(F.col("score").desc(), "vec_id")
    near = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= negatives).select(F.col("query_row").alias("of_row"), "window", F.col("nth").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    met = pairs.drop("rank").join(near, (F.col("query_row") == F.col("of_row")) & (F.col("score") == F.col("window")))
    return met.select(F.col("query_id").alias("anchor_id"), F.col("vec_id").alias("positive_id"), "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score")


def hard_negatives_sql(modulus: int = 100, relabelled: int = 7, labels: int = 10, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, factor: int = 256) -> str:
    """DuckDB SQL for hard_negatives() over vectors of one length, anchors and relabelled rows by divisors of their ids."""
    return f"""
WITH v AS (
  SELECT vec_id, row_number() OVER () AS row_no, CASE WHEN vec_id % {relabelled} = 0 THEN (label + 1) % {labels} ELSE label END AS label, list_transform(embedding, lambda x: floor({factor} * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.row_no AS anchor_row, q.vec_id AS anchor_id, c.vec_id, c.row_no, q.label = c.label AS same, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.row_no <> c.row_no WHERE q.vec_id % {modulus} = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_row ORDER BY score DESC, vec_id) AS nth FROM s WHERE same),
n AS (
  SELECT p.anchor_row, p.nth, p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_row, p.nth ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON p.anchor_row = s.anchor_row AND NOT s.same AND {low} * p.score <= 100 * s.score AND 100 * s.score <= {high} * p.score WHERE p.nth <= {positives})
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {negatives}"""
