"""Approximate nearest neighbours by adaptive dimension scans.

Largest inner products become smallest distances once each vector gets one more component, which makes all lengths
equal. Vectors are then rotated at random and dealt to lists around centres. Within each list that a query probes, the
distance is summed over blocks of columns; after t of D columns a candidate is left as soon as a hypothesis test says
that its whole distance exceeds the query's k-th best so far: partial sum > t/D * (1 + EPSILON/sqrt(t))^2 * bound. The
survivors' inner products are computed on the original vectors in double precision.

The bound is carried along: a query first scans its nearest lists, and goes to its other lists with the k-th best of
those, so the tests act from the first columns of the first candidate on; within a task it passes from list to list.

Centres and rotation come from a bounded sample; every row is indexed. How many lists a query probes is measured on the
sample: as few as find RECALL of the sample's true neighbours. Lists lie in cells of about BLOCK candidates, small lists
together and large ones cut by a hash, and a query goes to a cell once; no task holds a large list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scale import written
from .vectors import block, copies, kth_scores, matrix, ranked, valid, width

#: The index is fitted on so many vectors at most; lists at most.
SAMPLE, MOST_LISTS = 20_000, 1_024
#: The part of the sample's true neighbours that probing must find, the queries that measure it, and the part of its lists
#: that a query scans first.
RECALL, MEASURED, FIRST = 0.95, 500, 0.1
#: Columns of a block, and the tests' width.
COLUMNS, EPSILON = 8, 1.4
#: Rows of a cell of candidates or of a block of queries, and candidates scanned at once.
BLOCK, SCANNED = 8_192, 512
#: The part of a product's pairs that go on, below which they are taken one by one.
SPARSE = 0.6


@dataclass
class Index:
    dim: int
    longest: float  # square of the largest length
    rotation: np.ndarray
    centres: np.ndarray  # rotated
    probes: int
    cell: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # of each list, the first
    cells: np.ndarray = field(default_factory=lambda: np.ones(1, np.int64))  # of each list, how many

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.longest - (x**2).sum(1), 0))
        return np.column_stack([x, more]) @ self.rotation

    def nearest_lists(self, rotated: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each row, nearest first."""
        d = (self.centres**2).sum(1) - 2 * rotated @ self.centres.T
        n = min(n, len(self.centres))
        near = np.argpartition(d, n - 1, axis=1)[:, :n]
        return np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)

    def probes_for(self, sample: np.ndarray, k: int, recall: float) -> int:
        """The fewest lists whose probing finds that part of the true neighbours within the sample."""
        at = self.nearest_lists(self.lifted(sample, query=False), 1)[:, 0]
        queries = sample[:: max(1, len(sample) // MEASURED)]
        score = queries @ sample.T
        score[np.arange(len(queries)), np.arange(0, len(sample), max(1, len(sample) // MEASURED))] = -np.inf
        near = np.argpartition(-score, min(k, len(sample) - 1), axis=1)[:, : min(k, len(sample) - 1)]
        if not near.size:
            return 1
        order = self.nearest_lists(self.lifted(queries, query=True), len(self.centres))
        turn = np.empty_like(order)
        np.put_along_axis(turn, order, np.arange(order.shape[1])[None], 1)
        turns = np.sort(np.take_along_axis(turn, at[near], 1).ravel())
        return int(turns[min(len(turns) - 1, int(np.ceil(recall * len(turns))))]) + 1

    def lay(self, sizes: np.ndarray, rows: int) -> int:
        """Deals the lists to cells of about so many rows, and gives the number of cells."""
        self.cell, self.cells = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
        at, held = 0, 0
        for k, n in enumerate(sizes):
            if held and held + n > rows:
                at, held = at + 1, 0
            self.cell[k], self.cells[k] = at, max(1, -(-n // rows))
            held += n
            if self.cells[k] > 1:
                at, held = at + self.cells[k], 0
        return int(at + 1)


def fit(rows: DataFrame, k: int, recall: float = RECALL, seed: int = 11) -> Index | None:
    """Centres by k-means over a sample that a hash picks, about as many as the root of the number of rows."""
    total, longest = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    if not total:
        return None
    dim = width(rows)
    lot = F.xxhash64("row_no", F.lit(seed))
    wide = F.pmod(lot, F.lit(1 << 30)) / float(1 << 30)
    sample = matrix(rows.where(wide < 1.2 * SAMPLE / total).orderBy(lot).limit(SAMPLE).select("v").toArrow()["v"], dim)
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.normal(size=(dim + 1, dim + 1)))[0]
    index = Index(dim, float(longest), rotation, np.zeros((1, dim + 1)), 1)
    if not len(sample):
        return index
    x = index.lifted(sample, query=False)
    lists = int(min(MOST_LISTS, max(1, round(total**0.5)), len(x)))
    index.centres = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(10):
        at = index.nearest_lists(x, 1)[:, 0]
        many = np.bincount(at, minlength=lists)
        sums = np.stack([np.bincount(at, x[:, j], lists) for j in range(dim + 1)], 1)
        index.centres[many > 0] = sums[many > 0] / many[many > 0, None]
    index.probes = index.probes_for(sample, k, recall)
    return index


@dataclass
class Best:
    """The k nearest so far of each of a block of queries: squared distances and places, and the bound of the tests."""

    distance: np.ndarray
    place: np.ndarray
    carried: np.ndarray  # the k-th best of earlier scans
    met: int = 0
    abandoned: int = 0  # pairs left before their last columns
    work: int = 0  # multiply-adds of partial distances, and what all of them would have been
    full: int = 0

    def bound(self, rows: np.ndarray) -> np.ndarray:
        return np.minimum(self.distance[rows, -1], self.carried[rows])


def scan(q: np.ndarray, q_rows: np.ndarray, rows: np.ndarray, c: np.ndarray, c_rows: np.ndarray, offset: int, best: Best) -> None:
    """Scans a list's candidates (rotated, one to a row, at places from offset on) for some of the queries.

    q_rows and c_rows are their row_nos: no query meets its own row. After each block of columns queries and candidates without a
    pair that goes on are left out of the next product; once less than SPARSE of the rest goes on, its pairs go on one by one.
    """
    k, d = best.distance.shape[1], q.shape[1]
    for a in range(0, len(c), SCANNED):
        part, here = c[a : a + SCANNED], np.arange(len(c[a : a + SCANNED]))
        to, own_q = rows, q[rows]
        bound = best.bound(rows) * (1 + 1e-9) + 1e-9
        sums = np.zeros((len(rows), len(part)))
        alive = q_rows[rows][:, None] != c_rows[None, a : a + SCANNED]
        met = going = int(alive.sum())
        left = at = None  # of the pairs that go on, once they are few
        for t in range(0, d, COLUMNS):
            qb, cb = own_q[:, t : t + COLUMNS], part[:, t : t + COLUMNS]
            seen = min(t + COLUMNS, d)
            limit = bound * (seen / d * (1 + EPSILON / np.sqrt(seen)) ** 2 if seen < d else 1)
            best.work += (alive.size if left is None else len(left)) * (seen - t)
            if left is None:
                sums += (qb**2).sum(1)[:, None] + (cb**2).sum(1)[None] - 2 * qb @ cb.T
                alive &= sums <= limit[:, None]
            else:
                sums[left, at] += ((qb[left] - cb[at]) ** 2).sum(1)
                on = sums[left, at] <= limit[left]
                left, at = left[on], at[on]
            if seen == d:
                break
            going = int(alive.sum()) if left is None else len(left)
            if left is None:
                on_q, on_c = alive.any(1), alive.any(0)
                if on_q.sum() * on_c.sum() < 0.8 * alive.size:
                    to, own_q, bound, part, here = to[on_q], own_q[on_q], bound[on_q], part[on_c], here[on_c]
                    sums, alive = sums[np.ix_(on_q, on_c)], alive[np.ix_(on_q, on_c)]
                if going < SPARSE * alive.size:
                    left, at = np.nonzero(alive)
            if not going:
                break
        best.met += met
        best.abandoned += met - going
        best.full += len(rows) * len(c[a : a + SCANNED]) * d
        if left is not None:
            alive = np.zeros_like(alive)
            alive[left, at] = True
        touched = np.flatnonzero(alive.any(1)) if going else []
        if not len(touched):
            continue
        to = to[touched]
        both = np.concatenate([best.distance[to], np.where(alive[touched], sums[touched], np.inf)], 1)
        where = np.concatenate([best.place[to], np.broadcast_to(offset + a + here, (len(touched), len(here)))], 1)
        order = np.argpartition(both, k - 1, axis=1)[:, :k]
        order = np.take_along_axis(order, np.argsort(np.take_along_axis(both, order, 1), axis=1), 1)
        best.distance[to], best.place[to] = np.take_along_axis(both, order, 1), np.take_along_axis(where, order, 1)


def search_cell(index: Index, left: pa.Table, right: pa.Table, k: int) -> tuple[Best, np.ndarray, np.ndarray]:
    """Scans a cell: candidates (list, v, row_no) and queries (lists, v, row_no, kth, none where none is carried).

    Gives what was found and the vectors of both sides.
    """
    x, queries = matrix(left["v"], index.dim), matrix(right["v"], index.dim)
    list_of, c_rows, q_rows = left["list"].to_numpy(), left["row_no"].to_numpy(), right["row_no"].to_numpy()
    q, kth = index.lifted(queries, True), right["kth"].to_numpy().astype(np.float64)
    carried = np.where(np.isnan(kth), np.inf, (queries**2).sum(1) + index.longest - 2 * kth)
    best = Best(np.full((len(q), k), np.inf), np.full((len(q), k), -1), carried)
    asked = right["lists"].combine_chunks()
    row_of = np.repeat(np.arange(len(q)), np.asarray(asked.value_lengths()))
    wanted = np.asarray(asked.flatten())
    by_list = np.argsort(wanted, kind="stable")
    order = np.argsort(list_of, kind="stable")
    x, c_rows, list_of = x[order], c_rows[order], list_of[order]
    c = index.lifted(x, False)
    for at in np.unique(list_of):
        a, b = np.searchsorted(list_of, [at, at + 1])
        i, j = np.searchsorted(wanted[by_list], [at, at + 1])
        if i < j:
            scan(q, q_rows, row_of[by_list[i:j]], c[a:b], c_rows[a:b], a, best)
    best.place = np.where(best.place >= 0, order[best.place], -1)
    return best, matrix(left["v"], index.dim), queries


def nearest(embeddings: DataFrame, is_query, k: int = 20, recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for each query (a condition on vec_id) among all rows but its own.

    Rows that are null, zero or not finite or have a null id take no part; each row of a repeated id is a candidate (and a query) of its
    own; shorter vectors count as followed by zeros; other columns are ignored; an empty table gives an empty result.
    Approximate: see the README for the measured recall.
    """
    spark = embeddings.sparkSession
    rows = valid(embeddings, nonzero=True)
    index = fit(rows, k, recall)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fitted = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = fitted.value
        for batch in batches:
            lists = index.nearest_lists(index.lifted(matrix(batch.column(2), index.dim), False), 1)[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists.astype(np.int32))], names=["row_no", "vec_id", "v", "list"])

    indexed = written(rows.mapInArrow(assign, "row_no long, vec_id long, v array<double>, list int"))
    sizes = np.zeros(len(index.centres), np.int64)
    asked = 0
    for r in indexed.groupBy("list").agg(F.count("*").alias("n"), F.count_if(is_query(F.col("vec_id"))).alias("q")).collect():  # a row for each list
        sizes[r.list] = r.n
        asked += r.q
    index.lay(sizes, BLOCK)
    laid = spark.sparkContext.broadcast(index)
    blocks = max(1, -(-asked // BLOCK))  # of queries
    first = max(1, round(FIRST * index.probes))

    def probing(a: int, b: int):
        """Sends each query to the cells of its a-th to b-th nearest lists, once to a cell."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = laid.value
            for batch in batches:
                lists = index.nearest_lists(index.lifted(matrix(batch.column(2), index.dim), True), b)[:, a:b]
                n = lists.shape[1]
                many = index.cells[lists].ravel()
                row, which = np.repeat(np.repeat(np.arange(len(lists)), n), many), np.repeat(lists.ravel(), many)
                cell = index.cell[which] + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
                order = np.lexsort((cell, row))
                row, cell, which = row[order], cell[order], which[order]
                new = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(cell, prepend=-1) != 0))
                held = pa.ListArray.from_arrays(pa.array(np.append(new, len(which)).astype(np.int32)), pa.array(which.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row[new])) for c in batch.columns), pa.array(cell[new].astype(np.int32)), held], names=["row_no", "vec_id", "v", "cell", "lists"])

        return run

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            best, x, q = search_cell(laid.value, left, right, k)
            q_rows, q_ids, ids = right["row_no"].to_numpy(), right["vec_id"].to_numpy(), left["vec_id"].to_numpy()
            for row in range(0, len(q), 256):  # exact products of a few queries at a time
                p, real = best.place[row : row + 256], best.place[row : row + 256] >= 0
                score = np.einsum("qd,qkd->qk", q[row : row + 256], x[p])
                own = lambda a: np.broadcast_to(a[row : row + 256, None], p.shape)[real]  # noqa: B023, E731
                for part, got in zip(out, (own(q_rows), own(q_ids), ids[p][real], score[real]), strict=True):
                    part.append(got)
        names, kinds = ("query_row", "query_id", "vec_id", "score"), (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table({name: pa.array(np.concatenate(part) if part else np.empty(0), kind) for name, part, kind in zip(names, out, kinds, strict=True)})

    cell_first, cell_many = (F.array(*[F.lit(int(x)) for x in a]) for a in (index.cell, index.cells))  # an entry for each list
    at = F.col("list") + 1
    cell = (F.element_at(cell_first, at) + block(F.element_at(cell_many, at))).cast("int")
    candidates = indexed.select("row_no", "vec_id", "v", "list", cell.alias("cell"), F.explode(copies(blocks)).alias("qb"))
    queries = rows.where(is_query(F.col("vec_id")))

    def found(asking: DataFrame) -> DataFrame:
        keys = ("cell", "qb")
        sides = candidates.groupBy(*keys).cogroup(asking.withColumn("qb", block(blocks)).groupBy(*keys))
        return sides.applyInArrow(search, "query_row long, query_id long, vec_id long, score double")

    kind = "row_no long, vec_id long, v array<double>, cell int, lists array<int>"
    near = written(found(queries.mapInArrow(probing(0, first), kind).withColumn("kth", F.lit(None).cast("double"))))
    if index.probes > first:
        bounds = kth_scores(near, k)
        asking = queries.mapInArrow(probing(first, index.probes), kind).join(bounds, F.col("row_no") == F.col("bound_of"), "left").drop("bound_of")
        near = near.unionByName(found(asking))
    return ranked(near, k).select("query_id", "rank", "vec_id", "score")
