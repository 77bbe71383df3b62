"""Hard negatives against brute force, and the work that bounds spare."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.llm import bond, queries
from tests.oracles import compare, connect

SF = "/root/testdata/sf0.001"
ROWS = "vec_id long, embedding array<double>, label int, score long, row_no long, rank int, cb int"


def brute(rows, is_anchor, low=80, high=100, k=5):
    """rows: (id, whole vector, label). Triples per anchor row, positive row and rank, as sorted tuples."""
    out = []
    for i, (a, x, kind) in enumerate(rows):
        if not is_anchor(a):
            continue
        score = {j: int(sum(int(p) * int(q) for p, q in zip(x, y))) for j, (_, y, _) in enumerate(rows) if j != i}
        order = sorted(score, key=lambda j: (-score[j], rows[j][0]))
        for p in [j for j in order if rows[j][2] == kind][:k]:
            inside = [n for n in order if rows[n][2] != kind and low * score[p] <= 100 * score[n] <= high * score[p]]
            out += [(a, rows[p][0], r + 1, rows[n][0], score[p], score[n]) for r, n in enumerate(inside[:k])]
    return sorted(out)


def test_equals_sql(spark):
    assert compare(spark, connect(SF), "op11", queries.op11_hard_negatives, queries.oracle_sql()["op11_hard_negatives"], SF) == ""


@pytest.mark.parametrize("small", [False, True])
def test_by_brute_force(spark, monkeypatch, small):
    if small:  # many blocks of both sides
        monkeypatch.setattr(bond, "BLOCK", 40)
        monkeypatch.setattr(bond, "ANCHORS", 10)
    rng = np.random.default_rng(5)
    data = [(i, [float(v) for v in rng.normal(size=20)], int(rng.integers(3)) if i % 3 else 1) for i in range(200)]  # a hot label
    data += [(200 + i, data[i % 7][1], i % 3) for i in range(30)]  # copies in other labels, so ties
    data += [(300, [0.0] * 20, 1), (301, [1.0, 2.0], 0), (5, data[5][1], data[5][2])]  # zero, short, a repeated row
    odd = [(310, None, 1), (311, [1.0, None], 1), (312, [float("nan")], 1), (313, [float("inf")], 1), (314, [], 1), (315, [1.0], None), (None, [1.0], 1)]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in data + odd], ROWS).repartition(5)
    got = bond.hard_negatives(df, lambda i: i % 5 == 0)
    whole = [(i, np.floor(256 * np.array(v + [0.0] * (20 - len(v)))), kind) for i, v, kind in data]
    assert sorted(map(tuple, got.collect())) == brute(whole, lambda i: i % 5 == 0)


def test_edges(spark):
    empty = spark.createDataFrame([], ROWS)
    assert bond.hard_negatives(empty, lambda i: i % 2 == 0).count() == 0
    alone = spark.createDataFrame([(0, [1.0], 1, 0, 0, 0, 0), (1, [1.0], 2, 0, 0, 0, 0)], ROWS)
    assert bond.hard_negatives(alone, lambda i: i % 2 == 0).count() == 0  # no positive
    opposed = spark.createDataFrame([(0, [1.0], 1, 0, 0, 0, 0), (1, [-1.0], 1, 0, 0, 0, 0), (2, [-1.0], 2, 0, 0, 0, 0)], ROWS)
    assert bond.hard_negatives(opposed, lambda i: i == 0).count() == 0  # below zero a window is empty
    named = alone.withColumn("kind", F.lit("same"))
    assert [tuple(r) for r in bond.hard_negatives(named.union(named.withColumn("vec_id", F.col("vec_id") + 2).withColumn("kind", F.lit("other"))), lambda i: i == 0, F.col("kind")).collect()] == [(0, 1, 1, 2, 65536, 65536), (0, 1, 2, 3, 65536, 65536)]
    large = spark.createDataFrame([(k, [float(2**60)], k % 2, 0, 0, 0, 0) for k in range(4)], ROWS)
    with pytest.raises(Exception, match="exceeds a long"):
        bond.hard_negatives(large, lambda i: i == 0).collect()


def test_bounds_spare_work():
    """Multiply-adds beside those of all products."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20_000, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None])
    label = rng.integers(0, 10, len(x))
    own = [bond.Columns(x[label == k]) for k in range(10)]
    held, ids, spent, first, full_first = bond.Columns(x), np.arange(len(x)), 0, 0, 0
    for i in range(0, len(x), 400):
        ends = np.array([-np.inf]), np.array([np.inf])
        mine = own[label[i]]
        before = mine.work
        near = mine.scan(x[i], np.flatnonzero(label == label[i]) != i, *ends, 5)
        ((_, score),) = bond.best_of(mine, near, np.arange(mine.n), x[i], *ends, 5)
        first, full_first = first + mine.work - before, full_first + mine.n * 64
        wanted = np.unique(score)[::-1]
        low, high = -(-80 * wanted // 100), wanted
        near = held.scan(x[i], label != label[i], low.astype(float), high.astype(float), 5)
        bond.best_of(held, near, ids, x[i], low, high, 5)
        spent += 1
    assert first < 0.75 * full_first
    assert held.work < 0.65 * spent * x.size
