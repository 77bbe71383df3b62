"""Packing of calls with their results: by a plain scan of all pairs, over many small keys and one large key."""

import random
import time

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import spans


def scanned(costs, kinds, ids, budget, stretch=2):
    """Every group looks at all pairs."""
    call = {i: k for k, (t, i) in enumerate(zip(kinds, ids, strict=True)) if t == "tool_call" and i is not None}
    pairs = [(call[i], k) for k, (t, i) in enumerate(zip(kinds, ids, strict=True)) if t == "tool_result" and i in call and call[i] < k]
    groups, a, g = [0] * len(costs), 0, 0
    while a < len(costs):
        b, total = a + 1, costs[a]
        while b < len(costs) and total + costs[b] <= budget:
            total += costs[b]
            b += 1
        while crossed := [(c, r) for c, r in pairs if a <= c < b <= r]:
            reach = max(r for _, r in crossed) + 1
            if sum(costs[a:reach]) <= stretch * budget:
                b = reach
                continue
            first = min(c for c, _ in crossed)
            b = first if first > a else b
            break
        groups[a:b] = [g] * (b - a)
        a, g = b, g + 1
    return groups


@pytest.mark.parametrize("batch", [10_000, 7])
def test_pack_pairs_by_plain_python(spark, batch):
    rng = random.Random(5)
    keys = {}
    for k in [None, *range(60)]:
        n = rng.randint(1, 40)
        kinds = [rng.choice(["message", "tool_call", "tool_result", "tool_result"]) for _ in range(n)]
        keys[k] = [(rng.choice([0, 1, 3, 5, 12]), kind, None if rng.random() < 0.1 else f"c{rng.randint(0, 6)}") for kind in kinds]
    rows = [(k, span, i, *r) for k, rs in keys.items() for span in (0, 1) for i, r in enumerate(rs if span == 0 else rs[::-1])]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        df = spark.createDataFrame(rows, "k int, span long, ordinal long, cost long, type string, tool_call_id string")
        got = {(r.k, r.span, r.ordinal): r.group for r in spans.pack_pairs(df, ["k", "span"], 10).collect()}
        assert spans.pack_pairs(df.limit(0), ["k", "span"], 10).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for k, rs in keys.items():
        for span in (0, 1):
            costs, kinds, ids = zip(*(rs if span == 0 else rs[::-1]), strict=True)
            want |= {(k, span, i): g for i, g in enumerate(scanned(costs, kinds, ids, 10))}
    assert got == want


def test_a_null_cost_is_alone(spark):
    df = spark.createDataFrame([("s", i, c, "message", None) for i, c in enumerate([1, 1, None, 1, 1])], "k string, ordinal long, cost long, type string, tool_call_id string")
    assert [r.group for r in spans.pack_pairs(df, ["k"], 10).orderBy("ordinal").collect()] == [0, 0, 1, 2, 2]


def test_python_is_not_called_for_each_key(spark):
    """One key of many calls, whose results come at once, and 20,000 keys of two rows."""
    kind = F.when(F.col("id") % 2 == 0, "tool_call").otherwise("tool_result")
    row = lambda n, k: spark.range(n).select(k.alias("k"), F.col("id").alias("ordinal"), F.lit(4).cast("long").alias("cost"), kind.alias("type"), F.expr("concat('c', id div 2)").alias("tool_call_id"))
    rows = row(40_000, F.expr("id div 2")).unionByName(row(40_000, F.lit(-1).cast("long")))
    df = spans.pack_pairs(rows, ["k"], 8)
    assert "MapInArrow" in df._jdf.queryExecution().executedPlan().toString()
    began = time.time()
    assert df.groupBy("k", "group").count().where("count <> 2").count() == 0
    assert time.time() - began < 30
