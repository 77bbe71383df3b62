"""Keyed streams over several micro-batches, and time-outs that fire."""

import random
import time

from pyspark.sql import functions as F

from sessionloom.operators import events as E
from sessionloom.sources import sinks
from sessionloom.streaming import streams


def in_batches(spark, df, order, parts=5):
    """The rows as files that a stream takes one by one, cut by place in the order."""
    at = sinks.shared_folder(spark)
    rows = sorted(df.collect(), key=lambda r: r[order])
    step = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * step : (k + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(at)
        time.sleep(0.02)  # files in the order of their times
    return streams.as_stream(spark, at, 1)


def test_reply_anchors_over_five_batches(spark):
    rng = random.Random(2)
    rows = []
    for s in ("a", "b", "c"):
        for i in range(40):
            kind = rng.choice(["message", "message", "tool_call", "context", "reasoning", "metadata"])
            rows.append((s, i, kind, rng.choice(["user", "assistant"]) if kind == "message" else "assistant", f"m{s}{i}", rng.choice(["t1", None]) if kind == "context" else None))
    df = spark.createDataFrame(rows, "session_id string, ordinal long, type string, role string, message_id string, turn_id string")
    got = streams.run_to_table(streams.stream_links(in_batches(spark, df, "ordinal"))).collect()
    want = E.annotate_links(df).select("session_id", "ordinal", "in_reply_to").collect()
    key = lambda r: (r[0], r[1])
    assert [tuple(r) for r in sorted(got, key=key)] == [tuple(r) for r in sorted(want, key=key)] and len(got) == len(rows)
    assert sum(r.in_reply_to is not None for r in got) > 20


def test_ready_groups_over_five_batches(spark):
    rng = random.Random(3)
    rows = [(s, i, rng.randint(1, 30), rng.random() < 0.1) for s in ("a", "b") for i in range(60)]
    df = spark.createDataFrame(rows, "session_id string, ordinal long, cost long, is_boundary boolean")
    got = streams.run_to_table(streams.stream_level_one(in_batches(spark, df, "ordinal"), 70)).collect()
    want = set()
    for s in ("a", "b"):
        slot, held, total = 0, [], 0
        for _, i, cost, boundary in (r for r in rows if r[0] == s):
            if held and (boundary or total + cost > 70):
                want |= {(s, slot, o) for o in held}
                slot, held, total = slot + 1, [], 0
            if not boundary:
                held.append(i)
                total += cost
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 60


def until(check, seconds=60):
    end = time.time() + seconds
    while time.time() < end:
        if check():
            return True
        time.sleep(0.3)
    return False


def test_a_wait_times_out_unless_a_path_comes(spark):
    at, out = sinks.shared_folder(spark), sinks.shared_folder(spark)
    kind = "marker string, path string"

    def add(*rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(at)

    add(("late", None), ("soon", None), ("now", "/p"))
    stream = streams.await_markers(streams.as_stream(spark, at), 8_000)
    running = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(processingTime="500 milliseconds").start()
    seen = lambda: {(r.marker, r.status, r.path) for r in spark.read.schema(stream.schema).parquet(out).collect()}
    try:
        assert until(lambda: ("late", "waiting", None) in seen())
        add(("soon", "/q"), ("now", "/r"))
        assert until(lambda: ("late", "timeout", None) in seen())
        assert until(lambda: ("now", "ambiguous", "/p") in seen())
    finally:
        running.stop()
    assert seen() == {("late", "waiting", None), ("late", "timeout", None), ("soon", "waiting", None), ("soon", "found", "/q"), ("now", "found", "/p"), ("now", "ambiguous", "/p")}


def test_hits_over_several_batches(spark):
    df = spark.createDataFrame([(k, m, p) for k, (m, p) in enumerate([("a", "/1"), ("b", "/1"), ("a", "/1"), ("b", "/2"), ("c", None), ("a", "/1"), ("c", "/3")])], "k long, marker string, path string")
    got = streams.run_to_table(streams.await_markers(in_batches(spark, df, "k", 7).select("marker", "path"), None)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("a", "found", "/1"), ("b", "found", "/1"), ("b", "ambiguous", "/1"), ("c", "waiting", None), ("c", "found", "/3")], key=str)
