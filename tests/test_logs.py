"""Log files, folds against plain Python, streams in several batches."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sessionloom.functions import usage as U
from sessionloom.operators import events as E
from sessionloom.operators import spans as S
from sessionloom.sources import logs as L
from sessionloom.sources import sinks as K
from sessionloom.streaming import streams as R


@pytest.fixture
def folder(tmp_path):
    rows = [
        {"timestamp": "2024-01-01T00:00:00Z", "type": "session_meta", "payload": {"id": "s1", "cwd": "/w"}},
        {"timestamp": "2024-01-01T00:00:01Z", "type": "event_msg", "payload": {"type": "user_message", "message": "look data:image/png;base64,QUJD here"}},
        {"timestamp": "2024-01-01T00:00:02Z", "type": "response_item", "payload": {"type": "reasoning", "summary": [], "encrypted_content": "x"}},
        {"timestamp": "2024-01-01T00:00:03Z", "type": "response_item", "payload": {"type": "function_call", "call_id": "c1", "name": "run", "arguments": "{}"}},
        {"timestamp": "2024-01-01T00:00:04Z", "type": "response_item", "payload": {"type": "function_call_output", "call_id": "c1", "output": "done"}},
        {"timestamp": "2024-01-01T00:00:05Z", "type": "event_msg", "payload": {"type": "agent_message", "message": "ok"}},
        {"timestamp": "2024-01-01T00:00:06Z", "type": "compacted", "payload": {"message": "short"}},
        {"timestamp": "2024-01-01T00:00:07Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": 100, "cached_input_tokens": 70, "output_tokens": 20, "reasoning_output_tokens": 5, "total_tokens": 120}}}},
        {"timestamp": "2024-01-01T00:00:08Z", "type": "response_item", "payload": {"type": "web_search_call", "action": {"q": 1}}},
        {"timestamp": "2024-01-01T00:00:08Z", "type": "unheard_of", "payload": {}},
    ]
    text = "\r\n".join(json.dumps(r) for r in rows)
    (tmp_path / "run-0123abcd-0000-1111-2222-333344445555.jsonl").write_text(text + "\n\n{broken")
    (tmp_path / "other.txt").write_text("no log")
    return str(tmp_path)


def test_dialect_a(spark, folder):
    lines = L.read_session_lines(spark, folder)
    assert [r.line_no for r in lines.orderBy("line_no").collect()] == [*range(1, 11), 12]
    large = L.read_large_lines(spark, folder)
    assert sorted(large.select("line_no", "raw").collect()) == sorted(lines.select("line_no", "raw").collect())
    got = L.load_events(spark, "log_a", folder).orderBy("line_no").collect()
    assert [r.type for r in got] == ["metadata", "message", "reasoning", "tool_call", "tool_result", "message", "compaction", "usage", "tool_call", "agent_event"]
    assert got[1].text == "look [inline image/png data omitted] here" and got[3].call_id == got[4].call_id == "c1" and got[8].call_id == "web_search_9"
    assert got[7].usage.asDict() == {"input": 100, "output": 20, "cache_read": 70, "cache_write": 0, "reasoning": 5, "total": 120}
    assert got[0].session_id == "0123abcd-0000-1111-2222-333344445555" and got[0].declared_id == "s1"
    files = L.list_session_files(spark, folder).collect()
    assert len(files) == 1 and files[0].size > 100


def test_event_ids_are_unique(spark, folder):
    e = L.load_events(spark, "log_a", folder)
    assert e.select("event_id").distinct().count() == e.count()


def budget_fold(costs, budget):
    spent, out = 0.0, []
    for c in costs:
        fits = spent + c <= budget + 1e-9
        spent += c if fits else 0
        out.append(fits)
    return out


def test_budget_selection(spark):
    rng = random.Random(1)
    rows = [(k, i, float(rng.randint(1, 9))) for k in range(5) for i in range(12)]
    got = S.select_within_budget(spark.createDataFrame(rows, "session_id long, seq long, usd double"), ["session_id"], 20.0, 10).collect()
    for k in range(5):
        own = sorted((r.seq, r.selected) for r in got if r.session_id == k)
        assert [s for _, s in own] == budget_fold([u for a, i, u in rows if a == k and i < 10], 20.0)


def test_pairs_stay_together(spark):
    rows = [("a", 0, "tool_call", "c", 30), ("a", 1, "message", None, 30), ("a", 2, "tool_result", "c", 40), ("a", 3, "message", None, 10), ("b", 0, "message", None, 10), ("b", 1, "tool_call", "c", 10), ("b", 2, "message", None, 500), ("b", 3, "tool_result", "c", 10)]
    df = spark.createDataFrame(rows, "session_id string, ordinal long, type string, tool_call_id string, cost long")
    got = {(r.session_id, r.ordinal): r.group for r in S.pack_pairs(df, ["session_id"], 80).collect()}
    assert got["a", 0] == got["a", 1] == got["a", 2] and got["b", 0] == 0 and got["b", 1] == 1


def test_streams_equal_batches(spark, tmp_path):
    rng = random.Random(2)
    fields = list(U.FIELDS)
    rows = [(rng.randint(0, 3), i, rng.random() > 0.2, *[rng.randint(0, 50) for _ in range(5)]) for i in range(60)]
    df = spark.createDataFrame(rows, "key long, seq long, has boolean, input long, output long, cache_read long, cache_write long, reasoning long")
    df = df.select("key", "seq", F.when(F.col("has"), U.usage(**{f: F.col(f) for f in fields if f != "total"})).alias("total_usage"), U.usage(input=F.lit(3)).alias("last_usage"))
    at = str(tmp_path / "in")
    for part in range(3):  # one batch after the other
        df.where((F.col("seq") >= 20 * part) & (F.col("seq") < 20 * part + 20)).coalesce(1).write.mode("append").parquet(at)
    got = R.run_to_table(R.stream_usage_delta(R.as_stream(spark, at, 1)))
    want = E.usage_delta(df, ["key"], ["seq"]).select("key", "seq", "usage.*")
    assert sorted(got.collect()) == sorted(want.collect())


def test_publish_refuses_older_generations(spark, tmp_path):
    root = str(tmp_path / "docs")
    rows = spark.createDataFrame([("s", "h", 1)], "session_id string, handle string, n int")
    K.publish(spark, rows, root, rows, 3)
    with pytest.raises(ValueError):
        K.publish(spark, rows, root, rows, 3)
    with pytest.raises(ValueError):
        K.publish(spark, rows.select("session_id", "handle"), root, rows, 4)
    assert K.current_generation(spark, root) == 3
