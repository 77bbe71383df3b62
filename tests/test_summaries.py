"""What rounds of summaries write, and what their result is read from."""

from sessionloom.operators import spans, summaries
from sessionloom.sources import sinks


def test_rounds_write_texts_once_and_the_result_is_one_scan(spark, monkeypatch):
    lines = {"a": 9, "b": 4, "c": 1}
    leaves = spark.createDataFrame([(s, f"h{i}", i) for s, n in lines.items() for i in range(n)], "session_id string, handle string, seq long")
    records = spark.createDataFrame([(s, f"h{i}", 0, f"line {i} of {s}") for s, n in lines.items() for i in range(n)], "session_id string, handle string, pos long, record string")
    tables, new = [], sinks.shared_folder
    monkeypatch.setattr(sinks, "shared_folder", lambda s: tables.append(new(s)) or tables[-1])
    _, got = summaries.summarize_to_roots(leaves, records, "v1", 8)
    rows = got.collect()
    rounds = max(r.level for r in rows) + 1  # a root comes in the round after its top spans
    assert rounds >= 3 and {r.session_id for r in rows if r.level == 0} == set(lines)
    assert len(tables) <= 3 * rounds  # inputs, summaries, spans
    assert got._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1


def test_packing_needs_no_count_of_keys_whose_size_is_known(spark):
    df = spark.createDataFrame([(k, i, 3 + i % 5) for k in "ab" for i in range(20)], "k string, i long, c long")
    packed = lambda most: sorted(tuple(r) for r in spans.pack_greedy(df, ["k"], "i", df.c, 10, most).collect())
    assert packed(None) == packed(20) == packed(spans.FOLD + 1)
