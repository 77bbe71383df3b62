"""Publishing by bucket: what is touched, what survives a crash, what is cleared."""

import pytest
from pyspark.sql import functions as F

from sessionloom.sources import sinks
from sessionloom.streaming import streams

ROWS = "session_id string, turn long, text string"


def build(log):
    return log.groupBy("session_id").agg(F.count("*").alias("n"), F.concat_ws("|", F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x.text)).alias("head")).withColumn("handle", F.lit("h"))


def heads(spark, root):
    return {r.session_id: r.head for r in streams.latest_docs(spark, root).collect()}


def batch(spark, k, sessions):
    return spark.createDataFrame([(f"s{i}", k, f"t{k}-{i}") for i in sessions], ROWS)


def test_batches_touch_their_buckets_alone(spark):
    root = sinks.shared_folder(spark)
    publish = streams.publish_batch(spark, root, build, buckets=8)
    publish(batch(spark, 0, range(30)), 0)
    before = sinks.last_commit(spark, root)
    assert len(before.rows) > 4 and heads(spark, root) == {f"s{i}": f"t0-{i}" for i in range(30)}
    publish(batch(spark, 1, [3]), 1)
    after = sinks.last_commit(spark, root)
    assert sum(before.rows[b] != after.rows[b] for b in before.rows) == 1 and sum(len(v) for v in after.log.values()) == len(before.log) + 1
    assert heads(spark, root) == {f"s{i}": f"t0-{i}" for i in range(30)} | {"s3": "t0-3|t1-3"}


@pytest.mark.parametrize("where", ["build", "commit"])
def test_a_batch_that_died_halfway_is_published_on_restart(spark, monkeypatch, where):
    root = sinks.shared_folder(spark)
    streams.publish_batch(spark, root, build)(batch(spark, 0, [1, 2]), 0)

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        if where == "commit":
            m.setattr(streams, "commit", dies)
        with pytest.raises(RuntimeError, match="lost"):
            streams.publish_batch(spark, root, dies if where == "build" else build)(batch(spark, 1, [2, 3]), 1)
    assert heads(spark, root) == {"s1": "t0-1", "s2": "t0-2"}  # readers see the batch before, whole
    publish = streams.publish_batch(spark, root, build)
    publish(batch(spark, 1, [2, 3]), 1)
    want = {"s1": "t0-1", "s2": "t0-2|t1-2", "s3": "t1-3"}
    assert heads(spark, root) == want
    publish(batch(spark, 1, [2, 3]), 1)  # again, after its commit
    publish(batch(spark, 0, [1]), 0)
    assert heads(spark, root) == want
    gone = sinks.vacuum(spark, root, keep=1)
    assert len(gone) >= 2 and heads(spark, root) == want and sinks.vacuum(spark, root, keep=1) == []


def test_a_half_written_folder_hides_nothing(spark):
    """What a dying writer leaves: folders with _temporary alone, a commit file that was not renamed."""
    root = sinks.shared_folder(spark)
    publish = streams.publish_batch(spark, root, build)
    publish(batch(spark, 0, [1]), 0)
    for path in ("data/dead/_temporary", "log/dead/_temporary", "docs/batch=1/_temporary", "commits/.half"):
        fs, p = sinks._fs(spark, f"{root}/{path}")
        fs.mkdirs(p)
    publish(batch(spark, 1, [1]), 1)
    assert heads(spark, root) == {"s1": "t0-1|t1-1"}


def test_logs_are_put_together(spark, monkeypatch):
    monkeypatch.setattr(streams, "MOST_LOGS", 3)
    root = sinks.shared_folder(spark)
    publish = streams.publish_batch(spark, root, build, buckets=1)
    for k in range(6):
        publish(batch(spark, k, [1, k]), k)
    assert len(sinks.last_commit(spark, root).log[0]) <= 3
    assert heads(spark, root)["s1"] == "|".join(f"t{k}-1" for k in range(6) for _ in range(2 if k == 1 else 1))


def test_empty_sessions_go_and_columns_may_come(spark):
    root = sinks.shared_folder(spark)
    make = lambda rows, more="": spark.createDataFrame(rows, "session_id string, handle string" + more)
    assert sinks.read_collection(spark, root) is None and sinks.current_generation(spark, root) == -1
    sinks.publish(spark, make([("a", "1"), ("b", "2")]), root, make([("a", ""), ("b", "")]), 1, buckets=4)
    sinks.publish(spark, make([("a", "3", 7)], ", more int"), root, make([("a", "")]), 2)
    assert sorted((r.session_id, r.handle, r.more) for r in sinks.read_collection(spark, root).collect()) == [("a", "3", 7), ("b", "2", None)]
    sinks.publish(spark, make([], ", more int"), root, make([("a", ""), ("b", "")]), 3)
    assert sinks.read_collection(spark, root).count() == 0
    with pytest.raises(ValueError, match="missing or of another type"):
        sinks.publish(spark, make([("c", "1")]), root, make([("c", "")]), 4)
    with pytest.raises(ValueError, match="not newer"):
        sinks.publish(spark, make([("c", "1", 1)], ", more int"), root, make([("c", "")]), 3)
    stale = sinks.last_commit(spark, root)
    with pytest.raises(RuntimeError, match="another writer"):
        sinks.commit(spark, root, stale)


def test_five_batches_of_a_stream(spark):
    at, root = sinks.shared_folder(spark), sinks.shared_folder(spark)
    for k in range(5):
        batch(spark, k, [k, 9]).coalesce(1).write.mode("append").parquet(at)
        if k in (1, 4):  # the stream runs twice, and goes on where it was
            streams.stream_index(streams.as_stream(spark, at), root, build)
    assert heads(spark, root) == {f"s{k}": f"t{k}-{k}" for k in range(5)} | {"s9": "|".join(f"t{k}-9" for k in range(5))}
    assert sinks.current_generation(spark, root) == 4
