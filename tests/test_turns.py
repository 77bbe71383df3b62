"""The micro-batches that queries over streams run in."""

from pyspark.sql import functions as F

from sessionloom.plans import streams as plans


def test_micro_batches_do_not_grow_with_the_rows(spark):
    rows = spark.range(4000).select((F.col("id") % 400).cast("string").alias("session_id"), F.floor(F.col("id") / 400).alias("ordinal"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as where partitions are large
    try:
        stream = plans.in_turn(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    seen = []
    stream.writeStream.foreachBatch(lambda b, n: seen.append({(r.session_id, r.ordinal) for r in b.collect()})).trigger(availableNow=True).start().awaitTermination()
    assert 2 <= len(seen) <= 4 and set().union(*seen) == {(str(k), n) for k in range(400) for n in range(10)}
    last = {}
    for batch in seen:
        for session, ordinal in sorted(batch, key=lambda x: x[1]):
            assert last.get(session, -1) < ordinal
            last[session] = ordinal
