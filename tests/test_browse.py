"""What browsing takes where many requests share a topic, or have none."""

from pyspark.sql import functions as F

from sessionloom.operators import search

from .metrics import most_rows


def trees(spark, n):
    """n sessions of a root and two children, of which one has the topic's word twice."""
    rows = spark.range(n).select(F.col("id").cast("string").alias("session_id"), F.explode(F.array(*[F.struct(F.lit(h).alias("handle"), F.lit(p).cast("string").alias("parent_handle"), F.lit(int(p is not None)).alias("depth"), F.lit(k).cast("long").alias("pos"), F.lit(t).alias("search_text")) for k, (h, p, t) in enumerate([("root", None, "top"), ("a", "root", "other words"), ("b", "root", "the The end")])])).alias("d"))
    return rows.select("session_id", "d.*").withColumns({"kind": F.lit("note"), "type": F.lit("x"), "role": F.lit("user"), "retrieval_visible": F.lit(True)})


def test_a_topic_of_many_requests_meets_their_own_children_alone(spark):
    n = 500
    docs = trees(spark, n)
    asked = docs.where("depth = 0").select(F.col("session_id").alias("request_id"), "session_id", "handle", F.lit("children").alias("zoom"), F.when(F.col("session_id").cast("int") % 2 == 0, "THE end the").otherwise("").alias("topic"))
    df = search.browse(docs, asked, 0, 5)
    assert most_rows(df) <= 10 * n  # not every request with every document of the word: n * n / 2
    got = sorted((int(r.request_id), r.place, r.handle, r.matched) for r in df.collect())
    assert got == sorted(x for k in range(n) for x in ([(k, 0, "b", 2)] if k % 2 == 0 else [(k, 0, "a", 0), (k, 1, "b", 0)]))
    index = search.build_search_index(docs)
    assert sorted((int(r.request_id), r.place, r.handle, r.matched) for r in search.browse(docs, asked, 0, 5, index).collect()) == got


def test_without_a_topic_no_text_is_split(spark):
    docs = trees(spark, 3)
    asked = docs.where("depth = 0").select(F.col("session_id").alias("request_id"), "session_id", "handle", F.lit("children").alias("zoom"), F.lit("").alias("topic"))
    df = search.browse(docs, asked, 0, 1).select("request_id", "handle", "place")
    assert "split(" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.request_id, r.handle, r.place) for r in df.collect()) == [(str(k), "a", 0) for k in range(3)]
