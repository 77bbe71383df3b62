"""Queries that run streams over the tables, and sinks; their SQL is that of the batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import usage as U
from ..sources import sinks as K
from ..sources import tails as A
from ..streaming import streams as R
from .catalog import query, table
from .finding import MANIFEST, manifest
from .scalars import preview_sql, tokens_sql
from .trees import DOCS, docs
from .windows import _FIELDS, _LINKED, EVENTS, events, linked


def landed(df):
    """The rows as a stream over files that were just written to the shared folder."""
    at = K.shared_folder(df.sparkSession)
    df.write.parquet(at)
    return R.as_stream(df.sparkSession, at, 1000)


def in_turn(df, cuts=(2, 5)):
    """The rows as a stream of several micro-batches, in the order of their ordinals: written one after the other, a session's in
    one file of each. A micro-batch takes as many files as a cut has, so that their number does not grow with the rows."""
    at, files = K.shared_folder(df.sparkSession), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for a, b in zip((0, *cuts), (*cuts, 1 << 62)):
        df.where(F.col("ordinal").between(a, b - 1)).repartition(files, "session_id").write.mode("append").parquet(at)
    return R.as_stream(df.sparkSession, at, files)


def usage_rows(e):
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_type") != "error", U.usage(**{f: F.expr(x) for f, x in _FIELDS.items()})).alias("total_usage"), U.usage(input=F.col("event_id") % 5).alias("last_usage"))


def _win_01_sql() -> str:
    from .catalog import _SQL

    return f"SELECT event_id AS seq, * EXCLUDE (event_id) FROM ({_SQL['win_01_usage_delta']})"


@query("str_05_usage_delta", _win_01_sql())
def str_05(spark, sf):
    return R.run_to_table(R.stream_usage_delta(usage_rows(landed(table(spark, sf, "events"))))).drop("key")


@query("str_06_reply_anchors", f"WITH {_LINKED} SELECT session_id, ordinal, in_reply_to FROM k")
def str_06(spark, sf):
    return R.run_to_table(R.stream_links(in_turn(linked(spark, sf).select("session_id", "ordinal", "type", "role", "message_id", "turn_id"))))


@query("str_02_coalesce_changes", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 6 HOURS THEN 1 ELSE 0 END AS cut FROM events), s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT '/logs/' || user_id AS path, min(ts) AS first_at, max(ts) + INTERVAL 6 HOURS AS quiet_at, count(*) AS changes FROM s GROUP BY user_id, k""")
def str_02(spark, sf):
    e = table(spark, sf, "events").select(F.concat(F.lit("/logs/"), "user_id").alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    end = e.agg(F.max("ts") + F.expr("INTERVAL 30 DAYS")).first()[0]  # a later change closes the windows before it
    last = spark.createDataFrame([("", end)], e.schema)
    stream = R.coalesce_changes(landed(e.unionByName(last)), "6 hours", "10 days")
    out = R.run_to_table(stream).where("path <> ''")
    return out.select("path", F.col("first_at").cast("timestamp_ntz").alias("first_at"), F.col("quiet_at").cast("timestamp_ntz").alias("quiet_at"), "changes")


@query("str_03_stream_markers", "SELECT b.text AS marker, source AS path, doc_id AS line_no FROM documents d JOIN (SELECT DISTINCT text FROM benchmark) b ON contains(d.text, b.text)")
def str_03(spark, sf):
    lines = landed(table(spark, sf, "documents")).select(F.col("source").alias("path"), F.col("doc_id").alias("line_no"), F.col("text").alias("raw"))
    return R.run_to_table(R.stream_markers(lines, table(spark, sf, "benchmark").select(F.col("text").alias("marker")).distinct()))


_LINE = "replace(replace(text, chr(10), ' '), chr(13), ' ')"


def line_files(spark, sf):
    """The documents as lines of log files, each with its id in front."""
    at = K.shared_folder(spark)
    lines = table(spark, sf, "documents").select((F.col("doc_id") % 3).alias("folder"), F.concat_ws(" ", F.col("doc_id").cast("string"), F.translate("text", "\n\r", "  ")).alias("value"))
    lines.write.partitionBy("folder").text(at)
    return at


@query("str_03b_appended_markers", f"SELECT b.text AS marker, doc_id FROM documents d JOIN (SELECT DISTINCT text FROM benchmark) b ON contains(doc_id || ' ' || {_LINE.replace('text', 'd.text')}, b.text)")
def str_03b(spark, sf):
    lines = A.stream_lines(spark, line_files(spark, sf), ".txt").withColumn("line_no", F.split_part("raw", F.lit(" "), F.lit(1)).cast("long"))
    found = R.run_to_table(R.stream_markers(lines, table(spark, sf, "benchmark").select(F.col("text").alias("marker")).distinct()))
    return found.select("marker", F.col("line_no").alias("doc_id"))


@query("src_07b_read_tails", f"WITH f AS (SELECT doc_id % 3 AS folder, doc_id, strlen(doc_id || ' ' || {_LINE}) + 1 AS n FROM documents) SELECT folder, count(*) AS lines, sum(n)::BIGINT AS bytes FROM f GROUP BY 1")
def src_07b(spark, sf):
    """The tails of log files, as long as the files: all lines."""
    at = line_files(spark, sf)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(at).select("path", F.col("length").alias("size"))
    got = A.read_tails(files, 1 << 40).withColumn("folder", F.regexp_extract("path", "folder=([0-9]+)", 1).cast("long"))
    return got.groupBy("folder").agg(F.count("*").alias("lines"), F.sum(F.octet_length("raw") + 1).alias("bytes"))


@query("str_04_await_markers", "SELECT event_type || (user_id % 50) AS marker, CASE WHEN count(DISTINCT user_id) = 1 THEN 'found' ELSE 'ambiguous' END AS status FROM events GROUP BY 1")
def str_04(spark, sf):
    return R.run_to_table(R.await_markers(landed(table(spark, sf, "events").select(F.concat("event_type", (F.col("user_id") % 50).cast("string")).alias("marker"), F.concat(F.lit("/logs/"), "user_id").alias("path"))), None)).select("marker", "status")


@query("str_07_stream_dedupe", "SELECT source, lang, sha256(text) AS text_hash FROM documents GROUP BY ALL")
def str_07(spark, sf):
    d = landed(table(spark, sf, "documents")).select(F.col("source").alias("session_id"), F.col("lang").alias("role"), "text", F.timestamp_seconds(F.lit(1_700_000_000)).alias("ts"))
    return R.run_to_table(R.stream_dedupe(d)).select(F.col("session_id").alias("source"), F.col("role").alias("lang"), F.sha2("text", 256).alias("text_hash"))


@query("str_08_ready_batches", f"""WITH RECURSIVE {EVENTS}, c AS (SELECT session_id, ordinal, boundary, {tokens_sql('text')} AS cost FROM ev),
    f AS (SELECT session_id, ordinal, boundary, CASE WHEN boundary THEN 0 ELSE cost END AS total, 0::BIGINT AS slot, NOT boundary AS held FROM c WHERE ordinal = 0
      UNION ALL SELECT c.session_id, c.ordinal, c.boundary, CASE WHEN c.boundary THEN 0 WHEN f.held AND f.total + c.cost <= 80 THEN f.total + c.cost ELSE c.cost END, CASE WHEN f.held AND (c.boundary OR f.total + c.cost > 80) THEN f.slot + 1 ELSE f.slot END, NOT c.boundary
      FROM f JOIN c ON c.session_id = f.session_id AND c.ordinal = f.ordinal + 1), l AS (SELECT session_id, arg_max(slot, ordinal) AS last FROM f GROUP BY 1)
    SELECT session_id, slot, ordinal FROM f JOIN l USING (session_id) WHERE NOT boundary AND slot < last""")
def str_08(spark, sf):
    return R.run_to_table(R.stream_level_one(in_turn(events(spark, sf).select("session_id", "ordinal", T.estimate_tokens(F.col("text")).alias("cost"), (F.col("line_no") % 3 == 2).alias("is_boundary"))), 80))


@query("str_01_stream_index", f"SELECT conv_id::VARCHAR AS session_id, turn::VARCHAR AS handle, {preview_sql('text', 60)} AS head FROM conversations")
def str_01(spark, sf):
    root = K.shared_folder(spark)
    lines = landed(table(spark, sf, "conversations")).select(F.col("conv_id").cast("string").alias("session_id"), "turn", "text")
    R.stream_index(lines, root, lambda log: log.select("session_id", F.col("turn").cast("string").alias("handle"), T.preview(F.col("text"), 60).alias("head")))
    return R.latest_docs(spark, root).select("session_id", "handle", "head")


@query("snk_01_docs_store", f"WITH {DOCS} SELECT session_id, handle, full_tokens::BIGINT AS full_tokens, CASE WHEN full_text = '' THEN '' END AS excerpt FROM dc")
def snk_01(spark, sf):
    at = K.shared_folder(spark)
    d = docs(spark, sf)
    K.write_docs(d, at)
    return K.read_docs(spark, at, d.groupBy("session_id").agg(F.count("*").alias("docs"))).select("session_id", "handle", "full_tokens", "excerpt")


@query("snk_02_publish", "SELECT conv_id::VARCHAR AS session_id, turn::VARCHAR AS handle, CASE WHEN conv_id % 2 = 0 THEN 'new' ELSE 'old' END AS state FROM conversations WHERE NOT (conv_id % 2 = 0 AND turn > 2)")
def snk_02(spark, sf):
    root = K.shared_folder(spark)
    rows = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("string").alias("handle"), F.lit("old").alias("state"), "conv_id", "turn")
    K.publish(spark, rows, root, rows, 1)
    even = rows.where("conv_id % 2 = 0")
    K.publish(spark, even.where("turn <= 2").withColumn("state", F.lit("new")), root, even, 2)
    return K.read_collection(spark, root).select("session_id", "handle", "state")


@query("snk_04_headers", f"WITH {MANIFEST} SELECT 'idx-' || substr(sha256(session_id), 1, 32) AS index_id, session_id, source_path, updated_at FROM mf")
def snk_04(spark, sf):
    return K.headers(manifest(spark, sf))


COMPACTED = f"{EVENTS}, ce AS (SELECT *, CASE WHEN boundary THEN 'compaction' ELSE 'message' END AS type FROM ev)"


def compacted(spark, sf):
    return events(spark, sf).withColumn("type", F.when(F.col("line_no") % 3 == 2, "compaction").otherwise("message"))


@query("snk_05_export_linked", f"""WITH {COMPACTED}, i AS (SELECT *, substr(sha256(session_id || '|' || ordinal), 1, 8) AS entry_id, {tokens_sql('text')} AS cost FROM ce)
    SELECT session_id, ordinal, entry_id, lag(entry_id) OVER w AS parent_id, type AS entry_type, CASE WHEN type = 'compaction' THEN lead(entry_id) OVER w END AS first_kept_id, CASE WHEN type = 'compaction' THEN coalesce(sum(cost) OVER (PARTITION BY session_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT END AS tokens_before
    FROM i WINDOW w AS (PARTITION BY session_id ORDER BY ordinal)""")
def snk_05(spark, sf):
    return K.export_linked(compacted(spark, sf)).select("session_id", "ordinal", "entry_id", "parent_id", "entry_type", "first_kept_id", "tokens_before")


@query("snk_06_after_compaction", f"WITH {COMPACTED}, l AS (SELECT *, max(CASE WHEN boundary THEN ordinal END) OVER (PARTITION BY session_id) AS last FROM ce) SELECT session_id, CASE WHEN ordinal = last THEN 0 ELSE 1 END AS section, ordinal, CASE WHEN ordinal = last THEN 'system' ELSE role END AS role, text FROM l WHERE ordinal >= last")
def snk_06(spark, sf):
    return K.export_after_compaction(compacted(spark, sf))


@query("snk_07_reset_sessions", "SELECT conv_id::VARCHAR AS session_id, count(*) AS left_rows, (conv_id % 4 = 1)::BIGINT AS generation FROM conversations WHERE conv_id % 4 <> 0 GROUP BY conv_id")
def snk_07(spark, sf):
    rows = events(spark, sf)
    gone = rows.where("cast(session_id as long) % 4 = 0").select("session_id")
    bumped = rows.where("cast(session_id as long) % 4 = 1").select("session_id")
    generations = K.bump_generations(rows.select("session_id").distinct().withColumn("generation", F.lit(0).cast("long")), bumped)
    return K.reset_sessions(rows, gone).groupBy("session_id").agg(F.count("*").alias("left_rows")).join(generations, "session_id")


@query("src_02_session_files", "SELECT count(DISTINCT conv_id % 5) AS folders, sum(strlen(text) + 1)::BIGINT AS bytes FROM (SELECT conv_id, replace(replace(text, chr(10), ' '), chr(13), ' ') AS text FROM conversations)")
def src_02(spark, sf):
    from ..sources import logs as L

    at = K.shared_folder(spark)
    lines = table(spark, sf, "conversations").select((F.col("conv_id") % 5).alias("folder"), F.translate("text", "\n\r", "  ").alias("value"))
    lines.write.partitionBy("folder").text(at)
    files = L.list_session_files(spark, at, pattern="*.txt")
    return files.agg(F.count_distinct(F.regexp_extract("path", "folder=([0-9]+)", 1)).alias("folders"), F.sum("size").alias("bytes"))


@query("src_09_read_docs", f"WITH {DOCS} SELECT session_id, count(*) AS docs, sum(full_tokens)::BIGINT AS tokens FROM dc WHERE session_id::INT % 2 = 0 GROUP BY 1")
def src_09(spark, sf):
    at = K.shared_folder(spark)
    d = docs(spark, sf)
    K.write_docs(d, at)
    even = d.where("cast(session_id as int) % 2 = 0").groupBy("session_id").agg(F.count("*").alias("docs"))
    return K.read_docs(spark, at, even).groupBy("session_id").agg(F.count("*").alias("docs"), F.sum("full_tokens").alias("tokens"))


@query("str_10_publish_batches", f"SELECT conv_id::VARCHAR AS session_id, turn::VARCHAR AS handle, {preview_sql('text', 60)} AS head FROM conversations")
def str_10(spark, sf):
    root = K.shared_folder(spark)
    publish = R.publish_batch(spark, root, lambda log: log.select("session_id", F.col("turn").cast("string").alias("handle"), T.preview(F.col("text"), 60).alias("head")))
    rows = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), "turn", "text")
    for batch, part in enumerate(("turn < 2", "turn >= 2", "turn >= 2")):  # the last one again, under the same id
        publish(rows.where(part), min(batch, 1))
    return R.latest_docs(spark, root).select("session_id", "handle", "head")
