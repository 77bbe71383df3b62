"""Queries on summaries: packing, reuse, commits, revisions, publishing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import spans as P
from ..operators import summaries as S
from ..sources.sinks import written
from .catalog import query, table
from .scalars import tokens_sql
from .windows import _SPANS, EVENTS, boundary, events


@query("prj_20_child_records", "SELECT conv_id, turn, text IS NOT NULL AS has_text, role FROM conversations")
def prj_20(spark, sf):
    e = events(spark, sf).withColumns({"level": F.lit(1), "tool_name": F.lit(None).cast("string"), "call_id": F.lit(None).cast("string"), "summary": F.lit(""), "tokens": F.lit(0), "start_at": F.lit(0), "end_at": F.lit(0)})
    r = S.child_records(e).withColumn("back", F.from_json("record", "role string, text string, tool_name string"))
    return r.select(F.col("session_id").cast("long").alias("conv_id"), F.col("line_no").alias("turn"), (F.col("back.text") == F.col("text")).alias("has_text"), "back.role")


def costs(df):
    return df.withColumn("cost", T.estimate_tokens(F.col("text")))


def level_one(spark, sf, budget=60):
    e = written(costs(events(spark, sf)).select("session_id", "line_no", "ordinal", "role", "cost"))  # read several times, without the texts
    closed = P.compaction_spans(e, boundary(), F.col("role") != "system")
    tail = P.live_tail(e, boundary(), F.col("role").isin("user", "assistant"))
    return S.level_one_spans(e, closed, tail, budget)


LEVEL_ONE = f"""{_SPANS}, lt AS (SELECT *, coalesce(max(CASE WHEN boundary THEN ordinal END) OVER (PARTITION BY session_id), -1) AS lastb FROM ev),
  src AS (SELECT session_id, span, ordinal, {tokens_sql('text')} AS cost FROM spans UNION ALL SELECT session_id, 1073741824, ordinal, {tokens_sql('text')} FROM lt WHERE ordinal > lastb AND role IN ('user', 'assistant')),
  sn AS (SELECT *, row_number() OVER (PARTITION BY session_id, span ORDER BY ordinal) AS n FROM src),
  pk AS (SELECT session_id, span, ordinal, cost, n, cost AS total, 0::BIGINT AS g FROM sn WHERE n = 1
    UNION ALL SELECT s.session_id, s.span, s.ordinal, s.cost, s.n, CASE WHEN pk.total + s.cost <= 60 THEN pk.total + s.cost ELSE s.cost END, CASE WHEN pk.total + s.cost <= 60 THEN pk.g ELSE pk.g + 1 END
    FROM pk JOIN sn s ON s.session_id = pk.session_id AND s.span = pk.span AND s.n = pk.n + 1),
  pg AS (SELECT *, max(g) OVER (PARTITION BY session_id, span) AS lastg, sum(cost) OVER (PARTITION BY session_id, span, g) AS gt FROM pk),
  l1 AS (SELECT session_id, ordinal, cost, dense_rank() OVER (PARTITION BY session_id ORDER BY span, g) - 1 AS slot FROM pg WHERE span < 1073741824 OR g < lastg OR gt >= 60)"""


@query("hi_07_level_one_spans", f"WITH RECURSIVE {LEVEL_ONE} SELECT session_id, ordinal, 'summary/level-1/span-' || lpad(slot::VARCHAR, 4, '0') AS handle FROM l1")
def hi_07(spark, sf):
    return level_one(spark, sf).select("session_id", "ordinal", "handle")


@query("hi_08_rollup_levels")
def hi_08(spark, sf):
    one = level_one(spark, sf, 30).groupBy("session_id", "handle").agg(F.min("slot").alias("seq"), F.sum("cost").alias("tokens"))
    return S.rollup_levels(one, 80)


_STATUS = "CASE WHEN event_id % 7 = 3 THEN 'pending' WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'error' ELSE 'completed' END"


_SPAN_STATUS = "CASE WHEN user_id % 3 = 0 AND event_id % 7 = 3 THEN 'pending' WHEN user_id % 5 = 0 AND event_type = 'error' THEN 'error' ELSE 'completed' END"


@query("hi_09_root_candidates", f"SELECT user_id::VARCHAR AS session_id, count(*) AS spans FROM (SELECT *, {_SPAN_STATUS} AS status FROM events) GROUP BY 1 HAVING bool_and(status = 'completed')")
def hi_09(spark, sf):
    e = table(spark, sf, "events")
    return S.root_candidates(e.select(F.col("user_id").cast("string").alias("session_id"), F.expr(_SPAN_STATUS).alias("status")))


@query("hi_10_summary_inputs", "SELECT conv_id::VARCHAR AS session_id, string_agg(role || '|' || text, chr(10) ORDER BY turn) AS input, count(*) AS n_children, sha256(string_agg(role || '|' || text, chr(10) ORDER BY turn)) AS source_hash FROM conversations GROUP BY 1")
def hi_10(spark, sf):
    e = events(spark, sf).select("session_id", F.col("ordinal").alias("pos"), F.concat_ws("|", "role", "text").alias("record"))
    return S.summary_inputs(e, ["session_id"])


@query(
    "hi_10b_update_inputs",
    f"""WITH {EVENTS}, r AS (SELECT session_id, ordinal, role || '|' || text AS record, session_id::INT AS s FROM ev),
    g AS (SELECT session_id, s, count(*) AS n, string_agg(record, chr(10) ORDER BY ordinal) AS every, string_agg(CASE WHEN ordinal >= 2 THEN record END, chr(10) ORDER BY ordinal) AS tail FROM r GROUP BY ALL)
    SELECT session_id, CASE WHEN s % 3 = 0 AND n >= 2 THEN 'before ' || session_id || chr(10) || '{{"kind":"' || CASE WHEN s % 2 = 0 THEN 'append' ELSE 'replace_suffix' END || '","unchanged":2,"before":' || CASE WHEN s % 2 = 0 THEN 2 ELSE 3 END || ',"now":' || n || '}}' || chr(10) || coalesce(tail, '') ELSE every END AS input,
      n AS n_children, sha256(every) AS source_hash, CASE WHEN s % 3 = 0 AND n >= 2 THEN CASE WHEN s % 2 = 0 THEN 'append' ELSE 'replace_suffix' END ELSE 'create' END AS plan FROM g""",
)
def hi_10b(spark, sf):
    """Prompts that revise: a third of the sessions have a summary of their first two or three messages, others one of none."""
    e = events(spark, sf).select("session_id", F.col("ordinal").alias("pos"), F.concat_ws("|", "role", "text").alias("record"))
    s = F.col("session_id").cast("int")
    sizes = e.groupBy("session_id").agg(F.count("*").alias("n")).where("n >= 2")
    kind = F.when(s % 3 != 0, "create").when(s % 2 == 0, "append").otherwise("replace_suffix")
    plans = sizes.select("session_id", kind.alias("plan"), F.when(s % 3 == 0, 2).alias("from_index"), F.concat(F.lit("before "), "session_id").alias("previous"), F.when(s % 2 == 0, 2).otherwise(3).alias("n_before"))
    return S.summary_inputs(e, ["session_id"], plans)


@query("hi_07b_paired_spans")
def hi_07b(spark, sf):
    """Closed spans and tails with calls, less what a harness put into users' messages."""
    from .windows import called

    e = called(spark, sf).withColumn("cost", T.estimate_tokens(F.col("text")))
    tagged = F.when((F.col("role") == "user") & (F.col("type") == "message") & (F.col("line_no") % 8 == 4), F.concat(F.lit("<environment_context> "), "text")).otherwise(F.col("text"))
    e = written(e.withColumn("text", tagged))
    closed, tail = P.compaction_spans(e, boundary()), P.live_tail(e, boundary(), F.lit(True))
    return S.level_one_spans(S.level_one_sources(e), closed, tail, 120).select("session_id", "ordinal", "cost", "slot", "handle")


@query("hi_11_target_ids", "SELECT doc_id, sha256('{\"strategy\":\"v1\",\"handle\":\"h' || doc_id || '\",\"source_hash\":\"' || sha256(text) || '\",\"plan\":\"create\",\"options\":\"\"}') AS target_id FROM documents")
def hi_11(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("h"), "doc_id").alias("handle"), F.sha2("text", 256).alias("source_hash"))
    return S.target_ids(d, "v1").select("doc_id", "target_id")


_OUTPUT = "CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN concat('{\"summary\": \"s ', event_id, '\"}') WHEN 2 THEN concat('plain ', event_type) WHEN 3 THEN '{\"summary\": ' WHEN 4 THEN '{\"summary\": \"{nested}\"}' ELSE '{\"text\": 1}' END"


@query("hi_12_parse_summaries", "SELECT event_id, CASE event_id % 6 WHEN 1 THEN 's ' || event_id WHEN 2 THEN 'plain ' || event_type END AS summary, CASE event_id % 6 WHEN 0 THEN 'empty' WHEN 3 THEN 'malformed' WHEN 4 THEN 'no_summary' WHEN 5 THEN 'no_summary' END AS error FROM events")
def hi_12(spark, sf):
    return S.parse_summaries(table(spark, sf, "events").select("event_id", F.expr(_OUTPUT).alias("output"))).select("event_id", "summary", "error")


def targets(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.concat(F.lit("t"), F.col("event_id") % 400).alias("target_id"), F.concat(F.lit("l"), F.col("event_id") % 90).alias("lineage"), F.concat(F.lit("h"), F.col("event_id") % 7).alias("source_hash"), F.expr(_STATUS).alias("status"), F.concat(F.lit("summary "), "event_id").alias("summary"), F.col("event_id").alias("completed_at"), F.col("event_id").alias("updated_at"), F.col("event_id").alias("seq"))


TARGETS = f"tg AS (SELECT 't' || (event_id % 400) AS target_id, 'l' || (event_id % 90) AS lineage, 'h' || (event_id % 7) AS source_hash, {_STATUS} AS status, 'summary ' || event_id AS summary, event_id AS completed_at, event_id AS updated_at, event_id AS seq FROM events)"


@query("hi_13_apply_summaries", f"WITH {TARGETS}, n AS (SELECT DISTINCT 'l' || (doc_id % 100) AS lineage, 'h' || (doc_id % 8) AS source_hash FROM documents), b AS (SELECT lineage, source_hash, arg_max(summary, completed_at) AS summary FROM tg WHERE status = 'completed' GROUP BY 1, 2) SELECT n.*, summary FROM n LEFT JOIN b USING (lineage, source_hash)")
def hi_13(spark, sf):
    n = table(spark, sf, "documents").select(F.concat(F.lit("l"), F.col("doc_id") % 100).alias("lineage"), F.concat(F.lit("h"), F.col("doc_id") % 8).alias("source_hash")).distinct()
    return S.apply_summaries(n, targets(spark, sf)).select("lineage", "source_hash", "summary")


@query("hi_14_summarize_cycle")
def hi_14(spark, sf):
    """A run within a budget, and one that goes on from its targets, up to the roots."""
    one = level_one(spark, sf).join(events(spark, sf).select("session_id", "ordinal", F.concat_ws(": ", "role", "text").alias("record")), ["session_id", "ordinal"])
    one = written(one.withColumn("pos", F.col("ordinal")))
    leaves = one.groupBy("session_id", "handle").agg(F.min("slot").alias("seq"))
    half = float(one.agg(F.sum("cost")).first()[0]) * 0.5e-6
    targets, _ = S.summarize_to_roots(leaves, one, "v1", 60, most_usd=half)
    return S.summarize_to_roots(leaves, one, "v1", 60, targets=written(targets), at=1)[1]


@query("udf_01_summariser")
def udf_01(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("target_id"), F.col("text").alias("input"))
    made = S.retried(d, S.summarize_extractive)
    return made.select(F.col("target_id").alias("doc_id"), "summary", "breadcrumb", "topics", F.col("usage.input").alias("usage_input"), F.col("usage.output").alias("usage_output"), "error", "tries")


@query("hi_17_publish_decision", """WITH m AS (SELECT user_id, max(ts) AS mtime, count(*) AS size, count(*) FILTER (event_type = 'view') AS n FROM events WHERE user_id % 3 > 0 GROUP BY 1),
    c AS (SELECT user_id, max(ts) FILTER (event_type <> 'error') AS mtime, count(*) - user_id % 2 AS size, count(*) FILTER (event_type = 'view') AS n, user_id % 11 = 0 AS changed, user_id % 4 > 0 AS done FROM events GROUP BY 1)
    SELECT c.user_id::VARCHAR AS session_id, CASE WHEN changed OR coalesce(c.mtime < m.mtime OR c.size < m.size OR c.n < m.n, false) THEN 'stale_source' WHEN m.user_id IS NOT NULL AND NOT done THEN 'summary_not_ready' ELSE 'publish' END AS decision FROM c LEFT JOIN m USING (user_id)""")
def hi_17(spark, sf):
    e = table(spark, sf, "events")
    id_, views = F.col("user_id").cast("string").alias("session_id"), F.count_if(F.col("event_type") == "view").alias("event_count")
    m = e.where("user_id % 3 > 0").groupBy(id_).agg(F.max("ts").alias("mtime"), F.count("*").alias("size"), views)
    c = e.groupBy(id_, "user_id").agg(F.max(F.when(F.col("event_type") != "error", F.col("ts"))).alias("mtime"), (F.count("*") - F.first(F.col("user_id") % 2)).alias("size"), views)
    c = c.withColumn("source_changed", F.col("user_id") % 11 == 0).withColumn("summaries_done", F.col("user_id") % 4 > 0)
    return S.publish_decision(c, m).select("session_id", "decision")


@query("hi_18_reusable_sessions", "WITH f AS (SELECT source || '/' || lang AS path, sum(n_chars) FILTER (doc_id % 9 > 0)::BIGINT AS fingerprint FROM documents GROUP BY source, lang), m AS (SELECT source || '/' || lang AS path, sum(n_chars) FILTER (doc_id % 9 > 0 AND (lang <> 'es' OR doc_id % 2 = 0))::BIGINT AS fingerprint, count(*) % 3 AS pending, count(*) % 2 AS failed FROM documents GROUP BY source, lang) SELECT path FROM f SEMI JOIN m ON f.path = m.path AND f.fingerprint IS NOT DISTINCT FROM m.fingerprint AND (pending = 0 OR failed > 0)")
def hi_18(spark, sf):
    d = table(spark, sf, "documents")
    own = F.when(F.col("doc_id") % 9 > 0, F.col("n_chars"))
    none = F.lit(None).cast("string").alias("options")
    path = F.concat_ws("/", "source", "lang").alias("path")
    f = d.groupBy(path).agg(F.sum(own).alias("fingerprint")).withColumn("options", none)
    m = d.groupBy(path).agg(F.sum(F.when((F.col("lang") != "es") | (F.col("doc_id") % 2 == 0), own)).alias("fingerprint"), (F.count("*") % 3).alias("pending"), (F.count("*") % 2).alias("failed")).withColumn("options", none)
    return S.reusable_sessions(f, m).select("path")


@query("jn_11_split_reusable", f"WITH {TARGETS} SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM tg WHERE status = 'completed' AND target_id = 't' || (doc_id % 500)) THEN 'reused' ELSE 'pending' END AS work FROM documents")
def jn_11(spark, sf):
    return S.split_reusable(table(spark, sf, "documents").select("doc_id", F.concat(F.lit("t"), F.col("doc_id") % 500).alias("target_id")), targets(spark, sf)).select("doc_id", "work")


@query("jn_12_commit_targets", f"""WITH {TARGETS}, o AS (SELECT 't' || doc_id AS target_id, 'completed' AS status, doc_id AS updated_at FROM documents),
    u AS (SELECT *, 0 AS is_new FROM o UNION ALL SELECT target_id, status, updated_at, 1 FROM tg WHERE status <> 'pending'), r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY is_new DESC, updated_at DESC) AS n FROM u) SELECT target_id, status, updated_at FROM r WHERE n = 1""")
def jn_12(spark, sf):
    old = table(spark, sf, "documents").select(F.concat(F.lit("t"), "doc_id").alias("target_id"), F.lit("completed").alias("status"), F.col("doc_id").alias("updated_at"))
    return S.commit_targets(old, targets(spark, sf).select("target_id", "status", "updated_at"))


@query("jn_13_target_scope", f"WITH {TARGETS}, t AS (SELECT DISTINCT target_id FROM tg), c AS (SELECT DISTINCT 't' || (doc_id % 300) AS target_id FROM documents WHERE lang = 'en') SELECT target_id, target_id IN (SELECT target_id FROM c) AS is_current FROM t")
def jn_13(spark, sf):
    m = table(spark, sf, "documents").where("lang = 'en'").groupBy("source").agg(F.collect_set(F.concat(F.lit("t"), F.col("doc_id") % 300)).alias("summary_target_ids"))
    current, orphans = S.target_scope(targets(spark, sf).select("target_id").distinct(), m)
    return current.withColumn("is_current", F.lit(True)).unionByName(orphans.withColumn("is_current", F.lit(False)))


@query("jn_15_apply_results", "WITH j AS (SELECT event_id, event_id % 6 AS k, event_type FROM events) SELECT event_id, CASE WHEN event_type = 'error' THEN 'model failed' WHEN event_type = 'purchase' THEN 'missing' ELSE CASE k WHEN 0 THEN 'empty' WHEN 3 THEN 'malformed' WHEN 4 THEN 'no_summary' WHEN 5 THEN 'no_summary' END END AS error, CASE WHEN event_type NOT IN ('error', 'purchase') AND k IN (1, 2) THEN 'completed' ELSE 'error' END AS status FROM j")
def jn_15(spark, sf):
    e = table(spark, sf, "events")
    jobs = e.select("event_id", F.col("event_id").cast("string").alias("target_id"))
    bad = F.col("event_type") == "error"
    results = e.where("event_type <> 'purchase'").select(F.col("event_id").cast("string").alias("custom_id"), F.when(bad, "errored").otherwise("succeeded").alias("result_type"), F.expr(_OUTPUT).alias("output"), F.when(bad, "model failed").alias("message"))
    return S.apply_results(jobs, results).select("event_id", "error", "status")


@query("win_11_merge_jobs", f"WITH {TARGETS}, u AS (SELECT target_id, status, 0 AS l, seq FROM tg UNION ALL SELECT 't' || (doc_id % 450), CASE WHEN doc_id % 2 = 0 THEN 'succeeded' ELSE 'reused' END, 1, doc_id FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY CASE status WHEN 'succeeded' THEN 5 WHEN 'completed' THEN 4 WHEN 'reused' THEN 3 WHEN 'submitted' THEN 2 WHEN 'pending' THEN 1 ELSE 0 END DESC, l, seq) AS n FROM u) SELECT target_id, status, seq FROM r WHERE n = 1")
def win_11(spark, sf):
    other = table(spark, sf, "documents").select(F.concat(F.lit("t"), F.col("doc_id") % 450).alias("target_id"), F.when(F.col("doc_id") % 2 == 0, "succeeded").otherwise("reused").alias("status"), F.col("doc_id").alias("seq"))
    return S.merge_jobs(targets(spark, sf).select("target_id", "status", "seq"), other)


@query("win_14_revision_plan", """WITH c AS (SELECT conv_id, turn, CASE WHEN conv_id % 4 = 2 AND turn = 2 THEN text || '!' ELSE text END AS h FROM conversations),
    p AS (SELECT conv_id, turn, text AS h FROM conversations WHERE conv_id % 5 > 0 AND (conv_id % 4 > 0 OR turn < 3) UNION ALL SELECT conv_id, max(turn) + 1, 'x' FROM conversations WHERE conv_id % 7 = 1 AND conv_id % 5 > 0 AND conv_id % 4 > 0 GROUP BY 1),
    cn AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM c), pn AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM p),
    m AS (SELECT coalesce(cn.conv_id, pn.conv_id) AS conv_id, min(CASE WHEN cn.h IS DISTINCT FROM pn.h THEN coalesce(cn.i, pn.i) END) AS f FROM cn FULL JOIN pn ON cn.conv_id = pn.conv_id AND cn.i = pn.i GROUP BY 1),
    s AS (SELECT a.conv_id, a.n AS n_now, b.n AS n_then, f FROM (SELECT conv_id, count(*) AS n FROM cn GROUP BY 1) a LEFT JOIN (SELECT conv_id, count(*) AS n FROM pn GROUP BY 1) b USING (conv_id) LEFT JOIN m USING (conv_id)),
    z AS (SELECT *, CASE WHEN n_then IS NULL OR n_now < n_then OR f IS NULL OR f = 0 THEN 'create' WHEN f = n_then THEN 'append' ELSE 'replace_suffix' END AS plan FROM s)
    SELECT conv_id, plan, CASE WHEN plan <> 'create' THEN f END AS from_index FROM z""")
def win_14(spark, sf):
    c = table(spark, sf, "conversations")
    listed = lambda df: df.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "h"))), lambda x: x.h).alias("hashes"))
    now = listed(c.withColumn("h", F.when((F.col("conv_id") % 4 == 2) & (F.col("turn") == 2), F.concat("text", F.lit("!"))).otherwise(F.col("text"))))
    then = listed(c.where("conv_id % 5 > 0 and (conv_id % 4 > 0 or turn < 3)").withColumn("h", F.col("text")))
    then = then.withColumn("hashes", F.when((F.col("conv_id") % 7 == 1) & (F.col("conv_id") % 4 > 0), F.concat("hashes", F.array(F.lit("x")))).otherwise(F.col("hashes")))
    return S.revision_plan(now, then, "conv_id")


@query("win_15_maintenance_base", f"WITH {TARGETS}, n AS (SELECT DISTINCT 'l' || (doc_id % 100) AS lineage, 'h' || (doc_id % 8) AS source_hash FROM documents), m AS (SELECT n.*, target_id AS base_target_id, row_number() OVER (PARTITION BY n.lineage, n.source_hash ORDER BY completed_at DESC, target_id DESC) AS k FROM n JOIN tg ON tg.lineage = n.lineage AND tg.source_hash <> n.source_hash AND status = 'completed') SELECT lineage, source_hash, base_target_id FROM m WHERE k = 1")
def win_15(spark, sf):
    n = table(spark, sf, "documents").select(F.concat(F.lit("l"), F.col("doc_id") % 100).alias("lineage"), F.concat(F.lit("h"), F.col("doc_id") % 8).alias("source_hash")).distinct()
    return S.maintenance_base(n, targets(spark, sf)).select("lineage", "source_hash", "base_target_id")
