"""Queries on status, accounting, cost, forensics and coverage over all sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import usage as U
from ..operators import forensics as X
from ..operators import status as S
from .catalog import query, table
from .finding import MANIFEST, manifest
from .trees import DOCS, docs
from .upkeep import TARGETS, targets
from .windows import _FIELDS, EVENTS, events, usage_sql


def headed(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("ordinal"), F.when(F.col("event_type") == "error", F.concat(F.lit("d"), "event_id")).alias("declared_id"), F.when(F.col("event_id") % 3 > 0, F.col("ts")).alias("at"), F.when(F.col("event_type") == "click", F.concat(F.lit("/w/"), F.col("event_id") % 5)).alias("cwd"), F.when(F.col("event_id") % 2 == 0, "gpt-x").otherwise("").alias("model"), F.lit("message").alias("type"), F.when(F.col("event_type") == "view", "user").otherwise("assistant").alias("role"), U.usage(input=F.col("event_id") % 9).alias("usage"))


@query("agg_02_session_header", """SELECT user_id::VARCHAR AS session_id, coalesce('d' || max(event_id) FILTER (event_type = 'error'), user_id::VARCHAR) AS id, arg_min(ts, event_id) FILTER (event_id % 3 > 0) AS started_at, arg_min('/w/' || (event_id % 5), event_id) FILTER (event_type = 'click') AS cwd,
    count(*) AS event_count, count(*) FILTER (event_type = 'view') AS turn_count, sum(event_id % 9)::BIGINT AS input, CASE WHEN bool_or(event_id % 2 = 0) THEN 'openai' ELSE 'unknown' END AS model_family FROM events GROUP BY user_id""")
def agg_02(spark, sf):
    return S.build_sessions(headed(spark, sf)).select("session_id", "id", "started_at", "cwd", "event_count", "turn_count", "usage.input", "model_family")


@query("src_06_titles", "WITH s AS (SELECT DISTINCT user_id::VARCHAR AS id FROM events), n AS (SELECT (event_id % 40)::VARCHAR AS id, event_type || event_id AS name, event_id FROM events WHERE event_type <> 'view' AND event_id % 40 < 30), t AS (SELECT id, arg_max(name, event_id) AS title FROM n GROUP BY 1) SELECT id, coalesce(title, 'Session ' || substr(id, 1, 8)) AS title FROM s LEFT JOIN t USING (id)")
def src_06(spark, sf):
    e = table(spark, sf, "events")
    names = e.select((F.col("event_id") % 40).cast("string").alias("id"), F.when(F.col("event_type") != "view", F.concat("event_type", "event_id")).otherwise("").alias("name"), F.col("event_id").alias("line_no")).where("cast(id as int) < 30")
    return S.with_titles(e.select(F.col("user_id").cast("string").alias("id")).distinct(), names).select("id", "title")


@query("agg_04_session_counts", f"WITH {DOCS} SELECT session_id, count(DISTINCT pos) FILTER (depth = 1) AS events, count(*) FILTER (depth = 1 AND role = 'user') AS turns, count(*) AS docs FROM dc GROUP BY 1")
def agg_04(spark, sf):
    return S.session_counts(events(spark, sf), docs(spark, sf))


def spans_jobs(spark, sf):
    e = table(spark, sf, "events")
    spans = e.select(F.col("user_id").cast("string").alias("session_id"), (F.col("event_id") % 4).alias("span"), F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("t"), "event_id")).alias("target_id"))
    jobs = e.where("event_type <> 'purchase'").select(F.concat(F.lit("t"), "event_id").alias("target_id"), F.when(F.col("event_type") == "error", "error").when(F.col("value") > 5, "completed").otherwise("pending").alias("status"))
    return S.compaction_log(spans, jobs)


COMPACTIONS = """cl0 AS (SELECT user_id::VARCHAR AS session_id, event_id % 4 AS span, count(*) FILTER (event_id % 4 > 0) AS targets, count(*) FILTER (event_id % 4 > 0 AND event_type NOT IN ('purchase', 'error') AND value > 5) AS completed, count(*) FILTER (event_id % 4 > 0 AND event_type = 'error') AS failed FROM events GROUP BY 1, 2),
  cl AS (SELECT *, targets - completed - failed AS pending, CASE WHEN targets = 0 THEN 'empty' WHEN failed > 0 THEN 'error' WHEN completed = targets THEN 'indexed' WHEN completed > 0 THEN 'partial' ELSE 'pending' END AS status FROM cl0)"""


@query("agg_07_compaction_log", f"WITH {COMPACTIONS} SELECT * FROM cl")
def agg_07(spark, sf):
    return spans_jobs(spark, sf)


@query("agg_09_indexing_stats", f"WITH {COMPACTIONS} SELECT session_id, count(*) AS boundaries, count(*) FILTER (status = 'indexed') AS indexed, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'error') AS error, sum(targets)::BIGINT AS targets, sum(completed)::BIGINT AS completed, sum(pending)::BIGINT AS pending FROM cl GROUP BY 1")
def agg_09(spark, sf):
    return S.indexing_stats(spans_jobs(spark, sf))


@query("agg_08_target_counts", """WITH t AS (SELECT 't' || event_id AS target_id, CASE event_id % 4 WHEN 0 THEN 'claimed' WHEN 1 THEN 'completed' WHEN 2 THEN 'error' ELSE 'completed' END AS status, event_id AS claim, event_id % 3 = 0 AND event_type = 'view' AS cur FROM events)
    SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'claimed' AND claim > 500) AS claimed, count(*) FILTER (status = 'claimed' AND claim <= 500) AS stale, count(*) FILTER (status = 'error') AS failed,
      count(*) FILTER (cur) AS current_total, count(*) FILTER (cur AND status = 'completed') AS current_completed, count(*) FILTER (cur AND status = 'claimed' AND claim > 500) AS current_claimed, count(*) FILTER (cur AND status = 'claimed' AND claim <= 500) AS current_stale, count(*) FILTER (cur AND status = 'error') AS current_failed, count(*) FILTER (NOT cur) AS orphans FROM t""")
def agg_08(spark, sf):
    e = table(spark, sf, "events").withColumn("target_id", F.concat(F.lit("t"), "event_id"))
    k = F.col("event_id") % 4
    t = e.select("target_id", F.when(k == 0, "claimed").when(k == 2, "error").otherwise("completed").alias("status"), F.col("event_id").alias("claim_expires_at"))
    return S.target_counts(t, e.where("event_id % 3 = 0 and event_type = 'view'"), F.lit(500))


@query("agg_10_job_accounting", f"WITH {TARGETS} SELECT lineage, count(*) AS jobs, sum(seq % 900)::BIGINT AS planned_input, coalesce(sum(seq % 900) FILTER (status = 'completed'), 0)::BIGINT AS completed_input, count(*) FILTER (status = 'completed') AS completed, CASE WHEN coalesce(sum(seq % 11) FILTER (status = 'error'), 0) > 0 THEN 'actual' ELSE 'estimate' END AS basis, (CASE WHEN coalesce(sum(seq % 11) FILTER (status = 'error'), 0) > 0 THEN sum(seq % 11) FILTER (status = 'error') ELSE count(*) * 320 END)::BIGINT AS output FROM tg GROUP BY 1")
def agg_10(spark, sf):
    j = targets(spark, sf).withColumn("input_tokens", F.col("seq") % 900).withColumn("output_tokens", F.when(F.col("status") == "error", F.col("seq") % 11))
    return S.job_accounting(j, ["lineage"])


def pricing(spark, sf):
    p = table(spark, sf, "part")
    rate = lambda k: (F.col("p_size") % k).cast("double")
    model = F.when(F.col("p_partkey") % 10 == 0, 0).otherwise(F.col("p_partkey"))  # some names stand for several models
    return p.select(F.concat(F.lit("prov"), F.col("p_partkey") % 3).alias("provider_id"), F.concat(F.lit("Model-"), model).alias("model_id"), F.concat(F.lit("id"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("family"), F.lit("active").alias("status"), F.struct(rate(7).alias("input"), rate(11).alias("output"), rate(3).alias("cache_read"), rate(2).alias("cache_write"), rate(5).alias("reasoning")).alias("cost"))


PRICING = "pr AS (SELECT 'prov' || (p_partkey % 3) AS provider_id, 'Model-' || CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE p_partkey END AS model_id, 'id' || p_partkey AS id, p_name AS name, p_brand AS family, (p_size % 7)::DOUBLE AS c_in, (p_size % 11)::DOUBLE AS c_out, (p_size % 3)::DOUBLE AS c_cr, (p_size % 2)::DOUBLE AS c_cw, (p_size % 5)::DOUBLE AS c_re FROM part)"


@query("flt_10_list_models", f"WITH {PRICING} SELECT provider_id, model_id, id FROM pr WHERE provider_id = 'prov1' AND (contains(lower(model_id), '-1') OR contains(lower(id), '-1') OR contains(lower(name), '-1') OR contains(lower(family), '-1'))")
def flt_10(spark, sf):
    return S.list_models(pricing(spark, sf), "-1", "PROV1", None).select("provider_id", "model_id", "id")


ASKED = "ask AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'model-' || (event_id % 30) WHEN 1 THEN 'prov' || (event_id % 3) || '/MODEL-' || (event_id % 25) WHEN 2 THEN 'ID' || (event_id % 70) ELSE 'nothing' END AS model, CASE WHEN event_id % 8 = 0 THEN 'prov' || (event_id % 3) ELSE '' END AS provider FROM events)"
RESOLVED = f"""{PRICING}, {ASKED}, pk AS (SELECT provider_id, model_id, id, c_in, c_out, c_cr, c_cw, c_re, unnest(list_distinct([lower(model_id), lower(id), lower(provider_id || '/' || model_id), lower(provider_id || ':' || model_id)])) AS k FROM pr),
  rs AS (SELECT event_id, model, count(pk.id) AS n, min(pk.provider_id) AS provider_id, min(pk.model_id) AS model_id, min(c_in) AS c_in, min(c_out) AS c_out, min(c_cr) AS c_cr, min(c_cw) AS c_cw, min(c_re) AS c_re FROM ask LEFT JOIN pk ON pk.k = lower(model) AND (provider = '' OR provider = provider_id) GROUP BY 1, 2)"""


def asked(spark, sf):
    k = F.col("event_id") % 4
    model = F.when(k == 0, F.concat(F.lit("model-"), F.col("event_id") % 30)).when(k == 1, F.concat(F.lit("prov"), F.col("event_id") % 3, F.lit("/MODEL-"), F.col("event_id") % 25)).when(k == 2, F.concat(F.lit("ID"), F.col("event_id") % 70)).otherwise("nothing")
    provider = F.when(F.col("event_id") % 8 == 0, F.concat(F.lit("prov"), F.col("event_id") % 3)).otherwise("")
    return table(spark, sf, "events").select(F.col("event_id").alias("ask_id"), "event_id", model.alias("model"), provider.alias("provider"))


@query("jn_06_resolve_pricing", f"WITH {RESOLVED} SELECT event_id, CASE WHEN n = 0 THEN 'unknown' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS price_status, CASE WHEN n = 1 THEN provider_id END AS provider_id, CASE WHEN n = 1 THEN model_id END AS model_id FROM rs")
def jn_06(spark, sf):
    return S.resolve_pricing(asked(spark, sf), pricing(spark, sf)).select("event_id", "price_status", "provider_id", "model_id")


@query("agg_11_cost", f"""WITH {RESOLVED}, us AS (SELECT event_id, {usage_sql()} FROM events), j AS (SELECT * FROM us JOIN rs USING (event_id) WHERE n = 1),
    k AS (SELECT event_id, greatest(0, input - cache_read - cache_write) * c_in / 1e6::DOUBLE AS i, cache_read * CASE WHEN c_cr > 0 THEN c_cr ELSE c_in END / 1e6::DOUBLE AS cr, cache_write * CASE WHEN c_cw > 0 THEN c_cw ELSE c_in END / 1e6::DOUBLE AS cw,
      CASE WHEN c_re > 0 THEN greatest(0, output - reasoning) ELSE output END * c_out / 1e6::DOUBLE AS o, CASE WHEN c_re > 0 THEN reasoning * c_re / 1e6::DOUBLE ELSE 0 END AS re, (c_cr = 0 AND cache_read > 0)::INT + (c_cw = 0 AND cache_write > 0)::INT + (c_re = 0 AND reasoning > 0)::INT AS notes FROM j)
    SELECT event_id, round(i, 8) AS input_usd, round(o, 8) AS output_usd, round(i + cr + cw + o + re, 8) AS total_usd, notes FROM k""")
def agg_11(spark, sf):
    asks = asked(spark, sf).repartition("event_id")  # the prices stay where the usage is joined
    priced = S.resolve_pricing(asks, pricing(spark, sf)).where("price_status = 'ok'").join(table(spark, sf, "events").select("event_id", "value"), "event_id")
    return S.estimate_cost(priced.withColumn("usage", U.usage(**{f: F.expr(x) for f, x in _FIELDS.items()}))).select("event_id", F.round("input_usd", 8).alias("input_usd"), F.round("output_usd", 8).alias("output_usd"), F.round("total_usd", 8).alias("total_usd"), F.size("assumptions").alias("notes"))


@query("agg_12_source_fingerprint", """WITH s AS (SELECT source AS path, doc_id // 4096 AS part, sum(strlen(text) + 1)::BIGINT AS size, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS content, count(*) FILTER (contains(text, 'the')) AS marked, max(doc_id) FILTER (contains(text, 'the')) AS last, sha256(coalesce(string_agg(CASE WHEN contains(text, 'the') THEN doc_id::VARCHAR END, ',' ORDER BY doc_id), '')) AS places FROM documents GROUP BY 1, 2)
    SELECT path, sum(size)::BIGINT AS size, sha256(string_agg(content, '' ORDER BY part)) AS content_hash, sum(marked)::BIGINT AS compactions, max(last) AS last_compaction_line, sha256(string_agg(places, '' ORDER BY part)) AS compaction_hash FROM s GROUP BY 1""")
def agg_12(spark, sf):
    return S.source_fingerprint(table(spark, sf, "documents").select(F.col("source").alias("path"), F.col("doc_id").alias("line_no"), F.col("text").alias("raw")), "the")


@query("agg_13_index_ids", f"WITH {EVENTS} SELECT session_id, CASE WHEN session_id::INT % 5 = 0 THEN 'kept-' || session_id ELSE 'idx-' || substr(sha256(string_agg(sha256('message|' || role || '|' || text), '' ORDER BY ordinal)), 1, 32) END AS index_id FROM ev GROUP BY 1")
def agg_13(spark, sf):
    e = events(spark, sf)
    kept = e.select("session_id").distinct().where("cast(session_id as int) % 5 = 0").withColumn("index_id", F.concat(F.lit("kept-"), "session_id"))
    return S.index_ids(e, kept)


def jobs(spark, sf):
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "error", "error").when(F.col("value") > 15, "budget_limited").when(F.col("value") > 12, "suspended").otherwise("completed")
    return e.select(F.concat(F.lit("j"), "event_id").alias("job_id"), F.col("user_id").cast("string").alias("session_id"), kind.alias("status"), (F.col("event_id") % 50 == 7).alias("running"), F.col("ts").alias("updated_at"), F.lit("failed").alias("error"))


JOBS = "jb AS (SELECT 'j' || event_id AS job_id, user_id::VARCHAR AS session_id, CASE WHEN event_type = 'error' THEN 'error' WHEN value > 15 THEN 'budget_limited' WHEN value > 12 THEN 'suspended' ELSE 'completed' END AS status, event_id % 50 = 7 AS running, ts AS updated_at FROM events), lj AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY running DESC, updated_at DESC, job_id) AS n FROM jb) WHERE n = 1)"


@query("win_12_latest_job", f"WITH {JOBS} SELECT session_id, job_id FROM lj")
def win_12(spark, sf):
    return S.latest_job(jobs(spark, sf), ["session_id"]).select("session_id", "job_id")


@query("agg_14_session_status", f"""WITH {JOBS}, z AS (SELECT *, session_id::INT % 3 = 0 AS pub, CASE status WHEN 'budget_limited' THEN 'suspended-budget' WHEN 'suspended' THEN 'suspended' WHEN 'error' THEN 'error' END AS trouble FROM lj)
    SELECT session_id, CASE WHEN pub THEN 'ready' ELSE coalesce(trouble, CASE WHEN running THEN 'indexing-in-progress' END, 'not-started') END AS state, CASE WHEN pub AND trouble IS NOT NULL THEN trouble || ': failed' END AS message FROM z""")
def agg_14(spark, sf):
    m = manifest(spark, sf).where("cast(session_id as int) % 3 = 0")
    return S.session_status(m, jobs(spark, sf))


@query("agg_22_readiness", "SELECT event_type, bool_and(value > 1) AS all_ready, sum(event_id % 3)::BIGINT AS pending, sum(event_id % 5)::BIGINT AS completed, sum(event_id % 2)::BIGINT AS claimed, sum(0)::BIGINT AS failed, sum(event_id % 3) > 0 AS can_continue FROM events GROUP BY 1")
def agg_22(spark, sf):
    e = table(spark, sf, "events").select("event_type", (F.col("value") > 1).alias("ready"), (F.col("event_id") % 3).alias("pending"), (F.col("event_id") % 5).alias("completed"), (F.col("event_id") % 2).alias("claimed"), F.lit(0).cast("long").alias("failed"))
    return S.readiness(e, ["event_type"])


@query("agg_21_budget_suspension", "WITH b AS (SELECT o_orderkey, 5.0::DOUBLE AS l, o_totalprice / 50000 AS s, (o_orderkey % 40) / 10.0::DOUBLE AS r FROM orders), c AS (SELECT *, CASE WHEN s + r <= 0 THEN 0 ELSE ceil((s + r - 1e-9::DOUBLE) * 100) / 100.0::DOUBLE END AS cap FROM b) SELECT o_orderkey, cap AS approval_usd, CASE WHEN s + r > l THEN CASE WHEN cap - l <= 0 THEN 0 ELSE ceil((cap - l - 1e-9::DOUBLE) * 100) / 100.0::DOUBLE END ELSE 0 END AS additional_usd, CASE WHEN s >= l THEN 'over_budget' WHEN s + r > l THEN 'budget_limited' ELSE 'ok' END AS status FROM c")
def agg_21(spark, sf):
    b = table(spark, sf, "orders").select("o_orderkey", F.lit(5.0).alias("limit_usd"), (F.col("o_totalprice") / 50000).alias("spent_usd"), (F.col("o_orderkey") % 40 / 10.0).alias("remaining_usd"))
    return S.budget_suspension(b).select("o_orderkey", "approval_usd", "additional_usd", "status")


@query("jn_14_jobs_for_sessions", f"""WITH {MANIFEST}, jx AS (SELECT event_id, 'j' || event_id AS job_id, event_id % 400 = 0 AS whole, '/logs/' || (event_id % 37) || '.jsonl' AS path, (event_id % 53)::VARCHAR AS rid, event_id % 9 = 0 AS running, ts FROM events),
    p AS (SELECT job_id, session_id FROM jx JOIN mf ON source_path = path UNION SELECT job_id, rid FROM jx UNION SELECT job_id, session_id FROM jx, mf WHERE whole)
    SELECT session_id, job_id FROM p JOIN jx USING (job_id) JOIN mf USING (session_id) WHERE running OR ts >= updated_at""")
def jn_14(spark, sf):
    e = table(spark, sf, "events")
    j = e.select(F.concat(F.lit("j"), "event_id").alias("job_id"), F.when(F.col("event_id") % 400 == 0, "all").otherwise("some").alias("scope"), F.array(F.concat(F.lit("/logs/"), F.col("event_id") % 37, F.lit(".jsonl"))).alias("paths"), F.array((F.col("event_id") % 53).cast("string")).alias("result_ids"), (F.col("event_id") % 9 == 0).alias("running"), F.col("ts").alias("updated_at"))
    return S.jobs_for_sessions(j, manifest(spark, sf).withColumn("indexed_at", F.col("updated_at")))


@query("win_12b_latest_job_of_sessions", f"""WITH {MANIFEST}, jx AS (SELECT event_id, 'j' || event_id AS job_id, event_id % 40 = 0 AS whole, '/logs/' || (event_id % 37) || '.jsonl' AS path, (event_id % 53)::VARCHAR AS rid, event_id % 900 = 9 AS running, ts FROM events),
    p AS (SELECT job_id, session_id FROM jx JOIN mf ON source_path = path UNION SELECT job_id, rid FROM jx UNION SELECT job_id, session_id FROM jx, mf WHERE whole),
    r AS (SELECT session_id, job_id, row_number() OVER (PARTITION BY session_id ORDER BY running DESC, ts DESC, job_id) AS n FROM p JOIN jx USING (job_id) JOIN mf USING (session_id) WHERE running OR ts >= updated_at - INTERVAL 1 DAY)
    SELECT session_id, job_id FROM r WHERE n = 1""")
def win_12b(spark, sf):
    e = table(spark, sf, "events")
    j = e.select(F.concat(F.lit("j"), "event_id").alias("job_id"), F.when(F.col("event_id") % 40 == 0, "all").otherwise("some").alias("scope"), F.array(F.concat(F.lit("/logs/"), F.col("event_id") % 37, F.lit(".jsonl"))).alias("paths"), F.array((F.col("event_id") % 53).cast("string")).alias("result_ids"), (F.col("event_id") % 900 == 9).alias("running"), F.col("ts").alias("updated_at"))
    return S.latest_job_of_sessions(j, manifest(spark, sf).withColumn("indexed_at", F.col("updated_at") - F.expr("INTERVAL 1 DAY")))


@query("set_03_unindexed_active", f"WITH {JOBS} SELECT DISTINCT session_id FROM jb WHERE running AND session_id::INT % 3 > 0")
def set_03(spark, sf):
    return S.unindexed_active(jobs(spark, sf), manifest(spark, sf).where("cast(session_id as int) % 3 = 0"))


@query("set_04_status_page", f"WITH {JOBS}, {MANIFEST}, u AS (SELECT DISTINCT session_id, 0 AS section, NULL::TIMESTAMP AS updated_at FROM jb WHERE running AND session_id::INT % 3 > 0 UNION ALL SELECT session_id, 1, updated_at FROM mf WHERE session_id::INT % 3 = 0), r AS (SELECT *, row_number() OVER (ORDER BY section, updated_at DESC NULLS LAST, session_id) - 1 AS place FROM u) SELECT session_id, section, place::INTEGER AS place FROM r WHERE place < 30")
def set_04(spark, sf):
    m = manifest(spark, sf).where("cast(session_id as int) % 3 = 0")
    return S.status_page(S.unindexed_active(jobs(spark, sf), m), m, 0, 30).select("session_id", "section", "place")


@query("snk_03_upsert_manifest", "WITH u AS (SELECT source AS session_id, max(doc_id) AS indexed_at, 0 AS is_new, array_to_string(list_sort(list(DISTINCT lang)), ',') AS ids FROM documents WHERE doc_id % 2 = 0 GROUP BY 1 UNION ALL SELECT source, max(doc_id), 1, array_to_string(list_sort(list(DISTINCT lang)), ',') FROM documents WHERE doc_id % 3 = 0 GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY indexed_at DESC, is_new DESC) AS n FROM u) SELECT session_id, indexed_at, ids FROM r WHERE n = 1")
def snk_03(spark, sf):
    d = table(spark, sf, "documents")
    m = lambda k: d.where(F.col("doc_id") % k == 0).groupBy(F.col("source").alias("session_id")).agg(F.max("doc_id").alias("indexed_at"), F.collect_list("lang").alias("summary_target_ids"))
    return S.upsert_manifest(m(2), m(3)).select("session_id", "indexed_at", F.array_join("summary_target_ids", ",").alias("ids"))


def lines(spark, sf):
    return table(spark, sf, "documents").select(F.col("source").alias("path"), F.col("doc_id").alias("line_no"), F.col("text").alias("raw"))


@query("jn_07_find_markers", r"""WITH m AS (SELECT text AS marker FROM benchmark UNION SELECT 'License'), h AS (SELECT marker, source AS path, doc_id AS line_no, strlen(d.text) - strlen(list_last(string_split(d.text, marker))) - strlen(marker) AS byte_offset FROM documents d JOIN m ON contains(d.text, marker))
    SELECT marker, path, max(line_no) AS line_no, arg_max(byte_offset, line_no)::INTEGER AS byte_offset, count(*) AS lines FROM h GROUP BY 1, 2""")
def jn_07(spark, sf):
    m = table(spark, sf, "benchmark").select(F.col("text").alias("marker")).unionByName(spark.createDataFrame([("License",)], "marker string"))
    return X.find_markers(lines(spark, sf), m)


CANDIDATES = "cd AS (SELECT DISTINCT 'm' || (user_id % 40) AS marker, user_id AS session_id FROM events WHERE user_id % 40 < 35), ed AS (SELECT DISTINCT user_id AS parent_id, user_id + 40 AS child_id FROM events WHERE user_id % 3 > 0)"


@query("jn_08_resolve_forks", f"""WITH {CANDIDATES}, p AS (SELECT DISTINCT cd.marker, cd.session_id FROM cd JOIN ed ON session_id = parent_id JOIN cd c ON c.marker = cd.marker AND c.session_id = child_id),
    l AS (SELECT marker, count(*) AS leaves, min(session_id) AS leaf FROM cd ANTI JOIN p USING (marker, session_id) GROUP BY 1), n AS (SELECT marker, count(*) AS candidates FROM cd GROUP BY 1), z AS (SELECT *, CASE WHEN candidates = 1 THEN 'direct' WHEN coalesce(leaves, 0) = 1 THEN 'selected' ELSE 'ambiguous' END AS status FROM n LEFT JOIN l USING (marker))
    SELECT marker, status, CASE WHEN status <> 'ambiguous' THEN leaf END AS session_id, candidates FROM z""")
def jn_08(spark, sf):
    e = table(spark, sf, "events")
    c = e.where("user_id % 40 < 35").select(F.concat(F.lit("m"), F.col("user_id") % 40).alias("marker"), F.col("user_id").alias("session_id")).distinct()
    edges = X.read_edges(e.where("user_id % 3 > 0").select("user_id", (F.col("user_id") + 40).alias("child")), "user_id", "child")
    return X.resolve_forks(c, edges)


@query("src_08_edges", "SELECT DISTINCT user_id AS parent_id, nullif(event_id % 20, 0) AS child_id FROM events WHERE event_id % 20 > 0")
def src_08(spark, sf):
    return X.read_edges(table(spark, sf, "events").withColumn("child", F.nullif(F.col("event_id") % 20, F.lit(0))), "user_id", "child")


@query("win_08_latest_match", r"WITH r AS (SELECT source AS path, doc_id AS line_no, list_last(regexp_extract_all(text, '[A-Z][a-z]+ing')) AS match FROM documents), l AS (SELECT path, max(line_no) AS line_no, arg_max(match, line_no) AS match FROM r WHERE match IS NOT NULL GROUP BY 1) SELECT path, line_no, match, row_number() OVER (ORDER BY line_no DESC, path)::INTEGER AS place FROM l")
def win_08(spark, sf):
    return X.latest_match(lines(spark, sf).withColumn("mtime", F.lit(0)).withColumn("size", F.lit(0)), "[A-Z][a-z]+ing").select("path", "line_no", "match", "place")


@query("src_07_tail_lines", "WITH t AS (SELECT source AS path, doc_id AS line_no, sum(strlen(text) + 1) OVER (PARTITION BY source ORDER BY doc_id DESC) AS n FROM documents) SELECT path, line_no FROM t WHERE n <= 20000")
def src_07(spark, sf):
    return X.tail_lines(lines(spark, sf), 20000).select("path", "line_no")


@query("agg_16_session_inventory", "SELECT source AS session_id, arg_max('f' || doc_id, doc_id) AS newest, sum(n_chars)::BIGINT AS bytes, count(*) AS files, CASE WHEN source <> 'src3' THEN 'T ' || source END AS title FROM documents GROUP BY source")
def agg_16(spark, sf):
    d = table(spark, sf, "documents")
    names = d.where("source <> 'src3'").select(F.col("source").alias("session_id"), F.concat(F.lit("T "), "source").alias("title")).distinct()
    return X.session_inventory(d.select(F.col("source").alias("session_id"), F.concat(F.lit("f"), "doc_id").alias("path"), F.col("doc_id").alias("mtime"), F.col("n_chars").alias("size")), names)


@query("agg_17_corpus_fingerprint", "WITH l AS (SELECT url || '|' || sha256(html) AS line, substr(sha256(url), 1, 3) AS part FROM pages), p AS (SELECT part, sha256(string_agg(line, chr(10) ORDER BY line)) AS h, count(*) AS n FROM l GROUP BY 1) SELECT sha256(string_agg(part || h, chr(10) ORDER BY part)) AS fingerprint, sum(n)::BIGINT AS docs FROM p")
def agg_17(spark, sf):
    return X.corpus_fingerprint(table(spark, sf, "pages").select(F.col("url").alias("path"), F.col("html").alias("content")))


@query("agg_18_gate_status", "SELECT n_name AS name, CASE WHEN n_nationkey % 5 = 0 THEN 'missing' WHEN n_nationkey % 5 = 1 THEN 'invalid_schema' WHEN n_nationkey % 5 = 2 THEN 'stale' WHEN n_nationkey % 5 = 3 THEN 'result_not_allowed' ELSE 'ok' END AS status FROM nation")
def agg_18(spark, sf):
    n = table(spark, sf, "nation")
    k = F.col("n_nationkey") % 5
    stamps = n.where(k > 0).select(F.col("n_name").alias("name"), F.when(k == 1, "v0").otherwise("v1").alias("schema"), F.when(k == 2, "old").otherwise("f").alias("fingerprint"), F.when(k == 3, "fail").otherwise("pass").alias("result"))
    return X.gate_status(stamps, n.select(F.col("n_name").alias("name"), F.lit("f").alias("fingerprint")))


SCOPES = [("d1.md", "s1", ["fr", "*/8*"]), ("d2.md", "s2", ["en/**", "de/**"]), ("fr/825", "s3", ["none"])]
AFFECTED = r"""ch AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]+/([^?]*)', 1) AS path FROM pages), sc(doc_path, section_id, scope, re) AS (VALUES ('d1.md', 's1', 'fr', '^fr(/.*)?$'), ('d1.md', 's1', '*/8*', '^[^/]*/8[^/]*$'), ('d2.md', 's2', 'en/**', '^en/.*$'), ('d2.md', 's2', 'de/**', '^de/.*$'), ('fr/825', 's3', 'none', '^none(/.*)?$')),
  af AS (SELECT path, doc_path, section_id, 'source' AS kind, string_agg(scope, ',' ORDER BY scope) AS scopes FROM ch JOIN sc ON regexp_matches(path, re) GROUP BY 1, 2, 3 UNION ALL SELECT path, 'fr/825', 's3', 'doc', '' FROM ch WHERE path = 'fr/825')"""


def affected(spark, sf):
    changes = table(spark, sf, "pages").select(F.regexp_extract("url", "^[a-z]+://[^/]+/([^?]*)", 1).alias("path"))
    return changes, X.affected_docs(changes, spark.createDataFrame(SCOPES, "doc_path string, section_id string, scopes array<string>"))


@query("jn_09_affected_docs", f"WITH {AFFECTED} SELECT path, doc_path, section_id, kind, scopes FROM af")
def jn_09(spark, sf):
    return affected(spark, sf)[1].withColumn("scopes", F.array_join("scopes", ","))


@query("jn_10_uncovered", f"WITH {AFFECTED} SELECT path FROM ch WHERE path NOT IN (SELECT path FROM af)")
def jn_10(spark, sf):
    return X.uncovered(*affected(spark, sf))


@query("jn_16_reconcile_threads", "SELECT doc_id AS id, CASE WHEN doc_id % 4 > 0 AND lang <> 'es' THEN 'resolved' WHEN doc_id % 3 = 0 THEN 'degraded' ELSE 'blocked' END AS status, CASE WHEN doc_id % 4 > 0 AND lang <> 'es' THEN 'p' || doc_id WHEN doc_id % 3 = 0 THEN 'alt' || doc_id END AS path, CASE WHEN doc_id % 4 > 0 AND lang <> 'es' OR doc_id % 3 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN 'no_path' ELSE 'missing_file' END AS reason FROM documents")
def jn_16(spark, sf):
    d = table(spark, sf, "documents")
    threads = d.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("p"), "doc_id")).otherwise("").alias("path"))
    files = d.where("lang <> 'es'").select(F.concat(F.lit("p"), "doc_id").alias("path"))
    return X.reconcile_threads(threads, files, d.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.concat(F.lit("alt"), "doc_id").alias("path")))


@query("agg_19_retrieval_scorecard", """WITH t AS (SELECT conv_id AS eval_id, turn, CASE turn % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'open' END AS tool, turn % 2 = 1 AS verb, conv_id % 2 AS omitted, lower(text) AS content, turn = 3 AS is_error, lower(text) AS answer FROM conversations),
    s AS (SELECT eval_id, bool_or(contains(answer, 'the')) AS answered, bool_or(coalesce(tool = 'search', false)) AS searched, bool_or(coalesce(tool = 'open', false)) AS opened, bool_or(coalesce(tool = 'open' AND verb AND omitted = 0 AND contains(content, 'the'), false)) AS verbatim, count(*) FILTER (is_error) AS errors FROM t GROUP BY 1)
    SELECT *, answered AND searched AND opened AND verbatim AS passed FROM s""")
def agg_19(spark, sf):
    c = table(spark, sf, "conversations")
    t = c.select(F.col("conv_id").alias("eval_id"), F.when(F.col("turn") % 3 == 0, "search").when(F.col("turn") % 3 == 1, "open").alias("tool_name"), (F.col("turn") % 2 == 1).alias("is_verbatim"), (F.col("conv_id") % 2).alias("omitted"), F.col("text").alias("content"), (F.col("turn") == 3).alias("is_error"), F.col("text").alias("answer"), F.lit("THE").alias("expected"))
    return X.score_retrieval(t)


@query("agg_20_evidence_coverage", "WITH p(prefix) AS (VALUES ('call'), ('err'), ('view'), ('nothing')), c AS (SELECT DISTINCT user_id, event_type FROM events) SELECT prefix, count(DISTINCT user_id) AS sessions, count(DISTINCT user_id) = 0 AS missing FROM p LEFT JOIN c ON starts_with(event_type, prefix) GROUP BY 1")
def agg_20(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.lit("tool_call").alias("type"), F.col("event_type").alias("call_name"))
    return X.evidence_coverage(e, spark.createDataFrame([("call",), ("err",), ("view",), ("nothing",)], "prefix string"))
