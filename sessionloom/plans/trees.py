"""Queries over the hierarchy, its documents and the corpus of chunks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import usage as U
from ..operators import events as E
from ..operators import tree as N
from .catalog import query, table
from .scalars import preview_sql, safe_sql, tokens_sql
from .windows import _SPANS, EVENTS, events, spans


def event_rows(spark, sf):
    """Conversation messages as full event rows: usage of 1 per character, the role as topic, a time from the turn."""
    e = events(spark, sf).withColumn("handle", T.handle(F.col("session_id"), F.col("ordinal"), F.col("type"), F.col("event_id")))
    none = F.lit(None).cast("string")
    return e.withColumns({
        "at": F.col("line_no"), "usage": U.usage(input=F.length("text")), "topics": F.array(F.upper("role"), F.substring("text", 1, 1)),
        "call_name": none, "tool_name": none, "tool_call_id": none, "paired_handle": none,
    })


def nodes(spark, sf):
    return N.build_nodes(event_rows(spark, sf))


def rolled(spark, sf):
    return N.rollup_tree(nodes(spark, sf))


HANDLE = f"'session/' || session_id || '/event/' || lpad(ordinal::VARCHAR, 6, '0') || '-message-' || substr({safe_sql('event_id')}, 1, 18)"
#: Nodes of the conversations in DuckDB; their texts never need chunks of 6,000 characters.
NODES = f"""{EVENTS}, h AS (SELECT *, {HANDLE} AS handle FROM ev),
nd AS (
  SELECT session_id, handle, 'session/' || session_id AS parent_handle, 1 AS depth, ordinal AS pos, 'message' AS kind, role, role || ' message' AS title, role || ': ' || {preview_sql('text', 180)} AS head, NULL AS raw, turn AS at, length(text) AS own FROM h
  UNION ALL SELECT session_id, handle || CASE WHEN length(text) > 0 THEN '/content' ELSE '/raw' END, handle, 2, 0, CASE WHEN length(text) > 0 THEN 'event_content' ELSE 'event_raw' END, role, role || ' message ' || CASE WHEN length(text) > 0 THEN 'content' ELSE 'raw' END, role || ': ' || {preview_sql('text', 180)}, text, turn, 0 FROM h
  UNION ALL SELECT session_id, 'session/' || session_id, NULL, 0, 0, 'session', NULL, 'session ' || session_id, NULL, NULL, NULL, 0 FROM h GROUP BY session_id),
nt AS (SELECT *, {tokens_sql("coalesce(nullif(head, ''), nullif(raw, ''), title)")} AS rendered FROM nd),
ro AS (
  SELECT n.session_id, n.handle, n.parent_handle, n.depth, n.pos, n.kind, n.role, n.title, n.rendered,
    CASE n.depth WHEN 2 THEN {tokens_sql('n.raw')} ELSE sum(l.tokens) END AS full_tokens,
    CASE n.depth WHEN 2 THEN {tokens_sql('n.raw')} WHEN 1 THEN sum(l.rendered) ELSE sum(m.rendered) END AS next_tokens,
    CASE n.depth WHEN 2 THEN 0 ELSE sum(m.own) END AS usage_total, coalesce(n.at, min(m.at)) AS start_at, coalesce(n.at, max(m.at)) AS end_at
  FROM nt n LEFT JOIN nt m ON m.depth = 1 AND n.session_id = m.session_id AND (n.depth = 0 OR m.handle = n.handle)
    LEFT JOIN (SELECT session_id, parent_handle, rendered, {tokens_sql('raw')} AS tokens FROM nt WHERE depth = 2) l ON l.session_id = n.session_id AND l.parent_handle = m.handle
  GROUP BY n.session_id, n.handle, n.parent_handle, n.depth, n.pos, n.kind, n.role, n.title, n.rendered, n.raw, n.at)"""


@query("hi_01_build_nodes", f"WITH {NODES} SELECT session_id, handle, parent_handle, depth, pos::BIGINT AS pos, kind, role, title, head, raw FROM nt")
def hi_01(spark, sf):
    return nodes(spark, sf).select("session_id", "handle", "parent_handle", "depth", "pos", "kind", "role", "title", "head", "raw")


@query(
    "hi_02_chunk_text",
    """WITH c AS (SELECT doc_id, text, unnest(range(0, greatest(1, ceil(length(text) / 6000.0))::BIGINT)) AS chunk_no FROM documents)
    SELECT doc_id, chunk_no, chunk_no * 6000 AS chunk_start, least((chunk_no + 1) * 6000, length(text)) AS chunk_end, substr(text, chunk_no * 6000 + 1, 6000) AS chunk FROM c""",
)
def hi_02(spark, sf):
    return N.chunk_text(table(spark, sf, "documents").select("doc_id", "text"), "text")


@query(
    "hi_03_with_depth",
    """WITH RECURSIVE e AS (SELECT 'r' || r_regionkey AS node, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
    w AS (SELECT node, parent, 0 AS depth FROM e WHERE parent IS NULL UNION ALL SELECT e.node, e.parent, w.depth + 1 FROM w JOIN e ON e.parent = w.node)
    SELECT node, parent, depth, max(depth) OVER () AS max_depth FROM w""",
)
def hi_03(spark, sf):
    return N.with_depth(geography(spark, sf), "node", "parent")


def geography(spark, sf):
    named = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    regions = table(spark, sf, "region").select(named("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"))
    nations = table(spark, sf, "nation").select(named("n", "n_nationkey").alias("node"), named("r", "n_regionkey").alias("parent"))
    customers = table(spark, sf, "customer").select(named("c", "c_custkey").alias("node"), named("n", "c_nationkey").alias("parent"))
    return regions.unionByName(nations).unionByName(customers)


@query("agg_06_rollup_tree", f"WITH {NODES} SELECT session_id, handle, full_tokens::BIGINT AS full_tokens, next_tokens::BIGINT AS next_tokens, rendered AS rendered_tokens, usage_total::BIGINT AS usage_total, start_at, end_at FROM ro")
def agg_06(spark, sf):
    return rolled(spark, sf).select("session_id", "handle", "full_tokens", "next_tokens", "rendered_tokens", F.col("usage.total").alias("usage_total"), "start_at", "end_at")


@query(
    "agg_06b_rollup_deep",
    f"""WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n, count(*) OVER (PARTITION BY source) AS many FROM documents),
    t AS (SELECT source, n, (n - 1) // 2 AS up, n > 0 AND n % 17 = 0 AS hid, CASE WHEN 2 * n + 1 >= many THEN {tokens_sql('text')} ELSE 0 END AS leaf, 2 * n + 1 >= many AS is_leaf, {tokens_sql('lang')} AS rendered, n_chars % 100 AS own, CASE WHEN doc_id % 3 = 0 THEN n_chars END AS tm FROM d),
    c AS (SELECT source, n AS anc, n, '' AS path FROM t UNION ALL SELECT c.source, c.anc, t.n, c.path || CASE WHEN t.n % 2 = 1 THEN '0' ELSE '1' END FROM c JOIN t ON t.source = c.source AND t.up = c.n AND t.n > 0 AND NOT t.hid)
    SELECT source AS session_id, source || '/' || anc AS handle, count(*) FILTER (length(path) = 1) AS n_children, sum(leaf)::BIGINT AS full_tokens,
      (CASE WHEN bool_or(path = '' AND is_leaf) THEN sum(leaf) ELSE coalesce(sum(rendered) FILTER (length(path) = 1), 0) END)::BIGINT AS next_tokens, (CASE WHEN anc = 0 AND sum(own) FILTER (path = '') > 0 THEN sum(own) FILTER (path = '') ELSE sum(own) END)::BIGINT AS usage_total,
      arg_min(tm, path) FILTER (tm IS NOT NULL) AS start_at, arg_min(tm, translate(path, '01', '10')) FILTER (tm IS NOT NULL) AS end_at
    FROM c JOIN t USING (source, n) GROUP BY source, anc""",
)
def agg_06b(spark, sf):
    """The documents of each source as a binary heap, some of them hidden: trees of depth 9 and more."""
    d = table(spark, sf, "documents")
    n = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    d = d.withColumn("n", n.cast("long")).withColumn("many", F.count("*").over(Window.partitionBy("source")))
    named = lambda c: F.concat_ws("/", "source", c.cast("string"))
    none = F.lit(None).cast("string")
    rows = d.select(
        F.col("source").alias("session_id"), named(F.col("n")).alias("handle"), F.when(F.col("n") > 0, named(F.expr("(n - 1) div 2"))).alias("parent_handle"), F.floor(F.log2(F.col("n") + 1)).cast("int").alias("depth"), F.col("n").alias("pos"),
        F.when((F.col("n") > 0) & (F.col("n") % 17 == 0), "reasoning").otherwise("message").alias("kind"), F.col("lang").alias("head"), named(F.col("n")).alias("title"), F.when(2 * F.col("n") + 1 >= F.col("many"), F.col("text")).otherwise(none).alias("raw"),
        F.when(F.col("doc_id") % 3 == 0, F.col("n_chars")).alias("at"), U.usage(input=F.col("n_chars") % 100).alias("own_usage"), F.array("lang").alias("links"),
    )
    return N.rollup_tree(rows).select("session_id", "handle", "n_children", "full_tokens", "next_tokens", F.col("usage.total").alias("usage_total"), "start_at", "end_at")


@query(
    "agg_05_rollup_topics",
    f"""WITH {EVENTS}, t AS (SELECT session_id, ordinal, greatest(1, ceil(greatest(1, ceil(length(text) / 4.0)) / 1000.0)) AS weight, unnest([upper(role), substr(text, 1, 1)]) AS topic FROM ev),
    s AS (SELECT session_id, lower(topic) AS k, arg_min(topic, (ordinal, topic)) AS topic, sum(weight) AS weight FROM t WHERE trim(topic) <> '' GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY weight DESC, topic) AS n FROM s)
    SELECT session_id, string_agg(topic, '|' ORDER BY n) AS topics FROM r WHERE n <= 8 GROUP BY 1""",
)
def agg_05(spark, sf):
    session = F.concat(F.lit("session/"), "session_id")
    leaves = rolled(spark, sf).where("depth = 2").withColumn("pos", F.regexp_extract("handle", "/event/([0-9]+)-", 1).cast("long")).withColumn("parent_handle", session)
    return N.rollup_topics(leaves).select("session_id", F.array_join("topics", "|").alias("topics"))


@query(
    "win_05_navigation",
    f"""WITH {NODES} SELECT session_id, handle, row_number() OVER (PARTITION BY session_id, parent_handle ORDER BY pos, handle) || '/' || count(*) OVER (PARTITION BY session_id, parent_handle) AS siblings,
      (depth + 1) || '/' || (max(depth) OVER (PARTITION BY session_id) + 1) AS zoom FROM nt""",
)
def win_05(spark, sf):
    return N.with_navigation(nodes(spark, sf)).select("session_id", "handle", "siblings", "zoom")


_DX = f"""{NODES}, dx AS (SELECT r.*, CASE WHEN r.depth = 1 AND r.role IN ('user', 'assistant') THEN h.text ELSE '' END AS full_text FROM ro r LEFT JOIN h ON r.handle = h.handle),"""
#: Documents in DuckDB, with the beginning of texts to search or with whole ones.
DOCS = f"""{_DX}
dc AS (SELECT *, substr(full_text, 1, 4000) AS search_text, depth = 0 OR full_text <> '' AS retrieval_visible FROM dx)"""
WHOLE_DOCS = f"""{_DX}
dc AS (SELECT *, full_text AS search_text, depth = 0 OR full_text <> '' AS retrieval_visible FROM dx)"""


def docs(spark, sf, most=None):
    return N.build_docs(rolled(spark, sf), most=most)


@query("hi_04_docs", f"WITH {DOCS} SELECT session_id, handle, kind, full_tokens::BIGINT AS full_tokens, search_text, {preview_sql('full_text', 700)} AS excerpt, retrieval_visible FROM dc")
def hi_04(spark, sf):
    return docs(spark, sf, N.SEARCH_TEXT).select("session_id", "handle", "kind", "full_tokens", "search_text", "excerpt", "retrieval_visible")


@query("hi_05_descendant_text", f"WITH {NODES} SELECT session_id, handle, text AS descendant_text FROM h")
def hi_05(spark, sf):
    return N.descendant_text(nodes(spark, sf))


@query("hi_06_compacted_scope", f"WITH {_SPANS}, h2 AS (SELECT *, {HANDLE} AS handle FROM spans) SELECT session_id, handle FROM h2 UNION ALL SELECT session_id, handle || CASE WHEN length(text) > 0 THEN '/content' ELSE '/raw' END FROM h2 UNION ALL SELECT conv_id::VARCHAR, 'session/' || conv_id FROM conversations GROUP BY conv_id")
def hi_06(spark, sf):
    inside = spans(spark, sf).withColumn("handle", T.handle(F.col("session_id"), F.col("ordinal"), F.col("type"), F.col("event_id")))
    return N.compacted_scope(nodes(spark, sf), inside).select("session_id", "handle")


@query("flt_02_visible", f"WITH {NODES} SELECT session_id, handle FROM nt WHERE NOT (depth = 2 AND role = 'system')")
def flt_02(spark, sf):
    marked = nodes(spark, sf).withColumn("kind", F.when((F.col("depth") == 2) & (F.col("role") == "system"), "reasoning").otherwise(F.col("kind")))
    return N.visible(marked).select("session_id", "handle")


@query("flt_03_retrieval_visible", f"WITH {DOCS} SELECT session_id, handle FROM dc WHERE retrieval_visible AND full_tokens > 20")
def flt_03(spark, sf):
    return N.build_docs(rolled(spark, sf), predicate=F.col("full_tokens") > 20).where("retrieval_visible").select("session_id", "handle")


_TAGGED = "CASE turn % 4 WHEN 1 THEN 'seen <Environment_Context cwd=''x''> ' WHEN 2 THEN '<skills_instructions>' WHEN 3 THEN '<user_instructions>' ELSE '' END || text"


@query("flt_04_level_one_sources", rf"SELECT conv_id, turn FROM (SELECT *, {_TAGGED} AS t FROM conversations) WHERE role = 'assistant' OR role = 'user' AND NOT regexp_matches(t, '(?i)<(recommended_plugins|environment_context|permissions instructions|collaboration_mode|multi_agent_mode|skills_instructions|apps_instructions|plugins_instructions)(\s[^>]*)?>')")
def flt_04(spark, sf):
    from ..operators import summaries as S

    turn = F.col("line_no") % 4
    tag = F.when(turn == 1, "seen <Environment_Context cwd='x'> ").when(turn == 2, "<skills_instructions>").when(turn == 3, "<user_instructions>").otherwise("")
    e = events(spark, sf).withColumn("text", F.concat(tag, "text"))
    return S.level_one_sources(e).select(F.col("session_id").cast("long").alias("conv_id"), F.col("line_no").alias("turn"))


@query(
    "set_01_published_docs",
    f"WITH {DOCS} SELECT session_id, handle, CASE WHEN depth = 0 THEN 'summary' ELSE kind END AS kind, retrieval_visible AND (depth = 0 OR pos % 2 = 0) AS retrieval_visible FROM dc",
)
def set_01(spark, sf):
    d = docs(spark, sf)
    summary = d.where("depth = 0").withColumn("kind", F.lit("summary"))
    return N.published_docs(summary, d, d.where("pos % 2 = 0")).select("session_id", "handle", "kind", "retrieval_visible")


@query("prj_22_search_record", f"WITH {DOCS} SELECT session_id, handle, parent_handle, role, search_text, full_tokens::BIGINT AS full_tokens, search_text <> '' AS has_search_text FROM dc")
def prj_22(spark, sf):
    record = N.search_record(docs(spark, sf, N.SEARCH_TEXT))
    return N.from_search_record(record).select("session_id", "handle", "parent_handle", "role", "search_text", "full_tokens", (F.col("search_text") != "").alias("has_search_text"))


@query("udf_02_visibility_hook", f"WITH {DOCS} SELECT session_id, count(*) AS shown FROM dc WHERE retrieval_visible AND role = 'assistant' GROUP BY 1")
def udf_02(spark, sf):
    return N.build_docs(rolled(spark, sf), predicate=F.col("role") == "assistant").where("retrieval_visible").groupBy("session_id").agg(F.count("*").alias("shown"))


@query("prj_14_event_head", f"SELECT conv_id, turn, role || ' message' AS title, role || ': ' || {preview_sql('text', 180)} AS head FROM conversations")
def prj_14(spark, sf):
    e = event_rows(spark, sf)
    return e.select(F.col("session_id").cast("long").alias("conv_id"), F.col("line_no").alias("turn"), N.event_title(e).alias("title"), N.event_head().alias("head"))
