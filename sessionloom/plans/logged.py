"""Queries on session logs of both dialects, which Spark derives from the conversations and events tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import content as C
from ..functions import usage as U
from ..operators import events as E
from ..sources import logs as L
from .catalog import query, table
from .scalars import preview_sql


def files_a(spark, sf):
    """Whole files of the first dialect, one per conversation: a header, messages, a token count after each, a blank and a broken line."""
    c = table(spark, sf, "conversations")
    stamp = F.format_string("2024-01-01T00:%02d:00Z", F.col("turn"))
    user = F.col("role") == "user"
    message = F.to_json(F.struct(stamp.alias("timestamp"), F.lit("event_msg").alias("type"), F.struct(F.when(user, "user_message").otherwise("agent_message").alias("type"), F.col("text").alias("message")).alias("payload")))
    count = F.to_json(F.struct(stamp.alias("timestamp"), F.lit("event_msg").alias("type"), F.struct(F.lit("token_count").alias("type"), F.struct(F.struct(((F.col("turn") + 1) * 10).alias("input_tokens"), (F.col("turn") * 3).alias("output_tokens")).alias("total_token_usage")).alias("info")).alias("payload")))
    head = F.to_json(F.struct(F.lit("2024-01-01T00:00:00Z").alias("timestamp"), F.lit("session_meta").alias("type"), F.struct(F.concat(F.lit("id-"), "conv_id").alias("id"), F.lit("/work").alias("cwd")).alias("payload")))
    rows = c.withColumn("lines", F.concat_ws("\n", message, count)).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "lines"))), lambda x: x.lines), "\n").alias("body"), F.first(head).alias("head"))
    return rows.select(F.concat(F.lit("/logs/"), "conv_id", F.lit(".jsonl")).alias("path"), F.concat("head", F.lit("\r\n\n{broken\n"), "body").alias("value"))


@query("src_01_session_lines", "WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) SELECT '/logs/' || conv_id || '.jsonl' AS path, line_no, bad FROM (SELECT conv_id, 1 AS line_no, false AS bad FROM c GROUP BY 1 UNION ALL SELECT conv_id, 3, true FROM c GROUP BY 1 UNION ALL SELECT conv_id, 2 + 2 * n, false FROM c UNION ALL SELECT conv_id, 3 + 2 * n, false FROM c)")
def src_01(spark, sf):
    return L.split_lines(files_a(spark, sf)).select("path", "line_no", F.col("parse_error").isNotNull().alias("bad"))


@query(
    "src_03_dialect_a",
    """WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations), l AS (SELECT *, coalesce(lag((turn + 1) * 10) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS pi, coalesce(lag(turn * 3) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS po FROM c)
    SELECT '/logs/' || conv_id || '.jsonl' AS path, 1 AS line_no, 'metadata' AS type, 'system' AS role, NULL AS text, NULL::BIGINT AS input, NULL::BIGINT AS total FROM c GROUP BY conv_id
    UNION ALL SELECT '/logs/' || conv_id || '.jsonl', 3, 'agent_event', 'observer', '{broken', NULL, NULL FROM c GROUP BY conv_id
    UNION ALL SELECT '/logs/' || conv_id || '.jsonl', 2 + 2 * n, 'message', CASE role WHEN 'user' THEN 'user' ELSE 'assistant' END, text, NULL, NULL FROM c
    UNION ALL SELECT '/logs/' || conv_id || '.jsonl', 3 + 2 * n, 'usage', 'observer', NULL, (turn + 1) * 10 - pi, (turn + 1) * 10 - pi + turn * 3 - po FROM l""",
)
def src_03(spark, sf):
    e = L.rows_to_events_a(L.split_lines(files_a(spark, sf)))
    return e.select("path", "line_no", "type", "role", F.nullif("text", F.lit("")).alias("text"), "usage.input", "usage.total")


def lines_b(spark, sf):
    """Lines of the second dialect: a text block and a call per assistant row, results and plain text per user row, a boundary for each system row."""
    c = table(spark, sf, "conversations")
    sid = F.col("conv_id").cast("string")
    call = F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("c"), "turn").alias("id"), F.lit("look").alias("name"), F.struct(F.col("turn").alias("q")).alias("input"), F.lit(None).cast("string").alias("text"))
    text = F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("struct<q:bigint>").alias("input"), F.col("text").alias("text"))
    answer = F.to_json(F.struct(F.lit("assistant").alias("type"), sid.alias("sessionId"), F.struct(F.lit("big-model").alias("model"), F.array(text, call).alias("content"), F.struct(F.col("turn").alias("input_tokens"), F.lit(5).alias("output_tokens")).alias("usage")).alias("message")))
    ask = F.to_json(F.struct(F.lit("user").alias("type"), sid.alias("sessionId"), F.struct(F.col("text").alias("content")).alias("message")))
    other = F.to_json(F.struct(F.lit("system").alias("type"), F.lit("compact_boundary").alias("subtype"), sid.alias("sessionId"), F.col("text").alias("content")))
    raw = F.when(F.col("role") == "assistant", answer).when(F.col("role") == "user", ask).otherwise(other)
    return L.parsed(c.select(F.concat(F.lit("/b/"), "conv_id").alias("path"), (F.col("turn") + 1).alias("line_no"), raw.alias("raw")))


@query(
    "src_04_dialect_b",
    """SELECT conv_id::VARCHAR AS session_id, turn + 1 AS line_no, 0 AS block_no, CASE role WHEN 'system' THEN 'compaction' ELSE 'message' END AS type, role, text, NULL AS call_id, NULL::BIGINT AS total FROM conversations
    UNION ALL SELECT conv_id::VARCHAR, turn + 1, 1, 'tool_call', 'assistant', '{"q":' || turn || '}', 'c' || turn, NULL FROM conversations WHERE role = 'assistant'
    UNION ALL SELECT conv_id::VARCHAR, turn + 1, 1048576, 'usage', 'assistant', '', NULL, turn + 5 FROM conversations WHERE role = 'assistant'""",
)
def src_04(spark, sf):
    return L.rows_to_events_b(lines_b(spark, sf)).select("session_id", "line_no", "block_no", "type", "role", "text", "call_id", "usage.total")


@query("agg_03_session_header_b", f"SELECT '/b/' || conv_id AS path, conv_id::VARCHAR AS session_id, CASE WHEN bool_or(role = 'assistant') THEN 'big-model' END AS model, {preview_sql('arg_min(text, turn) FILTER (role = ' + chr(39) + 'user' + chr(39) + ')', 80)} AS title FROM conversations GROUP BY conv_id")
def agg_03(spark, sf):
    return L.build_sessions_b(lines_b(spark, sf)).select("path", "session_id", "model", "title")


@query("prj_01_normalize_usage", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 3 ELSE event_id % 40 END::BIGINT AS input, (event_id % 7)::BIGINT AS output, (event_id % 5)::BIGINT AS cache_read, (CASE WHEN event_id % 3 = 0 THEN event_id % 3 ELSE event_id % 40 END + event_id % 7)::BIGINT AS total FROM events")
def prj_01(spark, sf):
    e = table(spark, sf, "events")
    k = F.col("event_id") % 3
    raw = F.to_json(F.struct(F.when(k == 1, F.col("event_id") % 40).alias("prompt_tokens"), F.when(k == 2, (F.col("event_id") % 40).cast("string")).alias("inputTokens"), F.when(k == 0, -5).alias("input"), (F.col("event_id") % 7).alias("completion_tokens"), F.struct((F.col("event_id") % 5).alias("cached_tokens")).alias("prompt_tokens_details")))
    u = U.normalize_usage(F.try_parse_json(raw))
    return e.select("event_id", u["input"].alias("input"), u["output"].alias("output"), u["cache_read"].alias("cache_read"), u["total"].alias("total"))


def open_values(spark, sf):
    """Content of three shapes from the conversations: a text, an array of text and image, an object."""
    c = table(spark, sf, "conversations")
    k = F.col("turn") % 3
    parts = F.array(F.struct(F.lit("input_text").alias("type"), F.col("text").alias("text"), F.lit(None).cast("string").alias("image_url")), F.struct(F.lit("input_image").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("http://x/y.png").alias("image_url")))
    raw = F.when(k == 0, F.to_json(F.array("text")).substr(F.lit(2), F.length(F.to_json(F.array("text"))) - 2)).when(k == 1, F.to_json(parts)).otherwise(F.to_json(F.struct(F.lit("note").alias("type"), F.col("role").alias("who"))))
    return c.select("conv_id", "turn", "role", "text", F.try_parse_json(raw).alias("v"))


@query("prj_02_normalize_content", "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'text,input_image' ELSE 'note' END AS types, CASE WHEN turn % 3 < 2 THEN text END AS first_text FROM conversations")
def prj_02(spark, sf):
    n = open_values(spark, sf).withColumn("n", C.normalize_content(F.col("v")))
    return n.select("conv_id", "turn", F.array_join(F.transform("n", lambda b: b.type), ",").alias("types"), F.get("n", F.lit(0))["text"].alias("first_text"))


@query("prj_12_content_text", "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN text || chr(10) || '[image: http://x/y.png]' ELSE '{\"type\":\"note\",\"who\":\"' || role || '\"}' END AS text FROM conversations")
def prj_12(spark, sf):
    return open_values(spark, sf).select("conv_id", "turn", C.content_text(F.col("v")).alias("text"))


@query("prj_10_event_text", "SELECT conv_id, turn, role || chr(10) || CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN text || chr(10) || '{\"image_url\":\"http://x/y.png\",\"type\":\"input_image\"}' ELSE '{\"type\":\"note\",\"who\":\"' || role || '\"}' END || chr(10) || 'call-' || conv_id || CASE WHEN turn % 2 = 0 THEN chr(10) || '{\"turn\":' || turn || '}' ELSE '' END AS text FROM conversations")
def prj_10(spark, sf):
    arguments = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct("turn")))
    whole = C.event_text(F.col("text"), C.normalize_content(F.col("v")), F.concat(F.lit("call-"), F.col("conv_id").cast("string")), arguments, before=(F.lit(""), F.col("role")))
    return open_values(spark, sf).select("conv_id", "turn", whole.alias("text"))


@query(
    "prj_10b_event_documents",
    """SELECT conv_id::VARCHAR AS session_id, turn + 1 AS line_no, 0 AS block_no, role || CASE WHEN text <> '' THEN chr(10) || text ELSE '' END AS search_text, true AS visible FROM conversations WHERE text <> ''
    UNION ALL SELECT conv_id::VARCHAR, turn + 1, 0, '', false FROM conversations WHERE text = '' AND role <> 'user'
    UNION ALL SELECT conv_id::VARCHAR, turn + 1, 1, 'assistant' || chr(10) || 'look' || chr(10) || '{"q":' || turn || '}', true FROM conversations WHERE role = 'assistant'
    UNION ALL SELECT conv_id::VARCHAR, turn + 1, 1048576, 'assistant' || chr(10) || '{"cache_read":0,"cache_write":0,"input":' || turn || ',"output":5,"reasoning":0,"total":' || (turn + 5) || '}', true FROM conversations WHERE role = 'assistant'""",
)
def prj_10b(spark, sf):
    events = E.accepted(E.normalize_events(L.rows_to_events_b(lines_b(spark, sf))))
    return E.event_documents(events).select("session_id", "line_no", "block_no", "search_text", F.col("retrieval_visible").alias("visible"))


@query("prj_05_reasoning_flags", "SELECT event_id, event_id % 2 = 0 AS has_summary, event_id % 3 = 0 AS has_encrypted, false AS has_signature FROM events")
def prj_05(spark, sf):
    e = table(spark, sf, "events")
    raw = F.to_json(F.struct(F.when(F.col("event_id") % 2 == 0, F.array(F.lit("s"))).otherwise(F.array().cast("array<string>")).alias("summary"), F.when(F.col("event_id") % 3 == 0, "xyz").alias("encrypted_content")))
    return e.select("event_id", F.explode(C.reasoning_flags(F.try_parse_json(raw))).alias("f")).select("event_id", "f.*")


@query("prj_06_norm_call", "SELECT event_id, 'c' || event_id AS id, event_type AS name, '{\"k\":' || (event_id % 10) || '}' AS arguments FROM events")
def prj_06(spark, sf):
    odd = F.col("event_id") % 2 == 1
    id_, args = F.concat(F.lit("c"), "event_id"), F.struct((F.col("event_id") % 10).alias("k"))
    raw = F.to_json(F.struct(F.when(odd, id_).alias("id"), F.when(~odd, id_).alias("call_id"), F.when(odd, F.col("event_type")).alias("name"), F.when(~odd, F.col("event_type")).alias("toolName"), F.when(odd, args).alias("arguments"), F.when(~odd, args).alias("input")))
    return table(spark, sf, "events").select("event_id", C.norm_call(F.try_parse_json(raw)).alias("c")).select("event_id", "c.*")


@query("prj_13_payload_digest", f"SELECT doc_id, {preview_sql('text', 600)} AS text, '[' || (doc_id % 3 + 1) || ' items]' AS items, '{{lang, n}}' AS keys FROM documents")
def prj_13(spark, sf):
    d = table(spark, sf, "documents")
    raw = F.to_json(F.struct("text", F.sequence(F.lit(0), F.col("doc_id") % 3).alias("items"), F.struct("lang", F.lit(1).alias("n")).alias("obj")))
    m = C.payload_digest(F.try_parse_json(raw), ["text", "items", "obj", "absent"])
    return d.select("doc_id", m["text"].alias("text"), m["items"].alias("items"), m["obj"].alias("keys"))


@query("prj_19_canonical_tool_results", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text || '|' || role END AS texts, CASE WHEN turn % 2 = 1 THEN text END AS content, turn % 2 = 1 AS is_verbatim FROM conversations WHERE text <> role")
def prj_19(spark, sf):
    c = table(spark, sf, "conversations").where("text <> role")
    ref = lambda t: F.struct(t.alias("text"))
    listed = F.to_json(F.struct(F.struct(F.array(ref(F.col("text")), ref(F.col("role")), ref(F.col("text"))).alias("refs")).alias("structuredContent")))
    opened = F.to_json(F.struct(F.struct(F.col("text").alias("content"), F.lit(True).alias("isVerbatim"), F.lit(0).alias("omittedTokenCount")).alias("result")))
    r = C.canonical_tool_result(F.when(F.col("turn") % 2 == 0, listed).otherwise(opened))
    return c.select("conv_id", "turn", r.alias("r")).select("conv_id", "turn", F.array_join("r.texts", "|").alias("texts"), "r.content", "r.is_verbatim")


@query("prj_21_valid_text", "SELECT doc_id, text || chr(65533) || text AS text FROM documents")
def prj_21(spark, sf):
    broken = F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF")), F.col("text").cast("binary"))
    return table(spark, sf, "documents").select("doc_id", C.valid_text(broken.cast("string")).alias("text"))


@query("src_11_changes", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'M' ELSE 'A' END AS status, CASE WHEN page_id % 3 = 0 THEN 'old/' || page_id END AS old_path, 'new/' || page_id AS path FROM pages")
def src_11(spark, sf):
    p = table(spark, sf, "pages")
    k = F.col("page_id") % 3
    record = F.when(k == 0, F.concat_ws("\u0000", F.lit("R100"), F.concat(F.lit("old/"), "page_id"), F.concat(F.lit("new/"), "page_id"))).otherwise(F.concat_ws("\u0000", F.when(k == 1, "M").otherwise("A"), F.concat(F.lit("new/"), "page_id")))
    text = p.groupBy((F.col("page_id") % 7).alias("batch")).agg(F.concat(F.array_join(F.collect_list(record), "\u0000"), F.lit("\u0000")).alias("value"))
    return L.parse_changes(text).select(F.regexp_extract("path", "([0-9]+)$", 1).cast("long").alias("page_id"), "status", "old_path", "path")


@query("src_10_doc_sections", "SELECT 'docs/' || page_id || '-a_b.md' AS doc_path, 'p' || page_id AS section_id, CASE WHEN page_id % 2 = 0 THEN 'Title ' || page_id ELSE page_id || ' a b' END AS title, 'src/' || page_id || '/**|lib' AS scopes FROM pages")
def src_10(spark, sf):
    p = table(spark, sf, "pages")
    head = F.concat(F.lit("---\nid: p"), "page_id", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('\ntitle: "Title '), "page_id", F.lit('"'))).otherwise(""), F.lit("\nscopes:\n  - src/"), "page_id", F.lit('/**\n  - "lib"\n---\n'), "html")
    return L.read_doc_sections(p.select(F.concat(F.lit("docs/"), "page_id", F.lit("-a_b.md")).alias("path"), head.alias("value"))).withColumn("scopes", F.array_join("scopes", "|"))


@query("agg_15_analyze_sessions", "SELECT '/logs/' || conv_id || '.jsonl' AS path, '/work' AS current_path, count(*) FILTER (contains(text, 'the')) AS term_lines FROM conversations GROUP BY conv_id")
def agg_15(spark, sf):
    from ..operators import forensics as X

    return X.analyze_sessions(L.split_lines(files_a(spark, sf)), ["the"]).select("path", "current_path", "term_lines")
