"""Queries over text, id and number expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from .catalog import query, table

#: The white space class and the preview in DuckDB.
SPACES = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def compact_sql(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{SPACES}', ' ', 'g'))"


def preview_sql(c: str, most: int = 240, less: int = 3) -> str:
    t = compact_sql(c)
    return f"CASE WHEN length({t}) > {most} THEN substr({t}, 1, {most - less}) || '...' ELSE {t} END"


def tokens_sql(c: str) -> str:
    return f"greatest(1, ceil(length(coalesce({c}, '')) / 4.0))::BIGINT"


def safe_sql(c: str) -> str:
    return f"coalesce(nullif(substr(regexp_replace(regexp_replace(coalesce({c}, ''), '[^A-Za-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 96), ''), 'item')"


@query("scl_01_compact_text", f"SELECT doc_id, {compact_sql('text')} AS compact FROM documents")
def scl_01(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.compact_text(F.col("text")).alias("compact"))


@query("scl_02_preview", f"SELECT doc_id, {preview_sql('text')} AS preview, {preview_sql('text', 80)} AS short FROM documents")
def scl_02(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"), T.preview(F.col("text"), 80).alias("short"))


@query("scl_02b_preview_raw", f"SELECT page_id, {preview_sql('html', 160, 0)} AS preview FROM pages")
def scl_02b(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.preview_raw(F.col("html"), 160).alias("preview"))


_NOW = "TIMESTAMP '2024-03-01 00:00:00'"


@query(
    "scl_03_format_ago",
    f"""WITH e AS (SELECT event_id, greatest(0, floor((epoch_ms({_NOW}) - epoch_ms(ts)) / 1000.0))::BIGINT AS s FROM events)
    SELECT event_id, CASE WHEN s < 5 THEN 'just now' WHEN s < 60 THEN s || 's ago' WHEN s // 60 < 60 THEN (s // 60) || 'm ago'
      WHEN s // 3600 < 24 THEN (s // 3600) || 'h ago' WHEN s // 86400 < 30 THEN (s // 86400) || 'd ago'
      WHEN s // 86400 // 30 < 12 THEN (s // 86400 // 30) || 'mo ago' ELSE (s // 86400 // 365) || 'y ago' END AS ago FROM e""",
)
def scl_03(spark, sf):
    return table(spark, sf, "events").select("event_id", T.format_ago(F.col("ts"), F.expr(_NOW)).alias("ago"))


@query("scl_04_estimate_tokens", f"SELECT doc_id, {tokens_sql('text')} AS tokens FROM documents")
def scl_04(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query("scl_05_safe_id", f"SELECT page_id, {safe_sql('url')} AS id FROM pages")
def scl_05(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.safe_id(F.col("url")).alias("id"))


@query("scl_06_hash_text", "SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents")
def scl_06(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.hash_text(F.col("text")).alias("hash"))


@query(
    "scl_07_truncate_source",
    "SELECT doc_id, CASE WHEN length(text) <= 1000 THEN text ELSE substr(text, 1, 936) || chr(10) || '[truncated ' || (length(text) - 936) || ' chars]' END AS cut FROM documents",
)
def scl_07(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.truncate_source(F.col("text"), 1000).alias("cut"))


_PATH = "concat('/logs/', substr(sha2, 1, 2), '/run-', substr(sha2, 1, 8), '-', substr(sha2, 9, 4), '-', substr(sha2, 13, 4), '-', substr(sha2, 17, 4), '-', substr(sha2, 21, 12), '.jsonl')"


@query(
    "scl_08_session_id_from_path",
    f"""WITH p AS (SELECT user_id, CASE WHEN user_id % 5 = 0 THEN '/logs/plain-' || user_id || '.jsonl' ELSE {_PATH} END AS path
      FROM (SELECT DISTINCT user_id, sha256(user_id::VARCHAR) AS sha2 FROM events)),
    m AS (SELECT *, nullif(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '([0-9a-f]{{8}}-[0-9a-f-]{{27,}})', 1), '') AS found FROM p)
    SELECT user_id, path, found AS strict_id, coalesce(found, substr(sha256(path), 1, 24)) AS session_id FROM m""",
)
def scl_08(spark, sf):
    users = table(spark, sf, "events").select("user_id").distinct().withColumn("sha2", F.sha2(F.col("user_id").cast("string"), 256))
    paths = users.select("user_id", F.when(F.col("user_id") % 5 == 0, F.concat(F.lit("/logs/plain-"), "user_id", F.lit(".jsonl"))).otherwise(F.expr(_PATH)).alias("path"))
    return paths.select("user_id", "path", T.session_id_from_path(F.col("path"), strict=True).alias("strict_id"), T.session_id_from_path(F.col("path")).alias("session_id"))


@query(
    "scl_09_shorten",
    "SELECT page_id, CASE WHEN length(url) <= 30 THEN url ELSE substr(url, 1, 13) || '...' || right(url, 13) END AS middle, CASE WHEN length(url) <= 30 THEN url ELSE '...' || right(url, 27) END AS tail FROM pages",
)
def scl_09(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.shorten(F.col("url"), 30).alias("middle"), T.shorten(F.col("url"), 30, "tail").alias("tail"))


@query("scl_10_ceil_cents", "SELECT event_id, CASE WHEN value IS NULL OR value / 7 <= 0 THEN 0.0::DOUBLE ELSE ceil((value / 7 - 1e-9::DOUBLE) * 100) / 100.0::DOUBLE END AS usd FROM events")
def scl_10(spark, sf):
    return table(spark, sf, "events").select("event_id", T.ceil_cents(F.col("value") / 7).alias("usd"))


_ERROR = "CASE WHEN event_id % 4 = 0 THEN concat('429: Retry after ', value, ' seconds') WHEN event_id % 4 = 1 THEN concat('try again in ', cast(event_id % 7 AS {s}), ' min') WHEN event_id % 4 = 2 THEN 'too many requests' ELSE concat('failed on ', event_type) END"


@query(
    "scl_11_retry_after",
    f"""WITH e AS (SELECT event_id, {_ERROR.format(s="VARCHAR")} AS error FROM events),
    m AS (SELECT *, try_cast(nullif(regexp_extract(error, '(?i)(?:retry after|try again in)\\s+([0-9.]+)\\s*(?:minutes|minute|mins|min|m)', 1), '') AS DOUBLE) AS mins,
      try_cast(nullif(regexp_extract(error, '(?i)(?:retry after|try again in)\\s+([0-9.]+)\\s*(?:seconds|second|secs|sec|s)?\\b', 1), '') AS DOUBLE) AS secs FROM e)
    SELECT event_id, regexp_matches(error, '(?i)\\b429\\b|rate[_ -]?limit|too many requests|tokens per minute|requests per minute|retry after') AS limited,
      coalesce(ceil(mins * 60000), ceil(secs * 1000))::BIGINT AS wait_ms FROM m""",
)
def scl_11(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.expr(_ERROR.format(s="STRING")).alias("error"))
    return e.select("event_id", T.is_rate_limited(F.col("error")).alias("limited"), T.retry_after_ms(F.col("error")).alias("wait_ms"))


@query(
    "scl_14_normalize_topics",
    f"""WITH t AS (SELECT doc_id, unnest(string_split(text, ' ')) AS raw, generate_subscripts(string_split(text, ' '), 1) AS pos FROM documents),
    p AS (SELECT doc_id, pos, {preview_sql('raw', 220)} AS topic FROM t),
    f AS (SELECT doc_id, lower(topic) AS k, arg_min(topic, pos) AS topic, min(pos) AS pos FROM p WHERE topic <> '' GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM f)
    SELECT d.doc_id, coalesce(string_agg(topic, '|' ORDER BY pos), '') AS topics FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id AND n <= 8 GROUP BY 1""",
)
def scl_14(spark, sf):
    words = F.split("text", " ")
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.normalize_topics(words), "|").alias("topics"))


_MODEL = "concat(CASE event_id % 6 WHEN 0 THEN 'Claude-' WHEN 1 THEN 'gemini-' WHEN 2 THEN 'GPT-' WHEN 3 THEN 'o3-' WHEN 4 THEN 'OpenAI' ELSE '' END, event_type)"


@query(
    "prj_03_model_family",
    f"""WITH m AS (SELECT event_id, lower({_MODEL}) AS m FROM events)
    SELECT event_id, CASE WHEN contains(m, 'claude') OR contains(m, 'anthropic') THEN 'anthropic' WHEN contains(m, 'gemini') OR contains(m, 'google') THEN 'google'
      WHEN contains(m, 'gpt') OR contains(m, 'openai') OR contains(m, 'o3') OR contains(m, 'o4') THEN 'openai' WHEN m IN ('openai', 'anthropic', 'google', 'unknown') THEN m ELSE 'unknown' END AS family FROM m""",
)
def prj_03(spark, sf):
    return table(spark, sf, "events").select("event_id", T.model_family(F.expr(_MODEL)).alias("family"))


@query(
    "prj_04_role",
    "SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'observer' ELSE lower(role) END AS role FROM conversations",
)
def prj_04(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", T.norm_role(F.when(F.col("turn") % 4 == 3, F.lit("Critic")).otherwise(F.upper("role"))).alias("role"))


@query(
    "prj_08_event_id",
    """SELECT event_id, CASE WHEN event_id % 9 = 0 THEN substr(sha256('||'), 1, 24)
      ELSE concat_ws(':', 'table', CASE WHEN event_id % 2 = 0 THEN event_type END, event_id::VARCHAR) END AS id FROM events""",
)
def prj_08(spark, sf):
    odd = F.col("event_id") % 9 == 0
    part = lambda c: F.when(odd, F.lit("")).otherwise(c)
    kind = F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise("")
    return table(spark, sf, "events").select("event_id", T.event_id(part(F.lit("table")), part(kind), part(F.col("event_id").cast("string"))).alias("id"))


@query(
    "prj_09_message_id",
    "WITH m AS (SELECT conv_id, turn, 'msg_' || substr(sha256(conv_id || '/' || turn), 1, 20) AS id FROM conversations) SELECT conv_id, turn, id, id AS again FROM m",
)
def prj_09(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", T.message_id(F.concat_ws("/", "conv_id", "turn")).alias("id"))
    return c.withColumn("again", T.message_id(F.col("id")))


_INLINE = "concat(url, ' data:', CASE page_id % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'application/pdf' ELSE 'audio/ogg' END, ';base64,', substr(html, 1, 0), 'QUJD== end')"


@query(
    "prj_11_redact_inline",
    r"SELECT page_id, url || ' ' || CASE page_id % 3 WHEN 0 THEN '[inline image/png data omitted]' WHEN 1 THEN '[inline data omitted]' ELSE '[inline audio/ogg data omitted]' END || ' end' AS clean FROM pages",
)
def prj_11(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.redact_inline(F.expr(_INLINE)).alias("clean"))


def handle_sql(session: str, ordinal: str, kind: str, id_: str) -> str:
    """SQL of a handle whose parts need no percent-encoding."""
    return f"'session/' || {session} || '/event/' || lpad(({ordinal})::VARCHAR, 6, '0') || '-' || {safe_sql(kind)} || '-' || substr({safe_sql(id_)}, 1, 18)"


@query("prj_15_handles", f"SELECT event_id, {handle_sql('user_id', 'event_id', 'event_type', 'props')} AS handle, replace(replace(url_encode(props), '+', '%20'), '~', '~') AS encoded FROM events")
def prj_15(spark, sf):
    return table(spark, sf, "events").select("event_id", T.handle(F.col("user_id").cast("string"), F.col("event_id"), F.col("event_type"), F.col("props")).alias("handle"), T.encode_uri(F.col("props")).alias("encoded"))


@query(
    "prj_16_links",
    """SELECT page_id, 'tool:sessions://open?sessionId=s%2F' || page_id || '&handle=session%2Fs%2F' || page_id AS link, 's/' || page_id AS session_id, 'session/s/' || page_id AS handle, 'session/' || page_id AS bare FROM pages""",
)
def prj_16(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.concat(F.lit("s/"), "page_id").alias("s"))
    p = p.withColumn("link", T.session_link(F.concat(F.lit("session/"), "s"), session_id=F.col("s"))).withColumn("open", T.parse_link(F.col("link")))
    return p.select("page_id", "link", "open.session_id", "open.handle", T.parse_link(F.concat(F.lit("session/"), "page_id"))["handle"].alias("bare"))


@query(
    "prj_17_topic_ids",
    """WITH t AS (SELECT conv_id, turn, 'topic:v1:' || rtrim(translate(base64(('{"h":"session/' || conv_id || '","i":' || turn || '}')::BLOB), '+/', '-_'), '=') AS id FROM conversations)
    SELECT conv_id, turn, id, 'session/' || conv_id AS handle, turn::INTEGER AS topic_index, NULL::VARCHAR AS bad FROM t""",
)
def prj_17(spark, sf):
    c = table(spark, sf, "conversations").withColumn("id", T.topic_id(F.concat(F.lit("session/"), "conv_id"), F.col("turn")))
    c = c.withColumn("p", T.parse_topic_id(F.col("id"))).withColumn("q", T.parse_topic_id(F.concat(F.lit("topic:v1:*"), "id")))
    return c.select("conv_id", "turn", "id", "p.handle", "p.topic_index", F.col("q.handle").alias("bad"))


@query(
    "prj_18_public_view",
    "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'root' ELSE 'event/' || event_id END AS public, CASE WHEN event_id % 5 = 0 THEN 'session/' || user_id ELSE 'session/' || user_id || '/event/' || event_id END AS internal FROM events",
)
def prj_18(spark, sf):
    user = F.col("user_id").cast("string")
    full = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("session/"), user)).otherwise(F.concat(F.lit("session/"), user, F.lit("/event/"), F.col("event_id").cast("string")))
    e = table(spark, sf, "events").withColumn("public", T.relative_handle(full, user))
    return e.select("event_id", "public", T.absolute_handle(F.col("public"), user).alias("internal"))


@query("set_02_unique", "SELECT conv_id, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM conversations GROUP BY 1")
def set_02(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("role")).alias("r"))
    return c.select("conv_id", F.array_join(T.unique(F.concat(F.array(F.lit("")), "r")), ",").alias("roles"))


@query(
    "lim_06_cap_links",
    r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) AS pos FROM pages),
    d AS (SELECT page_id, link, min(pos) AS pos FROM l WHERE link <> '' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM d)
    SELECT p.page_id, coalesce(string_agg(link, ' ' ORDER BY pos), '') AS links FROM pages p LEFT JOIN r ON p.page_id = r.page_id AND n <= 5 GROUP BY 1""",
)
def lim_06(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(T.cap_links(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))), " ").alias("links"))


@query("flt_06_topic_match", "SELECT doc_id FROM documents WHERE contains(lower(text[1:0] || source), 'src1') AND contains(lower(source), 'src1')")
def flt_06(spark, sf):
    return table(spark, sf, "documents").where(T.topic_match(F.array("lang", "source"), "SRC1 ")).select("doc_id")


@query("flt_07_term_match", "SELECT doc_id, regexp_matches(text, 'licen[cs]e') AS by_regex, contains(text, 'License') OR contains(text, 'GNU') AS by_term FROM documents")
def flt_07(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.term_match(F.col("text"), "licen[cs]e", regex=True).alias("by_regex"), T.term_match(F.col("text"), "License", "GNU").alias("by_term"))


@query(
    "flt_08_scope_match",
    r"""WITH s(scope, re) AS (VALUES ('fr', '^fr(/.*)?$'), ('*/8*', '^[^/]*/8[^/]*$'), ('**/1?', '^.*/1\?$'), ('en/**', '^en/.*$')),
    p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/([^?]*)', 1) AS path FROM pages)
    SELECT page_id, path, scope FROM p, s WHERE regexp_matches(path, re)""",
)
def flt_08(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/]+/([^?]*)", 1).alias("path"))
    scopes = spark.createDataFrame([("fr",), ("*/8*",), ("**/1?",), ("en/**",)], "scope string")
    return pages.join(F.broadcast(scopes), T.scope_match(F.col("path"), F.col("scope"))).select("page_id", "path", "scope")
