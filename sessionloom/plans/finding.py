"""Queries that search, browse, open and page."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import search as S
from ..operators.tree import SEARCH_TEXT
from ..sources.sinks import written
from .catalog import query, table
from .scalars import compact_sql, preview_sql, tokens_sql
from .trees import DOCS, NODES, WHOLE_DOCS, docs, nodes

QUERIES = [(1, "The and with"), (2, "de la"), (3, "Erthat!! IDIOT"), (4, "der die")]
REQUESTS = "requests(request_id, query) AS (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in QUERIES) + ")"
TOKENS = "list_filter(string_split(lower(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda t: t <> '')"
_IX = f"""tk AS (SELECT session_id, handle, unnest({TOKENS.format(c="search_text")}) AS token FROM dc WHERE retrieval_visible AND search_text <> ''),
  ix AS (SELECT token, session_id, handle, count(*) AS tf FROM tk GROUP BY ALL)"""
INDEX, WHOLE_INDEX = f"{DOCS}, {_IX}", f"{WHOLE_DOCS}, {_IX}"


def requests(spark):
    return spark.createDataFrame(QUERIES, "request_id int, query string")


@query("sr_01_search_index", f"WITH {INDEX} SELECT token, session_id, handle, tf FROM ix")
def sr_01(spark, sf):
    return S.build_search_index(docs(spark, sf, SEARCH_TEXT))


@query(
    "sr_02_search",
    f"""WITH {INDEX}, {REQUESTS}, w AS (SELECT DISTINCT request_id, unnest({TOKENS.format(c="query")}) AS token FROM requests),
    s AS (SELECT request_id, session_id, handle, count(*) AS matched, sum(tf)::BIGINT AS tf FROM ix JOIN w USING (token) GROUP BY ALL),
    r AS (SELECT s.*, row_number() OVER (PARTITION BY request_id ORDER BY matched DESC, tf DESC, start_at, session_id, handle) - 1 AS place, count(*) OVER (PARTITION BY request_id) AS total FROM s JOIN dc USING (session_id, handle))
    SELECT request_id, place::INTEGER AS place, session_id, handle, matched, tf, total, CASE WHEN total > 10 THEN 10::BIGINT END AS next_start FROM r WHERE place < 10""",
)
def sr_02(spark, sf):
    return S.search(docs(spark, sf, SEARCH_TEXT), requests(spark)).select("request_id", "place", "session_id", "handle", "matched", "tf", "total", "next_start")


#: Requests with their own topic, roles, depth and page; the fifth has a filter alone, the last asks for nothing.
ASKED = [(1, "The and with", "de", ["user", "assistant"], None, 0, 12), (2, "", "der DIE", ["assistant"], 1, 3, 9), (3, "la", None, None, None, 0, 7), (4, "the", "", ["nobody"], None, 0, 5), (5, None, None, ["user"], None, 4, 6), (6, "", "", [], None, 0, 5)]


def asked_sql() -> str:
    text = lambda v: "NULL" if v is None else f"'{v}'"
    listed = lambda v: "[]::VARCHAR[]" if not v else "[" + ", ".join(map(text, v)) + "]"
    rows = ", ".join(f"({i}, {text(q)}, {text(t)}, {listed(r)}, {'NULL' if m is None else m}::INTEGER, {a}, {b})" for i, q, t, r, m, a, b in ASKED)
    return f"rq(request_id, query, topic, roles, mip, start_, limit_) AS (VALUES {rows})"


@query(
    "sr_02b_find_refs",
    f"""WITH {WHOLE_INDEX}, {asked_sql()}, w AS (SELECT DISTINCT request_id, unnest({TOKENS.format(c="concat_ws(' ', query, topic)")}) AS token FROM rq),
    s AS (SELECT request_id, session_id, handle, count(*) AS matched, sum(tf)::BIGINT AS tf FROM ix JOIN w USING (token) GROUP BY ALL
      UNION ALL SELECT request_id, session_id, handle, 1, 1 FROM rq JOIN dc ON list_contains(roles, role) WHERE retrieval_visible AND search_text <> '' AND request_id NOT IN (SELECT request_id FROM w)),
    f AS (SELECT s.*, dc.start_at, dc.role, dc.pos // 4 AS line, start_, limit_ FROM s JOIN dc USING (session_id, handle) JOIN rq USING (request_id) WHERE (len(roles) = 0 OR list_contains(roles, role)) AND (mip IS NULL OR depth = mip)),
    r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY matched DESC, tf DESC, start_at, session_id, handle) - 1 AS place, count(*) OVER (PARTITION BY request_id) AS total FROM f),
    c AS (SELECT p.session_id, p.pos // 4 AS line, arg_min(n.raw, n.handle) AS content FROM nt n JOIN nt p ON n.parent_handle = p.handle AND n.session_id = p.session_id WHERE n.depth = 2 GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY request_id, session_id, line, role ORDER BY handle) AS nth FROM r WHERE place >= start_ AND place < start_ + limit_)
    SELECT request_id, place::INTEGER AS place, session_id, handle, matched, tf, total, CASE WHEN total > start_ + limit_ THEN (start_ + limit_)::BIGINT END AS next_start, content FROM k JOIN c USING (session_id, line) WHERE nth = 1""",
)
def sr_02b(spark, sf):
    asked = spark.createDataFrame(ASKED, "request_id int, query string, topic string, role array<string>, mip int, start int, limit int")
    line = F.floor(F.regexp_extract("handle", "/event/([0-9]+)-", 1).cast("int") / 4).cast("long")
    d = docs(spark, sf).withColumn("line", F.floor(F.col("pos") / 4)).withColumn("message_id", F.lit(None).cast("string"))
    n = nodes(spark, sf).withColumn("line", line)
    return S.find_refs(d, n, asked).select("request_id", "place", "session_id", "handle", "matched", "tf", "total", "next_start", "content")


@query("sr_03_filter_only", f"WITH {DOCS}, r AS (SELECT *, row_number() OVER (ORDER BY start_at, session_id, handle) - 1 AS place FROM dc WHERE retrieval_visible AND search_text <> '' AND role = 'user') SELECT place::INTEGER AS place, session_id, handle FROM r WHERE place BETWEEN 5 AND 24")
def sr_03(spark, sf):
    everything = spark.createDataFrame([(1, "*")], "request_id int, query string")
    return S.search(S.apply_search_filter(docs(spark, sf), role="user"), everything, 5, 20).select("place", "session_id", "handle")


@query(
    "sr_04_topic_children",
    f"""WITH {WHOLE_INDEX}, s AS (SELECT session_id, handle, count(*) AS matched FROM ix WHERE token IN ('the', 'and', 'de') GROUP BY ALL),
    r AS (SELECT c.session_id, c.handle, matched, row_number() OVER (PARTITION BY c.session_id ORDER BY matched DESC, pos, c.handle) - 1 AS place FROM dc c JOIN s USING (session_id, handle) WHERE depth = 1)
    SELECT session_id, handle, matched, place::INTEGER AS place FROM r WHERE place < 3""",
)
def sr_04(spark, sf):
    d = written(docs(spark, sf).select("session_id", "handle", "parent_handle", "depth", "pos", "kind", "type", "role", "search_text", "retrieval_visible"))  # browse reads them again and again
    roots = d.where("depth = 0").select(F.col("session_id").alias("request_id"), "session_id", "handle", F.lit("children").alias("zoom"), F.lit("the and de").alias("topic"))
    return S.browse(d, roots, 0, 3).select("session_id", "handle", "matched", "place")


@query("flt_01_search_filter", f"WITH {DOCS} SELECT session_id, handle FROM dc WHERE retrieval_visible AND role IN ('user', 'system') AND parent_handle IN ('session/1', 'session/2', 'session/3') AND depth = 1")
def flt_01(spark, sf):
    return S.apply_search_filter(docs(spark, sf), mip=1, role=["user", "system"], parent_handle=["session/1", "session/2", "session/3"]).select("session_id", "handle")


@query("jn_05_parent_children", f"WITH {NODES}, nm AS MATERIALIZED (SELECT session_id, handle, parent_handle FROM nt) SELECT p.session_id, p.handle AS parent, c.handle AS child FROM nm p JOIN nm c ON c.parent_handle = p.handle AND c.session_id = p.session_id")
def jn_05(spark, sf):
    n = nodes(spark, sf)
    asked = n.select(F.col("handle").alias("request_id"), "session_id", "handle")
    kids = S.children_of(n, asked).select("session_id", F.col("handle").alias("child"))
    up = S.parent_of(n, kids.select(F.col("child").alias("request_id"), "session_id", F.col("child").alias("handle")))
    return up.select("session_id", F.col("handle").alias("parent"), F.col("request_id").alias("child"))


@query(
    "hi_15_browse",
    f"""WITH {DOCS}, q AS (SELECT session_id, handle, parent_handle FROM dc WHERE depth = 1 AND pos = 1),
    l AS (SELECT 'siblings' AS zoom, c.session_id, c.handle, c.pos FROM dc c JOIN q ON c.session_id = q.session_id AND c.parent_handle = q.parent_handle
      UNION ALL SELECT 'out', c.session_id, c.handle, c.pos FROM dc c JOIN q ON c.session_id = q.session_id AND c.handle = q.parent_handle
      UNION ALL SELECT 'in', c.session_id, c.handle, c.pos FROM dc c JOIN q ON c.session_id = q.session_id AND c.parent_handle = q.handle JOIN dc p ON p.handle = q.handle WHERE p.role NOT IN ('user', 'assistant')),
    r AS (SELECT *, row_number() OVER (PARTITION BY zoom, session_id ORDER BY pos, handle) - 1 AS place FROM l)
    SELECT zoom, session_id, handle, place::INTEGER AS place FROM r WHERE place < 2""",
)
def hi_15(spark, sf):
    d = docs(spark, sf)
    asked = d.where("depth = 1 and pos = 1").select("session_id", "handle", F.explode(F.array(*[F.lit(z) for z in ("siblings", "out", "in")])).alias("zoom"), F.lit("").alias("topic"))
    asked = asked.withColumn("request_id", F.concat_ws("|", "zoom", "session_id"))
    return S.browse(d, asked, 0, 2).select(F.split_part("request_id", F.lit("|"), F.lit(1)).alias("zoom"), "session_id", "handle", "place")


@query(
    "hi_15b_stand_in",
    """WITH p AS (SELECT doc_id, source, lang, n_chars, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS pos FROM documents),
    r AS (SELECT source || '/' || lang AS session_id, doc_id, pos, row_number() OVER (PARTITION BY source, lang ORDER BY pos) - 1 AS place FROM p)
    SELECT session_id, CASE WHEN session_id LIKE '%/en' THEN 'd' || doc_id ELSE 'sum' END AS handle, place::INTEGER AS place FROM r WHERE CASE WHEN session_id LIKE '%/en' THEN place < 5 ELSE place = 0 END""",
)
def hi_15b(spark, sf):
    """Roots without text over a single child: of English sessions that is a generated summary, whose children are listed in its stead."""
    d = table(spark, sf, "documents").select(F.concat_ws("/", "source", "lang").alias("session_id"), "lang", "doc_id", F.col("text").alias("search_text"))
    none = F.lit(None).cast("string")
    pos = F.row_number().over(Window.partitionBy("session_id").orderBy("doc_id")) - 1
    leaves = d.select("session_id", F.concat(F.lit("d"), "doc_id").alias("handle"), F.lit("sum").alias("parent_handle"), F.lit(2).alias("depth"), pos.cast("long").alias("pos"), F.lit("note").alias("kind"), "search_text")
    ids = d.select("session_id", "lang").distinct()
    kind = F.when(F.col("lang") == "en", "summary_span").otherwise("note")
    mids = ids.select("session_id", F.lit("sum").alias("handle"), F.lit("root").alias("parent_handle"), F.lit(1).alias("depth"), F.lit(0).cast("long").alias("pos"), kind.alias("kind"), F.lit("brief").alias("search_text"))
    roots = ids.select("session_id", F.lit("root").alias("handle"), none.alias("parent_handle"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("pos"), F.lit("session").alias("kind"), F.lit("").alias("search_text"))
    every = leaves.unionByName(mids).unionByName(roots).withColumns({"type": none, "role": none, "retrieval_visible": F.lit(True)})
    asked = ids.select(F.col("session_id").alias("request_id"), "session_id", F.lit("root").alias("handle"), F.lit("children").alias("zoom"), F.lit("").alias("topic"))
    return S.browse(every, asked, 0, 5).select("session_id", "handle", "place")


@query(
    "hi_16_open",
    f"""WITH {DOCS}, dm AS MATERIALIZED (SELECT * FROM dc), nm AS MATERIALIZED (SELECT handle, head FROM nt), q AS (SELECT session_id, handle, kind, depth, full_tokens, title, CASE WHEN depth = 0 THEN '' ELSE full_text END AS t, CASE pos % 3 WHEN 0 THEN 1000 WHEN 1 THEN 60 ELSE 10 END AS budget, role FROM dm WHERE depth < 2),
    o AS (SELECT *, t <> '' AS has, full_tokens <= budget AS fits, (greatest(160, budget * 4))::INTEGER AS room FROM q),
    ot AS (SELECT o.*, coalesce(nm.head, title) AS top FROM o LEFT JOIN nm USING (handle)),
    kd AS (SELECT ot.handle, c.pos, c.handle AS child, top, ot.budget, '- ' || c.title || ': ' || coalesce(n.head, c.title) || ' (' || c.full_tokens || ' full tokens) [' || c.handle || ']' AS line FROM ot JOIN dm c ON c.parent_handle = ot.handle AND c.session_id = ot.session_id LEFT JOIN nm n ON n.handle = c.handle WHERE NOT has),
    ks AS (SELECT *, row_number() OVER w = 1 OR {tokens_sql('top')} + sum({tokens_sql('line')}) OVER w <= budget AS shown FROM kd WINDOW w AS (PARTITION BY handle ORDER BY pos, child ROWS UNBOUNDED PRECEDING)),
    kk AS (SELECT handle, string_agg(line, chr(10) ORDER BY pos, child) FILTER (shown) AS lines, count(*) FILTER (NOT shown) AS more FROM ks GROUP BY 1),
    c AS (SELECT ot.*, CASE WHEN fits AND has THEN t WHEN has THEN substr(t, 1, room) ELSE top || coalesce(chr(10) || lines, '') || CASE WHEN more > 0 THEN chr(10) || '... ' || more || ' more children omitted.' ELSE '' END END AS content FROM ot LEFT JOIN kk USING (handle))
    SELECT session_id, handle, CASE WHEN fits AND has THEN 'verbatim' WHEN has THEN 'excerpt' ELSE 'heads' END AS mip_level, content, fits AND has AS is_verbatim,
      (CASE WHEN fits AND has THEN 0 WHEN has THEN greatest(0, full_tokens - {tokens_sql('content')}) ELSE full_tokens END)::BIGINT AS omitted_tokens FROM c""",
)
def hi_16(spark, sf):
    from ..operators import tree as N

    d = docs(spark, sf)
    texts = N.descendant_text(nodes(spark, sf)).withColumnRenamed("descendant_text", "full_text")
    rows = d.join(texts, ["session_id", "handle"], "left").withColumn("full_text", F.when(N.source_message(), F.col("full_text")))
    asked = d.where("depth < 2").select(F.col("handle").alias("request_id"), "session_id", "handle", F.when(F.col("pos") % 3 == 0, 1000).when(F.col("pos") % 3 == 1, 60).otherwise(10).alias("budget"))
    return S.open_nodes(rows, asked).select("session_id", "handle", "mip_level", "content", "is_verbatim", "omitted_tokens")


@query(
    "hi_19_render_refs",
    f"""WITH {NODES}, k AS (SELECT n.session_id, n.handle, n.depth, coalesce(n.raw, h.text) AS text, list(c.raw) FILTER (c.raw IS NOT NULL) AS kids, count(c.handle) AS n_children FROM nt n LEFT JOIN nt c ON c.parent_handle = n.handle LEFT JOIN h ON h.handle = n.handle WHERE n.depth > 0 GROUP BY ALL)
    SELECT session_id, handle, '[' || CASE WHEN depth = 2 THEN 'open' WHEN n_children > 0 THEN 'browse' ELSE 'select' END || '] ' || handle || CASE WHEN list_contains(list_transform(coalesce(kids, []), lambda x: {compact_sql('x')}), {compact_sql('text')}) OR {compact_sql('text')} = '' THEN '' ELSE ' ' || {preview_sql('text', 120)} END AS line_text FROM k""",
)
def hi_19(spark, sf):
    n = nodes(spark, sf)
    kids = n.where("parent_handle is not null").groupBy(F.col("parent_handle").alias("handle")).agg(F.collect_list("raw").alias("child_texts"), F.count("*").alias("n_children"))
    from .trees import event_rows

    own = event_rows(spark, sf).select("handle", F.col("text").alias("own_text"))
    refs = n.where("depth > 0").join(kids, "handle", "left").join(own, "handle", "left").withColumn("text", F.coalesce("raw", "own_text")).withColumn("child_texts", F.coalesce("child_texts", F.array().cast("array<string>"))).withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    return S.render_refs(refs.withColumn("openable", F.col("depth") == 2)).select("session_id", "handle", "line_text")


_HITS = "concat(event_type, '/', event_id)"


@query(
    "win_09_canonical_refs",
    f"""WITH h AS (SELECT event_id, user_id, {_HITS} AS handle, CASE WHEN event_id % 3 > 0 THEN event_id // 10 END AS line, event_type AS role, CASE WHEN event_id % 5 > 0 THEN 'm' || (event_id // 20) ELSE '' END AS message_id,
      event_id % 2 = 0 AS openable, CASE WHEN event_id % 7 = 0 THEN 'message' ELSE 'chunk' END AS kind FROM events),
    i AS (SELECT *, CASE WHEN line IS NOT NULL THEN 'line|' || line || '|' || role WHEN message_id <> '' THEN 'message|' || message_id ELSE 'handle|' || handle END AS identity FROM h),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id, identity ORDER BY openable DESC, kind = 'message' DESC, handle) AS n FROM i) SELECT event_id FROM r WHERE n = 1""",
)
def win_09(spark, sf):
    e = table(spark, sf, "events")
    hits = e.select("event_id", "user_id", F.expr(_HITS).alias("handle"), F.when(F.col("event_id") % 3 > 0, F.floor(F.col("event_id") / 10)).alias("line"), F.col("event_type").alias("role"), F.when(F.col("event_id") % 5 > 0, F.concat(F.lit("m"), F.floor(F.col("event_id") / 20))).otherwise("").alias("message_id"), (F.col("event_id") % 2 == 0).alias("openable"), F.when(F.col("event_id") % 7 == 0, "message").otherwise("chunk").alias("kind"))
    return S.canonical_refs(hits, ["user_id"]).select("event_id")


@query(
    "win_10_canonical_nav",
    f"""WITH r AS (SELECT doc_id, lang || '/' || repeat('x', (doc_id % 4)::INTEGER) || source AS handle, n_chars // 1000 AS line, {compact_sql('text')} AS k FROM documents),
    w AS (SELECT *, row_number() OVER (PARTITION BY line, k ORDER BY length(handle), doc_id) AS n FROM r) SELECT doc_id, handle FROM w WHERE n = 1""",
)
def win_10(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), F.concat("lang", F.lit("/"), F.repeat(F.lit("x"), (F.col("doc_id") % 4).cast("int")), "source").alias("handle"), F.floor(F.col("n_chars") / 1000).alias("line"), F.col("text"))
    return S.canonical_nav(d, []).select(F.col("pos").alias("doc_id"), "handle")


@query("lim_01_page", "WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS place, count(*) OVER () AS total FROM documents) SELECT doc_id, place::INTEGER AS place, total, CASE WHEN total > 45 THEN 45::BIGINT END AS next_start FROM r WHERE place BETWEEN 30 AND 44")
def lim_01(spark, sf):
    return S.page(table(spark, sf, "documents").select("doc_id", "n_chars"), [F.col("n_chars").desc(), F.col("doc_id")], 30, 15).select("doc_id", "place", "total", "next_start")


def manifest(spark, sf):
    """Sessions of the event table: one per user."""
    e = table(spark, sf, "events")
    return e.groupBy(F.col("user_id").cast("string").alias("session_id")).agg(F.max("ts").alias("updated_at"), F.min_by("event_type", "event_id").alias("title"), F.max_by("event_type", "event_id").alias("agent"), F.count("*").alias("event_count")).withColumns({"cwd": F.concat(F.lit("/home/"), "session_id"), "model": F.lit("m"), "source_path": F.concat(F.lit("/logs/"), "session_id", F.lit(".jsonl"))})


MANIFEST = """mf AS (SELECT user_id::VARCHAR AS session_id, max(ts) AS updated_at, arg_min(event_type, event_id) AS title, arg_max(event_type, event_id) AS agent, count(*) AS event_count, '/home/' || user_id AS cwd, 'm' AS model, '/logs/' || user_id || '.jsonl' AS source_path FROM events GROUP BY user_id)"""


@query("lim_02_browse_catalog", f"WITH {MANIFEST}, r AS (SELECT *, row_number() OVER (ORDER BY updated_at DESC, session_id) - 1 AS place FROM mf WHERE agent = 'click' AND contains(source_path, 'logs/1')) SELECT session_id, title, place::INTEGER AS place FROM r WHERE place < 20")
def lim_02(spark, sf):
    return S.browse_catalog(manifest(spark, sf), "click", "LOGS/1").select("session_id", "title", "place")


@query("flt_05_catalog_match", f"WITH {MANIFEST} SELECT session_id FROM mf WHERE contains(lower(title || agent), 'view') OR contains(lower(source_path), 'view')")
def flt_05(spark, sf):
    return S.catalog_match(manifest(spark, sf), "VIEW", ["session_id", "title", "agent", "cwd", "model", "source_path"]).select("session_id")


@query("flt_09_recent_files", f"WITH {MANIFEST} SELECT source_path AS path, event_count AS size FROM mf WHERE updated_at >= (SELECT max(updated_at) FROM mf WHERE session_id IN ('1', '2', '3')) - INTERVAL 2 SECONDS ORDER BY updated_at DESC, size DESC, path LIMIT 25")
def flt_09(spark, sf):
    m = manifest(spark, sf)
    since = m.where("session_id in ('1', '2', '3')").agg(F.max("updated_at").alias("since"))
    files = m.crossJoin(F.broadcast(since)).select(F.col("source_path").alias("path"), F.col("updated_at").alias("mtime"), F.col("event_count").alias("size"), "since")
    return S.recent_files(files, F.col("since"), 25).select("path", "size")


@query(
    "jn_04_hydrate",
    f"""WITH {DOCS}, refs AS (SELECT session_id, CASE WHEN pos % 2 = 0 THEN handle ELSE handle || '/lost' END AS handle, pos AS line FROM dc WHERE depth = 1)
    SELECT r.session_id, r.handle, coalesce(d.title, 'ref') AS title, n.raw AS content FROM refs r LEFT JOIN dc d ON d.session_id = r.session_id AND d.handle = r.handle
    LEFT JOIN nt p ON p.session_id = r.session_id AND p.depth = 1 AND p.pos = r.line LEFT JOIN nt n ON n.parent_handle = p.handle""",
)
def jn_04(spark, sf):
    d, n = docs(spark, sf), nodes(spark, sf)
    line = F.regexp_extract("handle", "/event/([0-9]+)-", 1).cast("long")
    refs = d.where("depth = 1").select("session_id", F.when(F.col("pos") % 2 == 0, F.col("handle")).otherwise(F.concat("handle", F.lit("/lost"))).alias("handle"), "kind", F.col("pos").alias("line"), F.lit("ref").alias("title"))
    return S.hydrate(refs, d, n.withColumn("line", line)).select("session_id", "handle", "title", "content")
