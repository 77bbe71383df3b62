"""Queries over the event table's windows, links and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import usage as U
from ..operators import events as E
from ..operators import spans as S
from .catalog import query, table
from .scalars import compact_sql, tokens_sql

#: Events of the conversations table in DuckDB; every third turn is a compaction boundary.
EVENTS = """ev AS (SELECT *, 'msg_' || substr(sha256(event_id), 1, 20) AS message_id, (turn % 3 = 2) AS boundary FROM (
  SELECT conv_id::VARCHAR AS session_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS ordinal,
    role, text, 'table:' || conv_id || ':' || turn || ':message:' || role AS event_id FROM conversations))"""


def boundary():
    return F.col("line_no") % 3 == 2



def events(spark, sf):
    return E.accepted(E.normalize_events(E.from_table(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")))


@query("src_05_table_events", f"WITH {EVENTS} SELECT session_id, turn AS line_no, ordinal, 'message' AS type, role, text FROM ev")
def src_05(spark, sf):
    return events(spark, sf).select("session_id", "line_no", "ordinal", "type", "role", "text")


@query(
    "prj_07_normalize_events",
    f"""WITH t AS (SELECT conv_id::VARCHAR AS session_id, turn, CASE WHEN turn = 4 THEN 'gossip' ELSE 'message' END AS type, CASE WHEN turn = 3 THEN 'observer' ELSE role END AS role FROM conversations),
    n AS (SELECT *, type = 'gossip' AS rejected, 'table:' || session_id || ':' || turn || ':' || type || ':' || role AS event_id FROM t)
    SELECT session_id, turn AS line_no, rejected, CASE WHEN NOT rejected THEN (row_number() OVER (PARTITION BY session_id, rejected ORDER BY turn) - 1)::BIGINT END AS ordinal,
      event_id, CASE WHEN type = 'message' THEN 'msg_' || substr(sha256(event_id), 1, 20) END AS message_id FROM n""",
)
def prj_07(spark, sf):
    raw = E.from_table(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")
    odd = raw.withColumn("type", F.when(F.col("line_no") == 4, "gossip").otherwise(F.col("type"))).withColumn("role", F.when(F.col("line_no") == 3, "Critic").otherwise(F.col("role")))
    return E.normalize_events(odd).select("session_id", "line_no", "rejected", "ordinal", "event_id", "message_id")


_FIELDS = {"input": "floor(value * 100)", "output": "floor(value * 7)", "cache_read": "event_id % 50", "cache_write": "event_id % 11", "reasoning": "floor(value)", "total": "floor(value * 107)"}


def usage_sql(value: str = "") -> str:
    return ", ".join(f"({x})::BIGINT AS {f}" for f, x in _FIELDS.items())


@query(
    "win_01_usage_delta",
    f"""WITH r AS (SELECT event_id, user_id, ts, event_type <> 'error' AS has, {usage_sql()} FROM events),
    c AS (SELECT event_id, user_id, ts, has, input, output, cache_read, cache_write, reasoning, CASE WHEN total > 0 THEN total ELSE input + output END AS total FROM r),
    l AS (SELECT *, {", ".join(f"coalesce(last_value(CASE WHEN has THEN {f} END IGNORE NULLS) OVER w, 0) AS p_{f}" for f in U.FIELDS)} FROM c
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    z AS (SELECT *, {" OR ".join(f"{f} < p_{f}" for f in U.FIELDS)} AS reset FROM l)
    SELECT event_id, {", ".join(f"(CASE WHEN NOT has THEN {'event_id % 5' if f in ('input', 'total') else '0'} WHEN reset THEN {f} ELSE {f} - p_{f} END)::BIGINT AS {f}" for f in U.FIELDS)} FROM z""",
)
def win_01(spark, sf):
    has = F.col("event_type") != "error"
    e = table(spark, sf, "events")
    total = U.usage(**{f: F.expr(x) for f, x in _FIELDS.items()})
    rows = e.withColumn("total_usage", F.when(has, total)).withColumn("last_usage", U.usage(input=F.col("event_id") % 5))
    return E.usage_delta(rows, ["user_id"], ["ts", "event_id"]).select("event_id", "usage.*")


_SPANS = f"""{EVENTS}, sp AS (SELECT *, coalesce(sum(boundary::INT) OVER (PARTITION BY session_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed,
    coalesce(bool_or(boundary) OVER (PARTITION BY session_id ORDER BY ordinal ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS ends FROM ev),
  spans AS (SELECT *, (dense_rank() OVER (PARTITION BY session_id ORDER BY closed) - 1)::BIGINT AS span FROM sp WHERE ends AND NOT boundary AND role <> 'system')"""


def spans(spark, sf):
    return S.compaction_spans(events(spark, sf), boundary(), F.col("role") != "system")


@query("win_02_compaction_spans", f"WITH {_SPANS} SELECT session_id, ordinal, span FROM spans")
def win_02(spark, sf):
    return spans(spark, sf).select("session_id", "ordinal", F.col("span").cast("long").alias("span"))


@query("win_03_live_tail", f"WITH {EVENTS}, b AS (SELECT *, coalesce(max(CASE WHEN boundary THEN ordinal END) OVER (PARTITION BY session_id), -1) AS last FROM ev) SELECT session_id, ordinal, text FROM b WHERE ordinal > last AND role IN ('user', 'assistant')")
def win_03(spark, sf):
    return S.live_tail(events(spark, sf), boundary(), F.col("role").isin("user", "assistant")).select("session_id", "ordinal", "text")


@query(
    "win_04_dedupe_messages",
    f"""WITH d AS (SELECT source AS session_id, doc_id, lang AS role, {compact_sql('text')} AS k, n_chars % 2 AS pref FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY session_id, role, k ORDER BY pref DESC, doc_id) AS n FROM d) SELECT session_id, doc_id FROM r WHERE k = '' OR n = 1""",
)
def win_04(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("session_id"), F.col("doc_id").alias("ordinal"), F.col("lang").alias("role"), "text", F.lit("message").alias("type"), "n_chars")
    return E.dedupe_messages(d, F.col("n_chars") % 2).select("session_id", F.col("ordinal").alias("doc_id"))


@query("win_04b_first_seen", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY source, lang, text")
def win_04b(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("session_id"), F.col("doc_id").alias("ordinal"), F.col("lang").alias("role"), "text", F.lit("message").alias("type"))
    return E.first_seen(d).select(F.col("ordinal").alias("doc_id"))


@query(
    "win_06_after_last_boundary",
    "WITH b AS (SELECT *, max(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id) AS last FROM events) SELECT user_id, event_id FROM b WHERE event_id > last",
)
def win_06(spark, sf):
    return S.after_last_boundary(table(spark, sf, "events"), F.col("event_type") == "error", "user_id", "event_id").select("user_id", "event_id")


@query(
    "win_07_pair_adjacent",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 0 END AS k FROM events),
    f AS (SELECT user_id, event_id, n, k, NULL::BIGINT AS mate, CASE WHEN k > 0 THEN event_id END AS pending FROM e WHERE n = 1
      UNION ALL
      SELECT e.user_id, e.event_id, e.n, e.k, CASE WHEN f.pending IS NOT NULL AND e.k > 0 AND e.k <> f.k THEN f.pending END,
        CASE WHEN e.k = 0 THEN NULL WHEN f.pending IS NOT NULL AND e.k <> f.k THEN NULL ELSE e.event_id END
      FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1),
    p AS (SELECT event_id, mate FROM f WHERE mate IS NOT NULL UNION ALL SELECT mate, event_id FROM f WHERE mate IS NOT NULL)
    SELECT f.event_id, p.mate AS pair_ordinal, CASE WHEN p.mate IS NULL THEN CASE f.k WHEN 1 THEN 'unpaired_call' ELSE 'unpaired_result' END END AS unpaired_reason
    FROM f LEFT JOIN p USING (event_id) WHERE f.k > 0""",
)
def win_07(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("ordinal"), "event_type")
    call, result = F.col("event_type") == "click", F.col("event_type") == "view"
    return E.pair_adjacent(e, call, result).where(call | result).select(F.col("ordinal").alias("event_id"), "pair_ordinal", "unpaired_reason")


@query(
    "lim_03_budget_prefix",
    f"""WITH {EVENTS}, c AS (SELECT *, {tokens_sql('text')} AS cost FROM ev), s AS (SELECT *, sum(cost) OVER (PARTITION BY session_id ORDER BY ordinal) AS spent FROM c),
    k AS (SELECT *, ordinal = 0 OR spent <= 150 AS kept FROM s), o AS (SELECT *, count(*) FILTER (NOT kept) OVER (PARTITION BY session_id) AS omitted FROM k)
    SELECT session_id, ordinal, spent::BIGINT AS spent, omitted::BIGINT AS omitted FROM o WHERE kept""",
)
def lim_03(spark, sf):
    kept = S.budget_prefix(events(spark, sf), ["session_id"], ["ordinal"], T.estimate_tokens(F.col("text")), F.lit(150))
    return kept.select("session_id", "ordinal", "spent", "omitted")


@query("lim_04_select_within_budget")
def lim_04(spark, sf):
    jobs = table(spark, sf, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("seq"), (F.round("o_totalprice") / 1000).alias("usd"))
    return S.select_within_budget(jobs, ["session_id"], 300.0, 20)


@query(
    "lim_05_pack_greedy",
    f"""WITH RECURSIVE {EVENTS}, c AS (SELECT session_id, ordinal, {tokens_sql('text')} AS cost FROM ev),
    f AS (SELECT session_id, ordinal, cost, cost AS total, 0::BIGINT AS g FROM c WHERE ordinal = 0
      UNION ALL SELECT c.session_id, c.ordinal, c.cost, CASE WHEN f.total + c.cost <= 120 THEN f.total + c.cost ELSE c.cost END, CASE WHEN f.total + c.cost <= 120 THEN f.g ELSE f.g + 1 END
      FROM f JOIN c ON c.session_id = f.session_id AND c.ordinal = f.ordinal + 1)
    SELECT session_id, ordinal, g AS "group" FROM f""",
)
def lim_05(spark, sf):
    return S.pack_greedy(events(spark, sf), ["session_id"], "ordinal", T.estimate_tokens(F.col("text")), 120).select("session_id", "ordinal", "group")


@query("lim_05b_pack_pairs")
def lim_05b(spark, sf):
    e = called(spark, sf).withColumn("cost", T.estimate_tokens(F.col("text")))
    return S.pack_pairs(e.select("session_id", "ordinal", "type", "tool_call_id", "cost"), ["session_id"], 120)


def called(spark, sf):
    """Conversation events with every second user message as a call and the assistant's next message as its result."""
    e = events(spark, sf)
    pair = F.when(F.col("role") == "user", F.col("line_no")).when(F.col("role") == "assistant", F.col("line_no") - 1)
    odd = pair % 4 == 2
    kind = F.when(odd & (F.col("role") == "user"), "tool_call").when(odd & (F.col("role") == "assistant"), "tool_result").otherwise("message")
    rows = e.withColumn("type", kind).withColumn("tool_call_id", F.when(odd, F.concat_ws("-", F.lit("call"), pair.cast("string"))))
    return rows.withColumn("handle", T.handle(F.col("session_id"), F.col("ordinal"), F.col("type"), F.col("event_id"))).withColumn("message_id", F.when(F.col("type") == "message", F.col("message_id")))


CALLED = f"""{EVENTS}, cp AS (SELECT * EXCLUDE (message_id), CASE role WHEN 'user' THEN turn WHEN 'assistant' THEN turn - 1 END AS pair, message_id AS mid FROM ev),
  ct AS (SELECT *, coalesce(pair % 4 = 2, false) AS odd FROM cp),
  ca AS (SELECT *, CASE WHEN odd AND role = 'user' THEN 'tool_call' WHEN odd AND role = 'assistant' THEN 'tool_result' ELSE 'message' END AS type, CASE WHEN odd THEN 'call-' || pair END AS tool_call_id FROM ct),
  ch AS (SELECT *, 'session/' || session_id || '/event/' || lpad(ordinal::VARCHAR, 6, '0') || '-' || type || '-' || substr(regexp_replace(event_id, '[^A-Za-z0-9_-]+', '-', 'g'), 1, 18) AS handle, CASE WHEN type = 'message' THEN mid END AS message_id FROM ca)"""


@query(
    "jn_01_pair_tool_calls",
    f"""WITH {CALLED}, e AS (SELECT session_id, tool_call_id, arg_max(handle, ordinal) FILTER (type = 'tool_call') AS c, arg_max(handle, ordinal) FILTER (type = 'tool_result') AS r FROM ch WHERE tool_call_id IS NOT NULL GROUP BY 1, 2)
    SELECT ch.session_id, ordinal, handle, CASE type WHEN 'tool_call' THEN r WHEN 'tool_result' THEN c END AS paired_handle FROM ch LEFT JOIN e USING (session_id, tool_call_id)""",
)
def jn_01(spark, sf):
    return E.pair_tool_calls(called(spark, sf)).select("session_id", "ordinal", "handle", "paired_handle")


def linked(spark, sf):
    """Called events, with a turn context in place of each system message and of the sixth turn."""
    e = called(spark, sf)
    context = (F.col("role") == "system") | (F.col("line_no") == 5)
    rows = e.withColumn("turn_id", F.when(context, F.concat(F.lit("turn-"), F.col("line_no").cast("string")))).withColumn("type", F.when(context, "context").otherwise(F.col("type")))
    return E.annotate_links(rows.withColumn("message_id", F.when(F.col("type") == "message", F.col("message_id"))))


_LINKED = f"""{CALLED}, k0 AS (SELECT * EXCLUDE (type, message_id), role = 'system' OR turn = 5 AS ctx, CASE WHEN role = 'system' OR turn = 5 THEN 'context' ELSE type END AS type FROM ch),
  k1 AS (SELECT *, CASE WHEN type = 'message' THEN mid END AS message_id, sum(ctx::INT) OVER (PARTITION BY session_id ORDER BY ordinal) AS turn_no, type = 'message' AND role = 'user' AS usr FROM k0),
  k2 AS (SELECT *, sum(usr::INT) OVER (PARTITION BY session_id, turn_no ORDER BY ordinal) AS user_no FROM k1),
  k3 AS (SELECT *, usr AND (turn_no = 0 OR user_no = 1) AS is_anchor FROM k2),
  k4 AS (SELECT *, last_value(CASE WHEN is_anchor THEN message_id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ordinal) AS anchor FROM k3),
  k AS (SELECT *, CASE WHEN type <> 'context' AND role <> 'user' THEN anchor END AS in_reply_to, is_anchor AND turn_no > 0 AS turn_root, CASE WHEN usr AND NOT is_anchor THEN anchor END AS turn_root_message_id FROM k4)"""


@query("jn_02_reply_anchor", f"WITH {_LINKED} SELECT session_id, ordinal, in_reply_to, turn_root, turn_root_message_id FROM k")
def jn_02(spark, sf):
    return linked(spark, sf).select("session_id", "ordinal", "in_reply_to", "turn_root", "turn_root_message_id")


@query(
    "jn_03_resolve_replies",
    f"WITH {_LINKED} SELECT k.session_id, k.ordinal, u.ordinal AS reply_ordinal, u.handle AS reply_handle FROM k LEFT JOIN k u ON u.session_id = k.session_id AND u.message_id = k.in_reply_to AND u.type = 'message' AND u.role = 'user'",
)
def jn_03(spark, sf):
    return E.resolve_replies(linked(spark, sf)).select("session_id", "ordinal", "reply_ordinal", "reply_handle")


@query("agg_01_usage_sum", f"WITH r AS (SELECT user_id, {usage_sql()} FROM events) SELECT user_id, {', '.join(f'sum({f})::BIGINT AS {f}' for f in U.FIELDS if f != 'total')}, sum(CASE WHEN total > 0 THEN total ELSE input + output END)::BIGINT AS total FROM r GROUP BY 1")
def agg_01(spark, sf):
    e = table(spark, sf, "events").withColumn("usage", U.usage(**{f: F.expr(x) for f, x in _FIELDS.items()}))
    return e.groupBy("user_id").agg(*U.sums("usage"))
