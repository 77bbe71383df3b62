"""The event table: one row per event of every session, in order, with links between events.

Order is the log's own (line, block), never time. All windows are by session, so one exchange on session_id serves
them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import content as C
from ..functions import text as T
from ..functions import usage as U


def by_session() -> WindowSpec:
    return Window.partitionBy("session_id")


def in_order() -> WindowSpec:
    return by_session().orderBy("ordinal")


def from_table(df: DataFrame, session: str, order: str, role: str, text: str) -> DataFrame:
    """Any table with a session key, an order, a role and a text as raw message events."""
    return df.select(
        F.col(session).cast("string").alias("session_id"),
        F.lit("table").alias("source_kind"),
        F.col(order).cast("long").alias("line_no"),
        F.lit(0).cast("long").alias("block_no"),
        F.lit("message").alias("type"),
        F.col(role).alias("role"),
        F.col(text).alias("text"),
    )


def normalize_events(df: DataFrame) -> DataFrame:
    """Adds ordinal (from 0, dense within a session), norm role, event_id, message_id; rows of unknown type are marked
    in `rejected` and have no ordinal."""
    known = F.col("type").isin(*T.EVENT_TYPES)
    numbered = df.withColumn("rejected", ~F.coalesce(known, F.lit(False))).withColumn(
        "ordinal", F.when(~F.col("rejected"), F.row_number().over(Window.partitionBy("session_id", "rejected").orderBy("line_no", "block_no")) - 1).cast("long")
    )
    place = F.concat_ws(".", F.col("line_no").cast("string"), F.when(F.col("block_no") > 0, F.col("block_no").cast("string")))
    named = numbered.withColumn("role", T.norm_role(F.col("role"))).withColumn("event_id", T.event_id(F.col("source_kind"), F.col("session_id"), place, F.col("type"), F.col("role")))
    return named.withColumn("message_id", F.when(F.col("type") == "message", T.message_id(F.col("event_id"))))


def quarantine(normalized: DataFrame) -> DataFrame:
    return normalized.where("rejected")


def accepted(normalized: DataFrame) -> DataFrame:
    return normalized.where("not rejected").drop("rejected")


def event_documents(events: DataFrame) -> DataFrame:
    """What search finds of loaded events (accepted, with the columns that loaders and normalize_events give): a document for each event with
    its handle and, as search_text, its title, role, text, a call's name and arguments, a result's output and usage as JSON, each on a line of
    its own. Reasoning and events with no more than a role aren't visible to retrieval. Other columns are kept."""
    call, none = F.col("type") == "tool_call", F.array().cast("array<struct<text:string,json:string>>")
    spent = F.to_json(F.when(F.col("usage").isNotNull(), F.struct(*[F.col(f"usage.{f}").alias(f) for f in sorted(U.FIELDS)])))
    whole = C.event_text(F.when(~call, F.col("text")), none, F.when(call, F.col("tool_name")), F.when(call, F.col("text")), spent, before=(F.col("title"), F.col("role")))
    shown = (F.col("type") != "reasoning") & (F.coalesce(whole, F.lit("")) != T.text_of(F.col("role")))
    named = events.withColumns({"search_text": whole, "retrieval_visible": F.coalesce(shown, F.lit(False)), "handle": T.handle(F.col("session_id"), F.col("ordinal"), F.col("type"), F.col("event_id")), "depth": F.lit(1), "start_at": F.col("at"), "tool_call_id": F.col("call_id")})
    return named.withColumn("search_text", F.when(F.col("retrieval_visible"), F.col("search_text")).otherwise(""))


def usage_delta(df: DataFrame, key: list[str], order: list[str], total: str = "total_usage", last: str = "last_usage") -> DataFrame:
    """Adds usage: the step of a running total within a key, the last usage where a row has no total."""
    before = F.last(total, ignorenulls=True).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("usage", U.delta(F.col(total), before, F.coalesce(F.col(last), U.usage())))


def dedupe_messages(df: DataFrame, preference: Column) -> DataFrame:
    """Of messages of a session with the same role and the same text but for white space, the most preferred stays, the
    first of equal ones; events of other types and empty texts pass."""
    key = F.when(F.col("type") == "message", F.nullif(T.compact_text(F.col("text")), F.lit("")))
    best = Window.partitionBy("session_id", "role", "dedupe_key").orderBy(F.col("preference").desc(), "ordinal")
    marked = df.withColumn("dedupe_key", F.sha2(key, 256)).withColumn("preference", preference)
    ranked = marked.withColumn("place", F.when(F.col("dedupe_key").isNull(), 1).otherwise(F.row_number().over(best)))
    return ranked.where("place = 1").drop("dedupe_key", "preference", "place")


def first_seen(df: DataFrame) -> DataFrame:
    """The first of messages of a session with exactly the same role and text."""
    first = Window.partitionBy("session_id", "role", "seen_key").orderBy("ordinal")
    return df.withColumn("seen_key", F.sha2(T.text_of(F.col("text")), 256)).withColumn("place", F.row_number().over(first)).where("type <> 'message' or place = 1").drop("seen_key", "place")


def annotate_links(df: DataFrame) -> DataFrame:
    """Adds in_reply_to, turn_root and turn_root_message_id.

    An anchor is a user message before the session's first turn context, or the first one after each context. Every other
    event but a user message replies to the latest anchor before it; a user message that is no anchor gets it as its turn root.
    An in_reply_to that is there already stays.
    """
    context = (F.col("type") == "context") & F.col("turn_id").isNotNull() & (F.col("turn_id") != "")
    user = (F.col("type") == "message") & (F.col("role") == "user")
    turn = F.sum(F.when(context, 1).otherwise(0)).over(in_order())
    nth = F.sum(F.when(user, 1).otherwise(0)).over(Window.partitionBy("session_id", "turn_no").orderBy("ordinal"))
    rows = df.withColumn("turn_no", turn).withColumn("user_no", nth)
    anchor = user & ((F.col("turn_no") == 0) | (F.col("user_no") == 1))
    rows = rows.withColumn("is_anchor", anchor).withColumn("anchor", F.last(F.when(anchor, F.col("message_id")), ignorenulls=True).over(in_order()))
    replies = F.col("type").isin("message", "reasoning", "tool_call", "tool_result", "usage", "agent_event") & (F.coalesce(F.col("role"), F.lit("")) != "user")
    given = F.col("in_reply_to") if "in_reply_to" in df.columns else F.lit(None).cast("string")
    return rows.withColumns({
        "in_reply_to": F.coalesce(F.nullif(given, F.lit("")), F.when(replies, F.col("anchor"))),
        "turn_root": F.col("is_anchor") & (F.col("turn_no") > 0),
        "turn_root_message_id": F.when(user & ~F.col("is_anchor"), F.col("anchor")),
    }).drop("turn_no", "user_no", "is_anchor", "anchor")


def pair_tool_calls(df: DataFrame) -> DataFrame:
    """Adds paired_handle: a call's result and a result's call in the same session, the last ones of repeated ids."""
    ends = df.where(F.col("type").isin("tool_call", "tool_result") & F.col("tool_call_id").isNotNull()).groupBy("session_id", "tool_call_id").agg(
        F.max_by(F.when(F.col("type") == "tool_call", F.col("handle")), F.when(F.col("type") == "tool_call", F.col("ordinal"))).alias("call_handle"),
        F.max_by(F.when(F.col("type") == "tool_result", F.col("handle")), F.when(F.col("type") == "tool_result", F.col("ordinal"))).alias("result_handle"),
    )
    paired = F.when(F.col("type") == "tool_call", F.col("result_handle")).when(F.col("type") == "tool_result", F.col("call_handle"))
    return df.join(ends, ["session_id", "tool_call_id"], "left").withColumn("paired_handle", paired).drop("call_handle", "result_handle")


def resolve_replies(df: DataFrame) -> DataFrame:
    """Adds the ordinal and handle of the user message that an event replies to."""
    asked = df.where("type = 'message' and role = 'user'").select("session_id", F.col("message_id").alias("in_reply_to"), F.col("ordinal").alias("reply_ordinal"), F.col("handle").alias("reply_handle"))
    return df.join(asked, ["session_id", "in_reply_to"], "left")


def pair_adjacent(df: DataFrame, call: Column, result: Column) -> DataFrame:
    """Pairs a search call with the result next to it, in either order: adds pair_ordinal, or unpaired_reason.

    A pending end waits for the very next event; of a run of calls only the last one is still pending when a result
    comes. Ends are taken from left to right, each once: within an island of neighbouring unlike ends, first with second, third
    with fourth.
    """
    kind = F.when(call, "call").when(result, "result")
    rows = df.withColumn("end_kind", kind)
    previous = F.lag("end_kind").over(in_order())
    opens = F.col("end_kind").isNotNull() & (previous.isNull() | (previous == F.col("end_kind")))
    rows = rows.withColumn("island", F.sum(F.when(opens | F.col("end_kind").isNull(), 1).otherwise(0)).over(in_order()))
    inner = Window.partitionBy("session_id", "island").orderBy("ordinal")
    rows = rows.withColumn("place", F.row_number().over(inner)).withColumn("island_size", F.count("end_kind").over(Window.partitionBy("session_id", "island")))
    mate = F.when(F.col("place") % 2 == 1, F.lead("ordinal").over(inner)).otherwise(F.lag("ordinal").over(inner))
    rows = rows.withColumn("pair_ordinal", F.when(F.col("end_kind").isNotNull(), mate))
    alone = F.col("end_kind").isNotNull() & F.col("pair_ordinal").isNull()
    return rows.withColumn("unpaired_reason", F.when(alone, F.concat(F.lit("unpaired_"), "end_kind"))).drop("end_kind", "island", "place", "island_size")
