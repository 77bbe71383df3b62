"""Session logs: JSONL files to lines, and the two dialects' lines to raw event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import content as C
from ..functions import text as T
from ..functions import usage as U

#: Columns of raw events; normalize_events() takes them.
RAW = ("session_id", "source_kind", "path", "line_no", "block_no", "type", "role", "at", "text", "call_id", "tool_name", "turn_id", "usage", "model", "sidechain", "title", "declared_id", "cwd")


def split_lines(files: DataFrame) -> DataFrame:
    """(path, line_no, raw, v, parse_error) of whole files (path, value): line numbers from 1 count blank lines, which give
    no row; a carriage return at the end goes; what is no JSON keeps its row with parse_error."""
    rows = files.select("path", F.posexplode(F.split("value", "\r?\n")).alias("pos", "raw")).where(F.trim("raw") != "")
    return parsed(rows.select("path", (F.col("pos") + 1).cast("long").alias("line_no"), "raw"))


def parsed(lines: DataFrame) -> DataFrame:
    v = F.try_parse_json("raw")
    return lines.withColumn("v", v).withColumn("parse_error", F.when(F.col("v").isNull(), "malformed JSON"))


def read_session_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all .jsonl files below a path. Each file is one value, so its numbering is exact; see
    read_large_lines() for files that are too large for that."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True, pathGlobFilter="*.jsonl")
    return split_lines(files.select(F.col("_metadata.file_path").alias("path"), "value"))


def read_large_lines(spark: SparkSession, path: str) -> DataFrame:
    """As read_session_lines() for files that Spark may split: lines are numbered within each split, and splits shifted by the
    lines of those before. Within a split the reader's order is kept by an id that rises with it."""
    from pyspark.sql import Window

    rows = spark.read.option("recursiveFileLookup", "true").text(path, pathGlobFilter="*.jsonl").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("seq"))
    inner = Window.partitionBy("path", "block").orderBy("seq")
    numbered = rows.withColumn("n", F.row_number().over(inner))
    sizes = numbered.groupBy("path", "block").agg(F.max("n").alias("size"))
    shift = sizes.withColumn("shift", F.coalesce(F.sum("size").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    met = numbered.join(shift, ["path", "block"]).select("path", (F.col("n") + F.col("shift")).cast("long").alias("line_no"), F.regexp_replace("value", "\r$", "").alias("raw"))
    return parsed(met.where(F.trim("raw") != ""))


def list_session_files(spark: SparkSession, path: str, latest: int | None = None, pattern: str = "*.jsonl") -> DataFrame:
    """(path, mtime, size), newest first, then largest, then by path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
    ordered = files.orderBy(F.col("mtime").desc(), F.col("size").desc(), "path")
    return ordered if latest is None else ordered.limit(latest)


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def rows_to_events_a(lines: DataFrame, include_response_messages: bool = True) -> DataFrame:
    """Raw events of the first dialect ({timestamp, type, payload} envelopes); other rows are dropped, malformed ones
    become agent_event."""
    v = F.col("v")
    outer, inner = _get(v, "type"), _get(v, "payload.type")
    event, item = outer == "event_msg", outer == "response_item"
    kind = (
        F.when(F.col("parse_error").isNotNull(), "agent_event")
        .when(outer == "session_meta", "metadata")
        .when(outer == "turn_context", "context")
        .when(outer == "compacted", "compaction")
        .when(event & inner.isin("user_message", "agent_message"), "message")
        .when(event & (inner == "token_count"), "usage")
        .when(event & inner.isin("patch_apply_end", "web_search_end"), "tool_result")
        .when(item & (inner == "message") & F.lit(include_response_messages), "message")
        .when(item & (inner == "reasoning"), "reasoning")
        .when(item & inner.isin("function_call", "custom_tool_call", "web_search_call"), "tool_call")
        .when(item & inner.isin("function_call_output", "custom_tool_call_output"), "tool_result")
    )
    role = F.when(event & (inner == "user_message"), "user").when(event & (inner == "agent_message"), "assistant").when(item & (inner == "message"), _get(v, "payload.role")).when(F.col("kind").isin("tool_result"), "tool").when(F.col("kind").isin("reasoning", "tool_call"), "assistant").when(F.col("kind") == "metadata", "system").otherwise("observer")
    call = F.coalesce(_get(v, "payload.call_id"), F.when(inner.isin("web_search_call", "web_search_end"), F.concat(F.lit("web_search_"), F.col("line_no"))))
    text = (
        F.when(F.col("kind") == "agent_event", F.col("raw"))
        .when((F.col("kind") == "message") & event, C.content_text(F.try_variant_get(v, "$.payload.message", "variant")))
        .when(F.col("kind") == "message", C.content_text(F.try_variant_get(v, "$.payload.content", "variant")))
        .when(F.col("kind") == "compaction", _get(v, "payload.message"))
        .when(F.col("kind") == "tool_call", F.coalesce(_get(v, "payload.arguments"), _get(v, "payload.input"), F.to_json(F.try_variant_get(v, "$.payload.action", "variant"))))
        .when(F.col("kind") == "tool_result", F.coalesce(_get(v, "payload.output"), _get(v, "payload.stdout"), _get(v, "payload.query")))
        .when(F.col("kind") == "reasoning", C.content_text(F.try_variant_get(v, "$.payload.summary", "variant")))
    )
    rows = lines.withColumn("kind", kind).where("kind is not null")
    total = F.try_variant_get(v, "$.payload.info.total_token_usage", "variant")
    last = F.try_variant_get(v, "$.payload.info.last_token_usage", "variant")
    none = F.lit(None).cast("string")
    out = rows.select(
        T.session_id_from_path(F.col("path")).alias("session_id"), F.lit("log_a").alias("source_kind"), "path", "line_no", F.lit(0).cast("long").alias("block_no"), F.col("kind").alias("type"), role.alias("role"), F.try_to_timestamp(_get(v, "timestamp")).alias("at"),
        T.redact_inline(text).alias("text"), F.when(F.col("kind").isin("tool_call", "tool_result"), call).alias("call_id"), F.when(F.col("kind") == "tool_call", F.coalesce(_get(v, "payload.name"), F.when(inner == "web_search_call", "web_search"))).alias("tool_name"),
        F.when(F.col("kind") == "context", _get(v, "payload.turn_id")).alias("turn_id"), F.when(F.col("kind") == "usage", F.when(total.isNotNull(), U.normalize_usage(total))).alias("total_usage"), F.when(F.col("kind") == "usage", U.normalize_usage(last)).alias("last_usage"),
        F.when(F.col("kind") == "context", _get(v, "payload.model")).alias("model"), F.lit(False).alias("sidechain"), none.alias("title"), F.when(F.col("kind") == "metadata", _get(v, "payload.id")).alias("declared_id"), F.coalesce(_get(v, "payload.cwd"), none).alias("cwd"),
    )
    from ..operators.events import usage_delta

    return usage_delta(out, ["path", "type"], ["line_no"]).withColumn("usage", F.when(F.col("type") == "usage", F.col("usage"))).select(*RAW)


def rows_to_events_b(lines: DataFrame) -> DataFrame:
    """Raw events of the second dialect: one row gives an event for each text, thinking, tool_use or tool_result block, and a usage
    event for an assistant's row; boundaries become compactions; turn_duration and stop_hook_summary are dropped."""
    v = F.col("v")
    outer, sub = _get(v, "type"), _get(v, "subtype")
    content = F.try_variant_get(v, "$.message.content", "variant")
    base = lines.where(outer.isin("user", "assistant", "system", "attachment") & ~F.coalesce(sub.isin("turn_duration", "stop_hook_summary"), F.lit(False)))
    blocks = base.where(outer.isin("user", "assistant")).select("*", F.posexplode(C.blocks(content)).alias("block_no", "block"))
    b = F.col("block")
    kind_b = _get(b, "type")
    type_ = F.when(kind_b == "thinking", "reasoning").when(kind_b == "tool_use", "tool_call").when(kind_b == "tool_result", "tool_result").otherwise("message")
    none = F.lit(None).cast("string")

    def row(df: DataFrame, block: Column, type_: Column, role: Column, text: Column, call: Column, tool: Column, usage: Column) -> DataFrame:
        return df.select(
            F.coalesce(_get(v, "sessionId"), T.session_id_from_path(F.col("path"))).alias("session_id"), F.lit("log_b").alias("source_kind"), "path", "line_no", block.cast("long").alias("block_no"), type_.alias("type"), role.alias("role"), F.try_to_timestamp(_get(v, "timestamp")).alias("at"),
            T.redact_inline(text).alias("text"), call.alias("call_id"), tool.alias("tool_name"), none.alias("turn_id"), usage.alias("usage"), _get(v, "message.model").alias("model"), F.coalesce(_get(v, "isSidechain", "boolean"), F.lit(False)).alias("sidechain"),
            F.when(F.coalesce(_get(v, "isCompactSummary", "boolean"), F.lit(False)), "compact summary").alias("title"), _get(v, "sessionId").alias("declared_id"), _get(v, "cwd").alias("cwd"),
        ).select(*RAW)

    no_usage = F.lit(None).cast(U.TYPE)
    text = F.when(type_ == "message", F.coalesce(_get(b, "text"), F.to_json(b))).when(type_ == "tool_call", F.to_json(F.try_variant_get(b, "$.input", "variant"))).when(type_ == "tool_result", C.content_text(F.try_variant_get(b, "$.content", "variant")))
    role = F.when(type_ == "tool_result", "tool").otherwise(outer)
    events = row(blocks, F.col("block_no"), type_, role, text, F.coalesce(_get(b, "id"), _get(b, "tool_use_id")), _get(b, "name"), no_usage)
    used = F.try_variant_get(v, "$.message.usage", "variant")
    usage = row(base.where((outer == "assistant") & used.isNotNull()), F.lit(1 << 20), F.lit("usage"), F.lit("assistant"), none, none, none, U.normalize_usage(used))
    boundary = sub == "compact_boundary"
    rest = row(base.where(outer.isin("system", "attachment")), F.lit(0), F.when(boundary, "compaction").otherwise("agent_event"), F.lit("system"), F.coalesce(_get(v, "content"), F.to_json(F.try_variant_get(v, "$.attachment", "variant"))), none, none, no_usage)
    return events.unionByName(usage).unionByName(rest)


def build_sessions_b(lines: DataFrame) -> DataFrame:
    """Headers of the second dialect, per path: first session id and cwd, first real model, title: the last custom one, else the
    last generated one, else the first user text (80 characters)."""
    v = F.col("v")
    outer, n = _get(v, "type"), F.col("line_no")
    given = lambda c: F.when(T.text_of(c) != "", n)
    model = _get(v, "message.model")
    custom, made, sid, cwd = F.when(outer == "custom-title", _get(v, "customTitle")), F.when(outer == "ai-title", _get(v, "aiTitle")), _get(v, "sessionId"), _get(v, "cwd")
    first = F.when(outer == "user", C.content_text(F.try_variant_get(v, "$.message.content", "variant")))
    h = lines.groupBy("path").agg(
        F.min_by(sid, given(sid)).alias("session_id"), F.min_by(cwd, given(cwd)).alias("cwd"), F.min_by(model, F.when((T.text_of(model) != "") & (model != "<synthetic>"), n)).alias("model"),
        F.max_by(custom, given(custom)).alias("custom"), F.max_by(made, given(made)).alias("made"), F.min_by(first, given(first)).alias("first"),
    )
    return h.select("path", "session_id", "cwd", "model", F.coalesce("custom", "made", F.nullif(T.preview(F.col("first"), 80), F.lit(""))).alias("title"))


def load_events(spark: SparkSession, source: str, path_or_df, **map_) -> DataFrame:
    """Normalised events of a named source: log_a or log_b (a path, or lines), or table (a DataFrame and its columns' names)."""
    from ..operators import events as E

    if source == "table":
        return E.normalize_events(E.from_table(path_or_df, **map_))
    loader = {"log_a": rows_to_events_a, "log_b": rows_to_events_b}[source]
    lines = path_or_df if isinstance(path_or_df, DataFrame) else read_large_lines(spark, path_or_df)
    return E.normalize_events(loader(lines))


def read_doc_sections(files: DataFrame) -> DataFrame:
    """(doc_path, section_id, title, scopes) of Markdown files (path, value) with front matter; the title falls back to the
    file's name with blanks for dashes."""
    head = F.regexp_extract("value", r"(?s)^---\r?\n(.*?)\r?\n---", 1)
    field = lambda name: F.nullif(F.trim(F.regexp_extract(head, rf"(?m)^{name}:\s*(.*)$", 1), F.lit("\"' ")), F.lit(""))
    listed = F.regexp_extract_all(F.regexp_extract(head, r"(?m)^(?:scope|scopes|scopePaths):[^\n]*((?:\n\s+- [^\n]+)+)", 1), F.lit(r"- *[\"']?([^\n\"']+)"), F.lit(1))
    name = F.regexp_extract("path", r"([^/]+?)(?:\.md)?$", 1)
    return files.select(F.col("path").alias("doc_path"), F.coalesce(field("id"), name).alias("section_id"), F.coalesce(field("title"), F.translate(name, "-_", "  ")).alias("title"), F.transform(listed, lambda s: F.trim(s)).alias("scopes"))


def parse_changes(df: DataFrame, column: str = "value") -> DataFrame:
    """(status, old_path, path) of NUL-separated name-status text; renames and copies have two paths."""
    records = F.regexp_extract_all(column, F.lit("([RC][0-9]*\u0000[^\u0000]+\u0000[^\u0000]+|[A-Z][0-9]*\u0000[^\u0000]+)(?:\u0000|$)"), F.lit(1))
    rows = df.select(F.posexplode(records).alias("seq", "record")).withColumn("parts", F.split("record", "\u0000"))
    two = F.size("parts") == 3
    return rows.select("seq", F.substring(F.col("parts")[0], 1, 1).alias("status"), F.when(two, F.col("parts")[1]).alias("old_path"), F.when(two, F.get("parts", F.lit(2))).otherwise(F.col("parts")[1]).alias("path"))
