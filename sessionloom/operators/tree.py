"""The hierarchy of a session as an adjacency list: session, events, their parts and chunks of long parts.

nodes(session_id, handle, parent_handle, depth, pos, kind, role, type, title, head, raw, at, own_usage, topics, links)
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import usage as U
from ..sources.sinks import written

#: Characters of a chunk of raw text, of the search text of a message where a caller wants it cut, of an excerpt; topics of a node.
CHUNK, SEARCH_TEXT, EXCERPT, TOPICS = 6000, 4000, 700, 8
NODE_COLUMNS = ("session_id", "handle", "parent_handle", "depth", "pos", "kind", "type", "role", "title", "head", "raw", "at", "own_usage", "topics", "links")


def event_title(df: DataFrame) -> Column:
    """The title of an event row (type, role, call_name, tool_name, title)."""
    unknown = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))
    made = (
        F.when(F.col("type") == "tool_call", F.concat(F.lit("tool call "), unknown(F.col("call_name"))))
        .when(F.col("type") == "tool_result", F.concat(F.lit("tool result "), unknown(F.coalesce(F.nullif("tool_name", F.lit("")), F.col("tool_call_id")))))
        .when(F.col("type") == "message", F.concat(F.coalesce("role", F.lit("message")), F.lit(" message")))
        .when(F.col("type") == "usage", "token usage")
        .otherwise(F.col("type"))
    )
    return F.coalesce(F.nullif("title", F.lit("")), made) if "title" in df.columns else made


def event_head() -> Column:
    """One line for an event row (type, role, call_name, tool_name, tool_call_id, text)."""
    unknown = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))
    brief = T.preview(F.col("text"), 180)
    return (
        F.when(F.col("type") == "tool_call", F.concat(F.lit("tool call "), unknown(F.col("call_name")), F.lit(" "), brief))
        .when(F.col("type") == "tool_result", F.concat(F.lit("tool result "), unknown(F.coalesce(F.nullif("tool_name", F.lit("")), F.col("tool_call_id"))), F.lit(" "), brief))
        .when(F.col("type") == "reasoning", F.concat(F.lit("reasoning "), brief))
        .otherwise(F.concat(F.coalesce(F.nullif("role", F.lit("")), F.col("type")), F.lit(": "), brief))
    )


def chunks(text: Column, size: int = CHUNK) -> Column:
    """array of (n, start, end, text) that cut a text; empty for one that needs no cutting."""
    many = F.ceil(F.length(text) / size).cast("int")
    cut = F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.struct(i.alias("n"), (i * size).alias("start"), F.least((i + 1) * size, F.length(text)).alias("end"), F.substr(text, i * size + 1, F.lit(size)).alias("text")))
    return F.when(F.length(text) > size, cut).otherwise(F.expr("cast(array() as array<struct<n:int,start:int,end:int,text:string>>)"))


def chunk_text(df: DataFrame, text_col: str, size: int = CHUNK) -> DataFrame:
    """A row for each piece of each text: chunk_no, chunk_start, chunk_end, chunk; a text that fits is one piece."""
    text = T.text_of(F.col(text_col))
    whole = F.array(F.struct(F.lit(0).alias("n"), F.lit(0).alias("start"), F.length(text).alias("end"), text.alias("text")))
    pieces = F.when(F.length(text) > size, chunks(text, size)).otherwise(whole)
    return df.withColumn("piece", F.explode(pieces)).withColumns({"chunk_no": F.col("piece.n"), "chunk_start": F.col("piece.start"), "chunk_end": F.col("piece.end"), "chunk": F.col("piece.text")}).drop("piece", text_col)


def joined_chunks(nodes: DataFrame) -> DataFrame:
    """A row (session_id, handle, kind, line, raw) for each part of nodes with a line that is cut, with the text of all its chunks."""
    part, n = F.regexp_replace("handle", "/chunk/[0-9]+$", ""), F.regexp_extract("handle", "/chunk/([0-9]+)$", 1).cast("int")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(n.alias("n"), "raw"))), lambda x: x.raw), "")
    rows = nodes.where(F.col("handle").rlike("/chunk/[0-9]+$"))
    return rows.groupBy("session_id", part.alias("handle")).agg(F.regexp_replace(F.min("kind"), "_chunk$", "").alias("kind"), F.min("line").alias("line"), whole.alias("raw"))


def build_nodes(events: DataFrame) -> DataFrame:
    """All nodes of all sessions from event rows (session_id, ordinal, type, role, text, event_id, at, usage, topics,
    call_name, tool_name, tool_call_id, paired_handle, handle).

    An event has one child with its content, call, result or reasoning; a long one has chunks below; the root of a
    session comes above its events.
    """
    part = F.when(F.col("type") == "tool_call", "call").when(F.col("type") == "tool_result", "result").when(F.col("type") == "reasoning", "reasoning").when(F.length(T.text_of(F.col("text"))) > 0, "content").otherwise("raw")
    kinds = F.when(F.col("part") == "call", "tool_call").when(F.col("part") == "result", "tool_result").when(F.col("part") == "reasoning", "reasoning").when(F.col("part") == "content", "event_content").otherwise("event_raw")
    none = F.lit(None).cast("string")
    own = T.unique(F.array(T.session_link(F.col("handle"), session_id=F.col("session_id")), F.when(F.col("paired_handle").isNotNull(), T.session_link(F.col("paired_handle"), session_id=F.col("session_id")))))
    rows = events.withColumn("part", part).withColumn("made_title", event_title(events)).withColumn("made_head", event_head()).withColumn("links", own)
    rows = rows.withColumn("part_handle", F.concat("handle", F.lit("/"), "part")).withColumn("cuts", chunks(T.text_of(F.col("text"))))

    def node(handle: Column, parent: Column, depth: int, pos: Column, kind: Column, title: Column, raw: Column, usage: Column, topics: Column) -> Column:
        return F.struct(handle.alias("handle"), parent.alias("parent_handle"), F.lit(depth).alias("depth"), pos.cast("long").alias("pos"), kind.alias("kind"), title.alias("title"), F.col("made_head").alias("head"), raw.alias("raw"), usage.alias("own_usage"), topics.alias("topics"))

    no_usage, no_topics = F.lit(None).cast(U.TYPE), F.array().cast("array<string>")
    root = F.concat(F.lit("session/"), T.encode_uri(F.col("session_id")))
    whole = F.size("cuts") == 0
    event = node(F.col("handle"), root, 1, F.col("ordinal"), F.col("type"), F.col("made_title"), none, F.col("usage"), no_topics)
    child = node(F.col("part_handle"), F.col("handle"), 2, F.lit(0), kinds, F.concat_ws(" ", "made_title", "part"), F.when(whole, T.text_of(F.col("text"))), no_usage, F.when(whole, F.col("topics")).otherwise(no_topics))
    cut = F.transform("cuts", lambda c: node(F.concat("part_handle", F.lit("/chunk/"), c.n.cast("string")), F.col("part_handle"), 3, c.n, F.concat(kinds, F.lit("_chunk")), F.concat_ws(" ", "made_title", "part", F.lit("chunk"), c.n.cast("string")), c.text, no_usage, F.when(c.n == 0, F.col("topics")).otherwise(no_topics)))
    below = rows.select("session_id", "type", "role", "at", "links", F.explode(F.concat(F.array(event, child), cut)).alias("node")).select("session_id", "node.*", "type", "role", "at", "links")
    roots = events.groupBy("session_id").agg(F.min("at").alias("at")).select(
        "session_id", root.alias("handle"), none.alias("parent_handle"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("pos"), F.lit("session").alias("kind"), F.concat(F.lit("session "), "session_id").alias("title"),
        none.alias("head"), none.alias("raw"), no_usage.alias("own_usage"), no_topics.alias("topics"), none.alias("type"), none.alias("role"), F.lit(None).cast(dict(events.dtypes)["at"]).alias("at"), F.array().cast("array<string>").alias("links"),
    )
    return below.select(*NODE_COLUMNS).unionByName(roots.select(*NODE_COLUMNS))


def hidden() -> Column:
    """Reasoning never surfaces."""
    return F.col("kind").startswith("reasoning")


def visible(nodes: DataFrame) -> DataFrame:
    return nodes.where(~hidden())


def forest_paths(edges: DataFrame) -> DataFrame:
    """For each node (node_no, parent_no, step) of a forest of any depth: path, the steps from its root down to it, and up, the
    node_nos on that way. By pointer doubling: each round joins a path to that of the node above its first step, so rounds
    grow with the logarithm of the depth. A parent that isn't there counts as none; a cycle is an error."""
    known = edges.select(F.col("node_no").alias("of_no"))
    now = edges.join(known, F.col("parent_no") == F.col("of_no"), "left").select("node_no", F.col("of_no").alias("above"), F.array("step").alias("path"), F.array("node_no").alias("up"))
    now, rows = written(now), None
    for rounds in count(1):
        if now.where("above is not null").isEmpty():
            return now.drop("above")
        rows = now.count() if rows is None else rows
        if 1 << rounds > 4 * rows:
            raise ValueError("nodes form a cycle")
        top = now.select(F.col("node_no").alias("of_no"), F.col("above").alias("next"), F.col("path").alias("head_path"), F.col("up").alias("head_up"))
        met = now.join(top, F.col("above") == F.col("of_no"), "left")
        longer = lambda a, b: F.when(F.col("of_no").isNull(), F.col(b)).otherwise(F.concat(a, b))
        now = written(met.select("node_no", F.col("next").alias("above"), longer("head_path", "path").alias("path"), longer("head_up", "up").alias("up")))


def _numbered(rows: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """Adds a long that rises with an order of all rows, with gaps; written."""
    return written(rows.orderBy(*order).withColumn(name, F.monotonically_increasing_id()))


def rollup_tree(nodes: DataFrame) -> DataFrame:
    """Adds to each node, over the visible nodes below it: n_children, full_tokens (of leaves), next_tokens (what the children's heads
    take), rendered_tokens, usage, start_at, end_at, all_links. The session's own usage stands for its children's; a node's own
    time stands for that of what is below; a node whose children are all hidden takes nothing. Nodes whose parent is missing are
    roots; repeated handles of a session are an error of the caller's.

    Trees may have any depth. Nodes are numbered before what is below them, and once more in the mirrored order. Each node then counts to
    all nodes on its way from the root: sums are added up, and the first and last times are those of the least numbers in the two orders.
    """
    keys = ["session_id"]
    rendered = T.estimate_tokens(F.coalesce(F.nullif("head", F.lit("")), F.nullif("raw", F.lit("")), F.col("title")))
    base = written(nodes.withColumn("rendered_tokens", rendered).withColumn("node_no", F.monotonically_increasing_id()))
    # what hidden nodes hold is not part of what is above them
    parent = base.select(F.col("session_id").alias("of_session"), F.col("handle").alias("of_handle"), F.col("node_no").alias("parent_no"))
    edges = written(base.join(parent, (F.col("session_id") == F.col("of_session")) & (F.col("parent_handle") == F.col("of_handle")), "left").select("node_no", F.when(~hidden(), F.col("parent_no")).alias("parent_no"), F.col("parent_no").alias("any_parent"), F.struct(F.coalesce("pos", F.lit(0)).cast("long").alias("pos"), F.xxhash64("handle").alias("tie"), F.col("node_no").alias("no")).alias("step")))
    paths = forest_paths(edges.select("node_no", "parent_no", "step"))
    below = edges.where("parent_no is not null").join(base.select(F.col("node_no").alias("child_no"), "rendered_tokens"), F.col("node_no") == F.col("child_no")).groupBy(F.col("parent_no").alias("up_no")).agg(F.count("*").alias("c_n"), F.sum("rendered_tokens").alias("c_next"))
    inner = edges.where("any_parent is not null").select(F.col("any_parent").alias("inner_no")).distinct()

    own_usage, no = F.coalesce("own_usage", U.usage()), F.lit(0).cast("long")
    small = base.join(paths.withColumnRenamed("node_no", "path_no"), F.col("node_no") == F.col("path_no")).join(inner, F.col("node_no") == F.col("inner_no"), "left").join(below, F.col("node_no") == F.col("up_no"), "left")
    leaf = F.when(F.col("inner_no").isNull(), T.estimate_tokens(F.col("raw"))).otherwise(no)
    small = small.where("session_id is not null").select(*keys, "node_no", "path", "up", "at", "links", F.coalesce("c_n", no).alias("n_children"), leaf.alias("leaf"), F.coalesce("c_next", leaf).alias("next_tokens"), *[own_usage[f].alias(f"u_{f}") for f in U.FIELDS])

    rows = _numbered(small, [*keys, "path"], "pre")
    last = F.struct(F.lit((1 << 63) - 1).alias("pos"), F.lit(0).cast("long").alias("tie"), F.lit(0).cast("long").alias("no"))
    rows = _numbered(rows, [*keys, F.concat("path", F.array(last)).desc()], "back")  # it orders a node before what is below it, children from the last

    timed = lambda by: F.min_by("at", F.when(F.col("at").isNotNull(), F.col(by)))
    sums = ["leaf", *[f"u_{f}" for f in U.FIELDS]]
    below = rows.select(F.explode("up").alias("rolled_no"), "at", "pre", "back", *sums).groupBy("rolled_no").agg(timed("pre").alias("first_at"), timed("back").alias("last_at"), *[F.sum(c).alias(c) for c in sums])
    links = rows.where(F.size("links") > 0).select("pre", F.posexplode("links").alias("nth", "link"), "up").select("link", F.struct("pre", "nth").alias("first"), F.explode("up").alias("link_no"))
    links = links.groupBy("link_no", "link").agg(F.min("first").alias("first")).groupBy("link_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "link"))), lambda x: x.link).alias("all_links"))
    own = rows.select("node_no", "n_children", "next_tokens")
    rolled = own.join(below, F.col("node_no") == F.col("rolled_no")).drop("node_no").join(links, F.col("rolled_no") == F.col("link_no"), "left").select(
        "rolled_no", "n_children", F.col("leaf").alias("full_tokens"), "next_tokens", F.col("first_at").alias("start_at"), F.col("last_at").alias("end_at"),
        F.coalesce("all_links", F.array().cast("array<string>")).alias("all_links"), F.struct(*[F.col(f"u_{f}").alias(f) for f in U.FIELDS]).alias("below_usage"),
    )
    kept_own = (F.col("depth") == 0) & F.greatest(*[own_usage[f] > 0 for f in U.FIELDS])
    return written(base.join(rolled, F.col("node_no") == F.col("rolled_no")).withColumn("usage", F.when(kept_own, own_usage).otherwise(F.col("below_usage"))).drop("node_no", "rolled_no", "below_usage"))


def rollup_topics(nodes: DataFrame) -> DataFrame:
    """Per parent (session_id, parent_handle): the topics of its visible children, those in other case counted together,
    each with a weight of 1 for every thousand tokens of the child; heaviest first, then by name; the first eight."""
    weight = F.greatest(F.lit(1), F.ceil(F.col("full_tokens") / 1000))
    named = nodes.where(~hidden()).select("session_id", "parent_handle", "pos", weight.alias("weight"), F.explode("topics").alias("topic")).withColumn("topic", T.compact_text(F.col("topic"))).where("topic <> ''")
    sums = named.groupBy("session_id", "parent_handle", F.lower("topic").alias("key")).agg(F.min_by("topic", F.struct("pos", "topic")).alias("topic"), F.sum("weight").alias("weight"))
    ranked = sums.withColumn("nth", F.row_number().over(Window.partitionBy("session_id", "parent_handle").orderBy(F.col("weight").desc(), "topic"))).where(F.col("nth") <= TOPICS)
    return ranked.groupBy("session_id", "parent_handle").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "topic"))), lambda x: x.topic).alias("topics"))


def with_depth(edges: DataFrame, node: str, parent: str) -> DataFrame:
    """Adds depth (0 at nodes without a parent) and max_depth of the whole forest to any adjacency list; one join per level.
    Nodes without a path from a root are left out, those of a cycle among them; a cycle below a root is an error."""
    roots = edges.where(F.col(parent).isNull()).withColumn("depth", F.lit(0))
    levels, current, rows = roots, roots, edges.count()
    for depth in count(1):
        if depth > rows:
            raise ValueError("nodes below a root form a cycle")
        above = current.select(F.col(node).alias("above"))
        current = written(edges.join(above, F.col(parent) == F.col("above")).drop("above").withColumn("depth", F.lit(depth)))
        if current.isEmpty():
            break
        levels = levels.unionByName(current)
    return levels.crossJoin(F.broadcast(levels.agg(F.max("depth").alias("max_depth"))))


def with_navigation(nodes: DataFrame) -> DataFrame:
    """Adds sibling_no, siblings ("2/5") and zoom ("depth+1/max+1") among visible nodes."""
    by = Window.partitionBy("session_id", "parent_handle")
    rows = visible(nodes).withColumn("sibling_no", F.row_number().over(by.orderBy("pos", "handle"))).withColumn("n", F.count("*").over(by))
    deepest = F.max("depth").over(Window.partitionBy("session_id"))
    return rows.withColumn("siblings", F.concat_ws("/", F.col("sibling_no").cast("string"), F.col("n").cast("string"))).withColumn("zoom", F.concat_ws("/", (F.col("depth") + 1).cast("string"), (deepest + 1).cast("string"))).drop("n")


def source_message() -> Column:
    return (F.col("type") == "message") & F.col("role").isin("user", "assistant") & (F.col("kind") == "message")


def message_content() -> Column:
    return (F.col("type") == "message") & F.col("role").isin("user", "assistant") & F.col("kind").isin("event_content", "event_content_chunk")


def descendant_text(nodes: DataFrame) -> DataFrame:
    """Per event handle: the visible leaves' texts below it, in order, joined by newlines; the chunks of a text by nothing."""
    leaves = visible(nodes).where("raw is not null")
    event = F.regexp_extract("handle", "^(session/[^/]+/event/[^/]+)", 1)
    leaf = F.struct("depth", "pos", "raw", (F.col("kind").endswith("_chunk") & (F.col("pos") > 0)).alias("goes_on"))
    parted = lambda x, i: F.concat(F.when((i == 0) | F.coalesce(x.goes_on, F.lit(False)), "").otherwise("\n"), x.raw)
    return leaves.groupBy("session_id", event.alias("handle")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(leaf)), parted), "").alias("descendant_text"))


def build_docs(rolled: DataFrame, predicate: Column | None = None, most: int | None = None) -> DataFrame:
    """One row per visible node: navigation, time, tokens, usage, search_text, excerpt, retrieval_visible.

    A source message is searched by the text below it; its own content nodes are not, and neither are nodes without text.
    The root is always visible to retrieval. A predicate may narrow it. The search text is whole, or of at most so many characters.
    """
    texts = descendant_text(rolled).withColumnRenamed("handle", "of_handle").withColumnRenamed("session_id", "of_session")
    met = with_navigation(rolled).join(texts, (F.col("session_id") == F.col("of_session")) & (F.col("handle") == F.col("of_handle")), "left").drop("of_handle", "of_session")
    text = F.when(source_message(), T.text_of(F.col("descendant_text"))).otherwise("")
    search = text if most is None else F.when(F.length(text) > most, F.substring(text, 1, most)).otherwise(text)
    shown = (F.col("depth") == 0) | ((search != "") & ~message_content())
    if predicate is not None:
        shown = shown & predicate
    return met.select(
        "session_id", "handle", "parent_handle", "depth", "pos", "kind", "type", "role", "title", "head", "sibling_no", "siblings", "zoom", "full_tokens", "next_tokens", "rendered_tokens", "start_at", "end_at", "usage", "all_links",
        search.alias("search_text"), T.preview(text, EXCERPT).alias("excerpt"), F.coalesce(shown, F.lit(False)).alias("retrieval_visible"), T.text_of(F.col("raw")).alias("raw"),
    )


def compacted_scope(nodes: DataFrame, spans: DataFrame) -> DataFrame:
    """The root, and the subtrees of the events that lie in closed spans (session_id, handle)."""
    event = F.regexp_extract("handle", "^(session/[^/]+/event/[^/]+)", 1)
    kept = spans.select(F.col("session_id").alias("of_session"), F.col("handle").alias("of_handle")).distinct()
    inside = nodes.where("depth > 0").withColumn("event_handle", event).join(kept, (F.col("session_id") == F.col("of_session")) & (F.col("event_handle") == F.col("of_handle")), "left_semi").drop("event_handle")
    return nodes.where("depth = 0").unionByName(inside)


def published_docs(summary_docs: DataFrame, source_docs: DataFrame, visible_handles: DataFrame) -> DataFrame:
    """Summary documents win by (session_id, handle); source documents fill in, seen by retrieval only where a handle is
    among the visible ones."""
    keys = ["session_id", "handle"]
    seen = visible_handles.select(*keys).distinct().withColumn("is_seen", F.lit(True))
    rest = source_docs.join(summary_docs.select(*keys), keys, "left_anti").join(seen, keys, "left")
    narrowed = rest.withColumn("retrieval_visible", F.col("retrieval_visible") & F.coalesce("is_seen", F.lit(False))).drop("is_seen")
    return summary_docs.unionByName(narrowed)


def search_record(docs: DataFrame) -> DataFrame:
    """Documents as search records: flat fields, has_search_text instead of an empty text, times as milliseconds."""
    return docs.select(
        "session_id", "handle", F.coalesce("parent_handle", F.lit("")).alias("parent_handle"), "depth", "kind", F.coalesce("role", F.lit("")).alias("role"), "title", F.nullif("search_text", F.lit("")).alias("search_text"),
        (F.col("search_text") != "").alias("has_search_text"), "retrieval_visible", F.col("usage.total").alias("usage_total"), "full_tokens",
    )


def from_search_record(records: DataFrame) -> DataFrame:
    return records.withColumn("search_text", F.coalesce("search_text", F.lit(""))).withColumn("parent_handle", F.nullif("parent_handle", F.lit(""))).withColumn("role", F.nullif("role", F.lit(""))).drop("has_search_text")
