"""Search, browse and open over published documents. Requests are tables, so one job answers many.

Ranking (ours; the rule is part of the interface): number of different query tokens matched, then their total count, then
earlier start, then handle. All query tokens are optional; no stemming, no typo tolerance.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.sinks import written
from .tree import joined_chunks

#: Parts that the rows of a request are ranked in before its page is taken from their first rows.
SALTS = 64
#: Documents of a block of the search index: 2 to this power.
BLOCK_BITS = 12
#: Fields that a filter may name.
FILTER_FIELDS = ("index_id", "session_id", "agent", "parent_handle", "message_id", "in_reply_to", "tool_call_id", "role")


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.regexp_replace(T.text_of(c), r"[^\p{L}\p{N}]+", " ")), " "), lambda t: t != "")


def build_search_index(docs: DataFrame) -> DataFrame:
    """(token, session_id, handle, tf) of visible documents that have text."""
    rows = docs.where(F.col("retrieval_visible") & (F.col("search_text") != ""))
    return rows.select("session_id", "handle", F.explode(tokens(F.col("search_text"))).alias("token")).groupBy("token", "session_id", "handle").agg(F.count("*").alias("tf"))


def apply_search_filter(docs: DataFrame, mip: int | None = None, **fields) -> DataFrame:
    """Visible documents whose fields equal the given values: a list means any of its values, fields must all hold. mip 0
    means verbatim documents, another mip the depth."""
    unknown = set(fields) - set(FILTER_FIELDS)
    if unknown:
        raise ValueError(f"no filter on {sorted(unknown)}")
    kept = docs.where("retrieval_visible")
    for name, value in fields.items():
        values = [v for v in (value if isinstance(value, (list, tuple, set)) else [value]) if v not in (None, "")]
        if values:
            kept = kept.where(F.col(name).isin(*values))
    if mip is not None:
        kept = kept.where(F.col("search_text") != "") if mip == 0 else kept.where(F.col("depth") == mip)
    return kept


def page(ranked: DataFrame, by: list[Column], start: int, limit: int, within: list[str] | None = None) -> DataFrame:
    """Rows start .. start + limit in order, with place (from 0), total, and next_start (null on the last page); of each
    key if `within` names one."""
    if within is None:
        total = ranked.count()
        rows = ranked.orderBy(*by).offset(start).limit(limit)
        numbered = rows.withColumn("place", F.row_number().over(Window.orderBy(*by)) - 1 + start)  # a page's rows only
        return numbered.withColumn("total", F.lit(total).cast("long")).withColumn("next_start", F.lit(start + limit if start + limit < total else None).cast("long"))
    spread = [c for c in ("session_id", "handle") if c in ranked.columns] or [c for c, kind in ranked.dtypes if kind in ("string", "bigint", "int")]
    salt = F.pmod(F.xxhash64(*spread), F.lit(SALTS))  # of documents not of their texts, which need not be read then
    first = Window.partitionBy(*within, "salt").orderBy(*by)  # no task ranks all rows of a large key
    few = ranked.withColumn("salt", salt).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= start + limit).drop("nth", "salt")
    rows = few.withColumn("place", F.row_number().over(Window.partitionBy(*within).orderBy(*by)) - 1).where(F.col("place").between(start, start + limit - 1))
    totals = ranked.groupBy(*[F.col(k).alias(f"of_{k}") for k in within]).agg(F.count("*").alias("total"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in within])
    kept = rows.join(totals, same).drop(*[f"of_{k}" for k in within])
    return kept.withColumn("next_start", F.when(F.col("total") > start + limit, F.lit(start + limit).cast("long")))


def search(docs: DataFrame, requests: DataFrame, start: int = 0, limit: int = 10, index: DataFrame | None = None) -> DataFrame:
    """Hits per request (request_id, query): place, matched, tf, total, next_start and the documents' columns. A query
    without tokens, or `*`, hits every visible document with text, with a score of 1."""
    index = index if index is not None else build_search_index(docs)
    asked = requests.withColumn("words", F.array_distinct(tokens(F.col("query"))))
    words = asked.where(F.size("words") > 0).select("request_id", F.explode("words").alias("token"))
    hits = index.join(words, "token").groupBy("request_id", "session_id", "handle").agg(F.count("*").alias("matched"), F.sum("tf").alias("tf"))
    shown = docs.where(F.col("retrieval_visible") & (F.col("search_text") != ""))
    found = shown.join(hits, ["session_id", "handle"])
    by = [F.col("matched").desc(), F.col("tf").desc(), F.col("start_at"), F.col("session_id"), F.col("handle")]
    pages = page(found, by, start, limit, ["request_id"])
    everything = asked.where(F.size("words") == 0).select("request_id")
    if everything.isEmpty():
        return pages
    one = F.lit(1).cast("long")
    shared = page(shown.withColumns({"matched": one, "tf": one}), by, start, limit)  # the same for all these requests
    return pages.unionByName(everything.crossJoin(F.broadcast(shared)).select(*pages.columns))


def canonical_refs(hits: DataFrame, keys: list[str]) -> DataFrame:
    """One hit for each identity: index, session, line and role, else the message id, else the handle. Openable ones
    first, then messages, then by handle."""
    identity = F.when(F.col("line").isNotNull(), F.concat_ws("|", F.lit("line"), F.col("line").cast("string"), "role")).when(T.text_of(F.col("message_id")) != "", F.concat_ws("|", F.lit("message"), "message_id")).otherwise(F.concat_ws("|", F.lit("handle"), "handle"))
    best = Window.partitionBy(*keys, "identity").orderBy(F.col("openable").desc(), (F.col("kind") == "message").desc(), "handle")
    return hits.withColumn("identity", identity).withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth", "identity")


def canonical_nav(refs: DataFrame, keys: list[str]) -> DataFrame:
    """Of refs with the same line and the same compacted text, the one with the shortest handle, the first of equal ones."""
    best = Window.partitionBy(*keys, "line", "nav_key").orderBy(F.length("handle"), "pos")
    return refs.withColumn("nav_key", T.compact_text(F.col("text"))).withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth", "nav_key")


def render_refs(refs: DataFrame) -> DataFrame:
    """The compact view: own text left out where a child repeats it, and what to do with the ref: open, browse or select."""
    repeated = F.exists("child_texts", lambda t: T.compact_text(t) == T.compact_text(F.col("text")))
    action = F.when(F.col("openable"), "open").when(F.col("n_children") > 0, "browse").otherwise("select")
    shown = F.when(repeated, "").otherwise(T.preview(F.col("text"), 120))
    return refs.withColumn("action", action).withColumn("line_text", F.concat_ws(" ", F.concat(F.lit("["), "action", F.lit("]")), "handle", F.nullif(shown, F.lit(""))))


def children_of(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """Children of requested handles (request_id, session_id, handle)."""
    asked = requests.select("request_id", "session_id", F.col("handle").alias("parent_handle"))
    return docs.join(asked, ["session_id", "parent_handle"])


def parent_of(docs: DataFrame, requests: DataFrame) -> DataFrame:
    own = requests.join(docs.select("session_id", "handle", "parent_handle"), ["session_id", "handle"]).select("request_id", "session_id", F.col("parent_handle").alias("handle"))
    return docs.join(own, ["session_id", "handle"])


def browse(docs: DataFrame, requests: DataFrame, start: int = 0, limit: int = 20, index: DataFrame | None = None) -> DataFrame:
    """Pages per request (request_id, session_id, handle, zoom, topic): zoom `in` or `children` lists children, `out` the parent,
    `siblings` the parent's children. Source messages have no children. Where a root without text has a single child and that is a
    generated summary, the child stands in for it, and its children are listed. With a topic, children are ranked by its tokens,
    and those without any are left out."""
    message = docs.where("kind = 'message' and type = 'message' and role in ('user', 'assistant')").select("session_id", "handle")
    inward = requests.where("zoom in ('in', 'children')").join(message, ["session_id", "handle"], "left_anti")
    only = docs.where("parent_handle is not null").groupBy("session_id", F.col("parent_handle").alias("handle")).agg(F.count("*").alias("n"), F.first("handle").alias("stand_in"), F.first("kind").alias("child_kind"))
    empty = docs.where("depth = 0 and coalesce(search_text, '') = ''").select("session_id", "handle")
    only = only.where("n = 1 and child_kind like 'summary%'").join(empty, ["session_id", "handle"]).select("session_id", "handle", "stand_in")
    inward = inward.join(only, ["session_id", "handle"], "left").withColumn("handle", F.coalesce("stand_in", "handle"))
    siblings = requests.where("zoom = 'siblings'").join(docs.select("session_id", "handle", "parent_handle"), ["session_id", "handle"]).select("request_id", "session_id", F.col("parent_handle").alias("handle"))
    listed = children_of(docs, inward.select("request_id", "session_id", "handle").unionByName(siblings)).unionByName(parent_of(docs, requests.where("zoom = 'out'")), allowMissingColumns=True)
    words = written(requests.select("request_id", F.explode(F.array_distinct(tokens(F.col("topic")))).alias("token")))
    if words.isEmpty():  # without a topic no text is read
        rows = listed.withColumn("matched", F.lit(0).cast("long"))
    else:
        topical = words.select("request_id").distinct().withColumn("topical", F.lit(True))
        asked = listed.select("request_id", "session_id", "handle").distinct().join(words, "request_id")  # a page's own children meet its words, not all documents
        if index is None:
            index = build_search_index(docs.join(asked.select("session_id", "handle"), ["session_id", "handle"], "left_semi"))
        scores = index.join(asked, ["token", "session_id", "handle"]).groupBy("request_id", "session_id", "handle").agg(F.count("*").alias("matched"))
        rows = listed.join(scores, ["request_id", "session_id", "handle"], "left").join(topical, "request_id", "left").where("topical is null or matched is not null").drop("topical")
    return page(rows.fillna({"matched": 0}), [F.col("matched").desc(), F.col("pos"), F.col("handle")], start, limit, ["request_id"])


def open_nodes(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """Renders requested nodes (request_id, session_id, handle, budget): verbatim if the budget takes it, else an excerpt of
    max(160, 4 * budget) characters for text, else the node's head and those of its children, in order while their lines fit the budget (one at
    least), with the number of those left out. Adds children, the handles shown. Hidden and unknown handles give status not_found."""
    own = docs.where(~F.col("kind").startswith("reasoning"))
    met = requests.join(own, ["session_id", "handle"], "left")
    text = F.coalesce(F.nullif("full_text", F.lit("")), F.lit(""))
    fits, has = F.col("full_tokens") <= F.col("budget"), text != ""
    room = F.greatest(F.lit(160), F.col("budget") * 4).cast("int")
    top = F.coalesce("head", "title")

    listed = met.where(F.col("kind").isNotNull() & ~has).select("request_id", "session_id", F.col("handle").alias("parent_handle"), "budget", T.estimate_tokens(top).alias("top_cost"))
    line = F.concat(F.lit("- "), F.col("title"), F.lit(": "), top, F.lit(" ("), F.col("full_tokens").cast("string"), F.lit(" full tokens) ["), F.col("handle"), F.lit("]"))
    kids = own.select("session_id", "parent_handle", "pos", F.col("handle").alias("child"), line.alias("line")).join(listed, ["session_id", "parent_handle"])
    by = Window.partitionBy("request_id").orderBy("pos", "child")
    spent = F.col("top_cost") + F.sum(T.estimate_tokens(F.col("line"))).over(by.rowsBetween(Window.unboundedPreceding, 0))
    shown = kids.withColumn("shown", (F.row_number().over(by) == 1) | (spent <= F.col("budget")))
    row = F.when(F.col("shown"), F.struct("pos", "child", "line"))
    heads = shown.groupBy(F.col("request_id").alias("of_request")).agg(F.array_sort(F.collect_list(row)).alias("rows"), F.count_if(~F.col("shown")).alias("more"))
    met = met.join(heads, F.col("request_id").eqNullSafe(F.col("of_request")), "left")
    lines = F.concat_ws("\n", top, F.transform("rows", lambda r: r.line), F.when(F.col("more") > 0, F.concat(F.lit("... "), F.col("more").cast("string"), F.lit(" more children omitted."))))

    level = F.when(F.col("kind").isNull(), None).when(fits & has, "verbatim").when(has, "excerpt").otherwise("heads")
    content = F.when(fits & has, text).when(has, F.substr(text, F.lit(1), room)).otherwise(lines)
    return met.select(
        "request_id", "session_id", "handle", F.when(F.col("kind").isNull(), "not_found").otherwise("ok").alias("status"), level.alias("mip_level"), F.when(F.col("kind").isNotNull(), content).alias("content"),
        (F.coalesce(fits & has, F.lit(False))).alias("is_verbatim"), F.when(F.col("kind").isNull() | (fits & has), 0).when(has, F.greatest(F.lit(0), F.col("full_tokens") - T.estimate_tokens(content))).otherwise(F.col("full_tokens")).cast("long").alias("omitted_tokens"),
        F.coalesce(F.transform("rows", lambda r: r.child), F.array().cast("array<string>")).alias("children"),
    )


@dataclass
class BlockIndex:
    """Postings by token and block of documents, the greatest tf of each token in each block, and what ranking and filters
    need of a document; all written."""

    postings: DataFrame  # token, block, doc_no, tf
    maxima: DataFrame  # token, block, most
    narrow: DataFrame  # doc_no, session_id, handle, start_at, depth, topics and fields that a filter may name


def build_block_index(docs: DataFrame, block_bits: int = BLOCK_BITS) -> BlockIndex:
    """The index of visible documents with text, in blocks of up to 2 ** block_bits documents."""
    rows = docs.where(F.col("retrieval_visible") & (F.col("search_text") != ""))
    fields = [c for c in dict.fromkeys(("session_id", "handle", "start_at", "depth", "topics", *FILTER_FIELDS)) if c in docs.columns]
    numbered = written(rows.select(F.monotonically_increasing_id().alias("doc_no"), *fields, "search_text"))
    block = F.shiftright("doc_no", block_bits).alias("block")
    postings = written(numbered.select("doc_no", block, F.explode(tokens(F.col("search_text"))).alias("token")).groupBy("token", "block", "doc_no").agg(F.count("*").alias("tf")))
    maxima = written(postings.groupBy("token", "block").agg(F.max("tf").alias("most")))
    return BlockIndex(postings, maxima, numbered.drop("search_text"))


def request_table(requests: DataFrame, start: int = 0, limit: int = 10) -> DataFrame:
    """Requests (request_id, query) with all columns a request may have: topic, which joins the query's words; start and limit; mip (0 for
    verbatim documents, another for the depth); and the FILTER_FIELDS, strings or arrays of them: a document must have one of
    a field's values. Null and empty values, and mip 0 alone, ask for nothing. Adds words; filtered tells whether there is any filter."""
    have = dict(requests.dtypes)

    def values(c: str) -> Column:
        if c not in have:
            return F.array().cast("array<string>")
        given = F.col(c) if have[c].startswith("array") else F.array(F.col(c).cast("string"))
        return F.coalesce(F.filter(given, lambda v: v.isNotNull() & (v != "")), F.array().cast("array<string>"))

    own = lambda c, other: F.coalesce(F.col(c).cast("int"), F.lit(other)) if c in have else F.lit(other)
    text = F.concat_ws(" ", *[c for c in ("query", "topic") if c in have])
    asked = requests.select("request_id", F.array_distinct(tokens(text)).alias("words"), own("start", start).alias("start"), own("limit", limit).alias("limit"), own("mip", None).cast("int").alias("mip"), *[values(c).alias(f"by_{c}") for c in FILTER_FIELDS])
    return asked.withColumn("filtered", F.coalesce(F.col("mip") != 0, F.lit(False)) | reduce(or_, [F.size(f"by_{c}") > 0 for c in FILTER_FIELDS]))


def passes(columns: list[str]) -> Column:
    """Whether a document (with those columns) passes the filter of a request beside it. A filter on a field that documents
    lack passes nothing."""
    every = [(F.size(f"by_{c}") == 0) | (F.array_contains(f"by_{c}", F.col(c)) if c in columns else F.lit(False)) for c in FILTER_FIELDS]
    return F.coalesce(reduce(and_, every), F.lit(False)) & (F.col("mip").isNull() | (F.col("mip") == 0) | (F.col("depth") == F.col("mip")))


def _scored(index: BlockIndex, asked: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents that pass their request's filter, from the wanted (request_id, block, token): request_id, doc_no, session_id,
    handle, start_at, matched, tf."""
    hits = index.postings.join(wanted, ["token", "block"]).groupBy("request_id", "doc_no").agg(F.count("*").alias("matched"), F.sum("tf").alias("tf"))
    met = hits.join(index.narrow, "doc_no").join(asked, "request_id").where(passes(index.narrow.columns))
    return met.select("request_id", "doc_no", "session_id", "handle", "start_at", "matched", "tf", "start", "limit")


def _unworded(index: BlockIndex, asked: DataFrame) -> DataFrame:
    """The same for requests with a filter and no words: each meets documents by an equality on the first field it names; a
    request that names only a depth meets those of that depth."""
    columns, found = index.narrow.columns, None
    rest = asked.where((F.size("words") == 0) & F.col("filtered"))
    one = F.lit(1).cast("long")
    for field in [*[c for c in FILTER_FIELDS if c in columns], "mip"]:
        if field == "mip":
            met = index.narrow.join(rest.where("mip <> 0").withColumn("is_key", F.col("mip")), F.col("depth") == F.col("is_key"))
        else:
            own = rest.where(F.size(f"by_{field}") > 0).withColumn("is_key", F.explode(F.array_distinct(f"by_{field}")))
            rest = rest.where(F.size(f"by_{field}") == 0)
            met = index.narrow.join(own, F.col(field) == F.col("is_key"))
        rows = met.where(passes(columns)).select("request_id", "doc_no", "session_id", "handle", "start_at", one.alias("matched"), one.alias("tf"), "start", "limit")
        found = rows if found is None else found.unionByName(rows)
    return found


def top_hits(index: BlockIndex, asked: DataFrame, totals: bool = True, first_blocks: int = 4) -> DataFrame:
    """The page of each request of request_table(): request_id, place, matched, tf, session_id, handle, total and next_start. Requests
    without words and filter get nothing.

    Without totals (total is null), blocks are passed over: a block can hold no hit better than the number of the request's
    tokens in it and the sum of their greatest tf. The most promising blocks come first; of the others only those that can reach
    the last place of the page (and the one after it) are read.
    """
    words = asked.select("request_id", F.explode("words").alias("token"))
    near = index.maxima.join(words, "token")
    if totals:
        found = _scored(index, asked, near.select("request_id", "block", "token"))
    else:
        bounds = written(near.groupBy("request_id", "block").agg(F.struct(F.count("*").alias("matched"), F.sum("most").alias("tf")).alias("bound"), F.collect_list("token").alias("tokens")))
        salt = F.pmod(F.col("block"), F.lit(SALTS))
        best = bounds.withColumn("nth", F.row_number().over(Window.partitionBy("request_id", salt).orderBy(F.col("bound").desc(), "block"))).where(F.col("nth") <= first_blocks)
        best = best.withColumn("nth", F.row_number().over(Window.partitionBy("request_id").orderBy(F.col("bound").desc(), "block"))).where(F.col("nth") <= first_blocks).drop("nth")
        best = written(best)
        early = written(_scored(index, asked, best.select("request_id", "block", F.explode("tokens").alias("token"))))
        last = early.withColumn("nth", F.row_number().over(Window.partitionBy("request_id").orderBy(F.col("matched").desc(), F.col("tf").desc()))).where(F.col("nth") == F.col("start") + F.col("limit") + 1)
        last = last.select(F.col("request_id").alias("of_request"), F.struct("matched", "tf").alias("least"))
        rest = bounds.join(best.select("request_id", "block"), ["request_id", "block"], "left_anti").join(last, F.col("request_id").eqNullSafe(F.col("of_request")), "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least")))
        found = early.unionByName(_scored(index, asked, rest.select("request_id", "block", F.explode("tokens").alias("token"))))
    found = written(found.unionByName(_unworded(index, asked)))
    by = [F.col("matched").desc(), F.col("tf").desc(), F.col("start_at"), F.col("session_id"), F.col("handle")]
    last = F.col("start") + F.col("limit")
    first = Window.partitionBy("request_id", F.pmod("doc_no", F.lit(SALTS))).orderBy(*by)  # no task ranks all hits of a request
    few = found.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= last + 1).drop("nth")
    placed = few.withColumn("place", F.row_number().over(Window.partitionBy("request_id").orderBy(*by)) - 1)
    if totals:
        sizes = found.groupBy(F.col("request_id").alias("of_request")).agg(F.count("*").alias("total"))
        placed = placed.join(sizes, F.col("request_id").eqNullSafe(F.col("of_request"))).drop("of_request")
        more = F.col("total") > last
    else:
        more = F.max("place").over(Window.partitionBy("request_id")) >= last
        placed = placed.withColumn("total", F.lit(None).cast("long"))
    return placed.withColumn("next_start", F.when(more, last.cast("long"))).where(F.col("place").between(F.col("start"), last - 1)).select("request_id", "place", "matched", "tf", "session_id", "handle", "total", "next_start")


def find_refs(docs: DataFrame, nodes: DataFrame, requests: DataFrame, start: int = 0, limit: int = 10, mip: int | None = None, topic: str = "", index: BlockIndex | None = None, totals: bool = True, **fields) -> DataFrame:
    """Search as one call. Each request (see request_table()) has its own words, topic, filters and page; a call's mip, topic
    (a label that documents must have) and fields narrow all of them. A request that asks for nothing gets nothing. Pages are hydrated from the
    source, and of hits that stand for the same line or message one is left. Place, total and next_start are those of the
    page, before repeats go; without totals, blocks that can't reach the page aren't read (see top_hits())."""
    kept = apply_search_filter(docs, mip, **fields)
    if topic:
        kept = kept.where(T.topic_match(F.col("topics"), topic))
    index = index if index is not None else build_block_index(kept)
    pages = top_hits(index, written(request_table(requests, start, limit)), totals).join(kept, ["session_id", "handle"])
    refs = hydrate(pages.withColumn("line", F.col("line") if "line" in pages.columns else F.lit(None).cast("long")), docs, nodes)
    return canonical_refs(refs.withColumn("openable", F.col("content").isNotNull()), ["request_id", "session_id"])


def hydrate(refs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds to search refs (session_id, handle, kind, line) what stored documents hold (they win), then content from the
    source: by handle, else from the same line, of the same kind first, then the smallest handle. A part that is cut has the
    text of all its chunks."""
    keys = ["session_id", "handle"]
    held = nodes.select(*keys, "kind", "line", "raw").where("raw is not null").unionByName(joined_chunks(nodes))
    stored = docs.select(*keys, F.col("title").alias("stored_title"), F.col("excerpt").alias("stored_excerpt"))
    exact = held.select(*keys, F.col("raw").alias("exact_content"))
    by_line = held.select(F.col("session_id").alias("line_session"), F.col("line").alias("at_line"), F.col("kind").alias("at_kind"), F.col("handle").alias("at_handle"), F.col("raw").alias("line_content"))
    met = refs.join(stored, keys, "left").join(exact, keys, "left")
    near = met.where("exact_content is null").join(by_line, (F.col("session_id") == F.col("line_session")) & (F.col("line") == F.col("at_line")))
    best = Window.partitionBy(*keys).orderBy((F.col("kind") == F.col("at_kind")).desc(), "at_handle")
    picked = near.withColumn("nth", F.row_number().over(best)).where("nth = 1").select(*keys, "line_content")
    return met.join(picked, keys, "left").withColumn("title", F.coalesce("stored_title", "title")).withColumn("content", F.coalesce("exact_content", "line_content")).drop("stored_title", "exact_content", "line_content")


def catalog_match(df: DataFrame, needle: str, fields: list[str]) -> DataFrame:
    """Rows whose joined fields contain the needle, in any case."""
    return df.where(F.lower(F.concat_ws("\n", *fields)).contains(needle.lower()))


def browse_catalog(manifest: DataFrame, agent: str | None = None, needle: str = "", start: int = 0, limit: int = 20) -> DataFrame:
    """Sessions, newest update first, ties by id; compact entries; filtered by agent and text."""
    rows = manifest if agent is None else manifest.where(F.col("agent") == agent)
    if needle:
        rows = catalog_match(rows, needle, ["session_id", "title", "agent", "cwd", "model", "source_path"])
    return page(rows, [F.col("updated_at").desc(), F.col("session_id")], start, limit)


def recent_files(files: DataFrame, since: Column, newest: int | None = 100) -> DataFrame:
    """Files changed since a time less two seconds, the newest ones; None takes all."""
    rows = files.where(F.col("mtime") >= since - F.expr("INTERVAL 2 SECONDS"))
    return rows if newest is None else rows.orderBy(F.col("mtime").desc(), F.col("size").desc(), "path").limit(newest)
