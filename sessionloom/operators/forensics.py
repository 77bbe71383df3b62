"""Log forensics and documentation coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import markers as M


def marker_hits(lines: DataFrame, markers: DataFrame) -> DataFrame:
    """The lines (with all their columns and marker) that contain a marker; null lines and markers have no part.

    Markers of up to markers.AUTOMATON characters are searched for in one pass over each line. Beyond that, a line that has a marker has
    the marker's inner words whole, so lines and markers meet on the longest of these, and only lines that have it are read for the
    marker; markers without an inner word meet the lines in groups, in one pass for each group.
    """
    asked = markers.select("marker").where("marker is not null").distinct()
    if M.size_of(asked) <= M.AUTOMATON:
        return M.scan(lines, asked)
    words = lambda c: F.split(c, r"[^\p{L}\p{N}]+")
    inner = F.filter(F.slice(words("marker"), 2, F.greatest(F.size(words("marker")) - 2, F.lit(0))), lambda w: w != "")
    longest = F.try_element_at(F.array_sort(F.transform(inner, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), F.lit(1))["w"]
    asked = asked.withColumn("marker_word", longest)
    spoken = lines.select("path", "line_no", F.explode(F.array_distinct(words("raw"))).alias("marker_word"))
    near = spoken.join(asked.where("marker_word is not null"), "marker_word").select("path", "line_no", "marker").distinct()
    met = lines.join(near, ["path", "line_no"]).where(F.contains(F.col("raw"), F.col("marker")))
    return met.unionByName(M.scan_in_groups(lines, asked.where("marker_word is null").select("marker")))


def find_markers(lines: DataFrame, markers: DataFrame) -> DataFrame:
    """Which paths contain each literal: the last line with it and the byte offset of its last place there."""
    hits = marker_hits(lines, markers)
    times = "size(split(raw, concat('\\\\Q', marker, '\\\\E'), -1)) - 1"
    last = F.expr(f"octet_length(substring_index(raw, marker, {times}))")
    return hits.groupBy("marker", "path").agg(F.max(F.struct("line_no", last.alias("byte_offset"))).alias("hit"), F.count("*").alias("lines")).select("marker", "path", "hit.line_no", "hit.byte_offset", "lines")


def resolve_forks(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """Per marker the session that is no other candidate's parent: selected if one is left, direct if there was one, else
    ambiguous (candidates: marker, session_id; edges: parent_id, child_id)."""
    pairs = candidates.join(edges, F.col("session_id") == F.col("parent_id")).select("marker", "session_id", F.col("child_id"))
    parents = pairs.join(candidates.select(F.col("marker").alias("m"), F.col("session_id").alias("c")), (F.col("marker") == F.col("m")) & (F.col("child_id") == F.col("c")), "left_semi").select("marker", "session_id").distinct()
    leaves = candidates.join(parents, ["marker", "session_id"], "left_anti")
    n = candidates.groupBy("marker").agg(F.count("*").alias("candidates"))
    left = leaves.groupBy("marker").agg(F.count("*").alias("leaves"), F.min("session_id").alias("leaf"))
    met = n.join(left, "marker", "left").fillna({"leaves": 0})
    status = F.when(F.col("candidates") == 1, "direct").when(F.col("leaves") == 1, "selected").otherwise("ambiguous")
    return met.select("marker", status.alias("status"), F.when(status != "ambiguous", F.col("leaf")).alias("session_id"), "candidates")


def latest_match(lines: DataFrame, pattern: str) -> DataFrame:
    """Per file its last match (the last one in its line), and place, the rank of files by time, line, size (all newest or
    largest first) and path."""
    rows = lines.withColumn("match", F.try_element_at(F.regexp_extract_all("raw", F.lit(pattern), F.lit(0)), F.lit(-1))).where("match is not null")
    own = Window.partitionBy("path").orderBy(F.col("line_no").desc())
    last = rows.withColumn("nth", F.row_number().over(own)).where("nth = 1").drop("nth", "raw")
    return numbered(last, [F.col("mtime").desc(), F.col("line_no").desc(), F.col("size").desc(), F.col("path")], "place")


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Adds the place from 1 in an order of all rows: rows are dealt by range, numbered within their part, and shifted by the
    sizes of the parts before."""
    from ..sources.sinks import written

    dealt = written(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("part").agg(F.count("*").alias("size"))  # a row for each partition
    shift = sizes.select(F.col("part").alias("of_part"), F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return dealt.withColumn("nth", own).join(shift, F.col("part") == F.col("of_part")).withColumn(name, (F.col("nth") + F.col("shift")).cast("int")).drop("part", "of_part", "nth", "shift")


def session_inventory(files: DataFrame, names: DataFrame) -> DataFrame:
    """Per session id: newest file, bytes, number of files, title."""
    a = files.groupBy("session_id").agg(F.max_by("path", F.struct("mtime", "size", "path")).alias("newest"), F.sum("size").alias("bytes"), F.count("*").alias("files"))
    return a.join(names.select("session_id", "title"), "session_id", "left")


def corpus_fingerprint(docs: DataFrame) -> DataFrame:
    """One hash over paths and contents: of the sorted lines of each of 4,096 parts (by a hash of the path), and then of the parts
    in order, so no task holds all lines."""
    lines = docs.select(F.concat_ws("|", "path", F.sha2("content", 256)).alias("line"), F.substring(F.sha2("path", 256), 1, 3).alias("part"))
    parts = lines.groupBy("part").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("hash"), F.count("*").alias("n"))
    return parts.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("part", "hash"))), "\n"), 256).alias("fingerprint"), F.coalesce(F.sum("n"), F.lit(0)).alias("docs"))


def gate_status(stamps: DataFrame, current: DataFrame, allowed: tuple[str, ...] = ("pass", "reviewed"), schema: str = "v1") -> DataFrame:
    """Per check (name, fingerprint): missing, invalid_schema, stale, result_not_allowed or ok, by its stamp."""
    met = current.join(stamps.select("name", F.col("schema").alias("s"), F.col("fingerprint").alias("f"), F.col("result").alias("r"), F.lit(True).alias("there")), "name", "left")
    status = F.when(F.col("there").isNull(), "missing").when(F.coalesce("s", F.lit("")) != schema, "invalid_schema").when(~F.col("f").eqNullSafe(F.col("fingerprint")), "stale").when(~F.coalesce(F.col("r").isin(*allowed), F.lit(False)), "result_not_allowed").otherwise("ok")
    return met.select("name", status.alias("status"))


#: Characters of a part's beginning or end by which paths and scopes meet.
EDGE = 32


def scope_anchor(scope: Column) -> Column:
    """What each path that a scope with wildcards matches must have, as (size, kind, key), the longest there is: the scope's first or
    last parts without wildcards (head, tail; size in parts), one such part (part), or what a part begins or ends with (begins, ends; size
    in characters). Without any of these, the number of parts (count), unless ** leaves it open (open)."""
    parts = F.split(scope, "/")
    n, plain = F.size(parts), lambda p: ~p.contains("*")
    starred = F.transform(parts, lambda p: p.contains("*"))
    before = lambda flags: F.greatest(F.array_position(flags, True).cast("int") - 1, F.lit(0))
    first, last = before(starred), before(F.reverse(starred))  # parts before the first with a wildcard, and after the last
    found = lambda size, kind, key: F.struct(F.length(key).alias("long"), size.cast("int").alias("size"), F.lit(kind).alias("kind"), key.alias("key"))
    head, tail = F.array_join(F.slice(parts, 1, first), "/"), F.array_join(F.slice(parts, n - last + 1, last), "/")
    edges = F.filter(parts, lambda p: p.contains("*"))
    begin, end = lambda p: F.left(F.regexp_extract(p, r"(?s)^([^*]*)", 1), F.lit(EDGE)), lambda p: F.right(F.regexp_extract(p, r"(?s)([^*]*)$", 1), F.lit(EDGE))
    among = F.concat(
        F.array(found(first, "head", head), found(last, "tail", tail)),
        F.transform(F.filter(parts, plain), lambda p: found(F.lit(0), "part", p)),
        F.transform(edges, lambda p: found(F.length(begin(p)), "begins", begin(p))),
        F.transform(edges, lambda p: found(F.length(end(p)), "ends", end(p))),
    )
    best = F.array_max(F.filter(among, lambda a: a["long"] > 0))
    none = F.when(scope.contains("**"), found(F.lit(0), "open", F.lit(""))).otherwise(found(F.lit(0), "count", n.cast("string")))
    return F.coalesce(best, none)


def path_anchors(path: Column, sizes: dict[str, list[int]]) -> Column:
    """All anchors (kind, key) of a path, of the kinds and sizes that scopes ask for."""
    parts = F.split(path, "/")
    n = F.size(parts)
    long = lambda kind: F.array(*[F.lit(k) for k in sizes[kind]])
    edge = lambda take, kind: F.flatten(F.transform(parts, lambda p: F.transform(F.filter(long(kind), lambda k: k <= F.length(p)), lambda k: take(p, k))))
    keys = {
        "head": lambda: F.transform(F.filter(long("head"), lambda k: k <= n), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")),
        "tail": lambda: F.transform(F.filter(long("tail"), lambda k: k <= n), lambda k: F.array_join(F.slice(parts, n - k + 1, k), "/")),
        "part": lambda: parts,
        "begins": lambda: edge(F.left, "begins"),
        "ends": lambda: edge(F.right, "ends"),
        "count": lambda: F.array(n.cast("string")),
    }
    named = lambda kind, found: F.transform(F.array_distinct(found), lambda key: F.struct(F.lit(kind).alias("kind"), key.alias("key")))
    asked = [named(kind, of()) for kind, of in keys.items() if kind in sizes]
    return F.concat(*asked) if asked else F.array().cast("array<struct<kind:string,key:string>>")


def wild_matches(paths: DataFrame, scopes: DataFrame) -> DataFrame:
    """paths (path) with the scopes (scope, re, other columns) with wildcards that match them. They meet on what a scope has beside
    wildcards (scope_anchor), so a scope is tried only on paths that have it; a scope with ** and nothing else that is whole at an edge of
    a part, as **/*, is tried on all."""
    asked = scopes.withColumn("anchor", scope_anchor(F.col("scope"))).select("*", "anchor.kind", "anchor.key", "anchor.size").drop("anchor")
    sizes: dict[str, list[int]] = {}
    for kind, size in asked.select("kind", "size").distinct().orderBy("kind", "size").collect():  # parts of a path at most, twice, and EDGE, twice
        sizes.setdefault(kind, []).append(size)
    closed = paths.select("path", F.explode(path_anchors(F.col("path"), sizes)).alias("anchor")).select("path", "anchor.kind", "anchor.key")
    matches = closed.join(asked.where("kind <> 'open'"), ["kind", "key"]).where(F.rlike("path", F.col("re"))).drop("kind", "key", "size")
    return matches.unionByName(paths.join(asked.where("kind = 'open'").drop("kind", "key", "size"), F.rlike("path", F.col("re")))) if "open" in sizes else matches


def affected_docs(changes: DataFrame, sections: DataFrame) -> DataFrame:
    """Documents that a change touches (changes: path; sections: doc_path, section_id, scopes): by a matching scope, or
    by an edit of the document itself; kind is source or doc, matched scopes are collected.

    A plain scope is a path or a folder and meets the changed paths on their own prefixes; scopes with wildcards meet them on what they have
    beside wildcards (wild_matches)."""
    scopes = sections.select("doc_path", "section_id", F.explode("scopes").alias("scope")).withColumn("re", T.scope_regex(F.col("scope")))
    globs = F.col("scope").contains("*")
    paths = changes.select("path").distinct()
    parts = F.split("path", "/")
    prefixes = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("prefix"))
    plain = prefixes.join(scopes.where(~globs), F.col("prefix") == F.rtrim(F.col("scope"), F.lit("/"))).where(F.rlike(F.col("path"), F.col("re")))
    wild = wild_matches(paths, scopes.where(globs))
    matched = ("path", "doc_path", "section_id", F.lit("source").alias("kind"), "scope")
    by_scope = plain.select(*matched).unionByName(wild.select(*matched))
    direct = changes.select("path").distinct().join(sections, F.col("path") == F.col("doc_path")).select("path", "doc_path", "section_id", F.lit("doc").alias("kind"), F.lit(None).cast("string").alias("scope"))
    return by_scope.unionByName(direct).groupBy("path", "doc_path", "section_id", "kind").agg(F.array_sort(F.collect_set("scope")).alias("scopes"))


def uncovered(changes: DataFrame, affected: DataFrame) -> DataFrame:
    return changes.select("path").distinct().join(affected.select("path").distinct(), "path", "left_anti")


def reconcile_threads(threads: DataFrame, files: DataFrame, alternatives: DataFrame) -> DataFrame:
    """Threads (id, path) against existing files: resolved; else degraded with another file of the same id; else blocked."""
    there = files.select("path").distinct().withColumn("exists", F.lit(True))
    other = alternatives.groupBy("id").agg(F.min("path").alias("other_path"))
    met = threads.join(there, "path", "left").join(other, "id", "left")
    status = F.when(F.col("exists"), "resolved").when(F.col("other_path").isNotNull(), "degraded").otherwise("blocked")
    reason = F.when(status == "blocked", F.when(T.text_of(F.col("path")) == "", "no_path").otherwise("missing_file"))
    return met.select("id", status.alias("status"), F.when(F.col("exists"), F.col("path")).otherwise(F.col("other_path")).alias("path"), reason.alias("reason"))


def score_retrieval(trace: DataFrame) -> DataFrame:
    """Per evaluation (eval_id, tool_name, is_verbatim, omitted, content, is_error, answer, expected): whether the answer
    has what was expected, a search and an open took place, verbatim evidence was opened with nothing left out, errors; passed if
    all hold."""
    has = F.contains(F.lower(T.text_of(F.col("content"))), F.lower(T.text_of(F.col("expected"))))
    s = trace.groupBy("eval_id").agg(
        F.bool_or(F.contains(F.lower(T.text_of(F.col("answer"))), F.lower(T.text_of(F.col("expected"))))).alias("answered"), F.bool_or(F.coalesce(F.col("tool_name") == "search", F.lit(False))).alias("searched"), F.bool_or(F.coalesce(F.col("tool_name") == "open", F.lit(False))).alias("opened"),
        F.bool_or(F.coalesce((F.col("tool_name") == "open") & F.col("is_verbatim") & (F.col("omitted") == 0) & has, F.lit(False))).alias("verbatim"), F.count_if("is_error").alias("errors"),
    )
    return s.withColumn("passed", F.col("answered") & F.col("searched") & F.col("opened") & F.col("verbatim"))


def evidence_coverage(events: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Per required prefix: the number of sessions with a call whose name starts with it; 0 means missing."""
    calls = events.where("type = 'tool_call'").select("session_id", "call_name").distinct()
    met = calls.join(prefixes, F.startswith(F.col("call_name"), F.col("prefix")))
    found = met.groupBy("prefix").agg(F.count_distinct("session_id").alias("sessions"))
    return prefixes.join(found, "prefix", "left").fillna({"sessions": 0}).withColumn("missing", F.col("sessions") == 0)


def tail_lines(lines: DataFrame, most_bytes: int) -> DataFrame:
    """The last whole lines of each file within so many bytes."""
    w = Window.partitionBy("path").orderBy(F.col("line_no").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("from_end", F.sum(F.octet_length("raw") + 1).over(w)).where(F.col("from_end") <= most_bytes).drop("from_end")


def read_edges(df: DataFrame, parent: str, child: str) -> DataFrame:
    return df.select(F.col(parent).alias("parent_id"), F.col(child).alias("child_id")).where("parent_id is not null and child_id is not null").distinct()


def analyze_sessions(lines: DataFrame, terms: list[str], path_pattern: str = r'"(?:cwd|workdir|path|rollout_path)":\s*"([^"]+)"') -> DataFrame:
    """Per log file: path events with line, the last path, tool calls, and lines that match terms."""
    paths = F.regexp_extract_all("raw", F.lit(path_pattern), F.lit(1))
    call = F.regexp_extract("raw", r'"type":\s*"(?:function_call|custom_tool_call)".*?"name":\s*"([^"]+)"', 1)
    rows = lines.withColumns({"paths": paths, "call": F.nullif(call, F.lit("")), "hit": T.term_match(F.col("raw"), *terms)})
    return rows.groupBy("path").agg(
        F.max_by(F.try_element_at("paths", F.lit(-1)), F.when(F.size("paths") > 0, F.col("line_no"))).alias("current_path"), F.sum(F.size("paths")).alias("path_events"),
        F.array_sort(F.collect_list(F.when(F.col("call").isNotNull(), F.struct("line_no", "call")))).alias("tool_calls"), F.count_if("hit").alias("term_lines"),
    )
