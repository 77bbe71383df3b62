"""Requests and trees that are larger than those of the registered queries."""

import random

import pytest
from pyspark.sql import functions as F

from sessionloom.functions import usage as U
from sessionloom.operators import events, search, tree


def test_every_request_for_everything_gets_its_page(spark):
    docs = spark.range(30).select(F.lit("s").alias("session_id"), F.concat(F.lit("h"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("handle"), F.lit(True).alias("retrieval_visible"), F.lit("word here").alias("search_text"), F.lit(0).alias("start_at"))
    requests = spark.range(1003).select(F.col("id").alias("request_id"), F.expr("case when id = 0 then 'word' when id % 2 = 0 then '*' else '' end").alias("query"))
    rows = search.search(docs, requests, start=5, limit=10).collect()
    assert {r.request_id for r in rows} == set(range(1003)) and len(rows) == 10030
    assert all((r.handle, r.total, r.next_start) == (f"h{r.place:02}", 30, 15) and 5 <= r.place < 15 for r in rows)


def test_depth_has_no_bound(spark):
    rows = [(i, i - 1 if i else None) for i in range(67)]
    got = tree.with_depth(spark.createDataFrame(rows, "node long, parent long"), "node", "parent").collect()
    assert len(got) == 67 and all(r.depth == r.node and r.max_depth == 66 for r in got)


def forest(seed, depth):
    """Random trees of two sessions with chains down to a depth: (session, handle, parent, depth, pos, kind, raw, at, own, links)."""
    rng, out = random.Random(seed), []
    for s in ("a", "b"):
        rows = [(s, "root", None, 0, 0, "session", None, None, rng.choice([0, 5]), [])]
        for i in range(60):
            up = rows[-1] if i < depth else rng.choice(rows)
            rows.append((s, f"n{i}", up[1], up[3] + 1, rng.randint(0, 6) * 100 + i, rng.choice(["message", "message", "message", "reasoning"]) if i >= depth else "message", "x" * rng.randint(0, 40), rng.choice([None, rng.randint(0, 99)]), rng.randint(0, 3), rng.choices(["l1", "l2", "l3"], k=rng.randint(0, 2))))
        out += rows
    return out + [("b", "lost", "nowhere", 4, 0, "message", "abcde", 3, 1, ["l9"])]


def rolled_by_hand(rows):
    kids = {}
    for r in rows:
        kids.setdefault((r[0], r[2]), []).append(r)
    tokens = lambda t: max(1, -(-len(t or "") // 4))
    out = {}

    def roll(r):
        s, h, _, depth, _, _, raw, at, own, links = r
        every = sorted(kids.get((s, h), []), key=lambda c: c[4]) if h != "nowhere" else []
        got = [(roll(c), c) for c in every]
        seen = [(g, c) for g, c in got if not c[5].startswith("reasoning")]
        full = sum(g[1] for g, _ in seen) if every else tokens(raw)
        ahead = sum(tokens(c[6] or c[1]) for _, c in seen) if every else tokens(raw)
        used = own if depth == 0 and own else own + sum(g[3] for g, _ in seen)
        start = at if at is not None else next((g[4] for g, _ in seen if g[4] is not None), None)
        end = at if at is not None else next((g[5] for g, _ in reversed(seen) if g[5] is not None), None)
        out[s, h] = (len(seen), full, ahead, used, start, end, list(dict.fromkeys([*links, *[x for g, _ in seen for x in g[6]]])))
        return out[s, h]

    for r in rows:
        if r[2] is None or r[2] == "nowhere":
            roll(r)
    return out


NODES = "session_id string, handle string, parent_handle string, depth int, pos long, kind string, raw string, at long, own long, links array<string>"


@pytest.mark.parametrize("depth", [0, 2, 10, 40])
def test_trees_of_any_depth_roll_up(spark, depth):
    rows = forest(depth, depth)
    df = spark.createDataFrame(rows, NODES).withColumns({"own_usage": U.usage(input=F.col("own")), "head": F.col("raw"), "title": F.col("handle")})
    got = {(r.session_id, r.handle): (r.n_children, r.full_tokens, r.next_tokens, r.usage.input, r.start_at, r.end_at, r.all_links) for r in tree.rollup_tree(df).collect()}
    want = rolled_by_hand(rows)
    assert len(got) == len(rows) and {k: v for k, v in got.items() if v != want[k]} == {}


def test_a_chain_loses_no_node_and_a_cycle_fails(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None, i) for i in range(300)], "node_no long, parent_no long, step long")
    assert all(r.path == r.up == list(range(r.node_no + 1)) for r in tree.forest_paths(chain).collect())
    ring = spark.createDataFrame([(0, None, 0), (1, 2, 1), (2, 1, 2)], "node_no long, parent_no long, step long")
    with pytest.raises(ValueError, match="cycle"):
        tree.forest_paths(ring)
    assert tree.forest_paths(chain.limit(0)).count() == 0


def test_a_cycle_below_a_root_fails(spark):
    rows = [(0, None), (1, 0), (1, 2), (2, 1)]
    with pytest.raises(ValueError, match="cycle"):
        tree.with_depth(spark.createDataFrame(rows, "node long, parent long"), "node", "parent")


def documents(spark, rows):
    """(handle, parent, depth, pos, kind, text) as documents of one session."""
    df = spark.createDataFrame([("s", *r, *[r[5][:40] or r[0]] * 2, len(r[5]) // 4 + 1) for r in rows], "session_id string, handle string, parent_handle string, depth int, pos int, kind string, full_text string, title string, head string, full_tokens long")
    return df.withColumns({"search_text": F.col("full_text"), "type": F.lit("message"), "role": F.lit("user"), "retrieval_visible": F.lit(True), "start_at": F.lit(0), "topics": F.array(F.lit("Topic One")), "message_id": F.concat(F.lit("m"), F.substring("handle", 1, 2)), "excerpt": F.col("full_text"), "line": F.lit(None).cast("long"), "raw": F.nullif("full_text", F.lit(""))})


TREE = [("root", None, 0, 0, "session", ""), ("sum", "root", 1, 0, "summary", "what it is about"), ("a1", "sum", 2, 0, "message", "alpha beta"), ("a1/x", "sum", 2, 1, "chunk", "alpha beta gamma"), ("b2", "sum", 2, 2, "message", "delta")]


def test_a_generated_only_child_stands_in_for_an_empty_root(spark):
    docs = documents(spark, TREE)
    asked = spark.createDataFrame([(1, "s", "root", "children", "")], "request_id int, session_id string, handle string, zoom string, topic string")
    plain = docs.withColumn("kind", F.when(F.col("kind") == "message", "note").otherwise(F.col("kind")))
    assert [r.handle for r in search.browse(plain, asked).orderBy("place").collect()] == ["a1", "a1/x", "b2"]
    more = plain.unionByName(documents(spark, [("c", "root", 1, 1, "note", "second child")]))
    assert [r.handle for r in search.browse(more, asked).orderBy("place").collect()] == ["sum", "c"]
    assert [r.handle for r in search.browse(plain.withColumn("kind", F.lit("note")), asked).collect()] == ["sum"]


def test_heads_of_children_fit_the_budget(spark):
    docs = documents(spark, [("root", None, 0, 0, "session", ""), *[(f"k{i}", "root", 1, i, "note", f"text {i}") for i in range(4)]])
    lines = [f"- text {i}: text {i} (2 full tokens) [k{i}]" for i in range(4)]
    cost = lambda t: -(-len(t) // 4)
    for budget, shown in ((1, 1), (cost("root") + 2 * cost(lines[0]), 2), (1000, 4)):
        asked = spark.createDataFrame([(1, "s", "root", budget)], "request_id int, session_id string, handle string, budget int")
        [got] = search.open_nodes(docs, asked).collect()
        rest = [f"... {4 - shown} more children omitted."] if shown < 4 else []
        assert got.mip_level == "heads" and got.content == "\n".join(["root", *lines[:shown], *rest]) and got.children == [f"k{i}" for i in range(shown)]


def test_find_refs_filters_pages_hydrates_and_folds(spark):
    docs = documents(spark, TREE)
    asked = spark.createDataFrame([(1, "alpha")], "request_id int, query string")
    nodes = docs.select("session_id", "handle", "kind", "line", F.concat(F.lit("source of "), "handle").alias("raw"))
    got = search.find_refs(docs, nodes, asked, topic="topic", role="user").collect()
    assert [(r.handle, r.content, r.total) for r in got] == [("a1", "source of a1", 2)]  # both hits stand for message ma1
    assert search.find_refs(docs, nodes, asked, topic="other").isEmpty() and search.find_refs(docs, nodes, asked, role="assistant").isEmpty()


@pytest.mark.parametrize("bits", [2, 12])
def test_top_hits_by_plain_python(spark, bits):
    """Random requests with their own filters and pages, with totals and with blocks passed over."""
    rng = random.Random(bits)
    words = ["alpha", "beta", "gamma", "delta", "rare"]
    texts = [" ".join(rng.choices(words, weights=[9, 5, 3, 2, 0.2], k=rng.randint(1, 12))) for _ in range(150)]
    rows = [("s%d" % (i % 3), f"h{i:03}", i % 2 + 1, rng.choice(["user", "assistant", None]), t, i % 17) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "session_id string, handle string, depth int, role string, search_text string, start_at int").withColumn("retrieval_visible", F.col("handle") != "h007").repartition(3)
    asked = [(1, "alpha rare", None, None, None, 0, 5), (2, "beta", "gamma", ["user"], None, 3, 4), (3, "rare", "", ["user", "assistant"], 2, 0, 50), (4, "", None, ["user"], 1, 2, 6), (5, "none", "", None, None, 0, 5), (6, None, None, [], 0, 0, 5), (7, "Alpha BETA", None, ["nobody"], None, 0, 5), (8, "", "", None, 2, 70, 20), (9, "alpha", None, [""], None, 140, 20)]
    requests = search.request_table(spark.createDataFrame(asked, "request_id int, query string, topic string, role array<string>, mip int, start int, limit int"))
    index = search.build_block_index(docs, bits)
    want, totals = {}, {}
    for i, q, t, roles, mip, start, limit in asked:
        tokens = set(f"{q or ''} {t or ''}".lower().split())
        roles = [r for r in roles or [] if r]
        hits = []
        for s, h, depth, role, text, at in rows:
            if h == "h007" or roles and role not in roles or mip and depth != mip:
                continue
            found = [text.split().count(w) for w in tokens if w in text.split()]
            if found or not tokens and (roles or mip):
                hits.append((-len(found) or -1, -sum(found) or -1, at, s, h))
        hits.sort()
        totals[i] = len(hits)
        for place, (matched, tf, _, s, h) in enumerate(hits[start : start + limit], start):
            want[i, place] = (s, h, -matched, -tf, start + limit if len(hits) > start + limit else None)
    for all_ in (True, False):
        got = search.top_hits(index, requests, all_, first_blocks=2).collect()
        assert {(r.request_id, r.place): (r.session_id, r.handle, r.matched, r.tf, r.next_start) for r in got} == want
        assert all(r.total == (totals[r.request_id] if all_ else None) for r in got) and len(got) == len(want)


def test_documents_that_lack_the_topic_label_are_found_by_its_words(spark):
    docs = documents(spark, TREE)
    nodes = docs.select("session_id", "handle", "kind", "line", F.concat(F.lit("source of "), "handle").alias("raw"))
    asked = spark.createDataFrame([(1, "", "delta", None), (2, "alpha", "nothing like that", "user"), (3, "alpha", "", "assistant"), (4, "", "", "")], "request_id int, query string, topic string, role string")
    got = {(r.request_id, r.handle) for r in search.find_refs(docs, nodes, asked, totals=False).collect()}
    assert got == {(1, "b2"), (2, "a1")}


def test_loaded_events_are_found_by_call_output_and_title(spark):
    kind = "session_id string, source_kind string, line_no long, block_no long, type string, role string, at timestamp, text string, call_id string, tool_name string, title string, usage struct<input:bigint,output:bigint,cache_read:bigint,cache_write:bigint,reasoning:bigint,total:bigint>"
    rows = [
        ("s", "log", 1, 0, "message", "user", None, "please look", None, None, "a greeting", None),
        ("s", "log", 2, 0, "tool_call", "assistant", None, '{"path":"x"}', "c1", "read_file", None, None),
        ("s", "log", 3, 0, "tool_result", "tool", None, "output of it", "c1", None, None, None),
        ("s", "log", 4, 0, "reasoning", "assistant", None, "secret thought", None, None, None, None),
        ("s", "log", 5, 0, "message", "user", None, None, None, None, None, None),
        ("s", "log", 6, 0, "usage", "assistant", None, None, None, None, None, (1, 2, 0, 0, 0, 3)),
    ]
    docs = events.event_documents(events.accepted(events.normalize_events(spark.createDataFrame(rows, kind))))
    assert [r.search_text for r in docs.orderBy("line_no").collect()] == [
        "a greeting\nuser\nplease look", 'assistant\nread_file\n{"path":"x"}', "tool\noutput of it", "", "", 'assistant\n{"cache_read":0,"cache_write":0,"input":1,"output":2,"reasoning":0,"total":3}',
    ]
    asked = spark.createDataFrame([(1, "read file"), (2, "greeting"), (3, "secret"), (4, "output of")], "request_id int, query string")
    got = search.search(docs, asked).where("place = 0").select("request_id", "line_no").collect()
    assert sorted((r.request_id, r.line_no) for r in got) == [(1, 2), (2, 1), (4, 3)]
    index = search.build_block_index(docs)
    assert index.narrow.count() == 4 and "tool_call_id" in index.narrow.columns
