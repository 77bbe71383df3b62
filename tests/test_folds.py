"""Sequential folds, rounds and streams beside plain Python."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import spans, summaries
from sessionloom.sources import sinks
from sessionloom.streaming import streams


def greedy(costs, budget):
    groups, total = [], None
    for c in costs:
        if total is None or total + c > budget:
            groups.append(0 if not groups else groups[-1] + 1)
            total = c
        else:
            groups.append(groups[-1])
            total += c
    return groups


def sessions(seed, most=30):
    rng = random.Random(seed)
    return {f"s{k}": [rng.randint(1, 12) for _ in range(rng.randint(1, most))] for k in range(12)}


@pytest.mark.parametrize("fold", [10_000, 6])
def test_pack_greedy(spark, monkeypatch, fold):
    monkeypatch.setattr(spans, "FOLD", fold)  # beyond it, starts are marked by pointer doubling
    all_ = sessions(1) | {None: [3, 0, 0, 25, 0, 1, 9, 11, 2, 2], "zero": [0] * 9, "large": [40] * 9, "one": [5]}
    rows = [(s, i, c, "kept") for s, costs in all_.items() for i, c in enumerate(costs)] + [("odd", i, c, "kept") for i, c in enumerate([None, -4, 7, 5])]
    df = spark.createDataFrame(rows, "session_id string, ordinal long, price long, text string")
    got = {(r.session_id, r.ordinal): r.group for r in spans.pack_greedy(df, ["session_id"], "ordinal", F.col("price"), 10).collect()}
    assert got == {(s, i): g for s, costs in (all_ | {"odd": [0, 0, 7, 5]}).items() for i, g in enumerate(greedy(costs, 10))}


@pytest.mark.parametrize("fold", [10_000, 2])
def test_packing_keeps_rows_of_equal_order(spark, monkeypatch, fold):
    monkeypatch.setattr(spans, "FOLD", fold)
    rows = [(k, o, c, t) for k in ("a", None) for o, c, t in [(0, 3, "x"), (0, 3, "x"), (0, 4, "y"), (1, 5, "z"), (None, 2, "n"), (1, 5, "z")]]
    df = spark.createDataFrame(rows, "k string, o long, c long, t string")
    got = spans.pack_greedy(df, ["k"], "o", F.col("c"), 8).collect()
    assert sorted(map(str, [(r.k, r.o, r.c, r.t) for r in got])) == sorted(map(str, rows))
    for k in ("a", None):
        own = [r for r in got if r.k == k]
        groups = {g: sum(r.c for r in own if r.group == g) for g in {r.group for r in own}}
        assert min(groups) == 0 and max(groups) == len(groups) - 1 and all(v <= 8 for v in groups.values())
        assert sorted((r.group, r.o if r.o is not None else -1) for r in own) == sorted(((r.group, r.o if r.o is not None else -1) for r in own), key=lambda x: (x[1], x[0]))
    assert spans.pack_greedy(df.limit(0), ["k"], "o", F.col("c"), 8).count() == 0


def test_a_long_session_packs_in_many_tasks(spark):
    n = 60_000
    df = spark.range(n).select(F.lit("s").alias("session_id"), F.col("id").alias("ordinal"), (F.col("id") * 7919 % 97).alias("cost"))
    got = {r.ordinal: r.group for r in spans.pack_greedy(df, ["session_id"], "ordinal", F.col("cost"), 1000).collect()}
    assert [got[i] for i in range(n)] == greedy([i * 7919 % 97 for i in range(n)], 1000)


def test_pack_pairs_keeps_calls_with_their_results(spark):
    rows = [("s", i, 4, kind, call) for i, (kind, call) in enumerate([("message", None), ("tool_call", "a"), ("tool_result", "a"), ("message", None), ("tool_call", "b"), ("message", None), ("tool_result", "b")])]
    df = spark.createDataFrame(rows, "session_id string, ordinal long, cost long, type string, tool_call_id string")
    groups = {r.ordinal: r.group for r in spans.pack_pairs(df, ["session_id"], 8).collect()}
    assert groups[1] == groups[2] and groups[4] == groups[6]
    sources = df.where("ordinal <> 3")
    got = summaries.level_one_spans(sources, df.where("ordinal < 4").withColumn("span", F.lit(0).cast("long")), df.where("ordinal >= 4"), 8).collect()
    slots = {r.ordinal: r.slot for r in got}
    assert 3 not in slots and slots[1] == slots[2] and slots.get(4) == slots.get(6)


def test_select_within_budget(spark):
    rng = random.Random(3)
    rows = [(f"k{k}", i, round(rng.random(), 2)) for k in range(5) for i in range(rng.randint(1, 20))]
    got = {(r.k, r.seq): (r.selected, r.status) for r in spans.select_within_budget(spark.createDataFrame(rows, "k string, seq long, usd double"), ["k"], 2.0, limit=10).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        spent, chosen = 0.0, {}
        for _, seq, usd in [r for r in rows if r[0] == key][:10]:
            chosen[seq] = spent + usd <= 2.0 + 1e-9
            spent += usd if chosen[seq] else 0
        status = "ok" if all(chosen.values()) else "budget_limited" if any(chosen.values()) else "over_budget"
        want |= {(key, seq): (c, status) for seq, c in chosen.items()}
    assert got == want


@pytest.mark.parametrize(("key", "fold"), [(["k"], 10_000), (["k"], 30), ([], 10_000), ([], 40)])
def test_admission_by_plain_python(spark, key, fold, monkeypatch):
    """Sizes over many powers of two, ties, nulls and zeros; one budget for each key, or one for all; with and without rounds."""
    monkeypatch.setattr(spans, "FOLD", fold)
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 40), rng.choice([0.0, None, -1.0, round(2.0 ** -rng.randint(0, 20), 6), round(rng.random() * 4, 3)]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, seq long, usd double, id long")
    got = spans.select_within_budget(df, key, 5.0, order=("seq", "id")).collect()
    assert len(got) == len(rows)
    left, spent = {}, {}
    for r in sorted(got, key=lambda r: (r.seq, r.id)):
        k = r.k if key else 0
        usd = Decimal(repr(max(r.usd or 0, 0)))
        fits = usd <= left.setdefault(k, Decimal("5.000000001"))
        assert r.selected == fits, r
        left[k] -= usd if fits else 0
        spent[k] = spent.get(k, 0) + (usd if fits else 0)
        assert r.spent == pytest.approx(float(spent[k]))
        assert r.status == "budget_limited"


def test_rollup_levels(spark):
    all_ = sessions(5)
    df = spark.createDataFrame([(s, f"h{i}", i, c) for s, costs in all_.items() for i, c in enumerate(costs)], "session_id string, handle string, seq long, tokens long")
    got = summaries.rollup_levels(df, 20).collect()
    for s, costs in all_.items():
        level, tokens = 1, costs
        while True:
            own = sorted((r for r in got if r.session_id == s and r.level == level), key=lambda r: r.seq)
            assert [r.tokens for r in own] == tokens
            parents = [r.parent_handle for r in own]
            if all(p is None for p in parents):
                break
            groups = greedy(tokens, 20)
            assert [parents.index(p) for p in parents] == [groups.index(g) for g in groups]
            tokens = [-(-sum(t for t, x in zip(tokens, groups) if x == g) // 4) for g in dict.fromkeys(groups)]
            level += 1


def plain_summary(text, words=12):
    return " / ".join(" ".join(x.split()[:words]) for x in text.split("\n"))


def test_cycle_reuses_and_keeps_to_its_budget(spark):
    inputs = spark.createDataFrame([(f"s{i}", f"h{i}", f"line one of {i}\nand two", f"hash{i}", i, 1.0) for i in range(6)], "session_id string, handle string, input string, source_hash string, seq long, usd double")
    none = spark.createDataFrame([], "target_id string, status string, summary string, updated_at long")
    calls = spark.sparkContext.accumulator(0)

    def counted(df):
        def run(batches):
            for pdf in batches:
                calls.add(len(pdf))
                yield pdf.assign(summary=[plain_summary(t) for t in pdf["input"]], topics=[[] for _ in range(len(pdf))], error=None)

        fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
        return df.mapInPandas(run, f"{fields}, summary string, topics array<string>, error string")

    targets, got = summaries.summarize_cycle(inputs, none, "v1", counted, budget=2.5, at=7)
    first = {r.handle: r.summary for r in got.collect()}
    assert [h for h, s in sorted(first.items()) if s] == ["h0", "h1"] and first["h0"] == "line one of 0 / and two" and calls.value == 2
    assert {r.updated_at for r in targets.collect()} == {7}
    _, again = summaries.summarize_cycle(inputs, targets, "v1", counted)
    rows = {r.handle: (r.work, r.summary) for r in again.collect()}
    assert rows["h0"] == ("reused", "line one of 0 / and two") and rows["h5"] == ("pending", "line one of 5 / and two") and calls.value == 6


def fold_to_roots(sessions_, known, budget, most_usd=None, fails=()):
    """Plain Python of summarize_to_roots() with the extractive summariser: texts are ids. Returns (level, session, handle) ->
    (state, summary) and what is known afterwards."""
    known, left, out = dict(known), Decimal(repr(most_usd)) + Decimal("1e-9") if most_usd is not None else None, {}
    tokens = lambda t: max(1, -(-len(t) // 4))
    levels = {s: [(f"h{i}", i, "\n".join(lines)) for i, lines in enumerate(spans_)] for s, spans_ in sessions_.items()}
    level = 1

    def round_(jobs, level):
        nonlocal left
        got, reused = {}, set(known)
        for seq, s, h, text in sorted((seq, s, h, text) for s, h, seq, text in jobs):
            key = (h, text)
            if key in reused:
                got[s, h] = ("reused", known[key])
            elif key in known:
                got[s, h] = ("done", known[key])
            else:
                cost = Decimal(repr(round(tokens(text) * 1e-6, 12)))
                if left is not None and cost > left:
                    got[s, h] = ("pending", None)
                    continue
                left = None if left is None else left - cost
                if any(f in text for f in fails):
                    got[s, h] = ("error", None)
                    continue
                known[key] = plain_summary(text)
                got[s, h] = ("done", known[key])
        out.update({(0 if k[1] == "summary/root" else level, *k): v for k, v in got.items()})
        return got

    roots = {}
    while levels or roots:
        got = round_([(s, *job) for s, own in [*levels.items(), *roots.items()] for job in own], level)
        above, roots = {}, {}
        for s, own in levels.items():
            texts = [got[s, h][1] for h, _, _ in own]
            if any(t is None for t in texts):
                continue
            groups = greedy([tokens(t) for t in texts], budget)
            if len(own) > 1 and groups[-1] + 1 < len(own):
                above[s] = [(f"summary/level-{level + 1}/span-{g:04}", min(q for (_, q, _), x in zip(own, groups) if x == g), "\n".join(t for t, x in zip(texts, groups) if x == g)) for g in dict.fromkeys(groups)]
            else:
                roots[s] = [("summary/root", min(q for _, q, _ in own), "\n".join(texts))]
        levels, level = above, level + 1
    return out, known


def trees(seed):
    """Sessions of spans of lines; lines differ, so no two jobs are equal."""
    rng = random.Random(seed)
    return {f"s{k}": [[f"{k}-{i}-{j} " + " ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.randint(1, 9))) for j in range(rng.randint(1, 3))] for i in range(rng.randint(1, 7))] for k in range(5)}


def to_roots(spark, sessions_, **options):
    leaves = spark.createDataFrame([(s, f"h{i}", i) for s, own in sessions_.items() for i in range(len(own))], "session_id string, handle string, seq long")
    records = spark.createDataFrame([(s, f"h{i}", j, t) for s, own in sessions_.items() for i, lines in enumerate(own) for j, t in enumerate(lines)], "session_id string, handle string, pos long, record string")
    targets, got = summaries.summarize_to_roots(leaves, records, "v1", 30, **options)
    return sinks.written(targets), {(r.level, r.session_id, r.handle): (r.state, r.summary) for r in got.collect()}


def test_runs_climb_to_the_roots_within_their_budgets(spark):
    """Three runs: a small budget with a failing row, a larger one, one without a bound; each goes on from the targets before."""
    sessions_, known, targets = trees(4), {}, None

    def failing(df):
        return summaries.by_row(lambda t: 1 / 0 if "2-0-0" in t else summaries.extract(t))(df)

    for at, (most, summariser, fails) in enumerate([(0.0001, failing, ("2-0-0",)), (0.0003, failing, ("2-0-0",)), (None, summaries.summarize_extractive, ())]):
        targets, got = to_roots(spark, sessions_, targets=targets, most_usd=most, summariser=summariser, at=at, tries=2)
        want, known = fold_to_roots(sessions_, known, 30, most, fails)
        assert got == want, at
    assert {s for level, s, _ in got if level == 0} == set(sessions_) and all(w in ("done", "reused") for w, _ in got.values())
    assert max(level for level, _, _ in got) > 1
    stored = targets.collect()
    assert len(stored) == len({r.target_id for r in stored}) == len(known) and all(r.status == "completed" and r.breadcrumb and r.usage.input > 0 for r in stored)


def test_a_failed_child_stops_its_session_alone(spark):
    sessions_ = {"a": [["fine one"], ["bad two"]], "b": [["fine three"], ["fine four"]]}
    targets, got = to_roots(spark, sessions_, summariser=summaries.by_row(lambda t: {"summary": "" if "bad" in t else t}), tries=2)
    assert {k: v[0] for k, v in got.items()} == {(1, "a", "h0"): "done", (1, "a", "h1"): "error", (1, "b", "h0"): "done", (1, "b", "h1"): "done", (2, "b", "summary/level-2/span-0000"): "done", (0, "b", "summary/root"): "done"}
    [failed] = targets.where("status = 'error'").collect()
    assert failed.error == "empty" and failed.summary is None


def test_rows_are_tried_a_bounded_number_of_times(spark):
    """A function that answers on a row's third call, one that raises, one that never answers."""
    at = sinks.shared_folder(spark).removeprefix("file:")

    def moody(text):
        import os
        import uuid

        os.makedirs(f"{at}/{text}", exist_ok=True)
        calls = len(os.listdir(f"{at}/{text}"))
        open(f"{at}/{text}/{uuid.uuid4().hex}", "w").close()
        if text == "raises":
            raise ValueError("no")
        return {"summary": "yes" if text == "late" and calls == 2 or text == "good" else " ", "usage": {"input": 5, "output": 1}}

    df = spark.createDataFrame([("1", "good"), ("2", "late"), ("3", "raises"), ("4", "mute"), (None, "good")], "target_id string, input string")
    got = {(r.target_id, r.input): r for r in summaries.retried(df, summaries.by_row(moody), in_flight=2).collect()}
    assert len(got) == 5 and {k[1]: r.tries for k, r in got.items()} == {"good": 1, "late": 3, "raises": 3, "mute": 3}
    assert got["2", "late"].summary == "yes" and got["2", "late"].usage.input == 15 and got["3", "raises"].error == "ValueError: no" and got["4", "mute"].error == "empty" and got["4", "mute"].summary is None
    assert got["3", "raises"].usage.input == 0 and got["1", "good"].usage.output == 1 and got["1", "good"].topics == []


def test_update_prompts_read_the_suffix(spark):
    children = spark.createDataFrame([("a", i, f"r{i}") for i in range(4)] + [("b", i, f"q{i}") for i in range(2)], "handle string, pos long, record string")
    plans = spark.createDataFrame([("a", "append", 2, "before", 2), ("b", "create", None, "old", 3)], "handle string, plan string, from_index int, previous string, n_before int")
    plain = {r.handle: r for r in summaries.summary_inputs(children, ["handle"]).collect()}
    got = {r.handle: r for r in summaries.summary_inputs(children, ["handle"], plans).collect()}
    lines = got["a"].input.split("\n")
    assert lines[0] == "before" and lines[2:] == ["r2", "r3"] and '"unchanged":2' in lines[1] and got["a"].plan == "append"
    assert got["b"].input == "q0\nq1" and got["b"].plan == "create" and all(got[h].source_hash == plain[h].source_hash for h in got)


def test_batches_of_an_older_generation_are_deferred(spark):
    root = sinks.shared_folder(spark)
    rows = lambda *r: spark.createDataFrame(r, "session_id string, turn long, text string, generation long")
    publish = streams.publish_batch(spark, root, lambda log: log.select("session_id", F.col("turn").cast("string").alias("handle"), F.col("text").alias("head")))
    publish(rows(("a", 0, "one", 0), ("b", 0, "two", 0)), 0)
    sinks.bump_generations(spark.createDataFrame([], "session_id string, generation long"), spark.createDataFrame([("a",)], "session_id string")).write.parquet(f"{root}/generations")
    publish(rows(("a", 1, "stale", 0), ("b", 1, "new", 0)), 1)
    assert sorted((r.session_id, r.head) for r in streams.latest_docs(spark, root).collect()) == [("a", "one"), ("b", "new"), ("b", "two")]
    assert [r.session_id for r in spark.read.parquet(f"{root}/deferred/batch=1").collect()] == ["a"]
    publish(rows(("a", 1, "fresh", 1)), 2)
    assert ("a", "fresh") in {(r.session_id, r.head) for r in streams.latest_docs(spark, root).collect()}


@pytest.mark.parametrize("most", [12, 11])
def test_stream_markers_are_bounded(spark, most, monkeypatch):
    monkeypatch.setattr(streams, "MOST_MARKED", most)  # "this" and "line 2", and one for each
    at = sinks.shared_folder(spark)
    for k in range(3):  # three files, three micro-batches
        spark.createDataFrame([("p", k, f"line {k} has this"), ("q", k, "nothing")], "path string, line_no long, raw string").coalesce(1).write.mode("append").parquet(at)
    markers = spark.createDataFrame([("this",), ("line 2",)], "marker string")
    if most == 11:
        with pytest.raises(ValueError):
            streams.stream_markers(streams.as_stream(spark, at), markers)
    else:
        got = streams.run_to_table(streams.stream_markers(streams.as_stream(spark, at), markers)).collect()
        assert sorted((r.marker, r.line_no) for r in got) == [("line 2", 2), ("this", 0), ("this", 1), ("this", 2)]
