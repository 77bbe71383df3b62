"""Summaries of closed spans, level by level, with reuse of what is done."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.sinks import tables, written, written_again

# Tags that mark a user's message as put there by a harness.
TAGS = ("recommended_plugins", "environment_context", "permissions instructions", "collaboration_mode", "multi_agent_mode", "skills_instructions", "apps_instructions", "plugins_instructions")
INJECTED = rf"(?i)<(?:{'|'.join(TAGS)})(?:\s[^>]*)?>"


def level_one_sources(df: DataFrame, injected: str = INJECTED) -> DataFrame:
    """What a first-level summary reads: messages of users and assistants, calls and results, less users' messages that a
    harness injected (where a column payload_kind is there, only those whose payload is a message)."""
    marked = (F.col("role") == "user") & F.coalesce(F.col("text").rlike(injected), F.lit(False))
    if "payload_kind" in df.columns:
        marked &= F.col("payload_kind").eqNullSafe("message")
    message = (F.col("type") == "message") & F.col("role").isin("user", "assistant") & ~marked
    return df.where(message | F.col("type").isin("tool_call", "tool_result"))


def child_records(nodes: DataFrame) -> DataFrame:
    """Adds record, the JSON a summary reads: source text at level 1, the child's summary and figures above."""
    low = F.to_json(F.struct(F.coalesce(F.nullif("role", F.lit("")), F.col("type")).alias("role"), F.col("tool_name"), F.col("call_id"), F.col("text")))
    high = F.to_json(F.struct(F.col("summary"), F.col("tokens"), F.col("start_at").alias("start"), F.col("end_at").alias("end"), (F.col("end_at") - F.col("start_at")).alias("duration")))
    return nodes.withColumn("record", F.when(F.col("level") == 1, low).otherwise(high))


def level_one_spans(sources: DataFrame, closed: DataFrame, tail: DataFrame, budget: int) -> DataFrame:
    """First-level groups: closed spans packed whole; of the tail all groups but the last, which may still grow unless it is full.

    sources/closed/tail are event rows (session_id, ordinal, cost); closed has span; only rows that are among the sources are packed
    (see level_one_sources). Where closed and tail have type and tool_call_id, a call and its result stay together. Adds slot (from
    0 in a session) and handle.
    """
    from .spans import pack_greedy, pack_pairs

    paired = {"type", "tool_call_id"} <= set(closed.columns) & set(tail.columns)
    columns = ["session_id", "span", "ordinal", "cost", *(["type", "tool_call_id"] if paired else [])]
    read = sources.select("session_id", "ordinal").distinct()

    def packed(df: DataFrame) -> DataFrame:
        rows, key = df.select(*columns).join(read, ["session_id", "ordinal"], "left_semi"), ["session_id", "span"]
        groups = pack_pairs(rows, key, budget) if paired else pack_greedy(rows, key, "ordinal", F.col("cost"), budget)
        return groups.select("session_id", "span", "ordinal", "cost", "group")

    done, open_ = packed(closed), packed(tail.withColumn("span", F.lit(1 << 30).cast("long")))
    by = Window.partitionBy("session_id")
    group = Window.partitionBy("session_id", "group")
    ready = open_.withColumn("last_group", F.max("group").over(by)).withColumn("total", F.sum("cost").over(group)).where((F.col("group") < F.col("last_group")) | (F.col("total") >= budget))
    rows = done.unionByName(ready.select(*done.columns))
    slots = rows.withColumn("slot", F.dense_rank().over(by.orderBy("span", "group")) - 1)
    return slots.withColumn("handle", F.concat(F.lit("summary/level-1/span-"), F.lpad(F.col("slot").cast("string"), 4, "0"))).drop("span", "group")


def parents_of(level: DataFrame, budget: int, most: int | None = None) -> DataFrame:
    """Adds parent_no to the spans of one level (session_id, seq, tokens): the group of spans in order whose tokens stay within the
    budget; null for all spans of a session with a single span, or where packing no longer makes them fewer. most: as for pack_greedy()."""
    from .spans import pack_greedy

    packed = pack_greedy(level, ["session_id"], "seq", F.col("tokens"), budget, most).drop("cost")
    by = Window.partitionBy("session_id")
    counted = packed.withColumn("n", F.count("*").over(by)).withColumn("groups", F.max("group").over(by) + 1)
    return counted.withColumn("parent_no", F.when((F.col("n") > 1) & (F.col("groups") < F.col("n")), F.col("group"))).drop("n", "groups", "group")


def span_handle(level: int, no: Column) -> Column:
    return F.concat(F.lit(f"summary/level-{level}/span-"), F.lpad(no.cast("string"), 4, "0"))


def rollup_levels(spans: DataFrame, budget: int) -> DataFrame:
    """Parents of spans (session_id, handle, seq, tokens) until each session has one top span or packing no longer shrinks
    it: (session_id, level, handle, seq, tokens, parent_handle). A session drops out as it converges; one round per level, without
    a bound, as each round leaves fewer spans."""
    current = spans.select("session_id", F.lit(1).alias("level"), "handle", F.col("seq").cast("long").alias("seq"), F.col("tokens").cast("long").alias("tokens"))
    done = None
    for level in count(1):
        rows = written(parents_of(written(current), budget).select("session_id", "level", "handle", "seq", "tokens", span_handle(level + 1, F.col("parent_no")).alias("parent_handle")))
        done = rows if done is None else done.unionByName(rows)
        above = rows.where("parent_handle is not null").groupBy("session_id", F.col("parent_handle").alias("handle")).agg(F.min("seq").alias("seq"), F.ceil(F.sum("tokens") / 4).cast("long").alias("tokens"))
        current = above.select("session_id", F.lit(level + 1).alias("level"), "handle", "seq", "tokens")
        if current.isEmpty():
            return done


def root_candidates(targets: DataFrame) -> DataFrame:
    """Sessions whose top spans (session_id, status) are all completed."""
    return targets.groupBy("session_id").agg(F.every(F.col("status") == "completed").alias("ready"), F.count("*").alias("spans")).where("ready").drop("ready")


def summary_inputs(children: DataFrame, key: list[str], revisions: DataFrame | None = None, first: str | None = None) -> DataFrame:
    """The records of each parent's children as ordered lines of JSON, with their number and hash (and, in a column named by first, their
    least pos; not beside revisions).

    With revisions (the key, plan and from_index of revision_plan(), previous, the summary to revise, and n_before), a parent whose plan is
    to append or to replace a suffix reads the previous summary, what has changed, and only the records from the first change on; the
    hash is over all records either way.
    """
    rows = F.array_sort(F.collect_list(F.struct("pos", "record")))
    firsts = [F.min("pos").alias(first)] if first else []
    whole = children.groupBy(*key).agg(rows.alias("rows"), F.count("*").alias("n_children"), *firsts)
    lines = lambda r: F.array_join(F.transform(r, lambda x: x.record), "\n")
    hashed = whole.withColumn("source_hash", F.sha2(lines(F.col("rows")), 256))
    if revisions is None:
        return hashed.select(*key, lines(F.col("rows")).alias("input"), "n_children", "source_hash", *([first] if first else []))
    met = hashed.join(revisions.select(*key, "plan", "from_index", "previous", "n_before"), key, "left")
    update = F.col("plan").isin("append", "replace_suffix") & F.col("previous").isNotNull()
    change = F.to_json(F.struct(F.col("plan").alias("kind"), F.col("from_index").alias("unchanged"), F.col("n_before").alias("before"), F.col("n_children").alias("now")))
    suffix = lines(F.slice("rows", F.col("from_index") + 1, F.greatest(F.col("n_children").cast("int") - F.col("from_index"), F.lit(0))))
    text = F.when(update, F.concat_ws("\n", "previous", change, suffix)).otherwise(lines(F.col("rows")))
    return met.select(*key, text.alias("input"), "n_children", "source_hash", F.when(update, F.col("plan")).otherwise("create").alias("plan"))


def target_ids(inputs: DataFrame, strategy: str, options: str = "") -> DataFrame:
    """Adds target_id, a hash of strategy, handle, source hash, plan, base and options: equal work has equal ids."""
    plan = F.col("plan") if "plan" in inputs.columns else F.lit("create")
    base = F.col("base_target_id") if "base_target_id" in inputs.columns else F.lit(None).cast("string")
    material = F.to_json(F.struct(F.lit(strategy).alias("strategy"), "handle", "source_hash", plan.alias("plan"), base.alias("base"), F.lit(options).alias("options")))
    return inputs.withColumn("target_id", F.sha2(material, 256))


def parse_summaries(df: DataFrame, column: str = "output") -> DataFrame:
    """Adds summary and error: a JSON object must have a text `summary` that is no JSON object itself; plain text is a
    summary; anything else is an error."""
    text = T.compact_text(F.col(column))
    json = F.try_parse_json(F.when(text.startswith("{") | text.startswith("["), text))
    inner = F.try_variant_get(json, "$.summary", "string")
    looks = F.col(column).rlike(r"^\s*[\[{]")
    good = inner.isNotNull() & (F.trim(inner) != "") & ~inner.rlike(r"^\s*[\[{]")
    summary = F.when(~looks & (text != ""), text).when(looks & good, T.compact_text(inner))
    error = F.when(text == "", "empty").when(looks & json.isNull(), "malformed").when(looks & ~F.coalesce(good, F.lit(False)), "no_summary")
    return df.withColumn("summary", summary).withColumn("error", error)


def split_reusable(jobs: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds work: reused where a completed target has the job's id, else pending."""
    done = targets.where("status = 'completed'").select("target_id").distinct().withColumn("is_done", F.lit(True))
    return jobs.join(done, "target_id", "left").withColumn("work", F.when(F.col("is_done"), "reused").otherwise("pending")).drop("is_done")


def commit_targets(targets: DataFrame, results: DataFrame) -> DataFrame:
    """Results merged into the targets by id (target_id, status, updated_at, ...): completed and error rows replace, reused
    ones leave what is stored; the latest write wins, completed over error at the same time."""
    old = targets.withColumn("is_new", F.lit(0))
    new = results.where("status in ('completed', 'error')").withColumn("is_new", F.lit(1))
    best = Window.partitionBy("target_id").orderBy(F.col("is_new").desc(), F.col("updated_at").desc(), (F.col("status") == "completed").desc())
    return old.unionByName(new, allowMissingColumns=True).withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth", "is_new")


def target_scope(targets: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Targets that the manifest's current lists (summary_target_ids) name, and orphans that none does."""
    current = manifest.select(F.explode("summary_target_ids").alias("target_id")).distinct()
    return targets.join(current, "target_id", "left_semi"), targets.join(current, "target_id", "left_anti")


def apply_results(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Batch results joined to jobs by custom id: parsed output of those that succeeded, else the error text."""
    met = jobs.join(results.select(F.col("custom_id").alias("target_id"), "result_type", "output", F.col("message")), "target_id", "left")
    parsed = parse_summaries(met.withColumn("output", F.when(F.col("result_type") == "succeeded", F.col("output"))))
    failed = F.when(F.col("result_type").isNull(), "missing").when(F.col("result_type") != "succeeded", F.coalesce("message", "result_type"))
    return parsed.withColumn("error", F.coalesce(failed, "error")).withColumn("status", F.when(F.col("error").isNull(), "completed").otherwise("error"))


#: Ranks of job states when lists of jobs are merged.
JOB_RANK = {"succeeded": 5, "completed": 4, "reused": 3, "submitted": 2, "pending": 1}


def merge_jobs(*dfs: DataFrame) -> DataFrame:
    """One row for each target: the one of the highest rank, the first of equal ones (by list, then seq)."""
    rank = F.coalesce(*[F.when(F.col("status") == k, v) for k, v in JOB_RANK.items()], F.lit(0))
    all_ = None
    for i, df in enumerate(dfs):
        own = df.withColumn("list_no", F.lit(i))
        all_ = own if all_ is None else all_.unionByName(own)
    best = Window.partitionBy("target_id").orderBy(rank.desc(), "list_no", "seq")
    return all_.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth", "list_no")


def revision_plan(current: DataFrame, previous: DataFrame, key: str = "handle") -> DataFrame:
    """What is to be done for each parent, from ordered hashes of its children now and before: append, replace_suffix (with
    the index of the first change), or create where it shrank, has no lineage or did not change."""
    now = current.select(key, F.size("hashes").alias("n_now"), F.posexplode("hashes").alias("i", "h"))
    then = previous.select(key, F.size("hashes").alias("n_then"), F.posexplode("hashes").alias("i", "g"))
    met = now.select(key, "i", "h").join(then.select(key, "i", "g"), [key, "i"], "full_outer")
    first = met.groupBy(key).agg(F.min(F.when(~F.col("h").eqNullSafe(F.col("g")), F.col("i"))).alias("first_change"))
    sizes = current.select(key, F.size("hashes").alias("n_now")).join(previous.select(key, F.size("hashes").alias("n_then")), key, "left")
    plan = F.when(F.col("n_then").isNull() | (F.col("n_now") < F.col("n_then")) | F.col("first_change").isNull() | (F.col("first_change") == 0), "create").when(F.col("first_change") == F.col("n_then"), "append").otherwise("replace_suffix")
    return sizes.join(first, key, "left").withColumn("plan", plan).select(key, "plan", F.when(F.col("plan") != "create", F.col("first_change")).alias("from_index"))


def maintenance_base(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """For each node (lineage, source_hash) the latest completed target of its lineage with another source hash."""
    done = targets.where("status = 'completed'").select("lineage", F.col("source_hash").alias("base_hash"), F.col("target_id").alias("base_target_id"), "completed_at")
    met = nodes.join(done, "lineage", "left").where(F.col("base_hash").isNull() | (F.col("base_hash") != F.col("source_hash")))
    best = Window.partitionBy("lineage", "source_hash").orderBy(F.col("completed_at").desc_nulls_last(), F.col("base_target_id").desc())
    return met.withColumn("nth", F.row_number().over(best)).where("nth = 1 and base_target_id is not null").drop("nth")


def apply_summaries(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds the stored summary of the newest completed target with the node's lineage and source hash."""
    best = Window.partitionBy("lineage", "source_hash").orderBy(F.col("completed_at").desc(), "target_id")
    done = targets.where("status = 'completed'").withColumn("nth", F.row_number().over(best)).where("nth = 1").select("lineage", "source_hash", "summary", "target_id")
    return nodes.join(done, ["lineage", "source_hash"], "left")


#: What a summariser adds to its inputs.
ADDED = {"summary": "string", "breadcrumb": "string", "topics": "array<string>", "usage": "struct<input:bigint,output:bigint>", "error": "string"}
SUMMARY = ", ".join(f"{name} {kind}" for name, kind in ADDED.items())
#: Times that a row without a usable summary is tried, and characters of a breadcrumb.
TRIES, BREADCRUMB = 3, 80


def by_row(summarise: Callable[[str], dict]) -> Callable[[DataFrame], DataFrame]:
    """A summariser from a function of one input's text that gives summary, breadcrumb, topics and usage (all but the first
    may be absent). A row whose call raises gets an error and the others go on."""

    def summariser(inputs: DataFrame) -> DataFrame:
        import pandas as pd

        def one(text: str) -> dict:
            try:
                got = dict(summarise(text))
            except Exception as e:  # a row's own failure stays with it
                return {"error": f"{type(e).__name__}: {e}"}
            usage = got.get("usage") or {}
            return got | {"usage": {"input": int(usage.get("input", 0)), "output": int(usage.get("output", 0))}}

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                got = [one("" if t is None else str(t)) for t in pdf["input"]]
                yield pdf.assign(summary=[g.get("summary") for g in got], breadcrumb=[g.get("breadcrumb") for g in got], topics=[list(g.get("topics") or []) for g in got], usage=[g.get("usage") for g in got], error=[g.get("error") for g in got])

        fields = ", ".join(f"`{n}` {t}" for n, t in inputs.dtypes)
        return inputs.mapInPandas(run, f"{fields}, {SUMMARY}")

    return summariser


def extract(text: str, words: int = 12, topics: int = 5) -> dict:
    """The first words of each line, and the most frequent long words as topics."""
    lines = text.split("\n")
    counts: dict[str, int] = {}
    for w in text.lower().split():
        if len(w) > 6 and w.isalpha():
            counts[w] = counts.get(w, 0) + 1
    brief = " / ".join(" ".join(x.split()[:words]) for x in lines)
    usage = {"input": max(1, -(-len(text) // 4)), "output": max(1, -(-len(brief) // 4))}
    return {"summary": brief, "breadcrumb": brief[:BREADCRUMB], "topics": sorted(counts, key=lambda w: (-counts[w], w))[:topics], "usage": usage}


def summarize_extractive(inputs: DataFrame) -> DataFrame:
    """The default summariser. Any function of DataFrames that adds the columns of SUMMARY can take its place, by_row() among
    them."""
    return by_row(extract)(inputs)


def retried(inputs: DataFrame, summariser: Callable[[DataFrame], DataFrame], key: str = "target_id", tries: int = TRIES, in_flight: int | None = None) -> DataFrame:
    """The summariser's rows for all inputs, with tries (how often a row was tried): rows with an error or without a summary
    are tried again, up to so many times; usage adds up over tries. Each round is written, so what has been answered is never asked again.

    in_flight: partitions that are worked on at once at most, to bound concurrent calls of an outside service.
    """
    pending, done = inputs, None
    for nth in range(1, tries + 1):
        dealt = pending if in_flight is None else pending.repartition(in_flight, key)
        made = summariser(dealt.drop("spent_input", "spent_output")).withColumn("tries", F.lit(nth))
        answered = F.coalesce(F.trim("summary"), F.lit("")) != ""
        error = F.when(F.col("error").isNotNull(), F.col("error")).when(~answered, "empty")
        made = made.withColumn("error", error).withColumn("summary", F.when(error.isNull(), F.col("summary")))
        if nth > 1:
            spent = pending.select(F.col(key).alias("of_key"), "spent_input", "spent_output")
            total = F.struct(*[(F.coalesce(f"usage.{f}", F.lit(0)) + F.col(f"spent_{f}")).cast("long").alias(f) for f in ("input", "output")])
            made = made.join(spent, F.col(key).eqNullSafe(F.col("of_key"))).withColumn("usage", total).drop("of_key", "spent_input", "spent_output")
        made = written(made)
        failed = made.where("error is not null")
        kept = made if nth == tries else made.where("error is null")
        done = kept if done is None else done.unionByName(kept)
        if nth == tries or failed.isEmpty():
            return done
        pending = failed.select(*inputs.columns, *[F.coalesce(f"usage.{f}", F.lit(0)).alias(f"spent_{f}") for f in ("input", "output")])


def summarize_cycle(inputs: DataFrame, targets: DataFrame, strategy: str, summariser: Callable[[DataFrame], DataFrame] = summarize_extractive, budget: float | None = None, at: int = 0, tries: int = TRIES, in_flight: int | None = None) -> tuple[DataFrame, DataFrame]:
    """One round: ids for the inputs (session_id, handle, input, source_hash), reuse of what is done, summaries of the rest,
    commit at time `at`. Returns the new targets and the inputs with work (reused or pending, as the round began), state (reused,
    done, error or pending, as it ended) and their summaries.

    With a budget (USD over all sessions), inputs have usd and seq, and only jobs that fit what is left of it are done, by seq, then session
    and handle; the others stay pending for a later round. Inputs of equal ids are summarised once. A row that still fails after so
    many tries is committed as an error, which a later run tries anew. A summariser need not give the columns beyond summary and error.
    """
    results, got = _results(inputs, targets, strategy, summariser, budget, at, tries, in_flight)
    return commit_targets(targets, results), got


def _results(inputs: DataFrame, targets: DataFrame, strategy: str, summariser: Callable[[DataFrame], DataFrame], budget: float | None, at: int, tries: int, in_flight: int | None) -> tuple[DataFrame, DataFrame]:
    """What summarize_cycle() makes anew, as rows of targets (written), and the inputs with work, state and summary."""
    from .spans import select_within_budget

    named = written(target_ids(inputs, strategy))
    known = targets.join(named.select("target_id").distinct(), "target_id", "left_semi").where("status = 'completed'")
    old = known.groupBy("target_id").agg(F.max_by("summary", "updated_at").alias("old"), F.lit(True).alias("is_done"))
    jobs = named.join(old, "target_id", "left").withColumn("work", F.when(F.col("is_done"), "reused").otherwise("pending")).drop("is_done")
    first = Window.partitionBy("target_id").orderBy(*(["seq"] if "seq" in jobs.columns else []), "session_id", "handle")
    pending = jobs.where("work = 'pending'").withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    if budget is not None:  # what is chosen among has no texts
        chosen = select_within_budget(pending.select("target_id", "session_id", "handle", "seq", "usd"), [], budget, order=("seq", "session_id", "handle")).where("selected")
        pending = pending.join(chosen.select("target_id"), "target_id", "left_semi")
    made = retried(pending.select("target_id", "session_id", "handle", "input"), lambda df: _with_all(summariser(df)), "target_id", tries, in_flight)
    status = F.when(F.col("error").isNull(), "completed").otherwise("error")
    results = made.select("target_id", status.alias("status"), "summary", "breadcrumb", "topics", "usage", "error", F.lit(at).cast("long").alias("updated_at"))
    new = results.select("target_id", F.col("summary").alias("new"), (F.col("status") == "error").alias("failed"))
    met = jobs.join(new, "target_id", "left")
    state = F.when(F.col("work") == "reused", "reused").when(F.col("new").isNotNull(), "done").when(F.col("failed"), "error").otherwise("pending")
    return results, met.withColumn("state", state).withColumn("summary", F.coalesce("new", "old")).drop("new", "old", "failed")


def _with_all(made: DataFrame) -> DataFrame:
    """The columns that a summariser left out, as nulls."""
    return made.withColumns({name: F.lit(None).cast(kind) for name, kind in ADDED.items() if name not in made.columns})


def summarize_to_roots(
    spans: DataFrame, records: DataFrame, strategy: str, budget: int, summariser: Callable[[DataFrame], DataFrame] = summarize_extractive, targets: DataFrame | None = None, most_usd: float | None = None, usd: Column | None = None, at: int = 0, tries: int = TRIES, in_flight: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rounds from first-level spans (session_id, handle, seq) with their records (session_id, handle, pos, record) up to
    the root of each session (handle `summary/root`, which reads the summaries of its top spans).

    A session climbs a level only when all its spans there have summaries: what failed or did not fit the budget stops it until a later
    run, which takes the returned targets and goes on from there. Parents are packed by the size of their children's finished
    summaries. Over all rounds together jobs cost most_usd at most (usd: the cost of an input, an expression over its column; a
    millionth of its estimated tokens unless given). Returns the targets, and for each span met session_id, level, handle, state and summary;
    level 0 is the root. Sessions that are done or stopped leave the frontier, so later rounds read only what still climbs; a root is
    summarised in the round after its top spans, beside the next level of other sessions.
    """
    cost = F.col("tokens") * 1e-6 if usd is None else usd
    if targets is None:
        targets = spans.sparkSession.createDataFrame([], f"target_id string, status string, {SUMMARY}, updated_at long")
    frontier = spans.select("session_id", "handle", F.col("seq").cast("long").alias("seq"), F.lit(1).alias("level"))
    inputs = summary_inputs(records.select("session_id", "handle", "pos", "record"), ["session_id", "handle"]).join(frontier, ["session_id", "handle"])
    every, places, results, left = None, [], None, most_usd
    for level in count(1):
        inputs = inputs.withColumn("tokens", T.estimate_tokens(F.col("input")))
        known = targets
        if every is not None:  # what this run has made, by its table of spans
            own = every.where("state = 'done'").select("target_id", F.lit("completed").alias("status"), "summary", F.lit(at).cast("long").alias("updated_at"))
            known = targets.select(*own.columns).unionByName(own)
        new, got = _results(inputs.withColumn("usd", cost), known, strategy, summariser, left, at, tries, in_flight)
        results = new if results is None else results.unionByName(new)
        got = written_again(got.select("session_id", "level", "handle", "seq", "state", "summary", "usd", "target_id"), places)
        every = tables(got, places)
        if left is not None:  # each id is paid for once
            paid = got.where("state in ('done', 'error')").select("target_id", "usd").distinct()
            left -= float(paid.agg(F.coalesce(F.sum("usd"), F.lit(0.0))).first()[0])
        climbing = got.where("level > 0")
        whole = climbing.groupBy("session_id").agg(F.every(F.col("summary").isNotNull()).alias("whole"), F.count("*").alias("n")).where("whole")
        most = whole.agg(F.max("n")).first()[0]
        if most is None:
            return commit_targets(targets, results), every.select("session_id", "level", "handle", "state", "summary")
        finished = climbing.join(whole.select("session_id"), "session_id", "left_semi").select("session_id", "handle", "seq", "summary", T.estimate_tokens(F.col("summary")).alias("tokens"))
        is_top = F.col("parent_no").isNull()
        packed = parents_of(finished, budget, most).withColumn("handle", F.when(is_top, "summary/root").otherwise(span_handle(level + 1, F.col("parent_no")))).withColumn("level", F.when(is_top, 0).otherwise(level + 1))
        children = packed.select("session_id", "handle", "level", F.col("seq").alias("pos"), F.col("summary").alias("record"))
        inputs = summary_inputs(children, ["session_id", "handle", "level"], first="seq")


def publish_decision(candidates: DataFrame, manifest: DataFrame) -> DataFrame:
    """publish, stale_source (the candidate is older than what is published, or its source changed since) or
    summary_not_ready (unfinished summaries would replace a published tree)."""
    old = manifest.select("session_id", *[F.col(c).alias(f"old_{c}") for c in ("mtime", "size", "event_count")])
    met = candidates.join(old, "session_id", "left")
    stale = (F.col("source_changed")) | (F.col("mtime") < F.col("old_mtime")) | (F.col("size") < F.col("old_size")) | (F.col("event_count") < F.col("old_event_count"))
    return met.withColumn("decision", F.when(F.coalesce(stale, F.col("source_changed")), "stale_source").when(F.col("old_mtime").isNotNull() & ~F.col("summaries_done"), "summary_not_ready").otherwise("publish")).drop("old_mtime", "old_size", "old_event_count")


def reusable_sessions(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose path, fingerprint and options equal the published ones (nulls equal nulls), with nothing pending unless it failed."""
    same = files.path.eqNullSafe(manifest.path) & files.fingerprint.eqNullSafe(manifest.fingerprint) & files.options.eqNullSafe(manifest.options)
    return files.join(manifest.where("pending = 0 or failed > 0"), same, "left_semi")
