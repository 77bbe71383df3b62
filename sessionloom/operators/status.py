"""Counts, accounting, status and cost of sessions, targets and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import usage as U
from ..sources.sinks import written


def build_sessions(events: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One header per session: declared id (the last one, else the file's), first time, first cwd, model and family, the
    file's time as the update, summed usage."""
    value = lambda c: F.when(T.text_of(F.col(c)) != "", F.col("ordinal"))
    heads = events.groupBy("session_id").agg(
        F.max_by("declared_id", value("declared_id")).alias("declared_id"), F.min_by("at", F.when(F.col("at").isNotNull(), F.col("ordinal"))).alias("started_at"), F.min_by("cwd", value("cwd")).alias("cwd"),
        F.min_by("model", value("model")).alias("model"), F.count("*").alias("event_count"), F.count_if((F.col("type") == "message") & (F.col("role") == "user")).alias("turn_count"), F.struct(*U.sums("usage")).alias("usage"),
    )
    heads = heads.withColumn("id", F.coalesce("declared_id", "session_id")).withColumn("model_family", T.model_family(F.col("model")))
    return heads if files is None else heads.join(files.select("session_id", F.col("mtime").alias("updated_at")), "session_id", "left")


def with_titles(sessions: DataFrame, names: DataFrame) -> DataFrame:
    """Adds title: the last non-empty name of the session's id, else a label of the id."""
    last = names.where(T.text_of(F.col("name")) != "").groupBy("id").agg(F.max_by("name", "line_no").alias("title"))
    return sessions.join(last, "id", "left").withColumn("title", F.coalesce("title", F.concat(F.lit("Session "), F.substring("id", 1, 8))))


def session_counts(events: DataFrame, docs: DataFrame) -> DataFrame:
    """Events, user turns and documents of each session."""
    e = events.groupBy("session_id").agg(F.count("*").alias("events"), F.count_if((F.col("type") == "message") & (F.col("role") == "user")).alias("turns"))
    return e.join(docs.groupBy("session_id").agg(F.count("*").alias("docs")), "session_id", "left").fillna({"docs": 0})


def compaction_log(spans: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per boundary (session_id, span): target, completed, failed and pending counts and a status."""
    met = spans.join(jobs, "target_id", "left")
    c = met.groupBy("session_id", "span").agg(F.count("target_id").alias("targets"), F.count_if(F.col("status").isin("completed", "succeeded", "reused")).alias("completed"), F.count_if(F.col("status") == "error").alias("failed"))
    c = c.withColumn("pending", F.col("targets") - F.col("completed") - F.col("failed"))
    return c.withColumn("status", F.when(F.col("targets") == 0, "empty").when(F.col("failed") > 0, "error").when(F.col("completed") == F.col("targets"), "indexed").when(F.col("completed") > 0, "partial").otherwise("pending"))


def target_counts(targets: DataFrame, current: DataFrame, now: Column) -> DataFrame:
    """Counts over all targets and over those in the current scope: total, completed, live and stale claims, failed; and orphans."""
    inside = current.select("target_id").distinct().withColumn("is_current", F.lit(True))
    rows = targets.join(inside, "target_id", "left").withColumn("is_current", F.coalesce("is_current", F.lit(False)))
    claimed = F.col("status") == "claimed"
    tests = {"total": F.lit(True), "completed": F.col("status") == "completed", "claimed": claimed & (F.col("claim_expires_at") > now), "stale": claimed & (F.col("claim_expires_at") <= now), "failed": F.col("status") == "error"}
    both = [F.count_if(t).alias(n) for n, t in tests.items()] + [F.count_if(t & F.col("is_current")).alias(f"current_{n}") for n, t in tests.items()]
    return rows.agg(*both, F.count_if(~F.col("is_current")).alias("orphans"))


def indexing_stats(log: DataFrame) -> DataFrame:
    return log.groupBy("session_id").agg(F.count("*").alias("boundaries"), F.count_if(F.col("status") == "indexed").alias("indexed"), F.count_if(F.col("status") == "partial").alias("partial"), F.count_if(F.col("status") == "error").alias("error"), F.sum("targets").alias("targets"), F.sum("completed").alias("completed"), F.sum("pending").alias("pending"))


def job_accounting(jobs: DataFrame, keys: list[str], output_estimate: int = 320) -> DataFrame:
    """Planned and completed input tokens, output (actual where any job tells it, else estimated), counts, and which it was."""
    done = F.col("status").isin("completed", "succeeded")
    a = jobs.groupBy(*keys).agg(F.count("*").alias("jobs"), F.sum("input_tokens").alias("planned_input"), F.coalesce(F.sum(F.when(done, F.col("input_tokens"))), F.lit(0)).alias("completed_input"), F.count_if(done).alias("completed"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("actual_output"))
    basis = F.when(F.col("actual_output") > 0, "actual").otherwise("estimate")
    return a.withColumn("basis", basis).withColumn("output", F.when(F.col("basis") == "actual", F.col("actual_output")).otherwise(F.col("jobs") * output_estimate)).drop("actual_output")


def list_models(pricing: DataFrame, needle: str = "", provider: str | None = None, limit: int | None = 20) -> DataFrame:
    """Models by provider and id whose fields contain the needle, in any case; the first `limit`, or all."""
    rows = pricing if provider is None else pricing.where(F.lower("provider_id") == provider.lower())
    fields = [c for c in ("provider_id", "model_id", "id", "name", "family", "status") if c in pricing.columns]
    found = rows.where(F.lower(F.concat_ws("\n", *fields)).contains(needle.lower())).orderBy("provider_id", "model_id")
    return found if limit is None else found.limit(limit)


def resolve_pricing(asked: DataFrame, pricing: DataFrame) -> DataFrame:
    """Adds to rows with `model` (and maybe `provider`): status (ok, unknown, ambiguous), provider_id, model_id, cost.

    `provider/model` and `provider:model` are parted where the first part is a known provider. Names match the model id, the id, or
    either qualified form, in any case. Rows that are equal in all columns, a given ask_id among them, are one, and count each model as often.

    Models are counted by name and provider before they meet the rows, each of which meets one count: a name that many models
    share costs no more than others.
    """
    low = lambda c: F.lower(F.trim(T.text_of(c)))
    numbered = "ask_id" in asked.columns
    rows = asked if numbered else asked.withColumn("ask_id", F.monotonically_increasing_id())
    columns = rows.columns
    rows = rows.groupBy(*columns).agg(F.count("*").alias("copies")) if numbered else rows.withColumn("copies", F.lit(1).cast("long"))
    rows = rows.withColumns({"wanted": low(F.col("model")), "wanted_by": low(F.col("provider"))})
    wanted = written(asked.select(low(F.col("model")).alias("model_key")).distinct())  # its size is known, so that few names are broadcast
    names = F.array_distinct(F.array(low(F.col("model_id")), low(F.col("id")), low(F.concat_ws("/", "provider_id", "model_id")), low(F.concat_ws(":", "provider_id", "model_id"))))
    keys = pricing.select("provider_id", "model_id", "cost", F.explode(names).alias("model_key")).join(wanted, "model_key", "left_semi")
    by = F.array_distinct(F.array(F.lit(""), low(F.col("provider_id"))))
    found = written(keys.withColumn("by", F.explode(by)).groupBy("model_key", "by").agg(F.count("model_id").alias("models"), F.min(F.struct("provider_id", "model_id", "cost")).alias("hit")))
    met = rows.join(found, (F.col("wanted") == F.col("model_key")) & (F.col("wanted_by") == F.col("by")), "left").withColumn("n", F.coalesce(F.col("models") * F.col("copies"), F.lit(0)))
    status = F.when(F.col("n") == 0, "unknown").when(F.col("n") > 1, "ambiguous").otherwise("ok")
    one = lambda c: F.when(F.col("n") == 1, F.col(f"hit.{c}")).alias(c)
    return met.select(*columns, status.alias("price_status"), one("provider_id"), one("model_id"), one("cost"))


def estimate_cost(df: DataFrame, usage: str = "usage", cost: str = "cost") -> DataFrame:
    """Adds per part the tokens and USD, total_usd and assumptions. Cached tokens leave the input; their rates fall back to the
    input's; with a reasoning rate, reasoning leaves the output."""
    u, rate = F.col(usage), lambda name: F.coalesce(F.col(f"{cost}.{name}"), F.lit(0.0))
    usable = lambda name: F.when(rate(name) > 0, rate(name)).otherwise(rate("input"))
    reasons = rate("reasoning") > 0
    parts = {
        "input": (F.greatest(F.lit(0), u["input"] - u["cache_read"] - u["cache_write"]), rate("input")),
        "cache_read": (u["cache_read"], usable("cache_read")),
        "cache_write": (u["cache_write"], usable("cache_write")),
        "output": (F.when(reasons, F.greatest(F.lit(0), u["output"] - u["reasoning"])).otherwise(u["output"]), rate("output")),
        "reasoning": (u["reasoning"], F.when(reasons, rate("reasoning")).otherwise(0.0)),
    }
    out = df.withColumns({f"{n}_tokens": t for n, (t, _) in parts.items()} | {f"{n}_usd": t * r / 1e6 for n, (t, r) in parts.items()})
    total = sum((F.col(f"{n}_usd") for n in parts), F.lit(0.0))
    notes = F.filter(F.array(
        F.when((rate("cache_read") == 0) & (u["cache_read"] > 0), "cache_read at input rate"), F.when((rate("cache_write") == 0) & (u["cache_write"] > 0), "cache_write at input rate"), F.when(~reasons & (u["reasoning"] > 0), "reasoning within output"),
    ), lambda x: x.isNotNull())
    return out.withColumn("total_usd", total).withColumn("assumptions", notes)


def jobs_for_sessions(jobs: DataFrame, manifest: DataFrame, whole_scope: bool = True) -> DataFrame:
    """(session_id, job_id) pairs: a job of scope all, or with the session's path, or its id in a path or among its results; jobs
    older than the published index only if they run. Without whole_scope jobs of scope all stay out, which give a row for each
    session (see latest_job_of_sessions()).

    Jobs of scope all need not be told from what they name: they meet all sessions, straight in the output, and only what the others
    name is shuffled.
    """
    ids = written(jobs.where("scope = 'all'").select("job_id").distinct()) if whole_scope else None  # its size is known
    some = jobs.join(ids, "job_id", "left_anti") if whole_scope else jobs
    paths = some.select("job_id", F.explode("paths").alias("path"))
    named = paths.withColumn("session_id", T.session_id_from_path(F.col("path"), strict=True)).where("session_id is not null").select("job_id", "session_id")
    by_path = paths.join(manifest.select("session_id", F.col("source_path").alias("path")), "path").select("job_id", "session_id")
    results = some.select("job_id", F.explode("result_ids").alias("session_id"))
    pairs = named.unionByName(by_path).unionByName(results)
    own = pairs.distinct().join(some.select("job_id", "updated_at", "running"), "job_id").join(manifest.select("session_id", "indexed_at"), "session_id")
    own = own.where(_fresh()).select("session_id", "job_id")
    if not whole_scope:
        return own
    whole = written(jobs.join(ids, "job_id", "left_semi").select("job_id", "updated_at", "running"))
    tasks = int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sessions = manifest.where("session_id is not null").select("session_id", "indexed_at").repartition(tasks)
    return own.unionByName(sessions.join(whole, _fresh()).select("session_id", "job_id"))


def _fresh() -> Column:
    return F.col("running") | F.col("indexed_at").isNull() | (F.col("updated_at") >= F.col("indexed_at"))


def latest_job_of_sessions(jobs: DataFrame, manifest: DataFrame) -> DataFrame:
    """(session_id, job_id) of the job that latest_job() picks among those of jobs_for_sessions(). Of the jobs of scope all one row
    is enough for all sessions: one that runs, else the newest; if that one is too old for a session, so are the others."""
    own = jobs_for_sessions(jobs, manifest, whole_scope=False)
    one = jobs.where("scope = 'all'").select("job_id", "running", "updated_at").orderBy(F.col("running").desc(), F.col("updated_at").desc(), "job_id").limit(1)
    shared = manifest.select("session_id", "indexed_at").join(F.broadcast(one), F.lit(True)).where(_fresh()).select("session_id", "job_id")
    met = own.unionByName(shared).distinct().join(jobs.select("job_id", "running", "updated_at"), "job_id")
    return latest_job(met, ["session_id"]).select("session_id", "job_id")


def latest_job(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """The running job of each key, else the newest."""
    best = Window.partitionBy(*keys).orderBy(F.col("running").desc(), F.col("updated_at").desc(), "job_id")
    return jobs.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth")


def session_status(manifest: DataFrame, jobs: DataFrame) -> DataFrame:
    """One state per session of either table: ready always wins once published; else suspended-budget, suspended, error,
    indexing-in-progress, not-started. What goes wrong beside a published index is a message."""
    last = latest_job(jobs, ["session_id"]).select("session_id", "running", F.col("status").alias("job_status"), F.col("error").alias("job_error"))
    met = manifest.select("session_id", F.lit(True).alias("published")).join(last, "session_id", "full_outer")
    trouble = F.when(F.col("job_status") == "budget_limited", "suspended-budget").when(F.col("job_status") == "suspended", "suspended").when(F.col("job_status") == "error", "error")
    state = F.when(F.col("published"), "ready").otherwise(F.coalesce(trouble, F.when(F.col("running"), "indexing-in-progress"), F.lit("not-started")))
    return met.select("session_id", state.alias("state"), F.when(F.col("published") & trouble.isNotNull(), F.concat_ws(": ", trouble, "job_error")).alias("message"))


def readiness(status: DataFrame, keys: list[str]) -> DataFrame:
    return status.groupBy(*keys).agg(F.every("ready").alias("all_ready"), *[F.sum(c).alias(c) for c in ("pending", "completed", "claimed", "failed")], (F.sum("pending") > 0).alias("can_continue"))


def unindexed_active(jobs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Sessions of running jobs that are not published."""
    return jobs.where("running").select("session_id").distinct().join(manifest.select("session_id"), "session_id", "left_anti")


def status_page(unindexed: DataFrame, indexed: DataFrame, start: int, limit: int) -> DataFrame:
    """Unindexed sessions first, then indexed ones, newest first; paged."""
    from .search import page

    rows = unindexed.select("session_id", F.lit(0).alias("section"), F.lit(None).cast(dict(indexed.dtypes)["updated_at"]).alias("updated_at")).unionByName(indexed.select("session_id", F.lit(1).alias("section"), "updated_at"))
    return page(rows, [F.col("section"), F.col("updated_at").desc(), F.col("session_id")], start, limit)


def budget_suspension(budgets: DataFrame) -> DataFrame:
    """What is left to do and to approve (limit_usd, spent_usd, remaining_usd): approval cap to the cent, additional
    amount, message."""
    cap = T.ceil_cents(F.col("spent_usd") + F.col("remaining_usd"))
    more = T.ceil_cents(cap - F.col("limit_usd"))
    over = F.col("spent_usd") + F.col("remaining_usd") > F.col("limit_usd")
    return budgets.withColumn("approval_usd", cap).withColumn("additional_usd", F.when(over, more).otherwise(0.0)).withColumn("status", F.when(F.col("spent_usd") >= F.col("limit_usd"), "over_budget").when(over, "budget_limited").otherwise("ok"))


def upsert_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """The newest record of each session; its current target ids sorted."""
    best = Window.partitionBy("session_id").orderBy(F.col("indexed_at").desc(), F.col("is_new").desc())
    all_ = old.withColumn("is_new", F.lit(0)).unionByName(new.withColumn("is_new", F.lit(1)))
    return all_.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth", "is_new").withColumn("summary_target_ids", F.array_sort(F.array_distinct("summary_target_ids")))


#: Lines of a source that are hashed together.
STRETCH = 4096


def source_fingerprint(lines: DataFrame, marker: str) -> DataFrame:
    """Per path: size, a hash of the line hashes, count and last line of marked lines, a hash of their list.

    Hashes are taken of stretches of STRETCH line numbers and then of those in order, so no task holds the lines of a large source.
    """
    marked = F.col("raw").contains(marker)
    ordered = lambda by, x: F.transform(F.array_sort(F.collect_list(F.struct(by, x.alias("x")))), lambda s: s.x)
    part = F.floor(F.col("line_no") / STRETCH).alias("stretch")
    numbers = F.transform(F.array_sort(F.collect_list(F.when(marked, F.col("line_no")))), lambda n: n.cast("string"))
    by_part = lines.groupBy("path", part).agg(
        F.sum(F.octet_length("raw") + 1).alias("size"), F.sha2(F.array_join(ordered("line_no", F.sha2("raw", 256)), ""), 256).alias("content"), F.count_if(marked).alias("marked"), F.max(F.when(marked, F.col("line_no"))).alias("last"),
        F.sha2(F.array_join(numbers, ","), 256).alias("places"),
    )
    whole = lambda c: F.sha2(F.array_join(ordered("stretch", F.col(c)), ""), 256)
    return by_part.groupBy("path").agg(F.sum("size").alias("size"), whole("content").alias("content_hash"), F.sum("marked").alias("compactions"), F.max("last").alias("last_compaction_line"), whole("places").alias("compaction_hash"))


def index_ids(events: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """idx- and a hash of the ordered events without their source; an id that a session has already stays.

    Of sessions with more than STRETCH ordinals the hashes of stretches are hashed, so no task holds the events of a large one.
    """
    material = F.sha2(F.concat_ws("|", "type", "role", "text"), 256)
    joined = lambda by, x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, x.alias("h")))), lambda s: s.h), "")
    parts = events.groupBy("session_id", F.floor(F.col("ordinal") / STRETCH).alias("stretch")).agg(F.sha2(joined("ordinal", material), 256).alias("part"))
    whole = parts.groupBy("session_id").agg(F.when(F.count("*") == 1, F.first("part")).otherwise(F.sha2(joined("stretch", F.col("part")), 256)).alias("m"))
    made = whole.select("session_id", F.concat(F.lit("idx-"), F.substring("m", 1, 32)).alias("index_id"))
    if manifest is None:
        return made
    kept = manifest.select("session_id", F.col("index_id").alias("kept"))
    return made.join(kept, "session_id", "left").select("session_id", F.coalesce(F.nullif("kept", F.lit("")), "index_id").alias("index_id"))
