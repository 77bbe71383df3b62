"""Cost, jobs and status beside plain Python, and what they take on skewed tables."""

from pyspark.sql import functions as F

from sessionloom.operators import status

from .metrics import most_rows


def test_a_name_of_many_models_is_counted_once(spark):
    n, cost = 2000, "named_struct('input', 1.0D)"
    many = spark.range(n).select(F.concat(F.lit("P"), F.col("id") % 3).alias("provider_id"), F.lit("Same").alias("model_id"), F.concat(F.lit("i"), "id").alias("id"), F.expr(cost).alias("cost"))
    asked = spark.range(n).select(F.col("id").alias("ask_id"), F.when(F.col("id") % 2 == 0, "same").when(F.col("id") % 4 == 1, "I7").otherwise("none").alias("model"), F.when(F.col("id") % 8 == 1, "p1").when(F.col("id") % 8 == 5, "p0").otherwise("").alias("provider"))
    df = status.resolve_pricing(asked, many)
    assert most_rows(df) <= 8 * n  # of about n * n / 2 pairs
    for r in df.collect():
        wanted = "ambiguous" if r.ask_id % 2 == 0 else "ok" if r.ask_id % 8 == 1 else "unknown"
        assert (r.price_status, r.model_id) == (wanted, "Same" if wanted == "ok" else None)


def test_equal_asks_count_a_model_as_often(spark):
    pricing = spark.createDataFrame([("p", "m", "i", 1.0)], "provider_id string, model_id string, id string, cost double")
    asked = [(1, "M", ""), (1, "M", ""), (2, "P:m", None), (3, "m", "q"), (4, None, "")]
    got = status.resolve_pricing(spark.createDataFrame(asked, "ask_id int, model string, provider string"), pricing)
    assert sorted((r.ask_id, r.price_status) for r in got.collect()) == [(1, "ambiguous"), (2, "ok"), (3, "unknown"), (4, "unknown")]


def test_jobs_of_all_sessions_meet_them_in_the_output_alone(spark):
    n = 400
    jobs = [(f"j{k}", "all" if k % 2 == 0 else "some", [f"/logs/{k % 5}.jsonl"], [str(k % 7), "gone"], k % 16 == 0, k) for k in range(n)]
    jobs += [("j0", "some", ["/logs/1.jsonl"], [], False, n), (None, "all", [], [], True, n)]  # a second row of a job
    sessions = [(str(k), f"/logs/{k}.jsonl", None if k % 50 == 49 else n - 2) for k in range(n)] + [(None, "/logs/1.jsonl", 0)]
    df = status.jobs_for_sessions(spark.createDataFrame(jobs, "job_id string, scope string, paths array<string>, result_ids array<string>, running boolean, updated_at int"), spark.createDataFrame(sessions, "session_id string, source_path string, indexed_at int"))
    whole = {j[0] for j in jobs if j[1] == "all"}
    pairs = {(j[0], s[0]) for j in jobs for s in sessions if j[0] and s[0] and (j[0] in whole or s[1] in j[2] or s[0] in j[3])}
    times, indexed = {}, {s: at for s, _, at in sessions}
    for job, _, _, _, running, at in jobs:
        times.setdefault(job, []).append((running, at))
    wanted = sorted((s, j) for j, s in pairs for running, at in times[j] if running or indexed[s] is None or at >= indexed[s])
    assert sorted((r.session_id, r.job_id) for r in df.collect()) == wanted
    assert most_rows(df) <= len(wanted)  # of 80,000 pairs of which most are too old
