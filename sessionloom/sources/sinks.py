"""Where documents, manifests and exports go: Parquet tables by generation, and linked or chat exports."""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T

#: Partitions of a documents table, unless a writer names another number: for some hundred MB each.
BUCKETS = 64


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir), deleted when the driver's JVM ends; where none is set,
    one of our own on a single machine, an error elsewhere."""
    context = spark.sparkContext
    folder = context._jsc.sc().getCheckpointDir()
    if folder.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(named)
        folder = context._jsc.sc().getCheckpointDir()
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.get()}/{uuid.uuid4().hex}")
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return place.toString()


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: what several later steps read is computed once, and lineage ends there."""
    return written_again(df, [])


def written_again(df: DataFrame, places: list[str]) -> DataFrame:
    """As written(); adds the table's folder to places, which hold tables of the same columns: they can be read as one (see tables())."""
    at = shared_folder(df.sparkSession)
    df.write.parquet(at)
    places.append(at)
    return tables(df, [at])


def tables(df: DataFrame, places: list[str]) -> DataFrame:
    """The rows of all tables with the columns of df in the given folders, by one scan: a plan that doesn't grow with their number."""
    return df.sparkSession.read.schema(df.schema).parquet(*places)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def bucket(buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int")


def stored_docs(docs: DataFrame) -> DataFrame:
    """What a documents table keeps: no content or search text; of verbatim documents no excerpt either."""
    verbatim = F.col("search_text") != ""
    return docs.withColumn("excerpt", F.when(~verbatim, F.col("excerpt"))).drop("raw", "search_text")


def write_docs(docs: DataFrame, root: str, buckets: int = BUCKETS) -> None:
    """Writes the stored form of documents, partitioned by a hash of the session."""
    stored_docs(docs).withColumn("session_bucket", bucket(buckets)).repartition(buckets, "session_bucket").sortWithinPartitions("session_id", "handle").write.mode("overwrite").partitionBy("session_bucket").parquet(root)


def read_docs(spark: SparkSession, root: str, counts: DataFrame | None = None) -> DataFrame:
    """The stored documents; with counts (session_id, docs), an error where a session has other than that many."""
    docs = spark.read.parquet(root).drop("session_bucket")
    if counts is None:
        return docs
    found = docs.groupBy("session_id").agg(F.count("*").alias("found"))
    met = docs.join(counts.join(found, "session_id", "left").select("session_id", "docs", F.coalesce("found", F.lit(0)).alias("found")), "session_id")
    return met.withColumn("ok", F.assert_true(F.col("docs") == F.col("found"), "a session's documents are incomplete")).where("ok is null").drop("ok", "docs", "found")


def replace_sessions(old: DataFrame | None, new: DataFrame, sessions: DataFrame) -> DataFrame:
    """The collection with every row of the given sessions replaced: a session without new rows goes. Rows must belong to the
    given sessions and carry an index id (one is made from the session id); new columns may come, none may go or change."""
    made = new.withColumn("index_id", F.coalesce(F.nullif("index_id", F.lit("")), F.concat(F.lit("idx-"), F.substring(F.sha2("session_id", 256), 1, 32)))) if "index_id" in new.columns else new.withColumn("index_id", F.concat(F.lit("idx-"), F.substring(F.sha2("session_id", 256), 1, 32)))
    scope = sessions.select(F.col("session_id").alias("scope_id")).distinct()
    checked = made.join(scope, made.session_id == scope.scope_id, "left").withColumn("bad", F.assert_true(F.col("scope_id").isNotNull() & F.col("handle").isNotNull(), "a row outside of the published sessions, or without a handle")).where("bad is null").drop("bad", "scope_id")
    if old is None:
        return checked
    before, after = dict(old.dtypes), dict(checked.dtypes)
    if wrong := [c for c, t in before.items() if after.get(c) != t]:
        raise ValueError(f"columns that are missing or of another type: {wrong}")
    kept = old.join(scope, old.session_id == scope.scope_id, "left_anti")
    return checked.unionByName(kept, allowMissingColumns=True)


@dataclass(frozen=True)
class Commit:
    """What a collection consists of: for each bucket of sessions the folder of its rows, and the folders of its log."""

    version: int = -1
    mark: int = -1  # generation or batch of the last writer
    buckets: int = BUCKETS
    schema: str | None = None  # of the rows, as JSON
    rows: dict[int, str] = field(default_factory=dict)
    log: dict[int, list[str]] = field(default_factory=dict)

    def file(self, root: str) -> str:
        return f"{root}/commits/{self.version:020d}.json"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _listed(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder; none if it isn't there."""
    fs, p = _fs(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def last_commit(spark: SparkSession, root: str) -> Commit:
    """The newest commit of a collection; an empty one, of version -1, if there is none."""
    names = [n for n in _listed(spark, f"{root}/commits") if n.endswith(".json")]
    if not names:
        return Commit()
    fs, p = _fs(spark, f"{root}/commits/{names[-1]}")
    stream = fs.open(p)
    try:
        got = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Commit(**got | {k: {int(b): v for b, v in got[k].items()} for k in ("rows", "log")})


def commit(spark: SparkSession, root: str, new: Commit) -> None:
    """Makes a commit the newest in one step: its file is written aside and renamed. An error where another writer has taken its
    version."""
    fs, p = _fs(spark, new.file(root))
    if fs.exists(p):
        raise RuntimeError(f"another writer has committed version {new.version}")
    _, aside = _fs(spark, f"{root}/commits/.{uuid.uuid4().hex}")
    stream = fs.create(aside, False)
    try:
        stream.write(bytearray(json.dumps(asdict(new)).encode()))
    finally:
        stream.close()
    if not fs.rename(aside, p):
        raise RuntimeError(f"another writer has committed version {new.version}")


def write_buckets(rows: DataFrame, folder: str, buckets: int) -> dict[int, str]:
    """Writes rows to a new folder by bucket of session, and gives the folder of each bucket that has rows. Large buckets are
    split among tasks, small ones put together."""
    spark = rows.sparkSession
    rows.withColumn("session_bucket", bucket(buckets)).hint("rebalance", "session_bucket").write.partitionBy("session_bucket").parquet(folder)
    return {int(name.split("=")[1]): f"{folder}/{name}" for name in _listed(spark, folder) if name.startswith("session_bucket=")}


def read_buckets(spark: SparkSession, schema: str | None, folders: list[str]) -> DataFrame | None:
    """The rows of some folders, under one schema: columns that older files lack are null."""
    if schema is None:
        return None
    kind = StructType.fromJson(json.loads(schema))
    return spark.read.schema(kind).parquet(*folders) if folders else spark.createDataFrame([], kind)


def read_collection(spark: SparkSession, root: str) -> DataFrame | None:
    """The rows of the newest commit; None before the first."""
    now = last_commit(spark, root)
    return read_buckets(spark, now.schema, list(now.rows.values()))


def replaced(spark: SparkSession, root: str, now: Commit, new: DataFrame, sessions: DataFrame) -> Commit:
    """The next commit (not yet made): the rows of the given sessions replaced. Only the buckets of these sessions are read and
    written anew; the others' folders are taken over as they are."""
    touched = {r[0] for r in sessions.select(bucket(now.buckets)).distinct().collect()}  # of a fixed number of buckets
    old = read_buckets(spark, now.schema, [f for b, f in now.rows.items() if b in touched])
    rows = replace_sessions(old, new, sessions)
    made = write_buckets(rows, f"{root}/data/{uuid.uuid4().hex}", now.buckets)
    return replace(now, version=now.version + 1, schema=rows.schema.json(), rows={b: f for b, f in now.rows.items() if b not in touched} | made)


def publish(spark: SparkSession, new: DataFrame, root: str, sessions: DataFrame, generation: int, buckets: int = BUCKETS) -> None:
    """Replaces the given sessions' rows in a collection under a new generation, in one step; what another reader has open
    stays. A generation that isn't newer than the current one is refused. The number of buckets is that of the first writer."""
    now = last_commit(spark, root)
    if generation <= now.mark:
        raise ValueError(f"generation {generation} is not newer than {now.mark}")
    commit(spark, root, replace(replaced(spark, root, now if now.version >= 0 else replace(now, buckets=buckets), new, sessions), mark=generation))


def current_generation(spark: SparkSession, root: str) -> int:
    return last_commit(spark, root).mark


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Deletes what neither of the newest commits names: commits before them, folders of replaced buckets and of writers that died.
    Not to run beside a writer. Gives what was deleted."""
    names = [n for n in _listed(spark, f"{root}/commits") if n.endswith(".json")]
    used: set[str] = set()
    for name in names[-keep:]:
        fs, p = _fs(spark, f"{root}/commits/{name}")
        stream = fs.open(p)
        got = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
        used |= {f.rsplit("/", 1)[0] for f in [*got["rows"].values(), *[f for fs_ in got["log"].values() for f in fs_]]}
    gone = [f"{root}/commits/{n}" for n in names[:-keep]] + [f"{root}/{top}/{n}" for top in ("data", "log") for n in _listed(spark, f"{root}/{top}") if f"{root}/{top}/{n}" not in used]
    for path in gone:
        fs, p = _fs(spark, path)
        fs.delete(p, True)
    return gone


def reset_sessions(table: DataFrame, sessions: DataFrame) -> DataFrame:
    """The table without the given sessions."""
    return table.join(sessions.select("session_id").distinct(), "session_id", "left_anti")


def bump_generations(generations: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, generation) with one more for each reset session, from 0 for unknown ones: writers of an older
    generation are to stop."""
    reset = sessions.select("session_id").distinct().withColumn("is_reset", F.lit(1))
    return generations.join(reset, "session_id", "full_outer").select("session_id", (F.coalesce("generation", F.lit(0)) + F.coalesce("is_reset", F.lit(0))).cast("long").alias("generation"))


def headers(sessions: DataFrame) -> DataFrame:
    """Pointers to the sources: index id, session, path; no events."""
    return sessions.select(F.concat(F.lit("idx-"), F.substring(F.sha2("session_id", 256), 1, 32)).alias("index_id"), "session_id", "source_path", "updated_at")


def export_linked(events: DataFrame, keep_from: int = 0) -> DataFrame:
    """Events as entries that each point at the previous one of their session: messages, calls and results as messages,
    compactions with their summary, the first entry kept after them and the tokens before; others as custom entries; reasoning
    without a summary is dropped."""
    kept = events.where((F.col("type") != "reasoning") | (T.text_of(F.col("text")) != ""))
    w = Window.partitionBy("session_id").orderBy("ordinal")
    id_ = F.substring(F.sha2(F.concat_ws("|", "session_id", F.col("ordinal").cast("string")), 256), 1, 8)
    rows = kept.withColumn("entry_id", id_)
    kind = F.when(F.col("type").isin("message", "tool_call", "tool_result", "reasoning"), "message").when(F.col("type") == "compaction", "compaction").otherwise("custom")
    before = F.sum(T.estimate_tokens(F.col("text"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.select(
        "session_id", "ordinal", "entry_id", F.lag("entry_id").over(w).alias("parent_id"), kind.alias("entry_type"), "role", "text",
        F.when(kind == "compaction", F.lead("entry_id").over(w)).alias("first_kept_id"), F.when(kind == "compaction", F.coalesce(before, F.lit(0))).alias("tokens_before"),
    )


def export_after_compaction(events: DataFrame) -> DataFrame:
    """Chat messages of each session from its last compaction on: section 0 the summary (or a note that there is none), section 1
    what came after."""
    by = Window.partitionBy("session_id")
    last = F.max(F.when(F.col("type") == "compaction", F.col("ordinal"))).over(by)
    rows = events.withColumn("last", last)
    head = rows.where("ordinal = last").select("session_id", F.lit(0).alias("section"), "ordinal", F.lit("system").alias("role"), F.coalesce(F.nullif("text", F.lit("")), F.lit("[no summary]")).alias("text"))
    rest = rows.where((F.col("ordinal") > F.col("last")) & F.col("type").isin("message", "tool_call", "tool_result")).select("session_id", F.lit(1).alias("section"), "ordinal", "role", "text")
    return head.unionByName(rest)
