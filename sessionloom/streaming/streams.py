"""Streams over growing logs. Order is the log's own, within and across batches; watermarks bound state only."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import usage as U
from ..operators.markers import AUTOMATON, scan, size_of
from ..sources.sinks import BUCKETS, commit, exists, last_commit, read_buckets, read_collection, replaced, shared_folder, write_buckets


#: Characters of the markers that a stream is tested for, as each worker holds all.
MOST_MARKED = AUTOMATON
#: Folders of a bucket's log, beyond which a batch that touches the bucket puts them together.
MOST_LOGS = 16


def run_to_table(stream: DataFrame) -> DataFrame:
    """Runs a stream over what is there and gives its output as a table."""
    at = shared_folder(stream.sparkSession)
    stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out")


def as_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)


def coalesce_changes(stream: DataFrame, gap: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """One row per quiet period of each path (path, ts): first and last change and their number."""
    return stream.withWatermark("ts", late).groupBy("path", F.session_window("ts", gap)).agg(F.count("*").alias("changes")).select("path", F.col("session_window.start").alias("first_at"), F.col("session_window.end").alias("quiet_at"), "changes")


def stream_dedupe(stream: DataFrame, within: str = "1 hour") -> DataFrame:
    """The first of equal messages (session_id, role, text, ts) within the watermark."""
    keyed = stream.withColumn("text_key", F.sha2(F.coalesce("text", F.lit("")), 256)).withWatermark("ts", within)
    return keyed.dropDuplicatesWithinWatermark(["session_id", "role", "text_key"]).drop("text_key")


def stream_markers(stream: DataFrame, markers: DataFrame) -> DataFrame:
    """Each new line (path, line_no, raw) with a marker of a static list, in one pass over the line. The markers have MOST_MARKED characters
    at most; more are an error."""
    asked = markers.select("marker").where("marker is not null").distinct()
    if (size := size_of(asked)) > MOST_MARKED:
        raise ValueError(f"markers of {size} characters, more than {MOST_MARKED}")
    return scan(stream.select("path", "line_no", "raw"), asked).select("marker", "path", "line_no")


def stream_usage_delta(stream: DataFrame) -> DataFrame:
    """usage per row (key, seq, total_usage, last_usage), equal to usage_delta() on the whole table: the state of a key is its
    last total."""
    fields = list(U.FIELDS)
    flat = stream.select("key", "seq", F.col("total_usage").isNotNull().alias("has"), *[F.col(f"total_usage.{f}").alias(f) for f in fields], *[F.coalesce(F.col(f"last_usage.{f}"), F.lit(0)).alias(f"l_{f}") for f in fields])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = list(state.get) if state.exists else [0] * len(fields)
        pdf = pd.concat(list(batches)).sort_values("seq")
        out = []
        for row in pdf.itertuples(index=False):
            if not row.has:
                out.append([getattr(row, f"l_{f}") for f in fields])
                continue
            now = [int(getattr(row, f)) for f in fields]
            reset = any(a < b for a, b in zip(now, before, strict=True))
            out.append(now if reset else [a - b for a, b in zip(now, before, strict=True)])
            before = now
        state.update(tuple(before))
        yield pd.DataFrame(out, columns=fields).assign(seq=pdf["seq"].to_numpy(), key=key[0])[["key", "seq", *fields]]

    longs = ", ".join(f"{f} long" for f in fields)
    return flat.groupBy("key").applyInPandasWithState(step, f"key long, seq long, {longs}", longs, "append", GroupStateTimeout.NoTimeout)


def keyed(stream: DataFrame, key: str, processor: StatefulProcessor, output: str, timers: bool = False) -> DataFrame:
    """The stream's rows by key through a processor with state and, if asked for, timers of processing time. State lies in
    the store that such processors need, unless the session names one."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in stream.sparkSession.conf.get(name, ""):
        stream.sparkSession.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return stream.groupBy(key).transformWithStateInPandas(processor, output, "Append", "ProcessingTime" if timers else "None")


def in_order(batches: Iterator[pd.DataFrame], *columns: str) -> list[tuple]:
    """The rows of a key as tuples of Python values in the order of the first column. Keys are many and have few rows, for which frames
    cost more than the rows themselves."""
    rows = [r for b in batches for r in zip(*(b[c].tolist() for c in columns), strict=True)]
    rows.sort(key=lambda r: r[0])
    return rows


class ReplyAnchors(StatefulProcessor):
    """Of a session: whether turns have begun, whether one awaits its first user message, and the anchor."""

    REPLIES = ("message", "reasoning", "tool_call", "tool_result", "usage", "agent_event")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("turn", "in_turns boolean, awaiting boolean, anchor string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.state.get() or (False, False, "")
        (in_turns, awaiting, anchor), ordinals, out = before, [], []
        for ordinal, kind, role, message_id, turn_id in in_order(rows, "ordinal", "type", "role", "message_id", "turn_id"):
            if kind == "context" and turn_id:
                in_turns = awaiting = True
            ordinals.append(ordinal)
            if kind == "message" and role == "user":
                if awaiting or not in_turns:
                    anchor, awaiting = message_id, False
                out.append(None)
            else:
                out.append(anchor if anchor and kind in self.REPLIES and role != "user" else None)
        if (in_turns, awaiting, anchor) != tuple(before):
            self.state.update((in_turns, awaiting, anchor))
        yield pd.DataFrame({"session_id": key[0], "ordinal": ordinals, "in_reply_to": out})

    def close(self) -> None:
        pass


def stream_links(stream: DataFrame) -> DataFrame:
    """in_reply_to per row (session_id, ordinal, type, role, message_id, turn_id), equal to annotate_links() on the whole
    table, over any number of batches."""
    rows = stream.select("session_id", "ordinal", "type", "role", "message_id", F.coalesce("turn_id", F.lit("")).alias("turn_id"))
    return keyed(rows, "session_id", ReplyAnchors(), "session_id string, ordinal long, in_reply_to string")


class OpenGroup(StatefulProcessor):
    """Of a session: the number and cost of the group that is open, and the list of its rows."""

    def __init__(self, budget: int):
        self.budget = budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.group = handle.getValueState("group", "slot long, total long, stored boolean")
        self.held = handle.getListState("held", "ordinal long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        slot, total, stored = self.group.get() or (0, 0, False)
        new, out = [], []  # rows of earlier batches are read only when their group closes
        for ordinal, cost, is_boundary in in_order(rows, "ordinal", "cost", "is_boundary"):
            if (stored or new) and (is_boundary or total + cost > self.budget):
                if stored:
                    out += [(slot, o) for (o,) in self.held.get()]
                    self.held.clear()
                out += [(slot, o) for o in new]
                slot, total, stored, new = slot + 1, 0, False, []
            if not is_boundary:
                new.append(ordinal)
                total += cost
        if new:
            self.held.appendList([(o,) for o in new])
        self.group.update((slot, total, stored or bool(new)))
        if out:
            yield pd.DataFrame({"session_id": key[0], "slot": [g for g, _ in out], "ordinal": [o for _, o in out]})

    def close(self) -> None:
        pass


def stream_level_one(stream: DataFrame, budget: int) -> DataFrame:
    """Groups of rows (session_id, ordinal, cost, is_boundary), each given out once when it is closed: by the row that no longer
    fits, or by a boundary. What is open stays in the state."""
    rows = stream.select("session_id", "ordinal", "cost", "is_boundary")
    return keyed(rows, "session_id", OpenGroup(budget), "session_id string, slot long, ordinal long")


class MarkerWait(StatefulProcessor):
    """Of a marker: the first path that has it and its status; while it waits, a timer."""

    def __init__(self, timeout_ms: int | None):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("found", "path string, status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.exists()
        path, status = self.state.get() if known else ("", "waiting")
        before = status if known else None
        for p in sorted({p for b in rows for p in b["path"] if p}):
            status = "found" if path in ("", p) else "ambiguous"
            path = path or p
        self.state.update((path, status))
        if self.timeout_ms is not None:
            if status == "waiting" and not known:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
            elif status != "waiting" and before == "waiting":
                for at in list(self.handle.listTimers()):
                    self.handle.deleteTimer(at)
        if status != before:
            yield pd.DataFrame({"marker": [key[0]], "status": [status], "path": [path or None]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame({"marker": [key[0]], "status": ["timeout"], "path": [None]})

    def close(self) -> None:
        pass


def await_markers(hits: DataFrame, timeout_ms: int | None = 30 * 60 * 1000) -> DataFrame:
    """State changes of each marker from its hits (marker, path): found, or ambiguous once a second path has it; timeout if the
    time passes after the first row without a path. A row without a path starts the wait (waiting). None waits without end, for streams
    that themselves end."""
    return keyed(hits.select("marker", "path"), "marker", MarkerWait(timeout_ms), "marker string, status string, path string", timers=timeout_ms is not None)


def publish_batch(spark: SparkSession, root: str, build: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the batch's rows join the stored log, the documents of its sessions are built anew and
    replace the old ones. Log and documents lie in buckets of sessions; a batch reads and writes only those of its sessions, and takes
    effect by one commit at its end. A batch that died before that leaves folders that nothing names (see vacuum()) and is published when
    it comes again; one that the last commit or an earlier one holds is passed over.

    A session whose generation has been raised (see bump_generations(); a table at root/generations) since a row was read is left to
    its newer rows: rows may carry `generation`, and older ones than the session's are dropped, with a note of the sessions at
    root/deferred. The number of buckets is that of the first batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        now = last_commit(session, root)
        if batch_id <= now.mark or batch.isEmpty():
            return
        if now.version < 0:
            now = replace(now, buckets=buckets)
        if "generation" in batch.columns:
            if exists(session, f"{root}/generations"):
                newest = session.read.parquet(f"{root}/generations").select("session_id", F.col("generation").alias("now"))
                met = batch.join(newest, "session_id", "left").withColumn("old", F.coalesce(F.col("generation") < F.col("now"), F.lit(False)))
                met.where("old").select("session_id").distinct().write.mode("overwrite").parquet(f"{root}/deferred/batch={batch_id}")
                batch = met.where("not old").drop("old", "now")
            batch = batch.drop("generation")
        schema = batch.schema.json()
        fresh = write_buckets(batch, f"{root}/log/{uuid.uuid4().hex}", now.buckets)
        log = now.log | {b: [*now.log.get(b, []), f] for b, f in fresh.items()}
        many = [b for b in fresh if len(log[b]) > MOST_LOGS]
        if many:  # one folder in place of many
            merged = read_buckets(session, schema, [f for b in many for f in log[b]])
            log |= {b: [f] for b, f in write_buckets(merged, f"{root}/log/{uuid.uuid4().hex}", now.buckets).items()}
        touched = read_buckets(session, schema, list(fresh.values())).select("session_id").distinct()
        stored = read_buckets(session, schema, [f for b in fresh for f in log[b]])
        docs = build(stored.join(touched, "session_id", "left_semi"))
        commit(session, root, replace(replaced(session, root, now, docs, touched), mark=batch_id, log=log))

    return run


def latest_docs(spark: SparkSession, root: str) -> DataFrame | None:
    """The documents of the newest batch that was published whole."""
    return read_collection(spark, root)


def stream_index(stream: DataFrame, root: str, build: Callable[[DataFrame], DataFrame]) -> None:
    """Runs publish_batch() over what the stream has."""
    query = stream.writeStream.foreachBatch(publish_batch(stream.sparkSession, root, build)).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
