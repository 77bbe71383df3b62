"""Mixing sources to target weights by Pfair scheduling.

Time is cut into slots, a slot serves one block of one source, and a source of weight w has served less than one block
more or less than w * t at any slot t. Block i of a source may run from slot floor(i / w) on (release) and must have
run by slot ceil((i + 1) / w) (deadline); each slot goes to the released block with the earliest deadline, ties by the
Pfair rules for successor blocks. Weights are exact fractions, so the schedule repeats after their common denominator:
one such period is laid out once, and block i of a source then has its slot by arithmetic, on any number of machines.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import floor, lcm

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scale import number_within, row_keys, written

#: Tempered weights are whole multiples of 1 / SLOTS; the longest period that is laid out.
SLOTS, MOST_SLOTS = 1 << 16, 1 << 20
#: Sources with a tempered weight of their own, at most; the smaller ones share one.
MOST_SOURCES = 4_096
#: Documents of a block.
BLOCK_DOCS = 16
#: What sources without a weight of their own share one under.
REST = "*"
#: Slots whose sizes are summed up at a time.
STRETCH = 4_096


def whole_parts(shares: dict[str, Fraction], slots: int) -> dict[str, int]:
    """Shares of 1 as whole parts of so many slots, at least one each, by largest remainder; ties by name."""
    if len(shares) > slots:
        raise ValueError("more sources than slots")
    parts = {k: max(1, floor(slots * w)) for k, w in shares.items()}
    by_remainder = sorted(shares, key=lambda k: (floor(slots * shares[k]) - slots * shares[k], k))
    for k in by_remainder[: max(0, slots - sum(parts.values()))]:
        parts[k] += 1
    for _ in range(sum(parts.values()) - slots):  # what the smallest sources got beyond their shares
        parts[max(parts, key=lambda k: (parts[k], k))] -= 1
    return parts


def exact_parts(weights: dict[str, float | Fraction], most: int = MOST_SLOTS) -> tuple[dict[str, int], int]:
    """Parts and the period they are parts of: exactly the weights, as fractions of their sum, if the fractions' common
    denominator is at most `most`; otherwise the nearest whole parts of `most` slots, which stray from the weights by less than
    half a block in a period. A float counts as the nearest fraction with a denominator of at most `most`."""
    if not weights or any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    exact = {k: Fraction(w).limit_denominator(most) if isinstance(w, float) else Fraction(w) for k, w in weights.items()}
    exact = {k: w or Fraction(1, most) for k, w in exact.items()}
    total = sum(exact.values())
    shares = {k: w / total for k, w in exact.items()}
    period = lcm(*(w.denominator for w in shares.values()))
    if period <= most:
        return {k: int(w * period) for k, w in shares.items()}, period
    return whole_parts(shares, most), most


def lay_out(parts: dict[str, int], period: int) -> list[str]:
    """The source of each slot of a period: earliest deadline first among released blocks.

    Ties go to the block whose window overlaps its successor's, then to the heavier source, then by name.
    """
    names = sorted(parts)
    waiting = [(0, k) for k in names]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, str]] = []
    served = dict.fromkeys(names, 0)
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            k = heapq.heappop(waiting)[1]
            done = (served[k] + 1) * period
            deadline = -(-done // parts[k])
            heapq.heappush(ready, (deadline, 0 if done % parts[k] else 1, -parts[k], k))
        k = heapq.heappop(ready)[3]
        out.append(k)
        served[k] += 1
        if served[k] < parts[k]:
            heapq.heappush(waiting, (served[k] * period // parts[k], k))
    return out


def tempered_weights(docs: DataFrame, power: float = 0.5, slots: int = SLOTS, most: int = MOST_SOURCES) -> dict[str, Fraction]:
    """Target weights from the sources' numbers of documents, to a power below 1 so that small sources count for more, as
    whole multiples of 1 / slots.

    The `most` largest sources have weights of their own; the others share REST, weighted by all their documents. A null source counts as a
    source named by the empty text.
    """
    counts = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    if not total:
        return {}
    large = {r.source: r.n for r in counts.orderBy(F.desc("n"), "source").limit(most).collect()}
    rest = total - sum(large.values())
    tempered = {k: (n / total) ** power for k, n in large.items()} | ({REST: (rest / total) ** power} if rest else {})
    whole = sum(tempered[k] for k in sorted(tempered))
    return {k: Fraction(n, slots) for k, n in whole_parts({k: Fraction(w / whole) for k, w in tempered.items()}, slots).items()}


def mix(docs: DataFrame, weights: dict[str, float | Fraction], block_docs: int = BLOCK_DOCS) -> DataFrame:
    """All columns of the documents, and mix_source, block (of its source, from 0), slot, nth (of its source, from 0).

    Every row keeps a place: when a source has no blocks left, its slots are passed over and the others go on in the
    same order. Sources that `weights` doesn't name, null ones included, share the weight REST; where that isn't named, it is
    the least weight, and counts only if there are such rows. Within a source, documents come by a hash of their id; repeated rows are placed each. An empty table gives
    an empty result. Columns named mix_source, block, slot or nth are replaced.
    """
    spark = docs.sparkSession
    own = dict(weights)
    docs = docs.drop("mix_source", "block", "slot", "nth")
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.struct("*").alias("whole_row"))
    if REST not in own:
        named = F.broadcast(spark.createDataFrame([(k,) for k in own], "named string"))
        if not own or not rows.join(named, F.col("source") == F.col("named"), "left_anti").limit(1).isEmpty():
            own[REST] = min(own.values(), default=Fraction(1))
    parts, period = exact_parts(own)
    names = sorted(parts)
    number = {k: i for i, k in enumerate(names)}
    order = [number[k] for k in lay_out(parts, period)]
    turn, taken = [], [0] * len(names)
    for i in order:
        turn.append(taken[i])
        taken[i] += 1
    plan = spark.createDataFrame(pa.table({"plan_source": pa.array(order, pa.int32()), "turn": pa.array(turn, pa.int32()), "at": pa.array(range(period), pa.int32())}))
    shares = F.broadcast(spark.createDataFrame([(k, number[k], parts[k]) for k in names], "name string, number int, parts int"))
    rest = (number.get(REST), parts.get(REST))
    of = rows.join(shares, F.col("source") == F.col("name"), "left").select(
        "doc_id", "whole_row", F.coalesce("name", F.lit(REST)).alias("mix_source"), F.coalesce("number", F.lit(rest[0])).alias("number"), F.coalesce("parts", F.lit(rest[1])).alias("parts")
    )
    blocks = number_within(of, ["number"], ["doc_id"], "nth").withColumn("block", F.floor(F.col("nth") / block_docs))
    placed = blocks.join(F.broadcast(plan), (F.col("number") == F.col("plan_source")) & (F.col("block") % F.col("parts") == F.col("turn")))  # at most MOST_SLOTS rows
    return placed.select("whole_row.*", "mix_source", "block", (F.floor(F.col("block") / F.col("parts")) * period + F.col("at")).alias("slot"), "nth")


def numbered(placed: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Adds position, the gapless place over all slots: a slot's rows come after those of all slots before. nth goes."""
    sizes = placed.groupBy("slot").agg(F.count("*").alias("size"))
    stretch = F.floor(F.col("slot") / STRETCH)
    by_stretch = sizes.groupBy(stretch.alias("stretch")).agg(F.sum("size").alias("size"))
    far = F.floor(F.col("stretch") / STRETCH)
    by_far = by_stretch.groupBy(far.alias("far")).agg(F.sum("size").alias("size"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    far_shift = by_far.select("far", F.coalesce(F.sum("size").over(before(F.lit(0)).orderBy("far")), F.lit(0)).alias("far_shift"))
    stretch_shift = by_stretch.withColumn("far", far).withColumn("stretch_shift", F.coalesce(F.sum("size").over(before("far").orderBy("stretch")), F.lit(0))).join(far_shift, "far").select("stretch", (F.col("stretch_shift") + F.col("far_shift")).alias("stretch_shift"))
    shift = sizes.withColumn("stretch", stretch).withColumn("in_stretch", F.coalesce(F.sum("size").over(before("stretch").orderBy("slot")), F.lit(0))).join(stretch_shift, "stretch").select(F.col("slot").alias("of_slot"), (F.col("in_stretch") + F.col("stretch_shift")).alias("shift"))
    return placed.join(shift, placed.slot == shift.of_slot).withColumn("position", F.col("shift") + F.col("nth") % block_docs).drop("of_slot", "shift", "nth")


def schedule(docs: DataFrame, weights: dict[str, float | Fraction], block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Per document: doc_id, source, mix_source, block, slot, position (from 0, gapless), without its text; see mix()."""
    return numbered(written(mix(docs.select("doc_id", "source"), weights, block_docs)), block_docs)


def in_mix_order(docs: DataFrame, weights: dict[str, float | Fraction], block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The documents in the order of the mix, so that a reader of the written files meets the sources in their weights.

    All columns stay, whatever their names; null and empty texts, null sources and repeated rows keep a place each; an empty
    table gives an empty result.
    """
    docs, keys = row_keys(docs)
    placed = written(mix(docs.select("doc_id", "source", *keys), weights, block_docs).select(F.col("file_key").alias("of_file"), F.col("row_index").alias("of_row"), "slot", "nth"))
    rows = docs.select(F.struct("*").alias("whole_row"), *keys)  # texts move once to their places and once into order
    return rows.join(placed, (F.col("file_key") == F.col("of_file")) & (F.col("row_index") == F.col("of_row"))).orderBy("slot", "nth").select("whole_row.*")
