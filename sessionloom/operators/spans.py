"""Compaction spans, live tails, budgets and packing."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from itertools import accumulate, pairwise
from math import nan

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.sinks import written
from .ordered import in_ranges, next_value, reached, running_sums, same, tie_break

#: Rows of a key that are folded in one array; of larger keys no task holds all.
FOLD = 10_000
#: Digits that costs count to, and their type.
SCALE = 12
MONEY = f"decimal(38,{SCALE})"


def by_session() -> WindowSpec:
    return Window.partitionBy("session_id")


def in_order() -> WindowSpec:
    return by_session().orderBy("ordinal")


def compaction_spans(df: DataFrame, boundary: Column, visible: Column | None = None) -> DataFrame:
    """The visible events that a later boundary closes, with span (from 0, dense over spans that have events). Boundaries
    themselves and events after the last one belong to none."""
    marked = df.withColumn("is_boundary", F.coalesce(boundary, F.lit(False)))
    rows = marked.withColumn("closed", F.coalesce(F.sum(F.col("is_boundary").cast("int")).over(in_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("open_until", F.max(F.col("is_boundary")).over(in_order().rowsBetween(1, Window.unboundedFollowing)))
    kept = rows.where(F.col("open_until") & ~F.col("is_boundary") & (visible if visible is not None else F.lit(True)))
    return kept.withColumn("span", F.dense_rank().over(by_session().orderBy("closed")) - 1).drop("is_boundary", "closed", "open_until")


def live_tail(df: DataFrame, boundary: Column, source: Column) -> DataFrame:
    """The events fit for a summary after the last boundary of their session."""
    last = F.max(F.when(boundary, F.col("ordinal"))).over(by_session())
    return df.withColumn("last_boundary", F.coalesce(last, F.lit(-1))).where((F.col("ordinal") > F.col("last_boundary")) & source).drop("last_boundary")


def after_last_boundary(lines: DataFrame, boundary: Column, key: str = "path", line: str = "line_no") -> DataFrame:
    """The log lines after the last boundary line of their file; none where there is no boundary."""
    last = F.max(F.when(boundary, F.col(line))).over(Window.partitionBy(key))
    return lines.withColumn("last_boundary", last).where(F.col(line) > F.col("last_boundary"))


def budget_prefix(children: DataFrame, key: list[str], order: list[str], cost: Column, budget: Column) -> DataFrame:
    """Children in order while their summed cost stays within the budget; the first is always kept. Adds spent and, for
    each key, omitted (how many were left out)."""
    by = Window.partitionBy(*key)
    rows = children.withColumn("cost", cost).withColumn("spent", F.sum("cost").over(by.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(by.orderBy(*order)))
    kept = (F.col("nth") == 1) | (F.col("spent") <= budget)
    return rows.withColumn("kept", kept).withColumn("omitted", F.sum((~F.col("kept")).cast("long")).over(by)).where("kept").drop("kept", "nth")


def pack_greedy(df: DataFrame, key: list[str], order: str, cost: Column, budget: int, most: int | None = None) -> DataFrame:
    """Adds group (from 0): runs of rows in order whose summed cost stays within the budget; a larger row is alone. Adds
    cost (null and negative ones are 0).

    Rows of equal order stay apart, in an order that a hash gives; null keys are a key, null orders come first. Keys of up to FOLD rows
    are folded, a number per row; of larger ones each row's next group start is found in the order of the running sums, and
    the starts are marked by pointer doubling, so no task holds such a key. most: rows of the largest key, where that is known; else they are counted first.
    """
    columns = [c for c in df.columns if c not in ("cost", "group")]
    df = df.drop("group")
    rows = df.withColumn("cost", F.greatest(F.coalesce(cost.cast("long"), F.lit(0)), F.lit(0)).cast("long")).withColumn("tie", tie_break(df))
    if most is not None and most <= FOLD:
        return _folded_groups(rows, key, order, budget).select(*columns, "cost", "group")
    large = rows.groupBy(*[F.col(k).alias(f"of_{k}") for k in key]).agg(F.count("*").alias("many")).where(F.col("many") > FOLD)
    met = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in key] or [F.lit(True)]
    if large.isEmpty():
        return _folded_groups(rows, key, order, budget).select(*columns, "cost", "group")
    large = written(large)
    few = _folded_groups(rows.join(large, met, "left_anti"), key, order, budget)
    many = _doubled_groups(rows.join(large, met, "left_semi"), key, order, budget)
    return few.select(*columns, "cost", "group").unionByName(many.select(*columns, "cost", "group"))


def _folded_groups(rows: DataFrame, key: list[str], order: str, budget: int) -> DataFrame:
    """Groups by a fold over each key's costs, which keeps where groups begin."""
    by = Window.partitionBy(*key).orderBy(order, "tie")
    placed = rows.withColumn("nth", F.row_number().over(by) - 1)
    listed = placed.groupBy(*[F.col(k).alias(f"of_{k}") for k in key]).agg(F.array_sort(F.collect_list(F.struct("nth", "cost"))).alias("rows"))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.expr("cast(array() as array<int>)").alias("starts"))

    def step(acc: Column, r: Column) -> Column:
        fits = (F.size(acc.starts) > 0) & (acc["sum"] + r.cost <= budget)
        more = F.struct((acc["sum"] + r.cost).alias("sum"), acc.starts.alias("starts"))
        return F.when(fits, more).otherwise(F.struct(r.cost.alias("sum"), F.concat(acc.starts, F.array(r.nth)).alias("starts")))

    starts = listed.select(*[f"of_{k}" for k in key], F.explode(F.aggregate("rows", start, step, lambda acc: acc.starts)).alias("of_nth"))
    met = placed.join(starts, same([*key, "nth"], [*[f"of_{k}" for k in key], "of_nth"]), "left")
    return met.withColumn("group", F.count("of_nth").over(Window.partitionBy(*key).orderBy("nth")) - 1).drop("nth", "of_nth", *[f"of_{k}" for k in key])


def _doubled_groups(rows: DataFrame, key: list[str], order: str, budget: int) -> DataFrame:
    """Groups without a task that holds a key: a group that starts at a row ends before the first row whose running sum
    exceeds the sum before it by more than the budget. Both kinds of values are sorted together by ranges."""
    one = F.lit(1).cast("long")
    placed = written(running_sums(in_ranges(rows, key, [order, "tie"]), key, [order, "tie"], {"nth": one, "reach": F.col("cost")}))
    ends = placed.select(*key, F.col("nth").alias("at"), "reach", "cost")
    # a row's own reach sorts after the questions for what lies above that reach
    points = ends.select(*key, F.col("reach").alias("value"), F.lit(1).alias("kind"), "at")
    asked = ends.select(*key, (F.col("reach") - F.col("cost") + budget).alias("value"), F.lit(2).alias("kind"), "at")
    both = in_ranges(points.unionByName(asked), key, ["value", "kind", "at"])
    nexts = next_value(both, key, ["value", "kind", "at"], F.when(F.col("kind") == 1, F.col("at")), "to").where("kind = 2")
    pointers = nexts.select(*key, "at", F.when(F.col("to").isNotNull(), F.greatest("to", F.col("at") + 1)).alias("to"))
    starts = reached(pointers, placed.where("nth = 1").select(*key, F.col("nth").alias("at")), key)
    marks = starts.select(*[F.col(k).alias(f"of_{k}") for k in key], F.col("at").alias("of_at"))
    met = placed.join(marks, same([*key, "nth"], [*[f"of_{k}" for k in key], "of_at"]), "left").drop("range_no")
    grouped = running_sums(in_ranges(met.withColumn("begins", F.col("of_at").isNotNull().cast("long")).drop("of_at", *[f"of_{k}" for k in key]), key, ["nth"]), key, ["nth"], {"group": F.col("begins")})
    return grouped.withColumn("group", F.col("group") - 1)


def pack_pairs(df: DataFrame, key: list[str], budget: int, stretch: int = 2) -> DataFrame:
    """Adds group as pack_greedy() does, but keeps a call and its result together.

    Columns: ordinal, cost, tool_call_id, type. If the row that would start the next group is past a call whose result
    comes later, the group takes rows up to that result while it stays within stretch * budget; else it ends before the call, unless the
    call is its first row.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    def grouped(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        costs, kinds, ids = (table[c].to_pylist() for c in ("cost", "type", "tool_call_id"))
        starts = [*pc.indices_nonzero(pc.equal(table["nth"], 1)).to_pylist(), len(costs)]
        groups = [g for i, j in pairwise(starts) for g in _paired_groups(costs[i:j], kinds[i:j], ids[i:j], budget, stretch)]
        yield from table.drop_columns(["nth"]).append_column("group", pa.array(groups, pa.int64())).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []  # rows of a key that may go on in the next batch
        for batch in batches:
            starts = pc.indices_nonzero(pc.equal(batch["nth"], 1))
            if len(starts):
                cut = starts[-1].as_py()
                if cut or held:
                    yield from grouped([*held, batch.slice(0, cut)])
                held, batch = [], batch.slice(cut)
            held.append(batch)
        if held:
            yield from grouped(held)

    # a window leaves the rows of each key together and in order; a call of Python for each key would cost more than its fold
    by = Window.partitionBy(*key).orderBy(F.col("ordinal").asc_nulls_last())
    schema = StructType([*df.schema.fields, StructField("group", LongType())])
    return df.withColumn("nth", F.row_number().over(by)).mapInArrow(run, schema)


def _paired_groups(costs: list, kinds: list, ids: list, budget: int, stretch: int) -> list[int]:
    """The groups of one key's rows in order, for pack_pairs(). A null cost fits no group and nothing fits beside it."""
    costs = [nan if c is None else c for c in costs]
    call = {i: k for k, (t, i) in enumerate(zip(kinds, ids, strict=True)) if t == "tool_call" and isinstance(i, str)}
    last = [-1] * len(costs)  # of each call the place of its last result
    for k, (t, i) in enumerate(zip(kinds, ids, strict=True)):
        if t == "tool_result" and isinstance(i, str) and call.get(i, k) < k:
            last[call[i]] = k
    sums = list(accumulate(costs, initial=0)) if all(isinstance(c, int) for c in costs) else None
    between = lambda i, j: sum(costs[i:j]) if sums is None else sums[j] - sums[i]
    groups, a, g = [0] * len(costs), 0, 0
    while a < len(costs):
        b, total = a + 1, costs[a]
        while b < len(costs) and total + costs[b] <= budget:
            total += costs[b]
            b += 1
        reach, read = -1, a  # the last result of the calls up to b
        while (reach := max(reach, max(last[read:b]))) >= b:
            read = b
            if between(a, reach + 1) <= stretch * budget:
                b = reach + 1
                continue
            first = next(c for c in range(a, b) if last[c] >= b)
            b = first if first > a else b
            break
        groups[a:b] = [g] * (b - a)
        a, g = b, g + 1
    return groups


def select_within_budget(jobs: DataFrame, key: list[str], budget: float | None, limit: int | None = None, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Jobs in order that fit what is left of the budget of their key (no key: one budget for all); one that doesn't is passed over and
    later ones still may. The limit of jobs comes first. Adds selected, spent (after the row) and status (ok, budget_limited or
    over_budget). Costs (usd) count to SCALE digits, null and negative ones as 0; jobs of equal order come in that of a hash.

    Rounds of running sums over ranges of the order, for all keys at once. A round takes jobs of up to half of what is left up to the first
    that no longer fits, or up to the first larger job that does; either way less than half is left, and jobs that cost more than
    that are out. So rounds grow with the number of bits between the budget and the least cost, and each reads only what is open. Keys of up
    to FOLD open jobs are folded.
    """
    usd = F.greatest(F.coalesce("usd", F.lit(0)), F.lit(0)).cast(MONEY)
    by, of = [*order, "tie"], [f"of_{k}" for k in key]
    rows = in_ranges(jobs.withColumn("tie", tie_break(jobs)).withColumn("money", usd), key, by)
    rows = running_sums(rows, key, by, {"nth": F.lit(1).cast("long")})
    rows = written(rows if limit is None else rows.where(F.col("nth") <= limit))
    if budget is None:
        taken = rows.select(*key, "nth")
    else:
        taken = _admitted(rows.select(*key, "nth", "range_no", "money"), key, budget)
    taken = taken.select(*[F.col(k).alias(f"of_{k}") for k in key], F.col("nth").alias("of_nth"))
    met = rows.join(taken, same([*key, "nth"], [*of, "of_nth"]), "left").withColumn("selected", F.col("of_nth").isNotNull()).drop("of_nth", *of)
    spent = running_sums(met, key, ["nth"], {"spent": F.when(F.col("selected"), F.col("money")).otherwise(F.lit(0).cast(MONEY))})
    status = F.when(F.min("selected"), "ok").when(F.max("selected"), "budget_limited").otherwise("over_budget")
    each = met.groupBy(*[F.col(k).alias(f"of_{k}") for k in key]).agg(status.alias("status"))
    return spent.join(each, same(key, of)).select(*jobs.columns, "selected", F.col("spent").cast("double").alias("spent"), "status")


def _admitted(open_: DataFrame, key: list[str], budget: float) -> DataFrame:
    """(key, nth) of the jobs (key, nth, range_no, money; written) that select_within_budget() takes: keys of up to FOLD open jobs by
    a fold, larger ones round by round until they are no larger."""
    of = [f"of_{k}" for k in key]
    left = F.lit(str(round(Decimal(repr(budget)) + Decimal("1e-9"), SCALE))).cast(MONEY)
    state = open_.groupBy(*[F.col(k).alias(f"of_{k}") for k in key]).agg(F.first(left).alias("left"))
    taken = None
    while True:
        sizes = open_.groupBy(*[F.col(k).alias(f"of_{k}") for k in key]).agg(F.count("*").alias("many"))
        few = open_.join(sizes.where(F.col("many") <= FOLD).drop("many"), same(key, of), "left_semi").join(state, same(key, of)).drop(*of)
        folded = _folded_admission(few, key)
        taken = folded if taken is None else taken.unionByName(folded)
        large = written(sizes.where(F.col("many") > FOLD))
        if large.isEmpty():
            return taken
        fits = open_.join(large, same(key, of), "left_semi").join(state, same(key, of)).drop(*of).where(F.col("money") <= F.col("left"))
        small = F.col("money") * 2 <= F.col("left")
        summed = written(running_sums(written(fits), key, ["nth"], {"sum": F.when(small, F.col("money")).otherwise(F.lit(0).cast(MONEY))}))
        over, larger = small & (F.col("sum") > F.col("left")), ~small & (F.col("sum") + F.col("money") <= F.col("left"))
        stops = summed.where(over | larger).groupBy(*[F.col(k).alias(f"of_{k}") for k in key]).agg(F.min("nth").alias("stop"))
        met = summed.join(stops, same(key, of), "left").drop(*of)
        now = (small & (F.col("stop").isNull() | (F.col("nth") < F.col("stop")))) | (larger & (F.col("nth") == F.col("stop")))
        got = written(met.where(now).select(*key, "nth", "money"))
        taken = taken.unionByName(got.drop("money"))
        rest = met.where(F.col("nth") > F.col("stop")).select(*key, "nth", "range_no", "money")
        spent = got.groupBy(*[F.col(k).alias(f"by_{k}") for k in key]).agg(F.sum("money").alias("spent"))
        state = written(state.join(spent, same(of, [f"by_{k}" for k in key]), "left").select(*of, (F.col("left") - F.coalesce("spent", F.lit(0))).cast(MONEY).alias("left")))
        open_ = written(rest.join(state, same(key, of)).where(F.col("money") <= F.col("left")).select(*key, "nth", "range_no", "money"))


def _folded_admission(few: DataFrame, key: list[str]) -> DataFrame:
    """(key, nth) of the jobs (key, nth, money, left) that are taken, by a fold over each key's jobs."""
    listed = few.groupBy(*key).agg(F.first("left").alias("left"), F.array_sort(F.collect_list(F.struct("nth", "money"))).alias("rows"))
    start = F.struct(F.col("left"), F.expr("cast(array() as array<bigint>)").alias("taken"))

    def step(acc: Column, r: Column) -> Column:
        return F.when(r.money <= acc.left, F.struct((acc.left - r.money).cast(MONEY).alias("left"), F.concat(acc.taken, F.array(r.nth)).alias("taken"))).otherwise(acc)

    return listed.select(*key, F.explode(F.aggregate("rows", start, step, lambda acc: acc.taken)).alias("nth"))
