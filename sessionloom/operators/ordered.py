"""Running sums, the next row of some kind, and chains of pointers over orders of any length: rows are dealt to ranges of their
order, and only a total for each range meets in one place."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import written

#: Ranges of an order, unless the session has more shuffle partitions.
RANGES = 8


def same(left: list[str], right: list[str]) -> Column:
    """Null-safe equality of columns, pair by pair; true of none."""
    return reduce(and_, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)], F.lit(True))


def tie_break(df: DataFrame) -> Column:
    """A hash that orders rows which are equal otherwise; rows with equal hashes are alike in all that can be hashed."""
    return F.xxhash64(*[F.col(c) for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind])


def in_ranges(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The rows with range_no, written: ranges follow one another in the order of the keys, then of the given columns."""
    ranges = max(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return written(df.repartitionByRange(ranges, *keys, *order).withColumn("range_no", F.spark_partition_id()))


def _by_range(rows: DataFrame, keys: list[str], totals: list[Column]) -> DataFrame:
    """Columns of_<key>, of_range and the totals of each key's rows in each range."""
    return rows.groupBy(*[F.col(k).alias(f"of_{k}") for k in keys], F.col("range_no").alias("of_range")).agg(*totals)


def _met(rows: DataFrame, keys: list[str], per_range: DataFrame) -> DataFrame:
    return rows.join(per_range, same([*keys, "range_no"], [*[f"of_{k}" for k in keys], "of_range"])).drop(*[f"of_{k}" for k in keys], "of_range")


def running_sums(rows: DataFrame, keys: list[str], order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """Adds to rows of in_ranges() the sums of each key's rows up to and with the row; equal places take any order."""
    own = Window.partitionBy(*keys, "range_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*[f"of_{k}" for k in keys]).orderBy("of_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = _by_range(rows, keys, [F.sum(c).alias(f"of_{name}") for name, c in sums.items()])
    shifts = totals.select(*[f"of_{k}" for k in keys], "of_range", *[F.coalesce(F.sum(f"of_{name}").over(before), F.lit(0)).alias(f"shift_{name}") for name in sums])
    met = _met(rows.withColumns({name: F.sum(c).over(own) for name, c in sums.items()}), keys, shifts)
    return met.withColumns({name: F.col(name) + F.col(f"shift_{name}") for name in sums}).drop(*[f"shift_{name}" for name in sums])


def next_value(rows: DataFrame, keys: list[str], order: list[Column | str], value: Column, name: str) -> DataFrame:
    """Adds to rows of in_ranges() the value of the first later row of the key whose value is not null."""
    later = Window.partitionBy(*keys, "range_no").orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    after = Window.partitionBy(*[f"of_{k}" for k in keys]).orderBy("of_range").rowsBetween(1, Window.unboundedFollowing)
    place = F.row_number().over(Window.partitionBy(*keys, "range_no").orderBy(*order))
    placed = rows.withColumn(name, value).withColumn("place_in_range", place)
    firsts = _by_range(placed, keys, [F.min_by(name, F.when(F.col(name).isNotNull(), F.col("place_in_range"))).alias("of_first")])
    shifts = firsts.select(*[f"of_{k}" for k in keys], "of_range", F.first("of_first", ignorenulls=True).over(after).alias("of_next"))
    found = placed.withColumn(name, F.first(name, ignorenulls=True).over(later))
    return _met(found, keys, shifts).withColumn(name, F.coalesce(name, "of_next")).drop("of_next", "place_in_range")


def reached(pointers: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """The places (keys, at) that chains of pointers (keys, at, to; null ends a chain) from the given starts (keys, at) run
    through, by pointer doubling: as many rounds as the longest chain's length has bits."""
    marked, jump = written(starts), written(pointers.where("to is not null"))
    while True:
        of = [f"of_{k}" for k in keys]
        hop = jump.select(*[F.col(k).alias(f"of_{k}") for k in keys], F.col("at").alias("of_at"), F.col("to").alias("via"))
        more = marked.join(hop, same([*keys, "at"], [*of, "of_at"])).select(*keys, F.col("via").alias("at"))
        marked = written(marked.unionByName(more).distinct())
        jump = written(jump.join(hop, same([*keys, "to"], [*of, "of_at"])).select(*keys, "at", F.col("via").alias("to")))
        if jump.isEmpty():
            return marked
