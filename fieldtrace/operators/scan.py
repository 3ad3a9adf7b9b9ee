"""Prefix computations over ordered rows that no single task needs to hold: segmented scans.

The rows of a key (a file's lines, a clock's anchors) are cut into blocks of a bounded stretch of their order.  Each block
is scanned by itself, a summary row per block is carried over the blocks before it, and the carried value is applied to
the block's rows.  Windows are partitioned by key and block, so a file of any share of all rows spreads over as many tasks
as it has blocks; only summaries, one row a block, meet per key.  Lines are shuffled once, on key and block: summaries
and carried values are joined on the same columns.

Orders need not be dense.  Rows that share a place in the order are told apart by further order columns.  Keys and orders
are not null: rows without them are in no file and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines of a block: a task's sort stays in memory, and a file of four thousand million lines has 65,536 summaries.
BLOCK = 65_536


def block_of(order: Column, size: float = BLOCK) -> Column:
    return F.floor(order / size).cast("long")


def _blocks(keys: list[str], backward: bool = False) -> Window:
    """Blocks before each one, or after it."""
    return Window.partitionBy(*keys).orderBy(F.desc("_block") if backward else F.asc("_block")).rowsBetween(Window.unboundedPreceding, -1)


def seen(rows: DataFrame, values: dict[str, tuple[Column, bool, bool]], by: list[str], order: list[str], size: float = BLOCK) -> DataFrame:
    """`rows` with, for each name, the last value that is not null up to each row.

    A value comes with whether the row itself counts, and whether to look from the other end.  The first order column is
    numeric and deals the blocks.
    """
    marked = rows.withColumn("_block", block_of(F.col(order[0]), size)).withColumns({f"_value_{k}": v for k, (v, _, _) in values.items()})
    ends = []
    for k, (_, _, backward) in values.items():
        place = F.when(F.col(f"_value_{k}").isNotNull(), F.struct(*order))
        ends.append((F.min_by if backward else F.max_by)(f"_value_{k}", place).alias(f"_end_{k}"))
    carried = marked.groupBy(*by, "_block").agg(*ends)
    carried = carried.select(*by, "_block", *(F.last(f"_end_{k}", ignorenulls=True).over(_blocks(by, backward)).alias(f"_carried_{k}") for k, (_, _, backward) in values.items()))
    for k, (_, inclusive, backward) in values.items():
        here = Window.partitionBy(*by, "_block").orderBy(*(F.desc(c) if backward else F.asc(c) for c in order))
        marked = marked.withColumn(f"_within_{k}", F.last(f"_value_{k}", ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)))
    both = marked.join(carried, [*by, "_block"])
    return both.select(*rows.columns, *(F.coalesce(f"_within_{k}", f"_carried_{k}").alias(k) for k in values))


def last_seen(rows: DataFrame, value: Column, out: str, by: list[str], order: list[str], size: float = BLOCK, inclusive: bool = True) -> DataFrame:
    """`rows` with `out`: the last value that is not null up to each row, or before it."""
    return seen(rows, {out: (value, inclusive, False)}, by, order, size)


def running_sum(rows: DataFrame, value: Column, out: str, by: list[str], order: list[str], size: float = BLOCK) -> DataFrame:
    """`rows` with `out`: the sum of the values (long) of all rows up to each one."""
    marked = rows.withColumn("_block", block_of(F.col(order[0]), size)).withColumn("_value", value.cast("long"))
    here = Window.partitionBy(*by, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = marked.groupBy(*by, "_block").agg(F.sum("_value").alias("_sum"))
    carried = sums.withColumn("_carried", F.coalesce(F.sum("_sum").over(_blocks(by)), F.lit(0).cast("long"))).drop("_sum")
    both = marked.withColumn("_within", F.sum("_value").over(here)).join(carried, [*by, "_block"])
    return both.withColumn(out, F.col("_within") + F.col("_carried")).select(*rows.columns, out)


def resets(rows: DataFrame, tick: str, out: str, by: list[str], order: str, size: float = BLOCK) -> DataFrame:
    """`rows` with `out`: how often, up to each row, a tick fell below the last tick before it; rows without a tick count none.

    A block's summary is its first and last tick and the falls within it.  Whether its first tick falls below the carried
    last one is known once the blocks are in a row; that fall counts from the row of the first tick on.
    """
    marked = rows.withColumn("_block", block_of(F.col(order), size))
    here = Window.partitionBy(*by, "_block").orderBy(order)
    before = F.last(tick, ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, -1))
    marked = marked.withColumn("_fell", F.when(F.col(tick) < before, 1).otherwise(0))
    at = F.when(F.col(tick).isNotNull(), F.col(order))
    ends = marked.groupBy(*by, "_block").agg(F.min_by(tick, at).alias("_first"), F.max_by(tick, at).alias("_last"), F.min(at).alias("_from"), F.sum("_fell").alias("_falls"))
    carried = ends.withColumn("_edge", F.when(F.col("_first") < F.last("_last", ignorenulls=True).over(_blocks(by)), 1).otherwise(0))
    carried = carried.withColumn("_carried", F.coalesce(F.sum(F.col("_falls") + F.col("_edge")).over(_blocks(by)), F.lit(0).cast("long")))
    within = F.sum("_fell").over(here.rowsBetween(Window.unboundedPreceding, 0))
    both = marked.withColumn("_within", within).join(carried.select(*by, "_block", "_from", "_edge", "_carried"), [*by, "_block"])
    edge = F.when(F.col(order) >= F.col("_from"), F.col("_edge")).otherwise(0)
    return both.withColumn(out, F.col("_carried") + F.col("_within") + edge).select(*rows.columns, out)


def first_rows(rows: DataFrame, most: int, by: list[str], order: str, size: float = BLOCK, prefer: Column | None = None, otherwise: str | None = None) -> DataFrame:
    """The first `most` rows of each key in order, counted over its blocks.

    With `prefer`, only rows for which it holds count, unless a key has none: then all do, and `otherwise` names the column
    that says so.
    """
    good = F.coalesce(prefer, F.lit(False)) if prefer is not None else F.lit(True)
    marked = rows.withColumn("_block", block_of(F.col(order), size)).withColumn("_good", good)
    sums = marked.groupBy(*by, "_block").agg(F.count(F.lit(1)).alias("_all"), F.count_if("_good").alias("_goods"))
    whole = Window.partitionBy(*by)
    totals = sums.withColumn("_none", F.sum("_goods").over(whole) == 0)
    kept = F.when(F.col("_none"), F.col("_all")).otherwise(F.col("_goods"))
    carried = totals.withColumn("_carried", F.coalesce(F.sum(kept).over(_blocks(by)), F.lit(0).cast("long"))).filter((F.col("_carried") < most) & (kept > 0))
    both = marked.join(carried.select(*by, "_block", "_none", "_carried"), [*by, "_block"]).filter(F.col("_good") | F.col("_none"))
    place = F.row_number().over(Window.partitionBy(*by, "_block").orderBy(order)) + F.col("_carried")
    out = both.withColumn("_place", place).filter(F.col("_place") <= most)
    return out.select(*rows.columns, *([F.col("_none").alias(otherwise)] if otherwise else []))


def within_ranges(rows: DataFrame, ranges: DataFrame, by: str, at: str, start: str, stop: str, size: float = BLOCK, how: str = "left") -> DataFrame:
    """Rows joined with the half-open range [start, stop) of their key that holds their place; further columns of `ranges` are added.

    Ranges of one key do not overlap.  Both sides are dealt by key and block: a range lies in the block of its start, and
    each block that has rows is given the one range that may reach into it from the blocks before.  However long ranges
    are, there are no more of these than blocks with rows.
    """
    more = [c for c in ranges.columns if c not in (by, start, stop)]
    own = ranges.select(F.col(by).alias("_key"), F.col(start).alias("_start"), F.col(stop).alias("_stop"), *more).filter("_stop > _start").withColumn("_at", block_of(F.col("_start"), size))
    placed = rows.withColumn("_block", block_of(F.col(at), size))
    latest = own.groupBy("_key", F.col("_at").alias("_block")).agg(F.max_by(F.struct("_start", "_stop", *more), "_start").alias("_end"))
    asked = placed.filter(F.col(by).isNotNull() & F.col("_block").isNotNull()).select(F.col(by).alias("_key"), "_block").distinct()
    blocks = asked.withColumn("_asked", F.lit(True)).unionByName(latest, allowMissingColumns=True)
    blocks = blocks.groupBy("_key", "_block").agg(F.max("_asked").alias("_asked"), F.first("_end", ignorenulls=True).alias("_end"))
    carried = blocks.withColumn("_carried", F.last("_end", ignorenulls=True).over(_blocks(["_key"]))).filter(F.col("_asked") & (F.col("_carried._stop") > F.col("_block") * size))
    own = own.unionByName(carried.select("_key", "_carried.*", F.col("_block").alias("_at")))
    held = (F.col(by) == F.col("_key")) & (F.col("_block") == F.col("_at")) & (F.col(at) >= F.col("_start")) & (F.col(at) < F.col("_stop"))
    return placed.join(own, held, how).drop("_key", "_start", "_stop", "_at", "_block")
