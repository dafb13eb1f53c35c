"""Exact global ``ntile``, running sums and medians without a one-task window (R5, R6).

A window with ``orderBy`` but no ``partitionBy`` pulls every row into one task. Here an ordering is

1. a range partitioning of the rows by its keys, sorted within the ranges and written to the shared
   folder with each row's range and place in it (``monotonically_increasing_id`` of the sorted rows
   holds both, so no window is needed);
2. a table of range offsets, one row per range: rows and sums of the ranges before;
3. a join of the two on the range.

Spark's own range partitioner finds the bounds and does the binary search, so planning takes equally
long for any number of ranges, and nothing about the ranges reaches the driver. Any bounds give
exact results; they only decide the balance. Tie-break columns make the keys unique, so a value
shared by a third of the rows is still spread over many ranges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelworks.functions.metrics import MONEY, money
from funnelworks.sources.sinks import materialize

_PLACE_BITS = 33   # monotonically_increasing_id: partition number above, row number below


@dataclass(frozen=True)
class SortKey:
    column: str
    ascending: bool = True   # ascending sorts NULLs first, descending NULLs last (Spark default)


def _ordered(keys: list[SortKey]) -> list[Column]:
    return [F.col(k.column).asc_nulls_first() if k.ascending else F.col(k.column).desc_nulls_last()
            for k in keys]


def _ranges(df: DataFrame, ranges: int | None) -> int:
    return ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def stored_order(df: DataFrame, keys: list[SortKey], ranges: int | None = None) -> DataFrame:
    """``df`` written in ranges of ``keys``, with ``__range`` and ``__place`` (0-based place within the range)."""
    d = df.repartitionByRange(_ranges(df, ranges), *_ordered(keys)).sortWithinPartitions(*_ordered(keys))
    d = materialize(d.withColumn("__id", F.monotonically_increasing_id()), "ranges")
    return d.withColumn("__range", F.shiftright("__id", _PLACE_BITS)).withColumn(
        "__place", F.col("__id").bitwiseAND((1 << _PLACE_BITS) - 1)).drop("__id")


def _offsets(ordered: DataFrame, **sums: Column) -> DataFrame:
    """One row per range: ``__before`` rows in earlier ranges and ``__n`` in all, and the same of each sum."""
    per = ordered.groupBy("__range").agg(F.count(F.lit(1)).alias("__rows"), *[F.sum(c).alias(k) for k, c in sums.items()])
    # A window over one row per range.
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = [F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"), F.sum("__rows").over(whole).alias("__n")]
    for k in sums:
        out += [F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"{k}_before"), F.sum(k).over(whole).alias(f"{k}_all")]
    return per.select("__range", *out)


def global_positions(df: DataFrame, keys: list[SortKey], name: str, ranges: int | None = None) -> DataFrame:
    """Adds ``name``, the row's 0-based position under ``keys``, and ``name_n``, the number of rows."""
    ordered = stored_order(df, keys, ranges)
    return (ordered.join(_offsets(ordered), "__range")
            .withColumn(name, F.col("__before") + F.col("__place")).withColumn(f"{name}_n", F.col("__n"))
            .drop("__range", "__place", "__before", "__n"))


def tile_expr(i: Column, n: Column, k: int) -> Column:
    """``ntile(k)`` from 0-based position i of n rows (first n mod k tiles get one extra)."""
    q, r = F.floor(n / k), n % k
    big = r * (q + 1)
    # with fewer rows than tiles q is 0 and every row lies below big
    return F.when(i < big, F.floor(i / (q + 1)) + 1).otherwise(F.floor((i - big) / F.greatest(q, F.lit(1))) + r + 1).cast("long")


def global_ntile(df: DataFrame, specs: dict[str, list[SortKey]], k: int = 5, ranges: int | None = None) -> DataFrame:
    """Adds one ``ntile(k)`` column per entry of ``specs`` (name -> ordering); each ordering is one stored step."""
    for name, keys in specs.items():
        pos = f"__{name}_pos"
        df = global_positions(df, keys, pos, ranges)
        df = df.withColumn(name, tile_expr(F.col(pos), F.col(f"{pos}_n"), k)).drop(pos, f"{pos}_n")
    return df


def running_sum(df: DataFrame, keys: list[SortKey], value: str, out: str, ranges: int | None = None) -> DataFrame:
    """Adds ``out`` (running sum of the money column ``value`` under ``keys``),
    ``out_total`` (grand total), ``out_pos`` (0-based position), ``out_n`` (rows).

    Sums are exact decimals, so the result does not depend on how rows were split into ranges.
    """
    ordered = stored_order(df, keys, ranges).withColumn("__m", money(value))
    d = ordered.join(_offsets(ordered, __s=F.col("__m")), "__range")
    w = Window.partitionBy("__range").orderBy("__place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = F.coalesce(F.sum("__m").over(w), F.lit(0)).cast(MONEY) + F.col("__s_before").cast(MONEY)
    return (d.withColumn(f"{out}_pos", F.col("__before") + F.col("__place"))
            .withColumn(out, running.cast("double"))
            .withColumn(f"{out}_total", F.col("__s_all").cast("double"))
            .withColumn(f"{out}_n", F.col("__n"))
            .drop("__range", "__place", "__m", "__before", "__n", "__s_before", "__s_all"))


def grouped_median(df: DataFrame, group_cols: list[str], value: str, tiebreak: list[str],
                   out: str = "median", ranges: int | None = None) -> DataFrame:
    """Exact interpolated median of ``value`` per group (NULLs ignored).

    Rows get their global position under (group, value, tie-break); each group's first position and
    size come from a grouped count/min (combined map-side), which gives the positions of its one or
    two middle rows, and those are looked up by position. Positions are unique, so no group is ever
    gathered in one task, however large. The tie-break must make rows unique (e.g. the unit id).
    """
    d = df.where(F.col(value).isNotNull()).select(*group_cols, value, *tiebreak)
    keys = [SortKey(c) for c in group_cols] + [SortKey(value)] + [SortKey(c) for c in tiebreak]
    ranked = global_positions(d, keys, "__pos", ranges).select(*group_cols, value, "__pos")
    size = ranked.groupBy(*group_cols).agg(F.min("__pos").alias("__first"), F.count(F.lit(1)).alias("__n"))
    middle = size.select(*group_cols, F.explode(F.array_distinct(F.array(
        F.col("__first") + F.floor((F.col("__n") - 1) / 2), F.col("__first") + F.ceil((F.col("__n") - 1) / 2)))).alias("__pos"))
    found = middle.join(ranked.select("__pos", value), "__pos")
    return found.groupBy(*group_cols).agg(
        (F.min(value) + (F.max(value) - F.min(value)) * F.when(F.count(F.lit(1)) == 2, 0.5).otherwise(0.0)).alias(out))
