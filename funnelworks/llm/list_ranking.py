"""Ranks of a linked list's elements and running values over dense positions, without a task that sees all of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelworks.llm.common import stored

#: One element in so many is a ruler, by a hash of its id.
RULERS = 32
#: A list of at most this many elements is walked in one task.
WALK = 50_000
#: Rows of a span: what running values gather in one group.
SPAN = 4096


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, left) of a whole list in one task, from its end backwards."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    t = pa.Table.from_batches(rows)
    ids, nexts, steps = (t.column(c).to_numpy() for c in ("id", "next", "steps"))
    by = np.argsort(nexts)
    # For each element the row that points at it; the list ends at -1.
    point = by[np.minimum(np.searchsorted(nexts[by], ids), len(by) - 1)]
    pointed = nexts[point] == ids
    out = np.zeros(len(ids), dtype=np.int64)
    row, total = int(by[0]), 0
    for _ in range(len(ids)):
        total += int(steps[row])
        out[row] = total
        if not pointed[row]:
            break
        row = int(point[row])
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(out)], names=["id", "left"])


def rank(links: DataFrame, seed: int = 0) -> DataFrame:
    """(id, left) of every element of a list given as (id, next, steps), all long; ``left`` sums the steps to the end.

    ``next`` is -1 at the end. Rulers are chosen by a hash; all elements jump, twice as far in each
    round, until they stand before a ruler or the end, which takes as many rounds as the
    logarithm of the longest stretch without a ruler. The rulers make a shorter list of the same kind,
    whose ranks give the others'. Elements that still jump have different targets, and a ruler has few
    elements before it, so no key of a join is frequent. Each round is a stored table.
    """
    links = links.select("id", "next", "steps")
    if links.limit(WALK + 1).count() <= WALK:
        return links.repartition(1).mapInArrow(_walked, "id long, left long")

    def ruler(c: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.col(c)), F.lit(RULERS)) == 0

    now = stored(links.withColumn("still", (F.col("next") >= 0) & ~ruler("next")), "list-jumps")
    while now.where("still").limit(1).count():
        to = now.select(F.col("id").alias("next"), F.col("next").alias("beyond"), F.col("steps").alias("more"), F.col("still").alias("on"))
        jumped = now.where("still").select("id", "next", "steps").join(to, "next").select(
            "id", F.col("beyond").alias("next"), (F.col("steps") + F.col("more")).alias("steps"), F.col("on").alias("still"))
        now = stored(now.where("not still").unionByName(jumped), "list-jumps")
    shorter = stored(now.where(ruler("id")), "list-rulers")
    left = stored(rank(shorter, seed + 1), "list-ranks").select(F.col("id").alias("next"), F.col("left").alias("beyond"))
    return now.join(left, "next", "left").select("id", (F.col("steps") + F.coalesce("beyond", F.lit(0))).alias("left"))


def running(rows: DataFrame, at: str, values: dict[str, str], key: list[str] | None = None) -> DataFrame:
    """``rows`` (stored, read twice) with ``<name>_run`` for each of ``values`` (name: "sum" or "xor"): its running
    value, the row's own included, over the positions ``at`` (dense, from 0) of the rows of one ``key``.

    Running values are taken in spans of SPAN positions; the spans' totals are run over in the same way, so
    neither a long list nor a frequent key is gathered in one task.
    """
    key = key or []
    total = {"sum": F.sum, "xor": F.bit_xor}
    add = {"sum": lambda a, b: a + b, "xor": lambda a, b: a.bitwiseXOR(b)}
    less = {"sum": lambda a, b: a - b, "xor": lambda a, b: a.bitwiseXOR(b)}
    rows = rows.withColumn("_span", F.floor(F.col(at) / SPAN))
    upto = Window.partitionBy(*key, "_span").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.select("*", *[total[how](c).over(upto).alias(f"{c}_run") for c, how in values.items()])
    if not rows.where("_span > 0").limit(1).count():
        return out.drop("_span")
    spans = stored(rows.groupBy(*key, "_span").agg(*[total[how](c).alias(c) for c, how in values.items()]).withColumnRenamed("_span", "_n"), "list-spans")
    carry = running(spans, "_n", values, key).select(*key, F.col("_n").alias("_span"), *[less[how](F.col(f"{c}_run"), F.col(c)).alias(f"{c}_before") for c, how in values.items()])
    out = out.join(carry, [*key, "_span"])
    done = [add[how](F.col(f"{c}_run"), F.col(f"{c}_before")).alias(f"{c}_run") for c, how in values.items()]
    return out.select(*[c for c in rows.columns if c != "_span"], *done)


def spread(intervals: DataFrame, first: str, last: str) -> DataFrame:
    """``intervals`` once for each span that its positions ``first`` to ``last`` touch, as ``_span``: joined with rows
    on the span and a key, an interval with very many rows is dealt out over as many keys."""
    at = F.sequence(F.floor(F.col(first) / SPAN), F.floor(F.col(last) / SPAN))
    return intervals.withColumn("_span", F.explode(at))


def span(at: str) -> Column:
    return F.floor(F.col(at) / SPAN)
