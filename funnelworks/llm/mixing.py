"""Mixing sources to target weights by hierarchical budgets.

The levels (domain, language, source) make a tree whose leaves hold documents. A token budget is
passed down: each node's budget goes to its children by weight, but no child gets more than its
subtree can give (its tokens times ``max_epochs``); what a child cannot use goes to its siblings by
weight, and only what all siblings together cannot use stays with the parent's siblings. A level is
one window over the siblings in order of capacity per weight: those up to the water level are
filled, the others share the rest in whole tokens. All arithmetic is in whole numbers.

A leaf's budget is a prefix of its seeded epochs: epoch e holds all its documents in the order of
``md5(seed:e:id)``. Full epochs take every document; of the last one the documents up to the budget
are taken, the last of them in part (``n_taken``). The place where a leaf's last epoch ends is found
without sorting a leaf in one task: documents are summed by leading hex digits of their key, as
many digits as the leaf is large, and only within such a bucket is there an order. The plan is a
row per leaf; documents are then kept or repeated by comparing with their leaf's row, so the texts
are not shuffled.

Null level values are the value '(none)'. Rows with equal id and equal number of tokens in a leaf
(repeated rows) are one document with copies, taken or left together. Null and empty texts have no
tokens; a leaf without tokens gives nothing. Ties of keys are broken by id (null first) and tokens.
Weights of 0 take nothing; missing ones are 1. An empty table gives an empty result. Only
DataFrame operations are used. Columns of the input stay unless they clash with the names of the
levels or with ``epoch``, ``n_tokens``, ``n_taken``; then the input's are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelworks.llm.common import aside, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a leaf that share a key bucket, about.
BUCKET_ROWS = 2_000
_D = "decimal(38,0)"


def word_tokens(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _key(seed: int, epoch: Column, id_col: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))


def _weight(level: str, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for value, w in weights.items():
        out = F.when(F.col(level) == value, F.lit(w)).otherwise(out)
    return out.cast(_D)


def share_out(nodes: DataFrame, parent: list[str], budget: str, weight: str, capacity: str, name: str, out: str) -> DataFrame:
    """Adds column ``out``: the ``budget`` of each parent dealt to its ``nodes`` by weight within capacity."""
    near = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = near.orderBy((F.col(capacity).cast("decimal(28,0)") / F.col(weight).cast("decimal(9,0)")), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # The weight from a node on: the total less what is before it, since a frame to the last row is gone through anew for each row.
    after = F.sum(weight).over(near) - F.coalesce(F.sum(weight).over(before), F.lit(0))
    d = nodes.withColumn("_room", F.col(budget).cast(_D) - F.coalesce(F.sum(F.col(capacity).cast(_D)).over(before), F.lit(0)))
    d = d.withColumn("_filled", F.col(capacity) * after.cast("decimal(12,0)") <= F.col(weight) * F.col("_room"))
    d = d.withColumn("_left", F.col(budget) - F.coalesce(F.sum(F.when(F.col("_filled"), F.col(capacity))).over(near), F.lit(0)))
    rest = F.when(~F.col("_filled"), F.col(weight))
    d = d.withColumn("_all", F.sum(rest).over(near)).withColumn("_upto", F.sum(rest).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn(out, F.when(F.col("_filled"), F.col(capacity).cast("long")).otherwise(F.expr(
        f"cast(cast(_upto as decimal(12,0)) * cast(_left as decimal(25,0)) div _all"
        f" - cast(_upto - {weight} as decimal(12,0)) * cast(_left as decimal(25,0)) div _all as long)")))
    return d.drop("_room", "_filled", "_left", "_all", "_upto")


def budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], total: int, max_epochs: int) -> DataFrame:
    """``leaves`` (levels..., avail) with their ``budget``; from the root down, one level at a time."""
    d = leaves.withColumn("capacity", F.col("avail") * max_epochs)
    for level in levels:
        d = d.withColumn(f"_w_{level}", _weight(level, weights.get(level, {})))
    d = d.where(" and ".join(f"_w_{x} > 0" for x in levels))
    held = None
    for k, level in enumerate(levels):
        path = levels[:k + 1]
        nodes = d.groupBy(*path).agg(F.sum("capacity").cast("long").alias("cap"), F.first(f"_w_{level}").alias("w"))
        nodes = nodes.withColumn("up", F.lit(total).cast("long")) if held is None else nodes.join(held, levels[:k])
        held = share_out(nodes, levels[:k], "up", "w", "cap", level, "given").select(*path, F.col("given").alias("up"))
    return d.join(held, levels).select(*levels, "avail", F.col("up").alias("budget"), "documents")


def plan(docs: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], fraction: tuple[int, int] = (1, 1),
         max_epochs: int = 4, seed: int = 0, id_col: str = "doc_id", tokens: str = "n_tokens") -> DataFrame:
    """A row per leaf with a budget: full epochs, tokens of the last one (rest), and where that ends.

    ``docs`` has the levels (without nulls), the id and the token count; the budget is ``fraction``
    (numerator, denominator) of all tokens.
    """
    units = stored(docs.groupBy(*levels, id_col, tokens).agg(F.count("*").alias("copies"))
                   .withColumn("size", F.col(tokens) * F.col("copies")), "mix-documents")
    leaves = stored(units.groupBy(*levels).agg(F.sum("size").alias("avail"), F.count("*").alias("documents")).where("avail > 0"), "mix-leaves")
    whole = leaves.agg(F.sum("avail")).first()[0] or 0
    dealt = budgets(leaves, levels, weights, whole * fraction[0] // fraction[1], max_epochs).where("budget > 0")
    dealt = stored(dealt.withColumn("full", F.expr("budget div avail")).withColumn("rest", F.expr("budget % avail"))
                   .withColumn("digits", F.ceil(F.log(16.0, F.greatest(F.lit(1.0), F.col("documents") / BUCKET_ROWS))).cast("int")), "mix-budgets")
    last = units.join(dealt.where("rest > 0").select(*levels, "full", "rest", "digits"), levels)
    last = last.withColumn("key", _key(seed, F.col("full"), id_col)).withColumn("bucket", F.expr("left(key, digits)"))
    sums = last.groupBy(*levels, "bucket").agg(F.sum("size").alias("sum"))
    starts = sums.withColumn("start", F.coalesce(F.sum("sum").over(
        Window.partitionBy(*levels).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # The one bucket of each leaf in which its budget ends.
    end = stored(starts.join(dealt.select(*levels, "rest"), levels).where("start < rest and start + sum >= rest").select(*levels, "bucket", "start"), "mix-ends")
    inside = last.join(end, [*levels, "bucket"])
    order = Window.partitionBy(*levels).orderBy("key", F.col(id_col).asc_nulls_first(), tokens).rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("begin", F.col("start") + F.coalesce(F.sum("size").over(order), F.lit(0))).where("begin < rest")
    at = F.max(F.struct("begin", "key", F.coalesce(F.col(id_col).cast("decimal(20,0)"), F.lit("-99999999999999999999").cast("decimal(20,0)")).alias("id"),
                        F.col(tokens).alias("tokens"), F.expr("ceil((rest - begin) / copies)").cast("long").alias("room")))
    cut = inside.groupBy(*levels).agg(at.alias("cut"))
    return stored(dealt.join(cut, levels, "left").select(*levels, "avail", "budget", "full", "rest", "cut"), "mix-plan")


def apply_plan(docs: DataFrame, leaves: DataFrame, levels: list[str], seed: int = 0, id_col: str = "doc_id", tokens: str = "n_tokens") -> DataFrame:
    """Each taken row of ``docs`` once per epoch in which it is taken, with ``epoch`` and ``n_taken``."""
    d = docs.join(leaves, levels)  # a row per leaf; AQE broadcasts it by its measured size
    d = d.withColumn("epoch", F.explode(F.expr("sequence(0L, IF(rest > 0, full, full - 1))")))
    mine = F.struct(F.when(F.col("epoch") == F.col("full"), _key(seed, F.col("epoch"), id_col)).alias("key"),
                    F.coalesce(F.col(id_col).cast("decimal(20,0)"), F.lit("-99999999999999999999").cast("decimal(20,0)")).alias("id"), F.col(tokens).alias("tokens"))
    d = d.withColumn("_mine", mine).withColumn("_cut", F.struct("cut.key", "cut.id", "cut.tokens"))
    d = d.where("epoch < full or _mine <= _cut")
    d = d.withColumn("n_taken", F.when((F.col("epoch") == F.col("full")) & (F.col("_mine") == F.col("_cut")),
                                       F.least(F.col(tokens), F.col("cut.room"))).otherwise(F.col(tokens)))
    return d.drop("_mine", "_cut", "avail", "budget", "full", "rest", "cut")


def levelled(docs: DataFrame, levels: dict[str, Column]) -> DataFrame:
    """``docs`` with each level as a column without nulls."""
    return docs.withColumns({k: F.coalesce(c.cast("string"), F.lit("(none)")) for k, c in levels.items()})


def mix(docs: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, int]], fraction: tuple[int, int] = (1, 1),
        max_epochs: int = 4, seed: int = 0, id_col: str = "doc_id") -> DataFrame:
    """Taken rows of ``docs`` (text and other columns included) with the levels, ``n_tokens``, ``epoch`` and ``n_taken``."""
    named = levelled(docs, levels).withColumn("n_tokens", word_tokens()).drop("epoch", "n_taken")
    plain = aside(named, id_col, "n_tokens", *levels)
    leaves = plan(plain.select(*levels, id_col, "n_tokens"), list(levels), weights, fraction, max_epochs, seed, id_col)
    taken = apply_plan(plain, leaves, list(levels), seed, id_col)
    return taken.select(*plain.columns, "epoch", "n_taken").toDF(*named.columns, "epoch", "n_taken")
