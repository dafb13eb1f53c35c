"""Merkle manifest of a dataset: a hash tree per group, a tree over the groups' roots, a proof per row.

A row's leaf is the sha256 of its fields, each ``-`` if null, else its UTF-8 byte count, a colon and
its value. The leaves of a group stand in the given order; every two consecutive nodes become the
sha256 of their hex digests side by side, a last odd one that of its own, until one node remains.
The groups' roots, in the order of the groups (null first, then bytewise), form the top tree alike.

Method: concatenated levels. A group's leaves are cut into aligned blocks of 2**BLOCK_LEVELS. A block
keeps each level as one string of hex digests; a fixed-width substring of two digests is hashed to a
parent, and the substring that flanks a node is its sibling, so the siblings of a leaf in its block
are one segment of text. The blocks' roots are the leaves of the next round, until a group has a
single one; the roots of the groups go through the same rounds. A leaf's proof is the segments of
its rounds side by side. Only blocks are gathered, however large a group is; a leaf's place
comes from one global ordering (range partitions and their offsets), so a group with most of the
rows is spread over all tasks. Each round is a stored table in the shared folder.

Null fields are leaves like others, null groups are one group, null order keys come first. Rows with
equal order keys are ordered by leaf; repeated rows have equal leaves and take neighbouring places.
Long texts are hashed whole. An empty table gives an empty manifest. Other columns are not
read, and columns named like the results (``leaf``, ``root``...) do no harm, as only fields, group and order are taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelworks.llm.common import stored
from funnelworks.operators.global_rank import SortKey, global_positions

HEX = 64
#: Levels of a block: 64 leaves, 4 KB of digests at its lowest level.
BLOCK_LEVELS = 6
BLOCK = 1 << BLOCK_LEVELS


def leaf(fields: Sequence[Column]) -> Column:
    """sha256 (hex) of the fields, each ``-`` or byte count, colon, value; integers in decimal."""
    texts = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _upto(n: Column) -> Column:
    """The integers 0 to n - 1."""
    return F.filter(F.sequence(F.lit(0), n.cast("int")), lambda i: i < n)


def _levels(leaves: Column, height: Column) -> Column:
    """A block's levels, lowest first, each one string (as bytes, which are cut by offset) of digests."""
    def add(levels: Column, _: Column) -> Column:
        below = F.element_at(levels, -1)
        runs = _upto(F.ceil(F.octet_length(below) / F.lit(2 * HEX)))
        parents = F.transform(runs, lambda i: F.sha2(F.substring(below, i * (2 * HEX) + 1, F.lit(2 * HEX)), 256))
        return F.concat(levels, F.array(F.array_join(parents, "").cast("binary")))

    return F.aggregate(_upto(height), F.array(leaves.cast("binary")), add)


def _path(levels: Column, height: Column, place: Column) -> tuple[Column, Column]:
    """(sides, siblings) of the node at ``place``: per level l, r or . (none), and the flanking digests."""
    def sibling(j: Column) -> Column:
        at = F.call_function("shiftright", place, j).bitwiseXOR(F.lit(1))
        return F.substring(F.get(levels, j), at * HEX + 1, F.lit(HEX)).cast("string")

    def side(j: Column) -> Column:
        odd = F.call_function("shiftright", place, j).bitwiseAND(F.lit(1)) == 1
        return F.when(odd, "l").when((F.call_function("shiftright", place, j) + 1) * HEX < F.octet_length(F.get(levels, j)), "r").otherwise(".")

    js = _upto(height)
    return F.array_join(F.transform(js, side), ""), F.array_join(F.transform(js, sibling), "")


def _climb(nodes: DataFrame, keep: Sequence[str] = (), over_groups: bool = False) -> DataFrame:
    """Nodes (_g group, _at place in it, _n nodes in it, _hash) with _sides, _siblings and _top.

    _top is the root of the group, or with ``over_groups`` the root of all groups, which are
    ordered by _g; then _sub is the group's.
    """
    member = F.struct((F.col("_at") % BLOCK).cast("int").alias("place"), F.col("_hash").alias("hash"), *keep)
    blocks = nodes.groupBy("_g", F.floor(F.col("_at") / BLOCK).alias("_block"), "_n").agg(F.sort_array(F.collect_list(member)).alias("_members"))
    # Length of the binary number n - 1: the levels above n leaves; a block of a larger group has all of its levels.
    height = F.when(F.col("_n") == 1, 0).when(F.col("_n") > BLOCK, BLOCK_LEVELS).otherwise(F.length(F.bin(F.col("_n") - 1)))
    blocks = blocks.withColumn("_height", height)
    blocks = blocks.withColumn("_levels", _levels(F.array_join(F.transform("_members", lambda m: m["hash"]), ""), F.col("_height")))
    blocks = stored(blocks, "merkle-blocks")
    tops = blocks.select("_g", F.col("_block").alias("_at"), F.ceil(F.col("_n") / BLOCK).alias("_n"), F.element_at("_levels", -1).cast("string").alias("_hash"))
    above = tops.where("_n = 1").select("_g", "_at", F.lit("").alias("_sides"), F.lit("").alias("_siblings"), F.col("_hash").alias("_top"))
    if tops.where("_n > 1").limit(1).count():
        above = above.unionByName(_climb(tops.where("_n > 1")).select("_g", "_at", "_sides", "_siblings", "_top"))
    above = above.withColumn("_sub", F.col("_top"))
    if over_groups:
        subs = stored(above.groupBy("_g").agg(F.min("_top").alias("_hash")), "merkle-subroots")
        subs = global_positions(subs, [SortKey("_g")], "_at").select(F.lit(0).alias("_g"), "_at", F.col("_at_n").alias("_n"), "_hash", F.col("_g").alias("_group"))
        roots = _climb(subs, ["_group"]).select(F.col("_group").alias("_g"), F.col("_sides").alias("_s"), F.col("_siblings").alias("_b"), F.col("_top").alias("_root"))
        above = above.join(roots, "_g").select("_g", "_at", F.concat("_sides", "_s").alias("_sides"), F.concat("_siblings", "_b").alias("_siblings"),
                                               F.col("_root").alias("_top"), "_sub")
    above = above.select("_g", F.col("_at").alias("_block"), F.col("_sides").alias("_up"), F.col("_siblings").alias("_beside"), "_top", "_sub")
    each = blocks.drop("_n").join(above, ["_g", "_block"]).select("*", F.explode("_members").alias("_m"))
    sides, siblings = _path(F.col("_levels"), F.col("_height"), F.col("_m.place"))
    return each.select("_g", (F.col("_block") * BLOCK + F.col("_m.place")).alias("_at"), F.col("_m.hash").alias("_hash"),
                       F.concat(sides, "_up").alias("_sides"), F.concat(siblings, "_beside").alias("_siblings"), "_top", "_sub",
                       *[F.col(f"_m.{k}").alias(k) for k in keep])


def proofs(rows: DataFrame, group: str, order: str, keep: Sequence[str] = ()) -> DataFrame:
    """``rows`` (group, order, leaf, keep) with subroot, root, sides and siblings.

    ``sides`` has a character for each level up to the root: the sibling stands left (l), right (r)
    or there is none (.); ``siblings`` are the digests of the siblings in the same order.
    """
    rows = stored(rows.select(F.col(group).alias("_group"), F.col(order).alias("_order"), F.col("leaf").alias("_hash"), *keep), "merkle-leaves")
    placed = global_positions(rows, [SortKey("_group"), SortKey("_order"), SortKey("_hash")], "_pos")
    placed = placed.select("_group", "_order", "_hash", *keep, "_pos")
    groups = placed.groupBy("_group").agg(F.min("_pos").alias("_g"), F.count("*").alias("_n")).withColumnRenamed("_group", "_name")
    # A group is known by the place of its first row, which is in the order of the groups.
    nodes = placed.join(groups, F.col("_group").eqNullSafe(F.col("_name"))).withColumn("_at", F.col("_pos") - F.col("_g"))
    done = _climb(nodes, ["_group", "_order", *keep], over_groups=True)
    return done.select(F.col("_group").alias(group), F.col("_order").alias(order), F.col("_hash").alias("leaf"), F.col("_sub").alias("subroot"),
                       F.col("_top").alias("root"), F.col("_sides").alias("sides"), F.col("_siblings").alias("siblings"), *keep)


def folded(start: Column, sides: Column, siblings: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    digests = siblings.cast("binary")

    def step(acc: Column, i: Column) -> Column:
        side = F.substring(sides, i + 1, F.lit(1))
        beside = F.substring(digests, acc["at"], F.lit(HEX)).cast("string")
        node = F.when(side == "l", F.concat(beside, acc["node"])).when(side == "r", F.concat(acc["node"], beside)).otherwise(acc["node"])
        return F.struct(F.sha2(node, 256).alias("node"), (acc["at"] + F.when(side == ".", 0).otherwise(HEX)).alias("at"))

    return F.aggregate(_upto(F.length(sides)), F.struct(start.alias("node"), F.lit(1).alias("at")), step)["node"]


def manifest(docs: DataFrame, fields: Sequence[str], group: str, order: str) -> DataFrame:
    """(group, order, leaf, subroot, root, sides, siblings) of every row of ``docs``."""
    return proofs(docs.select(group, order, leaf([F.col(c) for c in fields]).alias("leaf")), group, order)


def write_manifest(docs: DataFrame, path: str, fields: Sequence[str], group: str, order: str) -> None:
    """Write ``path``/proofs, a row of ``manifest`` per row, and ``path``/subroots, a row per group."""
    spark = docs.sparkSession
    manifest(docs, fields, group, order).write.parquet(f"{path}/proofs")
    done = spark.read.parquet(f"{path}/proofs")
    done.groupBy(group, "subroot", "root").agg(F.count("*").alias("n_rows")).write.parquet(f"{path}/subroots")


def verify(docs: DataFrame, proofs: DataFrame, fields: Sequence[str], group: str, order: str) -> DataFrame:
    """(group, order, n_rows, n_proofs, n_verified): the rows and proofs of each order key in its group, and rows whose leaf folds to a root.

    A key is intact if the three counts are equal; a row that was added, changed, moved or lost shows as a difference.
    """
    now = docs.select(F.col(group).alias("_g"), F.col(order).alias("_o"), leaf([F.col(c) for c in fields]).alias("_leaf")).groupBy("_g", "_o", "_leaf").agg(F.count("*").alias("_rows"))
    then = proofs.withColumn("_ok", folded(F.col("leaf"), F.col("sides"), F.col("siblings")) == F.col("root"))
    then = then.groupBy(F.col(group).alias("_h"), F.col(order).alias("_p"), "leaf").agg(F.count("*").alias("_proofs"), F.count_if("_ok").alias("_true"))
    same = F.col("_g").eqNullSafe(F.col("_h")) & F.col("_o").eqNullSafe(F.col("_p")) & (F.col("_leaf") == F.col("leaf"))
    both = now.join(then, same, "full").select(
        F.when(F.col("_leaf").isNull(), F.col("_h")).otherwise(F.col("_g")).alias(group), F.when(F.col("_leaf").isNull(), F.col("_p")).otherwise(F.col("_o")).alias(order),
        F.coalesce("_rows", F.lit(0)).alias("_rows"), F.coalesce("_proofs", F.lit(0)).alias("_proofs"), F.coalesce("_true", F.lit(0)).alias("_true"))
    return both.groupBy(group, order).agg(F.sum("_rows").alias("n_rows"), F.sum("_proofs").alias("n_proofs"),
                                          F.sum(F.least("_rows", "_true")).alias("n_verified"))
