"""Trie of conversation prefixes: what conversations share, by an Euler tour that is list-ranked distributedly.

``own_turns`` orders the turns of a conversation (null first; equal turns by the sha256 of role and text, null
role or text being empty), ``rebuilt`` lets conversations begin as another one does, and ``trie`` makes the nodes:
each distinct sequence of the first d turns (role, text), from the textless root at d = 0.

Method. A turn is known by its sha256 and a prefix by two 64-bit sums (exclusive or) of hashes of its places and
turns, run over a conversation's turns, so the parent's key is the child's without the last turn's hash.
Nodes are numbered by depth, parent and key, which puts the children of a node side by side. Each node
has an enter and an exit arc; the arc after an enter arc enters the first child or exits, the one
after an exit arc enters the next sibling or exits the parent. The list of arcs is ranked
(list_ranking.rank), and differences of running sums over the arcs' positions give each node's leaves
and saved tokens. The texts are read once; everything after that carries digests and numbers.

Skew. A node with a third of all conversations is counted with partial sums; a conversation with very
many turns and a node with very many children are dealt out in spans of positions; lists of members
that end in one node are joined in pieces of PIECE ids, and only where there is more than one
piece are they hashed as a sorted stream (sha256 has no parallel form; a task's memory is one piece).

Rows without a conv_id belong to no conversation and are left out. Repeated rows are turns of their own. An empty
table gives no node. Empty and very long texts are turns like others. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelworks.llm.common import stored
from funnelworks.llm.list_ranking import rank, running, span, spread
from funnelworks.operators.global_rank import SortKey, global_positions

WORD = r"[^\x20\x09-\x0D]+"
#: Ids of members that are joined into one text.
PIECE = 4096


def own_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, depth from 1, digest, words) of every turn, (conv_id, n_turns) of every conversation)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("words"))
    placed = global_positions(stored(turns, "trie-turns"), [SortKey("conv_id"), SortKey("turn"), SortKey("digest")], "_p").drop("_p_n")
    placed = stored(placed, "trie-placed")
    per = stored(placed.groupBy("conv_id").agg(F.min("_p").alias("_first"), F.count("*").alias("n_turns")), "trie-conversations")
    starts = spread(per.withColumn("_last", F.col("_first") + F.col("n_turns") - 1), "_first", "_last").select("conv_id", "_span", "_first")
    turns = placed.withColumn("_span", span("_p")).join(starts, ["conv_id", "_span"])
    return turns.select("conv_id", (F.col("_p") - F.col("_first") + 1).alias("depth"), "digest", "words"), per.select("conv_id", "n_turns")


def rebuilt(turns: DataFrame, sizes: DataFrame, donor: Column, taken: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Turns and sizes of the conversations that begin with the first ``taken`` turns (at most ``most``) of conversation
    ``donor``, both of the column conv_id, and go on with their own turns after as many."""
    plan = sizes.select("conv_id", "n_turns", donor.alias("_donor"), taken.alias("_h"))
    given = sizes.select(F.col("conv_id").alias("_donor"), F.col("n_turns").alias("_has"))
    plan = plan.join(given, "_donor", "left").withColumn("_k", F.least("_h", F.coalesce("_has", F.lit(0))))
    plan = stored(plan.withColumn("_rest", F.greatest(F.col("n_turns") - F.col("_h"), F.lit(0))), "trie-plans")
    head = turns.where(F.col("depth") <= most).select(F.col("conv_id").alias("_donor"), "depth", "digest", "words")
    head = plan.select("conv_id", "_donor", "_k").join(head, "_donor").where("depth <= _k").select("conv_id", "depth", "digest", "words")
    # A conversation of very many turns meets its plan in spans of its depths.
    spans = spread(plan.where("_rest > 0"), "_h", "n_turns").select("conv_id", "_h", "_k", "_span")
    rest = turns.withColumn("_span", span("depth")).join(spans, ["conv_id", "_span"]).where("depth > _h")
    rest = rest.select("conv_id", (F.col("depth") - F.col("_h") + F.col("_k")).alias("depth"), "digest", "words")
    return head.unionByName(rest), plan.select("conv_id", (F.col("_k") + F.col("_rest")).alias("n_turns"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of the pieces of each node, which come in order, joined by commas."""
    at, state, keys, out = None, None, [], []
    for batch in batches:
        for *key, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key == at:
                state.update(b"," + ids.encode())
                continue
            if at is not None:
                keys.append(at)
                out.append(state.hexdigest())
            at, state = key, hashlib.sha256(ids.encode())
    if at is not None:
        cols = [pa.array(c, pa.int64()) for c in zip(*keys, at, strict=True)] if keys else [pa.array([x], pa.int64()) for x in at]
        yield pa.RecordBatch.from_arrays([*cols, pa.array([*out, state.hexdigest()])], names=["depth", "x1", "x2", "ends_sha256"])


def _ends(members: DataFrame) -> DataFrame:
    """(depth, x1, x2, ends_sha256) of the nodes in which members end."""
    node = ["depth", "x1", "x2"]
    placed = global_positions(members.select(*node, "conv_id"), [SortKey(c) for c in (*node, "conv_id")], "_p")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = stored(placed.groupBy(*node, F.floor(F.col("_p") / PIECE).alias("_piece")).agg(ids.alias("ids")), "trie-ends")
    per = pieces.groupBy(*node).agg(F.count("*").alias("_n"), F.min("ids").alias("ids"))
    one = per.where("_n = 1").select(*node, F.sha2("ids", 256).alias("ends_sha256"))
    many = pieces.join(per.where("_n > 1").select(*node), node, "left_semi").select(*node, "_piece", "ids")
    many = many.repartition(*node).sortWithinPartitions(*node, "_piece")
    return one.unionByName(many.mapInArrow(_hashed, "depth long, x1 long, x2 long, ends_sha256 string"))


def trie(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """Nodes of the prefixes of ``turns`` (conv_id, depth, digest, words), members being all of ``sizes`` (conv_id, n_turns).

    (conv_id smallest member, depth, parent_conv_id the parent's, n_convs members, n_children, n_leaves childless
    nodes of the subtree, saved_tokens (n_convs - 1) * words of the last text over the subtree, ends_sha256 of the
    ids of members that end there, ascending, joined by commas).
    """
    hashes = [F.xxhash64(F.lit(k), F.col("depth"), F.col("digest")).alias(f"g{k}") for k in (1, 2)]
    turns = stored(turns.select("conv_id", "depth", (F.col("depth") - 1).alias("_at"), *hashes, "words"), "trie-hashes")
    paths = running(turns, "_at", {"g1": "xor", "g2": "xor"}, ["conv_id"])
    paths = paths.select("conv_id", "depth", F.col("g1_run").alias("x1"), F.col("g2_run").alias("x2"),
                         F.col("g1").bitwiseXOR(F.col("g1_run")).alias("p1"), F.col("g2").bitwiseXOR(F.col("g2_run")).alias("p2"), F.col("words").cast("long").alias("words"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    roots = sizes.select("conv_id", zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), none.alias("p1"), none.alias("p2"), zero.alias("words"))
    paths = stored(paths.unionByName(roots), "trie-paths")
    node = ["depth", "x1", "x2"]
    nodes = paths.groupBy(*node).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("p1").alias("p1"),
                                     F.min("p2").alias("p2"), F.min("words").alias("words"))
    nodes = stored(global_positions(nodes, [SortKey(c) for c in ("depth", "p1", "p2", "x1", "x2")], "id"), "trie-nodes")
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(
        F.min("id").alias("first"), F.max("id").alias("last"))
    inner = stored(nodes.select(*node, "id", "conv_id").join(kids, node), "trie-inner")
    tour = nodes.select("id", "id_n", "n_convs", "words").join(inner.select("id", "first", "last"), "id", "left").join(
        inner.select(F.col("last").alias("id"), F.col("id").alias("up")), "id", "left")
    after = F.when(F.col("up").isNotNull(), 2 * F.col("up") + 1).when(F.col("id") == 0, -1).otherwise(2 * F.col("id") + 2)
    arcs = F.array(F.struct((2 * F.col("id")).alias("id"), F.coalesce(2 * F.col("first"), 2 * F.col("id") + 1).alias("next"),
                            F.col("first").isNull().cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved")),
                   F.struct((2 * F.col("id") + 1).alias("id"), after.cast("long").alias("next"), zero.alias("leaves"), zero.alias("saved")))
    arcs = stored(tour.select(F.explode(arcs).alias("a"), (2 * F.col("id_n")).alias("arcs")).select("a.*", "arcs", F.lit(1).cast("long").alias("steps")), "trie-arcs")
    toured = arcs.select("id", "leaves", "saved", "arcs").join(rank(arcs), "id")
    toured = stored(toured.select("id", "leaves", "saved", (F.col("arcs") - F.col("left")).alias("at")), "trie-tour")
    sums = running(toured, "at", {"leaves": "sum", "saved": "sum"})
    out = F.col("id") % 2 == 1
    subtree = [F.sum(F.when(out, F.col(f"{c}_run")).otherwise(F.col(c) - F.col(f"{c}_run"))).alias(c) for c in ("leaves", "saved")]
    sums = sums.groupBy(F.floor(F.col("id") / 2).alias("id")).agg(*subtree)
    done = paths.join(sizes.withColumnRenamed("n_turns", "depth"), ["conv_id", "depth"])
    parents = spread(inner, "first", "last").select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), "_span",
                                                    F.col("conv_id").alias("parent_conv_id"))
    children = inner.select("id", (F.col("last") - F.col("first") + 1).alias("n_children"))
    result = nodes.withColumn("_span", span("id")).join(parents, ["depth", "p1", "p2", "_span"], "left")
    result = result.join(children, "id", "left").join(sums, "id").join(_ends(done), node, "left")
    return result.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), F.col("leaves").alias("n_leaves"),
                         F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
