"""SimHash near-duplicate detection with pivot distance tables.

Fingerprint: words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, shingles of
``shingle`` words with repeats, space-joined (fewer words: all of them as one; none: fingerprint 0),
XXH64 with seed 42 of each; a bit is 1 where over half of the hashes have it.

Links, at ``max_bits`` differing bits or fewer: equal fingerprints are one node. The 64 bits are
cut into ``max_bits + 2`` blocks; two linked fingerprints differ in at most ``max_bits`` blocks, so
they agree on two whole blocks, and those two blocks' bits are the key of a candidate group (one
key per pair of blocks; no link is lost). Inside a group the pivot table, the Hamming distances of
each member to PIVOTS reference fingerprints, discards pairs: by the triangle inequality no
coordinate of a linked pair differs by more than ``max_bits``. Members are swept in order of their
first coordinate, the largest difference over the other coordinates discards most of the rest, and
the survivors are verified on all bits. A group is reduced to a spanning set of its links before
they leave the task.

A group of any size is dealt out in cells: its members are hashed into chunks of about CHUNK, and
a cell holds two chunks, so every pair meets in some cell and no task gathers a group. Components
follow from the links (see ``components``).

Null and empty texts have fingerprint 0 and are linked like others; a null id never names a
component unless all its ids are null. Repeated rows, ties and copies share a node. An empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelworks.llm.common import aside, join_texts, per_document, stored, unpacked
from funnelworks.llm.components import components

PIVOTS = 32
CHUNK = 2048
_HASH_ROWS = 65_536


def _fingerprint(text: str, shingle: int) -> int:
    import xxhash

    data = text.encode()
    words = data.lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        starts, ends = [0], [len(line)]
    else:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        after = np.cumsum(sizes + 1)
        starts, ends = (after - sizes - 1)[:1 - shingle or None].tolist(), (after - 1)[shingle - 1:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for k in range(0, len(starts), _HASH_ROWS):
        part = [digest(line[a:b], 42) for a, b in zip(starts[k:k + _HASH_ROWS], ends[k:k + _HASH_ROWS], strict=True)]
        bits = np.unpackbits(np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id") -> DataFrame:
    """(id, fp): the 64-bit fingerprint of every text as a signed long."""
    return per_document(docs, [id_col], lambda texts: [(_fingerprint(t, shingle),) for t in texts], f"{id_col} long, fp long")


def block_masks(blocks: int) -> list[int]:
    """For each pair of ``blocks`` blocks of the 64 bits, the mask of their bits as a signed long."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    masks = [x | y for x, y in combinations(parts, 2)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def pivots() -> np.ndarray:
    """PIVOTS reference fingerprints: the SplitMix64 sequence from 1."""
    with np.errstate(over="ignore"):
        z = np.arange(1, PIVOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def linked_pairs(group: np.ndarray, fp: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of all linked pairs within runs of equal ``group``, in portions.

    The pivot table of all fingerprints comes first. Rows are ordered by group and first pivot
    distance; the k-th neighbour of a row is looked at only while some row's k-th neighbour is in
    its group and within ``max_bits`` of it on that coordinate.
    """
    table = np.bitwise_count(fp[:, None] ^ pivots()).astype(np.int8)
    order = np.lexsort((table[:, 0], group))
    group, fp, table = group[order], fp[order], table[order]
    left = np.arange(len(fp))
    for step in range(1, len(fp)):
        left = left[left + step < len(fp)]
        right = left + step
        near = (group[left] == group[right]) & (table[right, 0] - table[left, 0] <= max_bits)
        # Beyond the first neighbour out of reach, all later ones are too.
        left, right = left[near], right[near]
        if not len(left):
            return
        kept = np.abs(table[left] - table[right]).max(axis=1) <= max_bits
        a, b = left[kept], right[kept]
        close = np.bitwise_count(fp[a] ^ fp[b]) <= max_bits
        yield order[a[close]], order[b[close]]


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of ``n`` positions the smallest position it is connected to by ``pairs``."""
    root = np.arange(n)
    for a, b in pairs:
        while len(a):
            ra, rb = root[a], root[b]
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            if not len(a):
                break
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (up := root[root] != root).any():
                root[up] = root[root[up]]
    return root


def _cell_links(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by cell; the last cell of what is there waits for the next batch."""
        def links(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            unsigned = fp.view(np.uint64)
            root = spanning(len(fp), linked_pairs(np.cumsum(np.r_[False, cell[1:] != cell[:-1]]), unsigned, max_bits))
            kept = root != np.arange(len(fp))
            return pa.RecordBatch.from_arrays([pa.array(fp[root[kept]]), pa.array(fp[kept])], names=["a", "b"])

        cell, fp = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            cell = np.r_[cell, batch.column(0).to_numpy()]
            fp = np.r_[fp, batch.column(1).to_numpy()]
            done = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0
            if done:
                yield links(cell[:done], fp[:done])
                cell, fp = cell[done:], fp[done:]
        if len(cell):
            yield links(cell, fp)

    return run


def links(nodes: DataFrame, max_bits: int = 3) -> DataFrame:
    """(a, b) of fingerprints that connect all of ``nodes`` (fp long, distinct) at ``max_bits`` or fewer bits."""
    masks = block_masks(max_bits + 2)
    keys = nodes.select("fp", F.explode(F.array(*[
        F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)])).alias("x"))
    keys = keys.select("fp", "x.t", "x.key")
    # Stored, so that the join below has its own exchanges and AQE may split a large group.
    sizes = stored(keys.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-groups")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    members = (keys.join(sizes, ["t", "key"]).withColumn("chunks", chunks)
               .withColumn("own", F.pmod(F.xxhash64("fp", "t"), F.col("chunks")).cast("int")))
    cells = members.select("fp", "t", "key", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    # A cell is a group and two of its chunks; its name is a hash, and a clash only puts two cells side by side.
    cells = cells.select(F.xxhash64("t", "key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "fp")
    dealt = cells.repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(_cell_links(max_bits), "a long, b long").distinct()


def _rooted(marked: DataFrame, max_bits: int, id_col: str) -> DataFrame:
    """(fp, first_id, root) of the distinct fingerprints of ``marked``; fingerprints of one component share ``root``."""
    nodes = stored(marked.groupBy("fp").agg(F.min(id_col).alias("first_id")), "simhash-nodes")
    found = components(links(nodes, max_bits))
    return nodes.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id") -> DataFrame:
    """(id, fp, component_id) for every row; component_id is the smallest id among connected rows."""
    marked = stored(fingerprints(docs, shingle, id_col), "simhash-fingerprints")
    rooted = _rooted(marked, max_bits, id_col)
    named = stored(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-names")
    names = rooted.join(named, "root").select("fp", "component_id")
    return marked.join(names, "fp").select(id_col, "fp", "component_id")


def representatives(docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id") -> DataFrame:
    """One row of ``docs`` per component, whatever ids its rows have.

    It is that of the smallest id (no id comes last), of one id's texts the one of smallest md5, and of
    rows that repeat both the one whose columns come first. Rows are told apart by id and md5 of the
    text (null read as empty), so two components may leave rows of one id, or rows without an id.
    The join to the texts carries only rows that go and rows that occur several times; the texts cross it compressed.
    """
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    marked = stored(per_document(docs.select(id_col, digest.alias("_h"), "text"), [id_col, "_h"],
                                 lambda texts: [(_fingerprint(t, shingle),) for t in texts], f"{id_col} long, _h string, fp long"),
                    "simhash-fingerprints")
    roots = _rooted(marked, max_bits, id_col).select("fp", "root")
    rows = marked.groupBy(F.col(id_col).alias("_id"), "_h", "fp").agg(F.count("*").alias("rows"))
    rows = stored(rows.join(roots, "fp").select("root", "_id", "_h", "rows"), "simhash-rows")
    # Stored, so that the join below has its own exchanges and AQE may split a large component.
    first = stored(rows.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_h")).alias("first")),
                   "simhash-first")
    stays = F.col("first._id").eqNullSafe(F.col("_id")) & (F.col("first._h") == F.col("_h"))
    odd = rows.join(first, "root").withColumn("_stays", stays).where("not _stays or rows > 1")
    odd = stored(odd.select("_id", "_h", "_stays"), "simhash-odd-rows")
    plain = aside(docs, id_col, "text")
    joined = stored(join_texts(plain, odd, id_col, pack=True).where("_stays is null or _stays"), "simhash-kept")
    rest = joined.where("_stays is null").select(*plain.columns)
    # A minimum is combined before the shuffle, however often a row occurs.
    several = joined.where("_stays").groupBy("_id", "_h").agg(F.min(F.struct(*plain.columns)).alias("_row")).select("_row.*")
    return unpacked(rest.unionByName(several)).toDF(*docs.columns)
