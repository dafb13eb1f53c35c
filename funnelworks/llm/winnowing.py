"""Document fingerprints by winnowing.

Every k-gram of a text (k consecutive code points) gets a rolling 64-bit hash: prefix sums of
``code point * base^-i`` give each k-gram's polynomial by one subtraction, which is then mixed. Of
each window of ``window`` consecutive hashes the smallest is chosen, the rightmost among equals,
and the chosen (hash, position) pairs are the fingerprint. So two texts that share a passage of
``window + k - 1`` code points share a chosen hash, and positions tell where. The upper 44 bits of
a hash are compared and kept.

A text shorter than k is one k-gram; a text with fewer than ``window`` k-grams is one window. Null
and empty texts have an empty fingerprint. Long texts are hashed in blocks of BLOCK k-grams with
the windows across block ends kept, so the memory does not grow with the text beyond its code
points. Likeness is the share of common distinct hashes (two empty fingerprints: 1).

``with_next`` looks at each document and the next one in ascending id order (after the last: the
first; null ids come first; rows with equal ids in the order of their packed texts). The rows are
dealt out in ranges of ids, each sorted; only the first document of each range is sent to the range
before it as well. Repeated rows are documents of their own. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelworks.llm.common import per_document, shuffle_parts, split_points, steps

#: Code points of a k-gram and hashes of a window; BLOCK k-grams are hashed at once.
K, WINDOW = 20, 50
BLOCK = 1 << 17
_LOW = 20  # lower bits of a compared key hold the place in the block, so BLOCK + window stay below 2^20
_BASE = 0x9E3779B97F4A7C15
_NULL_ID = -(1 << 63)


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(size, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """Mixed rolling hashes of all k-grams of at most BLOCK + 4096 - 1 code points."""
    up, down = _powers(BLOCK + 4096)
    sums = np.empty(len(points) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * down[:len(points)], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * up[:len(points) - k + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the chosen k-grams in ascending position."""
    if not text:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    k = min(k, len(points))
    grams = len(points) - k + 1
    wide = min(window, grams)
    hashes, places, low = [], [], np.uint64((1 << _LOW) - 1)
    for first in range(0, grams - wide + 1, BLOCK - wide):  # first k-gram of the block's first window
        last = min(first + BLOCK, grams)  # behind its last k-gram; blocks share wide k-grams
        key = gram_hashes(points[first:last + k - 1], k) & ~low
        key |= low - np.arange(last - first, dtype=np.uint64)
        reach = 1
        while reach < wide:  # minimum over windows of twice the reach, up to the whole window
            step = min(reach, wide - reach)
            key = np.minimum(key[:-step], key[step:])
            reach += step
        key = key[np.r_[True, key[1:] != key[:-1]]]
        hashes.append(key >> np.uint64(_LOW))
        places.append((low - (key & low)).astype(np.int64) + first)
    h, p = np.concatenate(hashes), np.concatenate(places)
    new = np.r_[True, p[1:] > p[:-1]]  # a choice on both sides of a block end counts once
    return h[new], p[new]


def as_text(chosen: tuple[np.ndarray, np.ndarray]) -> str:
    """``hash:position`` pairs, the hash in hexadecimal, comma-joined."""
    return ",".join([f"{h:011x}:{p}" for h, p in zip(chosen[0].tolist(), chosen[1].tolist(), strict=True)])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Common distinct hashes over all distinct hashes."""
    a, b = set(a.tolist()), set(b.tolist())
    return len(a & b) / len(a | b) if a or b else 1.0


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW, id_col: str = "doc_id") -> DataFrame:
    """(id, fingerprint) of every document."""
    return per_document(docs, [id_col], lambda texts: [(as_text(winnow(t, k, window)),) for t in texts],
                        f"{id_col} long, fingerprint string")


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n/2) code points replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _pack(splits: list[int], first_id: int):
    """(part, late, key, text): each document to its range, and a range's first id to the range before too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        bounds = np.array(splits, dtype=np.int64)
        for batch in batches:
            for part in steps(batch):
                keys = np.array(part.column(0).to_pylist(), dtype=np.int64)
                texts = [squeeze((t or "").encode()) for t in part.column(1).to_pylist()]
                own = np.searchsorted(bounds, keys, side="right")
                rows = [(int(p), 0, int(k), True, t) for p, k, t in zip(own, keys, texts, strict=True)]
                rows += [(r[0] - 1, 0, r[2], False, r[4]) for r in rows if r[0] and splits[r[0] - 1] == r[2]]
                rows += [(len(splits), 1, r[2], False, r[4]) for r in rows[:len(texts)] if r[2] == first_id]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()), strict=True)],
                    names=["part", "late", "key", "own", "text"])

    return run


def _neighbours(k: int, window: int):
    """Rows of a range in order; a row is finished when the next one is there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, before, part = zstandard.ZstdDecompressor().decompress, None, None
        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for whole in batches:
            for batch in steps(whole):
                out = []
                for p, key, own, packed in zip(*(batch.column(c).to_pylist() for c in ("part", "key", "own", "text")), strict=True):
                    text = unpack(packed).decode()
                    chosen = winnow(text, k, window)
                    if before and part == p and before[1]:
                        changed = edited(before[2], text)
                        other = winnow(changed, k, window)
                        out.append((None if before[0] == _NULL_ID else before[0], len(before[2]), hashlib.sha256(changed.encode()).hexdigest(),
                                    as_text(before[3]), as_text(other), likeness(before[3][0], other[0]), likeness(before[3][0], chosen[0])))
                    part, before = p, (key, own, text, chosen)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return run


def with_next(docs: DataFrame, k: int = K, window: int = WINDOW, id_col: str = "doc_id") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and the next document's."""
    keyed = docs.select(F.coalesce(F.col(id_col), F.lit(_NULL_ID)).alias("key"), "text")
    splits = split_points(keyed, "key", shuffle_parts(docs.sparkSession))
    first_id = keyed.agg(F.min("key")).first()[0]
    packed = keyed.mapInArrow(_pack(splits, first_id), "part int, late int, key long, own boolean, text binary")
    dealt = packed.repartitionById(len(splits) + 1, "part").sortWithinPartitions("part", "late", "key", "own", "text")
    out = dealt.mapInArrow(_neighbours(k, window), "id long, n_chars long, edited_sha256 string, fingerprint string, "
                                                   "edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id_col)
