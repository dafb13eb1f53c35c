"""Operators 5 and 6 against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from funnelworks.llm import components, simhash, winnowing


def _grams(text, k):
    points = [ord(c) for c in text]
    k, mask, inverse = min(k, len(points)), (1 << 64) - 1, pow(winnowing._BASE, -1, 1 << 64)
    out = []
    for i in range(len(points) - k + 1):
        x = sum((points[i + j] + 1) * pow(inverse, j, 1 << 64) for j in range(k)) & mask
        x ^= x >> 32
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 29
        x = x * 0x94D049BB133111EB & mask
        out.append((x ^ (x >> 32)) >> 20)
    return out


def _winnow(text, k, window):
    if not text:
        return []
    h = _grams(text, k)
    wide = min(window, len(h))
    chosen = set()
    for i in range(len(h) - wide + 1):
        low = min(h[i:i + wide])
        chosen.add(max(j for j in range(i, i + wide) if h[j] == low))
    return [(h[j], j) for j in sorted(chosen)]


@pytest.mark.parametrize("block", [16, 1 << 17])
def test_winnow_equals_brute_force(monkeypatch, block):
    monkeypatch.setattr(winnowing, "BLOCK", block)
    rng = random.Random(1)
    for n in (0, 1, 3, 5, 20, 60, 200):
        for k, window in ((3, 4), (5, 1), (4, 7)):
            text = "".join(rng.choice("abé😀") for _ in range(n))
            h, p = winnowing.winnow(text, k, window)
            assert list(zip(h.tolist(), p.tolist(), strict=True)) == _winnow(text, k, window)


def test_a_shared_passage_is_always_found():
    rng = random.Random(2)
    line = "".join(rng.choice("abcdefgh ") for _ in range(winnowing.K + winnowing.WINDOW - 1))
    for _ in range(20):
        a, b = ("".join(rng.choice("stuvwxyz") for _ in range(rng.randrange(300))) + line for _ in range(2))
        assert set(winnowing.winnow(a)[0].tolist()) & set(winnowing.winnow(b + "xyz")[0].tolist())


def test_neighbours_of_a_table(docs, no_docs, rows):
    got = winnowing.with_next(docs).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    texts = [r[1] or "" for r in ordered]
    want = []
    for k, (r, text) in enumerate(zip(ordered, texts, strict=True)):
        changed = winnowing.edited(text, texts[(k + 1) % len(texts)])
        mine, other, following = winnowing.winnow(text), winnowing.winnow(changed), winnowing.winnow(texts[(k + 1) % len(texts)])
        want.append((r[0], len(text), hashlib.sha256(changed.encode()).hexdigest(), winnowing.as_text(mine), winnowing.as_text(other),
                     winnowing.likeness(mine[0], other[0]), winnowing.likeness(mine[0], following[0])))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert winnowing.with_next(no_docs).count() == 0
    alone = winnowing.with_next(docs.where("doc_id = 7")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    assert {r.doc_id for r in winnowing.fingerprints(docs).collect() if not r.fingerprint} == {100, 101}


def _fingerprint(text, n):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[k:k + n]) for k in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] * bool(words)
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def _roots(fps, max_bits):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= max_bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(fps))]


def test_simhash_of_a_table(docs, no_docs, rows):
    got = simhash.near_duplicates(docs, 3, 3).collect()
    fps = [_fingerprint(r[1], 3) for r in rows]
    roots = _roots(fps, 3)
    least = {}
    for r, root in zip(rows, roots, strict=True):
        if r[0] is not None:
            least[root] = min(least.get(root, r[0]), r[0])
    want = [(r[0], f if f < 1 << 63 else f - (1 << 64), least.get(root)) for r, f, root in zip(rows, fps, roots, strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.representatives(docs).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted({str(x) for x in (least.get(r) for r in set(roots))})


def test_one_representative_per_component_not_per_id(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    text = [" ".join(rng.sample(words, 60)) for _ in range(7)]
    rows = [(None, text[0]), (None, text[1]), (None, text[1]), (5, text[2]), (None, text[2]),  # unlinked null ids; a linked one
            (3, text[3]), (7, text[3]), (7, text[4]),  # id 7: a copy of 3, and a text of its own
            (9, text[5]), (9, text[6]), (9, text[6])]
    got = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [(None, text[0]), (None, text[1]), (5, text[2]), (3, text[3]), (7, text[4]), (9, text[5]), (9, text[6])]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_links_of_dense_and_chained_fingerprints(spark, monkeypatch):
    """A ball of near fingerprints, a chain, and noise; small chunks, so groups are dealt in many cells."""
    monkeypatch.setattr(simhash, "CHUNK", 16)
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = {centre} | {centre ^ sum(1 << b for b in rng.sample(range(64), 2)) for _ in range(120)}
    x = rng.getrandbits(64)
    for _ in range(40):
        fps.add(x)
        for b in rng.sample(range(64), 3):
            x ^= 1 << b
    fps |= {rng.getrandbits(64) for _ in range(300)}
    fps = sorted(fps)
    signed = [f if f < 1 << 63 else f - (1 << 64) for f in fps]
    found = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), 3)
    label = {r.node: r.root for r in components.components(found).collect()}
    roots = _roots(fps, 3)
    groups, mine = {}, {}
    for s, r in zip(signed, roots, strict=True):
        groups.setdefault(r, set()).add(s)
        mine.setdefault(label.get(s, s), set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_two_blocks_of_a_linked_pair_agree():
    masks = simhash.block_masks(5)
    rng = random.Random(9)
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 3):
            b ^= 1 << bit
        assert any((a ^ b) & (m % (1 << 64)) == 0 for m in masks)


def test_pivot_table_discards_no_link():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64))
    table = [np.bitwise_count(x[:, None] ^ simhash.pivots()).astype(int) for x in (a, b)]
    assert (np.abs(table[0] - table[1]).max(axis=1) <= 1).all()
