"""Operator 11: trees, proofs and folding against a plain tree."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from funnelworks.llm import merkle


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(*fields):
    return _sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def _tree(nodes):
    """(root, proof of each leaf as [(side, sibling)])."""
    proofs, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(place):
            proofs[k].append((".", "") if i ^ 1 >= len(nodes) else ("l" if i % 2 else "r", nodes[i ^ 1]))
            place[k] = i // 2
        nodes = [_sha("".join(nodes[i:i + 2])) for i in range(0, len(nodes), 2)]
    return nodes[0], proofs


def _manifest(rows):
    """{(group, order, leaf): set of (subroot, root, sides, siblings)} of rows (group, order, leaf)."""
    groups = {}
    for g, o, x in rows:
        groups.setdefault(g, []).append((o is not None, o or 0, x))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [_tree([x for _, _, x in sorted(groups[g])]) for g in names]
    root, tops = _tree([t[0] for t in trees])
    out = {}
    for g, (sub, proofs), top in zip(names, trees, tops, strict=True):
        for (known, o, x), path in zip(sorted(groups[g]), proofs, strict=True):
            path = path + top
            out.setdefault((g, o if known else None, x), []).append((sub, root, "".join(s for s, _ in path), "".join(h for _, h in path)))
    return {k: sorted(v) for k, v in out.items()}


def _got(df, group, order):
    out = {}
    for r in df.collect():
        out.setdefault((r[group], r[order], r.leaf), []).append((r.subroot, r.root, r.sides, r.siblings))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("levels", [1, 6])
def test_proofs_equal_a_plain_tree(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 1 << levels)
    rng = random.Random(levels)
    sizes = {"en": 200 if levels > 1 else 37, "de": 64, "é": 65, "z": 1, None: 3, "Z": 2, "": 13}
    rows = [(g, o, _leaf(g, o)) for g, n in sizes.items() for o in range(n)]
    rows += [("en", 5, _leaf("en", 5)), ("en", 5, _leaf("other")), (None, None, _leaf(None)), ("de", None, _leaf(1))]
    rng.shuffle(rows)
    d = spark.createDataFrame([(*r, "x") for r in rows], "g string, o long, leaf string, root string").repartition(5)
    got = merkle.proofs(d, "g", "o")
    assert _got(got, "g", "o") == _manifest(rows)
    back = got.select(merkle.folded(F.col("leaf"), F.col("sides"), F.col("siblings")).alias("a"), "root").collect()
    assert all(r.a == r.root for r in back)


def test_leaves_of_every_value(spark, docs, rows):
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    got = merkle.manifest(docs, fields, "lang", "doc_id")
    want = _manifest([(r[2], r[0], _leaf(r[0], r[3], r[2], r[4], r[1])) for r in rows])
    assert _got(got, "lang", "doc_id") == want


def test_one_leaf_and_no_leaf(spark, no_docs):
    d = spark.createDataFrame([("a", 1, "f" * 64)], "g string, o long, leaf string")
    r = merkle.proofs(d, "g", "o").first()
    assert (r.leaf, r.subroot, r.root, r.sides, r.siblings) == ("f" * 64, "f" * 64, "f" * 64, "", "")
    assert merkle.manifest(no_docs, ["doc_id", "text"], "lang", "doc_id").count() == 0


def test_manifest_tells_what_changed(spark, tmp_path):
    fields = ["doc_id", "lang", "text"]
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, lang string, text string")
    rows = [(k, ["en", "de", None][k % 3], f"text {k}") for k in range(200)]
    merkle.write_manifest(make(rows), f"{tmp_path}/m", fields, "lang", "doc_id")
    proofs = spark.read.parquet(f"{tmp_path}/m/proofs")
    subs = spark.read.parquet(f"{tmp_path}/m/subroots").collect()
    assert sorted((r.lang or "", r.n_rows) for r in subs) == [("", 66), ("de", 67), ("en", 67)] and len({r.root for r in subs}) == 1
    rows[7] = (7, "de", "changed")
    rows[9] = (9, "de", "text 9")
    del rows[20]
    now = merkle.verify(make([*rows, (500, "en", "new")]), proofs, fields, "lang", "doc_id")
    odd = {(r.lang, r.doc_id): (r.n_rows, r.n_proofs, r.n_verified) for r in now.collect() if not r.n_rows == r.n_proofs == r.n_verified}
    assert odd == {("de", 7): (1, 1, 0), ("de", 9): (1, 0, 0), ("en", 9): (0, 1, 0), (None, 20): (0, 1, 0), ("en", 500): (1, 0, 0)}
    forged = proofs.withColumn("leaf", F.when(F.col("doc_id") == 3, F.sha2(F.lit("x"), 256)).otherwise(F.col("leaf")))
    bad = forged.where(merkle.folded(F.col("leaf"), F.col("sides"), F.col("siblings")) != F.col("root")).collect()
    assert [r.doc_id for r in bad] == [3]
