"""Operator 12: the trie against brute force; list ranking and running values on their own."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from funnelworks.llm import conversation_trie, list_ranking, queries

COLUMNS = "conv_id long, turn long, role string, text string, depth string, words string"


def _own(rows):
    by = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            tie = hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).hexdigest()
            by.setdefault(c, []).append((t is not None, t or 0, tie, (r, x)))
    return {c: [z[-1] for z in sorted(v)] for c, v in by.items()}


def _rebuilt(own):
    out = {}
    for c, v in own.items():
        donor, h = c - abs(c) % 20 * (1 if c >= 0 else -1), zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(donor, [])[:h] + v[h:]
    return out


def _nodes(convs):
    nodes, kids, leaves, saved = {}, {}, {}, {}
    for c, v in convs.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    for k in sorted(nodes, key=len, reverse=True):
        below = kids.get(k, [])
        leaves[k] = sum(leaves[x] for x in below) or 1
        saved[k] = (len(nodes[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1] if k else "")) + sum(saved[x] for x in below)
    ends = {k: ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(k)) for k, m in nodes.items()}
    return sorted((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), leaves[k], saved[k],
                   hashlib.sha256(ends[k].encode()).hexdigest()) for k, m in nodes.items())


def _rows(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-45, 60), 1000, 2**62]:
        for t in range(rng.randrange(0, 7)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["a b", "a", "", None, "é \x0b ü", " "])))
    rows += [(7, 1, "user", "same"), (7, 1, "user", "same"), (None, 1, "user", "lost"), (8, 2**60, "user", "w " * 5000)]
    rows += [(c, 0, "system", "be kind") for c in range(100, 160)]           # copies that end together
    rows += [(70, t, "user", f"turn {t % 3}") for t in range(150)]            # a long conversation
    rng.shuffle(rows)
    return rows


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], COLUMNS).repartition(3)


@pytest.mark.parametrize("small", [False, True])
def test_trie_equals_brute_force(spark, monkeypatch, small, tmp_path):
    if small:  # many rulers, spans and pieces
        monkeypatch.setattr(list_ranking, "WALK", 60)
        monkeypatch.setattr(list_ranking, "RULERS", 6)
        monkeypatch.setattr(list_ranking, "SPAN", 8)
        monkeypatch.setattr(conversation_trie, "PIECE", 16)
    rows = _rows(small)
    _frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op12_conversation_trie(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == _nodes(_rebuilt(_own(rows)))


def test_trie_of_conversations_as_they_are(spark):
    rows = _rows(5)
    got = conversation_trie.trie(*conversation_trie.own_turns(_frame(spark, rows))).collect()
    assert sorted(tuple(r) for r in got) == _nodes(_own(rows))


def test_no_conversations(spark):
    assert conversation_trie.trie(*conversation_trie.own_turns(_frame(spark, [(None, 1, "a", "b")]))).count() == 0


def test_ranks_of_a_shuffled_list(spark, monkeypatch):
    monkeypatch.setattr(list_ranking, "WALK", 50)
    rng = random.Random(4)
    ids = rng.sample(range(10_000), 2000)
    steps = [rng.randrange(5) for _ in ids]
    rows = [(i, n, s) for i, n, s in zip(ids, [*ids[1:], -1], steps, strict=True)]
    rng.shuffle(rows)
    got = {r.id: r.left for r in list_ranking.rank(spark.createDataFrame(rows, "id long, next long, steps long")).collect()}
    assert got == {i: sum(steps[k:]) for k, i in enumerate(ids)}


def test_running_values_over_spans(spark, monkeypatch):
    monkeypatch.setattr(list_ranking, "SPAN", 4)
    rng = random.Random(6)
    rows = [(k, p, rng.randrange(-9, 9), rng.randrange(2**62)) for k, n in (("a", 150), ("b", 3), ("c", 4), ("d", 17)) for p in range(n)]
    d = spark.createDataFrame(rows, "k string, p long, v long, x long").repartition(3)
    got = {(r.k, r.p): (r.v_run, r.x_run) for r in list_ranking.running(d, "p", {"v": "sum", "x": "xor"}, ["k"]).collect()}
    want, v, x = {}, 0, 0
    for k, p, a, b in rows:
        v, x = (a, b) if p == 0 else (v + a, x ^ b)
        want[k, p] = (v, x)
    assert got == want


def test_intervals_meet_rows_in_spans(spark, monkeypatch):
    monkeypatch.setattr(list_ranking, "SPAN", 8)
    groups = spark.createDataFrame([("a", 0, 99), ("b", 100, 100), ("c", 101, 140)], "g string, first long, last long")
    rows = spark.range(141).withColumn("g", F.expr("case when id < 100 then 'a' when id = 100 then 'b' else 'c' end"))
    got = rows.withColumn("_span", list_ranking.span("id")).join(list_ranking.spread(groups, "first", "last"), ["g", "_span"])
    assert got.count() == 141 and got.where("id between first and last").count() == 141
