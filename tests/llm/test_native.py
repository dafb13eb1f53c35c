"""Operators 2 and 7: brute force, bootstrapping, exact budgets."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from funnelworks.llm import mixing, pii

BASE = (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"))


def _luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _base(text):
    out = []
    for n, (kind, pattern) in enumerate(zip(pii.KINDS, BASE, strict=True)):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))
                    or kind == "card" and 14 <= len(digits) <= 19 and _luhn(digits) or kind == "phone" and 10 <= len(digits) <= 15):
                out.append((m.start(), n, m.end()))
    return sorted(out)


def _joined(spans):
    return ",".join(f"{pii.KINDS[n]}:{a}:{b}" for a, n, b in spans)


def test_base_spans_equal_brute_force(spark, rows):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab1290. +-()@%_5:é😀\n") for _ in range(rng.randrange(120))) for _ in range(1500)]
    texts += ["a@b.c.@d.e a@b.c_d@e.f", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4", "+1 (234) 567-8901", "4111 1111 1111 1111, 4111-1111-1111-1112",
              "é 4111111111111111 😀 x@y.zz", "1" * 5000, "a.b" * 3000 + "@x.y", "a@" + "b.c" * 4000, "+" * 3000, "+1" * 2000]
    texts = [(k, t) for k, t in enumerate(texts)] + [(9000 + k, r[1]) for k, r in enumerate(rows)]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert len(got) == len(texts)
    for k, t in texts:
        want, r = _base(t or ""), got[k]
        assert r.base_sha256 == hashlib.sha256(_joined(want).encode()).hexdigest(), t
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(n == j for _, n, _ in want) for j in range(4)]


def test_patterns_discover_unseen_identifiers(spark):
    rows = [(k, f"please dial extension +1 (555) 010-00{k:02d} today or not") for k in range(12)]
    rows += [(100, "please dial extension 555-0199, thanks"), (101, "the year 1999-2000 was good"), (102, "Dial Extension (555)0188 now")]
    rows += [(200 + k, f"chapter number 10{k}-20{k}") for k in range(5)] + [(300, "please dial extension +1 (555) 010-0001 today or not")]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == "phone:22:30" and got[102] == "phone:16:24"
    assert got[101] == "" and all(got[200 + k] == "" for k in range(5))
    assert got[300] == got[1] == "phone:22:39"


def _found(spark, texts):
    return {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(texts, "doc_id long, text string")).collect()}


def test_a_pattern_may_hold_a_number(spark):
    rows = [(k, f"7 @ 8 unit 12 phone: +1 (555) 010-00{k:02d}, line 2: a{k}@b.org") for k in range(12)]
    rows += [(100, "unit 12 phone: 555-0199"), (101, "1 2 3 4 x@y.org line 2: person@intranet")]
    got = _found(spark, rows)
    assert got[100] == "phone:15:23" and got[101] == "email:8:15,email:24:39"


def test_context_is_the_text_before_an_occurrence(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab1@ +-é😀\n:") for _ in range(rng.randrange(300))) for _ in range(200)] + ["1 " * 200, "x@y.z" * 90]
    found = pii.occurrences(pii.hits(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    assert found
    for r in found:
        start = r.start - (len(re.search(r"[^0-9A-Za-z@+]*$", texts[r.doc_id][:r.start])[0]) if r.kind is None else 0)
        words = re.findall(r"[^\W_]+[:=]*", texts[r.doc_id][max(0, start - pii.CONTEXT):start].lower())
        if start == r.start:  # marks before a candidate belong to its token
            assert [r.w2, r.w1] == (["", "", *words])[-2:], (texts[r.doc_id], r)


def test_discovered_identifiers_make_patterns_reliable(spark):
    # 60 seeds make "dial extension" reliable; its 12 unseen numbers alone make "desk number" so, in the third round.
    rows = [(k, f"dial extension +1 (555) 010-00{k:02d}") for k in range(60)]
    rows += [(100 + k, f"dial extension 555-01{k:02d} or desk number 555-01{k:02d}") for k in range(12)]
    rows += [(200 + k, f"desk number 555-090{k}") for k in range(2)]
    got = _found(spark, rows)
    assert got[200] == got[201] == "phone:12:20" and got[105] == "phone:15:23,phone:39:47"


def test_short_tokens_are_found_and_count_against_a_pattern(spark):
    rows = [(k, f"please dial extension +1 (555) 010-00{k:02d}, go to page +1 (555) 010-01{k:02d}") for k in range(12)]
    rows += [(100, "please dial extension 0188, or x@y @"), (101, "go to page 555-0177")] + [(200 + k, f"go to page {k}") for k in range(8)]
    got = _found(spark, rows)
    assert got[100] == "phone:22:26"
    assert got[101] == "" and all(got[200 + k] == "" for k in range(8))  # 12 of 21 texts are phones; 12 of 13 without the short ones


def test_redaction_keeps_columns_and_rows(spark, docs, no_docs, rows):
    got = pii.redact(docs)
    assert got.columns == docs.columns and got.count() == len(rows)
    text = got.where("doc_id = 105").first().text
    assert text == "call <PHONE> or <EMAIL> now <IP>"
    assert got.where("doc_id = 100").first().text is None
    clean = {r[0]: r[1] for r in rows if r[0] not in (105, None)}
    assert {r.doc_id: r.text for r in got.collect() if r.doc_id in clean} == clean
    assert pii.redact(no_docs).count() == 0 and pii.find(no_docs).count() == 0
    both = spark.createDataFrame([(1, "x 1.2.3.4@a.bc y")], "doc_id long, text string")  # an ip inside an email
    assert pii.redact(both).first().text == "x <EMAIL> y"


def test_a_text_of_very_many_matches(spark):
    """Every step takes time in proportion to a text's matches; squares of these would take minutes."""
    n = 60_000
    numbers = spark.createDataFrame([(1, "7 " * n + "a@b.cc")], "doc_id long, text string")
    assert pii.find(numbers).first().spans == f"email:{2 * n}:{2 * n + 6}"
    unit = "\ufeff\u00e9\U0001f600 a@b.cc"
    mails = spark.createDataFrame([(1, (unit + "\n") * n), (2, "\ufeffno span"), (3, unit + "\ufeff")], "doc_id long, text string")
    texts = {r.doc_id: r.text for r in pii.redact(mails).collect()}
    one = "\ufeff\u00e9\U0001f600 <EMAIL>"
    assert texts == {1: (one + "\n") * n, 2: "\ufeffno span", 3: one + "\ufeff"}


def test_repeated_rows_have_equal_spans(docs):
    got = [tuple(r) for r in pii.find(docs).collect() if r.doc_id == 3]
    assert len(got) == 2 and got[0] == got[1]


LEVELS = ["domain", "lang", "source"]


def _share(total, children):
    """children: (name, weight, capacity); water-filling one child at a time."""
    given, open_ = {}, sorted(children, key=lambda c: (c[2] / c[1], c[0]))
    while open_:
        name, w, cap = open_[0]
        if cap * sum(c[1] for c in open_) > w * total:
            break
        given[name] = cap
        total -= cap
        open_ = open_[1:]
    upto, whole = 0, sum(c[1] for c in open_)
    for name, w, _ in open_:
        given[name] = (upto + w) * total // whole - upto * total // whole
        upto += w
    return given


def _budgets(avail, weights, total, epochs):
    def down(path, budget):
        if len(path) == 3:
            return {path: budget}
        names = sorted({k[len(path)] for k in avail if k[:len(path)] == path})
        children = [(n, weights.get(LEVELS[len(path)], {}).get(n, 1), sum(epochs * a for k, a in avail.items() if k[:len(path) + 1] == (*path, n))) for n in names]
        out = {}
        for n, b in _share(budget, children).items():
            out |= down((*path, n), b)
        return out

    return down((), total)


def _mix_rows(seed):
    rng = random.Random(seed)
    rows = []
    for k in range(300):
        source = "hub" if k % 3 == 0 else f"s{rng.randrange(6)}"
        rows.append((k, " ".join(["w"] * rng.randrange(0, 40)), rng.choice(["en", "en", "de", None]), source))
    return [*rows, (5, rows[5][1], rows[5][2], rows[5][3]), (None, "a b c", "en", "hub"), (400, None, "en", "hub"), (401, "", "fr", "s9")]


@pytest.mark.parametrize("fraction,epochs", [((1, 2), 4), ((1, 1), 2), ((5, 2), 2), ((1, 1000), 1)])
def test_budgets_and_prefixes_are_exact(spark, monkeypatch, fraction, epochs):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 8)  # so that the prefix spans key buckets
    rows = _mix_rows(epochs)
    weights = {"domain": {"d0": 3}, "lang": {"en": 5, "de": 2}, "source": {"hub": 4, "s1": 2}}
    domain = F.concat(F.lit("d"), F.length("source") % 2)
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(d, {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}, weights, fraction, epochs, seed=3).collect()
    path = lambda r: (f"d{len(r[3]) % 2}", r[2] or "(none)", r[3])
    avail = {}
    for r in rows:
        avail[path(r)] = avail.get(path(r), 0) + len((r[1] or "").split())
    avail = {k: v for k, v in avail.items() if v}
    total = sum(avail.values()) * fraction[0] // fraction[1]
    want = _budgets(avail, weights, total, epochs)
    assert sum(want.values()) == min(total, epochs * sum(avail.values()))
    taken, seen = {}, {}
    for r in got:
        k = (r.domain, r.lang, r.source)
        taken[k] = taken.get(k, 0) + r.n_taken
        seen.setdefault((k, r.epoch), []).append((r.doc_id, r.n_tokens, r.n_taken))
        assert r.n_taken <= r.n_tokens and r.epoch < epochs
    # Copies of a repeated row are cut alike, so their sum may pass the budget by less than one token a copy.
    assert all(0 <= taken.get(k, 0) - b <= 1 for k, b in want.items())
    assert set(taken) <= {k for k, b in want.items() if b}
    for k, b in want.items():
        full = b // avail[k]
        members = sorted((str(r[0]), len((r[1] or "").split())) for r in rows if path(r) == k)
        for e in range(full):
            assert sorted((str(i), n) for i, n, t in seen[k, e] if t == n) == members
        key = lambda i: hashlib.md5(f"3:{full}:{'null' if i is None else i}".encode()).hexdigest()
        part = {i for i, _, _ in seen.get((k, full), [])}
        ordered = sorted({r[0] for r in rows if path(r) == k}, key=key)
        assert part == set(ordered[:len(part)])


def test_mixing_an_empty_table_and_other_columns(docs, no_docs):
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    assert mixing.mix(no_docs, levels, {}).count() == 0
    got = mixing.mix(docs, levels, {"source": {"src1": 0}}, (1, 1), 1, seed=1)
    assert {"h", "fp", "key", "n_chars", "epoch", "n_tokens"} <= set(got.columns)
    assert {r.source for r in got.collect()} == {"src0"}
