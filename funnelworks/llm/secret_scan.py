"""Secrets by fixed patterns, widened by strings of high entropy.

Base spans, leftmost and non-overlapping per kind: assign (a keyword in either case, then : or =, then
a value of 6 or more characters; the span is the whole match), access (AKIA and 16 or more capitals or
digits), hex (24 or more lower-case hex digits). The expressions find what the contract's find, without giving back characters.

Added spans, of kind entropy. Candidates are the maximal runs of a character class (CLASSES: hex digits in
either case, base64 with its URL form) of at least the class's window, with a digit and a letter.
A window slides over a candidate; counts of its characters are kept, and of each step only the
entering and the leaving character change them and the sum of count * log2(count), in integer
millionths, so that no rounding builds up. The window's Shannon entropy is log2(window) - sum / window.
A candidate is a secret if any window with MIN_MIX digits and as many other characters has the class's
bits or more, if no expression of ALLOW matches the whole of it, if no text of KNOWN contains it
(alphabets, digits in order), and if it does not touch a base span. Secrets of the two classes that
overlap become one span. Allow-lists suppress added spans only.

Everything is DataFrame operations. Texts are read once, in one pass without a shuffle, and only
rows with a match go on, one row per match; positions are sums over the matches of one text.
Null texts are read as empty and have no spans. Repeated rows, null ids and equal ids are kept as rows of
their own. Long texts are read whole. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelworks.llm.common import stored

KINDS = ("assign", "access", "hex", "entropy")
#: Fixed by the contract; here with possessive quantifiers. Of assign's matches group 1 is the value.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
MIN_VALUE = 6


@dataclass(frozen=True)
class CharClass:
    """Characters (digits first), whether capitals count as small letters, window length, least bits."""
    alphabet: str
    fold: bool
    window: int
    bits: float

    def candidates(self) -> str:
        letters = "".join(c for c in self.alphabet if c.isalpha())
        letters += letters.upper() if self.fold else ""
        marks = "".join(rf"\{c}" for c in self.alphabet if not c.isalnum())
        every = f"[0-9{letters}{marks}]"
        return rf"(?<!{every})(?=[{letters}{marks}]*+[0-9])(?=[0-9{marks}]*+[{letters}]){every}{{{self.window},}}+"


_SMALL = "abcdefghijklmnopqrstuvwxyz"
CLASSES = (CharClass("0123456789abcdef", True, 16, 2.75), CharClass("0123456789" + _SMALL + _SMALL.upper() + "+/_=-", False, 20, 3.7))
MIN_MIX = 2
#: Harmless forms: UUIDs, placeholders, words with numbers behind them joined by marks (paths, names).
ALLOW = (
    r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",
    r"(?i).*(?:example|sample|dummy|placeholder|changeme|xxxx).*",
    r"(?:[A-Za-z]{0,24}[0-9]{0,4}[+/_=-]++)+[A-Za-z]{0,24}[0-9]{0,4}",
    r"[A-Za-z][a-z]*+(?:[A-Z][a-z]++)*+[0-9]{0,4}",
)
#: ALLOW as Spark runs it, matching the same. All repeated groups are possessive: one that can give back takes stack for each
#: repetition, which a long path exhausts. Other engines do not know these quantifiers.
SPARK_ALLOW = (*ALLOW[:2], r"(?:[A-Za-z]{0,24}+[0-9]{0,4}+[+/_=-]++)++[A-Za-z]{0,24}[0-9]{0,4}", ALLOW[3])
#: Characters in order.
KNOWN = ("0123456789" * 8, "0123456789abcdef" * 4, "0123456789ABCDEF" * 4, "0123456789" + _SMALL, "0123456789" + _SMALL.upper(),
         _SMALL + "0123456789", _SMALL.upper() + "0123456789", _SMALL + _SMALL.upper() + "0123456789", _SMALL.upper() + _SMALL + "0123456789+/=")
UNIT = 1_000_000


def weight(count: int) -> int:
    """count * log2(count) in millionths."""
    return round(count * log2(count) * UNIT) if count else 0


def limit(c: CharClass) -> int:
    """The largest sum of weights of a window that has the class's bits."""
    return int(c.window * (log2(c.window) - c.bits) * UNIT)


def least_sum(text: Column, c: CharClass) -> Column:
    """The least sum of weights, that is the highest entropy, among ``text``'s windows with enough digits and others; null if none."""
    chars = F.split(F.lower(text) if c.fold else text, "")
    codes = F.transform(chars, lambda x: F.instr(F.lit(c.alphabet), x))
    # Beside each entering character the one that leaves, 0 for none.
    moves = F.zip_with(codes, F.slice(F.concat(F.array_repeat(F.lit(0), c.window), codes), F.lit(1), F.size(codes)),
                       lambda come, go: F.struct(come.alias("come"), go.alias("go")))
    table = F.array(*[F.lit(weight(k)) for k in range(c.window + 2)])

    def step(acc: Column, move: Column) -> Column:
        come, go = move["come"], move["go"]
        counts = F.transform(acc["counts"], lambda n, k: n + (k + 1 == come).cast("int") - (k + 1 == go).cast("int"))
        had = F.element_at(acc["counts"], come)
        left = F.element_at(acc["counts"], F.greatest(go, F.lit(1))) + (come == go).cast("int")
        total = acc["sum"] + F.get(table, had + 1) - F.get(table, had) + F.when(go > 0, F.get(table, left - 1) - F.get(table, left)).otherwise(0)
        digits = acc["digits"] + (come <= 10).cast("int") - go.between(1, 10).cast("int")
        mixed = (acc["seen"] + 1 >= c.window) & digits.between(MIN_MIX, c.window - MIN_MIX)
        return F.struct(counts.alias("counts"), total.alias("sum"), digits.alias("digits"), (acc["seen"] + 1).alias("seen"),
                        F.when(mixed, F.least(acc["best"], total)).otherwise(acc["best"]).alias("best"))

    start = F.struct(F.array_repeat(F.lit(0), len(c.alphabet)).alias("counts"), F.lit(0).alias("sum"), F.lit(0).alias("digits"),
                     F.lit(0).alias("seen"), F.lit(None).cast("int").alias("best"))
    return F.aggregate(moves, start, step)["best"]


def _matches(text: Column, pattern: str, possible: Column) -> Column:
    """Array of (m: match, gap: code points between it and the match before)."""
    gaps = F.split(text, pattern, -1)
    found = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), gaps, lambda m, g: F.struct(m.alias("m"), F.length(g).alias("gap")))
    found = F.filter(found, lambda x: x["m"].isNotNull())
    return F.when(possible, found).otherwise(F.array().cast("array<struct<m:string,gap:int>>"))


def hits(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(_row, id, hits) per row: the raw matches of assign, access, hex and of each class's candidates."""
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.lower(text)
    word = F.contains(low, F.lit("passw")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | F.contains(low, F.lit("key"))
    patterns = [(ASSIGN, word), (ACCESS, F.contains(text, F.lit("AKIA"))), (HEX, None)] + [(c.candidates(), None) for c in CLASSES]
    raw = [_matches(text, p, F.regexp_like(text, F.lit(p)) if ok is None else ok) for p, ok in patterns]
    return docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col), F.array(*raw).alias("hits"))


def scan(raw: DataFrame, allow: Sequence[str] = SPARK_ALLOW, known: Sequence[str] = KNOWN) -> DataFrame:
    """(_row, kind 0..3, start, end, text): the base spans and the added ones, from the stored ``hits``."""
    rows = raw.select("_row", F.posexplode("hits").alias("kind", "of")).where("size(of) > 0")
    rows = rows.select("_row", "kind", F.posexplode("of").alias("i", "x")).select("_row", "kind", "i", "x.m", "x.gap")
    upto = Window.partitionBy("_row", "kind").orderBy("i")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.length("m")).over(upto).cast("long"))
    rows = rows.withColumn("start", F.col("end") - F.length("m"))
    n_base = len(KINDS) - 1
    random = F.lit(False)
    for k, c in enumerate(CLASSES):
        random = random | F.when(F.col("kind") == n_base + k, F.coalesce(least_sum(F.col("m"), c) <= limit(c), F.lit(False))).otherwise(False)
    listed = F.lit(False)
    for p in allow:
        listed = listed | F.regexp_like("m", F.lit(f"^(?:{p})$"))
    for t in known:
        listed = listed | F.contains(F.lit(t), F.col("m"))
    value = F.length(F.regexp_extract("m", ASSIGN, 1))
    fine = F.when(F.col("kind") == 0, value >= MIN_VALUE).when(F.col("kind") < n_base, True).otherwise(~listed & random)
    rows = rows.where(fine).withColumn("kind", F.least(F.col("kind"), F.lit(n_base)))
    # An added span touches a base span if one that begins before its end ends after its start.
    near = Window.partitionBy("_row").orderBy("start", "kind")
    base = F.col("kind") < n_base
    rows = rows.withColumn("reach", F.max(F.when(base, F.col("end"))).over(near.rowsBetween(Window.unboundedPreceding, -1)))
    # In reverse order, since a frame that ends at the last row is gone through anew for each row.
    back = Window.partitionBy("_row").orderBy(F.col("start").desc(), F.col("kind").desc())
    rows = rows.withColumn("ahead", F.min(F.when(base, F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    free = (F.coalesce("reach", F.lit(-1)) <= F.col("start")) & (F.coalesce("ahead", F.col("end")) >= F.col("end"))
    added = rows.where(~base & free)
    # Added spans that overlap become one: a new one begins where none before it reaches.
    before = Window.partitionBy("_row").orderBy("start", F.col("end").desc())
    fresh = F.coalesce(F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1)) <= F.col("start"), F.lit(True))
    added = added.withColumn("fresh", fresh.cast("int")).withColumn("island", F.sum("fresh").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    # Its text is that of the parts, each without what the parts before it cover.
    part = F.struct("start", (-F.col("end")).alias("back"), "m")
    added = added.groupBy("_row", "island").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    whole = F.aggregate("parts", F.struct(F.lit(0).cast("long").alias("end"), F.lit("").alias("text")), lambda a, p: F.struct(
        F.greatest(a["end"], -p["back"]).alias("end"),
        F.concat(a["text"], F.when(a["end"] == 0, p["m"]).when(-p["back"] > a["end"], F.right(p["m"], -p["back"] - a["end"])).otherwise("")).alias("text")))
    added = added.select("_row", F.lit(n_base).alias("kind"), F.col("parts")[0]["start"].alias("start"), whole.alias("w"))
    return rows.where(base).select("_row", "kind", "start", "end", F.col("m").alias("text")).unionByName(
        added.select("_row", "kind", "start", F.col("w.end").alias("end"), F.col("w.text").alias("text")))


def findings(docs: DataFrame, id_col: str = "doc_id", allow: Sequence[str] = SPARK_ALLOW, known: Sequence[str] = KNOWN) -> DataFrame:
    """(id, kind, start, end, text): a row per secret found; positions in code points, end exclusive."""
    raw = stored(hits(docs, id_col), "secret-hits")
    names = F.array(*[F.lit(k) for k in KINDS])
    return raw.select("_row", id_col).join(scan(raw, allow, known), "_row").select(id_col, F.get(names, F.col("kind")).alias("kind"), "start", "end", "text")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", allow: Sequence[str] = SPARK_ALLOW, known: Sequence[str] = KNOWN) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy) of every row."""
    raw = stored(hits(docs, id_col), "secret-hits")
    per = scan(raw, allow, known).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    some = raw.where("exists(hits, x -> size(x) > 0)").select("_row", id_col).join(per, "_row", "left").select(id_col, "spans")
    none = raw.where("not exists(hits, x -> size(x) > 0)").select(id_col).withColumn("spans", F.lit(None).cast(some.schema["spans"].dataType))
    every = some.unionByName(none).withColumn("spans", F.coalesce("spans", F.array().cast(some.schema["spans"].dataType)))
    of = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(of) - F.size(F.array_remove(of, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    base = F.filter("spans", lambda s: s["kind"] < len(KINDS) - 1)
    return every.select(id_col, *counts[:-1], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), counts[-1])
