"""Personal data by fixed patterns, widened by bootstrapped contextual extraction.

Base spans, leftmost and non-overlapping per kind: email, ip (parts at most 255), card (14 to 19
digits passing the Luhn check), phone (10 to 15 digits). The expressions below find what the
contract's find, but begin only where a match can begin and never give back characters, so that
long runs of digits or letters take linear time.

Bootstrapping. Occurrences are the base spans, whose texts are the seeds, and all other tokens with
a digit or an @ that touch no base span, of any length, without the marks around them (a token of
marks alone, such as a lone @, is none). An occurrence's lexical pattern is the two words before
it (runs of letters and digits in lower case, with a : or = behind), taken from the whole text
before it, other occurrences included. Patterns and texts make a graph (one edge per pattern, text and kind, however often it occurs,
so copies of a document add nothing). In each round a pattern's confidence in a kind is the summed
confidence of its texts in that kind over the number of its texts plus one, seeds having 1 and
others 0 at first; a text's confidence is then one minus the product of its reliable patterns'
doubts. A pattern is reliable in a kind with a confidence of MIN_CONFIDENCE or more and a support of
MIN_SUPPORT texts, seeds or texts that are themselves that sure. Confidences only rise; rounds go on
until no text is added and none rises by more than SETTLED (the rises shrink by a constant factor).
Then an unseen occurrence becomes a span of the kind for which its pattern is reliable and its text sure.
Everything is DataFrame operations; what is grouped is an edge or a pattern, never all rows of one.

Null texts are read as empty and have no spans. Copies of a row get the same spans. Long texts are
read whole; positions of a text's spans are summed in a window over that text alone. Rows with
equal id and different texts are told apart by the text's md5. An empty table gives an empty
result. Other columns are not read by ``find``; ``redact`` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelworks.llm.common import aside, join_texts, stored

KINDS = ("email", "ip", "card", "phone")
#: Fixed by the contract, in the order of KINDS; here with possessive quantifiers and bounded beginnings.
PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9]){13,}+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: Any token with a digit or an @.
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
MIN_CONFIDENCE, MIN_SUPPORT, SETTLED = 0.7, 3, 1e-6
#: The byte order mark in UTF-32.
MARK = bytearray(b"\x00\x00\xfe\xff")
#: Code points before a match, other matches included, in which its two words are looked for.
CONTEXT = 64


def _matches(text: Column, pattern: str, possible: Column) -> Column:
    """Array of (m: match, gap: code points between it and the match before, left: the last CONTEXT of them)."""
    found = F.when(possible, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    gaps = F.split(text, pattern, -1)
    pairs = F.transform(F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("g")),
                        lambda x: F.struct(x["m"].alias("m"), F.length(x["g"]).alias("gap"), F.right(x["g"], F.lit(CONTEXT)).alias("left")))
    return F.when(possible & (F.size(found) > 0), pairs)


def hits(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, h, hits) per row: the md5 of the text and, for the four kinds and the candidates, the raw matches."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digits = F.regexp_like("text", F.lit("[0-9]"))
    possible = [F.contains(text, F.lit("@")), digits, digits, F.contains(text, F.lit("+"))]
    raw = [_matches(F.col("text"), p, ok) for p, ok in zip(PATTERNS, possible, strict=True)]
    raw.append(_matches(F.col("text"), CANDIDATE, digits | F.contains(text, F.lit("@"))))
    d = docs.select(F.col(id_col), text.alias("text"))
    return d.select(id_col, F.md5(F.col("text").cast("binary")).alias("h"), F.array(*raw).alias("hits"))


def _digits(c: str) -> Column:
    return F.regexp_replace(F.col(c), "[^0-9]", "")


def occurrences(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, h, kind 0..3 or null, start, end, text, w2, w1): base spans, and tokens that touch none."""
    rows = found.where("exists(hits, x -> x is not null)").dropDuplicates([id_col, "h"])
    rows = rows.select(id_col, "h", F.posexplode("hits").alias("kind", "of")).where("of is not null")
    rows = rows.select(id_col, "h", "kind", F.posexplode("of").alias("i", "x")).select(
        id_col, "h", "kind", "i", F.col("x.m").alias("m"), F.col("x.gap").alias("gap"), F.col("x.left").alias("left"))
    upto = Window.partitionBy(id_col, "h", "kind").orderBy("i")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.length("m")).over(upto))
    rows = rows.withColumn("start", F.col("end") - F.length("m"))
    # The text before a match, over the matches before it: a match and its gap are two code points at least, but for a first one.
    piece = F.right(F.concat("left", "m"), F.lit(CONTEXT))
    past = F.collect_list(piece).over(upto.rowsBetween(-CONTEXT // 2, -1))
    rows = rows.withColumn("left", F.right(F.concat(F.array_join(past, ""), "left"), F.lit(CONTEXT)))
    n = F.length(_digits("m"))
    fine = (F.when(F.col("kind") == 1, F.regexp_like("m", F.lit(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")))
            .when(F.col("kind") == 2, n.between(14, 19) & F.call_function("luhn_check", _digits("m")))
            .when(F.col("kind") == 3, n.between(10, 15)).otherwise(True))
    rows = rows.where(fine)
    # Candidates without the marks around them.
    head = F.regexp_extract("m", "^[^0-9A-Za-z@+]*", 0)
    bare = F.regexp_replace(F.regexp_replace("m", "^[^0-9A-Za-z@+]+", ""), "[^0-9A-Za-z]+$", "")
    loose = F.col("kind") == len(KINDS)
    rows = rows.withColumn("text", F.when(loose, bare).otherwise(F.col("m")))
    rows = rows.withColumn("start", F.when(loose, F.col("start") + F.length(head)).otherwise(F.col("start")))
    rows = rows.withColumn("end", F.col("start") + F.length("text")).withColumn("kind", F.when(~loose, F.col("kind")))
    # A token touches a base span if one that begins before its end ends after its start.
    near = Window.partitionBy(id_col, "h").orderBy("start", F.col("kind").asc_nulls_last())
    back = Window.partitionBy(id_col, "h").orderBy(F.col("start").desc(), F.col("kind").desc_nulls_first())
    reach = F.max(F.when(F.col("kind").isNotNull(), F.col("end"))).over(near.rowsBetween(Window.unboundedPreceding, -1))
    # In reverse order, since a frame that ends at the last row is gone through anew for each row.
    ahead = F.min(F.when(F.col("kind").isNotNull(), F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("reach", reach).withColumn("ahead", ahead)
    free = (F.coalesce("reach", F.lit(-1)) <= F.col("start")) & (F.coalesce("ahead", F.col("end")) >= F.col("end"))
    rows = rows.where(F.col("kind").isNotNull() | (free & (F.col("text") != "")))
    words = F.regexp_extract_all(F.lower("left"), F.lit(r"[\p{L}\p{N}]+[:=]*"), F.lit(0))
    return rows.select(id_col, "h", "kind", "start", "end", F.lower("text").alias("text"),
                       F.coalesce(F.try_element_at(words, F.lit(-2)), F.lit("")).alias("w2"),
                       F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit("")).alias("w1"))


def reliable_patterns(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(w2, w1, kind, conf) of reliable patterns and (text, kind, sure) of unseen texts when nothing is added any more."""
    edges = stored(found.groupBy("w2", "w1", "text").agg(F.min("kind").alias("seed")), "pii-edges")
    sizes = edges.groupBy("w2", "w1").agg(F.count("*").alias("texts"))
    seeds = edges.where("seed is not null").select("w2", "w1", "text", F.col("seed").alias("kind"), F.lit(1.0).alias("sure"))
    unseen = edges.where("seed is null").select("w2", "w1", "text")
    # Only patterns with a seed or a sure text can gain confidence.
    sure, before = seeds, None
    while True:
        sums = sure.groupBy("w2", "w1", "kind").agg(F.sum("sure").alias("sum"), F.count("*").alias("support"))
        scored = sums.join(sizes, ["w2", "w1"]).withColumn("conf", F.col("sum") / (F.col("texts") + 1))
        reliable = stored(scored.where((F.col("conf") >= MIN_CONFIDENCE) & (F.col("support") >= MIN_SUPPORT))
                          .select("w2", "w1", "kind", "conf"), "pii-patterns")
        said = unseen.join(reliable, ["w2", "w1"])
        texts = stored(said.groupBy("text", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("conf"))))).alias("sure"))
                       .where(F.col("sure") >= MIN_CONFIDENCE), "pii-texts")
        news = texts
        if before is not None:
            was = before.withColumnRenamed("sure", "was")
            news = texts.join(was, ["text", "kind"], "left").where(F.col("was").isNull() | (F.col("sure") - F.col("was") > SETTLED))
        # The next round's patterns follow from the texts, so only these are compared.
        if not news.limit(1).count():
            return reliable, texts
        before = texts
        sure = seeds.unionByName(unseen.join(texts, "text").select("w2", "w1", "text", "kind", "sure"))


def spans(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, h, kind, start, end, base): base spans and the spans that reliable patterns discover."""
    reliable, texts = reliable_patterns(found)
    new = (found.where("kind is null").drop("kind").join(reliable, ["w2", "w1"]).join(texts.select("text", "kind"), ["text", "kind"]))
    # One kind for a place: the most confident pattern's.
    new = new.groupBy(id_col, "h", "start", "end").agg(F.max(F.struct("conf", (-F.col("kind")).alias("k")))["k"].alias("k"))
    base = found.where("kind is not null").select(id_col, "h", "kind", "start", "end", F.lit(True).alias("base"))
    return base.unionByName(new.select(id_col, "h", (-F.col("k")).alias("kind"), "start", "end", F.lit(False).alias("base")))


def _per_text(all_spans: DataFrame, id_col: str) -> DataFrame:
    """(id, h, spans): a text's spans in order of start and kind."""
    one = F.struct("start", "kind", "end", "base")
    return all_spans.groupBy(id_col, "h").agg(F.array_sort(F.collect_list(one)).alias("spans"))


def _joined(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row; the counts are of base spans."""
    raw = stored(hits(docs, id_col), "pii-hits")
    found = stored(occurrences(raw, id_col), "pii-occurrences")
    per = _per_text(spans(found, id_col), id_col)
    # Rows without any match need no join.
    some = raw.where("exists(hits, x -> x is not null)").select(F.col(id_col).alias("_id"), F.col("h").alias("_h"))
    some = some.join(per, F.col("_id").eqNullSafe(F.col(id_col)) & (F.col("_h") == F.col("h")), "left").select(F.col("_id").alias(id_col), "spans")
    none = raw.where("not exists(hits, x -> x is not null)").select(id_col).withColumn("spans", F.lit(None).cast(some.schema["spans"].dataType))
    every = some.unionByName(none).withColumn("spans", F.coalesce("spans", F.array().cast(some.schema["spans"].dataType)))
    base = F.filter("spans", lambda s: s["base"])
    of = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.array_remove(of, k)).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    counts = [(F.size(of) - n).cast("long").alias(f"n_{name}") for n, name in zip(counts, KINDS, strict=True)]
    return every.select(id_col, *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _replaced(text: Column, spans: Column) -> Column:
    """``text`` with ``spans`` (start, kind, end, reach: the end of those before) replaced by their kinds.

    A substring of a string is counted off from its beginning, so the text is cut as UTF-32 bytes, four a code
    point, which takes time in proportion to the text however many spans it has.
    """
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def cut(wide: Column, start: Column, size: Column) -> Column:
        # The decoder takes the mark put before a piece, and so none that the piece begins with.
        return F.decode(F.concat(F.lit(MARK), F.substring(wide, 4 * start + 1, 4 * size)), "UTF-32")

    def whole(wide: Column) -> Column:
        pieces = F.transform(spans, lambda s: F.when(s["start"] >= s["reach"], F.concat(
            cut(wide, s["reach"], s["start"] - s["reach"]), F.get(names, s["kind"]))).otherwise(F.lit("")))
        rest = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(pieces, ""), cut(wide, rest, F.length(text) - rest))

    # An array of one, so that the bytes are made once and not for every span.
    return F.get(F.transform(F.array(F.encode(text, "UTF-32")), whole), F.lit(0))


def redact(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with each span replaced by its kind in capitals and angle brackets; touching spans become one."""
    found = stored(occurrences(stored(hits(docs, id_col), "pii-hits"), id_col), "pii-occurrences")
    all_spans = spans(found, id_col)
    before = Window.partitionBy(id_col, "h").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    marked = all_spans.withColumn("reach", F.coalesce(F.max("end").over(before), F.lit(0)))
    one = F.struct("start", "kind", "end", "reach")
    per = marked.groupBy(F.col(id_col).alias("_id"), F.col("h").alias("_h")).agg(F.array_sort(F.collect_list(one)).alias("_spans"))
    per = stored(per, "pii-spans")
    new = _replaced(F.coalesce(F.col("text"), F.lit("")), F.col("_spans"))
    plain = aside(docs, id_col, "text")
    joined = join_texts(plain, per, id_col, pack=False)
    changed = joined.withColumn("text", F.when(F.col("_spans").isNotNull(), new).otherwise(F.col("text")))
    return changed.select(*plain.columns).toDF(*docs.columns)
