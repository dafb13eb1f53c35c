"""Toxicity scores: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A document's features are its distinct words' character n-grams: each distinct word (a run of
letters of the lower-cased text, with a blank on both sides) has the n-grams of GRAMS lengths,
hashed to 2^BITS bins; a bin's value is the number of its n-grams in the distinct words. Hashes and
sums of many words are taken side by side in arrays.

Training on labelled rows. First, all learning rows are counted: for each bin, the documents of
either label that have it. Its log-count ratio is ``log((p1 + 1) / N1) - log((p0 + 1) / N0)`` with
the usual smoothing, and scales the bin's value. The FEATURES bins of largest evidence (the difference
of the two rates in standard errors) are features of their own; the scaled values of all other bins
that occur are summed to one more feature, so every n-gram of a text has a say. Then a logistic regression
(Spark ML) is fitted to the features of at most ``fit_rows`` rows, a sample by a hash of the id. Only
the fit is bounded; counts cover all rows. The model has one weight per n-gram bin.

Texts meet their labels in a shuffle of compressed texts, at every size, and are then stored so.

A score is the logistic function of the sum of the distinct words' weights and an intercept. Null
and empty texts and texts without letters score the intercept alone. Rows with a null label are not
learned from; without rows of both labels every score is the share of label 1 (0 without rows).
Repeated rows count as often as they occur. Long texts and words are read whole. An empty table
gives an empty result. Columns other than id, text and label are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelworks.llm.common import packed, per_document, steps, stored

GRAMS = (3, 4, 5, 6)
BITS = 18
FEATURES = 16_384
#: Most rows to which the logistic regression is fitted.
FIT_ROWS = 20_000
#: Words of at most MEMO_CHARS letters are kept with their weight; words of a step are hashed in groups of about GROUP_CHARS letters.
MEMO_CHARS, MEMO_SIZE, GROUP_CHARS = 64, 1_000_000, 200_000
_WORD = re.compile(r"[^\W\d_]+")
_PRIME, _ODD = 0x100000001B3, np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def word_bins(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word's place in ``some``, bin) of each n-gram of each word, in that order."""
    sizes = np.fromiter(map(len, some), dtype=np.int64, count=len(some)) + 1
    # A word owns the blank before it and its letters; its n-grams may end on the blank after it.
    owner = np.repeat(np.arange(len(some), dtype=np.int32), sizes)
    n = len(owner)
    points = np.frombuffer((" " + " ".join(some) + " " * max(GRAMS)).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(n) + 1
    found, fits = np.empty((n, len(GRAMS)), dtype=np.int32), np.empty((n, len(GRAMS)), dtype=bool)
    h, factor = np.zeros(n, dtype=np.uint64), 1
    for k in range(max(GRAMS)):
        factor = (factor * _PRIME + 2 * k + 1) % (1 << 64)
        h += points[k:k + n] * np.uint64(factor | 1)
        if k + 1 in GRAMS:
            mixed = (h + np.uint64(k)) * _ODD
            mixed ^= mixed >> np.uint64(29)
            mixed *= _ODD
            at = GRAMS.index(k + 1)
            found[:, at] = mixed >> np.uint64(64 - BITS)
            np.greater(room, k, out=fits[:, at])
    return np.repeat(owner, fits.sum(axis=1)), found[fits]


def _groups(some: list[str]) -> Iterator[list[str]]:
    """``some`` in runs of about GROUP_CHARS letters, so that the arrays of a run stay small."""
    run, size = [], 0
    for w in some:
        run.append(w)
        size += len(w) + 1
        if size >= GROUP_CHARS:
            yield run
            run, size = [], 0
    if run:
        yield run


def document_bins(texts: list[str]) -> Iterator[np.ndarray]:
    """For each text the bins of its distinct words' n-grams, repeats included."""
    cut = [words(t) for t in texts]
    place: dict[str, int] = {}
    for c in cut:
        for w in c:
            place.setdefault(w, len(place))
    ends, bins, before = [np.zeros(1, dtype=np.int64)], [], 0
    for run in _groups(list(place)):
        owner, found = word_bins(run)
        ends.append(before + np.cumsum(np.bincount(owner, minlength=len(run))))
        bins.append(found)
        before += len(found)
    ends, bins = np.concatenate(ends).tolist(), np.concatenate(bins) if bins else np.empty(0, dtype=np.int64)
    for c in cut:
        yield np.concatenate([bins[ends[k]:ends[k + 1]] for k in map(place.__getitem__, c)]) if c else bins[:0]


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bin, label 0 documents, label 1 documents) of a task's rows (compressed text, label)."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    counts, last = np.zeros((2, 1 << BITS), dtype=np.int64), np.zeros(1 << BITS, dtype=np.int64)
    for whole in batches:
        for part in steps(whole):
            labels = part.column(1).to_pylist()
            for label, bins in zip(labels, document_bins([unpack(t).decode() for t in part.column(0).to_pylist()]), strict=True):
                at = np.arange(len(bins))
                last[bins] = at
                counts[label, bins[last[bins] == at]] += 1  # a document counts once
    any_ = np.flatnonzero(counts.any(axis=0))
    for k in range(0, len(any_), 65_536):
        at = any_[k:k + 65_536]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0, at]), pa.array(counts[1, at])], names=["bin", "n0", "n1"])


@dataclass
class Model:
    """Weight by bin (the regression's weight times the bin's log-count ratio) and the intercept."""

    weights: np.ndarray
    intercept: float
    memo: dict[str, float] = field(default_factory=dict)

    def __getstate__(self):
        return {"weights": self.weights, "intercept": self.intercept, "memo": {}}

    def scores(self, texts: list[str]) -> list[float]:
        cut = [words(t) for t in texts]
        if len(self.memo) > MEMO_SIZE:
            self.memo = {}
        memo = self.memo
        new = list(set().union(*cut).difference(memo))
        for run in _groups(new):
            owner, bins = word_bins(run)
            memo.update(zip(run, np.bincount(owner, self.weights[bins], minlength=len(run)).tolist(), strict=True))
        out = []
        for c in cut:
            z = math.fsum([self.intercept, *map(memo.__getitem__, c)])  # exact, whatever the order of the words
            out.append(1 / (1 + math.exp(-z)) if z > -700 else 0.0)
        for w in new:
            if len(w) > MEMO_CHARS:
                del memo[w]
        return out


def ratios(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Log-count ratio by bin (0 where none occurs) over all of ``rows`` (compressed text, label), the FEATURES bins with most evidence, N0, N1.

    The driver gets one row per bin, 2^BITS at most.
    """
    n0, n1 = rows.agg(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).first()
    ratio = np.zeros(1 << BITS)
    if not n0 or not n1:
        return ratio, np.empty(0, dtype=np.int64), n0, n1
    counts = rows.mapInArrow(_presence, "bin long, n0 long, n1 long").groupBy("bin").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    p0, p1 = (F.col("n0") + 1) / F.lit(n0 + 2.0), (F.col("n1") + 1) / F.lit(n1 + 2.0)
    pooled = (F.col("n0") + F.col("n1") + 1) / F.lit(n0 + n1 + 2.0)
    evidence = F.abs(p1 - p0) / F.sqrt(pooled * (1 - pooled + 1e-9) * (1 / n0 + 1 / n1))
    got = counts.select("bin", F.log(p1 / p0).alias("ratio"), evidence.alias("evidence")).toArrow()
    bins, values, evidence = (got.column(k).to_numpy() for k in range(3))
    ratio[bins] = values
    return ratio, np.sort(bins[np.lexsort((bins, -evidence))[:FEATURES]]), n0, n1


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` (id, text) with the ``label`` that ``labels`` (id, label) has for them, texts compressed; stored.

    The labels are the side that is hashed in each task, at every size.
    """
    docs = packed(docs.select(id_col, F.coalesce("text", F.lit("")).alias("text")))
    return stored(docs.join(labels.select(id_col, "label").hint("shuffle_hash"), id_col), "toxicity-labelled")


def train(rows: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id") -> Model:
    """Fit to ``rows`` (id, compressed text, label) as ``labelled`` makes them; labels are 0 or 1."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import SparseVector, VectorUDT

    rows = rows.where(F.col("label").isin(0, 1)).select(id_col, "text", F.col("label").cast("int").alias("label"))
    ratio, chosen, n0, n1 = ratios(rows.select("text", "label"))
    if not len(chosen):
        share = n1 / (n0 + n1) if n0 + n1 else 0.0
        return Model(ratio, math.log(share / (1 - share)) if 0 < share < 1 else (50.0 if share else -800.0))
    place = np.full(1 << BITS, len(chosen), dtype=np.int64)  # bins that are no features share the last place
    place[chosen] = np.arange(len(chosen))
    shared = rows.sparkSession.sparkContext.broadcast((place, ratio))  # 2^BITS entries

    @F.udf(VectorUDT())
    def features(data):
        import zstandard

        to, scale = shared.value
        bins = next(document_bins([zstandard.ZstdDecompressor().decompress(bytes(data)).decode()]))
        values = np.bincount(to[bins], scale[bins], minlength=len(chosen) + 1)
        at = np.flatnonzero(values)
        return SparseVector(len(values), at, values[at])

    share = min(1.0, fit_rows / (n0 + n1))
    # A uniform sample by a hash of the id; the limit holds the bound where the hash is a little uneven.
    sample = rows.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < int(share * 1_000_000) + (share == 1.0)).limit(fit_rows)
    fitted = stored(sample.repartition(12).select(F.col("label").cast("double").alias("label"), features("text").alias("features")), "toxicity-fit").cache()
    try:
        lr = LogisticRegression(maxIter=40, regParam=1e-4, elasticNetParam=0.0, standardization=False, tol=1e-5).fit(fitted)
    finally:
        fitted.unpersist()
    return Model(lr.coefficients.toArray()[place] * ratio, float(lr.intercept))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(id, score) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return per_document(docs, [id_col], lambda texts: [(x,) for x in shared.value.scores(texts)], f"{id_col} long, score double")
