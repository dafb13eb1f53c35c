"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

A language is a probability for each piece of the vocabulary. The probability of a word is the sum
over all its segmentations into pieces of the product of their probabilities (a forward pass over
the word's matches); a text's is the product over its words. Words are the runs of letters of the
lower-cased text, begun with U+2581; a letter that no piece covers costs a fixed small probability.

Training is expectation maximisation on word counts by language: all learning texts are counted
(in each task, then by Spark), and in each round a forward-backward pass over every distinct word
gives the expected piece counts, which are summed by Spark and smoothed. The start is the same for
all languages: probabilities falling with the piece's rank in the vocabulary. The model on the
driver has at most pieces x languages numbers.

Prediction: the learned language of the largest text probability (equal: the alphabetically
first), and as score its share of the sum over languages. ``und`` with score 0 for a null text or
one without a letter. All languages start equal, however many texts each has. Repeated rows count
as often as they occur. Texts whose language is null are not learned from; without any learning
text everything is ``und``. An empty table gives an empty result. Other columns are not read.
Words of up to SHORT letters are passed over side by side in arrays, longer ones one by one with
scaling; those over MEMO_CHARS are not kept between texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelworks.llm.common import per_document, steps, stored

SPACE = "▁"
UNKNOWN = 1e-9  # probability of a letter that no piece covers
SMOOTHING = 0.01  # added to each expected piece count
LEAST = 1e-11  # least probability of a piece
#: Longest word of the side-by-side passes; SHORT + 1 pieces of least probability are still above the smallest float.
SHORT = 24
MEMO_CHARS, MEMO_SIZE = 64, 500_000
_BASE = 0x9E3779B97F4A7C15
#: Distinct words a task counts before it hands its counts on; sums by Spark follow.
COUNT_WORDS = 200_000
_WORD = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=2)
def pieces(path: str) -> tuple[str, ...]:
    """The vocabulary: the model file's pieces of letters, in lower case, in order of rank."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = (lib.id_to_piece(i) for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i)))
    kept = (p.lower() for p in plain if p == SPACE or _WORD.fullmatch(p.removeprefix(SPACE)))
    return tuple(dict.fromkeys(kept))


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def matches(word: str, vocabulary: dict, longest: int) -> list[list[tuple[int, str]]]:
    """For each end (from 1) in SPACE + word the (start, piece) that end there; none: the letter alone with ''."""
    s = SPACE + word
    out = []
    for end in range(1, len(s) + 1):
        found = [(k, p) for k in range(max(0, end - longest), end) if (p := s[k:end]) in vocabulary]
        out.append(found or [(end - 1, "")])
    return out


def expected_counts(word: str, prob: dict[str, float], longest: int) -> dict[str, float]:
    """Expected number of each piece over all segmentations of the word; scaled, so long words don't underflow."""
    lattice = matches(word, prob, longest)
    n = len(lattice)
    fore, scale = [1.0] + [0.0] * n, [1.0] * (n + 1)  # fore[e] is the true value over the product of scale[1..e]
    weights = []
    for end in range(1, n + 1):
        row = []
        for k, p in lattice[end - 1]:
            w = prob.get(p, UNKNOWN)
            for j in range(k + 1, end):
                w /= scale[j]
            row.append((k, p, w))
        total = sum(fore[k] * w for k, _, w in row)
        scale[end] = total or 1.0
        fore[end] = 1.0 if total else 0.0
        weights.append([(k, p, w / scale[end]) for k, p, w in row])
    back = [0.0] * n + [1.0]
    out: dict[str, float] = {}
    for end in range(n, 0, -1):
        for k, p, w in weights[end - 1]:
            share = w * back[end]
            back[k] += share
            if p:
                out[p] = out.get(p, 0.0) + fore[k] * share
    return out


class Lattices:
    """Matches and passes of many short words at once.

    Substrings are looked up by a 64-bit polynomial hash among the hashes of all beginnings of all
    pieces, so a start is followed only as long as some piece goes on. Passes run over the ends (or
    starts) of all words side by side.
    """

    def __init__(self, vocabulary: list[str]):
        self.count, self.longest = len(vocabulary), max(map(len, vocabulary), default=1)
        ids: dict[int, int] = {}
        whole = {p: k for k, p in enumerate(vocabulary)}
        for prefix in {p[:n] for p in vocabulary for n in range(1, len(p) + 1)}:
            h = 0
            for c in prefix:
                h = (h * _BASE + ord(c)) & ((1 << 64) - 1)
            if h in ids:
                raise ValueError("two beginnings of pieces have one hash")
            ids[h] = whole.get(prefix, -1)
        self.keys = np.array(sorted(ids), dtype=np.uint64)
        self.ids = np.array([ids[h] for h in sorted(ids)], dtype=np.int64)

    def matches(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """(word, start, end, piece) of all matches in SPACE + word, and the sizes; piece -1 is a letter that no match ends with."""
        sizes = np.array([len(w) + 1 for w in words])
        points = np.frombuffer((SPACE + SPACE.join(words)).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        first = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(points)) - first[word]
        left = sizes[word] - place
        going, h = np.arange(len(points)), np.zeros(len(points), dtype=np.uint64)
        found = []
        for n in range(1, self.longest + 1):
            keep = left[going] >= n
            going, h = going[keep], h[keep]
            if not len(going):
                break
            h = h * np.uint64(_BASE) + points[going + (n - 1)]
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            keep = self.keys[at] == h
            going, h, piece = going[keep], h[keep], self.ids[at[keep]]
            is_piece = piece >= 0
            start = going[is_piece]
            found.append((word[start], place[start], place[start] + n, piece[is_piece], start + n - 1))
        w, start, end, piece, last = (np.concatenate(x) for x in zip(*found, strict=True))
        open_ = np.ones(len(points), dtype=bool)
        open_[last] = False
        alone = np.flatnonzero(open_)
        return (np.r_[w, word[alone]], np.r_[start, place[alone]], np.r_[end, place[alone] + 1],
                np.r_[piece, np.full(len(alone), -1)], sizes)

    @staticmethod
    def _sweep(table: np.ndarray, into: np.ndarray, out_of: np.ndarray, w: np.ndarray, p: np.ndarray, steps: range) -> None:
        """table[w, into] = sum of table[w, out_of] * p over the matches of (w, into), one value of ``into`` after another."""
        order = np.lexsort((w, into))
        into, out_of, w, p = into[order], out_of[order], w[order], p[order]
        for step in steps:
            a, b = np.searchsorted(into, [step, step + 1])
            if a < b:
                ww = w[a:b]
                new = np.flatnonzero(np.r_[True, ww[1:] != ww[:-1]])
                table[ww[new], step] = np.add.reduceat(table[ww, out_of[a:b]] * p[a:b], new, axis=0)

    def forward(self, words: list[str], probs: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language; ``probs`` has a row per piece and a last one for unknown letters."""
        w, start, end, piece, sizes = self.matches(words)
        table = np.zeros((len(words), int(sizes.max()) + 1, probs.shape[1]))
        table[:, 0] = 1.0
        self._sweep(table, end, start, w, probs[piece], range(1, table.shape[1]))
        return np.log(table[np.arange(len(words)), sizes])

    def expected(self, words: list[str], times: np.ndarray, prob: np.ndarray) -> np.ndarray:
        """Expected number of each piece in ``times`` copies of each word, in one language."""
        w, start, end, piece, sizes = self.matches(words)
        n, p = len(words), prob[piece][:, None]
        fore, back = (np.zeros((n, int(sizes.max()) + 1, 1)) for _ in range(2))
        fore[:, 0] = back[np.arange(n), sizes] = 1.0
        self._sweep(fore, end, start, w, p, range(1, fore.shape[1]))
        self._sweep(back, start, end, w, p, range(fore.shape[1] - 1, -1, -1))
        share = (fore[w, start] * p * back[w, end])[:, 0] / fore[np.arange(n), sizes, 0][w] * times[w]
        known = piece >= 0
        return np.bincount(piece[known], weights=share[known], minlength=self.count)


@lru_cache(maxsize=2)
def lattices(vocabulary: tuple[str, ...]) -> Lattices:
    return Lattices(list(vocabulary))


@dataclass
class Model:
    """Languages in alphabetical order, the pieces, and the probability of each piece (row) in each language."""

    languages: list[str]
    vocabulary: tuple[str, ...]
    table: np.ndarray

    def __post_init__(self):
        self.longest = max(map(len, self.vocabulary), default=1)
        self.rows = np.vstack([self.table, np.full((1, len(self.languages)), UNKNOWN)]) if self.languages else self.table
        self.probs: dict[str, int] = {p: k for k, p in enumerate(self.vocabulary)}
        self.memo: dict[str, int] = {}
        self.logs = np.empty((0, len(self.languages)))

    def __getstate__(self):
        return {"languages": self.languages, "vocabulary": self.vocabulary, "table": self.table}

    def __setstate__(self, state):
        self.__init__(**state)

    def word(self, word: str) -> np.ndarray:
        """Log probability of the word in each language, all segmentations summed; of any length."""
        fore, logs = [np.ones(len(self.languages))], [0.0]  # fore[e] has been divided by e**logs[e]
        for found in matches(word, self.probs, self.longest):
            base = max(logs[k] for k, _ in found)
            total = sum(fore[k] * self.rows[self.probs.get(p, -1)] * math.exp(logs[k] - base) for k, p in found)
            top = float(total.max())
            if top < 1e-200:
                total, base = np.maximum(total / top, 1e-300), base + math.log(top)
            fore.append(total)
            logs.append(base)
        return np.log(fore[-1]) + logs[-1]

    def _learn(self, new: list[str]) -> None:
        """Log probabilities of words that are not in the memo yet."""
        if not new:
            return
        short, long_ = ([w for w in new if (len(w) <= SHORT) == is_short] for is_short in (True, False))
        parts, step = [self.logs], max(256, 65_536 // len(self.languages))
        short.sort(key=len)
        parts += [lattices(self.vocabulary).forward(short[k:k + step], self.rows) for k in range(0, len(short), step)]
        if long_:
            parts.append(np.array([self.word(w) for w in long_]))
        for w in [*short, *long_]:
            self.memo[w] = len(self.memo)
        self.logs = np.concatenate(parts)

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        counted = [Counter(words(t)) if self.languages and any(c.isalpha() for c in t) else None for t in texts]
        kept = {w for c in counted if c for w in c if len(w) <= MEMO_CHARS}
        if len(self.memo) > MEMO_SIZE:
            self.memo, self.logs = {}, self.logs[:0]
        self._learn([w for w in kept if w not in self.memo])
        out = []
        for found in counted:
            if not found:
                out.append(("und", 0.0))
                continue
            known = [w for w in found if len(w) <= MEMO_CHARS]
            logs = np.array([found[w] for w in known], dtype=float) @ self.logs[[self.memo[w] for w in known]]
            for w in found.keys() - known:
                logs = logs + found[w] * self.word(w)
            best = int(logs.argmax())
            out.append((self.languages[best], float(1.0 / np.exp(logs - logs[best]).sum())))
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def batch() -> pa.RecordBatch:
        columns = zip(*((lang, w, n) for (lang, w), n in counts.items()), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "word", "n"])

    for whole in batches:
        for part in steps(whole):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                for w, n in Counter(words(text)).items():
                    counts[lang, w] += n
            if len(counts) >= COUNT_WORDS:
                yield batch()
                counts.clear()
    if counts:
        yield batch()


def _expect(languages: list[str], vocabulary: tuple[str, ...], table: np.ndarray):
    """Expected piece counts of a task's (lang, word, n) rows, summed by language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, longest = {x: k for k, x in enumerate(languages)}, max(map(len, vocabulary))
        rows, shared, whole = np.vstack([table, np.full((1, len(languages)), UNKNOWN)]), lattices(vocabulary), {p: k for k, p in enumerate(vocabulary)}
        sums = np.zeros(table.shape)
        for batch in batches:
            by: dict[str, list] = {}
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by.setdefault(lang, []).append((word, n))
            for lang, some in by.items():
                k = place[lang]
                short = sorted((x for x in some if len(x[0]) <= SHORT), key=lambda x: len(x[0]))
                if short:
                    sums[:, k] += shared.expected([w for w, _ in short], np.array([n for _, n in short], dtype=float), rows[:, k])
                for word, n in some:
                    if len(word) > SHORT:
                        prob = {p: rows[whole[p], k] for found in matches(word, whole, longest) for _, p in found if p}
                        for p, x in expected_counts(word, prob, longest).items():
                            sums[whole[p], k] += n * x
        for k, lang in enumerate(languages):
            at = np.flatnonzero(sums[:, k])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(sums[at, k])], names=["lang", "piece", "x"])

    return run


def train(docs: DataFrame, model_path: str, rounds: int = 1) -> Model:
    """Learn from the text and non-null lang of all rows of ``docs``."""
    vocabulary = pieces(model_path)
    known = docs.where("lang is not null and text is not null").select("lang", "text")
    counts = stored(known.mapInArrow(_count, "lang string, word string, n long")
                    .groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid-words")
    languages = [r.lang for r in counts.select("lang").distinct().orderBy("lang").collect()]
    start = 1 / np.arange(2.0, len(vocabulary) + 2)
    table = np.repeat((start / start.sum())[:, None], len(languages), axis=1)
    for _ in range(rounds if languages else 0):
        # Sums of floats in the order of Spark's tasks; they are rounded, so that a rerun gives the same model.
        found = (counts.repartition("word").mapInArrow(_expect(languages, vocabulary, table), "lang string, piece long, x double")
                 .groupBy("lang", "piece").agg(F.round(F.sum("x"), 6).alias("x")).collect())
        sums = np.full(table.shape, SMOOTHING)
        for lang, piece, x in found:
            sums[piece, languages.index(lang)] += x
        table = np.maximum(sums / sums.sum(axis=0), LEAST)
    return Model(languages, vocabulary, table)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(id, lang_pred, score) of every text."""
    return _predict(docs, model, [id_col], f"{id_col} long")


def label(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text, source, n_chars) with lang_pred and score beside the text, in one pass."""
    d = docs.select("doc_id", "source", "n_chars", F.col("text").alias("whole"), "text")
    return _predict(d, model, ["doc_id", "source", "n_chars", "whole"], "doc_id long, source string, n_chars long, whole string"
                    ).withColumnRenamed("whole", "text")


def _predict(docs: DataFrame, model: Model, columns: list[str], schema: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most pieces x languages numbers

    def run(texts: list[str]) -> list[tuple]:
        return shared.value.predict(texts)

    return per_document(docs, columns, run, f"{schema}, lang_pred string, score double")
