"""Quality rules as a short-circuit cascade.

A rule is a name, the features it needs and a test of a document. On a bounded sample each rule's
cost (time to compute what it needs and to test it) and rejection rate are measured, and the rules
run in order of rejection per cost: a document that a rule rejects is not looked at by later rules,
and a feature is computed only when a rule asks for it, once. The order changes the work, not the
verdict: a document is kept when no rule rejects it.

Features: words are ``[^\\x20\\x09-\\x0D]+``; ``word_chars`` code points in words; ``n_symbols``
characters of ``[#*$%&|<>]``; ``n_dup_lines`` lines (split at \\n) with a word that equal an earlier
line; ``n_repeat_words`` words inside 5-word windows that occur twice or more, first ones included.

Null and empty texts have no words and are rejected by ``few_words``. Very long texts are read
whole. Repeated rows get equal verdicts. An empty table gives an empty result (and the rules in the
given order). Other columns are not read.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelworks.llm.common import per_document

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: Documents of the sample on which cost and rejection are measured. Verdicts do not depend on it.
SAMPLE_ROWS = 400
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Features:
    """A text's features, each computed when first asked for."""

    def __init__(self, text: str):
        self.text = text

    def __getattr__(self, name: str):
        value = getattr(self, f"_{name}")()
        setattr(self, name, value)
        return value

    def _words(self) -> list[bytes]:
        return self.text.encode().split()  # bytes split at exactly the six ASCII blanks

    def _n_words(self) -> int:
        return len(self.words)

    def _word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, BLANKS))

    def _n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    def _lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(BLANKS)]

    def _n_lines(self) -> int:
        return len(self.lines)

    def _n_dup_lines(self) -> int:
        return self.n_lines - len(set(self.lines))

    def _n_repeat_words(self) -> int:
        w = self.words
        windows = list(zip(w, w[1:], w[2:], w[3:], w[4:]))
        if len(set(windows)) == len(windows):
            return 0
        counts, covered, end = Counter(windows), 0, 0
        for k, window in enumerate(windows):
            if counts[window] > 1:
                covered += k + 5 - max(k, end)
                end = k + 5
        return covered

    def _n_letters(self) -> int:
        return sum(map(str.isalpha, self.text))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Features], bool]


def _few_words(f: Features) -> bool:
    return f.n_words < 10


def _repeated(f: Features) -> bool:
    return 100 * f.n_repeat_words > 20 * f.n_words


def _symbols(f: Features) -> bool:
    return 5 * f.n_symbols > f.n_words


def _word_length(f: Features) -> bool:
    return not 2 * f.n_words <= f.word_chars <= 15 * f.n_words


def _same_lines(f: Features) -> bool:
    return 2 * f.n_dup_lines > f.n_lines


def _no_letters(f: Features) -> bool:
    return 2 * f.n_letters < f.word_chars


RULES = (Rule("few_words", _few_words), Rule("repeated_windows", _repeated), Rule("symbols", _symbols),
         Rule("word_length", _word_length), Rule("same_lines", _same_lines), Rule("few_letters", _no_letters))


@dataclass(frozen=True)
class Measured:
    name: str
    cost: float  # seconds a document
    rejection: float  # share of the sample


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> list[Measured]:
    """Cost and rejection of each rule on a sample of at most ``sample_rows`` texts; the tasks time themselves."""
    whole = docs.count()
    sample = docs.sample(min(1.0, 2 * sample_rows / whole), seed=seed).limit(sample_rows) if whole else docs

    def run(texts: list[str]) -> list[tuple]:
        out = []
        for t in texts:
            spent, said = [], []
            for r in rules:
                f, began = Features(t), time.perf_counter()  # a rule alone pays for all it needs
                said.append(r.rejects(f))
                spent.append(time.perf_counter() - began)
            out.append((spent, said))
        return out

    got = per_document(sample, [], run, "spent array<double>, said array<boolean>")
    sums = got.select(*[F.avg(F.col("spent")[k]) for k in range(len(rules))],
                      *[F.avg(F.col("said")[k].cast("int")) for k in range(len(rules))]).first()
    return [Measured(r.name, sums[k] or 0.0, sums[len(rules) + k] or 0.0) for k, r in enumerate(rules)]


def order(rules: tuple[Rule, ...], measured: list[Measured]) -> tuple[Rule, ...]:
    """Rules by rejection per cost, highest first; equal: the cheaper, then as given."""
    by = {m.name: m for m in measured}
    return tuple(sorted(rules, key=lambda r: (-by[r.name].rejection / max(by[r.name].cost, 1e-9), by[r.name].cost)))


def verdict(f: Features, rules: tuple[Rule, ...]) -> tuple[str | None, int]:
    """The rule that rejects first, and how many rules were asked."""
    for k, r in enumerate(rules):
        if r.rejects(f):
            return r.name, k + 1
    return None, len(rules)


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, features: tuple[str, ...] = (), id_col: str = "doc_id",
            sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, kept, rejected_by, n_asked, *features): the rules in measured order; named features of every text besides."""
    chosen = order(rules, measure(docs, rules, sample_rows))

    def run(texts: list[str]) -> list[tuple]:
        out = []
        for t in texts:
            f = Features(t)
            by, asked = verdict(f, chosen)
            out.append((by is None, by, asked, *(getattr(f, x) for x in features)))
        return out

    return per_document(docs, [id_col], run, f"{id_col} long, kept boolean, rejected_by string, n_asked int"
                        + "".join(f", {x} long" for x in features))
