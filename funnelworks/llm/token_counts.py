"""Unigram token counts without token lists.

The vocabulary is a list of (piece, score). An Aho-Corasick automaton of all pieces enumerates the
matches in a word; a Viterbi pass over the ends carries, for each end, the best score, where its
last piece starts, and how many tokens the best path has. The rules for ties are those of the
tokenizers library's Unigram model: scores are 64-bit floats added from the left; starts are
visited in ascending order and a later path replaces an earlier one only when it scores strictly
more; where no piece is one character long, that character may be unknown, at the lowest score
less 10, and is looked at after the pieces from the same start; a run of unknown characters is one
unknown, written as its UTF-8 bytes where the vocabulary has byte pieces, and as one token otherwise.

Words are what the library's Metaspace pre-tokenizer makes: U+2581 for a space, one in front unless
the text has it, and a cut before each. Equal words are counted once per worker (a bounded memo).

Null and empty texts count 0. Words of any length are counted whole; those over MEMO_CHARS are not
kept. Repeated rows give repeated results; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import DataFrame

from funnelworks.llm.common import per_document

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
MEMO_CHARS, MEMO_SIZE = 64, 1_000_000


def zipf_vocabulary(model_path: str) -> list[tuple[str, float]]:
    """The pieces of a public sentencepiece file with log probabilities that fall with their rank.

    The public files hold no unigram model; this makes one of a merge vocabulary, without training.
    """
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
    n = lib.get_piece_size()
    whole = math.fsum(1 / (k + 1) for k in range(n))
    return [(lib.id_to_piece(k), math.log(1 / (k + 1) / whole)) for k in range(n)]


class TokenCounter:
    """Counts the tokens of words for a unigram vocabulary with the unknown piece at ``unk_id``."""

    def __init__(self, vocabulary: list[tuple[str, float]], unk_id: int = 0, byte_fallback: bool = True):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        has = {p for p, _ in vocabulary}
        self.fallback = byte_fallback and all(f"<0x{b:02X}>" in has for b in range(256))
        self.memo: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Tokens of the best segmentation of ``word`` (with its U+2581)."""
        best, count, is_unknown = [0.0], [0], [False]  # by end
        top, tokens, single = None, 0, False  # of the end that is open, which is len(best)

        def close() -> None:
            nonlocal top, tokens, single
            at, unknown = len(best) - 1, False
            if not single:
                s = best[at] + self.unknown
                if top is None or s > top:
                    top, unknown = s, True
                    tokens = count[at] + (len(word[at].encode()) if self.fallback else not is_unknown[at])
            best.append(top)
            count.append(tokens)
            is_unknown.append(unknown)
            top, tokens, single = None, 0, False

        # The automaton reports ends in ascending order and, of one end, the longest piece first: starts ascend as the library visits them.
        for last, (size, score) in self.automaton.iter(word):
            while len(best) <= last:
                close()
            start = last + 1 - size
            s = best[start] + score
            if top is None or s > top:
                top, tokens = s, count[start] + 1
            if size == 1:
                single = True
        while len(best) <= len(word):
            close()
        return count[-1]

    def text(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(" ", SPACE)
        parts = text.split(SPACE)
        if parts[0]:
            parts.insert(0, "")  # the space put in front
        memo, total = self.memo, 0
        for p in parts[1:]:
            n = memo.get(p)
            if n is None:
                n = self.word(SPACE + p)
                if len(p) <= MEMO_CHARS:
                    if len(memo) > MEMO_SIZE:
                        memo.clear()
                    memo[p] = n
            total += n
        return total


@lru_cache(maxsize=2)
def counter(model_path: str) -> TokenCounter:
    return TokenCounter(zipf_vocabulary(model_path))


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens) of every text for the unigram vocabulary of ``zipf_vocabulary(model_path)``."""
    return per_document(docs, [id_col], lambda texts: [(counter(model_path).text(t),) for t in texts], f"{id_col} long, n_tokens long")
