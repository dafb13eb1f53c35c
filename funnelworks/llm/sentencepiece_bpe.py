"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding is the merge procedure itself: the symbols of a text are its characters (a space is
U+2581, one is put in front), an agenda holds the adjacent pairs that form a piece, ordered by
score and then from left to right, and the best pair is merged until the agenda is empty; what is
no piece falls back to its UTF-8 bytes. No piece has a non-space before a space, so no merge
crosses into a run of spaces: a text is encoded space by space, and each distinct stretch once per
worker (a bounded memo). The agendas of short stretches are kept side by side as the rows of one
array, and one step merges the best pair of each; a long stretch has a heap. Every stretch that is
encoded so is encoded by the sentencepiece library too, in one call per Arrow batch, and a
difference ends the job. Decoding is the library's ``decode(ids)``.

Null and empty texts encode to the end id alone and decode to ''. Long texts and long stretches
are encoded whole (stretches over MEMO_CHARS are not kept). Repeated rows give repeated results;
an empty table gives an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain, pairwise

import numpy as np
from pyspark.sql import DataFrame

from funnelworks.llm.common import per_document

SPACE = "▁"
#: Longest stretch that is kept in the memo, and the number of entries at which the memo starts anew.
MEMO_CHARS, MEMO_SIZE = 64, 400_000
#: Longest stretch whose agenda is a row of an array, and rows of such an array.
ROW_CHARS, ROWS = 30, 16_384
_STRETCH = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class MergeEncoder:
    """A sentencepiece BPE model file, encoded with an agenda of adjacent symbol pairs."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        special = [i for i in range(n) if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i)]
        self.bytes = {lib.id_to_piece(i): i for i in special if lib.is_byte(i)}
        self.bytes = [self.bytes[f"<0x{b:02X}>"] for b in range(256)]
        self.ids = {lib.id_to_piece(i): i for i in set(range(n)).difference(special)}
        self.cost = {p: -lib.get_score(i) for p, i in self.ids.items()}
        self.end = lib.eos_id()
        self._tables(n)
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("a piece has a space after another character; texts cannot be cut before spaces")
        if lib.encode(" a  b ") != self.stretches_ids(self.stretches(" a  b ")):
            raise ValueError("the model normalises texts in a way that is not supported")
        # Two plain maps rather than one of pairs, which the garbage collector would walk again and again.
        self.ids_of: dict[str, bytes] = {}
        self.text_of: dict[str, str] = {}
        self.decimal = [str(i) for i in range(n)]

    def _tables(self, n: int) -> None:
        """Arrays for the side-by-side agendas. A symbol is a piece's id, or n + code point where the character is none."""
        self.n = n
        self.symbol = np.arange(n, n + 0x110000, dtype=np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        of = lambda s: self.ids.get(s, n + ord(s) if len(s) == 1 else -1)
        pairs = {(a << 32 | b): i for p, i in self.ids.items() for k in range(1, len(p))
                 if (a := of(p[:k])) >= 0 and (b := of(p[k:])) >= 0}
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ids = np.array([pairs[k] for k in sorted(pairs)], dtype=np.int32)
        self.id_cost = np.full(n, np.inf)
        self.id_cost[list(self.ids.values())] = [self.cost[p] for p in self.ids]

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cost and merged id of pairs; the cost is infinite where a pair forms no piece."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        merged = self.pair_ids[at]
        return np.where((self.pair_keys[at] == key) & (right >= 0), self.id_cost[merged], np.inf), merged

    def merge_rows(self, stretches: list[str]) -> list[list[int]]:
        """``merge`` of many short stretches at once; each row holds one agenda in text order."""
        size = np.array([len(s) + 1 for s in stretches])
        wide, count = int(size.max()), len(stretches)
        sym = np.full((count, wide + 1), -1, dtype=np.int32)
        points = np.frombuffer((SPACE + SPACE.join(stretches)).encode("utf-32-le"), dtype=np.uint32)
        cells = np.arange(wide + 1) < size[:, None]
        sym[cells] = self.symbol[points]
        cost, merged = self._look_up(sym[:, :-1], sym[:, 1:])
        at, column = np.arange(count), np.arange(wide)
        while True:
            best = cost[at].argmin(axis=1)  # the leftmost of equals
            going = np.isfinite(cost[at, best])
            at, best = at[going], best[going]
            if not len(at):
                break
            sym[at, best] = merged[at, best]
            # What stands right of the merged pair moves up by one; the last column of sym stays empty.
            source = column + (column > best[:, None])
            sym[at[:, None], column] = sym[at[:, None], source]
            source = np.minimum(column + (column >= best[:, None]), wide - 1)
            cost[at[:, None], column] = cost[at[:, None], source]
            merged[at[:, None], column] = merged[at[:, None], source]
            cost[at, wide - 1] = np.inf
            cost[at, best], merged[at, best] = self._look_up(sym[at, best], sym[at, best + 1])
            near = best > 0
            a, k = at[near], best[near] - 1
            cost[a, k], merged[a, k] = self._look_up(sym[a, k], sym[a, k + 1])
            size[at] -= 1
        flat, odd = sym[sym >= 0].tolist(), np.flatnonzero((sym >= self.n).any(axis=1)).tolist()
        ends = np.cumsum(size).tolist()
        out = [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        for k in odd:
            out[k] = [j for i in out[k] for j in ([i] if i < self.n else [self.bytes[b] for b in chr(i - self.n).encode()])]
        return out

    @staticmethod
    def stretches(text: str) -> list[str]:
        """Runs of spaces with the characters after them, without the first space of each run."""
        if not text:
            return []
        if "  " not in text and text[0] != " " and text[-1] != " " and SPACE not in text:
            return text.split(" ")
        return [s[1:] for s in _STRETCH.findall(SPACE + text.replace(" ", SPACE))]

    def stretches_ids(self, stretches: list[str]) -> list[int]:
        return [i for s in stretches for i in self.merge(s)]

    def merge(self, stretch: str) -> list[int]:
        """Ids of one stretch, its first space added, by the agenda."""
        sym: list[str] = [SPACE, *stretch]
        n = len(sym)
        after, before, cost = list(range(1, n + 1)), list(range(-1, n - 1)), self.cost
        agenda = [(c, k, p) for k in range(n - 1) if (c := cost.get(p := sym[k] + sym[k + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, left, piece = heapq.heappop(agenda)
            right = after[left]
            if right == n or not sym[left] or sym[left] + sym[right] != piece:
                continue  # one of the two has been merged meanwhile
            sym[left], sym[right] = piece, ""
            after[left] = far = after[right]
            if far < n:
                before[far] = left
                if (c := cost.get(p := piece + sym[far])) is not None:
                    heapq.heappush(agenda, (c, left, p))
            if (near := before[left]) >= 0 and (c := cost.get(p := sym[near] + piece)) is not None:
                heapq.heappush(agenda, (c, near, p))
        out: list[int] = []
        for s in sym:
            if s:
                i = self.ids.get(s)
                out += [i] if i is not None else [self.bytes[b] for b in s.encode()]
        return out

    def learn(self, stretches: list[str]) -> None:
        """Keep ids, as 32-bit integers and as decimal text, of stretches; each is checked against the library."""
        new = {s: self.merge(s) for s in stretches if len(s) > ROW_CHARS}
        short = sorted((s for s in stretches if len(s) <= ROW_CHARS), key=len)
        for k in range(0, len(short), ROWS):
            new.update(zip(short[k:k + ROWS], self.merge_rows(short[k:k + ROWS]), strict=True))
        ours, theirs = list(new.values()), self.lib.encode([s.replace(SPACE, " ") for s in new]) if new else []
        if ours != theirs:
            for s, ids, said in zip(new, ours, theirs, strict=True):
                # The library has no dummy space for an empty text.
                if s and ids != said:
                    raise AssertionError(f"the agenda and the sentencepiece library differ on {s!r}: {ids}, {said}")
        flat, ends = list(chain.from_iterable(ours)), list(accumulate(map(len, ours), initial=0))
        data, names = array("i", flat).tobytes(), list(map(self.decimal.__getitem__, flat))
        self.ids_of.update(zip(new, [data[4 * a:4 * b] for a, b in pairwise(ends)], strict=True))
        self.text_of.update(zip(new, [" ".join(names[a:b]) for a, b in pairwise(ends)], strict=True))

    def encode_texts(self, texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
        """For each text its ids and their decimal texts, both without an end id."""
        cut = [self.stretches(t) for t in texts]
        if len(self.ids_of) > MEMO_SIZE:
            self.ids_of, self.text_of = {}, {}
        fresh = list(set(chain.from_iterable(cut)).difference(self.ids_of))
        # Learning makes many lists and no cycles.
        gc.disable()
        try:
            self.learn(fresh)
        finally:
            gc.enable()
        ids_of, text_of = self.ids_of.__getitem__, self.text_of.__getitem__
        out = [(np.frombuffer(b"".join(map(ids_of, c)), dtype=np.int32).tolist(), list(map(text_of, c))) for c in cut]
        for s in fresh:
            if len(s) > MEMO_CHARS:
                del self.ids_of[s], self.text_of[s]
        return iter(out)


@lru_cache(maxsize=2)
def encoder(path: str) -> MergeEncoder:
    return MergeEncoder(path)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ids): the ids of every text with the end id. ``model_path`` is the same on every machine."""
    def run(texts: list[str]) -> list[tuple]:
        e = encoder(model_path)
        return [([*ids, e.end],) for ids, _ in e.encode_texts(texts)]

    return per_document(docs, [id_col], run, f"{id_col} long, ids array<int>")


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of the ids with the end id and of their decoded text."""
    def run(texts: list[str]) -> list[tuple]:
        e, out = encoder(model_path), []
        end = str(e.end)
        for ids, decimal in e.encode_texts(texts):
            ids.append(e.end)
            digest = hashlib.sha256(" ".join([*decimal, end]).encode()).hexdigest()
            out.append((len(ids), digest, hashlib.sha256(e.lib.decode(ids).encode()).hexdigest()))
        return out

    return per_document(docs, [id_col], run, f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string")
