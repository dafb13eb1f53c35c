"""Token ids in Arrow stream files of fixed-size-list batches.

Format: a folder of Arrow IPC stream files. A file holds the ids of a range of documents, one after
another in ascending id order, cut into sequences of ``length`` ids; the columns are ``ids``
(fixed_size_list<uint16 or uint32>[length], 16 bits where the vocabulary allows) and ``mask``
(fixed_size_list<bool>[length], true for an id, false for the padding behind the last id of a file).
All batches of a file but the last have ``rows`` sequences, so they take equally many bytes and
batch k is found by arithmetic: ``SequenceFile`` maps a file into memory and gives any sequence as
a view of the mapped bytes, without a copy. Beside the files stand two Parquet tables: ``index``
(a row per document: file, first id within it, number of ids) and ``files`` (a row per file: its
first id in the whole stream, its number of ids).

Encoding: the documents of a range are encoded in chunks of about ``CHUNK_BYTES`` of text. A chunk is cut into the stretches
between spaces, tabs and line ends as one Arrow array; the tokenizers library encodes each distinct stretch, and each distinct
run of letters in one, once per chunk, and the ids of all stretches are taken from those by their places. That is exact
for a vocabulary whose normaliser and pre-tokenizer do not look across white space, which ``StretchEncoder`` asks for by name;
for any other vocabulary whole texts go to the library.

Null and empty texts hold the end id alone. Texts of any length are encoded whole; a document may
span many sequences. Rows with equal ids stand in the order of their packed texts; null ids come first.
An empty table writes no file and reads back as no rows. Other columns are not read. A task that
is run again writes a new file; ``files`` names the files of the attempts that counted.
"""

from __future__ import annotations

import json
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelworks.llm.common import scratch, split_points, steps, stored

#: Runs of letters that the library gets as one text, and texts that it gets at once.
RUNS = 512
#: Bytes of text that are encoded together, about, and what a row counts beside its text.
CHUNK_BYTES, ROW_BYTES = 16_000_000, 64
#: Ids of a sequence, sequences of a batch, and bytes of text of a file, about.
LENGTH, ROWS, FILE_BYTES = 2048, 64, 16_000_000
NULL_ID = -(1 << 63)
#: Letters below U+0100; a stretch of those, perhaps with a mark, or of any letters, and the space behind it.
_LETTERS = "[a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+"
_LATIN, _PLAIN = f"^{_LETTERS}$", rf"^(?:{_LETTERS}[.,]?|\pL+) $"
_LOWER = "".join(chr(k) for k in range(256) if chr(k).isalpha() and chr(k).lower() == chr(k))
#: By byte: whether it is a space, tab or line end.
_GAP = np.isin(np.arange(256), list(b" \t\n\r"))


class StretchEncoder:
    """A tokenizers file; ids as bytes of ``dtype``, little-endian."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer, pre_tokenizers

        self.lib = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if max(self.lib.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        self.end = np.array([end_id], dtype=self.dtype).tobytes()
        self.cuts = self._drops_white_space(json.loads(self.lib.to_str()))
        # The library with the same model for runs of lower-case Latin-1 letters, which normaliser and cuts leave as they are.
        self.bare = Tokenizer(self.lib.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = json.loads(self.lib.to_str())["model"].get("end_of_word_suffix")
        self.ends_word = None
        if suffix and self.cuts and self._keeps_runs():
            size = self.lib.get_vocab_size()
            self.ends_word = np.array([(self.lib.id_to_token(k) or "").endswith(suffix) for k in range(size)])

    @staticmethod
    def _drops_white_space(spec: dict) -> bool:
        """NFC, white space to one space, lower case; then matches without white space, the rest dropped."""
        pre = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        return (steps == ["NFC", "Replace", "Lowercase"] and spec["normalizer"]["normalizers"][1]["pattern"] == {"Regex": r"\s+"}
                and spec["normalizer"]["normalizers"][1]["content"] == " " and len(pre) == 2
                and pre[0].get("type") == "Split" and pre[0]["behavior"] == "Removed" and pre[0]["invert"]
                and " " not in pre[0]["pattern"]["Regex"] and r"[^\s" in pre[0]["pattern"]["Regex"]
                and pre[1]["type"] == "ByteLevel" and not pre[1]["add_prefix_space"] and not pre[1]["use_regex"])

    def _keeps_runs(self) -> bool:
        """Whether each word has one id that ends it, lower-case Latin-1 letters stay as they are and make one word, and runs of
        letters and marks hold no added token."""
        from tokenizers import pre_tokenizers

        spec = json.loads(self.lib.to_str())["model"]
        added = [t.content.strip(".,") for t in self.lib.get_added_tokens_decoder().values()]
        return (all(c + spec["end_of_word_suffix"] in spec["vocab"] for c in pre_tokenizers.ByteLevel.alphabet())
                and self.lib.normalizer.normalize_str(_LOWER) == _LOWER and len(self.lib.pre_tokenizer.pre_tokenize_str(_LOWER)) == 1
                and all(t and not t.isalpha() for t in added))

    def _library(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for k in range(0, len(texts), RUNS):
            found = self.lib.encode_batch_fast(texts[k:k + RUNS], add_special_tokens=False)
            out += [array(self.dtype.char, e.ids).tobytes() for e in found]
        return out

    def _runs(self, runs: list[str], lib) -> list[bytes]:
        """Ids of runs of letters; a run has at least one id that ends a word, so where there are as many as runs, each has its
        last id alone, and many runs go as one text."""
        out: list[bytes] = []
        for k in range(0, len(runs), RUNS):
            some = runs[k:k + RUNS]
            ids = np.array(lib.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype=self.dtype)
            ends = (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
            if len(ends) != len(some):
                out += self._library(some)
                continue
            data, size = ids.tobytes(), self.dtype.itemsize
            out += [data[a * size:b * size] for a, b in zip([0, *ends], ends, strict=False)]
        return out

    def _ids(self, stretches: pa.StringArray) -> pa.ListArray:
        """A list of ids for each distinct stretch (a space stands behind it), and the end id in a last one.

        A run of Latin-1 letters, with a full stop or comma behind it apart, is known by its lower case: such letters
        are composed already, become lower case one by one, and make one word of the pre-tokenizer. Others may end in a
        mark once they are normalised, so a full stop or comma stays with them.
        """
        plain = np.zeros(len(stretches), bool)
        if self.ends_word is not None:
            plain = pc.match_substring_regex(stretches, _PLAIN).to_numpy(zero_copy_only=False)
        runs, others = stretches.filter(pa.array(plain)), stretches.filter(pa.array(~plain))
        runs_only = pc.utf8_rtrim(runs, "., ")
        words = pc.if_else(pc.match_substring_regex(runs_only, _LATIN), pc.utf8_lower(runs_only), runs_only).dictionary_encode()
        latin = pc.match_substring_regex(words.dictionary, _LATIN)
        bare, full = words.dictionary.filter(latin), words.dictionary.filter(pc.invert(latin))
        marks = [".", ","]
        pieces = [b"", *self._library(marks), self.end, *self._runs(bare.to_pylist(), self.bare), *self._runs(full.to_pylist(), self.lib),
                  *self._library(pc.utf8_rtrim(others, " ").to_pylist())]
        places = np.argsort(np.argsort(~latin.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
        first = 2 + len(marks)
        # Two pieces for each stretch: a run and its mark, or the whole and nothing.
        codes = np.zeros((len(stretches) + 1, 2), np.int32)
        codes[:-1][plain, 0] = first + places[words.indices.to_numpy()]
        codes[:-1][~plain, 0] = first + len(places) + np.arange(len(others))
        for k, m in enumerate(marks, 1):
            codes[:-1][plain, 1] += k * pc.ends_with(runs, m + " ").to_numpy(zero_copy_only=False)
        codes[-1, 0] = 1 + len(marks)
        sizes = np.array([0, *map(len, pieces)]) // self.dtype.itemsize
        table = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.frombuffer(b"".join(pieces), self.dtype)))
        pairs = table.take(pa.array(codes.ravel()))
        return pa.ListArray.from_arrays(pa.array(pairs.offsets.to_numpy()[::2]), pairs.values)

    def encode(self, texts: list[bytes]) -> tuple[bytes, np.ndarray]:
        """The ids of texts in UTF-8, the end id behind each, one after another; and how many ids each has."""
        if not self.cuts:
            found = [ids + self.end for ids in self._library([t.decode() for t in texts])]
            return b"".join(found), np.array([len(ids) // self.dtype.itemsize for ids in found], np.int64)
        data = np.frombuffer(bytearray(b" ".join([*texts, b""])), np.uint8)
        gaps = np.flatnonzero(_GAP[data])
        data[gaps] = ord(" ")
        offsets = np.r_[0, gaps + 1].astype(np.int32)
        stretches = pa.StringArray.from_buffers(len(gaps), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        table = self._ids(stretches.dictionary)
        # Behind the last stretch of each text comes the end id.
        ends = np.searchsorted(gaps, np.cumsum(np.array([len(t) + 1 for t in texts], np.int64)) - 1) + 1
        taken = table.take(pa.array(np.insert(stretches.indices.to_numpy(), ends, len(table) - 1)))
        upto = taken.offsets.to_numpy()[ends + np.arange(1, len(ends) + 1)]
        return taken.values.to_numpy().tobytes(), np.diff(upto, prepend=0)

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, and the end id."""
        data, counts = self.encode([t.encode() for t in texts])
        ends = (np.cumsum(counts) * self.dtype.itemsize).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int) -> StretchEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    return StretchEncoder(path, end_id)


def open_file(uri: str):
    """A readable Arrow file: mapped into memory where the folder is on this machine's file systems."""
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    return pa.memory_map(path) if isinstance(fs, pyarrow.fs.LocalFileSystem) else fs.open_input_file(path)


def _schema(length: int, dtype: np.dtype) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Appends ids to one stream file, a batch of ``rows`` full sequences at a time."""

    def __init__(self, uri: str, length: int, rows: int, dtype: np.dtype):
        fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.schema, self.length, self.dtype = _schema(length, dtype), length, dtype
        self.sink = fs.open_output_stream(path)
        self.stream = pa.ipc.new_stream(self.sink, self.schema)
        self.batch_bytes = length * rows * dtype.itemsize
        self.held, self.total = bytearray(), 0

    def _write(self, data: bytes) -> None:
        ids = np.frombuffer(data, dtype=self.dtype)
        mask = np.ones(len(ids), dtype=bool)
        if pad := -len(ids) % self.length:
            ids, mask = np.r_[ids, np.zeros(pad, self.dtype)], np.r_[mask, np.zeros(pad, bool)]
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(a), self.length) for a in (ids, mask)]
        self.stream.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def append(self, ids: bytes) -> None:
        self.held += ids
        self.total += len(ids) // self.dtype.itemsize
        while len(self.held) >= self.batch_bytes:
            self._write(bytes(self.held[:self.batch_bytes]))
            del self.held[:self.batch_bytes]

    def close(self) -> None:
        if self.held:
            self._write(bytes(self.held))
        self.stream.close()
        self.sink.close()


class SequenceFile:
    """Random access to the sequences of one stream file."""

    def __init__(self, uri: str):
        self.file = open_file(uri)
        stream = pa.ipc.open_stream(self.file)
        self.schema = stream.schema
        self.length = self.schema.field("ids").type.list_size
        self.first = self.file.tell()
        try:
            self.rows = stream.read_next_batch().num_rows
        except StopIteration:
            self.rows = 0
        self.stride = self.file.tell() - self.first

    def batch(self, k: int) -> pa.RecordBatch:
        """Batch ``k``; its buffers are views of the mapped file."""
        self.file.seek(self.first + k * self.stride)
        return pa.ipc.read_record_batch(pa.ipc.read_message(self.file), self.schema)

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of sequence ``k``, a view of the mapped file, and its mask, unpacked from the mapped bits."""
        batch, row = self.batch(k // self.rows), k % self.rows
        at = slice(row * self.length, (row + 1) * self.length)
        return (batch.column(0).flatten().to_numpy(zero_copy_only=True)[at],
                batch.column(1).flatten()[at].to_numpy(zero_copy_only=False))

    def ids(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from position ``start`` of the file's stream, across sequences and batches."""
        per_batch, parts = self.rows * self.length, []
        while count > 0:
            k, at = divmod(start, per_batch)
            take = min(count, per_batch - at)
            parts.append(self.batch(k).column(0).flatten().to_numpy(zero_copy_only=True)[at:at + take])
            start, count = start + take, count - take
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.empty(0, np.uint16)])


@dataclass
class TokenDataset:
    """What ``write`` leaves: the folder, the documents' index and the table of files."""

    folder: str
    index: DataFrame  # id, file, local_start, n_tokens
    files: DataFrame  # file, file_start, file_tokens


def _pack(splits: list[int]):
    """(part, id, text): each document to its range of ids, its text compressed for the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze, bounds = zstandard.ZstdCompressor(level=1).compress, np.array(splits, dtype=np.int64)
        for whole in batches:
            for batch in steps(whole):
                keys = np.array([NULL_ID if k is None else k for k in batch.column(0).to_pylist()], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.searchsorted(bounds, keys, side="right"), pa.int32()), batch.column(0),
                     pa.array([squeeze((t or "").encode()) for t in batch.column(1).to_pylist()], pa.binary())], names=["part", "id", "text"])

    return run


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and unpacked texts of the rows in their order, about CHUNK_BYTES of text or one longer text at a time."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    keys, texts, size = [], [], 0
    for batch in batches:
        for key, packed in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
            text = unpack(packed.as_buffer())
            if texts and size + len(text) > CHUNK_BYTES:
                yield keys, texts
                keys, texts, size = [], [], 0
            keys.append(key)
            texts.append(text)
            size += len(text) + ROW_BYTES
    if texts:
        yield keys, texts


def _file_writer(folder: str, length: int, rows: int, tokenizer_path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents of one range come in order of their ids; they are encoded and make one file."""
        encode = encoder(tokenizer_path, end_id)
        name, out = f"part-{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}.arrow", None
        for keys, texts in _chunks(batches):
            out = out or SequenceWriter(f"{folder}/{name}", length, rows, encode.dtype)
            ids, counts = encode.encode(texts)
            starts = out.total + np.cumsum(counts) - counts
            out.append(ids)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([name] * len(keys)), pa.array(starts, pa.int64()),
                                              pa.array(counts, pa.int64())], names=["id", "file", "local_start", "n_tokens"])
        if out:
            out.close()

    return run


def write(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, length: int = LENGTH,
          rows: int = ROWS, file_bytes: int = FILE_BYTES, id_col: str = "doc_id") -> TokenDataset:
    """Encode every text, append ``end_id``, and write the stream files into ``folder`` (of the shared file system)."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "token-files")
    if ":/" not in folder:
        folder = f"file://{folder}"
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), "text")
    total = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Ranges of ids hold about equally many documents; each becomes one file, named after the number of its range.
    splits = split_points(keyed.select(F.coalesce("id", F.lit(NULL_ID)).alias("key")), "key", -(-total // file_bytes))
    dealt = (keyed.mapInArrow(_pack(splits), "part int, id long, text binary")
             .repartitionById(len(splits) + 1, "part").sortWithinPartitions("id", "text"))
    index = stored(dealt.mapInArrow(_file_writer(folder, length, rows, tokenizer_path, end_id),
                                    "id long, file string, local_start long, n_tokens long"), "token-index")
    # Names begin with the number of their range, so their order is that of the ids; a row per file.
    sizes = index.groupBy("file").agg(F.sum("n_tokens").alias("file_tokens")).orderBy("file").collect()
    rows_, start = [], 0
    for r in sizes:
        rows_.append((r.file, start, r.file_tokens))
        start += r.file_tokens
    files = spark.createDataFrame(rows_, "file string, file_start long, file_tokens long")
    return TokenDataset(folder, index, files)


def _file_reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (id, file, local_start, n_tokens, start) ordered by file and place."""
        name, seq = None, None
        for batch in batches:
            crcs = []
            for file, at, count in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                if file != name:
                    name, seq = file, SequenceFile(f"{folder}/{file}")
                crcs.append(zlib.crc32(seq.ids(at, count).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), batch.column(3), pa.array(crcs, pa.int64())],
                                             names=["id", "start", "n_tokens", "ids_crc32"])

    return run


def read_digests(data: TokenDataset, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the ids in the files."""
    placed = data.index.join(data.files, "file")
    placed = placed.select("id", "file", "local_start", "n_tokens", (F.col("file_start") + F.col("local_start")).alias("start"))
    dealt = placed.repartition("file").sortWithinPartitions("file", "local_start")
    out = dealt.mapInArrow(_file_reader(data.folder), "id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("id", id_col)
