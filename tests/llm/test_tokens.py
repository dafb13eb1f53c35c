"""Operators 1, 4 and 10 against the libraries."""

import zlib

import numpy as np
import pytest

from funnelworks.llm import sentencepiece_bpe, token_counts, token_files

ODD = ["", " ", "  ", "a ", " a", "a  b", "a\n b\t\tc", "日本語 😀😀", "▁x ▁▁y", "<s> </s> <0x41>", "aaaa" * 50, "\x00a",
       "é́ ́b", "A\x1cB　C d", "<|endoftext|>x <|startoftext|>", "ΑΣ ΑΣ.Σ İI'S", "1 23 4.5 it's they'll", "Word, word. WORD"]


@pytest.mark.parametrize("scores", ["zipf", "ties"])
@pytest.mark.parametrize("fallback", [True, False])
def test_token_counts_equal_the_library(model_path, rows, scores, fallback):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = token_counts.zipf_vocabulary(model_path)
    if scores == "ties":
        vocabulary = [(p, -float(min(k, 5))) for k, (p, _) in enumerate(vocabulary)]
    if not fallback:
        vocabulary = [x for x in vocabulary if not x[0].startswith("<0x")]
    lib = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=fallback))
    lib.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counter = token_counts.TokenCounter(vocabulary, byte_fallback=fallback)
    for text in [*ODD, *(r[1] or "" for r in rows if len(r[1] or "") < 1000)]:
        assert counter.text(text) == len(lib.encode(text).ids), text


def test_token_counts_of_a_table(docs, no_docs, rows, model_path):
    got = sorted(map(tuple, token_counts.token_counts(docs, model_path).collect()), key=str)
    counter = token_counts.counter(model_path)
    assert got == sorted(((r[0], counter.text(r[1] or "")) for r in rows), key=str)
    assert token_counts.token_counts(no_docs, model_path).count() == 0


def test_agendas_equal_the_library(model_path, rows):
    e = sentencepiece_bpe.MergeEncoder(model_path)
    texts = [*ODD, *(r[1] or "" for r in rows)]
    assert [ids for ids, _ in e.encode_texts(texts)] == e.lib.encode(texts)
    for text in texts:  # the heap alone, and the rows alone
        stretches = e.stretches(text)
        assert e.stretches_ids(stretches) == e.lib.encode(text)
        short = [s for s in stretches if len(s) <= sentencepiece_bpe.ROW_CHARS]
        if short:
            assert e.merge_rows(short) == [e.merge(s) for s in short]


def test_a_wrong_agenda_is_noticed(model_path):
    e = sentencepiece_bpe.MergeEncoder(model_path)
    e.merge_rows = lambda stretches: [[5] for _ in stretches]
    with pytest.raises(AssertionError, match="differ"):
        list(e.encode_texts(["hello"]))


def test_round_trip_of_a_table(docs, no_docs, rows, model_path):
    import hashlib

    lib = sentencepiece_bpe.encoder(model_path).lib
    want = []
    for r in rows:
        ids = [*lib.encode(r[1] or ""), lib.eos_id()]
        want.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, sentencepiece_bpe.round_trip(docs, model_path).collect()), key=str) == sorted(want, key=str)
    assert sentencepiece_bpe.round_trip(no_docs, model_path).count() == 0
    first = {r.doc_id: r.ids for r in sentencepiece_bpe.encode(docs.where("doc_id = 101"), model_path).collect()}
    assert first == {101: [lib.eos_id()]}


@pytest.fixture(scope="module")
def word_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_stretches_equal_the_library(word_path, rows):
    from tokenizers import Tokenizer

    lib, e = Tokenizer.from_file(word_path), token_files.StretchEncoder(word_path, 1)
    assert e.cuts
    texts = [*ODD, *(r[1] or "" for r in rows)]
    for text, ids in zip(texts, e.encode_texts(texts), strict=True):
        assert np.frombuffer(ids, e.dtype).tolist() == [*lib.encode(text, add_special_tokens=False).ids, 1], text


def test_a_vocabulary_that_keeps_white_space_goes_whole_to_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    e, lib = token_files.StretchEncoder(path, 1), Tokenizer.from_file(path)
    assert not e.cuts
    assert np.frombuffer(e.encode_texts(["a  b\nc"])[0], e.dtype).tolist() == [*lib.encode("a  b\nc", add_special_tokens=False).ids, 1]


def test_files_hold_the_ids_in_order(spark, docs, rows, word_path, tmp_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(word_path)
    data = token_files.write(docs, word_path, 1, folder=str(tmp_path / "ids"), length=16, rows=4, file_bytes=20_000)
    got = token_files.read_digests(data).collect()
    assert data.files.count() > 1
    ids = {r[1] or "": [*lib.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows}
    start = 0
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for g, r in zip(sorted(got, key=lambda g: g.start), ordered, strict=True):
        mine = ids[r[1] or ""]
        assert tuple(g) == (r[0], start, len(mine), zlib.crc32(np.array(mine, "<u4").tobytes()))
        start += len(mine)


def test_sequences_are_views_with_masks(tmp_path):
    path = f"file://{tmp_path}/one.arrow"
    ids = np.arange(1000, dtype="<u2")
    w = token_files.SequenceWriter(path, 8, 4, ids.dtype)
    for part in np.array_split(ids, 7):
        w.append(part.tobytes())
    w.close()
    f = token_files.SequenceFile(path)
    for k in (0, 3, 4, 57, 124):
        got, mask = f.sequence(k)
        assert not got.flags.owndata and got.tolist() == ids[8 * k:8 * k + 8].tolist() and mask.all()
    w = token_files.SequenceWriter(path, 8, 4, ids.dtype)
    w.append(ids[:13].tobytes())
    w.close()
    got, mask = token_files.SequenceFile(path).sequence(1)
    assert got.tolist() == [8, 9, 10, 11, 12, 0, 0, 0] and mask.tolist() == [True] * 5 + [False] * 3


def test_no_documents_make_no_files(no_docs, word_path):
    data = token_files.write(no_docs, word_path, 1)
    assert data.files.count() == 0 and token_files.read_digests(data).count() == 0


def _range_of(texts):
    import pyarrow as pa
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([squeeze(t.encode()) for t in texts], pa.binary())], names=["id", "text"])


def test_a_range_gives_each_stretch_to_the_library_once(word_path, tmp_path, monkeypatch):
    """Long stretches too, which were encoded anew every 256 documents."""
    from types import SimpleNamespace

    e, seen = token_files.StretchEncoder(word_path, 1), []
    for name in ("_runs", "_library"):
        plain = getattr(e, name)
        setattr(e, name, lambda some, *lib, plain=plain: (seen.extend(some), plain(some, *lib))[1])
    monkeypatch.setattr(token_files, "encoder", lambda *_: e)
    monkeypatch.setattr(token_files, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    word, other = "Abcde" * 20, "a1-" * 40
    texts = [f"{word}, {other} x{k}" for k in range(700)]
    out = list(token_files._file_writer(f"file://{tmp_path}", 16, 4, word_path, 1)(iter([_range_of(texts)])))
    assert sum(b.num_rows for b in out) == 700
    assert seen.count(word.lower()) == 1 and seen.count(other) == 1


def test_chunks_keep_rows_in_order(monkeypatch):
    monkeypatch.setattr(token_files, "CHUNK_BYTES", 1000)
    texts = ["é" * 100, "", "x" * 5000, "a b", *["word " * 30] * 20, ""]
    chunks = list(token_files._chunks(iter([_range_of(texts[:3]), _range_of(texts[3:])])))
    assert [t.decode() for _, c in chunks for t in c] == texts
    assert [k for ks, _ in chunks for k in ks] == [0, 1, 2, *range(len(texts) - 3)]
    assert len(chunks) > 5 and all(len(c) == 1 or sum(map(len, c)) <= 1000 for _, c in chunks)
    assert list(token_files._chunks(iter([]))) == []


def test_added_tokens_of_letters(word_path, tmp_path):
    from tokenizers import Tokenizer

    lib, path = Tokenizer.from_file(word_path), str(tmp_path / "added.json")
    lib.add_tokens(["river"])
    lib.save(path)
    e = token_files.StretchEncoder(path, 1)
    for text in ["The river", "rivers driver, River.", "a river. b"]:
        assert np.frombuffer(e.encode_texts([text])[0], e.dtype).tolist() == [*lib.encode(text, add_special_tokens=False).ids, 1]


def test_letters_of_all_scripts_equal_the_library(word_path):
    """Letters that decompose, whose lower case has a mark, and jamo that compose, in runs beside each other."""
    import random

    from tokenizers import Tokenizer

    rng, lib, e = random.Random(4), Tokenizer.from_file(word_path), token_files.StretchEncoder(word_path, 1)
    every = [c for c in map(chr, range(0x20, 0x1F000)) if c.isalpha()]
    odd = list("क़İſ각ΣςßẞDŽＡΩKİ́ͅªµ.,'1") + ["日本", "слово", "the"]
    for pick, gap in ((every, " "), (odd, "\t"), (every + odd * 2000, " ")):
        texts = [gap.join("".join(rng.choices(pick, k=rng.randrange(1, 5))) + rng.choice(["", ".", ",", ".,"]) for _ in range(40)) for _ in range(150)]
        for text, ids in zip(texts, e.encode_texts(texts), strict=True):
            assert np.frombuffer(ids, e.dtype).tolist() == [*lib.encode(text, add_special_tokens=False).ids, 1], text
