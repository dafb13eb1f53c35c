"""Every operator on tables whose extra columns have the names that the operators use inside."""

import pytest
from pyspark.sql import functions as F

from funnelworks.llm import (conversation_trie, langid, merkle, mixing, pii, quality, secret_scan, sentencepiece_bpe, simhash, token_counts,
                             token_files, toxicity, winnowing)

NAMES = """_id _h _spans _own_h _stays rows _row _x0 _x1 avail budget full rest cut _mine _cut capacity documents whole lang_pred score label
leaf subroot root siblings hits kind start end spans base part id file own late bin n0 component_id first _at _n _g _hash tokens size key
bucket n_taken kept rejected_by digest words depth n_turns _p _span c k i m gap fp word conf sure w1 w2 left reach ahead""".split()


def _extended(df):
    return df.drop("h", "fp", "key", "n_tokens", "epoch").withColumns({n: F.lit(f"x {n}") for n in NAMES})


@pytest.fixture(scope="module")
def plain(docs):
    return docs.drop("h", "fp", "key", "n_tokens", "epoch")


@pytest.fixture(scope="module")
def wide(docs):
    return _extended(docs)


def _rows(df, columns=None):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=str)


@pytest.mark.parametrize("name", ["redact", "representatives", "mix"])
def test_rows_keep_all_their_columns(plain, wide, name):
    levels = {"domain": F.col("source"), "lang": F.col("lang")}
    run = {"redact": pii.redact, "representatives": simhash.representatives,
           "mix": lambda d: mixing.mix(d, levels, {"lang": {"en": 3}}, (1, 2), 2, seed=1)}[name]
    want, got = run(plain), run(wide)
    assert [c for c in got.columns if c not in NAMES] == [c for c in want.columns if c != "n_taken"]
    assert set(NAMES) <= set(got.columns)
    assert _rows(got, want.columns) == _rows(want)
    assert all(r[n] == f"x {n}" for r in got.collect() for n in NAMES if n != "n_taken")


def test_operators_read_their_own_columns_only(plain, wide, model_path):
    import public_tokenizers

    runs = {
        "token_counts": lambda d: token_counts.token_counts(d, model_path),
        "pii": pii.find,
        "token_files": lambda d: token_files.read_digests(token_files.write(d, public_tokenizers.path("word_bpe_49k.json"), 1)),
        "winnowing": winnowing.with_next,
        "near_duplicates": simhash.near_duplicates,
        "quality": lambda d: quality.cascade(d, features=quality.BASE).drop("rejected_by", "n_asked"),
        "langid": lambda d: langid.predict(d, langid.train(d, model_path)),
        "sentencepiece": lambda d: sentencepiece_bpe.round_trip(d, model_path),
        "merkle": lambda d: merkle.manifest(d, ["doc_id", "text"], "lang", "doc_id"),
        "secrets": secret_scan.find,
    }
    for name, run in runs.items():
        assert _rows(run(wide)) == _rows(run(plain)), name


def test_labels_and_conversations(spark, plain, wide):
    labels = plain.where("doc_id is not null").select("doc_id", (F.col("doc_id") % 2).alias("label")).dropDuplicates(["doc_id"])
    scores = []
    for d, t in ((plain, labels), (wide, labels.withColumn("text", F.lit("x")).withColumn("score", F.lit("x")))):
        scores.append(_rows(toxicity.score(d, toxicity.train(toxicity.labelled(d, t)))))
    assert [r[0] for r in scores[0]] == [r[0] for r in scores[1]]
    assert all(abs(a[1] - b[1]) < 1e-3 for a, b in zip(*scores, strict=True))
    talk = spark.createDataFrame([(1, 0, "u", "a"), (1, 1, "v", "b"), (2, 0, "u", "a"), (2, None, None, None), (None, 1, "u", "a")],
                                 "conv_id long, turn long, role string, text string")
    tries = [_rows(conversation_trie.trie(*conversation_trie.own_turns(d))) for d in (talk, talk.withColumns({n: F.lit(n) for n in NAMES}))]
    assert tries[0] == tries[1] and len(tries[0]) == 5
