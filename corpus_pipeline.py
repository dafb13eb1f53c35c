"""A training-corpus pipeline of five stages over ``documents``.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over what its predecessor kept; it is
written as Parquet and reread before the next one. All but the last return the columns of
``documents``: doc_id, text, lang, source, n_chars.

1. Language identification (operator 9) learns from the rows that are not held out and drops the
   documents it rejects: texts without a letter (``und``). The language it predicts replaces
   ``lang``, so that later stages weigh what a text is, not what it was filed under.
2. SimHash near-dedup (operator 6): of the documents of one component one stays, that of the smallest
   id; of rows that repeat the id, the text of smallest md5.
3. PII (operator 2): spans are replaced by their kinds, and ``n_chars`` is counted anew. No
   document is dropped.
4. Mixing (operator 7): documents are taken, left or repeated so that the tokens of domains,
   languages and sources follow the target weights; a document is taken whole if its leaf's budget
   reaches it.
5. SentencePiece (operator 10): the ids and the decoded text of every document, as digests.

Null ids: such documents are their own group in stage 2 when nothing links them, and otherwise
leave their group to the smallest id. Empty tables go through all stages as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelworks.llm import langid, mixing, pii, sentencepiece_bpe, simhash
from funnelworks.llm.common import held_out, scratch
from funnelworks.llm.queries import MIX_WEIGHTS, mix_levels, tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs.where(~held_out()), tokenizer("piece_bpe_32k.model"))
    return langid.label(docs, model).where("lang_pred <> 'und'").select(
        "doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs, shingle=3, max_bits=3).select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named = {f"mix_{k}": c for k, c in mix_levels().items()}
    weights = {f"mix_{k}": w for k, w in MIX_WEIGHTS.items()}
    return mixing.mix(docs, named, weights, fraction=(1, 1), max_epochs=2, seed=7).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.round_trip(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Language models, XXH64 and SentencePiece are beyond SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's output is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
