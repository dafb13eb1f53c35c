"""Registered queries of the training-data operators: (spark, sf_dir) -> DataFrame over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelworks.llm import conversation_trie, langid, merkle, mixing, pii, quality, secret_scan, sentencepiece_bpe, simhash, token_counts, token_files, toxicity, winnowing
from funnelworks.llm.common import held_out

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(fn):
    REGISTRY[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@register
def op1_token_counts(spark, sf_dir):
    """Operator 1: unigram token counts of every text."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


@register
def op2_pii(spark, sf_dir):
    """Operator 2: base spans and contextually discovered ones of every text."""
    return pii.find(table(spark, sf_dir, "documents"))


@register
def op3_toxicity(spark, sf_dir):
    """Operator 3: learned from labelled rows that are not held out, scored for all; label 1 from 0.3."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.train(toxicity.labelled(docs.where(~held_out()), labels))
    out = toxicity.score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@register
def op4_token_files(spark, sf_dir):
    """Operator 4: ids of every text and the end id 1, written as stream files and read back."""
    data = token_files.write(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1)
    return token_files.read_digests(data)


@register
def op5_winnowing_fingerprints(spark, sf_dir):
    """Operator 5: fingerprints of every text and its edited text, and their likeness."""
    return winnowing.with_next(table(spark, sf_dir, "documents"))


@register
def op6_simhash_near_dedup(spark, sf_dir):
    """Operator 6: 3-word shingles, links at 3 bits or fewer, components by smallest doc_id."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def mix_levels() -> dict:
    """The tree of operator 7: three groups of sources (the table has no domain), languages, sources."""
    return {"domain": F.concat(F.lit("d"), F.ascii(F.md5(F.col("source").cast("binary"))) % 3), "lang": F.col("lang"), "source": F.col("source")}


MIX_WEIGHTS = {"domain": {"d0": 2, "d1": 3, "d2": 4}, "lang": {"en": 6, "de": 3, "fr": 2, "es": 2}, "source": {"src0": 3}}


@register
def op7_mixing(spark, sf_dir):
    """Operator 7: half of all tokens, dealt down the tree, as the taken documents of seeded epochs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = mixing.mix(docs, mix_levels(), MIX_WEIGHTS, fraction=(1, 2), max_epochs=4, seed=7)
    return out.select("doc_id", "domain", "lang", "source", "epoch", "n_tokens", "n_taken")


@register
def op8_quality_rules(spark, sf_dir):
    """Operator 8: the cascade's verdict beside the base counts of every text."""
    out = quality.cascade(table(spark, sf_dir, "documents"), features=quality.BASE)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.select("doc_id", *quality.BASE, failed.alias("base_failed"), (F.col("kept") & ~failed).alias("kept"))


@register
def op9_language_id(spark, sf_dir):
    """Operator 9: learned from rows that are not held out, predicted for all."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held_out()), tokenizer("piece_bpe_32k.model"))
    return langid.predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@register
def op10_sentencepiece_round_trip(spark, sf_dir):
    """Operator 10: merge-type SentencePiece encoding with an end id, and decoding, as digests."""
    return sentencepiece_bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


@register
def op11_merkle_manifest(spark, sf_dir):
    """Operator 11: a proof per row, by language and id, and what one row in seven gives when its n_chars is tampered with."""
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    more = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = docs.select("doc_id", "lang", merkle.leaf([F.col(c) for c in fields]).alias("leaf"),
                       F.when(chosen, merkle.leaf([more.get(c, F.col(c)) for c in fields])).alias("tampered"))
    out = merkle.proofs(rows, "lang", "doc_id", ["tampered"])
    out = out.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("sides"), F.col("siblings")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))


@register
def op12_conversation_trie(spark, sf_dir):
    """Operator 12: the prefix trie of conversations that begin as conversation c - c % 20 does, for crc32(c) % 4 turns."""
    turns, sizes = conversation_trie.own_turns(table(spark, sf_dir, "conversations"))
    c = F.col("conv_id")
    turns, sizes = conversation_trie.rebuilt(turns, sizes, c - c % 20, F.crc32(c.cast("string").cast("binary")) % 4, most=3)
    return conversation_trie.trie(turns, sizes)


@register
def op13_secret_scan(spark, sf_dir):
    """Operator 13: base spans and strings of high entropy of every text."""
    return secret_scan.find(table(spark, sf_dir, "documents"))
