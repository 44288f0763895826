"""The queries of this subpackage, thin over its operators, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, exact_dedup, html_text, jaccard_join, lm_scoring, mixing, nearest, prefix_trie, quality, sentencepieces, sharding, substring_dedup, toxicity
from .common import n_words, table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), n=4, threshold="0.85")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs.select("doc_id", "source", n_words(F.col("text")).alias("words")), size=F.col("words"))
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.neighbours(table(spark, sf_dir, "embeddings"), queries=lambda i: i % 20 == 0)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def tokenizer_model(name: str = "piece_bpe_32k.model", folder: str | None = None) -> bytes:
    """A public tokenizer's file, from a folder or else where its package keeps it."""
    if folder is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    else:
        path = os.path.join(folder, name)
    with open(path, "rb") as f:
        return f.read()


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = lm_scoring.fitted(docs, table(spark, sf_dir, "labels").where("quality = 1"))
    return lm_scoring.scored(docs, models)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digests(table(spark, sf_dir, "documents"), tokenizer_model())


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    scores = toxicity.scored(docs, lexicon)
    return scores.select("doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fitted(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(table(spark, sf_dir, "documents"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("copies"))
    dealt = sharding.sharded(docs, F.col("size"), by=[F.col("copies")], ident=F.col("doc_id"), shards=16)
    return dealt.select("row.doc_id", "size", "row.text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = prefix_trie.sequences(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(prefix_trie.grafted(seqs))


def queries():
    return {
        "op1_html_extraction": op1_html_extraction,
        "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
        "op3_source_mixing": op3_source_mixing,
        "op4_nearest_neighbours": op4_nearest_neighbours,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_lm_scoring": op6_lm_scoring,
        "op7_sentencepiece": op7_sentencepiece,
        "op8_toxicity": op8_toxicity,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_quality_classifier": op10_quality_classifier,
        "op11_sharding": op11_sharding,
        "op12_collocations": op12_collocations,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql():
    return {
        "op2_ngram_jaccard_join": jaccard_join.OP2_SQL,
        "op5_exact_dedup": exact_dedup.OP5_SQL,
        "op9_substring_dedup": substring_dedup.OP9_SQL,
        "op12_collocations": collocations.OP12_SQL,
        "op13_prefix_trie": prefix_trie.OP13_SQL,
    }
