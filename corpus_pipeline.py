"""The corpus pipeline: five stages over the documents table, each written as Parquet and read by the next.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Stages work on whatever the stage before kept, null texts, repeated rows and further columns included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.llm import exact_dedup, jaccard_join, mixing, sentencepieces, toxicity
from recallgrid.llm.common import lean, scratch, small_first, squeezed, table, written
from recallgrid.llm.queries import tokenizer_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half. The lexicon is learned as in the query: labels of held-out rows aren't read."""
    lexicon = toxicity.fitted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, lexicon, whole=True)


def staying(docs: DataFrame, mark: Column, gone: DataFrame, again: DataFrame) -> DataFrame:
    """The rows of docs without those whose (id, mark) is in gone, and one row of each (id, mark) in again: the least of all
    columns. gone and again are written tables (doc, seal).

    Rows are told apart by id and mark, a hash of the text, so rows that share an id don't go with one another.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), mark.alias("mark"))

    def on(other: DataFrame) -> Column:
        return rows["id"].eqNullSafe(other["doc"]) & (rows["mark"] == other["seal"])

    gone = small_first(gone)
    rows = rows.join(gone, on(gone), "left_anti")
    if again.take(1):
        again = small_first(again)
        one = rows.join(again, on(again), "left_semi").groupBy("id", "mark").agg(F.min("row").alias("row"))
        rows = rows.join(again, on(again), "left_anti").select("row").union(one.select("row"))
    return rows.select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document of the smallest id; of rows that share that id as well, one."""
    lean(spark)
    with scratch(spark) as keep:
        found = exact_dedup.exact_duplicates(docs).select(F.col("doc_id").alias("doc"), F.xxhash64("text_sha256").alias("seal"), "kept", "group_size")
        found = written(found.where("group_size > 1"), "copies")
        gone = keep(written(found.where("not kept").select("doc", "seal").distinct(), "gone"))
        again = keep(written(found.where("kept").groupBy("doc", "seal").agg(F.count("*").alias("n")).where("n > 1").select("doc", "seal"), "again"))
    return staying(docs, F.xxhash64(F.sha2(squeezed(F.col("text")), 256)), gone, again)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, Jaccard similarity 0.8) the document of the smallest id; of rows that
    share that id, one. Texts without words are no near duplicates and stay."""
    lean(spark)
    with scratch(spark) as keep:
        found = jaccard_join.clusters(docs).where("cluster is not null").select("cluster", "doc", F.col("text_hash").alias("seal"))
        first = F.min(F.struct(F.col("doc").isNull(), "doc", "seal")).alias("first")
        groups = written(found.groupBy("cluster").agg(first, F.count("*").alias("n")).where("n > 1").select("cluster", "first.doc", "first.seal").toDF("cluster", "best", "best_seal"), "groups")
        told = found.join(small_first(groups), "cluster").withColumn("stays", F.col("doc").eqNullSafe(F.col("best")) & (F.col("seal") == F.col("best_seal")))
        gone = keep(written(told.where("not stays").select("doc", "seal").distinct(), "gone"))
        again = keep(written(told.where("stays").groupBy("doc", "seal").agg(F.count("*").alias("n")).where("n > 1").select("doc", "seal"), "again"))
    return staying(docs, F.xxhash64("text"), gone, again)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as they were drawn."""
    return mixing.emitted(mixing.mix(docs)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each row's pieces and of what they decode to."""
    lean(spark)
    return sentencepieces.digests(docs, tokenizer_model())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode),
]

#: The first stage scores by a learned lexicon, which SQL can't state; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
