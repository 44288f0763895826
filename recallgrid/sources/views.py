"""Views that map the tables at hand to the data model: memories, edges, enrichments, recalls, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.functions.scalars import state_of
from recallgrid.operators import postings
from recallgrid.operators.dynamics import hebbian


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mem(spark: SparkSession, sf_dir: str, vectors: bool = True) -> DataFrame:
    """The memories. Without vectors, the join to them is left out."""
    docs = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    cols = [
        i.alias("id"),
        F.col("text").alias("content"),
        "lang",
        "source",
        ((i * 37) % 1000).cast("double").__truediv__(F.lit(1000.0)).alias("energy"),
        F.lit(1.0).alias("confidence"),
        (1700000000 + i * 3600).alias("created_at"),
        (1700000000 + i * 3600 + (i * 7919) % 86400).alias("last_accessed"),
        ((i * 13) % 50).alias("access_count"),
        F.array("lang", "source").alias("tags"),
    ]
    if vectors:
        emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
        docs = docs.join(emb, i == F.col("vec_id"), "left")
        cols.append("embedding")
    return docs.select(*cols).withColumn("state", state_of("energy"))


def keyword_index(spark: SparkSession, sf_dir: str) -> postings.Index:
    """The postings of the memories, built when first asked for."""
    return postings.ensure(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int) -> DataFrame:
    """The one row that a search asks with, as column q."""
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select(F.col("embedding").alias("q"))


def recall_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    views = table(spark, sf_dir, "events").where("event_type = 'view'")
    return views.crossJoin(F.broadcast(n)).select("event_id", "ts", F.col("user_id").alias("session_id"), ((F.col("event_id") * 7919) % F.col("n")).alias("mem_id"))


def assoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hebbian(recall_log(spark, sf_dir), id_col="mem_id", order_cols=("ts", "event_id"))


def assoc_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n = docs.agg(F.count("*").alias("n"))
    steps = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("from_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("ordinal"))
    return (
        steps.crossJoin(F.broadcast(n))
        .withColumn("to_id", F.col("from_id") + F.col("ordinal"))
        .where("to_id < n")
        .select("from_id", "to_id", F.lit(0.9).alias("weight"), F.lit(0).cast("long").alias("co_activation_count"), "ordinal")
    )


def assoc_orphan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n = docs.agg(F.count("*").alias("n"))
    lost = docs.where("doc_id % 100 = 0").crossJoin(F.broadcast(n))
    lost = lost.select(F.col("doc_id").alias("from_id"), (F.col("n") + F.col("doc_id")).alias("to_id"), F.lit(0.5).alias("weight"), F.lit(0).cast("long").alias("co_activation_count"), F.lit(None).cast("int").alias("ordinal"))
    return assoc(spark, sf_dir).unionByName(lost)


def enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    n = emb.agg(F.count("*").alias("n"))
    wanted = emb.select("vec_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("seq")).crossJoin(F.broadcast(n))
    wanted = wanted.select(F.col("vec_id").alias("memory_id"), "seq", ((F.col("vec_id") * 7 + F.col("seq") + 1) % F.col("n")).alias("at"))
    return wanted.join(emb.select(F.col("vec_id").alias("at"), "embedding"), "at").select("memory_id", "seq", "embedding")


def sess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per session signal, in order of turn."""
    emb = table(spark, sf_dir, "embeddings")
    n = emb.agg(F.count("*").alias("n"))
    turns = table(spark, sf_dir, "conversations").crossJoin(F.broadcast(n)).withColumn("at", (F.col("conv_id") * 8 + F.col("turn")) % F.col("n"))
    return turns.join(emb.select(F.col("vec_id").alias("at"), "embedding"), "at", "left").select(F.col("conv_id").alias("session_id"), "turn", "role", "text", "at", "embedding")
