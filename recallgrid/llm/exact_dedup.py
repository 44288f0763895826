"""Exact duplicates by content-defined chunk recipes, in DataFrame functions alone.

A text (null counts as empty) is normalised by turning each run of ASCII white space into one space, then cut
into chunks at places that its own letters decide, so every chunk has a bounded length. The ordered chunk
hashes are its recipe. Only documents whose recipe another document shares can have a duplicate; their chunks,
and no others, are deduplicated to verified identifiers: a chunk's hash plus, where one hash stands for
several chunk texts, the ordinal of the text among them. Two documents are equal when their ordered identifier
lists are. What groups and joins is short; texts move once, for the chunks of suspected copies.

Defined results: an empty table gives an empty one; null and empty texts are equal; rows that share an id are
rows of their own, and the smallest id stays (all rows that have it are marked kept); a null id sorts last and
stays only where its whole group has none. Input columns of any other name are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import squeezed, written

#: A chunk ends after a vowel, a letter that is none, and a space, or at its largest length.
CHUNK = r"(?s).{256,4093}?(?:[aeiou][^aeiou ] |\z)|.{1,4096}"


def chunk_texts(norm):
    return F.regexp_extract_all(norm, F.lit(CHUNK), F.lit(0))


def verified_ordinals(chunks: DataFrame) -> DataFrame:
    """For ``(doc, pos, hash, chunk)`` rows: per doc, its ``(pos, ordinal)`` list over hashes that several texts share."""
    texts = chunks.groupBy("hash", "chunk").agg(F.lit(1).alias("one"))
    clashing = texts.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    numbered = texts.join(clashing, "hash", "left_semi").selectExpr("hash", "chunk", "row_number() over (partition by hash order by chunk) as ordinal")
    return (
        chunks.join(numbered, ["hash", "chunk"])
        .groupBy("doc")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "ordinal"))).alias("ordinals"))
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_fn=F.xxhash64) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    base = docs.select(F.col(id_col).alias("doc"), squeezed(F.col(text_col)).alias("norm"))
    recipes = written(
        base.select("doc", F.sha2("norm", 256).alias("sha"), F.transform(chunk_texts(F.col("norm")), lambda c: hash_fn(c)).alias("recipe")),
        "recipes",
    )
    shared = recipes.groupBy("recipe").agg(F.count("*").alias("n")).where("n > 1").select("recipe")
    suspects = recipes.where("size(recipe) > 0").join(shared, "recipe", "left_semi").select("doc").distinct()
    chunks = (
        base.join(suspects, "doc", "left_semi")
        .select("doc", F.posexplode(chunk_texts(F.col("norm"))).alias("pos", "chunk"))
        .select("doc", "pos", hash_fn("chunk").alias("hash"), "chunk")
    )
    lists = recipes.join(verified_ordinals(chunks), "doc", "left")
    # Equal identifier lists: the same hashes in the same order, and the same ordinals where a hash alone leaves it open.
    key = [F.col("recipe"), F.coalesce("ordinals", F.array().cast("array<struct<pos:int,ordinal:int>>")).alias("ordinals")]
    lists = lists.select("doc", "sha", *key)
    groups = lists.groupBy("recipe", "ordinals").agg(F.min("doc").alias("keep_id"), F.count("*").alias("group_size"))
    return lists.join(groups, ["recipe", "ordinals"]).select(
        F.col("doc").alias(id_col),
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("doc").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


OP5_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM n
"""
