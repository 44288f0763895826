"""Operators over the association graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.functions.scalars import cosine


def prune_weak(edges: DataFrame, least: float = 0.05) -> DataFrame:
    return edges.where(F.col("weight") >= least)


def pruned_counts(edges: DataFrame, least: float = 0.05) -> DataFrame:
    """How many edges pruning keeps and drops."""
    return edges.agg(F.count_if(F.col("weight") >= least).alias("kept"), F.count_if(~(F.col("weight") >= least)).alias("pruned"))


def prune_orphans(edges: DataFrame, memories: DataFrame) -> DataFrame:
    """Edges whose two ends exist."""
    ids = memories.select("id")
    return edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")


def outbound(edges: DataFrame, memories: DataFrame, node: int) -> DataFrame:
    """Targets of a node that exist, heaviest first."""
    ids = memories.select(F.col("id").alias("to_id"))
    return edges.where(F.col("from_id") == node).join(ids, "to_id", "left_semi").orderBy(F.desc("weight"), "to_id")


def touching(edges: DataFrame, node: int) -> DataFrame:
    """Edges at a node, each with its direction and the other end; ordinals first, then weight."""
    hit = edges.where((F.col("from_id") == node) | (F.col("to_id") == node))
    out = hit.select(
        F.when(F.col("from_id") == node, "outgoing").otherwise("incoming").alias("direction"),
        F.when(F.col("from_id") == node, F.col("to_id")).otherwise(F.col("from_id")).alias("other_id"),
        "weight",
        "co_activation_count",
        "ordinal",
    )
    return out.orderBy(F.col("ordinal").asc_nulls_last(), F.desc("weight"), "other_id", "direction")


def labelled(edges: DataFrame, memories: DataFrame, most: int = 40) -> DataFrame:
    """Edges with the beginning of their target's content, or a mark that it was deleted."""
    names = memories.select(F.col("id").alias("to_id"), F.left("content", F.lit(most)).alias("label"))
    return edges.join(names, "to_id", "left").withColumn("label", F.coalesce("label", F.lit("[deleted]")))


def nodes(edges: DataFrame, least: float) -> DataFrame:
    """Ends of the edges that weigh enough."""
    heavy = edges.where(F.col("weight") >= least)
    return heavy.select(F.col("from_id").alias("id")).union(heavy.select("to_id")).distinct()


def summary(edges: DataFrame) -> DataFrame:
    w, c = F.col("weight"), F.col("co_activation_count")
    return edges.agg(
        F.count("*").alias("edges"),
        F.count_if(w >= 0.7).alias("strong"),
        F.count_if((w >= 0.4) & (w < 0.7)).alias("medium"),
        F.count_if(w < 0.4).alias("weak"),
        F.count_if(c > 0).alias("hebbian"),
        F.coalesce(F.max(c), F.lit(0)).alias("max_co_activations"),
        F.coalesce(F.sum(c), F.lit(0)).alias("sum_co_activations"),
    )


def chain_hints(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Seeds that begin an ordered chain, with its number of steps."""
    steps = edges.where("ordinal is not null").join(seeds.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    return steps.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("steps"))


def delete_cascade(memories: DataFrame, edges: DataFrame, enrichments: DataFrame, gone: DataFrame):
    """Without the memories in gone, their edges in both directions and their enrichments."""
    ids = gone.select("id")
    left = memories.join(ids, "id", "left_anti")
    kept = edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_anti").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_anti")
    return left, kept, enrichments.join(ids.withColumnRenamed("id", "memory_id"), "memory_id", "left_anti")


def cut(df: DataFrame) -> DataFrame:
    """The frame checkpointed, if spark.checkpoint.dir is set; else as it is."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df


def discover(seeds: DataFrame, edges: DataFrame, memories: DataFrame, q: DataFrame, depth: int = 1, least: float = 0.15, bonus: float = 0.1) -> DataFrame:
    """Breadth-first discovery from seeds (id, frontier_rank) over edges (with edge_seq for arrival order).

    Per hop, each unseen target takes the edge of the first frontier node that reaches it; whatever was reached stays
    seen. Targets without memory or embedding are dropped and lead no further. Score: similarity to the query, times
    0.5 + 0.5 energy, plus a bonus by weight. Each hop is a join, a window per target and an anti-join, checkpointed
    where the session has a folder for it, so that the plan doesn't grow with the depth.
    """
    strong = edges.where(F.col("weight") >= least)
    seen = seeds.select("id")
    frontier = seeds.select("id", "frontier_rank")
    found = None
    for hop in range(1, depth + 1):
        first = Window.partitionBy("to_id").orderBy("frontier_rank", "edge_seq")
        step = strong.join(frontier.withColumnRenamed("id", "from_id"), "from_id").join(seen.withColumnRenamed("id", "to_id"), "to_id", "left_anti")
        step = step.withColumn("rn", F.row_number().over(first)).where("rn = 1").select(F.col("to_id").alias("id"), "weight", "ordinal", "frontier_rank", "edge_seq")
        step = cut(step) if depth > 1 else step
        seen = seen.union(step.select("id"))
        scored = step.join(memories.where("embedding is not null").select("id", "energy", "state", "created_at", "embedding", "content"), "id").crossJoin(F.broadcast(q))
        sim = cosine("embedding", "q")
        scored = scored.withColumn("similarity", sim).withColumn("blended", sim * (0.5 + 0.5 * F.col("energy")) + bonus * F.col("weight")).withColumn("hop", F.lit(hop)).drop("q")
        out = scored.select("id", "weight", "ordinal", "hop", "similarity", "blended", "energy", "state", "created_at", "embedding", "content")
        found = out if found is None else found.unionByName(out)
        # A sortable key instead of a global row number: where the parent stood, then the ordinal, then arrival.
        frontier = scored.select("id", F.struct(F.coalesce("ordinal", F.lit(2**31 - 1)).alias("o"), "frontier_rank", "edge_seq").alias("frontier_rank"))
    return found

