"""Mixing sources to target weights by systematic sampling.

Each source has a weight and the mix a size; a source's target is its share by weight, held at ``most`` times
the source's own size, with the excess shared again among the others until none is above. A document's
expected copies are its source's target over its source's size. Within a source, ordered by size and id, these
are summed up from the front; one offset per source, drawn from a hash of its name, is added; and the document
is emitted once for each integer that its interval crosses. So a source's count is its expectation to within
one, and as neighbours in the order are of like size, so are its words.

The running sum is in fixed-point integers, so no rounding adds a copy and reruns agree. It is computed per
range partition and carried over partitions by a table of partition sums, so a source that holds a third of
all rows is summed by many tasks.

Defined results: null text has size 0; null source is a source of its own, the last; documents of size 0 are
drawn as others are but take no words; a source whose size is 0 has target 0 and no copies; an empty table
gives an empty one; rows with equal ids are drawn each for itself, in the order of a hash of their columns, so
that reruns agree (rows equal in all columns are alike). Input columns of whatever
names are carried in one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, written

#: One expected copy, in fixed point.
ONE = 1 << 24


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """``(source, source_size)`` with the target of each. Its windows see one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = sizes.withColumn("weight", F.array(*map(F.lit, weights))[(F.row_number().over(by_name) - 1) % len(weights)].cast("double"))
    out = out.withColumn("cap", most * F.col("source_size")).withColumn("budget", share * F.sum("source_size").over(everything))
    # Sources reach their caps in order of cap / weight; level is the words per weight if all before are at their caps.
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = out.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything)
    capped = F.when(level.isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * level))
    return out.select("source", "source_size", capped.alias("target"))


def mix(
    docs: DataFrame,
    size: Column | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """Per input row: row (a struct of the input's columns), size, source_size, target, copies."""
    tie = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map" not in kind and "variant" not in kind] or [F.lit(0)])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), (n_words(F.col("text")) if size is None else size).alias("size"), tie.alias("tie"))
    placed = written(
        rows.repartitionByRange(F.col("source").asc_nulls_last(), F.col("size").desc(), F.col("id"), F.col("tie")).withColumn("part", F.spark_partition_id()),
        "mix",
    )
    parts = placed.groupBy("source", "part").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    sizes = targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    step = F.when(F.col("source_size") > 0, F.least(F.lit(int(most * ONE)), F.floor(F.col("target") / F.col("source_size") * ONE + 0.5))).otherwise(0)
    # The offset lies in [0, 1).
    sizes = sizes.withColumn("step", step.cast("long")).withColumn("offset", F.pmod(F.xxhash64(F.lit(seed), F.coalesce("source", F.lit("\0"))), F.lit(ONE)))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("start", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    starts = starts.join(sizes.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    starts = starts.select(F.col("source").alias("of"), F.col("part").alias("at"), "start", "source_size", "target", "step", "offset")
    out = placed.join(starts, (F.col("part") == F.col("at")) & F.col("source").eqNullSafe(F.col("of")))
    rank = F.row_number().over(Window.partitionBy("source", "part").orderBy(F.col("size").desc(), "id", "tie"))
    out = out.withColumn("upto", (F.col("start") + rank) * F.col("step") + F.col("offset"))
    crossed = F.expr(f"(upto div {ONE}) - ((upto - step) div {ONE})")
    return out.select("row", "size", "source_size", "target", crossed.cast("long").alias("copies"))


def emitted(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it was drawn."""
    return mixed.select("row", F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int"))).alias("one")).select("row.*")
