"""Energy, decay, co-activation learning and propagation over memory and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from recallgrid.functions.scalars import decayed, searchable, state_of, stimulated

EDGE = ("from_id", "to_id", "weight", "co_activation_count", "ordinal")


def decay(memories: DataFrame, amount: float) -> DataFrame:
    """All memories once; the state before decides how much, the state after is derived anew."""
    energy = decayed("energy", "state", amount)
    return memories.withColumn("energy", energy).withColumn("state", state_of("energy"))


def decay_edges(edges: DataFrame, amount: float, rate: float = 1.0) -> DataFrame:
    return edges.withColumn("weight", F.greatest(F.lit(0.0), F.col("weight") - amount * rate))


def time_decay(memories: DataFrame, edges: DataFrame, elapsed_hours: float, per_day: float = 0.05, interval_hours: float = 1.0, edge_rate: float = 1.0):
    """Decay for the hours since the last one; nothing happens before an interval has passed."""
    if elapsed_hours < interval_hours:
        return memories, edges
    amount = per_day * (elapsed_hours / 24.0)
    return decay(memories, amount), decay_edges(edges, amount, edge_rate)


def decay_since(memories: DataFrame, edges: DataFrame, last_decay_at: int | None, now: int, per_day: float = 0.05, interval_hours: float = 1.0, edge_rate: float = 1.0):
    """time_decay from the time of the last decay on, and the time to note: now, or the old one where nothing was due. A store
    without a note counts as decayed a day ago."""
    hours = 24.0 if last_decay_at is None else (now - last_decay_at) / 3600
    if hours < interval_hours:
        return memories, edges, last_decay_at
    return *time_decay(memories, edges, hours, per_day, interval_hours, edge_rate), now


def tick_decay(memories: DataFrame, edges: DataFrame, per_day: float = 0.05, edge_rate: float = 1.0):
    return decay(memories, per_day / 24.0), decay_edges(edges, per_day / 24.0, edge_rate)


def stimulate(memories: DataFrame, ids: Column, amount: float, now: Column) -> DataFrame:
    """Raise the energy of the memories that ids picks; tell which came back from deep or archived."""
    energy = F.when(ids, stimulated("energy", amount)).otherwise(F.col("energy"))
    return (
        memories.withColumn("old_state", F.col("state"))
        .withColumn("energy", energy)
        .withColumn("state", F.when(ids, state_of("energy")).otherwise(F.col("state")))
        .withColumn("last_accessed", F.when(ids, now).otherwise(F.col("last_accessed")))
        .withColumn("access_count", F.col("access_count") + F.when(ids, 1).otherwise(0))
        .withColumn("resurrected", ids & F.col("old_state").isin("deep", "archived") & searchable("state"))
    )


#: Keys that are looked at for each part of an order, and rows of a block of consecutive rows.
KEYS_PER_PART = 20
BLOCK = 1 << 16


def _before(order_cols: tuple[str, ...], bound: Row) -> Column:
    """Whether a row's key comes before a bound, missing values first."""
    out = F.lit(False)
    for c in reversed(order_cols):
        out = F.coalesce(F.col(c) < F.lit(bound[c]), F.lit(True)) | (F.col(c).eqNullSafe(F.lit(bound[c])) & out)
    return out


def _part(order_cols: tuple[str, ...], bounds: list[Row], first: int = 0) -> Column:
    """The number of the bounds that a row's key doesn't come before, found by halves."""
    if not bounds:
        return F.lit(first)
    mid = len(bounds) // 2
    return F.when(_before(order_cols, bounds[mid]), _part(order_cols, bounds[:mid], first)).otherwise(_part(order_cols, bounds[mid + 1 :], first + mid + 1))


def ordered_index(df: DataFrame, order_cols: tuple[str, ...], name: str = "idx", parts: int | None = None) -> DataFrame:
    """A gapless global position by order_cols, from 1; rows without the first of them are left out. Rows are numbered within
    parts of about equal size, and parts are offset by the counts before them.

    Parts are cut at whole keys, so a moment that holds any number of rows is cut as well. The keys to cut at are those of
    least hash, some twenty a part; they decide on the parts' sizes alone, as any cuts give the same positions.
    """
    df = df.where(F.col(order_cols[0]).isNotNull())
    n = parts or 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(*order_cols).dropna().orderBy(F.xxhash64(*order_cols), *order_cols).limit(KEYS_PER_PART * n).collect()
    keys = sorted(set(keys))
    bounds = [keys[i * len(keys) // n] for i in range(1, n)] if len(keys) >= n else keys
    df = df.withColumn("part_of", _part(order_cols, bounds))
    earlier = Window.orderBy("part_of").rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy("part_of").agg(F.count("*").alias("n")).select("part_of", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("part_of").orderBy(*order_cols))
    # One row a part: their number is n at most.
    return df.withColumn("in_part", within).join(F.broadcast(offsets), "part_of").withColumn(name, F.col("in_part") + F.col("offset")).drop("part_of", "in_part", "offset")


def hebbian(log: DataFrame, id_col: str = "mem_id", order_cols: tuple[str, ...] = ("ts", "event_id"), window: int = 5, rate: float = 0.1, block: int = BLOCK) -> DataFrame:
    """Edges that a stream of recalls leaves: each recall is paired both ways with the ones before it in the window. A pair met
    n times has weight min(1, rate * n) and n - 1 co-activations after the first.

    The order is cut into blocks, and the last rows of a block are handed to the next as well, where they are paired but
    don't pair, so no row is copied for each place of its window.
    """
    block = max(block, window)
    placed = ordered_index(log.select(id_col, *order_cols), order_cols).select(F.col(id_col).alias("a"), "idx")
    own, handed = (F.floor(F.col("idx") / block)).alias("at"), (F.floor((F.col("idx") + window) / block)).alias("at")
    blocks = placed.select("a", "idx", F.explode(F.array_distinct(F.array(own, handed))).alias("at"))
    order = Window.partitionBy("at").orderBy("idx")
    met = blocks.select("a", "at", "idx", F.array(*[F.lag("a", k).over(order) for k in range(1, window + 1)]).alias("earlier")).where(F.floor(F.col("idx") / block) == F.col("at"))
    pairs = met.select("a", F.explode("earlier").alias("b")).where("a != b")
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("f"), F.col("b").alias("t")), F.struct(F.col("b").alias("f"), F.col("a").alias("t")))).alias("p"))
    n = both.groupBy(F.col("p.f").alias("from_id"), F.col("p.t").alias("to_id")).agg(F.count("*").alias("n"))
    weight = F.least(F.lit(1.0), min(rate, 0.5) + rate * (F.col("n") - 1))
    return n.select("from_id", "to_id", weight.alias("weight"), (F.col("n") - 1).alias("co_activation_count"), F.lit(None).cast("int").alias("ordinal"))


def propagate(memories: DataFrame, edges: DataFrame, source_id: int, amount: float, damping: float = 0.5, floor: float = 0.01) -> DataFrame:
    """Energy that one stimulated memory passes on, one hop, whatever the targets' state."""
    passed = edges.where(F.col("from_id") == source_id).select(F.col("to_id").alias("id"), (F.lit(float(amount)) * F.col("weight") * damping).alias("passed"))
    out = memories.join(passed.where(F.col("passed") > floor), "id", "left")
    hit = F.col("passed").isNotNull()
    return (
        out.withColumn("energy", F.when(hit, stimulated("energy", F.col("passed"))).otherwise(F.col("energy")))
        .withColumn("state", F.when(hit, state_of("energy")).otherwise(F.col("state")))
        .withColumn("access_count", F.col("access_count") + F.when(hit, 1).otherwise(0))
        .drop("passed")
    )


def associate(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert edges: weight (clamped) and ordinal are overwritten, counts kept."""
    fresh = new.select("from_id", "to_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "weight")).alias("new_weight"), F.col("ordinal").alias("new_ordinal"), F.lit(True).alias("is_new"))
    both = edges.join(fresh, ["from_id", "to_id"], "full")
    return both.select(
        "from_id",
        "to_id",
        F.coalesce("new_weight", "weight").alias("weight"),
        F.coalesce("co_activation_count", F.lit(0).cast("long")).alias("co_activation_count"),
        F.when(F.col("is_new"), F.col("new_ordinal")).otherwise(F.col("ordinal")).alias("ordinal"),
    )


def associate_if_absent(edges: DataFrame, new: DataFrame) -> DataFrame:
    fresh = new.join(edges, ["from_id", "to_id"], "left_anti")
    fresh = fresh.select("from_id", "to_id", "weight", F.lit(0).cast("long").alias("co_activation_count"), F.lit(None).cast("int").alias("ordinal"))
    return edges.select(*EDGE).unionByName(fresh)


def session_wiring(sessions: DataFrame, weight: float = 0.5) -> DataFrame:
    """(session_id, ids): an edge both ways between each two distinct ids of a session's list."""
    ids = sessions.select(F.array_distinct("ids").alias("ids"))
    a = ids.select("ids", F.explode("ids").alias("from_id"))
    pairs = a.select("from_id", F.explode("ids").alias("to_id")).where("from_id != to_id").distinct()
    return pairs.withColumn("weight", F.lit(weight))
