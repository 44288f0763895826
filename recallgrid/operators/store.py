"""Versioned snapshots: a mutation computes the next table, writes it beside the last and flips a pointer."""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new in place of those with their keys."""
    return table.join(new.select(*keys), keys, "left_anti").unionByName(new)


def sync_missing(table: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of other whose keys are missing here, added."""
    return table.unionByName(other.join(table.select(*keys), keys, "left_anti"))


def upsert_cascade(memories: DataFrame, enrichments: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of new in place of those of their ids, vectors included (none, if none is given), and enrichments without theirs."""
    gone = new.select(F.col("id").alias("memory_id"))
    return upsert(memories, new, ["id"]), enrichments.join(gone, "memory_id", "left_anti")


def sync_from(memories: DataFrame, edges: DataFrame, stored: DataFrame, stored_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the store has and memory lacks, added, memories and edges; only if the store has more memories."""
    more = stored.agg(F.count("*").alias("there")).crossJoin(memories.agg(F.count("*").alias("here"))).select((F.col("there") > F.col("here")).alias("more"))
    gate = F.broadcast(more)
    fresh = sync_missing(memories, stored.crossJoin(gate).where("more").drop("more"), ["id"])
    return fresh, sync_missing(edges, stored_edges.crossJoin(gate).where("more").drop("more"), ["from_id", "to_id"])


def dedup_copy(target: DataFrame, source: DataFrame, ids: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Rows of source whose id exists, added where target has none with their keys; of several with the same keys the least."""
    known = source.join(ids.select(F.col("id").alias(id_col)), id_col, "left_semi")
    rest = [c for c in source.columns if c not in keys]
    first = known.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("first")).select(*keys, "first.*") if rest else known.distinct()
    return sync_missing(target, first.select(*target.columns), keys)


def create(memories: DataFrame, new: DataFrame, now: Column, id_of: Column | None = None) -> DataFrame:
    """Memories with one more for each row of new (content, and tags and created_at where it has them): full energy and
    confidence, active, never recalled, created now unless it says when, without a vector. Ids are chance, unless given."""
    made = F.coalesce(F.col("created_at"), now) if "created_at" in new.columns else now
    values = {
        "id": F.expr("uuid()") if id_of is None else id_of,
        "content": F.col("content"),
        "tags": F.coalesce(F.col("tags"), F.array().cast("array<string>")) if "tags" in new.columns else F.array().cast("array<string>"),
        "energy": F.lit(1.0),
        "confidence": F.lit(1.0),
        "state": F.lit("active"),
        "created_at": made,
        "last_accessed": made,
        "access_count": F.lit(0),
    }
    rows = new.select(*(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in memories.schema))
    return memories.unionByName(rows)


def set_embeddings(memories: DataFrame, new: DataFrame) -> DataFrame:
    """The vectors of (id, embedding) in place of what these memories had."""
    u = new.select("id", F.col("embedding").alias("new_embedding"), F.lit(True).alias("given"))
    out = memories.join(u, "id", "left")
    return out.withColumn("embedding", F.when(F.col("given"), F.col("new_embedding")).otherwise(F.col("embedding"))).drop("new_embedding", "given")


def embedding_of(memories: DataFrame, node, length: int) -> DataFrame:
    """The vector of one memory, if it has one of the right length."""
    return memories.where((F.col("id") == node) & (F.size("embedding") == length)).select("id", "embedding")


def without_enrichments(enrichments: DataFrame, node) -> DataFrame:
    return enrichments.where(F.col("memory_id") != node)


def cleared(memories: DataFrame, enrichments: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Memories without vectors, no enrichments and no sessions, and one row that counts what was there."""
    counts = memories.agg(F.count("embedding").alias("embeddings")).crossJoin(enrichments.agg(F.count("*").alias("enrichments"))).crossJoin(sessions.agg(F.count("*").alias("sessions")))
    return without_vectors(memories), enrichments.where("false"), sessions.where("false"), counts


def put_metadata(metadata: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) rows with one set."""
    return upsert(metadata, metadata.sparkSession.createDataFrame([(key, value)], "key string, value string"), ["key"])


def get_metadata(metadata: DataFrame, key: str) -> DataFrame:
    return metadata.where(F.col("key") == key).select("value")


def update_energy(memories: DataFrame, updates: DataFrame) -> DataFrame:
    """Energy and state alone, where updates has an id."""
    u = updates.select("id", F.col("energy").alias("new_energy"), F.col("state").alias("new_state"))
    out = memories.join(u, "id", "left")
    return out.withColumn("energy", F.coalesce("new_energy", "energy")).withColumn("state", F.coalesce("new_state", "state")).drop("new_energy", "new_state")


def replace_enrichments(enrichments: DataFrame, new: DataFrame) -> DataFrame:
    """(memory_id, vectors) in place of what these memories had, numbered from 0."""
    rows = new.select("memory_id", F.posexplode("vectors").alias("seq", "embedding"))
    return enrichments.join(new.select("memory_id"), "memory_id", "left_anti").unionByName(rows)


def without_vectors(memories: DataFrame) -> DataFrame:
    kind = dict(memories.dtypes)["embedding"]
    return memories.withColumn("embedding", F.lit(None).cast(kind))


def for_model(memories: DataFrame, sessions: DataFrame, active: str, wanted: str) -> tuple[DataFrame, DataFrame]:
    """Vectors and sessions as they are, or cleared where they were made by another model."""
    return (memories, sessions) if active == wanted else (without_vectors(memories), sessions.where("false"))


class Store:
    """Tables under one root, each as numbered versions and a one-row pointer table, all through Spark's own file access.

    A reader that holds an old version keeps reading it; a writer that dies leaves the pointer where it was.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointers(self, name: str) -> str:
        return f"{self.root}/{name}/pointers"

    def current(self, name: str) -> str | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._pointers(name))
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        last = self.spark.read.schema("at long, version string").json(self._pointers(name)).orderBy(F.desc("at"), F.desc("version")).first()
        return last.version if last else None

    def read(self, name: str) -> DataFrame:
        """The current version; of a table that a sink keeps, its parts together."""
        parts = self._parts(name)
        if parts:
            return reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.root}/{at}/{self.current(at)}") for at in parts])
        return self.spark.read.parquet(f"{self.root}/{name}/{self.current(name)}")

    def _parts(self, name: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [x.getPath().getName() for x in system.listStatus(path)] if system.exists(path) else []
        return [f"{name}/{part}" for part in sorted(found) if part.startswith("part-") and self.current(f"{name}/{part}")]

    def write(self, name: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> str:
        version = f"v-{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).parquet(f"{self.root}/{name}/{version}")
        self.spark.createDataFrame([(time.time_ns(), version)], "at long, version string").write.mode("append").json(self._pointers(name))
        return version

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows to a log, which has no versions."""
        rows.write.mode("append").parquet(f"{self.root}/{name}/log")

    def log(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/log")

    def sink(self, name: str, keys: list[str], parts: int = 16):
        """For foreachBatch: each micro-batch is merged into its table by its keys. Of several rows of a batch with one key the
        greatest in all columns stays. The table is dealt into parts by key, a table that is there at the first batch,
        and only the parts that a batch touches are written anew; a batch that was merged before, and comes again after a
        failure, is left out."""
        part_of = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")

        def merge(batch: DataFrame, batch_id: int) -> None:
            if self.merged(name) >= batch_id:
                return
            known = set(self._parts(name))
            if not known and self.current(name):
                whole = self.read(name)
                for part in range(parts):
                    self.write(f"{name}/part-{part:04}", whole.where(part_of == part))
                known = set(self._parts(name))
            rest = [c for c in batch.columns if c not in keys]
            rows = batch.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("last")).select(*keys, "last.*") if rest else batch.distinct()
            rows = rows.withColumn("part", part_of).persist()
            for part in [r.part for r in rows.select("part").distinct().collect()]:  # at most as many as there are parts
                own, at = rows.where(F.col("part") == part).drop("part"), f"{name}/part-{part:04}"
                self.write(at, upsert(self.read(at), own, keys) if at in known else own)
            rows.unpersist()
            self.spark.createDataFrame([(batch_id,)], "batch long").write.mode("append").json(f"{self.root}/{name}/merged")

        return merge

    def merged(self, name: str) -> int:
        """The last micro-batch that a sink has merged; -1 if there is none."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/merged")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return -1
        return self.spark.read.schema("batch long").json(f"{self.root}/{name}/merged").agg(F.max("batch")).first()[0]


class FrameStore:
    """The same reading and writing, kept as frames in the session: for tests and for tables that need not last."""

    def __init__(self):
        self.versions: dict[str, list[DataFrame]] = {}

    def current(self, name: str) -> str | None:
        return f"v-{len(self.versions[name]) - 1}" if self.versions.get(name) else None

    def read(self, name: str) -> DataFrame:
        return self.versions[name][-1]

    def write(self, name: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> str:
        self.versions.setdefault(name, []).append(df)
        return self.current(name)

    def append(self, name: str, rows: DataFrame) -> None:
        self.write(name, self.read(name).unionByName(rows) if self.current(name) else rows)

    def log(self, name: str) -> DataFrame:
        return self.read(name)
