"""The embedder interface, and filling in vectors that are missing.

An embedder is any object with ``dims`` and ``embed(texts)``, which gives a vector for each text; it is made on the
executors, once for each task, by a factory that travels with the plan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 50
MOST_ERRORS = 100


class Embedder(Protocol):
    dims: int

    def embed(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


def normalised(vector: Sequence[float]) -> list[float]:
    norm = sum(x * x for x in vector) ** 0.5
    return [x / norm for x in vector] if norm else list(vector)


class TermEmbedder:
    """A stand-in without a model: the mean of one fixed vector for each of the first 512 words, brought to unit length."""

    def __init__(self, dims: int = 64, context: int = 512):
        self.dims, self.context = dims, context

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        import numpy as np
        import xxhash

        out = []
        for text in texts:
            words = text.split()[: self.context]
            pooled = np.zeros(self.dims)
            for w in words:
                pooled += np.random.Generator(np.random.PCG64(xxhash.xxh64_intdigest(w))).standard_normal(self.dims)
            out.append(normalised((pooled / max(1, len(words))).tolist()))
        return out


def embedded(rows: DataFrame, make: Callable[[], Embedder], text_col: str = "content", batch: int = BATCH, most_errors: int = MOST_ERRORS) -> DataFrame:
    """Rows with embedding and error. Texts go to the embedder in batches; if a batch fails, its texts go one by one, and one
    that fails has an error and no vector. A task with more errors than most_errors gives up, with an error of its own.
    A vector of another length than the embedder's is an error."""
    import pyarrow as pa

    columns = [c for c in rows.columns if c not in ("embedding", "error")]
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c in columns)
    at = columns.index(text_col)

    def run(batches):
        embedder, failed = make(), 0

        def one(text: str):
            nonlocal failed
            try:
                return checked(embedder.embed([text]))[0], None
            except Exception as e:  # noqa: BLE001  a text's failure is its own result
                failed += 1
                if failed > most_errors:
                    raise RuntimeError(f"more than {most_errors} texts could not be embedded, last: {e}") from e
                return None, str(e)

        def checked(vectors):
            if any(len(v) != embedder.dims for v in vectors):
                raise ValueError(f"a vector hasn't {embedder.dims} components")
            return [list(map(float, v)) for v in vectors]

        for given in batches:
            for k in range(0, given.num_rows, batch):
                part = given.slice(k, batch)
                texts = [t or "" for t in part.column(at).to_pylist()]
                try:
                    found = [(v, None) for v in checked(embedder.embed(texts))]
                except Exception:  # noqa: BLE001  tried again one by one
                    found = [one(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([v for v, _ in found], pa.list_(pa.float64())), pa.array([e for _, e in found], pa.string())], names=[*columns, "embedding", "error"]
                )

    return rows.select(*(F.col(f"`{c}`") for c in columns)).mapInArrow(run, f"{schema}, embedding array<double>, error string")


def backfilled(memories: DataFrame, make: Callable[[], Embedder], batch: int = BATCH, most_errors: int = MOST_ERRORS) -> DataFrame:
    """Memories whose missing vectors were made; those that could not be made stay missing. Only rows without one are embedded."""
    kind = dict(memories.dtypes)["embedding"]
    made = embedded(memories.where("embedding is null").select("id", "content"), make, batch=batch, most_errors=most_errors)
    vectors = made.where("embedding is not null").select("id", F.col("embedding").cast(kind).alias("made"))
    return memories.join(vectors, "id", "left").withColumn("embedding", F.coalesce("embedding", "made")).drop("made")


def enriched(memories: DataFrame, enrichments: DataFrame, ask: Callable[[str], Sequence[str]], make: Callable[[], Embedder], queries: int = 3) -> DataFrame:
    """(memory_id, seq, embedding) with vectors of the first so many queries that ask makes of each memory that has none."""
    import pyarrow as pa

    lacking = memories.join(enrichments.select(F.col("memory_id").alias("id")).distinct(), "id", "left_anti").select("id", "content")
    kind = dict(memories.dtypes)["id"]

    def run(batches):
        for given in batches:
            asked = [(i, n, q) for i, text in zip(given.column(0).to_pylist(), given.column(1).to_pylist(), strict=True) for n, q in enumerate(list(ask(text or ""))[:queries])]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in asked], given.schema.field(0).type), pa.array([x[1] for x in asked], pa.int32()), pa.array([x[2] for x in asked], pa.string())], names=["memory_id", "seq", "content"])

    made = embedded(lacking.mapInArrow(run, f"memory_id {kind}, seq int, content string"), make).where("embedding is not null")
    vector = dict(enrichments.dtypes)["embedding"]
    return enrichments.unionByName(made.select("memory_id", "seq", F.col("embedding").cast(vector).alias("embedding")))
