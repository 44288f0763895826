"""Exact nearest vectors by cosine, with cells that the triangle inequality rules out.

Vectors are laid out by the nearest of some pivots: a cell has a pivot and the least and greatest distance of its unit vectors from
it. No vector of a cell is nearer to a query than the query's distance from the pivot allows, so once the best k of the
most promising cells are known, a cell whose bound is below the k-th score can't change the result and isn't read; files are
sorted by cell, so row groups go with it. What is read is scored as a scan would score it: results are those of ``retrieval.knn``.

Changes are written as parts of their own, placed by the same pivots; a later part's ids hide those of the parts before it. When
parts are many, they are merged into one. Pivots are at most PIVOTS rows, and cells of a part as many; both come to the driver.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.operators import postings
from recallgrid.operators.retrieval import similar

#: Pivots at most, cells that are scored first, and parts that are merged into one.
PIVOTS, FIRST_CELLS, PARTS = 1024, 4, 8
#: The cell of vectors that have no direction, whose cosine is 0, and of those that have another size than the pivots.
NO_CELL = -1
CELL = "cell int, low double, high double, n long"


@dataclass
class Index:
    """vectors (part, cell, id, embedding) that hold, cells (part, cell, low, high, n), and the pivots of unit length."""

    vectors: DataFrame
    cells: DataFrame
    pivots: list[list[float]]


def _placed(vectors: DataFrame, pivots: list[list[float]]) -> DataFrame:
    """(cell, distance, id, embedding) of the vectors that aren't null."""
    import numpy as np
    import pyarrow as pa

    have = vectors.where("embedding is not null").select("id", "embedding")
    schema = have.schema

    def place(batches):
        p = np.array(pivots, float)
        for batch in batches:
            cells, distances = [], []
            for v in batch["embedding"].to_pylist():
                u = np.array([np.nan if x is None else x for x in v], float)
                norm = np.linalg.norm(u)
                if not len(p) or len(u) != p.shape[1] or not norm or not np.isfinite(norm):
                    cells.append(NO_CELL)
                    distances.append(0.0)
                    continue
                d = np.linalg.norm(p - u / norm, axis=1)
                cells.append(int(d.argmin()))
                distances.append(float(d.min()))
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(distances), *batch.columns], ["cell", "distance", *batch.schema.names])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return have.mapInArrow(place, f"cell int, distance double, {fields}")


def _write_part(vectors: DataFrame, changed: DataFrame, pivots: list[list[float]], path: str, number: int) -> None:
    """One part: its vectors sorted by cell, its cells, and the ids that it speaks for, those without a vector too."""
    spark, part = vectors.sparkSession, f"{path}/part={number:04d}"
    placed = _placed(vectors, pivots)
    placed.repartitionByRange(F.col("cell"), F.col("id")).sortWithinPartitions("cell", "id").write.option("parquet.block.size", 1 << 20).parquet(f"{part}/vectors")
    spark.read.parquet(f"{part}/vectors").groupBy("cell").agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.count("*").alias("n")).write.parquet(f"{part}/cells")
    changed.select("id").distinct().write.parquet(f"{part}/ids")


def pivots_of(vectors: DataFrame, most: int = PIVOTS) -> list[list[float]]:
    """Unit vectors of the rows of the least hashes, about one for every thirty rows, at most so many, of the commonest size."""
    have = vectors.where("embedding is not null").where("size(embedding) > 0")
    sizes = have.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    if sizes is None:
        return []
    n = max(1, min(most, sizes.n // 30))
    rows = have.where(F.size("embedding") == sizes["size"]).orderBy(F.xxhash64("id"), "id").limit(n).select("embedding").collect()
    out = []
    for r in rows:
        norm = sum(float(x) ** 2 for x in r.embedding if x is not None) ** 0.5
        if norm and None not in r.embedding:
            out.append([float(x) / norm for x in r.embedding])
    return out


def build(vectors: DataFrame, path: str, pivots: int = PIVOTS) -> None:
    """Write the index of (id, embedding) under a path; an id may have several rows."""
    chosen = pivots_of(vectors, pivots)
    _write_part(vectors, vectors, chosen, path, 0)
    vectors.sparkSession.createDataFrame([(json.dumps(chosen),)], "pivots string").coalesce(1).write.parquet(f"{path}/pivots")


def _parts(spark: SparkSession, path: str) -> list[int]:
    where, system = postings._files(spark, path)
    return sorted(int(s.getPath().getName().removeprefix("part=")) for s in system.listStatus(where) if s.getPath().getName().startswith("part="))


def load(spark: SparkSession, path: str) -> Index:
    numbers = _parts(spark, path)
    pivots = json.loads(spark.read.parquet(f"{path}/pivots").first().pivots)
    vectors = cells = None
    for i, number in enumerate(numbers):
        part = f"{path}/part={number:04d}"
        own = spark.read.parquet(f"{part}/vectors").select(F.lit(number).alias("part"), "cell", "id", "embedding")
        for later in numbers[i + 1 :]:
            own = own.join(spark.read.parquet(f"{path}/part={later:04d}/ids"), "id", "left_anti")
        own = own.select("part", "cell", "id", "embedding")
        edge = spark.read.parquet(f"{part}/cells").select(F.lit(number).alias("part"), "cell", "low", "high", "n")
        vectors, cells = (own, edge) if vectors is None else (vectors.unionByName(own), cells.unionByName(edge))
    return Index(vectors, cells, pivots)


def ensure(vectors: DataFrame, name: str, root: str | None = None) -> Index:
    """The index of vectors that are read from files, built if it isn't there; written beside and moved into place whole."""
    spark = vectors.sparkSession
    path = f"{root or postings.shared_root(spark)}/vectors-{name}-{postings.fingerprint(vectors)}"
    where, system = postings._files(spark, path)
    if not system.exists(where):
        aside = f"{path}-{uuid.uuid4().hex}"
        build(vectors, aside)
        source, _ = postings._files(spark, aside)
        if system.exists(where) or not system.rename(source, where):
            system.delete(source, True)
    return load(spark, path)


def changed(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Set the vectors of the given ids (id, embedding); a null embedding clears it. Only these rows are written, until there are
    so many parts that all are merged."""
    numbers = _parts(spark, path)
    index = load(spark, path)
    _write_part(rows, rows, index.pivots, path, numbers[-1] + 1)
    if len(numbers) >= PARTS:
        merged(spark, path)


def merged(spark: SparkSession, path: str) -> None:
    """One part in place of all, written beside and moved into place; the parts that it replaces go last."""
    old, index = _parts(spark, path), load(spark, path)
    number, aside = old[-1] + 1, f"{path}/aside-{uuid.uuid4().hex}"
    whole = index.vectors.select("id", "embedding")
    _write_part(whole, whole, index.pivots, aside, number)
    source, system = postings._files(spark, f"{aside}/part={number:04d}")
    target, _ = postings._files(spark, f"{path}/part={number:04d}")
    system.rename(source, target)
    for gone in [f"{path}/part={n:04d}" for n in old] + [aside]:
        where, system = postings._files(spark, gone)
        system.delete(where, True)


def bounds(index: Index, q: list[float]) -> dict[tuple[int, int], float]:
    """The greatest cosine that a vector of each (part, cell) can have to a query."""
    import numpy as np

    p, u = np.array(index.pivots, float), np.array(q, float)
    norm = np.linalg.norm(u)
    out = {}
    for r in index.cells.collect():
        if r.cell == NO_CELL or not norm or p.shape[1] != len(u):
            out[r.part, r.cell] = 1.0  # other sizes and no direction: always read
            continue
        d = float(np.linalg.norm(p[r.cell] - u / norm))
        least = max(0.0, d - r.high, r.low - d)
        out[r.part, r.cell] = 1.0 - least * least / 2 + 1e-9
    return out


def knn(index: Index, q: list[float], k: int, min_score: float | None = None) -> tuple[DataFrame, float]:
    """(id, score) of the k best ids, each by its best vector, and the share of vectors in the cells that were read."""
    spark = index.vectors.sparkSession
    asked = spark.createDataFrame([([float(x) for x in q],)], "q array<double>")
    limit = bounds(index, q)
    sizes = {(r.part, r.cell): r.n for r in index.cells.collect()}

    def best(cells) -> DataFrame:
        """The scan of some cells, each named to the scan of its part."""
        by_part: dict[int, list[int]] = {}
        for part, cell in cells:
            by_part.setdefault(part, []).append(cell)
        wanted = F.lit(False)
        for part, own in by_part.items():
            wanted = wanted | ((F.col("part") == part) & F.col("cell").isin(sorted(own)))
        hits = similar(index.vectors.where(wanted).select("id", "embedding"), asked, min_score)
        return hits.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(k)

    order = sorted(limit, key=lambda c: (-limit[c], c))
    first = best(order[:FIRST_CELLS]).collect()
    least = first[-1].score if len(first) == k else -2.0
    least = max(least, -2.0 if min_score is None else min_score)
    chosen = [c for c in order if limit[c] >= least]
    share = sum(sizes[c] for c in chosen) / max(1, sum(sizes.values()))
    return best(chosen), share
