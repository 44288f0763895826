"""Approximate nearest neighbours by stable projections, kd-trees and a chi-square stopping test.

Nearness is the largest inner product. A vector x gets one more component, sqrt(M - |x|^2) with M the largest
squared norm, and a query is scaled to norm sqrt(M) and gets 0: then the nearest in Euclidean distance are those
of largest inner product, and squared distances are at most 4 M. All are projected by one Gaussian (2-stable)
matrix to few dimensions; its columns are made orthogonal where there are no more than components, which only
narrows the spread of projected distances. For a projection of p dimensions, the squared projected distance over the
squared distance is chi-square distributed with p degrees of freedom. So the vectors of a query are taken in the order
of their projected distance, leaf by leaf of a kd-tree and within leaves one by one, and verified on the original
components, until a vector as near as the k-th best found would, at the confidence asked for, have been met
already. With the defaults some 30 to 45 in a hundred vectors are verified on vectors without any structure.

The index covers all rows. A top kd-tree, fitted on a bounded sample (``sample_rows`` of smallest hash), deals them
to blocks of bounded size, each with a tree of its own; a cell that holds more (many equal vectors) is dealt to several
blocks by a hash of the id. A query first searches the block that it lies in, which gives the score to beat, and
then only the blocks whose box in the projected space is not beyond the stopping radius. So a block's vectors move
once for the first search and once for each ``chunk_rows`` queries that come to it. A task's memory is that of a block
and a chunk; the driver holds the boxes of all blocks, half a kilobyte for each 16,384 vectors.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component take no part, as
queries or as candidates; all other finite vectors do, however large or small (what compares them is scaled by the
largest component; scores are of the vectors as they are, so they may overflow, and one that is not a number comes
last); vectors of different lengths don't meet; of equal scores the smaller id is nearer; repeated ids are
candidates each for itself, except of the query of that id; rows without an id take no part; an empty table gives an empty one.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

LEAF = 32


def chi_square_cdf(x: np.ndarray, p: int) -> np.ndarray:
    """For even p, in closed form."""
    half = np.asarray(x, float) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, p // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def chi_square_quantile(confidence: float, p: int) -> float:
    lo, hi = 0.0, 400.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(mid, p) < confidence else (lo, mid)
    return hi


class Tree:
    """A kd-tree whose leaves are slices of a permutation, with their bounding boxes."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.points = points
        slices = []
        todo = [(0, len(points))]
        while todo:
            lo, hi = todo.pop()
            own = points[self.order[lo:hi]]
            spread = own.max(axis=0) - own.min(axis=0)
            axis = int(spread.argmax())
            if hi - lo <= LEAF or spread[axis] == 0:
                for at in range(lo, hi, LEAF):
                    slices.append((at, min(hi, at + LEAF)))
                continue
            mid = (hi - lo) // 2
            self.order[lo:hi] = self.order[lo:hi][np.argpartition(own[:, axis], mid)]
            todo += [(lo, lo + mid), (lo + mid, hi)]
        self.slices = sorted(slices)
        self.starts = np.array([a for a, _ in self.slices])
        self.ends = np.array([b for _, b in self.slices])
        ordered = points[self.order]
        self.low = np.minimum.reduceat(ordered, self.starts, axis=0)
        self.high = np.maximum.reduceat(ordered, self.starts, axis=0)

    def leaf_distances(self, q: np.ndarray) -> np.ndarray:
        """Squared projected distance from q to each leaf's box."""
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        return np.einsum("ij,ij->i", gap, gap)

    def rows(self, leaves: np.ndarray) -> np.ndarray:
        """Places in the order of the tree of what some leaves hold."""
        keep = np.zeros(len(self.order) + 1, np.int64)
        keep[self.starts[leaves]] += 1
        keep[self.ends[leaves]] -= 1
        return np.nonzero(np.cumsum(keep[:-1]))[0]


def projection(components: int, dims: int, seed: int) -> np.ndarray:
    """A Gaussian matrix; with as many components as dimensions or more, its columns are made orthogonal, of the norm they have on average."""
    matrix = np.random.Generator(np.random.PCG64(seed)).standard_normal((components, dims))
    return np.linalg.qr(matrix)[0] * math.sqrt(components) if dims <= components else matrix


class Space:
    """What scales and projects the vectors of one length: the largest component, and the largest squared norm in units of its square."""

    def __init__(self, components: int, unit: float, largest: float, dims: int, seed: int):
        self.unit, self.largest = unit, largest
        self.matrix = projection(components + 1, dims, seed)

    def placed(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled vectors and their projections."""
        scaled = vectors / self.unit
        more = np.sqrt(np.maximum(0.0, self.largest - np.einsum("ij,ij->i", scaled, scaled)))
        return scaled, np.column_stack([scaled, more]) @ self.matrix

    def asked(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries of norm sqrt(largest), and their projections."""
        own = queries / np.abs(queries).max(axis=1, keepdims=True)
        own *= math.sqrt(self.largest) / np.sqrt(np.einsum("ij,ij->i", own, own))[:, None]
        return own, own @ self.matrix[:-1]

    def reach(self, score: float) -> float:
        """Squared distance of a vector whose scaled product with a query has this value."""
        return max(0.0, 2 * self.largest - 2 * score)


class Index:
    #: How many projected neighbours are verified between two looks at the radius, at first; then four times as many.
    STEP = 384
    #: Queries whose projected distances are computed together, and the share of leaves from which this is done.
    TOGETHER, WIDE = 32, 0.25

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, space: Space):
        self.space = space
        scaled, points = space.placed(vectors)
        self.tree = Tree(points)
        order = self.tree.order
        self.ids, self.vectors, self.scaled, self.points = ids[order], vectors[order], scaled[order], points[order]
        self.squares = np.einsum("ij,ij->i", self.points, self.points)
        self.verified = 0

    def search_all(self, ids: np.ndarray, queries: np.ndarray, k: int, quantile: float, floors: np.ndarray):
        """For each query its id, and ids, exact scores and scaled scores of the k best; a floor is a scaled score that k vectors
        are known to reach."""
        own, at = self.space.asked(queries)
        for begin in range(0, len(ids), self.TOGETHER):
            these = range(begin, min(len(ids), begin + self.TOGETHER))
            leaves = {i: np.nonzero(self.tree.leaf_distances(at[i]) <= self.radius(floors[i], quantile))[0] for i in these}
            wide = [i for i in these if len(leaves[i]) > self.WIDE * len(self.tree.slices)]
            products = dict(zip(wide, (self.points @ at[wide].T).T, strict=True)) if wide else {}
            for i in these:
                rows = self.tree.rows(leaves[i])
                dot = products[i][rows] if i in products else self.points[rows] @ at[i]
                far = np.maximum(self.squares[rows] - 2 * dot + float(at[i] @ at[i]), 0)
                yield ids[i], *self.search(ids[i], queries[i], own[i], rows, far, k, quantile, floors[i])

    def radius(self, worst: float, quantile: float) -> float:
        return quantile * self.space.reach(worst) * (1 + 1e-9) + 1e-9 * self.space.largest if worst > -math.inf else math.inf

    def search(self, query_id: int, query: np.ndarray, own: np.ndarray, rows: np.ndarray, far: np.ndarray, k: int, quantile: float, floor: float):
        """Incremental projected neighbours of one query: rows are taken by growing far and verified, until none is within the radius."""
        kept_at, kept, worst, step = np.empty(0, np.int64), np.empty(0), floor, self.STEP
        while len(rows):
            near = far <= self.radius(worst, quantile)
            rows, far = rows[near], far[near]
            if len(rows) > step:
                order = np.argpartition(far, step)
                at, (rows, far) = rows[order[:step]], (rows[order[step:]], far[order[step:]])
            else:
                at, rows = rows, rows[:0]
            step *= 4
            at = at[self.ids[at] != query_id]
            self.verified += len(at)
            kept_at, kept = np.concatenate([kept_at, at]), np.concatenate([kept, self.scaled[at] @ own])
            if len(kept) > k:
                least = np.partition(kept, len(kept) - k)[len(kept) - k]
                best = kept >= least - 1e-9 * max(1.0, abs(least))
                kept_at, kept = kept_at[best], kept[best]
            if len(kept) >= k:
                worst = max(floor, float(np.partition(kept, len(kept) - k)[len(kept) - k]))
            far = far[: len(rows)]
        exact = dots(self.vectors[kept_at], query)
        best = np.lexsort((self.ids[kept_at], -exact))[:k]
        return self.ids[kept_at][best], exact[best], kept[best]


def dots(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products summed from the first component to the last, so that equal vectors score equal everywhere."""
    out = np.zeros(len(vectors))
    for i in range(len(query)):
        out += vectors[:, i] * query[i]
    return out


class Cells:
    """A top kd-tree: cuts a projected space into cells of like numbers of sampled points."""

    def __init__(self, points: np.ndarray, cells: int):
        self.cuts: list[tuple[int, float, int, int]] = []  # axis, place, below, above; a negative child is cell -1 - child
        self.cells = 0
        self.root = self._cut(points, cells)

    def _cut(self, points: np.ndarray, cells: int) -> int:
        spread = points.max(axis=0) - points.min(axis=0) if len(points) else np.zeros(1)
        axis = int(spread.argmax())
        if cells <= 1 or spread[axis] == 0:
            self.cells += 1
            return -self.cells
        place = float(np.quantile(points[:, axis], (cells // 2) / cells))
        below = points[:, axis] <= place
        if below.all():  # more than a share of equal values at the upper end
            place = float(points[points[:, axis] < place, axis].max())
            below = points[:, axis] <= place
        at = len(self.cuts)
        self.cuts.append((axis, place, 0, 0))
        self.cuts[at] = (axis, place, self._cut(points[below], cells // 2), self._cut(points[~below], cells - cells // 2))
        return at

    def of(self, points: np.ndarray) -> np.ndarray:
        out = np.full(len(points), self.root)
        while (inner := np.nonzero(out >= 0)[0]).size:
            for at in np.unique(out[inner]):
                axis, place, below, above = self.cuts[at]
                here = inner[out[inner] == at]
                out[here] = np.where(points[here, axis] <= place, below, above)
        return -1 - out


def neighbours(
    vectors: DataFrame,
    queries=None,
    k: int = 20,
    dims: int = 32,
    confidence: float = 0.94,
    block_rows: int = 16_384,
    chunk_rows: int = 8_192,
    sample_rows: int = 20_000,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    seed: int = 7,
) -> DataFrame:
    """(query_id, rank, id, score) of the k nearest of each row that the condition queries picks (all, if none)."""
    import pyarrow as pa

    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and size(v) > 0")
    own = own.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x != 0)")
    peak = F.expr("array_max(transform(v, x -> abs(x)))")
    plain = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    scaled = F.aggregate(F.transform("v", lambda x: x / peak), F.lit(0.0), lambda a, x: a + x * x)  # where squares are too large or too small
    sized = own.select(F.size("v").alias("dim"), peak.alias("peak"), F.when((plain > 1e-290) & (plain < 1e300), F.log(plain)).otherwise(2 * F.log(peak) + F.log(scaled)).alias("log"))
    facts = sized.groupBy("dim").agg(F.count("*").alias("n"), F.max("peak").alias("unit"), F.max("log").alias("log")).collect()
    spaces = {r.dim: Space(r.dim, r.unit, math.exp(r.log - 2 * math.log(r.unit)) * (1 + 1e-9), dims, seed) for r in facts}
    quantile = chi_square_quantile(confidence, dims)
    own = own.withColumn("dim", F.size("v"))

    def matrix(t) -> np.ndarray:
        v = t.column("v").combine_chunks() if isinstance(t, pa.Table) else t.column(t.schema.get_field_index("v"))
        return v.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)

    # The cells of each length's space, from a bounded sample; a length of few rows has one.
    cells: dict[int, Cells] = {}
    for r in facts:
        wanted = math.ceil(r.n / block_rows)
        if wanted > 1:
            sample = own.where(F.col("dim") == r.dim).orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").toArrow()
            cells[r.dim] = Cells(spaces[r.dim].placed(matrix(sample))[1], wanted)

    def dealt(batches):
        """The cell of each vector."""
        for batch in batches:
            dim, out = batch.column("dim").to_numpy(), np.zeros(batch.num_rows, np.int32)
            for d in np.unique(dim):
                if int(d) in cells:
                    here = np.nonzero(dim == d)[0]
                    out[here] = cells[int(d)].of(spaces[int(d)].placed(matrix(batch.take(pa.array(here))))[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=["dim", "id", "v", "cell"])

    kinds = "dim int, id long, v array<double>, cell int"
    placed = written(own.select("dim", "id", "v").mapInArrow(dealt, kinds), "cells")
    counts = placed.groupBy("dim", "cell").agg(F.count("*").alias("n")).select("dim", "cell", F.ceil(F.col("n") / block_rows).cast("int").alias("parts"))
    # A block is a cell, or a part of one.
    block = [F.col("dim"), F.col("cell"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")]
    rows = written(placed.join(F.broadcast(counts), ["dim", "cell"]).select(*block, "id", "v"), "blocks")
    asked = rows.where(queries(F.col("id"))) if queries is not None else rows
    keys = ("dim", "cell", "part", "chunk")

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)], [np.empty(0)]
        if left.num_rows and right.num_rows:
            ids, v = left.column("id").to_numpy(), matrix(left)
            space = spaces[v.shape[1]]
            first = np.argsort(ids, kind="stable")
            index = Index(ids[first], v[first], space)
            for q, near, score, scaled in index.search_all(right.column("id").to_numpy(), matrix(right), k, quantile, right.column("floor").to_numpy()):
                for held, values in zip(out, (np.full(len(near), q, np.int64), near, score, scaled), strict=True):
                    held.append(values)
        return pa.table(dict(zip(("query_id", "id", "score", "scaled"), map(np.concatenate, out), strict=True)))

    def searched(asks: DataFrame) -> DataFrame:
        """Blocks against the queries that come to each, in chunks; rows of asks are (dim, cell, part, id, v, floor)."""
        asks = asks.select(*[F.col(c).alias(c) for c in asks.columns])  # columns of its own, as rows are on the other side
        chunks = written(asks.groupBy("dim", "cell", "part").agg(F.ceil(F.count("*") / chunk_rows).cast("int").alias("chunks")), "chunks")
        left = rows.join(F.broadcast(chunks), ["dim", "cell", "part"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        right = asks.join(F.broadcast(chunks), ["dim", "cell", "part"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
        right = right.select(*[F.col(c).alias(c) for c in (*keys, "id", "v", "floor")])
        cogrouped = left.select(*keys, "id", "v").groupBy(*keys).cogroup(right.groupBy(*keys))
        return cogrouped.applyInArrow(tile, "query_id long, id long, score double, scaled double")

    # First the block that a query lies in, for the score to beat.
    near = written(searched(asked.select("dim", "cell", "part", "id", "v", F.lit(-math.inf).alias("floor"))), "near")
    floors = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("scaled")).otherwise(-math.inf).alias("floor"))
    boxes: dict[int, list] = {}
    here = near.select("query_id", "id", "score")
    if (counts.agg(F.sum("parts")).first()[0] or 0) > 1:
        for r in box_table(rows, spaces, matrix).collect():  # a row of 2 * dims numbers for each block
            boxes.setdefault(r.dim, []).append((r.cell, r.part, r.low, r.high))
        packed = {d: (np.array([x[:2] for x in b], np.int32), np.array([x[2] for x in b]), np.array([x[3] for x in b])) for d, b in boxes.items()}

        def routed(batches):
            """The other blocks that a query has to search."""
            for batch in batches:
                dim = batch.column("dim").to_numpy()
                home = np.column_stack([batch.column(c).to_numpy() for c in ("cell", "part")])
                floor, out = batch.column("floor").to_numpy(), []
                for d in np.unique(dim):
                    space, (names, low, high) = spaces[int(d)], packed[int(d)]
                    at = np.nonzero(dim == d)[0]
                    for i, x in zip(at, space.asked(matrix(batch.take(pa.array(at))))[1], strict=True):
                        gap = np.maximum(np.maximum(low - x, x - high), 0)
                        reach = quantile * space.reach(floor[i]) * (1 + 1e-9) if floor[i] > -math.inf else math.inf
                        go = (np.einsum("ij,ij->i", gap, gap) <= reach) & (names != home[i]).any(axis=1)
                        out += [(i, *names[j]) for j in np.nonzero(go)[0]]
                at, cell, part = (pa.array([x[c] for x in out], pa.int32()) for c in range(3))
                moved = batch.take(at)
                yield pa.RecordBatch.from_arrays([moved.column("dim"), cell, part, moved.column("id"), moved.column("v"), moved.column("floor")], names=["dim", "cell", "part", "id", "v", "floor"])

        told = asked.join(floors.withColumnRenamed("query_id", "id"), "id", "left").withColumn("floor", F.coalesce("floor", F.lit(-math.inf)))
        asks = written(told.select("dim", "cell", "part", "id", "v", "floor").mapInArrow(routed, "dim int, cell int, part int, id long, v array<double>, floor double"), "routed")
        here = here.union(searched(asks).select("query_id", "id", "score"))
    # A score that is not a number comes last.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.isnan("score"), F.col("score").desc(), "id"))
    return here.withColumn("rank", rank).where(f"rank <= {k}").select("query_id", "rank", F.col("id").alias(id_col), "score")


def box_table(rows: DataFrame, spaces: dict[int, Space], matrix) -> DataFrame:
    """The projected box of each block: partial boxes of Arrow batches, joined by minima and maxima."""
    import pyarrow as pa

    def partial(batches):
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy() for c in ("dim", "cell", "part")])
            out = []
            for key in np.unique(keys, axis=0):
                points = spaces[int(key[0])].placed(matrix(batch.take(pa.array(np.nonzero((keys == key).all(axis=1))[0]))))[1]
                out += [(*map(int, key), i, float(a), float(b)) for i, (a, b) in enumerate(zip(points.min(axis=0), points.max(axis=0), strict=True))]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], kind) for c, kind in enumerate(kinds)], names=["dim", "cell", "part", "axis", "low", "high"])

    ends = rows.select("dim", "cell", "part", "v").mapInArrow(partial, "dim int, cell int, part int, axis int, low double, high double")
    ends = ends.groupBy("dim", "cell", "part", "axis").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    each = ends.groupBy("dim", "cell", "part").agg(F.sort_array(F.collect_list(F.struct("axis", "low", "high"))).alias("ends"))
    return each.select("dim", "cell", "part", F.col("ends.low").alias("low"), F.col("ends.high").alias("high"))
