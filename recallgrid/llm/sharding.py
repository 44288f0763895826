"""Sharding by histogram sort: shards of near equal bytes in the order of a key.

Rows have a key of three longs: a hash of the columns to order by, a hash of the id, and the row's number in a
written table, so that no two keys are equal and a group of copies can be cut anywhere. Shard k ends where k of
the shards' shares of all bytes lie below. To find these splitters, the driver sends candidate boundaries, each
task places its rows among them, and one small aggregate gives the exact bytes and rows below each. The next
candidates lie evenly inside the gap that holds a splitter, between the least and greatest key found there, until
a boundary is within the tolerance or the gap holds one row, of whose two sides the nearer is taken. Smaller
pieces for the sort are cut in the same rounds, by rows. Then rows are exchanged once, by piece, and sorted inside
it; a row's slot is its rank in the piece plus the exact count of rows before the piece in the shard.

What the driver holds grows with shards, pieces (``PIECES`` at most) and candidates, not with rows. As the hash comes first,
copies lie side by side and share a shard unless a splitter must fall inside their group.

Defined results: null text has no bytes, so size 1; an empty table gives an empty one; rows of equal text and id are
alike and dealt for themselves; a row larger than a shard's share leaves shards beside it empty. Columns are
carried in one struct, so they may have any names.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

KEY = ["k0", "k1", "k2"]
WIDTH = 8 * len(KEY)
#: Candidates for the first round and, for each splitter, in each further one; pieces at most, and rows that a piece is worth.
FIRST, NEXT, PIECES, PIECE_ROWS = 4096, 256, 1024, 100_000
SIGN = np.uint64(1 << 63)


def packed(batch: pa.RecordBatch) -> np.ndarray:
    """Each row's key as 24 bytes that sort as its longs do."""
    longs = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in KEY], axis=1).astype(np.int64)
    return np.ascontiguousarray((longs.view(np.uint64) ^ SIGN).astype(">u8")).view(f"S{WIDTH}").ravel()


def located(rows: DataFrame, bounds: list[int], name: str) -> DataFrame:
    """How many of the sorted boundaries are at most the row's key."""
    blob = b"".join(b.to_bytes(WIDTH, "big") for b in bounds)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.frombuffer(blob, f"S{WIDTH}") if blob else np.empty(0, f"S{WIDTH}")
        for batch in batches:
            at = np.searchsorted(edges, packed(batch), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], [*batch.schema.names, name])

    return rows.mapInArrow(place, rows.withColumn(name, F.lit(0)).schema)


def _span(gap) -> tuple[int, int]:
    """The least and the greatest key that a gap can hold, from the extremes of each long."""
    low, high = [], []
    for c in KEY:
        low.append(gap[f"low_{c}"] + (1 << 63))
        high.append(gap[f"high_{c}"] + (1 << 63))
        if low[-1] != high[-1]:
            break
    rest = len(KEY) - len(low)
    low, high = low + [0] * rest, high + [(1 << 64) - 1] * rest
    return tuple(int.from_bytes(b"".join(x.to_bytes(8, "big") for x in key), "big") for key in (low, high))


def _between(low: int, high: int, n: int) -> list[int]:
    """Boundaries that part the keys from low to high evenly, at most n, and those that part them from all others."""
    n = min(n, high - low)
    inner = [low + (high - low) * j // n for j in range(1, n + 1)]
    return [x for x in (low, *inner, high + 1) if x < 1 << 8 * WIDTH]


def histogram(rows: DataFrame, bounds: list[int]) -> list:
    """Exact bytes and rows of each gap between boundaries that holds any, with the extremes of its keys."""
    extremes = [f(c).alias(f"{side}_{c}") for c in KEY for f, side in ((F.min, "low"), (F.max, "high"))]
    found = located(rows.select(*KEY, "size"), bounds, "gap").groupBy("gap").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), *extremes)
    return sorted(found.collect(), key=lambda r: r.gap)


def splitters(rows: DataFrame, shards: int, tolerance: float, piece_rows: int = PIECE_ROWS) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Boundaries of shards and of pieces, each with the number of rows below it."""
    whole = histogram(rows, [])
    if not whole:
        return [], []
    total = whole[0]
    share, piece = total.bytes / shards, max(piece_rows, total.rows // PIECES)
    # What is still sought: (measure, how much of it lies below, how far off a boundary may be).
    sought = [("bytes", share * k, share * tolerance) for k in range(1, shards)]
    sought += [("rows", piece * k, piece / 4) for k in range(1, total.rows // piece)]
    bounds = _between(*_span(total), FIRST)
    found: dict = {}
    while any(goal not in found for goal in sought):
        gaps = histogram(rows, bounds)
        below = {"bytes": [0], "rows": [0]}
        for g in gaps:
            below["bytes"].append(below["bytes"][-1] + g.bytes)
            below["rows"].append(below["rows"][-1] + g.rows)
        # The boundary below a gap that holds rows; the one above it is that of the next such gap.
        edges = [0 if g.gap == 0 else bounds[g.gap - 1] for g in gaps] + [1 << 8 * WIDTH]
        wanted: set[int] = set()
        for goal in sought:
            if goal in found:
                continue
            measure, target, most = goal
            i = min(bisect_right(below[measure], target) - 1, len(gaps) - 1)
            near = min((i, i + 1), key=lambda j: abs(below[measure][j] - target))
            if abs(below[measure][near] - target) <= most or gaps[i].rows == 1:
                found[goal] = (edges[near], below["rows"][near])
            else:
                wanted.update(_between(*_span(gaps[i]), NEXT))
        bounds = sorted(wanted)
    return [found[g] for g in sought if g[0] == "bytes"], [found[g] for g in sought if g[0] == "rows"]


def sharded(docs: DataFrame, size: Column, by: list[Column], ident: Column, shards: int = 16, tolerance: float = 0.001, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Per input row: row (a struct of the input's columns), size, shard, and slot, its gapless place in the shard."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), size.cast("long").alias("size"), F.xxhash64(*by).alias("k0"), F.xxhash64(ident).alias("k1"), F.monotonically_increasing_id().alias("k2"))
    rows = written(rows, "sharding")
    ends, pieces = splitters(rows, shards, tolerance, piece_rows)
    shard_starts = [0, *(below for _, below in ends)]
    # Several splitters at one boundary leave shards empty; pieces end at each boundary once.
    cuts = sorted({(b, n) for b, n in [*ends, *pieces] if 0 < b < 1 << 8 * WIDTH})
    keys = sorted(b for b, _ in ends)
    firsts = [(0, 0), *cuts]
    shard_of = [bisect_right(keys, b) for b, _ in firsts]
    table = [(i, s, n - shard_starts[s]) for i, (s, (_, n)) in enumerate(zip(shard_of, firsts, strict=True))]
    told = rows.sparkSession.createDataFrame(table, "piece int, shard int, start long")  # PIECES and shards rows at most
    order = F.row_number().over(Window.partitionBy("piece").orderBy(*KEY))
    placed = located(rows, [b for b, _ in cuts], "piece").withColumn("order", order)
    return placed.join(F.broadcast(told), "piece").select("row", "size", "shard", (F.col("start") + F.col("order") - 1).alias("slot"))


def write_shards(dealt: DataFrame, path: str) -> None:
    """Each shard as a folder of files that hold its rows in order of slot; a task has the rows of few shards."""
    dealt.select("row.*", "shard", "slot").write.partitionBy("shard").parquet(path)
