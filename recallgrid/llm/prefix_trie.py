"""A trie of conversation prefixes by mergesort that knows common prefixes.

A conversation is a path: the SHA-256 of each turn's role and text, in order, one after the other, so paths sort as
bytes. Tasks sort their conversations by path and id into runs in which each row carries its LCP, the number of leading turns that
it shares with the row before; runs are written as a table. One exchange by range, split by path and id, so that no
common prefix and no group of equal conversations need fit a task, brings each range its slice of every run. A loser tree
merges the slices: of two heads the one with the greater LCP to the last output comes first, and only equal LCPs
have turns compared, from there on. The merged stream, with its LCPs, runs over a stack of open nodes: what a row
doesn't share with the one before is finished and emitted.

Nodes on the path of a range's first or last row may go on in another range. Of these a task emits parts, at most two a level; they are
summed by node, then folded from the deepest up by one task, which reads as many rows as there are ranges times turns
of a path, not conversations. Their conversations' ids are hashed in order of the pieces. A node whose children are many hands
them on before it is finished; these, and children of split nodes, learn their parent's id by a join.

Defined results: turns go by number, null first, ties by role and then by the turn's hash; null role and text are empty; rows
without a conversation id belong to none; repeated rows are turns of their own; an empty table gives no node. A conversation
is one row, so its hashes (36 bytes a turn) must fit a task; its texts are hashed where they are read and never moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_first, written

DIGEST = 32
#: Bytes of paths in a run and in a range, and children that a node may keep waiting for its id.
RUN_BYTES, RANGE_BYTES, WAITING = 32 << 20, 48 << 20, 1024
TURN = "struct<digest:string,chars:int>"


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as hash and code points."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", role.alias("role"), digest.alias("digest"), F.length(text).alias("chars")).alias("t"))
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return ordered.select("conv_id", F.transform("ts", lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars"))).cast(f"array<{TURN}>").alias("turns"))


def grafted(seqs: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Conversations that begin as the first of their hundred does: its first h turns, then their own after as many; h from a
    hash of the id."""
    heads = seqs.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    own = seqs.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int"))
    head = F.coalesce(F.col("head"), F.array().cast(f"array<{TURN}>"))
    turns = F.concat(F.slice(head, F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns")))
    return own.join(heads, "base", "left").select("conv_id", turns.alias("turns"))


def lcp(a: bytes, b: bytes, known: int = 0) -> int:
    """How many leading turns two paths share, of which some are known."""
    if a == b:
        return len(a) // DIGEST
    at, most = known * DIGEST, min(len(a), len(b))
    while at < most and a[at : at + DIGEST] == b[at : at + DIGEST]:
        at += DIGEST
    return at // DIGEST


RUNS = "run long, at int, lcp int, conv_id long, path binary, chars array<int>"


def sorted_runs(seqs: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Runs of rows in order of path and id, each with what it shares with the row before it in its run."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        run, held, size = TaskContext.get().partitionId() << 32, [], 0

        def finished() -> Iterator[pa.RecordBatch]:
            held.sort(key=lambda r: r[:2])
            shared = [0, *(lcp(a[0], b[0]) for a, b in zip(held, held[1:], strict=False))]
            for i in range(0, len(held), 2000):
                rows = held[i : i + 2000]
                columns = [[run] * len(rows), range(i, i + len(rows)), shared[i : i + 2000], [r[1] for r in rows], [r[0] for r in rows], [r[2] for r in rows]]
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["run", "at", "lcp", "conv_id", "path", "chars"])
            held.clear()

        for batch in batches:
            for p, i, c in zip(batch["path"].to_pylist(), batch["conv_id"].to_pylist(), batch["chars"].to_pylist(), strict=True):
                held.append((p, i, c))
                size += len(p) + 64
                if size >= run_bytes:
                    yield from finished()
                    run, size = run + 1, 0
        yield from finished()

    return seqs.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["chars"]).alias("chars")).mapInArrow(form, RUNS)


def merged(runs: list[list[tuple]]) -> Iterator[tuple[bytes, int, list[int], int]]:
    """Rows (path, conv_id, chars, lcp) of sorted runs in one order, lcp now with the row before in that order: a loser tree that
    compares turns only where two heads share equally much with the last output, and from there on."""
    k = len(runs)
    if not k:
        return
    at, shared = [0] * k, [0] * k

    def beats(a: int, b: int) -> bool:
        """Whether head a comes before head b; the loser's LCP becomes that with the winner. Ended runs have LCP -1."""
        if shared[a] != shared[b] or shared[a] < 0:
            return shared[a] > shared[b]
        (p, i, *_), (q, j, *_) = runs[a][at[a]], runs[b][at[b]]
        common = lcp(p, q, shared[a])
        first = (p[common * DIGEST : (common + 1) * DIGEST], i) <= (q[common * DIGEST : (common + 1) * DIGEST], j)
        shared[b if first else a] = common
        return first

    losers, winners = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    best = winners[1]
    while shared[best] >= 0:
        path, conv, chars, _ = runs[best][at[best]]
        yield path, conv, chars, shared[best]
        at[best] += 1
        shared[best] = runs[best][at[best]][3] if at[best] < len(runs[best]) else -1
        node = (k + best) // 2
        while node:
            if not beats(best, losers[node]):
                best, losers[node] = losers[node], best
            node //= 2


class Node:
    """An open node: sums over the finished part of its subtree, and finished children that wait for its id."""

    __slots__ = ("conv", "n", "children", "leaves", "saved", "chars", "ends", "waiting", "handed", "split")

    def __init__(self, chars: int, split: bool) -> None:
        self.conv, self.n, self.children, self.leaves, self.saved, self.chars = None, 0, 0, 0, 0, chars
        self.ends: list[int] = []
        self.waiting: list[tuple] = []
        self.handed = self.split = split


#: What a task emits. DONE: a finished node, with its parent's id or, if that isn't known, its key; NAME: the id of a node whose
#: children were handed on; PART: of a split node; ENDS: ids of conversations that end at a split node.
DONE, NAME, PART, ENDS = range(4)
EMITTED = "kind int, key binary, parent binary, conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, chars int, ends string"


def digest_of(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def nodes_of(rows: Iterator[tuple[bytes, int, list[int], int]], most_waiting: int = WAITING) -> Iterator[tuple]:
    """What EMITTED names, from rows in order with their LCPs."""
    stack: list[Node] = []
    path = b""

    def key(depth: int) -> bytes:
        return hashlib.sha256(path[: depth * DIGEST]).digest()

    def hand_on(node: Node, depth: int) -> Iterator[tuple]:
        """Children whose parent isn't finished, by its key."""
        parent = key(depth)
        for row in node.waiting:
            yield (DONE, None, parent, *row)
        node.waiting.clear()
        node.handed = True

    def close(last: bool) -> Iterator[tuple]:
        depth, node = len(stack) - 1, stack.pop()
        parent = stack[-1] if stack else None
        if parent is not None:
            parent.n += node.n
            parent.conv = node.conv if parent.conv is None else min(parent.conv, node.conv)
        if node.split or last:
            yield from hand_on(node, depth)
            above = key(depth - 1) if depth else None
            yield (PART, key(depth), above, node.conv, depth, None, node.n, node.children, node.leaves, node.saved, node.chars, None)
            if node.ends:
                yield (ENDS, key(depth), None, node.ends[0], depth, None, None, None, None, None, None, ",".join(map(str, node.ends)))
            return
        node.leaves += not node.children
        node.saved += (node.n - 1) * node.chars
        parent.children += 1
        parent.leaves += node.leaves
        parent.saved += node.saved
        for row in node.waiting:
            yield (DONE, None, None, row[0], row[1], node.conv, *row[3:])
        if node.handed:
            yield (NAME, key(depth), None, node.conv, depth, None, None, None, None, None, None, None)
        parent.waiting.append((node.conv, depth, None, node.n, node.children, node.leaves, node.saved, node.chars, digest_of(node.ends)))
        if len(parent.waiting) >= most_waiting:
            yield from hand_on(parent, depth - 1)

    for row_path, conv, chars, shared in rows:
        first = not stack
        while len(stack) > shared + 1:
            yield from close(False)
        path = row_path
        while len(stack) <= len(chars):
            stack.append(Node(chars[len(stack) - 1] if stack else 0, first))
        node = stack[-1]
        node.n += 1
        node.conv = conv if node.conv is None else min(node.conv, conv)
        node.ends.append(conv)
    while stack:
        yield from close(True)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    named = [c.split() for c in EMITTED.split(", ")]
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, named, strict=True)], [n for n, _ in named])


def batched(rows: Iterator[tuple], n: int = 5000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= n:
            yield _table(held)
            held.clear()
    if held:
        yield _table(held)


def merge_range(batches: Iterator[pa.RecordBatch], most_waiting: int = WAITING) -> Iterator[pa.RecordBatch]:
    """Nodes of a range from its slices of all runs, each slice in order."""
    runs: dict[int, list[tuple]] = {}
    for batch in batches:
        for run, shared, conv, path, chars in zip(*(batch[c].to_pylist() for c in ("run", "lcp", "conv_id", "path", "chars")), strict=True):
            mine = runs.setdefault(run, [])
            mine.append((path, conv, chars, shared if mine else 0))
    yield from batched(nodes_of(merged(list(runs.values())), most_waiting))


def fold_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Split nodes, summed over ranges, from the deepest up."""
    nodes = {row["key"]: row for batch in batches for row in batch.to_pylist()}
    for row in sorted(nodes.values(), key=lambda r: -r["depth"]):
        row["n_leaves"] += not row["n_children"]
        row["saved_tokens"] += (row["n_convs"] - 1) * row["chars"]
        if above := nodes.get(row["parent"]):
            above["n_children"] += 1
            above["n_leaves"] += row["n_leaves"]
            above["saved_tokens"] += row["saved_tokens"]
            row["parent_conv_id"] = above["conv_id"]
    yield from batched(tuple(row[c.split()[0]] for c in EMITTED.split(", ")) for row in nodes.values())


def hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends_sha256) of pieces that come in order of key and id; of a node, one hash and one piece are held."""
    key, state = None, None

    def told() -> Iterator[pa.RecordBatch]:
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])

    for batch in batches:
        for k, ids in zip(batch["key"].to_pylist(), batch["ends"].to_pylist(), strict=True):
            if k != key or state is None:
                yield from told()
                key, state = k, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    yield from told()


def prefix_trie(seqs: DataFrame, run_bytes: int = RUN_BYTES, most_waiting: int = WAITING) -> DataFrame:
    """Per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = seqs.sparkSession
    runs = written(sorted_runs(seqs, run_bytes), "trie-runs")
    size = runs.agg(F.sum(F.length("path") + 4 * F.size("chars") + 40).alias("size")).first().size or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + size // RANGE_BYTES)
    dealt = runs.repartitionByRange(ranges, "path", "conv_id").sortWithinPartitions("run", "at")
    out = written(dealt.mapInArrow(lambda batches: merge_range(batches, most_waiting), EMITTED), "trie-nodes")

    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    parts = out.where(F.col("kind") == PART).groupBy("key", "depth", "chars").agg(F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"), *sums)
    parts = parts.select(F.lit(PART).alias("kind"), "key", "parent", "conv_id", "depth", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "chars", F.lit(None).cast("string").alias("ends"))
    split = written(parts.coalesce(1).mapInArrow(fold_parts, EMITTED), "trie-split")
    pieces = out.where(F.col("kind") == ENDS).select("key", "conv_id", "ends").repartition("key").sortWithinPartitions("key", "conv_id")
    ends = pieces.mapInArrow(hash_pieces, "key binary, ends_sha256 string")
    names = out.where(F.col("kind") == NAME).select("key", "conv_id").union(split.select("key", "conv_id"))
    names = small_first(written(names.select(F.col("key").alias("parent"), F.col("conv_id").alias("named")), "trie-names"))

    columns = ["conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256")]
    done = out.where(F.col("kind") == DONE)
    known = done.where("parent is null").select(*columns)
    late = done.where("parent is not null").join(names, "parent").withColumn("parent_conv_id", F.col("named")).select(*columns)
    split = split.drop("ends").join(ends, "key", "left").withColumn("ends", F.coalesce("ends_sha256", F.lit(digest_of([])))).select(*columns)
    return known.union(late).union(split)


def with_turns(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes of a trie over conversations as they are, with role and text of their last turns; the root has none."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), text.alias("text"), digest.alias("digest"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest"))
    return nodes.join(turns.select("conv_id", place.cast("long").alias("depth"), "role", "text"), ["conv_id", "depth"], "left")


OP13_SQL = r"""
WITH RECURSIVE turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY i) AS ts FROM turns GROUP BY conv_id),
bytes AS (SELECT conv_id, [ord(c) for c in string_split(conv_id::VARCHAR, '')] AS b FROM own),
-- CRC-32, byte by byte and bit by bit
crc AS (
  SELECT conv_id, b, 1 AS i, 4294967295::BIGINT AS x FROM bytes
  UNION ALL
  SELECT conv_id, b, i + 1, list_reduce(list_prepend(xor(x, b[i]::BIGINT), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)
  FROM crc WHERE i <= len(b)),
h AS (SELECT conv_id, xor(x, 4294967295::BIGINT) % 6 AS h FROM crc WHERE i = len(b) + 1),
rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(base.ts, [])[1:h], o.ts[h + 1:]) AS ts
  FROM own o JOIN h USING (conv_id) LEFT JOIN own base ON base.conv_id = o.conv_id - o.conv_id % 100),
members AS (SELECT conv_id, d, ts[1:d] AS p, len(ts) = d AS at_end FROM (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT p, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE at_end), '')) AS ends_sha256
  FROM members GROUP BY p, d),
kids AS (SELECT p[1:depth - 1] AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(n.p[depth].text) END AS own_saved
  FROM nodes n LEFT JOIN kids k ON k.p = n.p),
up AS (SELECT p[1:e] AS p, e, n_children, own_saved FROM (SELECT p, n_children, own_saved, unnest(range(0, depth + 1)) AS e FROM full_nodes)),
sums AS (SELECT p, e, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(own_saved)::BIGINT AS saved_tokens FROM up GROUP BY p, e)
SELECT f.conv_id, f.depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
FROM full_nodes f JOIN sums s ON s.p = f.p AND s.e = f.depth LEFT JOIN nodes q ON f.depth > 0 AND q.depth = f.depth - 1 AND q.p = f.p[1:f.depth - 1]
"""
