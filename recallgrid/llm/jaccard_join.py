"""N-gram Jaccard join by parity sketches.

A document's set are its distinct shingles (runs of words of its text with A-Z in lower case; shorter texts are
one shingle). Two sets of sizes n and m whose Jaccard similarity is at least t differ in at most
d = (1 - t) / (1 + t) * (n + m) shingles. Each set has a parity sketch: every shingle flips one bit, so the
Hamming distance of two sketches is at most the symmetric difference of the sets.

For candidates, the sketch of a size band is cut into d + 1 + s blocks of 2**40 bits each. Two linked sets differ in
at most d blocks, so they agree in s + 1. A block's key is the XOR of a hash of each set bit. A document emits the
blocks of its own band and, if smaller partners may lie there, of the band below.

Blocks that say nothing are left out on both sides, as agreeing blocks say nothing in both or in neither:

- A block that no shingle meets has no key. If more than s of a document's blocks are empty, it gives the keys of a
  next cut as well (the same band, other hashes), up to the first cut with at most s. Both documents of a link give
  the keys of the first cut in which one of them has at most s empty blocks, and there they share a key.
- A key of more than ``hot`` sets says little (a phrase that many texts share, alone in its block). A document whose
  empty and hot blocks in a cut are at most s leaves its hot keys out there: with each partner it still shares a key
  that isn't hot. Documents with more of them keep their hot keys, so two such documents meet by those.

Equal sets (by size and hash) form one class beforehand. Documents that share a key are compared with the
least document of the key, not with each other; what that likely links (by the Hamming test of folded sketches) forms
groups, and only keys that still hold several groups have their other pairs compared, in tiles of bounded size. A tile
gives no pair that would join what its pairs have joined already, so a group of thousands of near copies costs a row
each. Likely links are verified on whole sets: first one pair for each document, which settles most groups. In a group
that these don't hold together, all documents of different components are compared, by sketch and then on whole
sets, again in tiles of bounded size that give the joining links alone. So no link is lost that a component rests on.

Defined results: null texts and texts without words have the empty set and link with nothing; ids are integers;
rows that share an id and differ in text are sets of their own, and link with each other, as one id has one
component (an empty set's row keeps its own id); rows of a null id take part, and a component's id is the least that isn't null;
other input columns are ignored.
"""

from __future__ import annotations

import math
from fractions import Fraction
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, small_first, written
from .words import MASK, forget, mixed, run_hashes, word_hashes

#: Each size band's upper end over its lower end.
BAND = 1.3
#: Below this threshold a cut could not have d + 1 blocks that aren't empty.
LOWEST = Fraction(7, 10)
#: A key's low bits name its band and cut; the last cut's number is that of the band's own key.
CUTS, TAG = 32, 4095


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(run_hashes(word_hashes(words), min(n, len(words))))


def band_of(n: int) -> int:
    return int(math.floor(math.log(n) / math.log(BAND) + 1e-12))


@lru_cache(maxsize=4096)
def band_ends(band: int) -> tuple[int, int]:
    """Smallest and largest set size of a band."""
    lo = math.ceil(BAND**band - 1e-9)
    while lo > 1 and band_of(lo - 1) >= band:
        lo -= 1
    while band_of(lo) < band:
        lo += 1
    hi = math.floor(BAND ** (band + 1) + 1e-9)
    while band_of(hi) > band:
        hi -= 1
    return lo, max(lo, hi)


@lru_cache(maxsize=4096)
def blocks_of(band: int, t: Fraction) -> tuple[int, int]:
    """How many blocks a band's sketch has, and how many of them, empty or hot, a document may leave out: as many as
    leave nine in ten of the band's smallest sets with one cut, and six in a hundred for hot ones."""
    lo, hi = band_ends(band)
    d = math.floor((1 - t) / (1 + t) * (hi + math.floor(hi / t)))
    if not d:
        return 1, 0  # only equal sets link here
    spare = more = math.ceil(0.06 * (d + 1)) if d >= 8 else 0
    while True:
        count = d + 1 + spare
        mean = count * (1 - 1 / count) ** lo
        spread = math.sqrt(max(0.0, mean + count * (count - 1) * (1 - 2 / count) ** lo - mean**2))
        wanted = more + (0 if mean <= 0.15 else math.ceil(mean + 1.3 * spread))
        if wanted <= spare:
            return count, spare
        spare = wanted


def block_keys(hashes: np.ndarray, band: int, t: Fraction) -> tuple[list[np.ndarray], list[int], list[int]]:
    """Keys of the blocks that a set shows in a band, and by cut its tag and how many more blocks it may leave out."""
    count, spare = blocks_of(band, t)
    keys, tags, left = [], [], []
    if count == 1:
        return keys, tags, left
    for cut in range(CUTS - 1):
        bits = mixed(hashes + np.uint64(0x51ED270B + 0x9E3779B97F4A7C15 * cut & MASK))
        block = ((bits >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        at, starts = np.unique(block[order], return_index=True)
        content = np.bitwise_xor.reduceat(mixed(bits[order] ^ np.uint64(0xA5A5)), starts)
        tag = band * CUTS + cut
        hashed = mixed(content + (at.astype(np.uint64) * np.uint64(4096) + np.uint64(tag)) * np.uint64(0x9E3779B97F4A7C15))
        keys.append(hashed & np.uint64(MASK ^ TAG) | np.uint64(tag))
        tags.append(tag)
        left.append(spare - (count - len(at)))
        if left[-1] >= 0:
            break
    else:  # no cut leaves few enough blocks empty: two such sets of a band meet in one key of the whole band
        tag = band * CUTS + CUTS - 1
        keys.append(np.array([band * 0x9E3779B97F4A7C15 & (MASK ^ TAG) | tag], np.uint64))
        tags.append(tag)
        left.append(0)
    return keys, tags, left


def keys_of(hashes: np.ndarray, t: Fraction) -> tuple[np.ndarray, list[int], list[int]]:
    n = len(hashes)
    band = band_of(n)
    keys, tags, left = block_keys(hashes, band, t)
    lower = band - 1
    while lower >= 0 and band_ends(lower)[1] >= math.ceil(n * t):
        if band_ends(lower)[0] <= band_ends(lower)[1] and band_of(band_ends(lower)[1]) == lower:
            for own, more in zip((keys, tags, left), block_keys(hashes, lower, t), strict=True):
                own += more
        lower -= 1
    return np.concatenate([np.empty(0, np.uint64), *keys]), tags, left


def sketch(hashes: np.ndarray) -> bytes:
    """Parity sketch with a power of two of bits, at least two for each shingle (64 to 2**15). Wider sketches lose fewer
    differing shingles to bits that flip twice, so pairs just below the threshold are told apart before texts are read."""
    width = 1 << min(15, max(6, (max(1, 2 * len(hashes)) - 1).bit_length()))
    bits = np.bincount((mixed(hashes) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """Distance after folding the wider sketch onto the narrower."""
    x, y = (np.frombuffer(v, np.uint8) for v in (a, b))
    if len(x) != len(y):
        if len(x) > len(y):
            x, y = y, x
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def linked(a: np.ndarray, b: np.ndarray, t: Fraction) -> bool:
    n, m = len(a), len(b)
    if min(n, m) < t * max(n, m):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= t * (n + m - both)


def described(docs: DataFrame, n: int, t: Fraction) -> DataFrame:
    """Per row: doc, text_hash, node (a hash of the set, so equal sets are one node), n_shingles, sketch, block keys, and by cut
    its tag and how many blocks may still be left out. A task gives the keys of a set that it meets again only once."""
    import pyarrow as pa

    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    names = ["doc", "text_hash", "node", "n_shingles", "sketch", "keys", "tags", "left"]

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                nodes, sizes, facts = [], [], []
                for v in part.column(2):
                    h = shingles(v.as_py(), n)
                    node = node_of(h)
                    nodes.append(node)
                    sizes.append(len(h))
                    if not len(h) or node in seen:
                        facts.append((None, None, None, None))
                    else:
                        seen.add(node)
                        keys, tags, left = keys_of(h, t)
                        facts.append((sketch(h), keys.view(np.int64), tags, left))
                more = [pa.array(x, kind) for x, kind in zip(zip(*facts, strict=True), (pa.binary(), longs, ints, ints), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), *more], names=names)
        forget()

    return docs.mapInArrow(run, "doc long, text_hash long, node long, n_shingles long, sketch binary, keys array<long>, tags array<int>, left array<int>")


def node_of(h: np.ndarray) -> int:
    if not len(h):
        return 0
    with np.errstate(over="ignore"):
        both = np.array([np.bitwise_xor.reduce(mixed(h)), np.add.reduce(mixed(h ^ np.uint64(0xC0FFEE)))], np.uint64)
        both = mixed(both + np.uint64(len(h)) * np.uint64(0x9E3779B97F4A7C15))
        return int((both[0] * np.uint64(3) ^ both[1]).view(np.int64))


def close(pairs: DataFrame, facts: DataFrame, t: Fraction) -> DataFrame:
    """Pairs (a, b) whose sizes fit and whose sketches don't rule a link out."""
    import pyarrow as pa

    num, den = t.numerator, t.denominator
    sizes = facts.select("node", "n_shingles", "sketch")
    both = pairs.join(sizes.toDF("a", "n_a", "s_a"), "a").join(sizes.toDF("b", "n_b", "s_b"), "b")
    both = both.where(f"{den} * least(n_a, n_b) >= {num} * greatest(n_a, n_b)")

    def run(batches):
        for batch in batches:
            n_a, s_a, n_b, s_b = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("n_a", "s_a", "n_b", "s_b"))
            ok = [(den + num) * hamming(x, y) <= (den - num) * (p + q) for p, x, q, y in zip(n_a, s_a, n_b, s_b, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, n: int, t: Fraction) -> DataFrame:
    """Pairs (a, b) that are linked, tested on whole sets."""
    import pyarrow as pa

    text = docs.select("node", "text")
    both = pairs.join(text.toDF("a", "t_a"), "a").join(text.toDF("b", "t_b"), "b")

    def run(batches):
        last: dict[int, np.ndarray] = {}
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            t_a, t_b = batch.column("t_a"), batch.column("t_b")
            ok = []
            for i in range(batch.num_rows):
                sets = []
                for doc, texts in ((a[i], t_a), (b[i], t_b)):
                    h = last.get(doc)
                    if h is None:
                        if len(last) > 200:
                            last.clear()
                        h = last[doc] = shingles(texts[i].as_py(), n)
                    sets.append(h)
                ok.append(linked(*sets, t))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
        forget()

    return both.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes in edges (a, b), comp one for each component.

    Each round every node takes the least of itself and its neighbours as its label, and the edges are drawn anew
    between labels; an edge from a node to its label keeps the label and the label's label together. Stars vanish
    in a round, and what is joined shrinks from round to round.
    """
    left = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct(), "edges")
    comps = None
    while True:
        ends = left.select(F.col("a").alias("node"), "b").union(left.select("b", "a"))
        labels = written(ends.groupBy("node").agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
        if comps is None:
            comps = labels.select("node", F.col("label").alias("comp"))
        else:
            comps = comps.join(labels.toDF("comp", "label"), "comp", "left").select("node", F.coalesce("label", "comp").alias("comp"))
        drawn = left.join(labels.toDF("a", "label_a"), "a").join(labels.toDF("b", "label_b"), "b")
        left = written(drawn.select(F.least("label_a", "label_b").alias("a"), F.greatest("label_a", "label_b").alias("b")).where("a != b").distinct(), "edges")
        if not left.take(1):
            return written(comps, "comps")


def shared_keys(facts: DataFrame, hot: int) -> DataFrame:
    """(key, node, least) rows of the keys that several nodes show, each with the least of them.

    One shuffle of 16 bytes a key serves the counts and the rows; a task streams a key's rows and holds none of them. Hot keys
    go where a node may leave them out, and have the least of the nodes that still show them."""
    rows = facts.select(F.explode("keys").alias("key"), "node").repartition("key")
    counts = rows.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("n")).where("least != most").drop("most")
    keys = written(rows.join(counts, "key").distinct(), "keys")
    some = keys.where(f"n > {hot}")
    if not some.take(1):
        return keys.drop("n")
    some = some.withColumn("tag", F.expr(f"cast(key & {TAG} as int)"))
    left = facts.select("node", F.explode(F.arrays_zip("tags", "left")).alias("x")).select("node", F.col("x.tags").alias("tag"), F.col("x.left").alias("left")).distinct()
    met = some.groupBy("node", "tag").agg(F.count("*").alias("met"))
    shown = met.join(left, ["node", "tag"]).where("met > left").select("node", "tag")
    some = written(some.join(shown, ["node", "tag"]).select("key", "node"), "hot")
    least = written(some.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least != most").drop("most"), "least")
    return keys.where(f"n <= {hot}").select("key", "node", "least").union(some.join(small_first(least), "key").select("key", "node", "least"))


class Labels:
    """Which of a tile's rows are joined: the labels they came with, and what was joined since."""

    def __init__(self, labels: np.ndarray):
        names, self.of = np.unique(labels, return_inverse=True)
        counts = np.bincount(self.of)
        # Rows outside the most frequent label come first, as only they need to be compared with all others.
        self.order = np.concatenate([np.nonzero(self.of != counts.argmax())[0], np.nonzero(self.of == counts.argmax())[0]])
        self.open = len(self.of) - int(counts.max())

    def join(self, i: int, k: int) -> None:
        self.of[self.of == self.of[k]] = self.of[i]


def joined_pairs(part: np.ndarray, crossing: bool, node: np.ndarray, comp: np.ndarray, n: np.ndarray, sketches: list[bytes], t: Fraction, holds=None):
    """Pairs of a tile's rows that join rows of different comps: their sizes and sketches don't rule a link out and, if
    given, holds(i, k) confirms it. A pair that would join what is joined already is left out. In a tile of two parts
    (crossing), pairs of one part are another tile's."""
    labels = Labels(comp)
    if not labels.open:
        return
    num, den = t.numerator, t.denominator
    width = min(map(len, sketches))
    bits = np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, width // 8), axis=0) for x in sketches])
    order = labels.order
    for at in range(min(labels.open, len(order) - 1)):
        i, rest = order[at], order[at + 1 :]
        ok = (labels.of[rest] != labels.of[i]) & (den * np.minimum(n[rest], n[i]) >= num * np.maximum(n[rest], n[i]))
        if crossing:
            ok &= part[rest] != part[i]
        rest = rest[ok]
        if len(rest):
            far = np.bitwise_count(bits[rest] ^ bits[i]).sum(axis=1, dtype=np.int64)
            for k in rest[(den + num) * far <= (den - num) * (n[rest] + n[i])]:
                if labels.of[k] != labels.of[i] and (holds is None or holds(i, k)):
                    labels.join(i, k)
                    yield min(node[i], node[k]), max(node[i], node[k])


def tiled(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows with a key, dealt into tiles: of the ``parts`` of their key, each two meet in one tile, so no task holds a whole group."""
    rows = rows.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return rows.withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other")).drop("other")


def compared(groups: DataFrame, about: DataFrame, t: Fraction, tile_rows: int) -> DataFrame:
    """From rows (key, node, comp), pairs (a, b) with one key whose sizes and sketches don't rule a link out, enough of them to
    join what such pairs join."""
    import pyarrow as pa

    parts = groups.groupBy("key").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("parts"))
    rows = tiled(groups.join(about.select("node", "n_shingles", "sketch"), "node"), parts)
    rows = rows.select("key", "lo", "hi", "part", "node", "comp", "n_shingles", "sketch").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def likely(batches):
        held: list[pa.RecordBatch] = []

        def flush(table):
            key, lo, hi, part, node, comp, n = (table.column(c).to_numpy() for c in ("key", "lo", "hi", "part", "node", "comp", "n_shingles"))
            sk = table.column("sketch").to_pylist()
            cut = np.nonzero((np.diff(key) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0))[0] + 1
            found = set()
            for a, b in zip([0, *cut], [*cut, len(key)], strict=True):
                if b - a > 1:
                    found.update(joined_pairs(part[a:b], lo[a] != hi[a], node[a:b], comp[a:b], n[a:b], sk[a:b], t))
            a, b = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:  # a tile that goes on in the next batch waits for it
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            same = np.ones(table.num_rows, bool)
            for c in ("key", "lo", "hi"):
                same &= table.column(c).to_numpy() == table.column(c)[-1].as_py()
            k = int(np.nonzero(~same)[0][-1]) + 1 if not same.all() else 0
            if k:
                yield flush(table.slice(0, k))
            held = table.slice(k).to_batches()
        if held:
            yield flush(pa.Table.from_batches(held))

    return rows.mapInArrow(likely, "a long, b long").distinct()


def settled(groups: DataFrame, about: DataFrame, texts: DataFrame, n: int, t: Fraction, tile_shingles: int) -> DataFrame:
    """From rows (key, node, comp), pairs (a, b) with one key that are linked, verified on whole sets, enough of them to join what
    links join. Tiles are of bounded size in shingles."""
    import pyarrow as pa

    sized = groups.join(about.select("node", "n_shingles", "sketch"), "node")
    parts = sized.groupBy("key").agg(F.ceil(F.sum("n_shingles") / tile_shingles).cast("int").alias("parts"))
    rows = tiled(sized.join(texts, "node"), parts).select("key", "lo", "hi", "part", "node", "comp", "n_shingles", "sketch", "text")

    def links(table: pa.Table) -> pa.Table:
        out = []
        if table.num_rows > 1:
            part, node, comp, size = (table.column(c).to_numpy() for c in ("part", "node", "comp", "n_shingles"))
            sets: dict[int, np.ndarray] = {}

            def own(i: int) -> np.ndarray:
                if i not in sets:
                    sets[i] = shingles(table.column("text")[int(i)].as_py(), n)
                return sets[i]

            crossing = table.column("lo")[0].as_py() != table.column("hi")[0].as_py()
            out = list(joined_pairs(part, crossing, node, comp, size, table.column("sketch").to_pylist(), t, lambda i, k: linked(own(i), own(k), t)))
            forget()
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return rows.groupBy("key", "lo", "hi").applyInArrow(links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, n: int = 5, threshold: str = "0.8", id_col: str = "doc_id", text_col: str = "text", tile_rows: int = 4096, hot: int = 64, tile_shingles: int = 1_000_000) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the least id of its component)."""
    facts = clusters(docs, n, threshold, id_col, text_col, tile_rows, hot, tile_shingles)
    # Sets of one id link with each other.
    several = facts.where("cluster is not null").groupBy("doc").agg(F.min("cluster").alias("a"), F.max("cluster").alias("b")).where("doc is not null and a != b").select("doc")
    several = written(several, "several")
    if several.take(1):
        own = facts.where("cluster is not null").join(several, "doc").select("doc", "cluster")
        edges = own.join(own.groupBy("doc").agg(F.min("cluster").alias("a")), "doc").where("a != cluster").select("a", F.col("cluster").alias("b"))
        facts = facts.join(components(edges).toDF("cluster", "comp"), "cluster", "left").withColumn("cluster", F.coalesce("comp", "cluster"))
    least = facts.where("cluster is not null").groupBy("cluster").agg(F.min("doc").alias("component_id"))
    return facts.join(least, "cluster", "left").select(F.col("doc").alias(id_col), "n_shingles", F.coalesce("component_id", "doc").alias("component_id"))


def clusters(docs: DataFrame, n: int = 5, threshold: str = "0.8", id_col: str = "doc_id", text_col: str = "text", tile_rows: int = 4096, hot: int = 64, tile_shingles: int = 1_000_000) -> DataFrame:
    """One row per input row: doc, text_hash (xxhash64 of its text), n_shingles, cluster: equal for the rows whose sets are
    joined by links, null for the empty set. Ids play no part. The result is a written table; what it was made from is removed."""
    t = Fraction(threshold)
    if not LOWEST <= t <= 1:
        raise ValueError(f"the threshold must lie between {LOWEST} and 1")
    with scratch(docs.sparkSession) as keep:
        return keep(_clusters(docs, n, t, id_col, text_col, tile_rows, hot, tile_shingles))


def _clusters(docs: DataFrame, n: int, t: Fraction, id_col: str, text_col: str, tile_rows: int, hot: int, tile_shingles: int) -> DataFrame:
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    facts = written(described(base, n, t), "sets")
    told = facts.where("keys is not null")
    keys = written(shared_keys(told, hot), "shown")
    about = told.select("node", "n_shingles", "sketch").dropDuplicates(["node"])
    # 1. Each key's nodes against the least of them: likely links.
    star = keys.where("node != least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    likely = written(close(star, about, t), "likely")
    groups = components(likely)
    # 2. What shares a key across the groups that likely links make.
    apart = keys.join(groups, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    several = apart.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key")
    others = compared(apart.join(several, "key", "left_semi"), about, t, tile_rows)
    pairs = written(likely.union(others).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    groups = components(pairs)
    wanted = written(facts.join(groups.select("node"), "node").groupBy("node").agg(F.min(F.struct("doc", "text_hash")).alias("x")).select("node", "x.*"), "wanted")
    met = (base["text_hash"] == wanted["text_hash"]) & base["doc"].eqNullSafe(wanted["doc"])
    texts = written(base.join(small_first(wanted), met).select("node", "text").dropDuplicates(["node"]), "texts")
    # 3. One pair of each node verified, which settles most groups.
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = written(verified(first, texts, n, t), "links")
    final = components(links)
    # 4. Groups of likely links that did not all hold: within them, whatever links join.
    within = groups.join(final.toDF("node", "own"), "node", "left").select(F.col("comp").alias("key"), "node", F.coalesce("own", "node").alias("comp"))
    split = within.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key")
    more = written(settled(written(within.join(split, "key", "left_semi"), "within"), about, texts, n, t, tile_shingles), "links")
    if more.take(1):
        final = components(links.union(more))
    return written(facts.join(final, "node", "left").select("doc", "text_hash", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("comp", "node")).alias("cluster")), "labelled")


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 4 THEN list_transform(generate_series(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 3], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS ss FROM w),
n AS (SELECT doc_id, len(ss) AS n_shingles FROM s),
e AS (SELECT doc_id, len(ss) AS n, unnest(ss) AS g FROM s),
l AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
u AS (SELECT a, b FROM l UNION ALL SELECT b AS a, a AS b FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
SELECT n.doc_id, n.n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n_shingles
"""
