"""Phrase collocations: frequent phrases of each language whose parts seldom part.

Texts are folded, cut into pieces at punctuation, and written once as chunks of word numbers, each with its own list of
words. All n-grams of one to max_n words are exploded into rows by chunk, equal ones of a chunk as one row with their
count, and aggregated by language, one length after the other: single words as they are, longer ones by 128 bits of
hash, which stand for the words and the language. A phrase is never more frequent than a phrase in it, so of n words only
those rows are made whose first and last n - 1 words are marked in a map of frequent hashes; the map has a fixed size, and what
is marked by chance is counted and found rare. A frequent n-gram is then spelt out by one of the chunks that hold it, which
learns of it by a join; so no list of phrases is gathered anywhere. Counts of prefixes and suffixes are joined, scores
are made in Decimal, and a candidate goes if a candidate one word longer has nearly its count: as every phrase between a
phrase and a longer one that holds it is at least as frequent as the longer, one word more is all that need be looked at.

Defined results: null text is empty, null language is ``und``; an empty table, and one without frequent phrases, give none;
repeated rows count each for themselves; a piece is counted whole however long it is. Other columns are ignored.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BATCH, LARGE_ROWS, scratch, small_first, written
from .words import BASE, MASK, mixed

#: ASCII capitals, what ends a piece, and what parts words; a piece's end is a word of its own, with number 0.
ENDS = b".,;:!?\x0b\x0c\r"
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + ENDS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(ENDS))
#: Bytes of text that make a chunk. A task gathers three times as many over all languages.
CHUNK_BYTES = 4 << 20
#: Bits of the map of frequent hashes, 8 MB.
MAP_BITS = 26
#: Bits of a hash that say which of the chunks with an n-gram spells it, so that the first chunks don't spell most.
SPELLER = 0xFFFF_0000_000F
#: Odd factors of the two hashes of a run of words.
BASES = np.array([[BASE], [0xD6E8FEB86659FD93]], np.uint64)


class Numbers(dict):
    """Words by number, in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def parts_of(text: str, most: int) -> Iterator[bytes]:
    """A folded text, or if it is long, parts of about so many bytes that end where pieces end."""
    data = text.encode().translate(FOLD)
    while len(data) > most and (end := data.find(b"\n", most)) >= 0:
        yield data[:end]
        data = data[end + 1 :]
    yield data


def _encoded(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The words of folded texts, and all texts as word numbers."""
    numbers = Numbers({b"\n": 0})
    parts = b"\n".join(texts).replace(b"\n", b" \n ").split(b" ")
    return numbers, np.fromiter(map(numbers.__getitem__, filter(None, parts)), np.int32)


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of so few rows, as a row of chunks is megabytes; the session's own setting is back afterwards."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def release(spark: SparkSession) -> None:
    """Have the last job's shuffle files removed: Spark keeps them until another job has run and the JVM has collected garbage."""
    spark.range(1).count()
    gc.collect()
    spark._jvm.System.gc()


CHUNK = "chunk long, lang string, words array<string>, counts array<int>, ids binary"


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(chunk, lang, words, counts, ids): word numbers of texts in order, 0 where a piece ends, and the words from number 1 on with
    their counts."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def row(lang: str) -> pa.RecordBatch:
            nonlocal number
            words, ids = _encoded(held.pop(lang))
            del sizes[lang]
            number += 1
            told = [w.decode() for w in words][1:]
            columns = [[number], [lang], [told], [np.bincount(ids, minlength=len(words))[1:].tolist()], [ids.tobytes()]]
            kinds = [pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["chunk", "lang", "words", "counts", "ids"])

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                name = lang.as_py()
                for part in parts_of(text.as_py(), chunk_bytes):
                    held.setdefault(name, []).append(part)
                    sizes[name] = sizes.get(name, 0) + len(part)
                    if sizes[name] >= chunk_bytes:
                        yield row(name)
                    elif sum(sizes.values()) >= 3 * chunk_bytes:
                        yield row(max(sizes, key=sizes.get))
        for name in list(held):
            yield row(name)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").where("text != ''")
    return rows.mapInArrow(encode, CHUNK)


def _hashes(words: list[str], lang: str) -> np.ndarray:
    """Two hashes of each word and its language by the word's number."""
    own = xxhash.xxh3_64_intdigest(lang.encode())
    out = np.zeros((2, len(words) + 1), np.uint64)
    for i, w in enumerate(words, 1):
        both = xxhash.xxh3_128_intdigest(w.encode(), own)
        out[0, i], out[1, i] = both >> 64, both & MASK
    return out


def _grams(ids: np.ndarray, hashes: np.ndarray, n: int, marked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where n words stand side by side in a piece, and two hashes of each of these n-grams. With marked, both places at which
    n - 1 of the words begin must be."""
    k = max(0, len(ids) - n + 1)
    at = np.flatnonzero(np.logical_and.reduce([ids[i : i + k] > 0 for i in range(n)]))
    if marked is not None:
        at = at[marked[at] & marked[at + 1]]
    out = hashes[:, ids[at]]
    with np.errstate(over="ignore"):
        for i in range(1, n):
            out = out * BASES + hashes[:, ids[at + i]]
        one, two = mixed(out).view(np.int64)
    return at, one, two


def _distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first index of each pair, in order of the pairs, and how often it stands."""
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return order[starts], np.diff(np.append(starts, len(a)))


def frequent_words(singles: DataFrame) -> DataFrame:
    """(one): the first hash of each word of (lang, words), as it is among the n-grams of one word."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [_hashes([w], lang)[:, 1:] for lang, w in zip(batch["lang"].to_pylist(), batch["words"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(mixed(np.concatenate([np.zeros((2, 0), np.uint64), *each], axis=1))[0].view(np.int64))], ["one"])

    return singles.select("lang", "words").mapInArrow(hashed, "one long")


def map_of(grams: DataFrame) -> np.ndarray:
    """A map of MAP_BITS bits with a bit for each first hash in (one). The driver gets the map, not the hashes."""
    slot = F.shiftrightunsigned("one", 64 - MAP_BITS)
    words = grams.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(1 << (MAP_BITS - 6), np.int64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint8)


def _marked(ids: np.ndarray, hashes: np.ndarray, n: int, known: np.ndarray) -> np.ndarray:
    """Whether the n words from each place on are marked in a map."""
    at, one, _ = _grams(ids, hashes, n)
    slot = one.view(np.uint64) >> np.uint64(64 - MAP_BITS)
    out = np.zeros(len(ids) + 1, bool)
    out[at] = known[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1
    return out


def hashed_grams(chunks: DataFrame, n: int, known: Broadcast | None = None) -> DataFrame:
    """(chunk, one, two, n): every n-gram of every chunk, by its hashes; with a map of n-grams one word shorter, those
    alone whose two parts are marked."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, hashes = np.frombuffer(row["ids"], np.int32), _hashes(row["words"], row["lang"])
                marked = None if known is None else _marked(ids, hashes, n - 1, known.value)
                _, one, two = _grams(ids, hashes, n, marked)
                first, count = _distinct(one, two)
                for i in range(0, len(first), 100_000):
                    part = first[i : i + 100_000]
                    columns = [np.full(len(part), row["chunk"]), one[part], two[part], count[i : i + 100_000].astype(np.int64)]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["chunk", "one", "two", "n"])

    return chunks.select("chunk", "lang", "words", "ids").mapInArrow(explode, "chunk long, one long, two long, n long")


def frequent_grams(chunks: DataFrame, n: int, least: int, known: Broadcast | None = None) -> DataFrame:
    """(chunk, words, one, two, a): each frequent n-gram, its count in all chunks, and a chunk that holds it."""
    own = F.col("one").bitwiseAND(F.lit(SPELLER))
    counted = hashed_grams(chunks, n, known).groupBy("one", "two").agg(F.min(F.col("chunk").bitwiseXOR(own)).alias("chunk"), F.sum("n").alias("a"))
    return counted.where(F.col("a") >= least).select(F.col("chunk").bitwiseXOR(own).alias("chunk"), F.lit(n).alias("words"), "one", "two", "a")


def phrases_of(chunks: DataFrame, frequent: DataFrame) -> DataFrame:
    """(lang, phrase, words, a): frequent n-grams by their words, which the chunk named for each has."""

    def spell(chunk: pa.Table, wanted: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [], [])
        lengths, ones, twos, counts = (wanted[c].to_numpy() for c in ("words", "one", "two", "a"))
        for row in chunk.to_pylist() if len(lengths) else ():
            words = [b"", *(w.encode() for w in row["words"])]
            ids, hashes = np.frombuffer(row["ids"], np.int32), _hashes(row["words"], row["lang"])
            for n in np.unique(lengths).tolist():
                mine = lengths == n
                known = dict(zip(zip(ones[mine].tolist(), twos[mine].tolist(), strict=True), counts[mine].tolist(), strict=True))
                at, one, two = _grams(ids, hashes, n)
                hit = np.flatnonzero(np.isin(one, ones[mine]))
                for i in hit[_distinct(one[hit], two[hit])[0]].tolist():
                    a = known.get((int(one[i]), int(two[i])))
                    if a is not None:
                        start = int(at[i])
                        for column, value in zip(out, (row["lang"], b" ".join([words[j] for j in ids[start : start + n].tolist()]), n, a), strict=True):
                            column.append(value)
        lang, phrase, words, a = (pa.array(c, k) for c, k in zip(out, [pa.string(), pa.binary(), pa.int32(), pa.int64()], strict=True))
        return pa.table([lang, phrase.cast(pa.string()), words, a], ["lang", "phrase", "words", "a"])

    both = chunks.select("chunk", "lang", "words", "ids").groupBy("chunk").cogroup(frequent.groupBy("chunk"))
    return both.applyInArrow(spell, "lang string, phrase string, words int, a long")


def exact(column: str):
    return F.col(column).cast("decimal(20,0)")


def collocations(docs: DataFrame, max_n: int = 4, least: int = 30, overlap: int = 80, top: int | None = 2000, scale: int = 2_000_000, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) over the columns lang and text; each language's first ``top``, or all."""
    spark = docs.sparkSession
    chunks = written(chunked(docs, chunk_bytes), "chunks", LARGE_ROWS)
    singles = chunks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", "w.words", F.col("w.counts").cast("long").alias("n"))
    singles = written(singles.groupBy("lang", "words").agg(F.sum("n").alias("a")), "singles")
    shorter = frequent_words(singles.where(F.col("a") >= least))
    frequent = []
    for n in range(2, max_n + 1):
        known = spark.sparkContext.broadcast(map_of(shorter))
        with batches_of(spark, 2), scratch(spark) as keep:  # the exchange of one length is gone before that of the next
            frequent.append(keep(written(frequent_grams(chunks, n, least, known), f"frequent-{n}")))
        known.destroy()
        release(spark)
        shorter = frequent[-1]
    frequent = reduce(DataFrame.union, frequent)
    counts = written(phrases_of(chunks, frequent), "phrases")
    totals = singles.groupBy("lang").agg(F.sum("a").alias("n"))
    parts = counts.select("lang", "phrase", "a").union(singles.where(F.col("a") >= least).select("lang", "words", "a"))

    split = F.split("phrase", " ")
    cuts = counts.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", F.array_join(F.slice(split, F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice(split, F.col("k") + 1, F.col("words")), " ").alias("rest"))
    cuts = cuts.join(parts.toDF("lang", "first", "l"), ["lang", "first"]).join(parts.toDF("lang", "rest", "r"), ["lang", "rest"])
    cuts = cuts.withColumn("score", F.expr(f"cast({scale} as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    scored = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # The longest-lived extension: the greatest count of a candidate that has one word more in front or behind.
    split_long = counts.where("words > 2").select("lang", "a", F.explode(F.array(F.array_join(F.slice(split, F.lit(1), F.col("words") - 1), " "), F.array_join(F.slice(split, F.lit(2), F.col("words") - 1), " "))).alias("phrase"))
    longer = split_long.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    gone = longer.join(counts.select("lang", "phrase", "a"), ["lang", "phrase"]).where(exact("longer") * 100 >= exact("a") * overlap)
    left = scored.join(gone.select("lang", "phrase"), ["lang", "phrase"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    ranked = left.withColumn("rank", rank)
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    ranked = ranked.join(small_first(written(totals, "totals")), "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


OP12_SQL = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, p FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
    FROM documents)),
words AS (
  SELECT lang, piece, i, ws[i] AS w FROM (
    SELECT lang, piece, ws, unnest(range(1, len(ws) + 1)) AS i FROM (
      SELECT lang, piece, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces))),
nexts AS (
  SELECT lang, w AS w1, lead(w, 1) OVER s AS w2, lead(w, 2) OVER s AS w3, lead(w, 3) OVER s AS w4 FROM words
  WINDOW s AS (PARTITION BY piece ORDER BY i)),
grams AS (
  SELECT lang, 1 AS k, w1 AS phrase FROM nexts
  UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM nexts WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM nexts WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM nexts WHERE w4 IS NOT NULL),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT * FROM f WHERE k > 1 AND a >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.k, c.a, j, array_to_string(string_split(c.phrase, ' ')[1:j], ' ') AS p, array_to_string(string_split(c.phrase, ' ')[j + 1:], ' ') AS q
  FROM cand c, range(1, 4) t(j) WHERE j < c.k),
scored AS (
  SELECT cuts.*, x.a AS l, y.a AS r, ((2000000::HUGEINT * cuts.a) // (x.a + y.a))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = p JOIN f y ON y.lang = cuts.lang AND y.phrase = q),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM cand c WHERE c.lang = b.lang AND c.k > b.k AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ') AND 100::HUGEINT * c.a >= 80::HUGEINT * b.a))
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals ON totals.lang = kept.lang
QUALIFY rank <= 2000
"""
