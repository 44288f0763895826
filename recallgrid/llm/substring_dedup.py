"""Removal of repeated passages by repeated-phrase automata.

A window is ``width`` consecutive words of a document; a word goes if a window over it also starts in a document
of smaller id. Each window has an anchor, the run of eight words in it that hashes least, so equal windows have
equal anchors and neighbouring windows mostly share one: some four in a hundred places are anchors.

1. Each document gives its anchors. Those of a single document end here; equal word sequences count as one.
2. Windows whose anchor recurs are confirmed by their own hashes: a window recurs if two documents have it, and
   its home is the least of them.
3. The anchor phrases of confirmed windows are the phrases of the automata. All documents are dealt out in shards of
   bounded size. The phrases that a shard's documents were found to hold are compiled to one Aho-Corasick automaton
   over words, and all of the shard's documents are streamed through it. It locates every occurrence of a phrase; the
   windows around an occurrence that are confirmed to have a home smaller than the document are marked, and the words
   that they cover go. A window that no occurrence lies in is not looked at.

Shards are of documents, not of phrases alone, as streaming all documents through every shard of all phrases would
cost the square of the input. Hashes have 64 bits. Counts are taken with partial sums and written, and then joined, so
that joins with a hot anchor or window can be split; what a hot passage costs is a short row for each document that
holds it.

Defined results: null and empty texts have no words, and their kept text is empty; texts shorter than a window
stay whole; a document that repeats itself keeps its words; rows that share an id don't count as smaller than
each other; rows without an id lose nothing and are nobody's home; repeated rows give repeated results; other input
columns are ignored.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .words import forget, run_hashes, window_minima, word_hashes

#: Words of an anchor.
ANCHOR = 8
#: Bytes of text that a shard has on average.
SHARD_BYTES = 4_000_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def anchors_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """The anchor of each window of a document."""
    return window_minima(run_hashes(hashes, min(ANCHOR, width)), width - min(ANCHOR, width) + 1)


def facts_of(docs: DataFrame, width: int) -> DataFrame:
    """Per row: doc, n_words, a digest of its words, and its distinct anchors."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                n, sha, anchors = [], [], []
                for v in part.column(1):
                    words = words_of(v.as_py())
                    n.append(len(words))
                    sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                    anchors.append(np.unique(anchors_of(word_hashes(words), width)).view(np.int64) if len(words) >= width else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(anchors, pa.list_(pa.int64()))], names=["doc", "n_words", "sha", "anchors"]
                )
        forget()

    return docs.mapInArrow(run, "doc long, n_words long, sha string, anchors array<long>")


def windows_of(held: DataFrame, width: int) -> DataFrame:
    """From (doc, text, anchors, own): (hash, doc, anchor, null) per distinct window with one of the anchors, and
    (null, doc, anchor, phrase) per anchor of own, which are those that no smaller document holds."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                hashes, docs, ties, mine_at, owners, phrases = [], [], [], [], [], []
                for doc, text, anchors, own in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    words = words_of(text)
                    h = word_hashes(words)
                    at = anchors_of(h, width)
                    hit = np.nonzero(np.isin(at, np.array(anchors, np.int64).view(np.uint64)))[0]
                    found, first = np.unique(run_hashes(h, width)[hit], return_index=True)
                    hashes.append(found.view(np.int64))
                    docs.append(np.full(len(found), doc, np.int64))
                    ties.append(at[hit[first]].view(np.int64))
                    if own:
                        uniq, places = np.unique(run_hashes(h, min(ANCHOR, width)), return_index=True)
                        mine = np.intersect1d(np.array(own, np.int64).view(np.uint64), uniq)
                        mine_at.append(mine.view(np.int64))
                        owners.append(np.full(len(mine), doc, np.int64))
                        phrases += [b" ".join(words[p : p + min(ANCHOR, width)]) for p in places[np.searchsorted(uniq, mine)]]
                none = np.empty(0, np.int64)
                windows = pa.array(np.concatenate([none, *hashes]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([windows, pa.nulls(len(phrases), pa.int64())]),
                        pa.array(np.concatenate([none, *docs, *owners])),
                        pa.array(np.concatenate([none, *ties, *mine_at])),
                        pa.concat_arrays([pa.nulls(len(windows), pa.binary()), pa.array(phrases, pa.binary())]),
                    ],
                    names=["hash", "doc", "anchor", "phrase"],
                )
        forget()

    return held.mapInArrow(run, "hash long, doc long, anchor long, phrase binary")


class Shard:
    """An automaton over the words of phrases."""

    def __init__(self, phrases: set[bytes]):
        self.numbers: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for phrase in phrases:
            words = phrase.split()
            self.automaton.add_word(tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words), len(words))
        self.automaton.make_automaton()

    def places(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(first word, number of words) of each occurrence of a phrase."""
        get = self.numbers.get
        return [(end - n + 1, n) for end, n in self.automaton.iter(tuple([get(w, 0) for w in words]))]


def covered(words: list[bytes], places: list[tuple[int, int]], doc: int, windows: np.ndarray, homes: np.ndarray, width: int) -> np.ndarray:
    """Which words a window covers that holds one of the places and is among windows (sorted), with a home smaller than doc."""
    n = len(words)
    near = np.zeros(n + 1, np.int64)
    for at, k in places:  # windows that hold the phrase
        near[max(0, at + k - width)] += 1
        near[max(0, min(at, n - width)) + 1] -= 1
    around = np.nonzero(np.cumsum(near)[: n - width + 1] > 0)[0]
    found = run_hashes(word_hashes(words), width)[around]
    at = np.minimum(np.searchsorted(windows, found), len(windows) - 1)
    starts = around[(windows[at] == found) & (homes[at] < doc)]
    mark = np.zeros(n + 1, np.int64)
    mark[: n - width + 1] += np.bincount(starts, minlength=n - width + 1)
    mark[width:] -= np.bincount(starts, minlength=n - width + 1)
    return np.cumsum(mark)[:n] > 0


def stripped(docs: DataFrame, passages: DataFrame, width: int) -> DataFrame:
    """From (shard, doc, text) and (shard, hash, home, phrase): doc, the digest of its words, n_removed, the digest of the kept
    words and the kept words themselves, for each row of docs that loses words."""
    import pyarrow as pa

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"doc": [], "sha": [], "gone": [], "new_sha": [], "kept": []}
        if left.num_rows and right.num_rows:
            phrases = {p for p in right.column("phrase").to_pylist() if p is not None}
            told = right.filter(pa.compute.is_null(right.column("phrase")))
            windows, homes = (told.column(c).to_numpy() for c in ("hash", "home"))
            windows = windows.view(np.uint64)
            order = np.argsort(windows)
            windows, homes = windows[order], homes[order]
            shard = Shard(phrases)
            for k in range(left.num_rows if len(windows) else 0):
                doc = left.column("doc")[k].as_py()
                words = words_of(left.column("text")[k].as_py())
                places = shard.places(words) if len(words) >= width else []
                off = covered(words, places, doc, windows, homes, width) if places else None
                if off is not None and off.any():
                    kept = b" ".join(w for w, x in zip(words, off.tolist(), strict=True) if not x)
                    for c, v in zip(out, (doc, hashlib.sha256(b" ".join(words)).hexdigest(), int(off.sum()), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                        out[c].append(v)
        forget()
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary())
        return pa.table({c: pa.array(v, kind) for (c, v), kind in zip(out.items(), kinds, strict=True)})

    return docs.groupBy("shard").cogroup(passages.groupBy("shard")).applyInArrow(tile, "doc long, sha string, gone long, new_sha string, kept binary")


def without_repeats(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text", texts: bool = False, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256; with texts, also kept_text where something was removed."""
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    facts = written(facts_of(base, width), "passages")
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shard = F.pmod(F.xxhash64("doc"), F.lit(1 + size // shard_bytes)).cast("int").alias("shard")
    least = facts.where(f"n_words >= {width}").groupBy("sha").agg(F.min("doc").alias("rep"))
    firsts = facts.join(least, "sha").where("doc = rep").dropDuplicates(["doc", "sha"])
    dealt = written(firsts.select(F.explode("anchors").alias("anchor"), "doc"), "dealt")
    recurring = written(dealt.groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo != hi"), "recurring")
    places = dealt.join(recurring, "anchor").select("doc", "anchor", (F.col("doc") == F.col("lo")).alias("own"))
    by_doc = places.groupBy("doc").agg(F.collect_list("anchor").alias("anchors"), F.collect_list(F.when(F.col("own"), F.col("anchor"))).alias("own"))
    held = base.join(by_doc, "doc").select("doc", "text", "anchors", "own")
    rows = written(windows_of(held, width), "windows")
    seen = rows.where("phrase is null").select("hash", "doc", "anchor")
    homes = written(seen.groupBy("hash").agg(F.min("doc").alias("home"), F.max("doc").alias("last")).where("home != last").drop("last"), "homes")
    confirmed = written(seen.join(homes, "hash").where("doc > home").select(shard, "hash", "home", "anchor").distinct(), "confirmed")
    phrases = rows.where("phrase is not null").select("anchor", "phrase").dropDuplicates(["anchor"])
    wanted = confirmed.select("shard", "anchor").distinct().join(phrases, "anchor")
    passages = confirmed.select("shard", "hash", "home", F.lit(None).cast("binary").alias("phrase"))
    passages = passages.distinct().union(wanted.select("shard", F.lit(None).cast("long"), F.lit(None).cast("long"), "phrase"))
    # A text of fewer bytes has fewer words than a window.
    streamed = base.where(f"doc is not null and octet_length(text) >= {2 * width - 1}").select(shard, "doc", "text")
    found = stripped(streamed, passages, width)
    found = (found if texts else found.drop("kept")).dropDuplicates(["doc", "sha"])
    out = facts.join(least, "sha", "left").join(found, ["doc", "sha"], "left")
    copy = F.col("rep").isNotNull() & (F.col("doc") > F.col("rep"))
    nothing = hashlib.sha256(b"").hexdigest()
    columns = [
        F.col("doc").alias(id_col),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(nothing)).otherwise(F.coalesce("new_sha", "sha")).alias("kept_sha256"),
    ]
    if texts:
        columns.append(F.when(copy, F.lit("")).otherwise(F.col("kept").cast("string")).alias("kept_text"))
    return out.select(*columns)


OP9_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS i FROM w WHERE len(ws) >= 50),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS g FROM p),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM k),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS j FROM f WHERE first < doc_id),
v AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM w),
t AS (SELECT v.doc_id, string_agg(word, ' ' ORDER BY v.j) AS kept, count(*) AS n FROM v ANTI JOIN c ON c.doc_id = v.doc_id AND c.j = v.j GROUP BY v.doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN t ON t.doc_id = w.doc_id
"""
