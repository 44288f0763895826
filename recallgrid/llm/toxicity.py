"""Toxicity by a weighted lexicon that an Aho-Corasick automaton matches in folded text.

Folding lowers case, takes accents and look-alike letters of other scripts to the Latin letters they resemble,
digits and signs to the letters they stand in for, drops invisible characters and makes all else a space. The
lexicon is learned from labels: entries are the whole words and word beginnings that enough toxic documents hold
(near copies count once) at the precision asked for; an entry's weight is its smoothed log-odds. Exception phrases are two-word phrases around an entry that clean documents hold more than
toxic ones; an entry inside one doesn't count. A document's score is a logistic function, fitted on the same
rows, of its summed weights per word and of their strongest, so long documents aren't toxic for their length.

The labels are read from a bounded sample: ``fit_rows`` rows with the smallest hash of their id (all, if fewer).
Everything else sees every row and whole texts; the automaton holds as many entries as the labelled rows support.

Defined results: null and empty texts hold no word and score the base rate's logistic; a table without labels
of both classes gives every document the share of toxic labels (0 if there are none) as its score; repeated rows
are scored alike; other input columns are ignored.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts, digits and signs, and the Latin letters that they are read as.
LOOK_ALIKE = {
    "a": "аαɑ4@", "b": "ьв", "c": "сϲ¢", "d": "ԁɗ", "e": "еεєё3€", "g": "ɡց", "h": "һн", "i": "іιıїl1¡", "j": "јϳ", "k": "кκ",
    "m": "м", "n": "пηո", "o": "оοօ0", "p": "рρ", "r": "г", "s": "ѕ5$", "t": "тτ7", "u": "υսцµ", "v": "ν", "w": "ωѡ", "x": "хχ", "y": "уγү", "z": "ʐ2",
}
INVISIBLE = "­​‌‍⁠﻿"


@lru_cache(maxsize=1)
def folding() -> dict[int, str | None]:
    table: dict[int, str | None] = {}
    spans = ((0xC0, 0x250), (0x300, 0x370), (0x1E00, 0x1F00), (0xFF01, 0xFF5F), (0x1D400, 0x1D800), (0x2460, 0x2500))
    for code in (c for a, b in spans for c in range(a, b)):
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(code)).lower() if not unicodedata.combining(x))
        if 0x300 <= code < 0x370:
            table[code] = None
        elif plain.isascii() and plain.isalnum():
            table[code] = plain
    for letter, others in LOOK_ALIKE.items():
        for x in others:
            table[ord(x)] = letter
            table[ord(x.upper()[0])] = table.get(ord(x.upper()[0]), letter)
    table |= {ord(x): None for x in INVISIBLE}
    for code in range(128):
        x = chr(code).lower()
        if code not in table:
            table[code] = x if x.isalnum() else " "
    for code, value in list(table.items()):
        if value:
            table[code] = value.replace("l", "i")
    table[ord("L")] = "i"
    return table


def folded(text: str) -> str:
    """Words of a text, folded, each with a space in front."""
    return " " + " ".join(text.lower().translate(folding()).split())


#: How long a beginning may be that is an entry; a longer one is told by these, or by its whole word.
PREFIXES = range(4, 15)


def terms_of(word: str) -> list[str]:
    """What a word may be matched by: itself (closed by a space) and its beginnings."""
    return [f" {word} ", *(f" {word[:n]}" for n in PREFIXES if n < len(word))]


class Lexicon:
    """Entries with weights, exception phrases, and the logistic of the two features."""

    def __init__(self, weights: dict[str, float], exceptions: set[str], logistic: tuple[float, float, float]):
        self.weights, self.exceptions, self.logistic = weights, exceptions, logistic
        self.automaton = None

    def __getstate__(self):
        return self.weights, self.exceptions, self.logistic

    def __setstate__(self, state):
        self.__init__(*state)

    def compiled(self):
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for term in [*self.weights, *self.exceptions]:
                self.automaton.add_word(term, (len(term), term in self.exceptions, self.weights.get(term, 0.0)))
            self.automaton.make_automaton()
        return self.automaton

    def features(self, text: str) -> tuple[float, float]:
        """Summed weight per square root of words, and the largest weight."""
        if not self.weights:
            return 0.0, 0.0
        text = folded(text) + " "
        hits, spared = {}, []
        for end, (n, exception, weight) in self.compiled().iter(text):
            begin = end - n + 1
            if exception:
                spared.append((begin, end))
            else:
                hits[begin] = max(hits.get(begin, 0.0), weight)
        if spared:
            hits = {b: w for b, w in hits.items() if not any(x <= b < y for x, y in spared)}
        if not hits:
            return 0.0, 0.0
        return sum(hits.values()) / math.sqrt(1 + text.count(" ")), max(hits.values())

    def score(self, text: str) -> float:
        a, b, c = self.logistic
        x, y = self.features(text)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, a + b * x + c * y))))


def learned(rows: Iterable[tuple[str, int]], support: int = 4, precision: float = 0.85) -> Lexicon:
    """Fit on (text, label) rows, taken one by one; equal texts count once."""
    seen: dict[str, int] = {}
    for text, label in rows:
        seen.setdefault(folded(text or ""), int(label or 0))
    texts = list(seen.items())
    n = [sum(1 for _, y in texts if y == k) for k in (0, 1)]
    if not n[0] or not n[1]:
        rate = (n[1] + 1e-9) / (len(texts) or 1)
        base = 40.0 if n[1] and not n[0] else -40.0 if not n[1] else math.log(rate / (1 - rate))
        return Lexicon({}, set(), (base, 0.0, 0.0))
    toxic: Counter[str] = Counter()
    seen_by: dict[str, set[int]] = {}
    for text, y in texts:
        if y:
            words = set(text.split())
            kin = min((zlib.crc32(w.encode()) for w in words), default=0)  # near copies mostly share it and count once
            for t in {t for w in words for t in terms_of(w)}:
                kins = seen_by.setdefault(t, set())
                if kin not in kins:
                    kins.add(kin)
                    toxic[t] += 1
    candidates = {t for t, k in toxic.items() if k >= support}
    by_word: dict[str, list[str]] = {}
    clean: Counter[str] = Counter()
    for text, y in texts:
        if not y:
            own: set[str] = set()
            for w in set(text.split()):
                found = by_word.get(w)
                if found is None:
                    found = by_word[w] = [t for t in terms_of(w) if t in candidates]
                own.update(found)
            clean.update(own)
    good = [t for t in candidates if toxic[t] >= precision * (toxic[t] + clean[t] * n[1] / n[0]) and toxic[t] > clean[t]]
    good.sort(key=lambda t: (clean[t] - toxic[t], -len(t), t))
    weights = {t: math.log((toxic[t] + 0.5) / (n[1] + 1)) - math.log((clean[t] + 0.5) / (n[0] + 1)) for t in good}
    # Phrases of two words around an entry that clean documents hold more than toxic ones do.
    around: list[Counter[str]] = [Counter(), Counter()]
    firsts = {t[1:5] for t in weights}
    for text, y in texts:
        words = text.split()
        own = set()
        for i, w in enumerate(words):
            if w[:4] in firsts and any(t in weights for t in terms_of(w)):
                own.update(f" {a} {b} " for a, b in ((words[i - 1] if i else "", w), (w, words[i + 1] if i + 1 < len(words) else "")) if a and b)
        around[y].update(own)
    spare = sorted((p for p, k in around[0].items() if k >= support and k / n[0] > 3 * around[1][p] / n[1]), key=lambda p: (-around[0][p], p))
    found = Lexicon(weights, set(spare), (0.0, 0.0, 0.0))
    x = np.array([(1.0, *found.features(t)) for t, _ in texts])
    y = np.array([label for _, label in texts], float)
    scale = np.maximum(x.std(axis=0), 1e-9)
    scale[0] = 1.0
    z, w = x / scale, np.zeros(3)
    for _ in range(60):  # Newton's steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.05 * np.eye(3), z.T @ (p - y) + 0.05 * w)
    return Lexicon(weights, found.exceptions, tuple(float(v) for v in w / scale))


def is_held_out(id_col):
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def fitted(docs: DataFrame, labels: DataFrame, fit_rows: int = 12_000, id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """A lexicon from the labelled rows that are not held out: at most fit_rows, those of the smallest hash of their id."""
    told = (
        labels.where("toxic is not null")
        .where(~is_held_out(F.col(id_col)))
        .select(F.col(id_col).alias("id"), "toxic")
        .orderBy(F.xxhash64("id"), "id", "toxic")
        .limit(fit_rows)
    )
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(told), "id").select("id", "text", "toxic")
    ordered = rows.orderBy("id", "toxic", F.xxhash64("text")).select("text", "toxic")
    return learned((r.text or "", r.toxic) for r in ordered.toLocalIterator())


def scored(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5, whole: bool = False) -> DataFrame:
    """Per row: id and score; with whole, the input rows whose score is below cut, unchanged."""
    import pyarrow as pa

    kind = dict(docs.dtypes)[id_col]
    if whole:
        at = docs.columns.index(text_col)

        def keep(batches):
            for batch in batches:
                mask = pa.array([lexicon.score(v.as_py() or "") < cut for v in batch.column(at)], pa.bool_())
                yield batch.filter(mask)

        return docs.mapInArrow(keep, docs.schema)

    def run(batches):
        for batch in batches:
            scores = [lexicon.score(v.as_py() or "") for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
