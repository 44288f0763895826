"""Cross-entropy difference of matched n-gram models.

Two interpolated character n-gram models of one order, smoothing and vocabulary are counted in one pass over the
corpus: the background from every document, the target from those that are named as target. A document's score is
its mean per-token loss under the target model less that under the background model, in nats: the lower, the
more it is like the target. Tokens are code points with an end-of-text token; begin-of-text tokens are context.

p_n(w | context) = (c(context, w) + mu * p_{n-1}(w | shorter context)) / (c(context) + mu), down to a uniform
distribution over the vocabulary.

Counts are kept by the n-gram itself, in a distributed table that has one row for each distinct n-gram: there is no
bound on its size, and no two n-grams share a count. Tasks count a few million tokens at a time and shuffle sparse
counts, which are summed by n-gram. To score, documents are dealt into chunks of as many tokens; each chunk asks the
table for its own distinct n-grams by a join and is scored with what comes back. Neither the table nor the corpus is
gathered in one place; the driver sees two numbers, how many tokens each model has.

Defined results: null and empty texts have one token, the end; without target documents the target counts are
empty and the target model uniform; an empty table gives an empty one; repeated rows are counted and scored as
often as they occur; other input columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_first, written


ORDER = 4
END = 0x110000
BEGIN = tuple(0x110001 + i for i in range(ORDER - 1))
#: Size of the vocabulary: code points and the end token.
VOCABULARY = 0x110001
#: How many tokens are counted, or scored, at once by a task.
CHUNK = 4_000_000
#: Bits of a token within the key of an n-gram.
BITS = 21


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each with its begin tokens and end; and where each starts."""
    points = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    lengths = np.array([len(p) + ORDER for p in points], np.int64)
    starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
    out = np.empty(starts[-1], np.uint64)
    for p, at in zip(points, starts, strict=False):
        out[at : at + ORDER - 1] = BEGIN
        out[at + ORDER - 1 : at + ORDER - 1 + len(p)] = p
        out[at + ORDER - 1 + len(p)] = END
    return out, starts


def valid(starts: np.ndarray, total: int) -> np.ndarray:
    """Each position's index within its text."""
    return np.arange(total) - np.repeat(starts[:-1], np.diff(starts))


def renumbered(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes in order, 0 among them, and each position's place in these; codes are below size."""
    if size <= max(1 << 24, 4 * len(codes)):
        seen = np.zeros(size, bool)
        seen[codes] = True
        seen[0] = True
        found = np.flatnonzero(seen)
        number = np.empty(size, np.int32)
        number[found] = np.arange(len(found), dtype=np.int32)
        return found, number[codes]
    found, at = np.unique(np.append(codes, 0), return_inverse=True)
    return found, at[:-1].astype(np.int32)


def numbered(seq: np.ndarray, index: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """For each order n, a number for the n-gram that ends at each position, and the n-gram of each number, as two
    integers. Number 0 is for n-grams that would begin in the text before. Numbers depend on which n-grams there are, not
    on the order of the texts."""
    single, first = renumbered(seq.astype(np.int64) + 1, END + ORDER + 1)
    high, low = np.zeros(len(single), np.int64), single.astype(np.int64)
    at, highs, lows = [first], [high], [low]
    for n in range(2, ORDER + 1):
        codes = np.zeros(len(seq), np.int64)
        codes[1:] = at[-1][:-1].astype(np.int64) * len(single) + first[1:]
        codes[index < n - 1] = 0
        found, here = renumbered(codes, len(low) * len(single))
        before, last = np.divmod(found, len(single))
        high, low = high[before] << BITS | low[before] >> BITS, (low[before] & (1 << BITS) - 1) << BITS | single[last]
        at.append(here)
        highs.append(high)
        lows.append(low)
    return at, highs, lows


def counted(docs: DataFrame) -> DataFrame:
    """(high, low, target, background) from (text, is_target): counts by n-gram, in parts."""
    import pyarrow as pa

    def sums(texts: list[str | None], flags: list[bool]):
        seq, starts = tokens(texts)
        index = valid(starts, len(seq))
        target = np.repeat(np.array(flags, bool), np.diff(starts))
        for at, high, low in zip(*numbered(seq, index), strict=True):
            both = [np.bincount(x, minlength=len(low))[1:] for x in (at[target], at)]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, (high[1:], low[1:], *both))), names=["high", "low", "target", "background"])

    def run(batches):
        texts, flags, size = [], [], 0
        for batch in batches:
            for text, flag in zip(batch.column(0), batch.column(1), strict=True):
                texts.append(text.as_py())
                flags.append(flag.as_py())
                size += len(texts[-1] or "") + ORDER
                if size >= CHUNK:
                    yield from sums(texts, flags)
                    texts, flags, size = [], [], 0
        if texts:
            yield from sums(texts, flags)

    return docs.mapInArrow(run, "high long, low long, target long, background long")


def mean_losses(owns, starts: np.ndarray, totals: list[float], mu: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: tokens, and the mean loss under target and background. owns has, for each order, both models' counts of
    the n-gram that ends at each position, side by side."""
    total = int(starts[-1])
    n = np.diff(starts) - (ORDER - 1)
    p = np.full((total, 2), 1 / VOCABULARY, np.float32)
    context = np.tile(np.array(totals, np.float32), (total, 1))
    mu = np.float32(mu)
    for own in owns:
        p *= mu
        p += own
        p /= np.maximum(context, own) + mu
        context[1:] = own[:-1]
    loss = -np.log(p)
    loss[valid(starts, total) < ORDER - 1] = 0
    sums = np.add.reduceat(loss, starts[:-1], axis=0, dtype=np.float64) / n[:, None] if len(n) else np.empty((0, 2))
    return n, sums[:, 0], sums[:, 1]


class Counts:
    """Both models' counts as a written table of (high, low, target, background), one row for each n-gram."""

    def __init__(self, grams: DataFrame, totals: list[float], mu: float):
        self.grams, self.totals, self.mu = grams, totals, mu


def fitted(docs: DataFrame, targets: DataFrame, mu: float = 5.0, id_col: str = "doc_id", text_col: str = "text") -> Counts:
    """Models of all documents and of those whose id is in targets."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    named = targets.select(F.col(id_col).alias("id")).where("id is not null").distinct().withColumn("is_target", F.lit(True))
    flagged = base.join(small_first(written(named, "targets")), "id", "left").select("text", F.coalesce("is_target", F.lit(False)).alias("is_target"))
    grams = written(counted(flagged).groupBy("high", "low").agg(F.sum("target").alias("target"), F.sum("background").alias("background")), "grams")
    # Every token is counted for the first order, begin tokens included.
    found = grams.where(f"high = 0 and low < {1 << BITS}").agg(F.sum("target"), F.sum("background")).first()
    return Counts(grams, [float(x or 0) for x in found], mu)


def scored(docs: DataFrame, models: Counts, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, target_loss, background_loss, score."""
    import pyarrow as pa

    kind = dict(docs.dtypes)[id_col]
    totals, mu = models.totals, models.mu
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = base.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + ORDER)).first()[0] or 1
    # Rows are dealt by their own number, so that equal ones part; written, as both reads must deal alike.
    number = F.xxhash64(F.monotonically_increasing_id())
    dealt = written(base.withColumn("chunk", F.pmod(number, F.lit(math.ceil(size / CHUNK)))), "lm-chunks")

    def asked(table: pa.Table) -> pa.Table:
        seq, starts = tokens(table.column("text").to_pylist())
        _, highs, lows = numbered(seq, valid(starts, len(seq)))
        place = [np.arange(1, len(low)) << 3 | n for n, low in enumerate(lows)]
        columns = [np.concatenate(place), *(np.concatenate([x[1:] for x in own]) for own in (highs, lows))]
        return pa.table([pa.array(np.full(len(columns[0]), table.column("chunk")[0].as_py(), np.int64)), *map(pa.array, columns)], names=["chunk", "place", "high", "low"])

    def answered(left: pa.Table, right: pa.Table) -> pa.Table:
        seq, starts = tokens(left.column("text").to_pylist())
        at, _, lows = numbered(seq, valid(starts, len(seq)))
        place = right.column("place").to_numpy()
        told = np.column_stack([right.column(c).to_numpy() for c in ("target", "background")]).astype(np.float32)

        def own(n: int) -> np.ndarray:
            counts, here = np.zeros((len(lows[n]), 2), np.float32), place & 7 == n
            counts[place[here] >> 3] = told[here]
            return counts[at[n]]

        n, a, b = mean_losses(map(own, range(ORDER)), starts, totals, mu)
        return pa.table([left.column("id"), pa.array(n), pa.array(a), pa.array(b), pa.array(a - b)], names=["id", "n_tokens", "target_loss", "background_loss", "score"])

    questions = dealt.groupBy("chunk").applyInArrow(asked, "chunk long, place long, high long, low long")
    answers = questions.join(models.grams, ["high", "low"]).select("chunk", "place", "target", "background")
    out = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(answered, f"id {kind}, n_tokens long, target_loss double, background_loss double, score double")
    return out.withColumnRenamed("id", id_col)
