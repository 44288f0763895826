"""Quality by co-training of two views.

One classifier sees the text's content alone (its words, their forms, and shares of characters), the other the page's
metadata alone (source, language, length as told). Both are logistic regressions. They start from the labelled rows;
in each round each view scores all unlabelled rows, and the rows it is surest of, as many of either class as keeps
the labelled balance, become labelled examples for the other view. The bounds of what is sure come from counts of
log-odds by narrow bins, and rows of one bin are taken together; gradients and Hessians are summed over all rows that
were taken, by tasks. At the end both are calibrated on rows that took no part in the fit, and the calibrated log-odds
are combined by a last logistic regression on the same rows, so a view that knows little weighs little. Every
document is then scored from both views.

What a word says is its smoothed log-odds among labelled documents, by hash in ``WORD_BUCKETS`` buckets. It is counted in
two halves of the labelled rows, each half scored by the other's counts, so no document is told by its own label;
all others are scored by the mean of both.

Of labelled rows the fit reads a bounded sample: ``fit_rows`` of them, those with the smallest hash of their id (all,
if fewer). Unlabelled rows all take part. Scoring sees every row and the whole of its text.

Defined results: null text is the empty text, null metadata a value of its own; of several labels for one id the
majority counts, and good if there is none; without labels of both classes every document gets the labelled share of
good ones (one half if there are none); repeated rows are scored alike; other input columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_first, written

META_BUCKETS = 64
#: Hash buckets of words, and how many words a worker remembers.
WORD_BUCKETS, KNOWN_WORDS = 1 << 16, 50_000
#: Edges of the bins of ranks, and from which rank a view is sure: a probability of 0.9 (of 0.1, on the other side).
EDGES = np.linspace(-12, 12, 12001)
SURE = np.arcsinh(np.log(9))
#: The most steps of a fit.
STEPS = 40
_runs = re.compile(r"(.)\1{2,}").findall


def _classes() -> np.ndarray:
    """Byte classes: lower, upper, digit, space, line feed, each ASCII punctuation by itself, other."""
    out = np.full(256, 5, np.int64)
    for b in range(128):
        c = chr(b)
        out[b] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 4 if c == "\n" else 3 if c.isspace() else 6 + b if c.isprintable() else 5
    _, dense = np.unique(out, return_inverse=True)
    return dense


CLASSES = _classes()
N_CLASSES = int(CLASSES.max()) + 1


class Words:
    """What is known of words, kept for those met before: forms, lengths, and what their hash buckets say."""

    def __init__(self, odds: np.ndarray | None):
        self.odds = odds
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.table = np.empty((4096, 9))

    def _row(self, w: str) -> tuple:
        n = len(w)
        said = float(self.odds[bucket(w)]) if self.odds is not None else 0.0
        return (w.isupper(), w[0].isupper(), not w[-1].isalnum(), not any(map(str.isalnum, w)), n, n * n, n <= 3, n >= 12, said)

    def facts(self, words: list[str]) -> np.ndarray:
        """A row of facts for each word."""
        if len(self.at) > KNOWN_WORDS:
            self.forget()
        at, get = [], self.at.get
        for w in words:
            i = get(w)
            if i is None:
                i = self.at[w] = len(self.at)
                if i == len(self.table):  # doubled, so that growing costs little
                    self.table = np.concatenate([self.table, np.empty_like(self.table)])
                self.table[i] = self._row(w)
            at.append(i)
        return self.table[at]


def bucket(word: str) -> int:
    return zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % WORD_BUCKETS


def text_features(text: str | None, known: Words) -> np.ndarray:
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, len(data))
    shares = np.bincount(CLASSES[data], minlength=N_CLASSES) / n
    words = text.split()
    lines = [x for x in text.split("\n") if x]
    k = max(1, len(words))
    facts = known.facts(words) if words else np.zeros((1, 9))
    upper, capital, ends, bare, length, squares, short, long, said = facts.sum(axis=0) / k
    rest = [
        1.0,
        np.log1p(len(words)),
        np.log1p(len(lines)),
        length,
        np.sqrt(max(0.0, squares - length * length)),
        len(set(words)) / k,
        len(set(lines)) / max(1, len(lines)),
        upper,
        capital,
        ends,
        bare,
        short,
        long,
        len(_runs(text)) / k,
        float(text[-1:] in ".!?"),
        said,
        float(facts[:, 8].min()),
        float(facts[:, 8].max()),
        said * np.sqrt(k),
    ]
    return np.concatenate([np.sqrt(shares), rest])


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(2 * META_BUCKETS + 4)
    out[zlib.crc32(f"source {source}".encode()) % META_BUCKETS] = 1
    out[META_BUCKETS + zlib.crc32(f"lang {lang}".encode()) % META_BUCKETS] = 1
    size = np.log1p(max(0, n_chars or 0))
    out[-4:] = 1.0, size, size * size / 10, float(n_chars is None)
    return out


class Newton:
    """Newton's steps with a ridge; a step that makes the loss worse is halved until it doesn't."""

    def __init__(self, w: np.ndarray, ridge: float):
        self.w, self.best, self.ridge = w, w, ridge
        self.least, self.done = np.inf, False

    def take(self, sums: np.ndarray, loss: float) -> bool:
        """Go on from the sums and the loss at w; whether the place is found."""
        d = len(self.w)
        loss += self.ridge * float(self.w @ self.w) / 2
        if not self.done:
            if loss <= self.least + 1e-9 * max(1.0, abs(self.least)):
                step = np.linalg.solve(sums[: d * d].reshape(d, d) + self.ridge * np.eye(d), sums[d * d :] + self.ridge * self.w)
                self.done = bool(np.abs(step).max() < 1e-6)
                self.least, self.best, self.w = loss, self.w, self.w - step
            else:
                self.w = (self.w + self.best) / 2
                self.done = bool(np.abs(self.w - self.best).max() < 1e-9)
            if self.done:
                self.best = self.w
        return self.done


class Logistic:
    """Logistic regression by Newton's steps with a ridge, on scaled features."""

    def __init__(self, ridge: float = 1.0):
        self.ridge = ridge

    def fit(self, x: np.ndarray, y: np.ndarray, scale: np.ndarray | None = None) -> Logistic:
        self.scale = np.maximum(np.abs(x).max(axis=0), 1e-9) if scale is None else scale
        z = x / self.scale
        steps = Newton(np.zeros(x.shape[1]), self.ridge)
        for _ in range(STEPS):
            if steps.take(newton_sums(z, y, steps.w), loss_of(z, y, steps.w)):
                break
        w = steps.best
        self.w = w / self.scale
        return self

    def ranks(self, x: np.ndarray) -> np.ndarray:
        """Log-odds without a bound, on a scale that has room for large ones, so that sure rows don't tie."""
        return np.clip(np.arcsinh(x @ self.w), EDGES[0], EDGES[-1])

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x @ self.w, -30, 30)


def probability(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-odds))


class CoTrained:
    def __init__(self, text: Logistic | None, meta: Logistic | None, calibrations, blend, base: float, odds: np.ndarray | None = None):
        self.text, self.meta, self.calibrations, self.blend, self.base, self.odds = text, meta, calibrations, blend, base, odds

    def scores(self, x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Combined, text and metadata probabilities."""
        if self.text is None:
            flat = np.full(len(x), self.base)
            return flat, flat, flat
        one = np.ones(len(x))
        views = [c.odds(np.column_stack([one, v.odds(f)])) for c, v, f in zip(self.calibrations, (self.text, self.meta), (x, m), strict=True)]
        return probability(self.blend.odds(np.column_stack([one, *views]))), probability(views[0]), probability(views[1])


def summed(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of (v array<double>) rows, added up in two steps so that few rows reach the driver."""
    import pyarrow as pa

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            total += batch.column(0).flatten().to_numpy().reshape(-1, size).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])

    found = parts.repartition(8).mapInArrow(run, "v array<double>").toArrow().column("v").combine_chunks()
    return found.flatten().to_numpy().reshape(-1, size).sum(axis=0)


def greatest(pool: DataFrame, least: list[np.ndarray]) -> list[np.ndarray]:
    """The greatest absolute value of each feature of both views, and least if that is more."""
    import pyarrow as pa

    def run(batches):
        most = [x.copy() for x in least]
        for batch in batches:
            for v in (0, 1):
                most[v] = np.maximum(most[v], np.abs(matrix(batch.column(v))).max(axis=0, initial=0))
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.list_(pa.float64())) for x in most], names=["x", "m"])

    found = pool.mapInArrow(run, "x array<double>, m array<double>").toArrow()
    return [np.maximum(x, matrix(found.column(v).combine_chunks()).max(axis=0, initial=0)) for v, x in enumerate(least)]


def loss_of(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The summed loss of rows."""
    return float(np.logaddexp(0, np.where(y > 0.5, -1, 1) * (z @ w)).sum())


def newton_sums(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The Hessian and then the gradient of the loss of rows, in one array."""
    p = probability(np.clip(z @ w, -30, 30))
    return np.concatenate([((z * (p * (1 - p) + 1e-6)[:, None]).T @ z).ravel(), z.T @ (p - y)])


def matrix(column) -> np.ndarray:
    """An Arrow column of arrays of one length."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def refitted(models: list[Logistic], labelled: list[np.ndarray], y: np.ndarray, taken: DataFrame) -> list[Logistic]:
    """Both views fitted to labelled rows and to what was taken for them, (view, label, f), by Newton's steps from models."""
    import pyarrow as pa
    import pyarrow.compute as pc

    scales = [m.scale for m in models]
    sizes = [len(x) for x in scales]
    steps = [Newton(m.w * m.scale, m.ridge) for m in models]
    lengths = [d * d + d + 1 for d in sizes]
    for _ in range(STEPS):

        def run(batches, ws=tuple(x.w for x in steps)):
            sums = [np.zeros(n) for n in lengths]
            for batch in batches:
                for k in range(0, batch.num_rows, 4096):
                    part = batch.slice(k, 4096)
                    for v in (0, 1):
                        own = part.filter(pc.equal(part.column(0), v))
                        if own.num_rows:
                            rows = matrix(own.column(2)) / scales[v], own.column(1).to_numpy(), ws[v]
                            sums[v] += np.append(newton_sums(*rows), loss_of(*rows))
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(sums)], pa.list_(pa.float64()))], names=["v"])

        sums = np.split(summed(taken.mapInArrow(run, "v array<double>"), sum(lengths)), [lengths[0]])
        found = []
        for v, x in enumerate(steps):
            rows = labelled[v] / scales[v], y, x.w
            found.append(x.take(sums[v][:-1] + newton_sums(*rows), sums[v][-1] + loss_of(*rows)))
        if all(found):
            break
    out = []
    for m, x in zip(models, steps, strict=True):
        new = Logistic(m.ridge)
        new.scale, new.w = m.scale, x.best / m.scale
        out.append(new)
    return out


def free_rows(views: list[np.ndarray], history: list) -> list[np.ndarray]:
    """Which rows no earlier round has taken for each view. history has each round's models and bounds: bounds[v] are
    the ranks up to and from which the other view's rows are taken for view v."""
    free = [np.ones(len(views[0]), bool) for _ in views]
    for models, bounds in history:
        for v in (0, 1):
            ranks = models[1 - v].ranks(views[1 - v])
            free[v] &= (ranks > bounds[v][0]) & (ranks < bounds[v][1])
    return free


def bounds_of(pool: DataFrame, models: list[Logistic], history: list, share: float, base: float) -> list[tuple[float, float]]:
    """For each view, the ranks of the other view's surest rows among all that are free."""
    import pyarrow as pa

    bins = len(EDGES) - 1

    def run(batches):
        sums = np.zeros((2, bins))
        rows = 0
        for batch in batches:
            views = [matrix(batch.column(i)) for i in (0, 1)]
            rows += batch.num_rows
            for v, free in enumerate(free_rows(views, history)):
                sums[v] += np.histogram(models[1 - v].ranks(views[1 - v])[free], EDGES)[0]
        yield pa.RecordBatch.from_arrays([pa.array([np.append(sums.ravel(), rows)], pa.list_(pa.float64()))], names=["v"])

    found = summed(pool.mapInArrow(run, "v array<double>"), 2 * bins + 1)
    want = int(share * found[-1])
    out = []
    for own in found[:-1].reshape(2, bins):
        low, high = round(want * (1 - base)), round(want * base)
        # So many bins from either end that they hold what is wanted.
        up = EDGES[min(bins, np.searchsorted(np.cumsum(own), low) + 1)] if low else -np.inf
        down = EDGES[max(0, bins - 1 - np.searchsorted(np.cumsum(own[::-1]), high))] if high else np.inf
        out.append((min(up, -SURE), max(down, SURE)))
    return out


def taken_rows(pool: DataFrame, models: list[Logistic], bounds, history: list) -> DataFrame:
    """(view, label, f): rows that this round takes for each view, with that view's features."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            views = [matrix(batch.column(i)) for i in (0, 1)]
            for v, free in enumerate(free_rows(views, history)):
                ranks = models[1 - v].ranks(views[1 - v])
                here = np.nonzero(free & ((ranks <= bounds[v][0]) | (ranks >= bounds[v][1])))[0]
                for k in range(0, len(here), 4096):
                    at = here[k : k + 4096]
                    label = (ranks[at] > 0).astype(float)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), v)), pa.array(label), pa.array(list(views[v][at]), pa.list_(pa.float64()))], names=["view", "label", "f"])

    return pool.mapInArrow(run, "view long, label double, f array<double>")


def cotrained(x, m, y, pool: DataFrame | None, odds: np.ndarray | None = None, rounds: int = 4, share: float = 0.05) -> CoTrained:
    """x, m, y: views and labels of labelled rows; every fifth of them calibrates. pool: (x, m) of all unlabelled rows."""
    base = float(y.mean()) if len(y) else 0.5
    if len(set(y.tolist())) < 2 or len(y) < 10:
        return CoTrained(None, None, None, None, base, odds)
    held = np.arange(len(y)) % 5 == 0
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(y), bool)
    views = [x, m]
    labelled = [v[~held] for v in views]
    scales = [np.maximum(np.abs(v).max(axis=0), 1e-9) for v in labelled]
    if pool is not None:
        scales = greatest(pool, scales)
    models = [Logistic().fit(v, y[~held], scale) for v, scale in zip(labelled, scales, strict=True)]
    history, taken = [], None
    for _ in range(rounds if pool is not None else 0):
        bounds = bounds_of(pool, models, history, share, base)
        more = written(taken_rows(pool, models, bounds, history), "taken")
        taken = more if taken is None else taken.union(more)
        history.append((models, bounds))
        models = refitted(models, labelled, y[~held], taken)
    proof = held if held.any() else ~held
    one = np.ones(int(proof.sum()))
    calibrations = [Logistic(0.01).fit(np.column_stack([one, v.odds(f[proof])]), y[proof]) for v, f in zip(models, views, strict=True)]
    told = [c.odds(np.column_stack([one, v.odds(f[proof])])) for c, v, f in zip(calibrations, models, views, strict=True)]
    blend = Logistic(0.1).fit(np.column_stack([one, *told]), y[proof])
    return CoTrained(models[0], models[1], calibrations, blend, base, odds)


def word_counts(docs: DataFrame, half: int) -> np.ndarray:
    """By bucket, how many bad and good documents of (id, text, label) in one half of the ids hold a word of it: two rows."""
    import pyarrow as pa

    def run(batches):
        total = np.zeros((2, WORD_BUCKETS))
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                own = {bucket(w) for w in set((text.as_py() or "").split())}
                total[int(label), list(own)] += 1
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["v"])

    own = docs.where(F.pmod(F.xxhash64("id"), F.lit(2)) == half).select("text", "label")
    return summed(own.mapInArrow(run, "v array<double>"), 2 * WORD_BUCKETS).reshape(2, WORD_BUCKETS)


def word_odds(counts: np.ndarray, smoothing: float = 2.0) -> np.ndarray:
    """Smoothed log-odds of good by bucket; 0 for buckets that say nothing."""
    bad, good = counts
    share = (good.sum() + 1) / (good.sum() + bad.sum() + 2)
    return np.log((good + smoothing * share) / (bad + smoothing * (1 - share))) - np.log(share / (1 - share))


def featured(docs: DataFrame, odds: list[np.ndarray]) -> DataFrame:
    """(id, label) rows of (id, text, source, lang, n_chars, label) with both views' features. Labelled rows are told by the
    words of the other half, all others by the mean."""
    import pyarrow as pa

    mean = (odds[0] + odds[1]) / 2

    def run(batches):
        known = [Words(odds[1]), Words(odds[0]), Words(mean)]
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                x = [text_features(v.as_py(), known[h]) for v, h in zip(part.column(1), part.column(6).to_pylist(), strict=True)]
                m = [meta_features(*v) for v in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(5), pa.array(x, pa.list_(pa.float64())), pa.array(m, pa.list_(pa.float64()))], names=["id", "label", "x", "m"])

    half = F.when(F.col("label").isNotNull(), F.pmod(F.xxhash64("id"), F.lit(2))).otherwise(2).cast("int").alias("half")
    return docs.select("id", "text", "source", "lang", "n_chars", "label", half).mapInArrow(run, "id long, label double, x array<double>, m array<double>")


def _inputs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    told = [F.col(c).cast(kind).alias(c) for c, kind in (("source", "string"), ("lang", "string"), ("n_chars", "long"))]
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *told)


def fitted(docs: DataFrame, labels: DataFrame, fit_rows: int = 8_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> CoTrained:
    each = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("label"))
    told = each.groupBy("id").agg((F.avg("label") >= 0.5).cast("double").alias("label"))
    first = told.orderBy(F.xxhash64("id"), "id").limit(fit_rows)  # short rows
    inputs = _inputs(docs, id_col, text_col)
    near = inputs.join(F.broadcast(first), "id")
    odds = [word_odds(word_counts(near, half)) for half in (0, 1)]
    rows = featured(near, odds).toArrow()
    label = rows.column("label").to_numpy(zero_copy_only=False)
    order = np.argsort(rows.column("id").to_numpy(), kind="stable")
    shape = (len(label), -1)
    x, m = ((np.array(rows.column(c).to_pylist(), float).reshape(shape) if len(label) else np.empty((0, 1)))[order] for c in ("x", "m"))
    label = label[order]
    mean = (odds[0] + odds[1]) / 2
    if len(set(label.tolist())) < 2:
        return cotrained(x, m, label, None, mean)
    known = small_first(written(told.select("id"), "told"))
    rest = inputs.where("id is not null").join(known, "id", "left_anti").withColumn("label", F.lit(None).cast("double"))
    pool = written(featured(rest, odds).select("x", "m"), "pool")
    return cotrained(x, m, label, pool, mean)


def scored(docs: DataFrame, model: CoTrained, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score, text_score, meta_score."""
    import pyarrow as pa

    def run(batches):
        known = Words(model.odds)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                x = np.array([text_features(v.as_py(), known) for v in part.column(1)])
                m = np.array([meta_features(*v) for v in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)), strict=True)])
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, model.scores(x, m))], names=["id", "score", "text_score", "meta_score"])

    return _inputs(docs, id_col, text_col).mapInArrow(run, "id long, score double, text_score double, meta_score double").withColumnRenamed("id", id_col)
