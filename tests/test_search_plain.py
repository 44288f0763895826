"""The search pipeline, discovery and diversity against plain Python over a small store."""

import math
import random
import re
from collections import defaultdict

import pytest

from recallgrid.functions import text as tx
from recallgrid.operators import postings, retrieval
from recallgrid.plans import pipeline

WORDS = ["red", "fox", "river", "stone", "cloud", "lamp", "paper", "green", "wolf", "song"]
STATES = ((0.3, "active"), (0.1, "dormant"), (0.02, "deep"))


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(y * y for y in b))


class Store:
    def __init__(self, seed):
        rng = random.Random(seed)
        self.rows = {}
        for i in range(70):
            words = rng.choices(WORDS, weights=range(1, 11), k=rng.randrange(3, 14))
            energy = rng.choice([0.9, 0.5, 0.2, 0.05, 0.01])
            vector = None if i % 9 == 8 else [rng.gauss(0, 1) for _ in range(5)]
            self.rows[i] = {"id": i, "content": f"[box{i % 4}] " + " ".join(words), "energy": energy, "created_at": 1000 + i, "embedding": vector, "state": next((s for e, s in STATES if energy >= e), "archived")}
        self.rows[60]["embedding"] = [x * 2 for x in self.rows[1]["embedding"]]  # the same direction
        self.edges = [(a, b, round(rng.random(), 2), k) for k, (a, b) in enumerate({(rng.randrange(70), rng.randrange(75)) for _ in range(260)})]
        self.q = [rng.gauss(0, 1) for _ in range(5)]

    def frames(self, spark):
        m = spark.createDataFrame([tuple(r[c] for c in ("id", "content", "energy", "created_at", "embedding", "state")) for r in self.rows.values()], "id long, content string, energy double, created_at long, embedding array<double>, state string")
        e = spark.createDataFrame([(a, b, w, 0, None, k) for a, b, w, k in self.edges], "from_id long, to_id long, weight double, co_activation_count long, ordinal int, edge_seq long")
        return m, e, spark.createDataFrame([(self.q,)], "q array<double>")


def best(scores, k):
    return dict(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k])


def keyword(store, query, k):
    toks = {i: [t for t in re.split(r"\W+", r["content"].lower()) if t] for i, r in store.rows.items()}
    terms = query.lower().split()
    mean = sum(map(len, toks.values())) / len(toks)
    df = {t: sum(t in x for x in toks.values()) for t in terms}
    out = {}
    for i, x in toks.items():
        if terms and all(t in x for t in terms):
            score = 0.0
            for t in terms:
                idf = math.log((len(toks) - df[t] + 0.5) / (df[t] + 0.5))
                tf = x.count(t)
                score += (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / mean))
            out[i] = round(score, 12)
    return best(out, k)


def hybrid(store, query, fetch, least):
    near = {i: cosine(r["embedding"], store.q) for i, r in store.rows.items() if r["embedding"]}
    near = best({i: s for i, s in near.items() if s >= least}, fetch)
    words = keyword(store, query, fetch)
    if not words:
        return near
    out = defaultdict(float)
    for ranked in (near, words):
        for rank, i in enumerate(sorted(ranked, key=lambda i: (-ranked[i], i)), 1):
            out[i] += 1 / (60 + rank)
    return {i: min(1.0, s / (2 / 61)) for i, s in out.items()}


def diverse(rows, query, limit):
    """Greedy choice, written from its rules: what is too near a chosen one is out for good."""
    terms = tx.fallback_terms(query)
    cues = {c for c in map(tx.shaping_token, terms) if c} if terms else tx.shaping_tokens(query)
    pool, chosen = sorted(rows, key=lambda r: (-r["blended"], r["id"])), []
    box = lambda r: re.match(r"\[[^\]]*\]", r["content"])[0].lower()
    words = lambda r: tx.shaping_tokens(r["content"])
    while pool and len(chosen) < limit:
        pool = [r for r in pool if not any(r["embedding"] and c["embedding"] and cosine(r["embedding"], c["embedding"]) >= 0.85 for c in chosen)]
        if not pool:
            break
        met = {c for c in cues if any(c in x["content"].lower() for x in chosen)}

        def value(r, met=met):
            overlap = max((len(words(r) & words(c)) / len(words(r) | words(c)) for c in chosen), default=0.0)
            crowd = sum(box(c) == box(r) for c in chosen)
            return r["blended"] + 0.05 * sum(c in r["content"].lower() for c in cues - met) - 0.2 * overlap - (0.08 * crowd if crowd >= 2 else 0.0)

        top = max(pool, key=value)
        chosen.append(top)
        pool.remove(top)
    return chosen


def searched(store, query, limit, least, depth=1):
    composite, inferential = pipeline.is_composite(query), pipeline.is_inferential(query)
    limit = min(max(limit, 15), 30) if composite else limit
    fetch, hits = 3 * limit, {}

    def add(texts, at):
        for t in texts:
            for i, s in hybrid(store, t, fetch, at).items():
                hits[i] = max(hits.get(i, s), s)

    add(tx.expand_query(query), least)
    terms = tx.fallback_terms(query)
    if terms and (len(hits) < 3 or composite):
        add(terms if len(hits) < 3 else terms[:3], least)
    relaxed = max(0.6 * least, 0.15)
    if inferential and relaxed < least and len(hits) < limit:
        add([query, *terms[:2]], relaxed)
    seen = {i: store.rows[i] | {"blended": s + 0.03 * store.rows[i]["energy"]} for i, s in hits.items() if store.rows[i]["state"] in ("active", "dormant")}
    order = sorted(seen, key=lambda i: (-seen[i]["blended"], i))
    found, reached, frontier = {}, set(seen), order
    for _ in range(depth):
        nexts = []
        for i in frontier:
            for a, b, w, _ in sorted(store.edges, key=lambda e: e[3]):
                if a == i and w >= 0.15 and b not in reached:
                    reached.add(b)
                    r = store.rows.get(b)
                    if r and r["embedding"]:
                        nexts.append(b)
                        found[b] = r | {"blended": cosine(r["embedding"], store.q) * (0.5 + 0.5 * r["energy"]) + 0.1 * w}
        frontier = nexts
    fresh = sorted(found.values(), key=lambda r: (-r["blended"], r["id"]))[: min(max(limit, 5), 12)]
    rows = [*seen.values(), *(r for r in fresh if r["state"] in ("active", "dormant"))]
    return diverse(rows, query, limit)


@pytest.mark.parametrize(("seed", "query", "limit", "least", "depth"), [(1, "the fox", 8, 0.3, 1), (2, "red and river", 6, 0.4, 1), (3, "what might the wolf song be", 10, 0.7, 2), (4, "zebra quartz", 5, 0.95, 3)])
def test_search(spark, seed, query, limit, least, depth):
    store = Store(seed)
    m, e, q = store.frames(spark)
    out = pipeline.search(m, e, q, query, 7, pipeline.SearchOptions(limit=limit, min_score=least, depth=depth), index=postings.of(m))["result"].collect()
    want = searched(store, query, limit, least, depth)
    assert [(r.position, r.id, r.query_id) for r in sorted(out, key=lambda r: r.position)] == [(k, r["id"], 7) for k, r in enumerate(want, 1)]
    assert [r.blended for r in sorted(out, key=lambda r: r.position)] == pytest.approx([r["blended"] for r in want])


def test_diversity(spark):
    store = Store(9)
    m, _, q = store.frames(spark)
    from pyspark.sql import functions as F

    hits = retrieval.similar(m, q).withColumn("blended", F.round("score", 9)).withColumn("query_id", F.lit(3).cast("long")).withColumn("query", F.lit("red fox of the river"))
    got = [r.id for r in retrieval.diversity(hits, 12).orderBy("position").collect()]
    rows = [r | {"blended": round(cosine(r["embedding"], store.q), 9)} for r in store.rows.values() if r["embedding"]]
    assert got == [r["id"] for r in diverse(rows, "red fox of the river", 12)] and len(got) == 12
