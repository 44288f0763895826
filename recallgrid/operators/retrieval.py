"""Vector and keyword retrieval, fusion, re-scoring and diversity selection.

Queries may come many at once: frames with a query_id column are ranked per query. A query's vector is one short
row and is broadcast; the memories are scanned once, with no shuffle before the top rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.functions.scalars import cosine, source_bucket
from recallgrid.functions.text import fallback_terms, query_phrases, shaping_token, shaping_tokens, tokens
from recallgrid.operators import postings

RRF_K = 60


def similar(vectors: DataFrame, q: DataFrame, min_score: float | None = None) -> DataFrame:
    """Vectors with their cosine to the query, those that reach min_score."""
    out = vectors.where("embedding is not null").crossJoin(F.broadcast(q)).withColumn("score", cosine("embedding", "q")).where("score is not null").drop("q")
    return out if min_score is None else out.where(F.col("score") >= min_score)


def knn(vectors: DataFrame, q: DataFrame, k: int, min_score: float | None = None, enrichments: DataFrame | None = None) -> DataFrame:
    """(id, score) of the k best; a memory scores the best of its own vector and its enrichments'."""
    hits = similar(vectors.select("id", "embedding"), q, min_score).select("id", "score")
    if enrichments is not None:
        more = similar(enrichments.select(F.col("memory_id").alias("id"), "embedding"), q, min_score).join(vectors.select("id"), "id", "left_semi").select("id", "score")
        hits = hits.unionByName(more).groupBy("id").agg(F.max("score").alias("score"))
    return hits.orderBy(F.desc("score"), "id").limit(k)


def similar_to(vectors: DataFrame, node: int, k: int) -> DataFrame:
    """The k nearest of a memory, without itself."""
    q = vectors.where(F.col("id") == node).select(F.col("embedding").alias("q"))
    return similar(vectors.where(F.col("id") != node), q).select("id", "score").orderBy(F.desc("score"), "id").limit(k)


def _less(text: str) -> Column:
    """How many bytes the column joined loses without a text."""
    return (F.octet_length("joined") - F.octet_length(F.replace("joined", F.lit(text), F.lit("")))).cast("int")


def _count(phrase: list[str]) -> Column:
    """How often a phrase stands in the column joined, whose tokens have a space of their own on either side."""
    if len(phrase) > 1:
        return F.regexp_count("joined", F.lit(f"(?= {'  '.join(phrase)} )"))
    return (_less(f" {phrase[0]} ") / F.lit(len(phrase[0].encode()) + 2)).cast("int")


def counted(docs: DataFrame, phrases: list[list[str]], content: str = "content", toks: Column | None = None, settle=lambda rows: rows) -> tuple[DataFrame, DataFrame]:
    """(id, len, tf0, tf1, ...) of each document, and one row of statistics: n, avg_len, df0, df1, ... Both read the documents, unless
    settle keeps the counts.

    Only the query's terms are counted, so documents aren't exploded.
    """
    joined = F.concat(F.lit(" "), F.array_join(tokens(content) if toks is None else toks, "  "), F.lit(" "))
    rows = docs.where(F.col(content).isNotNull()).select("id", joined.alias("joined"))
    length = F.when(F.col("joined") == "  ", 0).otherwise((_less(" ") / F.lit(2)).cast("int"))
    rows = rows.select("id", length.alias("len"), *(_count(p).alias(f"tf{i}") for i, p in enumerate(phrases)))
    rows = settle(rows)
    stats = rows.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(phrases))))
    return rows, stats


def bm25_part(i: int, k1: float = 1.2, b: float = 0.75) -> Column:
    """What phrase i adds to a document's score; rows and statistics stand side by side."""
    idf = F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
    idf = F.when(idf <= 0, 1e-6).otherwise(idf)
    tf = F.col(f"tf{i}")
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))


def bm25(docs: DataFrame, query: str, k: int | None = None, content: str = "content", k1: float = 1.2, b: float = 0.75, toks: Column | None = None, settle=lambda rows: rows) -> DataFrame:
    """(id, score) of documents that hold every phrase of the query, best first."""
    phrases = query_phrases(query)
    if not phrases:
        return docs.select("id", F.lit(0.0).alias("score")).where("false")
    rows, stats = counted(docs, phrases, content, toks, settle)
    hits = rows.where(reduce(lambda x, y: x & y, (F.col(f"tf{i}") > 0 for i in range(len(phrases))))).crossJoin(F.broadcast(stats))
    score = reduce(lambda x, y: x + y, (bm25_part(i, k1, b) for i in range(len(phrases))))
    out = hits.select("id", score.alias("score")).orderBy(F.desc("score"), "id")
    return out if k is None else out.limit(k)


#: Words whose stems a worker keeps.
STEMS_KEPT = 1 << 19


def stems(words: Column) -> Column:
    """Porter stems of a list of words: each distinct word of an Arrow batch is stemmed once, and no word becomes a Python object otherwise."""
    import pyarrow as pa
    import pyarrow.compute as pc

    from recallgrid.functions.text import porter

    memo: dict[str, str] = {}

    def stem(column):
        coded = column.flatten().dictionary_encode()
        if len(memo) > STEMS_KEPT:
            memo.clear()
        made = [memo[t] if t in memo else memo.setdefault(t, porter(t)) for t in coded.dictionary.to_pylist()]
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        ends = pa.array([0, *sizes.cumsum().tolist()], pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(made, pa.string()).take(coded.indices), mask=column.is_null())

    return F.arrow_udf(stem, "array<string>", F.ArrowUDFType.SCALAR)(words)


def bm25_stemmed(docs: DataFrame, query: str, k: int | None = None, content: str = "content") -> DataFrame:
    """BM25 over Porter stems, of documents and query alike. Documents are stemmed once, for the statistics and the scores."""
    from recallgrid.functions.text import porter
    from recallgrid.operators.graph import cut

    stemmed = " ".join("-".join(porter(t) for t in p) for p in query_phrases(query))
    return bm25(docs, stemmed, k, content, toks=stems(tokens(content)), settle=cut)


def rrf(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (id, score) lists, normalised so that first in all lists is 1."""
    ranked = [x.select("id", F.row_number().over(Window.partitionBy(F.lit(i)).orderBy(F.desc("score"), "id")).alias("rank")) for i, x in enumerate(lists)]
    every = reduce(DataFrame.unionByName, ranked)
    total = F.sum(1 / (k + F.col("rank").cast("double")))
    return every.groupBy("id").agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total / (len(lists) / (k + 1)))).alias("score"))


def hybrid(memories: DataFrame, q: DataFrame, query: str, fetch: int, min_score: float, enrichments: DataFrame | None = None, index: postings.Index | None = None) -> DataFrame:
    """Vector hits fused with keyword hits; without keyword hits, the vector scores as they are."""
    near = knn(memories.select("id", "embedding"), q, fetch, min_score, enrichments)
    words = bm25(memories, query, fetch) if index is None else postings.bm25(index, query, fetch, places=12)
    fused = rrf([near, words])
    any_word = words.limit(1).agg(F.count("*").alias("hits"))
    plain = near.crossJoin(F.broadcast(any_word)).where("hits = 0").select("id", "score")
    return fused.crossJoin(F.broadcast(any_word)).where("hits > 0").select("id", "score").unionByName(plain)


def best_of(variants: list[DataFrame]) -> DataFrame:
    """Each id's best score over query variants, whatever their scales."""
    return reduce(DataFrame.unionByName, variants).groupBy("id").agg(F.max("score").alias("score"))


def energy_nudge(results: DataFrame, factor: float = 0.03) -> DataFrame:
    return results.withColumn("blended", F.col("blended") + factor * F.col("energy"))


def session_affinity(results: DataFrame, centroid: DataFrame, weight: float = 0.3) -> DataFrame:
    """Scores times 1 + weight * cosine to the session's centroid (one row, column centroid); rows without vector as they are."""
    out = results.crossJoin(F.broadcast(centroid))
    sim = F.when(F.col("embedding").isNull(), 0.0).otherwise(F.coalesce(cosine("embedding", "centroid"), F.lit(0.0)))
    return out.withColumn("blended", F.col("blended") * (1 + weight * sim)).drop("centroid")


def merge_associations(results: DataFrame, found: DataFrame, limit: int, keep: Column, low: int = 5, high: int = 12) -> DataFrame:
    """Results with the best discoveries; the cap counts before the filter."""
    cap = min(max(limit, low), high)
    fresh = found.join(results.select("id"), "id", "left_anti")
    best = fresh.orderBy(F.desc("blended"), "id").limit(cap).where(keep)
    return results.unionByName(best.select(*results.columns))


def select_diverse(rows: list[dict], query: str, limit: int, same: float = 0.85, overlap: float = 0.20, cue: float = 0.05, crowd: float = 0.08) -> list[dict]:
    """Greedy selection of bounded candidates: best score plus unseen cues, less overlap with what was chosen and less a toll
    for a crowded source; near-identical vectors are left out for good."""
    cues = cues_of(query)
    toks = [shaping_tokens(r["content"] or "") for r in rows]
    lows = [(r["content"] or "").lower() for r in rows]
    return [rows[i] for i in chosen_of(rows, toks, [{c for c in cues if c in low} for low in lows], limit, same, overlap, cue, crowd)]


def cues_of(query: str) -> set[str]:
    """What of a query is looked for in a text: its fallback terms, or all its words if it has none."""
    terms = fallback_terms(query)
    return {t for t in map(shaping_token, terms) if t} if terms else shaping_tokens(query)


def chosen_of(rows: list[dict], toks: list[set], held: list[set], limit: int, same: float = 0.85, overlap: float = 0.20, cue: float = 0.05, crowd: float = 0.08) -> list[int]:
    """The places of the rows that are selected, in order, by each row's words and the cues that it holds."""
    import numpy as np

    def unit(v):
        v = np.asarray(v, float)
        n = np.linalg.norm(v)
        return v / n if n else v

    vecs = [None if r["embedding"] is None else unit(r["embedding"]) for r in rows]
    repeat = [0.0] * len(rows)  # each row's greatest overlap with what was chosen
    open_rows, chosen, covered, sources = list(range(len(rows))), [], set(), {}
    while open_rows and len(chosen) < min(limit, len(rows)):
        best, best_score = None, 0.0
        for i in open_rows:
            n = sources.get(rows[i]["bucket"], 0)
            score = rows[i]["blended"] + cue * len(held[i] - covered) - overlap * repeat[i] - (crowd * n if n >= 2 else 0.0)
            if best is None or score > best_score:
                best, best_score = i, score
        chosen.append(best)
        covered |= held[best]
        sources[rows[best]["bucket"]] = sources.get(rows[best]["bucket"], 0) + 1
        left = []
        for i in open_rows:
            if i == best or vecs[i] is not None and vecs[best] is not None and len(vecs[i]) == len(vecs[best]) and float(vecs[i] @ vecs[best]) >= same:
                continue
            if toks[i] and toks[best]:
                both = len(toks[i] & toks[best])
                repeat[i] = max(repeat[i], both / (len(toks[i]) + len(toks[best]) - both))
            left.append(i)
        open_rows = left
    return chosen


def diversity(results: DataFrame, limit: int, keep_all: bool = False) -> DataFrame:
    """Per query_id, of its candidates (id, query, content, created_at, embedding, blended): position and id in order of
    selection. A query's candidates are bounded by the pipeline (three times the limit and the associations)."""
    import pandas as pd

    kind = dict(results.dtypes)["id"]

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["blended", "id"], ascending=[False, True])
        rows = pdf.to_dict("records")
        took = rows[:limit] if keep_all or len(rows) < 2 else select_diverse(rows, rows[0]["query"], limit)
        return pd.DataFrame({"query_id": [r["query_id"] for r in took], "position": range(1, len(took) + 1), "id": [r["id"] for r in took], "blended": [r["blended"] for r in took]})

    given = results.select("query_id", "query", "id", "content", "embedding", "blended", source_bucket("content", "created_at").alias("bucket"))
    return given.groupBy("query_id").applyInPandas(pick, f"query_id long, position int, id {kind}, blended double")


def classify(vectors: DataFrame, examples: DataFrame, asked: DataFrame | None = None, least_margin: float = 0.1) -> DataFrame:
    """(id, label, mean_similarity, margin): the class of highest mean similarity. With asked (id, label), also the label asked for, its
    similarity, and a warning (null if none) where another is ahead of it by least_margin. Mean cosine to a class is the dot of the unit
    vector with the class's mean unit vector, so examples are folded to one row per class and broadcast as such."""
    unit = F.transform("embedding", lambda x: x.cast("double") / F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, y: s + y.cast("double") * y.cast("double"))))
    means = examples.select("label", F.posexplode(unit).alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("m"))
    means = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))
    scores = vectors.select("id", unit.alias("u")).crossJoin(F.broadcast(means))
    scores = scores.select("id", "label", F.aggregate(F.zip_with("u", "mean", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x).alias("mean_similarity"))
    order = Window.partitionBy("id").orderBy(F.desc("mean_similarity"), "label")
    ranked = scores.withColumn("rn", F.row_number().over(order)).withColumn("margin", F.col("mean_similarity") - F.lead("mean_similarity").over(order))
    if asked is None:
        return ranked.where("rn = 1").drop("rn")
    given = scores.join(asked.withColumnRenamed("label", "asked"), "id").where(F.col("label") == F.col("asked")).select("id", F.col("mean_similarity").alias("asked_similarity"))
    best = ranked.where("rn = 1").drop("rn").join(asked.withColumnRenamed("label", "asked"), "id", "left").join(given, "id", "left")
    ahead = F.col("mean_similarity") - F.coalesce("asked_similarity", F.lit(0.0))
    warned = (F.col("asked") != F.col("label")) & (ahead >= least_margin)
    percent = lambda c: F.format_string("%.0f%%", c * 100)
    warning = F.concat(F.lit("You specified '"), F.col("asked").cast("string"), F.lit("', but this looks more like a '"), F.col("label").cast("string"), F.lit("' (confidence: "), percent(F.col("mean_similarity")), F.lit(" vs "), percent(F.coalesce("asked_similarity", F.lit(0.0))), F.lit("). Proceeding anyway."))
    return best.withColumn("warning", F.when(warned, warning))
