"""The registered queries, each over whole tables, with the SQL that states its result where SQL can."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallgrid.functions import scalars as sc
from recallgrid.functions import temporal as tm
from recallgrid.functions import text as tx
from recallgrid.operators import documents, dynamics, graph, identity, postings, retrieval, section_index, sessions, store, vector_index
from recallgrid.plans import many, pipeline
from recallgrid.plans.registry import query
from recallgrid.sources import views
from recallgrid.streaming import recalls

STATE = "CASE WHEN {e} >= 0.3 THEN 'active' WHEN {e} >= 0.1 THEN 'dormant' WHEN {e} >= 0.02 THEN 'deep' ELSE 'archived' END"
MEM = f"""m0 AS (
  SELECT d.doc_id AS id, d.text AS content, d.lang, d.source, e.embedding, CAST((d.doc_id * 37) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS energy,
    CAST(1 AS DOUBLE) AS confidence, 1700000000 + d.doc_id * 3600 AS created_at,
    1700000000 + d.doc_id * 3600 + (d.doc_id * 7919) % 86400 AS last_accessed, (d.doc_id * 13) % 50 AS access_count
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
mem AS (SELECT *, {STATE.format(e='energy')} AS state FROM m0)"""
ASSOC = """rl AS (
  SELECT event_id, ts, user_id AS session_id, (event_id * 7919) % (SELECT COUNT(*) FROM documents) AS mem_id FROM events WHERE event_type = 'view'),
ro AS (SELECT mem_id, ROW_NUMBER() OVER (ORDER BY ts, event_id) AS idx FROM rl),
pr AS (SELECT x.mem_id AS a, y.mem_id AS b FROM ro x JOIN ro y ON y.idx BETWEEN x.idx - 5 AND x.idx - 1 WHERE x.mem_id <> y.mem_id),
pn AS (SELECT f, t, COUNT(*) AS n FROM (SELECT a AS f, b AS t FROM pr UNION ALL SELECT b AS f, a AS t FROM pr) z GROUP BY f, t),
assoc AS (SELECT f AS from_id, t AS to_id, LEAST(CAST(1 AS DOUBLE), CAST(0.1 AS DOUBLE) + CAST(0.1 AS DOUBLE) * (n - 1)) AS weight, n - 1 AS co_activation_count,
  CAST(NULL AS INTEGER) AS ordinal FROM pn)"""
SIM = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
Q0 = "qv AS (SELECT embedding AS q FROM embeddings WHERE vec_id = {v})"
COLS = "id, lang, source, energy, state, created_at, last_accessed, access_count"


def r6(c):
    return F.round(c, 6)


def plain(df, *cols):
    return df.select(*[c.strip() for c in COLS.split(",")], *cols)


# --- scans, filters, statistics -------------------------------------------------------------------------------


@query("mem_state_counts", f"WITH {MEM} SELECT state, COUNT(*) AS n FROM mem GROUP BY state")
def mem_state_counts(spark, d):
    return views.mem(spark, d, vectors=False).groupBy("state").agg(F.count("*").alias("n"))


@query(
    "mem_stats",
    f"""WITH {MEM}, {ASSOC} SELECT COUNT(*) AS total, SUM(CASE WHEN state = 'active' THEN 1 ELSE 0 END)::BIGINT AS active, SUM(CASE WHEN state = 'dormant' THEN 1 ELSE 0 END)::BIGINT AS dormant,
  SUM(CASE WHEN state = 'deep' THEN 1 ELSE 0 END)::BIGINT AS deep, SUM(CASE WHEN state = 'archived' THEN 1 ELSE 0 END)::BIGINT AS archived, ROUND(AVG(energy), 6) AS avg_energy,
  (SELECT COUNT(*) FROM assoc) AS edges FROM mem""",
)
def mem_stats(spark, d):
    m = views.mem(spark, d, vectors=False)
    by_state = [F.count_if(F.col("state") == s).alias(s) for s in ("active", "dormant", "deep", "archived")]
    edges = views.assoc(spark, d).agg(F.count("*").alias("edges"))
    return m.agg(F.count("*").alias("total"), *by_state, r6(F.coalesce(F.avg("energy"), F.lit(0.0))).alias("avg_energy")).crossJoin(edges)


@query("mem_scan", f"WITH {MEM} SELECT {COLS} FROM mem")
def mem_scan(spark, d):
    return plain(views.mem(spark, d, vectors=False))


@query("mem_by_id", f"WITH {MEM} SELECT {COLS}, content FROM mem WHERE id = 7")
def mem_by_id(spark, d):
    return plain(views.mem(spark, d, vectors=False).where("id = 7"), "content")


@query("mem_by_state", f"WITH {MEM} SELECT {COLS} FROM mem WHERE state = 'dormant'")
def mem_by_state(spark, d):
    return plain(views.mem(spark, d, vectors=False).where("state = 'dormant'"))


@query("mem_not_archived", f"WITH {MEM} SELECT {COLS} FROM mem WHERE state <> 'archived'")
def mem_not_archived(spark, d):
    return plain(views.mem(spark, d, vectors=False).where(sc.state_filter("state", include_deep=True)))


@query("mem_searchable_top_energy", f"WITH {MEM} SELECT {COLS} FROM mem WHERE state IN ('active', 'dormant') ORDER BY energy DESC, id LIMIT 25")
def mem_searchable_top_energy(spark, d):
    return plain(views.mem(spark, d, vectors=False).where(sc.searchable("state")).orderBy(F.desc("energy"), "id").limit(25))


@query("mem_substring_search", f"WITH {MEM} SELECT {COLS} FROM mem WHERE contains(lower(content), 'the') AND state IN ('active', 'dormant') ORDER BY energy DESC, id LIMIT 20")
def mem_substring_search(spark, d):
    m = views.mem(spark, d, vectors=False).where(sc.contains_ci("content", "The") & sc.searchable("state"))
    return plain(m.orderBy(F.desc("energy"), "id").limit(20))


@query("mem_tag_search", f"WITH {MEM} SELECT {COLS} FROM mem WHERE lower(lang) = 'fr' OR lower(source) = 'fr'")
def mem_tag_search(spark, d):
    return plain(views.mem(spark, d, vectors=False).where(F.exists("tags", lambda t: F.lower(t) == "fr")))


@query("mem_tags_all", f"WITH {MEM} SELECT {COLS} FROM mem WHERE lang = 'en' AND source = 'src3'")
def mem_tags_all(spark, d):
    want = F.array(F.lit("en"), F.lit("src3"))
    return plain(views.mem(spark, d, vectors=False).where(F.size(F.array_except(want, F.transform("tags", F.lower))) == 0))


@query("mem_tags_any", f"WITH {MEM} SELECT {COLS} FROM mem WHERE lang = 'de' OR source = 'src3'")
def mem_tags_any(spark, d):
    return plain(views.mem(spark, d, vectors=False).where(F.arrays_overlap(F.transform("tags", F.lower), F.array(F.lit("de"), F.lit("src3")))))


@query("mem_tag_prefix", f"WITH {MEM} SELECT {COLS} FROM mem WHERE starts_with(lower(lang), 'src1') OR starts_with(lower(source), 'src1')")
def mem_tag_prefix(spark, d):
    return plain(views.mem(spark, d, vectors=False).where(F.exists("tags", lambda t: F.lower(t).startswith("src1"))))


@query("tag_list", f"WITH {MEM} SELECT DISTINCT tag FROM (SELECT lang AS tag FROM mem UNION ALL SELECT source AS tag FROM mem) t")
def tag_list(spark, d):
    return views.mem(spark, d, vectors=False).select(F.explode("tags").alias("tag")).distinct()


@query("tag_counts", f"WITH {MEM} SELECT tag, COUNT(*) AS n FROM (SELECT lang AS tag FROM mem UNION ALL SELECT source AS tag FROM mem) t GROUP BY tag")
def tag_counts(spark, d):
    return views.mem(spark, d, vectors=False).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("mem_created_range", f"WITH {MEM} SELECT {COLS} FROM mem WHERE created_at > 1700100000 AND created_at < 1701000000")
def mem_created_range(spark, d):
    return plain(views.mem(spark, d, vectors=False).where("created_at > 1700100000 and created_at < 1701000000"))


@query("mem_page_recent", f"WITH {MEM} SELECT {COLS}, COUNT(*) OVER () AS total_filtered FROM mem WHERE state = 'active' ORDER BY last_accessed DESC, id LIMIT 20 OFFSET 40")
def mem_page_recent(spark, d):
    m = views.mem(spark, d, vectors=False).where("state = 'active'")
    page = m.orderBy(F.desc("last_accessed"), "id").offset(40).limit(20)
    return plain(page.crossJoin(F.broadcast(m.agg(F.count("*").alias("total_filtered")))), "total_filtered")


@query("embedding_counts", f"WITH {MEM} SELECT COUNT(*) AS total, COUNT(embedding) AS with_embedding, COUNT(*) - COUNT(embedding) AS without_embedding FROM mem")
def embedding_counts(spark, d):
    m = views.mem(spark, d)
    return m.agg(F.count("*").alias("total"), F.count("embedding").alias("with_embedding"), (F.count("*") - F.count("embedding")).alias("without_embedding"))


@query("missing_embeddings", f"WITH {MEM} SELECT id FROM mem WHERE embedding IS NULL ORDER BY id LIMIT 50")
def missing_embeddings(spark, d):
    return views.mem(spark, d).where("embedding is null").select("id").orderBy("id").limit(50)


ENRICH = """en AS (SELECT w.memory_id, w.seq, e.embedding FROM (SELECT v.vec_id AS memory_id, s.seq, (v.vec_id * 7 + s.seq + 1) % (SELECT COUNT(*) FROM embeddings) AS at
  FROM embeddings v CROSS JOIN (SELECT 0 AS seq UNION ALL SELECT 1 AS seq) s) w JOIN embeddings e ON e.vec_id = w.at)"""


@query("missing_enrichments", f"WITH {MEM}, {ENRICH} SELECT id FROM mem WHERE id NOT IN (SELECT DISTINCT memory_id FROM en)")
def missing_enrichments(spark, d):
    return views.mem(spark, d, vectors=False).join(views.enrich(spark, d).select(F.col("memory_id").alias("id")), "id", "left_anti").select("id")


# --- dynamics -----------------------------------------------------------------------------------------------------


def _decay_sql(amount: str) -> str:
    e = f"CASE WHEN state = 'archived' THEN energy WHEN state = 'deep' THEN GREATEST(energy - {amount} * CAST(0.25 AS DOUBLE), CAST(0.001 AS DOUBLE)) ELSE GREATEST(energy - {amount}, CAST(0.001 AS DOUBLE)) END"
    return f"SELECT id, ROUND(e, 6) AS energy, {STATE.format(e='e')} AS state FROM (SELECT id, {e} AS e FROM mem) t"


@query("decay_memories", f"WITH {MEM} {_decay_sql('CAST(0.15 AS DOUBLE)')}")
def decay_memories(spark, d):
    return dynamics.decay(views.mem(spark, d, vectors=False), 0.15).select("id", r6("energy").alias("energy"), "state")


@query("decay_edges", f"WITH {ASSOC} SELECT from_id, to_id, ROUND(GREATEST(CAST(0 AS DOUBLE), weight - CAST(0.15 AS DOUBLE)), 6) AS weight FROM assoc")
def decay_edges(spark, d):
    return dynamics.decay_edges(views.assoc(spark, d), 0.15).select("from_id", "to_id", r6("weight").alias("weight"))


@query("decay_tick", f"WITH {MEM} {_decay_sql('(CAST(0.05 AS DOUBLE) * (CAST(36 AS DOUBLE) / CAST(24 AS DOUBLE)))')}")
def decay_tick(spark, d):
    m, _ = dynamics.time_decay(views.mem(spark, d, vectors=False), views.assoc(spark, d), 36.0)
    return m.select("id", r6("energy").alias("energy"), "state")


@query(
    "stimulate_once",
    f"""WITH {MEM}, s AS (SELECT *, CASE WHEN id % 3 = 0 THEN LEAST(CAST(1 AS DOUBLE), energy + CAST(0.2 AS DOUBLE)) ELSE energy END AS e FROM mem)
SELECT id, ROUND(e, 6) AS energy, {STATE.format(e='e')} AS state, access_count + CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS access_count,
  CASE WHEN id % 3 = 0 THEN 1800000000 ELSE last_accessed END AS last_accessed FROM s""",
)
def stimulate_once(spark, d):
    m = dynamics.stimulate(views.mem(spark, d, vectors=False), F.col("id") % 3 == 0, 0.2, F.lit(1800000000))
    return m.select("id", r6("energy").alias("energy"), "state", "access_count", "last_accessed")


@query(
    "resurrections",
    f"""WITH {MEM} SELECT id, state AS old_state, {STATE.format(e='LEAST(CAST(1 AS DOUBLE), energy + CAST(0.2 AS DOUBLE))')} AS state FROM mem
WHERE state IN ('deep', 'archived') AND LEAST(CAST(1 AS DOUBLE), energy + CAST(0.2 AS DOUBLE)) >= 0.1""",
)
def resurrections(spark, d):
    m = dynamics.stimulate(views.mem(spark, d, vectors=False), F.lit(True), 0.2, F.lit(1800000000))
    return m.where("resurrected").select("id", "old_state", "state")


@query("hebbian_edges", f"WITH {ASSOC} SELECT from_id, to_id, ROUND(weight, 6) AS weight, co_activation_count FROM assoc")
def hebbian_edges(spark, d):
    return views.assoc(spark, d).select("from_id", "to_id", r6("weight").alias("weight"), "co_activation_count")


@query(
    "propagate_once",
    f"""WITH {MEM}, {ASSOC}, p AS (SELECT to_id, CAST(0.2 AS DOUBLE) * weight * CAST(0.5 AS DOUBLE) AS x FROM assoc WHERE from_id = (SELECT MIN(from_id) FROM assoc))
SELECT m.id, ROUND(CASE WHEN x > 0.01 THEN LEAST(CAST(1 AS DOUBLE), energy + x) ELSE energy END, 6) AS energy, access_count + CASE WHEN x > 0.01 THEN 1 ELSE 0 END AS access_count
FROM mem m LEFT JOIN p ON p.to_id = m.id""",
)
def propagate_once(spark, d):
    edges = views.assoc(spark, d)
    source = edges.agg(F.min("from_id")).first()[0]
    return dynamics.propagate(views.mem(spark, d, vectors=False), edges, source, 0.2).select("id", r6("energy").alias("energy"), "access_count")


ORD = """ao AS (SELECT from_id, from_id + k AS to_id, CAST(0.9 AS DOUBLE) AS weight, CAST(k AS INTEGER) AS ordinal FROM
  (SELECT doc_id AS from_id FROM documents WHERE doc_id % 50 = 0) f CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 AS k UNION ALL SELECT 3 AS k) s WHERE from_id + k < (SELECT COUNT(*) FROM documents))"""


@query(
    "associate_upsert",
    f"""WITH {ASSOC}, {ORD} SELECT COALESCE(a.from_id, n.from_id) AS from_id, COALESCE(a.to_id, n.to_id) AS to_id, ROUND(COALESCE(n.weight, a.weight), 6) AS weight,
  COALESCE(a.co_activation_count, 0) AS co_activation_count, n.ordinal FROM assoc a FULL JOIN ao n ON a.from_id = n.from_id AND a.to_id = n.to_id""",
)
def associate_upsert(spark, d):
    out = dynamics.associate(views.assoc(spark, d), views.assoc_ordinal(spark, d))
    return out.withColumn("weight", r6("weight"))


@query(
    "associate_if_absent",
    f"""WITH {ASSOC}, {ORD} SELECT from_id, to_id, ROUND(weight, 6) AS weight FROM assoc UNION ALL
SELECT from_id, to_id, weight FROM ao n WHERE NOT EXISTS (SELECT 1 FROM assoc a WHERE a.from_id = n.from_id AND a.to_id = n.to_id)""",
)
def associate_if_absent(spark, d):
    return dynamics.associate_if_absent(views.assoc(spark, d), views.assoc_ordinal(spark, d)).select("from_id", "to_id", r6("weight").alias("weight"))


SESS = "ss AS (SELECT conv_id AS session_id, turn, role, text, (conv_id * 8 + turn) % (SELECT COUNT(*) FROM embeddings) AS spot FROM conversations)"


@query("session_wiring", f"WITH {SESS} SELECT DISTINCT a.spot AS from_id, b.spot AS to_id, CAST(0.5 AS DOUBLE) AS weight FROM ss a JOIN ss b ON a.session_id = b.session_id AND a.spot <> b.spot")
def session_wiring(spark, d):
    return dynamics.session_wiring(sessions.id_sets(views.sess(spark, d)))


# --- graph --------------------------------------------------------------------------------------------------------


@query("edges_prune_weak", f"WITH {ASSOC} SELECT from_id, to_id, ROUND(weight, 6) AS weight FROM assoc WHERE weight >= 0.15")
def edges_prune_weak(spark, d):
    return graph.prune_weak(views.assoc(spark, d), 0.15).select("from_id", "to_id", r6("weight").alias("weight"))


ORPHAN = """ax AS (SELECT from_id, to_id, weight FROM assoc UNION ALL SELECT doc_id AS from_id, (SELECT COUNT(*) FROM documents) + doc_id AS to_id, CAST(0.5 AS DOUBLE) AS weight FROM documents WHERE doc_id % 100 = 0)"""


@query("edges_prune_orphans", f"WITH {MEM}, {ASSOC}, {ORPHAN} SELECT from_id, to_id, ROUND(weight, 6) AS weight FROM ax WHERE from_id IN (SELECT id FROM mem) AND to_id IN (SELECT id FROM mem)")
def edges_prune_orphans(spark, d):
    return graph.prune_orphans(views.assoc_orphan(spark, d), views.mem(spark, d, vectors=False)).select("from_id", "to_id", r6("weight").alias("weight"))


@query("edges_outbound", f"WITH {MEM}, {ASSOC} SELECT to_id, ROUND(weight, 6) AS weight FROM assoc WHERE from_id = 1 AND to_id IN (SELECT id FROM mem)")
def edges_outbound(spark, d):
    return graph.outbound(views.assoc(spark, d), views.mem(spark, d, vectors=False), 1).select("to_id", r6("weight").alias("weight"))


@query(
    "edges_both",
    f"""WITH {ASSOC} SELECT CASE WHEN from_id = 1 THEN 'outgoing' ELSE 'incoming' END AS direction, CASE WHEN from_id = 1 THEN to_id ELSE from_id END AS other_id, ROUND(weight, 6) AS weight
FROM assoc WHERE from_id = 1 OR to_id = 1""",
)
def edges_both(spark, d):
    return graph.touching(views.assoc(spark, d), 1).select("direction", "other_id", r6("weight").alias("weight"))


@query(
    "edges_labelled",
    f"""WITH {MEM}, {ASSOC}, {ORPHAN} SELECT from_id, to_id, ROUND(weight, 6) AS weight, COALESCE(left(content, 40), '[deleted]') AS label FROM ax LEFT JOIN mem ON id = to_id WHERE weight >= 0.2""",
)
def edges_labelled(spark, d):
    return graph.labelled(views.assoc_orphan(spark, d).where("weight >= 0.2"), views.mem(spark, d, vectors=False)).select("from_id", "to_id", r6("weight").alias("weight"), "label")


@query("graph_nodes", f"WITH {ASSOC} SELECT from_id AS id FROM assoc WHERE weight >= 0.2 UNION SELECT to_id AS id FROM assoc WHERE weight >= 0.2")
def graph_nodes(spark, d):
    return graph.nodes(views.assoc(spark, d), 0.2)


@query(
    "graph_summary",
    f"""WITH {ASSOC} SELECT COUNT(*) AS edges, SUM(CASE WHEN weight >= 0.7 THEN 1 ELSE 0 END)::BIGINT AS strong, SUM(CASE WHEN weight >= 0.4 AND weight < 0.7 THEN 1 ELSE 0 END)::BIGINT AS medium,
  SUM(CASE WHEN weight < 0.4 THEN 1 ELSE 0 END)::BIGINT AS weak, SUM(CASE WHEN co_activation_count > 0 THEN 1 ELSE 0 END)::BIGINT AS hebbian, MAX(co_activation_count) AS max_co_activations,
  SUM(co_activation_count)::BIGINT AS sum_co_activations FROM assoc""",
)
def graph_summary(spark, d):
    return graph.summary(views.assoc(spark, d))


@query("chain_hints", f"WITH {MEM}, {ORD} SELECT from_id AS id, COUNT(*) AS steps FROM ao WHERE from_id IN (SELECT id FROM mem WHERE state = 'active') GROUP BY from_id")
def chain_hints(spark, d):
    return graph.chain_hints(views.mem(spark, d, vectors=False).where("state = 'active'"), views.assoc_ordinal(spark, d))


@query(
    "delete_cascade",
    f"""WITH {MEM}, {ASSOC}, {ENRICH} SELECT (SELECT COUNT(*) FROM mem WHERE id % 10 <> 0) AS memories, (SELECT COUNT(*) FROM assoc WHERE from_id % 10 <> 0 AND to_id % 10 <> 0) AS edges,
  (SELECT COUNT(*) FROM en WHERE memory_id NOT IN (SELECT id FROM mem WHERE id % 10 = 0)) AS enrichments""",
)
def delete_cascade(spark, d):
    m = views.mem(spark, d, vectors=False)
    left, edges, en = graph.delete_cascade(m, views.assoc(spark, d), views.enrich(spark, d), m.where("id % 10 = 0"))
    counts = [f.agg(F.count("*").alias(n)) for f, n in ((left, "memories"), (edges, "edges"), (en, "enrichments"))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])


# --- retrieval ----------------------------------------------------------------------------------------------------


@query(
    "search_minimum_slice",
    f"""WITH {MEM}, {Q0.format(v=0)}, s AS (SELECT id, energy, state, {SIM.format(a='embedding', b='q')} AS score FROM mem, qv WHERE embedding IS NOT NULL)
SELECT id, state, ROUND(score, 6) AS score, ROUND(score + CAST(0.03 AS DOUBLE) * energy, 6) AS blended FROM s WHERE score >= 0.1 AND state IN ('active', 'dormant')
ORDER BY score + CAST(0.03 AS DOUBLE) * energy DESC, id LIMIT 10""",
)
def search_minimum_slice(spark, d):
    m = views.mem(spark, d).where(sc.searchable("state"))
    hits = retrieval.energy_nudge(retrieval.similar(m, views.query_vector(spark, d, 0), 0.1).withColumn("blended", F.col("score")))
    return hits.orderBy(F.desc("blended"), "id").limit(10).select("id", "state", r6("score").alias("score"), r6("blended").alias("blended"))


@query(
    "knn_primary",
    f"WITH {Q0.format(v=0)}, s AS (SELECT vec_id AS id, {SIM.format(a='embedding', b='q')} AS score FROM embeddings, qv) SELECT id, ROUND(score, 6) AS score FROM s WHERE score >= 0.1 ORDER BY s.score DESC, id LIMIT 20",
)
def knn_primary(spark, d):
    return retrieval.knn(views.vectors(spark, d), views.query_vector(spark, d, 0), 20, 0.1).select("id", r6("score").alias("score"))


def _indexed(spark, d):
    """The stored index over all vectors of the memories, their enrichments' among them."""
    rows = views.vectors(spark, d).unionByName(views.enrich(spark, d).select(F.col("memory_id").alias("id"), "embedding"))
    return vector_index.ensure(rows, "multi")


@query(
    "knn_indexed",
    f"""WITH {ENRICH}, {Q0.format(v=1)}, s AS (SELECT vec_id AS id, {SIM.format(a='embedding', b='q')} AS score FROM embeddings, qv UNION ALL
  SELECT memory_id AS id, {SIM.format(a='embedding', b='q')} AS score FROM en, qv), b AS (SELECT id, MAX(score) AS score FROM s WHERE score >= 0.1 GROUP BY id)
SELECT id, ROUND(score, 6) AS score FROM b ORDER BY b.score DESC, id LIMIT 20""",
)
def knn_indexed(spark, d):
    """The rows of knn_multivector, by an index that reads only the cells that can hold one of them."""
    q = views.query_vector(spark, d, 1).first()
    if q is None:
        return views.vectors(spark, d).select("id", F.lit(0.0).alias("score")).where("false")
    found, _ = vector_index.knn(_indexed(spark, d), q.q, 20, 0.1)
    return found.select("id", r6("score").alias("score"))


@query(
    "knn_multivector",
    f"""WITH {ENRICH}, {Q0.format(v=1)}, s AS (SELECT vec_id AS id, {SIM.format(a='embedding', b='q')} AS score FROM embeddings, qv UNION ALL
  SELECT memory_id AS id, {SIM.format(a='embedding', b='q')} AS score FROM en, qv), b AS (SELECT id, MAX(score) AS score FROM s WHERE score >= 0.1 GROUP BY id)
SELECT id, ROUND(score, 6) AS score FROM b ORDER BY b.score DESC, id LIMIT 20""",
)
def knn_multivector(spark, d):
    return retrieval.knn(views.vectors(spark, d), views.query_vector(spark, d, 1), 20, 0.1, views.enrich(spark, d)).select("id", r6("score").alias("score"))


@query(
    "knn_similar_to",
    f"WITH {Q0.format(v=2)}, s AS (SELECT vec_id AS id, {SIM.format(a='embedding', b='q')} AS score FROM embeddings, qv WHERE vec_id <> 2) SELECT id, ROUND(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT 10",
)
def knn_similar_to(spark, d):
    return retrieval.similar_to(views.vectors(spark, d), 2, 10).select("id", r6("score").alias("score"))


TOKENS = f"list_filter(regexp_split_to_array(translate(lower(content), '{tx.ACCENTED}', '{tx.PLAIN}'), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def bm25_sql(terms: list[str], name: str = "bm") -> str:
    """CTEs for the BM25 score of documents that hold all terms."""
    tf = ", ".join(f"CAST(len(list_filter(toks, lambda t: t = '{t}')) AS DOUBLE) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"SUM(CASE WHEN tf{i} > 0 THEN 1 ELSE 0 END) AS df{i}" for i in range(len(terms)))
    part = " + ".join(
        f"(CASE WHEN ln((n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) <= 0 THEN 0.000001::DOUBLE ELSE ln((n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) END) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / al))"
        for i in range(len(terms))
    )
    every = " AND ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""{name}t AS (SELECT id, {TOKENS} AS toks FROM mem), {name}c AS (SELECT id, CAST(len(toks) AS DOUBLE) AS l, {tf} FROM {name}t),
{name}s AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n, AVG(l) AS al, {df} FROM {name}c), {name} AS (SELECT id, {part} AS score FROM {name}c, {name}s WHERE {every})"""


@query("bm25_and", f"WITH {MEM}, {bm25_sql(['rewh', 'the'])} SELECT id, ROUND(score, 6) AS score FROM bm")
def bm25_and(spark, d):
    return postings.bm25(views.keyword_index(spark, d), "Rewh the").select("id", r6("score").alias("score"))


# A phrase's places: where its first token stands and the next follows.
PHRASE = f"""pt AS (SELECT id, {TOKENS} AS toks FROM mem), pc AS (SELECT id, CAST(len(toks) AS DOUBLE) AS l, CAST(len(list_filter(generate_series(1, len(toks) - 1), lambda i: toks[i] = 'of' AND toks[i + 1] = 'the')) AS DOUBLE) AS tf FROM pt),
ps AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n, AVG(l) AS al, CAST(COUNT(*) FILTER (tf > 0) AS DOUBLE) AS df FROM pc)"""


@query(
    "bm25_phrase",
    f"""WITH {MEM}, {PHRASE} SELECT id, ROUND(CASE WHEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) <= 0 THEN 0.000001::DOUBLE ELSE ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) END
  * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / al)), 6) AS score FROM pc, ps WHERE tf > 0""",
)
def bm25_phrase(spark, d):
    return postings.bm25(views.keyword_index(spark, d), "of-the").select("id", r6("score").alias("score"))


@query("keyword_postings", f"WITH {MEM}, t AS (SELECT id, {TOKENS} AS toks FROM mem), u AS (SELECT id, unnest(toks) AS term FROM t) SELECT term, COUNT(DISTINCT id) AS df, COUNT(*) AS cf FROM u GROUP BY term")
def keyword_postings(spark, d):
    """How many documents hold each term of the index, and how often."""
    return views.keyword_index(spark, d).postings.groupBy("term").agg(F.countDistinct("id").alias("df"), F.count("*").alias("cf"))


@query(
    "bm25_batch",
    f"""WITH {MEM}, {bm25_sql(['rewh', 'the'], 'qa')}, {bm25_sql(['thatea'], 'qb')}, {PHRASE} SELECT CAST(0 AS BIGINT) AS query_id, id, ROUND(score, 6) AS score FROM qa
  UNION ALL SELECT CAST(1 AS BIGINT) AS query_id, id, ROUND(score, 6) AS score FROM qb UNION ALL SELECT CAST(2 AS BIGINT) AS query_id, id, ROUND(CASE WHEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) <= 0 THEN 0.000001::DOUBLE
  ELSE ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) END * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / al)), 6) AS score FROM pc, ps WHERE tf > 0""",
)
def bm25_batch(spark, d):
    """Three queries in one pass over the postings of their terms."""
    return postings.bm25_many(views.keyword_index(spark, d), [(0, "rewh the"), (1, "thatea"), (2, "of-the")]).select("query_id", "id", r6("score").alias("score"))


@query("bm25_porter")
def bm25_porter(spark, d):
    return retrieval.bm25_stemmed(views.mem(spark, d, vectors=False), "rewhs thes", 50).select("id", r6("score").alias("score"))


FUSED = f"""WITH {MEM}, {Q0.format(v=0)}, {bm25_sql(['rewh'])},
v AS (SELECT id, ROW_NUMBER() OVER (ORDER BY score DESC, id) AS r FROM (SELECT id, {SIM.format(a='embedding', b='q')} AS score FROM mem, qv WHERE embedding IS NOT NULL) x WHERE score >= 0.1 QUALIFY r <= 30),
w AS (SELECT id, ROW_NUMBER() OVER (ORDER BY ROUND(score, 12) DESC, id) AS r FROM bm QUALIFY r <= 30),
u AS (SELECT id, CAST(1 AS DOUBLE) / (60 + r) AS x FROM v UNION ALL SELECT id, CAST(1 AS DOUBLE) / (60 + r) AS x FROM w)
SELECT id, ROUND(LEAST(CAST(1 AS DOUBLE), SUM(x) / (CAST(2 AS DOUBLE) / 61)), 6) AS score FROM u GROUP BY id"""


@query("rrf_fuse", FUSED)
def rrf_fuse(spark, d):
    m = views.mem(spark, d)
    near = retrieval.knn(m.select("id", "embedding"), views.query_vector(spark, d, 0), 30, 0.1)
    words = postings.bm25(views.keyword_index(spark, d), "rewh", 30, places=12)
    return retrieval.rrf([near, words]).select("id", r6("score").alias("score"))


@query("hybrid_search", FUSED)
def hybrid_search(spark, d):
    out = retrieval.hybrid(views.mem(spark, d), views.query_vector(spark, d, 0), "rewh", 30, 0.1, index=views.keyword_index(spark, d))
    return out.select("id", r6("score").alias("score"))


@query("hybrid_vector_only", f"WITH {MEM}, {Q0.format(v=0)}, s AS (SELECT id, {SIM.format(a='embedding', b='q')} AS score FROM mem, qv WHERE embedding IS NOT NULL) SELECT id, ROUND(score, 6) AS score FROM s WHERE score >= 0.1 ORDER BY s.score DESC, id LIMIT 30")
def hybrid_vector_only(spark, d):
    out = retrieval.hybrid(views.mem(spark, d), views.query_vector(spark, d, 0), "nosuchword", 30, 0.1, index=views.keyword_index(spark, d))
    return out.select("id", r6("score").alias("score"))


@query(
    "variants_max",
    f"""WITH {Q0.format(v=0)}, q1 AS (SELECT embedding AS p FROM embeddings WHERE vec_id = 1), s AS (SELECT vec_id AS id, {SIM.format(a='embedding', b='q')} AS score FROM embeddings, qv
  UNION ALL SELECT vec_id AS id, {SIM.format(a='embedding', b='p')} AS score FROM embeddings, q1) SELECT id, ROUND(MAX(score), 6) AS score FROM s WHERE score >= 0.1 GROUP BY id""",
)
def variants_max(spark, d):
    v = views.vectors(spark, d)
    lists = [retrieval.similar(v, views.query_vector(spark, d, i), 0.1).select("id", "score") for i in (0, 1)]
    return retrieval.best_of(lists).select("id", r6("score").alias("score"))


@query(
    "energy_nudge",
    f"WITH {MEM}, {Q0.format(v=0)} SELECT id, ROUND({SIM.format(a='embedding', b='q')} + CAST(0.03 AS DOUBLE) * energy, 6) AS blended FROM mem, qv WHERE embedding IS NOT NULL",
)
def energy_nudge(spark, d):
    hits = retrieval.similar(views.mem(spark, d), views.query_vector(spark, d, 0)).withColumn("blended", F.col("score"))
    return retrieval.energy_nudge(hits).select("id", r6("blended").alias("blended"))


@query(
    "session_affinity",
    f"""WITH {MEM}, {Q0.format(v=0)}, c AS (SELECT embedding AS z FROM embeddings WHERE vec_id = 5)
SELECT id, ROUND(energy * (1 + CAST(0.3 AS DOUBLE) * CASE WHEN embedding IS NULL THEN 0 ELSE {SIM.format(a='embedding', b='z')} END), 6) AS blended FROM mem, c""",
)
def session_affinity(spark, d):
    centroid = views.query_vector(spark, d, 5).withColumnRenamed("q", "centroid")
    return retrieval.session_affinity(views.mem(spark, d).withColumn("blended", F.col("energy")), centroid).select("id", r6("blended").alias("blended"))


@query(
    "assoc_discovery_1hop",
    f"""WITH {MEM}, {ASSOC}, {Q0.format(v=0)}, e AS (SELECT from_id, to_id, weight FROM assoc WHERE weight >= 0.15 AND from_id < 10 AND to_id >= 10),
f AS (SELECT to_id, weight, ROW_NUMBER() OVER (PARTITION BY to_id ORDER BY from_id) AS rn FROM e)
SELECT id, ROUND({SIM.format(a='embedding', b='q')} * (CAST(0.5 AS DOUBLE) + CAST(0.5 AS DOUBLE) * energy) + CAST(0.1 AS DOUBLE) * weight, 6) AS blended
FROM f JOIN mem ON id = to_id, qv WHERE rn = 1 AND embedding IS NOT NULL""",
)
def assoc_discovery_1hop(spark, d):
    return _discovery(spark, d, 1).select("id", r6("blended").alias("blended"))


def _discovery(spark, d, depth):
    m = views.mem(spark, d)
    seeds = m.where("id < 10").select("id", F.col("id").alias("frontier_rank"))
    return graph.discover(seeds, views.assoc(spark, d).withColumn("edge_seq", F.col("to_id")), m, views.query_vector(spark, d, 0), depth)


@query("assoc_discovery_multihop")
def assoc_discovery_multihop(spark, d):
    return _discovery(spark, d, 3).select("id", "hop", r6("blended").alias("blended"))


@query(
    "jaccard_pairs",
    """WITH t AS (SELECT doc_id AS id, list_distinct(string_split(lang || ' ' || source, ' ')) AS toks FROM documents)
SELECT a.id AS a, b.id AS b, ROUND(CAST(len(list_intersect(a.toks, b.toks)) AS DOUBLE) / len(list_distinct(list_concat(a.toks, b.toks))), 6) AS overlap
FROM t a JOIN t b ON b.id = a.id + 1""",
)
def jaccard_pairs(spark, d):
    t = views.mem(spark, d, vectors=False).select("id", F.array_distinct("tags").alias("toks"))
    b = t.select((F.col("id") - 1).alias("a"), F.col("id").alias("b"), F.col("toks").alias("other"))
    return t.withColumnRenamed("id", "a").join(b, "a").select("a", "b", r6(sc.jaccard("toks", "other")).alias("overlap"))


@query(
    "source_buckets",
    f"""WITH {MEM}, x AS (SELECT created_at, CASE WHEN id % 4 = 0 THEN '[' || upper(source) || '] ' || content ELSE content END AS content FROM mem)
SELECT bucket, COUNT(*) AS n FROM (SELECT CASE WHEN starts_with(content, '[') AND strpos(content, ']') > 2 AND strpos(content, ']') <= 49 THEN lower(left(content, strpos(content, ']')))
  ELSE strftime(make_timestamp(created_at * 1000000), '%Y-%m-%d') END AS bucket FROM x) t GROUP BY bucket""",
)
def source_buckets(spark, d):
    m = views.mem(spark, d, vectors=False)
    text = F.when(F.col("id") % 4 == 0, F.concat(F.lit("["), F.upper("source"), F.lit("] "), F.col("content"))).otherwise(F.col("content"))
    return m.select(sc.source_bucket(text, "created_at").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def _cues_sql(cues):
    return "(" + " OR ".join(f"contains(lower(text), '{c}')" for c in cues) + ")"


@query(
    "query_classes",
    f"""SELECT conv_id, turn, {_cues_sql(sc.COMPOSITE_CUES)} AS composite, {_cues_sql(sc.INFERENTIAL_CUES)} AS inferential,
  CASE WHEN {_cues_sql(sc.COMPOSITE_CUES)} THEN LEAST(GREATEST(10, 15), 30) ELSE 10 END AS effective_limit FROM conversations""",
)
def query_classes(spark, d):
    c = sc.is_composite("text")
    return views.table(spark, d, "conversations").select(
        "conv_id", "turn", c.alias("composite"), sc.is_inferential("text").alias("inferential"), sc.effective_limit(c, F.lit(10)).alias("effective_limit")
    )


@query("diversity_select")
def diversity_select(spark, d):
    hits = retrieval.similar(views.mem(spark, d), views.query_vector(spark, d, 0), 0.1).withColumn("blended", F.col("score"))
    top = hits.orderBy(F.desc("blended"), "id").limit(42).withColumn("query_id", F.lit(0).cast("long")).withColumn("query", F.lit("The rewh and thatea"))
    return retrieval.diversity(top, 10).withColumn("blended", r6("blended"))


def _searched(spark, d, query, vec, query_id, **options):
    m, edges = views.mem(spark, d), views.assoc(spark, d).withColumn("edge_seq", F.col("to_id"))
    o = pipeline.SearchOptions(min_score=0.1, **options)
    return pipeline.search(m, edges, views.query_vector(spark, d, vec), query, query_id, o, index=views.keyword_index(spark, d))


@query(
    "knn_mismatch",
    f"""WITH n AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT t.vec_id AS id, x.label, AVG(list_cosine_similarity(t.v, x.v)) AS m
  FROM n t JOIN n x ON x.vec_id % 5 <> 0 WHERE t.vec_id % 5 = 0 GROUP BY t.vec_id, x.label),
b AS (SELECT * FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY id ORDER BY m DESC, label) = 1)
SELECT b.id, b.label, b.label <> a.label AND b.m - COALESCE(a.m, 0) >= 0.02 AS warned FROM b JOIN (SELECT id, label, m FROM s WHERE label = (SELECT MIN(label) FROM embeddings)) a ON a.id = b.id""",
)
def knn_mismatch(spark, d):
    """Where the class asked for, the same for all here, falls clearly behind the one that is found."""
    v = views.table(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    first = v.agg(F.min("label").alias("label"))
    asked = v.where("id % 5 = 0").select("id").crossJoin(F.broadcast(first))
    found = retrieval.classify(v.where("id % 5 = 0"), v.where("id % 5 <> 0"), asked, 0.02)
    return found.select("id", "label", F.col("warning").isNotNull().alias("warned"))


@query("search_pipeline")
def search_pipeline(spark, d):
    return _searched(spark, d, "what would the rewh be", 0, 0)["result"].withColumn("blended", r6("blended"))


def _turns_asked(spark, d):
    """Every turn of a user as a query, with a vector of the embeddings' table."""
    emb = views.table(spark, d, "embeddings")
    turns = views.table(spark, d, "conversations").where("role = 'user'").crossJoin(F.broadcast(emb.agg(F.count("*").alias("n"))))
    turns = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"), ((F.col("conv_id") * 8 + F.col("turn")) % F.col("n")).alias("at"))
    return turns.join(emb.select(F.col("vec_id").alias("at"), F.col("embedding").alias("q")), "at", "left").select("query_id", "query", "q")


@query("batch_search")
def batch_search(spark, d):
    """All turns of users searched for in one plan."""
    m, edges = views.mem(spark, d), views.assoc(spark, d).withColumn("edge_seq", F.col("to_id"))
    found = many.search_many(m, edges, _turns_asked(spark, d), pipeline.SearchOptions(min_score=0.1), views.keyword_index(spark, d))
    return found.withColumn("blended", r6("blended"))


@query(
    "batch_knn",
    """WITH n AS (SELECT COUNT(*) AS n FROM embeddings),
a AS (SELECT conv_id * 1000 + turn AS query_id, (conv_id * 8 + turn) % n AS spot FROM conversations, n WHERE role = 'user'),
s AS (SELECT a.query_id, e.vec_id AS id, ROUND(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 12) AS score FROM a JOIN embeddings q ON q.vec_id = a.spot, embeddings e)
SELECT query_id, id, ROUND(score, 6) AS score FROM s WHERE score >= 0.1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 30""",
)
def batch_knn(spark, d):
    """The thirty nearest vectors of every user turn's."""
    found = many.knn_many(views.vectors(spark, d), _turns_asked(spark, d), 30, 0.1)
    return found.withColumn("score", r6("score"))


@query(
    "knn_classifier",
    f"""WITH n AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT t.vec_id AS id, x.label, AVG(list_cosine_similarity(t.v, x.v)) AS m
  FROM n t JOIN n x ON x.vec_id % 5 <> 0 WHERE t.vec_id % 5 = 0 GROUP BY t.vec_id, x.label)
SELECT id, label, ROUND(m, 6) AS mean_similarity FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY m DESC, label) AS rn FROM s) t WHERE rn = 1""",
)
def knn_classifier(spark, d):
    v = views.table(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    return retrieval.classify(v.where("id % 5 = 0"), v.where("id % 5 <> 0")).select("id", "label", r6("mean_similarity").alias("mean_similarity"))


# --- sessions -----------------------------------------------------------------------------------------------------


@query(
    "session_query_tail",
    f"""WITH {SESS} SELECT session_id, MAX(n) AS query_count, array_to_string(list(text ORDER BY turn, text), ' / ') AS tail FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY turn DESC, text DESC) AS rn, COUNT(*) OVER (PARTITION BY session_id) AS n FROM ss) z WHERE rn <= 3 GROUP BY session_id""",
)
def session_query_tail(spark, d):
    return sessions.query_tail(views.sess(spark, d), 3).select("session_id", "query_count", F.array_join("queries", " / ").alias("tail"))


@query("session_id_sets", f"WITH {SESS}, f AS (SELECT session_id, spot AS a, MIN(turn) AS t FROM ss GROUP BY session_id, spot) SELECT session_id, array_to_string(list(a ORDER BY t, a), ',') AS ids FROM f GROUP BY session_id")
def session_id_sets(spark, d):
    return sessions.id_sets(views.sess(spark, d)).select("session_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("session_expire", "SELECT conv_id AS session_id, MAX(1700000000 + conv_id * 86400 + turn) AS last_seen_at FROM conversations GROUP BY conv_id HAVING MAX(1700000000 + conv_id * 86400 + turn) >= 1710000000 - 90 * 86400")
def session_expire(spark, d):
    s = views.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("session_id")).agg(F.max(1700000000 + F.col("conv_id") * 86400 + F.col("turn")).alias("last_seen_at"))
    return sessions.unexpired(s, F.lit(1710000000), 90)


@query("recall_replay")
def recall_replay(spark, d):
    log = views.recall_log(spark, d).withColumnRenamed("session_id", "graph")
    return recalls.replay(log).withColumn("energy", r6("energy"))


@query(
    "co_access_windows",
    """SELECT time_bucket(INTERVAL '10 minutes', ts) AS start, (event_id * 7919) % (SELECT COUNT(*) FROM documents) AS mem_id, COUNT(*) AS recalls FROM events WHERE event_type = 'view' GROUP BY ALL""",
)
def co_access_windows(spark, d):
    out = recalls.co_access(views.recall_log(spark, d).withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "mem_id", "recalls")


# --- dates, text, citations ---------------------------------------------------------------------------------------


DAYS = "dd AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)"


def _days(spark, d):
    return views.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()


@query(
    "temporal_weekdays",
    f"""WITH {DAYS} SELECT d, CAST(d - ((isodow(d)::INTEGER - 7 - 1) % 7 + 7) % 7 - 1 AS DATE) AS last_sunday, CAST(d + ((3 - isodow(d)::INTEGER - 1) % 7 + 7) % 7 + 1 AS DATE) AS next_wednesday,
  CAST(d - (isodow(d)::INTEGER - 1) AS DATE) AS week_start, dayname(d) AS day_name FROM dd""",
)
def temporal_weekdays(spark, d):
    x = F.col("d")
    return _days(spark, d).select("d", tm.weekday_before(x, "Sun").alias("last_sunday"), tm.weekday_after(x, "Wed").alias("next_wednesday"), tm.week_start(x).alias("week_start"), F.date_format(x, "EEEE").alias("day_name"))


@query(
    "temporal_months",
    f"""WITH {DAYS} SELECT d, CAST(d - INTERVAL 1 MONTH AS DATE) AS month_ago, CAST(date_trunc('month', d - INTERVAL 1 MONTH) AS DATE) AS first, last_day(CAST(d - INTERVAL 1 MONTH AS DATE)) AS last FROM dd""",
)
def temporal_months(spark, d):
    first, last = tm.month_of(F.col("d"), -1)
    return _days(spark, d).select("d", F.add_months("d", -1).alias("month_ago"), first.alias("first"), last.alias("last"))


@query(
    "temporal_weekends",
    f"""WITH {DAYS} SELECT d, CAST(d - ((isodow(d)::INTEGER - 7 - 1) % 7 + 7) % 7 - 1 - 8 AS DATE) AS two_before, CAST(d + ((6 - isodow(d)::INTEGER - 1) % 7 + 7) % 7 + 1 AS DATE) AS one_after FROM dd""",
)
def temporal_weekends(spark, d):
    return _days(spark, d).select("d", tm.weekend_before(F.col("d"), 2).alias("two_before"), tm.weekend_after(F.col("d")).alias("one_after"))


RESOLVED = {
    "yesterday": ("d - 1", "d - 1", "dayname(d - 1)"),
    "three weeks ago": ("d - 21", "d - 21", "dayname(d - 21)"),
    "last sunday": ("d - ((isodow(d) - 1) % 7 + 1)::INTEGER", "d - ((isodow(d) - 1) % 7 + 1)::INTEGER", "'Sunday'"),
    "next month": ("date_trunc('month', d) + INTERVAL 1 MONTH", "last_day(date_trunc('month', d) + INTERVAL 1 MONTH)", "monthname(date_trunc('month', d) + INTERVAL 1 MONTH) || ' ' || year(date_trunc('month', d) + INTERVAL 1 MONTH)"),
    "the week before": ("d - 7", "d - 1", "NULL"),
    "two weekends before 17 July 2023": ("DATE '2023-07-08'", "DATE '2023-07-09'", "'2 weekends'"),
    "winter of 2022": ("DATE '2022-12-01'", "DATE '2023-02-28'", "'Winter 2022-2023'"),
    "first weekend of August 2023": ("DATE '2023-08-05'", "DATE '2023-08-06'", "'first weekend of August 2023'"),
    "the friday after": ("d + (CASE WHEN isodow(d) < 5 THEN 5 - isodow(d) ELSE 12 - isodow(d) END)::INTEGER", "d + (CASE WHEN isodow(d) < 5 THEN 5 - isodow(d) ELSE 12 - isodow(d) END)::INTEGER", "'Friday'"),
    "last year": ("make_date(year(d) - 1, 1, 1)", "make_date(year(d) - 1, 12, 31)", "CAST(year(d) - 1 AS VARCHAR)"),
    "a month ago": ("d - INTERVAL 1 MONTH", "d - INTERVAL 1 MONTH", "dayname(d - INTERVAL 1 MONTH)"),
}
RESOLVED_SQL = " UNION ALL ".join(f"SELECT d, '{said}' AS expression, CAST({a} AS DATE) AS first, CAST({b} AS DATE) AS last, {c} AS label, NULL AS error FROM dd" for said, (a, b, c) in RESOLVED.items())


@query(
    "temporal_resolver",
    f"""WITH dd AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) {RESOLVED_SQL}
UNION ALL SELECT d, 'no date' AS expression, NULL AS first, NULL AS last, NULL AS label, 'Could not resolve temporal expression ''no date''' AS error FROM dd""",
)
def temporal_resolver(spark, d):
    """Expressions against every day of the orders, in Arrow batches."""
    asked = _days(spark, d).select("d", F.explode(F.array(*map(F.lit, [*RESOLVED, "no date"]))).alias("expression"))
    return tm.resolved(asked, "expression", "d")


@query(
    "parse_timestamps",
    """WITH x AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(epoch(ts)::BIGINT AS VARCHAR) WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 2 THEN strftime(ts, '%Y-%m-%d') ELSE 'not a time' END AS t, ts FROM events)
SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch(date_trunc('second', ts))::BIGINT WHEN 1 THEN epoch(date_trunc('second', ts))::BIGINT WHEN 2 THEN epoch(date_trunc('day', ts))::BIGINT ELSE NULL END AS parsed FROM x""",
)
def parse_timestamps(spark, d):
    ts, k = F.col("ts").cast("timestamp"), F.col("event_id") % 4
    said = (
        F.when(k == 0, F.unix_seconds(ts).cast("string"))
        .when(k == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(k == 2, F.date_format(ts, "yyyy-MM-dd"))
        .otherwise("not a time")
    )
    return views.table(spark, d, "events").select("event_id", sc.parse_epoch(said).alias("parsed"))


@query(
    "strip_date_anchors",
    """SELECT doc_id AS id, trim(replace(regexp_replace(left(text, 60) || ' (2023-12-0' || (doc_id % 9 + 1) || ')' || substr(text, 61) || ' (2024-01-0' || (doc_id % 9 + 1) || ')  and', ' \\(\\d{4}-\\d{2}-\\d{2}\\)', '', 'g'), '  ', ' ')) AS content FROM documents""",
)
def strip_date_anchors(spark, d):
    """The whole of each text, with an anchor within and one behind."""
    day = (F.col("doc_id") % 9 + 1).cast("string")
    inner, behind = F.concat(F.lit(" (2023-12-0"), day, F.lit(")")), F.concat(F.lit(" (2024-01-0"), day, F.lit(")  and"))
    text = F.concat(F.left("text", F.lit(60)), inner, F.expr("substring(text, 61)"), behind)
    return views.table(spark, d, "documents").select(F.col("doc_id").alias("id"), sc.strip_date_anchor(text).alias("content"))


@query(
    "citation_format",
    """SELECT p_partkey AS id, p_brand || '. (' || p_size || '). *' || p_name || '*' || CASE WHEN p_size % 2 = 0 THEN ' (2nd).' ELSE '' END || ' ' || CASE WHEN p_size % 3 = 0 THEN 'https://doi.org/10.1/' || p_partkey ELSE p_type || '.' END AS reference,
  '(' || p_brand || ', ' || p_size || ', ' || CASE WHEN p_size % 2 = 0 THEN 'p. 3' ELSE 'pp. 3-5' END || ')' AS inline FROM part""",
)
def citation_format(spark, d):
    p, size = views.table(spark, d, "part"), F.col("p_size")
    none = F.lit(None).cast("string")
    year = size.cast("string")
    doi = F.when(size % 3 == 0, F.concat(F.lit("10.1/"), F.col("p_partkey").cast("string")))
    ref = sc.citation_reference(F.col("p_brand"), year, F.col("p_name"), F.when(size % 2 == 0, "2nd"), doi, none, F.col("p_type"))
    return p.select(F.col("p_partkey").alias("id"), ref.alias("reference"), sc.citation_inline(F.col("p_brand"), year, F.lit(3), F.when(size % 2 == 0, 3).otherwise(5)).alias("inline"))


@query("title_case", "SELECT p_partkey AS id, array_to_string(list_transform(string_split(lower(p_type || ' OF THE ' || p_name), ' '), lambda w: CASE WHEN w IN ('to','the','in','as','of','and','or') THEN w ELSE upper(left(w, 1)) || substr(w, 2) END), ' ') AS title FROM part")
def title_case(spark, d):
    return views.table(spark, d, "part").select(F.col("p_partkey").alias("id"), sc.title_case(F.concat("p_type", F.lit(" OF THE "), "p_name")).alias("title"))


@query("sanitized_names", "SELECT page_id AS id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^(https://|http://)', ''), '[:?&#/]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') || '.pdf' AS name FROM pages")
def sanitized_names(spark, d):
    return views.table(spark, d, "pages").select(F.col("page_id").alias("id"), sc.sanitized_name("url").alias("name"))


@query(
    "uuid_literals",
    """SELECT doc_id AS id, doc_id % 5 IN (0, 4) AS is_uuid FROM documents""",
)
def uuid_literals(spark, d):
    """Literals that are one, in lower and in upper case, and that lack dashes, hold another letter or go on."""
    h, k = F.md5(F.concat("source", "lang")), F.col("doc_id") % 5
    text = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    said = F.when(k == 1, h).when(k == 2, F.concat(F.lit("g"), F.substring(text, 2, 40))).when(k == 3, F.concat(text, F.lit("0"))).when(k == 4, F.upper(text)).otherwise(text)
    return views.table(spark, d, "documents").select(F.col("doc_id").alias("id"), sc.is_uuid(said).alias("is_uuid"))


# --- documents ----------------------------------------------------------------------------------------------------


def _sources(spark, d):
    """Documents as sources: lines as pages, with a code after every first line."""
    t = views.table(spark, d, "documents")
    return t.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("source"), F.regexp_replace("text", "\n", "\f").alias("text"))


@query(
    "doc_pages",
    """WITH x AS (SELECT 'doc' || doc_id AS source, string_split(regexp_replace(replace(text, chr(10), chr(12)), '[ \\t]+', ' ', 'g'), chr(12)) AS p FROM documents),
y AS (SELECT source, unnest(p) AS content, generate_subscripts(p, 1) AS page_number FROM x) SELECT source, CAST(page_number AS INTEGER) AS page_number, trim(content) AS content FROM y WHERE trim(content) <> ''""",
)
def doc_pages(spark, d):
    """Lines as pages; a document of one line is one page."""
    return documents.pages(_sources(spark, d)).withColumn("page_number", F.col("page_number").cast("int"))


@query("doc_pages_whole")
def doc_pages_whole(spark, d):
    """Pages of all documents: those of even ids have lines as pages, those of odd ids lines as paragraphs, to be packed."""
    t = views.table(spark, d, "documents")
    text = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\f"))).otherwise(F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return documents.pages(t.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("source"), text.alias("text")))


@query("doc_codes", "SELECT doc_id AS id, array_to_string(regexp_extract_all('F' || (10 + doc_id % 80) || '.' || (doc_id % 10) || ' and F' || (doc_id % 90 + 10) || ' ' || text, 'F\\d{2}(?:\\.\\d{1,2})?'), ',') AS codes FROM documents")
def doc_codes(spark, d):
    i = F.col("doc_id")
    text = F.concat(F.lit("F"), (10 + i % 80).cast("string"), F.lit("."), (i % 10).cast("string"), F.lit(" and F"), (i % 90 + 10).cast("string"), F.lit(" "), F.col("text"))
    return views.table(spark, d, "documents").select(i.alias("id"), F.array_join(documents.codes(text), ",").alias("codes"))


def _manual(spark, d):
    """A manual per source: a page per document, each an entry with two sub-sections."""
    i = F.col("doc_id")
    entry = F.concat(F.lit("Sample "), F.initcap("lang"), F.lit(" Disorder\nDiagnostic Criteria\nF"), (10 + i % 80).cast("string"), F.lit(" "), F.regexp_replace("text", "\n", " "), F.lit("\nComorbidity\nnone"))
    return views.table(spark, d, "documents").select(F.concat(F.lit("dsm5-"), F.col("source")).alias("source"), (i + 1).cast("int").alias("page_number"), entry.alias("content"))


@query(
    "doc_sections",
    """WITH p AS (SELECT 'dsm5-' || source AS source, doc_id + 1 AS page, COALESCE(LEAD(doc_id + 1) OVER w, doc_id + 1) AS following, ROW_NUMBER() OVER w AS k, 'Sample ' || upper(left(lang, 1)) || substr(lang, 2) || ' Disorder' AS title,
  CAST(len(regexp_extract_all('F' || (10 + doc_id % 80) || ' ' || replace(text, chr(10), ' '), 'F\\d{2}(?:\\.\\d{1,2})?')) AS INTEGER) AS n_codes FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))
SELECT source, 3 * k - 2 AS rowid, 'dsm5tr' AS profile, title, NULL AS parent, CAST(page AS INTEGER) AS page_start, CAST(following AS INTEGER) AS page_end, 'disorder' AS section_type, n_codes FROM p
UNION ALL SELECT source, 3 * k - 1 AS rowid, 'dsm5tr' AS profile, title || ' - Diagnostic Criteria' AS title, title AS parent, CAST(page AS INTEGER) AS page_start, CAST(page AS INTEGER) AS page_end, 'diagnostic_criteria' AS section_type, n_codes FROM p
UNION ALL SELECT source, 3 * k AS rowid, 'dsm5tr' AS profile, title || ' - Comorbidity' AS title, title AS parent, CAST(page AS INTEGER) AS page_start, CAST(following AS INTEGER) AS page_end, 'comorbidity' AS section_type, n_codes FROM p""",
)
def doc_sections(spark, d):
    return documents.index(_manual(spark, d)).select("source", "rowid", "profile", "title", "parent", "page_start", "page_end", "section_type", F.size("codes").alias("n_codes"))


@query("doc_titles", "SELECT DISTINCT 'Sample ' || upper(left(lang, 1)) || substr(lang, 2) || ' Disorder' AS title FROM documents")
def doc_titles(spark, d):
    return documents.index(_manual(spark, d)).where("parent is null").select("title").distinct()


@query("doc_search")
def doc_search(spark, d):
    pages = section_index.ensure(documents.pages(_sources(spark, d)), "pages", made=documents.index)
    return documents.search(pages, 'the AND rewh NOT "of the"', 20).withColumn("score", r6("score"))


# --- identity -----------------------------------------------------------------------------------------------------

# An identity for each conversation, an item for each of its turns, as the present layout would hold it.
ITEMS = """it AS (
  SELECT conv_id AS owner, lpad(CAST(turn AS VARCHAR), 8, '0') AS id, k AS item_type, CASE WHEN k = 'relationship' THEN role ELSE text END AS content,
    CASE WHEN k = 'relationship' THEN text WHEN turn % 2 = 0 THEN role END AS secondary, CASE WHEN k = 'rule' THEN role END AS tertiary,
    CASE WHEN k = 'rule' THEN CASE WHEN conv_id % 2 = 0 THEN 'negative' END WHEN turn % 3 > 0 THEN 'c' || conv_id % 5 END AS category, turn AS created_at
  FROM (SELECT *, ['persona_name', 'persona_description', 'value', 'preference', 'relationship', 'rule'][((conv_id + turn) % 6) + 1] AS k FROM conversations))"""
OWNER = ("owner",)


def _items(spark, d):
    turn, conv, role, text = F.col("turn"), F.col("conv_id"), F.col("role"), F.col("text")
    kind = F.array(*map(F.lit, identity.TYPES))[((conv + turn) % len(identity.TYPES)).cast("int")]
    related, rule = kind == "relationship", kind == "rule"
    return views.table(spark, d, "conversations").select(
        conv.alias("owner"),
        F.lpad(turn.cast("string"), 8, "0").alias("id"),
        kind.alias("item_type"),
        F.when(related, role).otherwise(text).alias("content"),
        F.when(related, text).when(turn % 2 == 0, role).alias("secondary"),
        F.when(rule, role).alias("tertiary"),
        F.when(rule, F.when(conv % 2 == 0, "negative")).when(turn % 3 > 0, F.concat(F.lit("c"), (conv % 5).cast("string"))).alias("category"),
        turn.alias("created_at"),
    )


@query(
    "identity_search",
    f"""WITH {ITEMS} SELECT owner, id, item_type FROM it WHERE item_type NOT LIKE 'persona%'
  AND (contains(lower(content), 'es ') OR contains(lower(COALESCE(secondary, '')), 'es ') OR contains(lower(COALESCE(tertiary, '')), 'es ') OR contains(lower(COALESCE(category, '')), 'es '))""",
)
def identity_search(spark, d):
    return identity.search(_items(spark, d), "ES ").select("owner", "id", "item_type")


@query("identity_categories", f"WITH {ITEMS} SELECT DISTINCT owner, category FROM it WHERE item_type IN ('value', 'preference') AND category IS NOT NULL")
def identity_categories(spark, d):
    return identity.categories(_items(spark, d), OWNER)


@query("identity_by_type", f"WITH {ITEMS} SELECT owner, id, content, created_at FROM it WHERE item_type = 'value'")
def identity_by_type(spark, d):
    return identity.by_type(_items(spark, d), "value").select("owner", "id", "content", "created_at")


@query(
    "identity_relationship",
    f"""WITH {ITEMS} SELECT owner, id, content, secondary FROM it WHERE item_type = 'relationship' AND lower(content) = 'user'
QUALIFY row_number() OVER (PARTITION BY owner ORDER BY created_at, id) = 1""",
)
def identity_relationship(spark, d):
    """Of each owner, the first relationship with an entity."""
    return identity.relationship(_items(spark, d), "USER", OWNER).select("owner", "id", "content", "secondary")


# --- mutations ----------------------------------------------------------------------------------------------------


@query(
    "upsert_memories",
    f"""WITH {MEM} SELECT id, energy FROM mem WHERE id % 7 <> 0 UNION ALL SELECT id, CAST(0.5 AS DOUBLE) AS energy FROM mem WHERE id % 7 = 0 UNION ALL SELECT id + (SELECT COUNT(*) FROM documents) AS id, CAST(1 AS DOUBLE) AS energy FROM mem WHERE id < 5""",
)
def upsert_memories(spark, d):
    m = views.mem(spark, d, vectors=False).select("id", "energy")
    n = m.agg(F.count("*").alias("n"))
    fresh = m.where("id < 5").crossJoin(F.broadcast(n)).select((F.col("id") + F.col("n")).alias("id"), F.lit(1.0).alias("energy"))
    return store.upsert(m, m.where("id % 7 = 0").withColumn("energy", F.lit(0.5)).unionByName(fresh), ["id"])


@query("sync_missing", f"WITH {MEM} SELECT id, CASE WHEN id % 2 = 0 THEN energy ELSE CAST(-1 AS DOUBLE) END AS energy FROM mem")
def sync_missing(spark, d):
    m = views.mem(spark, d, vectors=False).select("id", "energy")
    return store.sync_missing(m.where("id % 2 = 0"), m.withColumn("energy", F.lit(-1.0)), ["id"])


@query("update_energy", f"WITH {MEM} SELECT id, CASE WHEN id % 5 = 0 THEN CAST(0.05 AS DOUBLE) ELSE energy END AS energy, CASE WHEN id % 5 = 0 THEN 'deep' ELSE state END AS state, access_count FROM mem")
def update_energy(spark, d):
    m = views.mem(spark, d, vectors=False)
    new = m.where("id % 5 = 0").select("id", F.lit(0.05).alias("energy"), F.lit("deep").alias("state"))
    return store.update_energy(m, new).select("id", "energy", "state", "access_count")


@query("replace_enrichments", f"WITH {ENRICH} SELECT memory_id, seq FROM en WHERE memory_id % 4 <> 0 UNION ALL SELECT vec_id AS memory_id, 0 AS seq FROM embeddings WHERE vec_id % 4 = 0")
def replace_enrichments(spark, d):
    new = views.table(spark, d, "embeddings").where("vec_id % 4 = 0").select(F.col("vec_id").alias("memory_id"), F.array("embedding").alias("vectors"))
    return store.replace_enrichments(views.enrich(spark, d), new).select("memory_id", "seq")
