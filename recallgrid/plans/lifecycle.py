"""Queries over what is written: memories, edges, sessions, metadata, identity, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallgrid.functions import scalars as sc
from recallgrid.operators import dynamics, embedding, export, graph, identity, sessions, store
from recallgrid.plans import pipeline
from recallgrid.plans.catalog import ASSOC, COLS, ENRICH, ITEMS, MEM, OWNER, SESS, _items, plain, r6
from recallgrid.plans.reading import PREFIX_SQL
from recallgrid.plans.registry import query
from recallgrid.sources import views

STATE_SQL = "CASE WHEN {e} >= 0.3 THEN 'active' WHEN {e} >= 0.1 THEN 'dormant' WHEN {e} >= 0.02 THEN 'deep' ELSE 'archived' END"


def _sum(vector):
    """A vector as two numbers: its components and their sum."""
    return [F.size(vector).alias("dims"), r6(F.aggregate(F.transform(vector, lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)).alias("total")]


SUM_SQL = "CAST(len({v}) AS INTEGER) AS dims, ROUND(list_sum(CAST({v} AS DOUBLE[])), 6) AS total"


# --- memories -------------------------------------------------------------------------------------------------


@query("tags_rules", f"WITH {MEM} SELECT id, true AS all_of_none, false AS any_of_none, lang = 'en' AND source = 'src3' AS all_of, lang = 'en' OR source = 'src3' AS any_of FROM mem")
def tags_rules(spark, d):
    """Every memory against lists of tags: all of an empty list holds, any of an empty list doesn't."""
    m = views.mem(spark, d, vectors=False)
    every = lambda tags: F.size(F.array_except(F.array(*map(F.lit, tags)).cast("array<string>"), "tags")) == 0
    some = lambda tags: F.arrays_overlap(F.array(*map(F.lit, tags)).cast("array<string>"), F.col("tags"))
    return m.select("id", every([]).alias("all_of_none"), some([]).alias("any_of_none"), every(["en", "src3"]).alias("all_of"), some(["en", "src3"]).alias("any_of"))


@query("tag_count", f"WITH {MEM}, t AS (SELECT lang AS tag FROM mem UNION ALL SELECT source AS tag FROM mem), c AS (SELECT tag, COUNT(*) AS n FROM t WHERE lower(tag) = 'src3' GROUP BY tag) SELECT tag, n FROM c ORDER BY tag <> 'SRC3', tag LIMIT 1")
def tag_count(spark, d):
    """One tag's count, whatever its case: the tag as it is asked for if there is one, else the least."""
    each = views.mem(spark, d, vectors=False).select(F.explode("tags").alias("tag")).where("lower(tag) = 'src3'")
    return each.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.col("tag") != "SRC3", "tag").limit(1)


@query("dashboard_states", f"WITH {MEM}, t AS (SELECT * FROM mem WHERE contains(lower(content), 'the') AND state IN ('active', 'dormant') ORDER BY energy DESC, id LIMIT 600) SELECT id, state FROM t WHERE state = 'dormant'")
def dashboard_states(spark, d):
    """A dashboard's text search, whose state filter comes after the limit."""
    m = views.mem(spark, d)
    return pipeline.dashboard(m, "the", None, 600, state="Dormant").join(m.select("id", "state"), "id").select("id", "state")


@query("dashboard_unknown_state", f"WITH {MEM} SELECT {COLS} FROM mem WHERE false")
def dashboard_unknown_state(spark, d):
    return plain(pipeline.listed(views.mem(spark, d, vectors=False), 20, state="sleeping"))


@query(
    "dashboard_page",
    f"WITH {MEM}, t AS (SELECT COUNT(*) AS total_filtered FROM mem WHERE state = 'active') SELECT {COLS}, total_filtered, total_filtered > 50 AS has_more FROM mem, t WHERE state = 'active' ORDER BY last_accessed DESC, id LIMIT 20 OFFSET 30",
)
def dashboard_page(spark, d):
    return plain(pipeline.listed(views.mem(spark, d, vectors=False), 20, 30, "ACTIVE"), "total_filtered", "has_more")


@query("dashboard_by_id", f"WITH {MEM}, u AS (SELECT md5(CAST(id AS VARCHAR)) AS h, id, state FROM mem) SELECT id AS memory, state, 'id' AS method FROM u WHERE h = md5('7')")
def dashboard_by_id(spark, d):
    """A query that is an id finds that memory, whatever its state and case."""
    h = F.md5(F.col("id").cast("string"))
    key = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    m = views.mem(spark, d, vectors=False).withColumn("memory", F.col("id")).withColumn("id", key)
    return pipeline.dashboard(m, "8F14E45F-CEEA-167A-5A36-DEDD4BEA2543", None).join(m.select("id", "memory", "state"), "id").select("memory", "state", "method")


@query(
    "upsert_cascade",
    f"""WITH {MEM}, {ENRICH} SELECT id, embedding IS NOT NULL AS has_embedding, energy, (SELECT COUNT(*) FROM en WHERE memory_id = id AND memory_id % 3 <> 0) AS enrichments FROM mem WHERE id % 3 <> 0
UNION ALL SELECT id, false AS has_embedding, CAST(0.5 AS DOUBLE) AS energy, 0 AS enrichments FROM mem WHERE id % 3 = 0""",
)
def upsert_cascade(spark, d):
    """Rewritten memories without a vector lose theirs, and their enrichments."""
    m = views.mem(spark, d).select("id", "energy", "embedding")
    new = store.without_vectors(m.where("id % 3 = 0").withColumn("energy", F.lit(0.5)))
    left, more = store.upsert_cascade(m, views.enrich(spark, d), new)
    n = more.groupBy(F.col("memory_id").alias("id")).agg(F.count("*").alias("n"))
    return left.join(n, "id", "left").select("id", F.col("embedding").isNotNull().alias("has_embedding"), "energy", F.coalesce("n", F.lit(0).cast("long")).alias("enrichments"))


@query("set_embeddings", f"WITH {MEM} SELECT m.id, {SUM_SQL.format(v='CASE WHEN m.id % 3 = 0 THEN e.embedding ELSE m.embedding END')} FROM mem m LEFT JOIN embeddings e ON e.vec_id = (m.id + 1) % (SELECT COUNT(*) FROM embeddings)")
def set_embeddings(spark, d):
    m, vec = views.mem(spark, d).select("id", "embedding"), views.vectors(spark, d)
    n = vec.agg(F.count("*").alias("n"))
    at = m.where("id % 3 = 0").crossJoin(F.broadcast(n)).select("id", ((F.col("id") + 1) % F.col("n")).alias("at"))
    new = at.join(vec.select(F.col("id").alias("at"), "embedding"), "at").select("id", "embedding")
    out = store.set_embeddings(m, new).withColumn("embedding", F.col("embedding"))
    return out.select("id", *[F.when(F.col("embedding").isNotNull(), c).alias(name) for c, name in zip(_sum("embedding"), ("dims", "total"), strict=True)])


@query("embedding_of", f"WITH {MEM} SELECT id, {SUM_SQL.format(v='embedding')} FROM mem WHERE id = 7 AND len(embedding) = 64")
def embedding_of(spark, d):
    m = views.mem(spark, d)
    return store.embedding_of(m, 7, 64).unionByName(store.embedding_of(m, 8, 2048)).select("id", *_sum("embedding"))


@query("clear_vectors", f"WITH {MEM}, {ENRICH}, {SESS} SELECT (SELECT COUNT(embedding) FROM mem) AS embeddings, (SELECT COUNT(*) FROM en) AS enrichments, (SELECT COUNT(DISTINCT session_id) FROM ss) AS sessions, 0 AS embeddings_left, 0 AS enrichments_left, 0 AS sessions_left")
def clear_vectors(spark, d):
    """How much a change of model clears, and what is left after it."""
    all_sessions = views.sess(spark, d).select("session_id").distinct()
    m, e, s, counts = store.cleared(views.mem(spark, d).select("id", "embedding"), views.enrich(spark, d), all_sessions)
    left = store.cleared(m, e, s)[3].toDF("embeddings_left", "enrichments_left", "sessions_left")
    return counts.crossJoin(left)


@query("drop_enrichments", f"WITH {ENRICH} SELECT memory_id, seq FROM en WHERE memory_id <> 7")
def drop_enrichments(spark, d):
    return store.without_enrichments(views.enrich(spark, d), 7).select("memory_id", "seq")


@query(
    "create_memories",
    f"""WITH {MEM} SELECT 'm' || id AS key, content, energy, state, created_at, last_accessed, access_count, CAST(2 AS INTEGER) AS n_tags FROM mem
UNION ALL SELECT 'c' || conv_id || '-' || turn AS key, text AS content, CAST(1 AS DOUBLE) AS energy, 'active' AS state, CASE WHEN turn % 2 = 0 THEN 1700000000 + conv_id ELSE 1800000000 END AS created_at,
  CASE WHEN turn % 2 = 0 THEN 1700000000 + conv_id ELSE 1800000000 END AS last_accessed, 0 AS access_count, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS n_tags FROM conversations""",
)
def create_memories(spark, d):
    """Every turn of the conversations kept as a memory: those of even turns at a time of their own, users' with a tag."""
    m = views.mem(spark, d).withColumn("id", F.concat(F.lit("m"), F.col("id").cast("string"))).drop("lang", "source")
    turns = views.table(spark, d, "conversations").select(
        "conv_id",
        "turn",
        F.col("text").alias("content"),
        F.when(F.col("turn") % 2 == 0, 1700000000 + F.col("conv_id")).alias("created_at"),
        F.when(F.col("role") == "user", F.array("role")).alias("tags"),
    )
    key = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    out = store.create(m, turns, F.lit(1800000000), key)
    return out.select(F.col("id").alias("key"), "content", "energy", "state", "created_at", "last_accessed", "access_count", F.size("tags").alias("n_tags"))


@query(
    "sync_gated",
    f"""WITH {MEM}, {ASSOC} SELECT 'opened' AS run, (SELECT COUNT(*) FROM mem) AS memories, (SELECT COUNT(*) FROM assoc) AS edges
UNION ALL SELECT 'closed' AS run, (SELECT COUNT(*) FROM mem) AS memories, (SELECT COUNT(*) FROM assoc WHERE from_id % 2 = 0) AS edges""",
)
def sync_gated(spark, d):
    """What is missing comes over only if the store has more memories: here it has, and then as many."""
    m, e = views.mem(spark, d, vectors=False).select("id"), views.assoc(spark, d).select("from_id", "to_id")
    n = lambda x, name: x.agg(F.count("*").alias(name))
    out = None
    for run, here in (("opened", m.where("id % 2 = 0")), ("closed", m)):
        a, b = store.sync_from(here, e.where("from_id % 2 = 0"), m, e)
        row = n(a, "memories").crossJoin(n(b, "edges")).select(F.lit(run).alias("run"), "memories", "edges")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "dedup_copy",
    f"""WITH {MEM}, {ASSOC}, s AS (SELECT from_id, to_id, weight FROM assoc UNION ALL SELECT from_id, to_id, CAST(0.01 AS DOUBLE) AS weight FROM assoc WHERE from_id % 3 = 0 UNION ALL SELECT from_id + 100000000 AS from_id, to_id, weight FROM assoc)
SELECT from_id, to_id, ROUND(CASE WHEN from_id % 2 = 0 THEN CAST(0.5 AS DOUBLE) ELSE MIN(weight) END, 6) AS weight FROM s WHERE from_id IN (SELECT id FROM mem) GROUP BY from_id, to_id""",
)
def dedup_copy(spark, d):
    """Edges copied to a table that holds some: not those whose memory is gone, not those that are there, each once."""
    e = views.assoc(spark, d).select("from_id", "to_id", "weight")
    more = e.where("from_id % 3 = 0").withColumn("weight", F.lit(0.01)).unionByName(e.withColumn("from_id", F.col("from_id") + 100000000))
    target = e.where("from_id % 2 = 0").withColumn("weight", F.lit(0.5))
    return store.dedup_copy(target, e.unionByName(more), views.mem(spark, d, vectors=False), ["from_id", "to_id"], "from_id").withColumn("weight", r6("weight"))


@query("prune_weak_count", f"WITH {ASSOC} SELECT SUM(CASE WHEN weight >= 0.15 THEN 1 ELSE 0 END)::BIGINT AS kept, SUM(CASE WHEN weight < 0.15 THEN 1 ELSE 0 END)::BIGINT AS pruned FROM assoc")
def prune_weak_count(spark, d):
    return graph.pruned_counts(views.assoc(spark, d), 0.15)


# --- metadata and decay ----------------------------------------------------------------------------------------


@query("metadata_table", "SELECT n_name AS key, CASE WHEN n_name = 'NATION_3' THEN 'moved' ELSE CAST(n_regionkey AS VARCHAR) END AS value FROM nation UNION ALL SELECT 'last_decay_at' AS key, '1700086400' AS value")
def metadata_table(spark, d):
    """A key that is there is overwritten, one that isn't is added."""
    rows = views.table(spark, d, "nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    return store.put_metadata(store.put_metadata(rows, "NATION_3", "moved"), "last_decay_at", "1700086400")


@query("metadata_lookup", "SELECT CAST(n_regionkey AS VARCHAR) AS value FROM nation WHERE n_name = 'NATION_7'")
def metadata_lookup(spark, d):
    rows = views.table(spark, d, "nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    return store.get_metadata(rows, "NATION_7").unionByName(store.get_metadata(rows, "no such key"))


def _decayed_sql(hours: float) -> str:
    amount = f"(CAST(0.05 AS DOUBLE) * (CAST({hours} AS DOUBLE) / CAST(24 AS DOUBLE)))"
    return f"CASE state WHEN 'archived' THEN energy WHEN 'deep' THEN GREATEST(energy - {amount} * CAST(0.25 AS DOUBLE), CAST(0.001 AS DOUBLE)) ELSE GREATEST(energy - {amount}, CAST(0.001 AS DOUBLE)) END"


@query(
    "decay_opened",
    f"""WITH {MEM} SELECT 'first' AS run, id, ROUND({_decayed_sql(24)}, 6) AS energy, CAST(1700500000 AS BIGINT) AS last_decay_at FROM mem
UNION ALL SELECT 'early' AS run, id, ROUND(energy, 6) AS energy, CAST(1700499000 AS BIGINT) AS last_decay_at FROM mem
UNION ALL SELECT 'late' AS run, id, ROUND({_decayed_sql(72)}, 6) AS energy, CAST(1700500000 AS BIGINT) AS last_decay_at FROM mem""",
)
def decay_opened(spark, d):
    """A store that was never decayed counts as decayed a day ago; before an hour has passed nothing happens, not even a note."""
    m, e, out = views.mem(spark, d, vectors=False), views.assoc(spark, d), None
    for run, last in (("first", None), ("early", 1700500000 - 1000), ("late", 1700500000 - 72 * 3600)):
        left, _, at = dynamics.decay_since(m, e, last, 1700500000)
        row = left.select(F.lit(run).alias("run"), "id", r6("energy").alias("energy"), F.lit(at).cast("long").alias("last_decay_at"))
        out = row if out is None else out.unionByName(row)
    return out


# --- sessions ---------------------------------------------------------------------------------------------------


@query(
    "session_upsert",
    "WITH s AS (SELECT conv_id AS session_id, COUNT(*) AS n, MAX(turn) AS last FROM conversations GROUP BY conv_id) SELECT session_id, CASE WHEN session_id % 2 = 0 THEN CAST(0 AS BIGINT) ELSE n END AS n, CAST(last AS BIGINT) AS last FROM s UNION ALL SELECT -1 AS session_id, CAST(1 AS BIGINT) AS n, CAST(9 AS BIGINT) AS last",
)
def session_upsert(spark, d):
    have = views.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("session_id")).agg(F.count("*").alias("n"), F.max("turn").cast("long").alias("last"))
    new = have.where("session_id % 2 = 0").withColumn("n", F.lit(0).cast("long")).unionByName(spark.createDataFrame([(-1, 1, 9)], "session_id long, n long, last long"))
    return sessions.upserted(have, new)


@query("session_parsed", "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN CAST(2 AS INTEGER) ELSE CAST(0 AS INTEGER) END AS n, CASE turn % 3 WHEN 0 THEN text END AS first FROM conversations")
def session_parsed(spark, d):
    """Stored lists of queries: one that can be read, one that can't, and none at all."""
    t = views.table(spark, d, "conversations")
    k = F.col("turn") % 3
    stored = F.when(k == 0, F.to_json(F.array("text", "role"))).when(k == 1, F.concat(F.lit("[broken "), F.col("text")))
    out = sessions.parsed(t.select("conv_id", "turn", stored.alias("queries")))
    return out.select("conv_id", "turn", F.size("queries").alias("n"), F.get("queries", F.lit(0)).alias("first"))


def _events(spark, d):
    """Searches, creations and recalls from the event stream: views search, purchases create, clicks recall."""
    m = views.table(spark, d, "documents").agg(F.count("*").alias("n"))
    e = views.table(spark, d, "events").crossJoin(F.broadcast(m)).select(F.col("user_id").alias("session_id"), F.col("ts").alias("at"), "event_id", "event_type", ((F.col("event_id") * 7919) % F.col("n")).alias("memory_id"))
    return (e.where(F.col("event_type") == kind) for kind in ("view", "purchase", "click"))


EVENTS_SQL = "ev AS (SELECT user_id AS session_id, ts AS tm, event_id, event_type, (event_id * 7919) % (SELECT COUNT(*) FROM documents) AS memory_id FROM events)"


@query(
    "session_signals",
    f"""WITH {MEM}, {EVENTS_SQL}, sg AS (SELECT session_id, tm, 1 AS rank, 'search' AS kind, event_id FROM ev WHERE event_type = 'view'
  UNION ALL SELECT e.session_id, e.tm, 0 AS rank, CASE e.event_type WHEN 'purchase' THEN 'create' ELSE 'recall' END AS kind, e.event_id FROM ev e JOIN mem m ON m.id = e.memory_id AND m.embedding IS NOT NULL WHERE e.event_type IN ('purchase', 'click'))
SELECT v.event_id AS search_id, COUNT(s.session_id) AS n_before, COUNT(CASE WHEN s.kind = 'create' THEN 1 END) AS n_create, COUNT(CASE WHEN s.kind = 'recall' THEN 1 END) AS n_recall
FROM ev v JOIN sg s ON s.session_id = v.session_id AND (s.tm < v.tm OR (s.tm = v.tm AND s.rank = 0)) WHERE v.event_type = 'view' GROUP BY v.event_id""",
)
def session_signals(spark, d):
    """What moved a session's centroid before each search: earlier searches, creations and recalls, never the search itself."""
    searched, created, recalled = _events(spark, d)
    none = F.lit(None).cast("array<float>")
    asked = searched.select("session_id", "at", F.col("event_id").cast("string").alias("text"), none.alias("embedding"), F.col("event_id").alias("search_id"))
    told = sessions.signals(asked, created, recalled, views.mem(spark, d).select("id", "embedding"))
    return sessions.before_each(told, asked).where("n_before > 0").select("search_id", "n_before", "n_create", "n_recall")


@query(
    "session_touched",
    f"""WITH {MEM}, {EVENTS_SQL}, sg AS (SELECT session_id, tm, 'search' AS kind, NULL AS memory_id FROM ev WHERE event_type = 'view'
  UNION ALL SELECT e.session_id, e.tm, CASE e.event_type WHEN 'purchase' THEN 'create' ELSE 'recall' END AS kind, e.memory_id FROM ev e JOIN mem m ON m.id = e.memory_id AND m.embedding IS NOT NULL WHERE e.event_type IN ('purchase', 'click'))
SELECT session_id, MAX(tm) AS last_seen_at, COUNT(CASE WHEN kind = 'search' THEN 1 END) AS n_search, COUNT(CASE WHEN kind = 'create' THEN 1 END) AS n_create, COUNT(CASE WHEN kind = 'recall' THEN 1 END) AS n_recall, COUNT(DISTINCT memory_id) AS n_ids FROM sg GROUP BY session_id""",
)
def session_touched(spark, d):
    searched, created, recalled = _events(spark, d)
    asked = searched.select("session_id", "at", F.lit("").alias("text"), F.lit(None).cast("array<float>").alias("embedding"))
    told = sessions.signals(asked, created, recalled, views.mem(spark, d).select("id", "embedding"))
    return sessions.touched(told).withColumn("n_ids", F.size("ids").cast("long")).drop("ids")


@query(
    "access_log",
    f"""WITH {EVENTS_SQL}, o AS (SELECT *, LAG(event_type) OVER w AS last_type, LAG(event_id) OVER w AS last_id FROM ev WHERE event_type IN ('view', 'click')
  WINDOW w AS (PARTITION BY session_id ORDER BY tm, event_type = 'click', event_id)) SELECT session_id, last_id AS search_id, last_id % 7 AS result_ids, event_id AS recall_id, memory_id AS recalled FROM o WHERE event_type = 'click' AND last_type = 'view'""",
)
def access_log(spark, d):
    searched, _, recalled = _events(spark, d)
    asked = searched.select("session_id", "at", F.col("event_id").alias("search_id"), (F.col("event_id") % 7).alias("result_ids"))
    return sessions.access_log(asked, recalled.select("session_id", "at", F.col("event_id").alias("recall_id"), F.col("memory_id").alias("recalled")))


# --- embedding ---------------------------------------------------------------------------------------------------


class LetterEmbedder:
    """Counts of the 26 letters, brought to unit length: an embedder that SQL can state."""

    dims = 26

    def embed(self, texts):
        return [embedding.normalised([float(t.lower().count(c)) for c in "abcdefghijklmnopqrstuvwxyz"]) for t in texts]


@query(
    "embedding_backfill",
    f"""WITH {MEM}, c AS (SELECT id, embedding, list_transform(range(26), lambda i: CAST(length(lower(content)) - length(replace(lower(content), chr(97 + i::INTEGER), '')) AS DOUBLE)) AS v FROM mem),
n AS (SELECT id, embedding, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM c)
SELECT id, CAST(len(CASE WHEN embedding IS NULL THEN v ELSE CAST(embedding AS DOUBLE[]) END) AS INTEGER) AS dims, ROUND(CASE WHEN embedding IS NULL THEN list_sum(v) / CASE WHEN norm = 0 THEN 1 ELSE norm END ELSE list_sum(CAST(embedding AS DOUBLE[])) END, 3) AS total FROM n""",
)
def embedding_backfill(spark, d):
    """Every memory has a vector after it: those that had one keep it, the others get the embedder's."""
    out = embedding.backfilled(views.mem(spark, d).select("id", "content", "embedding"), LetterEmbedder)
    total = F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return out.select("id", F.size("embedding").alias("dims"), F.round(total, 3).alias("total"))


@query(
    "enrichment_backfill",
    f"""WITH {MEM}, {ENRICH}, have AS (SELECT * FROM en WHERE memory_id % 2 = 0),
v AS (SELECT id, list_transform(range(26), lambda i: CAST(length(lower(left(content, 20))) - length(replace(lower(left(content, 20)), chr(97 + i::INTEGER), '')) AS DOUBLE)) AS v FROM mem WHERE id NOT IN (SELECT memory_id FROM have)),
u AS (SELECT id, list_transform(v, lambda x: x / CASE WHEN list_sum(v) = 0 THEN 1 ELSE sqrt(list_dot_product(v, v)) END) AS u FROM v),
every AS (SELECT memory_id, seq, CAST(embedding AS DOUBLE[]) AS e FROM have UNION ALL SELECT id AS memory_id, s.seq, CAST(CAST(u AS FLOAT[]) AS DOUBLE[]) AS e FROM u CROSS JOIN (SELECT unnest(generate_series(0, 2))::INTEGER AS seq) s)
SELECT memory_id, seq, CAST(len(e) AS INTEGER) AS dims, ROUND(list_sum(list_transform(e, lambda x: abs(x))), 3) AS total, ROUND(list_dot_product(list_transform(e, lambda x: abs(x)), CAST(list_transform(range(1, len(e) + 1), lambda i: i) AS DOUBLE[])), 2) AS weighted FROM every""",
)
def enrichment_backfill(spark, d):
    """Three queries' vectors for each memory that has no enrichments; vectors by size, sum of magnitudes, and the same by place."""
    have = views.enrich(spark, d).where("memory_id % 2 = 0").withColumn("seq", F.col("seq").cast("int"))
    ask = lambda text: [f"{text[:20]} {k}" for k in range(5)]
    out = embedding.enriched(views.mem(spark, d, vectors=False).select("id", "content"), have, ask, LetterEmbedder)
    parts = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    total = lambda array: F.aggregate(array, F.lit(0.0), lambda a, x: a + x)
    weighted = F.transform(parts, lambda x, i: x * (i + 1))
    return out.select("memory_id", "seq", F.size("embedding").alias("dims"), F.round(total(parts), 3).alias("total"), F.round(total(weighted), 2).alias("weighted"))


# --- export -------------------------------------------------------------------------------------------------------


@query(
    "graph_json",
    f"""WITH {MEM}, {ASSOC} SELECT from_id, to_id, '{{"from":"' || from_id || '","to":"' || to_id || '","weight":' || CAST(ROUND(weight, 6) AS VARCHAR) || ',"co_activations":' || co_activation_count || '}}' AS json FROM assoc WHERE weight >= 0.15""",
)
def graph_json(spark, d):
    return export.edges_json(views.assoc(spark, d), 0.15)


@query(
    "graph_json_nodes",
    f"""WITH {MEM}, {ASSOC}, s AS (SELECT *, CASE WHEN strlen(content) <= 30 THEN content ELSE {PREFIX_SQL.format(t='content', n=27)} || '...' END AS label FROM mem
  WHERE id IN (SELECT from_id FROM assoc WHERE weight >= 0.15 UNION SELECT to_id FROM assoc WHERE weight >= 0.15))
SELECT id, '{{"id":"' || id || '","label":' || CAST(to_json(label) AS VARCHAR) || ',"energy":' || CAST(ROUND(energy, 6) AS VARCHAR) || ',"state":"' || state || '","access_count":' || access_count || '}}' AS json FROM s""",
)
def graph_json_nodes(spark, d):
    return export.nodes_json(views.assoc(spark, d), views.mem(spark, d, vectors=False), 0.15)


# --- identity -------------------------------------------------------------------------------------------------------

# An identity for each conversation, its turns as items of the older layout.
OLD_TYPES = ("persona_description", "trait", "tone", "expertise", "directive", "antipattern", "value")


def _old_items(spark, d):
    turn, conv = F.col("turn"), F.col("conv_id")
    kind = F.array(*map(F.lit, OLD_TYPES))[((conv + turn) % len(OLD_TYPES)).cast("int")]
    none = F.lit(None).cast("string")
    return views.table(spark, d, "conversations").select(
        conv.alias("owner"), F.lpad(turn.cast("string"), 8, "0").alias("id"), kind.alias("item_type"), F.col("text").alias("content"),
        none.alias("secondary"), none.alias("tertiary"), none.alias("category"), turn.alias("created_at"),
    )


OLD_SQL = f"oi AS (SELECT conv_id AS owner, lpad(CAST(turn AS VARCHAR), 8, '0') AS id, {list(OLD_TYPES)}[((conv_id + turn) % {len(OLD_TYPES)}) + 1] AS item_type, text AS content, turn AS created_at FROM conversations)"


@query(
    "identity_absorb",
    f"""WITH {OLD_SQL}, t AS (
  SELECT owner, min(struct_pack(created_at, id, content)) FILTER (item_type = 'persona_description') AS first,
    string_agg(content, ', ' ORDER BY created_at, id) FILTER (item_type = 'trait') AS tr, string_agg(content, ', ' ORDER BY created_at, id) FILTER (item_type = 'tone') AS tn,
    string_agg(content, ', ' ORDER BY created_at, id) FILTER (item_type = 'expertise') AS ex
  FROM oi GROUP BY owner),
a AS (SELECT *, COALESCE(first.content, '') AS x0 FROM t),
b AS (SELECT *, CASE WHEN tr IS NULL THEN x0 WHEN x0 = '' THEN 'Traits: ' || tr ELSE regexp_replace(x0, '[.]+$', '') || ' Traits: ' || tr || '.' END AS x1 FROM a),
c AS (SELECT *, CASE WHEN tn IS NULL THEN x1 ELSE regexp_replace(x1, '[.]+$', '') || ' Tone: ' || tn || '.' END AS x2 FROM b),
e AS (SELECT *, CASE WHEN ex IS NULL THEN x2 ELSE regexp_replace(x2, '[.]+$', '') || ' Expertise: ' || ex || '.' END AS x3 FROM c)
SELECT owner, CASE item_type WHEN 'directive' THEN 'rule' WHEN 'antipattern' THEN 'rule' ELSE item_type END AS item_type, content, CASE WHEN item_type = 'antipattern' THEN 'negative' END AS category
FROM oi WHERE item_type IN ('directive', 'antipattern', 'value') OR (item_type = 'persona_description' AND owner IN (SELECT owner FROM e WHERE x3 = x0))
UNION ALL SELECT owner, 'persona_description' AS item_type, x3 AS content, NULL AS category FROM e WHERE x3 <> x0""",
)
def identity_absorb(spark, d):
    """Each owner's items of the older layout in the present one."""
    return identity.absorbed(_old_items(spark, d), OWNER).select("owner", "item_type", "content", "category")


@query("identity_raw_types", f"WITH {OLD_SQL} SELECT owner, id, item_type, content FROM oi WHERE item_type NOT IN ('tone', 'trait') UNION ALL SELECT owner, id, 'mood' AS item_type, content FROM oi WHERE item_type = 'tone'")
def identity_raw_types(spark, d):
    """Types by their strings: one dropped, one renamed to a type that isn't known."""
    return identity.retyped(identity.removed_type(_old_items(spark, d), "trait"), "tone", "mood").select("owner", "id", "item_type", "content")


@query("identity_raw_list", f"WITH {OLD_SQL} SELECT owner, id, content FROM oi WHERE item_type = 'antipattern'")
def identity_raw_list(spark, d):
    return identity.listed(_old_items(spark, d), "antipattern").select("owner", "id", "content")


def _lines(array, *fields):
    """A list of structs as one text."""
    return F.array_join(F.transform(array, lambda x: F.concat_ws("|", *(x[f].cast("string") for f in fields))), "\n").alias(array)


@query(
    "identity_assembled",
    f"""WITH {ITEMS} SELECT owner, COALESCE((max(struct_pack(created_at, id, content)) FILTER (item_type = 'persona_name')).content, '') AS name,
  COALESCE((max(struct_pack(created_at, id, content)) FILTER (item_type = 'persona_description')).content, '') AS description,
  COALESCE(string_agg(concat_ws('|', content, secondary, category), chr(10) ORDER BY created_at, id) FILTER (item_type = 'value'), '') AS "values",
  COALESCE(string_agg(concat_ws('|', content, secondary, category), chr(10) ORDER BY created_at, id) FILTER (item_type = 'preference'), '') AS preferences,
  COALESCE(string_agg(concat_ws('|', content, COALESCE(secondary, ''), category), chr(10) ORDER BY created_at, id) FILTER (item_type = 'relationship'), '') AS relationships,
  COALESCE(string_agg(concat_ws('|', content, secondary, tertiary, CASE WHEN category = 'negative' THEN 'true' ELSE 'false' END), chr(10) ORDER BY created_at, id) FILTER (item_type = 'rule'), '') AS rules
FROM it GROUP BY owner""",
)
def identity_assembled(spark, d):
    """Each owner's identity as one row."""
    me = identity.assembled(_items(spark, d), OWNER)
    lists = [_lines("values", "principle", "why", "category"), _lines("preferences", "prefer", "over", "category"), _lines("relationships", "entity", "relation", "context"), _lines("rules", "content", "instead", "why", "negative")]
    return me.select("owner", "name", "description", *lists)


@query(
    "identity_from_blob",
    f"""WITH {ITEMS} SELECT owner, item_type, content, CASE WHEN item_type NOT LIKE 'persona%' THEN secondary END AS secondary, CASE WHEN item_type NOT LIKE 'persona%' THEN category END AS category
FROM it WHERE owner % 4 > 0 AND (item_type NOT LIKE 'persona%' OR (content <> '' AND (owner, item_type, id) IN (SELECT (owner, item_type, max(id)) FROM it GROUP BY owner, item_type)))
UNION ALL SELECT owner, item_type, content, secondary, category FROM it WHERE owner % 4 = 0""",
)
def identity_from_blob(spark, d):
    """Assembled identities back as items, for the owners that have none in the store."""
    items = _items(spark, d)
    return identity.from_blob(items.where("owner % 4 = 0"), identity.assembled(items, OWNER), OWNER).select("owner", "item_type", "content", "secondary", "category")


@query(
    "identity_set_persona",
    f"""WITH {ITEMS} SELECT owner, item_type, content FROM it WHERE NOT (owner % 3 = 0 AND item_type = 'persona_name')
UNION ALL SELECT DISTINCT owner, 'persona_name' AS item_type, 'Eve ' || owner AS content FROM it WHERE owner % 3 = 0
UNION ALL SELECT DISTINCT owner, 'rule' AS item_type, 'Ask' AS content FROM it WHERE owner % 3 = 0""",
)
def identity_set_persona(spark, d):
    """Owners get a name, twice, of which the last stays in place of any there was, and a rule beside those there were."""
    items = _items(spark, d)
    none = F.lit(None).cast("string")
    each = items.where("owner % 3 = 0").select("owner").distinct()
    new = [("persona_name", F.lit("Old"), 1000), ("persona_name", F.concat(F.lit("Eve "), F.col("owner").cast("string")), 1001), ("rule", F.lit("Ask"), 1002)]
    rows = F.explode(F.array(*(F.struct(F.lit(kind).alias("item_type"), text.alias("content"), F.lit(at).cast("long").alias("created_at")) for kind, text, at in new)))
    fresh = each.select("owner", rows.alias("r")).select("owner", F.lit("new").alias("id"), "r.*", none.alias("secondary"), none.alias("tertiary"), none.alias("category"))
    return identity.put(items, fresh.select(*items.columns), OWNER).select("owner", "item_type", "content")


@query(
    "identity_lines",
    f"""WITH {ITEMS} SELECT owner, id, content || COALESCE(' (' || secondary || ')', '') || COALESCE(' [' || tertiary || ']', '') || COALESCE(' {{' || category || '}}', '') AS line FROM it""",
)
def identity_lines(spark, d):
    return _items(spark, d).select("owner", "id", sc.format_item("content", "secondary", "tertiary", "category").alias("line"))
