"""Session state: query tails, id sets, centroids, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def query_tail(signals: DataFrame, most: int = 50) -> DataFrame:
    """Per session the last queries in order, and how many there were. most 0 keeps all."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"])
    out = signals.groupBy("session_id").agg(ordered.alias("queries"), F.count("*").alias("query_count"))
    return out if most == 0 else out.withColumn("queries", F.slice("queries", F.greatest(F.lit(1), F.size("queries") - most + 1), most))


def parsed(rows: DataFrame) -> DataFrame:
    """Stored sessions with their lists read from JSON; a list that can't be read is empty."""
    empty = F.array().cast("array<string>")
    lists = [c for c in ("queries", "created_ids", "recalled_ids") if c in rows.columns]
    return rows.withColumns({c: F.coalesce(F.from_json(c, "array<string>"), empty) for c in lists})


def id_sets(signals: DataFrame, id_col: str = "at") -> DataFrame:
    """Per session its ids without repeats, in the order of first mention."""
    firsts = signals.groupBy("session_id", id_col).agg(F.min("turn").alias("turn"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("turn", id_col))), lambda s: s[id_col])
    return firsts.groupBy("session_id").agg(ordered.alias("ids"))


def unexpired(sessions: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Sessions seen within so many days; 0 keeps all."""
    return sessions if days == 0 else sessions.where(F.col("last_seen_at") >= now - days * 86400)


def fold_centroid(old, new, smoothing: float = 0.1):
    """One step of the moving average, brought back to unit length."""
    import numpy as np

    new = np.asarray(new, float)
    mixed = new if old is None else smoothing * new + (1 - smoothing) * np.asarray(old, float)
    norm = np.linalg.norm(mixed)
    return mixed / norm if norm else mixed


def centroids(signals: DataFrame, smoothing: float = 0.1) -> DataFrame:
    """Per session the centroid over its signals' vectors in order. A plain ordered fold inside the JVM: each step mixes and
    normalises, which no closed form gives."""
    vec = F.transform(F.sort_array(F.collect_list(F.struct("turn", F.col("embedding").cast("array<double>").alias("v")))), lambda s: s["v"])
    folded = signals.where("embedding is not null").groupBy("session_id").agg(vec.alias("vs"))

    def unit(v):
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        return F.transform(v, lambda x: F.when(norm == 0, x).otherwise(x / norm))

    def step(acc, v):
        return unit(F.when(F.size(acc) == 0, v).otherwise(F.zip_with(v, acc, lambda n, o: smoothing * n + (1 - smoothing) * o)))

    return folded.select("session_id", F.size("vs").alias("signals"), F.aggregate("vs", F.array().cast("array<double>"), step).alias("centroid"))


def session_id(seconds: Column) -> Column:
    """Eight hex digits of the time, eight of chance."""
    return F.lower(F.concat(F.lpad(F.hex(seconds), 8, "0"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 8)))


def upserted(sessions: DataFrame, new: DataFrame) -> DataFrame:
    """Sessions of new in place of those with their ids."""
    return sessions.join(new.select("session_id"), "session_id", "left_anti").unionByName(new)


SIGNAL = ("session_id", "at", "rank", "kind", "text", "memory_id", "embedding")


def signals(searches: DataFrame, creations: DataFrame, recalls: DataFrame, memories: DataFrame) -> DataFrame:
    """What moves a session's centroid, in order of (at, rank): a search's text and vector, each created memory and each recalled
    memory's vector, with its id. A search's own signal has the rank 1 and all others 0, and ``before`` takes what is
    strictly earlier, so no search sees itself.

    searches: (session_id, at, text, embedding); creations: (session_id, at, memory_id); recalls: (session_id, at, memory_id).
    Memories that don't exist or have no vector give no signal.
    """
    own = memories.where("embedding is not null").select(F.col("id").alias("memory_id"), "embedding")
    none, no_text = F.lit(None).cast(dict(own.dtypes)["memory_id"]), F.lit(None).cast("string")
    asked = searches.select("session_id", "at", F.lit(1).alias("rank"), F.lit("search").alias("kind"), "text", none.alias("memory_id"), "embedding")
    for kind, rows in (("create", creations), ("recall", recalls)):
        met = rows.join(own, "memory_id").select("session_id", "at", F.lit(0).alias("rank"), F.lit(kind).alias("kind"), no_text.alias("text"), "memory_id", "embedding")
        asked = asked.unionByName(met)
    return asked.select(*SIGNAL)


def before(all_signals: DataFrame, searches: DataFrame) -> DataFrame:
    """For each search (search_id, session_id, at) the signals of its session that were there when it ran: a row for each pair, for a
    few searches to be looked into. What all searches saw, ``before_each`` tells without pairs."""
    then = searches.select("search_id", "session_id", F.col("at").alias("search_at"))
    return all_signals.join(then, "session_id").where("at < search_at or (at = search_at and rank = 0)")


def before_each(all_signals: DataFrame, searches: DataFrame, smoothing: float = 0.1) -> DataFrame:
    """(search_id, n_before, n_create, n_recall, n_vectors, centroid) of each search (search_id, session_id, at): how many signals of its
    session were there when it ran, and the centroid of their vectors, null if there were none.

    One ordered scan: sessions are dealt to tasks, and signals and searches come by session and time through Spark's sort; a task
    carries one session's counts and centroid from row to row and from batch to batch, so neither pairs of searches
    and signals nor a session's list ever exist. Of signals at one time, created memories come before recalled ones, by id."""
    import numpy as np
    import pyarrow as pa

    kind = dict(searches.dtypes)["search_id"]
    vector = F.col("embedding").cast("array<double>").alias("embedding")
    told = all_signals.select("session_id", "at", F.col("rank").cast("double").alias("rank"), "kind", F.col("memory_id").cast("string").alias("tie"), F.lit(None).cast(kind).alias("search_id"), vector)
    none = F.lit(None)
    asks = searches.select("session_id", "at", F.lit(0.5).alias("rank"), F.lit("ask").alias("kind"), none.cast("string").alias("tie"), "search_id", none.cast("array<double>").alias("embedding"))
    order = ["session_id", "at", "rank", "kind", "tie", "search_id"]
    rows = told.unionByName(asks).repartition("session_id").sortWithinPartitions(*order)
    searched = rows.schema["search_id"].dataType
    names = ["search_id", "n_before", "n_create", "n_recall", "n_vectors", "centroid"]

    def scan(batches):
        session, counts, n, centroid = None, {}, 0, None
        for batch in batches:
            out: list[list] = [[] for _ in names]
            columns = (batch[c].to_pylist() for c in ("session_id", "kind", "search_id", "embedding"))
            for own, what, search, v in zip(*columns, strict=True):
                if own != session:
                    session, counts, n, centroid = own, {}, 0, None
                if what == "ask":
                    row = (search, sum(counts.values()), counts.get("create", 0), counts.get("recall", 0), n, None if centroid is None else centroid.tolist())
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    continue
                counts[what] = counts.get(what, 0) + 1
                if v is not None:
                    n, centroid = n + 1, fold_centroid(centroid, np.asarray(v, float), smoothing)
            kinds = [batch.schema.field("search_id").type, *[pa.int64()] * 4, pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    return rows.mapInArrow(scan, f"search_id {searched.simpleString()}, n_before long, n_create long, n_recall long, n_vectors long, centroid array<double>")


def touched(all_signals: DataFrame) -> DataFrame:
    """Per session: when it was last seen, its number of signals of each kind, and the ids it created or recalled, each once."""
    count = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("search", "create", "recall")]
    return all_signals.groupBy("session_id").agg(F.max("at").alias("last_seen_at"), *count, F.sort_array(F.collect_set("memory_id")).alias("ids"))


def access_log(searches: DataFrame, recalls: DataFrame) -> DataFrame:
    """(session_id, search_id, result_ids, recall_id, recalled) of each recall that is the first after a search of its session:
    a search is taken once, by the next recall, and gone if another search comes first.

    searches: (session_id, at, search_id, result_ids); recalls: (session_id, at, recall_id, recalled). At one time a search
    comes before a recall. One window a session, without a join."""
    none = lambda kind: F.lit(None).cast(kind)
    asked = searches.select("session_id", "at", F.lit(0).alias("kind"), F.col("search_id").alias("event"), F.col("search_id"), "result_ids", none(dict(recalls.dtypes)["recalled"]).alias("recalled"))
    kinds = dict(searches.dtypes)
    met = recalls.select("session_id", "at", F.lit(1).alias("kind"), F.col("recall_id").alias("event"), none(kinds["search_id"]).alias("search_id"), none(kinds["result_ids"]).alias("result_ids"), "recalled")
    order = Window.partitionBy("session_id").orderBy("at", "kind", "event")
    prior = [F.lag(c).over(order).alias(f"last_{c}") for c in ("kind", "search_id", "result_ids")]
    every = asked.unionByName(met).select("*", *prior)
    return every.where("kind = 1 and last_kind = 0").select("session_id", F.col("last_search_id").alias("search_id"), F.col("last_result_ids").alias("result_ids"), F.col("event").alias("recall_id"), "recalled")
