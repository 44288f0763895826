"""The streaming log against the batch one, over disorder, late events and a restart."""

import random

import pytest
from pyspark.sql import functions as F

from recallgrid.operators import sessions
from recallgrid.streaming import access, recalls

EVENT = "session_id string, t long, kind int, event long, value long"
STORE = "spark.sql.streaming.stateStore.providerClass"


def batches():
    """Files of events in order of time, but for disorder of less than ten minutes; the last event is far in the future."""
    rng = random.Random(12)
    events = [(f"s{rng.randrange(4)}", i * 20 + rng.randrange(3), rng.randrange(2), i, rng.randrange(100)) for i in range(160)]
    shuffled = sorted(events, key=lambda e: e[1] + rng.randrange(400))
    files = [shuffled[i : i + 40] for i in range(0, 160, 40)]
    late = [("s0", 1, 0, 900, 1), ("s1", 2, 1, 901, 2)]
    return events, [*files[:3], files[3] + late, [("end", 10**6, 0, 999, 0)]]


def split(frame):
    rows = frame.withColumn("at", F.timestamp_seconds(F.col("t") + 1_700_000_000))
    asked = rows.where("kind = 0").select("session_id", "at", F.col("event").alias("search_id"), F.col("value").alias("result_ids"))
    return asked, rows.where("kind = 1").select("session_id", "at", F.col("event").alias("recall_id"), F.col("value").alias("recalled"))


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(STORE, before)


def run(spark, folder, **options):
    source = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = access.access_log(*split(source), **options)
    job = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    job.awaitTermination()


def test_stream_is_batch_after_a_restart(rocks, tmp_path):
    events, files = batches()
    for part in (files[:2], files[2:]):  # the second run goes on from the first one's state
        for rows in part:
            rocks.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run(rocks, tmp_path)
    got = sorted((r.session_id, r.search_id, int(r.result_ids), r.recall_id, r.recalled) for r in rocks.read.schema(access.LOG).parquet(f"{tmp_path}/out").collect())
    want = sessions.access_log(*split(rocks.createDataFrame(events, EVENT)))
    assert got and got == sorted((r.session_id, r.search_id, r.result_ids, r.recall_id, r.recalled) for r in want.collect())


def test_a_search_is_forgotten(rocks, tmp_path):
    rows = [("a", 0, 0, 1, 5), ("a", 50, 1, 2, 6), ("b", 0, 0, 3, 7), ("b", 200, 1, 4, 8), ("end", 10**6, 0, 9, 0)]
    for e in rows:
        rocks.createDataFrame([e], EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run(rocks, tmp_path, forget_after_ms=100_000)
    assert [(r.session_id, r.search_id, r.recall_id) for r in rocks.read.schema(access.LOG).parquet(f"{tmp_path}/out").collect()] == [("a", 1, 2)]


def plain_recalls(events):
    """The dynamics of recalls written anew: (graph, mem_id) to energy and count."""
    level, weight, recent = {}, {}, {}

    def lift(g, i, amount):
        energy, count = level.get((g, i), (1.0, 0))
        level[g, i] = min(1.0, energy + amount), count + 1

    for g, _, _, i in sorted(events, key=lambda e: (e[1], e[2])):
        lift(g, i, 0.2)
        mine = recent.setdefault(g, [])
        for j in mine:
            if j != i and level[g, j][0] >= 0.1:
                for pair in ((g, i, j), (g, j, i)):
                    weight[pair] = min(1.0, weight[pair] + 0.1) if pair in weight else 0.1
        mine.append(i)
        del mine[:-5]
        for (h, a, b), w in list(weight.items()):
            if (h, a) == (g, i) and 0.2 * w * 0.5 > 0.01:
                lift(g, b, 0.2 * w * 0.5)
    return level


def test_recalls_by_keyed_state(rocks, tmp_path):
    """Three batches and a restart give the energies of a plain fold, and so does the replay of the whole log."""
    rng = random.Random(5)
    events = [(rng.randrange(3), 1000 + i, i, rng.randrange(8)) for i in range(240)]
    schema = "graph long, t long, event_id long, mem_id long"
    want = {k: (pytest.approx(e), n) for k, (e, n) in plain_recalls(events).items()}
    latest = {}
    for k, part in enumerate((events[:80], events[80:160], events[160:])):
        rocks.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if k == 0:
            continue
        source = rocks.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withColumn("ts", F.timestamp_seconds("t"))

        def keep(frame, number):
            for r in frame.collect():
                latest[r.graph, r.mem_id] = (r.energy, r.access_count)

        recalls.stream_keyed(source).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert latest == want
    whole = rocks.createDataFrame(events, schema).withColumn("ts", F.timestamp_seconds("t"))
    assert {(r.graph, r.mem_id): (r.energy, r.access_count) for r in recalls.replay(whole).collect()} == want
