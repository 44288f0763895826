"""Goldens and rules of single operators."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallgrid.functions import scalars as sc
from recallgrid.functions import temporal as tm
from recallgrid.functions import text as tx
from recallgrid.operators import documents, dynamics, graph, identity, retrieval, sessions, store
from recallgrid.plans import pipeline
from recallgrid.streaming import recalls


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'long' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def test_states(spark):
    assert [one(spark, sc.state_of("e"), e=e) for e in (0.3, 0.25, 0.1, 0.05, 0.02, 0.01)] == ["active", "dormant", "dormant", "deep", "deep", "archived"]
    assert one(spark, sc.decayed("e", "s", 0.3), e=1.0, s="active") == pytest.approx(0.7)
    assert one(spark, sc.decayed("e", "s", 1.5), e=1.0, s="active") == 0.001
    assert one(spark, sc.decayed("e", "s", 0.3), e=0.01, s="archived") == 0.01
    assert one(spark, sc.decayed("e", "s", 0.04), e=0.05, s="deep") == pytest.approx(0.04)
    assert one(spark, sc.stimulated("e", 0.3), e=0.5) == 0.8 and one(spark, sc.stimulated("e", 0.5), e=1.0) == 1.0


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in rows.select(sc.cosine("a", "b")).collect()] == [0.0, pytest.approx(1.0), 0.0, None, None]


def test_rrf(spark):
    a, b = (spark.createDataFrame(x, "id long, score double") for x in ([(1, 9.0), (2, 8.0)], [(1, 0.5), (3, 0.4)]))
    got = {r.id: r.score for r in retrieval.rrf([a, b]).collect()}
    assert got[1] == pytest.approx(1.0) and len(got) == 3
    assert retrieval.rrf([a.limit(0), b.limit(0)]).count() == 0


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "Rust programming language"), (2, "programming, in Café"), (3, "cooking"), (4, None)], "id long, content string")
    assert {r.id for r in retrieval.bm25(docs, 'Programming "').collect()} == {1, 2}
    assert {r.id for r in retrieval.bm25(docs, "cafe programming").collect()} == {2}
    assert {r.id for r in retrieval.bm25(docs, "programming-language").collect()} == {1}
    assert retrieval.bm25(docs, "quantum physics").count() == retrieval.bm25(docs, "  ").count() == 0
    stemmed = spark.createDataFrame([(1, "Researching things"), (2, "none")], "id long, content string")
    assert {r.id for r in retrieval.bm25_stemmed(stemmed, "research").collect()} == {1}


def test_porter():
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "falling": "fall", "filing": "file",
             "happy": "happi", "relational": "relat", "vietnamization": "vietnam", "triplicate": "triplic", "hopefulness": "hope", "adoption": "adopt", "probate": "probat", "controll": "control"}
    assert {w: tx.porter(w) for w in pairs} == pairs


def test_expansion():
    assert tx.expand_query("what is Ada's plan") == ["what is Ada's plan", "Ada plan"]
    assert tx.expand_query("plan") == ["plan"]
    assert tx.fallback_terms("Ada bought red apples, Ada") == ["Ada", "bought", "apples"]
    assert tx.fallback_terms("the plan") == []
    assert tx.normalize_variants(" a b ", ["A B", "", "c"]) == ["a b", "c"]
    assert tx.shaping_tokens("The dog’s DOGS, at it") == {"dog", "dogs"}
    assert tx.truncate_bytes("naïve words", 6) == "na..." and tx.truncate_bytes("abcd", 3) == "..."
    assert tx.percent_decode("a%20b+c%zz%C3%A9") == "a b c%zzé"


def test_limits():
    assert pipeline.effective_limit("all books", 50) == 30 and pipeline.effective_limit("all books", 5) == 15 and pipeline.effective_limit("x", 50) == 50
    assert pipeline.is_inferential("What job would fit") and not pipeline.is_inferential("where")


@pytest.mark.parametrize(
    ("said", "ref", "first", "last"),
    [
        ("last sunday", (2023, 5, 25), (2023, 5, 21), (2023, 5, 21)),
        ("a month ago", (2023, 3, 31), (2023, 2, 28), (2023, 2, 28)),
        ("a month ago", (2024, 3, 31), (2024, 2, 29), (2024, 2, 29)),
        ("last saturday", (2023, 5, 25), (2023, 5, 20), (2023, 5, 20)),
        ("the sunday before 2023-05-25", (2020, 1, 1), (2023, 5, 21), (2023, 5, 21)),
        ("two weekends before 17 July 2023", (2020, 1, 1), (2023, 7, 8), (2023, 7, 9)),
        ("the weekend after", (2023, 7, 15), (2023, 7, 22), (2023, 7, 23)),
        ("this monday", (2023, 5, 25), (2023, 5, 22), (2023, 5, 22)),
        ("last month", (2023, 3, 31), (2023, 2, 1), (2023, 2, 28)),
        ("the week before July 10th, 2023", (2020, 1, 1), (2023, 7, 3), (2023, 7, 9)),
        ("last weekend of April 2023", (2020, 1, 1), (2023, 4, 29), (2023, 4, 30)),
        ("winter 2023", (2020, 1, 1), (2023, 12, 1), (2024, 2, 29)),
        ("in two weeks", (2023, 1, 1), (2023, 1, 15), (2023, 1, 15)),
    ],
)
def test_resolver(said, ref, first, last):
    assert tm.resolve(said, date(*ref))[:2] == (date(*first), date(*last))


def test_resolver_errors():
    for said in ("someday", "the weekend of never", "fourth weekend of April"):
        with pytest.raises(ValueError):
            tm.resolve(said, date(2023, 1, 1))


def test_centroid(spark):
    assert sessions.fold_centroid(None, [3, 4]) == pytest.approx([0.6, 0.8])
    assert sessions.fold_centroid([1, 0], [0, 1]) == pytest.approx(np.array([0.9, 0.1]) / np.sqrt(0.82))
    rows = spark.createDataFrame([(1, 2, [0.0, 1.0]), (1, 1, [1.0, 0.0]), (2, 1, [0.0, 0.0])], "session_id long, turn long, embedding array<double>")
    got = {r.session_id: r.centroid for r in sessions.centroids(rows).collect()}
    assert got[1] == pytest.approx(list(np.array([0.9, 0.1]) / np.sqrt(0.82))) and got[2] == [0.0, 0.0]


def test_hebbian_is_replay(spark):
    """The closed form agrees with the fold as long as every memory stays searchable."""
    log = [(1, f"2024-01-01 0{i // 20}:{i % 20 + 10}:00", i, (i * i) % 11) for i in range(60)]
    frame = spark.createDataFrame(log, "graph long, t string, event_id long, mem_id long").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    got = {(r.from_id, r.to_id): r.weight for r in dynamics.hebbian(frame).collect()}
    g = recalls.Graph()
    for *_, i in log:
        g.recall(i)
    want = {(a, b): w for a, x in g.edges.items() for b, w in x.items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    folded = {r.mem_id: (r.energy, r.access_count) for r in recalls.replay(frame).collect()}
    assert folded == {i: (e, n) for i, e, _, n in g.rows()}
    again = recalls.Graph.load(g.dump())
    assert list(again.rows()) == list(g.rows()) and again.edges == g.edges and again.window == g.window


def test_stream_is_batch(spark, tmp_path):
    log = [(i % 3, f"2024-01-01 00:{i % 60:02d}:00", i, (i * 7) % 5) for i in range(45)]
    frame = spark.createDataFrame(log, "graph long, t string, event_id long, mem_id long").select("graph", F.col("t").cast("timestamp").alias("ts"), "event_id", "mem_id")
    frame.coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")
    run = recalls.stream(source).writeStream.outputMode("update").format("memory").queryName("recalled").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    run.awaitTermination()
    got = {(r.graph, r.mem_id): r.energy for r in spark.table("recalled").collect()}
    assert got == {(r.graph, r.mem_id): r.energy for r in recalls.replay(frame).collect()}


def test_discovery(spark):
    """The first edge that reaches a target counts, and what was dropped stays seen and leads no further."""
    mems = spark.createDataFrame([(i, "m", 1.0, "active", 0, [1.0, 0.0] if i != 3 else None) for i in range(7)], "id long, content string, energy double, state string, created_at long, embedding array<double>")
    edges = [(0, 1, 0.5, None, 0), (0, 3, 0.9, None, 1), (1, 2, 0.4, None, 2), (3, 4, 0.9, None, 3), (2, 5, 0.1, None, 4), (0, 2, 0.1, None, 5), (1, 6, 0.2, 1, 6)]
    frame = spark.createDataFrame(edges, "from_id long, to_id long, weight double, ordinal int, edge_seq long")
    seeds = spark.createDataFrame([(0, 1)], "id long, frontier_rank int")
    q = spark.createDataFrame([([1.0, 0.0],)], "q array<double>")
    got = {r.id: (r.hop, round(r.blended, 6)) for r in graph.discover(seeds, frame, mems, q, 3).collect()}
    assert got == {1: (1, 1.05), 2: (2, 1.04), 6: (2, 1.02)}


def test_diversity():
    def row(i, content, v, score, bucket="b"):
        return {"id": i, "content": content, "embedding": v, "blended": score, "bucket": bucket}

    rows = [row(1, "alpha beta", [1.0, 0.0], 0.9), row(2, "alpha beta gamma", [1.0, 0.01], 0.89), row(3, "alpha beta", None, 0.8), row(4, "delta words", [0.0, 1.0], 0.7)]
    assert [r["id"] for r in retrieval.select_diverse(rows, "alpha", 4)] == [1, 4, 3]


def test_delete_and_prune(spark):
    mems = spark.createDataFrame([(i,) for i in range(4)], "id long")
    edges = spark.createDataFrame([(0, 1, 0.5), (1, 0, 0.01), (1, 9, 0.9), (2, 3, 0.6)], "from_id long, to_id long, weight double")
    assert graph.prune_weak(edges).count() == 3 and graph.prune_orphans(edges, mems).count() == 3
    en = spark.createDataFrame([(0, 0), (2, 0)], "memory_id long, seq int")
    left, kept, rest = graph.delete_cascade(mems, edges, en, spark.createDataFrame([(0,)], "id long"))
    assert (left.count(), kept.count(), rest.count()) == (3, 2, 1)


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    assert s.current("mem") is None
    first = spark.createDataFrame([(1, 0.1), (2, 0.2)], "id long, energy double")
    s.write("mem", first)
    s.write("mem", store.upsert(s.read("mem"), spark.createDataFrame([(2, 0.9), (3, 0.3)], "id long, energy double"), ["id"]))
    assert {r.id: r.energy for r in s.read("mem").collect()} == {1: 0.1, 2: 0.9, 3: 0.3}


def test_store_log_and_models(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, "q")], "id long, query string")
    s.append("access", rows)
    s.append("access", rows)
    assert s.log("access").count() == 2
    merge = s.sink("mem", ["id"])
    merge(rows, 0)
    merge(spark.createDataFrame([(1, "r"), (2, "s")], "id long, query string"), 1)
    assert {r.id: r.query for r in s.read("mem").collect()} == {1: "r", 2: "s"}
    mems = spark.createDataFrame([(1, [1.0])], "id long, embedding array<double>")
    assert store.for_model(mems, rows, "a", "a")[0] is mems
    cleared, none = store.for_model(mems, rows, "a", "b")
    assert cleared.first().embedding is None and none.count() == 0


def test_loose_times_and_vectors(spark):
    import struct

    said = ["1700000000.9", "17 July 2023", "July 17, 2023", "2023-07-17", "1700000000", "soon"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string").orderBy("i").select(sc.parse_epoch_loose("t")).collect()]
    assert got == [1700000000, 1689552000, 1689552000, 1689552000, 1700000000, None]
    values = [0.0, 1.5, -2.25, 3.4e38, 1e-40]
    blobs = spark.createDataFrame([(bytearray(struct.pack("<5f", *values)),), (bytearray(b"abc"),), (bytearray(),)], "b binary").select(sc.vector_of("b")).collect()
    assert blobs[0][0] == [struct.unpack("<f", struct.pack("<f", v))[0] for v in values] and blobs[1][0] is None and blobs[2][0] == []


def test_identity(spark):
    items = spark.createDataFrame([("1", "persona_name", "Ada", None, None, None, 1), ("2", "trait", "kind", None, None, None, 2)], identity.SCHEMA)
    items = identity.add(identity.retyped(items, "trait", "value", "old"), "persona_name", "Eve", 3)
    assert {(r.item_type, r.content, r.category) for r in items.collect()} == {("value", "kind", "old"), ("persona_name", "Eve", None)}
    assert identity.search(items, "Eve").count() == 0 and "<values>\n  • kind\n</values>" in identity.render(items)
    with pytest.raises(ValueError):
        identity.add(items, "nonsense", "x", 1)


def test_documents(spark):
    texts = spark.createDataFrame([("f", "one\f\f two  x"), ("p", "a" * 2000 + "\n\n" + "b" * 2000 + "\n\nc"), ("e", "")], "source string, text string")
    got = sorted((r.source, r.page_number, r.content[:5]) for r in documents.pages(texts).collect())
    assert got == [("f", 1, "one"), ("f", 3, "two x"), ("p", 1, "aaaaa"), ("p", 2, "bbbbb")]
    page = "Anxiety Disorder\nDiagnostic Criteria\nF41.1 text\nComorbidity\nmore 1.\nPanic Disorder\nbody F40"
    paged = spark.createDataFrame([("dsm5", 1, page), ("other", 2, "plain rewh page"), ("nasw ethics", 3, "1. SOCIAL WORKERS' ETHICAL RESPONSIBILITIES TO CLIENTS\n1.01 Commitment\ntext")], "source string, page_number int, content string")
    rows = documents.index(paged).collect()
    by = {(r.source, r.title): r for r in rows}
    assert by["dsm5", "Anxiety Disorder"].codes == ["F41.1"] and by["dsm5", "Anxiety Disorder - Comorbidity"].parent == "Anxiety Disorder"
    assert by["other", "Page 2"].rowid == -2 and by["nasw ethics", "1.01 Commitment"].parent == "1. Social Workers' Ethical Responsibilities to Clients"
    hits = documents.search(documents.index(paged), 'rewh OR "body F40"', 5).collect()
    assert {(h.source, h.title) for h in hits} == {("other", "Page 2"), ("dsm5", "Panic Disorder")}
    assert ">>>rewh<<<" in next(h.snippet for h in hits if h.source == "other")
    assert documents.search(documents.index(paged), "text NOT f41", 5).count() == 1
