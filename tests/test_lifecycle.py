"""Stores, sinks, embedders, judges, queries and texts beyond what SQL states."""

import json
import tomllib

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from recallgrid.functions import text as tx
from recallgrid.operators import documents, embedding, export, identity, postings, sessions, store
from recallgrid.plans import pipeline
from recallgrid.sources import files

MEM = "id long, content string, tags array<string>, energy double, confidence double, state string, created_at long, last_accessed long, access_count long, embedding array<double>"


@pytest.fixture(scope="module")
def memories(spark):
    rows = [(i, f"memory number {i} of things", ["a"], 0.1 * i, 1.0, "active" if i > 2 else "dormant", 100 + i, 200 - i, 0, [1.0, 0.1 * i] if i % 2 else None) for i in range(1, 7)]
    return spark.createDataFrame(rows, MEM)


def test_frame_store(spark, memories):
    kept = store.FrameStore()
    assert kept.current("m") is None
    kept.write("m", memories)
    kept.write("m", memories.where("id > 3"))
    assert kept.current("m") == "v-1" and kept.read("m").count() == 3
    kept.append("log", memories.limit(1))
    kept.append("log", memories.limit(2))
    assert kept.log("log").count() == 3


def test_sink(spark, tmp_path):
    kept = store.Store(spark, f"file://{tmp_path}/s")
    merge = kept.sink("m", ["id"], parts=4)
    frame = lambda rows: spark.createDataFrame(rows, "id long, v long")
    merge(frame([(1, 1), (2, 2), (2, 5), (9, 9)]), 0)
    merge(frame([(2, 3), (3, 3)]), 1)
    merge(frame([(2, 100)]), 1)  # the same batch again
    assert sorted(tuple(r) for r in kept.read("m").collect()) == [(1, 1), (2, 3), (3, 3), (9, 9)]
    assert kept.merged("m") == 1 and kept.merged("none") == -1


def test_create_defaults(spark, memories):
    new = spark.createDataFrame([("now",), ("later",)], "content string")
    out = store.create(memories.withColumn("id", F.col("id").cast("string")), new, F.lit(77))
    made = out.where("created_at = 77").collect()
    assert {r.content for r in made} == {"now", "later"} and len({r.id for r in made}) == 2
    assert all((r.energy, r.state, r.tags, r.access_count, r.embedding) == (1.0, "active", [], 0, None) for r in made)


class Fussy:
    dims = 2

    def embed(self, texts):
        if any("4" in t for t in texts):
            raise RuntimeError("no fours")
        return [[float(len(t)), 1.0] for t in texts]


def test_embedding(spark, memories):
    out = {r.id: r.embedding for r in embedding.backfilled(memories, Fussy, batch=2).collect()}
    assert out[1] == [1.0, 0.1] and out[2] == [float(len("memory number 2 of things")), 1.0] and out[4] is None
    told = {r.id: r.error for r in embedding.embedded(memories.select("id", "content"), Fussy).collect()}
    assert told == {i: "no fours" if i == 4 else None for i in range(1, 7)}
    with pytest.raises(Exception, match="could not be embedded"):
        embedding.embedded(memories.select("id", "content"), Fussy, most_errors=0).collect()
    a, b = embedding.TermEmbedder(8).embed(["one two", "two one"])
    assert a == pytest.approx(b) and sum(x * x for x in a) == pytest.approx(1) and embedding.TermEmbedder(8).embed([""]) == [[0.0] * 8]


def test_judge(spark, memories):
    hits = memories.select("id", "content", F.col("energy").alias("blended"))
    seen = []

    def judge(query, texts, limit):
        seen.append((query, len(texts), limit))
        return [1, 0]

    got = {r.id: r.blended for r in pipeline.rerank(hits, "what", judge, 3, 10).collect()}
    assert got == {5: 1.0, 6: 0.95} and seen == [("what", 3, 10)]
    assert pipeline.rerank(hits.where("false"), "what", judge).count() == 0 and len(seen) == 1


def test_search_with_judge(spark, memories):
    edges = spark.createDataFrame([(1, 2, 0.9, 0, None, 0)], "from_id long, to_id long, weight double, co_activation_count long, ordinal int, edge_seq long")
    q = spark.createDataFrame([([1.0, 0.1],)], "q array<double>")
    options = pipeline.SearchOptions(min_score=0.0, rerank=lambda query, texts, limit: [0], depth=0)
    out = pipeline.search(memories, edges, q, "things", 0, options)
    assert out["rerank"].count() == 1 and out["result"].count() == 1
    shown = pipeline.preview(spark.createDataFrame([("x" * 200,)], "content string")).first()[0]
    assert len(shown) == 100 and shown.endswith("...")


def test_batch_errors(spark, memories):
    edges = spark.createDataFrame([], "from_id long, to_id long, weight double, co_activation_count long, ordinal int, edge_seq long")
    good, bad = (spark.createDataFrame([([1.0, 0.1],)], f"{c} array<double>") for c in ("q", "other"))
    rows = pipeline.batch(memories, edges, [(0, "things", good), (1, "things", bad)], pipeline.SearchOptions(min_score=0.0, depth=0)).collect()
    assert any(r.query_id == 0 and r.error is None for r in rows) and [r.id for r in rows if r.query_id == 1] == [None]
    with pytest.raises(AnalysisException):
        memories.select("nothing").collect()


def test_full_text(spark):
    assert documents.parse_query('a b OR "c d" NOT e') == ([["a"], ["b"], ["c", "d"], ["e"]], ("OR", ("AND", 0, 1), ("NOT", 2, 3)))
    assert documents.parse_query("(a OR b) c") == ([["a"], ["b"], ["c"]], ("AND", ("OR", 0, 1), 2))
    assert documents.parse_query("") == ([], None) and documents.parse_query("!!") == ([], None)
    for bad in ("a AND", "(a", "OR a", "a)"):
        with pytest.raises(ValueError):
            documents.parse_query(bad)


def test_section_search(spark):
    paged = spark.createDataFrame([("dsm5 x", 1, "Test Disorder\nDiagnostic Criteria\nfear of words\nComorbidity\nfear of more"), ("notes", 1, "fear itself")], "source string, page_number int, content string")
    sections = documents.index(paged)
    found = {(r.source, r.title) for r in documents.search_type(sections, "fear", "comorbidity").collect()}
    assert found == {("dsm5 x", "Test Disorder - Comorbidity"), ("notes", "Page 1")}
    assert [r.n for r in spark.createDataFrame([('["a", "b"]',), ("broken",), (None,)], "c string").select(F.size(documents.codes_of("c")).alias("n")).collect()] == [2, 0, 0]


def test_postings(spark, tmp_path):
    rows = [(1, "Rust programming language"), (2, "programming, in Café"), (3, "cooking"), (4, None), (5, "")]
    spark.createDataFrame(rows, "id long, content string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    index = postings.ensure(docs, f"file://{tmp_path}/index")
    assert index.stats.first().n == 4
    hits = lambda q: {r.id for r in postings.bm25(index, q).collect()}
    assert hits("Programming") == {1, 2} and hits("cafe programming") == {2} and hits("programming-language") == {1} and hits("language-programming") == hits(" ") == set()
    spark.createDataFrame([(6, "cooking again")], "id long, content string").write.mode("append").parquet(f"{tmp_path}/docs")
    grown = postings.ensure(spark.read.parquet(f"{tmp_path}/docs"), f"file://{tmp_path}/index")
    assert {r.id for r in postings.bm25(grown, "cooking").collect()} == {3, 6} and hits("cooking") == {3}
    plain = postings.of(docs)
    assert {r.id for r in postings.bm25(plain, "programming").collect()} == {1, 2}
    assert postings.bm25(postings.of(docs.limit(0)), "a").count() == 0


def test_signals_order(spark):
    searches = spark.createDataFrame([("s", 5, "q", [1.0], 0), ("s", 9, "r", [1.0], 1)], "session_id string, at long, text string, embedding array<double>, search_id long")
    memories = spark.createDataFrame([(1, [0.0]), (2, None)], "id long, embedding array<double>")
    made = spark.createDataFrame([("s", 5, 1), ("s", 6, 2), ("s", 7, 3)], "session_id string, at long, memory_id long")
    told = sessions.signals(searches, made, made.limit(0), memories)
    assert sorted((r.search_id, r.kind) for r in sessions.before(told, searches).collect()) == [(0, "create"), (1, "create"), (1, "search")]


def test_render(spark):
    rows = [("1", "persona_name", "Ada", None, None, None, 1), ("2", "persona_description", "Curious", None, None, None, 2), ("3", "rule", "Ask", "first", "it helps", None, 3), ("4", "rule", "guess", "look", None, "negative", 4), ("5", "oddity", "x", None, None, None, 5)]
    rows += [(f"v{i:05}", "value", f"value {i}", None, None, None, 10 + i) for i in range(1500)]
    text = identity.render(spark.createDataFrame(rows, identity.SCHEMA))
    assert text.startswith("<persona>\nI am Ada. Curious\n</persona>\n\n<values>\n") and text.count("  • value ") == 1500
    assert text.endswith("<rules>\nDo:\n  • Ask — first\n    (it helps)\n\nDon't:\n  ✗ guess → look\n</rules>\n\n") and "oddity" not in text
    assert identity.absorbed(spark.createDataFrame([("1", "trait", "calm", None, None, None, 1)], identity.SCHEMA)).select("content").collect()[0][0] == "Traits: calm"


def test_settings_writer():
    text = "# mine\n[other]\ndebug = 1\n\n[brain]\n# rate\ndecay_rate_per_day = 0.1  # slow\nrerank_mode = \"off # not a comment\" # why\n\n[last]\nx = 1\n"
    out = files.with_setting(files.with_setting(files.with_setting(text, "decay_rate_per_day", 0.2), "rerank_mode", "llm"), "debug", True)
    assert "decay_rate_per_day = 0.2  # slow" in out and 'rerank_mode = "llm" # why' in out and out.startswith("# mine\n[other]\ndebug = 1\n")
    assert tomllib.loads(out)["brain"] == {"decay_rate_per_day": 0.2, "rerank_mode": "llm", "debug": True} and tomllib.loads(out)["last"] == {"x": 1}
    assert tomllib.loads(files.with_setting("", "debug", False)) == {"brain": {"debug": False}}
    with pytest.raises(ValueError):
        files.with_setting(text, "no_such", 1)


def test_copy_document(spark, tmp_path):
    (tmp_path / "My file.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "bad.pdf").write_bytes(b"nothing")
    names = [files.copy_document(spark, f"{tmp_path}/My file.pdf", f"file://{tmp_path}/out").rsplit("/", 1)[-1] for _ in range(3)]
    assert names == ["My_file.pdf", "My_file_2.pdf", "My_file_3.pdf"]
    with pytest.raises(ValueError):
        files.copy_document(spark, f"{tmp_path}/bad.pdf", f"file://{tmp_path}/out")


def test_multipart():
    body = b'--x\r\nContent-Disposition: form-data; name="n"\r\n\r\nv\r\n--x\r\nContent-Disposition: form-data; name="f"; filename="a b.pdf"\r\n\r\n\x00\xffdata\r\n--x--\r\n'
    assert tx.multipart_file(body, "x") == ("a b.pdf", b"\x00\xffdata") and tx.multipart_file(b"", "x") is None and tx.multipart_file(body, "y") is None


def test_export(spark, memories, tmp_path):
    edges = spark.createDataFrame([(1, 2, 0.9, 3), (2, 99, 0.5, 0), (3, 4, 0.01, 0)], "from_id long, to_id long, weight double, co_activation_count long")
    page = export.page(edges, memories.withColumn("content", F.lit("a </script> b")), least=0.1)
    data = json.loads(page.split("const data = ")[1].split(";\n")[0])
    assert {n["id"] for n in data["nodes"]} == {"1", "2"} and len(data["edges"]) == 2 and page.count("</script>") == 1
    export.write(edges, memories, f"file://{tmp_path}/g", 0.1)
    assert spark.read.json(f"file://{tmp_path}/g/nodes").count() == 2 and spark.read.json(f"file://{tmp_path}/g/edges").count() == 2
