"""Stems by Arrow: the words that are stemmed, and how often documents are read for them."""

from pyspark.sql import functions as F

from recallgrid.functions.text import porter
from recallgrid.operators import retrieval


def test_stems(spark):
    lists = [["running", "dogs", "runs", "running"], [], None, ["été", "ponies"], ["sky"] * 3]
    rows = spark.createDataFrame(list(enumerate(lists)), "id long, words array<string>").coalesce(1)
    got = {r.id: r.s for r in rows.select("id", retrieval.stems(F.col("words")).alias("s")).collect()}
    assert got == {i: None if ws is None else [porter(w) for w in ws] for i, ws in enumerate(lists)}


def test_read_once(spark):
    """Statistics and scores come from one pass over the documents."""
    seen = spark.sparkContext.accumulator(0)

    def told(text):
        seen.add(1)
        return text

    docs = spark.createDataFrame([(i, f"running dogs {'run ' * i}") for i in range(20)], "id long, content string")
    docs = docs.withColumn("content", F.udf(told, "string").asNondeterministic()("content"))
    assert len(retrieval.bm25_stemmed(docs, "runs dog", 5).collect()) == 5
    assert seen.value == 20


def test_counts(spark):
    """Terms and phrases that follow each other without a gap, against plain Python."""
    texts = {1: "a a a", 2: "", 3: "b a a", 4: None, 5: "aa a", 6: "é a é é", 7: "..."}
    docs = spark.createDataFrame(list(texts.items()), "id long, content string")
    phrases = [["a"], ["a", "a"], ["e"], ["b", "a"]]
    rows, stats = retrieval.counted(docs, phrases)

    def told(text):
        ts = text.replace("é", "e").replace(".", "").split()
        return (len(ts), *(sum(ts[i : i + len(p)] == p for i in range(len(ts))) for p in phrases))

    assert {r[0]: tuple(r[1:]) for r in rows.collect()} == {i: told(t) for i, t in texts.items() if t is not None}
    assert stats.first().n == 6
