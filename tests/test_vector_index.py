"""The vector index against a scan, before and after changes, and what it leaves unread."""

import random

import pytest

from recallgrid.operators import retrieval, vector_index


def vectors(n=900, dims=12, clusters=15, seed=4):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(clusters)]
    rows = [(i, [x + rng.gauss(0, 0.08) for x in centres[i % clusters]]) for i in range(n)]
    rows += [(n, None), (n + 1, [0.0] * dims), (n + 2, [1.0] * 3), (n + 3, []), (3, [1.0] * dims), (n + 4, rows[5][1]), (n + 5, rows[5][1])]
    return rows


def scan(frame, q, k, least=None):
    asked = frame.sparkSession.createDataFrame([(q,)], "q array<double>")
    hits = retrieval.similar(frame, asked, least).groupBy("id").agg({"score": "max"}).withColumnRenamed("max(score)", "score")
    return [(r.id, round(r.score, 12)) for r in hits.orderBy(hits.score.desc(), "id").limit(k).collect()]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    frame = spark.createDataFrame(vectors(), "id long, embedding array<double>").cache()
    path = f"file://{tmp_path_factory.mktemp('vectors')}/index"
    vector_index.build(frame, path)
    return frame, path


def test_same_as_a_scan(spark, made):
    frame, path = made
    index = vector_index.load(spark, path)
    shares = []
    for q, k, least in [(vectors()[7][1], 10, None), (vectors()[5][1], 3, 0.5), ([1.0] * 12, 25, None), ([1.0, 2.0, 3.0], 5, None), ([0.0] * 12, 4, None), (vectors()[8][1], 2000, 0.9)]:
        found, share = vector_index.knn(index, q, k, least)
        assert [(r.id, round(r.score, 12)) for r in found.collect()] == scan(frame, q, k, least)
        shares.append(share)
    assert shares[0] < 0.2 and shares[1] < 0.2  # in clusters, most cells are ruled out


def test_changes(spark, made, tmp_path, monkeypatch):
    frame, _ = made
    path = f"file://{tmp_path}/index"
    vector_index.build(frame, path)
    monkeypatch.setattr(vector_index, "PARTS", 2)
    held = dict(enumerate([r[1] for r in vectors()[:900]]))
    held |= {901: [0.0] * 12, 902: [1.0] * 3, 904: vectors()[5][1], 905: vectors()[5][1]}
    for k in range(3):  # the last change merges all parts
        rows = [(7 + k, [0.5 + k] * 12), (20 + k, None), (2000 + k, vectors()[9][1])]
        vector_index.changed(spark, path, spark.createDataFrame(rows, "id long, embedding array<double>"))
        held.update(rows)
        held[3] = vectors()[3][1]
        now = spark.createDataFrame([(i, v) for i, v in held.items()] + [(3, [1.0] * 12)], "id long, embedding array<double>")
        index = vector_index.load(spark, path)
        for q in (vectors()[9][1], [1.0] * 12):
            assert [(r.id, round(r.score, 12)) for r in vector_index.knn(index, q, 12)[0].collect()] == scan(now, q, 12)
    assert len(vector_index._parts(spark, path)) <= 2


def test_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, embedding array<double>")
    vector_index.build(empty, f"file://{tmp_path}/i")
    assert vector_index.knn(vector_index.load(spark, f"file://{tmp_path}/i"), [1.0], 3)[0].collect() == []
