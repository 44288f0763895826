"""n-grams of op12 are made into rows only where their shorter parts are frequent."""

import glob
import random

import pyarrow.parquet as pq

from recallgrid.llm import collocations, common
from recallgrid.llm.common import written


def test_only_grams_of_frequent_parts_are_counted(spark):
    draw = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    texts = [(" ".join(draw.choice(words) for _ in range(200)) + " of the old house", lang) for lang in ("en", "de") for _ in range(60)]
    docs = spark.createDataFrame(texts, "text string, lang string")
    chunks = written(collocations.chunked(docs, 3000), "chunks")
    before = collocations.hashed_grams(chunks, 3).agg({"n": "sum"}).first()[0]
    known = spark.sparkContext.broadcast(collocations.map_of(collocations.frequent_grams(chunks, 2, 30)))
    after = collocations.hashed_grams(chunks, 3, known).agg({"n": "sum"}).first()[0]
    assert before > 24_000 and 240 <= after <= 260
    every = {(r.one, r.two, r.a) for r in collocations.frequent_grams(chunks, 3, 30).collect()}
    told = collocations.frequent_grams(chunks, 3, 30, known).collect()
    assert len(told) == 4 and {(r.one, r.two, r.a) for r in told} == every
    # Each is spelt by a chunk that holds it, not all by the first.
    assert collocations.phrases_of(chunks, collocations.frequent_grams(chunks, 3, 30, known)).count() == 4
    spellers = {r.chunk for r in collocations.frequent_grams(chunks, 1, 30).collect()}
    assert len(spellers) > 4


def test_row_groups_of_chunks_are_few_rows(spark, monkeypatch):
    """A task that writes or reads many chunks holds a few of them at once, not a hundred."""
    draw = random.Random(5)
    docs = spark.createDataFrame([(" ".join(f"w{draw.randrange(500)}" for _ in range(300)), "en") for _ in range(60)], "text string, lang string").coalesce(1)
    monkeypatch.setattr(collocations, "LARGE_ROWS", collocations.LARGE_ROWS | {"parquet.block.size": 16 << 10})
    collocations.collocations(docs, chunk_bytes=2000)
    path = next(p for p in reversed(common._written) if "/chunks-" in p).removeprefix("file://")
    footers = [pq.ParquetFile(f).metadata for f in glob.glob(f"{path}/*.parquet")]
    groups = [m.row_group(i).num_rows for m in footers for i in range(m.num_row_groups)]
    assert sum(groups) > 20 and max(groups) <= 6
