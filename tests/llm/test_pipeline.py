"""The pipeline's stages, one after another, against plain Python."""

import hashlib
import math
import random
import re
import struct
from collections import defaultdict

import sentencepiece
import xxhash
from pyspark.sql import Row

import corpus_pipeline
from recallgrid.llm import mixing, toxicity
from recallgrid.llm.queries import tokenizer_model

from .test_operators import DOCS, WORD, brute_components, corpus, row, water_levels


def test_stages(spark, tmp_path):
    rows = corpus() + [row(200 + i, f"plain words number {i} you idiot{i % 2}") for i in range(40)] + [row(300 + i, f"quite other words {i} here") for i in range(60)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(200, 240)] + [(i, 0, 1) for i in range(300, 360)] + [(i, 0, 1) for i in range(10)]
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    lexicon = toxicity.fitted(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    left = [r for r in rows if lexicon.score(r[1] or "") < 0.5]
    assert len(left) < len(rows)
    stages = dict(corpus_pipeline.STAGES)
    assert len(corpus_pipeline.STAGES) == 5

    def ran(name, frame):
        out = stages[name](spark, frame, str(tmp_path))
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        return spark.read.parquet(path)

    kept = ran("toxicity", docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in left)
    seen, firsts = set(), []
    for r in sorted(left, key=lambda r: r[0]):
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")
        if norm not in seen:
            seen.add(norm)
            firsts.append(r)
    kept = ran("exact_dedup", kept)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [r[0] for r in firsts]
    groups = brute_components(firsts, 5, 80, 100)
    kept = ran("ngram_jaccard_join", kept)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in groups.items() if i == c)
    ids = {r.doc_id for r in kept.collect()}
    kept = ran("source_mixing", kept)
    mixed = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and set(mixed) <= ids and max(map(mixed.count, ids)) <= 2
    last = ran("sentencepiece", kept)
    assert sorted(r.doc_id for r in last.collect()) == sorted(mixed)


ONE = 1 << 24


def drawn(rows):
    """Copies of each row of (id, text, source) by systematic sampling, in plain Python: its order within the source is by size and id."""
    size = lambda r: len(WORD.findall(r[1] or ""))
    sources = defaultdict(list)
    for r in rows:
        sources[r[2]].append(r)
    want = water_levels({s: sum(map(size, x)) for s, x in sources.items()})
    out = []
    for s, own in sources.items():
        total = sum(map(size, own))
        step = min(2 * ONE, math.floor(want[s] / total * ONE + 0.5)) if total else 0
        seed = xxhash.xxh64_intdigest(b"mix", seed=42)
        upto = xxhash.xxh64_intdigest((s if s is not None else "\0").encode(), seed=seed) % ONE
        for r in sorted(own, key=lambda r: (-size(r), r[0] is not None, r[0] or 0)):
            upto += step
            out += [r] * (upto // ONE - (upto - step) // ONE)
    return out


def test_draw(spark):
    rows = [(i, " ".join(["w"] * (i * 7 % 23)), ("a", "b", None)[i % 3]) for i in range(200)]
    got = mixing.emitted(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)))
    assert sorted(map(str, got.collect())) == sorted(str(got_row) for got_row in map(lambda r: Row(doc_id=r[0], text=r[1], source=r[2]), drawn(rows)))


def test_whole_pipeline(spark, tmp_path):
    """run() against plain Python from end to end, over rows that share ids, repeated rows, and null ids and texts."""
    rng = random.Random(8)
    near = [str(rng.random()) for _ in range(150)]
    rows = [(r[0], r[1], r[2], r[3], r[4]) for r in corpus() if r[0] < 90]
    rows += [(3, "alpha beta", "en", "a", 1), (5, "alpha  beta", "en", "b", 1), (5, "a wholly unique text", "en", "b", 1)] + [(9, "same row", "en", "a", 1)] * 2
    rows += [(300, " ".join(near), "en", "a", 1), (300, " ".join([*near[:-1], "end"]), "en", "a", 1), (301, " ".join(["begin", *near[1:]]), "en", "b", 1)]
    rows += [(None, "no id", "en", "a", 1), (None, "no id", "en", "a", 1), (None, None, None, None, None)]
    rows += [(400 + i, f"plain words number {i} you idiot{i % 2}", "en", "a", 1) for i in range(40)] + [(500 + i, f"quite other words {i} here", "en", None, 1) for i in range(60)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kind).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(400, 440)] + [(i, 0, 1) for i in range(500, 560)] + [(i, 0, 1) for i in range(10, 20)]
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")

    lexicon = toxicity.fitted(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    left = [r for r in rows if lexicon.score(r[1] or "") < 0.5]
    order = lambda r: (r[0] is None, r[0] or 0, tuple((x is not None, x) for x in r))
    texts = {}
    for r in sorted(left, key=order):
        texts.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), r)
    firsts = sorted(texts.values(), key=order)
    groups = brute_components([(k, r[1]) for k, r in enumerate(firsts)], 5, 80, 100)  # by row: positions are ids of their own, in order
    kept = {}
    for k, (_, c) in groups.items():
        kept.setdefault(c, []).append(firsts[k])
    # Of one id the order within a group is by hash, so any of that id's rows may stay.
    best = [[r for r in own if r[0] == own[0][0]] for own in kept.values()]
    library = sentencepiece.SentencePieceProcessor(model_proto=tokenizer_model())

    def digest(text):
        ids = [library.bos_id(), *library.encode(text or ""), library.eos_id()]
        return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()

    got = sorted(map(str, ((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())))
    assert sum(len(x) > 1 for x in best) == 1
    choices = [[x[0] for x in best]] + [[x[-1] for x in best]]
    assert any(got == sorted(str((r[0], *digest(r[1]))) for r in drawn([(r[0], r[1], r[3]) for r in chosen])) for chosen in choices)
