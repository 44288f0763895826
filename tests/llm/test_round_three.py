"""Sharding, collocations and the prefix trie against plain Python on small tables that hold every odd case."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallgrid.llm import collocations, html_text, jaccard_join, prefix_trie, queries, sharding, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard long, slot long, piece int, row string, k0 long, chunk long, words string, hash long, a long, n long"
EXTRA = [7, 8, 9, 10, "r", 11, 12, "w", 13, 14, 15]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None, *EXTRA) for i, t, lang in rows], DOCS).repartition(3)


def corpus():
    rng = random.Random(11)
    rows = [(None, None, None), (None, None, None), (1, "", "en"), (2, " \t\n", "en"), (3, "x" * 30_000, "en"), (4, " ".join(["la"] * 3000), None), (5, "É naïve 日本\t日本", "und")]
    rows += [(10 + k, "the same text again and again, and again", "en") for k in range(150)] + [(10, "the same text again and again, and again", "en")] * 20
    rows += [(1000 + k, " ".join(rng.choice(["of", "the", "New", "York", "city", "a.b", "Rain;", "x"]) for _ in range(rng.randrange(60))), rng.choice(["en", "de", None])) for k in range(200)]
    return rows


def plain_sizes(rows):
    return sorted((i if i is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)


@pytest.mark.parametrize("tolerance", [0.0, 0.001, 0.2])
def test_sharding(spark, tolerance):
    rows = corpus()
    docs = docs_of(spark, rows)
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 1
    dealt = sharding.sharded(docs, size, by=[F.coalesce("text", F.lit(""))], ident=F.col("doc_id"), shards=5, tolerance=tolerance, piece_rows=20)
    found = dealt.select("row.doc_id", "row.text", "size", "shard", "slot", F.xxhash64(F.coalesce("row.text", F.lit(""))).alias("h"), F.xxhash64("row.doc_id").alias("g")).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, zlib.crc32((r.text or "").encode())) for r in found) == plain_sizes(rows)
    by_shard = defaultdict(list)
    for r in found:
        by_shard[r.shard].append(r)
    total, largest = sum(r.size for r in found), max(r.size for r in found)
    below = 0
    for shard in range(5):
        mine = sorted(by_shard[shard], key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine)))
        below += sum(r.size for r in mine)
        # A boundary lies within the tolerance, or at the nearer side of the row that the share's end falls into.
        assert abs(below - total * (shard + 1) / 5) <= max(total / 5 * tolerance, largest / 2) + 1e-6
    order = [(r.h, r.g) for r in sorted(found, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    again = Counter((r.shard, r.slot, r.doc_id, r.text) for r in found)
    docs = docs_of(spark, rows[::-1]).repartition(7)
    second = sharding.sharded(docs, size, by=[F.coalesce("text", F.lit(""))], ident=F.col("doc_id"), shards=5, tolerance=tolerance, piece_rows=50)
    assert Counter((r.shard, r.slot, r.doc_id, r.text) for r in second.select("shard", "slot", "row.doc_id", "row.text").collect()) == again


def test_sharding_ends(spark, tmp_path):
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 1
    assert sharding.sharded(docs_of(spark, []), size, [F.col("text")], F.col("doc_id")).count() == 0
    one = sharding.sharded(docs_of(spark, [(1, "a", "en")]), size, [F.col("text")], F.col("doc_id"), shards=16).collect()
    assert [(r.slot, r.size) for r in one] == [(0, 2)]
    # One group of copies is all there is: it is cut evenly.
    same = sharding.sharded(docs_of(spark, [(7, "copy", "en")] * 400), size, [F.col("text")], F.col("doc_id"), shards=8, piece_rows=30)
    assert sorted(r["count"] for r in same.groupBy("shard").count().collect()) == [50] * 8
    sharding.write_shards(sharding.sharded(spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id long, text string"), size, [F.col("text")], F.col("doc_id"), shards=4), f"file://{tmp_path}/shards")
    assert spark.read.parquet(f"file://{tmp_path}/shards").select("doc_id").distinct().count() == 50


def test_splitters_find_the_exact_place(spark):
    """Against a sort of all rows: with no tolerance, each boundary is the nearest one that there is."""
    rng = random.Random(3)
    rows = [(rng.choice([-(1 << 63), (1 << 63) - 1, 0, rng.getrandbits(64) - (1 << 63)]), rng.choice([-1, 5]), i, rng.choice([0, 1, 1, 50])) for i in range(500)]
    frame = spark.createDataFrame(rows, "k0 long, k1 long, k2 long, size long")
    ends, pieces = sharding.splitters(frame, 7, 0.0, piece_rows=60)
    ordered = sorted(rows)
    sums = [0]
    for r in ordered:
        sums.append(sums[-1] + r[3])
    for k, (_, below) in enumerate(ends, 1):
        assert abs(sums[below] - sums[-1] * k / 7) == min(abs(s - sums[-1] * k / 7) for s in sums)
    assert len(pieces) == 7 and all(abs(n - 60 * k) <= 15 for k, (_, n) in enumerate(pieces, 1))


def plain_collocations(rows, max_n=4, least=30, overlap=80, top=2000):
    f, total = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, max_n + 1):
                for i in range(len(words) - n + 1):
                    f[lang, tuple(words[i : i + n])] += 1
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = defaultdict(list)
    for (lang, p), a in candidates.items():
        inside = (c for (g, q), c in candidates.items() if g == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
        if any(100 * c >= overlap * a for c in inside):
            continue
        cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, total[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1))


@pytest.mark.parametrize(("least", "top", "max_n"), [(30, 2000, 4), (3, 5, 3), (12, None, 6)])
def test_collocations(spark, least, top, max_n):
    rows = corpus()
    found = collocations.collocations(docs_of(spark, rows), max_n=max_n, least=least, top=top, chunk_bytes=3000)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    told = sorted(map(tuple, found.collect()))
    assert told and told == plain_collocations(rows, max_n, least, top=top or 10**9)


def test_grams_that_share_one_hash_are_told_apart():
    """Pairs of hashes part what either of them alone does not."""
    one, two = np.array([5, 5, 7, 5, 7]), np.array([1, 2, 1, 1, 1])
    first, count = collocations._distinct(one, two)
    assert sorted(zip(one[first].tolist(), two[first].tolist(), count.tolist(), strict=True)) == [(5, 1, 2), (5, 2, 1), (7, 1, 2)]
    assert all(len(x) == 0 for x in collocations._distinct(one[:0], two[:0]))
    words = [f"w{i}" for i in range(5000)]
    hashes = collocations._hashes(words, "en")
    assert len(set(map(tuple, hashes.T.tolist()))) == 5001 and not (hashes[:, 1:] == collocations._hashes(words, "de")[:, 1:]).any()


def test_collocations_of_nothing(spark):
    assert collocations.collocations(docs_of(spark, [])).collect() == []
    assert collocations.collocations(docs_of(spark, [(1, None, None), (2, "a b", "en")])).collect() == []


def plain_trie(paths):
    """paths: conv_id to a list of (role, text)."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in kids[p]) if kids[p] else 1
        saved[p] = sum(saved[q] for q in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    digest = {p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest() for p in members}
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], digest[p]) for p, m in members.items()), key=repr)


CONV = "conv_id long, turn long, role string, text string, digest string, chars int, path string, lcp int, key string"


def talk(seed, n=140):
    rng = random.Random(seed)
    rows = []
    for c in list(range(n)) + [200, 205, 299, 5000, 5001]:
        if rng.random() < 0.3:
            rows += [(c, k, "user", "hot") for k in range(3)]  # copies
            continue
        for k in range(rng.randrange(1, 7)):
            rows.append((c, rng.choice([k, k, k, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "naïve 日本", "long " * 30])))
    rows += [(3, k, "user", "deep") for k in range(300)] + [(None, 1, "user", "lost")] + rows[:4]
    rng.shuffle(rows)
    return rows


def plain_paths(rows, graft=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), role, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), text))
    own = {c: [(r, t) for _, r, _, t in sorted(x)] for c, x in own.items()}
    if not graft:
        return own
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, "p", 2, "k") for r in rows], CONV)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, seed):
    rows = talk(seed)
    small = {"run_bytes": 2000, "most_waiting": 3} if seed == 1 else {}
    seqs = prefix_trie.sequences(conversations(spark, rows).repartition(5))
    found = prefix_trie.prefix_trie(prefix_trie.grafted(seqs), **small)
    assert sorted(map(tuple, found.collect()), key=repr) == plain_trie(plain_paths(rows))
    bare = prefix_trie.prefix_trie(seqs)
    assert sorted(map(tuple, bare.collect()), key=repr) == plain_trie(plain_paths(rows, graft=False))
    texts = {(r.conv_id, r.depth): (r.role, r.text) for r in prefix_trie.with_turns(bare, conversations(spark, rows)).collect()}
    assert all(told == (paths[c][d - 1] if d else (None, None)) for paths in [plain_paths(rows, graft=False)] for (c, d), told in texts.items())


def test_trie_of_little(spark):
    assert prefix_trie.prefix_trie(prefix_trie.sequences(conversations(spark, []))).collect() == []
    assert prefix_trie.prefix_trie(prefix_trie.sequences(conversations(spark, [(None, 1, "a", "b")]))).collect() == []
    # All conversations are one: one path, whose last node has all ids, over several ranges.
    rows = [(c, k, "user", f"t{k}") for c in range(300) for k in range(2)]
    found = prefix_trie.prefix_trie(prefix_trie.sequences(conversations(spark, rows)))
    assert sorted(map(tuple, found.collect()), key=repr) == plain_trie(plain_paths(rows, graft=False))


def test_merge_compares_no_shared_turn_twice(monkeypatch):
    """Runs that share a long prefix: the loser tree looks at few turns, and its LCPs are those of a plain sort."""
    rng = random.Random(4)
    turn = [hashlib.sha256(bytes([i])).digest() for i in range(6)]
    rows = [(b"".join(turn[:5] * 10) + b"".join(rng.choice(turn) for _ in range(rng.randrange(4))), i, [1] * 3) for i in range(200)]
    runs = []
    for k in range(7):
        run = sorted(r for r in rows if r[1] % 7 == k)
        runs.append([(p, i, c, prefix_trie.lcp(a[0], p) if a else 0) for a, (p, i, c) in zip([None, *run], run, strict=False)])
    looked = []
    true = prefix_trie.lcp
    monkeypatch.setattr(prefix_trie, "lcp", lambda a, b, known=0: looked.append(true(a, b, known) - known) or true(a, b, known))
    out = list(prefix_trie.merged(runs))
    want = sorted(rows)
    assert [(p, i) for p, i, *_ in out] == [(p, i) for p, i, _ in want]
    assert [s for *_, s in out] == [0, *(true(a[0], b[0]) for a, b in zip(want, want[1:], strict=False))]
    assert sum(looked) < 7 * 53 + 3 * 200 and list(prefix_trie.merged([])) == []


def test_queries_are_there():
    assert {"op11_sharding", "op12_collocations", "op13_prefix_trie"} <= set(queries.queries())


PARAGRAPH = "<p>A paragraph of the page that goes on for quite a while, with many words in it, and ends.</p>"


def test_page_in_a_form():
    inside = PARAGRAPH * 3 + "<input name=q><button>Go</button>"
    for page in (f"<body><form id=aspnetForm action=x>{inside}</form></body>", f"<body><a href=#c>Skip on</a><form>{inside}</form><form><label>Your mail</label><input></form></body>"):
        text = html_text.main_text(f"<html>{page}</html>")
        assert text.count("goes on") == 3 and "Go" not in text and "Your mail" not in text
    # A form beside an article stays furniture, however wordy.
    assert "consent" not in html_text.main_text(f"<article>{PARAGRAPH * 2}</article><form><p>{'I consent to all of it. ' * 9}</p></form>")


def test_lists_and_tables_between_paragraphs():
    listed = "<ul><li>one</li><li>two</li></ul>"
    told = "<table><tr><td>a</td><td>1</td></tr><tr><td>b</td><td>2</td></tr></table>"
    links = "<ul><li><a href=x>Read</a></li><li><a href=y>more</a></li></ul>"
    text = html_text.main_text(f"<body><div id=content>{PARAGRAPH * 2}{listed}{PARAGRAPH * 2}{told}{PARAGRAPH}{links}</div><ul><li>foot</li></ul></body>").split("\n")
    assert [t for t in text if len(t) < 5] == ["one", "two", "a", "1", "b", "2"] and len(text) == 11


def test_sets_without_a_cut_share_the_key_of_their_band(monkeypatch):
    """Where no cut will do, two sets of a band always meet."""
    from fractions import Fraction

    monkeypatch.setattr(jaccard_join, "CUTS", 1)
    rng = np.random.default_rng(2)
    for n in (12, 40, 300):
        one, two = (np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64)) for _ in range(2))
        keys = [jaccard_join.keys_of(x, Fraction(4, 5)) for x in (one, two)]
        assert set(keys[0][0].tolist()) & set(keys[1][0].tolist()) and all(more == 0 for more in keys[0][2])


def plain_toxicity(lexicon, text):
    """The score by looking for each entry with str.find."""
    padded = toxicity.folded(text) + " "
    hits, spared = {}, []
    for term in [*lexicon.weights, *lexicon.exceptions]:
        at = padded.find(term)
        while at >= 0:
            if term in lexicon.exceptions:
                spared.append((at, at + len(term) - 1))
            else:
                hits[at] = max(hits.get(at, 0.0), lexicon.weights[term])
            at = padded.find(term, at + 1)
    hits = [w for b, w in hits.items() if not any(x <= b < y for x, y in spared)]
    a, b, c = lexicon.logistic
    return 1 / (1 + np.exp(-np.clip(a + b * (sum(hits) / np.sqrt(1 + padded.count(" ")) if hits else 0.0) + c * max(hits, default=0.0), -40, 40)))


def test_toxicity_against_plain_search(spark):
    """More entries and exceptions than any fixed number, and scores of all rows, a very long one too."""
    rng = random.Random(9)
    bad = ["".join(rng.choice("bcdfgklm") + rng.choice("aeou") for _ in range(3)) for _ in range(1200)]
    good = [f"word{i}" for i in range(300)]
    rows = [(" ".join(rng.choice(good) for _ in range(12)) + (" " + " ".join(rng.sample(bad, 40)) if k % 2 else ""), k % 2) for k in range(900)]
    lexicon = toxicity.learned(rows)
    assert len(lexicon.weights) > 2000
    texts = [t for t, _ in rows[:60]] + [None, "", "x" * 50_000, " ".join(good * 50 + bad[:3])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.scored(docs, lexicon).collect()}
    assert all(got[i] == pytest.approx(plain_toxicity(lexicon, t or "")) for i, t in enumerate(texts))
    assert toxicity.scored(docs.limit(0), lexicon).count() == 0
