"""Registered queries against their SQL on the smallest tables, as the driver does on larger ones."""

import math
import os

import duckdb
import pytest

from recallgrid.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    frame = registry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    found = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted(repr(tuple(plain(r[i]) for i in order)) for r in found.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in frame.collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    rows = registry.queries()[name](spark, SF).collect()
    if name == "diversity_select":
        assert [r.position for r in rows] == list(range(1, len(rows) + 1))
    if name == "batch_search":
        assert all(r.error is None for r in rows)


def test_anchors_of_whole_texts(spark):
    """Every text is stripped to its end, not only a prefix of it."""
    import re

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.id: r.content for r in registry.queries()["strip_date_anchors"](spark, SF).collect()}
    assert any(len(t) > 1000 for t in texts.values())
    assert got == {i: re.sub(r" \(\d{4}-\d{2}-\d{2}\)", "", f"{t}  and").replace("  ", " ").strip(" ") for i, t in texts.items()}


def test_pages_of_all_documents(spark):
    """Pages by form feed and by packing, against a fold in plain Python."""
    import re

    def stripped(text):
        return re.sub(r"^\s+|\s+$", "", text, flags=re.A).strip(" ")

    want = []
    for i, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        clean = re.sub(r"[ \t]+", " ", text)
        if i % 2 == 0 and "\n" in clean:
            found = [(k, stripped(p)) for k, p in enumerate(clean.split("\n"), 1)]
        else:
            packed = []
            for p in filter(None, map(stripped, clean.split("\n"))):
                if packed and len(f"{packed[-1]}\n\n{p}".encode()) <= 3000:
                    packed[-1] += f"\n\n{p}"
                else:
                    packed.append(p)
            found = list(enumerate(packed, 1))
        want += [(f"doc{i}", k, p) for k, p in found if p]
    got = [(r.source, r.page_number, r.content) for r in registry.queries()["doc_pages_whole"](spark, SF).collect()]
    assert sorted(got) == sorted(want)
    assert len({g[0] for g in got}) == spark.read.parquet(f"{SF}/documents.parquet").where("trim(text) != ''").count()
    assert any(k > 1 and int(s[3:]) % 2 and "\n\n" in p for s, k, p in got)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plan_shape(spark):
    """A keyword scan reads two columns and shuffles no text; a state scan reads no content."""
    from recallgrid.operators import retrieval
    from recallgrid.sources import views

    plan = views.mem(spark, SF, vectors=False).where("state = 'active'").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[1]
    plan = retrieval.bm25(views.mem(spark, SF, vectors=False), "the")._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "SortMergeJoin" not in plan
