"""File sources."""

from recallgrid.sources import files


def test_lenses_and_manifests(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Title here\n\nBody\nmore")
    (tmp_path / "b.md").write_text("no heading")
    (tmp_path / "c.md").write_text("# only")
    got = {r.name: (r.description, r.body) for r in files.lenses(spark, str(tmp_path)).collect()}
    assert got == {"a": ("Title here", "Body\nmore"), "b": ("", "no heading"), "c": ("", "# only")}
    (tmp_path / "x.toml").write_text('[meta]\nname="n"\nversion="1"\n[instructions]\ncontent="do"')
    (tmp_path / "y.toml").write_text('[meta]\nname="n"\nversion=""\n[instructions]\ncontent="do"')
    (tmp_path / "z.toml").write_text("not toml =")
    assert [tuple(r) for r in files.manifests(spark, str(tmp_path)).collect()] == [("n", "1", "do")]
    assert files.lens_name("a b/ç-1") == "abç-1" and files.lens_name("//") is None


def test_sidecars_and_documents(spark, tmp_path):
    (tmp_path / "s.meta.json").write_text('{"citation": {"author": "A", "year": "2020"}, "related_sources": ["t"]}')
    (tmp_path / "bad.meta.json").write_text("{")
    got = {r.source: r for r in files.sidecars(spark, str(tmp_path)).collect()}
    assert got["s"].citation.author == "A" and got["s"].related_sources == ["t"] and got["bad"].citation is None
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "e.pdf").write_bytes(b"hello")
    docs = files.document_files(spark, str(tmp_path))
    assert {r.source: r.error for r in docs.collect()} == {"d": None, "e": "not a PDF file"}
    assert files.stale(docs, docs.where("source = 'd'")).count() == 1


def test_settings():
    s = files.settings('[brain]\nsearch_min_score = 2.0\nrerank_candidates = 1\ndecay_rate_per_day = 1\nother = 3\ndebug = true')
    assert (s.search_min_score, s.rerank_candidates, s.decay_rate_per_day, s.debug) == (1.0, 5, 0.05, True)
    assert files.settings("= nonsense") == files.Settings()
    assert files.sanitized_copy_name("a.pdf", {"a.pdf", "a_2.pdf"}) == "a_3.pdf"
