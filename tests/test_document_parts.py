"""Sources are cut in parts of their pages; sections, parents, row ids and pages are those of one pass over all pages."""

import random
import time

from recallgrid.operators import documents


def pages_of(seed: int, n: int) -> list[tuple[str, int, str]]:
    draw = random.Random(seed)
    lines = {
        "dsm handbook": ["Part 1: One", "Chapter 2: Two", "2.1 Title", "2.1.3 Inner", "text", "more text"],
        "icd-11 list": ["CHAPTER 07\nSleep", "Insomnia (7A00-7A0Z)", "7A01 Chronic", "7A01.1 Mild", "text <<<PAGE 99>>>", "words"],
        "nasw ethics": ["Preamble", "1. SOCIAL WORKERS' ETHICAL RESPONSIBILITIES TO ALL", "1.01 Duty", "text", "so on"],
        "dsm5 manual": ["Sleep Disorder", "Diagnostic Criteria", "Comorbidity", "F10.1 text", "1 more F20", "2 words"],
    }
    rows = []
    for source, forms in lines.items():
        for number in range(1, n):
            if draw.random() < 0.9:
                few = draw.random() < 0.7
                rows.append((source, number * 3 if source == "icd-11 list" else number, "\n".join(draw.choice(forms[-2:] if few else forms) for _ in range(draw.randint(0, 4)))))
    return rows


def whole(rows):
    """Each source in one pass."""
    out = []
    for profile in documents.PROFILES:
        source = {"dsm5trhandbook": "dsm handbook", "dsm5tr": "dsm5 manual", "icd11": "icd-11 list", "nasw_ethics": "nasw ethics"}[profile.id]
        for i, r in enumerate(profile.sections(sorted((n, t) for s, n, t in rows if s == source)), 1):
            out.append((source, i, r["title"], r["parent"], r["page_start"], r["page_end"], r["content"], tuple(r["codes"]), r["section_type"]))
    return sorted(out, key=lambda x: x[:2])


def test_parts_agree_with_one_pass(spark, monkeypatch):
    monkeypatch.setattr(documents, "PART_PAGES", 4)
    for seed in (1, 2):
        rows = pages_of(seed, 90)
        df = spark.createDataFrame(rows, "source string, page_number int, content string").repartition(3)
        got = sorted(((r.source, r.rowid, r.title, r.parent, r.page_start, r.page_end, r.content, tuple(r.codes), r.section_type) for r in documents.index(df).collect()), key=lambda x: x[:2])
        assert got == whole(rows)
    monkeypatch.setattr(documents, "NAMED_SOURCES", 1)
    assert documents.index(df).count() == len(got)


def test_known_source_without_sections(spark):
    df = spark.createDataFrame([("nasw ethics", 5, "text"), ("nasw ethics", 700, None), ("x", 1, "y")], "source string, page_number int, content string")
    got = {(r.source, r.rowid, r.profile, r.section_type, r.content) for r in documents.index(df).collect()}
    assert got == {("nasw ethics", -5, "nasw_ethics", "page", "text"), ("nasw ethics", -700, "nasw_ethics", "page", None), ("x", -1, "pages", "page", "y")}


def test_a_long_source_is_no_square():
    pages = [(n, f"PART {n}: Of {n}\nbody\n{n}.1 Title\ntext") for n in range(11, 40_000)]
    began = time.time()
    assert len(documents.Handbook().sections(pages)) == 2 * len(pages)
    assert time.time() - began < 20
