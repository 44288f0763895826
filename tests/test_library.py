"""PDF texts and libraries of documents."""

import os
import time
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recallgrid.operators import documents
from recallgrid.sources import library, pdf

LINES = st.text(st.characters(exclude_categories=["Cs", "Cc"]), max_size=20)


def plain(text):
    lines = (" ".join(line.replace("\t", " ").split(" ")) for line in text.split("\n"))
    import re

    return "\n".join(x for x in (re.sub(" +", " ", line).strip(" ") for line in lines) if x)


@given(st.lists(st.lists(LINES, max_size=4).map("\n".join), max_size=4), st.booleans())
@settings(max_examples=150, deadline=None)
def test_round_trip(pages, packed):
    assert list(pdf.page_texts(pdf.written(pages, packed))) == [(i, plain(p)) for i, p in enumerate(pages, 1)]


@given(st.binary(max_size=300), st.integers(0, 600))
@settings(max_examples=200, deadline=None)
def test_broken_files_end(noise, at):
    """Whatever is in a file, it is read or refused, and ends."""
    good = pdf.written(["one\ntwo", "three"], packed=False)
    for data in (b"%PDF-1.4\n" + noise, good[:at], good[:at] + noise + good[at:]):
        try:
            list(pdf.page_texts(data))
        except Exception as e:  # noqa: BLE001
            assert not isinstance(e, (RecursionError, MemoryError))


def page_of(content, font=b"<< /Type /Font /Subtype /Type1 >>", more=b"", filters=b""):
    return (
        b"%%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Kids [3 0 R] /Resources << /Font << /F 4 0 R >> /XObject << /X 6 0 R >> >> >> endobj\n"
        b"3 0 obj << /Type /Page /Contents [5 0 R] >> endobj 4 0 obj %b endobj\n5 0 obj << %b /Length 7 0 R >> stream\n%b\nendstream endobj %b trailer << /Root 1 0 R >>" % (font, filters, content, more)
    )


def text_of(*args, **kwargs):
    return [t for _, t in pdf.page_texts(page_of(*args, **kwargs))]


def test_operators_of_a_page():
    assert text_of(b"BT /F 10 Tf 1 0 0 1 50 700 Tm [(Wo) -20 (rd) -300 (next)] TJ 0 -12 Td (line) ' ET") == ["Word next\nline"]
    assert text_of(b"BT /F 10 Tf 12 TL (a) Tj (b) ' ET q 1 0 0 1 0 -300 cm BT /F 10 Tf (c) Tj ET Q") == ["a\nb\nc"]
    assert text_of(b"BT /F 10 Tf (a\\\nb\\050\\)(in) \\101) Tj ET BI /W 1 ID \x00(x) Tj EI BT 0 -50 Td (z) Tj ET") == ["ab()(in) A\nz"]
    form = b"6 0 obj << /Subtype /Form /Length 30 >> stream\nBT /F 9 Tf (inside) Tj ET\nendstream endobj"
    assert text_of(b"q 1 0 0 1 0 90 cm /X Do Q BT /F 9 Tf (out) Tj ET", more=form) == ["inside\nout"]
    with pytest.raises(pdf.PdfError, match="deep"):
        text_of(b"/X Do", more=b"6 0 obj << /Subtype /Form >> stream\n/X Do\nendstream endobj")


def test_fonts_and_filters():
    differing = b"<< /Subtype /Type1 /Encoding << /Differences [65 /eacute /fi /uni20AC 97 /z] >> >>"
    assert text_of(b"BT /F 9 Tf (ABCaD) Tj ET", differing) == ["éfi€zD"]
    assert text_of(b"BT /F 9 Tf <80E9> Tj ET", b"<< /Subtype /Type1 /Encoding /WinAnsiEncoding >>") == ["€é"]
    ranges = b"4 0 obj << /Subtype /Type0 /ToUnicode 8 0 R >> endobj 8 0 obj << >> stream\n1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfrange <0001> <0003> <0041> <0010> <0011> [<00660066> <D83DDE00>] endbfrange\nendstream endobj"
    assert text_of(b"BT /F 9 Tf <0001000200030010001100FF> Tj ET", more=ranges) == ["ABCff😀�"]
    said = b"BT /F 9 Tf (packed) Tj ET"
    assert text_of(said.hex().encode() + b">", filters=b"/Filter /ASCIIHexDecode") == ["packed"]
    import base64

    twice = base64.a85encode(zlib.compress(said)) + b"~>"
    assert text_of(twice, filters=b"/Filter [/ASCII85Decode /FlateDecode]") == ["packed"]
    rows = [said[i : i + 5] for i in range(0, len(said), 5)]
    stored, above = b"", bytes(5)
    for row in rows:
        stored, above = stored + b"\x02" + bytes((x - y) & 255 for x, y in zip(row, above, strict=True)), row
    assert text_of(zlib.compress(stored), filters=b"/Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 5 >>") == ["packed"]


def test_what_is_refused():
    good = pdf.written(["text"])
    for data, why in (
        (b"hello", "not a PDF"), (b"%PDF-1.4", "no pages"), (good[: len(good) // 2], "without an end"), (page_of(b"x", filters=b"/Filter /LZWDecode"), "LZWDecode"),
        (page_of(zlib.compress(b"x" * 99)[:-6], filters=b"/Filter /FlateDecode"), "stream"), (page_of(b"x").replace(b"/Root", b"/Encrypt 9 0 R /Root"), "encrypted"),
        (page_of(b"x").replace(b"[3 0 R]", b"[3 0 R 33 0 R]"), "isn't there"),
    ):
        with pytest.raises(pdf.PdfError, match=why):
            list(pdf.page_texts(data))
    # An update at the end of a file counts, and pages that hang in a circle are read once.
    newer = page_of(b"BT (old) Tj ET") + b" 5 0 obj << >> stream\nBT (new) Tj ET\nendstream endobj"
    assert [t for _, t in pdf.page_texts(newer)] == ["new"]
    assert [t for _, t in pdf.page_texts(page_of(b"BT (once) Tj ET").replace(b"[3 0 R]", b"[3 0 R 2 0 R]"))] == ["once"]


class Lines:
    """An extractor of another kind."""

    def extract(self, content):
        if b"bad" in content:
            raise RuntimeError("a bad one")
        return enumerate(content.decode().split("\n"), 1)


def test_library(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "library")
    assert library.refresh(spark, str(folder), root) == {"taken": 0, "gone": 0}
    (folder / "sub").mkdir(parents=True)
    (folder / "a.pdf").write_bytes(pdf.written(["first\npage", "", "third"]))
    (folder / "b.pdf").write_bytes(b"hello")
    (folder / "scan.pdf").write_bytes(pdf.written(["", " "]))
    (folder / "note.txt").write_text("no document")
    (folder / "sub" / "c.pdf").write_bytes(pdf.written(["deep"]))

    def held():
        return sorted(map(tuple, library.pages(spark, root).collect()))

    assert library.refresh(spark, str(folder), root) == {"taken": 4, "gone": 0}
    assert held() == [("a", 1, "first\npage"), ("a", 3, "third"), ("c", 1, "deep")]
    why = {r.source: r.error for r in library.failures(spark, root).collect()}
    assert why["b"] == "not a PDF file" and "OCR" in why["scan"] and len(why) == 2
    assert library.refresh(spark, str(folder), root) == {"taken": 0, "gone": 0}

    # One changed, one mended, one gone, one of a name that another has; what stays is not read again.
    (folder / "a.pdf").write_bytes(pdf.written(["changed now"]))
    (folder / "b.pdf").write_bytes(pdf.written(["mended"]))
    os.utime(folder / "b.pdf", (time.time() + 5,) * 2)
    (folder / "sub" / "c.pdf").unlink()
    (folder / "sub" / "a.pdf").write_bytes(pdf.written(["namesake"]))
    assert library.refresh(spark, str(folder), root) == {"taken": 3, "gone": 1}
    want = [("changed now",), ("mended",), ("namesake",)]
    assert sorted((t,) for _, _, t in held()) == want
    sources = {s for s, _, _ in held()}
    assert "b" in sources and len(sources) == 3 and all(s == "b" or s.endswith("a.pdf") for s in sources)
    library.compact(spark, root)
    assert sorted((t,) for _, _, t in held()) == want and [r.source for r in library.failures(spark, root).collect()] == ["scan"]
    assert [x for x in os.listdir(f"{root}/pages") if x.startswith("version=")] == ["version=3"]
    assert library.refresh(spark, str(folder), root) == {"taken": 0, "gone": 0}
    assert documents.search(documents.index(library.pages(spark, root)), "mend* OR changed", 5).count() == 2


def test_a_run_that_died_counts_for_nothing(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "library")
    folder.mkdir()
    (folder / "a.pdf").write_text("x\ny")
    assert library.refresh(spark, str(folder), root, Lines())["taken"] == 1
    spark.createDataFrame([("p", "s", 1, "left over", None)], "path string, source string, page_number int, content string, error string").write.parquet(f"{root}/pages/version=2")
    assert {r.content for r in library.pages(spark, root).collect()} == {"x", "y"}
    (folder / "b.pdf").write_text("bad")
    library.refresh(spark, str(folder), root, Lines())
    assert {r.content for r in library.pages(spark, root).collect()} == {"x", "y"}
    assert [(r.source, r.error) for r in library.failures(spark, root).collect()] == [("b", "a bad one")]


def test_stream(spark, tmp_path):
    folder, root, check = tmp_path / "in", str(tmp_path / "library"), str(tmp_path / "check")
    folder.mkdir()

    def run():
        q = library.follow(spark, str(folder), root, check, files_per_batch=2)
        q.awaitTermination(120)
        assert q.exception() is None

    for i in range(3):
        (folder / f"f{i}.pdf").write_bytes(pdf.written([f"text {i}"]))
    (folder / "broken.pdf").write_bytes(pdf.written(["x"])[:30])
    run()
    run()
    assert {r.content for r in library.pages(spark, root).collect()} == {"text 0", "text 1", "text 2"}
    (folder / "late.pdf").write_bytes(pdf.written(["late"]))
    run()
    assert library.pages(spark, root).where("content = 'late'").count() == 1
    assert [r.source for r in library.failures(spark, root).collect()] == ["broken"]
    assert library.refresh(spark, str(folder), root) == {"taken": 0, "gone": 0}


def test_too_long(spark):
    files = spark.createDataFrame([("p/a.pdf", "a", 4, b"text"), ("p/b.pdf", "b", 99, b"long")], "path string, source string, length long, content binary")
    got = {r.source: (r.content, r.error) for r in library.extracted(files, Lines(), max_bytes=50).collect()}
    assert got == {"a": ("text", None), "b": (None, "too long")}
