"""Document sources: pages, sections, codes, full-text search, citations."""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.functions.scalars import SMALL_WORDS, title_case  # noqa: F401  title_case is part of this module's surface
from recallgrid.functions.text import tokens
from recallgrid.operators import section_index
from recallgrid.operators.section_index import Index

PAGE_BYTES = 3000
PAGE_MARK = "<<<PAGE {}>>>\n"


def pages(texts: DataFrame) -> DataFrame:
    """(source, text) to (source, page_number, content). Form feeds part pages, whose numbers stay when blank ones go; texts
    without them are packed paragraph by paragraph to pages of about 3000 bytes."""
    clean = F.regexp_replace("text", r"[ \t]+", " ")
    fed = texts.where(F.col("text").contains("\f")).select("source", F.posexplode(F.split(clean, "\f")).alias("pos", "content"))
    fed = fed.select("source", (F.col("pos") + 1).alias("page_number"), F.trim(F.regexp_replace("content", r"^\s+|\s+$", "")).alias("content")).where("content != ''")

    # An ordered fold: close a page when the next paragraph would overfill it.
    def pack(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        over = (F.octet_length(last) + F.octet_length(p) + 2 > PAGE_BYTES) & (last != "")
        joined = F.when(last == "", p).otherwise(F.concat(last, F.lit("\n\n"), p))
        return F.when(over, F.concat(acc, F.array(p))).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined)))

    paragraphs = F.filter(F.transform(F.split(clean, "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    packed = texts.where(~F.col("text").contains("\f")).select("source", F.posexplode(F.aggregate(paragraphs, F.array(F.lit("")), pack)).alias("pos", "content"))
    return fed.unionByName(packed.where("content != ''").select("source", (F.col("pos") + 1).alias("page_number"), "content"))


def codes(text: Column | str) -> Column:
    """Diagnosis codes in order, repeats kept."""
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(r"F\d{2}(?:\.\d{1,2})?"), F.lit(0))


@dataclass(frozen=True)
class Head:
    """A heading that stands on a page. It ends the open headings of its own and deeper levels; level 0 ends all and opens none."""

    at: int
    title: str
    level: int = 0
    under: tuple[int, ...] = ()
    kind: str = "other"
    codes: tuple[str, ...] = ()


class Profile(Protocol):
    """How a kind of document is told and cut into sections. A heading stands on one page. parts names the sections that a
    stretch of text adds to the section it stands in."""

    id: str
    first_page: int

    def matches(self, name: Column, sample: Column) -> Column: ...

    def heads(self, text: str) -> list[Head]: ...

    def parts(self, text: str) -> set[str]: ...

    def sections(self, pages: list[tuple[int, str]], before: dict[int, str] | None = None, own: int | None = None) -> list[dict]: ...


def _pages_at(full: str) -> list[tuple[int, int]]:
    return [(m.start(), int(m[1])) for m in re.finditer(r"<<<PAGE (\d+)>>>", full)]


def _mark_end(mark: tuple[int, int]) -> int:
    return mark[0] + len(PAGE_MARK.format(mark[1])) - 1


def _page_of(marks: list[tuple[int, int]], at: int) -> int:
    """The page of the last mark that ends before an offset; 1 if there is none."""
    i = bisect_right(marks, at, key=_mark_end)
    return marks[i - 1][1] if i else 1


@dataclass(frozen=True)
class Heading:
    """A kind of heading. Its level ends the open headings of its own and deeper levels; its parent is the open heading of the
    first of the levels in under that has one. Level 0 stands alone and ends all. With coded, its first groups are codes."""

    pattern: str
    level: int
    title: Callable[..., str]
    under: tuple[int, ...] = ()
    kind: str = "other"
    coded: tuple[int, ...] = ()


def _laid(profile: Profile, pages: list[tuple[int, str]], own: int | None) -> tuple[str, list[tuple[int, int]], list[tuple[int, int, Head]]]:
    """The pages as one text with their marks, the marks' places, and the headings of the first own pages (all, if None) with where
    their sections begin and end."""
    parts, found, at = [], [], 0
    own = len(pages) if own is None else own
    for i, (n, text) in enumerate(pages):
        mark = PAGE_MARK.format(n)
        found += [(at + len(mark) + h.at, i < own, h) for h in profile.heads(text)]
        parts.append(mark + text)
        at += len(mark) + len(text) + 1
    full = "\n".join(parts)
    ends = [*(x[0] for x in found[1:]), len(full)]
    return full, _pages_at(full), [(a, end, h) for (a, mine, h), end in zip(found, ends, strict=False) if mine]


class Headed:
    """A profile whose sections are told by forms of headings, each from its place to the next heading; those before first_page are
    left out."""

    HEADINGS: list[Heading] = []
    first_page = 1

    def heads(self, text: str) -> list[Head]:
        found = sorted(((m.start(), i, m) for i, h in enumerate(self.HEADINGS) for m in re.finditer(h.pattern, text, re.M)), key=lambda x: x[:2])
        out = []
        for at, i, m in found:
            h, groups = self.HEADINGS[i], [g.strip() for g in m.groups()]
            out.append(Head(at, h.title(*groups), h.level, h.under, h.kind, tuple(groups[k] for k in h.coded)))
        return out

    def parts(self, text: str) -> set[str]:
        return set()

    def sections(self, pages: list[tuple[int, str]], before: dict[int, str] | None = None, own: int | None = None) -> list[dict]:
        full, marks, found = _laid(self, pages, own)
        open_, out = dict(before or {}), []
        for at, end, head in found:
            parent = next((open_[x] for x in head.under if x in open_), None)
            open_ = _opened(open_, head)
            row = {"title": head.title, "parent": parent, "page_start": _page_of(marks, at), "page_end": _page_of(marks, end), "content": re.sub(r"<<<PAGE \d+>>>\n?", "", full[at:end])}
            if row["page_start"] >= self.first_page:
                out.append(row | {"codes": list(head.codes), "section_type": head.kind})
        return out


def _opened(open_: dict[int, str], head: Head) -> dict[int, str]:
    """The open headings after one more."""
    left = {x: t for x, t in open_.items() if x < head.level}
    return left | {head.level: head.title} if head.level else left


class Handbook(Headed):
    """Numbered sections in chapters in parts. From page 11 on, as the table of contents before has the same form."""

    id = "dsm5trhandbook"
    # The forms of headings, and the first page of content.
    HEADINGS = [
        Heading(r"(?i)^part\s+(\d+)\s*:\s*(.+?)$", 1, "Part {}: {}".format),
        Heading(r"(?i)^chapter\s+(\d+)\s*:\s*(.+?)$", 2, "Chapter {}: {}".format, (1,)),
        Heading(r"^(\d+)\.(\d+)\s+([A-Z][^\n]+?)$", 3, "{}.{} {}".format, (2,)),
        Heading(r"^(\d+)\.(\d+)\.(\d+)\s+([A-Z][^\n]+?)$", 4, "{}.{}.{} {}".format, (3,)),
    ]
    first_page = 11

    def matches(self, name: Column, sample: Column) -> Column:
        low = F.lower(name)
        return low.contains("handbook") & (low.contains("dsm") | low.contains("diagnostic"))


class Classification(Headed):
    """Codes and their titles in blocks in chapters, from page 44 on."""

    id = "icd11"
    # The forms of headings, and the first page of content.
    HEADINGS = [
        Heading(r"^CHAPTER\s+(\d{2})\s*\n+([A-Z][^\n]+?)$", 1, "Chapter {}: {}".format),
        Heading(r"^([A-Z][A-Za-z0-9\s,\-']+?)\s+\(([A-Z0-9]{2,5})-([A-Z0-9]{2,5}(?:\.[A-Z0-9])?)\)\s*$", 2, "{} ({}-{})".format, (1,), coded=(1, 2)),
        Heading(r"^([0-9][A-Z][A-Z0-9]{2})\s+([A-Z][^\n]+?)$", 3, "{} {}".format, (2, 1), "disorder", (0,)),
        Heading(r"^([0-9][A-Z][A-Z0-9]{2}\.[A-Z0-9]+)\s+([A-Z][^\n]+?)$", 4, "{} {}".format, (3, 2), "disorder", (0,)),
    ]
    first_page = 44

    def matches(self, name: Column, sample: Column) -> Column:
        low = F.lower(name)
        return low.contains("icd") & low.contains("11")


class Manual:
    """Disorder entries, each with its standard sub-sections; codes of an entry hold for its sub-sections."""

    id = "dsm5tr"
    # The headers that part an entry, and how entries are told.
    HEADERS = {
        "Diagnostic Criteria": "diagnostic_criteria", "Diagnostic Features": "diagnostic_features", "Associated Features": "associated_features",
        "Development and Course": "development_and_course", "Differential Diagnosis": "differential_diagnosis", "Comorbidity": "comorbidity",
    }
    first_page = 0
    ENTRY = r"^([A-Z][a-zA-Z\-\s,()]+(?:Disorder|Syndrome|Episode|Specifier))\s*$"

    def matches(self, name: Column, sample: Column) -> Column:
        named = F.lower(name).contains("dsm") & F.lower(name).rlike("5|tr")
        return named | sample.rlike("Diagnostic and Statistical Manual|DSM-5-TR|American Psychiatric Association")

    def heads(self, text: str) -> list[Head]:
        return [Head(m.start(), m[0].strip(), kind="disorder") for m in re.finditer(self.ENTRY, text, re.M)]

    def parts(self, text: str) -> set[str]:
        return {h for h in self.HEADERS if h in text}

    def sections(self, pages: list[tuple[int, str]], before: dict[int, str] | None = None, own: int | None = None) -> list[dict]:
        full, marks, found = _laid(self, pages, own)
        out = []

        def row(a, b, title, parent, code, kind):
            return {"title": title, "parent": parent, "page_start": _page_of(marks, a), "page_end": _page_of(marks, b), "content": re.sub(r"<<<PAGE \d+>>>\n?", "", full[a:b]), "codes": code, "section_type": kind}

        for start, end, head in found:
            body, title = full[start:end], head.title
            code = re.findall(r"F\d{2}(?:\.\d{1,2})?", body)
            out.append(row(start, end, title, None, code, head.kind))
            parts = sorted((body.find(h), h) for h in self.HEADERS if h in body)
            for (at, header), to in zip(parts, [*(x for x, _ in parts[1:]), len(body)], strict=False):
                out.append(row(start + at, start + to, f"{title} - {header}", title, code, self.HEADERS[header]))
        return out


def _titled(text: str) -> str:
    """Words in lower case with a capital in front, small ones without."""
    return " ".join(w if w in SMALL_WORDS else w[:1].upper() + w[1:] for w in text.lower().split())


class Ethics(Headed):
    """Numbered standards under numbered parts, from page 3 on."""

    id = "nasw_ethics"
    # The forms of headings, and the first page of content.
    HEADINGS = [
        Heading(r"^(Preamble|Purpose Of The NASW Code Of Ethics|Ethical Principles|Ethical Standards|Overview)\s*$", 0, "{}".format),
        Heading(r"^(\d)\.\s+(SOCIAL WORKERS[''’]?\s+ETHICAL RESPONSIBILITIES[^\n]+)$", 1, lambda n, t: f"{n}. {_titled(t)}"),
        Heading(r"^(\d)\.(\d{2})\s+([A-Z][^\n]+?)$", 2, "{}.{} {}".format, (1,)),
    ]
    first_page = 3

    def matches(self, name: Column, sample: Column) -> Column:
        low = F.lower(name)
        return low.contains("ethics") & (low.contains("nasw") | (low.contains("code") & low.contains("social")))


#: In the order in which they are asked.
PROFILES: list[Profile] = [Handbook(), Manual(), Classification(), Ethics()]
SECTION = "source string, rowid long, profile string, title string, parent string, page_start int, page_end int, content string, codes array<string>, section_type string"


def profiled(paged: DataFrame, profiles: list[Profile]) -> DataFrame:
    """(source, profile) of the sources that a profile knows, by name or by their first five pages; the first that does counts."""
    rank = F.row_number().over(Window.partitionBy("source").orderBy("page_number"))
    firsts = paged.withColumn("rank", rank).where("rank <= 5").groupBy("source").agg(F.array_join(F.collect_list("content"), "\n").alias("sample"))
    known = F.coalesce(*(F.when(p.matches(F.col("source"), F.col("sample")), p.id) for p in profiles), F.lit(None).cast("string"))
    return firsts.select("source", known.alias("profile")).where("profile is not null")


#: Page numbers of a part of a source, and sources whose profiles are broadcast; more are joined by a shuffle.
PART_PAGES, NAMED_SOURCES = 512, 100_000


@dataclass
class Run:
    """What a run of a source's pages does to those after it. first: its first page with a heading; lead: the parts before that;
    rows: its sections, but for the parts of its last heading, which are tail; low: the lowest level that it ends; open: its open
    headings."""

    first: int | None
    lead: set[str]
    rows: int = 0
    tail: set[str] | None = None
    low: int = 0
    open: dict[int, str] | None = None

    def then(self, b: Run) -> Run:
        if b.first is None:
            return Run(None, self.lead | b.lead) if self.first is None else Run(self.first, self.lead, self.rows, self.tail | b.lead, self.low, self.open)
        if self.first is None:
            return Run(b.first, self.lead | b.lead, b.rows, b.tail, b.low, b.open)
        return Run(self.first, self.lead, self.rows + len(self.tail | b.lead) + b.rows, b.tail, min(self.low, b.low), {x: t for x, t in self.open.items() if x < b.low} | b.open)

    def text(self) -> str:
        return json.dumps([self.first, sorted(self.lead), self.rows, sorted(self.tail or ()), self.low, list((self.open or {}).items())])

    @staticmethod
    def of(text: str) -> Run:
        first, lead, rows, tail, low, open_ = json.loads(text)
        return Run(first, set(lead), rows, set(tail), low, dict(map(tuple, open_)))


def _run(profile: Profile, number: int, text: str) -> Run:
    """One page as a run."""
    heads = profile.heads(text)
    if not heads:
        return Run(None, profile.parts(text))
    mark = PAGE_MARK.format(number)
    marks = _pages_at(mark + text)
    out = Run(None, profile.parts(text[: heads[0].at]))
    for head, end in zip(heads, [*(h.at for h in heads[1:]), len(text)], strict=True):
        kept = _page_of(marks, len(mark) + head.at) >= profile.first_page
        out = out.then(Run(number, set(), int(kept), profile.parts(text[head.at : end]), head.level, _opened({}, head)))
    return out


def _carried(parts: DataFrame, by_id: dict[str, Profile]) -> DataFrame:
    """(source, part, first, home, offset, open, rows) of pages (source, profile, part, page_number, tie, text): the first page of a
    part with a heading, the part of the last heading before, the rows and open headings before it, and the source's rows.
    Pages are summed up one by one, then by part, then a source's parts in order; text goes no further than its page."""
    import pandas as pd

    def each(batches):
        for pdf in batches:
            pdf["run"] = [_run(by_id[p], int(n), t).text() for p, n, t in zip(pdf["profile"], pdf["page_number"], pdf["text"], strict=True)]
            yield pdf[["source", "part", "page_number", "tie", "run"]]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out = Run(None, set())
        for text in pdf.sort_values(["page_number", "tie"])["run"]:
            out = out.then(Run.of(text))
        return pd.DataFrame({"source": pdf["source"].iloc[:1], "part": pdf["part"].iloc[:1], "run": out.text()})

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        before, home, told = Run(None, set()), None, []
        for part, text in zip(pdf["part"].tolist(), pdf["run"], strict=True):
            mine = Run.of(text)
            offset = before.rows + len((before.tail or set()) | mine.lead) if before.first is not None else 0
            told.append((mine.first, home, offset, json.dumps(list((before.open or {}).items()))))
            before, home = before.then(mine), home if mine.first is None else part
        out = pd.DataFrame(told, columns=["first", "home", "offset", "open"]).astype({"first": "Int64", "home": "Int64"})
        out["source"], out["part"], out["rows"] = pdf["source"].iloc[0], pdf["part"].to_numpy(), before.rows + len(before.tail or ())
        return out[["source", "part", "first", "home", "offset", "open", "rows"]]

    runs = parts.select("source", "profile", "part", "page_number", "tie", "text").mapInPandas(each, "source string, part long, page_number int, tie long, run string")
    folded = runs.groupBy("source", "part").applyInPandas(fold, "source string, part long, run string")
    return folded.groupBy("source").applyInPandas(carry, "source string, part long, first long, home long, offset long, open string, rows long")


def index(paged: DataFrame, profiles: list[Profile] | None = None) -> DataFrame:
    """Sections of each source whose profile parses, else its pages with negative row ids.

    A source is cut in parts of so many page numbers, which are tasks' groups of their own: each learns the open headings and the
    rows before it, and the pages after it up to the next heading go to it as well, as they belong to its last section. What a
    source passes through one task is a row for each part. Sources without a profile never leave the JVM."""
    import pandas as pd

    known = PROFILES if profiles is None else profiles
    by_id = {p.id: p for p in known}
    names = [c.split()[0] for c in SECTION.split(", ")]

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["page_number", "tie", "own"], ascending=[True, True, False])
        numbered = list(zip(pdf["page_number"].tolist(), pdf["text"].tolist(), strict=True))
        at = pdf.iloc[0]
        rows = by_id[at["profile"]].sections(numbered, dict(map(tuple, json.loads(at["open"]))), int(pdf["own"].sum()))
        for i, r in enumerate(rows, 1):
            r["rowid"] = at["offset"] + i
        out = pd.DataFrame(rows, columns=[c for c in names if c not in ("source", "profile")])
        out["source"], out["profile"] = at["source"], at["profile"]
        return out[names]

    told = profiled(paged, known)
    few = told.limit(NAMED_SOURCES + 1).collect()
    if not few:
        return _bare(paged.withColumn("profile", F.lit("pages")))
    if len(few) <= NAMED_SOURCES:
        told = F.broadcast(paged.sparkSession.createDataFrame(few, "source string, profile string"))
    bare = _bare(paged.join(told, "source", "left_anti").withColumn("profile", F.lit("pages")))
    n = F.col("page_number").cast("int")
    parts = paged.join(told, "source").select("source", "profile", n.alias("page_number"), "content", F.floor(n / PART_PAGES).alias("part"), F.xxhash64("content").alias("tie"), F.coalesce("content", F.lit("")).alias("text"))
    placed = parts.join(_carried(parts, by_id), ["source", "part"])
    to = lambda part, own: F.struct(part.alias("home"), F.lit(own).alias("own"))
    mine = F.when(F.col("page_number") >= F.col("first"), to(F.col("part"), True))
    onward = F.when(F.col("home").isNotNull() & (F.coalesce(F.col("page_number") <= F.col("first"), F.lit(True))), to(F.col("home"), False))
    sent = placed.where("rows > 0").select("source", "profile", "page_number", "tie", "text", "offset", "open", F.explode(F.array_compact(F.array(mine, onward))).alias("to")).select("*", "to.home", "to.own")
    parsed = sent.drop("to").groupBy("source", "home").applyInPandas(build, SECTION)
    return parsed.unionByName(_bare(placed.where("rows = 0"))).unionByName(bare)


def _bare(paged: DataFrame) -> DataFrame:
    """Pages (source, profile, page_number, content) as rows of an index."""
    n = F.col("page_number")
    return paged.select(
        "source",
        (-n).cast("long").alias("rowid"),
        "profile",
        F.concat(F.lit("Page "), n.cast("string")).alias("title"),
        F.lit(None).cast("string").alias("parent"),
        n.cast("int").alias("page_start"),
        n.cast("int").alias("page_end"),
        "content",
        F.array().cast("array<string>").alias("codes"),
        F.lit("page").alias("section_type"),
    )


def page_range(paged: DataFrame, first: int, last: int) -> DataFrame:
    """The pages of each source from first to last."""
    return paged.where(F.col("page_number").between(first, last))


def section(sections: DataFrame, source: str, title: str) -> DataFrame:
    """The first section of a source with exactly this title."""
    return sections.where((F.col("source") == source) & (F.col("title") == title)).orderBy("rowid").limit(1)


def of_type(sections: DataFrame, section_type: str) -> DataFrame:
    return sections.where(F.col("section_type") == section_type)


def titles(sections: DataFrame) -> DataFrame:
    """(source, title) of the top sections, each title once, in the order in which they stand."""
    return sections.where("parent is null").groupBy("source", "title").agg(F.min("rowid").alias("at")).orderBy("source", "at").select("source", "title")


def index_kinds(sections: DataFrame) -> DataFrame:
    """(source, index_type, profile) of each index; pages where a profile has cut nothing."""
    known = F.max(F.col("rowid") > 0)
    return sections.groupBy("source").agg(F.when(known, "sections").otherwise("pages").alias("index_type"), F.when(known, F.max("profile")).otherwise("pages").alias("profile"))


def hydrated(hits: DataFrame, sections: DataFrame) -> DataFrame:
    """Hits (source, rowid, ...) with what they stand for: a positive row is a section, read from the index; any other is a page
    named by its number, without codes."""
    page = -F.col("rowid")
    told = sections.where("rowid > 0").select("source", "rowid", "title", "parent", "page_start", "page_end", "codes", "section_type")
    cut = hits.where("rowid > 0").join(told, ["source", "rowid"])
    bare = hits.where("rowid <= 0").select(
        *hits.columns,
        F.concat(F.lit("Page "), page.cast("string")).alias("title"),
        F.lit(None).cast("string").alias("parent"),
        page.cast("int").alias("page_start"),
        page.cast("int").alias("page_end"),
        F.array().cast("array<string>").alias("codes"),
        F.lit("page").alias("section_type"),
    )
    return cut.select(*bare.columns).unionByName(bare)


def codes_of(text: Column | str) -> Column:
    """Codes of a JSON list; none where it can't be read."""
    return F.coalesce(F.from_json(F.col(text) if isinstance(text, str) else text, "array<string>"), F.array().cast("array<string>"))


def related(sources: DataFrame, name: str) -> DataFrame:
    """A source and those that its sidecar names, which exist."""
    named = sources.where(F.col("source") == name).select(F.explode(F.concat(F.array("source"), F.coalesce("related_sources", F.array().cast("array<string>")))).alias("source")).distinct()
    return named.join(sources.select("source"), "source", "left_semi")


def search_related(sections: DataFrame | Index, sources: DataFrame, name: str, query: str, limit: int = 10) -> DataFrame:
    """search over a source and its related ones, with the statistics of these; sources without an index give nothing."""
    return search(sections, query, limit, sources=related(sources, name))


def search_type(sections: DataFrame | Index, query: str, section_type: str, limit: int = 10) -> DataFrame:
    """search among the sections of a type, with shorter snippets; sources that are indexed by page are searched as they are."""
    rows = sections.sections if isinstance(sections, Index) else sections
    cut = index_kinds(rows).where("index_type = 'sections'").select("source")
    return search(sections, query, limit, F.col("section_type") == section_type, cut, 32)


def parse_query(query: str) -> tuple[list[list[str]], object]:
    """The phrases of a full-text query, and the query as a tree: a phrase's number, or (operator, left, right)."""
    found = section_index.parse(query)
    return [list(p.words) for p in found.phrases], found.tree


#: Hits that are named to the scan of their sections; more are joined.
NAMED_HITS = 1000


def search(sections: DataFrame | Index, query: str, limit: int = 10, keep: Column | None = None, keep_in: DataFrame | None = None, width: int = 40, sources: DataFrame | None = None) -> DataFrame:
    """(source, rowid, title, snippet, score) over title, content and codes, best first over all sources, or the given ones. What keep
    names, in the sources of keep_in (all, if none), is shown; statistics are of all sections. Sections are a stored
    index, or a frame that is searched as it is."""
    asked = section_index.parse(query)
    index = sections if isinstance(sections, Index) else section_index.of(sections)
    rows = index.sections
    if asked.tree is None:
        return rows.select("source", "rowid", "title", F.lit("").alias("snippet"), F.lit(0.0).alias("score")).where("false")
    allowed = None
    if keep is not None:
        shown = rows.where(keep)
        allowed = shown.select("doc") if keep_in is None else shown.join(keep_in, "source", "left_semi").select("doc").union(rows.join(keep_in, "source", "left_anti").select("doc"))
    top = section_index.ranked(index, asked, limit, allowed, sources)
    if index.blocks is not None and limit <= NAMED_HITS:  # few hits: their sections alone are read
        best = top.collect()
        rows = rows.where(F.col("doc").isin([r.doc for r in best]))
        top = F.broadcast(rows.sparkSession.createDataFrame(best, top.schema))
    wanted = [w for i in section_index._scoring(asked.tree, asked) for w in asked.phrases[i].words]
    return rows.join(top, "doc").select("source", "rowid", "title", snippet(F.col("content"), wanted, width).alias("snippet"), "score")


def snippet(content: Column, words: list[str], width: int = 40) -> Column:
    """Forty words around the first hit, hits marked, dots where text is left out."""
    parts = F.filter(F.split(content, r"\s+"), lambda w: w != "")
    low = [w.lower() for w in words]

    def hit(w: Column) -> Column:
        return F.exists(tokens(w), lambda t: t.isin(*low))

    first = F.coalesce(F.array_min(F.transform(parts, lambda w, i: F.when(hit(w), i + 1))), F.lit(1))
    start = F.greatest(F.lit(1), F.least(first - width // 2, F.size(parts) - width + 1))
    shown = F.transform(F.slice(parts, start, width), lambda w: F.when(hit(w), F.concat(F.lit(">>>"), w, F.lit("<<<"))).otherwise(w))
    return F.concat(F.when(start > 1, "...").otherwise(""), F.array_join(shown, " "), F.when(F.size(parts) >= start + width, "...").otherwise(""))
