"""Queries over documents, texts and search results beyond the plain catalog, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recallgrid.functions import scalars as sc
from recallgrid.operators import documents, graph, retrieval, section_index, sessions
from recallgrid.plans import pipeline
from recallgrid.plans.catalog import ASSOC, MEM, Q0, SESS, SIM, TOKENS, _manual, r6
from recallgrid.plans.registry import query
from recallgrid.sources import library, pdf, views

# --- scalars ------------------------------------------------------------------------------------------------------

PREFIX_SQL = "left({t}, list_max(list_filter(range(0, {n} + 1), lambda k: strlen(left({t}, k)) <= {n}))::BIGINT)"


@query(
    "truncated_texts",
    f"""SELECT doc_id AS id, CASE WHEN strlen(text) <= 30 THEN text ELSE {PREFIX_SQL.format(t='text', n=27)} || '...' END AS short, CASE WHEN strlen(text) <= 40 THEN text ELSE {PREFIX_SQL.format(t='text', n=40)} || '...' END AS hint,
  CASE WHEN strlen(text) <= 2 THEN text ELSE '..' END AS dots FROM documents""",
)
def truncated_texts(spark, d):
    """Byte budgets, dots within them and beyond them, cut at characters."""
    t = views.table(spark, d, "documents")
    return t.select(F.col("doc_id").alias("id"), sc.truncated_bytes("text", 30).alias("short"), sc.chain_hint("text", 40).alias("hint"), sc.truncated_bytes("text", 2).alias("dots"))


@query(
    "query_strings",
    """SELECT page_id AS id, url AS q, page_id::VARCHAR AS n, '100%' AS odd, NULL AS missing, CAST(4 AS INTEGER) AS parts FROM pages""",
)
def query_strings(spark, d):
    """Keys and decoded values of a query string made of each page's address; a percent sign that begins no escape stays."""
    t = views.table(spark, d, "pages")
    text = F.concat(F.lit("q="), F.url_encode("url"), F.lit("&&n="), F.col("page_id").cast("string"), F.lit("&odd=100%&n=second"))
    param = lambda key: sc.query_param(text, key)
    return t.select(F.col("page_id").alias("id"), param("q").alias("q"), param("n").alias("n"), param("odd").alias("odd"), param("missing").alias("missing"), F.size(sc.query_params(text)).alias("parts"))


@query(
    "reference_dates",
    """SELECT event_id AS id, CASE event_id % 3 WHEN 2 THEN NULL ELSE CAST(ts AS DATE) END AS day, CASE event_id % 3 WHEN 2 THEN NULL WHEN 1 THEN strftime(ts, '%Y-%m-%d') || ' (sometime)' ELSE strftime(ts, '%Y-%m-%d') || ' to ' || strftime(ts + INTERVAL 1 DAY, '%Y-%m-%d') END AS said FROM events""",
)
def reference_dates(spark, d):
    """Dates and the dates that longer times begin with; resolved dates and ranges as text."""
    ts, k = F.col("ts").cast("timestamp"), F.col("event_id") % 3
    given = F.when(k == 0, F.date_format(ts, " yyyy-MM-dd ")).when(k == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("next week")
    day = sc.reference_date(given)
    said = sc.format_resolved(day, F.when(k == 0, F.date_add(day, 1)), F.when(k == 1, "sometime"))
    return views.table(spark, d, "events").select(F.col("event_id").alias("id"), day.alias("day"), said.alias("said"))


@query("formatted_memories", f"WITH {MEM} SELECT id, 'ID: ' || id || chr(10) || 'Content: ' || content || chr(10) || 'State: ' || state || ' (energy: ' || printf('%.2f', floor(energy * 10) / 10) || ')' || chr(10) || 'Access count: ' || access_count || chr(10) || 'Created: ' || created_at AS shown, 'english' AS language FROM mem")
def formatted_memories(spark, d):
    m = views.mem(spark, d, vectors=False).withColumn("energy", F.floor(F.col("energy") * 10) / 10)
    return m.select("id", sc.format_memory("id", "content", "state", "energy", "access_count", "created_at").alias("shown"), sc.resolver_language("content").alias("language"))


@query("lens_names", "SELECT page_id AS id, NULLIF(regexp_replace(url, '[^\\p{L}\\p{N}_-]', '', 'g'), '') AS name, NULLIF(regexp_replace('/' || chr(32) || '.', '[^\\p{L}\\p{N}_-]', '', 'g'), '') AS nothing FROM pages")
def lens_names(spark, d):
    return views.table(spark, d, "pages").select(F.col("page_id").alias("id"), sc.lens_name("url").alias("name"), sc.lens_name(F.lit("/ .")).alias("nothing"))


@query(
    "citation_instructions",
    """SELECT p_partkey AS id, '(' || p_brand || ', ' || p_size || ')' AS short, 'When presenting information from ' || p_name || ', always include the APA 7 citation.' || chr(10) || 'Full reference: ' || p_brand || '. (' || p_size || '). *' || p_name || '* ' || p_type || '.' AS told FROM part""",
)
def citation_instructions(spark, d):
    none, year = F.lit(None).cast("string"), F.col("p_size").cast("string")
    reference = sc.citation_reference(F.col("p_brand"), year, F.col("p_name"), none, none, none, F.col("p_type"))
    return views.table(spark, d, "part").select(F.col("p_partkey").alias("id"), sc.citation_short("p_brand", year).alias("short"), sc.citation_instruction("p_name", reference).alias("told"))


@query("vector_round_trip", "SELECT vec_id AS id, CAST(len(embedding) * 4 AS INTEGER) AS n_bytes, true AS same, true AS odd_is_none FROM embeddings")
def vector_round_trip(spark, d):
    """Every vector to bytes and back; bytes whose number is no multiple of four are no vector."""
    v = views.vectors(spark, d).withColumn("bytes", sc.vector_bytes("embedding"))
    same = F.forall(F.arrays_zip(F.col("embedding").alias("a"), sc.vector_of("bytes").alias("b")), lambda x: x["a"] == x["b"])
    return v.select("id", F.octet_length("bytes").alias("n_bytes"), same.alias("same"), sc.vector_of(F.substring("bytes", 1, 7)).isNull().alias("odd_is_none"))


@query(
    "cosine_unequal",
    f"""WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS a, CAST(embedding AS DOUBLE[])[1:60] AS b FROM embeddings) SELECT id, CAST(NULL AS DOUBLE) AS skipped, CAST(0 AS DOUBLE) AS zero,
  ROUND(list_dot_product(a[1:60], b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6) AS zipped FROM v""",
)
def cosine_unequal(spark, d):
    """Vectors against their first sixty components, by each rule for unequal lengths."""
    a, b = F.col("embedding"), F.slice("embedding", 1, 60)
    return views.vectors(spark, d).select("id", sc.cosine(a, b).alias("skipped"), sc.cosine(a, b, "zero").alias("zero"), r6(sc.cosine(a, b, "zip")).alias("zipped"))


JACCARD_SQL = f"""t AS (SELECT id, list_distinct({TOKENS}) AS toks FROM (SELECT doc_id AS id, text AS content FROM documents) m)"""


@query(
    "jaccard_texts",
    f"WITH {JACCARD_SQL} SELECT a.id AS a, b.id AS b, ROUND(CASE WHEN len(a.toks) = 0 OR len(b.toks) = 0 THEN 0 ELSE len(list_intersect(a.toks, b.toks))::DOUBLE / len(list_distinct(list_concat(a.toks, b.toks))) END, 6) AS overlap FROM t a JOIN t b ON b.id = a.id + 1",
)
def jaccard_texts(spark, d):
    """Each text's tokens against the next one's."""
    from recallgrid.functions.text import tokens

    t = views.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array_distinct(tokens("text")).alias("toks"))
    pairs = t.toDF("a", "x").join(t.toDF("b", "y"), F.col("b") == F.col("a") + 1)
    return pairs.select("a", "b", r6(sc.jaccard("x", "y")).alias("overlap"))


# --- documents ----------------------------------------------------------------------------------------------------


def _shelf(spark, d):
    """A page of headings for each document, in sources that each of the four profiles and none of them knows."""
    i = F.col("doc_id")
    kind = F.array(*map(F.lit, ("dsm handbook", "icd-11 list", "nasw ethics", "dsm5 manual", "plain notes")))[(i % 5).cast("int")]
    n, body = i.cast("string"), F.regexp_replace("text", r"[\n\r]", " ")
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    text = (
        F.when(i % 5 == 0, line("PART ", n, ": Of ", n, "\nbody\nChapter ", n, ": On ", n, "\n", n, ".1 Title ", n, "\n", body, "\n", n, ".1.2 Inner ", n, "\nmore"))
        .when(i % 5 == 1, line("CHAPTER 07\nSleep ", n, ".\nInsomnia of ", n, " (7A00-7A0Z)\n7A0", (i % 10).cast("string"), " Chronic ", n, "\n", body, "\n7A0", (i % 10).cast("string"), ".1 Mild ", n, "\nless"))
        .when(i % 5 == 2, line("Preamble\n1. SOCIAL WORKERS' ETHICAL RESPONSIBILITIES TO THE ", F.upper(F.col("lang")), "\n1.0", (1 + i % 9).cast("string"), " Duty ", n, "\n", body))
        .when(i % 5 == 3, line("Test Disorder\nDiagnostic Criteria\nF10 ", body, "\nComorbidity\nnone"))
        .otherwise(body)
    )
    return views.table(spark, d, "documents").select(F.concat(kind, F.lit(" "), (i % 10 / 5).cast("int").cast("string")).alias("source"), (i + 44).cast("int").alias("page_number"), text.alias("content"))


SHELF_SQL = """sh AS (SELECT doc_id, ['dsm handbook', 'icd-11 list', 'nasw ethics', 'dsm5 manual', 'plain notes'][doc_id % 5 + 1] || ' ' || (doc_id % 10 // 5) AS source, doc_id + 44 AS page, lang FROM documents)"""


def _filed(spark, d):
    """A PDF file of each document, three of its lines to a page, in two layouts of files. Of eight files, one lacks the format's
    mark and one breaks off in the middle."""
    import pyarrow as pa

    def write(batches):
        for batch in batches:
            files = []
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                lines = (text or "").split("\n")
                data = pdf.written(["\n".join(lines[k : k + 3]) for k in range(0, len(lines), 3)], packed=i % 2 == 0)
                files.append(data[5:] if i % 8 == 3 else data[: len(data) // 2] if i % 8 == 5 else data)
            names = pa.array([f"doc{i}" for i in batch.column("doc_id").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([names, names, pa.array(map(len, files), pa.int64()), pa.array(files, pa.binary())], ["path", "source", "length", "content"])

    return views.table(spark, d, "documents").select("doc_id", "text").mapInArrow(write, "path string, source string, length long, content binary")


@query(
    "pdf_pages",
    """WITH l AS (SELECT doc_id, doc_id % 8 IN (3, 5) AS broken, string_split(COALESCE(text, ''), chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, broken, ls, unnest(range(0, CAST((len(ls) + 2) // 3 AS BIGINT))) AS k FROM l),
t AS (SELECT doc_id, broken, k + 1 AS page_number, list_transform(ls[3 * k + 1 : 3 * k + 3], lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))) AS ls FROM p),
c AS (SELECT doc_id, broken, page_number, array_to_string(list_filter(ls, lambda x: x <> ''), chr(10)) AS content FROM t)
SELECT 'doc' || doc_id AS source, CAST(page_number AS INTEGER) AS page_number, content, FALSE AS failed FROM c WHERE NOT broken AND content <> ''
UNION ALL SELECT 'doc' || doc_id, NULL, NULL, TRUE FROM c GROUP BY doc_id HAVING bool_or(broken) OR max(length(content)) = 0""",
)
def pdf_pages(spark, d):
    """Pages of files, and a row for each file that can't be read, in whatever way it is broken."""
    return library.extracted(_filed(spark, d)).select("source", "page_number", "content", F.col("error").isNotNull().alias("failed"))


@query(
    "doc_profiles",
    f"""WITH {SHELF_SQL} SELECT DISTINCT source, CASE WHEN doc_id % 5 = 4 THEN 'pages' ELSE 'sections' END AS index_type, ['dsm5trhandbook', 'icd11', 'nasw_ethics', 'dsm5tr', 'pages'][doc_id % 5 + 1] AS profile FROM sh""",
)
def doc_profiles(spark, d):
    return documents.index_kinds(documents.index(_shelf(spark, d)))


@query(
    "doc_headings",
    f"""WITH {SHELF_SQL}, p AS (SELECT *, doc_id::VARCHAR AS n FROM sh)
SELECT source, 'Part ' || n || ': Of ' || n AS title, NULL AS parent, page AS page_start, 'other' AS section_type FROM p WHERE doc_id % 5 = 0
UNION ALL SELECT source, 'Chapter ' || n || ': On ' || n AS title, 'Part ' || n || ': Of ' || n AS parent, page AS page_start, 'other' AS section_type FROM p WHERE doc_id % 5 = 0
UNION ALL SELECT source, n || '.1 Title ' || n AS title, 'Chapter ' || n || ': On ' || n AS parent, page AS page_start, 'other' AS section_type FROM p WHERE doc_id % 5 = 0
UNION ALL SELECT source, n || '.1.2 Inner ' || n AS title, n || '.1 Title ' || n AS parent, page AS page_start, 'other' AS section_type FROM p WHERE doc_id % 5 = 0
UNION ALL SELECT source, 'Chapter 07: Sleep ' || n || '.' AS title, NULL AS parent, page AS page_start, 'other' AS section_type FROM p WHERE doc_id % 5 = 1
UNION ALL SELECT source, 'Insomnia of ' || n || ' (7A00-7A0Z)' AS title, 'Chapter 07: Sleep ' || n || '.' AS parent, page AS page_start, 'other' AS section_type FROM p WHERE doc_id % 5 = 1
UNION ALL SELECT source, '7A0' || (doc_id % 10) || ' Chronic ' || n AS title, 'Insomnia of ' || n || ' (7A00-7A0Z)' AS parent, page AS page_start, 'disorder' AS section_type FROM p WHERE doc_id % 5 = 1
UNION ALL SELECT source, '7A0' || (doc_id % 10) || '.1 Mild ' || n AS title, '7A0' || (doc_id % 10) || ' Chronic ' || n AS parent, page AS page_start, 'disorder' AS section_type FROM p WHERE doc_id % 5 = 1
UNION ALL SELECT source, 'Preamble' AS title, NULL AS parent, page AS page_start, 'other' AS section_type FROM p WHERE doc_id % 5 = 2
UNION ALL SELECT source, '1. Social Workers'' Ethical Responsibilities to the ' || upper(left(lang, 1)) || substr(lang, 2) AS title, NULL AS parent, page AS page_start, 'other' AS section_type FROM p WHERE doc_id % 5 = 2
UNION ALL SELECT source, '1.0' || (1 + doc_id % 9) || ' Duty ' || n AS title, '1. Social Workers'' Ethical Responsibilities to the ' || upper(left(lang, 1)) || substr(lang, 2) AS parent, page AS page_start, 'other' AS section_type FROM p WHERE doc_id % 5 = 2""",
)
def doc_headings(spark, d):
    """Titles, parents and pages of what the three heading profiles cut."""
    cut = documents.index(_shelf(spark, d)).where("profile in ('dsm5trhandbook', 'icd11', 'nasw_ethics')")
    return cut.select("source", "title", "parent", F.col("page_start").cast("long").alias("page_start"), "section_type")


MANUAL_SQL = """mn AS (SELECT 'dsm5-' || source AS source, doc_id + 1 AS page, 'Sample ' || upper(left(lang, 1)) || substr(lang, 2) || ' Disorder' AS title, lang FROM documents)"""


@query("doc_section_types", f"WITH {MANUAL_SQL} SELECT source, 'comorbidity' AS section_type, title || ' - Comorbidity' AS title, COUNT(*) AS n FROM mn GROUP BY source, title")
def doc_section_types(spark, d):
    return documents.of_type(documents.index(_manual(spark, d)), "comorbidity").groupBy("source", "section_type", "title").agg(F.count("*").alias("n"))


@query("doc_section_get", f"WITH {MANUAL_SQL} SELECT source, title, MIN(page) AS page_start FROM mn WHERE source = 'dsm5-src3' AND title = 'Sample En Disorder' GROUP BY source, title")
def doc_section_get(spark, d):
    found = documents.section(documents.index(_manual(spark, d)), "dsm5-src3", "Sample En Disorder")
    return found.select("source", "title", F.col("page_start").cast("long").alias("page_start"))


@query("doc_section_titles", f"WITH {MANUAL_SQL} SELECT DISTINCT source, title FROM mn")
def doc_section_titles(spark, d):
    return documents.titles(documents.index(_manual(spark, d)))


@query("doc_page_range", "SELECT 'dsm5-' || source AS source, CAST(doc_id + 1 AS INTEGER) AS page_number FROM documents WHERE doc_id + 1 BETWEEN 11 AND 90")
def doc_page_range(spark, d):
    return documents.page_range(_manual(spark, d), 11, 90).select("source", "page_number")


def _pages_of(spark, d):
    """Each document as one page of a source without a profile."""
    i = F.col("doc_id")
    return views.table(spark, d, "documents").select(F.concat(F.lit("notes "), F.col("source")).alias("source"), (i + 1).cast("int").alias("page_number"), F.col("text").alias("content"))


def doc_bm25_sql(where: str, terms: list[str], scoring: list[str], keep: str = "true", df: dict[int, str] | None = None) -> str:
    """Whole SQL of a search over the pages of _pages_of; where is a condition on tf0, tf1 and so on, scoring are terms of the sum in
    which {0} is what phrase 0 adds. A term is a word, starts:x, title:term, content:term or near:x:other:n; df has the word whose
    documents count where they aren't those of the term."""

    def counted(term: str, toks: str = "toks") -> str:
        kind, _, rest = term.partition(":")
        if kind in ("title", "content"):
            return counted(rest, f"{kind}_toks")
        if kind == "near":  # in the content alone, as no title has such words
            word, other, n = rest.split(":")
            return f"len(list_filter(range(1, len({toks}) + 1), lambda i: {toks}[i] = '{word}' AND list_contains({toks}[greatest(1, i - {int(n) + 1}):i + {int(n) + 1}], '{other}')))"
        test = f"starts_with(t, '{rest}')" if kind == "starts" else f"t = '{term}'"
        return f"len(list_filter({toks}, lambda t: {test}))"

    tf = ", ".join(f"CAST({counted(t)} AS DOUBLE) AS tf{i}" for i, t in enumerate(terms))
    held = ", ".join(f"CAST({counted((df or {}).get(i, t))} AS DOUBLE) AS held{i}" for i, t in enumerate(terms))
    dfs = ", ".join(f"SUM(CASE WHEN held{i} > 0 THEN 1 ELSE 0 END) AS df{i}" for i in range(len(terms)))
    rare = "ln((n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE))"
    parts = [
        f"(CASE WHEN {rare} <= 0 THEN 0.000001::DOUBLE ELSE {rare} END) * tf{{i}} * 2.2::DOUBLE / (tf{{i}} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / al))".format(i=i)
        for i in range(len(terms))
    ]
    score = " + ".join(x.format(*parts) for x in scoring)
    return f"""WITH p AS (SELECT doc_id, 'notes ' || source AS source, text AS content, 'Page ' || (doc_id + 1) AS title FROM documents),
u AS (SELECT doc_id, source, title, {TOKENS} AS content_toks FROM p), v AS (SELECT doc_id, source, content_toks, {TOKENS} AS title_toks FROM (SELECT doc_id, source, content_toks, title AS content FROM u)),
t AS (SELECT *, list_concat(title_toks, content_toks) AS toks FROM v),
c AS (SELECT doc_id, source, CAST(len(toks) AS DOUBLE) AS l, {tf}, {held} FROM t), s AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n, AVG(l) AS al, {dfs} FROM c)
SELECT source, -(doc_id + 1) AS rowid, 'Page ' || (doc_id + 1) AS title, ROUND({score}, 6) AS score FROM c, s WHERE ({where}) AND {keep}"""


def _notes(spark, d):
    """The stored index over the documents' pages."""
    return section_index.ensure(_pages_of(spark, d), "notes", made=documents.index)


def _found(found):
    return found.select("source", "rowid", "title", r6("score").alias("score"))


@query(
    "doc_search_operators",
    doc_bm25_sql("(tf0 > 0 AND tf1 > 0) OR (tf2 > 0 AND NOT tf3 > 0)", ["rewh", "thatea", "thatea", "the"], ["CASE WHEN tf0 > 0 AND tf1 > 0 THEN {0} + {1} ELSE 0 END", "CASE WHEN tf2 > 0 AND NOT tf3 > 0 THEN {2} ELSE 0 END"]),
)
def doc_search_operators(spark, d):
    """NOT before AND before OR, and words together before all; what stands after NOT, or in a part that doesn't match, doesn't score."""
    return _found(documents.search(_notes(spark, d), "rewh thatea OR thatea NOT the", 1_000_000))


@query("doc_search_brackets", doc_bm25_sql("(tf0 > 0 OR tf1 > 0) AND tf2 > 0", ["rewh", "thatea", "the"], ["{0}", "{1}", "{2}"]))
def doc_search_brackets(spark, d):
    return _found(documents.search(_notes(spark, d), "(rewh OR thatea) AND the", 1_000_000))


@query("doc_search_related", doc_bm25_sql("tf0 > 0", ["rewh"], ["{0}"], "true").replace("FROM documents),", "FROM documents WHERE source IN ('src3', 'src5')),"))
def doc_search_related(spark, d):
    """A source and its related ones; one that doesn't exist gives nothing."""
    known = views.table(spark, d, "documents").select(F.concat(F.lit("notes "), F.col("source")).alias("source")).distinct()
    sources = known.withColumn("related_sources", F.when(F.col("source") == "notes src3", F.array(F.lit("notes src5"), F.lit("no such source"))))
    return _found(documents.search_related(_notes(spark, d), sources, "notes src3", "rewh", 1_000_000))


@query("doc_search_prefix", doc_bm25_sql("tf0 > 0 AND tf1 > 0", ["starts:thate", "the"], ["{0}", "{1}"]))
def doc_search_prefix(spark, d):
    """All words that begin alike count as one."""
    return _found(documents.search(_notes(spark, d), "thate* AND the", 1_000_000))


@query("doc_search_column", doc_bm25_sql("tf0 > 0 AND tf1 > 0", ["title:starts:1", "content:the"], ["{0}", "{1}"]))
def doc_search_column(spark, d):
    """Words of one field: pages whose number begins with 1, and whose text has a word."""
    return _found(documents.search(_notes(spark, d), "title : 1* AND content : the", 1_000_000))


@query("doc_search_near", doc_bm25_sql("tf0 > 0 AND tf1 > 0", ["near:the:of:3", "near:of:the:3"], ["{0}", "{1}"], df={0: "the", 1: "of"}))
def doc_search_near(spark, d):
    """Two words with at most three between; places that are near none of the other don't count."""
    return _found(documents.search(_notes(spark, d), "NEAR(the of, 3)", 1_000_000))


@query(
    "doc_search_top",
    doc_bm25_sql("tf0 > 0 OR tf1 > 0", ["rewh", "thatea"], ["CASE WHEN tf0 > 0 THEN {0} ELSE 0 END", "CASE WHEN tf1 > 0 THEN {1} ELSE 0 END"]) + " ORDER BY score DESC, source, rowid LIMIT 20",
)
def doc_search_top(spark, d):
    """The best twenty, for which blocks of pages that can't hold one of them aren't read."""
    return _found(documents.search(_notes(spark, d), "rewh OR thatea", 20))


@query(
    "doc_hydrated",
    f"""WITH {MANUAL_SQL}, p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source ORDER BY page) AS k FROM mn)
SELECT 'notes ' || source AS source, -(doc_id + 1) AS rowid, 'Page ' || (doc_id + 1) AS title, NULL AS parent, CAST(doc_id + 1 AS INTEGER) AS page_start, 'page' AS section_type FROM documents
UNION ALL SELECT source, 3 * k - 2 AS rowid, title, NULL AS parent, CAST(page AS INTEGER) AS page_start, 'disorder' AS section_type FROM p
UNION ALL SELECT source, 3 * k - 1 AS rowid, title || ' - Diagnostic Criteria' AS title, title AS parent, CAST(page AS INTEGER) AS page_start, 'diagnostic_criteria' AS section_type FROM p
UNION ALL SELECT source, 3 * k AS rowid, title || ' - Comorbidity' AS title, title AS parent, CAST(page AS INTEGER) AS page_start, 'comorbidity' AS section_type FROM p""",
)
def doc_hydrated(spark, d):
    """Hits of both kinds: pages by their number, sections by what the index holds of them."""
    sections = documents.index(_pages_of(spark, d)).unionByName(documents.index(_manual(spark, d)))
    return documents.hydrated(sections.select("source", "rowid"), sections).select("source", "rowid", "title", "parent", "page_start", "section_type")


@query(
    "doc_page_limits",
    f"""WITH {SHELF_SQL}, p AS (SELECT *, doc_id::VARCHAR AS n, page - 43 AS pg FROM sh)
SELECT source, n || '.1 Title ' || n AS title, pg AS page_start FROM p WHERE doc_id % 5 = 0 AND pg >= 11
UNION ALL SELECT source, 'Insomnia of ' || n || ' (7A00-7A0Z)' AS title, pg AS page_start FROM p WHERE doc_id % 5 = 1 AND pg >= 44
UNION ALL SELECT source, '1.0' || (1 + doc_id % 9) || ' Duty ' || n AS title, pg AS page_start FROM p WHERE doc_id % 5 = 2 AND pg >= 3""",
)
def doc_page_limits(spark, d):
    """Pages from 1 on: headings before a profile's first page of content aren't sections."""
    cut = documents.index(_shelf(spark, d).withColumn("page_number", F.col("page_number") - 43)).where("profile in ('dsm5trhandbook', 'icd11', 'nasw_ethics')")
    wanted = cut.where(F.col("title").rlike(r"^\d+\.1 Title |^Insomnia of |^1\.0\d Duty "))
    return wanted.select("source", "title", F.col("page_start").cast("long").alias("page_start"))


@query("doc_search_type")
def doc_search_type(spark, d):
    """A full-text search among one type of section."""
    index = section_index.ensure(_manual(spark, d), "manual", made=documents.index)
    return documents.search_type(index, "the", "diagnostic_criteria", 20).withColumn("score", r6("score"))


# --- search -------------------------------------------------------------------------------------------------------

HITS_SQL = f"""{Q0.format(v=0)}, h AS (SELECT id, ROUND({SIM.format(a='embedding', b='q')}, 9) AS blended FROM mem, qv WHERE embedding IS NOT NULL), r AS (SELECT id, blended, ROW_NUMBER() OVER (ORDER BY blended DESC, id) - 1 AS place FROM h WHERE blended >= 0.1)"""


def _hits(spark, d):
    hits = retrieval.similar(views.mem(spark, d), views.query_vector(spark, d, 0), None)
    return hits.select("id", "content", F.round("score", 9).alias("blended")).where("blended >= 0.1")


@query("rerank_rules", f"WITH {MEM}, {HITS_SQL} SELECT id, CASE place WHEN 4 THEN CAST(1 AS DOUBLE) WHEN 0 THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.85 AS DOUBLE) END AS blended FROM r WHERE place IN (0, 2, 4)")
def rerank_rules(spark, d):
    """A judge's order over the twenty best: a position beyond them names nothing and uses up its rank, the others go."""
    return pipeline.rerank(_hits(spark, d), "q", lambda query, texts, limit: [4, 99, 0, 2]).select("id", F.round("blended", 6).alias("blended"))


@query("rerank_failed", f"WITH {MEM}, {HITS_SQL} SELECT id, ROUND(blended, 6) AS blended FROM r")
def rerank_failed(spark, d):
    """A judge that fails or names nothing leaves the results as they are."""

    def failing(query, texts, limit):
        raise ConnectionError("no judge")

    return pipeline.rerank(pipeline.rerank(_hits(spark, d), "q", failing), "q", lambda *_: []).select("id", r6("blended").alias("blended"))


@query(
    "output_hints",
    f"""WITH {MEM}, {HITS_SQL}, k(k) AS (VALUES (0.0), (0.3), (0.6), (2.0)) SELECT CAST(k AS DOUBLE) AS least, COUNT(r.id) < 3 OR COALESCE(MAX(blended) < 0.45, false) AS sparse FROM k LEFT JOIN r ON r.blended >= k GROUP BY k""",
)
def output_hints(spark, d):
    out = None
    for least in (0.0, 0.3, 0.6, 2.0):
        row = pipeline.output_hint(_hits(spark, d).where(F.col("blended") >= least)).withColumn("least", F.lit(least))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "dashboard_search",
    f"""WITH {MEM}, {Q0.format(v=0)}, v AS (SELECT id, ROW_NUMBER() OVER (ORDER BY score DESC, id) AS r FROM (SELECT id, {SIM.format(a='embedding', b='q')} AS score FROM mem, qv WHERE embedding IS NOT NULL) x WHERE score >= 0.5 QUALIFY r <= 10),
t AS (SELECT id, {TOKENS} AS toks FROM mem), c AS (SELECT id, CAST(len(toks) AS DOUBLE) AS l, CAST(len(list_filter(toks, lambda t: t = 'rewh')) AS DOUBLE) AS tf FROM t),
s AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n, AVG(l) AS al, CAST(COUNT(*) FILTER (tf > 0) AS DOUBLE) AS df FROM c),
w AS (SELECT id, ROW_NUMBER() OVER (ORDER BY ROUND(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 0.000001 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / al)), 12) DESC, id) AS r FROM c, s WHERE tf > 0 QUALIFY r <= 10),
u AS (SELECT id, CAST(1 AS DOUBLE) / (60 + r) AS x FROM v UNION ALL SELECT id, CAST(1 AS DOUBLE) / (60 + r) AS x FROM w)
SELECT id, ROUND(LEAST(CAST(1 AS DOUBLE), SUM(x) / (CAST(2 AS DOUBLE) / 61)), 6) AS score, 'semantic' AS method FROM u GROUP BY id""",
)
def dashboard_search(spark, d):
    """Ten vector hits of half a point at least, fused with ten keyword hits, and not cut again."""
    found = pipeline.dashboard(views.mem(spark, d), "rewh", views.query_vector(spark, d, 0), 10, 0.3, index=views.keyword_index(spark, d))
    return found.withColumn("score", r6("score"))


# --- sessions and graphs against folds stated in SQL -----------------------------------------------------------------


@query(
    "session_centroid_ema",
    f"""WITH RECURSIVE {SESS}, g AS (SELECT s.session_id, ROW_NUMBER() OVER (PARTITION BY s.session_id ORDER BY s.turn) AS k, CAST(e.embedding AS DOUBLE[]) AS v FROM ss s JOIN embeddings e ON e.vec_id = s.spot),
f AS (SELECT session_id, k, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS c FROM g WHERE k = 1
  UNION ALL SELECT z.session_id, z.k, list_transform(z.m, lambda x: x / sqrt(list_dot_product(z.m, z.m))) AS c FROM (SELECT g.session_id, g.k, list_transform(list_zip(g.v, f.c), lambda p: 0.1::DOUBLE * p[1] + 0.9::DOUBLE * p[2]) AS m FROM f JOIN g ON g.session_id = f.session_id AND g.k = f.k + 1) z)
SELECT f.session_id, f.k AS signals, ROUND(list_sum(c), 6) AS total, ROUND(list_dot_product(c, CAST(list_transform(range(1, 65), lambda i: i) AS DOUBLE[])), 5) AS weighted FROM f JOIN (SELECT session_id, MAX(k) AS k FROM g GROUP BY session_id) m ON m.session_id = f.session_id AND m.k = f.k""",
)
def session_centroid_ema(spark, d):
    """All components of every session's centroid, as their sum and their sum by place."""
    c = sessions.centroids(views.sess(spark, d))
    total = F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x)
    weighted = F.aggregate(F.transform("centroid", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return c.select("session_id", F.col("signals").cast("long").alias("signals"), r6(total).alias("total"), F.round(weighted, 5).alias("weighted"))


@query(
    "session_centroid_before",
    f"""WITH RECURSIVE {SESS}, g AS (SELECT s.session_id, s.turn, s.role, ROW_NUMBER() OVER (PARTITION BY s.session_id ORDER BY s.turn) AS k, CAST(e.embedding AS DOUBLE[]) AS v FROM ss s JOIN embeddings e ON e.vec_id = s.spot),
f AS (SELECT session_id, k, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS c FROM g WHERE k = 1
  UNION ALL SELECT z.session_id, z.k, list_transform(z.m, lambda x: x / sqrt(list_dot_product(z.m, z.m))) AS c
  FROM (SELECT g.session_id, g.k, list_transform(list_zip(g.v, f.c), lambda p: 0.1::DOUBLE * p[1] + 0.9::DOUBLE * p[2]) AS m FROM f JOIN g ON g.session_id = f.session_id AND g.k = f.k + 1) z)
SELECT g.session_id * 1000 + g.turn AS search_id, g.k - 1 AS n_vectors, ROUND(list_sum(list_transform(c, lambda x: abs(x))), 6) AS total, ROUND(list_dot_product(list_transform(c, lambda x: abs(x)), CAST(list_transform(range(1, 65), lambda i: i) AS DOUBLE[])), 5) AS weighted
FROM g LEFT JOIN f ON f.session_id = g.session_id AND f.k = g.k - 1 WHERE g.role = 'user'""",
)
def session_centroid_before(spark, d):
    """The centroid that each user's turn finds, from the turns before it: users' as searches, all others as recalled memories."""
    rows = views.sess(spark, d).where("embedding is not null")
    asked = rows.where("role = 'user'").select("session_id", F.col("turn").alias("at"), "text", "embedding", (F.col("session_id") * 1000 + F.col("turn")).alias("search_id"))
    recalled = rows.where("role <> 'user'").select("session_id", F.col("turn").alias("at"), F.col("at").alias("memory_id"))
    told = sessions.signals(asked, recalled.limit(0), recalled, views.vectors(spark, d))
    c = sessions.before_each(told, asked)
    sizes = F.transform("centroid", F.abs)
    total = F.aggregate(sizes, F.lit(0.0), lambda a, x: a + x)
    weighted = F.aggregate(F.transform(sizes, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return c.select("search_id", "n_vectors", r6(total).alias("total"), F.round(weighted, 5).alias("weighted"))


@query(
    "discovery_reach",
    f"""WITH {MEM}, {ASSOC}, s AS (SELECT id FROM mem WHERE id < 20), a AS (SELECT from_id, to_id FROM assoc WHERE weight >= 0.15),
h1 AS (SELECT DISTINCT to_id AS id FROM a WHERE from_id IN (SELECT id FROM s) AND to_id NOT IN (SELECT id FROM s)), v1 AS (SELECT id FROM h1 JOIN mem USING (id) WHERE embedding IS NOT NULL),
h2 AS (SELECT DISTINCT to_id AS id FROM a WHERE from_id IN (SELECT id FROM v1) AND to_id NOT IN (SELECT id FROM s) AND to_id NOT IN (SELECT id FROM h1)), v2 AS (SELECT id FROM h2 JOIN mem USING (id) WHERE embedding IS NOT NULL),
h3 AS (SELECT DISTINCT to_id AS id FROM a WHERE from_id IN (SELECT id FROM v2) AND to_id NOT IN (SELECT id FROM s) AND to_id NOT IN (SELECT id FROM h1) AND to_id NOT IN (SELECT id FROM h2)), v3 AS (SELECT id FROM h3 JOIN mem USING (id) WHERE embedding IS NOT NULL)
SELECT id, 1 AS hop FROM v1 UNION ALL SELECT id, 2 AS hop FROM v2 UNION ALL SELECT id, 3 AS hop FROM v3""",
)
def discovery_reach(spark, d):
    """What three hops from twenty seeds reach, and at which hop."""
    m = views.mem(spark, d)
    seeds = m.where("id < 20").select("id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("id")).alias("frontier_rank"))
    edges = views.assoc(spark, d).withColumn("edge_seq", F.col("to_id"))
    return graph.discover(seeds, edges, m, views.query_vector(spark, d, 0), 3).select("id", "hop")
