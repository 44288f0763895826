"""Column functions of the data model. Every one is a JVM-side expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENERGY_FLOOR = 0.001
DEEP_MULTIPLIER = 0.25


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def state_of(energy: Column | str) -> Column:
    e = col(energy)
    return F.when(e >= 0.3, "active").when(e >= 0.1, "dormant").when(e >= 0.02, "deep").otherwise("archived")


def searchable(state: Column | str) -> Column:
    return col(state).isin("active", "dormant")


def state_filter(state: Column | str, include_deep: bool = False, include_archived: bool = False, unfiltered: bool = False) -> Column:
    """Which states a search sees."""
    if unfiltered or include_archived:
        return F.lit(True)
    if include_deep:
        return col(state) != "archived"
    return searchable(state)


def decayed(energy: Column | str, state: Column | str, amount: Column | float) -> Column:
    """Energy after a decay: archived rests, deep loses a quarter of the amount, nothing falls under the floor."""
    e, s, a = col(energy), col(state), amount if isinstance(amount, Column) else F.lit(float(amount))
    return F.when(s == "archived", e).when(s == "deep", F.greatest(e - a * DEEP_MULTIPLIER, F.lit(ENERGY_FLOOR))).otherwise(F.greatest(e - a, F.lit(ENERGY_FLOOR)))


def stimulated(energy: Column | str, amount: Column | float) -> Column:
    return F.least(F.lit(1.0), col(energy) + (amount if isinstance(amount, Column) else F.lit(float(amount))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str, unequal: str = "null") -> Column:
    """Cosine in double precision; 0 where a norm is 0, null where a vector is null. Where lengths differ: null (a scan skips
    the pair), zero (as the classifier counts it), or with zip the dot product over the shorter and norms over all."""
    a, b = col(a), col(b)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    same = F.size(a) == F.size(b)
    if unequal == "zip":
        n = F.least(F.size(a), F.size(b))
        return F.when(a.isNotNull() & b.isNotNull(), F.when(norms == 0, 0.0).otherwise(dot(F.slice(a, 1, n), F.slice(b, 1, n)) / norms))
    out = F.when(same, F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms))
    return out if unequal == "null" else F.when(a.isNotNull() & b.isNotNull(), F.when(same, out).otherwise(0.0))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Overlap of token sets; 0 if either is empty."""
    a, b = col(a), col(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def source_bucket(content: Column | str, created_at: Column | str) -> Column:
    """A leading [label] that ends within 48 bytes, in lower case; else the day of creation, UTC."""
    label = F.regexp_extract(col(content), r"^(\[[^\]]*\])", 1)
    fits = (F.octet_length(label) > 2) & (F.octet_length(label) <= 49)
    return F.when(fits, F.lower(label)).otherwise(F.date_format(F.timestamp_seconds(col(created_at)), "yyyy-MM-dd"))


# Cues of composite and of inferential queries.
COMPOSITE_CUES = (" and ", " both ", "activities", "events", "books", "states", "cities", "names", "causes", "traits", "attributes", "both have", "in common", "all ")
INFERENTIAL_CUES = ("might", "likely", "considered", "would", "could", "personality", "attributes", "traits", "describe", "what job")


def has_cue(text: Column | str, cues: tuple[str, ...]) -> Column:
    low = F.lower(col(text))
    out = F.lit(False)
    for cue in cues:
        out = out | low.contains(cue)
    return out


def is_composite(text: Column | str) -> Column:
    return has_cue(text, COMPOSITE_CUES)


def is_inferential(text: Column | str) -> Column:
    return has_cue(text, INFERENTIAL_CUES)


def effective_limit(composite: Column, limit: Column, low: int = 15, high: int = 30) -> Column:
    return F.when(composite, F.least(F.greatest(limit, F.lit(low)), F.lit(high))).otherwise(limit)


def contains_ci(content: Column | str, needle: str) -> Column:
    """Case-insensitive substring, taken literally."""
    return F.lower(col(content)).contains(needle.lower())


def strip_date_anchor(content: Column | str) -> Column:
    """Drop ` (YYYY-MM-DD)`, turn double spaces into one in a single pass, trim."""
    return F.trim(F.replace(F.regexp_replace(col(content), r" \(\d{4}-\d{2}-\d{2}\)", ""), F.lit("  "), F.lit(" ")))


def parse_epoch(text: Column | str) -> Column:
    """Epoch seconds of an integer, an RFC 3339 time, a time without zone (UTC) or a date; null otherwise."""
    t = F.trim(col(text))
    stamp = F.when(
        t.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$") | t.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$") | t.rlike(r"^\d{4}-\d{2}-\d{2}$"),
        F.unix_seconds(F.try_to_timestamp(t)),
    )
    return F.coalesce(F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("bigint")), stamp)


def parse_epoch_loose(text: Column | str) -> Column:
    """As parse_epoch, and fractional epochs (truncated), `17 July 2023` and `July 17, 2023`."""
    t = F.trim(col(text))
    named = F.coalesce(F.try_to_timestamp(t, F.lit("d MMMM yyyy")), F.try_to_timestamp(t, F.lit("MMMM d, yyyy")))
    return F.coalesce(parse_epoch(text), F.when(t.rlike(r"^[+-]?\d*\.\d+$"), t.try_cast("double").cast("bigint")), F.unix_seconds(named))


def vector_of(blob: Column | str) -> Column:
    """Little-endian 32-bit floats of a binary column; null where its length is no multiple of four. Digits are read by
    arithmetic on the hex form, so the import stays in the JVM."""
    b = col(blob)
    byte = lambda i: F.conv(F.hex(F.substr(b, i, F.lit(1))), 16, 10).cast("long")

    def number(k: Column) -> Column:
        word = byte(k) + byte(k + 1) * 256 + byte(k + 2) * 65536 + byte(k + 3) * 16777216
        sign = F.when(word >= 2**31, -1.0).otherwise(1.0)
        exponent, fraction = F.floor(word / 2**23) % 256, word % 2**23
        return (F.when(exponent == 0, sign * fraction * F.lit(2.0**-149)).otherwise(sign * (1 + fraction / 2**23) * F.pow(F.lit(2.0), exponent - 127))).cast("float")

    n = (F.octet_length(b) / 4).cast("int")
    return F.when(F.octet_length(b) % 4 == 0, F.when(n == 0, F.array().cast("array<float>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: number(i * 4 + 1))))


# Words that stay small in titles.
SMALL_WORDS = ("to", "the", "in", "as", "of", "and", "or")


def title_case(text: Column | str) -> Column:
    words = F.filter(F.split(F.lower(col(text)), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when(w.isin(*SMALL_WORDS), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w))))), " ")


def is_uuid(text: Column | str) -> Column:
    return col(text).rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")


def byte_prefix(text: Column | str, most: int) -> Column:
    """At most so many bytes from the front, cut at a character."""
    b = F.encode(col(text), "UTF-8")

    def inner(i: int) -> Column:  # whether the byte at a place goes on a character
        return F.substring(F.hex(F.substring(b, i, 1)), 1, 1).isin("8", "9", "A", "B")

    end = F.when(~inner(most + 1), most)
    for back in (1, 2):
        if most - back >= 0:
            end = end.when(~inner(most + 1 - back), most - back)
    return F.decode(F.substr(b, F.lit(1), end.otherwise(max(0, most - 3))), "UTF-8")


def truncated_bytes(text: Column | str, most: int) -> Column:
    """At most so many bytes, dots within the budget; dots alone where it is three or less."""
    t = col(text)
    cut = F.lit("." * most) if most <= 3 else F.concat(byte_prefix(t, most - 3), F.lit("..."))
    return F.when(F.octet_length(t) <= most, t).otherwise(cut)


def chain_hint(text: Column | str, most: int) -> Column:
    """At most so many bytes, and dots beyond the budget."""
    t = col(text)
    return F.when(F.octet_length(t) <= most, t).otherwise(F.concat(byte_prefix(t, most), F.lit("...")))


def url_decoded(text: Column | str) -> Column:
    """Plus signs as spaces, %XX decoded; escapes that aren't one stay."""
    return F.try_url_decode(F.regexp_replace(col(text), "%(?![0-9A-Fa-f]{2})", "%25"))


def query_params(text: Column | str) -> Column:
    """(key, value) of each part of a query string, in order, values decoded."""
    parts = F.filter(F.split(col(text), "&"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), url_decoded(F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")).alias("value")))


def query_param(text: Column | str, key: str) -> Column:
    """The first value of a key; null if there is none."""
    return F.try_element_at(F.filter(query_params(text), lambda p: p["key"] == key), F.lit(1))["value"]


def reference_date(text: Column | str) -> Column:
    """A date, or the date that a longer text begins with; null otherwise."""
    day = F.left(F.trim(col(text)), F.lit(10))
    return F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day.try_cast("date"))


def format_resolved(first: Column | str, last: Column | str, label: Column | str) -> Column:
    """A resolved date or range as text, its label in brackets."""
    a, b, tail = col(first).cast("string"), col(last).cast("string"), F.coalesce(F.concat(F.lit(" ("), col(label), F.lit(")")), F.lit(""))
    return F.concat(F.when(b.isNull() | (a == b), a).otherwise(F.concat(a, F.lit(" to "), b)), tail)


def resolver_language(text: Column | str) -> Column:
    """The language whose rules read an expression. There is one, and texts of any length and language go to it."""
    return F.when(col(text).isNotNull(), "english")


# The layouts of a memory, and of what a reader of a cited source is told.
MEMORY_LAYOUT = "ID: %s\nContent: %s\nState: %s (energy: %.2f)\nAccess count: %s\nCreated: %s"
CITING = ("When presenting information from ", ", always include the APA 7 citation.\nFull reference: ")


def format_memory(id_, content, state, energy, access_count, created_at) -> Column:
    return F.format_string(MEMORY_LAYOUT, col(id_).cast("string"), col(content), col(state), col(energy), col(access_count).cast("string"), col(created_at).cast("string"))


def format_item(content, secondary, tertiary, category) -> Column:
    """An identity item on one line; what is missing is left out."""
    return F.concat_ws(" ", col(content), F.concat(F.lit("("), col(secondary), F.lit(")")), F.concat(F.lit("["), col(tertiary), F.lit("]")), F.concat(F.lit("{"), col(category), F.lit("}")))


def lens_name(name: Column | str) -> Column:
    """Letters, digits, hyphens and underscores alone; null if nothing is left."""
    return F.nullif(F.regexp_replace(col(name), r"[^\p{L}\p{N}_-]", ""), F.lit(""))


def citation_short(author, year) -> Column:
    return F.concat(F.lit("("), col(author), F.lit(", "), col(year), F.lit(")"))


def citation_instruction(title, reference) -> Column:
    """What a reader of a cited source is told."""
    return F.concat(F.lit(CITING[0]), col(title), F.lit(CITING[1]), col(reference))


def vector_bytes(vector: Column | str) -> Column:
    """Little-endian 32-bit floats of a vector; the reverse of vector_of, in Arrow batches."""
    import numpy as np

    pack = F.pandas_udf(lambda column: column.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes()), "binary", F.PandasUDFType.SCALAR)
    return pack(col(vector))


def citation_reference(author, year, title, edition, doi, url, publisher) -> Column:
    """APA reference: edition, then DOI, URL or publisher, the first there is."""
    where = F.coalesce(F.concat(F.lit("https://doi.org/"), doi), url, F.concat(publisher, F.lit(".")))
    return F.concat_ws(
        " ", F.concat(author, F.lit(". ("), year, F.lit(").")), F.concat(F.lit("*"), title, F.lit("*")), F.concat(F.lit("("), edition, F.lit(").")), where
    )


def citation_inline(author, year, first, last) -> Column:
    pages = F.when(first == last, F.concat(F.lit("p. "), first.cast("string"))).otherwise(F.concat(F.lit("pp. "), first.cast("string"), F.lit("-"), last.cast("string")))
    return F.concat(F.lit("("), author, F.lit(", "), year, F.lit(", "), pages, F.lit(")"))


def sanitized_name(name: Column | str) -> Column:
    """File name rules for names without percent signs: scheme off, dangerous characters and runs of separators to one
    underscore, ends trimmed, .pdf put back."""
    n = F.regexp_replace(F.replace(col(name), F.lit("+"), F.lit(" ")), "^blob:", "")
    n = F.regexp_replace(n, "^(https://|http://|file:///|file://|https:|http:|file:)", "")
    n = F.regexp_replace(n, r"(?i)\.pdf$", "")
    n = F.regexp_replace(n, r"[:?&#\\/\"'\p{Cc}]", "_")
    n = F.regexp_replace(n, r"[_\s]+", "_")
    n = F.regexp_replace(n, r"^_+|_+$", "")
    return F.when(n == "", "unnamed_reference.pdf").otherwise(F.concat(n, F.lit(".pdf")))
