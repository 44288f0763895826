"""Tokens, stems and query expansion."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of query expansion, and the smaller list of result shaping.
STOP_WORDS = frozenset(
    "a an the is are was were be been being have has had do does did will would could should may might shall can what when where which who whom whose why how that "
    "this these those i you he she it we they me him her us them my your his its our their not no and but or so yet for from if in into of on to up with at by about "
    "after before between during than too very just also am out over own same still then under until again once only".split()
)
SHAPING_STOP_WORDS = frozenset("the a an and or to of in on for with from is are was were be been this that it as at by what when where who how does did".split())


def _accents() -> tuple[str, str]:
    """Accented Latin letters and what they fold to."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii() and b.isalpha()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def tokens(content: Column | str) -> Column:
    """Lower-case runs of letters and digits, accents folded."""
    c = F.col(content) if isinstance(content, str) else content
    low = F.lower(c)
    folded = F.when(low.rlike("[\u00c0-\u024f]"), F.translate(low, ACCENTED, PLAIN)).otherwise(low)  # most texts have none
    return F.array_remove(F.split(folded, r"[^\p{L}\p{N}]+"), "")


def query_phrases(query: str) -> list[list[str]]:
    """Each white-space separated word of a query, without quotes, as the tokens that must stand side by side."""
    fold = str.maketrans(ACCENTED, PLAIN)
    out = []
    for word in query.split():
        found = [t for t in re.split(r"[\W_]+", word.replace('"', "").lower().translate(fold)) if t]
        if found:
            out.append(found)
    return out


def _trim(token: str, keep: str = "") -> str:
    a, b = 0, len(token)
    while a < b and not (token[a].isalnum() or token[a] in keep):
        a += 1
    while b > a and not (token[b - 1].isalnum() or token[b - 1] in keep):
        b -= 1
    return token[a:b]


def clean_token(raw: str) -> str:
    """A query word without punctuation around it and without possessive ending; empty if nothing is left."""
    t = _trim(raw, "'’`").replace("’", "'").replace("`", "")
    return _trim(t[:-2] if t.endswith(("'s", "'S")) else t)


@lru_cache(maxsize=1 << 16)
def shaping_token(raw: str) -> str | None:
    t = _trim(raw, "'’`").replace("’", "'").replace("`", "").lower()
    t = _trim(t.removesuffix("'s"))
    return t if len(t.encode()) >= 3 and t not in SHAPING_STOP_WORDS else None


def shaping_tokens(text: str) -> set[str]:
    return {t for t in map(shaping_token, set(text.split())) if t}


def significant(query: str) -> list[str]:
    return [t for t in map(clean_token, query.split()) if t and t.lower() not in STOP_WORDS]


def expand_query(query: str) -> list[str]:
    """The query, and without its stop words if that leaves fewer words and a different text."""
    words = query.split()
    kept = significant(query)
    bare = " ".join(kept)
    return [query, bare] if len(words) > 1 and 0 < len(kept) < len(words) and bare != query else [query]


def fallback_terms(query: str, most: int = 5) -> list[str]:
    """Single terms for sparse results: capitalised or of four bytes at least."""
    kept = significant(query)
    if len(kept) < 2:
        return []
    wanted = [t for t in kept if t[0].isupper() or len(t.encode()) >= 4]
    return list(dict.fromkeys(wanted))[:most]


def normalize_variants(original: str, generated: list[str]) -> list[str]:
    """The original first, then generated ones, trimmed, without repeats that differ in case alone."""
    seen: dict[str, str] = {}
    for text in (original, *generated):
        if text.strip():
            seen.setdefault(text.strip().lower(), text.strip())
    return list(seen.values()) or [original]


def truncate_bytes(text: str, most: int) -> str:
    """At most so many bytes, dots included, cut at a character."""
    if len(text.encode()) <= most:
        return text
    if most <= 3:
        return "." * most
    return text.encode()[: most - 3].decode("utf-8", "ignore") + "..."


def percent_decode(text: str) -> str:
    """%XX and + decoded; bad escapes stay, bad UTF-8 is replaced."""
    data = text.encode().replace(b"+", b" ")
    return re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), data).decode("utf-8", "replace")


def multipart_file(body: bytes, boundary: str) -> tuple[str, bytes] | None:
    """Name and bytes of the first file of a multipart body; none if it holds none."""
    parts = body.split(b"--" + boundary.encode())
    for part in parts[1:-1]:  # what lies between two boundaries
        head, blank, data = part.removeprefix(b"\r\n").partition(b"\r\n\r\n")
        named = re.search(r'filename="([^"]+)"', head.decode("utf-8", "replace"))
        if blank and named:
            return named[1], data.removesuffix(b"\r\n")
    return None


# Porter's algorithm (1980): suffixes of steps 2 to 4, longest first within each rule list.
_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
# Of equal length, in the order above.
_RULES = tuple(tuple(sorted(rules, key=lambda r: -len(r[0]))) for rules in (_STEP2, _STEP3))
_CUTS = tuple(sorted(_STEP4, key=len, reverse=True))


def _shape(word: str) -> str:
    """c and v for each letter."""
    out = ""
    for i, x in enumerate(word):
        out += "v" if x in "aeiou" or (x == "y" and i and out[i - 1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _cvc(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def porter(w: str) -> str:
    """Stem of a lower-case ASCII word."""
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                stem = w[: -len(end)]
                if "v" in _shape(stem):
                    if stem.endswith(("at", "bl", "iz")):
                        w = stem + "e"
                    elif len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c" and stem[-1] not in "lsz":
                        w = stem[:-1]
                    else:
                        w = stem + "e" if _measure(stem) == 1 and _cvc(stem) else stem
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for rules in _RULES:
        for end, new in rules:
            if w.endswith(end):
                w = w[: -len(end)] + new if _measure(w[: -len(end)]) > 0 else w
                break
    for end in _CUTS:
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w
