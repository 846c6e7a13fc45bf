"""Column builders for lines and texts. All run in the JVM but nfkc and the exact branch of normalised."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom import dims

#: White space of any script, as a class that Java and RE2 read alike.
WS = r"[\s\p{Z}\x0B\x1C-\x1F\x85]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
#: Marks of list items.
BULLET_MARKS = "•●○◦▪▸►➤➢★✦✧→⮞⬥"
BULLET = rf"^\s*(?:[{BULLET_MARKS}\-*]|\d+[.)]\s|[a-zA-Z][.)]\s|[ivxIVX]+[.)]\s)\s*"
#: Patterns of page marks, mail and web addresses.
ARTIFACTS = (r"^[0-9]{1,4}$", r"(?i)^page\s+[0-9]+\s*(?:of\s+[0-9]+)?$", r"^-\s*[0-9]+\s*-$", r"^[0-9]+\s*/\s*[0-9]+$", r"^\[\s*[0-9]+\s*\]$")
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
URL = r"https?://[^\s]+"
S, E, W, CUT = "__S__", "__E__", "__W__", "\x1e"
#: Fixed values: (pattern, replacement in Java's notation) that keep full stops from ending sentences, in order.
PROTECT: tuple[tuple[str, str], ...] = (
    (f"({URL})", f"{S}$1{E}"),
    (f"({EMAIL})", f"{S}$1{E}"),
    (rf"(?i)(^|[^A-Za-z0-9_])((?:{dims.JS_NAMES})\.js)($|[^A-Za-z0-9_])", f"$1{S}$2{E}$3"),
    (r"(\.NET)($|[^A-Za-z0-9_])", f"{S}$1{E}$2"),
    (r"(\.{2,})", f"{S}$1{E}"),
    (rf"(?i)(^|[^A-Za-z0-9_])((?:{dims.SPECIAL_ABBREVIATIONS})\.)\s+", f"$1{S}$2{W}"),
    (rf"(?i)(^|[^A-Za-z0-9_])((?:{dims.SPECIAL_ABBREVIATIONS})\.)", f"$1{S}$2{E}"),
    (r"([0-9]+\.[0-9]+)", f"{S}$1{E}"),
    (rf"(?i)(^|[^A-Za-z0-9_])((?:{'|'.join(dims.ABBREVIATIONS)})\.)\s", f"$1{S}$2{W}"),
)


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """body of c, with c evaluated once however often body names it (filters that are pushed down copy expressions)."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def is_blank(c: Column) -> Column:
    return c.isNull() | c.rlike(f"^{WS}*$")


def mojibake_fixed(c: Column) -> Column:
    for bad, good in dims.MOJIBAKE:
        c = F.replace(c, F.lit(bad), F.lit(good))
    return c


def nfkc(c: Column) -> Column:
    """Compatibility normalisation; ASCII text never leaves the JVM."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))

    # a function in Python is evaluated for every row, so the others are sent as nulls
    wide = F.when(~c.rlike(r"^\p{ASCII}*$"), c)
    return F.coalesce(F.pandas_udf(run, "string")(wide), c)


def whitespace_normalised(c: Column) -> Column:
    return trimmed(F.regexp_replace(F.replace(c, F.lit("\t"), F.lit(" ")), " {2,}", " "))


def cleaned_simple(c: Column) -> Column:
    """Mojibake, control characters and white space; without compatibility normalisation, so wholly in the JVM."""
    return whitespace_normalised(F.regexp_replace(mojibake_fixed(c), CONTROL, ""))


def cleaned(c: Column) -> Column:
    return F.coalesce(let(nfkc(mojibake_fixed(c)), lambda t: whitespace_normalised(F.regexp_replace(t, CONTROL, ""))), F.lit(""))


def is_artifact(c: Column) -> Column:
    def rest(t: Column) -> Column:
        return t.rlike(r"^[0-9pP\-\[]") & reduce(lambda a, p: a | t.rlike(p), ARTIFACTS, F.lit(False))  # few lines begin like one

    return F.coalesce(let(trimmed(c), rest), F.lit(False))


def bullets_normalised(c: Column) -> Column:
    return F.regexp_replace(c, BULLET, "• ")


def punctuation_normalised(c: Column) -> Column:
    c = F.translate(c, "‘’“”", "''\"\"")
    c = F.replace(F.replace(c, F.lit("—"), F.lit(" - ")), F.lit("–"), F.lit(" - "))
    return F.regexp_replace(c, " {2,}", " ")


#: What normalisation must leave alone, in order.
_KEEP = tuple(
    re.compile(p, f)
    for p, f in (
        (EMAIL, 0), (URL, 0), (r"\bC\+\+\b", 0), (r"\bC#\b", 0), (r"\.NET\b", 0), (r"\b[Nn]ode\.js\b", 0), (r"\b[Vv]ue\.js\b", 0), (r"\b[Rr]eact\.js\b", 0), (r"\b[Nn]ext\.js\b", 0), (r"\b[Ee]xpress\.js\b", 0), (r"\b[Dd]3\.js\b", 0),
        (r"\b[Tt]hree\.js\b", 0), (r"\bAngular\.js\b", 0), (r"(?:C?GPA|gpa)[\s:]*\d+\.?\d*(?:\s*/\s*\d+\.?\d*)?", 0), (r"\bv\d+(?:\.\d+)+\b", 0), (r"\b(?:Python|Java|PHP|Ruby|Go|Rust|Swift|Kotlin)\s+\d+(?:\.\d+)*\b", 0),
        (r"\d+\.?\d*\s*\+?\s*(?:years?|yrs?)\b", re.I), (r"\b\d+\.\d+\b", 0), (r"(?:\+?\d{1,3}[\s\-]?)?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{4}", 0),
        (r"\b(?:Mr|Mrs|Ms|Dr|Sr|Jr|Inc|Ltd|Corp|Prof|Dept|Assoc|Mgr|Engr)\.", re.I), (r"\b(?:e\.g|i\.e|vs|etc|approx|est)\.", re.I),
    )
)
_BULLET_PY = re.compile(BULLET)


def normalise_exactly(text: str) -> str:
    """Bullets and punctuation, with the protected tokens cut out and put back unchanged."""
    kept: list[str] = []
    for pattern in _KEEP:
        pieces, at = [], 0
        for m in pattern.finditer(text):
            pieces += [text[at : m.start()], f"\x00{len(kept)}\x01"]
            kept.append(m[0])
            at = m.end()
        text = "".join([*pieces, text[at:]])
    text = _BULLET_PY.sub("• ", text)
    text = text.translate({0x2018: "'", 0x2019: "'", 0x201C: '"', 0x201D: '"', 0x2014: " - ", 0x2013: " - "})
    text = re.sub(" {2,}", " ", text)
    while "\x00" in text:
        text = re.sub("\x00(\\d+)\x01", lambda m: kept[int(m[1])], text)
    return text


def normalised_plain(c: Column) -> Column:
    return punctuation_normalised(bullets_normalised(c))


def normalised_exact(c: Column) -> Column:
    """Only texts with an address or a span of years, where protected tokens make a difference; null for all others."""
    exact = F.pandas_udf(lambda values: values.map(lambda v: None if v is None else normalise_exactly(v)), "string")
    return exact(F.when(c.rlike("(?i)@|http|years?|yrs?"), c))


def normalised(c: Column) -> Column:
    """Bullets and punctuation; what needs no protection stays in the JVM."""
    return F.when(is_blank(c), c).otherwise(F.coalesce(normalised_exact(c), normalised_plain(c)))


def heading_key(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(trimmed(c)), f"{WS}+", " "), r"[.\-;]+$", "")


def embedding_text(c: Column) -> Column:
    """Without one leading heading phrase, which needs no word's end after it; the text itself if nothing is left."""
    stripped = F.regexp_replace(trimmed(c), rf"(?i)^(?:{dims.HEADING_PREFIX})\s*[:\-–—]?\s*", "")
    return F.when(stripped == "", c).otherwise(stripped)


def terms(c: Column) -> Column:
    """The set of content words, sorted."""
    found = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9+#]+"), 0)
    stop = F.array(*[F.lit(w) for w in dims.STOP_WORDS])
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: (F.length(x) > 1) & ~F.array_contains(stop, x))))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, f"{WS}+"), lambda x: x != ""))


def has_requirement_words(c: Column) -> Column:
    return F.lower(c).rlike("|".join(dims.REQUIREMENT_KEYWORDS))


def is_mandatory(c: Column) -> Column:
    return c.rlike(rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{dims.MANDATORY})(?:$|[^\p{{L}}\p{{N}}_])")


def is_list_item(c: Column) -> Column:
    return c.rlike(BULLET + r"\S")


def is_caps(c: Column) -> Column:
    return c.rlike(r"\p{Lu}") & ~c.rlike(r"\p{Ll}")


def is_title_case(c: Column) -> Column:
    """Every run of letters is one capital and small letters behind it (letters without case don't matter)."""
    return c.rlike(r"\p{Lu}") & ~c.rlike(r"[\p{Lu}\p{Ll}]\p{Lu}") & ~c.rlike(r"(?:^|[^\p{Lu}\p{Ll}])\p{Ll}")


def is_heading_shape(c: Column) -> Column:
    t, n = trimmed(c), word_count(c)
    size = F.char_length(t)
    caps = is_caps(t) & n.between(1, 6) & (size <= 60)
    colon = t.endswith(":") & n.between(1, 5) & (size <= 50)
    title = n.between(1, 4) & (size <= 40) & t.rlike(r"^\p{Lu}") & ~t.rlike(r"[0-9]|\.$") & is_title_case(t)
    return F.coalesce(caps | colon | title, F.lit(False))


def sentences(c: Column) -> Column:
    """A paragraph cut after . ! ? before a capital, but not in or after protected tokens."""
    for p, r in PROTECT:
        c = F.regexp_replace(c, p, r)
    c = F.regexp_replace(c, r"([.!?])\s+([A-Z])", f"$1{CUT}$2")
    c = F.replace(F.regexp_replace(c, f"{S}|{E}", ""), F.lit(W), F.lit(" "))
    return F.filter(F.transform(F.split(c, CUT), trimmed), lambda x: x != "")


def oversized_parts(c: Column, max_words: int) -> Column:
    """A sentence of too many words at its semicolons, else at commas before conjunctions, else at commas, else every
    max_words words. The delimiters are lost."""
    words = F.filter(F.split(c, f"{WS}+"), lambda x: x != "")
    by_words = F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / max_words).cast("int")), lambda i: F.concat_ws(" ", F.slice(words, i * max_words + 1, max_words)))
    semi = F.split(c, r";\s*")
    conj = F.split(F.regexp_replace(c, r",\s+((?:and|or|but|which|where|while)(?:$|[^A-Za-z0-9_]))", CUT + "$1"), CUT)
    comma = F.split(c, r",\s+")
    keep = lambda parts: F.filter(F.transform(parts, trimmed), lambda x: x != "")
    return F.when(F.size(semi) > 1, keep(semi)).when(F.size(conj) > 1, keep(conj)).when(F.size(comma) > 1, keep(comma)).otherwise(by_words)


def sanitised_name(c: Column) -> Column:
    """A file name without path tricks: no NUL, no .., no slashes; odd characters and blanks as one underscore."""
    t = F.translate(F.replace(F.replace(c, F.lit("\x00"), F.lit("")), F.lit(".."), F.lit("")), "/\\", "__")
    t = F.regexp_replace(F.regexp_replace(t, rf"[^\p{{L}}\p{{N}}_\s.\-]", "_"), rf"[_\s\p{{Z}}]+", "_")
    ext = F.regexp_extract(t, r"[^.](\.[^.]+)$", 1)
    stem = F.regexp_replace(F.regexp_replace(t, r"([^.])\.[^.]+$", "$1"), r"^[_.]+|[_.]+$", "")
    return F.concat(F.when(stem == "", F.lit("unnamed")).otherwise(stem), ext)


def first_int(c: Column, pattern: str) -> Column:
    return F.regexp_extract(c, pattern, 1).try_cast("int")


#: The patterns of required_years and candidate_years.
def required_years(c: Column) -> Column:
    return F.coalesce(first_int(c, r"(?i)([0-9]+)\+?\s*years?"), F.lit(0))


def candidate_years(c: Column, reference_year: int = 2026) -> Column:
    """Years of experience that a text states, else the span of the years in it, at least 1."""
    stated = first_int(c, r"(?i)([0-9]+)\+?\s*years?\s*(?:of\s*)?experience")
    spaced = F.concat(F.lit("  "), F.regexp_replace(c, r"[^\p{L}\p{N}_]+", "  "), F.lit("  "))
    years = F.transform(F.regexp_extract_all(spaced, F.lit(" ((?:20|19)[0-9]{2}) "), 1), lambda y: y.cast("int"))
    upper = F.when(F.lower(c).rlike("present|current"), F.lit(reference_year)).otherwise(F.array_max(years))
    return F.coalesce(stated, F.greatest(F.lit(1), upper - F.array_min(years)), F.lit(1))
