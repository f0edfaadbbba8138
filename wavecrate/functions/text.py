"""Names, titles and keys as Column expressions; Unicode folding by Arrow functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavecrate import patterns as P
from wavecrate.params import ARTICLES, DECORATIONS, GENERIC_TERMS, PLACEHOLDER_MD5, PRO_SOCIETIES, ROMANS


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def ascii_fold(text: pd.Series) -> pd.Series:
    """Accents off, what isn't ASCII then dropped, lower case, trimmed; blank means no signal."""

    def fold(t: str) -> str:
        return unicodedata.normalize("NFKD", t.lower().strip()).encode("ascii", "ignore").decode().strip()

    return text.map(fold, na_action="ignore")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def collapse(text: Column) -> Column:
    """White space runs become one space; ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize(text: Column, unicode: bool = False) -> Column:
    """Lower case, trimmed, straight apostrophes, ``ft.`` and ``feat.`` without dot; accents stay.

    ``unicode`` also composes characters (an Arrow function, so only where texts may be decomposed).
    """
    out = F.trim(F.lower(F.coalesce(text, F.lit(""))))
    out = F.translate(out, "’‘", "''")
    out = F.regexp_replace(out, r"\b(ft|feat)\.", "$1")
    return nfc(out) if unicode else out


def normalized_key(title: Column, artist: Column, unicode: bool = False) -> Column:
    return F.concat(normalize(title, unicode), F.lit(" - "), normalize(F.coalesce(artist, F.lit("")), unicode))


def punct_fold(folded: Column) -> Column:
    """Match key of an already folded name: dots, commas, apostrophes, hyphens and bullets dropped."""
    return collapse(F.regexp_replace(folded, P.FOLDED_PUNCTUATION, ""))


def strip_artist_noise(name: Column) -> Column:
    """A leading marketplace bullet and a trailing rights society go; a name never becomes empty."""
    cut = F.regexp_replace(name, P.BULLET_PREFIX, "")
    cut = F.regexp_replace(cut, r"(?i)\s*\(\s*(?:" + "|".join(PRO_SOCIETIES) + r")\s*\)\s*$", "")
    return F.when(cut == name, name).otherwise(F.coalesce(F.nullif(collapse(cut), F.lit("")), name))


def looks_acronym(name: Column) -> Column:
    s = F.trim(F.coalesce(name, F.lit("")))
    return s.rlike(P.DOTTED_INITIALS) | s.rlike(r"(?:^|\s)\S\s+\S(?:\s|$)")


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def is_stylized(name: Column) -> Column:
    """Most tokens are one character."""
    t = tokens(name)
    return F.size(F.filter(t, lambda x: F.length(x) == 1)) * 2 > F.size(t)


def track_title(title: Column) -> Column:
    """Feature credits and the original-mix marker go; every other version marker stays."""
    t = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    t = F.regexp_replace(t, P.FEATURE_BRACKETS, "")
    t = F.regexp_replace(t, P.ORIGINAL_MARK, "")
    t = F.regexp_replace(t, P.FEATURE_TAIL, "")
    return collapse(t)


def title_key(folded: Column) -> Column:
    """Match key of a folded ``track_title``: brackets and spaced hyphens become spaces."""
    return collapse(F.replace(F.regexp_replace(folded, r"[()\[\]]", " "), F.lit(" - "), F.lit(" ")))


def strip_safe_suffixes(title: Column) -> Column:
    """Markers that don't change the recording's identity go; null if nothing does."""
    out = F.trim(F.regexp_replace(title, P.SAFE_SUFFIX, ""))
    out = F.trim(F.regexp_replace(out, r"\(\s*\)", ""))
    return F.when((out != "") & (out != title), out)


def strip_generic_parens(title: Column) -> Column:
    """Brackets that hold generic version words only go; null if nothing does."""
    generic = "|".join(GENERIC_TERMS)
    words = rf"(?:[^A-Za-z\1]*(?<![A-Za-z])(?:{generic})(?![A-Za-z]))*[^A-Za-z\1]*"
    out = F.trim(F.regexp_replace(title, r"(?i)\(" + words.replace(r"\1", ")") + r"\)", ""))
    out = F.trim(F.regexp_replace(out, r"(?i)\[" + words.replace(r"\1", r"\]") + r"\]", ""))
    return F.when((out != "") & (out != title), out)


def first_artist(artist: Column) -> Column:
    """The part before the first separator that occurs, in the order tried; null if none does."""
    out = F.lit(None).cast("string")
    for sep in reversed(P.FIRST_ARTIST):
        out = F.when(F.contains(artist, F.lit(sep)), F.trim(F.substring_index(artist, sep, 1))).otherwise(out)
    return out


def _date(day: Column, month: Column, year: Column) -> Column:
    y = year.try_cast("int")
    y = F.when(y < 100, F.when(y <= 50, y + 2000).otherwise(y + 1900)).otherwise(y)
    return F.try_to_timestamp(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")


def set_title(title: Column, channel: Column | None = None) -> Column:
    """struct(text, base_title, part_number, part_total, extracted_date) of a set's raw title."""
    t = F.translate(title, "_", " ")
    if channel is not None:
        low, size = F.lower(channel), F.length(channel)
        starts = F.startswith(F.lower(t), F.concat(low, F.lit(" - "))) | F.startswith(F.lower(t), F.concat(low, F.lit(" – ")))
        t = F.when(starts & (size > 0), F.substr(t, size + 4)).otherwise(t)
        for mark in ("-", "- "):
            ends = F.endswith(F.lower(t), F.concat(F.lit(mark), low)) & (size > 0)
            t = F.when(ends, F.rtrim(F.substr(t, F.lit(1), F.greatest(F.lit(0), F.length(t) - size - len(mark))))).otherwise(t)
    t = F.regexp_replace(t, r"@(\S)", "@ $1")
    return let(F.regexp_replace(t, P.SEPARATORS, " - "), _undated)


def _undated(t: Column) -> Column:
    held, day = F.lit(""), F.lit(None).cast("date")
    for p in reversed(P.SET_DATES):
        held = F.when(t.rlike(p), F.regexp_extract(t, p, 0)).otherwise(held)
        day = F.when(t.rlike(p), _date(*[F.regexp_extract(t, p, i) for i in (1, 2, 3)])).otherwise(day)

    def rest(h: Column) -> Column:
        at = F.position(h, t)
        plain = F.when(h == "", t).otherwise(F.concat(F.substr(t, F.lit(1), at - 1), F.substr(t, at + F.length(h))))
        for p in DECORATIONS:
            plain = F.regexp_replace(plain, "(?i)" + p, "")
        return F.lower(collapse(plain))

    return let(F.struct(let(held, rest).alias("t"), day.alias("day")), lambda x: _parts(x["t"], x["day"]))


def _parts(t: Column, day: Column) -> Column:
    digits, roman, fraction = P.PART_DIGITS, P.PART_ROMAN, P.PART_FRACTION
    numerals = F.create_map(*[F.lit(x) for pair in ROMANS.items() for x in pair])
    n, m = (F.regexp_extract(t, fraction, i).try_cast("int") for i in (1, 2))
    part_of = ~t.rlike(P.DATE_FRACTION) & t.rlike(fraction) & (n <= m) & m.between(2, 20)

    def before(p: str) -> Column:
        return F.regexp_replace(F.regexp_replace(t, p, ""), r"[ \-]+$", "")

    part = F.when(t.rlike(digits), F.regexp_extract(t, digits, 1).try_cast("int")).when(t.rlike(roman), F.try_element_at(numerals, F.regexp_extract(t, roman, 1))).when(part_of, n)
    base = F.when(t.rlike(digits), before(digits)).when(t.rlike(roman), before(roman)).when(part_of, before(fraction)).otherwise(t)
    total = F.when(~t.rlike(digits) & ~t.rlike(roman) & part_of, m)
    return F.struct(t.alias("text"), base.alias("base_title"), part.cast("int").alias("part_number"), total.cast("int").alias("part_total"), day.alias("extracted_date"))


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared share of token sets: both empty 1, one empty 0."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.nullif(union, F.lit(0)))


#: Separators in the order tried: pattern, rule, role of later parts, guards.
SEPARATORS = (
    (P.FEATURING, "local", "featured", ""),
    (P.PRESENTING, "local", "primary", ""),
    (r",", "comma", "primary", ""),
    (r" & ", "ampersand", "primary", ""),
    (r" \+ ", "ampersand", "primary", ""),
    (r"\|", "ampersand", "primary", ""),
    (r"(?i)\s+x\s+", "ampersand", "primary", "stylized"),
    (r"(?i)\s+and\s+", "ampersand", "primary", "stylized article"),
    (r"(?i)\s+y\s+", "ampersand", "primary", "stylized article"),
    (r"(?i)\s+e\s+", "ampersand", "primary", "stylized"),
)


def _with_role(later: str) -> Callable[[Column, Column], Column]:
    return lambda t, i: F.struct(t.alias("token"), F.when(i == 0, "primary").otherwise(later).alias("role"), i.alias("position"))


def artist_parts(raw: Column) -> Column:
    """struct(rule, parts): rule is single, local, comma or ampersand; parts are struct(token, role, position).

    The first separator that occurs decides; letter-by-letter names and names that
    go on with an article stay whole.
    """
    s = F.trim(raw)
    alone = F.struct(F.lit("single").alias("rule"), F.array(F.struct(s.alias("token"), F.lit("primary").alias("role"), F.lit(0).alias("position"))).alias("parts"))
    out = alone
    for pattern, rule, later, guards in reversed(SEPARATORS):
        split = F.filter(F.transform(F.split(s, pattern), lambda t: F.trim(t)), lambda t: t != "")
        parts = F.transform(split, _with_role(later))
        found = F.struct(F.lit(rule).alias("rule"), parts.alias("parts"))
        if "article" in guards:
            whole = F.exists(F.slice(split, 2, 100), lambda t: F.lower(F.element_at(F.split(t, r"\s+"), 1)).isin(*ARTICLES))
            found = F.when(whole, alone).otherwise(found)
        if "stylized" in guards:
            found = F.when(is_stylized(s), alone).otherwise(found)
        out = F.when(s.rlike(pattern), found).otherwise(out)
    return out


def is_id_track(title: Column, artist: Column) -> Column:
    """An unidentified entry of a tracklist."""
    t, a = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (title, artist))
    return (t.isin(*P.UNIDENTIFIED) & a.isin(*P.UNIDENTIFIED)) | (t == "")


def search_match(query: str, *columns: Column) -> Column:
    """Whether any column holds the query, as it is or with all spaces left out of both; null counts as empty."""
    q, squeezed = query.lower(), query.lower().replace(" ", "")
    out = F.lit(False)
    for c in columns:
        low = F.lower(F.coalesce(c, F.lit("")))
        out = out | F.contains(low, F.lit(q)) | F.contains(F.replace(low, F.lit(" "), F.lit("")), F.lit(squeezed))
    return out


def escape_like(query: str) -> str:
    """The query with LIKE's own characters made literal, for ``ESCAPE '\\'``."""
    for c in "\\%_":
        query = query.replace(c, "\\" + c)
    return query


def relevance(query: str, name: Column) -> Column:
    """3: equal, 2: starts with the query, 1: holds it."""
    low, q = F.lower(F.coalesce(name, F.lit(""))), F.lit(query.lower())
    return F.when(low == q, 3).when(F.startswith(low, q), 2).otherwise(1)


def cache_key(query: Column) -> Column:
    return F.md5(F.lower(F.trim(query)))


def is_placeholder(image: Column, prefix: str = PLACEHOLDER_MD5) -> Column:
    """Whether an image's bytes are the generic cover, by the start of their digest; null and empty ones aren't."""
    return F.coalesce((F.octet_length(image) > 0) & F.startswith(F.md5(image), F.lit(prefix)), F.lit(False))
