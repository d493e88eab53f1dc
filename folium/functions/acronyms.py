"""Acronyms and their long forms, by letter matching from the end.

A scan looks at each ``text (inside)``: an inside of three words or more is the long form of
the word before it, a shorter one is the short form of the words before it."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The shape of a text before a parenthesis with its inside, of a short form and
# of a candidate in running text, and upper-case words that are no acronyms.
_PAIR = re.compile(r"([^()]{1,200}?)\s*\(\s*([A-Za-z0-9][A-Za-z0-9\-&,.\s]{1,200}?)\s*\)")
SHORT = r"^[A-Za-z0-9][A-Za-z0-9\-&]{1,9}$"
CANDIDATE = r"(?<![\p{L}\p{N}_])([A-ZÄÖÜ][A-ZÄÖÜ0-9\-&]{1,9})(?![\p{L}\p{N}_])"
NO_ACRONYMS = "DER DIE DAS UND ODER ICH WIR SIE ER ES THE AND OR FOR NOT BUT YES NO TO OF GMBH KG EG EU USA UK".split()
CONTEXT = 100


def valid_short(word: Column) -> Column:
    """2 to 10 characters, two capitals at least, and half of the letters capitals."""
    upper = F.char_length(F.regexp_replace(word, r"[^\p{Lu}]", ""))
    letters = F.char_length(F.regexp_replace(word, r"[^\p{L}]", ""))
    return word.rlike(SHORT) & (upper >= 2) & (2 * upper >= letters)


def is_short(word: str) -> bool:
    """``valid_short`` for one Python string."""
    upper, letters = sum(c.isupper() for c in word), sum(c.isalpha() for c in word)
    return re.match(SHORT, word) is not None and upper >= 2 and 2 * upper >= letters


def letters_match(short: str, long: str) -> bool:
    """Whether the short form's letters occur in the long form in order, the first at a word's start.

    Each is looked for from the end, as far right as the ones after it leave room."""
    end, text = len(long), long.lower()
    if len(text) != len(long):
        end = len(text)
    for k in range(len(short) - 1, -1, -1):
        c = short[k].lower()
        if not c.isalnum():
            continue
        at = text.rfind(c, 0, end)
        while k == 0 and at > 0 and text[at - 1].isalnum():
            at = text.rfind(c, 0, at)
        if at < 0:
            return False
        end = at
    return True


def trim_long(before: str, short: str) -> str | None:
    """The fewest last words whose letters match, among max(|A| + 5, 2|A|) words."""
    words = before.split()
    for n in range(1, min(len(words), max(len(short) + 5, 2 * len(short))) + 1):
        tail = " ".join(words[-n:])
        if letters_match(short, tail):
            return tail
    return None


def pairs_of(text: str | None) -> dict[str, str]:
    """Short form -> long form; the first long form of a short one counts."""
    found: dict[str, str] = {}
    for m in _PAIR.finditer(text or ""):
        before, inside = m[1].strip(), m[2].strip()
        if len(inside.split()) >= 3:
            short = (before.split() or [""])[-1].rstrip(",.;:")
            long = inside if is_short(short) and letters_match(short, inside) else None
        else:
            short = inside
            long = trim_long(before, short) if is_short(short) and short not in found else None
        if long:
            found.setdefault(short, long)
    return found


def pairs_column(text: Column) -> Column:
    """map of short form -> long form, by an Arrow UDF (matching runs back and forth)."""
    @F.pandas_udf("array<struct<short:string,long:string>>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"short": k, "long": v} for k, v in pairs_of(t).items()])

    return F.map_from_entries(found(text))


def match_column(short: Column, long: Column) -> Column:
    @F.pandas_udf("boolean")
    def matches(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([letters_match(x, y) for x, y in zip(a, b, strict=True)])

    return matches(short, long)


def trim_column(before: Column, short: Column) -> Column:
    @F.pandas_udf(StringType())
    def trimmed(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([trim_long(x, y) for x, y in zip(a, b, strict=True)])

    return trimmed(before, short)


def quoted(word: Column) -> Column:
    """A word as a pattern of itself."""
    return F.concat(F.lit("\\Q"), word, F.lit("\\E"))


def resolved(body: Column, long: Column) -> Column:
    """Whether a long form stands anywhere in a body, whatever its case."""
    return F.contains(F.lower(body), F.lower(long))


def expand(body: Column, pairs: Column) -> Column:
    """The body with each long form after the first bare occurrence of its short form.

    Short forms go in the map's order; resolved ones and those before a parenthesis stay."""
    entries = F.map_entries(pairs)

    def add(text: Column, e: Column) -> Column:
        bare = F.concat(F.lit(r"(?s)\A(.*?(?<![\p{L}\p{N}_])"), quoted(e["key"]), F.lit(r"(?![\p{L}\p{N}_])(?!\s*\())"))
        after = F.regexp_replace(text, bare, F.concat(F.lit("$1 ("), F.regexp_replace(e["value"], r"([\\$])", r"\\$1"), F.lit(")")))
        return F.when(resolved(text, e["value"]), text).otherwise(after)

    return F.aggregate(entries, body, add)


def unresolved(notes: DataFrame, key: str, body: str, known: Column) -> DataFrame:
    """(key, acronym, context): candidates of a body that ``known`` (an array) lacks.

    The context is a hundred characters on both sides of the first occurrence."""
    text = F.col(body)
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(CANDIDATE + r"(?!\s?\()"), F.lit(1)))
    names = F.array_except(F.array_except(found, known), F.array(*map(F.lit, NO_ACRONYMS)))
    rows = notes.select(key, text.alias("_t"), F.explode(names).alias("acronym"))
    whole = F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), quoted(F.col("acronym")), F.lit(r"(?![\p{L}\p{N}_])(?!\s?\()"))
    at = F.regexp_instr("_t", whole)
    start = F.greatest(F.lit(1), at - CONTEXT)
    size = at + F.char_length("acronym") + CONTEXT - start
    return rows.select(key, "acronym", F.substring("_t", start, size).alias("context"))
