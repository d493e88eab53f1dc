"""Similarity of strings by their longest common subsequence, in whole numbers of Python.

``ratio`` is 200 * LCS / (sum of lengths).  ``partial_ratio`` is the best ratio of the
shorter string with a part of the longer one of its length, or a shorter part at either
end.  ``token_set_ratio``
compares the shared words, with and without the other words of either side.  A string's
characters are the bits of a number, so a step over one character is a few operations on
words of that length."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _places(text: str) -> dict[str, int]:
    """For each character the bits of its places."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def _common(places: dict[str, int], size: int, other: str) -> int:
    """Length of the longest common subsequence of a string, given by its places, with another."""
    full = (1 << size) - 1
    free = full
    for c in other:
        met = places.get(c)
        if met:
            hit = free & met
            free = ((free + hit) | (free - hit)) & full
    return size - free.bit_count()


def ratio(a: str, b: str) -> float:
    if not a and not b:
        return 100.0
    return 200.0 * _common(_places(a), len(a), b) / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> tuple[float, int]:
    """The best ratio and where in the longer string its part begins (the first of equals).

    A part whose last character the shorter string lacks is no better than the part one
    place before it (at the end: one place after it), so only others are compared."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return (100.0 if not long else 0.0), 0
    m, places = len(short), _places(short)
    best, at = 0.0, 0
    parts = [(i, i + m) for i in range(len(long) - m + 1) if long[i + m - 1] in places]
    parts += [(0, k) for k in range(1, m) if long[k - 1] in places] + [(i, len(long)) for i in range(len(long) - m + 1, len(long)) if long[i] in places]
    for start, end in sorted(parts):
        if 200.0 * min(m, end - start) / (m + end - start) <= best:
            continue
        r = 200.0 * _common(places, m, long[start:end]) / (m + end - start)
        if r > best:
            best, at = r, start
            if best == 100.0:
                break
    return best, at


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    with_left, with_right = f"{both} {left}".strip(), f"{both} {right}".strip()
    pairs = [(with_left, with_right)] + ([(both, with_left), (both, with_right)] if both else [])
    return max(ratio(p, q) for p, q in pairs)


def _column(rule, kind: str):
    def apply(a: Column, b: Column) -> Column:
        @F.pandas_udf(kind)
        def scored(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([None if p is None or q is None else rule(p, q) for p, q in zip(x, y, strict=True)])

        return scored(a, b)

    return apply


ratio_of = _column(ratio, "double")
partial_ratio_of = _column(lambda a, b: partial_ratio(a, b)[0], "double")
partial_place_of = _column(lambda a, b: partial_ratio(a, b)[1], "int")
token_set_ratio_of = _column(token_set_ratio, "double")

EVIDENCE, HALLUCINATED, LEAST, NEAR = 90.0, 75.0, 12, 90.0


def evidence(quote: Column, text: Column) -> Column:
    """struct(ok, score) of evidence keys: token sets nine tenths alike; no evidence is null, an
    empty side fails.  Evidence whose words all occur needs no comparison."""
    some, both = F.coalesce(quote, F.lit("")) != "", (F.coalesce(quote, F.lit("")) != "") & (F.coalesce(text, F.lit("")) != "")
    q, t = F.array_distinct(F.split(quote, " ")), F.array_distinct(F.split(text, " "))
    inside = F.size(F.array_except(q, t)) == 0
    score = F.when(~both, 0.0).when(inside, 100.0).otherwise(token_set_ratio_of(quote, text))
    return F.when(some, F.struct((score >= EVIDENCE).alias("ok"), F.round(score / 100, 3).alias("score")))


def hallucinated(sentence: Column, text: Column) -> Column:
    """Whether a sentence of twelve characters and more is found nowhere in a text; literal
    occurrences need no comparison."""
    literal = F.contains(text, sentence)
    score = F.when(literal, 100.0).otherwise(partial_ratio_of(sentence, text))
    return F.when(F.char_length(F.trim(sentence)) >= LEAST, score < HALLUCINATED).otherwise(False)
