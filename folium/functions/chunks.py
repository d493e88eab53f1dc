"""Chunks and windows of text that are packed or ranked by their content."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folium.functions.fuzzy import partial_ratio
from folium.functions.text import bound, words

CHUNK_WORDS = (100, 180)
WINDOW_WORDS, WINDOW_CHARS, TITLE_WEIGHT = 400, 8000, 100
CENTRAL, FOUND = 4, 70.0


def packed(sentences: Column, least: int = CHUNK_WORDS[0], most: int = CHUNK_WORDS[1]) -> Column:
    """array<array<string>>: sentences in order, packed up to ``most`` words once a chunk has
    ``least``; a chunk begins with the last sentence of the one before."""
    none = F.array().cast("array<string>")

    def add(state: Column, s: Column) -> Column:
        n = F.size(words(s))
        full = (F.size(state["now"]) > 0) & (state["n"] + n > most) & (state["n"] >= least)
        last = F.slice(state["now"], -1, 1)
        return F.when(
            full,
            F.struct(
                F.array_append(state["done"], state["now"]).alias("done"),
                F.array_append(last, s).alias("now"),
                (F.size(words(F.try_element_at(state["now"], F.lit(-1)))) + n).alias("n"),
            ),
        ).otherwise(F.struct(state["done"].alias("done"), F.array_append(state["now"], s).alias("now"), (state["n"] + n).alias("n")))

    start = F.struct(F.array().cast("array<array<string>>").alias("done"), none.alias("now"), F.lit(0).alias("n"))
    return F.aggregate(sentences, start, add, lambda s: F.when(F.size(s["now"]) > 0, F.array_append(s["done"], s["now"])).otherwise(s["done"]))


# Hyphens at breaks, reference numbers, and fragments of citations.
_FRAGMENT = r"^[;,\s]*[A-Z][a-z]+,?\s+[A-Z]\..*?\(S\.\s*\d+\)\s*$"


def clean_sentence(sentence: Column) -> Column:
    """A sentence without extraction marks; fragments and what is under twenty characters are empty."""
    t = F.regexp_replace(sentence, r"([\p{L}\p{N}_]+)-\s*\n?\s*([\p{L}\p{N}_]+)", "$1$2")
    t = F.trim(F.regexp_replace(t, r"\[\d+(?:,\s*\d+)*\]", ""))
    bare = F.trim(F.regexp_replace(t, r"\s*\(S\.\s*\d+(?:-\d+)?\)", ""))
    return F.when(t.rlike(_FRAGMENT) | (F.char_length(bare) < 20), "").otherwise(t)


def around_hits(concept: str, sentences: list[str], context: int = 1, threshold: float = FOUND) -> list[int]:
    """Places of sentences that name a concept, each with its neighbours, in the order of the hits."""
    out: dict[int, None] = {}
    for i, s in enumerate(sentences):
        if partial_ratio(concept.lower(), s.lower())[0] >= threshold:
            out.update(dict.fromkeys(range(max(0, i - context), min(len(sentences), i + context + 1))))
    return list(out)


def central(sentences: list[str], n: int = CENTRAL, rounds: int = 100) -> list[int]:
    """The n most central sentences in their own order: the stationary weights of a walk along
    TF-IDF cosines of a tenth and more.  n sentences and fewer all stay."""
    if len(sentences) <= n:
        return list(range(len(sentences)))
    bags = [Counter(re.findall(r"\w+", s.lower())) for s in sentences]
    df = Counter(w for b in bags for w in b)
    index = {w: k for k, w in enumerate(sorted(df))}
    m = np.zeros((len(bags), len(index)))
    for i, b in enumerate(bags):
        for w, c in b.items():
            m[i, index[w]] = c * np.log(len(bags) / df[w])
    norm = np.linalg.norm(m, axis=1)
    cosine = (m @ m.T) / np.maximum(np.outer(norm, norm), 1e-12)
    links = (cosine >= 0.1).astype(float) + 1e-9
    walk = links / links.sum(axis=1, keepdims=True)
    weight = np.full(len(bags), 1 / len(bags))
    for _ in range(rounds):
        weight = 0.15 / len(bags) + 0.85 * weight @ walk
    best = np.lexsort((np.arange(len(bags)), -weight.round(12)))[:n]
    return sorted(best.tolist())


def concept_window(text: str, terms: list[str], size: int = WINDOW_WORDS, most: int = WINDOW_CHARS) -> str:
    """The windows of a text that speak most of a concept, joined where they overlap.

    terms[0] is the title, a hundred points for each occurrence; every other term that occurs is
    one.  Windows begin every half window; the best are taken up to ``most`` characters."""
    tokens = [(m[0], m.start()) for m in re.finditer(r"\S+", text)]
    if not terms or not tokens:
        return text[:most] if not terms else ""
    title = " ".join(terms[0].split()).lower()
    others = [re.compile(rf"(?<!\w){re.escape(t)}(?!\w)", re.I) for t in terms[1:] if t]
    step, spans = max(1, size // 2), []
    for start in range(0, len(tokens), step):
        end = min(start + size, len(tokens))
        window = " ".join(w for w, _ in tokens[start:end])
        score = TITLE_WEIGHT * (window.lower().count(title) if title else 0) + sum(1 for p in others if p.search(window))
        if score:
            spans.append((-score, start, end))
        if end == len(tokens):
            break
    gap = "\n\n[...]\n\n"
    taken: list[tuple[int, int]] = []
    used = 0
    for _, start, end in sorted(spans):
        cost = sum(len(w) + 1 for w, _ in tokens[start:end]) + (len(gap) if taken else 0)
        if taken and used + cost > most:
            break
        taken.append((start, end))
        used += cost
        if used >= most:
            break
    joined: list[list[int]] = []
    for start, end in sorted(taken):
        if joined and start <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], end)
        else:
            joined.append([start, end])
    markers = [(m.start(), m[1]) for m in re.finditer(r"(?m)^[ \t]*\[S\.\s*(\d+)\][ \t]*$", text)]
    out = []
    for start, end in joined:
        page = next((p for at, p in reversed(markers) if at <= tokens[start][1]), None)
        part = " ".join(w for w, _ in tokens[start:end])
        out.append(f"[S. {page}] {part}" if page and not part.startswith("[S.") else part)
    return gap.join(out)


def window_column(text: Column, terms: Column) -> Column:
    @F.pandas_udf("string")
    def window(texts: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([concept_window(t or "", list(x)) for t, x in zip(texts, lists, strict=True)])

    return window(text, terms)


def central_column(sentences: Column, concept: Column) -> Column:
    """The central sentences among those around a concept's mentions; none where it has none."""

    @F.pandas_udf("array<string>")
    def picked(lists: pd.Series, concepts: pd.Series) -> pd.Series:
        out = []
        for s, c in zip(lists, concepts, strict=True):
            near = [s[k] for k in around_hits(c, list(s))]
            out.append([near[k] for k in central(near)])
        return pd.Series(out)

    return picked(sentences, concept)


def around_column(sentences: Column, concept: Column) -> Column:
    @F.pandas_udf("array<string>")
    def near(lists: pd.Series, concepts: pd.Series) -> pd.Series:
        return pd.Series([[s[k] for k in around_hits(c, list(s))] for s, c in zip(lists, concepts, strict=True)])

    return near(sentences, concept)


def coverage(titles: Column, text: Column, overview: Column, tokens) -> Column:
    """struct(n, in_text, half, most, all, phrase): titles half of whose tokens a text holds, and how
    many keep a half, three quarters and all of them in its overview, or their very phrase."""
    share = lambda own, held: F.size(F.array_intersect(own, held)) / F.nullif(F.size(own), F.lit(0))
    flat = lambda t: F.lower(F.regexp_replace(t, r"\s+", " "))

    def kept(rows: Column) -> Column:
        n = lambda rule: F.size(F.filter(rows, rule))
        return F.struct(
            F.size(titles).alias("n"), F.size(rows).alias("in_text"), n(lambda r: r["o"] >= 0.5).alias("half"), n(lambda r: r["o"] >= 0.75).alias("most"),
            n(lambda r: r["o"] >= 1.0).alias("every"), n(lambda r: r["p"]).alias("phrase"),
        )

    def rows(full: Column, view: Column) -> Column:
        of = lambda t: bound(tokens(t), lambda own: F.struct(share(own, full).alias("f"), share(own, view["short"]).alias("o"), F.contains(view["flat"], flat(t)).alias("p")))
        return F.filter(F.transform(titles, of), lambda r: r["f"] >= 0.5)

    view = bound(overview, lambda o: F.struct(tokens(o).alias("short"), flat(o).alias("flat")))
    return bound(tokens(text), lambda full: bound(view, lambda v: bound(rows(full, v), kept)))


def distinct_names(names: pd.DataFrame, threshold: float, rule) -> pd.DataFrame:
    """Rows (name, score), best first, of which none is like one that was kept."""
    kept: list[str] = []
    rows = []
    for r in names.sort_values(["score", "name"], ascending=[False, True], kind="stable").itertuples(index=False):
        key = r.name.lower().strip()
        if all(rule(key, k) < threshold for k in kept):
            kept.append(key)
            rows.append(r)
    return pd.DataFrame(rows, columns=names.columns)
