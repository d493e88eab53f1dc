"""Evaluations of notes as one aggregation, merges of clusters, and where notes are written."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.functions.decision import LABELS
from folium.functions.drafts import label_of_scores
from folium.functions.stats import wilson

PROMPT_WORDS = 12_000
# Openings of lines that a page filter knows.
CAPTION = r"(?i)^\s*(Abb\.|Abbildung|Fig\.|Figure|Tab\.|Tabelle)\s*\d+[:.]"
BIBLIOGRAPHY = r"(?i)^\s*(literatur|bibliographie|references|bibliography)\s*$"
ENTRY = r"^\s*[A-ZÄÖÜ][A-Za-zÄÖÜäöüß'`-]+,\s+.*\b(19|20)\d{2}\b"


def by_anchors(anchors: DataFrame, sentences: Column, factual: Column, pages: Column) -> DataFrame:
    """A note's evaluation from its scored anchors (note, label, page) and its counts.

    Anchors that could not be read count in no rate; coverage is over all and over factual
    sentences, and by pages."""
    n = lambda *x: F.count_if(F.col("label").isin(*x))
    rate = lambda a, b: F.when(b > 0, F.round(a / F.nullif(b, F.lit(0)), 3)).otherwise(0.0)
    readable = n("confirmed", "uncertain", "hallucinated")
    rows = anchors.groupBy("note").agg(
        F.count("*").alias("anchors"), readable.alias("parseable"), n("confirmed").alias("confirmed"), n("uncertain").alias("uncertain"), n("hallucinated").alias("hallucinated"),
        F.count_distinct("page").alias("covered"), F.max(sentences).alias("sentences"), F.max(factual).alias("factual"), F.max(pages).alias("pages"),
    )
    ci = wilson(F.col("hallucinated"), F.col("parseable"))
    return rows.select(
        "note", "anchors", "parseable", rate(F.col("hallucinated"), F.col("parseable")).alias("hallucination_rate"), ci["lo"].alias("ci_lo"), ci["hi"].alias("ci_hi"),
        rate(F.col("confirmed"), F.col("sentences")).alias("coverage"), rate(F.col("confirmed"), F.col("factual")).alias("coverage_factual"),
        rate(F.col("covered"), F.col("pages")).alias("source_coverage"), (F.col("parseable") < 5).alias("small_sample"),
    )


def by_claims(claims: DataFrame, chunks: Column) -> DataFrame:
    """A note's evaluation from scores of its claims (note, entailment, contradiction, chunk)."""
    rows = claims.withColumn("label", label_of_scores(F.col("entailment"), F.col("contradiction")))
    n = lambda *x: F.count_if(F.col("label").isin(*x))
    held = F.count_distinct(F.when(F.col("label") == "confirmed", F.col("chunk")))
    share = lambda a, b: F.round(a / b, 3)
    return rows.groupBy("note").agg(
        F.count("*").alias("claims"), share(n("confirmed"), F.count("*")).alias("support_rate"), share(n("hallucinated", "contradiction"), F.count("*")).alias("hallucination_rate"),
        F.round(F.sum(F.col("entailment").cast("decimal(20,6)")) / F.count("*"), 3).cast("double").alias("mean_entailment"), F.round(held / F.nullif(F.max(chunks), F.lit(0)), 3).alias("span_diversity"),
    )


def empty_result(note: Column, error: Column, total: Column) -> Column:
    """The result of a note that could not be evaluated: counts of zero, rates of -1."""
    zero = [F.lit(0).alias(f"claims_{x}") for x in LABELS]
    none = [F.lit(-1.0).alias(x) for x in ("confirmed_rate", "uncertain_rate", "parse_error_rate", "hallucination_rate", "coverage_rate")]
    return F.struct(note.alias("note"), error.alias("error"), total.alias("claims_total"), *zero, *none, F.lit(False).alias("rate_valid"))


def prompt_batches(items: Column, most: int = PROMPT_WORDS) -> Column:
    """array<array<..>>: items (with a number of ``words``) in order, packed up to a prompt's words."""
    def add(state: Column, x: Column) -> Column:
        full = (F.size(state["now"]) > 0) & (state["n"] + x["words"] > most)
        return F.struct(
            F.when(full, F.array_append(state["done"], state["now"])).otherwise(state["done"]).alias("done"),
            F.when(full, F.array(x)).otherwise(F.array_append(state["now"], x)).alias("now"),
            F.when(full, x["words"]).otherwise(state["n"] + x["words"]).alias("n"),
        )

    none = F.slice(items, 1, 0)
    start = F.struct(F.slice(F.array(none), 1, 0).alias("done"), none.alias("now"), F.lit(0).alias("n"))
    return F.aggregate(items, start, add, lambda s: F.when(F.size(s["now"]) > 0, F.array_append(s["done"], s["now"])).otherwise(s["done"]))


def page_lines(lines: Column, recurring: Column) -> Column:
    """A page's lines without recurring ones, captions, and its bibliography: entries go at once,
    and after three of them everything does."""
    kept = F.filter(lines, lambda x: ~F.array_contains(recurring, x) & ~x.rlike(CAPTION))

    def add(state: Column, x: Column) -> Column:
        opens, entry = x.rlike(BIBLIOGRAPHY), state["seen"] & x.rlike(ENTRY)
        hits = state["hits"] + entry.cast("int")
        out = ~opens & ~(state["seen"] & ((hits >= 3) | entry))
        return F.struct((state["seen"] | opens).alias("seen"), hits.alias("hits"), F.when(out, F.array_append(state["out"], x)).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(False).alias("seen"), F.lit(0).alias("hits"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(kept, start, add, lambda s: s["out"])


def unified_diff(old: Column, new: Column, name: Column, most: int = 60) -> Column:
    """A unified diff with two lines of context; lines beyond ``most`` are counted."""

    @F.pandas_udf("string")
    def diff(a: pd.Series, b: pd.Series, names: pd.Series) -> pd.Series:
        out = []
        for x, y, n in zip(a, b, names, strict=True):
            lines = list(difflib.unified_diff((x or "").splitlines(), (y or "").splitlines(), f"old/{n}", f"new/{n}", n=2, lineterm=""))
            more = [f"... {len(lines) - most} more lines"] if len(lines) > most else []
            out.append("\n".join(lines[:most] + more))
        return pd.Series(out)

    return diff(old, new, name)


def safe_alt(text: Column) -> Column:
    """An alternative text on one line that opens no link and no table cell."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.replace(F.replace(F.replace(t, F.lit("[["), F.lit("\\[\\[")), F.lit("]]"), F.lit("\\]\\]")), F.lit("|"), F.lit("\\|"))


def merged_cluster(members: DataFrame) -> DataFrame:
    """Clusters of drafts (cluster, pos, title, aliases, tags, anchors) as one row each.

    Anchors are distinct by page and the first eighty characters of the quote; aliases are those
    of all and the others' titles; a tag counts in two members of a cluster of three or more."""
    size = members.groupBy("cluster").agg(F.count("*").alias("n"), F.min_by("title", "pos").alias("title"))
    anchors = members.select("cluster", F.explode("anchors").alias("a")).groupBy("cluster", F.substring(F.trim("a.quote"), 1, 80).alias("q"), F.coalesce("a.page", F.lit("")).alias("p")).agg(F.lit(1).alias("x"))
    anchors = anchors.groupBy("cluster").agg(F.count("*").alias("anchors"))
    names = members.select("cluster", F.explode(F.concat(F.array("title"), "aliases")).alias("alias")).distinct().join(size.select("cluster", "title"), "cluster").where("alias <> title")
    names = names.groupBy("cluster").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    tags = members.select("cluster", F.explode(F.array_distinct("tags")).alias("tag")).groupBy("cluster", "tag").agg(F.count("*").alias("k")).join(size.select("cluster", "n"), "cluster")
    tags = tags.where((F.col("n") < 3) | (F.col("k") >= 2)).groupBy("cluster").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    none = F.array().cast("array<string>")
    out = size.join(anchors, "cluster", "left").join(names, "cluster", "left").join(tags, "cluster", "left")
    return out.select("cluster", "title", F.coalesce("anchors", F.lit(0)).alias("anchors"), F.coalesce("aliases", none).alias("aliases"), F.coalesce("tags", none).alias("tags"))


def write_plan(drafts: DataFrame, vault: DataFrame, inbox: DataFrame) -> DataFrame:
    """(id, action, path): how drafts (id, title, source) are written.

    A title that the vault (title, source) has becomes a merge stub, marked where the sources
    differ; a pristine inbox note (path, title, source, pristine) of the same source is overwritten,
    an edited one gets a variant beside it; else the note is new."""
    from folium.functions.text import title_key
    from folium.operators.links import inbox_match

    held = vault.groupBy(title_key(F.col("title")).alias("k")).agg(F.min("source").alias("held"))
    found = inbox_match(drafts, inbox).withColumnRenamed("path", "old")
    state = inbox.select(F.col("path").alias("old"), "pristine")
    rows = drafts.withColumn("k", title_key(F.col("title"))).join(held, "k", "left").join(found, "id").join(state, "old", "left")
    new = F.concat("title", F.lit(".md"))
    action = F.when(F.col("held").isNotNull(), F.when(F.col("held") == F.col("source"), "merge").otherwise("cross-source merge")).when(F.col("old").isNull(), "create").when(F.col("pristine"), "overwrite").otherwise("variant")
    path = F.when(F.col("held").isNotNull(), F.concat(F.when(F.col("held") == F.col("source"), "MERGE - ").otherwise("XSOURCE-MERGE - "), new)).when(F.col("old").isNull(), new)
    path = F.coalesce(path, F.when(F.col("pristine"), F.col("old")).otherwise(F.regexp_replace("old", r"\.md$", "-2.md")))
    return rows.select("id", action.alias("action"), path.alias("path"))
