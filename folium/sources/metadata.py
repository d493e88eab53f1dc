"""Bibliographic answers as rows: what services return, in one shape, and the first that is usable.

A service is a callable from ids to texts (``fetch``); without a network an offline one takes
its place.  The expressions only read the texts.  Every reader returns
struct(title, author, year, doi, type), null where the answer is no record."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Types of works that count as reviewed, and a count of citations that is low.
REVIEWED = ["journal-article", "proceedings-article", "dissertation"]
FEW_CITATIONS = 5


def fetched(ids: DataFrame, fetch: Callable[[str], str | None], column: str = "id", answer: str = "answer") -> DataFrame:
    """Rows with the text that a service returns for an id; a failure is a null answer."""
    kept = ids.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for x in pdf[column]:
                try:
                    found.append(None if x is None else fetch(x))
                except Exception:  # a service that fails is one that knows nothing
                    found.append(None)
            yield pdf.assign(**{answer: found})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return ids.mapInPandas(run, f"{fields}, `{answer}` string")


def _get(json: Column, path: str) -> Column:
    return F.get_json_object(json, path)


def _work(title: Column, author: Column, year: Column, doi: Column, kind: Column, known: Column) -> Column:
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.when(
        known, F.struct(text(title).alias("title"), text(author).alias("author"), year.try_cast("int").alias("year"), text(doi).alias("doi"), text(kind).alias("type"))
    )


def _year(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(\d{4})", 1), F.lit(""))


def _last_word(name: Column) -> Column:
    return F.try_element_at(F.filter(F.split(name, r"\s+"), lambda w: w != ""), F.lit(-1))


def crossref(json: Column) -> Column:
    """A work message: first title, first family name, first part of the date."""
    m = F.coalesce(_get(json, "$.message"), json)
    return _work(_get(m, "$.title[0]"), _get(m, "$.author[0].family"), _get(m, "$.published.date-parts[0][0]"), _get(m, "$.DOI"), _get(m, "$.type"), _get(m, "$.title").isNotNull())


def open_library(json: Column) -> Column:
    """A book: last word of the first author's name, first four digits of the date."""
    return _work(_get(json, "$.title"), _last_word(_get(json, "$.authors[0].name")), _year(_get(json, "$.publish_date")), F.lit(""), F.lit("book"), _get(json, "$.title").isNotNull())


def google_books(json: Column) -> Column:
    i = _get(json, "$.items[0].volumeInfo")
    year = F.nullif(F.regexp_extract(_get(i, "$.publishedDate"), r"^(\d{4})", 1), F.lit(""))
    return _work(_get(i, "$.title"), _last_word(_get(i, "$.authors[0]")), year, F.lit(""), F.lit("book"), i.isNotNull())


def arxiv(xml: Column) -> Column:
    """The first entry of a feed."""
    entry = F.nullif(F.regexp_extract(xml, r"(?s)<entry>(.*?)</entry>", 1), F.lit(""))
    field = lambda tag: F.trim(F.regexp_replace(F.regexp_extract(entry, rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1), r"\s+", " "))
    return _work(field("title"), _last_word(field("name")), _year(field("published")), field("arxiv:doi"), F.lit("preprint"), entry.isNotNull())


def pubmed(json: Column, pmid: Column) -> Column:
    r = F.get(F.map_values(F.map_filter(F.from_json(_get(json, "$.result"), "map<string,string>"), lambda k, _: k == pmid)), F.lit(0))
    author = F.substring_index(_get(r, "$.authors[0].name"), " ", 1)
    doi = F.rtrim(F.regexp_extract(_get(r, "$.elocationid"), r"(10\.\d{4,9}/\S+)", 1), F.lit(".,;)"))
    return _work(_get(r, "$.title"), author, _year(_get(r, "$.pubdate")), doi, F.lit("journal-article"), r.isNotNull())


def openalex(json: Column) -> Column:
    """The first result of a title search."""
    r = F.coalesce(_get(json, "$.results[0]"), F.when(F.lit(False), json))
    doi = F.replace(F.coalesce(_get(r, "$.doi"), F.lit("")), F.lit("https://doi.org/"), F.lit(""))
    return _work(_get(r, "$.title"), _last_word(_get(r, "$.authorships[0].author.display_name")), _get(r, "$.publication_year"), doi, _get(r, "$.type"), r.isNotNull())


def tei_header(xml: Column) -> Column:
    """Title, first surname, year and DOI of a TEI header."""
    one = lambda p: F.trim(F.regexp_extract(xml, p, 1))
    title = one(r"(?s)<titleStmt>.*?<title[^>]*>(.*?)</title>")
    return _work(title, one(r"(?s)<surname>(.*?)</surname>"), _year(one(r'<date[^>]*when="([^"]*)"')), one(r'(?s)<idno type="DOI">(.*?)</idno>'), F.lit(""), title != "")


def start_page(json: Column) -> Column:
    """The first number of a page range."""
    return F.nullif(F.regexp_extract(_get(json, "$.page"), r"^\s*(\d+)", 1), F.lit("")).try_cast("int")


def issued_year(json: Column) -> Column:
    """The year of the first date that a record has."""
    return F.coalesce(*[F.nullif(_get(json, f"$.{k}.date-parts[0][0]"), F.lit("null")) for k in ("issued", "published-print", "published-online")]).try_cast("int")


def quality(doi: Column, crossref_json: Column, openalex_json: Column) -> Column:
    """struct(reviewed, citations, retracted, flags) of a work by its type, updates and citations."""
    kind = _get(crossref_json, "$.type")
    updates = F.transform(F.coalesce(F.from_json(_get(crossref_json, "$.update-to"), "array<struct<type:string>>"), F.array().cast("array<struct<type:string>>")), lambda u: F.lower(u["type"]))
    has = lambda *x: F.exists(updates, lambda u: u.isin(*x))
    reviewed = F.when(crossref_json.isNotNull(), F.coalesce(kind.isin(REVIEWED), F.lit(False)))
    citations = F.coalesce(_get(crossref_json, "$.is-referenced-by-count"), _get(openalex_json, "$.cited_by_count")).cast("int")
    retracted = F.coalesce(kind == "retracted-article", F.lit(False)) | has("retraction", "withdrawal") | F.coalesce(_get(openalex_json, "$.is_retracted") == "true", F.lit(False))
    flags = F.array_compact(
        F.array(
            F.when(has("expression-of-concern"), "expression of concern"),
            F.when(has("correction", "erratum"), "corrected"),
            F.when(retracted, "retracted"),
            F.when(citations < FEW_CITATIONS, F.concat(F.lit("few citations n="), citations.cast("string"))),
            F.when(~reviewed, "not peer-reviewed"),
            F.when(doi.isNull(), "no DOI"),
        )
    )
    return F.struct(reviewed.alias("reviewed"), citations.alias("citations"), retracted.alias("retracted"), flags.alias("flags"))


def cascade(rows: DataFrame, steps: list[tuple[str, Callable[[DataFrame], DataFrame]]], key: str) -> DataFrame:
    """(key, step, work): the first step that finds a work; a step sees only rows still open.

    A step maps rows to (key, work).  Steps are few and fixed, so the plan is a chain of joins."""
    found, open_rows = None, rows
    for name, step in steps:
        hits = step(open_rows).where("work is not null").select(key, F.lit(name).alias("step"), "work")
        found = hits if found is None else found.unionByName(hits)
        open_rows = open_rows.join(hits.select(key), key, "left_anti")
    return rows.select(key).join(found, key, "left")
