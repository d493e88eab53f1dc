"""Plans over bibliographic answers, rendered from rows by offline services and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from folium.functions import names as N
from folium.functions import text as T
from folium.plans.registry import Registry
from folium.sources import metadata as M
from folium.sources.tables import table

QUERIES = Registry()
query = QUERIES.query


def parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", (F.col("p_size") + 1970).alias("year"), "p_size")


def json(**fields):
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


_WORK = "SELECT p_partkey, p_name AS title, {author} AS author, {year} AS year, {doi} AS doi, '{kind}' AS type FROM part{where}"


def _reader(name: str, answer, read, author="'Smith'", year="(p_size + 1970)::INT", doi="''", kind="book", where=""):
    @query(name, _WORK.format(author=author, year=year, doi=doi, kind=kind, where=where))
    def one(spark, sf_dir):
        rows = parts(spark, sf_dir).withColumn("answer", answer()).withColumn("w", read(F.col("answer"))).where("w is not null")
        return rows.select("p_partkey", "w.title", "w.author", "w.year", "w.doi", "w.type")


def crossref_text():
    author = F.array(F.struct(F.col("p_brand").alias("family")), F.struct(F.lit("Two").alias("family")))
    date = F.concat(F.lit('{"date-parts":[['), "year", F.lit(",3]]}"))
    body = F.to_json(F.struct(F.array("p_name").alias("title"), author.alias("author"), F.concat(F.lit("10.1/"), "p_partkey").alias("DOI"), F.lit("journal-article").alias("type")))
    return F.concat(F.lit('{"message":'), F.regexp_replace(body, r"\}$", ""), F.lit(',"published":'), date, F.lit("}}"))


_reader("f109_crossref", crossref_text, M.crossref, author="p_brand", doi="'10.1/' || p_partkey", kind="journal-article")
_reader("f110_open_library", lambda: json(title=F.col("p_name"), authors=F.array(F.struct(F.lit("Ann B. Smith").alias("name"))), publish_date=F.concat(F.lit("May "), "year")), M.open_library)
_reader(
    "s46_google_books",
    lambda: json(items=F.array(F.struct(F.struct(F.col("p_name").alias("title"), F.array(F.lit("Ann Smith")).alias("authors"), F.concat("year", F.lit("-03")).alias("publishedDate")).alias("volumeInfo")))),
    M.google_books,
)
_reader(
    "s47_arxiv",
    lambda: F.concat(F.lit("<feed><title>no</title><entry>\n<title>"), "p_name", F.lit("</title><author><name>Ann Smith</name></author><published>"), "year", F.lit("-01-02T00:00</published></entry></feed>")),
    M.arxiv, kind="preprint",
)
_reader(
    "s48_pubmed",
    lambda: F.concat(F.lit('{"result":{"uids":["7"],"7":'), json(title=F.col("p_name"), authors=F.array(F.struct(F.lit("Smith AB").alias("name"))), pubdate=F.concat("year", F.lit(" Mar")), elocationid=F.lit("doi: 10.1234/x.")), F.lit("}}")),
    lambda a: M.pubmed(a, F.lit("7")), doi="'10.1234/x'", kind="journal-article",
)
_reader(
    "s49_openalex",
    lambda: F.when(F.col("p_size") % 2 == 0, json(results=F.array(F.struct(F.col("p_name").alias("title"), F.array(F.struct(F.struct(F.lit("Ann Smith").alias("display_name")).alias("author"))).alias("authorships"), F.col("year").alias("publication_year"), F.lit("https://doi.org/10.1/z").alias("doi"), F.lit("article").alias("type"))))).otherwise('{"results":[]}'),
    M.openalex, doi="'10.1/z'", kind="article", where=" WHERE p_size % 2 = 0",
)
_reader(
    "s50_tei_header",
    lambda: F.concat(F.lit("<TEI><titleStmt>\n<title level='a'>"), "p_name", F.lit("</title></titleStmt><surname>Smith</surname><surname>Two</surname><date when=\""), "year", F.lit('-05"/><idno type="DOI">10.1/t</idno></TEI>')),
    M.tei_header, doi="'10.1/t'", kind="",
)


@query("s44_crossref_lookup", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'Title of 10.1/' || p_partkey END AS title FROM part")
def crossref_lookup(spark, sf_dir):
    """A service that knows a third of the works, fails for a third, and has no answer for the rest."""

    def service(doi: str) -> str | None:
        import json as j

        size = int(doi.split("#")[1])
        if size % 3 == 1:
            raise TimeoutError
        return j.dumps({"message": {"title": ["Title of " + doi.split("#")[0]]}}) if size % 3 == 0 else None

    doi = F.concat(F.lit("10.1/"), "p_partkey", F.lit("#"), "p_size")
    rows = M.fetched(table(spark, sf_dir, "part").select("p_partkey", doi.alias("id")), service)
    return rows.select("p_partkey", M.crossref(F.col("answer")).alias("w")).select("p_partkey", "w.title")


@query("s59_embedded_metadata", "SELECT p_partkey, p_name AS title, 'Smith' AS author, CASE WHEN p_size % 2 = 0 THEN 2004 END AS year, CASE WHEN p_size % 2 = 0 THEN '10.1/k' ELSE '' END AS doi FROM part WHERE p_size % 5 > 0")
def embedded_metadata(spark, sf_dir):
    """Title and author of a file where both are plausible, year and DOI from other fields."""
    author = F.when(F.col("p_size") % 5 == 0, "Administrator").otherwise("Ann Smith")
    subject, words = F.when(F.col("p_size") % 2 == 0, "Vol 3, 2004"), F.when(F.col("p_size") % 2 == 0, "10.1/k").otherwise("some words")
    rows = parts(spark, sf_dir).select("p_partkey", F.col("p_name").alias("title"), author.alias("a"), subject.alias("s"), words.alias("k"))
    ok = rows.where(N.plausible_author(F.col("a")) & N.plausible_title(F.col("title")))
    year = F.nullif(F.regexp_extract("s", r"(\d{4})", 1), F.lit("")).cast("int")
    return ok.select("p_partkey", "title", N.surname(F.col("a")).alias("author"), year.alias("year"), F.when(F.col("k").startswith("10."), F.col("k")).otherwise("").alias("doi"))


@query("s60_doi_by_title", "SELECT p_partkey, '10.1/' || p_partkey || '-b' AS doi FROM part WHERE p_size % 2 = 0")
def doi_by_title(spark, sf_dir):
    """The best of three results that scores eighty and more and is of the year."""
    from pyspark.sql import Window

    doi = lambda k: F.concat(F.lit("10.1/"), "p_partkey", F.lit(k)).alias("doi")
    best = F.when(F.col("p_size") % 2 == 0, 95).otherwise(79)
    found = F.array(F.struct(F.lit(99).alias("score"), F.lit(1900).alias("y"), doi("-a")), F.struct(best.alias("score"), F.lit(2000).alias("y"), doi("-b")), F.struct(F.lit(60).alias("score"), F.lit(2000).alias("y"), doi("-c")))
    rows = parts(spark, sf_dir).select("p_partkey", F.explode(found).alias("f")).select("p_partkey", "f.*").where("score >= 80 and y = 2000")
    first = F.row_number().over(Window.partitionBy("p_partkey").orderBy(F.desc("score"), "doi"))
    return rows.withColumn("k", first).where("k = 1").select("p_partkey", "doi")


@query("f98_pages_and_years", "SELECT p_partkey, 172 + p_size AS page, CASE WHEN p_size % 2 = 0 THEN (1970 + p_size)::INT END AS year FROM part")
def pages_and_years(spark, sf_dir):
    date = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(',"published-online":{"date-parts":[['), "year", F.lit("]]}"))).otherwise(',"issued":{"date-parts":[[null]]}')
    answer = F.concat(F.lit('{"page":" '), F.col("p_size") + 172, F.lit('-190"'), date, F.lit("}"))
    rows = parts(spark, sf_dir).withColumn("a", answer)
    return rows.select("p_partkey", M.start_page(F.col("a")).cast("long").alias("page"), M.issued_year(F.col("a")).alias("year"))


@query("f99_quality_report", """WITH x AS (SELECT p_partkey, p_size, p_size % 4 = 0 AS journal, p_size % 7 = 0 AS gone, p_size % 5 = 0 AS fixed FROM part)
SELECT p_partkey, journal AS reviewed, p_size % 9 AS citations, gone AS retracted, array_to_string(list_filter([CASE WHEN fixed AND NOT gone THEN 'corrected' END, CASE WHEN gone THEN 'retracted' END, CASE WHEN p_size % 9 < 5 THEN 'few citations n=' || p_size % 9 END, CASE WHEN NOT journal THEN 'not peer-reviewed' END], lambda f: f IS NOT NULL), ',') AS flags FROM x""")
def quality_report(spark, sf_dir):
    s = F.col("p_size")
    update = F.when(s % 7 == 0, '"Retraction"').when(s % 5 == 0, '"erratum"').otherwise('"note"')
    work = F.concat(F.lit('{"type":"'), F.when(s % 4 == 0, "journal-article").otherwise("book"), F.lit('","update-to":[{"type":'), update, F.lit("}]}"))
    other = F.concat(F.lit('{"cited_by_count":'), s % 9, F.lit("}"))
    q = M.quality(F.lit("10.1/x"), work, other)
    rows = parts(spark, sf_dir).select("p_partkey", q.alias("q"))
    return rows.select("p_partkey", "q.reviewed", F.col("q.citations").cast("long").alias("citations"), "q.retracted", F.array_join("q.flags", ",").alias("flags"))


@query("x16_metadata_cascade", """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'embedded' WHEN 1 THEN 'doi' WHEN 2 THEN 'file name' END AS step, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN 'Work of ' || p_partkey WHEN 2 THEN 'From name' END AS title FROM part""")
def metadata_cascade(spark, sf_dir):
    """Embedded metadata, a DOI in the text, then the file name: the first that finds a work."""
    k = F.col("p_size") % 4
    work = lambda title, when: F.when(when, F.struct(title.alias("title"))).alias("work")
    text = F.when(k <= 1, F.concat(F.lit("see doi:10.1000/x"), "p_partkey")).otherwise("no id")
    file = F.when(k <= 2, "Lee - 2001 - From name.pdf").otherwise("scan.pdf")
    rows = parts(spark, sf_dir).select("p_partkey", "p_name", "p_size", text.alias("text"), file.alias("file"))
    steps = [
        ("embedded", lambda df: df.select("p_partkey", work(F.col("p_name"), F.col("p_size") % 4 == 0))),
        ("doi", lambda df: df.select("p_partkey", work(F.concat(F.lit("Work of "), F.regexp_extract(T.doi(F.col("text")), r"x(\d+)$", 1)), T.doi(F.col("text")).isNotNull()))),
        ("file name", lambda df: df.select("p_partkey", work(N.dynamic_name(F.col("file"))["title"], N.dynamic_name(F.col("file")).isNotNull()))),
    ]
    return M.cascade(rows, steps, "p_partkey").select("p_partkey", "step", "work.title")
