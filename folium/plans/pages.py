"""Plans over page text: scans, labels, front matter, chapters, overviews and figures.

The corpus has no scans, so a document's paragraphs stand for pages, apart by form feeds;
every third one opens a chapter, and the first carries a phrase of front matter."""

from __future__ import annotations

from pyspark.sql import functions as F

from folium.functions import pages as P
from folium.functions import text as T
from folium.plans.registry import Registry
from folium.sources.tables import table

QUERIES = Registry()
query = QUERIES.query


def scans(spark, sf_dir):
    """(doc_id, text): pages apart by form feeds, with chapter headings and a copyright page."""
    head = lambda i: F.when(i == 0, "Copyright, all rights reserved\n").when(i % 3 == 1, F.concat(F.lit("Kapitel "), (i % 90 + 1).cast("string"), F.lit(". Vom Anfang\n"))).otherwise("")
    page = F.transform(F.split("text", "\n"), lambda p, i: F.concat(head(i), p))
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.array_join(page, "\f").alias("text"))


_PARTS = "SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents"


@query("s1_page_scan", f"""WITH p AS ({_PARTS}), q AS (SELECT doc_id, i, CASE WHEN i = 1 THEN 'Copyright, all rights reserved' || chr(10) WHEN (i - 1) % 3 = 1 THEN 'Kapitel ' || ((i - 1) % 90 + 1) || '. Vom Anfang' || chr(10) ELSE '' END || p AS t FROM p)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i)::INT AS page, t AS text FROM q WHERE trim(regexp_replace(t, '\\s+', ' ', 'g'), ' ') <> ''""")
def page_scan(spark, sf_dir):
    return scans(spark, sf_dir).select("doc_id", F.explode(P.scan_pages(F.col("text"))).alias("p")).select("doc_id", "p.*")


def labels_of(doc_id):
    """Labels of three kinds: usable, not numeric, not increasing."""
    ten = F.sequence(F.lit(11), F.lit(20))
    number = F.transform(ten, lambda i: i.cast("string"))
    return F.when(doc_id % 3 == 0, number).when(doc_id % 3 == 1, F.concat(F.array(F.lit("iv")), number)).otherwise(F.concat(number, F.array(F.lit("3"))))


@query("s2_label_validation", "SELECT doc_id, doc_id % 3 = 0 AS usable FROM documents")
def label_validation(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", P.usable_labels(labels_of(F.col("doc_id"))).isNotNull().alias("usable"))


@query("s3_page_numbers", f"""WITH p AS ({_PARTS}), q AS (SELECT doc_id, i, i = 1 OR (i - 1) % 3 = 1 OR trim(regexp_replace(p, '\\s+', ' ', 'g'), ' ') <> '' AS filled FROM p)
SELECT doc_id, (CASE WHEN doc_id % 3 = 0 THEN CASE WHEN i <= 10 THEN i + 10 ELSE i END ELSE row_number() OVER (PARTITION BY doc_id ORDER BY i) END)::INT AS page FROM q WHERE filled""")
def page_numbers(spark, sf_dir):
    """Labels count before blank pages drop; short lists go on by place, unusable ones not at all."""
    rows = scans(spark, sf_dir).select("doc_id", F.explode(P.scan_pages(F.col("text"), labels_of(F.col("doc_id")))).alias("p"))
    return rows.select("doc_id", "p.page")


@query("s8_whole_text", r"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
q AS (SELECT doc_id, i, CASE WHEN i = 1 THEN 'Copyright, all rights reserved' || chr(10) WHEN (i - 1) % 3 = 1 THEN 'Kapitel ' || ((i - 1) % 90 + 1) || '. Vom Anfang' || chr(10) ELSE '' END || p AS t FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS page, count(*) OVER (PARTITION BY doc_id) AS n FROM q WHERE trim(regexp_replace(t, '\s+', ' ', 'g'), ' ') <> '')
SELECT doc_id, sha256(string_agg(chr(10) || chr(10) || '[S. ' || page || ']' || chr(10) || chr(10) || t, '' ORDER BY page)) AS h, count(*) AS pages FROM n WHERE page > 1 OR n = 1 GROUP BY doc_id""")
def whole_text(spark, sf_dir):
    """Pages without front matter, each after its marker."""
    rows = scans(spark, sf_dir).select("doc_id", P.body_pages(P.scan_pages(F.col("text"))).alias("p"))
    return rows.select("doc_id", F.sha2(P.marked_text(F.col("p")), 256).alias("h"), F.size("p").cast("long").alias("pages"))


@query("s10_full_text", "SELECT doc_id, sha256(text) AS h FROM documents")
def full_text(spark, sf_dir):
    """Pages of a table joined by line feeds; here a document's paragraphs are its pages."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", "\n"), lambda t, i: F.struct(i.alias("page"), t.alias("text"))).alias("p"))
    return rows.select("doc_id", F.sha2(F.array_join(F.transform(F.array_sort("p"), lambda x: x["text"]), "\n"), 256).alias("h"))


@query("s13_front_pages", r"SELECT doc_id, array_to_string(string_split(text, chr(10))[1:2], chr(10)) AS front FROM documents")
def front_pages(spark, sf_dir):
    """The first two pages."""
    pages = F.split(F.replace("text", F.lit("\n"), F.lit("\f")), "\f")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(pages, 1, 2), "\n").alias("front"))


@query("s5_info_fields", """SELECT doc_id, source AS title, NULL::VARCHAR AS subject, CAST(n_chars AS VARCHAR) AS pages, lang AS info_author, CASE WHEN doc_id % 2 = 0 THEN '2019' END AS info_year FROM documents""")
def info_listing(spark, sf_dir):
    """What a file listing says; its author and year are told apart from citable fields."""
    made = F.when(F.col("doc_id") % 2 == 0, "Mon Mar 15 14:23:01 2019 CET").otherwise("unknown")
    lines = F.concat_ws("\n", F.concat(F.lit("Title:          "), "source"), F.lit("Subject:"), F.lit("no field"), F.concat(F.lit("Author: "), "lang"), F.concat(F.lit("CreationDate: "), made), F.concat(F.lit("Pages: "), "n_chars"))
    return table(spark, sf_dir, "documents").select("doc_id", P.info_fields(lines).alias("f")).select("doc_id", "f.*")


@query("p1_front_matter", "SELECT doc_id, CASE WHEN len(string_split(text, chr(10))) > 1 THEN 1 ELSE 0 END AS dropped FROM documents")
def front_matter(spark, sf_dir):
    pages = F.transform(F.split("text", "\f"), lambda t, i: F.struct((i + 1).alias("page"), t.alias("text")))
    rows = scans(spark, sf_dir).select("doc_id", pages.alias("p"))
    return rows.select("doc_id", (F.size("p") - F.size(P.body_pages(F.col("p")))).alias("dropped"))


@query("p2_real_chapter", "SELECT doc_id, doc_id % 4 IN (0, 3) AS real FROM documents")
def real_chapter(spark, sf_dir):
    """Headings, and lines of a table of contents that look like them."""
    n = F.col("doc_id") % 4
    tail = F.when(n == 0, "").when(n == 1, " .......... 12").when(n == 2, "    7").otherwise(" in 3 Teilen")
    line = F.concat(F.lit("2.1 Die Geschichte"), tail)
    return table(spark, sf_dir, "documents").select("doc_id", P.is_chapter(line).alias("real"))


@query("p4_scanned", r"SELECT doc_id, i, trim(regexp_replace(p, '\s+', ' ', 'g'), ' ') = '' AS scanned FROM (" + _PARTS + ")")
def scanned(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "p"))
    return rows.select("doc_id", (F.col("i") + 1).cast("long").alias("i"), P.is_scanned(F.col("p")).alias("scanned"))


def marked(spark, sf_dir):
    return scans(spark, sf_dir).select("doc_id", P.marked_text(P.scan_pages(F.col("text"))).alias("text"))


@query("w4_chapter_split", f"""WITH p AS ({_PARTS}), q AS (SELECT doc_id, i, i = 1 OR (i - 1) % 3 = 1 OR trim(regexp_replace(p, '\\s+', ' ', 'g'), ' ') <> '' AS filled FROM p),
n AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS page, count(*) FILTER (WHERE (i - 1) % 3 = 1) OVER (PARTITION BY doc_id) AS k FROM q WHERE filled),
c AS (SELECT doc_id, (i - 2) // 3 AS chapter, min(page) AS own, max(page) AS last FROM n WHERE k >= 2 AND i > 1 GROUP BY ALL)
SELECT doc_id, chapter::INT AS chapter, ((3 * chapter + 1) % 90 + 1) || ' Vom Anfang' AS title, own::INT AS first, coalesce(lead(own) OVER (PARTITION BY doc_id ORDER BY chapter), last)::INT AS last FROM c""")
def chapter_split(spark, sf_dir):
    """Chapters of texts with two headings or more; their pages are those of their markers (the
    marker of the next chapter's page stands before its heading)."""
    rows = marked(spark, sf_dir).where(F.size(P.headings(F.col("text"))) >= 2)
    rows = rows.select("doc_id", F.posexplode(P.chapters(F.col("text"))).alias("chapter", "c"))
    return rows.select("doc_id", "chapter", "c.title", "c.first", "c.last")


@query("w6_page_range", f"""WITH p AS ({_PARTS}), q AS (SELECT doc_id FROM p WHERE i = 1 OR (i - 1) % 3 = 1 OR trim(regexp_replace(p, '\\s+', ' ', 'g'), ' ') <> '') SELECT doc_id, 1 AS first, count(*)::INT AS last FROM q GROUP BY doc_id""")
def range_of_pages(spark, sf_dir):
    return marked(spark, sf_dir).select("doc_id", P.page_range(F.col("text")).alias("r")).select("doc_id", "r.*")


@query("w7_overview")
def overviews(spark, sf_dir):
    """Tests hold overviews against plain loops."""
    return marked(spark, sf_dir).select("doc_id", P.overview(F.col("text")).alias("overview"))


@query("f93_anchor_page", "SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN CASE WHEN p_size % 2 = 0 THEN 40 + p_size % 3 ELSE (p_size % 3) END END::INT AS page FROM part")
def anchor_pages(spark, sf_dir):
    """Sheet 0 has no text; every second file has labels."""
    has_text = F.array(F.lit(False), F.lit(True), F.lit(True))
    labels = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("40"), F.lit("41"), F.lit("42")))
    return table(spark, sf_dir, "part").select("p_partkey", P.anchor_page(has_text, (F.col("p_size") % 3).cast("int"), labels).alias("page"))


def figure_pages(spark, sf_dir):
    """Pages with a figure caption, a table caption that names a figure, or neither."""
    kind = F.col("doc_id") % 3
    line = F.when(kind == 0, F.concat(F.lit("Abb.  3a: from "), "source")).when(kind == 1, "Tabelle 2: siehe Abb. 3: x").otherwise("see Fig. 3: no caption")
    text = F.concat(F.lit("first line\n  "), line, F.lit("\n"), F.substring_index("text", "\n", 1))
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 5 < 2).alias("raster"), text.alias("text"))


@query("f90_captions", "SELECT doc_id, 2 AS line, 'Abb. 3a' AS label, 'Abb. 3a: from ' || source AS text FROM documents WHERE doc_id % 3 = 0")
def figure_captions(spark, sf_dir):
    return figure_pages(spark, sf_dir).select("doc_id", F.explode(P.captions(F.col("text"))).alias("c")).select("doc_id", "c.*")


_SIGNAL = "CASE WHEN doc_id % 3 = 0 AND doc_id % 5 < 2 THEN 'captioned_raster' WHEN doc_id % 3 = 0 THEN 'captioned_no_raster' WHEN doc_id % 5 < 2 THEN 'raster_uncaptioned' ELSE 'no_signal' END"


@query("f91_page_signal", f"SELECT doc_id, {_SIGNAL} AS signal FROM documents")
def page_signals(spark, sf_dir):
    return figure_pages(spark, sf_dir).select("doc_id", P.page_signal(F.size(P.captions(F.col("text"))) > 0, F.col("raster")).alias("signal"))


@query("a59_figure_report", f"SELECT {_SIGNAL} AS signal, count(*) AS pages, count(*) FILTER (WHERE doc_id % 3 = 0) AS captions FROM documents GROUP BY 1")
def figure_report(spark, sf_dir):
    rows = figure_pages(spark, sf_dir).select(F.size(P.captions(F.col("text"))).alias("n"), "raster")
    return rows.groupBy(P.page_signal(F.col("n") > 0, F.col("raster")).alias("signal")).agg(F.count("*").alias("pages"), F.sum("n").alias("captions"))


@query("f88_page_number", "SELECT doc_id, n_chars::INT AS page FROM documents")
def page_number(spark, sf_dir):
    """The first number of a page reference."""
    given = F.concat(F.lit("S. "), "n_chars", F.lit("–"), F.col("n_chars") + 1)
    return table(spark, sf_dir, "documents").select("doc_id", T.first_group(given, r"(\d+)").cast("int").alias("page"))
