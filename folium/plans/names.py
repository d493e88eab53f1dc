"""Plans over names: authors, titles, file names and labels, from the columns of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folium.functions import names as N
from folium.functions import text as T
from folium.plans.registry import Registry
from folium.sources.tables import table

QUERIES = Registry()
query = QUERIES.query


def customers(spark, sf_dir, *columns):
    return table(spark, sf_dir, "customer").select("c_custkey", *columns)


def lit(*values):
    return F.concat(*[F.lit(v) if isinstance(v, str) and not v.startswith("c_") else F.col(v) if isinstance(v, str) else v for v in values])


def pick(*values):
    """One of several values by the key."""
    return F.element_at(F.array(*values), (F.col("c_custkey") % len(values) + 1).cast("int"))


def pick_sql(*values):
    return "[" + ", ".join(values) + f"][c_custkey % {len(values)} + 1]"


@query("p15_plausible_author", "SELECT c_custkey, " + pick_sql("true", "false", "false", "false", "false") + " AS ok FROM customer")
def plausible_author(spark, sf_dir):
    given = pick(lit(" ", "c_name"), F.lit("Microsoft "), F.lit("E."), F.lit("(Hrsg.)"), F.lit("x"))
    return customers(spark, sf_dir, N.plausible_author(given).alias("ok"))


@query("p16_plausible_title", "SELECT c_custkey, " + pick_sql("true", "false", "false", "false") + " AS ok FROM customer")
def plausible_title(spark, sf_dir):
    given = pick(lit("c_name"), lit("c_name", ".docx"), lit("Untitled ", "c_name"), F.lit("ab"))
    return customers(spark, sf_dir, N.plausible_title(given).alias("ok"))


@query("p42_institution", "SELECT c_custkey, " + pick_sql("true", "false", "false", "true") + " AS ok FROM customer")
def institution(spark, sf_dir):
    """A marker alone may be a surname."""
    given = pick(lit("University of ", "c_name"), F.lit("Hospital"), lit("c_name", " Smith"), lit("Max-Planck-Institut ", "c_name"))
    return customers(spark, sf_dir, N.is_institution(given).alias("ok"))


@query("f49_persons", "SELECT c_custkey, " + pick_sql("c_name", "c_name || ' und Ann Lee'", "'World Health Organization'", "c_name || '; Ann Lee'") + " AS author FROM customer")
def persons(spark, sf_dir):
    given = pick(lit("c_name", " und University of the Punjab"), lit("c_name", " und Ann Lee"), F.lit("World Health Organization"), lit("c_name", "; Ann Lee; Institut für x ", "c_name"))
    return customers(spark, sf_dir, N.persons(given).alias("author"))


def files():
    """Five forms of file names."""
    return pick(
        lit("c_name", " et al. - 2016 - The ", "c_mktsegment", ".pdf"), lit("Smith_2019_the_", "c_mktsegment", ".pdf"), lit("1998-Lee-the ", "c_mktsegment", " - one.pdf"),
        lit("Kuhlthau - INFORMATION SEARCH ", "c_mktsegment", ".pdf"), lit("nothing", ".pdf"),
    )


@query("f45_dynamic_name", f"""SELECT c_custkey, {pick_sql("c_name", "'Smith'", "'Lee'", "'Kuhlthau'", "NULL")} AS author, {pick_sql("2016", "2019", "1998", "NULL", "NULL")} AS year,
  {pick_sql("'The ' || c_mktsegment", "'the ' || c_mktsegment", "'the ' || c_mktsegment || ' - one'", "'INFORMATION SEARCH ' || c_mktsegment", "NULL")} AS title FROM customer""")
def dynamic_name(spark, sf_dir):
    return customers(spark, sf_dir, "c_name", "c_mktsegment").select("c_custkey", N.dynamic_name(files()).alias("n")).select("c_custkey", "n.author", "n.year", "n.title")


@query("f46_strict_name", f"""SELECT c_custkey, {pick_sql("c_name || ' et al.'", "NULL", "'1998-Lee-the ' || c_mktsegment", "'Kuhlthau'", "NULL")} AS author, {pick_sql("'2016'", "NULL", "NULL", "NULL", "NULL")} AS year,
  {pick_sql("'The ' || c_mktsegment", "NULL", "'one'", "'INFORMATION SEARCH ' || c_mktsegment", "NULL")} AS title FROM customer""")
def strict_name(spark, sf_dir):
    return customers(spark, sf_dir, "c_name", "c_mktsegment").select("c_custkey", N.strict_name(files()).alias("n")).select("c_custkey", "n.author", "n.year", "n.title")


@query("p45_author_confirmed", "SELECT c_custkey, " + pick_sql("true", "false", "false", "false", "false") + " AS ok FROM customer")
def author_confirmed(spark, sf_dir):
    embedded = pick(lit("Ann ", "c_name"), F.lit("Smithers"), F.lit("Bo Leeds"), F.lit("Kuhl"), lit("c_name"))
    return customers(spark, sf_dir, N.confirms(files(), embedded).alias("ok"))


@query("p46_complete", "SELECT c_custkey, " + pick_sql("true", "false", "false") + " AS ok FROM customer")
def complete(spark, sf_dir):
    return customers(spark, sf_dir, N.complete(pick(lit("c_name"), F.lit(" "), lit("c_name")), pick(lit("c_name"), lit("c_name"), F.lit(None).cast("string"))).alias("ok"))


@query("f47_significant_tokens", "SELECT c_custkey, list_sort(list_distinct(['metodo', 'uber', 'customer', lower(c_mktsegment)])) AS toks FROM customer")
def significant_tokens(spark, sf_dir):
    title = lit("<b>Método</b> &lt;span&gt;über&lt;/span&gt; de la 2019 ", "c_name", " ", "c_mktsegment")
    return customers(spark, sf_dir, F.array_sort(N.significant_tokens(title)).alias("toks"))


@query("f48_file_name", "SELECT c_custkey, replace(c_name, '#', '#') || ' - ' || " + pick_sql("'2001'", "'n.d.'") + " || ' - ' || c_mktsegment || ' und ' || repeat('lange ', 9) || CASE WHEN length(c_mktsegment) = 10 THEN 'lange.pdf' ELSE 'lange Worte.pdf' END AS f FROM customer")
def built_name(spark, sf_dir):
    title = lit("c_mktsegment", ' und "', F.repeat(F.lit("lange "), F.lit(10)), "Worte Worteundmehrworteundmehrworte")
    return customers(spark, sf_dir, "c_name", "c_mktsegment").select("c_custkey", N.file_name(F.col("c_name"), pick(F.lit(2001), F.lit(None).cast("int")), title).alias("f"))


def author_fields():
    return pick(lit("c_name"), lit("Lee, Ann; ", "c_name", ", B."), lit("Ann Lee und Bo ", "c_name", " and Cy Du"), F.lit(""))


@query("f51_author_label", "SELECT c_custkey, " + pick_sql("c_name", "'Lee & ' || c_name", "'Lee et al.'", "'Autor'") + " AS label FROM customer")
def author_label(spark, sf_dir):
    return customers(spark, sf_dir, N.short_author(author_fields()).alias("label"))


@query("f50_primary_authors", "SELECT c_custkey, " + pick_sql("[c_name]", "['Lee', 'Ann', c_name]", "['Du']", "[]") + " AS names FROM customer")
def primary_authors(spark, sf_dir):
    given = pick(lit("c_name", " et al."), lit("Lee, Ann; ", "c_name", ", B."), F.lit("Cy Du & A."), F.lit("unknown"))
    return customers(spark, sf_dir, N.primary_authors(given).alias("names"))


@query("f52_short_label", "SELECT c_custkey, " + pick_sql("c_name || ' 2011'", "'Lee et al. 1999'", "'Lee et al.'", "'only a name'") + " AS label FROM customer")
def short_label(spark, sf_dir):
    """The year of the file name comes first; a stem stands in for an author."""
    file = pick(F.lit("X - 2011 - T.pdf"), F.lit("x.pdf"), F.lit("x.pdf"), F.lit("only a name.pdf"))
    year = pick(F.lit("1999"), F.lit("1999"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return customers(spark, sf_dir, N.short_label(author_fields(), year, file).alias("label"))


@query("f53_sources_block", """SELECT c_custkey, '## Quellen' || chr(10) || chr(10) || '*Quelle: ' || CASE WHEN c_custkey % 2 = 0 THEN '[[Lee - 2011 - The T.pdf|Lee 2011]]' ELSE 'Lee 2011' END || ': The T, S. 2, 9, 10–12, ' || (100 + c_custkey) || '*' || chr(10) AS block FROM customer""")
def sources_block(spark, sf_dir):
    pages = F.array(F.lit("S. 9"), F.lit("s. 10–12"), F.lit("none"), lit("S. ", (F.col("c_custkey") + 100).cast("string")), F.lit("2"), F.lit("S. "), F.lit("9"))
    none = F.lit(None).cast("string")
    return customers(spark, sf_dir, N.sources_block(none, F.lit("1999"), F.lit("12 - 3"), F.lit("Lee - 2011 - The T.pdf"), pages, F.col("c_custkey") % 2 == 0).alias("block"))


def dashed():
    return pick(lit("c_name", " - 2017 - Information.pdf"), lit("c_name", " - draft.pdf"), lit("12. ", "c_name", ".pdf"))


@query("f54_pdf_short_name", "SELECT c_custkey, " + pick_sql("c_name || ' (2017)'", "c_name", "c_name") + " AS name FROM customer")
def pdf_short_name(spark, sf_dir):
    return customers(spark, sf_dir, N.pdf_short_name(dashed()).alias("name"))


@query("f55_pdf_filter_key", "SELECT c_custkey, " + pick_sql("c_name || ' - 2017'", "c_name || ' - draft'", "'12. ' || c_name") + " AS k FROM customer")
def pdf_filter_key(spark, sf_dir):
    return customers(spark, sf_dir, N.pdf_filter_key(dashed()).alias("k"))


@query("f56_clean_link", "SELECT c_custkey, " + pick_sql("c_name", "c_name", "c_name || '|x'", "'[2024] ' || c_name") + " AS t FROM customer")
def clean_link(spark, sf_dir):
    given = pick(lit("[[", "c_name", "]]"), lit("[[[[ ", "c_name", " ]]]]"), lit("[[", "c_name", "|x]]"), lit("[2024] ", "c_name"))
    return customers(spark, sf_dir, N.clean_link(given).alias("t"))


@query("f57_link_targets", "SELECT c_custkey, [c_name, 'B', 'C'] AS stems FROM customer")
def link_targets(spark, sf_dir):
    return customers(spark, sf_dir, N.link_targets(lit("[[", "c_name", "|alias, folder/B.md, , C]]")).alias("stems"))


@query("f105_citation", "SELECT c_custkey, " + pick_sql("c_name", "'Lee'") + " AS author, " + pick_sql("'2011'", "'2011'", "'1999'") + " AS year FROM customer")
def citation(spark, sf_dir):
    file = F.when(F.col("c_custkey") % 3 < 2, "Lee - 2011 - T.pdf").otherwise("Lee - T.pdf")
    c = N.citation(pick(lit("c_name"), F.lit("")), F.lit("1999"), file)
    return customers(spark, sf_dir, "c_name").select("c_custkey", c.alias("c")).select("c_custkey", "c.author", "c.year")


@query("f106_display_file", "SELECT c_custkey, " + pick_sql("c_name || ' - 2016 - T.pdf'", "'plain.pdf'") + " AS f FROM customer")
def display_file(spark, sf_dir):
    return customers(spark, sf_dir, N.display_file(pick(lit("c_name", " und University of the Punjab - 2016 - T.pdf"), F.lit("plain.pdf"))).alias("f"))


@query("f107_doi_from_name", "SELECT c_custkey, " + pick_sql("'10.1000/ab_' || c_custkey", "NULL", "NULL") + " AS doi FROM customer")
def doi_from_name(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    return customers(spark, sf_dir, N.doi_of_name(pick(lit("10.1000_ab_", key, "."), lit("x10.1000_", key), lit("10.1_", key))).alias("doi"))


@query("f108_arxiv_from_name", "SELECT c_custkey, " + pick_sql("'2101.' || lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0')", "NULL") + " AS id FROM customer")
def arxiv_from_name(spark, sf_dir):
    number = lit("2101.", F.lpad((F.col("c_custkey") % 100000).cast("string"), 5, "0"))
    return customers(spark, sf_dir, N.arxiv_of_name(pick(lit(number, "v2"), lit(number, "x"))).alias("id"))


@query("f112_note_file_name", "SELECT c_custkey, " + pick_sql("replace(c_name, '#', '-') || ' 3-Phasen- Modell.md'") + " AS f FROM customer")
def note_file_name(spark, sf_dir):
    return customers(spark, sf_dir, N.note_file(lit("c_name", "  3-Phasen: Modell.")).alias("f"))


@query("f113_hub_file_name", "SELECT c_custkey, 'MoC-' || replace(c_name, '#', '-') || '- x.md' AS f FROM customer")
def hub_file_name(spark, sf_dir):
    return customers(spark, sf_dir, N.hub_file(lit("c_name", "? x.")).alias("f"))


@query("f69_slug", "SELECT c_custkey, left(replace(c_name, '#', '') || '-' || 'über-' || repeat('w', 60), 60) AS s FROM customer")
def slugs(spark, sf_dir):
    return customers(spark, sf_dir, N.slug(lit("inbox__", "c_name", "  über (", F.repeat(F.lit("w"), F.lit(60)), ").md")).alias("s"))


@query("f100_inside_folder", "SELECT c_custkey, " + pick_sql("true", "false", "false", "false", "true") + " AS ok FROM customer")
def inside_folder(spark, sf_dir):
    return customers(spark, sf_dir, N.inside_folder(pick(lit("c_name", ".md"), lit("../", "c_name"), F.lit(".."), F.lit("con.txt"), lit("..", "c_name"))).alias("ok"))


@query("f121_path_title", "SELECT c_custkey, c_name AS title FROM customer")
def path_title(spark, sf_dir):
    return customers(spark, sf_dir, N.path_title(pick(lit("<sibling:", "c_name", ">"), lit("a/b/", "c_name", ".md"))).alias("title"))


@query("p47_candidate_notes", "SELECT c_custkey, " + pick_sql("'inbox__' || c_name", "'vault__' || c_name") + " AS f FROM customer WHERE c_custkey % 3 < 2 AND c_custkey % 2 = c_custkey % 3")
def candidate_notes(spark, sf_dir):
    """Files whose names say inbox or vault."""
    name = pick(lit("inbox__", "c_name"), lit("vault__", "c_name"), lit("draft__", "c_name"))
    rows = customers(spark, sf_dir, name.alias("f"), (F.col("c_custkey") % 2 == F.col("c_custkey") % 3).alias("x"))
    return rows.where(F.col("f").rlike("^(inbox|vault)__") & F.col("x")).select("c_custkey", "f")


@query("f95_disambiguation", r"SELECT c_custkey, c_name || ' x' AS t FROM customer")
def disambiguation(spark, sf_dir):
    return customers(spark, sf_dir, T.without_parentheses(lit("c_name", " (", "c_mktsegment", ") x")).alias("t"))


@query("f101_note_title", r"SELECT doc_id, coalesce(nullif(regexp_extract(CASE WHEN doc_id % 2 = 0 THEN text || chr(10) || '# ' || source || chr(10) || '# no' ELSE text END, '(?m)^#\s+(.+)$', 1), ''), 'note-' || doc_id) AS title FROM documents")
def note_title(spark, sf_dir):
    body = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("\n# "), "source", F.lit("\n# no"))).otherwise(F.col("text"))
    path = F.concat(F.lit("a/note-"), "doc_id", F.lit(".md"))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(T.first_group(body, r"(?m)^#\s+(.+)$"), N.stem(path)).alias("title"))
