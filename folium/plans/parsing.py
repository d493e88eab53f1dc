"""Plans over model output: what was rendered from the tables is parsed back.

The corpus holds no model output, so each query renders the columns of a row in the
format and parses the text; its oracle SQL is the columns themselves (a round trip)."""

from __future__ import annotations

from pyspark.sql import functions as F

from folium.functions import parsing as P
from folium.operators import judge
from folium.plans.registry import Registry
from folium.sources.tables import table

QUERIES = Registry()
query = QUERIES.query


def _lines(*parts) -> F.Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _field(key: str, *values) -> F.Column:
    return F.concat(F.lit(f"{key}: "), *[F.lit(v) if isinstance(v, str) else v for v in values])


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")


def note_text() -> F.Column:
    """A model answer with one note, two anchors (one without a quote) and a nameless note."""
    third = F.col("doc_id") % 3 == 0
    return _lines(
        "Here you are.", "  <!--NOTE-->  ", _field("title", "Note ", F.col("doc_id")), _field("proposed-tags", F.col("lang"), ", ", F.col("source"), " ,"),
        "action: create", "extend_path: none", "some words", "<!--BODY-->", "", F.col("text"), "", "<!--ANCHOR-->", _field("page", "S. ", F.col("n_chars")),
        "<!--QUOTE-->", F.concat(F.lit("“"), "source", F.lit("”")), F.when(third, _lines("<!--ANCHOR-->", "page: S. 1")), "<!--NOTE-->", "tags: x", "<!--END-->", "<!--NOTE-->", "title: after the end",
    )


@query("f72_sentinel_sections", """SELECT doc_id, unnest(CASE WHEN doc_id % 3 = 0 THEN ['', 'NOTE', 'BODY', 'ANCHOR', 'QUOTE', 'ANCHOR', 'NOTE'] ELSE ['', 'NOTE', 'BODY', 'ANCHOR', 'QUOTE', 'NOTE'] END) AS name,
  unnest(range(0, CASE WHEN doc_id % 3 = 0 THEN 7 ELSE 6 END)) AS pos FROM documents""")
def sentinel_sections(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(P.split_sections(note_text())).alias("pos", "s"))
    return rows.select("doc_id", F.coalesce("s.name", F.lit("")).alias("name"), F.col("pos").cast("long").alias("pos"))


@query("f73_headers", """SELECT p_partkey, p_name AS a, nullif(p_brand, 'Brand#11') AS b, 4::BIGINT AS n FROM part""")
def header_map(spark, sf_dir):
    """Hyphens become underscores, null words null, lines that are no header drop out."""
    brand = F.when(F.col("p_brand") == "Brand#11", "None").otherwise(F.col("p_brand"))
    text = _lines("first-name: old", "no header", _field("first-name", "  ", F.col("p_name"), "  "), _field("brand", brand), "x: 1", "empty:", "Upper: no")
    rows = table(spark, sf_dir, "part").select("p_partkey", P.headers(text).alias("h"))
    return rows.select("p_partkey", F.col("h")["first_name"].alias("a"), F.col("h")["brand"].alias("b"), F.size("h").cast("long").alias("n"))


@query("f74_note_parse", r"""SELECT doc_id, 'Note ' || doc_id AS title, lang || ',' || source AS proposed, 'create' AS action, NULL::VARCHAR AS extend_path,
  sha256(regexp_replace(text, '^\n+|\n+$', '', 'g')) AS body, 'S. ' || n_chars AS page, '“' || source || '”' AS quote, 1::BIGINT AS n_notes, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS n_warnings FROM documents""")
def note_parse(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", P.notes(note_text()).alias("p")).withColumn("n", F.col("p.notes")[0])
    anchor = F.col("n.source_anchors")[0]
    return rows.select(
        "doc_id", "n.title", F.array_join("n.proposed_tags", ",").alias("proposed"), "n.action", "n.extend_path", F.sha2("n.body", 256).alias("body"),
        anchor["page"].alias("page"), anchor["quote"].alias("quote"), F.size("p.notes").cast("long").alias("n_notes"), F.size("p.warnings").cast("long").alias("n_warnings"),
    )


@query("f116_one_note", "SELECT doc_id, 'Note ' || doc_id AS title, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS n_warnings FROM documents")
def one_note(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", P.one_note(note_text()).alias("p"))
    return rows.select("doc_id", "p.note.title", F.size("p.warnings").cast("long").alias("n_warnings"))


@query("f75_planner_parse", """SELECT p_partkey, 'Source ' || p_partkey AS source_title, p_name AS title, lower(p_type) AS priority, CASE WHEN p_size % 2 = 0 THEN 'operational' ELSE 'conceptual' END AS category,
  CASE WHEN p_size % 3 = 0 THEN 'extension' ELSE 'primary' END AS origin, [p_brand, 'B. Two'] AS cited, 2::BIGINT AS n, (CASE WHEN p_size % 2 = 0 THEN 1 ELSE 2 END + CASE WHEN p_size % 3 = 2 THEN 1 ELSE 0 END)::BIGINT AS n_warnings FROM part""")
def planner_parse(spark, sf_dir):
    """Concepts with defaults; unknown categories and origins fall back."""
    category = F.when(F.col("p_size") % 2 == 0, "Operational").otherwise("other")
    origin = F.when(F.col("p_size") % 3 == 0, "extension").when(F.col("p_size") % 3 == 1, "null").otherwise("elsewhere")
    text = _lines(
        _field("source_title", "Source ", F.col("p_partkey")), "<!--CONCEPT-->", _field("title", F.col("p_name")), _field("priority", F.col("p_type")), _field("category", category),
        _field("origin", origin), _field("cited_authors", F.col("p_brand"), ", B. Two,"), "<!--CONCEPT-->", "priority: high", "<!--CONCEPT-->", "title: second", "<!--END-->",
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", P.concept_plan(text).alias("p")).withColumn("c", F.col("p.concepts")[0])
    return rows.select(
        "p_partkey", "p.source_title", "c.title", "c.priority", "c.category", "c.origin", F.col("c.cited_authors").alias("cited"),
        F.size("p.concepts").cast("long").alias("n"), F.size("p.warnings").cast("long").alias("n_warnings"),
    )


@query("f76_verifier_parse", """SELECT doc_id, quality = 1 AS all_verified, 'S. ' || doc_id AS page, toxic = 1 AS verified, 2::BIGINT AS n, CASE WHEN toxic = 1 THEN 'a quote' END AS quote FROM labels""")
def verifier_parse(spark, sf_dir):
    bit = lambda c, a, b: F.when(F.col(c) == 1, a).otherwise(b)
    text = _lines(
        _field("all_verified", bit("quality", "Yes", "no")), "<!--ANCHOR-->", _field("page", "S. ", F.col("doc_id")), _field("verified", bit("toxic", "T", "false")),
        F.when(F.col("toxic") == 1, _lines("<!--QUOTE-->", "a quote", "")), "<!--ANCHOR-->", "page: -", "<!--END-->",
    )
    rows = table(spark, sf_dir, "labels").select("doc_id", P.verification(text).alias("p")).withColumn("a", F.col("p.anchors")[0])
    return rows.select("doc_id", "p.all_verified", "a.page", "a.verified", F.size("p.anchors").cast("long").alias("n"), "a.quote")


@query("f77_critic_parse", """SELECT doc_id, quality = 1 AS title_test, false AS glance_test, toxic = 0 AS deletion_test, least(5, doc_id % 9)::INT AS score, CASE WHEN doc_id % 2 = 0 THEN 'say more' || chr(10) || 'and less' END AS revision_hint FROM labels""")
def critic_parse(spark, sf_dir):
    text = _lines(
        _field("title_test", F.when(F.col("quality") == 1, "1").otherwise("0")), _field("deletion-test", F.when(F.col("toxic") == 0, "TRUE").otherwise("x")),
        _field("score", F.col("doc_id") % 9, " (of 5)"), F.when(F.col("doc_id") % 2 == 0, _lines("<!--REVISION_HINT-->", "say more", "and less")), "<!--END-->",
    )
    rows = table(spark, sf_dir, "labels").select("doc_id", P.critique(text).alias("p"))
    return rows.select("doc_id", *[f"p.{k}" for k in ("title_test", "glance_test", "deletion_test", "score", "revision_hint")])


@query("f78_cross_reference_parse", """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'high' ELSE 'none' END AS duplicate_risk, CASE WHEN p_size % 2 = 0 THEN p_name || '.md' END AS duplicate_path, [p_type || chr(10) || 'differs'] AS contradictions, ['[[' || p_name || ']]'] AS related, 1::BIGINT AS n_warnings FROM part""")
def cross_reference_parse(spark, sf_dir):
    even = F.col("p_size") % 2 == 0
    text = _lines(
        F.when(even, _lines("duplicate_risk: high", _field("duplicate_path", F.col("p_name"), ".md"))), "<!--CONTRADICTION-->", F.col("p_type"), "differs", "<!--CONTRADICTION-->", "",
        "<!--RELATED-->", F.concat(F.lit("  [["), "p_name", F.lit("]]")), "[[a]] [[b]]", "<!--END-->",
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", P.cross_reference(text).alias("p"))
    return rows.select("p_partkey", "p.duplicate_risk", "p.duplicate_path", "p.contradictions", "p.related", F.size("p.warnings").cast("long").alias("n_warnings"))


@query("f117_background_parse", "SELECT p_partkey, p_name AS concept, ['is ' || p_type, 'has ' || p_brand] AS claims FROM part")
def background_parse(spark, sf_dir):
    text = _lines(
        "<!--CONCEPT-->", _field("title", F.col("p_name")), "<!--CLAIMS-->", F.concat(F.lit(" - is "), "p_type"), "not a claim", "-", F.concat(F.lit("- has "), "p_brand"), "<!--END-->",
        "<!--CONCEPT-->", "title: empty", "<!--CLAIMS-->", "<!--END-->",
    )
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(P.background(text)).alias("concept", "claims"))


def judge_texts(spark, sf_dir):
    """Answers per order: every fifth index is wrong, some labels and pages are, some claims
    are answered twice or not at all."""
    key, line = F.col("l_partkey"), F.col("l_linenumber")
    index = F.when(key % 11 == 0, "x").when(key % 13 == 0, F.lit("99")).otherwise(line.cast("string"))
    row = F.struct(
        index.alias("claim_idx"), F.when(key % 7 == 0, "maybe").otherwise("contradicted").alias("label"), F.when(key % 3 == 0, "  ").otherwise(F.col("l_returnflag")).alias("evidence"),
        F.when(key % 5 == 0, "p").otherwise((key % 90).cast("string")).alias("best_page"),
    )
    rows = table(spark, sf_dir, "lineitem").where("l_suppkey % 4 > 0").select(F.col("l_orderkey").alias("note"), line.alias("k"), key.alias("p"), row.alias("r"))
    # An order has seven lines at most.
    body = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("k", "p", "r"))), lambda x: x["r"]))
    return rows.groupBy("note").agg(F.concat(F.lit("Sure: "), body, F.lit(" Done.")).alias("text"))


def asked(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("note"), F.col("l_linenumber").cast("int").alias("claim_idx"))
    return rows.agg(F.lit(1).alias("best_page"))


_JUDGE_SQL = """raw AS (SELECT l_orderkey AS note, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS pos,
  CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 13 = 0 THEN 99 ELSE l_linenumber END AS claim_idx, CASE WHEN l_partkey % 7 = 0 THEN 'parse_error' ELSE 'contradicted' END AS label,
  CASE WHEN l_partkey % 3 > 0 THEN l_returnflag END AS evidence, CASE WHEN l_partkey % 5 > 0 THEN l_partkey % 90 END AS page,
  list_filter([CASE WHEN l_partkey % 7 = 0 THEN 'judge_schema_label_invalid' END, CASE WHEN l_partkey % 5 = 0 THEN 'judge_schema_best_page_invalid' END], lambda x: x IS NOT NULL) AS flags
  FROM lineitem WHERE l_suppkey % 4 > 0),
asked AS (SELECT DISTINCT l_orderkey AS note, l_linenumber AS claim_idx FROM lineitem),
one AS (SELECT note, claim_idx, arg_min({'l': label, 'e': evidence, 'p': page, 'f': flags}, pos) AS a, count(*) AS n FROM raw WHERE claim_idx IS NOT NULL GROUP BY ALL),
judged AS (SELECT note, claim_idx, coalesce(a.l, 'parse_error') AS label, a.e AS evidence, CASE WHEN a IS NULL THEN 1 ELSE a.p END AS best_page,
  list_sort(list_concat(coalesce(a.f, []), list_filter([CASE WHEN a IS NULL THEN 'judge_missing_claim' END, CASE WHEN n > 1 THEN 'duplicate_judge_response' END], lambda x: x IS NOT NULL))) AS flags
  FROM asked LEFT JOIN one USING (note, claim_idx))"""


@query("f79_json_salvage", "SELECT l_orderkey AS note, count(*) AS n FROM lineitem WHERE l_suppkey % 4 > 0 GROUP BY 1")
def json_salvage(spark, sf_dir):
    rows = judge_texts(spark, sf_dir).select("note", F.size(P.json_array(F.col("text"), judge.RAW)).cast("long").alias("n"))
    return rows


@query("f80_judge_rows", f"WITH {_JUDGE_SQL} SELECT note, claim_idx::INT AS claim_idx, label, evidence, best_page::INT AS best_page, array_to_string(flags, ',') AS flags FROM judged")
def judge_rows(spark, sf_dir):
    rows = judge.normalise(judge.answers(judge_texts(spark, sf_dir)), asked(spark, sf_dir))
    return rows.withColumn("flags", F.array_join("flags", ","))


@query("f81_claim_scores", f"""WITH {_JUDGE_SQL}, c AS (SELECT l_orderkey AS note, l_linenumber AS claim_idx, max(l_discount) * 10 AS cosine, bool_or(l_tax > 0.03) AS verified FROM lineitem GROUP BY 1, 2),
j AS (SELECT *, label = 'parse_error' AS bad, evidence IS NOT NULL AND NOT verified AS off FROM judged JOIN c USING (note, claim_idx))
SELECT note, claim_idx::INT AS claim_idx, CASE WHEN bad THEN 'parse_error' WHEN cosine < 0.4 THEN 'retrieval_or_parse_uncertain' ELSE label END AS label,
  array_to_string(list_sort(list_distinct(list_concat(flags, CASE WHEN bad THEN ['parse_error'] WHEN cosine < 0.4 THEN ['retrieval_low_cosine'] ELSE [] END))), ',') AS flags FROM j""")
def claim_scores(spark, sf_dir):
    judged = judge.normalise(judge.answers(judge_texts(spark, sf_dir)), asked(spark, sf_dir))
    context = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("note"), F.col("l_linenumber").cast("int").alias("claim_idx"))
    context = context.agg((F.max("l_discount") * 10).alias("cosine"), F.bool_or(F.col("l_tax") > 0.03).alias("verified"))
    return judge.score(judged, context).select("note", "claim_idx", "label", F.array_join("flags", ",").alias("flags"))
