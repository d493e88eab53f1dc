"""Plans over joins of drafts with each other, with the vault and with sources.

Parts stand for drafts: their names are titles, their brands runs, and bodies name others."""

from __future__ import annotations

from pyspark.sql import functions as F

from folium.functions import drafts as R
from folium.functions import text as T
from folium.operators import links as L
from folium.plans.raters import _coefficients_sql, coefficients, rated
from folium.plans.registry import Registry
from folium.sources.tables import table

QUERIES = Registry()
query = QUERIES.query


def drafts(spark, sf_dir):
    """(id, run, title, aliases, target, score, body): every third part extends its predecessor's title."""
    title = F.concat(F.lit("Part "), F.col("p_partkey"))
    target = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("part "), F.col("p_partkey") - 1))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("run"), title.alias("title"), F.array("p_name").alias("aliases"), target.alias("target"),
        (F.col("p_size") % 6).alias("score"), F.concat_ws(" ", "p_name", "p_type").alias("body"),
    )


@query("j36_subconcept_index", "SELECT k AS key, max(p_partkey) AS id FROM (SELECT lower('Part ' || p_partkey) AS k, p_partkey FROM part UNION SELECT lower(p_name), p_partkey FROM part) GROUP BY k")
def subconcept_index(spark, sf_dir):
    return L.title_index(drafts(spark, sf_dir))


@query("j35_pending_index", """WITH d AS (SELECT p_partkey, p_brand AS run, 'Part ' || p_partkey AS title, p_name FROM part), s AS (SELECT run, count(*) >= 3 AS many FROM d GROUP BY run),
k AS (SELECT run, p_partkey, title, lower(title) AS key, 0 AS r FROM d UNION ALL SELECT run, p_partkey, title, lower(p_name), 1 FROM d UNION ALL SELECT run, p_partkey, title, CAST(p_partkey AS VARCHAR), 2 FROM d JOIN s USING (run) WHERE many AND length(CAST(p_partkey AS VARCHAR)) >= 4)
SELECT run, key, arg_min(title, r * 1000000000000 + p_partkey) AS title FROM k GROUP BY run, key""")
def pending_index(spark, sf_dir):
    return L.pending_index(drafts(spark, sf_dir))


def linked(spark, sf_dir):
    """Bodies that name the next three parts of the key, within one run of all."""
    p = F.col("p_partkey")
    body = F.concat(*[x for k in (2, 1, 3) for x in (F.lit(" see PART "), (p + k).cast("string"), F.lit("x part "), (p + k).cast("string"), F.lit(","))])
    title = F.concat(F.lit("Part "), p, F.when(p % 5 == 0, ": ein Modell").otherwise(""))
    rows = table(spark, sf_dir, "part").select(p.alias("id"), F.floor(p / 50).alias("run"), title.alias("title"), F.array(F.concat(F.lit("part "), p)).alias("aliases"), body.alias("body"))
    return rows


_LINKED = """n AS (SELECT p_partkey AS id, p_partkey // 50 AS run, 'Part ' || p_partkey || CASE WHEN p_partkey % 5 = 0 THEN ': ein Modell' ELSE '' END AS title FROM part),
m AS (SELECT a.id, b.title, k FROM n a, (VALUES (1, 1), (2, 0), (3, 2)) v(s, k) JOIN n b ON TRUE WHERE b.id = a.id + s AND b.run = a.run)"""


@query("j25_cross_mentions", f"WITH {_LINKED} SELECT id, title, row_number() OVER (PARTITION BY id ORDER BY k) AS place FROM m")
def cross_mentions(spark, sf_dir):
    """Titles that a body names as words, in the order of the body."""
    from pyspark.sql import Window

    rows = linked(spark, sf_dir)
    found = L.mentions(rows, L.pending_index(rows))
    return found.select("id", "title", F.row_number().over(Window.partitionBy("id").orderBy("at")).cast("long").alias("place"))


@query("j24_hub_mentions", f"WITH {_LINKED} SELECT id, count(*) AS n FROM m GROUP BY id")
def hub_mentions(spark, sf_dir):
    """Mentions of two words or more, counted per note."""
    rows = linked(spark, sf_dir)
    return L.mentions(rows, L.pending_index(rows), least_words=2).groupBy("id").agg(F.count("*").alias("n"))


@query("j26_hub_resolve", f"WITH {_LINKED} SELECT id, list(title ORDER BY k) AS subconcepts FROM m WHERE id % 5 = 0 GROUP BY id HAVING count(*) >= 3")
def hub_resolve(spark, sf_dir):
    rows = linked(spark, sf_dir)
    return L.hubs(rows, L.mentions(rows, L.pending_index(rows)), R.is_overview(F.col("title")))


@query("j27_sibling_candidates", """WITH t AS (SELECT p_partkey AS id, p_brand AS run, unnest(string_split(p_name, ' ')) AS t FROM part), l AS (SELECT a.id AS q, b.id AS c, 1.0 + count(DISTINCT a.t) AS score FROM t a JOIN t b USING (run, t) WHERE a.id <> b.id AND a.id % 100 = 0 GROUP BY 1, 2),
s AS (SELECT a.p_partkey AS q, b.p_partkey AS c, 0.9 AS score FROM part a JOIN part b USING (p_brand) WHERE a.p_partkey % 100 = 0 AND b.p_partkey % 10 = 1), u AS (SELECT * FROM l UNION ALL SELECT * FROM s ANTI JOIN l USING (q, c))
SELECT q, c, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS k FROM u) WHERE k <= 5""")
def sibling_candidates(spark, sf_dir):
    """Siblings for the stated query set (ids divisible by 100); a cosine of .9 for every tenth part."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("run"), F.col("p_name").alias("title"))
    asked = rows.where("id % 100 = 0")
    pairs = asked.select(F.col("id").alias("q"), "run").join(rows.where("id % 10 = 1").select(F.col("id").alias("c"), "run"), "run")
    return L.sibling_candidates(asked, rows, pairs.select("q", "c", F.lit(0.9).alias("cosine")))


@query("j39_title_token_match", "SELECT p_partkey, p_name || ' of ' || p_brand AS title, len(list_intersect(string_split(p_name, ' '), ['small', 'ring', 'of'])) - CASE WHEN list_contains(string_split(p_name, ' '), 'of') THEN 1 ELSE 0 END > 0 AS ok FROM part")
def title_token_match(spark, sf_dir):
    """One content token in common; stop words do not count."""
    title = F.concat("p_name", F.lit(" of "), "p_brand")
    ok = F.arrays_overlap(T.content_tokens(title), T.content_tokens(F.lit("The Small Ring of it")))
    return table(spark, sf_dir, "part").select("p_partkey", title.alias("title"), ok.alias("ok"))


@query("j8_sibling_duplicates", """WITH d AS (SELECT p_partkey AS id, p_name, (p_size % 6) AS score, length(p_name || ' ' || p_type) AS n, CASE WHEN p_partkey % 3 = 0 AND p_partkey - 1 IN (SELECT p_partkey FROM part) THEN p_partkey - 1 ELSE p_partkey END AS root FROM part),
b AS (SELECT root, arg_max(id, struct_pack(s := score, n := n, k := 'part ' || id, i := id)) AS survivor FROM d GROUP BY root),
a AS (SELECT b.survivor, list_sort(list_distinct(flatten(list(CASE WHEN d.id = survivor THEN [p_name] ELSE ['Part ' || d.id, p_name] END)))) AS aliases FROM d JOIN b USING (root) GROUP BY survivor)
SELECT id, b.survivor, CASE WHEN id = b.survivor THEN aliases END AS aliases FROM d JOIN b USING (root) JOIN a ON a.survivor = b.survivor""")
def sibling_duplicates(spark, sf_dir):
    """Drafts that extend their predecessor: one of each component stays and takes the others' names."""
    return L.resolve_duplicates(drafts(spark, sf_dir))


@query("j29_hub_boilerplate", """SELECT p_type AS hub, lower(p_name || ' is one of six words') AS key, count(*) AS n FROM part GROUP BY ALL HAVING count(*) >= 3""")
def hub_boilerplate(spark, sf_dir):
    """Sentences of six words and more that three subs of a hub share."""
    from folium.functions import markdown as M

    body = F.concat("p_name", F.lit(" is one of six words (S. 3)\n\nAnd short."))
    subs = table(spark, sf_dir, "part").select(F.col("p_type").alias("hub"), F.col("p_partkey").alias("id"), F.explode(M.sentences(body)).alias("s"))
    subs = subs.select("hub", "id", M.sentence_key(F.col("s")).alias("key"), F.size(T.words(F.col("s"))).alias("n_words"))
    return L.shared_sentences(subs)


@query("j31_chapter_doi", "SELECT p_partkey AS id, min('10.1/' || s_suppkey) AS doi FROM part JOIN supplier ON s_suppkey % 60 = p_size AND (p_partkey % 2 = 0 OR s_suppkey % 3 = 0) GROUP BY 1 HAVING count(*) = 1")
def chapter_doi(spark, sf_dir):
    chapters = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("page"), F.when(F.col("p_partkey") % 2 == 1, 0).alias("year"))
    works = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 60).cast("long").alias("page"), (F.col("s_suppkey") % 3).cast("int").alias("year"), F.concat(F.lit("10.1/"), "s_suppkey").alias("doi"))
    return L.chapter_dois(chapters, works)


@query("j32_file_match", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'a/Part ' || p_partkey || '.pdf' WHEN 1 THEN 'a/Part ' || p_partkey || '.pdf' END AS path FROM part")
def file_match(spark, sf_dir):
    p = F.col("p_partkey")
    stem = F.when(p % 3 == 0, F.concat(F.lit("Part "), p)).when(p % 3 == 1, F.concat(F.lit("Pa rt"), p)).otherwise(F.concat(F.lit("none "), p))
    notes = table(spark, sf_dir, "part").select(p.alias("id"), stem.alias("stem"))
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("Part "), p).alias("stem"), F.concat(F.lit("a/Part "), p, F.lit(".pdf")).alias("path"))
    return L.match_files(notes, files)


@query("j4_inbox_match", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'z' || p_partkey END AS path FROM part")
def inbox_match(spark, sf_dir):
    """Two inbox notes of a title: the pristine one, though its path comes later."""
    p = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(p.alias("id"), F.concat(F.lit("Part "), p, F.lit("!")).alias("title"), F.lit("x.pdf").alias("source"))
    held = table(spark, sf_dir, "part").where(p % 2 == 0).select(F.concat(F.lit("part "), p).alias("title"), F.lit("x.pdf").alias("source"), F.explode(F.array(F.struct(F.concat(F.lit("a"), p).alias("path"), F.lit(False).alias("pristine")), F.struct(F.concat(F.lit("z"), p).alias("path"), F.lit(True).alias("pristine")))).alias("x"))
    return L.inbox_match(rows, held.select("title", "source", "x.path", "x.pristine"))


@query("j30_eligible_targets", "SELECT p_partkey AS id, NOT (p_partkey % 3 = 0 AND (p_partkey - 1) % 2 = 0 AND p_partkey - 1 IN (SELECT p_partkey FROM part)) AS ok FROM part")
def eligible_targets(spark, sf_dir):
    p = F.col("p_partkey")
    vault = table(spark, sf_dir, "part").select(F.concat(F.lit("Part "), p).alias("title"), F.when(p % 2 == 0, "MOC").otherwise("concept").alias("type"))
    return L.eligible_targets(drafts(spark, sf_dir), vault, R.EXCLUDED_TYPES)


@query("j23_adversarial_match", "SELECT DISTINCT l_orderkey AS note, l_linenumber * 10000000 + l_partkey AS k, CASE WHEN l_partkey % 2 = 0 THEN 'A' END AS label FROM lineitem")
def adversarial_match(spark, sf_dir):
    """Perturbed claims inside an extracted one of their note, or around it."""
    claim = F.concat(F.lit("claim "), "l_linenumber", F.lit(" of "), "l_partkey", F.lit("."))
    key = (F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("k")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("note"), key, "l_partkey", claim.alias("claim")).distinct()
    held = rows.where("l_partkey % 2 = 0").select("note", F.col("k").alias("pos"), F.concat(F.lit("So "), F.upper("claim"), F.lit(" Yes")).alias("claim"), F.lit("A").alias("label"))
    return L.found_claims(rows.select("note", "k", "claim"), held)


_AC1 = f"({_coefficients_sql('lang')})"


@query("j33_inflation", f"""WITH x AS (SELECT lang, ac1 FROM {_AC1}), y AS (SELECT lang, ac1 FROM ({_coefficients_sql("lang").replace("FROM documents JOIN labels USING (doc_id))", "FROM documents JOIN labels USING (doc_id) WHERE doc_id % 2 = 0)")}))
SELECT lang, x.ac1 - y.ac1 > 0.10 AS inflated FROM x JOIN y USING (lang)""")
def inflation(spark, sf_dir):
    """Agreement of all labels (hybrid) against that of the blind ones (here: even ids)."""
    rows = rated(spark, sf_dir)
    hybrid = coefficients(rows, "lang").select("lang", F.col("ac1").alias("h"))
    blind = coefficients(rows.where("doc_id % 2 = 0"), "lang").select("lang", F.col("ac1").alias("b"))
    return hybrid.join(blind, "lang").select("lang", (F.col("h") - F.col("b") > 0.10).alias("inflated"))


@query("j19_label_map", """WITH c AS (SELECT l_orderkey AS note, l_linenumber AS claim_idx, l_returnflag AS f FROM lineitem) SELECT note, claim_idx, CASE f WHEN 'A' THEN 's' WHEN 'R' THEN 'h' ELSE '?' END AS label FROM c""")
def label_map(spark, sf_dir):
    """Pipeline labels as verdicts: supported, not supported, open."""
    from folium.functions.decision import verdict_of

    primary = F.when(F.col("l_returnflag") == "A", "supported_exact").when(F.col("l_returnflag") == "R", "contradicted").otherwise("parse_error")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("note"), F.col("l_linenumber").alias("claim_idx"), verdict_of(primary).alias("label"))
