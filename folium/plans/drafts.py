"""Plans over drafts: scores, gates, routing and filters.

Documents stand for drafts.  ``drafts`` gives each the columns that an agent would have
written (a draft's score, gates, action and so on), made from the row's own numbers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folium.functions import drafts as R
from folium.functions import parsing as P
from folium.functions import text as T
from folium.plans.registry import Registry
from folium.sources.claims import RUNS_SQL, runs
from folium.sources.tables import table

QUERIES = Registry()
query = QUERIES.query


def drafts(spark, sf_dir):
    d, n = F.col("doc_id"), F.col("n_chars")
    return table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", "source", "n_chars",
        (n % 6).cast("int").alias("score"), (d % 3 > 0).alias("gates"), F.when(d % 4 > 0, "more").alias("hint"), (d % 9 > 0).alias("context"),
        F.when(d % 5 == 0, "hub").when(d % 5 == 1, "extend").when(d % 5 == 2, "skip").otherwise("create").alias("action"),
        (n % 4).cast("int").alias("subs"), F.when(d % 11 == 0, "edition-unverified").alias("status"),
        F.when(d % 7 == 0, "secondary_mention").otherwise("primary").alias("origin"), (n % 10).cast("int").alias("citations"),
    )


_DRAFTS = """drafts AS (SELECT doc_id, text, lang, source, n_chars, (n_chars % 6)::INT AS score, doc_id % 3 > 0 AS gates, CASE WHEN doc_id % 4 > 0 THEN 'more' END AS hint, doc_id % 9 > 0 AS context,
  CASE doc_id % 5 WHEN 0 THEN 'hub' WHEN 1 THEN 'extend' WHEN 2 THEN 'skip' ELSE 'create' END AS action, (n_chars % 4)::INT AS subs, CASE WHEN doc_id % 11 = 0 THEN 'edition-unverified' END AS status,
  CASE WHEN doc_id % 7 = 0 THEN 'secondary_mention' ELSE 'primary' END AS origin, (n_chars % 10)::INT AS citations FROM documents)"""


def scores(spark, sf_dir):
    """Inference and similarity scores of claims (line items)."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("note"), F.col("l_linenumber").alias("claim_idx"), (F.col("l_discount") * 10).alias("e"), (F.col("l_tax") * 10).alias("c"), "l_returnflag", "l_linestatus"
    )


@query("f23_nli_label", """SELECT l_orderkey AS note, l_linenumber AS claim_idx, CASE WHEN l_tax * 10 >= 0.5 AND l_discount * 10 < 0.4 THEN 'contradiction' WHEN l_discount * 10 >= 0.7 THEN 'confirmed' WHEN l_discount * 10 >= 0.4 THEN 'uncertain' ELSE 'hallucinated' END AS label FROM lineitem""")
def nli_label(spark, sf_dir):
    return scores(spark, sf_dir).select("note", "claim_idx", R.label_of_scores(F.col("e"), F.col("c")).alias("label"))


@query("f24_nli_override", """SELECT l_orderkey AS note, l_linenumber AS claim_idx, CASE WHEN l_tax * 10 >= 0.3 THEN 'hallucinated' WHEN l_discount * 10 >= 0.7 THEN 'confirmed' ELSE l_returnflag END AS label FROM lineitem""")
def nli_override(spark, sf_dir):
    return scores(spark, sf_dir).select("note", "claim_idx", R.overridden(F.col("e"), F.col("c"), F.col("l_returnflag")).alias("label"))


@query("f21_anchor_score", """WITH x AS (SELECT l_orderkey AS note, l_linenumber AS claim_idx, l_returnflag = 'N' AND l_linestatus = 'F' AS alone, l_discount * 10 AS f, l_tax * 10 AS s FROM lineitem), y AS (SELECT *, CASE WHEN alone THEN s ELSE 0.8 * f + 0.2 * s END AS v FROM x)
SELECT note, claim_idx, round(v, 3) AS score, CASE WHEN v >= CASE WHEN alone THEN 0.7 ELSE 0.85 END THEN 'confirmed' WHEN v >= CASE WHEN alone THEN 0.5 ELSE 0.7 END THEN 'uncertain' ELSE 'hallucinated' END AS label FROM y""")
def anchor_score(spark, sf_dir):
    a = R.anchor_score(F.col("e"), F.col("c"), F.col("l_returnflag") == "N", F.col("l_linestatus") != "F")
    return scores(spark, sf_dir).select("note", "claim_idx", a.alias("a")).select("note", "claim_idx", "a.score", "a.label")


@query("f32_confidence", f"""WITH {_DRAFTS}, r AS (SELECT doc_id, list_filter([CASE WHEN NOT gates THEN 'not peer-reviewed' WHEN citations < 5 THEN 'few citations n=' || citations END, CASE WHEN action = 'extend' THEN 'contradicts a note' END,
  CASE WHEN NOT context THEN 'no second source' END, CASE WHEN subs < 2 THEN 'anchors: ' || subs END], lambda x: x IS NOT NULL) AS r FROM drafts)
SELECT doc_id, CASE len(r) WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS level, array_to_string(r, '; ') AS reasons FROM r""")
def confidence(spark, sf_dir):
    c = R.confidence(F.col("gates"), F.col("citations"), F.col("action") == "extend", F.col("context"), F.col("subs"))
    return drafts(spark, sf_dir).select("doc_id", c.alias("c")).select("doc_id", "c.level", "c.reasons")


@query("p24_refine_decision", f"""WITH {_DRAFTS} SELECT doc_id, CASE WHEN NOT context THEN 'missing_concept_context' WHEN score = 3 AND hint IS NULL THEN 'score3_without_hint' WHEN score IN (2, 3) AND hint IS NULL THEN 'missing_revision_hint'
  WHEN score IN (2, 3) THEN 'score_band' WHEN score >= 4 AND NOT gates AND hint IS NOT NULL THEN 'hard_gate_failure' ELSE 'no_trigger' END AS reason, reason IN ('score_band', 'hard_gate_failure') AS attempt FROM drafts""")
def refine_decision(spark, sf_dir):
    r = R.refine(F.col("score"), F.col("gates"), F.col("hint"), F.col("context"))
    return drafts(spark, sf_dir).select("doc_id", r.alias("r")).select("doc_id", "r.reason", "r.attempt")


@query("p25_refine_accepted", f"WITH {_DRAFTS} SELECT doc_id FROM drafts WHERE gates AND score >= 4")
def refine_accepted(spark, sf_dir):
    return drafts(spark, sf_dir).where(R.refine_accepted(F.col("score"), F.col("gates"))).select("doc_id")


_ROUTE = """CASE WHEN status = 'edition-unverified' THEN 'edition unverified' WHEN NOT gates AND NOT (action = 'hub' AND score >= 4 AND subs >= 2) THEN 'hard gate' WHEN score >= 4 THEN 'ok' ELSE 'score ' || score || '<4' END"""


def routed(spark, sf_dir):
    return drafts(spark, sf_dir).withColumn("d", R.routing(F.col("action"), F.col("score"), F.col("gates"), F.col("subs"), F.coalesce("status", F.lit(""))))


@query("p21_vault_routing", f"WITH {_DRAFTS} SELECT doc_id, {_ROUTE} AS reason, {_ROUTE} = 'ok' AS auto FROM drafts")
def vault_routing(spark, sf_dir):
    return routed(spark, sf_dir).select("doc_id", "d.reason", "d.auto")


@query("f120_status_line", f"""WITH {_DRAFTS} SELECT doc_id, 'Score: ' || score || '/5 | Hard-Gates: ' || CASE WHEN gates THEN 'OK' ELSE 'fail' END || ' | Confidence: low ' || CASE WHEN action = 'hub' THEN '[MoC] ' ELSE '' END
  || CASE WHEN {_ROUTE} = 'ok' THEN '[Vault]' ELSE '[Inbox: ' || {_ROUTE} || ']' END || CASE WHEN hint IS NULL THEN chr(10) || '        Gründe: a, b' ELSE '' END AS line FROM drafts""")
def status_line(spark, sf_dir):
    flags = F.when(F.col("hint").isNull(), F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    line = R.status_line(F.col("action"), F.col("score"), F.col("gates"), F.lit("low"), F.col("d"), flags)
    return routed(spark, sf_dir).select("doc_id", line.alias("line"))


@query("p5_absence_filter", f"WITH {_DRAFTS} SELECT doc_id FROM drafts WHERE NOT (action <> 'extend' AND doc_id % 6 = 0)")
def absence_filter(spark, sf_dir):
    """Every sixth body says, in one of two phrases, that its source does not treat it."""
    phrase = F.when(F.col("doc_id") % 12 == 0, " Dies wird Nicht Behandelt.").when(F.col("doc_id") % 6 == 0, " It is not mentioned here.").otherwise("")
    return drafts(spark, sf_dir).where(~R.is_absence(F.col("action"), F.concat("text", phrase))).select("doc_id")


@query("p14_overview_marker", "SELECT doc_id, doc_id % 4 IN (0, 3) AS overview FROM documents")
def overview_marker(spark, sf_dir):
    t = F.element_at(F.array(F.lit("ADKAR-Modell"), F.lit("Modellierung"), F.lit("Atlanten"), F.lit("Die ÜBERSICHT")), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", R.is_overview(F.concat("source", F.lit(" "), t)).alias("overview"))


_WORDS = r"SELECT DISTINCT unnest(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS w FROM documents"
_GENERIC = ", ".join(f"'{g}'" for g in R.GENERIC)


@query("p9_specific_concept", f"""SELECT w, lower(w) NOT IN ({_GENERIC}) AND (regexp_matches(w, '\\p{{Lu}}') OR length(w) >= 8) AS ok FROM ({_WORDS} UNION SELECT 'Theory' UNION SELECT 'tinnitus' UNION SELECT 'short' UNION SELECT 'Ability')""")
def specific_concept(spark, sf_dir):
    names = table(spark, sf_dir, "documents").select(F.explode(T.words(F.col("text"))).alias("w"))
    more = spark.createDataFrame([("Theory",), ("tinnitus",), ("short",), ("Ability",)], "w string")
    return names.unionByName(more).distinct().select("w", R.is_specific(F.col("w")).alias("ok"))


@query("p10_language", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN true WHEN lang = 'en' THEN true WHEN lang = 'de' THEN false ELSE true END AS ok FROM documents")
def language_fits(spark, sf_dir):
    """English is the main language: German and its kin go, other guesses stay."""
    given = F.when(F.col("doc_id") % 5 == 0, "short").otherwise("two words and more")
    return table(spark, sf_dir, "documents").select("doc_id", R.fits_language(given, F.col("lang"), F.lit("en")).alias("ok"))


@query("p8_present_concepts", r"""WITH s AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM documents), t AS (SELECT p_partkey, p_size, list_distinct(list_filter(regexp_extract_all(lower(p_name || ' ' || p_type || ' the of'), '[\p{L}\p{N}_]+'), lambda w: length(w) >= 3 AND w <> 'the')) AS toks FROM part),
x AS (SELECT p_partkey, p_size, toks, unnest(toks) AS w FROM t), c AS (SELECT p_partkey, p_size, count(s.w) / CAST(count(*) AS DOUBLE) AS cov FROM x LEFT JOIN s USING (w) GROUP BY ALL)
SELECT p_partkey FROM c WHERE cov >= 0.5 OR p_size / 50.0 >= 0.5""")
def present_concepts(spark, sf_dir):
    """Titles half of whose tokens the texts hold, or that are near them in meaning (here: size)."""
    held = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("w")).distinct()
    toks = T.content_tokens(F.concat_ws(" ", "p_name", "p_type", F.lit("the of")))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.explode(toks).alias("w")).join(held.withColumn("hit", F.lit(1)), "w", "left")
    found = rows.groupBy("p_partkey", "p_size").agg((F.count("hit") / F.count("*")).alias("coverage"), F.count("*").alias("n"))
    return found.where(R.present(F.col("coverage"), F.col("p_size") / 50.0, F.col("n"))).select("p_partkey")


@query("p11_prominence", """WITH c AS (SELECT lower(p_name) AS name, p_brand AS chunk, max(p_retailprice) AS score FROM part GROUP BY ALL), n AS (SELECT name, count(*) AS k, max(score) AS score FROM c GROUP BY name)
SELECT name FROM (SELECT name, row_number() OVER (ORDER BY score DESC, name) AS r FROM n WHERE k >= 2 OR (SELECT count(*) FROM n WHERE k >= 2) < 3) WHERE r <= 20""")
def prominence(spark, sf_dir):
    """Concepts of two chunks or more, unless fewer than three are; the best twenty."""
    per = table(spark, sf_dir, "part").groupBy(F.lower("p_name").alias("name"), "p_brand").agg(F.max("p_retailprice").alias("score"))
    names = per.groupBy("name").agg(F.count("*").alias("k"), F.max("score").alias("score"))
    enough = F.broadcast(names.agg((F.count_if(F.col("k") >= 2) < 3).alias("few")))  # one row
    return names.crossJoin(enough).where("few or k >= 2").orderBy(F.col("score").desc(), "name").limit(20).select("name")


@query("p18_proposed_tags", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN [replace(p_name, ' ', '-'), 'new-tag'] ELSE ['new-tag', 'third'] END AS tags FROM part")
def proposed_tags(spark, sf_dir):
    """Two of the proposed tags that fit and are new, in order."""
    own = F.replace("p_name", F.lit(" "), F.lit("-"))
    given = F.array(F.lit("No Tag"), own, F.lit("a--b"), F.lit("new-tag"), F.lit("third"))
    known = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("x"))).otherwise(F.array(own))
    return table(spark, sf_dir, "part").select("p_partkey", R.proposed_tags(given, known).alias("tags"))


@query("p20_dedup_eligible", "SELECT p_partkey, p_size % 4 NOT IN (0, 1) AS ok FROM part")
def dedup_eligible(spark, sf_dir):
    kind = F.element_at(F.array(F.lit(" Literature"), F.lit("moc"), F.lit("concept"), F.lit(None).cast("string")), (F.col("p_size") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", R.dedup_eligible(kind).alias("ok"))


@query("p22_source_unresolved", "SELECT doc_id, doc_id % 10 = 0 OR (doc_id % 2 = 0 AND doc_id % 3 = 0) OR doc_id % 7 = 0 AS unresolved FROM documents")
def source_unresolved(spark, sf_dir):
    d = F.col("doc_id")
    gap = lambda m: F.when(d % m == 0, "").otherwise("x")
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "documents").select("doc_id", R.source_unresolved(gap(2), F.when(d % 7 != 0, F.lit("2001")), gap(3), none, d % 10 == 0).alias("unresolved"))


@query("p23_edition_unverified", "SELECT doc_id, doc_id % 2 = 1 AND n_chars % 3 > 1 AS unverified FROM documents")
def edition_unverified(spark, sf_dir):
    page = F.when(F.col("n_chars") % 3 > 0, F.col("n_chars") % 3)
    return table(spark, sf_dir, "documents").select("doc_id", R.edition_unverified(F.col("doc_id") % 2 == 0, page).alias("unverified"))


@query("p26_actionable", f"WITH {_DRAFTS} SELECT doc_id FROM drafts WHERE action <> 'skip' AND origin <> 'secondary_mention'")
def actionable(spark, sf_dir):
    return drafts(spark, sf_dir).where(R.actionable(F.col("action"), F.col("origin"))).select("doc_id")


@query("p28_own_version", f"WITH {RUNS_SQL} SELECT run_id FROM runs WHERE run_id % 3 = 0")
def own_version(spark, sf_dir):
    v = F.concat(F.when(F.col("run_id") % 6 == 0, "foss-").when(F.col("run_id") % 3 == 0, "extractive-").otherwise("v-foss-"), F.col("version"))
    return runs(spark, sf_dir).where(R.own_version(v)).select("run_id")


@query("p30_dashboard_filter", f"""WITH {RUNS_SQL}, f AS (SELECT run_id FROM runs WHERE version = 'v4.12.2' AND starts_with(lower('PDF ' || pdf), 'pdf 1') AND model <> '5-LOW')
SELECT run_id, (SELECT count(DISTINCT model) FROM runs) AS n_models FROM f""")
def dashboard_filter(spark, sf_dir):
    """Runs by version (the newest), a prefix of the file and the model; options come from all runs."""
    rows = runs(spark, sf_dir)
    newest = F.broadcast(rows.agg(F.max_by("version", T.version_key(F.col("version"))).alias("newest"), F.count_distinct("model").alias("n_models")))  # one row
    named = F.lower(F.concat(F.lit("PDF "), "pdf")).startswith("pdf 1")
    return rows.crossJoin(newest).where((F.col("version") == F.col("newest")) & named & (F.col("model") != "5-LOW")).select("run_id", "n_models")


@query("j16_run_semi_join", f"WITH {RUNS_SQL} SELECT l_orderkey AS run_id, l_linenumber AS k FROM lineitem WHERE l_orderkey IN (SELECT run_id FROM runs WHERE model = '1-URGENT')")
def run_semi_join(spark, sf_dir):
    """Quality rows of the runs that a filter left."""
    kept = runs(spark, sf_dir).where("model = '1-URGENT'").select("run_id")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("k")).join(kept, "run_id", "left_semi")


@query("p32_already_evaluated", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def already_evaluated(spark, sf_dir):
    """Notes without an evaluation of the version in question."""
    done = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id").join(done, "doc_id", "left_anti")


@query("p33_already_evaluated_log", "SELECT doc_id, quality = 1 AS done FROM labels")
def already_evaluated_log(spark, sf_dir):
    """Log rows of a version and folder whose path ends with the note's name."""
    path = F.concat(F.lit("/v/01-inbox/"), "doc_id", F.lit(".md"))
    version = F.when(F.col("quality") == 1, "v4").otherwise("v3")
    hit = (version == "v4") & path.endswith(F.concat("doc_id", F.lit(".md"))) & path.contains("01-inbox")
    return table(spark, sf_dir, "labels").select("doc_id", hit.alias("done"))


@query("p35_eval_targets", f"WITH {_DRAFTS} SELECT doc_id FROM drafts WHERE {_ROUTE} = 'ok' AND doc_id IN (SELECT doc_id FROM labels)")
def eval_targets(spark, sf_dir):
    """Notes that would be written and that exist (here: are labelled)."""
    there = table(spark, sf_dir, "labels").select("doc_id")
    return routed(spark, sf_dir).where("d.auto").select("doc_id").join(there, "doc_id", "left_semi")


@query("p39_header_line", r"SELECT p_partkey, p_retailprice > 1.15 * (SELECT avg(p_retailprice) FROM part) OR p_size % 2 = 0 AS header FROM part")
def header_line(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    mean = F.broadcast(part.agg(F.avg("p_retailprice").alias("m")))  # one row
    line = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("2. The "), "p_name")).otherwise(F.concat("p_name", F.lit(" goes on, and on.")))
    return part.crossJoin(mean).select("p_partkey", R.is_header(F.col("p_retailprice"), F.col("m"), line).alias("header"))


@query("f87_traffic_light", "SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN '⚪' WHEN p_size / 50.0 >= 0.7 THEN '🟢' WHEN p_size / 50.0 >= 0.4 THEN '🟡' ELSE '🔴' END AS light FROM part")
def traffic_light(spark, sf_dir):
    x = F.when(F.col("p_size") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("p_size") / 50.0)
    return table(spark, sf_dir, "part").select("p_partkey", R.traffic_light(x).alias("light"))


@query("f86_label_cell", "SELECT doc_id, CASE WHEN quality = 1 THEN 's' WHEN toxic = 1 THEN 'h' END AS label FROM labels")
def label_cell(spark, sf_dir):
    cell = F.concat(F.lit(" <!--claim_idx="), "doc_id", F.lit("--> "), F.when(F.col("quality") == 1, "S ").when(F.col("toxic") == 1, "h").otherwise("maybe"))
    return table(spark, sf_dir, "labels").select("doc_id", R.label_cell(cell).alias("label"))


@query("f94_yes_no", "SELECT p_partkey, p_size % 6 < 5 AS yes, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END::INT AS n FROM part")
def yes_no(spark, sf_dir):
    given = F.element_at(F.array(*map(F.lit, ["true", "YES", "1", " t ", "y", "no"])), (F.col("p_size") % 6 + 1).cast("int"))
    number = F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_size"), F.lit("/5 (good)"))).otherwise("none")
    return table(spark, sf_dir, "part").select("p_partkey", P.yes(given).alias("yes"), P.first_int(number).alias("n"))


@query("f83_context_pool", "SELECT l_orderkey AS note, l_linenumber AS k, 'K' || dense_rank() OVER (PARTITION BY l_orderkey ORDER BY first) AS kid FROM (SELECT *, min(l_linenumber) OVER (PARTITION BY l_orderkey, l_suppkey) AS first FROM lineitem)")
def context_pool(spark, sf_dir):
    """Ids of distinct chunks (here: suppliers) of a note's claims, in the order of first use."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("note"), F.col("l_linenumber").alias("k"), "l_suppkey")
    first = F.min("k").over(Window.partitionBy("note", "l_suppkey"))
    kid = F.dense_rank().over(Window.partitionBy("note").orderBy("first"))
    return rows.withColumn("first", first).select("note", "k", F.concat(F.lit("K"), kid).alias("kid"))


@query("w9_context_expansion", r"""WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(coalesce(lag(text) OVER o || ' ', '') || text || coalesce(' ' || lead(text) OVER o, ''), '\s+'), lambda x: x <> '') AS w FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, sha256(array_to_string(w[1:450], ' ')) AS h FROM w""")
def context_expansion(spark, sf_dir):
    """A chunk with its neighbours, 450 words at most (its own limit)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    three = F.concat_ws(" ", F.lag("text").over(w), "text", F.lead("text").over(w))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.words(three).alias("w"))
    return rows.select("conv_id", "turn", F.sha2(F.array_join(F.slice("w", 1, 450), " "), 256).alias("h"))
