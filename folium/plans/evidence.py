"""Plans over evidence: fuzzy scores, chunks, windows and central sentences.

Fuzzy scores and greedy choices have no SQL; tests hold them against brute force."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folium.functions import chunks as C
from folium.functions import fuzzy as Z
from folium.functions import pages as P
from folium.functions import text as T
from folium.plans.registry import Registry
from folium.plans.texts import split_sql
from folium.sources.claims import RUNS_SQL, runs
from folium.sources.tables import table

QUERIES = Registry()
query = QUERIES.query


def turns(spark, sf_dir):
    """(conv_id, turn, text, before): turns with the one before."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", before.alias("before")).where("before is not null")


@query("f20_fuzzy_ratio")
def fuzzy_ratio(spark, sf_dir):
    rows = turns(spark, sf_dir)
    return rows.select("conv_id", "turn", F.round(Z.ratio_of(F.col("text"), F.col("before")), 6).alias("ratio"))


@query("f20_fuzzy_token_set")
def fuzzy_token_set(spark, sf_dir):
    rows = turns(spark, sf_dir)
    return rows.select("conv_id", "turn", F.round(Z.token_set_ratio_of(F.lower("text"), F.lower("before")), 6).alias("ratio"))


@query("f20_fuzzy_partial")
def fuzzy_partial(spark, sf_dir):
    """Part names, one letter changed, in a line that holds them."""
    name = F.concat(F.substring("p_name", 1, 2), F.lit("x"), F.substring("p_name", 4, 100))
    line = F.concat(F.lit("a line with "), "p_name", F.lit(" in "), "p_type")
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("a"), line.alias("b"))
    return rows.select("p_partkey", F.round(Z.partial_ratio_of(F.col("a"), F.col("b")), 6).alias("ratio"), Z.partial_place_of(F.col("a"), F.col("b")).alias("at"))


@query("f12_evidence")
def evidence(spark, sf_dir):
    """The first sentence of a text, whole, with a word more, and with other words, as evidence."""
    first = F.regexp_extract("text", r"^(.{1,200}?[.!?])", 1)
    given = F.array(first, F.concat(first, F.lit(" otherword")), F.concat(F.lit("quite other words than these "), "source"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.posexplode(given).alias("k", "q"))
    rows = rows.select("doc_id", "k", T.evidence_key(F.col("q")).alias("q"), T.evidence_key(F.substring_index("text", "\n", 1)).alias("t"))
    return rows.select("doc_id", "k", Z.evidence(F.col("q"), F.col("t")).alias("e")).select("doc_id", "k", "e.ok", "e.score")


@query("a41_hallucination_rate", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 0.5 ELSE 0.0 END AS rate FROM part")
def hallucination_rate(spark, sf_dir):
    """One verbatim and one invented sentence, or one too short to tell."""
    text = F.concat(F.lit("the line of "), "p_name", F.lit(" and of "), "p_brand", F.lit(" and more words"))
    said = F.array(F.concat(F.lit("the line of "), "p_name"), F.when(F.col("p_size") % 2 == 0, "zqzqzq xyxyxy qqqq zzzz").otherwise("zq"))
    rows = table(spark, sf_dir, "part").select("p_partkey", text.alias("t"), F.explode(said).alias("s"))
    rows = rows.withColumn("h", Z.hallucinated(F.col("s"), F.col("t"))).where(F.char_length(F.trim("s")) >= Z.LEAST)
    return rows.groupBy("p_partkey").agg(F.round(F.avg(F.col("h").cast("double")), 6).alias("rate"))


@query("f13_clean_sentence", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'The interaction of ' || p_name || ' is known' WHEN 1 THEN '' ELSE '' END AS s FROM part")
def clean_sentence(spark, sf_dir):
    k = F.col("p_partkey") % 3
    given = F.when(k == 0, F.concat(F.lit("The interac- tion of "), "p_name", F.lit(" is known [21, 22]"))).when(k == 1, "; Allard, S.L. and so on (S. 8)").otherwise("too short (S. 3)")
    return table(spark, sf_dir, "part").select("p_partkey", C.clean_sentence(given).alias("s"))


@query("w8_packed_chunks")
def packed_chunks(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(C.packed(T.sentences(F.col("text")))).alias("chunk", "s"))
    return rows.select("doc_id", "chunk", F.size("s").alias("n_sentences"), F.array_join("s", " ").alias("text"))


def first_words(spark, sf_dir):
    """(doc_id, concept, sentences): a text's sentences and the third word of the text as a concept."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.get(T.words(F.col("text")), F.lit(2)).alias("concept"), T.sentences(F.col("text")).alias("s"))
    return rows.where("concept is not null")


@query("w13_concept_sentences")
def concept_sentences(spark, sf_dir):
    near = F.filter(F.transform(C.around_column(F.col("s"), F.col("concept")), C.clean_sentence), lambda s: s != "")
    return first_words(spark, sf_dir).select("doc_id", F.array_distinct(near).alias("sentences"))


@query("w14_central_sentences")
def central_sentences(spark, sf_dir):
    return first_words(spark, sf_dir).select("doc_id", C.central_column(F.col("s"), F.col("concept")).alias("sentences"))


@query("w3_concept_window")
def concept_window(spark, sf_dir):
    """Windows around a two-word title and two terms; the rest of a text is read, too."""
    w = T.words(F.col("text"))
    terms = F.array(F.array_join(F.slice(w, 3, 2), " "), F.coalesce(F.get(w, F.lit(5)), F.lit("")), F.lit("the"))
    return table(spark, sf_dir, "documents").select("doc_id", C.window_column(F.col("text"), terms).alias("window"))


@query("w15_distinct_concepts")
def distinct_concepts(spark, sf_dir):
    """Names of a brand, best price first, none like one that was kept.

    A group is one source's concepts, which a planner caps; distinct names combine first."""
    rows = table(spark, sf_dir, "part").groupBy("p_brand", F.concat_ws(" ", "p_name", "p_type").alias("name")).agg(F.max("p_retailprice").alias("score"))
    kept = rows.groupBy("p_brand").applyInPandas(
        lambda pdf: C.distinct_names(pdf[["name", "score", "p_brand"]], Z.NEAR, Z.ratio), "name string, score double, p_brand string"
    )
    return kept.select("p_brand", "name", "score")


@query("a43_overview_coverage")
def overview_coverage(spark, sf_dir):
    pair = lambda w, x: F.array_join(F.slice(w, F.greatest(F.lit(1), F.floor(F.size(w) * x).cast("int")), F.lit(2)), " ")
    titles = T.bound(T.words(F.col("text")), lambda w: F.array(*[pair(w, x) for x in (0.1, 0.5, 0.9)]))
    measured = T.bound(titles, lambda t: C.coverage(t, F.col("text"), P.overview(F.col("text"), 300), T.content_tokens))
    return table(spark, sf_dir, "documents").select("doc_id", measured.alias("c")).select("doc_id", "c.*")


@query("w25_claim_picks", """WITH n AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('42' || doc_id)) AS k FROM documents), c AS (SELECT doc_id, s, pos FROM (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, """ + split_sql("text") + """ AS l FROM documents WHERE doc_id IN (SELECT doc_id FROM n WHERE k <= 3))))
SELECT lang, doc_id, pos FROM (SELECT lang, doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY md5('42' || doc_id || '|' || pos)) AS r FROM c JOIN n USING (doc_id)) WHERE r <= 2""")
def claim_picks(spark, sf_dir):
    """Three notes of a language and two sentences of each, by a seeded hash."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    k = F.row_number().over(Window.partitionBy("lang").orderBy(F.md5(F.concat(F.lit("42"), "doc_id"))))
    rows = d.select("doc_id", "lang").withColumn("k", k).where("k <= 3").drop("k").join(d.select("doc_id", "text"), "doc_id")
    s = rows.select("lang", "doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "s"))
    r = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.md5(F.concat(F.lit("42"), "doc_id", F.lit("|"), "pos"))))
    return s.withColumn("r", r).where("r <= 2").select("lang", "doc_id", F.col("pos").cast("long").alias("pos"))


@query("w30_title_ranking", """WITH t AS (SELECT p_partkey, len(list_intersect(string_split(p_name, ' '), ['small', 'ring', 'blue', 'bolt'])) AS n FROM part) SELECT p_partkey, n FROM (SELECT *, row_number() OVER (ORDER BY n DESC, p_partkey) AS k FROM t) WHERE k <= 75""")
def title_ranking(spark, sf_dir):
    """The 75 titles that share most tokens with a prompt; ties in order."""
    n = F.size(F.array_intersect(F.split("p_name", " "), F.array(*map(F.lit, ["small", "ring", "blue", "bolt"]))))
    return table(spark, sf_dir, "part").select("p_partkey", n.cast("long").alias("n")).orderBy(F.col("n").desc(), "p_partkey").limit(75)


@query("w35_free_variant", "SELECT p_name AS stem, p_name || CASE count(*) WHEN 1 THEN '' ELSE '-' || count(*) END AS free FROM (SELECT p_name FROM part UNION ALL SELECT p_name FROM part) GROUP BY p_name")
def free_variant(spark, sf_dir):
    """The first unused number of a name, where names 2 to n are taken."""
    rows = table(spark, sf_dir, "part").select("p_name").unionAll(table(spark, sf_dir, "part").select("p_name"))
    n = rows.groupBy("p_name").agg(F.count("*").alias("n"))
    return n.select(F.col("p_name").alias("stem"), F.concat("p_name", F.when(F.col("n") == 1, "").otherwise(F.concat(F.lit("-"), "n"))).alias("free"))


@query("a58_scaling_points", f"""WITH {RUNS_SQL}, v AS (SELECT version, dense_rank() OVER (ORDER BY CAST(split_part(version[2:], '.', 1) AS INT) DESC, CAST(split_part(version, '.', 2) AS INT) DESC, CAST(split_part(version, '.', 3) AS INT) DESC) AS r FROM (SELECT DISTINCT version FROM runs))
SELECT run_id, words, n_total, r <= 10 AS recent FROM runs JOIN v USING (version) WHERE words > 0 AND n_total > 0""")
def scaling_points(spark, sf_dir):
    """Words against notes; runs of the newest ten versions are marked."""
    rows = runs(spark, sf_dir)
    place = F.dense_rank().over(Window.orderBy(F.desc("k")))
    newest = rows.select("version").distinct().withColumn("k", T.version_key(F.col("version"))).withColumn("r", place)
    return rows.where("words > 0 and n_total > 0").join(F.broadcast(newest.limit(10_000).select("version", "r")), "version").select("run_id", "words", "n_total", (F.col("r") <= 10).alias("recent"))


@query("a19_agent_stats", """WITH e AS (SELECT CASE WHEN event_type = 'error' THEN NULL WHEN event_type IN ('view', 'click') THEN 'eval_quality' ELSE event_type END AS agent, value, user_id FROM events)
SELECT agent, count(*) AS calls, count(*) FILTER (WHERE user_id % 7 = 0) AS errors, round(sum(value), 4) AS cost, round(100.0 * count(*) FILTER (WHERE user_id % 2 = 0) / count(*), 2) AS cached FROM e WHERE agent IS NOT NULL AND user_id % 5 = 0 GROUP BY agent""")
def dashboard_agent_stats(spark, sf_dir):
    """Sums per canonical agent over the runs that a filter left."""
    kept = table(spark, sf_dir, "events").where("user_id % 5 = 0").select("user_id").distinct()
    agent = F.when(F.col("event_type") == "error", None).when(F.col("event_type").isin("view", "click"), "eval_quality").otherwise(F.col("event_type"))
    rows = table(spark, sf_dir, "events").join(kept, "user_id", "left_semi").withColumn("agent", agent).where("agent is not null")
    even, bad = F.col("user_id") % 2 == 0, F.col("user_id") % 7 == 0
    return rows.groupBy("agent").agg(
        F.count("*").alias("calls"), F.count_if(bad).alias("errors"), F.round(F.sum("value"), 4).alias("cost"), F.round(100.0 * F.count_if(even) / F.count("*"), 2).alias("cached")
    )
