"""Plans over evaluations, merges, page filters and writes as a whole."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folium.functions import text as T
from folium.operators import evaluate as E
from folium.operators import models as M
from folium.plans import models as PM
from folium.plans.registry import Registry
from folium.sources import metadata as B
from folium.sources import stores as X
from folium.sources.tables import table

QUERIES = Registry()
query = QUERIES.query


def lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


@query("a44_evaluation_v1", """WITH x AS (SELECT l_orderkey AS note, CASE l_partkey % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'uncertain' WHEN 2 THEN 'hallucinated' ELSE 'not_parseable' END AS label, l_suppkey % 20 AS page FROM lineitem),
n AS (SELECT note, count(*) AS anchors, count(*) FILTER (WHERE label <> 'not_parseable') AS p, count(*) FILTER (WHERE label = 'confirmed') AS c, count(*) FILTER (WHERE label = 'hallucinated') AS h, count(DISTINCT page) AS g FROM x GROUP BY note)
SELECT note, anchors, p AS parseable, CASE WHEN p > 0 THEN round(CAST(h AS DOUBLE) / p, 3) ELSE 0.0 END AS hallucination_rate, round(c / 12.0, 3) AS coverage, round(c / 9.0, 3) AS coverage_factual, round(g / 20.0, 3) AS source_coverage, p < 5 AS small_sample FROM n""")
def evaluation_v1(spark, sf_dir):
    k = F.col("l_partkey") % 4
    label = F.when(k == 0, "confirmed").when(k == 1, "uncertain").when(k == 2, "hallucinated").otherwise("not_parseable")
    rows = lines(spark, sf_dir).select(F.col("l_orderkey").alias("note"), label.alias("label"), (F.col("l_suppkey") % 20).alias("page"))
    return E.by_anchors(rows, F.lit(12), F.lit(9), F.lit(20)).drop("ci_lo", "ci_hi")


@query("a45_evaluation_v2", """WITH x AS (SELECT l_orderkey AS note, l_discount * 10 AS e, l_tax * 10 AS c, l_suppkey % 8 AS chunk FROM lineitem), y AS (SELECT *, CASE WHEN c >= 0.5 AND e < 0.4 THEN 'contradiction' WHEN e >= 0.7 THEN 'confirmed' WHEN e >= 0.4 THEN 'uncertain' ELSE 'hallucinated' END AS l FROM x)
SELECT note, count(*) AS claims, round(count(*) FILTER (WHERE l = 'confirmed') / CAST(count(*) AS DOUBLE), 3) AS support_rate, round(count(*) FILTER (WHERE l IN ('hallucinated', 'contradiction')) / CAST(count(*) AS DOUBLE), 3) AS hallucination_rate,
  round(CAST(sum(CAST(e AS DECIMAL(20,6))) AS DOUBLE) / count(*), 3) AS mean_entailment, round(count(DISTINCT CASE WHEN l = 'confirmed' THEN chunk END) / 8.0, 3) AS span_diversity FROM y GROUP BY note""")
def evaluation_v2(spark, sf_dir):
    rows = lines(spark, sf_dir).select(F.col("l_orderkey").alias("note"), (F.col("l_discount") * 10).alias("entailment"), (F.col("l_tax") * 10).alias("contradiction"), (F.col("l_suppkey") % 8).alias("chunk"))
    return E.by_claims(rows, F.lit(8))


@query("f122_empty_result", "SELECT p_partkey, p_name AS note, 'pdf_not_parseable' AS error, p_size AS claims_total, 0 AS claims_contradicted, CAST(-1.0 AS DOUBLE) AS confirmed_rate, false AS rate_valid FROM part")
def empty_result(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", E.empty_result(F.col("p_name"), F.lit("pdf_not_parseable"), F.col("p_size")).alias("r"))
    return rows.select("p_partkey", "r.note", "r.error", "r.claims_total", "r.claims_contradicted", "r.confirmed_rate", "r.rate_valid")


@query("f82_prompt_batches", """WITH x AS (SELECT conv_id, turn, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS n FROM conversations) SELECT conv_id, sum(n)::BIGINT AS words, count(*) AS items FROM x GROUP BY conv_id""")
def prompt_batches(spark, sf_dir):
    """Turns packed into prompts of forty words; together they are all turns, in order."""
    item = F.struct("turn", F.size(T.words(F.col("text"))).alias("words"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("x"))
    packed = rows.select("conv_id", F.explode(E.prompt_batches(F.col("x"), 40)).alias("b"))
    ok = packed.where((F.size("b") == 1) | (F.aggregate("b", F.lit(0), lambda s, i: s + i["words"]) <= 40))
    return ok.groupBy("conv_id").agg(F.sum(F.aggregate("b", F.lit(0), lambda s, i: s + i["words"])).alias("words"), F.sum(F.size("b")).alias("items"))


@query("p7_page_filter", "SELECT p_partkey, ['Text of ' || p_name, 'Lee, A. 2001 in the text', 'Rest'] AS l FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, ['Text of ' || p_name, 'after two'] FROM part WHERE p_size % 2 = 1")
def page_filter(spark, sf_dir):
    """Running heads, captions and bibliographies go; an entry's shape in the text stays."""
    head = [F.lit("Running head"), F.concat(F.lit("Text of "), "p_name"), F.lit("Abb. 3: a figure")]
    even = F.array(*head, F.lit("Lee, A. 2001 in the text"), F.lit("Rest"))
    odd = F.array(*head, F.lit("Literatur"), F.lit("Lee, A. 2001 x"), F.lit("Du, B. 1999 y"), F.lit("after two"), F.lit("Ek, C. 2010 z"), F.lit("after three"))
    page = F.when(F.col("p_size") % 2 == 0, even).otherwise(odd)
    return table(spark, sf_dir, "part").select("p_partkey", E.page_lines(page, F.array(F.lit("Running head"))).alias("l"))


@query("s58_page_sentences", "SELECT p_partkey, unnest(['The first sentence is about ' || p_name || '.', 'Vgl. S. 4 for what is said of ' || p_brand || '.']) AS s FROM part")
def page_sentences(spark, sf_dir):
    """Sentences of twenty characters and more from the lines of a page that a filter leaves."""
    page = F.array(F.lit("Running head"), F.concat(F.lit("The first sentence is  about "), "p_name", F.lit(". Short one.")), F.concat(F.lit("Vgl. S. 4 for what is said of "), "p_brand", F.lit(".")))
    kept = E.page_lines(page, F.array(F.lit("Running head")))
    text = F.regexp_replace(F.array_join(kept, " "), r"\s+", " ")
    cut = F.filter(T.sentences(F.replace(text, F.lit("Vgl. "), F.lit("vgl. "))), lambda s: F.char_length(s) >= 20)
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(F.transform(cut, lambda s: F.replace(s, F.lit("vgl. "), F.lit("Vgl. ")))).alias("s"))


@query("f71_unified_diff")
def unified_diff(spark, sf_dir):
    """Tests hold diffs."""
    new = F.regexp_replace("text", r"\n", "\nadded\n")
    return table(spark, sf_dir, "documents").select("doc_id", E.unified_diff(F.col("text"), new, F.concat("doc_id", F.lit(".md"))).alias("diff"))


@query("f92_safe_alt", r"SELECT p_partkey, 'A \[\[' || p_name || '\]\] and \| ' || p_brand AS alt FROM part")
def safe_alt(spark, sf_dir):
    given = F.concat(F.lit("  A [["), "p_name", F.lit("]]\n and | "), "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", E.safe_alt(given).alias("alt"))


@query("f103_draft_excerpt", r"SELECT conv_id, turn, array_to_string(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')[1:150], ' ') AS excerpt FROM conversations")
def draft_excerpt(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.slice(T.words(F.col("text")), 1, 150), " ").alias("excerpt"))


@query("f6_abbreviations", "SELECT p_partkey, 1::BIGINT AS n FROM part")
def abbreviations(spark, sf_dir):
    """A line in which every period is held: abbreviations, initials, a decimal, a page reference."""
    given = F.concat(F.lit("vgl. J. R. Lee z.B. S. 4-5, 3.5 "), "p_name", F.lit(" etc. und ff. "), "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", F.size(T.sentences(given)).cast("long").alias("n"))


@query("f35_language_detect", "SELECT doc_id, CASE WHEN length(trim(text, ' ')) < 3 THEN 'unknown' ELSE CASE WHEN regexp_matches(text[1:500], '[äöüßÄÖÜ]') OR g >= e THEN 'de' ELSE 'en' END END AS lang FROM (SELECT *, len(list_filter(string_split_regex(lower(text[1:500]), '[^\\p{L}\\p{N}_]+'), lambda w: w IN ('der','die','das','und','ist','werden','nicht','eine','einer'))) AS g, len(list_filter(string_split_regex(lower(text[1:500]), '[^\\p{L}\\p{N}_]+'), lambda w: w IN ('the','and','is','are','not','with','from','this','that'))) AS e FROM documents)")
def language_detect(spark, sf_dir):
    """The language of the first 500 characters (the operator's own limit), by the word rule."""
    head = F.substring("text", 1, 500)
    guess = F.when(F.char_length(F.trim("text")) < 3, "unknown").otherwise(F.lower(T.german_or_english(head)))
    return table(spark, sf_dir, "documents").select("doc_id", guess.alias("lang"))


@query("u1_whitelist_union", "SELECT p_type AS tag FROM part UNION SELECT p_brand FROM part WHERE p_size > 25")
def whitelist_union(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_type").alias("tag")).union(part.where("p_size > 25").select("p_brand")).distinct()


@query("u4_token_sets", "SELECT p_partkey, list_sort(list_intersect(a, b)) AS both, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS rest, len(list_intersect(a, b)) = len(a) AS subset FROM (SELECT p_partkey, string_split(p_name, ' ') AS a, ['small', 'red', 'blue', 'ring', 'bolt'] AS b FROM part)")
def token_sets(spark, sf_dir):
    a, b = F.split("p_name", " "), F.array(*map(F.lit, ["small", "red", "blue", "ring", "bolt"]))
    rest = F.array_except(a, b)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_sort(F.array_intersect(a, b)).alias("both"), F.array_sort(rest).alias("rest"), (F.size(rest) == 0).alias("subset"))


@query("a47_cluster_merge", """WITH m AS (SELECT p_brand AS cluster, p_partkey, 'T' || p_partkey AS title, p_name, p_type FROM part), s AS (SELECT cluster, count(*) AS n, min(p_partkey) AS rep FROM m GROUP BY 1), t AS (SELECT cluster, p_type, count(*) AS k FROM m GROUP BY 1, 2),
a AS (SELECT cluster, title AS x FROM m UNION SELECT cluster, p_name FROM m)
SELECT s.cluster, 'T' || rep AS title, (SELECT count(DISTINCT p_name) FROM m WHERE m.cluster = s.cluster) AS anchors, coalesce((SELECT list_sort(list(x)) FROM a WHERE a.cluster = s.cluster AND x <> 'T' || rep), []) AS aliases, coalesce((SELECT list_sort(list(p_type)) FROM t WHERE t.cluster = s.cluster AND (n < 3 OR k >= 2)), []) AS tags FROM s""")
def cluster_merge(spark, sf_dir):
    anchor = F.struct(F.concat(F.lit(" "), "p_name").alias("quote"), F.lit("S. 1").alias("page"))
    rows = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("cluster"), F.col("p_partkey").alias("pos"), F.concat(F.lit("T"), "p_partkey").alias("title"), F.array("p_name").alias("aliases"), F.array("p_type", "p_type").alias("tags"), F.array(anchor, anchor).alias("anchors")
    )
    return E.merged_cluster(rows)


@query("s32_write_plan", """SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'merge' WHEN 1 THEN 'cross-source merge' WHEN 2 THEN 'overwrite' WHEN 3 THEN 'variant' ELSE 'create' END AS action,
  CASE p_partkey % 6 WHEN 0 THEN 'MERGE - Part ' || p_partkey || '.md' WHEN 1 THEN 'XSOURCE-MERGE - Part ' || p_partkey || '.md' WHEN 2 THEN 'old/' || p_partkey || '.md' WHEN 3 THEN 'old/' || p_partkey || '-2.md' ELSE 'Part ' || p_partkey || '.md' END AS path FROM part""")
def write_plan(spark, sf_dir):
    p = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    drafts = part.select(p.alias("id"), F.concat(F.lit("Part "), p).alias("title"), F.lit("a.pdf").alias("source"))
    vault = part.where(p % 6 < 2).select(F.concat(F.lit("PART "), p).alias("title"), F.when(p % 6 == 0, "a.pdf").otherwise("b.pdf").alias("source"))
    inbox = part.where((p % 6).isin(2, 3)).select(F.concat(F.lit("old/"), p, F.lit(".md")).alias("path"), F.concat(F.lit("part "), p).alias("title"), F.lit("a.pdf").alias("source"), (p % 6 == 2).alias("pristine"))
    return E.write_plan(drafts, vault, inbox)


@query("s39_state_load", "SELECT p_partkey, p_name, p_size FROM part")
def state_load(spark, sf_dir):
    saved = X.state(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), "p_partkey")
    return X.restored(saved, "p_partkey", "p_name string, p_size " + table(spark, sf_dir, "part").schema["p_size"].dataType.simpleString())


@query("s45_open_library_lookup", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Book ' || p_partkey END AS title FROM part")
def open_library_lookup(spark, sf_dir):
    service = lambda isbn: '{"title": "Book %s", "publish_date": "2001"}' % isbn if isbn else None
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_partkey").cast("string")).alias("id"))
    return B.fetched(rows, service).select("p_partkey", B.open_library(F.col("answer"))["title"].alias("title"))


@query("x19_json_repair", "SELECT p_partkey AS note, p_size % 3 = 1 AS repaired FROM part WHERE p_size % 3 < 2")
def json_repair(spark, sf_dir):
    """Answers that hold no array go to a second call, which repairs a part of them."""
    from folium.functions import parsing as P
    from folium.operators import judge

    rule = lambda p: "[]" if int(p) % 3 == 1 else "none"
    rows = table(spark, sf_dir, "part").where("p_size % 3 < 2").select(F.col("p_partkey").alias("note"), F.col("p_size").cast("string").alias("prompt"))
    return M.called(rows, M.Offline(rule), "m").select("note", P.json_array(F.col("text"), judge.RAW).isNotNull().alias("repaired"))


@query("x13_verifier", "SELECT CASE p_partkey % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'fuzzy' WHEN 2 THEN 'semantic' END AS tier, count(*) AS n FROM part WHERE p_partkey % 5 < 3 GROUP BY 1")
def verifier(spark, sf_dir):
    """Anchors per tier that resolved them; the statistics event of a verification."""
    rows = M.tiers(PM.anchored(spark, sf_dir)).where("tier in ('exact', 'fuzzy', 'semantic')")
    return rows.groupBy("tier").agg(F.count("*").alias("n"))


@query("st10_parallel_extraction", "SELECT p_partkey AS id, p_name AS title FROM part WHERE p_partkey % 10 > 0")
def parallel_extraction(spark, sf_dir):
    """Extractions that fail or hold no note drop; the others go on."""
    from folium.functions import parsing as P

    def rule(prompt: str) -> str:
        title, key = prompt.split("\n")
        if key.endswith("0"):
            raise ValueError
        return f"<!--NOTE-->\ntitle: {title}\n<!--END-->"

    prompt = F.concat_ws("\n", "p_name", F.col("p_partkey").cast("string")).alias("prompt")
    rows = M.called(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), prompt), M.Offline(rule), "m", at_a_time=4)
    return rows.where("error is null").select("id", F.explode(P.notes(F.col("text"))["notes"]).alias("n")).select("id", "n.title")


@query("p12_entity_projection", "SELECT p_partkey, p_name || ' Theory' AS name, 'Concept' AS type, 3 AS page FROM part WHERE p_size >= 38")
def entity_projection(spark, sf_dir):
    """Recognised entities of a score of .75 and more that are specific and of the language."""
    from folium.functions import drafts as R

    found = F.array(*[F.struct(t.alias("name"), F.lit("Concept").alias("type"), F.lit(3).alias("page")) for t in (F.concat(F.lit(" "), "p_name", F.lit(" Theory ")), F.lit("theory"), F.lit("ab"))])
    rows = table(spark, sf_dir, "part").where("p_size / 50.0 >= 0.75").select("p_partkey", F.explode(found).alias("e")).select("p_partkey", F.trim("e.name").alias("name"), "e.type", "e.page")
    return rows.where((F.char_length("name") >= 3) & R.is_specific(F.col("name")) & R.fits_language(F.col("name"), F.lit("en"), F.lit("en")))


@query("s11_block_lines", "SELECT l_orderkey AS page, string_agg(CAST(l_partkey AS VARCHAR), ' ' ORDER BY round_even(l_extendedprice / 8.0, 0) * 8, l_partkey) AS line FROM lineitem GROUP BY 1")
def block_lines(spark, sf_dir):
    """Blocks of a page in reading order: by rows of eight points, then from the left.

    A page has few blocks (here: the lines of an order)."""
    row = F.struct((F.bround(F.col("l_extendedprice") / 8.0) * 8).alias("y"), F.col("l_partkey").alias("x"), F.col("l_partkey").cast("string").alias("t"))
    pages = lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("page")).agg(F.array_sort(F.collect_list(row)).alias("b"))
    return pages.select("page", F.array_join(F.transform("b", lambda x: x["t"]), " ").alias("line"))


@query("w12_layout_chunks", """WITH l AS (SELECT l_orderkey AS doc, l_linenumber AS pos, l_partkey, l_partkey % 3 = 0 AS head FROM lineitem), c AS (SELECT *, count(*) FILTER (WHERE head) OVER (PARTITION BY doc ORDER BY pos, l_partkey ROWS UNBOUNDED PRECEDING) AS chunk FROM l)
SELECT doc, chunk, count(*) AS n, max(CASE WHEN head THEN l_partkey END) AS header FROM c GROUP BY doc, chunk""")
def layout_chunks(spark, sf_dir):
    """Lines from header to header: a running count of headers numbers the chunks."""
    rows = lines(spark, sf_dir).select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos"), "l_partkey", (F.col("l_partkey") % 3 == 0).alias("head"))
    w = Window.partitionBy("doc").orderBy("pos", "l_partkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = rows.withColumn("chunk", F.sum(F.col("head").cast("long")).over(w))
    return cut.groupBy("doc", "chunk").agg(F.count("*").alias("n"), F.max(F.when(F.col("head"), F.col("l_partkey"))).alias("header"))


@query("w16_keyword_fallback", r"""WITH w AS (SELECT source, unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}]{4,}'), lambda x: true)) AS w FROM documents), n AS (SELECT source, w, count(*) AS tf FROM w GROUP BY ALL), d AS (SELECT w, count(*) AS df FROM n GROUP BY w)
SELECT source, w, tf FROM (SELECT source, w, tf, row_number() OVER (PARTITION BY source ORDER BY round(tf * ln(1 + 20.0 / df), 9) DESC, w) AS k FROM n JOIN d USING (w)) WHERE k <= 8""")
def keyword_fallback(spark, sf_dir):
    """Eight words of a source that tell it from the others, by frequency and rarity."""
    words = table(spark, sf_dir, "documents").select("source", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{4,}"), F.lit(0))).alias("w"))
    tf = words.groupBy("source", "w").agg(F.count("*").alias("tf"))
    df = tf.groupBy("w").agg(F.count("*").alias("df"))
    score = F.round(F.col("tf") * F.log(1 + F.lit(20.0) / F.col("df")), 9)
    k = F.row_number().over(Window.partitionBy("source").orderBy(score.desc(), "w"))
    return tf.join(df, "w").withColumn("k", k).where("k <= 8").select("source", "w", "tf")
