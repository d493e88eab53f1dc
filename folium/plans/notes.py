"""Note plans: key lookups, link rewrites, rankings and metadata clean-up."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folium.functions import names as N
from folium.functions import text as T
from folium.plans.registry import Registry
from folium.plans.texts import split_sql
from folium.sources.claims import RUNS_SQL, runs
from folium.sources.tables import table

QUERIES = Registry()
query = QUERIES.query


def docs(spark, sf_dir, *columns):
    return table(spark, sf_dir, "documents").select("doc_id", *columns)


@query("a11_distinct_versions", f"WITH {RUNS_SQL} SELECT DISTINCT version FROM runs WHERE version IS NOT NULL")
def distinct_versions(spark, sf_dir):
    return runs(spark, sf_dir).select("version").where("version is not null").distinct()


@query("p31_eval_select", f"WITH {RUNS_SQL} SELECT run_id, ts, rate FROM runs WHERE version = 'v4.3.1' AND model = '2-HIGH'")
def eval_select(spark, sf_dir):
    return runs(spark, sf_dir).where("version = 'v4.3.1' and model = '2-HIGH'").select("run_id", "ts", "rate").orderBy("ts")


@query(
    "a25_accept_trend",
    f"""WITH {RUNS_SQL} SELECT version, round(CAST(sum(n_vault) AS DOUBLE) / sum(n_total) * 100, 1) AS accept, round(avg(duration) FILTER (WHERE duration > 0), 4) AS mean_duration, CAST(sum(tokens) AS BIGINT) AS tokens FROM runs GROUP BY version""",
)
def accept_trend(spark, sf_dir):
    return (
        runs(spark, sf_dir)
        .groupBy("version")
        .agg(
            F.round(F.sum("n_vault") / F.sum("n_total") * 100, 1).alias("accept"),
            F.round(F.avg(F.when(F.col("duration") > 0, F.col("duration"))), 4).alias("mean_duration"),
            F.sum("tokens").alias("tokens"),
        )
    )


@query("a56_rate_scatter", f"WITH {RUNS_SQL} SELECT run_id, round(rate * 100, 1) AS x, round(100.0 * n_vault / n_total, 1) AS y FROM runs WHERE rate >= 0")
def rate_scatter(spark, sf_dir):
    return runs(spark, sf_dir).where("rate >= 0").select(
        "run_id", F.round(F.col("rate") * 100, 1).alias("x"), F.round(100.0 * F.col("n_vault") / F.col("n_total"), 1).alias("y")
    )


@query(
    "j17_run_enrichment",
    """SELECT c_custkey, count(o_orderkey) AS n_runs, coalesce(max(o_orderstatus), '-') AS status, n_name AS place FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey GROUP BY c_custkey, n_name""",
)
def run_enrichment(spark, sf_dir):
    """Runs of a key with their labels; keys without runs stay."""
    per = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderstatus").alias("s"))
    place = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("place"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(per, "c_custkey", "left").join(place, "c_nationkey", "left")
    return rows.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_runs"), F.coalesce("s", F.lit("-")).alias("status"), "place")


@query(
    "j1_concept_lookup",
    """WITH k AS (SELECT lower(p_name) AS key, min(p_partkey) AS path, count(DISTINCT p_partkey) AS n FROM part GROUP BY 1)
SELECT p_partkey, CASE WHEN n = 1 THEN path END AS path FROM part LEFT JOIN k ON key = lower(p_name)""",
)
def concept_lookup(spark, sf_dir):
    """The one entry of a key; an ambiguous key finds nothing."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("key"))
    keys = part.groupBy("key").agg(F.min("p_partkey").alias("lo"), F.max("p_partkey").alias("hi"))
    return part.join(keys, "key", "left").select("p_partkey", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("path"))


@query(
    "j10_link_rewrite",
    """WITH m AS (SELECT doc_id, 'merged-' || doc_id AS target FROM documents WHERE doc_id % 3 = 0), r AS (SELECT doc_id, unnest([doc_id + 1, doc_id + 2, doc_id + 3]) AS link, unnest([1, 2, 3]) AS pos FROM documents)
SELECT r.doc_id, array_to_string(list(coalesce(target, CAST(link AS VARCHAR)) ORDER BY pos), ',') AS links FROM r LEFT JOIN m ON m.doc_id = link GROUP BY r.doc_id""",
)
def link_rewrite(spark, sf_dir):
    """Links to merged notes point at what they were merged into, in order."""
    merged = docs(spark, sf_dir).where("doc_id % 3 = 0").select(F.col("doc_id").alias("link"), F.concat(F.lit("merged-"), "doc_id").alias("target"))
    d = F.col("doc_id")
    rows = docs(spark, sf_dir).select("doc_id", F.posexplode(F.array(d + 1, d + 2, d + 3)).alias("pos", "link")).join(merged, "link", "left")
    pairs = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("target", F.col("link").cast("string")).alias("v"))))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(pairs, lambda x: x["v"]), ",").alias("links"))


_NAMES_SQL = "SELECT c_custkey, c_name || ' ' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN ': eine lange Geschichte' ELSE '' END AS title FROM customer"


@query(
    "j20_title_match",
    rf"""WITH t AS ({_NAMES_SQL}), k AS (SELECT c_custkey, unnest([title, split_part(title, ':', 1), 'Other ' || title, 'Customer eine']) AS found, unnest(range(0, 4)) AS k, title FROM t),
x AS (SELECT *, list_distinct(regexp_extract_all(lower(title), '[\p{{L}}]{{4,}}')) AS a, list_distinct(regexp_extract_all(lower(found), '[\p{{L}}]{{4,}}')) AS b, list_distinct(regexp_extract_all(lower(split_part(found, ':', 1)), '[\p{{L}}]{{4,}}')) AS m FROM k)
SELECT c_custkey, k::INT AS k, len(list_intersect(a, m)) >= 2 AND len(list_intersect(a, b)) >= 0.5 * len(a) AND len(list_intersect(a, m)) >= 0.6 * len(m) AND NOT (len(list_intersect(a, m)) = len(m) AND len(m) < len(a) AND len(list_intersect(a, b)) < len(a)) AS ok FROM x""",
)
def title_match(spark, sf_dir):
    """A title against four candidates: itself, its main part, a longer one and another."""
    name = F.concat("c_name", F.lit(" "), "c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, ": eine lange Geschichte").otherwise(""))
    rows = table(spark, sf_dir, "customer").select("c_custkey", name.alias("t"))
    found = F.array(F.col("t"), F.substring_index("t", ":", 1), F.concat(F.lit("Other "), "t"), F.lit("Customer eine"))
    rows = rows.select("c_custkey", "t", F.posexplode(found).alias("k", "f"))
    return rows.select("c_custkey", "k", N.titles_match(F.col("t"), F.col("f")).alias("ok"))


@query(
    "w17_tag_scoring",
    f"""WITH s AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS w FROM documents), g AS (SELECT DISTINCT lower(p_type) || '-' || replace(p_name, ' ', '-') AS tag FROM part),
x AS (SELECT tag, unnest(string_split(tag, '-')) AS w FROM g), n AS (SELECT tag, count(s.w) AS score FROM x LEFT JOIN s USING (w) GROUP BY tag)
SELECT tag, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, tag) AS k FROM n) WHERE k <= 30""",
)
def tag_scoring(spark, sf_dir):
    """The 30 tags that share most tokens with the source; ties by name."""
    words = docs(spark, sf_dir, "text").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)))).alias("w")).distinct()
    tags = table(spark, sf_dir, "part").select(F.concat_ws("-", F.lower("p_type"), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("tag")).distinct()
    toks = tags.select("tag", F.explode(F.split("tag", "-")).alias("w")).join(words.withColumn("hit", F.lit(1)), "w", "left")
    return toks.groupBy("tag").agg(F.count("hit").alias("score")).orderBy(F.col("score").desc(), "tag").limit(30)


@query(
    "w22_option_dedup",
    """WITH l AS (SELECT lower(p_brand) AS key, max(length(p_name)) AS n FROM part GROUP BY 1) SELECT key, max(p_name) AS label FROM part JOIN l ON key = lower(p_brand) AND n = length(p_name) GROUP BY key""",
)
def option_dedup(spark, sf_dir):
    """The longest label of each key; the greater of equally long ones."""
    rows = table(spark, sf_dir, "part").groupBy(F.lower("p_brand").alias("key"))
    return rows.agg(F.max(F.struct(F.char_length("p_name").alias("n"), "p_name")).alias("m")).select("key", F.col("m.p_name").alias("label"))


def sentence_rows(spark, sf_dir):
    """Every sentence of a text with its place; every third text ends with an anchor."""
    t = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 3 == 0, " (S. 5)").otherwise(""))
    return docs(spark, sf_dir, "source", "text").select("doc_id", "source", F.posexplode(T.sentences(t)).alias("pos", "s"))


_SENTENCES_SQL = f"""s AS (SELECT doc_id, source, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, source, {split_sql("text || CASE WHEN doc_id % 3 = 0 THEN ' (S. 5)' ELSE '' END")} AS l FROM documents))"""


@query("f3_sentence_key", f"WITH {_SENTENCES_SQL}" + r" SELECT doc_id, pos, lower(regexp_replace(regexp_replace(regexp_replace(s, '\(S\. \d+(-\d+)?\)', '', 'g'), '\s+', ' ', 'g'), '^ | $', '', 'g')) AS k FROM s")
def sentence_key(spark, sf_dir):
    """The key of every whole sentence."""
    bare = F.regexp_replace("s", r"\(S\. \d+(-\d+)?\)", "")
    return sentence_rows(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), F.lower(F.trim(F.regexp_replace(bare, r"\s+", " "))).alias("k"))


@query("f10_pdf_normalise", r'''SELECT doc_id, md5(trim(regexp_replace(translate(regexp_replace(text, '(\w)-\n(\w)', '\1\2', 'g'), '„“”', '"""'), '\s+', ' ', 'g'), ' ')) AS h FROM documents''')
def pdf_normalise(spark, sf_dir):
    """Hyphens at line ends join, quotes fold, white space collapses."""
    t = F.translate(F.regexp_replace("text", r"(\w)-\n(\w)", "$1$2"), "„“”", '"""')
    return docs(spark, sf_dir, "text").select("doc_id", F.md5(F.trim(F.regexp_replace(t, r"\s+", " "))).alias("h"))


@query("f14_strip_anchors", r"SELECT doc_id, regexp_replace(source || '. (S. ' || doc_id || ') x (S. 1-2)', '\s*\(S\. \d+(-\d+)?\)', '', 'g') AS t FROM documents")
def strip_anchors(spark, sf_dir):
    from folium.operators.render import strip_anchors as strip

    return docs(spark, sf_dir, "source").select("doc_id", strip(F.concat("source", F.lit(". (S. "), "doc_id", F.lit(") x (S. 1-2)"))).alias("t"))


@query("f36_language_sample", "SELECT doc_id, text[1:100] || text[greatest(1, n_chars // 2 - 50):greatest(1, n_chars // 2 - 50) + 99] || right(text, 100) AS s FROM documents")
def language_sample(spark, sf_dir):
    """Head, middle and tail of a text."""
    mid = F.expr("substring(text, int(greatest(1, n_chars div 2 - 50)), 100)")
    return docs(spark, sf_dir, "text", "n_chars").select("doc_id", F.concat(F.substring("text", 1, 100), mid, F.right("text", F.lit(100))).alias("s"))


@query("f68_cell_escape", r"SELECT page_id, replace(replace(replace(html, '\', '\\'), '|', '\|'), chr(10), ' ') AS c FROM pages")
def cell_escape(spark, sf_dir):
    """Whole pages as table cells."""
    return table(spark, sf_dir, "pages").select("page_id", N.table_cell(F.col("html")).alias("c"))


@query("u8_notes_union", "SELECT doc_id AS key FROM documents UNION SELECT item_id FROM benchmark UNION SELECT conv_id FROM conversations")
def notes_union(spark, sf_dir):
    key = lambda t, c: table(spark, sf_dir, t).select(F.col(c).alias("key"))
    return key("documents", "doc_id").union(key("benchmark", "item_id")).union(key("conversations", "conv_id")).distinct()


@query("a38_sibling_density", """WITH e AS (SELECT page_id, count(DISTINCT h) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS h FROM pages) GROUP BY 1)
SELECT count(*) AS pages, round(CAST(sum(n) AS DOUBLE) / (count(*) * (count(*) - 1) / 2.0), 6) AS density FROM e""")
def sibling_density(spark, sf_dir):
    """Distinct links over the possible pairs."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.size(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))).alias("n")).where("n > 0")
    n = F.count("*")
    return rows.agg(n.alias("pages"), F.round(F.sum("n") / (n * (n - 1) / 2.0), 6).alias("density"))


@query("a40_anchor_rate", f"WITH {_SENTENCES_SQL}" + r" SELECT source, round(avg(CASE WHEN regexp_matches(s, '\(S\. \d+(-\d+)?\)') THEN 1.0 ELSE 0.0 END), 6) AS rate FROM s GROUP BY source")
def anchor_rate(spark, sf_dir):
    """The share of a source's sentences with an anchor."""
    hit = F.when(F.col("s").rlike(r"\(S\. \d+(-\d+)?\)"), 1.0).otherwise(0.0)
    return sentence_rows(spark, sf_dir).groupBy("source").agg(F.round(F.avg(hit), 6).alias("rate"))


