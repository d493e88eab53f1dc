"""Row rules: predicates, labels, names and small parsers as expressions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folium.functions import text as T
from folium.plans.registry import Registry
from folium.sources.tables import table

QUERIES = Registry()
query = QUERIES.query


def part(spark, sf_dir):
    return table(spark, sf_dir, "part")


@query("p17_tag_schema", r"SELECT DISTINCT tag, regexp_full_match(tag, '[a-z0-9]+(-[a-z0-9]+)*(/[a-z0-9]+(-[a-z0-9]+)*){0,2}') AS ok FROM (SELECT lower(p_type) || '/' || replace(p_name, ' ', '-') || '/' || p_brand AS tag FROM part UNION ALL SELECT replace(p_name, ' ', '--') FROM part UNION ALL SELECT replace(p_name, ' ', '-') FROM part)")
def tag_schema(spark, sf_dir):
    """Kebab case, three levels at most, no double hyphen."""
    dash = lambda by: F.replace("p_name", F.lit(" "), F.lit(by))
    tags = F.explode(F.array(F.concat_ws("/", F.lower("p_type"), dash("-"), "p_brand"), dash("--"), dash("-")))
    rows = part(spark, sf_dir).select(tags.alias("tag")).distinct()
    return rows.select("tag", F.col("tag").rlike(r"^[a-z0-9]+(-[a-z0-9]+)*(/[a-z0-9]+(-[a-z0-9]+)*){0,2}$").alias("ok"))


@query("f118_csv_items", "SELECT p_partkey, list_filter(list_transform(string_split(' ' || p_name || ' ,, ' || p_brand || ' , ', ','), lambda x: trim(x, ' ')), lambda x: x <> '') AS items FROM part")
def csv_items(spark, sf_dir):
    line = F.concat(F.lit(" "), "p_name", F.lit(" ,, "), "p_brand", F.lit(" , "))
    return part(spark, sf_dir).select("p_partkey", T.csv_items(line).alias("items"))


@query("f119_null_word", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_name END AS v FROM part")
def null_word(spark, sf_dir):
    v = F.when(F.col("p_size") % 4 == 0, F.element_at(F.array(*map(F.lit, ["None", " - ", "null", ""])), (F.col("p_partkey") % 4 + 1).cast("int"))).otherwise(F.col("p_name"))
    return part(spark, sf_dir).select("p_partkey", T.null_word(v).alias("v"))


@query("f111_yaml_list", """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '[]' ELSE '["' || replace(p_name, '"', '\\"') || '", "' || p_brand || '"]' END AS y FROM part""")
def yaml_list(spark, sf_dir):
    items = F.when(F.col("p_size") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("p_name", "p_brand"))
    quoted = F.transform(items, lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('\\"')), F.lit('"')))
    return part(spark, sf_dir).select("p_partkey", F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]")).alias("y"))


@query(
    "s19_run_log",
    r"""WITH l AS (SELECT doc_id, '[' || source || '] ' || CASE WHEN n_chars % 3 = 0 THEN '→ Vault' WHEN n_chars % 3 = 1 THEN '→ Inbox (score ' || n_chars % 5 || ')' ELSE 'words: ' || n_chars END AS line FROM documents)
SELECT regexp_extract(line, '^\[(\w+)\]', 1) AS run, count(*) FILTER (WHERE contains(line, '→ Vault')) AS vault, count(*) FILTER (WHERE contains(line, '→ Inbox')) AS inbox,
  min(CAST(nullif(regexp_extract(line, 'words: (\d+)', 1), '') AS BIGINT)) AS words FROM l GROUP BY 1""",
)
def run_log(spark, sf_dir):
    """Routing lines and the least word count of each run's log."""
    n = F.col("n_chars") % 3
    tail = F.when(n == 0, "→ Vault").when(n == 1, F.concat(F.lit("→ Inbox (score "), F.col("n_chars") % 5, F.lit(")"))).otherwise(F.concat(F.lit("words: "), "n_chars"))
    lines = table(spark, sf_dir, "documents").select(F.concat(F.lit("["), "source", F.lit("] "), tail).alias("line"))
    hit = lambda w: F.count_if(F.contains("line", F.lit(w)))
    words = F.min(T.first_group(F.col("line"), r"words: (\d+)").cast("long"))
    return lines.groupBy(T.first_group(F.col("line"), r"^\[(\w+)\]").alias("run")).agg(hit("→ Vault").alias("vault"), hit("→ Inbox").alias("inbox"), words.alias("words"))


@query(
    "a33_repeat_routing",
    "SELECT source, count(*) FILTER (WHERE n_chars % 3 = 0) AS vault, count(*) FILTER (WHERE n_chars % 3 <> 0) AS inbox, min(n_chars % 3 = 0) = max(n_chars % 3 = 0) AS stable FROM documents GROUP BY source",
)
def repeat_routing(spark, sf_dir):
    v = F.col("n_chars") % 3 == 0
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(v).alias("vault"), F.count_if(~v).alias("inbox"), (F.bool_and(v) | ~F.bool_or(v)).alias("stable"))


@query(
    "j3_existence_join",
    """WITH k AS (SELECT doc_id, 0 AS pos, source || '-' || doc_id AS key FROM documents UNION ALL SELECT doc_id, 1, source || '-' || (doc_id + 1) FROM documents),
v AS (SELECT source || '-' || doc_id AS key, doc_id AS path FROM documents WHERE doc_id % 4 <> 0) SELECT doc_id, arg_min(path, pos) AS path FROM k JOIN v USING (key) GROUP BY doc_id""",
)
def existence_join(spark, sf_dir):
    """The title, then each alias: the first key that an eligible entry has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    key = lambda n: F.concat_ws("-", "source", n)
    keys = docs.select("doc_id", F.posexplode(F.array(key(F.col("doc_id")), key(F.col("doc_id") + 1))).alias("pos", "key"))
    vault = docs.where("doc_id % 4 <> 0").select(key(F.col("doc_id")).alias("key"), F.col("doc_id").alias("path"))
    return keys.join(vault, "key").groupBy("doc_id").agg(F.min_by("path", "pos").alias("path"))


@query("s57_insert_if_absent", "SELECT doc_id, 'new' AS origin FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'old' FROM labels")
def insert_if_absent(spark, sf_dir):
    old = table(spark, sf_dir, "labels").select("doc_id")
    new = table(spark, sf_dir, "documents").select("doc_id").join(old, "doc_id", "left_anti")
    return new.withColumn("origin", F.lit("new")).unionByName(old.withColumn("origin", F.lit("old")))


@query("u7_append_missing", "SELECT doc_id, quality, NULL::VARCHAR AS lang FROM labels UNION ALL SELECT doc_id, NULL, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def append_missing(spark, sf_dir):
    known = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rest = table(spark, sf_dir, "documents").select("doc_id", "lang").join(known.select("doc_id"), "doc_id", "left_anti")
    return known.unionByName(rest, allowMissingColumns=True)


@query(
    "p38_concept_cap",
    "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations) WHERE role <> 'user' OR k <= 2",
)
def concept_cap(spark, sf_dir):
    """The first two actionable rows (here: user turns) stay, others always do."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    k = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    return rows.withColumn("k", k).where("role <> 'user' or k <= 2").select("conv_id", "turn")
