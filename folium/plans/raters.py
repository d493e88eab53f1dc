"""Agreement of two raters, and calibration samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folium.functions.stats import agreement
from folium.plans.registry import Registry
from folium.sources.tables import table

QUERIES = Registry()
query = QUERIES.query
CATEGORIES = ["s", "h", "?"]

_RATED_SQL = """rated AS (SELECT doc_id, lang, source, CASE WHEN quality = 1 THEN 's' WHEN doc_id % 5 = 0 THEN '?' ELSE 'h' END AS a,
  CASE WHEN toxic = 0 THEN 's' WHEN doc_id % 3 = 0 THEN '?' ELSE 'h' END AS b FROM documents JOIN labels USING (doc_id))"""


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two raters' verdicts on the labelled documents."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    other = lambda m: F.when(F.col("doc_id") % m == 0, "?").otherwise("h")
    return rows.select(
        "doc_id",
        "lang",
        "source",
        F.when(F.col("quality") == 1, "s").otherwise(other(5)).alias("a"),
        F.when(F.col("toxic") == 0, "s").otherwise(other(3)).alias("b"),
    )


def coefficients(rows: DataFrame, *keys: str) -> DataFrame:
    """All coefficients in one aggregation: counts per category, then closed forms."""
    of = lambda c, k: F.count_if(F.col(c) == k)
    value = agreement(
        F.count("*"), F.count_if(F.col("a") == F.col("b")), [of("a", k) for k in CATEGORIES], [of("b", k) for k in CATEGORIES]
    )
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), value.alias("v")).select(*keys, "n", "v.*")


def _coefficients_sql(keys: str) -> str:
    return f"""WITH {_RATED_SQL}, c AS (SELECT {keys}, count(*) AS n, CAST(count(*) FILTER (WHERE a = b) AS DOUBLE) / count(*) AS po,
  [count(*) FILTER (WHERE a = 's'), count(*) FILTER (WHERE a = 'h'), count(*) FILTER (WHERE a = '?')] AS x,
  [count(*) FILTER (WHERE b = 's'), count(*) FILTER (WHERE b = 'h'), count(*) FILTER (WHERE b = '?')] AS y FROM rated GROUP BY {keys}),
e AS (SELECT *, CAST(x[1] AS DOUBLE) / n * y[1] / n + CAST(x[2] AS DOUBLE) / n * y[2] / n + CAST(x[3] AS DOUBLE) / n * y[3] / n AS pe,
  ((x[1] + y[1]) / (2.0 * n) * (1 - (x[1] + y[1]) / (2.0 * n)) + (x[2] + y[2]) / (2.0 * n) * (1 - (x[2] + y[2]) / (2.0 * n)) + (x[3] + y[3]) / (2.0 * n) * (1 - (x[3] + y[3]) / (2.0 * n))) / 2 AS pg,
  (4.0 * n * n - (x[1] + y[1]) * (x[1] + y[1]) - (x[2] + y[2]) * (x[2] + y[2]) - (x[3] + y[3]) * (x[3] + y[3])) / (2.0 * n * (2.0 * n - 1)) AS de FROM c)
SELECT {keys}, n, po AS percent, CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END AS kappa, CASE WHEN pg < 1 THEN (po - pg) / (1 - pg) END AS ac1,
  CASE WHEN de = 0 THEN 1.0 ELSE 1 - (1 - po) / de END AS alpha FROM e"""


@query("a50_agreement_report", _coefficients_sql("lang"))
def agreement_report(spark, sf_dir):
    """Percent agreement, Cohen's kappa, Gwet's AC1 and Krippendorff's alpha per language."""
    return coefficients(rated(spark, sf_dir), "lang")


@query("a60_metric_table", _coefficients_sql("'all'").replace("SELECT 'all', n", "SELECT n").replace("SELECT 'all', count", "SELECT count"))
def metric_table(spark, sf_dir):
    return coefficients(rated(spark, sf_dir))


@query(
    "a31_confusion_matrix",
    f"WITH {_RATED_SQL}, g AS (SELECT unnest(['s', 'h', '?']) AS a) SELECT g.a, "
    + ", ".join(f"count(*) FILTER (WHERE b = '{k}') AS {n}" for k, n in zip("sh?", ["n_s", "n_h", "n_q"], strict=True))
    + " FROM g LEFT JOIN rated USING (a) GROUP BY g.a",
)
def confusion_matrix(spark, sf_dir):
    names = dict(zip(CATEGORIES, ["n_s", "n_h", "n_q"], strict=True))
    grid = spark.createDataFrame([(k,) for k in CATEGORIES], "a string")
    counts = rated(spark, sf_dir).groupBy("a").agg(*[F.count_if(F.col("b") == k).alias(n) for k, n in names.items()])
    return grid.join(counts, "a", "left").fillna(0)


@query(
    "a32_confusion_totals",
    f"WITH {_RATED_SQL} SELECT coalesce(a, 'all') AS a, coalesce(b, 'all') AS b, count(*) AS n FROM rated GROUP BY CUBE (a, b)",
)
def confusion_totals(spark, sf_dir):
    cube = rated(spark, sf_dir).cube("a", "b").agg(F.count("*").alias("n"))
    return cube.select(F.coalesce("a", F.lit("all")).alias("a"), F.coalesce("b", F.lit("all")).alias("b"), "n")


@query(
    "j15_label_join",
    f"""WITH {_RATED_SQL} SELECT source, round(avg(CASE WHEN h.a = p.b THEN 1.0 ELSE 0.0 END), 4) AS agreement
FROM (SELECT source, doc_id, a FROM rated WHERE doc_id % 2 = 0) h JOIN (SELECT doc_id, b FROM rated WHERE doc_id % 3 = 0) p USING (doc_id) GROUP BY source""",
)
def label_join(spark, sf_dir):
    """Share of equal verdicts on the keys that both sides have."""
    rows = rated(spark, sf_dir)
    human = rows.where("doc_id % 2 = 0").select("source", "doc_id", "a")
    pipeline = rows.where("doc_id % 3 = 0").select("doc_id", "b")
    same = F.avg(F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0))
    return human.join(pipeline, "doc_id").groupBy("source").agg(F.round(same, 4).alias("agreement"))


@query(
    "u2_three_way_keys",
    f"""WITH {_RATED_SQL} SELECT doc_id FROM rated WHERE doc_id % 2 = 0 INTERSECT SELECT doc_id FROM rated WHERE a = 's' INTERSECT SELECT doc_id FROM rated WHERE b = 's'""",
)
def three_way_keys(spark, sf_dir):
    keys = lambda cond: rated(spark, sf_dir).where(cond).select("doc_id")
    return keys("doc_id % 2 = 0").intersect(keys("a = 's'")).intersect(keys("b = 's'"))


@query("u3_missing_claims", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def missing_claims(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id").distinct()
    return docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query(
    "p37_claim_completeness",
    """SELECT count(*) FILTER (WHERE l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL) AS both_sides,
  count(*) FILTER (WHERE l.doc_id IS NULL) AS only_documents, count(*) FILTER (WHERE d.doc_id IS NULL) AS only_labels
FROM documents d FULL JOIN (SELECT * FROM labels WHERE quality = 1) l ON d.doc_id = l.doc_id""",
)
def claim_completeness(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"))
    lab = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("l"))
    j = d.join(lab, F.col("d") == F.col("l"), "full")
    return j.agg(
        F.count_if(F.col("l").isNotNull() & F.col("d").isNotNull()).alias("both_sides"),
        F.count_if(F.col("l").isNull()).alias("only_documents"),
        F.count_if(F.col("d").isNull()).alias("only_labels"),
    )


@query(
    "w24_stratified_sample",
    """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('42|' || doc_id), doc_id) AS k FROM documents)
SELECT doc_id, lang FROM r WHERE k <= 15""",
)
def stratified_sample(spark, sf_dir):
    """15 rows of each stratum by seeded hash; each task keeps 15 a stratum before the shuffle."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang")
    h = F.sha2(F.concat(F.lit("42|"), F.col("doc_id")), 256)
    rows = rows.withColumn("h", h)
    # Spark turns the rank filter into a top-k per task ahead of the exchange.
    k = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    return rows.withColumn("k", k).where("k <= 15").select("doc_id", "lang")


@query(
    "a49_calibration_collect",
    f"""WITH {_RATED_SQL} SELECT source, count(*) FILTER (WHERE a = 's') AS n_s, count(*) FILTER (WHERE a = 'h') AS n_h, count(*) FILTER (WHERE a = '?') AS n_q,
  round(CAST(count(*) FILTER (WHERE a = 'h') AS DOUBLE) / nullif(count(*) FILTER (WHERE a <> '?'), 0), 4) AS human_rate,
  round(avg(CASE WHEN b = 'h' THEN 1.0 ELSE 0.0 END), 4) AS pipeline_rate FROM rated GROUP BY source""",
)
def calibration_collect(spark, sf_dir):
    n = lambda k: F.count_if(F.col("a") == k)
    return (
        rated(spark, sf_dir)
        .groupBy("source")
        .agg(
            n("s").alias("n_s"),
            n("h").alias("n_h"),
            n("?").alias("n_q"),
            F.round(n("h") / F.nullif(F.count_if(F.col("a") != "?"), F.lit(0)), 4).alias("human_rate"),
            F.round(F.avg(F.when(F.col("b") == "h", 1.0).otherwise(0.0)), 4).alias("pipeline_rate"),
        )
    )
