"""Version-over-version trends of pipeline runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folium.functions.text import version_key
from folium.plans.registry import Registry
from folium.sources.claims import RUNS_SQL, runs

QUERIES = Registry()
query = QUERIES.query

_KEY_SQL = "list_transform(regexp_extract_all({v}, '[0-9]+'), lambda x: CAST(x AS INTEGER))"
_KEYED_SQL = f"{RUNS_SQL}, vers AS (SELECT DISTINCT version, {_KEY_SQL.format(v='version')} AS k FROM runs)"


def versions(df: DataFrame) -> DataFrame:
    """Distinct versions with their sort key: a few rows, whatever the runs."""
    return df.select("version").where("version is not null").distinct().withColumn("k", version_key(F.col("version")))


def latest(df: DataFrame) -> DataFrame:
    """One row: the newest version."""
    return versions(df).agg(F.max_by("version", "k").alias("latest"))


def pct() -> F.Column:
    return F.round(100.0 * F.col("n_vault") / F.col("n_total"), 1)


_PCT_SQL = "round(100.0 * n_vault / n_total, 1)"


@query(
    "a10_kpi_trend",
    f"""WITH {RUNS_SQL} SELECT version, count(*) AS n, avg(rate) AS avg_rate, avg(duration) / 60.0 AS avg_dur_min,
  sum(CASE WHEN n_vault >= 10 THEN 1 ELSE 0 END) * 100.0 / count(*) AS accept_rate, sum(tokens) / 1e6 AS tokens_m FROM runs GROUP BY version""",
)
def kpi_trend(spark, sf_dir):
    return (
        runs(spark, sf_dir)
        .groupBy("version")
        .agg(
            F.count("*").alias("n"),
            F.avg("rate").alias("avg_rate"),
            (F.avg("duration") / 60.0).alias("avg_dur_min"),
            (F.count_if(F.col("n_vault") >= 10) * 100.0 / F.count("*")).alias("accept_rate"),
            (F.sum("tokens") / 1e6).alias("tokens_m"),
        )
    )


@query("w34_versions_in_order", f"WITH {_KEYED_SQL} SELECT version, row_number() OVER (ORDER BY k) AS pos FROM vers")
def versions_in_order(spark, sf_dir):
    return versions(runs(spark, sf_dir)).select("version", F.row_number().over(Window.orderBy("k")).cast("long").alias("pos"))


@query("w33_latest_version", f"WITH {_KEYED_SQL} SELECT arg_max(version, k) AS latest FROM vers")
def latest_version(spark, sf_dir):
    return latest(runs(spark, sf_dir))


@query(
    "w18_top_versions",
    f"""WITH {_KEYED_SQL}, c AS (SELECT version, k, count(*) AS n, row_number() OVER (ORDER BY k DESC) AS pos FROM runs JOIN vers USING (version) GROUP BY version, k)
SELECT version, n FROM (SELECT *, row_number() OVER (ORDER BY k DESC) AS r FROM c WHERE n >= 3 OR pos = 1) WHERE r <= 15""",
)
def top_versions(spark, sf_dir):
    """The newest 15 versions of three runs or more; the newest always counts."""
    rows = runs(spark, sf_dir).groupBy("version").agg(F.count("*").alias("n")).withColumn("k", version_key(F.col("version")))
    newest = Window.orderBy(F.col("k").desc())
    rows = rows.withColumn("pos", F.row_number().over(newest)).where((F.col("n") >= 3) | (F.col("pos") == 1))
    return rows.withColumn("r", F.row_number().over(newest)).where("r <= 15").select("version", "n")


@query(
    "w20_version_delta",
    f"""WITH {_KEYED_SQL}, a AS (SELECT version, k, avg(rate) FILTER (WHERE rate >= 0) AS m, count(*) FILTER (WHERE rate >= 0) AS n FROM runs JOIN vers USING (version) GROUP BY version, k)
SELECT version, round(m - lag(m) OVER (ORDER BY k), 4) AS delta, coalesce(n >= 20 AND lag(n) OVER (ORDER BY k) >= 20, false) AS reliable FROM a""",
)
def version_delta(spark, sf_dir):
    rated = F.col("rate") >= 0
    rows = runs(spark, sf_dir).groupBy("version").agg(F.avg(F.when(rated, F.col("rate"))).alias("m"), F.count_if(rated).alias("n"))
    w = Window.orderBy("k")  # one row per version
    return rows.withColumn("k", version_key(F.col("version"))).select(
        "version",
        F.round(F.col("m") - F.lag("m").over(w), 4).alias("delta"),
        F.coalesce((F.col("n") >= 20) & (F.lag("n").over(w) >= 20), F.lit(False)).alias("reliable"),
    )


@query(
    "w21_scaling_recency",
    f"""WITH {_KEYED_SQL}, r AS (SELECT version, dense_rank() OVER (ORDER BY k DESC) <= 10 AS recent FROM vers)
SELECT run_id, version, words, n_total, recent FROM runs JOIN r USING (version)""",
)
def scaling_recency(spark, sf_dir):
    df = runs(spark, sf_dir)
    flagged = versions(df).select("version", (F.dense_rank().over(Window.orderBy(F.col("k").desc())) <= 10).alias("recent"))
    return df.join(flagged, "version").select("run_id", "version", "words", "n_total", "recent")


@query(
    "a12_pooled_rate",
    f"""WITH {RUNS_SQL} SELECT version, CASE WHEN count(*) FILTER (WHERE rate >= 0) = 0 THEN NULL
  WHEN bool_and(tokens % 10 <> 0) FILTER (WHERE rate >= 0) AND sum(n_total) FILTER (WHERE rate >= 0) > 0
  THEN round(CAST(sum(n_vault) FILTER (WHERE rate >= 0) AS DOUBLE) / sum(n_total) FILTER (WHERE rate >= 0) * 100, 1)
  ELSE round(avg(rate) FILTER (WHERE rate >= 0) * 100, 1) END AS pooled FROM runs GROUP BY version""",
)
def pooled_rate(spark, sf_dir):
    """Counts pool only if every rated row has them (here: tokens not a multiple of ten)."""
    rated = runs(spark, sf_dir).where("rate >= 0")
    pooled = rated.groupBy("version").agg(
        F.when(
            F.bool_and(F.col("tokens") % 10 != 0) & (F.sum("n_total") > 0), F.round(F.sum("n_vault") / F.sum("n_total") * 100, 1)
        )
        .otherwise(F.round(F.avg("rate") * 100, 1))
        .alias("pooled")
    )
    return versions(runs(spark, sf_dir)).select("version").join(pooled, "version", "left")


@query(
    "a13_kpi_bundle",
    f"""WITH {_KEYED_SQL}, cur AS (SELECT * FROM runs WHERE version = (SELECT arg_max(version, k) FROM vers))
SELECT (SELECT arg_max(version, k) FROM vers) AS latest, (SELECT count(*) FROM runs) AS n_runs, count(*) AS n_latest,
  round(CAST(sum(n_vault) AS DOUBLE) / sum(n_total) * 100, 1) AS accept_pct, median(rate) FILTER (WHERE rate >= 0) AS median_rate FROM cur""",
)
def kpi_bundle(spark, sf_dir):
    df = runs(spark, sf_dir)
    newest = F.broadcast(latest(df))  # one row
    scope = df.join(newest, F.col("version") == F.col("latest"))
    kpis = scope.groupBy("latest").agg(
        F.count("*").alias("n_latest"),
        F.round(F.sum("n_vault") / F.sum("n_total") * 100, 1).alias("accept_pct"),
        F.median(F.when(F.col("rate") >= 0, F.col("rate"))).alias("median_rate"),
    )
    return kpis.crossJoin(F.broadcast(df.agg(F.count("*").alias("n_runs"))))  # one row each


@query(
    "a14_per_pdf",
    f"""WITH {_KEYED_SQL}, n AS (SELECT pdf, max(k) AS k FROM runs JOIN vers USING (version) GROUP BY pdf),
cur AS (SELECT runs.*, n.k FROM runs JOIN vers USING (version) JOIN n ON n.pdf = runs.pdf AND n.k = vers.k)
SELECT pdf, any_value(version) AS version, median({_PCT_SQL}) AS median_pct, avg(duration) AS avg_duration, median(words) AS median_words FROM cur GROUP BY pdf""",
)
def per_pdf(spark, sf_dir):
    """Each PDF at its newest version. A hot PDF's rows never meet in one window."""
    df = runs(spark, sf_dir).withColumn("k", version_key(F.col("version")))
    newest = df.groupBy("pdf").agg(F.max("k").alias("k"))
    return (
        df.join(newest, ["pdf", "k"])
        .groupBy("pdf")
        .agg(
            F.max("version").alias("version"),
            F.median(pct()).alias("median_pct"),
            F.avg("duration").alias("avg_duration"),
            F.median("words").alias("median_words"),
        )
    )


@query("a15_median", f"WITH {RUNS_SQL} SELECT version, median({_PCT_SQL}) AS med FROM runs GROUP BY version")
def interpolated_median(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("version").agg(F.median(pct()).alias("med"))


@query(
    "a16_tokens_by_version",
    f"WITH {RUNS_SQL} SELECT version, CAST(sum(tokens) AS BIGINT) AS tokens, median(duration) AS med_duration FROM runs WHERE NOT starts_with(version, 'v4.1.') GROUP BY version",
)
def tokens_by_version(spark, sf_dir):
    """Versions of the excluded prefix do not count."""
    df = runs(spark, sf_dir).where(~F.startswith(F.col("version"), F.lit("v4.1.")))
    return df.groupBy("version").agg(F.sum("tokens").alias("tokens"), F.median("duration").alias("med_duration"))


_MONTHS = [f"v4.{m}.0" for m in range(1, 13)]


@query(
    "a18_longitudinal_matrix",
    f"WITH {RUNS_SQL} SELECT pdf, " + ", ".join(f"median({_PCT_SQL}) FILTER (WHERE version = '{v}') AS {v.replace('.', '_')}" for v in _MONTHS) + " FROM runs GROUP BY pdf",
)
def longitudinal_matrix(spark, sf_dir):
    """Median acceptance per PDF and release; a gap is null."""
    cells = [F.median(F.when(F.col("version") == v, pct())).alias(v.replace(".", "_")) for v in _MONTHS]
    return runs(spark, sf_dir).groupBy("pdf").agg(*cells)


@query(
    "a17_quality_slope",
    f"WITH {RUNS_SQL} SELECT pdf, version, median({_PCT_SQL}) AS med, CAST(sum(tokens) AS BIGINT) AS tokens FROM runs GROUP BY pdf, version",
)
def quality_slope(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("pdf", "version").agg(F.median(pct()).alias("med"), F.sum("tokens").alias("tokens"))


@query(
    "a23_runs_by_version",
    f"WITH {RUNS_SQL} SELECT version, count(*) AS n, CAST(sum(n_vault) AS BIGINT) AS n_vault, list_sort(list(DISTINCT pdf)) AS pdfs FROM runs GROUP BY version",
)
def runs_by_version(spark, sf_dir):
    return (
        runs(spark, sf_dir)
        .groupBy("version")
        .agg(F.count("*").alias("n"), F.sum("n_vault").alias("n_vault"), F.array_sort(F.collect_set("pdf")).alias("pdfs"))
    )


@query(
    "a51_log_nesting",
    f"WITH {RUNS_SQL} SELECT pdf, version, {_PCT_SQL} AS pct, count(*) AS n FROM runs GROUP BY ALL",
)
def log_nesting(spark, sf_dir):
    """Acceptance values per key and version, each with its number: no list grows with the runs."""
    return runs(spark, sf_dir).groupBy("pdf", "version", pct().alias("pct")).agg(F.count("*").alias("n"))


@query(
    "s23_run_upsert",
    f"""WITH {RUNS_SQL} SELECT pdf, arg_max(run_id, run_id) AS run_id, arg_max(version, run_id) AS version,
  arg_max(tokens = 0 AND duration > 0, run_id) AS fully_cached FROM runs GROUP BY pdf""",
)
def run_upsert(spark, sf_dir):
    """The last row of a key wins: a grouped maximum, combined before the shuffle."""
    row = F.struct("version", ((F.col("tokens") == 0) & (F.col("duration") > 0)).alias("fully_cached"))
    return (
        runs(spark, sf_dir)
        .groupBy("pdf")
        .agg(F.max("run_id").alias("run_id"), F.max_by(row, "run_id").alias("r"))
        .select("pdf", "run_id", "r.version", "r.fully_cached")
    )


@query(
    "p29_history_filter",
    f"WITH {RUNS_SQL} SELECT run_id, version FROM runs WHERE contains(lower(model), 'low') AND version = 'v4.6.0'",
)
def history_filter(spark, sf_dir):
    df = runs(spark, sf_dir).where(F.contains(F.lower("model"), F.lit("low")) & (F.col("version") == "v4.6.0"))
    return df.select("run_id", "version")


@query(
    "a52_weighted_totals",
    f"""WITH {RUNS_SQL} SELECT CAST(sum(n_total) AS BIGINT) AS total, CAST(sum(n_vault) AS BIGINT) AS vault,
  CAST(sum(n_vault) AS DOUBLE) / sum(n_total) AS ratio FROM runs""",
)
def weighted_totals(spark, sf_dir):
    return runs(spark, sf_dir).agg(
        F.sum("n_total").alias("total"), F.sum("n_vault").alias("vault"), (F.sum("n_vault") / F.sum("n_total")).alias("ratio")
    )


@query(
    "a34_repeat_summary",
    f"""WITH {RUNS_SQL} SELECT pdf, median(n_vault) AS med, avg(n_vault) AS mean, coalesce(stddev_samp(n_vault), 0) AS sd,
  min(n_vault) AS lo, max(n_vault) AS hi, count(DISTINCT n_vault) = 1 AS stable FROM runs GROUP BY pdf""",
)
def repeat_summary(spark, sf_dir):
    return (
        runs(spark, sf_dir)
        .groupBy("pdf")
        .agg(
            F.median("n_vault").alias("med"),
            F.avg("n_vault").alias("mean"),
            F.coalesce(F.stddev_samp("n_vault"), F.lit(0.0)).alias("sd"),
            F.min("n_vault").alias("lo"),
            F.max("n_vault").alias("hi"),
            (F.min("n_vault") == F.max("n_vault")).alias("stable"),
        )
    )


@query(
    "j28_paired_diff",
    f"""WITH {RUNS_SQL}, p AS (SELECT pdf, max(n_vault) FILTER (WHERE model = '1-URGENT') AS a, max(n_vault) FILTER (WHERE model = '5-LOW') AS b FROM runs GROUP BY pdf)
SELECT pdf, a, b FROM p WHERE a IS DISTINCT FROM b""",
)
def paired_diff(spark, sf_dir):
    """Keys whose two configurations differ; a side that is missing differs."""
    side = lambda m: F.max(F.when(F.col("model") == m, F.col("n_vault")))
    rows = runs(spark, sf_dir).groupBy("pdf").agg(side("1-URGENT").alias("a"), side("5-LOW").alias("b"))
    return rows.where(~F.col("a").eqNullSafe(F.col("b")))


@query(
    "j18_label_worklist",
    """WITH l AS (SELECT doc_id, d.n_chars, quality FROM documents d LEFT JOIN labels USING (doc_id))
SELECT doc_id, quality IS NOT NULL AS labelled, n_chars FROM l""",
)
def label_worklist(spark, sf_dir):
    """Unlabelled rows first, then the longest; one order, no window over all rows."""
    from folium.sources.tables import table

    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(
        table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left"
    )
    return rows.select("doc_id", F.col("quality").isNotNull().alias("labelled"), "n_chars").orderBy(
        "labelled", F.col("n_chars").desc_nulls_last()
    )
