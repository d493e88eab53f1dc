"""Single rates, rules and coefficients, each as a query of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from folium.functions import decision as D
from folium.functions import stats as S
from folium.functions import text as T
from folium.plans.evaluation import _DECIDED_SQL, _sql_rate, decided
from folium.plans.raters import _coefficients_sql, coefficients, rated
from folium.plans.registry import Registry
from folium.sources.claims import CLAIMS_SQL, RUNS_SQL, claims, runs
from folium.sources.tables import table

QUERIES = Registry()
query = QUERIES.query


def _count(*labels: str) -> str:
    return "count(*) FILTER (WHERE label IN (" + ", ".join(f"'{x}'" for x in labels) + "))"


def _note_rate(name: str, of: tuple, among: tuple):
    @query(name, f"WITH {_DECIDED_SQL} SELECT note, {_sql_rate(_count(*of), _count(*among))} AS rate FROM decided GROUP BY note")
    def rate(spark, sf_dir):
        n = lambda x: F.count_if(F.col("label").isin(*x))
        return decided(spark, sf_dir).groupBy("note").agg(S.guarded_rate(n(of), n(among)).alias("rate"))


_note_rate("a3_hallucination_rate", ("not_in_context", "contradicted"), tuple(D.NORMAL_LABELS))
_note_rate("a4_confirmed_rate", ("supported_exact", "supported_paraphrase"), tuple(D.NORMAL_LABELS))
_note_rate("a5_partial_rate", ("partially_supported",), tuple(D.NORMAL_LABELS))
_note_rate("a6_uncertain_rate", ("retrieval_or_parse_uncertain",), tuple(D.LABELS))
_note_rate("a7_parse_error_rate", ("parse_error",), tuple(D.LABELS))


@query("a2_guarded_rate", f"""WITH {RUNS_SQL} SELECT run_id, {_sql_rate("n_vault", "(n_total % 13)")} AS value, n_total % 13 <> 0 AS valid FROM runs""")
def guarded(spark, sf_dir):
    """A rate with a zero denominator is -1 and not valid."""
    m = S.metric(F.col("n_vault"), F.col("n_total") % 13)
    return runs(spark, sf_dir).select("run_id", m["value"].alias("value"), m["valid"].alias("valid"))


def _coefficient(name: str, column: str):
    @query(name, f"SELECT source, {column} FROM ({_coefficients_sql('source')})")
    def one(spark, sf_dir):
        return coefficients(rated(spark, sf_dir), "source").select("source", column)


_coefficient("a27_percent_agreement", "percent")
_coefficient("a28_cohen_kappa", "kappa")
_coefficient("a29_gwet_ac1", "ac1")
_coefficient("a30_krippendorff_alpha", "alpha")


@query("a26_average_agreement", f"WITH {RUNS_SQL} SELECT model, round(avg(rate) FILTER (WHERE rate >= 0) * 100, 1) AS mean FROM runs GROUP BY model")
def average_agreement(spark, sf_dir):
    """The mean of what was measured, null where nothing was."""
    known = F.when(F.col("rate") >= 0, F.col("rate"))
    return runs(spark, sf_dir).groupBy("model").agg(F.round(F.avg(known) * 100, 1).alias("mean"))


@query("f27_audit_override", f"WITH {_DECIDED_SQL} SELECT note, claim_idx, label FROM decided WHERE source = 'audit_override'")
def audit_override(spark, sf_dir):
    """Claims whose stricter audit label counts; system labels are never overridden."""
    rows = claims(spark, sf_dir)
    held = ~F.col("parse_failed") & (F.col("cosine") >= D.LOW_COSINE)
    label = D.downgraded(F.col("primary_label"), F.col("evidence"))
    return rows.where(held & D.overrides(F.col("audit_label"), label)).select("note", "claim_idx", F.col("audit_label").alias("label"))


@query("f28_parse_error_rule", f"WITH {CLAIMS_SQL} SELECT note, claim_idx, CASE WHEN parse_failed THEN 'parse_error' END AS label FROM claims")
def parse_error_rule(spark, sf_dir):
    return claims(spark, sf_dir).select("note", "claim_idx", D.parse_error_rule(F.col("parse_failed")).alias("label"))


@query("f29_low_cosine_rule", f"WITH {CLAIMS_SQL} SELECT note, claim_idx, CASE WHEN cosine < 0.4 THEN 'retrieval_or_parse_uncertain' END AS label FROM claims")
def low_cosine_rule(spark, sf_dir):
    return claims(spark, sf_dir).select("note", "claim_idx", D.low_cosine_rule(F.col("cosine")).alias("label"))


@query("p43_default_rule", f"""WITH {CLAIMS_SQL} SELECT note, claim_idx, primary_label AS label, CASE WHEN primary_label IN ('parse_error', 'retrieval_or_parse_uncertain') THEN 'system' ELSE 'primary' END AS source FROM claims""")
def default_rule(spark, sf_dir):
    d = D.default_rule(F.col("primary_label"))
    return claims(spark, sf_dir).select("note", "claim_idx", d["label"].alias("label"), d["source"].alias("source"))


@query("p44_valid_claims", f"WITH {_DECIDED_SQL} SELECT note, claim_idx FROM decided WHERE label NOT IN ('parse_error', 'retrieval_or_parse_uncertain')")
def valid_claims(spark, sf_dir):
    return decided(spark, sf_dir).where(~D.is_system(F.col("label"))).select("note", "claim_idx")


@query("f31_metric_keys", f"WITH {_DECIDED_SQL} SELECT DISTINCT label, label AS key FROM decided")
def metric_keys(spark, sf_dir):
    return decided(spark, sf_dir).select("label", D.metric_key(F.col("label")).alias("key")).distinct()


@query("u6_flag_union", f"""WITH {_DECIDED_SQL}, f AS (SELECT note, unnest(flags) AS x FROM decided UNION SELECT l_orderkey, 'call_retry' FROM lineitem WHERE l_linenumber = 7)
SELECT note, string_agg(DISTINCT x, ',' ORDER BY x) AS flags FROM f GROUP BY note""")
def flag_union(spark, sf_dir):
    """Flags of a note's claims and of its calls; a flag is one row per task before the exchange."""
    own = decided(spark, sf_dir).select("note", F.explode("flags").alias("x"))
    calls = table(spark, sf_dir, "lineitem").where("l_linenumber = 7").select(F.col("l_orderkey").alias("note"), F.lit("call_retry").alias("x"))
    # A note has as many distinct flags as there are flags, a dozen.
    return own.union(calls).distinct().groupBy("note").agg(F.array_join(F.array_sort(F.collect_set("x")), ",").alias("flags"))


@query("a35_routing_summary", "SELECT source, count(*) FILTER (WHERE n_chars >= 2000) AS vault, count(*) FILTER (WHERE n_chars BETWEEN 500 AND 1999) AS inbox, count(*) FILTER (WHERE n_chars < 500) AS unresolved FROM documents GROUP BY source")
def routing_summary(spark, sf_dir):
    return S.routing_summary(routed(spark, sf_dir), "source")


def routed(spark, sf_dir):
    """Drafts with their destination (here: by length)."""
    goes = F.when(F.col("n_chars") >= 2000, "vault").when(F.col("n_chars") >= 500, "inbox")
    return table(spark, sf_dir, "documents").select("doc_id", "source", goes.alias("destination"))


@query("a54_report_lines", """SELECT source, unnest(['Vault: ' || count(*) FILTER (WHERE n_chars >= 2000), 'Inbox: ' || count(*) FILTER (WHERE n_chars BETWEEN 500 AND 1999), 'Unresolved: ' || count(*) FILTER (WHERE n_chars < 500)]) AS line FROM documents GROUP BY source""")
def report_lines(spark, sf_dir):
    s = S.routing_summary(routed(spark, sf_dir), "source")
    lines = F.array(*[F.concat(F.lit(f"{k.title()}: "), k) for k in ("vault", "inbox", "unresolved")])
    return s.select("source", F.explode(lines).alias("line"))


@query("a55_acceptance_chart", f"""WITH {RUNS_SQL}, v AS (SELECT pdf, version, median(100.0 * n_vault / n_total) AS m FROM runs GROUP BY pdf, version),
l AS (SELECT pdf, arg_max(version, [CAST(split_part(version[2:], '.', 1) AS INT), CAST(split_part(version, '.', 2) AS INT), CAST(split_part(version, '.', 3) AS INT)]) AS version FROM v GROUP BY pdf)
SELECT pdf, version, round(m, 1) AS accept FROM v JOIN l USING (pdf, version)""")
def acceptance_chart(spark, sf_dir):
    """The median acceptance of each key's newest version."""
    per = runs(spark, sf_dir).groupBy("pdf", "version").agg(F.median(100.0 * F.col("n_vault") / F.col("n_total")).alias("m"))
    newest = per.groupBy("pdf").agg(F.max_by(F.struct("version", "m"), T.version_key(F.col("version"))).alias("r"))
    return newest.select("pdf", "r.version", F.round("r.m", 1).alias("accept"))


@query("a24_quality_by_version", f"""WITH {RUNS_SQL} SELECT version, round(avg(rate) * 100, 2) AS mean, round(median(rate) * 100, 2) AS median, round(CAST(sum(n_vault) AS DOUBLE) / sum(n_total) * 100, 2) AS pooled, count(*) AS n FROM runs WHERE rate >= 0 GROUP BY version""")
def quality_by_version(spark, sf_dir):
    rate = F.col("rate")
    rows = runs(spark, sf_dir).where(rate >= 0).groupBy("version")
    pooled = F.sum("n_vault") / F.sum("n_total") * 100
    return rows.agg(F.round(F.avg(rate) * 100, 2).alias("mean"), F.round(F.median(rate) * 100, 2).alias("median"), F.round(pooled, 2).alias("pooled"), F.count("*").alias("n"))


@query("w19_version_order", f"""WITH {RUNS_SQL} SELECT version, dense_rank() OVER (ORDER BY CAST(split_part(version[2:], '.', 1) AS INT), CAST(split_part(version, '.', 2) AS INT), CAST(split_part(version, '.', 3) AS INT)) AS place FROM (SELECT DISTINCT version FROM runs)""")
def version_order(spark, sf_dir):
    """Places of the (few) distinct versions by their numbers."""
    from pyspark.sql import Window

    place = F.dense_rank().over(Window.orderBy(T.version_key(F.col("version"))))
    return runs(spark, sf_dir).select("version").distinct().withColumn("place", place.cast("long"))


@query("a57_scatter_versioned", f"""WITH {RUNS_SQL} SELECT run_id, version, round(rate * 100, 1) AS x, round(100.0 * n_vault / n_total, 1) AS y,
  [CAST(split_part(version[2:], '.', 1) AS INT), CAST(split_part(version, '.', 2) AS INT), CAST(split_part(version, '.', 3) AS INT)] AS k FROM runs WHERE rate >= 0""")
def scatter_versioned(spark, sf_dir):
    rows = runs(spark, sf_dir).where("rate >= 0")
    y = F.round(100.0 * F.col("n_vault") / F.col("n_total"), 1)
    return rows.select("run_id", "version", F.round(F.col("rate") * 100, 1).alias("x"), y.alias("y"), T.version_key(F.col("version")).alias("k"))


@query("w31_runs_ordered", f"WITH {RUNS_SQL} SELECT run_id, row_number() OVER (PARTITION BY pdf ORDER BY ts, run_id) AS place FROM runs")
def runs_ordered(spark, sf_dir):
    """Runs of a key in time order: a place per key instead of one global sort."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("pdf").orderBy("ts", "run_id"))
    return runs(spark, sf_dir).select("run_id", place.cast("long").alias("place"))
