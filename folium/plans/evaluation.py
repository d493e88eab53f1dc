"""Claim decisions and note-level aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.functions import decision as D
from folium.functions.stats import guarded_rate, wilson
from folium.plans.registry import Registry
from folium.sources.claims import CLAIMS_SQL, claims

QUERIES = Registry()
query = QUERIES.query

_DECIDED_SQL = f"""{CLAIMS_SQL},
down AS (SELECT *, CASE WHEN evidence = false AND primary_label = 'supported_exact' THEN 'not_in_context'
    WHEN evidence = false AND primary_label = 'supported_paraphrase' THEN 'partially_supported' ELSE primary_label END AS lab,
  CASE WHEN evidence = false AND primary_label = 'supported_exact' THEN ['evidence_fabricated', 'evidence_unverified']
    WHEN evidence = false AND primary_label = 'supported_paraphrase' THEN ['evidence_unverified'] ELSE [] END AS ef FROM claims),
rank(l, r) AS (VALUES ('supported_exact', 0), ('supported_paraphrase', 1), ('partially_supported', 2), ('not_in_context', 3), ('contradicted', 4)),
ranked AS (SELECT down.*, a.r AS ar, b.r AS br FROM down LEFT JOIN rank a ON a.l = audit_label LEFT JOIN rank b ON b.l = lab),
decided AS (SELECT note, claim_idx, primary_label, cosine, claim,
  CASE WHEN parse_failed THEN 'parse_error' WHEN cosine < 0.4 THEN 'retrieval_or_parse_uncertain'
    WHEN audit_label IS NOT NULL AND ar > br THEN audit_label ELSE lab END AS label,
  CASE WHEN parse_failed THEN ['parse_error'] WHEN cosine < 0.4 THEN ['retrieval_low_cosine']
    WHEN audit_label IS NULL OR audit_label = lab THEN ef
    WHEN ar IS NULL OR br IS NULL THEN list_sort(list_concat(ef, ['audit_disagrees_with_system']))
    WHEN ar > br THEN list_sort(list_concat(ef, ['audit_overridden', 'judge_uneinig']))
    ELSE list_sort(list_concat(ef, ['audit_disagrees_softer'])) END AS flags,
  CASE WHEN parse_failed OR cosine < 0.4 THEN 'system'
    WHEN audit_label IS NOT NULL AND ar > br THEN 'audit_override'
    WHEN br IS NULL THEN 'system' ELSE 'primary' END AS source FROM ranked)"""


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = D.decide(F.col("primary_label"), F.col("audit_label"), F.col("cosine"), F.col("evidence"), F.col("parse_failed"))
    return claims(spark, sf_dir).withColumn("d", row).select("note", "claim_idx", "primary_label", "cosine", "claim", "d.*")


@query(
    "f25_decision_engine",
    f"WITH {_DECIDED_SQL} SELECT note, claim_idx, label, array_to_string(flags, ',') AS flags, source FROM decided",
)
def decision_engine(spark, sf_dir):
    return decided(spark, sf_dir).select("note", "claim_idx", "label", F.array_join("flags", ",").alias("flags"), "source")


@query(
    "f26_evidence_downgrade",
    f"""WITH {CLAIMS_SQL} SELECT note, claim_idx, CASE WHEN evidence = false AND primary_label = 'supported_exact' THEN 'not_in_context'
  WHEN evidence = false AND primary_label = 'supported_paraphrase' THEN 'partially_supported' ELSE primary_label END AS label FROM claims""",
)
def evidence_downgrade(spark, sf_dir):
    return claims(spark, sf_dir).select("note", "claim_idx", D.downgraded(F.col("primary_label"), F.col("evidence")).alias("label"))


@query(
    "f30_input_quarantine",
    f"""WITH {CLAIMS_SQL} SELECT note, claim_idx, NOT (parse_failed AND evidence IS NOT NULL) AND cosine BETWEEN 0 AND 1 AS valid FROM claims""",
)
def input_quarantine(spark, sf_dir):
    ok = D.valid_input(F.col("primary_label"), F.col("cosine"), F.col("evidence"), F.col("parse_failed"))
    return claims(spark, sf_dir).select("note", "claim_idx", ok.alias("valid"))


@query("a1_label_counts", f"WITH {_DECIDED_SQL} SELECT " + ", ".join(f"count(*) FILTER (WHERE label = '{x}') AS n_{x}" for x in D.LABELS) + " FROM decided")
def label_counts(spark, sf_dir):
    return decided(spark, sf_dir).agg(*[F.count_if(F.col("label") == x).alias(f"n_{x}") for x in D.LABELS])


_VALID = "count(*) FILTER (WHERE label NOT IN ('parse_error', 'retrieval_or_parse_uncertain'))"


def _sql_rate(n: str, d: str) -> str:
    return f"CASE WHEN {d} = 0 THEN -1.0 ELSE round_even(CAST({n} AS DOUBLE) / {d}, 3) END"


@query(
    "a8_claim_aggregate",
    f"""WITH {_DECIDED_SQL} SELECT note, count(*) AS n_claims, {_VALID} AS n_valid,
  {_sql_rate("count(*) FILTER (WHERE label IN ('not_in_context', 'contradicted'))", _VALID)} AS hallucination_rate,
  {_sql_rate("count(*) FILTER (WHERE label IN ('supported_exact', 'supported_paraphrase'))", _VALID)} AS confirmed_rate,
  {_sql_rate("count(*) FILTER (WHERE label = 'partially_supported')", _VALID)} AS partial_rate,
  {_sql_rate("count(*) FILTER (WHERE label = 'retrieval_or_parse_uncertain')", "count(*)")} AS uncertain_rate,
  {_sql_rate("count(*) FILTER (WHERE label = 'parse_error')", "count(*)")} AS parse_error_rate
FROM decided GROUP BY note""",
)
def claim_aggregate(spark, sf_dir):
    """Rates of a note; unmeasurable ones are -1."""
    label = F.col("label")
    n = lambda *x: F.count_if(label.isin(*x))
    valid = n(*D.NORMAL_LABELS)
    return (
        decided(spark, sf_dir)
        .groupBy("note")
        .agg(
            F.count("*").alias("n_claims"),
            valid.alias("n_valid"),
            guarded_rate(n("not_in_context", "contradicted"), valid).alias("hallucination_rate"),
            guarded_rate(n("supported_exact", "supported_paraphrase"), valid).alias("confirmed_rate"),
            guarded_rate(n("partially_supported"), valid).alias("partial_rate"),
            guarded_rate(n("retrieval_or_parse_uncertain"), F.count("*")).alias("uncertain_rate"),
            guarded_rate(n("parse_error"), F.count("*")).alias("parse_error_rate"),
        )
    )


@query(
    "a9_note_aggregate",
    f"""WITH {_DECIDED_SQL}, f AS (SELECT note, string_agg(DISTINCT x, ',' ORDER BY x) AS flags FROM (SELECT note, unnest(flags) AS x FROM decided) GROUP BY note),
n AS (SELECT note, count(*) AS n, count(*) FILTER (WHERE label = 'parse_error') AS bad, count(*) FILTER (WHERE label IN ('not_in_context', 'contradicted')) AS h FROM decided GROUP BY note)
SELECT n.note, n AS n_claims, coalesce(flags, '') AS flags, bad >= ceil(greatest(3.0, 0.3 * n)) AS parse_gate,
  greatest(0.0, round((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n), 3)) AS ci_lo,
  least(1.0, round((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n), 3)) AS ci_hi
FROM (SELECT *, CAST(h AS DOUBLE) / n AS p FROM n) n LEFT JOIN f USING (note)""",
)
def note_aggregate(spark, sf_dir):
    """Flags of a note united, its parse-error gate and the Wilson interval of its rate."""
    rows = (
        decided(spark, sf_dir)
        .groupBy("note")
        .agg(
            F.count("*").alias("n_claims"),
            F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("flags")))), ",").alias("flags"),
            F.count_if(F.col("label") == "parse_error").alias("bad"),
            F.count_if(F.col("label").isin("not_in_context", "contradicted")).alias("h"),
        )
    )
    ci = wilson(F.col("h"), F.col("n_claims"))
    gate = F.col("bad") >= F.ceil(F.greatest(F.lit(3.0), 0.3 * F.col("n_claims")))
    return rows.select("note", "n_claims", "flags", gate.alias("parse_gate"), ci["lo"].alias("ci_lo"), ci["hi"].alias("ci_hi"))


@query(
    "p34_presence_flag",
    f"""WITH {_DECIDED_SQL} SELECT note, claim_idx, array_to_string(CASE WHEN label = 'not_in_context' AND cosine >= 0.75
  THEN list_sort(list_distinct(list_append(flags, 'possible_retrieval_miss'))) ELSE flags END, ',') AS flags FROM decided""",
)
def presence_flag(spark, sf_dir):
    miss = (F.col("label") == "not_in_context") & (F.col("cosine") >= D.PRESENCE_COSINE)
    flags = F.when(miss, F.array_sort(F.array_union("flags", F.array(F.lit("possible_retrieval_miss"))))).otherwise(F.col("flags"))
    return decided(spark, sf_dir).select("note", "claim_idx", F.array_join(flags, ",").alias("flags"))


@query(
    "w23_audit_sample",
    f"""WITH {_DECIDED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY note, label ORDER BY sha256(note || '|' || claim), claim_idx, flags) AS k, count(*) OVER (PARTITION BY note, label) AS n FROM decided)
SELECT note, claim_idx, label FROM r WHERE cosine < 0.4 OR list_contains(flags, 'evidence_unverified') OR k <= greatest(1, ceil(0.02 * n))""",
)
def audit_sample(spark, sf_dir):
    """Claims of a note that are audited: those of low cosine or unverified evidence, and two per
    cent of each label, one at least, in the order of a hash of note and claim."""
    return D.audited(decided(spark, sf_dir), "note").select("note", "claim_idx", "label")


@query("f22_wilson_interval", """WITH c AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS h FROM documents JOIN labels USING (doc_id) GROUP BY lang)
SELECT lang, greatest(0.0, round((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n), 3)) AS lo,
  least(1.0, round((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n), 3)) AS hi
FROM (SELECT *, CAST(h AS DOUBLE) / n AS p FROM c)""")
def wilson_interval(spark, sf_dir):
    from folium.sources.tables import table

    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("h"))
    return rows.select("lang", wilson(F.col("h"), F.col("n")).alias("w")).select("lang", "w.lo", "w.hi")
