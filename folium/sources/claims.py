"""Views of the driver tables in the shapes that evaluation plans read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.functions.decision import LABELS
from folium.sources.tables import table


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged claims: note, claim_idx, primary, audit, cosine, evidence, parse_failed."""
    label = lambda i: F.element_at(F.array(*map(F.lit, LABELS)), (i + 1).cast("int"))
    audit = F.pmod(F.col("l_suppkey"), F.lit(9))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("note"),
        F.col("l_linenumber").alias("claim_idx"),
        label(F.pmod(F.col("l_partkey"), F.lit(7))).alias("primary_label"),
        F.when(audit < 7, label(F.least(audit, F.lit(6)))).alias("audit_label"),
        (F.col("l_discount") * 10).alias("cosine"),
        F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "R", False).alias("evidence"),
        (F.pmod(F.col("l_partkey"), F.lit(7)) == 5).alias("parse_failed"),
        F.concat_ws(" ", "l_partkey", "l_suppkey", "l_returnflag").alias("claim"),
    )


CLAIMS_SQL = """claims AS (SELECT l_orderkey AS note, l_linenumber AS claim_idx,
  ['supported_exact','supported_paraphrase','partially_supported','not_in_context','contradicted','parse_error','retrieval_or_parse_uncertain'][l_partkey % 7 + 1] AS primary_label,
  CASE WHEN l_suppkey % 9 < 7 THEN ['supported_exact','supported_paraphrase','partially_supported','not_in_context','contradicted','parse_error','retrieval_or_parse_uncertain'][l_suppkey % 9 + 1] END AS audit_label,
  l_discount * 10 AS cosine, CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END AS evidence, l_partkey % 7 = 5 AS parse_failed,
  l_partkey || ' ' || l_suppkey || ' ' || l_returnflag AS claim FROM lineitem)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipeline runs: run_id, pdf, version, n_total, n_vault, words, tokens, duration, ts."""
    day = F.dayofmonth("o_orderdate")
    month = F.month("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        (F.col("o_custkey") % 50).alias("pdf"),
        F.concat(F.lit("v4."), month, F.lit("."), F.pmod(day, F.lit(3))).alias("version"),
        (10 + F.col("o_orderkey") % 20).alias("n_total"),
        F.least(10 + F.col("o_orderkey") % 20, F.col("o_custkey") % 25).alias("n_vault"),
        F.col("o_totalprice").alias("words"),
        (F.col("o_orderkey") * 7 % 100000).alias("tokens"),
        (F.col("o_custkey") * 3 % 1000).cast("double").alias("duration"),
        F.when(F.col("o_orderstatus") != "P", (F.col("o_orderkey") % 100) / 100.0).otherwise(-1.0).alias("rate"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderpriority").alias("model"),
    )


RUNS_SQL = """runs AS (SELECT o_orderkey AS run_id, o_custkey % 50 AS pdf,
  'v4.' || month(o_orderdate) || '.' || (day(o_orderdate) % 3) AS version, 10 + o_orderkey % 20 AS n_total,
  least(10 + o_orderkey % 20, o_custkey % 25) AS n_vault, o_totalprice AS words, o_orderkey * 7 % 100000 AS tokens,
  CAST(o_custkey * 3 % 1000 AS DOUBLE) AS duration,
  CASE WHEN o_orderstatus <> 'P' THEN (o_orderkey % 100) / 100.0 ELSE -1.0 END AS rate, o_orderdate AS ts, o_orderpriority AS model FROM orders)"""
