"""Trace events: agent statistics, JSON scans, cost, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folium.plans.registry import Registry
from folium.sources.tables import table

QUERIES = Registry()
query = QUERIES.query

# Prices in cents per million input and output tokens.
PRICES = [("view", 300, 1500), ("click", 25, 125), ("purchase", 1500, 7500)]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("s17_json_scan", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_scan(spark, sf_dir):
    """Typed read of JSON strings; a bad line gives null."""
    return events(spark, sf_dir).select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query(
    "s21_token_trace",
    """SELECT user_id, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) FILTER (WHERE event_type <> 'view') AS BIGINT) AS tokens,
  count(*) FILTER (WHERE event_type = 'view') AS cached FROM events GROUP BY user_id""",
)
def token_trace(spark, sf_dir):
    """Token sums of a run over rows that no cache answered (here: views)."""
    rows = events(spark, sf_dir).select("user_id", "event_type", F.from_json("props", "k long")["k"].alias("k"))
    fresh = F.col("event_type") != "view"
    return rows.groupBy("user_id").agg(F.sum(F.when(fresh, F.col("k"))).alias("tokens"), F.count_if(~fresh).alias("cached"))


@query(
    "f85_canonical_agent",
    """SELECT event_id, CASE WHEN event_type = 'signup' THEN NULL WHEN starts_with(event_type, 'err') THEN 'eval' ELSE event_type END AS agent FROM events""",
)
def canonical_agent(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", agent().alias("agent"))


def agent():
    """Unknown agents (here: signup) drop out, evaluation agents (here: err*) fold into one."""
    kind = F.col("event_type")
    return F.when(kind == "signup", None).when(F.startswith(kind, F.lit("err")), "eval").otherwise(kind)


_AGENT_SQL = "CASE WHEN event_type = 'signup' THEN NULL WHEN starts_with(event_type, 'err') THEN 'eval' ELSE event_type END"


@query(
    "a20_agent_stats",
    f"""SELECT agent, count(*) AS calls, count(*) FILTER (WHERE value < 1) AS errors, round(CAST(count(*) FILTER (WHERE value < 1) AS DOUBLE) / count(*), 4) AS error_rate,
  CAST(floor(avg(event_id % 1000)) AS BIGINT) AS avg_ms, count(DISTINCT user_id) AS users FROM (SELECT *, {_AGENT_SQL} AS agent FROM events) WHERE agent IS NOT NULL GROUP BY agent""",
)
def agent_stats(spark, sf_dir):
    bad = F.count_if(F.col("value") < 1)
    return (
        events(spark, sf_dir)
        .withColumn("agent", agent())
        .where("agent is not null")
        .groupBy("agent")
        .agg(
            F.count("*").alias("calls"),
            bad.alias("errors"),
            F.round(bad / F.count("*"), 4).alias("error_rate"),
            F.floor(F.avg(F.col("event_id") % 1000)).alias("avg_ms"),
            F.count_distinct("user_id").alias("users"),
        )
    )


@query(
    "f37_cost_per_call",
    """WITH p(m, i, o) AS (VALUES ('view', 300, 1500), ('click', 25, 125), ('purchase', 1500, 7500))
SELECT event_id, coalesce(((i * (event_id % 1000) + o * (user_id % 100) + 50) // 100) / 1e6, 0.0) AS cost FROM events LEFT JOIN p ON m = split_part('provider/' || event_type, '/', 2)""",
)
def cost_per_call(spark, sf_dir):
    """Price table join on the model without its provider; unpriced models cost nothing.

    Dollars to six digits, halves up, in whole numbers until the last division."""
    prices = F.broadcast(spark.createDataFrame(PRICES, "m string, i long, o long"))  # a fixed table
    rows = events(spark, sf_dir).withColumn("m", F.substring_index(F.concat(F.lit("provider/"), "event_type"), "/", -1))
    cost = F.expr("((i * (event_id % 1000) + o * (user_id % 100) + 50) div 100) / 1e6d")
    return rows.join(prices, "m", "left").select("event_id", F.coalesce(cost, F.lit(0.0)).alias("cost"))


@query(
    "a48_live_runs",
    """SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, date_diff('second', date_trunc('second', min(ts)), date_trunc('second', max(ts))) AS elapsed,
  arg_max(event_type, event_id) AS last_type, max(ts) >= TIMESTAMP '2024-01-30 00:00:00' AS running FROM events GROUP BY user_id""",
)
def live_runs(spark, sf_dir):
    """First and last event of a run and whether its newest one is recent enough."""
    seconds = lambda c: F.unix_timestamp(F.date_trunc("second", c))
    return (
        events(spark, sf_dir)
        .groupBy("user_id")
        .agg(
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
            (seconds(F.max("ts")) - seconds(F.min("ts"))).alias("elapsed"),
            F.max_by("event_type", "event_id").alias("last_type"),
            (F.max("ts") >= F.lit("2024-01-30 00:00:00").cast("timestamp")).alias("running"),
        )
    )


@query(
    "st4_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 2 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS first_ts, count(*) AS n FROM s GROUP BY user_id, k""",
)
def sessions(spark, sf_dir):
    """Runs of events without a gap of two hours: session windows, merged by the engine."""
    rows = events(spark, sf_dir).groupBy("user_id", F.session_window("ts", "2 hours").alias("w"))
    return rows.agg(F.min("ts").alias("first_ts"), F.count("*").alias("n")).select("user_id", "first_ts", "n")


@query("p27_llm_call_rows", "SELECT event_id FROM events WHERE event_type IN ('view', 'click', 'purchase') AND json_extract(props, '$.k') IS NOT NULL")
def llm_call_rows(spark, sf_dir):
    keep = F.col("event_type").isin([p[0] for p in PRICES]) & F.get_json_object("props", "$.k").isNotNull()
    return events(spark, sf_dir).where(keep).select("event_id")


@query("f97_date_labels", "SELECT event_id, strftime(ts, '%d.%m %H:%M') AS label FROM events")
def date_labels(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.date_format("ts", "dd.MM HH:mm").alias("label"))


@query(
    "a22_run_totals",
    "SELECT count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens, round(sum(value), 2) AS total FROM events WHERE event_type <> 'view'",
)
def run_totals(spark, sf_dir):
    rows = events(spark, sf_dir).where("event_type <> 'view'")
    return rows.agg(F.count("*").alias("n"), F.sum(F.from_json("props", "k long")["k"]).alias("tokens"), F.round(F.sum("value"), 2).alias("total"))


@query(
    "st6_run_budget",
    "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k <= 5",
)
def run_budget(spark, sf_dir):
    """The calls of a run that its cap of five admits, in order."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return events(spark, sf_dir).select("event_id", "user_id").withColumn("k", k).where("k <= 5").select("event_id", "user_id")
