"""Roles of the driver's test tables.

* events        → telemetry; `error` rows act as alerts, user_id as the agent,
                  props.k as the storyline id, value as severity.
* orders        → threats (o_orderkey), customer → endpoints, nation → tenants.
* conversations → analyst notes; documents ⋈ labels → text + verdict.
* embeddings    → feature vectors; label 0 against the rest is the minority.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from threatframe.plans.registry import load
from threatframe.session import ensure_utc

# Fixed query parameters of the registered event queries.
AS_OF = "2024-01-31 00:00:00"
LOOKBACK_DAYS = 20
WINDOW_S = 3600          # ±60 min in oracle queries (the operator default is ±60 s)
EVENT_CAP = 1000
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry events with the columns the matcher needs."""
    ensure_utc(spark)
    ev = load(spark, sf_dir, "events")
    return ev.select(
        "event_id",
        F.col("ts").alias("event_time"),
        F.col("user_id").cast("string").alias("agent"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").alias("storyline"),
    )


def alerts(ev: DataFrame) -> DataFrame:
    """Alerts are the `error` events; each keeps its storyline and agent."""
    return ev.filter(F.col("event_type") == "error").select(
        F.col("event_id").alias("alert_id"),
        F.col("event_time").alias("created_at"),
        F.col("storyline").alias("a_storyline"),
        F.col("agent").alias("a_agent"),
    )


def threats_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat threat rows from orders (ids, verdict, hashes as hex text)."""
    ensure_utc(spark)
    o = load(spark, sf_dir, "orders")
    verdict = (F.when(F.col("o_orderstatus") == "F", "true_positive")
               .when(F.col("o_orderstatus") == "P", "false_positive")
               .otherwise("undefined"))
    return o.select(
        F.col("o_orderkey").alias("threat_id"),
        F.col("o_custkey").alias("endpoint_id"),
        F.col("o_orderdate").alias("created_at"),
        verdict.alias("analyst_verdict"),
        F.sha2(F.col("o_custkey").cast("string"), 256).alias("sha256"),
        F.when(F.col("o_orderpriority") == "1-URGENT",
               F.sha1(F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("sha1"),
        F.md5(F.col("o_orderkey").cast("string")).alias("md5"),
        "o_orderpriority", "o_totalprice", "o_orderstatus",
    )


THREATS_SQL = """
  SELECT o_orderkey AS threat_id, o_custkey AS endpoint_id, o_orderdate AS created_at,
         CASE o_orderstatus WHEN 'F' THEN 'true_positive' WHEN 'P' THEN 'false_positive'
              ELSE 'undefined' END AS analyst_verdict,
         sha256(CAST(o_custkey AS VARCHAR)) AS sha256,
         CASE WHEN o_orderpriority = '1-URGENT'
              THEN sha1(strftime(o_orderdate, '%Y-%m-%d')) END AS sha1,
         md5(CAST(o_orderkey AS VARCHAR)) AS md5,
         o_orderpriority, o_totalprice, o_orderstatus
  FROM orders"""

EVENTS_SQL = """
  SELECT event_id, ts AS event_time, CAST(user_id AS VARCHAR) AS agent, event_type, value,
         json_extract_string(props, '$.k') AS storyline
  FROM events"""

ALERTS_SQL = """
  SELECT event_id AS alert_id, event_time AS created_at, storyline AS a_storyline,
         agent AS a_agent
  FROM ev WHERE event_type = 'error'"""
