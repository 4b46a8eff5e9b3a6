"""Registered streaming queries: the event table replayed as a file stream
(`availableNow`), results written under the checkpoint directory and read
back.  Their oracle is the SQL of the batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatframe.plans import roles as R
from threatframe.plans.registry import load, register
from threatframe.session import ensure_utc
from threatframe.streaming import stream


def _event_stream(spark, sf_dir):
    ensure_utc(spark)
    schema = load(spark, sf_dir, "events").schema
    src = stream.event_source(spark, sf_dir, schema, file_glob="events.parquet")
    return src.select(
        "event_id", F.col("ts").cast("timestamp").alias("event_time"),
        F.col("user_id").alias("threat_id"), F.col("user_id").cast("string").alias("agent"),
        "event_type", "value", F.get_json_object("props", "$.k").alias("storyline"))


@register("q_stream_dedupe", sql="""
SELECT DISTINCT user_id AS threat_id, date_trunc('hour', ts) AS event_hour, event_type FROM events""")
def q_stream_dedupe(spark, sf_dir):
    """One row per (threat, hour, type) survives the streaming dedupe."""
    ev = _event_stream(spark, sf_dir).withColumn(
        "event_hour", F.date_trunc("hour", "event_time"))
    d = stream.dedupe_stream(ev, "event_time", ["threat_id", "event_hour", "event_type"])
    out = stream.run_available_now(d.select("threat_id", "event_hour", "event_type", "event_time"),
                                   "dedupe")
    r = spark.read.parquet(out)
    return r.select("threat_id", F.col("event_hour").cast("timestamp_ntz").alias("event_hour"),
                    "event_type")


@register("q_stream_match", sql=f"""
WITH ev AS ({R.EVENTS_SQL})
SELECT a.event_id AS alert_id, e.event_id
FROM ev a JOIN ev e ON e.storyline = a.storyline AND e.event_id <> a.event_id
 AND e.event_time >= a.event_time - INTERVAL {R.WINDOW_S} SECOND
 AND e.event_time <= a.event_time + INTERVAL {R.WINDOW_S} SECOND
WHERE a.event_type = 'error'""")
def q_stream_match(spark, sf_dir):
    """R2: alerts (error events) matched to events of their storyline within
    ±W by a watermarked stream-stream join."""
    ev = _event_stream(spark, sf_dir)
    alerts = ev.filter(F.col("event_type") == "error").select(
        F.col("event_id").alias("alert_id"), F.col("event_time").alias("created_at"),
        F.col("storyline").alias("a_storyline"))
    cand = _event_stream(spark, sf_dir).select("event_id", "event_time", "storyline")
    m = stream.match_stream(alerts, cand, "a_storyline", "storyline", "created_at", "event_time",
                            R.WINDOW_S, R.WINDOW_S, watermark="2 hours",
                            extra=F.col("event_id") != F.col("alert_id"))
    out = stream.run_available_now(m.select("alert_id", "event_id"), "match")
    return spark.read.parquet(out)
