"""Registered queries of scans, sinks, registry, nested attach and small
filters: landed files are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatframe.operators import agg, filters, joins, metrics, project, upsert, validate
from threatframe.plans import roles as R
from threatframe.plans.q_ingest import AS_OF, INGEST_TABLES, alert_documents, land_documents
from threatframe.plans.registry import load, register
from threatframe.schemas import NOTE_PAGE
from threatframe.session import ensure_utc, scratch_path
from threatframe.sources import sinks, store
from threatframe.sources.scan import scan_events, scan_feature_csv, scan_notes, scan_threats


@register("q_scan_notes", sql="""
SELECT CAST(conv_id AS VARCHAR) AS threat_id, count(*) AS n_notes,
       CAST(sum(length(note)) AS BIGINT) AS chars
FROM (SELECT conv_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS note FROM conversations)
WHERE note <> '' GROUP BY conv_id""")
def q_scan_notes(spark, sf_dir):
    """S4 + P7: one landed note page per turn, scanned back and counted per alert."""
    path = scratch_path(spark, "note-pages")
    body = F.struct(F.lit(None).cast("string").alias("body"), F.col("text").alias("text"))
    (load(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("threat_id"), F.array(body).alias("data"),
        F.lit(None).cast(NOTE_PAGE["pagination"].dataType).alias("pagination"))
     .write.json(path))
    return scan_notes(spark, path).groupBy("threat_id").agg(
        F.count(F.lit(1)).alias("n_notes"), F.sum(F.length("note")).cast("long").alias("chars"))


@register("q_scan_events", sql="""
SELECT CAST(user_id AS VARCHAR) AS "agentUuid", event_type AS "eventType", ts AS "eventTime",
       json_extract_string(props, '$.k') AS storyline
FROM events WHERE event_type IN ('click', 'error')""")
def q_scan_events(spark, sf_dir):
    """S5 + P1 + F10 + L4: landed event rows under source names, scoped to two
    types, newest first."""
    ensure_utc(spark)
    path = scratch_path(spark, "event-rows")
    load(spark, sf_dir, "events").select(
        F.col("ts").alias("event.time"), F.col("user_id").cast("string").alias("agent.uuid"),
        F.col("event_type").alias("event.type"),
        F.get_json_object("props", "$.k").alias("src.process.storyline.id")).write.parquet(path)
    rows = filters.scope(scan_events(spark, path), "eventType", ["click", "error"])
    return filters.newest_first(rows, "eventTime").select(
        "agentUuid", "eventType", F.col("eventTime").cast("timestamp_ntz").alias("eventTime"),
        "storyline")


@register("q_feature_csv", sql="""
SELECT CAST(d.n_chars AS DOUBLE) AS n_chars, CASE WHEN d.lang = 'en' THEN '' ELSE d.lang END
       AS notes_text, l.quality AS label
FROM documents d JOIN labels l USING (doc_id)""")
def q_feature_csv(spark, sf_dir):
    """S6 + P13: a feature CSV with header, label last, text null → ''."""
    path = scratch_path(spark, "feature-csv")
    d = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id")
    d = d.select(F.col("quality").alias("label"), F.col("n_chars").cast("double").alias("n_chars"),
                 F.when(F.col("lang") != "en", F.col("lang")).alias("notes_text"))
    project.label_last(d).write.option("header", True).csv(path)
    return scan_feature_csv(spark, path, ["n_chars"])


@register("q_upsert_alternate", sql="""
WITH s AS (SELECT c_custkey AS endpoint_id, CAST(c_nationkey AS BIGINT) AS tenant_id,
                  md5(c_name) AS agent_uuid, c_mktsegment AS os_type
           FROM customer WHERE c_acctbal >= 0),
i AS (SELECT c_custkey + 1000000 AS endpoint_id, CAST(c_nationkey AS BIGINT) AS tenant_id,
             md5(c_name) AS agent_uuid, 'linux' AS os_type FROM customer WHERE c_acctbal <= 5000)
SELECT coalesce(i.endpoint_id, s.endpoint_id) AS endpoint_id, tenant_id, agent_uuid,
       coalesce(i.os_type, s.os_type) AS os_type
FROM s FULL JOIN i USING (tenant_id, agent_uuid)""")
def q_upsert_alternate(spark, sf_dir):
    """T5 + F5: endpoints upserted on (tenant, agent uuid); the endpoint id may change."""
    c = load(spark, sf_dir, "customer")
    base = c.select("c_acctbal", F.col("c_custkey").alias("endpoint_id"),
                    F.col("c_nationkey").cast("long").alias("tenant_id"),
                    F.md5("c_name").alias("agent_uuid"), F.col("c_mktsegment").alias("os_type"))
    stored = base.filter("c_acctbal >= 0").drop("c_acctbal")
    new = base.filter("c_acctbal <= 5000").drop("c_acctbal") \
        .withColumn("endpoint_id", F.col("endpoint_id") + 1000000) \
        .withColumn("os_type", F.lit("linux"))
    return upsert.upsert(stored, filters.valid_ids(new, ["endpoint_id"]),
                         ["tenant_id", "agent_uuid"], update="*", origin=None)


@register("q_drop_paths", sql="""
SELECT o_orderkey, '{"status":"' || o_orderstatus || '"}' AS info FROM orders""")
def q_drop_paths(spark, sf_dir):
    """Drop a top-level and a nested field."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.struct(
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
        .alias("info"))
    return project.drop_paths(o, ["o_custkey"], ["info.priority"]).select(
        "o_orderkey", F.to_json("info").alias("info"))


@register("q_label_rules", sql="""
SELECT 'threat_id_positive' AS rule, count(*) FILTER (WHERE NOT coalesce(doc_id > 0, false)) AS n
FROM labels
UNION ALL SELECT 'not_null_quality', count(*) FILTER (WHERE quality IS NULL) FROM labels
UNION ALL SELECT 'ids_int', count(*) FILTER (WHERE toxic = 1) FROM labels
UNION ALL SELECT 'accepted', count(*) FILTER (WHERE doc_id > 0 AND quality IS NOT NULL AND toxic = 0)
FROM labels
UNION ALL SELECT 'rejected', count(*) FILTER (WHERE NOT (coalesce(doc_id > 0, false)
  AND quality IS NOT NULL AND toxic = 0)) FROM labels""")
def q_label_rules(spark, sf_dir):
    """V7 + V8 + V10 + A9: label, indicator and not-null rules, counted per rule."""
    rows = load(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("threat_id"), "quality",
        F.when(F.col("toxic") == 1, F.array(F.lit("1"), F.lit("x"))).otherwise(
            F.array(F.lit("1"))).alias("ids_raw"))
    rules = dict(validate.label_rules() + validate.indicator_rules()
                 + validate.not_null_rules(["quality"]))
    return validate.rule_counts(rows, list(rules.items()))


@register("q_nested_events", sql=f"""
WITH ev AS ({R.EVENTS_SQL}), alerts AS ({R.ALERTS_SQL}),
p AS (SELECT a.alert_id, e.event_id, e.event_time, e.event_type
      FROM alerts a JOIN ev e ON e.agent = a.a_agent AND e.event_id <> a.alert_id
       AND e.event_time >= date_trunc('second', a.created_at - INTERVAL {R.WINDOW_S} SECOND)
       AND e.event_time <= date_trunc('second', a.created_at + INTERVAL {R.WINDOW_S} SECOND))
SELECT a.alert_id, count(p.event_id) AS n,
       coalesce(string_agg(p.event_type, ',' ORDER BY p.event_time, p.event_id), '') AS types
FROM alerts a LEFT JOIN p USING (alert_id) GROUP BY a.alert_id""")
def q_nested_events(spark, sf_dir):
    """The events of each alert nested in time order, uncut; none gives []."""
    ev = R.events(spark, sf_dir)
    a = R.alerts(ev)
    pairs = joins.interval_join(a, ev, "a_agent", "agent", "created_at", "event_time", R.WINDOW_S,
                                R.WINDOW_S, extra_condition=F.col("event_id") != F.col("alert_id"))
    out = joins.attach_list(a.select("alert_id"), pairs, "alert_id", ["event_time", "event_id"],
                            F.col("event_type"), "types")
    return out.select("alert_id", F.size("types").cast("long").alias("n"),
                      F.array_join("types", ",").alias("types"))


@register("q_audit_counts", sql=f"""
WITH ev AS ({R.EVENTS_SQL}), alerts AS ({R.ALERTS_SQL})
SELECT 'events' AS stage, count(*) AS n FROM ev
UNION ALL SELECT 'alerts', count(*) FROM alerts
UNION ALL SELECT 'guarded', count(*) FROM alerts
  WHERE created_at >= TIMESTAMP '{R.AS_OF}' - INTERVAL {R.LOOKBACK_DAYS} DAY""")
def q_audit_counts(spark, sf_dir):
    """Rows per stage of the event match."""
    from threatframe.plans.q_events import guarded_alerts

    ev = R.events(spark, sf_dir)
    return agg.audit_counts({"events": ev, "alerts": R.alerts(ev), "guarded": guarded_alerts(ev)})


@register("q_events_of", sql="""
SELECT event_id, user_id, value FROM events WHERE event_type = 'error' AND user_id = 1""")
def q_events_of(spark, sf_dir):
    """The events of one type and agent; both predicates reach the scan."""
    ev = load(spark, sf_dir, "events")
    return store.events_of(ev, "event_type", "error", "user_id", 1) \
        .select("event_id", "user_id", "value")


def _scored_orders(spark, sf_dir):
    o = load(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("F", "P"))
    return o.select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("label"),
                    F.col("o_totalprice").alias("prob"),
                    filters.threshold("o_totalprice", 100000).alias("pred_label"))


@register("q_write_scored", sql="""
SELECT o_orderkey, round(o_totalprice, 4) AS prob,
       CAST(CASE WHEN o_totalprice >= 100000 THEN 1 ELSE 0 END AS BIGINT) AS pred_label,
       '2024-02-01' AS scored_at
FROM orders WHERE o_orderstatus IN ('F', 'P')""")
def q_write_scored(spark, sf_dir):
    """K2 + F7: scored results written as JSON with `scored_at`, read back."""
    path = scratch_path(spark, "scored")
    sinks.write_scored(_scored_orders(spark, sf_dir), path, "2024-02-01")
    return spark.read.schema("o_orderkey long, prob double, pred_label long, scored_at string") \
        .json(path).select("o_orderkey", F.round("prob", 4).alias("prob"), "pred_label",
                           "scored_at")


@register("q_write_metrics", sql="""
WITH b AS (SELECT o_totalprice AS score, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS label
           FROM orders WHERE o_orderstatus IN ('F', 'P')),
r AS (SELECT *, rank() OVER (ORDER BY score) AS lo, count(*) OVER (PARTITION BY score) AS c FROM b),
a AS (SELECT sum(CASE WHEN label = 1 THEN lo + (c - 1) / 2.0 ELSE 0 END) AS r1,
             sum(label) AS p, count(*) - sum(label) AS n FROM r)
SELECT round((r1 - p * (p + 1) / 2.0) / (p * n), 6) AS test_auc,
       CAST(100000 AS DOUBLE) AS threshold,
       CAST((SELECT count(*) FILTER (WHERE label = 1) FROM b) AS BIGINT) AS support_1,
       round((SELECT avg(CASE WHEN (score >= 100000) = (label = 1) THEN 1.0 ELSE 0.0 END) FROM b), 6)
         AS accuracy
FROM a""")
def q_write_metrics(spark, sf_dir):
    """M19 + K3: AUC and report of stored scores as one metrics row, written and read back."""
    path = scratch_path(spark, "metrics")
    scored = _scored_orders(spark, sf_dir)
    row = sinks.metrics_row(metrics.auc(scored, "prob", "label"),
                            metrics.classification_report(scored, "label", "pred_label"), 100000.0)
    sinks.write_metrics(row, path)
    back = spark.read.schema("test_auc double, threshold double, classification_report string") \
        .json(path)
    report = F.col("classification_report")
    return back.select(F.round("test_auc", 6).alias("test_auc"), "threshold",
                       F.get_json_object(report, "$.1.support").cast("long").alias("support_1"),
                       F.round(F.get_json_object(report, "$.accuracy.f1").cast("double"), 6)
                       .alias("accuracy"))


@register("q_write_importance", sql="""
SELECT rpad(feature, 40, ' ') AS feature,
       format('{:.3f}', importance) AS importance
FROM (SELECT p_type AS feature, 100.0 * count(*) / sum(count(*)) OVER () AS importance
      FROM part GROUP BY p_type ORDER BY importance DESC, feature LIMIT 20)""")
def q_write_importance(spark, sf_dir):
    """A10 + L1 + K4: the 20 most frequent part types as an importance file, read back."""
    from threatframe.operators.rank import top_k

    path = scratch_path(spark, "importance")
    freq = agg.frequency_map(load(spark, sf_dir, "part"), "p_type", "f")
    top = top_k(freq.select(F.col("p_type").alias("feature"),
                            (F.col("f") * 100).alias("importance")),
                [F.col("importance").desc(), F.col("feature")], 20)
    sinks.write_importance(top, path)
    return spark.read.schema("feature string, importance string").option("header", True) \
        .option("ignoreTrailingWhiteSpace", False).csv(path)


@register("q_model_registry", sql="""
SELECT r.run AS model_run_id, r.name, count(*) AS n_rows, CAST(2 AS BIGINT) AS n_columns
FROM orders, (SELECT CAST(1 AS BIGINT) AS run, 'F' AS name
              UNION ALL SELECT CAST(2 AS BIGINT), 'P') r
WHERE o_orderstatus = r.name GROUP BY r.run, r.name""")
def q_model_registry(spark, sf_dir):
    """K6: two model runs registered with their rows and columns."""
    root = scratch_path(spark, "registry")
    o = load(spark, sf_dir, "orders")
    for status in ("F", "P"):
        store.register_run(spark, root, status, "price rule", "orders", "{}",
                           o.filter(F.col("o_orderstatus") == status), "o_orderkey",
                           ["o_totalprice", "o_orderpriority"], AS_OF)
    rows = store.read_table(spark, root, "model_run_rows").groupBy("model_run_id") \
        .agg(F.count(F.lit(1)).alias("n_rows"))
    columns = store.read_table(spark, root, "model_run_columns").groupBy("model_run_id") \
        .agg(F.count(F.lit(1)).alias("n_columns"))
    return store.read_table(spark, root, "model_runs").join(rows, "model_run_id") \
        .join(columns, "model_run_id").select("model_run_id", "name", "n_rows", "n_columns")


@register("q_lookup_route", sql="""
WITH l AS (SELECT md5(o_orderpriority) AS h, avg(CASE o_orderstatus WHEN 'F' THEN 1.0 ELSE 0.0 END)
                  AS p FROM orders WHERE o_totalprice < 100000 GROUP BY 1)
SELECT o.o_orderkey, CAST(coalesce(floor(l.p), -1) AS INTEGER) AS pred_label,
       CASE WHEN l.h IS NULL THEN 'model' ELSE 'lookup' END AS source
FROM orders o LEFT JOIN l ON l.h = CASE WHEN o.o_totalprice < 200000 THEN md5(o.o_orderpriority) END""")
def q_lookup_route(spark, sf_dir):
    """M18 (routes) + U4: rows with a known hash take its truncated probability,
    the rest go to the model; one result of both."""
    from threatframe.plans.score import lookup_route

    o = load(spark, sf_dir, "orders")
    known = o.filter("o_totalprice < 100000").groupBy(F.md5("o_orderpriority").alias("h")).agg(
        F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("p"))
    rows = o.select("o_orderkey", F.when(F.col("o_totalprice") < 200000, F.md5("o_orderpriority"))
                    .alias("h"))
    hit, miss = lookup_route(rows, known, "h", "p")
    return hit.select("o_orderkey", "pred_label", "source").unionByName(
        miss.select("o_orderkey", F.lit(-1).alias("pred_label"),
                    F.lit("model").alias("source")))


_CHILDREN_SQL = """
WITH x AS (SELECT o.*, c.c_nationkey, c.c_name FROM orders o JOIN customer c
             ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey),
ok AS (SELECT * FROM x WHERE o_orderkey > 0 AND c_nationkey > 0 AND o_custkey > 0),
acc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, o_custkey, o_orderdate
                              ORDER BY o_orderkey) AS rn FROM ok) WHERE rn = 1)
SELECT DISTINCT 'endpoints' AS "table", CAST(o_custkey AS VARCHAR) AS k,
       CAST(c_nationkey AS VARCHAR) AS v FROM x WHERE o_custkey > 0 AND c_nationkey > 0
UNION ALL SELECT 'threat_notes', o_orderkey || '|1', o_orderpriority FROM acc
UNION ALL SELECT 'threat_indicators', o_orderkey || '|0', o_orderpriority FROM acc
UNION ALL SELECT 'indicator_tactics', o_orderkey || '|0|0', 't' || o_orderstatus FROM acc
UNION ALL SELECT 'tactic_techniques', o_orderkey || '|0|0|0', 'k' || o_custkey FROM acc
UNION ALL SELECT 'deepvis_events', CAST(o_orderkey AS VARCHAR), o_orderstatus FROM acc"""


@register("q_ingest_children", sql=_CHILDREN_SQL)
def q_ingest_children(spark, sf_dir):
    """The child tables after two overlapping batches, the
    second with every alert twice; keys in natural form, ids followed by joins."""
    from threatframe.plans.ingest import ingest_into

    docs = alert_documents(spark, sf_dir)
    info = F.col("threatInfo")
    status = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_key"),
                                                  "o_orderstatus")
    docs = docs.join(status, "_key").withColumn("indicators", F.array(F.struct(
        F.col("notes")[0].alias("category"), F.lit(None).cast("string").alias("description"),
        F.array(F.lit("1")).alias("ids"), F.array(F.struct(
            F.concat(F.lit("t"), "o_orderstatus").alias("name"), F.lit("s").alias("source"),
            F.array(F.struct(F.concat(F.lit("k"), F.substring(info["storyline"], 2, 20))
                             .alias("name"), F.lit("l").alias("link"))).alias("techniques")))
        .alias("tactics")))).withColumn("deepvis", F.array(
            F.struct(info["createdAt"].alias("eventTime"), F.col("o_orderstatus").alias("eventType")),
            F.struct(info["createdAt"].alias("eventTime"),
                     F.lit(None).cast("string").alias("eventType")))).drop("o_orderstatus")
    early = docs.filter(info["createdAt"] < "1999")
    late = docs.filter(info["createdAt"] >= "1998")
    root = scratch_path(spark, "store")
    for batch in (early, late.unionByName(late)):
        path = land_documents(batch, scratch_path(spark, "alerts"))
        ingest_into(spark, root, scan_threats(spark, path), AS_OF)
    t = {name: store.read_table(spark, root, name) for name in INGEST_TABLES}
    ind = t["threat_indicators"].select("indicator_id", F.concat_ws(
        "|", "threat_id", "position").alias("ik"), "category")
    tac = t["indicator_tactics"].join(ind, "indicator_id").select("tactic_id", F.concat_ws(
        "|", "ik", "position").alias("tk"), "name")
    tech = t["tactic_techniques"].withColumnRenamed("name", "technique").join(tac, "tactic_id")
    parts = [
        t["endpoints"].select(F.lit("endpoints").alias("table"),
                              F.col("endpoint_id").cast("string").alias("k"),
                              F.col("tenant_id").cast("string").alias("v")),
        t["threat_notes"].select(F.lit("threat_notes"), F.concat_ws("|", "threat_id", "occurrence"),
                                 "note"),
        ind.select(F.lit("threat_indicators"), "ik", "category"),
        tac.select(F.lit("indicator_tactics"), "tk", "name"),
        tech.select(F.lit("tactic_techniques"), F.concat_ws("|", "tk", "position"), "technique"),
        t["deepvis_events"].select(F.lit("deepvis_events"), F.col("threat_id").cast("string"),
                                   "event_type"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out

