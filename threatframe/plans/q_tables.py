"""Registered queries over orders / customer / nation / lineitem /
conversations / supplier: filters, fallbacks, validation, hashes, lookups,
notes, references, dedupe, upserts, normalisation, access paths, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatframe.functions import scalars as X
from threatframe.operators import agg, filters, joins, rank, split, upsert, validate
from threatframe.operators.graph import linked_groups
from threatframe.plans import roles as R
from threatframe.plans.registry import load, register
from threatframe.plans.ingest import normalise_indicators, notes_text_per_key
from threatframe.session import ensure_utc

T = R.THREATS_SQL


# ---------------------------------------------------------------- F1-F3, X8
@register("q_filter_since_verdict", sql=f"""
WITH t AS ({T})
SELECT threat_id, analyst_verdict,
       CASE lower(analyst_verdict) WHEN 'true_positive' THEN 1
            WHEN 'false_positive' THEN 0 END AS label
FROM t
WHERE created_at >= TIMESTAMP '2001-08-01' - INTERVAL 730 DAY
  AND analyst_verdict IN ('true_positive', 'false_positive')""")
def q_filter_since_verdict(spark, sf_dir):
    t = R.threats_from_orders(spark, sf_dir)
    t = filters.since(t, "created_at", filters.lookback("2001-08-01", 730))
    t = filters.verdict_in(t, "analyst_verdict", " true_positive, false_positive ")
    return t.select("threat_id", "analyst_verdict",
                    X.verdict_label(F.col("analyst_verdict")).alias("label"))


# ---------------------------------------------------------------- P5, P6, X13
_FALLBACK_INPUT = """
  SELECT o.o_orderkey, o.o_orderstatus, o.o_orderpriority, c.c_custkey, c.c_nationkey,
         c.c_mktsegment,
         CASE WHEN o.o_orderstatus = 'O' THEN '' ELSE CAST(o.o_orderkey AS VARCHAR) END AS id_raw,
         CASE WHEN c.c_mktsegment = 'AUTOMOBILE' THEN ''
              ELSE '10.' || c.c_nationkey || '.' || (c.c_custkey % 250) || '.1, 10.9.9.9' END
           AS det_ip,
         '192.168.' || c.c_nationkey || '.' || (o.o_orderkey % 250) AS rt_ip,
         CASE WHEN o.o_orderpriority = '1-URGENT' THEN '' ELSE CAST(c.c_nationkey AS VARCHAR) END
           AS rt_group,
         CAST(c.c_custkey AS VARCHAR) AS det_group,
         CASE WHEN c.c_mktsegment = 'BUILDING' THEN '' END AS det_site
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey"""


@register("q_identifier_fallback", sql=f"""
WITH x AS ({_FALLBACK_INPUT})
SELECT CAST(coalesce(nullif(trim(id_raw), ''), CAST(o_orderkey AS VARCHAR)) AS BIGINT) AS threat_id,
       CASE WHEN strpos(coalesce(nullif(det_ip, ''), nullif(rt_ip, '')), ',') > 0
            THEN trim(split_part(coalesce(nullif(det_ip, ''), nullif(rt_ip, '')), ',', 1))
            ELSE coalesce(nullif(det_ip, ''), nullif(rt_ip, '')) END AS ip_v4,
       coalesce(nullif(rt_group, ''), nullif(det_group, ''), '0') AS group_id,
       coalesce(nullif(det_site, ''), '0') AS site_id
FROM x""")
def q_identifier_fallback(spark, sf_dir):
    o, c = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer")
    x = o.join(c, F.col("c_custkey") == F.col("o_custkey")).select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "O", "").otherwise(F.col("o_orderkey").cast("string"))
        .alias("id_raw"),
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", "")
        .otherwise(F.concat(F.lit("10."), F.col("c_nationkey").cast("string"), F.lit("."),
                            (F.col("c_custkey") % 250).cast("string"), F.lit(".1, 10.9.9.9")))
        .alias("det_ip"),
        F.concat(F.lit("192.168."), F.col("c_nationkey").cast("string"), F.lit("."),
                 (F.col("o_orderkey") % 250).cast("string")).alias("rt_ip"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "")
        .otherwise(F.col("c_nationkey").cast("string")).alias("rt_group"),
        F.col("c_custkey").cast("string").alias("det_group"),
        F.when(F.col("c_mktsegment") == "BUILDING", "").alias("det_site"),
    )
    return x.select(
        F.coalesce(X.nonempty(F.trim("id_raw")), F.col("o_orderkey").cast("string"))
        .cast("long").alias("threat_id"),
        X.first_of_list(X.first_nonempty("det_ip", "rt_ip")).alias("ip_v4"),
        F.coalesce(X.first_nonempty("rt_group", "det_group"), F.lit("0")).alias("group_id"),
        F.coalesce(X.first_nonempty("det_site"), F.lit("0")).alias("site_id"),
    )


# ---------------------------------------------------------------- P7, X6
_NOTE_INPUT = """
  SELECT conv_id, turn,
         CASE role WHEN 'user' THEN ' ' || chr(9) || text || chr(10) || ' '
                   WHEN 'assistant' THEN '' END AS body,
         CASE WHEN turn = 0 AND role = 'assistant' THEN '  ' || chr(10) ELSE text END AS text
  FROM conversations"""
_NOTE_SQL = f"""
  SELECT conv_id, turn,
         regexp_replace(coalesce(nullif(body, ''), text, ''), '^\\s+|\\s+$', '', 'g') AS note
  FROM ({_NOTE_INPUT})"""


def _notes(spark, sf_dir):
    cv = load(spark, sf_dir, "conversations")
    x = cv.select(
        "conv_id", "turn",
        F.when(F.col("role") == "user",
               F.concat(F.lit(" \t"), F.col("text"), F.lit("\n ")))
        .when(F.col("role") == "assistant", F.lit("")).alias("body"),
        F.when((F.col("turn") == 0) & (F.col("role") == "assistant"), F.lit("  \n"))
        .otherwise(F.col("text")).alias("text"))
    from threatframe.operators.project import note_text

    return x.select("conv_id", "turn", note_text(F.col("body"), F.col("text")).alias("note"))


@register("q_note_text", sql=f"""
SELECT conv_id, turn, length(note) AS note_len, md5(note) AS note_md5
FROM ({_NOTE_SQL}) WHERE note <> ''""")
def q_note_text(spark, sf_dir):
    """Body else text, stripped, blank notes dropped."""
    n = _notes(spark, sf_dir).filter(F.col("note") != "")
    return n.select("conv_id", "turn", F.length("note").alias("note_len"),
                    F.md5("note").alias("note_md5"))


@register("q_attach_notes", sql=f"""
SELECT conv_id, count(*) AS n_notes, CAST(sum(length(note)) AS BIGINT) AS notes_len,
       md5(string_agg(note, ' ' ORDER BY turn)) AS notes_md5
FROM ({_NOTE_SQL}) WHERE note <> '' GROUP BY conv_id""")
def q_attach_notes(spark, sf_dir):
    """All notes of each alert nested in turn order, uncut."""
    n = _notes(spark, sf_dir).filter(F.col("note") != "")
    parents = n.select("conv_id").distinct()
    nested = joins.attach_list(parents, n, "conv_id", ["turn"], F.col("note"), "notes")
    return nested.select("conv_id", F.size("notes").cast("long").alias("n_notes"),
                         F.aggregate("notes", F.lit(0).cast("long"),
                                     lambda a, x: a + F.length(x)).alias("notes_len"),
                         F.md5(F.array_join("notes", " ")).alias("notes_md5"))


@register("q_notes_text", sql=f"""
WITH n AS (SELECT * FROM ({_NOTE_SQL}) WHERE note <> ''),
j AS (SELECT conv_id, count(*) AS n_notes,
             substr(string_agg(note, ' ' ORDER BY turn), 1, 5000) AS notes_text
      FROM n GROUP BY conv_id)
SELECT conv_id, n_notes, length(notes_text) AS notes_len, md5(notes_text) AS notes_md5 FROM j""")
def q_notes_text(spark, sf_dir):
    """Notes of each alert in turn order, joined by a space and cut
    to 5000 characters; only the notes that can reach the cut are gathered."""
    n = _notes(spark, sf_dir).filter(F.col("note") != "")
    text = notes_text_per_key(n, "conv_id", "turn", "note", 5000)
    counts = n.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_notes"))
    return counts.join(text, "conv_id").select(
        "conv_id", "n_notes", F.length("notes_text").alias("notes_len"),
        F.md5("notes_text").alias("notes_md5"))


# ---------------------------------------------------------------- V1-V3, V9, A9
def _rules_sql(rows: list[tuple[str, str]], src: str) -> str:
    """Long-form rule counts in SQL: (rule, failures) + accepted / rejected."""
    fails = [f"NOT coalesce({cond}, false)" for _n, cond in rows]
    parts = [f"SELECT '{n}' AS rule, count(*) FILTER (WHERE {f}) AS n FROM src"
             for (n, _c), f in zip(rows, fails)]
    anyfail = " OR ".join(f"({f})" for f in fails)
    parts.append(f"SELECT 'accepted', count(*) FILTER (WHERE NOT ({anyfail})) FROM src")
    parts.append(f"SELECT 'rejected', count(*) FILTER (WHERE {anyfail}) FROM src")
    return f"WITH src AS ({src})\n" + "\nUNION ALL\n".join(parts)


def _id_sql(raw: str, name: str) -> list[tuple[str, str]]:
    t = f"trim({raw})"
    whole = (f"(CASE WHEN regexp_full_match({t}, '[+-]?[0-9]+') "
             f"THEN TRY_CAST({t} AS BIGINT) END)")
    fmt = f"({raw} IS NULL OR {t} = '' OR {whole} IS NOT NULL)"
    val = f"(CASE WHEN {raw} IS NULL OR {t} = '' THEN 0 ELSE {whole} END)"
    return [(f"{name}_format", fmt), (f"{name}_positive", f"{val} > 0")]


_TENANT_SRC = """
  SELECT CAST(n_nationkey AS VARCHAR) AS tenant_id_raw,
         regexp_replace(CASE WHEN n_regionkey = 0 THEN ' ' || chr(9) ELSE n_name END,
                        '^\\s+|\\s+$', '', 'g') AS name
  FROM nation"""


@register("q_validate_tenants", sql=_rules_sql(
    _id_sql("tenant_id_raw", "tenant_id") + [("name_nonempty", "length(name) >= 1")], _TENANT_SRC))
def q_validate_tenants(spark, sf_dir):
    n = load(spark, sf_dir, "nation")
    src = n.select(F.col("n_nationkey").cast("string").alias("tenant_id_raw"),
                   X.strip_ws(F.when(F.col("n_regionkey") == 0, F.lit(" \t"))
                              .otherwise(F.col("n_name"))).alias("name"))
    return validate.rule_counts(src, validate.tenant_rules())


_ENDPOINT_SRC = """
  SELECT CAST(c_custkey AS VARCHAR) AS endpoint_id_raw,
         CAST(c_nationkey AS VARCHAR) AS tenant_id_raw,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN substr(md5(c_name), 1, 31)
              WHEN c_mktsegment = 'HOUSEHOLD' THEN
                substr(md5(c_name), 1, 8) || '-' || substr(md5(c_name), 9, 4) || '-' ||
                substr(md5(c_name), 13, 4) || '-' || substr(md5(c_name), 17, 4) || '-' ||
                substr(md5(c_name), 21, 12)
              ELSE md5(c_name) END AS agent_uuid_raw,
         CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) AS group_id_raw,
         CAST(c_nationkey AS VARCHAR) AS site_id_raw,
         CASE WHEN c_custkey % 7 = 0 THEN '2024-01-02T00:00:00Z' END AS scan_started_raw,
         CASE WHEN c_custkey % 7 = 0 THEN '2024-01-01T00:00:00Z'
              WHEN c_custkey % 11 = 0 THEN 'garbage' END AS scan_finished_raw
  FROM customer"""
_UUID_RE = ("([0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"
            "|[0-9A-Fa-f]{32})")
_TS_SQL = "try_strptime({x}, '%Y-%m-%dT%H:%M:%SZ')"


@register("q_validate_endpoints", sql=_rules_sql(
    _id_sql("endpoint_id_raw", "endpoint_id") + _id_sql("tenant_id_raw", "tenant_id") + [
        ("agent_uuid", f"regexp_full_match(agent_uuid_raw, '{_UUID_RE}')"),
        ("group_id", "CAST(group_id_raw AS BIGINT) >= 0"),
        ("site_id", "CAST(site_id_raw AS BIGINT) >= 0"),
        ("scan_started_at", "scan_started_raw IS NULL OR "
         + _TS_SQL.format(x="scan_started_raw") + " IS NOT NULL"),
        ("scan_finished_at", "scan_finished_raw IS NULL OR "
         + _TS_SQL.format(x="scan_finished_raw") + " IS NOT NULL"),
        ("scan_order", f"{_TS_SQL.format(x='scan_started_raw')} IS NULL OR "
         f"{_TS_SQL.format(x='scan_finished_raw')} IS NULL OR "
         f"{_TS_SQL.format(x='scan_finished_raw')} >= {_TS_SQL.format(x='scan_started_raw')}"),
    ], _ENDPOINT_SRC))
def q_validate_endpoints(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    h = F.md5("c_name")
    src = c.select(
        F.col("c_custkey").cast("string").alias("endpoint_id_raw"),
        F.col("c_nationkey").cast("string").alias("tenant_id_raw"),
        F.when(F.col("c_mktsegment") == "MACHINERY", F.substring(h, 1, 31))
        .when(F.col("c_mktsegment") == "HOUSEHOLD", F.concat_ws(
            "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
            F.substring(h, 17, 4), F.substring(h, 21, 12)))
        .otherwise(h).alias("agent_uuid_raw"),
        F.floor("c_acctbal").cast("long").cast("string").alias("group_id_raw"),
        F.col("c_nationkey").cast("string").alias("site_id_raw"),
        F.when(F.col("c_custkey") % 7 == 0, F.lit("2024-01-02T00:00:00Z")).alias("scan_started_raw"),
        F.when(F.col("c_custkey") % 7 == 0, F.lit("2024-01-01T00:00:00Z"))
        .when(F.col("c_custkey") % 11 == 0, F.lit("garbage")).alias("scan_finished_raw"),
    )
    return validate.rule_counts(src, validate.endpoint_rules())


_THREAT_SRC = f"""
  SELECT CAST(t.threat_id AS VARCHAR) AS threat_id_raw,
         CAST(c.c_nationkey AS VARCHAR) AS tenant_id_raw,
         t.md5 AS md5_raw,
         CASE t.o_orderpriority WHEN '5-LOW' THEN substr(sha1(CAST(t.threat_id AS VARCHAR)), 1, 39)
              WHEN '4-NOT SPECIFIED' THEN upper(sha1(CAST(t.threat_id AS VARCHAR)))
              ELSE sha1(CAST(t.threat_id AS VARCHAR)) END AS sha1_raw,
         t.sha256 AS sha256_raw,
         CAST(CAST(floor(t.o_totalprice) AS BIGINT) - 100000 AS VARCHAR) AS file_size_raw,
         strftime(t.created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at_raw,
         CASE WHEN t.o_orderstatus = 'O' AND t.o_orderpriority = '2-HIGH' THEN 'not a date'
              ELSE strftime(t.created_at, '%Y-%m-%dT%H:%M:%SZ') END AS identified_at_raw,
         CASE t.o_orderpriority WHEN '1-URGENT' THEN 'unresolved' WHEN '2-HIGH' THEN 'in_progress'
              WHEN '3-MEDIUM' THEN 'resolved' WHEN '5-LOW' THEN 'closed' END AS incident_status,
         t.analyst_verdict, 'static' AS detection_type
  FROM ({T}) t JOIN customer c ON c.c_custkey = t.endpoint_id"""


def _hex_sql(c):
    return f"({c} IS NULL OR regexp_full_match({c}, '([0-9A-Fa-f]{{2}})*'))"


@register("q_validate_threats", sql=_rules_sql(
    _id_sql("threat_id_raw", "threat_id") + _id_sql("tenant_id_raw", "tenant_id") + [
        ("md5_hex", _hex_sql("md5_raw")), ("sha1_hex", _hex_sql("sha1_raw")),
        ("sha256_hex", _hex_sql("sha256_raw")),
        ("file_size", "file_size_raw IS NULL OR CAST(file_size_raw AS BIGINT) >= 0"),
        ("identified_at", _TS_SQL.format(x="identified_at_raw") + " IS NOT NULL"),
        ("created_at", _TS_SQL.format(x="created_at_raw") + " IS NOT NULL"),
        ("enum_incident_status",
         "incident_status IS NULL OR incident_status IN ('unresolved', 'in_progress', 'resolved')"),
        ("enum_analyst_verdict", "analyst_verdict IS NULL OR analyst_verdict IN "
         "('undefined', 'true_positive', 'false_positive')"),
        ("enum_detection_type", "detection_type IS NULL OR detection_type IN ('static', 'dynamic')"),
    ], _THREAT_SRC))
def q_validate_threats(spark, sf_dir):
    return validate.rule_counts(_threat_src(spark, sf_dir), validate.threat_rules())


def _threat_src(spark, sf_dir):
    t = R.threats_from_orders(spark, sf_dir)
    c = load(spark, sf_dir, "customer")
    sha1 = F.sha1(F.col("threat_id").cast("string"))
    iso = X.format_seconds(F.col("created_at").cast("timestamp"))
    return t.join(c, F.col("c_custkey") == F.col("endpoint_id")).select(
        F.col("threat_id").cast("string").alias("threat_id_raw"),
        F.col("c_nationkey").cast("string").alias("tenant_id_raw"),
        F.col("md5").alias("md5_raw"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.substring(sha1, 1, 39))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.upper(sha1))
        .otherwise(sha1).alias("sha1_raw"),
        F.col("sha256").alias("sha256_raw"),
        (F.floor("o_totalprice").cast("long") - 100000).cast("string").alias("file_size_raw"),
        iso.alias("created_at_raw"),
        F.when((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "2-HIGH"),
               F.lit("not a date")).otherwise(iso).alias("identified_at_raw"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "unresolved")
        .when(F.col("o_orderpriority") == "2-HIGH", "in_progress")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "resolved")
        .when(F.col("o_orderpriority") == "5-LOW", "closed").alias("incident_status"),
        "analyst_verdict", F.lit("static").alias("detection_type"),
    )


# ---------------------------------------------------------------- X1, X2
_HEX_INPUT = f"""
  SELECT threat_id,
         CASE o_orderpriority WHEN '1-URGENT' THEN sha256 WHEN '2-HIGH' THEN upper(md5)
              WHEN '3-MEDIUM' THEN '' WHEN '4-NOT SPECIFIED' THEN substr(md5, 1, 31)
              ELSE 'zz' || substr(md5, 3) END AS hex_raw
  FROM ({T})"""


@register("q_hash_bytes", sql=f"""
SELECT threat_id, regexp_full_match(hex_raw, '([0-9A-Fa-f]{{2}})*') AS hex_ok,
       CASE WHEN regexp_full_match(hex_raw, '([0-9A-Fa-f]{{2}})*')
            THEN CAST(length(hex_raw) / 2 AS DOUBLE) END AS n_bytes,
       CASE WHEN regexp_full_match(hex_raw, '([0-9A-Fa-f]{{2}})*') AND length(hex_raw) >= 2
            THEN lower(substr(hex_raw, 1, 2)) END AS first_byte
FROM ({_HEX_INPUT})""")
def q_hash_bytes(spark, sf_dir):
    t = R.threats_from_orders(spark, sf_dir)
    raw = (F.when(F.col("o_orderpriority") == "1-URGENT", F.col("sha256"))
           .when(F.col("o_orderpriority") == "2-HIGH", F.upper("md5"))
           .when(F.col("o_orderpriority") == "3-MEDIUM", F.lit(""))
           .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.substring("md5", 1, 31))
           .otherwise(F.concat(F.lit("zz"), F.substring("md5", 3, 64))))
    b = X.hex_to_bytes(raw)
    return t.select("threat_id", X.is_hex(raw).alias("hex_ok"),
                    F.octet_length(b).cast("double").alias("n_bytes"),
                    F.when(F.octet_length(b) >= 1, F.lower(F.hex(F.substring(b, 1, 1))))
                    .alias("first_byte"))


# ---------------------------------------------------------------- J4, U4
@register("q_hash_lookup", sql=f"""
WITH t AS ({T}),
known AS (SELECT sha256, avg(CASE analyst_verdict WHEN 'true_positive' THEN 1.0 ELSE 0.0 END) AS p
          FROM t WHERE created_at < TIMESTAMP '1999-01-01'
            AND analyst_verdict IN ('true_positive', 'false_positive') GROUP BY sha256),
s AS (SELECT * FROM t WHERE created_at >= TIMESTAMP '1999-01-01')
SELECT s.threat_id, s.sha256,
       CAST(CASE s.analyst_verdict WHEN 'true_positive' THEN 1 WHEN 'false_positive' THEN 0 END
            AS DOUBLE) AS true_label,
       round(k.p, 6) AS prob, CAST(trunc(k.p) AS DOUBLE) AS pred_label,
       CASE WHEN k.p IS NULL THEN 'model' ELSE 'lookup' END AS source
FROM s LEFT JOIN known k ON k.sha256 = s.sha256""")
def q_hash_lookup(spark, sf_dir):
    """J4 + U4: known hashes are scored from the lookup, the rest go to the
    model route (probability left for the model)."""
    from threatframe.plans.score import lookup_route

    t = R.threats_from_orders(spark, sf_dir).withColumn(
        "label", X.verdict_label(F.col("analyst_verdict")))
    cutoff = F.lit("1999-01-01").cast("timestamp_ntz")
    known = (t.filter((F.col("created_at") < cutoff) & F.col("label").isNotNull())
             .groupBy("sha256").agg(F.avg("label").alias("p")))
    s = t.filter(F.col("created_at") >= cutoff)
    hit, miss = lookup_route(s, known, "sha256", "p")
    miss = miss.select("threat_id", "sha256", "label", F.lit(None).cast("double").alias("prob"),
                       F.lit(None).cast("int").alias("pred_label"), F.lit("model").alias("source"))
    out = hit.select("threat_id", "sha256", "label", "prob", "pred_label", "source") \
        .unionByName(miss)
    # nullable integers leave as double, so both engines agree on their type
    return out.select("threat_id", "sha256", F.col("label").cast("double").alias("true_label"),
                      F.round("prob", 6).alias("prob"),
                      F.col("pred_label").cast("double").alias("pred_label"), "source")


# ---------------------------------------------------------------- J7-J9
_GRAPH = [("endpoints", "tenant_id", "tenants", "tenant_id", "cascade"),
          ("threats", "tenant_id", "tenants", "tenant_id", "cascade"),
          ("threats", "endpoint_id", "endpoints", "endpoint_id", "set_null")]


def _ref_tables(spark, sf_dir):
    n, c, o = (load(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    tenants = n.select(F.col("n_nationkey").cast("long").alias("tenant_id"), "n_regionkey")
    endpoints = c.select(F.col("c_custkey").alias("endpoint_id"),
                         F.col("c_nationkey").cast("long").alias("tenant_id"), "c_mktsegment")
    threats = o.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")) \
        .select(F.col("o_orderkey").alias("threat_id"),
                F.col("c_nationkey").cast("long").alias("tenant_id"),
                F.col("o_custkey").alias("endpoint_id"))
    return tenants, endpoints, threats


@register("q_fk_rejects", sql="""
WITH tenants AS (SELECT n_nationkey AS tenant_id FROM nation WHERE n_regionkey <> 0),
ep AS (SELECT c_custkey AS endpoint_id, c_nationkey AS tenant_id FROM customer),
ep_ok AS (SELECT * FROM ep WHERE tenant_id IN (SELECT tenant_id FROM tenants))
SELECT 'endpoints' AS "table", endpoint_id AS "key", 'fk_tenant' AS rule
FROM ep WHERE tenant_id NOT IN (SELECT tenant_id FROM tenants)
UNION ALL
SELECT 'threats', o_orderkey, 'fk_endpoint' FROM orders
WHERE o_custkey NOT IN (SELECT endpoint_id FROM ep_ok)""")
def q_fk_rejects(spark, sf_dir):
    """Tenants of region 0 are missing; their endpoints are refused and so
    are the threats of refused endpoints."""
    tenants, endpoints, _ = _ref_tables(spark, sf_dir)
    o = load(spark, sf_dir, "orders")
    tenants = tenants.filter(F.col("n_regionkey") != 0)
    ep_ok, ep_bad = joins.reference_check(endpoints, tenants, "tenant_id", "tenant_id", "fk_tenant")
    threats = o.select(F.col("o_orderkey").alias("threat_id"), F.col("o_custkey").alias("endpoint_id"))
    _th_ok, th_bad = joins.reference_check(threats, ep_ok, "endpoint_id", "endpoint_id",
                                           "fk_endpoint")
    return (ep_bad.select(F.lit("endpoints").alias("table"), F.col("endpoint_id").alias("key"), "rule")
            .unionByName(th_bad.select(F.lit("threats").alias("table"),
                                       F.col("threat_id").alias("key"), "rule")))


@register("q_delete_cascade", sql="""
WITH gone_t AS (SELECT n_nationkey AS tenant_id FROM nation WHERE n_regionkey = 1),
tenants AS (SELECT n_nationkey AS tenant_id FROM nation
            WHERE n_nationkey NOT IN (SELECT tenant_id FROM gone_t)),
endpoints AS (SELECT c_custkey AS endpoint_id FROM customer
              WHERE c_nationkey NOT IN (SELECT tenant_id FROM gone_t)),
threats AS (SELECT o.o_orderkey AS threat_id FROM orders o JOIN customer c
              ON c.c_custkey = o.o_custkey WHERE c.c_nationkey NOT IN (SELECT tenant_id FROM gone_t))
SELECT 'tenants' AS table_name, count(*) AS n_rows, CAST(sum(tenant_id) AS BIGINT) AS key_sum FROM tenants
UNION ALL SELECT 'endpoints', count(*), CAST(sum(endpoint_id) AS BIGINT) FROM endpoints
UNION ALL SELECT 'threats', count(*), CAST(sum(threat_id) AS BIGINT) FROM threats""")
def q_delete_cascade(spark, sf_dir):
    """Deleting the tenants of region 1 removes their endpoints and
    threats (threats reach tenants directly and through endpoints)."""
    tenants, endpoints, threats = _ref_tables(spark, sf_dir)
    gone = tenants.filter(F.col("n_regionkey") == 1).select("tenant_id")
    keys = {"tenants": ["tenant_id"], "endpoints": ["endpoint_id"], "threats": ["threat_id"]}
    out = joins.delete_cascade({"tenants": tenants, "endpoints": endpoints, "threats": threats},
                               keys, [g for g in _GRAPH if g[4] == "cascade"], "tenants", gone)
    parts = [out[t].agg(F.count(F.lit(1)).alias("n_rows"),
                        F.sum(keys[t][0]).cast("long").alias("key_sum"))
             .withColumn("table_name", F.lit(t)) for t in ("tenants", "endpoints", "threats")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]) \
        .select("table_name", "n_rows", "key_sum")


@register("q_set_null", sql="""
SELECT o.o_orderkey AS threat_id,
       CAST(CASE WHEN c.c_mktsegment = 'BUILDING' THEN NULL ELSE o.o_custkey END AS DOUBLE)
         AS endpoint_id
FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey""")
def q_set_null(spark, sf_dir):
    """Deleting the BUILDING endpoints nulls the threats' endpoint id."""
    _tenants, endpoints, threats = _ref_tables(spark, sf_dir)
    gone = endpoints.filter(F.col("c_mktsegment") == "BUILDING").select("endpoint_id")
    out = joins.set_null(threats, gone, "endpoint_id")
    return out.select("threat_id", F.col("endpoint_id").cast("double").alias("endpoint_id"))


# ---------------------------------------------------------------- A2
_LI_ORDER = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
             "l_returnflag", "l_linestatus", "l_shipdate"]


@register("q_dedupe_first", sql=f"""
SELECT l_orderkey, l_linenumber, {', '.join(_LI_ORDER)} FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                               ORDER BY {', '.join(_LI_ORDER)}) AS rn FROM lineitem)
WHERE rn = 1""")
def q_dedupe_first(spark, sf_dir):
    """A2: one line per (order, line number), first in full-column order."""
    li = load(spark, sf_dir, "lineitem")
    return agg.dedupe_first(li, ["l_orderkey", "l_linenumber"], _LI_ORDER)


# ---------------------------------------------------------------- T1-T4, T12, T13
_AS_OF = "2001-09-01 00:00:00"
_UPSERT_BASE = f"""
  SELECT threat_id, endpoint_id, analyst_verdict, o_orderpriority AS incident_status,
         round(o_totalprice, 2) AS total, created_at FROM ({T})"""
_UPSERT_SQL_HEAD = f"""
WITH b AS ({_UPSERT_BASE}),
s AS (SELECT *, TIMESTAMP '2000-01-01' AS ingested_at, created_at AS last_updated_at
      FROM b WHERE created_at < TIMESTAMP '2000-01-01'),
i AS (SELECT threat_id, endpoint_id,
             CASE WHEN analyst_verdict = 'undefined' THEN 'false_positive'
                  ELSE analyst_verdict END AS analyst_verdict,
             lower(incident_status) AS incident_status, round(total + 1, 2) AS total, created_at
      FROM b WHERE created_at >= TIMESTAMP '1999-01-01')"""


def _upsert_inputs(spark, sf_dir):
    t = R.threats_from_orders(spark, sf_dir).select(
        "threat_id", "endpoint_id", "analyst_verdict",
        F.col("o_orderpriority").alias("incident_status"),
        F.round("o_totalprice", 2).alias("total"), "created_at")
    c2000 = F.lit("2000-01-01").cast("timestamp_ntz")
    stored = (t.filter(F.col("created_at") < c2000)
              .withColumn("ingested_at", c2000)
              .withColumn("last_updated_at", F.col("created_at")))
    incoming = t.filter(F.col("created_at") >= F.lit("1999-01-01").cast("timestamp_ntz")).select(
        "threat_id", "endpoint_id",
        F.when(F.col("analyst_verdict") == "undefined", "false_positive")
        .otherwise(F.col("analyst_verdict")).alias("analyst_verdict"),
        F.lower("incident_status").alias("incident_status"),
        F.round(F.col("total") + 1, 2).alias("total"), "created_at")
    return stored, incoming


def _upsert_out(df):
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c)
                       if c in ("ingested_at", "last_updated_at") else F.col(c)
                       for c in df.columns])


@register("q_upsert_insert", sql=_UPSERT_SQL_HEAD + f"""
SELECT s.*, 'kept' AS origin FROM s WHERE threat_id IN (SELECT threat_id FROM i)
UNION ALL SELECT s.*, 'stored' FROM s WHERE threat_id NOT IN (SELECT threat_id FROM i)
UNION ALL SELECT i.*, TIMESTAMP '{_AS_OF}', TIMESTAMP '{_AS_OF}', 'inserted' FROM i
  WHERE threat_id NOT IN (SELECT threat_id FROM s)""")
def q_upsert_insert(spark, sf_dir):
    """T1 + T12: insert if absent; the stored row wins."""
    s, i = _upsert_inputs(spark, sf_dir)
    return _upsert_out(upsert.upsert(s, i, ["threat_id"], update=[], as_of=_AS_OF,
                                     touch="last_updated_at", insert_only=("ingested_at",)))


@register("q_upsert_all", sql=_UPSERT_SQL_HEAD + f"""
SELECT i.threat_id, i.endpoint_id, i.analyst_verdict, i.incident_status, i.total, i.created_at,
       s.ingested_at, TIMESTAMP '{_AS_OF}' AS last_updated_at, 'updated' AS origin
FROM i JOIN s USING (threat_id)
UNION ALL SELECT s.*, 'stored' FROM s WHERE threat_id NOT IN (SELECT threat_id FROM i)
UNION ALL SELECT i.*, TIMESTAMP '{_AS_OF}', TIMESTAMP '{_AS_OF}', 'inserted' FROM i
  WHERE threat_id NOT IN (SELECT threat_id FROM s)""")
def q_upsert_all(spark, sf_dir):
    """T2/T3 + T12/T13: every column from incoming; ingested_at kept."""
    s, i = _upsert_inputs(spark, sf_dir)
    return _upsert_out(upsert.upsert(s, i, ["threat_id"], update="*", as_of=_AS_OF,
                                     touch="last_updated_at", insert_only=("ingested_at",)))


@register("q_upsert_partial", sql=_UPSERT_SQL_HEAD + f"""
SELECT s.threat_id, s.endpoint_id, i.analyst_verdict, i.incident_status, s.total, s.created_at,
       s.ingested_at, TIMESTAMP '{_AS_OF}' AS last_updated_at, 'updated' AS origin
FROM i JOIN s USING (threat_id)
UNION ALL SELECT s.*, 'stored' FROM s WHERE threat_id NOT IN (SELECT threat_id FROM i)
UNION ALL SELECT i.*, TIMESTAMP '{_AS_OF}', TIMESTAMP '{_AS_OF}', 'inserted' FROM i
  WHERE threat_id NOT IN (SELECT threat_id FROM s)""")
def q_upsert_partial(spark, sf_dir):
    """T4: only the label columns change on conflict."""
    s, i = _upsert_inputs(spark, sf_dir)
    return _upsert_out(upsert.upsert(s, i, ["threat_id"],
                                     update=["analyst_verdict", "incident_status"], as_of=_AS_OF,
                                     touch="last_updated_at", insert_only=("ingested_at",)))


# ---------------------------------------------------------------- T7-T9, T15, X18
def supplier_documents(spark, sf_dir):
    """Nested alert documents, one per supplier, built from its own row and
    its nation / region (bounded arrays: two indicators, two tactics)."""
    s, n, r = (load(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    dims = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    x = s.join(dims, F.col("s_nationkey") == F.col("n_nationkey"))
    tech = F.struct(F.concat(F.lit("T"), F.col("s_suppkey").cast("string")).alias("name"),
                    F.concat(F.lit("https://attack.example/"), F.col("s_suppkey").cast("string"))
                    .alias("link"))
    bad_tech = F.struct(F.lit("x").alias("name"), F.lit(None).cast("string").alias("link"))
    tac1 = F.struct(F.col("s_name").alias("name"),
                    F.when(F.col("s_acctbal") >= 0, F.col("r_name")).alias("source"),
                    F.array(tech).alias("techniques"))
    tac2 = F.struct(F.concat(F.col("s_name"), F.lit("-b")).alias("name"),
                    F.col("n_name").alias("source"),
                    F.when(F.col("s_acctbal") > 5000, F.array(bad_tech))
                    .otherwise(F.array().cast("array<struct<name:string,link:string>>"))
                    .alias("techniques"))
    ind1 = F.struct(F.col("n_name").alias("category"), F.col("r_name").alias("description"),
                    F.array(F.col("s_nationkey").cast("string"), F.col("n_regionkey").cast("string"))
                    .alias("ids"), F.array(tac1, tac2).alias("tactics"))
    ind2 = F.struct(F.lit("peer").alias("category"), F.lit(None).cast("string").alias("description"),
                    F.array(F.lit("x1")).alias("ids"),
                    F.lit(None).cast(tac1_type()).alias("tactics"))
    return x.select(F.col("s_suppkey").alias("threat_id"), F.array(ind1, ind2).alias("indicators"))


def tac1_type():
    return "array<struct<name:string,source:string,techniques:array<struct<name:string,link:string>>>>"


_NORM_SQL = """
WITH x AS (SELECT s.*, n.n_name, n.n_regionkey, r.r_name FROM supplier s
           JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey),
ind AS (SELECT s_suppkey AS threat_id, 0 AS ind_pos FROM x
        UNION ALL SELECT s_suppkey, 1 FROM x),
ind_id AS (SELECT *, row_number() OVER (ORDER BY threat_id, ind_pos) AS indicator_id FROM ind),
tac AS (SELECT s_suppkey AS threat_id, 0 AS ind_pos, 0 AS tac_pos, s_name AS name,
               CASE WHEN s_acctbal >= 0 THEN r_name END AS source, 1 AS n_techniques,
               true AS tech_ok FROM x
        UNION ALL
        SELECT s_suppkey, 0, 1, s_name || '-b', n_name,
               CASE WHEN s_acctbal > 5000 THEN 1 ELSE 0 END, s_acctbal <= 5000 FROM x),
ok AS (SELECT t.*, i.indicator_id FROM tac t JOIN ind_id i USING (threat_id, ind_pos)
       WHERE name IS NOT NULL AND source IS NOT NULL AND tech_ok)
SELECT indicator_id, threat_id, ind_pos, tac_pos, name, source, n_techniques,
       row_number() OVER (ORDER BY indicator_id, tac_pos) AS tactic_id
FROM ok"""


@register("q_normalise", sql=_NORM_SQL)
def q_normalise(spark, sf_dir):
    """T7-T9 + T15 + V5/V6: nested indicators → tactics → techniques with
    surrogate ids; a tactic with a bad technique is rejected whole."""
    docs = supplier_documents(spark, sf_dir)
    ind, tac, _tech, _rej = normalise_indicators(docs)
    return tac.select("indicator_id", "threat_id", "ind_pos", "tac_pos", "name", "source",
                      "n_techniques", "tactic_id")


@register("q_array_contains", sql="""
SELECT s.s_suppkey AS threat_id, p.ind_pos,
       CASE p.ind_pos WHEN 0 THEN list_contains([s.s_nationkey, n.n_regionkey], 3) ELSE false END
         AS has_3,
       CASE p.ind_pos WHEN 0 THEN list_has_any([s.s_nationkey, n.n_regionkey], [1, 2]) ELSE false END
         AS any_1_2
FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey,
     (SELECT 0 AS ind_pos UNION ALL SELECT 1) p""")
def q_array_contains(spark, sf_dir):
    """X17 + X18: integer id arrays of indicators; containment and overlap
    (a non-integer id becomes NULL and matches nothing)."""
    docs = supplier_documents(spark, sf_dir)
    ind, _tac, _tech, _rej = normalise_indicators(docs)
    return ind.select("threat_id", "ind_pos",
                      F.coalesce(F.array_contains("ids", 3), F.lit(False)).alias("has_3"),
                      F.coalesce(F.arrays_overlap("ids", F.array(F.lit(1), F.lit(2))), F.lit(False))
                      .alias("any_1_2"))


@register("q_bytes_lists", sql="""
SELECT p_partkey, lower(hex(unhex(md5(CAST(p_partkey AS VARCHAR))))) AS text_bytes,
       md5(CAST(p_partkey AS VARCHAR)) AS binary_bytes,
       list_filter([p_type, trim(split_part(p_name, ' ', 1)), split_part(p_name, ' ', 2)], lambda x: x <> '') AS items
FROM part""")
def q_bytes_lists(spark, sf_dir):
    """X2 + X7: hex text and binary columns as bytes, comma text as a list."""
    p = load(spark, sf_dir, "part").select(
        "p_partkey", F.md5(F.col("p_partkey").cast("string")).alias("t"),
        F.concat("p_type", F.lit(" , "), F.replace("p_name", F.lit(" "), F.lit(",  ")), F.lit(", ,")).alias("l"))
    p = p.withColumn("b", F.unhex("t"))
    return p.select("p_partkey", F.lower(F.hex(X.as_bytes(p, "t"))).alias("text_bytes"),
                    F.lower(F.hex(X.as_bytes(p, "b"))).alias("binary_bytes"),
                    X.split_list("l").alias("items"))


@register("q_access_paths", sql=f"""
WITH t AS ({T})
SELECT 'by_hash' AS path, threat_id FROM t
WHERE sha256 IN (SELECT sha256(CAST(c_custkey AS VARCHAR)) FROM customer WHERE c_acctbal > 9000)
UNION ALL
SELECT 'tenant_window', t.threat_id FROM t JOIN customer c ON c.c_custkey = t.endpoint_id
WHERE c.c_nationkey = 7 AND t.created_at >= TIMESTAMP '1998-01-01'
  AND t.created_at < TIMESTAMP '1999-01-01'""")
def q_access_paths(spark, sf_dir):
    """T17 on threats laid out for lookups: by a table of hashes (semi join), and by
    tenant and time range (the days' folders, then row groups of the tenant)."""
    from threatframe.session import scratch_path
    from threatframe.sources.lookup import in_window, read_lookup, write_lookup
    from threatframe.sources.store import find_by_hash

    c = load(spark, sf_dir, "customer")
    path = scratch_path(spark, "lookup")
    write_lookup(R.threats_from_orders(spark, sf_dir).withColumn(
        "created_at", F.col("created_at").cast("timestamp")).join(
        c.select("c_custkey", F.col("c_nationkey").alias("tenant_id")),
        F.col("c_custkey") == F.col("endpoint_id"), "left").drop("c_custkey"), path, period="month")
    t = read_lookup(spark, path)
    hashes = c.filter(F.col("c_acctbal") > 9000).select(
        F.sha2(F.col("c_custkey").cast("string"), 256).alias("sha256"))
    by_hash = find_by_hash(t, hashes, "sha256").select(F.lit("by_hash").alias("path"), "threat_id")
    win = in_window(t, "1998-01-01", "1999-01-01", 7, period="month") \
        .select(F.lit("tenant_window").alias("path"), "threat_id")
    return by_hash.unionByName(win)


# ---------------------------------------------------------------- M1-M5
@register("q_split_random", sql=f"""
SELECT threat_id, CASE WHEN {X.hash_fraction_sql(42, 'threat_id')} < 0.2 THEN 'test'
                       ELSE 'train' END AS split
FROM ({T})""")
def q_split_random(spark, sf_dir):
    t = R.threats_from_orders(spark, sf_dir)
    return split.random_split(t, "threat_id").select("threat_id", "split")


_GROUP_FIELDS = ["sha1", "sha256", "md5", "threat_id"]


@register("q_split_group", sql=f"""
SELECT threat_id, coalesce(sha1, sha256, md5, CAST(threat_id AS VARCHAR)) AS group_key,
       CASE WHEN {X.hash_fraction_sql(42, 'coalesce(sha1, sha256, md5, CAST(threat_id AS VARCHAR))')}
            < 0.2 THEN 'test' ELSE 'train' END AS split
FROM ({T})""")
def q_split_group(spark, sf_dir):
    t = R.threats_from_orders(spark, sf_dir)
    return split.group_split(t, _GROUP_FIELDS).select("threat_id", "group_key", "split")


@register("q_split_time", sql=f"""
SELECT threat_id, CASE WHEN created_at < TIMESTAMP '1999-01-01' THEN 'train' ELSE 'test' END AS split
FROM ({T})""")
def q_split_time(spark, sf_dir):
    t = R.threats_from_orders(spark, sf_dir)
    return split.time_split(t, "created_at", "1999-01-01").select("threat_id", "split")


@register("q_split_temporal_group", sql=f"""
WITH t AS ({T}),
s AS (SELECT *, CASE WHEN created_at < TIMESTAMP '1999-01-01' THEN 'train' ELSE 'test' END AS sp
      FROM t),
g AS (SELECT DISTINCT endpoint_id, o_orderpriority FROM s WHERE sp = 'train')
SELECT s.threat_id,
       CASE WHEN s.sp = 'test' AND g.endpoint_id IS NOT NULL THEN 'dropped' ELSE s.sp END AS split
FROM s LEFT JOIN g ON g.endpoint_id = s.endpoint_id AND g.o_orderpriority = s.o_orderpriority""")
def q_split_temporal_group(spark, sf_dir):
    t = R.threats_from_orders(spark, sf_dir)
    return split.temporal_group_split(t, "created_at", "1999-01-01",
                                      ["endpoint_id", "o_orderpriority"]).select("threat_id", "split")


@register("q_global_rank", sql="""
SELECT *, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey,
                             l_quantity, l_extendedprice) AS rank FROM lineitem""")
def q_global_rank(spark, sf_dir):
    """Exact position of every line item in date order, all columns kept."""
    from threatframe.operators.rank import global_rank

    return global_rank(load(spark, sf_dir, "lineitem"),
                       ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                        "l_quantity", "l_extendedprice"])


_LINKED_SQL = f"""
WITH RECURSIVE t AS ({T}),
e AS (SELECT threat_id AS node, 'sha256:' || sha256 AS h FROM t
      UNION ALL SELECT threat_id, 'sha1:' || sha1 FROM t WHERE sha1 IS NOT NULL),
cc(node, label) USING KEY (node) AS (
  SELECT DISTINCT threat_id, threat_id FROM t
  UNION
  (SELECT e2.node, min(c.label) FROM recurring.cc c JOIN e e1 ON e1.node = c.node
     JOIN e e2 ON e2.h = e1.h
   GROUP BY e2.node
   HAVING min(c.label) < (SELECT r.label FROM recurring.cc r WHERE r.node = e2.node)))"""


@register("q_split_linked", sql=_LINKED_SQL + f"""
SELECT node AS threat_id, CASE WHEN {X.hash_fraction_sql(42, 'label')} < 0.2 THEN 'test' ELSE 'train' END AS split
FROM cc""")
def q_split_linked(spark, sf_dir):
    """M2 + M3: group split over threats linked by any hash."""
    t = R.threats_from_orders(spark, sf_dir).select("threat_id", "sha256", "sha1")
    return split.group_split(t, ["sha1", "sha256", "threat_id"], linked=True, id_col="threat_id") \
        .select("threat_id", "split")


@register("q_linked_groups", sql=_LINKED_SQL + """
SELECT node AS threat_id, label AS group_id FROM cc""")
def q_linked_groups(spark, sf_dir):
    """M3: threats sharing a sha256 or a sha1 are one group (components)."""
    t = R.threats_from_orders(spark, sf_dir)
    return linked_groups(t.select("threat_id", "sha256", "sha1"), "threat_id",
                         ["sha256", "sha1"]).select("threat_id", "group_id")


# ---------------------------------------------------------------- A10, M17
@register("q_freq_encode", sql="""
WITH n AS (SELECT count(*) AS total FROM customer),
seg AS (SELECT c_mktsegment, count(*) AS k FROM customer GROUP BY 1),
nat AS (SELECT c_nationkey, count(*) AS k FROM customer GROUP BY 1)
SELECT c.c_custkey, round(seg.k / n.total, 6) AS c_mktsegment_freq,
       round(nat.k / n.total, 6) AS c_nationkey_freq
FROM customer c, n JOIN seg ON true JOIN nat ON true
WHERE seg.c_mktsegment = c.c_mktsegment AND nat.c_nationkey = c.c_nationkey""")
def q_freq_encode(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    out = c.select("c_custkey", "c_mktsegment", "c_nationkey")
    for col in ("c_mktsegment", "c_nationkey"):
        out = agg.frequency_encode(out, col, agg.frequency_map(c, col))
    return out.select("c_custkey", F.round("c_mktsegment_freq", 6).alias("c_mktsegment_freq"),
                      F.round("c_nationkey_freq", 6).alias("c_nationkey_freq"))
