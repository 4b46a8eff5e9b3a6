"""Accept / reject split.

Rules are (name, predicate) pairs; a predicate that is false or NULL fails.
All rules are evaluated once into an array of failed rule names, so a row
is read once and one bad row never affects another (no chunked retries).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threatframe.functions import scalars as X
from threatframe.schemas import ANALYST_VERDICTS, DETECTION_TYPES, INCIDENT_STATUSES

Rule = tuple[str, Column]


def failed_rules(rules: list[Rule]) -> Column:
    return F.filter(
        F.array(*[F.when(~F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules]),
        lambda r: r.isNotNull())


def validate(df: DataFrame, rules: list[Rule], table: str = "", key: list[str] | None = None,
             as_of: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, reject rows).  Rejects: table, key, rule, payload
    (JSON of the row), as_of — one row per failed rule."""
    tagged = df.withColumn("_failed", failed_rules(rules))
    accepted = tagged.filter(F.size("_failed") == 0).drop("_failed")
    bad = tagged.filter(F.size("_failed") > 0)
    payload_cols = [c for c in df.columns if not c.startswith("_")]
    key_col = (F.to_json(F.struct(*[F.col(k) for k in key])) if key
               else F.lit(None).cast("string"))
    rejects = bad.select(
        F.lit(table).alias("table"), key_col.alias("key"),
        F.explode("_failed").alias("rule"),
        F.to_json(F.struct(*payload_cols)).alias("payload"),
        (F.to_timestamp(F.lit(as_of)) if as_of else F.current_timestamp()).alias("as_of"))
    return accepted, rejects


def rule_counts(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Failures per rule plus accepted / rejected totals, long form."""
    tagged = df.withColumn("_failed", failed_rules(rules))
    per_rule = [F.count_if(F.array_contains("_failed", n)).alias(n) for n, _c in rules]
    wide = tagged.agg(*per_rule, F.count_if(F.size("_failed") == 0).alias("accepted"),
                      F.count_if(F.size("_failed") > 0).alias("rejected"))
    names = [n for n, _c in rules] + ["accepted", "rejected"]
    stack = ", ".join(f"'{n}', `{n}`" for n in names)
    return wide.selectExpr(f"stack({len(names)}, {stack}) AS (rule, n)")


# --------------------------------------------------------------------------
# Rule sets.  Inputs carry raw text columns named `<x>_raw` (see project.py).
# --------------------------------------------------------------------------
def _positive_id(raw: str, name: str) -> list[Rule]:
    return [(f"{name}_format", X.id_format_ok(F.col(raw))),
            (f"{name}_positive", X.to_id(F.col(raw)) > 0)]


def _enum(col: str, domain: list[str]) -> Rule:
    c = F.col(col)
    return (f"enum_{col}", c.isNull() | c.isin(domain))


def tenant_rules() -> list[Rule]:
    """V1: id > 0, name non-empty."""
    return _positive_id("tenant_id_raw", "tenant_id") + [
        ("name_nonempty", F.length(F.col("name")) >= 1)]


def endpoint_rules() -> list[Rule]:
    """V2: ids > 0, UUID, group/site ≥ 0 (or NULL), scan end ≥ start."""
    start, end = X.parse_ts(F.col("scan_started_raw")), X.parse_ts(F.col("scan_finished_raw"))
    return (_positive_id("endpoint_id_raw", "endpoint_id")
            + _positive_id("tenant_id_raw", "tenant_id")
            + [("agent_uuid", X.is_uuid(F.col("agent_uuid_raw"))),
               ("group_id", X.id_format_ok(F.col("group_id_raw"))
                & (X.to_id(F.col("group_id_raw")) >= 0)),
               ("site_id", X.id_format_ok(F.col("site_id_raw"))
                & (X.to_id(F.col("site_id_raw")) >= 0)),
               ("scan_started_at", F.col("scan_started_raw").isNull() | start.isNotNull()),
               ("scan_finished_at", F.col("scan_finished_raw").isNull() | end.isNotNull()),
               ("scan_order", start.isNull() | end.isNull() | (end >= start))])


#: Label columns and the values that they may hold.
LABEL_DOMAINS = {"incident_status": INCIDENT_STATUSES, "analyst_verdict": ANALYST_VERDICTS,
                 "detection_type": DETECTION_TYPES}


def enum_rules() -> list[Rule]:
    """V9: labels are null or of their domain."""
    return [_enum(c, domain) for c, domain in LABEL_DOMAINS.items()]


def null_unknown_labels(df: DataFrame) -> DataFrame:
    """Labels outside their domain become null."""
    return df.withColumns({c: F.when(F.col(c).isin(domain), F.col(c))
                           for c, domain in LABEL_DOMAINS.items()})


def threat_rules(enums: bool = True) -> list[Rule]:
    """V3 (+ V9): ids > 0, hex hashes, file size ≥ 0, required times, enums."""
    rules = _positive_id("threat_id_raw", "threat_id") + _positive_id("tenant_id_raw", "tenant_id")
    for h in ("md5", "sha1", "sha256"):
        c = F.col(f"{h}_raw")
        rules.append((f"{h}_hex", c.isNull() | X.is_hex(c)))
    fs = F.col("file_size_raw")
    rules += [
        ("file_size", fs.isNull() | (X.id_format_ok(fs) & (X.to_id(fs) >= 0))),
        ("identified_at", X.parse_ts(F.col("identified_at_raw")).isNotNull()),
        ("created_at", X.parse_ts(F.col("created_at_raw")).isNotNull()),
    ]
    return rules + (enum_rules() if enums else [])


def note_rules() -> list[Rule]:
    """V4: threat id > 0, note non-empty."""
    return [("threat_id_positive", F.col("threat_id") > 0),
            ("note_nonempty", F.length(F.col("note")) >= 1)]


def technique_ok(t: Column) -> Column:
    """V6 on one technique struct."""
    return t["name"].isNotNull() & t["link"].isNotNull()


def tactic_rules() -> list[Rule]:
    """V5 (+V6 nested): name and source required; every technique valid."""
    techs = F.coalesce(F.col("techniques"), F.array())
    return [("tactic_name", F.col("name").isNotNull()),
            ("tactic_source", F.col("source").isNotNull()),
            ("tactic_techniques", F.forall(techs, technique_ok))]


def label_rules() -> list[Rule]:
    """V7: threat id > 0, the rest optional."""
    return [("threat_id_positive", F.col("threat_id") > 0)]


def indicator_rules() -> list[Rule]:
    """V8: threat id > 0, ids all integers."""
    ids = F.coalesce(F.col("ids_raw"), F.array())
    return [("threat_id_positive", F.col("threat_id") > 0),
            ("ids_int", F.forall(X.int_array(ids), lambda v: v.isNotNull()))]


def not_null_rules(cols: list[str]) -> list[Rule]:
    """V10."""
    return [(f"not_null_{c}", F.col(c).isNotNull()) for c in cols]
