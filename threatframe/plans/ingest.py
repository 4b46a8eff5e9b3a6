"""Ingest of nested alert documents into the normalised tables.

scan → flatten (P2-P4) → validate (V1-V4, V9) → last-wins dedupe (A1) →
reference checks (J7) → unique-key arbitration (T11) → upserts (T1-T4) →
notes (T6), indicators (T7-T9), events (T10) → versioned writes (K1).
Every step is a DataFrame operator; nothing is collected.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window, functions as F

from threatframe.functions import scalars as X
from threatframe.operators import agg, joins, project, upsert, validate
from threatframe.operators.rank import global_rank
from threatframe.schemas import LABEL_COLUMNS, TABLES
from threatframe.session import cut_lineage, dropped, scratch_path, written


def notes_text_per_key(notes: DataFrame, key: str, order: str, text: str,
                       max_len: int = 5000) -> DataFrame:
    """(key, notes_text): non-empty notes in `order`, joined by a space, cut
    to `max_len` characters.

    A note at position r starts at character ≥ 2(r-1), so only the first
    max_len/2 + 1 notes of a key can reach the cut: those are selected by an
    exact per-key rank (range-partitioned, so a hot key is split over tasks)
    and only they are gathered — at most max_len/2 + 1 items per key.
    """
    n = notes.filter(F.length(F.col(text)) > 0).select(key, order, text)
    ranked = global_rank(n, [F.col(order), F.col(text)], partition_by=[key], name="_r")
    head = ranked.filter(F.col("_r") <= max_len // 2 + 1)
    joined = (head.groupBy(key)
              .agg(F.sort_array(F.collect_list(F.struct("_r", text))).alias("_l"))
              .select(key, F.substring(F.concat_ws(" ", F.transform("_l", lambda s: s[text])),
                                       1, max_len).alias("notes_text")))
    return joined


def _max_id(stored: DataFrame | None, col: str):
    """Scalar subquery: largest stored id (0 when the table is empty)."""
    if stored is None:
        return F.lit(0).cast("long")
    return stored.agg(F.coalesce(F.max(col), F.lit(0)).cast("long")).scalar()


def normalise_indicators(docs: DataFrame, stored: dict[str, DataFrame] | None = None,
                         cut=cut_lineage):
    """T7-T9 (+T15, V5/V6, X17, D21): explode indicators → tactics →
    techniques with surrogate ids in natural-key order.

    With `stored` tables given, indicators whose natural key (threat_id,
    position) is already stored are skipped together with their tactics
    (as the reference does), and new ids continue after the stored maximum —
    re-ingesting a batch adds nothing.  Returns (indicators, tactics,
    techniques, tactic rejects).  A NULL list is empty; a tactic with an
    invalid technique is rejected with its techniques.  Each table is materialised before
    and after its ids are given (by `cut`): a rank reads its input several times, and the
    next table starts from it.
    """
    stored = stored or {}
    ind_type = docs.schema["indicators"].dataType
    has_ord = "_ordinal" in docs.columns
    ind = docs.select("threat_id", *(["_ordinal"] if has_ord else []), F.posexplode(F.coalesce(
        F.col("indicators"), F.array().cast(ind_type))).alias("ind_pos", "ind"))
    ind = ind.select("threat_id", "ind_pos", *(["_ordinal"] if has_ord else []),
                     F.col("ind.category").alias("category"),
                     F.col("ind.description").alias("description"),
                     X.int_array(F.coalesce(F.col("ind.ids"), F.array().cast("array<string>")))
                     .alias("ids"),
                     F.col("ind.tactics").alias("tactics"))
    if has_ord:
        # two copies of one alert in a batch: the first copy's indicator wins
        ind = agg.dedupe_first(ind, ["threat_id", "ind_pos"], ["_ordinal"]).drop("_ordinal")
    if "threat_indicators" in stored:
        known = stored["threat_indicators"].select(
            "threat_id", F.col("position").alias("ind_pos"))
        ind = ind.join(known, ["threat_id", "ind_pos"], "left_anti")
    ind = global_rank(cut(ind), [F.col("threat_id"), F.col("ind_pos")], name="_r") \
        .withColumn("indicator_id", _max_id(stored.get("threat_indicators"), "indicator_id")
                    + F.col("_r")).drop("_r")
    ind = cut(ind)
    tac_type = ind_type.elementType["tactics"].dataType
    tac = ind.select("indicator_id", "threat_id", "ind_pos", F.posexplode(
        F.coalesce(F.col("tactics"), F.array().cast(tac_type))).alias("tac_pos", "t"))
    tac = tac.select("indicator_id", "threat_id", "ind_pos", "tac_pos",
                     F.col("t.name").alias("name"), F.col("t.source").alias("source"),
                     F.col("t.techniques").alias("techniques"))
    ok, rejects = validate.validate(tac, validate.tactic_rules(), table="indicator_tactics",
                                    key=["indicator_id", "tac_pos"])
    ok = ok.withColumn("n_techniques", F.size(F.coalesce(F.col("techniques"), F.array())))
    ok = global_rank(ok, [F.col("indicator_id"), F.col("tac_pos")], name="_r") \
        .withColumn("tactic_id", _max_id(stored.get("indicator_tactics"), "tactic_id")
                    + F.col("_r")).drop("_r")
    ok = cut(ok)
    tech = ok.select("tactic_id", F.posexplode(F.coalesce(
        F.col("techniques"), F.array().cast(tac_type.elementType["techniques"].dataType)))
        .alias("tech_pos", "x"))
    tech = tech.select("tactic_id", "tech_pos", F.col("x.name").alias("name"),
                       F.col("x.link").alias("link"))
    tech = global_rank(tech, [F.col("tactic_id"), F.col("tech_pos")], name="_r") \
        .withColumn("technique_id", _max_id(stored.get("tactic_techniques"), "technique_id")
                    + F.col("_r")).drop("_r")
    return ind.drop("tactics"), ok.drop("techniques"), tech, rejects


def insert_events(docs: DataFrame, stored: DataFrame, as_of: str, cut=cut_lineage):
    """T10 + T11 + V10: deepvis events of the batch keyed by (threat, time, type);
    the first per key in batch order, only keys not stored yet; 4 of the event
    columns are stored.  Returns (new rows with their ids, rejects of events
    without a time or type)."""
    ev = docs.select("threat_id", "_ordinal", F.posexplode(F.coalesce(
        F.col("deepvis"), F.array().cast(docs.schema["deepvis"].dataType))).alias("_p", "e"))
    ev = ev.select("threat_id", F.col("e.eventTime").alias("event_time"),
                   F.col("e.eventType").alias("event_type"),
                   F.col("e.eventCategory").alias("event_cat"),
                   F.col("e.severity").alias("severity"),
                   F.struct("_ordinal", "_p").alias("_order"))
    key = ["threat_id", "event_time", "event_type"]
    ev, rejects = validate.validate(ev, validate.not_null_rules(key), "deepvis_events", key, as_of)
    first = agg.dedupe_first(ev, key, ["_order"])
    new = cut(first.join(stored.select(*key), key, "left_anti"))
    new = global_rank(new, [F.col(k) for k in key], name="_r") \
        .withColumn("dvevent_id", _max_id(stored, "dvevent_id") + F.col("_r")).drop("_r") \
        .withColumn("ingested_at", F.to_timestamp(F.lit(as_of)))
    return new.select(*TABLES["deepvis_events"]["schema"].names), rejects


def _ts(col: str):
    return X.parse_ts(F.col(col))


def ingest(docs: DataFrame, store: dict[str, DataFrame], as_of: str):
    """One batch of alert documents merged into the stored tables.  Returns
    (new tables, rejects)."""
    merged, fresh, rejects, _ids = ingest_parts(docs, store, as_of)
    return dict(store, **merged, **{t: store[t].unionByName(rows) for t, rows in fresh.items()}), \
        rejects


def ingest_into(spark, root: str, docs: DataFrame, as_of: str,
                counts: agg.RunningCounts | None = None) -> DataFrame:
    """T16 + K1: ingest a batch into the stored tables under `root`.  New rows of
    the child tables are appended; of the threats only the months that the batch
    touches are rewritten; tenants and endpoints are small and written whole.
    Returns the rejects; `counts` is told the rows of each stage (A9).  What the steps
    materialise lies in a folder of the batch and goes when its tables are committed."""
    from threatframe.schemas import TABLE_ORDER
    from threatframe.sources.store import append_table, read_table, replace_buckets, write_table

    store = {t: read_table(spark, root, t) for t in TABLE_ORDER}
    counts = counts or agg.RunningCounts(on=False)
    folder = scratch_path(spark, "ingest")
    cut = partial(written, under=folder)
    merged, fresh, rejects, ids = ingest_parts(docs, store, as_of, counts, cut)
    fresh = {t: cut(counts.watch(f"new {t}", rows)) for t, rows in fresh.items()}
    rejects = written(counts.watch("rejects", rejects, **{
        t: F.count_if(F.col("table") == t) for t in TABLE_ORDER}))
    month = F.date_format("created_at", "yyyy-MM")
    changed = merged["threats"].join(ids, "threat_id", "left_semi")
    old = store["threats"].join(ids, "threat_id", "left_semi")
    # one row per month
    touched = [r[0] for r in changed.select(month).unionAll(old.select(month)).distinct().collect()]
    for t in ("tenants", "endpoints"):
        write_table(merged[t], root, t)
    if touched:
        replace_buckets(merged["threats"], root, "threats", month, touched)
    for t, rows in fresh.items():
        append_table(rows, root, t)
    dropped(spark, folder)  # the rejects lie elsewhere
    return rejects


def ingest_parts(docs: DataFrame, store: dict[str, DataFrame], as_of: str,
                 counts: agg.RunningCounts | None = None, cut=written):
    """One batch of alert documents (with `_ordinal` = batch order) against the
    stored tables.  Returns (merged tenants, endpoints and threats; new rows of the
    child tables; rejects; ids of the inserted or updated threats).

    Each table step reads materialised parents: the documents and every
    finished table are written by `cut` (under the shared checkpoint
    directory), in dependency order, so no step recomputes the scan and a
    lost executor only repeats the current step."""
    rejects = []
    counts = counts or agg.RunningCounts(on=False)
    docs = cut(counts.watch("documents", docs))  # in columns: each step reads a few
    # tenants (V1, A1 last wins, T1 insert if absent)
    ten = project.tenant_columns(docs)
    ten_ok, r = validate.validate(ten, validate.tenant_rules(), "tenants", ["tenant_id_raw"], as_of)
    rejects.append(r)
    ten_ok = ten_ok.select(X.to_id("tenant_id_raw").alias("tenant_id"), "name", "_ordinal")
    ten_ok = agg.dedupe_last(ten_ok, ["tenant_id"], ["_ordinal"]).drop("_ordinal")
    tenants = upsert.upsert(store["tenants"], ten_ok.withColumn("ingested_at", F.lit(None)
                                                                .cast("timestamp")),
                            ["tenant_id"], update=[], as_of=as_of, insert_only=("ingested_at",),
                            origin=None)
    tenants = cut(counts.watch("tenants", tenants))
    # endpoints (V2, A1, J7 tenant, T2)
    ep = project.endpoint_columns(docs).filter(F.col("endpoint_id_raw").isNotNull()
                                               & (F.trim("endpoint_id_raw") != ""))
    ep_ok, r = validate.validate(ep, validate.endpoint_rules(), "endpoints", ["endpoint_id_raw"],
                                 as_of)
    rejects.append(r)
    ep_ok = ep_ok.select(
        X.to_id("endpoint_id_raw").alias("endpoint_id"), X.to_id("tenant_id_raw").alias("tenant_id"),
        X.canonical_uuid("agent_uuid_raw").alias("agent_uuid"), "computer_name", "os_name",
        "os_type", "os_revision", "ip_v4", "ip_v6", X.to_id("group_id_raw").alias("group_id"),
        X.to_id("site_id_raw").alias("site_id"), "agent_version",
        _ts("scan_started_raw").alias("scan_started_at"),
        _ts("scan_finished_raw").alias("scan_finished_at"), "_ordinal")
    ep_ok = cut(counts.watch("valid endpoints", agg.dedupe_last(
        ep_ok, ["endpoint_id"], ["_ordinal"])))
    ep_ok, r = joins.reference_check(ep_ok, tenants, "tenant_id", "tenant_id", "fk_tenant")
    rejects.append(_reject_rows(r, "endpoints", ["endpoint_id"], as_of))
    ep_ok, r = _against_stored(cut(ep_ok), store["endpoints"], "endpoint_id",
                               ["tenant_id", "agent_uuid"], "unique_tenant_uuid")
    rejects.append(_reject_rows(r, "endpoints", ["endpoint_id"], as_of))
    endpoints = upsert.upsert(store["endpoints"], ep_ok.drop("_ordinal")
                              .withColumn("ingested_at", F.lit(None).cast("timestamp")),
                              ["endpoint_id"], update="*", as_of=as_of, touch="ingested_at",
                              origin=None)
    endpoints = cut(counts.watch("endpoints", endpoints))
    # threats (V3, V9, A1, J7, T11, T3)
    th = project.threat_columns(docs)
    # An unknown label is logged and stored as null; the threat stays
    _known, r = validate.validate(th, validate.enum_rules(), "threats", ["threat_id_raw"], as_of)
    rejects.append(r)
    th = validate.null_unknown_labels(th)
    th_ok, r = validate.validate(th, validate.threat_rules(enums=False), "threats",
                                 ["threat_id_raw"], as_of)
    rejects.append(r)
    th_ok = th_ok.select(
        X.to_id("threat_id_raw").alias("threat_id"), "storyline",
        X.to_id("tenant_id_raw").alias("tenant_id"), "incident_status", "analyst_verdict",
        "detection_type", "confidence_level", "classification", "classification_source",
        _ts("created_at_raw").alias("created_at"),
        F.when(X.nonempty("endpoint_id_raw").isNotNull(), X.to_id("endpoint_id_raw"))
        .alias("endpoint_id"),
        X.hex_to_bytes("md5_raw").alias("md5"), X.hex_to_bytes("sha1_raw").alias("sha1"),
        X.hex_to_bytes("sha256_raw").alias("sha256"), "file_path",
        X.to_id("file_size_raw").alias("file_size"), "threat_name", "publisher_name",
        "certificate_id", "initiated_by", _ts("identified_at_raw").alias("identified_at"),
        "_ordinal")
    th_ok = cut(counts.watch("valid threats", agg.dedupe_last(
        th_ok, ["threat_id"], ["_ordinal"])))
    th_ok, r = joins.reference_check(th_ok, tenants, "tenant_id", "tenant_id", "fk_tenant")
    rejects.append(_reject_rows(r, "threats", ["threat_id"], as_of))
    th_ok, r = joins.reference_check(th_ok, endpoints, "endpoint_id", "endpoint_id", "fk_endpoint")
    rejects.append(_reject_rows(r, "threats", ["threat_id"], as_of))
    th_ok = cut(th_ok)
    stored_th = store["threats"]
    th_ok, r = _against_stored(th_ok, stored_th, "threat_id",
                               ["tenant_id", "sha256", "identified_at"], "unique_threat")
    rejects.append(_reject_rows(r, "threats", ["threat_id"], as_of))
    th_ok = th_ok.drop("_ordinal")
    th_ok = th_ok.withColumn("ingested_at", F.lit(None).cast("timestamp")) \
        .withColumn("last_updated_at", F.lit(None).cast("timestamp"))
    threats = upsert.upsert(stored_th, th_ok, ["threat_id"],
                            update=[c for c in TABLES["threats"]["schema"].names
                                    if c not in ("threat_id", "ingested_at")],
                            as_of=as_of, touch="last_updated_at", insert_only=("ingested_at",),
                            origin=None)
    threats = cut(counts.watch("threats", threats))
    # notes (T6: posexplode + V4 + occurrence number + insert if absent)
    # the first copy of an alert in the batch gives the notes (D3, as for indicators)
    ids = docs.select(
        X.to_id(F.coalesce(X.nonempty(F.trim(F.col("id"))), F.col("threatInfo.threatId")))
        .alias("threat_id"), F.col("notes"), "_ordinal").filter(F.col("threat_id").isNotNull())
    ids = agg.dedupe_first(ids, ["threat_id"], ["_ordinal"])
    notes = ids.select("threat_id", F.posexplode(F.coalesce("notes", F.array().cast("array<string>")))
                       .alias("pos", "note")).withColumn("note", X.strip_ws("note"))
    notes_ok, r = validate.validate(notes, validate.note_rules(), "threat_notes", ["threat_id"], as_of)
    rejects.append(r)
    notes_ok, r = joins.reference_check(cut(notes_ok), threats, "threat_id", "threat_id",
                                        "fk_threat")
    rejects.append(_reject_rows(r, "threat_notes", ["threat_id", "pos"], as_of))
    from threatframe.operators.rank import occurrence_number

    notes_ok = occurrence_number(cut(notes_ok), ["threat_id", "note"], ["pos"]).drop("pos")
    stored_notes = store["threat_notes"]
    fresh = notes_ok.join(stored_notes.select("threat_id", "note", "occurrence"),
                          ["threat_id", "note", "occurrence"], "left_anti")
    fresh = _number_after(cut(fresh), stored_notes, "note_id", ["threat_id", "note", "occurrence"])
    note_rows = fresh.withColumn("ingested_at", F.to_timestamp(F.lit(as_of))).select(
        *TABLES["threat_notes"]["schema"].names)
    # indicators → tactics → techniques (T7-T9) and events (T10) of accepted threats
    th_docs = cut(docs.select(
        X.to_id(F.coalesce(X.nonempty(F.trim(F.col("id"))), F.col("threatInfo.threatId")))
        .alias("threat_id"), "indicators", "deepvis", "_ordinal") \
        .join(th_ok.select("threat_id"), "threat_id", "left_semi"))
    ind, tac, tech, r = normalise_indicators(th_docs, store, cut)
    rejects.append(r)
    ind_rows = ind.select("indicator_id", "threat_id", F.col("ind_pos").cast("int").alias("position"),
                          "category", "description", "ids",
                          F.to_timestamp(F.lit(as_of)).alias("ingested_at"))
    tac_rows = tac.select("tactic_id", "indicator_id", F.col("tac_pos").cast("int").alias("position"),
                          "name", "source")
    tech_rows = tech.select("technique_id", "tactic_id",
                            F.col("tech_pos").cast("int").alias("position"), "name", "link")
    events, r = insert_events(th_docs, store["deepvis_events"], as_of, cut)
    rejects.append(r)
    merged = {"tenants": tenants, "endpoints": endpoints, "threats": threats}
    new_rows = {"threat_notes": note_rows, "threat_indicators": ind_rows,
                "indicator_tactics": tac_rows, "tactic_techniques": tech_rows,
                "deepvis_events": events}
    from functools import reduce

    all_rejects = reduce(lambda a, b: a.unionByName(b), rejects)
    return merged, new_rows, all_rejects, th_ok.select("threat_id")


def _against_stored(batch: DataFrame, stored: DataFrame, key: str, unique: list[str],
                    rule: str) -> tuple[DataFrame, DataFrame]:
    """T11 over stored and incoming rows: a unique key belongs to the stored row
    that has it, else to the first batch row; batch rows with another `key` are
    rejected.  Null parts never conflict.  Returns (batch rows kept, rejected)."""
    ord_type = batch.schema["_ordinal"].dataType
    cols = [key, *unique]
    both = (stored.select(*cols, F.lit(None).cast(ord_type).alias("_ordinal"),
                          F.lit(0).alias("_src"))
            .unionByName(batch.select(*cols, "_ordinal", F.lit(1).alias("_src")))
            .dropna(subset=unique))
    w = Window.partitionBy(*unique).orderBy("_src", "_ordinal")
    losers = (both.withColumn("_holder", F.first(key).over(w))
              .filter((F.col("_src") == 1) & (F.col("_holder") != F.col(key))).select(key))
    return (batch.join(losers, key, "left_anti"),
            batch.join(losers, key, "left_semi").withColumn("rule", F.lit(rule)))


def _number_after(fresh: DataFrame, stored: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """Surrogate ids for new rows after max(stored id)."""
    base = stored.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("long").alias("_base"))
    ranked = global_rank(fresh, [F.col(c) for c in order], name="_r")
    return (agg.attach_one_row(ranked, base)
            .withColumn(id_col, (F.col("_base") + F.col("_r")).cast("long"))
            .drop("_base", "_r"))


def _reject_rows(df: DataFrame, table: str, key: list[str], as_of: str) -> DataFrame:
    payload = [c for c in df.columns if not c.startswith("_") and c != "rule"]
    return df.select(F.lit(table).alias("table"),
                     F.to_json(F.struct(*[F.col(k) for k in key])).alias("key"), "rule",
                     F.to_json(F.struct(*payload)).alias("payload"),
                     F.to_timestamp(F.lit(as_of)).alias("as_of"))


__all__ = ["ingest", "ingest_into", "ingest_parts", "normalise_indicators", "notes_text_per_key", "LABEL_COLUMNS"]
