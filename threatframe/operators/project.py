"""Projections (P1-P16): column mapping, flattening of the nested alert,
fallbacks, whitelists, masking, feature alignment.  All are `select`s."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from threatframe.functions import scalars as X
from threatframe.schemas import EVENT_COLUMNS, STORYLINE_SOURCE


def _has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def map_columns(df: DataFrame, mapping=EVENT_COLUMNS, keep: list[str] | None = None,
                storyline: bool = True) -> DataFrame:
    """One typed column per (output, source, type); the output name is
    taken first, then the source name; absent in both gives typed NULL."""
    cols: list[Column] = [F.col(k) for k in (keep or [])]
    for out, src, typ in mapping:
        present = [F.col(f"`{n}`") for n in (out, src) if _has(df, n)]
        val = F.coalesce(*present) if len(present) > 1 else (present[0] if present else F.lit(None))
        cols.append(val.cast(typ).alias(out))
    if storyline:
        present = [F.col(f"`{n}`") for n in ("storyline", STORYLINE_SOURCE) if _has(df, n)]
        cols.append((F.coalesce(*present) if present else F.lit(None)).cast("string")
                    .alias("storyline"))
    return df.select(*cols)


def threat_columns(df: DataFrame) -> DataFrame:
    """P2 + P5: nested alert → flat threat columns (raw text kept for
    validation; `_raw` suffix marks text that is parsed later)."""
    ti = lambda f: F.col(f"threatInfo.{f}")
    return df.select(
        F.coalesce(X.nonempty(F.trim(F.col("id"))), ti("threatId")).alias("threat_id_raw"),
        ti("storyline").alias("storyline"),
        F.col("agentDetectionInfo.accountId").alias("tenant_id_raw"),
        ti("incidentStatus").alias("incident_status"),
        ti("analystVerdict").alias("analyst_verdict"),
        ti("detectionType").alias("detection_type"),
        ti("confidenceLevel").alias("confidence_level"),
        ti("classification").alias("classification"),
        ti("classificationSource").alias("classification_source"),
        ti("createdAt").alias("created_at_raw"),
        F.col("agentRealtimeInfo.agentId").alias("endpoint_id_raw"),
        ti("md5").alias("md5_raw"), ti("sha1").alias("sha1_raw"), ti("sha256").alias("sha256_raw"),
        ti("filePath").alias("file_path"), ti("fileSize").alias("file_size_raw"),
        ti("threatName").alias("threat_name"), ti("publisherName").alias("publisher_name"),
        ti("certificateId").alias("certificate_id"), ti("initiatedBy").alias("initiated_by"),
        ti("identifiedAt").alias("identified_at_raw"), ti("updatedAt").alias("updated_at_raw"),
        *[c for c in ("_ordinal",) if _has(df, c)],
    )


def endpoint_columns(df: DataFrame) -> DataFrame:
    """P3 + P6: endpoint columns; detection IP first, realtime IP second;
    group/site realtime first, then detection, else 0."""
    det = lambda f: F.col(f"agentDetectionInfo.{f}")
    rt = lambda f: F.col(f"agentRealtimeInfo.{f}")
    return df.select(
        rt("agentId").alias("endpoint_id_raw"),
        det("accountId").alias("tenant_id_raw"),
        rt("agentUuid").alias("agent_uuid_raw"),
        rt("agentComputerName").alias("computer_name"),
        rt("agentOsName").alias("os_name"), rt("agentOsType").alias("os_type"),
        rt("agentOsRevision").alias("os_revision"),
        X.first_of_list(X.first_nonempty(det("agentIpV4"), rt("agentLocalIpV4"))).alias("ip_v4"),
        X.first_of_list(X.first_nonempty(det("agentIpV6"), rt("agentLocalIpV6"))).alias("ip_v6"),
        F.coalesce(X.first_nonempty(rt("groupId"), det("groupId")), F.lit("0")).alias("group_id_raw"),
        F.coalesce(X.first_nonempty(rt("siteId"), det("siteId")), F.lit("0")).alias("site_id_raw"),
        rt("agentVersion").alias("agent_version"),
        rt("scanStartedAt").alias("scan_started_raw"),
        rt("scanFinishedAt").alias("scan_finished_raw"),
        *[c for c in ("_ordinal",) if _has(df, c)],
    )


def tenant_columns(df: DataFrame) -> DataFrame:
    """Account id and stripped account name."""
    return df.select(
        F.col("agentDetectionInfo.accountId").alias("tenant_id_raw"),
        X.strip_ws(F.coalesce(F.col("agentDetectionInfo.accountName"), F.lit(""))).alias("name"),
        *[c for c in ("_ordinal",) if _has(df, c)],
    )


def note_text(body, text) -> Column:
    """Body, else text; whitespace stripped ('' when both missing)."""
    return X.strip_ws(F.coalesce(X.nonempty(body), text, F.lit("")))


def project_paths(df: DataFrame, paths: list[str]) -> DataFrame:
    """Keep only the listed paths, of any depth (others and unknown ones dropped).

    Structs, also those inside arrays, are rebuilt with only their kept fields; a path
    that ends at a struct keeps it whole, as does one that goes on below a plain value.
    A struct none of whose listed fields exists is dropped."""
    tree: dict = {}
    for p in paths:
        at = tree
        for name in p.split("."):
            at = at.setdefault(name, {})
        at[""] = {}  # the path ends here
    cols = [_kept(F.col(f"`{n}`"), df.schema[n].dataType, sub) for n, sub in tree.items()
            if n in df.columns]
    names = [n for n in tree if n in df.columns]
    return df.select(*[c.alias(n) for c, n in zip(cols, names) if c is not None])


def _kept(value: Column, kind: T.DataType, sub: dict) -> Column | None:
    """`value` with only the fields that `sub` names."""
    if "" in sub:
        return value
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        if not any(n in kind.elementType.names for n in sub):
            return None
        return F.transform(value, lambda x: _kept(x, kind.elementType, sub))
    if not isinstance(kind, T.StructType):
        return value
    fields = [(n, _kept(value.getField(n), kind[n].dataType, s)) for n, s in sub.items()
              if n in kind.names]
    fields = [c.alias(n) for n, c in fields if c is not None]
    return F.when(value.isNotNull(), F.struct(*fields)) if fields else None


def drop_paths(df: DataFrame, fields: list[str], nested: list[str]) -> DataFrame:
    """Drop top-level fields and nested `a.b` fields."""
    out = df.drop(*fields)
    for p in nested:
        head, _, rest = p.partition(".")
        if head in out.columns and rest:
            out = out.withColumn(head, F.col(head).dropFields(rest))
    return out


def mask_inputs(df: DataFrame, ignore_notes: bool, ignore_verdict: bool) -> DataFrame:
    """P10: take the label first, then hide notes / the verdict."""
    out = df.withColumn("label", X.verdict_label(F.col("threatInfo.analystVerdict")))
    if ignore_notes:
        out = out.withColumn("notes", F.array().cast("array<string>"))
    if ignore_verdict:
        out = out.withColumn("threatInfo", F.col("threatInfo").withField(
            "analystVerdict", F.lit(None).cast("string")))
    return out


def flatten_struct(df: DataFrame, sep: str = "_") -> DataFrame:
    """Nested struct fields to `parent_child` columns (arrays kept)."""
    def walk(typ: T.StructType, prefix: list[str]):
        for f in typ.fields:
            path = prefix + [f.name]
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, path)
            else:
                yield F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path))
    return df.select(*walk(df.schema, []))


def notes_to_text(notes, max_len: int = 5000) -> Column:
    """Notes joined by a space, cut to max_len characters."""
    return F.substring(F.concat_ws(" ", notes), 1, max_len)


def label_last(df: DataFrame, label: str = "label") -> DataFrame:
    """Label as the last column."""
    return df.select(*[c for c in df.columns if c != label], label)


def align_columns(df: DataFrame, order: list[str], categorical: list[str]) -> DataFrame:
    """Training column order; a missing numeric is NULL, a missing
    categorical is ''; extra columns dropped."""
    cols = []
    for c in order:
        if c in df.columns:
            cols.append(F.col(c))
        elif c in categorical:
            cols.append(F.lit("").alias(c))
        else:
            cols.append(F.lit(None).cast("double").alias(c))
    return df.select(*cols)


def fill_features(df: DataFrame, numeric: list[str], text: list[str]) -> DataFrame:
    """Numeric NULL → 0.0, text NULL → ''."""
    return df.fillna(0.0, subset=numeric).fillna("", subset=text)
