"""Scans (S1-S6) with declared schemas.

JSON Lines is the scalable landing format; a large export envelope is split too (see
`export`).  Every scan adds `_ordinal` = (file, position): the batch order
that last-wins and first-wins rules need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from threatframe.functions import scalars as X
from threatframe.operators.chains import chain_places
from threatframe.operators.project import map_columns, note_text
from threatframe.schemas import ALERT, ALERT_PAGE, EVENT_COLUMNS, LANDED_PAGE, NOTE_PAGE
from threatframe.sources.export import scan_export


def _with_ordinal(df: DataFrame) -> DataFrame:
    return df.withColumn("_ordinal", F.struct(F.input_file_name().alias("file"),
                                              F.monotonically_increasing_id().alias("pos")))


def scan_threats(spark: SparkSession, path: str, envelope: bool = False) -> DataFrame:
    """Alert documents; JSON Lines, or the export envelope
    `{exported_at, threats: [...]}` (missing key → no rows)."""
    if not envelope:
        return _with_ordinal(spark.read.schema(ALERT).json(path))
    return scan_export(spark, path)


def scan_pages(spark: SparkSession, path: str, by_cursor: bool = False,
               strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """S3 + U1 + A9: landed alert pages → (alerts, page audit).  The audit
    compares the reported `totalItems` with the rows seen per page file.

    The batch order is that of the files, or with `by_cursor` that of the pages' cursors
    (each page says which cursor it was asked with), whatever the files are called; a
    broken or cyclic chain raises, or with `strict` off its pages are left out and shown
    in the audit's `fault`."""
    pages = spark.read.schema(LANDED_PAGE if by_cursor else ALERT_PAGE).json(path) \
        .withColumn("_file", F.input_file_name())
    token = F.coalesce(X.nonempty("pagination.nextCursor"), X.nonempty("nextPageToken"))
    if by_cursor:
        pages = chain_places(pages.withColumn("_next", token), "cursor", "_next", "batch", strict) \
            .withColumnRenamed("place", "_page")
        order = F.struct(F.col("batch").alias("file"), F.col("_page").alias("page"))
    else:
        pages = pages.withColumn("_page", F.monotonically_increasing_id())
        order = F.struct(F.col("_file").alias("file"), F.col("_page").alias("page"))
    alerts = pages.filter(F.col("_page").isNotNull()).select(order.alias("_o"), F.posexplode(
        F.coalesce("data", F.array().cast(T.ArrayType(ALERT)))).alias("_i", "a")).select(
        "a.*", F.struct("_o.file", "_o.page", F.col("_i").cast("long").alias("pos")).alias("_ordinal"))
    audit = pages.select("_file", F.col("pagination.totalItems").alias("total_items"),
                         F.size(F.coalesce("data", F.array())).alias("seen"),
                         F.col("pagination.nextCursor").alias("next_cursor"),
                         F.col("nextPageToken").alias("next_page_token"),
                         *([F.col("batch"), F.col("_page").alias("place"), F.col("fault")]
                           if by_cursor else []))
    return alerts, audit


def scan_notes(spark: SparkSession, path: str) -> DataFrame:
    """S4 + P7: landed note pages → (threat_id text, position, note);
    blank notes dropped."""
    pages = spark.read.schema(NOTE_PAGE).json(path)
    rows = pages.select("threat_id", F.posexplode(F.coalesce("data", F.array().cast(
        NOTE_PAGE["data"].dataType))).alias("pos", "n"))
    out = rows.select("threat_id", "pos", note_text(F.col("n.body"), F.col("n.text")).alias("note"))
    return out.filter(F.col("note") != "")


def scan_events(spark: SparkSession, path: str, fmt: str = "parquet",
                schema: T.StructType | None = None) -> DataFrame:
    """S5 + P1: landed event rows (source or output names) → the typed event
    columns plus storyline."""
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    return map_columns(r.load(path))


def scan_feature_csv(spark: SparkSession, path: str, numeric: list[str],
                     label: str = "label", text: str = "notes_text") -> DataFrame:
    """Feature CSV with header; label as int, text NULL → ''."""
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in numeric]
                          + [T.StructField(text, T.StringType()),
                             T.StructField(label, T.IntegerType())])
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.withColumn(text, F.coalesce(F.col(text), F.lit("")))


__all__ = ["scan_threats", "scan_pages", "scan_notes", "scan_events", "scan_feature_csv",
           "EVENT_COLUMNS"]
