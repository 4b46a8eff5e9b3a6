"""One large export document as many tasks.

An envelope `{exported_at, threats: [...]}` is a single JSON value, which a reader of
whole documents takes in one task.  Here it is read as text that ends a row at every
closing brace, so Spark splits the file.  What a brace means depends on all text before
it (inside a string or not, and how deep), so three running sums per file block, each
continued over the blocks before, give every piece its place: the parity of quotation
marks, the depth, and the number of records that have ended.  The pieces of a record
are joined again and parsed; a record is one alert, of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from threatframe.schemas import ALERT
from threatframe.session import cut_lineage

_HEAD = r'(?s)^(.*?)"threats"\s*:\s*\['
_EXPORTED = r'"exported_at"\s*:\s*"([^"]*)"'
_BLOCK = ["_file", "_block"]


def _running(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Add `name`: the sum of `value` over the pieces of the file before this one.

    A window runs per file block (bounded by the split size), another over the totals
    of a file's blocks."""
    before = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*_BLOCK).orderBy("_pos").rowsBetween(*before)
    blocks = Window.partitionBy("_file").orderBy("_block").rowsBetween(*before)
    df = df.withColumn("_v", value)
    totals = df.groupBy(*_BLOCK).agg(F.sum("_v").alias("_t")).select(
        *_BLOCK, F.coalesce(F.sum("_t").over(blocks), F.lit(0)).alias("_before"))
    return df.withColumn("_in", F.coalesce(F.sum("_v").over(inside), F.lit(0))) \
        .join(totals, _BLOCK).withColumn(name, F.col("_in") + F.col("_before")) \
        .drop("_v", "_in", "_before")


def _count(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, signs, ""))


def scan_export(spark: SparkSession, path: str) -> DataFrame:
    """The alerts of export envelopes, with `exported_at` of their file (null if absent)
    and `_ordinal` = (file, number of the record).

    The order of the envelope's members and all white space are free; braces, brackets
    and quotation marks inside strings are text.  Null records are left out.  `threats`
    is the envelope's only array of objects."""
    pieces = spark.read.option("lineSep", "}").text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_pos"))
    pieces = cut_lineage(pieces)  # read once: the numbers stay
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    quoted = _running(pieces, _count(plain, '"'), "_quotes")
    # the text outside strings: a piece that starts inside one gets its opening mark back
    whole = F.when(F.col("_quotes") % 2 == 1, F.concat(F.lit('"'), plain)).otherwise(plain)
    outside = F.regexp_replace(F.regexp_replace(whole, '"[^"]*"', ""), '"[^"]*$', "")
    closes = (F.col("_quotes") + _count(plain, '"')) % 2 == 0  # the brace after it counts
    deep = quoted.withColumn("_step", (_count(outside, "{[") - _count(outside, "]")
                                       - closes.cast("int")).cast("long")) \
        .withColumn("_closes", closes)
    deep = _running(deep, F.col("_step"), "_depth")
    ended = deep.withColumn("_ends", F.col("_closes") & (F.col("_depth") + F.col("_step") == 2))
    placed = _running(ended, F.col("_ends").cast("long"), "_record")
    records = placed.groupBy("_file", "_record").agg(
        F.sort_array(F.collect_list(F.struct("_block", "_pos", "value"))).alias("_pieces"),
        F.max("_ends").alias("_whole")) \
        .withColumn("_text", F.concat(F.array_join(F.transform("_pieces", lambda p: p["value"]), "}"),
                                      F.lit("}"))).drop("_pieces")
    records = cut_lineage(records)
    outer = records.filter("_record = 0 or not _whole").select("_file", F.regexp_extract(
        F.when(F.col("_whole"), F.regexp_extract("_text", _HEAD, 1)).otherwise(F.col("_text")),
        _EXPORTED, 1).alias("_at")).groupBy("_file").agg(
        F.max(F.when(F.col("_at") != "", F.col("_at"))).alias("exported_at"))
    own = F.when(F.col("_record") == 0, F.regexp_replace("_text", _HEAD, "")).otherwise(F.col("_text"))
    alert = F.from_json(F.regexp_replace(own, r"^(?:[\s,]|null)*", ""), ALERT)
    return records.filter("_whole").withColumn("_alert", alert).join(outer, "_file", "left") \
        .select("_alert.*", "exported_at",
                F.struct(F.col("_file").alias("file"), F.col("_record").alias("pos")).alias("_ordinal"))
