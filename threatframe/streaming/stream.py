"""Structured Streaming forms.

* R1 `ingest_stream`   landed alert documents → `foreachBatch(ingest)`;
                       idempotent because every table step is an upsert.
* R2 `match_stream`    stream-stream inner join of alerts and events on the
                       storyline with an event-time range; watermarks on both
                       sides bound the join state.
* R3 `dedupe_stream`   `dropDuplicatesWithinWatermark` on (threat, time, type).

The prioritised fallback (J2) needs the final absence of matches, so it
stays a batch step inside R1's `foreachBatch`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from threatframe.session import ensure_checkpoint_dir, scratch_path


def event_source(spark: SparkSession, directory: str, schema, file_glob: str | None = None,
                 fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """File stream of landed events (Parquet or JSON), schema declared."""
    r = spark.readStream.schema(schema).format(fmt)
    if file_glob:
        r = r.option("pathGlobFilter", file_glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(directory)


def dedupe_stream(events: DataFrame, time_col: str, keys: list[str],
                  watermark: str = "60 days") -> DataFrame:
    """First arrival per key within the watermark; later copies dropped."""
    return events.withWatermark(time_col, watermark).dropDuplicatesWithinWatermark(keys)


def match_stream(alerts: DataFrame, events: DataFrame, alert_key: str, event_key: str,
                 alert_time: str, event_time: str, before_s: int, after_s: int,
                 watermark: str = "2 hours", extra=None) -> DataFrame:
    """R2: inner stream-stream interval join; events later than the
    watermark are dropped, as in any watermarked join.

    The state is kept by key and time bucket, as in the batch join (J1): an alert goes to
    the buckets its window touches (2, or 3 at most where it ends on a bound), an event
    has one, so an alert meets the events around it and not all of its key."""
    width_us = max(before_s + after_s, 1) * 1_000_000

    def bucket(at):
        return F.floor(F.unix_micros(at) / width_us).cast("long")

    lo = F.col(alert_time) - F.make_dt_interval(secs=F.lit(before_s))
    hi = F.col(alert_time) + F.make_dt_interval(secs=F.lit(after_s))
    a = alerts.withWatermark(alert_time, watermark).withColumn(
        "_bucket", F.explode(F.sequence(bucket(lo), bucket(hi))))
    e = events.withWatermark(event_time, watermark).withColumn("_ebucket", bucket(F.col(event_time)))
    cond = ((F.col(alert_key) == F.col(event_key)) & (F.col("_bucket") == F.col("_ebucket"))
            & (F.col(event_time) >= F.col(alert_time) - F.make_dt_interval(secs=F.lit(before_s)))
            & (F.col(event_time) <= F.col(alert_time) + F.make_dt_interval(secs=F.lit(after_s))))
    if extra is not None:
        cond = cond & extra
    return a.join(e, cond, "inner").drop("_bucket", "_ebucket")


def run_available_now(df: DataFrame, name: str, out_path: str | None = None,
                      foreach_batch=None, checkpoint: str | None = None) -> str:
    """Run a streaming frame over all available input, then stop.

    Output goes to Parquet under the shared checkpoint directory (append,
    exactly once through the sink's commit log), or through `foreach_batch`.
    `checkpoint` is the query's durable checkpoint: a later run with the same
    one reads only what is new.  Without it the run starts afresh.  Returns the
    output path."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    out_path = out_path or scratch_path(spark, f"stream-{name}-out")
    ckpt = checkpoint or scratch_path(spark, f"stream-{name}-ckpt")
    w = df.writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True)
    if foreach_batch is not None:
        q = w.foreachBatch(foreach_batch).start()
    else:
        q = w.format("parquet").outputMode("append").start(out_path)
    q.awaitTermination()
    return out_path


def ingest_stream(spark: SparkSession, docs_dir: str, store_root: str, as_of: str,
                  schema=None, checkpoint: str | None = None) -> None:
    """Landed alert documents (JSON Lines) → ingest per micro-batch into
    the versioned store.  The checkpoint lies beside the store by default, so a
    second run reads no file again; even if it did, nothing would change."""
    from threatframe.plans.ingest import ingest_into
    from threatframe.schemas import ALERT
    from threatframe.sources.store import write_table

    src = spark.readStream.schema(schema or ALERT).json(docs_dir)

    def batch(bdf: DataFrame, epoch: int) -> None:
        # batch order: epoch, then position in the (deterministically split) files
        bdf = bdf.withColumn("_ordinal", F.struct(
            F.lit(epoch).cast("long").alias("epoch"), F.input_file_name().alias("file"),
            F.monotonically_increasing_id().alias("pos")))
        rejects = ingest_into(spark, store_root, bdf, as_of)
        write_table(rejects, store_root, f"rejects_epoch_{epoch}")

    run_available_now(src, "ingest", foreach_batch=batch,
                      checkpoint=checkpoint or f"{store_root.rstrip('/')}/_stream_checkpoint")
