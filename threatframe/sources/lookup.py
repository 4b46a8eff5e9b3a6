"""Threats laid out for lookups (T17): by file hash, by tenant and time.

Plain Parquet by Spark's own writer: one folder per period (a day, or a month where days
are small), files sorted by tenant and time, and Bloom filters on the hash columns, so a
time window reads the folders of its periods, a tenant the row groups of its range, and
a hash only row groups whose filter may hold it.  Periods are dealt by (period, hash of
the id), so one that holds a third of all rows is several tasks and files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

HASHES = ("sha256", "sha1", "md5")
PERIOD = "created_period"  # first day of the period
#: Rows of one task of a period, which is dealt over as many tasks as it needs.
ROWS_PER_TASK = 5_000_000


def write_lookup(threats: DataFrame, path: str, id_col: str = "threat_id", tenant_col: str = "tenant_id",
                 time_col: str = "created_at", distinct_hashes: int = 1_000_000,
                 rows_per_task: int = ROWS_PER_TASK, period: str = "day") -> None:
    """Write `threats` under `path`, replacing the periods ("day" or "month") it holds."""
    dated = threats.withColumn(PERIOD, F.date_trunc(period, F.col(time_col)).cast("date"))
    # one row per period
    tasks = dated.groupBy(PERIOD).agg(F.ceil(F.count(F.lit(1)) / rows_per_task).cast("int").alias("_n"))
    dealt = dated.join(tasks, dated[PERIOD].eqNullSafe(tasks[PERIOD])).drop(tasks[PERIOD]) \
        .withColumn("_part", F.pmod(F.xxhash64(id_col), F.col("_n")))
    writer = dealt.repartition(PERIOD, "_part").drop("_n", "_part") \
        .sortWithinPartitions(PERIOD, tenant_col, time_col, id_col) \
        .write.mode("overwrite").partitionBy(PERIOD).option("partitionOverwriteMode", "dynamic")
    for c in HASHES:
        if c in threats.columns:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true") \
                .option(f"parquet.bloom.filter.expected.ndv#{c}", str(distinct_hashes))
    writer.parquet(path)


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def by_hash(threats: DataFrame, col: str, values: list[str]) -> DataFrame:
    """Threats with one of a few stated hashes: an equality that reaches the filters."""
    return threats.filter(F.col(col).isin(list(values)))


def in_window(threats: DataFrame, start: str, end: str, tenant: int | None = None,
              tenant_col: str = "tenant_id", time_col: str = "created_at", period: str = "day") -> DataFrame:
    """Threats created in [start, end), of one tenant if given; reads those periods only."""
    t, lo, hi = F.col(time_col).cast("timestamp"), F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end))
    # a period of up to a month that holds `start` began a month before it at most
    first = F.add_months(F.to_date(F.lit(start)), -1) if period == "month" else F.to_date(F.lit(start))
    found: Column = (F.col(PERIOD) >= first) & (F.col(PERIOD) <= F.to_date(F.lit(end))) \
        & (t >= lo) & (t < hi)
    return threats.filter(found if tenant is None else found & (F.col(tenant_col) == tenant))
