"""Registry of named queries over the driver's test tables.

Each entry is (callable(spark, sf_dir) -> DataFrame, oracle SQL or None).
The SQL runs in DuckDB over the same Parquet files; a query without SQL is
checked by row count only (iterative or model-based operators).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def load_spread(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table for CPU-heavy work per row, dealt evenly over all cores: the test
    tables are single row groups, which one task would read and compute."""
    return load(spark, sf_dir, table).repartition(spark.sparkContext.defaultParallelism)


def load_even(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """As `load_spread`, but shuffled only where the parts that Spark reads are uneven (row
    groups are not split): long rows are then read in place."""
    df = load(spark, sf_dir, table)
    n = spark.sparkContext.defaultParallelism
    rows = df.groupBy(F.spark_partition_id()).count() \
        .agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()  # from the footers
    if rows["all"] is not None and rows["most"] * n <= 2 * rows["all"]:
        return df
    return df.repartition(max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def all_queries() -> dict[str, tuple]:
    # importing the modules fills the registry
    from threatframe.plans import (q_events, q_tables, q_text, q_models,  # noqa: F401
                                   q_stream, q_ingest, q_wired)
    return REGISTRY
