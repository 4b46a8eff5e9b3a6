"""Aggregations.

De-duplication is an aggregate of a struct (min/max picks the whole winning
row).  Spark plans it as a sort aggregate, partial and final: each task sorts its
rows by key and sends one row per key on, so a hot key never needs all its rows
in one task, at the price of the sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F


def attach_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a global aggregate (exactly one row) to every row
    as scalar subqueries: evaluated once, no join of any kind in the plan."""
    out = df
    for c in one_row.columns:
        out = out.withColumn(c, one_row.select(c).scalar())
    return out


def _pick(df: DataFrame, keys: list[str], order: list[str], fn) -> DataFrame:
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                      *[F.col(c) for c in rest])
    out = df.groupBy(*keys).agg(fn(packed).alias("_w"))
    return out.select(*keys, *[F.col(f"_w._o{i}").alias(c) for i, c in enumerate(order)],
                      *[F.col(f"_w.{c}") for c in rest])


def dedupe_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A1: one row per key, the last in `order` wins (order must be total)."""
    return _pick(df, keys, order, F.max)


def dedupe_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A2: one row per key, the first in `order` wins."""
    return _pick(df, keys, order, F.min)


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """A3: rows per class."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """A4: one row (n_neg, n_pos, w_pos = n_neg / n_pos)."""
    out = df.agg(F.count_if(F.col(label) == 0).alias("n_neg"),
                 F.count_if(F.col(label) == 1).alias("n_pos"))
    return out.withColumn("w_pos", F.when(F.col("n_pos") > 0,
                                          F.col("n_neg") / F.col("n_pos")))


def with_weight_col(df: DataFrame, label: str = "label", name: str = "weight") -> DataFrame:
    """Attach the A4 weight per row (1 for class 0, n_neg/n_pos for class 1)."""
    w = class_weight(df, label).select("w_pos")
    return (attach_one_row(df, w)
            .withColumn(name, F.when(F.col(label) == 1, F.col("w_pos")).otherwise(F.lit(1.0)))
            .drop("w_pos"))


def frequency_map(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """A10: category → share of rows."""
    name = name or f"{col}_freq"
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return (attach_one_row(df.groupBy(col).agg(F.count(F.lit(1)).alias("_n")), total)
            .select(col, (F.col("_n") / F.col("_total")).alias(name)))


def frequency_encode(df: DataFrame, col: str, fmap: DataFrame, name: str | None = None,
                     unseen: float = 0.0) -> DataFrame:
    """Join a frequency map back; unseen categories get `unseen`."""
    name = name or f"{col}_freq"
    return (df.join(fmap, col, "left")
            .withColumn(name, F.coalesce(F.col(name), F.lit(unseen))))


def event_profile(pairs: DataFrame, alert_id: str, type_col: str, types: list[str],
                  severity: str, amount: str | None = None) -> DataFrame:
    """Per alert, event count, count per known type, max severity and an
    optional sum; conditional aggregates instead of an open pivot."""
    aggs: list[Column] = [F.count(F.col(type_col)).alias("n_events")]
    aggs += [F.count_if(F.col(type_col) == t).alias(f"n_{t}") for t in types]
    aggs.append(F.max(severity).alias("max_severity"))
    if amount:
        aggs.append(F.sum(amount).alias(f"sum_{amount}"))
    return pairs.groupBy(alert_id).agg(*aggs)


class RunningCounts:
    """Counts that the jobs of a run gather on the way, without a job of their own.

    `watch` marks a frame that the run materialises once; `frame` is asked for after
    that and gives (stage, metric, n), from one row per watched frame.  With `on` false
    nothing is counted."""

    def __init__(self, on: bool = True):
        self.on = on
        self._seen: list[tuple[str, Observation]] = []

    def watch(self, stage: str, df: DataFrame, **metrics: Column) -> DataFrame:
        """Count the rows of `df`, and further aggregates by name."""
        if not self.on:
            return df
        seen = Observation()
        self._seen.append((stage, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"),
                          *[c.alias(n) for n, c in metrics.items()])

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(stage, metric, int(n or 0)) for stage, seen in self._seen
                for metric, n in seen.get.items()]
        return spark.createDataFrame(rows, "stage string, metric string, n long")


def audit_counts(stage_frames: dict[str, DataFrame]) -> DataFrame:
    """Rows per stage as one long frame (stage, n)."""
    from functools import reduce

    parts = [f.agg(F.count(F.lit(1)).alias("n")).withColumn("stage", F.lit(s))
             for s, f in stage_frames.items()]
    return reduce(lambda a, b: a.unionByName(b), parts).select("stage", "n")
