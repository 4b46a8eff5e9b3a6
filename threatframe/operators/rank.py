"""Ranking and running totals without a single-partition window.

`global_rank` and `running_total` split the total order into ranges whose
bounds are literals: one small job samples keys, the chosen bounds are written
into the bucket expression, so every later use of the frame computes the same
bucket (unlike a range exchange, which samples its own bounds each time it is
planned).  A window then runs per bucket and the totals of the buckets before
are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

SAMPLE_PER_BUCKET = 20


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def _directed(order: list) -> list[tuple[Column, bool]]:
    """Order entries as (column, ascending); an entry is a name, a column or
    (name or column, "asc" | "desc")."""
    out = []
    for o in order:
        o, way = o if isinstance(o, tuple) else (o, "asc")
        out.append((F.col(o) if isinstance(o, str) else o, way == "asc"))
    return out


def _sort_cols(keys: list[tuple[Column, bool]]) -> list[Column]:
    return [c.asc_nulls_first() if up else c.desc_nulls_last() for c, up in keys]


def _before(names: list[str], ups: list[bool], types: list[str], bound: tuple) -> Column:
    """True where the key columns come strictly before `bound` in the order."""
    cond = F.lit(False)
    for name, up, kind, b in reversed(list(zip(names, ups, types, bound))):
        k = F.col(name)
        if b is None:
            less = F.lit(False) if up else k.isNotNull()
            same = k.isNull()
        else:
            v = F.lit(b).cast(kind)
            less = (k.isNull() | F.coalesce(k < v, F.lit(False))) if up else \
                F.coalesce(k > v, F.lit(False))
            same = F.coalesce(k == v, F.lit(False))
        cond = less | (same & cond)
    return cond


def with_range_bucket(df: DataFrame, order: list, n: int | None = None,
                      name: str = "_bucket") -> DataFrame:
    """Add `name`: the number (0..n-1) of the range of `order` a row falls in.

    Bounds come from a uniform sample of SAMPLE_PER_BUCKET rows per bucket and
    are literals of a balanced CASE tree, so the column is a pure function of
    the row.  The bounds decide only how even the buckets are.
    """
    keys = _directed(order)
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f"_k{i}" for i in range(len(keys))]
    ups = [up for _, up in keys]
    only = df.select(*[c.alias(k) for (c, _), k in zip(keys, names)])
    types = [only.schema[k].dataType.simpleString() for k in names]
    sample = only.orderBy(F.rand(11)).limit(SAMPLE_PER_BUCKET * n)
    rows = [tuple(r) for r in sample.orderBy(
        *_sort_cols([(F.col(k), up) for k, up in zip(names, ups)])).collect()]
    bounds = list(dict.fromkeys(rows[i * len(rows) // n] for i in range(1, n))) if rows else []

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(_before(names, ups, types, bounds[mid]), tree(lo, mid)) \
            .otherwise(tree(mid + 1, hi))

    wide = df.select("*", *[c.alias(k) for (c, _), k in zip(keys, names)])
    return wide.withColumn(name, tree(0, len(bounds))).drop(*names)


def _with_earlier(df: DataFrame, keys: list, groups: list[str], value: Column, name: str,
                  n: int | None) -> DataFrame:
    """Add `name` = sum of `value` over the rows before, within the groups."""
    full = list(groups) + list(keys)
    b = with_range_bucket(df, full, n)
    w = Window.partitionBy("_bucket", *groups).orderBy(*_sort_cols(_directed(keys)))
    inside = b.withColumn("_in", F.coalesce(
        F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per = b.groupBy("_bucket", *groups).agg(F.sum(value).alias("_n"))
    ow = (Window.partitionBy(*groups) if groups else Window.partitionBy()).orderBy("_bucket")
    per = (per.withColumn("_off", F.sum("_n").over(ow.rowsBetween(Window.unboundedPreceding, -1)))
           .filter(F.col("_off").isNotNull())
           .select(F.col("_bucket").alias("_ob"), "_off",
                   *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)]))
    # A group has an offset only in the buckets after the one it starts in, and
    # groups follow one another in the order: at most one row per bound.
    cond = F.col("_bucket") == F.col("_ob")
    for i, g in enumerate(groups):
        cond = cond & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = inside.join(F.broadcast(per), cond, "left")
    return (out.withColumn(name, F.coalesce(F.col("_off"), F.lit(0)) + F.col("_in"))
            .drop("_bucket", "_in", "_ob", "_off", *[f"_g{i}" for i in range(len(groups))]))


def global_rank(df: DataFrame, order: list, partition_by: list[str] | None = None,
                name: str = "rank", num_partitions: int | None = None) -> DataFrame:
    """Add `name` = 1-based position in `order` (must be a total order),
    restarted for each `partition_by` group."""
    out = _with_earlier(df, order, list(partition_by or []), F.lit(1).cast("long"), name,
                        num_partitions)
    return out.withColumn(name, F.col(name) + 1)


def running_total(df: DataFrame, order: list, value: str, name: str,
                  num_partitions: int | None = None,
                  partition_by: list[str] | None = None) -> DataFrame:
    """Add `name` = sum of the long column `value` over all rows of the group
    that come before in `order` (a total order)."""
    return _with_earlier(df, order, list(partition_by or []), F.col(value).cast("long"), name,
                         num_partitions)


def occurrence_number(df: DataFrame, key: list[str], order: list, name: str = "occurrence"):
    """1, 2, ... among rows with the same natural key (e.g. equal notes of
    one alert), by range buckets, so a key may hold any number of rows."""
    return global_rank(df, order, partition_by=key, name=name) \
        .withColumn(name, F.col(name).cast("int"))


def top_k(df: DataFrame, order: list, k: int) -> DataFrame:
    """L1/L3: k first rows in a total order (TakeOrderedAndProject: each task
    keeps its own k best, the driver merges n·k rows)."""
    return df.orderBy(*_cols(order)).limit(k)


def sample_cap(df: DataFrame, id_col: str, k: int | None, seed: int = 42) -> DataFrame:
    """L2: optional cap on the number of alerts, taken in seeded hash order."""
    if k is None:
        return df
    from threatframe.functions.scalars import hash_fraction

    return df.orderBy(hash_fraction(seed, F.col(id_col)), F.col(id_col)).limit(k)
