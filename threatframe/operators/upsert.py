"""Table maintenance without MERGE.

Plain Parquet has no MERGE, so an upsert is a full outer join of the stored
table with the (key-unique) incoming rows: one shuffle of both sides on the
key, after which every column is picked per row.  Written back through the
versioned store (`sources.store`), readers keep the previous version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threatframe.operators.agg import dedupe_first


def _lit_ts(as_of: str | None) -> Column:
    return F.to_timestamp(F.lit(as_of)) if as_of else F.current_timestamp()


def upsert(stored: DataFrame, incoming: DataFrame, key: list[str], update="*",
           as_of: str | None = None, touch: str | None = None,
           insert_only: tuple[str, ...] = (), origin: str | None = "origin") -> DataFrame:
    """Merge `incoming` (unique per key) into `stored`.

    * ``update="*"``  every non-key column from incoming on conflict (T2);
    * ``update=[..]`` only those columns (T3/T4); the rest keep stored values;
    * ``update=[]``   insert if absent, the stored row wins (T1).
    ``touch`` is set to ``as_of`` on every inserted or updated row (T13);
    ``insert_only`` columns are set to ``as_of`` on insert only (T12).
    """
    cols = stored.columns
    s = stored.select(*[F.col(c).alias(f"_s_{c}") for c in cols]).withColumn("_s_hit", F.lit(True))
    i = incoming.select(*[F.col(c).alias(f"_i_{c}") for c in cols if c in incoming.columns]) \
        .withColumn("_i_hit", F.lit(True))
    cond = None
    for k in key:
        c = F.col(f"_s_{k}") == F.col(f"_i_{k}")
        cond = c if cond is None else cond & c
    j = s.join(i, cond, "full_outer")
    in_s, in_i = F.col("_s_hit").isNotNull(), F.col("_i_hit").isNotNull()
    now = _lit_ts(as_of)
    out = []
    for c in cols:
        sc = F.col(f"_s_{c}")
        ic = F.col(f"_i_{c}") if c in incoming.columns else F.lit(None).cast(stored.schema[c].dataType)
        if c in key:
            v = F.coalesce(sc, ic)
        elif c == touch:
            v = F.when(in_i & (F.lit(update != []) | ~in_s), now).otherwise(sc)
        elif c in insert_only:
            v = F.when(in_s, sc).otherwise(now)
        elif update == "*" or (isinstance(update, (list, tuple)) and c in update):
            v = F.when(in_i, ic).otherwise(sc)
        else:
            v = F.when(in_s, sc).otherwise(ic)
        out.append(v.cast(stored.schema[c].dataType).alias(c))
    if origin:
        out.append(F.when(in_s & in_i, F.lit("updated" if update != [] else "kept"))
                   .when(in_s, F.lit("stored")).otherwise(F.lit("inserted")).alias(origin))
    return j.select(*out)


def insert_if_absent(stored: DataFrame, incoming: DataFrame, key: list[str],
                     order: list[str], origin: str = "origin") -> DataFrame:
    """First incoming row per key (A2), appended only when the key is not
    stored yet; stored rows are never changed."""
    first = dedupe_first(incoming, key, order).select(*stored.columns)
    new = first.join(stored.select(*key), key, "left_anti")
    return (stored.withColumn(origin, F.lit("stored"))
            .unionByName(new.withColumn(origin, F.lit("inserted"))))


def unique_arbitration(df: DataFrame, unique: list[str], order: list[str],
                       rule: str) -> tuple[DataFrame, DataFrame]:
    """One row per unique key survives (first in `order`); rows
    with a NULL key part never conflict.  Returns (kept, rejected+rule)."""
    from functools import reduce

    from pyspark.sql import Window

    has_null = reduce(lambda a, b: a | b, [F.col(u).isNull() for u in unique])
    w = Window.partitionBy(*unique).orderBy(*[F.col(o) for o in order])
    ranked = df.filter(~has_null).withColumn("_rn", F.row_number().over(w))
    kept = ranked.filter(F.col("_rn") == 1).drop("_rn").unionByName(df.filter(has_null))
    rejected = ranked.filter(F.col("_rn") > 1).drop("_rn").withColumn("rule", F.lit(rule))
    return kept, rejected
