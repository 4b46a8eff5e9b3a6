"""Joins: interval (J1), prioritised fallback (J2), any-key (J3), nested
attach (J5/J6), reference checks (J7-J9).  Lookup joins (J4) carry no hint: AQE
decides by the size of the shuffled side.

Interval joins are planned as equi-joins on (key, time bucket) plus a range
residual, so Spark picks a sort-merge / hash join and a hot key is split across
buckets; no nested-loop or cartesian plan appears.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, Window


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def interval_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                  left_time: str, right_time: str, before_s: int, after_s: int,
                  bucket_s: int | None = None, truncate_bounds: bool = True,
                  extra_condition: Column | None = None, how: str = "inner") -> DataFrame:
    """Pairs with equal keys and right time in [lt - before, lt + after].

    Bounds are cut to whole seconds (closed interval).  The left row is
    exploded to the time buckets its window touches (at most 2 with the default
    bucket width), the right row carries its single bucket; a pair is produced
    once.  Key columns must not clash between the two sides.  With `how` left_semi,
    the left rows that have a pair, at most once per bucket.
    """
    width_us = int(bucket_s if bucket_s else max(before_s + after_s, 1)) * 1_000_000
    lt = F.col(left_time).cast("timestamp")
    lo = lt - F.make_dt_interval(secs=F.lit(before_s))
    hi = lt + F.make_dt_interval(secs=F.lit(after_s))
    if truncate_bounds:
        lo, hi = F.date_trunc("second", lo), F.date_trunc("second", hi)
    l = (left.withColumn("_lo", lo).withColumn("_hi", hi)
         .withColumn("_bucket", F.explode(F.sequence(
             F.floor(_micros(F.col("_lo")) / width_us).cast("long"),
             F.floor(_micros(F.col("_hi")) / width_us).cast("long")))))
    r = right.withColumn("_rbucket", F.floor(_micros(F.col(right_time)) / width_us).cast("long"))
    rt = F.col(right_time).cast("timestamp")
    cond = ((F.col(left_key) == F.col(right_key)) & (F.col("_bucket") == F.col("_rbucket"))
            & (rt >= F.col("_lo")) & (rt <= F.col("_hi")))
    if extra_condition is not None:
        cond = cond & extra_condition
    return l.join(r, cond, how).drop("_lo", "_hi", "_bucket", "_rbucket")


def cap_per_group(df: DataFrame, group: list[str], order: list[Column], cap: int) -> DataFrame:
    """Keep at most `cap` rows per group in a total order.

    `row_number() <= cap` is planned with a WindowGroupLimit, which trims each
    group on the map side before the shuffle.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= cap).drop("_rn")


def fallback_join(left: DataFrame, right: DataFrame, left_id: str,
                  keys: list[tuple[str, str, str]], left_time: str, right_time: str,
                  before_s: int, after_s: int, extra_condition=None) -> DataFrame:
    """Prioritised interval join (J2): try keys in order; a later key is used
    only for left rows that no earlier key matched.  Adds column `match_key`.

    `keys` is a list of (label, left_key, right_key).  What a key leaves unmatched is
    found by a semi join, which stops at a row's first match: the matches, which may be
    far more than the rows, are neither stored nor read again.
    """
    parts = []
    remaining = left
    for i, (label, lk, rk) in enumerate(keys):
        def match(how):
            return interval_join(remaining, right, lk, rk, left_time, right_time, before_s,
                                 after_s, extra_condition=extra_condition(lk, rk)
                                 if callable(extra_condition) else extra_condition, how=how)

        parts.append(match("inner").withColumn("match_key", F.lit(label)))
        if i + 1 < len(keys):
            matched = match("left_semi").select(left_id).distinct()
            remaining = remaining.join(matched, left_id, "left_anti")
    return reduce(lambda a, b: a.unionByName(b), parts)


def any_key_join(left: DataFrame, right: DataFrame, pair: list[str],
                 branches: list[tuple[list[tuple[str, str]], str]], left_time: str,
                 right_time: str, before_s: int, after_s: int) -> DataFrame:
    """Disjunctive match (J3): OR of equi-conditions as a union of interval
    joins, one per branch, one row per `pair` (a column of each side).

    Each branch is ([(left_col, right_col), ...], label); the first pair is the
    bucketed key, the rest are extra equalities.  A branch leaves out what an earlier
    one matches, so two rows meet once; only rows that share their id with another
    row of their side can give a pair twice, and only their pairs are de-duplicated.
    """
    def all_equal(cols):
        return reduce(lambda a, b: a & b, [F.col(a) == F.col(b) for a, b in cols])

    def matches(l, r):
        outs, earlier = [], None
        for cols, _label in branches:
            (lk, rk), rest = cols[0], cols[1:]
            conds = ([all_equal(rest)] if rest else []) + ([~earlier] if earlier is not None else [])
            outs.append(interval_join(l, r, lk, rk, left_time, right_time, before_s, after_s,
                                      extra_condition=reduce(lambda a, b: a & b, conds) if conds else None))
            mine = F.coalesce(all_equal(cols), F.lit(False))
            earlier = mine if earlier is None else earlier | mine
        return reduce(lambda a, b: a.unionByName(b), outs)

    def by_id(df, id_col):
        """(rows with an id of their own, the others)"""
        shared = df.groupBy(id_col).count().filter("count > 1").select(F.col(id_col).alias("_shared"))
        same = F.col(id_col).eqNullSafe(F.col("_shared"))
        return df.join(shared, same, "left_anti"), df.join(shared, same, "left_semi")

    left_id, right_id = sorted(pair, key=lambda c: c not in left.columns)
    own_l, shared_l = by_id(left, left_id)
    own_r, shared_r = by_id(right, right_id)
    repeated = matches(shared_l, right).unionByName(matches(own_l, shared_r))
    return matches(own_l, own_r).unionByName(repeated.dropDuplicates(pair))


def attach_list(parent: DataFrame, child: DataFrame, key: str, order: list[str],
                value: Column, name: str) -> DataFrame:
    """Nest child rows as an ordered array column (J5/J6); no child gives []."""
    agg = (child.groupBy(key)
           .agg(F.sort_array(F.collect_list(F.struct(*[F.col(o) for o in order],
                                                     value.alias("v")))).alias("_l")))
    agg = agg.select(key, F.transform("_l", lambda s: s["v"]).alias(name))
    return (parent.join(agg, key, "left")
            .withColumn(name, F.coalesce(F.col(name), F.array().cast(agg.schema[name].dataType))))


def reference_check(child: DataFrame, parent: DataFrame, child_col: str, parent_col: str,
                    rule: str) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) for a foreign key (J7); a NULL reference is allowed.
    One left join against the distinct parent keys, then two filters."""
    p = parent.select(F.col(parent_col).alias("_pk")).distinct().withColumn("_hit", F.lit(True))
    j = child.join(p, F.col(child_col) == F.col("_pk"), "left")
    kept = j.filter(F.col(child_col).isNull() | F.col("_hit").isNotNull()).drop("_pk", "_hit")
    rejected = (j.filter(F.col(child_col).isNotNull() & F.col("_hit").isNull())
                .drop("_pk", "_hit").withColumn("rule", F.lit(rule)))
    return kept, rejected


def delete_cascade(tables: dict[str, DataFrame], keys: dict[str, list[str]],
                   graph: list[tuple[str, str, str, str, str]], table: str,
                   deleted_keys: DataFrame) -> dict[str, DataFrame]:
    """Remove `deleted_keys` rows of `table` and, transitively, their children
    (J8); `set_null` references are nulled instead (J9).

    `graph` holds (child, child_col, parent, parent_col, action) edges,
    `keys` the key columns per table and `deleted_keys` the removed keys of
    `table`.
    """
    out = dict(tables)
    pending = [(table, deleted_keys)]
    while pending:
        name, gone = pending.pop(0)
        cols = gone.columns
        out[name] = out[name].join(gone, cols, "left_anti")
        for child, ccol, parent, pcol, action in graph:
            if parent != name or child not in out:
                continue
            g = gone.select(F.col(pcol).alias(ccol)).distinct()
            if action == "cascade":
                removed = out[child].join(g, ccol, "left_semi").select(*keys[child]).distinct()
                pending.append((child, removed))
            else:
                out[child] = set_null(out[child], g, ccol)
    return out


def set_null(child: DataFrame, gone: DataFrame, col: str) -> DataFrame:
    """Null the reference `col` where it points at a deleted parent."""
    g = gone.select(F.col(col).alias("_gone")).distinct().withColumn("_hit", F.lit(True))
    return (child.join(g, F.col(col) == F.col("_gone"), "left")
            .withColumn(col, F.when(F.col("_hit"), F.lit(None).cast(child.schema[col].dataType))
                        .otherwise(F.col(col)))
            .drop("_gone", "_hit"))
