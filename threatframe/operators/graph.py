"""Connected components and linked groups (M3).

`components` alternates large-star and small-star steps on an edge list: a
large-star hangs every larger neighbour of a node on the smallest neighbour, a
small-star does the same for the smaller ones.  The number of edges does not
grow, and the rounds are polylogarithmic in the number of nodes for any id
order.  It runs until a round changes no edge; it has no round limit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from threatframe.session import cut_lineage


#: A key with more than 1/HEAVY of the rows is joined by broadcast: HEAVY keys at most.
HEAVY = 400


def _leasts(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, m, _n): least value and number of rows of every key."""
    return rows.groupBy(key).agg(F.min(value).alias("m"), F.count(F.lit(1)).alias("_n"))


def _hang(rows: DataFrame, leasts: DataFrame, key: str, n: int) -> DataFrame:
    """The `n` rows or fewer joined with `leasts`.  A hub's rows stay where they are: by a
    shuffle one task would sort them all."""
    heavy = F.broadcast(leasts.filter(F.col("_n") * HEAVY > n).drop("_n"))
    light = leasts.filter(F.col("_n") * HEAVY <= n).drop("_n")
    return rows.join(heavy, key).unionByName(
        rows.join(heavy.select(key), key, "left_anti").join(light, key))


def _large_star(e: DataFrame, n: int) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    m = _leasts(both, "u", "v").select("u", F.least("u", "m").alias("m"), "_n")
    return (_hang(both.filter("v > u"), m, "u", 2 * n)
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(e: DataFrame, n: int) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    m = _leasts(down, "u", "v")
    hung = _hang(down, m, "u", n).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(m.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): every node that an edge a-b with a <> b names, with
    the smallest node it is connected to.  Null ends are ignored."""
    e = cut_lineage(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
                    .filter("u <> v").distinct())
    state = None
    while True:
        new = e.agg(F.count(F.lit(1)).alias("n"),
                    F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (new.n, new.h) == state or new.n == 0:
            break
        state = (new.n, new.h)
        e = cut_lineage(_large_star(e, new.n))  # read four times
        e = cut_lineage(_small_star(e, new.n))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def linked_groups(df: DataFrame, id_col: str, hash_cols: list[str],
                  name: str = "group_id") -> DataFrame:
    """Add `name` = smallest id in the row's component (rows without any hash
    are their own group).  Each hash hangs its rows on its smallest row, so a
    hash shared by n rows makes n edges."""
    parts = []
    n = df.count()
    for h in hash_cols:
        rows = df.filter(F.col(h).isNotNull()).select(F.col(id_col).alias("node"),
                                                      F.col(h).alias("hash"))
        parts.append(_hang(rows, _leasts(rows, "hash", "node"), "hash", n)
                     .select("node", F.col("m").alias("least")))
    found = components(reduce(lambda x, y: x.unionByName(y), parts), "node", "least")
    found = found.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    return (df.join(found, F.col(id_col) == F.col("_node"), "left")
            .withColumn(name, F.coalesce("_component", F.col(id_col)))
            .drop("_node", "_component"))
