"""Order of linked records by pointer doubling.

Pages name the cursor of the next one.  Every page starts with a pointer to the page
before it and a distance of one; each round replaces a page's pointer by its target's
and adds the distances, so after log2(length) rounds every page knows its place and the
head of its chain.  A round is one equi-join on the pointer; nothing is collected but
the number of pages still moving.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from threatframe.session import cut_lineage


class BrokenChain(ValueError):
    """Pages whose cursors do not form chains."""


def chain_places(pages: DataFrame, key: str = "cursor", following: str = "next_cursor",
                 group: str = "batch", strict: bool = True) -> DataFrame:
    """Add `place` (0 for a chain's first page) and `fault` to `pages`.

    A page is found by `key` (null: the first page of its `group`) and names the next by
    `following` (null: the last).  Faults: `repeated` (several pages of a group have one
    key), `missing` (no page of the group names it, and it is not the first), `cycle`
    (the pages before it come back to it), `forked` (two pages name it).  A page behind
    a faulty one is `missing`.  With `strict`, any fault raises BrokenChain; otherwise
    faulty pages have a null place.  Keys of different groups are different; a null
    group is one group."""
    named = pages.withColumn("_g", F.coalesce(F.col(group).cast("string"), F.lit(""))) \
        .withColumn("_id", F.coalesce(F.concat(F.lit("c"), F.col(key)), F.lit("first"))) \
        .withColumn("_to", F.concat(F.lit("c"), F.col(following)))
    held = named.groupBy("_g", "_id").agg(F.count(F.lit(1)).alias("_pages"))
    namers = named.filter("_to is not null").groupBy("_g", F.col("_to").alias("_id")).agg(
        F.count(F.lit(1)).alias("_named"), F.min("_id").alias("_before"))
    at = held.join(namers, ["_g", "_id"], "left")
    fault = (F.when(F.col("_pages") > 1, "repeated").when(F.col("_named") > 1, "forked")
             .when((F.col("_id") != "first") & F.col("_named").isNull(), "missing")
             .when((F.col("_id") == "first") & F.col("_named").isNotNull(), "cycle"))
    at = cut_lineage(at.select("_g", "_id", fault.alias("fault"),
                               F.when(F.col("_id") != "first", F.col("_before")).alias("_up"),
                               F.when(F.col("_id") == "first", 0).otherwise(1).cast("long").alias("place")))
    n = at.count()
    rounds = max(1, n).bit_length() + 1
    for _ in range(rounds):
        moving = at.filter(F.col("fault").isNull() & F.col("_up").isNotNull())
        if moving.isEmpty():
            break
        up = at.select("_g", F.col("_id").alias("_up"), F.col("_up").alias("_up2"),
                       F.col("place").alias("_more"), F.col("fault").alias("_fault2"))
        step = at.join(up, ["_g", "_up"], "left")
        going = F.col("fault").isNull() & F.col("_up").isNotNull()
        at = cut_lineage(step.select(
            "_g", "_id",
            F.when(going & (F.col("_more").isNull() | F.col("_fault2").isNotNull()), "missing")
            .otherwise(F.col("fault")).alias("fault"),
            F.when(going, F.col("_up2")).otherwise(F.col("_up")).alias("_up"),
            F.when(going, F.col("place") + F.coalesce("_more", F.lit(0))).otherwise(F.col("place"))
            .alias("place")))
    # who still moves after enough rounds for any chain goes round in a circle
    at = at.withColumn("fault", F.when(F.col("fault").isNull() & F.col("_up").isNotNull(), "cycle")
                       .otherwise(F.col("fault"))).drop("_up")
    at = at.withColumn("place", F.when(F.col("fault").isNull(), F.col("place")))
    if strict:
        bad = at.filter("fault is not null").select("fault", "_g", "_id").limit(5).collect()
        if bad:
            raise BrokenChain("; ".join(f"{r['fault']}: {r['_g']}/{r['_id']}" for r in bad))
    return named.drop("_to").join(at, ["_g", "_id"]).drop("_g", "_id")
