"""Ranks, dedupe, upserts, splits, components: properties."""

from pyspark.sql import functions as F

from threatframe.operators import agg, rank, split, upsert
from threatframe.operators.graph import linked_groups


def test_global_rank_exact_and_partition_independent(spark):
    df = spark.range(0, 1000).withColumn("g", (F.col("id") % 3 == 0).cast("int"))
    for n in (1, 3, 7):
        r = rank.global_rank(df, [("id", "desc")], partition_by=["g"], num_partitions=n)
        rows = {(x.g, x.id): x.rank for x in r.collect()}
        ids0 = sorted((i for g, i in rows if g == 0), reverse=True)
        assert [rows[(0, i)] for i in ids0] == list(range(1, len(ids0) + 1))


def test_dedupe_last_and_first(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 5, "c")], "k long, o long, v string")
    assert sorted((r.k, r.v) for r in agg.dedupe_last(df, ["k"], ["o"]).collect()) == [
        (1, "b"), (2, "c")]
    assert sorted((r.k, r.v) for r in agg.dedupe_first(df, ["k"], ["o"]).collect()) == [
        (1, "a"), (2, "c")]


def test_upsert_modes_and_idempotence(spark):
    stored = spark.createDataFrame([(1, "x", "old"), (2, "y", "old")], "k long, a string, b string")
    inc = spark.createDataFrame([(2, "Y", "new"), (3, "z", "new")], "k long, a string, b string")
    allc = {r.k: (r.a, r.b) for r in upsert.upsert(stored, inc, ["k"], "*").collect()}
    assert allc == {1: ("x", "old"), 2: ("Y", "new"), 3: ("z", "new")}
    part = {r.k: (r.a, r.b) for r in upsert.upsert(stored, inc, ["k"], ["a"]).collect()}
    assert part[2] == ("Y", "old")
    ins = {r.k: (r.a, r.b) for r in upsert.upsert(stored, inc, ["k"], []).collect()}
    assert ins[2] == ("y", "old") and ins[3] == ("z", "new")
    once = upsert.upsert(stored, inc, ["k"], "*", origin=None)
    twice = upsert.upsert(once, inc, ["k"], "*", origin=None)
    assert sorted(once.collect()) == sorted(twice.collect())


def test_unique_arbitration_nulls_never_conflict(spark):
    df = spark.createDataFrame([(1, "h", 1), (2, "h", 2), (3, None, 3), (4, None, 4)],
                               "id long, sha string, o long")
    kept, rej = upsert.unique_arbitration(df, ["sha"], ["o"], "unique_sha")
    assert sorted(r.id for r in kept.collect()) == [1, 3, 4]
    assert [r.id for r in rej.collect()] == [2]


def test_splits_disjoint_and_no_group_on_both_sides(spark):
    import datetime as dt

    rows = [(i, i % 10, dt.datetime(2000 + i % 3, 1, 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g long, t timestamp")
    r = split.random_split(df, "id").groupBy("split").count().collect()
    assert sum(x["count"] for x in r) == 300
    tg = split.temporal_group_split(df, "t", "2001-06-01", ["g"])
    train_g = {x.g for x in tg.filter("split = 'train'").collect()}
    test_g = {x.g for x in tg.filter("split = 'test'").collect()}
    assert not (train_g & test_g)
    grp = split.group_split(df, ["g"])
    assert grp.groupBy("group_key").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0


def test_linked_groups_transitive(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, "a", "x"), (4, "c", None)],
                               "id long, h1 string, h2 string")
    out = {r.id: r.group_id for r in linked_groups(df, "id", ["h1", "h2"]).collect()}
    assert out == {1: 1, 2: 1, 3: 1, 4: 4}


def test_global_rank_of_wide_rows(spark):
    """100,000 rows in several splits, all columns kept: ranks are 1..n."""
    df = spark.range(0, 100_000, 1, 6).select(
        F.xxhash64("id").alias("k"), "id", F.repeat(F.lit("x"), 50).alias("payload"))
    r = rank.global_rank(df, ["k", "id"], name="r", num_partitions=9)
    got = r.agg(F.countDistinct("r").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi"),
                F.max(F.length("payload")).alias("p")).first()
    assert (got.n, got.lo, got.hi, got.p) == (100_000, 1, 100_000, 50)


def test_components_of_a_shuffled_chain(spark):
    import random

    from threatframe.operators.graph import components

    ids = list(range(300))
    random.Random(3).shuffle(ids)
    chain = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")
    out = components(chain, "a", "b").collect()
    assert {r.component for r in out} == {0} and len(out) == 300


def test_rows_of_a_hub_stay_in_several_tasks(spark):
    """A hash that two thirds of the rows share, and one row per other hash."""
    from threatframe.operators.graph import _hang, _leasts

    rows = spark.range(0, 6000, 1, 6).select(
        "id", F.when(F.col("id") % 3 > 0, "hub").otherwise(F.col("id").cast("string")).alias("h"))
    out = _hang(rows, _leasts(rows, "h", "id"), "h", 6000).withColumn("task", F.spark_partition_id())
    got = out.collect()
    assert {(r.id, r.m) for r in got} == {(i, 1 if i % 3 else i) for i in range(6000)} and len(got) == 6000
    assert len({r.task for r in got if r.h == "hub"}) > 1
    df = rows.withColumn("h2", (F.col("id") % 1000).cast("string"))
    groups = {r.id: r.group_id for r in linked_groups(df, "id", ["h", "h2"]).collect()}
    assert set(groups.values()) == {0} and len(groups) == 6000
