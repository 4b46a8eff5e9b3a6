"""Laid-out lookups and the order of linked pages."""

import random

import pytest
from pyspark.sql import functions as F

from threatframe.operators.chains import BrokenChain, chain_places
from threatframe.session import scratch_path
from threatframe.sources import lookup


def _scan_metric(df, name: str) -> int:
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply(name).value() for i in range(leaves.size()))


@pytest.fixture(scope="module")
def laid(spark):
    path = scratch_path(spark, "test-lookup")
    t = spark.range(4000).select(
        F.col("id").alias("threat_id"), (F.col("id") % 7).alias("tenant_id"),
        F.expr("timestamp'2024-03-01' + make_dt_interval(cast(id % 10 as int), 0, cast(id % 60 as int))")
        .alias("created_at"),
        F.sha2(F.col("id").cast("string"), 256).alias("sha256"), F.md5(F.col("id").cast("string")).alias("md5"))
    lookup.write_lookup(t, path, distinct_hashes=4000, rows_per_task=150)
    return t, lookup.read_lookup(spark, path)


def test_window_reads_its_days_only(laid):
    t, stored = laid
    got = lookup.in_window(stored, "2024-03-03", "2024-03-05", 4)
    want = t.filter("tenant_id = 4 and created_at >= '2024-03-03' and created_at < '2024-03-05'")
    assert {r.threat_id for r in got.collect()} == {r.threat_id for r in want.collect()} != set()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(created_period" in plan
    assert _scan_metric(got, "numPartitions") == 3 and _scan_metric(stored, "numPartitions") == 10
    assert _scan_metric(got, "numFiles") < _scan_metric(stored, "numFiles") / 2


def test_hash_skips_row_groups(spark, laid):
    t, stored = laid
    one = t.filter("threat_id = 1234").first()
    for col in ("sha256", "md5"):
        got = lookup.by_hash(stored, col, [one[col]])
        assert [r.threat_id for r in got.collect()] == [1234]
        # row groups without the hash are not read although its range covers them
        assert _scan_metric(got, "numOutputRows") < 1000
        assert lookup.by_hash(stored, col, ["0" * 64]).count() == 0


def test_a_day_is_replaced_and_others_stay(spark):
    path = scratch_path(spark, "test-lookup")
    cols = "threat_id long, tenant_id long, created_at timestamp, sha1 string"
    import datetime as dt

    a = [(1, 1, dt.datetime(2024, 1, 1, 5), "x"), (2, 1, dt.datetime(2024, 1, 2, 5), "y"), (3, 1, None, "z")]
    lookup.write_lookup(spark.createDataFrame(a, cols), path)
    lookup.write_lookup(spark.createDataFrame([(9, 1, dt.datetime(2024, 1, 2, 6), "w")], cols), path)
    assert {r.threat_id for r in lookup.read_lookup(spark, path).collect()} == {1, 3, 9}


def pages(spark, rows):
    return spark.createDataFrame(rows, "batch string, cursor string, next_cursor string, n int").repartition(3)


def test_places_of_long_and_short_chains(spark):
    rows = []
    for batch, n in (("a", 1), ("b", 2), ("c", 37)):
        names = [None] + [f"{batch if n < 9 else ''}x{random.Random(k).random()}" for k in range(1, n)]
        rows += [(batch, names[k], names[k + 1] if k + 1 < n else None, k) for k in range(n)]
    rows += [("d", None, "x0.1", 0), ("d", "x0.1", None, 1)]
    random.Random(1).shuffle(rows)
    got = chain_places(pages(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.place == r.n and r.fault is None for r in got)


@pytest.mark.parametrize("rows,faults", [
    ([("a", None, "p", 0), ("a", "q", None, 1)], {1: "missing"}),
    ([("a", None, "p", 0), ("a", "p", "q", 1), ("a", "r", "s", 2), ("a", "s", "r", 3)],
     {2: "cycle", 3: "cycle"}),
    ([("a", None, "p", 0), ("a", "p", None, 1), ("a", "p", None, 2)], {1: "repeated", 2: "repeated"}),
    ([("a", None, "p", 0), ("a", "q", "p", 1), ("a", "p", "z", 2), ("a", "z", None, 3)],
     {1: "missing", 2: "forked", 3: "missing"}),
    ([("a", None, "p", 0), ("a", None, None, 1)], {0: "repeated", 1: "repeated"}),
])
def test_faulty_chains(spark, rows, faults):
    df = pages(spark, rows)
    got = {r.n: (r.place, r.fault) for r in chain_places(df, strict=False).collect()}
    assert {n: f for n, (_, f) in got.items() if f} == faults
    assert all((p is None) == bool(f) for p, f in got.values())
    with pytest.raises(BrokenChain):
        chain_places(df)


def test_no_pages(spark):
    assert chain_places(pages(spark, []).limit(0)).count() == 0


def test_shuffled_pages_take_as_many_files_as_the_data_needs(spark):
    """Not four tasks whatever the size."""
    from threatframe.plans.q_ingest import alert_documents, land_pages
    from threatframe.session import scratch_path

    docs = alert_documents(spark, "/root/testdata/sf0.001").filter("_key < 400")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = land_pages(docs, scratch_path(spark, "pages"), page_size=4, shuffled=True)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    pages = spark.read.json(path)
    assert len(pages.inputFiles()) > 4 and pages.count() == -(-docs.count() // 4)
