"""Interval, fallback and any-key joins: bounds, priority, plans."""

import datetime as dt

from pyspark.sql import functions as F

from threatframe.operators import joins


def _ts(s):
    return dt.datetime.fromisoformat(s)


def _frames(spark):
    alerts = spark.createDataFrame([
        (1, _ts("2024-01-01 12:00:00.700"), "s1", "a1"),
        (2, _ts("2024-01-01 12:00:00"), "s9", "a2"),
        (3, _ts("2024-01-01 12:00:00"), "s8", "a8"),
    ], "alert_id long, created_at timestamp, a_story string, a_agent string")
    events = spark.createDataFrame([
        (10, _ts("2024-01-01 11:59:00"), "s1", "a1"),      # exactly on the lower bound
        (11, _ts("2024-01-01 12:01:00"), "s1", "a1"),      # exactly on the upper bound
        (12, _ts("2024-01-01 11:58:59"), "s1", "a1"),      # one second outside
        (13, _ts("2024-01-01 12:01:00.900"), "s1", "zz"),  # fraction past the cut bound
        (20, _ts("2024-01-01 12:00:30"), "sX", "a2"),      # agent of alert 2
        (21, _ts("2024-01-01 12:00:30"), "s9", "a2"),      # storyline of alert 2
    ], "event_id long, event_time timestamp, story string, agent string")
    return alerts, events


def test_interval_bounds_closed_and_cut_to_seconds(spark):
    a, e = _frames(spark)
    got = joins.interval_join(a, e, "a_story", "story", "created_at", "event_time", 60, 60)
    pairs = sorted((r.alert_id, r.event_id) for r in got.collect())
    assert pairs == [(1, 10), (1, 11), (2, 21)]


def test_fallback_prefers_first_key(spark):
    a, e = _frames(spark)
    got = joins.fallback_join(a, e, "alert_id", [("storyline", "a_story", "story"),
                                                  ("agent", "a_agent", "agent")],
                              "created_at", "event_time", 60, 60)
    rows = sorted((r.alert_id, r.event_id, r.match_key) for r in got.collect())
    # alert 2 has a storyline match, so its agent match (20) is not used
    assert rows == [(1, 10, "storyline"), (1, 11, "storyline"), (2, 21, "storyline")]


def test_fallback_uses_second_key_when_first_empty(spark):
    a, e = _frames(spark)
    e2 = e.filter(F.col("event_id") != 21)
    got = joins.fallback_join(a, e2, "alert_id", [("storyline", "a_story", "story"),
                                                   ("agent", "a_agent", "agent")],
                              "created_at", "event_time", 60, 60)
    rows = sorted((r.alert_id, r.event_id, r.match_key) for r in got.collect())
    assert (2, 20, "agent") in rows and all(r[0] != 3 for r in rows)


def test_no_nested_loop_or_cartesian(spark):
    a, e = _frames(spark)
    plans = []
    for df in (joins.interval_join(a, e, "a_story", "story", "created_at", "event_time", 60, 60),
               joins.any_key_join(a, e, ["alert_id", "event_id"],
                                  [([("a_story", "story")], "s"), ([("a_agent", "agent")], "g")],
                                  "created_at", "event_time", 60, 60)):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
    for p in plans:
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_cap_per_group(spark):
    df = spark.createDataFrame([(1, i) for i in range(5)] + [(2, 0)], "g long, v long")
    got = joins.cap_per_group(df, ["g"], [F.col("v")], 2)
    assert sorted((r.g, r.v) for r in got.collect()) == [(1, 0), (1, 1), (2, 0)]


def test_event_cap_is_the_setting_of_the_feature(spark):
    from threatframe.plans import roles

    df = spark.range(1005).selectExpr("1L AS g", "id AS v")
    assert joins.cap_per_group(df, ["g"], [F.col("v")], roles.EVENT_CAP).count() == 1000
    assert joins.cap_per_group(df, ["g"], [F.col("v")], 2).count() == 2


def test_reference_check_and_cascade(spark):
    parent = spark.createDataFrame([(1,), (2,)], "tenant_id long")
    child = spark.createDataFrame([(10, 1), (11, 3), (12, None)], "endpoint_id long, tenant_id long")
    kept, rej = joins.reference_check(child, parent, "tenant_id", "tenant_id", "fk_tenant")
    assert sorted(r.endpoint_id for r in kept.collect()) == [10, 12]
    assert [r.endpoint_id for r in rej.collect()] == [11]
    threats = spark.createDataFrame([(100, 10), (101, 12)], "threat_id long, endpoint_id long")
    out = joins.delete_cascade(
        {"tenants": parent, "endpoints": child, "threats": threats},
        {"tenants": ["tenant_id"], "endpoints": ["endpoint_id"], "threats": ["threat_id"]},
        [("endpoints", "tenant_id", "tenants", "tenant_id", "cascade"),
         ("threats", "endpoint_id", "endpoints", "endpoint_id", "cascade")],
        "tenants", spark.createDataFrame([(1,)], "tenant_id long"))
    assert [r.threat_id for r in out["threats"].collect()] == [101]


def _nodes(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_fallback_stores_no_matches(spark):
    """The matches of a key are not kept to find what is left."""
    a, e = _frames(spark)
    got = joins.fallback_join(a, e, "alert_id", [("storyline", "a_story", "story"), ("agent", "a_agent", "agent")],
                              "created_at", "event_time", 60, 60)
    assert "LeftSemi" in _nodes(got)
    assert sorted((r.alert_id, r.event_id, r.match_key) for r in got.collect()) == [
        (1, 10, "storyline"), (1, 11, "storyline"), (2, 21, "storyline")]


def test_any_key_aggregates_only_pairs_of_shared_ids(spark):
    a, e = _frames(spark)
    branches = [([("a_story", "story")], "s"), ([("a_agent", "agent")], "a")]

    def pairs(x, y):
        got = joins.any_key_join(x, y, ["alert_id", "event_id"], branches, "created_at", "event_time", 60, 60)
        return got, sorted((r.alert_id, r.event_id) for r in got.collect())

    want = [(1, 10), (1, 11), (2, 20), (2, 21)]
    got, found = pairs(a, e)
    assert found == want
    # copies of rows, also with another time, and null keys
    twice = a.unionByName(a).unionByName(a.withColumn("created_at", F.expr("created_at + interval 1 second")))
    assert set(pairs(twice, e.unionByName(e))[1]) >= set(want)
    assert len(pairs(twice, e.unionByName(e))[1]) == len(set(pairs(twice, e.unionByName(e))[1]))
    none = e.withColumn("story", F.lit(None).cast("string"))
    assert pairs(a, none)[1] == want
    # the union of the own pairs lies above no aggregate
    top = _nodes(got).split("Union", 1)[0]
    assert "Aggregate" not in top


def test_stream_match_is_keyed_by_time_too(spark):
    """An alert meets the events of its window, not all of its key."""
    from threatframe.session import scratch_path
    from threatframe.streaming import stream

    a, e = _frames(spark)
    paths = [scratch_path(spark, n) for n in ("alerts", "events")]
    for df, p in zip((a, e), paths):
        df.write.parquet(p)
    m = stream.match_stream(stream.event_source(spark, paths[0], a.schema), stream.event_source(
        spark, paths[1], e.schema), "a_story", "story", "created_at", "event_time", 60, 60)
    assert "_ebucket" in m._jdf.queryExecution().analyzed().toString()
    out = stream.run_available_now(m.select("alert_id", "event_id"), "t")
    assert sorted((r.alert_id, r.event_id) for r in spark.read.parquet(out).collect()) == [(1, 11), (2, 21)]
