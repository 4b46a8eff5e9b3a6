"""Scalar functions and validation rules on the edge rows of FIXTURES §6."""

from pyspark.sql import functions as F

from threatframe.functions import scalars as X
from threatframe.operators import validate as V


def _one(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_hex_guard(spark):
    rows = [(None,), ("",), ("ABcd",), ("abc",), ("zz",)]
    ok = _one(spark, rows, "h string", X.is_hex("h"))
    assert ok == [None, True, True, False, False]
    b = _one(spark, rows, "h string", F.octet_length(X.hex_to_bytes("h")))
    assert b == [None, 0, 2, None, None]


def test_ids(spark):
    rows = [(None,), ("",), ("0",), ("-3",), ("abc",), ("1.5",), (" 42 ",)]
    assert _one(spark, rows, "x string", X.to_id("x")) == [0, 0, 0, -3, None, None, 42]
    assert _one(spark, rows, "x string", X.id_format_ok("x")) == [True, True, True, True,
                                                                 False, False, True]


def test_uuid(spark):
    rows = [(None,), ("",), ("123E4567-E89B-12D3-A456-426614174000",),
            ("123e4567e89b12d3a456426614174000",), ("123e4567",)]
    assert _one(spark, rows, "u string", X.is_uuid("u")) == [None, False, True, True, False]
    assert _one(spark, rows[2:4], "u string", X.canonical_uuid("u")) == [
        "123e4567-e89b-12d3-a456-426614174000"] * 2


def test_ip_and_strip(spark):
    rows = [("10.0.0.1, 10.0.0.2",), ("10.0.0.3",), (" \t x \n",)]
    assert _one(spark, rows[:2], "s string", X.first_of_list("s")) == ["10.0.0.1", "10.0.0.3"]
    assert _one(spark, rows[2:], "s string", X.strip_ws("s")) == ["x"]
    assert _one(spark, [("", "b")], "a string, b string", X.first_nonempty("a", "b")) == ["b"]


def test_parse_ts(spark):
    rows = [("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05.123+01:00",),
            ("2024-01-02T03:04:05",), ("garbage",), (None,)]
    got = _one(spark, rows, "t string", F.date_format(X.parse_ts("t"), "yyyy-MM-dd HH:mm:ss"))
    assert got == ["2024-01-02 03:04:05", "2024-01-02 02:04:05", "2024-01-02 03:04:05", None, None]


def test_verdict_label(spark):
    rows = [("TRUE_POSITIVE",), ("false_positive",), ("undefined",), (None,)]
    assert _one(spark, rows, "v string", X.verdict_label("v")) == [1, 0, None, None]


def test_validate_split_and_rejects(spark):
    df = spark.createDataFrame([("5", "acme"), ("0", "x"), ("abc", ""), ("7", " ")],
                               "tenant_id_raw string, name string")
    ok, rej = V.validate(df, V.tenant_rules(), "tenants", ["tenant_id_raw"], "2024-01-01 00:00:00")
    assert [r.tenant_id_raw for r in ok.collect()] == ["5", "7"]
    rules = sorted((r.key, r.rule) for r in rej.collect())
    assert ('{"tenant_id_raw":"0"}', "tenant_id_positive") in rules
    assert ('{"tenant_id_raw":"abc"}', "tenant_id_format") in rules
    assert ('{"tenant_id_raw":"abc"}', "name_nonempty") in rules
    # accepted + rejected rows = input rows
    assert ok.count() + rej.select("key").distinct().count() == df.count()


def test_tactic_rejected_by_bad_technique(spark):
    df = spark.createDataFrame(
        [("a", "s", [("t", "l")]), ("b", None, []), ("c", "s", [("t", None)]), ("d", "s", None)],
        "name string, source string, techniques array<struct<name:string,link:string>>")
    ok, _rej = V.validate(df, V.tactic_rules())
    assert sorted(r.name for r in ok.collect()) == ["a", "d"]


def test_enum_domain(spark):
    df = spark.createDataFrame([("resolved",), ("closed",), (None,)], "incident_status string")
    counts = {r.rule: r.n for r in V.rule_counts(df, [V._enum("incident_status",
                                                             ["unresolved", "in_progress",
                                                              "resolved"])]).collect()}
    assert counts["enum_incident_status"] == 1 and counts["accepted"] == 2


def test_ids_and_ints_of_the_whole_range(spark):
    rows = [("9223372036854775807",), ("9223372036854775808",), ("1409534255853270482",), ("-9223372036854775808",)]
    assert _one(spark, rows, "x string", X.to_id("x")) == [
        9223372036854775807, None, 1409534255853270482, -9223372036854775808]
    assert _one(spark, rows, "x string", X.id_format_ok("x")) == [True, False, True, True]
    rows = [(["2147483647", "2147483648", " 2000000000", "x", None, "1.5"],)]
    assert _one(spark, rows, "x array<string>", X.int_array("x")) == [
        [2147483647, None, 2000000000, None, None, None]]


def test_paths_of_any_depth(spark):
    from threatframe.operators.project import project_paths

    df = spark.createDataFrame(
        [(1, ((1, 2), [(3, 4)], 5), "z"), (2, None, "y")],
        "id int, a struct<b:struct<c:int,d:int>,e:array<struct<f:int,g:int>>,h:int>, k string")
    got = project_paths(df, ["id", "a.b.d", "a.e.f", "a.b.nope", "nope.x"])
    assert got.schema.simpleString() == "struct<id:int,a:struct<b:struct<d:int>,e:array<struct<f:int>>>>"
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(1, ((2,), [(3,)])), (2, None)]
    assert project_paths(df, ["a", "a.h"]).schema["a"].dataType == df.schema["a"].dataType
