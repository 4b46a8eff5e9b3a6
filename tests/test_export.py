"""One export document read by many tasks equals the reader of whole documents."""

import json

import pytest
from pyspark.sql import functions as F

from threatframe.schemas import EXPORT
from threatframe.sources.export import scan_export
from threatframe.sources.scan import scan_threats


def alert(i):
    odd = ['plain', 'br}ace {"x": [}', 'quo\\"te " and \\ back', 'é 日本 }]', '\\\\" }', ''][i % 6]
    return {"id": str(i), "threatInfo": {"threatId": str(i), "threatName": odd, "filePath": "C:\\x\\" + odd},
            "notes": [odd, "second }"] if i % 3 else [],
            "indicators": [{"category": odd, "ids": [i, 2]}] if i % 4 else None}


def multi_line(spark, path):
    rows = spark.read.schema(EXPORT).option("multiLine", True).json(path)
    return rows.select("exported_at", F.posexplode("threats").alias("pos", "t")).select(
        "t.*", "exported_at", "pos")


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("indent,first", [(None, True), (2, True), (None, False), (1, False)])
def test_equals_whole_documents(spark, tmp_path, small_splits, indent, first):
    at = {"exported_at": "2024-02-01T00:00:00Z"}
    threats = {"threats": [alert(i) for i in range(120)]}
    for name, n in (("a", 120), ("b", 7), ("c", 1)):
        body = {"threats": threats["threats"][:n]}
        (tmp_path / f"{name}.json").write_text(json.dumps({**at, **body} if first else {**body, **at},
                                                          indent=indent))
    got = scan_export(spark, str(tmp_path))
    want = multi_line(spark, str(tmp_path))
    cols = [c for c in got.columns if c != "_ordinal"]

    def rows(df, pos):
        return sorted(json.dumps([r.asDict(True) for r in [x]], sort_keys=True, default=str) for x in
                      df.select(*cols, pos).collect())

    assert rows(got, F.col("_ordinal.pos").cast("int").alias("pos")) == rows(want, "pos")
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 4


@pytest.mark.parametrize("text", ["", "{}", '{"threats": []}', '{"exported_at": "x", "threats": null}',
                                  '{"exported_at": "x"}\n'])
def test_without_records(spark, tmp_path, text):
    (tmp_path / "e.json").write_text(text)
    assert scan_export(spark, str(tmp_path)).count() == 0


def test_null_records_and_missing_date(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"threats": [null, {"id": "1"}, null, {"id": "2"}]}')
    got = scan_threats(spark, str(tmp_path), envelope=True).orderBy("_ordinal").collect()
    assert [(r.id, r.exported_at) for r in got] == [("1", None), ("2", None)]
