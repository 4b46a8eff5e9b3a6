"""Ingest of nested alert documents: edge rows, rejects, idempotence."""

import json

from pyspark.sql import functions as F

from threatframe.plans.ingest import ingest_into
from threatframe.sources.scan import scan_pages, scan_threats
from threatframe.sources.store import read_table

AS_OF = "2024-02-01 00:00:00"
SHA_A = "a" * 64
UUID1 = "123e4567-e89b-12d3-a456-426614174000"


def doc(tid, acct="5", name="Acme", agent="77", uuid=UUID1, sha=SHA_A, ident="2024-01-01T00:00:00Z",
        verdict="true_positive", notes=None, indicators=None, deepvis=None, status="resolved"):
    return {
        "id": tid,
        "threatInfo": {"threatId": tid, "storyline": "s1", "analystVerdict": verdict,
                       "incidentStatus": status, "detectionType": "static",
                       "createdAt": "2024-01-01T00:00:00Z", "identifiedAt": ident,
                       "sha256": sha, "md5": None, "sha1": None, "fileSize": "10"},
        "agentDetectionInfo": {"accountId": acct, "accountName": name, "agentIpV4": "",
                               "groupId": "3"},
        "agentRealtimeInfo": {"agentId": agent, "agentUuid": uuid,
                              "agentLocalIpV4": "10.0.0.1, 10.0.0.2", "groupId": ""},
        "notes": notes, "indicators": indicators, "deepvis": deepvis,
    }


DOCS = [
    doc("1", notes=["hello", " \t", "hello"], verdict="false_positive",
        indicators=[{"category": "c", "description": "d", "ids": ["1", "x"],
                     "tactics": [{"name": "t1", "source": "s", "techniques": [{"name": "k", "link": "l"}]},
                                 {"name": "t2", "source": "s", "techniques": [{"name": "k", "link": None}]},
                                 {"name": "t3", "source": None, "techniques": []}]},
                    {"category": "c2", "description": None, "ids": None, "tactics": None}],
        deepvis=[{"eventTime": "2024-01-01T00:00:10Z", "eventType": "proc", "severity": 1},
                 {"eventTime": "2024-01-01T00:00:10Z", "eventType": "proc", "severity": 2}]),
    doc("1", verdict="true_positive"),                    # same threat again: last wins
    doc("2", ident="2024-01-01T00:00:00Z"),               # same (tenant, sha, identified) as 1
    doc("3", sha=None), doc("4", sha=None),               # NULL sha never conflicts
    doc("abc"),                                           # non-numeric id → reject
    doc("6", acct="0"),                                   # tenant id 0 → reject
    doc("7", agent="88", uuid="not-a-uuid"),              # endpoint rejected → fk_endpoint
    doc("8", status="closed", sha="b" * 64),              # unknown label → null and a log row
]


def _land(tmp_path, docs, name="docs"):
    p = tmp_path / name
    p.mkdir()
    with open(p / "part-0.json", "w") as f:
        for d in docs:
            f.write(json.dumps(d) + "\n")
    return str(p)


def _run(spark, path, root):
    return ingest_into(spark, root, scan_threats(spark, path), AS_OF)


def test_ingest_edges_and_idempotence(spark, tmp_path):
    path = _land(tmp_path, DOCS)
    root = str(tmp_path / "store")
    rejects = _run(spark, path, root)
    threats = {r.threat_id: r for r in read_table(spark, root, "threats").collect()}
    assert sorted(threats) == [1, 3, 4, 8]
    assert threats[8].incident_status is None
    assert threats[1].analyst_verdict == "true_positive"          # last wins
    rules = {(r.key, r.rule) for r in rejects.collect()}
    assert any(k == '{"threat_id":2}' and rule == "unique_threat" for k, rule in rules)
    assert any("abc" in (k or "") and rule == "threat_id_format" for k, rule in rules)
    assert any(rule == "fk_endpoint" for _k, rule in rules)
    assert any(rule == "enum_incident_status" for _k, rule in rules)
    ep = read_table(spark, root, "endpoints").collect()
    assert [(e.endpoint_id, e.ip_v4, e.group_id) for e in ep] == [(77, "10.0.0.1", 3)]
    notes = sorted((n.note, n.occurrence) for n in read_table(spark, root, "threat_notes").collect())
    assert notes == [("hello", 1), ("hello", 2)]  # the first copy's notes, blanks rejected
    tac = sorted(t.name for t in read_table(spark, root, "indicator_tactics").collect())
    assert tac == ["t1"]
    # second run of the same batch changes nothing
    before = {t: sorted(read_table(spark, root, t).drop("ingested_at", "last_updated_at").collect())
              for t in ("tenants", "endpoints", "threats", "threat_notes")}
    _run(spark, path, root)
    after = {t: sorted(read_table(spark, root, t).drop("ingested_at", "last_updated_at").collect())
             for t in before}
    assert before == after


def test_indicators_notes_events(spark, tmp_path):
    path = _land(tmp_path, [DOCS[0]])
    root = str(tmp_path / "store")
    rejects = _run(spark, path, root)
    notes = sorted((n.note, n.occurrence) for n in read_table(spark, root, "threat_notes").collect())
    assert notes == [("hello", 1), ("hello", 2)]                 # blank note rejected
    ind = sorted((i.position, i.ids) for i in read_table(spark, root, "threat_indicators").collect())
    assert ind == [(0, [1, None]), (1, [])]
    tac = sorted(t.name for t in read_table(spark, root, "indicator_tactics").collect())
    assert tac == ["t1"]                                          # t2 bad technique, t3 no source
    tech = [t.name for t in read_table(spark, root, "tactic_techniques").collect()]
    assert tech == ["k"]
    ev = read_table(spark, root, "deepvis_events").collect()
    assert [(e.event_type, e.severity) for e in ev] == [("proc", 1)]  # first per key
    assert {r.rule for r in rejects.collect()} >= {"note_nonempty", "tactic_techniques",
                                                   "tactic_source"}
    _run(spark, path, root)
    assert read_table(spark, root, "threat_indicators").count() == 2
    assert read_table(spark, root, "indicator_tactics").count() == 1
    assert read_table(spark, root, "deepvis_events").count() == 1
    assert read_table(spark, root, "threat_notes").count() == 2


def test_export_envelope_and_pages(spark, tmp_path):
    p = tmp_path / "export.json"
    p.write_text(json.dumps({"exported_at": "2024-02-01T00:00:00Z", "threats": DOCS[:3]}))
    df = scan_threats(spark, str(p), envelope=True)
    assert df.count() == 3 and df.select("exported_at").distinct().count() == 1
    q = tmp_path / "pages"
    q.mkdir()
    (q / "p1.json").write_text(json.dumps({"data": DOCS[:2], "pagination": {
        "nextCursor": "c2", "totalItems": 3}}) + "\n")
    (q / "p2.json").write_text(json.dumps({"data": DOCS[2:3], "pagination": {
        "nextCursor": None, "totalItems": 3}}) + "\n")
    alerts, audit = scan_pages(spark, str(q))
    assert alerts.count() == 3
    assert audit.agg(F.sum("seen")).first()[0] == 3


def test_copies_and_stored_keys(spark, tmp_path):
    """One alert twice stores its note once; a stored endpoint keeps its unique key;
    events without a type and notes of unknown alerts are rejected."""
    root = str(tmp_path / "store")
    twice = doc("1", notes=["n"])
    _run(spark, _land(tmp_path, [twice, twice], "a"), root)
    assert [(n.note, n.occurrence) for n in read_table(spark, root, "threat_notes").collect()] == [
        ("n", 1)]
    second = [doc("9", agent="99", sha="c" * 64, notes=["x"],
                  deepvis=[{"eventTime": "2024-01-01T00:00:10Z", "severity": 1}]),
              doc("10", sha="d" * 64, deepvis=[{"eventTime": "2024-01-01T00:00:10Z"}])]
    rejects = _run(spark, _land(tmp_path, second, "b"), root)
    assert [e.endpoint_id for e in read_table(spark, root, "endpoints").collect()] == [77]
    rules = {(r.table, r.rule) for r in rejects.collect()}
    assert {("endpoints", "unique_tenant_uuid"), ("threat_notes", "fk_threat"),
            ("deepvis_events", "not_null_event_type")} <= rules


def test_page_ordinals_are_unique(spark, tmp_path):
    q = tmp_path / "pages"
    q.mkdir()
    page = {"data": DOCS[:2], "pagination": {"nextCursor": None, "totalItems": 4}}
    (q / "p.json").write_text((json.dumps(page) + "\n") * 2)
    alerts, _audit = scan_pages(spark, str(q))
    assert alerts.select("_ordinal").distinct().count() == alerts.count() == 4


def test_store_raises_on_other_errors(spark, tmp_path):
    import pytest
    from threatframe.sources.store import current_version

    root = str(tmp_path / "store")
    assert current_version(spark, root, "tenants") is None
    bad = tmp_path / "store" / "tenants" / "commits" / "version=00000001"
    bad.mkdir(parents=True)
    (bad / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        current_version(spark, root, "tenants")


def test_untouched_files_stay_in_place(spark, tmp_path):
    """A second batch rewrites only the months it touches and appends child rows."""
    root = str(tmp_path / "store")
    first = [doc("1", notes=["a"]), doc("2", sha="e" * 64)]
    first[1]["threatInfo"]["createdAt"] = "2024-03-01T00:00:00Z"
    _run(spark, _land(tmp_path, first, "a"), root)
    before = {t: set(read_table(spark, root, t).inputFiles()) for t in ("threats", "threat_notes")}
    third = doc("3", sha="f" * 64, notes=["b"])
    third["threatInfo"]["createdAt"] = "2024-03-09T00:00:00Z"
    _run(spark, _land(tmp_path, [third], "b"), root)
    after = {t: set(read_table(spark, root, t).inputFiles()) for t in before}
    assert before["threat_notes"] < after["threat_notes"]
    kept = before["threats"] & after["threats"]
    assert {f for f in before["threats"] if "2024-01" in f} == kept != before["threats"]
    assert sorted(r.threat_id for r in read_table(spark, root, "threats").collect()) == [1, 2, 3]
    assert read_table(spark, root, "threat_notes").count() == 2


def test_indicator_tables_start_from_finished_ones(spark):
    """Three nested ranks must not read the documents 27 times."""
    from threatframe.plans.ingest import normalise_indicators
    from threatframe.schemas import ALERT

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    docs = spark.createDataFrame([(1, None)], f"threat_id long, indicators {ALERT['indicators'].dataType.simpleString()}")
    ind, tac, tech, _ = normalise_indicators(docs.mapInArrow(count, docs.schema))
    assert (ind.count(), tac.count(), tech.count()) == (0, 0, 0)
    assert seen.value == 1


def test_landed_pages_are_whole_and_small(spark):
    """Pages of runs that several tasks write are whole and follow the keys, also where
    keys repeat at a run's edge; the files are compressed."""
    import glob

    from threatframe.plans.q_ingest import land_pages
    from threatframe.session import scratch_path

    keys = [*range(50), *[50] * 9, *range(51, 120)]
    docs = spark.createDataFrame([(k, f"d{k}") for k in keys], "_key long, name string")
    path = land_pages(docs, scratch_path(spark, "pages"), page_size=3)
    pages = spark.read.json(path).select(
        F.coalesce(F.col("cursor").cast("int"), F.lit(0)).alias("n"), "data.name",
        "pagination").orderBy("n").collect()
    assert [p.n for p in pages] == list(range(43))
    assert [x for p in pages for x in p.name] == [f"d{k}" for k in keys]
    assert [len(p.name) for p in pages] == [3] * 42 + [2]
    assert {p.pagination.totalItems for p in pages} == {128} and pages[-1].pagination.nextCursor is None
    files = glob.glob(path.removeprefix("file:") + "/part-*")
    assert files and all(f.endswith(".gz") for f in files)


def test_an_ingest_leaves_its_tables_and_rejects_only(spark, tmp_path):
    """No row checkpoints, which are not compressed; what the steps of a batch
    materialise is gone after it, the rejects stay readable."""
    import os

    from threatframe.session import ensure_checkpoint_dir

    shared = ensure_checkpoint_dir(spark).removeprefix("file:")
    path = _land(tmp_path, DOCS)
    before = set(os.listdir(shared))
    rejects = _run(spark, path, str(tmp_path / "store"))
    left = set(os.listdir(shared)) - before
    assert len(left) == 1 and left.pop().startswith("rows-")
    assert rejects.filter("table = 'threats'").count() > 0
    assert read_table(spark, str(tmp_path / "store"), "threats").count() > 0


def test_landed_documents_are_gzipped_in_batch_order(spark, tmp_path):
    """The batch order is that of the keys, from the files' names and places."""
    from threatframe.plans.q_ingest import alert_documents, land_documents

    docs = alert_documents(spark, "/root/testdata/sf0.001")
    path = land_documents(docs, str(tmp_path / "docs"))
    files = [f for f in (tmp_path / "docs").iterdir() if f.name.startswith("part-")]
    assert files and all(f.name.endswith(".json.gz") for f in files)
    assert sum(f.stat().st_size for f in files) < 300 * docs.count()  # as text 1,000 a document
    got = scan_threats(spark, path).orderBy("_ordinal.file", "_ordinal.pos").select("id").collect()
    assert [int(r.id) for r in got] == sorted(r._key for r in docs.select("_key").collect())
