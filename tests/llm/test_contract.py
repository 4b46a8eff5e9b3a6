"""Columns, types and plain facts of every registered query of the subpackage."""

import pytest

from tests.conftest import SF_SMALL
from threatframe.llm.queries import QUERIES

LONG, INT, TEXT, REAL, FLAG = "bigint", "int", "string", "double", "boolean"
CONTRACT = {
    "op2_sharding": {"doc_id": LONG, "size": LONG, "text_crc32": LONG, "law": TEXT, "shard": INT,
                     "slot": LONG, "grown_shard": INT},
    "op3_merkle": {"doc_id": LONG, "n_chars": LONG, "edited_sha256": TEXT, "fingerprint": TEXT,
                   "edited_fingerprint": TEXT, "near_edited": REAL, "near_next": REAL},
    "op4_quality": {"doc_id": LONG, "held_out": FLAG, "score": REAL, "predicted": INT},
    "op5_shingle_join": {"doc_id": LONG, "n_shingles": LONG, "component_id": LONG},
    "op6_packing": {"doc_id": LONG, "start": LONG, "length": LONG, "ids_crc32": LONG,
                    "doc_tokens": LONG, "sequence_id": LONG, "offset": LONG},
    "op7_language_id": {"doc_id": LONG, "held_out": FLAG, "lang_pred": TEXT, "score": REAL},
    "op8_license_scan": {"doc_id": LONG, "n_words": LONG, "n_base": LONG, "first_word": LONG,
                         "last_word": LONG, "base_labels": TEXT, "labels": TEXT, "score": REAL},
    "op9_token_files": {"doc_id": LONG, "start": LONG, "n_tokens": LONG, "ids_crc32": LONG},
    "op10_byte_bpe": {"doc_id": LONG, "n_tokens": LONG, "ids_sha256": TEXT, "decoded_sha256": TEXT},
}
PER_DOCUMENT = set(CONTRACT) - {"op6_packing"}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_contract(spark, name):
    df = QUERIES[name][0](spark, SF_SMALL)
    types = dict(df.dtypes)
    assert {c: types.get(c) for c in CONTRACT[name]} == CONTRACT[name]
    rows = df.collect()
    docs = sorted(r.doc_id for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect())
    if name in PER_DOCUMENT:
        assert sorted(r.doc_id for r in rows) == docs
    else:
        assert {r.doc_id for r in rows} == set(docs)
    for column in ("score", "near_edited", "near_next"):
        if column in CONTRACT[name]:
            assert all(0 <= r[column] <= 1 for r in rows)
    if name == "op2_sharding":
        total = {}
        for r in rows:
            total[r.shard] = total.get(r.shard, 0) + r.size
        assert set(total) <= set(range(40)) and r.law == "bytes"
        # sizes are near equal: no shard is off the mean by more than its largest document
        mean, most = sum(total.values()) / 40, max(r.size for r in rows)
        assert all(abs(n - mean) <= most for n in total.values())
        slots = {}
        for r in rows:
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_hot_groups_are_dealt_by_block_pair(spark, monkeypatch):
    """Block pairs of one component, or of one list, lie in several partitions."""
    from threatframe.llm import pivot_index, shingle_join

    seen = []
    kept = shingle_join.written

    def watch(df, name, *rest):
        if name in ("jaccard-inside", "pivot-links"):
            plan = df._jdf.queryExecution().executedPlan().toString()
            seen.append((name, plan))
        return kept(df, name, *rest)

    monkeypatch.setattr(shingle_join, "written", watch)
    monkeypatch.setattr(pivot_index, "written", watch)
    monkeypatch.setattr(shingle_join, "BLOCK", 4)
    monkeypatch.setattr(pivot_index, "BLOCK", 8)
    words = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(i, " ".join(words[:50] + [f"x{i}"])) for i in range(24)],
                                 "doc_id long, text string")
    got = shingle_join.jaccard_components(docs, 3, 80, 100).collect()
    assert {(r.component_id, r.n_links) for r in got} == {(0, 23)}
    vectors = spark.createDataFrame([(i, [1.0, 0.001 * i, 0.0], 1) for i in range(40)],
                                    "vec_id long, embedding array<double>, label int")
    got = pivot_index.near_duplicates(vectors, 0.98).collect()
    assert {(r.component_id, r.n_links) for r in got} == {(0, 39)}
    assert [n for n, _ in seen] == ["jaccard-inside", "pivot-links"]
    assert "hashpartitioning(group" in seen[0][1] and ", lo" in seen[0][1].split("hashpartitioning(group", 1)[1][:40]
    assert "pivot" in seen[1][1] and "lo" in seen[1][1].split("hashpartitioning(label", 1)[1][:60]
