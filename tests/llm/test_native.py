"""Sharding, Merkle fingerprints, licence scan against brute force."""

import hashlib
import re
import zlib

import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import cases
from threatframe.llm import license_scan, merkle, sharding
from threatframe.session import scratch_path


def test_sharding_law_and_places(spark, edge):
    path = scratch_path(spark, "test-map")
    rows = sharding.shard(edge, 3, path, slots=64).collect()
    assert len(rows) == len(cases())
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted(
        (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in cases())
    for s in range(3):
        own = sorted(r.place for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    maps = spark.read.parquet(path)
    assert sorted(r.version for r in maps.select("version").distinct().collect()) == [0, 1]
    assert maps.filter("version = 0 and shard <> slot % 3").count() == 0


def test_rebalance_evens_out_and_moves_little():
    load = {s: 100 + 37 * s % 91 for s in range(400)}
    load[7] = 5000
    first = sharding.first_map(8, 400)
    after = sharding.rebalance(first, load, 8)
    total = [sum(n for s, n in load.items() if after[s] == k) for k in range(8)]
    assert max(total) - min(total) < 200
    assert sharding.rebalance(after, load, 8) == after
    assert sum(a != b for a, b in zip(first, after)) < 120


def test_sharding_of_an_empty_table(spark, empty):
    assert sharding.shard(empty, 3, scratch_path(spark, "test-map"), slots=16).count() == 0


def leaf_hashes(text: str, n: int = merkle.LEAF_WORDS):
    run = re.compile(r"[ \t\n\x0b\f\r]*(?:[^ \t\n\x0b\f\r]+[ \t\n\x0b\f\r]*){1,%d}|"
                     r"[ \t\n\x0b\f\r]+" % n)
    tree = [[[xxhash.xxh64_intdigest(x.encode(), seed=42) for x in run.findall(p)]
             for p in s.split("\n")] for s in text.split("\n\n")]
    return [[[h - 2**64 if h >= 2**63 else h for h in p] for p in s] for s in tree]


def digest(parts) -> str:
    return hashlib.sha256(",".join(parts).encode()).hexdigest()


def test_merkle_against_brute_force(spark, edge):
    ids = F.col("doc_id").isNotNull()
    rows = merkle.fingerprint_edits(edge.filter(ids).dropDuplicates(["doc_id"])).collect()
    docs = sorted({i: t or "" for i, t in cases() if i is not None}.items())
    assert len(rows) == len(docs)
    by = {r.doc_id: r for r in rows}
    for k, (i, t) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        cut = len(t) // 4
        edited = t[:len(t) - cut] + following[:cut]
        r = by[i]
        assert r.edited == edited
        for text, root, leaves in ((t, r.fingerprint, r.leaves),
                                   (edited, r.edited_fingerprint, r.edited_leaves)):
            tree = leaf_hashes(text)
            assert root == digest([digest([digest([str(h) for h in p]) for p in s]) for s in tree])
            assert set(leaves) == {h for s in tree for p in s for h in p}
        assert set(r.next_leaves) == {h for s in leaf_hashes(following) for p in s for h in p}


def test_merkle_keeps_repeats_and_null_ids(spark, edge, empty):
    assert merkle.fingerprint_edits(edge).count() == len(cases())
    assert merkle.fingerprint_edits(empty).count() == 0
    one = merkle.fingerprint_edits(edge.filter("doc_id = 12")).first()
    assert one.edited[:10] == one.text[:10] and len(one.edited) == len(one.text)
    both = spark.createDataFrame([([], []), ([1], []), ([1, 2], [2, 3])],
                                 "a array<long>, b array<long>")
    assert [r[0] for r in both.select(merkle.likeness(F.col("a"), F.col("b"))).collect()] == \
        [1.0, 0.0, 1 / 3]


def test_merkle_locates_edits(spark):
    base = "a b c d e\nf g\n\nh i j\nk l\n\nm n"
    pairs = [(base, base, []), (base, base.replace("k", "K"), [(1, 1, 0)]),
             (base, base.replace("e\n", "E\n"), [(0, 0, 1)]),
             (base, "new\n\n" + base, [(0, 0, 0)]),
             (base, base.replace("h i j\n", "h i j\nx y\n"), [(1, 1, 0)]),
             ("p\n\nq", "q\n\np", [(0, 0, 0), (1, 0, 0)]), ("p", "p\n\np", [(1, 0, 0)]),
             ("", "w", [(0, 0, 0)])]
    df = spark.createDataFrame([p[:2] for p in pairs], "a string, b string")
    at = merkle.edit_positions(F.col("x"), F.col("y"))
    got = df.withColumn("x", merkle.branches(merkle.sections(F.col("a")))) \
        .withColumn("y", merkle.branches(merkle.sections(F.col("b")))).select(at).collect()
    assert [[tuple(p) for p in r[0]] for r in got] == [p[2] for p in pairs]


def test_license_scan_against_brute_force(spark, edge, empty):
    extra = [(90, "cc by cc by-nc 4.0 gnu\ngnu GENERAL public license"), (91, "mit  License, mit"),
             (92, "license mit apache"), (93, "Permission is hereby granted, free of charge, to")]
    docs = edge.select("doc_id", "text", "score").unionByName(
        spark.createDataFrame([(i, t, 0.0) for i, t in extra],
                              "doc_id long, text string, score double"))
    rows = license_scan.scan(docs).collect()
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = []
    for i, t in [*cases(), *extra]:
        w = [x.decode() for x in word.findall((t or "").encode().lower())]
        places = sorted((k, label) for p, label in license_scan.BASE.items() for k in range(len(w))
                        if w[k:k + len(p.split())] == p.split())
        want.append((i or -1, len(w), places))
    got = [(r.doc_id or -1, r.n_words, sorted((x.start, x.label) for x in r.found if x.base))
           for r in rows]
    assert sorted(got) == sorted(want)
    labels = {r.doc_id: {x.label for x in r.found} for r in rows}
    assert labels[21] == {"gpl", "gpl-3.0"} and labels[90] == {"cc-by", "cc-by-nc", "gpl"}
    assert labels[93] == {"mit"}
    assert all(0 <= x.score <= 1 + 1e-9 for r in rows for x in r.found)
    assert license_scan.scan(empty).count() == 0
