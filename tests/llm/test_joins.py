"""Shingle join, pivot index and the pipeline against brute force."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tests.conftest import SF_SMALL
from tests.llm.conftest import cases, prose
from threatframe.llm import pivot_index, shingle_join
from threatframe.llm.common import table


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def classes(nodes, linked):
    """Smallest reachable node of each node."""
    least = {n: n for n in nodes}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        least[b] = a
    return {n: find(n) for n in nodes}


def brute(rows, k, num, den):
    sets = [(i, shingle_set(t, k)) for i, t in rows if i is not None]
    linked = [(i, j) for n, (i, a) in enumerate(sets) for j, b in sets[:n]
              if a and b and den * len(a & b) >= num * len(a | b)]
    return classes({i for i, _ in sets}, linked)


def family(n: int) -> list[tuple]:
    """Documents with shared passages, and a family of copies with one to six edits each."""
    r = random.Random(9)
    base = prose(70, 160).split()
    out = [(i, prose(1000 + i, r.randint(5, 120))) for i in range(n)]
    for i in range(n, 3 * n):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"edit{r.randrange(400)}"
        out.append((i, " ".join(w)))
    shared = " ".join(base[:30])
    return out + [(3 * n + i, f"{shared} {prose(i, 40)}") for i in range(n)]


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 8, 10)])
def test_shingle_join_against_brute_force(spark, k, num, den):
    rows = family(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = shingle_join.jaccard_components(docs, k, num, den).collect()
    want = brute(rows, k, num, den)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(shingle_set(t, k)) for i, t in rows}
    assert len(set(want.values())) < len(rows) - 20


def test_shingle_join_hard_cases(spark, edge, empty):
    got = shingle_join.jaccard_components(edge, 3, 90, 100).collect()
    assert len(got) == len(cases())
    want = brute(cases(), 3, 90, 100)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert want[11] == want[12] == 10 and want[15] == 15
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert {r.doc_id: r.n_shingles for r in got}[14] == 0
    assert shingle_join.jaccard_components(empty).count() == 0


def test_overlap_bound_never_underestimates():
    r = np.random.default_rng(4)
    for _ in range(200):
        n, common = int(r.integers(1, 400)), int(r.integers(0, 400))
        shared = r.integers(0, 2**63, common).astype(np.uint64)
        a = np.unique(np.concatenate([shared, r.integers(0, 2**63, n).astype(np.uint64)]))
        b = np.unique(np.concatenate([shared, r.integers(0, 2**63, 30).astype(np.uint64)]))
        bound = shingle_join.overlap_bound(shingle_join.cells(a), shingle_join.cells(b))
        assert bound >= len(np.intersect1d(a, b))


def test_word_hashes_follow_the_words():
    text = b"The  cat\tsat\nthe CAT \x0b sat\r\n\xc3\x89t\xc3\xa9 "
    words = text.lower().split()
    hashes = shingle_join.word_hashes(text)
    assert len(hashes) == len(words)
    assert len(set(hashes.tolist())) == len(set(words))
    assert len(shingle_join.word_hashes(b" \n")) == 0 == len(shingle_join.word_hashes(b""))


def vectors() -> list[tuple]:
    r = np.random.default_rng(3)
    rows = []
    for c in range(12):
        centre = r.normal(size=64)
        for _ in range(20):
            rows.append((len(rows), (centre + r.normal(scale=0.09 + 0.004 * c, size=64)).tolist(),
                         c % 2))
    for x in r.normal(size=(300, 64)):
        rows.append((len(rows), x.tolist(), int(r.integers(2))))
    return rows


def test_pivot_index_recall_and_precision(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    x = np.array([v for _, v, _ in rows], np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([c for _, _, c in rows])
    hit = (x @ x.T >= 0.98) & (label[:, None] == label) & ~np.eye(len(x), dtype=bool)
    got = {r.vec_id: r for r in pivot_index.near_duplicates(df, 0.98).collect()}
    n = np.array([got[i].n_links for i in range(len(x))])
    assert (n <= hit.sum(1)).all() and n.sum() >= 0.99 * hit.sum() > 0
    want = classes(range(len(x)), zip(*np.nonzero(np.triu(hit))))
    assert np.mean([got[i].component_id == want[i] for i in want]) >= 0.99
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_pivot_index_blocks_of_a_hot_list(spark, monkeypatch):
    monkeypatch.setattr(pivot_index, "BLOCK", 16)
    rows = vectors()[:60]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    small = {r.vec_id: (r.n_links, r.component_id)
             for r in pivot_index.near_duplicates(df, 0.98).collect()}
    monkeypatch.undo()
    assert small == {r.vec_id: (r.n_links, r.component_id)
                     for r in pivot_index.near_duplicates(df, 0.98).collect()}


def test_pivot_index_hard_cases(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, v, 1), (3, [2.0, 4.0, 6.0], 1), (4, None, 1), (5, [0.0] * 3, 1),
            (6, [float("nan"), 1.0, 2.0], 1), (7, [float("inf"), 1.0, 2.0], 1),
            (8, [None, 1.0, 2.0], 1), (9, v, None), (10, v, 2), (11, [1.0, 2.0], 1), (12, [], 1),
            (1, v, 1), (13, [-1.0, -2.0, -3.0], 1), (14, [1e-30, 2e-30, 3e-30], 1)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows],
                               "vec_id long, embedding array<double>, label int, node long, "
                               "kept string")
    got = pivot_index.near_duplicates(df, 0.98).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: (r.n_links, r.component_id) for r in got}
    assert by[1] == by[2] == by[3] == by[14] == (4, 1)
    assert all(by[i] == (0, i) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12, 13))
    none = pivot_index.near_duplicates(df.filter("vec_id < 0"), 0.98)
    assert none.count() == 0


def test_pipeline_stages(spark):
    docs = table(spark, SF_SMALL, "documents")
    kept = corpus_pipeline.identify_language(spark, docs, SF_SMALL)
    assert kept.columns == corpus_pipeline.COLUMNS
    wordy = {r.doc_id for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)}
    assert {r.doc_id for r in kept.collect()} == wordy
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    left = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF_SMALL).collect()}
    want = brute(rows, 5, 8, 10)
    assert left == set(want.values())


def test_pipeline_hard_cases(spark, edge, empty):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, edge, SF_SMALL)
        assert got.columns == corpus_pipeline.COLUMNS
        assert got.count() <= len(cases())
        assert stage(spark, empty, SF_SMALL).count() == 0
    left = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, edge, "").collect()]
    assert sorted(left, key=lambda i: i or -1) == [None, 10, *range(13, 25)]
    assert corpus_pipeline.pack_sequences(spark, edge, "").count() >= len(cases())


@pytest.mark.parametrize("block", [1024, 16])
def test_shingle_join_loses_no_link(spark, monkeypatch, block):
    """Every link of a family of near copies is counted, and listed once per pair of sets."""
    monkeypatch.setattr(shingle_join, "BLOCK", block)
    rows = family(40)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = {i: shingle_set(t, 5) for i, t in rows}
    near = {(i, j) for i in sets for j in sets if i < j
            and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])}
    got = shingle_join.jaccard_components(docs, 5, 8, 10).collect()
    assert {r.doc_id: r.n_links for r in got} == {i: sum(i in p for p in near) for i in sets}
    links, members = shingle_join.jaccard_links(docs, 5, 8, 10)
    node = {r.doc_id: r.node for r in members.collect()}
    found = [(r.a, r.b) for r in links.collect()]
    assert len(found) == len(set(found)) > 0
    assert set(found) == {tuple(sorted((node[i], node[j]))) for i, j in near if sets[i] != sets[j]}


def test_shingle_join_ids_with_different_texts(spark):
    """Rows of one doc_id are one node, which joins what its texts are linked to."""
    one, two = prose(31, 60), prose(32, 60)
    rows = [(3, one), (5, one), (5, two), (9, two), (5, None), (6, None), (7, prose(33, 60)),
            (None, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = shingle_join.jaccard_components(docs.repartition(3), 3, 90, 100).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.n_links) for r in got) == [
        (0, 0, 0), (3, 3, 1), (5, 3, 0), (5, 3, 1), (5, 3, 1), (6, 6, 0), (7, 7, 0), (9, 3, 1)]


def test_pipeline_keeps_different_texts_of_one_id(spark):
    """A repeated id loses only its copies, not the other texts it holds."""
    one, two, three = prose(31, 60), prose(32, 60), prose(33, 60)
    rows = [(3, one), (5, one), (5, two), (5, two), (9, three), (9, None), (9, None)]
    rows += [(7, prose(40 + i, 60)) for i in range(12)] + [(7, prose(40, 60)), (8, prose(41, 60))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs.repartition(3), "").collect()
    want = {(3, one), (5, two), (9, three), (9, None)} | {(7, prose(40 + i, 60)) for i in range(12)}
    assert len(got) == len(want) and {(r.doc_id, r.text) for r in got} == want
