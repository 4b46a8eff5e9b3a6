"""Hard negatives against brute force in Python integers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from threatframe.llm import hard_negatives
from threatframe.llm.queries import QUERIES


def brute(rows, is_anchor, k=5, m=10):
    """rows: (id, label, vector); exact integers throughout."""
    use = []
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and \
                all(x is not None and math.isfinite(x) for x in v):
            row = (i, label, tuple(math.floor(256 * x) if abs(x) < 1e300 else int(x) * 256 for x in v))
            if row not in use:
                use.append(row)
    out = []
    for i, label, v in use:
        if not is_anchor(i):
            continue
        def score(w):
            return max(-2 ** 63, min(2 ** 63 - 1, sum(a * b for a, b in zip(v, w))))
        others = [(score(w), j, y) for j, y, w in use if j != i and len(w) == len(v)]
        same = sorted({(-s, j) for s, j, y in others if y == label})[:k]
        rest = sorted({(-s, j) for s, j, y in others if y != label})
        for p, j in same:
            fit = [(s, n) for s, n in rest if 30 * -p <= 100 * -s <= 90 * -p][:m]
            out += [(i, j, r, n, -p, -s) for r, (s, n) in enumerate(fit, 1)]
    return sorted(out)


def mined(df, **kw):
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("id") % 10 == 0, **kw).collect())


SCHEMA = "vec_id long, label int, embedding array<double>, score long, anchor int, part int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("blocks", [(7, 3), (4096, 8192)])
def test_against_brute_force(spark, blocks):
    r = random.Random(3)
    rows = [(i, 0 if r.random() < 0.4 else r.randrange(4), [r.randrange(-2, 6) / 8 for _ in range(4)])
            for i in range(300)]
    got = mined(frame(spark, rows), block_rows=blocks[0], anchor_block=blocks[1])
    assert got == brute(rows, lambda i: i % 10 == 0)
    assert len(got) > 300


def test_hard_cases(spark):
    r = random.Random(4)
    rows = [(i, r.randrange(3), [r.random(), r.random()]) for i in range(60)]
    rows += rows[:12]  # repeated rows
    rows += [(None, 1, [1.0, 1.0]), (61, None, [1.0, 1.0]), (62, 1, None), (70, 1, [None, 1.0]),
             (71, 1, [float("nan"), 1.0]), (72, 1, [float("inf"), 1.0]), (80, 1, [0.0, 0.0]),
             (81, 2, [0.0, 0.0]), (90, 2, [1e300, -1e300]), (91, 2, [5e299, 0.0]),
             (92, 0, [1e9, 3e9]), (100, 0, [-1.0, -2.0]), (110, 0, [1.0]), (111, 0, [0.5]),
             (112, 1, [0.25]), (120, 1, []), (121, 1, []), (122, 2, []),
             (20, 2, [0.5, 0.25]), (-10, 0, [0.7, 0.7])]
    assert mined(frame(spark, rows)) == brute(rows, lambda i: i % 10 == 0)


def test_empty_and_without_anchors(spark):
    df = frame(spark, [(1, 1, [1.0]), (2, 2, [0.5])])
    assert mined(df) == [] and mined(df.filter("vec_id < 0")) == []


def test_query_against_brute_force(spark):
    got = QUERIES["op13_hard_negatives"][0](spark, SF_SMALL)
    assert got.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"),
                          ("negative_id", "bigint"), ("positive_score", "bigint"),
                          ("negative_score", "bigint")]
    rows = [(r.vec_id, r.label if r.vec_id % 7 or r.label is None else (r.label + 1) % 10, r.embedding)
            for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, lambda i: i % 100 == 0)
