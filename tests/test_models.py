"""Metrics, kNN/SMOTE, forest invariants."""

from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from threatframe.operators import metrics, novelty, resample


def test_auc_ties_count_half(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 1), (0.4, 0), (0.8, 1)], "s double, y int")
    assert abs(metrics.auc(df, "s", "y").first()["auc"] - 0.875) < 1e-12


def test_auc_one_class_is_null(spark):
    df = spark.createDataFrame([(0.1, 1), (0.4, 1)], "s double, y int")
    assert metrics.auc(df, "s", "y").first()["auc"] is None


def test_report_class_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (1, 0)], "y int, p int")
    rows = {r.row: r for r in metrics.classification_report(df, "y", "p").collect()}
    assert rows["1"].precision == 0.0 and rows["1"].recall == 0.0 and rows["1"].support == 2
    assert abs(rows["accuracy"].f1 - 1 / 3) < 1e-12


def test_knn_matches_brute_force(spark):
    import random

    rnd = random.Random(1)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {(r.id, r.nn_rank): r.nn_id for r in resample.knn(df, "id", "v", 3).collect()}
    for i, v in rows:
        d = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w in rows if j != i)
        assert [got[(i, k)] for k in (1, 2, 3)] == [j for _d, j in d[:3]]


def _brute_knn(rows, k):
    out = {}
    for i, v in rows:
        d = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w in rows if j != i)
        for r, (_, j) in enumerate(d[:k], 1):
            out[i, r] = j
    return out


def test_knn_without_spread_along_one_axis(spark):
    """Points around many centres in 12 dimensions, repeated points and ties among them."""
    import random

    r = random.Random(3)
    centres = [[r.uniform(-9, 9) for _ in range(12)] for _ in range(20)]
    rows = [(i, [c + r.gauss(0, 0.4) for c in centres[i % 20]]) for i in range(400)]
    rows += [(400 + i, rows[i][1]) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {(x.id, x.nn_rank): x.nn_id for x in resample.knn(df, "id", "v", 4).collect()}
    assert got == _brute_knn(rows, 4)
    pairs = resample.candidates(df.select("id", "v"), 4).count()
    assert pairs < len(rows) ** 2 / 8


def test_knn_of_sparse_text_like_vectors(spark):
    import random

    r = random.Random(8)
    rows = []
    for i in range(150):
        v = [0.0] * 60
        for _ in range(5):
            v[min(59, int(r.expovariate(0.1)))] += r.choice([0.25, 0.5])
        rows.append((i, v))
    df = spark.createDataFrame([*rows, (999, None)], "id long, v array<double>")
    got = {(x.id, x.nn_rank): x.nn_id for x in resample.knn(df, "id", "v", 5).collect()}
    assert got == _brute_knn(rows, 5)


def test_knn_of_few_points(spark):
    for n in (0, 1, 2, 4):
        rows = [(i, [float(i * i)]) for i in range(n)]
        df = spark.createDataFrame(rows, "id long, v array<double>")
        got = {(x.id, x.nn_rank): x.nn_id for x in resample.knn(df, "id", "v", 5).collect()}
        assert got == _brute_knn(rows, 5)


def test_knn_over_tiles_without_structure(spark):
    """Random directions: whatever the bounds leave, a point brings k of a tile at most;
    copies, ties, -0.0 and a vector that is not finite across tiles."""
    import random

    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) for _ in range(24)]) for i in range(300)]
    rows += [(300 + i, [float(r.randint(0, 1)) for _ in range(3)] + [0.0] * 21) for i in range(60)]
    rows += [(360 + i, rows[7][1]) for i in range(20)] + [(380, [-0.0] * 24), (381, [0.0] * 24)]
    df = spark.createDataFrame([*rows, (999, [float("nan")] * 24)], "id long, v array<double>")
    got = {(x.id, x.nn_rank): x.nn_id for x in resample.knn(df, "id", "v", 4, block=64).collect()}
    assert [got.pop((999, n)) for n in (1, 2, 3, 4)] == [0, 1, 2, 3]
    assert got == _brute_knn(rows, 4)
    assert resample.candidates(df.select("id", "v"), 4).count() == 4 * (len(rows) + 1)


def test_smote_points_between_minority_points(spark):
    rows = [(i, [float(i), float(i % 5)], 0 if i < 10 else 1) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y int")
    syn = resample.smote(df, "id", "v", "y", 0, ratio=Fraction(3, 10)).collect()
    assert len(syn) == int(Fraction(3, 10) * 50) - 10
    pts = {i: v for i, v, _y in rows}
    for r in syn:
        a, b = pts[r.base_id], pts[r.nn_id]
        for x, lo, hi in zip(r.v, a, b):
            assert min(lo, hi) - 1e-9 <= x <= max(lo, hi) + 1e-9


def test_forest_scores_independent_of_row_order(spark):
    import random

    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, 1), rnd.gauss(0, 1)]) for i in range(300)] + [(999, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    a = {r.id: r.novelty_score for r in novelty.novelty(df, df, "id", "v", n_trees=20).collect()}
    b = {r.id: r.novelty_score for r in
         novelty.novelty(df.orderBy(F.rand(5)).repartition(3), df, "id", "v", n_trees=20).collect()}
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)
    assert a[999] == min(a.values())


def test_final_fit_saved_and_loaded(spark, tmp_path):
    """M12 + K5: the model fitted on all rows scores alike after saving and loading."""
    from threatframe.operators import model
    from threatframe.operators.boosting import BoostedTreesModel
    from threatframe.plans.train import final_fit
    from threatframe.sources.sinks import save_model

    rows = [(i, [float(i % 7), float(i)], int(i % 9 == 0)) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    m = final_fit(df, "id", "v", "label", rounds=2, depth=2)
    save_model(m, str(tmp_path / "model"))
    x = model.vectorize(df, array_col="v")
    again = BoostedTreesModel.load(str(tmp_path / "model"))
    a = [r.p_class1 for r in model.score(m, x).orderBy("id").collect()]
    assert a == [r.p_class1 for r in model.score(again, x).orderBy("id").collect()]
    assert len(again.trees.features) == 2 and again.names == ["v_0", "v_1"]


def test_smote_with_few_minority_rows(spark):
    for m in (2, 3, 5):
        rows = [(i, [float(i), float(i % 5)], 0 if i < m else 1) for i in range(m + 50)]
        df = spark.createDataFrame(rows, "id long, v array<double>, y int")
        assert resample.smote(df, "id", "v", "y", 0, ratio=Fraction(3, 10)).count() == 15 - m
    one = spark.createDataFrame([(i, [float(i)], int(i > 0)) for i in range(20)],
                                "id long, v array<double>, y int")
    with pytest.raises(ValueError):
        resample.smote(one, "id", "v", "y", 0, ratio=Fraction(3, 10))


def test_forest_without_training_rows_or_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0, 3.0])], "id long, v array<double>")
    got = {r.id: (r.novelty_score, r.is_novel) for r in
           novelty.novelty(df.filter("id < 0"), df, "id", "v", n_trees=5).collect()}
    assert got == {k: (None, False) for k in (1, 2, 3)}
    got = {r.id: r.novelty_score for r in novelty.novelty(df, df, "id", "v", n_trees=5).collect()}
    assert got[2] is None and got[1] is not None and got[3] is not None


def test_path_lengths_of_a_row_by_row_walk():
    """Arrays prepared once per forest give the walk's lengths, in equal order of addition;
    a value that is no number goes right."""
    import numpy as np
    import pandas as pd

    r = np.random.default_rng(3)
    data = np.round(r.normal(size=(300, 3)), 1)
    names = ["tree", "node", "feature", "threshold", "left", "right", "size", "depth"]
    rows = [n for t in range(7) for n in novelty._grow(t, data[t:t + 1 + 40 * t], 42, 6)]
    nodes = pd.DataFrame(rows, columns=names).sample(frac=1, random_state=1)
    x = np.concatenate([np.tile(data, (8, 1)), [[np.nan] * 3]])
    want = []
    for v in x:
        total = 0.0
        for t in range(7):
            tree = {n[1]: n for n in rows if n[0] == t}
            n = tree[0]
            while n[2] >= 0:
                n = tree[n[4] if v[n[2]] < n[3] else n[5]]
            total += n[7] + novelty._c([n[6]])[0]
        want.append(total / 7)
    assert novelty._path_lengths(x, novelty._trees(nodes)).tolist() == want
