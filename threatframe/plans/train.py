"""Training plan.

Stratified folds by seeded hash rank; inside each training part the minority is
oversampled with SMOTE (so no synthetic neighbour of a validation row leaks into
training).  All folds are fitted at once: every original row trains the models of the
other folds and stops that of its own, a synthetic row trains the one model it was
made for.  Each model weighs the positive class neg/pos of its own rows.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from threatframe.operators import boosting, metrics, model, resample, split
from threatframe.session import cut_lineage


def oversample(train: DataFrame, id_col: str, vec: str, label: str, minority: int = 1,
               ratio=Fraction(3, 10), seed: int = 42) -> DataFrame:
    """Original rows ⧺ SMOTE rows (is_synthetic), ids of synthetic rows
    negative so they never collide with real ids."""
    syn = resample.smote(train, id_col, vec, label, minority, ratio=ratio, seed=seed)
    syn = syn.select((-1 - F.col("synth_id")).alias(id_col), F.col(vec),
                     F.lit(minority).cast(train.schema[label].dataType).alias(label),
                     F.lit(True).alias("is_synthetic"))
    base = train.select(id_col, F.transform(vec, lambda v: v.cast("double")).alias(vec), label,
                        F.lit(False).alias("is_synthetic"))
    return base.unionByName(syn)


def cross_validate(df: DataFrame, id_col: str, vec: str, label: str, k: int = 5,
                   seed: int = 42, resample_minority: bool = True,
                   **options) -> tuple[DataFrame, DataFrame]:
    """(per-fold AUC, mean/std summary); `options` are those of the boosted trees."""
    folds = cut_lineage(split.stratified_folds(df.select(id_col, vec, label), id_col, label,
                                               k, seed))
    rows = folds.select(F.transform(vec, lambda v: v.cast("double")).alias("x"), label, "fold",
                        F.lit(None).cast("int").alias("made_for"))
    if resample_minority:
        for f in range(k):
            made = oversample(folds.filter(F.col("fold") != f).drop("fold"), id_col, vec, label,
                              seed=seed).filter("is_synthetic")
            rows = rows.unionByName(made.select(F.col(vec).alias("x"), label,
                                                F.lit(None).cast("int").alias("fold"),
                                                F.lit(f).alias("made_for")))
    trees = boosting.fit_folds(rows, label, "x", k=k, only="made_for", **options)
    scored = [model.score(boosting.BoostedTreesModel(trees[f]), model.vectorize(
        folds.filter(F.col("fold") == f), array_col=vec)).select("fold", label, "p_class1")
        for f in range(k)]
    per_fold = cut_lineage(metrics.auc(reduce(lambda a, b: a.unionByName(b), scored),
                                       "p_class1", label, ["fold"]))
    return per_fold, metrics.fold_summary(per_fold)


def final_fit(df: DataFrame, id_col: str, vec: str, label: str, seed: int = 42, **options):
    """Fit on all (oversampled) rows with every round."""
    data = oversample(df.select(id_col, vec, label), id_col, vec, label, seed=seed)
    return model.fit_gbt(model.vectorize(data, array_col=vec), label=label, **options)
