"""The classifier's input (P15, P16, M7): one matrix that training and evaluation
share — flat numeric columns, the event profile of the alert, text features."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from threatframe.operators import model, text
from threatframe.operators.project import fill_features


def fit_vocabulary(train: DataFrame, id_col: str, text_col: str,
                   size: int = 500) -> tuple[DataFrame, int]:
    """M6: the stored part of the text features: (term, df, rank) and the number of
    training documents."""
    return text.vocabulary(text.term_stats(train, text_col), size), train.count()


def feature_matrix(rows: DataFrame, profile: DataFrame, id_col: str, numeric: list[str],
                   profile_cols: list[str], text_col: str, vocab: DataFrame, n_docs: int,
                   out: str = "features") -> DataFrame:
    """Add `out` = numeric columns, event profile (0 where an alert has no events) and
    text weights as one vector; `profile` has one row per `id_col`."""
    wide = fill_features(rows.join(profile.select(id_col, *profile_cols), id_col, "left"),
                         [*numeric, *profile_cols], [text_col])
    wide = text.tfidf_vectors(wide, text_col, vocab, n_docs)
    return model.vectorize(wide, numeric=[*numeric, *profile_cols],
                           extra_vectors=["text_features"], out=out)
