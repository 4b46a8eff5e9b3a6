"""Leak-free splits (M1-M5) and stratified folds (M9).

Membership is a pure function of the row (seeded md5 of an id or group), so
a split is stable as data grows and needs no shuffle; only the temporal-group
split joins against the set of groups seen before the cutoff.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threatframe.functions.scalars import hash_fraction
from threatframe.operators.graph import linked_groups
from threatframe.operators.rank import global_rank


def random_split(df: DataFrame, id_col: str, test_size: float = 0.2, seed: int = 42,
                 name: str = "split") -> DataFrame:
    """M1: test when md5(seed:id) fraction < test_size."""
    return df.withColumn(name, F.when(hash_fraction(seed, F.col(id_col)) < test_size, "test")
                         .otherwise("train"))


def group_key(fields: list[str]) -> Column:
    """First present group field, as text (M2)."""
    return F.coalesce(*[F.col(f).cast("string") for f in fields])


def group_split(df: DataFrame, fields: list[str], test_size: float = 0.2, seed: int = 42,
                name: str = "split", group_col: str = "group_key", linked: bool = False,
                id_col: str | None = None) -> DataFrame:
    """M2: M1 on the first present group field, so a group never straddles.

    With `linked` (and the row id `id_col`), rows that share any of the fields, directly
    or through others, are one group (M3), named by its smallest id: two rows with equal
    sha256 of which only one has a sha1 also stay together."""
    if linked:
        out = linked_groups(df, id_col, [f for f in fields if f != id_col], group_col)
        out = out.withColumn(group_col, F.col(group_col).cast("string"))
    else:
        out = df.withColumn(group_col, group_key(fields))
    return out.withColumn(name, F.when(hash_fraction(seed, F.col(group_col)) < test_size, "test")
                          .otherwise("train"))


def time_split(df: DataFrame, time_col: str, cutoff: str, name: str = "split") -> DataFrame:
    """M4: before the cutoff is train, the rest test."""
    return df.withColumn(name, F.when(F.col(time_col).cast("timestamp")
                                      < F.to_timestamp(F.lit(cutoff)), "train").otherwise("test"))


def temporal_group_split(df: DataFrame, time_col: str, cutoff: str, group_cols: list[str],
                         name: str = "split") -> DataFrame:
    """M5: time split; a test row whose group also occurs before the cutoff
    is `dropped`, so no group is on both sides."""
    out = time_split(df, time_col, cutoff, name)
    train_groups = (out.filter(F.col(name) == "train").select(*group_cols).distinct()
                    .withColumn("_in_train", F.lit(True)))
    out = out.join(train_groups, group_cols, "left")
    return out.withColumn(name, F.when((F.col(name) == "test") & F.col("_in_train").isNotNull(),
                                       "dropped").otherwise(F.col(name))).drop("_in_train")


def stratified_folds(df: DataFrame, id_col: str, label: str, k: int = 5, seed: int = 42,
                     name: str = "fold") -> DataFrame:
    """M9: within each label, rows ranked by md5(seed:id) (ties by id), fold =
    (rank - 1) mod k.  The rank is range-partitioned, so a 2-valued label does
    not put half the data into one task."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    ranked = global_rank(df.withColumn("_h", h), [F.col("_h"), F.col(id_col)],
                         partition_by=[label], name="_r")
    return ranked.withColumn(name, ((F.col("_r") - 1) % k).cast("int")).drop("_h", "_r")
