"""Shared helpers of the llm operators: query registry, written tables, plain columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from threatframe.session import scratch_path, tidy

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write `df` as Parquet under the cluster's shared checkpoint folder and
    read it back: lineage ends here, and a lost executor costs no recompute."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(col: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def sliced(batches, column: str | int, most: int = 4 << 20):
    """Arrow batches cut so that the texts of `column` take about `most` bytes each (one
    row at least): what a task holds of a batch does not grow with its rows."""
    import numpy as np
    import pyarrow.compute as pc

    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(size, dtype=np.int64)
        at = 0
        while at < b.num_rows:
            end = int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right"))
            end = max(end, at + 1)
            yield b.slice(at, end - at)
            at = end


def with_text_scores(docs: DataFrame, text_col: str, fields: str, make) -> DataFrame:
    """Add the columns `fields` (a DDL list), computed from whole texts by Arrow batch.

    `make()` runs once per task and returns a function from a list of texts (None:
    null) to a list of value lists, one per field.  Columns of the input that have
    a field's name are replaced; all other columns pass through.
    """
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    added = T.StructType.fromDDL(fields)
    names = [f.name for f in added]
    base = docs.drop(*[n for n in names if n in docs.columns])
    schema = T.StructType(list(base.schema) + list(added))
    types = [to_arrow_type(f.dataType) for f in added]
    at = base.columns.index(text_col)

    def scored(batches):
        score = make()
        for b in sliced(batches, at):
            values = score(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *(pa.array(v, t) for v, t in zip(values, types))],
                names=[*b.schema.names, *names])

    return base.mapInArrow(lambda batches: tidy(scored(batches)), schema)
