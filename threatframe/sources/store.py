"""Versioned Parquet table store.

Plain Parquet has no transactions, so every write goes to a new version
directory and becomes visible only when its commit marker is written after
the data.  Readers take the newest committed version, so a failed or running
write is never seen, and the previous version stays readable.

A marker lists the folders that make up its version.  `write_table` starts a
table anew, `append_table` adds a folder, `replace_buckets` rewrites only the
buckets (say months) that a batch touches; all other files stay in place.

Layout:  <root>/<table>/data/version=<n>/[_bucket=<b>/]...
         <root>/<table>/commits/version=<n>/   (one row per folder)
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from threatframe.schemas import TABLES


def _commits(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}/commits"


def _data(root: str, name: str, version: int) -> str:
    return f"{root.rstrip('/')}/{name}/data/version={version:08d}"


def _marker(spark: SparkSession, root: str, name: str) -> list:
    """The rows (version, folder, bucket) of the newest commit; none if the table
    has no commit folder.  Any other read error is raised."""
    try:
        marks = spark.read.parquet(_commits(root, name))
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    return marks.filter(F.col("version") == marks.agg(F.max("version")).scalar()) \
        .select("version", "folder", "bucket").collect()  # one row per folder


def current_version(spark: SparkSession, root: str, name: str) -> int | None:
    """Newest committed version (reads only the small commit markers)."""
    rows = _marker(spark, root, name)
    return int(rows[0]["version"]) if rows else None


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The current version with its declared schema; empty if none."""
    schema = TABLES[name]["schema"] if name in TABLES else None
    folders = [r["folder"] for r in _marker(spark, root, name) if r["folder"]]
    if not folders:
        if schema is None:
            raise FileNotFoundError(f"no committed version of {name}")
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(*folders)


def _commit(spark: SparkSession, root: str, name: str, version: int,
            parts: list[tuple[str, str | None]]) -> int:
    """Make `parts` (folder, bucket) the table's version.  Of two writers of one
    version, the second fails here."""
    spark.createDataFrame([(version, f, b) for f, b in parts or [(None, None)]],
                          "version int, folder string, bucket string") \
        .withColumn("committed_at", F.current_timestamp()).coalesce(1) \
        .write.mode("error").parquet(f"{_commits(root, name)}/version={version:08d}")
    return version


def write_table(df: DataFrame, root: str, name: str, partition_by: list[str] | None = None,
                sort_by: list[str] | None = None) -> int:
    """K1: write a whole new version, then commit it.  Rows are clustered by
    `partition_by` and sorted within files by `sort_by` so that range and
    equality filters (T17) skip row groups."""
    v = (current_version(df.sparkSession, root, name) or 0) + 1
    out = df
    if partition_by:
        out = out.repartition(*[F.col(c) for c in partition_by])
    if sort_by:
        out = out.sortWithinPartitions(*sort_by)
    w = out.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(_data(root, name, v))
    return _commit(df.sparkSession, root, name, v, [(_data(root, name, v), None)])


def append_table(new_rows: DataFrame, root: str, name: str) -> int:
    """K1 for insert-only tables: the files of the version before stay, new rows
    get a folder of their own."""
    spark = new_rows.sparkSession
    before = _marker(spark, root, name)
    v = (before[0]["version"] if before else 0) + 1
    new_rows.write.mode("overwrite").parquet(_data(root, name, v))
    kept = [(r["folder"], r["bucket"]) for r in before if r["folder"]]
    return _commit(spark, root, name, v, [*kept, (_data(root, name, v), None)])


def replace_buckets(table: DataFrame, root: str, name: str, bucket: Column,
                    touched: list[str]) -> int:
    """K1 for updated tables: of the whole new `table`, write only the rows of the
    `touched` buckets; the folders of all other buckets stay in place.  A table
    that was not written by buckets before is written whole."""
    spark = table.sparkSession
    before = [r for r in _marker(spark, root, name)]
    v = (before[0]["version"] if before else 0) + 1
    rows = table.withColumn("_bucket", bucket)
    kept = [(r["folder"], r["bucket"]) for r in before
            if r["bucket"] is not None and r["bucket"] not in touched]
    if all(r["bucket"] is not None or not r["folder"] for r in before):
        rows = rows.filter(F.col("_bucket").isin(list(touched)))
    else:
        kept = []
    path = _data(root, name, v)
    (rows.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(path))
    # one row per written bucket
    made = [r[0] for r in rows.select("_bucket").distinct().collect()]
    return _commit(spark, root, name, v, [*kept, *((f"{path}/_bucket={b}", b) for b in made)])


def register_run(spark: SparkSession, root: str, name: str, description: str,
                 featureset: str, metrics_json: str, rows: DataFrame, id_col: str,
                 columns: list[str], as_of: str) -> int:
    """K6: append a model run, its rows and its columns to the registry."""
    runs = read_table(spark, root, "model_runs")
    run_id = (runs.agg(F.max("model_run_id")).first()[0] or 0) + 1
    new_run = spark.createDataFrame(
        [(run_id, name, description, featureset, metrics_json)],
        "model_run_id long, name string, description string, featureset string, metrics string",
    ).withColumn("trained_at", F.to_timestamp(F.lit(as_of)))
    write_table(runs.unionByName(new_run), root, "model_runs")
    rr = read_table(spark, root, "model_run_rows")
    write_table(rr.unionByName(rows.select(F.lit(run_id).cast("long").alias("model_run_id"),
                                           F.col(id_col).cast("long").alias("threat_id"))),
                root, "model_run_rows")
    rc = read_table(spark, root, "model_run_columns")
    cols = spark.createDataFrame([(run_id, c) for c in columns],
                                 "model_run_id long, column_name string")
    write_table(rc.unionByName(cols), root, "model_run_columns")
    return run_id


# ---------------------------------------------------------------- T17 access paths
def find_by_hash(threats: DataFrame, hashes: DataFrame, col: str) -> DataFrame:
    """Threats whose hash is in `hashes` (semi join; no row duplication)."""
    return threats.join(hashes.select(col).distinct(), col, "left_semi")


def events_of(events: DataFrame, type_col: str, event_type: str, threat_col: str | None = None,
              threat_id=None) -> DataFrame:
    """Events of one type, optionally of one threat."""
    out = events.filter(F.col(type_col) == event_type)
    if threat_col is not None and threat_id is not None:
        out = out.filter(F.col(threat_col) == threat_id)
    return out
