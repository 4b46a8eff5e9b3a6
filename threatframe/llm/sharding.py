"""Sharding by fixed virtual slots (operator 2).

Records are hashed by doc_id into SLOTS virtual slots.  Bytes are summed per
slot (at most SLOTS rows), and a versioned slot-to-shard map is stored as a
Parquet table: version 0 deals the slots in turn, `rebalance` edits the newest
version by moving single slots from the fullest to the emptiest shard while that
narrows their gap, and stores the result as the next version.  Records follow
their slot; their law is `bytes`: shards get nearly equal bytes.

`place` numbers the records of a shard from 0 without gaps, ordered by slot,
doc_id, size and checksum.  Equal rows are counted before the shuffle and
numbered as a block, so a row that repeats any number of times is one record on
the way.  Null text has size 16 and the checksum of no bytes; a null doc_id is
hashed like any value.  An empty table gives no rows.  All ids with one value
share a slot, so one doc_id holding most bytes makes its shard the largest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from threatframe.llm.common import query, table
from threatframe.session import scratch_path

SLOTS = 8192
OVERHEAD = 16


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def slot_bytes(records: DataFrame, key: str, size: str, slots: int = SLOTS) -> DataFrame:
    """(slot, bytes) of the slots that have records."""
    return (records.groupBy(slot_of(F.col(key), slots).alias("slot"))
            .agg(F.sum(size).alias("bytes")))


def first_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Version 0: slot s belongs to shard s mod shards."""
    return [s % shards for s in range(slots)]


def rebalance(shard_of: list[int], load: dict[int, int], shards: int) -> list[int]:
    """The map after moving slots from the fullest to the emptiest shard, always
    the slot nearest half of their gap, until no move narrows it."""
    out = list(shard_of)
    own: list[dict[int, int]] = [{} for _ in range(shards)]
    for slot, n in load.items():
        own[out[slot]][slot] = n
    total = [sum(x.values()) for x in own]
    while True:
        top = max(range(shards), key=lambda i: (total[i], -i))
        low = min(range(shards), key=lambda i: (total[i], i))
        gap = total[top] - total[low]
        moves = [(abs(gap - 2 * n), s) for s, n in own[top].items() if 0 < n < gap]
        if not moves:
            return out
        slot = min(moves)[1]
        n = own[top].pop(slot)
        own[low][slot] = n
        out[slot] = low
        total[top] -= n
        total[low] += n


def store_map(spark: SparkSession, path: str, shard_of: list[int], version: int) -> DataFrame:
    """Append one version of the map (version, slot, shard) to the table at `path`."""
    csv = F.split(F.lit(",".join(map(str, shard_of))), ",")
    (spark.range(0, len(shard_of), 1, 1)
     .select(F.lit(version).alias("version"), F.col("id").cast("int").alias("slot"),
             F.get(csv, F.col("id").cast("int")).cast("int").alias("shard"))
     .write.mode("append").parquet(path))
    return spark.read.schema("version int, slot int, shard int").parquet(path)


def latest(maps: DataFrame) -> DataFrame:
    """(slot, shard) of the newest version."""
    return maps.filter(F.col("version") == maps.agg(F.max("version")).scalar()) \
        .select("slot", "shard")


def shard(docs: DataFrame, shards: int, path: str, slots: int = SLOTS, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard, place; the map's versions are at `path`."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    load = {r.slot: r.bytes for r in slot_bytes(rows, "doc_id", "size", slots).collect()}
    dealt = first_map(shards, slots)
    store_map(spark, path, dealt, 0)
    maps = store_map(spark, path, rebalance(dealt, load, shards), 1)

    same = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("virtual_slot", slot_of(F.col("doc_id"), slots))
    # one row per virtual slot
    held = same.groupBy("virtual_slot").agg(F.sum("n").alias("held"))
    before = (Window.partitionBy("shard").orderBy("slot")
              .rowsBetween(Window.unboundedPreceding, -1))
    starts = (latest(maps).join(held, F.col("slot") == F.col("virtual_slot"))
              .select("slot", "shard", F.coalesce(F.sum("held").over(before), F.lit(0))
                      .alias("slot_start")))
    inside = (Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32")
              .rowsBetween(Window.unboundedPreceding, -1))
    numbered = same.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return (numbered.join(F.broadcast(starts), F.col("virtual_slot") == F.col("slot"))
            .withColumn("_at", F.col("slot_start") + F.col("_in"))
            .select("doc_id", "size", "text_crc32", "virtual_slot", "shard",
                    F.explode(F.sequence(F.col("_at"), F.col("_at") + F.col("n") - 1))
                    .alias("place")))


@query("op2_sharding")
def op2_sharding(spark, sf_dir):
    placed = shard(table(spark, sf_dir, "documents"), 40, scratch_path(spark, "slot-map"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                         F.col("place").cast("long").alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
