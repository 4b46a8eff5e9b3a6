"""Concatenate and cut (operator 6).

Pass 1 encodes every whole text, appends the end id and writes the ids with the
number of ids before them in the same task; the tasks' totals are then summed in
task order (one row per task), which gives each document its place in one long
row of ids.  Pass 2 cuts that row at every multiple of `window`: a document that
crosses a boundary gives one piece per sequence.  Only the last sequence is not
full, so the padding of the whole table is under one window.

Null text counts as empty and gives the end id alone.  Documents that repeat a
doc_id are packed as separate documents.  Very long documents fill sequences of
their own from boundary to boundary.  An empty table gives no pieces.  Only the
id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from threatframe.llm.common import query, sliced, table, tidy, whole_text, written
from threatframe.llm.wordids import encoder

WINDOW = 4096
END_ID = 2


def _encode(tokenizer: str, end_id: int):
    def run(batches):
        enc = encoder(tokenizer)
        kind = "<u2" if max(enc.size, end_id + 1) <= 1 << 16 else "<u4"
        task, before = TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4").tobytes()
        for b in sliced(batches, "text"):
            ids = [np.frombuffer(x + end, "<u4").astype(kind)
                   for x in enc.encode(b.column("text").cast(pa.binary()).to_pylist())]
            sizes = np.array([len(x) for x in ids], dtype=np.int64)
            at = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.full(len(ids), task, dtype=np.int32)),
                 pa.array(at), pa.array(sizes),
                 pa.array([x.tobytes() for x in ids], pa.binary())],
                names=["doc_id", "task", "task_start", "doc_tokens", "ids"])
    return run


def _cut(window: int):
    def run(batches):
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "doc_tokens",
                                                    "sequence_id", "offset", "ids")}
            for doc, at, n, raw in zip(b.column("doc_id").to_pylist(),
                                       b.column("place").to_pylist(),
                                       b.column("doc_tokens").to_pylist(),
                                       b.column("ids").to_pylist()):
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                cuts = [0, *range(window - at % window, n, window), n]
                for i, j in zip(cuts[:-1], cuts[1:]):
                    out["doc_id"].append(doc)
                    out["start"].append(i)
                    out["length"].append(j - i)
                    out["doc_tokens"].append(n)
                    out["sequence_id"].append((at + i) // window)
                    out["offset"].append((at + i) % window)
                    out["ids"].append(ids[i:j].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()],
                names=list(out))
    return run


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, id_col: str = "doc_id",
         text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start (in the document), length, doc_tokens,
    sequence_id, offset (in the sequence) and ids (little-endian unsigned 32-bit)."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        whole_text(text_col).alias("text"))
    encode = _encode(tokenizer, end_id)
    coded = written(plain.mapInArrow(
        lambda batches: tidy(encode(batches)),
        "doc_id long, task int, task_start long, doc_tokens long, ids binary"), "packing-ids")
    totals = coded.groupBy("task").agg(F.sum("doc_tokens").alias("n"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_off"))
    # one row per task of the first pass
    placed = coded.join(F.broadcast(offsets), "task").select(
        "doc_id", (F.col("_off") + F.col("task_start")).alias("place"), "doc_tokens", "ids")
    return placed.mapInArrow(
        _cut(window), "doc_id long, start long, length long, doc_tokens long, "
                      "sequence_id long, offset long, ids binary")


def pieces(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The pieces with the checksum of their ids in place of the ids."""
    return pack(docs, tokenizer).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset")


@query("op6_packing")
def op6_packing(spark, sf_dir):
    import public_tokenizers

    return pieces(table(spark, sf_dir, "documents"),
                  public_tokenizers.path("word_bpe_49k.json"))
