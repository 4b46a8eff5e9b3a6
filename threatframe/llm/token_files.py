"""Token-ID files in ORC (operator 9).

`write_tokens` encodes whole texts and writes one row per document, in
ascending id order over files and rows: `doc_id`, `ids array<int>` (ORC's
integer run-length encoding), `n_tokens`.  ORC stripes split a file into
parallel reads; row indexes (`row_index_stride`) and Bloom filters on `doc_id`
let a reader skip row groups that hold none of the wanted documents.
`read_tokens` reads the files back, with the number of ids before each document.

Null text counts as empty, and an empty text has the end id alone.  Rows that
repeat a doc_id stay separate rows (in any order among themselves if they are
equal, else by a hash of the text).  Only the id and text columns are read, so
other columns may have any name.  An empty table gives files without rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from threatframe.llm.common import query, sliced, table, whole_text, written
from threatframe.llm.wordids import encoder
from threatframe.operators.rank import running_total, with_range_bucket
from threatframe.session import scratch_path

END_ID = 2
STRIPE_BYTES = 16 << 20
ROW_INDEX_STRIDE = 1000
BLOOM_FPP = 0.01


def _encode(tokenizer: str, end_id: int):
    def run(batches):
        enc = encoder(tokenizer)
        end = np.array([end_id], dtype="<u4").tobytes()
        for b in sliced(batches, "text"):
            raw = [x + end for x in enc.encode(b.column("text").cast(pa.binary()).to_pylist())]
            sizes = np.array([len(x) // 4 for x in raw], dtype=np.int64)
            flat = np.frombuffer(b"".join(raw), dtype="<i4")
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids, pa.array(sizes)],
                                             names=["doc_id", "ids", "n_tokens"])
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id",
                 text_col: str = "text", end_id: int = END_ID) -> None:
    """Encode `docs` and write ORC files under `path`."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        whole_text(text_col).alias("text"))
    ranged = with_range_bucket(plain, ["doc_id"], n, "_part")
    (ranged.repartitionById(n, "_part")
     .sortWithinPartitions("doc_id", F.xxhash64("text"))
     .select("doc_id", "text")
     .mapInArrow(_encode(tokenizer, end_id), "doc_id long, ids array<int>, n_tokens long")
     .write.option("orc.bloom.filter.columns", "doc_id")
     .option("orc.bloom.filter.fpp", BLOOM_FPP)
     .option("orc.stripe.size", STRIPE_BYTES)
     .option("orc.create.index", "true")
     .option("orc.row.index.stride", ROW_INDEX_STRIDE)
     .option("compression", "lz4")
     .orc(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids, n_tokens of the files (a filter on doc_id reaches their indexes)."""
    return spark.read.schema("doc_id long, ids array<int>, n_tokens long").orc(path)


def _crc(batches):
    for b in batches:
        ids = b.column("ids")
        flat = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<u4")
        at = ids.offsets.to_numpy()
        crc = [zlib.crc32(flat[i:j]) for i, j in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(np.diff(at).astype(np.int64)),
             pa.array(crc, pa.int64())], names=["doc_id", "n_tokens", "ids_crc32"])


def token_digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of read ids."""
    sums = written(tokens.select("doc_id", "ids")
                   .mapInArrow(_crc, "doc_id long, n_tokens long, ids_crc32 long"), "token-sums")
    return running_total(sums, ["doc_id", "n_tokens", "ids_crc32"], "n_tokens", "start") \
        .select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op9_token_files")
def op9_token_files(spark, sf_dir):
    import public_tokenizers

    path = scratch_path(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), path,
                 public_tokenizers.path("word_bpe_49k.json"))
    return token_digests(read_tokens(spark, path))
