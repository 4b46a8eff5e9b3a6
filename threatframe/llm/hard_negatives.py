"""Hard-negative mining by a secondary-sort shuffle (operator 13).

Rows become integer vectors, floor(256 * x), packed once into blocks of at most
BLOCK_ROWS; the anchors into blocks of at most ANCHOR_BLOCK.  Every anchor block
meets every row block once per pass, as one matrix product in a task of its own
(anchor blocks are sent to each group of row blocks, row blocks to each anchor
block; nothing is broadcast or collected).

Pass 1 keeps the best `positives` same-label rows of each anchor and block, which
is enough to know the anchor's positives.  Pass 2 knows the positives, so a block
keeps, for each anchor and positive, the first `negatives` different-label rows of
its score window.  Both passes aggregate exactly: what a block leaves out has that
many better rows in the same block.

The records left are keys of (anchor, descending score, negatives after positives,
id), packed into bytes that sort in this order.  repartitionAndSortWithinPartitions
brings each anchor's records together in order; an iterator opens a window at each
positive, gives every negative to the open windows it fits and closes a window once
it is full, so no anchor is ever held in memory.

Rows with a null label, a null vector, or a null or non-finite component take no
part; nor do rows without an id.  An empty vector has product 0 with other empty
ones; vectors of different length are not compared.  Equal rows that repeat count
once, as do rows of one id, side and score.  Rows of one id with different labels
or vectors are rows of their own; each such anchor is mined by itself, and an id is
never its own positive or negative.  A score beyond the long range is held at its
end.  Ties go by smaller id.  An empty table, or one without anchors, gives no
rows.  Columns other than the three named ones are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from threatframe.llm.common import query, table, written

BLOCK_ROWS = 4096
ANCHOR_BLOCK = 8192
#: Row blocks in a group, and anchors in one matrix product: bounds of a task's memory.
GROUP_BLOCKS = 8
_SLICE = 512
POSITIVES = 5
NEGATIVES = 10
#: A negative's score lies between LOW and HIGH hundredths of the positive's.
LOW, HIGH = 30, 90
SCALE = 256

_I64 = np.iinfo(np.int64)
#: Components up to this size multiply exactly in double precision, see `_products`.
_SMALL = 1 << 20
_BLOCK = ("dim int, wide boolean, n int, ids binary, labels binary, vectors binary")
_TOP = "anchor long, twin long, is_positive boolean, score long, id long"


# --- vectors and blocks ---------------------------------------------------------

def usable(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, v array<double>) of the rows that take part."""
    v = F.col(vec_col)
    x = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                  F.transform(v, lambda c: c.cast("double")).alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return x.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
                    & ~F.coalesce(bad, F.lit(False)))


def _whole(flat: np.ndarray) -> tuple[np.ndarray, bool]:
    """floor(SCALE * x) as 64-bit integers, or as Python integers if any is too large."""
    with np.errstate(over="ignore"):
        scaled = np.floor(SCALE * flat)
    if not len(flat) or np.abs(scaled).max() < 1 << 31:
        return scaled.astype(np.int64), False
    # x * 256 only moves the exponent: exact in integers even where the double overflows
    from fractions import Fraction

    return np.array([Fraction(float(x)) * SCALE // 1 for x in flat], dtype=object), True


def _pack(block_rows: int):
    def run(batches):
        for b in batches:
            vec = b.column("v")
            at = vec.offsets.to_numpy()
            flat = vec.values.to_numpy(zero_copy_only=False)
            ids = b.column("id").to_numpy(zero_copy_only=False)
            labels = b.column("label").to_numpy(zero_copy_only=False)
            dims = np.diff(at)
            out: list[tuple] = []
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                m = flat[at[rows][:, None] + np.arange(dim)].astype(np.float64)
                wide = np.abs(m).max(axis=1, initial=0) * SCALE >= _SMALL
                for kind in (False, True):
                    some = np.flatnonzero(wide == kind)
                    some = some[np.argsort(ids[rows[some]], kind="stable")]
                    for i in range(0, len(some), block_rows):
                        part = some[i:i + block_rows]
                        out.append((int(dim), kind, len(part), ids[rows[part]].astype("<i8").tobytes(),
                                    labels[rows[part]].astype("<i8").tobytes(),
                                    m[part].astype("<f8").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], t) for k, t in enumerate(
                    (pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                names=["dim", "wide", "n", "ids", "labels", "vectors"])
    return run


def blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """Pack the rows of each Arrow batch into blocks, ids ascending inside a block."""
    return rows.mapInArrow(_pack(block_rows), _BLOCK)


class _Side:
    """One unpacked block."""

    def __init__(self, n: int, dim: int, ids: bytes, labels: bytes, vectors: bytes):
        self.ids = np.frombuffer(ids, "<i8")
        self.labels = np.frombuffer(labels, "<i8")
        flat, self.exact = _whole(np.frombuffer(vectors, "<f8"))
        self.m = flat.reshape(n, dim)


def _scores(a: _Side, b: _Side):
    """(anchor row, its scores), a slice of anchors at a time."""
    for i in range(0, len(a.ids), _SLICE):
        yield from enumerate(_products(a, b, slice(i, i + _SLICE)), i)


def _products(whole: _Side, b: _Side, some: slice) -> np.ndarray:
    """Exact integer inner products, held inside the long range."""
    a, dim = whole.m[some], whole.m.shape[1]
    if not dim or not len(a):
        return np.zeros((len(a), len(b.ids)), dtype=np.int64)
    if not (whole.exact or b.exact):
        top = int(np.abs(a).max()) * int(np.abs(b.m).max()) * dim
        if top < 1 << 53:  # every partial sum is an exact double
            return (a.astype(np.float64) @ b.m.T.astype(np.float64)).astype(np.int64)
        if top <= _I64.max:
            return a @ b.m.T
    return np.clip(a.astype(object) @ b.m.astype(object).T, _I64.min, _I64.max).astype(np.int64)


def _first_of(order: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The first k of `order`, rows of one id and score once."""
    head = order[:2 * k + 8]
    while True:
        s, i = score[head], ids[head]
        new = np.ones(len(head), dtype=bool)
        new[1:] = (s[1:] != s[:-1]) | (i[1:] != i[:-1])
        if new.sum() >= k or len(head) == len(order):
            return head[new][:k]
        head = order[:2 * len(head)]


def _best_same(a: _Side, twins: np.ndarray, b: _Side, k: int):
    for i, scores in _scores(a, b):
        same = np.flatnonzero((b.labels == a.labels[i]) & (b.ids != a.ids[i]))
        s = scores[same]
        if len(s) > 8 * k:  # cutting at a score keeps all its ties
            keep = s >= np.partition(s, len(s) - 4 * k)[len(s) - 4 * k]
            if len(np.unique(b.ids[same[keep]])) >= k:
                same, s = same[keep], s[keep]
        top = _first_of(np.lexsort((b.ids[same], ~s)), s, b.ids[same], k)
        for j in top:
            yield int(a.ids[i]), int(twins[i]), True, int(s[j]), int(b.ids[same[j]])


def _window(positive: int) -> tuple[int, int]:
    """Smallest and largest negative score of a positive's window (empty if crossed)."""
    return -(-LOW * positive // 100), HIGH * positive // 100


def _best_other(a: _Side, twins: np.ndarray, positives: list, b: _Side, k: int):
    for i, s in _scores(a, b):
        spans = [_window(p) for p in positives[i]]
        spans = [(lo, hi) for lo, hi in spans if lo <= hi]
        if not spans:
            continue
        fit = np.flatnonzero((b.labels != a.labels[i]) & (b.ids != a.ids[i])
                             & (s >= max(min(x for x, _ in spans), _I64.min))
                             & (s <= min(max(y for _, y in spans), _I64.max)))
        s = s[fit]
        wanted: set[int] = set()
        for lo, hi in spans:
            inside = np.flatnonzero((s >= lo) & (s <= hi))
            t = s[inside]
            if len(t) > 8 * k:
                keep = t >= np.partition(t, len(t) - 4 * k)[len(t) - 4 * k]
                if len(np.unique(b.ids[fit[inside[keep]]])) >= k:
                    inside, t = inside[keep], t[keep]
            order = np.lexsort((b.ids[fit[inside]], ~t))
            wanted.update(inside[_first_of(order, t, b.ids[fit[inside]], k)].tolist())
        for j in wanted:
            yield int(a.ids[i]), int(twins[i]), False, int(s[j]), int(b.ids[fit[j]])


def _records(found) -> pa.RecordBatch:
    cols = list(zip(*found)) or [()] * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.bool_(), pa.int64(),
                                               pa.int64()))],
        names=["anchor", "twin", "is_positive", "score", "id"])


# --- the two passes -------------------------------------------------------------

def _meet(packed: DataFrame, anchors: DataFrame, n_groups: int, n_parts: int,
          compare) -> DataFrame:
    """Records of every row block with every anchor, by (row group, anchor part): the
    anchors of a part make one matrix, the blocks of a group meet it one by one."""
    left = packed.withColumn("grp", F.pmod(F.xxhash64("ids"), F.lit(n_groups)).cast("int")) \
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))
    right = anchors.withColumn("part", F.pmod(F.xxhash64("anchor", "twin"), F.lit(n_parts))
                               .cast("int")) \
        .withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))

    def run(rows: pa.Table, some: pa.Table) -> pa.Table:
        out: list[pa.RecordBatch] = []
        by_dim: dict[int, list[int]] = {}
        for k, d in enumerate(some.column("dim").to_pylist()):
            by_dim.setdefault(d, []).append(k)
        sides = {}
        for d, at in by_dim.items():
            t = some.take(pa.array(at))
            v = t.column("v").combine_chunks()
            side = _Side(len(at), d, t.column("anchor").to_numpy().astype("<i8").tobytes(),
                         t.column("label").to_numpy().astype("<i8").tobytes(),
                         v.flatten().to_numpy(zero_copy_only=False).astype("<f8").tobytes())
            more = t.column("scores").to_pylist() if "scores" in t.column_names else None
            sides[d] = side, t.column("twin").to_numpy(), more
        for r in rows.select(["dim", "n", "ids", "labels", "vectors"]).to_batches(max_chunksize=1):
            d = r.column("dim")[0].as_py()
            if d in sides:
                one = _Side(r.column("n")[0].as_py(), d, *(r.column(c)[0].as_py()
                                                           for c in ("ids", "labels", "vectors")))
                out.append(_records(compare(*sides[d], one)))
        return pa.Table.from_batches(out or [_records([])])

    return left.groupBy("grp", "part").cogroup(right.groupBy("grp", "part")) \
        .applyInArrow(run, _TOP)


def mine(df: DataFrame, is_anchor, id_col: str = "vec_id", vec_col: str = "embedding",
         label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES,
         block_rows: int = BLOCK_ROWS, anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `is_anchor` is a condition on the column `id`.
    """
    spark = df.sparkSession
    rows = usable(df, id_col, vec_col, label_col)
    packed = written(blocks(rows, block_rows), "negatives-blocks")
    # equal anchor rows once; rows of one id that differ are anchors of their own
    anchors = written(rows.filter(is_anchor).withColumnRenamed("id", "anchor")
                      .withColumn("twin", F.xxhash64("label", "v"))
                      .dropDuplicates(["anchor", "label", "v"])
                      .withColumn("dim", F.size("v")), "negatives-anchors")
    # both counts grow with the table; a small one is still dealt over all cores
    n_parts = max(1, -(-anchors.count() // anchor_block))
    n_groups = max(2 * spark.sparkContext.defaultParallelism,
                   -(-packed.count() // GROUP_BLOCKS))

    same = _meet(packed, anchors, n_groups, n_parts,
                 lambda a, twins, _, b: _best_same(a, twins, b, positives))
    # partial: best of a block; here: best of all blocks, ≤ positives · blocks rows a key
    ordered = F.row_number().over(_by_anchor())
    found = same.dropDuplicates(["anchor", "twin", "score", "id"]) \
        .withColumn("r", ordered).filter(F.col("r") <= positives).drop("r")
    found = written(found, "negatives-positives")

    scores = found.groupBy("anchor", "twin").agg(F.collect_set("score").alias("scores"))  # ≤ positives
    others = _meet(packed, anchors.join(scores, ["anchor", "twin"]), n_groups, n_parts,
                   lambda a, twins, s, b: _best_other(a, twins, s, b, negatives))
    keys = found.unionByName(others)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    mined = keys.rdd.map(_key).map(lambda k: (k, None)).repartitionAndSortWithinPartitions(
        n, partitionFunc=lambda k: zlib.crc32(k[:16])).mapPartitions(
        lambda pairs: _windows((k for k, _ in pairs), negatives))
    return spark.createDataFrame(
        mined, "anchor_id long, positive_id long, rank int, negative_id long, "
               "positive_score long, negative_score long", verifySchema=False)


def _by_anchor():
    from pyspark.sql import Window

    return Window.partitionBy("anchor", "twin").orderBy(F.col("score").desc(), "id")


# --- secondary sort --------------------------------------------------------------

_KEY = struct.Struct(">QQQ?Q")
_HALF = 1 << 63


def _key(row) -> bytes:
    """Bytes in the order (anchor, twin, descending score, positives first, id)."""
    return _KEY.pack(row.anchor + _HALF, row.twin + _HALF, _HALF - 1 - row.score,
                     not row.is_positive, row.id + _HALF)


def _windows(keys, negatives: int):
    """Stream sorted keys: positives open windows, negatives go to the open ones."""
    who = last = None
    opened: list[list] = []
    for key in keys:
        if key == last:
            continue
        last = key
        anchor, twin, down, is_negative, other = _KEY.unpack(key)
        if (anchor, twin) != who:
            who, opened = (anchor, twin), []
        score, other = _HALF - 1 - down, other - _HALF
        if not is_negative:
            lo, hi = _window(score)
            if lo <= hi:
                opened.append([lo, hi, 0, other, score])
            continue
        for w in opened:
            if w[0] <= score <= w[1]:
                w[2] += 1
                yield anchor - _HALF, w[3], w[2], other, w[4], score
        # full windows and those that all later scores miss are closed
        opened = [w for w in opened if w[2] < negatives and w[0] <= score]


@query("op13_hard_negatives")
def op13_hard_negatives(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    flipped = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10) \
        .otherwise(F.col("label"))
    return mine(e.select("vec_id", "embedding", flipped.alias("label")),
                F.col("id") % 100 == 0)
