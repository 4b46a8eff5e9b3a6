"""N-gram Jaccard self-join with rare-first prefix filtering (operator 5).

Documents are sets of distinct word shingles (64-bit hashes; with fewer words
than a shingle, the whole sequence is one).  Equal sets are one class, named by
its smallest doc_id.  Shingles are ordered rare first: frequencies over all
documents come from a sketch of 2^SKETCH_BITS counters, of fixed size, which is
summed and broadcast; it only decides the order, ties go by hash, and any common
order gives the same links.  A class joins on the shingles of its prefix, the
first n - ceil(t n) + 1, and a candidate must pass

* the length filter, min(n) >= t max(n),
* the positional filter: what is left after the shared shingle suffices,
* the suffix filter: the sets' counts per cell of hash space differ by no more
  than two sets of enough overlap can differ (about n/4 cells, a byte each).

Components come first, in two rounds, neither of which emits all pairs of a
group: first every member of a prefix group meets one centre, the member in which
the shingle stands earliest (the text with the fewest rare shingles of its own);
then only pairs whose members are still in different components are made and
verified on their whole sets.  A link inside a component cannot change it, so the
components are those of all links, and no link leaves one.  All links are then
found inside the components: their classes are dealt to blocks of bounded bytes,
and every pair of classes meets once, in one pair of blocks, where whole sets are
compared.  Blocks return counts of links, a row per class, unless the links
themselves are asked for.  `n_links` of a row is the number of other rows it is
linked to; rows of one class are linked.

Null or empty texts, and texts without words, have empty sets and link with
nothing; a null doc_id stays alone.  Repeated rows are one class.  Rows that
share a doc_id with different texts are one node.  An empty table gives no rows.
Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from threatframe.llm.common import query, table, tidy, whole_text, written
from threatframe.operators.graph import components

SKETCH_BITS = 22
_CHUNK = 1 << 16
_GROUP_BYTES = 1_000_000
BLOCK_BYTES = 4_000_000  # of whole sets
BLOCK = 1024
_WIDTH = 4096
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_BASE = _U(0xD1342543DE82EF95)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of one or more texts."""
    raw = np.frombuffer(text, np.uint8)
    gap = _SPACE[raw]
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(first):
        return np.zeros(0, dtype=np.uint64)
    size = last - first
    power = np.cumprod(np.concatenate([[_U(1)], np.full(int(size.max()) - 1, _BASE)]),
                       dtype=np.uint64)
    inside = ~gap
    place = np.flatnonzero(inside) - np.repeat(first, size)
    value = _BYTE[raw[inside]] * power[place]
    return _mix(np.add.reduceat(value, np.cumsum(size) - size) + size.astype(np.uint64))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one text's word hashes."""
    if not len(words):
        return words
    m = min(k, len(words))
    total = np.full(len(words) - m + 1, _U(m), dtype=np.uint64)
    for j in range(m):
        total = total * _U(0x9E3779B97F4A7C15) + words[j:len(words) - m + 1 + j]
    return np.unique(_mix(total))


def text_sets(texts: list[bytes], k: int):
    """Yield the shingle set of each text; words are hashed for many texts at once."""
    some: list[bytes] = []
    held = 0
    for t in [*texts, None]:
        if t is not None:
            some.append(t)
            held += len(t)
        if some and (t is None or held >= _GROUP_BYTES):
            # the words of each text: a joint hash, cut by word counts
            every = word_hashes(b" ".join(some))
            ends = np.cumsum([len(x.split()) for x in some])
            for i, j in zip([0, *ends[:-1]], ends):
                yield shingles(every[i:j], k)
            some, held = [], 0


def signature(items: bytes) -> bytes | None:
    """Name of a class: digest of the set's bytes; none for the empty set."""
    return hashlib.blake2b(items, digest_size=16).digest() if items else None


def cells(found: np.ndarray) -> bytes:
    """Counts of the set per cell of hash space: a power of two of about n/4 cells."""
    bits = max(3, int(len(found) // 4).bit_length())
    counts = np.bincount((found >> _U(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b""


def overlap_bound(a: bytes, b: bytes) -> int | None:
    """No two sets with these cells share more; None if unknown."""
    if not a or not b:
        return None
    x, y = np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)
    while len(x) > len(y):
        x = x.reshape(-1, 2).sum(1)
    while len(y) > len(x):
        y = y.reshape(-1, 2).sum(1)
    return int(np.minimum(x, y).sum())


def _tidy(run):
    return lambda batches: tidy(run(batches))


def _scan(k: int):
    """Per document: set size and signature; per task: the sketch of its shingles."""
    def run(batches):
        sketch = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)

        def rows(ids, n, sig, chunk, counts):
            return pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(sig, pa.binary()),
                 pa.array(chunk, pa.int32()), pa.array(counts, pa.binary())],
                names=["doc_id", "n", "sig", "chunk", "counts"])

        for b in batches:
            n, sig = [], []
            held: list[np.ndarray] = []
            for s in text_sets(b.column("text").cast(pa.binary()).to_pylist(), k):
                n.append(len(s))
                sig.append(signature(s.tobytes()))
                held.append(s)
                if len(s) > 1 << 16 or len(held) > 500:
                    _count(sketch, held)
            _count(sketch, held)
            none = [None] * len(n)
            yield rows(b.column("doc_id"), n, sig, none, none)
        for c in range((1 << SKETCH_BITS) // _CHUNK):
            part = sketch[c * _CHUNK:(c + 1) * _CHUNK]
            if part.any():
                yield rows(pa.array([None], pa.int64()), [None], [None], [c],
                           [zlib.compress(part.tobytes(), 1)])
    return run


def _count(sketch: np.ndarray, held: list[np.ndarray]) -> None:
    if held:
        at, n = np.unique(np.concatenate(held) >> _U(64 - SKETCH_BITS), return_counts=True)
        sketch[at.astype(np.int64)] += n.astype(np.uint32)
        held.clear()


def _sum_sketch(batches):
    """Sums per chunk; a task holds at most the 2^SKETCH_BITS counters."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for c, z in zip(b.column("chunk").to_pylist(), b.column("counts").to_pylist()):
            part = np.frombuffer(zlib.decompress(z), np.uint32).astype(np.uint64)
            sums[c] = sums[c] + part if c in sums else part
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()),
         pa.array([np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes() for x in sums.values()],
                  pa.binary())], names=["chunk", "counts"])


def _prefixes(k: int, num: int, den: int, sketch):
    def run(batches):
        often = sketch.value
        for b in batches:
            n, pre, cell, sig = [], [], [], []
            for s in text_sets(b.column("text").cast(pa.binary()).to_pylist(), k):
                keep = len(s) - -(-num * len(s) // den) + 1 if len(s) else 0
                order = np.lexsort((s, often[(s >> _U(64 - SKETCH_BITS)).astype(np.int64)]))
                n.append(len(s))
                pre.append(s[order[:keep]].view(np.int64))
                cell.append(cells(s))
                sig.append(signature(s.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(sig, pa.binary()),
                 pa.array(pre, pa.list_(pa.int64())), pa.array(cell, pa.binary())],
                names=["doc_id", "n", "sig", "prefix", "cells"])
    return run


def _whole_sets(k: int):
    def run(batches):
        for b in batches:
            sets = [s.tobytes() for s in text_sets(
                b.column("text").cast(pa.binary()).to_pylist(), k)]
            sig = [signature(s) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(sig, pa.binary()),
                                              pa.array(sets, pa.binary())], names=["sig", "items"])
    return run


def _signed(k: int, text_col: str):
    def run(batches):
        for b in batches:
            texts = [t or b"" for t in b.column(text_col).cast(pa.binary()).to_pylist()]
            sig = [signature(s.tobytes()) for s in text_sets(texts, k)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sig, pa.binary())],
                                             names=[*b.schema.names, "sig"])
    return run


def with_signature(docs: DataFrame, k: int = 5, text_col: str = "text") -> DataFrame:
    """Add `sig`, the name of the row's class: a digest of its shingle set, null if empty."""
    schema = T.StructType([*docs.schema, T.StructField("sig", T.BinaryType())])
    return docs.mapInArrow(_tidy(_signed(k, text_col)), schema)


def _suffix_filter(num: int, den: int):
    def run(batches):
        for b in batches:
            na, nb = b.column("na").to_pylist(), b.column("nb").to_pylist()
            keep = []
            for i, (x, y) in enumerate(zip(b.column("ca").to_pylist(), b.column("cb").to_pylist())):
                most = overlap_bound(x, y)
                keep.append(most is None or (num + den) * most >= num * (na[i] + nb[i]))
            names = ["a", "b", "ga", "gb"]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names], names=names) \
                .filter(pa.array(keep, pa.bool_()))
    return run


def _verify(num: int, den: int):
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist()):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(den * both >= num * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]) \
                .filter(pa.array(keep, pa.bool_()))
    return run


def overlaps(x: list[np.ndarray], y: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of sets x with sets y (or with each other)."""
    flat = [np.concatenate(s) for s in ([x] if y is None else [x, y])]
    if y is None:
        words, many = np.unique(flat[0], return_counts=True)
        words = words[many > 1]
    else:
        words = np.intersect1d(*flat)
    spots = []
    for sets, all_ in zip([x, y], flat):
        at = np.searchsorted(words, all_)
        hit = np.flatnonzero(words[np.minimum(at, len(words) - 1)] == all_) if len(words) else at[:0]
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit]
        order = np.argsort(at[hit], kind="stable")
        spots.append((at[hit][order], row[order], len(sets)))
    both = np.zeros((len(x), len(x if y is None else y)), dtype=np.int64)
    for lo in range(0, len(words), _WIDTH):
        sides = []
        for at, row, n in spots:
            i, j = np.searchsorted(at, [lo, lo + _WIDTH])
            m = np.zeros((n, min(_WIDTH, len(words) - lo)), dtype=np.float32)
            m[row[i:j], at[i:j] - lo] = 1
            sides.append(m)
        both += (sides[0] @ sides[-1].T).astype(np.int64)
    return both


def _block_links(num: int, den: int, as_pairs: bool):
    """Links between the classes of two blocks of a component, or of one block:
    pairs, or the number of linked rows per class."""
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        _, lo, hi = key
        left, right = rows[rows["block"] == lo], rows[rows["block"] == hi]
        out = {"a": [], "b": []} if as_pairs else {"node": [], "found": []}
        if len(left) and len(right):
            x, y = ([np.frombuffer(s, np.uint64) for s in part["items"]] for part in (left, right))
            both = overlaps(x) if lo == hi else overlaps(x, y)
            every = np.add.outer([len(s) for s in x], [len(s) for s in y]) - both
            hit = den * both >= num * every
            if lo == hi:
                np.fill_diagonal(hit, False)
            a, b = left["node"].to_numpy(), right["node"].to_numpy()
            if as_pairs:
                i, j = np.nonzero(np.triu(hit) if lo == hi else hit)
                out = {"a": [np.minimum(a[i], b[j])], "b": [np.maximum(a[i], b[j])]}
            else:
                out = {"node": [a], "found": [hit @ right["copies"].to_numpy()]}
                if lo != hi:
                    out["node"].append(b)
                    out["found"].append(hit.T @ left["copies"].to_numpy())
        empty = np.zeros(0, dtype=np.int64)
        return pd.DataFrame({k: np.concatenate(v) if v else empty for k, v in out.items()})
    return run


def _fits(num: int, den: int) -> Column:
    """Length and positional filter of the pair (n, pos), (n2, pos2)."""
    left = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))
    return ((den * F.least("n", "n2") >= num * F.greatest("n", "n2"))
            & ((num + den) * left >= num * (F.col("n") + F.col("n2"))))


class JaccardJoin:
    """One run of the join; intermediate tables are written to the shared folder."""

    def __init__(self, docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str):
        self.spark, self.k, self.num, self.den = docs.sparkSession, k, num, den
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                                whole_text(text_col).alias("text"))
        self.sets: list[DataFrame] = []

    def solve(self) -> DataFrame:
        """One row per class: node, sig, rep (smallest doc_id), copies (rows) and group,
        the smallest node of its component of links between texts."""
        scan = written(self.docs.mapInArrow(
            _tidy(_scan(self.k)), "doc_id long, n long, sig binary, chunk int, counts binary"), "sets")
        self.rows = scan.filter(F.col("chunk").isNull()).select("doc_id", "n", "sig")
        classes = written(
            self.rows.filter("sig is not null and doc_id is not null").groupBy("sig")
            .agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
            .withColumn("node", F.monotonically_increasing_id()), "jaccard-classes")
        reps = self._prefix_table(self._sketch(scan), classes)
        shared = self._shared(reps)
        centre = shared.filter("pos * 4294967296 + n = least").groupBy("h") \
            .agg(F.min("node").alias("c")).select(F.col("h").alias("ch"), "c")
        centre = shared.select(F.col("h").alias("h2"), F.col("node").alias("node2"),
                               F.col("n").alias("n2"), F.col("pos").alias("pos2")) \
            .join(centre, (F.col("h2") == F.col("ch")) & (F.col("node2") == F.col("c"))) \
            .select("h2", "node2", "n2", "pos2")
        first = self._links(shared.join(centre, F.col("h") == F.col("h2")), reps, "jaccard-star")
        found = written(components(first, "a", "b").select(F.col("node").alias("found"), "component"),
                        "jaccard-components")
        named = (shared.join(found, F.col("node") == F.col("found"), "left")
                 .select("h", "node", "n", "pos", F.coalesce("component", "node").alias("label")))
        named = written(named, "jaccard-labelled")
        open_ = named.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")) \
            .filter("lo <> hi").select("h")
        rest = named.join(open_, "h", "left_semi")
        other = rest.select(F.col("h").alias("h2"), F.col("node").alias("node2"),
                            F.col("n").alias("n2"), F.col("pos").alias("pos2"),
                            F.col("label").alias("label2"))
        second = self._links(rest.join(other, (F.col("h") == F.col("h2"))
                                       & (F.col("label") < F.col("label2"))
                                       & _fits(self.num, self.den)), reps, "jaccard-rest")
        final = components(first.unionByName(second), "a", "b") \
            .select(F.col("node").alias("found"), "component")
        return written(classes.join(final, F.col("node") == F.col("found"), "left")
                       .select("node", "sig", "rep", "copies",
                               F.coalesce("component", "node").alias("group")), "jaccard-groups")

    def run(self) -> DataFrame:
        groups = self.solve()
        found = self._inside(groups, False)
        groups, of_doc = self._one_node_per_id(groups)
        least = groups.groupBy("group").agg(F.min("rep").alias("component_id"))
        of_class = groups.join(least, "group")
        if found is not None:
            found = found.groupBy("node").agg(F.sum("found").alias("found"))
            of_class = of_class.join(found, "node", "left")
        else:
            of_class = of_class.withColumn("found", F.lit(0))
        of_class = of_class.select(
            F.col("sig").alias("_sig"), "component_id",
            (F.coalesce("found", F.lit(0)) + F.col("copies") - 1).alias("_links"))
        key = F.when(F.col("doc_id").isNotNull(), F.col("sig"))
        rows = self.rows.join(of_class, key == F.col("_sig"), "left")
        if of_doc is not None:  # texts without words follow the others of their doc_id
            of_doc = of_doc.join(least.withColumnRenamed("component_id", "_of_doc"), "group") \
                .select(F.col("doc_id").alias("_doc"), "_of_doc")
            blank = F.when(F.col("sig").isNull(), F.col("doc_id"))
            rows = rows.join(of_doc, blank == F.col("_doc"), "left") \
                .withColumn("component_id", F.coalesce("component_id", "_of_doc"))
        return (rows
                .select("doc_id", F.col("n").alias("n_shingles"),
                        F.coalesce("component_id", "doc_id").alias("component_id"),
                        F.coalesce("_links", F.lit(0)).cast("long").alias("n_links")))

    def _one_node_per_id(self, groups: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """`groups` with those joined that a doc_id of different texts has rows in, and
        the group of each such doc_id; None if there is none."""
        rows = self.rows.filter("doc_id is not null")
        mixed = written(rows.groupBy("doc_id").agg(
            F.min("sig").alias("lo"), F.max("sig").alias("hi"), F.count("sig").alias("worded"),
            F.count(F.lit(1)).alias("held"))
            .filter("lo <> hi or (worded > 0 and worded < held)").select("doc_id"), "jaccard-mixed")
        if mixed.isEmpty():
            return groups, None
        places = written(rows.filter("sig is not null").join(mixed, "doc_id", "left_semi")
                         .select("doc_id", "sig").distinct()
                         .join(groups.select("sig", "group"), "sig")
                         .select("doc_id", "group").distinct(), "jaccard-places")
        first = places.groupBy("doc_id").agg(F.min("group").alias("first"))
        merged = components(places.join(first, "doc_id"), "group", "first") \
            .select(F.col("node").alias("found"), "component")

        def renamed(df: DataFrame) -> DataFrame:
            return df.join(merged, F.col("group") == F.col("found"), "left") \
                .withColumn("group", F.coalesce("component", "group")).drop("found", "component")

        return renamed(groups), renamed(first.withColumnRenamed("first", "group"))

    def links(self) -> tuple[DataFrame, DataFrame]:
        """All links between classes (a < b), each once, and the rows of the classes
        (doc_id, n_shingles, node).  Links grow with the square of a family's size."""
        groups = self.solve()
        pairs = self._inside(groups, True)
        if pairs is None:
            pairs = self.spark.createDataFrame([], "a long, b long")
        rows = self.rows.filter("doc_id is not null").join(groups.select("sig", "node"), "sig")
        return pairs, rows.select("doc_id", F.col("n").alias("n_shingles"), "node")

    def _inside(self, groups: DataFrame, as_pairs: bool) -> DataFrame | None:
        """Every pair of classes of a component, compared once; None without links."""
        if not self.sets:
            return None
        sets = self.sets[0] if len(self.sets) == 1 else self.sets[0].unionByName(self.sets[1])
        held = groups.groupBy("group").agg(F.count(F.lit(1)).alias("classes")) \
            .filter("classes > 1")
        members = (groups.join(held, "group").join(sets, "sig").dropDuplicates(["sig"])
                   .select("group", "node", "copies", "items"))
        members = written(members, "jaccard-members")
        blocks = members.groupBy("group").agg(F.greatest(
            F.ceil(F.sum(F.octet_length("items")) / BLOCK_BYTES), F.ceil(F.count(F.lit(1)) / BLOCK))
            .cast("int").alias("blocks"))
        dealt = (members.join(blocks, "group")
                 .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
                 .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                 .withColumn("lo", F.least("block", "other"))
                 .withColumn("hi", F.greatest("block", "other")))
        # without this the grouping would keep the partitioning by `group` of the join
        return written(dealt.select("group", "lo", "hi", "block", "node", "copies", "items")
                       .repartition("group", "lo", "hi").groupBy("group", "lo", "hi")
                       .applyInPandas(_block_links(self.num, self.den, as_pairs),
                                      "a long, b long" if as_pairs else "node long, found long"),
                       "jaccard-inside")

    def _sketch(self, scan: DataFrame):
        rows = (scan.filter(F.col("chunk").isNotNull()).select("chunk", "counts")
                .repartition("chunk").mapInArrow(_sum_sketch, "chunk int, counts binary")
                .collect())  # 2^SKETCH_BITS counters in all
        sketch = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        for r in rows:
            sketch[r.chunk * _CHUNK:(r.chunk + 1) * _CHUNK] = np.frombuffer(r.counts, np.uint32)
        return self.spark.sparkContext.broadcast(sketch)

    def _prefix_table(self, sketch, classes: DataFrame) -> DataFrame:
        rows = self.docs.filter("doc_id is not null").mapInArrow(
            _tidy(_prefixes(self.k, self.num, self.den, sketch)),
            "doc_id long, n long, sig binary, prefix array<long>, cells binary")
        mine = classes.select(F.col("rep").alias("doc_id"), "sig", "node")
        return written(rows.join(mine, ["doc_id", "sig"])
                       .dropDuplicates(["doc_id", "sig"])
                       .select("node", F.col("doc_id").alias("rep"), "sig", "n", "prefix", "cells"),
                       "jaccard-prefixes")

    def _shared(self, reps: DataFrame) -> DataFrame:
        """The prefix entries (h, node, n, pos) of shingles that two or more classes have."""
        rows = reps.select("node", "n", F.posexplode("prefix").alias("pos", "h"))
        many = rows.groupBy("h").agg(
            F.count(F.lit(1)).alias("c"),
            F.min(F.col("pos") * F.lit(4294967296) + F.col("n")).alias("least")) \
            .filter("c > 1").select("h", "least")
        return written(rows.join(many, "h"), "jaccard-shared")

    def _links(self, met: DataFrame, reps: DataFrame, name: str) -> DataFrame:
        """Verified links (a, b) of met prefix entries."""
        pairs = (met.filter(_fits(self.num, self.den) & (F.col("node") != F.col("node2")))
                 .select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))
                 .distinct())
        side = reps.select("node", "sig", "n", "cells")
        wide = (pairs.join(side.select(F.col("node").alias("a"), F.col("sig").alias("ga"),
                                       F.col("n").alias("na"), F.col("cells").alias("ca")), "a")
                .join(side.select(F.col("node").alias("b"), F.col("sig").alias("gb"),
                                  F.col("n").alias("nb"), F.col("cells").alias("cb")), "b"))
        pairs = written(wide.select("a", "b", "ga", "gb", "na", "nb", "ca", "cb")
                        .mapInArrow(_suffix_filter(self.num, self.den),
                                    "a long, b long, ga binary, gb binary"), f"{name}-pairs")
        if pairs.isEmpty():
            return pairs.select("a", "b")
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        ids = reps.select("node", "rep").join(nodes, "node", "left_semi") \
            .select(F.col("rep").alias("doc_id")).distinct()
        # rows of the same doc_id but another class are read too; sig tells them apart
        sets = written(self.docs.join(ids, "doc_id", "left_semi").dropDuplicates()
                       .mapInArrow(_tidy(_whole_sets(self.k)), "sig binary, items binary")
                       .filter("sig is not null"), f"{name}-sets")
        self.sets.append(sets)
        whole = (pairs.join(sets.select(F.col("sig").alias("gb"), F.col("items").alias("sb")), "gb")
                 .join(sets.select(F.col("sig").alias("ga"), F.col("items").alias("sa")), "ga"))
        return written(whole.select("a", "b", "sa", "sb")
                       .mapInArrow(_verify(self.num, self.den), "a long, b long").distinct(),
                       f"{name}-links")


def representatives(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sig: of each component of texts, the smallest doc_id and its class.
    Texts are told apart even where they share a doc_id."""
    groups = JaccardJoin(docs, k, num, den, id_col, text_col).solve()
    return groups.groupBy("group").agg(F.min(F.struct("rep", "sig")).alias("least")) \
        .select(F.col("least.rep").alias("doc_id"), "least.sig")


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, n_links: documents are linked when the Jaccard
    similarity of their k-word shingle sets is at least num/den."""
    return JaccardJoin(docs, k, num, den, id_col, text_col).run()


def jaccard_links(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10,
                  id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links of different shingle sets as pairs of nodes, and the rows of the nodes."""
    return JaccardJoin(docs, k, num, den, id_col, text_col).links()


@query("op5_shingle_join")
def op5_shingle_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)
