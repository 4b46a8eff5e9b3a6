"""Byte-level BPE encoding and decoding by a rank file (operator 10).

Whole texts are split by the pattern; the distinct pieces of a group of texts
are sorted into length buckets (powers of two), and each bucket is a padded
matrix of ids.  In every round each row merges its leftmost pair of least rank;
pairs are looked up in an open-addressed hash table of numpy arrays, and rows
without a further merge leave the matrix (compaction).  Pieces longer than
`LONG` bytes are single rows that merge all non-overlapping copies of their
least pair in one round, unless a merge would create a pair of no greater rank;
then only the leftmost is merged.  A piece that is a token itself is that token.

Null text counts as empty: no ids, empty decoding.  Equal rows give equal
results, each row its own.  Only the id and text columns are read.  An empty
table gives no rows.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from threatframe.llm.common import query, table, whole_text

LONG = 512
_NONE = np.int32(2**31 - 1)
_GROUP_BYTES = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left id, right id) -> merged id, open addressing with linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 2.5))))
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.vals = np.full(1 << self.bits, _NONE, dtype=np.int32)
        keys = self._key(left, right)
        slot = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] < 0
            self.keys[slot[todo[free]]] = keys[todo[free]]
            won = self.keys[slot[todo]] == keys[todo]
            self.vals[slot[todo[won]]] = merged[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    @staticmethod
    def _key(left, right):
        return (left.astype(np.int64) << 32) | right.astype(np.int64)

    def _slot(self, keys):
        return ((keys.astype(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, _NONE where a pair has none or an id is negative."""
        shape = left.shape
        keys = self._key(left, right).ravel()
        keys[(left.ravel() < 0) | (right.ravel() < 0)] = -2
        slot = self._slot(keys)
        got = self.keys[slot]
        out = np.where(got == keys, self.vals[slot], _NONE)
        on = np.flatnonzero((got != keys) & (got >= 0) & (keys >= 0))
        while len(on):
            slot[on] = (slot[on] + 1) & ((1 << self.bits) - 1)
            got = self.keys[slot[on]]
            hit = got == keys[on]
            out[on[hit]] = self.vals[slot[on[hit]]]
            on = on[~hit & (got >= 0)]
        return out.reshape(shape)


class ByteBpe:
    """Encoder and decoder of one rank file; `limit` bounds the pieces kept per worker (twice)."""

    def __init__(self, path: str, pattern: str, limit: int = 200_000):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.limit = limit
        self.store: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for t, i in self.ranks.items():
            tokens[i] = t
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        rows = [(self.ranks[t[:k]], self.ranks[t[k:]], i) for t, i in self.ranks.items()
                for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        self.pairs = PairTable(*np.array(rows, dtype=np.int32).reshape(-1, 3).T)
        self.token_bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.token_size = np.array([len(t) for t in tokens], dtype=np.int64)
        self.token_at = np.cumsum(self.token_size) - self.token_size
        # \s of the pattern is the White_Space property; for ASCII text the
        # classes are spelt out for the faster bytes engine.
        self.wide = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}")
                                  .replace(r"\S", r"\P{White_Space}")
                                  .replace(r"\s", r"\p{White_Space}"))
        self.plain = re.compile(pattern.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9")
                                .replace("?A-Za-z+", "?[A-Za-z]+").replace("?0-9+", "?[0-9]+")
                                .encode())

    def split(self, text: bytes) -> list[bytes]:
        if text.isascii():
            return self.plain.findall(text)
        return [p.encode() for p in self.wide.findall(text.decode())]

    def _rows(self, ids: np.ndarray) -> list[np.ndarray]:
        """Merge a padded matrix of ids (-1: padding) until no pair is left."""
        done: list = [None] * len(ids)
        which = np.arange(len(ids))
        rank = np.full(ids.shape, _NONE, dtype=np.int32)
        rank[:, :-1] = self.pairs.find(ids[:, :-1], ids[:, 1:])
        cols = np.arange(ids.shape[1])
        while len(ids):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(ids)), at]
            live = best < _NONE
            if not live.all():
                for k in np.flatnonzero(~live):
                    row = ids[k]
                    done[which[k]] = row[row >= 0]
                ids, rank, which, at, best = ids[live], rank[live], which[live], at[live], best[live]
                if not len(ids):
                    break
            r = np.arange(len(ids))
            ids[r, at] = best
            take = np.minimum(cols + (cols > at[:, None]), len(cols) - 1)
            shorter = at + 1 < len(cols)
            ids = np.take_along_axis(ids, take, axis=1)
            rank = np.take_along_axis(rank, take, axis=1)
            ids[shorter, -1] = -1
            rank[shorter, -1] = _NONE
            nxt = np.where(at + 1 < len(cols), ids[r, np.minimum(at + 1, len(cols) - 1)], -1)
            rank[r, at] = self.pairs.find(best, nxt)
            has = at > 0
            rank[r[has], at[has] - 1] = self.pairs.find(ids[r[has], at[has] - 1], best[has])
        return done

    def _long(self, ids: np.ndarray) -> np.ndarray:
        """Merge one long row; all non-overlapping copies of its least pair at once
        where that equals merging them one by one from the left."""
        while len(ids) > 1:
            rank = self.pairs.find(ids[:-1], ids[1:])
            best = rank.min()
            if best == _NONE:
                break
            at = np.flatnonzero(rank == best)
            run = np.cumsum(np.concatenate([[True], np.diff(at) > 1]))
            first = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1])
            at = at[(np.arange(len(at)) - first[run - 1]) % 2 == 0]

            def merged(places):
                new = ids.copy()
                new[places] = best
                keep = np.ones(len(ids), dtype=bool)
                keep[places + 1] = False
                return new[keep], np.cumsum(keep)[places] - 1

            new, spots = merged(at)
            near = np.unique(np.concatenate([spots - 1, spots]))
            near = near[(near >= 0) & (near < len(new) - 1)]
            if len(at) > 1 and len(near) and self.pairs.find(new[near], new[near + 1]).min() <= best:
                new, _ = merged(at[:1])
            ids = new
        return ids

    def _learn(self, pieces: list[bytes]) -> None:
        buckets: dict[int, list[bytes]] = {}
        for p in pieces:
            whole = self.ranks.get(p)
            if whole is not None:
                self.store[p] = whole.to_bytes(4, "little")
            else:
                buckets.setdefault((len(p) - 1).bit_length(), []).append(p)
        for bits, some in buckets.items():
            width = 1 << bits
            if width > LONG:
                for p in some:
                    ids = self._long(self.byte_id[np.frombuffer(p, np.uint8)])
                    self.store[p] = ids.astype("<u4").tobytes()
                continue
            step = max(1, (1 << 20) // width)
            for i in range(0, len(some), step):
                part = some[i:i + step]
                sizes = np.array([len(p) for p in part])
                ids = np.full((len(part), width), -1, dtype=np.int32)
                ids[np.arange(width) < sizes[:, None]] = \
                    self.byte_id[np.frombuffer(b"".join(part), np.uint8)]
                self.store.update(zip(part, (x.astype("<u4").tobytes() for x in self._rows(ids))))

    def _group(self, texts: list[bytes]) -> list[bytes]:
        rows = [self.split(t) for t in texts]
        distinct = set().union(*rows)
        new = distinct.difference(self.store)
        if len(self.store) + len(new) > self.limit:
            self.older, self.store = self.store, {}
            new = distinct
        kept = new & self.older.keys()
        self.store.update(zip(kept, map(self.older.__getitem__, kept)))
        self._learn(list(new - kept))
        ids = self.store.__getitem__
        return [b"".join(map(ids, r)) for r in rows]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        some: list[bytes] = []
        held = 0
        for t in texts:
            some.append(t)
            held += len(t)
            if held >= _GROUP_BYTES:
                out += self._group(some)
                some, held = [], 0
        return out + self._group(some) if some else out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a row of ids."""
        parts = []
        for i in range(0, len(ids), 1 << 18):
            some = ids[i:i + (1 << 18)]
            size = self.token_size[some]
            skip = self.token_at[some] - (np.cumsum(size) - size)
            parts.append(self.token_bytes[np.repeat(skip, size) + np.arange(size.sum())].tobytes())
        return b"".join(parts)


_OPEN: dict[tuple[str, str], ByteBpe] = {}


def _codec(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _OPEN:
        _OPEN[path, pattern] = ByteBpe(path, pattern)
    return _OPEN[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int> of each whole text."""
    def run(batches):
        codec = _codec(path, pattern)
        for b in batches:
            raw = codec.encode(b.column("text").cast(pa.binary()).to_pylist())
            at = np.cumsum([0, *(len(x) // 4 for x in raw)]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(raw), dtype="<i4"))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.ListArray.from_arrays(pa.array(at), flat)],
                names=["doc_id", "ids"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        whole_text(text_col).alias("text"))
    return plain.mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids, decoded binary."""
    def run(batches):
        codec = _codec(path, pattern)
        for b in batches:
            ids = b.column("ids")
            flat, at = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            back = [codec.decode(flat[i:j]) for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids, pa.array(back, pa.binary())],
                                             names=["doc_id", "ids", "decoded"])

    return coded.select("doc_id", "ids").mapInArrow(
        run, "doc_id long, ids array<int>, decoded binary")


@query("op10_byte_bpe")
def op10_byte_bpe(spark, sf_dir):
    import public_tokenizers as public

    path = public.path("byte_bpe_multi_50k.tiktoken")
    coded = encode(table(spark, sf_dir, "documents"), path, public.PATTERN)
    return decode(coded, path, public.PATTERN).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)
        .alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
