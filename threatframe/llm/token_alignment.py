"""Cross-tokenizer alignment by inverted pair bitmaps (operator 11).

Every whole text is encoded by two tokenizers, A on space + text and B, which adds
the space itself.  The tokens of both cover the same bytes, so byte offsets where
either ends cut a text into segments that lie in one A and one B token each: the
segments are the links, and offsets where both end close the groups.

Neither tokenizer joins bytes across a single space between two characters that are
not white space (A's pattern starts a match there, B has no piece with an inner
space), so a text's tokens, links and groups are those of its units, which start at
such spaces; where no piece of B joins a letter and a sign after it, the signs at the
end of a word are a unit too.  A worker keeps the alignment of the units it has met and
asks the tokenizers for new ones only.  Tests compare with both tokenizers on whole
texts.

Inverted index: documents are numbered inside chunks (at most CHUNK_DOCS documents
or about CHUNK_ENTRIES postings, a part of one task).  A chunk holds, for each pair
of ids linked in it, a compressed bitmap of its documents (16-bit numbers, or plain
bits where these are shorter; those of successive groups of texts are OR-merged as
the chunk grows) and multiplicity planes: bit k of plane k says whether 2^k is part
of a posting's further links.  Chunks hold disjoint documents, so the popcounts of a
pair's bitmaps add up to its number of documents and those of the planes to its
number of links.

The chunks are written once.  Only (chunk, pair, popcount) rows are shuffled to add
up the counts, one row for a pair and chunk however frequent the pair is; the counts
then return to the chunks, where the postings give each document its scores.  No
row per document and pair ever leaves a task.

A text that is null, empty, or whose joined A or B tokens differ from the bytes of
space + text (a character that B's rules rewrite) has no tokens: zeros and an empty
digest.  Very long texts are aligned whole.  Rows that repeat a doc_id or a text are
documents of their own, also in the counts; a null doc_id stays null.  An empty table
gives no rows.  Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from threatframe.llm.common import query, table, whole_text, written
from threatframe.llm.wordids import LETTER, PAD, SIGN, UnitRows, classes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

CHUNK_DOCS = 1 << 15
CHUNK_ENTRIES = 4_000_000
#: Bytes of text that are aligned together, and units a worker keeps.
GROUP_BYTES = 1 << 20
KEPT_UNITS = 600_000
_ORD = 16  # bits of a document's number in its chunk

_DOC = {"doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(),
        "n_links": pa.int64(), "groups_sha256": pa.string()}
_CHUNK = ("chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, "
          "n_links array<long>, groups_sha256 array<string>, pairs array<long>, docs array<int>, "
          "links array<long>, bits binary, planes binary, n_planes int")
_SCORED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
           "count_sum long, groups_sha256 string")


# --- tokenizers ------------------------------------------------------------------

def _byte_letters() -> dict[str, int]:
    """Letter -> byte of byte-level vocabularies: printable Latin-1 stands for itself,
    the other bytes take the letters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Side:
    """A tokenizer with the bytes of each id."""

    def __init__(self, pieces: list[bytes], encode):
        self.pieces, self.encode = pieces, encode
        self.sizes = np.array([len(p) for p in pieces], dtype=np.int64)

    def spells(self, ids: list[int], raw: bytes) -> bool:
        return b"".join(map(self.pieces.__getitem__, ids)) == raw


def _byte_level(path: str) -> _Side:
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    letters = _byte_letters()
    pieces = [b""] * (max(tok.get_vocab(with_added_tokens=True).values()) + 1)
    for token, i in tok.get_vocab(with_added_tokens=True).items():
        pieces[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) \
            else token.encode()
    return _Side(pieces, lambda texts: [
        e.ids for e in tok.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)])


def _sentence_pieces(path: str) -> _Side:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        pieces.append(bytes([int(piece[1:-1], 16)]) if sp.is_byte(i)
                      else piece.replace("▁", " ").encode())
    return _Side(pieces, lambda texts: sp.encode(texts, num_threads=1))


# --- units -------------------------------------------------------------------------

#: White space beyond ASCII in UTF-8, by its first byte.
_WIDE_SPACES = [c.encode() for c in "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000"] + \
    [chr(c).encode() for c in range(0x2000, 0x200B)]


def unit_starts(raw: bytes, data: np.ndarray) -> np.ndarray:
    """Places of single spaces between two characters that are neither white space nor
    control characters; `raw` starts with a space, which counts."""
    space = data == 32
    plain = data > 32  # bytes of other characters
    if any(w in raw for w in _WIDE_SPACES):
        for w in _WIDE_SPACES:
            at = raw.find(w)
            while at >= 0:
                plain[at:at + len(w)] = False
                at = raw.find(w, at + 1)
    start = np.zeros(len(data), dtype=bool)
    start[1:-1] = space[1:-1] & plain[:-2] & plain[2:]
    start[0] = True
    return np.flatnonzero(start)


def with_tails(us: np.ndarray, end: int, data: np.ndarray) -> np.ndarray:
    """Starts of units, and of the signs that end a unit of a space, letters and signs."""
    kind = classes(data)
    kind[(data >= 65) & (data <= 90)] = LETTER
    letter, sign = kind == LETTER, kind == SIGN
    ue = np.append(us[1:], end)

    def inside(flags):
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[ue] - total[us]

    back = np.zeros(len(data), dtype=bool)
    back[1:] = sign[:-1] & letter[1:]
    letters, signs = inside(letter), inside(sign)
    tail = (signs > 0) & (1 + letters + signs == ue - us) & (inside(back) == 0) & \
        letter[np.minimum(us + 1, len(data) - 1)] & (data[us] == 32)
    return np.sort(np.concatenate([us, (us + 1 + letters)[tail]]))


class _Flat:
    """Rows of variable length in one growing array."""

    def __init__(self, dtype):
        self.data = np.empty(0, dtype=dtype)
        self.start, self.size = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        self.n = self.used = 0

    def append(self, sizes: np.ndarray, data: np.ndarray) -> None:
        n, used = self.n + len(sizes), self.used + len(data)
        if n > len(self.start):
            self.start, self.size = (np.resize(x, 2 * n) for x in (self.start, self.size))
        if used > len(self.data):
            self.data = np.resize(self.data, 2 * used)
        self.start[self.n:n] = self.used + np.cumsum(sizes) - sizes
        self.size[self.n:n] = sizes
        self.data[self.used:used] = data
        self.n, self.used = n, used

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes of the rows, and their values in a row."""
        n = self.size[rows]
        total = np.cumsum(n)
        at = np.repeat(self.start[rows] - total + n, n)
        at += np.arange(len(at))
        return n, self.data[at]


class Aligner:
    """Both tokenizers, and the alignment of the units met so far."""

    def __init__(self, a_path: str, b_path: str, limit: int = KEPT_UNITS):
        self.a, self.b = _byte_level(a_path), _sentence_pieces(b_path)
        self.b_bits = len(self.b.pieces).bit_length()
        # ids with the sign that follows them in the text of groups
        self.words = [f"{i}{sign}".encode() for side, signs in ((self.a, ",|"), (self.b, ",;"))
                      for sign in signs for i in range(len(side.pieces))]
        self.tails = not any(x.isalpha() and 32 < ord(y) < 127 and not y.isalnum()
                             for p in self.b.pieces for x, y in _pairs(p))
        self.known = UnitRows(limit)
        self._clear()

    def _clear(self) -> None:
        self.links = _Flat(np.int64)
        self.figures = np.empty((4, 0), dtype=np.int64)  # wrong, n_a, n_b, n_groups
        self.groups: list[bytes] = []

    def _encoded(self, units: list[bytes]):
        """Ids of A and B for all units in a row, and the units that either gets wrong
        (these without ids)."""
        whole = b"".join(units)
        text = whole.decode()[1:]
        (ia,), (ib,) = self.a.encode([text]), self.b.encode([text])
        wrong = np.zeros(len(units), dtype=bool)
        if units and not (self.a.spells(ia, whole) and self.b.spells(ib, whole)):
            for k, u in enumerate(units):
                if u.startswith(b" "):  # the others are ASCII signs
                    t = [u.decode()[1:]]
                    wrong[k] = not (self.a.spells(self.a.encode(t)[0], u)
                                    and self.b.spells(self.b.encode(t)[0], u))
            ia, ib, _ = self._encoded([u for u, w in zip(units, wrong) if not w])
        return np.array(ia, dtype=np.int64), np.array(ib, dtype=np.int64), wrong

    def _learn(self, new: list[bytes], _at) -> np.ndarray:
        """Rows of new units: encoded as one text, signs after a word of one letter."""
        units = [p for u in new for p in ((u,) if u.startswith(b" ") else (b" a", u))]
        ia, ib, wrong = self._encoded(units)
        sizes = np.array([len(u) for u in units])
        ends = np.cumsum(sizes[~wrong])
        ends_a, ends_b = np.cumsum(self.a.sizes[ia]), np.cumsum(self.b.sizes[ib])
        in_a, in_b = np.zeros((2, int(sizes.sum()) + 1), dtype=bool)
        in_a[ends_a] = in_b[ends_b] = True
        cuts, both = np.flatnonzero(in_a | in_b), np.flatnonzero(in_a & in_b)

        def per_unit(places):
            return np.diff(np.searchsorted(places, ends, "right"), prepend=0)

        pairs = ia[np.searchsorted(ends_a, cuts)] << self.b_bits | ib[np.searchsorted(ends_b, cuts)]
        # each group's A ids, then its B ids, in one row of words
        group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        until_a, until_b = (np.searchsorted(e, both, "right") for e in (ends_a, ends_b))
        row = np.empty(len(ia) + len(ib), dtype=np.int64)
        size_a, size_b = len(self.a.pieces), len(self.b.pieces)
        row[np.arange(len(ia)) + np.concatenate([[0], until_b])[group_a]] = \
            ia + (both[group_a] == ends_a) * size_a if len(ia) else 0
        row[np.arange(len(ib)) + until_a[group_b]] = \
            ib + (both[group_b] == ends_b) * size_b + 2 * size_a if len(ib) else 0
        text = [self.words[k] for k in row.tolist()]
        right = np.flatnonzero(~wrong)
        n = np.zeros((5, len(units)), dtype=np.int64)
        n[0] = wrong
        for k, places in enumerate((ends_a, ends_b, both, cuts), 1):
            n[k, right] = per_unit(places)
        until = np.cumsum(n[1] + n[2]).tolist()
        self.groups += [b"".join(text[i:j]) for i, j in zip([0, *until[:-1]], until)]
        self.links.append(n[4], pairs)
        before = self.figures.shape[1]
        self.figures = np.concatenate([self.figures, n[:4]], axis=1)
        # the letters before signs have rows of their own that nothing refers to
        return before + np.cumsum([1 if u.startswith(b" ") else 2 for u in new]) - 1

    def align(self, ids: list, texts: list[str], first: int):
        """Figures of each text, and its postings as (pair, number of the document) keys
        in order with their numbers of links."""
        out = {c: [0] * len(texts) for c in ("n_a", "n_b", "n_groups", "n_links")}
        out |= {"doc_id": ids, "groups_sha256": [""] * len(texts)}
        full = [k for k, t in enumerate(texts) if t]
        none = np.empty(0, dtype=np.int64)
        if not full:
            return out, none, none
        # a line end keeps texts apart: the space after it starts no unit
        parts = [b" " + texts[k].encode() for k in full]
        sizes = np.array([len(p) for p in parts])
        ends = np.cumsum(sizes)
        raw = b"".join([*parts, b"\n" * PAD])
        starts = []
        for p, at in zip(parts, (ends - sizes).tolist()):
            data = np.frombuffer(p, np.uint8)
            us = unit_starts(p, data)
            starts.append((with_tails(us, len(p), data) if self.tails else us) + at)
        us = np.concatenate(starts)
        rows = self.known.find(raw, us, np.append(us[1:], ends[-1]), self._learn, self._clear)
        until = np.cumsum([len(s) for s in starts])
        begin = until - [len(s) for s in starts]
        figures = np.add.reduceat(self.figures[:, rows], begin, axis=1)
        n_links = np.add.reduceat(self.links.size[rows], begin)
        right = figures[0] == 0
        groups = [self.groups[r] for r in rows.tolist()]
        for d, k in enumerate(full):
            if right[d]:
                for c, v in zip(("n_a", "n_b", "n_groups"), figures[1:, d].tolist()):
                    out[c][k] = v
                out["n_links"][k] = int(n_links[d])
                out["groups_sha256"][k] = hashlib.sha256(
                    b"".join(groups[begin[d]:until[d]])[:-1]).hexdigest()
        counts, keys = self.links.take(rows)
        doc = np.repeat(np.array(full, dtype=np.int64) + first, until - begin)
        keys = keys << _ORD | np.repeat(doc, counts)
        if not right.all():
            keys = keys[np.repeat(np.repeat(right, until - begin), counts)]
        keys.sort()
        starts = _runs(keys)
        return out, keys[starts[:-1]], np.diff(starts)


def _pairs(piece: bytes) -> list[tuple[str, str]]:
    """Neighbouring characters of a piece of B; none of a single byte."""
    text = piece.decode(errors="replace")
    return list(zip(text, text[1:]))


_OPEN: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """The aligner of this worker process."""
    if (a_path, b_path) not in _OPEN:
        _OPEN.clear()
        _OPEN[a_path, b_path] = Aligner(a_path, b_path)
    return _OPEN[a_path, b_path]


# --- chunks ----------------------------------------------------------------------

def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start, with the end."""
    if not len(values):
        return np.zeros(1, dtype=np.int64)
    return np.concatenate([[0], np.flatnonzero(np.diff(values)) + 1, [len(values)]])


def pack_bitmaps(pairs: np.ndarray, starts: np.ndarray, numbers: np.ndarray, width: int) -> bytes:
    """Bitmaps of all pairs in a row: a pair's document numbers in 16 bits each, or
    `width` plain bits where these are shorter."""
    n = np.diff(starts)
    dense = n * 16 > width
    out, before = [], 0
    for k in np.flatnonzero(dense):
        out.append(numbers[starts[before]:starts[k]].astype("<u2").tobytes())
        bits = np.zeros(width, dtype=np.uint8)
        bits[numbers[starts[k]:starts[k + 1]]] = 1
        out.append(np.packbits(bits, bitorder="little").tobytes())
        before = k + 1
    out.append(numbers[starts[before]:].astype("<u2").tobytes())
    return b"".join(out)


def unpack_bitmaps(raw: bytes, n: np.ndarray, width: int) -> np.ndarray:
    """The document numbers of all pairs in a row."""
    dense = n * 16 > width
    size = np.where(dense, (width + 7) // 8, 2 * n)
    at = np.concatenate([[0], np.cumsum(size)])
    data = np.frombuffer(raw, np.uint8)
    out, before = [], 0
    for k in np.flatnonzero(dense):
        out.append(data[at[before]:at[k]].view("<u2"))
        out.append(np.flatnonzero(np.unpackbits(data[at[k]:at[k + 1]], count=width,
                                                bitorder="little")))
        before = k + 1
    # an odd number of plain bytes leaves the rest unaligned
    out.append(np.frombuffer(data[at[before]:].tobytes(), "<u2"))
    return np.concatenate([np.asarray(x, dtype=np.int64) for x in out])


def _planes(links: np.ndarray) -> tuple[bytes, int]:
    more = links - 1
    n = int(more.max(initial=0)).bit_length()
    return b"".join(np.packbits((more >> k & 1).astype(np.uint8), bitorder="little").tobytes()
                    for k in range(n)), n


def _from_planes(raw: bytes, n_planes: int, entries: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(n_planes, (entries + 7) // 8) \
        if n_planes else np.empty((0, 0), np.uint8)
    out = np.ones(entries, dtype=np.int64)
    for k in range(n_planes):
        out += np.unpackbits(planes[k], count=entries, bitorder="little").astype(np.int64) << k
    return out


class _Chunk:
    def __init__(self):
        self.docs = {c: [] for c in _DOC}
        self.keys, self.links, self.entries = [], [], 0

    def add(self, figures: dict, keys: np.ndarray, links: np.ndarray) -> None:
        for c in _DOC:
            self.docs[c] += figures[c]
        self.keys.append(keys)
        self.links.append(links)
        self.entries += len(keys)

    def batch(self, number: int) -> pa.RecordBatch:
        """OR-merge the groups' bitmaps (keys of different groups differ) and pack them."""
        keys = np.concatenate(self.keys)
        order = np.argsort(keys, kind="stable")
        keys, links = keys[order], np.concatenate(self.links)[order]
        pairs = keys >> _ORD
        starts = _runs(pairs)
        pairs = pairs[starts[:-1]]
        width = len(self.docs["doc_id"])
        planes, n_planes = _planes(links)
        total = np.add.reduceat(links, starts[:-1]) if len(pairs) else links
        row = {"chunk": (pa.int64(), number)} | {c: (pa.list_(t), self.docs[c])
                                                 for c, t in _DOC.items()}
        row |= {"pairs": (pa.list_(pa.int64()), pairs), "docs": (pa.list_(pa.int32()), np.diff(starts)),
                "links": (pa.list_(pa.int64()), total),
                "bits": (pa.binary(), pack_bitmaps(pairs, starts, keys & (1 << _ORD) - 1, width)),
                "planes": (pa.binary(), planes), "n_planes": (pa.int32(), n_planes)}
        return pa.RecordBatch.from_arrays([pa.array([v], t) for t, v in row.values()],
                                          names=list(row))


def _grouped(batches, chunk_docs: int):
    """Ids and texts of about GROUP_BYTES."""
    ids, texts, held = [], [], 0
    for b in batches:
        for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            ids.append(i)
            texts.append(t)
            held += len(t) + 64
            if held >= GROUP_BYTES or len(ids) == chunk_docs:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _index(a_path: str, b_path: str, chunk_docs: int, chunk_entries: int):
    def run(batches):
        tool = aligner(a_path, b_path)
        number, chunk = TaskContext.get().partitionId() << 32, _Chunk()
        for ids, texts in _grouped(batches, chunk_docs):
            held = len(chunk.docs["doc_id"])
            if held and (held + len(ids) > chunk_docs or chunk.entries >= chunk_entries):
                yield chunk.batch(number)
                number, chunk, held = number + 1, _Chunk(), 0
            chunk.add(*tool.align(ids, texts, held))
        if chunk.docs["doc_id"]:
            yield chunk.batch(number)
    return run


def pair_index(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id",
               text_col: str = "text", chunk_docs: int = CHUNK_DOCS,
               chunk_entries: int = CHUNK_ENTRIES) -> DataFrame:
    """The written chunks: documents' figures, pair bitmaps and multiplicity planes."""
    if not 0 < chunk_docs <= 1 << _ORD:
        raise ValueError("a chunk holds 1 to 65536 documents")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        whole_text(text_col).alias("text"))
    return written(plain.mapInArrow(_index(a_path, b_path, chunk_docs, chunk_entries), _CHUNK),
                   "alignment-chunks")


def _posted(index: DataFrame) -> DataFrame:
    """(chunk, pair, docs, links): popcounts of the chunks' bitmaps and planes."""
    return index.select("chunk", F.inline(F.arrays_zip("pairs", "docs", "links"))) \
        .withColumnRenamed("pairs", "pair")


def _b_bits(b_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size().bit_length()


def pair_counts(index: DataFrame, b_path: str) -> DataFrame:
    """a_id, b_id, docs, links of every linked pair of the corpus."""
    bits = _b_bits(b_path)
    return _posted(index).groupBy("pair").agg(F.sum("docs").alias("docs"),
                                              F.sum("links").alias("links")) \
        .select(F.shiftright("pair", bits).alias("a_id"),
                F.col("pair").bitwiseAND((1 << bits) - 1).alias("b_id"), "docs", "links")


def _score(chunks: pa.Table, returned: pa.Table) -> pa.Table:
    """Counts that came back to a chunk, spread over its postings."""
    c = chunks.to_pylist()[0]
    width = len(c["doc_id"])
    pairs, n = np.array(c["pairs"], dtype=np.int64), np.array(c["docs"], dtype=np.int64)
    at = np.searchsorted(pairs, returned.column("pair").to_numpy())
    count, best = np.zeros(len(pairs), dtype=np.int64), np.zeros(len(pairs), dtype=bool)
    count[at] = returned.column("count").to_numpy()
    best[at] = returned.column("best").to_numpy(zero_copy_only=False)
    numbers = unpack_bitmaps(c["bits"], n, width)
    links = _from_planes(c["planes"], c["n_planes"], len(numbers))
    sums, bests = np.zeros(width, dtype=np.int64), np.zeros(width, dtype=np.int64)
    np.add.at(sums, numbers, links * np.repeat(count, n))
    np.add.at(bests, numbers, links * np.repeat(best, n))
    return pa.table({**{k: pa.array(c[k], t) for k, t in _DOC.items()},
                     "n_best": pa.array(bests), "count_sum": pa.array(sums)}) \
        .select([x.split()[0] for x in _SCORED.split(", ")])


def scores(index: DataFrame, b_path: str) -> DataFrame:
    """Figures of every document, with the sum of its links' counts and the number of
    links whose count is the highest of their A id."""
    a_id = F.shiftright("pair", _b_bits(b_path))
    # a pair has one row per chunk, so its window is as long as the chunks are many
    counted = written(_posted(index).select(
        "chunk", "pair", F.sum("docs").over(Window.partitionBy("pair")).alias("count")),
        "alignment-counts")
    # one row per id of vocabulary A
    top = counted.groupBy(a_id.alias("a_id")).agg(F.max("count").alias("top"))
    back = counted.withColumn("a_id", a_id).join(F.broadcast(top), "a_id") \
        .select("chunk", "pair", "count", (F.col("count") == F.col("top")).alias("best"))
    return index.drop("links").groupBy("chunk").cogroup(back.groupBy("chunk")) \
        .applyInArrow(_score, _SCORED)


def align(docs: DataFrame, a_path: str, b_path: str, **options) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256."""
    return scores(pair_index(docs, a_path, b_path, **options), b_path)


@query("op11_token_alignment")
def op11_token_alignment(spark, sf_dir):
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                 public_tokenizers.path("piece_bpe_32k.model"))
