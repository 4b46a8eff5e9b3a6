"""Packing, token files, byte-level BPE: against the libraries, and round trips."""

import base64
import zlib

import numpy as np
import public_tokenizers as public
import pytest

from tests.llm.conftest import cases
from threatframe.llm import byte_bpe, packing, token_files
from threatframe.session import scratch_path

WORD = public.path("word_bpe_49k.json")
BYTES = public.path("byte_bpe_multi_50k.tiktoken")


def wanted() -> list[tuple]:
    """(doc_id, ids with the end id) by the tokenizers library."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    return [(i, np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4"))
            for i, x in cases()]


def key(x):
    return (x[0] is not None, x[0] or 0, *x[1:])


def test_packing_pieces_rebuild_every_document(spark, edge):
    rows = packing.pack(edge, WORD, window=512).collect()
    row: dict[int, bytes] = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length and r.offset + r.length <= 512
        assert r.sequence_id * 512 + r.offset not in row
        row[r.sequence_id * 512 + r.offset] = bytes(r.ids)
    at = 0
    for place in sorted(row):  # the pieces tile the whole row of ids
        assert place == at
        at += len(row[place]) // 4
    want = sorted(((i, x.tobytes()) for i, x in wanted()), key=key)
    docs: dict[tuple, bytes] = {}
    for r in sorted(rows, key=lambda r: r.sequence_id * 512 + r.offset):
        first = r.sequence_id * 512 + r.offset - r.start
        docs[r.doc_id, first] = docs.get((r.doc_id, first), b"") + bytes(r.ids)
    assert sorted(((i, x) for (i, _), x in docs.items()), key=key) == want


def test_packing_of_an_empty_table(empty):
    assert packing.pack(empty, WORD).count() == 0


def test_token_files_keep_order_and_ids(spark, edge):
    path = scratch_path(spark, "test-tokens")
    token_files.write_tokens(edge, path, WORD)
    back = token_files.read_tokens(spark, path)
    got = sorted(((r.doc_id, np.array(r.ids, "<u4").tobytes()) for r in back.collect()), key=key)
    assert got == sorted(((i, x.tobytes()) for i, x in wanted()), key=key)
    sums = sorted(token_files.token_digests(back).collect(), key=lambda r: r.start)
    assert [r.start for r in sums] == [sum(x.n_tokens for x in sums[:k]) for k in range(len(sums))]
    assert sorted(r.ids_crc32 for r in sums) == sorted(zlib.crc32(x) for _, x in wanted())
    ids = [r.doc_id for r in sums]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert back.filter("doc_id = 18").count() == 1


def test_token_files_of_an_empty_table(spark, empty):
    path = scratch_path(spark, "test-tokens")
    token_files.write_tokens(empty, path, WORD)
    assert token_files.token_digests(token_files.read_tokens(spark, path)).count() == 0


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(BYTES, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})


def test_byte_bpe_equals_the_library(edge, reference):
    coded = byte_bpe.encode(edge, BYTES, public.PATTERN)
    rows = byte_bpe.decode(coded, BYTES, public.PATTERN).collect()
    want = sorted(((i, reference.encode_ordinary(t or "")) for i, t in cases()), key=key)
    assert sorted(((r.doc_id, r.ids) for r in rows), key=key) == want
    assert sorted(bytes(r.decoded) for r in rows) == sorted((t or "").encode() for _, t in cases())


def test_byte_bpe_long_pieces_and_signs(reference):
    import random

    r = random.Random(2)
    signs = ["a", "the", "'s", "'RE", "  ", "\n", "\x1c", "\x85", "\xa0", "é", "é", "²", "日",
             "😀", "_", "12", "٣", "​", "İ", "ß"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 15))) for _ in range(3000)]
    texts += ["a" * 5000, "abc" * 700, " " * 3000 + "x", "ab" * 513 + "c",
              "".join(r.choice("abcdethin") for _ in range(4000))]
    got = byte_bpe.ByteBpe(BYTES, public.PATTERN).encode([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == \
        [reference.encode_ordinary(t) for t in texts]


def test_byte_bpe_of_an_empty_table(empty):
    assert byte_bpe.encode(empty, BYTES, public.PATTERN).count() == 0


def test_word_ids_equal_the_library():
    import random

    from threatframe.llm.wordids import WordIds

    w = WordIds(WORD, limit=50)  # small stores: generations change often
    r = random.Random(1)
    parts = ["a", "B", "K", "'s", ".", ",", "!!", " ", "\n", "\xa0", " ", "\x1c", "\x85",
             "̇", "́", "İ", "Σ", "ẞ", "é", "É", "1", "<|endoftext|>", "<|ENDOFTEXT|>",
             "日本", "한", "😀", "_", "\x00"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(5000)]
    want = w.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in w.encode([t.encode() for t in texts])] == \
        [e.ids for e in want]
