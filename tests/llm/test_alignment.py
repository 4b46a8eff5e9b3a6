"""Token alignment against brute force over byte ranges."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as public
import pytest

from tests.conftest import SF_SMALL
from tests.llm.conftest import cases
from threatframe.llm import token_alignment as ta
from threatframe.llm.queries import QUERIES

A, B = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    return tok, sentencepiece.SentencePieceProcessor(model_file=B)


def letters():
    keep = list(range(ord("!"), ord("~") + 1)) + list(range(ord("¡"), ord("¬") + 1)) \
        + list(range(ord("®"), ord("ÿ") + 1))
    out, n = {}, 0
    for b in range(256):
        out[chr(b) if b in keep else chr(256 + n)] = b
        n += b not in keep
    return out


def brute(tools, rows):
    """Sorted result rows of [(doc_id, text)], and the counts of pairs."""
    tok, sp = tools
    table = letters()

    def spans(parts):
        out, at = [], 0
        for i, raw in parts:
            out.append((i, at, at + len(raw)))
            at += len(raw)
        return out

    docs = []
    for doc_id, text in rows:
        links, groups, n_a, n_b = [], [], 0, 0
        if text:
            want = (" " + text).encode()
            a = [(i, bytes(table[c] for c in tok.id_to_token(i)))
                 for i in tok.encode(" " + text, add_special_tokens=False).ids]
            b = []
            for i in sp.encode(text):
                p = sp.id_to_piece(i)
                b.append((i, bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6
                          else p.replace("▁", " ").encode()))
            if b"".join(r for _, r in a) == want == b"".join(r for _, r in b):
                a, b = spans(a), spans(b)
                n_a, n_b = len(a), len(b)
                j = 0
                for i, lo, hi in a:
                    while b[j][2] <= lo:
                        j += 1
                    k = j
                    while k < len(b) and b[k][1] < hi:
                        links.append((i, b[k][0]))
                        k += 1
                both = sorted({e for _, _, e in a} & {e for _, _, e in b})
                ga, gb = iter(a), iter(b)
                for e in both:
                    left, right = [], []
                    for i, _, hi in ga:
                        left.append(str(i))
                        if hi == e:
                            break
                    for i, _, hi in gb:
                        right.append(str(i))
                        if hi == e:
                            break
                    groups.append(",".join(left) + "|" + ",".join(right))
        docs.append((doc_id, n_a, n_b, groups, links))
    count = Counter(p for *_, links in docs for p in set(links))
    top = defaultdict(int)
    for (i, _), n in count.items():
        top[i] = max(top[i], n)
    out = [(d, na, nb, len(g), len(x), sum(count[p] == top[p[0]] for p in x),
            sum(count[p] for p in x),
            hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
           for d, na, nb, g, x in docs]
    return sorted(out, key=str), count, Counter(p for *_, links in docs for p in links)


@pytest.mark.parametrize("docs,entries", [(ta.CHUNK_DOCS, ta.CHUNK_ENTRIES), (4, 10)])
def test_hard_cases(spark, edge, tools, docs, entries):
    extra = [(30, "A b ▁ ﬁ \u0001\t\n  x"), (31, "<0x41> <s> </s> <unk>"), (32, " "),
             (33, "日本語テキスト 😀😀 the the the"), (34, "the the the"), (35, "  the\u0000 the")]
    df = edge.unionByName(spark.createDataFrame(extra, "doc_id long, text string"),
                          allowMissingColumns=True)
    index = ta.pair_index(df, A, B, chunk_docs=docs, chunk_entries=entries)
    got = sorted((tuple(r) for r in ta.scores(index, B).collect()), key=str)
    want, count, links = brute(tools, [*cases(), *extra])
    assert got == want
    assert sum(r[1] > 0 for r in want) > 12
    counts = ta.pair_counts(index, B).collect()
    assert {(r.a_id, r.b_id): r.docs for r in counts} == count
    assert {(r.a_id, r.b_id): r.links for r in counts} == links


def test_bitmaps_and_planes_round_trip():
    r = np.random.default_rng(1)
    for width in (1, 7, 300, 32768):
        sets = [np.sort(r.choice(width, r.integers(1, width + 1), replace=False)) for _ in range(20)]
        sets += [np.array([width - 1]), np.arange(width)]
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        raw = ta.pack_bitmaps(np.arange(len(sets)), starts, np.concatenate(sets), width)
        assert (ta.unpack_bitmaps(raw, np.diff(starts), width) == np.concatenate(sets)).all()
    for top in (1, 2, 9, 100_000):
        links = r.integers(1, top + 1, 1003)
        assert (ta._from_planes(*ta._planes(links), 1003) == links).all()


def test_empty_table(empty):
    assert ta.align(empty, A, B).count() == 0


def test_query(spark, tools):
    got = QUERIES["op11_token_alignment"][0](spark, SF_SMALL)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links",
                                                  "n_best", "count_sum")] \
        + [("groups_sha256", "string")]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(tools, docs)[0]
