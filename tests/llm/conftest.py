"""Small tables with the hard cases: nulls, empty and long texts, repeats, clashing columns."""

import random

import pytest

WORDS = ("the of and to in is that it was for on are with as his they be at one have this from "
         "river stone light winter garden letter engine signal harbour market window copper").split()
LONG = " ".join(random.Random(5).choices(WORDS, k=20_000))


def prose(seed: int, n: int = 60) -> str:
    r = random.Random(seed)
    return ". ".join(" ".join(r.choices(WORDS, k=10)).capitalize() for _ in range(max(1, n // 10)))


def cases() -> list[tuple]:
    """(doc_id, text): prose, a near and an exact copy, null, empty, blank, signs, long, repeats."""
    base = prose(1, 400)
    return [
        (10, base), (11, base), (12, base.replace("stone", "pebble", 1)), (13, prose(2)),
        (14, None), (15, ""), (16, " \t\n "), (17, "!!! 123 ***"), (18, LONG), (19, "one"),
        (20, "Één café für São — 日本 😀"), (13, prose(2)), (None, prose(3)),
        (21, "This work is licensed under the GNU General Public License, version 3."),
        (22, "a\n\nb\n\n\nc\r\n d"), (23, "x" * 3000), (24, "<|endoftext|> It's <|ENDOFTEXT|>"),
    ]


@pytest.fixture(scope="session")
def edge(spark):
    """The cases with the columns of documents and columns of clashing names."""
    rows = [(i, t, "en" if k % 2 else None, None, len(t) if t else 0, 1.0, "s", 7, -1, "x")
            for k, (i, t) in enumerate(cases())]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, score double, "
              "shard string, ids long, component_id long, fingerprint string")


@pytest.fixture(scope="session")
def empty(edge):
    return edge.filter("doc_id < 0")
