"""Word-first language identification with n-gram backoff (operator 7).

Model: log frequencies per language of the WORDS most frequent words and of the
GRAMS most frequent character n-grams (4 to 1 letters, with word ends marked) of a
bounded sample: SAMPLE documents per language, the first in hash order among the
labelled rows that are not held out.  A known word scores its per-language log
frequency, normalised over languages; an unseen word is cut from the left into the
longest known n-grams, four letters first, then three, two and one, and scores
their mean.  The prediction is the language with the greatest sum over all words
of the whole text (ties: first by name); the score is the mean probability that
the words give this language.

Texts that are null or have no letter are `und` with score 0, as is every text
when no language was learned.  A null doc_id is never learned from.  Rows equal in
doc_id and text are learned from once and get equal results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from threatframe.llm.common import query, table, whole_text, with_text_scores
from threatframe.session import cut_lineage

SAMPLE = 3000
WORDS = 40_000
GRAMS = 40_000
MAX_N = 4
FLOOR = -8.0
_KEEP = 250_000
_GROUP_CHARS = 1_000_000
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class LanguageModel:
    languages: list[str]
    words: dict[str, np.ndarray]
    grams: dict[str, np.ndarray]

    def logs(self, words: list[str]) -> np.ndarray:
        """Log probability of each language given each word, a row per word."""
        size = len(self.languages)
        out = np.full((len(words), size), -np.log(max(1, size)))
        known = [k for k, w in enumerate(words) if w in self.words]
        if known:
            out[known] = [self.words[words[k]] for k in known]
        grams = self.grams
        parts, ends, rest = [], [], []
        for k, w in enumerate(words):
            if w in self.words:
                continue
            marked, i, before = f"<{w}>", 0, len(parts)
            while i < len(marked):
                for n in range(MAX_N, 0, -1):
                    found = grams.get(marked[i:i + n])
                    if found is not None:
                        parts.append(found)
                        break
                i += n
            if len(parts) > before:
                rest.append(k)
                ends.append(len(parts))
        if rest:
            ends = np.array(ends)
            starts = np.concatenate([[0], ends[:-1]])
            sums = np.add.reduceat(np.array(parts), starts, axis=0)
            out[rest] = _normal(sums / (ends - starts)[:, None])
        return out

    def scorer(self):
        """A function from texts to ([language], [score])."""
        size = len(self.languages)
        rows: dict[str, int] = {}
        store = np.zeros((0, size))
        chances = np.zeros((0, size))

        def group(texts):
            nonlocal store, chances
            lists = [_LETTERS.findall(t.lower()) if t and size else [] for t in texts]
            new = set().union(*lists).difference(rows)
            if len(rows) + len(new) > _KEEP:
                rows.clear()
                store, chances = store[:0], chances[:0]
                new = set().union(*lists)
            if new:
                words = list(new)
                rows.update(zip(words, range(len(store), len(store) + len(words))))
                logs = self.logs(words)
                store = np.concatenate([store, logs])
                chances = np.concatenate([chances, np.exp(logs)])
            for words in lists:
                if not any(map(str.isalpha, words)):
                    yield "und", 0.0
                    continue
                at = np.fromiter(map(rows.__getitem__, words), np.int64, len(words))
                best = int(store[at].sum(axis=0).argmax())
                yield self.languages[best], float(min(1.0, chances[at, best].mean()))

        def score(texts):
            found, some, held = [], [], 0
            for t in texts:
                some.append(t)
                held += len(t or "")
                if held >= _GROUP_CHARS:
                    found += group(some)
                    some, held = [], 0
            found += group(some)
            return [x for x, _ in found], [y for _, y in found]

        return score


def _normal(logs: np.ndarray) -> np.ndarray:
    """Log probabilities along the last axis, none under FLOOR by much."""
    def scaled(x):
        top = x.max(axis=-1, keepdims=True)
        return x - (top + np.log(np.exp(x - top).sum(axis=-1, keepdims=True)))

    return scaled(np.maximum(scaled(logs), FLOOR))


def _top(counts: DataFrame, item: str, k: int) -> dict[str, dict[str, int]]:
    """Counts per language of the k most frequent items (k x languages numbers)."""
    per = counts.groupBy(item).agg(F.sum("n").alias("n"), F.map_from_entries(
        F.collect_list(F.struct("lang", "n"))).alias("by"))
    rows = per.orderBy(F.desc("n"), item).limit(k).select(item, "by").collect()
    return {r[item]: r["by"] for r in rows}


def _logs(items: dict[str, dict[str, int]], totals: dict[str, int], languages) -> dict:
    size = max(1, len(items))
    return {x: _normal(np.array([np.log((by.get(lang, 0) + 0.05) / (totals.get(lang, 0) + size))
                                 for lang in languages])) for x, by in items.items()}


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang", sample: int = SAMPLE) -> LanguageModel:
    """Learn from a bounded sample of the rows of `docs` for which `learn` holds."""
    rows = docs.filter(learn & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull()
                       & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"),
                       F.lower(whole_text(text_col)).alias("text"),
                       F.xxhash64(id_col, text_col).alias("h"))
    # a bound on the hash leaves about 2 * sample rows per language to rank
    share = rows.groupBy("lang").agg((F.lit(2.0 * sample) / F.count(F.lit(1))).alias("share"))
    drawn = rows.join(share, "lang").filter(F.pmod("h", F.lit(1 << 31)) < F.col("share") * (1 << 31)) \
        .groupBy("lang", "doc_id", "h").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    texts = drawn.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= sample)
    words = cut_lineage(texts.select("lang", F.explode(F.regexp_extract_all(
        "text", F.lit(r"\p{L}+"), F.lit(0))).alias("word")) \
        .groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")))
    marked = F.concat(F.lit("<"), "word", F.lit(">"))
    grams = words.select("lang", "n", F.explode(F.flatten(F.array(*[
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(marked) - (k - 1), F.lit(1))),
                    lambda i, k=k: F.substring(marked, i, F.lit(k)))
        for k in range(1, MAX_N + 1)]))).alias("gram")) \
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    return LanguageModel(languages, _logs(_top(words, "word", WORDS), totals, languages),
                         _logs(_top(grams, "gram", GRAMS), totals, languages))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Add `lang_pred` and `score` to all columns of `docs`."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # WORDS + GRAMS rows at most
    return with_text_scores(docs, text_col, "lang_pred string, score double",
                            lambda: held.value.scorer())


def learnable(id_col: str = "doc_id") -> Column:
    """Rows to learn from: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1


@query("op7_language_id")
def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, learnable())
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(~learnable(), F.lit(False)).alias("held_out"), "lang_pred", "score")
