"""Licence scan by a positional rare-token index (operator 8).

A template is a notice with a mandatory key phrase.  Document frequencies of all
template words are counted over the whole corpus; for every template the index
keeps the RARE words of its key phrase with the highest IDF and their positions.
A document's words are looked up in the index: each hit votes for (template,
start = place of the word - position in the key phrase).  Where all indexed words
of a template vote for one start, the key phrase is compared with the words
there, and a verified place scores the IDF share of the notice's words that
stand at their relative positions.  The index is rare-first only to be short: a
place of a key phrase has all its words, so no place is missed.

Base phrases are templates without more words than their key.  Null text counts
as empty: no words, no labels ('' and ''), score 0, null first and last word.
Equal rows give equal results.  Texts of any length are scanned whole inside
their row; nothing is shuffled but the word counts.  In an empty corpus, or for
words no document has, every IDF is log(1 + N) alike.  Only the id and text
columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from threatframe.llm.common import query, table, whole_text

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RARE = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Base phrase -> label.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

_GNU = "this work is licensed under the gnu general public license"
#: (label, notice, key phrase in it).
NOTICES = [
    ("gpl", _GNU, "gnu general public license"),
    ("gpl-2.0", f"{_GNU} version 2", "gnu general public license version 2"),
    ("gpl-3.0", f"{_GNU} version 3", "gnu general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license",
     "gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license",
     "gnu affero general public license"),
    ("apache", "licensed under the apache license", "apache license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("cc-by", "licensed under cc by", "cc by"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
            "software", "permission is hereby granted free of charge"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are "
            "permitted", "redistribution and use in source and binary forms"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license "
                "v 2 0", "mozilla public license"),
]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def _templates(base: dict[str, str], notices: list[tuple[str, str, str]]) -> list[dict]:
    out = [{"label": label, "words": p.split(), "key": p.split(), "at": 0, "base": True}
           for p, label in base.items()]
    for label, notice, key in notices:
        w, k = notice.split(), key.split()
        at = next(i for i in range(len(w)) if w[i:i + len(k)] == k)
        out.append({"label": label, "words": w, "key": k, "at": at, "base": False})
    return out


def word_idf(texts: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """log((1 + N) / (1 + df)) of each template word over all documents."""
    known = F.array(*[F.lit(w) for w in vocabulary])
    seen = texts.select(F.array_intersect(words_of(F.col("text")), known).alias("w"))
    # one row per template word, and one for the number of documents
    rows = seen.select(F.explode(F.array_append("w", F.lit(""))).alias("w")) \
        .groupBy("w").count().collect()
    df = {r["w"]: r["count"] for r in rows}
    n = df.get("", 0)
    return {w: math.log((1 + n) / (1 + df.get(w, 0))) for w in vocabulary}


def scan(docs: DataFrame, base: dict[str, str] = BASE,
         notices: list[tuple[str, str, str]] = NOTICES, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """doc_id, n_words, found: array of (template, label, base, start, length, score) of
    every verified place, in word positions from 0."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        whole_text(text_col).alias("text"))
    templates = _templates(base, notices)
    idf = word_idf(texts, sorted({w for t in templates for w in t["words"]}))

    index, table_ = [], []
    for k, t in enumerate(templates):
        places = {}
        for i, w in enumerate(t["key"]):
            places.setdefault(w, i)
        rare = sorted(places, key=lambda w: (-idf[w], w))[:RARE]
        index += [(w, k, places[w]) for w in rare]
        total = sum(idf[w] for w in t["words"])
        share = [idf[w] / total if total else 1 / len(t["words"]) for w in t["words"]]
        table_.append(F.struct(
            F.lit(k).alias("template"), F.lit(t["label"]).alias("label"),
            F.lit(t["base"]).alias("base"), F.lit(len(rare)).alias("votes"),
            F.lit(t["at"]).alias("at"),
            F.array(*[F.lit(w) for w in t["key"]]).alias("key"),
            F.array(*[F.lit(w) for w in t["words"]]).alias("words"),
            F.array(*[F.lit(float(s)) for s in share]).alias("share")))
    postings = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(k).alias("template"),
                                  F.lit(i).alias("at")) for w, k, i in index])
    rare_words = F.array(*[F.lit(w) for w in sorted({w for w, _, _ in index})])

    rows = texts.select("doc_id", words_of(F.col("text")).alias("words"))
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    # hits: (word, place) of the document's indexed words
    hits = F.filter(F.transform("words", lambda w, i: F.when(
        F.array_contains(rare_words, w), F.struct(w.alias("word"), i.alias("place")))),
        lambda h: h.isNotNull())
    rows = rows.withColumn("hits", F.when(F.arrays_overlap("words", rare_words), hits))
    votes = F.flatten(F.transform("hits", lambda h: F.transform(
        F.filter(postings, lambda p: p["word"] == h["word"]),
        lambda p: F.struct(p["template"].alias("template"),
                           (h["place"] - p["at"]).alias("start")))))
    rows = rows.withColumn("votes", votes)
    # places that all indexed words of a template vote for; each word votes once
    # for a start, so equal votes are as many as the words that agree
    ordered = F.array_sort("votes")
    rows = rows.withColumn("votes", ordered)
    known = F.array(*table_)

    def candidates(t):
        return F.filter("votes", lambda v: v["template"] == t["template"])

    def agreed(v, i, t):
        # sorted: the vote is the last of a run of t.votes equal votes
        run = t["votes"] - 1
        return (F.get(v, i - run) == F.get(v, i)) & \
            (F.get(v, i + 1).isNull() | (F.get(v, i + 1) != F.get(v, i)))

    def starts(t):
        own = F.transform(candidates(t), lambda v: v["start"])
        ends = F.filter(F.transform(own, lambda s, i: F.when(agreed(own, i, t), s)),
                        lambda s: s.isNotNull())
        return F.filter(ends, lambda s: (s >= 0) & (
            F.slice(F.col("words"), F.greatest(s, F.lit(0)) + 1, F.size(t["key"])) == t["key"]))

    def found(t):
        return F.transform(starts(t), lambda s: F.struct(
            t["template"].alias("template"), t["label"].alias("label"), t["base"].alias("base"),
            s.alias("start"), F.size(t["key"]).alias("length"),
            F.aggregate(
                F.transform(t["words"], lambda w, i: F.when(
                    F.get(F.col("words"), s - t["at"] + i) == w, F.get(t["share"], i))
                    .otherwise(0.0)),
                F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))).alias("score")))

    empty = F.filter(F.flatten(F.transform(known, lambda t: F.transform(
        F.array(t["template"]), lambda x: F.struct(
            t["template"].alias("template"), t["label"].alias("label"), t["base"].alias("base"),
            F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit(0.0).alias("score"))))),
        lambda x: F.lit(False))
    return rows.select("doc_id", "n_words", F.when(
        F.size(F.coalesce("votes", F.array().cast("array<struct<template:int,start:int>>"))) > 0,
        F.flatten(F.transform(known, found))).otherwise(empty).alias("found"))


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


@query("op8_license_scan")
def op8_license_scan(spark, sf_dir):
    seen = scan(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda x: x["base"])
    return (seen.withColumn("base_found", base)
            .select("doc_id", "n_words", F.size("base_found").cast("long").alias("n_base"),
                    F.array_min(F.transform("base_found", lambda x: x["start"])).cast("long")
                    .alias("first_word"),
                    F.array_max(F.transform("base_found", lambda x: x["start"])).cast("long")
                    .alias("last_word"),
                    _joined(F.transform("base_found", lambda x: x["label"])).alias("base_labels"),
                    _joined(F.transform("found", lambda x: x["label"])).alias("labels"),
                    F.round(F.coalesce(F.array_max(F.transform(
                        F.filter("found", lambda x: ~x["base"]),
                        lambda x: F.least(x["score"], F.lit(1.0)))), F.lit(0.0)), 6)
                    .alias("score")))
