"""The corpus pipeline: language ID, quality, near duplicates, packing.

Each stage takes the documents its predecessor kept and decides over all of
them; `run` writes every stage's result as Parquet in the shared folder and reads
it back.  All stages but the last return the columns of `documents`; the last
returns the packed pieces.  Nulls: a null text is `und` and goes in the first
stage, a null doc_id stays alone in the third.  Rows that repeat a doc_id and its
text count as one document there; different texts of one doc_id are documents of
their own.  Further columns are dropped.  An empty table passes through as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from threatframe.llm import language_id, packing, quality, shingle_join
from threatframe.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: A document goes when its words give its best language less than this
#: mean probability.
LEAST_LANGUAGE_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a language: not `und`, and a sure enough score."""
    docs = docs.select(*COLUMNS)
    model = language_id.fit(docs, language_id.learnable())
    return language_id.identify(docs, model).filter(
        (F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the classifier predicts as label 1."""
    docs = docs.select(*COLUMNS)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.assess(docs, model).filter(F.col("score") >= quality.THRESHOLD) \
        .select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the text with the smallest doc_id of each group of near duplicates:
    five-word shingles, Jaccard similarity of 0.8 or more.  Rows are told apart by
    doc_id and text, so different texts of one doc_id are decided one by one."""
    docs = docs.select(*COLUMNS)
    words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^ \t\n\x0B\f\r]")
    row = F.min(F.struct(*COLUMNS)).alias("row")
    # repeats go first, by partial aggregation: no id or text fills one task
    signed = shingle_join.with_signature(docs.filter(words & F.col("doc_id").isNotNull())) \
        .groupBy("doc_id", "sig").agg(row)
    worded = signed.join(shingle_join.representatives(docs), ["doc_id", "sig"], "left_semi")
    blank = docs.filter(~words & F.col("doc_id").isNotNull()).groupBy("doc_id", "text").agg(row)
    return worded.select("row.*").unionByName(blank.select("row.*")) \
        .unionByName(docs.filter(F.col("doc_id").isNull()))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all that is left into sequences of token ids."""
    import public_tokenizers

    return packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned stages and connected components: no SQL; tests compare with brute force.
ORACLE_SQL = None
