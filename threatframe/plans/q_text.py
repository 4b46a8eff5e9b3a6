"""Registered text queries over `documents`: vocabulary (L3) and TF-IDF
(M6/M7, A11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatframe.functions.scalars import hash_fraction_sql
from threatframe.functions.stopwords import german_english, sql_list
from threatframe.operators import text
from threatframe.plans.q_events import _SQL_MATCHED
from threatframe.plans.registry import load_even, register

VOCAB = 500


def _sql_terms() -> str:
    """DuckDB form of `text.tokens`: tokens by position, stop words removed,
    positions renumbered, bigrams from adjacent positions."""
    return f"""
WITH stop AS (SELECT unnest([{sql_list(german_english())}]) AS w),
tok AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos
        FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')),
                                                '[\\p{{L}}\\p{{N}}_]{{2,}}') AS t
              FROM documents)),
kept AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS p
         FROM tok WHERE term NOT IN (SELECT w FROM stop)),
terms AS (SELECT doc_id, term FROM kept
          UNION ALL
          SELECT a.doc_id, a.term || ' ' || b.term FROM kept a
          JOIN kept b ON b.doc_id = a.doc_id AND b.p = a.p + 1),
tc AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term),
stats AS (SELECT term, sum(tf) AS cf, count(*) AS df FROM tc GROUP BY term),
vocab AS (SELECT term, cf, df, row_number() OVER (ORDER BY cf DESC, term) AS rank
          FROM stats ORDER BY cf DESC, term LIMIT {VOCAB})"""


@register("q_topk", sql=_sql_terms() + """
SELECT term, CAST(cf AS BIGINT) AS cf, df, rank FROM vocab""")
def q_topk(spark, sf_dir):
    """L3 + A11: the 500 most frequent uni/bigrams after stop words, with
    corpus and document frequency."""
    docs = load_even(spark, sf_dir, "documents")
    v = text.vocabulary(text.term_stats(docs, "text"), VOCAB)
    return v.select("term", F.col("cf").cast("long").alias("cf"), "df", "rank")


@register("q_tfidf", sql=_sql_terms() + """,
n AS (SELECT count(*) AS n FROM documents),
w AS (SELECT tc.doc_id, tc.term, tc.tf * (ln((1 + n.n) / (1 + v.df)) + 1) AS w
      FROM tc JOIN vocab v USING (term) CROSS JOIN n),
nrm AS (SELECT doc_id, sqrt(sum(w * w)) AS z FROM w GROUP BY doc_id)
SELECT w.doc_id, w.term, round(w.w / nrm.z, 6) AS weight FROM w JOIN nrm USING (doc_id)""")
def q_tfidf(spark, sf_dir):
    """M6: smoothed TF-IDF over the 500-term vocabulary, L2 per document."""
    docs = load_even(spark, sf_dir, "documents")
    out = text.tfidf_long(docs, "doc_id", "text", VOCAB)
    return out.select("doc_id", "term", F.round("weight", 6).alias("weight"))


@register("q_feature_matrix", sql=_SQL_MATCHED + _sql_terms().replace("WITH stop", ",stop", 1) + """,
n AS (SELECT count(*) AS n FROM documents),
w AS (SELECT tc.doc_id, tc.term, tc.tf * (ln((1 + n.n) / (1 + v.df)) + 1) AS w
      FROM tc JOIN vocab v USING (term) CROSS JOIN n),
nrm AS (SELECT doc_id, sqrt(sum(w * w)) AS z, sum(w) AS s, count(*) AS nnz FROM w GROUP BY doc_id),
prof AS (SELECT alert_id, count(*) AS n_events, max(value) AS top FROM matched GROUP BY alert_id)
SELECT d.doc_id, CAST(d.n_chars AS DOUBLE) AS n_chars,
       CAST(coalesce(p.n_events, 0) AS DOUBLE) AS n_events,
       round(coalesce(p.top, 0), 4) AS max_severity, coalesce(nrm.nnz, 0) AS text_nnz,
       round(coalesce(nrm.s / nrm.z, 0), 4) AS text_sum
FROM documents d LEFT JOIN prof p ON p.alert_id = d.doc_id LEFT JOIN nrm ON nrm.doc_id = d.doc_id""")
def q_feature_matrix(spark, sf_dir):
    """P15 + P16 + M7: numeric column, event profile and sparse text weights of each
    document in one vector, read back from it."""
    from pyspark.ml.functions import vector_to_array

    v = document_matrix(spark, sf_dir).select("doc_id", vector_to_array("features").alias("v"))
    words = F.slice("v", 4, VOCAB)
    return v.select("doc_id", F.col("v")[0].alias("n_chars"), F.col("v")[1].alias("n_events"),
                    F.round(F.col("v")[2], 4).alias("max_severity"),
                    F.size(F.filter(words, lambda w: w > 0)).cast("long").alias("text_nnz"),
                    F.round(F.aggregate(words, F.lit(0.0), lambda a, w: a + w), 4)
                    .alias("text_sum"))


def document_matrix(spark, sf_dir):
    """Documents with `features`: length, event profile and text weights, all named."""
    from threatframe.operators import agg
    from threatframe.plans import roles
    from threatframe.plans.features import feature_matrix, fit_vocabulary
    from threatframe.plans.q_events import matched_events

    docs = load_even(spark, sf_dir, "documents").select("doc_id", "text",
                                                        F.col("n_chars").cast("double"))
    profile = agg.event_profile(matched_events(spark, sf_dir), "alert_id", "event_type",
                                roles.EVENT_TYPES, "value").withColumnRenamed("alert_id", "doc_id")
    vocab, n = fit_vocabulary(docs, "doc_id", "text", VOCAB)
    return feature_matrix(docs, profile, "doc_id", ["n_chars"], ["n_events", "max_severity"],
                          "text", vocab, n)


@register("q_feature_names", sql=_sql_terms() + """
SELECT CAST(idx AS INTEGER) AS idx, name FROM (
  SELECT 0 AS idx, 'n_chars' AS name UNION ALL SELECT 1, 'n_events' UNION ALL SELECT 2, 'max_severity'
  UNION ALL SELECT rank + 2, 'text_features_' || term FROM vocab)""")
def q_feature_names(spark, sf_dir):
    """P15 + M14: the tracked names of the assembled matrix."""
    from threatframe.operators.model import entry_names

    return entry_names(document_matrix(spark, sf_dir))


_APPLIED_SQL = _sql_terms().replace(
    "stats AS (SELECT term, sum(tf) AS cf, count(*) AS df FROM tc GROUP BY term)",
    "train AS (SELECT doc_id FROM documents WHERE " + hash_fraction_sql(42, "doc_id") + " >= 0.2),\n"
    "stats AS (SELECT term, sum(tf) AS cf, count(*) AS df FROM tc "
    "WHERE doc_id IN (SELECT doc_id FROM train) GROUP BY term)") + """,
n AS (SELECT count(*) AS n FROM train),
test AS (SELECT * FROM tc WHERE doc_id NOT IN (SELECT doc_id FROM train)),
w AS (SELECT t.doc_id, t.term, t.tf * (ln((1 + n.n) / (1 + v.df)) + 1) AS w
      FROM test t JOIN vocab v USING (term) CROSS JOIN n),
nrm AS (SELECT doc_id, sqrt(sum(w * w)) AS z FROM w GROUP BY doc_id)"""


@register("q_stored_terms", sql=_APPLIED_SQL + """
SELECT w.doc_id, w.term, round(w.w / nrm.z, 6) AS weight FROM w JOIN nrm USING (doc_id)""")
def q_stored_terms(spark, sf_dir):
    """M6 + M7 + K5: terms fitted on the train split in a pipeline that is stored, loaded
    and applied to the test split; entries are read back by their names."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    from threatframe.operators import split as SP
    from threatframe.operators.boosting import feature_names
    from threatframe.operators.stored import TermWeights
    from threatframe.plans.q_models import _stored

    docs = SP.random_split(load_even(spark, sf_dir, "documents"), "doc_id", 0.2)
    fitted = Pipeline(stages=[TermWeights("text", size=VOCAB)]).fit(docs.filter("split = 'train'"))
    x = _stored(spark, fitted).transform(docs.filter("split = 'test'"))
    names = F.array(*[F.lit(n) for n in feature_names(x, "text_features")])
    return x.select("doc_id", F.posexplode(vector_to_array("text_features")).alias("at", "w")) \
        .filter("w <> 0").select("doc_id", F.element_at(names, F.col("at") + 1).alias("term"),
                                 F.round("w", 6).alias("weight"))


@register("q_tfidf_apply", sql=_APPLIED_SQL + """
SELECT w.doc_id, w.term, round(w.w / nrm.z, 6) AS weight FROM w JOIN nrm USING (doc_id)""")
def q_tfidf_apply(spark, sf_dir):
    """M6 on the train split, M7 on the test split: the stored vocabulary and
    document frequencies of training are applied to unseen documents."""
    from threatframe.operators import split as SP

    docs = SP.random_split(load_even(spark, sf_dir, "documents"), "doc_id", 0.2)
    train, test = docs.filter(F.col("split") == "train"), docs.filter(F.col("split") == "test")
    vocab = text.vocabulary(text.term_stats(train, "text"), VOCAB).select("term", "df")
    n_docs = train.agg(F.count(F.lit(1)).alias("n"))
    out = text.tfidf_long(test, "doc_id", "text", VOCAB, vocab=vocab, n_docs=n_docs)
    return out.select("doc_id", "term", F.round("weight", 6).alias("weight"))
