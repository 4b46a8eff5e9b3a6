"""Registered metric and model queries: class weight, AUC, report, folds,
kNN, SMOTE, boosted trees, importances, isolation forest, two-stage scoring."""

from __future__ import annotations

from fractions import Fraction

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from threatframe.functions.scalars import hash_fraction, hash_fraction_sql
from threatframe.operators import agg, metrics, model, novelty, resample, split
from threatframe.plans.registry import load, load_spread, register
from threatframe.session import cut_lineage, scratch_path
from threatframe.sources.sinks import save_model


def _scored_docs(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "n_chars")
    lab = load(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return d.join(lab, "doc_id").withColumn("score", F.col("n_chars").cast("double"))


_DOCS_SQL = """
  SELECT d.doc_id, CAST(d.n_chars AS DOUBLE) AS score, l.quality AS label
  FROM documents d JOIN labels l USING (doc_id)"""


@register("q_class_weight", sql=f"""
SELECT count(*) FILTER (WHERE label = 0) AS n_neg, count(*) FILTER (WHERE label = 1) AS n_pos,
       round(count(*) FILTER (WHERE label = 0) / count(*) FILTER (WHERE label = 1), 6) AS w_pos
FROM ({_DOCS_SQL})""")
def q_class_weight(spark, sf_dir):
    """A3 + A4."""
    w = agg.class_weight(_scored_docs(spark, sf_dir))
    return w.select("n_neg", "n_pos", F.round("w_pos", 6).alias("w_pos"))


@register("q_auc", sql=f"""
WITH b AS ({_DOCS_SQL}),
r AS (SELECT *, rank() OVER (ORDER BY score) AS lo, count(*) OVER (PARTITION BY score) AS c FROM b),
a AS (SELECT sum(CASE WHEN label = 1 THEN lo + (c - 1) / 2.0 ELSE 0 END) AS r1,
             sum(label) AS p, count(*) - sum(label) AS n FROM r)
SELECT CAST(p AS BIGINT) AS n_pos, CAST(n AS BIGINT) AS n_neg,
       round((r1 - p * (p + 1) / 2.0) / (p * n), 6) AS auc FROM a""")
def q_auc(spark, sf_dir):
    """A5: ROC AUC of `n_chars` as a score for the quality label."""
    b = _scored_docs(spark, sf_dir)
    a = metrics.auc(b, "score", "label")
    counts = b.agg(F.count_if(F.col("label") == 1).alias("n_pos"),
                   F.count_if(F.col("label") == 0).alias("n_neg"))
    return agg.attach_one_row(a, counts).select("n_pos", "n_neg", F.round("auc", 6).alias("auc"))


_ORDERS_SQL = """
  SELECT o_orderkey, o_totalprice AS score,
         CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 0 END AS label
  FROM orders WHERE o_orderstatus IN ('F', 'P')"""


@register("q_auc_orders", sql=f"""
WITH b AS ({_ORDERS_SQL}),
r AS (SELECT *, rank() OVER (ORDER BY score) AS lo, count(*) OVER (PARTITION BY score) AS c FROM b),
a AS (SELECT sum(CASE WHEN label = 1 THEN lo + (c - 1) / 2.0 ELSE 0 END) AS r1,
             sum(label) AS p, count(*) - sum(label) AS n FROM r)
SELECT round((r1 - p * (p + 1) / 2.0) / (p * n), 6) AS auc FROM a""")
def q_auc_orders(spark, sf_dir):
    """A5 over orders: price as a score for status F against P."""
    o = load(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("F", "P"))
    return metrics.auc(o.withColumn("label", (F.col("o_orderstatus") == "F").cast("int")),
                       "o_totalprice", "label").select(F.round("auc", 6).alias("auc"))


@register("q_accuracy", sql=f"""
SELECT round(avg(CASE WHEN label = (CASE WHEN score >= 100000 THEN 1 ELSE 0 END)
                      THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM ({_ORDERS_SQL})""")
def q_accuracy(spark, sf_dir):
    """Accuracy of the rule `price ≥ 100000` for status F against P."""
    o = load(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("F", "P"))
    o = o.select((F.col("o_orderstatus") == "F").cast("int").alias("label"),
                 (F.col("o_totalprice") >= 100000).cast("int").alias("pred"))
    return metrics.accuracy(o, "label", "pred").select(F.round("accuracy", 6).alias("accuracy"))


@register("q_report", sql=f"""
WITH b AS (SELECT label, CASE WHEN score >= 2000 THEN 1 ELSE 0 END AS pred FROM ({_DOCS_SQL})),
c AS (SELECT k AS cls, count(*) FILTER (WHERE label = k) AS s, count(*) FILTER (WHERE pred = k) AS q,
             count(*) FILTER (WHERE label = k AND pred = k) AS t
      FROM b, (SELECT 0 AS k UNION ALL SELECT 1) ks GROUP BY k),
m AS (SELECT CAST(cls AS VARCHAR) AS "row",
             CASE WHEN q > 0 THEN t / q ELSE 0.0 END AS precision,
             CASE WHEN s > 0 THEN t / s ELSE 0.0 END AS recall, s AS support
      FROM c WHERE s + q > 0),
m2 AS (SELECT *, CASE WHEN precision + recall > 0
                      THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM m),
allr AS (
  SELECT "row", precision, recall, f1, support FROM m2
  UNION ALL
  SELECT 'accuracy', NULL, NULL, avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END), count(*) FROM b
  UNION ALL
  SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM m2
  UNION ALL
  SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
         sum(f1 * support) / sum(support), sum(support) FROM m2)
SELECT "row", round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM allr""")
def q_report(spark, sf_dir):
    """Classification report for the rule `n_chars ≥ 2000` (F7 threshold form)."""
    b = _scored_docs(spark, sf_dir).withColumn("pred", (F.col("score") >= 2000).cast("int"))
    r = metrics.classification_report(b, "label", "pred")
    return r.select("row", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")],
                    F.col("support").cast("long").alias("support"))


_FOLDS_SQL = """
  (row_number() OVER (PARTITION BY {label} ORDER BY md5('42:' || CAST({id} AS VARCHAR)), {id}) - 1) % 5"""


@register("q_folds", sql=f"""
SELECT doc_id, quality, CAST({_FOLDS_SQL.format(label='quality', id='doc_id')} AS INTEGER) AS fold
FROM labels""")
def q_folds(spark, sf_dir):
    """M9 + W4: stratified 5-fold assignment by seeded hash rank within label."""
    lab = load(spark, sf_dir, "labels").select("doc_id", "quality")
    return split.stratified_folds(lab, "doc_id", "quality").select("doc_id", "quality", "fold")


@register("q_folds_orders", sql=f"""
SELECT o_orderkey, o_orderstatus,
       CAST({_FOLDS_SQL.format(label='o_orderstatus', id='o_orderkey')} AS INTEGER) AS fold
FROM orders""")
def q_folds_orders(spark, sf_dir):
    """M9 + W4 over orders, stratified by status."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return split.stratified_folds(o, "o_orderkey", "o_orderstatus") \
        .select("o_orderkey", "o_orderstatus", "fold")


@register("q_fold_stats", sql=f"""
WITH b AS ({_DOCS_SQL}),
f AS (SELECT *, {_FOLDS_SQL.format(label='label', id='doc_id')} AS fold FROM b),
r AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY score) AS lo,
             count(*) OVER (PARTITION BY fold, score) AS c FROM f),
a AS (SELECT fold, sum(CASE WHEN label = 1 THEN lo + (c - 1) / 2.0 ELSE 0 END) AS r1,
             sum(label) AS p, count(*) - sum(label) AS n FROM r GROUP BY fold),
auc AS (SELECT fold, (r1 - p * (p + 1) / 2.0) / (p * n) AS auc FROM a)
SELECT count(*) AS n_folds, round(avg(auc), 6) AS auc_mean, round(stddev_pop(auc), 6) AS auc_std
FROM auc""")
def q_fold_stats(spark, sf_dir):
    """A5 per fold + A8: mean and population std of the fold AUCs."""
    b = split.stratified_folds(_scored_docs(spark, sf_dir), "doc_id", "label")
    per = metrics.auc(b, "score", "label", ["fold"])
    s = metrics.fold_summary(per)
    return s.select("n_folds", F.round("auc_mean", 6).alias("auc_mean"),
                    F.round("auc_std", 6).alias("auc_std"))


_MINOR_SQL = "SELECT vec_id, embedding FROM embeddings WHERE label = 0"
_D2_SQL = ("list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: "
           "(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)) * "
           "(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE))))")
_KNN_SQL = f"""
m AS ({_MINOR_SQL}),
p AS (SELECT a.vec_id, b.vec_id AS nn_id, {_D2_SQL} AS d2 FROM m a JOIN m b ON a.vec_id <> b.vec_id),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, nn_id) AS nn_rank
                      FROM p) WHERE nn_rank <= 5)"""


@register("q_knn", sql=f"""
WITH {_KNN_SQL}
SELECT vec_id, nn_id, CAST(nn_rank AS INTEGER) AS nn_rank, round(sqrt(d2), 6) AS dist FROM nn""")
def q_knn(spark, sf_dir):
    """M8 (neighbours): exact 5 nearest minority neighbours of each minority point."""
    e = load_spread(spark, sf_dir, "embeddings").filter(F.col("label") == 0)
    out = resample.knn(e, "vec_id", "embedding", 5)
    return out.select("vec_id", "nn_id", F.col("nn_rank").cast("int").alias("nn_rank"),
                      F.round("dist", 6).alias("dist"))


@register("q_smote", sql=f"""
WITH {_KNN_SQL},
cnt AS (SELECT count(*) FILTER (WHERE label = 0) AS m, count(*) FILTER (WHERE label <> 0) AS big
        FROM embeddings),
j AS (SELECT unnest(range(0, CAST(floor(0.3 * big) - m AS BIGINT))) AS synth_id, m FROM cnt),
base AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id) AS i FROM m),
g AS (SELECT j.synth_id, base.vec_id AS base_id, base.embedding AS be,
             CAST(floor({hash_fraction_sql('42:nn', 'j.synth_id')} * 5) + 1 AS BIGINT) AS nn_rank,
             {hash_fraction_sql('42:u', 'j.synth_id')} AS u
      FROM j JOIN base ON base.i = (j.synth_id % j.m) + 1),
s AS (SELECT g.synth_id, g.base_id, nn.nn_id, g.u,
             list_transform(range(1, len(g.be) + 1), lambda k:
               CAST(g.be[k] AS DOUBLE) + g.u * (CAST(e.embedding[k] AS DOUBLE) - CAST(g.be[k] AS DOUBLE)))
               AS pt
      FROM g JOIN nn ON nn.vec_id = g.base_id AND nn.nn_rank = g.nn_rank
      JOIN m e ON e.vec_id = nn.nn_id)
SELECT synth_id, base_id, nn_id, round(u, 6) AS u, round(pt[1], 5) AS x0,
       round(sqrt(list_sum(list_transform(pt, lambda v: v * v))), 4) AS norm FROM s""")
def q_smote(spark, sf_dir):
    """M8 + U3: SMOTE to 0.3 × majority for the label-0 minority (seeded)."""
    e = load_spread(spark, sf_dir, "embeddings")
    syn = resample.smote(e, "vec_id", "embedding", "label", 0, ratio=Fraction(3, 10))
    pt = F.col("embedding")
    return syn.select("synth_id", "base_id", "nn_id", F.round("u", 6).alias("u"),
                      F.round(pt[0], 5).alias("x0"),
                      F.round(F.sqrt(F.aggregate(pt, F.lit(0.0), lambda a, v: a + v * v)), 4)
                      .alias("norm"))


def _embedding_frame(spark, sf_dir):
    """Named vectors with a test part, and a validation part of the training rows."""
    e = load_spread(spark, sf_dir, "embeddings").withColumn(
        "label", (F.col("label") == 0).cast("int"))
    e = split.random_split(e, "vec_id", 0.2)
    e = e.withColumn("held", hash_fraction("42:held", F.col("vec_id")) < 0.2)
    return model.vectorize(e, array_col="embedding")


def _fit(spark, sf_dir):
    """The frame and a model fitted on its train split, anew for each query, at the full
    settings: up to 1000 rounds, stopped by the AUC of the held part."""
    e = _embedding_frame(spark, sf_dir)
    return e, model.fit_gbt(e.filter(F.col("split") == "train"), validation_col="held")


@register("q_gbt_score")
def q_gbt_score(spark, sf_dir):
    """M10 + M13 + F7: weighted boosted trees on the train split, scored on the test split."""
    e, m = _fit(spark, sf_dir)
    s = model.score(m, e.filter(F.col("split") == "test"))
    return s.select("vec_id", "label", F.round("p_class1", 6).alias("prob"), "pred_label")


def _first_tree_sql() -> str:
    """The first tree of the weighted fit level by level: from margin 0 every row has
    gradient w (0.5 - y) and Hessian w / 4."""
    sums = "0.5 * sum(n0) - 0.5 * any_value(w) * sum(n1)", "0.25 * sum(n0) + 0.25 * any_value(w) * sum(n1)"
    ctes = ["""
rows AS (SELECT vec_id, CASE WHEN label = 0 THEN 1 ELSE 0 END AS y, unnest(embedding) AS v,
                generate_subscripts(embedding, 1) - 1 AS f FROM embeddings),
wt AS (SELECT count(*) FILTER (WHERE label <> 0) / count(*) FILTER (WHERE label = 0) AS w FROM embeddings),
qs AS (SELECT f, unnest(quantile_disc(CAST(v AS DOUBLE), [""" + ", ".join(
        f"{k}.0 / {model.BORDERS + 1}.0" for k in range(1, model.BORDERS + 1)) + """])) AS b FROM rows GROUP BY f),
cand AS (SELECT f, b, row_number() OVER (PARTITION BY f ORDER BY b) - 1 AS c FROM (SELECT DISTINCT f, b FROM qs)),
binned AS (SELECT r.vec_id, r.y, r.f, count(k.b) AS bin FROM rows r
           LEFT JOIN cand k ON k.f = r.f AND k.b < CAST(r.v AS DOUBLE) GROUP BY r.vec_id, r.y, r.f),
n0 AS (SELECT vec_id, 0 AS node FROM embeddings)"""]
    for d in range(model.DEPTH):
        ctes.append(f"""
h{d} AS (SELECT b.f, n.node, b.bin, count(*) FILTER (WHERE y = 0) AS n0, count(*) FILTER (WHERE y = 1) AS n1
         FROM binned b JOIN n{d} n USING (vec_id) GROUP BY b.f, n.node, b.bin),
s{d} AS (SELECT h.f, k.c, h.node, h.bin <= k.c AS low, {sums[0]} AS g, {sums[1]} AS h
         FROM h{d} h JOIN cand k ON k.f = h.f CROSS JOIN wt GROUP BY h.f, k.c, h.node, h.bin <= k.c),
p{d} AS (SELECT f, c, node, sum(g) AS g, sum(h) AS h FROM s{d} GROUP BY f, c, node),
a{d} AS (SELECT f, c, sum(x) AS gain FROM (
           SELECT f, c, g * g / (h + {model.L2}) AS x FROM s{d} UNION ALL
           SELECT f, c, -g * g / (h + {model.L2}) AS x FROM p{d}) GROUP BY f, c),
t{d} AS (SELECT f, c, gain FROM a{d} ORDER BY round(gain, 9) DESC, f, c LIMIT 1),
n{d + 1} AS (SELECT b.vec_id, n.node + CASE WHEN b.bin > t.c THEN {1 << d} ELSE 0 END AS node
             FROM binned b JOIN t{d} t ON t.f = b.f JOIN n{d} n ON n.vec_id = b.vec_id)""")
    last = f"n{model.DEPTH}"
    ctes.append(f"""
leaf AS (SELECT node, {sums[0]} AS g, {sums[1]} AS h FROM (
           SELECT n.node, count(*) FILTER (WHERE e.label <> 0) AS n0, count(*) FILTER (WHERE e.label = 0) AS n1
           FROM {last} n JOIN embeddings e USING (vec_id) GROUP BY n.node) CROSS JOIN wt GROUP BY node)""")
    splits = " UNION ALL ".join(
        f"SELECT 'split' AS part, {d} AS idx, CAST(t.f AS INTEGER) AS feature, round(k.b, 6) AS threshold, "
        f"round(t.gain, 4) AS value FROM t{d} t JOIN cand k ON k.f = t.f AND k.c = t.c"
        for d in range(model.DEPTH))
    return ("WITH " + ",".join(ctes) + "\n" + splits + f"""
UNION ALL
SELECT 'leaf', CAST(node AS INTEGER), -1, 0.0, round(-{model.LEARNING_RATE} * g / (h + {model.L2}), 6) FROM leaf
WHERE g <> 0""")


@register("q_gbt_first_tree", sql=_first_tree_sql())
def q_gbt_first_tree(spark, sf_dir):
    """Splits (feature, border, gain) and leaves of the first tree over all rows."""
    e = load_spread(spark, sf_dir, "embeddings").withColumn(
        "label", (F.col("label") == 0).cast("int"))
    t = model.fit_gbt(model.vectorize(e, array_col="embedding"), rounds=1).trees
    rows = [("split", d, int(f), round(float(t.borders[f][c]), 6), round(float(g), 4))
            for d, (f, c, g) in enumerate(zip(t.features[0], t.cuts[0], t.gains[0]))]
    rows += [("leaf", i, -1, 0.0, round(float(x), 6)) for i, x in enumerate(t.leaves[0]) if x]
    return spark.createDataFrame(
        rows, "part string, idx int, feature int, threshold double, value double")


@register("q_importance")
def q_importance(spark, sf_dir):
    """M14 + L1: top-20 feature importances (× 100, 3 decimals), by the tracked names."""
    _e, m = _fit(spark, sf_dir)
    return model.importances(spark, m, k=20)


@register("q_iforest")
def q_iforest(spark, sf_dir):
    """M15 + M16 + F8: isolation forest fitted on the train split, all rows scored."""
    e = split.random_split(load_spread(spark, sf_dir, "embeddings"), "vec_id", 0.2)
    nov = novelty.novelty(e.filter(F.col("split") == "train"), e, "vec_id", "embedding")
    return nov.select("vec_id", F.round("novelty_score", 6).alias("novelty_score"), "is_novel")


@register("q_two_stage")
def q_two_stage(spark, sf_dir):
    """Hash lookup first (vectors seen in training), model + novelty for
    the rest; one result with its route."""
    from threatframe.plans.score import two_stage

    e, m = _fit(spark, sf_dir)
    e = e.withColumn("sha256", F.sha2(F.to_json("embedding"), 256))
    train, test = e.filter(F.col("split") == "train"), e.filter(F.col("split") == "test")
    lookup = train.groupBy("sha256").agg(F.avg("label").alias("p"))
    return two_stage(test, lookup, m, train, id_col="vec_id", key="sha256", vec="embedding")


@register("q_evaluate")
def q_evaluate(spark, sf_dir):
    """AUC and classification report of the test split, long form."""
    e, m = _fit(spark, sf_dir)
    s = model.score(m, e.filter(F.col("split") == "test"))
    rep = metrics.classification_report(s, "label", "pred_label")
    a = metrics.auc(s, "p_class1", "label").select(
        F.lit("auc").alias("row"), F.lit(None).cast("double").alias("precision"),
        F.lit(None).cast("double").alias("recall"), F.col("auc").alias("f1"),
        F.lit(None).cast("long").alias("support"))
    return rep.unionByName(a)


@register("q_cv_auc")
def q_cv_auc(spark, sf_dir):
    """M9 + M8 (inside folds) + A4 + M10 + A5 + A8: 5-fold cross-validated AUC."""
    from threatframe.plans.train import cross_validate

    e = load_spread(spark, sf_dir, "embeddings").withColumn("label", (F.col("label") == 0).cast("int"))
    per, summary = cross_validate(e, "vec_id", "embedding", "label", k=5)
    return per.select(F.col("fold").cast("string").alias("fold"), F.round("auc", 6).alias("auc")) \
        .unionByName(summary.select(F.lit("mean").alias("fold"),
                                    F.round("auc_mean", 6).alias("auc")))


@register("q_novelty_encoded")
def q_novelty_encoded(spark, sf_dir):
    """M17 + M15 + M16 + K5: customers encoded (numeric balance, one-hot market segment,
    nation by frequency), isolation forest fitted on all; the stored pipeline scores."""
    from threatframe.operators.stored import CategoryEncoder, IsolationForest

    c = load_spread(spark, sf_dir, "customer")
    encoder = CategoryEncoder(["c_acctbal"], ["c_mktsegment"], ["c_nationkey"])
    fitted = Pipeline(stages=[encoder, IsolationForest("c_custkey", "iso_features")]).fit(c)
    return _stored(spark, fitted).transform(c).select(
        "c_custkey", F.round("novelty_score", 6).alias("novelty_score"), "is_novel")


def _stored(spark, fitted):
    """The pipeline model as loaded from where it was saved."""
    path = scratch_path(spark, "model")
    save_model(fitted, path)
    return PipelineModel.load(path)


_TRAIN_SQL = hash_fraction_sql(42, "{id}") + " >= 0.2"


@register("q_stored_encoders", sql=f"""
WITH train AS (SELECT * FROM customer WHERE c_acctbal > 0 AND {_TRAIN_SQL.format(id="c_custkey")}),
freq AS (SELECT c_nationkey, count(*) / (SELECT count(*) FROM train) AS share FROM train GROUP BY c_nationkey)
SELECT c.c_custkey, round(CAST(c.c_acctbal AS DOUBLE), 4) AS c_acctbal, round(coalesce(f.share, 0), 6) AS nation_share,
       CASE WHEN c.c_mktsegment IN (SELECT c_mktsegment FROM train) THEN 'c_mktsegment=' || c.c_mktsegment
            ELSE '' END AS segment
FROM customer c LEFT JOIN freq f USING (c_nationkey)""")
def q_stored_encoders(spark, sf_dir):
    """M17 + K5: encoders fitted on the train split, stored, loaded, applied to all."""
    from threatframe.operators.stored import CategoryEncoder

    c = load(spark, sf_dir, "customer")
    train = split.random_split(c, "c_custkey", 0.2).filter("split = 'train' and c_acctbal > 0")
    loaded = _stored(spark, Pipeline(stages=[CategoryEncoder(
        ["c_acctbal"], ["c_mktsegment"], ["c_nationkey"], "x")]).fit(train))
    names = F.array(*[F.lit(n) for n in loaded.stages[0].names])
    hot = F.filter(F.arrays_zip(names.alias("name"), F.col("x")), lambda e: (e["x"] == 1) &
                   e["name"].startswith("c_mktsegment="))
    return loaded.transform(c).select(
        "c_custkey", F.round(F.col("x")[0], 4).alias("c_acctbal"),
        F.round(F.col("x")[1], 6).alias("nation_share"),
        F.coalesce(F.get(hot, F.lit(0))["name"], F.lit("")).alias("segment"))


_NUMERIC = ["n_chars", "toxic"]
_PROFILE = ["n_events", "max_severity"]


def _labelled_documents(spark, sf_dir):
    """Documents with a label (quality), completed with the event profile of their id; the
    toxic mark stands for an input that comes from the verdict."""
    from threatframe.plans import classify
    from threatframe.plans.q_events import matched_events
    from threatframe.plans.roles import EVENT_TYPES

    d = load_spread(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    lab = load(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"), "toxic")
    rows = split.random_split(d.join(lab, "doc_id"), "doc_id", 0.2) \
        .withColumn("held", hash_fraction("42:held", F.col("doc_id")) < 0.2)
    profile = agg.event_profile(matched_events(spark, sf_dir), "alert_id", "event_type", EVENT_TYPES,
                                "value").withColumnRenamed("alert_id", "doc_id")
    return cut_lineage(classify.complete(rows, profile, "doc_id", _NUMERIC, _PROFILE, "text"))


def _document_model(spark, sf_dir):
    """The completed rows, and the stored pipeline fitted on their train split."""
    from threatframe.plans import classify

    rows = _labelled_documents(spark, sf_dir)
    fitted = classify.pipeline([*_NUMERIC, *_PROFILE], "text", validation_col="held") \
        .fit(rows.filter("split = 'train'"))
    return rows, _stored(spark, fitted)


@register("q_evaluate_inputs")
def q_evaluate_inputs(spark, sf_dir):
    """M19 + P10 + K5: the stored classifier over the whole matrix, evaluated on the test
    split with all inputs, without notes, and without notes and verdict."""
    from functools import reduce

    from threatframe.plans import classify

    rows, fitted = _document_model(spark, sf_dir)
    test = rows.filter("split = 'test'")
    parts = [classify.evaluate(test, fitted, "text", ["toxic"], ignore_notes=notes, ignore_verdict=verdict)
             .withColumn("hidden", F.lit(name))
             for name, notes, verdict in (("nothing", False, False), ("notes", True, False),
                                          ("notes and verdict", True, True))]
    return reduce(lambda a, b: a.unionByName(b), parts).withColumn("value", F.round("value", 4))


@register("q_score_documents")
def q_score_documents(spark, sf_dir):
    """M18 + K5: test documents by the hash of their text among training documents, the
    rest by the stored classifier and the stored forest."""
    from threatframe.operators.stored import CategoryEncoder, IsolationForest
    from threatframe.plans.score import two_stage

    rows, fitted = _document_model(spark, sf_dir)
    rows = rows.withColumn("sha256", F.sha2("text", 256))
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    forest = _stored(spark, Pipeline(stages=[
        CategoryEncoder([*_NUMERIC, *_PROFILE], [], []),
        IsolationForest("doc_id", "iso_features")]).fit(train))
    lookup = train.groupBy("sha256").agg(F.avg("label").alias("p"))
    return two_stage(test, lookup, fitted, None, id_col="doc_id", key="sha256", vec="iso_features",
                     forest=forest)
