"""Language ID and quality: held-out accuracy and hard cases."""

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.llm.conftest import cases
from threatframe.llm import language_id, quality
from threatframe.llm.common import table


def test_language_held_out_accuracy(spark):
    docs = table(spark, SF_SMALL, "documents")
    model = language_id.fit(docs, language_id.learnable())
    held = docs.filter(~language_id.learnable())
    got = language_id.identify(held, model)
    assert got.filter("lang = lang_pred").count() >= 0.97 * held.count()
    assert got.filter("score < 0 or score > 1").count() == 0


def test_language_hard_cases(spark, edge, empty):
    model = language_id.fit(table(spark, SF_SMALL, "documents"), language_id.learnable())
    got = language_id.identify(edge, model)
    assert set(got.columns) == set(edge.columns) | {"lang_pred"}
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(cases())
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (14, 15, 16, 17))
    assert rows[18].lang_pred in model.languages and rows[10].score == rows[11].score
    assert language_id.identify(empty, model).count() == 0
    none = language_id.fit(empty, language_id.learnable())
    assert {r.lang_pred for r in language_id.identify(edge, none).collect()} == {"und"}


def test_backoff_uses_shorter_grams():
    logs = {"words": {"the": np.log([0.9, 0.1])},
            "grams": {"<qua": np.log([0.8, 0.2]), "x": np.log([0.1, 0.9])}}
    m = language_id.LanguageModel(["a", "b"], logs["words"], logs["grams"])
    the, qua, xx, other = m.logs(["the", "qua", "xx", "??"])
    assert np.allclose(the, logs["words"]["the"])
    assert qua.argmax() == 0 and xx.argmax() == 1 and np.allclose(np.exp(other), 0.5)


def test_quality_separates_noise(spark):
    docs, labels = table(spark, SF_SMALL, "documents"), table(spark, SF_SMALL, "labels")
    model = quality.fit(docs, labels)
    got = quality.assess(docs, model).join(labels, "doc_id").select("score", "quality").toPandas()
    good, bad = got.score[got.quality == 1], got.score[got.quality == 0]
    auc = np.mean([[g > b for b in bad] for g in good])
    assert auc > 0.95 and got.score.between(0, 1).all()


def test_quality_hard_cases(spark, edge, empty):
    docs, labels = table(spark, SF_SMALL, "documents"), table(spark, SF_SMALL, "labels")
    model = quality.fit(docs, labels)
    rows = quality.assess(edge, model).collect()
    assert len(rows) == len(cases())
    by = {r.doc_id: r.score for r in rows}
    assert by[14] == by[15] and by[10] == by[11] and all(0 <= s <= 1 for s in by.values())
    assert quality.assess(empty, model).count() == 0
    one_class = quality.fit(docs, labels.filter("quality = 1"))
    assert one_class.score(quality.encode_text("a b")) == 1.0
    assert quality.fit(docs, labels.filter("quality = 7")).score(quality.encode_text("")) == 0.5
    nulls = labels.withColumn("quality", F.lit(None).cast("int"))
    assert quality.fit(docs, nulls).constant == 0.5


def test_training_gradient():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(3, quality.FEATURES)) for _ in range(60)]
    y = np.array([float(b[:, 0].max() > 0.8) for b in bags])
    m = quality.train(bags, y, rounds=400)
    s = np.array([m.score(b) for b in bags])
    assert np.mean([[a > b for b in s[y == 0]] for a in s[y == 1]]) > 0.95
