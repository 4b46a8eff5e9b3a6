"""Quality classifier by attention over passages (operator 4).

A document is a bag of passages of PASSAGE_WORDS words; every passage of the
whole text is encoded (word shape, repetition and character class figures, then
a learned tanh layer).  Gated attention, softmax over w·(tanh(V h) * sigmoid(U h)),
weighs the passages, and a logistic layer scores the weighted representation:
attention-based multiple-instance learning with labels on documents only.

Training uses a bounded sample: the TRAIN_DOCS labelled documents first in hash
order among those whose crc32(doc_id as text) mod 5 is not 0; of a longer bag
MAX_BAG passages at even distances over the whole text are learned from.  Their
encodings come to the driver, which fits the layers by full-batch Adam; scoring
runs over all passages of all documents.

A null or empty text is a bag of one passage without words and gets that bag's
score.  A doc_id with several labels or texts is learned with the smallest of each;
null labels and ids are not learned from.  Repeated rows get equal scores.  Without labels of both
classes every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

import math
import operator
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from threatframe.llm.common import query, table, with_text_scores

PASSAGE_WORDS = 100
TRAIN_DOCS = 3000
MAX_BAG = 256
HIDDEN = 16
ROUNDS = 150
THRESHOLD = 0.3
_CLASSES = 10


def _class_table() -> bytes:
    """Byte -> class: lower, upper, digit, space, line end, stop, comma-like, bar,
    other ASCII sign, beyond ASCII."""
    out = bytearray(256)
    for b in range(256):
        c = chr(b)
        out[b] = (9 if b >= 128 else 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit()
                  else 4 if c == "\n" else 3 if c.isspace() else 5 if c == "." else
                  6 if c in ",;:'\"()-?" else 7 if c == "|" else 8)
    return bytes(out)


_TABLE = _class_table()
_MARKS = [bytes([k]) for k in range(_CLASSES)]
FEATURES = _CLASSES + 10


def passages(text: str | None) -> list[list[str]]:
    words = (text or "").split(" ")
    return [words[i:i + PASSAGE_WORDS] for i in range(0, len(words), PASSAGE_WORDS)]


def encode(passage: list[str]) -> list[float]:
    """Figures of one passage: character class shares and word statistics."""
    raw = " ".join(passage).encode()
    classes = raw.translate(_TABLE)
    size, n = max(1, len(raw)), len(passage)
    kinds = set(passage)
    low = sum(map(str.islower, passage))
    return [*(classes.count(m) / size for m in _MARKS),
            len(kinds) / n,
            sum(map(operator.eq, passage, islice(passage, 1, None))) / n,
            sum(map(str.isupper, passage)) / n,
            sum(map(str.isalpha, passage)) / n,
            low / n,
            (n - low - sum(map(str.isupper, passage))) / n,
            math.log1p(size / n),
            math.log1p(n) / 5,
            math.log1p(max(map(len, passage))) / 5,
            sum(map(len, kinds)) / size]


def encode_text(text: str | None) -> np.ndarray:
    return np.array([encode(p) for p in passages(text)])


class AttentionModel:
    """Gated-attention scorer; parameters are numpy arrays of fixed size."""

    def __init__(self, mean, scale, params, constant=None):
        self.mean, self.scale, self.params, self.constant = mean, scale, params, constant

    def score(self, bag: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        p = self.params
        h = np.tanh((bag - self.mean) / self.scale @ p["W"] + p["b"])
        e = (np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"]
        a = np.exp(e - e.max())
        z = (a / a.sum()) @ h
        return float(1 / (1 + np.exp(-(z @ p["c"] + p["d"][0]))))


def train(bags: list[np.ndarray], labels: np.ndarray, rounds: int = ROUNDS,
          seed: int = 5) -> AttentionModel:
    """Fit by full-batch Adam on the mean logistic loss."""
    if len(bags) == 0 or len(set(labels.tolist())) < 2:
        return AttentionModel(None, None, None,
                              float(labels.mean()) if len(bags) else 0.5)
    x = np.concatenate(bags)
    first = np.cumsum([0, *map(len, bags)])[:-1]
    bag = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / scale
    rng = np.random.default_rng(seed)
    p = {"W": rng.normal(0, .3, (x.shape[1], HIDDEN)), "b": np.zeros(HIDDEN),
         "V": rng.normal(0, .3, (HIDDEN, HIDDEN)), "U": rng.normal(0, .3, (HIDDEN, HIDDEN)),
         "w": rng.normal(0, .3, HIDDEN), "c": rng.normal(0, .3, HIDDEN), "d": np.zeros(1)}
    m1 = {k: np.zeros_like(v) for k, v in p.items()}
    m2 = {k: np.zeros_like(v) for k, v in p.items()}
    for t in range(1, rounds + 1):
        h = np.tanh(x @ p["W"] + p["b"])
        tv, su = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (tv * su) @ p["w"]
        a = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a /= np.add.reduceat(a, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first)
        s = 1 / (1 + np.exp(-(z @ p["c"] + p["d"][0])))
        g = (s - labels) / len(labels)
        dz = g[:, None] * p["c"]
        da = (dz[bag] * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, first)[bag])
        dt, ds = de[:, None] * p["w"] * su * (1 - tv ** 2), \
            de[:, None] * p["w"] * tv * su * (1 - su)
        dh = (a[:, None] * dz[bag] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h ** 2)
        grad = {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds,
                "w": (de[:, None] * tv * su).sum(0), "c": z.T @ g, "d": np.array([g.sum()])}
        for k in p:
            grad[k] = grad[k] + (1e-5 * p[k] if k != "d" else 0)
            m1[k] = .9 * m1[k] + .1 * grad[k]
            m2[k] = .999 * m2[k] + .001 * grad[k] ** 2
            p[k] = p[k] - .02 * (m1[k] / (1 - .9 ** t)) / (np.sqrt(m2[k] / (1 - .999 ** t)) + 1e-8)
    return AttentionModel(mean, scale, p)


def learnable(id_col: str = "doc_id") -> Column:
    """Rows to learn from: crc32 of the id as text, modulo 5, is not 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", sample: int = TRAIN_DOCS) -> AttentionModel:
    rows = (labels.filter(learnable(id_col) & F.col(label_col).isNotNull())
            .groupBy(F.col(id_col).cast("long").alias("_id"))
            .agg(F.min(label_col).cast("int").alias("_label"))
            .orderBy(F.xxhash64("_id"), "_id").limit(sample))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"))
    # `sample` rows at most; rows that share an id meet in partial aggregates first
    chosen = texts.join(F.broadcast(rows), "_id") \
        .groupBy("_id", "_label").agg(F.min("text").alias("text"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            bags = [encode_text(t) for t in b.column("text").to_pylist()]
            bags = [x[np.linspace(0, len(x) - 1, MAX_BAG).astype(int)] if len(x) > MAX_BAG else x
                    for x in bags]
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), b.column("_label"),
                 pa.array([x.ravel() for x in bags], pa.list_(pa.float64()))],
                names=["_id", "_label", "bag"])

    got = chosen.select("_id", "_label", "text").mapInArrow(
        run, "_id long, _label int, bag array<double>").toPandas().sort_values("_id")
    bags = [np.asarray(b).reshape(-1, FEATURES) for b in got["bag"]]
    return train(bags, got["_label"].to_numpy(dtype=float))


def assess(docs: DataFrame, model: AttentionModel, text_col: str = "text") -> DataFrame:
    """Add `score` to all columns of `docs`."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def make():
        m = held.value
        return lambda texts: ([m.score(encode_text(t)) for t in texts],)

    return with_text_scores(docs, text_col, "score double", make)


@query("op4_quality")
def op4_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return assess(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(~learnable(), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
