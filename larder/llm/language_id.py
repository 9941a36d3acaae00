"""Language identification: sparse multinomial logistic regression on TF-IDF of character 1- to 3-grams.

n-grams are hashed to 2^15 features; document frequencies are counted over all documents. The model is fitted by
follow-the-regularised-leader (FTRL-Proximal, McMahan et al., 2013) with elastic-net penalties on a sample of labelled rows, whose bound is
`per_class` rows for each language (drawn by a hash of the text, in proportion); a quarter of it is held out to find the
temperature by which scores are divided before they are read as probabilities. Every document is scored over its whole text.

Defined results: texts without a letter, null or empty texts are 'und' with confidence 0; so is everything when no row has a
label. Of the labels the `MOST_LABELS` commonest are learnt, so that a column of noise can't fill the driver; rows of others are left out of
the sample and get the likeliest of those. With one label only, texts with letters get it. Every row gives one row, repeated rows and null doc_ids included.
Labels are used as they stand; ties go to the label that sorts first. Other columns, whatever their names, aren't looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.features import characters, document_frequencies, idf, products, take, tfidf, vectors
from larder.llm.textual import slices
from larder.runtime import ship

BITS, PER_CLASS, MOST_LABELS = 15, 1000, 512
OUT = "doc_id bigint, lang string, confidence double"


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(data, y: np.ndarray, classes: int, bits: int = BITS, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.1, seed: int = 7) -> np.ndarray:
    """Weights (features, classes) after `epochs` passes of one row at a time; most are zero."""
    at, feature, value = data
    z, n = np.zeros((1 << bits, classes)), np.zeros((1 << bits, classes))

    def weights(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            f, x = feature[at[i] : at[i + 1]], value[at[i] : at[i + 1], None]
            zf, nf = z[f], n[f]
            w = weights(zf, nf)
            p = softmax((w * x).sum(0))
            p[y[i]] -= 1
            g = x * p[None, :]
            z[f] = zf + g - (np.sqrt(nf + g * g) - np.sqrt(nf)) / alpha * w
            n[f] = nf + g * g
    return weights(z, n)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the scores under which held-out labels are likeliest, by golden section on its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-300)).mean()
    a, b, r = np.log(0.02), np.log(50.0), (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(docs: DataFrame, label: str = "lang", per_class: int = PER_CLASS, most_labels: int = MOST_LABELS):
    """(labels, idf, weights, temperature, held-out accuracy), or None where no row has a label."""
    df, n = document_frequencies(docs, characters, BITS)
    weight = idf(df, n)
    rows = docs.select(F.col(label).cast("string").alias("label"), F.col("text").cast("string").alias("text")).where("label is not null and text <> ''")
    common = rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(most_labels)
    count = {r[0]: r[1] for r in common.collect()}  # most_labels rows at most
    if not count:
        return None
    labels = sorted(count)
    share = F.create_map(*[F.lit(x) for k in labels for x in (k, min(1.0, per_class / count[k]))])
    draw = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) / 1_000_003
    y, at, feature, value = vectors(rows.where(draw < F.try_element_at(share, F.col("label"))), characters, BITS, weight)
    y = np.array([labels.index(v) for v in y], np.int64)
    order = np.random.default_rng(11).permutation(np.lexsort((np.diff(at), y)))
    held, used = order[: len(order) // 4], order[len(order) // 4 :]
    w = ftrl(take(at, feature, value, used), y[used], len(labels))
    logits = products(*take(at, feature, value, held), w)
    good = float((logits.argmax(1) == y[held]).mean()) if len(held) else float("nan")
    return labels, weight, w, temperature(logits, y[held]), good


def identify(docs: DataFrame, label: str = "lang", per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, lang, confidence) of every document."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(fit(docs, label, per_class))

    def run(batches):
        model = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                names, sure = np.full(part.num_rows, "und", object), np.zeros(part.num_rows)
                if model is not None:
                    labels, weight, w, heat, _ = model
                    at, feature, value = tfidf(characters(part.column("text"), BITS), weight)
                    p = softmax(products(at, feature, value, w) / heat)
                    known = np.diff(at) > 0
                    names[known] = np.array(labels, object)[p.argmax(1)][known]
                    sure[known] = p.max(1)[known]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names.tolist(), pa.string()), pa.array(sure)], ["doc_id", "lang", "confidence"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, OUT)
