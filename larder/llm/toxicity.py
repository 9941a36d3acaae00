"""Toxicity: non-negative positive-unlabelled learning (nnPU, Kiryo et al., 2017).

Texts are TF-IDF vectors of hashed words and of the 4- and 5-grams inside them; document frequencies are counted over all documents.
A classifier looks at the `telling` features that set confirmed examples apart most in its sample. Classifiers are trained by numpy
from confirmed toxic examples and unlabelled documents with the risk
    prior x E_toxic[loss(+)] + max(0, E_unlabelled[loss(-)] - prior x E_toxic[loss(-)])
under the logistic loss; the class prior is a parameter, or the toxic share of all labelled rows, but no more than the documents
allow: a feature that a share of the confirmed examples has can't be rarer in all documents than that share of the toxic ones. The sample has at most about
`positives` toxic and `unlabelled` other rows, drawn by a hash of the text; texts fall into
folds by a hash, and each of the classifiers is trained without one fold, so that a wrong label can't be learnt by heart. Every document is scored over its whole text, by the one classifier that its fold wasn't shown to; above 0.5 it is toxic.

Defined results: null or empty texts, and texts without a word, score 0 and aren't toxic. Without a confirmed example nothing is toxic. Every row
gives one row, repeated rows and null doc_ids included. A document that several label rows call toxic counts once. Other
columns, whatever their names, aren't looked at, and pass through the filter. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.features import SLICE, document_frequencies, flagged, idf, label_frequencies, products, take, telling, tfidf, vectors, word_parts
from larder.llm.tables import fit as fitted
from larder.llm.textual import slices
from larder.runtime import forget, materialize, ship

BITS, FOLDS, POSITIVES, UNLABELLED, TELLING = 18, 3, 4000, 12000, 1024
OUT = "doc_id bigint, score double, toxic boolean"


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def nnpu(data, positive: np.ndarray, prior: float, epochs: int = 150, rate: float = 0.3, l2: float | None = None, beta: float = 0.0, gamma: float = 1.0, adaptive: bool = True) -> tuple[np.ndarray, float]:
    """Weights over the sample's features and the bias that minimise the non-negative risk.

    Steps are Adam's (Kingma and Ba, 2015), by which features that few examples have are learnt as soon as common ones; plain gradient
    steps without `adaptive`. The penalty on weights is a hundredth by the number of rows unless it is given.
    """
    l2 = 0.01 / max(1, len(positive)) if l2 is None else l2
    at, feature, value = data
    size = int(feature.max()) + 1 if len(feature) else 1
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    n_p, n_u = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    w = np.zeros(size + 1)  # the bias last
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, epochs + 1):
        z = np.bincount(row, value * w[feature], len(at) - 1) + w[-1]
        s, loss = sigmoid(z), np.logaddexp(0, z)  # the loss for "-" and its slope s; for "+" the slope is s - 1
        minus = loss[~positive].sum() / n_u - prior * loss[positive].sum() / n_p
        g = np.where(positive, -prior / n_p * s, s / n_u)
        if minus >= -beta:
            g = g + np.where(positive, prior / n_p * (s - 1), 0.0)
        else:
            g = -gamma * g
        slope = np.append(np.bincount(feature, value * g[row], size), g.sum())
        slope[:-1] += l2 * w[:-1]
        if adaptive:
            first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
            step = first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        else:
            step = slope
        w = w - rate * step
    return w[:-1], float(w[-1])


def allowed(share: float, p: np.ndarray, n_p: int, everywhere: np.ndarray, total: int, least: int = 10, common: float = 0.2) -> float:
    """The class prior: the share of toxic documents, held under what each feature that is common among the examples allows."""
    seen = p / max(n_p, 1)
    use = (p >= least) & (seen >= common)
    if not use.any() or not total:
        return share
    sure = seen - np.sqrt(seen * (1 - seen) / n_p)  # less one standard error
    return float(min(share, (everywhere[use] / total / np.maximum(sure[use], 1e-9)).min()))


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED, most: int = TELLING, least_df: int = 5):
    """(idf, [(weights, bias)]) or None where no document is confirmed toxic."""
    marked = labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    n, bad = marked.agg(F.count("*"), F.sum("toxic")).first()
    if not bad:
        return None
    everywhere, total = document_frequencies(docs, word_parts, BITS)
    weight = idf(everywhere, total)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text")).where("text <> ''")
    draw = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) / 1_000_003
    toxic = marked.where("toxic = 1").select("id")
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")
    picked = rows.where(draw < min(1.0, positives / bad)).join(fitted(toxic, 16), "id", "left_semi").select((fold + FOLDS).alias("label"), "text")
    others = rows.where(draw < min(1.0, unlabelled / max(total, 1))).select(fold.alias("label"), "text")
    sample = materialize(picked.union(others), "toxicity-sample")
    df, n_of = label_frequencies(sample, word_parts, BITS, 2 * FOLDS)
    if not n_of[FOLDS:].any():
        return None
    if prior is None:
        prior = allowed(min(0.9, bad / n), df[FOLDS:].sum(0), int(n_of[FOLDS:].sum()), everywhere, total)
    chosen, shown = [], np.zeros(1 << BITS, bool)
    for k in range(FOLDS):
        use = [i for i in range(FOLDS) if i != k]
        use = use if n_of[[FOLDS + i for i in use]].any() else list(range(FOLDS))
        bad_ones = [FOLDS + i for i in use]
        p, u, n_p, n_u = df[bad_ones].sum(0), df[use].sum(0), int(n_of[bad_ones].sum()), int(n_of[use].sum())
        chosen.append((use, telling(p, n_p, u, n_u, most, min(least_df, n_p))))
        shown[chosen[-1][1]] = True
    label, at, feature, value = vectors(sample, word_parts, BITS, weight, shown)
    forget(sample)
    part, y = np.array(label, np.int64) % FOLDS, np.array(label, np.int64) >= FOLDS
    out = []
    for use, features in chosen:
        rows = np.flatnonzero(np.isin(part, use))
        rows = rows[np.lexsort((value[np.minimum(at[rows], len(value) - 1)] if len(value) else rows, np.diff(at)[rows], y[rows]))]  # in one order whatever the tasks' order
        place = np.full(1 << BITS, -1)
        place[features] = np.arange(len(features))
        a, f, v = flagged(*take(at, feature, value, rows), place >= 0)
        w, bias = nnpu((a, place[f], v), y[rows], prior)
        full = np.zeros(1 << BITS, np.float32)
        full[features[: len(w)]] = w[: len(features)]
        out.append((full, bias))
    return weight, out


def folds(texts: pa.Array) -> np.ndarray:
    """The fold of each text, as xxhash64 gives it in SQL."""
    return np.array([np.int64(np.uint64(xxhash.xxh64_intdigest(t or "", seed=42))) % FOLDS for t in texts.to_pylist()], np.int64)


def _scores(texts: pa.Array, model) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    weight, members = model
    counted = word_parts(texts, BITS)
    some = np.diff(counted[0]) > 0
    at, feature, value = flagged(*tfidf(counted, weight), np.any([w != 0 for w, _ in members], axis=0))
    z = products(at, feature, value, np.stack([w for w, _ in members], 1)) + np.array([b for _, b in members])
    return np.where(some, sigmoid(z[np.arange(len(texts)), folds(texts)]), 0.0)


def score(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> DataFrame:
    """(doc_id, score, toxic) of every document."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(train(docs, labels, prior))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                s = _scores(part.column("text"), shared.value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), pa.array(s > 0.5)], ["doc_id", "score", "toxic"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, OUT)


def drop_toxic(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> DataFrame:
    """The documents that aren't toxic, with all their columns, in one pass and with no shuffle."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(train(docs, labels, prior))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield part.filter(pa.array(_scores(part.column("text"), shared.value) <= 0.5))

    return docs.mapInArrow(run, docs.schema)
