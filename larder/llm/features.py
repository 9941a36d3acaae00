"""Hashed TF-IDF features: counts of words or of character n-grams, with document frequencies over the whole corpus."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.textual import bytes_of, lowered, mix, slices, word_hashes
from larder.runtime import ship

SLICE = 1 << 19  # bytes of text whose n-grams are held at once
Sparse = tuple[np.ndarray, np.ndarray, np.ndarray]  # first entry of each text (the end last), features, counts
_LETTER = np.zeros(0x110000, bool)


def _letters() -> np.ndarray:
    if not _LETTER[97]:
        _LETTER[[c for c in range(0x30000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]] = True
    return _LETTER


def _counted(text: np.ndarray, feature: np.ndarray, n: int, bits: int) -> Sparse:
    keys = np.sort((text.astype(np.int64) << bits) | feature)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    rows = keys[first] >> bits
    return np.searchsorted(rows, np.arange(n + 1)), keys[first] & ((1 << bits) - 1), np.diff(np.append(first, len(keys)))


def words(texts: pa.Array, bits: int) -> Sparse:
    h, at = word_hashes(texts)
    return _counted(np.repeat(np.arange(len(texts)), np.diff(at)), (h >> np.uint64(64 - bits)).astype(np.int64), len(texts), bits)


def characters(texts: pa.Array, bits: int, orders: tuple[int, ...] = (1, 2, 3)) -> Sparse:
    """n-grams of lower-cased letters, each run of anything else being one space."""
    raw, at = bytes_of(lowered(texts))
    code = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begin = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[at]
    row = np.repeat(np.arange(len(texts)), np.diff(begin))
    code = np.where(_letters()[code], code, np.uint32(32)).astype(np.uint64)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32) | (row[1:] != row[:-1])
    code, row = code[keep], row[keep]
    texts_, features = [], []
    for k in orders:
        m = len(code) - k + 1
        if m <= 0:
            continue
        h = np.full(m, k, np.uint64)
        for j in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + code[j : j + m]
        inside = row[:m] == row[k - 1 :]
        if k == 1:
            inside &= code != 32
        texts_.append(row[:m][inside])
        features.append((mix(h[inside]) >> np.uint64(64 - bits)).astype(np.int64))
    none = np.zeros(0, np.int64)
    return _counted(np.concatenate([none, *texts_]), np.concatenate([none, *features]), len(texts), bits)


def word_parts(texts: pa.Array, bits: int, orders: tuple[int, ...] = (4, 5)) -> Sparse:
    """Words, and the n-grams inside words, a word's edges being shown by a space."""
    raw, at = bytes_of(lowered(texts))
    code = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begin = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[at]
    row = np.repeat(np.arange(len(texts)), np.diff(begin))
    code = np.where(_letters()[code], code, np.uint32(32)).astype(np.uint64)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32) | (row[1:] != row[:-1])
    code, row = code[keep], row[keep]
    gaps = np.concatenate([[0], np.cumsum(code == 32)])
    h, first = word_hashes(texts)
    texts_, features = [np.repeat(np.arange(len(texts)), np.diff(first))], [(h >> np.uint64(64 - bits)).astype(np.int64)]
    for k in orders:
        m = len(code) - k + 1
        if m <= 0:
            continue
        h = np.full(m, k, np.uint64)
        for j in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + code[j : j + m]
        inside = (row[:m] == row[k - 1 :]) & (gaps[k - 1 : k - 1 + m] == gaps[1 : 1 + m])
        texts_.append(row[:m][inside])
        features.append((mix(h[inside]) >> np.uint64(64 - bits)).astype(np.int64))
    return _counted(np.concatenate(texts_), np.concatenate(features), len(texts), bits)


def label_frequencies(rows: DataFrame, kind: Callable[[pa.Array, int], Sparse], bits: int, labels: int) -> tuple[np.ndarray, np.ndarray]:
    """(labels, features) counts of the texts of each label that have each feature, and the texts of each label."""

    def run(batches):
        df, n = np.zeros((labels, 1 << bits), np.int64), np.zeros(labels, np.int64)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                label = part.column("label").to_numpy().astype(np.int64)
                at, feature, _ = kind(part.column("text"), bits)
                df += np.bincount((np.repeat(label, np.diff(at)) << bits) | feature, minlength=labels << bits).reshape(labels, -1)
                n += np.bincount(label, minlength=labels)
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([hit, -1 - np.arange(labels)])), pa.array(np.concatenate([df.ravel()[hit], n]))], ["key", "n"])

    got = rows.select("label", "text").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # labels x 2^bits rows at most
    key, n = got.column("key").to_numpy(), got.column("n").to_numpy()
    df, total = np.zeros(labels << bits, np.int64), np.zeros(labels, np.int64)
    df[key[key >= 0]], total[-1 - key[key < 0]] = n[key >= 0], n[key < 0]
    return df.reshape(labels, -1), total


def telling(p: np.ndarray, n_p: int, u: np.ndarray, n_u: int, most: int, least_df: int) -> np.ndarray:
    """The features that tell the first kind of texts most from the second, by likelihood ratio, commoner among the first."""
    a, b = (p + 0.5) / (n_p + 1), (u + 0.5) / (n_u + 1)
    g = n_p * (a * np.log(a / b) + (1 - a) * np.log((1 - a) / (1 - b)))
    g[(a <= b) | (p < least_df)] = 0
    top = np.argsort(-g, kind="stable")[:most]
    return np.sort(top[g[top] > 0])


def document_frequencies(docs: DataFrame, kind: Callable[[pa.Array, int], Sparse], bits: int) -> tuple[np.ndarray, int]:
    """For each feature the number of texts of the whole table that have it, and the number of texts that have any."""
    ship(docs.sparkSession)

    def run(batches):
        df, n = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                at, feature, _ = kind(part.column("text"), bits)
                df += np.bincount(feature, minlength=1 << bits)
                n += int((np.diff(at) > 0).sum())
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1)), pa.array(np.append(df[hit], n))], ["feature", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).where("text <> ''").mapInArrow(run, "feature bigint, n bigint")
    got = rows.groupBy("feature").agg(F.sum("n").alias("n")).toPandas()  # 2^bits rows at most
    df, total = np.zeros(1 << bits, np.int64), 0
    for f, n in zip(got["feature"].to_numpy(), got["n"].to_numpy()):
        if f < 0:
            total = int(n)
        else:
            df[f] = n
    return df, total


def idf(df: np.ndarray, n: int) -> np.ndarray:
    return (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)


def tfidf(sparse: Sparse, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(1 + log count) x idf, each text's vector of length one."""
    at, feature, count = sparse
    value = (1 + np.log(count)).astype(np.float32) * weight[feature]
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    norm = np.sqrt(np.bincount(row, value.astype(np.float64) ** 2, len(at) - 1))
    return at, feature, (value / np.maximum(norm, 1e-12)[row]).astype(np.float32)


def products(at: np.ndarray, feature: np.ndarray, value: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Each text's vector times the weights (features, outputs)."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return np.stack([np.bincount(row, value * weights[feature, k], len(at) - 1) for k in range(weights.shape[1])], 1)


def vectors(rows: DataFrame, kind: Callable[[pa.Array, int], Sparse], bits: int, weight: np.ndarray, only: np.ndarray | None = None) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Labels and TF-IDF vectors of (label, text) rows, gathered on the driver: for samples of bounded size. With `only` (a flag for each
    feature) the others are left out of the vectors, whose length counts them."""
    shared = rows.sparkSession.sparkContext.broadcast((weight, only))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                weight, only = shared.value
                at, feature, value = tfidf(kind(part.column("text"), bits), weight)
                if only is not None:
                    at, feature, value = flagged(at, feature, value, only)
                off = pa.array(at.astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.ListArray.from_arrays(off, pa.array(feature.astype(np.int32))), pa.ListArray.from_arrays(off, pa.array(value))], ["label", "feature", "value"])

    got = rows.select("label", "text").mapInArrow(run, f"label {rows.schema['label'].dataType.simpleString()}, feature array<int>, value array<float>").toArrow()
    feature = got.column("feature").combine_chunks()
    value = got.column("value").combine_chunks()
    flat = lambda a: np.concatenate([c.flatten().to_numpy() for c in (a.chunks if isinstance(a, pa.ChunkedArray) else [a])] or [np.zeros(0)])
    size = np.concatenate([[0], np.cumsum(got.column("feature").combine_chunks().value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64) if got.num_rows else np.zeros(1, np.int64)
    return got.column("label").to_pylist(), size, flat(feature).astype(np.int64), flat(value).astype(np.float32)


def flagged(at: np.ndarray, feature: np.ndarray, value: np.ndarray, only: np.ndarray):
    """The vectors without features that aren't flagged."""
    keep = only[feature]
    return np.concatenate([[0], np.cumsum(keep)])[at], feature[keep], value[keep]


def take(at: np.ndarray, feature: np.ndarray, value: np.ndarray, rows: np.ndarray):
    """The given rows of a set of vectors."""
    size = np.diff(at)[rows]
    new = np.concatenate([[0], np.cumsum(size)])
    index = np.repeat(at[rows] - new[:-1], size) + np.arange(new[-1])
    return new, feature[index], value[index]
