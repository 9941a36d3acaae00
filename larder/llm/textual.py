"""Vectorised text kernels over Arrow string columns: words, their hashes and n-grams, without a Python object a word.

A word is a maximal run of letters, digits, marks and underscores, lower-cased. Hashes are 64 bits wide and depend on the
word's bytes alone, so they agree between workers and runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

WORD = regex.compile(r"[\p{L}\p{N}\p{M}_]+")
_OTHER = r"[^\p{L}\p{N}\p{M}_\x00-\x7f]+"
_WINDOW = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_IS_WORD = np.zeros(256, bool)
for _c in range(256):
    _IS_WORD[_c] = _c >= 128 or chr(_c).isalnum() or _c == 95
_ODD = np.zeros(256, bool)
_ODD[[0xC2, *range(0xCA, 0x100)]] = True
_IS_WORD_T, _ODD_T = _IS_WORD.tobytes(), _ODD.tobytes()
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(n, _WINDOW + 4096)
        for k, base in (("p", _P), ("i", _P_INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[k] = np.cumprod(a, dtype=np.uint64)
    return _powers["p"], _powers["i"]


def _flags(raw: np.ndarray, table: bytes) -> np.ndarray:
    return np.frombuffer(raw.tobytes().translate(table), bool)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lowered(texts: pa.Array) -> pa.Array:
    """Lower-cased texts with each run of non-ASCII characters that are in no word turned into a space; null as empty.

    Only texts with a character outside ASCII and the Latin letters U+00C0 to U+027F go through the pattern.
    """
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    raw, at = bytes_of(texts)
    odd = np.flatnonzero(_flags(raw, _ODD_T))
    times = np.flatnonzero(raw == 0xC3)
    times = times[np.isin(raw[np.minimum(times + 1, len(raw) - 1)], (0x97, 0xB7))]
    rows = np.unique(np.searchsorted(at, np.concatenate([odd, times]), "right") - 1)
    if not len(rows):
        return texts
    mask = np.zeros(len(texts), bool)
    mask[rows] = True
    return pc.replace_with_mask(texts, pa.array(mask), pc.replace_substring_regex(texts.take(pa.array(rows)), _OTHER, " "))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string column and where each text starts, with the end last."""
    _, off, data = texts.buffers()
    at = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the index of its first word, with the total last."""
    raw, at = bytes_of(lowered(texts))
    n, found, where, lo = len(raw), [], [], 0
    while lo < n:
        hi = min(lo + _WINDOW, n)
        if hi < n:  # end on a byte that is in no word, or on a text's end
            gap = np.flatnonzero(~_flags(raw[lo:hi], _IS_WORD_T))
            edge = at[np.searchsorted(at, hi, "right") - 1]
            hi = max(lo + int(gap[-1]) + 1 if len(gap) else lo, int(edge))
            if hi <= lo:  # one word longer than the window
                step, hi = _WINDOW, lo + _WINDOW
                stop = int(at[np.searchsorted(at, lo, "right")])
                while hi < stop and not (g := np.flatnonzero(~_flags(raw[hi : hi + step], _IS_WORD_T))).size:
                    hi += step
                hi = min(hi + int(g[0]) + 1, stop) if hi < stop else stop
        part = raw[lo:hi]
        inside = _flags(part, _IS_WORD_T)
        first = np.zeros(hi - lo + 1, bool)
        first[at[np.searchsorted(at, lo) : np.searchsorted(at, hi, "right")] - lo] = True
        start = inside.copy()
        start[1:] &= ~inside[:-1] | first[1:-1]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | first[1:-1]
        s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
        p, inv = powers(hi - lo)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * p[: hi - lo], out=total[1:])
        found.append(mix((total[e] - total[s]) * inv[s]))
        where.append(s + lo)
        lo = hi
    if not found:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    return np.concatenate(found), np.searchsorted(np.concatenate(where), at)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive hash of each n words that start at an index; the last n-1 indexes have none."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    k = len(words) - n + 1
    out = np.zeros(k, np.uint64)
    for j in range(n):
        out = out * _P + words[j : j + k]
    return mix(out)


def slices(batch: pa.RecordBatch | pa.Table, column: str, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `limit` bytes of text each, so that working memory doesn't follow the batch's size."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(size, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted values without repeats."""
    if len(values) < 2:
        return values
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])]
