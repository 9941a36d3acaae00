"""Benchmark decontamination: a broadcast hash set of the test items' word n-grams against every window of the documents.

Words are lower-cased runs of letters, digits, marks and underscores, so case, punctuation and spacing don't hide a passage.
Every window of `n` words of a document is looked up in the set; each hit is verified word by word. The passages that
verified windows cover are cut, or the document goes when they cover `drop_share` of its words or more. Items of fewer than
`n` words are sought whole; those under `least` words are ordinary phrases and are passed over. The set's size is counted:
beyond `most_grams` the items are split, each part marks the documents in a pass of its own, and a document is judged once
by the passages of all parts together, so that results don't depend on the number of parts.

Defined results: null or empty texts are clean. Each row is judged by itself, repeated rows and null doc_ids included.
An empty benchmark table leaves all documents as they are, and an empty table of documents gives an
empty result. Items without an id stand last among a document's items, as null. A cut passage leaves one space; n_chars, where the documents have
it as an integer, follows the text. Other columns, whatever their names, pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.tables import free
from larder.llm.textual import WORD, ngram_hashes, slices, word_hashes
from larder.runtime import materialize, ship

HITS = "doc_id bigint, item_ids array<bigint>, spans array<struct<start:int,stop:int>>, hit_words int, n_words int, action string, clean_text string"
_BITS = 22


def tokens(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    found = [(m.group(), m.span()) for m in WORD.finditer(text)]
    return pc.utf8_lower(pa.array([w for w, _ in found], pa.string())).to_pylist(), [s for _, s in found]


def _runs(covered: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _without(text: str, passages: list[tuple[int, int, int]]) -> str:
    for a, b, _ in reversed(passages):
        text = f"{text[:a].rstrip(' ')} {text[b:].lstrip(' ')}"
    return text


def _sorted(ids) -> list:
    return sorted(ids, key=lambda i: (i is None, i or 0))


class Grams:
    """The items' n-grams: for each length sorted hashes, the words of each gram as places in one table of words, the items of
    each, and a bit filter. Some 60 bytes a gram of eight words, and each word once."""

    def __init__(self, items: list[tuple[int, str]], n: int, least: int):
        self.words: dict[str, int] = {}
        rows: dict[int, list[np.ndarray]] = {}
        owners: dict[int, list[np.ndarray]] = {}
        for item, text in items:
            words, _ = tokens(text or "")
            size = min(n, len(words))
            if size < min(least, n):
                continue
            at = np.array([self.words.setdefault(w, len(self.words)) for w in words], np.int32)
            rows.setdefault(size, []).append(np.lib.stride_tricks.sliding_window_view(at, size))
            owners.setdefault(size, []).append(np.full(len(words) - size + 1, np.iinfo(np.int64).min if item is None else item, np.int64))
        self.word_hashes, _ = word_hashes(pa.array(list(self.words), pa.large_string()))
        self.hashes, self.filter, self.grams, self.first, self.items = {}, {}, {}, {}, {}
        for size in rows:
            gram, item = np.concatenate(rows[size]), np.concatenate(owners[size])
            h = ngram_hashes(self.word_hashes[gram].ravel(), size)[::size] if len(gram) else np.zeros(0, np.uint64)
            order = np.lexsort((item, *gram.T[::-1], h))
            gram, item, h = gram[order], item[order], h[order]
            new = np.concatenate([[True], (gram[1:] != gram[:-1]).any(1)])
            once = new | np.concatenate([[True], item[1:] != item[:-1]])
            kept = np.flatnonzero(new)
            self.grams[size], self.hashes[size], self.items[size] = gram[kept], h[kept], item[once]
            self.first[size] = np.append(np.cumsum(once)[kept] - 1, int(once.sum()))
            self.filter[size] = np.zeros(1 << _BITS, bool)
            self.filter[size][(h >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def _hits(self, h: np.ndarray, size: int) -> np.ndarray:
        """Which hashes are in the set."""
        i = np.flatnonzero(self.filter[size][(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        known = self.hashes[size]
        return i[known[np.minimum(np.searchsorted(known, h[i]), len(known) - 1)] == h[i]]

    def rows(self, texts: pa.Array) -> np.ndarray:
        """Rows with a window whose hash is in the set."""
        words, at = word_hashes(texts)
        out = []
        for size in self.hashes:
            i = self._hits(ngram_hashes(words, size), size)
            row = np.searchsorted(at, i, "right") - 1
            out.append(row[i + size <= at[row + 1]])
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)

    def covered(self, words: list[str]) -> tuple[np.ndarray, set]:
        """Which words verified windows cover, and the items they are from."""
        covered, ids = np.zeros(len(words), bool), set()
        at = np.array([self.words.get(w, -1) for w in words], np.int32)
        h = np.append(self.word_hashes, np.uint64(0))[at] if len(at) else np.zeros(0, np.uint64)
        for size, known in self.hashes.items():
            if len(at) < size:
                continue
            i = self._hits(ngram_hashes(h, size), size)
            k, window = np.searchsorted(known, h_i := ngram_hashes(h, size)[i]), np.lib.stride_tricks.sliding_window_view(at, size)[i]
            while len(i):  # grams with the same hash stand together
                same = (self.grams[size][k] == window).all(1)
                for a in i[same].tolist():
                    covered[a : a + size] = True
                for g in np.unique(k[same]).tolist():
                    ids.update(self.items[size][self.first[size][g] : self.first[size][g + 1]].tolist())
                k = k + 1
                on = ~same & (known[np.minimum(k, len(known) - 1)] == h_i) & (k < len(known))
                i, k, window, h_i = i[on], k[on], window[on], h_i[on]
        return covered, {None if x == np.iinfo(np.int64).min else x for x in ids}

    def passages(self, text: str) -> tuple[list[tuple[int, int, int]], set[int], int]:
        """Verified passages as (start, stop, words), the items they are from, and the words of the text."""
        words, spans = tokens(text)
        covered, ids = self.covered(words)
        return [(spans[a][0], spans[b - 1][1], b - a) for a, b in _runs(covered)], ids, len(words)

    def clean(self, text: str, drop_share: float):
        """What became of a text with hits: (items, passages in it, their words, all words, the new text or None), or None."""
        found, ids, n = self.passages(text)
        if not found:
            return None
        hit = sum(w for _, _, w in found)
        if hit >= drop_share * n:
            return _sorted(ids), found, hit, n, None
        new, more = text, found
        while more:  # a cut may join the halves of another passage
            new = _without(new, more)
            more = self.passages(new)[0]
        return _sorted(ids), found, hit, n, new


def _count(benchmark: DataFrame, most_grams: int) -> int:
    """Parts of about `most_grams`: one unless the benchmark table is large."""
    return max(1, -(-(benchmark.agg(F.sum(F.length("text"))).first()[0] or 0) // (4 * most_grams)))


def _parts(benchmark: DataFrame, n: int, least: int, parts: int) -> Iterator[Grams]:
    """The items' grams in parts."""
    rows = benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).where("text is not null")
    for k in range(parts):
        part = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        made = Grams([(r[0], r[1]) for r in part.toLocalIterator()], n, least)
        if made.hashes:
            yield made


_FOUND = "struct<items:array<bigint>,words:array<struct<start:int,stop:int>>,spans:array<struct<start:int,stop:int>>,hit:int,n:int,action:string,now:string,again:boolean>"


def _put(batch: pa.RecordBatch, j: int, made: dict[int, dict]) -> pa.RecordBatch:
    """The batch with other values in some rows of a column."""
    mask = np.zeros(batch.num_rows, bool)
    mask[list(made)] = True
    column = batch.column(j)
    new = pa.array([made[i] for i in sorted(made)], column.type)
    at = np.arange(batch.num_rows)
    at[mask] = batch.num_rows + np.arange(len(made))
    return batch.set_column(j, batch.schema.field(j), pa.concat_arrays([column, new]).take(pa.array(at)))


def _marked(shared, name: str):
    """Each row's covered words and items so far, with those of one part."""

    def mark(batches):
        grams = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                j = part.schema.get_field_index(name)
                state, text, made = part.column(j), part.column(part.schema.get_field_index("text")), {}
                now = pa.array([(s or {}).get("now") for s in state.to_pylist()], pa.string())
                now = pc.coalesce(now, text.cast(pa.string()))
                for i in grams.rows(now).tolist():
                    covered, ids = grams.covered(tokens(now[i].as_py())[0])
                    if ids:
                        old = state[i].as_py() or {}
                        items = old["items"] if old.get("action") else _sorted({*(old.get("items") or []), *ids})  # of the text as it was
                        made[i] = old | {"items": items, "words": [*(old.get("words") or []), *({"start": a, "stop": b} for a, b in _runs(covered))]}
                yield _put(part, j, made) if made else part

    return mark


def _judged(name: str, drop_share: float):
    """What becomes of the rows that the parts marked; a text that is cut is to be read again, as a cut may join passages."""

    def judge(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                j, texts, made = part.schema.get_field_index(name), part.column(part.schema.get_field_index("text")), {}
                for i, old in enumerate(part.column(j).to_pylist()):
                    if not old or not old["words"]:
                        if old and old["again"]:
                            made[i] = old | {"again": False}
                        continue
                    first = old.get("action") is None
                    text = texts[i].as_py() if first else old["now"]
                    _, spans = tokens(text)
                    covered = np.zeros(len(spans), bool)
                    for w in old["words"]:
                        covered[w["start"] : w["stop"]] = True
                    found = [(spans[a][0], spans[b - 1][1], b - a) for a, b in _runs(covered)]
                    if first:
                        hit = sum(w for _, _, w in found)
                        drop = hit >= drop_share * len(spans)
                        old |= {"spans": [{"start": a, "stop": b} for a, b, _ in found], "hit": hit, "n": len(spans), "action": "drop" if drop else "cut"}
                    cut = old["action"] == "cut"
                    old |= {"words": None, "now": _without(text, found) if cut else None, "again": cut}
                    made[i] = {k: old[k] for k in ("items", "words", "spans", "hit", "n", "action", "now", "again")}
                yield _put(part, j, made) if made else part

    return judge


def _by_all_parts(rows: DataFrame, name: str, benchmark: DataFrame, n: int, least: int, drop_share: float, parts: int) -> DataFrame:
    """The rows with a column of what was found (_FOUND, null where nothing was), by the items of all parts together."""
    todo, done = rows.withColumn(name, F.lit(None).cast(_FOUND)), None
    while True:
        for grams in _parts(benchmark, n, least, parts):
            shared = rows.sparkSession.sparkContext.broadcast(grams)
            todo = materialize(todo.mapInArrow(_marked(shared, name), todo.schema), "marked")
            shared.destroy()
        todo = materialize(todo.mapInArrow(_judged(name, drop_share), todo.schema), "judged")
        again = F.coalesce(F.col(name)["again"], F.lit(False))
        ready = todo.where(~again)
        done, todo = ready if done is None else done.union(ready), todo.where(again)
        if todo.isEmpty():
            return done


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 8, least: int = 5, drop_share: float = 0.5, most_grams: int = 5_000_000) -> DataFrame:
    """One row (HITS) for each document with a verified hit."""
    spark = docs.sparkSession
    ship(spark)
    rows, out = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null"), None
    parts = _count(benchmark, most_grams)
    if parts > 1:
        found = _by_all_parts(rows, "found", benchmark, n, least, drop_share, parts).where("found.action is not null")
        return found.selectExpr("doc_id", "found.items as item_ids", "found.spans as spans", "found.hit as hit_words", "found.n as n_words", "found.action as action", "found.now as clean_text")
    for grams in _parts(benchmark, n, least, parts):
        shared = spark.sparkContext.broadcast(grams)

        def find(batches, shared=shared):
            grams = shared.value
            schema = pa.schema([("doc_id", pa.int64()), ("item_ids", pa.list_(pa.int64())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("hit_words", pa.int32()), ("n_words", pa.int32()), ("action", pa.string()), ("clean_text", pa.string())])
            for batch in batches:
                for part in slices(batch, "text"):
                    found = []
                    for i in grams.rows(part.column("text")).tolist():
                        if made := grams.clean(part.column("text")[i].as_py(), drop_share):
                            ids, spans, hit, words, new = made
                            found.append((part.column("doc_id")[i].as_py(), ids, [{"start": a, "stop": b} for a, b, _ in spans], hit, words, "drop" if new is None else "cut", new))
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, f)) for f in found], schema)

        out = rows.mapInArrow(find, HITS)
    return out if out is not None else rows.sparkSession.createDataFrame([], HITS)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 8, least: int = 5, drop_share: float = 0.5, most_grams: int = 5_000_000) -> DataFrame:
    """The documents without the benchmark's passages, with no shuffle; in one pass unless the benchmark is in parts."""
    spark, out = docs.sparkSession, docs
    ship(spark)
    counted = [f.name for f in docs.schema if f.name == "n_chars" and isinstance(f.dataType, (T.IntegerType, T.LongType))]
    parts = _count(benchmark, most_grams)
    if parts > 1:
        (name,) = free(docs, "__larder_found")
        rows = _by_all_parts(docs, name, benchmark, n, least, drop_share, parts)
        cut = F.col(name)["action"].eqNullSafe("cut")
        now = {"text": F.col(name)["now"]} | {c: F.length(F.col(name)["now"]) for c in counted}
        kept = rows.where(~F.col(name)["action"].eqNullSafe("drop"))
        return kept.select(*(F.when(cut, now[f.name]).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name) if f.name in now else F.col(f"`{f.name}`") for f in docs.schema))
    for grams in _parts(benchmark, n, least, parts):
        shared = spark.sparkContext.broadcast(grams)

        def keep(batches, shared=shared):
            grams = shared.value
            for batch in batches:
                for part in slices(batch, "text"):
                    rows = grams.rows(part.column("text")).tolist()
                    made = {i: m[-1] for i in rows if (m := grams.clean(part.column("text")[i].as_py(), drop_share))}
                    if not made:
                        yield part
                        continue
                    mask = np.zeros(part.num_rows, bool)
                    mask[list(made)] = True
                    for name, f in [("text", lambda t: t or ""), *((c, lambda t: len(t or "")) for c in counted)]:
                        j = part.schema.get_field_index(name)
                        new = pa.array([f(made[i]) for i in sorted(made)], part.column(j).type)
                        part = part.set_column(j, part.schema.field(j), pc.replace_with_mask(part.column(j), pa.array(mask), new))
                    keep = np.ones(part.num_rows, bool)
                    keep[[i for i, t in made.items() if t is None]] = False
                    yield part.filter(pa.array(keep))

        out = out.mapInArrow(keep, out.schema)
    return out
