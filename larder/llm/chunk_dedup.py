"""Repeated passages: content-defined chunks by a gear rolling hash, deduplicated by digest.

A gear hash rolls over the UTF-8 bytes; a chunk ends after a word where the hash of the last 16 bytes is less than after any of
the `REACH` words before, and not more than after any of the `REACH` words behind. In a run of more than `LONG` bytes without white space, as in scripts that have none and in
encoded or minified text, a chunk may end after any character where the hash says so and no such place is among the 17
bytes before; such a run counts as a word for each `UNIT` bytes. All of this depends on nearby bytes alone, so an insertion moves only the
chunks around it. A chunk of more than `MOST` bytes, which only monotonous text has, is cut at every `MOST` bytes from its start.
Chunks are grouped by a 128-bit digest; a chunk that occurs in several documents stays in the one with the least doc_id.
Neighbouring chunks that go make one passage, and passages of fewer than `min_words` words stay. A shared passage of w words
loses about its first and last half dozen words to the chunks that reach over its edges.

Defined results: null doc_ids and null or empty texts have no passages. Rows that share a doc_id are one document, and repeats
within a document stay. Offsets count characters. Texts of any length are read whole. Other columns, whatever
their names, aren't looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.tables import fit, free, hashed
from larder.llm.textual import bytes_of, slices
from larder.runtime import materialize, ship

GAP, REACH, MOST = 3, 5, 4096
LONG, UNIT = 48, 6
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 16, 256, np.uint16)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32]).tobytes()
CHUNKS = "d0 bigint, d1 bigint, doc_id bigint, place bigint"


def gear(raw: np.ndarray) -> np.ndarray:
    """The 16-bit gear hash after each byte: h = 2 h + gear[byte], of which the last 16 bytes remain."""
    h = _GEAR[raw]
    for s in (1, 2, 4, 8):
        more = h.copy()
        more[s:] += h[:-s] << np.uint16(s)
        h = more
    return h


def bounds(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end byte and words of each chunk of texts that start at `at` (the end last)."""
    space = np.frombuffer(raw.tobytes().translate(_SPACE), bool)
    last = np.zeros(len(raw), bool)
    last[at[1:][at[1:] > at[:-1]] - 1] = True
    end = ~space
    end[:-1] &= space[1:] | last[:-1]
    ends = np.flatnonzero(end)  # of words: their last bytes
    begin = ~space
    begin[1:] &= space[:-1] | last[:-1]
    begins = np.flatnonzero(begin)
    row = np.searchsorted(at, ends, "right") - 1
    hashes = gear(raw)
    h = hashes[ends].astype(np.int32)
    h[(ends - at[row] < 15) | last[ends]] = 1 << 16  # no whole window, or nothing follows
    least = h < 1 << 16
    for s in range(1, REACH + 1):
        apart = row[s:] != row[:-s]
        least[s:] &= (h[s:] < h[:-s]) | apart
        least[:-s] &= (h[:-s] <= h[s:]) | apart
    cuts = ends[least] + 2  # the white space after the word belongs to the chunk
    run = np.flatnonzero(ends - begins >= LONG)
    inside = [_inside(raw, hashes, begins[i], ends[i]) for i in run.tolist()]
    edge = np.unique(np.concatenate([at, cuts, *inside]))
    long = np.flatnonzero(np.diff(edge) > MOST)
    if len(long):
        more = np.concatenate([np.arange(edge[i] + MOST, edge[i + 1], MOST) for i in long])
        for _ in range(3):  # on to the start of a character
            more = more + ((raw[np.minimum(more, len(raw) - 1)] & 0xC0) == 0x80)
        edge = np.unique(np.concatenate([edge, np.minimum(more, len(raw))]))
    words = np.diff(np.searchsorted(np.delete(ends, run), edge))
    if len(run):
        first, size = begins[run], ends[run] - begins[run] + 1
        before = np.concatenate([[0], np.cumsum(size)])
        j = np.searchsorted(first, edge, "right")
        part = np.where(j > 0, np.minimum(edge - first[j - 1], size[j - 1]) - size[j - 1], 0)
        words = words + np.diff(before[j] + part) // UNIT
    return edge[:-1], edge[1:], words


def _inside(raw: np.ndarray, hashes: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Where chunks start inside a run without white space, begin and end being its first and last byte."""
    p = np.flatnonzero(hashes[begin + 15 : end] < 1 << 12) + begin + 16
    p = p[(raw[p] & 0xC0) != 0x80]
    return p[np.concatenate([[True], np.diff(p) >= GAP * UNIT])] if len(p) else p


def _chunk(batches):
    schema = pa.schema([(c, pa.int64()) for c in ("d0", "d1", "doc_id", "place")])
    for batch in batches:
        for part in slices(batch, "text"):
            raw, at = bytes_of(part.column("text").cast(pa.large_string()))
            if not len(raw):
                continue
            a, b, words = bounds(raw, at)
            keep = words >= GAP
            a, b, words = a[keep], b[keep], words[keep]
            view, digest = memoryview(raw), xxhash.xxh3_128_digest
            d = np.frombuffer(b"".join([digest(view[x:y]) for x, y in zip(a.tolist(), b.tolist())]), np.int64).reshape(-1, 2)
            chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            row = np.searchsorted(at, a, "right") - 1
            start, size = chars[a] - chars[at[row]], chars[b] - chars[a]
            ids = part.column("doc_id").take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), ids, pa.array((start << 32) | (np.minimum(words, 65535) << 16) | size)], schema=schema)


def chunks(docs: DataFrame) -> DataFrame:
    """(d0, d1, doc_id, place) of each chunk of GAP words or more; place packs start, words and length."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.where("doc_id is not null and text is not null").mapInArrow(_chunk, CHUNKS)


def repeated_passages(docs: DataFrame, min_words: int = 16) -> DataFrame:
    """(doc_id, start, stop, n_words, kept_ids): each passage that goes, and the documents in which its chunks stay."""
    all_ = materialize(chunks(docs), "chunks")
    shared = all_.groupBy("d0", "d1").agg(F.min("doc_id").alias("kept"), F.max("doc_id").alias("most")).where("kept <> most")
    shared = materialize(shared.select("d0", "d1", "kept"), "shared-chunks")
    gone = all_.join(hashed(shared, 24), ["d0", "d1"]).where("doc_id <> kept")
    start, words = F.shiftright("place", 32), F.shiftright("place", 16).bitwiseAND(65535)
    gone = gone.select("doc_id", "kept", start.alias("start"), (start + F.col("place").bitwiseAND(65535)).alias("stop"), words.alias("words"))
    by = Window.partitionBy("doc_id").orderBy("start", "stop")
    before = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    gone = gone.withColumn("before", before)
    gone = gone.withColumn("run", F.sum(F.when(F.col("before") >= F.col("start"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    new = F.when(F.col("before") > F.col("start"), 0).otherwise(F.col("words"))
    runs = gone.groupBy("doc_id", "run").agg(F.min("start").cast("int").alias("start"), F.max("stop").cast("int").alias("stop"), F.sum(new).cast("int").alias("n_words"), F.sort_array(F.collect_set("kept")).alias("kept_ids"))
    return runs.where(F.col("n_words") >= min_words).drop("run")


def drop_passages(docs: DataFrame, min_words: int = 16) -> DataFrame:
    """The documents without the passages that stay elsewhere, with all their columns; n_chars follows an altered text."""
    (of, name), columns = free(docs, "__larder_id", "__larder_spans"), docs.columns
    spans = repeated_passages(docs, min_words).groupBy(F.col("doc_id").alias(of)).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias(name))
    spans = materialize(spans, "passages")
    counted = [f.name for f in docs.schema if f.name == "n_chars" and isinstance(f.dataType, (T.IntegerType, T.LongType))]

    def cut(batches):
        for batch in batches:
            j = batch.schema.get_field_index("text")
            spans = batch.column(batch.schema.get_field_index(name))
            mask = pc.is_valid(spans)
            made = []
            for text, holes in zip(batch.column(j).filter(mask).to_pylist(), spans.filter(mask).to_pylist()):
                at, kept = 0, []
                for h in holes:
                    kept.append(text[at : h["start"]])
                    at = max(at, h["stop"])
                made.append("".join([*kept, text[at:]]))
            for c, new in [("text", made), *((c, [len(t) for t in made]) for c in counted)]:
                k = batch.schema.get_field_index(c)
                batch = batch.set_column(k, batch.schema.field(k), pc.replace_with_mask(batch.column(k), mask, pa.array(new, batch.column(k).type)))
            yield batch.select(columns)

    joined = docs.join(fit(spans, 64), F.col("doc_id").cast("bigint") == F.col(of), "left").drop(of)
    return joined.mapInArrow(cut, docs.schema)
