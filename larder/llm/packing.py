"""Packing into windows of equal length by non-negative least squares.

Each document is its token count, by a public byte-level BPE whose vocabulary file is a parameter, and one end token. A document longer than a
window is cut into whole windows and a rest. Lengths fall into `units` bins, each a piece's length rounded up; combinations of at
most `depth` bins that fill a window exactly are enumerated, and non-negative least squares finds how often to repeat each so that
together they use up the histogram of all pieces. Repeats are rounded down and held to what there is; pieces take their
places by rank within their bin, ranks coming from counts by shard, so that no task holds a bin. What is left over is packed
greedily, best fit by falling length, in shards.

Defined results: null or empty texts have no tokens and aren't packed. Each row is packed by itself, repeated rows and null doc_ids included. Every
other token is in exactly one window, and no window holds more than `window` tokens. Other columns, whatever their names, aren't
looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.tables import fit
from larder.llm.textual import slices
from larder.runtime import materialize, ship

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def ranks_of(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every row with a text."""
    spark = docs.sparkSession
    ship(spark)
    with open(vocabulary, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())

    def run(batches):
        import tiktoken

        encode = tiktoken.Encoding("larder", pat_str=PATTERN, mergeable_ranks=ranks_of(raw.value), special_tokens={}).encode_ordinary
        for batch in batches:
            for part in slices(batch, "text"):
                n = [len(encode(t)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.where("text <> ''").mapInArrow(run, "doc_id bigint, n_tokens bigint")


def combinations(units: int, depth: int) -> list[tuple[int, ...]]:
    """Falling tuples of at most `depth` bins that add up to `units`."""
    out: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], left: int) -> None:
        if left == 0:
            out.append(head)
        elif len(head) < depth:
            top = min(left, head[-1] if head else units)
            least = -(-left // (depth - len(head)))
            for k in range(top, least - 1, -1):
                grow((*head, k), left - k)

    grow((), units)
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Non-negative least squares by active sets (Lawson and Hanson, 1974)."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    edge = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        w[passive] = -np.inf
        j = int(w.argmax())
        if w[j] <= edge:
            break
        passive[j] = True
        while True:
            at = np.flatnonzero(passive)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            low = z <= 0
            step = (x[at][low] / np.maximum(x[at][low] - z[low], 1e-300)).min()
            x[at] += step * (z - x[at])
            passive[at[x[at] <= 1e-12 * max(1.0, x.max())]] = False
            x[~passive] = 0
            if not passive.any():
                break
    return x


def solve(histogram: np.ndarray, units: int, depth: int) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats) that the histogram (index: bin, of 0 to units) can supply."""
    left = histogram.astype(np.int64).copy()
    if not left.any():
        return []
    combos = [c for c in combinations(units, depth) if all(left[k] >= c.count(k) for k in c)]
    if not combos:
        return []
    a = np.zeros((units + 1, len(combos)))
    for j, c in enumerate(combos):
        for k in c:
            a[k, j] += 1
    scale = float(left.max())
    x = nnls(a, left / scale) * scale
    out = []
    for j in np.argsort(-x, kind="stable"):
        if x[j] < 1 - 1e-6:
            break
        used = a[:, j].astype(np.int64)
        n = min(int(np.floor(x[j] + 1e-6)), *(int(left[k] // used[k]) for k in set(combos[j])))
        if n > 0:
            left -= used * n
            out.append((combos[j], n))
    return out


def greedy(lengths: np.ndarray, window: int) -> np.ndarray:
    """Window number of each piece by best fit, longest first."""
    out, room, free, n = np.zeros(len(lengths), np.int64), [[] for _ in range(window + 1)], 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = free >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            k = room[r].pop()
            if not room[r]:
                free &= ~(1 << r)
        else:
            r, k, n = window, n, n + 1
        out[i] = k
        if r > size:
            room[r - size].append(k)
            free |= 1 << (r - size)
    return out


def pack(docs: DataFrame, window: int = 2048, units: int = 128, depth: int = 4, vocabulary: str = VOCABULARY, shard_rows: int = 50_000) -> DataFrame:
    """(window_id, n_tokens, n_pieces, doc_ids, segments): one row for each window; a segment is a document's tokens from start on."""
    spark = docs.sparkSession
    unit = window // units
    counts = token_counts(docs, vocabulary).select("doc_id", (F.col("n_tokens") + 1).alias("n"))
    start = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(window).cast("bigint")))
    length = F.least(F.col("n") - F.col("start"), F.lit(window)).cast("int")
    pieces = counts.select("doc_id", "n", start.alias("start")).select("doc_id", "start", length.alias("length"))
    pieces = materialize(pieces.withColumn("bin", F.ceil(F.col("length") / unit).cast("int")), "pieces")
    histogram = np.zeros(units + 1, np.int64)
    for k, n in pieces.groupBy("bin").count().collect():  # `units` rows at most
        histogram[k] = n
    slots, windows = [], 0
    taken = np.zeros(units + 1, np.int64)
    for combo, n in solve(histogram, units, depth):
        for k in sorted(set(combo)):
            m = combo.count(k)
            slots.append((k, int(taken[k]), int(taken[k] + n * m), windows, m))
            taken[k] += n * m
        windows += n
    total = int(histogram.sum())
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // 1_000_000))
    sharded = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start"), F.lit(shards)).cast("int"))
    sums = sharded.groupBy("bin", "shard").count()
    before = Window.partitionBy("bin").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(sums.select("bin", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset")), "offsets")
    within = F.row_number().over(Window.partitionBy("bin", "shard").orderBy("doc_id", "start", "length"))
    ranked = sharded.withColumn("rank", within - 1).join(fit(offsets, 24), ["bin", "shard"]).withColumn("rank", F.col("rank") + F.col("offset"))
    table = F.broadcast(spark.createDataFrame(slots, "b int, lo bigint, hi bigint, base bigint, m int"))  # at most units x depth rows
    placed = ranked.join(table, (F.col("bin") == F.col("b")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")), "left")
    placed = placed.select("doc_id", "start", "length", (F.col("base") + F.floor((F.col("rank") - F.col("lo")) / F.col("m"))).alias("window_id"))
    placed = materialize(placed, "placed")
    left = total - int(taken.sum())
    groups = max(1, -(-left // shard_rows))

    def rest(table):
        k = table.column("shard")[0].as_py()
        at = greedy(table.column("length").to_numpy(), window) + windows + (k << 32)
        return pa.table({**{c: table.column(c) for c in ("doc_id", "start", "length")}, "window_id": pa.array(at)})

    residual = placed.where("window_id is null").withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "length"), F.lit(groups).cast("bigint")))
    residual = residual.select("doc_id", "start", "length", "shard").groupBy("shard").applyInArrow(rest, "doc_id bigint, start bigint, length int, window_id bigint")
    every = placed.where("window_id is not null").unionByName(residual)
    made = every.groupBy("window_id").agg(F.sum("length").cast("int").alias("n_tokens"), F.count("*").cast("int").alias("n_pieces"), F.sort_array(F.collect_list(F.struct("doc_id", "start", "length"))).alias("segments"))
    return made.select("window_id", "n_tokens", "n_pieces", F.col("segments.doc_id").alias("doc_ids"), "segments")
