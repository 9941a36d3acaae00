"""Exact duplicates: a minimal perfect hash over the digests that history holds.

History is the rows up to a doc_id (by default the lower half of the ids' range); the rest arrive. The distinct digests of
history are spread over shards by their first bytes, and each shard gets a minimal perfect hash of levels of bits
(as BBHash, Limasset et al., 2017) whose slots hold the whole digest and the locator (doc_id) of the row that stays. An
arriving distinct digest is looked up once in its shard's slot and compared byte for byte: a member is a repeat of the slot's winner. Digests
that aren't members are grouped among themselves, and the least doc_id of each stays.

Defined results: texts are equal when their bytes are (SHA-256 of UTF-8); an empty text equals an empty text; a null text
equals nothing, and such rows stay. Of equal texts the least doc_id stays; a null doc_id comes after every other. Of rows
with the same doc_id and text one stays. Other columns, whatever their names, aren't looked at. An empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.tables import fit, free
from larder.llm.textual import mix
from larder.runtime import materialize, ship

_GAMMA, _LEVELS = 2.0, 48


class PerfectHash:
    """Minimal perfect hash of distinct 32-byte digests: level after level, keys alone on a bit take it; the rank of its bit
    is a key's slot. Keys left after the last level, if ever any, are searched in a sorted tail."""

    def __init__(self, levels: list[np.ndarray], base: list[int], tail: np.ndarray):
        self.levels, self.base, self.tail = levels, base, tail
        self.ranks = [np.concatenate([[0], np.cumsum(np.bitwise_count(w), dtype=np.int64)]) for w in levels]

    @staticmethod
    def keys(digests: np.ndarray) -> np.ndarray:
        """(n, 32) bytes to (n, 4) words."""
        return np.ascontiguousarray(digests).view(np.uint64).reshape(-1, 4)

    @staticmethod
    def place(words: np.ndarray, level: int, bits: int) -> np.ndarray:
        salt = np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        h = mix((words[:, level % 4] ^ salt) + words[:, (level + 1) % 4])
        return (h % np.uint64(bits)).astype(np.int64)

    @classmethod
    def build(cls, words: np.ndarray) -> PerfectHash:
        left, levels, base, n = words, [], [], 0
        while len(left) and len(levels) < _LEVELS:
            bits = (max(64, int(len(left) * _GAMMA)) + 63) // 64 * 64
            at = cls.place(left, len(levels), bits)
            alone = np.bincount(at, minlength=bits) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            base.append(n)
            n += int(alone.sum())
            left = left[~alone[at]]
        tail = left[np.lexsort(left.T[::-1])] if len(left) else left
        return cls(levels, [*base, n], tail)

    def slots(self, words: np.ndarray) -> np.ndarray:
        """The slot of each key; any slot or -1 for what was no key."""
        out, left = np.full(len(words), -1, np.int64), np.arange(len(words))
        for k, level in enumerate(self.levels):
            if not len(left):
                return out
            at = self.place(words[left], k, len(level) * 64)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = ((level[word] >> bit) & np.uint64(1)).astype(bool)
            below = np.bitwise_count(level[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[left[hit]] = self.base[k] + self.ranks[k][word[hit]] + below
            left = left[~hit]
        if len(self.tail):
            places = {w.tobytes(): i for i, w in enumerate(self.tail)}
            for i in left:
                out[i] = self.base[-1] + places[b] if (b := words[i].tobytes()) in places else -1
        return out

    def arrays(self) -> dict:
        return {"levels": [w.tobytes() for w in self.levels], "base": self.base, "tail": self.tail.tobytes()}

    @classmethod
    def of(cls, levels, base, tail) -> PerfectHash:
        return cls([np.frombuffer(w, np.uint64) for w in levels], base, np.frombuffer(tail, np.uint64).reshape(-1, 4))


FOUND = "digest binary, least bigint, n_rows bigint, winner bigint, member boolean"
INDEX = "shard bigint, levels array<binary>, base array<bigint>, tail binary, digests binary, winners array<bigint>"


def _words(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    raw = column.cast(pa.binary(32)) if not pa.types.is_fixed_size_binary(column.type) else column
    data = np.frombuffer(raw.buffers()[1], np.uint8)[raw.offset * 32 : (raw.offset + len(raw)) * 32] if len(raw) else np.zeros(0, np.uint8)
    return PerfectHash.keys(data.reshape(-1, 32))


def _index(table: pa.Table) -> pa.Table:
    """One shard's index of its distinct digests (shard, digest, winner)."""
    words = _words(table.column("digest"))
    made = PerfectHash.build(words)
    slot = made.slots(words)
    digests, winners = np.zeros_like(words), np.zeros(len(words), np.int64)
    digests[slot] = words
    winners[slot] = table.column("winner").to_numpy()
    a = made.arrays()
    row = {"shard": table.column("shard")[0].as_py(), **a, "digests": digests.tobytes(), "winners": winners.tolist()}
    schema = pa.schema([("shard", pa.int64()), ("levels", pa.list_(pa.binary())), ("base", pa.list_(pa.int64())), ("tail", pa.binary()), ("digests", pa.binary()), ("winners", pa.list_(pa.int64()))])
    return pa.Table.from_pylist([row], schema)


def _lookup(index: pa.Table, asked: pa.Table) -> pa.Table:
    """The asked distinct digests of a shard with the winner that history has for each."""
    words = _words(asked.column("digest"))
    winner, member = np.zeros(len(words), np.int64), np.zeros(len(words), bool)
    if index.num_rows and len(words):
        r = index.slice(0, 1)
        levels, base, tail = (r.column(c)[0].as_py() for c in ("levels", "base", "tail"))
        held = np.frombuffer(r.column("digests")[0].as_py(), np.uint64).reshape(-1, 4)
        slot = PerfectHash.of(levels, base, tail).slots(words)
        inside = (slot >= 0) & (slot < len(held))
        member[inside] = (held[slot[inside]] == words[inside]).all(1)  # byte check: a nonmember may land on any slot
        winner[member] = r.column("winners").combine_chunks().values.to_numpy()[slot[member]]
    out = {c: asked.column(c) for c in ("digest", "least", "n_rows")}
    return pa.table({**out, "winner": pa.array(winner, mask=~member), "member": pa.array(member)})


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """Index rows (INDEX), one a shard, of (digest, winner) rows with distinct digests."""
    keyed = history.select(shard_of(shards).alias("shard"), "digest", "winner")
    return keyed.groupBy("shard").applyInArrow(_index, INDEX)


def shard_of(shards: int):
    return F.pmod(F.xxhash64("digest"), F.lit(shards).cast("bigint"))


def digests(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.sha2(F.col("text").cast("string"), 256)).alias("digest")).where("digest is not null")


def lookups(docs: DataFrame, history_until: int | None = None, shard_rows: int = 500_000) -> DataFrame:
    """(digest, doc_id, copies, winner, member) of every distinct (text, doc_id) whose text has several rows; member: history holds the digest.

    A digest is looked up once however many rows have it, so that a shard's task follows the number of distinct texts.
    """
    spark = docs.sparkSession
    ship(spark)
    keys = materialize(digests(docs).groupBy("digest", "doc_id").agg(F.count("*").alias("copies")), "digests")
    low, high = keys.agg(F.min("doc_id"), F.max("doc_id")).first()
    cut = history_until if history_until is not None else (None if low is None else low + (high - low) // 2)
    old = F.lit(False) if cut is None else F.col("doc_id") <= cut
    distinct = keys.groupBy("digest").agg(F.min("doc_id").alias("least"), F.sum("copies").alias("n_rows"), F.min(F.when(old, F.col("doc_id"))).alias("in_history"))
    distinct = materialize(distinct, "distinct-digests")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-distinct.count() // shard_rows))
    index = materialize(build_index(distinct.where("in_history is not null").select("digest", F.col("in_history").alias("winner")), shards), "perfect-hash")
    asked = distinct.select(shard_of(shards).alias("shard"), "digest", "least", "n_rows")
    found = index.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(_lookup, FOUND)
    found = materialize(found.where("n_rows > 1").select("digest", F.when(F.col("member"), F.col("winner")).otherwise(F.col("least")).alias("winner"), "member"), "lookups")
    return keys.join(fit(found, 44), "digest").select("digest", "doc_id", "copies", "winner", "member")


def repeats(docs: DataFrame, history_until: int | None = None) -> DataFrame:
    """(doc_id, kept_id, in_history, n_rows): the rows that go, how many of each document, and what stays for them."""
    stays = F.col("doc_id").eqNullSafe(F.col("winner"))
    gone = lookups(docs, history_until).select("doc_id", F.col("winner").alias("kept_id"), F.col("member").alias("in_history"), (F.col("copies") - stays.cast("bigint")).alias("n_rows"))
    return gone.where("n_rows > 0")


def drop_repeats(docs: DataFrame, history_until: int | None = None) -> DataFrame:
    """The documents with one row of each text, with all its columns."""
    key, digest, of, kept = free(docs, "__larder_key", "__larder_digest", "__larder_id", "__larder_stays")
    found = lookups(docs, history_until)
    stays = F.col("doc_id").eqNullSafe(F.col("winner"))
    gone = materialize(found.where(~stays | (F.col("copies") > 1)).select(F.col("digest").alias(digest), F.col("doc_id").alias(of), stays.alias(kept)), "repeats")
    keyed = docs.withColumn(key, F.unhex(F.sha2(F.col("text").cast("string"), 256)))
    same = (F.col(key) == F.col(digest)) & F.col("doc_id").cast("bigint").eqNullSafe(F.col(of))
    out = keyed.join(fit(gone, 56), same, "left_anti")
    double = gone.where(F.col(kept))
    if not double.isEmpty():  # rows with the same doc_id and text: one of them stays
        out = out.union(keyed.join(double, same, "left_semi").dropDuplicates([key, "doc_id"]))
    return out.drop(key)
