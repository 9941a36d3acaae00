"""Near duplicates: SimHash signatures searched by navigable small-world graphs over Hamming distance.

Every document with a word gets a 256-bit SimHash of its distinct word pairs (of its one word, if it has one). Equal
signatures are folded into one node. The nodes are partitioned by a hash of the signature alone, and every node is a query
to every shard, its own and all others: a task holds one shard and reads others from the shared folder one by one, so
that no two signatures are left uncompared. Of two shards one asks the other, as distance is symmetric.

A shard's graph links each node with the nearest nodes met from it. Signatures of unlike texts all lie about as far from each other,
so that no walk leads from afar to a query's few partners; the long jumps of the small world are entry points instead: tables of nodes by
sampled bits, as many as let a partner at the radius share an entry with the query. From all nodes of its entries that lie within
`reach`, a query's beam spreads over their links and expands as long as new nodes are within reach; nothing is cut off. A beam of more than
`beam_most` nodes, and a query whose entries hold more nodes than a scan is worth, are answered by an exact scan of the shard instead. A shard is
audited by queries planted at exactly the radius from its nodes, one partner to be found by each, so that no group weighs more than
another, against the exact answer; under `recall` the number of entry tables is doubled, and beyond `tables_most` the shard answers
all by exact scans. Shards of up to `core` nodes are scanned. Edges are verified by the exact distance over all 256 bits and unioned over
the whole corpus. A query's work in a shard grows slowly with the shard; over the corpus work grows with nodes times shards.

Defined results: null doc_id, null text, and texts without words are near copies of nothing. Rows that share a doc_id
are one document: they fall into one group and stay or go together. Of each group the least doc_id stays. Other columns,
whatever their names, aren't looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.components import components
from larder.llm.tables import fit, free
from larder.llm.textual import distinct, mix, ngram_hashes, slices, word_hashes
from larder.runtime import materialize, scratch_path, ship

BITS = 256
RADIUS = 54  # of 256 bits: word-pair sets of a Jaccard similarity near 0.65 at the edge
_SEEDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89], np.uint64)
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()  # a byte's bits, a byte each
_S = ["s0", "s1", "s2", "s3"]
CORE = 4096  # nodes that are scanned sooner than a graph is built


def simhash(features: np.ndarray) -> np.ndarray:
    """Four 64-bit words: bit i is set when more features' hashes have bit i than not."""
    bits = _SPREAD.take(mix(features[:, None] ^ _SEEDS[None, :]).view(np.uint8).ravel()).reshape(-1, BITS // 8)
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(bits), 255):  # a byte each; sums of 255 don't carry
        ones += np.add.reduce(bits[lo : lo + 255], axis=0).view(np.uint8)
    return np.packbits(ones * 2 > len(features)).view(np.uint64)


def signatures_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (n, 4), and which texts have one."""
    words, at = word_hashes(texts)
    pairs = ngram_hashes(words, 2)
    out, has = np.zeros((len(texts), 4), np.uint64), np.diff(at) > 0
    for i in np.flatnonzero(has):
        a, b = at[i], at[i + 1]
        out[i] = simhash(distinct(pairs[a : b - 1]) if b - a > 1 else words[a:b])
    return out, has


def _sign(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            sig, has = signatures_of(part.column("text"))
            sig = sig[has].view(np.int64)
            ids = part.column("doc_id").filter(pa.array(has))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(np.ascontiguousarray(sig[:, k])) for k in range(4))], ["doc_id", *_S])


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, s0, s1, s2, s3) of every document that has an id and a word."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.where("doc_id is not null and text is not null").mapInArrow(_sign, "doc_id bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint")


def shards_of(nodes: int, most: int = 1 << 18, least: int = 1 << 14, tasks: int = 12) -> int:
    """Number of shards: of `most` nodes at the most, and `tasks` of them unless they had fewer than `least`."""
    return max(1, -(-nodes // most), min(tasks, nodes // least))


def scan(sig: np.ndarray, query: np.ndarray, radius: int):
    """All (query row, node) within the radius, by comparing every pair; the first 192 bits rule most out."""
    n, cols = len(sig), [np.ascontiguousarray(sig[:, k]) for k in range(4)]
    step = max(1, (1 << 16) // max(1, n))
    for lo in range(0, len(query), step):
        q = query[lo : lo + step]
        d = np.bitwise_count(q[:, 0:1] ^ cols[0])
        d += np.bitwise_count(q[:, 1:2] ^ cols[1])
        d += np.bitwise_count(q[:, 2:3] ^ cols[2])
        at = np.flatnonzero(d.ravel() <= radius)
        row, o = np.divmod(at, max(1, n))
        keep = d.ravel()[at].astype(np.int64) + np.bitwise_count(q[row, 3] ^ cols[3][o]) <= radius
        yield row[keep] + lo, o[keep]


def exact(sig: np.ndarray, rows: np.ndarray, size: int, radius: int):
    """All (row, other) within the radius, other among the first `size` nodes, by a scan."""
    for q, o in scan(sig[:size], sig[rows], radius):
        keep = rows[q] != o
        yield rows[q[keep]], o[keep]


def _joined(parts) -> tuple[np.ndarray, np.ndarray]:
    parts = [(np.zeros(0, np.int64),) * 2, *parts]
    return np.concatenate([p[0] for p in parts]).astype(np.int64), np.concatenate([p[1] for p in parts]).astype(np.int64)


class SmallWorld:
    """A shard's entry tables and graph, and the search over both."""

    LINKS, BACK, SURE = 12, 24, 0.95

    def __init__(self, sig: np.ndarray, radius: int, reach: int, beam_most: int, more: int = 1):
        self.sig, self.radius, self.reach, self.beam_most, n = sig, radius, reach, beam_most, len(sig)
        self.width = max(4, int(np.ceil(np.log2(max(n, 2) / 8))))
        met = (1 - radius / BITS) ** self.width  # how likely a partner at the radius shares a table's entry
        self.tables = more * int(np.ceil(np.log(1 - self.SURE) / np.log(1 - met)))
        bits, rng = self.bits(sig), np.random.default_rng(n)
        even = np.flatnonzero(np.abs(bits.mean(0) - 0.5) < 0.25)
        even = even if len(even) >= 4 * self.width else np.arange(BITS)
        self.places = [rng.choice(even, self.width, replace=False) for _ in range(self.tables)]
        self.order, self.first = np.empty((self.tables, n), np.int32), np.empty((self.tables, (1 << self.width) + 1), np.int32)
        for t, place in enumerate(self.places):
            key = self.keys(bits, place)
            self.order[t] = np.argsort(key, kind="stable")
            self.first[t] = np.searchsorted(key[self.order[t]], np.arange((1 << self.width) + 1))
        self.links = np.full((n, self.LINKS + self.BACK), -1, np.int32)

    @staticmethod
    def bits(sig: np.ndarray) -> np.ndarray:
        return np.unpackbits(np.ascontiguousarray(sig).view(np.uint8), axis=1)

    @staticmethod
    def keys(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
        key = np.zeros(len(bits), np.int32)
        for j in place:
            key = (key << 1) | bits[:, j]
        return key

    def near(self, query: np.ndarray, row: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The (query row, node) pairs within reach as row << 32 | node, each once and sorted, and their distances."""
        d = np.bitwise_count(self.sig[node, 0] ^ query[row, 0])
        d += np.bitwise_count(self.sig[node, 1] ^ query[row, 1])
        some = np.flatnonzero(d <= self.reach)
        row, node, d = row[some], node[some], d[some].astype(np.int32)
        for k in (2, 3):
            d += np.bitwise_count(self.sig[node, k] ^ query[row, k])
        some = d <= self.reach
        pair, at = np.unique((row[some].astype(np.int64) << 32) | node[some], return_index=True)
        return pair, d[some][at]

    def entries(self, query: np.ndarray, step: int = 2048, most: int = 1 << 21):
        """For part after part of the queries: its first row and its queries, the pairs within reach among the nodes that share an entry
        with a query, their distances, and the rows that are better scanned. A part has about `most` nodes to look at."""
        for begin in range(0, len(query), step):
            part = query[begin : begin + step]
            bits = self.bits(part)
            key = [self.keys(bits, p) for p in self.places]
            size = np.stack([f[k + 1] - f[k] for f, k in zip(self.first, key)])
            total = size.sum(0, dtype=np.int64)
            heavy = total > max(len(self.sig) // 16, 32 * self.tables)
            size[:, heavy] = 0
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(np.where(heavy, 0, total)) // most)) + 1).tolist(), len(part)]
            for lo, hi in zip(cuts, cuts[1:]):
                rows, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for t, k in enumerate(key):
                    n = size[t, lo:hi]
                    if n.any():
                        start = np.cumsum(n) - n
                        rows.append(np.repeat(np.arange(hi - lo), n))
                        nodes.append(self.order[t][np.repeat(self.first[t][k[lo:hi]] - start, n) + np.arange(int(n.sum()))])
                pair, d = self.near(part[lo:hi], np.concatenate(rows), np.concatenate(nodes))
                yield begin + lo, part[lo:hi], pair, d, np.flatnonzero(heavy[lo:hi])

    def spread(self, query: np.ndarray, pair: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The beams spread over the links as long as they grow; the queries whose beams outgrow beam_most leave to be scanned."""
        fresh, wide = pair, np.zeros(0, np.int64)
        while len(fresh):
            row, n = np.unique(pair >> 32, return_counts=True)
            over = row[n > self.beam_most]
            if len(over):
                wide = np.concatenate([wide, over])
                keep = ~np.isin(pair >> 32, over)
                pair, d, fresh = pair[keep], d[keep], fresh[~np.isin(fresh >> 32, over)]
            to = self.links[fresh & 0xFFFFFFFF]
            r, c = np.nonzero(to >= 0)
            asked = np.unique((fresh[r] >> 32 << 32) | to[r, c])
            if len(pair):
                at = np.minimum(np.searchsorted(pair, asked), len(pair) - 1)
                asked = asked[pair[at] != asked]
            fresh, more = self.near(query, asked >> 32, asked & 0xFFFFFFFF)
            pair, d = np.concatenate([pair, fresh]), np.concatenate([d, more])
            order = np.argsort(pair, kind="stable")
            pair, d = pair[order], d[order]
        return pair, d, wide

    def ask(self, query: np.ndarray):
        """Pairs (query row, node) within the radius."""
        for lo, q, pair, d, heavy in self.entries(query):
            pair, d, wide = self.spread(q, pair, d)
            pair = pair[d <= self.radius]
            yield (pair >> 32) + lo, pair & 0xFFFFFFFF
            yield from self.scanned(q, np.concatenate([heavy, wide]), lo)

    def scanned(self, query: np.ndarray, rows: np.ndarray, lo: int):
        if len(rows):
            for q, o in scan(self.sig, query[rows], self.radius):
                yield rows[q] + lo, o

    def grow(self):
        """Link all nodes; yields the pairs within the radius that are met on the way."""
        rows, nodes, ds = [], [], []
        for lo, _, pair, d, _ in self.entries(self.sig):
            row, node = (pair >> 32) + lo, pair & 0xFFFFFFFF
            other = row != node
            row, node, d = row[other], node[other], d[other]
            yield row[d <= self.radius], node[d <= self.radius]
            order = np.lexsort((node, d, row))  # the nearest of each node
            row, node, d = row[order], node[order], d[order]
            few = np.arange(len(row)) - np.searchsorted(row, row) < self.LINKS
            rows.append(row[few])
            nodes.append(node[few])
            ds.append(d[few])
        row, node, d = (np.concatenate(x) for x in (rows, nodes, ds))
        self.links[row, np.arange(len(row)) - np.searchsorted(row, row)] = node
        order = np.lexsort((row, d, node))
        row, node = row[order], node[order]
        rank = np.arange(len(node)) - np.searchsorted(node, node)
        few = rank < self.BACK
        self.links[node[few], self.LINKS + rank[few]] = row[few]


def planted(sig: np.ndarray, rows: np.ndarray, radius: int) -> np.ndarray:
    """The signatures of the rows with `radius` bits of each turned."""
    turn = np.random.default_rng(len(sig)).random((len(rows), BITS)).argpartition(radius, axis=1) < radius
    return sig[rows] ^ np.packbits(turn, axis=1).view(np.uint64)


class Shard:
    """A shard's answers. own() comes first: it builds the graph, and the audit settles how many entry tables it has, if a graph does at all."""

    def __init__(self, sig: np.ndarray, radius: int, core: int = CORE, reach: int = 26, beam_most: int = 256, tables_most: int = 4, audit: int = 256, recall: float = 0.9):
        self.sig, self.radius, self.core, self.reach, self.beam_most, self.tables_most, self.audit, self.least = sig, radius, core, radius + reach, beam_most, tables_most, audit, recall
        self.world: SmallWorld | None = None
        self.recall = 1.0

    def audited(self, world: SmallWorld) -> float:
        """The share of planted queries that find the node they were made from; its distance is the radius, so an exact scan finds it."""
        rows = np.unique(np.linspace(0, len(self.sig) - 1, self.audit).astype(np.int64))
        found = np.zeros(len(rows), bool)
        for q, o in world.ask(planted(self.sig, rows, self.radius)):
            found[q[rows[q] == o]] = True
        return float(found.mean())

    def build(self):
        """Settle how the shard answers; yields the pairs within the radius that are met on the way."""
        more = 1
        while len(self.sig) > self.core and more <= self.tables_most:
            world = SmallWorld(self.sig, self.radius, self.reach, self.beam_most, more)
            yield from world.grow()
            self.recall = self.audited(world)
            if self.recall >= self.least:
                self.world = world
                return
            more *= 2
        self.recall = 1.0

    def own(self):
        """Pairs (row, other) of the shard's own nodes, every row being a query."""
        yield from self.build()
        if self.world is None:
            yield from exact(self.sig, np.arange(len(self.sig)), len(self.sig), self.radius)
            return
        for q, o in self.meets(self.sig):
            yield q[q != o], o[q != o]

    def meets(self, query: np.ndarray):
        """Pairs (query row, row) of other signatures with the shard's nodes."""
        return self.world.ask(query) if self.world else scan(self.sig, query, self.radius)


def partners(sig: np.ndarray, radius: int, **settings):
    """Pairs (row, other) of a shard within the radius, every row being a query; and the audited recall, 1 where exact."""
    shard = Shard(sig, radius, **settings)
    return *_joined(shard.own()), shard.recall


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row of each row's component, by label spreading with pointer jumps."""
    root = np.arange(n)
    while len(a):
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == before).all():
            break
    return root


def _forest(n: int, pairs, most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Rows, and the least row of each one's component where that is another; pairs are folded as they come."""
    held, size, known = [], 0, (np.zeros(0, np.int64),) * 2

    def fold():
        a, b = _joined([known, *held])
        root = spanning(n, a, b)
        far = np.flatnonzero(root != np.arange(n))
        return far, root[far]

    for a, b in pairs:
        held.append((a, b))
        size += len(a)
        if size >= most:
            known, held, size = fold(), [], 0
    return fold()


def _read(path: str, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and signatures of a shard's nodes."""
    system, at = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    at = f"{at}/shard={shard}"
    if system.get_file_info(at).type == fs.FileType.NotFound:
        return np.zeros(0, np.int64), np.zeros((0, 4), np.uint64)
    files = sorted(f.path for f in system.get_file_info(fs.FileSelector(at)) if f.path.endswith(".parquet"))
    table = pa.concat_tables([pq.ParquetFile(system.open_input_file(f)).read(["node", *_S]) for f in files])
    sig = np.stack([table.column(s).to_numpy().view(np.uint64) for s in _S], 1)
    order = np.lexsort((sig[:, 3], sig[:, 1], mix(sig[:, 0] ^ sig[:, 2])))  # ids often follow the content; a graph grows best in no order
    return table.column("node").to_numpy()[order], sig[order]


def asked_by(shard: int, shards: int) -> list[int]:
    """The other shards whose nodes are queries to this one: of any two shards one asks the other, and all answer about as many."""
    half = shards // 2
    return [(shard + k) % shards for k in range(1, half + 1) if 2 * k != shards or shard < half]


def _edges(path: str, radius: int, core: int):
    """Edges of (shard, others, own) rows: of the shard's own nodes with each other where `own`, and with the nodes of the others."""

    def run(batches):
        for batch in batches:
            for i, others, own in zip(*(c.to_pylist() for c in batch.columns)):
                ids, sig = _read(path, i)
                if not len(ids):  # what this shard holds none of meets nothing here
                    continue
                shard = Shard(sig, radius, core)
                a, b = _forest(len(ids), shard.own() if own else shard.build())
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])
                for j in others:
                    theirs, query = _read(path, j)
                    a, b = _forest(len(ids) + len(theirs), ((q + len(ids), o) for q, o in shard.meets(query)))
                    both = np.concatenate([ids, theirs])
                    yield pa.RecordBatch.from_arrays([pa.array(both[a]), pa.array(both[b])], ["a", "b"])

    return run


def work(shards: int, most: int = 16) -> list[tuple[int, list[int], bool]]:
    """The tasks: a shard and the others that ask it, `most` of them at once, so that tasks grow in number and not in length."""
    out = []
    for i in range(shards):
        others = asked_by(i, shards)
        out += [(i, others[k : k + most], k == 0) for k in range(0, max(1, len(others)), most)]
    return out


def near_groups(docs: DataFrame, radius: int = RADIUS, core: int = CORE) -> DataFrame:
    """(doc_id, kept_id) of every document that is a near copy of another in its group and isn't the one that stays."""
    spark = docs.sparkSession
    sig = materialize(signatures(docs), "signatures")
    nodes = materialize(sig.groupBy(*_S).agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("last")), "nodes")
    shards = shards_of(nodes.count())
    path = scratch_path(spark, "shards")
    nodes.select("node", *_S, F.pmod(F.xxhash64(*_S), F.lit(shards)).alias("shard")).repartition(shards, "shard").write.partitionBy("shard").parquet(path)
    todo = work(shards)
    todo = spark.createDataFrame([(k, *w) for k, w in enumerate(todo)], "k int, shard int, others array<int>, own boolean").repartitionByRange(len(todo), "k").drop("k")
    edges = todo.mapInArrow(_edges(path, radius, core), "a bigint, b bigint")
    roots = components(edges)
    known = nodes.join(roots, "node", "left").withColumn("kept_id", F.coalesce("root", "node"))
    known = known.where("root is not null or last <> node").select(*_S, "kept_id")
    out = sig.join(known, _S).where("doc_id <> kept_id").select("doc_id", "kept_id")
    return out.groupBy("doc_id").agg(F.min("kept_id").alias("kept_id"))


def drop_near_copies(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The documents without the near copies: one document of each group stays, with all its columns."""
    (name,) = free(docs, "__larder_gone")
    gone = materialize(near_groups(docs, radius).select(F.col("doc_id").alias(name)), "near-copies")
    return docs.join(fit(gone, 16), F.col("doc_id").cast("bigint") == F.col(name), "left_anti")
