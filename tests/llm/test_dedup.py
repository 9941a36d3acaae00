"""Exact and near duplicates and repeated passages against brute force, with awkward rows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from larder.llm import chunk_dedup, exact_dedup, simhash_dedup
from larder.llm.components import components
from larder.llm.exact_dedup import PerfectHash

rng = random.Random(5)
VOCAB = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(900)]


def prose(n, r=rng):
    return " ".join(r.choice(VOCAB) for _ in range(n))


def docs(spark, rows, extra="kept_id bigint, __larder_gone string, score double"):
    """Rows of (doc_id, text) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 1, "x", 0.5) for i, t in rows], f"doc_id bigint, text string, {extra}")


@pytest.fixture(scope="module")
def corpus():
    rows = [(i, prose(rng.randint(5, 120))) for i in range(150)]
    for k in range(60):
        rows.append((1000 + k, rows[k % 20][1]))
    for k in range(40):
        words = rows[40 + k % 10][1].split()
        words[len(words) // 2] = "zzz"
        rows.append((2000 + k, " ".join(words)))
    rows += [(3000, None), (3001, None), (3002, ""), (3003, ""), (None, "lonely words here"), (None, rows[0][1]), (3004, "…!?"), (3005, prose(20_000)), (5, rows[5][1])]
    return rows


def test_perfect_hash_is_minimal_and_byte_checked():
    words = np.random.default_rng(1).integers(0, 1 << 63, (5000, 4), dtype=np.uint64)
    made = PerfectHash.build(words)
    assert sorted(made.slots(words)) == list(range(5000))
    again = PerfectHash.of(*(made.arrays()[k] for k in ("levels", "base", "tail")))
    assert (again.slots(words) == made.slots(words)).all()
    assert not len(PerfectHash.build(words[:0]).slots(words[:0]))


def test_exact_repeats(spark, corpus):
    got = {(r["doc_id"], r["kept_id"], r["n_rows"]) for r in exact_dedup.repeats(docs(spark, corpus)).collect()}
    groups, want = {}, set()
    for i, t in corpus:
        if t is not None:
            groups.setdefault(t, []).append(i)
    for ids in groups.values():
        known = [i for i in ids if i is not None]
        least = min(known) if known else None
        for i in set(ids):
            n = ids.count(i) - (i == least)
            if n:
                want.add((i, least, n))
    assert got == want


def test_exact_drop(spark, corpus):
    left = exact_dedup.drop_repeats(docs(spark, corpus))
    assert left.columns == ["doc_id", "text", "kept_id", "__larder_gone", "score"]
    texts = [r["text"] for r in left.collect()]
    assert texts.count(None) == 2 and sorted(t for t in texts if t is not None) == sorted({t for _, t in corpus if t is not None})


def brute_groups(rows):
    ids = [i for i, t in rows if i is not None and t is not None]
    sig, has = simhash_dedup.signatures_of(pa.array([t for i, t in rows if i is not None and t is not None], pa.string()))
    ids, sig = [i for i, h in zip(ids, has) if h], sig[has]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k in range(len(ids)):
        d = np.bitwise_count(sig ^ sig[k]).sum(1)
        for j in np.flatnonzero(d <= simhash_dedup.RADIUS):
            a, b = sorted((find(ids[k]), find(ids[j])))
            root[b] = a
    return {i: find(i) for i in ids if find(i) != i}


def test_near_groups(spark, corpus):
    got = {r["doc_id"]: r["kept_id"] for r in simhash_dedup.near_groups(docs(spark, corpus)).collect()}
    want = brute_groups(corpus)
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want)
    assert all(2000 + k in got for k in range(40)) and all(1000 + k in got for k in range(60))


def test_near_drop(spark, corpus):
    left = simhash_dedup.drop_near_copies(docs(spark, corpus))
    ids = [r["doc_id"] for r in left.select("doc_id").collect()]
    assert ids.count(None) == 2 and {3000, 3001, 3002, 3003, 3004, 3005} <= set(ids)
    assert not {1000 + k for k in range(60)} & set(ids)


def test_small_world_recall():
    gen = np.random.default_rng(3)
    base = gen.integers(0, 1 << 63, (900, 4), dtype=np.uint64)
    noise = np.packbits(gen.random((5, 900, 256)) < 0.08, axis=2).view(np.uint64).reshape(5, 900, 4)
    sig = (base[None] ^ noise).reshape(-1, 4)
    a, b, recall = simhash_dedup.partners(sig, simhash_dedup.RADIUS, core=256)
    d = np.array([np.bitwise_count(sig ^ s).sum(1) for s in sig])
    want = {(i, j) for i, j in zip(*np.nonzero(d <= simhash_dedup.RADIUS)) if i < j}
    got = {(min(i, j), max(i, j)) for i, j in zip(a.tolist(), b.tolist())}
    assert got <= want and len(got) >= 0.9 * len(want) and recall >= 0.9


def turned(gen, sig, bits):
    """The signatures with so many bits of each turned."""
    return sig ^ np.packbits(gen.random((len(sig), 256)).argsort(1) < bits, axis=1).view(np.uint64)


def test_every_pair_within_the_radius_meets(spark, monkeypatch):
    gen = np.random.default_rng(11)
    base = gen.integers(0, 1 << 63, (3000, 4), dtype=np.uint64)
    sig = np.concatenate([base, turned(gen, base, simhash_dedup.RADIUS)]).view(np.int64)
    rows = spark.createDataFrame([(k, *map(int, s)) for k, s in enumerate(sig)], "doc_id bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint")
    monkeypatch.setattr(simhash_dedup, "signatures", lambda docs: docs)
    monkeypatch.setattr(simhash_dedup, "shards_of", lambda nodes: 7)
    want = {(3000 + k, k) for k in range(3000)}
    for core in (simhash_dedup.CORE, 100):  # by scans, and by graphs
        got = {(r["doc_id"], r["kept_id"]) for r in simhash_dedup.near_groups(rows, core=core).collect()}
        assert got <= want and len(got) >= (0.9 if core == 100 else 1) * len(want)


@pytest.mark.parametrize("shards", [1, 2, 3, 8, 9])
def test_any_two_shards_meet_once(shards):
    met = [frozenset((i, j)) for i in range(shards) for j in simhash_dedup.asked_by(i, shards)]
    assert len(met) == len(set(met)) == shards * (shards - 1) // 2 and all(len(m) == 2 for m in met)


@pytest.mark.parametrize("shards", [1, 2, 5, 40])
def test_work_asks_every_pair_of_shards_once(shards):
    todo = simhash_dedup.work(shards, 4)
    asked = [frozenset((i, j)) for i, others, _ in todo for j in others]
    assert len(asked) == len(set(asked)) == shards * (shards - 1) // 2 and sorted(i for i, _, own in todo if own) == list(range(shards)) and all(len(o) <= 4 for _, o, _ in todo)


def plain_simhash(text):
    """A signature by plain Python over hashes of the text's distinct pairs of words; a word alone counts for itself."""
    from larder.llm.textual import mix, ngram_hashes, word_hashes

    words, _ = word_hashes(pa.array([text], pa.large_string()))
    features = {int(ngram_hashes(words[k : k + 2], 2)[0]) for k in range(len(words) - 1)} if len(words) > 1 else {int(words[0])}
    out = []
    for seed in simhash_dedup._SEEDS:
        votes = [0] * 64
        for f in features:
            h = int(mix(np.array([f ^ int(seed)], np.uint64))[0])
            for b in range(64):
                votes[b] += 1 if h >> b & 1 else -1
        out.append(sum(1 << b for b in range(64) if votes[b] > 0))
    return out


def test_signatures_against_plain_python():
    texts = ["one", "two words", "a b a b a b c", prose(50), prose(300), "same same same"]
    sig, has = simhash_dedup.signatures_of(pa.array(texts, pa.string()))
    flip = lambda w: int.from_bytes(bytes(int(f"{x:08b}"[::-1], 2) for x in int(w).to_bytes(8, "little")), "little")  # noqa: E731  packbits puts the first bit highest
    for k, t in enumerate(texts):
        mine = plain_simhash(t)
        assert sorted(map(int, sig[k])) == sorted(mine) or sorted(map(flip, sig[k])) == sorted(mine), t
    assert has.all()


def test_near_groups_by_graphs_with_a_hot_group(spark):
    r = random.Random(2)
    base = prose(120, r).split()
    rows = []
    for k in range(700):  # a third of all are copies of one text with a few words changed
        words = list(base)
        for _ in range(r.randint(0, 6)):
            words[r.randrange(120)] = r.choice(VOCAB)
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, prose(60, r)) for k in range(1000)]
    rows += [(3000 + k, rows[700 + k][1] + " added") for k in range(400)]
    table = docs(spark, rows)
    got = {x["doc_id"]: x["kept_id"] for x in simhash_dedup.near_groups(table, core=64).collect()}
    want = brute_groups(rows)
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want) and sum(3000 + k in got for k in range(400)) >= 392


def test_the_audit_weighs_queries_not_pairs():
    gen = np.random.default_rng(7)
    hot = turned(gen, np.repeat(gen.integers(0, 1 << 63, (1, 4), dtype=np.uint64), 1500, 0), 20)
    lone = gen.integers(0, 1 << 63, (2500, 4), dtype=np.uint64)
    sig = np.concatenate([hot, lone, turned(gen, lone, 46), gen.integers(0, 1 << 63, (5500, 4), dtype=np.uint64)])
    at = gen.permutation(len(sig))
    a, b, recall = simhash_dedup.partners(sig[at], simhash_dedup.RADIUS, core=256)
    got = {(min(i, j), max(i, j)) for i, j in zip(at[a].tolist(), at[b].tolist())}
    assert recall >= 0.9 and sum((1500 + k, 4000 + k) in got for k in range(2500)) >= 0.9 * 2500


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (3, 1), (20, 21)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {k: got.get(k, k) for k in (1, 2, 3, 7, 8, 9, 20, 21)} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 20: 20, 21: 20}


def test_repeated_passages(spark):
    shared = prose(120)
    rows = [(1, prose(60) + "\n" + shared + "\n" + prose(60)), (2, prose(31) + "\n" + shared + "\n" + prose(9)), (3, prose(200)), (4, None), (5, ""), (None, shared), (6, "x" * 200_000)]
    got = chunk_dedup.repeated_passages(docs(spark, rows)).collect()
    assert {r["doc_id"] for r in got} == {2} and all(r["kept_ids"] == [1] for r in got)
    text = dict(rows)[2]
    covered = "".join(text[r["start"] : r["stop"]] for r in got)
    assert len(covered) > 0.6 * len(shared) and covered.strip() in shared
    left = {r["doc_id"]: r["text"] for r in chunk_dedup.drop_passages(docs(spark, rows)).collect()}
    assert left[1] == dict(rows)[1] and left[3] == dict(rows)[3] and len(left[2]) == len(text) - len(covered) and left[4] is None


def test_chunks_resist_shifts():
    body = prose(400)
    cut = lambda t: [t.encode()[a:b] for a, b in zip(*chunk_dedup.bounds(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[:2])]
    a, b = set(cut(body)), set(cut("inserted words " + body))
    assert b"".join(cut(body)) == body.encode() and len(a & b) >= 0.9 * len(a)


@pytest.mark.parametrize("run", [exact_dedup.repeats, exact_dedup.drop_repeats, simhash_dedup.near_groups, simhash_dedup.drop_near_copies, chunk_dedup.repeated_passages, chunk_dedup.drop_passages])
def test_empty_tables(spark, run):
    assert run(docs(spark, [])).count() == 0


def whole_chunks(t):
    raw = np.frombuffer(t.encode(), np.uint8)
    return [raw[a:b].tobytes() for a, b in zip(*chunk_dedup.bounds(raw, np.array([0, len(raw)]))[:2])]


@pytest.mark.parametrize("letters", ["的一是不了人我在有他这为之大来以个中上们", "abcdefghijklmnop(){};=", "ABCDEFabcdef0123456789+/", "กขฃคฅฆงจฉชซฌญ"])
def test_passages_without_white_space(spark, letters):
    r = random.Random(1)
    text = lambda n: "".join(r.choice(letters) for _ in range(n))
    shared, other = text(30_000), text(5_000)
    made = whole_chunks(shared)
    assert b"".join(made) == shared.encode() and all(c.decode() for c in made)
    assert len(set(made) & set(whole_chunks(letters[0] + shared))) >= 0.99 * len(set(made))
    rows = [(1, shared), (2, shared), (3, letters[0] + shared), (4, text(300) + shared[2000:2400] + text(300)), (5, other)]
    got = {}
    for p in chunk_dedup.repeated_passages(docs(spark, rows)).collect():
        got[p["doc_id"]] = got.get(p["doc_id"], 0) + p["stop"] - p["start"]
    assert got[2] >= len(shared) - 50 and got[3] >= len(shared) - 300 and 100 <= got[4] <= 400 and not {1, 5} & set(got)


def test_passages_in_monotonous_and_repeated_rows(spark):
    rows = [(1, "x" * 50_000), (2, "x" * 50_000), (3, prose(80)), (3, prose(80)), (4, " ".join(["same few words here"] * 100)), (5, "\n" * 9000), (6, "\n" * 9000)]
    rows += [(7, rows[2][1] + " " + rows[3][1])]
    got = {p["doc_id"] for p in chunk_dedup.repeated_passages(docs(spark, rows)).collect()}
    assert got == {2, 7}  # rows of one doc_id are one document, and what repeats within a document stays


def naive_passages(rows, least=16):
    """Chunks by a plain loop over each text, and the runs of those that an earlier document has."""
    where, out = {}, {}
    for i, t in rows:
        for c in whole_chunks(t):
            if len(c.split()) >= chunk_dedup.GAP:
                where.setdefault(c, set()).add(i)
    for i, t in rows:
        n = at = 0
        for c in [*whole_chunks(t), b""]:
            if c and len(c.split()) >= chunk_dedup.GAP and min(where[c]) != i:
                n += len(c.split())
            else:
                if n >= least:
                    out[i] = out.get(i, 0) + n
                n = 0
            at += len(c)
    return out


def test_passages_against_a_plain_loop(spark):
    r = random.Random(8)
    parts = [prose(r.randint(20, 90), r) for _ in range(30)]
    rows = [(k, " ".join(r.choice(parts) if r.random() < 0.4 else prose(r.randint(5, 60), r) for _ in range(6))) for k in range(60)]
    got = {}
    for p in chunk_dedup.repeated_passages(docs(spark, rows)).collect():
        got[p["doc_id"]] = got.get(p["doc_id"], 0) + p["n_words"]
    assert got == naive_passages(rows) and got
