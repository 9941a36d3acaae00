"""The pipeline against its stages by brute force, on awkward rows."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from larder.llm import packing, simhash_dedup, toxicity
from larder.llm.textual import WORD

rng = random.Random(21)
VOCAB = ["".join(rng.choice("abcdefghklmnopst") for _ in range(rng.randint(2, 7))) for _ in range(500)]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, toxic boolean, kept_id bigint"


def prose(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def bad(n):
    return " ".join(w if k % 6 else rng.choice(["zzvile", "zzfoul", "zzgrim"]) for k, w in enumerate(prose(n).split()))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = [prose(rng.randint(30, 90)) for _ in range(140)]
    items = [prose(30), prose(12), prose(6), None]
    rows = list(enumerate(base))
    rows += [(300 + k, base[k % 9]) for k in range(30)] + [(7, base[7])]  # copies, and a row over again
    for k in range(20):
        words = base[40 + k].split()
        words[len(words) // 2] = "changed"
        rows.append((400 + k, " ".join(words)))
    rows += [(500, f"{prose(60)} {items[0].upper()} {prose(60)}"), (501, items[1]), (502, f"{items[2]} {prose(50)}"), (503, f"{prose(20)} {items[0]}")]
    rows += [(1000 + k, bad(60)) for k in range(40)] + [(2000, None), (2001, None), (2002, ""), (2003, ""), (2004, "…?!"), (None, prose(20)), (2005, prose(20_000)), (2006, base[3] + " " + prose(3000))]
    at = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, True, 1) for i, t in rows], SCHEMA)
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(60)] + [(1000 + k, 1, 1) for k in range(20)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), rows, [t for t in items if t]


def without_copies(rows):
    out, seen = [], {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if t is None or t not in seen:
            out.append((i, t))
            seen[t] = i
    return out


def without_near(rows):
    known = [(i, t) for i, t in rows if i is not None and t is not None]
    sig, has = simhash_dedup.signatures_of(pa.array([t for _, t in known], pa.string()))
    root = {i: i for i, _ in known}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(known)):
        for b in range(a):
            if has[a] and has[b] and int(np.bitwise_count(sig[a] ^ sig[b]).sum()) <= simhash_dedup.RADIUS:
                lo, hi = sorted((find(known[a][0]), find(known[b][0])))
                root[hi] = lo
    return [(i, t) for i, t in rows if i not in root or find(i) == i]


def without_passages(rows, items, n=8, least=5):
    grams = {}
    for t in items:
        w = [x.lower() for x in WORD.findall(t)]
        size = min(n, len(w))
        if size >= least:
            grams.setdefault(size, set()).update(tuple(w[k : k + size]) for k in range(len(w) - size + 1))

    def spans(text):
        found = list(WORD.finditer(text))
        w, hit = [m.group().lower() for m in found], [False] * len(found)
        for size, known in grams.items():
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in known:
                    hit[k : k + size] = [True] * size
        out, k = [], 0
        while k < len(hit):
            stop = k
            while stop < len(hit) and hit[stop]:
                stop += 1
            if stop > k:
                out.append((found[k].start(), found[stop - 1].end()))
            k = max(stop, k + 1)
        return out, sum(hit), len(w)

    out = []
    for i, t in rows:
        holes, hit, total = spans(t or "")
        if holes and hit * 2 >= total:
            continue
        while holes:
            for a, b in reversed(holes):
                t = f"{t[:a].rstrip(' ')} {t[b:].lstrip(' ')}"
            holes = spans(t)[0]
        out.append((i, t))
    return out


def test_every_stage_by_brute_force(spark, tables):
    at, rows, items = tables
    docs = spark.read.parquet(f"{at}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "decontaminate", "packing"]

    def step(name, docs):
        path = f"{at}/after-{name}"
        stages[name](spark, docs, at).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    def held(docs):
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        return sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=repr)

    labels = spark.read.parquet(f"{at}/labels.parquet")
    toxic = {(r["doc_id"]) for r in toxicity.score(docs, labels).where("toxic").collect()}
    assert len(toxic & set(range(1000, 1040))) >= 38 and len(toxic - set(range(1000, 1040))) <= 1
    want = [(i, t) for i, t in rows if i not in toxic]
    docs = step("toxicity", docs)
    assert held(docs) == sorted(want, key=repr)
    docs, want = step("exact_dedup", docs), without_copies(want)
    assert held(docs) == sorted(want, key=repr)
    docs, want = step("near_dedup", docs), without_near(want)
    assert held(docs) == sorted(want, key=repr) and not {400 + k for k in range(20)} & {i for i, _ in want}
    docs, want = step("decontaminate", docs), without_passages(want, items)
    assert held(docs) == sorted(want, key=repr) and 501 not in {i for i, _ in want}
    packed = step("packing", docs).collect()
    counts = packing.token_counts(docs).collect()
    placed = {}
    for r in packed:
        assert r["n_tokens"] == sum(s["length"] for s in r["segments"]) <= 2048
        for s in r["segments"]:
            placed.setdefault(s["doc_id"], []).append((s["start"], s["length"]))
    need = {}
    for r in counts:
        if r["n_tokens"]:
            need[r["doc_id"]] = need.get(r["doc_id"], 0) + r["n_tokens"] + 1  # each ends with a token of its own
    assert {i: sum(n for _, n in p) for i, p in placed.items()} == need
    run = corpus_pipeline.run(spark, at).collect()
    assert sorted(i for r in run for i in r["doc_ids"] if i is not None) == sorted(i for r in packed for i in r["doc_ids"] if i is not None)


def test_empty_tables(spark, tables, tmp_path):
    at, _, _ = tables
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{at}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
