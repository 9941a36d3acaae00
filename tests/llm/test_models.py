"""The trained models and the solver against plain Python, with ties, repeats and noise."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa

from larder.llm import features, language_id, packing, toxicity

rng = random.Random(12)


def vectors(n, width, r):
    """Sparse rows as (first entry of each, features, values)."""
    rows = [sorted(r.sample(range(width), r.randint(1, 5))) for _ in range(n)]
    at = np.cumsum([0, *map(len, rows)])
    return at, np.array([f for x in rows for f in x]), np.array([r.uniform(0.1, 1) for x in rows for _ in x], np.float32)


def plain_ftrl(data, y, classes, order, alpha, beta, l1, l2):
    """FTRL-Proximal a coordinate at a time, as its authors write it."""
    at, feature, value = data
    z, n = {}, {}

    def weight(key):
        if abs(z.get(key, 0.0)) <= l1:
            return 0.0
        return -(z[key] - math.copysign(l1, z[key])) / ((beta + math.sqrt(n.get(key, 0.0))) / alpha + l2)

    for i in order:
        entries = [(int(feature[k]), float(value[k])) for k in range(at[i], at[i + 1])]
        w = {(f, c): weight((f, c)) for f, _ in entries for c in range(classes)}
        score = [sum(w[f, c] * x for f, x in entries) for c in range(classes)]
        top = max(score)
        total = sum(math.exp(s - top) for s in score)
        for c in range(classes):
            error = math.exp(score[c] - top) / total - (c == y[i])
            for f, x in entries:
                g = error * x
                sigma = (math.sqrt(n.get((f, c), 0.0) + g * g) - math.sqrt(n.get((f, c), 0.0))) / alpha
                z[f, c] = z.get((f, c), 0.0) + g - sigma * w[f, c]
                n[f, c] = n.get((f, c), 0.0) + g * g
    return {(f, c): weight((f, c)) for f, c in z}


def test_ftrl_against_plain_python():
    r = random.Random(3)
    data, classes = vectors(60, 16, r), 3
    y = np.array([r.randrange(classes) for _ in range(60)])
    got = language_id.ftrl(data, y, classes, bits=4, epochs=2, alpha=0.5, beta=1.0, l1=0.05, l2=0.1, seed=7)
    draw = np.random.default_rng(7)
    order = [*draw.permutation(60), *draw.permutation(60)]
    want = plain_ftrl(data, y, classes, order, 0.5, 1.0, 0.05, 0.1)
    for f, c in itertools.product(range(16), range(classes)):
        assert abs(got[f, c] - want.get((f, c), 0.0)) < 1e-6
    assert (got == 0).any() and (got != 0).any()


def test_temperature_is_the_best_of_many():
    r = np.random.default_rng(5)
    logits, y = r.normal(size=(200, 3)) * 4, r.integers(0, 3, 200)
    loss = lambda t: -np.log(language_id.softmax(logits / t)[np.arange(200), y]).mean()
    assert loss(language_id.temperature(logits, y)) <= min(loss(t) for t in np.geomspace(0.05, 40, 400)) + 1e-6
    assert language_id.temperature(logits[:0], y[:0]) == 1.0


def test_language_with_ties_repeats_and_noise(spark):
    words = {"aa": ["alba", "mora", "lina"], "bb": ["grunt", "fjord", "kvist"]}
    text = lambda k: " ".join(rng.choice(words[k]) for _ in range(30))
    rows = [(k, text("aa"), "aa") for k in range(60)] + [(100 + k, text("bb"), "bb") for k in range(60)] + [(200 + k, text("aa"), f"noise{k}") for k in range(20)]
    rows += [rows[0], rows[0], (300, "mora alba", None), (None, "fjord grunt kvist", None)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels, *_ = language_id.fit(table, most_labels=2)
    assert labels == ["aa", "bb"]
    got = language_id.identify(table).collect()
    assert len(got) == len(rows)
    same = spark.createDataFrame([(k, "the very same text", g) for k, g in enumerate(["x", "y"] * 20)], "doc_id bigint, text string, lang string")
    assert len({(r["lang"], r["confidence"]) for r in language_id.identify(same).collect()}) == 1  # equal texts get one answer, whatever their labels


def plain_nnls(a, b, rounds=200_000, tolerance=1e-12):
    """Non-negative least squares by coordinate descent."""
    x, r = np.zeros(a.shape[1]), b.astype(float).copy()
    size = (a * a).sum(0)
    for _ in range(rounds):
        most = 0.0
        for j in range(a.shape[1]):
            step = max(-x[j], a[:, j] @ r / size[j])
            x[j] += step
            r -= step * a[:, j]
            most = max(most, abs(step))
        if most < tolerance:
            break
    return x


def test_nnls_against_coordinate_descent():
    r = np.random.default_rng(4)
    for rows, columns in ((6, 4), (8, 12), (5, 5)):
        a, b = r.random((rows, columns)), r.normal(size=rows)
        mine, theirs = packing.nnls(a, b), plain_nnls(a, b)
        assert (mine >= 0).all() and abs(np.linalg.norm(a @ mine - b) - np.linalg.norm(a @ theirs - b)) < 1e-6
    assert not packing.nnls(np.eye(3), -np.ones(3)).any()


def test_solved_combinations_are_supplied():
    made = packing.combinations(8, 3)
    assert set(made) == {tuple(sorted(c, reverse=True)) for n in (1, 2, 3) for c in itertools.product(range(1, 9), repeat=n) if sum(c) == 8} and len(made) == len(set(made))
    r = np.random.default_rng(2)
    for _ in range(20):
        histogram = np.concatenate([[0], r.integers(0, 50, 8)])
        used = np.zeros(9, int)
        for combo, n in packing.solve(histogram, 8, 3):
            assert sum(combo) == 8 and n > 0
            for k in combo:
                used[k] += n
        assert (used <= histogram).all()


def test_greedy_is_best_fit():
    r = np.random.default_rng(9)
    lengths = r.integers(1, 33, 300)
    got = packing.greedy(lengths, 32)
    room, want = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        fits = [k for k, free in enumerate(room) if free >= lengths[i]]
        k = min(fits, key=lambda k: room[k]) if fits else len(room)
        room += [] if fits else [32]
        room[k] -= lengths[i]
        want[i] = room[k]
    assert np.bincount(got, lengths).max() <= 32 and sorted(32 - np.bincount(got, lengths).astype(int)) == sorted(room)


def risk(w, bias, data, positive, prior):
    """The non-negative risk by plain Python."""
    at, feature, value = data
    plus, minus_p, minus_u = [], [], []
    for i in range(len(at) - 1):
        z = bias + sum(value[k] * w[feature[k]] for k in range(at[i], at[i + 1]))
        if positive[i]:
            plus.append(math.log1p(math.exp(-z)))
            minus_p.append(math.log1p(math.exp(z)))
        else:
            minus_u.append(math.log1p(math.exp(z)))
    mean = lambda x: sum(x) / len(x)
    negative = mean(minus_u) - prior * mean(minus_p)
    return prior * mean(plus) + negative, negative


def test_nnpu_step_is_the_gradient_by_differences():
    r = random.Random(8)
    data = vectors(40, 12, r)
    positive = np.array([k < 15 for k in range(40)])
    rate, prior = 1e-3, 0.2
    w, bias = toxicity.nnpu(data, positive, prior, epochs=1, rate=rate, l2=0.0, adaptive=False)
    h, zero = 1e-5, np.zeros(12)
    base, negative = risk(zero, 0.0, data, positive, prior)
    assert negative > 0  # so that the whole risk's gradient is taken
    for j in range(12):
        up = zero.copy()
        up[j] = h
        slope = (risk(up, 0.0, data, positive, prior)[0] - base) / h
        assert abs(w[j] + rate * slope) < 1e-7
    assert abs(bias + rate * (risk(zero, h, data, positive, prior)[0] - base) / h) < 1e-7


def test_the_prior_is_no_more_than_the_documents_allow():
    p, everywhere = np.array([90, 40, 2, 30]), np.array([95, 60, 1, 900])
    got = toxicity.allowed(0.3, p, 100, everywhere, 1000)
    assert 0.095 / 0.9 <= got <= 0.06 / 0.35 and toxicity.allowed(0.05, p, 100, everywhere, 1000) == 0.05
    assert toxicity.allowed(0.3, p * 0, 100, everywhere, 1000) == 0.3


def test_nnpu_lowers_the_risk_and_turns_back_below_zero():
    r = random.Random(10)
    data = vectors(60, 12, r)
    positive = np.array([k < 20 for k in range(60)])
    w, bias = toxicity.nnpu(data, positive, 0.2, epochs=40)
    assert risk(w, bias, data, positive, 0.2)[0] < risk(np.zeros(12), 0.0, data, positive, 0.2)[0]
    w, bias = toxicity.nnpu(data, positive, 0.9, epochs=1, rate=1e-3, l2=0.0, adaptive=False)
    if risk(np.zeros(12), 0.0, data, positive, 0.9)[1] < 0:
        up = risk(w, bias, data, positive, 0.9)[1]
        assert up > risk(np.zeros(12), 0.0, data, positive, 0.9)[1]


def test_features_against_plain_python():
    texts = ["Aé b, 12 aé!", "", "zz", None]
    at, feature, count = features.characters(pa.array(texts, pa.string()), 20)
    plain = lambda t: "".join(c if c.isalpha() else " " for c in (t or "").lower())
    for i, t in enumerate(texts):
        s = plain(t)
        while "  " in s:
            s = s.replace("  ", " ")
        grams = [s[k : k + n] for n in (1, 2, 3) for k in range(len(s) - n + 1) if n > 1 or s[k] != " "]
        assert count[at[i] : at[i + 1]].sum() == len(grams) and at[i + 1] - at[i] == len(set(grams)), (t, grams)


def test_toxicity_with_repeated_rows_and_ties(spark):
    clean = [(k, " ".join(rng.choice(["field", "river", "stone", "cloud", "table"]) for _ in range(30))) for k in range(200)]
    bad = [(500 + k, " ".join(rng.choice(["vilest", "field", "grimmer", "river"]) for _ in range(30))) for k in range(40)]
    rows = [*clean, *bad, bad[0], bad[0], (None, bad[1][1]), (None, None)]
    marked = spark.createDataFrame([(500 + k, 1) for k in range(30)] + [(500, 0), (500, 1)] + [(k, 0) for k in range(160)], "doc_id bigint, toxic int")
    got = toxicity.score(spark.createDataFrame(rows, "doc_id bigint, text string"), marked).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add((r["score"], r["toxic"]))
    assert len(got) == len(rows) and len(by[500]) == 1 and sum(any(t for _, t in by[500 + k]) for k in range(40)) >= 38 and not any(t for k in range(200) for _, t in by[k])
