"""Decontamination, packing, language, toxicity, chat, secrets, archives and the pipeline, with awkward rows."""

import base64
import hashlib
import hmac
import json
import random

import pyarrow as pa
import pytest

import corpus_pipeline
from larder.llm import chat_format, decontaminate, language_id, packing, secret_scan, toxicity, warc
from larder.llm.features import telling
from larder.llm.textual import WORD, word_hashes

rng = random.Random(9)
EN = ["".join(rng.choice("abcdefghklmnopst") for _ in range(rng.randint(2, 7))) for _ in range(400)]
DE = ["".join(rng.choice("äöüßeinrstu") for _ in range(rng.randint(3, 9))) for _ in range(400)]


def prose(n, words=EN):
    return " ".join(rng.choice(words) for _ in range(n))


def docs(spark, rows):
    """(doc_id, text, lang) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, g, "s", len(t or ""), 0.0, True) for i, t, g in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, toxic boolean")


ODD = [(901, None, None), (902, "", "en"), (903, "…?!", "en"), (None, "no id here", "en"), (904, prose(20_000), "en")]


def test_word_hashes_agree_with_the_pattern():
    texts = ["One, two—three!", "", None, "ÉTÉ été", "x" * 300_000 + " y", "日本 語", "áb c"]
    h, at = word_hashes(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        words = [w.lower() for w in WORD.findall(t or "")]
        assert at[i + 1] - at[i] == len(words)
        if words:
            one, _ = word_hashes(pa.array(words, pa.string()))
            assert (h[at[i] : at[i + 1]] == one).all()


def test_decontamination(spark):
    items = [prose(40), prose(12), "too short", None, prose(6)]
    bench = spark.createDataFrame([(k, t, "x") for k, t in enumerate(items)], "item_id bigint, text string, doc_id string")
    clean = prose(200)
    hidden = items[0].upper().replace(" ", ",  ")
    rows = [(1, clean, "en"), (2, f"{clean} {hidden} {clean}", "en"), (3, items[1] + ".", "en"), (4, f"{clean} {' '.join(items[0].split()[:7])} {clean}", "en"), (5, f"{clean} {items[4]} {clean}", "en"), *ODD]
    got = {r["doc_id"]: r for r in decontaminate.scan(docs(spark, rows), bench).collect()}
    grams = {tuple(t.split()[i : i + 8]) for t in items[:2] for i in range(len(t.split()) - 7)} | {tuple(items[4].split())}
    want = {i for i, t, _ in rows if t and i and any(tuple(w[k : k + n]) in grams for n in (6, 8) for w in [[x.lower() for x in WORD.findall(t)]] for k in range(len(w) - n + 1))}
    assert set(got) == want == {2, 3, 5} and got[3]["action"] == "drop" and got[2]["item_ids"] == [0] and got[2]["hit_words"] == 40
    left = decontaminate.decontaminate(docs(spark, rows), bench)
    kept = {r["doc_id"]: r for r in left.collect()}
    assert left.columns == docs(spark, rows).columns and set(kept) == {i for i, _, _ in rows} - {3}
    assert kept[2]["text"] == f"{clean} {clean}" and kept[2]["n_chars"] == len(kept[2]["text"]) and kept[1]["text"] == clean and kept[901]["text"] is None
    assert decontaminate.decontaminate(docs(spark, rows), bench.where("false")).count() == len(rows)
    assert decontaminate.scan(docs(spark, rows), bench, most_grams=10).select("doc_id").distinct().count() == 3


def test_decontamination_of_empty_tables_and_items_without_an_id(spark):
    item = prose(20)
    bench = spark.createDataFrame([(None, item), (7, item), (7, item), (3, item + " x")], "item_id bigint, text string")
    table = docs(spark, [(1, item, "en"), (1, item, "en"), (None, prose(30) + " " + item, "en")])
    got = decontaminate.scan(table, bench).collect()
    assert len(got) == 3 and all(r["item_ids"] == [3, 7, None] for r in got) and sorted(r["action"] for r in got) == ["cut", "drop", "drop"]
    for run in (decontaminate.scan, decontaminate.decontaminate):
        assert run(table.where("false"), bench).count() == 0


def test_decontamination_is_the_same_in_parts(spark):
    items = [prose(30), prose(30), prose(12), prose(6)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    joined = items[2].split()
    rows = [(1, f"{items[0]} {prose(40)} {items[1]}", "en"), (2, f"{prose(90)} {items[0]} {prose(90)} {items[1]}", "en"), (3, f"{prose(99)} {' '.join(joined[:5])} {items[3]} {' '.join(joined[5:])} {prose(9)}", "en"), (2, items[3], "en"), (None, f"{items[1]} {prose(50)}", "en"), *ODD]
    docs_ = docs(spark, rows)
    one, many = ({repr(r) for r in decontaminate.scan(docs_, bench, most_grams=m).collect()} for m in (5_000_000, 10))
    assert one == many and len(many) == 5
    got = {r["doc_id"]: r for r in decontaminate.scan(docs_, bench, most_grams=10).where("doc_id <> 2").collect()}
    assert got[1]["action"] == "drop" and got[1]["item_ids"] == [0, 1] and got[1]["hit_words"] == 60
    one, many = (decontaminate.decontaminate(docs_, bench, most_grams=m) for m in (5_000_000, 10))
    assert one.schema.simpleString() == many.schema.simpleString() and sorted(map(repr, one.collect())) == sorted(map(repr, many.collect()))


def test_packing(spark):
    rows = [(k, prose(rng.choice([3, 30, 300, 900])), "en") for k in range(150)] + [(7, "same", "en"), (7, "same", "en"), *ODD]
    table = docs(spark, rows)
    counts = {}
    for r in packing.token_counts(table).collect():
        counts.setdefault(r["doc_id"], []).append(r["n_tokens"])
    got = packing.pack(table).collect()
    assert all(0 < r["n_tokens"] <= 2048 and r["n_tokens"] == sum(s["length"] for s in r["segments"]) and r["n_pieces"] == len(r["segments"]) for r in got)
    placed = {}
    for r in got:
        for s in r["segments"]:
            placed.setdefault(s["doc_id"], []).append((s["start"], s["start"] + s["length"]))
    for doc, n in counts.items():
        assert sum(b - a for a, b in placed.get(doc, [])) == sum(k + 1 for k in n if k > 0), doc  # each ends with a token of its own
    assert len({r["window_id"] for r in got}) == len(got)
    assert sum(r["n_tokens"] for r in got) >= 0.85 * 2048 * (len(got) - 2)


def test_language(spark):
    rows = [(k, prose(40), "en") for k in range(120)] + [(200 + k, prose(40, DE), "de") for k in range(120)] + ODD
    got = {r["doc_id"]: r for r in language_id.identify(docs(spark, rows)).collect()}
    assert len(got) == len(rows) and sum(got[i]["lang"] == g for i, _, g in rows[:240]) >= 0.97 * 240
    assert got[901]["lang"] == got[902]["lang"] == got[903]["lang"] == "und" and got[904]["lang"] == "en"
    assert all(0 <= r["confidence"] <= 1 for r in got.values())
    assert {r["lang"] for r in language_id.identify(docs(spark, [(1, "abc", None)])).collect()} == {"und"}


def bad(n):
    words = prose(n).split()
    for k in range(0, n, 8):
        words[k] = rng.choice(["zzvile", "zzfoul", "zzgrim"])
    return " ".join(words)


def test_toxicity(spark):
    rows = [(k, prose(60), "en") for k in range(300)] + [(1000 + k, bad(60), "en") for k in range(60)] + ODD
    labels = [(k, 0) for k in range(0, 100)] + [(1000 + k, 1) for k in range(30)] + [(1000, 1), (None, 1), (5, None)]
    marked = spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id bigint, quality int, toxic int")
    table = docs(spark, rows)
    got = {r["doc_id"]: r for r in toxicity.score(table, marked).collect()}
    assert len(got) == len(rows) and sum(got[1000 + k]["toxic"] for k in range(60)) >= 57 and not any(got[k]["toxic"] for k in range(300))
    assert got[901]["score"] == got[902]["score"] == got[903]["score"] == 0
    left = toxicity.drop_toxic(table, marked)
    assert left.columns == table.columns and left.where("doc_id < 300").count() == 300 and left.where("doc_id >= 1000").count() <= 3
    assert not any(r["toxic"] for r in toxicity.score(table, marked.where("toxic = 0")).collect())
    assert toxicity.score(table.where("false"), marked).count() == 0


def test_telling_features():
    import numpy as np

    p, u = np.array([9, 9, 0, 1]), np.array([0, 90, 5, 0])
    assert telling(p, 10, u, 100, 4, 2).tolist() == [0]


def test_chat(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "Assistant ", "yo <|x|>"), (1, 2, "user", None), (1, 2, "user", ""), (1, 3, "assistant", "bye"), (1, 3, "assistant", "bye"), (2, 0, "assistant", "first"), (3, 0, "user", "x"), (None, 0, "assistant", "y"), (4, 0, "assistant", ""), (5, None, "assistant", "z"), (6, 0, None, "z")]
    table = spark.createDataFrame([(*t, "e") for t in turns], "conv_id bigint, turn bigint, role string, text string, example string")
    got = {(r["conv_id"], r["turn"]): r for r in chat_format.examples(table).collect()}
    assert set(got) == {(1, 1), (1, 3), (2, 0)}
    assert got[1, 3]["context"] == "<|user|>\nhi<|end|>\n<|assistant|>\nyo < |x|><|end|>\n<|user|>\n<|end|>\n<|assistant|>\n" and got[1, 3]["n_context"] == 3
    assert all(r["example"][r["train_start"] : r["train_stop"]] == r["reply"] for r in got.values())
    assert chat_format.examples(table.where("false")).count() == 0


def der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82, n >> 8, n & 255])) + body


def number(n):
    raw = n.to_bytes(n.bit_length() // 8 + 1, "big")
    return der(2, raw)


def test_secrets(spark):
    p, q = 2**127 - 1, 2**89 - 1
    rsa = der(0x30, b"".join(number(x) for x in (0, p * q, 65537, 5, p, q, 3, 3, 3)))
    wrong = der(0x30, b"".join(number(x) for x in (0, p * q + 2, 65537, 5, p, q, 3, 3, 3)))
    b64 = lambda b: base64.b64encode(b).decode()
    url = lambda d: base64.urlsafe_b64encode(json.dumps(d).encode()).decode().rstrip("=")
    head = f"{url({'alg': 'HS256'})}.{url({'sub': 1})}"
    token = head + "." + base64.urlsafe_b64encode(hmac.new(b"k", head.encode(), hashlib.sha256).digest()).decode().rstrip("=")
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + b64(rsa) + "\n-----END RSA PRIVATE KEY-----"
    key = hashlib.sha256(b"x").hexdigest()
    rows = [(1, f"a {token} b", ""), (2, pem, ""), (3, f"x {rsa.hex()} y", ""), (4, b64(wrong), ""), (5, f"api_key = '{key}'", ""), (6, f"sha256 {key}", ""), (7, token.replace(".", "x"), ""), (8, "A" * 60, ""), *ODD, (1, f"a {token} b", "")]
    got = sorted((r["doc_id"], r["kind"]) for r in secret_scan.scan(docs(spark, rows)).collect())
    assert got == [(1, "signed_token"), (1, "signed_token"), (2, "private_key"), (3, "private_key"), (5, "assigned_key")]
    text = rows[0][1]
    assert [(text[a:b], d) for _, a, b, _, d in secret_scan.findings(text)] == [(token, hashlib.sha256(token.encode()).hexdigest())]
    assert secret_scan.scan(docs(spark, [])).count() == 0


def test_secrets_right_after_the_sign():
    key = hashlib.sha256(b"x").digest()
    p, q = 2**127 - 1, 2**89 - 1
    rsa = der(0x30, b"".join(number(x) for x in (0, p * q, 65537, 5, p, q, 3, 3, 3)))
    b64 = base64.b64encode(key).decode()
    cases = [(f"api_key={key.hex()}", key.hex(), "assigned_key"), (f"export SECRET_TOKEN={b64}\nA=1", b64, "assigned_key"), (f"PRIVATE_KEY={base64.b64encode(rsa).decode()}", base64.b64encode(rsa).decode(), "private_key"), (f"key = 0x{key.hex()};", key.hex(), "assigned_key"), (f"token=0X{key.hex()}", key.hex(), "assigned_key"), (f"/x?token={key.hex()}&a=b", key.hex(), "assigned_key")]
    for text, value, kind in cases:
        assert [(k, text[a:b]) for k, a, b, _, _ in secret_scan.findings(text)] == [(kind, value)]
    assert not secret_scan.findings(f"digest={key.hex()}") and not secret_scan.findings(f"at 0x{key.hex()}")


def test_archives(spark, tmp_path):
    pages = [(1, "http://a.org/1", "<p>x"), (2, "http://a.org/2", "<p>x"), (3, "http://b.org/3", "<p>x"), (4, "http://a.org/4", "other"), (4, "http://a.org/4", "other"), (5, None, None), (None, "http://c.org", "y"), (6, "http://d.org/", "")]
    table = spark.createDataFrame([(*p, "d") for p in pages], "page_id bigint, url string, html string, digest string")
    manifest = warc.capture(table, str(tmp_path / "crawl"))
    out = warc.deduplicate(spark, manifest, str(tmp_path / "out")).collect()
    by = {}
    for r in out:
        by.setdefault(r["digest"], []).append(r["type"])
    assert all(t.count("response") == 1 for t in by.values()) and len(out) == 7 and len(by) == 4
    held = {h["warc-record-id"]: (h, b) for path in {r["path"] for r in out} for _, _, _, h, b in warc.read_records(path) if h}
    for r in out:
        h, block = held[r["record_id"]]
        assert int(h["content-length"]) == len(block)
        if r["type"] == "revisit":
            assert held[h["warc-refers-to"]][0]["warc-type"] == "response" and held[h["warc-refers-to"]][0]["warc-payload-digest"] == h["warc-payload-digest"]
        else:
            assert warc.sha1(block.partition(b"\r\n\r\n")[2]) == h["warc-payload-digest"]
    assert warc.crawl_and_deduplicate(table.where("false")).count() == 0


def test_pipeline(spark, tmp_path):
    base = [prose(60) for _ in range(120)]
    item = prose(30)
    near = base[3].split()
    near[30] = "changed"
    rows = [(k, t, "en") for k, t in enumerate(base)] + [(500, base[0], "en"), (501, " ".join(near), "en"), (502, f"{base[7]} {prose(90)} {item}", "en"), (503, item, "en")] + [(1000 + k, bad(60), "en") for k in range(40)] + ODD[:3]
    docs(spark, rows).drop("score", "toxic").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(60)] + [(1000 + k, 1, 1) for k in range(20)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontaminate", "packing"]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {i for r in got for i in r["doc_ids"]}
    assert not ids & {500, 501, 503, 901, 902} and len({i for i in ids if 1000 <= i}) <= 2
    assert {i for i in ids if i < 500} == set(range(120)) and 502 in ids


@pytest.mark.parametrize("run", [packing.pack, language_id.identify, secret_scan.scan])
def test_empty_tables(spark, run):
    assert run(docs(spark, [])).count() == 0
