"""WARC archives with every kind of record and damage, against a resolver over plain dictionaries."""

import random

import pytest

from larder.llm import warc

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
KIND = {"Content-Type": "application/http; msgtype=response"}


def rec(kind, name, block, **more):
    headers = {"WARC-Type": kind, "WARC-Record-ID": name, "WARC-Target-URI": f"http://x.org/{name}", "WARC-Date": "2024-01-01T00:00:00Z"} | more
    return [(k.replace("_", "-"), v) for k, v in headers.items() if v is not None], block


def plain(headers, block):
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def held(rows):
    return {h["warc-record-id"]: (h, b) for path in {r["path"] for r in rows} for *_, h, b in warc.read_records(path) if h}


def run(spark, tmp_path, files):
    """The written rows and headers read of archives that are given as bytes by name."""
    (tmp_path / "in").mkdir(exist_ok=True)
    for name, data in files.items():
        (tmp_path / "in" / name).write_bytes(data)
    manifest = spark.createDataFrame([(str(tmp_path / "in" / n),) for n in files], "path string")
    return warc.deduplicate(spark, manifest, str(tmp_path / "out")).collect(), warc.read_headers(spark, manifest)


def test_every_record_is_carried_over(spark, tmp_path):
    a, b = HTTP + b"same body", HTTP + b"other body"
    records = [
        rec("warcinfo", "info", b"software: x\r\n", Content_Type="application/warc-fields"),
        rec("request", "req", b"GET / HTTP/1.1\r\n\r\n", WARC_Concurrent_To="r1", Content_Type="application/http; msgtype=request"),
        rec("response", "r1", a, **KIND),  # no digest given
        rec("response", "r2", a, WARC_Payload_Digest="sha1:CLAIMED", **KIND),
        rec("response", "r3", b, WARC_Payload_Digest="sha1:CLAIMED", **KIND),  # the same claim over another body
        rec("metadata", "m1", b"via: y\r\n", WARC_Refers_To="r3"),
        rec("resource", "s1", b"bytes", **{"Content-Type": "image/png"}),
        rec("revisit", "v1", HTTP, WARC_Payload_Digest="sha1:CLAIMED", WARC_Refers_To="r3", WARC_Profile=warc.PROFILE, **KIND),
        rec("revisit", "v2", HTTP, WARC_Payload_Digest="sha1:CLAIMED", WARC_Profile=warc.PROFILE, **KIND),
        rec("revisit", "v3", HTTP, WARC_Payload_Digest="sha1:ELSEWHERE", WARC_Refers_To="<far>", WARC_Profile=warc.PROFILE, **KIND),
        rec("response", None, HTTP + b"no id, no date", WARC_Date=None, **KIND),
        rec("response", "r1", a, **KIND),  # the same record over again
    ]
    rows, _ = run(spark, tmp_path, {"a.warc.gz": b"".join(warc.record(*r) for r in records)})
    got = held(rows)
    assert len(rows) == len(records) - 1 and len(got) == len(records)
    new = lambda old: got[warc.fresh_id(old)]
    assert new("r1")[1] == a and new("r3")[1] == b and new("s1")[1] == b"bytes" and new("s1")[0]["content-type"] == "image/png"
    assert new("r2")[0]["warc-type"] == "revisit" and new("r2")[1] == HTTP and new("r2")[0]["warc-refers-to"] == warc.fresh_id("r1")
    assert new("v1")[0]["warc-refers-to"] == warc.fresh_id("r3") and new("v2")[0]["warc-refers-to"] == warc.fresh_id("r1") and new("v3")[0]["warc-refers-to"] == "<far>"
    assert new("req")[0]["warc-concurrent-to"] == warc.fresh_id("r1") and new("m1")[0]["warc-refers-to"] == warc.fresh_id("r3")
    assert sum(b.endswith(b"no id, no date") for _, b in got.values()) == 1 and sum(h["warc-type"] == "warcinfo" and b == b"software: x\r\n" for h, b in got.values()) == 1
    for h, block in got.values():
        assert int(h["content-length"]) == len(block) and ("warc-block-digest" not in h or h["warc-block-digest"] == warc.sha1(block))


@pytest.mark.parametrize("packed", [True, False])
def test_damage_is_passed_over_and_counted(spark, tmp_path, packed):
    one = [rec("response", f"r{k}", HTTP + bytes([65 + k]) * 3000, **KIND) for k in range(5)]
    made = [bytearray((warc.record if packed else plain)(*r)) for r in one]
    if packed:
        made[1][40:50] = b"\xff" * 10  # a spoilt member
    else:
        made[1] = made[1].replace(b"Content-Length: 3", b"Content-Length: x")
    data = b"".join(map(bytes, made)) + b"\0" * 7 + bytes(made[4])[:-60]  # padding, and a record that is cut off
    rows, headers = run(spark, tmp_path, {"a.warc": data, "empty.warc": b"", "noise.warc": b"nothing of the kind"})
    assert {r["uri"] for r in rows} == {f"http://x.org/r{k}" for k in (0, 2, 3, 4)}
    hurt = {r["file"].rpartition("/")[2]: r["n_damaged"] for r in warc.damage(headers).collect()}
    assert hurt["a.warc"] == 2 and hurt["noise.warc"] == 1 and "empty.warc" not in hurt


def test_many_records_in_one_member_and_large_ones(spark, tmp_path):
    import gzip

    records = [rec("response", f"r{k}", HTTP + random.Random(k).randbytes(900_000 if k == 2 else 50), **KIND) for k in range(6)] + [rec("response", "long", HTTP + b"z" * 3_000_000, **KIND)]
    whole = b"".join(plain(*r) for r in records)
    for name, data in {"one.warc.gz": gzip.compress(whole), "plain.warc": whole}.items():
        at = tmp_path / name
        at.write_bytes(data)
        assert [(h["warc-record-id"], b) for *_, h, b in warc.read_records(str(at))] == [(dict(h)["WARC-Record-ID"], b) for h, b in records]
    rows, _ = run(spark, tmp_path, {"one.warc.gz": gzip.compress(whole), "plain.warc": whole})
    assert sorted(r["type"] for r in rows) == ["response"] * 7 + ["revisit"] * 7 and len({r["record_id"] for r in rows}) == 14


def test_against_plain_dictionaries(spark, tmp_path):
    rng, files, records = random.Random(3), {}, []
    for f in range(3):
        part = []
        for k in range(60):
            body, name, date = HTTP + b"body %d" % rng.randrange(12), f"f{f}-{k}", f"2024-01-{rng.randint(1, 28):02d}T00:00:00Z"
            digest = warc.sha1(body[len(HTTP) :])
            kind = rng.choice(["response", "response", "revisit", "metadata"])
            part.append((kind, name, date, digest, rec(kind, name, HTTP if kind == "revisit" else body, WARC_Date=date, WARC_Payload_Digest=digest, **KIND)))
        records += part
        files[f"{f}.warc.gz"] = b"".join(warc.record(*p[-1]) for p in part)
    first = {}
    for kind, name, date, digest, _ in records:
        if kind == "response":
            first[digest] = min(first.get(digest, (date, name)), (date, name))
    rows, _ = run(spark, tmp_path, files)
    got = {r["record_id"]: (r["type"], r["refers_to"]) for r in rows}
    want = {}
    for kind, name, date, digest, _ in records:
        origin = first.get(digest)
        if kind == "metadata" or (kind == "response" and origin == (date, name)):
            want[warc.fresh_id(name)] = (kind, None)
        else:
            want[warc.fresh_id(name)] = ("revisit", warc.fresh_id(origin[1]) if origin else None)
    assert got == want
