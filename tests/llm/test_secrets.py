"""Secret scans: every kind of key, values of any length, decoys, and texts made to be slow."""

import base64
import json
import random
import time

import pytest

from larder.llm import secret_scan


def der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | (k := (n.bit_length() + 7) // 8)]) + n.to_bytes(k, "big")
    return bytes([tag]) + size + body


def number(n):
    return der(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


def string(b):
    return len(b).to_bytes(4, "big") + b


P, Q = 2**127 - 1, 2**89 - 1
RSA = der(0x30, b"".join(number(x) for x in (0, P * Q, 65537, 5, P, Q, 3, 3, 3)))
EC = der(0x30, number(1) + der(4, bytes(range(32))) + der(0xA0, der(6, bytes([0x2A, 0x86, 0x48, 0xCE, 0x3D, 3, 1, 7]))))
PKCS8 = der(0x30, number(0) + der(0x30, der(6, bytes([0x2A, 0x86, 0x48, 0x86, 0xF7, 0x0D, 1, 1, 1])) + der(5, b"")) + der(4, RSA))
LOCKED = der(0x30, der(0x30, der(6, bytes([0x2A, 0x86, 0x48, 0x86, 0xF7, 0x0D, 1, 5, 13])) + der(0x30, number(7))) + der(4, bytes(range(48))))
SSH = b"openssh-key-v1\0" + string(b"none") + string(b"none") + string(b"") + (1).to_bytes(4, "big") + string(b"ssh-ed25519" * 3) + string(bytes(range(64)))
KEY_ID = "AKIA" + base64.b32encode((((123456789012 << 7) & 0x7FFFFFFFFF80) | 1 << 47).to_bytes(6, "big") + b"abcd").decode()


def lines(data, label):
    body = base64.encodebytes(data).decode()
    return f"-----BEGIN {label}-----\n{body}-----END {label}-----"


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        (lines(RSA, "RSA PRIVATE KEY"), "private_key"), (lines(EC, "EC PRIVATE KEY"), "private_key"), (lines(PKCS8, "PRIVATE KEY"), "private_key"), (lines(LOCKED, "ENCRYPTED PRIVATE KEY"), "private_key"),
        (lines(SSH, "OPENSSH PRIVATE KEY"), "openssh_key"), (base64.b64encode(SSH).decode(), "openssh_key"), (EC.hex(), "private_key"), (base64.b64encode(PKCS8).decode(), "private_key"), (KEY_ID, "access_key_id"),
        ("-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4\nDEK-Info: x\n\n" + base64.encodebytes(RSA).decode() + "-----END RSA PRIVATE KEY-----", "private_key"),
    ],
)
def test_every_kind(text, kind):
    for around in ("", "before ", "é" * 5000 + "\n"):
        found = secret_scan.findings(f"{around}{text} after")
        assert [(k, a, b) for k, a, b, _, _ in found] == [(kind, len(around), len(around) + len(text))]


@pytest.mark.parametrize("spoil", [RSA[:-1], RSA + b"\0", EC[:-3], PKCS8[:40], SSH[:-8], LOCKED[:-1]])
def test_broken_structures_are_left_alone(spoil):
    assert not secret_scan.findings(lines(spoil, "PRIVATE KEY")) and not secret_scan.findings(base64.b64encode(spoil).decode())


def test_values_of_any_length():
    r = random.Random(6)
    for n in [*range(16, 70), 100, 200, 256, 400]:
        for value in (base64.b64encode(r.randbytes(n)).decode(), r.randbytes(n).hex(), base64.urlsafe_b64encode(r.randbytes(n)).decode().rstrip("=")):
            assert [k for k, *_ in secret_scan.findings(f"aws_secret_access_key = '{value}'")] == ["assigned_key"], (n, value)
            assert not secret_scan.findings(f"sum = '{value}'")
    for decoy in ("some_long_function_name_here_and_more", "A" * 60, "abcdefgh" * 8, base64.b64encode(b"plain words of a sentence, and some more of them").decode(), "0123456789abcdef" * 4 + "0"):
        assert not secret_scan.findings(f"token: {decoy}"), decoy


def test_planted_among_decoys(spark):
    r = random.Random(4)
    url = lambda d: base64.urlsafe_b64encode(json.dumps(d).encode()).decode().rstrip("=")
    rows, want = [], []
    for k in range(120):
        text, at = "", []
        for _ in range(r.randint(0, 6)):
            text += " ".join(r.choice(["release", "notes", "sha256", "build", "é1"]) for _ in range(r.randint(1, 40))) + "\n"
            pick = r.randrange(6)
            secret, kind, lead = [(lines(RSA, "RSA PRIVATE KEY"), "private_key", ""), (f"{url({'alg': 'none'})}.{url({'n': r.random()})}.", "signed_token", "jwt "), (r.randbytes(32).hex(), "assigned_key", "api_key="), (r.randbytes(32).hex(), None, "sha256 "), (base64.b64encode(r.randbytes(60)).decode(), None, "data: "), (KEY_ID, "access_key_id", "id ")][pick]
            if kind:
                at.append((k, kind, len(text) + len(lead), len(text) + len(lead) + len(secret)))
            text += f"{lead}{secret}\n"
        rows.append((k, text))
        want += at
    got = secret_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((x["doc_id"], x["kind"], x["start"], x["stop"]) for x in got) == sorted(want) and want


@pytest.mark.parametrize("text", ["-----BEGIN RSA PRIVATE KEY-----\n" * 20_000, "a." * 300_000, "A" * 600_000, "ab" * 300_000, "eyJ." * 100_000, "key=\n" * 100_000, "0x" * 200_000, "-" * 600_000, "\n".join(f"api_key={k:064x}" for k in range(5000)), "key=" + base64.b64encode(der(0x30, b"".join(number(x) for x in (0, *[1 << 4_000_000] * 8)))[:200_000]).decode()])
def test_slow_texts(text):
    began = time.perf_counter()
    secret_scan.findings(text)
    assert time.perf_counter() - began < 5
