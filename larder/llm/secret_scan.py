r"""Secret scans by structure: a candidate is decoded and its inside parsed before it is reported.

Kinds reported:
  signed_token     three base64url parts, the first a JSON object with an "alg" string, the second a JSON object
  private_key      DER of PKCS#1, SEC 1, PKCS#8 or encrypted PKCS#8, from PEM, bare base64 or hex: tags and nested lengths
                   must fill the bytes exactly, and the parts must be those of the kind
  openssh_key      openssh-key-v1: magic, then length-prefixed strings that fill the bytes, as the format nests them
  access_key_id    AKIA or ASIA and 16 characters that decode as base32 to an account number of twelve digits
  assigned_key     hex or base64 of 16 varied bytes or more, assigned to a name that says key, token or secret; varied means 0.65
                   or more of the distinct values that so many random bytes have on average, and written in three
                   or more of upper case, lower case, digits and other signs (hex: in digits and letters), which lengths
                   of 16, 20, 24, 32, 48 and 64 bytes needn't be
Anything else (digests in running text, base64 without a structure, passwords) isn't reported.

Defined results: null or empty texts hold no secret. Each row is scanned by itself, repeated rows and null doc_ids included. One
row is returned for each finding, in the order of the text; where findings overlap, the kind that is first in PEM, token, key id,
hex, base64 stays. Texts of any length are scanned whole in time that is linear in their length; a modulus of more than 65,536 bits is
no key. Offsets count characters; the value is never returned, only its
length and a SHA-256 of it. Other columns, whatever their names, aren't looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.textual import slices
from larder.runtime import ship

FOUND = "doc_id bigint, kind string, start int, stop int, n_bytes int, digest string"
# Any reportable value holds one of these; the JVM rules out the other texts before a byte goes to Python.
GATE = r"[A-Za-z0-9+/_=-]{22,}|(?:AKIA|ASIA)[A-Z2-7]{16}|-----BEGIN"
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,}+)\.([A-Za-z0-9_-]{2,}+)\.([A-Za-z0-9_-]*+)")
_MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
_HEX = re.compile(r"(?:(?<![0-9A-Za-z+/_-])|(?<=(?<![0-9A-Za-z+/_-])0[xX]))(?:[0-9a-fA-F]{2}){16,}+(?![0-9A-Za-z+/_=-])")
_B64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/]{22,}+(?![_-])|[A-Za-z0-9_-]{22,}+)={0,2}+(?![A-Za-z0-9+/_=-])")
_KEY_ID = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)([A-Z2-7]{16})(?![A-Za-z0-9])")
_NAMED = re.compile(r"(?:key|token|secret|credential|passwd|password)[\w.\-]*[\"']?\s{0,3}(?::=|=>|[:=])\s{0,3}[\"']?(?:0x)?$", re.I)
_RAW = {16, 20, 24, 32, 48, 64}
_CLASSES = [re.compile(x) for x in ("[a-z]", "[A-Z]", "[0-9]", "[+/_-]")]


def tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the value of a DER element; None unless its length is minimal and inside `end`."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end or data[at] == 0:
            return None
        n, at = int.from_bytes(data[at : at + k], "big"), at + k
        if n < 128:
            return None
    return (tag, at, at + n) if at + n <= end else None


def parts(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill data[at:end] exactly."""
    out = []
    while at < end:
        x = tlv(data, at, end)
        if x is None:
            return None
        out.append(x)
        at = x[2]
    return out


def private_der(data: bytes) -> bool:
    """Whether the bytes are exactly one private key in DER."""
    top = tlv(data, 0, len(data))
    if not top or top[0] != 0x30 or top[2] != len(data) or not (inner := parts(data, top[1], top[2])):
        return False
    tags = [t for t, _, _ in inner]
    value = lambda i: data[inner[i][1] : inner[i][2]]
    if tags == [2] * 9 and value(0) in (b"\0", b"\1"):  # PKCS#1: version and eight numbers, the modulus the product of the primes
        if len(value(1)) > 8193:
            return False
        n, p, q = (int.from_bytes(value(i), "big") for i in (1, 4, 5))
        return n > 1 and p * q == n
    if tags[:2] == [2, 4] and value(0) == b"\1" and set(tags[2:]) <= {0xA0, 0xA1}:  # SEC 1
        return len(value(1)) in (20, 24, 28, 32, 48, 66) and all(parts(data, a, b) for _, a, b in inner[2:])
    if tags[:3] == [2, 0x30, 4] and value(0) in (b"\0", b"\1") and set(tags[3:]) <= {0xA0, 0xA1, 0x81}:  # PKCS#8
        algorithm = parts(data, inner[1][1], inner[1][2])
        return bool(algorithm) and algorithm[0][0] == 6 and bool(parts(value(2), 0, len(value(2))))
    if tags == [0x30, 4]:  # encrypted PKCS#8: an algorithm of the PKCS#5 or PKCS#12 family, and the ciphertext
        algorithm = parts(data, inner[0][1], inner[0][2])
        return bool(algorithm) and len(algorithm) == 2 and data[algorithm[0][1] : algorithm[0][2]].startswith(b"\x2a\x86\x48\x86\xf7\x0d\x01") and algorithm[1][0] == 0x30
    return False


def openssh(data: bytes) -> bool:
    """Whether the bytes are one openssh-key-v1 file whose nested strings fill it."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def string(at: int) -> tuple[bytes, int] | None:
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at : at + 4], "big")
        return (data[at + 4 : at + 4 + n], at + 4 + n) if at + 4 + n <= len(data) else None

    for _ in range(3):  # cipher, derivation, its options
        if (x := string(at)) is None:
            return False
        at = x[1]
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not 1 <= keys <= 64:
        return False
    for _ in range(keys + 1):  # public keys, then the private part
        if (x := string(at)) is None:
            return False
        at = x[1]
    return at == len(data) and len(x[0]) % 8 == 0 and len(x[0]) > 0


def unbase64(text: str) -> bytes | None:
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except binascii.Error:
        return None


def _object(part: str) -> dict | None:
    data = unbase64(part)
    try:
        made = json.loads(data) if data and data[:1] == b"{" else None
    except (ValueError, RecursionError):
        return None
    return made if isinstance(made, dict) else None


def _kind(data: bytes | None) -> str | None:
    if not data:
        return None
    return "private_key" if private_der(data) else "openssh_key" if openssh(data) else None


def varied(data: bytes, text: str) -> bool:
    """Whether a decoded value is like random bytes, as the head of this module states it."""
    n = len(data)
    if n < 16 or len(set(data)) < 0.65 * 256 * (1 - (255 / 256) ** n):
        return False
    return n in _RAW or sum(bool(c.search(text)) for c in _CLASSES) >= (2 if len(text) == 2 * n else 3)


def pem(text: str) -> list[tuple[int, int, int, int]]:
    """(start, stop, body start, body stop) of each private key block: a mark that opens one, and the next mark, which closes it."""
    out, open_ = [], None
    for m in _MARK.finditer(text):
        if m[1] == "END" and open_ is not None and open_[2] == m[2]:
            out.append((open_.start(), m.end(), open_.end(), m.start()))
        open_ = m if m[1] == "BEGIN" else None
    return out


def findings(text: str) -> list[tuple[str, int, int, int, str]]:
    """(kind, start, stop, bytes, digest of the value) of each confirmed secret, in order and without overlaps."""
    out: list[tuple[int, int, str, int, str]] = []  # in order

    def add(kind: str, start: int, stop: int, data: bytes) -> None:
        k = bisect.bisect_left(out, (start,))
        if (k == 0 or out[k - 1][1] <= start) and (k == len(out) or stop <= out[k][0]):
            out.insert(k, (start, stop, kind, len(data), hashlib.sha256(data).hexdigest()))

    for start, stop, a, b in pem(text):
        body = re.sub(r"^(?:[A-Za-z-]+:.*\n)+|\\n|\s", "", text[a:b].lstrip(), flags=re.M)
        if (data := unbase64(body)) and (kind := _kind(data)):
            add(kind, start, stop, data)
    for m in _TOKEN.finditer(text):
        head = _object(m[1])
        if head and isinstance(head.get("alg"), str) and _object(m[2]) is not None:
            add("signed_token", *m.span(), m[0].encode())
    for m in _KEY_ID.finditer(text):
        account = (int.from_bytes(base64.b32decode(m[1])[:6], "big") & 0x7FFFFFFFFF80) >> 7
        if account < 10**12:
            add("access_key_id", *m.span(), m[0].encode())
    for pattern, decode in ((_HEX, bytes.fromhex), (_B64, unbase64)):
        for m in pattern.finditer(text):
            data = decode(m[0])
            if not data:
                continue
            kind = _kind(data)
            if not kind and varied(data, m[0]) and _NAMED.search(text, max(0, m.start() - 80), m.start()):
                kind = "assigned_key"
            if kind:
                add(kind, *m.span(), data)
    return [(kind, start, stop, n, digest) for start, stop, kind, n, digest in out]


def _scan(batches):
    import pyarrow as pa

    schema = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("n_bytes", pa.int32()), ("digest", pa.string())])
    for batch in batches:
        for part in slices(batch, "text"):
            rows = [dict(zip(schema.names, (i, *f))) for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()) for f in findings(t)]
            yield pa.RecordBatch.from_pylist(rows, schema)


def scan(docs: DataFrame) -> DataFrame:
    """One row (FOUND) for each confirmed secret."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.where(F.col("text").rlike(GATE)).mapInArrow(_scan, FOUND)
