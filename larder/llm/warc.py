"""WARC archives: reading, revisit resolution and writing of deduplicated archives.

Archives are read record by record as a stream, compressed or not; only headers are shuffled, by payload digest, and payloads are read
again where they lie when the new archives are written. Payload digests of responses are computed from the bytes (SHA-1, and
SHA-256 to tell payloads apart); what a header claims is used for revisits only, which have no payload. Of the responses with one
payload the earliest (date, then record id, then place) is the original; every other response of it becomes a revisit record that
refers to it. A revisit is of the payload of the response that it names, if that is there, else of the earliest response that
has or claims its digest; where no response has it, it stays as it is. Records of all other types are carried over. All
records get fresh headers: ids derived from the old ones, lengths and digests computed anew; a warcinfo opens each new archive
with the fields that the old one gave.

Archives are written by the tasks under names of their own attempt, and a manifest lists those of the attempts that counted: a task
that is run again leaves at most a file that no manifest names.

Defined results: a damaged or cut-off stretch of an archive is passed over up to the next record or gzip member, and read_headers
gives one row of type 'damaged' for it, which damage() counts. Records without an id get one from their place; records that share
id and payload are repeats of the first. Records without a digest, a date or a URI are kept. Of a record, the block is held in
memory at once; one archive is one task's work. Rows of pages that repeat (the same page_id, url and html) are one capture, and pages
that share only the id are captures of their own. Null or empty html is an empty payload; a null url is written as "about:blank";
null page_ids are captured as page -1. Empty tables give no archive. Other columns, whatever their names, aren't looked at.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.runtime import materialize, scratch_path, ship

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = "file string, at bigint, part int, size bigint, type string, record_id string, uri string, date string, digest string, refers_to string, payload string, payload_sha1 string"
WRITTEN = "record_id string, type string, uri string, date string, digest string, payload string, refers_to string, refers_to_uri string, refers_to_date string, archive string, at bigint, size bigint, path string"
_NAMES = {"type": "WARC-Type", "record_id": "WARC-Record-ID", "uri": "WARC-Target-URI", "date": "WARC-Date", "digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
_READ, _HEAD, _GZIP = 1 << 20, 1 << 20, b"\x1f\x8b\x08"
_COPIED = ("Content-Type", "WARC-Profile", "WARC-IP-Address", "WARC-Truncated", "WARC-Identified-Payload-Type", "WARC-Segment-Number", "WARC-Segment-Total-Length")
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes, level: int = 4) -> bytes:
    """One record as a gzip member of its own."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + z.flush()


def _place(path: str):
    if "://" not in path and not path.startswith("file:"):
        path = f"file://{path}"
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def _size(path: str) -> int:
    system, at = _place(path)
    return system.get_file_info(at).size or 0


def _open(path: str, mode: str):
    system, at = _place(path)
    if mode == "r":
        return system.open_input_stream(at, compression=None)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    return system.open_output_stream(at, compression=None)


def _fields(head: bytes) -> dict[str, str]:
    """Headers by lower-case name; of a name that is given again the values are joined by a space."""
    made: dict[str, str] = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.decode("utf-8", "replace").partition(":")
        k, v = k.strip().lower(), v.strip()
        made[k] = f"{made[k]} {v}" if k in made else v
    return made


class _Parser:
    """Records out of a stream of plain bytes, of which `limit` more at the most can follow."""

    def __init__(self) -> None:
        self.held, self.base = bytearray(), 0  # bytes that are in no record yet, and the place of the first

    def feed(self, more: bytes, limit: int | None, last: bool) -> Iterator[tuple[int, int, dict[str, str] | None, bytes]]:
        """(place, size, headers, block) of each record that is whole by now; headers are None for a damaged stretch."""
        held, at = self.held, 0
        held += more
        while True:
            k = held.find(b"WARC/", at)
            if k < 0:
                stop = len(held) if last else max(at, len(held) - 4)
                if held[at:stop].strip(b"\r\n\0"):
                    yield self.base + at, stop - at, None, b""
                at = stop
                break
            if held[at:k].strip(b"\r\n\0"):
                yield self.base + at, k - at, None, b""
            at, head = k, held.find(b"\r\n\r\n", k, k + _HEAD)
            if head < 0 and not last and len(held) - k < _HEAD:
                break
            headers = _fields(bytes(held[k:head])) if head >= 0 else {}
            n = headers.get("content-length", "")
            end = head + 4 + int(n) if n.isdigit() and len(n) < 18 else -1
            if 0 < end <= len(held):
                yield self.base + k, end - k, headers, bytes(held[head + 4 : end])
                at = end
            elif end > 0 and not last and (limit is None or end - len(held) <= limit):
                break
            else:  # no length, or more than there is: look for a record inside
                inner = held.find(b"WARC/", k + 5)
                at = inner if inner >= 0 else len(held)
                yield self.base + k, at - k, None, b""
        del held[:at]
        self.base += at


def read_records(path: str) -> Iterator[tuple[int, int, int, dict[str, str] | None, bytes]]:
    """(offset, number within the gzip member, size, headers by lower-case name, block) of each record, in order; headers are None
    for a damaged stretch."""
    hurt = None
    for at, part, size, headers, block in _stretches(path):
        if hurt and not (headers is None and at == hurt[0] + hurt[2]):
            yield hurt
            hurt = None
        if headers is None:
            hurt = (hurt[0], hurt[1], hurt[2] + size, None, b"") if hurt else (at, part, size, None, b"")
        else:
            yield at, part, size, headers, block
    if hurt:
        yield hurt


def _stretches(path: str) -> Iterator[tuple[int, int, int, dict[str, str] | None, bytes]]:
    with _open(path, "r") as f:
        size, rest, at = _size(path), f.read(_READ), 0
        if not rest.startswith(_GZIP):  # not compressed
            plain, done = _Parser(), len(rest)
            while True:
                for place, n, headers, block in plain.feed(rest, max(0, size - done), not rest):
                    yield place, 0, n, headers, block
                if not rest:
                    return
                rest = f.read(_READ)
                done += len(rest)
        while rest:
            if not rest.startswith(_GZIP):  # padding, or what follows a damaged member
                k = rest.find(_GZIP)
                while k < 0 and (more := f.read(_READ)):
                    gone, rest = rest[:-2], rest[-2:] + more
                    at += len(gone)
                    k = rest.find(_GZIP)
                if k < 0:
                    return
                rest, at = rest[k:], at + k
            z, plain, raw, part, sound = zlib.decompressobj(31), _Parser(), rest, 0, True
            used, seen = 0, []
            try:
                while not z.eof:
                    if not raw and not (raw := f.read(_READ)):
                        sound = False
                        break
                    out = z.decompress(raw)
                    seen.append(raw)
                    used += len(raw) - len(z.unused_data)
                    raw = z.unused_data
                    for _, n, headers, block in plain.feed(out, None, z.eof):
                        yield at, part, used if z.eof and part == 0 else n, headers, block
                        part += 1
                rest = raw
            except zlib.error:
                sound, seen = False, [*seen, raw]
            if not sound:  # the next member may begin inside of what was read
                yield at, part, 0, None, b""
                rest = b"".join(seen)[2:]
                used = 2
            elif not rest:
                rest = f.read(_READ)
            at += used


class Archive:
    """Archives of a task: a new one is begun when the last holds `most` bytes."""

    def __init__(self, folder: str, most: int = 256 << 20):
        c = TaskContext.get()
        self.folder, self.most, self.info = folder, most, b"format: WARC File Format 1.1\r\nsoftware: larder\r\n"
        self.tag = f"{c.partitionId():06d}-{c.taskAttemptId()}" if c else "000000-0"
        self.file, self.n, self.at, self.path = None, 0, 0, ""

    def write(self, member: bytes) -> tuple[str, int, int]:
        if self.file is None or self.at >= self.most:
            self.close()
            self.path = f"{self.folder}/part-{self.tag}-{self.n:04d}.warc.gz"
            self.file, self.n, self.at = _open(self.path, "w"), self.n + 1, 0
            name = self.path.rpartition("/")[2]
            lead = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], self.info)
            self.file.write(lead)
            self.at = len(lead)
        place = self.path, self.at, len(member)
        self.file.write(member)
        self.at += len(member)
        return place

    def close(self) -> None:
        if self.file:
            self.file.close()
            self.file = None


def _captured(folder: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Archive(folder)
        seen: dict[str, int] = {}
        for batch in batches:
            for page, url, html, digest, repeat in zip(*(batch.column(k).to_pylist() for k in range(5))):
                body = (html or "").encode()
                date = datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=max(page, 0) % 10**9)
                name = uuid.uuid5(_SPACE, f"page:{page}:{url}:{digest}")
                headers = [("WARC-Type", "revisit" if repeat else "response"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Target-URI", url or "about:blank"), ("WARC-Date", date.strftime("%Y-%m-%dT%H:%M:%SZ")), ("WARC-Payload-Digest", sha1(body)), ("Content-Type", "application/http; msgtype=response")]
                if repeat:
                    headers.append(("WARC-Profile", PROFILE))
                path, _, _ = out.write(record(headers, _HTTP % len(body) + (b"" if repeat else body)))
                seen[path] = seen.get(path, 0) + 1
        out.close()
        yield pa.RecordBatch.from_pydict({"path": pa.array(list(seen), pa.string()), "n_records": pa.array(list(seen.values()), pa.int64())})

    return run


def capture(pages: DataFrame, folder: str) -> DataFrame:
    """Write a crawl's archives of (page_id, url, html): a host's later captures of a payload it gave before are revisits, as
    a crawler writes them. Gives the manifest (path, n_records)."""
    ship(pages.sparkSession)
    rows = pages.select(F.coalesce(F.col("page_id").cast("bigint"), F.lit(-1)).alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    keys = rows.select("page_id", "url", "digest", host.alias("host")).distinct()
    first = keys.groupBy(F.col("host").alias("h"), F.col("digest").alias("g")).agg(F.min(F.struct("page_id", F.coalesce("url", F.lit("")).alias("url"))).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = (F.col("host") == F.col("h")) & (F.col("digest") == F.col("g")) & (F.struct("page_id", F.coalesce("url", F.lit("")).alias("url")) != F.col("first"))
    repeats = keys.join(materialize(first, "first-captures"), later).select(F.col("page_id").alias("p"), F.col("url").alias("u"), F.col("digest").alias("d"))
    copies = rows.groupBy("page_id", "url", "digest").agg(F.count("*").alias("c")).where("c > 1")
    if not copies.isEmpty():
        rows = rows.dropDuplicates(["page_id", "url", "digest"])
    repeats = materialize(repeats, "revisits")
    same = (F.col("page_id") == F.col("p")) & F.col("url").eqNullSafe(F.col("u")) & (F.col("digest") == F.col("d"))
    rows = rows.join(repeats, same, "left").select("page_id", "url", "html", "digest", F.col("d").isNotNull().alias("repeat")) if not repeats.isEmpty() else rows.withColumn("repeat", F.lit(False))
    return materialize(rows.mapInArrow(_captured(folder), "path string, n_records bigint"), "manifest")


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """What a record carries: of an HTTP message what follows its header, else the block."""
    if not headers.get("content-type", "").lower().startswith("application/http"):
        return block
    head, sep, body = block.partition(b"\r\n\r\n")
    return body if sep else block


def _headers(batches):
    kinds = {"at": pa.int64(), "part": pa.int32(), "size": pa.int64()}
    schema = pa.schema([(n := c.split()[0], kinds.get(n, pa.string())) for c in HEADERS.split(", ")])
    for batch in batches:
        for path in batch.column(0).to_pylist():
            rows = []
            for at, part, size, h, block in read_records(path):
                row = {"file": path, "at": at, "part": part, "size": size}
                if h is None:
                    rows.append(row | {"type": "damaged"})
                else:
                    row |= {k: h.get(v.lower()) for k, v in _NAMES.items()}
                    row["type"] = (row["type"] or "unknown").lower()
                    row["record_id"] = row["record_id"] or made_id(path, at, part)
                    if row["type"] == "response":
                        body = payload_of(h, block)
                        row |= {"payload": hashlib.sha256(body).hexdigest(), "payload_sha1": sha1(body)}
                    rows.append(row)
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema)


def read_headers(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """HEADERS of every record of the archives that the manifest's `path` column names, a task for each archive."""
    ship(spark)
    paths = materialize(manifest.select("path").distinct(), "archives")
    return paths.repartition(max(1, paths.count())).mapInArrow(_headers, HEADERS)


def damage(headers: DataFrame) -> DataFrame:
    """(file, n_damaged): the damaged stretches of each archive that has any."""
    return headers.where("type = 'damaged'").groupBy("file").agg(F.count("*").alias("n_damaged"))


def resolve(headers: DataFrame) -> DataFrame:
    """The records with `role`, and `original` (record_id, uri, date, payload, payload_sha1) where they repeat one.

    Roles: 'original' and 'repeat' of responses, 'revisit' and 'unresolved' of revisits, 'other' of the rest.
    """
    rows = headers.where("type <> 'damaged'")
    responses, revisits = rows.where("type = 'response'"), rows.where("type = 'revisit'")
    order = F.struct(F.coalesce("date", F.lit("")).alias("on"), "record_id", "file", "at", "part")
    found = F.struct("record_id", "uri", "date", "payload", "payload_sha1")
    first = responses.groupBy(F.col("payload").alias("p")).agg(F.min(order).alias("at_first"), F.min_by(found, order).alias("original"), F.count("*").alias("n"))
    first = materialize(first.where("n > 1"), "originals")  # what stands alone is its own original and needs no join
    known = responses.join(first, F.col("payload") == F.col("p"), "left")
    again = F.col("at_first").isNotNull() & (order != F.col("at_first"))
    known = known.withColumn("role", F.when(again, "repeat").otherwise("original")).withColumn("original", F.coalesce("original", found)).drop("p", "at_first", "n")
    known = materialize(known, "responses")
    claims = known.select(F.explode(F.array_distinct(F.array("payload_sha1", F.coalesce("digest", "payload_sha1")))).alias("c"), F.col("original").alias("by_claim"), order.alias("o"))
    claims = materialize(claims.groupBy("c").agg(F.min_by("by_claim", "o").alias("by_claim")), "claims")
    met = revisits.join(claims, F.col("digest") == F.col("c"), "left").drop("c")
    named = materialize(revisits.where("refers_to is not null").select(F.col("refers_to").alias("r")).distinct(), "named")
    if named.isEmpty():
        met = met.withColumn("by_name", F.lit(None).cast(known.schema["original"].dataType))
    else:
        target = known.join(named, F.col("record_id") == F.col("r"), "left_semi").groupBy(F.col("record_id").alias("r")).agg(F.min_by("original", order).alias("by_name"))
        met = met.join(target, F.col("refers_to") == F.col("r"), "left").drop("r")
    met = met.withColumn("original", F.coalesce("by_name", "by_claim")).drop("by_name", "by_claim")
    met = met.withColumn("role", F.when(F.col("original").isNotNull(), "revisit").otherwise("unresolved"))
    rest = rows.where("type not in ('response', 'revisit')").withColumn("role", F.lit("other")).withColumn("original", F.lit(None).cast(known.schema["original"].dataType))
    return known.unionByName(met).unionByName(rest)


def fresh_id(old: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, 'deduplicated:' + old)}>"


def made_id(path: str, at: int, part: int) -> str:
    """The id of a record that has none."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{path.rpartition("/")[2]}:{at}:{part}')}>"


def _rewritten(folder: str):
    def run(key, table):
        plan = {(r["at"], r["part"]): r for r in table.to_pylist()}
        out, rows, source = Archive(folder), [], key[0].as_py()
        for at, part, _, headers, block in read_records(source):
            p = plan.get((at, part))
            if p is None or headers is None:
                continue
            if p["type"] == "warcinfo" and out.file is None:
                out.info = block
                continue
            role, first, refers = p["role"], p["original"] or {}, None
            same = role == "repeat" and first["record_id"] == p["record_id"]  # the record itself over again
            new = fresh_id(f"{p['record_id']} {source.rpartition('/')[2]}:{at}:{part}" if same else p["record_id"])
            made = [("WARC-Type", "revisit" if role == "repeat" else p["type"]), ("WARC-Record-ID", new), ("WARC-Date", p["date"] or "1970-01-01T00:00:00Z")]
            if p["uri"] or p["type"] != "warcinfo":
                made.append(("WARC-Target-URI", p["uri"] or "about:blank"))
            made += [(n, headers[n.lower()]) for n in _COPIED if n.lower() in headers and not (role == "repeat" and n == "WARC-Profile")]
            made += [("WARC-Concurrent-To", fresh_id(i)) for i in headers.get("warc-concurrent-to", "").split()]
            digest = p["payload_sha1"] or first.get("payload_sha1") or p["digest"]
            if role == "repeat":
                made.append(("WARC-Profile", PROFILE))
                if headers.get("content-type", "").lower().startswith("application/http"):
                    head, sep, _ = block.partition(b"\r\n\r\n")
                    block = head + sep if sep else b""
                else:
                    block = b""
            if role in ("repeat", "revisit"):
                refers = fresh_id(first["record_id"])
                made += [("WARC-Refers-To", refers), ("WARC-Refers-To-Target-URI", first["uri"] or "about:blank"), ("WARC-Refers-To-Date", first["date"] or "1970-01-01T00:00:00Z")]
            elif p["refers_to"]:  # a revisit keeps its word on what isn't here; other records name records that are carried over
                refers = p["refers_to"] if role == "unresolved" else fresh_id(p["refers_to"])
                made += [("WARC-Refers-To", refers), *((n, headers[n.lower()]) for n in ("WARC-Refers-To-Target-URI", "WARC-Refers-To-Date") if n.lower() in headers)]
            made += [("WARC-Payload-Digest", digest)] * bool(digest) + [("WARC-Block-Digest", sha1(block))]
            path, place, size = out.write(record(made, block))
            if p["type"] != "warcinfo":
                rows.append({"record_id": new, "type": made[0][1], "uri": p["uri"], "date": p["date"], "digest": digest, "payload": p["payload"] or first.get("payload"), "refers_to": refers, "refers_to_uri": first.get("uri") if refers else None, "refers_to_date": first.get("date") if refers else None, "archive": path.rpartition("/")[2], "at": place, "size": size, "path": path})
        out.close()
        kinds = {"at": pa.int64(), "size": pa.int64()}
        return pa.Table.from_pylist(rows, pa.schema([(n := c.split()[0], kinds.get(n, pa.string())) for c in WRITTEN.split(", ")]))

    return run


def write_deduplicated(plan: DataFrame, folder: str) -> DataFrame:
    """WRITTEN: where each record of the new archives lies, but for their warcinfo records. One new archive for each old one, or
    more where it is large."""
    rows = plan.select("file", "at", "part", "type", "record_id", "uri", "date", "digest", "refers_to", "payload", "payload_sha1", "role", "original")
    return materialize(rows.groupBy("file").applyInArrow(_rewritten(folder), WRITTEN), "written")


def deduplicate(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """Read the manifest's archives, resolve revisits and write deduplicated archives to `folder`; gives WRITTEN."""
    headers = materialize(read_headers(spark, manifest), "warc-headers")
    return write_deduplicated(resolve(headers), folder)


def crawl_and_deduplicate(pages: DataFrame) -> DataFrame:
    """The pages as a crawl's archives, and these deduplicated: (type, uri, date, payload, refers_to_uri, refers_to_date) of every new record."""
    spark = pages.sparkSession
    manifest = capture(pages, scratch_path(spark, "crawl"))
    made = deduplicate(spark, manifest, scratch_path(spark, "archives"))
    return made.select("type", "uri", "date", "payload", "refers_to_uri", "refers_to_date")
