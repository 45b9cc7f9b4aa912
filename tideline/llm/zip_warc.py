"""WARC archives packaged in ZIP files, written and read back by range.

An archive is a ZIP file of stored (uncompressed) members: archive/data.warc.gz holds WARC records, each a gzip member
of its own; indexes/index.cdxj has a line with offset and length for each record; datapackage.json names both. The
reader parses the end record, the ZIP64 records where they are needed, and the central directory, finds where the
members' bytes begin, reads the index, and then only the ranges of the records. Nothing is extracted.

Files are reached through pyarrow's file systems, so any folder that all executors share by a URI will do.

Null html is the empty payload. Of pages with equal payloads of `least` bytes or more the one with the largest page_id
is a response and the others revisit it; repeated rows of that page are responses too, and pages without page_id revisit
it. Equal payloads that all lack a page_id are all responses. Null urls are empty. An empty table gives no archive and
no rows. Only page_id, url and html are read, so columns of any other name change nothing. A very long page is held whole, one
at a time.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import new_path, staged

MEMBER, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
#: Bytes of records after which a task begins a further archive; bytes of consecutive records that are read at once.
ARCHIVE_BYTES, READ_BYTES = 256 << 20, 4 << 20
#: Bytes of records that a task reads, about.
TASK_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response with the payload, or a revisit with only the HTTP headers."""
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Target-URI: {url}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        *([] if refers_to is None else [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "surrogatepass").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def parse_record(data: bytes) -> dict:
    """A record's type, ids, and its payload's length and digest, both of the full payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    h = _headers(head)
    body = rest[: int(h["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length, digest = int(_headers(http)["content-length"]), h["warc-payload-digest"].removeprefix("sha1:")
    if h["warc-type"] == "response" and (len(payload) != length or base32_sha1(payload) != digest):
        raise ValueError(f"record {h['warc-record-id']}: the payload isn't what its headers say")
    number = lambda s: int(x) if s and (x := s.removeprefix("<urn:page:").removesuffix(">")) else None
    return {
        "page_id": number(h["warc-record-id"]),
        "url": h.get("warc-target-uri", ""),
        "payload": payload if h["warc-type"] == "response" else None,
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": h["warc-type"],
        "refers_to": number(h.get("warc-refers-to")),
    }


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Archive:
    """Writes one ZIP file; it gets its name only when it is whole."""

    def __init__(self, uri: str):
        self.fs, self.path = _file_system(uri)
        self.uri = uri
        self.out = self.fs.open_output_stream(self.path + ".part", compression=None)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(MEMBER, "w", force_zip64=True)
        self.size, self.lines = 0, []

    def add(self, page_id, record: bytes) -> None:
        packed = gzip.compress(record, 1, mtime=0)
        self.member.write(packed)
        self.lines.append(json.dumps({"page": page_id, "offset": self.size, "length": len(packed)}))
        self.size += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        with self.zip.open(INDEX, "w", force_zip64=True) as f:
            f.write("".join(x + "\n" for x in self.lines).encode())
        self.zip.writestr(PACKAGE, json.dumps({"profile": "data-package", "resources": [{"path": MEMBER}, {"path": INDEX}]}))
        self.zip.close()
        self.out.close()
        self.fs.move(self.path + ".part", self.path)
        return self.uri, len(self.lines), self.size


def _marked(pages: DataFrame, least: int) -> DataFrame:
    """page_id, url, payload, refers_to. Payloads that many pages share are handled apart from the join by digest, so no
    task gets all of them."""
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload")
    ).withColumn("_h", F.when(F.octet_length("payload") >= least, F.sha1("payload")))
    keys = base.select("page_id", "_h").filter("_h is not null")
    repeated = staged(keys.groupBy("_h").agg(F.max("page_id").alias("_max"), F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "repeated")
    total = keys.agg(F.count(F.lit(1))).first()[0]
    hot = repeated.filter(F.col("_n") > F.lit(max(1000, total // 1000))).select("_h", F.col("_max").alias("_hot"))  # 1000 rows at most
    cold = repeated.select(F.col("_h").alias("_k"), F.col("_max").alias("_cold"))
    # a hot page's key matches nothing and spreads the pages
    key = F.when(F.col("_hot").isNull(), F.coalesce("_h", F.concat(F.lit("-"), F.xxhash64("payload")))).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url")))
    joined = base.join(F.broadcast(hot), "_h", "left").withColumn("_k", key).join(cold, "_k", "left")
    best = F.coalesce("_hot", "_cold")
    return joined.select("page_id", "url", "payload", F.when(best.isNotNull() & ~F.col("page_id").eqNullSafe(best), best).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes pages (page_id, url, html) to ZIP files in a shared folder; (path, n_records, n_bytes) of each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        at, done = TaskContext.get().partitionId(), []
        archive = None
        for pdf in batches:
            for page_id, url, payload, refers_to in zip(pdf["page_id"].array, pdf["url"], pdf["payload"], pdf["refers_to"].array, strict=True):
                if archive is None:
                    # a name of its own for each attempt: the list of archives says which attempt counts
                    fs, path = _file_system(folder)
                    fs.create_dir(path, recursive=True)
                    archive = _Archive(f"{folder}/part-{at:05d}-{uuid.uuid4().hex}.wacz")
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                archive.add(page_id, warc_record(page_id, url, bytes(payload), refers_to))
                if archive.size >= ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = None
        if archive is not None:
            done.append(archive.close())
        yield pd.DataFrame(done, columns=["path", "n_records", "n_bytes"])

    return staged(_marked(pages, least).mapInPandas(run, "path string, n_records long, n_bytes long"), "archives")


def zip_members(f, size: int) -> dict[str, tuple[int, int]]:
    """Where the stored members' bytes are: name -> (offset, length). f: an open file that can seek and read."""

    def read(at: int, n: int) -> bytes:
        f.seek(at)
        return f.read(n)

    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\5\6")
    if end < 0:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    if 0xFFFF in (n,) or 0xFFFFFFFF in (length, start):
        locator = read(tail_at + end - 20, 20)
        if locator[:4] != b"PK\6\7":
            raise ValueError("no ZIP64 locator")
        record = read(struct.unpack("<Q", locator[8:16])[0], 56)
        if record[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end of central directory")
        n, length, start = struct.unpack("<QQQ", record[32:56])
    directory, at, found = read(start, length), 0, {}
    for _ in range(n):
        if directory[at : at + 4] != b"PK\1\2":
            raise ValueError("the central directory is broken")
        method = struct.unpack("<H", directory[at + 10 : at + 12])[0]
        packed, full = struct.unpack("<II", directory[at + 20 : at + 28])
        n_name, n_extra, n_comment = struct.unpack("<HHH", directory[at + 28 : at + 34])
        local = struct.unpack("<I", directory[at + 42 : at + 46])[0]
        name = directory[at + 46 : at + 46 + n_name].decode()
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n_field = struct.unpack("<HH", extra[:4])
            field = extra[4 : 4 + n_field]
            if kind == 1:  # ZIP64: only those that don't fit above, in this order
                if full == 0xFFFFFFFF:
                    full, field = struct.unpack("<Q", field[:8])[0], field[8:]
                if packed == 0xFFFFFFFF:
                    packed, field = struct.unpack("<Q", field[:8])[0], field[8:]
                if local == 0xFFFFFFFF:
                    local = struct.unpack("<Q", field[:8])[0]
            extra = extra[4 + n_field :]
        if method == 0:
            a, b = struct.unpack("<HH", read(local, 30)[26:30])
            found[name] = (local + 30 + a + b, packed)
        at += 46 + n_name + n_extra + n_comment
    return found


def _open(uri: str):
    fs, path = _file_system(uri)
    f = fs.open_input_file(path)
    return f, f.size()


def locate(archives: DataFrame, read_bytes: int = READ_BYTES) -> DataFrame:
    """(path, at, lengths): ranges of consecutive records, in bytes of the ZIP file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                rows: list[tuple] = []
                f, size = _open(path)
                with f:
                    members = zip_members(f, size)
                    f.seek(members[INDEX][0])
                    lines = f.read(members[INDEX][1]).splitlines()
                    base, at, lengths = members[MEMBER][0], None, []
                    for line in map(json.loads, lines):
                        if at is None or line["offset"] != at + sum(lengths) or sum(lengths) >= read_bytes:
                            if lengths:
                                rows.append((path, base + at, lengths))
                            at, lengths = line["offset"], []
                        lengths.append(line["length"])
                    if lengths:
                        rows.append((path, base + at, lengths))
                yield pd.DataFrame(rows, columns=["path", "at", "lengths"])

    return archives.select("path").mapInPandas(run, "path string, at long, lengths array<long>")


RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(ranges: DataFrame, payload: bool = True) -> DataFrame:
    """The records in the ranges, each read by its bytes alone."""
    schema = RECORD if payload else RECORD.replace("payload binary, ", "")
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, at, lengths in pdf.itertuples(index=False):
                f, _ = _open(path)
                with f:
                    f.seek(at)
                    data = f.read(int(sum(lengths)))
                rows, start = [], 0
                for n in map(int, lengths):
                    rows.append(parse_record(zlib.decompress(data[start : start + n], 31)))
                    start += n
                out = pd.DataFrame(rows)[columns]
                for c in ("page_id", "refers_to"):
                    out[c] = pd.array([None if pd.isna(x) else int(x) for x in out[c]], "Int64")
                yield out

    return ranges.mapInPandas(run, schema)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes pages to a new shared folder and reads all records back."""
    spark: SparkSession = pages.sparkSession
    archives = write_archives(pages, new_path(spark, "warc"), least)
    n, size = archives.agg(F.count(F.lit(1)), F.sum("n_bytes")).first()
    tasks = max(spark.sparkContext.defaultParallelism, (size or 0) // TASK_BYTES)
    ranges = locate(archives.repartition(max(1, min(n, tasks)), "path")).repartition(tasks, F.xxhash64("path", "at"))
    return read_records(ranges, payload=False).drop("url")
