"""WARC archives in ZIP packages: written by tasks, and read back by ranges without extraction.

A package holds archive/data.warc and indexes/index.cdxj, both stored uncompressed. Every task writes packages of about
PACKAGE_BYTES in the folder that driver and executors share, under a name with its attempt, and returns their names: what a
lost attempt left is never read. The reader finds the central directory (ZIP64 too) at a package's end, from it
the place of the stored members, reads the index and then the records by ranges of about RANGE_BYTES.

Of records whose payloads of at least REVISIT_BYTES are equal, the one with the smallest id is a response and the others
are revisits, whose HTTP head still tells the payload's length and whose digest header its SHA-256.

Defined cases: null payloads are empty; rows that share the smallest id are all responses; null ids are
responses; null urls leave the target out, line breaks in urls are percent-encoded.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import kept, modest, new_folder, small_side

PACKAGE_BYTES, RANGE_BYTES, REVISIT_BYTES = 64 << 20, 4 << 20, 100
SENT_DIGESTS = 200_000
DATA, INDEX = "archive/data.warc", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def record(page: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """What a record says: type, id, url, refers_to, payload (None for revisits), payload_bytes, digest (of the payload itself where it's there)."""
    head, _, block = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = block[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
    page = lambda s: int(m[1]) if s and (m := re.search(r"urn:page:(-?\d+)", s)) else None
    kind, told = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response":
        digest = hashlib.sha256(payload).hexdigest()
        if digest != told or len(payload) != size:
            raise ValueError("a payload differs from its digest or length")
    return {"id": page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": page(fields.get("warc-refers-to")), "payload": payload if kind == "response" else None, "payload_bytes": size, "payload_digest": told}


@dataclass
class Member:
    """A stored member of a package: its name, where its bytes begin, how many there are."""

    name: str
    start: int
    size: int


def members(file: pa.NativeFile, size: int) -> list[Member]:
    """The stored members that a package's central directory lists."""
    tail_at = max(0, size - 65_557)
    tail = file.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
        (end64,) = struct.unpack_from("<Q", tail, end - 12)
        count, length, start = struct.unpack_from("<QQQ", file.read_at(56, end64), 32)
    directory, at, out = file.read_at(length, start), 0, []
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, packed, full, n_name, n_extra, n_note = struct.unpack_from("<H8xIIHHH", directory, at + 10)
        (local,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + n_name].decode()
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:
                wide = [v for (v,) in struct.iter_unpack("<Q", extra[4 : 4 + n // 8 * 8])]
                full = wide.pop(0) if full == 0xFFFFFFFF else full
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                local = wide.pop(0) if local == 0xFFFFFFFF else local
            extra = extra[4 + n :]
        if method == 0:
            l_name, l_extra = struct.unpack_from("<HH", file.read_at(30, local), 26)
            out.append(Member(name, local + 30 + l_name + l_extra, full))
        at += 46 + n_name + n_extra + n_note
    return out


def write_packages(rows: DataFrame, folder: str) -> DataFrame:
    """path, n_records of the packages that hold the rows (id, url, payload, digest, size, refers_to)."""
    pafs.FileSystem.from_uri(folder)[0].create_dir(pafs.FileSystem.from_uri(folder)[1], recursive=True)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        context, made = TaskContext.get(), 0
        todo = (row for b in batches for part in range(0, b.num_rows, 64) for row in b.slice(part, 64).to_pylist())
        row = next(todo, None)
        while row is not None:
            path = f"{base}/part-{context.partitionId()}-{context.taskAttemptId()}-{made}.zip"
            index, at = [], 0
            with store.open_output_stream(path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                with z.open(DATA, "w", force_zip64=True) as data:
                    while row is not None and at < PACKAGE_BYTES:
                        raw = record(row["id"], row["url"], (row["payload"] or "").encode("utf-8", "surrogatepass"), row["digest"], row["size"], row["refers_to"])
                        data.write(raw)
                        index.append(json.dumps({"offset": at, "length": len(raw)}))
                        at += len(raw)
                        row = next(todo, None)
                z.writestr(INDEX, "\n".join(index))
            made += 1
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(index)], pa.int64())], names=["path", "n_records"])

    return modest(rows.select("id", "url", "payload", "digest", "size", "refers_to")).mapInArrow(task, "path string, n_records long")


def read_packages(packages: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """id, url, record_type, refers_to, payload_bytes, payload_digest (and payload) of every record of the packages (path)."""
    kinds = [("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())] + [("payload", pa.binary())] * payloads
    schema = "id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payloads

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        for path in (p for b in batches for p in b.column(0).to_pylist()):
            with store.open_input_file(path) as file:
                found = {m.name: m for m in members(file, file.size())}
                where, data = found[INDEX], found[DATA]
                lines = file.read_at(where.size, where.start).decode().split("\n")
                spots = [(x["offset"], x["length"]) for x in map(json.loads, filter(None, lines))]
                first = 0
                while first < len(spots):
                    last, begin = first, spots[first][0]
                    while last + 1 < len(spots) and sum(spots[last + 1]) - begin <= RANGE_BYTES:
                        last += 1
                    chunk = file.read_at(sum(spots[last]) - begin, data.start + begin)
                    got = [parse_record(chunk[o - begin : o - begin + n]) for o, n in spots[first : last + 1]]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in got], t) for k, t in kinds], names=[k for k, _ in kinds])
                    first = last + 1

    return modest(packages.select("path")).mapInArrow(task, schema)


def archive(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", sent_digests: int = SENT_DIGESTS) -> DataFrame:
    """The packages (path, n_records) written for df's rows."""
    payload = F.coalesce(F.col(f"`{payload_col}`"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"))
    rows = rows.select("id", "url", "payload", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    first = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("of"), "first")
    first = kept(first)
    rows = rows.join(small_side(first, first.count(), sent_digests), F.col("digest") == F.col("of"), "left")
    refers_to = F.when((F.col("size") >= REVISIT_BYTES) & (F.col("id") > F.col("first")), F.col("first"))
    return kept(write_packages(rows.withColumn("refers_to", refers_to), folder))


def round_trip(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """df's rows as the archive written from them tells them."""
    folder = new_folder(df.sparkSession, "warc")
    return read_packages(archive(df, folder, id_col, url_col, payload_col), folder).withColumnRenamed("id", id_col)
