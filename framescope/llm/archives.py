"""WARC records in ZIP-packaged archives: writing them, and reading them by range without extraction.

An archive is a ZIP file whose members are all stored: ``archive/data.warc.gz`` (one gzip member a record),
``indexes/index.cdxj`` (one line a record, with its offset and length) and ``datapackage.json``. The reader takes the
end of the file, parses the end record, the ZIP64 end record where there is one, and the central directory, finds the
index, and reads each record by its own range.

Archives go to the folder that driver and executors share. A task names its files after its attempt, so that a retry
never overwrites a file which an earlier attempt has reported.

Of records with equal payloads the one with the smallest id is a ``response``; the others are ``revisit`` records that
carry no payload, only its digest, its length and the id they refer to.

Defined results: a null payload counts as empty; empty payloads are deduplicated like any other. A null id is written
as ``none`` and read back as null; it counts as larger than every id, and if all ids of a payload are null, each record
is a response. Rows that repeat the smallest id are all responses. A null URL is left out of the record. An empty table
gives no archives and an empty result. An archive holds pages: columns other than id, URL and payload aren't written,
whatever their names, and can be joined to what is read by ``page_id``.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framescope.llm.common import flat_map, materialize, quoted, shared_dir

# Fixed values of the ZIP format: signatures and the values that stand for "see the ZIP64 field".
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
BIG16, BIG32 = 0xFFFF, 0xFFFFFFFF
WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- WARC records ---------------------------------------------------------------------------------------------------


def _clean(value: str) -> str:
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in value)


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, size: int | None = None) -> bytes:
    """A response record, or with ``refers_to`` a revisit record that holds the HTTP header alone. ``size`` is the
    payload's length where the payload itself isn't at hand."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if size is None else size}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    pairs = (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _page(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


def parse_record(data: bytes) -> dict[str, Any]:
    """The fields of one record; a response's digest and length come from its payload, a revisit's from its headers."""
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = _fields(head)
    block = rest[: int(warc["content-length"])]
    http_head, _, payload = block.partition(b"\r\n\r\n")
    http = _fields(http_head)
    kind = warc["warc-type"]
    stated = warc.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "revisit":
        length, digest, body = int(http["content-length"]), stated, None
    else:
        length, digest, body = len(payload), payload_digest(payload), payload
        if stated and stated != digest:
            raise ValueError(f"record {warc.get('warc-record-id')}: its payload has another digest than stated")
    return {"page_id": _page(warc.get("warc-record-id")), "url": warc.get("warc-target-uri"), "record_type": kind, "payload": body, "payload_bytes": length, "payload_digest": digest, "refers_to": _page(warc.get("warc-refers-to"))}


# --- ZIP ------------------------------------------------------------------------------------------------------------


def zip_of(members: Iterable[tuple[str, bytes]]) -> bytes:
    """A ZIP file of stored members, all with ZIP64 sizes and offsets, so that any size takes the same path."""
    out, directory, count = bytearray(), bytearray(), 0
    for name, data in members:
        label, crc, at = name.encode(), zlib.crc32(data), len(out)
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data))
        out += LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x800, 0, 0, 0x21, crc, BIG32, BIG32, len(label), len(extra)) + label + extra + data
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at)
        directory += CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x800, 0, 0, 0x21, crc, BIG32, BIG32, len(label), len(extra), 0, 0, 0, 0, BIG32) + label + extra
        count += 1
    at, end = len(out), len(out) + len(directory)
    out += directory
    out += END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, len(directory), at)
    out += LOCATOR64 + struct.pack("<IQI", 0, end, 1)
    out += END + struct.pack("<HHHHIIH", 0, 0, BIG16, BIG16, BIG32, BIG32, 0)
    return bytes(out)


class ZipRanges:
    """The stored members of a ZIP file, read by range through ``read_at(offset, length)``."""

    def __init__(self, read_at: Callable[[int, int], bytes], size: int) -> None:
        self.read_at = read_at
        self.members = {name: (at, length) for name, at, length, method in self._directory(size) if method == 0}

    def _directory(self, size: int) -> Iterator[tuple[str, int, int, int]]:
        tail_at = max(0, size - 22 - BIG16)
        tail = self.read_at(tail_at, size - tail_at)
        k = tail.rfind(END)
        while k >= 0 and (k + 22 > len(tail) or k + 22 + struct.unpack_from("<H", tail, k + 20)[0] != len(tail)):
            k = tail.rfind(END, 0, k)
        if k < 0:
            raise ValueError("no end record: not a ZIP file")
        count, length, at = struct.unpack_from("<HII", tail, k + 10)
        if BIG16 == count or BIG32 in (length, at):
            place = tail_at + k - 20
            locator = self.read_at(place, 20) if place >= 0 else b""
            if locator[:4] != LOCATOR64:
                raise ValueError("the end record points to a ZIP64 record that isn't there")
            end64 = self.read_at(struct.unpack_from("<Q", locator, 8)[0], 56)
            if end64[:4] != END64:
                raise ValueError("no ZIP64 end record where the locator points")
            count, length, at = struct.unpack_from("<QQQ", end64, 32)
        data, k = self.read_at(at, length), 0
        for _ in range(count):
            if data[k : k + 4] != CENTRAL:
                raise ValueError("the central directory is damaged")
            method, packed, full, n, extra_n, comment_n, local = (struct.unpack_from(f, data, k + o)[0] for f, o in (("<H", 10), ("<I", 20), ("<I", 24), ("<H", 28), ("<H", 30), ("<H", 32), ("<I", 42)))
            name = data[k + 46 : k + 46 + n].decode("utf-8", "replace")
            extra, e = data[k + 46 + n : k + 46 + n + extra_n], 0
            while e + 4 <= len(extra):  # the ZIP64 field holds only the values that didn't fit
                tag, width = struct.unpack_from("<HH", extra, e)
                if tag == 1:
                    wide = list(struct.unpack_from(f"<{width // 8}Q", extra, e + 4))
                    full = wide.pop(0) if full == BIG32 else full
                    packed = wide.pop(0) if packed == BIG32 else packed
                    local = wide.pop(0) if local == BIG32 else local
                e += 4 + width
            yield name, local, packed, method
            k += 46 + n + extra_n + comment_n

    def start(self, name: str) -> int:
        """Where the bytes of a member begin."""
        local = self.members[name][0]
        head = self.read_at(local, 30)
        if head[:4] != LOCAL:
            raise ValueError(f"no local header for {name}")
        n, extra = struct.unpack_from("<HH", head, 26)
        return local + 30 + n + extra

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        return self.read_at(self.start(name) + offset, self.members[name][1] - offset if length is None else length)


def records_of(archive: ZipRanges) -> Iterator[dict[str, Any]]:
    """Records by the archive's indexes; a WARC member without an index is walked through from its start."""
    listed = set()
    for name in sorted(archive.members):
        if name.startswith("indexes/") and name.endswith(".cdxj"):
            starts: dict[str, int] = {}
            for line in archive.read(name).split(b"\n"):
                if line.strip():
                    entry = json.loads(line.split(b" ", 2)[2])
                    member = f"archive/{entry['filename']}"
                    listed.add(member)
                    if member not in starts:
                        starts[member] = archive.start(member)
                    data = archive.read_at(starts[member] + int(entry["offset"]), int(entry["length"]))
                    record = parse_record(gzip.decompress(data) if member.endswith(".gz") else data)
                    yield record | ({"url": entry["url"]} if "url" in entry else {})
    for name in sorted(archive.members):
        if name.startswith("archive/") and name.endswith(".warc.gz") and name not in listed:
            at, (_, size), start = 0, archive.members[name], archive.start(name)
            while at < size:
                unpack, out, step = zlib.decompressobj(31), bytearray(), at
                while not unpack.eof and step < size:
                    part = archive.read_at(start + step, min(1 << 16, size - step))
                    out += unpack.decompress(part)
                    step += len(part)
                at = step - len(unpack.unused_data)
                yield parse_record(bytes(out))


# --- Spark ----------------------------------------------------------------------------------------------------------


def _archive(rows: list[tuple]) -> bytes:
    data, index = bytearray(), []
    for page_id, url, payload, digest, refers_to, *length in rows:
        packed = gzip.compress(make_record(page_id, url, payload, digest, refers_to, *length), 1, mtime=0)
        entry = {"filename": WARC_MEMBER.removeprefix("archive/"), "offset": str(len(data)), "length": str(len(packed)), "digest": f"sha1:{digest}"} | ({"url": url} if url is not None else {})
        index.append(f"page:{'none' if page_id is None else page_id} 20240101000000 {json.dumps(entry)}\n")
        data += packed
    about = json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "records": len(rows)})
    return zip_of([(WARC_MEMBER, bytes(data)), (INDEX_MEMBER, "".join(index).encode()), ("datapackage.json", about.encode())])


@F.pandas_udf(T.StringType())
def digest_of(payloads: pd.Series) -> pd.Series:
    return pd.Series([payload_digest((p or "").encode("utf-8", "surrogatepass")) for p in payloads], dtype=object)


def referred(rows: DataFrame, hot_rows: int) -> DataFrame:
    """``rows`` (page_id, url, payload, digest) with ``refers_to``, the smallest id of its payload unless it is its own.

    Digests meet their smallest ids in a join, payloads of unknown role with them. At most ``hot_rows`` digests are
    held by more than 1 in ``hot_rows`` rows; these get their id from a broadcast, drop the payload of each revisit on
    the spot, and are dealt out by id.
    """
    groups = materialize(rows.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1"), "digests")
    total = rows.count()
    hot = groups.where(F.col("n") * hot_rows > total).select(F.col("digest").alias("hot_digest"), F.col("first_id").alias("hot_id"))
    groups = groups.where(F.col("n") * hot_rows <= total).select(F.col("digest").alias("key"), "first_id")
    seen = rows.join(F.broadcast(hot), F.col("digest") == F.col("hot_digest"), "left")
    is_hot = F.col("hot_digest").isNotNull()
    revisit = F.col("hot_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("hot_id"))
    key = F.when(is_hot, F.concat(F.lit("#"), F.xxhash64("page_id", "url").cast("string"))).otherwise(F.col("digest"))
    size = F.coalesce(F.octet_length("payload"), F.lit(0)).cast("long")
    seen = seen.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "digest", size.alias("size"), "hot_id", key.alias("key"))
    first = F.coalesce("hot_id", "first_id")
    refers_to = F.when(first.isNotNull() & ~F.col("page_id").eqNullSafe(first), first)
    return seen.join(groups, "key", "left").select("page_id", "url", "payload", "digest", refers_to.alias("refers_to"), "size")


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", archive_bytes: int = 8 << 20, hot_rows: int = 1000) -> DataFrame:
    """Write a record per row; a table with ``path`` and ``records`` of each archive. Archives hold about
    ``archive_bytes`` of payloads, or one larger record. A payload that more than 1 in ``hot_rows`` rows hold isn't
    moved by its digest."""
    root = f"{shared_dir(pages.sparkSession).rstrip('/')}/archives-{uuid.uuid4().hex}"
    rows = pages.select(quoted(id_col).cast("long").alias("page_id"), quoted(url_col).cast("string").alias("url"), quoted(payload_col).cast("string").alias("payload"))
    marked = referred(rows.withColumn("digest", digest_of("payload")), hot_rows)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        label = f"{context.partitionId():06d}-{context.taskAttemptId()}" if context else uuid.uuid4().hex
        files, folder = fs.FileSystem.from_uri(root)
        paths: list[str] = []
        counts: list[int] = []
        held: list[tuple] = []
        size = 0

        def flush() -> None:
            name = f"part-{label}-{len(paths):05d}.wacz"
            files.create_dir(folder, recursive=True)
            with files.open_output_stream(f"{folder}/{name}") as out:
                out.write(_archive(held))
            paths.append(f"{root}/{name}")
            counts.append(len(held))
            held.clear()

        for batch in batches:
            for page_id, url, text, digest, refers_to, length in zip(*(c for c in batch.columns), strict=True):
                payload = (text.as_py() or "").encode("utf-8", "surrogatepass")
                held.append((page_id.as_py(), url.as_py(), payload, digest.as_py(), refers_to.as_py(), length.as_py()))
                size += len(payload)
                if size >= archive_bytes:
                    flush()
                    size = 0
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], ["path", "records"])

    return materialize(marked.mapInArrow(write, "path string, records long"), "archive-list")


def read_archives(archives: DataFrame, path_col: str = "path", with_payload: bool = True) -> DataFrame:
    """The records of the archives that ``archives`` lists: ``page_id``, ``url``, ``record_type``, ``payload_bytes``,
    ``payload_digest``, ``refers_to`` and, if asked for, ``payload`` (null for a revisit)."""
    kinds = [("page_id", T.LongType()), ("url", T.StringType()), ("record_type", T.StringType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("refers_to", T.LongType())]
    kinds += [("payload", T.BinaryType())] * with_payload

    def make() -> Callable[[Any], Iterable[tuple]]:
        def read(path: str) -> Iterator[tuple]:
            files, name = fs.FileSystem.from_uri(path)
            with files.open_input_file(name) as file:
                for record in records_of(ZipRanges(lambda at, n: file.read_at(n, at), file.size())):
                    yield tuple(record[k] for k, _ in kinds)

        return read

    tasks = max(2, 2 * archives.sparkSession.sparkContext.defaultParallelism, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return flat_map(archives.repartition(tasks), path_col, [], [T.StructField(k, t) for k, t in kinds], make)
