"""WARC archives in seekable Zstandard bundles."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqrank.llm.common import saved, shared_folder

#: Bytes of records that close a frame, and of a bundle that close a file. A larger record has a frame of its own.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 28
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"  # pages carry no date of capture

# Fixed values of the formats: skippable frame and seek table of seekable Zstandard, and WARC names.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
VERSION = b"WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, record_id string, record_type string, bundle string, frame int, frame_offset long, frame_bytes long, record_offset int, record_bytes int"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _quoted(url: str) -> str:
    """A url that fits on a header line and can be read back."""
    return re.sub(r"[\x00-\x20%\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _unquoted(url: str) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url)


def record_id(page_id: int | None, number: int) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:page:none:{number}>"


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None, number: int = 0) -> bytes:
    """A response record with the whole payload, or a revisit record that refers to an earlier one."""
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, number)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{payload_digest}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {_quoted(url)}")
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        body += payload
    else:
        head += [f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: {record_id(refers_to, 0)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return b"\r\n".join([VERSION, *(x.encode() for x in head)]) + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """The header, block and end of the record at ``at``."""
    stop = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:stop].split(b"\r\n")
    if first != VERSION:
        raise ValueError("not a WARC record")
    head = {k: v for k, _, v in (x.decode().partition(": ") for x in lines)}
    size = int(head["Content-Length"])
    return head, data[stop + 4 : stop + 4 + size], stop + 8 + size


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer: a skippable frame with the compressed and plain size of every frame."""
    entries = b"".join(struct.pack("<II", *f) for f in frames)
    return struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(frames), 0, SEEKABLE)


def read_seek_table(file: fs.FileSystem | pa.NativeFile, size: int) -> list[tuple[int, int]]:
    """(offset, compressed bytes) of every frame of an open bundle of ``size`` bytes, from its footer."""
    count, flags, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    entries = np.frombuffer(file.read_at(count * width, size - 9 - count * width), dtype="<u4").reshape(count, width // 4)[:, 0].astype(np.int64)
    return list(zip((np.cumsum(entries) - entries).tolist(), entries.tolist(), strict=True))


class _Bundle:
    """A file that is being written."""

    def __init__(self, folder: str, name: str):
        self.system, path = fs.FileSystem.from_uri(folder)
        self.system.create_dir(path, recursive=True)
        self.name = name
        self.out = self.system.open_output_stream(f"{path}/{name}", compression=None)
        self.frames: list[tuple[int, int]] = []
        self.offset = 0
        self.buffer: list[bytes] = []
        self.size = 0
        self.waiting: list[tuple] = []

    def add(self, row: tuple, data: bytes) -> None:
        self.waiting.append((*row, self.size, len(data)))
        self.buffer.append(data)
        self.size += len(data)

    def frame(self) -> list[tuple]:
        """Write what waits as a frame of its own; the index rows of its records."""
        if not self.buffer:
            return []
        data = zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(self.buffer))
        self.out.write(data)
        rows = [(*row[:3], self.name, len(self.frames), self.offset, len(data), *row[3:]) for row in self.waiting]
        self.frames.append((len(data), self.size))
        self.offset += len(data)
        self.buffer, self.waiting, self.size = [], [], 0
        return rows

    def close(self) -> None:
        self.out.write(seek_table(self.frames))
        self.out.close()


def uri(path: str) -> str:
    return f"file://{path}" if path.startswith("/") else path


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of every page whose payload a page with a larger id has too.

    Only ids and digests are moved. Groups of equal payloads are reduced before they are exchanged.
    """
    keys = pages.select("page_id", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("digest"))
    copies = keys.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return keys.join(copies, "digest").where("page_id < refers_to").distinct()


def write_archive(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write a record for every row of ``pages`` (page_id long, url, html) below ``folder``; the index.

    Of records whose payloads are equal and hold at least ``least_bytes`` bytes, the one with the
    largest page_id is a response and the others revisit it; smaller ones are all responses. Rows that
    repeat the largest page_id are all responses, and so is a page without an id.

    Every task writes bundles of its own: records in independent frames of about FRAME_BYTES and a
    footer with the seek table. A file's name holds a fresh random part, and the index is a table that
    only successful tasks add to: files of lost attempts are in no index row. The index maps each
    record to its bundle, frame, the frame's place in the file and the record's place in the frame.
    """
    spark = pages.sparkSession
    source = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    again = revisits(pages).where("digest is not null")
    keyed = source.withColumn("digest", F.sha1("payload"))
    joined = keyed.join(again, ["page_id", "digest"], "left").select("page_id", "url", "payload", F.when(F.length("payload") >= least_bytes, F.col("refers_to")).alias("refers_to"))
    folder = uri(folder)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names = [x.split()[0] for x in INDEX.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[x.split()[1]] for x in INDEX.split(", ")]

    def write(batches):
        task, bundle, rows = TaskContext.get().partitionId(), None, []
        number = 0
        for b in batches:
            for page_id, url, payload, refers_to in zip(*(b.column(k) for k in range(4)), strict=True):
                page_id, url, payload, refers_to = page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py()
                if bundle is None:
                    bundle = _Bundle(folder, f"pages-{task:06d}-{uuid.uuid4().hex}.warc.zst")
                number += 1
                data = record(page_id, url, payload, digest(payload), refers_to, (task << 40) + number)
                bundle.add((page_id, record_id(page_id, (task << 40) + number), "response" if refers_to is None else "revisit"), data)
                if bundle.size >= FRAME_BYTES:
                    rows += bundle.frame()
                if bundle.offset >= BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
            if len(rows) > 10_000:
                yield batch(rows)
                rows = []
        if bundle is not None:
            rows += bundle.frame()
            bundle.close()
        if rows:
            yield batch(rows)

    return saved(joined.mapInArrow(write, INDEX))[0]


RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_archive(spark: SparkSession, index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records that ``index`` rows name, read from their frames below ``folder``.

    Files are found by name in the index, frames by the seek table in each file's footer, which must
    agree with the index; each frame is read and decompressed on its own, so that any part of an index
    (some ids, say) reads only the frames that it needs. A response's length and digest are those of the
    payload that was read, which must equal its header's; a revisit, which holds no payload, has them from
    its header.
    """
    folder = uri(folder)
    frames = index.groupBy("bundle", "frame", "frame_offset", "frame_bytes").agg(F.collect_list("record_offset").alias("offsets"))
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def read(batches):
        system, path = fs.FileSystem.from_uri(folder)
        name, file, table = None, None, []
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            for bundle, frame, offset, size, offsets in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bundle != name:
                    if file:
                        file.close()
                    name, file = bundle, system.open_input_file(f"{path}/{bundle}")
                    table = read_seek_table(file, file.size())
                if table[frame] != (offset, size):
                    raise ValueError(f"{bundle}: the index and the seek table differ on frame {frame}")
                data = unzip.decompress(file.read_at(size, offset))
                rows = [_read(data, at, with_payload) for at in sorted(offsets)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        if file:
            file.close()

    return frames.sortWithinPartitions("bundle", "frame").mapInArrow(read, RECORDS)


def _read(data: bytes, at: int, with_payload: bool) -> tuple:
    head, block, _ = parse(data, at)
    http, _, payload = block.partition(b"\r\n\r\n")
    own, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(re.search(rb"Content-Length: (\d+)", http)[1])
    revisit = head["WARC-Type"] == "revisit"
    if not revisit:
        if digest(payload) != own or len(payload) != size:
            raise ValueError(f"{head['WARC-Record-ID']}: the payload is damaged")
        own, size = digest(payload), len(payload)
    page_id = int(head["X-Page-ID"]) if "X-Page-ID" in head else None
    url = _unquoted(head["WARC-Target-URI"]) if "WARC-Target-URI" in head else None
    refers = int(head["WARC-Refers-To"][len("<urn:page:") : -1]) if revisit else None
    return page_id, url, head["WARC-Type"], refers, size, own, payload if with_payload and not revisit else None


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of every page, read back from an archive.

    Null html is an empty payload; null ids and urls and repeated rows are kept; other columns are
    ignored; an empty table writes no file and gives no rows.
    """
    spark = pages.sparkSession
    folder = shared_folder(spark)
    back = read_archive(spark, write_archive(pages, folder), folder, with_payload=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
