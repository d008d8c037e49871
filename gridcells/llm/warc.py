"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding whole WARC records, and a seek
table as its last (skippable) frame, so any Zstandard reader can read it from the start and a
reader that knows the table can begin at any frame.  The index maps record identifiers to
bundle, frame and offset within the frame.

Of pages with equal payloads of at least ``min_bytes`` bytes the one with the largest page_id is
a response and the others are revisits that refer to it and leave the payload out; smaller ones are all
responses.  Payloads are compared by SHA-1 and size.

Writing.  Only page ids and digests are grouped (a payload that a third of all pages share is combined before the
shuffle); pages then meet their page to refer to in one join by id, and each task writes its rows,
in order of id, as bundles of bounded size.  A bundle gets its name only when it is complete, and a task that
runs again writes the same names, so a lost executor leaves no half or double bundle.  Bundles
and index go below ``folder``, which all machines must share; any file system that pyarrow can open.

Cases.  A null html is an empty payload; a null url has no target header; rows with a null
page_id refer to the largest id with their payload, and are responses if there is none; repeated
rows each get a record, and all rows with the largest id are responses.  An empty table has no bundles.
A payload longer than a frame is one record of a longer frame; columns other than id, url and html are not written, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcells.llm.common import share_code

#: Fixed values of the seekable Zstandard format: magic of the skippable frame and of the seek table.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")      # the name space of URLs
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = ("record_id string, page_id bigint, record_type string, bundle string, frame int, frame_offset bigint, "
         "frame_bytes bigint, offset_in_frame bigint, record_bytes bigint")
RECORDS = ("record_id string, page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, "
           "payload_digest string, payload binary")


# ---- seekable bundles ----------------------------------------------------------------------

class BundleWriter:
    """Frames of at least ``frame_bytes`` bytes of whole records, then the seek table."""

    def __init__(self, out, frame_bytes: int, level: int = 3):
        self.out, self.frame_bytes, self.packer = out, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int]] = []
        self.written, self.parts, self.size = 0, [], 0

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset within it) of the record."""
        place = len(self.frames), self.size
        self.parts.append(record)
        self.size += len(record)
        if self.size >= self.frame_bytes:
            self.flush()
        return place

    def flush(self) -> None:
        if self.parts:
            frame = self.packer.compress(b"".join(self.parts))
            self.out.write(frame)
            self.frames.append((len(frame), self.size))
            self.written += len(frame)
            self.parts, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


def seek_table(tail: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, size) of every frame, from the end of a bundle."""
    n, flags, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    entry = 12 if flags & 0x80 else 8            # with checksums an entry has four more bytes
    out, at, begin = [], 0, len(tail) - 9 - n * entry
    if begin < 0:
        raise ValueError("the tail does not hold the whole seek table")
    for k in range(n):
        packed, size = struct.unpack_from("<II", tail, begin + k * entry)
        out.append((at, packed, size))
        at += packed
    return out


def frames(bundle: bytes) -> Iterator[bytes]:
    reader = zstandard.ZstdDecompressor()
    for at, packed, size in seek_table(bundle):
        yield reader.decompress(bundle[at:at + packed], max_output_size=size)


# ---- records -------------------------------------------------------------------------------

def record_id(page_id: int | None, digest: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page_id}:{digest.hex()}')}>"


def write_record(page_id, url, payload: bytes, refers_to, date: str) -> tuple[str, str, bytes]:
    """(identifier, type, bytes) of a page's record."""
    digest = hashlib.sha1(payload).digest()
    kind = "response" if refers_to is None else "revisit"
    name = record_id(page_id, digest)
    head = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", urllib.parse.quote(url, safe="".join(map(chr, range(33, 127))))))
    if page_id is not None:
        head.append(("WARC-Page-ID", str(page_id)))
    head.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()))
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)),
                 ("WARC-Refers-To-Page-ID", str(refers_to))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return name, kind, b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in raw.split(b"\r\n")[1:] if line)
    return {k.decode().lower(): v.strip().decode() for k, _, v in pairs}


def read_records(data: bytes) -> Iterator[dict]:
    """The records of a frame; a response's digest is checked against its payload."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = headers(data[at:end])
        block = data[end + 4:end + 4 + int(head["content-length"])]
        at = end + 4 + len(block) + 4
        cut = block.index(b"\r\n\r\n")
        payload, kind = block[cut + 4:], head["warc-type"]
        digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:"))
        if kind == "response" and hashlib.sha1(payload).digest() != digest:
            raise ValueError(f"{head['warc-record-id']}: the payload does not have its digest")
        number = lambda k: int(head[k]) if k in head else None
        url = head.get("warc-target-uri")
        yield {"record_id": head["warc-record-id"], "page_id": number("warc-page-id"),
               "url": None if url is None else urllib.parse.unquote(url) if "%" in url else url, "record_type": kind,
               "refers_to": number("warc-refers-to-page-id"),
               "payload_bytes": int(headers(block[:cut])["content-length"]), "payload_digest": digest.hex(),
               "payload": payload if kind == "response" else None}


# ---- jobs ----------------------------------------------------------------------------------

def with_references(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """``page_id, url, html, refers_to``; the last is null for responses."""
    none = F.lit(-(1 << 63))
    rows = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                        F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.coalesce("page_id", none)).withColumn("sha", F.sha1(F.encode("html", "utf-8")))
    small = rows.select("key", "page_id", "sha", F.octet_length("html").alias("size")).where(F.col("size") >= min_bytes)
    groups = (small.groupBy("sha", "size").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
              .where("n > 1 and refers_to is not null").drop("n"))
    others = (small.join(groups, ["sha", "size"]).where("key <> refers_to")
              .select("key", "sha", "refers_to").distinct())
    return rows.join(others, ["key", "sha"], "left").select("page_id", "url", "html", "refers_to", "key", "sha")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   min_bytes: int = 1000, frame_bytes: int = 1 << 18, bundle_bytes: int = 16 << 20,
                   date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write the bundles below ``folder``/bundles and return their index (kept in ``folder``/index)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pyarrow.fs.FileSystem.from_uri(f"{folder}/bundles")
        task, number, writer, rows, out, temporary = TaskContext.get(), 0, None, [], None, ""
        store.create_dir(base, recursive=True)

        def finish() -> pa.RecordBatch:
            writer.close()
            out.close()
            name = f"part-{task.partitionId():06d}-{number:04d}.warc.zst"
            store.move(temporary, f"{base}/{name}")
            at = [0]
            for packed, _ in writer.frames:
                at.append(at[-1] + packed)
            cols = list(zip(*((n, p, k, name, f, at[f], writer.frames[f][0], o, s) for n, p, k, f, o, s in rows), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, INDEX_TYPES, strict=True)],
                                              names=[x.split()[0] for x in INDEX.split(", ")])

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if writer is None:
                    temporary = f"{base}/_{uuid.uuid4().hex}"
                    out = store.open_output_stream(temporary)
                    writer, rows = BundleWriter(out, frame_bytes), []
                name, kind, record = write_record(page_id.as_py(), url.as_py(), html.as_py().encode(), refers_to.as_py(), date)
                rows.append((name, page_id.as_py(), kind, *writer.add(record), len(record)))
                if writer.written >= bundle_bytes:
                    yield finish()
                    writer, number = None, number + 1
        if writer is not None:
            yield finish()

    spark = pages.sparkSession
    share_code(spark)
    rows = with_references(pages, id_col, url_col, html_col, min_bytes).sortWithinPartitions("key", "sha", "url")
    rows.select("page_id", "url", "html", "refers_to").mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


INDEX_TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
RECORD_TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]


def as_batch(records: list[dict]) -> pa.RecordBatch:
    names = [x.split()[0] for x in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in records], t) for n, t in zip(names, RECORD_TYPES, strict=True)], names=names)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """All records of all bundles, frame by frame."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for frame in frames(content.as_buffer().to_pybytes()):
                    yield as_batch(list(read_records(frame)))

    share_code(spark)
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst")
             .option("recursiveFileLookup", "true").load(folder))
    return files.select("content").mapInArrow(run, RECORDS)


def fetch(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """The records of the index rows ``wanted``: reads only their frames."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pyarrow.fs.FileSystem.from_uri(f"{folder}/bundles")
        reader = zstandard.ZstdDecompressor()
        for batch in batches:
            found, held, frame = [], None, b""
            for r in batch.to_pylist():
                if held != (r["bundle"], r["frame"]):
                    with store.open_input_file(f"{base}/{r['bundle']}") as f:
                        frame = reader.decompress(f.read_at(r["frame_bytes"], r["frame_offset"]))
                    held = (r["bundle"], r["frame"])
                found += read_records(frame[r["offset_in_frame"]:r["offset_in_frame"] + r["record_bytes"]])
            yield as_batch(found)
    return wanted.repartition("bundle").sortWithinPartitions("bundle", "frame", "offset_in_frame").mapInArrow(run, RECORDS)
