"""WARC archives of pages, compressed record by record with a dictionary of their own.

An archive (``.warc.zst``) starts with a skippable Zstandard frame that holds the dictionary with which all its records are compressed, each
as a frame by itself, so that one record can be read by its place and length alone.  The dictionary is built from the archive's own first
``train_bytes`` of records (a bound on what a task holds; all records are archived); an archive with too few to build one from has none.

Of pages with equal payloads of at least ``least`` bytes the one with the smallest id is a response, the others revisit it: they carry headers
and the payload's length and digest, but not the payload.  Digests are summed up by Spark before anything is written, one row for each
repeated payload; these go to every task if there are few, else both sides are dealt by digest and salt, so copies of one page are no hot key.

Every task attempt writes archives under names of its own, moved into place when they are whole, and returns a row for each record; these rows, written by
Spark's own commit, are the index.  Only archives that the index names are read, so what a lost or repeated attempt left counts for nothing.
Archives go to any file system that Arrow knows by its URI.

Defined results: a null html is an empty payload; pages without an id come after those with one: they revisit a page with an id, and where none has an id all are
responses; rows that repeat the smallest id are responses each; equal payloads below ``least`` bytes are responses; control characters
and spaces in urls are percent-encoded; other columns are not read; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import BROADCAST_IDS, Scratch

LEAST_BYTES = 100
TRAIN_BYTES = 4 << 20
DICTIONARY_BYTES = 112_640
ARCHIVE_BYTES = 64 << 20
LEVEL = 9
SALTS = 64
#: Fixed values of the formats: the frame that holds a dictionary, and a revisit's profile.
DICTIONARY_FRAME = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_INDEX = "file string, offset bigint, length bigint, page_id string, record_type string, payload_digest string"
_RECORD = "file string, page_id string, url string, record_type string, refers_to string, payload_bytes bigint, payload_digest string"


def with_originals(pages: DataFrame, scratch: Scratch, id_col: str, html_col: str, url_col: str, least: int = LEAST_BYTES, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): ``refers_to`` is the id of the page that has the payload, null for responses."""
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    of = rows.filter(F.octet_length("payload") >= least).select("digest", "page_id").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    repeated = scratch.write(of.filter("n > 1 AND first IS NOT NULL").select("digest", "first"), "repeated")
    if repeated.count() <= broadcast_ids:
        joined = rows.join(F.broadcast(repeated), "digest", "left")
    else:
        salts = F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
        joined = salted.join(repeated.withColumn("salt", F.explode(salts)), ["digest", "salt"], "left")
    refers = F.when(~F.coalesce(F.col("page_id") == F.col("first"), F.lit(False)), F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def record_id(page_id: str | None, digest: str) -> str:
    """The same for a page whenever it is archived; one without an id gets a new one."""
    made = uuid.uuid4() if page_id is None else uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}\n{digest}")
    return f"<{made.urn}>"


def _header_text(value: str, also: str = "") -> str:
    """With what would end a header line or be cut off at its ends, and ``also``, percent-encoded."""
    return "".join(quote(c, safe="") if c <= " " or c == "\x7f" or c in also else c for c in value)


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit of the page ``refers_to``."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else _header_text(url),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "WARC-Profile": None if refers_to is None else PROFILE,
        "WARC-Refers-To": None if refers_to is None else record_id(refers_to, digest),
        "Page-ID": None if page_id is None else _header_text(page_id, "%"),
        "Refers-To-Page-ID": None if refers_to is None else _header_text(refers_to, "%"),
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def warcinfo() -> bytes:
    block = b"software: fieldweave\r\nformat: WARC File Format 1.1\r\n"
    return b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <%s>\r\nWARC-Date: %s\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (uuid.uuid4().urn.encode(), DATE.encode(), len(block), block)


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict | None:
    """A dictionary of at most ``size`` bytes and a tenth of its samples; none if they are too few or too short for one."""
    size = min(size, sum(map(len, samples)) // 10)
    try:
        return zstandard.train_dictionary(size, samples) if size >= 256 else None
    except zstandard.ZstdError:
        return None


class Archive:
    """One archive being written: the dictionary's frame, then a frame for each record; ``write`` returns its place and length."""

    def __init__(self, out: BinaryIO, dictionary: zstandard.ZstdCompressionDict | None, level: int = LEVEL):
        self.out, self.size = out, 0
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True)
        if dictionary is not None:
            data = dictionary.as_bytes()
            self._put(struct.pack("<II", DICTIONARY_FRAME, len(data)) + data)
        self.write(warcinfo())

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def write(self, record: bytes) -> tuple[int, int]:
        at, frame = self.size, self.compressor.compress(record)
        self._put(frame)
        return at, len(frame)


def file_system(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """Arrow's file system for a URI, and the path on it."""
    return arrow_fs.FileSystem.from_uri(uri)


def write_archives(records: DataFrame, folder: str, scratch: Scratch, archive_bytes: int = ARCHIVE_BYTES, train_bytes: int = TRAIN_BYTES, level: int = LEVEL) -> DataFrame:
    """Archives below ``folder`` of ``records`` (page_id, url, payload, digest, refers_to), and their index: one row for each record."""
    rows = records.select(F.col("page_id").cast("string"), F.col("url").cast("string"), "payload", "digest", F.col("refers_to").cast("string"))

    def index(entries: list[tuple]) -> pa.RecordBatch:
        names = [c.split()[0] for c in _INDEX.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*entries), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        source = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        task, attempt, serial, ended = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], 0, False
        while not ended:
            held, size = [], 0  # what the dictionary is built from
            for row in source:
                held.append((row, record(*row)))
                size += len(held[-1][1])
                if size >= train_bytes:
                    break
            else:
                ended = True
            if not held:
                break
            name = f"pages-{task:05d}-{serial:05d}-{attempt}.warc.zst"
            entries = []
            with fs.open_output_stream(f"{root}/{name}.open", compression=None) as out:
                archive = Archive(out, build_dictionary([r for _, r in held]), level)

                def put(row: tuple, made: bytes) -> None:
                    at, length = archive.write(made)  # noqa: B023
                    entries.append((name, at, length, row[0], "response" if row[4] is None else "revisit", row[3]))  # noqa: B023

                for row, made in held:
                    put(row, made)
                held.clear()
                while not ended and archive.size < archive_bytes:
                    row = next(source, None)
                    if row is None:
                        ended = True
                    else:
                        put(row, record(*row))
                    if len(entries) >= 20_000:
                        yield index(entries)
                        entries = []
            fs.move(f"{root}/{name}.open", f"{root}/{name}")
            if entries:
                yield index(entries)
            serial += 1

    return scratch.write(rows.mapInArrow(run, _INDEX), "index")


def read_dictionary(source: BinaryIO) -> tuple[zstandard.ZstdCompressionDict | None, bytes]:
    """The dictionary of an archive that is read from its start, and the bytes read beyond it (none if there is a dictionary)."""
    head = source.read(8)
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_FRAME:
        data = source.read(struct.unpack("<I", head[4:])[0])
        if data[:4] == zstandard.FRAME_HEADER:  # it may be compressed itself
            data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
        return zstandard.ZstdCompressionDict(data), b""
    return None, head


class _Joined(io.RawIOBase):
    """``head``, then what ``source`` has."""

    def __init__(self, head: bytes, source: BinaryIO):
        self.head, self.source = head, source

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.head[: len(buffer)] or self.source.read(len(buffer))
        self.head = self.head[len(data) :] if self.head else b""
        buffer[: len(data)] = data
        return len(data)


def read_records(source: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a compressed archive, one held at a time."""
    dictionary, head = read_dictionary(source)
    stream = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(_Joined(head, source), read_across_frames=True)
    yield from plain_records(io.BufferedReader(stream, 1 << 16))


def plain_records(text: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of plain WARC bytes; raises ValueError if a record is cut short or its digest is wrong."""
    while version := text.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record but {version[:20]!r}")
        headers: dict[str, str] = {}
        while (line := text.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError("a record's headers are cut short")
            name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            headers[name.strip().lower()] = value.strip()
        block = text.read(int(headers["content-length"]))
        if len(block) < int(headers["content-length"]) or text.read(4) != b"\r\n\r\n":
            raise ValueError("a record's block is cut short")
        known = headers.get("warc-block-digest", "")
        if known.startswith("sha256:") and known[7:] != hashlib.sha256(block).hexdigest():
            raise ValueError(f"record {headers.get('warc-record-id')} has another digest than it says")
        yield headers, block


def page_of(headers: dict[str, str], block: bytes) -> tuple[str | None, str | None, str, str | None, int, str, bytes]:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of a response or revisit record.

    The payload's length and digest are a response's own, and for a revisit, whose payload is elsewhere, those that it states.
    """
    kind = headers["warc-type"]
    http, _, payload = block.partition(b"\r\n\r\n")
    if kind == "revisit":
        length = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
        digest = headers["warc-payload-digest"].removeprefix("sha256:")
    else:
        length, digest = len(payload), hashlib.sha256(payload).hexdigest()
    return headers.get("page-id"), headers.get("warc-target-uri"), kind, headers.get("refers-to-page-id"), length, digest, payload


def read_archives(index: DataFrame, folder: str, scratch: Scratch, with_payload: bool = False) -> DataFrame:
    """One row for each page in the archives that ``index`` names: (file, page_id, url, record_type, refers_to, payload_bytes, payload_digest), and ``payload`` if asked for.

    Each archive is read from start to end by one task, a record at a time; Spark lists the folder and deals archives to tasks by their size.
    """
    spark = index.sparkSession
    if index.isEmpty():
        return spark.createDataFrame([], _RECORD + (", payload binary" if with_payload else ""))
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"))
    named = scratch.write(index.select(F.col("file").alias("named")).distinct(), "named")
    schema = _RECORD + (", payload binary" if with_payload else "")
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        rows, size = [], 0
        make = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds[: len(names)])], names)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{name}", compression=None) as source:
                    for headers, block in read_records(source):
                        if headers["warc-type"] in ("response", "revisit"):
                            row = (name, *page_of(headers, block))
                            rows.append(row[: len(names)])
                            size += len(block) if with_payload else 0
                        if len(rows) >= 10_000 or size >= 4 << 20:
                            yield make()
                            rows, size = [], 0
        if rows:
            yield make()

    return scratch.semi_join(listed, named, F.col("file") == F.col("named")).mapInArrow(run, schema)


def read_one(folder: str, file: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its place in the index, without reading those before it."""
    fs, root = file_system(folder)
    with fs.open_input_file(f"{root}/{file}") as source:
        dictionary, _ = read_dictionary(source)
        frame = source.read_at(length, offset)
    return next(plain_records(io.BytesIO(zstandard.ZstdDecompressor(dict_data=dictionary).decompress(frame))))


def archive_pages(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES, train_bytes: int = TRAIN_BYTES) -> tuple[DataFrame, str, Scratch]:
    """Archive all pages; (index, folder, scratch) with what ``read_archives`` takes."""
    scratch = Scratch(pages.sparkSession)
    folder = folder or scratch.path("archives")
    return write_archives(with_originals(pages, scratch, id_col, html_col, url_col, least), folder, scratch, archive_bytes, train_bytes), folder, scratch


def typed_ids(records: DataFrame, id_type: str) -> DataFrame:
    """``page_id`` and ``refers_to``, which archives hold as text, in the type of the table that they came from."""
    back: dict[str, Column] = {c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))).cast(id_type) if id_type == "string" else F.col(c).cast(id_type) for c in ("page_id", "refers_to")}
    return records.withColumns(back)


def open_archives(spark: SparkSession, index_path: str, folder: str, with_payload: bool = False) -> DataFrame:
    """``read_archives`` of an index that was written before."""
    return read_archives(spark.read.schema(_INDEX).parquet(index_path), folder, Scratch(spark), with_payload)
