"""Archives of pages: what is read back, the bytes of the format, dictionaries, repeats and damage."""

from __future__ import annotations

import hashlib
import io
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from fieldweave.llm import queries, warc
from fieldweave.llm.scratch import Scratch

LONG = "<p>" + "same words on each page, " * 10
ROWS = [
    (3, "http://h/3", LONG),
    (1, "http://h/1\nX-Evil: 1", LONG),
    (2, None, LONG),
    (4, "http://h/4", "short"),
    (5, "http://h/5", "short"),
    (6, "http://h/é ü", None),
    (7, "http://h/7", ""),
    (8, "http://h/8", "日本\r\n\r\nWARC/1.1\r\n" * 9),
    (None, "http://h/none", LONG),
    (None, "http://h/none", "without an id, and long enough to be a repeated payload " * 3),
    (None, "http://h/none", "without an id, and long enough to be a repeated payload " * 3),
    (1, "http://h/again", LONG),
    *[(100 + k, f"http://h/{k}", f"<html><head><title>Page {k}</title></head><body class='post'><h1>Title {k}</h1><p>{'word ' * (k % 50)}{k * 7919}</p></body></html>") for k in range(400)],
]


def brute(rows: list[tuple]) -> list[tuple]:
    first: dict[str, int] = {}
    for page_id, _, html in rows:
        if html and len(html.encode()) >= 100 and page_id is not None:
            first[html] = min(page_id, first.get(html, page_id))
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        other = first.get(html) if html is not None and first.get(html) != page_id else None
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if other is not None else "response", other))
    return out


def frame(spark, rows):
    docs = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    for name in ("digest", "payload", "first", "refers_to", "file", "salt", "n"):
        docs = docs.withColumn(name, F.lit(0))
    return docs


def read(index, folder, scratch) -> list[tuple]:
    back = warc.typed_ids(warc.read_archives(index, folder, scratch), "bigint")
    return sorted(map(tuple, back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_pages_come_back_as_they_were(spark):
    index, folder, scratch = warc.archive_pages(frame(spark, ROWS), archive_bytes=3000, train_bytes=20_000)
    assert read(index, folder, scratch) == sorted(brute(ROWS), key=str)
    assert index.count() == len(ROWS) and index.select("file").distinct().count() > 3
    texts = {r["page_id"]: r for r in warc.read_archives(index, folder, scratch, with_payload=True).filter("record_type = 'response'").collect()}
    assert texts["8"]["payload"].decode() == ROWS[7][2] and texts["6"]["url"] == "http://h/é%20ü" and texts["1"]["url"] in ("http://h/1%0AX-Evil:%201", "http://h/again")


def test_many_repeated_payloads_are_dealt_by_salt(spark):
    scratch = Scratch(spark)
    rows = warc.with_originals(frame(spark, ROWS), scratch, "page_id", "html", "url", broadcast_ids=0)
    folder = scratch.path("archives")
    assert read(warc.write_archives(rows, folder, scratch), folder, scratch) == sorted(brute(ROWS), key=str)


def test_archives_follow_the_format(spark):
    index, folder, _ = warc.archive_pages(frame(spark, ROWS).coalesce(1))
    (name,) = [r["file"] for r in index.select("file").distinct().collect()]
    fs, root = warc.file_system(folder)
    data = fs.open_input_file(f"{root}/{name}").read()
    magic, length = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and zstandard.ZstdCompressionDict(data[8 : 8 + length]).dict_id()
    dictionary = zstandard.ZstdCompressionDict(data[8 : 8 + length])
    plain, entries = b"", sorted(map(tuple, index.collect()), key=lambda r: r[1])
    for _, at, size, page_id, kind, _ in entries:
        one = zstandard.ZstdDecompressor(dict_data=dictionary).decompress(data[at : at + size])
        assert one.startswith(b"WARC/1.1\r\nWARC-Type: " + kind.encode()) and (page_id is None or b"\r\nPage-ID: " + page_id.encode() + b"\r\n" in one)
        plain += one
    assert entries[-1][1] + entries[-1][2] == len(data)
    # frames by themselves, without what they share, take more
    assert sum(e[2] for e in entries) < sum(len(zstandard.compress(warc.record(*r))) for r in warc.with_originals(frame(spark, ROWS), Scratch(spark), "page_id", "html", "url").select(F.col("page_id").cast("string"), "url", "payload", "digest", F.col("refers_to").cast("string")).collect())
    headers, block = warc.read_one(folder, *entries[5][:3])
    assert headers["page-id"] == entries[5][3] and len(block) == int(headers["content-length"])
    revisit = next(h for h, _ in warc.read_records(io.BytesIO(data)) if h["warc-type"] == "revisit")
    original = next(h for h, _ in warc.read_records(io.BytesIO(data)) if h.get("page-id") == revisit["refers-to-page-id"])
    assert revisit["warc-refers-to"] == original["warc-record-id"] and revisit["warc-profile"].endswith("identical-payload-digest")


def test_few_or_no_pages(spark):
    index, folder, scratch = warc.archive_pages(frame(spark, ROWS[:1]))
    assert read(index, folder, scratch) == brute(ROWS[:1])
    index, folder, scratch = warc.archive_pages(frame(spark, []))
    assert read(index, folder, scratch) == []


def test_what_a_lost_attempt_left_is_not_read(spark):
    index, folder, scratch = warc.archive_pages(frame(spark, ROWS))
    fs, root = warc.file_system(folder)
    with fs.open_output_stream(f"{root}/pages-00000-00000-lost.warc.zst", compression=None) as out:
        out.write(b"half of an archive")
    assert read(index, folder, scratch) == sorted(brute(ROWS), key=str)


def test_damage_is_an_error():
    out = io.BytesIO()
    archive = warc.Archive(out, None)
    archive.write(warc.record("1", "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None).replace(b"payload", b"damaged"))
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_records(io.BytesIO(out.getvalue())))
    whole = warc.record("1", "u", b"payload", "", None)
    with pytest.raises(ValueError, match="cut short"):
        list(warc.plain_records(io.BytesIO(whole[:-6])))


def test_ids_that_are_text(spark):
    rows = spark.createDataFrame([("a b%41+\n", "u", LONG), ("z", "u", LONG)], "page_id string, url string, html string")
    back = warc.typed_ids(warc.read_archives(*warc.archive_pages(rows)), "string")
    assert {(r["page_id"], r["refers_to"]) for r in back.collect()} == {("a b%41+\n", None), ("z", "a b%41+\n")}


def test_query_equals_brute_force_on_a_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, queries.op11_warc_archive(spark, "/root/testdata/sf0.001").collect())) == sorted(brute(rows))
