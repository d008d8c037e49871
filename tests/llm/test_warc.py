import hashlib
import io

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from gridcells.llm import warc
from gridcells.llm.common import scratch_path

PAGES = "/root/testdata/sf0.01/pages.parquet"


def expected(rows, min_bytes=1000):
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page."""
    holder = {}
    for i, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= min_bytes and i is not None:
            holder[raw] = max(i, holder.get(raw, i))
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        to = holder.get(raw)
        to = None if to == i else to
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def seen(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


@given(st.lists(st.binary(max_size=300), max_size=30), st.integers(1, 500))
@settings(max_examples=60, deadline=None)
def test_bundle_frames_are_independent(records, frame_bytes):
    out = io.BytesIO()
    writer = warc.BundleWriter(out, frame_bytes)
    places = [writer.add(r) for r in records]
    writer.close()
    table = warc.seek_table(out.getvalue())
    for (frame, offset), record in zip(places, records, strict=True):
        at, packed, _ = table[min(frame, len(table) - 1)] if table else (0, 0, 0)
        raw = zstandard.ZstdDecompressor().decompress(out.getvalue()[at:at + packed]) if record else b""
        assert raw[offset:offset + len(record)] == record if record else True
    assert b"".join(warc.frames(out.getvalue())) == b"".join(records)
    whole = zstandard.ZstdDecompressor().stream_reader(out.getvalue(), read_across_frames=True).read()
    assert whole == b"".join(records)                       # an ordinary reader skips the table


def test_pages(spark):
    pages = spark.read.parquet(PAGES)
    copies = pages.where("page_id % 5 = 0").selectExpr("page_id + 1000000 page_id", "url", "html")
    pages = pages.union(copies).union(copies.selectExpr("page_id + 1000000", "url", "html"))
    folder = scratch_path(spark, "warc")
    index = warc.write_archives(pages, folder, frame_bytes=20_000, bundle_bytes=60_000)
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    records = warc.read_archives(spark, folder)
    assert seen(records) == expected(rows)
    assert sum(1 for x in expected(rows) if x[3] == "revisit") > 50
    assert index.select("bundle").distinct().count() > 5 and index.agg({"frame": "max"}).first()[0] > 0
    got = {r.page_id: r for r in warc.fetch(spark, folder, index.where("page_id % 7 = 0")).collect()}
    own = {i: (u, h) for i, u, h in rows}
    assert set(got) == {i for i in own if i % 7 == 0}
    for i, r in got.items():
        assert r.url == own[i][0] and (r.payload is None or r.payload.decode() == own[i][1])


def test_odd_rows(spark):
    long = "é" * 600
    rows = [(1, "http://a/\r\n x", None), (2, None, ""), (None, "u", long), (None, "u", "n" * 2000), (3, "ü", long), (4, "u", long),
            (4, "u", long), (5, "u", "x" * 999), (6, "u", "x" * 999), (7, "u", "y" * 3_000_000), (8, "u", "a\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id int, url string, html string, sha string")
    folder = scratch_path(spark, "warc")
    warc.write_archives(pages, folder)
    out = warc.read_archives(spark, folder)
    assert seen(out) == expected(rows)
    assert {r.payload.decode() for r in out.where("record_type = 'response'").collect()} == {h or "" for _, _, h in rows}
    empty = scratch_path(spark, "warc")
    assert warc.write_archives(pages.limit(0), empty).count() == 0
    assert warc.read_archives(spark, empty).count() == 0


def test_damaged_payload_is_noticed():
    _, _, record = warc.write_record(1, "u", b"payload", None, "1970-01-01T00:00:00Z")
    assert next(warc.read_records(record))["payload"] == b"payload"
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_records(record.replace(b"payload", b"pAyload")))
