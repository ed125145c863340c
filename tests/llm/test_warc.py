import base64
import hashlib
import struct
from collections import defaultdict

import pytest
import zstandard

from transitlake.llm import shared, warc


def rows_of(spark):
    long = "<p>" + "word " * 40_000 + "</p>"
    html = ["<a>", "<a>", None, "", "é漢", "é漢", "<b>\r\n\r\nWARC/1.1\r\n", long, long, "x"] + [f"<html><body>page {i} of the same site</body></html>" for i in range(60)]
    urls = ["http://a/", None, "http://b/ c\r\nd"]
    rows = [(i, urls[i % 3], h, "x", True) for i, h in enumerate(html)] + [(None, "http://n/", "<n>", "x", True), (None, "http://n/", "<a>", "x", True)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, owner string, revisit boolean")


def want(rows, least=0):
    groups = defaultdict(list)
    for r in rows:
        groups[(r.html or "").encode()].append(r.page_id)
    out = []
    for r in rows:
        b = (r.html or "").encode()
        top = max((x for x in groups[b] if x is not None), default=None)
        revisit = len(b) >= least and r.page_id != top
        out.append((r.page_id, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 4])
@pytest.mark.parametrize("roll", [16_000_000, 2_000])
def test_round_trip(spark, monkeypatch, least, roll):
    monkeypatch.setattr(warc, "ROLL_BYTES", roll)
    pages = rows_of(spark)
    folder = shared.shared_dir(spark, "warc")
    manifest = warc.write_archives(pages, folder, min_bytes=least)
    got = sorted(map(tuple, warc.read_archives(manifest, folder).collect()), key=str)
    assert got == want(pages.collect(), least)
    assert sum(r.records for r in manifest.collect()) == pages.count()


def test_large_ids_beside_null(spark):
    big = 2**53 + 1
    rows = [(big, None, "a"), (big + 2, None, "a"), (None, None, "a"), (big + 4, None, "b")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    folder = shared.shared_dir(spark, "warc")
    got = warc.read_archives(warc.write_archives(pages, folder), folder).collect()
    assert {(r.page_id, r.refers_to) for r in got} == {(big, big + 2), (big + 2, None), (None, big + 2), (big + 4, None)}


def test_no_pages(spark):
    folder = shared.shared_dir(spark, "warc")
    assert warc.read_archives(warc.write_archives(rows_of(spark).limit(0), folder), folder).count() == 0


def test_archive_layout():
    records = [warc.record(i, "http://a/", f"<p>{i} and more of the same</p>".encode() * 5, None, False) for i in range(50)]
    data = warc.archive(records)
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D
    dictionary = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    rest, frames = data[8 + size :], 0
    while rest:  # each record is a frame of its own
        d = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        assert d.decompress(rest) == records[frames]
        rest, frames = d.unused_data, frames + 1
    assert frames == 50
    assert [h["WARC-Record-ID"] for h, _ in warc.read_archive(data)] == [f"<urn:x-page:{i}>" for i in range(50)]


def test_a_changed_payload_is_noticed(spark):
    data = bytearray(warc.archive([warc.record(1, None, b"abc", None, False)]))
    data[-3] ^= 1
    with pytest.raises(Exception):
        list(warc.read_archive(bytes(data)))
