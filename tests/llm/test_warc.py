import base64
import gzip
import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidegrid.llm.warc import archive_pages, read_archives

PAGES = [
    (1, "http://a/", "<p>é</p>"), (2, "http://b/\r\nX: y", "<p>é</p>"), (3, None, "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n"),
    (4, "http://c/", None), (5, "http://d/", ""), (6, "http://e/", "x" * 10_001), (7, "http://é/", "same"), (7, "http://g/", "same"),
    (None, "http://n/", "only without id"), (9, "http://h/", "x" * 10_001), (10, "u", "\r\n" * 50),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'x' AS digest", "1 AS chunk")


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.mark.parametrize("min_bytes, chunk_bytes", [(0, 1 << 20), (5, 7)])
def test_round_trip(pages, min_bytes, chunk_bytes):
    rows = read_archives(archive_pages(pages, min_bytes=min_bytes, chunk_bytes=chunk_bytes), chunk_bytes).collect()
    records = defaultdict(list)
    for r in rows:
        records[r.path, r.record_id, r.url].append(r)
    assert len(records) == len(PAGES)
    texts, seen = defaultdict(list), []
    for i, _, html in PAGES:
        texts[i].append(html or "")
    for chunks in records.values():
        chunks.sort(key=lambda r: r.chunk_no)
        last, page = chunks[-1], int(chunks[0].page_id) if chunks[0].page_id else None
        html = texts[page][0]
        assert [c.is_last for c in chunks] == [False] * (len(chunks) - 1) + [True] and last.intact
        assert max(len(c.chunk) for c in chunks) <= chunk_bytes
        same = [i for i, _, h in PAGES if (h or "") == html and i is not None]
        keep = max(same, default=None)
        response = page == keep or len(html.encode()) < min_bytes
        assert (last.record_type, last.refers_to) == (("response", None) if response else ("revisit", str(keep)))
        assert (last.payload_bytes, last.payload_digest) == (len(html.encode()), digest(html))
        if response:
            assert b"".join(c.chunk for c in chunks).decode() == html
            assert last.digest_so_far == digest(html)
            assert chunks[0].digest_so_far == base64.b32encode(hashlib.sha1(chunks[0].chunk).digest()).decode()
        seen.append(page)
    assert sorted(map(str, seen)) == sorted(str(i) for i, *_ in PAGES)


def test_archives_are_plain_warc(pages):
    path = archive_pages(pages.where("page_id = 1")).first().path.removeprefix("file://")
    text = gzip.open(path).read()
    head, http, body = text.split(b"\r\n\r\n")[:3]
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and body.decode() == "<p>é</p>"
    assert f"Content-Length: {len(http) + 4 + len(body)}".encode() in head and text.endswith(b"\r\n\r\n")


def test_damage_is_not_silent(spark, pages, tmp_path):
    path = archive_pages(pages.where("page_id = 6")).first().path.removeprefix("file://")
    broken = gzip.compress(gzip.open(path).read()[:-2000])
    (tmp_path / "b.warc.gz").write_bytes(broken)
    manifest = spark.createDataFrame([(f"file://{tmp_path}/b.warc.gz",)], "path string")
    with pytest.raises(Exception, match="ends inside a record"):
        read_archives(manifest).collect()


def test_no_pages(pages):
    assert read_archives(archive_pages(pages.limit(0))).agg(F.count("*")).first()[0] == 0
