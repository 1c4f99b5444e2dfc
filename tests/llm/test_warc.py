import hashlib

import pytest

from secstream.llm import warc
from secstream.session import work_dir

import uuid

SCHEMA = "page_id long, url string, html string, record_type string"


def archived(spark, rows, **more):
    pages = spark.createDataFrame([(*r, "own") for r in rows], SCHEMA)
    path = f"{work_dir(spark)}/warc-test-{uuid.uuid4().hex}"
    out = warc.archive_pages(pages, path, **more)
    return sorted((tuple(r) for r in out.collect()), key=str), path


def expected(rows, small=100):
    size = lambda h: len((h or "").encode())
    out = []
    for page, _, html in rows:
        same = [p for p, _, h in rows if h == html and p is not None]
        first = min(same, default=None) if size(html) >= small else None
        again = first is not None and page != first
        out.append((page, size(html), hashlib.sha256((html or "").encode()).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_round_trip_of_hostile_pages(spark):
    big = "é日" * 400 + "\r\n\r\n"
    rows = [
        (5, "http://a/\r\nWARC-Type: x", big),
        (2, None, big),
        (2, None, big),
        (None, "u", big),
        (7, "u", None),
        (8, "u", ""),
        (9, "u", "short"),
        (10, "u", "short"),
        (11, "u", "x" * 200 + "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 5 + "WARC/1.1"),
        (12, "u", "WARC/1.1"),
        (None, None, "y" * 150),
        (None, None, "y" * 150),
    ]
    for size, kind in ((64, "gzip"), (1 << 16, "none")):
        got, _ = archived(spark, rows, size=size, compression=kind)
        assert got == expected(rows)


def test_segments_follow_the_standard(spark):
    _, path = archived(spark, [(1, "u", "z" * 1000)], size=300)
    parts = sorted((r.segment, r.type, len(r.block), r.total_length, r.origin) for r in warc.read_warc(spark, path).collect())
    assert [p[:2] for p in parts] == [(1, "response"), (2, "continuation"), (3, "continuation"), (4, "continuation")]
    assert parts[-1][3] == sum(p[2] for p in parts)
    assert len({p[4] for p in parts[1:]}) == 1


def test_digests_are_carried_from_chunk_to_chunk(spark):
    pages = spark.createDataFrame([(1, "u", "abcdefghij")], "page_id long, url string, html string")
    chunks = sorted((r.chunk_no, bytes(r.data), r.sha256_so_far, r.last) for r in warc.chunk_table(pages, 4).collect())
    assert [c[1] for c in chunks] == [b"abcd", b"efgh", b"ij"]
    assert [c[2] for c in chunks] == [hashlib.sha256(b"abcdefghij"[:n]).hexdigest() for n in (4, 8, 10)]
    assert [c[3] for c in chunks] == [False, False, True]


def test_empty_table(spark):
    assert archived(spark, [])[0] == []


def test_a_lost_segment_is_an_error(spark):
    pages = spark.createDataFrame([(1, "u", "z" * 1000)], "page_id long, url string, html string")
    path = f"{work_dir(spark)}/warc-test-{uuid.uuid4().hex}"
    chunks = warc.chunk_table(pages, 300)
    types = warc.record_types(chunks)
    warc.warc_lines(chunks.filter("chunk_no <> 1"), types).write.option("lineSep", warc.END).text(path)
    with pytest.raises(Exception, match="lacks segment"):
        warc.page_records(warc.read_warc(spark, path)).collect()
