import pytest

from deltion.llm import warc
from tests.llm.helpers import against_sql, write

PAGES = [(3, "http://a.b/c d", "same"), (1, "http://a.b/é", "same"), (2, None, None), (5, "x", ""), (4, "http://q", "ü" * 70000), (4, "http://q", "ü" * 70000), (None, "u", "same"), (9, "u", "other"), (10, "\r\nX: y", "other")]


def test_edge_rows(spark, tmp_path):
    folder = write(spark, tmp_path / "t", pages=PAGES)
    assert against_sql(spark, folder, "op1_warc_zstd") == []


def test_empty_table(spark, tmp_path):
    folder = write(spark, tmp_path / "t")
    assert against_sql(spark, folder, "op1_warc_zstd") == []


def test_given_pages(spark):
    assert against_sql(spark, "/root/testdata/sf0.001", "op1_warc_zstd") == []


def test_round_trip_and_damage(spark):
    rows = [(i, f"http://h{i}/", f"<p>page {i % 150} " + "lorem ipsum dolor " * (i % 40), None) for i in range(400)]
    pages = warc.with_record_types(spark.createDataFrame(rows, "page_id long, url string, html string, n int")).coalesce(1)
    archives = warc.write_archives(pages, archive_bytes=20_000).collect()
    assert len(archives) > 3
    assert all(a.content[:4] == b"\x5d\x2a\x4d\x18" for a in archives[:-1])
    read = warc.read_archives(spark.createDataFrame(archives)).collect()
    assert sorted(r.page_id for r in read) == list(range(400)) and not any(r.error for r in read)
    text = {r[0]: r[2].encode() for r in rows}
    assert all((r.payload == text[r.page_id]) if r.record_type == "response" else (text[r.refers_to] == text[r.page_id]) for r in read)

    whole = archives[0].content
    n = len([1 for r in read if r.path == archives[0].path])
    broken = list(warc.frames(whole[:-3]))
    assert len(broken) == n and broken[-1][2] and not any(b[2] for b in broken[:-1])
    flipped = bytearray(whole)
    flipped[-6] ^= 255
    assert list(warc.frames(bytes(flipped)))[-1][2]
    assert [x[2] for x in warc.frames(b"not zstandard")] == ["no frame starts here"]


@pytest.mark.parametrize("old, new", [(b"WARC/1.1", b"WARC/9.9"), (b"WARC-Date", b"WARC-Dote"), (b"<p>", b"<q>"), (b"\r\n\r\n", b"\r\n"), (b"Content-Length: ", b"Content-Length: 1")])
def test_checks(old, new):
    whole = warc.record(1, "http://a/", b"<p>hello", None, "2024-01-01T00:00:00Z")
    assert warc.parse(whole)["payload"] == b"<p>hello"
    with pytest.raises(ValueError):
        warc.parse(whole.replace(old, new, 1))
