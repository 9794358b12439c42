import base64
import gzip
import hashlib

import pytest

from pixelloom.llm import warc


def expected(rows, least=0):
    out, first = [], {}
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= least:
            first[b] = min(p, first.get(b, p))
    for p, _, h in rows:
        b = (h or "").encode()
        f = first.get(b, p)
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if f == p else "revisit", None if f == p else f))
    return sorted(out)


FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"


def test_magic_in_payloads_nulls_and_copies(spark):
    rows = [(1, "http://a/", "plain é\r\n\r\n"), (2, None, None), (3, "u v\r\nWARC-Type: x", ""), (4, "http://d/", "x" + FAKE + FAKE + "WARC/1.0\r\nrest"), (5, "http://e/", "plain é\r\n\r\n"),
            (6, "", FAKE), (7, "http://g/", "WARC/1.0\r\n"), (8, "http://h/", "\r\n\r\n" * 50 + FAKE * 3), (9, "x", "x" + FAKE + FAKE + "WARC/1.0\r\nrest")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2)
    got = sorted(tuple(r) for r in warc.archive_report(pages).collect())
    assert got == expected(rows)


def test_empty_table_and_extra_columns(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string, digest string, off bigint")
    assert warc.archive_report(pages).count() == 0
    pages = spark.createDataFrame([(1, "u", "a", "d", 5)], "page_id bigint, url string, html string, digest string, off bigint")
    assert warc.archive_report(pages).count() == 1


def test_large_payload_of_many_magic_strings(spark):
    rows = [(1, "u", FAKE * 2000), (2, "u", "z" * 3_000_000), (3, "u", "end")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = sorted(tuple(r) for r in warc.archive_report(pages).collect())
    assert got == expected(rows)


def archive(spark, tmp_path, rows, change):
    """One archive file of the rows, changed, in a folder of its own."""
    path = str(tmp_path / "plain")
    warc.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1), path)
    (tmp_path / "changed").mkdir()
    data = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "plain").glob("*.gz")))
    (tmp_path / "changed" / "a.warc").write_bytes(change(data))
    return str(tmp_path / "changed")


ROWS = [(k, f"http://{k}/", f"page {k} " * (k + 1)) for k in range(6)]


def ids(df):
    return sorted(r["page_id"] for r in df.collect())


def test_text_before_the_first_record(spark, tmp_path):
    path = archive(spark, tmp_path, ROWS, lambda b: b"x\nWARC/1.0\r\nnothing" + b)
    assert ids(warc.read_archives(spark, path)) == list(range(6)) and warc.damages(spark, path).count() == 0


def test_missing_byte_is_an_error_or_reported(spark, tmp_path):
    path = archive(spark, tmp_path, ROWS, lambda b: b.replace(b"page 2 page", b"page 2page", 1))
    with pytest.raises(ValueError, match="damaged archives.*no record where the next"):
        warc.read_archives(spark, path)
    assert ids(warc.read_archives(spark, path, "skip")) == [0, 1, 2]
    out = warc.damages(spark, path).collect()
    assert [r["reason"] for r in out] == [warc.GAP] and out[0]["unread"] > 0


def test_cut_file_and_bad_header(spark, tmp_path):
    path = archive(spark, tmp_path, ROWS, lambda b: b[:-30])
    with pytest.raises(ValueError, match="behind the file's end"):
        warc.read_archives(spark, path)
    assert ids(warc.read_archives(spark, path, "skip")) == [0, 1, 2, 3, 4]
    other = tmp_path / "other"
    other.mkdir()
    path = archive(spark, other, ROWS, lambda b: b.replace(b"Content-Length", b"Content-Longth", 4).replace(b"Content-Longth", b"Content-Length", 3))
    assert ids(warc.read_archives(spark, path, "skip")) == [0, 1, 2] and warc.damages(spark, path).first()["reason"] == warc.HEADLESS


def test_repeated_rows_and_null_ids_with_many_copies(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 2)
    rows = [(k, "u", "same") for k in range(30)] + [(3, "u", "same"), (3, "u", "other"), (0, "u", "same")]
    got = [tuple(r) for r in warc.archive_report(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()]
    assert sorted(got) == expected(rows)
    out = warc.archive_report(spark.createDataFrame([(None, "u", "same"), (5, "u", "same")], "page_id bigint, url string, html string")).collect()
    assert sorted((r["record_type"], r["refers_to"]) for r in out) == [("response", None), ("revisit", 5)]
