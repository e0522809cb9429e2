import gzip
import hashlib
from collections import defaultdict

import pytest

pytest.importorskip("rankframe.llm")

from rankframe.llm import archives
from rankframe.llm.queries import op13_archive_conversion

LONG = "<p>" + "long page " * 120 + "</p>"
PAGES = [
    (1, "http://a/x", "<p>short</p>"),
    (2, "http://a/y y\n", "<p>short</p>"),
    (3, None, LONG),
    (4, "http://a/z", LONG),
    (4, "http://a/z", LONG),
    (None, "http://b/", LONG),
    (5, "", None),
    (6, "http://c/é", ""),
    (7, "http://c/", "HTTP/1.0 200 OK\r\n\r\nWARC/1.1\r\n\n\n" + "ñ" * 600),
    (8, "http://d/", "HTTP/1.0 200 OK\r\n\r\nWARC/1.1\r\n\n\n" + "ñ" * 600),
    (9, "http://e/", "x" * 3_000_000),
    (10, "http://e/", "y" * 999),
    (11, "http://e/", "y" * 999),
    (12, "http://e/", "z" * 1000),
    (13, "http://e/", "z" * 1000),
    (-2, "http://e/", "w" * 1000),
    (None, "http://e/", "w" * 1000),
]


def plain(pages):
    groups, out = defaultdict(list), []
    for i, (key, _, html) in enumerate(pages):
        if len((html or "").encode()) >= 1000:
            groups[html].append(i)
    for i, (key, _, html) in enumerate(pages):
        data = (html or "").encode()
        same = groups.get(html, [i])
        keep = max(same, key=lambda j: (pages[j][0] is not None, pages[j][0] or 0))
        best = pages[keep][0]
        out.append((key, len(data), hashlib.sha1(data).hexdigest(), "response" if i == keep else "revisit", None if i == keep else best))
    return sorted(out, key=str)


def test_pages_through_both_formats(spark):
    table = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("key", archives.F.lit("clash")).repartition(3)
    got = sorted((tuple(r) for r in archives.archive_pages(table).collect()), key=str)
    assert got == plain(PAGES)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert archives.archive_pages(empty).count() == 0


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()]
    got = sorted((tuple(r) for r in op13_archive_conversion(spark, "/root/testdata/sf0.01").collect()), key=str)
    assert got == plain(rows)


def arc_file(folder, name, version, records):
    about = f"{version} 0 someone\n{archives.FIELDS[version]}\n\n".encode()
    data = archives.arc_head(version, f"filedesc://{name}", "0.0.0.0", "20010203040506", "text/plain", len(about), name) + about
    for head, body in records:
        data += head.encode() % len(body) + body + b"\n"
    path = folder / f"{name}.gz"
    path.write_bytes(gzip.compress(data[:100]) + gzip.compress(data[100:]))
    return f"file://{path}"


def test_headers_of_both_versions(spark, tmp_path):
    http = b"HTTP/1.1 404 Not Found\nContent-Type: text/html\nx-document-key: 77\n\n<p>none</p>"
    one = arc_file(tmp_path, "one.arc", 1, [("http://a/b c 1.2.3.4 19961231 text/html; charset=x %d\n", http), ("dns:a - 20010101000000 text/dns %d\n", b"a. 1.2.3.4\n\n")])
    two = arc_file(tmp_path, "two.arc", 2, [("http://q/ ::1 20019999000000 text/plain 200 - - 0 two.arc %d\n", b"no header\n\n\nhere")])
    files = spark.createDataFrame([(one,), (two,)], "file string")
    warcs = [r.file for r in archives.convert_arc(spark, files).collect()]
    found = {f.get("warc-target-uri", f["warc-type"]): (f, b) for path in warcs for f, b in archives.read_warc(path)}
    fields, block = found["http://a/b c"]
    assert (fields["warc-type"], fields["warc-date"], fields["warc-ip-address"], block) == ("response", "1996-12-31T00:00:00Z", "1.2.3.4", http)
    assert fields["warc-payload-digest"] == archives.sha1_label(b"<p>none</p>") and fields["warc-block-digest"] == archives.sha1_label(http)
    fields, block = found["dns:a"]
    assert (fields["warc-type"], fields["content-type"], block) == ("resource", "text/dns", b"a. 1.2.3.4\n\n")
    fields, block = found["http://q/"]
    assert (fields["warc-date"], block) == ("2001-02-03T04:05:06Z", b"no header\n\n\nhere")  # a date that isn't takes the file's
    assert len({f["warc-record-id"] for f, _ in found.values()}) == len(found)
    rows = archives.read_archives(spark, spark.createDataFrame([(w,) for w in warcs], "file string")).collect()
    assert sorted((r.key or 0, r.payload_bytes, r.record_type) for r in rows) == [(0, 12, "resource"), (0, 16, "resource"), (77, 11, "response")]


@pytest.mark.parametrize("data", [b"http://a/ 1.2.3.4 20010101 text/html 3\nabc\n", b"filedesc://x 0.0.0.0 2001 text/plain 4\n1 0\nnonsense\n", b"filedesc://x 0.0.0.0 2001 text/plain 400\n1 0\n"])
def test_broken_archives_are_named(tmp_path, data):
    path = tmp_path / "x.arc"
    path.write_bytes(data)
    with pytest.raises(ValueError, match="x.arc"):
        list(archives.read_arc(f"file://{path}"))
