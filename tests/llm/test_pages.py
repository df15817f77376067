"""WARC archives and URL filters."""

import glob
import hashlib

import pytest
import zstandard
from askloom.llm import url_filters, warc
from askloom.storage import new_folder

PAGES = "page_id long, url string, html string, id int, payload string, bundle long"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], PAGES)


ROWS = [
    (1, "http://a/1", "x" * 100),
    (2, "http://a/2\r\nX: y", "x" * 100),
    (3, None, "x" * 99),
    (4, "http://ä/4", "x" * 99),
    (5, "http://a/5", None),
    (6, "http://a/6", ""),
    (7, "http://a/7", "é" * 50),
    (0, "http://a/0", "é" * 50),
    (8, "http://a/8", "\r\n\r\nWARC/1.1\r\n" * 40),
    (9, "http://a/9", "long " * 300_000),
    (None, "http://a/n", "x" * 100),
    (None, "http://a/n", "n" * 200),
    (10, "http://a/10", "r" * 150),
    (10, "http://a/10", "r" * 150),
]


def expected(rows):
    first = {}
    for i, _, h in rows:
        if h and len(h.encode()) >= 100 and i is not None:
            first[h] = min(i, first.get(h, i))
    for i, _, h in rows:
        data = (h or "").encode()
        revisit = h in first and first[h] != i
        yield i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[h] if revisit else None


def test_archive_round_trip(spark):
    folder = new_folder(spark, "warc-test")
    index = warc.archive_pages(pages(spark, ROWS).repartition(3), folder, frame_bytes=300, bundle_bytes=1000)
    got = warc.read_records(index, folder).collect()
    found = [(r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]
    assert sorted(map(str, found)) == sorted(map(str, expected(ROWS)))
    texts = {(r.id, bytes(r.payload).decode()) for r in got if r.record_type == "response"}
    assert (9, "long " * 300_000) in texts and (8, "\r\n\r\nWARC/1.1\r\n" * 40) in texts


def test_one_record_is_read_by_its_frame(spark):
    folder = new_folder(spark, "warc-test")
    index = warc.archive_pages(pages(spark, ROWS), folder, frame_bytes=300)
    row = warc.read_records(index.where("record_id = '<urn:page:7>'"), folder).first()
    assert row.id == 7 and row.record_type == "revisit" and row.refers_to == 0


def test_bundles_are_plain_zstandard_with_a_seek_table(spark):
    folder = new_folder(spark, "warc-test")
    index = warc.archive_pages(pages(spark, ROWS).coalesce(1), folder, frame_bytes=300, bundle_bytes=700)
    bundles = glob.glob(f"{folder.removeprefix('file://').removeprefix('file:')}/*.warc.zst")
    assert {r.bundle for r in index.select("bundle").distinct().collect()} == {b.rsplit("/", 1)[1] for b in bundles}
    seen = 0
    for path in bundles:
        own = list(warc.scan_bundle(path))
        with open(path, "rb") as file:
            data = file.read()
        plain = b"".join(
            zstandard.ZstdDecompressor().decompress(data[at : at + size])
            for at, size, _ in warc.read_seek_table(_Opened(data))
        )
        assert plain.count(b"WARC-Record-ID: ") == len(own)
        seen += len(own)
    assert seen == len(ROWS) and len(bundles) > 1


class _Opened:
    def __init__(self, data):
        self.data, self.at = data, 0

    def size(self):
        return len(self.data)

    def seek(self, at):
        self.at = at

    def read(self, n):
        self.at += n
        return self.data[self.at - n : self.at]


def test_empty_archive(spark):
    folder = new_folder(spark, "warc-test")
    index = warc.archive_pages(pages(spark, []), folder)
    assert index.count() == 0 and warc.read_records(index, folder).count() == 0


URLS = [
    ("http://a.example.org/es/x", "a.example.org", "/es/x", "example.org/es/", "block"),
    ("HTTP://A.Example.ORG/es/x?q=/en/1", "a.example.org", "/es/x", "example.org/es/", "block"),
    ("https://example.org/en/123#top", "example.org", "/en/123", "example.org/en/1", "block"),
    ("https://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("https://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("https://x.com/de/1", "x.com", "/de/1", "com/de/", "block"),
    ("https://com/fr/", "com", "/fr/", "com/fr/", "allow"),
    ("https://x.com/es/1", "x.com", "/es/1", None, "allow"),
    ("https://x.org", "x.org", "", None, "allow"),
    ("https://x.org?a=/b", "x.org", "", None, "allow"),
    ("no scheme/org/", "", "", None, "allow"),
    ("a://b://org/", "b:", "//org/", None, "allow"),
    ("http://u@x.org:80/p", "u@x.org:80", "/p", None, "allow"),
    ("http://É.ORG/", "É.org", "/", "org/", "allow"),
    ("http://..org/\nes/", "..org", "/\nes/", "org/", "allow"),
    ("http://x.com/de/" + "y" * 100_000, "x.com", "/de/" + "y" * 100_000, "com/de/", "block"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
]


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame(url_filters.RULES, "host string, path string, verdict string")


@pytest.mark.parametrize("limit", [url_filters.RULES_BROADCAST_BYTES, 0])
def test_urls(spark, rules, limit, monkeypatch):
    monkeypatch.setattr(url_filters.judge_urls, "__defaults__", ("allow", limit))
    frame = pages(spark, [(n, u[0], "") for n, u in enumerate(URLS)] + [(0, URLS[0][0], ""), (None, None, None)])
    got = url_filters.filter_urls(frame, rules).collect()
    want = [(n, *u) for n, u in enumerate(URLS)] + [(0, *URLS[0]), (None, *URLS[-1])]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_rule_precedence(spark):
    rules = [("b.c", "/xx", "allow"), ("a.b.c", "/", "block"), ("c", "/xx", "block"), ("c", "/xx", "block"),
             ("b.c", "/xx", "block"), (None, "/", "block"), ("c", None, "block")]
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    urls = pages(spark, [(1, "x://a.b.c/xxx", ""), (2, "x://b.c/xxx", ""), (3, "x://c/xx", ""), (4, "x://c/x", "")])
    got = {r.id: (r.rule, r.verdict) for r in url_filters.filter_urls(urls, frame, default="block").collect()}
    assert got == {1: ("b.c/xx", "block") if len("a.b.c/") < len("b.c/xx") else ("a.b.c/", "block"),
                   2: ("b.c/xx", "block"), 3: ("c/xx", "block"), 4: (None, "block")}


def test_no_urls_and_no_rules(spark, rules):
    assert url_filters.filter_urls(pages(spark, []), rules).count() == 0
    got = url_filters.filter_urls(pages(spark, [(1, "http://x.com/de/", "")]), rules.limit(0)).first()
    assert (got.rule, got.verdict) == (None, "allow")


def test_hosts_of_very_many_labels(spark, rules):
    long = "x." * 100_000
    urls = [(1, f"http://{long}example.org/es/1", ""), (2, f"http://{long}/es/", ""), (3, "http://" + "." * 100_000 + "com/de/", "")]
    got = {r.id: (r.rule, r.verdict) for r in url_filters.filter_urls(pages(spark, urls), rules).collect()}
    assert got == {1: ("example.org/es/", "block"), 2: (None, "allow"), 3: ("com/de/", "block")}
