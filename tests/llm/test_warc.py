"""WARC: exact round trip, deduplication, the loser tree and the merged order."""

import glob
import gzip
import hashlib
import random

import pytest
from llm_cases import clashing

from tallyfold.llm import warc

SCHEMA = "page_id bigint, url string, html string"
LONG = "<p>" + "payload " * 30 + "</p>"


def plain(rows):
    first = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and page is not None:
            first[data] = min(page, first.get(data, page))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        revisit = page is not None and len(data) >= 100 and first[data] != page
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[data] if revisit else None))
    return sorted(map(str, out))


PAGES = [(1, "http://a.example.com/x", LONG), (2, "https://b.example.com:8080/y?q=1", LONG), (3, "http://a.example.com/x", "short"),
         (4, None, "short"), (5, "not a url", None), (6, "http://[bad", ""), (7, "http://é.example/ü", "é漢\r\n\r\nWARC/1.0\r\n" * 20),
         (8, "http://a.example.com/x\r\nX: y", "z" * 300_000), (9, "http://a.example.com/x", LONG), (0, "http://z.example.com/", "é漢\r\n\r\nWARC/1.0\r\n" * 20),
         (None, "http://n.example/", LONG), (9, "http://a.example.com/x", LONG), (1, "http://a.example.com/x", LONG)]


def test_round_trip(spark):
    got = warc.archive_and_read(clashing(spark.createDataFrame(PAGES, SCHEMA))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(str(tuple(r)) for r in got.collect()) == plain(PAGES)


def test_files_are_warc_and_bytes_come_back(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(PAGES, SCHEMA), path, records_per_file=2)
    payloads = []
    for name in glob.glob(path + "/*.gz"):
        data = gzip.open(name).read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            size = int(fields["Content-Length"])
            block, data = rest[:size], rest[size:]
            assert head.startswith(b"WARC/1.0") and data.startswith(b"\r\n\r\n")
            data = data[4:]
            if fields["WARC-Type"] == "response":
                payloads.append(block.partition(b"\r\n\r\n")[2].decode())
    want = [h or "" for p, _, h in PAGES]
    assert set(payloads) == set(want)


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted((rng.randint(0, 30), i, j) for j in range(rng.randint(0, 20))) for i in range(k)]
    tree = warc.LoserTree(runs, key=lambda x: x[0])
    assert list(tree) == sorted((x for r in runs for x in r), key=lambda x: (x[0], x[1]))


def test_history_is_globally_ordered(spark):
    rng = random.Random(2)
    pages = [(i, f"http://h{rng.randint(0, 3)}.example.com/{'hot' if rng.random() < .4 else rng.randint(0, 50)}", f"text {rng.randint(0, 40)} " * 15) for i in range(400)]
    rows = warc.archive_and_read(spark.createDataFrame(pages, SCHEMA).repartition(6), per_range=40).orderBy("key_range", "place").collect()
    keys = [(r.url_key, r.timestamp, r.page_id) for r in rows]
    assert len(keys) == 400 and keys == sorted(keys)
    sizes = {}
    for r in rows:
        sizes[r.key_range] = sizes.get(r.key_range, 0) + 1
    assert len(sizes) >= 8 and max(sizes.values()) <= 80


def test_url_keys():
    assert warc.url_key("http://www.Example.com/a?b=1") == "com,example,www)/a?b=1"
    assert warc.url_key("https://x.org:8080") == "org,x:8080)/"
    assert warc.url_key("") == ")/"


def test_empty_table(spark):
    assert warc.archive_and_read(spark.createDataFrame([], SCHEMA)).count() == 0
