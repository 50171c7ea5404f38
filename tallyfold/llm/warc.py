"""WARC archives and their index, merged by loser trees.

Writing: pages become WARC/1.0 records (an HTTP message as the block) in
gzip files of a bounded number of records. Of equal payloads of at least
`least_bytes` the smallest page_id is stored in full (response); the others
are revisit records that refer to it and hold the HTTP head alone.

Reading: each archive is read as a stream, payload digests and lengths are
taken from the bytes of full records, and its captures form a run sorted
by URL key, timestamp and page. The runs are cut at common key boundaries;
each key range merges its piece of every run through a loser tree, so the
ranges together are the globally ordered capture history.

Scale: records are written and parsed where they lie. Only the index (no
payloads) is shuffled. Ranges are cut by (URL key, timestamp, page) from a
bounded sample, so a hot host or a single hot URL is spread over many
ranges. Equal payloads are found by a partial minimum per digest and one
join whose sides AQE can split.

The page table has no capture time; WARC-Date is a fixed start plus
page_id seconds, so it is the same on every run.

Defined cases: a null html is an empty payload; a null URL leaves the
header out and has an empty key; a null page_id is never referred to and is
always a response; rows that repeat the first page_id of a payload are
responses too; an empty table writes no record and gives no row.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.common import hashed_sample, map_lists, sql_type, stored
from tallyfold.session import scratch_path

END = "\r\n"
# Fixed value: the profile name of revisit records in the WARC standard.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
FIRST_SECOND = 1577836800  # 2020-01-01T00:00:00Z

CAPTURE = pa.struct([("url_key", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()),
                     ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
                     ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64())])


def _lines(*parts: Column) -> Column:
    """Header lines; a null part is a line left out."""
    return F.concat(F.concat_ws(END, *parts), F.lit(END + END))


def _field(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value)


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def records(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """One column `value`: a WARC record without its closing empty lines."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"),
                        F.octet_length(html).alias("size"))
    first = stored(rows.where(F.col("size") >= least_bytes).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "payloads")
    joined = rows.join(first, "digest", "left")
    revisit = F.coalesce(F.col("first") != F.col("page_id"), F.lit(False))
    message = _lines(F.lit("HTTP/1.1 200 OK"), _field("Content-Type", "text/html; charset=utf-8"),
                     _field("Content-Length", F.col("size").cast("string")))
    block = F.when(revisit, message).otherwise(F.concat(message, "html"))
    date = F.date_format(F.timestamp_seconds(F.lit(FIRST_SECOND) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    head = _lines(F.lit("WARC/1.0"), _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
                  _field("WARC-Record-ID", _record_id(F.col("page_id"))), _field("WARC-Date", date),
                  _field("WARC-Target-URI", url), _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
                  F.when(revisit, _field("WARC-Refers-To", _record_id(F.col("first")))),
                  F.when(revisit, _field("WARC-Profile", REVISIT_PROFILE)),
                  _field("Content-Type", "application/http; msgtype=response"),
                  _field("Content-Length", F.octet_length(block).cast("string")))
    return joined.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 100, records_per_file: int = 10_000) -> None:
    """WARC files under `path`. A record ends with two empty lines, which is
    the row separator of the text sink."""
    (records(pages, least_bytes).write.option("lineSep", END + END).option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(path))


def url_key(url: str) -> str:
    """Host names reversed, then the path: com,example)/a?b"""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.strip().lower()
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/")
    return key + (f"?{parts.query}" if parts.query else "")


def _page_number(record_id: str) -> int | None:
    number = record_id.removeprefix("<urn:page:").removesuffix(">")
    return None if number == "none" else int(number)


class _Counted:
    def __init__(self, stream):
        self.stream, self.at = stream, 0

    def read(self, n: int) -> bytes:
        data = self.stream.read(n)
        self.at += len(data)
        return data

    def head(self) -> list[str]:
        lines = []
        while (line := self.stream.readline()) not in (b"", b"\r\n"):
            self.at += len(line)
            lines.append(line[:-2].decode("utf-8"))
        self.at += len(line)
        return lines


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}


def captures(stream, archive: str):
    """The index entries of one uncompressed WARC stream, in file order."""
    source = _Counted(stream)
    while True:
        offset = source.at
        lines = source.head()
        if not lines:
            return
        fields = _fields(lines)
        start = source.at
        message = _fields(source.head())
        size = int(message["content-length"])
        digest = fields["warc-payload-digest"].removeprefix("sha256:")
        left = int(fields["content-length"]) - (source.at - start)
        if fields["warc-type"] == "response":
            state = hashlib.sha256()
            size = left
            while left:
                part = source.read(min(left, 1 << 20))
                if not part:
                    raise EOFError(f"{archive}: record at {offset} is cut short")
                state.update(part)
                left -= len(part)
            if state.hexdigest() != digest:
                raise ValueError(f"{archive}: payload at {offset} does not match its digest")
        source.read(4)
        refers = fields.get("warc-refers-to")
        yield (url_key(fields.get("warc-target-uri", "")), fields["warc-date"], _page_number(fields["warc-record-id"]),
               size, digest, fields["warc-type"], _page_number(refers) if refers else None, archive, offset)


def order_key(capture: tuple) -> tuple:
    """URL key, timestamp, page (none first), then place in the archives."""
    return (capture[0], capture[1], capture[2] is not None, capture[2] or 0, capture[7], capture[8])


class LoserTree:
    """k-way merge of sorted runs: inner nodes hold the loser of the match
    below them, so replacing the winner replays one path to the root."""

    def __init__(self, runs: list, key):
        self.runs, self.key = [iter(r) for r in runs], key
        self.k = len(self.runs)
        self.head: list = [None] * self.k
        self.rank: list = [None] * self.k  # None: the run is at its end
        for i in range(self.k):
            self._advance(i)
        self.loser = [-1] * self.k
        self.winner = self._build(1) if self.k else -1

    def _advance(self, i: int) -> None:
        self.head[i] = next(self.runs[i], None)
        self.rank[i] = None if self.head[i] is None else (self.key(self.head[i]), i)

    def _beats(self, a: int, b: int) -> bool:
        return self.rank[b] is None or (self.rank[a] is not None and self.rank[a] < self.rank[b])

    def _build(self, node: int) -> int:
        """Winner below `node`; leaves are nodes k..2k-1."""
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (a, b) if self._beats(a, b) else (b, a)
        self.loser[node] = lose
        return win

    def __iter__(self):
        while self.k and self.rank[self.winner] is not None:
            i = self.winner
            yield self.head[i]
            self._advance(i)
            node = (i + self.k) // 2
            while node:
                if self._beats(self.loser[node], i):
                    self.loser[node], i = i, self.loser[node]
                node //= 2
            self.winner = i


def _boundaries(spark: SparkSession, pages: DataFrame, per_range: int, sample_rows: int) -> list[tuple]:
    """Keys that cut the captures into ranges of about `per_range`, from a
    uniform sample of at most `sample_rows` pages."""
    n = pages.count()
    named = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))
    rows = (hashed_sample(named, sample_rows, "page_id", "url", total=n)
            .select("page_id", "url", F.date_format(F.timestamp_seconds(F.lit(FIRST_SECOND) + F.coalesce("page_id", F.lit(0))),
                                                    "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date")).collect())
    keys = sorted(order_key((url_key(r.url or ""), r.date, r.page_id, 0, "", "", None, "", -1)) for r in rows)
    ranges = max(1, -(-n // per_range))
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)})


def capture_history(spark: SparkSession, path: str, boundaries: list[tuple]) -> DataFrame:
    """Captures of all archives under `path`: key_range, place (in the
    range), and the fields of a capture; ordered by (key_range, place)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    names = [f.name for f in CAPTURE]

    def start():
        from bisect import bisect_right

        def step(paths, contents):
            ranges, runs = [], []
            for name, content in zip(paths, contents):
                run = sorted(captures(gzip.open(io.BytesIO(content)), name.rsplit("/", 1)[-1]), key=order_key)
                at = 0
                while at < len(run):
                    k = bisect_right(boundaries, order_key(run[at]))
                    end = at + 1
                    while end < len(run) and bisect_right(boundaries, order_key(run[end])) == k:
                        end += 1
                    ranges.append(k)
                    runs.append([dict(zip(names, c)) for c in run[at:end]])
                    at = end
            return {"key_range": ranges, "run": runs}
        return step

    out = pa.schema([("key_range", pa.int64()), ("run", pa.list_(CAPTURE))])
    cut = map_lists(files, start, out, rows=8)

    def merge(key: tuple, pieces: pa.Table) -> pa.Table:
        runs = [[tuple(c.values()) for c in run] for run in pieces.column("run").to_pylist()]
        merged = list(LoserTree(runs, order_key))
        columns = list(zip(*merged)) if merged else [[] for _ in names]
        return pa.table({"key_range": pa.array([key[0].as_py()] * len(merged), pa.int64()),
                         "place": pa.array(range(len(merged)), pa.int64())}
                        | {f.name: pa.array(c, f.type) for f, c in zip(CAPTURE, columns)})

    fields = ", ".join(f"`{f.name}` {sql_type(f.type)}" for f in CAPTURE)
    return cut.groupBy("key_range").applyInArrow(merge, f"key_range bigint, place bigint, {fields}")


def archive_and_read(pages: DataFrame, least_bytes: int = 100, per_range: int = 20_000,
                     sample_rows: int = 8192) -> DataFrame:
    """Write the archives of `pages` in the shared folder and read them back
    as the merged capture history."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, least_bytes)
    return capture_history(spark, path, _boundaries(spark, pages, per_range, sample_rows))
