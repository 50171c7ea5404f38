"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Texts are lower-cased (A-Z) and cut into words of letters, digits and
non-ASCII characters. Every run of `window` consecutive words of a
benchmark item is a pattern; an item with fewer words (but some) is one
pattern. Patterns of one length share a Wu-Manber table whose letters are
words: a block is up to three words; the shift table tells how far the
search may jump when a block ends at the current word, and a block that no
pattern holds allows the longest jump; a block that ends a pattern selects
a bucket of candidate patterns, which are compared word by word.

Scale: documents are scanned in one pass without a shuffle; the patterns
are broadcast in blocks of at most `patterns_at_once`, one scan per block,
so the broadcast is bounded whatever the size of the benchmark.

Defined cases: null and empty texts have no words and match nothing; an
item with a null item_id marks words as hit but is not listed; repeated
items are one item; empty tables on either side leave nothing hit.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import utf8

# Bytes that are part of a word after lower-casing A-Z
# (0-9, a-z and all bytes of non-ASCII characters); others separate.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
              for c in range(256))

HITS = "struct<n_words:bigint,n_hit:bigint,items:array<bigint>,spans:array<struct<first:bigint,last:bigint>>>"


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def patterns(text: bytes | None, window: int) -> list[tuple[bytes, ...]]:
    w = words(text)
    if not w:
        return []
    return [tuple(w[i:i + window]) for i in range(max(1, len(w) - window + 1))]


class PatternTable:
    """Shift table and suffix buckets for patterns of one length."""

    def __init__(self, found: dict[tuple[bytes, ...], set], length: int):
        self.length, self.block = length, min(3, length)
        self.jump = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], dict[bytes, list]] = defaultdict(lambda: defaultdict(list))
        for pattern, items in found.items():
            for end in range(self.block, length + 1):
                key = pattern[end - self.block:end]
                self.shift[key] = min(self.shift.get(key, self.jump), length - end)
            self.bucket[pattern[-self.block:]][pattern[0]].append((list(pattern), items))
        self.bucket = {k: dict(v) for k, v in self.bucket.items()}

    def occurrences(self, w: list[bytes]) -> Iterable[tuple[int, set]]:
        """(first word, items) of every pattern that occurs in `w`."""
        end, n, length, size = self.length, len(w), self.length, self.block
        shift, jump = self.shift, self.jump
        while end <= n:
            step = shift.get(tuple(w[end - size:end]), jump)
            if step:
                end += step
                continue
            start = end - length
            for pattern, items in self.bucket[tuple(w[end - size:end])].get(w[start], ()):
                if w[start:end] == pattern:
                    yield start, items
            end += 1


def tables_of(rows: Iterable, window: int) -> list[PatternTable]:
    """One table per pattern length from (pattern words, item ids) rows."""
    by_length: dict[int, dict] = defaultdict(dict)
    for row in rows:
        by_length[len(row.pattern)][tuple(bytes(x) for x in row.pattern)] = {i for i in row.items if i is not None}
    return [PatternTable(found, length) for length, found in sorted(by_length.items())]


def scan(text: bytes | None, tables: list[PatternTable]) -> dict:
    w = words(text)
    marked, items = None, set()
    for table in tables:
        for start, found in table.occurrences(w):
            marked = marked or bytearray(len(w))
            marked[start:start + table.length] = b"\1" * table.length
            items |= found
    spans = []
    if marked:
        at = 0
        for hit, run in itertools.groupby(marked):
            size = len(list(run))
            if hit:
                spans.append({"first": at, "last": at + size - 1})
            at += size
    return {"n_words": len(w), "n_hit": sum(marked or ()), "items": sorted(items), "spans": spans}


def _scanner(tables) -> Column:
    @F.pandas_udf(HITS)
    def hits(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([scan(t, tables.value) for t in texts], columns=["n_words", "n_hit", "items", "spans"])

    return hits.asNondeterministic()


def _blocks(found: DataFrame, size: int):
    """The distinct patterns, at most `size` of them in memory at a time."""
    rows = found.toLocalIterator(prefetchPartitions=False)
    while block := list(itertools.islice(rows, size)):
        yield block


def _merge(parts: list[Column]) -> Column:
    """One hit record from those of several pattern blocks."""
    spans = F.flatten(F.array(*(p["spans"] for p in parts)))
    positions = F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["first"], s["last"]))))
    return F.struct(parts[0]["n_words"].alias("n_words"), F.size(positions).cast("bigint").alias("n_hit"),
                    F.array_sort(F.array_distinct(F.flatten(F.array(*(p["items"] for p in parts))))).alias("items"),
                    spans.alias("spans"))


def add_hits(docs: DataFrame, items: DataFrame, name: str, text_col: str = "text", item_col: str = "item_id",
             item_text_col: str = "text", window: int = 10, patterns_at_once: int = 1_000_000) -> DataFrame:
    """`docs` with a column `name`: n_words, n_hit (words inside any
    occurrence), items (sorted ids of the items found) and spans (hit word
    runs; runs from several pattern blocks may overlap)."""
    spark = docs.sparkSession

    @F.pandas_udf("array<array<binary>>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([patterns(t, window) for t in texts], dtype=object)

    found = (items.select(F.col(item_col).cast("bigint").alias("item"), F.explode(cut(utf8(item_text_col))).alias("pattern"))
             .groupBy("pattern").agg(F.collect_set("item").alias("items")))
    parts = []
    for block in _blocks(found, patterns_at_once):
        parts.append(_scanner(spark.sparkContext.broadcast(tables_of(block, window)))(utf8(text_col)))
    if not parts:
        parts.append(_scanner(spark.sparkContext.broadcast([]))(utf8(text_col)))
    if len(parts) == 1:
        return docs.withColumn(name, parts[0])
    names = [f"{name}_{i}" for i in range(len(parts))]
    return docs.withColumns(dict(zip(names, parts))).withColumn(name, _merge([F.col(n) for n in names])).drop(*names)


def clean_documents(docs: DataFrame, items: DataFrame, text_col: str = "text", window: int = 10) -> DataFrame:
    """The documents without any occurrence of a benchmark window."""
    mark = "_hits"
    while mark in docs.columns:
        mark += "_"
    return add_hits(docs, items, mark, text_col, window=window).where(F.col(mark)["n_hit"] == 0).drop(mark)
