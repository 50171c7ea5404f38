"""Ranked lexical search: MaxScore with bounds of term pairs.

Every document is ranked for every item of a stated query set by the sum of
the impacts of the item's terms. A block of documents is indexed by term
(documents and impacts), with each term's largest impact. The terms of an
item are paired, the two most frequent first; for every pair the two lists
are intersected and the largest joint impact is stored. What a pair can add
to any document of the block is then at most the larger of the joint maximum
and the two single maxima, which is below the sum of the single maxima
unless one document has both.

At query time the pairs of an item are sorted by that bound. Those with the
smallest bounds whose sum is below the score of the item's k-th best
document so far are not essential: a document that holds no other term
cannot be among the best. Only the lists of the essential pairs are merged;
the others are looked up for the documents that are left, the largest bound
first, and a document goes as soon as its score and the bounds still to come
stay below the k-th best. Scores equal to the k-th best are kept, as the
smaller id decides among equals. So the result is exact.

Scale: items are dealt with in blocks of about `terms_at_once` terms, each
with one scan of the texts that stores, per document, its length and the
counts of the block's terms; broadcasts and the driver hold one block at a
time. Document frequencies are partial aggregates. The floor of every item
is the k-th best score in a share of the documents, found first (any subset
gives a valid floor); with it a task returns few documents for each item, at
most k, and these are reduced by two rounds of Spark's ranked window. A
posting list never leaves its task, so a word in a third of all documents
is an ordinary list of every block.

Recovery: counts, floors and results of a block of items are stored tables.

Defined cases: a null or empty text has no terms and is never a result; a
very long text is counted whole; documents with repeated ids or equal texts
are ranked as rows of their own, null ids after all others; items with one
id (null is an id too) are one item with the terms of all its rows; an item
without terms that any document holds has no result; empty tables give an
empty result; only the named columns are read, so others cannot clash. An
impact beyond 64 bits (terms repeated 10^9 times in one text) is not
expected and not checked.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import map_lists, stored, utf8

# Fixed value: terms are runs of ASCII letters, digits and non-ASCII characters; only A-Z change to a-z.
_TERM = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))
NO_ID = 2**63 - 1  # stands for a null id among numbers; a flag tells it from the id itself

COUNTS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])
FOUND = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TERM).split() if text else []


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def pair_up(items: list[list[int]], df: np.ndarray) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
    """(pairs of terms, for each item the numbers of its pairs). Neighbours
    by falling document frequency make a pair; a term left over has -1 as
    its partner; terms in no document are left out."""
    numbers: dict[tuple[int, int], int] = {}
    of_item = []
    for terms in items:
        ordered = sorted((t for t in terms if df[t]), key=lambda t: (-df[t], t)) + [-1]
        pairs = [(ordered[i], ordered[i + 1]) for i in range(0, len(ordered) - 1, 2)]
        of_item.append(np.array([numbers.setdefault(p, len(numbers)) for p in pairs], np.int64))
    return list(numbers), of_item


@dataclass
class Search:
    """What a task needs: weights by term number, the pairs, the items' pairs
    and floors, and the collection's size in documents and terms."""

    weights: np.ndarray
    pairs: list[tuple[int, int]]
    of_item: list[np.ndarray]
    floors: np.ndarray
    n_docs: int
    n_terms: int
    k: int
    joint: bool = True  # False: independent term maxima, for comparison

    def impacts(self, terms: np.ndarray, tfs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return self.weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * lengths))

    def stretched(self, n: list[int]) -> np.ndarray:
        """The length measure of documents; n times the number of documents may exceed 64 bits."""
        return np.array([50 + 50 * x * self.n_docs // self.n_terms for x in n], np.int64)


class Block:
    """The index of some documents: lists by term, their maxima, and the
    bounds of the pairs."""

    def __init__(self, search: Search, n: list[int], sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray):
        doc = np.repeat(np.arange(len(n)), sizes)
        impacts = search.impacts(terms, tfs, search.stretched(n)[doc])
        order = np.argsort(terms, kind="stable")
        self.docs, self.impacts, self.size = doc[order], impacts[order], len(n)
        counts = np.bincount(terms, minlength=len(search.weights))
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        self.highest = np.zeros(len(counts), np.int64)
        held = np.flatnonzero(counts)
        if len(held):
            self.highest[held] = np.maximum.reduceat(self.impacts, self.starts[held])
        self.bounds = np.array([self._bound(a, b, search.joint) for a, b in search.pairs], np.int64)
        self.read = 0  # list entries merged or looked up, for comparison

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.starts[term], self.ends[term])
        return self.docs[at], self.impacts[at]

    def _bound(self, a: int, b: int, joint: bool) -> int:
        """The most that the pair adds to a document of the block."""
        if b < 0:
            return self.highest[a]
        single = max(self.highest[a], self.highest[b])
        if not joint:
            return self.highest[a] + self.highest[b]
        if not self.highest[a] or not self.highest[b]:
            return single
        (docs, impacts), (others, more) = self.postings(a), self.postings(b)
        if len(docs) < len(others):
            docs, impacts, others, more = others, more, docs, impacts
        at = np.minimum(np.searchsorted(docs, others), len(docs) - 1)
        both = docs[at] == others
        return max(single, np.max(impacts[at[both]] + more[both], initial=0))

    def _lists(self, pair: tuple[int, int]) -> list[tuple[np.ndarray, np.ndarray]]:
        return [self.postings(t) for t in pair if t >= 0 and self.starts[t] < self.ends[t]]

    def best(self, pairs: list[tuple[int, int]], own: np.ndarray, floor: int, score: np.ndarray) -> np.ndarray:
        """The documents whose score is `floor` (1 at least) or more; their
        scores are left in `score`, a buffer of one number a document."""
        score[:] = 0
        order = own[np.argsort(self.bounds[own], kind="stable")]
        below = np.cumsum(self.bounds[order])
        essential = int(np.searchsorted(below, floor))  # the pairs before it stay below the floor together
        for unit in order[essential:]:
            for docs, impacts in self._lists(pairs[unit]):
                score[docs] += impacts
                self.read += len(docs)
        left = np.flatnonzero(score)
        for i in range(essential - 1, -1, -1):
            left = left[score[left] + below[i] >= floor]
            if not len(left):
                return left
            for docs, impacts in self._lists(pairs[order[i]]):
                if len(left) > len(docs):
                    score[docs] += impacts  # what is not left is not read again
                    self.read += len(docs)
                else:
                    at = np.minimum(np.searchsorted(docs, left), len(docs) - 1)
                    held = docs[at] == left
                    score[left[held]] += impacts[at[held]]
                    self.read += len(left)
        return left[score[left] >= floor]


class Best:
    """The k best documents of an item so far."""

    def __init__(self, k: int, floor: int):
        self.k, self.floor = k, max(1, int(floor))
        self.scores, self.ids, self.nulls = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        scores, ids, nulls = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.nulls, nulls)))
        kept = np.lexsort((nulls, ids, -scores))[:self.k]
        self.scores, self.ids, self.nulls = scores[kept], ids[kept], nulls[kept]
        if len(kept) == self.k:
            self.floor = max(self.floor, int(self.scores[-1]))


def count_terms(docs: DataFrame, vocabulary, id_col: str, text_col: str) -> DataFrame:
    """One row per document with a term: doc_id, n (all its terms), and the
    numbers and counts of those in the broadcast vocabulary."""

    def start():
        number = vocabulary.value.get

        def step(ids, texts):
            rows = []
            for doc_id, text in zip(ids, texts):
                words = terms_of(text)
                if words:
                    tf = Counter(map(number, words))
                    tf.pop(None, None)
                    rows.append((doc_id, len(words), list(tf), list(tf.values())))
            return {f.name: [r[i] for r in rows] for i, f in enumerate(COUNTS)}
        return step

    return map_lists(docs.select(F.col(id_col).cast("bigint"), utf8(text_col)), start, COUNTS, rows=256)


def _search(counts: DataFrame, search, block_docs: int, block_entries: int = 1 << 22) -> DataFrame:
    """The best documents of each item in every partition: item, doc_id, score."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, entries = [], 0, 0
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                held.append(part)
                docs, entries = docs + part.num_rows, entries + len(part.column("terms").flatten())
                if docs >= block_docs or entries >= block_entries:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held, docs, entries = [], 0, 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Search = search.value
        best = [Best(own.k, floor) for floor in own.floors]
        for table in blocks(batches):
            ids, terms, tfs = (table.column(c).combine_chunks() for c in ("doc_id", "terms", "tfs"))
            nulls = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(NO_ID).to_numpy()
            block = Block(own, table.column("n").to_pylist(), terms.value_lengths().to_numpy(),
                          terms.flatten().to_numpy(), tfs.flatten().to_numpy())
            score = np.zeros(block.size, np.int64)
            for item, units in enumerate(own.of_item):
                if len(units):
                    found = block.best(own.pairs, units, best[item].floor, score)
                    if len(found):
                        best[item].add(score[found], ids[found], nulls[found])
        for item, b in enumerate(best):
            if len(b.scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.scores), item, np.int32)),
                                                  pa.array(b.ids, mask=b.nulls), pa.array(b.scores)], schema=FOUND)

    return counts.mapInArrow(run, "item int, doc_id bigint, score bigint")


def best_k(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item with their rank; first within 256 parts
    of an item, then over what those leave."""
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    place = F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))
    parts = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(256))).withColumn("place", place).where(F.col("place") <= k)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    return parts.select("item", "doc_id", "score", rank.cast("int").alias("rank")).where(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text", terms_at_once: int = 1 << 20,
                   block_docs: int = 16_384, floor_share: int = 8) -> DataFrame:
    """item_id, rank, doc_id and score of each item's k best documents.
    Floors come from one in `floor_share` documents, chosen by hash."""
    spark = docs.sparkSession

    def start():
        return lambda item_ids, texts: dict(zip(("item_id", "term"), map(list, zip(*(
            (i, t) for i, text in zip(item_ids, texts) for t in set(terms_of(text))))))) or {"item_id": [], "term": []}

    wanted = stored(map_lists(items.select(F.col(item_col).cast("bigint"), utf8(item_text_col)), start,
                              pa.schema([("item_id", pa.int64()), ("term", pa.binary())])).distinct(), "query-terms")
    blocks = max(1, -(-wanted.count() // terms_at_once))
    wanted = wanted.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    ranked = []
    for number in range(blocks):
        rows = wanted.where(F.col("block") == number).groupBy("item_id").agg(F.collect_list("term").alias("terms")).collect()
        if not rows:
            continue
        rows.sort(key=lambda r: (r.item_id is None, r.item_id or 0))
        numbers: dict[bytes, int] = {}
        terms = [[numbers.setdefault(bytes(t), len(numbers)) for t in sorted(r.terms)] for r in rows]
        vocabulary = spark.sparkContext.broadcast(numbers)
        counts = stored(count_terms(docs, vocabulary, id_col, text_col), "term-counts")
        total = counts.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
        df = np.zeros(len(numbers), np.int64)
        for r in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one block's terms
            df[r.term] = r["count"]
        pairs, of_item = pair_up(terms, df)
        search = Search(np.array([weight(int(d), total.n) for d in df], np.int64), pairs, of_item,
                        np.ones(len(rows), np.int64), total.n, max(1, total.l or 0), k)
        sent = spark.sparkContext.broadcast(search)
        some = counts.where(F.pmod(F.xxhash64("doc_id", "n", "tfs"), F.lit(floor_share)) == 0)
        for r in best_k(_search(some, sent, block_docs), k).where(F.col("rank") == k).collect():  # one number an item
            search.floors[r.item] = r.score
        sent.unpersist()
        sent = spark.sparkContext.broadcast(search)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], "item int, item_id bigint")
        best = best_k(_search(counts, sent, block_docs), k).join(names, "item")
        ranked.append(stored(best.select("item_id", "rank", "doc_id", "score"), "ranked"))
        for b in (vocabulary, sent):
            b.unpersist()
    if not ranked:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    out = ranked[0]
    for more in ranked[1:]:
        out = out.unionByName(more)
    return out
