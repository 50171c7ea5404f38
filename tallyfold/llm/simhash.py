"""SimHash near-dedup over a vantage-point tree.

Texts become 64-bit fingerprints; two texts are near-duplicates when their
fingerprints differ in at most `radius` bits. The pairs come from a
vantage-point tree: a node holds one fingerprint (the vantage point) and a
distance `mu`; fingerprints within `mu` of it go inside, the others
outside. By the triangle inequality the two ends of a pair differ by at
most `radius` in their distance to the vantage point, so a pair that is
separated has its inner end within `radius` of the boundary: that one is
also sent outside. By induction every pair meets in at least one leaf, and
a branch beyond the bound is never visited. Leaves are shards: Spark
groups the fingerprints by leaf, and each leaf compares its members exactly.

Scale: exact copies fall together in a partial aggregate by fingerprint
before anything else. The tree is built from a bounded sample (a uniform
sample of the distinct fingerprints, so dense regions get more leaves) and
is the only broadcast. A leaf returns a spanning forest, at most one link
per member, so a group of copies never becomes all its pairs. Components
are joined in shared tables; nothing is collected but the sample.

Defined cases: a null or empty text has fingerprint 0 and is linked like
any other; rows with a null doc_id are fingerprinted and linked, but never
name a component (a component of such rows only has a null component_id);
repeated rows are all returned; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import connected_components, hashed_sample, map_lists, stored, utf8, words_of

SEED = 42
BITS_AT_ONCE = 1 << 16


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of the word shingles of one text."""
    words = words_of(text)
    if not words:
        return 0
    joined = b" ".join(words)
    width = min(shingle, len(words))
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e - 1], SEED) for s, e in zip(starts, starts[width:])], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BITS_AT_ONCE):
        part = hashes[i:i + BITS_AT_ONCE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint_column(shingle: int = 3):
    """A column function from UTF-8 bytes to the fingerprint (bigint)."""

    @F.pandas_udf("bigint")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return prints.asNondeterministic()  # never evaluated twice by a pushed-down filter


class VantageTree:
    """Flat arrays of nodes; children are node numbers, or ~leaf for a leaf."""

    def __init__(self, sample: np.ndarray, population: int, radius: int, capacity: int):
        self.radius = radius
        self.point, self.mu, self.inner, self.outer = [], [], [], []
        self.leaves = 0
        weight = population / max(1, len(sample))
        self.root = self._grow(sample, weight, capacity)

    def _leaf(self) -> int:
        self.leaves += 1
        return ~(self.leaves - 1)

    def _grow(self, members: np.ndarray, weight: float, capacity: int) -> int:
        if len(members) * weight <= capacity or len(members) < 8:
            return self._leaf()
        best = (0.95 * len(members) ** 2, None, None)
        # candidate vantage points: evenly spaced members of this branch
        for point in members[:: max(1, len(members) // 8)][:8]:
            upto = np.cumsum(np.bincount(np.bitwise_count(members ^ point), minlength=65))
            inside = upto[:64]
            beyond = len(members) - np.concatenate([np.zeros(self.radius, upto.dtype), upto])[:64]
            cost = inside.astype(float) ** 2 + beyond.astype(float) ** 2
            k = int(cost.argmin())
            if cost[k] < best[0]:
                best = (cost[k], point, k)
        if best[1] is None:  # no split shortens the work: near copies closer than the radius
            return self._leaf()
        _, point, mu = best
        node = len(self.point)
        self.point.append(point), self.mu.append(mu), self.inner.append(0), self.outer.append(0)
        far = np.bitwise_count(members ^ point)
        self.inner[node] = self._grow(members[far <= mu], weight, capacity)
        self.outer[node] = self._grow(members[far > mu - self.radius], weight, capacity)
        return node

    def route(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, index) of every shard that a fingerprint belongs to."""
        leaves, rows = [], []
        stack = [(self.root, np.arange(len(prints)))]
        while stack:
            node, at = stack.pop()
            if not len(at):
                continue
            if node < 0:
                leaves.append(np.full(len(at), ~node, np.int64))
                rows.append(at)
                continue
            far = np.bitwise_count(prints[at] ^ self.point[node])
            stack.append((self.inner[node], at[far <= self.mu[node]]))
            stack.append((self.outer[node], at[far > self.mu[node] - self.radius]))
        none = np.zeros(0, np.int64)
        return np.concatenate(leaves or [none]), np.concatenate(rows or [none])


def leaf_capacity(population: int) -> int:
    """Members a leaf may have. Copies at the boundaries grow with the depth
    of the tree and comparisons with the size of its leaves; leaves that
    grow as the square root of the population balance the two."""
    return max(4096, int(32 * math.sqrt(population)))


def leaf_forest(prints: np.ndarray, radius: int, cells: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (a, b) of the pairs within `radius` among distinct
    fingerprints, as stars around the smallest member of each component.

    Members are sorted by distance to a vantage point of the leaf, so a
    block only meets the members within `radius` of its own distances.
    """
    prints = np.sort(prints)
    far = np.bitwise_count(prints ^ prints[0]).astype(np.int64)
    order = np.argsort(far, kind="stable")
    prints, far = prints[order], far[order]
    labels = np.arange(len(prints))
    block = max(1, cells // max(1, len(prints)))  # rows compared at once, for bounded memory
    for i in range(0, len(prints), block):
        end = int(np.searchsorted(far, far[min(i + block, len(far)) - 1] + radius, "right"))
        near = np.bitwise_count(prints[i:i + block, None] ^ prints[None, i:end]) <= radius
        np.fill_diagonal(near, False)
        for r in np.flatnonzero(near.any(axis=1)):
            hits = i + np.flatnonzero(near[r])
            other = hits[labels[hits] != labels[i + r]]
            if len(other):
                labels[np.isin(labels, np.unique(labels[other]))] = labels[i + r]
    _, group, size = np.unique(labels, return_inverse=True, return_counts=True)
    signed = prints.view(np.int64)
    lowest = np.full(len(size), np.iinfo(np.int64).max)
    np.minimum.at(lowest, group, signed)
    linked = (size[group] > 1) & (signed != lowest[group])
    return signed[linked], lowest[group][linked]


def near_links(distinct: DataFrame, radius: int = 3, capacity: int | None = None, sample_rows: int = 16384) -> DataFrame:
    """Links (a, b) that span the pairs of distinct fingerprints (column
    `fp`) within `radius` bits. `sample_rows` bounds the sample the tree is
    built from."""
    population = distinct.count()
    rows = hashed_sample(distinct.select("fp"), sample_rows, "fp", total=population).collect()
    sample = np.array([r.fp for r in rows], dtype=np.int64).view(np.uint64)
    tree = distinct.sparkSession.sparkContext.broadcast(
        VantageTree(sample, population, radius, capacity or leaf_capacity(population)))

    def start():
        def step(fp):
            prints = np.array(fp, dtype=np.int64)
            leaf, row = tree.value.route(prints.view(np.uint64))
            return {"leaf": leaf, "fp": prints[row]}
        return step

    shards = map_lists(distinct.select("fp"), start, pa.schema([("leaf", pa.int64()), ("fp", pa.int64())]), rows=65_536)

    def compare(shard: pa.Table) -> pa.Table:
        a, b = leaf_forest(shard.column("fp").to_numpy().view(np.uint64), radius)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return shards.groupBy("leaf").applyInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    radius: int = 3) -> DataFrame:
    """One row per document: doc_id, text_hash (of the text, to tell rows
    with one doc_id apart), fp (bigint) and component_id, the smallest
    doc_id among the documents linked to it."""
    prints = stored(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"),
                                fingerprint_column(shingle)(utf8(text_col)).alias("fp")), "prints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-prints")
    parts = connected_components(near_links(distinct, radius))
    rooted = stored(distinct.join(parts, F.col("fp") == F.col("node"), "left")
                    .select("fp", "low", F.coalesce("component", "fp").alias("root")), "rooted")
    lowest = stored(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "lowest")
    named = stored(rooted.join(lowest, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id")


def fingerprint_hex(fp):
    """16 lower-case hex digits of a fingerprint column."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
             radius: int = 3) -> DataFrame:
    """The documents with one of each group of near-duplicates left: the one
    with the smallest doc_id (then text hash). Of wholly repeated rows one
    stays. A group of rows that all lack a doc_id keeps its smallest text
    hash."""
    found = near_duplicates(docs, id_col, text_col, shingle, radius)
    group = F.coalesce("component_id", "fp")
    first = found.groupBy(group.alias("g"), F.col("component_id").isNull().alias("anonymous")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("k"))
    first = stored(first.select(F.col("k.doc_id").alias("_keep_id"), F.col("k.text_hash").alias("_keep_text")).distinct(), "kept")
    kept = docs.join(first, docs[id_col].eqNullSafe(first["_keep_id"]) & (F.xxhash64(docs[text_col]) == first["_keep_text"]),
                     "left_semi")
    return kept.dropDuplicates([id_col, text_col])
