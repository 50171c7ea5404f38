"""SimHash: fingerprints, tree, leaves and components against plain versions."""

import numpy as np
import pytest
import xxhash
from llm_cases import ODD_TEXTS, clashing, documents
from pyspark.sql import functions as F

from tallyfold.llm import simhash
from tallyfold.llm.common import connected_components


def plain_fingerprint(text, k=3):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(
        str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=3):
    """{key: smallest linked key} from {key: fingerprint}, over all pairs."""
    root = {k: k for k in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


@pytest.mark.parametrize("text", [*ODD_TEXTS, "one two", "One TWO three", "a b c d e f g a b c", "É é ÀB"])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode() if text else None) % (1 << 64) == plain_fingerprint(text)


def test_spark_text_hash_is_the_same_xxh64(spark):
    row = spark.createDataFrame([("naïve text",)], "t string").select(F.xxhash64("t").alias("h")).first()
    assert row.h % (1 << 64) == xxhash.xxh64_intdigest("naïve text".encode(), 42)


def clustered(seed, loose=300, centres=12, near=25):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, loose, dtype=np.uint64)
    parts = [base]
    for c in base[:centres]:
        for _ in range(near):
            for bit in rng.integers(0, 64, rng.integers(1, 5)):
                c = c ^ (np.uint64(1) << np.uint64(bit))
            parts.append(np.array([c]))
    return np.unique(np.concatenate(parts))


@pytest.mark.parametrize("capacity", [16, 64, 100_000])
def test_tree_routes_every_pair_to_a_common_leaf(capacity):
    prints = clustered(3)
    tree = simhash.VantageTree(prints[::2], len(prints), 3, capacity)
    leaf, row = tree.route(prints)
    shards = [set(leaf[row == i].tolist()) for i in range(len(prints))]
    assert all(shards)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    assert all(shards[a] & shards[b] for a, b in zip(*np.nonzero(near)))


def test_leaf_forest_spans_the_pairs():
    prints = clustered(4)
    a, b = simhash.leaf_forest(prints, 3, cells=4000)
    assert len(a) < len(prints)  # a forest
    got = {int(x): int(x) for x in prints.view(np.int64)} | dict(zip(a.tolist(), b.tolist()))
    want = plain_components({int(x): int(x) % (1 << 64) for x in prints.view(np.int64)})
    assert got == want


def test_near_duplicates_match_brute_force(spark):
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join(words), " ".join([*words, "tail"]), " ".join(["HEAD", *words]), "x y z", "X y\tz", "", None, "p q r s t u"]
    docs = documents(spark, [*texts, *ODD_TEXTS])
    got = {r.doc_id: r for r in simhash.near_duplicates(clashing(docs)).collect()}
    prints = {i: plain_fingerprint(t) for i, t in enumerate([*texts, *ODD_TEXTS])}
    want = plain_components(prints)
    assert {i: r.fp % (1 << 64) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == want


def test_null_and_repeated_ids(spark):
    docs = documents(spark, [(None, "only here and alone"), (5, "twice the same"), (5, "twice the same"), (7, "twice the same"), (None, "twice the same")])
    got = sorted(str((r.doc_id, r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == sorted(map(str, [(None, None), (5, 5), (5, 5), (7, 5), (None, 5)]))
    kept = simhash.keep_one(docs).select("doc_id", "text").collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("5", "twice the same"), ("None", "only here and alone")]


def test_empty_table(spark):
    docs = documents(spark, [])
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_one(docs).columns == docs.columns


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 160)] + [(300, 301), (301, 300), (7, 7), (500, 500)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 160)} | {300: 300, 301: 300}
    assert got == want


def test_hashed_sample(spark):
    from tallyfold.llm.common import hashed_sample

    got = [r.id for r in hashed_sample(spark.range(20_000), 300, "id").collect()]
    assert len(set(got)) == 300 and got == [r.id for r in hashed_sample(spark.range(20_000).repartition(9), 300, "id").collect()]
    assert 7_000 < sum(got) / 300 < 13_000
    assert hashed_sample(spark.range(50), 300, "id").count() == 50 and hashed_sample(spark.range(0), 5, "id").count() == 0
