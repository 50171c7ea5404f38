"""Sharding: LPT against a plain heap, equal texts together, gapless slots."""

import random

import pytest
from llm_cases import ODD_TEXTS, clashing, documents
from pyspark.sql import functions as F

from tallyfold.llm import sharding


def test_longest_first_is_plain_lpt():
    rng = random.Random(3)
    items = [(i, rng.randint(1, 1000)) for i in range(500)]
    loads, want = [0] * 8, {}
    for item, size in sorted(items, key=lambda x: (-x[1], x[0])):
        shard = loads.index(min(loads))
        want[item] = shard
        loads[shard] += size
    assert sharding.longest_first(items, 8) == want
    assert max(loads) - min(loads) <= 1000


def assigned(docs, shards=8):
    return sharding.assign_shards(docs, shards, carry={"doc_id": F.col("doc_id"), "text": F.col("text")}).collect()


def test_groups_sizes_and_slots(spark, monkeypatch):
    rng = random.Random(5)
    texts = ["x" * rng.randint(0, 300) + str(rng.randint(0, 40)) for _ in range(400)] + ["hot " * 5] * 150 + [t for t in ODD_TEXTS if t is None or len(t) < 1000]
    docs = clashing(documents(spark, texts).repartition(7))
    for parts in (sharding.PARTS, 16):  # 16: most groups share bundles
        monkeypatch.setattr(sharding, "PARTS", parts)
        rows = assigned(docs)
        assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
        home = {}
        for r in rows:
            assert r["size"] == len((r.text or "").encode()) + 1
            assert home.setdefault(r.text or "", r.shard) == r.shard
        for s in range(8):
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    loads = [sum(r["size"] for r in assigned(docs, 4) if r.shard == s) for s in range(4)]
    assert max(loads) - min(loads) <= 150 * 21


def test_near_equal(spark, monkeypatch):
    texts = [f"{i} " + "y" * (i % 97) for i in range(3000)]
    monkeypatch.setattr(sharding, "PARTS", 512)
    rows = assigned(documents(spark, texts))
    loads = [sum(r["size"] for r in rows if r.shard == s) for s in range(8)]
    assert max(loads) - min(loads) <= 0.01 * sum(loads) / 8


@pytest.mark.parametrize("texts", [[], [None, None, ""], [(None, "a"), (None, "a"), (3, "b")]])
def test_small_tables(spark, texts):
    rows = assigned(documents(spark, texts))
    assert len(rows) == len(texts)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
