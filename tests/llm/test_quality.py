"""Quality classifier: the pairwise identity, gradients by learning, held-out accuracy."""

import itertools
import random

import numpy as np
import pytest
import zlib
from llm_cases import ODD_TEXTS, clashing, documents

from tallyfold.llm import quality


def test_pairwise_identity():
    m = quality.FactorisationMachine(seed=1)
    index, value = quality.features(b"The quick the lazy *** dog\nthe lazy dog", 40)
    m.linear[index] = np.linspace(-1, 1, len(index))
    pairs = sum(float(m.factors[i] @ m.factors[j]) * x * y for (i, x), (j, y) in itertools.combinations(zip(index.tolist(), value.tolist()), 2))
    assert m.raw(index, value) == pytest.approx(m.bias + float(m.linear[index] @ value) + pairs, abs=1e-5)


def test_training_gradient_matches_differences():
    rng = np.random.default_rng(2)
    rows = [quality.features(" ".join(rng.choice(["a", "b", "c", "#", "zz"], 6)).encode(), 12) for _ in range(6)]
    labels, weights = np.array([0, 1, 0, 1, 1, 0], np.float32), np.ones(6, np.float32)

    def loss(m):
        p = [1 / (1 + np.exp(-m.raw(i, v))) for i, v in rows]
        return -np.mean([np.log(x if y else 1 - x) for x, y in zip(p, labels)])
    m = quality.FactorisationMachine(seed=3)
    before = loss(m.train(rows, labels, weights, rounds=1, batch=6, rate=0.0))
    after = loss(quality.FactorisationMachine(seed=3).train(rows, labels, weights, rounds=40, batch=6, rate=0.02))
    assert after < 0.5 * before


def corpus(n, seed=4):
    rng = random.Random(seed)
    texts, marks = [], []
    for i in range(n):
        words = [rng.choice(("house", "river", "the", "of", "stone", "and", "light")) + rng.choice(("", "s", "ly")) for _ in range(rng.randint(20, 90))]
        bad = rng.random() < 0.3
        texts.append(" ".join(w.upper() + "!!" for w in words) if bad and i % 2 else " ".join([rng.choice(words)] * 60) if bad else " ".join(words) + ".")
        marks.append(int(not bad))
    return texts, marks


def test_held_out_accuracy(spark):
    texts, marks = corpus(600)
    docs = clashing(documents(spark, texts))
    labels = spark.createDataFrame(list(enumerate(marks)), "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    rows = docs.select("doc_id", quality.score_column(docs, model).alias("p"), (quality.fold_of() == 0).alias("held")).collect()
    held = [r for r in rows if r.held]
    assert {r.doc_id for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum((r.p >= 0.3) == bool(marks[r.doc_id]) for r in held) >= 0.97 * len(held)
    assert all(0 <= r.p <= 1 for r in rows)
    kept = {r.doc_id for r in quality.accepted(docs, labels).select("doc_id").collect()}
    assert kept == {r.doc_id for r in rows if r.p >= 0.3}


def test_held_out_labels_and_other_columns_do_not_matter(spark):
    texts, marks = corpus(200)
    docs = documents(spark, texts)
    held = {i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0}
    one = quality.fit(docs, spark.createDataFrame(list(enumerate(marks)), "doc_id bigint, quality int"))
    other = quality.fit(docs.selectExpr("doc_id", "text", "n_chars", "'xx' lang", "'yy' source"), spark.createDataFrame(
        [(i, 1 - m if i in held else m) for i, m in enumerate(marks)], "doc_id bigint, quality int"))
    assert [one.score(t.encode(), len(t)) for t in texts[:20]] == [other.score(t.encode(), len(t)) for t in texts[:20]]


def test_odd_rows(spark):
    docs = documents(spark, ODD_TEXTS)
    for rows in ([], [(1, 1), (None, 0), (2, None)], [(i, i % 2) for i in range(len(ODD_TEXTS))] + [(1, 0), (1, 0)]):
        labels = spark.createDataFrame(rows, "doc_id bigint, quality int")
        model = quality.fit(docs, labels)
        assert all(0 <= r.p <= 1 for r in docs.select(quality.score_column(docs, model).alias("p")).collect())
    empty = documents(spark, [])
    assert quality.accepted(empty, spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")).count() == 0
    bare = docs.select("doc_id", "text")
    assert bare.select(quality.score_column(bare, quality.Constant(0.5)).alias("p")).count() == len(ODD_TEXTS)
