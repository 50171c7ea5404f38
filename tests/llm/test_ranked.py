"""Ranked search: against brute force, with ties, odd texts and pruned work."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_cases import ODD_TEXTS, clashing, documents

from tallyfold.llm import ranked


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k):
    """Every document scored for every item."""
    words = [(i, plain_terms(t)) for i, t in docs]
    words = [(i, len(w), Counter(w)) for i, w in words if w]
    n_docs, n_terms = len(words), sum(n for _, n, _ in words)
    df = Counter(t for *_, tf in words for t in tf)
    by_item = {}
    for item, text in items:
        by_item.setdefault(item, set()).update(plain_terms(text))
    out = []
    for item, terms in by_item.items():
        scored = []
        for i, n, tf in words:
            m = 100 - 50 + 50 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * tf[t] // (1000 * tf[t] + 20 * m))
                        for t in terms if t in tf)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def texts(rng, n, words=400):
    vocabulary = [f"w{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    return [" ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 60))) for _ in range(n)]


def collected(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def items_table(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string")


@pytest.mark.parametrize("terms_at_once", [1 << 20, 40])
def test_equals_brute_force(spark, terms_at_once):
    rng = random.Random(5)
    own = texts(rng, 600)
    docs = [(i, t) for i, t in enumerate(own)] + [(1000 + i, own[7]) for i in range(30)] + [(None, own[7]), (7, own[7])]
    docs += [(2000 + i, t) for i, t in enumerate(ODD_TEXTS)]
    items = [(i, t) for i, t in enumerate(texts(rng, 25))] + [(3, "W1 w2!w399"), (None, own[7]), (90, ""), (91, None), (92, "unknownterm"), (93, own[7])]
    items_df = items_table(spark, items).selectExpr("*", "'x' AS doc_id", "'y' AS score")
    found = ranked.rank_documents(clashing(documents(spark, docs)), items_df, 10, terms_at_once=terms_at_once, block_docs=128)
    assert collected(found) == plain(docs, items, 10)


def test_terms():
    for text in [*ODD_TEXTS, "A-b_c Éa1@Zz[x]{y}~é　b"]:
        assert ranked.terms_of(None if text is None else text.encode()) == [w.encode() for w in plain_terms(text)]


def test_ties_and_short_lists(spark):
    docs = [(i, "same words here") for i in range(40, 0, -1)]
    docs += [(100, "other")]
    got = collected(ranked.rank_documents(documents(spark, docs), items_table(spark, [(1, "here same"), (2, "other")]), 5))
    assert [(i, r, d) for i, r, d, _ in got] == [(1, r, r) for r in range(1, 6)] + [(2, 1, 100)]


def test_a_frequent_pair_in_a_third_of_all_rows(spark):
    rng = random.Random(9)
    docs = [(i, ("alpha beta " * (1 + i % 3) if i % 3 == 0 else "") + t) for i, t in enumerate(texts(rng, 900))]
    items = [(0, "alpha beta w5 w9"), (1, "beta w200")]
    assert collected(ranked.rank_documents(documents(spark, docs), items_table(spark, items), 50)) == plain(docs, items, 50)


def test_empty_tables(spark):
    some, none = documents(spark, ["a b"]), documents(spark, [])
    assert ranked.rank_documents(none, items_table(spark, [(1, "a")])).count() == 0
    assert ranked.rank_documents(some, items_table(spark, [])).count() == 0
    assert ranked.rank_documents(documents(spark, [None, ""]), items_table(spark, [(1, "a")])).count() == 0


def block_of(rng, joint, n=3000):
    docs = [Counter(plain_terms(t)) for t in texts(rng, n)]
    numbers = {f"w{i}": i for i in range(400)}
    sizes = np.array([len(d) for d in docs])
    terms = np.array([numbers[t] for d in docs for t in d], np.int32)
    tfs = np.array([c for d in docs for c in d.values()], np.int64)
    df = np.bincount(terms, minlength=400)
    items = [[numbers[t] for t in set(plain_terms(t))] for t in texts(rng, 40)]
    pairs, of_item = ranked.pair_up(items, df)
    lengths = [sum(d.values()) for d in docs]
    search = ranked.Search(np.array([ranked.weight(int(x), n) for x in df]), pairs, of_item, np.ones(len(items), np.int64), n, sum(lengths), 10, joint)
    return search, ranked.Block(search, lengths, sizes, terms, tfs)


def test_pair_bounds_hold_and_read_less():
    read = {}
    for joint in (True, False):
        search, block = block_of(random.Random(2), joint)
        score = np.zeros(block.size, np.int64)
        for own in search.of_item:
            everything = block.best(search.pairs, own, 1, score)
            full = score.copy()
            for unit, (a, b) in ((u, search.pairs[u]) for u in own):
                both = np.zeros(block.size, np.int64)
                for t in (a, b):
                    if t >= 0:
                        docs, impacts = block.postings(t)
                        both[docs] += impacts
                # joint bounds are reached, sums of maxima only bound
                assert both.max() == block.bounds[unit] if joint else both.max() <= block.bounds[unit]
            floor = int(np.sort(full[everything])[-10])
            before = block.read
            found = block.best(search.pairs, own, floor, score)
            assert sorted(found) == sorted(np.flatnonzero(full >= floor)) and (score[found] == full[found]).all()
            read[joint] = read.get(joint, 0) + block.read - before
    assert read[True] < read[False]
