"""Decontamination: the Wu-Manber tables against plain comparison at every place."""

import random
import re

import pytest
from llm_cases import ODD_TEXTS, clashing, documents

from tallyfold.llm import decontam

PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return PLAIN_WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_hits(text, items, window):
    w = plain_words(text)
    hit, found = set(), set()
    for item, t in items:
        p = plain_words(t)
        for i in range(max(1, len(p) - window + 1) if p else 0):
            part = p[i:i + window]
            for at in range(len(w) - len(part) + 1):
                if w[at:at + len(part)] == part:
                    hit |= set(range(at, at + len(part)))
                    if item is not None:
                        found.add(item)
    return len(w), len(hit), sorted(found)


def test_words():
    for text in ("Naïve Ünïcode-99 x_y", "A`B{C~D", "", "\x00a\x7fb", "ÀB漢字 z9"):
        assert [w.decode() for w in decontam.words(text.encode())] == plain_words(text)


def cases(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "x", "y", "zed", "é"]

    def some(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, some(rng.choice((1, 2, 3, 5, 9, 10, 11, 25)))) for i in range(12)] + [(3, some(12)), (None, some(10)), (90, None), (91, ""), (92, "?!")]
    texts = [some(rng.randint(0, 60)) for _ in range(25)]
    for _, t in items:
        if t:
            texts.append(some(7) + ", " + t.upper() + "! " + some(4))
            texts.append(" ".join(t.split()[1:]))
    return texts + ODD_TEXTS[:9], items


@pytest.mark.parametrize("seed,window,at_once", [(1, 10, 1_000_000), (2, 4, 1_000_000), (3, 10, 15)])
def test_matches_plain_search(spark, seed, window, at_once):
    texts, items = cases(seed)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = decontam.add_hits(clashing(documents(spark, texts)), bench, "found", window=window, patterns_at_once=at_once).select("doc_id", "found").collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.found.n_words, r.found.n_hit, list(r.found["items"])) == plain_hits(texts[r.doc_id], items, window)
        covered = {k for s in r.found.spans for k in range(s["first"], s["last"] + 1)}
        assert len(covered) == r.found.n_hit


def test_clean_documents(spark):
    item = " ".join(f"q{i}" for i in range(14))
    texts = ["nothing of it", "start " + item, " ".join(item.split()[:9]), "x " + " ".join(item.split()[2:12]) + " y", None, ""]
    docs = clashing(documents(spark, texts))
    kept = decontam.clean_documents(docs, spark.createDataFrame([(1, item)], "item_id bigint, text string"))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 4, 5]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.clean_documents(documents(spark, ["a b c"]), none).count() == 1
    assert decontam.clean_documents(documents(spark, []), spark.createDataFrame([(1, "a")], "item_id bigint, text string")).count() == 0
