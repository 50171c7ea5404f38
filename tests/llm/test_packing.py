"""Packing: ids, pieces, placement and the best-fit rule."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import ODD_TEXTS, clashing, documents

from tallyfold.llm import packing, tokens

VOCABULARY = tokens.vocabulary_path()


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.sampled_from("aB 1.'\n\t sreté漢 　\x1c🙂<|>"), st.characters(codec="utf-8")), max_size=60))
def test_ids_equal_the_vocabulary_files(reference, text):
    assert tokens.load_encoder(VOCABULARY)(text).tolist() == reference(text)


def test_ids_of_special_strings(reference):
    for text in ("<|endoftext|>", "a<|endoftext|>b", "a <|endoftext|>\n<|endoftext|><|endoftext|> b<|endoftext", "it's  we'll\n\n  x"):
        assert tokens.load_encoder(VOCABULARY)(text).tolist() == reference(text)


@pytest.mark.parametrize("space", [" ", "\t", "\n", "\u3000", "\x85", " \n"])
def test_ids_of_long_white_space(reference, space):
    run = space * 9_999
    for text in (run, run + "a", run + " a", "a" + run + "\nb" + run, run + "<|endoftext|>" + run + " x"):
        assert tokens.load_encoder(VOCABULARY)(text).tolist() == reference(text)
        double = text.replace(run, run + run)
        assert tokens.load_encoder(VOCABULARY)(double).tolist() == reference(double)


@pytest.mark.parametrize("space", [" ", "\t", "\n", "\u3000"])
def test_ids_of_two_million_white_space(reference, space):
    text = "a" + space * 2_000_000 + "b"
    assert tokens.load_encoder(VOCABULARY)(text).tolist() == reference(text)


class PlainBins:
    """Best fit over a plain list, the fullest closing first."""

    def __init__(self, size, limit):
        self.size, self.limit, self.open, self.made = size, limit, [], 0

    def place(self, length):
        fits = [f for _, f in self.open if f >= length]
        if fits:
            at = max(i for i, (_, f) in enumerate(self.open) if f == min(fits))
            number, free = self.open.pop(at)
        else:
            number, free = self.made, self.size
            self.made += 1
        left = free - length
        if left:
            if len(self.open) == self.limit:
                fullest = min(f for _, f in self.open)
                if fullest > left:
                    return number, self.size - free
                self.open.pop(max(i for i, (_, f) in enumerate(self.open) if f == fullest))
            self.open.append((number, left))
        return number, self.size - free


@pytest.mark.parametrize("limit", [1, 3, 50])
def test_bitset_bins_are_bounded_best_fit(limit):
    rng = random.Random(limit)
    plain, bins = PlainBins(64, limit), packing.OpenBins(64, limit)
    for _ in range(3000):
        length = rng.randint(1, 64)
        assert bins.place(length) == plain.place(length)
        assert bins.count <= limit and sum(map(len, bins.by_free.values())) == bins.count


@pytest.mark.parametrize("length", [1, 2047, 2048, 2049, 4096, 5000])
def test_cut(length):
    pieces = packing.cut(length, 2048)
    assert sum(n for _, n in pieces) == length and all(n == 2048 for _, n in pieces[1:])
    assert [s for s, _ in pieces] == list(np.cumsum([0] + [n for _, n in pieces[:-1]]))


def check(rows, texts, reference, size=2048):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in enumerate(texts):
        pieces = sorted(by_doc.pop(i), key=lambda r: r.piece)
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in pieces]).tolist()
        assert ids == (reference(t) if t else []) + [0]
        assert [r.piece for r in pieces] == list(range(len(pieces))) and all(r.length * 4 == len(r.ids) for r in pieces)
        assert len(ids) > size or len(pieces) == 1
    assert not by_doc
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
    return by_sequence


def test_pack_documents(spark, reference):
    rng = random.Random(1)
    texts = [t for t in ODD_TEXTS if t is None or len(t) < 100_000] + [" ".join(rng.choice(("alpha", "beta", "one")) for _ in range(rng.randint(1, 900))) for _ in range(200)]
    docs = clashing(documents(spark, texts))
    pieces = packing.pack_documents(docs, VOCABULARY)
    rows = pieces.collect()
    made = check(rows, texts, reference)
    assert rows == pieces.collect()  # the same again
    least = -(-sum(r.length for r in rows) // 2048)
    assert len(made) <= 1.1 * least + 8 * spark.sparkContext.defaultParallelism
    joined = {r.sequence_id: r.ids for r in packing.sequences(pieces).collect()}
    for key, spans in made.items():
        assert len(joined[key]) == 4 * sum(n for _, n in spans)


def test_very_long_text(spark, reference):
    texts = ["word " * 30_000, "x" * 50_000]
    check(packing.pack_documents(documents(spark, texts), VOCABULARY).collect(), texts, reference)


def test_empty_table(spark):
    assert packing.pack_documents(documents(spark, []), VOCABULARY).count() == 0
