"""Harmonic packing: classes, fixed counts, whole documents, little padding."""

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import ODD_TEXTS, clashing, documents

from tallyfold.llm import harmonic, tokens
from tallyfold.llm.queries import QUERIES

VOCABULARY = tokens.vocabulary_path()


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def packed(lengths, size, whole):
    """(sequences closed while rows come, sequences made of the rest)."""
    classes = harmonic.HarmonicClasses(size, whole)
    closed = [s for i, n in enumerate(lengths) for s in classes.add(i, n)]
    assert all(len(pieces) < j for j, pieces in classes.open.items())
    return closed, list(classes.rest())


def covers(sequences, lengths):
    spans = defaultdict(list)
    for pieces in sequences:
        for key, start, length in pieces:
            assert length > 0
            spans[key].append((start, length))
    for i, n in enumerate(lengths):
        at = 0
        for start, length in sorted(spans.pop(i, [])):
            assert start == at
            at += length
        assert at == n
    assert not spans


@settings(max_examples=300, deadline=None)
@given(lengths=st.lists(st.integers(1, 400), max_size=80), size=st.sampled_from([1, 7, 64, 100]), whole=st.integers(0, 70))
def test_every_token_lies_in_one_piece(lengths, size, whole):
    closed, rest = packed(lengths, size, whole)
    covers(closed + rest, lengths)
    assert all(sum(n for *_, n in s) <= size for s in closed + rest)


def test_a_class_holds_a_fixed_count_of_pieces_that_fit_its_places():
    rng = random.Random(3)
    size, whole = 2048, 64
    closed, rest = packed([rng.randint(1, 5000) for _ in range(4000)], size, whole)
    for pieces in closed:
        j = len(pieces)
        assert all(length <= -(-size // j) for *_, length in pieces)
        # places of cut rests are filled to the last token
        if j <= size // whole and all(length > whole for *_, length in pieces):
            assert sum(length for *_, length in pieces) == size
        # an uncut rest wastes less than one part in j + 1 of the sequence
        assert all(length * (j + 1) > size for *_, length in pieces if length <= whole)
    lengths = [sum(n for *_, n in s) for s in rest]
    short = [n for n in lengths if n < size]
    assert all(n & (n - 1) == 0 for n in lengths) and len(short) == len(set(short))


@pytest.mark.parametrize("length", [1, 63, 64, 65, 1024, 1025, 2047, 2048, 2049, 40_000])
def test_class_of_every_length(length):
    classes = harmonic.HarmonicClasses(2048, 64)
    rest = length % 2048
    if rest:
        j = classes.class_of(rest)
        places = {classes.place(j, i) for i in range(j)}
        assert max(places) - min(places) <= 1 and sum(classes.place(j, i) for i in range(j)) == 2048
        # the largest place that a cut rest fills; the smallest that holds an uncut one
        assert max(places) <= rest < 2048 / (j - 1) if rest > 64 else 2048 / (j + 1) < rest <= min(places)


def check(rows, texts, reference, size=2048):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(texts):
        pieces = sorted(by_doc.pop(i), key=lambda r: r.start)
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in pieces]).tolist()
        assert ids == (reference(t) if t else []) + [1]
        assert [r.start for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1]]
        assert {r.doc_tokens for r in pieces} == {len(ids)}
    assert not by_doc
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size


def test_pack_harmonic(spark, reference):
    rng = random.Random(1)
    texts = ODD_TEXTS + ["<|endoftext|> a"] + [" ".join(rng.choice(("alpha", "beta", "one")) for _ in range(rng.randint(1, 3000)))
                                               for _ in range(300)]
    pieces = harmonic.pack_harmonic(clashing(documents(spark, texts)), VOCABULARY)
    rows = pieces.collect()
    check(rows, texts, reference)
    assert rows == pieces.collect()  # the same again
    total = harmonic.padding(pieces).first()
    assert total.tokens == sum(r.length for r in rows) and total.padding <= 0.01 * total.tokens


def test_null_ids_and_empty_table(spark):
    assert harmonic.pack_harmonic(documents(spark, []), VOCABULARY).count() == 0
    rows = harmonic.pack_harmonic(documents(spark, [(None, "a"), (None, None), (7, "a"), (7, "a")]), VOCABULARY).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.doc_tokens) for r in rows) == [(-1, 1), (-1, 2), (7, 2), (7, 2)]
    assert harmonic.padding(documents(spark, []).selectExpr("doc_id AS sequence_id", "doc_id AS length")).first().padding == 0


def test_query_over_its_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = QUERIES["op11_harmonic"](spark, sf_dir)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    total = harmonic.padding(rows).first()
    assert total.padding <= 0.01 * total.tokens
    assert rows.select("doc_id").distinct().count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
