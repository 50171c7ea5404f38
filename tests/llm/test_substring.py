"""Substring dedup: cutting, runs and removal against a plain version."""

import random
import re
import time

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import ODD_TEXTS, clashing, documents

from tallyfold.llm import substring


def sentence(tag, n=8):
    return " ".join(f"{tag}{i}" for i in range(n)) + ". "


PASSAGE = "".join(sentence(t) for t in ("pa", "pb", "pc", "pd", "pe", "pf", "pg"))


def plain_cut(text):
    """[(first, end, words)] of a text's sentences, one at a time: the ends
    by the plain pattern, then any GAP words in a row by their lowest rank."""
    words = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"\S+", text)]
    ends = {m.end() for m in re.finditer(r"[.!?]+[\"')\]]*\s+|\n\s*", text)}
    starts = [i for i, w in enumerate(words) if i == 0 or w[0] in ends]
    begins = set(starts)

    def number(word):
        return int.from_bytes(xxhash.xxh3_128_digest(word)[:8], "little")

    def rank(i, first):
        x = (number(words[i][2]) + (number(words[i - 1][2]) if i > first else 0) * 0x9E3779B97F4A7C15) % 2**64
        x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 % 2**64
        return ((x ^ (x >> 32)) >> 1) + (0 if text[words[i][1] - 1] in ",;:" else 1 << 63)

    for first, end in zip(starts, [*starts[1:], len(words)]):
        for i in range(first, end - substring.GAP):
            begins.add(min(range(i, i + substring.GAP), key=lambda j: (rank(j, first), -j)) + 1)
    begins = sorted(begins)
    out = []
    for first, end in zip(begins, [*begins[1:], len(words)]):
        out.append((words[first][0] if first else 0, words[end][0] if end < len(words) else len(text), [w for _, _, w in words[first:end]]))
    return out


def plain_removal(docs, sentences=3, least_words=12):
    """{(doc_id, text): left text} by comparing all runs of words."""
    seen, left = {}, {}
    for doc_id, text in sorted(set(docs), key=lambda d: (d[0] is None, d[0] or 0)):
        cut = plain_cut(text) if text else []
        runs = []
        for first in range(len(cut)):
            end = first
            while end < len(cut) and (end - first < sentences or sum(len(w) for _, _, w in cut[first:end]) < least_words):
                end += 1
            if end - first >= sentences and sum(len(w) for _, _, w in cut[first:end]) >= least_words:
                runs.append((first, end))
        gone = set()
        for first, end in runs or ([(0, len(cut))] if cut else []):
            words = tuple(w for _, _, ws in cut[first:end] for w in ws)
            if seen.setdefault(words, (doc_id, text, first)) != (doc_id, text, first):
                gone |= set(range(first, end))
        left[doc_id, text] = None if text is None else text if not gone else "".join(text[a:b] for i, (a, b, _) in enumerate(cut) if i not in gone)
    return left


def cut_of(texts):
    """The sentences of each text, by the operator."""
    cut = substring.Cut(texts)
    a, b = cut.spans(np.arange(len(cut.text)), np.arange(len(cut.text)) + 1)
    out = [[] for _ in texts]
    for t, first, end in zip(cut.text.tolist(), a.tolist(), b.tolist()):
        out[t].append((first, end))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab .,;!?\n\t\")\u00e9\u0130\u3000", max_size=80), min_size=1, max_size=4))
def test_sentences_are_those_of_the_plain_cut(texts):
    got = cut_of(texts)
    assert got == [[(a, b) for a, b, _ in plain_cut(t)] if t.split() else [] for t in texts]
    for text, spans in zip(texts, got):
        assert "".join(text[a:b] for a, b in spans) == (text if spans else "")


@pytest.mark.parametrize("text", ["." * 1_000_000, "!\"" * 500_000, ".)" * 500_000, ". " * 200_000, "\n" * 1_000_000, " " * 2_000_000,
                                  "a" + "." * 999_999 + "b", "\n \t" * 300_000, "x" * 2_000_000])
def test_long_runs_of_marks_take_linear_time(text):
    before = time.perf_counter()
    substring.Cut([text, text]).runs(3, 12)
    assert time.perf_counter() - before < 5


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.!?\"')] \n", max_size=40))
def test_sentence_ends_are_those_of_the_plain_pattern(text):
    plain = re.compile(r"[.!?]+[\"')\]]*\s+|\n\s*")
    assert [m.span()[1] for m in substring._END.finditer(text)] == [m.span()[1] for m in plain.finditer(text)]


def test_passage_inside_a_sentence_is_removed(spark):
    texts = [sentence("a") + PASSAGE + sentence("b"), "quite another start " + PASSAGE + sentence("c"), sentence("d") + sentence("e") + sentence("f")]
    got = {r.doc_id: r for r in substring.remove_repeats(clashing(documents(spark, texts))).collect()}
    assert got[0].text == texts[0] and got[0].n_removed == 0
    assert got[2].text == texts[2]
    assert "pb0" not in got[1].text and "pg0" not in got[1].text and "c7" in got[1].text and got[1].n_removed >= 6


ODD = [t for t in ODD_TEXTS if t is None or len(t) < 100_000 or not t.strip("word ")]  # the plain version is slow on the others


@pytest.mark.parametrize("at_once,buffer,tasks", [(1_000_000, 1_000_000, 1), (40, 10, 3), (1, 1, 7)])
def test_matches_plain_version(spark, monkeypatch, at_once, buffer, tasks):
    """One buffer or many: what is joined in a task and what is not gives the same."""
    monkeypatch.setattr(substring, "AT_ONCE", at_once)
    monkeypatch.setattr(substring, "BUFFER", buffer)
    docs = [(i, t) for i, t in enumerate([
        PASSAGE, PASSAGE, sentence("x") + PASSAGE, PASSAGE + PASSAGE, sentence("q"), sentence("q"),
        "".join(sentence("r", 2) for _ in range(40)), "short one", " short  one", "again " * 300, "again " * 90 + "and", *(t and t[:3000] for t in ODD)])]
    docs += [(None, PASSAGE), (1, PASSAGE), (3, sentence("z") + PASSAGE)]
    table = documents(spark, docs).repartition(tasks)
    got = sorted((str(r.doc_id), str(r.text)) for r in substring.remove_repeats(table).collect())
    left = plain_removal(docs)
    assert got == sorted((str(i), str(left[i, t])) for i, t in docs)


def test_odd_texts_end(spark):
    docs = clashing(documents(spark, [*ODD_TEXTS, *ODD_TEXTS]))
    rows = {r.doc_id: r for r in substring.remove_repeats(docs).collect()}
    for i, text in enumerate(ODD_TEXTS):
        copy = rows[i + len(ODD_TEXTS)].text
        assert copy == text if not text or not text.split() else copy == ""


def test_repeats_inside_one_text(spark):
    text = PASSAGE + sentence("m") + PASSAGE
    row = substring.remove_repeats(documents(spark, [text])).first()
    assert row.text == PASSAGE + sentence("m")


@pytest.mark.parametrize("texts", [[], [None], [""]])
def test_nothing_to_do(spark, texts):
    rows = substring.remove_repeats(documents(spark, texts)).collect()
    assert [(r.n_sentences, r.n_removed, r.text) for r in rows] == [(0, 0, t) for t in texts]


def windows_of(text, n=50):
    w = text.lower().split()
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def test_no_50_words_of_an_earlier_text_stay(spark):
    """Passages of 50 words, with few or no marks, placed anywhere inside sentences of any length."""
    rng = random.Random(5)

    def fresh(n):
        return [f"{''.join(rng.choices('abcdefgh', k=5))}{rng.choice(['', '', '', '', '', '', ',', '.'] if n % 2 else [''])}" for _ in range(n)]

    passages = [fresh(n) for n in (50, 51, 60, 75, 101) * 8] + [["again"] * 70]
    texts = [" ".join(fresh(rng.randint(0, 30)) + p + fresh(rng.randint(0, 30))) for _ in range(3) for p in passages]
    left = {r.doc_id: r.text for r in substring.remove_repeats(documents(spark, texts)).collect()}
    seen = set()
    for i, text in enumerate(texts):
        assert i >= len(passages) or i == len(passages) - 1 or left[i] == text
        assert not windows_of(left[i]) & seen, i
        seen |= windows_of(text)


def test_copies_of_short_texts_are_removed(spark):
    texts = ["One sentence of more than a dozen words that stands alone in its text", "Two sentences make this short text here. The other one ends it."]
    rows = substring.remove_repeats(documents(spark, texts + texts)).collect()
    assert {r.doc_id: r.text for r in rows} == {0: texts[0], 1: texts[1], 2: "", 3: ""}
