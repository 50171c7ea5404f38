"""Quality rules against a plain count of the same measures."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import ODD_TEXTS, clashing, documents

from tallyfold.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    seen = {}
    for x in windows:
        seen[x] = seen.get(x, 0) + 1
    covered = {j for i, x in enumerate(windows) if seen[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


def judged(spark, texts):
    rows = rules.judge(clashing(documents(spark, texts))).collect()
    return {r.doc_id: r for r in rows}


def test_measures(spark):
    good = "The house of the sea and the wind is in it. " * 2 + " ".join(f"word{i}" for i in range(60))
    texts = [*ODD_TEXTS, good, "a b c a b c a b c", "x y z\nx y z\n\n \nx y z", "a b cd a b c a b cd", "a b c\x01 a b c a b c 1 a b c", "🙂 é # * <b> | $5"]
    got = judged(spark, texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(t), t and t[:40]
        assert not (r.base_failed and r.kept)
    assert got[len(ODD_TEXTS)].kept


@settings(max_examples=15, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(["a", "b", "ab", "c", "\n", "#", "é"]), max_size=40).map(" ".join), min_size=1, max_size=30))
def test_measures_of_random_texts(spark, texts):
    got = judged(spark, texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(t)


@pytest.mark.parametrize("name,text", [("symbols", "the # of $ * "), ("stop_words", "zzz qqq www "), ("duplicate_lines", None)])
def test_each_rule_rejects(spark, name, text):
    body = " ".join(f"{text}{i}" for i in range(60)) if text else "the same line here\n" * 40 + "\n".join(f"the line {i} of {i * 7}" for i in range(4)) * 4
    r = judged(spark, [body])[0]
    rule = next(x for x in rules.RULES if x.name == name)
    share = 100 * getattr(r, rule.count) / getattr(r, rule.of)
    assert (rule.low is not None and share < rule.low) or (rule.high is not None and share > rule.high)
    assert not r.kept


def test_no_user_functions(spark, capsys):
    rules.judge(documents(spark, ["x"])).explain()
    assert "Python" not in capsys.readouterr().out


def test_empty_table(spark):
    assert rules.judge(documents(spark, [])).count() == 0
