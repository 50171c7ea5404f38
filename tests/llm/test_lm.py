"""Language-model scoring: gradients, normalisation, windows, base scores."""

import math
import pickle
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import ODD_TEXTS, clashing, documents

from tallyfold.llm import lm, tokens
from tallyfold.llm.common import words_of

VOCABULARY = tokens.vocabulary_path()


@pytest.fixture(scope="module")
def words():
    counts = np.zeros(lm.IDS)
    counts[:3000] = np.arange(3000, 0, -1)
    return lm.Vocabulary(counts, 50_256)


def plain_log(model, words, numbers, at, target_id):
    """log10 p of one id at one scored place of a window, from the model's plain pass."""
    h = model.hidden(numbers[None])[0, at].astype(np.float64)
    z = h @ model.p["cls"] + model.p["cls_b"]
    number = int(words.number[target_id])
    c = min(number // lm.MEMBERS, lm.CLASSES)
    out = z[c] - np.logaddexp.reduce(z)
    if c < lm.CLASSES:
        z = h @ model.p["mem"][c] + model.p["mem_b"][c]
        return (out + z[number % lm.MEMBERS] - np.logaddexp.reduce(z)) / math.log(10)
    return out / math.log(10) + float(words.tail[target_id])


def test_gradients():
    m = lm.Attention()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    rng = np.random.default_rng(0)
    numbers, targets = rng.integers(0, lm.HEAD + 2, (2, lm.WINDOW)), rng.integers(-1, lm.HEAD + 1, (2, lm.STRIDE))

    def loss():
        h = m.hidden(numbers).reshape(-1, lm.WIDTH)
        total, n = 0.0, 0
        for a, b in zip(h, targets.reshape(-1)):
            if b >= 0:
                n += 1
                c = min(b // lm.MEMBERS, lm.CLASSES)
                z = a @ m.p["cls"] + m.p["cls_b"]
                total -= z[c] - np.logaddexp.reduce(z)
                if c < lm.CLASSES:
                    z = a @ m.p["mem"][c] + m.p["mem_b"][c]
                    total -= z[b % lm.MEMBERS] - np.logaddexp.reduce(z)
        return total / n
    g = m.gradients(numbers, targets)
    for k, w in m.p.items():
        for _ in range(3):
            i = tuple(rng.integers(0, s) for s in w.shape)
            i = (numbers[0, 3], i[1]) if k == "embed" else i
            old, step = w[i], 1e-5
            w[i] = old + step
            up = loss()
            w[i] = old - step
            down = loss()
            w[i] = old
            assert g[k][i] == pytest.approx((up - down) / 2 / step, abs=1e-7)


def test_distribution_sums_to_one_and_is_causal(words):
    m = lm.Attention(seed=2)
    rng = np.random.default_rng(1)
    numbers = rng.integers(0, lm.HEAD + 1, (1, lm.WINDOW)).astype(np.int32)
    mark = np.zeros((1, lm.STRIDE), bool)
    mark[0, 9] = True
    logs = np.concatenate([m.log10_scores(np.repeat(numbers, len(part), axis=0), np.repeat(mark, len(part), axis=0).ravel(),
                                          words.number[part], part, words) for part in np.array_split(np.arange(lm.IDS), 64)])
    assert (10.0 ** logs.astype(np.float64)).sum() == pytest.approx(1, abs=1e-3)
    later = numbers.copy()
    later[0, lm.CONTEXT + 10:] = 5
    np.testing.assert_allclose(m.hidden(numbers)[0, :10], m.hidden(later)[0, :10], atol=1e-6)
    np.testing.assert_allclose(m.hidden(numbers).reshape(-1, lm.WIDTH), m.last_layer(numbers), atol=1e-5)


@pytest.mark.parametrize("lengths", [[0], [23], [24], [47, 48, 0, 200], [5, 1000, 31]])
def test_every_place_is_scored_once(words, lengths):
    rng = np.random.default_rng(8)
    texts = [rng.integers(0, 5000, n).astype(np.uint32) for n in lengths]
    inputs, place, text, ids = lm.windows(texts, words)
    assert sorted(place[place >= 0].tolist()) == list(range(sum(lengths) + len(lengths)))
    assert ids.tolist() == [x for t in texts for x in (*t.tolist(), words.end)]
    starts = np.cumsum([0] + [n + 1 for n in lengths])
    for window, places, t in zip(inputs, place, text):
        full = [lm.START] * lm.CONTEXT + [lm.START] + words.number[texts[t]].tolist()  # the input of each place, context before it
        first = int(places[0] - starts[t])
        n = min(lm.WINDOW, len(full) - first)
        assert window[:n].tolist() == full[first:first + n]
        held = places[places >= 0]
        assert (np.diff(held) == 1).all() and held[-1] < starts[t + 1]


def test_scorer_matches_plain_windows(words):
    m = lm.Attention(seed=4)
    rng = np.random.default_rng(6)
    texts = [rng.integers(0, 5000, n).astype(np.uint32) for n in (0, 3, 23, 24, 80)]
    got = lm.Scorer(m, words)(texts, at_once=2)
    for t, score in zip(texts, got):
        ids = [*t.tolist(), words.end]
        inputs = [lm.START] * (lm.CONTEXT + 1) + words.number[t].tolist()
        total = 0.0
        for at, target in enumerate(ids):
            first = at // lm.STRIDE * lm.STRIDE
            window = np.array((inputs[first:first + lm.WINDOW] + [0] * lm.WINDOW)[:lm.WINDOW], np.int32)
            total += plain_log(m, words, window, at - first, target)
        assert score == pytest.approx(total, abs=1e-2)


def test_base_scores_and_learning(spark):
    texts = [t for t in ODD_TEXTS if t is None or len(t) < 1000] + [f"the house of stone {i % 7} and the River ran by the house" for i in range(60)]
    docs = clashing(documents(spark, texts))
    rows = {r.doc_id: r for r in lm.score_documents(docs, VOCABULARY).collect()}
    counts = Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update((t or "").encode().lower().split())
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        w = [*(t or "").encode().lower().split(), None]
        r = rows[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
        assert r.score < 0


def test_model_learns(spark):
    """Held-out texts are likelier under the trained model than under id frequencies alone."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) <= 20000").select("doc_id", "text").orderBy("doc_id").collect()
    encode = tokens.load_encoder(VOCABULARY)
    split = [(zlib.crc32(str(r.doc_id).encode()) % 7 == 2, lm.subwords(encode, lm.words_of(r.text.encode()))) for r in docs]
    train, held = [t for h, t in split if not h], [t for h, t in split if h][:60]
    counts = np.zeros(lm.IDS)
    for t in train:
        counts += np.bincount(t, minlength=lm.IDS)
    counts[50_256] = len(train)
    own = lm.Vocabulary(counts, 50_256)
    model = lm.Attention().train(*lm.training_windows(train[:480], own))
    n = sum(len(t) + 1 for t in held)
    plain = sum(np.log10((counts[[*t, 50_256]] + 1) / (counts.sum() + lm.IDS)).sum() for t in held) / n
    assert lm.Scorer(model, own)(held).sum() / n > plain + 0.1


def test_rare_words_join(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 4)
    test_base_scores_and_learning(spark)


def test_odd_tables(spark):
    assert lm.score_documents(documents(spark, []), VOCABULARY).count() == 0
    rows = lm.score_documents(documents(spark, [(None, "alone"), (None, None), (7, "alone"), (7, "alone")]), VOCABULARY).collect()
    assert sorted(r.n_tokens for r in rows) == [1, 2, 2, 2]


def test_learns_from_every_window(spark):
    """Texts beyond a first sample and texts of any length are learned from."""
    texts = [f"the house of stone {i} and the river" for i in range(40)] + [None, "", "word and word " * 5000]
    encode = tokens.load_encoder(VOCABULARY)
    ids = [lm.subwords(encode, lm.words_of((t or "").encode())) for t in texts]
    counts = np.bincount(np.concatenate(ids).astype(int), minlength=lm.IDS).astype(float)
    counts[50_256] = len(texts)
    own = lm.Vocabulary(counts, 50_256)
    docs = spark.createDataFrame([(k, x.astype(lm.STORED).tobytes()) for k, x in enumerate(ids)], "doc_id bigint, ids binary").repartition(3)
    made = [lm.Attention() for _ in range(2)]
    before = lm.Scorer(lm.Attention(), own)(ids)
    assert [lm.train_on_all(m, docs, own) for m in made] == [sum(len(i) + 1 for i in ids)] * 2
    assert all((made[0].p[k] == made[1].p[k]).all() for k in made[0].p)
    assert (lm.Scorer(made[0], own)(ids)[[0, -1]] > before[[0, -1]]).all()


@pytest.mark.parametrize("share", [1, 2, 3, 5])
def test_share_of_the_windows_of_every_text(words, share):
    laid = lm.Laid([np.arange(n, dtype=lm.STORED) for n in (0, 5, 23, 24, 47, 48, 200, 3000)], words)
    seen = [laid.shared(share, np.full(8, mark)) for mark in range(lm.STRIDE * share)]
    for picked in seen:
        got = np.bincount(laid.text[picked], minlength=8)
        assert (got >= 1).all() and (got >= laid.counts // share).all() and (got <= -(-laid.counts // share)).all()
    assert sorted(set(np.concatenate(seen).tolist())) == list(range(len(laid.text)))  # no place of a text is left out for all marks


def test_ids_of_words_are_those_of_texts():
    encode = tokens.load_encoder(VOCABULARY)
    rng = random.Random(3)
    texts = [lm.words_of("".join(rng.choices("aB's1.,-<é漢\u3000\xa0\x85\x1c \n ", k=rng.randint(0, 60))).encode()) for _ in range(3000)]
    texts += [lm.words_of(t.encode()) for t in ("a<|endoftext|>b <|endoftext|> c", "it's don't 's '", "x" * 5000)]
    memory = lm.Memory(encode, {b"a": 0.5})
    ids, logs = lm.encoded(memory, texts)
    for t, x, log in zip(texts, ids, logs):
        assert x.tolist() == lm.subwords(encode, t).tolist()
        assert (~np.isnan(log)).tolist() == [w == b"a" for w in t]


def test_score_uses_texts_outside_the_sample(spark, monkeypatch):
    """A passage of long texts that the first sample (one text) leaves out makes the same held-out passage likelier."""
    odd = "seven copper kettles sang under quiet willow bridges " * 3
    held = next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 7 == 2)
    plain = [(i, f"the house of stone {i % 7} and the river ran by the house") for i in range(60)]
    long = [(i, odd * 300) for i in range(100, 120) if zlib.crc32(str(i).encode()) % 7 != 2]
    docs = documents(spark, [*plain, *long, (held, odd)])

    def score():
        return {r.doc_id: r.score for r in lm.score_documents(docs, VOCABULARY, sample_rows=1).collect()}[held]

    learned = score()
    monkeypatch.setattr(lm, "train_on_all", lambda *given, **more: 0)
    assert learned > score() + 5


def plain_layer(p, numbers):
    """The last layer of one window, place by place in double precision."""
    p = {k: v.astype(np.float64) for k, v in p.items()}
    x = p["embed"][numbers] + p["place"]
    out = []
    for at in range(lm.CONTEXT, lm.WINDOW):
        kv = x[:at + 1] @ p["kv"]
        z = kv[:, :lm.WIDTH] @ (x[at] @ p["q"]) / math.sqrt(lm.WIDTH)
        a = np.exp(z - z.max())
        h = x[at] + a / a.sum() @ kv[:, lm.WIDTH:] @ p["out"]
        out.append(h + np.maximum(h @ p["up"] + p["up_b"], 0) @ p["down"])
    return np.array(out)


@pytest.mark.parametrize("factor", [1, 30, -2000])
def test_layer_is_that_of_single_places(factor):
    """Attention scores from small ones to such as overflow or vanish in float32."""
    m, rng = lm.Attention(seed=5), np.random.default_rng(3)
    m.p["q"] *= np.float32(factor)
    numbers = rng.integers(0, lm.HEAD + 2, (5, lm.WINDOW)).astype(np.int32)
    for got, window in zip(m.hidden(numbers), numbers):
        np.testing.assert_allclose(got, plain_layer(m.p, window), atol=1e-4 * max(1, abs(factor) ** 0.5))


def test_gradients_add_up_over_blocks(monkeypatch):
    """Also where a block has no scored place, or rare ids alone."""
    m, rng = lm.Attention(seed=6), np.random.default_rng(4)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    numbers, targets = rng.integers(0, lm.HEAD + 2, (11, lm.WINDOW)), rng.integers(-1, lm.HEAD + 1, (11, lm.STRIDE))
    targets[3:6], targets[6:9] = -1, lm.HEAD
    whole = m.gradients(numbers, targets)
    monkeypatch.setattr(lm, "BLOCK", 3)
    monkeypatch.setattr(lm, "ROWS", 17)
    parts = m.gradients(numbers, targets)
    for k, g in whole.items():
        np.testing.assert_allclose(parts[k], g, atol=1e-12)


def test_new_words_are_made_into_ids_together():
    """One call for all words of a part of the texts."""
    encode, calls = tokens.load_encoder(VOCABULARY), []

    def counted(text):
        calls.append(text)
        return encode(text)
    counted.sizes = encode.sizes
    texts = [[f"{w}{i % 500}".encode() for i in range(1000)] for w in ("stone", "caf\u00e9", "<|endoftext|>x", "it's")]
    memory = lm.Memory(counted, {})
    ids, _ = lm.encoded(memory, texts)
    assert [x.tolist() for x in ids] == [lm.subwords(encode, t).tolist() for t in texts]
    assert len(calls) == 1


def test_words_are_split_alike(monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choices("aB\u00c9\u6f22\u3000\xa0\x85\x1c\x00 \t\n\x0b\x0c\r", k=rng.randint(0, 40))).encode() for _ in range(2000)] + [None, b"", b" "]
    array = pa.array([b"cut off", *texts], pa.binary()).slice(1)
    for size in (1 << 24, 50):
        monkeypatch.setattr(lm, "BYTES", size)
        got = [(at + i, w) for at, part in lm.text_slices(array) for w, i in zip(*flat(part))]
        assert got == [(i, w) for i, t in enumerate(texts) for w in words_of(t)]
    assert list(lm.pieces(np.array([3, 9, 1, 1, 0, 5, 2]), 5)) == [(0, 1), (1, 2), (2, 5), (5, 6), (6, 7)]
    assert list(lm.pieces(np.zeros(0, int), 5)) == []


def flat(part):
    words, counts = lm.split_words(part)
    return words.to_pylist(), np.repeat(np.arange(len(counts)), counts).tolist()


def test_few_words_at_a_time_give_the_same_rows(spark, monkeypatch):
    texts = [t for t in ODD_TEXTS if t is None or len(t) < 200_000] + [f"Stone {i} House {i % 3} stone" for i in range(50)]
    frame = documents(spark, texts).selectExpr("doc_id", "doc_id % 2 = 0 held_out", "text").coalesce(1)

    def rows():
        out = lm.encode_documents(frame, VOCABULARY, {b"stone": 0.5, b"a": 0.25}).collect()
        return sorted((r.doc_id, r.held_out, r.n_tokens, r.known, r.base, sorted(zip(map(bytes, r.rare), r.times)), bytes(r.ids)) for r in out)
    whole, encode = rows(), tokens.load_encoder(VOCABULARY)
    for (i, held, n, known, base, rare, ids), t in zip(whole, texts, strict=True):
        w = words_of((t or "").encode())
        assert ids == lm.subwords(encode, w).astype(lm.STORED).tobytes()
        c = Counter(x for x in w if x not in (b"stone", b"a"))
        assert (held, n, known, rare) == (i % 2 == 0, len(w) + 1, len(w) - c.total(), sorted(c.items()))
        assert base == pytest.approx(0.5 * w.count(b"stone") + 0.25 * w.count(b"a"))
    monkeypatch.setattr(lm, "AT_A_TIME", 3)
    assert rows() == whole


def test_sizes_of_ids():
    encode = tokens.load_encoder(VOCABULARY)
    for text in ("a<|endoftext|>b", "it's caf\u00e9 \u6f22\u5b57 \U0001f600", " " * 30_000 + "x", ""):
        assert encode.sizes[encode(text)].sum() == len(text.encode())


def test_work_arrays_are_not_sent():
    m = lm.Attention()
    m.hidden(np.zeros((64, lm.WINDOW), np.int32))
    assert m.room and not pickle.loads(pickle.dumps(lm.Scorer(m, None))).model.room
