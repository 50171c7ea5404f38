"""Language-model scoring: a causal self-attention model over subword ids.

Base: add-one smoothed word counts over all training documents. Model: one
layer of causal self-attention with a feed-forward layer, trained here in
numpy on subword ids of a public vocabulary. A text is cut into windows
that overlap by `CONTEXT` places; the last `STRIDE` places of a window are
scored, with the earlier ones of the window as context, so every token is
scored once. A text begins with `CONTEXT` start marks. Windows are scored
in batches under one causal mask.

The output is a proper distribution over all ids in two steps: a class,
then a member of the class. The `HEAD` most frequent ids fill the learned
classes; all other ids form one more class and follow their counts there.

Scale: word counts come from all training documents, combined per batch,
per task and then by word. Words that make up at least 2^-18 of all tokens
(at most 2^18 of them, by arithmetic) are broadcast; occurrences of the
rarer ones meet their counts in one join. Every text is made into ids once (each
distinct word of some 8 MB of text once, as ids of a word do not depend on its
neighbours); the ids are stored, two bytes each, and counting them (at most
one row per id), learning and scoring read them from there. The model learns from every training text, of any
length, as Spark work (`train_on_all`): from all of its windows, or, where
`share` is set above 1, from one in `share` and one at least. A driver pass over `sample_rows` slices of at most
`SLICE` ids at hashed places of these texts only gives the parameters that
the tasks start from. Windows are built for one step or batch at a time,
whatever the length of a text.

Defined cases: a null or empty text is its end token alone; repeated rows
are scored (and learned from) one by one; a null doc_id counts as the empty
text for its fold; without training documents the base score is 0 and the
model stays as initialised; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import hashed_sample, sql_type, stored, utf8, words_of  # noqa: F401 (words_of: what split_words is held to)
from tallyfold.llm.tokens import load_encoder

WINDOW, STRIDE, WIDTH, INNER = 32, 24, 16, 32
CONTEXT = WINDOW - STRIDE
CLASSES, MEMBERS = 31, 32
HEAD = CLASSES * MEMBERS
START = HEAD + 1  # input number of the start of a text; HEAD stands for all rarer ids
FREQUENT = 1 << 18
IDS = 50_257
ROUNDS, AT_ONCE, FAN = 4, 512, 64  # of `train_on_all`: averagings, windows a step, rows added up by one task
SLICE, BYTES, AT_A_TIME = 768, 1 << 23, 1 << 18  # ids of a starting slice, bytes of text whose words are told apart together, words looked up together
BLOCK, ROWS = 128, 1536  # windows whose arrays are made together (they fit the processor's cache); rows of a product that need no packing
STORED = np.dtype("<u2")

# white space that does not end a word: ids of such words depend on their neighbours
_INNER_SPACE = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


class Vocabulary:
    """Ids by frequency. `end` is the id of the end token; it is always in the head."""

    def __init__(self, counts: np.ndarray, end: int):
        order = np.argsort(-counts, kind="stable")
        head = order[:HEAD]
        if end not in head:
            head[-1] = end
        self.number = np.full(len(counts), HEAD, np.int32)  # 0..HEAD-1, or HEAD
        self.number[head] = np.arange(HEAD)
        rare = self.number == HEAD
        spread = np.where(rare, counts + 1.0, 0.0)
        self.tail = np.log10(np.maximum(spread / spread.sum(), 1e-300)).astype(np.float32)
        self.tail[~rare] = 0.0
        self.end = end


class Room(dict):
    """Work arrays by name, used again from step to step."""

    def __call__(self, name: str, kind: np.dtype, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self or self[name].size < size or self[name].dtype != kind:
            self[name] = np.empty(size, kind)
        return self[name][:size].reshape(shape)


def _times(rows: np.ndarray, matrix: np.ndarray, out: np.ndarray) -> np.ndarray:
    """rows @ matrix, `ROWS` at a time."""
    for i in range(0, len(rows), ROWS):
        np.matmul(rows[i:i + ROWS], matrix, out=out[i:i + ROWS])
    return out


def _gram(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b, `ROWS` at a time."""
    total = a[:ROWS].T @ b[:ROWS]
    for i in range(ROWS, len(a), ROWS):
        total += a[i:i + ROWS].T @ b[i:i + ROWS]
    return total


def _turned(matrix: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(matrix.T)


def _exp(make: Callable[[], np.ndarray], seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """e to the rows that `make` gives, in place (0 where `seen` is 0), and their sums.
    Rows are made again, less their maximum, only where float32 overflows or vanishes."""
    z = make()
    ones = np.ones(z.shape[-1], z.dtype)
    with np.errstate(over="ignore", invalid="ignore"):
        np.exp(z, out=z)
        if seen is not None:
            z *= seen
        total = z.reshape(-1, z.shape[-1]) @ ones
        if not (total.min(initial=1) > 1e-25 and total.max(initial=1) < 1e30):
            z = make()
            if seen is not None:
                z[..., seen == 0] = -np.inf
            z -= z.max(axis=-1, keepdims=True)
            np.exp(z, out=z)
            total = z.reshape(-1, z.shape[-1]) @ ones
    return z, total


class Attention:
    """The model and its gradients."""

    def __init__(self, seed: int = 17):
        rng = np.random.default_rng(seed)

        def normal(*shape):
            return rng.normal(0, 1 / math.sqrt(shape[-2]), shape).astype(np.float32)

        self.p = {"embed": rng.normal(0, 0.3, (HEAD + 2, WIDTH)).astype(np.float32),
                  "place": np.zeros((WINDOW, WIDTH), np.float32), "q": normal(WIDTH, WIDTH), "kv": normal(WIDTH, 2 * WIDTH), "out": normal(WIDTH, WIDTH),
                  "up": normal(WIDTH, INNER), "up_b": np.zeros(INNER, np.float32), "down": normal(INNER, WIDTH) * np.float32(0.3),
                  "cls": normal(WIDTH, CLASSES + 1), "cls_b": np.zeros(CLASSES + 1, np.float32),
                  "mem": normal(CLASSES, WIDTH, MEMBERS), "mem_b": np.zeros((CLASSES, MEMBERS), np.float32)}
        # scored places (rows) see the places up to their own
        self.seen = np.tril(np.ones((WINDOW, WINDOW), np.float32))[CONTEXT:]
        self.room = Room()

    def __getstate__(self) -> dict:
        return {**self.__dict__, "room": Room()}

    def _with_ones(self, name: str, kind: np.dtype, rows: int) -> np.ndarray:
        """A work array of rows that end in 1, which the last row of a matrix (its bias) meets."""
        out = self.room(name, kind, rows, WIDTH + 1)
        out[:, WIDTH] = 1
        return out

    def _attend(self, numbers: np.ndarray) -> None:
        """Leaves the arrays of the attention layer in `room`: h and what it is made of."""
        p, count, kind = self.p, len(numbers), self.p["q"].dtype
        rows = count * STRIDE
        x = np.take(p["embed"], numbers, axis=0, out=self.room("x", kind, count, WINDOW, WIDTH), mode="clip")
        x += p["place"]
        kv = _times(x.reshape(-1, WIDTH), p["kv"], self.room("kv", kind, count * WINDOW, 2 * WIDTH)).reshape(count, WINDOW, 2 * WIDTH)
        own = self.room("own", kind, rows, WIDTH)
        own.reshape(count, STRIDE, WIDTH)[...] = x[:, CONTEXT:]
        q = _times(own, p["q"] * kind.type(1 / math.sqrt(WIDTH)), self.room("q", kind, rows, WIDTH))
        scores = self.room("a", kind, count, STRIDE, WINDOW)
        a, total = _exp(lambda: np.matmul(q.reshape(count, STRIDE, WIDTH), kv[..., :WIDTH].transpose(0, 2, 1), out=scores), self.seen)
        # the weights are normalised after mixing
        mixed = np.matmul(a, kv[..., WIDTH:], out=self.room("mixed", kind, count, STRIDE, WIDTH)).reshape(-1, WIDTH)
        mixed /= total[:, None]
        h = self._with_ones("h", kind, rows)
        np.add(own, _times(mixed, p["out"], self.room("spare", kind, rows, WIDTH)), out=h[:, :WIDTH])
        u = _times(h, np.vstack([p["up"], p["up_b"]]), self.room("u", kind, rows, INNER))
        np.maximum(u, 0, out=u)
        y = self._with_ones("y", kind, rows)
        np.add(h[:, :WIDTH], _times(u, p["down"], self.room("spare", kind, rows, WIDTH)), out=y[:, :WIDTH])
        self.room["total"] = total

    def last_layer(self, numbers: np.ndarray) -> np.ndarray:
        """The last layer at the scored places of windows (count, WINDOW), as rows."""
        self._attend(numbers)
        return self.room("y", self.p["q"].dtype, len(numbers) * STRIDE, WIDTH + 1)[:, :WIDTH].copy()

    def hidden(self, numbers: np.ndarray) -> np.ndarray:
        """`last_layer` by windows."""
        return self.last_layer(numbers).reshape(len(numbers), STRIDE, WIDTH)

    def _bounds(self, group: np.ndarray) -> list[tuple[int, slice]]:
        """The classes that occur, and where they lie among sorted ones."""
        bounds = np.searchsorted(group, np.arange(CLASSES + 1)).tolist()
        return [(c, slice(*cut)) for c, cut in enumerate(zip(bounds, bounds[1:])) if cut[1] > cut[0]]

    def _members(self) -> np.ndarray:
        """The matrices of the classes, each with its bias as the last row."""
        return np.concatenate([self.p["mem"], self.p["mem_b"][:, None]], axis=1)

    def _log_share(self, z: np.ndarray, picked: np.ndarray) -> np.ndarray:
        """log softmax of the picked column of each row (z is overwritten)."""
        out = z.reshape(-1)[np.arange(len(z)) * z.shape[1] + picked]
        top = max(0.0, float(z.max(initial=0.0)) - 60)  # far from float32 overflow; 0 in practice
        if top:
            z -= top
        np.exp(z, out=z)
        return out - top - np.log(z @ np.ones(z.shape[1], z.dtype))

    def log10_scores(self, numbers: np.ndarray, scored: np.ndarray, targets: np.ndarray, ids: np.ndarray, words: Vocabulary) -> np.ndarray:
        """log10 probability of the targets (numbers; `ids` for the rare ones)
        at those scored places of the windows that hold a token."""
        self._attend(numbers)
        kind = self.p["q"].dtype
        group = np.minimum(targets // MEMBERS, CLASSES)
        order = np.argsort(group.astype(np.int8), kind="stable")
        targets, group = targets[order], group[order]
        h = np.take(self.room("y", kind, len(numbers) * STRIDE, WIDTH + 1), np.flatnonzero(scored)[order], axis=0,
                    out=self.room("picked", kind, len(order), WIDTH + 1), mode="clip")
        z = self.room("z", kind, len(h), CLASSES + 1)
        got = self._log_share(_times(h, np.vstack([self.p["cls"], self.p["cls_b"]]), z), group)
        in_head, members = int(np.count_nonzero(group < CLASSES)), self._members()
        z = self.room("z", kind, in_head, MEMBERS)
        for c, part in self._bounds(group):
            np.matmul(h[part], members[c], out=z[part])
        got[:in_head] += self._log_share(z, targets[:in_head] % MEMBERS)
        out = np.empty_like(got)
        out[order] = got * np.float32(1 / math.log(10))
        return out + words.tail[ids]

    def gradients(self, numbers: np.ndarray, targets: np.ndarray) -> dict:
        """Of the mean negative log-likelihood; targets < 0 are not scored.
        They are added up over `BLOCK` windows at a time, whose arrays stay in the processor's cache."""
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        share = self.p["q"].dtype.type(1 / max(1, np.count_nonzero(targets >= 0)))
        for i in range(0, len(numbers), BLOCK):
            self._add_gradients(numbers[i:i + BLOCK], targets[i:i + BLOCK], share, g)
        return g

    def _add_gradients(self, numbers: np.ndarray, targets: np.ndarray, share: np.float32, g: dict) -> None:
        self._attend(numbers)
        p, room, count, kind = self.p, self.room, len(numbers), self.p["q"].dtype
        rows, scale = count * STRIDE, kind.type(1 / math.sqrt(WIDTH))
        h, y = (room(name, kind, rows, WIDTH + 1) for name in ("h", "y"))
        x, own, q, mixed, spare = (room(name, kind, n, WIDTH) for name, n in
                                   (("x", count * WINDOW), ("own", rows), ("q", rows), ("mixed", rows), ("spare", rows)))
        u, kv = room("u", kind, rows, INNER), room("kv", kind, count, WINDOW, 2 * WIDTH)
        a = room("a", kind, count, STRIDE, WINDOW)
        a.reshape(-1, WINDOW)[...] /= room["total"][:, None]
        at = np.flatnonzero(targets.reshape(-1) >= 0)
        t = targets.reshape(-1)[at]
        group = np.minimum(t // MEMBERS, CLASSES)
        order = np.argsort(group.astype(np.int8), kind="stable")
        at, t, group = at[order], t[order], group[order]
        picked = np.take(y, at, axis=0, out=room("picked", kind, len(at), WIDTH + 1), mode="clip")

        def loss(make, targets):
            z, total = _exp(make)
            z *= (share / total)[:, None]
            z.reshape(-1)[np.arange(len(z)) * z.shape[1] + targets] -= share
            return z

        z = room("z", kind, len(at), CLASSES + 1)
        dz = loss(lambda: _times(picked, np.vstack([p["cls"], p["cls_b"]]), z), group)
        both = _gram(picked, dz)
        g["cls"] += both[:WIDTH]
        g["cls_b"] += both[WIDTH]
        dh = _times(dz, _turned(p["cls"]), room("dp", kind, len(at), WIDTH))
        bounds, members, in_head = self._bounds(group), self._members(), int(np.count_nonzero(group < CLASSES))
        turned = np.ascontiguousarray(p["mem"].transpose(0, 2, 1))
        z, more, both = room("z", kind, in_head, MEMBERS), room("more", kind, in_head, WIDTH), np.zeros_like(members)

        def logits():
            for c, part in bounds:
                np.matmul(picked[part], members[c], out=z[part])
            return z

        dm = loss(logits, t[:in_head] % MEMBERS)
        for c, part in bounds:
            np.matmul(picked[part].T, dm[part], out=both[c])
            np.matmul(dm[part], turned[c], out=more[part])
        g["mem"] += both[:, :WIDTH]
        g["mem_b"] += both[:, WIDTH]
        dh[:in_head] += more
        dy = room("dy", kind, rows, WIDTH)
        dy[...] = 0
        dy[at] = dh
        g["down"] += _gram(u, dy)
        du = _times(dy, _turned(p["down"]), room("du", kind, rows, INNER))
        du *= u > 0
        both = _gram(h, du)
        g["up"] += both[:WIDTH]
        g["up_b"] += both[WIDTH]
        dh = _times(du, _turned(p["up"]), room("dh", kind, rows, WIDTH))
        dh += dy
        g["out"] += _gram(mixed, dh)
        dmixed = _times(dh, _turned(p["out"]), room("dmixed", kind, rows, WIDTH))
        # the mean of a row's gradients under its weights, from what was mixed
        mean = np.multiply(dmixed, mixed, out=spare) @ np.ones(WIDTH, kind)

        def wide(m):
            return m.reshape(count, STRIDE, WIDTH)

        ds = np.matmul(wide(dmixed), kv[..., WIDTH:].transpose(0, 2, 1), out=room("ds", kind, count, STRIDE, WINDOW))
        ds -= mean.reshape(count, STRIDE, 1)
        ds *= a
        dkv = room("dkv", kind, count, WINDOW, 2 * WIDTH)
        np.matmul(ds.transpose(0, 2, 1), wide(q), out=dkv[..., :WIDTH])
        np.matmul(a.transpose(0, 2, 1), wide(dmixed), out=dkv[..., WIDTH:])
        dkv = dkv.reshape(-1, 2 * WIDTH)
        dq = np.matmul(ds, kv[..., :WIDTH], out=wide(spare)).reshape(-1, WIDTH)
        dq *= scale
        g["q"] += _gram(own, dq)
        g["kv"] += _gram(x, dkv)
        dx = _times(dkv, _turned(p["kv"]), room("dx", kind, count * WINDOW, WIDTH))
        dh += _times(dq, _turned(p["q"]), room("dmixed", kind, rows, WIDTH))
        dx.reshape(count, WINDOW, WIDTH)[:, CONTEXT:] += wide(dh)
        g["place"] += dx.reshape(count, WINDOW, WIDTH).sum(axis=0)
        order = np.argsort(numbers.reshape(-1).astype(np.int16), kind="stable")
        number = numbers.reshape(-1)[order]
        first = np.concatenate([[0], np.flatnonzero(number[1:] != number[:-1]) + 1])
        sorted_rows = np.take(dx, order, axis=0, out=room("x", kind, count * WINDOW, WIDTH), mode="clip")
        g["embed"][number[first]] += np.add.reduceat(sorted_rows, first, axis=0)

    def train(self, numbers: np.ndarray, targets: np.ndarray, rounds: int = 2, batch: int = 32, rate: float = 0.015, seed: int = 23) -> Attention:
        rng = np.random.default_rng(seed)
        steps, planned = Steps(self), max(1, rounds * -(-len(numbers) // batch))
        for _ in range(rounds if len(numbers) else 0):
            for part in np.array_split(rng.permutation(len(numbers)), -(-len(numbers) // batch)):
                steps(numbers[part], targets[part], rate * (1 - (steps.taken + 1) / (planned + 1)))
        return self


class Steps:
    """Adam steps on a model."""

    def __init__(self, model: Attention):
        self.model, self.taken = model, 0
        self.mean = {k: np.zeros_like(v) for k, v in model.p.items()}
        self.spread = {k: np.zeros_like(v) for k, v in model.p.items()}

    def __call__(self, numbers: np.ndarray, targets: np.ndarray, rate: float) -> None:
        self.taken += 1
        now, p, mean, spread = np.float32(rate), self.model.p, self.mean, self.spread
        for k, g in self.model.gradients(numbers, targets).items():
            mean[k] += np.float32(0.1) * (g - mean[k])
            spread[k] += np.float32(0.01) * (g * g - spread[k])
            p[k] -= now * (mean[k] / np.float32(1 - 0.9 ** self.taken)) / (np.sqrt(spread[k] / np.float32(1 - 0.99 ** self.taken)) + np.float32(1e-7))


class Laid:
    """Texts (ids) laid end to end, each with its end token: `ids` and their
    numbers; `text` and `first` are the text and the first scored place in it
    of every window. Each target is scored by one window."""

    def __init__(self, texts: list[np.ndarray], words: Vocabulary):
        end = np.array([words.end])
        self.ids = np.concatenate([part for t in texts for part in (t, end)]).astype(np.int32)
        self.number = words.number[self.ids]
        self.lengths = np.array([len(t) + 1 for t in texts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.counts = -(-self.lengths // STRIDE)
        self.text = np.repeat(np.arange(len(texts)), self.counts)
        self.first = (np.arange(len(self.text)) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)) * STRIDE

    def windows(self, which) -> tuple[np.ndarray, np.ndarray]:
        """Of the windows numbered `which`: the inputs (count, WINDOW) and the
        places in `ids` that they score (count, STRIDE; -1 past a text's end)."""
        first, text = self.first[which][:, None], self.text[which]
        starts = self.starts[text][:, None]
        scored = first + np.arange(STRIDE)
        place = np.where(scored < self.lengths[text][:, None], scored + starts, -1)
        # the input at a place is the target before it, or a start mark
        before = first + np.arange(-CONTEXT - 1, STRIDE - 1)
        return np.where(before < 0, START, self.number[np.clip(before + starts, 0, len(self.ids) - 1)]), place

    def training(self, which) -> tuple[np.ndarray, np.ndarray]:
        """(inputs, targets) of windows; targets are -1 past a text's end."""
        inputs, place = self.windows(which)
        return inputs, np.where(place >= 0, self.number[place], -1)

    def shared(self, share: int, marks: np.ndarray) -> np.ndarray:
        """The numbers of one in `share` windows of every text, one at least,
        from the window on that the text's mark names."""
        number = self.first // STRIDE
        return np.flatnonzero(number % share == (marks % np.minimum(share, self.counts))[self.text])


def windows(texts: list[np.ndarray], words: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs and scored places of all windows, the text of each, and the target ids."""
    laid = Laid(texts, words)
    return (*laid.windows(slice(None)), laid.text, laid.ids)


class Scorer:
    def __init__(self, model: Attention, words: Vocabulary):
        self.model, self.words = model, words

    def __call__(self, texts: list[np.ndarray], at_once: int = 2 * BLOCK) -> np.ndarray:
        """log10 probability of each text with its end token."""
        laid = Laid(texts, self.words)
        total = np.zeros(len(texts))
        for i in range(0, len(laid.text), at_once):
            inputs, place = laid.windows(slice(i, i + at_once))
            where = place.ravel()
            mark = where >= 0
            hit = where[mark]
            got = self.model.log10_scores(inputs, mark, laid.number[hit], laid.ids[hit], self.words)
            total += np.bincount(np.repeat(laid.text[i:i + at_once], STRIDE)[mark], got, len(texts))
        return total


def training_windows(texts: list[np.ndarray], words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(inputs, targets) of all windows."""
    if not texts:
        return np.zeros((0, WINDOW), np.int32), np.zeros((0, STRIDE), np.int32)
    return Laid(texts, words).training(slice(None))


def subwords(encode, words: list[bytes]) -> np.ndarray:
    return encode(" " + b" ".join(words).decode("utf-8")) if words else np.zeros(0, np.uint32)


def held_out(id_col: str | Column = "doc_id") -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def pieces(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(from, to) of consecutive rows, in all of at most `most` or a single row."""
    ends, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] - sizes[i] + most, "right")))
        yield i, j
        i = j


def text_slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Slices of about `BYTES` of texts (UTF-8 bytes; null: empty), and where they begin."""
    texts = texts.fill_null(b"")
    for i, j in pieces(pc.binary_length(texts).to_numpy().astype(np.int64), BYTES):
        yield i, texts.slice(i, j - i)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased (A-Z only) words of texts end to end, and how many each has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    words, of = lists.flatten(), pc.list_parent_indices(lists)
    held = pc.greater(pc.binary_length(words), 0)  # white space at an end leaves an empty word there
    return words.filter(held).view(pa.binary()), np.bincount(of.filter(held).to_numpy(), minlength=len(texts))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, c) over all texts; words are UTF-8 bytes."""
    columns = pa.schema([("word", pa.binary()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_slices(batch.column(0)):
                yield pa.RecordBatch.from_arrays(pc.value_counts(split_words(texts)[0]).flatten(), schema=columns)

    return docs.select(utf8(text_col)).mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def id_counts(training: DataFrame) -> np.ndarray:
    """How often each subword id occurs in rows with `ids`; one row per id at most reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(IDS, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                total += np.bincount(np.frombuffer(ids.as_buffer(), STORED), minlength=IDS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    out = np.zeros(IDS)
    for r in training.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r.id] = r.n
    return out


def train_on_all(model: Attention, training: DataFrame, words: Vocabulary, rate: float = 0.004, share: int = 1) -> int:
    """Goes on from the model's parameters over one in `share` windows of
    every row of `training` (doc_id, ids), once; returns the number of
    targets learned from.

    A hash deals the texts into `ROUNDS` parts. In a round every task steps
    through the windows of its texts of that part, all tasks from the same
    parameters; the new parameters are the tasks' mean, weighted by targets.
    A task holds a buffer of windows; sums are added up by `FAN` rows at a
    time and in the order of the tasks, so the driver gets one row for
    FAN * FAN tasks and the result is the same again."""
    spark = training.sparkSession.sparkContext
    shared, learned = spark.broadcast(words), 0
    schema = "task int, weight bigint, total binary"
    columns = pa.schema([("task", pa.int32()), ("weight", pa.int64()), ("total", pa.binary())])

    def row(task: int, weight: int, total: np.ndarray) -> list:
        return [pa.array([task], pa.int32()), pa.array([weight], pa.int64()), pa.array([total.tobytes()], pa.binary())]

    def added(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(c.to_pylist() for c in table.columns)))
        total = np.sum([np.frombuffer(t) for _, _, t in rows], axis=0)
        return pa.Table.from_arrays(row(rows[0][0] // FAN, sum(w for _, w, _ in rows), total), schema=columns)

    for number in range(ROUNDS):
        given = spark.broadcast(model.p)
        now = rate * (1 - number / ROUNDS)

        def learn(batches, given=given, now=now, number=number):
            own, rng = Attention(), np.random.default_rng(number)
            own.p = {k: v.copy() for k, v in given.value.items()}
            steps, pending, size, weight = Steps(own), [], 0, 0

            def through():
                laid, seen = Laid([np.frombuffer(t, STORED) for t in pending], shared.value), 0
                picked = rng.permutation(laid.shared(share, np.array([zlib.crc32(t) for t in pending])))
                for part in np.array_split(picked, -(-len(picked) // AT_ONCE)):
                    inputs, targets = laid.training(part)
                    steps(inputs, targets, now)
                    seen += int((targets >= 0).sum())
                return seen

            for batch in batches:
                for ids in batch.column(0):
                    pending.append(ids.as_py())
                    size += len(pending[-1]) + 2
                    if size > 400_000 * share:
                        weight += through()
                        pending, size = [], 0
            if pending:
                weight += through()
            if weight:
                total = np.concatenate([v.ravel() for v in own.p.values()]).astype(np.float64) * weight
                yield pa.RecordBatch.from_arrays(row(TaskContext.get().partitionId(), weight, total), schema=columns)

        sums = training.where(F.pmod(F.xxhash64("doc_id", "ids"), F.lit(ROUNDS)) == number).select("ids").mapInArrow(learn, schema)
        for _ in range(2):
            sums = sums.groupBy(F.floor(F.col("task") / FAN)).applyInArrow(added, schema)
        rows = sorted((r.task, r.weight, bytes(r.total)) for r in sums.collect())
        given.unpersist()
        if rows:
            weight = sum(w for _, w, _ in rows)
            mean = np.sum([np.frombuffer(t) for _, _, t in rows], axis=0) / weight
            cuts = np.cumsum([v.size for v in model.p.values()])[:-1]
            model.p = {k: part.reshape(v.shape).astype(v.dtype) for (k, v), part in zip(model.p.items(), np.split(mean, cuts))}
            learned += weight
    return learned


ENCODED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()),
                     ("rare", pa.list_(pa.binary())), ("times", pa.list_(pa.int64())), ("ids", pa.binary())])


class Memory:
    """The distinct words of a part of the texts: of each its ids (`lengths`
    of them in `flat`, from `begins` on; all made together), and the logarithm
    of its count plus one where it is frequent (else nan)."""

    def __init__(self, encode, frequent: dict[bytes, float]):
        self.encode, self.frequent = encode, pa.array(list(frequent), pa.binary())
        self.known = np.array([*frequent.values(), math.nan])

    def learn(self, distinct: pa.Array) -> None:
        self.words = distinct
        text = distinct.view(pa.string())
        odd = pc.match_substring_regex(text, _INNER_SPACE)
        plain = text.filter(pc.invert(odd))
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(plain)], plain), " ")[0].as_py()
        ids = self.encode(" " + joined) if len(plain) else np.zeros(0, np.uint32)
        # the ids of a word end where its bytes end
        ends = np.cumsum(pc.binary_length(plain).to_numpy().astype(np.int64) + 1)
        self.odd = odd.to_numpy(zero_copy_only=False)
        self.lengths = np.zeros(len(distinct), np.int64)
        self.lengths[~self.odd] = np.diff(np.searchsorted(np.cumsum(self.encode.sizes[ids]), ends, "right"), prepend=0)
        self.begins, self.flat = np.cumsum(self.lengths) - self.lengths, ids.astype(STORED)
        self.logs = self.known[pc.fill_null(pc.index_in(distinct, self.frequent), -1).to_numpy()]

    def ids(self, numbers: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        """Of texts of so many words, given end to end as numbers of the words."""
        size, cuts = self.lengths[numbers], np.cumsum(counts)[:-1]
        ends = np.concatenate([[0], np.cumsum(size)])
        found = self.flat[np.repeat(self.begins[numbers] - ends[:-1], size) + np.arange(ends[-1])]
        out = np.split(found, ends[cuts])
        if self.odd.any():
            for i, of in enumerate(np.split(numbers, cuts)):
                if self.odd[of].any():
                    out[i] = subwords(self.encode, self.words.take(pa.array(of)).to_pylist()).astype(STORED)
        return out


def encoded(memory: Memory, texts: list[list[bytes]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The ids of texts, given as words, and their words' logarithms."""
    words, counts = pa.array(list(chain.from_iterable(texts)), pa.binary()).dictionary_encode(), np.array([len(t) for t in texts], np.int64)
    memory.learn(words.dictionary)
    numbers = words.indices.to_numpy()
    return memory.ids(numbers, counts), np.split(memory.logs[numbers], np.cumsum(counts)[:-1])


def encode_documents(texts: DataFrame, vocabulary: str, frequent: dict[bytes, float]) -> DataFrame:
    """Rows (doc_id, held_out, text) with their ids, and the parts of the base
    score: of frequent words the sum, of rarer ones the words."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(load_encoder(vocabulary), shared.value)
        for batch in batches:
            for at, text in text_slices(batch.column(2)):
                words, counts = split_words(text)
                words = words.dictionary_encode()
                memory.learn(words.dictionary)
                numbers, ends = words.indices.to_numpy(), np.concatenate([[0], np.cumsum(counts)])
                for i, j in pieces(counts, AT_A_TIME):
                    of, n = numbers[ends[i]:ends[j]], counts[i:j]
                    logs = memory.logs[of]
                    seldom = np.isnan(logs)
                    row = np.repeat(np.arange(j - i), n)
                    pairs, times = np.unique(row[seldom] * len(memory.words) + of[seldom], return_counts=True)
                    cuts = pa.array(np.searchsorted(pairs, np.arange(j - i + 1) * len(memory.words)), pa.int32())
                    known = np.bincount(row[~seldom], minlength=j - i)
                    base = [math.fsum(log.tolist()) for log in np.split(logs[~seldom], np.cumsum(known)[:-1])]
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).slice(at + i, j - i), batch.column(1).slice(at + i, j - i), pa.array(n + 1, pa.int64()),
                        pa.array(known, pa.int64()), pa.array(base, pa.float64()),
                        pa.ListArray.from_arrays(cuts, memory.words.take(pa.array(pairs % max(1, len(memory.words))))),
                        pa.ListArray.from_arrays(cuts, pa.array(times, pa.int64())),
                        pa.array([x.tobytes() for x in memory.ids(of, n)], pa.binary())], schema=ENCODED)

    return texts.select(F.col("doc_id").cast("bigint"), "held_out", utf8("text")).mapInArrow(
        run, ", ".join(f"`{f.name}` {sql_type(f.type)}" for f in ENCODED))


def add_scores(table: DataFrame, model: Attention, words: Vocabulary) -> DataFrame:
    """`table` with the column `score` in place of `ids`, its last column."""
    shared = table.sparkSession.sparkContext.broadcast(Scorer(model, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, pending, size = [], [], 0
            for i, ids in enumerate(batch.column(batch.num_columns - 1)):
                pending.append(np.frombuffer(ids.as_py(), STORED))
                size += len(pending[-1]) + 1
                if size > 100_000 or i + 1 == batch.num_rows:
                    scores += shared.value(pending).tolist()
                    pending, size = [], 0
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "score"])

    kept = table.schema.fields[:-1]
    return table.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", score double")


def starting_slices(training: DataFrame, rows: int) -> list[np.ndarray]:
    """At most `SLICE` ids from a hashed place of each of `rows` texts (lowest hashes)."""
    size = F.length("ids") / 2
    place = F.pmod(F.xxhash64("ids", "doc_id"), F.greatest(size - SLICE, F.lit(0)).cast("bigint") + 1)
    cut = training.select("doc_id", F.substring("ids", (2 * place + 1).cast("int"), F.lit(2 * SLICE)).alias("ids"))
    return [np.frombuffer(bytes(r.ids), STORED) for r in hashed_sample(cut, rows, "doc_id", "ids").select("ids").collect()]


def score_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 50_256,
                    sample_rows: int = 480, share: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score per document."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out(id_col).alias("held_out"))
    counts = stored(word_counts(texts.where("not held_out")), "words")
    found = counts.agg(F.count("*").alias("v"), F.sum("c").alias("n")).first()
    ends = texts.where("not held_out").count()
    n, v = (found.n or 0) + ends, found.v + (ends > 0)
    often = counts.where(F.col("c") * FREQUENT >= n).collect()  # at most FREQUENT rows: their counts add up to n at most
    table = stored(encode_documents(texts, vocabulary, {bytes(r.word): math.log10(r.c + 1) for r in often})
                   .withColumn("row", F.monotonically_increasing_id()), "ids")
    training = table.where("not held_out").select("doc_id", "ids")
    spread = id_counts(training)
    spread[end_id] = ends
    words = Vocabulary(spread, end_id)
    model = Attention().train(*training_windows(starting_slices(training, sample_rows), words))
    train_on_all(model, training, words, share=share)
    passed = add_scores(table.select("row", "doc_id", "held_out", "n_tokens", "known", "base", "ids"), model, words)
    rare = table.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("word"), "r.times")
    seldom = counts.where(F.col("c") * FREQUENT < n)
    added = rare.join(seldom, "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("part"))
    return passed.join(added, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.lit(int(ends > 0)) + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.lit(math.log10(ends + 1)) + F.coalesce("part", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(n + v + 1))).alias("base_score"),
        "score")
