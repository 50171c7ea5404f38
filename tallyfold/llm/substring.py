"""Substring dedup by sliding sentence spans.

A text is cut into sentences (at closing marks before white space, and at
line ends). Any `GAP` words in a row without such an end are cut at the one
with the lowest rank, clause marks first; the rank hashes a word with the
one before it. So a cut depends on the nearest words alone, no piece has
more than `GAP` words, and a passage of 50 words holds a run in every place
it occurs, wherever it starts. Below, a sentence is such a piece. Every run
of consecutive sentences, the shortest from each sentence on with at least
`sentences` sentences and `least_words` words, is hashed over its words; a
text that holds no such run is one run, however short.
The hashes are joined over the whole corpus, and every sentence covered by
a run that also occurs earlier (by doc_id, then place) is removed. The
first occurrence stays.

Scale: the words of a batch of texts are hashed once each, and all ranks,
cuts and run hashes are array arithmetic on them. A task holds runs in
buffers of bounded size and joins each buffer in itself first: of equal
runs only the earliest goes on as a row, the others are known to be later
and leave as merged spans. So a passage in a third of all documents is one
row per buffer, and one shuffle of narrow rows (a 128-bit hash, the
document, two packed numbers) finds the rest: a run is later if its rank
among the equal ones is not the first. Nothing is joined back, and no text
is shuffled with the runs. What is collected per document is at most its
own runs.

Defined cases: null texts stay null, texts without a word stay as they are
and have no sentences; a very long text is cut in time proportional to its
length, whatever it repeats; a null doc_id orders after all others; rows
that repeat both doc_id and text are one document and kept alike; of rows
that share a doc_id only, the text's hash decides which is earlier; an
empty table gives an empty result; extra columns, whatever their names, are
not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# possessive and not after another mark: a run of marks is tried once, not once from each of them
_END = re.compile(r"(?<![.!?])[.!?]++[\"')\]]*+\s++|\n\s*+")
GAP = 8  # of any so many words in a row, a sentence is cut after one at least
AT_ONCE, BUFFER, OUT = 1_000_000, 1_000_000, 100_000  # characters cut together, runs joined in a task, rows a batch

_SPACE = np.array([chr(c).isspace() for c in range(0x3001)])
_CLAUSE = [ord(c) for c in ",;:"]
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)  # odd: powers can be divided out again

RUNS = pa.schema([(name, pa.int64()) for name in ("high", "low", "doc_id", "text_hash", "place", "chars")])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _packed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.int64) << 32) | b.astype(np.int64)


class Cut:
    """Texts cut into sentences. Texts are laid end to end, a line end
    between them; `starts` are the places of their words, `first` the
    numbers of the words that begin a sentence (and the count of words),
    `text` the text that each sentence belongs to."""

    def __init__(self, texts: list[str]):
        joined = "\n".join(texts)
        lengths = np.array([len(t) for t in texts], np.int64)
        self.lengths, self.offsets = lengths, np.cumsum(lengths + 1) - lengths - 1
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        space = np.ones(len(points) + 2, bool)
        space[1:-1] = (points < len(_SPACE)) & _SPACE[np.minimum(points, len(_SPACE) - 1)]
        edges = np.flatnonzero(space[1:] != space[:-1])
        self.starts, last = edges[::2], points[edges[1::2] - 1]
        words = joined.lower().split()
        numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
        table = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, numbers)), "<u8").reshape(-1, 2)
        self.lanes = table[np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))]
        n = len(self.starts)
        begins = np.zeros(n + 1, bool)
        begins[np.searchsorted(self.starts, [m.end() for m in _END.finditer(joined)])] = True
        begins[np.searchsorted(self.starts, self.offsets)] = True
        self._cut_long(begins, np.isin(last, _CLAUSE), n)
        self.first = np.append(np.flatnonzero(begins[:n]), n)
        self.text = np.searchsorted(self.offsets, self.starts[self.first[:-1]], "right") - 1

    def _cut_long(self, begins: np.ndarray, clause: np.ndarray, n: int) -> None:
        """Begins a sentence after the lowest rank of each `GAP` words before
        the last one of a sentence; of equal ranks the last counts."""
        m = n - GAP
        if m <= 0:
            return
        sentence = np.cumsum(begins[:n])
        before = np.append(np.uint64(0), self.lanes[:-1, 0])
        before[begins[:n]] = 0
        rank = _mixed(self.lanes[:, 0] + before * np.uint64(_BASES[0])) >> np.uint64(1)
        rank[~clause] |= np.uint64(1 << 63)
        own = np.arange(m)
        best, at = rank[:m].copy(), own.copy()
        for k in range(1, GAP):
            lower = rank[k:k + m] <= best
            np.copyto(best, rank[k:k + m], where=lower)
            np.copyto(at, own + k, where=lower)
        begins[at[sentence[:m] == sentence[GAP:]] + 1] = True

    def spans(self, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in their text of the sentences first..end; the first and the
        last one of a text reach to its edges."""
        text = self.text[first]
        one = np.searchsorted(self.text, text)
        a = np.where(first == one, 0, self.starts[self.first[first]] - self.offsets[text])
        ends = end == np.searchsorted(self.text, text, "right")
        b = self.starts[np.minimum(self.first[end], len(self.starts) - 1)] - self.offsets[text]
        return a, np.where(ends, self.lengths[text], b)

    def runs(self, sentences: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first sentence, end, two hash lanes) of every run."""
        count = len(self.text)
        own, limit = np.arange(count), np.searchsorted(self.text, self.text, "right")
        end = np.maximum(np.searchsorted(self.first, self.first[:-1] + least_words), own + sentences)
        held = end <= limit
        some = np.zeros(len(self.lengths), bool)
        some[self.text[held]] = True
        whole = ~some[self.text] & (np.append(-1, self.text[:-1]) != self.text)  # first sentence of a text without runs
        first = np.flatnonzero(held | whole)
        end = np.where(held, end, limit)[first]
        a, b = self.first[first], self.first[end]
        return first, end, np.stack([_mixed(self._sums(lane, base, a, b) + (b - a).astype(np.uint64))
                                     for lane, base in enumerate(_BASES)], axis=1)

    def _sums(self, lane: int, base: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of words a..b, the sum of hash * base ** (place - a), modulo 2^64."""
        n = len(self.lanes)

        def powers(x):
            out = np.full(n + 1, x, np.uint64)
            out[:1] = 1
            return np.cumprod(out)

        total = np.append(np.uint64(0), np.cumsum(self.lanes[:, lane] * powers(base)[:n]))
        return (total[b] - total[a]) * powers(pow(base, -1, 1 << 64))[a]


class Buffer:
    """The runs of some documents, joined with one another."""

    def __init__(self):
        self.docs, self.parts, self.size = [], [], 0

    def add(self, docs: list[tuple], cut: Cut, sentences: int, least_words: int) -> None:
        first, end, lanes = cut.runs(sentences, least_words)
        text = cut.text[first]
        one = np.searchsorted(cut.text, text)
        pieces = np.bincount(cut.text, minlength=len(docs))
        self.parts.append((text + len(self.docs), lanes, _packed(first - one, end - one), _packed(*cut.spans(first, end))))
        self.docs += [(*d, p) for d, p in zip(docs, pieces.tolist())]
        self.size += len(first)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The earliest of equal runs as they are; the later ones as merged
        spans, and the number of sentences of each document (`chars` is -1),
        both with the complement of `place` and a hash of their own."""
        if not self.docs:
            return
        null = np.array([d[0] is None for d in self.docs])
        ids = np.array([d[0] or 0 for d in self.docs], np.int64)
        hashes, pieces = (np.array([d[k] for d in self.docs], np.int64) for k in (1, 2))
        order = np.lexsort((hashes, ids, null))
        fresh = np.ones(len(order), bool)
        fresh[1:] = np.any([k[order][1:] != k[order][:-1] for k in (hashes, ids, null)], axis=0)
        rank = np.full(len(order), -1)
        rank[order[fresh]] = np.arange(fresh.sum())  # a document that was there before stays -1
        docs = order[fresh]
        doc = rank[np.concatenate([p[0] for p in self.parts])]
        kept = np.flatnonzero(doc >= 0)
        kept = kept[np.argsort(doc[kept], kind="stable")]
        doc = doc[kept]
        lanes, place, chars = (np.concatenate([p[k] for p in self.parts])[kept] for k in (1, 2, 3))
        equal = np.lexsort((lanes[:, 1], lanes[:, 0]))
        later = np.zeros(len(doc), bool)
        later[equal[1:]] = (lanes[equal[1:]] == lanes[equal[:-1]]).all(axis=1)
        at = np.flatnonzero(later)
        # runs of a document are in order and so are their ends
        apart = np.ones(len(at), bool)
        apart[1:] = (doc[at[1:]] != doc[at[:-1]]) | ((place[at[1:]] >> 32) > (place[at[:-1]] & 0xFFFFFFFF))
        a, b = at[apart], at[np.append(apart[1:], True)[:len(at)]]
        mask = 0xFFFFFFFF
        spans = (doc[a], ~_packed(place[a] >> 32, place[b] & mask), _packed(chars[a] >> 32, chars[b] & mask))
        counts = (np.arange(len(docs)), ~pieces[docs], np.full(len(docs), -1))
        firsts = (doc[~later], place[~later], chars[~later])
        doc2, place2, chars2 = (np.concatenate(k) for k in zip(spans, counts))
        own = docs[doc2]
        own_lanes = np.stack([_mixed(hashes[own].view(np.uint64) + place2.view(np.uint64) * np.uint64(_BASES[1])),
                              _mixed(ids[own].view(np.uint64) + place2.view(np.uint64) * np.uint64(_BASES[0]))], axis=1)
        lanes = np.concatenate([lanes[~later], own_lanes]).view(np.int64)
        doc, place, chars = (np.concatenate(k) for k in zip(firsts, (doc2, place2, chars2)))
        doc = docs[doc]
        out = pa.RecordBatch.from_arrays([pa.array(lanes[:, 0]), pa.array(lanes[:, 1]), pa.array(ids[doc], mask=null[doc]), pa.array(hashes[doc]),
                                          pa.array(place), pa.array(chars)], schema=RUNS)
        for i in range(0, out.num_rows, OUT):
            yield out.slice(i, OUT)


def run_table(docs: DataFrame, id_col: str, text_col: str, sentences: int, least_words: int) -> DataFrame:
    """The rows of all buffers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, ids, texts, size = Buffer(), [], [], 0
        for batch in batches:
            for doc_id, text_hash, text in zip(*batch.columns):
                ids.append((doc_id.as_py(), text_hash.as_py()))
                texts.append(text.as_py())
                size += len(texts[-1])
                if size > AT_ONCE:
                    buffer.add(ids, Cut(texts), sentences, least_words)
                    ids, texts, size = [], [], 0
                    if buffer.size > BUFFER:
                        yield from buffer.rows()
                        buffer = Buffer()
        if texts:
            buffer.add(ids, Cut(texts), sentences, least_words)
        yield from buffer.rows()

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("h"), text.alias("t")).where("t <> ''")
    return rows.mapInArrow(run, ", ".join(f"{name} bigint" for name in RUNS.names))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: int = 3,
                  least_words: int = 12) -> DataFrame:
    """(doc_id, text_hash, runs): per document with text, the spans that
    occur earlier in the corpus (`place`: first sentence and end, `chars`:
    first character and end, packed; complements of `place` are merged
    spans), and its number of sentences where `chars` is -1."""
    equal = Window.partitionBy("high", "low").orderBy(F.col("doc_id").asc_nulls_last(), "text_hash", "place")
    # the same place of a document that several buffers hold has the same rank
    found = run_table(docs, id_col, text_col, sentences, least_words).withColumn("rank", F.rank().over(equal)).where("rank > 1 or place < 0")
    return found.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("place", "chars")).alias("runs"))


def without(text: str, place: np.ndarray, chars: np.ndarray) -> tuple[str, int, int]:
    """(text without the spans, sentences, removed ones), from the runs of a document."""
    counts = chars == -1
    total = int(~place[counts].min(initial=-1)) if counts.any() else 0
    place = np.where(place < 0, ~place, place)[~counts]
    chars = chars[~counts][np.argsort(place)]
    out, at, done, removed = [], 0, 0, 0
    for p, c in zip(np.sort(place).tolist(), chars.tolist()):
        first, end, a, b = p >> 32, p & 0xFFFFFFFF, c >> 32, c & 0xFFFFFFFF
        if a > at:
            out.append(text[at:a])
        at = max(at, b)
        removed += max(0, end - max(first, done))
        done = max(done, end)
    out.append(text[at:])
    return "".join(out), total, removed


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: int = 3,
                   least_words: int = 12) -> DataFrame:
    """doc_id, n_sentences, n_removed and the text that is left, per document."""
    found = repeated_runs(docs, id_col, text_col, sentences, least_words)
    schema = pa.schema([("doc_id", pa.int64()), ("n_sentences", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                batch = whole.slice(i, 1024)
                texts, runs = batch.column(1), batch.column(2)
                place, chars = (k.to_numpy(zero_copy_only=False) for k in runs.flatten().flatten())
                ends = np.cumsum(np.array(pa.compute.fill_null(pa.compute.list_value_length(runs), 0), np.int64))
                kept = []
                for k, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
                    kept.append(without(texts[k].as_py(), place[a:b], chars[a:b]) if b > a else (texts[k].as_py(), 0, 0))
                text, total, removed = zip(*kept)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                                                  pa.array(text, pa.string())], schema=schema)

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("t"), F.xxhash64(text).alias("h"))
    joined = rows.join(found, rows["id"].eqNullSafe(found["doc_id"]) & (rows["h"] == found["text_hash"]), "left")
    return joined.select("id", "t", "runs").mapInArrow(left, "doc_id bigint, n_sentences bigint, n_removed bigint, text string")
