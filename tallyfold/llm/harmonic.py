"""Harmonic packing of token sequences.

Every document becomes its token ids plus an end id. What is longer than a
sequence gives full sequences first; the rest belongs to the class j of
sequences that hold exactly j pieces, each in a place of size / j tokens. A
rest of more than `whole` tokens goes to the class whose place is the
largest that it fills: the place takes what fits and the remainder is dealt
with in the same way, so those places carry no padding. A rest of at most
`whole` tokens is not cut any more and goes to the class of the smallest
place that holds it, j = size // length, which wastes less than one part in
j + 1. A sequence closes at its j-th piece, whatever else is open.

The sequences that a task could not fill when its rows end are dealt out
again by the classes 1, 2, 4, ..., whose places are powers of two: two
equal units of a class make one unit of the class below, so at most one of
each class is left, a sequence whose length is a power of two. Those need
no padding.

Scale: classes are filled by each task for itself in one pass, without a
shuffle. A task holds one open sequence for each class (about a hundred
with the usual parameters) and a slice of its texts.

Recovery: the packing of a partition depends on its rows alone, so a task
that runs again gives the same sequences. Sequence ids are the partition
number times 2^32 plus a running number.

Defined cases: a null or empty text is the end id alone; a very long text is
read whole and cut like any other; repeated rows and rows of equal length
are documents of their own, in the order of their rows; a null id is kept;
an empty table gives no piece; columns besides the two named are not read,
so their names cannot clash.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import sql_type
from tallyfold.llm.tokens import load_encoder

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

# A piece is (key, start, length); what a key stands for is the caller's.
Piece = tuple[object, int, int]


class HarmonicClasses:
    """One open sequence for each class; `add` and `rest` yield the closed
    sequences as lists of pieces, in the order of their places."""

    def __init__(self, size: int, whole: int):
        self.size, self.whole = size, whole
        self.open: dict[int, list[Piece]] = {}

    def class_of(self, length: int) -> int:
        """Pieces in a sequence that takes `length` (1..size) tokens."""
        return -(-self.size // length) if length > self.whole else self.size // length

    def place(self, j: int, i: int) -> int:
        """Tokens in place i of class j; the j places add up to the size."""
        return self.size * (i + 1) // j - self.size * i // j

    def add(self, key: object, length: int) -> Iterator[list[Piece]]:
        start = 0
        while length - start >= self.size:
            yield [(key, start, self.size)]
            start += self.size
        while start < length:
            j = self.class_of(length - start)
            pieces = self.open.setdefault(j, [])
            taken = min(length - start, self.place(j, len(pieces)))
            pieces.append((key, start, taken))
            start += taken
            if len(pieces) == j:
                yield self.open.pop(j)

    def rest(self) -> Iterator[list[Piece]]:
        """The unfilled sequences, dealt out by places of powers of two."""
        units: dict[int, list[list[Piece]]] = {}
        for j in sorted(self.open):
            for key, start, length in self.open[j]:
                while length:
                    part = 1 << (length.bit_length() - 1)
                    units.setdefault(part, []).append([(key, start, part)])
                    start, length = start + part, length - part
        self.open = {}
        while units:
            part = min(units)
            equal = units.pop(part)
            if 2 * part <= self.size:
                pairs = [equal[i] + equal[i + 1] for i in range(0, len(equal) - 1, 2)]
                if pairs:
                    units[2 * part] = pairs + units.get(2 * part, [])
                equal = equal[len(equal) - len(equal) % 2:]
            yield from equal


def pack_harmonic(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048,
                  whole: int = 64, end_id: int = 1, rows: int = 256) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (unsigned 32-bit
    little-endian), doc_tokens, sequence_id and offset. `size` is the length
    of a sequence, `whole` the largest rest that is not cut, `rows` the
    documents whose texts a task holds at a time as Python objects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(vocabulary)
        classes = HarmonicClasses(size, whole)
        end = struct.pack("<I", end_id)
        next_id = TaskContext.get().partitionId() << 32

        def batch_of(sequences: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal next_id
            out = []
            for pieces in sequences:
                offset = 0
                for (doc_id, ids), start, length in pieces:
                    out.append((doc_id, start, length, ids[4 * start:4 * (start + length)], len(ids) // 4, next_id, offset))
                    offset += length
                next_id += 1
            columns = zip(*out) if out else ([] for _ in PIECES)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECES)], schema=PIECES)

        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                doc_ids, texts = (c.to_pylist() for c in batch.slice(i, rows).columns)
                closed = []
                for doc_id, text in zip(doc_ids, texts):
                    ids = encode(text).astype("<u4").tobytes() + end if text else end
                    closed += classes.add((doc_id, ids), len(ids) // 4)
                yield batch_of(closed)
        yield batch_of(list(classes.rest()))

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(
        run, ", ".join(f"`{f.name}` {sql_type(f.type)}" for f in PIECES))


def padding(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """One row: sequences, tokens and padding, where a sequence is filled up
    to `size` unless its length is a power of two."""
    used = pieces.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    fill = F.when(F.bit_count("used") == 1, 0).otherwise(F.lit(size) - F.col("used"))
    return used.agg(F.count("*").alias("sequences"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"),
                    F.coalesce(F.sum(fill), F.lit(0)).alias("padding"))
