"""Bounded-space online best-fit packing of token sequences.

Every document becomes its token ids plus an end id. Documents longer than
a sequence are cut into full-length pieces, with the shorter piece first.
Pieces are packed batch by batch as they arrive (the longest of a batch
first) into a fixed number of open sequences: a piece goes to the open sequence with the least free space that still
holds it, else to a new one; when too many are open, the fullest closes.
The open sequences are keyed by free space in one integer used as a bitset,
so the best fit is its lowest set bit at or above the piece's length.

Scale: one pass per input partition and no shuffle; what a task holds is
the open sequences (numbers only) and one batch of texts. Each partition
leaves at most `open_bins` sequences that could have taken more, which is
a vanishing share at usual split sizes.

Recovery: a partition's packing depends on its rows alone, so a task that
is run again gives the same sequences. Sequence ids are the partition
number times 2^32 plus a running number.

Defined cases: a null or empty text is the end id alone; repeated rows are
packed as documents of their own; an empty table gives no piece.
"""

from __future__ import annotations

import struct
from collections import defaultdict

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import map_lists
from tallyfold.llm.tokens import load_encoder

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


class OpenBins:
    """At most `limit` open bins of `size`; bit f of `mask` is set while a
    bin with f free places is open, and `by_free[f]` stacks those bins."""

    def __init__(self, size: int, limit: int, first_id: int = 0):
        self.size, self.limit, self.next_id = size, limit, first_id
        self.mask, self.count = 0, 0
        self.by_free: dict[int, list[int]] = defaultdict(list)

    def _take(self, free: int) -> int:
        bin_id = self.by_free[free].pop()
        if not self.by_free[free]:
            self.mask ^= 1 << free
        self.count -= 1
        return bin_id

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece of 1..size tokens."""
        fitting = self.mask >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_id = self._take(free)
        else:
            bin_id, free = self.next_id, self.size
            self.next_id += 1
        left = free - length
        if left:
            if self.count == self.limit:  # the fullest closes first
                fullest = (self.mask & -self.mask).bit_length() - 1
                if fullest > left:
                    return bin_id, self.size - free
                self._take(fullest)
            self.by_free[left].append(bin_id)
            self.mask |= 1 << left
            self.count += 1
        return bin_id, self.size - free


def cut(length: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, the rest first."""
    rest = length % size
    pieces = [(0, rest)] if rest else []
    return pieces + [(start, size) for start in range(rest, length, size)]


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048,
                   open_bins: int = 4096, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (unsigned 32-bit
    little-endian), sequence_id and offset."""

    def start():
        encode = load_encoder(vocabulary)
        bins = OpenBins(size, open_bins, TaskContext.get().partitionId() << 32)
        end = struct.pack("<I", end_id)

        def step(doc_ids, texts):
            pieces = []
            for doc_id, text in zip(doc_ids, texts):
                ids = encode(text).astype("<u4").tobytes() + end if text else end
                pieces += [(doc_id, number, first, length, ids[4 * first:4 * (first + length)])
                           for number, (first, length) in enumerate(cut(len(ids) // 4, size))]
            pieces.sort(key=lambda p: -p[3])
            rows = [(*p, *bins.place(p[3])) for p in pieces]
            return {f.name: [r[i] for r in rows] for i, f in enumerate(PIECES)}
        return step

    return map_lists(docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")), start, PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id and ids, the pieces in
    order of offset (a group is one sequence, so it is bounded)."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(
        F.aggregate(ordered, F.lit(b""), lambda so_far, p: F.concat(so_far, p["ids"])).alias("ids"))
