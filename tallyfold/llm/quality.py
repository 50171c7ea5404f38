"""Quality classifier: a factorisation machine.

A text's features are its hashed words (term frequency, unit length), bins
of structure statistics and a bin of its stated length. The score is
    sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)
and the pairwise part is computed in time linear in the features through
    1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

Training: logistic loss, Adam, numpy, on a bounded sample of labelled
documents, `per_label` of either label (lowest hashes of doc_id), weighted
back to the label shares over all training rows. Rows for which
crc32(doc_id as text) mod `folds` is 0 are held out. doc_id, lang, source
and the labels are never features.

Scale: the sample is the only thing collected; scoring is one pass without
a shuffle, and a text's work is linear in its words.

Defined cases: a null or empty text has only its structure bins and still
gets a score; a null stated length has a bin of its own; a document with
several label rows counts once, by its largest quality; without labels of
both kinds every score is the share of the labels there are (0.5 with none).
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import hashed_sample, utf8

WORD_BUCKETS = 1 << 15
# Lower bin edges of each structure statistic.
STATISTICS = {
    "words": (1, 10, 25, 50, 100, 200, 400, 800, 1600, 5000),
    "word_bytes": (1, 2, 3, 4, 5, 6, 7, 8, 10, 14),
    "distinct_share": (.02, .05, .1, .2, .3, .4, .5, .6, .7, .8, .9, .97),
    "top_share": (.02, .04, .06, .08, .1, .15, .2, .3, .5),
    "repeat_share": (.01, .05, .1, .2, .3, .5, .7, .9),
    "line_words": (1, 3, 6, 10, 20, 40, 80, 160, 400),
    "dup_lines": (.01, .05, .1, .2, .3, .5, .7, .9),
    "symbols": (.001, .01, .02, .05, .1, .2, .4),
    "marks": (.001, .01, .02, .04, .06, .1, .2),
    "upper": (.005, .01, .02, .03, .05, .1, .2, .4, .7),
    "digits": (.001, .005, .01, .03, .1, .3),
}
CHARS_BINS = 24
STRIDE = 16  # bins set aside for each statistic
N_FEATURES = WORD_BUCKETS + STRIDE * len(STATISTICS) + CHARS_BINS
_UPPER = bytes(range(0x41, 0x5B))
_DIGITS = bytes(range(0x30, 0x3A))
_SYMBOLS = b"#*$%&|<>"
_MARKS = b"!?~^_=+@"


def statistics(text: bytes, counts: Counter, n: int) -> list[float]:
    lines = [x for x in text.split(b"\n") if x.strip()]
    size = max(1, len(text))
    repeats = sum(c for c in counts.values() if c >= max(8, n // 20))
    return [n, sum(len(w) * c for w, c in counts.items()) / max(1, n), len(counts) / max(1, n),
            max(counts.values(), default=0) / max(1, n), repeats / max(1, n), n / max(1, len(lines)),
            1 - len(set(lines)) / max(1, len(lines)) if lines else 0.0,
            *((size - len(text.translate(None, group))) / size if text else 0.0 for group in (_SYMBOLS, _MARKS, _UPPER, _DIGITS))]


def features(text: bytes | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, values) of one document."""
    text = text or b""
    counts = Counter(text.lower().split())
    n = sum(counts.values())
    norm = math.sqrt(sum(c * c for c in counts.values())) or 1.0
    index = [zlib.crc32(w) % WORD_BUCKETS for w in counts]
    value = [c / norm for c in counts.values()]
    at = WORD_BUCKETS
    for x, edges in zip(statistics(text, counts, n), STATISTICS.values()):
        index.append(at + sum(x >= e for e in edges))
        at += STRIDE
    index.append(at + (CHARS_BINS - 1 if n_chars is None or n_chars < 0 else min(CHARS_BINS - 2, int(n_chars).bit_length())))
    value += [1.0] * (len(STATISTICS) + 1)
    return np.array(index, np.int32), np.array(value, np.float32)


class FactorisationMachine:
    def __init__(self, rank: int = 8, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.bias = 0.0
        self.linear = np.zeros(N_FEATURES, np.float32)
        self.factors = rng.normal(0, 0.02, (N_FEATURES, rank)).astype(np.float32)

    def raw(self, index: np.ndarray, value: np.ndarray) -> float:
        xv = self.factors[index] * value[:, None]
        total = xv.sum(axis=0)
        return float(self.bias + self.linear[index] @ value + 0.5 * (total @ total - (xv * xv).sum()))

    def score(self, text: bytes | None, n_chars: int | None) -> float:
        z = self.raw(*features(text, n_chars))
        return 1 / (1 + math.exp(-z)) if z > -500 else 0.0

    def train(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray,
              rounds: int = 8, batch: int = 64, rate: float = 0.02, decay: float = 1e-4, seed: int = 9) -> FactorisationMachine:
        rng = np.random.default_rng(seed)
        rank = self.factors.shape[1]
        m_w, s_w = np.zeros_like(self.linear), np.zeros_like(self.linear)
        m_v, s_v = np.zeros_like(self.factors), np.zeros_like(self.factors)
        step = 0
        share = float((labels * weights).sum() / weights.sum())
        self.bias = math.log(share / (1 - share))
        for _ in range(rounds):
            for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // batch)):
                step += 1
                index = np.concatenate([rows[i][0] for i in part])
                value = np.concatenate([rows[i][1] for i in part])
                row = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
                starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                xv = self.factors[index] * value[:, None]
                total = np.add.reduceat(xv, starts)
                z = (self.bias + np.add.reduceat(self.linear[index] * value, starts)
                     + 0.5 * ((total ** 2).sum(axis=1) - np.add.reduceat((xv ** 2).sum(axis=1), starts)))
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) * weights[part] / weights[part].mean() / len(part)
                used, place = np.unique(index, return_inverse=True)
                g_w = np.bincount(place, error[row] * value, len(used)).astype(np.float32) + decay * self.linear[used]
                pair = (error[row] * value)[:, None] * (total[row] - xv)
                g_v = np.stack([np.bincount(place, pair[:, f], len(used)) for f in range(rank)], axis=1).astype(np.float32) + decay * self.factors[used]
                self.bias -= rate * float(error.sum())
                for weight, mean, spread, g in ((self.linear, m_w, s_w, g_w), (self.factors, m_v, s_v, g_v)):
                    mean[used] = 0.9 * mean[used] + 0.1 * g
                    spread[used] = 0.99 * spread[used] + 0.01 * g * g
                    weight[used] -= rate * (mean[used] / (1 - 0.9 ** step)) / (np.sqrt(spread[used] / (1 - 0.99 ** step)) + 1e-6)
        return self


def fold_of(id_col: str | Column = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, mod `folds` (a null id counts as the empty text)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % folds


class Constant:
    """The score when there is nothing to learn from."""

    def __init__(self, value: float):
        self.value = value

    def score(self, text: bytes | None, n_chars: int | None) -> float:
        return self.value


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars",
        label_col: str = "quality", folds: int = 5, per_label: int = 1500):
    """A machine trained on at most `per_label` documents of either label."""
    marked = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
              .where(fold_of("id", folds) != 0).groupBy("id").agg(F.max("y").alias("y")))
    counts = {r.y: r["count"] for r in marked.groupBy("y").count().collect()}
    if len(counts) < 2:
        return Constant(float(next(iter(counts))) if counts else 0.5)
    sample = None
    for y in (0, 1):
        part = hashed_sample(marked.where(F.col("y") == y), per_label, "id", total=counts[y])
        sample = part if sample is None else sample.unionByName(part)
    chars = F.col(chars_col).cast("bigint") if chars_col in docs.columns else F.lit(None).cast("bigint")

    @F.pandas_udf("struct<index:array<int>,value:array<float>>")
    def featured(texts: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        found = [features(t, None if pd.isna(n) else int(n)) for t, n in zip(texts, n_chars)]
        return pd.DataFrame({"index": [i for i, _ in found], "value": [v for _, v in found]})

    # the sample is bounded by 2 * per_label ids
    rows = (docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("t"), chars.alias("n"))
            .join(F.broadcast(sample), "id").groupBy("id", "y").agg(F.min(F.struct("t", "n")).alias("d"))
            .select("id", "y", featured(F.col("d.t"), F.col("d.n")).alias("f")).collect())
    rows.sort(key=lambda r: r.id)
    y = np.array([r.y for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return Constant(float(y[0]) if len(y) else 0.5)
    taken = {k: float((y == k).sum()) for k in (0, 1)}
    weights = np.where(y == 1, counts[1] / taken[1], counts[0] / taken[0]).astype(np.float32)
    return FactorisationMachine().train([(np.array(r.f["index"], np.int32), np.array(r.f["value"], np.float32)) for r in rows],
                                        y, weights / weights.mean())


def score_column(docs: DataFrame, model, text_col: str = "text", chars_col: str = "n_chars") -> Column:
    """The score of each document; higher means that label 1 is likelier."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # of fixed size

    @F.pandas_udf("double")
    def scores(texts: pd.Series, n_chars: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([m.score(t, None if pd.isna(n) else int(n)) for t, n in zip(texts, n_chars)], dtype="float64")

    chars = F.col(chars_col).cast("bigint") if chars_col in docs.columns else F.lit(None).cast("bigint")
    return scores.asNondeterministic()(utf8(text_col), chars)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that score at least `threshold`."""
    mark = "_score"
    while mark in docs.columns:
        mark += "_"
    return docs.withColumn(mark, score_column(docs, fit(docs, labels))).where(F.col(mark) >= threshold).drop(mark)
