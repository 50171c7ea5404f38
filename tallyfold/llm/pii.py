"""Personal data by a semi-Markov conditional random field.

Two sources of spans. Base rules find email, ip, card and phone spans by
fixed patterns and checks; these always stay. The semi-Markov model adds
spans that the rules do not cover (numbers in other formats, secrets such
as keys, tokens and passwords): a run of neighbouring tokens with a digit
or an at sign is cut into segments, every candidate segment of up to
`MAX_TOKENS` tokens is scored by features of the whole span, and dynamic
programming over bounded segments picks boundaries and kinds jointly.
Tokens without a digit or at sign can only be outside, so the runs are
independent and the search over a text is exact and linear.

The model is trained here, by gradient ascent on the conditional
log-likelihood (forward-backward over segments): on written examples drawn
from format rules with a fixed seed, and on runs from a bounded sample of
the corpus that the base rules explain.

Scale: one pass over the texts without a shuffle; a text without a digit
or at sign costs one search. The patterns are arranged so that a text's
work is linear in its length.

Defined cases: a null or empty text has no spans; repeated rows get equal
spans; an empty table trains on the written examples alone.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import hashed_sample

KINDS = ("email", "ip", "card", "phone", "secret")  # in the order in which ties are listed
BASE_KINDS = 4
OUTSIDE = len(KINDS)
MAX_TOKENS = 5

SPANS = "array<struct<kind:int,first:bigint,end:bigint,base:boolean>>"

# A local part ends at its at sign, so only the domain is a pattern.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is tried from its first digit only: a later start meets the same continuation.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]\S*")
_EDGE = "\"'`,;:.!?()[]{}<>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _is_byte_list(s: str) -> bool:
    """Every dot-separated number is at most 255."""
    parts = [p.lstrip("0") for p in s.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def _is_card(s: str) -> bool:
    d = _digits(s)
    return 14 <= len(d) <= 19 and luhn(d)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, first, end) of the base rules, leftmost and non-overlapping per kind."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        first = at
        while first > done and text[first - 1] in _LOCAL:
            first -= 1
        match = _DOMAIN.match(text, at) if first < at else None
        if match:
            done = match.end()
            found.append((0, first, done))
        at = text.find("@", max(at + 1, done))
    found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if _is_byte_list(m.group())]
    found += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if _is_card(m.group())]
    found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return found


# --- whole-span features ---------------------------------------------------

_CHECKS = (
    ("email", re.compile(r"[\w.%+-]+@[\w-]+(\.[\w-]+)+")),
    ("loose_email", re.compile(r"[\w.%+-]+\s*(@|\(at\)|\[at\])\s*[\w-]+(\.[\w-]+)*")),
    ("dotted4", re.compile(r"\d+(\.\d+){3}")),
    ("dotted", re.compile(r"\d+(\.\d+)+")),
    ("phone_groups", re.compile(r"(\+?\d{1,3}[ .-]?)?\(?\d{2,4}\)?([ .-]\d{2,4}){2,4}")),
    ("phone_paren", re.compile(r"(\+?\d{1,3} )?\(\d{2,4}\) ?\d{2,4}([ .-]\d{2,4})*")),
    ("four_by_four", re.compile(r"\d{4}([ -]?\d{4}){2,3}\d{0,3}")),
    ("hex", re.compile(r"[0-9a-f]{16,}")),
    ("upper_id", re.compile(r"[A-Z0-9]{16,}")),
    ("mixed_id", re.compile(r"[A-Za-z0-9_/+-]{20,}")),
    ("key_value", re.compile(r"(?i)(password|passwd|pwd|secret|token|api_?key|access_?key)\s*[=:]\s*\S{6,}")),
    ("value", re.compile(r"\w+=\S+")),
    ("integer", re.compile(r"\d+")),
    ("date", re.compile(r"\d{1,4}([/.-])\d{1,2}\1\d{1,4}")),
    ("money", re.compile(r"[$€£]?\d{1,3}([.,]\d{3})*([.,]\d{1,2})?[%$€£]?")),
)
_DOTTED = re.compile(r"[0-9]+(\.[0-9]+)*")
_CUE = re.compile(r"(?i)(password|passwd|pwd|secret|token|key)\W*$")
_DIGIT_STEPS = (0, 3, 6, 9, 13, 15, 16, 19)
FEATURES = (len(_CHECKS) + len(_DIGIT_STEPS) + 1 + MAX_TOKENS + 8)


def features(span: str, before: str, tokens: int) -> list[int]:
    """Numbers of the features that hold for a candidate segment."""
    core = span.strip(_EDGE) if not span.startswith("(") else span.strip("\"'`,;:.!?[]{}<>")
    digits = _digits(core)
    out = [i for i, (_, p) in enumerate(_CHECKS) if p.fullmatch(core)]
    at = len(_CHECKS)
    out.append(at + sum(len(digits) > s for s in _DIGIT_STEPS))
    at += len(_DIGIT_STEPS) + 1
    out.append(at + tokens - 1)
    at += MAX_TOKENS
    flags = (14 <= len(digits) <= 19 and luhn(digits), core.startswith("+"), bool(_CUE.search(before)),
             bool(digits) and any(c.isalpha() for c in core), bool(_DOTTED.fullmatch(core)) and _is_byte_list(core),
             "@" in core, len(core) >= 16, True)
    return out + [at + i for i, hold in enumerate(flags) if hold]


class SemiMarkov:
    """Weights of (kind, feature) and of (previous kind, kind)."""

    def __init__(self):
        self.weights = np.zeros((len(KINDS) + 1, FEATURES))
        self.steps = np.zeros((len(KINDS) + 2, len(KINDS) + 1))  # last row: start of a run

    def segments(self, text: str, tokens: list[tuple[int, int]]) -> dict[tuple[int, int], list[int]]:
        """Features of every candidate (first token, end token)."""
        before = text[max(0, tokens[0][0] - 24):tokens[0][0]]
        return {(i, j): features(text[tokens[i][0]:tokens[j - 1][1]],
                                 before if i == 0 else text[max(0, tokens[i][0] - 24):tokens[i][0]], j - i)
                for i in range(len(tokens)) for j in range(i + 1, min(i + MAX_TOKENS, len(tokens)) + 1)}

    def score(self, found: list[int], length: int) -> np.ndarray:
        s = self.weights[:, found].sum(axis=1)
        if length > 1:
            s[OUTSIDE] = -np.inf  # outside segments are single tokens
        return s

    def best(self, text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(kind, first token, end token) of the best segmentation's entities."""
        n = len(tokens)
        scores = {k: self.score(f, k[1] - k[0]) for k, f in self.segments(text, tokens).items()}
        value = np.full((n + 1, len(KINDS) + 2), -np.inf)
        value[0, -1] = 0.0
        back: list[list] = [[None] * (len(KINDS) + 1) for _ in range(n + 1)]
        for j in range(1, n + 1):
            for i in range(max(0, j - MAX_TOKENS), j):
                reach = value[i][:, None] + self.steps
                prev = reach.argmax(axis=0)
                total = reach.max(axis=0) + scores[i, j]
                for kind in np.flatnonzero(total > value[j, :-1]):
                    value[j, kind] = total[kind]
                    back[j][kind] = (i, int(prev[kind]))
        out, j, kind = [], n, int(value[n, :-1].argmax())
        while j:
            i, prev = back[j][kind]
            if kind != OUTSIDE:
                out.append((kind, i, j))
            j, kind = i, prev
        return out[::-1]

    def gradient(self, text: str, tokens: list, gold: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Of the log-likelihood of a full segmentation `gold` (kind, first, end)."""
        n, k = len(tokens), len(KINDS) + 1
        found = self.segments(text, tokens)
        scores = {key: self.score(f, key[1] - key[0]) for key, f in found.items()}
        alpha = np.full((n + 1, k + 1), -np.inf)
        alpha[0, -1] = 0.0
        entry = np.full((n + 1, k), -np.inf)  # paths that end at i and step to a kind
        for j in range(n + 1):
            if j:
                alpha[j, :k] = np.logaddexp.reduce([entry[i] + scores[i, j] for i in range(max(0, j - MAX_TOKENS), j)], axis=0)
            entry[j] = np.logaddexp.reduce(alpha[j][:, None] + self.steps, axis=0)
        beta = np.full((n + 1, k), -np.inf)
        beta[n] = 0.0
        for i in range(n - 1, 0, -1):
            leave = np.logaddexp.reduce([scores[i, j] + beta[j] for j in range(i + 1, min(i + MAX_TOKENS, n) + 1)], axis=0)
            beta[i] = np.logaddexp.reduce(self.steps[:-1] + leave, axis=1)
        total = np.logaddexp.reduce(alpha[n, :k])
        weights, steps = np.zeros_like(self.weights), np.zeros_like(self.steps)
        for (i, j), f in found.items():
            weights[:, f] -= np.exp(entry[i] + scores[i, j] + beta[j] - total)[:, None]
            steps -= np.exp(alpha[i][:, None] + self.steps + (scores[i, j] + beta[j])[None, :] - total)
        prev = -1
        for kind, i, j in gold:
            weights[kind, found[i, j]] += 1
            steps[prev, kind] += 1
            prev = kind
        return weights, steps

    def train(self, examples: list, rounds: int = 4, rate: float = 0.3, decay: float = 1e-3) -> SemiMarkov:
        seen_w, seen_s = np.full_like(self.weights, 1e-6), np.full_like(self.steps, 1e-6)
        order = random.Random(3)
        for _ in range(rounds):
            order.shuffle(examples)
            for text, tokens, gold in examples:
                w, s = self.gradient(text, tokens, gold)
                w, s = w - decay * self.weights, s - decay * self.steps
                seen_w += w * w
                seen_s += s * s
                self.weights += rate * w / np.sqrt(seen_w)
                self.steps += rate * s / np.sqrt(seen_s)
        return self


# --- runs and examples -----------------------------------------------------

def runs(text: str) -> list[list[tuple[int, int]]]:
    """Runs of neighbouring tokens that hold a digit or an at sign."""
    out: list[list[tuple[int, int]]] = []
    for match in _TRIGGER.finditer(text):
        first = match.start()
        while first and not text[first - 1].isspace():
            first -= 1
        if out and text[out[-1][-1][1]:first] in (" ", "\t", " "):
            out[-1].append((first, match.end()))
        else:
            out.append([(first, match.end())])
    return out


def _written(rng: random.Random) -> list[tuple[int, str]]:
    """Items (kind, words) of one example run, drawn from format rules."""

    def number(n: int) -> str:
        return str(rng.randint(1, 9)) + "".join(str(rng.randint(0, 9)) for _ in range(n - 1))

    def some(alphabet: str, n: int) -> str:
        return "".join(rng.choice(alphabet) for _ in range(n - 2)) + rng.choice("23456789") + rng.choice(alphabet)

    def card() -> str:
        body = number(rng.choice((14, 15, 15, 18)))
        full = next(body + str(d) for d in range(10) if luhn(body + str(d)))
        join = rng.choice(("", "", " ", "-"))
        return join.join(full[i:i + 4] for i in range(0, len(full), 4))

    def unchecked() -> str:  # as long as a card number, without its check digit
        body = number(rng.choice((13, 15, 15, 15, 18)))
        full = next(body + str(d) for d in rng.sample(range(10), 10) if not luhn(body + str(d)))
        join = rng.choice(("", "", " ", "-"))
        return join.join(full[i:i + 4] for i in range(0, len(full), 4))

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return rng.choice((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{number(2)} {number(2)} {number(4)} {number(4)}",
                           f"+1 {a} {b} {c}", f"{a} {b} {c}", f"+{number(11)}", f"{a}.{b}.{c}"))

    def secret() -> str:
        hexed, upper, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
        return rng.choice((some(hexed, rng.choice((32, 40, 64))), f'"{some(hexed, 40)}"', "AKIA" + some(upper, 16), some(upper, 20),
                           f"password={some(hexed, 18)}", f"token={some(mixed, 24)}", some(mixed, 36), f"secret:{some(mixed, 20)}"))

    plain = (lambda: number(rng.randint(1, 9)), lambda: f"{rng.randint(0, 20)}.{rng.randint(0, 20)}" + rng.choice(("", ".")),
             lambda: f"{rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}", lambda: str(rng.randint(1800, 2100)),
             lambda: f"{rng.randint(1, 28)}/{rng.randint(1, 12)}/{rng.randint(1990, 2030)}", lambda: f"${number(3)}.{rng.randint(10, 99)}",
             lambda: f"{number(2)}%", lambda: f"{rng.randint(0, 23)}:{rng.randint(10, 59)}", lambda: f"[{rng.randint(1, 99)}]",
             lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: f"{number(3)},{number(3)}",
             lambda: f"978-{number(1)}-{number(2)}-{number(6)}-{number(1)}", lambda: rng.choice(("H2O", "mp3", "@home", "v2", "4th", "B2B")),
             unchecked, unchecked, unchecked, unchecked, lambda: f"{number(4)}-{number(4)}", lambda: f"#{number(5)}", lambda: number(rng.choice((10, 12, 20, 24))))
    made = (lambda: f"{rng.choice(('ana', 'li.wei', 'j_r', 'bosbt'))}{rng.randint(0, 99)}@{rng.choice(('mail', 'post', 'web'))}{rng.randint(1, 9)}.{rng.choice(('example.com', 'org', 'co.uk'))}",
            lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)), card, phone, secret)
    items = []
    for _ in range(rng.choice((1, 1, 1, 2, 3))):
        kind = rng.choice((0, 1, 2, 3, 3, 4, 4, *[OUTSIDE] * 7))
        words = plain[rng.randrange(len(plain))]() if kind == OUTSIDE else made[kind]()
        items.append((kind, words + (rng.choice(",.;") if rng.random() < 0.15 else "")))
    return items


def written_examples(count: int = 360, seed: int = 11) -> list:
    rng, out = random.Random(seed), []
    while len(out) < count:
        items = _written(rng)
        before = rng.choice(("the ", "call ", "of ", "token = ", "from ", ""))
        text = before + " ".join(words for _, words in items)
        found = runs(text)
        if len(found) != 1 or sum(len(w.split()) for _, w in items) != len(found[0]):
            continue
        gold, at = [], 0
        for kind, words in items:
            size = len(words.split())
            gold += [(OUTSIDE, at + i, at + i + 1) for i in range(size)] if kind == OUTSIDE or size > MAX_TOKENS else [(kind, at, at + size)]
            at += size
        out.append((text, found[0], gold))
    return out


def corpus_examples(texts: list[str], count: int = 240) -> list:
    """Runs that the base rules explain: each token lies in one base span, or is a short plain number."""
    out = []
    for text in texts:
        spans = sorted(base_spans(text), key=lambda s: s[1])
        for run in runs(text):
            if len(run) > 12:
                continue
            gold, at = [], 0
            while at < len(run):
                inside = [s for s in spans if s[1] < run[at][1] and s[2] > run[at][0]]
                if not inside and run[at][1] - run[at][0] <= 8:
                    gold.append((OUTSIDE, at, at + 1))
                    at += 1
                    continue
                if len(inside) != 1:
                    break
                end = at
                while end < len(run) and run[end][0] < inside[0][2]:
                    end += 1
                if end - at > MAX_TOKENS:
                    break
                gold.append((inside[0][0], at, end))
                at = end
            if at == len(run):
                out.append((text, run, gold))
                if len(out) == count:
                    return out
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 200,
        longest: int = 20_000) -> SemiMarkov:
    """Train on written examples and on at most `sample_rows` texts of at
    most `longest` characters that hold a digit or at sign (lowest hashes)."""
    held = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).where(
        F.col("t").rlike("[0-9@]") & (F.length("t") <= longest))
    rows = hashed_sample(held, sample_rows, "id", "t").collect()
    return SemiMarkov().train(written_examples() + corpus_examples([r.t for r in rows]))


# --- finding and masking ---------------------------------------------------

def find(text: str | None, model: SemiMarkov) -> list[dict]:
    """All spans: base ones, and the model's that overlap none of them."""
    if not text or not _TRIGGER.search(text):
        return []
    spans = [(first, kind, end, True) for kind, first, end in base_spans(text)]
    taken = sorted((first, end) for first, _, end, _ in spans)
    at = 0
    for run in runs(text):
        while at < len(taken) and taken[at][1] <= run[0][0]:
            at += 1
        for kind, i, j in model.best(text, run):
            first, end = run[i][0], run[j - 1][1]
            core = text[first:end].lstrip("\"'`,;:.!?[]{}<>").rstrip(_EDGE)
            first = text.index(core, first) if core else first
            end = first + len(core)
            near = at
            while near < len(taken) and taken[near][1] <= first:
                near += 1
            if core and (near == len(taken) or taken[near][0] >= end):
                spans.append((first, kind, end, False))
    return [{"kind": kind, "first": first, "end": end, "base": base} for first, kind, end, base in sorted(spans)]


def span_column(model: SemiMarkov, text_col: str = "text") -> Column:
    """The spans of each text, by start and kind."""

    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([find(t, model) for t in texts], dtype=object)

    return spans.asNondeterministic()(F.col(text_col).cast("string"))


def base_count(spans: Column, kind: int) -> Column:
    """How many base spans are of a kind. The function has one argument: a
    second one, even with a default, would be given the span's position."""
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("bigint")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["first"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def masked(text: str | None, model: SemiMarkov) -> str | None:
    """The text with every span, or union of overlapping ones, written as its first kind."""
    spans = find(text, model)
    if not spans:
        return text
    out, done = [], 0
    for s in spans:
        if s["first"] >= done:
            out += [text[done:s["first"]], f"<{KINDS[s['kind']].upper()}>"]
        done = max(done, s["end"])
    return "".join(out) + text[done:]


def mask_documents(docs: DataFrame, model: SemiMarkov, text_col: str = "text") -> DataFrame:
    """`docs` with the spans in `text_col` masked."""

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return pd.Series([masked(t, model) for t in texts], dtype=object)

    return docs.withColumn(text_col, mask.asNondeterministic()(F.col(text_col).cast("string")))
