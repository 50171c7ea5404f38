"""Quality rules: a threshold table compiled into Spark projections.

Every measure is a count built from functions on the text's own words and
lines, every rule compares two counts in whole numbers, and the table is
compiled into one Boolean column. No user functions, no shuffle, and the
work on a text grows as n log n in its words.

Repeated 3-word windows: when a text's windows are not all different they
are sorted together with their positions; a window equal to its neighbour
is a repeat, and the words covered follow from the sorted positions.

Defined cases: a null or empty text has no words and fails the base rule;
each row is judged alone, so repeated rows get equal verdicts.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frequent function words of the corpus languages.
STOP_WORDS = {
    "en": "the of and to in is that was for on with as it by be this are from or an at a he".split(),
    "fr": "le la les de des du un une et en est que qui dans pour par sur pas au avec ce il ne".split(),
    "de": "der die das und in zu den von mit ist des im für auf nicht ein eine als auch es an dem sich".split(),
    "es": "el la los las de del que y en un una por con para es no se su al lo como más".split(),
}


class Rule(NamedTuple):
    """Kept texts have low <= 100 * count / of <= high (None: no bound);
    texts whose `of` is 0 pass."""

    name: str
    count: str
    of: str
    low: int | None
    high: int | None


# The threshold table, in percent.
RULES = (
    Rule("word_length", "word_chars", "n_words", 200, 1500),
    Rule("symbols", "n_symbols", "n_words", None, 30),
    Rule("stop_words", "n_stop_words", "n_words", 2, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 50),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 30),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 90),
)

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def _size(c: Column) -> Column:
    return F.size(c).cast("bigint")


def measures(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns and one column per measure."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = [F.col(c).alias(f"k_{c}") for c in keep]
    names = [F.col(f"k_{c}") for c in keep]
    # array columns are used several times below, so the optimizer keeps each stage's value
    split = docs.select(*kept, text.alias("t")).select(
        *names, "t", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("w"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    n = F.size("w")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.concat_ws(
        " ", F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<string>"))
    stop = sorted({w for words in STOP_WORDS.values() for w in words})
    counted = split.select(
        *names, windows.alias("win"),
        n.cast("bigint").alias("n_words"),
        F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("bigint").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        _size(F.filter("w", lambda x: F.lower(x).isin(stop))).alias("n_stop_words"),
        _size(F.col("lines")).alias("n_lines"),
        (_size(F.col("lines")) - _size(F.array_distinct("lines"))).alias("n_dup_lines"),
        _size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)\s*$"))).alias("n_ellipsis_lines"),
        _size(F.filter("lines", lambda x: x.rlike(r"^\s*[-•*]\s"))).alias("n_bullet_lines"))
    numbers = [c for c in counted.columns if c != "win" and not c.startswith("k_")]
    # a window and its position as one text: words hold no spaces, so equal windows sort together
    order = F.when(F.size(F.array_distinct("win")) < F.size("win"), F.sort_array(F.transform(
        "win", lambda x, i: F.concat(x, F.lit(" "), F.lpad(i.cast("string"), 10, "0")))))
    ordered = counted.select(*names, *numbers, order.alias("o"))
    prefixed = ordered.select(*names, *numbers, "o", F.transform("o", lambda x: F.substring_index(x, " ", 3)).alias("p"))
    m = F.size("p")
    zipped = F.arrays_zip(F.col("o").alias("o"), F.col("p").alias("p"),
                          F.concat(F.array(F.lit(None).cast("string")), F.slice("p", 1, F.greatest(m - 1, F.lit(0)))).alias("before"),
                          F.slice("p", 2, F.greatest(m - 1, F.lit(0))).alias("after"))
    repeats = F.sort_array(F.transform(
        F.filter(zipped, lambda z: z["p"].eqNullSafe(z["before"]) | z["p"].eqNullSafe(z["after"])),
        lambda z: F.substring_index(z["o"], " ", -1).cast("int")))
    found = prefixed.select(*names, *numbers, repeats.alias("r"))
    k = F.size("r")
    steps = F.zip_with(F.slice("r", 2, F.greatest(k - 1, F.lit(0))), F.slice("r", 1, F.greatest(k - 1, F.lit(0))),
                       lambda later, sooner: F.least(F.lit(3), later - sooner))
    covered = F.when(k > 0, 3 + F.aggregate(steps, F.lit(0), lambda a, b: a + b)).otherwise(0)
    return found.select(*(F.col(f"k_{c}").alias(c) for c in keep), *numbers, covered.cast("bigint").alias("n_repeat_words"))


def passes(rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one Boolean column over the measures."""
    verdict = F.lit(True)
    for r in rules:
        part = 100 * F.col(r.count)
        if r.low is not None:
            verdict = verdict & (part >= r.low * F.col(r.of))
        if r.high is not None:
            verdict = verdict & (part <= r.high * F.col(r.of))
    return verdict


def judge(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
          rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measures with base_failed and kept."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measures(docs, text_col, keep).withColumn("base_failed", base).withColumn(
        "kept", ~F.col("base_failed") & passes(rules))
