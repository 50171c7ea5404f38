"""Small tables for the operator tests."""

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, texts, schema=DOC_SCHEMA, first=0):
    """A documents table from texts, or (doc_id, text) pairs."""
    rows = [t if isinstance(t, tuple) else (first + i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], schema)


def clashing(df):
    """The same table with extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = ("fp", "component_id", "hits", "spans", "size", "shard", "slot", "split", "row", "bundle", "own", "w", "t", "s", "h",
             "id", "score", "word", "c", "known", "first", "end", "runs", "k", "high", "low", "value", "digest", "text_hash", "n_words", "_hits", "_score")
    return df.withColumns({n: F.lit("x") for n in names if n not in df.columns})


ODD_TEXTS = [None, "", " ", "\n\n", "a", "A a\ta", "x" * 200_000, "word " * 30_000, "é ü 漢字     z", "a\x00b c", "same text here", "same text here",
             "." * 300_000, " " * 1_200_000 + "b", "\u3000" * 1_200_000]
