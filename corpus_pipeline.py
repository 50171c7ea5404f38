"""Corpus pipeline: documents -> quality -> near duplicates -> benchmark -> personal data -> sequences.

Every stage is (name, function of (spark, docs, sf_dir)) and works on all
rows that its predecessor kept; its result is written as Parquet in the
shared folder (`spark.checkpoint.dir`) and read again for the next one, so
a lost executor costs at most the running stage. All stages but the last
return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import decontam, packing, pii, quality, simhash
from tallyfold.llm.common import stored
from tallyfold.llm.queries import read
from tallyfold.llm.tokens import vocabulary_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.accepted(docs, read(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, that with the smallest doc_id."""
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontam.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become placeholders; n_chars follows the text."""
    masked = pii.mask_documents(docs, pii.fit(docs))
    return masked.withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids."""
    return packing.pack_documents(docs, vocabulary_path())


STAGES = [
    ("quality classifier", good_quality),
    ("near duplicates", one_of_each),
    ("benchmark decontamination", decontaminated),
    ("personal data", without_personal_data),
    ("best-fit packing", packed),
]

# Trained models, fingerprints and token ids are beyond SQL; tests/llm holds
# every stage's result against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents under `sf_dir`."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
