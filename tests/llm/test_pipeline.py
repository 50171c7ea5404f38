"""The pipeline against plain versions of its stages, and the queries' SQL."""

import pytest
from llm_cases import ODD_TEXTS, documents
from oracle_harness import compare, duck_connection
from pyspark.sql import functions as F
from test_decontam import plain_hits
from test_simhash import plain_components, plain_fingerprint

import corpus_pipeline
from tallyfold.llm import packing, pii, quality, queries, tokens

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with junk, copies, benchmark passages, personal data and odd rows."""
    path = str(tmp_path_factory.mktemp("corpus"))
    passage = " ".join(f"bench{i}" for i in range(15))
    good = [" ".join(f"{w}{i * k % 89}" for k, w in enumerate(("river", "stone", "light", "house", "of", "the") * 15)) for i in range(1, 60)]
    junk = ["NOISE!! " * 80 + f"{i}" for i in range(25)]
    texts = [*good, *junk, good[0], good[1] + " tail", good[3] + " " + passage, good[4].replace("river", "sea") + " ann@example.org", *ODD_TEXTS]
    documents(spark, texts).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 59), 0) for i in range(84)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r for r in docs.collect()}
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = {i: r.text for i, r in texts.items() if model.score(r.text.encode() if r.text is not None else None, r.n_chars) >= 0.3}
    assert set(range(59)) <= set(kept) and not set(range(59, 84)) & set(kept)
    groups = plain_components({i: plain_fingerprint(t) for i, t in kept.items()})
    kept = {i: t for i, t in kept.items() if groups[i] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    kept = {i: t for i, t in kept.items() if not plain_hits(t, items, 10)[1]}
    assert 86 not in kept and 0 in kept and 84 not in kept
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} == set(kept)
    finder = pii.SemiMarkov().train(pii.written_examples())
    encode = tokens.load_encoder(tokens.vocabulary_path())
    lengths = {}
    for r in rows:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    for i, t in kept.items():
        masked = pii.masked(t, finder)
        assert lengths[i] == len(encode(masked or "")) + 1
    assert "<EMAIL>" in pii.masked(kept[87], finder)


def test_stage_contract(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("extra", F.lit(1))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert out.dtypes == docs.dtypes
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0, name


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    found = compare(queries.QUERIES[name](spark, SMALL), queries.ORACLE[name], duck_connection(SMALL))
    assert found["hash_match"], found


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE) - {"op12_whitening"}))   # that one reads vectors
def test_queries_return_every_document(spark, name):
    out = queries.QUERIES[name](spark, SMALL)
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert ids == {r.doc_id for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id").collect()}


def test_packing_of_the_given_documents(spark):
    pieces = packing.pack_documents(spark.read.parquet(f"{SMALL}/documents.parquet"), tokens.vocabulary_path())
    total = pieces.agg(F.sum("length"), F.countDistinct("sequence_id")).first()
    assert total[1] >= total[0] / 2048
