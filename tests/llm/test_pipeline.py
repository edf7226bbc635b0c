"""The corpus pipeline, stage by stage, on planted documents."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


@pytest.fixture(scope="module")
def planted(spark, small):
    r = random.Random(8)
    bench = spark.read.parquet(f"{small}/benchmark.parquet").first()["text"]
    prose = lambda: " ".join(r.choice(["thion", "and", "the", "wher", "ering", "onth", "hat", "ses", "in", "of", "lyed"]) + str(r.randint(0, 99) if r.random() < 0.05 else "") for _ in range(200))
    clean = [prose() for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(clean)]
    rows += [(100, clean[0]), (101, clean[1] + " tail"), (102, prose() + " " + bench), (103, prose() + " password=ab12cd34ef56 end"), (104, None), (105, ""), (None, "no id here")]
    return spark.createDataFrame([(i, t, "en", "src1", len(t or ""), "x") for i, t in rows], DOC)


def test_stages_keep_columns_and_clean_documents(spark, small, planted):
    docs = planted
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, small)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        ids = {r[0] for r in out.select("doc_id").collect()}
        assert set(range(20)) <= ids, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert not ids & {100, 101, 102} and {103, 104, 105, None} <= ids
    row = docs.where("doc_id = 103").first()
    assert row["text"].endswith("<secret> end") and row["n_chars"] == len(row["text"]) and row["extra"] == "x"
    last = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert last.count() <= docs.count() and set(docs.columns) <= set(last.columns)


def test_stages_on_an_empty_table(spark, small, planted):
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, planted.limit(0), small).count() == 0


def test_run(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = corpus_pipeline.run(spark, small)
    assert 0 < out.count() <= docs.count() and out.select("doc_id").distinct().count() == out.count()
