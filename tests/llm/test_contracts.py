"""The registered queries against SQL or brute force on small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pandas as pd
import pytest

from treeloom.llm import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(name, same):
    same(QUERIES[name], SQL[name])


@pytest.fixture(scope="session")
def docs(small):
    return pd.read_parquet(f"{small}/documents.parquet")


def low(text):
    return (text or "").encode().lower().decode()


def test_secrets_against_brute_force(spark, small, docs):
    got = QUERIES["op6_secret_scan"](spark, small).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    for i, text in zip(docs.doc_id, docs.text):
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
        line = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        row = got.loc[i]
        assert row["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert (row["n_assign"], row["n_access"], row["n_hex"]) == tuple(sum(k == j for _, k, _ in spans) for j in range(3))
        assert set(filter(None, line.split(","))) <= set(row["spans"].split(","))


def test_base_scores_against_brute_force(spark, small, docs):
    got = QUERIES["op8_lm_scoring"](spark, small).toPandas().set_index("doc_id")
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs.doc_id}
    tokens = {i: [*low(t).encode().split(), 0] for i, t in zip(docs.doc_id, docs.text)}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        row = got.loc[i]
        want = sum(math.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"]) == (held[i], len(ws), sum(w in counts for w in ws), n)
        assert row["base_score"] == pytest.approx(want, rel=1e-9) and row["score"] < 0


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    got = QUERIES["op5_toxicity"](spark, d).toPandas().merge(pd.read_parquet(f"{d}/labels.parquet"), on="doc_id")
    held = got[got.held_out]
    assert held.score.between(0, 1).all() and ((held.score >= 0.7) == (held.predicted == 1)).all()
    assert (held.predicted == held.toxic).mean() > 0.97
    assert held[(held.toxic == 0)].predicted.mean() < 0.01


def test_quality_on_labelled_rows(spark):
    d = "/root/testdata/sf0.1"
    got = QUERIES["op10_quality"](spark, d).toPandas().merge(pd.read_parquet(f"{d}/labels.parquet"), on="doc_id")
    assert got[got.quality == 1].accepted.mean() > 0.995
    assert got[got.quality == 0].accepted.mean() < 0.02
