"""Literal expectations of functions and scores."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from treeloom.functions import scoring as S
from treeloom.functions import sets, text
from treeloom.operators import classify


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def arr(*xs):
    return F.array(*map(F.lit, xs)).cast("array<string>")


@pytest.mark.parametrize("a,b,want", [((), (), 1), (("a",), (), 0), (("a", "b"), ("a", "b"), 1), (("a", "b"), ("c", "d"), 0), (("a", "b"), ("b", "c"), 1 / 3), (("a", "a", "b"), ("a", "b", "b"), 1), (("b", "a"), ("a", "b"), 1)])
def test_jaccard(spark, a, b, want):
    assert one(spark, x=sets.jaccard(arr(*a), arr(*b)))["x"] == pytest.approx(want)


def test_linear_penalty(spark):
    cases = [(1, 2, 15, 0), (15, 2, 15, 20), (100, 2, 15, 20), (8.5, 2, 15, 10), (5, 2, 2, 20)]
    got = one(spark, **{f"c{i}": S.whole(S.linear_penalty(F.lit(float(v)), s, t)) for i, (v, s, t, _) in enumerate(cases)})
    assert list(got) == [w for *_, w in cases]


def test_penalties(spark):
    lit = lambda x: F.lit(x)
    got = one(
        spark,
        dup=S.duplication_penalty(lit(15.0)),
        dup_most=S.duplication_penalty(lit(90.0)),
        parse=S.parse_error_penalty(lit(1), lit(500)),
        parse_all=S.parse_error_penalty(lit(20), lit(10)),
        parse_none=S.parse_error_penalty(lit(5), lit(0)),
        coupling=S.coupling_penalty(lit(1), lit(2), lit(10)),
        cycles=S.dependency_penalty(lit(1000), lit(3), lit(3), lit(0.0)),
        deep=S.dependency_penalty(lit(100), lit(0), lit(20), lit(0.0)),
        far=S.dependency_penalty(lit(100), lit(0), lit(0), lit(1.0)),
        all=S.dependency_penalty(lit(10), lit(10), lit(50), lit(1.0)),
        arch=S.architecture_penalty(lit(0.5)),
        over=S.architecture_penalty(lit(2.0)),
    )
    assert got.asDict() == dict(dup=10, dup_most=20, parse=11, parse_all=56, parse_none=0, coupling=8, cycles=2, deep=3, far=3, all=16, arch=6, over=0)


def test_textual_similarity_counts_bytes(spark):
    got = one(spark, d=text.byte_levenshtein(F.lit("é"), F.lit("e")), both=text.textual_similarity(F.lit(""), F.lit("")), one=text.textual_similarity(F.lit(""), F.lit("a")), empty=text.exact_match(F.lit(""), F.lit("")))
    assert got.asDict() == dict(d=2, both=1.0, one=0.0, empty=False)


def test_normalisation(spark):
    rows = spark.createDataFrame([("  return a  +  b ; ",), ("x = 'a  b'  + c",), ("// c\nlet s = 'http://x'; /* y */ z",)], "t string")
    plain = [r[0] for r in rows.select(text.normalize_plain(F.col("t"))).collect()]
    assert plain[0] == "return a+b;"
    quoted = [r[0] for r in rows.select(text.normalize_quoted(F.col("t"))).collect()]
    assert quoted[:2] == ["return a+b;", "x='a  b'+c"]
    bare = [r[0] for r in rows.select(text.strip_comments(F.col("t"))).collect()]
    assert bare[2] == "\nlet s = 'http://x';  z"


@pytest.mark.parametrize("glob,path,hit", [("*.ts", "a.ts", True), ("*.ts", "a.tsx", False), ("a[", "a[", False), ("?.js", "x.js", True)])
def test_glob(spark, glob, path, hit):
    assert one(spark, x=text.matches_any(F.lit(path), [glob]))["x"] is hit


@pytest.mark.parametrize("glob,path,hit", [("node_modules", "src/node_modules/x.js", True), ("src/**/test", "src/a/b/test/x.js", True), ("src/**/test", "src/test/x.js", True), ("dist/*.js", "pkg/dist/a.js", True), ("dist/*.js", "distant/a.js", False)])
def test_path_glob(spark, glob, path, hit):
    assert one(spark, x=text.matches_any(F.lit(path), [glob], text.path_glob_regex))["x"] is hit


def test_count_bins(spark):
    ns = [0, 1, 2, 3, 4, 7, 8, 15, 16, 100]
    got = one(spark, **{f"n{n}": text.count_bin(F.lit(n)) for n in ns})
    assert list(got) == ["1", "1", "2-3", "2-3", "4-7", "4-7", "8-15", "8-15", "16+", "16+"]


def test_classifier(spark):
    t = classify.Thresholds(0.95, 0.85, 0.80, 0.75)
    lit = F.lit
    kind = lambda s, same, syn, **k: classify.classify(lit(s), lit(same), lit(syn), t, **k)
    got = one(spark, a=kind(0.99, True, 1.0)[0], b=kind(0.99, False, 1.0)[0], bv=kind(0.99, False, 1.0)[1], c=kind(0.90, False, 0.0)[0], d=kind(0.99, False, 6 / 7)[1], e=kind(0.82, False, 0.0)[0], f=kind(0.76, False, 0.0)[0], g=kind(0.5, False, 0.0)[0], h=kind(0.99, True, 1.0, enabled=(4,))[0])
    assert (got["a"], got["b"], got["c"], got["e"], got["f"], got["g"], got["h"]) == (1, 2, 3, 3, 4, 0, 4)
    assert got["bv"] < 0.95 and got["d"] == pytest.approx(6 / 7)


def test_size_filter_and_confidence(spark):
    lit = F.lit
    got = one(spark, near=classify.comparable(lit(100), lit(110), lit(20), lit(22)), far=classify.comparable(lit(100), lit(300), lit(20), lit(21)), lines=classify.comparable(lit(100), lit(105), lit(20), lit(60)), c=classify.confidence(lit(0.99), lit(500), lit(500), lit(10), lit(10)))
    assert (got["near"], got["far"], got["lines"], got["c"]) == (True, False, False, 1.0)


def test_semantic_evidence(spark):
    def value(strong, other, ret, oret, lits, olits, base=1.0):
        return one(spark, x=sets.semantic_evidence(F.lit(base), arr(*strong), arr(*other), arr(*ret), arr(*oret), arr(*lits), arr(*olits)))["x"]

    assert value("a", "a", "", "", "", "") == 1.0
    assert value("a", "b", "", "", "", "") == 0.75
    assert value("", "b", "", "", "", "", 0.9) == 0.9
    assert value("", "", "a", "b", "", "") == 0.75
    assert value("", "", "", "", "ab", "cd") == 0.5
    assert value("", "", "", "", "a", "cd") == 1.0
    assert value("a", "b", "", "", "", "", 0.0) == 0.0


def test_count_similarity(spark):
    got = one(spark, a=sets.count_similarity(F.lit(0), F.lit(0)), b=sets.count_similarity(F.lit(5), F.lit(5)), c=sets.count_similarity(F.lit(10), F.lit(0)), d=sets.count_similarity(F.lit(10), F.lit(5)))
    assert list(got) == [1, 1, 0, 0.5]
