"""Clone reports and the chain from pages to classified pairs, against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from treeloom.operators import clones, imports, trees
from treeloom.runtime import Scratch

PAIRS = "id1 long, id2 long, similarity double, pair_type int"


def test_statistics_count_each_place_once(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9, 1), (2, 3, 0.7, 3), (1, 3, 0.8, 3)], PAIRS)
    members = spark.createDataFrame([(1, 1), (1, 2), (7, 7), (7, 8)], "group_id long, id long")
    row = clones.statistics(pairs, members).first()
    assert (row["pairs"], row["groups"], row["clones"], row["type1"], row["type2"], row["type3"]) == (3, 2, 5, 1, 0, 2)
    assert row["average_similarity"] == pytest.approx(0.8)
    none = clones.statistics(pairs.limit(0), members.limit(0)).first()
    assert (none["pairs"], none["clones"], none["average_similarity"]) == (0, 0, 0.0)


def test_clones_by_file_prefers_groups(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9, 1), (2, 3, 0.7, 3)], PAIRS)
    items = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b")], "id long, file_path string")
    members = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 4)], "group_id long, id long")
    got = lambda m: {r["file_path"]: r["clones"] for r in clones.clones_by_file(pairs, m, items).collect()}
    assert got(members) == {"a": 3, "b": 1} and got(members.limit(0)) == {"a": 2, "b": 1}


def test_duplication_percent(spark):
    rows = spark.createDataFrame([(3, 12), (0, 5), (4, 0)], "c long, f long")
    assert [r[0] for r in rows.select(clones.duplication_percent(F.col("c"), F.col("f"))).collect()] == [25.0, 0.0, 0.0]


def test_verified_pairs_find_all_copies_and_near_copies(spark):
    r = random.Random(4)
    page = lambda tags: "<html>" + "".join(f"<{t}>{r.randint(0, 99)}</{t}>" for t in tags) + "</html>"
    base = [[r.choice(["p", "div", "ul", "h1", "h2", "table", "b", "i"]) for _ in range(30)] for _ in range(6)]
    rows = [(i, page(t)) for i, t in enumerate(base)]
    rows += [(10 + i, page(t[:7] + ["span"] + t[8:])) for i, t in enumerate(base)]
    rows += [(20, rows[0][1]), (21, page(base[0])), (30, None), (None, rows[1][1])]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    got = {(x["id1"], x["id2"]): x for x in clones.verified_pairs(pages, Scratch(spark), patterns=["table"]).collect()}
    assert got[0, 20]["pair_type"] == 1 and got[0, 20]["similarity"] == 1.0
    assert got[0, 21]["pair_type"] == 2 and got[0, 21]["distance"] == 0.0
    html = dict(x for x in rows if x[0] is not None)
    for i in range(6):
        row = got[i, 10 + i]
        a, b = (trees.post_order(*trees.parse_html(html[j])[:2]) for j in (i, 10 + i))
        assert row["distance"] == trees.edit_distance(*a, *b) == 1.0 and row["pair_type"] in (2, 3)
    assert not any(30 in k for k in got)


def test_pattern_features(spark):
    rows = spark.createDataFrame([(1, "If(x)"), (1, "If"), (1, "For"), (2, "While")], "tree_id long, label string")
    assert {tuple(r) for r in clones.pattern_features(rows, ["If", "While", "Try"]).collect()} == {(1, "pattern:If"), (2, "pattern:While")}


def test_reserved_exports_are_not_unused(spark):
    rows = [("src/app/page.tsx", "default"), ("src/app/page.tsx", "helper"), ("src/app/route.ts", "GET"), ("src/app/page.tsx", "GET"), ("lib/page.tsx", "default"), ("src/Main.ts", "x"), ("src/main.ts", "x"), ("src/a.test", "x")]
    exports = spark.createDataFrame([(a, b, "named", "function") for a, b in rows], "file_path string, name string, kind string, declaration string")
    none = spark.createDataFrame([], "file_path string, name string")
    got = {tuple(r) for r in imports.unused_exports(exports, none).select("file_path", "name").collect()}
    assert got == {("src/app/page.tsx", "helper"), ("src/app/page.tsx", "GET"), ("lib/page.tsx", "default"), ("src/Main.ts", "x")}
