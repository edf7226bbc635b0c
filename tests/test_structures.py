"""Clusters, graphs, flow, trees and imports on small cases with known answers."""

from __future__ import annotations

import itertools
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from treeloom.operators import flow, graph, grouping, imports, lsh, metrics, stats, trees
from treeloom.runtime import Scratch


def pairs_of(spark, rows):
    return spark.createDataFrame([(a, b, s, 1) for a, b, s in rows], "id1 long, id2 long, similarity double, pair_type int")


def items_of(spark, ids):
    return spark.createDataFrame([(i, f"{i:03d}", 1, 10, 0, 0) for i in ids], "id long, file_path string, start_line int, end_line int, start_col int, end_col int")


def groups_of(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r["group_id"], set()).add(r["id"])
    return sorted(map(sorted, out.values()))


TRIANGLE = [(1, 2, 0.9), (2, 3, 0.9), (1, 3, 0.9)]


@pytest.mark.parametrize(
    "mode,rows,threshold,want",
    [
        ("connected", [(1, 2, 0.9), (3, 4, 0.85)], 0.8, [[1, 2], [3, 4]]),
        ("k_core", TRIANGLE, 0.8, [[1, 2, 3]]),
        ("k_core", [(1, 2, 0.9), (2, 3, 0.9), (2, 4, 0.9), (3, 4, 0.9)], 0.8, [[2, 3, 4]]),
        ("star", [(1, 2, 0.9), (2, 3, 0.95), (1, 3, 0.75)], 0.7, [[1, 2, 3]]),
        ("complete_linkage", TRIANGLE, 0.8, [[1, 2, 3]]),
        ("complete_linkage", [(1, 2, 0.9), (2, 3, 0.9)], 0.8, [[1, 2]]),
        ("centroid", [(1, 2, 0.9), (2, 3, 0.9), (1, 3, 0.5)], 0.8, [[1, 2]]),
        ("centroid", [(1, 2, 0.9), (2, 3, 0.9), (1, 3, 0.85)], 0.8, [[1, 2, 3]]),
    ],
)
def test_grouping(spark, mode, rows, threshold, want):
    ids = sorted({i for a, b, _ in rows for i in (a, b)})
    assert groups_of(grouping.group(mode, pairs_of(spark, rows), items_of(spark, ids), threshold, Scratch(spark))) == want


def test_complete_linkage_groups_are_cliques(spark):
    r = random.Random(4)
    rows = [(a, b, r.choice([0.7, 0.82, 0.9, 0.95])) for a, b in itertools.combinations(range(12), 2)]
    strong = {(a, b) for a, b, s in rows if s >= 0.8}
    for g in groups_of(grouping.complete_linkage(pairs_of(spark, rows), items_of(spark, range(12)), 0.8, Scratch(spark))):
        assert all(p in strong for p in itertools.combinations(g, 2))


def covers(spark, groups):
    """Survivors among groups of (similarity, [(file, start, end)])."""
    rows, meta, items = [], [], []
    for g, (s, spans) in enumerate(groups, 1):
        meta.append((g, s))
        for f, a, b in spans:
            rows.append((g, len(items)))
            items.append((len(items), f, a, b, 0, 0))
    frame = grouping.uncovered_groups(
        spark.createDataFrame(rows, "group_id long, id long"), spark.createDataFrame(meta, "group_id long, similarity double"), spark.createDataFrame(items, "id long, file_path string, start_line int, end_line int, start_col int, end_col int"), Scratch(spark)
    )
    return sorted(r["group_id"] for r in frame.collect())


@pytest.mark.parametrize(
    "groups,want",
    [
        ([(0.9692, [("s", 299, 315), ("s", 318, 334)]), (0.9613, [("s", 298, 315), ("s", 317, 334)])], [2]),
        ([(0.9, [("x", 1, 10), ("y", 1, 10)]), (0.9, [("x", 1, 10), ("y", 1, 10)])], [1]),
        ([(0.9, [("x", 2, 9), ("z", 1, 8)]), (0.9, [("x", 1, 10), ("y", 1, 10)])], [1, 2]),
        ([(0.9, [("x", 10, 20), ("x", 30, 40)]), (0.9, [("x", 1, 100), ("y", 1, 100)])], [1, 2]),
        ([(0.95, [("x", 2, 5), ("y", 2, 5)]), (0.65, [("x", 1, 6), ("y", 1, 6)])], [1, 2]),
        ([(0.90, [("x", 3, 8), ("y", 3, 8)]), (0.86, [("x", 2, 9), ("y", 2, 9)]), (0.82, [("x", 1, 10), ("y", 1, 10)])], [1, 3]),
    ],
)
def test_covered_groups(spark, groups, want):
    assert covers(spark, groups) == want


def test_maximal_members(spark):
    g = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "group_id long, id long")
    items = spark.createDataFrame([(0, "x", 512, 542, 0, 0), (1, "x", 515, 542, 0, 0), (2, "y", 1, 30, 0, 0)], "id long, file_path string, start_line int, end_line int, start_col int, end_col int")
    assert groups_of(grouping.maximal_members(g, items)) == [[0, 2]]


def _first_merges(frame, threshold):
    """Complete linkage as it is defined: the most similar pair of clusters, the first of equals, until none is left."""
    place = {**dict(zip(frame.id1, frame.place1)), **dict(zip(frame.id2, frame.place2))}
    s = {(a, b): v for x, y, v in zip(frame.id1, frame.id2, frame.similarity) for a, b in ((x, y), (y, x))}
    clusters = [[i] for i in sorted(place, key=place.get)]
    while True:
        least = {(a, b): min(s.get((x, y), -1.0) for x in clusters[a] for y in clusters[b]) for a in range(len(clusters)) for b in range(a)}
        best = min(((-v, b, a) for (a, b), v in least.items() if v >= threshold), default=None)
        if best is None:
            return sorted(sorted(c) for c in clusters)
        clusters[best[1]] += clusters.pop(best[2])


def test_complete_linkage_merges_as_defined_dense_or_sparse(monkeypatch):
    r = np.random.default_rng(4)
    for share in (0.2, 0.6, 1.0):
        edges = np.array([(i, j) for i in range(16) for j in range(i + 1, 16) if r.random() < share])
        place = r.permutation(16)
        frame = pd.DataFrame({"id1": edges[:, 0], "id2": edges[:, 1], "place1": place[edges[:, 0]], "place2": place[edges[:, 1]], "similarity": r.choice([0.7, 0.8, 0.9, 0.95], len(edges))})
        for cells in (0, 1 << 30):
            monkeypatch.setattr(grouping, "CELLS", cells)
            groups = {}
            for i, o in grouping._complete(frame, 0.8).items():
                groups.setdefault(o, []).append(i)
            assert sorted(sorted(g) for g in groups.values()) == _first_merges(frame, 0.8)


def test_large_components_and_clusters_end_in_seconds():
    n = 900
    a, b = np.triu_indices(n, 1)
    frame = pd.DataFrame({"id1": a, "id2": b, "place1": a, "place2": b, "similarity": 0.5 + (a * 31 + b * 17) % 50 / 100})
    began = time.perf_counter()
    whole = grouping._complete(frame, 0.5)  # before: every merge went through all pairs in Python, minutes
    assert set(whole.values()) == {0} and time.perf_counter() - began < 15
    # 4,000 groups of two in one file; every tenth lies inside the one before. Before: every two groups were matched, minutes
    g = np.repeat(np.arange(4000), 2)
    start = 10 * (g - (g % 10 == 9)) + (g % 10 == 9) + 5 * (np.arange(8000) % 2)
    cluster = pd.DataFrame({"group_id": g, "file_path": "f", "start_line": start, "end_line": start + 4 - 2 * (g % 10 == 9), "start_col": 0, "end_col": 0, "similarity": 0.9})
    began = time.perf_counter()
    assert sorted(grouping._kept(cluster)) == [x for x in range(4000) if x % 10 != 9] and time.perf_counter() - began < 15
    both = pd.concat([cluster[cluster.group_id < 2], cluster[cluster.group_id == 0].assign(group_id=7)])
    assert grouping._kept(both) == [0, 1]  # of groups that cover each other the first stays

def edges_of(spark, text):
    return spark.createDataFrame([tuple(map(int, e.split("-"))) for e in text.split()], "src long, dst long")


@pytest.mark.parametrize("text,want", [("1-2 2-1 3-4 4-3 2-3", [[1, 2], [3, 4]]), ("1-1", []), ("1-2 2-3 3-4 4-5 5-1", [[1, 2, 3, 4, 5]]), ("1-2 2-3", [])])
def test_cycles(spark, text, want):
    e = edges_of(spark, text)
    found = {}
    for r in graph.scc(graph.vertices(e), e, Scratch(spark)).collect():
        found.setdefault(r["component"], []).append(r["id"])
    assert sorted(sorted(v) for v in found.values() if len(v) > 1) == want


@pytest.mark.parametrize("text,start,want", [("1-2 2-3 3-1", 1, 3), ("1-2 2-3 3-2", 1, 3), ("1-2 2-3 1-4 4-5 5-6 6-4", 1, 4)])
def test_longest_chain(spark, text, start, want):
    e, scratch = edges_of(spark, text), Scratch(spark)
    c = graph.scc(graph.vertices(e), e, scratch)
    chains = graph.longest_chains(c, graph.condensation(c, e), scratch)
    assert chains.join(c.where(F.col("id") == start), "component").first()["length"] == want


def test_coupling(spark):
    rows = {r["id"]: r for r in graph.coupling(edges_of(spark, "1-2 3-2"), spark.createDataFrame([(2, 0.8)], "id long, abstractness double")).collect()}
    assert (rows[2]["ca"], rows[2]["ce"], rows[2]["instability"]) == (2, 0, 0.0) and rows[2]["distance"] == pytest.approx(0.2)
    assert (rows[1]["ca"], rows[1]["ce"], rows[1]["instability"]) == (0, 1, 1.0)


@pytest.mark.parametrize(
    "edges,want",
    [
        ([("a", "b", "normal")], 1),
        ([("a", "b", "cond_true"), ("a", "c", "cond_false")], 2),
        ([("a", "b", "cond_true")], 1),
        ([("d", x, "cond_true") for x in "1234"] + [("d", "e", "cond_false")], 5),
        ([("a", "b", "cond_true"), ("a", "b", "cond_true"), ("a", "c", "cond_false")], 2),
        ([("a", "b", "exception")], 2),
    ],
)
def test_mccabe(spark, edges, want):
    frame = spark.createDataFrame([(1, *e) for e in edges], "cfg_id long, src string, dst string, edge_type string")
    assert flow.mccabe(frame).first()["complexity"] == want


@pytest.mark.parametrize("rows,want", [([(4, 6, "t", 2), (6, 6, "t", 3)], [(4, 6, 3)]), ([(4, 6, "t", 2), (7, 8, "t", 2)], [(4, 8, 2)]), ([(4, 4, "t", 2), (6, 6, "t", 2)], [(4, 4, 2), (6, 6, 2)]), ([(4, 6, "t", 2), (6, 6, "u", 2)], [(4, 6, 2), (6, 6, 2)])])
def test_merge_contiguous(spark, rows, want):
    frame = spark.createDataFrame([("f", *r, "d") for r in rows], "file_path string, start_line int, end_line int, reason string, severity int, description string")
    got = flow.merge_contiguous(frame).collect()
    assert sorted((r["start_line"], r["end_line"], r["severity"]) for r in got) == want


def test_def_use_across_blocks(spark):
    refs = spark.createDataFrame([(1, "v", True, 1, 10), (1, "v", False, 1, 11), (1, "v", False, 3, 30), (1, "w", False, 3, 31)], "cfg_id long, name string, is_def boolean, block_id long, pos long")
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 3)], "cfg_id long, src long, dst long")
    got = {(r["name"], r["def_block"], r["use_block"]) for r in flow.def_use(refs, edges, Scratch(spark)).collect()}
    assert got == {("v", 1, 1), ("v", 1, 3)}


def test_lcom(spark):
    methods = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 4)], "class int, method long")
    used = spark.createDataFrame([(1, 1, "name"), (1, 2, "name"), (1, 3, "age")], "class int, method long, var string")
    none = spark.createDataFrame([], "class int, method long, callee long")
    got = {r["class"]: r["lcom4"] for r in metrics.lcom4(used, methods, none, Scratch(spark)).collect()}
    assert got == {1: 2, 2: 1}


def test_cbo(spark):
    deps = spark.createDataFrame([("S", "R", "i"), ("S", "L", "h"), ("S", "C", "m"), ("S", "S", "i"), ("S", "R", "h")], "class string, dep_class string, kind string")
    row = metrics.class_coupling(deps, ["i", "h", "m"]).first()
    assert (row["coupling"], row["kind_h"], row["dependencies"]) == (3, 2, "C,L,R")


def test_common_root(spark):
    paths = spark.createDataFrame([("src/a/x.ts",), ("src/a/b/y.ts",), ("src/ab/z.ts",)], "file_path string")
    assert metrics.common_root(paths).first()["root"] == "src"


def tree(nested):
    labels, parents = [], []

    def walk(node, parent):
        labels.append(node[0])
        parents.append(parent)
        me = len(labels) - 1
        for child in node[1:]:
            walk(child, me)

    walk(nested, -1)
    return trees.post_order(labels, parents)


def brute_distance(a, b):
    """Forest edit distance by its recursive definition."""
    from functools import lru_cache

    def size(f):
        return sum(1 + size(t[1:]) for t in f)

    @lru_cache(None)
    def go(f, g):
        if not f or not g:
            return size(f) + size(g)
        x, y = f[-1], g[-1]
        return min(go(f[:-1] + x[1:], g) + 1, go(f, g[:-1] + y[1:]) + 1, go(x[1:], y[1:]) + go(f[:-1], g[:-1]) + (x[0] != y[0]))

    return go((a,), (b,))


def random_tree(r, n):
    nodes = [[r.choice("abc")] for _ in range(n)]
    for i in range(1, n):
        nodes[r.randrange(i)].append(nodes[i])
    freeze = lambda t: (t[0], *map(freeze, t[1:]))
    return freeze(nodes[0])


def test_tree_distance_against_definition():
    r = random.Random(9)
    for _ in range(60):
        a, b = random_tree(r, r.randint(1, 8)), random_tree(r, r.randint(1, 8))
        (l1, m1), (l2, m2) = tree(a), tree(b)
        assert trees.edit_distance(l1, m1, l2, m2) == brute_distance(a, b) == trees.edit_distance(l2, m2, l1, m1)


def test_html_tree_tolerates_unclosed_tags():
    labels, parents, _ = trees.parse_html("<div><p>a<b>b<br></p><i>c</div><span>")
    assert labels == ["#root", "div", "p", "b", "br", "i", "span"] and parents == [-1, 0, 1, 2, 3, 1, 0]


def test_leader_clusters():
    assert trees.leader_clusters([1, 2, 3], {(1, 2): 1.0, (1, 3): 9.0, (2, 3): 9.0}, {1: 10, 2: 10, 3: 10}, 0.8) == {1: 1, 2: 1, 3: 3}


def test_capped_candidates(spark):
    rows = [("both", 0, "k"), ("both", 1, "m"), ("late", 1, "m"), ("q", 0, "k"), ("q", 1, "m")]
    bands = spark.createDataFrame(rows, "id string, band int, key string")
    got = lsh.capped_candidates(bands, bands.where("id = 'q'"), 3).orderBy("place").collect()
    assert [r["other"] for r in got] == ["both", "late"]


def test_strategy_switch():
    assert not lsh.use_lsh(100) and lsh.use_lsh(142) and lsh.use_lsh(500) and not lsh.use_lsh(500, forced=False)


def test_mcnemar(spark):
    frame = spark.createDataFrame([(0, 0), (10, 0), (5, 5), (1, 9)], "b long, c long")
    got = [r[0] for r in frame.select(stats.mcnemar_exact("b", "c")).collect()]
    assert got == pytest.approx([1.0, 2 / 1024, 1.0, 22 / 1024])


def test_relative_imports(spark):
    files = spark.createDataFrame([("src/a.ts",), ("src/b/index.ts",), ("src/c.js",)], "file_path string")
    asked = spark.createDataFrame([("src/x.ts", "./a"), ("src/x.ts", "./b"), ("src/b/y.ts", "../c"), ("src/x.ts", "./none")], "file_path string, source string")
    got = {(r["file_path"], r["source"]): r["target"] for r in imports.resolve_relative(asked, files).collect()}
    assert got == {("src/x.ts", "./a"): "src/a.ts", ("src/x.ts", "./b"): "src/b/index.ts", ("src/b/y.ts", "../c"): "src/c.js"}


def test_orphans_are_cycles_without_an_entry(spark):
    files = spark.createDataFrame([("index.ts",), ("a.ts",), ("b.ts",), ("c.ts",), ("d.test.ts",)], "file_path string")
    edges = spark.createDataFrame([("index.ts", "a.ts"), ("b.ts", "c.ts"), ("c.ts", "b.ts"), ("d.test.ts", "b.ts")], "src string, dst string")
    assert sorted(r["id"] for r in imports.orphans(files, edges, Scratch(spark)).collect()) == ["b.ts", "c.ts"]


def test_expanded_chains_are_simple_paths():
    members = {1: {1}, 2: {2, 3, 4}, 9: {9}}
    edges = [(1, 2), (2, 3), (3, 4), (4, 2), (4, 9)]
    assert graph.expand_chain([1, 2, 9], 1, members, edges) == [1, 2, 3, 4, 9]
    assert graph.expand_chain([1, 2], 1, members, edges) == [1, 2, 3, 4]
    assert graph.cycle_path(2, {2, 3, 4}, edges) == [2, 3, 4, 2]


def test_entry_chains(spark):
    e, scratch = edges_of(spark, "1-2 2-3 7-3"), Scratch(spark)
    nodes = graph.vertices(e)
    c = graph.scc(nodes, e, scratch)
    chains = graph.longest_chains(c, graph.condensation(c, e), scratch)
    assert [(r["id"], r["length"]) for r in graph.entry_chains(chains, nodes, e, c).collect()] == [(1, 3), (7, 2)]


def test_sieve_of_ids_never_hides_a_match(spark):
    from treeloom.operators.sift import sifted

    rows = spark.range(5000).selectExpr("case when id % 7 = 0 then null else id - 2500 end as doc", "id as __other")
    got = sifted(rows, "doc", spark.range(1000, 3000, 3).toDF("id")).toPandas()
    inside = got.doc.isin(range(1000, 3000, 3))
    assert len(got) == 5000 and got[inside]["__near"].all() and got[~inside]["__near"].mean() < 0.01
    assert not sifted(rows, "doc", spark.range(0).toDF("id")).where("__near").count()
