"""Trees: HTML and bracket trees to rows, tree features, tree edit distance.

A tree travels as its labels in post order with left-most leaves, which is the shape the
edit distance wants: ``labels ARRAY<STRING>``, ``lml ARRAY<INT>``.
"""

from __future__ import annotations

import hashlib
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.functions.text import count_bin
from treeloom.runtime import ship
from treeloom.functions.udf import pandas_udf

#: Elements that have no end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Tree sizes beyond which the distance is bounded, and only profiled; key roots of the bounded form.
EXACT_NODES, PROFILE_NODES, MOST_ROOTS = 500, 2000, 100


class _Tree(HTMLParser):
    """Elements of a page in document order; unclosed elements end with their parent."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.labels: list[str] = ["#root"]
        self.parents: list[int] = [-1]
        self.lines: list[int] = [1]
        self.stack: list[int] = [0]

    def handle_starttag(self, tag: str, attrs) -> None:
        self.labels.append(tag)
        self.parents.append(self.stack[-1])
        self.lines.append(self.getpos()[0])
        if tag not in VOID:
            self.stack.append(len(self.labels) - 1)

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.labels[self.stack[depth]] == tag:
                del self.stack[depth:]
                return


def parse_html(html: str | None) -> tuple[list[str], list[int], list[int]]:
    """(labels, parents, lines) in pre-order; the root stands before all."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.labels, tree.parents, tree.lines


_NODE = "array<struct<node_id:int,parent_id:int,child_idx:int,label:string,depth:int,line:int>>"


@pandas_udf(_NODE)
def html_nodes(html: pd.Series) -> pd.Series:
    out = []
    for text in html:
        labels, parents, lines = parse_html(text)
        depth, seen = [0] * len(labels), [0] * len(labels)
        rows = []
        for i, p in enumerate(parents):
            place = 0
            if p >= 0:
                depth[i] = depth[p] + 1
                place = seen[p]
                seen[p] += 1
            rows.append({"node_id": i, "parent_id": p, "child_idx": place, "label": labels[i], "depth": depth[i], "line": lines[i]})
        out.append(rows)
    return pd.Series(out)


def nodes(pages: DataFrame, id: str = "page_id", html: str = "html") -> DataFrame:
    """One row for each node: (tree_id, node_id, parent_id, child_idx, label, depth, line)."""
    ship(pages.sparkSession)
    return pages.select(F.col(id).alias("tree_id"), F.inline(html_nodes(F.col(html))))


def post_order(labels: list[str], parents: list[int]) -> tuple[list[str], list[int]]:
    """Labels and left-most leaves in post order."""
    kids: list[list[int]] = [[] for _ in labels]
    for i, p in enumerate(parents):
        if p >= 0:
            kids[p].append(i)
    out: list[str] = []
    lml: list[int] = []
    first: dict[int, int] = {}
    stack = [(0, 0)]
    while stack:
        node, k = stack.pop()
        if k < len(kids[node]):
            stack.append((node, k + 1))
            stack.append((kids[node][k], 0))
        else:
            first[node] = first[kids[node][0]] if kids[node] else len(out)
            out.append(labels[node])
            lml.append(first[node])
    return out, lml


def key_roots(lml: list[int]) -> list[int]:
    """For each left-most leaf the last node that has it."""
    return sorted({leaf: i for i, leaf in enumerate(lml)}.values())


@pandas_udf("struct<labels:array<string>,lml:array<int>,size:int,height:int>")
def html_tree(html: pd.Series) -> pd.DataFrame:
    out = []
    for text in html:
        labels, parents, _ = parse_html(text)
        depth = [0] * len(labels)
        for i, p in enumerate(parents):
            depth[i] = depth[p] + 1 if p >= 0 else 0
        flat, lml = post_order(labels, parents)
        out.append((flat, lml, len(flat), max(depth) + 1))
    return pd.DataFrame(out, columns=["labels", "lml", "size", "height"])


def _subtree_features(labels: list[str], parents: list[int], most: int) -> set[str]:
    """Hashes of subtrees up to a height, in child order."""
    n = len(labels)
    kids: list[list[int]] = [[] for _ in labels]
    for i, p in enumerate(parents):
        if p >= 0:
            kids[p].append(i)
    height, digest = [0] * n, [""] * n
    out = set()
    for i in range(n - 1, -1, -1):
        height[i] = 1 + max((height[k] for k in kids[i]), default=0)
        digest[i] = hashlib.md5("|".join([labels[i], *(digest[k] for k in kids[i])]).encode()).hexdigest()[:16]
        if height[i] <= most:
            out.add(f"sub:{height[i]}:{digest[i]}")
    return out


@pandas_udf("array<string>")
def html_subtrees(html: pd.Series) -> pd.Series:
    return html.map(lambda text: sorted(_subtree_features(*parse_html(text)[:2], 3)))


def label_features(node_rows: DataFrame) -> DataFrame:
    """(tree_id, feature) of 4-grams over pre-order labels, labels and binned label counts."""
    label = F.regexp_replace("label", r"\(.*$", "")
    order = F.array_sort(F.collect_list(F.struct("node_id", label.alias("label"))))
    seq = node_rows.groupBy("tree_id").agg(F.transform(order, lambda x: x["label"]).alias("seq"))
    grams = seq.where(F.size("seq") >= 4).select("tree_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("seq") - 3), lambda i: F.concat(F.lit("kgram:"), F.array_join(F.slice("seq", i, F.lit(4)), ":")))).alias("feature"))
    counts = node_rows.groupBy("tree_id", label.alias("label")).agg(F.count("*").alias("n"))
    kinds = counts.select("tree_id", F.explode(F.array(F.concat(F.lit("type:"), "label"), F.concat(F.lit("typedist:"), "label", F.lit(":"), count_bin(F.col("n"))))).alias("feature"))
    return grams.union(kinds).distinct()


def edit_distance(l1: list[str], m1: list[int], l2: list[str], m2: list[int], insert: float = 1.0, delete: float = 1.0, rename=None, roots: int | None = None) -> float:
    """Ordered tree edit distance by key roots; each row of a forest table is one numpy step.

    ``rename(a, b)`` costs a relabelling (default 1 for different labels).  With ``roots`` only the
    last key roots of each side are used, which bounds the work of large trees.
    """
    n, m = len(l1), len(l2)
    if n == 0 or m == 0:
        return n * delete + m * insert
    codes = {s: i for i, s in enumerate(dict.fromkeys([*l1, *l2]))}
    names = list(codes)
    table = np.array([[0.0 if a == b else 1.0 if rename is None else rename(a, b) for b in names] for a in names])
    a, b = np.array([codes[s] for s in l1]), np.array([codes[s] for s in l2])
    lm1, lm2 = np.asarray(m1), np.asarray(m2)
    tree = np.zeros((n, m))
    k1, k2 = key_roots(list(m1)), key_roots(list(m2))
    if roots is not None:
        k1, k2 = k1[-roots:], k2[-roots:]
    for i in k1:
        li = lm1[i]
        for j in k2:
            lj = lm2[j]
            cols = np.arange(lj, j + 1)
            width = len(cols)
            forest = np.zeros((i - li + 2, width + 1))
            forest[0] = np.arange(width + 1) * insert
            ramp = np.arange(width + 1) * insert
            left = lm2[cols] - lj
            own = left == 0
            for x in range(li, i + 1):
                r = x - li + 1
                above = forest[r - 1]
                best = above[1:] + delete
                if lm1[x] == li:
                    match = np.where(own, above[:-1] + table[a[x], b[cols]], forest[0][left] * 0 + forest[lm1[x] - li][left] + tree[x, cols])
                else:
                    match = forest[lm1[x] - li][left] + tree[x, cols]
                step = np.minimum(best, match)
                # insertions run along the row: a running minimum against the ramp
                line = np.concatenate(([above[0] + delete], step))
                forest[r] = np.minimum.accumulate(line - ramp) + ramp
                if lm1[x] == li:
                    tree[x, cols[own]] = forest[r][1:][own]
    return float(tree[n - 1, m - 1])


def profile_distance(l1: list[str], l2: list[str]) -> float:
    """The larger side's labels that the other side's counts do not cancel."""
    c1, c2 = pd.Series(l1).value_counts(), pd.Series(l2).value_counts()
    shared = int(np.minimum(c1, c2.reindex(c1.index, fill_value=0)).sum())
    return float(max(len(l1), len(l2)) - shared)


def bounded_distance(l1: list[str], m1: list[int], l2: list[str], m2: list[int]) -> float:
    """Exact to 500 nodes; beyond, the size difference, profile or capped key roots."""
    big = max(len(l1), len(l2))
    if big <= EXACT_NODES:
        return edit_distance(l1, m1, l2, m2)
    diff = abs(len(l1) - len(l2))
    if diff > 0.8 * big:
        return float(diff)
    low = profile_distance(l1, l2)
    return low if big > PROFILE_NODES else max(low, edit_distance(l1, m1, l2, m2, roots=MOST_ROOTS))


@pandas_udf("double")
def tree_distance(l1: pd.Series, m1: pd.Series, l2: pd.Series, m2: pd.Series) -> pd.Series:
    """Distances of pairs of trees."""
    return pd.Series([bounded_distance(list(a), list(b), list(c), list(d)) for a, b, c, d in zip(l1, m1, l2, m2)], dtype="float64")


def similarity(distance: Column, n1: Column, n2: Column, by_sum: bool = False) -> Column:
    """1 - distance over the larger size, or over the sum of sizes."""
    top = (n1 + n2) if by_sum else F.greatest(n1, n2)
    return F.when(top <= 0, 1.0).otherwise(1.0 - F.least(distance, top) / top)


def capped(distance: Column, n1: Column, n2: Column, most: float) -> Column:
    """A size difference or distance over the cap is cap + 1."""
    return F.when((F.abs(n1 - n2) > most) | (distance > most), most + 1.0).otherwise(distance)


def leader_clusters(ids: list[int], distances: dict[tuple[int, int], float], sizes: dict[int, int], threshold: float) -> dict[int, int]:
    """Each item joins the first earlier leader that is similar enough, or leads."""
    out: dict[int, int] = {}
    leaders: list[int] = []
    for i in ids:
        for k in leaders:
            d = distances.get((k, i), distances.get((i, k)))
            if d is not None and 1 - min(d, max(sizes[k], sizes[i])) / max(sizes[k], sizes[i]) >= threshold:
                out[i] = k
                break
        else:
            leaders.append(i)
            out[i] = i
    return out
