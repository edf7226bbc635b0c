"""Directed graphs as (src, dst) tables.

Iterative operators keep their state in tables under the shared folder and stop when a round
changes nothing; no vertex set or edge set is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.operators.components import components
from treeloom.runtime import Scratch

__all__ = ["components", "coupling", "transitive_closure", "reachable", "depths", "scc", "cycles", "condensation", "longest_chains", "matrix", "roots", "leaves"]


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def coupling(edges: DataFrame, abstractness: DataFrame | None = None, distinct_edges: bool = True) -> DataFrame:
    """Afferent and efferent coupling, instability and distance from the main sequence.

    ``distinct_edges`` is for edge sets; a module graph counts every import statement.
    """
    e = edges.distinct() if distinct_edges else edges
    ends = e.select(F.inline(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("ca"), F.lit(1).alias("ce")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("ca"), F.lit(0).alias("ce")))))
    out = ends.groupBy("id").agg(F.sum("ca").cast("long").alias("ca"), F.sum("ce").cast("long").alias("ce"))
    out = out.withColumn("instability", F.when(F.col("ca") + F.col("ce") > 0, F.col("ce") / (F.col("ca") + F.col("ce"))).otherwise(0.0))
    if abstractness is not None:
        out = out.join(abstractness.select("id", "abstractness"), "id", "left")
    else:
        out = out.withColumn("abstractness", F.lit(0.0))
    return out.withColumn("abstractness", F.coalesce("abstractness", F.lit(0.0))).withColumn("distance", F.abs(F.col("abstractness") + F.col("instability") - 1))


def abstractness(exports: Column) -> Column:
    """A19"""
    return F.least(exports / 10.0, F.lit(1.0))


def zone(ca: Column, instability: Column, abstract: Column, distance: Column) -> Column:
    """G16"""
    return (
        F.when((distance >= 0.5) & (ca >= 2) & (instability <= 0.3) & (abstract <= 0.3), "zone_of_pain")
        .when((distance >= 0.5) & (instability >= 0.7) & (abstract >= 0.7), "zone_of_uselessness")
        .when(distance <= 0.2, "main_sequence")
        .otherwise("")
    )


def module_risk(total: Column, distance: Column) -> Column:
    """G17"""
    return F.when((total >= 10) | (distance > 0.5), "high").when((total >= 5) | (distance > 0.3), "medium").otherwise("low")


def load_time(edges: DataFrame) -> DataFrame:
    """Edges that exist when modules load; coupling keeps the dynamic ones."""
    return edges.where("edge_type <> 'dynamic'")


def matrix(edges: DataFrame) -> DataFrame:
    """G15"""
    return edges.select("src", "dst").distinct()


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an incoming edge."""
    return nodes.join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti")


def transitive_closure(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(src, dst) for every non-empty path; a start on a cycle reaches itself.  Paths double each round."""
    known = scratch.cut(edges.select("src", "dst").distinct())
    n = known.count()
    while True:
        step = known.select(F.col("src").alias("mid"), F.col("dst").alias("end"))
        new = scratch.cut(known.union(known.join(step, known["dst"] == step["mid"]).select("src", F.col("end").alias("dst"))).distinct())
        scratch.drop(known)
        m = new.count()
        if m == n:
            return new
        known, n = new, m


def depths(starts: DataFrame, edges: DataFrame, scratch: Scratch, most: int | None = None) -> DataFrame:
    """(id, depth) of what the starts reach, breadth first, to depth ``most``."""
    e = edges.select("src", "dst").distinct()
    seen = scratch.cut(starts.select("id").distinct().withColumn("depth", F.lit(0)))
    level = 0
    while most is None or level < most:
        edge = seen.where(F.col("depth") == level).select(F.col("id").alias("src"))
        next_ids = edge.join(e, "src").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        new = scratch.cut(next_ids.withColumn("depth", F.lit(level + 1)))
        if new.isEmpty():
            return seen
        seen = scratch.cut(seen.union(new))
        level += 1
    return seen


def reachable(starts: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Ids that the starts reach, themselves included."""
    return depths(starts, edges, scratch).select("id")


def _propagate(ids: DataFrame, edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """Least label over all ancestors, by rounds of joins."""
    state = scratch.cut(ids)
    while True:
        sent = edges.join(state.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min(label).alias("__in"))
        new = scratch.cut(state.join(sent, "id", "left").select("id", F.least(F.col(label), F.coalesce("__in", F.col(label))).alias(label), (F.col("__in") < F.col(label)).alias("__moved")))
        moved = not new.where("__moved").isEmpty()
        scratch.drop(state)
        state = new.drop("__moved")
        state.scratch_path = new.scratch_path
        if not moved:
            return state


def scc(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component), the component named by its least id.

    Rounds of colouring: every vertex takes the least id among its ancestors; what a colour's
    root reaches backwards within the colour is one component and leaves the graph.
    """
    left = scratch.cut(nodes.select("id").distinct())
    e = scratch.cut(edges.select("src", "dst").where("src <> dst").distinct())
    done: list[DataFrame] = []
    while not left.isEmpty():
        colour = _propagate(left.withColumn("colour", F.col("id")), e, scratch, "colour")
        within = e.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("cd")), "dst").where("cs = cd")
        back = scratch.cut(within.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        found = depths(colour.where("id = colour").select("id"), back, scratch).select("id")
        piece = scratch.cut(found.join(colour, "id").select("id", F.col("colour").alias("component")))
        done.append(piece)
        left = scratch.cut(left.join(piece, "id", "left_anti"))
        e = scratch.cut(e.join(piece.select(F.col("id").alias("src")), "src", "left_anti").join(piece.select(F.col("id").alias("dst")), "dst", "left_anti"))
    if not done:
        return nodes.select("id", F.col("id").alias("component"))
    out = done[0]
    for piece in done[1:]:
        out = out.union(piece)
    return out


def cycles(components_: DataFrame, edges: DataFrame) -> DataFrame:
    """Components of more than one vertex with severity, internal edges and the edge to cut.

    ``edges`` holds src, dst and weight; the lightest internal edge is named, ties by src, dst.
    """
    size = components_.groupBy("component").agg(F.count("*").alias("size")).where("size > 1")
    a = components_.select(F.col("id").alias("src"), F.col("component"))
    b = components_.select(F.col("id").alias("dst"), F.col("component").alias("c2"))
    inner = edges.join(a, "src").join(b, "dst").where("component = c2 and src <> dst")
    cut = inner.groupBy("component").agg(F.count("*").alias("edges"), F.min(F.struct("weight", "src", "dst")).alias("cut"))
    severity = F.when(F.col("size") <= 2, "low").when(F.col("size") <= 4, "medium").when(F.col("size") <= 6, "high").otherwise("critical")
    return size.join(cut, "component").select("component", "size", severity.alias("severity"), "edges", F.col("cut.src").alias("cut_src"), F.col("cut.dst").alias("cut_dst"))


def condensation(components_: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between components with one crossing edge each, the first by src, dst."""
    a = components_.select(F.col("id").alias("src"), F.col("component").alias("csrc"))
    b = components_.select(F.col("id").alias("dst"), F.col("component").alias("cdst"))
    return edges.join(a, "src").join(b, "dst").where("csrc <> cdst").groupBy("csrc", "cdst").agg(F.min(F.struct("src", "dst")).alias("via")).select("csrc", "cdst", F.col("via.src").alias("src"), F.col("via.dst").alias("dst"))


def longest_chains(components_: DataFrame, dag: DataFrame, scratch: Scratch, top: int = 1) -> DataFrame:
    """For each component its ``top`` chains downwards by summed size, ties by the chain of least ids.

    Rows (component, length, chain, place); a round extends every chain by one component until nothing changes.
    """
    size = components_.groupBy("component").agg(F.count("*").alias("own"))
    place = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("length"), "chain"))
    state = scratch.cut(size.select("component", F.col("own").alias("length"), F.array("component").alias("chain"), F.lit(1).alias("place")))
    links = dag.select(F.col("csrc").alias("component"), F.col("cdst").alias("next")).join(size, "component")
    leaf = size.join(dag.select(F.col("csrc").alias("component")).distinct(), "component", "left_anti").select("component", F.col("own").alias("length"), F.array("component").alias("chain"))
    while True:
        below = state.select(F.col("component").alias("next"), F.col("length").alias("l"), F.col("chain").alias("c"))
        grown = links.join(below, "next").select("component", (F.col("own") + F.col("l")).alias("length"), F.concat(F.array("component"), F.col("c")).alias("chain"))
        new = scratch.cut(grown.union(leaf).distinct().withColumn("place", place).where(F.col("place") <= top))
        same = new.exceptAll(state).isEmpty() and new.count() == state.count()
        scratch.drop(state)
        state = new
        if same:
            return state


def module_kind(source: Column, builtins: list[str]) -> Column:
    """G20"""
    return (
        F.when(source == "", "package")
        .when(source.startswith("node:"), "builtin")
        .when(source.rlike(r"^\.\.?(/|$)"), "relative")
        .when(source.startswith("/"), "absolute")
        .when(source.rlike(r"^[@~]/"), "alias")
        .when(F.split(source, "/")[0].isin(builtins), "builtin")
        .otherwise("package")
    )


def entry_chains(chains: DataFrame, nodes: DataFrame, edges: DataFrame, components_: DataFrame, most: int = 5) -> DataFrame:
    """The longest chains that begin at modules without importers, by length, then name."""
    entry = roots(nodes, edges).join(components_, "id")
    best = entry.join(chains.where("place = 1"), "component").select("id", "length", "chain")
    return best.orderBy(F.desc("length"), "id").limit(most)


def _route(start: int, goal: int, inside: set[int], out: dict[int, list[int]], avoid: set[int]) -> list[int] | None:
    """A shortest route within a component, least ids first."""
    seen, queue = {start: None}, [start]
    for node in queue:
        if node == goal:
            path = []
            while node is not None:
                path.append(node)
                node = seen[node]
            return path[::-1]
        for n in out.get(node, ()):
            if n in inside and n not in seen and n not in avoid:
                seen[n] = node
                queue.append(n)
    return None


def expand_chain(chain: list[int], start: int | None, members: dict[int, set[int]], edges: list[tuple[int, int]]) -> list[int]:
    """A simple path of modules along a chain of components.

    Works on one reported chain and the edges among its components: between components it takes the
    first crossing edge, inside one a shortest route, and in the last it walks while it can.
    """
    out: dict[int, list[int]] = {}
    for a, b in sorted(set(edges)):
        out.setdefault(a, []).append(b)
    path: list[int] = []
    at = start
    for i, c in enumerate(chain):
        inside = members[c]
        at = min(inside) if at is None else at
        if i + 1 < len(chain):
            after = members[chain[i + 1]]
            exits = [(a, b) for a, b in sorted(set(edges)) if a in inside and b in after]
            found = next(((r, b) for a, b in exits if (r := _route(at, a, inside, out, set()))), None)
            if found is None:
                return path + [at]
            path += found[0]
            at = found[1]
        else:
            seen = {at}
            path.append(at)
            while nxt := next((n for n in out.get(path[-1], ()) if n in inside and n not in seen), None):
                path.append(nxt)
                seen.add(nxt)
    return path


def cycle_path(start: int, members: set[int], edges: list[tuple[int, int]]) -> list[int]:
    """A simple path through a cycle from ``start`` back to it."""
    out: dict[int, list[int]] = {}
    for a, b in sorted(set(edges)):
        out.setdefault(a, []).append(b)
    for n in out.get(start, ()):
        if n in members and (rest := _route(n, start, members, out, set())):
            return [start, *rest]
    return [start]
