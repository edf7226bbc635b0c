"""Control flow and data flow over block, edge and reference tables.

Tables: ``blocks(cfg_id, block_id, label)``, ``edges(cfg_id, src, dst, edge_type)`` with types
normal, cond_true, cond_false, loop, exception, break, continue, return, and
``refs(cfg_id, name, is_def, kind, block_id, pos)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.runtime import Scratch

CONDITIONAL = ("cond_true", "cond_false")


def mccabe(edges: DataFrame, cfgs: DataFrame | None = None, extras: DataFrame | None = None) -> DataFrame:
    """(cfg_id, complexity) = 1 + extras + over blocks (distinct conditional targets - 1, if more than one) + one for any exception edge."""
    targets = F.count_distinct(F.when(F.col("edge_type").isin(*CONDITIONAL), F.col("dst")))
    block = edges.groupBy("cfg_id", "src").agg(targets.alias("targets"), F.max((F.col("edge_type") == "exception").cast("int")).alias("raises"))
    value = block.groupBy("cfg_id").agg(F.sum(F.greatest(F.col("targets") - 1, F.lit(0)) + F.col("raises")).alias("points"))
    out = value if cfgs is None else cfgs.select("cfg_id").distinct().join(value, "cfg_id", "left")
    if extras is not None:
        out = out.join(extras.groupBy("cfg_id").agg(F.sum("n").alias("extra")), "cfg_id", "left")
    else:
        out = out.withColumn("extra", F.lit(0))
    return out.select("cfg_id", (F.coalesce("points", F.lit(0)) + F.coalesce("extra", F.lit(0)) + 1).cast("long").alias("complexity"))


def complexity_record(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """Complexity beside node, edge, loop and decision counts; entry and exit are no nodes."""
    e = edges.groupBy("cfg_id").agg(
        F.count("*").alias("edges"),
        F.count_if(F.col("edge_type") == "loop").alias("loops"),
        F.count_if(F.col("edge_type") == "exception").alias("handlers"),
    )
    n = blocks.groupBy("cfg_id").agg(F.count_if(~F.col("label").isin("entry", "exit")).alias("nodes"))
    c = mccabe(edges, blocks)
    zero = lambda x: F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x)
    return c.join(n, "cfg_id", "left").join(e, "cfg_id", "left").select("cfg_id", "complexity", zero("nodes"), zero("edges"), zero("loops"), zero("handlers"), (F.col("complexity") - 1).alias("decisions"))


def reachable_blocks(entries: DataFrame, edges: DataFrame, terminated: DataFrame | None, scratch: Scratch) -> DataFrame:
    """C4: blocks reached from the entries; normal edges out of a block with a terminator are not followed."""
    live = edges.select("cfg_id", "src", "dst", "edge_type")
    if terminated is not None:
        stop = terminated.select("cfg_id", F.col("block_id").alias("src")).distinct().withColumn("stops", F.lit(True))
        live = live.join(stop, ["cfg_id", "src"], "left").where("edge_type <> 'normal' or stops is null")
    live = scratch.cut(live.select("cfg_id", "src", "dst").distinct())
    seen = scratch.cut(entries.select("cfg_id", "block_id").distinct())
    front = seen
    while True:
        step = front.select("cfg_id", F.col("block_id").alias("src")).join(live, ["cfg_id", "src"]).select("cfg_id", F.col("dst").alias("block_id")).distinct()
        front = scratch.cut(step.join(seen, ["cfg_id", "block_id"], "left_anti"))
        if front.isEmpty():
            return seen
        seen = scratch.cut(seen.union(front))


def reachability_ratio(blocks: DataFrame, reached: DataFrame) -> DataFrame:
    """Blocks, unreachable blocks and the ratio of each graph."""
    hit = blocks.join(reached.withColumn("hit", F.lit(1)), ["cfg_id", "block_id"], "left")
    n, r = F.count("*"), F.count("hit")
    return hit.groupBy("cfg_id").agg(n.alias("blocks"), (n - r).alias("unreachable"), (r / n).alias("ratio"))


def dead_blocks(blocks: DataFrame, reached: DataFrame) -> DataFrame:
    """Unreachable blocks that hold more than no-ops, critical."""
    return blocks.where("statements > 0").join(reached, ["cfg_id", "block_id"], "left_anti").withColumn("severity", F.lit("critical"))


def dead_statements(statements: DataFrame) -> DataFrame:
    """Statements after the first terminator of their block.

    ``statements`` holds (cfg_id, block_id, pos, kind); return and throw warn, break and continue inform.
    """
    ends = F.col("kind").isin("return", "throw", "break", "continue")
    by = Window.partitionBy("cfg_id", "block_id").orderBy("pos")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    first = F.first(F.when(ends, F.col("kind")), ignorenulls=True).over(before)
    out = statements.withColumn("after", first).where("after is not null")
    severity = F.when(F.col("after").isin("return", "throw"), "warning").otherwise("info")
    return out.withColumn("reason", F.concat(F.lit("after_"), "after")).withColumn("severity", severity).drop("after")


def dead_reason(last_kind: Column, label: Column) -> tuple[Column, Column]:
    """Reason and severity of an unreachable block by its predecessor's last statement, then its label."""
    jump = last_kind.isin("return", "throw", "break", "continue")
    reason = F.when(jump, F.concat(F.lit("unreachable_after_"), last_kind)).when(label.contains("loop"), "unreachable_after_infinite_loop").otherwise("unreachable_branch")
    return reason, F.when(jump, "critical").otherwise("warning")


def merge_contiguous(findings: DataFrame, key: str = "file_path") -> DataFrame:
    """Neighbouring findings of one reason become one with the gravest severity.

    A finding continues the run before it when that run has its reason and reaches at least the
    line before its start; another reason in between closes the run.  ``findings`` holds key,
    start_line, end_line, reason, severity rank and description.
    """
    by = Window.partitionBy(key).orderBy("start_line", "end_line", "reason", "severity", "description")
    runs = findings.withColumn("__turn", (F.col("reason") != F.lag("reason").over(by)).cast("int")).withColumn("__run", F.sum(F.coalesce("__turn", F.lit(1))).over(by))
    inside = Window.partitionBy(key, "__run").orderBy("start_line", "end_line", "severity", "description")
    reach = F.max("end_line").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    gap = runs.withColumn("__gap", F.when(F.col("start_line") <= reach + 1, 0).otherwise(1)).withColumn("__island", F.sum("__gap").over(inside))
    worst = F.max_by(F.col("description"), F.struct("severity", -F.col("start_line"), -F.col("end_line")))
    return gap.groupBy(key, "__run", "__island", "reason").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.max("severity").alias("severity"), worst.alias("description"), F.count("*").alias("merged")).drop("__run", "__island")


def nesting_depth(nodes: DataFrame, id: str = "tree_id") -> DataFrame:
    """Greatest depth and the line of the first node that has it; ``nodes`` holds (id, depth, line)."""
    return nodes.groupBy(id).agg(F.max("depth").alias("max_depth"), F.min_by("line", F.struct(-F.col("depth"), "line")).alias("line"))


def def_use_in_block(refs: DataFrame) -> DataFrame:
    """Each use with the latest definition of its name before it in the block."""
    by = Window.partitionBy("cfg_id", "name", "block_id").orderBy("pos", F.desc("is_def")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("is_def"), F.col("pos")), ignorenulls=True).over(by)
    return refs.withColumn("def_pos", last).where("not is_def and def_pos is not null").select("cfg_id", "name", "block_id", F.col("pos").alias("use_pos"), "def_pos")


def def_use(refs: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(cfg_id, name, def_block, def_pos, use_block, use_pos) - in the block, else the nearest defining predecessor.

    Uses without a definition in their block search backwards breadth first; ties between
    blocks of one distance go to the least block id.
    """
    local = def_use_in_block(refs).select("cfg_id", "name", F.col("block_id").alias("def_block"), "def_pos", F.col("block_id").alias("use_block"), "use_pos")
    defs = refs.where("is_def").groupBy("cfg_id", "name", F.col("block_id").alias("at")).agg(F.max("pos").alias("def_pos"))
    back = scratch.cut(edges.select("cfg_id", F.col("dst").alias("at"), F.col("src").alias("prev")).distinct())
    uses = refs.where("not is_def").select("cfg_id", "name", F.col("block_id").alias("use_block"), F.col("pos").alias("use_pos"))
    open_ = uses.join(local.select("cfg_id", "name", "use_block", "use_pos"), ["cfg_id", "name", "use_block", "use_pos"], "left_anti")
    front = scratch.cut(open_.withColumn("at", F.col("use_block")).distinct())
    seen = front
    found = None
    key = ["cfg_id", "name", "use_block", "use_pos"]
    while not front.isEmpty():
        step = front.join(back, ["cfg_id", "at"]).select(*key, F.col("prev").alias("at")).distinct()
        step = scratch.cut(step.join(seen, [*key, "at"], "left_anti"))
        hit = scratch.cut(step.join(defs, ["cfg_id", "name", "at"]).groupBy(*key).agg(F.min(F.struct("at", "def_pos")).alias("d")).select("cfg_id", "name", F.col("d.at").alias("def_block"), F.col("d.def_pos").alias("def_pos"), "use_block", "use_pos"))
        found = hit if found is None else found.union(hit)
        seen = scratch.cut(seen.union(step))
        front = scratch.cut(step.join(hit.select(*key), key, "left_anti"))
    return local if found is None else local.unionByName(found)


def chain_totals(refs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Definitions, uses, pairs, variables and the share of pairs across blocks."""
    r = refs.groupBy("cfg_id").agg(F.count_if("is_def").alias("defs"), F.count_if(~F.col("is_def")).alias("uses"), F.count_distinct("name").alias("variables"))
    p = pairs.groupBy("cfg_id").agg(F.count("*").alias("pairs"), F.count_if(F.col("def_block") != F.col("use_block")).alias("crossing"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return r.join(p, "cfg_id", "left").select("cfg_id", "defs", "uses", "variables", zero("pairs"), zero("crossing"))


def cfg_features(edges: DataFrame) -> DataFrame:
    """Block, edge and type counts, cyclomatic number E - N + 2, branching factor."""
    ends = edges.select("cfg_id", F.explode(F.array("src", "dst")).alias("block")).groupBy("cfg_id").agg(F.count_distinct("block").alias("blocks"))
    kinds = edges.groupBy("cfg_id", "edge_type").agg(F.count("*").alias("n"))
    total = kinds.groupBy("cfg_id").agg(
        F.sum("n").alias("edges"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("edge_type", "n")))).alias("kinds"),
        F.sum(F.when(F.col("edge_type") == "loop", F.col("n")).otherwise(0)).alias("loops"),
        F.sum(F.when(F.col("edge_type").isin(*CONDITIONAL), F.col("n")).otherwise(0)).alias("conditions"),
    )
    return total.join(ends, "cfg_id").select("cfg_id", "blocks", "edges", (F.col("edges") - F.col("blocks") + 2).alias("cyclomatic"), "kinds", "loops", "conditions", (F.col("edges") / F.col("blocks")).alias("branching"))
