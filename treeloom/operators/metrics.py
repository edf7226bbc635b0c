"""Rollups, summaries, histograms, rankings, coupling and cohesion counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.functions.text import clean_path, dir_name
from treeloom.operators.components import components
from treeloom.runtime import Scratch


def by_module(functions: DataFrame) -> DataFrame:
    """A1: functions of each cleaned path; the average comes from the sum."""
    return functions.groupBy(clean_path(F.col("file_path")).alias("file_path")).agg(
        F.count("*").alias("functions"),
        F.sum("complexity").cast("long").alias("total"),
        (F.sum("complexity") / F.count("*")).alias("average"),
        F.max("complexity").cast("long").alias("most"),
        F.count_if(F.col("risk_level") == "high").alias("high_risk"),
        F.sum("handlers").cast("long").alias("handlers"),
    )


def by_directory(functions: DataFrame) -> DataFrame:
    """A2: functions of each direct parent directory."""
    return functions.groupBy(dir_name(clean_path(F.col("file_path"))).alias("directory")).agg(
        F.count("*").alias("functions"), F.avg("complexity").alias("average"), F.max("complexity").cast("long").alias("most"), F.avg("nesting").alias("average_nesting"), F.max("nesting").cast("long").alias("most_nesting")
    )


def common_root(paths: DataFrame, path: str = "file_path") -> DataFrame:
    """A3: the longest directory that all paths share: that of the least and the greatest path."""
    d = F.split(dir_name(F.col(path)), "/")
    ends = paths.agg(F.min(d).alias("a"), F.max(d).alias("b"))
    same = F.aggregate(
        F.zip_with("a", "b", lambda x, y: F.struct(x.alias("x"), (x == y).alias("same"))),
        F.struct(F.array().cast("array<string>").alias("out"), F.lit(True).alias("on")),
        lambda acc, p: F.struct(F.when(acc["on"] & p["same"], F.concat(acc["out"], F.array(p["x"]))).otherwise(acc["out"]).alias("out"), (acc["on"] & F.coalesce(p["same"], F.lit(False))).alias("on")),
    )
    return ends.select(F.array_join(same["out"], "/").alias("root"))


def complexity_summary(functions: DataFrame) -> DataFrame:
    """A4: one row of counts, average, extremes and risk counts."""
    return functions.agg(
        F.count("*").alias("functions"),
        F.avg("complexity").alias("average"),
        F.min("complexity").cast("long").alias("least"),
        F.max("complexity").cast("long").alias("most"),
        *(F.count_if(F.col("risk_level") == r).alias(f"{r}_risk") for r in ("low", "medium", "high")),
    )


def histogram(rows: DataFrame, value: str) -> DataFrame:
    """A4: exact distribution."""
    return rows.groupBy(F.col(value).cast("long").alias("value")).agg(F.count("*").alias("n"))


def coupling_bin(n: Column) -> Column:
    """A5: 0, 1-3, 4-7, 8-10 and, from 11, 10+."""
    return F.when(n == 0, "0").when(n <= 3, "1-3").when(n <= 7, "4-7").when(n <= 10, "8-10").otherwise("10+")


def threshold_bin(n: Column, low: int, medium: int) -> Column:
    """Bins that follow the risk thresholds; those that would be empty are left out."""
    edges = [(1, 1), (2, 5), (6, low), (max(low, 5) + 1, medium), (medium + 1, None)]
    out = None
    for a, b in edges:
        if b is not None and b < a:
            continue
        label = f"{a}+" if b is None else str(a) if a == b else f"{a}-{b}"
        test = F.lit(True) if b is None else n <= b
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def dead_code_summary(findings: DataFrame) -> DataFrame:
    """Totals by severity and the files affected."""
    return findings.agg(F.count("*").alias("findings"), *(F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "warning", "info")), F.count_distinct("file_path").alias("files"))


def class_coupling(deps: DataFrame, kinds: list[str]) -> DataFrame:
    """Distinct dependencies other than the class itself; the breakdown by kind is not distinct."""
    d = deps.where("class <> dep_class")
    return d.groupBy("class").agg(
        F.count_distinct("dep_class").alias("coupling"),
        *(F.count_if(F.col("kind") == k).alias(f"kind_{k.lower()}") for k in kinds),
        F.array_join(F.array_sort(F.collect_set("dep_class")), ",").alias("dependencies"),
    )


def lcom4(method_vars: DataFrame, methods: DataFrame, calls: DataFrame, scratch: Scratch) -> DataFrame:
    """Components of a class's methods linked by a shared variable or a call.

    ``methods`` holds (class, method) with numeric method ids unique over classes,
    ``method_vars`` (class, method, var), ``calls`` (class, method, callee).
    A class without methods has none and no row.
    """
    first = method_vars.groupBy("class", "var").agg(F.min("method").alias("src"))
    by_var = method_vars.join(first, ["class", "var"]).select("src", F.col("method").alias("dst"))
    known = methods.select("class", F.col("method").alias("callee"))
    by_call = calls.join(known, ["class", "callee"], "left_semi").select(F.col("method").alias("src"), F.col("callee").alias("dst"))
    label = components(by_var.union(by_call), scratch)
    out = methods.join(label, methods["method"] == label["id"], "left").select("class", F.coalesce("component", "method").alias("component"))
    return out.groupBy("class").agg(F.count_distinct("component").alias("lcom4"))


def module_quality(complexity: DataFrame, dead: DataFrame, names: DataFrame) -> DataFrame:
    """Complexity and dead code of each path, full outer, then the module's name; what is missing counts 0."""
    both = complexity.join(dead, "file_path", "full_outer")
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in both.columns if c != "file_path"]
    return both.select("file_path", *zero).join(names, "file_path", "left")


def worst_modules(modules: DataFrame) -> list[Column]:
    """Worst first."""
    return [F.desc("high_risk"), F.desc("most"), F.desc("average"), F.desc("findings"), F.asc("file_path")]
