"""Clone reports: statistics, duplication, counts by file, and the chain from candidates to classified pairs.

``pairs`` holds (id1, id2, similarity, pair_type), ``members`` (group_id, id) and ``items``
(id, file_path, ...); an id stands for one place in the sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.functions.sets import jaccard
from treeloom.operators import classify, lsh, trees
from treeloom.runtime import Scratch, ship

TYPES = (1, 2, 3, 4)


def clone_ids(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The distinct items of pairs and of groups."""
    return pairs.select(F.explode(F.array("id1", "id2")).alias("id")).union(members.select("id")).distinct()


def statistics(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """One row of pairs, groups, distinct clones, the mean similarity of pairs (0 without any) and pairs of each type."""
    by_pair = pairs.agg(F.count("*").alias("pairs"), F.coalesce(F.avg("similarity"), F.lit(0.0)).alias("average_similarity"), *(F.count_if(F.col("pair_type") == t).alias(f"type{t}") for t in TYPES))
    groups = members.agg(F.count_distinct("group_id").alias("groups"))
    # one row each
    return by_pair.crossJoin(groups).crossJoin(clone_ids(pairs, members).agg(F.count("*").alias("clones")))


def duplication_percent(clones: Column, fragments: Column) -> Column:
    """Clones of a hundred fragments; 0 without either."""
    return F.when((fragments <= 0) | (clones <= 0), 0.0).otherwise(clones.cast("double") / fragments * 100)


def clones_by_file(pairs: DataFrame, members: DataFrame, items: DataFrame) -> DataFrame:
    """Members of groups in each file, an item once for each group; without groups the distinct items of pairs."""
    if members.isEmpty():
        members = pairs.select(F.explode(F.array("id1", "id2")).alias("id")).distinct()
    return members.select("id").join(items.select("id", "file_path"), "id").groupBy("file_path").agg(F.count("*").alias("clones"))


def pattern_features(node_rows: DataFrame, patterns: list[str]) -> DataFrame:
    """(tree_id, feature): those of the named labels that a tree holds, parameters of labels apart."""
    label = F.regexp_replace("label", r"\(.*$", "")
    return node_rows.where(label.isin(*patterns)).select("tree_id", F.concat(F.lit("pattern:"), label).alias("feature")).distinct()


def features_of_pages(pages: DataFrame, patterns: list[str] = (), id: str = "page_id", html: str = "html") -> DataFrame:
    """(id, features) of parsed pages: subtrees, label sequences, labels and patterns."""
    rows = trees.nodes(pages, id, html)
    found = trees.label_features(rows).union(pages.select(F.col(id).alias("tree_id"), F.explode(trees.html_subtrees(F.col(html))).alias("feature")))
    if patterns:
        found = found.union(pattern_features(rows, list(patterns)))
    return found.groupBy(F.col("tree_id").alias("id")).agg(F.array_sort(F.collect_set("feature")).alias("features"))


def verified_pairs(pages: DataFrame, scratch: Scratch, floor: float = 0.10, patterns: list[str] = (), id: str = "page_id", html: str = "html") -> DataFrame:
    """Candidates to classified pairs (id1, id2, distance, similarity, pair_type, confidence).

    Pages whose trees are equal form a class: its least id stands for it, and each other member is
    paired with that one only.  Candidates between classes share a band of their features' signatures
    (J3); then come the size test (P3), the Jaccard floor (P6), the tree distance (N22), the
    classifier (N34) and its confidence (N35), the dearest step on the fewest pairs.  Type 0 is no copy.
    """
    ship(pages.sparkSession)
    rows = pages.where(F.col(id).isNotNull() & F.col(html).isNotNull()).select(F.col(id).alias("id"), F.col(html).alias("html"))
    tree = trees.html_tree(F.col("html"))
    shapes = rows.select("id", "html", F.sha2("html", 256).alias("text"), tree.alias("t")).select("id", "html", "text", "t.labels", "t.lml", "t.size", F.sha2(F.to_json(F.struct("t.labels", "t.lml")), 256).alias("shape"))
    shapes = scratch.cut(shapes)
    least = scratch.cut(shapes.groupBy("shape").agg(F.min_by(F.struct("id", "text"), "id").alias("first")).select("shape", F.col("first.id").alias("rep"), F.col("first.text").alias("rep_text")))
    reps = scratch.cut(shapes.join(least.select(F.col("rep").alias("id")), "id", "left_semi"))
    facts = scratch.cut(features_of_pages(reps.select("id", "html"), patterns, "id", "html").join(reps.drop("html"), "id"))
    pairs = lsh.candidates(lsh.banded(lsh.with_signature(facts.select("id", "features"), "features")))
    side = lambda n: facts.select(*(F.col(c).alias(f"{c}{n}") for c in facts.columns))
    both = pairs.join(side(1), "id1").join(side(2), "id2")
    n1, n2 = F.col("size1"), F.col("size2")
    both = both.where(classify.comparable(n1, n2, n1, n2)).withColumn("syntactic", jaccard(F.col("features1"), F.col("features2")))
    both = both.where(classify.passes_jaccard(F.col("syntactic"), n1, n2, floor))
    both = both.withColumn("distance", trees.tree_distance("labels1", "lml1", "labels2", "lml2")).select("id1", "id2", "distance", "syntactic", "size1", "size2", (F.col("text1") == F.col("text2")).alias("same"))
    equal = shapes.join(least, "shape").where("id <> rep").select(F.col("rep").alias("id1"), F.col("id").alias("id2"), F.lit(0.0).alias("distance"), F.lit(1.0).alias("syntactic"), F.col("size").alias("size1"), F.col("size").alias("size2"), (F.col("text") == F.col("rep_text")).alias("same"))
    both = scratch.cut(both.union(equal))
    kind, value = classify.classify(trees.similarity(F.col("distance"), n1, n2), F.col("same"), F.col("syntactic"))
    out = both.select("id1", "id2", "distance", value.alias("similarity"), kind.cast("int").alias("pair_type"), "size1", "size2")
    return out.withColumn("confidence", classify.confidence(F.col("similarity"), n1, n2, F.lit(0), F.lit(0))).drop("size1", "size2")
