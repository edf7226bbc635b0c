"""Pair filters and the pair classifier as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Thresholds:
    """Least similarity of exact, renamed, modified and semantic copies."""

    exact: float = 0.85
    renamed: float = 0.75
    modified: float = 0.70
    semantic: float = 0.65


def comparable(n1: Column, n2: Column, l1: Column, l2: Column) -> Column:
    """Sizes within half their mean, and lines not half apart from both sides."""
    sizes = F.abs(n1 - n2) / ((n1 + n2) / 2.0) <= 0.5
    lines = F.abs(l1 - l2)
    return sizes & ~((lines > 0.5 * l1) & (lines > 0.5 * l2))


def overlaps(file1: Column, start1: Column, end1: Column, file2: Column, start2: Column, end2: Column) -> Column:
    """Inclusive line ranges of one file that intersect."""
    return (file1 == file2) & (start1 <= end2) & (start2 <= end1)


def covers(outer_start: list[Column], outer_end: list[Column], inner_start: list[Column], inner_end: list[Column]) -> Column:
    """P5: (line, column) containment."""
    return (F.struct(*outer_start) <= F.struct(*inner_start)) & (F.struct(*outer_end) >= F.struct(*inner_end))


def passes_jaccard(j: Column, n1: Column, n2: Column, floor: float = 0.10) -> Column:
    """Items without features always pass, and so does all at floor 0."""
    return F.lit(True) if floor <= 0 else (n1 == 0) | (n2 == 0) | (j >= floor)


def large_enough(size: Column, lines: Column, least_nodes: int = 10, least_lines: int = 5) -> Column:
    """P2"""
    return (size >= least_nodes) & (lines >= least_lines)


def classify(structural: Column, same_text: Column, syntactic: Column, t: Thresholds = Thresholds(), enabled: tuple[int, ...] = (1, 2, 3, 4)) -> tuple[Column, Column]:
    """(type, similarity); type 0 is no copy.

    Exact copies need equal text; without it the structural score is capped just below that
    class.  Renamed copies score the lesser of structure and syntax.
    """
    cap = max(math.nextafter(t.exact, 0.0), t.renamed) if 1 in enabled else 1.0
    capped = F.least(structural, F.lit(cap)) if 1 in enabled else structural
    exact = (structural >= t.exact) & same_text if 1 in enabled else F.lit(False)
    renamed = (capped >= t.renamed) & (syntactic >= t.renamed) if 2 in enabled else F.lit(False)
    modified = capped >= t.modified if 3 in enabled else F.lit(False)
    semantic = capped >= t.semantic if 4 in enabled else F.lit(False)
    kind = F.when(exact, 1).when(renamed, 2).when(modified, 3).when(semantic, 4).otherwise(0)
    value = F.when(exact, structural).when(renamed, F.least(capped, syntactic)).otherwise(capped)
    return kind, value


def confidence(similarity: Column, size1: Column, size2: Column, complexity1: Column, complexity2: Column) -> Column:
    """N35"""
    top = F.greatest(complexity1, complexity2)
    alike = F.when((complexity1 > 0) & (complexity2 > 0), F.least(complexity1, complexity2) / top * 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), similarity + F.least((size1 + size2) / 2.0 / 100.0, F.lit(0.2)) + alike)


def significant(similarity: Column, distance: Column, kind: Column, size1: Column, size2: Column, least: float = 0.0, most_distance: float = 50.0, least_nodes: int = 10, t: Thresholds = Thresholds()) -> Column:
    """The distance limit does not bind semantic copies."""
    return (similarity >= (least or t.semantic)) & ((distance <= most_distance) | (kind == 4)) & (F.least(size1, size2) >= least_nodes)


def reported(similarity: Column, kind: Column, kinds: tuple[int, ...] = (1, 2, 4), least: float = 0.0, most: float = 0.0) -> Column:
    """Enabled types (none: all) within bounds; an upper bound of 0 or less is none."""
    out = similarity >= least
    if kinds:
        out = out & kind.isin(*kinds)
    return out & (similarity <= most) if most > 0 else out


def top_pairs(pairs: DataFrame, limit: int = 10_000) -> DataFrame:
    """The report's first pairs in its total order."""
    return pairs.orderBy(F.desc("similarity"), "id1", "id2").limit(limit)
