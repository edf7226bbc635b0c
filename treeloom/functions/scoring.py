"""Penalties, scores, grades and gates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest penalty of a category, and the largest of dependencies and architecture.
MOST, MOST_DEPENDENCY, MOST_ARCHITECTURE = 20.0, 16.0, 12.0
#: Least score of each grade, and of a healthy project.
GRADES = [("A", 90), ("B", 75), ("C", 60), ("D", 45)]
HEALTHY = 70


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def linear_penalty(value: Column, start: Column | float, saturation: Column | float) -> Column:
    """K1: nothing up to ``start``, all from ``saturation``, a line between."""
    v = value.cast("double")
    s, t = (x if isinstance(x, Column) else F.lit(float(x)) for x in (start, saturation))
    return F.when(v.isNull() | F.isnan(v) | (v <= s), 0.0).when(t <= s, MOST).otherwise(F.least(F.lit(MOST), (v - s) / (t - s) * MOST))


def whole(penalty: Column) -> Column:
    return F.round(penalty).cast("long")


def duplication_penalty(percent: Column) -> Column:
    """K2"""
    return whole(linear_penalty(percent, 0.0, 30.0))


def parse_error_penalty(failed: Column, total: Column) -> Column:
    """K3"""
    ratio = F.least(F.lit(1.0), failed / F.nullif(total, F.lit(0)))
    return F.when((failed <= 0) | (total <= 0), 0).otherwise(F.greatest(F.round(ratio * 56), F.lit(11.0))).cast("long")


def coupling_penalty(high: Column, medium: Column, classes: Column) -> Column:
    """K4"""
    ratio = (high + F.lit(0.3) * medium) / F.nullif(classes, F.lit(0))
    return F.when(classes <= 0, 0).otherwise(F.round(F.least(F.lit(MOST), ratio / 0.40 * MOST))).cast("long")


def dependency_penalty(modules: Column, cyclic: Column, depth: Column, deviation: Column) -> Column:
    """K5: cycles, depth beyond what the size explains, distance from the main sequence."""
    ratio = F.least(F.lit(1.0), cyclic / F.nullif(modules, F.lit(0)))
    cycles = F.when((cyclic > 0) & (modules > 0), F.round(F.least(F.lit(10.0), F.greatest(F.log2(cyclic + F.lit(1.0)), ratio * 10)))).otherwise(0.0)
    expected = F.greatest(F.lit(3.0), F.ceil(F.log2(modules + F.lit(1.0))).cast("double") + 1)
    deep = F.when(modules > 0, clamp(depth - expected, 0, 3)).otherwise(0.0)
    return (cycles + deep + F.when(deviation > 0, F.round(clamp(deviation, 0, 1) * 3)).otherwise(0.0)).cast("long")


def architecture_penalty(compliance: Column) -> Column:
    """K6"""
    return F.when(F.isnan(compliance), 0.0).otherwise(F.round(MOST_ARCHITECTURE * (1 - clamp(compliance, 0, 1)))).cast("long")


def normalized_penalty(penalty: Column, most: float) -> Column:
    """K7: a penalty on the scale of ``most`` brought to 20."""
    return whole(clamp(penalty / most * MOST, 0, MOST))


def penalty_score(penalty: Column, most: float = MOST) -> Column:
    """K7: 100 less the share of the penalty."""
    return whole(clamp(100 - penalty * 100.0 / most, 0, 100))


def health_score(penalties: list[Column]) -> Column:
    """K8"""
    total = sum(penalties[1:], penalties[0])
    return clamp(100 - total, 0, 100).cast("long")


def grade(score: Column) -> Column:
    """K9"""
    out = F.when(score >= GRADES[0][1], GRADES[0][0])
    for name, least in GRADES[1:]:
        out = out.when(score >= least, name)
    return out.otherwise("F")


def is_healthy(score: Column) -> Column:
    return score >= HEALTHY


def complexity_penalty(high: Column, medium: Column, functions: Column) -> Column:
    """Saturates at a twentieth of the functions."""
    return F.when(functions <= 0, 0).otherwise(whole(linear_penalty((high + F.lit(0.5) * medium) / F.nullif(functions, F.lit(0)), 0.0, 0.05)))


def dead_code_penalty(critical: Column, warning: Column, info: Column, files: Column) -> Column:
    """K11"""
    weight = critical + F.lit(0.5) * warning + F.lit(0.2) * info
    return F.when(files <= 0, 0).otherwise(whole(linear_penalty(weight / F.nullif(files, F.lit(0)), 0.0, 3.0)))


def valid_summary(counts: list[Column], ratios: list[Column]) -> Column:
    """No count is negative, every ratio lies in [0, 1]."""
    out = F.lit(True)
    for c in counts:
        out = out & (c >= 0)
    for r in ratios:
        out = out & (r >= 0) & (r <= 1)
    return out


def health_or_invalid(valid: Column, penalties: list[Column]) -> tuple[Column, Column]:
    """(score, grade); an invalid summary scores 0 and has no grade."""
    score = F.when(valid, health_score(penalties)).otherwise(0).cast("long")
    return score, F.when(valid, grade(score)).otherwise("N/A")


def fallback_score(average_complexity: Column, dead: Column, high: Column) -> Column:
    """A score from few counts."""
    score = F.lit(100) - F.when(average_complexity > 10, 10).otherwise(0) - F.when(dead > 0, 5).otherwise(0) - F.when(high > 0, 5).otherwise(0)
    return clamp(score, 0, 100).cast("long")


def project_scale(files: Column) -> Column:
    """K13"""
    return F.when(files >= 1000, "Enterprise").when(files >= 200, "Large").when(files >= 50, "Medium").when(files >= 10, "Small").otherwise("Micro")


def risk(value: Column, low: float, medium: float) -> Column:
    """C17: low, medium or high by two thresholds."""
    return F.when(value <= low, "low").when(value <= medium, "medium").otherwise("high")


def severity_rank(severity: Column) -> Column:
    """Order of severities; an unknown one is 0."""
    return F.when(severity == "critical", 3).when(severity == "warning", 2).when(severity == "info", 1).otherwise(0)


def at_least(severity: Column, least: str) -> Column:
    return severity_rank(severity) >= {"info": 1, "warning": 2, "critical": 3}[least]
