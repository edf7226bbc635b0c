"""Paired comparison of outcomes."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.functions.udf import pandas_udf


def paired_counts(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cells of a paired two by two table; b counts only the first, c only the second."""
    x, y = F.col(a), F.col(b)
    return pairs.agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("b"), F.count_if(~x & y).alias("c"), F.count_if(~x & ~y).alias("neither"))


@pandas_udf("double")
def mcnemar_exact(b: pd.Series, c: pd.Series) -> pd.Series:
    """Two-sided binomial tail of the discordant pairs; 1 without any."""

    def tail(x: int, y: int) -> float:
        n, k = x + y, min(x, y)
        if n == 0:
            return 1.0
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
        return min(1.0, 2 * sum(math.exp(v) for v in logs))

    return pd.Series([tail(int(x), int(y)) for x, y in zip(b, c)], dtype="float64")


def bonferroni(p, tests: int):
    return F.least(F.lit(1.0), p * tests)


def function_deltas(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Matched rows with their change, new rows and removed rows."""
    a = before.select(*keys, F.col(value).alias("before"))
    b = after.select(*keys, F.col(value).alias("after"))
    status = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "removed").otherwise("matched")
    return a.join(b, keys, "full_outer").select(*keys, status.alias("status"), "before", "after", (F.col("after") - F.col("before")).alias("delta"))
