"""A sieve of fixed size before a join on ids, so that rows which cannot match are never shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the sieve; it is broadcast as at most 2**18 words of 64 bits, however many ids there are.
BITS = 24


def sifted(rows: DataFrame, column: str, ids: DataFrame, out: str = "__near") -> DataFrame:
    """``rows`` with a boolean ``out``: false proves that the id in ``column`` is not among the ids of
    the one column of ``ids``; true leaves it open, the more often the more ids there are.

    Ids are compared as integers.  Null is compared as a value.  A join that decides must follow.
    """
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(1 << BITS))
    named = ids.select(place(ids.columns[0]).alias("p"))
    words = named.groupBy(F.expr("shiftright(p, 6)").alias("__word")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("__bits"))
    marked = rows.withColumn("__place", place(column)).withColumn("__word", F.expr("shiftright(__place, 6)")).join(F.broadcast(words), "__word", "left")
    hit = F.expr("coalesce(shiftrightunsigned(__bits, cast(__place & 63 as int)) & 1, 0L) = 1L")
    return marked.select(*(f"`{c}`" for c in rows.columns), hit.alias(out))
