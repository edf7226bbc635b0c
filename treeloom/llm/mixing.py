"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells (source, language, topic) of tokens.  Each sweep rakes the
cell weights to the target share of every margin in turn; after the last sweep a cell's
ratio of raked to own weight is the relative rate of its documents.  Rates are scaled so
that the largest expected token count is reached at which no probability exceeds one (or to
a given budget), and a document is kept when a hash of its id, uniform in [0, 1), falls
below its cell's probability, so runs agree and copies of a row are kept or left together.

Everything is DataFrame operations: one grouped aggregation over documents, window sums over
the cells, and one join back.  The cells are broadcast only when their counted number is
within ``BROADCAST_CELLS``; beyond that documents are salted against them.  Sweeps are cut
by tables in the shared folder.

Defined cases: null text has no tokens; a null source, language or topic is a value of its
own; a value without a target keeps its present share; targets of absent values are left
out and the rest scaled; a cell without tokens has the rate of its margins, and a corpus
without tokens keeps every document; repeated rows share their fate; a null id hashes as a
value; an empty table gives no rows; columns that share a name with a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.runtime import Scratch

BROADCAST_CELLS = 100_000
SALT = 64
SWEEPS = 12
#: Margins: a list of (column, targets); targets are {value: share} or an exponent that tempers
#: the present shares: 1 keeps them, 0 makes them equal.
Margins = list[tuple[str, "dict[str, float] | float"]]

DEFAULT_SOURCES = 0.75
DEFAULT_LANGS = {"en": 0.55, "fr": 0.17, "de": 0.17, "es": 0.11}
DEFAULT_TOPICS = 0.9


def tokens(text: Column) -> Column:
    """White-space separated tokens: places where a token begins."""
    t = F.coalesce(text, F.lit(""))
    return F.regexp_count(t, F.lit(r"[^ \t\n\x0b\f\r]+")).cast("long")


def topic(text: Column) -> Column:
    """A coarse topic from the whole text: licence and code references, listings with many lines, prose."""
    t = F.coalesce(text, F.lit(""))
    lines = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    return F.when(F.lower(t).contains("license"), "reference").when(lines * 200 > F.length(t), "listing").otherwise("prose")


def _rake(cells: DataFrame, margins: Margins, weight: str) -> DataFrame:
    """One sweep: scale the weights to each margin's targets in turn; a value without a target keeps its share."""
    for column, targets in margins:
        by = Window.partitionBy(column)
        share = F.sum(weight).over(by)
        goal = F.col(f"goal_{column}")
        cells = cells.withColumn("__share", share).withColumn(weight, F.when(F.col("__share") > 0, F.col(weight) * goal / F.col("__share")).otherwise(F.col(weight))).drop("__share")
    return cells


def cell_rates(cells: DataFrame, margins: Margins, scratch: Scratch, sweeps: int = SWEEPS) -> DataFrame:
    """Cells (margin columns and own share ``w0``) with the raked share ``w``."""
    out = cells.withColumn("w", F.col("w0"))
    for column, targets in margins:
        present = out.groupBy(column).agg(F.sum("w0").alias("__now"))
        if isinstance(targets, dict):
            pairs = [x for k, v in targets.items() for x in (F.lit(k), F.lit(float(v)))]
            wish = F.try_element_at(F.create_map(*pairs), F.col(column))
        else:
            wish = F.pow(F.col("__now"), F.lit(float(targets)))
        # shares that have no target are kept; the targets present fill the rest
        row = present.select(column, "__now", F.when(F.col("__now") > 0, wish).alias("__wish"))
        sums = row.agg(F.sum(F.when(F.col("__wish").isNull(), F.col("__now"))).alias("kept"), F.sum("__wish").alias("wished")).first()
        kept, wished = float(sums["kept"] or 0.0), float(sums["wished"] or 0.0)
        goal = F.coalesce(F.col("__wish") * F.lit((1.0 - kept) / wished if wished > 0 else 1.0), F.col("__now"))
        goals = row.select(F.col(column).alias("__v"), goal.alias(f"goal_{column}"))
        out = out.join(goals, F.col(column).eqNullSafe(F.col("__v")), "left").drop("__v")
    out = scratch.cut(out)
    done = 0
    while done < sweeps:
        step = min(4, sweeps - done)
        new = out
        for _ in range(step):
            new = _rake(new, margins, "w")
        new = scratch.cut(new)
        scratch.drop(out)
        out, done = new, done + step
    return out


def uniform(doc: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from 52 bits of the id's digest."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(
    documents: DataFrame,
    margins: Margins,
    doc: str = "doc_id",
    text: str = "text",
    topics: Column | None = None,
    budget: float | None = None,
    seed: int = 0,
    keep: list[str] | None = None,
    sweeps: int = SWEEPS,
) -> DataFrame:
    """``keep`` columns with tokens, topic, probability and selected of each document."""
    spark = documents.sparkSession
    scratch = Scratch(spark)
    keep = list(documents.columns if keep is None else keep)
    made = ["tokens", "topic", "probability", "selected"]
    columns = [c for c, _ in margins]
    kept = [c for c in keep if c not in made]
    top = (topic(F.col(text)) if topics is None else topics).alias("topic")
    rows = documents.select(*(f"`{c}`" for c in kept), *(F.col(c).alias(f"__{c}") for c in columns if c != "topic"), tokens(F.col(text)).alias("tokens"), top, F.col(doc).alias("__doc"))
    names = {c: (c if c == "topic" else f"__{c}") for c in columns}
    counted = scratch.cut(documents.select(*(F.col(c) for c in columns if c != "topic"), tokens(F.col(text)).alias("tokens"), top).groupBy(*columns).agg(F.sum("tokens").cast("double").alias("n")))
    size = counted.agg(F.count("*"), F.sum("n")).first()
    total = float(size[1] or 0.0)
    cells = counted.withColumn("w0", F.col("n") / F.lit(total or 1.0))
    raked = cell_rates(cells, margins, scratch, sweeps) if total > 0 else cells.withColumn("w", F.lit(1.0)).withColumn("w0", F.lit(1.0))
    rates = raked.select(*columns, "n", F.when(F.col("w0") > 0, F.col("w") / F.col("w0")).otherwise(F.lit(0.0)).alias("rate"))
    top_rate = float(rates.agg(F.max("rate")).first()[0] or 1.0)
    scale = 1.0 / top_rate if top_rate > 0 else 1.0
    if budget is not None and total > 0:
        scale = _scale_for(rates, budget, scale)
    # a cell whose documents have no tokens costs nothing; it is kept
    chance = rates.select(*(F.col(c).alias(f"__c_{c}") for c in columns), F.when(F.col("n") > 0, F.round(F.least(F.lit(1.0), F.col("rate") * scale), 9)).otherwise(F.lit(1.0)).alias("probability"))
    on = F.lit(True)
    for c in columns:
        on = on & F.col(names[c]).eqNullSafe(F.col(f"__c_{c}"))
    if size[0] <= BROADCAST_CELLS:
        found = rows.join(F.broadcast(chance), on)
    else:
        salted = chance.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        found = rows.withColumn("__r", F.pmod(F.xxhash64("__doc"), F.lit(SALT)).cast("int")).join(salted, on & (F.col("__r") == F.col("__s")))
    chosen = uniform(F.col("__doc"), seed) < F.col("probability")
    return found.select(*(f"`{c}`" for c in kept), "tokens", "topic", "probability", chosen.alias("selected"))


def _scale_for(rates: DataFrame, budget: float, least: float) -> float:
    """The scale whose expected tokens, with probabilities cut at one, meet the budget: bisection on cell sums."""
    low, high = 0.0, least * 1e6
    for _ in range(40):
        mid = (low + high) / 2
        got = rates.agg(F.sum(F.col("n") * F.least(F.lit(1.0), F.col("rate") * mid))).first()[0] or 0.0
        low, high = (mid, high) if got < budget else (low, mid)
    return low


def default_margins() -> Margins:
    """Tempered sources and topics, fixed shares of languages."""
    return [("source", DEFAULT_SOURCES), ("lang", DEFAULT_LANGS), ("topic", DEFAULT_TOPICS)]


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_margins(), keep=["doc_id", "source", "lang"])


def _sql(sweeps: int = SWEEPS) -> str:
    wish = lambda column, t: f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in t.items()) + " END"
    goals = {"source": f"pow(sum(w0), {DEFAULT_SOURCES})", "lang": wish("lang", DEFAULT_LANGS), "topic": f"pow(sum(w0), {DEFAULT_TOPICS})"}
    out = [
        "WITH d AS MATERIALIZED (SELECT doc_id, source, lang, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0b\\f\\r]+')) AS BIGINT) AS tokens, "
        "CASE WHEN contains(lower(coalesce(text, '')), 'license') THEN 'reference' WHEN (length(text) - length(replace(text, chr(10), ''))) * 200 > length(text) THEN 'listing' ELSE 'prose' END AS topic FROM documents)",
        "c AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS n FROM d GROUP BY ALL)",
        "c0 AS MATERIALIZED (SELECT *, n / (SELECT sum(n) FROM c) AS w0, n / (SELECT sum(n) FROM c) AS w FROM c)",
    ]
    for column, goal in goals.items():
        out.append(f"n_{column} AS MATERIALIZED (SELECT {column} AS v, sum(w0) AS now, CASE WHEN sum(w0) > 0 THEN CAST({goal} AS DOUBLE) END AS wish FROM c0 GROUP BY {column})")
        out.append(f"g_{column} AS MATERIALIZED (SELECT v, coalesce(wish * (1.0 - coalesce((SELECT sum(now) FROM n_{column} WHERE wish IS NULL), 0.0)) / (SELECT sum(wish) FROM n_{column}), now) AS goal FROM n_{column})")
    last = "c0"
    for i in range(sweeps):
        for column in goals:
            new = f"r{i}_{column}"
            out.append(f"{new} AS MATERIALIZED (SELECT source, lang, topic, n, w0, CASE WHEN s > 0 THEN w * goal / s ELSE w END AS w FROM (SELECT x.*, goal, sum(w) OVER (PARTITION BY x.{column}) AS s FROM {last} x JOIN g_{column} g ON x.{column} IS NOT DISTINCT FROM g.v))")
            last = new
    out.append(f"r AS MATERIALIZED (SELECT *, CASE WHEN w0 > 0 THEN w / w0 ELSE 0 END AS rate FROM {last})")
    out.append("p AS MATERIALIZED (SELECT source, lang, topic, CASE WHEN n > 0 THEN round(least(1.0, rate * (1.0 / (SELECT max(rate) FROM r))), 9) ELSE 1.0 END AS probability FROM r)")
    return ",\n".join(out) + (
        "\nSELECT d.doc_id, d.source, d.lang, d.tokens, d.topic, CAST(probability AS DOUBLE) AS probability, "
        "CAST(('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) / 4503599627370496.0 < probability AS selected "
        "FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.lang IS NOT DISTINCT FROM p.lang AND d.topic = p.topic"
    )


OP7_SQL = _sql()
