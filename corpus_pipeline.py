"""The corpus pipeline: quality, near duplicates, decontamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result to
the shared folder and reads it back as the next stage's documents, so a lost executor costs at
most one stage's tasks.  All stages but the last return the columns of documents.

Defined cases follow the operators: null and empty texts pass every filter they cannot be
judged by, rows with a null id are never near duplicates, rows that share an id are one
document, and extra columns travel along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeloom.llm import decontamination, mixing, ngram_join, quality, secrets
from treeloom.operators.sift import sifted
from treeloom.runtime import Scratch, table

#: SQL cannot express the trained stages; each stage is tested against a brute-force version.
ORACLE_SQL = None


def _same(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    plain = docs.withColumnsRenamed({c: f"__own_{c}" for c in docs.columns if c not in ("doc_id", "text", "source", "lang")})
    scored = quality.score(plain, model)
    return scored.where("accepted").withColumnsRenamed({f"__own_{c}": c for c in docs.columns}).select(*_same(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links at five words and a similarity of 0.8: the one with the least id."""
    found = Scratch(spark).cut(ngram_join.classes(docs, k=5, part=80))
    ids = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.min(F.expr("doc_id = component_id")).alias("stays"))
    # only rows that go or share an id are joined; a sieve of fixed size lets the others pass in place
    open_rows = F.col("__near") & F.col("doc_id").isNotNull()
    marked = sifted(docs, "doc_id", ids.where("rows > 1 or not stays").select("doc_id"))
    rows = marked.where(open_rows).drop("__near").join(ids.where("stays").select("doc_id"), "doc_id", "left_semi")
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where("__n = 1").drop("__n")
    return marked.where(~open_rows).drop("__near").unionByName(first).select(*_same(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    plain = docs.withColumnsRenamed({c: f"__own_{c}" for c in docs.columns if c not in ("doc_id", "text")})
    found = decontamination.decontaminate(plain, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("hit_items") == 0).withColumnsRenamed({f"__own_{c}": c for c in docs.columns}).select(*_same(docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every finding in a text is replaced by ``<secret>``."""
    plain = docs.withColumnsRenamed({c: f"__own_{c}" for c in docs.columns if c not in ("doc_id", "text")})
    found = secrets.find_secrets(plain).withColumnsRenamed({"secrets": "__found"} | {f"__own_{c}": c for c in docs.columns})
    hit = F.size("__found") > 0
    out = found.withColumn("text", secrets.mask(F.col("text"), F.col("__found")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*_same(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that expected tokens meet the target shares."""
    return mixing.mix(docs, mixing.default_margins()).where("selected").drop("selected")


STAGES = [
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    before = None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.cut(docs)
            if before is not None:
                scratch.drop(before)
            scratch.release()
            before = docs
    return docs
