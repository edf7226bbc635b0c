"""File sources: collection by globs, snapshots with parse errors, line-delimited records."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions.text import base_name, matches_any, path_glob_regex
from treeloom.operators.trees import parse_html
from treeloom.runtime import ship

#: File extensions of scripts.
SCRIPTS = (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".mts", ".cts")


def collect(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, recursive: bool = True) -> DataFrame:
    """(path, content) of files under a folder whose base name matches an include and no exclude pattern."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    name = base_name(F.col("path"))
    keep = matches_any(name, include) if include else F.lit(True)
    drop = matches_any(name, exclude) if exclude else F.lit(False)
    return files.where(keep & ~drop).select("path", F.decode("content", "UTF-8").alias("content")).dropDuplicates(["path"])


def ignore_patterns(gitignore: str) -> list[str]:
    """S3: the patterns of a .gitignore; comments and negations are left out."""
    lines = (x.strip() for x in gitignore.splitlines())
    return [x for x in lines if x and x[0] not in "#!"]


def is_script(path: Column) -> Column:
    out = F.lit(False)
    for e in SCRIPTS:
        out = out | F.lower(path).endswith(e)
    return out


def scripts(files: DataFrame, root: str, include: list[str] | None = None, exclude: list[str] | None = None, gitignore: str = "") -> DataFrame:
    """Script files by path patterns relative to the root, without regard to case."""
    inner = F.lower(F.regexp_replace("path", "^" + _quoted(root.rstrip("/")) + "/", ""))
    drop = [*(exclude or []), *ignore_patterns(gitignore)]
    keep = matches_any(inner, include, path_glob_regex) if include else F.lit(True)
    return files.where(is_script(F.col("path")) & keep & ~(matches_any(inner, drop, path_glob_regex) if drop else F.lit(False)))


def _quoted(text: str) -> str:
    import re

    return re.escape(text)


def snapshot(files: DataFrame, parse: Callable[[str], object] = parse_html) -> DataFrame:
    """(path, content, parse_error); a file that fails to parse is recorded and never ends the run.

    Persist the result to share one parse between analyses.
    """
    ship(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            errors = []
            for text in frame["content"]:
                try:
                    parse(text or "")
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  any failure of a parser is that file's result
                    errors.append(f"{type(e).__name__}: {e}")
            yield frame.assign(parse_error=errors)

    return files.select("path", "content").mapInPandas(run, "path string, content string, parse_error string")


def records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(metadata, records) of line-delimited JSON, gzipped or not; metadata rows carry ``"type": "metadata"``."""
    rows = spark.read.json(path)
    if "type" not in rows.columns:
        return rows.limit(0), rows
    return rows.where("type = 'metadata'"), rows.where("type is null or type <> 'metadata'")
