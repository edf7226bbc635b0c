"""Anti-join analyses over import and export tables, and path resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.functions.text import base_name, dir_name, stem
from treeloom.operators.graph import module_kind, reachable
from treeloom.runtime import Scratch

#: File extensions of modules, tried in this order.
EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts"]
#: Base names of entry files.
ENTRIES = ["index", "main", "app", "server"]
#: Convention files of app folders, the exports taken from each of them, and those taken from routes.
CONVENTION_FILES = ["page", "layout", "template", "loading", "error", "not-found", "default", "route"]
CONVENTION_EXPORTS = ["default", "generateMetadata", "metadata", "generateViewport", "viewport", "generateStaticParams", "dynamic", "dynamicParams", "revalidate", "fetchCache", "runtime", "preferredRegion", "maxDuration"]
ROUTE_EXPORTS = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"]


def is_entry(path: Column) -> Column:
    """P18"""
    return stem(path).isin(*ENTRIES)


def is_test(path: Column) -> Column:
    """P18"""
    return _has_part(path, "test", "spec") | path.contains("__tests__")


def is_config(path: Column) -> Column:
    """P18"""
    return _has_part(path, "config", "setup")


def _has_part(path: Column, *names: str) -> Column:
    return F.arrays_overlap(F.split(base_name(path), r"\."), F.array(*map(F.lit, names)))


def framework_reserved(path: Column, name: Column) -> Column:
    """Exports that the framework itself takes from the convention files of an app folder."""
    convention = path.contains("/app/") & stem(path).isin(*CONVENTION_FILES)
    return convention & (name.isin(*CONVENTION_EXPORTS) | ((stem(path) == "route") & name.isin(*ROUTE_EXPORTS)))


def unused_imports(imports: DataFrame, references: DataFrame) -> DataFrame:
    """Imported local names that their file never refers to; side-effect, type-only and dynamic imports are exempt."""
    named = imports.where("import_type not in ('side_effect', 'dynamic') and not is_type_only")
    return named.join(references.select("file_path", F.col("name").alias("local")).distinct(), ["file_path", "local"], "left_anti")


def unused_exports(exports: DataFrame, imported: DataFrame) -> DataFrame:
    """Exports whose name no importer of the file takes; a star import takes all; re-exports, types, ``*``, entry or test files and exports that a framework takes are exempt."""
    path = F.col("file_path")
    own = exports.where("kind not in ('reexport', 'type', 'all')").where(~is_entry(path) & ~is_test(path) & ~framework_reserved(path, F.col("name").cast("string")))
    star = imported.where("name = '*'").select("file_path").distinct()
    return own.join(star, "file_path", "left_anti").join(imported.select("file_path", "name").distinct(), ["file_path", "name"], "left_anti")


def unused_functions(exports: DataFrame, imported: DataFrame) -> DataFrame:
    """J9 for functions and classes, severity warning."""
    return unused_exports(exports.where("declaration in ('function', 'class')"), imported).withColumn("severity", F.lit("warning"))


def without_duplicates(findings: DataFrame, stronger: DataFrame) -> DataFrame:
    """Findings that a stronger finding at the same file and line does not already report."""
    return findings.join(stronger.select("file_path", "start_line").distinct(), ["file_path", "start_line"], "left_anti")


def resolve_relative(imports: DataFrame, files: DataFrame) -> DataFrame:
    """The file that a relative import means: itself, with an extension, or a directory's index, first hit in that order."""
    joined = F.concat(dir_name(F.col("file_path")), F.lit("/"), F.col("source"))
    parts = F.aggregate(
        F.split(joined, "/"),
        F.array().cast("array<string>"),
        lambda acc, p: F.when((p == ".") | (p == ""), acc).when((p == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(p))),
    )
    base = F.array_join(parts, "/")
    tried = F.array(base, *(F.concat(base, F.lit(e)) for e in EXTENSIONS), *(F.concat(base, F.lit(f"/index{e}")) for e in EXTENSIONS))
    cand = imports.select("*", F.posexplode(tried).alias("priority", "target"))
    hit = cand.join(files.select(F.col("file_path").alias("target")).distinct(), "target", "left_semi")
    keys = [c for c in imports.columns]
    best = hit.groupBy(*keys).agg(F.min_by("target", "priority").alias("target"))
    return best


def suffix_index(files: DataFrame, most: int = 5) -> DataFrame:
    """Each file under its last one to five path components."""
    parts = F.split("file_path", "/")
    cut = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(most))), lambda n: F.array_join(F.slice(parts, -n, n), "/"))
    return files.select("file_path", F.explode(cut).alias("suffix"))


def resolve_alias(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Every file whose suffix is the import's path after its alias, as given or with an extension."""
    rest = F.regexp_replace("source", r"^[@~]/", "")
    tried = F.array(rest, *(F.concat(rest, F.lit(e)) for e in EXTENSIONS), *(F.concat(rest, F.lit(f"/index{e}")) for e in EXTENSIONS))
    cand = imports.where(F.col("source").rlike("^[@~]/")).select("*", F.explode(tried).alias("suffix"))
    return cand.join(suffix_index(files).withColumnRenamed("file_path", "target"), "suffix").drop("suffix").distinct()


def import_graph(imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, name) pairs taken, and edges; namespace and side-effect imports take all, require and dynamic ones no name."""
    star = F.col("import_type").isin("namespace", "side_effect")
    names = imports.where("import_type not in ('require', 'dynamic')").select(F.col("target").alias("file_path"), F.when(star, "*").otherwise(F.col("imported")).alias("name")).distinct()
    return names, imports.select(F.col("file_path").alias("src"), F.col("target").alias("dst")).distinct()


def graph_edges(imports: DataFrame) -> DataFrame:
    """An edge for each import with weight max(1, names) and type dynamic over type_only over import."""
    kind = F.when(F.col("import_type") == "dynamic", "dynamic").when(F.col("is_type_only"), "type_only").otherwise("import")
    return imports.select(F.col("file_path").alias("src"), F.coalesce("target", "source").alias("dst"), kind.alias("edge_type"), F.greatest(F.lit(1), F.size("specifiers")).alias("weight"), F.col("target").isNull().alias("is_external"))


def orphans(files: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Files that no entry reaches; entries are entry-named files and files nobody imports, tests and configs apart."""
    path = F.col("id")
    plain = files.select(F.col("file_path").alias("id"))
    imported = edges.select(F.col("dst").alias("id")).distinct()
    named = plain.where(is_entry(path))
    free = plain.where(~is_test(path) & ~is_config(path)).join(imported, "id", "left_anti")
    seen = reachable(named.union(free), edges, scratch)
    return plain.join(seen, "id", "left_anti").where(~is_test(path) & ~is_config(path))


def type_only_lines(files: DataFrame) -> DataFrame:
    """P20: lines that begin ``import type ``."""
    return files.select("file_path", F.posexplode(F.split("content", "\n")).alias("at", "line")).where(F.ltrim("line").startswith("import type ")).select("file_path", (F.col("at") + 1).alias("line"))


def first_per_key(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def module_summary(files: DataFrame, imports: DataFrame, exports: DataFrame, builtins: list[str]) -> DataFrame:
    """A10: one row of files, imports, exports, distinct packages, and imports by kind.

    ``imports`` holds (source, import_type, is_type_only), a row for each statement.
    """
    kind = module_kind(F.col("source"), builtins)
    counted = imports.agg(
        F.count("*").alias("imports"),
        F.count_distinct(F.when(kind == "package", F.col("source"))).alias("packages"),
        *(F.count_if(kind == k).alias(f"{k}_imports") for k in ("relative", "absolute")),
        F.count_if(F.col("import_type") == "dynamic").alias("dynamic_imports"),
        F.count_if("is_type_only").alias("type_only_imports"),
        F.count_if(F.col("import_type") == "require").alias("require_imports"),
    )
    # one row each
    return files.agg(F.count("*").alias("files")).crossJoin(exports.agg(F.count("*").alias("exports"))).crossJoin(counted)
