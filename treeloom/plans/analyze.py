"""The five analyses of a project as frames, and the commands that write them.

``snapshot`` parses every file once; each analysis reads its columns only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions import scoring as S
from treeloom.functions import text
from treeloom.operators import clones, flow, graph, imports, lsh, metrics
from treeloom.runtime import Scratch
from treeloom.sources import scripts
from treeloom.sources.config import Config

#: Names that count as built-in modules, and as built-in types.
BUILTINS = ["assert", "buffer", "child_process", "cluster", "crypto", "dns", "events", "fs", "http", "http2", "https", "module", "net", "os", "path", "perf_hooks", "process", "querystring", "readline", "stream", "string_decoder", "timers", "tls", "tty", "url", "util", "v8", "vm", "worker_threads", "zlib"]
BUILTIN_TYPES = ["Array", "Boolean", "Date", "Error", "Function", "Map", "Number", "Object", "Promise", "Proxy", "RegExp", "Set", "String", "Symbol", "WeakMap", "WeakSet"]


class Project:
    """A parsed project; its snapshot is a table in the shared folder, read by all analyses."""

    def __init__(self, spark: SparkSession, files: DataFrame, config: Config = Config()):
        self.spark, self.config = spark, config
        self.scratch = Scratch(spark)
        self.snapshot = self.scratch.cut(scripts.parsed(files))

    def _rows(self, column: str) -> DataFrame:
        return scripts.table_of(self.snapshot, column)

    def functions(self) -> DataFrame:
        c = self.config.complexity
        return self._rows("functions").withColumn("risk_level", S.risk(F.col("complexity"), c.low, c.medium))

    def complexity(self) -> dict[str, DataFrame]:
        f = self.functions()
        return {"functions": f.orderBy(F.desc("complexity"), "file_path", "start_line", "name"), "summary": metrics.complexity_summary(f), "modules": metrics.by_module(f), "directories": metrics.by_directory(f)}

    def resolved(self) -> DataFrame:
        """Imports with the file each relative path means; others have no target."""
        rows = self._rows("imports")
        asked = rows.where(F.col("source").rlike(r"^\.\.?(/|$)")).select("file_path", "source").distinct()
        found = imports.resolve_relative(asked, self.snapshot.select("file_path"))
        return rows.join(found, ["file_path", "source"], "left")

    def edges(self) -> DataFrame:
        """One edge for each import statement, weighted by its names."""
        r = self.resolved().groupBy("file_path", "source", "line", "target").agg(F.collect_list("imported").alias("specifiers"), F.bool_and(F.col("import_type") == "dynamic").alias("d"), F.bool_and("is_type_only").alias("is_type_only"))
        return imports.graph_edges(r.withColumn("import_type", F.when(F.col("d"), "dynamic").otherwise("static")))

    def dependencies(self) -> dict[str, DataFrame]:
        edges = self.scratch.cut(self.edges())
        inner = edges.where("not is_external")
        live = graph.load_time(inner).select("src", "dst")
        nodes = self.snapshot.select(F.col("file_path").alias("id"))
        scc = self.scratch.cut(graph.scc(self._numbered(nodes), self._numbered_edges(live), self.scratch))
        exports = self._rows("exports").groupBy(F.col("file_path").alias("id")).agg(F.count("*").alias("n"))
        a = exports.select("id", graph.abstractness(F.col("n")).alias("abstractness"))
        m = graph.coupling(inner.select("src", "dst"), a, distinct_edges=False)
        m = m.withColumn("zone", graph.zone(F.col("ca"), F.col("instability"), F.col("abstractness"), F.col("distance"))).withColumn("risk", graph.module_risk(F.col("ca") + F.col("ce"), F.col("distance")))
        names = self._names(nodes)
        members = scc.join(names, "id").withColumn("n", F.expr("count(*) over (partition by component)")).where("n > 1")
        dag = graph.condensation(scc, self._numbered_edges(live))
        chains = graph.longest_chains(scc.select("id", "component"), dag, self.scratch)
        return {"edges": edges, "chains": chains, "modules": m, "cycles": members.select("component", "name", "n"), "orphans": imports.orphans(self.snapshot.select("file_path"), inner, self.scratch)}

    def _names(self, nodes: DataFrame) -> DataFrame:
        return nodes.select(F.xxhash64("id").alias("id"), F.col("id").alias("name"))

    def _numbered(self, nodes: DataFrame) -> DataFrame:
        return nodes.select(F.xxhash64("id").alias("id"))

    def _numbered_edges(self, edges: DataFrame) -> DataFrame:
        return edges.select(F.xxhash64("src").alias("src"), F.xxhash64("dst").alias("dst"))

    def dead_code(self) -> dict[str, DataFrame]:
        found = self._rows("findings").select("file_path", "start_line", "end_line", "reason", S.severity_rank(F.col("severity")).alias("severity"), F.col("reason").alias("description"))
        inside = flow.merge_contiguous(found)
        imported = self._rows("imports")
        unused = imports.unused_imports(imported.where("local <> ''"), self._rows("refs"))
        taken, _ = imports.import_graph(self.resolved().where("target is not null and import_type <> 'reexport'"))
        passed = self.resolved().where("target is not null and import_type = 'reexport'").select(F.col("target").alias("file_path"), F.lit("*").alias("name"))
        taken = taken.union(passed)
        functions = imports.unused_functions(self._rows("exports"), taken)
        exports = imports.unused_exports(self._rows("exports"), taken)
        line = lambda f: f.withColumnRenamed("line", "start_line")
        return {"statements": inside, "imports": unused, "functions": functions, "exports": imports.without_duplicates(line(exports), line(functions)).withColumnRenamed("start_line", "line")}

    def coupling(self) -> DataFrame:
        """Distinct dependencies of a file: packages and files imported, classes made or extended."""
        made = self._rows("classes").where(~F.col("dep").isin(*BUILTIN_TYPES)).select(F.col("file_path").alias("class"), "dep", "kind")
        local = self._rows("imports").where("local <> ''").select(F.col("file_path").alias("class"), F.col("local").alias("dep"), F.col("source")).distinct()
        named = made.join(local, ["class", "dep"], "left").select("class", F.coalesce("source", "dep").alias("dep_class"), "kind")
        taken = self._rows("imports").select(F.col("file_path").alias("class"), F.col("source").alias("dep_class"), F.lit("import").alias("kind"))
        out = metrics.class_coupling(named.union(taken.distinct()), ["import", "instantiation", "inheritance"])
        return out.withColumn("risk_level", S.risk(F.col("coupling"), self.config.coupling.low, self.config.coupling.medium))

    def _fragments(self) -> DataFrame:
        """Functions large enough to be compared."""
        c = self.config.clones
        return self._rows("functions").where((F.col("end_line") - F.col("start_line") + 1 >= c.least_lines) & (F.col("node_count") >= c.least_nodes))

    def modules(self) -> DataFrame:
        """A10"""
        made = self._rows("imports").groupBy("file_path", "source", "line").agg(F.min("import_type").alias("import_type"), F.bool_and("is_type_only").alias("is_type_only"))
        return imports.module_summary(self.snapshot, made, self._rows("exports"), BUILTINS)

    def clones(self) -> DataFrame:
        """Near-duplicate functions by 4-gram shingles of normalised lines."""
        lines = self.snapshot.select("file_path", F.split("content", "\n").alias("lines"))
        spans = self._fragments()
        cut = spans.join(lines, "file_path").select(F.xxhash64("file_path", "start_line", "name").alias("id"), F.array_join(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n").alias("content"))
        words = cut.select("id", F.explode(F.array(F.filter(F.split(text.strip_comments(F.col("content")), r"\W+"), lambda w: w != ""))).alias("w"))
        named = spans.select(F.xxhash64("file_path", "start_line", "name").alias("id"), F.concat_ws(":", "file_path", "start_line", "name").alias("place"))
        pairs = lsh.near_duplicates(words.select("id", F.array_sort(F.array_distinct(text.shingles(F.col("w"), 4))).alias("features")), self.config.clones.similarity)
        return pairs.join(named.toDF("id1", "place1"), "id1").join(named.toDF("id2", "place2"), "id2").select("place1", "place2", "jaccard")

    def summary(self, compliance: float = 1.0) -> DataFrame:
        """One row of totals, all seven penalties, score and grade from the analyses' one-row summaries.

        ``compliance`` is the share of architecture rules that hold; no rules are checked here, so by default all do.
        """
        f = self.functions().agg(F.count("*").alias("functions"), F.coalesce(F.avg("complexity"), F.lit(0.0)).alias("average_complexity"), F.count_if(F.col("risk_level") == "high").alias("high"), F.count_if(F.col("risk_level") == "medium").alias("medium"))
        files = self.snapshot.agg(F.count("*").alias("files"), F.count("parse_error").alias("failed"))
        d = self.dead_code()
        dead = d["statements"].agg(F.count_if(F.col("severity") == 3).alias("critical"), F.count_if(F.col("severity") == 2).alias("warning"), F.count_if(F.col("severity") == 1).alias("info"))
        unused = d["functions"].agg(F.count("*").alias("unused_functions"))
        c = self.coupling().agg(F.count("*").alias("classes"), F.count_if(F.col("risk_level") == "high").alias("high_coupling"), F.count_if(F.col("risk_level") == "medium").alias("medium_coupling"))
        pairs = self.clones().select(F.col("place1").alias("id1"), F.col("place2").alias("id2"))
        fragments = self._fragments().agg(F.count("*").alias("fragments"))
        copied = pairs.select(F.explode(F.array("id1", "id2")).alias("id")).distinct().agg(F.count("*").alias("clones"))
        deps = self.dependencies()
        deepest = deps["chains"].agg(F.coalesce(F.max("length") - 1, F.lit(0)).alias("depth"))
        cyc = deps["cycles"].agg(F.count_distinct("name").alias("in_cycles"))
        msd = deps["modules"].agg(F.coalesce(F.avg("distance"), F.lit(0.0)).alias("deviation"))
        row = files
        for part in (f, dead, unused, c, cyc, msd, fragments, copied, deepest):  # one row each
            row = row.crossJoin(part)
        col = F.col
        penalties = [
            S.complexity_penalty(col("high"), col("medium"), col("functions")),
            S.dead_code_penalty(col("critical"), col("warning") + col("unused_functions"), col("info"), col("files")),
            S.coupling_penalty(col("high_coupling"), col("medium_coupling"), col("classes")),
            S.duplication_penalty(clones.duplication_percent(col("clones"), col("fragments"))),
            S.dependency_penalty(col("files"), col("in_cycles"), col("depth"), col("deviation")),
            S.architecture_penalty(F.lit(compliance)),
            S.parse_error_penalty(col("failed"), col("files")),
        ]
        valid = S.valid_summary([col("functions"), col("files")], [])
        score, grade = S.health_or_invalid(valid, penalties)
        return row.withColumn("score", score).withColumn("grade", grade).withColumn("scale", S.project_scale(col("files")))

    def check(self, most: int = 19, cycles: int = 0) -> DataFrame:
        """Violations of the limits; none is a pass."""
        f = self.functions().where(F.col("complexity") > most).select(F.lit("complexity").alias("category"), F.concat_ws(":", "file_path", "start_line").alias("location"), F.col("complexity").cast("long").alias("actual"), F.lit(most).cast("long").alias("threshold"))
        d = self.dead_code()["statements"].select(F.lit("dead_code").alias("category"), F.concat_ws(":", "file_path", "start_line").alias("location"), F.lit(1).cast("long").alias("actual"), F.lit(0).cast("long").alias("threshold"))
        n = self.dependencies()["cycles"].agg(F.count_distinct("component").alias("actual")).where(F.col("actual") > cycles).select(F.lit("cycles").alias("category"), F.lit("").alias("location"), "actual", F.lit(cycles).cast("long").alias("threshold"))
        return f.union(d).union(n)
