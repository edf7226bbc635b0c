"""Queries of projections, joins, rollups, scores and rankings, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from treeloom.functions import scoring as S
from treeloom.functions import sets, text
from treeloom.operators import classify, flow, graph, imports, metrics, stats
from treeloom.plans import frames as R
from treeloom.runtime import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


r6 = lambda c: F.round(c, 6)


# -- rollups (A1-A13) and module joins


@query(f"WITH {R.FUNCTIONS} SELECT file_path, count(*) AS functions, CAST(sum(complexity) AS BIGINT) AS total, round(sum(complexity) / count(*), 6) AS average, max(complexity) AS most, count(*) FILTER (WHERE risk_level = 'high') AS high_risk, CAST(sum(handlers) AS BIGINT) AS handlers FROM functions GROUP BY file_path")
def rollup_complexity_by_module(spark, d):
    """A1"""
    return metrics.by_module(R.functions(spark, d)).withColumn("average", r6(F.col("average")))


@query(f"WITH {R.FUNCTIONS} SELECT directory, count(*) AS functions, round(avg(complexity), 6) AS average, max(complexity) AS most, round(avg(nesting), 6) AS average_nesting, max(nesting) AS most_nesting FROM functions GROUP BY directory")
def rollup_complexity_by_directory(spark, d):
    """A2"""
    out = metrics.by_directory(R.functions(spark, d))
    return out.withColumn("average", r6(F.col("average"))).withColumn("average_nesting", r6(F.col("average_nesting")))


@query(f"WITH {R.FUNCTIONS} SELECT count(*) AS functions, round(avg(complexity), 6) AS average, min(complexity) AS least, max(complexity) AS most, count(*) FILTER (WHERE risk_level = 'low') AS low_risk, count(*) FILTER (WHERE risk_level = 'medium') AS medium_risk, count(*) FILTER (WHERE risk_level = 'high') AS high_risk FROM functions")
def summary_complexity(spark, d):
    """A4"""
    return metrics.complexity_summary(R.functions(spark, d)).withColumn("average", r6(F.col("average")))


@query(f"WITH {R.FUNCTIONS} SELECT complexity AS value, count(*) AS n FROM functions GROUP BY complexity")
def histogram_complexity(spark, d):
    """A4"""
    return metrics.histogram(R.functions(spark, d), "complexity")


@query(f"WITH {R.FUNCTIONS} SELECT CASE WHEN complexity <= 1 THEN '1' WHEN complexity <= 5 THEN '2-5' WHEN complexity <= 9 THEN '6-9' WHEN complexity <= 19 THEN '10-19' ELSE '20+' END AS bin, count(*) AS n FROM functions GROUP BY 1")
def histogram_threshold_bins(spark, d):
    """A12"""
    return R.functions(spark, d).groupBy(metrics.threshold_bin(F.col("complexity"), 9, 19).alias("bin")).agg(F.count("*").alias("n"))


@query(f"WITH {R.FUNCTIONS} SELECT directory, CAST(median(complexity) AS DOUBLE) AS median FROM functions GROUP BY directory")
def median_complexity(spark, d):
    """Exact median, the mean of the two middle values."""
    return R.functions(spark, d).groupBy("directory").agg(F.median("complexity").alias("median"))


@query(f"WITH {R.FUNCTIONS} SELECT directory, min_by(id, (-complexity, id)) AS longest, min_by(id, (-nesting, id)) AS deepest FROM functions GROUP BY directory")
def extremes(spark, d):
    """First on a tie."""
    return R.functions(spark, d).groupBy("directory").agg(F.min_by("id", F.struct(-F.col("complexity"), "id")).alias("longest"), F.min_by("id", F.struct(-F.col("nesting"), "id")).alias("deepest"))


@query(f"WITH {R.FUNCTIONS} SELECT id, name, complexity, risk_level FROM functions WHERE complexity > 1 AND complexity >= 5 AND complexity <= 18")
def filter_complexity_report(spark, d):
    """P10: unchanged functions dropped, bounds applied; aggregates never see this filter."""
    c = F.col("complexity")
    return R.functions(spark, d).where((c > 1) & (c >= 5) & (c <= 18)).select("id", "name", "complexity", "risk_level")


@query(f"WITH {R.FUNCTIONS}, k AS (SELECT file_path, count(*) AS functions, CAST(sum(complexity) AS BIGINT) AS total FROM functions GROUP BY 1), l AS (SELECT r_name || '/' || n_name || '/' || m || '.ts' AS file_path, count(s_suppkey) AS loc FROM nation JOIN region ON n_regionkey = r_regionkey CROSS JOIN (SELECT DISTINCT c_mktsegment AS m FROM customer) LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1) SELECT file_path, coalesce(functions, 0) AS functions, coalesce(total, 0) AS total, coalesce(loc, 0) AS loc FROM k FULL JOIN l USING (file_path)")
def join_rollup_loc(spark, d):
    """Files without functions stay."""
    k = R.functions(spark, d).groupBy("file_path").agg(F.count("*").alias("functions"), F.sum("complexity").cast("long").alias("total"))
    seg = table(spark, d, "customer").select(F.collect_set("c_mktsegment").alias("ms"))
    files = F.broadcast(table(spark, d, "nation")).join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    segments = seg.collect()[0]["ms"]  # the fixed market segments
    files = files.select("n_nationkey", "r_name", "n_name", F.explode(F.array(*map(F.lit, segments))).alias("m"))
    sup = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    loc = files.join(sup, "n_nationkey", "left").select(F.concat_ws("/", "r_name", "n_name", F.concat("m", F.lit(".ts"))).alias("file_path"), F.coalesce("n", F.lit(0)).alias("loc"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return k.join(loc, "file_path", "full_outer").select("file_path", zero("functions"), zero("total"), zero("loc"))


def _quality(spark, d):
    f = metrics.by_module(R.functions(spark, d)).select("file_path", "functions", "most", "average", "high_risk")
    dead = R.findings_by_file(spark, d).groupBy("file_path").agg(F.count("*").alias("findings"), F.count_if(F.col("severity") == "critical").alias("critical"))
    names = R.functions(spark, d).select("file_path", F.col("directory").alias("module")).distinct()
    return metrics.module_quality(f, dead, names)


_QUALITY = f"WITH {R.FILE_FINDINGS}, a AS (SELECT file_path, count(*) AS functions, max(complexity) AS most, sum(complexity) / count(*) AS average, count(*) FILTER (WHERE risk_level = 'high') AS high_risk FROM functions GROUP BY 1), b AS (SELECT file_path, count(*) AS findings, count(*) FILTER (WHERE severity = 'critical') AS critical FROM file_findings GROUP BY 1), n AS (SELECT DISTINCT file_path, directory AS module FROM functions), q AS (SELECT file_path, coalesce(functions, 0) AS functions, coalesce(most, 0) AS most, coalesce(average, 0) AS average, coalesce(high_risk, 0) AS high_risk, coalesce(findings, 0) AS findings, coalesce(critical, 0) AS critical, module FROM a FULL JOIN b USING (file_path) LEFT JOIN n USING (file_path)) "


@query(_QUALITY + "SELECT file_path, functions, most, round(average, 6) AS average, high_risk, findings, critical, module FROM q")
def join_module_quality(spark, d):
    """J6"""
    return _quality(spark, d).withColumn("average", r6(F.col("average")))


@query(_QUALITY + "SELECT file_path, row_number() OVER (ORDER BY high_risk DESC, most DESC, average DESC, findings DESC, file_path) AS place FROM q ORDER BY place LIMIT 25")
def rank_worst_modules(spark, d):
    """The report's 25 worst."""
    top = _quality(spark, d).orderBy(*metrics.worst_modules(None)).limit(25)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*metrics.worst_modules(None))).cast("long")).select("file_path", "place")


@query(f"WITH {R.FUNCTIONS} SELECT directory, row_number() OVER (ORDER BY max(complexity) DESC, avg(complexity) DESC, count(*) DESC, directory) AS place FROM functions GROUP BY directory")
def rank_worst_directories(spark, d):
    """Directories are few; their aggregates are ranked."""
    g = metrics.by_directory(R.functions(spark, d))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("most"), F.desc("average"), F.desc("functions"), "directory")).cast("long")).select("directory", "place")


@query(f"WITH {R.FUNCTIONS} SELECT id, name, complexity FROM functions ORDER BY complexity DESC, file_path, name, id LIMIT 20")
def top_functions(spark, d):
    """Functions by complexity."""
    return R.functions(spark, d).orderBy(F.desc("complexity"), "file_path", "name", "id").limit(20).select("id", "name", "complexity")


@query(f"WITH {R.FUNCTIONS} SELECT id, risk_level FROM functions ORDER BY CASE risk_level WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, complexity DESC, name, id LIMIT 20")
def top_functions_by_risk(spark, d):
    """T3"""
    rank = F.when(F.col("risk_level") == "high", 0).when(F.col("risk_level") == "medium", 1).otherwise(2)
    return R.functions(spark, d).orderBy(rank, F.desc("complexity"), "name", "id").limit(20).select("id", "risk_level")


@query(f"WITH {R.FUNCTIONS} SELECT * FROM (SELECT directory, id, row_number() OVER (PARTITION BY directory ORDER BY complexity DESC, handlers DESC, nesting DESC, name, id) AS place FROM functions) WHERE place <= 8")
def hotspots(spark, d):
    """The eight hottest functions of each directory."""
    by = Window.partitionBy("directory").orderBy(F.desc("complexity"), F.desc("handlers"), F.desc("nesting"), "name", "id")
    return R.functions(spark, d).withColumn("place", F.row_number().over(by).cast("long")).where("place <= 8").select("directory", "id", "place")


@query(f"WITH {R.FUNCTIONS} SELECT root, directory, files, total, CAST(g AS BIGINT) AS level FROM (SELECT split_part(file_path, '/', 1) AS root, directory, count(DISTINCT file_path) AS files, CAST(sum(complexity) AS BIGINT) AS total, grouping(root, directory) AS g FROM functions GROUP BY ROLLUP (root, directory))")
def rollup_three_levels(spark, d):
    """A1, A2 and A4 in one pass."""
    f = R.functions(spark, d).withColumn("root", F.split("file_path", "/")[0])
    return f.rollup("root", "directory").agg(F.count_distinct("file_path").alias("files"), F.sum("complexity").cast("long").alias("total"), F.grouping_id().cast("long").alias("level"))


# -- coupling and cohesion

_CBO = f"WITH {R.CLASS_DEPS}, cbo AS (SELECT class, count(DISTINCT dep_class) AS coupling FROM class_deps WHERE class <> dep_class GROUP BY class) "


@query(f"WITH {R.CLASS_DEPS} SELECT class, count(DISTINCT dep_class) AS coupling, count(*) FILTER (WHERE kind = 'A') AS kind_a, count(*) FILTER (WHERE kind = 'N') AS kind_n, count(*) FILTER (WHERE kind = 'R') AS kind_r, string_agg(DISTINCT CAST(dep_class AS VARCHAR), ',' ORDER BY CAST(dep_class AS VARCHAR)) AS dependencies FROM class_deps WHERE class <> dep_class GROUP BY class")
def cbo_metrics(spark, d):
    """The total is distinct, the kinds are not."""
    deps = R.class_deps(spark, d)
    out = metrics.class_coupling(deps.withColumn("dep_class", F.col("dep_class").cast("string")).withColumn("class", F.col("class").cast("string")), ["A", "N", "R"])
    return out.withColumn("class", F.col("class").cast("long"))


def _cbo(spark, d):
    return R.class_deps(spark, d).where("class <> dep_class").groupBy("class").agg(F.count_distinct("dep_class").alias("coupling"))


@query(_CBO + "SELECT CASE WHEN coupling = 0 THEN '0' WHEN coupling <= 3 THEN '1-3' WHEN coupling <= 7 THEN '4-7' WHEN coupling <= 10 THEN '8-10' ELSE '10+' END AS bin, count(*) AS n, CASE WHEN max(coupling) <= 3 THEN 'low' WHEN max(coupling) <= 7 THEN 'medium' ELSE 'high' END AS worst FROM cbo GROUP BY 1")
def cbo_summary_bins(spark, d):
    """A5"""
    return _cbo(spark, d).groupBy(metrics.coupling_bin(F.col("coupling")).alias("bin")).agg(F.count("*").alias("n"), S.risk(F.max("coupling"), 3, 7).alias("worst"))


@query(_CBO + "SELECT class, coupling FROM cbo ORDER BY coupling DESC, class LIMIT 10")
def cbo_most_coupled(spark, d):
    """T4/T6"""
    return _cbo(spark, d).orderBy(F.desc("coupling"), "class").limit(10)


@query(_CBO + "SELECT class, coupling FROM cbo WHERE coupling >= 2 AND coupling <= 6")
def cbo_filter(spark, d):
    """P11"""
    return _cbo(spark, d).where("coupling >= 2 and coupling <= 6")


_MARTIN = f"WITH {R.IMPORT_EDGES}, m AS (SELECT id, sum(ca) AS ca, sum(ce) AS ce FROM (SELECT src AS id, 0 AS ca, 1 AS ce FROM E UNION ALL SELECT dst, 1, 0 FROM E) GROUP BY id), x AS (SELECT id, CAST(ca AS BIGINT) AS ca, CAST(ce AS BIGINT) AS ce, CASE WHEN ca + ce > 0 THEN ce / (ca + ce) ELSE 0 END AS i FROM m) "


@query(_MARTIN.replace("FROM E", "FROM (SELECT DISTINCT * FROM import_edges)") + "SELECT id, ca, ce, round(i, 6) AS instability, round(abs(i - 1), 6) AS distance FROM x")
def coupling_martin(spark, d):
    """A18 over an edge set."""
    return graph.coupling(R.import_edges(spark, d)).select("id", "ca", "ce", r6(F.col("instability")).alias("instability"), r6(F.col("distance")).alias("distance"))


@query(_MARTIN.replace("FROM E", "FROM import_edges") + ", z AS (SELECT id, ca, ce, i, least(ca / 10.0, 1.0) AS a, abs(least(ca / 10.0, 1.0) + i - 1) AS dist FROM x) SELECT id, ca, ce, round(a, 6) AS abstractness, CASE WHEN dist >= 0.5 AND ca >= 2 AND i <= 0.3 AND a <= 0.3 THEN 'zone_of_pain' WHEN dist >= 0.5 AND i >= 0.7 AND a >= 0.7 THEN 'zone_of_uselessness' WHEN dist <= 0.2 THEN 'main_sequence' ELSE '' END AS zone, CASE WHEN ca + ce >= 10 OR dist > 0.5 THEN 'high' WHEN ca + ce >= 5 OR dist > 0.3 THEN 'medium' ELSE 'low' END AS risk FROM z")
def coupling_zones(spark, d):
    """A module graph counts every import statement."""
    e = R.import_edges(spark, d)
    c = graph.coupling(e, distinct_edges=False).drop("abstractness", "distance")
    a = graph.abstractness(F.col("ca"))
    dist = F.abs(a + F.col("instability") - 1)
    return c.select("id", "ca", "ce", r6(a).alias("abstractness"), graph.zone(F.col("ca"), F.col("instability"), a, dist).alias("zone"), graph.module_risk(F.col("ca") + F.col("ce"), dist).alias("risk"))


@query(_MARTIN.replace("FROM E", "FROM import_edges") + "SELECT CASE WHEN ca + ce <= 0 THEN '0' WHEN ca + ce <= 3 THEN '1-3' WHEN ca + ce <= 7 THEN '4-7' WHEN ca + ce <= 10 THEN '8-10' ELSE '11+' END AS bucket, count(*) AS n, round(avg(i), 6) AS instability, count(*) FILTER (WHERE i <= 0.3) AS stable, count(*) FILTER (WHERE i >= 0.7) AS unstable FROM x GROUP BY 1")
def coupling_summary(spark, d):
    """A9"""
    c = graph.coupling(R.import_edges(spark, d), distinct_edges=False).withColumn("t", F.col("ca") + F.col("ce"))
    t = F.col("t")
    bucket = F.when(t <= 0, "0").when(t <= 3, "1-3").when(t <= 7, "4-7").when(t <= 10, "8-10").otherwise("11+")
    return c.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), r6(F.avg("instability")).alias("instability"), F.count_if(F.col("instability") <= 0.3).alias("stable"), F.count_if(F.col("instability") >= 0.7).alias("unstable"))


@query(f"WITH {R.IMPORT_EDGES} SELECT DISTINCT src, dst FROM import_edges")
def dependency_matrix(spark, d):
    """G15"""
    return graph.matrix(R.import_edges(spark, d))


@query("SELECT doc_id AS id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def graph_roots(spark, d):
    """Labels refer to documents; documents that nothing refers to."""
    edges = table(spark, d, "labels").select(F.col("quality").cast("long").alias("src"), F.col("doc_id").alias("dst"))
    return graph.roots(table(spark, d, "documents").select(F.col("doc_id").alias("id")), edges)


@query("SELECT l_shipdate, n, total FROM (SELECT l_shipdate, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1)")
def filter_load_time_edges(spark, d):
    """Edges of one type left out before counting."""
    return graph.load_time(table(spark, d, "lineitem").withColumn("edge_type", F.when(F.col("l_returnflag") == "A", "dynamic").otherwise("import"))).groupBy("l_shipdate").agg(F.count("*").alias("n"), F.sum("l_linenumber").cast("long").alias("total"))


# -- anti joins (J8-J13) and path predicates


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def unused_imports(spark, d):
    """Orders are imports, line items refer to them."""
    o = table(spark, d, "orders").select(F.lit("f").alias("file_path"), F.col("o_orderkey").alias("local"), F.lit("named").alias("import_type"), F.lit(False).alias("is_type_only"))
    r = table(spark, d, "lineitem").select(F.lit("f").alias("file_path"), F.col("l_orderkey").alias("name"))
    return imports.unused_imports(o, r).select(F.col("local").alias("o_orderkey"))


@query("SELECT file_path, name FROM (SELECT 'm/' || source || '.ts' AS file_path, doc_id AS name FROM documents) e WHERE NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = name) AND file_path <> 'm/src1.ts'")
def unused_exports(spark, d):
    """Documents are exports of their source's file, labels use them; a star import of one file takes all of it."""
    e = table(spark, d, "documents").select(F.concat(F.lit("m/"), "source", F.lit(".ts")).alias("file_path"), F.col("doc_id").cast("string").alias("name"), F.lit("named").alias("kind"), F.lit("function").alias("declaration"))
    used = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("name")).distinct()
    taken = e.select("file_path", "name").join(used, "name", "left_semi").select("file_path", "name")
    star = spark.createDataFrame([("m/src1.ts", "*")], "file_path string, name string")
    return imports.unused_functions(e, taken.union(star)).select("file_path", F.col("name").cast("long").alias("name"))


@query(f"WITH {R.FINDINGS} SELECT count(*) AS n FROM findings a WHERE severity < 3 AND NOT EXISTS (SELECT 1 FROM findings b WHERE b.severity = 3 AND a.file_path = b.file_path AND a.start_line = b.start_line)")
def dedupe_findings(spark, d):
    """J11"""
    f = R.findings(spark, d)
    return imports.without_duplicates(f.where("severity < 3"), f.where("severity = 3")).agg(F.count("*").alias("n"))


@query("SELECT item_id FROM benchmark WHERE NOT EXISTS (SELECT 1 FROM documents WHERE contains(documents.text, benchmark.text))")
def missing_benchmark_items(spark, d):
    """Anti join on containment, the benchmark being the bounded side."""
    b = table(spark, d, "benchmark")
    rows = b.limit(100_001).count()
    assert rows <= 100_000, "the benchmark is to be searched by the decontamination operator"
    docs = table(spark, d, "documents").select("text")
    hit = docs.join(F.broadcast(b.withColumnRenamed("text", "item")), F.contains(F.col("text"), F.col("item"))).select("item_id").distinct()
    return b.join(hit, "item_id", "left_anti").select("item_id")


_URLS = "u AS (SELECT page_id, regexp_replace(url, '^https?://[^/]*/?', '') AS path, url FROM pages)"


@query(f"WITH {_URLS}, s AS (SELECT page_id, string_split(path, '/') AS p FROM u) SELECT array_to_string(p[greatest(len(p) - n + 1, 1):], '/') AS suffix, count(*) AS files FROM (SELECT page_id, p, unnest(range(1, least(len(p), 5) + 1)) AS n FROM s) GROUP BY 1")
def suffix_index(spark, d):
    """J13"""
    files = table(spark, d, "pages").select(F.regexp_replace("url", r"^https?://[^/]*/?", "").alias("file_path"))
    return imports.suffix_index(files).groupBy("suffix").agg(F.count("*").alias("files"))


@query("SELECT doc_id, CASE WHEN source = '' THEN 'package' WHEN starts_with(source, 'node:') THEN 'builtin' WHEN regexp_matches(source, '^\\.\\.?(/|$)') THEN 'relative' WHEN starts_with(source, '/') THEN 'absolute' WHEN regexp_matches(source, '^[@~]/') THEN 'alias' WHEN split_part(source, '/', 1) IN ('src1', 'src2') THEN 'builtin' ELSE 'package' END AS kind FROM documents")
def module_source_kind(spark, d):
    """G20"""
    return table(spark, d, "documents").select("doc_id", graph.module_kind(F.col("source"), ["src1", "src2"]).alias("kind"))


@query("SELECT page_id, regexp_matches(lower(url), '(^|/)[^/]*(1|2)[^/]*(/|$)') AS hit FROM pages")
def path_glob(spark, d):
    """Slash-less patterns match any segment, without regard to case."""
    return table(spark, d, "pages").select("page_id", text.matches_any(F.lower("url"), ["*1*", "*2*"], text.path_glob_regex).alias("hit"))


@query("SELECT p_partkey, regexp_matches(p_name, '^r[^/]*$') OR lower(p_name) = 'small ring' AS hit FROM part")
def name_glob(spark, d):
    """S2, P14"""
    n = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", (text.matches_name(n, "r*") | text.matches_name(n, "Small Ring")).alias("hit"))


# -- text (S8, N14-N19) and pair filters


@query(f"WITH {R.FRAGMENTS} SELECT id, line_count, CAST(strlen(content) AS BIGINT) AS bytes FROM fragments")
def line_counts(spark, d):
    """S8"""
    return R.fragments(spark, d).select("id", text.line_count(F.col("content")).alias("line_count"), text.byte_length(F.col("content")).alias("bytes"))


_NORM = "regexp_replace(regexp_replace(text, '([A-Za-z0-9_])[ \\t\\r\\n\\f\\v]+([A-Za-z0-9_])', '\\1' || chr(1) || '\\2', 'g'), '[ ]', '', 'g')"


@query("SELECT md5(text) AS hash, count(*) AS copies, min(doc_id) AS least FROM documents WHERE text <> '' GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, d):
    """Groups of equal content by digest; the empty text matches nothing."""
    t = table(spark, d, "documents").where("text <> ''")
    return t.groupBy(text.content_hash(F.col("text")).alias("hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("least")).where("copies > 1")


@query("SELECT a.n_name AS n1, b.n_name AS n2, CAST(levenshtein(a.n_name, b.n_name) AS INTEGER) AS distance, round(1 - levenshtein(a.n_name, b.n_name) / greatest(strlen(a.n_name), strlen(b.n_name)), 6) AS similarity FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def textual_similarity(spark, d):
    """N19, J1 over few items: distances in bytes."""
    n = table(spark, d, "nation")
    a, b = n.select(F.col("n_nationkey").alias("k1"), F.col("n_name").alias("n1")), n.select(F.col("n_nationkey").alias("k2"), F.col("n_name").alias("n2"))
    x, y = F.col("n1"), F.col("n2")
    return a.join(b, F.col("k1") < F.col("k2")).select("n1", "n2", text.byte_levenshtein(x, y).alias("distance"), r6(text.textual_similarity(x, y)).alias("similarity"))


@query(f"WITH {R.FRAGMENTS} SELECT count(*) AS pairs FROM fragments a JOIN fragments b ON a.file_path = b.file_path AND a.id < b.id WHERE abs(a.node_count - b.node_count) / ((a.node_count + b.node_count) / 2.0) <= 0.5 AND NOT (abs(a.line_count - b.line_count) > 0.5 * a.line_count AND abs(a.line_count - b.line_count) > 0.5 * b.line_count) AND NOT (a.start_line <= b.end_line AND b.start_line <= a.end_line) AND least(a.node_count, b.node_count) >= 10")
def pair_prefilters(spark, d):
    """P2-P4 on pairs of one file, which the sizes bin: fragments meet in bins of log size only."""
    f = R.fragments(spark, d).where("node_count >= 10").select("id", "file_path", "node_count", "line_count", "start_line", "end_line")
    # sizes within half their mean differ by a factor of 5/3 at most: neighbours among bins of that width
    bin_ = F.floor(F.log(F.col("node_count")) / F.log(F.lit(5 / 3 + 1e-9))).cast("int")
    a = f.select(*(F.col(c).alias(f"a_{c}") for c in f.columns), F.explode(F.array(bin_ - 1, bin_, bin_ + 1)).alias("bin"), F.col("file_path"))
    b = f.select(*(F.col(c).alias(f"b_{c}") for c in f.columns), bin_.alias("bin"), F.col("file_path"))
    c = F.col
    ok = classify.comparable(c("a_node_count"), c("b_node_count"), c("a_line_count"), c("b_line_count"))
    over = classify.overlaps(c("a_file_path"), c("a_start_line"), c("a_end_line"), c("b_file_path"), c("b_start_line"), c("b_end_line"))
    return a.join(b, ["file_path", "bin"]).where(c("a_id") < c("b_id")).where(ok & ~over).agg(F.count("*").alias("pairs"))


_PAIRS = "p AS (SELECT o_orderkey AS id, o_totalprice / 500000.0 AS struct, (o_orderkey % 10) / 10.0 AS syn, o_orderkey % 7 = 0 AS same, o_custkey % 90 + 5 AS n1, o_custkey % 60 + 5 AS n2, (o_custkey % 80) * 1.0 AS dist FROM orders), c AS (SELECT *, least(struct, 0.8499999999999999) AS cap FROM p), k AS (SELECT *, CASE WHEN struct >= 0.85 AND same THEN 1 WHEN cap >= 0.75 AND syn >= 0.75 THEN 2 WHEN cap >= 0.70 THEN 3 WHEN cap >= 0.65 THEN 4 ELSE 0 END AS type FROM c), v AS (SELECT *, CASE type WHEN 1 THEN struct WHEN 2 THEN least(cap, syn) ELSE cap END AS sim FROM k)"


def _pairs(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    rows = o.select(k.alias("id"), (F.col("o_totalprice") / 500000.0).alias("struct"), ((k % 10) / 10.0).alias("syn"), (k % 7 == 0).alias("same"), (F.col("o_custkey") % 90 + 5).alias("n1"), (F.col("o_custkey") % 60 + 5).alias("n2"), ((F.col("o_custkey") % 80) * F.lit(1.0)).alias("dist"))
    kind, value = classify.classify(F.col("struct"), F.col("same"), F.col("syn"))
    return rows.withColumn("type", kind).withColumn("sim", value)


@query(f"WITH {_PAIRS} SELECT id, type, round(sim, 9) AS similarity, round(least(1.0, sim + least((n1 + n2) / 2.0 / 100.0, 0.2) + least(n1, n2) / greatest(n1, n2) * 0.1), 9) AS confidence FROM v")
def classify_pairs(spark, d):
    """N34, N35"""
    n1, n2 = F.col("n1"), F.col("n2")
    return _pairs(spark, d).select("id", "type", F.round("sim", 9).alias("similarity"), F.round(classify.confidence(F.col("sim"), n1, n2, n1, n2), 9).alias("confidence"))


@query(f"WITH {_PAIRS} SELECT id, type FROM v WHERE sim >= 0.65 AND (dist <= 50 OR type = 4) AND least(n1, n2) >= 10 AND type IN (1, 2, 4)")
def filter_significant_pairs(spark, d):
    """Semantic copies ignore the distance limit."""
    p = _pairs(spark, d)
    ok = classify.significant(F.col("sim"), F.col("dist"), F.col("type"), F.col("n1"), F.col("n2"))
    return p.where(ok & classify.reported(F.col("sim"), F.col("type"))).select("id", "type")


@query(f"WITH {_PAIRS} SELECT id, round(sim, 9) AS similarity FROM v ORDER BY sim DESC, id LIMIT 100")
def top_pairs(spark, d):
    """T1/T2 in the report's total order."""
    p = _pairs(spark, d).select("id", F.col("sim").alias("similarity"), F.col("id").alias("id1"), F.lit(0).alias("id2"))
    return classify.top_pairs(p, 100).select("id", F.round("similarity", 9).alias("similarity"))


@query("SELECT l_orderkey, least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b, max(l_discount) AS s FROM lineitem GROUP BY ALL")
def pair_metadata(spark, d):
    """One row for each unordered pair."""
    t = table(spark, d, "lineitem")
    return t.groupBy("l_orderkey", F.least("l_suppkey", "l_partkey").alias("a"), F.greatest("l_suppkey", "l_partkey").alias("b")).agg(F.max("l_discount").alias("s"))


# -- flow (C6, C8, C14, C16, J15, N37)


@query(f"WITH {R.FLOW_EDGES}, b AS (SELECT cfg_id, src, greatest(count(DISTINCT dst) FILTER (WHERE edge_type IN ('cond_true', 'cond_false')) - 1, 0) + max(CAST(edge_type = 'exception' AS INTEGER)) AS points FROM flow_edges GROUP BY 1, 2) SELECT cfg_id, CAST(sum(points) + 1 AS BIGINT) AS complexity FROM b GROUP BY cfg_id")
def cfg_mccabe(spark, d):
    """C6"""
    return flow.mccabe(R.flow_edges(spark, d))


@query(f"WITH {R.FLOW_EDGES} SELECT cfg_id, count(*) AS edges, count(*) FILTER (WHERE edge_type = 'loop') AS loops, count(*) FILTER (WHERE edge_type = 'exception') AS handlers, (SELECT count(DISTINCT event_type) FROM events WHERE user_id = cfg_id) AS nodes FROM flow_edges GROUP BY cfg_id")
def cfg_record(spark, d):
    """C8"""
    blocks = table(spark, d, "events").select(F.col("user_id").alias("cfg_id"), F.col("event_type").alias("block_id"), F.lit("").alias("label")).distinct()
    e = R.flow_edges(spark, d)
    out = flow.complexity_record(e, blocks).join(e.select("cfg_id").distinct(), "cfg_id", "left_semi")
    return out.select("cfg_id", "edges", "loops", "handlers", "nodes")


@query(f"WITH {R.FINDINGS}, o AS (SELECT *, CASE WHEN reason = lag(reason) OVER w THEN 0 ELSE 1 END AS turn FROM findings WINDOW w AS (PARTITION BY file_path ORDER BY start_line, end_line, reason, severity, description)), r AS (SELECT *, sum(turn) OVER (PARTITION BY file_path ORDER BY start_line, end_line, reason, severity, description) AS run FROM o), g AS (SELECT *, CASE WHEN start_line <= max(end_line) OVER (PARTITION BY file_path, run ORDER BY start_line, end_line, severity, description ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS gap FROM r), i AS (SELECT *, sum(gap) OVER (PARTITION BY file_path, run ORDER BY start_line, end_line, severity, description ROWS UNBOUNDED PRECEDING) AS island FROM g) SELECT file_path, reason, min(start_line) AS start_line, max(end_line) AS end_line, max(severity) AS severity, count(*) AS merged FROM i GROUP BY file_path, run, island, reason")
def merge_findings(spark, d):
    """C14/W1"""
    return flow.merge_contiguous(R.findings(spark, d)).drop("description")


@query("WITH r AS (SELECT user_id, ts, event_id, event_type FROM events), u AS (SELECT event_id, user_id, ts FROM r WHERE event_type = 'purchase'), f AS (SELECT user_id, ts, event_id AS def_id FROM r WHERE event_type = 'signup') SELECT u.event_id AS use_id, f.def_id FROM u ASOF JOIN f ON u.user_id = f.user_id AND u.ts >= f.ts")
def def_use_asof(spark, d):
    """The latest definition before each use."""
    e = table(spark, d, "events").where("event_type in ('signup', 'purchase')")
    by = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "signup", 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(by)
    return e.withColumn("def_id", last).where("event_type = 'purchase' and def_id is not null").select(F.col("event_id").alias("use_id"), "def_id")


@query("SELECT user_id AS cfg_id, count(*) FILTER (WHERE event_type = 'signup') AS defs, count(*) FILTER (WHERE event_type <> 'signup') AS uses, count(DISTINCT json_extract_string(props, '$.k')) AS variables FROM events GROUP BY 1")
def chain_totals(spark, d):
    """C16"""
    refs = table(spark, d, "events").select(F.col("user_id").alias("cfg_id"), F.get_json_object("props", "$.k").alias("name"), (F.col("event_type") == "signup").alias("is_def"))
    none = spark.createDataFrame([], "cfg_id long, def_block string, use_block string")
    return flow.chain_totals(refs, none).select("cfg_id", "defs", "uses", "variables")


@query(f"WITH {R.FLOW_EDGES}, n AS (SELECT cfg_id, count(DISTINCT b) AS blocks FROM (SELECT cfg_id, src AS b FROM flow_edges UNION ALL SELECT cfg_id, dst FROM flow_edges) GROUP BY 1) SELECT cfg_id, blocks, count(*) AS edges, count(*) - blocks + 2 AS cyclomatic, count(*) FILTER (WHERE edge_type = 'loop') AS loops, count(*) FILTER (WHERE edge_type IN ('cond_true', 'cond_false')) AS conditions, round(count(*) / blocks, 6) AS branching FROM flow_edges JOIN n USING (cfg_id) GROUP BY cfg_id, blocks")
def cfg_features(spark, d):
    """N37"""
    return flow.cfg_features(R.flow_edges(spark, d)).select("cfg_id", "blocks", "edges", "cyclomatic", F.col("loops").cast("long").alias("loops"), F.col("conditions").cast("long").alias("conditions"), r6(F.col("branching")).alias("branching"))


# -- dead code summaries (A6-A8, P12, P13, T5) and scores


@query(f"WITH {R.FILE_FINDINGS} SELECT count(*) AS findings, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'info') AS info, count(DISTINCT file_path) AS files FROM file_findings")
def dead_code_summary(spark, d):
    """A6/A8"""
    return metrics.dead_code_summary(R.findings_by_file(spark, d))


@query(f"WITH {R.FILE_FINDINGS} SELECT file_path, count(*) AS all_findings, count(*) FILTER (WHERE severity <> 'info') AS reported FROM file_findings GROUP BY 1")
def dead_code_by_module(spark, d):
    """The rollup counts before the severity filter."""
    return R.findings_by_file(spark, d).groupBy("file_path").agg(F.count("*").alias("all_findings"), F.count_if(S.at_least(F.col("severity"), "warning")).alias("reported"))


@query(f"WITH {R.FILE_FINDINGS} SELECT file_path, max(CASE severity WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END) AS worst, count(*) AS n, min(start_line) AS line FROM file_findings GROUP BY 1 ORDER BY worst DESC, n DESC, file_path LIMIT 20")
def dead_code_files(spark, d):
    """P13, T5"""
    g = R.findings_by_file(spark, d).groupBy("file_path").agg(F.max(S.severity_rank(F.col("severity"))).alias("worst"), F.count("*").alias("n"), F.min("start_line").alias("line"))
    return g.orderBy(F.desc("worst"), F.desc("n"), "file_path").limit(20)


_CHECK = f"WITH {R.FUNCTIONS} SELECT 'complexity' AS category, id, complexity AS actual FROM functions WHERE complexity > 19"


@query(_CHECK)
def check_gate(spark, d):
    """Violations of the complexity limit."""
    return R.functions(spark, d).where("complexity > 19").select(F.lit("complexity").alias("category"), "id", F.col("complexity").alias("actual"))


_DIRS = f"WITH {R.FUNCTIONS}, g AS (SELECT directory, count(*) AS n, count(*) FILTER (WHERE risk_level = 'high') AS high, count(*) FILTER (WHERE risk_level = 'medium') AS medium, CAST(sum(handlers) AS BIGINT) AS handlers, count(DISTINCT file_path) AS files FROM functions GROUP BY 1), "
_PENALTIES = (
    "p AS (SELECT *, CAST(round(least(20.0, (high + 0.5 * medium) / n / 0.05 * 20)) AS BIGINT) AS complexity_penalty, CAST(round(least(20.0, greatest(0.0, 100.0 * medium / n) / 30.0 * 20)) AS BIGINT) AS duplication_penalty, "
    "CAST(CASE WHEN high > 0 THEN greatest(round(least(1.0, high / n) * 56), 11.0) ELSE 0 END AS BIGINT) AS parse_penalty, CAST(round(least(20.0, (high + 0.3 * medium) / n / 0.4 * 20)) AS BIGINT) AS coupling_penalty, "
    "CAST(round(12 * (1 - medium / n)) AS BIGINT) AS architecture_penalty, CAST(round(least(20.0, (high + 0.5 * medium + 0.2 * handlers) / files / 3.0 * 20)) AS BIGINT) AS dead_penalty, "
    "CAST(CASE WHEN high > 0 THEN round(least(10.0, greatest(log2(high + 1.0), least(1.0, high / n) * 10))) ELSE 0 END + greatest(0, least(3, files - greatest(3.0, ceil(log2(n + 1.0)) + 1))) + round(3 * medium / n) AS BIGINT) AS dependency_penalty FROM g) "
)


def _penalties(spark, d):
    f = R.functions(spark, d)
    g = f.groupBy("directory").agg(F.count("*").alias("n"), F.count_if(F.col("risk_level") == "high").alias("high"), F.count_if(F.col("risk_level") == "medium").alias("medium"), F.sum("handlers").cast("long").alias("handlers"), F.count_distinct("file_path").alias("files"))
    n, high, medium, files = F.col("n"), F.col("high"), F.col("medium"), F.col("files")
    return g.select(
        "directory",
        "n",
        S.complexity_penalty(high, medium, n).cast("long").alias("complexity_penalty"),
        S.duplication_penalty(F.lit(100.0) * medium / n).alias("duplication_penalty"),
        S.parse_error_penalty(high, n).alias("parse_penalty"),
        S.coupling_penalty(high, medium, n).alias("coupling_penalty"),
        S.architecture_penalty(medium / n).alias("architecture_penalty"),
        S.dead_code_penalty(high, medium, F.col("handlers"), files).cast("long").alias("dead_penalty"),
        S.dependency_penalty(n, high, files, medium / n).alias("dependency_penalty"),
    )


@query(_DIRS + _PENALTIES + "SELECT directory, n, complexity_penalty, duplication_penalty, parse_penalty, coupling_penalty, architecture_penalty, dead_penalty, dependency_penalty FROM p")
def score_penalties(spark, d):
    """K1-K6, K10, K11"""
    return _penalties(spark, d)


@query(_DIRS + _PENALTIES + ", s AS (SELECT directory, n, greatest(0, least(100, 100 - complexity_penalty - dead_penalty - coupling_penalty - duplication_penalty - dependency_penalty - architecture_penalty - parse_penalty)) AS score, complexity_penalty, dependency_penalty FROM p) SELECT directory, CAST(score AS BIGINT) AS score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 45 THEN 'D' ELSE 'F' END AS grade, score >= 70 AS healthy, CAST(greatest(0, least(100, 100 - round(complexity_penalty * 100.0 / 20))) AS BIGINT) AS complexity_score, CAST(greatest(0, least(20, round(dependency_penalty / 16.0 * 20))) AS BIGINT) AS dependency_scaled, CASE WHEN n >= 1000 THEN 'Enterprise' WHEN n >= 200 THEN 'Large' WHEN n >= 50 THEN 'Medium' WHEN n >= 10 THEN 'Small' ELSE 'Micro' END AS scale FROM s")
def score_health(spark, d):
    """K7-K9, K12, K13"""
    p = _penalties(spark, d)
    score = S.health_score([F.col(f"{c}_penalty") for c in ("complexity", "dead", "coupling", "duplication", "dependency", "architecture", "parse")])
    return p.withColumn("score", score).select(
        "directory",
        "score",
        S.grade(F.col("score")).alias("grade"),
        S.is_healthy(F.col("score")).alias("healthy"),
        S.penalty_score(F.col("complexity_penalty")).alias("complexity_score"),
        S.normalized_penalty(F.col("dependency_penalty"), S.MOST_DEPENDENCY).alias("dependency_scaled"),
        S.project_scale(F.col("n")).alias("scale"),
    )


@query("SELECT o_orderkey, CASE WHEN o_totalprice % 7 > 3 AND o_custkey % 2 = 0 THEN CAST(greatest(0, 100 - o_custkey % 130) AS BIGINT) ELSE 0 END AS score, CASE WHEN NOT (o_totalprice % 7 > 3 AND o_custkey % 2 = 0) THEN 'N/A' WHEN 100 - o_custkey % 130 >= 90 THEN 'A' WHEN 100 - o_custkey % 130 >= 75 THEN 'B' WHEN 100 - o_custkey % 130 >= 60 THEN 'C' WHEN 100 - o_custkey % 130 >= 45 THEN 'D' ELSE 'F' END AS grade FROM orders")
def score_validation(spark, d):
    """An invalid summary scores 0 and has no grade."""
    valid = (F.col("o_totalprice") % 7 > 3) & (F.col("o_custkey") % 2 == 0)
    score, grade = S.health_or_invalid(valid, [F.col("o_custkey") % 130])
    return table(spark, d, "orders").select("o_orderkey", score.alias("score"), grade.alias("grade"))


# -- paired statistics


@query(f"WITH {R.FLAGS} SELECT count(*) FILTER (WHERE model AND human) AS both, count(*) FILTER (WHERE model AND NOT human) AS b, count(*) FILTER (WHERE NOT model AND human) AS c, count(*) FILTER (WHERE NOT model AND NOT human) AS neither FROM flags")
def paired_counts(spark, d):
    """J20"""
    return stats.paired_counts(R.flags(spark, d), "model", "human")


@query("WITH e AS (SELECT user_id, event_type, count(*) FILTER (WHERE day(ts) <= 3) AS before, count(*) FILTER (WHERE day(ts) > 27) AS after FROM events GROUP BY ALL) SELECT user_id, event_type, CASE WHEN before = 0 THEN 'new' WHEN after = 0 THEN 'removed' ELSE 'matched' END AS status, before, after, CASE WHEN before > 0 AND after > 0 THEN after - before ELSE 0 END AS delta FROM e WHERE before + after > 0")
def function_deltas(spark, d):
    """J21"""
    e = table(spark, d, "events")
    n = lambda rows: rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return stats.function_deltas(n(e.where(F.dayofmonth("ts") <= 3)), n(e.where(F.dayofmonth("ts") > 27)), ["user_id", "event_type"], "n").fillna(0)


@query("SELECT event_type, max(value) AS most, round(sum(value), 2) AS total, count(*) AS n FROM events GROUP BY 1")
def benchmark_aggregate(spark, d):
    """A20"""
    return table(spark, d, "events").groupBy("event_type").agg(F.max("value").alias("most"), F.round(F.sum("value"), 2).alias("total"), F.count("*").alias("n"))


@query("SELECT doc_id FROM labels WHERE quality = 1 EXCEPT SELECT doc_id FROM labels WHERE toxic = 1")
def set_difference(spark, d):
    """U6"""
    t = table(spark, d, "labels")
    return t.where("quality = 1").select("doc_id").join(t.where("toxic = 1").select("doc_id"), "doc_id", "left_anti").distinct()


@query("SELECT count(*) AS n FROM (SELECT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R' UNION SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def union_distinct(spark, d):
    """U1, U4, U7"""
    a = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("k"))
    return a.union(table(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey")).distinct().agg(F.count("*").alias("n"))


_PLACES = ["src/app/page.tsx", "src/app/route.ts", "src/app/deep/not-found.js", "lib/app.test.ts", "pkg/Index.ts", "pkg/index.ts", "pkg/app.mjs", "x.spec", "a/__tests__x.js", "c/jest.config", "c/setup.ts", "app/page.tsx"]
_EXPORTED = ["default", "GET", "metadata", "helper"]
_WHERE = f"p AS (SELECT DISTINCT list_extract({_PLACES}, CAST(o_custkey % {len(_PLACES)} AS INTEGER) + 1) AS file_path, list_extract({_EXPORTED}, CAST(o_orderkey % 4 AS INTEGER) + 1) AS name FROM orders), s AS (SELECT *, regexp_extract(file_path, '([^/]*)$', 1) AS base, regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem FROM p)"


@query(f"WITH {_WHERE} SELECT file_path, name, stem IN ('index', 'main', 'app', 'server') AS entry, list_has_any(string_split(base, '.'), ['test', 'spec']) OR contains(file_path, '__tests__') AS test, list_has_any(string_split(base, '.'), ['config', 'setup']) AS config, contains(file_path, '/app/') AND stem IN {tuple(imports.CONVENTION_FILES)} AND (name IN {tuple(imports.CONVENTION_EXPORTS)} OR (stem = 'route' AND name IN {tuple(imports.ROUTE_EXPORTS)})) AS reserved FROM s")
def file_predicates(spark, d):
    """Each kind of path with each kind of export."""
    pick = lambda names, key: F.element_at(F.array(*map(F.lit, names)), (F.col(key) % len(names) + 1).cast("int"))
    rows = table(spark, d, "orders").select(pick(_PLACES, "o_custkey").alias("file_path"), pick(_EXPORTED, "o_orderkey").alias("name")).distinct()
    path = F.col("file_path")
    return rows.select("file_path", "name", imports.is_entry(path).alias("entry"), imports.is_test(path).alias("test"), imports.is_config(path).alias("config"), imports.framework_reserved(path, F.col("name")).alias("reserved"))


@query("SELECT (SELECT count(*) FROM pages) AS files, (SELECT count(*) FROM labels) AS exports, count(*) AS imports, count(DISTINCT CASE WHEN k = 'package' THEN s END) AS packages, count(*) FILTER (WHERE k = 'relative') AS relative_imports, count(*) FILTER (WHERE k = 'absolute') AS absolute_imports, count(*) FILTER (WHERE t = 'dynamic') AS dynamic_imports, count(*) FILTER (WHERE doc_id % 7 = 0) AS type_only_imports, count(*) FILTER (WHERE t = 'require') AS require_imports FROM (SELECT doc_id, t, s, CASE WHEN starts_with(s, './') THEN 'relative' WHEN starts_with(s, '/') THEN 'absolute' WHEN s = 'src1' THEN 'builtin' ELSE 'package' END AS k FROM (SELECT doc_id, CASE lang WHEN 'en' THEN 'named' WHEN 'fr' THEN 'dynamic' ELSE 'require' END AS t, CASE doc_id % 3 WHEN 0 THEN './' || source WHEN 1 THEN '/' || source ELSE source END AS s FROM documents))")
def module_summary(spark, d):
    """A10: documents are imports of their source, pages are files, labels exports."""
    n, source = F.col("doc_id") % 3, F.col("source")
    made = table(spark, d, "documents").select(F.when(n == 0, F.concat(F.lit("./"), source)).when(n == 1, F.concat(F.lit("/"), source)).otherwise(source).alias("source"), F.when(F.col("lang") == "en", "named").when(F.col("lang") == "fr", "dynamic").otherwise("require").alias("import_type"), (F.col("doc_id") % 7 == 0).alias("is_type_only"))
    return imports.module_summary(table(spark, d, "pages"), made, table(spark, d, "labels"), ["src1"])
