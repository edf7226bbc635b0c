"""The relations that the engine's operators work on, drawn from the driver's tables.

Each function gives a frame; the constant beside it is the same relation as DuckDB SQL, to be
placed in a WITH clause.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeloom.functions.scoring import risk
from treeloom.runtime import table


def functions(spark: SparkSession, d: str) -> DataFrame:
    """Functions: a customer with its number of orders as complexity; file, directory and root from its place."""
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("handlers"))
    nation = F.broadcast(table(spark, d, "nation"))  # a fixed dimension
    region = F.broadcast(table(spark, d, "region"))
    rows = table(spark, d, "customer").join(orders, "c_custkey", "left").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    complexity = F.coalesce("n", F.lit(0)).cast("long")
    path = F.concat_ws("/", "r_name", "n_name", F.concat("c_mktsegment", F.lit(".ts")))
    return rows.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), path.alias("file_path"), F.concat_ws("/", "r_name", "n_name").alias("directory"), complexity.alias("complexity"), F.coalesce("handlers", F.lit(0)).cast("long").alias("handlers"), (complexity % 5).alias("nesting"), risk(complexity, 9, 19).alias("risk_level"))


FUNCTIONS = """functions AS (
  SELECT c_custkey AS id, c_name AS name, r_name || '/' || n_name || '/' || c_mktsegment || '.ts' AS file_path, r_name || '/' || n_name AS directory,
         complexity, handlers, complexity % 5 AS nesting, CASE WHEN complexity <= 9 THEN 'low' WHEN complexity <= 19 THEN 'medium' ELSE 'high' END AS risk_level
  FROM (SELECT c.*, coalesce(n, 0) AS complexity, coalesce(h, 0) AS handlers FROM customer c LEFT JOIN (
          SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS h FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey)
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def class_deps(spark: SparkSession, d: str) -> DataFrame:
    """Classes: an order depends on suppliers; the kind is the return flag."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("class"), F.col("l_suppkey").alias("dep_class"), F.col("l_returnflag").alias("kind"))


CLASS_DEPS = "class_deps AS (SELECT l_orderkey AS class, l_suppkey AS dep_class, l_returnflag AS kind FROM lineitem)"


def import_edges(spark: SparkSession, d: str) -> DataFrame:
    """Module edges, one for each import statement: supplier to part."""
    return table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))


IMPORT_EDGES = "import_edges AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem)"


def nation_edges(spark: SparkSession, d: str) -> DataFrame:
    """A cyclic graph: customer nation to supplier nation, where trade exceeds the mean by a seventh; weight is the count."""
    line, orders = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    cust, supp = table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(cust, F.col("o_custkey") == F.col("c_custkey")).join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
    counts = rows.groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.count("*").alias("weight"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    return counts.withColumn("rank", rank).where("rank <= 1 + src % 2 and src <> dst").select("src", "dst", "weight")


NATION_EDGES = """nation_edges AS MATERIALIZED (SELECT src, dst, weight FROM (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rank FROM (
    SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, count(*) AS weight
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2))
  WHERE rank <= 1 + src % 2 AND src <> dst)"""


def flow_edges(spark: SparkSession, d: str) -> DataFrame:
    """Control flow of a user: from each event type to the next; the type of the edge follows from both."""
    e = table(spark, d, "events")
    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    kind = F.when(F.col("dst") == "error", "exception").when(F.col("src") == F.col("dst"), "loop").when((F.col("src") == "click") & (F.col("dst") == "purchase"), "cond_true").when(F.col("src") == "click", "cond_false").otherwise("normal")
    return e.select(F.col("user_id").alias("cfg_id"), F.col("event_type").alias("src"), nxt.alias("dst")).where("dst is not null").select("cfg_id", "src", "dst", kind.alias("edge_type"))


FLOW_EDGES = """flow_edges AS (SELECT cfg_id, src, dst, CASE WHEN dst = 'error' THEN 'exception' WHEN src = dst THEN 'loop' WHEN src = 'click' AND dst = 'purchase' THEN 'cond_true' WHEN src = 'click' THEN 'cond_false' ELSE 'normal' END AS edge_type
  FROM (SELECT user_id AS cfg_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL)"""


def findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings: a user's event as a short range of hours; reason is the event type, severity follows the value."""
    e = table(spark, d, "events")
    start = F.floor(F.unix_timestamp("ts") / 36000).cast("long")
    length = F.pmod(F.col("event_id"), F.lit(4)).cast("long")
    return e.select(F.col("user_id").alias("file_path"), start.alias("start_line"), (start + length).alias("end_line"), F.when(F.pmod(F.col("event_id"), F.lit(3)) == 0, "after_throw").otherwise("after_return").alias("reason"), (F.pmod(F.col("event_id"), F.lit(3)) + 1).cast("int").alias("severity"), F.col("event_id").cast("string").alias("description"))


FINDINGS = """findings AS (SELECT user_id AS file_path, CAST(floor(epoch(ts) / 36000) AS BIGINT) AS start_line, CAST(floor(epoch(ts) / 36000) AS BIGINT) + event_id % 4 AS end_line,
  CASE WHEN event_id % 3 = 0 THEN 'after_throw' ELSE 'after_return' END AS reason, CAST(event_id % 3 + 1 AS INTEGER) AS severity, CAST(event_id AS VARCHAR) AS description FROM events)"""


def fragments(spark: SparkSession, d: str) -> DataFrame:
    """Fragments: a document in its source's file."""
    t = table(spark, d, "documents")
    lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    return t.select(F.col("doc_id").alias("id"), F.col("source").alias("file_path"), F.col("text").alias("content"), F.col("n_chars").alias("node_count"), lines.alias("line_count"), (F.col("doc_id") % 100).alias("start_line"), (F.col("doc_id") % 100 + lines - 1).alias("end_line"))


FRAGMENTS = """fragments AS (SELECT doc_id AS id, source AS file_path, text AS content, n_chars AS node_count, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS line_count,
  doc_id % 100 AS start_line, doc_id % 100 + length(text) - length(replace(text, chr(10), '')) AS end_line FROM documents)"""


def flags(spark: SparkSession, d: str) -> DataFrame:
    """Paired outcomes: a label's two verdicts."""
    return table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("model"), (F.col("toxic") == 1).alias("human"))


FLAGS = "flags AS (SELECT doc_id, quality = 1 AS model, toxic = 1 AS human FROM labels)"


def findings_by_file(spark: SparkSession, d: str) -> DataFrame:
    """Dead code findings on functions' files: orders with the least priority, severity by status."""
    place = functions(spark, d).select(F.col("id").alias("o_custkey"), "file_path")
    severity = F.when(F.col("o_orderstatus") == "F", "critical").when(F.col("o_orderstatus") == "O", "warning").otherwise("info")
    return table(spark, d, "orders").where(F.col("o_orderpriority").startswith("5")).join(place, "o_custkey").select("file_path", F.col("o_orderkey").alias("start_line"), severity.alias("severity"), F.col("o_orderpriority").alias("reason"))


FILE_FINDINGS = FUNCTIONS + """, file_findings AS (SELECT f.file_path, o_orderkey AS start_line, CASE o_orderstatus WHEN 'F' THEN 'critical' WHEN 'O' THEN 'warning' ELSE 'info' END AS severity, o_orderpriority AS reason
  FROM orders JOIN functions f ON o_custkey = f.id WHERE starts_with(o_orderpriority, '5'))"""
