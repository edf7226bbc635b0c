"""Queries of near-duplicate search, clustering, graphs, trees and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from treeloom.functions import sets, text
from treeloom.operators import clones, flow, graph, grouping, imports, lsh, metrics, semantic, stats, trees
from treeloom.plans import frames as R
from treeloom.runtime import Scratch, spread, table
from treeloom.streaming import windows

QUERIES: dict = {}
SQL: dict[str, str] = {}

THRESHOLD = 0.8
#: Shares over which the left side of a pair is dealt.
SHARES = 16


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


r6 = lambda c: F.round(c, 6)


# -- near duplicates


def _features(spark, d):
    # the generator keeps the split from being inlined into each shingle
    words = spread(table(spark, d, "documents")).select(F.col("doc_id").alias("id"), F.explode(F.array(text.words(F.col("text")))).alias("w"))
    return words.select("id", F.array_sort(F.array_distinct(text.shingles(F.col("w"), 4, " "))).alias("features"))


_SETS = """w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents),
f AS (SELECT id, list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) AS features FROM w WHERE len(w) >= 4),
reps AS MATERIALIZED (SELECT min(id) AS id, features FROM f GROUP BY features),
s AS MATERIALIZED (SELECT id, unnest(features) AS s FROM reps)"""


@query(f"WITH {_SETS}, p AS (SELECT a.id AS id1, b.id AS id2, count(*) AS same FROM s a JOIN s b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2), j AS (SELECT id1, id2, same / (len(x.features) + len(y.features) - same) AS jaccard FROM p JOIN reps x ON x.id = id1 JOIN reps y ON y.id = id2) SELECT id1, id2, round(jaccard, 6) AS jaccard FROM j WHERE jaccard >= {THRESHOLD}")
def near_duplicate_documents(spark, d):
    """The flagship: pairs of distinct texts at Jaccard 0.8 of 4-word shingles, by banded MinHash and exact verification."""
    return lsh.near_duplicates(_features(spark, d), THRESHOLD).select("id1", "id2", r6(F.col("jaccard")).alias("jaccard"))


_FAMILY = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(lsh.coefficients()))
_SIGN = f"h AS (SELECT id, CAST('0x' || substr(md5(s), 1, 7) AS BIGINT) AS x FROM s), sig AS MATERIALIZED (SELECT id, slot, min((a * x + b) % {lsh.PRIME}) AS v FROM h CROSS JOIN (VALUES {_FAMILY}) c(slot, a, b) GROUP BY 1, 2)"


def _signed(spark, d):
    f = _features(spark, d).where(F.size("features") > 0)
    return lsh.with_signature(f.groupBy("features").agg(F.min("id").alias("id")), "features").select("id", "sig")


@query(f"WITH {_SETS}, {_SIGN} SELECT id, CAST(sum(v) AS BIGINT) AS total, min(v) AS least, count(*) AS slots FROM sig GROUP BY id")
def minhash_signatures(spark, d):
    """N3"""
    add = F.aggregate("sig", F.lit(0).cast("long"), lambda s, x: s + x)
    return _signed(spark, d).select("id", add.alias("total"), F.array_min("sig").alias("least"), F.size("sig").cast("long").alias("slots"))


_CANDIDATES = "b AS (SELECT id, slot // 4 AS band, string_agg(CAST(v AS VARCHAR), ',' ORDER BY slot) AS key FROM sig GROUP BY 1, 2), candidates AS MATERIALIZED (SELECT DISTINCT x.id AS id1, y.id AS id2 FROM b x JOIN b y ON x.band = y.band AND x.key = y.key AND x.id < y.id)"


@query(f"WITH {_SETS}, {_SIGN}, {_CANDIDATES} SELECT id1, id2 FROM candidates")
def lsh_candidates(spark, d):
    """N5, N6, J3"""
    return lsh.candidates(lsh.banded(_signed(spark, d)))


@query(f"WITH {_SETS}, {_SIGN}, b AS (SELECT id, slot // 4 AS band, string_agg(CAST(v AS VARCHAR), ',' ORDER BY slot) AS key FROM sig GROUP BY 1, 2), c AS (SELECT x.id AS query, y.id AS other, min(x.band) AS band FROM b x JOIN b y ON x.band = y.band AND x.key = y.key GROUP BY 1, 2), p AS (SELECT query, other, row_number() OVER (PARTITION BY query ORDER BY band, other) AS place FROM c) SELECT query, other, place FROM p WHERE place <= 3 AND query <> other")
def lsh_capped_candidates(spark, d):
    """The first three candidates of each query, itself counted."""
    b = lsh.banded(_signed(spark, d))
    return lsh.capped_candidates(b, b, 3).withColumn("place", F.col("place").cast("long"))


@query(f"WITH {_SETS}, {_SIGN}, {_CANDIDATES} SELECT id1, id2, round(count(*) FILTER (WHERE a.v = b.v) / 128, 6) AS estimate FROM candidates JOIN sig a ON a.id = id1 JOIN sig b ON b.id = id2 AND a.slot = b.slot GROUP BY 1, 2")
def jaccard_estimates(spark, d):
    """Estimates of all candidate pairs."""
    s = Scratch(spark).cut(_signed(spark, d))  # read three times, so made once
    a, b = s.select(F.col("id").alias("id1"), F.col("sig").alias("s1")), s.select(F.col("id").alias("id2"), F.col("sig").alias("s2"))
    return lsh.candidates(lsh.banded(s)).join(a, "id1").join(b, "id2").select("id1", "id2", r6(sets.estimated_jaccard(F.col("s1"), F.col("s2"))).alias("estimate"))


@query(f"WITH {_SETS}, {_SIGN}, {_CANDIDATES}, v AS (SELECT id, list_distinct(w) AS f FROM w) SELECT id1, id2, round(len(list_intersect(a.f, b.f)) / len(list_distinct(list_concat(a.f, b.f))), 6) AS jaccard FROM candidates JOIN v a ON a.id = id1 JOIN v b ON b.id = id2")
def jaccard_words(spark, d):
    """Word sets of all candidate pairs of documents."""
    w = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array_distinct(text.words(F.col("text"))).alias("f"))
    a, b = w.select(F.col("id").alias("id1"), F.col("f").alias("fa")), w.select(F.col("id").alias("id2"), F.col("f").alias("fb"))
    return lsh.candidates(lsh.banded(_signed(spark, d))).join(a, "id1").join(b, "id2").select("id1", "id2", r6(sets.jaccard(F.col("fa"), F.col("fb"))).alias("jaccard"))


# -- clustering

_SPAIRS = "sp AS MATERIALIZED (SELECT a.s_suppkey AS id1, b.s_suppkey AS id2, 0.5 + ((a.s_suppkey * 31 + b.s_suppkey * 17) % 50) / 100.0 AS similarity, CAST(1 + (a.s_suppkey + b.s_suppkey) % 4 AS INTEGER) AS pair_type FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey)"
_CONNECTED = f"WITH RECURSIVE {_SPAIRS}, e AS MATERIALIZED (SELECT id1 AS x, id2 AS y FROM sp WHERE similarity >= 0.9 UNION SELECT id2, id1 FROM sp WHERE similarity >= 0.9), reach(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x), g AS MATERIALIZED (SELECT x AS id, least(x, min(y)) AS group_id FROM reach GROUP BY x) "


def _supplier_pairs(spark, d):
    """Nations are few: the left side of each is dealt over shares, and no task pairs a whole nation."""
    s, n = table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), 4 * spark.sparkContext.defaultParallelism
    a = s.select(F.col("s_suppkey").alias("id1"), "s_nationkey", F.pmod("s_suppkey", F.lit(SHARES)).alias("share"))
    b = s.select(F.col("s_suppkey").alias("id2"), "s_nationkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))).alias("share"))
    value = 0.5 + ((F.col("id1") * 31 + F.col("id2") * 17) % 50) / 100.0
    key = ["s_nationkey", "share"]
    return a.repartition(n, *key).join(b.repartition(n, *key), key).where("id1 < id2").select("id1", "id2", value.alias("similarity"), (1 + (F.col("id1") + F.col("id2")) % 4).cast("int").alias("pair_type"))


def _supplier_items(spark, d):
    k = F.col("s_suppkey")
    start = (k % 40).cast("int")
    return table(spark, d, "supplier").select(k.alias("id"), F.concat(F.lit("f"), (k % 3).cast("string")).alias("file_path"), start.alias("start_line"), (start + 5 + (k % 7)).cast("int").alias("end_line"), F.lit(0).alias("start_col"), F.lit(0).alias("end_col"))


@query(_CONNECTED + "SELECT group_id, id FROM g")
def group_connected(spark, d):
    """N43"""
    return grouping.connected(_supplier_pairs(spark, d), 0.9, Scratch(spark))


@query(_CONNECTED + ", n AS (SELECT group_id, count(*) AS size FROM g GROUP BY 1), m AS (SELECT a.group_id, avg(similarity) AS similarity, arg_min(pair_type, (-similarity, pair_type)) AS group_type FROM sp JOIN g a ON a.id = id1 JOIN g b ON b.id = id2 AND a.group_id = b.group_id GROUP BY 1) SELECT group_id, size, round(similarity, 6) AS similarity, group_type FROM n JOIN m USING (group_id)")
def group_metadata(spark, d):
    """N48-N50"""
    p = _supplier_pairs(spark, d)
    return grouping.group_meta(grouping.connected(p, 0.9, Scratch(spark)), p).withColumn("similarity", r6(F.col("similarity")))


_CLONE_IDS = "SELECT id1 AS id FROM sp UNION SELECT id2 FROM sp UNION SELECT id FROM g"


@query(_CONNECTED + f", c AS (SELECT count(*) AS clones FROM ({_CLONE_IDS})) SELECT count(*) AS pairs, round(coalesce(avg(similarity), 0), 6) AS average_similarity, count(*) FILTER (WHERE pair_type = 1) AS type1, count(*) FILTER (WHERE pair_type = 2) AS type2, count(*) FILTER (WHERE pair_type = 3) AS type3, count(*) FILTER (WHERE pair_type = 4) AS type4, (SELECT count(DISTINCT group_id) FROM g) AS groups, (SELECT clones FROM c) AS clones, round((SELECT clones FROM c) / (SELECT count(*) FROM supplier) * 100, 6) AS duplication FROM sp")
def clone_statistics(spark, d):
    """N55, N56, U7"""
    p = _supplier_pairs(spark, d)
    fragments = table(spark, d, "supplier").agg(F.count("*").alias("fragments"))  # one row
    out = clones.statistics(p, grouping.connected(p, 0.9, Scratch(spark))).crossJoin(fragments)
    return out.select(*(r6(F.col(c)).alias(c) if c == "average_similarity" else c for c in out.columns if c != "fragments"), r6(clones.duplication_percent(F.col("clones"), F.col("fragments"))).alias("duplication"))


@query(_CONNECTED + "SELECT 'f' || (id % 3) AS file_path, count(*) AS clones FROM g GROUP BY 1")
def clones_by_file(spark, d):
    """A11"""
    p = _supplier_pairs(spark, d)
    return clones.clones_by_file(p, grouping.connected(p, 0.9, Scratch(spark)), _supplier_items(spark, d))


@query()
def group_k_core(spark, d):
    """N44"""
    return grouping.k_core(_supplier_pairs(spark, d), 0.8, 3, Scratch(spark))


@query()
def group_star_medoid(spark, d):
    """N45"""
    return grouping.star_medoid(_supplier_pairs(spark, d), 0.8, Scratch(spark))


@query()
def group_complete_linkage(spark, d):
    """N46"""
    return grouping.complete_linkage(_supplier_pairs(spark, d), _supplier_items(spark, d), 0.8, Scratch(spark))


@query()
def group_centroid(spark, d):
    """N47"""
    return grouping.centroid(_supplier_pairs(spark, d), _supplier_items(spark, d), 0.8, Scratch(spark))


@query()
def group_pipeline(spark, d):
    """N51-N54"""
    return grouping.pipeline("complete_linkage", _supplier_pairs(spark, d), _supplier_items(spark, d), 0.8, Scratch(spark))


# -- graphs

_CLOSURE = f"WITH RECURSIVE {R.NATION_EDGES}, reach(src, dst) AS (SELECT src, dst FROM nation_edges UNION SELECT r.src, e.dst FROM reach r JOIN nation_edges e ON r.dst = e.src), nodes AS (SELECT src AS id FROM nation_edges UNION SELECT dst FROM nation_edges), comp AS MATERIALIZED (SELECT n.id, least(n.id, coalesce(min(a.dst), n.id)) AS component FROM nodes n LEFT JOIN (SELECT a.src, a.dst FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src) a ON a.src = n.id GROUP BY n.id) "


def _nation_graph(spark, d):
    """Few vertices whatever the scale: the trade counts are cut once."""
    scratch = Scratch(spark)
    return scratch.cut(R.nation_edges(spark, d)), scratch


def _components(spark, d):
    e, scratch = _nation_graph(spark, d)
    return scratch.cut(graph.scc(graph.vertices(e), e, scratch)), e, scratch


@query(_CLOSURE + "SELECT src, dst FROM reach")
def graph_closure(spark, d):
    """G13"""
    return graph.transitive_closure(*_nation_graph(spark, d))


@query(_CLOSURE + "SELECT id, component FROM comp")
def graph_scc(spark, d):
    """G2"""
    return _components(spark, d)[0]


@query(_CLOSURE + ", z AS (SELECT component, count(*) AS size FROM comp GROUP BY 1 HAVING count(*) > 1), i AS (SELECT a.component, src, dst, weight FROM nation_edges JOIN comp a ON a.id = src JOIN comp b ON b.id = dst AND a.component = b.component WHERE src <> dst) SELECT component, size, CASE WHEN size <= 2 THEN 'low' WHEN size <= 4 THEN 'medium' WHEN size <= 6 THEN 'high' ELSE 'critical' END AS severity, count(*) AS edges, arg_min(src, (weight, src, dst)) AS cut_src, arg_min(dst, (weight, src, dst)) AS cut_dst FROM z JOIN i USING (component) GROUP BY component, size")
def graph_cycles(spark, d):
    """G3-G5"""
    c, e, _ = _components(spark, d)
    return graph.cycles(c, e)


@query(_CLOSURE + "SELECT a.component AS csrc, b.component AS cdst, arg_min(src, (src, dst)) AS src, arg_min(dst, (src, dst)) AS dst FROM nation_edges JOIN comp a ON a.id = src JOIN comp b ON b.id = dst WHERE a.component <> b.component GROUP BY 1, 2")
def graph_condensation(spark, d):
    """G7"""
    c, e, _ = _components(spark, d)
    return graph.condensation(c, e)


@query(_CLOSURE + ", z AS (SELECT component, count(*) AS own FROM comp GROUP BY 1), dag AS (SELECT DISTINCT a.component AS csrc, b.component AS cdst FROM nation_edges JOIN comp a ON a.id = src JOIN comp b ON b.id = dst WHERE a.component <> b.component), walk(component, head, length) AS (SELECT component, component, own FROM z UNION SELECT csrc, csrc, own + length FROM walk JOIN dag ON cdst = head JOIN z ON z.component = csrc) SELECT component, max(length) AS length FROM walk GROUP BY 1")
def graph_longest_chains(spark, d):
    """The longest chain below each component, counted in modules."""
    c, e, scratch = _components(spark, d)
    out = graph.longest_chains(c, graph.condensation(c, e), scratch)
    return out.select("component", "length")


@query(f"WITH RECURSIVE {R.NATION_EDGES}, walk(id, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT dst, depth + 1 FROM walk JOIN nation_edges ON src = id WHERE depth < 3) SELECT id, min(depth) AS depth FROM walk GROUP BY id")
def graph_depth_filter(spark, d):
    """Breadth first to depth three."""
    e, scratch = _nation_graph(spark, d)
    return graph.depths(spark.createDataFrame([(0,)], "id long"), e, scratch, 3)


@query(f"WITH {R.NATION_EDGES} SELECT id, count(*) AS total FROM (SELECT src AS id FROM nation_edges UNION ALL SELECT dst FROM nation_edges) GROUP BY id HAVING count(*) >= 4")
def graph_min_coupling(spark, d):
    """P16"""
    c = graph.coupling(R.nation_edges(spark, d).select("src", "dst"))
    return c.withColumn("total", F.col("ca") + F.col("ce")).where("total >= 4").select("id", "total")


@query(f"WITH RECURSIVE {R.NATION_EDGES}, walk(id) AS (SELECT n_nationkey::BIGINT FROM nation WHERE n_nationkey NOT IN (SELECT dst FROM nation_edges) UNION SELECT dst FROM walk JOIN nation_edges ON src = id) SELECT n_nationkey::BIGINT AS id FROM nation WHERE n_nationkey NOT IN (SELECT id FROM walk)")
def graph_orphans(spark, d):
    """What no root reaches, so cycles without an entry."""
    e, scratch = _nation_graph(spark, d)
    name = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"), F.lit(".ts"))
    files = table(spark, d, "nation").select(name("n_nationkey").alias("file_path"))
    edges = e.select(name("src").alias("src"), name("dst").alias("dst"))
    return imports.orphans(files, edges, scratch).select(F.regexp_extract("id", r"n(\d+)", 1).cast("long").alias("id"))


# -- cohesion, reachability, data flow


@query("WITH RECURSIVE mv AS MATERIALIZED (SELECT DISTINCT s_nationkey AS class, l_suppkey AS method, l_partkey AS var FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), e AS MATERIALIZED (SELECT DISTINCT a.method AS x, b.method AS y FROM mv a JOIN mv b ON a.class = b.class AND a.var = b.var), reach(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x), c AS (SELECT x, min(y) AS component FROM reach GROUP BY x) SELECT s_nationkey AS class, count(DISTINCT coalesce(component, s_suppkey)) AS lcom4 FROM supplier LEFT JOIN c ON x = s_suppkey GROUP BY 1")
def lcom4(spark, d):
    """A17"""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("class"), F.col("s_suppkey").alias("method"))
    used = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("method"), F.col("l_partkey").alias("var")).distinct()
    calls = spark.createDataFrame([], "class int, method long, callee long")
    return metrics.lcom4(used.join(s, "method").select("class", "method", "var"), s, calls, Scratch(spark))


@query(f"WITH RECURSIVE {R.FLOW_EDGES}, live AS MATERIALIZED (SELECT DISTINCT cfg_id, src, dst FROM flow_edges WHERE edge_type <> 'normal' OR src <> 'error'), walk(cfg_id, b) AS (SELECT DISTINCT user_id, 'signup' FROM events WHERE event_type = 'signup' UNION SELECT w.cfg_id, dst FROM walk w JOIN live l ON l.cfg_id = w.cfg_id AND l.src = w.b), n AS (SELECT user_id AS cfg_id, count(DISTINCT event_type) AS blocks FROM events GROUP BY 1), r AS (SELECT cfg_id, count(*) AS hit FROM walk GROUP BY 1) SELECT cfg_id, blocks, blocks - coalesce(hit, 0) AS unreachable, round(coalesce(hit, 0) / blocks, 6) AS ratio FROM n LEFT JOIN r USING (cfg_id)")
def cfg_reachability(spark, d):
    """C4, C5"""
    e = table(spark, d, "events")
    blocks = e.select(F.col("user_id").alias("cfg_id"), F.col("event_type").alias("block_id")).distinct()
    reached = flow.reachable_blocks(blocks.where("block_id = 'signup'"), R.flow_edges(spark, d), blocks.where("block_id = 'error'"), Scratch(spark))
    return flow.reachability_ratio(blocks, reached).withColumn("ratio", r6(F.col("ratio")))


@query("WITH s AS (SELECT user_id AS cfg_id, day(ts) AS block_id, row_number() OVER (PARTITION BY user_id, day(ts) ORDER BY ts, event_id) AS pos, CASE event_type WHEN 'error' THEN 'throw' WHEN 'signup' THEN 'break' ELSE event_type END AS kind FROM events), a AS (SELECT *, first_value(CASE WHEN kind IN ('throw', 'break') THEN kind END IGNORE NULLS) OVER (PARTITION BY cfg_id, block_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS after FROM s) SELECT cfg_id, block_id, pos, 'after_' || after AS reason, CASE WHEN after = 'throw' THEN 'warning' ELSE 'info' END AS severity FROM a WHERE after IS NOT NULL")
def dead_statements(spark, d):
    """C12"""
    e = table(spark, d, "events")
    pos = F.row_number().over(Window.partitionBy("user_id", F.dayofmonth("ts")).orderBy("ts", "event_id")).cast("long")
    kind = F.when(F.col("event_type") == "error", "throw").when(F.col("event_type") == "signup", "break").otherwise(F.col("event_type"))
    rows = e.select(F.col("user_id").alias("cfg_id"), F.dayofmonth("ts").cast("long").alias("block_id"), pos.alias("pos"), kind.alias("kind"))
    return flow.dead_statements(rows).select("cfg_id", "block_id", "pos", "reason", "severity")


@query()
def def_use_blocks(spark, d):
    """J15 across blocks: days are blocks in a line, uses look back to the nearest day with a definition."""
    e = table(spark, d, "events").where("event_type in ('signup', 'purchase')")
    block = F.dayofmonth("ts").cast("long")
    refs = e.select(F.col("user_id").alias("cfg_id"), F.lit("v").alias("name"), (F.col("event_type") == "signup").alias("is_def"), block.alias("block_id"), F.col("event_id").alias("pos"))
    days = refs.select("cfg_id", F.col("block_id").alias("src")).distinct()
    edges = days.withColumn("dst", F.lead("src").over(Window.partitionBy("cfg_id").orderBy("src"))).where("dst is not null")
    return flow.def_use(refs, edges, Scratch(spark))


_KINDS = ["cond_false", "cond_true", "exception", "loop", "normal"]
_CFGSIM = (
    f"WITH {R.FLOW_EDGES}, n AS (SELECT cfg_id, count(DISTINCT b) AS blocks FROM (SELECT cfg_id, src AS b FROM flow_edges UNION ALL SELECT cfg_id, dst FROM flow_edges) GROUP BY 1), "
    "f AS (SELECT cfg_id, any_value(blocks) AS bl, count(*) AS e, count(*) - any_value(blocks) + 2 AS cy, count(*) / any_value(blocks) AS br, "
    + ", ".join(f"count(*) FILTER (WHERE edge_type = '{k}') AS k{i}" for i, k in enumerate(_KINDS))
    + " FROM flow_edges JOIN n USING (cfg_id) GROUP BY cfg_id) SELECT a.cfg_id AS id1, b.cfg_id AS id2, round("
    + " + ".join(f"{w} * (CASE WHEN greatest({x}, {y}) = 0 THEN 1 ELSE 1 - abs({x} - {y}) / greatest({x}, {y}) END)" for w, x, y in [(0.20, "a.bl", "b.bl"), (0.15, "a.e", "b.e"), (0.25, "a.cy", "b.cy"), (0.10, "a.br", "b.br"), (0.05, "(a.k3 + a.k0 + a.k1)", "(b.k3 + b.k0 + b.k1)")])
    + " + 0.25 * ("
    + " + ".join(f"a.k{i} * b.k{i}" for i in range(5))
    + ") / (sqrt("
    + " + ".join(f"a.k{i} * a.k{i}" for i in range(5))
    + ") * sqrt("
    + " + ".join(f"b.k{i} * b.k{i}" for i in range(5))
    + ")), 6) AS similarity FROM f a JOIN f b ON b.cfg_id = a.cfg_id + 1"
)


@query(_CFGSIM)
def semantic_similarity(spark, d):
    """Control flow of neighbouring users."""
    f = flow.cfg_features(R.flow_edges(spark, d))
    one = f.select("cfg_id", F.struct(*[c for c in f.columns if c != "cfg_id"]).alias("s"))
    a, b = one.select(F.col("cfg_id").alias("id1"), F.col("s").alias("a")), one.select(F.col("cfg_id").alias("id2"), F.col("s").alias("b"))
    return a.join(b, F.col("id2") == F.col("id1") + 1).select("id1", "id2", r6(semantic.combined(semantic.cfg_similarity(F.col("a"), F.col("b")), None)).alias("similarity"))


@query("WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT a.vec_id AS id1, b.vec_id AS id2, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS cosine FROM v a JOIN v b ON b.vec_id = a.vec_id + 1")
def vector_cosine(spark, d):
    """N41 over dense vectors of neighbouring ids."""
    v = table(spark, d, "embeddings")
    a, b = v.select(F.col("vec_id").alias("id1"), F.col("embedding").alias("a")), v.select(F.col("vec_id").alias("id2"), F.col("embedding").alias("b"))
    return a.join(b, F.col("id2") == F.col("id1") + 1).select("id1", "id2", r6(sets.dense_cosine(F.col("a"), F.col("b"))).alias("cosine"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 0.5 WHEN o_custkey % 3 = 0 THEN 0.75 WHEN o_custkey % 7 = 0 THEN 0.75 ELSE 1.0 END * 0.8 AS value FROM orders")
def semantic_evidence(spark, d):
    """The first discount that applies."""
    k = F.col("o_custkey")
    arr = lambda hit, a, b: F.when(hit, F.array(*map(F.lit, a))).otherwise(F.array(*map(F.lit, b)))
    lit = arr(k % 5 == 0, ["1", "2"], ["1"])
    strong = arr(k % 3 == 0, ["s"], ["t"])
    ret = arr(k % 7 == 0, ["r"], ["q"])
    one = lambda x: F.array(*map(F.lit, x))
    value = sets.semantic_evidence(F.lit(0.8), strong, one(["t"]), ret, one(["q"]), lit, one(["3", "4"]))
    return table(spark, d, "orders").select("o_orderkey", value.alias("value"))


# -- trees (S7, N8-N13, N22-N29, C10, C11)


@query()
def tree_nodes(spark, d):
    """Pages as node rows."""
    return trees.nodes(table(spark, d, "pages"))


@query()
def tree_nesting(spark, d):
    """C10, C11"""
    return flow.nesting_depth(trees.nodes(table(spark, d, "pages")))


@query()
def tree_features(spark, d):
    """Label and sequence features beside subtree hashes."""
    pages = table(spark, d, "pages")
    labels = trees.label_features(trees.nodes(pages))
    sub = pages.select(F.col("page_id").alias("tree_id"), F.explode(trees.html_subtrees(F.col("html"))).alias("feature"))
    return labels.union(sub).groupBy("tree_id").agg(F.count("*").alias("features"), F.md5(F.array_join(F.array_sort(F.collect_list("feature")), "\n")).alias("digest"))


@query()
def tree_edit_distance(spark, d):
    """Pages of neighbouring ids whose sizes are comparable; the distance comes last."""
    t = table(spark, d, "pages").select("page_id", trees.html_tree(F.col("html")).alias("t"))
    t = Scratch(spark).cut(t.select("page_id", "t.labels", "t.lml", "t.size"))
    a = t.select(F.col("page_id").alias("id1"), F.col("labels").alias("l1"), F.col("lml").alias("m1"), F.col("size").alias("n1"))
    b = t.select(F.col("page_id").alias("id2"), F.col("labels").alias("l2"), F.col("lml").alias("m2"), F.col("size").alias("n2"))
    near = a.join(b, F.col("id2") == F.col("id1") + 1).where(F.abs(F.col("n1") - F.col("n2")) / ((F.col("n1") + F.col("n2")) / 2.0) <= 0.5)
    out = near.withColumn("distance", trees.tree_distance("l1", "m1", "l2", "m2"))
    return out.select("id1", "id2", "distance", r6(trees.similarity(F.col("distance"), F.col("n1"), F.col("n2"))).alias("similarity"))


@query()
def mcnemar(spark, d):
    """A21"""
    counts = stats.paired_counts(R.flags(spark, d), "model", "human")
    return counts.withColumn("p", F.round(stats.mcnemar_exact(F.col("b"), F.col("c")), 12)).withColumn("adjusted", F.round(stats.bonferroni(F.col("p"), 14), 12))


# -- streaming: an extension beyond the reference's batch operators


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_events(spark, d):
    """Extension: a windowed stream with a watermark, run to the end of what is there."""
    return windows.daily_counts(spark, d)
