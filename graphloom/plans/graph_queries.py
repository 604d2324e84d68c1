"""Queries over forests and relation graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import hierarchy as H
from ..operators import layout as L
from ..sources import adapters as A
from .node_queries import CLAIMS_SQL


def _forest(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = A.forest_nodes(spark, d)
    return n, n.where("parent_id <> ''").select(F.col("node_id").alias("child"), F.col("parent_id").alias("parent"))


def forest_projection(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers whose orders name several nations have several candidate parents; every tenth names itself."""
    nodes = A.table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node_id"))
    s = A.table(spark, d, "supplier")
    ident = lambda c: F.concat(F.lit("s"), c.cast("string"))
    k = F.col("s_suppkey")
    first = s.select(ident(k).alias("child"), F.when(k % 10 == 3, ident(k)).otherwise(ident(F.floor(k / 2))).alias("parent"))
    second = s.where(k % 7 == 0).select(ident(k).alias("child"), ident(k + 60).alias("parent"))
    loop = s.where(k.isin(0, 1)).select(ident(k).alias("child"), ident(1 - k).alias("parent"))
    candidates = first.where("child not in ('s0', 's1')").unionByName(second.where("child <> 's0'")).unionByName(loop).distinct()
    parents, issues = H.projected(nodes, candidates)
    return parents.select(F.lit("parent").alias("code"), F.col("child").alias("node_id"), F.col("parent").alias("detail")).unionByName(issues)


def ancestor_closure(spark: SparkSession, d: str) -> DataFrame:
    return H.ancestors(_forest(spark, d)[1]).select("node_id", "ancestor", F.col("distance").cast("long").alias("distance"))


def layer_mapping(spark: SparkSession, d: str) -> DataFrame:
    n, parents = _forest(spark, d)
    return H.layers(n.select("node_id", T.is_container(F.col("node_type")).alias("is_container")), parents).withColumn("depth", F.col("depth").cast("long"))


def layer_summary(spark: SparkSession, d: str) -> DataFrame:
    return layer_mapping(spark, d).groupBy("layer", "role", "depth").agg(F.count(F.lit(1)).alias("n"))


def lowest_common_scope(spark: SparkSession, d: str) -> DataFrame:
    c = A.table(spark, d, "customer")
    pairs = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("a"), F.concat(F.lit("s"), (F.col("c_custkey") % 100).cast("string")).alias("b"))
    return H.lowest_common(pairs, _forest(spark, d)[1])


def cycle_detection(spark: SparkSession, d: str) -> DataFrame:
    p = A.table(spark, d, "part").select(F.col("p_partkey").alias("child"), ((F.col("p_partkey") * F.col("p_partkey") + 7) % 211).alias("parent"))
    return H.cycle_members(p)


def _backbone(spark: SparkSession, d: str) -> DataFrame:
    c = A.local_claims(spark, d)
    return c.where(T.relation_type(F.col("relation_type")).isin("prerequisite", "progressive", "derives_to")).select(F.col("source_key").alias("a"), F.col("target_key").alias("b")).where("a <> b").distinct()


def connected_components(spark: SparkSession, d: str) -> DataFrame:
    nodes = A.table(spark, d, "part").select(F.col("p_partkey").alias("node_id"))
    return G.components(nodes, _backbone(spark, d)).groupBy("component").agg(F.count(F.lit(1)).alias("members"))


def scc_ranks(spark: SparkSession, d: str) -> DataFrame:
    nodes = A.table(spark, d, "part").select(F.col("p_partkey").alias("node_id"))
    return G.condensed_ranks(nodes, _backbone(spark, d)).withColumn("rank", F.col("rank").cast("long"))


def relation_groups(spark: SparkSession, d: str) -> DataFrame:
    nodes = A.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("node_id"))
    links = _backbone(spark, d).select(F.col("a").cast("string").alias("source_id"), F.col("b").cast("string").alias("target_id"))
    return G.relation_groups(nodes, links)


def _chapters(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nodes = A.local_nodes(spark, d).select("chapter", F.col("ord").alias("key"), F.lpad(F.col("temporary_id"), 9, "0").alias("node_id"), T.node_type(F.col("node_type")).alias("node_type"), "ord")
    ends = nodes.select("chapter", "key", "node_id")
    c = A.local_claims(spark, d).select("source_key", "target_key", T.relation_type(F.col("relation_type")).alias("relation_type"))
    edges = c.join(ends.select(F.col("key").alias("source_key"), F.col("chapter"), F.col("node_id").alias("source_id")), "source_key").join(ends.select(F.col("key").alias("target_key"), F.col("chapter").alias("other"), F.col("node_id").alias("target_id")), "target_key")
    return nodes.drop("key"), edges.where("chapter = other and source_id <> target_id").select("chapter", "source_id", "target_id", "relation_type").distinct()


def main_path(spark: SparkSession, d: str) -> DataFrame:
    return G.chapter_plans(*_chapters(spark, d))


def node_score(spark: SparkSession, d: str) -> DataFrame:
    return G.node_scores(*_chapters(spark, d)).select("chapter", "node_id", "score", F.col("incoming").cast("long").alias("incoming"))


def start_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.start_nodes(G.node_scores(*_chapters(spark, d)))


def isolated_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Parts that no claim names, and documents that no label describes."""
    ident = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string")).alias("node_id")
    named = A.local_claims(spark, d).select(F.explode(F.array("source_key", "target_key")).alias("key")).distinct()  # a row for each part, not for each claim
    used = named.select(ident("p", "key")).union(A.table(spark, d, "labels").select("doc_id").distinct().select(ident("d", "doc_id")))
    nodes = A.table(spark, d, "part").select(ident("p", "p_partkey")).union(A.table(spark, d, "documents").select(ident("d", "doc_id")))
    return nodes.join(used, "node_id", "left_anti")


def duplicate_names(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "part").groupBy(F.trim("p_name").alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def duplicate_edges(spark: SparkSession, d: str) -> DataFrame:
    c = A.local_claims(spark, d)
    return c.groupBy(T.edge_id(F.col("source_key").cast("string"), F.col("relation_type"), F.col("target_key").cast("string")).alias("edge_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def relation_counts(spark: SparkSession, d: str) -> DataFrame:
    c = A.local_claims(spark, d)
    return c.select(F.explode(F.array("source_key", "target_key")).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))


def symmetry_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Symmetric relations whose two ends also have a directional one, either way."""
    c = A.local_claims(spark, d).select("source_key", "target_key", T.directionality(F.col("relation_type")).alias("way"), F.least("source_key", "target_key").alias("lo"), F.greatest("source_key", "target_key").alias("hi"))
    return c.where("way = 'symmetric'").select("lo", "hi").distinct().join(c.where("way = 'directional'").select("lo", "hi"), ["lo", "hi"], "left_semi")


def _cards(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "part").select(F.col("p_brand").alias("group"), F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("node_id"), F.col("p_partkey").alias("ord"), F.col("p_size"))


def shelf_grid(spark: SparkSession, d: str) -> DataFrame:
    return L.grid(_cards(spark, d))


def column_fallback(spark: SparkSession, d: str) -> DataFrame:
    return L.columns(_cards(spark, d)).groupBy("group", "rank").agg(F.count(F.lit(1)).alias("n"))


def shelf_packing(spark: SparkSession, d: str) -> DataFrame:
    units = _cards(spark, d).select("group", F.col("node_id").alias("unit_id"), "ord", (F.col("p_size") * 10.0).alias("width"), (F.col("p_size") % 7 * 20.0 + 20).alias("height"))
    return L.shelves(units, 1200.0)


def geometry_overlap(spark: SparkSession, d: str) -> DataFrame:
    boxes = _cards(spark, d).select("group", "node_id", (F.col("ord") % 37 * 60.0).alias("x"), (F.col("ord") % 23 * 45.0).alias("y"), (F.col("p_size") * 4.0).alias("width"), (F.col("p_size") * 3.0).alias("height"))
    return L.overlaps(boxes, 128.0)  # boxes are 200 by 150 at most


def port_allocation(spark: SparkSession, d: str) -> DataFrame:
    line = A.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("card"), F.when(F.col("l_returnflag") == "A", "left").otherwise("right").alias("side"), F.concat_ws("#", "l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_extendedprice") * 100).cast("long").cast("string")).alias("edge_id"), F.col("l_partkey").alias("opposite")).where("card < 20")
    return L.ports(line.distinct()).select("card", "side", "edge_id", F.round("fraction", 9).alias("fraction"))


QUERIES = {f.__name__: f for f in (forest_projection, ancestor_closure, layer_mapping, layer_summary, lowest_common_scope, cycle_detection, connected_components, scc_ranks, relation_groups, main_path, node_score, start_nodes, isolated_nodes, duplicate_names, duplicate_edges, relation_counts, symmetry_conflicts, shelf_grid, column_fallback, shelf_packing, geometry_overlap, port_allocation)}

FOREST_SQL = """forest AS (SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS node_id, '' AS parent_id, true AS box FROM region
    UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'r' || CAST(n_regionkey AS VARCHAR), true FROM nation UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR), 'n' || CAST(s_nationkey AS VARCHAR), false FROM supplier
    UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR), 'n' || CAST(c_nationkey AS VARCHAR), false FROM customer)"""
CLOSURE_SQL = f"""WITH RECURSIVE {FOREST_SQL},
  up AS (SELECT node_id, parent_id AS ancestor, 1 AS distance FROM forest WHERE parent_id <> '' UNION ALL SELECT up.node_id, f.parent_id, up.distance + 1 FROM up JOIN forest f ON f.node_id = up.ancestor WHERE f.parent_id <> '')"""
LAYERS_SQL = f"""{CLOSURE_SQL},
  chain AS (SELECT node_id, max(distance) AS depth, arg_max(ancestor, distance) AS root_id, string_agg(ancestor, '/' ORDER BY distance DESC) AS above FROM up GROUP BY node_id),
  layers AS (SELECT f.node_id, f.parent_id, coalesce(depth, 0) AS depth, CASE WHEN NOT box THEN 'knowledge' WHEN coalesce(depth, 0) = 0 THEN 'chapter' WHEN depth = 1 THEN 'section' ELSE 'subsection' END AS role, coalesce(root_id, f.node_id) AS root_id, concat_ws('/', above, f.node_id) AS path
    FROM forest f LEFT JOIN chain c ON c.node_id = f.node_id)"""
BACKBONE_SQL = f"""{CLAIMS_SQL}, backbone AS (SELECT DISTINCT source_key AS a, target_key AS b FROM claims WHERE relation_type IN ('prerequisite', 'progressive', 'derives_to') AND source_key <> target_key)"""
SCORES_SQL = f"""WITH {CLAIMS_SQL},
  n AS (SELECT p_brand AS chapter, p_partkey, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS node_id, CASE p_type WHEN 'ECONOMY' THEN 4 WHEN 'LARGE' THEN 3 WHEN 'SMALL' THEN 3 WHEN 'MEDIUM' THEN 2 END AS base FROM part),
  e AS (SELECT DISTINCT s.chapter, s.node_id AS a, t.node_id AS b, relation_type FROM claims c JOIN n s ON s.p_partkey = c.source_key JOIN n t ON t.p_partkey = c.target_key
    WHERE s.chapter = t.chapter AND s.node_id <> t.node_id AND s.base IS NOT NULL AND t.base IS NOT NULL AND relation_type IN ('prerequisite', 'progressive', 'derives_to')),
  w AS (SELECT *, CASE relation_type WHEN 'prerequisite' THEN 3 ELSE 2 END AS weight FROM e),
  load AS (SELECT chapter, node_id, sum(weight) AS load, sum(k) AS incoming FROM (SELECT chapter, a AS node_id, weight, 0 AS k FROM w UNION ALL SELECT chapter, b, weight, 1 FROM w) q GROUP BY chapter, node_id),
  scores AS (SELECT n.chapter, n.node_id, n.p_partkey, CAST(base + coalesce(load, 0) AS BIGINT) AS score, CAST(coalesce(incoming, 0) AS BIGINT) AS incoming FROM n LEFT JOIN load l ON l.chapter = n.chapter AND l.node_id = n.node_id WHERE base IS NOT NULL)"""

ORACLE_SQL = {
    "forest_projection": """WITH RECURSIVE s AS (SELECT s_suppkey AS k FROM supplier), top AS (SELECT max(k) AS m FROM s),
      cand AS (SELECT DISTINCT child, parent FROM (SELECT k AS child, CASE WHEN k % 10 = 3 THEN k ELSE k // 2 END AS parent FROM s WHERE k > 1 UNION ALL SELECT k, k + 60 FROM s WHERE k % 7 = 0 AND k > 0 UNION ALL SELECT k, 1 - k FROM s WHERE k <= 1) q),
      known AS (SELECT * FROM cand WHERE parent IN (SELECT k FROM s)), others AS (SELECT * FROM known WHERE child <> parent),
      counted AS (SELECT child, count(DISTINCT parent) AS n, min(parent) AS parent, string_agg(DISTINCT 's' || CAST(parent AS VARCHAR), '|' ORDER BY 's' || CAST(parent AS VARCHAR)) AS parents FROM others GROUP BY child),
      single AS (SELECT child, parent FROM counted WHERE n = 1)
      SELECT 'parent' AS code, 's' || CAST(child AS VARCHAR) AS node_id, 's' || CAST(parent AS VARCHAR) AS detail FROM single WHERE child > 1
      UNION ALL SELECT 'hierarchy_endpoint_missing', 's' || CAST(child AS VARCHAR), 's' || CAST(parent AS VARCHAR) FROM cand WHERE parent NOT IN (SELECT k FROM s)
      UNION ALL SELECT 'hierarchy_self_parent', 's' || CAST(child AS VARCHAR), 's' || CAST(parent AS VARCHAR) FROM known WHERE child = parent
      UNION ALL SELECT 'hierarchy_multiple_parents', 's' || CAST(child AS VARCHAR), parents FROM counted WHERE n > 1
      UNION ALL SELECT 'hierarchy_cycle', 's0', 's0|s1'""",
    "ancestor_closure": f"{CLOSURE_SQL} SELECT node_id, ancestor, CAST(distance AS BIGINT) AS distance FROM up",
    "layer_mapping": f"{LAYERS_SQL} SELECT node_id, parent_id, CAST(depth AS BIGINT) AS depth, role, CASE WHEN role = 'chapter' THEN 'chapter' ELSE 'knowledge_point' END AS layer, root_id, path FROM layers",
    "layer_summary": f"{LAYERS_SQL} SELECT CASE WHEN role = 'chapter' THEN 'chapter' ELSE 'knowledge_point' END AS layer, role, CAST(depth AS BIGINT) AS depth, count(*) AS n FROM layers GROUP BY ALL",
    "lowest_common_scope": """WITH p AS (SELECT c_custkey, c_nationkey, c_custkey % 100 AS k FROM customer)
      SELECT 'c' || CAST(c_custkey AS VARCHAR) AS a, 's' || CAST(k AS VARCHAR) AS b, CASE WHEN s.s_suppkey IS NULL THEN NULL WHEN c_nationkey = s_nationkey THEN 'n' || CAST(c_nationkey AS VARCHAR) WHEN n.n_regionkey = m.n_regionkey THEN 'r' || CAST(n.n_regionkey AS VARCHAR) END AS lca
      FROM p LEFT JOIN supplier s ON s.s_suppkey = k LEFT JOIN nation n ON n.n_nationkey = c_nationkey LEFT JOIN nation m ON m.n_nationkey = s_nationkey""",
    "cycle_detection": """WITH RECURSIVE p AS (SELECT p_partkey AS child, (p_partkey * p_partkey + 7) % 211 AS parent FROM part),
      walk AS (SELECT child AS origin, parent AS place, least(child, parent) AS low, 1 AS n FROM p WHERE child < 211 UNION ALL SELECT w.origin, p.parent, least(w.low, p.parent), w.n + 1 FROM walk w JOIN p ON p.child = w.place WHERE w.place <> w.origin AND w.n < 220)
      SELECT origin AS node_id, min(low) AS cycle_id FROM walk WHERE place = origin GROUP BY origin""",
    "connected_components": f"""WITH RECURSIVE {BACKBONE_SQL},
      both_ways AS (SELECT a, b FROM backbone UNION SELECT b, a FROM backbone), reach AS (SELECT p_partkey AS node_id, p_partkey AS root FROM part UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.node_id WHERE r.root < e.b),
      low AS (SELECT node_id, min(root) AS component FROM reach GROUP BY node_id)
      SELECT component, count(*) AS members FROM low GROUP BY component""",
    "node_score": f"{SCORES_SQL} SELECT chapter, node_id, score, incoming FROM scores",
    "start_nodes": f"{SCORES_SQL} SELECT chapter, node_id FROM (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY incoming, score DESC, p_partkey) AS r FROM scores) q WHERE r = 1",
    "isolated_nodes": f"""WITH {CLAIMS_SQL}, u AS (SELECT source_key AS k FROM claims UNION SELECT target_key FROM claims)
      SELECT 'p' || CAST(p_partkey AS VARCHAR) AS node_id FROM part WHERE p_partkey NOT IN (SELECT k FROM u) UNION ALL SELECT 'd' || CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "duplicate_names": "SELECT trim(p_name) AS name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1",
    "duplicate_edges": f"WITH {CLAIMS_SQL} SELECT CAST(source_key AS VARCHAR) || '--' || relation_type || '--' || CAST(target_key AS VARCHAR) AS edge_id, count(*) AS n FROM claims GROUP BY 1 HAVING count(*) > 1",
    "relation_counts": f"WITH {CLAIMS_SQL} SELECT k AS node_id, count(*) AS n FROM (SELECT source_key AS k FROM claims UNION ALL SELECT target_key FROM claims) q GROUP BY k",
    "symmetry_conflicts": f"""WITH {CLAIMS_SQL}, p AS (SELECT least(source_key, target_key) AS lo, greatest(source_key, target_key) AS hi, relation_type IN ('contrast', 'parallel') AS sym FROM claims)
      SELECT lo, hi FROM p GROUP BY lo, hi HAVING bool_or(sym) AND bool_or(NOT sym)""",
    "shelf_grid": """WITH c AS (SELECT p_brand AS "group", lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS node_id, row_number() OVER w - 1 AS i, greatest(1, CAST(ceil(sqrt(count(*) OVER v * 1.6)) AS BIGINT)) AS k FROM part WINDOW v AS (PARTITION BY p_brand), w AS (PARTITION BY p_brand ORDER BY p_partkey))
      SELECT "group", node_id, (i % k) * 220.0::DOUBLE AS x, (i // k) * 104.0::DOUBLE AS y, 180.0::DOUBLE AS width, 64.0::DOUBLE AS height FROM c""",
    "column_fallback": """WITH c AS (SELECT p_brand AS "group", row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT "group", i % least(3, n) AS rank, count(*) AS n FROM c GROUP BY ALL""",
    "geometry_overlap": """WITH b AS (SELECT p_brand AS "group", lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS node_id, p_partkey % 37 * 60.0 AS x, p_partkey % 23 * 45.0 AS y, p_size * 4.0 AS w, p_size * 3.0 AS h FROM part)
      SELECT a."group", a.node_id AS a, b.node_id AS b FROM b a JOIN b b ON a."group" = b."group" AND a.node_id < b.node_id AND a.x + 1 < b.x + b.w AND b.x + 1 < a.x + a.w AND a.y + 1 < b.y + b.h AND b.y + 1 < a.y + a.h""",
    "port_allocation": """WITH e AS (SELECT DISTINCT l_suppkey AS card, CASE WHEN l_returnflag = 'A' THEN 'left' ELSE 'right' END AS side, CAST(l_orderkey AS VARCHAR) || '#' || CAST(l_linenumber AS VARCHAR) || '#' || CAST(l_partkey AS VARCHAR) || '#' || CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR) AS edge_id, l_partkey AS opposite FROM lineitem WHERE l_suppkey < 20)
      SELECT card, side, edge_id, round(row_number() OVER (PARTITION BY card, side ORDER BY opposite, edge_id) * 1.0::DOUBLE / (count(*) OVER (PARTITION BY card, side) + 1), 9) AS fraction FROM e""",
    "shelf_packing": """WITH RECURSIVE u AS (SELECT p_brand AS g, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS unit_id, p_size * 10.0::DOUBLE AS w, p_size % 7 * 20.0::DOUBLE + 20 AS h, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part),
      walk AS (SELECT g, unit_id, w, h, i, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, h AS tall FROM u WHERE i = 1
        UNION ALL SELECT u.g, u.unit_id, u.w, u.h, u.i, CASE WHEN k.x + k.w + 40 + u.w > 1200 THEN 0.0 ELSE k.x + k.w + 40 END, CASE WHEN k.x + k.w + 40 + u.w > 1200 THEN k.y + k.tall + 40 ELSE k.y END, CASE WHEN k.x + k.w + 40 + u.w > 1200 THEN u.h ELSE greatest(k.tall, u.h) END FROM walk k JOIN u ON u.g = k.g AND u.i = k.i + 1)
      SELECT g AS "group", unit_id, x, y, w AS width, h AS height FROM walk""",
}
