"""Queries over scenes: cards, their places, and the routes and labels of relations between them.

A conversation is a scene: its turns are cards; a turn leads to the next one, answers what opened
the conversation, and stands beside the turn before the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import manual as M
from ..operators import placement as P
from ..operators import routing as R
from ..operators import scans
from ..sources import adapters as A
from ..storage import stored


def conversation_scenes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(cards (group, node_id), edges (group, edge_id, source_id, target_id, relation_type, relation_family, place)) of all conversations."""
    turns = scans.running(A.table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("group"), "turn", "role", F.length("text").alias("size")), ["group"], ["turn"])
    turns = stored(turns.withColumn("node_id", F.lpad(F.col("idx").cast("string"), 6, "0")), "turns")
    at = turns.select("group", F.col("idx").alias("at"), F.col("node_id").alias("target_id"))
    kind = lambda name, family, to: F.struct(F.lit(name).alias("relation_type"), family.alias("relation_family"), to.cast("long").alias("at"))
    family = F.when(F.col("size") % 5 == 0, "unresolved").otherwise("semantic")
    kinds = F.array(kind("progressive", family, F.col("idx") + 1), kind("derives_to", F.lit("semantic"), F.when((F.col("role") == "assistant") & (F.col("idx") > 2), 1)), kind("parallel", F.lit("semantic"), F.col("idx") - 2))
    edges = turns.select("group", F.col("node_id").alias("source_id"), "idx", F.explode(kinds).alias("k")).select("group", "source_id", "idx", "k.*").join(at, ["group", "at"])
    edges = edges.select("group", F.concat_ws("#", "group", "source_id", "target_id", "relation_type").alias("edge_id"), "source_id", "target_id", "relation_type", "relation_family", F.col("idx").cast("int").alias("place"))
    return turns.select("group", "node_id"), stored(edges, "relations")


def _laid_out(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cards, edges = conversation_scenes(spark, d)
    return stored(P.component_layout(cards, edges), "scenes"), edges


def scene_layout(spark: SparkSession, d: str) -> DataFrame:
    return _laid_out(spark, d)[0].drop("component")


def edge_routes(spark: SparkSession, d: str) -> DataFrame:
    """Routes of all relations of all scenes, and where their labels stand."""
    cards, edges = _laid_out(spark, d)
    found = stored(R.orthogonal_routes(cards, edges), "routes")
    important = edges.select("group", "edge_id", "place", (F.col("relation_family") == "unresolved").alias("important"))
    labels = P.label_places(found.join(important, ["group", "edge_id"]), cards).select("group", "edge_id", F.col("x").alias("label_x"), F.col("y").alias("label_y"), "visible", "reason")
    path = F.array_join(F.transform("points", lambda p: F.concat_ws(",", p["x"].cast("decimal(18,1)"), p["y"].cast("decimal(18,1)"))), " ")
    routes = found.select("group", "edge_id", "status", F.round("cost", 6).alias("cost"), F.coalesce(path, F.lit("")).alias("path"))
    return routes.join(labels, ["group", "edge_id"])


def nested_frames(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations and market segments as nested frames around the cards of suppliers and customers."""
    n, s, c = (A.table(spark, d, t) for t in ("nation", "supplier", "customer"))
    ident = lambda p, *k: F.concat(F.lit(p), F.concat_ws(":", *(F.col(x).cast("string") for x in k)))
    scope = lambda df, me, parent, order: df.select(me.alias("scope_id"), parent.alias("parent_id"), order.cast("long").alias("ord")).distinct()
    scopes = (
        scope(A.table(spark, d, "region"), ident("r", "r_regionkey"), F.lit(""), F.col("r_regionkey")).unionByName(scope(n, ident("n", "n_nationkey"), ident("r", "n_regionkey"), F.col("n_nationkey")))
        .unionByName(scope(c, ident("m", "c_nationkey", "c_mktsegment"), ident("n", "c_nationkey"), F.lit(0)))
    )
    nodes = s.select(ident("n", "s_nationkey").alias("group"), ident("s", "s_suppkey").alias("node_id")).unionByName(c.select(ident("m", "c_nationkey", "c_mktsegment").alias("group"), ident("c", "c_custkey").alias("node_id")))
    none = nodes.limit(0).select("group", F.col("node_id").alias("source_id"), F.col("node_id").alias("target_id"), F.lit("").alias("relation_type"), F.lit("").alias("relation_family"))
    frames, cards, issues = P.nested_layout(scopes, nodes, none)
    box = lambda df, kind, me: df.select(F.lit(kind).alias("kind"), F.col(me).alias("object_id"), *(F.round(v, 6).alias(v) for v in ("x", "y", "width", "height")))
    told = issues.select(F.col("code").alias("kind"), "object_id", *(F.lit(None).cast("double").alias(v) for v in ("x", "y", "width", "height")))
    return box(frames, "frame", "scope_id").unionByName(box(cards, "card", "node_id")).unionByName(told)


def reading_columns(spark: SparkSession, d: str) -> DataFrame:
    """Cards of conversations with the answers in a column beside what opened them."""
    turns = scans.running(A.table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("group"), "turn", "role"), ["group"], ["turn"])
    turns = stored(turns.withColumn("node_id", F.lpad(F.col("idx").cast("string"), 6, "0")), "turns")
    items = turns.where("role = 'assistant' and idx > 1").select("group", F.lit("answers").alias("sequence_id"), F.lpad(F.lit("1"), 6, "0").alias("parent_id"), "node_id", F.col("idx").alias("ordinal"))
    return P.reading_places(_laid_out(spark, d)[0], items)


def manual_positions(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer as cards in rows of four, of which a reviewer moves every third."""
    orders = scans.running(A.table(spark, d, "orders").select(F.col("o_custkey").alias("group"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("node_id"), "o_orderkey", "o_totalprice"), ["group"], ["node_id"])
    at = F.col("idx") - 1
    box = (F.lit(200.0).alias("width"), F.lit(80.0).alias("height"))
    rows = stored(orders.select("group", "node_id", "o_orderkey", (at % 4 * 240).cast("double").alias("x"), (F.floor(at / 4) * 120).cast("double").alias("y"), *box, F.floor("o_totalprice").cast("long").alias("p"), "n"), "cards")
    cards = rows.select("group", "node_id", "x", "y", "width", "height")
    wish = rows.where("o_orderkey % 3 = 0").select("group", "node_id", F.when(F.col("o_orderkey") % 7 != 0, F.col("p") % 900).alias("x"), (F.col("p") * 7 % (F.ceil(F.col("n") / 4) * 120 + 200)).alias("y"))
    frames = rows.groupBy("group").agg(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(960.0).alias("width"), (F.ceil(F.max("n") / 4) * 120 + 160).cast("double").alias("height"))
    placed, issues = M.manual_places(cards, wish, frames)
    return placed.join(issues.withColumnRenamed("object_id", "node_id"), ["group", "node_id"], "left").select(F.col("group").alias("scene_id"), "node_id", "x", "y", "code")


QUERIES = {f.__name__: f for f in (scene_layout, edge_routes, nested_frames, reading_columns, manual_positions)}

ORACLE_SQL: dict[str, str] = {
    "manual_positions": """WITH RECURSIVE o AS (SELECT o_custkey AS g, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS id, o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS p,
        row_number() OVER (PARTITION BY o_custkey ORDER BY lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
      c AS (SELECT g, id, CAST(i % 4 * 240 AS DOUBLE) AS x, CAST(i // 4 * 120 AS DOUBLE) AS y, (n + 3) // 4 * 120 AS h, k, p FROM o),
      w AS (SELECT g, id, row_number() OVER (PARTITION BY g ORDER BY id) AS r, CASE WHEN k % 7 <> 0 THEN CAST(p % 900 AS DOUBLE) END AS x, CAST(p * 7 % (h + 200) AS DOUBLE) AS y, h FROM c WHERE k % 3 = 0),
      walk AS (SELECT g, CAST(0 AS BIGINT) AS r, list({'id': id, 'x': x, 'y': y} ORDER BY id) AS now, CAST(NULL AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS code FROM c GROUP BY g
        UNION ALL SELECT g, r, CASE WHEN code = '' THEN list_transform(now, lambda b: CASE WHEN b.id = s.id THEN {'id': s.id, 'x': s.x, 'y': s.y} ELSE b END) ELSE now END, id, code FROM (
          SELECT a.g, w.r, a.now, w.id, w.x, w.y, CASE WHEN w.x IS NULL THEN 'manual_position_invalid' WHEN w.x < -1 OR w.y < -1 OR w.x + 200 > 961 OR w.y + 80 > w.h + 161 THEN 'manual_position_out_of_scope'
            WHEN len(list_filter(a.now, lambda b: b.id <> w.id AND w.x + 1 < b.x + 200 AND b.x + 1 < w.x + 200 AND w.y + 1 < b.y + 80 AND b.y + 1 < w.y + 80)) > 0 THEN 'manual_position_overlap' ELSE '' END AS code
          FROM walk a JOIN w ON w.g = a.g AND w.r = a.r + 1) s),
      e AS (SELECT g, unnest(arg_max(now, r)) AS b FROM walk GROUP BY g)
      SELECT e.g AS scene_id, e.b.id AS node_id, e.b.x AS x, e.b.y AS y, nullif(k.code, '') AS code FROM e LEFT JOIN walk k ON k.g = e.g AND k.id = e.b.id""",
}
