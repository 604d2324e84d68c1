from pyspark.sql import functions as F

from graphloom.operators import migration as M
from graphloom.operators import scene as S


def test_drafts_to_document_and_back(spark):
    nodes = spark.createDataFrame([("c1", "1 Sets", "ch1", "", "container", 0), ("s1", "1.2 Maps", "ch1", "", "container", 1), ("k1", "Sum", "ch1", "1.2 Maps", "concept", 2), ("k2", "Set", "ch1", "9.9 none", "concept", 3)], "node_id string, display_name string, chapter string, section string, node_type string, ord int")
    relations = spark.createDataFrame([("r1", "structure", "c1", "s1", "contains", "accepted"), ("r2", "membership", "c1", "k1", "contains", "accepted"), ("r3", "membership", "s1", "k1", "contains", "accepted"), ("r4", "semantic", "k2", "k1", "prerequisite", "pending")], "relation_id string, relation_family string, source_id string, target_id string, relation_type string, review_status string")
    scopes = M.scopes(nodes, relations)
    assert sorted((r.scope_id, r.structural_role, r.structural_number) for r in scopes.collect()) == [("c1", "chapter", "1"), ("s1", "section", "1.2")]
    evidence = spark.createDataFrame([("a1", ["k1"]), ("a0", ["k1", "k2"])], "anchor_id string, target_ids array<string>")
    occ = M.occurrences(nodes, spark.createDataFrame([], "node_id string, chapter_hint string, section_hint string"), evidence)
    assert {r.node_id: r.anchor_ids for r in occ.collect()} == {"k1": ["a0", "a1"], "k2": ["a0"]}
    got = M.recovered_memberships(occ, scopes, spark.createDataFrame([("k1", "c1")], "node_id string, scope_id string"))
    assert sorted((r.node_id, r.scope_id, r.is_new) for r in got.collect()) == [("k1", "c1", False), ("k1", "s1", True)]
    old = {r.node_id: r for r in M.legacy_drafts(nodes, relations, occ, spark.createDataFrame([("k1", "r3")], "node_id string, relation_id string")).collect()}
    assert (old["k1"].parent_id, old["k1"].prerequisites, old["k1"].section) == ("s1", ["k2"], "1.2 Maps") and old["k2"].relations[0].relation_id == "r4"


def test_advice(spark):
    plans = spark.createDataFrame([("c", "a", "path", "", 0), ("c", "b", "branch", "a", 1), ("d", "x", "path", "", 0)], "chapter string, node_id string, place string, parent string, position long")
    advice = spark.createDataFrame([("c", "b", "path", "", 0), ("c", "zz", "path", "", 1), ("c", "b", "branch", "a", 2)], "chapter string, node_id string, place string, parent string, position long")
    assert sorted((r.chapter, r.node_id, r.place) for r in M.advised(plans, advice).collect()) == [("c", "a", "unassigned"), ("c", "b", "path"), ("d", "x", "path")]
    s = {r.chapter: r for r in M.plan_summary(plans, spark.createDataFrame([("c", 1, 1)], "chapter string, backbone int, clusters int")).collect()}
    assert (s["c"].mode, s["c"].confidence, s["d"].mode) == ("main_path_with_branches", 0.96, "single_path")
    w = M.advice_wanted(s["c"] and spark.createDataFrame([("single_path", 0.9, 0, 1, 0), ("single_path", 0.5, 0, 1, 0)], "mode string, confidence double, branches int, complexity int, unassigned int"))
    assert [r.wants_advice for r in w.collect()] == [False, True]


def test_readability(spark):
    box = "`group` string, node_id string, x double, y double, width double, height double"
    cards = spark.createDataFrame([("g", "a", 0.0, 0.0, 50.0, 50.0), ("g", "b", 200.0, 0.0, 50.0, 50.0), ("g", "m", 100.0, 10.0, 20.0, 20.0)], box).withColumn("frame_id", F.lit("f"))
    p = lambda *v: [{"x": float(x), "y": float(y)} for x, y in v]
    routes = spark.createDataFrame([("g", "e1", "a", "b", "routed", p((50, 20), (200, 20))), ("g", "e2", "a", "b", "routed", p((50, 40), (150, 40), (150, -30), (220, -30), (220, 0))), ("g", "e3", "a", "b", "failed", p((0, 0), (10, 10)))], "`group` string, edge_id string, source_id string, target_id string, status string, points array<struct<x:double,y:double>>")
    none = spark.createDataFrame([], box)
    frames = spark.createDataFrame([("g", "f", -10.0, -10.0, 200.0, 100.0)], box)
    ports = spark.createDataFrame([("a", "r", "e1", 0.5), ("a", "r", "e2", 0.55)], "card string, side string, edge_id string, fraction double")
    got = {(r.code, r.object_id) for r in S.readability(cards, routes, none, ports, frames).collect()}
    assert {("failed_edges", "e3"), ("edge_node_intrusion", "e1"), ("edge_crossing", "e1|e2"), ("group_overflow", "f"), ("port_spacing_violation", "a|r|e2"), ("terminal_direction_violation", "e3")} <= got
    assert ("node_overlap", "a|b") not in got and ("edge_node_intrusion", "e2") not in got
