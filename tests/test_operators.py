import pytest
from pyspark.sql import functions as F

from graphloom.operators import canonical as C
from graphloom.operators import graph as G
from graphloom.operators import hierarchy as H
from graphloom.operators import layout as L
from graphloom.operators import merge as M
from graphloom.operators import pages as P
from graphloom.operators import projection as V
from graphloom.operators import publishing as B
from graphloom.operators import reading as R
from graphloom.operators import rules
from graphloom.operators import session as S


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda t: [(v is None, v) for v in t])


def test_equal_names_become_one_node(spark):
    n = spark.createDataFrame([("t1", "Linear map", "concept", "c1", "", "d", 0.6, ["LM"], ["p#1"], 1), ("t2", " linear  MAP ", "concept", "c1", "", "longer", 0.9, [], ["p#2"], 2), ("t3", " ", "concept", "c1", "", "", 0.5, [], [], 3)], "temporary_id string, display_name string, node_type string, chapter string, section string, definition string, confidence double, aliases array<string>, evidence_refs array<string>, ord int")
    c = C.canonical_nodes(n)
    (got,) = c.collect()
    assert (got.display_name, got.source_ids, got.evidence_refs, got.aliases, got.confidence) == ("linear  MAP", ["t1", "t2"], ["p#1", "p#2"], ["LM"], 0.75)
    assert C.alias_mappings(n, c).count() == 3


def test_claims_resolve_and_self_loops_do_not(spark):
    n = spark.createDataFrame([("t1", "A", "concept", "c", "", "", 0.6, [], [], 1), ("t2", "B", "concept", "c", "", "", 0.9, [], [], 2)], "temporary_id string, display_name string, node_type string, chapter string, section string, definition string, confidence double, aliases array<string>, evidence_refs array<string>, ord int")
    nodes = C.canonical_nodes(n)
    m = C.alias_mappings(n, nodes)
    claims = spark.createDataFrame([("k1", 1, "t1", "", "", "B", "support", 0.5, "explicit", "x", ["r1"], "pending"), ("k2", 2, "t1", "", "", "b", "explains", 0.7, "model_inferred", "y", [], "pending"), ("k3", 3, "t1", "", "t1", "", "explains", 0.7, "explicit", "", ["r"], "pending")], "claim_id string, ord int, source_temporary_id string, source_mention string, target_temporary_id string, target_mention string, relation_type string, confidence double, evidence_type string, evidence_text string, evidence_refs array<string>, review_status string")
    r = C.resolved(claims, m, C.mention_index(nodes, m))
    (one,) = C.consolidated(r).collect()
    assert (one.relation_type, one.confidence, one.evidence_refs, one.evidence_text, one.review_status, one.claim_count) == ("explains", 0.7, ["r1"], "x；y", "needs_expert_review", 2)
    assert r.where(~C.is_resolved()).count() == 1


def test_references_are_sorted_in_all_partitions(spark):
    drafts = spark.createDataFrame([(2, "n2", "Set", "sets"), (1, "n1", "set", "Map")], "ord long, node_id string, node_name string, display_name string").coalesce(1)
    index = C.reference_index(drafts)
    assert {r.reference: r.node_id for r in index.collect()} == {"n1": "n1", "n2": "n2", "set": "n1", "Map": "n1", "map": "n1", "Set": "n2", "sets": "n2"}
    assert "Repartition 4, true" in index._jdf.queryExecution().optimizedPlan().toString()


def test_isolated_nodes_meet_each_named_part_once(spark, sf):
    from graphloom.plans import catalogue

    plan = catalogue.QUERIES["isolated_nodes"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [key#" in plan


def test_same_image_needs_review(spark):
    p = spark.createDataFrame([("b", 1, "p1", "one.", "h", ""), ("b", 2, "p2", "two.", "h", "")], "book string, page_index int, page_id string, text string, image_sha256 string, printed string")
    (r,) = P.continuity(p).collect()
    assert r.needs_model_review and r.suggested_action == "manual_review" and "duplicate_page_image" in r.signals


def test_chapters_of_headed_pages(spark):
    p = spark.createDataFrame([("b", 4, "目录 第一章 集合 7"), ("b", 7, "第一章 集合\n文"), ("b", 34, "第二章：函数")], "book string, page_index int, text string").withColumn("heading", P.chapter_heading(F.col("text")))
    assert rows(P.chapters(p).select("title", "start_page", "end_page")) == [("第一章 集合", 7, 33), ("第二章 函数", 34, 34)]


def test_batches_cut_by_pages_and_size(spark):
    p = spark.createDataFrame([("b", i, c) for i, c in enumerate([1, 1, 1, 1, 1, 11_999, 2, 50_000])], "book string, page_index int, chars int")
    assert [r[1] for r in sorted(P.batches(p).select("page_index", "batch_no").collect())] == [0, 0, 0, 0, 1, 1, 2, 3]
    with pytest.raises(ValueError):
        P.selected_pages(3, [4])
    assert P.selected_pages(3, [2, 1, 2]) == [1, 2]


def test_page_sources(spark):
    b = spark.createDataFrame([([("12", 5.0), ("第 3页", 9.0), ("第3页", 8.0), ("x", 20.0)],)], "blocks array<struct<text string, y double>>")
    assert b.select(P.printed_number(F.col("blocks"))).first()[0] == "第3页"
    t = spark.createDataFrame([("short", "read"), ("a text that is long enough to be used", "read")], "n string, o string")
    assert [r[0].status for r in t.select(P.page_text(F.col("n"), False, F.col("o"), True)).collect()] == ["ocr", "native_text"]


def test_cache_computes_each_key_once(spark):
    pages = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "cache_key string, page int")
    hits, fresh = P.cached(pages, spark.createDataFrame([("a", "old")], "cache_key string, result string"), lambda m: m.select("cache_key", F.lit("new").alias("result")))
    assert fresh.count() == 1 and rows(hits.select("page", "result", "cache_hit")) == [(1, "old", True), (2, "new", False), (3, "new", False)]


def test_forest_faults(spark):
    n = spark.createDataFrame([(x,) for x in "abcdefg"], "node_id string")
    c = spark.createDataFrame([("b", "a"), ("c", "a"), ("c", "b"), ("d", "d"), ("e", "f"), ("f", "e"), ("g", "z")], "child string, parent string")
    parents, issues = H.projected(n, c)
    assert rows(parents) == [("b", "a")]
    assert rows(issues) == [("hierarchy_cycle", "e", "e|f"), ("hierarchy_endpoint_missing", "g", "z"), ("hierarchy_multiple_parents", "c", "a|b"), ("hierarchy_self_parent", "d", "d")]


def test_long_tail_into_a_cycle(spark):
    p = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(100, 98)], "child int, parent int")
    assert rows(H.cycle_members(p)) == [(98, 98), (99, 98), (100, 98)]


def test_closure_of_a_long_chain(spark):
    p = spark.createDataFrame([(i + 1, i) for i in range(20)], "child int, parent int")
    assert H.ancestors(p).count() == 210
    pairs = spark.createDataFrame([(7, 12), (3, 3), (5, 99)], "a int, b int")
    assert rows(H.lowest_common(pairs, p)) == [(3, 3, 3), (5, 99, None), (7, 12, 7)]


def test_graph_ranks(spark):
    n = spark.createDataFrame([(x,) for x in range(8)], "node_id int")
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (5, 4), (6, 6)], "a int, b int")
    assert rows(G.condensed_ranks(n, e)) == [(0, 0, 0), (1, 0, 0), (2, 0, 0), (3, 3, 1), (4, 4, 2), (5, 5, 0), (6, 6, 0), (7, 7, 0)]
    assert rows(G.components(n, e)) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (5, 0), (6, 6), (7, 7)]


def test_chapter_plan(spark):
    n = spark.createDataFrame([("c", x, t, i) for i, (x, t) in enumerate([("a", "concept"), ("b", "rule"), ("d", "method"), ("e", "application"), ("f", "container")])], "chapter string, node_id string, node_type string, ord int")
    e = spark.createDataFrame([("c", "a", "b", "prerequisite"), ("c", "a", "d", "progressive"), ("c", "e", "b", "explains")], "chapter string, source_id string, target_id string, relation_type string")
    got = {r.node_id: (r.place, r.parent) for r in G.chapter_plans(n, e).collect()}
    assert got == {"a": ("path", ""), "b": ("path", ""), "d": ("branch", "a"), "e": ("auxiliary", "b"), "f": ("unassigned", "")}


def test_merge_keeps_local_edits(spark):
    f = lambda *v: spark.createDataFrame([("node", k, "name", x) for k, x in v], "record_type string, object_id string, field_name string, value string")
    base, local, remote = f(("1", "a"), ("2", "a"), ("3", "a"), ("4", "a")), f(("1", "L"), ("2", "a"), ("3", "L"), ("4", "a"), ("5", "x")), f(("1", "a"), ("2", "R"), ("3", "R"), ("5", "y"), ("6", "n"))
    plan = M.plan(base, local, remote)
    assert rows(plan.select("object_id", "outcome")) == [("2", "change"), ("3", "conflict"), ("4", "ignored_delete"), ("5", "new_object_conflict"), ("6", "new_object")]
    assert M.status(plan).first()[0] == "conflicts" and M.status(M.resolved(plan, False)).first()[0] == "ready"
    assert rows(M.applied(local, M.resolved(plan, True)).select("object_id", "value")) == [("1", "L"), ("2", "R"), ("3", "R"), ("4", "a"), ("5", "y"), ("6", "n")]
    spoiled = M.baseline(base, "e", 1).withColumn("field_sha256", F.lit("0"))
    with pytest.raises(Exception, match="baseline"):
        M.checked(spoiled).collect()


def test_commands(spark):
    log = spark.createDataFrame([(1, 1, 10, "a", "x", None, "o"), (1, 2, 11, "a", "y", 5, "o"), (1, 3, 12, "a", "z", 1, "o")], "document_id long, at long, command_id long, action string, value string, expected_revision long, object_id string")
    assert rows(S.stale(log).select("command_id", "revision_before", "is_stale")) == [(10, 0, False), (11, 1, True), (12, 1, False)]
    assert S.as_of(log, 2).first().value == "y"
    n, r = S.deleted(spark.createDataFrame([("a", "", ["b"]), ("b", "", []), ("c", "b", ["b", "a"])], "node_id string, parent_id string, prerequisites array<string>"), spark.createDataFrame([("a", "b"), ("a", "c")], "source_id string, target_id string"), spark.createDataFrame([("b",)], "node_id string"))
    assert {x.node_id: (x.parent_id, x.prerequisites) for x in n.collect()} == {"a": ("", []), "c": ("", ["a"])} and r.count() == 1


def test_catalogue_acceptance(spark):
    nodes = spark.createDataFrame([("c1", "", "container", "pending"), ("s1", "c1", "container", "pending"), ("k1", "s1", "concept", "pending"), ("s2", "c1", "container", "pending")], "node_id string, parent_id string, node_type string, review_status string")
    parents = spark.createDataFrame([("s1", "c1"), ("k1", "s1"), ("s2", "c1")], "child string, parent string")
    tree = H.layers(nodes.select("node_id", (F.col("node_type") == "container").alias("is_container")), parents)
    relations = spark.createDataFrame([("r1", "c1", "s1", "contains", "pending"), ("r2", "c1", "s2", "contains", "pending"), ("r3", "s1", "k1", "contains", "pending"), ("r4", "k1", "s1", "explains", "pending")], "relation_id string, source_id string, target_id string, relation_type string, review_status string")
    n, r = S.accepted_structure(nodes, relations, tree, spark.createDataFrame([("s2",)], "node_id string"))
    assert rows(n.where("review_status = 'accepted'").select("node_id")) == [("c1",), ("s1",)]
    assert rows(r.where("review_status = 'accepted'").select("relation_id")) == [("r1",)]


def test_publish_needs_a_choice(spark):
    state = "active", "accepted"
    doc = {
        "nodes": spark.createDataFrame([("c", *state), ("k", *state), ("b", "active", "pending")], "node_id string, lifecycle_state string, review_status string"),
        "scopes": spark.createDataFrame([("c", "active"), ("b", "active")], "scope_id string, lifecycle_state string"),
        "relations": spark.createDataFrame([("m", "membership", "c", "k", "contains", *state, 1), ("s", "structure", "b", "c", "contains", *state, 2), ("s2", "structure", "c", "b", "contains", *state, 3)], "relation_id string, relation_family string, source_id string, target_id string, relation_type string, lifecycle_state string, review_status string, ord int"),
        "occurrences": spark.createDataFrame([("o",)], "occurrence_id string"),
    }
    choices = "node_id string, relation_id string"
    can = B.Capability(("explains",))
    found = B.preflight(doc, B.Profile(spark.createDataFrame([], choices)), can)
    assert rows(found.issues.select("code", "object_id")) == [("primary_membership_confirmation_required", "k")]
    assert B.gate(found.issues).first()[0] == "needs_decision"
    mine = B.Profile(spark.createDataFrame([("k", "m")], choices))
    blocked = B.preflight(doc, mine, can)
    assert rows(blocked.issues.select("code", "object_id")) == [("required_scope_not_accepted", "b")] and rows(blocked.ancestors) == [("b",), ("c",)]
    doc["relations"] = doc["relations"].where("relation_id = 'm'")
    done = B.preflight(doc, mine, can)
    assert B.gate(done.issues).first()[0] == "ready" and rows(done.nodes) == [("k",)]
    assert {r.name: r.n for r in done.counts.collect()} == {"nodes_not_accepted": 1, "relations_not_accepted": 0, "selected_knowledge_nodes": 1, "selected_semantic_relations": 0, "secondary_memberships_omitted": 0, "occurrences_omitted": 1}
    now = spark.createDataFrame([("doc", 3, "fp")], "document_id string, revision int, business_fingerprint string")
    one, two = B.plan_identity(done, now, mine, can), B.plan_identity(done, now.withColumn("revision", F.lit(4)), mine, B.Capability(("explains",), version="2"))
    assert B.stale_parts(one, one).isEmpty() and rows(B.stale_parts(one, two)) == [("capability_version",), ("revision",)]
    assert one.first()[0].startswith("plan_") and one.first()[0] != two.first()[0]
    asked = B.Profile(spark.createDataFrame([("k", "m")], choices), spark.createDataFrame([("k",), ("b",), ("zz",)], "node_id string"), spark.createDataFrame([("m",), ("no",)], "relation_id string"), protocol="p9")
    got = B.preflight(doc, asked, can).issues
    assert rows(got.select("code", "object_id")) == [("selected_node_missing", "zz"), ("selected_node_not_accepted", "b"), ("selected_relation_missing", "no"), ("target_protocol_unsupported", "p9")]


def test_projection_ends(spark):
    cards = spark.createDataFrame([("v1", "a", "s1"), ("v2", "a", "s2"), ("v3", "b", "s2"), ("v4", "d", "s9")], "view_id string, node_id string, scope_id string")
    r = spark.createDataFrame([("r1", "a", "b"), ("r2", "a", "d")], "relation_id string, source_id string, target_id string")
    assert rows(V.selected_ends(r, cards)) == [("r1", "v2", "v3"), ("r2", "v1", "v4")]


def test_layout(spark):
    b = spark.createDataFrame([("g", "a", 0.0, 0.0, 10.0, 10.0), ("g", "b", 9.5, 0.0, 10.0, 10.0), ("g", "c", 5.0, 5.0, 1000.0, 10.0), ("h", "d", 0.0, 0.0, 10.0, 10.0)], "`group` string, node_id string, x double, y double, width double, height double")
    assert rows(L.overlaps(b)) == [("g", "a", "c"), ("g", "b", "c")]
    assert L.fits_budget(100, 100, 100, 100) and not L.fits_budget(300, 100, 200, 90) and L.fits_budget(300, 270, 10, 9)
    p = L.ports(spark.createDataFrame([("c", "l", "e1", 5), ("c", "l", "e2", 1)], "card string, side string, edge_id string, opposite int"))
    assert rows(p.select("edge_id", "fraction")) == [("e1", 2 / 3), ("e2", 1 / 3)]
    assert L.close_ports(p, 30.0).count() == 1


def test_overlaps_are_found_once_in_many_tasks(spark, sf):
    box = [("g", f"n{i % 35:02}", i * 37 % 300 - 150.0, i * 53 % 200 - 90.0, float(i * 13 % 90), float(i * 29 % 70)) for i in range(40)]
    b = spark.createDataFrame(box, "`group` string, node_id string, x double, y double, width double, height double")
    apart = lambda p, q, at: p[at] + 1 >= q[at] + q[at + 2] or q[at] + 1 >= p[at] + p[at + 2]
    want = sorted({("g", p[1], q[1]) for p in box for q in box if p[1] < q[1] and not apart(p, q, 2) and not apart(p, q, 3)})
    assert want and rows(L.overlaps(b, 16.0)) == want == rows(L.overlaps(b))
    from graphloom.plans import catalogue

    assert "Broadcast" not in catalogue.QUERIES["geometry_overlap"](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_reading_order_comes_from_the_text(spark):
    anchors = spark.createDataFrame([("p", "a1", "2. Ｓｕｂｔｒａｃｔ it\n① Divide first\n第三步 Other")], "parent_id string, anchor_id string, text string")
    kids = spark.createDataFrame([("p", "k1", "subtract"), ("p", "k2", "Divide"), ("p", "k3", "missing"), ("q", "k4", "only child")], "parent_id string, child_id string, name string")
    assert rows(R.reading_sequences(kids, anchors)) == [("p", "k1", 2, "evidence_backed"), ("p", "k2", 1, "evidence_backed"), ("p", "k3", None, "unavailable")]
    assert [R.ordinal(x) for x in ("12", "③", "十", "二十一", "第四", "x")] == [12, 3, 10, 21, 4, 0]


def test_places_inside_ranks(spark):
    ranks = spark.createDataFrame([("g", "a", 0, 0), ("g", "b", 0, 1), ("g", "c", 1, 2), ("g", "d", 1, 3), ("g", "e", 1, 4), ("g", "f", 2, 5)], "`group` string, node_id string, rank int, ord int")
    edges = spark.createDataFrame([("g", "b", "c"), ("g", "a", "d"), ("g", "d", "f")], "`group` string, a string, b string")
    assert rows(G.ordered_ranks(ranks, edges).where("rank = 1").select("node_id", "place")) == [("c", 1), ("d", 0), ("e", 2)]
    loose = ranks.withColumn("linked", F.col("node_id") != "e")
    assert rows(G.spread_isolated(loose).where("node_id = 'e'").select("rank")) == [(2,)]


def test_edge_classes(spark):
    e = spark.createDataFrame([("e1", "semantic", "prerequisite", "a", "b"), ("e2", "semantic", "derives_to", "b", "a"), ("e3", "semantic", "contrast", "a", "b"), ("e4", "semantic", "parallel", "a", "c"), ("e5", "semantic", "explains", "a", "c"), ("e6", "semantic", "explains", "c", "d"), ("e7", "unresolved", "contains", "a", "d"), ("e8", "semantic", "explains", "a", "x"), ("e9", "semantic", "explains", "d", "x2")], "edge_id string, relation_family string, relation_type string, source_id string, target_id string")
    scopes = spark.createDataFrame([("a", "s1"), ("b", "s1"), ("c", "s1"), ("d", "s2"), ("x", "s9"), ("x2", "s2")], "node_id string, scope_id string")
    parents = spark.createDataFrame([("s1", "top"), ("s2", "top")], "child string, parent string")
    got = {r.edge_id: r["class"] for r in L.edge_classes(e, scopes, parents).collect()}
    assert got == {"e1": "semantic_cycle", "e2": "semantic_cycle", "e3": "symmetry_conflict", "e4": "symmetry_conflict", "e5": "rank_enforced", "e6": "cross_scope", "e7": "unresolved_semantics", "e8": "order_conflict", "e9": "rank_enforced"}
    assert [r.view_id for r in L.route_order(spark.createDataFrame([("g", "v1", "derives_to", "semantic"), ("g", "v2", "contains", "unresolved"), ("g", "v3", "contains", "semantic"), ("g", "v4", "what", "semantic")], "`group` string, view_id string, relation_type string, relation_family string")).orderBy("place").collect()] == ["v3", "v2", "v4", "v1"]


def test_geometry_rules(spark):
    box = "`group` string, node_id string, x double, y double, width double, height double"
    b = spark.createDataFrame([("g", "p", 0.0, 0.0, 100.0, 100.0), ("g", "k", 10.0, 10.0, 20.0, 20.0), ("g", "out", 90.0, 90.0, 20.0, 20.0)], box)
    kids = spark.createDataFrame([("k", "p"), ("out", "p"), ("lost", "p")], "child string, parent string")
    assert rows(L.nesting_issues(kids, b)) == [("geometry_child_out_of_bounds", "out"), ("layout_coordinate_missing", "lost")]
    edges = spark.createDataFrame([("e1", "k", "out"), ("e2", "k", "lost"), ("e3", "p", "k")], "edge_id string, source_id string, target_id string")
    assert rows(L.route_issues(edges, b, spark.createDataFrame([("e1", "routed"), ("e3", "failed")], "edge_id string, status string"))) == [("edge_route_failed", "e3"), ("edge_route_missing_endpoint", "e2")]
    arrows = spark.createDataFrame([("g", "e1", 25.0, 25.0, 4.0, 4.0), ("g", "e2", 300.0, 0.0, 4.0, 4.0)], "`group` string, edge_id string, x double, y double, width double, height double")
    assert rows(L.arrow_occlusions(arrows, b)) == [("e1", "k"), ("e1", "p")]


def test_completion_groups(spark):
    from graphloom.operators import completion as K

    n = spark.createDataFrame([("n1", "One", ["p1#b"], 1), ("n2", "One", [], 2), ("n3", "Two", [], 3), ("n4", "Two", [], 4), ("n5", "Three", [], 5)], "node_id string, chapter string, evidence_refs array<string>, ord int")
    pages = spark.createDataFrame([("p1", 1), ("p2", 2), ("p3", 3)], "page_id string, page_index int")
    titles = spark.createDataFrame([("Chapter Two", 2, 3, 0)], "title string, start_page int, end_page int, ord int")
    members, found = K.completion_groups(n, pages, titles)
    assert rows(members.select("chapter_key", "node_id")) == [("one", "n1"), ("one", "n2"), ("two", "n3"), ("two", "n4")]
    assert rows(found.select("chapter_key", "page_id", "place")) == [("one", "p1", 0), ("two", "p2", 0), ("two", "p3", 1)]
    alone = K.completion_groups(n.where("chapter = 'Two'"), pages, titles.where("ord > 0"))[1]
    assert alone.count() == 3
    p = spark.createDataFrame([("p1", 1, "1", "ok", False, "text", [("b", "said", 0.5, [0.0])]), ("p2", 2, "2", "ok", False, "text", [])], "page_id string, page_index int, printed_page_number string, ocr_status string, requires_visual_review boolean, source_text string, blocks array<struct<block_id:string,text:string,confidence:double,bbox:array<double>>>")
    got = {r.page_id: r.payload for r in K.page_payloads(p).collect()}
    assert '"text":"","blocks":[{"evidence_ref":"p1#b","text":"said"' in got["p1"] and '"text":"text","blocks":[]' in got["p2"]


def test_documents_take_each_others_place(spark):
    d = spark.createDataFrame([("node", "a", "name", "x")], "record_type string, object_id string, field_name string, value string")
    assert S.replaced(d, d, 3, 3)[1] == 3 and S.replaced(d, d.withColumn("value", F.lit("y")), 3, 3)[1] == 4
    with pytest.raises(ValueError, match="revision"):
        S.replaced(d, d, 3, 2)
    change = spark.createDataFrame([("node", "a", "name", "x", "x", "z", "change")], "record_type string, object_id string, field_name string, base string, local string, remote string, outcome string")
    values, revision = M.revised(d, change, 3, 3)
    assert revision == 4 and values.first().value == "z"
    with pytest.raises(ValueError, match="conflicts"):
        M.revised(d, change.withColumn("outcome", F.lit("conflict")), 3, 3)
    names = spark.createDataFrame([("c", "Sub"), ("p", "Top")], "node_id string, display_name string")
    assert rows(H.written_back(names, spark.createDataFrame([("c", "p")], "child string, parent string"))) == [("c", "Sub", "p", "Top"), ("p", "Top", "", "")]


def test_small_edits(spark):
    p = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "profile_id string, based_on_revision int, target string")
    change = spark.createDataFrame([("a", 4, "z", 1), ("a", 5, "w", 2), ("c", 5, "n", 3)], "profile_id string, based_on_revision int, target string, `order` int")
    assert rows(S.profiles_upserted(p, change)) == [("a", 5, "w"), ("b", 1, "y"), ("c", 5, "n")]
    r = spark.createDataFrame([("r1", "old"), ("r2", "keep"), ("r3", "gone")], "relation_id string, text string")
    assert rows(S.relations_edited(r, spark.createDataFrame([("r1", "new"), ("r4", "more")], r.schema), r.where("relation_id = 'r3'"))) == [("r1", "new"), ("r2", "keep"), ("r4", "more")]
    n = spark.createDataFrame([("t1", "c", "s", 2), ("t2", "c", "s", 1), ("t1", "c", "s", 3)], "temporary_id string, chapter string, section string, ord int")
    o = spark.createDataFrame([("t1", "n"), ("t2", "n")], "temporary_id string, node_id string")
    assert rows(C.occurrence_rows(n, o).select("temporary_id", "place")) == [("t1", 1), ("t2", 0)]
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("d", "e"), ("e", "f"), ("f", "d")], "a string, b string")
    assert rows(rules.first_cycles(rules.learning_cycles(e), 1)) == [("a", 2)] and rows(rules.learning_cycles(e)) == [("a", 2), ("d", 3)]
