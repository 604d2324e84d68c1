"""Queries without SQL against brute force, and graphs beyond any fixed number of rounds."""

import pytest

from graphloom.operators import graph as G
from graphloom.operators import hierarchy as H
from graphloom.plans import catalogue
from graphloom.sources import adapters as A
from graphloom.sources import readers

def backbone(spark, sf):
    kinds = {"AF", "AO", "NF"}  # prerequisite, progressive, derives_to
    names = {v: k for k, v in A.RAW_RELATIONS.items()}
    return {(r.source_key, r.target_key) for r in A.local_claims(spark, sf).collect() if names.get(r.relation_type) in kinds and r.source_key != r.target_key}


def reached(start, out):
    seen, todo = {start}, [start]
    while todo:
        for y in out.get(todo.pop(), ()):
            if y not in seen:
                seen.add(y)
                todo.append(y)
    return seen


def test_strong_components_and_groups_of_all_relations(spark, sf):
    out, back = {}, {}
    for a, b in backbone(spark, sf):
        out.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)
    nodes = [r.p_partkey for r in A.table(spark, sf, "part").collect()]
    want = {x: min(reached(x, out) & reached(x, back)) for x in nodes}
    assert {r.node_id: r.scc for r in catalogue.QUERIES["scc_ranks"](spark, sf).collect()} == want
    both = {x: out.get(x, []) + back.get(x, []) for x in nodes}
    groups = {frozenset(reached(x, both)) for x in nodes if both[x]}
    got = catalogue.QUERIES["relation_groups"](spark, sf).collect()
    assert sorted(r.members for r in got if not r.is_isolated) == sorted(map(len, groups))
    assert sum(r.members for r in got) == len(nodes)


def test_long_chain_into_a_cycle(spark):
    n = spark.createDataFrame([(x,) for x in range(103)], "node_id int")
    e = spark.createDataFrame([(x, x + 1) for x in range(102)] + [(102, 100)], "a int, b int")
    assert {r.node_id: r.scc for r in G.strong_components(n, e).collect()} == {x: min(x, 100) for x in range(103)}


def test_closure_of_a_deep_chain(spark):
    p = spark.createDataFrame([(i + 1, i) for i in range(200)], "child int, parent int")
    assert sorted(map(tuple, H.ancestors(p).collect())) == sorted((i, j, i - j) for i in range(201) for j in range(i))
    with pytest.raises(ValueError, match="cycle"):
        H.ancestors(spark.createDataFrame([(1, 2), (2, 1)], "child int, parent int"))


def test_no_range_is_lost(spark):
    pdfs = spark.createDataFrame([("x.pdf", 20_000, "")], "path string, page_count int, text string")
    ranges = spark.range(1, 10_101).selectExpr("cast(id as int) as first", "cast(id as int) as last", "'' as label")
    assert readers.page_ranges(pdfs, ranges).count() == 10_100


def plain_plans(nodes, edges):
    """Places of all nodes: the path follows the heaviest edge to a node that isn't on it yet."""
    from graphloom.functions import vocab

    out = {}
    for chapter in {n["chapter"] for n in nodes}:
        here = sorted((n for n in nodes if n["chapter"] == chapter), key=lambda n: n["ord"])
        index = {n["node_id"]: i for i, n in enumerate(here)}
        kind = {n["node_id"]: n["node_type"] for n in here}
        own = [e for e in edges if e["chapter"] == chapter]
        main = [x for x in index if kind[x] in vocab.MAIN_TYPES]
        strong = [e for e in own if e["relation_type"] in vocab.BACKBONE and {e["source_id"], e["target_id"]} <= set(main)]
        weight = lambda e: vocab.BACKBONE_WEIGHTS[e["relation_type"]]
        score = {x: vocab.NODE_WEIGHTS[kind[x]] + sum(weight(e) for e in strong for end in ("source_id", "target_id") if e[end] == x) for x in main}
        entering = {x: sum(e["target_id"] == x for e in strong) for x in main}
        path = [min(main, key=lambda x: (entering[x], -score[x], index[x]))] if main else []
        while path:
            ahead = [e for e in strong if e["source_id"] == path[-1] and e["target_id"] not in path]
            if not ahead:
                break
            path.append(min(ahead, key=lambda e: (-weight(e), -score[e["target_id"]], entering[e["target_id"]], index[e["target_id"]]))["target_id"])
        out |= {(chapter, x): ("path", "", i) for i, x in enumerate(path)}
        rest = [x for x in main if x not in path]
        for x in rest:
            near = [e["source_id"] for e in strong if e["target_id"] == x and e["source_id"] in path] or [e["target_id"] for e in strong if e["source_id"] == x and e["target_id"] in path]
            out[chapter, x] = ("branch", min(near, key=path.index) if near else min(path, key=index.get), index[x])
        for x in index:
            if (chapter, x) in out:
                continue
            far = lambda y: abs(index[y] - index[x])  # noqa: E731, B023
            if kind[x] in vocab.AUXILIARY_TYPES and main:
                near = {b for e in own if e["relation_type"] != "contains" for a, b in ((e["source_id"], e["target_id"]), (e["target_id"], e["source_id"])) if a == x and b in path + rest}
                out[chapter, x] = ("auxiliary", min(near, key=lambda y: (far(y), index[y])) if near else min(path + rest, key=far), index[x])
            else:
                out[chapter, x] = ("unassigned", "", index[x])
    return out


def test_chapter_plans(spark, sf):
    from graphloom.plans import graph_queries as Q

    nodes, edges = Q._chapters(spark, sf)
    want = plain_plans([r.asDict() for r in nodes.collect()], [r.asDict() for r in edges.collect()])
    got = {(r.chapter, r.node_id): (r.place, r.parent, r.position) for r in catalogue.QUERIES["main_path"](spark, sf).collect()}
    assert got == want and len({v[0] for v in want.values()}) >= 3
