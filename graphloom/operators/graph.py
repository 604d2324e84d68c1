"""Graphs of any size by DataFrame rounds: components, strong components, ranks; and plans of chapters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vocab
from ..storage import measured, stored
from . import scans


def linked(edges: DataFrame) -> DataFrame:
    """(v, label): the smallest vertex reachable from each vertex of edges (a, b), whatever their direction.

    Each round hooks every vertex to its smallest neighbour, shortens the chains by doubling, and
    contracts the edges; a few rounds suffice, as at least half of the vertices with edges go.
    """
    labels = None
    rest, seen = measured(edges.select("a", "b").where("a <> b").distinct(), "edges", n=F.count(F.lit(1)))
    while seen["n"]:
        both = rest.select(F.col("a").alias("v"), F.col("b").alias("u")).union(rest.select("b", "a"))
        up = stored(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("label")), "hooks")
        while True:
            step = lambda df, to: df.select(F.col("v").alias("label"), F.col("label").alias(to))
            two = up.join(step(up, "two"), "label").select("v", F.col("two").alias("label"))
            four = two.join(step(two, "four"), "label").select("v", F.col("four").alias("label"), (F.col("four") != F.col("label")).alias("moved"))
            up, moved = measured(four, "chains", n=F.count_if("moved"))
            up = up.select("v", "label")
            if not moved["n"]:
                break
        over = up.select(F.col("v").alias("label"), F.col("label").alias("top"))
        labels = up if labels is None else stored(labels.join(over, "label", "left").select("v", F.coalesce("top", "label").alias("label")), "labels")
        a, b = up.select(F.col("v").alias("a"), F.col("label").alias("la")), up.select(F.col("v").alias("b"), F.col("label").alias("lb"))
        rest, seen = measured(rest.join(a, "a").join(b, "b").where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "edges", n=F.count(F.lit(1)))
    return labels if labels is not None else rest.select(F.col("a").alias("v"), F.col("b").alias("label"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, component): the smallest node reachable over edges (a, b), whatever their direction."""
    found = linked(edges).select(F.col("v").alias("node_id"), F.col("label").alias("component"))
    return nodes.select("node_id").distinct().join(found, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, scc): the smallest member of each node's strong component, by forward and backward colouring.

    Each round, nodes take the smallest colour that reaches them; those that also reach their
    colour's root are its component and leave. Nodes without in- or out-edges leave first.
    """
    ids = nodes.select("node_id").distinct()
    rest = edges.select("a", "b").where("a <> b").distinct().join(ids.withColumnRenamed("node_id", "a"), "a", "left_semi").join(ids.withColumnRenamed("node_id", "b"), "b", "left_semi").select("a", "b")
    done: DataFrame | None = None
    while True:
        rest = _trimmed(rest)
        if rest.isEmpty():
            break
        left = rest.select(F.col("a").alias("node_id")).distinct()
        colour = _spread(left.withColumn("c", F.col("node_id")), rest)
        same = rest.join(colour.select(F.col("node_id").alias("a"), F.col("c").alias("ca")), "a").join(colour.select(F.col("node_id").alias("b"), F.col("c").alias("cb")), "b").where("ca = cb").select(F.col("b").alias("a"), F.col("a").alias("b"))
        roots = colour.withColumn("hit", F.when(F.col("node_id") == F.col("c"), F.lit(0)).otherwise(F.lit(1))).select("node_id", F.col("hit").alias("c"))
        back = _spread(roots, stored(same, "same"))
        found = stored(colour.join(back.where("c = 0").select("node_id"), "node_id", "left_semi").withColumnRenamed("c", "scc"), "scc")
        done = found if done is None else done.unionByName(found)
        gone = found.select("node_id")
        rest = stored(rest.join(gone.withColumnRenamed("node_id", "a"), "a", "left_anti").join(gone.withColumnRenamed("node_id", "b"), "b", "left_anti").select("a", "b"), "rest")
    if done is None:
        return ids.withColumn("scc", F.col("node_id"))
    return done.unionByName(ids.join(done, "node_id", "left_anti").withColumn("scc", F.col("node_id")))


def _trimmed(edges: DataFrame) -> DataFrame:
    """The edges (a, b) left when nodes without in- or out-edges have gone, again and again: such nodes are on no cycle."""
    edges, seen = measured(edges, "trimmed", n=F.count(F.lit(1)))
    while seen["n"]:
        entered, left = edges.select(F.col("b").alias("a")).distinct(), edges.select(F.col("a").alias("b")).distinct()
        before = seen["n"]
        edges, seen = measured(edges.join(entered, "a", "left_semi").join(left, "b", "left_semi").select("a", "b"), "trimmed", n=F.count(F.lit(1)))
        if seen["n"] == before:
            break
    return edges


def _spread(values: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, c): the smallest value c of any node from which edges (a, b) lead to this one."""
    while True:
        got = edges.join(values.withColumnRenamed("node_id", "a"), "a").groupBy("b").agg(F.min("c").alias("m"))
        nxt, seen = measured(values.join(got.withColumnRenamed("b", "node_id"), "node_id", "left").select("node_id", F.least("c", F.coalesce("m", "c")).alias("c"), (F.coalesce("m", "c") < F.col("c")).alias("moved")), "spread", n=F.count_if("moved"))
        values = nxt.select("node_id", "c")
        if not seen["n"]:
            return values


def longest_ranks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, rank): length of the longest path of edges (a, b) that ends in each node. A cycle is an error.

    Each round only nodes that moved push their successors, so a round's cost follows what
    changed. Without a cycle no path has more edges than there are nodes with one.
    """
    ranks = nodes.select("node_id").distinct().withColumn("rank", F.lit(0))
    moved = ranks
    most = edges.agg(F.count_distinct("a").alias("n")).first()["n"]
    for _ in range(most + 1):
        push = edges.join(moved.withColumnRenamed("node_id", "a"), "a").groupBy("b").agg((F.max("rank") + 1).alias("r")).withColumnRenamed("b", "node_id")
        nxt, seen = measured(ranks.join(push, "node_id", "left").select("node_id", F.greatest("rank", F.coalesce("r", "rank")).alias("rank"), (F.coalesce("r", "rank") > F.col("rank")).alias("moved")), "ranks", n=F.count_if("moved"))
        ranks, moved = nxt.select("node_id", "rank"), nxt.where("moved").select("node_id", "rank")
        if not seen["n"]:
            return ranks
    raise ValueError("the edges have a cycle")


def condensed_ranks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, scc, rank): ranks of strong components, so that members of a cycle share one."""
    edges = stored(edges.select("a", "b"), "edges")
    scc = stored(strong_components(nodes, edges), "members")
    a, b = scc.select(F.col("node_id").alias("a"), F.col("scc").alias("sa")), scc.select(F.col("node_id").alias("b"), F.col("scc").alias("sb"))
    over = stored(edges.join(a, "a").join(b, "b").where("sa <> sb").select(F.col("sa").alias("a"), F.col("sb").alias("b")).distinct(), "condensed")
    ranks = longest_ranks(scc.select(F.col("scc").alias("node_id")), over)
    return scc.join(ranks.withColumnRenamed("node_id", "scc"), "scc").select("node_id", "scc", "rank")


def relation_groups(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """(group_id, representative, members, is_isolated): components of semantic relations (source_id, target_id); nodes without any are pooled in one group."""
    ends = relations.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    degree = ends.select(F.col("a").alias("node_id")).union(ends.select("b")).groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))
    linked = components(degree, ends).join(degree, "node_id")
    name = lambda c: F.concat(F.lit("visual-group:"), F.substring(F.sha2(c, 256), 1, 20))
    groups = linked.groupBy("component").agg(F.max_by("node_id", F.struct("degree", "node_id")).alias("representative"), F.count(F.lit(1)).alias("members")).select(name(F.col("component")).alias("group_id"), "representative", "members", F.lit(False).alias("is_isolated"))
    alone = nodes.select("node_id").distinct().join(degree, "node_id", "left_anti").agg(F.min("node_id").alias("representative"), F.count(F.lit(1)).alias("members")).where("members > 0").select(name(F.lit("isolated")).alias("group_id"), "representative", "members", F.lit(True).alias("is_isolated"))
    return groups.unionByName(alone)


def backbone(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (chapter, source_id, target_id, relation_type) of backbone types between main nodes (chapter, node_id, node_type) of one chapter, with their weight."""
    main = nodes.where(F.col("node_type").isin(*vocab.MAIN_TYPES)).select("chapter", "node_id")
    weight = F.create_map(*(F.lit(x) for kv in vocab.BACKBONE_WEIGHTS.items() for x in kv))
    e = edges.where(F.col("relation_type").isin(*vocab.BACKBONE)).withColumn("weight", weight[F.col("relation_type")])
    return e.join(main.withColumnRenamed("node_id", "source_id"), ["chapter", "source_id"], "left_semi").join(main.withColumnRenamed("node_id", "target_id"), ["chapter", "target_id"], "left_semi")


def node_scores(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(chapter, node_id, score, incoming): a main node's base weight and the weights of its backbone edges."""
    base = F.create_map(*(F.lit(x) for kv in vocab.NODE_WEIGHTS.items() for x in kv))
    ends = backbone(nodes, edges)
    load = ends.select("chapter", F.col("source_id").alias("node_id"), "weight", F.lit(0).alias("in")).unionByName(ends.select("chapter", F.col("target_id").alias("node_id"), "weight", F.lit(1).alias("in"))).groupBy("chapter", "node_id").agg(F.sum("weight").alias("load"), F.sum("in").alias("incoming"))
    main = nodes.where(F.col("node_type").isin(*vocab.MAIN_TYPES)).select("chapter", "node_id", "ord", base[F.col("node_type")].alias("base"))
    return main.join(load, ["chapter", "node_id"], "left").select("chapter", "node_id", "ord", (F.col("base") + F.coalesce("load", F.lit(0))).cast("long").alias("score"), F.coalesce("incoming", F.lit(0)).alias("incoming"))


def start_nodes(scores: DataFrame) -> DataFrame:
    """(chapter, node_id): where each chapter's main path starts: fewest incoming, greatest score, first."""
    w = Window.partitionBy("chapter").orderBy("incoming", F.col("score").desc(), "ord")
    return scores.withColumn("rank", F.row_number().over(w)).where("rank = 1").select("chapter", "node_id")


def spread_isolated(ranks: DataFrame) -> DataFrame:
    """ranks (group, node_id, rank, ord, linked) with nodes that no relation links spread over the ranks of their group, by their place ord in it; halves go to the even rank."""
    w = Window.partitionBy("group")
    rows = ranks.withColumn("top", F.max("rank").over(w)).withColumn("n", F.count(F.lit(1)).over(w))
    spread = F.least(F.col("top"), F.bround(F.col("ord") / F.greatest(F.lit(1), F.col("n") - 1) * F.col("top"), 0).cast("int"))
    return rows.withColumn("rank", F.when(~F.col("linked") & (F.col("top") > 0) & (F.col("n") > 1), spread).otherwise(F.col("rank"))).drop("top", "n")


def ordered_ranks(ranks: DataFrame, edges: DataFrame) -> DataFrame:
    """(group, node_id, rank, place): the order inside each rank of ranks (group, node_id, rank, ord): by the mean place of the predecessors in ranks before, over edges (group, a, b); those without any come last, equal ones by ord.

    A rank follows from those before it, so there is a round of joins for each.
    """
    top = ranks.agg(F.max("rank")).first()[0]
    placed = None
    for k in range(0 if top is None else top + 1):
        here = ranks.where(F.col("rank") == k)
        if placed is None:
            mean = here.select("group", "node_id", F.lit(None).cast("double").alias("mean"))
        else:
            mean = edges.join(placed.select("group", F.col("node_id").alias("a"), "place"), ["group", "a"]).groupBy("group", F.col("b").alias("node_id")).agg(F.avg("place").alias("mean"))
        order = Window.partitionBy("group").orderBy(F.col("mean").asc_nulls_last(), "ord")
        new = here.join(mean, ["group", "node_id"], "left").select("group", "node_id", "rank", (F.row_number().over(order) - 1).alias("place"))
        placed = stored(new if placed is None else placed.unionByName(new), "places")
    return placed if placed is not None else ranks.select("group", "node_id", "rank", F.lit(0).alias("place"))


def _followed(starts: DataFrame, to: DataFrame) -> DataFrame:
    """(chapter, node_id, steps): starts (chapter, node_id) and all nodes that pointers (chapter, node_id, to) lead to from there, by doubling; one on a cycle counts when it is met first."""
    seen = starts.select("chapter", "node_id", F.lit(0).cast("long").alias("steps"))
    jump, length = to.select("chapter", "node_id", "to"), 1
    while True:
        far = seen.join(jump, ["chapter", "node_id"]).select("chapter", F.col("to").alias("node_id"), (F.col("steps") + length).alias("steps"))
        new, found = measured(far.join(seen.select("chapter", "node_id"), ["chapter", "node_id"], "left_anti").groupBy("chapter", "node_id").agg(F.min("steps").alias("steps")), "followed", n=F.count(F.lit(1)))
        if not found["n"]:
            return seen
        seen, length = stored(seen.unionByName(new), "seen"), length * 2
        jump = stored(jump.join(jump.select("chapter", F.col("node_id").alias("to"), F.col("to").alias("next")), ["chapter", "to"]).select("chapter", "node_id", F.col("next").alias("to")), "jumps")


def main_paths(scores: DataFrame, strong: DataFrame) -> DataFrame:
    """(chapter, node_id, position): each chapter's walk from its start node along the heaviest edge to a node that it hasn't visited.

    scores: (chapter, node_id, ord, score, incoming); strong: (chapter, source_id, target_id, weight). All
    chapters walk together. Until a walk meets itself it follows each node's best edge to an
    unvisited node, and such a stretch of any length is found by doubling; then the visited
    nodes leave the choice, and it goes on from where it is.
    """
    aim = scores.select("chapter", F.col("node_id").alias("target_id"), "score", "incoming", "ord")
    rank = F.struct((-F.col("weight")).alias("w"), (-F.col("score")).alias("s"), "incoming", "ord", "target_id")
    edges = stored(strong.join(aim, ["chapter", "target_id"]).select("chapter", F.col("source_id").alias("node_id"), "target_id", rank.alias("rank")), "ahead")
    ends = stored(start_nodes(scores).withColumn("position", F.lit(0).cast("long")), "starts")
    path = ends
    while True:
        free = edges.join(path.select("chapter", F.col("node_id").alias("target_id")), ["chapter", "target_id"], "left_anti")
        best = stored(free.groupBy("chapter", "node_id").agg(F.min("rank").alias("rank")).select("chapter", "node_id", F.col("rank.target_id").alias("to")), "best")
        walked = _followed(ends, best).join(ends.select("chapter", F.col("position").alias("at")), "chapter")
        new, seen = measured(walked.where("steps > 0").select("chapter", "node_id", (F.col("at") + F.col("steps")).alias("position")), "walked", n=F.count(F.lit(1)))
        if not seen["n"]:
            return path
        path = stored(path.unionByName(new), "path")
        ends = stored(new.groupBy("chapter").agg(F.max_by("node_id", "position").alias("node_id"), F.max("position").alias("position")).select("chapter", "node_id", "position"), "ends")


def chapter_plans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(chapter, node_id, place, parent, position): each knowledge node's place (path, branch, auxiliary or unassigned) in its chapter, what it hangs on, and its position.

    nodes: (chapter, node_id, node_type, ord), ord tells nodes of a chapter apart. A branch hangs on its first predecessor
    on the path, else its first successor there, else on the path's first node by ord; an
    auxiliary node on the nearest main node by place that a relation links it to, else on the
    nearest of all, of equal ones the first on the path, then by place. Chapters may be of any size.
    """
    scores = stored(node_scores(nodes, edges).select("chapter", "node_id", "ord", "score", "incoming"), "scores")
    strong = stored(backbone(nodes, edges).select("chapter", "source_id", "target_id", "weight"), "backbone")
    path = main_paths(scores, strong)
    is_main = F.col("node_type").isin(*vocab.MAIN_TYPES)
    placed = scans.running(nodes.select("chapter", "node_id", "node_type", "ord"), ["chapter"], ["ord"], mains=is_main.cast("long"))
    placed = stored(placed.select("chapter", "node_id", "node_type", (F.col("idx") - 1).alias("index"), "mains", is_main.alias("main")).join(path, ["chapter", "node_id"], "left"), "placed")

    on = lambda key: path.select("chapter", F.col("node_id").alias(key), F.struct("position", F.col("node_id").alias("node")).alias("at"))
    behind = strong.join(on("source_id"), ["chapter", "source_id"]).groupBy("chapter", F.col("target_id").alias("node_id")).agg(F.min("at").alias("behind"))
    ahead = strong.join(on("target_id"), ["chapter", "target_id"]).groupBy("chapter", F.col("source_id").alias("node_id")).agg(F.min("at").alias("ahead"))
    roots = placed.where("position is not null").groupBy("chapter").agg(F.min_by("node_id", "index").alias("root"))
    branch = placed.where("main and position is null").join(behind, ["chapter", "node_id"], "left").join(ahead, ["chapter", "node_id"], "left").join(roots, "chapter", "left")
    branch = branch.select("chapter", "node_id", F.lit("branch").alias("place"), F.coalesce("behind.node", "ahead.node", "root").alias("parent"), F.col("index").alias("position"))

    helpers = placed.where(F.col("node_type").isin(*vocab.AUXILIARY_TYPES)).select("chapter", "node_id", "index", "mains")
    mains = placed.where("main").select("chapter", F.col("node_id").alias("host"), F.col("index").alias("host_index"), F.col("mains").alias("number"), F.struct(F.col("position").isNull().alias("off"), F.coalesce("position", "index").alias("at")).alias("turn"))
    ends = edges.where("relation_type <> 'contains'").select("chapter", "source_id", "target_id")
    beside = ends.unionByName(ends.select("chapter", F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))).distinct()
    far = F.abs(F.col("host_index") - F.col("index"))
    linked = helpers.join(beside.withColumnRenamed("source_id", "node_id").withColumnRenamed("target_id", "host"), ["chapter", "node_id"]).join(mains, ["chapter", "host"])
    linked = linked.groupBy("chapter", "node_id").agg(F.min(F.struct(far.alias("far"), "host_index", "host")).alias("h")).select("chapter", "node_id", F.col("h.host").alias("linked"))
    near = helpers.withColumn("number", F.explode(F.array("mains", F.col("mains") + 1))).join(mains, ["chapter", "number"])
    near = near.groupBy("chapter", "node_id").agg(F.min(F.struct(far.alias("far"), "turn", "host")).alias("h")).select("chapter", "node_id", F.col("h.host").alias("near"))
    helped = helpers.join(near, ["chapter", "node_id"]).join(linked, ["chapter", "node_id"], "left")
    helped = helped.select("chapter", "node_id", F.lit("auxiliary").alias("place"), F.coalesce("linked", "near").alias("parent"), F.col("index").alias("position"))

    walked = path.select("chapter", "node_id", F.lit("path").alias("place"), F.lit("").alias("parent"), "position")
    known = stored(walked.unionByName(branch).unionByName(helped), "plans")
    rest = placed.join(known.select("chapter", "node_id"), ["chapter", "node_id"], "left_anti").select("chapter", "node_id", F.lit("unassigned").alias("place"), F.lit("").alias("parent"), F.col("index").alias("position"))
    return known.unionByName(rest)
