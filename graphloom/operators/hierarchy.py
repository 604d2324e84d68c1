"""Containment forests: projection from edges and fields, cycles, closures, roles and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored


def candidate_parents(nodes: DataFrame, relations: DataFrame, statuses: tuple[str, ...] = ("pending", "accepted", "needs_revision", "needs_expert_review")) -> DataFrame:
    """(child, parent): contains relations of an eligible status; the parent field counts only for children that no contains relation names.

    nodes: (node_id, parent_id, review_status); relations: (source_id, target_id, relation_type, review_status).
    """
    contains = relations.where("relation_type = 'contains'")
    named = contains.where("target_id <> ''").select(F.col("target_id").alias("node_id")).distinct()
    explicit = contains.where(F.col("review_status").isin(*statuses)).select(F.col("target_id").alias("child"), F.col("source_id").alias("parent"))
    field = nodes.where(F.col("review_status").isin(*statuses) & (F.col("parent_id") != "")).join(named, "node_id", "left_anti").select(F.col("node_id").alias("child"), F.col("parent_id").alias("parent"))
    return explicit.unionByName(field).distinct()


def projected(nodes: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((child, parent) without faults, issues (code, node_id, detail)).

    A missing end, a node that contains itself, several parents and cycles are issues; several
    parents leave the child without one, and so does a cycle.
    """
    ids = nodes.select("node_id").distinct()
    known = candidates.join(ids.withColumnRenamed("node_id", "child"), "child", "left_semi").join(ids.withColumnRenamed("node_id", "parent"), "parent", "left_semi")
    issue = lambda df, code, detail: df.select(F.lit(code).alias("code"), F.col("child").alias("node_id"), detail.alias("detail"))
    lost = candidates.join(known, ["child", "parent"], "left_anti")
    selves, others = known.where("child = parent"), known.where("child <> parent")
    count = others.groupBy("child").agg(F.count_distinct("parent").alias("n"), F.array_join(F.array_sort(F.collect_set("parent")), "|").alias("parents"), F.min("parent").alias("parent"))
    single = count.where("n = 1").select("child", "parent")
    looped = cycle_members(single)
    issues = (
        issue(lost, "hierarchy_endpoint_missing", F.col("parent"))
        .unionByName(issue(selves, "hierarchy_self_parent", F.col("parent")))
        .unionByName(issue(count.where("n > 1"), "hierarchy_multiple_parents", F.col("parents")))
        .unionByName(looped.groupBy("cycle_id").agg(F.array_join(F.array_sort(F.collect_list("node_id")), "|").alias("members")).select(F.lit("hierarchy_cycle").alias("code"), F.col("cycle_id").alias("node_id"), F.col("members").alias("detail")))
    )
    return single.join(looped.select(F.col("node_id").alias("child")), "child", "left_anti"), issues


def ancestors(parents: DataFrame) -> DataFrame:
    """(node_id, ancestor, distance), itself at 0 excluded, of a forest without cycles (child, parent), by doubling: log2 of the depth rounds."""
    reach = parents.select(F.col("child").alias("node_id"), F.col("parent").alias("ancestor"), F.lit(1).alias("distance"))
    step, edges = 1, parents.count()
    while True:
        if step > 2 * edges + 1:
            raise ValueError("the forest has a cycle")
        far = reach.where(F.col("distance") == step).select("node_id", F.col("ancestor").alias("via"))
        more = far.join(reach.select(F.col("node_id").alias("via"), "ancestor", F.col("distance").alias("d")), "via").where(F.col("d") <= step).select("node_id", "ancestor", (F.col("d") + step).alias("distance"))
        if more.isEmpty():
            return reach
        reach, step = stored(reach.unionByName(more), "reach"), step * 2


def upward(starts: DataFrame, parents: DataFrame) -> DataFrame:
    """(node_id): starts and all nodes above them, where each child has one parent (child, parent); cycles are walked once.

    Pointers double, and what is reached with them, until a round reaches nothing new.
    """
    reached, jump = starts.select("node_id").distinct(), parents.select("child", "parent")
    while True:
        new = stored(reached.join(jump.withColumnRenamed("child", "node_id"), "node_id").select(F.col("parent").alias("node_id")).distinct().join(reached, "node_id", "left_anti"), "above")
        if new.isEmpty():
            return reached
        reached = stored(reached.unionByName(new), "reached")
        jump = stored(jump.join(jump.select(F.col("child").alias("parent"), F.col("parent").alias("far")), "parent").select("child", F.col("far").alias("parent")), "jumps")


def written_back(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """nodes (node_id, display_name, ...) with parent_id and parent_name of a projected forest (child, parent); empty for roots and for children without a clear parent."""
    names = nodes.select(F.col("node_id").alias("parent"), F.col("display_name").alias("parent_name"))
    found = parents.join(names, "parent", "left").select(F.col("child").alias("node_id"), F.col("parent").alias("parent_id"), "parent_name")
    out = nodes.drop("parent_id", "parent_name").join(found, "node_id", "left")
    return out.withColumn("parent_id", F.coalesce("parent_id", F.lit(""))).withColumn("parent_name", F.coalesce("parent_name", F.lit("")))


def cycle_members(parents: DataFrame) -> DataFrame:
    """(node_id, cycle_id) of the nodes on cycles where each node has one parent at most; cycle_id is the smallest member.

    Pointers double each round; after as many steps as there are nodes every pointer is on a
    cycle, or has run out at a root.
    """
    jump = parents.select(F.col("child").alias("node_id"), F.col("parent").alias("to"), F.least("child", "parent").alias("low"))
    state = None
    while True:
        nxt = jump.select(F.col("node_id").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        # Those whose pointer runs out lead to a root, and are lost here.
        jump = stored(jump.join(nxt, "to").select("node_id", F.col("to2").alias("to"), F.least("low", "low2").alias("low")), "jumps")
        before, state = state, jump.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("to").alias("image"), F.sum(F.hash("node_id", "low").cast("long")).alias("h")).first()
        if state["n"] == 0 or state == before:
            break
    # The image no longer shrinks, so each of its nodes is on a cycle.
    on = jump.select(F.col("to").alias("node_id")).distinct()
    return jump.join(on, "node_id", "left_semi").select("node_id", F.col("low").alias("cycle_id"))


def layers(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """(node_id, parent_id, depth, role, layer, root_id, path): where each of nodes (node_id, is_container) stands in a forest (child, parent)."""
    up = ancestors(parents)
    chain = up.groupBy("node_id").agg(F.max("distance").alias("depth"), F.max_by("ancestor", "distance").alias("root_id"), F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("distance", "ancestor")))), lambda s: s["ancestor"]), "/").alias("above"))
    rows = nodes.join(chain, "node_id", "left").join(parents.withColumnRenamed("child", "node_id"), "node_id", "left")
    depth = F.coalesce("depth", F.lit(0))
    role = F.when(~F.col("is_container"), "knowledge").when(depth == 0, "chapter").when(depth == 1, "section").otherwise("subsection")
    return rows.select("node_id", F.coalesce("parent", F.lit("")).alias("parent_id"), depth.alias("depth"), role.alias("role"), F.when(role == "chapter", "chapter").otherwise("knowledge_point").alias("layer"), F.coalesce("root_id", "node_id").alias("root_id"), F.concat_ws("/", "above", "node_id").alias("path"))


def lowest_common(pairs: DataFrame, parents: DataFrame) -> DataFrame:
    """pairs (a, b) with lca: the nearest node that is a or b itself or above both; null without one."""
    up = ancestors(parents)
    own = parents.select(F.col("child").alias("n")).union(parents.select("parent")).distinct()
    reach = up.select("node_id", "ancestor", "distance").unionByName(own.select(F.col("n").alias("node_id"), F.col("n").alias("ancestor"), F.lit(0).alias("distance")))
    x = reach.select(F.col("node_id").alias("a"), F.col("ancestor").alias("c"), F.col("distance").alias("da"))
    y = reach.select(F.col("node_id").alias("b"), F.col("ancestor").alias("c"))
    best = pairs.select("a", "b").distinct().join(x, "a").join(y, ["b", "c"]).groupBy("a", "b").agg(F.min_by("c", "da").alias("lca"))
    return pairs.join(best, ["a", "b"], "left")
