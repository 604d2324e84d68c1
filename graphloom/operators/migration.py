"""Drafts to review documents and back: scopes, occurrences, recovered memberships, and legacy rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from . import hierarchy


def scopes(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """(scope_id, structural_role, structural_number, reading_order) of container nodes (node_id, display_name, chapter, node_type, ord); the role follows the depth over structure relations (source_id, target_id, review_status) that weren't rejected."""
    boxes = nodes.where(F.col("node_type") == "container")
    links = relations.where("relation_family = 'structure' and review_status <> 'rejected'").groupBy(F.col("target_id").alias("child")).agg(F.max("source_id").alias("parent")).where("child <> parent")
    links = links.join(boxes.select(F.col("node_id").alias("child")), "child", "left_semi").join(boxes.select(F.col("node_id").alias("parent")), "parent", "left_semi").select("child", "parent")
    loops = hierarchy.cycle_members(links).select(F.col("node_id").alias("child"))
    depth = hierarchy.ancestors(links.join(loops, "child", "left_anti")).groupBy(F.col("node_id")).agg(F.max("distance").alias("d"))
    rows = boxes.join(depth, "node_id", "left").withColumn("d", F.coalesce("d", F.lit(0)))
    role = F.when(F.col("d") == 0, "chapter").when(F.col("d") == 1, "section").otherwise("subsection")
    return rows.select(F.col("node_id").alias("scope_id"), role.alias("structural_role"), T.structural_number(F.col("display_name"), F.col("chapter")).alias("structural_number"), F.col("ord").alias("reading_order"))


def anchors_by_node(evidence: DataFrame) -> DataFrame:
    """(node_id, anchor_ids) of evidence (anchor_id, target_ids), in order of the anchors."""
    return evidence.select("anchor_id", F.explode("target_ids").alias("node_id")).groupBy("node_id").agg(F.array_sort(F.collect_set("anchor_id")).alias("anchor_ids"))


def occurrences(nodes: DataFrame, hints: DataFrame, evidence: DataFrame) -> DataFrame:
    """(occurrence_id, node_id, chapter_hint, section_hint, anchor_ids) of nodes that are no containers: a row for each hint (node_id, chapter_hint, section_hint), or the node's own place."""
    own = nodes.where(F.col("node_type") != "container").select("node_id", "chapter", "section")
    rows = own.join(hints.distinct(), "node_id", "left").join(anchors_by_node(evidence), "node_id", "left")
    chapter, section = F.coalesce("chapter_hint", "chapter"), F.coalesce("section_hint", "section")
    return rows.select(T.stable_id("occurrence", F.col("node_id"), chapter, section).alias("occurrence_id"), "node_id", chapter.alias("chapter_hint"), section.alias("section_hint"), F.coalesce("anchor_ids", F.array().cast("array<string>")).alias("anchor_ids")).dropDuplicates(["occurrence_id"])


def recovered_memberships(occurrences_: DataFrame, scopes_: DataFrame, known: DataFrame) -> DataFrame:
    """(node_id, scope_id, occurrence_ids, is_new): nodes put in the one scope whose number their section begins with; where several fit, none is taken. known: (node_id, scope_id)."""
    number = F.regexp_extract(F.coalesce("section_hint", F.lit("")), r"^\s*(\d+(?:\.\d+){0,4})", 1)
    hinted = occurrences_.withColumn("structural_number", number).where("structural_number <> ''")
    fits = hinted.join(scopes_.select("scope_id", "structural_number"), "structural_number")
    w = Window.partitionBy("occurrence_id")
    sole = fits.withColumn("k", F.count(F.lit(1)).over(w)).where("k = 1").groupBy("node_id", "scope_id").agg(F.array_sort(F.collect_set("occurrence_id")).alias("occurrence_ids"))
    old = known.select("node_id", "scope_id", F.lit(True).alias("old")).distinct()
    both = sole.join(old, ["node_id", "scope_id"], "full")
    return both.select("node_id", "scope_id", F.coalesce("occurrence_ids", F.array().cast("array<string>")).alias("occurrence_ids"), F.col("old").isNull().alias("is_new"))


def legacy_drafts(nodes: DataFrame, relations: DataFrame, occurrences_: DataFrame, choices: DataFrame) -> DataFrame:
    """Rows of the first schema: each node (node_id, display_name) with its parent (the chosen membership, else the first), prerequisites, first occurrence and the relations that begin at it. choices: (node_id, relation_id)."""
    member = relations.where("relation_family in ('membership', 'structure') and relation_type = 'contains'").select(F.col("target_id").alias("node_id"), "relation_id", F.col("source_id").alias("parent"))
    picked = member.join(choices.withColumn("chosen", F.lit(True)), ["node_id", "relation_id"], "left")
    parent = picked.groupBy("node_id").agg(F.min_by("parent", F.struct(F.col("chosen").isNull().alias("other"), "relation_id")).alias("parent_id"))
    needs = relations.where("relation_type = 'prerequisite'").groupBy(F.col("target_id").alias("node_id")).agg(F.array_sort(F.collect_set("source_id")).alias("prerequisites"))
    place = occurrences_.groupBy("node_id").agg(F.min(F.struct("occurrence_id", "chapter_hint", "section_hint")).alias("o")).select("node_id", F.col("o.chapter_hint").alias("chapter"), F.col("o.section_hint").alias("section"))
    out = relations.where("relation_family in ('semantic', 'unresolved')").groupBy(F.col("source_id").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("relation_id", "target_id", "relation_type", "review_status"))).alias("relations"))
    rows = nodes.select("node_id", "display_name")
    for part in (parent, needs, place, out):
        rows = rows.join(part, "node_id", "left")
    return rows.withColumn("parent_id", F.coalesce("parent_id", F.lit(""))).withColumn("prerequisites", F.coalesce("prerequisites", F.array().cast("array<string>")))


def advice_wanted(plans: DataFrame) -> DataFrame:
    """plans (mode, confidence, branches, complexity, unassigned) with wants_advice: unsure, branched, crowded or incomplete ones."""
    unsure = (F.col("mode") == "multi_core_clusters") | (F.col("confidence") < 0.72) | (F.col("branches") >= 3) | (F.col("complexity") >= 7) | (F.col("unassigned") >= 2)
    return plans.withColumn("wants_advice", unsure)


def plan_summary(plans: DataFrame, edges: DataFrame) -> DataFrame:
    """(chapter, mode, confidence, branches, unassigned) of ``graph.chapter_plans`` and the number of backbone edges and clusters by chapter (chapter, backbone, clusters)."""
    count = lambda place: F.count_if(F.col("place") == place)
    got = plans.groupBy("chapter").agg(count("path").alias("path"), count("branch").alias("branches"), count("unassigned").alias("unassigned"), count("auxiliary").alias("auxiliary")).join(edges, "chapter", "left")
    main, strong = F.col("path") + F.col("branches"), F.coalesce("backbone", F.lit(0)) > 0
    mode = F.when(F.coalesce("clusters", F.lit(0)) >= 2, "multi_core_clusters").when(F.col("branches") > 0, "main_path_with_branches").otherwise("single_path")
    sure = F.least(F.lit(0.96), 0.42 + F.when(main > 0, 0.34).otherwise(0.0) + F.when(strong, 0.12).otherwise(0.0) + F.when(F.col("path") > 0, 0.08).otherwise(0.0) - F.when(mode == "multi_core_clusters", 0.06).otherwise(0.0) - F.when(F.col("unassigned") > 0, 0.06).otherwise(0.0))
    sure = F.when(main == 0, F.when(F.col("unassigned") > 0, 0.38).otherwise(0.0)).when(~strong & (main > 1), F.least(sure, F.lit(0.62))).otherwise(sure)
    return got.select("chapter", mode.alias("mode"), F.round(sure, 3).alias("confidence"), "branches", "unassigned")


def advised(plans: DataFrame, advice: DataFrame) -> DataFrame:
    """plans with the places that advice (chapter, node_id, place, parent, position) gives, as far as it names nodes of the chapter, each once; nodes that it leaves out keep their place unless it names their chapter, when they are unassigned."""
    known = advice.join(plans.select("chapter", "node_id"), ["chapter", "node_id"], "left_semi")
    first = known.withColumn("k", F.row_number().over(Window.partitionBy("chapter", "node_id").orderBy("position", "place"))).where("k = 1").drop("k")
    named = first.select("chapter").distinct()
    rest = plans.join(first.select("chapter", "node_id"), ["chapter", "node_id"], "left_anti")
    lost = rest.join(named, "chapter", "left_semi").withColumn("place", F.lit("unassigned")).withColumn("parent", F.lit(""))
    return first.select(*plans.columns).unionByName(lost).unionByName(rest.join(named, "chapter", "left_anti"))
