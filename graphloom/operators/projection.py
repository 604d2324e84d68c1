"""Views of a review document: textbook and relations projections, their ledgers, and what is published."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def instances(nodes: DataFrame, memberships: DataFrame) -> DataFrame:
    """(view_id, node_id, scope_id, nth, is_reference): a card for each membership (scope_id, node_id, relation_id) of a node; one in the virtual scope without any."""
    w = Window.partitionBy("node_id").orderBy("scope_id", "relation_id")
    placed = memberships.withColumn("nth", F.row_number().over(w)).select("node_id", "scope_id", "nth", "relation_id")
    rows = nodes.select("node_id").join(placed, "node_id", "left")
    return rows.select(F.concat(F.lit("node:"), F.col("node_id"), F.lit("@"), F.coalesce("relation_id", F.lit("unassigned"))).alias("view_id"), "node_id", F.coalesce("scope_id", F.lit("unassigned")).alias("scope_id"), F.coalesce("nth", F.lit(1)).alias("nth"), (F.coalesce("nth", F.lit(1)) > 1).alias("is_reference"))


def ledger(relations: DataFrame, visible: DataFrame, include_rejected: bool = False) -> DataFrame:
    """(relation_id, representation): how each active relation shows: nested (structure and membership), filtered (rejected), line (both ends visible), else context. visible: (node_id)."""
    ids = visible.select("node_id").distinct()
    a, b = ids.select(F.col("node_id").alias("source_id"), F.lit(True).alias("__a")), ids.select(F.col("node_id").alias("target_id"), F.lit(True).alias("__b"))
    rows = relations.where("lifecycle_state = 'active'").join(a, "source_id", "left").join(b, "target_id", "left")
    nested = F.col("relation_family").isin("structure", "membership")
    kind = F.when((F.col("review_status") == "rejected") & ~F.lit(include_rejected), "filtered").when(nested, "nested").when(F.col("__a") & F.col("__b"), "line").otherwise("context")
    return rows.select("relation_id", kind.alias("representation"))


def projection_issues(nodes: DataFrame, scopes: DataFrame, relations: DataFrame) -> DataFrame:
    """(code, object_id) of what a projection can't show."""
    live = relations.where("lifecycle_state = 'active' and review_status <> 'rejected'")
    s, n = scopes.select(F.col("scope_id").alias("id")).distinct(), nodes.select(F.col("node_id").alias("id")).distinct()
    ends = lambda family, *cols: live.where(F.col("relation_family") == family).select("relation_id", F.explode(F.array(*cols)).alias("id"))
    out = lambda df, code: df.select(F.lit(code).alias("code"), F.col("relation_id").alias("object_id")).distinct()
    members = live.where("relation_family = 'membership'").join(s.withColumnRenamed("id", "source_id"), "source_id", "left_semi").select(F.col("target_id").alias("node_id"))
    free = nodes.join(scopes.select(F.col("scope_id").alias("node_id")), "node_id", "left_anti").join(members, "node_id", "left_anti").select(F.lit("node_membership_unresolved").alias("code"), F.col("node_id").alias("object_id"))
    several = live.where("relation_family = 'structure'").groupBy(F.col("target_id").alias("object_id")).agg(F.count_distinct("source_id").alias("k")).where("k > 1").select(F.lit("structure_projection_multiple_parents").alias("code"), "object_id")
    return (
        out(ends("structure", "source_id", "target_id").join(s, "id", "left_anti"), "structure_projection_endpoint_missing")
        .unionByName(several)
        .unionByName(out(ends("membership", "source_id").join(s, "id", "left_anti"), "membership_projection_endpoint_missing"))
        .unionByName(free)
        .unionByName(out(ends("semantic", "source_id", "target_id").join(n, "id", "left_anti"), "semantic_projection_endpoint_missing"))
    )


def selected_ends(relations: DataFrame, cards: DataFrame, focused: str = "") -> DataFrame:
    """(relation_id, source_view, target_view): of all cards of both ends the pair in the focused scope, else in one scope, else the first."""
    a, b = cards.select(F.col("node_id").alias("source_id"), F.col("view_id").alias("source_view"), F.col("scope_id").alias("sa")), cards.select(F.col("node_id").alias("target_id"), F.col("view_id").alias("target_view"), F.col("scope_id").alias("sb"))
    same = F.col("sa") == F.col("sb")
    # Pairs in one scope come from an equi-join; only relations without any fall back to first cards.
    both = relations.select("relation_id", "source_id", "target_id").join(a, "source_id").join(b, ["target_id"]).where(same)
    best = both.groupBy("relation_id").agg(F.min(F.struct((F.col("sa") != focused).alias("far"), "source_view", "target_view")).alias("p")).select("relation_id", "p.source_view", "p.target_view")
    rest = relations.join(best, "relation_id", "left_anti").join(a.groupBy("source_id").agg(F.min("source_view").alias("source_view")), "source_id").join(b.groupBy("target_id").agg(F.min("target_view").alias("target_view")), "target_id")
    return best.unionByName(rest.select("relation_id", "source_view", "target_view"))


def formal_projection(nodes: DataFrame, memberships: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with parent_id and prerequisites, edges) of a published graph: contains edges from memberships, semantic ones between nodes that are in."""
    ids = nodes.select("node_id")
    inner = relations.join(ids.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi")
    needs = inner.where("relation_type = 'prerequisite'").groupBy(F.col("target_id").alias("node_id")).agg(F.array_sort(F.collect_set("source_id")).alias("prerequisites"))
    parents = memberships.groupBy("node_id").agg(F.min("scope_id").alias("parent_id"))
    full = nodes.join(parents, "node_id", "left").join(needs, "node_id", "left").withColumn("parent_id", F.coalesce("parent_id", F.lit(""))).withColumn("prerequisites", F.coalesce("prerequisites", F.array().cast("array<string>")))
    contains = full.where("parent_id <> ''").select(F.col("parent_id").alias("source_id"), F.col("node_id").alias("target_id"), F.lit("contains").alias("relation_type"))
    return full, contains.unionByName(inner.select("source_id", "target_id", "relation_type")).distinct()


def layer_edges(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with their scope, edges that are dropped since an end is missing)."""
    ids = nodes.select("node_id").distinct()
    kept = edges.join(ids.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi")
    return kept.withColumn("scope", T.edge_scope(F.col("relation_type"))), edges.join(kept, edges.columns, "left_anti")


def membership_status(memberships: DataFrame) -> DataFrame:
    """(node_id, review_status): the most pressing status among the memberships (node_id, review_status) of a node; empty if none is open or accepted."""
    has = lambda s: F.bool_or(F.col("review_status") == s)
    status = F.when(has("needs_revision"), "needs_revision").when(has("needs_expert_review"), "needs_expert_review").when(has("pending"), "pending").when(has("accepted"), "accepted").otherwise("")
    return memberships.groupBy("node_id").agg(status.alias("review_status"))


def shown(instances_: DataFrame, relations: DataFrame, hidden: DataFrame, include_rejected: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cards, relations, ledger (relation_id, representation)) of a view without its hidden cards (view_id): a relation with a hidden end goes as well, and the ledger says ``view_hidden``.

    instances_: (view_id, node_id, ...); relations: (relation_id, source_view, target_view, review_status).
    """
    gone = hidden.select("view_id").distinct()
    cards = instances_.join(gone, "view_id", "left_anti")
    mark = lambda c: gone.select(F.col("view_id").alias(c), F.lit(True).alias(f"h_{c}"))
    seen = relations.join(mark("source_view"), "source_view", "left").join(mark("target_view"), "target_view", "left")
    rejected = (F.col("review_status") == "rejected") & ~F.lit(include_rejected)
    seen = seen.withColumn("representation", F.when(rejected, "filtered").when(F.coalesce(F.col("h_source_view") | F.col("h_target_view"), F.col("h_source_view"), F.col("h_target_view"), F.lit(False)), "view_hidden").otherwise("line"))
    return cards, seen.where("representation = 'line'").select(*relations.columns), seen.select("relation_id", "representation")
