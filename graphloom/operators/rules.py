"""Integrity and quality rules: each a query of (rule, object_id); reports are their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vocab
from . import graph, hierarchy


def issue(df: DataFrame, code: str, object_id: Column | str, severity: str = "error") -> DataFrame:
    return df.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), (F.col(object_id) if isinstance(object_id, str) else object_id).cast("string").alias("object_id"))


def report(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by its keys over all shuffle partitions before it is grouped: what a task holds is a share of the rows, whatever the size of files and however well rows compress."""
    return df.repartition(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def repeated(df: DataFrame, key: str) -> DataFrame:
    return dealt(df.select(key), key).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def dangling(df: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    return df.join(known.select(F.col(known_key).alias(key)).distinct(), key, "left_anti")


def lost(df: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """The same as dangling, where many rows share a key, or there are few against all that is known: keys are looked up once each, and rows meet those that are missing."""
    keys = df.select(key).distinct()
    found = known.select(F.col(known_key).alias(key)).join(keys, key, "left_semi")
    missing = keys.join(found, key, "left_anti").select(F.col(key).alias("__missing"))
    return df.join(missing, F.col(key).eqNullSafe(F.col("__missing")), "left_semi")


def lost_members(df: DataFrame, key: str, listed: str, known: DataFrame, known_key: str) -> DataFrame:
    """The keys of rows that list what isn't known; a key comes as often as it does."""
    return lost(df.select(F.col(key), F.explode(listed).alias("__m")), "__m", known, known_key).select(key)


def document_issues(doc: dict[str, DataFrame]) -> DataFrame:
    """Integrity of a review document.

    doc: nodes (node_id, lifecycle_state, review_status), scopes (scope_id, structural_role,
    lifecycle_state, review_status), occurrences (occurrence_id, node_id, lifecycle_state,
    evidence_anchor_ids), evidence (anchor_id), relations (relation_id, relation_family, source_id,
    target_id, relation_type, lifecycle_state, review_status, occurrence_ids, ord), profiles
    (profile_id, node_ids, relation_ids, membership_ids), meta (schema_version, document_id).
    """
    n, s, o, e, r, p, m = (doc[k] for k in ("nodes", "scopes", "occurrences", "evidence", "relations", "profiles", "meta"))
    life, status = F.col("lifecycle_state"), F.col("review_status")
    bad_life, bad_status = ~life.isin(*vocab.LIFECYCLES), ~status.isin(*vocab.REVIEW_STATUSES)
    active = r.where((life == "active") & (status != "rejected"))
    scoped = r.join(s.select(F.col("scope_id").alias("source_id"), F.lit(True).alias("a")), "source_id", "left").join(s.select(F.col("scope_id").alias("target_id"), F.lit(True).alias("b")), "target_id", "left").withColumn("a", F.coalesce("a", F.lit(False))).withColumn("b", F.coalesce("b", F.lit(False)))
    archived = n.where("lifecycle_state = 'archived'").select("node_id")
    ends = r.select("relation_id", "lifecycle_state", F.explode(F.array("source_id", "target_id")).alias("node_id"))
    facts = ("relation_family", "source_id", "relation_type", "target_id")
    fact = Window.partitionBy(*facts).orderBy("ord", "relation_id")
    structure = active.where("relation_family = 'structure'")
    single = structure.groupBy(F.col("target_id").alias("child")).agg(F.count_distinct("source_id").alias("k"), F.min("source_id").alias("parent")).where("k = 1").select("child", "parent")
    with_state = s.join(n.select(F.col("node_id").alias("scope_id"), F.col("lifecycle_state").alias("node_state")), "scope_id")
    issues = report(
        issue(m.where("schema_version <> 2"), "schema_version_invalid", "document_id"), issue(m.where("document_id = ''"), "document_id_missing", "document_id"),
        *(issue(repeated(df, k), f"duplicate_{what}", k) for df, k, what in ((n, "node_id", "node_id"), (r, "relation_id", "relation_id"), (o, "occurrence_id", "occurrence_id"), (e, "anchor_id", "evidence_id"), (s, "scope_id", "scope_id"), (p, "profile_id", "profile_id"))),
        issue(n.where(bad_life), "node_lifecycle_invalid", "node_id"), issue(n.where(bad_status), "node_review_status_invalid", "node_id"),
        issue(dangling(s, "scope_id", n, "node_id"), "scope_node_missing", "scope_id"), issue(s.where(~F.col("structural_role").isin(*vocab.SCOPE_ROLES)), "scope_role_invalid", "scope_id"),
        issue(s.where(bad_life), "scope_lifecycle_invalid", "scope_id"), issue(s.where(bad_status), "scope_review_status_invalid", "scope_id"), issue(with_state.where("lifecycle_state <> node_state"), "scope_node_lifecycle_mismatch", "scope_id"),
        issue(dangling(o, "node_id", n, "node_id"), "occurrence_node_missing", "occurrence_id"), issue(o.where(bad_life), "occurrence_lifecycle_invalid", "occurrence_id"),
        issue(o.where(life == "active").join(archived, "node_id", "left_semi"), "active_occurrence_archived_node", "occurrence_id"), issue(lost_members(o, "occurrence_id", "evidence_anchor_ids", e, "anchor_id"), "occurrence_evidence_missing", "occurrence_id"),
        issue(r.where(~F.col("relation_family").isin(*vocab.RELATION_FAMILIES)), "relation_family_invalid", "relation_id"), issue(lost(ends, "node_id", n, "node_id"), "relation_endpoint_missing", "relation_id"),
        issue(r.where(bad_life), "relation_lifecycle_invalid", "relation_id"), issue(r.where(bad_status), "relation_review_status_invalid", "relation_id"),
        issue(ends.where(life == "active").join(archived, "node_id", "left_semi"), "active_relation_archived_endpoint", "relation_id"),
        issue(dealt(r.select(*facts, "ord", "relation_id"), *facts).withColumn("k", F.row_number().over(fact)).where("k > 1"), "duplicate_relation_fact", "relation_id"), issue(lost_members(r, "relation_id", "occurrence_ids", o, "occurrence_id"), "relation_occurrence_missing", "relation_id"),
        issue(r.where("relation_family = 'structure' and relation_type <> 'contains'"), "structure_relation_type_invalid", "relation_id"), issue(scoped.where("relation_family = 'structure' and not (a and b)"), "structure_endpoint_role_invalid", "relation_id"),
        issue(structure.groupBy("target_id").agg(F.count_distinct("source_id").alias("k")).where("k > 1"), "structure_multiple_parents", "target_id"), issue(hierarchy.cycle_members(single), "structure_cycle", "node_id"),
        issue(r.where("relation_family = 'membership' and relation_type <> 'contains'"), "membership_relation_type_invalid", "relation_id"), issue(scoped.where("relation_family = 'membership' and not a"), "membership_scope_missing", "relation_id"), issue(scoped.where("relation_family = 'membership' and b"), "membership_target_is_scope", "relation_id"),
        issue(lost_members(p, "profile_id", "node_ids", n, "node_id"), "profile_node_missing", "profile_id"), issue(lost_members(p, "profile_id", "relation_ids", r, "relation_id"), "profile_relation_missing", "profile_id"), issue(lost_members(p, "profile_id", "membership_ids", r, "relation_id"), "profile_membership_missing", "profile_id"),
    )
    return dealt(issues, "code", "object_id").distinct()


def draft_issues(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Quality of a draft graph.

    nodes: (node_id, display_name, node_type, parent_id, review_status, evidence); edges:
    (source_id, target_id, relation_type, review_status, evidence).
    """
    eid = F.concat_ws("--", "source_id", "relation_type", "target_id")
    ok, good = nodes.where("review_status = 'accepted'"), edges.where("review_status = 'accepted'")
    whole = good.where("source_id <> '' and target_id <> '' and relation_type <> ''")
    ends = whole.where("source_id <> target_id").select("*", F.explode(F.array("source_id", "target_id")).alias("end"))
    state = nodes.select(F.col("node_id").alias("end"), F.col("review_status").alias("end_status"))
    outside = ends.join(state, "end").where("end_status <> 'accepted'")
    touched = good.select(F.explode(F.array("source_id", "target_id")).alias("node_id")).distinct()
    parents = nodes.select(F.col("node_id").alias("parent_id"), F.col("review_status").alias("parent_status"), F.col("node_type").alias("parent_type"))
    children = ok.where(F.col("node_type") != "container").select("node_id", "parent_id").where("parent_id <> ''")
    inside = good.where(F.col("relation_type").isin(*vocab.BACKBONE)).join(children.select(F.col("node_id").alias("source_id"), F.col("parent_id").alias("pa")), "source_id").join(children.select(F.col("node_id").alias("target_id"), F.col("parent_id").alias("pb")), "target_id").where("pa = pb").groupBy("pa").agg(F.count(F.lit(1)).alias("k"))
    owned = ok.where("parent_id <> ''").join(ok.select(F.col("node_id").alias("parent_id")), "parent_id", "left_semi")
    contains = good.where("relation_type = 'contains'").select(F.col("source_id").alias("parent_id"), F.col("target_id").alias("node_id")).distinct()
    learning = whole.where(F.col("relation_type").isin(*vocab.BACKBONE)).select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    crowded = children.groupBy("parent_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").join(inside.withColumnRenamed("pa", "parent_id"), "parent_id", "left").where("coalesce(k, 0) = 0")
    return report(
        issue(nodes.where("review_status = 'pending'"), "node_pending_review", "node_id", "warning"), issue(nodes.where("review_status = 'needs_revision'"), "node_needs_revision", "node_id", "warning"),
        issue(edges.where("review_status = 'pending'"), "edge_pending_review", eid, "warning"), issue(edges.where("review_status = 'needs_revision'"), "edge_needs_revision", eid, "warning"),
        issue(ok.where("trim(display_name) = ''"), "node_missing_name", "node_id"), issue(ok.where("evidence = ''"), "node_missing_evidence", "node_id", "warning"),
        issue(good.groupBy("source_id", "relation_type", "target_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "duplicate_edge", eid, "warning"),
        issue(good.where("source_id = '' or target_id = '' or relation_type = ''"), "edge_incomplete", eid), issue(whole.where("source_id = target_id"), "edge_self_loop", eid),
        issue(dangling(ends, "end", nodes, "node_id"), "edge_endpoint_missing", eid), issue(outside.where("relation_type = 'contains'"), "edge_endpoint_not_accepted", eid), issue(outside.where("relation_type <> 'contains'"), "edge_endpoint_not_accepted", eid, "warning"),
        issue(whole.where("relation_type <> 'contains' and evidence = ''"), "edge_missing_evidence", eid, "warning"), issue(ok.join(parents, "parent_id").where("parent_status <> 'accepted'"), "structure_parent_not_accepted", "node_id"),
        issue(ok.where("trim(display_name) <> ''").groupBy(F.trim("display_name").alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "duplicate_node_name", "name", "warning"),
        issue(ok.join(touched, "node_id", "left_anti"), "isolated_node", "node_id", "warning"), issue(crowded, "chapter_main_path_missing", "parent_id", "info"),
        issue(owned.join(contains, ["parent_id", "node_id"], "left_anti"), "structure_relation_not_accepted", "node_id"), issue(learning_cycles(learning), "learning_path_cycle", "cycle_id", "warning"),
        issue(ok.agg(F.count(F.lit(1)).alias("n")).where("n = 0"), "no_accepted_nodes", F.lit("")),
    ).distinct()


def learning_cycles(edges: DataFrame) -> DataFrame:
    """(cycle_id, members): groups of two nodes or more that lead to each other over edges (a, b), named by their smallest member."""
    nodes = edges.select(F.col("a").alias("node_id")).union(edges.select("b")).distinct()
    return graph.strong_components(nodes, edges).groupBy(F.col("scc").alias("cycle_id")).agg(F.count(F.lit(1)).alias("members")).where("members > 1")


def first_cycles(cycles: DataFrame, keep: int = 10) -> DataFrame:
    """The first ``keep`` of ``learning_cycles``, for a report."""
    return cycles.orderBy("cycle_id").limit(keep)


def rollup(issues: DataFrame) -> DataFrame:
    """(severity, code, n), errors first."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return issues.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n")).orderBy(rank, "code")


def dimension(code: Column) -> Column:
    return F.when(code.startswith("structure_") | code.startswith("scope_"), "structure").when(code.startswith("membership_") | code.startswith("occurrence_"), "membership").otherwise("integrity")


def document_quality(doc: dict[str, DataFrame], ledger: DataFrame, projection_issues: DataFrame) -> DataFrame:
    """(dimension, severity, code, object_id): integrity by dimension, relations that no one resolved, memberships that are missing or several, relations that the projection doesn't show."""
    r, n, s = doc["relations"], doc["nodes"], doc["scopes"]
    live = r.where("lifecycle_state = 'active' and review_status <> 'rejected'")
    count = live.where("relation_family = 'membership'").groupBy(F.col("target_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))
    single = n.where("lifecycle_state = 'active'").join(s.select(F.col("scope_id").alias("node_id")), "node_id", "left_anti").join(count, "node_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    shown = lambda df, d: df.select(F.lit(d).alias("dimension"), "severity", "code", "object_id")
    broken = document_issues(doc)
    return report(
        broken.select(dimension(F.col("code")).alias("dimension"), "severity", "code", "object_id"),
        shown(issue(live.where("relation_family = 'unresolved'"), "unresolved_legacy_relation", "relation_id", "warning"), "semantic"),
        shown(issue(single.where("n = 0"), "membership_missing", "node_id", "warning"), "membership"), shown(issue(single.where("n > 1"), "multiple_memberships", "node_id", "warning"), "membership"),
        shown(issue(dangling(r.where("lifecycle_state = 'active'"), "relation_id", ledger, "relation_id"), "relation_representation_missing", "relation_id"), "displayability"),
        shown(projection_issues.select("code", F.lit("warning").alias("severity"), "object_id"), "displayability"),
    )
