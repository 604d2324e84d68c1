"""Publishing the accepted part of a review document: what is chosen, what stands against it, and whether a plan still holds."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .hierarchy import upward
from .rules import dangling, document_issues, issue, report

PROTOCOL, CAPABILITY_VERSION = "p4", "1"


@dataclass(frozen=True)
class Capability:
    """What a target can carry."""

    supported: tuple[str, ...]
    protocol: str = PROTOCOL
    version: str = CAPABILITY_VERSION


@dataclass(frozen=True)
class Profile:
    """What is asked for: choices (node_id, relation_id) are confirmed primary memberships; without nodes (node_id) or relations (relation_id) all accepted ones are meant."""

    choices: DataFrame
    nodes: DataFrame | None = None
    relations: DataFrame | None = None
    protocol: str = PROTOCOL
    profile_id: str = "default"


@dataclass(frozen=True)
class Plan:
    """issues (code, severity, object_id); nodes (node_id) and relations (relation_id) to publish; memberships (node_id, relation_id, scope_id); ancestors (node_id); counts: one row."""

    issues: DataFrame
    nodes: DataFrame
    relations: DataFrame
    memberships: DataFrame
    ancestors: DataFrame
    counts: DataFrame
    extra: dict = field(default_factory=dict)


def preflight(doc: dict[str, DataFrame], profile: Profile, capability: Capability, check_integrity: bool = False) -> Plan:
    """The plan for a document.

    doc: nodes (node_id, lifecycle_state, review_status), scopes (scope_id, lifecycle_state),
    relations (relation_id, relation_family, source_id, target_id, relation_type,
    lifecycle_state, review_status, ord), occurrences; with ``check_integrity`` all that
    ``rules.document_issues`` takes. An accepted relation that is named brings its ends along.
    Of several accepted structure relations of a scope the last by ord leads upward.
    """
    active = lambda df: df.where("lifecycle_state = 'active'")
    nodes = active(doc["nodes"]).select("node_id", "review_status")
    boxes = active(doc["scopes"]).select(F.col("scope_id").alias("node_id")).join(nodes.select("node_id"), "node_id", "left_semi")
    relations = active(doc["relations"])
    good = relations.where("review_status = 'accepted'")
    ok = nodes.where("review_status = 'accepted'").select("node_id")
    knowledge = ok.join(boxes, "node_id", "left_anti")

    issues = [issue(dangling(profile.nodes, "node_id", nodes, "node_id"), "selected_node_missing", "node_id"), issue(nodes.where("review_status <> 'accepted'").join(profile.nodes, "node_id", "left_semi"), "selected_node_not_accepted", "node_id")] if profile.nodes is not None else []
    picked = good
    if profile.relations is not None:
        issues.append(issue(dangling(profile.relations, "relation_id", relations, "relation_id"), "selected_relation_missing", "relation_id"))
        picked = good.join(profile.relations.select("relation_id").distinct(), "relation_id", "left_semi")
    if check_integrity:
        issues.append(issue(document_issues(doc), "document_integrity_error", F.concat_ws(":", "code", "object_id")))
    if profile.protocol != capability.protocol:
        issues.append(issue(nodes.sparkSession.range(1), "target_protocol_unsupported", F.lit(profile.protocol)))

    ends = picked.where("relation_family in ('semantic', 'unresolved')").select("relation_id", F.explode(F.array("source_id", "target_id")).alias("node_id")).join(boxes, "node_id", "left_anti")
    issues.append(issue(ends.join(ok, "node_id", "left_anti"), "accepted_relation_endpoint_not_accepted", "relation_id"))
    chosen = knowledge
    if profile.nodes is not None:
        chosen = knowledge.join(profile.nodes, "node_id", "left_semi")
        if profile.relations is not None:
            chosen = chosen.unionByName(ends.join(knowledge, "node_id", "left_semi").select("node_id")).distinct()
    chosen = stored(chosen, "chosen")
    issues.append(issue(chosen.agg(F.count(F.lit(1)).alias("n")).where("n = 0"), "no_accepted_nodes", F.lit("")))

    members = good.where("relation_family = 'membership'").select(F.col("target_id").alias("node_id"), "relation_id", F.col("source_id").alias("scope_id"))
    inside = members.join(boxes.withColumnRenamed("node_id", "scope_id"), "scope_id", "left_semi")
    asked = chosen.join(profile.choices.select("node_id", F.col("relation_id").alias("asked_id")), "node_id", "left")
    valid = asked.join(inside.withColumnRenamed("relation_id", "asked_id"), ["node_id", "asked_id"]).select("node_id", F.col("asked_id").alias("relation_id"), "scope_id")
    options = asked.where("asked_id is null").join(inside.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")), "node_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    issues += [
        issue(asked.where("asked_id is not null").join(valid.select("node_id"), "node_id", "left_anti"), "primary_membership_invalid", "node_id"),
        issue(options.where("n = 1"), "primary_membership_confirmation_required", "node_id"),
        issue(options.where("n > 1"), "primary_membership_required", "node_id"),
        issue(options.where("n = 0"), "accepted_membership_missing", "node_id"),
    ]

    above = good.where("relation_family = 'structure'").groupBy(F.col("target_id").alias("child")).agg(F.max_by("source_id", F.struct("ord", "relation_id")).alias("parent"))
    ancestors = upward(valid.select(F.col("scope_id").alias("node_id")).distinct(), above)
    issues.append(issue(dangling(ancestors, "node_id", ok, "node_id"), "required_scope_not_accepted", "node_id"))

    inner = picked.where("relation_family = 'semantic'").join(chosen.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi").join(chosen.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi")
    carried = F.col("relation_type").isin(*capability.supported)
    issues += [issue(picked.where("relation_family = 'unresolved'"), "unresolved_relation_not_publishable", "relation_id"), issue(inner.where(~carried), "relation_type_unsupported", "relation_id")]
    edges = inner.where(carried).select("relation_id")

    of = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
    spare = members.join(chosen, "node_id", "left_semi").groupBy("node_id").agg(F.count(F.lit(1)).alias("k")).agg(F.coalesce(F.sum(F.greatest(F.col("k") - 1, F.lit(0))), F.lit(0)).alias("n"))
    counts = (
        of(nodes.where("review_status <> 'accepted'"), "nodes_not_accepted").union(of(relations.where("review_status <> 'accepted'"), "relations_not_accepted"))
        .union(of(chosen, "selected_knowledge_nodes")).union(of(edges, "selected_semantic_relations"))
        .union(spare.select(F.lit("secondary_memberships_omitted"), "n")).union(of(doc["occurrences"], "occurrences_omitted"))
    )
    return Plan(report(*issues).distinct(), chosen, edges, valid, ancestors, counts)


def gate(issues: DataFrame) -> DataFrame:
    """(status): ready without issues, needs_decision if all are open membership choices, otherwise blocked."""
    decision = F.col("code").isin("primary_membership_required", "primary_membership_confirmation_required")
    return issues.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.min(decision), F.lit(True)).alias("d")).select(F.when(F.col("n") == 0, "ready").when(F.col("d"), "needs_decision").otherwise("blocked").alias("status"))


def _digest(*cols: str) -> list[Column]:
    """Sums of four pieces of each row's hash: equal for equal sets of rows in any order."""
    h = F.sha2(F.concat_ws("\u001f", *cols), 256)
    return [F.coalesce(F.sum(F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")), F.lit(0)).alias(f"p{i}") for i in range(4)]


def plan_identity(plan: Plan, document: DataFrame, profile: Profile, capability: Capability) -> DataFrame:
    """(plan_id, document_id, revision, business_fingerprint, profile_fingerprint, capability_version) of a plan.

    document: one row (document_id, revision, business_fingerprint). Rows are hashed and added up,
    so the id takes no sorted list of what is chosen.
    """
    rows = lambda df, kind, *cols: df.select(F.lit(kind).alias("kind"), F.concat_ws("\u001f", *cols).alias("row"))
    asked = rows(profile.choices, "choice", "node_id", "relation_id")
    for df, kind, col in ((profile.nodes, "node", "node_id"), (profile.relations, "relation", "relation_id")):
        asked = asked if df is None else asked.unionByName(rows(df, kind, col))
    chosen = rows(plan.nodes, "node", "node_id").unionByName(rows(plan.relations, "relation", "relation_id")).unionByName(rows(plan.memberships, "membership", "node_id", "relation_id"))
    text = lambda *cols: F.sha2(F.concat_ws("|", *(c if isinstance(c, Column) else F.col(c).cast("string") for c in cols)), 256)
    whole = lambda df: df.agg(*_digest("kind", "row")).select(text("p0", "p1", "p2", "p3").alias("h")).scalar()
    out = document.select("document_id", "revision", "business_fingerprint", text(F.lit(profile.profile_id), F.lit(profile.protocol), whole(asked)).alias("profile_fingerprint"), F.lit(capability.version).alias("capability_version"), whole(chosen).alias("chosen"))
    plan_id = F.concat(F.lit("plan_"), F.substring(text("document_id", "revision", "business_fingerprint", "profile_fingerprint", "capability_version", "chosen"), 1, 24))
    return out.select(plan_id.alias("plan_id"), *(c for c in out.columns if c != "chosen"))


def stale_parts(planned: DataFrame, current: DataFrame) -> DataFrame:
    """(part): what has changed between the identity a plan was made with and the present one (both of ``plan_identity``); none: the plan holds."""
    parts = ("document_id", "revision", "business_fingerprint", "profile_fingerprint", "capability_version")
    fields = lambda df, name: df.select(F.explode(F.array(*(F.struct(F.lit(p).alias("part"), F.col(p).cast("string").alias(name)) for p in parts))).alias("f")).select("f.*")
    return fields(planned, "then").join(fields(current, "now"), "part", "full").where(~F.col("then").eqNullSafe(F.col("now"))).select("part")
