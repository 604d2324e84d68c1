"""Queries over review documents: integrity, quality, merges, sessions, projections, publishing and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import layout as L
from ..operators import merge as M
from ..operators import projection as V
from ..operators import publishing as B
from ..operators import rules as R
from ..operators import session as S
from ..sources import adapters as A
from ..streaming import events as E


def _ident(prefix: str, c) -> F.Column:
    return F.concat(F.lit(prefix), c.cast("string"))


def _document(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Nations as scopes, suppliers as nodes; orders' lines between suppliers as semantic relations. Faults come by remainders."""
    n, s = A.table(spark, d, "nation"), A.table(spark, d, "supplier")
    k, nk = F.col("s_suppkey"), F.col("n_nationkey")
    nodes = n.select(_ident("n", nk).alias("node_id"), F.when(nk % 11 == 5, "archived").otherwise("active").alias("lifecycle_state"), F.when(nk % 7 == 3, "pending").otherwise("accepted").alias("review_status")).unionByName(
        s.select(_ident("s", k).alias("node_id"), F.when(k % 13 == 4, "archived").when(k % 29 == 7, "lost").otherwise("active").alias("lifecycle_state"), F.when(k % 5 == 0, "pending").when(k % 31 == 9, "odd").otherwise("accepted").alias("review_status"))
    )
    scopes = n.select(_ident("n", nk).alias("scope_id"), F.when(nk == 9, "volume").when(nk % 2 == 0, "chapter").otherwise("section").alias("structural_role"), F.lit("active").alias("lifecycle_state"), F.lit("accepted").alias("review_status"))
    member = s.select(_ident("m", k).alias("relation_id"), F.lit("membership").alias("relation_family"), _ident("n", F.col("s_nationkey") + F.when(k % 17 == 2, 40).otherwise(0)).alias("source_id"), _ident("s", k).alias("target_id"), F.lit("contains").alias("relation_type"), k.alias("ord"))
    second = s.where(k % 9 == 0).select(_ident("q", k).alias("relation_id"), F.lit("membership").alias("relation_family"), _ident("n", (F.col("s_nationkey") + 1) % 25).alias("source_id"), _ident("s", k).alias("target_id"), F.lit("contains").alias("relation_type"), (k + 100_000).alias("ord"))
    structure = n.where(nk >= 5).select(_ident("t", nk).alias("relation_id"), F.lit("structure").alias("relation_family"), _ident("n", nk % 5).alias("source_id"), _ident("n", nk).alias("target_id"), F.when(nk == 17, "explains").otherwise("contains").alias("relation_type"), (nk + 200_000).cast("bigint").alias("ord"))
    twice = n.where(nk == 20).select(F.lit("t99").alias("relation_id"), F.lit("structure").alias("relation_family"), F.lit("n3").alias("source_id"), _ident("n", nk).alias("target_id"), F.lit("contains").alias("relation_type"), F.lit(300_000).cast("bigint").alias("ord"))
    ring = n.where(nk == 6).select(F.lit("t98").alias("relation_id"), F.lit("structure").alias("relation_family"), F.lit("n6").alias("source_id"), F.lit("n1").alias("target_id"), F.lit("contains").alias("relation_type"), F.lit(300_003).cast("bigint").alias("ord"))
    line = A.table(spark, d, "lineitem")
    semantic = line.select(F.concat_ws("#", F.lit("x"), "l_orderkey", "l_linenumber", "l_partkey").alias("relation_id"), F.when(F.col("l_linenumber") == 7, "unresolved").otherwise("semantic").alias("relation_family"), _ident("s", F.col("l_suppkey")).alias("source_id"), _ident("s", F.col("l_partkey") % 104).alias("target_id"), F.when(F.col("l_returnflag") == "A", "prerequisite").when(F.col("l_returnflag") == "R", "contrast").otherwise("related_to").alias("relation_type"), (F.col("l_orderkey") * 10 + F.col("l_linenumber") + 1_000_000).alias("ord"))
    relations = member.unionByName(second).unionByName(structure).unionByName(twice).unionByName(ring).unionByName(semantic)
    relations = relations.withColumn("lifecycle_state", F.when(F.col("ord") % 23 == 1, "archived").otherwise("active")).withColumn("review_status", F.when(F.col("ord") % 6 == 1, "rejected").when(F.col("ord") % 6 == 2, "pending").otherwise("accepted")).withColumn("occurrence_ids", F.array(_ident("o", F.col("ord") % 120)))
    occurrences = s.select(_ident("o", k).alias("occurrence_id"), _ident("s", k + F.when(k % 19 == 3, 500).otherwise(0)).alias("node_id"), F.lit("active").alias("lifecycle_state"), F.array(_ident("e", k % 33 + F.when(k % 13 == 5, 1_000_000_000).otherwise(0))).alias("evidence_anchor_ids"))
    evidence = A.table(spark, d, "benchmark").select(_ident("e", F.col("item_id")).alias("anchor_id"))
    profiles = A.table(spark, d, "region").select(_ident("p", F.col("r_regionkey")).alias("profile_id"), F.array(_ident("s", F.col("r_regionkey") * 30)).alias("node_ids"), F.array(_ident("m", F.col("r_regionkey"))).alias("relation_ids"), F.array(F.lit("m1")).alias("membership_ids"))
    meta = A.table(spark, d, "region").where("r_regionkey < 2").select((F.col("r_regionkey") + 1).alias("schema_version"), F.when(F.col("r_regionkey") == 1, "").otherwise("doc").alias("document_id"))
    return {"nodes": nodes, "scopes": scopes, "relations": relations, "occurrences": occurrences, "evidence": evidence, "profiles": profiles, "meta": meta}


def integrity_report(spark: SparkSession, d: str) -> DataFrame:
    return R.document_issues(_document(spark, d)).select("code", "object_id")


def document_quality(spark: SparkSession, d: str) -> DataFrame:
    doc = _document(spark, d)
    live = doc["nodes"].where("lifecycle_state = 'active'")
    issues = V.projection_issues(live, doc["scopes"], doc["relations"])
    return R.document_quality(doc, V.ledger(doc["relations"], live), issues).groupBy("dimension", "severity", "code").agg(F.count(F.lit(1)).alias("n"))


def projection_ledger(spark: SparkSession, d: str) -> DataFrame:
    doc = _document(spark, d)
    return V.ledger(doc["relations"], doc["nodes"].where("lifecycle_state = 'active'")).groupBy("representation").agg(F.count(F.lit(1)).alias("n"))


def projection_issues(spark: SparkSession, d: str) -> DataFrame:
    doc = _document(spark, d)
    return V.projection_issues(doc["nodes"].where("lifecycle_state = 'active'"), doc["scopes"], doc["relations"])


def _choices(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "supplier").where("s_suppkey % 4 = 1").select(_ident("s", F.col("s_suppkey")).alias("node_id"), _ident("m", F.col("s_suppkey")).alias("relation_id"))


def _plan(spark: SparkSession, d: str) -> B.Plan:
    return B.preflight(_document(spark, d), B.Profile(_choices(spark, d)), B.Capability(("prerequisite", "progressive", "derives_to", "explains")))


def publish_preflight(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d).issues.select("code", "object_id")


def publish_counts(spark: SparkSession, d: str) -> DataFrame:
    """What a plan holds and what it leaves out."""
    return _plan(spark, d).counts


def publish_ancestors(spark: SparkSession, d: str) -> DataFrame:
    """Scopes that the chosen memberships need, with all above them."""
    return _plan(spark, d).ancestors


def publish_status(spark: SparkSession, d: str) -> DataFrame:
    """Decisions that are open in a document whose relations are all in order, for each target."""
    doc = _document(spark, d)
    ends = B.preflight(doc, B.Profile(_choices(spark, d)), B.Capability(("prerequisite", "contrast", "related_to"))).issues
    open_ = ends.where("code in ('primary_membership_required', 'primary_membership_confirmation_required')")
    return B.gate(ends).select(F.lit("all").alias("issues"), "status").unionByName(B.gate(open_).select(F.lit("choices").alias("issues"), "status")).unionByName(B.gate(ends.where("code = 'none'")).select(F.lit("none").alias("issues"), "status"))


def publish_selection(spark: SparkSession, d: str) -> DataFrame:
    """A plan for named nodes and relations, some of which are missing, pending or archived, of a document with faults, for another protocol."""
    s = A.table(spark, d, "supplier")
    wanted = s.where("s_suppkey % 3 = 0").select(_ident("s", F.col("s_suppkey") + F.when(F.col("s_suppkey") % 27 == 0, 9000).otherwise(0)).alias("node_id"))
    named = s.where("s_suppkey % 2 = 0").select(_ident("m", F.col("s_suppkey") + F.when(F.col("s_suppkey") % 22 == 0, 9000).otherwise(0)).alias("relation_id"))
    profile = B.Profile(_choices(spark, d), wanted, named, protocol="other")
    return B.preflight(_document(spark, d), profile, B.Capability(("prerequisite",)), check_integrity=True).issues.select("code", "object_id")


def membership_status(spark: SparkSession, d: str) -> DataFrame:
    r = _document(spark, d)["relations"].where("relation_family = 'membership'")
    return V.membership_status(r.select(F.col("target_id").alias("node_id"), "review_status"))


def hidden_cards(spark: SparkSession, d: str) -> DataFrame:
    """How relations show in a view in which every fifth supplier's card is hidden."""
    doc = _document(spark, d)
    cards = doc["nodes"].select(F.concat(F.lit("node:"), "node_id").alias("view_id"), "node_id")
    links = doc["relations"].where("relation_family = 'semantic'").select("relation_id", F.concat(F.lit("node:"), "source_id").alias("source_view"), F.concat(F.lit("node:"), "target_id").alias("target_view"), "review_status")
    hidden = A.table(spark, d, "supplier").where("s_suppkey % 5 = 0").select(_ident("node:s", F.col("s_suppkey")).alias("view_id"))
    _, _, ledger = V.shown(cards, links, hidden)
    return ledger.groupBy("representation").agg(F.count(F.lit(1)).alias("n"))


def membership_choice(spark: SparkSession, d: str) -> DataFrame:
    """Cards of suppliers: one for each membership, further ones as references."""
    doc = _document(spark, d)
    members = doc["relations"].where("relation_family = 'membership'").select("relation_id", F.col("source_id").alias("scope_id"), F.col("target_id").alias("node_id"))
    return V.instances(doc["nodes"].where("node_id like 's%'"), members).withColumn("nth", F.col("nth").cast("long"))


def quality_report(spark: SparkSession, d: str) -> DataFrame:
    s = A.table(spark, d, "supplier")
    k = F.col("s_suppkey")
    nodes = s.select(_ident("s", k).alias("node_id"), F.when(k % 37 == 1, " ").otherwise(_ident("name ", k % 60)).alias("display_name"), F.when(k < 10, "container").otherwise("concept").alias("node_type"), F.when(k >= 10, _ident("s", k % 10)).otherwise("").alias("parent_id"), F.when(k % 8 == 2, "pending").when(k % 8 == 3, "needs_revision").otherwise("accepted").alias("review_status"), F.when(k % 6 == 5, "").otherwise("text").alias("evidence"))
    line = A.table(spark, d, "lineitem")
    edges = line.select(_ident("s", F.col("l_suppkey")).alias("source_id"), F.when(F.col("l_linenumber") == 6, "").otherwise(_ident("s", F.col("l_partkey") % 103)).alias("target_id"), F.when(F.col("l_returnflag") == "A", "prerequisite").when(F.col("l_returnflag") == "R", "contains").otherwise("explains").alias("relation_type"), F.when(F.col("l_linestatus") == "F", "accepted").when(F.col("l_linenumber") % 2 == 0, "pending").otherwise("needs_revision").alias("review_status"), F.when(F.col("l_linenumber") == 3, "").otherwise("said").alias("evidence"))
    return R.draft_issues(nodes, edges)


def quality_rollup(spark: SparkSession, d: str) -> DataFrame:
    return R.rollup(quality_report(spark, d))


def _trio(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = A.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.round("o_totalprice", 0).cast("long").cast("string").alias("price"))
    k = F.col("o_orderkey")
    change = lambda df, m, r: df.withColumn("o_orderstatus", F.when(k % m == r, "P!").otherwise(F.col("o_orderstatus"))).withColumn("price", F.when(k % m == r + 1, F.concat("price", F.lit(str(m)))).otherwise(F.col("price")))
    wide = lambda df: M.fields(df, "order", "o_orderkey", ["o_orderstatus", "o_orderpriority", "price"])
    return wide(o.where(k % 50 != 7)), wide(change(o.where(k % 50 != 9), 10, 2)), wide(change(o.where(k % 50 != 11), 15, 2))


def three_way_merge(spark: SparkSession, d: str) -> DataFrame:
    return M.plan(*_trio(spark, d)).select("object_id", "field_name", "base", "local", "remote", "outcome")


def merge_outcomes(spark: SparkSession, d: str) -> DataFrame:
    base, local, remote = _trio(spark, d)
    plan = M.resolved(M.plan(base, local, remote), use_remote=True)
    return M.applied(local, plan, content=("price",), status_field="o_orderstatus").groupBy("field_name", "value").agg(F.count(F.lit(1)).alias("n")).where("field_name = 'o_orderstatus'")


def field_baseline_hash(spark: SparkSession, d: str) -> DataFrame:
    return M.checked(M.baseline(_trio(spark, d)[0], "export", 3)).select("object_id", "field_name", "base_revision", "field_sha256")


def document_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Whether documents say the same: one dealt out anew, one whose numbers have other spaces around them, and one with a changed field, against the first."""
    base, local, _ = _trio(spark, d)
    own = M.fingerprint(base).scalar()
    cases = {"dealt_anew": base.repartition(7, "value"), "spaced": base.withColumn("value", F.when(F.col("field_name") == "price", F.concat(F.lit(" "), "value", F.lit("  "))).otherwise(F.col("value"))), "changed": local}
    rows = [M.fingerprint(v).select(F.lit(k).alias("document"), (F.col("fingerprint") == own).alias("same")) for k, v in cases.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def _log(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "events")
    return e.select(F.col("user_id").alias("document_id"), F.col("ts").alias("at"), F.col("event_id").alias("command_id"), F.col("event_type").alias("action"), F.when(F.col("event_type") != "error", F.round("value", 2).cast("string")).alias("value"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 40).alias("expected_revision"), (F.col("event_id") % 4).cast("string").alias("object_id"))


def command_log_fold(spark: SparkSession, d: str) -> DataFrame:
    return S.folded(_log(spark, d)).select("document_id", "command_id", F.col("revision").cast("long").alias("revision"), "value_after")


def stale_commands(spark: SparkSession, d: str) -> DataFrame:
    return S.stale(_log(spark, d))


def undo_state(spark: SparkSession, d: str) -> DataFrame:
    return S.as_of(_log(spark, d), 25)


def command_history(spark: SparkSession, d: str) -> DataFrame:
    return S.history(_log(spark, d)).select("document_id", "command_id", F.col("steps_back").cast("long").alias("steps_back"))


def command_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Whether commands name a record and a field that may be edited, at the revision that they expect."""
    kinds = F.array(*(F.lit(x) for x in ("node", "relation", "scope", "chapter")))
    names = F.array(*(F.lit(x) for x in ("review_status", "node_type", "confidence")))
    e = A.table(spark, d, "events").select("event_id", F.element_at(kinds, (F.col("event_id") % 4 + 1).cast("int")).alias("record_type"), F.element_at(names, (F.col("event_id") % 3 + 1).cast("int")).alias("field_name"), F.when(F.col("event_id") % 5 == 0, F.col("event_id") % 10).alias("expected_revision"), F.lit(5).alias("revision_before"))
    return S.checked_commands(e).groupBy("record_type", "field_name", "verdict").agg(F.count(F.lit(1)).alias("n"))


def bulk_accept(spark: SparkSession, d: str) -> DataFrame:
    raw = F.create_map(*(F.lit(x) for kv in A.RAW_STATUSES.items() for x in kv))
    o = A.table(spark, d, "orders").select("o_orderkey", "o_orderpriority", T.review_status(raw[F.col("o_orderstatus")]).alias("review_status"))
    return S.accepted(o, o.where("o_orderkey % 3 = 0").select("o_orderkey"), "o_orderkey").groupBy("o_orderpriority", "review_status").agg(F.count(F.lit(1)).alias("n"))


def archive_cascade(spark: SparkSession, d: str) -> DataFrame:
    doc = _document(spark, d)
    chosen = A.table(spark, d, "supplier").where("s_suppkey % 6 = 1").select(_ident("s", F.col("s_suppkey")).alias("node_id"))
    zero = lambda df: df.withColumn("revision", F.lit(1))
    out = S.archived(zero(doc["nodes"]), zero(doc["relations"]), zero(doc["scopes"]), doc["occurrences"].withColumn("revision", F.lit(1)), chosen)
    return out["nodes"].select(F.lit("node").alias("kind"), "lifecycle_state", "revision").union(out["relations"].select(F.lit("relation"), "lifecycle_state", "revision")).union(out["occurrences"].select(F.lit("occurrence"), "lifecycle_state", "revision")).groupBy("kind", "lifecycle_state", "revision").agg(F.count(F.lit(1)).alias("n"))


def view_states(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "events")
    state = e.where("event_id < 1000").groupBy("user_id", "event_type").agg(F.max("value").alias("value")).withColumn("event_id", F.lit(-1).cast("bigint"))
    changes = e.where("event_id >= 1000").select("user_id", "event_type", "value", "event_id")
    return S.upserted(state.select("user_id", "event_type", "value", "event_id"), changes, ["user_id", "event_type"], "event_id")


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return E.windowed(A.table(spark, d, "events")).select("window_start", "event_type", "n", F.round("total", 6).alias("total"))


def event_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return L.percentile(A.table(spark, d, "events"), "event_type", "value", 0.95)


def streamed_event_windows(spark: SparkSession, d: str) -> DataFrame:
    """The same windows from a stream that is read to its end."""
    return E.drained(spark, f"{d}/events.parquet").select("window_start", "event_type", "n", F.round("total", 6).alias("total"))


QUERIES = {f.__name__: f for f in (integrity_report, document_quality, projection_ledger, projection_issues, publish_preflight, publish_status, membership_choice, quality_report, quality_rollup, three_way_merge, merge_outcomes, field_baseline_hash, document_fingerprint, command_log_fold, stale_commands, undo_state, command_history, bulk_accept, archive_cascade, publish_counts, publish_ancestors, publish_selection, membership_status, hidden_cards, command_verdicts, event_percentiles, view_states, event_windows, streamed_event_windows)}

DOCUMENT_SQL = r"""
  nodes AS (SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS node_id, CASE WHEN n_nationkey % 11 = 5 THEN 'archived' ELSE 'active' END AS lifecycle_state, CASE WHEN n_nationkey % 7 = 3 THEN 'pending' ELSE 'accepted' END AS review_status FROM nation
    UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR), CASE WHEN s_suppkey % 13 = 4 THEN 'archived' WHEN s_suppkey % 29 = 7 THEN 'lost' ELSE 'active' END, CASE WHEN s_suppkey % 5 = 0 THEN 'pending' WHEN s_suppkey % 31 = 9 THEN 'odd' ELSE 'accepted' END FROM supplier),
  scopes AS (SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS scope_id, CASE WHEN n_nationkey = 9 THEN 'volume' WHEN n_nationkey % 2 = 0 THEN 'chapter' ELSE 'section' END AS structural_role FROM nation),
  facts AS (
    SELECT 'm' || CAST(s_suppkey AS VARCHAR) AS relation_id, 'membership' AS relation_family, 'n' || CAST(s_nationkey + CASE WHEN s_suppkey % 17 = 2 THEN 40 ELSE 0 END AS VARCHAR) AS source_id, 's' || CAST(s_suppkey AS VARCHAR) AS target_id, 'contains' AS relation_type, s_suppkey AS ord FROM supplier
    UNION ALL SELECT 'q' || CAST(s_suppkey AS VARCHAR), 'membership', 'n' || CAST((s_nationkey + 1) % 25 AS VARCHAR), 's' || CAST(s_suppkey AS VARCHAR), 'contains', s_suppkey + 100000 FROM supplier WHERE s_suppkey % 9 = 0
    UNION ALL SELECT 't' || CAST(n_nationkey AS VARCHAR), 'structure', 'n' || CAST(n_nationkey % 5 AS VARCHAR), 'n' || CAST(n_nationkey AS VARCHAR), CASE WHEN n_nationkey = 17 THEN 'explains' ELSE 'contains' END, n_nationkey + 200000 FROM nation WHERE n_nationkey >= 5
    UNION ALL SELECT 't99', 'structure', 'n3', 'n20', 'contains', 300000 FROM nation WHERE n_nationkey = 20
    UNION ALL SELECT 't98', 'structure', 'n6', 'n1', 'contains', 300003 FROM nation WHERE n_nationkey = 6
    UNION ALL SELECT 'x#' || CAST(l_orderkey AS VARCHAR) || '#' || CAST(l_linenumber AS VARCHAR) || '#' || CAST(l_partkey AS VARCHAR), CASE WHEN l_linenumber = 7 THEN 'unresolved' ELSE 'semantic' END, 's' || CAST(l_suppkey AS VARCHAR), 's' || CAST(l_partkey % 104 AS VARCHAR),
      CASE l_returnflag WHEN 'A' THEN 'prerequisite' WHEN 'R' THEN 'contrast' ELSE 'related_to' END, l_orderkey * 10 + l_linenumber + 1000000 FROM lineitem),
  relations AS (SELECT *, CASE WHEN ord % 23 = 1 THEN 'archived' ELSE 'active' END AS lifecycle_state, CASE ord % 6 WHEN 1 THEN 'rejected' WHEN 2 THEN 'pending' ELSE 'accepted' END AS review_status FROM facts),
  occurrences AS (SELECT 'o' || CAST(s_suppkey AS VARCHAR) AS occurrence_id, 's' || CAST(s_suppkey + CASE WHEN s_suppkey % 19 = 3 THEN 500 ELSE 0 END AS VARCHAR) AS node_id, s_suppkey % 33 + CASE WHEN s_suppkey % 13 = 5 THEN 1000000000 ELSE 0 END AS anchor FROM supplier),
  ends AS (SELECT relation_id, lifecycle_state, source_id AS node_id FROM relations UNION ALL SELECT relation_id, lifecycle_state, target_id FROM relations),
  lone AS (SELECT target_id AS child, min(source_id) AS parent FROM relations WHERE relation_family = 'structure' AND lifecycle_state = 'active' AND review_status <> 'rejected' GROUP BY target_id HAVING count(DISTINCT source_id) = 1),
  chase AS (SELECT child AS origin, parent AS place, 1 AS steps FROM lone UNION ALL SELECT origin, s.parent, steps + 1 FROM chase c JOIN lone s ON s.child = c.place WHERE c.place <> c.origin AND steps < 50),
  issues AS (
    SELECT 'schema_version_invalid' AS code, 'doc' AS object_id FROM region WHERE r_regionkey = 0 UNION SELECT 'document_id_missing', '' FROM region WHERE r_regionkey = 1
    UNION SELECT 'duplicate_relation_id', relation_id FROM relations GROUP BY relation_id HAVING count(*) > 1
    UNION SELECT 'node_lifecycle_invalid', node_id FROM nodes WHERE lifecycle_state = 'lost' UNION SELECT 'node_review_status_invalid', node_id FROM nodes WHERE review_status = 'odd'
    UNION SELECT 'scope_role_invalid', 'n9' UNION SELECT 'scope_node_lifecycle_mismatch', scope_id FROM scopes JOIN nodes ON node_id = scope_id WHERE lifecycle_state <> 'active'
    UNION SELECT 'occurrence_node_missing', occurrence_id FROM occurrences WHERE node_id NOT IN (SELECT node_id FROM nodes) UNION SELECT 'active_occurrence_archived_node', occurrence_id FROM occurrences o JOIN nodes n ON n.node_id = o.node_id WHERE n.lifecycle_state = 'archived'
    UNION SELECT 'occurrence_evidence_missing', occurrence_id FROM occurrences WHERE anchor NOT IN (SELECT item_id FROM benchmark)
    UNION SELECT 'relation_endpoint_missing', relation_id FROM ends WHERE node_id NOT IN (SELECT node_id FROM nodes)
    UNION SELECT 'active_relation_archived_endpoint', relation_id FROM ends e JOIN nodes n ON n.node_id = e.node_id WHERE e.lifecycle_state = 'active' AND n.lifecycle_state = 'archived'
    UNION SELECT 'duplicate_relation_fact', relation_id FROM (SELECT relation_id, row_number() OVER (PARTITION BY relation_family, source_id, relation_type, target_id ORDER BY ord, relation_id) AS k FROM relations) q WHERE k > 1
    UNION SELECT 'relation_occurrence_missing', relation_id FROM relations WHERE ord % 120 NOT IN (SELECT s_suppkey FROM supplier)
    UNION SELECT 'structure_relation_type_invalid', 't17' UNION SELECT 'structure_multiple_parents', target_id FROM relations WHERE relation_family = 'structure' AND lifecycle_state = 'active' AND review_status <> 'rejected' GROUP BY target_id HAVING count(DISTINCT source_id) > 1
    UNION SELECT 'structure_cycle', origin FROM chase WHERE place = origin
    UNION SELECT 'membership_scope_missing', relation_id FROM relations WHERE relation_family = 'membership' AND source_id NOT IN (SELECT scope_id FROM scopes)
    UNION SELECT 'profile_node_missing', 'p' || CAST(r_regionkey AS VARCHAR) FROM region WHERE r_regionkey * 30 NOT IN (SELECT s_suppkey FROM supplier)),
  live AS (SELECT * FROM relations WHERE lifecycle_state = 'active' AND review_status <> 'rejected'), shown AS (SELECT node_id FROM nodes WHERE lifecycle_state = 'active'),
  gaps AS (
    SELECT DISTINCT 'structure_projection_endpoint_missing' AS code, relation_id AS object_id FROM live WHERE relation_family = 'structure' AND (source_id NOT IN (SELECT scope_id FROM scopes) OR target_id NOT IN (SELECT scope_id FROM scopes))
    UNION ALL SELECT 'structure_projection_multiple_parents', target_id FROM live WHERE relation_family = 'structure' GROUP BY target_id HAVING count(DISTINCT source_id) > 1
    UNION ALL SELECT 'membership_projection_endpoint_missing', relation_id FROM live WHERE relation_family = 'membership' AND source_id NOT IN (SELECT scope_id FROM scopes)
    UNION ALL SELECT 'node_membership_unresolved', node_id FROM shown WHERE node_id NOT IN (SELECT scope_id FROM scopes) AND node_id NOT IN (SELECT target_id FROM live WHERE relation_family = 'membership' AND source_id IN (SELECT scope_id FROM scopes))
    UNION ALL SELECT DISTINCT 'semantic_projection_endpoint_missing', relation_id FROM live WHERE relation_family = 'semantic' AND (source_id NOT IN (SELECT node_id FROM shown) OR target_id NOT IN (SELECT node_id FROM shown)))"""
PUBLISH_SQL = (
    DOCUMENT_SQL
    + r""",
  ok AS (SELECT node_id FROM nodes WHERE lifecycle_state = 'active' AND review_status = 'accepted'), box AS (SELECT scope_id FROM scopes WHERE scope_id IN (SELECT node_id FROM shown)),
  good AS (SELECT * FROM relations WHERE lifecycle_state = 'active' AND review_status = 'accepted'),
  members AS (SELECT target_id AS node_id, relation_id, source_id FROM good WHERE relation_family = 'membership' AND source_id IN (SELECT scope_id FROM box)),
  asked AS (SELECT ok.node_id, 'm' || CAST(s_suppkey AS VARCHAR) AS chosen_id FROM ok LEFT JOIN supplier ON 's' || CAST(s_suppkey AS VARCHAR) = ok.node_id AND s_suppkey % 4 = 1 WHERE ok.node_id NOT IN (SELECT scope_id FROM box)),
  open_ AS (SELECT a.node_id, count(m.relation_id) AS n FROM asked a LEFT JOIN members m ON m.node_id = a.node_id WHERE chosen_id IS NULL GROUP BY a.node_id),
  valid AS (SELECT a.node_id, m.source_id FROM asked a JOIN members m ON m.node_id = a.node_id AND m.relation_id = a.chosen_id),
  lead_up AS (SELECT target_id AS child, arg_max(source_id, ord) AS parent FROM good WHERE relation_family = 'structure' GROUP BY target_id),
  needed AS (SELECT DISTINCT source_id AS node_id FROM valid UNION SELECT parent FROM needed JOIN lead_up ON child = node_id),
  blockers AS (
    SELECT 'accepted_relation_endpoint_not_accepted' AS code, relation_id AS object_id FROM good WHERE relation_family IN ('semantic', 'unresolved') AND ((source_id NOT IN (SELECT node_id FROM ok) AND source_id NOT IN (SELECT scope_id FROM box)) OR (target_id NOT IN (SELECT node_id FROM ok) AND target_id NOT IN (SELECT scope_id FROM box)))
    UNION SELECT 'primary_membership_invalid', node_id FROM asked WHERE chosen_id IS NOT NULL AND node_id NOT IN (SELECT node_id FROM valid)
    UNION SELECT CASE WHEN n = 0 THEN 'accepted_membership_missing' WHEN n = 1 THEN 'primary_membership_confirmation_required' ELSE 'primary_membership_required' END, node_id FROM open_
    UNION SELECT 'required_scope_not_accepted', node_id FROM needed WHERE node_id NOT IN (SELECT node_id FROM ok) UNION SELECT 'unresolved_relation_not_publishable', relation_id FROM good WHERE relation_family = 'unresolved'
    UNION SELECT 'relation_type_unsupported', relation_id FROM good WHERE relation_family = 'semantic' AND source_id IN (SELECT node_id FROM ok) AND target_id IN (SELECT node_id FROM ok) AND relation_type NOT IN ('prerequisite', 'progressive', 'derives_to', 'explains'))"""
)
DRAFT_SQL = r"""
  nodes AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS node_id, CASE WHEN s_suppkey % 37 = 1 THEN ' ' ELSE 'name ' || CAST(s_suppkey % 60 AS VARCHAR) END AS display_name, s_suppkey < 10 AS box, CASE WHEN s_suppkey >= 10 THEN 's' || CAST(s_suppkey % 10 AS VARCHAR) ELSE '' END AS parent_id,
      CASE s_suppkey % 8 WHEN 2 THEN 'pending' WHEN 3 THEN 'needs_revision' ELSE 'accepted' END AS status, CASE WHEN s_suppkey % 6 = 5 THEN '' ELSE 'text' END AS evidence FROM supplier),
  edges AS (SELECT 's' || CAST(l_suppkey AS VARCHAR) AS a, CASE WHEN l_linenumber = 6 THEN '' ELSE 's' || CAST(l_partkey % 103 AS VARCHAR) END AS b, CASE l_returnflag WHEN 'A' THEN 'prerequisite' WHEN 'R' THEN 'contains' ELSE 'explains' END AS kind,
      CASE WHEN l_linestatus = 'F' THEN 'accepted' WHEN l_linenumber % 2 = 0 THEN 'pending' ELSE 'needs_revision' END AS status, CASE WHEN l_linenumber = 3 THEN '' ELSE 'said' END AS evidence FROM lineitem),
  e AS (SELECT *, a || '--' || kind || '--' || b AS id FROM edges), ok AS (SELECT * FROM nodes WHERE status = 'accepted'), good AS (SELECT * FROM e WHERE status = 'accepted'), whole AS (SELECT * FROM good WHERE a <> '' AND b <> ''),
  ends AS (SELECT id, kind, a AS x FROM whole WHERE a <> b UNION ALL SELECT id, kind, b FROM whole WHERE a <> b),
  kids AS (SELECT node_id, parent_id FROM ok WHERE NOT box AND parent_id <> ''), inner_edges AS (SELECT p.parent_id FROM good JOIN kids p ON p.node_id = a JOIN kids q ON q.node_id = b WHERE kind = 'prerequisite' AND p.parent_id = q.parent_id),
  steps AS (SELECT DISTINCT a, b FROM whole WHERE kind = 'prerequisite' AND a <> b), reach AS (SELECT a, b FROM steps UNION SELECT r.a, s.b FROM reach r JOIN steps s ON s.a = r.b),
  report AS (
    SELECT 'node_pending_review' AS code, 'warning' AS severity, node_id AS object_id FROM nodes WHERE status = 'pending' UNION SELECT 'node_needs_revision', 'warning', node_id FROM nodes WHERE status = 'needs_revision'
    UNION SELECT 'edge_pending_review', 'warning', id FROM e WHERE status = 'pending' UNION SELECT 'edge_needs_revision', 'warning', id FROM e WHERE status = 'needs_revision'
    UNION SELECT 'node_missing_name', 'error', node_id FROM ok WHERE trim(display_name) = '' UNION SELECT 'node_missing_evidence', 'warning', node_id FROM ok WHERE evidence = ''
    UNION SELECT 'duplicate_edge', 'warning', id FROM good GROUP BY id HAVING count(*) > 1 UNION SELECT 'edge_incomplete', 'error', id FROM good WHERE a = '' OR b = '' UNION SELECT 'edge_self_loop', 'error', id FROM whole WHERE a = b
    UNION SELECT 'edge_endpoint_missing', 'error', id FROM ends WHERE x NOT IN (SELECT node_id FROM nodes) UNION SELECT 'edge_endpoint_not_accepted', CASE WHEN kind = 'contains' THEN 'error' ELSE 'warning' END, id FROM ends JOIN nodes ON node_id = x WHERE status <> 'accepted'
    UNION SELECT 'edge_missing_evidence', 'warning', id FROM whole WHERE kind <> 'contains' AND evidence = '' UNION SELECT 'structure_parent_not_accepted', 'error', ok.node_id FROM ok JOIN nodes p ON p.node_id = ok.parent_id WHERE p.status <> 'accepted'
    UNION SELECT 'duplicate_node_name', 'warning', trim(display_name) FROM ok WHERE trim(display_name) <> '' GROUP BY 3 HAVING count(*) > 1
    UNION SELECT 'isolated_node', 'warning', node_id FROM ok WHERE node_id NOT IN (SELECT a FROM good) AND node_id NOT IN (SELECT b FROM good)
    UNION SELECT 'structure_relation_not_accepted', 'error', c.node_id FROM ok c JOIN ok p ON p.node_id = c.parent_id WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.kind = 'contains' AND g.a = c.parent_id AND g.b = c.node_id)
    UNION SELECT 'learning_path_cycle', 'warning', low FROM (SELECT x.a, min(x.b) AS low FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a GROUP BY x.a) q
    UNION SELECT 'chapter_main_path_missing', 'info', parent_id FROM kids WHERE parent_id NOT IN (SELECT parent_id FROM inner_edges) GROUP BY parent_id HAVING count(*) >= 3)"""
TRIO_SQL = r"""
  o AS (SELECT o_orderkey AS k, o_orderstatus AS st, o_orderpriority AS pr, CAST(CAST(round(o_totalprice, 0) AS BIGINT) AS VARCHAR) AS price FROM orders),
  wb AS (SELECT * FROM o WHERE k % 50 <> 7), wl AS (SELECT k, CASE WHEN k % 10 = 2 THEN 'P!' ELSE st END AS st, pr, CASE WHEN k % 10 = 3 THEN price || '10' ELSE price END AS price FROM o WHERE k % 50 <> 9),
  wr AS (SELECT k, CASE WHEN k % 15 = 2 THEN 'P!' ELSE st END AS st, pr, CASE WHEN k % 15 = 3 THEN price || '15' ELSE price END AS price FROM o WHERE k % 50 <> 11),
  b AS (SELECT k, 'o_orderstatus' AS f, st AS v FROM wb UNION ALL SELECT k, 'o_orderpriority', pr FROM wb UNION ALL SELECT k, 'price', price FROM wb),
  l AS (SELECT k, 'o_orderstatus' AS f, st AS v FROM wl UNION ALL SELECT k, 'o_orderpriority', pr FROM wl UNION ALL SELECT k, 'price', price FROM wl),
  r AS (SELECT k, 'o_orderstatus' AS f, st AS v FROM wr UNION ALL SELECT k, 'o_orderpriority', pr FROM wr UNION ALL SELECT k, 'price', price FROM wr),
  keys AS (SELECT k, f FROM b UNION SELECT k, f FROM l UNION SELECT k, f FROM r),
  joined AS (SELECT keys.k, keys.f, b.v AS bv, l.v AS lv, r.v AS rv FROM keys LEFT JOIN b ON b.k = keys.k AND b.f = keys.f LEFT JOIN l ON l.k = keys.k AND l.f = keys.f LEFT JOIN r ON r.k = keys.k AND r.f = keys.f),
  planned AS (SELECT *, CASE WHEN bv IS NOT NULL AND rv IS NULL THEN 'ignored_delete' WHEN rv IS NULL THEN NULL WHEN bv IS NULL AND lv IS NULL THEN 'new_object' WHEN bv IS NULL AND lv <> rv THEN 'new_object_conflict' WHEN bv IS NULL THEN NULL
      WHEN rv = bv THEN NULL WHEN lv IS NOT NULL AND lv = bv THEN 'change' WHEN lv = rv THEN NULL ELSE 'conflict' END AS outcome FROM joined)"""
LOG_SQL = """log AS (SELECT user_id AS document_id, ts, event_id AS command_id, CASE WHEN event_type <> 'error' THEN round(value, 2) END AS num, event_type, event_id % 4 AS object, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS revision FROM events)"""
WINDOWS_SQL = "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL"

ORACLE_SQL = {
    "integrity_report": f"WITH RECURSIVE {DOCUMENT_SQL} SELECT code, object_id FROM issues",
    "document_quality": f"""WITH RECURSIVE {DOCUMENT_SQL}, single AS (SELECT s.node_id, count(m.relation_id) AS n FROM shown s LEFT JOIN live m ON m.target_id = s.node_id AND m.relation_family = 'membership' WHERE s.node_id NOT IN (SELECT scope_id FROM scopes) GROUP BY s.node_id)
      SELECT CASE WHEN code LIKE 'structure\\_%' ESCAPE '\\' OR code LIKE 'scope\\_%' ESCAPE '\\' THEN 'structure' WHEN code LIKE 'membership\\_%' ESCAPE '\\' OR code LIKE 'occurrence\\_%' ESCAPE '\\' THEN 'membership' ELSE 'integrity' END AS dimension, 'error' AS severity, code, count(*) AS n FROM issues GROUP BY ALL
      UNION ALL SELECT 'semantic', 'warning', 'unresolved_legacy_relation', count(*) FROM live WHERE relation_family = 'unresolved' HAVING count(*) > 0
      UNION ALL SELECT 'membership', 'warning', CASE WHEN n = 0 THEN 'membership_missing' ELSE 'multiple_memberships' END, count(*) FROM single WHERE n <> 1 GROUP BY ALL
      UNION ALL SELECT 'displayability', 'warning', code, count(*) FROM gaps GROUP BY ALL""",
    "projection_ledger": f"""WITH RECURSIVE {DOCUMENT_SQL} SELECT CASE WHEN review_status = 'rejected' THEN 'filtered' WHEN relation_family IN ('structure', 'membership') THEN 'nested' WHEN source_id IN (SELECT node_id FROM shown) AND target_id IN (SELECT node_id FROM shown) THEN 'line' ELSE 'context' END AS representation, count(*) AS n
      FROM relations WHERE lifecycle_state = 'active' GROUP BY ALL""",
    "projection_issues": f"WITH RECURSIVE {DOCUMENT_SQL} SELECT code, object_id FROM gaps",
    "publish_preflight": f"WITH RECURSIVE {PUBLISH_SQL} SELECT code, object_id FROM blockers",
    "publish_status": "SELECT 'all' AS issues, 'blocked' AS status UNION ALL SELECT 'choices', 'needs_decision' UNION ALL SELECT 'none', 'ready'",
    "publish_counts": f"""WITH RECURSIVE {PUBLISH_SQL}
      SELECT 'nodes_not_accepted' AS name, count(*) AS n FROM nodes WHERE lifecycle_state = 'active' AND review_status <> 'accepted' UNION ALL SELECT 'relations_not_accepted', count(*) FROM relations WHERE lifecycle_state = 'active' AND review_status <> 'accepted'
      UNION ALL SELECT 'selected_knowledge_nodes', count(*) FROM asked UNION ALL SELECT 'occurrences_omitted', count(*) FROM occurrences
      UNION ALL SELECT 'selected_semantic_relations', count(*) FROM good WHERE relation_family = 'semantic' AND source_id IN (SELECT node_id FROM asked) AND target_id IN (SELECT node_id FROM asked) AND relation_type IN ('prerequisite', 'progressive', 'derives_to', 'explains')
      UNION ALL SELECT 'secondary_memberships_omitted', CAST(coalesce(sum(k - 1), 0) AS BIGINT) FROM (SELECT count(*) AS k FROM good WHERE relation_family = 'membership' AND target_id IN (SELECT node_id FROM asked) GROUP BY target_id) q""",
    "publish_ancestors": f"WITH RECURSIVE {PUBLISH_SQL} SELECT node_id FROM needed",
    "publish_selection": f"""WITH RECURSIVE {PUBLISH_SQL},
      wanted AS (SELECT 's' || CAST(s_suppkey + CASE WHEN s_suppkey % 27 = 0 THEN 9000 ELSE 0 END AS VARCHAR) AS node_id FROM supplier WHERE s_suppkey % 3 = 0), named AS (SELECT 'm' || CAST(s_suppkey + CASE WHEN s_suppkey % 22 = 0 THEN 9000 ELSE 0 END AS VARCHAR) AS relation_id FROM supplier WHERE s_suppkey % 2 = 0),
      mine AS (SELECT * FROM asked WHERE node_id IN (SELECT node_id FROM wanted)), my_valid AS (SELECT a.node_id, m.source_id FROM mine a JOIN members m ON m.node_id = a.node_id AND m.relation_id = a.chosen_id),
      my_open AS (SELECT a.node_id, count(m.relation_id) AS n FROM mine a LEFT JOIN members m ON m.node_id = a.node_id WHERE chosen_id IS NULL GROUP BY a.node_id),
      my_needed AS (SELECT DISTINCT source_id AS node_id FROM my_valid UNION SELECT parent FROM my_needed JOIN lead_up ON child = node_id)
      SELECT DISTINCT 'document_integrity_error' AS code, code || ':' || object_id AS object_id FROM issues UNION SELECT 'target_protocol_unsupported', 'other'
      UNION SELECT 'selected_node_missing', node_id FROM wanted WHERE node_id NOT IN (SELECT node_id FROM shown) UNION SELECT 'selected_node_not_accepted', node_id FROM wanted WHERE node_id IN (SELECT node_id FROM shown) AND node_id NOT IN (SELECT node_id FROM ok)
      UNION SELECT 'selected_relation_missing', relation_id FROM named WHERE relation_id NOT IN (SELECT relation_id FROM relations WHERE lifecycle_state = 'active')
      UNION SELECT 'primary_membership_invalid', node_id FROM mine WHERE chosen_id IS NOT NULL AND node_id NOT IN (SELECT node_id FROM my_valid)
      UNION SELECT CASE WHEN n = 0 THEN 'accepted_membership_missing' WHEN n = 1 THEN 'primary_membership_confirmation_required' ELSE 'primary_membership_required' END, node_id FROM my_open
      UNION SELECT 'required_scope_not_accepted', node_id FROM my_needed WHERE node_id NOT IN (SELECT node_id FROM ok)""",
    "membership_status": f"""WITH RECURSIVE {DOCUMENT_SQL} SELECT target_id AS node_id, CASE WHEN bool_or(review_status = 'pending') THEN 'pending' WHEN bool_or(review_status = 'accepted') THEN 'accepted' ELSE '' END AS review_status FROM relations WHERE relation_family = 'membership' GROUP BY target_id""",
    "hidden_cards": f"""WITH RECURSIVE {DOCUMENT_SQL}, h AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS id FROM supplier WHERE s_suppkey % 5 = 0)
      SELECT CASE WHEN review_status = 'rejected' THEN 'filtered' WHEN source_id IN (SELECT id FROM h) OR target_id IN (SELECT id FROM h) THEN 'view_hidden' ELSE 'line' END AS representation, count(*) AS n FROM relations WHERE relation_family = 'semantic' GROUP BY ALL""",
    "command_verdicts": """WITH c AS (SELECT CASE event_id % 4 WHEN 0 THEN 'node' WHEN 1 THEN 'relation' WHEN 2 THEN 'scope' ELSE 'chapter' END AS record_type, CASE event_id % 3 WHEN 0 THEN 'review_status' WHEN 1 THEN 'node_type' ELSE 'confidence' END AS field_name, event_id % 5 = 0 AND event_id % 10 <> 5 AS stale FROM events)
      SELECT record_type, field_name, CASE WHEN stale THEN 'stale' WHEN record_type = 'chapter' THEN 'unknown_record' WHEN field_name = 'review_status' OR (record_type = 'node' AND field_name = 'node_type') OR (record_type = 'relation' AND field_name = 'confidence') THEN 'ok' ELSE 'field_not_editable' END AS verdict, count(*) AS n FROM c GROUP BY ALL""",
    "membership_choice": f"""WITH RECURSIVE {DOCUMENT_SQL}, m AS (SELECT target_id, source_id, relation_id, row_number() OVER (PARTITION BY target_id ORDER BY source_id, relation_id) AS nth FROM relations WHERE relation_family = 'membership')
      SELECT 'node:' || node_id || '@' || coalesce(relation_id, 'unassigned') AS view_id, node_id, coalesce(source_id, 'unassigned') AS scope_id, coalesce(nth, 1) AS nth, coalesce(nth, 1) > 1 AS is_reference FROM nodes LEFT JOIN m ON target_id = node_id WHERE node_id LIKE 's%'""",
    "quality_report": f"WITH RECURSIVE {DRAFT_SQL} SELECT code, severity, object_id FROM report",
    "quality_rollup": f"WITH RECURSIVE {DRAFT_SQL} SELECT severity, code, count(*) AS n FROM report GROUP BY ALL",
    "three_way_merge": f"WITH {TRIO_SQL} SELECT CAST(k AS VARCHAR) AS object_id, f AS field_name, bv AS base, lv AS local, rv AS remote, outcome FROM planned WHERE outcome IS NOT NULL",
    "merge_outcomes": f"""WITH {TRIO_SQL}, merged AS (SELECT k, f, CASE WHEN outcome IN ('change', 'conflict', 'new_object', 'new_object_conflict') THEN rv ELSE lv END AS v FROM planned)
      SELECT f AS field_name, v AS value, count(*) AS n FROM merged WHERE v IS NOT NULL AND f = 'o_orderstatus' GROUP BY ALL""",
    "field_baseline_hash": f"WITH {TRIO_SQL} SELECT CAST(k AS VARCHAR) AS object_id, f AS field_name, 3 AS base_revision, sha256(v) AS field_sha256 FROM b",
    "document_fingerprint": "SELECT * FROM (VALUES ('dealt_anew', true), ('spaced', true), ('changed', false)) t(document, same)",
    "stale_commands": """WITH RECURSIVE log AS (SELECT user_id AS document_id, event_id AS command_id, CASE WHEN event_id % 3 = 0 THEN event_id % 40 END AS expected, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
      walk AS (SELECT document_id, command_id, rn, CAST(0 AS BIGINT) AS revision_before, coalesce(expected <> 0, false) AS is_stale FROM log WHERE rn = 1
        UNION ALL SELECT l.document_id, l.command_id, l.rn, w.revision_before + CASE WHEN w.is_stale THEN 0 ELSE 1 END, coalesce(l.expected <> w.revision_before + CASE WHEN w.is_stale THEN 0 ELSE 1 END, false) FROM walk w JOIN log l ON l.document_id = w.document_id AND l.rn = w.rn + 1)
      SELECT document_id, command_id, revision_before, is_stale FROM walk""",
    "undo_state": f"WITH {LOG_SQL} SELECT document_id, CAST(object AS VARCHAR) AS object_id, CAST(arg_max_null(num, revision) AS VARCHAR) AS value FROM log WHERE revision <= 25 GROUP BY document_id, object",
    "command_history": f"WITH {LOG_SQL}, back AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY revision DESC) AS steps_back FROM log) SELECT document_id, command_id, steps_back FROM back WHERE steps_back <= 12",
    "command_log_fold": f"WITH {LOG_SQL} SELECT document_id, command_id, revision, CAST(last_value(num IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY revision ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS VARCHAR) AS value_after FROM log",
    "bulk_accept": "SELECT o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN 'accepted' WHEN o_orderstatus = 'P' THEN 'needs_revision' WHEN o_orderkey % 3 = 0 THEN 'accepted' ELSE 'pending' END AS review_status, count(*) AS n FROM orders GROUP BY ALL",
    "archive_cascade": f"""WITH RECURSIVE {DOCUMENT_SQL}, gone AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS id FROM supplier WHERE s_suppkey % 6 = 1),
      x AS (SELECT 'node' AS kind, lifecycle_state, node_id IN (SELECT id FROM gone) AS hit FROM nodes UNION ALL SELECT 'relation', lifecycle_state, source_id IN (SELECT id FROM gone) OR target_id IN (SELECT id FROM gone) FROM relations UNION ALL SELECT 'occurrence', 'active', node_id IN (SELECT id FROM gone) FROM occurrences)
      SELECT kind, CASE WHEN hit AND lifecycle_state = 'active' THEN 'archived' ELSE lifecycle_state END AS lifecycle_state, CASE WHEN hit AND lifecycle_state = 'active' AND kind <> 'occurrence' THEN 2 ELSE 1 END AS revision, count(*) AS n FROM x GROUP BY ALL""",
    "view_states": """WITH c AS (SELECT user_id, event_type, value, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events WHERE event_id >= 1000),
      s AS (SELECT user_id, event_type, max(value) AS value FROM events WHERE event_id < 1000 GROUP BY ALL)
      SELECT user_id, event_type, value, event_id FROM c WHERE k = 1 UNION ALL SELECT s.user_id, s.event_type, s.value, -1 FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = s.user_id AND c.event_type = s.event_type)""",
    "event_windows": WINDOWS_SQL,
    "event_percentiles": "SELECT event_type, round(value, 3) AS value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) q WHERE k = greatest(1, least(n, CAST(ceil(n * 0.95::DOUBLE) AS BIGINT)))",
    "streamed_event_windows": WINDOWS_SQL,
}
