"""Queries over node candidates and relation claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import canonical as C
from ..operators import completion as K
from ..sources import adapters as A

NODES_SQL = r"""
  nodes AS (
    SELECT p_partkey AS ord, CAST(p_partkey AS VARCHAR) AS temporary_id, trim(p_name) AS display_name, p_brand AS chapter, p_type AS definition, p_size / 50.0 AS confidence,
      CASE p_type WHEN 'ECONOMY' THEN 'concept' WHEN 'LARGE' THEN 'rule' WHEN 'MEDIUM' THEN 'method' WHEN 'PROMO' THEN 'application' WHEN 'SMALL' THEN 'property' WHEN 'STANDARD' THEN 'representation' ELSE 'concept' END AS node_type,
      regexp_replace(lower(trim(p_name)), '[\s_\-,;:()\[\]{}]+', '', 'g') AS mention, regexp_replace(lower(trim(p_brand)), '[\s_\-,;:()\[\]{}]+', '', 'g') AS chapter_key
    FROM part WHERE trim(p_name) <> ''),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY mention, node_type, chapter_key ORDER BY confidence DESC, length(definition) DESC, ord) AS rn FROM nodes),
  names AS (SELECT mention, node_type, chapter_key, display_name || ' ' || definition AS alias, min(ord) AS first FROM nodes GROUP BY ALL),
  aliases AS (SELECT mention, node_type, chapter_key, string_agg(alias, '|' ORDER BY first) AS aliases FROM names GROUP BY ALL),
  members AS (SELECT mention, node_type, chapter_key, count(*) AS member_count, round(avg(least(1.0, greatest(0.0, confidence))), 3) AS confidence, string_agg(temporary_id, '|' ORDER BY ord) AS source_ids FROM nodes GROUP BY ALL),
  best AS (
    SELECT r.mention, r.node_type, r.chapter_key, r.display_name, r.chapter, m.member_count, m.confidence, m.source_ids, a.aliases,
      lower(trim(r.chapter)) || '_' || trim(regexp_replace(lower(r.display_name), '[^a-z0-9]+', '_', 'g'), '_') AS base_id
    FROM ranked r JOIN members m ON r.mention = m.mention AND r.node_type = m.node_type AND r.chapter_key = m.chapter_key
      JOIN aliases a ON r.mention = a.mention AND r.node_type = a.node_type AND r.chapter_key = a.chapter_key WHERE r.rn = 1),
  canonical AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY base_id ORDER BY mention, node_type, chapter_key) = 1 THEN base_id ELSE base_id || '_' || node_type END AS node_id FROM best)"""


def _canonical(spark: SparkSession, d: str) -> DataFrame:
    return C.canonical_nodes(A.local_nodes(spark, d))


def mention_canonicalize(spark: SparkSession, d: str) -> DataFrame:
    joined = lambda c: F.array_join(c, "|").alias(c)
    return _canonical(spark, d).select("node_id", "display_name", "node_type", "chapter", "member_count", "confidence", joined("aliases"), joined("source_ids"))


def alias_mapping(spark: SparkSession, d: str) -> DataFrame:
    return C.alias_mappings(A.local_nodes(spark, d), _canonical(spark, d))


def node_id_collision(spark: SparkSession, d: str) -> DataFrame:
    return _canonical(spark, d).where(F.col("node_id").endswith(F.concat(F.lit("_"), F.col("node_type")))).select("node_id", "node_type")


def type_normalize_counts(spark: SparkSession, d: str) -> DataFrame:
    nodes = A.local_nodes(spark, d).select(F.lit("node").alias("kind"), T.node_type(F.col("node_type")).alias("value"))
    claims = A.local_claims(spark, d).select(F.lit("relation").alias("kind"), T.relation_type(F.col("relation_type")).alias("value"))
    raw = F.create_map(*(F.lit(x) for kv in A.RAW_STATUSES.items() for x in kv))
    orders = A.table(spark, d, "orders").select(F.lit("status").alias("kind"), T.review_status(raw[F.col("o_orderstatus")]).alias("value"))
    return nodes.union(claims).union(orders).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


def relation_profile(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("relation_type")
    return A.local_claims(spark, d).select(T.relation_type(t).alias("relation_type"), T.directionality(t).alias("directionality"), T.edge_scope(t).alias("edge_scope"), T.relation_priority(t).alias("priority")).groupBy("relation_type", "directionality", "edge_scope", "priority").agg(F.count(F.lit(1)).alias("n"))


def _claims(spark: SparkSession, d: str) -> DataFrame:
    names = A.table(spark, d, "part").select("p_partkey", "p_name")
    c = A.local_claims(spark, d)
    c = c.join(names.select(F.col("p_partkey").alias("source_key"), F.col("p_name").alias("source_mention")), "source_key").join(names.select(F.col("p_partkey").alias("target_key"), F.col("p_name").alias("target_mention")), "target_key")
    blank = F.col("line") % 3 == 0
    return c.select(
        "claim_id", (F.col("order_key") * 1000 + F.col("line")).alias("ord"), F.when(blank, "").otherwise(F.col("source_key").cast("string")).alias("source_temporary_id"), "source_mention",
        F.col("target_key").cast("string").alias("target_temporary_id"), "target_mention", "relation_type", "confidence", F.lit("explicit").alias("evidence_type"), F.lit("").alias("evidence_text"),
        F.array(F.col("claim_id")).alias("evidence_refs"), F.lit("pending").alias("review_status"),
    )


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    nodes = _canonical(spark, d)
    mappings = C.alias_mappings(A.local_nodes(spark, d), nodes)
    return C.resolved(_claims(spark, d), mappings, C.mention_index(nodes, mappings))


def relation_consolidate(spark: SparkSession, d: str) -> DataFrame:
    return C.consolidated(_resolved(spark, d)).select("source_id", "relation_type", "target_id", F.round("confidence", 6).alias("confidence"), "claim_count", F.array_join("evidence_refs", "|").alias("evidence_refs"), "review_status")


def relation_unresolved(spark: SparkSession, d: str) -> DataFrame:
    r = _resolved(spark, d).where(~C.is_resolved())
    return r.select("claim_id", F.when((F.col("source_id") == "") | (F.col("target_id") == "") | (F.col("relation_type") == ""), "unresolved_end").otherwise("self_loop").alias("reason"))


CLAIMS_SQL = r"""
  line AS (SELECT l_orderkey, l_partkey, l_discount, l_returnflag || l_linestatus AS flags, row_number() OVER w AS line, lead(l_partkey) OVER w AS target_key FROM lineitem
      WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_returnflag, l_linestatus)),
  claims AS (SELECT CAST(l_orderkey AS VARCHAR) || '#' || CAST(line AS VARCHAR) AS claim_id, l_orderkey * 1000 + line AS ord, l_partkey AS source_key, target_key, line, l_discount * 10 AS confidence,
      CASE flags WHEN 'AF' THEN 'prerequisite' WHEN 'AO' THEN 'progressive' WHEN 'NF' THEN 'derives_to' WHEN 'NO' THEN 'explains' WHEN 'RF' THEN 'contrast' WHEN 'RO' THEN 'parallel' END AS relation_type
    FROM line WHERE target_key IS NOT NULL)"""
RESOLVED_SQL = (
    NODES_SQL
    + ","
    + CLAIMS_SQL
    + r""",
  owner AS (SELECT n.ord, n.mention, c.node_id FROM nodes n JOIN canonical c ON n.mention = c.mention AND n.node_type = c.node_type AND n.chapter_key = c.chapter_key),
  sole AS (SELECT mention, min(node_id) AS node_id FROM canonical GROUP BY mention HAVING count(DISTINCT node_id) = 1),
  ends AS (
    SELECT k.*, CASE WHEN k.line % 3 = 0 THEN coalesce(u.node_id, '') ELSE coalesce(s.node_id, '') END AS source_id, coalesce(t.node_id, '') AS target_id
    FROM claims k LEFT JOIN owner s ON s.ord = k.source_key LEFT JOIN sole u ON u.mention = s.mention LEFT JOIN owner t ON t.ord = k.target_key)"""
)


def draft_dedup_merge(spark: SparkSession, d: str) -> DataFrame:
    p = A.table(spark, d, "part")
    drafts = p.select(F.col("p_partkey").alias("ord"), T.slug(F.col("p_name")).alias("node_id"), F.array("p_brand").alias("prerequisites"), F.array("p_type").alias("tags"), (F.col("p_size") / 50.0).alias("confidence"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("").alias("reasoning"))
    return C.merged_drafts(drafts).select("node_id", F.array_join("prerequisites", "|").alias("prerequisites"), F.array_join("tags", "|").alias("tags"), "confidence", "draft_count", "reasoning")


def reference_resolution(spark: SparkSession, d: str) -> DataFrame:
    p = A.table(spark, d, "part")
    drafts = p.select(F.col("p_partkey").alias("ord"), F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("node_id"), T.slug(F.col("p_name")).alias("node_name"), F.col("p_name").alias("display_name"))
    wanted = p.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("N"), F.col("p_partkey").cast("string"))).otherwise(F.concat(F.lit("missing "), F.col("p_name"))).alias("reference"))
    return C.resolve_reference(wanted, "reference", C.reference_index(drafts), "node_id")


def subject_metadata(spark: SparkSession, d: str) -> DataFrame:
    g = F.concat(F.when(F.col("p_partkey") % 2 == 0, "Grade").otherwise("g"), (F.col("p_size") % 14).cast("string"))
    return A.table(spark, d, "part").select(g.alias("grade")).select(T.education_stage(F.col("grade")).alias("education_stage"), T.grade_band(F.col("grade")).alias("grade_band")).groupBy("education_stage", "grade_band").agg(F.count(F.lit(1)).alias("n"))


def evidence_sanitize(spark: SparkSession, d: str) -> DataFrame:
    c = A.local_claims(spark, d).select("claim_id", F.array((F.col("order_key") % 50).cast("string"), (F.col("order_key") % 7).cast("string")).alias("evidence_refs"), "confidence", F.lit("pending").alias("review_status"))
    allowed = A.table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("ref")).where("n_nationkey >= 5")
    return C.sanitized(c, allowed).select("claim_id", F.array_join("evidence_refs", "|").alias("evidence_refs"), F.round("confidence", 6).alias("confidence"), "review_status", F.col("dropped_refs").cast("long").alias("dropped_refs"))


def evidence_anchors(spark: SparkSession, d: str) -> DataFrame:
    nodes = A.table(spark, d, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("node_id"), F.when(F.col("item_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("doc:"), F.col("item_id").cast("string"), F.lit("#b1")), F.concat(F.lit("doc:"), (F.col("item_id") + 1).cast("string")))).alias("evidence_refs"), F.lit(0.9).alias("confidence"))
    docs = A.table(spark, d, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("page_id"), "text")
    pages = docs.select("page_id", F.lit("").alias("block_id"), "text").unionByName(docs.select("page_id", F.lit("b1").alias("block_id"), F.substring("text", 1, 40).alias("text")))
    return C.evidence_anchors(nodes, pages).withColumn("anchor_text", F.md5("anchor_text")).withColumn("nth", F.col("nth").cast("long"))


def formal_edges(spark: SparkSession, d: str) -> DataFrame:
    nodes, relations = _suppliers(spark, d)
    return C.formal_edges(nodes, relations)


def _suppliers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = A.table(spark, d, "supplier")
    ident = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    status = F.when(F.col("s_acctbal") > 0, "approved").otherwise("needs_review")
    nodes = s.select(ident.alias("node_id"), F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("s"), ((F.col("s_suppkey") + 4) % 40).cast("string"))).otherwise("").alias("parent_id"), F.array(F.concat(F.lit("s"), ((F.col("s_suppkey") * 7) % 50).cast("string"))).alias("prerequisites"), status.alias("review_status"))
    line = A.table(spark, d, "lineitem")
    raw = F.create_map(*(F.lit(x) for kv in {"AF": "contains", "AO": "sequence", "NF": "derived_from", "NO": "nonsense", "RF": "prerequisite", "RO": "parallel"}.items() for x in kv))
    relations = line.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source_id"), F.concat(F.lit("s"), (F.col("l_partkey") % 120).cast("string")).alias("target_id"), raw[F.concat("l_returnflag", "l_linestatus")].alias("relation_type"), F.when(F.col("l_linenumber") % 2 == 0, "accept").otherwise("pending").alias("review_status"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return nodes, relations


def _typed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    _, r = _suppliers(spark, d)
    r = r.withColumn("relation_type", T.relation_type(F.col("relation_type"))).withColumn("review_status", T.review_status(F.col("review_status"))).where("relation_type <> ''")
    scopes = A.table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node_id"))
    return r, scopes


def family_classification(spark: SparkSession, d: str) -> DataFrame:
    r, scopes = _typed(spark, d)
    return C.classified(r, scopes).groupBy("family", "relation_type").agg(F.count(F.lit(1)).alias("n"))


def migrated_relations(spark: SparkSession, d: str) -> DataFrame:
    return C.migrated_relations(*_typed(spark, d))


RELATIONS_SQL = r"""
  raw AS (SELECT 's' || CAST(l_suppkey AS VARCHAR) AS source_id, 's' || CAST(l_partkey % 120 AS VARCHAR) AS target_id, l_orderkey * 10 + l_linenumber AS ord,
      CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'contains' WHEN 'AO' THEN 'progressive' WHEN 'NF' THEN 'derives_to' WHEN 'NO' THEN '' WHEN 'RF' THEN 'prerequisite' WHEN 'RO' THEN 'parallel' END AS relation_type,
      CASE WHEN l_linenumber % 2 = 0 THEN 'accepted' ELSE 'pending' END AS review_status FROM lineitem),
  r AS (SELECT * FROM raw WHERE relation_type <> ''),
  scopes AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS node_id FROM supplier WHERE s_suppkey % 3 = 0),
  families AS (SELECT r.*, CASE WHEN relation_type <> 'contains' THEN 'semantic' WHEN a.node_id IS NOT NULL AND b.node_id IS NOT NULL THEN 'structure' WHEN a.node_id IS NOT NULL THEN 'membership' ELSE 'unresolved' END AS family
    FROM r LEFT JOIN scopes a ON a.node_id = r.source_id LEFT JOIN scopes b ON b.node_id = r.target_id)"""

def _completion(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """An order's claims as a model's answer; first claims are seeds already; a quarter of the parts, and some pages, aren't known."""
    c = A.local_claims(spark, d).withColumn("ref", F.concat(F.lit("page:"), (F.col("source_key") % 97).cast("string")))
    ends = [F.col("source_key").cast("string").alias("source_node_id"), F.col("target_key").cast("string").alias("target_node_id")]
    answers = c.groupBy(F.col("order_key").alias("answer_id")).agg(F.to_json(F.array_sort(F.collect_list(F.struct("line", *ends, "relation_type", F.array("ref").alias("evidence_refs"), "confidence")))).alias("answer"))
    first = c.where("line = 1").select(*ends, T.relation_type(F.col("relation_type")).alias("relation_type"), "ref", "confidence")
    seeds = first.groupBy("source_node_id", "relation_type", "target_node_id").agg(F.first("ref").alias("ref"), F.min("confidence").alias("confidence"))
    text = lambda v, name: F.lit(v).alias(name)
    seeds = seeds.select("source_node_id", "relation_type", "target_node_id", text("explicit", "evidence_type"), text("same_page", "inference_scope"), F.array("ref").alias("evidence_refs"), text("", "evidence_text"), "confidence", text("", "reasoning_summary"), text("seed", "relation_source"), text("accepted", "review_status"))
    part = A.table(spark, d, "part")
    refs = part.where("p_partkey % 97 % 3 <> 0").select(F.concat(F.lit("page:"), (F.col("p_partkey") % 97).cast("string")).alias("evidence_ref"))
    return K.completed(seeds, answers, part.where("p_size % 4 <> 1").select(F.col("p_partkey").cast("string").alias("node_id")), refs)


def completed_relations(spark: SparkSession, d: str) -> DataFrame:
    relations, _ = _completion(spark, d)
    return relations.select("source_node_id", "relation_type", "target_node_id", "relation_source", "review_status", F.round("confidence", 6).alias("confidence"), F.array_join("evidence_refs", "|").alias("evidence_refs"))


def completion_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return _completion(spark, d)[1]


def manual_ids(spark: SparkSession, d: str) -> DataFrame:
    """Numbers for parts' names beside those that every third part has taken."""
    p = A.table(spark, d, "part")
    used = p.where("p_partkey % 3 = 0").select(F.concat_ws("_", F.lit("math_manual"), F.translate(F.lower("p_name"), " ", "_"), (F.col("p_partkey") % 5 + 1).cast("string")).alias("node_id"))
    return C.manual_ids(p.select(F.col("p_name").alias("display_name"), F.col("p_partkey").alias("ord")), used, "math").select("ord", "node_id")


QUERIES = {f.__name__: f for f in (completed_relations, completion_diagnostics, manual_ids, mention_canonicalize, alias_mapping, node_id_collision, type_normalize_counts, relation_profile, relation_consolidate, relation_unresolved, draft_dedup_merge, reference_resolution, subject_metadata, evidence_sanitize, evidence_anchors, formal_edges, family_classification, migrated_relations)}

COMPLETION_SQL = f"""WITH {CLAIMS_SQL},
  raw AS (SELECT CAST(source_key AS VARCHAR) AS s, relation_type AS t, CAST(target_key AS VARCHAR) AS g, confidence, ord, line, 'page:' || CAST(source_key % 97 AS VARCHAR) AS ref, source_key % 97 IN (SELECT p_partkey % 97 FROM part WHERE p_partkey % 97 % 3 <> 0) AS told,
    source_key <> target_key AND source_key IN (SELECT p_partkey FROM part WHERE p_size % 4 <> 1) AND target_key IN (SELECT p_partkey FROM part WHERE p_size % 4 <> 1) AS fits FROM claims),
  seeds AS (SELECT s, t, g, min(ref) AS ref, min(confidence) AS confidence FROM raw WHERE line = 1 GROUP BY s, t, g),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY s, t, g ORDER BY ord DESC) AS k FROM raw WHERE fits),
  final AS (SELECT s, t, g, 'llm_relation_completion' AS origin, CASE WHEN told THEN 'pending' ELSE 'needs_expert_review' END AS status, confidence, CASE WHEN told THEN ref ELSE '' END AS refs FROM ranked WHERE k = 1
    UNION ALL SELECT s, t, g, 'seed', 'accepted', confidence, ref FROM seeds x WHERE NOT EXISTS (SELECT 1 FROM ranked r WHERE r.s = x.s AND r.t = x.t AND r.g = x.g))"""

ORACLE_SQL = {
    "completed_relations": f"{COMPLETION_SQL} SELECT s AS source_node_id, t AS relation_type, g AS target_node_id, origin AS relation_source, status AS review_status, round(confidence, 6) AS confidence, refs AS evidence_refs FROM final",
    "completion_diagnostics": f"""{COMPLETION_SQL} SELECT 'raw_relation_count' AS name, count(*) AS n FROM raw UNION ALL SELECT 'invalid_endpoint_or_type_count', count(*) FROM raw WHERE NOT fits UNION ALL SELECT 'filtered_evidence_ref_count', count(*) FROM raw WHERE fits AND NOT told
      UNION ALL SELECT 'seed_relation_count', count(*) FROM seeds UNION ALL SELECT 'final_relation_count', count(*) FROM final UNION ALL SELECT 'final_type:' || t, count(*) FROM final GROUP BY t
      UNION ALL SELECT 'raw_type:' || CASE t WHEN 'progressive' THEN 'sequence' WHEN 'derives_to' THEN 'derived_from' WHEN 'explains' THEN 'related' ELSE t END, count(*) FROM raw GROUP BY t""",
    "manual_ids": """WITH p AS (SELECT p_partkey AS ord, 'math_manual_' || replace(lower(p_name), ' ', '_') AS base, p_partkey % 3 = 0 AS taken, p_partkey % 5 + 1 AS n FROM part),
      wanted AS (SELECT ord, base, row_number() OVER (PARTITION BY base ORDER BY ord) AS r FROM p), taken AS (SELECT DISTINCT base, n FROM p WHERE taken),
      numbers AS (SELECT base, unnest(range(1, k + 6)) AS n FROM (SELECT base, count(*) AS k FROM p GROUP BY base) q), free AS (SELECT base, n, row_number() OVER (PARTITION BY base ORDER BY n) AS r FROM numbers a WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.base = a.base AND t.n = a.n))
      SELECT ord, w.base || '_' || CAST(f.n AS VARCHAR) AS node_id FROM wanted w JOIN free f ON f.base = w.base AND f.r = w.r""",
    "mention_canonicalize": f"WITH {NODES_SQL} SELECT node_id, display_name, node_type, chapter, member_count, confidence, aliases, source_ids FROM canonical",
    "alias_mapping": f"""WITH {NODES_SQL},
      joined AS (SELECT n.*, c.node_id, c.member_count FROM nodes n JOIN canonical c ON n.mention = c.mention AND n.node_type = c.node_type AND n.chapter_key = c.chapter_key),
      declared AS (SELECT *, upper(display_name) AS alias FROM joined UNION ALL SELECT *, replace(display_name, ' ', '_') FROM joined UNION ALL SELECT *, display_name || ' ' || definition FROM joined)
      SELECT temporary_id, display_name AS source_mention, node_id AS canonical_node_id, 'exact_normalized_mention' AS mapping_method, CASE WHEN member_count = 1 THEN 1.0 ELSE 0.98 END::DOUBLE AS confidence, false AS needs_review FROM joined
      UNION ALL SELECT temporary_id, alias, node_id, 'declared_alias', least(1.0, greatest(0.0, confidence))::DOUBLE, confidence < 0.7 FROM declared""",
    "node_id_collision": f"WITH {NODES_SQL} SELECT node_id, node_type FROM canonical WHERE node_id <> base_id",
    "type_normalize_counts": f"""WITH {NODES_SQL}, {CLAIMS_SQL}
      SELECT 'node' AS kind, node_type AS value, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT 'relation', relation_type, count(*) FROM claims GROUP BY ALL
      UNION ALL SELECT 'status', CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'P' THEN 'needs_revision' ELSE 'pending' END, count(*) FROM orders GROUP BY ALL""",
    "relation_profile": f"""WITH {CLAIMS_SQL}
      SELECT relation_type, CASE WHEN relation_type IN ('contrast', 'parallel') THEN 'symmetric' ELSE 'directional' END AS directionality,
        CASE WHEN relation_type IN ('prerequisite', 'progressive', 'derives_to') THEN 'learning_path' ELSE 'semantic' END AS edge_scope,
        CASE relation_type WHEN 'prerequisite' THEN 90 WHEN 'progressive' THEN 80 WHEN 'derives_to' THEN 70 WHEN 'contrast' THEN 60 WHEN 'parallel' THEN 50 WHEN 'explains' THEN 10 END AS priority, count(*) AS n FROM claims GROUP BY ALL""",
    "relation_consolidate": f"""WITH {RESOLVED_SQL}
      SELECT source_id, relation_type, target_id, round(max(least(1.0, greatest(0.0, confidence))), 6) AS confidence, count(*) AS claim_count, string_agg(claim_id, '|' ORDER BY ord) AS evidence_refs, 'pending' AS review_status
      FROM ends WHERE source_id <> '' AND target_id <> '' AND source_id <> target_id GROUP BY source_id, relation_type, target_id""",
    "relation_unresolved": f"WITH {RESOLVED_SQL} SELECT claim_id, CASE WHEN source_id = '' OR target_id = '' THEN 'unresolved_end' ELSE 'self_loop' END AS reason FROM ends WHERE source_id = '' OR target_id = '' OR source_id = target_id",
    "draft_dedup_merge": r"""WITH d AS (SELECT p_partkey AS ord, trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g'), '_') AS node_id, p_brand, p_type, p_size / 50.0 AS confidence, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS reasoning FROM part),
      b AS (SELECT node_id, p_brand, min(ord) AS o FROM d GROUP BY ALL), t AS (SELECT node_id, p_type, min(ord) AS o FROM d GROUP BY ALL), f AS (SELECT node_id, arg_min(reasoning, ord) AS reasoning FROM d WHERE reasoning <> '' GROUP BY node_id),
      bs AS (SELECT node_id, string_agg(p_brand, '|' ORDER BY o) AS prerequisites FROM b GROUP BY node_id), ts AS (SELECT node_id, string_agg(p_type, '|' ORDER BY o) AS tags FROM t GROUP BY node_id),
      m AS (SELECT node_id, max(confidence) AS confidence, count(*) AS draft_count FROM d GROUP BY node_id)
      SELECT m.node_id, prerequisites, tags, confidence, draft_count, coalesce(reasoning, '') AS reasoning FROM m JOIN bs ON bs.node_id = m.node_id JOIN ts ON ts.node_id = m.node_id LEFT JOIN f ON f.node_id = m.node_id""",
    "reference_resolution": r"""WITH first AS (SELECT lower(p_name) AS name, arg_min('n' || CAST(p_partkey AS VARCHAR), p_partkey) AS node_id FROM part GROUP BY 1),
      w AS (SELECT p_partkey, p_name, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN 'N' || CAST(p_partkey AS VARCHAR) ELSE 'missing ' || p_name END AS reference FROM part)
      SELECT w.p_partkey, reference, CASE p_partkey % 3 WHEN 0 THEN f.node_id WHEN 1 THEN 'n' || CAST(p_partkey AS VARCHAR) ELSE reference END AS node_id FROM w LEFT JOIN first f ON f.name = lower(w.p_name)""",
    "subject_metadata": r"""WITH g AS (SELECT p_size % 14 AS g FROM part)
      SELECT CASE WHEN g BETWEEN 1 AND 6 THEN 'primary_school' WHEN g BETWEEN 7 AND 9 THEN 'junior_middle_school' WHEN g BETWEEN 10 AND 12 THEN 'senior_high_school' ELSE '' END AS education_stage,
        CASE WHEN g BETWEEN 1 AND 6 THEN 'g1_g6' WHEN g BETWEEN 7 AND 9 THEN 'g7_g9' WHEN g BETWEEN 10 AND 12 THEN 'g10_g12' ELSE '' END AS grade_band, count(*) AS n FROM g GROUP BY ALL""",
    "evidence_sanitize": f"""WITH {CLAIMS_SQL},
      x AS (SELECT claim_id, confidence, CAST(split_part(claim_id, '#', 1) AS BIGINT) % 50 AS a, CAST(split_part(claim_id, '#', 1) AS BIGINT) % 7 AS b FROM claims),
      k AS (SELECT *, CASE WHEN a BETWEEN 5 AND 24 THEN CAST(a AS VARCHAR) END AS ka, CASE WHEN b BETWEEN 5 AND 24 THEN CAST(b AS VARCHAR) END AS kb FROM x)
      SELECT claim_id, concat_ws('|', ka, kb) AS evidence_refs, round(CASE WHEN ka IS NULL AND kb IS NULL THEN least(confidence, 0.5) ELSE confidence END, 6) AS confidence,
        CASE WHEN ka IS NULL AND kb IS NULL THEN 'needs_expert_review' ELSE 'pending' END AS review_status, CAST((ka IS NULL)::INT + (kb IS NULL)::INT AS BIGINT) AS dropped_refs FROM k""",
    "evidence_anchors": r"""WITH x AS (SELECT item_id, 0 AS nth, 'doc:' || CAST(item_id AS VARCHAR) AS page_id, 'b1' AS block_id, item_id AS d, 40 AS w FROM benchmark WHERE item_id % 5 <> 0
        UNION ALL SELECT item_id, 1, 'doc:' || CAST(item_id + 1 AS VARCHAR), '', item_id + 1, 600 FROM benchmark WHERE item_id % 5 <> 0)
      SELECT 'b' || CAST(item_id AS VARCHAR) AS node_id, CAST(nth AS BIGINT) AS nth, page_id, block_id, md5(coalesce(substr(t.text, 1, w), '')) AS anchor_text, 0.9::DOUBLE AS confidence FROM x LEFT JOIN documents t ON t.doc_id = x.d
      UNION ALL SELECT 'b' || CAST(item_id AS VARCHAR), 0, '', '', md5(''), 0.5::DOUBLE FROM benchmark WHERE item_id % 5 = 0""",
    "formal_edges": f"""WITH {RELATIONS_SQL},
      nodes AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS node_id, CASE WHEN s_suppkey % 4 = 0 THEN 's' || CAST((s_suppkey + 4) % 40 AS VARCHAR) ELSE '' END AS parent_id, 's' || CAST(s_suppkey * 7 % 50 AS VARCHAR) AS need, CASE WHEN s_acctbal > 0 THEN 'accepted' ELSE 'needs_revision' END AS review_status FROM supplier),
      implied AS (SELECT parent_id AS source_id, node_id AS target_id, 'contains' AS relation_type, 'parent_node_id' AS relation_source, review_status FROM nodes WHERE parent_id <> '' UNION ALL SELECT need, node_id, 'prerequisite', 'prerequisite_nodes', review_status FROM nodes)
      SELECT i.* FROM implied i WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.source_id = i.source_id AND r.target_id = i.target_id AND r.relation_type = i.relation_type)
      UNION ALL SELECT source_id, target_id, relation_type, 'candidate_relations', 'accepted' FROM r
        WHERE review_status = 'accepted' AND source_id IN (SELECT node_id FROM nodes) AND target_id IN (SELECT node_id FROM nodes) GROUP BY source_id, target_id, relation_type""",
    "family_classification": f"WITH {RELATIONS_SQL} SELECT family, relation_type, count(*) AS n FROM families GROUP BY ALL",
    "migrated_relations": f"""WITH {RELATIONS_SQL} SELECT source_id, relation_type, target_id, min(family) AS family, CASE WHEN min(review_status) <> max(review_status) THEN 'needs_expert_review' ELSE min(review_status) END AS review_status, count(*) AS origin_count FROM families GROUP BY source_id, relation_type, target_id""",
}
