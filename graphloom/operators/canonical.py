"""Canonical nodes, their aliases, and the consolidation of relation claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def grouped(nodes: DataFrame) -> DataFrame:
    """nodes with their group: normalised name, type and normalised chapter. Nodes without a name are dropped."""
    named = nodes.withColumn("display_name", T.trimmed(F.col("display_name"))).where(F.col("display_name") != "")
    return named.withColumn("mention", T.mention(F.col("display_name"))).withColumn("node_type", T.node_type(F.col("node_type"))).withColumn("chapter_key", T.mention(F.col("chapter")))


KEY = ("mention", "node_type", "chapter_key")


def ordered(column: str, order: str = "ord"):
    """A list column's values in row order, each once."""
    rows = F.array_sort(F.collect_list(F.struct(order, column)))
    return T.ordered_unique(F.flatten(F.transform(rows, lambda r: r[column])) if column in ("aliases", "evidence_refs") else F.transform(rows, lambda r: r[column]))


def canonical_nodes(nodes: DataFrame, subject: str = "", grade: str = "", term: str = "") -> DataFrame:
    """One node for each group.

    The representative has the greatest confidence, then the longest definition, then comes first.
    confidence is the mean; ids that collide get their type, then a number, in the order of groups.
    """
    lit = F.lit
    best = F.max_by(F.struct("display_name", "chapter", "section", "definition"), F.struct(F.col("confidence"), F.length("definition"), -F.col("ord")))
    got = grouped(nodes).groupBy(*KEY).agg(
        best.alias("best"), F.round(F.avg(T.clamped(F.col("confidence"))), 3).alias("confidence"), F.count(lit(1)).alias("member_count"),
        ordered("temporary_id").alias("source_ids"), ordered("evidence_refs").alias("evidence_refs"),
        F.array_sort(F.collect_list(F.struct("ord", F.concat(F.array("display_name"), "aliases").alias("names")))).alias("names"),
    )
    got = got.select(*KEY, "best.*", "confidence", "member_count", "source_ids", "evidence_refs", "names")
    got = got.withColumn("aliases", F.filter(T.ordered_unique(F.flatten(F.transform("names", lambda r: r["names"]))), lambda a: T.mention(a) != F.col("mention"))).drop("names")
    base = T.node_id(lit(subject), lit(grade), lit(term), F.col("chapter"), T.slug(F.col("display_name")))
    got = got.withColumn("node_name", T.slug(F.col("display_name"))).withColumn("base_id", base)
    return decollided(got)


def decollided(nodes: DataFrame) -> DataFrame:
    """nodes (base_id, node_type, KEY) with a node_id of their own: base, base_type, base_type_2, ... in the order of KEY."""
    order = Window.partitionBy("base_id").orderBy("mention", "node_type", "chapter_key")
    first = nodes.withColumn("nth", F.row_number().over(order)).withColumn("typed", F.when(F.col("nth") == 1, F.col("base_id")).otherwise(F.concat_ws("_", "base_id", "node_type")))
    again = Window.partitionBy("typed").orderBy("nth", "mention", "node_type", "chapter_key")
    k = F.row_number().over(again)
    return first.withColumn("node_id", F.when(k == 1, F.col("typed")).otherwise(F.concat(F.col("typed"), F.lit("_"), k.cast("string")))).drop("nth", "typed", "base_id")


def alias_mappings(nodes: DataFrame, canonical: DataFrame) -> DataFrame:
    """(temporary_id, source_mention, canonical_node_id, mapping_method, confidence, needs_review): a row for each member, and for each of its declared aliases."""
    joined = grouped(nodes).join(canonical.select(*KEY, "node_id", "member_count"), list(KEY))
    exact = joined.select("temporary_id", F.col("display_name").alias("source_mention"), F.col("node_id").alias("canonical_node_id"), F.lit("exact_normalized_mention").alias("mapping_method"), F.when(F.col("member_count") == 1, 1.0).otherwise(0.98).alias("confidence"), F.lit(False).alias("needs_review"))
    declared = joined.withColumn("alias", F.explode(T.clean_list(F.col("aliases")))).select("temporary_id", F.col("alias").alias("source_mention"), F.col("node_id").alias("canonical_node_id"), F.lit("declared_alias").alias("mapping_method"), T.clamped(F.col("confidence")).alias("confidence"), (F.col("confidence") < 0.7).alias("needs_review"))
    return exact.unionByName(declared)


def mention_index(canonical: DataFrame, mappings: DataFrame) -> DataFrame:
    """(mention, node_id) for mentions that name exactly one canonical node."""
    own = canonical.select("node_id", F.explode(F.concat(F.array("display_name", "node_name"), "aliases")).alias("name"))
    mapped = mappings.select(F.col("canonical_node_id").alias("node_id"), F.col("source_mention").alias("name"))
    names = own.unionByName(mapped).select("node_id", T.mention(F.col("name")).alias("mention")).where("mention <> ''")
    return names.groupBy("mention").agg(F.min("node_id").alias("node_id"), F.max("node_id").alias("other")).where("node_id = other").drop("other")


def resolved(claims: DataFrame, mappings: DataFrame, index: DataFrame) -> DataFrame:
    """claims (source_temporary_id, source_mention, target_..., relation_type) with source_id, target_id and relation type normalised; empty where an end isn't unique."""
    by_id = mappings.groupBy("temporary_id").agg(F.max("canonical_node_id").alias("by_id"))
    for side in ("source", "target"):
        claims = claims.join(by_id.withColumnRenamed("temporary_id", f"{side}_temporary_id").withColumnRenamed("by_id", f"{side}_by_id"), f"{side}_temporary_id", "left")
        claims = claims.withColumn(f"{side}_key", T.mention(F.col(f"{side}_mention")))
        claims = claims.join(index.withColumnRenamed("mention", f"{side}_key").withColumnRenamed("node_id", f"{side}_by_name"), f"{side}_key", "left")
        claims = claims.withColumn(f"{side}_id", F.coalesce(f"{side}_by_id", f"{side}_by_name", F.lit(""))).drop(f"{side}_by_id", f"{side}_by_name", f"{side}_key")
    return claims.withColumn("relation_type", T.relation_type(F.col("relation_type")))


def is_resolved():
    return (F.col("source_id") != "") & (F.col("target_id") != "") & (F.col("relation_type") != "") & (F.col("source_id") != F.col("target_id"))


def consolidated(claims: DataFrame) -> DataFrame:
    """Resolved claims, one row for each (source, type, target): references in order, the greatest confidence; a claim for experts makes all so."""
    c = claims.where(is_resolved()).withColumn("status", F.when((F.col("evidence_type") == "model_inferred") & (F.size("evidence_refs") == 0), "needs_expert_review").otherwise(F.col("review_status")))
    rows = F.array_sort(F.collect_list(F.struct("ord", "evidence_refs", "status", "evidence_text")))
    got = c.groupBy("source_id", "relation_type", "target_id").agg(rows.alias("rows"), F.max(T.clamped(F.col("confidence"))).alias("confidence"), F.max(F.col("status") == "needs_expert_review").alias("expert"), F.count(F.lit(1)).alias("claim_count"))
    return got.select(
        "source_id", "relation_type", "target_id", "confidence", "claim_count",
        T.ordered_unique(F.flatten(F.transform("rows", lambda r: r["evidence_refs"]))).alias("evidence_refs"),
        F.array_join(T.ordered_unique(F.transform("rows", lambda r: r["evidence_text"])), "；").alias("evidence_text"),
        F.when(F.col("expert"), "needs_expert_review").otherwise(F.col("rows")[0]["status"]).alias("review_status"),
    )


def reference_index(drafts: DataFrame) -> DataFrame:
    """(reference, node_id): ids, names and display names, as they are and in lower case; the first draft that claims one has it.

    drafts: (ord, node_id, node_name, display_name). Keys are sorted before they are merged, so drafts
    are dealt over all partitions first, however few files they came in.
    """
    drafts = drafts.repartition(max(1, int(drafts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    keys = F.flatten(F.array(*(F.array(T.trimmed(F.col(c)), F.lower(T.trimmed(F.col(c)))) for c in ("node_id", "node_name", "display_name"))))
    rows = drafts.select("ord", "node_id", F.posexplode(keys).alias("pos", "reference")).where("reference <> ''")
    return rows.groupBy("reference").agg(F.min_by("node_id", F.struct("ord", "pos")).alias("node_id"))


def resolve_reference(df: DataFrame, column: str, index: DataFrame, to: str) -> DataFrame:
    """The node that a reference names, raw or in lower case; else the reference itself."""
    raw = T.trimmed(F.col(column))
    a, b = index.select(F.col("reference").alias("__a"), F.col("node_id").alias("__x")), index.select(F.col("reference").alias("__b"), F.col("node_id").alias("__y"))
    out = df.withColumn("__r", raw).join(a, F.col("__r") == F.col("__a"), "left").join(b, F.lower("__r") == F.col("__b"), "left")
    return out.withColumn(to, F.coalesce("__x", "__y", "__r")).drop("__r", "__a", "__b", "__x", "__y")


def merged_drafts(drafts: DataFrame) -> DataFrame:
    """Drafts (ord, node_id, prerequisites, tags, confidence, reasoning) by node: lists in order without repeats, the greatest confidence, the first reasoning given."""
    rows = F.array_sort(F.collect_list(F.struct("ord", "prerequisites", "tags", "reasoning")))
    got = drafts.groupBy("node_id").agg(rows.alias("rows"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("draft_count"))
    pick = lambda name: T.ordered_unique(F.flatten(F.transform("rows", lambda r: r[name])))
    said = F.filter(F.transform("rows", lambda r: r["reasoning"]), lambda x: x != "")
    return got.select("node_id", pick("prerequisites").alias("prerequisites"), pick("tags").alias("tags"), "confidence", "draft_count", F.coalesce(F.get(said, 0), F.lit("")).alias("reasoning"))


def formal_edges(nodes: DataFrame, relations: DataFrame, statuses: tuple[str, ...] = ("accepted",)) -> DataFrame:
    """(source_id, target_id, relation_type, relation_source, review_status) of a formal graph.

    nodes: (node_id, parent_id, prerequisites, review_status); relations: (source_id, target_id,
    relation_type, review_status, ord). A parent or prerequisite makes an edge unless a relation,
    of whatever status, says the same; of relations with an eligible status the last one stays.
    """
    r = relations.withColumn("relation_type", T.relation_type(F.col("relation_type"))).withColumn("review_status", T.review_status(F.col("review_status"))).where("source_id <> '' and target_id <> '' and relation_type <> ''")
    said = r.select("source_id", "target_id", "relation_type").distinct()
    status = T.review_status(F.col("review_status"))
    parent = nodes.where("parent_id <> ''").select(F.col("parent_id").alias("source_id"), F.col("node_id").alias("target_id"), F.lit("contains").alias("relation_type"), F.lit("parent_node_id").alias("relation_source"), status.alias("review_status"))
    needs = nodes.select(F.explode("prerequisites").alias("source_id"), F.col("node_id").alias("target_id"), F.lit("prerequisite").alias("relation_type"), F.lit("prerequisite_nodes").alias("relation_source"), status.alias("review_status"))
    implied = parent.unionByName(needs).dropDuplicates(["source_id", "target_id", "relation_type"]).join(said, ["source_id", "target_id", "relation_type"], "left_anti")
    known = nodes.select("node_id")
    explicit = r.where(F.col("review_status").isin(*statuses)).join(known.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi").join(known.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi")
    explicit = explicit.groupBy("source_id", "target_id", "relation_type").agg(F.max_by("review_status", "ord").alias("review_status")).withColumn("relation_source", F.lit("candidate_relations"))
    return implied.unionByName(explicit)


def migrated_relations(relations: DataFrame, scopes: DataFrame) -> DataFrame:
    """relations (source_id, target_id, relation_type, review_status, ord) with their family, one for each fact; where statuses disagree an expert must look."""
    r = classified(relations, scopes)
    return r.groupBy("source_id", "relation_type", "target_id").agg(
        F.min("family").alias("family"), F.when(F.min("review_status") != F.max("review_status"), "needs_expert_review").otherwise(F.min("review_status")).alias("review_status"), F.count(F.lit(1)).alias("origin_count")
    )


def classified(relations: DataFrame, scopes: DataFrame) -> DataFrame:
    """relations with family: contains between scopes is structure, from a scope to another node membership, otherwise unresolved; all else is semantic. scopes: (node_id), each once."""
    s = scopes.select(F.col("node_id").alias("__s"))
    out = relations.join(s, F.col("source_id") == F.col("__s"), "left").withColumn("__a", F.col("__s").isNotNull()).drop("__s")
    out = out.join(s, F.col("target_id") == F.col("__s"), "left").withColumn("__b", F.col("__s").isNotNull()).drop("__s")
    family = F.when(F.col("relation_type") != "contains", "semantic").when(F.col("__a") & F.col("__b"), "structure").when(F.col("__a"), "membership").otherwise("unresolved")
    return out.withColumn("family", family).drop("__a", "__b")


def sanitized(claims: DataFrame, allowed: DataFrame) -> DataFrame:
    """claims (claim_id, evidence_refs, confidence, review_status) with only references that exist; a claim that is left without any is doubted. allowed: (ref)."""
    refs = claims.select("claim_id", F.posexplode("evidence_refs").alias("pos", "ref")).join(allowed.distinct(), "ref", "left_semi")
    kept = refs.groupBy("claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref"))), lambda r: r["ref"]).alias("kept"))
    out = claims.join(kept, "claim_id", "left").withColumn("kept", F.coalesce("kept", F.array().cast("array<string>")))
    bare = F.size("kept") == 0
    return out.withColumn("dropped_refs", F.size("evidence_refs") - F.size("kept")).withColumn("evidence_refs", F.col("kept")).withColumn("confidence", F.when(bare, F.least("confidence", F.lit(0.5))).otherwise(F.col("confidence"))).withColumn("review_status", F.when(bare, "needs_expert_review").otherwise(F.col("review_status"))).drop("kept")


def evidence_anchors(nodes: DataFrame, pages: DataFrame, width: int = 600) -> DataFrame:
    """(node_id, nth, page_id, block_id, anchor_text, confidence): an anchor for each reference page#block of nodes (node_id, evidence_refs, confidence); a node without one gets itself, at half confidence at most.

    pages: (page_id, block_id, text); block_id is empty for the page as a whole.
    """
    refs = nodes.select("node_id", "confidence", F.posexplode_outer("evidence_refs").alias("nth", "ref"))
    split = refs.withColumn("page_id", F.split_part("ref", F.lit("#"), F.lit(1))).withColumn("block_id", F.split_part("ref", F.lit("#"), F.lit(2)))
    found = split.join(pages, ["page_id", "block_id"], "left")
    return found.select("node_id", F.coalesce("nth", F.lit(0)).alias("nth"), F.coalesce("page_id", F.lit("")).alias("page_id"), F.coalesce("block_id", F.lit("")).alias("block_id"), F.substring(F.coalesce("text", F.lit("")), 1, width).alias("anchor_text"), F.when(F.col("ref").isNull(), F.least("confidence", F.lit(0.5))).otherwise(F.col("confidence")).alias("confidence"))


def manual_ids(drafts: DataFrame, used: DataFrame, prefix: str) -> DataFrame:
    """drafts (display_name, ord) with node_id: prefix_manual_name_n, n the first numbers that ``used`` (node_id) leaves free, in the order of ord.

    The r-th free number of a name is at most r plus how many of its numbers are taken, so each
    name's numbers are counted up to there and the taken ones left out.
    """
    part = F.substring(F.regexp_replace(F.regexp_replace(F.lower(T.trimmed(F.col("display_name"))), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", ""), 1, 48)
    named = drafts.withColumn("base", F.concat_ws("_", F.lit(prefix), F.lit("manual"), F.when(part == "", "manual_node").otherwise(part)))
    named = named.withColumn("r", F.row_number().over(Window.partitionBy("base").orderBy("ord", "display_name")))
    taken = used.select("node_id", F.regexp_extract("node_id", r"^(.*)_([1-9]\d{0,8})$", 1).alias("base"), F.regexp_extract("node_id", r"^(.*)_([1-9]\d{0,8})$", 2).try_cast("int").alias("n")).where("base <> ''").select("base", "n").distinct()
    # Taken numbers less the free ones before them: the r-th free one comes after all with fewer than r before.
    taken = taken.withColumn("free_before", F.col("n") - F.row_number().over(Window.partitionBy("base").orderBy("n")))
    ahead = named.join(taken, "base").where("free_before < r").groupBy("base", "r").agg(F.count(F.lit(1)).alias("skipped"))
    out = named.join(ahead, ["base", "r"], "left")
    return out.withColumn("node_id", F.concat_ws("_", "base", (F.col("r") + F.coalesce("skipped", F.lit(0))).cast("string"))).select(*drafts.columns, "node_id")


def occurrence_rows(nodes: DataFrame, owners: DataFrame) -> DataFrame:
    """(node_id, chapter, section, temporary_id, place): where each canonical node occurs, each place once, in the order of ord.

    nodes: (temporary_id, chapter, section, ord); owners: (temporary_id, node_id).
    """
    seen = nodes.join(owners, "temporary_id").groupBy("node_id", "chapter", "section", "temporary_id").agg(F.min("ord").alias("ord"))
    return seen.withColumn("place", F.row_number().over(Window.partitionBy("node_id").orderBy("ord", "temporary_id")) - 1).drop("ord")
