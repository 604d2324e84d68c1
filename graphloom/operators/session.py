"""Review sessions: folds over ordered commands, archiving with its cascade, bulk acceptance, undo by log prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import stored
from . import hierarchy, scans


def folded(log: DataFrame) -> DataFrame:
    """log (document_id, at, command_id, action, value, expected_revision) with revision, is_stale, value_after.

    A command counts if it expects the revision at hand; each that counts raises it by one. With
    expected_revision null every command counts, and the fold is a window.
    """
    w = Window.partitionBy("document_id").orderBy("at", "command_id")
    revision = F.row_number().over(w)
    return log.withColumn("revision", revision).withColumn("value_after", F.last("value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def stale(log: DataFrame) -> DataFrame:
    """(document_id, command_id, revision_before, is_stale) of a log (document_id, at, command_id, expected_revision), where a stale command changes nothing.

    Commands that expect nothing always count. Less those before it, a command expects that so many
    of the others have counted; the ones that count are the first that expects 0, the first after it
    that expects 1, and so on. So each command points to the next one in its document that expects one
    more, and who is on the way from the first is found by doubling: a document may hold any
    share of all commands, and rounds are as many as the logarithm of the longest chain.
    Commands of a null document are those of one more document.
    """
    doc = F.coalesce(F.concat(F.lit("d"), F.col("document_id").cast("string")), F.lit("-")).alias("doc")
    free = F.col("expected_revision").isNull()
    rows = scans.running(log.select("document_id", doc, "at", "command_id", "expected_revision"), ["doc"], ["at", "command_id"], free=free.cast("long"))
    rows = stored(rows.withColumn("wants", F.when(~free, F.col("expected_revision") - F.col("free")).cast("long")).drop("n", "at"), "commands")

    wants = rows.where("wants >= 0")
    node = F.concat_ws("\u001f", "doc", F.col("idx").cast("string"))
    meets = wants.select("doc", "wants", "idx", F.lit(1).alias("own")).unionByName(wants.select("doc", (F.col("wants") + 1).alias("wants"), "idx", F.lit(0).alias("own")))
    meets = meets.withColumnRenamed("idx", "at")
    met = stored(scans.running(meets, ["doc", "wants"], ["at", "own"], nth=F.col("own").cast("long")).withColumn("node", F.concat_ws("\u001f", "doc", F.col("at").cast("string"))), "expected")
    there = met.where("own = 1").select("doc", "wants", "nth", F.col("node").alias("parent"))
    onward = met.where("own = 0").select("doc", "wants", (F.col("nth") + 1).alias("nth"), F.col("node").alias("child")).join(there, ["doc", "wants", "nth"]).select("child", "parent")
    counted = hierarchy.upward(there.where("wants = 0 and nth = 1").select(F.col("parent").alias("node_id")), stored(onward, "onward"))

    done = rows.withColumn("node_id", node).join(counted.withColumn("counts", F.lit(True)), "node_id", "left").withColumn("counts", free | F.coalesce("counts", F.lit(False)))
    order = done.withColumnRenamed("idx", "place").drop("free")
    told = scans.running(order, ["doc"], ["place"], upto=F.col("counts").cast("long"))
    return told.select("document_id", "command_id", (F.col("upto") - F.col("counts").cast("long")).alias("revision_before"), (~F.col("counts")).alias("is_stale"))


def as_of(log: DataFrame, revision: int) -> DataFrame:
    """The last value of each (document_id, object_id) after so many revisions: undo is reading a shorter prefix."""
    upto = folded(log).where(F.col("revision") <= revision)
    return upto.groupBy("document_id", "object_id").agg(F.max_by("value", "revision").alias("value"))


def history(log: DataFrame, keep: int = 12) -> DataFrame:
    """The last ``keep`` commands of each document."""
    w = Window.partitionBy("document_id").orderBy(F.col("at").desc(), F.col("command_id").desc())
    return log.withColumn("steps_back", F.row_number().over(w)).where(F.col("steps_back") <= keep)


def archived(nodes: DataFrame, relations: DataFrame, scopes: DataFrame, occurrences: DataFrame, chosen: DataFrame) -> dict[str, DataFrame]:
    """All four after archiving the chosen (node_id): scopes, occurrences and incident relations go too; revisions rise, but for occurrences."""
    ids = chosen.select(F.col("node_id").alias("__id")).distinct().withColumn("__hit", F.lit(True))

    def gone(df: DataFrame, *keys: str, bump: bool = True) -> DataFrame:
        hits = None
        for i, k in enumerate(keys):
            df = df.join(ids.withColumnRenamed("__hit", f"__h{i}"), F.col(k) == F.col("__id"), "left").drop("__id")
            h = F.coalesce(F.col(f"__h{i}"), F.lit(False))
            hits = h if hits is None else hits | h
        hit = hits & (F.col("lifecycle_state") == "active")
        out = df.withColumn("__hit", hit).withColumn("lifecycle_state", F.when(F.col("__hit"), "archived").otherwise(F.col("lifecycle_state")))
        if bump:
            out = out.withColumn("revision", F.col("revision") + F.col("__hit").cast("int"))
        return out.drop("__hit", *(f"__h{i}" for i in range(len(keys))))

    return {"nodes": gone(nodes, "node_id"), "scopes": gone(scopes, "scope_id"), "occurrences": gone(occurrences, "node_id", bump=False), "relations": gone(relations, "source_id", "target_id")}


def deleted(nodes: DataFrame, relations: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, parent_id, prerequisites) and relations without the chosen, and without what refers to them."""
    ids = chosen.select("node_id").distinct()
    left = nodes.join(ids, "node_id", "left_anti")
    left = left.join(ids.select(F.col("node_id").alias("parent_id"), F.lit(True).alias("__p")), "parent_id", "left").withColumn("parent_id", F.when(F.col("__p"), "").otherwise(F.col("parent_id"))).drop("__p")
    needs = left.select("node_id", F.posexplode("prerequisites").alias("pos", "need")).join(ids.withColumnRenamed("node_id", "need"), "need", "left_anti").groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "need"))), lambda s: s["need"]).alias("__n"))
    left = left.join(needs, "node_id", "left").withColumn("prerequisites", F.coalesce("__n", F.array().cast("array<string>"))).drop("__n")
    kept = relations.join(ids.withColumnRenamed("node_id", "source_id"), "source_id", "left_anti").join(ids.withColumnRenamed("node_id", "target_id"), "target_id", "left_anti")
    return left, kept


def accepted(df: DataFrame, only: DataFrame | None = None, key: str = "node_id") -> DataFrame:
    """df with pending rows (of ``only``'s keys) accepted."""
    if only is None:
        return df.withColumn("review_status", F.when(F.col("review_status") == "pending", "accepted").otherwise(F.col("review_status")))
    hit = df.join(only.select(key).distinct().withColumn("__hit", F.lit(True)), key, "left")
    return hit.withColumn("review_status", F.when(F.col("__hit") & (F.col("review_status") == "pending"), "accepted").otherwise(F.col("review_status"))).drop("__hit")


def accepted_structure(nodes: DataFrame, relations: DataFrame, tree: DataFrame, issues: DataFrame, root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and relations after accepting a catalogue: containers of one root's tree (of all roots without one) that have no issue, and the contains relations between them.

    tree: ``hierarchy.layers`` of the nodes; issues: (node_id).
    """
    wanted = tree.where((F.col("role") != "knowledge") if root is None else (F.col("role") != "knowledge") & (F.col("root_id") == root)).join(issues.select("node_id").distinct(), "node_id", "left_anti").select("node_id")
    done = accepted(nodes, wanted)
    both = relations.where("relation_type = 'contains'").join(wanted.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi").join(wanted.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi").select("relation_id")
    return done, accepted(relations, both, "relation_id")


def upserted(state: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """state with the last change of each key in the place of its row."""
    last = changes.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).where("__k = 1").drop("__k")
    return state.join(last.select(*keys), keys, "left_anti").unionByName(last.select(*state.columns))


def overridden(edges: DataFrame, overrides: DataFrame) -> DataFrame:
    """edges (edge_id, review_status) with the statuses that overrides (edge_id, status) give them."""
    return edges.join(overrides, "edge_id", "left").withColumn("review_status", F.coalesce("status", "review_status")).drop("status")


def resynchronized(old: DataFrame, new: DataFrame) -> DataFrame:
    """New relations (relation_id, source_id, relation_type, target_id, review_status) under the ids that their facts had; old ones that are missing are archived."""
    fact = ["source_id", "relation_type", "target_id"]
    known = old.select(F.col("relation_id").alias("old_id"), *fact).groupBy(*fact).agg(F.min("old_id").alias("old_id"))
    current = new.join(known, fact, "left").withColumn("relation_id", F.coalesce("old_id", "relation_id")).drop("old_id").withColumn("lifecycle_state", F.lit("active"))
    missing = old.join(current.select("relation_id"), "relation_id", "left_anti").select(*new.columns).withColumn("lifecycle_state", F.lit("archived"))
    return current.select(*new.columns, "lifecycle_state").unionByName(missing)


# The fields that a command may change, by record type; they must be these for results to agree.
EDITABLE = {
    "node": ("display_name", "node_name", "node_type", "cognitive_level", "subject_tags", "review_status", "review_notes", "lifecycle_state"),
    "relation": ("relation_type", "review_status", "reasoning_summary", "confidence", "proposed_relation_type", "lifecycle_state"),
    "scope": ("structural_role", "reading_order", "review_status", "lifecycle_state"),
    "profile": ("target_protocol", "selected_node_ids", "selected_relation_ids", "primary_membership_by_node"),
}


def checked_commands(log: DataFrame, editable: dict[str, tuple[str, ...]] = EDITABLE) -> DataFrame:
    """log (record_type, field_name, expected_revision, revision_before, ...) with verdict: ok, stale (another revision was expected), unknown_record or field_not_editable."""
    table = F.create_map(*(x for k, v in editable.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    fields = F.try_element_at(table, F.col("record_type"))
    stale_ = F.col("expected_revision").isNotNull() & (F.col("expected_revision") != F.col("revision_before"))
    return log.withColumn("verdict", F.when(stale_, "stale").when(fields.isNull(), "unknown_record").when(~F.array_contains(fields, F.col("field_name")), "field_not_editable").otherwise("ok"))


def replaced(current: DataFrame, candidate: DataFrame, revision: int, expected_revision: int) -> tuple[DataFrame, int]:
    """(values, revision) after a whole document takes the place of another: nothing happens if both say the same, otherwise the revision rises by one. Values are those of ``merge.fields``."""
    from .merge import fingerprint

    if expected_revision != revision:
        raise ValueError(f"revision {revision}, not {expected_revision}")
    same = fingerprint(current).first()["fingerprint"] == fingerprint(candidate).first()["fingerprint"]
    return (current, revision) if same else (candidate, revision + 1)


def profiles_upserted(profiles: DataFrame, changes: DataFrame) -> DataFrame:
    """profiles (profile_id, based_on_revision, ...) with the last change of each in its place; a new one is based on the revision that its change names."""
    return upserted(profiles, changes.select(*profiles.columns, "order"), ["profile_id"], "order")


def relations_edited(relations: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """relations (relation_id, ...) with ``added`` in the place of equal ids and without ``removed`` (relation_id)."""
    left = relations.join(added.select("relation_id"), "relation_id", "left_anti").unionByName(added.select(*relations.columns))
    return left.join(removed.select("relation_id").distinct(), "relation_id", "left_anti")
