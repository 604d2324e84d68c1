"""Field-level three-way merges of documents, kept as tables of (record_type, object_id, field_name, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

KEY = ["record_type", "object_id", "field_name"]


def fields(df: DataFrame, record_type: str, id_col: str, columns: list[str]) -> DataFrame:
    """A row for each field of each object; null is the empty value."""
    pairs = F.array(*(F.struct(F.lit(c).alias("field_name"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in columns))
    return df.select(F.lit(record_type).alias("record_type"), F.col(id_col).cast("string").alias("object_id"), F.explode(pairs).alias("f")).select("record_type", "object_id", "f.*")


def baseline(values: DataFrame, export_id: str, revision: int) -> DataFrame:
    return values.select(F.lit(export_id).alias("base_export_id"), F.lit(revision).alias("base_revision"), *KEY, "value", F.sha2("value", 256).alias("field_sha256"))


def checked(rows: DataFrame) -> DataFrame:
    """The baseline's rows, or an error where a hash doesn't fit or an identity is missing."""
    bad = (F.sha2("value", 256) != F.col("field_sha256")) | (F.col("record_type") == "") | (F.col("object_id") == "") | (F.col("field_name") == "")
    return rows.withColumn("value", F.when(bad, F.raise_error(F.concat_ws("/", F.lit("baseline doesn't fit its hash:"), *KEY))).otherwise(F.col("value")))


def plan(base: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """(KEY, base, local, remote, outcome) of all fields that a remote document changes.

    outcome: change (local is as it was), conflict, new_object, new_object_conflict, or
    ignored_delete (remote lacks what the base has; deleting takes a command).
    """
    side = lambda df, name: df.select(*KEY, F.col("value").alias(name))
    all_ = side(base, "base").join(side(local, "local"), KEY, "full").join(side(remote, "remote"), KEY, "full")
    same = lambda a, b: T.canonical_json(F.col(a)).eqNullSafe(T.canonical_json(F.col(b)))
    has = lambda c: F.col(c).isNotNull()
    outcome = (
        F.when(has("base") & ~has("remote"), "ignored_delete")
        .when(~has("remote"), None)
        .when(~has("base") & ~has("local"), "new_object")
        .when(~has("base") & ~same("local", "remote"), "new_object_conflict")
        .when(~has("base"), None)
        .when(same("remote", "base"), None)
        .when(has("local") & same("local", "base"), "change")
        .when(same("local", "remote"), None)
        .otherwise("conflict")
    )
    return all_.withColumn("outcome", outcome).where("outcome is not null")


def status(planned: DataFrame) -> DataFrame:
    return planned.agg(F.coalesce(F.max(F.col("outcome").isin("conflict", "new_object_conflict")), F.lit(False)).alias("c")).select(F.when(F.col("c"), "conflicts").otherwise("ready").alias("status"))


def resolved(planned: DataFrame, use_remote: bool) -> DataFrame:
    """Conflicts as changes, or without them."""
    conflict = F.col("outcome").isin("conflict", "new_object_conflict")
    return planned.withColumn("outcome", F.when(conflict, "change").otherwise(F.col("outcome"))) if use_remote else planned.where(~conflict)


def applied(local: DataFrame, planned: DataFrame, content: tuple[str, ...] = (), status_field: str = "review_status") -> DataFrame:
    """local with the plan's changes; an accepted object whose content changed needs revision."""
    new = planned.where(F.col("outcome").isin("change", "new_object")).select(*KEY, F.col("remote").alias("new"))
    merged = local.join(new, KEY, "full").select(*KEY, F.coalesce("new", "value").alias("value"))
    edited = new.where(F.col("field_name").isin(*content)).select("record_type", "object_id").distinct().withColumn("edited", F.lit(True)) if content else None
    if edited is None:
        return merged
    reset = F.col("edited") & (F.col("field_name") == status_field) & (F.col("value") == "accepted")
    return merged.join(edited, ["record_type", "object_id"], "left").withColumn("value", F.when(reset, "needs_revision").otherwise(F.col("value"))).drop("edited")


def revised(local: DataFrame, planned: DataFrame, revision: int, expected_revision: int, **options) -> tuple[DataFrame, int]:
    """(values, revision) after applying a plan to the revision that it was made for; conflicts that are open, or another revision, are errors."""
    if expected_revision != revision:
        raise ValueError(f"revision {revision}, not {expected_revision}")
    if not planned.where(F.col("outcome").isin("conflict", "new_object_conflict")).isEmpty():
        raise ValueError("the plan has open conflicts")
    return applied(local, planned, **options), revision + 1


def fingerprint(values: DataFrame) -> DataFrame:
    """(fingerprint): equal for equal documents, whatever the order of rows. Rows are hashed and added up, so it takes no sort and no single list."""
    h = F.sha2(F.concat_ws("\u001f", *KEY, T.canonical_json(F.col("value"))), 256)
    parts = [F.sum(F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(4)]
    return values.agg(*parts, F.count(F.lit(1)).alias("n")).select(F.sha2(F.concat_ws("|", *(F.coalesce(F.col(f"p{i}"), F.lit(0)).cast("string") for i in range(4)), F.col("n").cast("string")), 256).alias("fingerprint"))
