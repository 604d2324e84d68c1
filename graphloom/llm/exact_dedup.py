"""Exact copies: rows meet by a 128-bit hash of their normalised text, the smallest id stays, and bytes are compared inside groups.

Only digests are shuffled for all rows (hash, id, row number). Texts move once more for rows that
share their hash with another row, and copies are merged in each task before they are sent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import measured, stored
from .exchange import id_filter, partitions, with_maybe

#: A group of more than 1 / (HOT * shuffle partitions) of all rows is hot; so there are fewer than HOT * partitions of them.
HOT = 8
_SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _SPACES, " ")


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _groups(digests: DataFrame, *keys: str) -> DataFrame:
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id"), "row")).alias("first")
    return digests.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), first)


def _bits(df: DataFrame, key: Column) -> DataFrame:
    return id_filter(df.select(key.alias("doc_id")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): a row for each row of docs.

    Texts are equal when they are the same bytes after ``normalised``. Of equal texts the row with
    the smallest id stays; a null id comes after all others, and of several rows with that id and
    text exactly one is kept. Null, empty and blank texts: null and empty are the same text, a
    blank one is one space. Texts are taken whole, whatever their length. An empty table gives no
    rows; other columns are ignored.

    Groups of one hash are compared byte by byte. If a group holds different texts, these are
    kept apart by their SHA-256, after the comparison has shown that no two of them share it
    (else ValueError). Rows of hot groups learn about their group by a broadcast of at most
    HOT * shuffle partitions rows, all others by a shuffle of those that a bitmap lets through.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = rows.withColumn("text", normalised(F.col("text")))
    digests, seen = measured(
        texts.select("doc_id", hash_of(F.col("text")).alias("h"), F.unhex(F.sha2("text", 256)).alias("s"), F.monotonically_increasing_id().alias("row")), "digests", n=F.count(F.lit(1))
    )
    groups = stored(_groups(digests, "h").where("n > 1"), "groups")

    # Rows that surely share no hash are done.
    by_hash = with_maybe(digests.select(F.xxhash64("h").alias("doc_id"), F.col("doc_id").alias("id"), "h", "s", "row"), _bits(groups, F.xxhash64("h"))).drop("doc_id")

    # The comparison: distinct texts of each hash among the rows whose ids are in question.
    asked = _bits(by_hash.where("__maybe"), F.coalesce("id", F.lit(0)))
    read = with_maybe(rows.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "text"), asked).where("__maybe").select(normalised(F.col("text")).alias("text"))
    differing = read.groupBy(hash_of(F.col("text")).alias("h"), "text").agg(F.count(F.lit(1)).alias("n"))
    named = differing.groupBy("h", F.sha2("text", 256).alias("s")).agg(F.count(F.lit(1)).alias("texts"))
    split = named.groupBy("h").agg(F.sum("texts").alias("texts"), F.max("texts").alias("alike")).where("texts > 1")
    split, found = measured(split, "collisions", n=F.count(F.lit(1)), alike=F.max("alike"))
    if (found["alike"] or 1) > 1:
        raise ValueError("two different texts share both digests")

    classes = groups.withColumn("class", F.lit(None).cast("binary"))
    if found["n"]:
        apart = _groups(digests.join(split, "h", "left_semi"), "h", "s").withColumnRenamed("s", "class")
        classes = stored(classes.join(split, "h", "left_anti").unionByName(apart), "classes")
    classes = classes.select(F.col("h").alias("ch"), "class", "n", "first")
    hot = F.col("n") * (HOT * partitions(spark)) > F.lit(seen["n"] or 0)
    same = (F.col("h") == F.col("ch")) & (F.col("class").isNull() | (F.col("class") == F.col("s")))

    first_pass = by_hash.join(F.broadcast(classes.where(hot)), same, "left")
    done = ~F.col("__maybe") | F.col("ch").isNotNull()
    rest = first_pass.where(~done).select("id", "h", "s", "row").join(classes.where(~hot), same, "left")
    out = first_pass.where(done).drop("__maybe").unionByName(rest)
    alone = F.col("n").isNull()
    return out.select(
        F.col("id").alias("doc_id"), F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("first.row") == F.col("row"))).alias("kept"), F.lower(F.hex("s")).alias("text_sha256"),
    )
