"""The domain's tables, read from a star schema with events, documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import scans


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: p_type and o_orderpriority stand in for raw node types and statuses.
RAW_TYPES = {"ECONOMY": "knowledge_point", "LARGE": "theorem", "MEDIUM": "skill", "PROMO": "example", "SMALL": "principle", "STANDARD": " Model "}
RAW_RELATIONS = {"AF": "prerequisite", "AO": "sequence", "NF": "derived_from", "NO": "related", "RF": "contrast", "RO": "parallel"}
RAW_STATUSES = {"F": "approved", "O": "pending", "P": "needs_review"}


def local_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node candidates: (temporary_id, display_name, node_type, chapter, section, definition, confidence, aliases, evidence_refs, ord)."""
    p = table(spark, sf_dir, "part")
    raw = F.create_map(*(F.lit(x) for kv in RAW_TYPES.items() for x in kv))
    return p.select(
        F.col("p_partkey").cast("string").alias("temporary_id"), F.col("p_name").alias("display_name"), F.coalesce(raw[F.col("p_type")], F.lit("other")).alias("node_type"),
        F.col("p_brand").alias("chapter"), F.lit("").alias("section"), F.col("p_type").alias("definition"), (F.col("p_size") / 50.0).alias("confidence"),
        F.array(F.upper("p_name"), F.translate("p_name", " ", "_"), F.concat(F.col("p_name"), F.lit(" "), F.col("p_type"))).alias("aliases"),
        F.array(F.concat(F.lit("page:"), (F.col("p_partkey") % 97).cast("string"))).alias("evidence_refs"), F.col("p_partkey").alias("ord"),
    )


def local_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relation claims: within an order each line's part leads to the next one's."""
    line = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")
    raw = F.create_map(*(F.lit(x) for kv in RAW_RELATIONS.items() for x in kv))
    claim = line.select(
        "l_orderkey", F.row_number().over(w).alias("line"), F.col("l_partkey").alias("source_key"), F.lead("l_partkey").over(w).alias("target_key"),
        raw[F.concat("l_returnflag", "l_linestatus")].alias("relation_type"), (F.col("l_discount") * 10).alias("confidence"),
    ).withColumn("claim_id", F.concat_ws("#", F.col("l_orderkey").cast("string"), F.col("line").cast("string"))).withColumnRenamed("l_orderkey", "order_key")
    return claim.where(F.col("target_key").isNotNull())


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page evidence of books: (book, page_index, page_id, text, image_sha256, doc_id). A source is a book; its documents are its pages in order."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("book"), "doc_id", "text")
    placed = scans.running(d, ["book"], ["doc_id"]).withColumn("page_index", F.col("idx").cast("int"))
    return placed.select("book", "page_index", "doc_id", "text", F.concat_ws(":", "book", F.lit("page"), F.col("page_index").cast("string")).alias("page_id"), F.sha2("text", 256).alias("image_sha256"))


def forest_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, suppliers and customers as (node_id, parent_id, display_name, node_type)."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    ident = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    row = lambda df, a, b, name, kind: df.select(a.alias("node_id"), b.alias("parent_id"), F.col(name).alias("display_name"), F.lit(kind).alias("node_type"))
    return (
        row(r, ident("r", "r_regionkey"), F.lit(""), "r_name", "chapter")
        .union(row(n, ident("n", "n_nationkey"), ident("r", "n_regionkey"), "n_name", "section"))
        .union(row(s, ident("s", "s_suppkey"), ident("n", "s_nationkey"), "s_name", "concept"))
        .union(row(c, ident("c", "c_custkey"), ident("n", "c_nationkey"), "c_name", "method"))
    )
