"""Completing relations between canonical nodes: what a model is asked, and what of its answers stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import vocab

ANSWER = "array<struct<source_node_id:string,target_node_id:string,relation_type:string,evidence_type:string,inference_scope:string,evidence_refs:array<string>,evidence_text:string,confidence:double,reasoning_summary:string,review_status:string>>"
#: Page index of a page that isn't in the book.
_FAR = 10**9


def page_payloads(pages: DataFrame) -> DataFrame:
    """(page_id, payload): what a prompt says of a page, as JSON; its blocks with their references, or its text if it has none.

    pages: (page_id, page_index, printed_page_number, ocr_status, requires_visual_review,
    source_text, blocks array<struct<block_id, text, confidence, bbox>>).
    """
    blocks = F.coalesce("blocks", F.array().cast("array<struct<block_id:string,text:string,confidence:double,bbox:array<double>>>"))
    shown = F.transform(blocks, lambda b: F.struct(F.concat_ws("#", F.col("page_id"), b["block_id"]).alias("evidence_ref"), b["text"].alias("text"), b["confidence"].alias("confidence"), b["bbox"].alias("bbox")))
    text = F.when(F.size(blocks) == 0, F.coalesce("source_text", F.lit(""))).otherwise("")
    return pages.select("page_id", F.to_json(F.struct("page_id", "page_index", "printed_page_number", "ocr_status", "requires_visual_review", text.alias("text"), shown.alias("blocks"))).alias("payload"))


def completion_groups(nodes: DataFrame, pages: DataFrame, chapters: DataFrame, size: int = 80) -> tuple[DataFrame, DataFrame]:
    """((chapter_key, chunk_no, node_id), (chapter_key, chunk_no, page_id, place)): nodes of a chapter in chunks of ``size``, each chunk of two or more with its pages.

    nodes: (node_id, chapter, evidence_refs, ord); pages: (page_id, page_index); chapters: (title,
    start_page, end_page, ord) of one book. A chunk has the pages that its nodes refer to; without
    any, those of the first chapter whose title contains its name or is contained in it; without
    that, all pages, if the nodes are of one chapter.
    """
    key = F.when(T.mention(F.col("chapter")) == "", "selected_scope").otherwise(T.mention(F.col("chapter")))
    rank = F.row_number().over(Window.partitionBy("chapter_key").orderBy("ord", "node_id")) - 1
    dealt = nodes.withColumn("chapter_key", key).withColumn("chunk_no", F.floor(rank / size))
    many = dealt.groupBy("chapter_key", "chunk_no").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("chapter_key", "chunk_no")
    dealt = dealt.join(many, ["chapter_key", "chunk_no"], "left_semi")
    refs = dealt.select("chapter_key", "chunk_no", F.explode("evidence_refs").alias("ref")).select("chapter_key", "chunk_no", F.split_part("ref", F.lit("#"), F.lit(1)).alias("page_id")).distinct()
    named = refs.join(pages, "page_id").select("chapter_key", "chunk_no", "page_id", "page_index")
    bare = many.join(named, ["chapter_key", "chunk_no"], "left_anti")
    # A book has few chapters, so titles are held against chapter names one by one.
    title = T.mention(F.col("title"))
    match = F.contains(title, F.col("chapter_key")) | F.contains(F.col("chapter_key"), title)
    ranges = bare.select("chapter_key").distinct().join(chapters, match).groupBy("chapter_key").agg(F.min_by(F.struct("start_page", "end_page"), "ord").alias("r"))
    told = bare.join(ranges, "chapter_key").join(pages, F.col("page_index").between(F.col("r.start_page"), F.col("r.end_page"))).select("chapter_key", "chunk_no", "page_id", "page_index")
    single = dealt.agg((F.count_distinct("chapter_key") == 1).alias("one")).scalar()
    whole = bare.join(told, ["chapter_key", "chunk_no"], "left_anti").where(single).withColumn("k", F.lit(1)).join(pages.withColumn("k", F.lit(1)), "k").select("chapter_key", "chunk_no", "page_id", "page_index")
    found = named.unionByName(told).unionByName(whole)
    place = F.row_number().over(Window.partitionBy("chapter_key", "chunk_no").orderBy("page_index", "page_id")) - 1
    return dealt.select("chapter_key", "chunk_no", "node_id"), found.select("chapter_key", "chunk_no", "page_id", place.alias("place"))


def completed(seeds: DataFrame, answers: DataFrame, nodes: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relations, diagnostics): seed relations with a model's completions in their place.

    seeds: (source_node_id, relation_type, target_node_id, evidence_type, inference_scope,
    evidence_refs, evidence_text, confidence, reasoning_summary, relation_source, review_status);
    answers: (answer_id, answer) with ANSWER's JSON; nodes: (node_id) that may be ends; refs:
    (evidence_ref) that may be named. Ends that are missing or the same, and relations without a
    type, are dropped and counted; unknown references are dropped and counted; a relation without
    any left goes to expert review. Of equal facts the last answer stays, and before the seed.
    """
    t = lambda c: T.trimmed(F.coalesce(F.col(c), F.lit("")))
    raw = answers.select("answer_id", F.posexplode(F.from_json("answer", ANSWER)).alias("pos", "r")).select("answer_id", "pos", "r.*")
    raw = raw.withColumn("source_node_id", t("source_node_id")).withColumn("target_node_id", t("target_node_id")).withColumn("raw_type", F.coalesce("relation_type", F.lit("unknown"))).withColumn("relation_type", F.nullif(T.relation_type(F.col("relation_type")), F.lit("")))
    known = lambda c: nodes.select(F.col("node_id").alias(c), F.lit(True).alias(f"has_{c}")).distinct()
    raw = raw.join(known("source_node_id"), "source_node_id", "left").join(known("target_node_id"), "target_node_id", "left")
    fits = F.coalesce(F.col("has_source_node_id") & F.col("has_target_node_id") & (F.col("source_node_id") != F.col("target_node_id")) & F.col("relation_type").isNotNull(), F.lit(False))
    raw = raw.withColumn("fits", fits)
    kept = raw.where("fits").select("answer_id", "pos", F.posexplode_outer("evidence_refs").alias("at", "evidence_ref")).join(refs.select("evidence_ref", F.lit(True).alias("ok")).distinct(), "evidence_ref", "left")
    kept = kept.groupBy("answer_id", "pos").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("ok"), F.struct("at", "evidence_ref")))), lambda s: s["evidence_ref"]).alias("allowed"), F.count("evidence_ref").alias("named"))
    new = raw.where("fits").join(kept, ["answer_id", "pos"])
    among = lambda c, values, other: F.when(F.col(c).isin(*values), F.col(c)).otherwise(other)
    status = F.when(F.size("allowed") == 0, "needs_expert_review").otherwise(F.coalesce("review_status", F.lit("pending")))
    new = new.select(
        "source_node_id", "relation_type", "target_node_id", among("evidence_type", vocab.EVIDENCE_TYPES, "model_inferred").alias("evidence_type"), among("inference_scope", vocab.INFERENCE_SCOPES, "same_section").alias("inference_scope"),
        F.col("allowed").alias("evidence_refs"), t("evidence_text").alias("evidence_text"), T.clamped(F.col("confidence")).alias("confidence"), t("reasoning_summary").alias("reasoning_summary"), F.lit("llm_relation_completion").alias("relation_source"), status.alias("review_status"), F.struct(F.lit(1).alias("round"), "answer_id", "pos").alias("rank"),
    )
    old = seeds.withColumn("rank", F.struct(F.lit(0).alias("round"), F.lit(None).cast(answers.schema["answer_id"].dataType).alias("answer_id"), F.lit(-1).alias("pos"))).select(*new.columns)
    fact = ["source_node_id", "relation_type", "target_node_id"]
    last = F.row_number().over(Window.partitionBy(*fact).orderBy(F.col("rank").desc()))
    relations = old.unionByName(new).withColumn("k", last).where("k = 1").drop("k", "rank")
    of = lambda name, c: F.struct(F.lit(name).alias("name"), F.coalesce(c, F.lit(0)).cast("long").alias("n"))
    counts = raw.join(kept, ["answer_id", "pos"], "left").agg(F.explode(F.array(
        of("raw_relation_count", F.count(F.lit(1))), of("invalid_endpoint_or_type_count", F.sum((~F.col("fits")).cast("int"))), of("filtered_evidence_ref_count", F.sum(F.col("named") - F.size("allowed"))),
    )).alias("d")).select("d.*")
    size = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
    types = raw.groupBy(F.concat(F.lit("raw_type:"), F.col("raw_type")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    final = relations.groupBy(F.concat(F.lit("final_type:"), F.col("relation_type")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return relations, counts.unionByName(size(seeds, "seed_relation_count")).unionByName(size(relations, "final_relation_count")).unionByName(types).unionByName(final)
