"""Five stages from raw documents to packed token sequences.

Each stage works on all that the one before kept; what it returns is written as Parquet and read
again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import langid, mixing, ngram_join, packing, substring_dedup
from graphloom.llm.exchange import id_filter, maybe_rows, partitions, stored
from graphloom.llm.queries import tokenizer_file


#: Rows in a batch that goes to Python: whole texts are large, and a batch takes its size several times, in the JVM and in Python.
BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    """Set for the session, as a stage's rows are written after the stage has returned."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text or letters go; a missing language is filled in."""
    _small_batches(spark)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    found = langid.identify(rows, langid.fit(docs), text_col="row.text").where(F.col("lang_pred") != "und")
    return found.select(*(F.coalesce("row.lang", "lang_pred").alias("lang") if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one of smallest id stays."""
    _small_batches(spark)
    found = ngram_join.jaccard_components(docs)
    gone = stored(found.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct(), "near-copies")
    seen = maybe_rows(docs, id_filter(gone))
    kept = seen.where("not __maybe").select("row").unionByName(seen.where("__maybe").join(gone, "doc_id", "left_anti").select("row"))
    return kept.select("row.*")


#: Pieces of consecutive documents of the mixture that are packed together: about five cycles of its slots.
MIXED_PIECES = 8192


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of 50 words that a document with a smaller id has too are cut out of the texts; all documents stay."""
    _small_batches(spark)
    found = substring_dedup.cut_documents(docs)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which their sources interleave at their target weights."""
    return mixing.interleaved(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs documents that were stored in the order of the mixture, and numbers sequences in that order.

    Spark deals the files of a table out by their size, so the order is taken from the numbers in
    the names of the files (compared as numbers, of any length) and the places of their rows.
    """
    _small_batches(spark)
    placed = docs.select("doc_id", "text", F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("long").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    ordered = placed.repartitionByRange(partitions(spark), "__file", "__row").sortWithinPartitions("__file", "__row")
    return packing.pack_documents(ordered, tokenizer_file("word_bpe_49k.json"), block_pieces=MIXED_PIECES, keep_tokenizer=False)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", drop_repeats),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: Not all stages can be expressed in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{i + 1}")
    return docs
