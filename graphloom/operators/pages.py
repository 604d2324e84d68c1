"""Ordered pages: continuity, chapters, batches, titles and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab
from ..storage import stored
from . import scans


def continuity(pages: DataFrame, threshold: float = 0.62) -> DataFrame:
    """Neighbouring pages of each book, scored for whether the second follows the first.

    pages: (book, page_index, page_id, text, image_sha256, printed). Scores are whole hundredths
    until the end, so they don't depend on the order of additions.
    """
    now = scans.running(pages.withColumn("squeezed", T.squeezed(F.col("text"))), ["book"], ["page_index"])
    pair = scans.with_previous(now, "book", ["page_id", "page_index", "squeezed", "image_sha256", "printed"])
    pair = pair.withColumn("a", T.page_number(F.col("p_printed"))).withColumn("b", T.page_number(F.col("printed")))
    pair = pair.withColumn("tail", F.right("p_squeezed", F.lit(180))).withColumn("head", F.substring("squeezed", 1, 180))
    missing = (F.col("squeezed") == "") | (F.col("p_squeezed") == "")
    follows = F.col("page_index") == F.col("p_page_index") + 1
    numbered = F.col("a").isNotNull() & F.col("b").isNotNull()
    same_image = (F.col("p_image_sha256") != "") & (F.col("p_image_sha256") == F.col("image_sha256"))
    same_text = ~same_image & ~missing & (F.col("squeezed") == F.col("p_squeezed"))
    pair = pair.withColumn("overlap", F.when(missing, 0.0).otherwise(T.bigram_jaccard(F.col("tail"), F.col("head"))))
    mid = ~missing & T.ends_mid_sentence(F.col("tail"))
    goes_on = T.starts_like_continuation(F.col("head"))
    flags = [
        ("file_page_index_continuous", follows, 8), ("file_page_index_gap", ~follows, -42),
        ("printed_page_number_continuous", numbered & (F.col("b") == F.col("a") + 1), 12),
        ("printed_page_number_repeated", numbered & (F.col("b") == F.col("a")), -12),
        ("printed_page_number_gap_or_reverse", numbered & ~F.col("b").isin(0) & (F.col("b") != F.col("a") + 1) & (F.col("b") != F.col("a")) | numbered & (F.col("b") == 0) & (F.col("a") != 0), -34),
        ("duplicate_page_image", same_image, -58), ("duplicate_page_text", same_text, -46), ("text_evidence_missing", missing, -18),
        ("boundary_vocabulary_related", ~missing & (F.col("overlap") >= 0.08), 5),
        ("sentence_boundary_continuous", mid & goes_on, 8), ("possible_broken_sentence", mid & ~goes_on, -12),
        ("next_page_starts_with_heading", ~missing & T.starts_with_heading(F.col("head")), 2),
    ]
    found = pair.withColumn("signals", F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c, _ in flags))))
    points = sum((F.when(F.array_contains("signals", n), v).otherwise(0) for n, _, v in flags), F.lit(72))
    severe = F.exists("signals", lambda s: s.isin("file_page_index_gap", "printed_page_number_gap_or_reverse", "duplicate_page_image", "duplicate_page_text"))
    found = found.withColumn("continuity_score", F.greatest(F.lit(0), F.least(F.lit(100), points)) / 100)
    review = severe | (F.col("continuity_score") < threshold)
    return found.select(
        "book", F.col("p_page_id").alias("previous_page_id"), F.col("page_id").alias("next_page_id"), "continuity_score", "signals",
        review.alias("needs_model_review"), F.when(review, "manual_review").otherwise("keep_order").alias("suggested_action"),
    )


def chapters(pages: DataFrame) -> DataFrame:
    """(book, chapter_no, title, start_page, end_page): a chapter begins where a heading differs from the one found before; a book without any is one chapter.

    pages: (book, page_index, heading), heading empty where there is none.
    """
    headed = scans.running(pages.where("heading <> ''").select("book", "page_index", "heading"), ["book"], ["page_index"])
    first = headed.where("idx = 1").select("book", "page_index", "heading")
    starts = first.unionByName(scans.with_previous(headed, "book", ["heading"]).where("heading <> p_heading").select("book", "page_index", "heading"))
    ends = pages.groupBy("book").agg(F.min("page_index").alias("first"), F.max("page_index").alias("final"))
    places = scans.running(starts, ["book"], ["page_index"])
    numbered = places.select("book", F.col("idx").alias("chapter_no"), F.col("heading").alias("title"), F.col("page_index").alias("start_page"))
    follow = places.select("book", (F.col("idx") - 1).alias("chapter_no"), (F.col("page_index") - 1).alias("end"))
    some = numbered.join(follow, ["book", "chapter_no"], "left").join(ends, "book").select("book", "chapter_no", "title", "start_page", F.coalesce("end", "final").alias("end_page"))
    none = ends.join(starts, "book", "left_anti").select("book", F.lit(1).alias("chapter_no"), F.lit("选定页面范围").alias("title"), F.col("first").alias("start_page"), F.col("final").alias("end_page"))
    return some.unionByName(none)


def chapter_heading(text):
    """Heading of a chapter in the first 500 characters of a page, but for tables of contents."""
    head = F.substring(T.trimmed(text), 1, 500)
    number, title = (F.regexp_extract(head, "(?U)" + vocab.CHAPTER, i) for i in (1, 2))
    title = F.regexp_replace(title, r"^[ 　:：]+|[ 　:：]+$", "")
    found = F.concat(F.lit("第"), number, F.lit("章"), F.when(title != "", F.concat(F.lit(" "), title)).otherwise(""))
    return F.when(F.contains(F.substring(head, 1, 100), F.lit("目录")) | (number == ""), "").otherwise(found)


def section_titles(text):
    """Numbered section titles in the first 500 characters."""
    head = F.substring(T.trimmed(text), 1, 500)
    numbers = F.regexp_extract_all(head, F.lit("(?U)" + vocab.SECTION), F.lit(1))
    titles = F.regexp_extract_all(head, F.lit("(?U)" + vocab.SECTION), F.lit(2))
    return T.ordered_unique(F.zip_with(numbers, titles, lambda a, b: F.concat_ws(" ", F.translate(a, "．", "."), T.trimmed(b))))


def batches(pages: DataFrame, max_pages: int = 4, max_chars: int = 12_000) -> DataFrame:
    """pages (book, page_index, chars) with batch_no: a batch closes when it has max_pages pages or the next page would exceed max_chars.

    How far a batch from each page would go follows from running totals and the few pages behind
    it; the pages on which batches begin are then found by doubling, in books of any size.
    """
    placed = scans.running(pages.select("book", "page_index", "chars"), ["book"], ["page_index"], total=F.col("chars").cast("long"))
    rows = stored(placed.select(F.col("book").alias("group"), "page_index", "idx", "n", "total", (F.col("total") - F.coalesce(F.col("chars").cast("long"), F.lit(0))).alias("ahead")), "pages")
    asked = rows.withColumn("j", F.explode(F.sequence(F.col("idx") + 1, F.col("idx") + max_pages - 1))) if max_pages > 1 else rows.limit(0).withColumn("j", F.col("idx"))
    fits = asked.join(rows.select("group", F.col("idx").alias("j"), F.col("total").alias("then")), ["group", "j"]).where(F.col("then") - F.col("ahead") <= max_chars)
    far = fits.groupBy("group", "idx").agg(F.max("j").alias("last"))
    cuts = rows.select("group", "idx").join(far, ["group", "idx"], "left").select("group", "idx", F.coalesce("last", "idx").alias("last"))
    starts = scans.greedy_starts(cuts).withColumn("starts", F.lit(1))
    marked = rows.join(starts, ["group", "idx"], "left").select("group", "page_index", F.coalesce("starts", F.lit(0)).alias("starts"))
    out = scans.running(marked, ["group"], ["page_index"], batch_no=F.col("starts"))
    return out.select(F.col("group").alias("book"), "page_index", (F.col("batch_no") - 1).cast("int").alias("batch_no"))


def chunks(nodes: DataFrame, size: int = 80) -> DataFrame:
    """nodes (chapter, node_id) with chunk_no: groups of at most ``size`` of a chapter; a chapter of one node has none."""
    rows = scans.running(nodes.select("chapter", "node_id"), ["chapter"], ["node_id"]).where("n >= 2")
    return rows.select("chapter", "node_id", F.floor((F.col("idx") - 1) / size).alias("chunk_no"))


def selected_pages(total: int, wanted: list[int] | None) -> list[int]:
    """Page numbers in order, each once; all without a wish. Out of range, or an empty wish, is an error."""
    if wanted is None:
        return list(range(1, total + 1))
    pages = sorted(set(wanted))
    if not pages or pages[0] < 1 or pages[-1] > total:
        raise ValueError(f"pages {wanted} of a document of {total}")
    return pages


def cached(pages: DataFrame, cache: DataFrame, compute) -> tuple[DataFrame, DataFrame]:
    """(results for all pages, new cache rows): what the cache (cache_key, result) lacks is computed once for each key.

    pages: (cache_key, ...). compute: DataFrame of distinct keys with one page each -> (cache_key, result).
    """
    misses = pages.join(cache.select("cache_key"), "cache_key", "left_anti").dropDuplicates(["cache_key"])
    fresh = compute(misses)
    hits = pages.join(cache.withColumn("cache_hit", F.lit(True)).unionByName(fresh.withColumn("cache_hit", F.lit(False))), "cache_key", "left")
    return hits, fresh


def cache_key(image_sha256, pipeline: str, detector: str, recognizer: str):
    return F.sha2(F.concat_ws("|", F.lit(pipeline), F.lit(detector), F.lit(recognizer), image_sha256), 256)


def printed_number(blocks):
    """Text of the lowest block (text, y) that is a page number alone; of equal ones the first."""
    numbers = F.filter(F.transform(blocks, lambda b, i: F.struct(b["y"].alias("y"), (-i).alias("i"), T.trimmed(b["text"]).alias("text"))), lambda b: b["text"].rlike(r"(?U)^(第)?\d{1,4}(页)?$"))
    return F.coalesce(F.array_max(numbers)["text"], F.lit(""))


def page_text(native, forced: bool, ocr, ocr_enabled: bool, enough: int = 24):
    """(text, status): a page's own text if it has enough characters, else what OCR read, else nothing."""
    own = (F.length(T.squeezed(native)) >= enough) & ~F.lit(forced)
    return F.when(own, F.struct(native.alias("text"), F.lit("native_text").alias("status"))).when(F.lit(ocr_enabled), F.struct(ocr.alias("text"), F.lit("ocr").alias("status"))).otherwise(F.struct(F.coalesce(native, F.lit("")).alias("text"), F.lit("unavailable").alias("status")))
