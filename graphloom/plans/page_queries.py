"""Queries over pages, documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab
from ..operators import pages as P
from ..operators import reading as R
from ..sources import adapters as A


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    return A.pages(spark, d).withColumn("printed", F.when(F.col("page_index") % 9 == 0, "").otherwise(F.concat(F.lit("p "), (F.col("page_index") + F.floor(F.col("page_index") / 50)).cast("string"))))


def page_continuity(spark: SparkSession, d: str) -> DataFrame:
    return P.continuity(_evidence(spark, d)).withColumn("signals", F.array_join("signals", "|"))


def conversation_continuity(spark: SparkSession, d: str) -> DataFrame:
    c = A.table(spark, d, "conversations")
    turns = c.select(F.col("conv_id").cast("string").alias("book"), F.col("turn").alias("page_index"), F.concat_ws(":", "conv_id", F.lit("turn"), "turn").alias("page_id"), "text", F.lit("").alias("image_sha256"), F.lit("").alias("printed"))
    return P.continuity(turns).select("next_page_id", "continuity_score", F.array_join("signals", "|").alias("signals"), "needs_model_review")


def duplicate_pages(spark: SparkSession, d: str) -> DataFrame:
    return A.pages(spark, d).groupBy("book", "image_sha256").agg(F.count(F.lit(1)).alias("n"), F.min("page_index").cast("long").alias("first_page")).where("n > 1")


def _headed(spark: SparkSession, d: str) -> DataFrame:
    docs = A.table(spark, d, "documents").select("doc_id", "n_chars")
    return A.pages(spark, d).select("book", "page_index", "doc_id").join(docs, "doc_id").withColumn("heading", F.when(F.col("n_chars") % 4 == 0, F.concat(F.lit("H"), (F.col("n_chars") % 12).cast("string"))).otherwise(""))


def chapter_islands(spark: SparkSession, d: str) -> DataFrame:
    bare = F.col("book") == "src3"
    return P.chapters(_headed(spark, d).withColumn("heading", F.when(bare, "").otherwise(F.col("heading")))).withColumn("start_page", F.col("start_page").cast("long")).withColumn("end_page", F.col("end_page").cast("long")).withColumn("chapter_no", F.col("chapter_no").cast("long"))


def page_batches(spark: SparkSession, d: str) -> DataFrame:
    pages = A.pages(spark, d).select("book", "page_index", F.length("text").alias("chars"))
    return P.batches(pages).groupBy("book", "batch_no").agg(F.min("page_index").cast("long").alias("first_page"), F.max("page_index").cast("long").alias("last_page"))


def node_chunks(spark: SparkSession, d: str) -> DataFrame:
    nodes = A.table(spark, d, "part").select(F.col("p_brand").alias("chapter"), F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("node_id"))
    return P.chunks(nodes, 20).groupBy("chapter", "chunk_no").agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("first"))


def redact_secrets(spark: SparkSession, d: str) -> DataFrame:
    docs = A.table(spark, d, "documents")
    return docs.select("doc_id", T.redacted(F.concat(F.lit("Authorization: Bearer abc.DEF-12 password='x1' "), F.col("text"))).alias("r")).select("doc_id", F.md5("r").alias("redacted_md5"), (F.length("r") - F.length(F.regexp_replace("r", r"\[REDACTED", ""))).cast("long").alias("marks"))


def structural_numbers(spark: SparkSession, d: str) -> DataFrame:
    p = A.table(spark, d, "part")
    name = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("part "), F.col("p_size").cast("string"), F.lit(".2.1"))).otherwise(F.col("p_name"))
    return p.select("p_partkey", T.structural_number(name, F.col("p_brand")).alias("number"))


def page_title_extract(spark: SparkSession, d: str) -> DataFrame:
    p = A.table(spark, d, "pages")
    tag = lambda t: T.trimmed(F.regexp_extract("html", f"(?is)<{t}[^>]*>(.*?)</{t}>", 1))
    return p.select("page_id", tag("title").alias("title"), tag("h1").alias("heading"), F.split_part("url", F.lit("/"), F.lit(3)).alias("host"))


def status_value_counts(spark: SparkSession, d: str) -> DataFrame:
    raw = F.create_map(*(F.lit(x) for kv in A.RAW_STATUSES.items() for x in kv))
    a = A.table(spark, d, "orders").select(F.lit("order").alias("kind"), T.review_status(raw[F.col("o_orderstatus")]).alias("value"))
    b = A.table(spark, d, "events").select(F.lit("event").alias("kind"), F.col("event_type").alias("value"))
    c = A.table(spark, d, "conversations").select(F.lit("role").alias("kind"), F.col("role").alias("value"))
    return a.union(b).union(c).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


def progress_modes(spark: SparkSession, d: str) -> DataFrame:
    raw = F.element_at(F.array(*(F.lit(x) for x in (" Full ", "摘要", "disabled", "1", "what", ""))), (F.col("event_id") % 6 + 1).cast("int"))
    return A.table(spark, d, "events").select(T.progress_mode(raw).alias("mode")).groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


def quality_labels(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = A.table(spark, d, "documents").select("doc_id", "source"), A.table(spark, d, "labels")
    status = F.when(F.col("quality").isNull(), "pending").when((F.col("quality") == 1) & (F.col("toxic") == 0), "accepted").otherwise("rejected")
    return docs.join(labels, "doc_id", "left").select("source", status.alias("review_status")).groupBy("source", "review_status").agg(F.count(F.lit(1)).alias("n"))


def cached_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose text a cache already holds, and those computed once for each distinct text."""
    pages = A.pages(spark, d).withColumn("cache_key", P.cache_key(F.col("image_sha256"), "v1", "det", "rec"))
    cache = pages.where("doc_id % 3 = 0").select("cache_key").distinct().withColumn("result", F.lit("cached"))
    hits, _ = P.cached(pages, cache, lambda misses: misses.select("cache_key", F.lit("computed").alias("result")))
    return hits.groupBy("book", "result", "cache_hit").agg(F.count(F.lit(1)).alias("n"))


def reading_sequence(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a conversation as numbered items, bound to their roles' names."""
    c = A.table(spark, d, "conversations")
    parent = F.col("conv_id").cast("string")
    anchors = c.select(parent.alias("parent_id"), F.concat_ws("#", "conv_id", "turn").alias("anchor_id"), F.concat((F.col("turn") + 1).cast("string"), F.lit(". "), F.col("role"), F.lit(" "), F.col("turn").cast("string")).alias("text"))
    children = c.select(parent.alias("parent_id"), F.concat_ws("#", "conv_id", "turn").alias("child_id"), F.concat_ws(" ", "role", "turn").alias("name"))
    return R.reading_sequences(children, anchors).withColumn("ordinal", F.col("ordinal").cast("long"))


QUERIES = {f.__name__: f for f in (page_continuity, conversation_continuity, duplicate_pages, chapter_islands, page_batches, node_chunks, redact_secrets, structural_numbers, page_title_extract, status_value_counts, progress_modes, quality_labels, cached_evidence, reading_sequence)}

PAGES_SQL = """pages AS (SELECT source AS book, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_index, doc_id, text FROM documents)"""
_ENDS = vocab.SENTENCE_ENDS.replace("'", "''")
_SCORE_SQL = r"""
  marked AS (SELECT *, sq = '' OR psq = '' AS missing, page_index = pidx + 1 AS follows, a IS NOT NULL AND b IS NOT NULL AS numbered, pimg <> '' AND pimg = img AS same_image,
      right(psq, 180) AS tail, left(sq, 180) AS head FROM pairs),
  grams AS (SELECT *, CASE WHEN length(tail) < 2 THEN [] ELSE list_distinct(list_transform(range(1, length(tail)), lambda i: substr(tail, i, 2))) END AS x, CASE WHEN length(head) < 2 THEN [] ELSE list_distinct(list_transform(range(1, length(head)), lambda i: substr(head, i, 2))) END AS y FROM marked),
  scored AS (SELECT *, CASE WHEN len(x) = 0 OR len(y) = 0 OR missing THEN 0.0 ELSE len(list_intersect(x, y)) * 1.0 / len(list_distinct(list_concat(x, y))) END AS overlap,
      NOT missing AND strpos('{ends}', right(tail, 1)) = 0 AS mid,
      NOT missing AND regexp_matches(head, '^(第[一二三四五六七八九十百0-9]+[章节单元]|[0-9]+(\.[0-9]+){{0,3}}\s*[^，。；]{{1,24}})') AS headed, NOT missing AND NOT same_image AND sq = psq AS same_text FROM grams),
  found AS (SELECT *,
      concat_ws('|', CASE WHEN follows THEN 'file_page_index_continuous' ELSE 'file_page_index_gap' END,
        CASE WHEN numbered AND b = a + 1 THEN 'printed_page_number_continuous' WHEN numbered AND b = a THEN 'printed_page_number_repeated' WHEN numbered THEN 'printed_page_number_gap_or_reverse' END,
        CASE WHEN same_image THEN 'duplicate_page_image' WHEN same_text THEN 'duplicate_page_text' END, CASE WHEN missing THEN 'text_evidence_missing' END,
        CASE WHEN NOT missing AND overlap >= 0.08 THEN 'boundary_vocabulary_related' END, CASE WHEN mid AND NOT headed THEN 'sentence_boundary_continuous' WHEN mid THEN 'possible_broken_sentence' END,
        CASE WHEN headed THEN 'next_page_starts_with_heading' END) AS signals,
      72 + CASE WHEN follows THEN 8 ELSE -42 END + CASE WHEN NOT numbered THEN 0 WHEN b = a + 1 THEN 12 WHEN b = a THEN -12 ELSE -34 END + CASE WHEN same_image THEN -58 WHEN same_text THEN -46 ELSE 0 END
        + CASE WHEN missing THEN -18 ELSE 0 END + CASE WHEN NOT missing AND overlap >= 0.08 THEN 5 ELSE 0 END + CASE WHEN mid AND NOT headed THEN 8 WHEN mid THEN -12 ELSE 0 END + CASE WHEN headed THEN 2 ELSE 0 END AS points,
      NOT follows OR (numbered AND b <> a + 1 AND b <> a) OR same_image OR same_text AS severe FROM scored),
  result AS (SELECT *, greatest(0, least(100, points)) / 100.0 AS continuity_score FROM found)""".replace("{ends}", _ENDS).replace("{{", "{").replace("}}", "}")

ORACLE_SQL = {
    "page_continuity": f"""WITH {PAGES_SQL},
      e AS (SELECT *, CASE WHEN page_index % 9 = 0 THEN NULL ELSE page_index + page_index // 50 END AS n, regexp_replace(text, '\\s+', '', 'g') AS squeezed, sha256(text) AS img0, book || ':page:' || CAST(page_index AS VARCHAR) AS page_id FROM pages),
      pairs AS (SELECT * FROM (SELECT book, page_id, page_index, squeezed AS sq, img0 AS img, n AS b, lag(page_id) OVER w AS ppage, lag(page_index) OVER w AS pidx, lag(squeezed) OVER w AS psq, lag(img0) OVER w AS pimg, lag(n) OVER w AS a FROM e WINDOW w AS (PARTITION BY book ORDER BY page_index)) q WHERE ppage IS NOT NULL), {_SCORE_SQL}
      SELECT book, ppage AS previous_page_id, page_id AS next_page_id, continuity_score::DOUBLE AS continuity_score, signals, severe OR continuity_score < 0.62 AS needs_model_review, CASE WHEN severe OR continuity_score < 0.62 THEN 'manual_review' ELSE 'keep_order' END AS suggested_action FROM result""",
    "conversation_continuity": f"""WITH e AS (SELECT CAST(conv_id AS VARCHAR) AS book, turn AS page_index, CAST(conv_id AS VARCHAR) || ':turn:' || CAST(turn AS VARCHAR) AS page_id, regexp_replace(text, '\\s+', '', 'g') AS squeezed FROM conversations),
      pairs AS (SELECT * FROM (SELECT book, page_id, page_index, squeezed AS sq, '' AS img, CAST(NULL AS INT) AS b, lag(page_id) OVER w AS ppage, lag(page_index) OVER w AS pidx, lag(squeezed) OVER w AS psq, '' AS pimg, CAST(NULL AS INT) AS a FROM e WINDOW w AS (PARTITION BY book ORDER BY page_index)) q WHERE ppage IS NOT NULL), {_SCORE_SQL}
      SELECT page_id AS next_page_id, continuity_score::DOUBLE AS continuity_score, signals, severe OR continuity_score < 0.62 AS needs_model_review FROM result""",
    "duplicate_pages": f"WITH {PAGES_SQL} SELECT book, sha256(text) AS image_sha256, count(*) AS n, min(page_index) AS first_page FROM pages GROUP BY book, sha256(text) HAVING count(*) > 1",
    "chapter_islands": f"""WITH {PAGES_SQL},
      h AS (SELECT book, page_index, CASE WHEN book <> 'src3' AND n_chars % 4 = 0 THEN 'H' || CAST(n_chars % 12 AS VARCHAR) ELSE '' END AS heading FROM pages p JOIN documents d ON d.doc_id = p.doc_id),
      found AS (SELECT *, lag(heading) OVER (PARTITION BY book ORDER BY page_index) AS last FROM h WHERE heading <> ''),
      starts AS (SELECT *, row_number() OVER w AS chapter_no, lead(page_index) OVER w - 1 AS stop FROM found WHERE last IS NULL OR last <> heading WINDOW w AS (PARTITION BY book ORDER BY page_index)),
      span AS (SELECT book, min(page_index) AS a, max(page_index) AS z FROM h GROUP BY book)
      SELECT s.book, chapter_no, heading AS title, page_index AS start_page, coalesce(stop, z) AS end_page FROM starts s JOIN span ON span.book = s.book
      UNION ALL SELECT book, 1, '选定页面范围', a, z FROM span WHERE book NOT IN (SELECT book FROM starts)""",
    "page_batches": f"""WITH RECURSIVE {PAGES_SQL},
      walk AS (SELECT book, page_index, 0 AS batch_no, 1 AS k, length(text) AS chars FROM pages WHERE page_index = 1
        UNION ALL SELECT p.book, p.page_index, CASE WHEN w.k >= 4 OR w.chars + length(p.text) > 12000 THEN w.batch_no + 1 ELSE w.batch_no END, CASE WHEN w.k >= 4 OR w.chars + length(p.text) > 12000 THEN 1 ELSE w.k + 1 END,
          CASE WHEN w.k >= 4 OR w.chars + length(p.text) > 12000 THEN length(p.text) ELSE w.chars + length(p.text) END FROM walk w JOIN pages p ON p.book = w.book AND p.page_index = w.page_index + 1)
      SELECT book, batch_no, min(page_index) AS first_page, max(page_index) AS last_page FROM walk GROUP BY book, batch_no""",
    "node_chunks": """WITH p AS (SELECT p_brand AS chapter, p_partkey FROM part),
      n AS (SELECT chapter, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS node_id, count(*) OVER (PARTITION BY chapter) AS k, row_number() OVER (PARTITION BY chapter ORDER BY p_partkey) AS r FROM p)
      SELECT chapter, (r - 1) // 20 AS chunk_no, count(*) AS n, min(node_id) AS first FROM n WHERE k >= 2 GROUP BY ALL""",
    "redact_secrets": r"""WITH a AS (SELECT doc_id, 'Authorization: Bearer abc.DEF-12 password=''x1'' ' || text AS t FROM documents),
      b AS (SELECT doc_id, regexp_replace(regexp_replace(t, 'data:(?:image|application)/[^;\s]+;base64,[A-Za-z0-9+/=]+', '[REDACTED_DATA_URL]', 'gi'), '\bBearer\s+[A-Za-z0-9._~+/=-]+', 'Bearer [REDACTED]', 'gi') AS t FROM a),
      c AS (SELECT doc_id, regexp_replace(t, '(["'']?(?:api[_-]?key|apikey|authorization|access[_-]?token|refresh[_-]?token|secret|password)["'']?\s*[:=]\s*["'']?)([^"''\s,}\]]+)', '\1[REDACTED]', 'gi') AS r FROM b)
      SELECT doc_id, md5(r) AS redacted_md5, length(r) - length(replace(r, '[REDACTED', '')) AS marks FROM c""",
    "structural_numbers": r"""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN CAST(p_size AS VARCHAR) || '.2.1' ELSE regexp_extract(p_brand, '([0-9]+)', 1) END AS number FROM part""",
    "page_title_extract": r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, trim(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)) AS heading, split_part(url, '/', 3) AS host FROM pages""",
    "status_value_counts": """SELECT 'order' AS kind, CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'P' THEN 'needs_revision' ELSE 'pending' END AS value, count(*) AS n FROM orders GROUP BY ALL
      UNION ALL SELECT 'event', event_type, count(*) FROM events GROUP BY ALL UNION ALL SELECT 'role', role, count(*) FROM conversations GROUP BY ALL""",
    "progress_modes": "SELECT CASE event_id % 6 WHEN 0 THEN 'full' WHEN 1 THEN 'summary' WHEN 3 THEN 'full' ELSE 'off' END AS mode, count(*) AS n FROM events GROUP BY ALL",
    "quality_labels": "SELECT source, CASE WHEN quality IS NULL THEN 'pending' WHEN quality = 1 AND toxic = 0 THEN 'accepted' ELSE 'rejected' END AS review_status, count(*) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY ALL",
    "cached_evidence": f"""WITH c AS (SELECT DISTINCT text FROM documents WHERE doc_id % 3 = 0)
      SELECT source AS book, CASE WHEN c.text IS NULL THEN 'computed' ELSE 'cached' END AS result, c.text IS NOT NULL AS cache_hit, count(*) AS n FROM documents d LEFT JOIN c ON c.text = d.text GROUP BY ALL""",
}
