"""The numbered queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, fim, fingerprint, langid, media, mixing, ngram_join, packing, repair, substring_dedup, suffix_dedup, token_counts


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(_table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeated_bytes(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op6_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = _table(spark, sf_dir, "conversations")
    return chat.preference_turns(chosen, chat.swapped_replies(chosen), edits=True, pair_col="conv_id")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_table(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _table(spark, sf_dir, "conversations")
    return repair.repair_reports(repair.damaged(told), originals=told)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fill_in_middle_digests(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_matroska": op1_matroska,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_fingerprints": op4_fingerprints,
    "op5_language": op5_language,
    "op6_preferences": op6_preferences,
    "op7_token_counts": op7_token_counts,
    "op8_packing": op8_packing,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_mixing": op10_mixing,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_structure_repair": op12_structure_repair,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE_SQL: dict[str, str] = {
    "op2_jaccard_join": r"""
      WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        spots AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM spots),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b)
      SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m.root AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id""",
    "op9_substring_dedup": r"""
      WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        spots AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50),
        k AS (SELECT doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS k FROM spots),
        f AS (SELECT k, min(doc_id) AS first FROM k GROUP BY k),
        m AS (SELECT k.doc_id, i FROM k JOIN f ON f.k = k.k WHERE first < k.doc_id),
        x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM m),
        g AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id),
        t AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM w),
        kept AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.j) AS kept FROM t LEFT JOIN x ON x.doc_id = t.doc_id AND x.j = t.j WHERE x.j IS NULL GROUP BY t.doc_id)
      SELECT w.doc_id, len(w) AS n_words, coalesce(g.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN g ON g.doc_id = w.doc_id LEFT JOIN kept ON kept.doc_id = w.doc_id""",
    "op6_preferences": """
      WITH last AS (SELECT conv_id, max(turn) AS last_turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
      reply AS (SELECT l.conv_id, l.last_turn, max(c.text) AS said FROM last l JOIN conversations c
                ON c.conv_id = l.conv_id AND c.turn = l.last_turn AND c.role = 'assistant' GROUP BY l.conv_id, l.last_turn),
      rejected AS (
        SELECT c.conv_id, c.turn, c.role,
               CASE WHEN c.turn = r.last_turn AND c.role = 'assistant' THEN coalesce(o.said, '') ELSE c.text END AS text
        FROM conversations c LEFT JOIN reply r ON r.conv_id = c.conv_id LEFT JOIN reply o ON o.conv_id = xor(c.conv_id, 1)),
      both_sides AS (SELECT a.conv_id AS pair_id, a.turn, a.role AS ra, a.text AS ta, b.role AS rb, b.text AS tb FROM conversations a JOIN rejected b ON a.conv_id = b.conv_id AND a.turn = b.turn),
      cut AS (SELECT pair_id, min(turn) AS first FROM both_sides WHERE ra <> rb OR ta <> tb GROUP BY pair_id),
      shown AS (SELECT s.pair_id, turn, ra, rb, ta, tb, first IS NULL OR turn < first AS shared, '<|im_start|>' || ra || chr(10) AS ha, '<|im_start|>' || rb || chr(10) AS hb FROM both_sides s LEFT JOIN cut c ON c.pair_id = s.pair_id),
      sized AS (SELECT *, ha || ta || '<|im_end|>' || chr(10) AS a, hb || tb || '<|im_end|>' || chr(10) AS b FROM shown),
      placed AS (SELECT *, CAST(coalesce(sum(length(a)) OVER before, 0) AS BIGINT) AS p0, CAST(coalesce(sum(CASE WHEN NOT shared THEN length(a) END) OVER before, 0) AS BIGINT) AS a0, CAST(coalesce(sum(CASE WHEN NOT shared THEN length(b) END) OVER before, 0) AS BIGINT) AS b0
        FROM sized WINDOW before AS (PARTITION BY pair_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      SELECT pair_id, turn, CASE WHEN shared THEN 'prompt' ELSE 'completion' END AS part, CASE WHEN shared THEN a END AS prompt, CASE WHEN shared THEN p0 END AS prompt_start,
        CASE WHEN NOT shared THEN a END AS chosen, CASE WHEN NOT shared THEN a0 END AS chosen_start, CASE WHEN NOT shared AND ra = 'assistant' THEN a0 + length(ha) END AS chosen_loss_start, CASE WHEN NOT shared AND ra = 'assistant' THEN length(ta) + 10 END AS chosen_loss_length,
        CASE WHEN NOT shared THEN b END AS rejected, CASE WHEN NOT shared THEN b0 END AS rejected_start, CASE WHEN NOT shared AND rb = 'assistant' THEN b0 + length(hb) END AS rejected_loss_start, CASE WHEN NOT shared AND rb = 'assistant' THEN length(tb) + 10 END AS rejected_loss_length
      FROM placed""",
    "op10_mixing": """
      WITH RECURSIVE counted AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
      shares AS (SELECT source, pow(n::DOUBLE, 0.5) * 200 / sum(pow(n::DOUBLE, 0.5)) OVER () AS share FROM counted),
      wholes AS (SELECT source, share, CAST(floor(share) AS BIGINT) AS whole, 200 - sum(CAST(floor(share) AS BIGINT)) OVER () AS spare FROM shares),
      quotas AS (SELECT source, greatest(whole + CASE WHEN row_number() OVER (ORDER BY round(share - whole, 9) DESC, source) <= spare THEN 1 ELSE 0 END, 1) AS quota FROM wholes),
      sized AS (SELECT source, CAST(quota AS BIGINT) AS quota, CAST(sum(quota) OVER () AS BIGINT) AS slots FROM quotas),
      walk AS (SELECT CAST(-1 AS BIGINT) AS slot, source, quota, slots, CAST(0 AS BIGINT) AS done, false AS chosen FROM sized
        UNION ALL SELECT slot + 1, source, quota, slots, done + CASE WHEN pick = 1 THEN 1 ELSE 0 END, pick = 1
        FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN done < quota AND done * slots // quota <= slot + 1 THEN 0 ELSE 1 END, ((done + 1) * slots + quota - 1) // quota, CASE WHEN quota = 1 THEN md5('=' || source) ELSE '' END, source) AS pick FROM walk WHERE slot < slots - 1) q),
      cycle AS (SELECT source, quota, slots, slot, done - 1 AS nth FROM walk WHERE chosen),
      ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS r FROM documents),
      placed AS (SELECT doc_id, k.source, r, r // 8 AS block, r // 8 // quota AS cycle, r // 8 % quota AS nth, quota, slots FROM ranked k JOIN sized s ON s.source = k.source)
      SELECT p.doc_id, p.source, p.quota / p.slots AS target_weight, p.block, p.cycle, c.slot, (p.cycle * p.slots + c.slot) * 8 + p.r % 8 AS position, p.nth + 1 - (c.slot + 1) * p.quota / p.slots AS deviation
      FROM placed p JOIN cycle c ON c.source = p.source AND c.nth = p.nth""",
    "op11_exact_dedup": r"""
      WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
      SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256 FROM t WINDOW same AS (PARTITION BY t)""",
    "op13_fill_in_middle": r"""
      WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS d FROM documents),
        h AS (SELECT doc_id, t, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM t),
        u AS (SELECT *, list_transform(regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]'), lambda x: length(x)) AS sizes FROM h),
        c AS (SELECT *, len(sizes) AS n, least(h1 % (len(sizes) + 1), h2 % (len(sizes) + 1)) AS a, greatest(h1 % (len(sizes) + 1), h2 % (len(sizes) + 1)) AS b FROM u),
        p AS (SELECT doc_id, t, n, CAST(coalesce(list_sum(sizes[1:a]), 0) AS BIGINT) AS pc, CAST(coalesce(list_sum(sizes[a+1:b]), 0) AS BIGINT) AS mc,
          CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c),
        o AS (SELECT *, left(t, pc) AS pre, substr(t, pc + 1, mc) AS mid, substr(t, pc + mc + 1) AS suf FROM p)
      SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN pc END AS prefix_chars, CASE WHEN form <> 'plain' THEN mc END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', pre, '<S>', suf, '<M>', mid) ELSE concat('<S>', suf, '<P>', pre, '<M>', mid) END) AS output_sha256, sha256(t) AS restored_sha256 FROM o""",
    "op12_structure_repair": r"""
      WITH RECURSIVE tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256)) q),
        named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, t, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS bytes FROM conversations, tab),
        hashed AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 20 AS kind FROM named),
        hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM hashed WHERE kind <> 0),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS k FROM hurt),
        r AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, lag(k) OVER (PARTITION BY conv_id ORDER BY i) AS before, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault FROM placed),
        moves(was, now, gap, gone) AS (VALUES ('n', 's', 0, false), ('n', 'u', 0, false), ('n', 'a', 1, false), ('s', 'u', 0, false), ('s', 'a', 1, false), ('u', 'u', 1, false), ('u', 'a', 0, false), ('a', 'u', 0, false), ('a', 'a', 1, false), ('n', 'n', 0, true), ('s', 's', 0, true), ('u', 'u', 0, true), ('a', 'a', 0, true)),
        walk AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 'n' AS state, CAST(0 AS BIGINT) AS cost, '' AS audit FROM r
          UNION ALL SELECT conv_id, i, state, cost, audit FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) AS pick FROM (
            SELECT w.conv_id, r.i, m.now AS state, CAST(w.cost + CASE WHEN m.gone THEN 2 ELSE 5 * m.gap + CASE WHEN r.fault = 3 THEN 5 ELSE 0 END + CASE WHEN m.now = r.k THEN 0 ELSE 1 END END AS BIGINT) AS cost,
              w.audit || CASE WHEN m.gone THEN 'D' ELSE repeat('I', m.gap) || CASE WHEN m.now = r.k THEN 'K' ELSE 'R' END END AS audit
            FROM walk w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1 JOIN moves m ON m.was = w.state
            WHERE m.gone OR (r.fault NOT IN (1, 2) AND (m.now = r.k OR m.now <> 's'))) c) p WHERE pick = 1),
        done AS (SELECT conv_id, cost, audit FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) AS pick FROM (
          SELECT w.conv_id, w.cost + CASE w.state WHEN 's' THEN 10 WHEN 'u' THEN 5 ELSE 0 END AS cost, w.audit || CASE w.state WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END AS audit
          FROM walk w JOIN (SELECT DISTINCT conv_id, n FROM r) s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.n = w.i) e) q WHERE pick = 1),
        letters AS (SELECT conv_id, p, audit[p] AS x, CASE WHEN audit[p] <> 'I' THEN length(replace(audit[1:p], 'I', '')) END AS i, length(replace(audit[1:p], 'D', '')) AS place FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM done) q WHERE audit[p] <> 'D'),
        kept AS (SELECT l.conv_id, p, x, place, role, k, text FROM letters l LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.i),
        heads AS (SELECT conv_id, CASE WHEN k = 's' AND x = 'K' THEN 1 ELSE 0 END AS head FROM kept WHERE place = 1),
        said AS (SELECT kept.conv_id, string_agg(CASE WHEN x = 'K' THEN role WHEN (place - head) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(CASE WHEN x <> 'I' THEN text END, ''), chr(10) ORDER BY p) AS said FROM kept JOIN heads ON heads.conv_id IS NOT DISTINCT FROM kept.conv_id GROUP BY kept.conv_id),
        counted AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (i > 1 AND before || k NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
      SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
      FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN said s ON s.conv_id IS NOT DISTINCT FROM o.conv_id""",
}
