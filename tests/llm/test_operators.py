import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import bytescan, chat, fingerprint, langid, media, mixing, ngram_join, packing, queries, substring_dedup, suffix_dedup, token_counts

from ..compare import connection, spark_rows, sql_rows
from . import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sample(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def made(seed=1):
    """Texts with copies, near copies, shared passages, repeats inside, and the odd cases."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    prose = lambda n: [word() for _ in range(n)]
    passage, base = prose(70), prose(120)
    texts = [None, "", "   \n", "one two", "ONE  Two", "a", "a " * 200, " ".join(base), " ".join(base).upper(), " ".join(base)]
    for k in range(25):
        near = list(base)
        for _ in range(k // 3):
            near[r.randrange(len(near))] = word()
        texts.append(" ".join(near))
    texts += [" ".join(prose(r.randint(0, 60)) + passage[r.randint(0, 15) :] + prose(r.randint(0, 60))) for _ in range(25)]
    texts += [" ".join(prose(r.randint(1, 12))) for _ in range(20)] + [" ".join(passage * 3), " ".join(prose(30_000))]
    ids = list(range(0, 10 * len(texts), 10))
    r.shuffle(ids)
    return list(zip(ids, texts))


def frame(spark, docs, parts=3):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCS).repartition(parts)


@pytest.fixture(params=["made", "table"])
def docs(request, spark, sf):
    return made() if request.param == "made" else sample(spark, sf)


def test_jaccard(spark, docs):
    want = brute.jaccard(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame(spark, docs)).collect()}
    assert got == want


def test_jaccard_of_many_near_copies(spark):
    r = random.Random(5)
    base = [str(r.random()) for _ in range(90)]
    docs = []
    for i in range(150):
        near = list(base)
        for _ in range(i % 9):
            near[r.randrange(len(near))] = str(r.randint(0, 30))
        docs.append((i, " ".join(near)))
    docs += [(1000 + i, " ".join(base[:40] + [str(r.random()) for _ in range(30)])) for i in range(60)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame(spark, docs)).collect()}
    assert got == brute.jaccard(docs)


def test_long_lists_in_blocks(spark):
    """Pairs of a long list that may link, whatever the blocks that it is cut into."""
    r, rows, labels = np.random.default_rng(3), [], []
    for doc in range(240):
        size = int(r.integers(30, 60))
        heavy = int(r.integers(size // 2, size + 1))
        sketch = np.bincount(r.integers(0, 64, heavy) if doc % 3 else np.arange(heavy) % 64, minlength=64).astype(np.uint16)
        rows += [(part, 5, doc, size - heavy, size, bytearray(sketch.tobytes())) for part in range(1 + doc % 2)]
        labels += [(doc, 0 if doc % 4 else doc % 16)] if doc % 5 else []
    label, by, want = dict(labels), {x[2]: x for x in rows}, set()
    for a, b in itertools.combinations(sorted(by), 2):
        (_, _, _, la, sa, ka), (_, _, _, lb, sb, kb) = by[a], by[b]
        shared = np.minimum(np.frombuffer(ka, np.uint16), np.frombuffer(kb, np.uint16)).sum()
        if label.get(a, a) != label.get(b, b) and 4 * min(sa, sb) >= 3 * max(sa, sb) and 7 * min(sa - la, sb - lb, shared) >= 3 * (sa + sb):
            want.add((a, b))
    lists = spark.createDataFrame(rows, "part long, low long, doc long, light long, size long, sketch binary")
    known = spark.createDataFrame(labels, "v long, label long")
    for block in (7, 100, 1000):
        got = ngram_join.apart_pairs(lists, known, 2, block).collect()
        assert sorted((x.a, x.b) for x in got) == sorted(want) and want


def test_jaccard_of_a_template(spark):
    """Documents of which most is the same and that link with none, and a few copies among them."""
    r = random.Random(8)
    same = [str(r.random()) for _ in range(34)]
    docs = [(i, " ".join(same + [str(r.random()) for _ in range(10)])) for i in range(800)]
    docs += [(2000 + i, t + " more") for i, t in docs[:20]]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame(spark, docs)).collect()}
    assert got == {i: (len(t.split()) - 4, i % 2000) for i, t in docs}


def test_jaccard_of_shared_ids(spark):
    """Texts of one id are vertices of their own; a component's id is the smallest of its documents'."""
    r = random.Random(12)
    prose = lambda n: [str(r.random()) for _ in range(n)]
    base, other = prose(300), prose(200)
    docs = [(1, base), (2, base[1:]), (2, other), (3, other[:-1]), (2, base[1:]), (4, prose(30)), (9, base[2:]), (9, ["short"]), (-5, other[1:]), (7, []), (7, prose(50)), (None, base)]
    docs = [(i, " ".join(w)) for i, w in docs]
    plain = brute.jaccard(list(enumerate(t for _, t in docs)))
    known = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            known.setdefault(plain[k][1], []).append(i)
    want = sorted((i, plain[k][0], min(known[plain[k][1]])) for k, (i, t) in enumerate(docs) if i is not None)
    # the null row links with nothing, and gives its base no smaller id
    rows = ngram_join.jaccard_components(frame(spark, docs)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows if r.doc_id is not None) == want
    assert [r.component_id for r in rows if r.doc_id is None] == [None] and len(rows) == len(docs)


def test_substring_dedup(spark, docs):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(frame(spark, docs)).collect()}
    assert got == brute.substring_dedup(docs)


def test_suffix_dedup(spark, docs):
    rows = suffix_dedup.remove_repeated_bytes(frame(spark, docs)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows} == brute.suffix_dedup(docs)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans for r in rows)


def repeated_ids():
    """Rows that share an id but not their text, beside passages of smaller and larger ids."""
    r = random.Random(9)
    prose = lambda n: " ".join(str(r.randint(0, 999)) for _ in range(n))
    shared, other = prose(200), prose(80)
    return [(1, shared), (5, shared), (5, "a b c"), (7, prose(300)), (5, prose(30) + " " + other + " " + prose(9)), (3, other), (5, shared), (5, None), (9, "x" * 4000), (4, "y " + "x" * 900), (9, "ab" * 500 + other), (2, "ab" * 300)]


def test_rows_of_one_id(spark):
    docs = repeated_ids()
    got = substring_dedup.remove_repeats(frame(spark, docs)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == sorted(brute.substring_rows(docs))
    got = suffix_dedup.remove_repeated_bytes(frame(spark, docs)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted(brute.suffix_rows(docs))
    for run in (ngram_join.jaccard_components, fingerprint.fingerprints):
        assert sorted(r.doc_id for r in run(frame(spark, docs)).collect()) == sorted(i for i, _ in docs)
    pieces = packing.pack_documents(frame(spark, docs), queries.tokenizer_file("word_bpe_49k.json")).where("start = 0").collect()
    assert sorted(r.doc_id for r in pieces) == sorted(i for i, _ in docs)


def test_a_long_run_of_one_letter(spark):
    docs = [(2, "z" * 300_000 + "q"), (1, "z" * 70), (3, "k" + "z" * 60)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeated_bytes(frame(spark, docs)).collect()}
    assert got == {1: (70, 0, 0), 2: (300_001, 300_000, 1), 3: (61, 60, 1)}


def test_runs_hold_what_their_windows_need():
    r = random.Random(8)
    texts = [" ".join(r.choice(("stone", "river", "of", "a", "light", "ß", str(r.randint(0, 10**6)))) for _ in range(n)).encode() for n in (900, 7, 0, 700)] + [b"z" * 400, b"ab" * 200]
    data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    hashes, at, who, least = suffix_dedup.minimizers(data, bounds)
    rows, place, w, extent, after, before = suffix_dedup.contexts(data, bounds, at, who, suffix_dedup.low_bits(hashes), least, 50, 26)
    windows = {(i, j) for i, t in enumerate(texts) for j in range(len(t) - 49)}
    # every window is whole in a row of its anchor, and prose has hardly one that is in two
    held = [(i, p - b + k) for i, p, b, a in zip(w.tolist(), place.tolist(), before.tolist(), after.tolist()) for k in range(b + a - 49)]
    assert set(held) <= windows and {x for x in windows if x[0] < 4} <= set(held)
    assert sum(x[0] < 4 for x in held) < 1.1 * sum(x[0] < 4 for x in windows)
    assert all(row[:a].tobytes() == texts[i][p : p + a] and not row[a:50].any() and row[50 : 50 + b].tobytes() == texts[i][p - b : p][::-1] and not row[50 + b :].any() for row, i, p, a, b in zip(rows, w.tolist(), place.tolist(), after.tolist(), before.tolist()))
    o = np.argsort(rows.view("S76").ravel(), kind="stable")
    rows, columns = rows[o], [c[o].astype(np.int64) for c in (w, place, extent, after, before)]
    blob = suffix_dedup.front_coded(rows, *columns, blank=suffix_dedup.blanks(after[o], before[o], 50, 26))
    got, _, back = suffix_dedup.decoded(blob, 76, lambda c: suffix_dedup.blanks(c[3], c[4], 50, 26))
    assert got == [x.tobytes() for x in rows] and all((x == y).all() for x, y in zip(back, columns))
    assert len(blob) < 40 * len(rows)


def test_suffix_dedup_of_few_letters(spark):
    r = random.Random(12)
    word = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
    shared = [word(n, letters) for n, letters in ((50, "ab"), (51, "abc"), (49, "ab"), (120, "ab\0"), (76, "abcdefgh"), (300, "xyz"))]
    docs = [(i, "".join(r.choice((r.choice(shared), word(r.randint(0, 60), "ab"), r.choice("ab") * r.randint(0, 90), r.choice(("ab", "abc")) * r.randint(0, 50))) for _ in range(r.randint(0, 12)))) for i in range(120)]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in suffix_dedup.remove_repeated_bytes(frame(spark, docs)).collect()}
    assert got == brute.suffix_dedup(docs)


def test_loser_tree():
    r = random.Random(3)
    rows = [sorted(bytes(r.choice(b"ab") for _ in range(6)) for _ in range(r.randint(0, 30))) for _ in range(5)]
    runs = []
    for run in rows:
        a = np.frombuffer(b"".join(run), np.uint8).reshape(-1, 6)
        if len(run):
            z = np.zeros(len(run), np.int64)
            got, lcp, _ = suffix_dedup.decoded(suffix_dedup.front_coded(a, z, z, z, z), 6)
            assert got == run
            runs.append((got, lcp))
        else:
            runs.append(([], []))
    of, row, lcp = suffix_dedup.merged(runs, 6)
    got = [rows[f][k] for f, k in zip(of, row)]
    assert got == sorted(sum(rows, []))
    assert lcp[1:] == [next((i for i in range(6) if a[i] != b[i]), 6) for a, b in zip(got, got[1:])]


def test_media(spark, docs):
    text = dict(docs)
    rows = media.media_digests(frame(spark, docs)).collect()
    assert len(rows) == len(docs)
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), brute.sha(payload), zlib.crc32(payload[-64:]))
        assert r.feature.startswith("ok|A_PCM/INT/LIT|")
    same = {}
    for r in rows:
        assert same.setdefault(text[r.doc_id] or "", (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


@pytest.mark.parametrize("mode", [0, 1, 2, 3])
def test_lacing(mode):
    frames = [b"x" * 300] if mode == 0 else [b"y" * 90] * 4 if mode == 2 else [b"a" * s for s in (0, 700, 255, 254, 1, 70_000, 3)]
    raw = media.lace(frames, mode)
    sizes, at = media.lace_sizes(raw, 0, len(raw), mode)
    assert sizes == [len(f) for f in frames] and raw[at:] == b"".join(frames)


def test_packets(spark):
    raw = media.mux(bytes(range(256)) * 200)
    packets, cues, codecs, status = media.parse(raw)
    assert [p[1] for p in packets] == [64_000_000 * i for i in range(100)]
    assert status == "ok" and len(packets) == 100 and [c[2] for c in cues] == sorted({p[7] for p in packets}) and packets[-1][1] >= cues[-1][0]
    df = spark.createDataFrame([(1, bytearray(raw)), (2, bytearray(raw[:3000])), (3, bytearray(b"junk")), (4, None)], "doc_id long, media binary")
    got = {r.doc_id: (r.status == "ok", len(r.packets)) for r in media.demux(df).collect()}
    assert got[1] == (True, 100) and not got[2][0] and got[3] == (False, 0) and got[4] == (False, 0)
    assert media.packet_table(df).where("doc_id = 1").agg(F.sum("size")).first()[0] == 256 * 200


def test_unknown_sizes_scales_and_references():
    whole, unknown = media.element, lambda kind, body: kind.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + body
    tracks = whole(media.TRACKS, whole(media.TRACK_ENTRY, media.number(media.TRACK_NUMBER, 2) + media.number(media.DEFAULT_DURATION, 7)))
    block = lambda at, flags, frames, mode: b"\x82" + at.to_bytes(2, "big") + bytes([flags | mode << 1]) + media.lace(frames, mode)
    one = media.number(media.TIMESTAMP, 10) + whole(media.SIMPLE_BLOCK, block(1, 0x80, [b"aa", b"b", b"ccc"], 1)) + whole(media.SIMPLE_BLOCK, block(2, 0, [b"dd"], 0))
    two = media.number(media.TIMESTAMP, 20) + whole(media.BLOCK_GROUP, whole(media.BLOCK, block(0, 0, [b"ee"], 0))) + whole(media.BLOCK_GROUP, whole(media.BLOCK, block(3, 0, [b"f", b"g"], 2)) + whole(media.REFERENCE_BLOCK, b"\xfd"))
    body = whole(media.INFO, media.number(media.TIMESTAMP_SCALE, 500)) + tracks + unknown(media.CLUSTER, one) + unknown(media.CLUSTER, two) + whole(media.CUES, whole(media.CUE_POINT, media.number(media.CUE_TIME, 20) + whole(media.CUE_POSITIONS, media.number(media.CUE_TRACK, 2) + media.number(media.CUE_CLUSTER, 99))))
    raw = whole(media.EBML, b"") + unknown(media.SEGMENT, body)
    packets, cues, _, status = media.parse(raw)
    assert status == "ok" and cues == [(10_000, 2, 99)] and len({p[7] for p in packets}) == 2
    assert [(p[0], p[1], raw[p[2] : p[2] + p[3]], p[4], p[5]) for p in packets] == [
        (2, 5500, b"aa", True, "xiph"), (2, 5507, b"b", True, "xiph"), (2, 5514, b"ccc", True, "xiph"), (2, 6000, b"dd", False, "none"),
        (2, 10_000, b"ee", True, "none"), (2, 11_500, b"f", False, "fixed"), (2, 11_507, b"g", False, "fixed"),
    ]


def test_fingerprints(spark, docs):
    rows = fingerprint.fingerprints(frame(spark, docs)).collect()
    text = {i: t or "" for i, t in docs}
    order = sorted(text, reverse=True)
    after = dict(zip(order, order[1:] + order[:1]))
    assert len(rows) == len(docs)
    prints = {t: brute.fingerprint(t) for t in set(text.values())}
    for r in rows:
        t, h = text[r.doc_id], len(text[r.doc_id]) // 2
        edited = t[: len(t) - h] + text[after[r.doc_id]][:h]
        own, changed = prints[t], brute.fingerprint(edited)
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), brute.sha(edited), brute.fingerprint_text(own), brute.fingerprint_text(changed))
        assert r.near_edited == pytest.approx(brute.likeness(own, changed)) and r.near_next == pytest.approx(brute.likeness(own, prints[text[after[r.doc_id]]]))


def test_likeness_of_long_texts(spark):
    r = random.Random(8)
    line = lambda: " ".join(str(r.randint(0, 10**6)) for _ in range(6)) + ".\n"
    docs = [(i, "".join(line() for _ in range(n))) for i, n in enumerate((3000, 3000, 300, 300, 6000, 6000))]
    for row in fingerprint.fingerprints(frame(spark, docs)).collect():
        assert 0.3 < row.near_edited < 0.75 and row.near_next < 0.3


def test_fingerprint_is_a_multiset_hash(spark):
    v = lambda c: fingerprint.vector(fingerprint.paragraphs(F.col(c)))
    df = spark.createDataFrame([("one\ntwo\ntwo", "two\none\ntwo", "one\ntwo", "two", "")], "a string, b string, c string, d string, e string").select(*(v(c).alias(c) for c in "abcde"))
    r = df.select(F.col("a") == F.col("b"), F.col("a") == F.col("c"), fingerprint.combine(F.col("c"), F.col("d")) == F.col("a"), fingerprint.combine(F.col("a"), F.col("d"), -1) == F.col("c"), fingerprint.combine(F.col("d"), F.col("d"), -1) == F.col("e"), fingerprint.likeness(F.col("a"), F.col("b")), fingerprint.likeness(F.col("a"), F.col("c"))).first()
    assert tuple(r)[:6] == (True, False, True, True, True, 1.0) and 0 < r[6] < 1


def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.identify(docs, langid.fit(docs)).withColumn("out", langid.held_out(F.col("doc_id")))
    held = got.where("out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert held[0] > 0.95 and held[1] == sum(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in docs.select("doc_id").collect())
    odd = spark.createDataFrame([(1, None, "x"), (2, "12 34 !!", "x"), (3, "", "x"), (None, "der die und das ist", None), (4, "ααα βββ", None)], "doc_id long, text string, lang_pred string")
    rows = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd, langid.fit(docs)).collect()}
    assert [rows[k] for k in (1, 2, 3)] == [("und", 0.0)] * 3 and rows[None][0] != "und" and rows[4][0] != "und"
    few = langid.fit(docs, max_bytes=20_000)  # no more than the bytes allow, but some of each language
    assert few.languages == langid.fit(docs).languages and len(few.code[0]) <= 257
    one = spark.createDataFrame([(1, "le chat " * 50, "fr"), (4, "the dog " * 5, "en")], "doc_id long, text string, lang string")
    assert langid.fit(one, max_bytes=60).languages == ["en", "fr"]
    untaught = langid.fit(docs.where("doc_id < 0"))
    assert {r.lang_pred for r in langid.identify(docs, untaught).collect()} == {"und"}


def context_counts(teachers):
    counts = [{} for _ in range(5)]
    for text in teachers:
        padded = bytes(4) + text
        for i in range(4, len(padded)):
            for o in range(5):
                c = counts[o].setdefault(padded[i - o : i], {})
                c[padded[i]] = c.get(padded[i], 0) + 1
    return counts


def code_length(counts, new):
    """Bits of ``new`` by prediction by partial matching, orders 4 to 0, method C."""
    padded, bits = bytes(4) + new, 0.0
    for i in range(4, len(padded)):
        p = 1.0
        for o in (4, 3, 2, 1, 0):
            c = counts[o].get(padded[i - o : i])
            if c is None:
                continue
            total, kinds = sum(c.values()), len(c)
            if padded[i] in c:
                p *= c[padded[i]] / (total + kinds)
                break
            p *= kinds / (total + kinds)
        else:
            p /= 256
        bits -= np.log2(p)
    return bits


def test_code_lengths_follow_the_escapes():
    one, two = [b"abracadabra abracadabra", b"abrX"], [b"brac brac", "déjà vu".encode()]
    table = {}
    for k, texts in enumerate((one, two)):
        data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
        for g in langid.grams(data, bounds).tolist():
            table.setdefault(g, [0, 0])[k] += 1
    found = np.array(sorted(table), np.uint64)
    trees = langid.Trees(["x", "y"], found, np.array([table[g] for g in found.tolist()]).T)
    r = random.Random(1)
    new = [b"abrxc", b"", b"brac abra", "dé".encode()] + [bytes(r.choice(b"abrc \0z") for _ in range(r.randint(1, 40))) for _ in range(50)]
    got = trees.lengths(np.frombuffer(b"".join(new), np.uint8), np.cumsum([0] + [len(t) for t in new])) / langid.UNIT
    for t, lengths in zip(new, got.tolist()):
        assert lengths == pytest.approx([code_length(context_counts(one), t), code_length(context_counts(two), t)], abs=0.002 * len(t) + 1e-9)


def test_predictions_are_the_shortest_codes(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    teachers = {}
    for r in rows:
        if r.lang and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            teachers.setdefault(r.lang, []).append(r.text.encode())
    counts = {k: context_counts(v) for k, v in teachers.items()}
    got = {r.doc_id: r for r in queries.op5_language(spark, sf).collect()}
    assert len(got) == len(rows)
    short = sorted((r for r in rows if r.text and any(map(str.isalpha, r.text))), key=lambda r: len(r.text))[:25]
    for r in short:
        raw = r.text.encode()
        bits = {k: code_length(c, raw) for k, c in counts.items()}
        best, odds = min(bits.values()), got[r.doc_id]
        assert bits[odds.lang_pred] <= best + 0.002 * len(raw)
        assert odds.score == pytest.approx(1 / sum(2 ** ((best - b) / len(raw) ** 0.5) for b in bits.values()), abs=0.01)
        assert odds.bits_per_byte == pytest.approx(best / len(raw), abs=0.003)


def plain_preferences(chosen, rejected):
    """By pair: prompt, chosen, rejected and the loss spans of both completions."""

    def side(rows):
        turns = {}
        for p, t, role, text in rows:
            turns.setdefault(p, {}).setdefault(t, []).append((role or "user", text or ""))
        return {p: {t: min(v) for t, v in ts.items()} for p, ts in turns.items()}

    a, b, out = side(chosen), side(rejected), {}
    order = lambda t: (t is not None, t or 0)
    show = lambda s: f"<|im_start|>{s[0]}\n{s[1]}<|im_end|>\n"
    for p in a.keys() | b.keys():
        x, y = a.get(p, {}), b.get(p, {})
        turns = sorted(x.keys() | y.keys(), key=order)
        cut = next((i for i, t in enumerate(turns) if x.get(t) != y.get(t)), len(turns))
        found = ["".join(show(x[t]) for t in turns[:cut])]
        for s in (x, y):
            text, loss = "", []
            for t in turns[cut:]:
                if t in s:
                    if s[t][0] == "assistant":
                        loss.append((len(text) + len(f"<|im_start|>{s[t][0]}\n"), len(s[t][1]) + len("<|im_end|>")))
                    text += show(s[t])
            found += [text, loss]
        out[p] = tuple(found)
    return out


SIDE = "pair_id long, turn long, role string, text string"


def both_ways(spark, a, b):
    got = chat.preference_pairs(chat.preference_turns(spark.createDataFrame(a, SIDE), spark.createDataFrame(b, SIDE))).collect()
    assert {r.pair_id: (r.prompt, r.chosen, [tuple(s) for s in r.chosen_loss], r.rejected, [tuple(s) for s in r.rejected_loss]) for r in got} == plain_preferences(a, b) and len(got) == len({r.pair_id for r in got})


def test_preferences(spark, sf):
    assert spark_rows(queries.op6_preferences(spark, sf)) == sql_rows(connection(sf), queries.ORACLE_SQL["op6_preferences"])
    a = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 1, "assistant", "yes"), (2, 0, None, None), (None, 0, "user", "x"), (None, None, "assistant", "y"), (7, -3, "user", "a"), (7, 200, "assistant", "b"), (0, 5, "user", "same")]
    b = [(1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 2, "user", "more"), (3, 0, "user", "alone"), (None, 0, "user", "x"), (7, -3, "user", "a"), (7, 200, "assistant", "c"), (0, 5, "user", "same")]
    both_ways(spark, a, b)
    r = random.Random(6)
    a, b = [], []
    for p in range(40):
        n, cut = r.choice((3, 70, 300)), r.random()
        for t in range(n):
            role = "assistant" if t % 2 else "user"
            a.append((p, t, role, "x" * r.randint(0, 9)))
            b.append(a[-1] if t < cut * n else (p, t, role, "y" * r.randint(0, 9)))
    both_ways(spark, a, b)
    empty = spark.createDataFrame([], SIDE)
    assert chat.preference_turns(empty, empty).count() == 0
    noisy = spark.createDataFrame([(4, 0, "user", "hi", 1, "k", True), (4, 1, "assistant", "ho", 1, "k", True)], SIDE + ", chunk int, pk string, starts boolean")
    assert [r.part for r in chat.preference_turns(noisy, noisy).collect()] == ["prompt"] * 2


def test_swapped_replies(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (1, 0, "user", "r"), (1, 1, "assistant", "b"), (1, 3, "assistant", None), (4, 0, "assistant", "c"), (6, 0, "user", "z"), (None, 0, "assistant", "n")]
    got = chat.swapped_replies(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(map(tuple, got)) == [(0, 1, "assistant", ""), (1, 3, "assistant", "a"), (4, 0, "assistant", "")]


def test_token_counts(spark, docs):
    path = queries.tokenizer_file("piece_bpe_32k.model")
    scores = token_counts.piece_scores(path)

    def plain(token):
        best = [(0.0, 0)] + [None] * len(token)
        for j in range(1, len(token) + 1):
            for i in range(max(0, j - 64), j):
                s = scores.get(token[i:j])
                if s is not None:
                    best[j] = max(filter(None, (best[j], (best[i][0] + s, best[i][1] - 1))))
        return -best[-1][1]

    text, memo = dict(docs), {}
    for r in token_counts.token_counts(frame(spark, docs), path).collect():
        words = brute.WORD.findall(text[r.doc_id] or "")
        if len(words) < 2000:
            counts = [memo.setdefault(w, plain("▁".encode() + w.encode())) for w in words]
            assert (r.n_pretokens, r.n_tokens, r.most_tokens) == (len(words), sum(counts), max(counts, default=0))


def test_shared_prefixes_are_scored_once():
    trie = token_counts.ForwardTrie({bytes([b]): -9.0 for b in range(256)} | {b"ab": -1.0, b"abc": -1.5})
    assert trie.counts([b"ab", b"abab", b"abc", b"abcd"]) == [1, 2, 1, 2] and trie.nodes == 6


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    path, text = queries.tokenizer_file("word_bpe_49k.json"), dict(docs)
    tokenizer = Tokenizer.from_file(path)
    rows = packing.pack_documents(frame(spark, docs), path, window=256).collect()
    pieces, windows = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(text)
    for i, ps in pieces.items():
        ids = tokenizer.encode(text[i] or "", add_special_tokens=False).ids + [1]
        ps.sort(key=lambda p: p.start)
        assert [p.start for p in ps] == list(np.cumsum([0] + [p.length for p in ps])[:-1]) and sum(p.length for p in ps) == len(ids) == ps[0].doc_tokens
        assert all(p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) for p in ps)
    for ps in windows.values():
        ps.sort(key=lambda p: p.offset)
        assert [p.offset for p in ps] == list(np.cumsum([0] + [p.length for p in ps])[:-1]) and sum(p.length for p in ps) == ps[0].sequence_tokens <= 256


def test_special_tokens_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    path, r = queries.tokenizer_file("word_bpe_49k.json"), random.Random(4)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "endoftext", " ", "\n", "a", "don't", "é", "x1", "中文", "!?"]
    docs = list(enumerate(["hello <|endoftext|> world", "x <|endof", "text|> y", "<|endoftext|>", "<|endoftext|>"] + ["".join(r.choice(bits) for _ in range(r.randint(0, 12))) for _ in range(2000)]))
    tokenizer = Tokenizer.from_file(path)
    rows = packing.pack_documents(frame(spark, docs), path).collect()
    assert len(rows) >= len(docs)
    for p in rows:
        ids = tokenizer.encode(docs[p.doc_id][1], add_special_tokens=False).ids + [1]
        assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())


def test_little_padding(spark, sf):
    rows = packing.pack_documents(spark.read.parquet(f"{sf}/documents.parquet"), queries.tokenizer_file("word_bpe_49k.json")).collect()
    fill = {r.sequence_id: r.sequence_tokens for r in rows}
    assert all(n <= 2048 for n in fill.values()) and sum(r.length for r in rows) == sum(fill.values())
    assert len(fill) <= -(-sum(fill.values()) // 2048) + 1


def test_little_padding_in_any_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    path, seen = queries.tokenizer_file("word_bpe_49k.json"), []
    for parts in (1, 64, 256):
        rows = packing.pack_table(docs.repartition(parts, "doc_id"), path).collect()
        fill, at = {}, {}
        for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == at.get(r.sequence_id, 0)
            at[r.sequence_id] = r.offset + r.length
            fill[r.sequence_id] = r.sequence_tokens
        assert at == fill and max(fill.values()) <= 2048
        assert len(fill) <= -(-sum(fill.values()) // 2048) + 1
        seen.append(sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows))
    whole = packing.pack_documents(docs, path).collect()
    assert seen[0] == seen[1] == seen[2] == sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in whole)
    assert packing.pack_table(docs.limit(0), path).count() == 0


def test_a_line_repeated_without_end_is_unlike_nothing(spark):
    docs = [(3, "x\n" * 65_536), (2, ""), (1, "x\n" * 40_000), (0, "y\n" * 200_000 + "z")]
    got = {r.doc_id: r.near_next for r in fingerprint.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[3] == 0 and got[2] == 0 and got[1] < 0.2
    again = [(2, "x\n" * 1_000_000), (1, "x\n" * 999_000)]
    assert fingerprint.fingerprints(spark.createDataFrame(again, "doc_id long, text string")).where("doc_id = 2").first().near_next > 0.99


def test_best_fit_decreasing():
    r = random.Random(2)
    lengths = [r.randint(1, 64) for _ in range(500)]
    place, left, want = packing.best_fit_decreasing(lengths, 64), [], {}
    for i in sorted(range(500), key=lambda i: -lengths[i]):
        fits = [c for c in left if c >= lengths[i]]
        c = min(fits, default=64)
        if fits:
            left.remove(c)
        left.append(c - lengths[i])
        want[i] = 64 - c
    assert [p[1] for p in place] == [want[i] for i in range(500)]
    assert len({w for w, _ in place}) == len(left)


def test_mixing(spark):
    rows = [(i, s) for s, n in (("a", 400), ("b", 100), (None, 25), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame([(k, s) for k, (_, s) in enumerate(rows)] + [(None, "c")], "doc_id long, source string")
    got = mixing.mix(df, slots=20, block=4).collect()
    assert len(got) == len(rows) + 1 and len({r.position for r in got}) == len(got) and all(-1 < r.deviation < 1 for r in got)
    weights = {r.source: r.target_weight for r in got}
    assert abs(sum(weights.values()) - 1) < 1e-9 and weights["a"] > weights["b"] > weights[None] >= weights["c"]
    own = spark.createDataFrame([("a", 3), ("b", 7)], "source string, quota int")
    order = sorted(mixing.mix(df.where("source in ('a', 'b')"), own, block=1).collect(), key=lambda r: r.position)
    for t in range(1, 101):
        assert abs(sum(r.source == "a" for r in order[:t]) - 0.3 * t) < 1
    with pytest.raises(Exception, match="no weight"):
        mixing.mix(df, own).collect()


def test_more_sources_than_slots(spark):
    rows = [(i, f"site{i}") for i in range(10_001)] + [(20_000 + i, "big") for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string")).collect()
    assert len(got) == len(rows) == len({r.position for r in got}) and all(-1 < r.deviation < 1 for r in got)
    assert {r.cycle for r in got if r.source != "big"} == {0} and len({r.slot for r in got if r.source != "big"}) == 10_001


@pytest.mark.parametrize("quota", [{"a": 7, "b": 5, "c": 3, "d": 1, "e": 1}, {"a": 1, "b": 1}, {"a": 3}, {"a": 2, "b": 9, "c": 1, "d": 4}])
def test_every_source_is_on_time(spark, quota):
    w = spark.createDataFrame(list(quota.items()), "source string, quota int")
    slots = {r.slot: (r.source, r.nth) for r in mixing.cycle(w).collect()}
    total = sum(quota.values())
    assert sorted(slots) == list(range(total))
    for slot, (s, i) in slots.items():
        assert i * total // quota[s] <= slot < -(-(i + 1) * total // quota[s])


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(name, spark, sf):
    assert spark_rows(queries.QUERIES[name](spark, sf)) == sql_rows(connection(sf), queries.ORACLE_SQL[name])


OPERATORS = {
    "op1": (lambda d: media.media_digests(d), 1),
    "op2": (lambda d: ngram_join.jaccard_components(d), 1),
    "op3": (lambda d: suffix_dedup.remove_repeated_bytes(d), 1),
    "op4": (lambda d: fingerprint.fingerprints(d), 1),
    "op5": (lambda d: langid.identify(d, langid.fit(d.withColumn("lang", F.lit("x")))), 1),
    "op7": (lambda d: token_counts.token_counts(d, queries.tokenizer_file("piece_bpe_32k.model")), 1),
    "op8": (lambda d: packing.pack_table(d, queries.tokenizer_file("word_bpe_49k.json")), 1),
    "op9": (lambda d: substring_dedup.remove_repeats(d), 1),
    "op10": (lambda d: mixing.mix(d), 1),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_tables(name, spark):
    """Empty tables, nulls in all columns, repeated rows, and columns with names that operators use."""
    run, _ = OPERATORS[name]
    schema = "doc_id long, text string, source string, part int, blob binary, kept string, n_words int, range int, __maybe boolean, row int, tag int, found string"
    assert run(spark.createDataFrame([], schema)).count() == 0
    extra = (1, bytearray(b"x"), "k", 2, 3, True, 4, 5, "f")
    rows = [(5, "a b c d e f g", "s", *extra), (5, "a b c d e f g", "s", *extra), (None, None, None, *(None,) * 9), (7, None, None, *extra), (8, "x", "s", *extra)]
    assert run(spark.createDataFrame(rows, schema)).count() == len(rows)
    nulls = [(None,) * 12] * 3
    assert run(spark.createDataFrame(nulls, schema)).count() == 3


def test_rolling_hash_of_spans():
    data = np.frombuffer(b"abcabcXabc", np.uint8)
    h = bytescan.rolling(bytescan.BYTE_VALUE[data], 3)
    assert h[0] == h[3] == h[7] and len(set(h.tolist())) == 6
    s, e, first = bytescan.words(np.frombuffer(b" ab cd\x0bef", np.uint8), np.array([0, 4, 4, 9]))
    assert (s.tolist(), e.tolist(), first.tolist()) == ([1, 4, 7], [3, 6, 9], [0, 1, 1, 3])
    assert hashlib.sha256(b"").hexdigest() == brute.sha("")
