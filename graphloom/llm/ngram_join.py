"""Exact Jaccard self-join of word shingles by universe partition.

Linked sets of at most h shingles differ in H = floor(2h / 7) of them at most (at 0.75). Sets are
banded by size, and a band's universe of hashes is cut into segments, so of two linked sets'
segments all but H are alike. Larger bands index each segment's subset; small ones fewer, larger
segments with all their one-deletion neighbours, so that a segment with one difference still
meets. The allocation follows the cost: a segment whose list is long is given nothing, as long as
the light ones left to a set outnumber H. Sets that consist of common content are left over; they
meet again over the finest partition (single shingles), where each looks up only its rarest ones,
and two sets that share no light shingle are compared only if their light ones alone don't already
make too many differences. Candidates are verified on their whole sets of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import linked
from ..storage import measured
from .bytescan import U64, chunks, lean, lean_pair, lean_task, mix, powers, prefix_sums, ragged, runs, word_hashes, words
from .exchange import BLOBS, buckets, deal, doc_bucket, gather, id_filter, small_batches, stored, stored_lean, table, with_maybe
from .repeats import FLUSH, KINDS, kind_batch

WORDS = 5
#: Longest list of documents under one signature that is paired at once.
LIGHT = 8
#: Sets up to this size get one-deletion neighbourhoods.
SMALL = 24
SLACK = 1.3
SIGNATURE, PROFILE, SEGMENTS = 0, 1, 2
PAIR, CLASS, FILLED, HEAVY, MEMBER = 0, 1, 2, 3, 4
FOUND = "kind int, a long, b long, band int, n long"


def band_edges() -> np.ndarray:
    """Smallest size of each band; the next is 1.7 times as large."""
    edges = [1]
    while edges[-1] < 2**40:
        edges.append(max(edges[-1] + 1, -(-17 * edges[-1] // 10)))
    return np.array(edges)


EDGES = band_edges()
TOPS = EDGES[1:] - 1
DIFFER = 2 * TOPS // 7
DELETIONS = TOPS <= SMALL
SEGMENT_COUNT = np.where(DELETIONS, DIFFER // 2 + 1, np.ceil(SLACK * (DIFFER + 1)).astype(np.int64))


def shingle_sets(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each document, and their bounds."""
    starts, ends, first = words(data, bounds)
    hashes = word_hashes(data, starts, ends, lower=True)
    count = np.diff(first)
    each = np.where(count > 0, np.maximum(count - WORDS + 1, 1), 0)
    at, who = ragged(first[:-1], each), np.repeat(np.arange(len(count)), each)
    if not len(at):
        return np.zeros(0, U64), np.zeros(len(bounds), np.int64)
    length = np.minimum(count, WORDS)[who]
    sums = prefix_sums(hashes)
    h = mix((sums[at + length] - sums[at]) * powers(len(sums))[1][at] + length.astype(U64) * U64(0xA0761D6478BD642F))
    o = np.argsort(h)
    o = o[np.argsort(who[o].astype(np.uint16 if len(count) < 65536 else np.int64), kind="stable")]
    h, who = h[o], who[o]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (who[1:] != who[:-1])))
    return h[new], np.concatenate(([0], np.cumsum(np.bincount(who[new], minlength=len(count)))))


def signatures(sets: np.ndarray, first: np.ndarray) -> Iterator[tuple]:
    """For each band that a set may have partners in: owners, bands and hashes of signatures; the sets, their bands and (but for small ones) their numbers of segments in use."""
    size = np.diff(first)
    home = np.searchsorted(EDGES, size, "right") - 1
    for step in range(len(EDGES)):
        band = home + step
        who = np.flatnonzero((size > 0) & (4 * size >= 3 * EDGES[np.minimum(band, len(EDGES) - 1)]))
        if not len(who):
            return
        for small in (False, True):
            mine = who[DELETIONS[band[who]] == small]
            if not len(mine):
                continue
            b, n = band[mine], size[mine]
            u = sets[ragged(first[mine], n)]
            owner = np.repeat(np.arange(len(mine)), n)
            m = SEGMENT_COUNT[b]
            segment = ((u >> U64(32)) * m[owner].astype(U64) >> U64(32)).astype(np.int64)
            value = mix(u ^ U64(0xE7037ED1A0B428DB))
            salt = lambda o, s: b[o].astype(U64) * U64(0x8EBC6AF09C88C6E3) + s.astype(U64) * U64(0x589965CC75374CC3)  # noqa: E731, B023
            if not small:
                start = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (segment[1:] != segment[:-1]))))
                o = owner[start]
                yield mine[o], b[o], mix(np.add.reduceat(value, start) + salt(o, segment[start])), mine, b, np.bincount(o, minlength=len(mine))
            else:
                base = np.concatenate(([0], np.cumsum(m)))
                total = np.zeros(base[-1], U64)
                np.add.at(total, base[owner] + segment, value)
                o = np.repeat(np.arange(len(mine)), m)
                s = np.arange(base[-1]) - base[o]
                whole = mix(total + salt(o, s))
                less = mix(total[base[owner] + segment] - value + salt(owner, segment))
                o = np.concatenate((o, owner))
                yield mine[o], b[o], np.concatenate((whole, less)), mine, b, None


def _rows(kind: int, a, b=None, band=None, n=None) -> pa.RecordBatch:
    zero = np.zeros(len(a), np.int64)
    c = [np.full(len(a), kind), a, zero if b is None else b, zero if band is None else band, zero if n is None else n]
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x).astype(t)) for x, t in zip(c, (np.int32, np.int64, np.int64, np.int32, np.int64))], names=["kind", "a", "b", "band", "n"])


def light_pairs(docs: np.ndarray, first: np.ndarray, count: np.ndarray, band: np.ndarray) -> list[np.ndarray]:
    """(smaller, larger, band, lists in which they meet) of all pairs in lists of 2 to LIGHT documents."""
    found = []
    for size in range(2, LIGHT + 1):
        at = first[count == size]
        if len(at):
            members = docs[at[:, None] + np.arange(size)]
            i, j = np.triu_indices(size, 1)
            found.append((members[:, i].ravel(), members[:, j].ravel(), np.repeat(band[at], len(i))))
    if not found:
        return [np.zeros(0, np.int64)] * 4
    a, b, k = (np.concatenate(c) for c in zip(*found))
    o = np.lexsort((b, a, k))
    a, b, k = a[o], b[o], k[o]
    start = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (k[1:] != k[:-1]))))
    return [a[start], b[start], k[start], np.diff(np.append(start, len(a)))]


def lists(docs: np.ndarray, key: np.ndarray, *columns: np.ndarray) -> tuple:
    """Entries by key, then document, each (key, document) once; the lists' starts and lengths."""
    o = np.lexsort((docs, key))
    docs, key, columns = docs[o], key[o], [c[o] for c in columns]
    if len(docs):
        new = np.concatenate(([True], (docs[1:] != docs[:-1]) | (key[1:] != key[:-1])))
        docs, key, columns = docs[new], key[new], [c[new] for c in columns]
    start = runs(key)
    return docs, key, columns, start, np.diff(np.append(start, len(docs)))


def first_round(docs: DataFrame, n: int) -> DataFrame:
    """FOUND rows: PAIR, CLASS (a's equal of smallest id b, n shingles), FILLED (segments in use in a band) and HEAVY (long lists in a band)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        held: list[tuple] = []
        count = 0

        def send() -> Iterator[pa.RecordBatch]:
            who, band, sig = (np.concatenate(c) for c in zip(*held))
            rows = deal(((sig >> U64(40)) % U64(n)).astype(np.int64), who, sig.astype(np.uint32), band)
            for i in range(0, len(rows), 64):
                yield kind_batch(SIGNATURE, rows[i : i + 64])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            profile, used = [], []
            for lo, hi, data, bounds in chunks(batch.column(1)):
                names = ids[lo:hi]
                sets, first = shingle_sets(data, bounds)
                size = np.diff(first)
                sums = [np.concatenate(([U64(0)], np.cumsum(mix(sets ^ U64(c)))))[first] for c in (0x1D8E4E27C47D124F, 0xEB44ACCAB455D165)]
                one, two = (np.diff(s) for s in sums)
                profile.append((names, size, one, two))
                new = np.zeros(hi - lo, bool)
                for i, f in enumerate(zip(one.tolist(), two.tolist())):
                    if size[i] and f not in seen:
                        seen.add(f)
                        new[i] = True
                own = np.flatnonzero(new)
                part = np.concatenate(([0], np.cumsum(size[own])))
                for owner, band, sig, mine, b, filled in signatures(sets[ragged(first[own], size[own])], part):
                    held.append((names[own][owner], band.astype(np.uint8), sig))
                    count += len(sig)
                    if filled is not None:
                        used.append((names[own][mine], b, filled))
                if count >= FLUSH:
                    yield from send()
                    held, count = [], 0
            if profile:
                names, size, one, two = (np.concatenate(c) for c in zip(*profile))
                yield kind_batch(PROFILE, deal(((one >> U64(33)) % U64(n)).astype(np.int64), names, size.astype(np.uint32), one, two))
            if used:
                names, band, filled = (np.concatenate(c) for c in zip(*used))
                yield kind_batch(SEGMENTS, deal(doc_bucket(names, n), names, band.astype(np.uint8), filled.astype(np.uint32)))
        if count:
            yield from send()

    def meet(t: pa.Table) -> pa.Table:
        kind = t.column("kind").to_numpy()
        of = lambda k: t.filter(pa.array(kind == k)).column("blob")
        out = []
        names, size, one, two = gather(of(PROFILE), (np.int64, np.uint32, np.uint64, np.uint64))
        o = np.lexsort((names, two, one, size))
        names, size, one, two = names[o], size[o], one[o], two[o]
        if len(names):
            new = np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (size[1:] != size[:-1]))) | (size == 0)
            start = np.flatnonzero(new)
            out.append(_rows(CLASS, names, np.repeat(names[start], np.diff(np.append(start, len(names)))), None, size))
        names, band, filled = gather(of(SEGMENTS), (np.int64, np.uint8, np.uint32))
        out.append(_rows(FILLED, names, None, band, filled))
        names, sig, band = gather(of(SIGNATURE), (np.int64, np.uint32, np.uint8))
        names, key, (band,), start, count = lists(names, sig.astype(U64) << U64(8) | band.astype(U64), band)
        a, b, k, s = light_pairs(names, start, count, band)
        out.append(_rows(PAIR, a, b, k, s))
        long_ = np.repeat(count > LIGHT, count)
        h, c = np.unique(np.stack((names[long_], band[long_].astype(np.int64))), axis=1, return_counts=True)
        out.append(_rows(HEAVY, h[0], None, h[1], c))
        return pa.Table.from_batches(out)

    return docs.where("doc_id is not null").mapInArrow(lean_task(task), KINDS).groupBy("part").applyInArrow(lean(meet), FOUND)


def second_round(sets: DataFrame, n: int) -> DataFrame:
    """Over single shingles: (kind PAIR, a, b, n lists) and (MEMBER, part, blob) of the long lists' entries by document."""
    schema = "kind int, a long, b long, n long, part int, blob binary"
    names = ["kind", "a", "b", "n", "part", "blob"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who = batch.column(0).to_numpy()
            sets = [np.frombuffer(s.as_buffer(), U64) for s in batch.column(2)]
            if sets:
                size = np.array([len(s) for s in sets])
                u = np.concatenate(sets)
                yield table(deal(((u >> U64(40)) % U64(n)).astype(np.int64), np.repeat(who, size), u.astype(np.uint32), np.repeat(size, size).astype(np.uint32)))

    def meet(key: tuple, t: pa.Table) -> pa.Table:
        part = key[0].as_py()
        docs, low, size = gather(t.column("blob"), (np.int64, np.uint32, np.uint32))
        docs, low, (size,), start, count = lists(docs, low, size)
        a, b, _, s = light_pairs(docs, start, count, np.zeros(len(docs), np.int64))
        each = np.repeat(count, count)
        long_ = each > LIGHT
        rows = deal(doc_bucket(docs[long_], n), docs[long_], size[long_], each[long_].astype(np.uint32), np.full(int(long_.sum()), part, np.uint32), low[long_])
        z = np.zeros(len(rows), np.int64)
        cols = [np.concatenate((np.full(len(a), PAIR), np.full(len(rows), MEMBER))).astype(np.int32), *(np.concatenate((c, z)).astype(np.int64) for c in (a, b, s)), np.concatenate((np.zeros(len(a)), [r[0] for r in rows])).astype(np.int32)]
        return pa.table([*map(pa.array, cols), pa.array([None] * len(a) + [r[1] for r in rows], pa.binary())], names=names)

    return sets.mapInArrow(lean_task(task), BLOBS).groupBy("part").applyInArrow(lean_pair(meet), schema)


#: Classes of long lists in a set's sketch; the sum of the smaller counts bounds what two sets share.
SKETCH = 64
#: part of the row that has a set's light shingles and no list.
NO_LIST = -1


def rarest(members: DataFrame) -> DataFrame:
    """(part, low, doc, light, size, sketch): of the long lists, those that a set needs besides its light shingles, the shortest first, so that a quarter of it and one more are looked up; and a row without a list for each set."""

    def choose(t: pa.Table) -> pa.Table:
        docs, size, count, part, low = gather(t.column("blob"), (np.int64, np.uint32, np.uint32, np.uint32, np.uint32))
        o = np.lexsort((low, part, count, docs))
        docs, size, count, part, low = docs[o], size[o].astype(np.int64), count[o], part[o].astype(np.int64), low[o]
        start = runs(docs)
        heavy = np.diff(np.append(start, len(docs)))
        who = np.repeat(np.arange(len(start)), heavy)
        light = size[start] - heavy
        sketch = np.bincount(who * SKETCH + low % SKETCH, minlength=len(start) * SKETCH).reshape(-1, SKETCH)
        sketch = np.minimum(sketch, 65535).astype(np.uint16)
        keep = np.flatnonzero(np.arange(len(docs)) - start[who] < size // 4 + 1 - light[who])
        w = np.concatenate((who[keep], np.arange(len(start))))
        cols = [np.concatenate((part[keep], np.full(len(start), NO_LIST))), np.concatenate((low[keep], np.zeros(len(start)))), docs[start][w], light[w], size[start][w]]
        raw = [r.tobytes() for r in sketch]
        return pa.table([*(pa.array(c.astype(np.int64)) for c in cols), pa.array([raw[i] for i in w.tolist()], pa.binary())], names=["part", "low", "doc", "light", "size", "sketch"])

    return members.groupBy("part").applyInArrow(lean(choose), "part long, low long, doc long, light long, size long, sketch binary")


def star_pairs(lists_: DataFrame) -> DataFrame:
    """(a, b): each long list's set with the fewest light shingles, with every other that it may link to: what both have in long lists must do for the similarity."""
    leader = lists_.groupBy("part", "low").agg(F.min(F.struct("light", "doc", "size")).alias("l"))
    shared = F.least(F.col("size") - F.col("light"), F.col("l.size") - F.col("l.light"))
    both = lists_.join(leader, ["part", "low"]).where((F.col("doc") != F.col("l.doc")) & (7 * shared >= 3 * (F.col("size") + F.col("l.size"))))
    return both.select(F.least("doc", "l.doc").alias("a"), F.greatest("doc", "l.doc").alias("b")).distinct()


#: Tasks' worth of lists for each bucket, so that the many lists of one family of near copies don't meet in one.
LIST_DEALS = 8


#: Rows of a long list that meet in one task; a longer list is cut into blocks, and each two of them meet.
LIST_BLOCK = 16384


def apart_pairs(lists_: DataFrame, labels: DataFrame, n: int, block: int = LIST_BLOCK) -> DataFrame:
    """(a, b): pairs of one long list that may link and are in different components so far.

    What such two share lies in long lists, so a set of which less than three quarters do links
    with none. Within a list, sets go by size, and each looks only at the sizes that it could
    link to; those of the most frequent component look at no others, but are looked at.
    """
    rows = lists_.where(4 * (F.col("size") - F.col("light")) >= 3 * F.col("size"))
    rows = rows.join(labels.withColumnRenamed("v", "doc"), "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    mixed = rows.groupBy("part", "low").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("k")).where("x <> y")
    rows = rows.join(mixed.select("part", "low", F.ceil(F.col("k") / block).alias("blocks")), ["part", "low"])
    rows = rows.withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))

    def pairs(t: pa.Table) -> pa.Table:
        part, low, x, y, own, docs, light, size, label = (t.column(c).to_numpy() for c in ("part", "low", "x", "y", "own", "doc", "light", "size", "label"))
        o = np.lexsort((size, y, x, low, part))
        part, low, x, y, own, docs, light, size, label = (c[o] for c in (part, low, x, y, own, docs, light, size, label))
        sketches = np.frombuffer(b"".join(s.as_buffer().to_pybytes() for s in t.column("sketch")), np.uint16).reshape(-1, SKETCH)[o]
        heavy, found = size - light, []
        cut = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (low[1:] != low[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])))) if len(low) else np.zeros(0, int)
        for u, v in zip(cut, np.append(cut[1:], len(low))):
            s, h, name, doc, half = size[u:v], heavy[u:v], label[u:v], docs[u:v], own[u:v]
            # A count that doesn't fit bounds nothing.
            sketch = sketches[u:v].astype(np.int64)
            sketch[sketch == 65535] = 1 << 40
            values, many = np.unique(name, return_counts=True)
            main = name == values[many.argmax()]
            least = np.searchsorted(s, -(-3 * s // 4), "left")
            most = np.searchsorted(s, np.minimum(4 * s // 3, 7 * h // 3 - s), "right")
            for i in np.flatnonzero(~main & (most > least)):
                j = np.arange(least[i], most[i])
                need = 3 * (s[i] + s[j])
                j = j[(name[j] != name[i]) & (main[j] | (j > i)) & (7 * h[j] >= need) & ((half[j] != half[i]) | (x[u] == y[u]))]
                j = j[7 * np.minimum(sketch[i], sketch[j]).sum(1) >= 3 * (s[i] + s[j])]
                if len(j):
                    found.append(np.stack((np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j]))))
        got = np.unique(np.concatenate(found, 1), axis=1) if found else np.zeros((2, 0), np.int64)
        return pa.table([pa.array(got[0]), pa.array(got[1])], names=["a", "b"])

    dealt = rows.withColumn("deal", F.pmod(F.xxhash64("part", "low", "x", "y"), F.lit(LIST_DEALS * n)))
    return dealt.groupBy("deal").applyInArrow(lean(pairs), "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that are linked: 100 * intersection >= 75 * union of their whole sets."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= 75 * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    return left.select("a", "b", "x", "y").mapInArrow(lean_task(test), "a long, b long")


def _band(size: Column) -> Column:
    return F.size(F.filter(F.array(*(F.lit(int(e)) for e in EDGES[EDGES < 2**31])), lambda e: e <= size)) - 1


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, set_id): the smallest id reachable over links, and the smallest id with the same set.

    Null text, and text without words, has no shingles and is linked with nothing; with fewer
    than five words all of them are one. Equal texts share a set. Repeated rows of an id give one
    row each; rows that share an id but not their text are vertices of their own, each with its own
    links. A null id gives a row of its own (component null). No rows give none; other columns
    are ignored. Sets are whole, whatever the text's length.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    told = F.xxhash64("text")
    several = source.where("doc_id is not null").groupBy("doc_id").agg(F.min(told).alias("lo"), F.max(told).alias("hi"))
    several, seen = measured(several.where("lo <> hi").select("doc_id"), "shared-ids", n=F.count(F.lit(1)))
    if not seen["n"]:
        return _components(source)

    # Texts of shared ids get ids of their own, below all others.
    rows = source.join(several.select("doc_id", F.lit(True).alias("shared")), "doc_id", "left").withColumn("told", F.when(F.col("shared"), told))
    least = source.agg(F.min("doc_id")).first()[0]
    names = rows.where("shared").select("doc_id", "told").distinct()
    names = stored(names.withColumn("vertex", F.lit(least) - 1 - F.monotonically_increasing_id()), "vertices")
    named = rows.join(names, ["doc_id", "told"], "left").withColumn("vertex", F.coalesce("vertex", "doc_id"))
    found = _components(named.select(F.col("vertex").alias("doc_id"), "text")).withColumnRenamed("doc_id", "vertex")
    found = stored(found.join(names.select("vertex", "doc_id"), "vertex", "left").withColumn("doc_id", F.coalesce("doc_id", "vertex")), "found")
    top = lambda key, name: found.groupBy(F.col(key)).agg(F.min("doc_id").alias(name))
    out = found.join(top("component_id", "component"), "component_id", "left").join(top("set_id", "set"), "set_id", "left")
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.col("set").alias("set_id"))


def _components(source: DataFrame) -> DataFrame:
    """The same for (doc_id, text) rows of which all with one id have one text."""
    spark = source.sparkSession
    n = buckets(spark)
    found = stored_lean(first_round(source, n), "segments")
    profile = found.where(F.col("kind") == CLASS).select(F.col("a").alias("doc_id"), F.col("b").alias("set_id"), F.col("n").alias("size"))
    one = profile.groupBy("doc_id").agg(F.min("set_id").alias("set_id"), F.max("size").alias("size"))

    filled = found.where(F.col("kind") == FILLED).groupBy("a", "band").agg(F.max("n").alias("filled"))
    heavy = found.where(F.col("kind") == HEAVY).groupBy("a", "band").agg(F.sum("n").alias("heavy"))
    light = stored(filled.join(heavy, ["a", "band"], "full").select("a", "band", (F.col("filled") - F.coalesce("heavy", F.lit(0))).alias("light")).join(one.withColumnRenamed("doc_id", "a"), "a"), "light")
    tops = F.array(*(F.lit(int(t)) for t in TOPS[TOPS < 2**31]))
    most = F.least(F.element_at(tops, F.col("band") + 1).cast("long"), F.floor(F.col("size") * 4 / 3))
    # Small bands have no light count: any long list leaves the set over.
    left_over = light.where(F.col("light").isNull() | (F.col("light") <= F.floor((F.col("size") + most) / 7))).select(F.col("set_id").alias("doc_id")).distinct()

    met = found.where(F.col("kind") == PAIR).groupBy("a", "b", "band").agg(F.sum("n").alias("met"))
    side = lambda x: one.select(F.col("doc_id").alias(x), F.col("set_id").alias(f"set_{x}"), F.col("size").alias(f"size_{x}"))
    spare = lambda x: light.select(F.col("a").alias(x), "band", F.col("light").alias(f"light_{x}"))
    met = met.join(side("a"), "a").join(side("b"), "b").where("set_a <> set_b")
    differ = F.floor((F.col("size_a") + F.col("size_b")) / 7)
    met = met.where((F.col("band") == _band(F.greatest("size_a", "size_b"))) & (4 * F.least("size_a", "size_b") >= 3 * F.greatest("size_a", "size_b")))
    met = met.join(spare("a"), ["a", "band"], "left").join(spare("b"), ["b", "band"], "left")
    met = met.where(F.col("met") >= F.coalesce(F.greatest("light_a", "light_b"), F.lit(0)) - differ)
    pairs = stored(met.select(F.least("set_a", "set_b").alias("a"), F.greatest("set_a", "set_b").alias("b")).distinct(), "pairs")
    left_over = stored(left_over, "left-over")

    needed = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).union(left_over)

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in chunks(batch.column(1)):
                sets, first = shingle_sets(data, bounds)
                raw, cut = sets.tobytes(), (first * 8).tolist()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(first)), pa.array([raw[x:y] for x, y in zip(cut, cut[1:])], pa.binary())], names=["doc_id", "size", "shingles"])

    wanted = with_maybe(source.where("doc_id is not null"), id_filter(needed)).where("__maybe").drop("__maybe")
    sets = stored_lean(wanted.mapInArrow(lean_task(sets_of), "doc_id long, size long, shingles binary").dropDuplicates(["doc_id"]), "sets")

    with small_batches(spark, 400):
        again = stored(second_round(with_maybe(sets, id_filter(left_over)).where("__maybe").drop("__maybe"), n), "shingles")
    members = stored(rarest(again.where(F.col("kind") == MEMBER).select("part", "blob")), "lists")
    lights = sets.select("doc_id", "size").join(members.where(F.col("part") == NO_LIST).select(F.col("doc").alias("doc_id"), "light"), "doc_id", "left").withColumn("light", F.coalesce("light", "size"))
    long_lists = members.where(F.col("part") != NO_LIST)
    side = lambda x: lights.select(F.col("doc_id").alias(x), F.col("size").alias(f"size_{x}"), F.col("light").alias(f"light_{x}"))
    fine = again.where(F.col("kind") == PAIR).groupBy("a", "b").agg(F.sum("n").alias("met")).join(side("a"), "a").join(side("b"), "b")
    fine = fine.where((F.col("light_a") + F.col("light_b") - 2 * F.col("met") <= differ) & (4 * F.least("size_a", "size_b") >= 3 * F.greatest("size_a", "size_b"))).select("a", "b")

    with small_batches(spark, 400):
        links = stored(verified(pairs.union(fine).union(star_pairs(long_lists)).distinct(), sets), "links")
    labels = linked(links)
    with small_batches(spark, 400):
        more = stored(verified(apart_pairs(long_lists, labels, n), sets), "more-links")
    if not more.isEmpty():
        labels = linked(links.union(more))
    return source.select("doc_id").join(one, "doc_id", "left").join(labels.withColumnRenamed("v", "set_id").withColumnRenamed("label", "linked"), "set_id", "left").select(
        "doc_id", F.coalesce("size", F.lit(0)).alias("n_shingles"), F.coalesce("linked", "set_id").alias("component_id"), "set_id"
    )
