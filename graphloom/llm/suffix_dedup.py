"""Suffix-array dedup of bytes by a distributed, common-prefix-aware merge sort.

Only suffixes that can share 50 bytes with another document are sorted. In every window of 50
bytes the least hash of its 24-byte spans is an anchor (so equal windows have equal anchors), and
anchors that one document alone holds end there. For the rest, tasks sort the suffixes that begin
at anchors, as far as windows with that anchor reach, together with the bytes before them, into
runs; a run goes out front-coded (common prefix with its predecessor, then what differs) and
compressed, all suffixes of one anchor to one task. There a
loser tree merges the runs: it compares common-prefix lengths, and bytes only beyond a prefix that
both are known to share; the lengths it puts out are the suffix array's LCP table, whose intervals
decide all windows of 50 bytes around an anchor, without hashes.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import BYTE_VALUE, U64, chunks, lean, ragged, rolling, runs
from .exchange import BLOBS, buckets, narrow, packed_column, partitions, read_column, stored_lean
from .repeats import KINDS, Marks, Members, blob_table, cut_out, keyed, kind_table, mark_rows, shared_anchors, split_kinds, tagged, with_blobs

WINDOW, SPAN = 50, 24
#: Anchors that a task merges before it sends them: they are fewer than windows of words, so more text fits.
FLUSH = 800_000
#: Anchors whose surroundings are looked at together.
SLICE = 20_000


def minimizers(data: np.ndarray, bounds: np.ndarray, window: int = WINDOW, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, places and documents of the anchors: spans whose hash is the least of some window inside one document.

    The last array has the least hash (its ``low_bits``) of the window that begins at p at p + window - span; 0 is none.
    """
    size, wide = np.diff(bounds), window - span + 1
    hashes = rolling(BYTE_VALUE[data], span)
    if len(data) < window:
        return hashes[:0], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
    low = low_bits(hashes)
    least = low[: len(data) - window + 1].copy()
    reach, step = low, 1
    while step * 2 <= wide:
        reach = np.minimum(reach[:-step], reach[step:])
        step *= 2
    least = np.minimum(reach[: len(least)], reach[wide - step : wide - step + len(least)])
    # Windows that cross documents, or lie in one that is too short, have no anchor.
    edge = bounds[1:-1]
    least[_near(edge, window - 1, len(least))] = 0
    padded = np.zeros(len(low) + wide - 1, np.uint32)
    padded[wide - 1 : wide - 1 + len(least)] = least
    reach, step = padded, 1
    while step * 2 <= wide:
        reach = np.maximum(reach[:-step], reach[step:])
        step *= 2
    most = np.maximum(reach[: len(low)], reach[wide - step : wide - step + len(low)])
    at = np.flatnonzero(low == most)
    who = np.searchsorted(bounds, at, "right") - 1
    inside = (size[who] >= window) & (at + span <= bounds[who + 1])
    at, who = at[inside], who[inside]
    return hashes[at], at, who, padded


def low_bits(hashes: np.ndarray) -> np.ndarray:
    """What windows compare of the hashes; never 0."""
    return (hashes >> U64(32)).astype(np.uint32) | np.uint32(1)


def _near(edges: np.ndarray, before: int, limit: int) -> np.ndarray:
    """All places in [edge - before, edge) that are in [0, limit)."""
    at = ragged(edges - before, np.full(len(edges), before))
    return at[(at >= 0) & (at < limit)]


def front_coded(rows: np.ndarray, docs: np.ndarray, *columns: np.ndarray, blank: np.ndarray | None = None) -> bytes:
    """A sorted run: rows (n x width bytes) as common prefix and remainder, with document and further whole numbers, compressed.

    blank: places of the rows that are 0 and that ``decoded`` can tell from the columns; they take no room.
    """
    n, width = rows.shape
    lcp = common(rows)
    base = int(docs.min())
    sent = np.arange(width) >= lcp[:, None]
    rest = rows[sent if blank is None else sent & ~blank]
    raw = b"".join((struct.pack("<qqB", n, base, len(columns)), *(packed_column(narrow(c)) for c in (docs - base, *columns)), lcp.tobytes(), rest.tobytes()))
    return struct.pack("<q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def common(rows: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the one before it."""
    lcp = np.zeros(len(rows), np.uint8)
    for i in range(1, len(rows), SLICE):
        same = rows[i : i + SLICE] == rows[i - 1 : i - 1 + SLICE][: len(rows) - i]
        lcp[i : i + SLICE] = np.where(same.all(1), rows.shape[1], same.argmin(1))
    return lcp


def decoded(blob: bytes, width: int, blank: Callable | None = None) -> tuple[list[bytes], list[int], list[np.ndarray]]:
    """A run's rows, their common prefixes, and the other columns; blank: columns -> the places that were left out."""
    blob = pa.decompress(blob[8:], struct.unpack_from("<q", blob)[0], codec="zstd", asbytes=True)
    n, base, more = struct.unpack_from("<qqB", blob)
    p, columns = 17, []
    for _ in range(more + 1):
        column, p = read_column(blob, p, n)
        columns.append(column.astype(np.int64))
    columns[0] += base
    lcp = np.frombuffer(blob, np.uint8, n, p)
    sent = np.arange(width) >= lcp[:, None]
    if blank is not None:
        sent &= ~blank(columns)
    rest = np.zeros((n, width), np.uint8)
    rest[sent] = np.frombuffer(blob, np.uint8, offset=p + n)
    rest, lcp = rest.tobytes(), lcp.tolist()
    row, rows = b"", []
    for end, k in zip(range(width, len(rest) + 1, width), lcp):
        row = row[:k] + rest[end - width + k : end]
        rows.append(row)
    return rows, lcp, columns


def beyond(x: bytes, y: bytes, known: int) -> int:
    """Bytes that x and y share; the first ``known`` of them aren't looked at again."""
    number = int.from_bytes
    apart = number(x[known:], "big") ^ number(y[known:], "big")
    return len(x) - ((apart.bit_length() + 7) >> 3)


def merged(sorted_runs: list[tuple[list[bytes], list[int]]], width: int) -> tuple[list[int], list[int], list[int]]:
    """Run, row and common prefix with its predecessor of every row, in order, by a loser tree.

    Each head's lcp is its common prefix with the row that was put out last. Of two heads the one
    with the longer prefix is the smaller; only if they are equal are bytes looked at, from that
    prefix on, and the loser then remembers the prefix that it shares with the winner.
    """
    k = len(sorted_runs)
    size = 1 << max(0, k - 1).bit_length()
    rows = [r for r, _ in sorted_runs] + [[]] * (size - k)
    prefixes = [p for _, p in sorted_runs] + [[]] * (size - k)
    at, head, lcp = [0] * size, [r[0] if r else b"" for r in rows], [0 if r else -1 for r in rows]
    loser = [0] * size

    def duel(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        known = lcp[a]
        if known != lcp[b]:
            return (a, b) if known > lcp[b] else (b, a)
        if known < 0:
            return a, b
        shared = beyond(head[a], head[b], known)
        if shared < width and head[b][shared] < head[a][shared]:
            a, b = b, a
        lcp[b] = shared
        return a, b

    node = [0] * size + list(range(size))
    for i in range(size - 1, 0, -1):
        node[i], loser[i] = duel(node[2 * i], node[2 * i + 1])
    w = node[1] if size > 1 else 0
    of, row, common_ = [], [], []
    for _ in range(sum(map(len, rows))):
        of.append(w)
        row.append(at[w])
        common_.append(lcp[w])
        at[w] = p = at[w] + 1
        if p < len(rows[w]):
            head[w], lcp[w] = rows[w][p], prefixes[w][p]
        else:
            lcp[w] = -1
        i = (w + size) >> 1
        while i:
            o = loser[i]
            known, other = lcp[w], lcp[o]
            if other > known:
                loser[i], w = w, o
            elif other == known >= 0:
                w, loser[i] = duel(w, o)
            i >>= 1
    return of, row, common_


def repeated(rows: np.ndarray, lcp: np.ndarray, docs: np.ndarray, after: np.ndarray, before: np.ndarray, window: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted rows: which have a window that a smaller document has too, and the least and most bytes before the anchor at which such windows begin.

    Two rows share the window that begins ``a`` bytes before the anchor if they lie in one
    interval of the LCP table at depth window - a, and, sorted by the bytes before the anchor, in
    one interval of that order's table at depth a.
    """
    n, wide = len(rows), window - span + 1
    first = np.flatnonzero(lcp < span)
    of_many = np.repeat(np.minimum.reduceat(docs, first) != np.maximum.reduceat(docs, first), np.diff(np.append(first, n)))
    keep = np.flatnonzero(of_many)
    rows, lcp, docs, after, before = rows[keep], lcp[keep], docs[keep], after[keep], before[keep]
    nearest, furthest = np.full(len(keep), 255, np.uint8), np.zeros(len(keep), np.uint8)
    if not len(keep):
        return keep, nearest.astype(np.int64), furthest.astype(np.int64)
    back = np.ascontiguousarray(rows[:, window:])
    by_back = np.argsort(back.view(f"S{back.shape[1]}").ravel(), kind="stable")
    back_lcp = common(back[by_back])
    for a in range(wide):
        able = np.flatnonzero((after >= window - a) & (before >= a))
        if not len(able):
            continue
        behind = np.empty(len(keep), np.int64)
        behind[by_back] = np.cumsum(back_lcp < a)
        key = (np.cumsum(lcp < window - a) * (len(keep) + 1) + behind)[able]
        o = np.argsort(key)
        key, who = key[o], able[o]
        start = runs(key)
        least = np.repeat(np.minimum.reduceat(docs[who], start), np.diff(np.append(start, len(key))))
        later = who[docs[who] > least]
        nearest[later] = np.minimum(nearest[later], a)
        furthest[later] = a
    hit = nearest < 255
    return keep[hit], nearest[hit].astype(np.int64), furthest[hit].astype(np.int64)


def blanks(after: np.ndarray, before: np.ndarray, window: int, wide: int) -> np.ndarray:
    """Places of the rows of ``contexts`` that lie beyond the bytes after and before the anchor."""
    return np.concatenate((np.arange(window) >= after[:, None], np.arange(wide) >= before[:, None]), axis=1)


def contexts(data: np.ndarray, bounds: np.ndarray, at: np.ndarray, who: np.ndarray, own: np.ndarray, least: np.ndarray, window: int, wide: int) -> tuple[np.ndarray, ...]:
    """Anchors with the bytes around them: rows, places in the document, documents, extents, bytes after and before.

    A row has room for ``window`` bytes from the anchor on and ``wide`` bytes before it, backwards;
    it holds those of the windows whose anchor this is, by its hash (``own``) and the windows' least
    ones, and 0 elsewhere. Which windows these are depends on the same bytes, and a window that
    documents share has the same anchor in each, so no window is decided by less than the whole of
    it. Neighbours with equal rows, as in a run of one letter, are one entry that extends from the
    first to the last: their windows overlap.
    """
    steps = np.concatenate((np.arange(window), -1 - np.arange(wide)))
    found = []
    for i in range(0, len(at), SLICE):
        p, w = at[i : i + SLICE], who[i : i + SLICE]
        # Column j is the window that begins wide - j bytes before the anchor.
        mine = least[p[:, None] + np.arange(wide + 1)] == own[i : i + SLICE, None]
        after, before = window - mine[:, ::-1].argmax(1), wide - mine.argmax(1)
        rows = data[np.clip(p[:, None] + steps, 0, len(data) - 1)]
        rows[blanks(after, before, window, wide)] = 0
        new = np.ones(len(p), bool)
        new[1:] = (rows[1:] != rows[:-1]).any(1) | (w[1:] != w[:-1]) | (p[1:] - p[:-1] > window - SPAN + 1) | (after[1:] != after[:-1]) | (before[1:] != before[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(p)) - 1
        found.append((rows[first], (p - bounds[w])[first], w[first], (p[last] - p[first]).astype(np.uint32), after[first].astype(np.uint8), before[first].astype(np.uint8)))
    return tuple(np.concatenate(c) for c in zip(*found))


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept): every byte is removed that a string of ``window`` bytes covers which also starts in a document with a smaller id.

    Strings are judged on the input; matches never cross documents. spans are the maximal removed
    runs (start, end) and kept the bytes that stay (perhaps not valid UTF-8). Null text is empty.
    Rows that repeat an id remove nothing from each other; each is judged by its own text. A row
    with a null id stays whole and removes nothing. No rows give none; other columns are ignored.
    Ids may be any whole numbers. A text is handled whole, so a task needs memory for the longest;
    a run of one letter, however long, is one entry.
    """
    n, m, width = partitions(docs.sparkSession), buckets(docs.sparkSession), 2 * window - span
    wide = window - span
    source = tagged(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")))

    def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple:
        hashes, _, who, _ = minimizers(data, bounds, window, span)
        return hashes, who, np.ones(len(who), bool)

    hits = stored_lean(shared_anchors(source, anchors, n, m, FLUSH), "anchors")

    def sort(left: pa.Table, right: pa.Table) -> pa.Table:
        member, found = Members(right.column("blob")), []
        ids, tags = left.column("doc_id").to_numpy(), left.column("tag").to_numpy()
        for lo, hi, data, bounds in chunks(left.column("text")):
            hashes, at, who, least = minimizers(data, bounds, window, span)
            keys = keyed(hashes, n)
            hit = member(ids[lo:hi][who], keys)
            at, who, keys = at[hit], who[hit], keys[hit]
            if not len(at):
                continue
            rows, place, w, extent, after, before = contexts(data, bounds, at, who, low_bits(hashes[hit]), least, window, wide)
            part = keys[np.searchsorted(at, place + bounds[w])] >> U64(32)
            found.append((rows, ids[lo:hi][w], tags[lo:hi][w], place, extent, after, before, part.astype(np.int64)))
        if not found:
            return kind_table([], [])
        rows, names, tag, at, extent, after, before, part = (np.concatenate(c) for c in zip(*found))
        found.clear()
        o = np.lexsort((names, np.ascontiguousarray(rows).view(f"S{width}").ravel(), part))
        rows, names, tag, at, extent, after, before, part = (c[o] for c in (rows, names, tag, at, extent, after, before, part))
        new = np.ones(len(rows), bool)
        new[1:] = (common(rows)[1:] < width) | (part[1:] != part[:-1]) | (after[1:] != after[:-1]) | (before[1:] != before[:-1])
        first = np.flatnonzero(new)
        later = names > np.repeat(np.minimum.reduceat(names, first), np.diff(np.append(first, len(names))))
        whole = later & (after.astype(np.int64) + before >= window)
        own = mark_rows(names[whole], tag[whole], (at - before)[whole], (at + extent + after)[whole], m)
        rows, names, tag, at, extent, after, before, part = (c[~later] for c in (rows, names, tag, at, extent, after, before, part))
        cuts = np.append(runs(part), len(part))
        coded = [front_coded(*(c[a:b] for c in (rows, names, tag.view(np.uint32), at, extent, after, before)), blank=blanks(after[a:b], before[a:b], window, wide)) for a, b in zip(cuts, cuts[1:])]
        return kind_table(list(zip(part[cuts[:-1]].tolist(), coded)), own)

    def merge(t: pa.Table) -> pa.Table:
        sent, passing = split_kinds(t)
        found = [decoded(b.as_buffer().to_pybytes(), width, lambda c: blanks(c[4], c[5], window, wide)) for b in sent]
        marks: list[tuple[int, bytes]] = []
        if found:
            of, row, lcp = merged([(r, p) for r, p, _ in found], width)
            start = np.concatenate(([0], np.cumsum([len(r) for r, _, _ in found])))
            place = start[np.array(of)] + np.array(row)
            names, tag, at, extent, after, before = (np.concatenate([c[i] for _, _, c in found])[place] for i in range(6))
            rows = np.frombuffer(b"".join([found[f][0][r] for f, r in zip(of, row)]), np.uint8).reshape(-1, width)
            hit, nearest, furthest = repeated(rows, np.array(lcp, np.uint8), names, after, before, window, span)
            marks = mark_rows(names[hit], tag[hit].astype(np.uint32).view(np.int32), at[hit] - furthest, (at + extent)[hit] - nearest + window, m)
        return pa.concat_tables([blob_table(marks), passing.cast(blob_table([]).schema)])

    marks = stored_lean(with_blobs(source, hits, m, sort, KINDS).groupBy("part").applyInArrow(lean(merge), BLOBS), "marks")

    def rewrite(t: pa.Table, marks: Marks) -> pa.Table:
        ids, tags = t.column("doc_id").fill_null(0).to_numpy(), t.column("tag").to_numpy()
        size, gone, number, spans, kept = [], [], [], [], []
        for lo, hi, data, bounds in chunks(t.column("text")):
            cut = marks.covered(ids[lo:hi], tags[lo:hi], bounds, len(data))
            begins, ends = cut.copy(), cut.copy()
            begins[1:] &= ~cut[:-1]
            ends[:-1] &= ~cut[1:]
            edges = bounds[1:-1]
            edges = edges[(edges > 0) & (edges < len(data))]
            begins[edges], ends[edges - 1] = cut[edges], cut[edges - 1]
            begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
            each = np.searchsorted(begins, bounds)
            who = np.repeat(np.arange(hi - lo), np.diff(each))
            pairs = list(zip((begins - bounds[who]).tolist(), (ends - bounds[who]).tolist()))
            spans += [pairs[a:b] for a, b in zip(each.tolist(), each[1:].tolist())]
            stay = np.concatenate(([0], np.cumsum(~cut)))[bounds]
            text = data[~cut].tobytes()
            kept += [text[a:b] for a, b in zip(stay.tolist(), stay[1:].tolist())]
            size.append(np.diff(bounds))
            gone.append(np.diff(bounds) - np.diff(stay))
            number.append(np.diff(each))
        join = lambda c: pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table([t.column("doc_id"), join(size), join(gone), join(number), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return cut_out(source, marks, m, rewrite, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:bigint,end:bigint>>, kept binary")
