"""Substring dedup by fixed-block anchors.

Every document's non-overlapping blocks of 25 words are the references; every rolling window of 25
words probes them. A repeat of 50 words holds a whole block of whichever document has it, so a
hit lies inside each. Hits are extended to all windows of 50 words around them, which meet by
their hashes; runs of windows that a smaller document also has are the maximal exact repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import U64, chunks, lean, mix, powers, prefix_sums, ragged, rolling, word_hashes, words
from .exchange import BLOBS, buckets, deal, gather, partitions, stored_lean, with_maybe
from .repeats import KINDS, Marks, Members, blob_table, cut_out, keyed, kind_table, mark_rows, moved_rows, named, shared_anchors, split_kinds, tagged, with_blobs

WINDOW = 50


def _windows(data: np.ndarray, bounds: np.ndarray, window: int, size: int) -> tuple:
    """Word hashes, documents' first words, and the word and document of each run of ``size`` words, in documents of ``window`` words or more."""
    starts, ends, first = words(data, bounds)
    hashes = word_hashes(data, starts, ends)
    count = np.diff(first)
    each = np.where(count >= window, count - size + 1, 0)
    return hashes, first, ragged(first[:-1], each), np.repeat(np.arange(len(count)), each)


def repeat_marks(source: DataFrame, window: int = WINDOW) -> DataFrame:
    """(part, blob): marks of the runs of ``window`` words of each row (doc_id, text, tag) that also start in a document with a smaller id."""
    n, m, block = partitions(source.sparkSession), buckets(source.sparkSession), window // 2

    def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple:
        hashes, first, at, who = _windows(data, bounds, window, block)
        return rolling(hashes, block)[at], who, (at - first[who]) % block == 0

    hits = stored_lean(shared_anchors(source, anchors, n, m), "anchors")

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        member, found = Members(right.column("blob")), []
        ids, tags = left.column("doc_id").to_numpy(), left.column("tag").to_numpy()
        for lo, hi, data, bounds in chunks(left.column("text")):
            hashes, first, at, who = _windows(data, bounds, window, block)
            names = ids[lo:hi]
            hit = np.zeros(len(hashes) + 1, np.int64)
            hit[at[member(names[who], keyed(rolling(hashes, block)[at], n))] + 1] = 1
            hit = np.cumsum(hit)
            count = np.diff(first)
            each = np.maximum(count - window + 1, 0)
            s, who = ragged(first[:-1], each), np.repeat(np.arange(len(count)), each)
            near = hit[s + window - block + 1] > hit[s]
            s, who = s[near], who[near]
            if not len(s):
                continue
            back = powers(len(hashes) + 1)[1][s]
            one, two = prefix_sums(hashes), prefix_sums(mix(hashes ^ U64(0x5851F42D4C957F2D)))
            found.append((mix((one[s + window] - one[s]) * back), mix((two[s + window] - two[s]) * back).astype(np.uint32), names[who], tags[lo:hi][who], (s - first[who]).astype(np.uint32)))
        if not found:
            return kind_table([], [])
        h, h2, names, tag, at = (np.concatenate(c) for c in zip(*found))
        found.clear()
        o = np.argsort(h)
        h, h2, names, tag, at = h[o], h2[o], names[o], tag[o], at[o]
        later = names > _least(h, h2, names)
        sent = ~later
        parts = ((h[sent] >> U64(40)) % U64(n)).astype(np.int64)
        return kind_table(deal(parts, names[sent], h[sent], h2[sent], tag[sent], at[sent]), mark_rows(names[later], tag[later], at[later], at[later] + window, m))

    def meet(t: pa.Table) -> pa.Table:
        sent, passing = split_kinds(t)
        names, h, h2, tag, at = gather(sent, (np.int64, np.uint64, np.uint32, np.int32, np.uint32))
        o = np.argsort(h)
        h, h2, names, tag, at = h[o], h2[o], names[o], tag[o], at[o]
        later = names > _least(h, h2, names)
        return pa.concat_tables([blob_table(mark_rows(names[later], tag[later], at[later], at[later] + window, m)), passing.cast(blob_table([]).schema)])

    return stored_lean(with_blobs(source, hits, m, extend, KINDS).groupBy("part").applyInArrow(lean(meet), BLOBS), "marks")


def _kept(texts: pa.ChunkedArray, ids: np.ndarray, tags: np.ndarray, marks: Marks, normalise: bool) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words, removed words and what is left of each text."""
    counts, gone, kept = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    for lo, hi, data, bounds in chunks(texts):
        starts, ends, first = words(data, bounds)
        stay = ~marks.covered(ids[lo:hi], tags[lo:hi], first, len(starts))
        left = np.concatenate(([0], np.cumsum(stay)))[first]
        size = ends[stay] - starts[stay] + 1
        text = np.append(data, np.uint8(32))[ragged(starts[stay], size)]
        text[np.cumsum(size) - 1] = 32
        text, cut = text.tobytes(), np.concatenate(([0], np.cumsum(size)))[left].tolist()
        found = [text[a : max(a, b - 1)] for a, b in zip(cut, cut[1:])]
        counts.append(np.diff(first))
        gone.append(np.diff(first) - np.diff(left))
        if not normalise:
            for i in np.flatnonzero(gone[-1] == 0).tolist():
                found[i] = data[bounds[i] : bounds[i + 1]].tobytes()
        kept += found
    return np.concatenate(counts), np.concatenate(gone), kept


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): every word is removed that lies in a run of ``window`` words which also starts in a document with a smaller id.

    Runs are judged on the input. kept_text joins the words that stay by one space; without any
    it is empty. Null text has no words. Other columns are ignored, so names can't clash. Rows
    that repeat an id remove nothing from each other; each is judged by its own text. A row with
    a null id stays whole and removes nothing. No rows give none. Runs are compared by 96-bit
    hashes. A task holds a bucket of texts at a time; a text, however long, is handled whole.
    """
    source = tagged(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    marks = repeat_marks(source, window)

    def rewrite(t: pa.Table, marks: Marks) -> pa.Table:
        counts, gone, kept = _kept(t.column("text"), t.column("doc_id").fill_null(0).to_numpy(), t.column("tag").to_numpy(), marks, True)
        return pa.table([t.column("doc_id"), pa.array(counts), pa.array(gone), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    out = cut_out(source, marks, buckets(docs.sparkSession), rewrite, "doc_id long, n_words long, n_removed long, kept binary")
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("kept_text"))


def cut_documents(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the same repeats cut out of the texts. A text that loses nothing stays as it was, null too; all other columns come along, whatever their names.

    Documents that no mark can name don't reach Python, nor do they move.
    """
    rest = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"))
    whole = tagged(rows)
    marks = repeat_marks(whole.select("doc_id", "text", "tag"), window)
    seen = with_maybe(whole, named(marks))

    def rewrite(t: pa.Table, marks: Marks) -> pa.Table:
        _, _, kept = _kept(t.column("text"), t.column("doc_id").to_numpy(), t.column("tag").to_numpy(), marks, False)
        kept = pa.array([k if v else None for k, v in zip(kept, t.column("text").is_valid().to_pylist())], pa.binary())
        return pa.table([t.column("row"), kept], names=["row", "kept"])

    moved = moved_rows(seen, marks, buckets(docs.sparkSession), rewrite, f"row {whole.schema['row'].dataType.simpleString()}, kept binary")
    out = moved.select("row", F.col("kept").cast("string").alias("kept")).unionByName(seen.where("not __maybe or doc_id is null").select("row", F.col("text").alias("kept")))
    return out.select(*(F.col("kept").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns))


def _least(h: np.ndarray, h2: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The smallest document of each entry's window; entries are sorted by h."""
    if not len(h):
        return names
    first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (h2[1:] != h2[:-1]))))
    return np.repeat(np.minimum.reduceat(names, first), np.diff(np.append(first, len(h))))
