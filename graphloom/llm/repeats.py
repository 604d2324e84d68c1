"""What the two searches for repeated spans share.

A search has three passes over the texts. In the first, anchors (hashes of short spans) meet by
value; a document learns which of its anchors another document holds too. In the second, only
documents with such anchors send the spans around them, which are compared whole, and each span
that also starts in a document with a smaller id comes back as a mark (document, start, end). In
the third, the marks are cut out. A task sends each value once, for the smallest document that
holds it, and marks the others itself; so a passage that a third of all documents hold costs one
entry a task.

Rows that share an id but not their text are told apart by a tag, a hash of the text, which is 0
for all ids that occur once: marks belong to one text alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import U64, chunks, lean_pair, lean_task, mix, ragged, runs
from .exchange import BLOBS, blob_filter, deal, doc_bucket, doc_bucket_column, gather, id_filter, stored, table, with_maybe

KINDS = "part int, kind int, blob binary"
SENT, OWN = 0, 1
#: Anchors that a task merges before it sends them.
FLUSH = 200_000


def tagged(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text and others) with tag: 32 bits of the text's hash for ids that occur more than once, otherwise 0."""
    again = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    seen = with_maybe(rows, stored(id_filter(again), "repeated-ids"))
    return seen.withColumn("tag", F.when(F.col("__maybe"), F.hash("text")).otherwise(0)).drop("__maybe")


def keyed(hashes: np.ndarray, n: int) -> np.ndarray:
    """Bucket in the high 32 bits, 32 bits of the hash in the low ones."""
    return ((hashes >> U64(40)) % U64(n)) << U64(32) | (hashes & U64(0xFFFFFFFF))


def kind_batch(kind: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([kind] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "kind", "blob"])


def blob_table(rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.Table.from_batches([table(rows)])


def kind_table(sent: list[tuple[int, bytes]], own: list[tuple[int, bytes]]) -> pa.Table:
    return pa.Table.from_batches([kind_batch(SENT, sent), kind_batch(OWN, own)])


def split_kinds(t: pa.Table) -> tuple[pa.ChunkedArray, pa.Table]:
    """Blobs that were sent to this bucket, and the rows that only pass through it."""
    kind = t.column("kind").to_numpy()
    return t.filter(pa.array(kind == SENT)).column("blob"), t.filter(pa.array(kind == OWN)).select(["part", "blob"])


def _pairs(docs: np.ndarray, keys: np.ndarray, m: int) -> list[tuple[int, bytes]]:
    """(document, anchor) pairs, each once, by the document's bucket."""
    if not len(docs):
        return []
    o = np.lexsort((keys, docs))
    docs, keys = docs[o], keys[o]
    new = np.concatenate(([True], (docs[1:] != docs[:-1]) | (keys[1:] != keys[:-1])))
    docs, keys = docs[new], keys[new]
    return deal(doc_bucket(docs, m), docs, (keys >> U64(32)).astype(np.uint32), keys.astype(np.uint32))


def shared_anchors(docs: DataFrame, anchors: Callable, n: int, m: int, flush: int = FLUSH) -> DataFrame:
    """(part, blob) of (document, anchor's bucket, anchor) where another document has the anchor too.

    n: buckets of anchors, one for each shuffle partition; m: buckets of documents, of which there
    are more, as they hold texts. Rows from one kind to the other are n * m at most.
    anchors: (data, bounds) -> hashes, documents' places in the chunk, flags; an anchor counts
    only if one of its holders has it flagged.
    """

    def sends(docs: np.ndarray, keys: np.ndarray, flags: np.ndarray) -> Iterator[pa.RecordBatch]:
        o = np.argsort(keys)
        docs, keys, flags = docs[o], keys[o], flags[o]
        first = runs(keys)
        least, most, flagged = np.minimum.reduceat(docs, first), np.maximum.reduceat(docs, first), np.logical_or.reduceat(flags, first)
        size = np.diff(np.append(first, len(keys)))
        group = np.repeat(np.arange(len(first)), size)
        settled = (least != most) & flagged
        mine = settled[group]
        own = _pairs(docs[mine], keys[mine], m)
        if own:
            yield kind_batch(OWN, own)
        # One entry for a settled group or a single document; several unflagged holders each need an answer.
        single = settled | (least == most)
        send = np.zeros(len(keys), bool)
        send[first[single]] = True
        open_ = ~single[group]
        open_[1:] &= ~((docs[1:] == docs[:-1]) & (keys[1:] == keys[:-1])) | ~open_[:-1]
        send |= open_
        g = group[send]
        notes = (flagged[g] + 2 * settled[g]).astype(np.uint8)
        parts = (keys[send] >> U64(32)).astype(np.int64)
        rows = deal(parts, docs[send], keys[send].astype(np.uint32), notes)
        for i in range(0, len(rows), 64):
            yield kind_batch(SENT, rows[i : i + 64])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, bounds in chunks(batch.column(1)):
                hashes, who, flags = anchors(data, bounds)
                held.append((ids[lo:hi][who], keyed(hashes, n), flags))
                count += len(who)
                if count >= flush:
                    yield from sends(*(np.concatenate(c) for c in zip(*held)))
                    held, count = [], 0
        if count:
            yield from sends(*(np.concatenate(c) for c in zip(*held)))

    def meet(key: tuple, t: pa.Table) -> pa.Table:
        sent, passing = split_kinds(t)
        docs, low, notes = gather(sent, (np.int64, np.uint32, np.uint8))
        rows: list[tuple[int, bytes]] = []
        if len(docs):
            o = np.argsort(low)
            docs, low, notes = docs[o], low[o], notes[o]
            first = runs(low)
            many = (np.minimum.reduceat(docs, first) != np.maximum.reduceat(docs, first)) | (np.bitwise_or.reduceat(notes, first) & 2 > 0)
            many &= np.bitwise_or.reduceat(notes, first) & 1 > 0
            answer = np.repeat(many, np.diff(np.append(first, len(low)))) & (notes & 2 == 0)
            rows = _pairs(docs[answer], low[answer].astype(U64) | U64(key[0].as_py()) << U64(32), m)
        return pa.concat_tables([blob_table(rows), passing.cast(blob_table([]).schema)])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(lean_task(task), KINDS).groupBy("part").applyInArrow(lean_pair(meet), BLOBS)


class Members:
    """Which (document, anchor) pairs a bucket's rows hold."""

    def __init__(self, blobs: pa.ChunkedArray):
        docs, part, low = gather(blobs, (np.int64, np.uint32, np.uint32))
        self.known = np.sort(self._key(docs, part.astype(U64) << U64(32) | low.astype(U64)))

    @staticmethod
    def _key(docs: np.ndarray, keys: np.ndarray) -> np.ndarray:
        return mix(docs.astype(U64)) + mix(keys)

    def __call__(self, docs: np.ndarray, keys: np.ndarray) -> np.ndarray:
        if not len(self.known) or not len(docs):
            return np.zeros(len(docs), bool)
        wanted = self._key(docs, keys)
        return self.known[np.minimum(np.searchsorted(self.known, wanted), len(self.known) - 1)] == wanted


def named(blobs: DataFrame) -> DataFrame:
    """The bitmap of the documents that stored blobs name, stored as well.

    Spark holds on to its last write, with the shuffle files behind it, until the next one. This one
    is small, so the files of the pass before are gone when texts move in the next pass.
    """
    return stored(blob_filter(blobs), "named")


def with_blobs(docs: DataFrame, blobs: DataFrame, m: int, function: Callable, schema: str) -> DataFrame:
    """function(documents, blobs) -> table, for each bucket of the documents that blobs may name."""
    left = with_maybe(docs.where("doc_id is not null"), named(blobs)).where("__maybe").drop("__maybe").withColumn("part", doc_bucket_column(F.col("doc_id"), m))
    return left.groupBy("part").cogroup(blobs.groupBy("part")).applyInArrow(lean_pair(function), schema)


def mark_rows(docs: np.ndarray, tags: np.ndarray, starts: np.ndarray, ends: np.ndarray, m: int) -> list[tuple[int, bytes]]:
    """Marks by the document's bucket; those of one text that touch are one."""
    if not len(docs):
        return []
    o = np.lexsort((starts, tags, docs))
    docs, tags, starts, ends = docs[o], tags[o].astype(np.int32), starts[o].astype(np.int64), ends[o].astype(np.int64)
    turn = np.concatenate(([True], (docs[1:] != docs[:-1]) | (tags[1:] != tags[:-1])))
    # The furthest end so far in the same text: ends plus an offset that grows with the text.
    offset = np.cumsum(turn) * (int(ends.max()) + 1)
    reach = np.maximum.accumulate(ends + offset)
    new = turn.copy()
    new[1:] |= starts[1:] + offset[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(docs)) - 1
    return deal(doc_bucket(docs[first], m), docs[first], tags[first], starts[first].astype(np.uint32), (reach[last] - offset[last]).astype(np.uint32))


class Marks:
    """Marks of a bucket; covered() tells which places of a chunk lie under one."""

    def __init__(self, blobs: pa.ChunkedArray | None = None):
        self.docs, self.tags, self.starts, self.ends = gather(blobs if blobs is not None else [], (np.int64, np.int32, np.uint32, np.uint32))
        o = np.argsort(self.docs, kind="stable")
        self.docs, self.tags, self.starts, self.ends = self.docs[o], self.tags[o], self.starts[o].astype(np.int64), self.ends[o].astype(np.int64)

    def covered(self, ids: np.ndarray, tags: np.ndarray, first: np.ndarray, total: int) -> np.ndarray:
        """ids, tags: of the chunk's rows; first: their bounds in it."""
        if not len(self.docs):
            return np.zeros(total, bool)
        lo, hi = np.searchsorted(self.docs, ids, "left"), np.searchsorted(self.docs, ids, "right")
        at, row = ragged(lo, hi - lo), np.repeat(np.arange(len(ids)), hi - lo)
        own = self.tags[at] == tags[row]
        at, base = at[own], first[:-1][row[own]]
        change = np.bincount(base + self.starts[at], minlength=total + 1).astype(np.int64) - np.bincount(base + self.ends[at], minlength=total + 1)
        return np.cumsum(change[:total]) > 0


def moved_rows(seen: DataFrame, marks: DataFrame, m: int, rewrite: Callable, schema: str) -> DataFrame:
    """rewrite(rows, Marks) -> table with the schema's columns, over the rows of ``seen`` (with __maybe) that marks may name."""

    def marked(left: pa.Table, right: pa.Table) -> pa.Table:
        return rewrite(left.drop_columns(["part"]), Marks(right.column("blob")))

    moved = seen.where("__maybe and doc_id is not null").drop("__maybe").withColumn("part", doc_bucket_column(F.col("doc_id"), m))
    return moved.groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(lean_pair(marked), schema)


def cut_out(docs: DataFrame, marks: DataFrame, m: int, rewrite: Callable, schema: str) -> DataFrame:
    """rewrite(rows, Marks) -> table with the schema's columns, over all rows; only documents that marks may name are moved."""
    seen = with_maybe(docs, named(marks))

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = Marks()
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                yield from rewrite(pa.Table.from_batches([batch.slice(i, 2000)]), none).to_batches()

    untouched = seen.where("not __maybe or doc_id is null").drop("__maybe").mapInArrow(lean_task(alone), schema)
    return untouched.unionByName(moved_rows(seen, marks, m, rewrite, schema))
