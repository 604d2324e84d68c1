"""Packing of tokenised documents into windows by best-fit decreasing.

Overlong documents are cut into full windows first; what is left of them and all shorter ones go,
longest first, each into the tightest open window, which a segment tree over remaining capacity
finds. ``pack_documents`` packs the rows of each input partition in their order, block by block.
``pack_table`` heeds no order: pieces shorter than a window, a few numbers each, are dealt out anew,
so that a task packs thousands of them however the table lies in files.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import measured
from .bytescan import SEPARATOR, HashSlots, chunks, lean_task, ragged, word_hashes, words
from .exchange import partitions

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"
#: Pieces that a task packs together; more begin a new block, so a task's memory is bounded.
BLOCK_PIECES = 400_000
#: Bytes of text that are tokenised at a time: what a task holds besides its memo grows with it.
CHUNK = 1 << 19
#: Distinct words whose ids are remembered before all are forgotten: 50 bytes each.
MEMO_WORDS = 1_000_000


class WindowTree:
    """Open windows by remaining capacity; a segment tree of counts finds the tightest that fits."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, w: int) -> None:
        self.open[capacity].append(w)
        i = capacity + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, window) of the least capacity that is at least need."""
        count, i = self.count, need + self.leaves
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i <<= 1
                if not count[i]:
                    i += 1
        capacity = i - self.leaves
        while i:
            count[i] -= 1
            i >>= 1
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(window, offset) of each length; longest first, ties in the order given."""
    tree, place, opened = WindowTree(window), [(0, 0)] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[i]
        got = tree.take(need)
        if got is None:
            got, opened = (window, opened), opened + 1
        capacity, w = got
        place[i] = (w, window - capacity)
        if capacity > need:
            tree.put(capacity - need, w)
    return place


_BYTES = np.arange(256)
_ALPHA = ((_BYTES | 32) >= 97) & ((_BYTES | 32) <= 122)
_ALNUM = _ALPHA | ((_BYTES >= 48) & (_BYTES <= 57))
_MARK = (_BYTES > 32) & (_BYTES < 127) & ~_ALNUM & (_BYTES != 39)
_LATIN = (_BYTES >= 0x80) & (_BYTES <= 0xBF) & (_BYTES != 0x97) & (_BYTES != 0xB7)


def occurrences(raw: bytes, bounds: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the places where one of ``texts`` stands inside one document."""
    found = []
    for t in texts:
        at = raw.find(t)
        while at >= 0:
            found.append((at, at + len(t)))
            at = raw.find(t, at + len(t))
    starts, ends = np.array(sorted(found), np.int64).reshape(-1, 2).T
    inside = np.searchsorted(bounds, starts, "right") == np.searchsorted(bounds, ends, "left")
    return starts[inside], ends[inside]


def spans(data: np.ndarray, bounds: np.ndarray, special: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, cut between letters or digits and ASCII marks other than the apostrophe, where no pre-token spans; a special token is a span of its own.

    Starts, ends, each document's first, and which are letters alone (ASCII and Latin-1): one pre-token each.
    """
    starts, ends, _ = words(data, bounds)
    second = np.zeros(len(data), bool)
    second[1:] = (data[:-1] == 0xC3) & _LATIN[data[1:]]
    latin = second.copy()
    latin[:-1] |= second[1:]
    letter, sign, mark = _ALPHA[data] | latin, _ALNUM[data] | latin, _MARK[data]
    cut = np.zeros(len(data), bool)
    cut[1:] = (sign[:-1] & mark[1:]) | (mark[:-1] & sign[1:])
    for a, b in zip(*(x.tolist() for x in occurrences(data.tobytes(), bounds, special))):
        cut[a + 1 : b] = False
        for edge in (a, b):
            cut[edge : edge + 1] = 0 < edge < len(data) and not SEPARATOR[data[edge - 1 : edge + 1]].any()
    first, last = cut.copy(), cut
    first[starts] = True
    starts = np.flatnonzero(first)
    more = np.zeros(len(data) + 1, bool)
    more[:-1] = last
    more[ends] = True
    ends = np.flatnonzero(more[1:]) + 1
    letters = np.concatenate(([0], np.cumsum(letter)))
    return starts, ends, np.searchsorted(starts, bounds), letters[ends] - letters[starts] == ends - starts


def roomy(a: np.ndarray, need: int) -> np.ndarray:
    """a, or a copy of twice the size or more if it has fewer than ``need`` places."""
    if len(a) >= need:
        return a
    out = np.zeros(max(need, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


class WordTokenizer:
    """Ids of whole chunks of text. The tokenizer drops white space and lower-cases, so words are tokenised apart, each distinct one once. Special tokens in a text are what the tokenizer makes of them."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end_id = end_id
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.closes[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.slots = HashSlots()
        #: Ids of all remembered words, end to end, and where each word's begin and how many they are; the arrays have room to grow.
        self.flat, self.n_flat = np.array([self.end_id], np.uint32), 1
        self.at, self.size, self.n_words = np.zeros(1, np.uint32), np.ones(1, np.uint32), 1

    def remember(self, hashes: np.ndarray, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Slots of new words."""
        slots = self.n_words + np.arange(len(size))
        self.slots.put(hashes, slots)
        self.flat, self.at, self.size = roomy(self.flat, self.n_flat + len(flat)), roomy(self.at, self.n_words + len(size)), roomy(self.size, self.n_words + len(size))
        self.flat[self.n_flat : self.n_flat + len(flat)] = flat
        self.at[slots], self.size[slots] = self.n_flat + np.cumsum(size) - size, size
        self.n_flat, self.n_words = self.n_flat + len(flat), self.n_words + len(size)
        return slots

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and how many each has."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((i for g in got for i in g), np.uint32, int(size.sum())), size

    def encode_letters(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters alone: a thousand are one call, as each ends with a closing piece."""
        got = [self.tokenizer.encode(" ".join(texts[i : i + 1000]), add_special_tokens=False).ids for i in range(0, len(texts), 1000)]
        flat = np.array([i for g in got for i in g], np.uint32)
        ends = np.flatnonzero(self.closes[flat]) + 1
        if len(ends) != len(texts):
            return self.encode(texts)
        return flat, np.diff(ends, prepend=0)

    def ids(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, each closed by the end id, and their bounds."""
        if self.n_words > MEMO_WORDS:
            self.forget()
        starts, ends, first, plain = spans(data, bounds, self.special)
        distinct, where, back = np.unique(word_hashes(data, starts, ends, lower=True), return_index=True, return_inverse=True)
        slots = self.slots.get(distinct)
        raw, unknown = data.tobytes(), slots < 0
        for encode, new in ((self.encode_letters, np.flatnonzero(unknown & plain[where])), (self.encode, np.flatnonzero(unknown & ~plain[where]))):
            if not len(new):
                continue
            flat, size = encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist())])
            slots[new] = self.remember(distinct[new], flat, size)
        each = np.insert(slots[back.ravel()], first[1:], 0)
        sizes = self.size[each].astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return self.flat[ragged(self.at[each].astype(np.int64), sizes)], ends[first + np.arange(len(first))]


_known: dict[tuple[str, int], WordTokenizer] = {}


def tokenizer(path: str, end_id: int, keep: bool) -> WordTokenizer:
    """One for each Python worker, which outlives a task, or else a new one."""
    if not keep:
        return WordTokenizer(path, end_id)
    if (path, end_id) not in _known:
        _known[path, end_id] = WordTokenizer(path, end_id)
    return _known[path, end_id]


def _rows(found: list[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(found), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found[i : i + 50_000])], names=[c.split()[0] for c in schema.split(", ")])


def pieces(batches: Iterator[pa.RecordBatch], tokens: WordTokenizer, window: int) -> Iterator[tuple | None]:
    """(doc_id, start, length, crc of ids, tokens of the document) of all pieces of a window at most, and None after each document."""
    for batch in batches:
        names = batch.column(0).to_pylist()
        for lo, hi, data, bounds in chunks(batch.column(1), CHUNK):
            ids, cut = tokens.ids(data, bounds)
            raw, cut = memoryview(ids.astype("<u4")).cast("B"), cut.tolist()
            for i in range(hi - lo):
                total = cut[i + 1] - cut[i]
                for start in range(0, total, window):
                    length = min(window, total - start)
                    at = 4 * (cut[i] + start)
                    yield names[lo + i], start, length, zlib.crc32(raw[at : at + 4 * length]), total
                yield None


def placed(rest: list[tuple], window: int, sequence: int) -> tuple[list[tuple], int]:
    """Pieces with their sequence, place and the sequence's tokens, and how many sequences there are, numbered on from one."""
    place = best_fit_decreasing([p[2] for p in rest], window)
    fill: dict[int, int] = {}
    for p, (w, _) in zip(rest, place):
        fill[w] = fill.get(w, 0) + p[2]
    return [(*p, sequence + w, at, fill[w]) for p, (w, at) in zip(rest, place)], len(fill)


_CUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, piece long"
#: Pieces that a task packs at least, where the table has as many: the last window of each task is what stays open.
LEAST_PIECES = 4096


def pack_table(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``pack_documents``, packed without regard to order: how the table lies in partitions makes no gaps.

    Texts are tokenised where they are, and their pieces are stored. Pieces shorter than a window
    are dealt out by their numbers over so many tasks that each has LEAST_PIECES to BLOCK_PIECES of
    them (all of them in one if there are fewer). Odd tables as there.
    """
    spark = docs.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, found = TaskContext.get().partitionId() << 36, []
        for piece in pieces(batches, tokenizer(tokenizer_path, end_id, True), window):
            if piece is not None:
                found.append((*piece, number))
                number += 1
            elif len(found) >= 50_000:
                yield from _rows(found, _CUT)
                found.clear()
        yield from _rows(found, _CUT)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, rest = TaskContext.get().partitionId() << 36, []
        for batch in batches:
            rest.extend(zip(*(c.to_pylist() for c in batch.columns)))
            if len(rest) >= 2 * BLOCK_PIECES:  # not reached where pieces are dealt out evenly
                found, opened = placed(sorted(rest, key=lambda p: p[5]), window, sequence)
                yield from _rows([(*p[:5], 2 * p[6] + 1, *p[7:]) for p in found], PIECES)
                sequence += opened
                rest.clear()
        found, _ = placed(sorted(rest, key=lambda p: p[5]), window, sequence)
        yield from _rows([(*p[:5], 2 * p[6] + 1, *p[7:]) for p in found], PIECES)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    all_pieces, seen = measured(texts.mapInArrow(lean_task(cut), _CUT), "pieces", short=F.count_if(F.col("length") < window))
    short = seen["short"] or 0
    tasks = min(max(1, short // LEAST_PIECES), max(partitions(spark), -(-short // BLOCK_PIECES)))
    full = all_pieces.where(F.col("length") == window).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("piece") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.col("length").alias("sequence_tokens"))
    dealt = all_pieces.where(F.col("length") < window).repartition(tasks, "piece")
    return full.unionByName(dealt.mapInArrow(lean_task(pack), PIECES))


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", block_pieces: int = BLOCK_PIECES, keep_tokenizer: bool = True) -> DataFrame:
    """A row for each piece of a document: where its ids lie in the document and in a sequence.

    Null text is empty: the document is the end id alone. Each row of a repeated document is
    packed for itself; a null id stays null. No rows give no sequences. Texts of any length are
    tokenised whole. Other columns are ignored. sequence_id holds the task's partition in its
    high bits, so a task that runs again gives the same numbers. A task packs its pieces in
    blocks of block_pieces, in the order of its rows: within a block longest first (ties in that
    order), and no window stays open beyond its block, which bounds a task's memory and costs one
    window a block at most where there are short pieces. Sequences are numbered in the order of
    the blocks. keep_tokenizer: Python workers keep the tokenizer and the ids of MEMO_WORDS words
    between tasks, which saves time and takes memory.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 36
        full: list[tuple] = []
        rest: list[tuple] = []

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            found, opened = placed(rest, window, sequence)
            yield from _rows(found, PIECES)
            sequence += opened
            rest.clear()

        for piece in pieces(batches, tokenizer(tokenizer_path, end_id, keep_tokenizer), window):
            if piece is None:  # a document ends
                if len(rest) >= block_pieces:
                    yield from packed()
            elif piece[2] == window:
                full.append((*piece, sequence, 0, window))
                sequence += 1
                if len(full) >= 50_000:
                    yield from _rows(full, PIECES)
                    full.clear()
            else:
                rest.append(piece)
        yield from _rows(full, PIECES)
        yield from packed()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean_task(task), PIECES)
