"""Language identification by prediction by partial matching.

Each language has a variable-order byte context tree (orders 4 to 0, escapes by method C, and all
bytes alike below) whose statistics are frozen after training, so a text's exact code length
under a language is a sum over its bytes, found in tables. The shortest code wins.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytescan import HashSlots, chunks, lean_task, mix, release

#: Documents of each language that the trees are fitted on, as expected: those whose hash is below a threshold.
FIT_DOCUMENTS = 400
#: Bytes of text of each language that the trees are fitted on, at most; a single document may be longer.
FIT_BYTES = 4 << 20
#: A thousandth of a bit is the unit of code lengths.
UNIT = 1000
#: Bytes of the longest context.
ORDER = 4
#: Bytes of text that are scored at a time.
CHUNK = 1 << 18


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def grams(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Each byte behind the ORDER bytes before it in its document, 8 bits each; before the start there are zeros."""
    out = data.astype(np.uint64)
    for k in range(1, ORDER + 1):
        back = np.zeros(len(data), np.uint64)
        back[k:] = data[: max(0, len(data) - k)]
        for j in range(k):
            at = bounds[:-1] + j
            back[at[at < np.minimum(bounds[1:], len(data))]] = 0
        out |= back << np.uint64(8 * k)
    return out


def _bits(parts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(whole, 1) / np.maximum(parts, 1))


class Trees:
    """Frozen statistics of all languages as tables of code lengths, one for each order.

    ``slots[o]`` finds a gram of o + 1 bytes that some language has seen (or the context at the
    start of a text), ``code[o]`` has what its last byte costs each language after the others,
    escapes included, and ``escape[o]`` what it costs to leave a context of o bytes, which is a
    gram of the order below.
    """

    def __init__(self, languages: list[str], found: np.ndarray, counts: np.ndarray):
        """found: grams of ORDER + 1 bytes; counts: languages x grams."""
        self.languages, self.slots, self.code, self.escape = languages, [], [], []
        keys, shorter = np.zeros(0, np.uint64), np.full((0, len(languages)), 8.0)
        for o in range(ORDER + 1):
            below, keys = keys, np.unique(np.append(found & np.uint64((1 << 8 * (o + 1)) - 1), np.uint64(0)))
            at = np.searchsorted(keys, found & np.uint64((1 << 8 * (o + 1)) - 1))
            count = np.stack([np.bincount(at, c, len(keys)) for c in counts], 1) if len(counts) else np.zeros((len(keys), 0))
            contexts, of = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = (np.stack([np.bincount(of, w, len(contexts)) for w in v.T], 1) if len(counts) else np.zeros((len(contexts), 0)) for v in (count, count > 0))
            leave = np.where(total > 0, _bits(kinds, total + kinds), 0.0)
            suffix = np.searchsorted(below, keys & np.uint64((1 << 8 * o) - 1)) if o else None
            less = shorter[suffix] if o else np.full(count.shape, 8.0)
            shorter = np.where(count > 0, _bits(count, (total + kinds)[of]), leave[of] + less)
            escape = np.zeros((max(1, len(below)), len(languages)))
            escape[np.searchsorted(below, contexts) if o else [0]] = leave
            slots = HashSlots(max(4, (2 * len(keys)).bit_length()))
            slots.put(mix(keys), np.arange(len(keys), dtype=np.int32))
            self.slots.append(slots)
            self.code.append(np.round(shorter * UNIT).astype(np.uint32))
            self.escape.append(np.round(escape * UNIT).astype(np.uint32))

    def lengths(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Code length of each document under each language, in UNITs of a bit."""
        out = np.zeros((len(bounds) - 1, len(self.languages)), np.int64)
        if not len(data):
            return out
        g = grams(data, bounds)
        costs, left = np.zeros((len(g), len(self.languages)), np.uint32), np.arange(len(g))
        for o in range(ORDER, -1, -1):
            rank = self.slots[o].get(mix(g & np.uint64((1 << 8 * (o + 1)) - 1)))
            seen = rank >= 0
            costs[left[seen]] += self.code[o][rank[seen]]
            left, g = left[~seen], g[~seen]
            if not o:
                costs[left] += self.escape[0][0] + np.uint32(8 * UNIT)
                break
            context = self.slots[o - 1].get(mix(g >> np.uint64(8) & np.uint64((1 << 8 * o) - 1)))
            seen = context >= 0
            costs[left[seen]] += self.escape[o][context[seen]]
        some = np.flatnonzero(np.diff(bounds))
        out[some] = np.add.reduceat(costs, bounds[some], axis=0, dtype=np.int64)
        return out


def fit(docs: DataFrame, per_language: int = FIT_DOCUMENTS, max_bytes: int = FIT_BYTES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Trees:
    """Trees of all languages, from documents with text and language that aren't held out.

    About ``per_language`` documents of each language are read, each whole: those whose hashed id
    is below a threshold. Of these, documents are taken by their hashes, long ones last, as far as
    a language's bytes go, and at least one. What comes to the driver has at most as many rows as
    they have bytes.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    share = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))  # a row for each language
    limit = (F.lit(float(per_language << 30)) / F.col("n")).cast("long")
    sample = docs.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < limit)
    size = F.octet_length("text")
    order = Window.partitionBy("lang").orderBy(8 * size > max_bytes, F.xxhash64("doc_id"), "text")
    sample = sample.withColumn("nth", F.row_number().over(order)).withColumn("bytes", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    sample = sample.where((F.col("bytes") <= max_bytes) | (F.col("nth") == 1)).select("lang", "text")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            for lang in sorted(set(names)):
                column = batch.filter(pa.array(names == lang)).column(1)
                for _, _, data, bounds in chunks(column):
                    if len(data):
                        found, n = np.unique(grams(data, bounds), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    got = sample.mapInArrow(lean_task(tally), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang = got["lang"].combine_chunks().dictionary_encode()
    languages = sorted(lang.dictionary.to_pylist())
    found, at = np.unique(got["gram"].to_numpy().astype(np.uint64), return_inverse=True)
    counts = np.zeros((len(languages), len(found)), np.int64)
    if languages:
        row = np.searchsorted(np.array(languages), np.array(lang.dictionary.to_pylist()))
        counts[row[lang.indices.to_numpy()], at] = got["n"].to_numpy()
    trees = Trees(languages, found, counts)
    del got, lang, at, found, counts
    gc.collect()  # trees of earlier calls are in cycles with the functions that used them
    release()
    return trees


def identify(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and bits_per_byte.

    Text alone decides. Null text, or text without a letter, is ``und`` with score 0; so is all
    text if no language was learned. score is the share of the best language among all, when
    each counts 2 to the minus code length over the root of the text's length; ties go to the
    first name. Texts of any length are read whole. Columns lang_pred, score and bits_per_byte
    of docs are replaced; all others stay, whatever their names, and are never looked at. Null
    ids and repeated rows need nothing special; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(trees)

    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])

    def chunk(trees: Trees, texts: pa.Array, data: np.ndarray, bounds: np.ndarray) -> tuple:
        size = np.diff(bounds)
        letters = np.concatenate(([0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122))))[bounds]
        known = np.diff(letters) > 0
        for i in np.flatnonzero(~known & (size > 0)).tolist():
            known[i] = any(map(str.isalpha, texts[i].as_py()))
        known &= bool(trees.languages)
        lengths = trees.lengths(data, bounds) / UNIT if trees.languages else np.zeros((len(size), 1))
        least = lengths.min(1)
        odds = np.exp2(-(lengths - least[:, None]) / np.sqrt(np.maximum(size, 1))[:, None]).sum(1)
        names = [trees.languages[b] if k else "und" for b, k in zip(lengths.argmin(1).tolist(), known.tolist())]
        return names, np.where(known, 1 / odds, 0.0), least / np.maximum(size, 1)

    @F.arrow_udf("lang_pred string, score double, bits_per_byte double")
    def predict(text: pa.Array) -> pa.Array:
        names, scores, bits = [], [np.zeros(0)], [np.zeros(0)]
        for lo, hi, data, bounds in chunks(text, CHUNK):
            n, s, b = chunk(shared.value, text.slice(lo, hi - lo), data, bounds)
            names += n
            scores.append(s)
            bits.append(b)
        out = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(bits))], fields=list(kind))
        release()
        return out

    # Or Spark would predict once more for each filter on what was predicted, in a Python worker of its own.
    predict = predict.asNondeterministic()
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "bits_per_byte")]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), predict(F.col(text_col)).alias("found"))
    return rows.select("row.*", "found.*")
