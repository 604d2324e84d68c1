"""Token counts under a unigram model by dynamic programming shared along a trie.

A task inserts its distinct pre-tokens in a trie of bytes. The forward pass (the best score of
any segmentation, and its number of pieces) depends on the prefix alone, so each node is scored
once, whatever number of pre-tokens run through it; terminal nodes keep the counts, and documents
add up those of their pre-tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import chunks, lean_task, word_hashes, words

#: Pre-tokens whose counts a worker remembers before it forgets them all.
MEMO = 1_000_000
SPACE = "▁".encode()


def piece_scores(path: str) -> dict[bytes, float]:
    """Scores of a vocabulary's pieces: minus the logarithm of their rank, as frequencies fall with rank. Any single byte is a piece as well, behind all others."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    scores = {bytes([b]): -math.log(n + 2) for b in range(256)}
    for i in range(n):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
            scores[sp.id_to_piece(i).encode()] = -math.log(i + 2)
    return scores


class ForwardTrie:
    """Pre-tokens in byte order are a walk through their trie: what is above the common prefix with the one before stays on the stack."""

    def __init__(self, scores: dict[bytes, float]):
        self.scores = scores
        by_last: dict[int, set[int]] = {}
        for p in scores:
            by_last.setdefault(p[-1], set()).add(len(p))
        #: Lengths of the pieces that end in each byte.
        self.lengths = [sorted(by_last.get(b, ())) for b in range(256)]
        self.nodes = 0

    def counts(self, tokens: list[bytes]) -> list[int]:
        """Pieces of the best segmentation of each of the sorted distinct tokens; the fewest of equal scores."""
        get, lengths, out = self.scores.get, self.lengths, []
        best: list[tuple[float, int]] = [(0.0, 0)]
        before = b""
        for token in tokens:
            n = min(len(before), len(token))
            shared = next((i for i in range(n) if before[i] != token[i]), n)
            del best[shared + 1 :]
            for end in range(shared + 1, len(token) + 1):
                top = None
                for size in lengths[token[end - 1]]:
                    if size > end:
                        break
                    score = get(token[end - size : end])
                    if score is not None:
                        s, c = best[end - size]
                        found = (s + score, c - 1)  # fewer pieces are greater
                        if top is None or found > top:
                            top = found
                best.append(top)
            self.nodes += len(token) - shared
            out.append(-best[-1][1])
            before = token
        return out


_tries: dict[str, tuple[ForwardTrie, dict[int, int]]] = {}


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_pretokens, n_tokens, most_tokens): tokens of each whole text, and of its longest pre-token in tokens.

    A pre-token is a word with a mark for the space before it. Null and blank texts have none.
    Repeated rows each give a row, null ids stay, no rows give none, other columns are ignored.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_path not in _tries:
            _tries[model_path] = ForwardTrie(piece_scores(model_path)), {}
        trie, known = _tries[model_path]
        for batch in batches:
            for lo, hi, data, bounds in chunks(batch.column(1), 1 << 21):
                if len(known) > MEMO:
                    known.clear()
                starts, ends, first = words(data, bounds)
                distinct, where, back = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
                counts = np.fromiter(map(known.get, distinct.tolist(), repeat(-1)), np.int64, len(distinct))
                new = np.flatnonzero(counts < 0)
                if len(new):
                    raw = data.tobytes()
                    texts = sorted((SPACE + raw[starts[i] : ends[i]], j) for i, j in zip(where[new].tolist(), new.tolist()))
                    order = np.array([j for _, j in texts])
                    counts[order] = trie.counts([t for t, _ in texts])
                    known.update(zip(distinct[new].tolist(), counts[new].tolist()))
                each = counts[back.ravel()]
                sums = np.concatenate(([0], np.cumsum(each)))[first]
                most = np.zeros(hi - lo, np.int64)
                some = np.flatnonzero(np.diff(first))
                if len(some):
                    most[some] = np.maximum.reduceat(each, first[some])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(bounds)), pa.array(np.diff(first)), pa.array(np.diff(sums)), pa.array(most)], names=["doc_id", "n_bytes", "n_pretokens", "n_tokens", "most_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean_task(task), "doc_id long, n_bytes long, n_pretokens long, n_tokens long, most_tokens long")
