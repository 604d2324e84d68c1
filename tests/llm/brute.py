"""Plain versions of the operators, for small inputs."""

import hashlib
import re
import struct
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def substring_rows(docs, n=50):
    """A result for each row; ids may repeat."""
    words, first = [(i, WORD.findall(t or "")) for i, t in docs], {}
    for i, w in words:
        for j in range(len(w) - n + 1):
            k = tuple(w[j : j + n])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for j in range(len(w) - n + 1):
            if first[tuple(w[j : j + n])] < i:
                gone[j : j + n] = [True] * n
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def substring_dedup(docs, n=50):
    return {r[0]: r[1:] for r in substring_rows(docs, n)}


def suffix_rows(docs, n=50):
    raw, first = [(i, (t or "").encode()) for i, t in docs], {}
    for i, b in raw:
        for j in range(len(b) - n + 1):
            first[b[j : j + n]] = min(first.get(b[j : j + n], i), i)
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for j in range(len(b) - n + 1):
            if first[b[j : j + n]] < i:
                gone[j : j + n] = b"\1" * n
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(b, gone) if not g)))
    return out


def suffix_dedup(docs, n=50):
    return {r[0]: r[1:] for r in suffix_rows(docs, n)}


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


def jaccard(docs):
    sets, lists, parent = {i: shingles(t) for i, t in docs}, defaultdict(list), {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        met = Counter(j for x in s for j in lists[x])
        for j, n in met.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for x in s:
            lists[x].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def _signed64(x):
    return x - 2**64 if x >= 2**63 else x


def _chained(h, k):
    """xxhash64 of a long and then an int."""
    seed = xxhash.xxh64(struct.pack("<q", h), seed=42).intdigest()
    return xxhash.xxh64(struct.pack("<i", k), seed=seed).intdigest()


def fingerprint(text):
    """124 signed lanes modulo 2**32 and 4 dense ones modulo 2**48."""
    lanes, dense = [0] * 124, [0] * 4
    for p in re.split(r"\n+|(?<=[.!?])[ \t\n\x0b\f\r]+", text or ""):
        if p:
            h = _signed64(xxhash.xxh64(p.encode(), seed=42).intdigest())
            bits = [_chained(h, 100), _chained(h, 101)]
            for j in range(124):
                lanes[j] += 1 if bits[j // 62] >> j % 62 & 1 else -1
            for k in range(4):
                dense[k] += _chained(h, k) & (2**48 - 1)
    return [x % 2**32 for x in lanes] + [x % 2**48 for x in dense]


def fingerprint_text(v):
    return "".join(f"{x:08x}" for x in v[:124]) + "".join(f"{x:012x}" for x in v[124:])


def likeness(a, b):
    if a == b:
        return 1.0
    whole = lambda x: (x + 2**31) % 2**32 - 2**31
    square = lambda v: sum(whole(x) ** 2 for x in v[:124])
    near = 1 - square([x - y for x, y in zip(a, b)]) / max(1, square(a) + square(b))
    return max(0.0, min(near, 1 - 1 / 1024))
