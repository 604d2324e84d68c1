"""Exact dedup, conversation repair and fill-in-middle against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.llm import exact_dedup, fim, queries, repair

from .brute import sha


# --- op11 -------------------------------------------------------------------------------------
def plain_groups(docs):
    texts = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in docs]
    ids = defaultdict(list)
    for i, t in texts:
        ids[t].append(i)
    least = lambda xs: min((x is None, x or 0, x) for x in xs)[2]
    kept, out = set(), []
    for i, t in sorted(texts, key=lambda r: (r[0] is None, r[0] or 0)):
        out.append((i, least(ids[t]), len(ids[t]), t not in kept, sha(t)))
        kept.add(t)
    return sorted(out, key=repr)


def odd_docs():
    r = random.Random(11)
    pool = ["", None, " ", "\n\t", "a b", "a  b", "a\x0bb", "a b", "é", "é", "long " * 50_000, "long  " * 50_000, "A b"] + [f"text {i}" for i in range(40)]
    docs = [(i, r.choice(pool)) for i in range(400)] + [(None, "a b"), (None, "only null"), (None, "only null"), (5, "tie"), (5, "tie"), (5, "tie"), (9, "tie"), (-3, "text 1")]
    docs += [(10_000 + i, "hot  copy" if i % 2 else "hot copy") for i in range(3000)]
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize("hashed", ["md5", "weak", "one"])
def test_exact_groups(spark, hashed):
    """With a weak hash different texts fall into one group, and bytes decide."""
    hash_of = {"md5": exact_dedup.content_hash, "weak": lambda t: F.unhex(F.md5((F.length(t) % 7).cast("string"))), "one": lambda t: F.unhex(F.md5(F.lit("x")))}[hashed]
    docs = odd_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    got = exact_dedup.exact_groups(df, hash_of=hash_of).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got), key=repr) == plain_groups(docs)


def test_exact_groups_odd_tables(spark):
    schema = "doc_id long, text string, h binary, s binary, row int, n int, first string, __maybe boolean, class string"
    assert exact_dedup.exact_groups(spark.createDataFrame([], schema)).count() == 0
    rows = [(None,) * 9] * 3 + [(1, "x", b"", b"", 1, 1, "k", True, "c")] * 2
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in got) == [(0, None, 3, False), (0, None, 3, False), (0, None, 3, True), (1, 1, 2, False), (1, 1, 2, True)]


def test_exact_dedup_is_native(spark, sf):
    assert "Python" not in queries.op11_exact_dedup(spark, sf)._jdf.queryExecution().toString()


# --- op13 -------------------------------------------------------------------------------------
def plain_fim(i, text, seed=1, transformed=90, reversed_=20):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, d = len(tokens), hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= transformed:
        return i, n, "plain", None, None, text
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < reversed_:
        return i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def fim_docs():
    r = random.Random(13)
    pieces = ["word", "Ab", " ", "\n", "\r\n", "<", ">", "P", "<S", "M>", "é", "é", "中文", "😀", "\x00", " ", "12", ".", "'", "\\", "{seed}", "\t"]
    docs = [(i, "".join(r.choice(pieces) for _ in range(r.randint(0, 30)))) for i in range(600)]
    docs += [(1000, None), (1001, ""), (1002, "a<P>b"), (1003, "x<M>"), (None, "no id at all"), (None, None), (7, "again"), (7, "again"), (-5, "below zero"), (2000, "ab, " * 300_000), (2001, "é" * 5000), (2002, "x" * 5000)]
    return docs


def test_fill_in_middle(spark):
    docs = fim_docs()
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in docs], "doc_id long, text string, form string, batch int").repartition(5)
    want = sorted((plain_fim(*d) for d in docs), key=repr)
    made = fim.fill_in_middle(df)
    assert sorted((tuple(r) for r in made.collect()), key=repr) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert sorted((tuple(r) for r in fim.restored_texts(made).collect()), key=repr) == sorted(((i, t or "") for i, t in docs), key=repr)
    digests = sorted((tuple(r) for r in fim.fill_in_middle_digests(df).collect()), key=repr)
    assert digests == sorted(((*w[:5], sha(w[5]), sha(t or "")) for (i, t) in docs for w in [plain_fim(i, t)]), key=repr)
    other = fim.fill_in_middle(df, seed=8, transformed=100, reversed_=100).collect()
    assert sorted(map(tuple, other), key=repr) == sorted((plain_fim(i, t, 8, 100, 100) for i, t in docs), key=repr)
    assert fim.fill_in_middle(df.limit(0)).count() == 0


def test_batches_are_cut_by_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["a" * 600_000, None, "b" * 600_000, "c" * 3_000_000, "", "d"]})
    got = list(fim._pieces(batch, "text"))
    assert [b.num_rows for b in got] == [2, 1, 1, 2] and pa.Table.from_batches(got)["text"].to_pylist() == batch["text"].to_pylist()


# --- op12 -------------------------------------------------------------------------------------
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")
COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def plain_damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k:
            row = (c, t, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
            out += [row] * (2 if k == 3 else 1)
    return out


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        shown = VISIBLE.findall(text)
        out.append(1 if not shown else 2 if (role, text) in seen else 3 if shown[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def cheapest(turns, fault):
    """By (cost, letters) over states of the pattern, insertion allowed anywhere: a plain search that settles states in order."""
    import heapq

    n, done, heap = len(turns), set(), [(0, "", 0, "")]
    while heap:
        cost, letters, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n and state in ("", "a"):
            return cost, letters
        after = {"": "ua", "s": "u", "u": "a", "a": "u"}[state][:1]
        heapq.heappush(heap, (cost + 5, letters + "I", i, after))
        if i < n:
            heapq.heappush(heap, (cost + 2, letters + "D", i + 1, state))
            if fault[i] not in (1, 2):
                extra, own = 5 * (fault[i] == 3), turns[i][1][:1]
                if own == after or (own == "s" and state == ""):
                    heapq.heappush(heap, (cost + extra, letters + "K", i + 1, own))
                heapq.heappush(heap, (cost + extra + 1, letters + "R", i + 1, after))
    raise AssertionError


def plain_repair(rows, originals=()):
    said = defaultdict(list)
    for c, t, role, text in rows:
        said[c].append((t, " " if role is None else role, " " if text is None else text))
    out = {c: (0, 0, 0, 0, 0, 0, "", sha("")) for c in originals}
    for c, turns in said.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        fault, known = faults(turns), {t for t, _, _ in turns if t is not None}
        cost, letters = cheapest(turns, fault)
        made, left, state = [], iter(turns), ""
        for x in letters:
            if x == "D":
                next(left)
                continue
            _, role, text = ("", "", "") if x == "I" else next(left)
            state = "s" if x == "K" and not state and role[:1] == "s" else "a" if state == "u" else "u"
            made.append((role if x == "K" else {"u": "user", "a": "assistant"}[state]) + ":" + text)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        out[c] = (gaps, fault.count(1), fault.count(2), fault.count(3), illegal, cost, letters, sha("\n".join(made)))
    return out


SAID = "conv_id long, turn long, role string, text string"


def talk(seed, conversations=150, longest=9):
    r = random.Random(seed)
    rows = []
    for c in range(conversations):
        for t in range(r.randint(1, longest)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]) if r.random() < 0.4 else ("user", "assistant")[t % 2]
            text = r.choice(["Yes.", "No!", "so", "", " \n", None, "a?\t", "b. ", "é"]) if r.random() < 0.5 else f"Turn {r.randint(0, 5)}."
            rows.append((c, r.choice([t, t, t, 2 * t, t - 1, None]), role, text))
    return rows + [(None, 1, "user", "x."), (None, None, "assistant", "y."), (-7, 0, None, None)]


def reports(df, originals=None):
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair.repair_reports(df, originals).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_repair(spark, seed):
    rows = talk(seed)
    assert reports(spark.createDataFrame(rows, SAID).repartition(5)) == plain_repair(rows)


def test_conversations_over_many_ranges(spark):
    """With many ranges a long conversation is cut into chunks; states, ties, texts seen before, turns and pairs go over the borders."""
    r = random.Random(4)
    rows = talk(3, 20)
    for c, n in ((100, 900), (101, 400), (102, 300)):
        for t in range(n):
            role = r.choice(["user", "assistant", "system"]) if c == 100 else ("user", "assistant")[t % 2] if c == 101 else "system"
            rows.append((c, t // 3 * 2 if c == 100 else t, role, r.choice(["Yes.", "No.", "well", ""]) if r.random() < 0.2 else f"t{r.randint(0, 3 * n)}."))
    rows += [(103, None, "user", "same.") for _ in range(300)] + [(104, t, "user", f"u{t}") for t in range(300)]
    df = spark.createDataFrame(rows, SAID).repartition(6)
    want = plain_repair(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        assert repair.ranged(df).where("conv_id = 100").select("part").distinct().count() > 3
        assert reports(df) == want
        turns = defaultdict(list)
        for t in sorted(repair.repaired_turns(df).collect(), key=lambda t: (t.part, t.place)):
            turns[t.conv_id].append(f"{t.role}:{t.text}")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {c: sha("\n".join(turns[c])) for c in want} == {c: w[-1] for c, w in want.items()}


def test_least_cost_over_all_edits():
    """The plain search itself, against all strings of edits on small conversations."""
    r = random.Random(8)
    for _ in range(60):
        turns = [(t, r.choice(["user", "assistant", "system", "x"]), r.choice(["a.", "b.", "c", ""])) for t in range(r.randint(0, 3))]
        fault, best = faults(turns), None
        for size in range(2 * len(turns) + 3):
            for letters in itertools.product("DIKR", repeat=size):
                if sum(x != "I" for x in letters) != len(turns):
                    continue
                cost, state, i, ok = 0, "", 0, True
                for x in letters:
                    if x == "D":
                        cost, i = cost + 2, i + 1
                        continue
                    after = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
                    if x == "I":
                        cost, state = cost + 5, after
                        continue
                    own = turns[i][1][:1]
                    if fault[i] in (1, 2) or (x == "K" and own != after and not (own == "s" and state == "")):
                        ok = False
                        break
                    cost, state, i = cost + 5 * (fault[i] == 3) + (x == "R"), own if x == "K" else after, i + 1
                if ok and state in ("", "a") and (best is None or (cost, "".join(letters)) < best):
                    best = (cost, "".join(letters))
        assert cheapest(turns, fault) == best


def test_damage_and_whole_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in queries.op12_structure_repair(spark, sf).collect()}
    assert got == plain_repair(plain_damage(rows), {r[0] for r in rows})
    odd = talk(5) + [(c, t, "user", "What. Is! This?") for c in range(30) for t in range(3)]
    made = repair.damaged(spark.createDataFrame(odd, SAID)).collect()
    assert sorted(map(tuple, made), key=repr) == sorted(plain_damage(odd), key=repr)


def test_repair_odd_tables(spark):
    schema = SAID + ", ck int, cn string, part int, seq string, letters string, spans int, digest string, kind int, copy int"
    empty = spark.createDataFrame([], schema)
    assert repair.repair_reports(repair.damaged(empty), empty).count() == 0 and repair.repaired_turns(empty).count() == 0
    rows = [(None,) * 13] * 3 + [(1, 0, "user", "a." * 200_000, 1, "x", 1, "y", "z", 1, "d", 1, 1), (1, 1, "assistant", "b.", 1, "x", 1, "y", "z", 1, "d", 1, 1)]
    df = spark.createDataFrame(rows, schema)
    assert reports(df, df) == plain_repair([r[:4] for r in rows])
    alone = spark.createDataFrame([(8, 0, "user", "x")], SAID)
    assert reports(alone.limit(0), alone) == {8: (0, 0, 0, 0, 0, 0, "", sha(""))}
