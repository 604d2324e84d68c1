"""Scans over ranges, greedy cuts and walks against plain loops, with one group that holds most rows."""

import math
import random

from pyspark.sql import functions as F

from graphloom.functions import vocab
from graphloom.operators import graph as G
from graphloom.operators import layout as L
from graphloom.operators import pages as P
from graphloom.operators import scans, session

from .test_whole import plain_plans


def groups(seed):
    r = random.Random(seed)
    return {"hot": 3000, "b": 7, "c": 1, None: 40, "d": r.randint(2, 90)}, r


def test_running(spark):
    sizes, r = groups(1)
    rows = [(g, i * 3, r.choice([None, 0, 1, 5])) for g, n in sizes.items() for i in range(n)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, ord long, v long").repartition(5)
    got = sorted(((x.g or "", x.ord, x.idx, x.n, x.total) for x in scans.running(df, ["g"], ["ord"], total=F.col("v")).collect()))
    want = []
    for g, n in sizes.items():
        total = 0
        for i, (_, o, v) in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: x[1])):
            total += v or 0
            want.append((g or "", o, i + 1, n, total))
    assert got == sorted(want)
    assert scans.running(df.limit(0), ["g"], ["ord"]).count() == 0
    placed = scans.running(df.where("g is not null"), ["g"], ["ord"])
    pairs = sorted((x.g, x.p_ord, x.ord) for x in scans.with_previous(placed, "g", ["ord"], strip=16).collect())
    assert pairs == sorted((g, 3 * i, 3 * i + 3) for g, n in sizes.items() if g for i in range(n - 1))


def plain_shelves(units, width, gap):
    x = y = tall = 0.0
    out = []
    for u, w, h in units:
        if x > 0 and x + w > width:
            x, y, tall = 0.0, y + tall + gap, 0.0
        out.append((u, x, y))
        x, tall = x + w + gap, max(tall, h)
    return out


def test_shelves(spark):
    sizes, r = groups(2)
    rows = [(g or "null", f"u{i:05}", i, r.choice([0.0, 10.0, 60.0, 90.0, 700.0]), r.choice([20.0, 30.0])) for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "group string, unit_id string, ord int, width double, height double").repartition(3)
    for width in (600.0, 100.0):
        want = sorted((g, u, x, y) for g in {x[0] for x in rows} for u, x, y in plain_shelves([(x[1], x[3], x[4]) for x in sorted(rows, key=lambda x: x[2]) if x[0] == g], width, 40.0))
        assert sorted((x.group, x.unit_id, x.x, x.y) for x in L.shelves(df, width).collect()) == want
    own = {}
    for x in L.shelves(df).collect():
        own.setdefault(x.group, []).append(x)
    for g, placed in own.items():
        mine = [x for x in rows if x[0] == g]
        width = max(max(x[3] for x in mine), max(1.0, sum((x[3] + 40) * (x[4] + 40) for x in mine) * 1.6) ** 0.5)
        want = plain_shelves([(x[1], x[3], x[4]) for x in sorted(mine, key=lambda x: x[2])], width, 40.0)
        assert sorted((x.unit_id, round(x.x, 6), round(x.y, 6)) for x in placed) == sorted(want)


def test_batches_of_a_long_book(spark):
    sizes, r = groups(3)
    rows = [(g or "x", i + 1, r.choice([0, 10, 3000, 5000, 13_000])) for g, n in sizes.items() for i in range(n)]
    want = []
    for g in {x[0] for x in rows}:
        batch = k = chars = 0
        for _, i, c in sorted(x for x in rows if x[0] == g):
            if k and (k >= 4 or chars + c > 12_000):
                batch, k, chars = batch + 1, 0, 0
            k, chars = k + 1, chars + c
            want.append((g, i, batch))
    got = P.batches(spark.createDataFrame(rows, "book string, page_index int, chars int").repartition(4)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_walks_of_dense_chapters_and_long_chains(spark):
    r = random.Random(6)
    kinds = [*vocab.MAIN_TYPES, *vocab.AUXILIARY_TYPES, "chapter"]
    nodes, edges = [], set()
    for c, n, m in (("a", 60, 400), ("b", 25, 30), ("c", 2, 1), ("d", 90, 0)):
        for i in range(n):
            nodes.append((c, f"{c}{i:03}", vocab.MAIN_TYPES[0] if c == "d" else r.choice(kinds), i))
        for _ in range(m):
            a, b = r.randrange(n), r.randrange(n)
            if a != b:
                edges.add((c, f"{c}{a:03}", f"{c}{b:03}", r.choice([*vocab.BACKBONE, "related_to", "contains"])))
    edges |= {("d", f"d{i:03}", f"d{i + 1:03}", vocab.BACKBONE[0]) for i in range(89)}
    n = spark.createDataFrame(nodes, "chapter string, node_id string, node_type string, ord int")
    e = spark.createDataFrame(sorted(edges), "chapter string, source_id string, target_id string, relation_type string")
    got = {(x.chapter, x.node_id): (x.place, x.parent, x.position) for x in G.chapter_plans(n, e).collect()}
    want = plain_plans([x.asDict() for x in n.collect()], [x.asDict() for x in e.collect()])
    assert got == want
    assert sum(v[0] == "path" for k, v in want.items() if k[0] == "d") == 90


def test_stale_commands_of_documents_of_any_size(spark):
    """The fold, one command after the other, of logs of which one document holds most."""
    r = random.Random(6)
    log = [(r.choice(["a", "a", "a", "b", "c", None]), i // 2, i, r.choice([None, r.randrange(3), i // 3, i // 2, -1])) for i in range(900)]
    log += [("d", i, 1000 + i, i) for i in range(300)] + [("e", i, 2000 + i, 0) for i in range(50)]
    revision, want = {}, []
    for doc, _, command, expected in sorted(log, key=lambda c: c[1:3]):
        now = revision.get(doc, 0)
        late = expected is not None and expected != now
        want.append((command, doc, now, late))
        revision[doc] = now + (not late)
    r.shuffle(log)
    got = session.stale(spark.createDataFrame(log, "document_id string, at long, command_id long, expected_revision long"))
    assert sorted((x.command_id, x.document_id, x.revision_before, x.is_stale) for x in got.collect()) == sorted(want, key=lambda w: w[0])
    assert revision["d"] == 300 and revision["e"] == 1 and session.stale(spark.createDataFrame([], "document_id string, at long, command_id long, expected_revision long")).count() == 0


def test_percentiles_of_groups_of_any_size(spark):
    r = random.Random(7)
    values = [(r.choice(["a", "b", None]), r.choice([None, float(r.randrange(40)), r.random()])) for _ in range(700)] + [("one", 3.0)]
    got = L.percentile(spark.createDataFrame(values, "g string, v double"), "g", "v", 0.95).collect()
    want = {}
    for g in {g for g, _ in values}:
        own = sorted((v for h, v in values if h == g), key=lambda v: (v is not None, v or 0.0))
        at = own[max(1, math.ceil(len(own) * 0.95)) - 1]
        want[g] = None if at is None else round(at, 3)
    assert {x.g: x.v for x in got} == want
