"""Layouts of components, nested frames and labels against plain versions."""

import math
import random
from collections import defaultdict

from graphloom.operators import placement as P

NODE = "group string, node_id string"
EDGE = "group string, source_id string, target_id string, relation_type string, relation_family string"
W, H = P.CARD_WIDTH, P.CARD_HEIGHT


def parts(nodes, edges):
    near = {n: set() for n in nodes}
    for a, b, *_ in edges:
        near[a].add(b)
        near[b].add(a)
    todo, out = set(nodes), []
    while todo:
        seen, front = set(), [min(todo)]
        while front:
            x = front.pop()
            if x not in seen:
                seen.add(x)
                front += near[x]
        todo -= seen
        out.append(sorted(seen))
    return out, near


def ranks_of(nodes, edges):
    """Longest paths over the graph whose cycles are shrunk."""
    out = {n: {b for a, b in edges if a == n} for n in nodes}
    reach = {}
    for n in nodes:
        seen, todo = set(), [n]
        while todo:
            for y in out[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        reach[n] = seen
    same = {n: min([n] + [m for m in nodes if m in reach[n] and n in reach[m]]) for n in nodes}
    memo = {}

    def rank(c):
        if c not in memo:
            memo[c] = max([rank(same[a]) + 1 for a, b in edges if same[b] == c and same[a] != c], default=0)
        return memo[c]

    return {n: rank(same[n]) for n in nodes}


def plain_component(nodes, near, edges):
    n = len(nodes)
    if n == 1:
        return "single", {nodes[0]: (0.0, 0.0)}, {nodes[0]: 0}
    directed = [e for e in edges if e[2] == "prerequisite" and e[3] != "unresolved"]
    rank = ranks_of(nodes, {(a, b) for a, b, *_ in directed})
    hub = max(nodes, key=lambda x: (len(near[x]), x))
    lx, ly = W + max(P.RANK_GAP, 96), H + max(P.ROW_GAP, 54)
    if len(near[hub]) >= max(6, math.ceil((n - 1) * 0.6)):
        leaves = [x for x in nodes if x != hub]
        side = max(2, math.ceil(len(leaves) / 4))
        w, h = side + 1, max(4, math.ceil(len(leaves) / (side * 2)) + 2)
        while 2 * w + 2 * (h - 2) < len(leaves):
            h += 1
        slots = [(c, 0) for c in range(w)] + [(c, h - 1) for c in range(w)] + [(0, r) for r in range(1, h - 1)] + [(w - 1, r) for r in range(1, h - 1)]
        return "ring", {hub: ((w - 1) * lx / 2, (h - 1) * ly / 2), **{x: (c * lx, r * ly) for x, (c, r) in zip(leaves, slots)}}, rank
    # the order inside ranks
    lines = {r: sorted(x for x in nodes if rank[x] == r) for r in set(rank.values())}
    for k in range(P.SWEEPS):
        height = {x: (i + 0.5) / len(line) for line in lines.values() for i, x in enumerate(line)}
        mean = {}
        for x in nodes:
            h = [height[y] for y in near[x] if (rank[y] < rank[x] if k % 2 == 0 else rank[y] > rank[x])]
            mean[x] = round(sum(h) / len(h), 9) if h else height[x]
        lines = {r: sorted(line, key=lambda x: (mean[x], x)) for r, line in lines.items()}
    if len(lines) > 1 and len(directed) >= max(2, n // 3):
        columns = {r: math.ceil(len(v) / 5) for r, v in lines.items()}
        rows = {r: math.ceil(len(v) / columns[r]) for r, v in lines.items()}
        at, left = {}, 0
        for r in sorted(lines):
            for i, x in enumerate(lines[r]):
                short = min(columns[r], len(lines[r]) - i // columns[r] * columns[r])
                at[x] = ((left + (columns[r] - short) / 2 + i % columns[r]) * (W + P.RANK_GAP), (max(rows.values()) - rows[r]) * (H + P.ROW_GAP) / 2 + i // columns[r] * (H + P.ROW_GAP))
            left += columns[r]
        return "bands", at, rank
    order = [x for r in sorted(lines) for x in lines[r]]
    wide = max(2, min(n, math.ceil(math.sqrt(n * P.ASPECT * ly / lx))))
    return "grid", {x: (((wide - min(wide, n - i // wide * wide)) / 2 + i % wide) * lx, i // wide * ly) for i, x in enumerate(order)}, rank


def plain_layout(nodes, edges):
    out = {}
    for g in {n[0] for n in nodes}:
        mine = [n for x, n in nodes if x == g]
        own = [e[1:] for e in edges if e[0] == g and e[1] != e[2] and {e[1], e[2]} <= set(mine)]
        found, near = parts(mine, own)
        units = []
        for members in sorted(found, key=lambda m: (-len(m), m[0])):
            shape, at, rank = plain_component(members, near, [e for e in own if e[0] in members])
            units.append((shape, at, rank, max(x for x, _ in at.values()) + W, max(y for _, y in at.values()) + H))
        gap = P.COMPONENT_GAP
        page = max(max(u[3] for u in units), math.sqrt(max(1, sum((u[3] + gap) * (u[4] + gap) for u in units)) * P.ASPECT))
        x = y = tall = 0.0
        for shape, at, rank, w, h in units:
            if x and x + w > page:
                x, y, tall = 0.0, y + tall + gap, 0.0
            for n, (a, b) in at.items():
                out[g, n] = (shape, rank[n], round(x + a, 6), round(y + b, 6))
            x, tall = x + w + gap, max(tall, h)
    return out


def made(seed):
    r = random.Random(seed)
    nodes, edges = [], []
    for g, n, m, kinds in (("star", 12, 0, ()), ("mix", 40, 38, ("prerequisite", "contrast")), ("sym", 14, 16, ("contrast", "parallel")), ("dag", 60, 110, ("prerequisite",)), ("one", 1, 0, ()), ("none", 9, 0, ())):
        nodes += [(g, f"n{i:02}") for i in range(n)]
        edges += [(g, f"n{a:02}", f"n{b:02}", r.choice(kinds), r.choice(["semantic", "semantic", "unresolved"])) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(m))]
    edges += [("star", "n03", f"n{i:02}", "contrast", "semantic") for i in range(12) if i != 3] + [("star", "n01", "n02", "prerequisite", "semantic"), ("mix", "n00", "ghost", "prerequisite", "semantic"), ("dag", "n05", "n05", "prerequisite", "semantic")]
    return nodes, edges


def test_component_layout(spark):
    nodes, edges = made(4)
    got = {(r.group, r.node_id): (r.shape, r["rank"], round(r.x, 6), round(r.y, 6)) for r in P.component_layout(spark.createDataFrame(nodes, NODE).repartition(3), spark.createDataFrame(edges, EDGE)).collect()}
    want = plain_layout(nodes, edges)
    assert {v[0] for v in want.values()} == {"ring", "bands", "grid", "single"}
    assert got == want
    assert P.component_layout(spark.createDataFrame([], NODE), spark.createDataFrame([], EDGE)).count() == 0


def plain_frames(scopes, held):
    kids, parent = defaultdict(list), {s: p for s, p, _ in scopes}
    for s, p, o in sorted(scopes, key=lambda s: (s[2], s[0])):
        kids[p if p in parent else ""].append(s)
    out = {}

    def measure(s):
        w, h = held.get(s, (0.0, 0.0))
        y, sizes = P.HEADER + P.PAD_Y + h + (P.UNIT_GAP if s in held and kids[s] else 0.0), []
        for c in kids[s]:
            cw, ch = measure(c)
            sizes.append((c, y, cw))
            y += ch + P.UNIT_GAP
        bottom = max(P.HEADER + P.PAD_Y + h, y - P.UNIT_GAP if kids[s] else 0.0)
        width = max(P.SCOPE_WIDTH, w + 2 * P.PAD_X, *(cw + 2 * P.PAD_X for _, _, cw in sizes))
        out[s] = [width, max(P.HEADER + 2 * P.PAD_Y + H, bottom + P.PAD_Y), [(c, cy) for c, cy, _ in sizes]]
        return out[s][:2]

    placed = {}

    def place(s, depth, y):
        placed[s] = (depth, depth * P.PAD_X, y, *out[s][:2])
        for c, cy in out[s][2]:
            place(c, depth + 1, y + cy)

    y = 0.0
    for root in kids[""]:
        _, h = measure(root)
        place(root, 0, y)
        y += h + P.ROOT_GAP
    return placed


def test_scope_frames(spark):
    r = random.Random(7)
    scopes = [(f"s{i:03}", "" if i < 3 else "gone" if i == 9 else f"s{r.randrange(max(0, i - 25), i):03}", r.randint(0, 3)) for i in range(120)]
    scopes += [(f"deep{i:03}", f"deep{i - 1:03}" if i else None, 0) for i in range(70)]
    held = {s: (r.choice([100.0, 900.0]), r.choice([50.0, 400.0])) for s, _, _ in scopes if r.random() < 0.6}
    loop = [("ra", "rc", 0), ("rb", "ra", 0), ("rc", "rb", 0), ("under", "rb", 0)]
    df = spark.createDataFrame(scopes + loop, "scope_id string, parent_id string, ord int")
    frames, issues = P.scope_frames(df, spark.createDataFrame([(s, *v) for s, v in held.items()], "scope_id string, width double, height double"))
    got = {f.scope_id: (f.depth, f.x, f.y, f.width, f.height) for f in frames.collect()}
    assert got == plain_frames(scopes, held)
    assert [tuple(i) for i in issues.collect()] == [("layout_structure_cycle", "ra")]


def test_nested_layout(spark):
    scopes = spark.createDataFrame([("a", "", 0), ("b", "a", 0), ("c", "a", 1), ("d", "c", 0), ("x", "y", 0), ("y", "x", 0)], "scope_id string, parent_id string, ord int")
    nodes = [(s, f"{s}{i}") for s in "abdx" for i in range(4)]
    edges = [(s, f"{s}0", f"{s}{i}", "prerequisite", "semantic") for s in "ab" for i in (1, 2)]
    frames, cards, issues = P.nested_layout(scopes, spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE))
    box = {f.scope_id: (f.x, f.y, f.x + f.width, f.y + f.height) for f in frames.collect()}
    inside = lambda a, b: a[0] >= b[0] and a[1] >= b[1] and a[2] <= b[2] and a[3] <= b[3]
    assert set(box) == set("abcd") and inside(box["b"], box["a"]) and inside(box["c"], box["a"]) and inside(box["d"], box["c"])
    placed = cards.collect()
    rects = [(c.scope_id, (c.x, c.y, c.x + c.width, c.y + c.height)) for c in placed]
    assert len(placed) == 12 and all(inside(r, box[s]) for s, r in rects)
    apart = lambda a, b: a[2] <= b[0] or b[2] <= a[0] or a[3] <= b[1] or b[3] <= a[1]
    assert all(apart(p, q) for i, (_, p) in enumerate(rects) for _, q in rects[:i])
    assert all(apart(r, box[t]) for s, r in rects for t in box if t != s and (s, t) in {("a", "b"), ("a", "c"), ("b", "c"), ("b", "d")})
    assert sorted(tuple(i) for i in issues.collect()) == sorted([("layout_structure_cycle", "x")] + [("layout_coordinate_missing", f"x{i}") for i in range(4)])


def plain_labels(routes, cards):
    out = {}
    for g in {r[0] for r in routes}:
        mine, placed = [r for r in routes if r[0] == g], []
        touches = lambda a, b, wb, hb: not (a[0] + P.LABEL_WIDTH <= b[0] - 2 or b[0] + wb <= a[0] - 2 or a[1] + P.LABEL_HEIGHT <= b[1] - 2 or b[1] + hb <= a[1] - 2)
        for _, e, _, status, important, pts in sorted(mine, key=lambda r: (r[2], r[1])):
            if status != "routed" or len(pts) < 2:
                out[g, e] = (None, None, False, "route_unavailable")
                continue
            size = lambda s: abs(s[0][0] - s[1][0]) + abs(s[0][1] - s[1][1])
            slot = None
            for s in sorted(zip(pts, pts[1:]), key=size, reverse=True):
                at = ((s[0][0] + s[1][0]) / 2 - P.LABEL_WIDTH / 2, (s[0][1] + s[1][1]) / 2 - P.LABEL_HEIGHT / 2 - 6)
                if size(s) >= 90 and not any(touches(at, c[2:4], c[4], c[5]) for c in cards if c[0] == g) and not any(touches(at, p, P.LABEL_WIDTH, P.LABEL_HEIGHT) for p in placed):
                    slot = at
                    break
            if slot is None:
                out[g, e] = (None, None, False, "no_safe_slot")
            else:
                placed.append(slot)
                shown = len(mine) <= 12 or important
                out[g, e] = (*slot, shown, "" if shown else "overview_density")
    return out


def test_label_places(spark):
    r = random.Random(9)
    routes, cards = [], []
    for g, n in (("dense", 60), ("few", 10), ("crowd", 150)):
        cards += [(g, f"c{i}", r.randint(0, 1500) * 1.0, r.randint(0, 1500) * 1.0, 120.0, 60.0) for i in range(8)]
        for i in range(n):
            p = [(r.randint(0, 40) * 40.0, r.randint(0, 40) * 40.0)]
            for k in range(r.randint(0, 4)):
                step = r.choice([-400.0, -120.0, -40.0, 80.0, 120.0, 300.0])
                p.append((p[-1][0] + step, p[-1][1]) if k % 2 else (p[-1][0], p[-1][1] + step))
            routes.append((g, f"e{i:03}", r.randint(0, 2), "failed" if i % 17 == 3 else "routed", i % 5 == 0, p))
    df = spark.createDataFrame(routes, "group string, edge_id string, place int, status string, important boolean, points array<struct<x:double,y:double>>")
    got = P.label_places(df.repartition(4), spark.createDataFrame(cards, "group string, node_id string, x double, y double, width double, height double")).collect()
    assert {(x.group, x.edge_id): (x.x, x.y, x.visible, x.reason) for x in got} == plain_labels(routes, cards)
    assert len(got) == len(routes) and {x.reason for x in got} == {"", "route_unavailable", "no_safe_slot", "overview_density"}


def plain_reading(cards, sequences):
    at = {(g, n): [x, y, w, h] for g, n, x, y, w, h in cards}
    named = defaultdict(list)
    for g, s, p, n, o in sequences:
        if (g, n) in at and (g, p) in at:
            named[g, s].append((o, n, p))
    for (g, _), items in sorted(named.items()):
        if len(items) < 2:
            continue
        items.sort()
        own = {n for _, n, _ in items} | {items[0][2]}
        px, py, pw, ph = at[g, items[0][2]]
        total = sum(at[g, n][3] for _, n, _ in items) + P.ROW_GAP * (len(items) - 1)
        x, y0 = px + pw + 96, max(0.0, py + ph / 2 - total / 2)
        while True:
            y, column = y0, []
            for _, n, _ in items:
                column.append((n, y, *at[g, n][2:]))
                y += at[g, n][3] + P.ROW_GAP
            hit = [b for (k, n), b in at.items() if k == g and n not in own and any(x - 14 < b[0] + b[2] and b[0] < x + w + 14 and cy - 14 < b[1] + b[3] and b[1] < cy + h + 14 for _, cy, w, h in column)]
            if not hit:
                break
            x = max(b[0] + b[2] for b in hit) + 96
        for n, cy, _, _ in column:
            at[g, n][:2] = [x, cy]
    return {k: tuple(v) for k, v in at.items()}


def test_reading_places(spark):
    r = random.Random(10)
    cards = [(g, f"n{i}", r.randint(0, 12) * 160.0, r.randint(0, 8) * 110.0, r.choice([100.0, 140.0]), r.choice([50.0, 80.0])) for g, n in (("a", 25), ("b", 9), ("c", 3)) for i in range(n)]
    sequences = [("a", s, p, f"n{i}", r.randint(0, 3)) for s, p, own in (("s1", "n0", (1, 2, 3)), ("s2", "n4", (5, 6, 7, 8)), ("s3", "n1", (9, 10)), ("s4", "ghost", (11, 12)), ("s5", "n2", (13,))) for i in own]
    sequences += [("b", "z", "n8", f"n{i}", -i) for i in (0, 1, 2)] + [("b", "y", "n3", "n4", 1), ("b", "y", "n3", "lost", 2), ("none", "s", "n0", "n1", 1)]
    df = spark.createDataFrame(cards, "group string, node_id string, x double, y double, width double, height double")
    got = P.reading_places(df.repartition(3), spark.createDataFrame(sequences, "group string, sequence_id string, parent_id string, node_id string, ordinal int")).collect()
    want = plain_reading(cards, sequences)
    assert {(c.group, c.node_id): (c.x, c.y, c.width, c.height) for c in got} == want
    assert sum(want[c[:2]] != c[2:] for c in cards) >= 8
