"""Routes against Dijkstra's algorithm on the whole grid of channels."""

import heapq
import random
from collections import defaultdict

from graphloom import storage
from graphloom.operators import layout, routing

BOX = "group string, node_id string, x double, y double, width double, height double"
EDGE = "group string, edge_id string, source_id string, target_id string, place int"
C, TURN, OVERLAP = routing.CLEARANCE, routing.TURN, routing.OVERLAP


class Grid:
    def __init__(self, boxes):
        self.box = {b[1]: b for b in boxes}
        around = [(x - C, x + w / 2, x + w + C, y - C, y + h / 2, y + h + C) for _, _, x, y, w, h in boxes]
        self.xs, self.ys = sorted({v for a in around for v in a[:3]}), sorted({v for a in around for v in a[3:]})
        self.around = around

    def free(self, p, q):
        (xa, ya), (xb, yb) = min(p, q), max(p, q)
        for x0, _, x1, y0, _, y1 in self.around:
            if xa == xb and x0 < xa < x1 and max(ya, y0) < min(yb, y1) or ya == yb and y0 < ya < y1 and max(xa, x0) < min(xb, x1):
                return False
            if p == q and x0 < xa < x1 and y0 < ya < y1:
                return False
        return True

    def sides(self, n):
        _, _, x, y, w, h = self.box[n]
        return [((x - C, y + h / 2), "h"), ((x + w + C, y + h / 2), "h"), ((x + w / 2, y - C), "v"), ((x + w / 2, y + h + C), "v")]

    def neighbours(self):
        out = defaultdict(list)
        for i, x in enumerate(self.xs):
            for j, y in enumerate(self.ys):
                for q, way in (((self.xs[i + 1], y), "h") if i + 1 < len(self.xs) else (None, ""), ((x, self.ys[j + 1]), "v") if j + 1 < len(self.ys) else (None, "")):
                    if q and self.free((x, y), (x, y)) and self.free(q, q) and self.free((x, y), q):
                        out[(x, y)].append((q, way))
                        out[q].append(((x, y), way))
        return out

    def cost(self, a, b, near, used=()):
        ends, best = self.sides(b), {}
        heap = [(C, p, way) for p, way in self.sides(a) if self.free(p, p)]
        while heap:
            c, p, way = heapq.heappop(heap)
            if (p, way) in best:
                continue
            best[p, way] = c
            for q, axis in near[p]:
                length = abs(p[0] - q[0]) + abs(p[1] - q[1])
                more = length * OVERLAP * used.count((min(p, q), max(p, q))) if used else 0
                heapq.heappush(heap, (c + length + more + (TURN if axis != way else 0), q, axis))
        found = [best[p, way] + C + (TURN if way != end else 0) for p, end in ends for way in "hv" if (p, way) in best]
        return min(found, default=None)

    def unit_pieces(self, points):
        out = []
        for (xa, ya), (xb, yb) in zip(points, points[1:]):
            (xa, ya), (xb, yb) = min((xa, ya), (xb, yb)), max((xa, ya), (xb, yb))
            if xa == xb:
                at = [y for y in self.ys if ya <= y <= yb]
                out += [((xa, p), (xa, q)) for p, q in zip(at, at[1:])]
            else:
                at = [x for x in self.xs if xa <= x <= xb]
                out += [((p, ya), (q, ya)) for p, q in zip(at, at[1:])]
        return [(p, q) for p, q in out if self.free(p, p) and self.free(q, q)]


def scenes(seed):
    r = random.Random(seed)
    boxes, edges = [], []
    for g in range(6):
        name = f"g{g}"
        n = r.randint(2, 9)
        cells = r.sample([(i, j) for i in range(4) for j in range(3)], n)
        jitter = 0 if g % 2 else 20
        for k, (i, j) in enumerate(cells):
            boxes.append((name, f"n{k}", i * 220.0 + r.randint(0, jitter), j * 130.0 + r.randint(0, jitter), 140.0 + r.choice([0, 20]), 60.0 + r.choice([0, 10])))
        for e in range(r.randint(1, 10)):
            a, b = r.randrange(n), r.randrange(n)
            edges.append((name, f"{name}e{e}", f"n{a}", f"n{b}", r.randint(0, 3)))
    # a card shut in by others, a card that is not there
    boxes += [("shut", "in", 0.0, 0.0, 50.0, 50.0), ("shut", "l", -70.0, -60.0, 60.0, 170.0), ("shut", "r", 60.0, -60.0, 60.0, 170.0), ("shut", "t", -10.0, -70.0, 70.0, 60.0), ("shut", "b", -10.0, 60.0, 70.0, 60.0)]
    edges += [("shut", "no way", "in", "l", 0), ("shut", "around", "l", "r", 1), ("shut", "nobody", "l", "ghost", 0)]
    return boxes, edges


def routes(spark, boxes, edges, **k):
    return {r.edge_id: r for r in routing.orthogonal_routes(spark.createDataFrame(boxes, BOX), spark.createDataFrame(edges, EDGE), **k).collect()}


def by_group(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[0]].append(r)
    return out


def test_routes_are_the_cheapest(spark):
    boxes, edges = scenes(3)
    got = routes(spark, boxes, edges, passes=1)
    assert set(got) == {e[1] for e in edges}
    groups = by_group(boxes)
    near = {g: Grid(b).neighbours() for g, b in groups.items()}
    for g, e, a, b, _ in edges:
        grid, r = Grid(groups[g]), got[e]
        want = grid.cost(a, b, near[g]) if a != b and b in grid.box else None
        assert (r.status, r.cost) == (("failed", None) if want is None else ("routed", want)), e
        if want is None:
            continue
        pts = [tuple(p) for p in r.points]
        length = sum(abs(p[0] - q[0]) + abs(p[1] - q[1]) for p, q in zip(pts, pts[1:]))
        assert length + TURN * (len(pts) - 2) == want
        assert all((p[0] == q[0]) != (p[1] == q[1]) for p, q in zip(pts, pts[1:]))
        outer = [pts[0], *pts[1:-1], pts[-1]]
        shrunk = lambda p, q: (p[0] + (C if q[0] > p[0] else -C if q[0] < p[0] else 0), p[1] + (C if q[1] > p[1] else -C if q[1] < p[1] else 0))
        outer[0], outer[-1] = shrunk(pts[0], pts[1]), shrunk(pts[-1], pts[-2])
        assert all(grid.free(p, q) for p, q in zip(outer, outer[1:]))


def test_later_edges_leave_lanes_to_earlier_ones(spark):
    boxes, edges = scenes(5)
    edges += [("g1", f"twin{i}", "n0", "n1", i) for i in range(4)]
    first, second = routes(spark, boxes, edges, passes=1), routes(spark, boxes, edges)
    groups, place = by_group(boxes), {e[1]: (e[4], e[1]) for e in edges}
    moved = 0
    for g, es in by_group(edges).items():
        grid = Grid(groups[g])
        near, took = grid.neighbours(), defaultdict(list)
        pieces = {e[1]: grid.unit_pieces([tuple(p) for p in first[e[1]].points]) for e in es if first[e[1]].points}
        for e, ps in pieces.items():
            for p in ps:
                took[p].append(e)
        keep = {e for e, ps in pieces.items() if all(min(took[p], key=place.get) == e for p in ps)}
        used = [p for e in keep for p in pieces[e]]
        for _, e, a, b, _ in es:
            if e in keep or first[e].status == "failed":
                assert (second[e].status, second[e].cost, second[e].points) == (first[e].status, first[e].cost, first[e].points)
            else:
                moved += 1
                assert second[e].cost == grid.cost(a, b, near, used)
    assert moved


def test_a_laid_out_scene(spark):
    nodes = spark.createDataFrame([("s", f"n{i:02}", i) for i in range(40)], "group string, node_id string, ord int")
    boxes = layout.grid(nodes)
    edges = spark.createDataFrame([("s", f"e{i}", f"n{i * 7 % 40:02}", f"n{i * 11 % 40:02}", i) for i in range(1, 40)], EDGE)
    got = routing.orthogonal_routes(boxes, edges).collect()
    assert {r.edge_id for r in got if r.status == "failed"} == {f"e{i}" for i in range(1, 40) if i * 4 % 40 == 0}
    assert routing.orthogonal_routes(boxes.limit(0), edges.limit(0)).count() == 0


def test_scenes_in_tasks_and_by_rounds_of_joins_have_the_same_routes(spark):
    boxes, edges = scenes(5)
    edges += [("g1", f"twin{i}", "n0", "n1", i) for i in range(4)]
    boxes, edges = ([r for r in rows if r[0] in ("g0", "g1", "shut")] for rows in (boxes, edges))
    sizes = sorted(r["count"] for r in routing.channel_points(spark.createDataFrame(boxes, BOX)).groupBy("group").count().collect())
    in_tasks, mixed = routes(spark, boxes, edges), routes(spark, boxes, edges, whole=sizes[1])
    assert sizes[0] < sizes[1] < sizes[2] and set(in_tasks) == {e[1] for e in edges}
    assert in_tasks == mixed


def test_shares_of_a_scene_have_the_same_routes(spark, monkeypatch):
    boxes, edges = scenes(9)
    at_once = routes(spark, boxes, edges)
    monkeypatch.setattr(routing, "SHARE", 200)
    assert routes(spark, boxes, edges) == at_once


def comb(bends):
    """A closed room with walls that leave a way at one end in turn: a route has to go up and down between them."""
    right = 120.0 * bends + 200.0
    walls = [("s", f"w{i}", 120.0 * i, 0.0 if i % 2 else -460.0, 20.0, 1500.0) for i in range(bends)]
    room = [("s", "top", -300.0, -460.0, right + 300, 20.0), ("s", "bottom", -300.0, 1480.0, right + 300, 20.0), ("s", "left", -300.0, -460.0, 20.0, 1960.0), ("s", "right", right - 20, -460.0, 20.0, 1960.0)]
    return [*walls, *room, ("s", "a", -200.0, 500.0, 60.0, 40.0), ("s", "b", right - 140, 500.0, 60.0, 40.0)]


def test_tables_do_not_grow_in_number_with_the_bends(spark):
    written = []
    for bends in (1, 8):
        boxes, before = comb(bends), len(storage._written)
        r = routes(spark, boxes, [("s", "e", "a", "b", 0)])["e"]
        written.append(len(storage._written) - before)
        grid = Grid(boxes)
        assert r.cost == grid.cost("a", "b", grid.neighbours()) and len(r.points) > bends
    assert written[0] == written[1] <= 12
