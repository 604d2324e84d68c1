"""Cheapest routes of some edges of one scene, for ``routing``: rounds of one bend each over arrays of points and edges."""

from __future__ import annotations

import numpy as np

#: Points times edges that are searched at once.
CELLS = 2**18
#: Runs of up to so many points, and up to four times as many, ... are searched as one table.
SHORT = 4
#: The ways in which an edge leaves left, right, top and bottom of a card.
SIDES = "hhvv"


class _Runs:
    """A scene's runs of one way. at: the points' places along them, with what shared stretches cost."""

    def __init__(self, line: np.ndarray, run: np.ndarray, place: np.ndarray, cum: np.ndarray):
        n = len(line)
        self.at, self.order = place + cum, np.lexsort((place, run, line))
        here = np.stack((line[self.order], run[self.order]))
        self.first = np.flatnonzero(np.append(True, (here[:, 1:] != here[:, :-1]).any(0))) if n else np.zeros(0, int)
        size = np.diff(np.append(self.first, n))
        self.size, self.of = size, np.empty(n, int)
        self.of[self.order] = np.repeat(np.arange(len(size)), size)
        self.tables, most = [], SHORT
        todo = np.flatnonzero(size > 1)
        while len(todo):
            some, todo = todo[size[todo] <= most], todo[size[todo] > most]
            most *= 4
            if len(some):
                step = np.arange(size[some].max())
                held = step < size[some, None]
                ids = np.where(held, self.order[np.minimum(self.first[some, None] + step, n - 1)], n)
                self.tables.append((ids, np.append(self.at, 0.0)[ids][:, :, None], held, ids[held]))

    def points(self, p: int) -> np.ndarray:
        """The points of the run through p."""
        a = self.first[self.of[p]]
        return self.order[a : a + self.size[self.of[p]]]

    def moved(self, cost: np.ndarray) -> np.ndarray:
        """What it costs at least to be at each point, (points and a void one, edges), after a move along a run from any of its points."""
        out = cost.copy()
        for ids, at, held, points in self.tables:
            here = cost[ids]
            there = np.minimum.accumulate(here - at, axis=1) + at
            back = np.minimum.accumulate((here + at)[:, ::-1], axis=1)[:, ::-1] - at
            out[points] = np.minimum(there, back)[held]
        return out


def _sides(box: np.ndarray, clearance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of boxes (x0, xm, x1, y0, ym, y1): x and y of the four places just outside the clearance, and of the ports on the card."""
    x0, xm, x1, y0, ym, y1 = box.T
    pick = lambda *c: np.stack(c, 1)
    return pick(x0, x1, xm, xm), pick(ym, ym, y0, y1), pick(x0 + clearance, x1 - clearance, xm, xm), pick(ym, ym, y0 + clearance, y1 - clearance)


class Scene:
    """The points of a scene's channels: places, names of runs, and what shared stretches cost from a run's first point on."""

    def __init__(self, x: np.ndarray, y: np.ndarray, vrun: np.ndarray, hrun: np.ndarray, vcum: np.ndarray, hcum: np.ndarray):
        self.x, self.y, self.n = x, y, len(x)
        self.runs = {"v": _Runs(x, vrun, y, vcum), "h": _Runs(y, hrun, x, hcum)}
        self.ux, i = np.unique(x, return_inverse=True)
        self.uy, j = np.unique(y, return_inverse=True)
        self.there = np.full((len(self.ux), len(self.uy)), self.n)
        self.there[i, j] = np.arange(self.n)
        most = max(1.0, *(float(np.abs(r.at).max(initial=0)) for r in self.runs.values()))
        #: Costs that differ by less are the same; ways are followed back with some more.
        self.least = max(1e-9, 1e-13 * most)
        self.near = 100 * self.least

    def points_at(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The points that stand there; n where none does."""
        if not self.n:
            return np.zeros(x.shape, int)
        i, j = np.minimum(np.searchsorted(self.ux, x), len(self.ux) - 1), np.minimum(np.searchsorted(self.uy, y), len(self.uy) - 1)
        return np.where((self.ux[i] == x) & (self.uy[j] == y), self.there[i, j], self.n)

    def routes(self, source: np.ndarray, target: np.ndarray, clearance: float, turn: float):
        """(edge, cost, path) of the cheapest routes between boxes, one row for each edge; edges without a way have none.

        Of equal routes the one with the fewest moves is found, then the one with the least path.
        """
        step = max(1, CELLS // max(1, self.n))
        for a in range(0, len(source), step):
            search = _Search(self, source[a : a + step], target[a : a + step], clearance, turn)
            yield from ((a + e, *found) for e, found in search.routes())


class _Search:
    """Costs of states, (points and a void one, edges) for each way in which a point is reached, and the move with which they were found."""

    def __init__(self, scene: Scene, source: np.ndarray, target: np.ndarray, clearance: float, turn: float):
        self.scene, self.clearance, self.turn = scene, clearance, turn
        self.edge = np.arange(len(source))
        sx, sy, self.source_x, self.source_y = _sides(source, clearance)
        tx, ty, self.target_x, self.target_y = _sides(target, clearance)
        self.starts, self.ends = scene.points_at(sx, sy), scene.points_at(tx, ty)
        beside = lambda at, lo, hi: np.maximum(0.0, np.maximum(lo - at[:, None], at[:, None] - hi))
        #: At least so far it is from a point to the card of the target.
        left = beside(scene.x, target[:, 0], target[:, 2]) + beside(scene.y, target[:, 3], target[:, 5]) + clearance
        self.left = np.concatenate((left, np.zeros((1, len(source)))))
        self.total = np.full(len(source), np.inf)

    def _void(self) -> np.ndarray:
        return np.full(self.left.shape, np.inf)

    def _first(self, way: str) -> np.ndarray:
        at = self._void()
        for side in range(4):
            if SIDES[side] == way:
                at[self.starts[:, side], self.edge] = self.clearance
        at[-1] = np.inf
        return self.scene.runs[way].moved(at)

    def _narrow(self, kept: np.ndarray, front: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Goes on with some of the edges only."""
        for name in ("edge", "starts", "ends", "source_x", "source_y", "target_x", "target_y", "total"):
            setattr(self, name, getattr(self, name)[kept])
        self.left = self.left[:, kept]
        self.cost, self.move = ({w: c[:, kept] for w, c in by.items()} for by in (self.cost, self.move))
        return {w: c[:, kept] for w, c in front.items()}

    def routes(self):
        """(edge, (cost, path)) as soon as they are known."""
        front = {w: self._first(w) for w in "vh"}
        self.cost, self.move, k = {w: c.copy() for w, c in front.items()}, {w: np.isfinite(c).astype(np.int32) for w, c in front.items()}, 1
        while True:
            for w, c in front.items():
                for side in range(4):
                    arrived = c[self.ends[:, side], np.arange(len(self.total))] + self.clearance + (self.turn if w != SIDES[side] else 0.0)
                    np.minimum(self.total, arrived, out=self.total)
            # What costs as much as a whole route already does won't become a better one.
            front = {w: np.where(c + self.left < self.total, c, np.inf) for w, c in front.items()}
            open_ = np.isfinite(front["v"]).any(0) | np.isfinite(front["h"]).any(0)
            if 2 * open_.sum() <= len(open_):
                yield from ((self.edge[e], self._route(e)) for e in np.flatnonzero(~open_ & np.isfinite(self.total)))
                if not open_.any():
                    return
                front = self._narrow(np.flatnonzero(open_), front)
            found = {w: self.scene.runs[w].moved(front["h" if w == "v" else "v"] + self.turn) for w in "vh"}
            k += 1
            for w, c in found.items():
                new = (c + self.left < self.total) & (c + self.scene.least < self.cost[w])
                front[w] = np.where(new, c, np.inf)
                self.cost[w][new], self.move[w][new] = c[new], k

    def _before(self, e: int, way: str, p: int) -> tuple[str, np.ndarray]:
        """The states from which the cheapest moves of edge e to a point along a way come; for a first move, sides of the source."""
        runs, cost, k = self.scene.runs[way], self.cost[way][p, e], self.move[way][p, e]
        if k == 1:
            sides = [s for s in range(4) if SIDES[s] == way and self.starts[e, s] < self.scene.n and runs.of[self.starts[e, s]] == runs.of[p]]
            return "", np.array([s for s in sides if abs(self.clearance + abs(runs.at[self.starts[e, s]] - runs.at[p]) - cost) <= self.scene.near])
        other, q = "h" if way == "v" else "v", runs.points(p)
        same = np.abs(self.cost[other][q, e] + np.abs(runs.at[q] - runs.at[p]) + self.turn - cost) <= self.scene.near
        return other, q[same & (self.move[other][q, e] == k - 1)]

    def _route(self, e: int) -> tuple[float, list[tuple[float, float]]]:
        """The cost and the least path of edge e: followed back over all equal ways, then put together from the source on."""
        last, level = [], {}
        for side in range(4):
            for way in "vh":
                p = int(self.ends[e, side])
                if self.cost[way][p, e] + self.clearance + (self.turn if way != SIDES[side] else 0.0) <= self.total[e] + self.scene.near:
                    last.append((way, p, side))
                    level.setdefault(int(self.move[way][p, e]), {})[way, p] = ()
        for k in range(max(level), 0, -1):
            for state in level.get(k, {}):
                other, before = level[k][state] = self._before(e, *state)
                if other:
                    level.setdefault(k - 1, {}).update(dict.fromkeys((other, int(q)) for q in before))
        paths: dict[tuple[str, int], tuple] = {}
        for k in sorted(level):
            for (way, p), (other, before) in level[k].items():
                at = (float(self.scene.x[p]), float(self.scene.y[p]))
                if other:
                    paths[way, p] = (*min(paths[other, int(q)] for q in before), at)
                else:
                    began = ((int(self.starts[e, s]), (float(self.source_x[e, s]), float(self.source_y[e, s]))) for s in before)
                    paths[way, p] = (*min((port, (float(self.scene.x[q]), float(self.scene.y[q]))) for q, port in began), at)
        path = min((*paths[way, p], (float(self.target_x[e, s]), float(self.target_y[e, s]))) for way, p, s in last)
        return float(self.total[e]), list(path)
