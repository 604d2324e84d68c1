"""Orthogonal routes between cards, for all edges of all scenes at once.

Channels run beside cards (a clearance away) and through their centres, as far as no card's
clearance is in the way; such a free stretch is a run, and runs cross at points. A state of the
search is a point and the way an edge came to it; a move goes to any point of the run across, so
a round adds one bend to all edges. Scenes of up to POINTS points are dealt out with a share of
their edges each, and all rounds of a share go on in one task (``route_search``). In larger ones a
round is one of joins; there edges only look at states that can still be on a route within their
bound, and bounds grow for those that find none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import measured, small_batches, stored
from .route_search import Scene

#: Distances and penalties of a scene.
CLEARANCE, TURN, OVERLAP = 14.0, 24.0, 10.0
#: How much longer than the straight way an edge looks at first, and how its bound grows.
SLACK, GROWTH = 240.0, 4.0
#: Most points of a scene that tasks hold whole, and points times edges of a task's share of it.
POINTS, SHARE = 2**17, 2**24


def _around(boxes: DataFrame, clearance: float) -> DataFrame:
    """Boxes with their clearance, (group, node_id, x0, xm, x1, y0, ym, y1)."""
    mid = lambda lo, size: (F.col(lo) + F.col(size) / 2).cast("double")
    far = lambda lo, size: (F.col(lo) + F.col(size) + clearance).cast("double")
    near = lambda lo: (F.col(lo) - clearance).cast("double")
    return boxes.select("group", "node_id", near("x").alias("x0"), mid("x", "width").alias("xm"), far("x", "width").alias("x1"), near("y").alias("y0"), mid("y", "height").alias("ym"), far("y", "height").alias("y1"))


def _lines(around: DataFrame, way: str) -> DataFrame:
    """(group, i, at): the distinct places of a scene's channels across a way, numbered from 1."""
    at = around.select("group", F.explode(F.array(f"{way}0", f"{way}m", f"{way}1")).alias("at")).distinct()
    return at.withColumn("i", F.row_number().over(Window.partitionBy("group").orderBy("at")))


def _runs(around: DataFrame, lines: DataFrame, others: DataFrame, way: str, across: str) -> DataFrame:
    """(group, i, run, j): the points j on the runs of the lines i across a way; a run is named by its first point."""
    place = lambda df, c, name: df.join(lines.select("group", F.col("at").alias(c), F.col("i").alias(name)), ["group", c])
    cross = lambda df, c, name: df.join(others.select("group", F.col("at").alias(c), F.col("i").alias(name)), ["group", c])
    boxes = cross(cross(place(place(around, f"{way}0", "lo"), f"{way}1", "hi"), f"{across}0", "s"), f"{across}1", "e")
    blocked = boxes.select("group", F.explode(F.sequence(F.col("lo") + 1, F.col("hi") - 1)).alias("i"), "s", "e")
    size = others.groupBy("group").agg(F.max("i").alias("n"))
    ends = lines.join(size, "group").select("group", "i", F.explode(F.array(F.struct(F.lit(-1).alias("s"), F.lit(1).alias("e")), F.struct(F.col("n").alias("s"), F.col("n").alias("e")))).alias("x"))
    before = Window.partitionBy("group", "i").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    gaps = blocked.unionByName(ends.select("group", "i", "x.s", "x.e")).withColumn("run", F.max("e").over(before)).where("run <= s")
    return gaps.select("group", "i", "run", F.explode(F.sequence("run", "s")).alias("j"))


def channel_points(boxes: DataFrame, clearance: float = CLEARANCE) -> DataFrame:
    """(group, xi, yi, x, y, vrun, hrun): where the channels of scenes of boxes (group, node_id, x, y, width, height) cross, outside the clearance of all boxes.

    There are as many as a scene has columns times rows of channels: in proportion to the cards
    where these stand in rows and columns.
    """
    return _points(_around(boxes, clearance))


def _points(around: DataFrame) -> DataFrame:
    xs, ys = _lines(around, "x"), _lines(around, "y")
    v = _runs(around, xs, ys, "x", "y").select("group", F.col("i").alias("xi"), F.col("j").alias("yi"), F.col("run").alias("vrun"))
    h = _runs(around, ys, xs, "y", "x").select("group", F.col("j").alias("xi"), F.col("i").alias("yi"), F.col("run").alias("hrun"))
    at = lambda df, i, name: df.select("group", F.col("i").alias(i), F.col("at").alias(name))
    return v.join(h, ["group", "xi", "yi"]).join(at(xs, "xi", "x"), ["group", "xi"]).join(at(ys, "yi", "y"), ["group", "yi"]).select("group", "xi", "yi", "x", "y", "vrun", "hrun")


def _weighed(points: DataFrame, used: DataFrame | None, overlap: float) -> DataFrame:
    """points with vcum and hcum: what shared stretches cost from a run's first point on. used: (group, way, line, place, n) of stretches that end at a place."""
    if used is None:
        return points.withColumn("vcum", F.lit(0.0)).withColumn("hcum", F.lit(0.0))
    for way, line, place, run, at in (("v", "xi", "yi", "vrun", "y"), ("h", "yi", "xi", "hrun", "x")):
        w = Window.partitionBy("group", line, run).orderBy(place)
        here = used.where(F.col("way") == way).select("group", F.col("line").alias(line), F.col("place").alias(place), "n")
        length = F.coalesce(F.col(at) - F.lag(at).over(w), F.lit(0.0))
        points = points.join(here, ["group", line, place], "left").withColumn(f"{way}cost", length * F.coalesce("n", F.lit(0)) * overlap).drop("n")
        points = points.withColumn(f"{way}cum", F.sum(f"{way}cost").over(w)).drop(f"{way}cost")
    return points


def _ends(edges: DataFrame, around: DataFrame, key: str, clearance: float) -> DataFrame:
    """(edge_id, group, x, y, way, port): the four places where an edge may leave a card, just outside its clearance."""
    side = lambda x, y, way, px, py: F.struct(x.alias("x"), y.alias("y"), F.lit(way).alias("way"), F.struct(px.alias("x"), py.alias("y")).alias("port"))
    c = F.col
    sides = F.array(side(c("x0"), c("ym"), "h", c("x0") + clearance, c("ym")), side(c("x1"), c("ym"), "h", c("x1") - clearance, c("ym")), side(c("xm"), c("y0"), "v", c("xm"), c("y0") + clearance), side(c("xm"), c("y1"), "v", c("xm"), c("y1") - clearance))
    return edges.join(around.withColumnRenamed("node_id", key), ["group", key]).select("edge_id", "group", F.explode(sides).alias("s")).select("edge_id", "group", "s.*")


def _left(x: Column, y: Column) -> Column:
    """At least so far it is to the clearance of the target."""
    beside = lambda v, lo, hi: F.greatest(F.lit(0.0), F.col(lo) - v, v - F.col(hi))
    return beside(x, "tx0", "tx1") + beside(y, "ty0", "ty1")


_STATE = ["edge_id", "xi", "yi", "way"]
_KEPT = ["group", "vrun", "hrun", "x", "y", "vcum", "hcum", "tx0", "tx1", "ty0", "ty1", "bound"]


def _moved(states: DataFrame, points: DataFrame, way: str, turn: float) -> DataFrame:
    """States after a move along the runs of a way through where they are."""
    line, run, place, at, cum = ("xi", "vrun", "yi", "y", "vcum") if way == "v" else ("yi", "hrun", "xi", "x", "hcum")
    to = points.select("group", line, run, F.col(place).alias("to"), *(F.col(c).alias(f"to_{c}") for c in ("x", "y", "vcum", "hcum", "hrun" if way == "v" else "vrun")))
    other = "hrun" if way == "v" else "vrun"
    went = states.join(to, ["group", line, run])
    cost = F.col("cost") + F.abs(F.col(f"to_{at}") - F.col(at)) + F.abs(F.col(f"to_{cum}") - F.col(cum)) + turn
    step = F.struct(F.col("to_x").alias("x"), F.col("to_y").alias("y"))
    return went.select(
        "edge_id", "group", F.col(line), F.col("to").alias(place), F.lit(way).alias("way"), F.col(run), F.col(f"to_{other}").alias(other), F.col("to_x").alias("x"), F.col("to_y").alias("y"),
        F.col("to_vcum").alias("vcum"), F.col("to_hcum").alias("hcum"), "tx0", "tx1", "ty0", "ty1", "bound", cost.alias("cost"), F.concat("path", F.array(step)).alias("path"),
    )


def _search(starts: DataFrame, ends: DataFrame, points: DataFrame, clearance: float, turn: float) -> tuple[DataFrame, DataFrame]:
    """(best states at the ends, with the total of their routes; edge_ids that would have looked beyond their bound)."""

    def least(found: DataFrame, known: DataFrame | None) -> tuple[DataFrame, int]:
        """Each state's best way where it is better than what is known, or, as one row for an edge, that some are beyond its bound."""
        best = found.groupBy(*_STATE).agg(F.min(F.struct("cost", "path", *_KEPT)).alias("s")).select(*_STATE, "s.*")
        within = F.col("cost") + _left(F.col("x"), F.col("y")) <= F.col("bound")
        kept = best.where(within)
        if known is not None:
            kept = kept.join(known.select(*_STATE, F.col("cost").alias("had")), _STATE, "left").where("had is null or cost + 1e-9 < had").drop("had")
        beyond = best.where(~within).select("edge_id").distinct()
        rows, seen = measured(kept.unionByName(beyond, allowMissingColumns=True), "routes-front", n=F.count("cost"))
        return rows, seen["n"]

    def reached(found: DataFrame) -> DataFrame:
        """(edge_id, total, end): what edges cost by way of the states in which they arrive."""
        return found.join(ends, ["edge_id", "xi", "yi"]).withColumn("total", F.col("cost") + clearance + F.when(F.col("way") != F.col("end_way"), turn).otherwise(0.0))

    first = _moved(starts.where("way = 'v'"), points, "v", 0.0).unionByName(_moved(starts.where("way = 'h'"), points, "h", 0.0))
    front, n = least(first, None)
    known, cut, least_total = front.where("cost is not null"), front.where("cost is null").select("edge_id"), None
    while n:
        totals = reached(front.where("cost is not null")).select("edge_id", "total")
        least_total = stored((totals if least_total is None else totals.unionByName(least_total)).groupBy("edge_id").agg(F.min("total").alias("total")), "routes-total")
        # What costs as much as a whole route already does won't become a better one.
        worth = F.col("total").isNull() | (F.col("cost") + _left(F.col("x"), F.col("y")) + clearance < F.col("total"))
        live = front.where("cost is not null").join(least_total, "edge_id", "left").where(worth).drop("total")
        found = _moved(live.where("way = 'h'"), points, "v", turn).unionByName(_moved(live.where("way = 'v'"), points, "h", turn))
        front, n = least(found.join(least_total, "edge_id", "left").where(worth).drop("total"), known)
        better = front.where("cost is not null")
        if n:
            known = stored(known.join(better.select(*_STATE), _STATE, "left_anti").unionByName(better), "routes-known")
        cut = cut.unionByName(front.where("cost is null").select("edge_id"))
    return reached(known), cut.distinct()


def _bends(routes: DataFrame) -> DataFrame:
    """Routes (path) as points: without places where they stand still or go straight on."""
    p = lambda c, i: F.element_at(c, i + 1)
    moving = routes.withColumn("path", F.filter("path", lambda q, i: (i == 0) | (F.element_at("path", F.greatest(i, F.lit(1))) != q)))
    last = F.size("path") - 1
    straight = lambda i: ((p("path", i - 1)["x"] == p("path", i)["x"]) & (p("path", i)["x"] == p("path", i + 1)["x"])) | ((p("path", i - 1)["y"] == p("path", i)["y"]) & (p("path", i)["y"] == p("path", i + 1)["y"]))
    return moving.withColumn("points", F.filter("path", lambda q, i: (i == 0) | (i == last) | ~F.coalesce(F.when((i > 0) & (i < last), straight(i)), F.lit(False)))).drop("path")


def _routed(edges: DataFrame, around: DataFrame, points: DataFrame, clearance: float, turn: float) -> DataFrame:
    """(edge_id, group, cost, points) of the cheapest routes; edges without any are not in it."""
    at = points.select("group", "x", "y", "xi", "yi", "vrun", "hrun", "vcum", "hcum")
    box = around.select("group", F.col("node_id").alias("target_id"), F.col("x0").alias("tx0"), F.col("x1").alias("tx1"), F.col("y0").alias("ty0"), F.col("y1").alias("ty1"))
    starts = _ends(edges, around, "source_id", clearance).join(at, ["group", "x", "y"]).join(edges.join(box, ["group", "target_id"]).select("edge_id", "tx0", "tx1", "ty0", "ty1"), "edge_id")
    starts = stored(starts.withColumn("cost", F.lit(clearance)).withColumn("path", F.array("port", F.struct("x", "y"))).withColumn("straight", F.min(F.col("cost") + _left(F.col("x"), F.col("y"))).over(Window.partitionBy("edge_id"))), "routes-starts")
    ends = stored(_ends(edges, around, "target_id", clearance).join(at, ["group", "x", "y"]).select("edge_id", "xi", "yi", F.col("way").alias("end_way"), "port"), "routes-ends")
    slack, out = SLACK, None
    while True:
        there, cut = _search(starts.withColumn("bound", F.col("straight") + slack), ends, points, clearance, turn)
        best = there.groupBy("edge_id").agg(F.min(F.struct("total", F.concat("path", F.array("port")).alias("path"), "group", "bound")).alias("r")).select("edge_id", "r.*")
        best = best.join(cut.withColumn("cut", F.lit(True)), "edge_id", "left").withColumn("sure", F.col("cut").isNull() | (F.col("total") <= F.col("bound")))
        best = stored(_bends(best.where("sure").select("edge_id", "group", F.col("total").alias("cost"), "path")), "routes-found")
        out = best if out is None else out.unionByName(best)
        starts, seen = measured(starts.join(cut, "edge_id", "left_semi").join(best.select("edge_id"), "edge_id", "left_anti"), "routes-starts", n=F.count(F.lit(1)))
        if not seen["n"]:
            return out
        slack *= GROWTH


def _searched(clearance: float, turn: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task from rows (group, edges, channels), a share of a scene's edges and all its points, to (edge_id, group, cost, path)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges, channels = batch.column("edges"), batch.column("channels")
            ids, boxes = edges.values.field("edge_id"), [edges.values.field(c).values.to_numpy(zero_copy_only=False).reshape(-1, 6) for c in ("source", "target")]
            points = [channels.values.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "vrun", "hrun", "vcum", "hcum")]
            of, out = [], []
            for row in range(batch.num_rows):
                (a, b), (p, q) = ([o[row].as_py(), o[row + 1].as_py()] for o in (edges.offsets, channels.offsets))
                best: dict = {}  # a card that is there twice has twice as many sides
                for e, cost, path in Scene(*(c[p:q] for c in points)).routes(*(c[a:b] for c in boxes), clearance, turn):
                    name = ids[a + int(e)].as_py()
                    best[name] = min(best.get(name, (cost, path)), (cost, path))
                of += [row] * len(best)
                out += best.items()
            step = pa.struct([("x", pa.float64()), ("y", pa.float64())])
            paths = pa.array([[{"x": x, "y": y} for x, y in path] for _, (_, path) in out], pa.list_(step))
            columns = [pa.array([name for name, _ in out], ids.type), batch.column("group").take(pa.array(of, pa.int64())), pa.array([cost for _, (cost, _) in out], pa.float64()), paths]
            yield pa.RecordBatch.from_arrays(columns, names=["edge_id", "group", "cost", "path"])

    return task


def _routed_whole(edges: DataFrame, around: DataFrame, points: DataFrame, clearance: float, turn: float) -> DataFrame:
    """The same as of ``_routed``, for scenes of which a task can hold all points."""
    spark, count = edges.sparkSession, F.count(F.lit(1))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    box = lambda key, name: around.select("group", F.col("node_id").alias(key), F.array("x0", "xm", "x1", "y0", "ym", "y1").alias(name))
    known = edges.join(box("source_id", "source"), ["group", "source_id"]).join(box("target_id", "target"), ["group", "target_id"])
    shares = known.groupBy("group").agg(count.alias("e")).join(points.groupBy("group").agg(count.alias("p")), "group").select("group", F.ceil(F.col("e") * F.col("p") / SHARE).cast("long").alias("shares"))
    asked = known.join(shares, "group").select("group", F.pmod(F.xxhash64("edge_id"), "shares").alias("share"), F.struct("edge_id", "source", "target").alias("e"))
    asked = asked.repartition(parts, "group", "share").groupBy("group", "share").agg(F.collect_list("e").alias("edges"))
    scenes = points.groupBy("group").agg(F.collect_list(F.struct("x", "y", "vrun", "hrun", "vcum", "hcum")).alias("channels")).join(shares, "group")
    scenes = scenes.select("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), "channels").repartition(parts, "group", "share")
    kind = dict(edges.dtypes)
    found = asked.join(scenes, ["group", "share"]).select("group", "edges", "channels").mapInArrow(_searched(clearance, turn), f"edge_id {kind['edge_id']}, group {kind['group']}, cost double, path array<struct<x: double, y: double>>")
    with small_batches(spark):
        return stored(_bends(found), "routes-found")


def stretches(routes: DataFrame, points: DataFrame) -> DataFrame:
    """(edge_id, group, way, line, place): the stretches of runs between neighbouring crossings that routes take, each by where it ends; the ways out of cards are none."""
    seg = routes.select("edge_id", "group", F.explode(F.arrays_zip(F.slice("points", 1, F.size("points") - 1).alias("p"), F.slice("points", 2, F.size("points") - 1).alias("q"))).alias("s"))
    seg = seg.select("edge_id", "group", F.least("s.p.x", "s.q.x").alias("xa"), F.greatest("s.p.x", "s.q.x").alias("xb"), F.least("s.p.y", "s.q.y").alias("ya"), F.greatest("s.p.y", "s.q.y").alias("yb"))
    before = lambda at, line, run, i: points.withColumn("from", F.lag(at).over(Window.partitionBy("group", line, run).orderBy(i)))
    v = before("y", "xi", "vrun", "yi").join(seg.where("xa = xb").withColumnRenamed("xa", "x"), ["group", "x"]).where("from >= ya and y <= yb").select("edge_id", "group", F.lit("v").alias("way"), F.col("xi").alias("line"), F.col("yi").alias("place"))
    h = before("x", "yi", "hrun", "xi").join(seg.where("ya = yb and xa < xb").withColumnRenamed("ya", "y"), ["group", "y"]).where("from >= xa and x <= xb").select("edge_id", "group", F.lit("h").alias("way"), F.col("yi").alias("line"), F.col("xi").alias("place"))
    return v.unionByName(h)


def orthogonal_routes(boxes: DataFrame, edges: DataFrame, passes: int = 2, clearance: float = CLEARANCE, turn: float = TURN, overlap: float = OVERLAP, whole: int = POINTS) -> DataFrame:
    """(group, edge_id, status, cost, points): edges (group, edge_id, source_id, target_id, place) routed around boxes (group, node_id, x, y, width, height).

    points go from a side's middle of the source to one of the target with right angles only, a
    clearance away from every card. cost is the length, and turn for each bend, the least there
    is over all ways and sides. In the first pass edges don't see each other. An edge keeps its
    route if on each stretch it is the first by place (then edge_id) of those that take it; the
    others are routed again, with overlap for each unit of length beside each kept edge, and so
    on for so many passes. status is routed, or failed where no way leads out of the cards'
    clearances; edges of which an end has no box, and loops, are failed too. No edges give no rows.
    Scenes of up to ``whole`` points are searched by tasks that hold all of them, larger ones by rounds of joins, with the same routes.
    """
    around = stored(_around(boxes, clearance), "boxes")
    points = stored(_points(around), "channels")
    large, sized = measured(points.groupBy("group").agg(F.count(F.lit(1)).alias("points")).where(F.col("points") > whole).select("group"), "large", n=F.count(F.lit(1)))

    def routed(edges: DataFrame, points: DataFrame) -> DataFrame:
        if not sized["n"]:
            return _routed_whole(edges, around, points, clearance, turn)
        small, rest = ([df.join(large, "group", how) for df in (edges, points)] for how in ("left_anti", "left_semi"))
        return _routed_whole(small[0], around, small[1], clearance, turn).unionByName(_routed(rest[0], around, stored(rest[1], "channels"), clearance, turn))

    edges = stored(edges.select("group", "edge_id", "source_id", "target_id", "place"), "edges")
    rest, done, used = edges.where("source_id <> target_id"), None, None
    for k in range(1, passes + 1):
        here = points if used is None else points.join(rest.select("group").distinct(), "group", "left_semi")
        found = routed(rest, stored(_weighed(here, used, overlap), "channels"))
        if k == passes:
            done = found if done is None else done.unionByName(found)
            break
        taken = stretches(found, points)
        order = rest.select("edge_id", F.struct("place", "edge_id").alias("rank"))
        ranked = taken.join(order, "edge_id")
        ahead = ranked.groupBy("group", "way", "line", "place").agg(F.min("rank").alias("first"))
        behind = ranked.join(ahead, ["group", "way", "line", "place"]).where("rank <> first").select("edge_id").distinct()
        behind = stored(behind, "routes-behind")
        kept = stored(found.join(behind, "edge_id", "left_anti"), "routes-kept")
        done = kept if done is None else done.unionByName(kept)
        rest, seen = measured(rest.join(behind, "edge_id", "left_semi"), "edges", n=F.count(F.lit(1)))
        if not seen["n"]:
            break
        used = stretches(done, points).groupBy("group", "way", "line", "place").agg(F.count(F.lit(1)).alias("n"))
    return edges.select("group", "edge_id").join(done.drop("group"), "edge_id", "left").select("group", "edge_id", F.when(F.col("cost").isNull(), "failed").otherwise("routed").alias("status"), "cost", "points")
