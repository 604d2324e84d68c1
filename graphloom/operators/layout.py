"""Positions of cards and the geometry rules that are joins over boxes."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..storage import stored
from . import graph, hierarchy, scans


def grid(nodes: DataFrame, width: float = 180.0, height: float = 64.0, gap: float = 40.0, aspect: float = 1.6) -> DataFrame:
    """(group, node_id, x, y, width, height): nodes (group, node_id, ord) of each group in rows of ceil(sqrt(n * aspect))."""
    rows = scans.running(nodes.select("group", "node_id", "ord"), ["group"], ["ord", "node_id"]).withColumn("i", F.col("idx") - 1)
    rows = rows.withColumn("columns", F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("n") * aspect))).cast("int"))
    return rows.select("group", "node_id", ((F.col("i") % F.col("columns")) * (width + gap)).alias("x"), (F.floor(F.col("i") / F.col("columns")) * (height + gap)).alias("y"), F.lit(width).alias("width"), F.lit(height).alias("height"))


def columns(nodes: DataFrame) -> DataFrame:
    """nodes (group, node_id, ord) with rank: three columns in turn."""
    rows = scans.running(nodes.select("group", "node_id", "ord"), ["group"], ["ord", "node_id"]).withColumn("i", F.col("idx") - 1)
    return rows.select("group", "node_id", (F.col("i") % F.least(F.lit(3), F.col("n"))).alias("rank"))


def shelves(units: DataFrame, shelf_width: float | None = None, gap: float = 40.0, aspect: float = 1.6) -> DataFrame:
    """units (group, unit_id, ord, width, height) with x, y: left to right in the order of ord, a new shelf where one doesn't fit.

    Without a width each group has its own: of the widest unit and of the width at which all
    units, with their gaps, would fill a page of the aspect, the greater. How far a shelf from
    each unit on would go follows from running totals; which units begin one, from doubling; so
    groups may be of any size. A unit wider than the shelf has one of its own.
    """
    units = units.select("group", "unit_id", "ord", F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"))
    if shelf_width is None:
        page = F.sqrt(F.greatest(F.lit(1.0), F.sum((F.col("width") + gap) * (F.col("height") + gap))) * aspect)
        units = units.join(units.groupBy("group").agg(F.greatest(F.max("width"), page).alias("shelf")), "group")
    else:
        units = units.withColumn("shelf", F.lit(float(shelf_width)))
    # Widths in shelves, so that one width serves all groups.
    share = (F.col("width") + gap) / (F.col("shelf") + gap)
    exact = shelf_width is not None
    rows = stored(scans.running(units, ["group"], ["ord", "unit_id"], total=(F.col("width") + gap) if exact else share), "units")
    starts = scans.greedy_starts(scans.last_within(rows, float(shelf_width) + gap if exact else 1.0)).withColumn("begins", F.lit(1))
    shelved = scans.running(rows.drop("n", "total").withColumnRenamed("idx", "place").join(starts.withColumnRenamed("idx", "place"), ["group", "place"], "left"), ["group"], ["place"], shelf_no=F.col("begins"), right=F.col("width") + gap)
    shelved = stored(shelved.drop("n", "idx"), "shelved")
    each = shelved.groupBy("group", "shelf_no").agg(F.min(F.col("right") - F.col("width") - gap).alias("left"), F.max("height").alias("tall"))
    down = scans.running(each, ["group"], ["shelf_no"], below=F.col("tall") + gap).select("group", "shelf_no", "left", (F.col("below") - F.col("tall") - gap).alias("y"))
    return shelved.join(down, ["group", "shelf_no"]).select("group", "unit_id", (F.col("right") - F.col("width") - gap - F.col("left")).alias("x"), "y", "width", "height")


def overlaps(boxes: DataFrame, cell: float = 512.0, tolerance: float = 1.0) -> DataFrame:
    """(group, a, b): pairs of boxes (group, node_id, x, y, width, height) of a group that overlap by more than the tolerance.

    Boxes meet in the grid cells that they touch, so no box is held against all others. A pair
    counts in the cell where its common area begins, so it is found once, however many cells it
    shares; only pairs of ids that have several boxes are compared with each other. Cells are dealt over
    all partitions, as few bytes of boxes come to many pairs.
    """
    span = lambda lo, size: F.sequence(F.floor(F.col(lo) / cell), F.floor((F.col(lo) + F.col(size)) / cell))
    counted = boxes.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("group", "node_id")))
    touched = counted.withColumn("cx", F.explode(span("x", "width"))).withColumn("cy", F.explode(span("y", "height")))
    parts = max(1, int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cells = lambda which: touched.where(which).repartition(parts, "group", "cx", "cy")
    hit = lambda lo, size: (F.col(f"a.{lo}") + tolerance < F.col(f"b.{lo}") + F.col(f"b.{size}")) & (F.col(f"b.{lo}") + tolerance < F.col(f"a.{lo}") + F.col(f"a.{size}"))
    begins = lambda lo, at: F.floor(F.greatest(F.col(f"a.{lo}"), F.col(f"b.{lo}")) / cell) == F.col(f"a.{at}")
    same = reduce(and_, (F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("group", "cx", "cy")))
    over = same & (F.col("a.node_id") < F.col("b.node_id")) & hit("x", "width") & hit("y", "height") & begins("x", "cx") & begins("y", "cy")

    def met(one: str, two: str) -> DataFrame:
        # Merged, as a join by broadcast has as few tasks as the boxes have files.
        pairs = cells(one).alias("a").join(cells(two).alias("b").hint("merge"), over)
        return pairs.select(F.col("a.group").alias("group"), F.col("a.node_id").alias("a"), F.col("b.node_id").alias("b"))

    return met("n = 1", "n = 1").unionByName(met("n > 1", "n > 0").unionByName(met("n = 1", "n > 1")).distinct())


def ports(ends: DataFrame) -> DataFrame:
    """ends (card, side, edge_id, opposite) with fraction: edges of a side of a card in the order of their opposite ends, evenly spread."""
    w = Window.partitionBy("card", "side")
    rank = F.row_number().over(w.orderBy("opposite", "edge_id"))
    return ends.withColumn("fraction", rank / (F.count(F.lit(1)).over(w) + 1))


def close_ports(ports_: DataFrame, length: float, least: float = 12.0) -> DataFrame:
    """(card, side, edge_id) of ports nearer than ``least`` to the one before."""
    w = Window.partitionBy("card", "side").orderBy("fraction", "edge_id")
    return ports_.withColumn("d", (F.col("fraction") - F.lag("fraction").over(w)) * length).where(F.col("d") < least).select("card", "side", "edge_id")


def fits_budget(nodes: int, edges: int, largest_nodes: int, largest_edges: int) -> bool:
    """Whether a scene may be laid out in full: small as a whole, or made of small components."""
    small = nodes < 300 and edges <= 160 and nodes * edges <= 12_000
    return small or (nodes <= 1000 and edges <= 2000 and largest_nodes <= 12 and largest_edges <= 24)


def widest_column(boxes: DataFrame) -> DataFrame:
    """(group, ratio): share of a group's boxes in its fullest column."""
    count = boxes.groupBy("group", F.round("x", 3).alias("x")).agg(F.count(F.lit(1)).alias("k"))
    return count.groupBy("group").agg((F.max("k") / F.sum("k")).alias("ratio"))


def percentile(values: DataFrame, group: str, value: str, fraction: float) -> DataFrame:
    """(group, value): the nearest-rank percentile of each group, to three decimals: of n values the ceil(n * fraction)-th, the first at least.

    Equal values are counted first, and their running totals come of a scan over ranges, so a group may hold all rows.
    """
    counted = values.groupBy(F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    ranked = scans.running(counted, ["g"], ["v"], upto=F.col("k"))
    whole = values.groupBy(F.col(group).alias("h")).agg(F.count(F.lit(1)).alias("all"))  # a row for each group
    at = F.greatest(F.lit(1), F.least(F.col("all"), F.ceil(F.col("all") * fraction)))
    found = ranked.join(whole, F.col("g").eqNullSafe(F.col("h"))).where((F.col("upto") >= at) & (F.col("upto") - F.col("k") < at))
    return found.select(F.col("g").alias(group), F.round("v", 3).alias(value))


def route_order(edges: DataFrame) -> DataFrame:
    """edges (group, view_id, relation_type, relation_family) with place: which is routed first in its group: by kind, resolved ones first, then by name."""
    # Fixed values.
    rank = {"contains": 0, "explains": 1, "prerequisite": 2, "progressive": 2, "derives_to": 3}
    kind = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in rank.items() for x in kv)), F.col("relation_type")), F.lit(2))
    w = Window.partitionBy("group").orderBy(kind, (F.col("relation_family") == "unresolved").cast("int"), "view_id")
    return edges.withColumn("place", F.row_number().over(w) - 1)


def edge_classes(edges: DataFrame, scopes: DataFrame, parents: DataFrame) -> DataFrame:
    """edges (edge_id, relation_family, relation_type, source_id, target_id) with layout_scope and class.

    class: unresolved_semantics; for symmetric relations symmetry_conflict if a directional one
    joins the same ends, else same_rank; semantic_cycle inside a cycle of directional relations of
    one scope; rank_enforced within a scope; cross_scope if the ends' scopes (node_id, scope_id)
    meet in a forest (child, parent); else order_conflict.
    """
    end = lambda side: scopes.select(F.col("node_id").alias(f"{side}_id"), F.col("scope_id").alias(f"{side}_scope"))
    rows = edges.withColumn("way", T.directionality(F.col("relation_type"))).join(end("source"), "source_id", "left").join(end("target"), "target_id", "left")
    rows = rows.withColumn("lo", F.least("source_id", "target_id")).withColumn("hi", F.greatest("source_id", "target_id"))
    same = F.coalesce(F.col("source_scope") == F.col("target_scope"), F.lit(False))
    directed = rows.where("way = 'directional'")
    local = directed.where(same).select(F.concat_ws("\u001f", "source_scope", "source_id").alias("a"), F.concat_ws("\u001f", "source_scope", "target_id").alias("b"))
    scc = graph.strong_components(local.select(F.col("a").alias("node_id")).union(local.select("b")).distinct(), local)
    ring = lambda side: scc.select(F.col("node_id").alias(f"{side}_key"), F.col("scc").alias(f"{side}_scc"))
    rows = rows.withColumn("source_key", F.concat_ws("\u001f", "source_scope", "source_id")).withColumn("target_key", F.concat_ws("\u001f", "source_scope", "target_id")).join(ring("source"), "source_key", "left").join(ring("target"), "target_key", "left")
    rows = rows.join(directed.select("lo", "hi", F.lit(True).alias("conflict")).distinct(), ["lo", "hi"], "left")
    meet = hierarchy.lowest_common(rows.where("source_scope is not null and target_scope is not null").select(F.col("source_scope").alias("a"), F.col("target_scope").alias("b")).distinct(), parents)
    rows = rows.join(meet.select(F.col("a").alias("source_scope"), F.col("b").alias("target_scope"), F.col("lca").alias("layout_scope")), ["source_scope", "target_scope"], "left")
    cyclic = same & (F.col("way") == "directional") & F.coalesce(F.col("source_scc") == F.col("target_scc"), F.lit(False))
    found = (
        F.when(F.col("relation_family") == "unresolved", "unresolved_semantics").when((F.col("way") == "symmetric") & F.coalesce("conflict", F.lit(False)), "symmetry_conflict").when(F.col("way") == "symmetric", "same_rank")
        .when(cyclic, "semantic_cycle").when(same, "rank_enforced").when(F.col("layout_scope").isNotNull(), "cross_scope").otherwise("order_conflict")
    )
    return rows.select(*edges.columns, "layout_scope", found.alias("class"))


def route_issues(edges: DataFrame, boxes: DataFrame, routes: DataFrame) -> DataFrame:
    """(code, object_id): edges (edge_id, source_id, target_id) whose ends have no box (node_id), and those that have but for which no route (edge_id, status) was found."""
    known = boxes.select("node_id").distinct()
    ends = edges.select("edge_id", F.explode(F.array("source_id", "target_id")).alias("node_id"))
    lost = ends.join(known, "node_id", "left_anti").select("edge_id").distinct()
    failed = edges.join(lost, "edge_id", "left_anti").join(routes.where("status = 'routed'"), "edge_id", "left_anti")
    return lost.select(F.lit("edge_route_missing_endpoint").alias("code"), F.col("edge_id").alias("object_id")).unionByName(failed.select(F.lit("edge_route_failed").alias("code"), F.col("edge_id").alias("object_id")))


def nesting_issues(children: DataFrame, boxes: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """(code, object_id): children (child, parent) without a box (node_id, x, y, width, height), or whose box leaves their parent's."""
    b = lambda key, p: boxes.select(F.col("node_id").alias(key), *(F.col(c).alias(f"{p}_{c}") for c in ("x", "y", "width", "height")))
    missing = children.join(boxes.select(F.col("node_id").alias("child")), "child", "left_anti").select(F.lit("layout_coordinate_missing").alias("code"), F.col("child").alias("object_id"))
    both = children.join(b("child", "c"), "child").join(b("parent", "p"), "parent")
    outside = (F.col("c_x") < F.col("p_x") - tolerance) | (F.col("c_y") < F.col("p_y") - tolerance) | (F.col("c_x") + F.col("c_width") > F.col("p_x") + F.col("p_width") + tolerance) | (F.col("c_y") + F.col("c_height") > F.col("p_y") + F.col("p_height") + tolerance)
    return missing.unionByName(both.where(outside).select(F.lit("geometry_child_out_of_bounds").alias("code"), F.col("child").alias("object_id")))


def arrow_occlusions(arrows: DataFrame, boxes: DataFrame, cell: float = 512.0) -> DataFrame:
    """(edge_id, node_id): arrow boxes (group, edge_id, x, y, width, height) that lie over a card. They meet in grid cells."""
    a = arrows.select("group", F.concat(F.lit("edge:"), "edge_id").alias("node_id"), "x", "y", "width", "height")
    b = boxes.select("group", F.concat(F.lit("node:"), "node_id").alias("node_id"), "x", "y", "width", "height")
    met = overlaps(a.unionByName(b), cell, 0.0).where(F.col("a").startswith("edge:") & F.col("b").startswith("node:"))
    return met.select(F.substring("a", 6, 1 << 30).alias("edge_id"), F.substring("b", 6, 1 << 30).alias("node_id")).distinct()
