"""Readability of a scene: cards, routes as segments, labels, ports and frames, each rule a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import layout
from .rules import issue, report

STUB, PORT_GAP = 24.0, 12.0


def segments(routes: DataFrame) -> DataFrame:
    """(group, edge_id, n, nth, x1, y1, x2, y2) of routes (group, edge_id, points array<struct<x,y>>)."""
    p = routes.withColumn("n", F.size("points") - 1).where("n >= 1").select("group", "edge_id", "n", "points", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("nth"))
    at = lambda i, c: F.element_at("points", i)[c]
    return p.select("group", "edge_id", "n", "nth", at(F.col("nth"), "x").alias("x1"), at(F.col("nth"), "y").alias("y1"), at(F.col("nth") + 1, "x").alias("x2"), at(F.col("nth") + 1, "y").alias("y2"))


def _boxes(df: DataFrame, ident: Column) -> DataFrame:
    """Boxes of axis-parallel segments."""
    return df.withColumns({"node_id": ident, "x": F.least("x1", "x2"), "y": F.least("y1", "y2"), "width": F.abs(F.col("x2") - F.col("x1")), "height": F.abs(F.col("y2") - F.col("y1"))})


def meets(a: DataFrame, b: DataFrame, cell: float = 512.0) -> DataFrame:
    """Pairs of boxes of two tables (group, node_id, x, y, width, height) that touch, by the grid cells that they share; columns of b get the prefix o_."""
    span = lambda lo, size: F.sequence(F.floor(F.col(lo) / cell), F.floor((F.col(lo) + F.col(size)) / cell))
    cells = lambda df: df.withColumn("cx", F.explode(span("x", "width"))).withColumn("cy", F.explode(span("y", "height")))
    other = cells(b)
    other = other.select(*(F.col(c).alias(c if c in ("group", "cx", "cy") else f"o_{c}") for c in other.columns))
    both = cells(a).join(other, ["group", "cx", "cy"])
    near = lambda lo, size: (F.col(lo) <= F.col(f"o_{lo}") + F.col(f"o_{size}")) & (F.col(f"o_{lo}") <= F.col(lo) + F.col(size))
    return both.where(near("x", "width") & near("y", "height")).drop("cx", "cy").distinct()


def crossings(segs: DataFrame) -> DataFrame:
    """(group, a, b) pairs of edges of which a horizontal and a vertical segment cross inside."""
    ident = F.concat_ws("#", "edge_id", "nth")
    h, v = _boxes(segs.where("y1 = y2 and x1 <> x2"), ident), _boxes(segs.where("x1 = x2 and y1 <> y2"), ident)
    m = meets(h, v).where((F.col("edge_id") != F.col("o_edge_id")) & (F.col("o_x") > F.col("x")) & (F.col("o_x") < F.col("x") + F.col("width")) & (F.col("y") > F.col("o_y")) & (F.col("y") < F.col("o_y") + F.col("o_height")))
    return m.select("group", F.least("edge_id", "o_edge_id").alias("a"), F.greatest("edge_id", "o_edge_id").alias("b"))


def shared_runs(segs: DataFrame, allowed: float = 0.0) -> DataFrame:
    """(group, a, b) pairs of edges that run on one line for longer than is allowed: an equi-join on the line."""
    flat = segs.select("group", "edge_id", F.when(F.col("y1") == F.col("y2"), "h").when(F.col("x1") == F.col("x2"), "v").alias("way"), F.when(F.col("y1") == F.col("y2"), F.col("y1")).otherwise(F.col("x1")).alias("line"), F.when(F.col("y1") == F.col("y2"), F.least("x1", "x2")).otherwise(F.least("y1", "y2")).alias("lo"), F.when(F.col("y1") == F.col("y2"), F.greatest("x1", "x2")).otherwise(F.greatest("y1", "y2")).alias("hi")).where("way is not null")
    other = flat.select("group", "way", "line", F.col("edge_id").alias("b"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    both = flat.join(other, ["group", "way", "line"]).where((F.col("edge_id") < F.col("b")) & (F.least("hi", "hi2") - F.greatest("lo", "lo2") > allowed))
    return both.select("group", F.col("edge_id").alias("a"), "b").distinct()


def readability(cards: DataFrame, routes: DataFrame, labels: DataFrame, ports: DataFrame, frames: DataFrame) -> DataFrame:
    """(code, severity, object_id) of a scene.

    cards, labels and frames: (group, node_id, x, y, width, height); frames have their members'
    frame in frame_id of cards. routes: (group, edge_id, source_id, target_id, status, points);
    ports: (card, side, edge_id, fraction, length).
    """
    segs = segments(routes).join(routes.select("edge_id", "source_id", "target_id"), "edge_id")
    pair = lambda df: F.concat_ws("|", "a", "b")
    length = F.abs(F.col("x2") - F.col("x1")) + F.abs(F.col("y2") - F.col("y1"))
    hit = meets(_boxes(segs, F.concat_ws("#", "edge_id", "nth")), cards.select("group", "node_id", F.col("x") + 1, F.col("y") + 1, F.col("width") - 2, F.col("height") - 2).toDF("group", "node_id", "x", "y", "width", "height"))
    stub = ((F.col("nth") == 1) & (F.col("o_node_id") == F.col("source_id"))) | ((F.col("nth") == F.col("n")) & (F.col("o_node_id") == F.col("target_id")))
    clash = meets(labels, cards).select(F.concat_ws("|", "node_id", "o_node_id").alias("id"))
    out = cards.join(frames.select(F.col("node_id").alias("frame_id"), *(F.col(c).alias(f"f_{c}") for c in ("x", "y", "width", "height"))), "frame_id")
    inside = (F.col("x") >= F.col("f_x")) & (F.col("y") >= F.col("f_y")) & (F.col("x") + F.col("width") <= F.col("f_x") + F.col("f_width")) & (F.col("y") + F.col("height") <= F.col("f_y") + F.col("f_height"))
    diagonal = (F.col("x1") != F.col("x2")) & (F.col("y1") != F.col("y2"))
    shape = lambda df: df.select("group", "node_id", "x", "y", "width", "height")
    return report(
        issue(layout.overlaps(shape(cards)).select(pair(None).alias("id")), "node_overlap", "id"), issue(routes.where("status <> 'routed'"), "failed_edges", "edge_id"),
        issue(hit.where(~stub).select("edge_id").distinct(), "edge_node_intrusion", "edge_id"), issue(segs.where(((F.col("nth") == 1) | (F.col("nth") == F.col("n"))) & diagonal).select("edge_id").distinct(), "terminal_direction_violation", "edge_id"),
        issue(segs.where(((F.col("nth") == 1) | (F.col("nth") == F.col("n"))) & (F.col("n") > 1) & (length < STUB)).select("edge_id").distinct(), "terminal_stub_short", "edge_id"),
        issue(shared_runs(segs).select(pair(None).alias("id")), "ambiguous_overlap", "id"), issue(crossings(segs).select(pair(None).alias("id")), "edge_crossing", "id", "warning"),
        issue(clash, "label_overlap", "id"), issue(layout.overlaps(shape(labels)).select(pair(None).alias("id")), "label_overlap", "id"),
        issue(layout.close_ports(ports, PORT_GAP * 10).select(F.concat_ws("|", "card", "side", "edge_id").alias("id")), "port_spacing_violation", "id"),
        issue(layout.overlaps(shape(frames)).select(pair(None).alias("id")), "group_overlap", "id"), issue(out.where(~inside).select("frame_id").distinct(), "group_overflow", "frame_id"),
    )
