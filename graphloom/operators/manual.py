"""Positions that a reviewer gives to cards, and rules that a finished geometry keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import measured, stored
from . import layout

#: Boxes may lie over each other, or leave a frame, by as much.
BORDER_TOLERANCE = 1.0
BOX = ("x", "y", "width", "height")


def _within(inner: str, outer: str, tolerance: float) -> Column:
    """Whether the box of columns inner_x, ... lies in that of outer_x, ...; unknown if one is missing."""
    i, o = ({c: F.col(f"{p}_{c}") for c in BOX} for p in (inner, outer))
    ends = lambda lo, size: (i[lo] >= o[lo] - tolerance) & (i[lo] + i[size] <= o[lo] + o[size] + tolerance)
    return ends("x", "width") & ends("y", "height")


def _boxes(df: DataFrame, key: str, to: str, prefix: str) -> DataFrame:
    return df.select(F.col(key).alias(to), *(F.col(c).alias(f"{prefix}_{c}") for c in BOX))


def manual_places(cards: DataFrame, overrides: DataFrame, frames: DataFrame | None = None, tolerance: float = BORDER_TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """(cards at their new places, issues (code, group, object_id)) of cards (group, node_id, x, y, width, height) and overrides (group, node_id, x, y).

    Overrides of a group are taken in the order of node_id. One that is no number is
    manual_position_invalid; one that leaves its group's frame (group, x, y, width, height), or
    whose group has none, manual_position_out_of_scope (without ``frames``, as in scenes that have
    no scopes, this isn't asked); one that overlaps another card of the group, as cards stand at
    that moment, manual_position_overlap. These cards keep their places, the others move.
    Overrides of unknown cards count for nothing; of several for one card the smallest counts.

    Whom a card could meet is found once, in grid cells. What then depends on earlier overrides is
    settled for all groups in common rounds: an override is decided once all earlier ones that
    it could meet are, so rounds are as many as the longest chain of overrides in each other's way.
    """
    number = lambda c: F.col(c).cast("string").try_cast("double")
    given = overrides.groupBy("group", "node_id").agg(F.min(F.struct(number("x").alias("x"), number("y").alias("y"))).alias("to"))
    asked = cards.select("group", "node_id", "width", "height").join(given, ["group", "node_id"]).select("group", "node_id", F.col("to.x").alias("x"), F.col("to.y").alias("y"), "width", "height")
    if frames is not None:
        asked = asked.join(_boxes(frames, "group", "group", "f"), "group", "left")
        me = asked.select("*", *(F.col(c).alias(f"me_{c}") for c in BOX))
        outside = ~F.coalesce(_within("me", "f", tolerance), F.lit(False))
    else:
        me, outside = asked, F.isnan("x") | F.isnan("y")
    code = F.when(F.col("x").isNull() | F.col("y").isNull(), "manual_position_invalid").when(outside, "manual_position_out_of_scope")
    asked = stored(me.select("group", "node_id", *BOX, code.alias("code")), "asked")
    open_ = asked.where("code is null").drop("code")

    # New places are met with each other and with those that cards have now.
    new = lambda c: F.concat(F.lit("n:"), c)
    near = open_.select("group").distinct()
    now = cards.select("group", F.concat(F.lit("o:"), "node_id").alias("node_id"), *BOX).join(near, "group", "left_semi")
    met = layout.overlaps(open_.select("group", new(F.col("node_id")).alias("node_id"), *BOX).unionByName(now), tolerance=tolerance).where(F.col("a").startswith("n:"))
    met = met.select("group", F.expr("substring(a, 3)").alias("a"), F.expr("substring(b, 3)").alias("b"), F.col("b").startswith("n:").alias("moved")).where("a <> b")
    movers = open_.select("group", F.col("node_id").alias("b"), F.lit(True).alias("mover"))
    # a < b among new places: the later one asks. A card that stands where it is until then is in the way of the earlier.
    both = met.where("moved").select("group", F.col("b").alias("node_id"), F.col("a").alias("other"), F.lit(True).alias("if_moved"))
    old = met.where("not moved").join(movers, ["group", "b"], "left").select("group", F.col("a").alias("node_id"), F.col("b").alias("other"), (F.col("mover").isNotNull() & (F.col("b") < F.col("a"))).alias("waits"))
    ways = both.select("group", "node_id", "other", "if_moved", F.lit(False).alias("if_stays"), F.lit(True).alias("waits")).unionByName(old.select("group", "node_id", "other", F.lit(False).alias("if_moved"), F.lit(True).alias("if_stays"), "waits"))
    ways = stored(ways.groupBy("group", "node_id", "other").agg(F.bool_or("if_moved").alias("if_moved"), F.bool_or("if_stays").alias("if_stays"), F.bool_and("waits").alias("waits")), "ways")

    state = open_.select("group", "node_id", F.lit(None).cast("boolean").alias("moves"))
    while True:
        known = state.select("group", F.col("node_id").alias("other"), F.col("moves").alias("went"))
        asks = state.where("moves is null").select("group", "node_id")
        way = ways.join(asks, ["group", "node_id"], "left_semi").join(known, ["group", "other"], "left")
        blocks = ~F.col("waits") | (F.col("if_moved") & F.col("if_stays")) | F.when(F.col("went"), F.col("if_moved")).otherwise(F.col("went").isNotNull() & F.col("if_stays"))
        told = way.groupBy("group", "node_id").agg(F.bool_or(F.coalesce(blocks, F.lit(False))).alias("blocked"), F.bool_or(F.col("waits") & F.col("went").isNull()).alias("unsure"))
        verdict = F.when(F.coalesce("blocked", F.lit(False)), F.lit(False)).when(F.coalesce("unsure", F.lit(False)), F.lit(None).cast("boolean")).otherwise(True)
        nxt = state.join(told, ["group", "node_id"], "left").select("group", "node_id", F.when(F.col("moves").isNotNull(), F.col("moves")).otherwise(verdict).alias("moves"))
        state, seen = measured(nxt, "verdicts", n=F.count_if(F.col("moves").isNull()))
        if not seen["n"]:
            break

    to = open_.join(state.where("moves"), ["group", "node_id"], "left_semi").select("group", "node_id", F.col("x").alias("__x"), F.col("y").alias("__y"))
    placed = cards.join(to, ["group", "node_id"], "left").withColumn("x", F.coalesce("__x", "x")).withColumn("y", F.coalesce("__y", "y")).select(*cards.columns)
    issue = lambda df, code: df.select(code.alias("code"), "group", F.col("node_id").alias("object_id"))
    return placed, issue(asked.where("code is not null"), F.col("code")).unionByName(issue(state.where("not moves"), F.lit("manual_position_overlap")))


def geometry_issues(scopes: DataFrame, frames: DataFrame, contents: DataFrame, members: DataFrame, cards: DataFrame, tolerance: float = BORDER_TOLERANCE) -> DataFrame:
    """(code, object_id, other_id) of scopes (scope_id, parent_id) with frames and contents, the area inside a frame, (scope_id, x, y, width, height), and of members (node_id, scope_id) with cards (node_id, x, y, width, height).

    layout_scope_coordinate_missing: a scope below another has no frame, or its parent no contents;
    geometry_scope_out_of_bounds: its frame leaves them. geometry_content_out_of_bounds: contents
    leave their own frame. layout_coordinate_missing: a member has no card;
    geometry_child_out_of_bounds: its card leaves its scope's contents; geometry_sibling_overlap: two cards of a
    scope overlap (object_id is the smaller). other_id is the parent, the scope or the other card.
    """
    issue = lambda df, code, one, other=F.lit(None): df.select(F.lit(code).alias("code"), F.col(one).alias("object_id"), other.cast("string").alias("other_id"))
    area = lambda key: _boxes(contents, "scope_id", key, "c")
    below = scopes.where("parent_id <> ''").join(_boxes(frames, "scope_id", "scope_id", "b"), "scope_id", "left").join(area("parent_id"), "parent_id", "left")
    lost = F.col("b_x").isNull() | F.col("c_x").isNull()
    own = _boxes(frames, "scope_id", "scope_id", "b").join(area("scope_id"), "scope_id")
    placed = members.join(_boxes(cards, "node_id", "node_id", "b"), "node_id", "left")
    held = placed.join(area("scope_id"), "scope_id")
    beside = layout.overlaps(members.withColumnRenamed("scope_id", "group").join(cards, "node_id"), tolerance=tolerance)
    return (
        issue(below.where(lost), "layout_scope_coordinate_missing", "scope_id", F.col("parent_id"))
        .unionByName(issue(below.where(~_within("b", "c", tolerance)), "geometry_scope_out_of_bounds", "scope_id", F.col("parent_id")))
        .unionByName(issue(own.where(~_within("c", "b", tolerance)), "geometry_content_out_of_bounds", "scope_id"))
        .unionByName(issue(placed.where("b_x is null"), "layout_coordinate_missing", "node_id", F.col("scope_id")))
        .unionByName(issue(held.where(~_within("b", "c", tolerance)), "geometry_child_out_of_bounds", "node_id", F.col("scope_id")))
        .unionByName(issue(beside, "geometry_sibling_overlap", "a", F.col("b")))
    )
