"""Places of cards in a scene: rings, bands and grids of components, packed on shelves; nested frames of scopes; columns of reading sequences; labels on routes.

Everything is done for all components, scopes or routes of all scenes in the same rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..storage import measured, stored
from . import graph, hierarchy, layout, routing, scans, scene

#: Sizes and distances of a scene.
CARD_WIDTH, CARD_HEIGHT, RANK_GAP, ROW_GAP, COMPONENT_GAP, ASPECT = 250.0, 86.0, 80.0, 28.0, 72.0, 1.6
SCOPE_WIDTH, HEADER, PAD_X, PAD_Y, UNIT_GAP, ROOT_GAP = 310.0, 54.0, 28.0, 24.0, 34.0, 54.0
LABEL_WIDTH, LABEL_HEIGHT, LABEL_RISE, LEAST_SEGMENT, DENSE = 156.0, 28.0, 6.0, 90.0, 12
#: Cards in a column of a band; the least degree of a hub, and the share of its component that it must link.
BAND_ROWS, HUB_DEGREE, HUB_SHARE = 5, 6, 0.6
#: Times that the order inside ranks follows the neighbours.
SWEEPS = 4


def _key(*columns: str) -> Column:
    return F.concat_ws("\u001f", *columns)


def component_shapes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Stored (group, component, node_id, size, hub, rank, shape) of nodes (group, node_id) under edges (group, source_id, target_id, relation_type, relation_family).

    A component's hub is its node with the most neighbours, of equal ones the greatest; shape is
    single for a lone node, ring where the hub has max(6, 60 % of the others) neighbours, bands
    where directional relations (at least max(2, a third of the nodes)) lead over several ranks,
    else grid. Nodes of a cycle share a rank. Edges with an end that is no node don't count.
    """
    nodes = stored(nodes.select("group", "node_id", _key("group", "node_id").alias("key")).dropDuplicates(["key"]), "nodes")
    directed = (T.directionality(T.relation_type(F.col("relation_type"))) == "directional") & (F.col("relation_family") != "unresolved")
    ends = edges.select(_key("group", "source_id").alias("a"), _key("group", "target_id").alias("b"), F.coalesce(directed, F.lit(False)).alias("directed"))
    known = nodes.select("key")
    ends = stored(ends.where("a <> b").join(known.withColumnRenamed("key", "a"), "a", "left_semi").join(known.withColumnRenamed("key", "b"), "b", "left_semi"), "ends")
    comp = graph.components(nodes.select(F.col("key").alias("node_id")), ends).withColumnRenamed("node_id", "key")
    degree = ends.select("a", "b").union(ends.select("b", "a")).distinct().groupBy(F.col("a").alias("key")).agg(F.count(F.lit(1)).alias("degree"))
    members = stored(nodes.join(comp, "key").join(degree, "key", "left").withColumn("degree", F.coalesce("degree", F.lit(0))), "members")
    ranks = graph.condensed_ranks(members.select(F.col("key").alias("node_id")), ends.where("directed").select("a", "b").distinct()).select(F.col("node_id").alias("key"), "rank")
    ranked = stored(members.join(ranks, "key"), "ranked")
    arrows = ends.where("directed").join(ranked.select(F.col("key").alias("a"), "component"), "a").groupBy("component").agg(F.count(F.lit(1)).alias("arrows"))
    facts = ranked.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("degree", "node_id")).alias("top"), F.min("rank").alias("lo"), F.max("rank").alias("hi")).join(arrows, "component", "left")
    size = F.col("size")
    shape = (
        F.when(size == 1, "single").when(F.col("top.degree") >= F.greatest(F.lit(HUB_DEGREE), F.ceil((size - 1) * HUB_SHARE)), "ring")
        .when((F.col("hi") > F.col("lo")) & (F.coalesce("arrows", F.lit(0)) >= F.greatest(F.lit(2), F.floor(size / 3))), "bands").otherwise("grid")
    )
    return stored(ranked.join(facts.select("component", "size", F.col("top.node_id").alias("hub"), shape.alias("shape")), "component").select("group", "component", "key", "node_id", "size", "hub", "rank", "shape"), "shapes")


def swept(shapes: DataFrame, links: DataFrame, sweeps: int = SWEEPS) -> DataFrame:
    """shapes with ``place``, the order inside (component, rank) from 0 on.

    It starts with the order of node_id. In each sweep all ranks are ordered anew by the mean place of
    a node's neighbours (links (a, b) of keys), those of lower ranks in odd sweeps and of higher ones in
    even ones; nodes without any stay where they are, of equal ones the smaller node_id is first. Places
    are scaled to the rank's size, so that ranks of different sizes compare.
    """
    bands = ["component", "rank"]
    order = lambda df, *by: scans.running(df, bands, [*by, "node_id"]).withColumn("place", F.col("idx") - 1).withColumn("height", (F.col("idx") - 0.5) / F.col("n")).drop("idx", "n")
    now = order(shapes)
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    for k in range(sweeps):
        now = stored(now, "places")
        low = now.select(F.col("key").alias("b"), F.col("rank").alias("other"), F.col("height").alias("h"))
        seen = both.join(low, "b").join(now.select(F.col("key").alias("a"), "rank"), "a").where("other < rank" if k % 2 == 0 else "other > rank")
        mean = seen.groupBy(F.col("a").alias("key")).agg(F.round(F.avg("h"), 9).alias("mean"))
        now = order(now.drop("place").join(mean, "key", "left").withColumn("at", F.coalesce("mean", "height")).drop("height", "mean"), "at").drop("at")
    return now.drop("height")


def component_places(shapes: DataFrame, width: float = CARD_WIDTH, height: float = CARD_HEIGHT) -> DataFrame:
    """swept shapes with x, y inside their component.

    A ring's hub stands in the middle of a rectangle of slots that its leaves take by name: top
    row, bottom row, left and right column. Bands stand side by side in the order of ranks; one of more
    than BAND_ROWS cards has several columns, filled row by row, its last row in the middle. A
    grid is filled row by row by rank and place, wide enough for the aspect.
    """
    loose_x, loose_y = width + max(RANK_GAP, 96.0), height + max(ROW_GAP, 54.0)
    step_x, step_y = width + RANK_GAP, height + ROW_GAP
    at = lambda df, x, y: df.select("group", "component", "node_id", "shape", "rank", x.cast("double").alias("x"), y.cast("double").alias("y"))

    single = at(shapes.where("shape = 'single'"), F.lit(0.0), F.lit(0.0))

    ring = shapes.where("shape = 'ring'").withColumn("leaves", F.col("size") - 1)
    side = F.greatest(F.lit(2), F.ceil(F.col("leaves") / 4))
    ring = ring.withColumn("w", side + 1).withColumn("h", F.greatest(F.lit(4), F.ceil(F.col("leaves") / (side * 2)) + 2, F.ceil((F.col("leaves") - 2 * (side + 1)) / 2) + 2))
    hub = at(ring.where("node_id = hub"), (F.col("w") - 1) * loose_x / 2, (F.col("h") - 1) * loose_y / 2)
    leaf = scans.running(ring.where("node_id <> hub"), ["component"], ["node_id"]).withColumn("k", F.col("idx") - 1)
    w, h, k = F.col("w"), F.col("h"), F.col("k")
    column = F.when(k < w, k).when(k < 2 * w, k - w).when(k < 2 * w + h - 2, F.lit(0)).otherwise(w - 1)
    row = F.when(k < w, F.lit(0)).when(k < 2 * w, h - 1).when(k < 2 * w + h - 2, k - 2 * w + 1).otherwise(k - 2 * w - h + 3)
    leaf = at(leaf, column * loose_x, row * loose_y)

    def rowed(df: DataFrame, columns: Column, n: Column, i: Column) -> DataFrame:
        """Row and place of the i-th of n cards in rows of so many columns, the last one in the middle."""
        df = df.withColumn("columns", columns.cast("long")).withColumn("row", F.floor(i / F.col("columns")))
        short = F.least(F.col("columns"), n - F.col("row") * F.col("columns"))
        return df.withColumn("inset", (F.col("columns") - short) / 2 + i % F.col("columns"))

    bands = shapes.where("shape = 'bands'")
    ranks = bands.groupBy("component", "rank").agg(F.count(F.lit(1)).alias("cards")).withColumn("columns", F.ceil(F.col("cards") / BAND_ROWS))
    ranks = ranks.withColumn("rows", F.ceil(F.col("cards") / F.col("columns")))
    tall = ranks.groupBy("component").agg(F.max("rows").alias("most"))
    ranks = scans.running(ranks, ["component"], ["rank"], right=F.col("columns")).join(tall, "component")
    ranks = ranks.select("component", "rank", "cards", "most", "rows", (F.col("right") - F.col("columns")).alias("left"), F.col("columns").alias("wide"))
    banded = rowed(bands.join(ranks, ["component", "rank"]), F.col("wide"), F.col("cards"), F.col("place"))
    banded = at(banded, (F.col("left") + F.col("inset")) * step_x, (F.col("most") - F.col("rows")) * step_y / 2 + F.col("row") * step_y)

    grid = scans.running(shapes.where("shape = 'grid'"), ["component"], ["rank", "place"]).withColumn("i", F.col("idx") - 1)
    wide = F.greatest(F.lit(2), F.least(F.col("size"), F.ceil(F.sqrt(F.col("size") * ASPECT * loose_y / loose_x))))
    grid = rowed(grid, wide, F.col("size"), F.col("i"))
    grid = at(grid, F.col("inset") * loose_x, F.col("row") * loose_y)
    return single.unionByName(hub).unionByName(leaf).unionByName(banded).unionByName(grid)


def component_layout(nodes: DataFrame, edges: DataFrame, width: float = CARD_WIDTH, height: float = CARD_HEIGHT) -> DataFrame:
    """(group, node_id, component, shape, rank, x, y, width, height): cards of scenes, nodes (group, node_id) under edges (group, source_id, target_id, relation_type, relation_family).

    Components are laid out by themselves (``component_shapes``, ``component_places``) and packed on
    shelves, larger ones first, then by their first node; a shelf is as wide as a page of the aspect
    that holds all of them, or as the widest. An empty table gives no rows.
    """
    shapes = component_shapes(nodes, edges)
    links = edges.where("source_id <> target_id").select(_key("group", "source_id").alias("a"), _key("group", "target_id").alias("b"))
    places = stored(component_places(swept(shapes, links), width, height), "places")
    units = places.groupBy("group", "component").agg((F.max("x") + width).alias("width"), (F.max("y") + height).alias("height"), F.count(F.lit(1)).alias("size"), F.min("node_id").alias("first"))
    units = units.select("group", F.col("component").alias("unit_id"), F.struct((-F.col("size")).alias("size"), "first").alias("ord"), "width", "height")
    packed = layout.shelves(units, None, COMPONENT_GAP, ASPECT).select("group", F.col("unit_id").alias("component"), F.col("x").alias("ux"), F.col("y").alias("uy"))
    return places.join(packed, ["group", "component"]).select("group", "node_id", "component", "shape", F.col("rank").cast("long").alias("rank"), (F.col("x") + F.col("ux")).alias("x"), (F.col("y") + F.col("uy")).alias("y"), F.lit(width).alias("width"), F.lit(height).alias("height"))


def scope_frames(scopes: DataFrame, contents: DataFrame, card_height: float = CARD_HEIGHT) -> tuple[DataFrame, DataFrame]:
    """((scope_id, depth, x, y, width, height, inner_x, inner_y), issues (code, object_id)) of scopes (scope_id, parent_id, ord) around contents (scope_id, width, height).

    A frame has a header, what the scope itself holds, and below it the frames of its children in
    the order of ord (then scope_id), one under the other; roots (parent_id empty, null or unknown) stand under
    each other too. inner_x and inner_y are where a scope's own contents begin. Scopes on a cycle
    are one issue layout_structure_cycle for each cycle, named by its smallest member; they and all below
    have no frame.

    The height of a frame is a sum over the scopes below, its width a maximum, and its place a sum over
    those above, so all of it takes as many rounds as the logarithm of the depth.
    """
    rows = scopes.select("scope_id", "parent_id", "ord").dropDuplicates(["scope_id"])
    ids = rows.select(F.col("scope_id").alias("parent_id"))
    up = stored(rows.join(ids, "parent_id", "left_semi").select(F.col("scope_id").alias("child"), F.col("parent_id").alias("parent")), "parents")
    rings = hierarchy.cycle_members(up)
    issues = rings.select(F.lit("layout_structure_cycle").alias("code"), F.col("cycle_id").alias("object_id")).distinct()

    held = contents.select("scope_id", F.col("width").alias("w"), F.col("height").alias("h"))
    kids = up.groupBy(F.col("parent").alias("scope_id")).agg(F.count(F.lit(1)).alias("kids"))
    own = rows.join(up.withColumnRenamed("child", "scope_id"), "scope_id", "left").join(held, "scope_id", "left").join(kids, "scope_id", "left")
    nothing = F.lit(0.0)
    inner = F.coalesce("h", nothing) + F.when(F.col("h").isNotNull(), UNIT_GAP).otherwise(0.0)
    tall = HEADER + 2 * PAD_Y + F.when(F.col("kids").isNull(), F.greatest(F.lit(card_height), F.coalesce("h", nothing))).otherwise(inner + UNIT_GAP * (F.col("kids") - 1))
    wide = F.greatest(F.lit(SCOPE_WIDTH), F.coalesce("w", nothing) + 2 * PAD_X)
    own = stored(own.select("scope_id", "parent", "ord", "kids", (HEADER + PAD_Y + inner).alias("first"), tall.alias("tall"), wide.alias("wide")), "scopes")

    # Of a scope and what is less than 2 ** k steps below it: heights, widths less their depth under it; above it: steps. Who leads to a cycle never ends.
    state = own.select("scope_id", F.col("parent").alias("far"), F.col("tall").alias("height"), F.col("wide").alias("width"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    length, most = 1, own.count()
    while True:
        state, seen = measured(state, "frames", n=F.count("far"))
        if not seen["n"] or length > 2 * most:
            break
        below = state.where("far is not null").groupBy(F.col("far").alias("scope_id")).agg(F.sum("height").alias("more"), (F.max("width") + 2 * PAD_X * length).alias("wider"))
        above = state.select(F.col("scope_id").alias("far"), F.col("far").alias("next"), F.col("depth").alias("steps"))
        state = state.join(below, "scope_id", "left").join(above, "far", "left")
        state = state.select("scope_id", F.col("next").alias("far"), (F.col("height") + F.coalesce("more", nothing)).alias("height"), F.greatest("width", F.coalesce("wider", "width")).alias("width"), (F.col("depth") + F.coalesce("steps", F.lit(0))).alias("depth"))
        length *= 2
    sized = stored(state.where("far is null").select("scope_id", "depth", "width", "height").join(own.select("scope_id", "parent", "ord", "first"), "scope_id"), "sized")

    # Where each frame begins in its parent's, and then from the top.
    starts = sized.select(F.col("scope_id").alias("parent"), F.col("first").alias("above"))
    line = sized.withColumn("gap", F.when(F.col("parent").isNull(), ROOT_GAP).otherwise(UNIT_GAP)).withColumn("under", F.coalesce("parent", F.lit("")))
    lined = scans.running(line, ["under"], ["ord", "scope_id"], reach=F.col("height") + F.col("gap")).join(starts, "parent", "left")
    moved = lined.select("scope_id", F.col("parent").alias("far"), (F.col("reach") - F.col("height") - F.col("gap") + F.coalesce("above", nothing)).alias("y"))
    while True:
        moved, seen = measured(moved, "offsets", n=F.count("far"))
        if not seen["n"]:
            break
        above = moved.select(F.col("scope_id").alias("far"), F.col("far").alias("next"), F.col("y").alias("more"))
        moved = moved.join(above, "far", "left").select("scope_id", F.col("next").alias("far"), (F.col("y") + F.coalesce("more", nothing)).alias("y"))
    x = F.col("depth") * PAD_X
    frames = sized.join(moved.select("scope_id", "y"), "scope_id").select("scope_id", "depth", x.alias("x"), "y", "width", "height", (x + PAD_X).alias("inner_x"), (F.col("y") + HEADER + PAD_Y).alias("inner_y"))
    return frames, issues


def nested_layout(scopes: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frames, cards (scope_id, node_id, shape, x, y, width, height), issues): the cards of each scope, nodes (group, node_id) with the scope as group, by ``component_layout``, inside nested ``scope_frames``.

    Cards whose scope has no frame have no place, and are issues layout_coordinate_missing.
    """
    local = stored(component_layout(nodes, edges), "local")
    sizes = local.groupBy(F.col("group").alias("scope_id")).agg(F.max(F.col("x") + F.col("width")).alias("width"), F.max(F.col("y") + F.col("height")).alias("height"))
    frames, issues = scope_frames(scopes, sizes)
    frames = stored(frames, "frames")
    inside = frames.select(F.col("scope_id").alias("group"), "inner_x", "inner_y")
    cards = local.join(inside, "group").select(F.col("group").alias("scope_id"), "node_id", "shape", (F.col("x") + F.col("inner_x")).alias("x"), (F.col("y") + F.col("inner_y")).alias("y"), "width", "height")
    lost = local.join(inside, "group", "left_anti").select(F.lit("layout_coordinate_missing").alias("code"), F.col("node_id").alias("object_id"))
    return frames, cards, issues.unionByName(lost)


def label_places(routes: DataFrame, cards: DataFrame, width: float = LABEL_WIDTH, height: float = LABEL_HEIGHT) -> DataFrame:
    """(group, edge_id, x, y, width, height, visible, reason): a label for each of routes (group, edge_id, place, status, important, points) that touches no card of cards (group, node_id, x, y, width, height) and no other label by two units or less.

    Labels stand over the middle of a segment, the longest first, none shorter than LEAST_SEGMENT. A route
    chooses after all routes with a smaller place (then edge_id) of its scene: a round fixes those whose best free
    slot no undecided earlier route still wants any slot near. In scenes of more than DENSE routes only important
    ones are shown (reason overview_density). No slot: no_safe_slot; no route: route_unavailable.
    """
    near = 2.0
    rows = stored(routes.select("group", "edge_id", "place", "status", "important", "points"), "labels")
    many = rows.groupBy("group").agg((F.count(F.lit(1)) > DENSE).alias("dense"))
    routed = (F.col("status") == "routed") & (F.size("points") >= 2)
    seg = rows.where(routed).select("group", "edge_id", "place", F.posexplode(F.arrays_zip(F.slice("points", 1, F.size("points") - 1).alias("p"), F.slice("points", 2, F.size("points") - 1).alias("q"))).alias("nth", "s"))
    length = F.abs(F.col("s.p.x") - F.col("s.q.x")) + F.abs(F.col("s.p.y") - F.col("s.q.y"))
    slot = seg.where(length >= min(width, LEAST_SEGMENT)).select(
        "group", "edge_id", "place", "nth", length.alias("length"), ((F.col("s.p.x") + F.col("s.q.x")) / 2 - width / 2).alias("x"), ((F.col("s.p.y") + F.col("s.q.y")) / 2 - height / 2 - LABEL_RISE).alias("y"), F.concat_ws("#", "edge_id", "nth").alias("node_id")
    )
    wide = lambda df: df.select("group", "node_id", (F.col("x") - near).alias("x"), (F.col("y") - near).alias("y"), F.lit(width + 2 * near).alias("width"), F.lit(height + 2 * near).alias("height"))
    strict = lambda df, w, h: df.where((F.col("x") < F.col("o_x") + w) & (F.col("o_x") < F.col("x") + F.col("width")) & (F.col("y") < F.col("o_y") + h) & (F.col("o_y") < F.col("y") + F.col("height")))
    over = strict(scene.meets(wide(slot), cards.select("group", "node_id", "x", "y", "width", "height")), F.col("o_width"), F.col("o_height")).select("group", "node_id").distinct()
    free = stored(slot.join(over, ["group", "node_id"], "left_anti"), "slots")
    boxes = free.select("group", "node_id", "x", "y", F.lit(width).alias("width"), F.lit(height).alias("height"))
    clash = strict(scene.meets(wide(free), boxes), F.lit(width), F.lit(height)).select("group", F.col("node_id").alias("a"), F.col("o_node_id").alias("b"))
    turn = free.select("group", F.col("node_id").alias("a"), F.struct("place", "edge_id").alias("ta"), F.col("edge_id").alias("ea"))
    # (a, b): slots of two routes that are in each other's way, a's route choosing after b's.
    clash = stored(clash.join(turn, ["group", "a"]).join(turn.select("group", F.col("a").alias("b"), F.col("ta").alias("tb"), F.col("ea").alias("eb")), ["group", "b"]).where("tb < ta").select("group", "a", "b", "ea", "eb"), "clashes")

    choice = Window.partitionBy("group", "edge_id").orderBy(F.col("length").desc(), "nth")
    open_, fixed = free, None
    while True:
        best = open_.withColumn("first", F.row_number().over(choice) == 1)
        # A slot waits while an earlier route that isn't decided has a slot in its way; later slots of a route wait for better ones.
        waits = clash.join(open_.select("group", F.col("node_id").alias("b")), ["group", "b"], "left_semi").select("group", F.col("a").alias("node_id"), F.lit(True).alias("waits")).distinct()
        new, seen = measured(best.where("first").join(waits, ["group", "node_id"], "left").where("waits is null").select("group", "edge_id", "node_id", "x", "y"), "fixed", n=F.count(F.lit(1)))
        if not seen["n"]:
            break
        fixed = new if fixed is None else fixed.unionByName(new)
        taken = clash.join(new.select("group", F.col("node_id").alias("b")), ["group", "b"], "left_semi").select("group", F.col("a").alias("node_id")).distinct()
        open_ = stored(open_.join(new.select("group", "edge_id"), ["group", "edge_id"], "left_anti").join(taken, ["group", "node_id"], "left_anti"), "slots")
    if fixed is None:
        fixed = free.select("group", "edge_id", "node_id", "x", "y").limit(0)
    out = rows.select("group", "edge_id", "important", routed.alias("routed")).join(many, "group").join(fixed.drop("node_id"), ["group", "edge_id"], "left")
    shown = F.col("x").isNotNull() & (~F.col("dense") | F.coalesce("important", F.lit(False)))
    reason = F.when(~F.col("routed"), "route_unavailable").when(F.col("x").isNull(), "no_safe_slot").when(~shown, "overview_density").otherwise("")
    size = lambda v: F.when(F.col("x").isNotNull(), F.lit(v))
    return out.select("group", "edge_id", "x", "y", size(width).alias("width"), size(height).alias("height"), shown.alias("visible"), reason.alias("reason"))


def reading_places(cards: DataFrame, sequences: DataFrame) -> DataFrame:
    """cards (group, node_id, x, y, width, height) with the items of reading sequences (group, sequence_id, parent_id, node_id, ordinal) in columns of their own.

    A sequence of two or more items whose cards are there stands right of its parent, one under the other in the
    order of ordinal (then node_id) about the parent's middle, not above 0. As long as cards other than its own and the parent's
    come nearer than a route's clearance, the column moves right of all of these. Sequences of a
    scene follow each other by sequence_id, as each sees what those before have moved; all scenes go
    together, so there are as many rounds as the most sequences of a scene. A parent without a card moves nothing.
    """
    wide = max(RANK_GAP, 96.0)
    cards = stored(cards.select("group", "node_id", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height"))), "cards")
    known = cards.select("group", "node_id")
    items = sequences.join(known, ["group", "node_id"], "left_semi").join(known.withColumnRenamed("node_id", "parent_id"), ["group", "parent_id"], "left_semi")
    full = items.groupBy("group", "sequence_id").agg(F.count(F.lit(1)).alias("k")).where("k >= 2").select("group", "sequence_id")
    turns = scans.running(full, ["group"], ["sequence_id"]).select("group", "sequence_id", F.col("idx").alias("turn"))
    items, seen = measured(items.join(turns, ["group", "sequence_id"]).select("group", "turn", "parent_id", "node_id", "ordinal"), "sequences", top=F.max("turn"))
    for turn in range(1, (seen["top"] or 0) + 1):
        here = items.where(F.col("turn") == turn)
        sized = scans.running(here.join(cards.select("group", "node_id", "width", "height"), ["group", "node_id"]), ["group"], ["ordinal", "node_id"], reach=F.col("height") + ROW_GAP)
        total = sized.groupBy("group").agg((F.max("reach") - ROW_GAP).alias("total"))
        parent = cards.select("group", F.col("node_id").alias("parent_id"), (F.col("x") + F.col("width") + wide).alias("x"), (F.col("y") + F.col("height") / 2).alias("middle"))
        moving = sized.join(total, "group").join(parent, ["group", "parent_id"])
        moving = stored(moving.select("group", "node_id", "parent_id", "x", (F.greatest(F.lit(0.0), F.col("middle") - F.col("total") / 2) + F.col("reach") - F.col("height") - ROW_GAP).alias("y"), "width", "height"), "moving")
        own = moving.select("group", "node_id").union(moving.select("group", "parent_id")).distinct()
        others = stored(cards.join(moving.select("group").distinct(), "group", "left_semi").join(own, ["group", "node_id"], "left_anti"), "others")
        while True:
            c = routing.CLEARANCE
            around = moving.select("group", "node_id", (F.col("x") - c).alias("x"), (F.col("y") - c).alias("y"), (F.col("width") + 2 * c).alias("width"), (F.col("height") + 2 * c).alias("height"))
            hit = scene.meets(around, others).where("x < o_x + o_width and o_x < x + width and y < o_y + o_height and o_y < y + height")
            past, met = measured(hit.groupBy("group").agg((F.max(F.col("o_x") + F.col("o_width")) + wide).alias("past")), "blockers", n=F.count(F.lit(1)))
            if not met["n"]:
                break
            moving = stored(moving.join(past, "group", "left").withColumn("x", F.coalesce("past", "x")).drop("past"), "moving")
        new = moving.select("group", "node_id", F.col("x").alias("nx"), F.col("y").alias("ny"))
        cards = stored(cards.join(new, ["group", "node_id"], "left").select("group", "node_id", F.coalesce("nx", "x").alias("x"), F.coalesce("ny", "y").alias("y"), "width", "height"), "cards")
    return cards
