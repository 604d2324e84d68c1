import random

from graphloom.operators import manual

CARD = "group string, node_id string, x double, y double, width double, height double"


def sequential(cards, overrides, frames):
    """The rule taken one override at a time."""
    boxes, issues = {(g, n): (x, y, w, h) for g, n, x, y, w, h in cards}, set()
    over = lambda a, b: all(a[i] + 1 < b[i] + b[i + 2] and b[i] + 1 < a[i] + a[i + 2] for i in (0, 1))
    for g, n, x, y in sorted(overrides, key=lambda o: o[:2]):
        if (g, n) not in boxes:
            continue
        try:
            new = (float(x), float(y), *boxes[g, n][2:])
        except (TypeError, ValueError):
            issues.add(("manual_position_invalid", g, n))
            continue
        f = frames.get(g)
        if f is None or not all(new[i] >= f[i] - 1 and new[i] + new[i + 2] <= f[i] + f[i + 2] + 1 for i in (0, 1)):
            issues.add(("manual_position_out_of_scope", g, n))
        elif any(over(new, b) for (h, m), b in boxes.items() if h == g and m != n):
            issues.add(("manual_position_overlap", g, n))
        else:
            boxes[g, n] = new
    return {(*k, *b) for k, b in boxes.items()}, issues


def test_manual_places(spark):
    r = random.Random(4)
    cards, overrides, frames = [], [], {}
    for s in range(12):
        g = f"s{s}"
        if s != 3:
            frames[g] = (0.0, 0.0, 420.0, 420.0)
        for i in range(12):
            cards.append((g, f"n{i:02d}", i % 4 * 100.0, i // 4 * 100.0, 80.0, 80.0 if i % 5 else 40.0))
            if r.random() < 0.8:
                overrides.append((g, f"n{i:02d}", r.choice([str(r.randrange(-20, 400)), str(100 * r.randrange(4)), "no", None]) if i % 3 else str(r.randrange(380)), str(r.randrange(360))))
    overrides += [("s1", "unknown", "1", "2"), ("nowhere", "n01", "1", "2")]
    placed, issues = manual.manual_places(spark.createDataFrame(cards, CARD), spark.createDataFrame(overrides, "group string, node_id string, x string, y string"), spark.createDataFrame([(g, *f) for g, f in frames.items()], "group string, x double, y double, width double, height double"))
    want, told = sequential(cards, overrides, frames)
    assert {tuple(x) for x in placed.collect()} == want
    assert {tuple(x) for x in issues.collect()} == told and len({c for c, _, _ in told}) == 3
    assert want != {tuple(c) for c in cards}


def test_manual_places_without_frames(spark):
    cards = [("g", "a", 0.0, 0.0, 10.0, 10.0), ("g", "b", 20.0, 0.0, 10.0, 10.0), ("g", "c", 40.0, 0.0, 10.0, 10.0), (None, "a", 0.0, 0.0, 10.0, 10.0)]
    # a goes; b takes the place that a has left; c would lie where b is now
    wish = [("g", "a", -500.0, 0.0), ("g", "b", 0.0, 0.0), ("g", "c", 3.0, 3.0)]
    frame = spark.createDataFrame(cards, CARD)
    placed, issues = manual.manual_places(frame, spark.createDataFrame(wish, "group string, node_id string, x double, y double"))
    assert {(x.group, x.node_id): x.x for x in placed.collect()} == {("g", "a"): -500.0, ("g", "b"): 0.0, ("g", "c"): 40.0, (None, "a"): 0.0}
    assert [tuple(x) for x in issues.collect()] == [("manual_position_overlap", "g", "c")]
    none, quiet = manual.manual_places(frame.limit(0), spark.createDataFrame(wish, "group string, node_id string, x double, y double"))
    assert none.count() == 0 and quiet.count() == 0


def test_geometry_issues(spark):
    area = "scope_id string, x double, y double, width double, height double"
    scopes = spark.createDataFrame([("root", ""), ("in", "root"), ("out", "root"), ("lost", "root"), ("deep", "lost")], "scope_id string, parent_id string")
    frames = spark.createDataFrame([("root", 0.0, 0.0, 100.0, 100.0), ("in", 10.0, 10.0, 50.0, 50.0), ("out", 80.0, 10.0, 50.0, 50.0), ("deep", 1.0, 1.0, 5.0, 5.0)], area)
    contents = spark.createDataFrame([("root", 5.0, 5.0, 90.0, 90.0), ("in", 12.0, 12.0, 46.0, 46.0), ("out", 70.0, 10.0, 50.0, 50.0)], area)
    members = spark.createDataFrame([("a", "in"), ("b", "in"), ("c", "in"), ("d", "in"), ("e", "elsewhere")], "node_id string, scope_id string")
    cards = spark.createDataFrame([("a", 12.0, 12.0, 10.0, 10.0), ("b", 15.0, 15.0, 10.0, 10.0), ("c", 50.0, 12.0, 20.0, 10.0), ("e", 12.0, 12.0, 10.0, 10.0)], "node_id string, x double, y double, width double, height double")
    got = sorted(tuple(x) for x in manual.geometry_issues(scopes, frames, contents, members, cards).collect())
    assert got == [
        ("geometry_child_out_of_bounds", "c", "in"),
        ("geometry_content_out_of_bounds", "out", None),
        ("geometry_scope_out_of_bounds", "out", "root"),
        ("geometry_sibling_overlap", "a", "b"),
        ("layout_coordinate_missing", "d", "in"),
        ("layout_scope_coordinate_missing", "deep", "lost"),
        ("layout_scope_coordinate_missing", "lost", "root"),
    ]
