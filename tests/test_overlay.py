"""Overlay, points in polygons, dissolve and distance of polygons against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plotwise.operators import geometry, overlay

DRAW = random.Random(11)


def polygon(key, *rings):
    return [(key, r, s, float(x), float(y)) for r, ring in enumerate(rings) for s, (x, y) in enumerate(ring)]


def segs(spark, *polygons):
    return geometry.segments(spark.createDataFrame([row for p in polygons for row in p], "id long, ring int, seq int, x double, y double"))


ARROW = [(0, 0), (10, 0), (10, 10), (5, 4), (0, 10)]  # concave
FRAME = ([(20, 0), (32, 0), (32, 12), (20, 12)], [(23, 3), (23, 9), (29, 9), (29, 3)])  # with a hole
STAR = [(50 + (12 if k % 2 else 4.5) * math.cos(k * math.pi / 7 + 0.3), 6 + (12 if k % 2 else 4.5) * math.sin(k * math.pi / 7 + 0.3)) for k in range(14)]
TWO = ([(0, 20), (6, 20), (6, 26)], [(10, 20), (16, 20), (16, 26), (10, 26)])  # two parts


@pytest.fixture(scope="module")
def shapes(spark):
    return segs(spark, polygon(1, ARROW), polygon(2, *FRAME), polygon(3, STAR), polygon(4, *TWO), polygon(5, ARROW[::-1])).cache()


RINGS = {1: [ARROW], 2: list(FRAME), 3: [STAR], 4: list(TWO), 5: [ARROW]}


def contains(rings, x, y):
    n = 0
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if (ay <= y) != (by <= y) and ax + (y - ay) / (by - ay) * (bx - ax) > x:
                n += 1
    return n % 2 == 1


def ring_area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)) / 2


@pytest.mark.parametrize("cell", [0.7, 3.0, 100.0])
def test_cover_adds_up_to_the_area(spark, shapes, cell):
    got = {r.id: r.a for r in overlay.cell_cover(shapes, cell=cell).groupBy("id").agg(F.sum("area").alias("a")).collect()}
    assert got == pytest.approx({k: abs(sum(map(ring_area, v))) for k, v in RINGS.items()}, rel=1e-9)


@pytest.mark.parametrize("cell", [0.7, 3.0, 100.0])
def test_points_in_polygons(spark, shapes, cell):
    places = [(k, DRAW.uniform(-3, 65), DRAW.uniform(-8, 30)) for k in range(3000)] + [(-1, None, 1.0), (-2, float("nan"), 1.0)] + [(k, float(DRAW.randrange(60)) + 0.25, float(DRAW.randrange(26))) for k in range(3000, 3500)]
    points = spark.createDataFrame(places, "p long, x double, y double")
    got = {(r.p, r.id) for r in overlay.points_in_polygons(points, shapes, cell=cell).collect()}
    assert got == {(p, k) for p, x, y in places if x == x and x is not None for k, rings in RINGS.items() if contains(rings, x, y)}


def clipped(ring, box):
    """The area of a ring within a box, by cutting it at the four sides in turn."""
    for axis, bound, keep in ((0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1)):
        out = []
        for a, b in zip(ring, [*ring[1:], ring[0]], strict=True):
            in_a, in_b = keep * (a[axis] - bound) >= 0, keep * (b[axis] - bound) >= 0
            if in_a:
                out.append(a)
            if in_a != in_b:
                t = (bound - a[axis]) / (b[axis] - a[axis])
                out.append(tuple(a[i] + t * (b[i] - a[i]) for i in (0, 1)))
        ring = out
        if not ring:
            return 0.0
    return ring_area(ring)


@pytest.mark.parametrize("cell", [1.3, 5.0, 200.0])
def test_overlay_with_boxes(spark, shapes, cell):
    boxes = {k: (x := DRAW.uniform(-2, 60), y := DRAW.uniform(-6, 28), x + DRAW.uniform(0.1, 9), y + DRAW.uniform(0.1, 9)) for k in range(60)}
    table = spark.createDataFrame([(k, *b) for k, b in boxes.items()], "right_id long, x0 double, y0 double, x1 double, y1 double")
    got = {(r.left_id, r.right_id): r.area for r in overlay.overlay_areas(shapes.withColumnRenamed("id", "left_id"), geometry.box_segments(table, "right_id"), cell=cell).collect()}
    want = {(i, k): abs(sum(clipped(r, b) for r in rings)) for i, rings in RINGS.items() for k, b in boxes.items()}
    assert got == pytest.approx({k: v for k, v in want.items() if v > 1e-7}, rel=1e-7, abs=1e-7)


@pytest.mark.parametrize("cell", [0.9, 4.0])
def test_parts_of_a_tiling_sum_to_the_whole(spark, shapes, cell):
    # A skewed lattice of triangles that covers everything.
    at = lambda i, j: (-10 + 4 * i + 1.1 * j, -12 + 3.3 * j + 0.7 * i)
    tiles = [polygon(100 + 2 * (i * 40 + j) + k, t) for i in range(-10, 24) for j in range(-6, 22) for k, t in enumerate(([at(i, j), at(i + 1, j), at(i, j + 1)], [at(i + 1, j), at(i + 1, j + 1), at(i, j + 1)]))]
    got = overlay.overlay_areas(shapes.withColumnRenamed("id", "left_id"), segs(spark, *tiles).withColumnRenamed("id", "right_id"), cell=cell).groupBy("left_id").agg(F.sum("area").alias("a"))
    assert {r.left_id: r.a for r in got.collect()} == pytest.approx({k: abs(sum(map(ring_area, v))) for k, v in RINGS.items()}, rel=1e-7)


def test_overlay_of_concave_shapes_by_hand(spark):
    a = segs(spark, polygon(1, *FRAME)).withColumnRenamed("id", "left_id")
    b = segs(spark, polygon(7, [(22, 2), (30, 2), (30, 10), (22, 10)]), polygon(8, [(20, 0), (32, 12), (20, 12)]), polygon(9, [(24, 4), (28, 4), (28, 8)])).withColumnRenamed("id", "right_id")
    for cell in (1.0, 7.0, 50.0):
        got = {r.right_id: r.area for r in overlay.overlay_areas(a, b, cell=cell).collect()}
        assert got == pytest.approx({7: 64 - 36, 8: 72 - 18}, rel=1e-9)


def test_shares_means_and_interpolation(spark):
    zones = segs(spark, polygon(1, [(0, 0), (4, 0), (4, 4)]), polygon(2, [(10, 0), (14, 0), (14, 4), (10, 4)]), polygon(3, [(90, 0), (91, 0), (91, 1)]))
    others = segs(spark, polygon(5, [(0, 0), (2, 0), (2, 4), (0, 4)]), polygon(6, [(2, 0), (12, 0), (12, 4), (2, 4)]))
    values = spark.createDataFrame([(5, 8.0, 1.0), (6, 40.0, 3.0)], "id long, people double, rate double")
    assert {r.id: r.share for r in overlay.overlap_shares(zones, others, cell=1.5).collect()} == pytest.approx({1: 1.0, 2: 0.5, 3: 0.0})
    people = {r.id: r.people for r in overlay.interpolate(others, values, zones, cell=1.5, columns=["people"]).collect()}
    assert people == pytest.approx({1: 8 * 2 / 8 + 40 * 6 / 40, 2: 40 * 8 / 40, 3: 0.0})
    assert {r.id: r.rate for r in overlay.polygon_means(zones, others, values, cell=1.5, columns=["rate"]).collect()} == {1: 2.0, 2: 3.0, 3: None}


def cells(spark, picked):
    boxes = spark.createDataFrame([(g, float(x), float(y), float(x + 1), float(y + 1)) for g, x, y in picked], "group string, x0 double, y0 double, x1 double, y1 double")
    return geometry.box_segments(boxes, "group")


def loops(rows):
    """Rings as lists of corners, each checked to be closed and in order."""
    out = {}
    for r in sorted(rows, key=lambda r: (r.ring, r.seq)):
        out.setdefault((r[0], r.ring), []).append(r)
    for ring in out.values():
        assert [r.seq for r in ring] == list(range(len(ring)))
        for a, b in zip(ring, [*ring[1:], ring[0]], strict=True):
            assert (a.x2, a.y2) == (b.x1, b.y1)
    return {k: [(r.x1, r.y1) for r in v] for k, v in out.items()}


def test_dissolve_by_hand(spark):
    frame = [("frame", x, y) for x in range(5) for y in range(5) if (x, y) not in {(2, 2), (1, 1)}]  # two holes that touch in a corner
    corner = [("corner", 0, 0), ("corner", 1, 1)]
    found = loops(overlay.dissolve(cells(spark, frame + corner)).collect())
    rings = {g: [tuple(v) for (k, _), v in found.items() if k == g] for g in ("frame", "corner")}
    assert sorted(map(ring_area, rings["corner"])) == [1.0, 1.0]
    assert sorted(map(ring_area, rings["frame"]))[-1] == 25.0 and sum(map(ring_area, rings["frame"])) == 23.0
    assert max(map(len, rings["frame"])) in (4, 8)


def test_dissolve_keeps_area_and_boundary(spark):
    picked = {(g, DRAW.randrange(40), DRAW.randrange(40)) for g in "ab" for _ in range(900)}
    got = overlay.dissolve(cells(spark, picked), straight=False)
    found = loops(got.collect())
    for g in "ab":
        mine = {(x, y) for k, x, y in picked if k == g}
        rings = [v for (k, _), v in found.items() if k == g]
        assert sum(map(ring_area, rings)) == len(mine)
        assert sum(map(len, rings)) == sum((x + i, y + j) not in mine for x, y in mine for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1)))
    straight = loops(overlay.dissolve(cells(spark, picked)).collect())
    assert {k[0] for k in straight} == {"a", "b"} and len(straight) == len(found) and sum(map(len, straight.values())) < sum(map(len, found.values()))
    assert sum(ring_area(v) for v in straight.values()) == len(picked)


def test_dissolve_a_random_tiling(spark):
    # Triangles of a bent lattice, each turned either way.
    bend = {(i, j): (i + DRAW.uniform(-0.3, 0.3), j + DRAW.uniform(-0.3, 0.3)) for i in range(13) for j in range(13)}
    tiles = []
    for i in range(12):
        for j in range(12):
            a, b, c, d = bend[i, j], bend[i + 1, j], bend[i + 1, j + 1], bend[i, j + 1]
            tiles += [polygon(len(tiles), [a, b, c][:: DRAW.choice([1, -1])]), polygon(len(tiles) + 1, [a, c, d][:: DRAW.choice([1, -1])])]
    whole = overlay.oriented(segs(spark, *tiles)).withColumn("group", F.lit("all"))
    found = loops(overlay.dissolve(whole).collect())
    rim = [bend[k] for k in [(i, 0) for i in range(12)] + [(12, j) for j in range(12)] + [(i, 12) for i in range(12, 0, -1)] + [(0, j) for j in range(12, 0, -1)]]
    assert len(found) == 1 and set(next(iter(found.values()))) == set(rim)
    assert ring_area(next(iter(found.values()))) == pytest.approx(ring_area(rim))


def test_merge_polygons(spark):
    parts = segs(spark, polygon(1, [(0, 0), (2, 0), (2, 2), (0, 2)]), polygon(2, [(2, 0), (2, 2), (5, 2), (5, 0)]), polygon(3, [(9, 0), (10, 0), (9, 1)]))
    names = spark.createDataFrame([(1, "Sol 1", "open"), (2, "Sol 2", "gated"), (3, "Luna", "open")], "id long, name string, access string")
    merged = spark.createDataFrame([(1, 7, "Sol", "open"), (2, 7, "Sol", "open")], "id long, into long, name string, access string")
    outlines, rows = overlay.merge_polygons(parts, names, merged)
    assert {r.id: (r.area, r.x0, r.x1) for r in geometry.measures(outlines).collect()} == {7: (10.0, 0.0, 5.0), 3: (0.5, 9.0, 10.0)}
    assert sorted(tuple(r) for r in rows.collect()) == [(3, "Luna", "open"), (7, "Sol", "open")]


def box_distance(rings, box):
    """By brute force: 0 if they touch or one holds the other, else over all corners and sides."""
    u0, v0, u1, v1 = box
    if contains(rings, (u0 + u1) / 2, (v0 + v1) / 2):
        return 0.0
    if any(abs(clipped(r, box)) > 0 for r in rings) and abs(sum(clipped(r, box) for r in rings)) > 1e-12:
        return 0.0

    def to_side(p, a, b):
        t = min(1, max(0, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / ((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2)))
        return math.dist(p, (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))

    best = math.inf
    for ring in rings:
        for a, b in zip(ring, [*ring[1:], ring[0]], strict=True):
            best = min(best, *(to_side(p, a, b) for p in ((u0, v0), (u0, v1), (u1, v0), (u1, v1))))
            best = min(best, *(math.hypot(max(u0 - x, x - u1, 0), max(v0 - y, y - v1, 0)) for x, y in (a, b)))
    return best


def test_distances_to_boxes(spark, shapes):
    boxes = [(g, float(x), float(y)) for g in range(6) for _ in range(40) for x, y in [(DRAW.randrange(-60, 140), DRAW.randrange(-60, 140))]]
    boxes += [(6, 4.25, 7.0), (7, 25.0, 5.0), (8, 4.0, 0.5), (9, 4.875, 8.0)]  # in the arrow's mouth, in the frame's hole, inside the arrow, in the mouth
    table = spark.createDataFrame([(g, x, y, x + (0.25 if g > 5 else 1), y + (0.25 if g > 5 else 1)) for g, x, y in boxes], "c long, u0 double, v0 double, u1 double, v1 double")
    got = {(r.id, r.c): r.d for r in overlay.distances_to_boxes(shapes, table, group=["c"], size=1.0).collect()}
    rows = table.collect()
    want = {(i, g): min(box_distance(rings, (r.u0, r.v0, r.u1, r.v1)) for r in rows if r.c == g) for i, rings in RINGS.items() for g in {r.c for r in rows}}
    assert got == pytest.approx(want, abs=1e-9)
    assert got[2, 7] == pytest.approx(2.0) and got[1, 8] == 0.0 and got[1, 9] > 0
