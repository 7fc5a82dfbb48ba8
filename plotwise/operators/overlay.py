"""Polygons over polygons, points and cells, by way of a grid.

A polygon is its segments (key, ring, seq, x1, y1, x2, y2): rings closed, holes
run the other way round than what they are cut from. Concave shapes, holes and
several parts are all the same to these operators.

The segments are cut at the lines of a grid. A cell that a segment passes is an
edge cell: it keeps its pieces, and the winding number of its lower left
corner, which is how often the polygon's boundary crosses the cell's left line
from there upward. The cells between two edge cells of a column are inner cells
or outside, all alike, and that winding number tells which. So a point meets
only its own cell, inner cells answer without geometry, and the area within a
cell follows from running sums down its column.

Grid lines lie off round numbers, and differently so in x and y, so that corners
of polygons are not on them and slanting sides don't pass their crossings.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .geometry import measures, segments
from .graph import cut
from .relate import with_places

#: Where the grid's upright and level lines lie between multiples of the cell size.
SHIFT_X, SHIFT_Y = 0.3819660112501051, 0.7320508075688772
PIECE = "array<struct<x1:double,y1:double,x2:double,y2:double>>"


def column_of(x: Column, cell: float) -> Column:
    return F.floor(x / cell - SHIFT_X)


def row_of(y: Column, cell: float) -> Column:
    return F.floor(y / cell - SHIFT_Y)


def left_line(gx: Column, cell: float) -> Column:
    return (gx + SHIFT_X) * cell


def low_line(gy: Column, cell: float) -> Column:
    return (gy + SHIFT_Y) * cell


def pieces(segs: DataFrame, *, cell: float, key: str = "id") -> DataFrame:
    """(key, gx, gy, x1, y1, x2, y2, cross, px1, py1, px2, py2): each segment with each cell it passes, and its piece there.

    cross is 1 or -1 where the segment crosses the cell's left line rightward
    or leftward, 0 elsewhere. Segments with a null or without length are left out.
    """
    c = F.col
    good = segs.select(key, *[c(v).cast("double").alias(v) for v in ("x1", "y1", "x2", "y2")]).where("x1 is not null and y1 is not null and x2 is not null and y2 is not null and (x1 <> x2 or y1 <> y2)")
    lo, hi = F.least("x1", "x2"), F.greatest("x1", "x2")
    cols = good.withColumn("gx", F.explode(F.sequence(column_of(lo, cell), column_of(hi, cell))))
    left, right = left_line(c("gx"), cell), left_line(c("gx") + 1, cell)
    y_at = lambda x: c("y1") + (x - c("x1")) / (c("x2") - c("x1")) * (c("y2") - c("y1"))
    end = lambda x, y: (F.when(c(x) < left, left).when(c(x) > right, right).otherwise(c(x)), F.when(c(x) < left, y_at(left)).when(c(x) > right, y_at(right)).otherwise(c(y)))
    (ax, ay), (bx, by) = end("x1", "y1"), end("x2", "y2")
    crosses = (c("x1") < left) != (c("x2") < left)
    sign = F.when(crosses, F.when(c("x1") < c("x2"), 1).otherwise(-1)).otherwise(0)
    ends = cols.withColumns({"ax": ax, "ay": ay, "bx": bx, "by": by, "sign": sign, "at": F.when(crosses, row_of(y_at(left), cell))})
    rows = ends.withColumn("gy", F.explode(F.sequence(row_of(F.least("ay", "by"), cell), row_of(F.greatest("ay", "by"), cell))))
    low, high = low_line(c("gy"), cell), low_line(c("gy") + 1, cell)
    x_at = lambda y: c("ax") + (y - c("ay")) / (c("by") - c("ay")) * (c("bx") - c("ax"))
    clip = lambda x, y: (F.when(c(y) < low, x_at(low)).when(c(y) > high, x_at(high)).otherwise(c(x)), F.when(c(y) < low, low).when(c(y) > high, high).otherwise(c(y)))
    (px1, py1), (px2, py2) = clip("ax", "ay"), clip("bx", "by")
    return rows.select(key, "gx", "gy", "x1", "y1", "x2", "y2", F.when(c("at") == c("gy"), c("sign")).otherwise(0).alias("cross"), px1.alias("px1"), py1.alias("py1"), px2.alias("px2"), py2.alias("py2"))


def cell_cover(segs: DataFrame, *, cell: float, key: str = "id", whole: bool = False) -> DataFrame:
    """(key, gx, gy, area, corner, parts): the cells that a polygon covers or its boundary passes.

    area is the polygon's within the cell. In edge cells ``parts`` has the
    pieces of the boundary (with ``whole`` the uncut segments) and ``corner``
    the winding number of the lower left corner; in inner cells both are null.
    A cell's pieces are one row, so the cells should be no larger than what a
    polygon of few segments spans.
    """
    found = pieces(segs, cell=cell, key=key)
    dx = F.col("px2") - F.col("px1")
    under = dx * ((F.col("py1") + F.col("py2")) / 2 - low_line(F.col("gy"), cell))
    part = F.struct(*[F.col(v if whole else f"p{v}").alias(v) for v in ("x1", "y1", "x2", "y2")])
    edge = found.groupBy(key, "gx", "gy").agg(F.sum(under).alias("under"), F.sum(dx).alias("dx"), F.sum("cross").alias("cross"), F.collect_list(part).alias("parts"))
    down = Window.partitionBy(key, "gx").orderBy(F.desc("gy"))
    above = F.coalesce(F.sum("dx").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    edge = edge.withColumns({"area": F.abs(F.col("under") + cell * above), "corner": F.sum("cross").over(down.rowsBetween(Window.unboundedPreceding, 0)), "below": F.lead("gy").over(down)})
    inner = edge.where("below < gy - 1 and corner % 2 <> 0").select(key, "gx", F.explode(F.sequence(F.col("below") + 1, F.col("gy") - 1)).alias("gy"), F.lit(float(cell) * cell).alias("area"), F.lit(None).cast("long").alias("corner"), F.lit(None).cast(PIECE).alias("parts"))
    return edge.select(key, "gx", "gy", "area", "corner", "parts").union(inner)


def points_in_polygons(points: DataFrame, segs: DataFrame, *, cell: float, key: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """points with the key of each polygon that contains them; a point in several comes back for each.

    A point meets only the cells of its own place: an inner one contains it,
    in an edge one the boundary is counted on the way from the lower left
    corner up and then right to the point. Points on a boundary belong to one
    side of it: it counts what lies just above and right of the point. Points without a place are in no polygon.
    """
    px, py = F.col(f"`{x}`"), F.col(f"`{y}`")
    cover = cell_cover(segs, cell=cell, key=key, whole=True).select(F.col(key).alias("__key"), F.col("gx").alias("__gx"), F.col("gy").alias("__gy"), F.col("corner").alias("__corner"), F.col("parts").alias("__parts"))
    placed = points.where((F.abs(px) < float("inf")) & (F.abs(py) < float("inf"))).withColumns({"__gx": column_of(px, cell), "__gy": row_of(py, cell)})
    left = left_line(F.col("__gx"), cell)

    def crossed(s: Column) -> Column:
        high = s["y1"] + (left - s["x1"]) / (s["x2"] - s["x1"]) * (s["y2"] - s["y1"])
        up = ((s["x1"] < left) != (s["x2"] < left)) & (row_of(high, cell) == F.col("__gy")) & (high <= py)
        wide = s["x1"] + (py - s["y1"]) / (s["y2"] - s["y1"]) * (s["x2"] - s["x1"])
        across = ((s["y1"] <= py) != (s["y2"] <= py)) & (wide > left) & (wide <= px)
        return F.coalesce(up, F.lit(False)) != F.coalesce(across, F.lit(False))

    n = F.abs(F.col("__corner")) + F.size(F.filter("__parts", crossed))
    hit = placed.join(cover, ["__gx", "__gy"]).where(F.col("__parts").isNull() | (n % 2 == 1))
    return hit.select(*[F.col(f"`{c}`") for c in points.columns], F.col("__key").alias(key))


def zonal_sums(pixels: DataFrame, segs: DataFrame, *, pixel_area: float, cell: float, key: str = "id") -> DataFrame:
    """(key, year, total): yearly mean of each pixel (x, y, date, value) times its area, summed over the polygon that contains it."""
    yearly = pixels.groupBy("x", "y", F.year("date").alias("year")).agg(F.avg("value").alias("value"))
    return points_in_polygons(yearly, segs, cell=cell, key=key).groupBy(key, "year").agg((F.sum("value") * pixel_area).alias("total"))


def _common_area(a: list[dict], corner_a: int, b: list[dict], corner_b: int, left: float, low: float, size: float) -> float:
    """The area that two polygons have in common within a cell, from their pieces there.

    The cell is cut into upright slabs in which no two pieces cross or end; in
    a slab the pieces stand one over the other, so the heights in its middle
    times its width are exact.
    """
    lines = [[(p["x1"], p["y1"], p["x2"], p["y2"]) if p["x1"] <= p["x2"] else (p["x2"], p["y2"], p["x1"], p["y1"]) for p in side] for side in (a, b)]
    stops = {left, left + size}
    for side in lines:
        stops.update(v for p in side for v in (p[0], p[2]))
    for ax, ay, bx, by in lines[0]:
        if ax == bx:
            continue
        slope = (by - ay) / (bx - ax)
        for cx, cy, dx, dy in lines[1]:
            lo, hi = max(ax, cx), min(bx, dx)
            if lo < hi:
                other = (dy - cy) / (dx - cx)
                first, last = ay + (lo - ax) * slope - cy - (lo - cx) * other, ay + (hi - ax) * slope - cy - (hi - cx) * other
                if (first < 0 < last) or (last < 0 < first):
                    stops.add(lo + (hi - lo) * first / (first - last))
    # Ends on the cell's lower line, where the boundary goes in and out below.
    feet = [sorted(v for p in side for v, w in ((p[0], p[1]), (p[2], p[3])) if w == low) for side in lines]
    inside = [corner_a % 2, corner_b % 2]
    at = [0, 0]
    total = 0.0
    ordered = sorted(stops)
    for x0, x1 in zip(ordered, ordered[1:], strict=False):
        mid = (x0 + x1) / 2
        if not x0 < mid < x1:
            continue
        for k in (0, 1):
            while at[k] < len(feet[k]) and feet[k][at[k]] <= mid:
                at[k] += 1
        state = [(inside[k] + at[k]) % 2 for k in (0, 1)]
        marks = sorted((p[1] + (mid - p[0]) / (p[2] - p[0]) * (p[3] - p[1]), k) for k in (0, 1) for p in lines[k] if p[0] < mid < p[2])
        y, height = low, 0.0
        for value, k in [*marks, (low + size, 2)]:
            if state[0] and state[1]:
                height += value - y
            y = value
            if k < 2:
                state[k] ^= 1
        total += height * (x1 - x0)
    return total


def overlay_areas(left: DataFrame, right: DataFrame, *, cell: float, left_key: str = "left_id", right_key: str = "right_id") -> DataFrame:
    """(left_id, right_id, area) of every two polygons that have an area in common, from their segments.

    They meet cell by cell. Where one of the two covers a cell, the other's
    area there counts; only cells that both boundaries pass are worked out by
    geometry. Rounding leaves areas below a billionth of a cell; these don't
    count as common.
    """
    a = cell_cover(left, cell=cell, key=left_key).withColumnsRenamed({"area": "a_area", "corner": "a_corner", "parts": "a_parts"})
    b = cell_cover(right, cell=cell, key=right_key).withColumnsRenamed({"area": "b_area", "corner": "b_corner", "parts": "b_parts"})
    met = a.join(b, ["gx", "gy"])
    plain = met.where("a_parts is null or b_parts is null").select(left_key, right_key, F.when(F.col("a_parts").isNull(), F.col("b_area")).otherwise(F.col("a_area")).alias("area"))
    size = float(cell)
    kinds = dict(met.dtypes)

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = zip(*(part.column(k).to_pylist() for k in ("a_parts", "a_corner", "b_parts", "b_corner", "left", "low")), strict=True)
            area = [_common_area(*r, size) for r in rows]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(area, pa.float64())], [left_key, right_key, "area"])

    both = met.where("a_parts is not null and b_parts is not null").select(left_key, right_key, "a_parts", "a_corner", "b_parts", "b_corner", left_line(F.col("gx"), cell).alias("left"), low_line(F.col("gy"), cell).alias("low"))
    exact = both.mapInArrow(work, f"`{left_key}` {kinds[left_key]}, `{right_key}` {kinds[right_key]}, area double")
    return plain.union(exact).groupBy(left_key, right_key).agg(F.sum("area").alias("area")).where(F.col("area") > size * size * 1e-9)


def shapes(segs: DataFrame, *, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(segments, members): each polygon that differs from all others once, under the least key, and (key, shape) with that key for every polygon.

    Polygons are the same if all their segments are, in the same order. What
    depends on the place and form of a polygon alone is the same for all of
    them, so it is worked out once and handed to the members.
    """
    side = F.struct("ring", "seq", *[F.col(v).cast("double").alias(v) for v in ("x1", "y1", "x2", "y2")])
    whole = segs.groupBy(key).agg(F.sort_array(F.collect_list(side)).alias("__sides"))
    whole = cut(whole.withColumn("__mark", F.sha2(F.to_json("__sides"), 256)))
    kinds = cut(whole.groupBy("__mark").agg(F.min(key).alias("shape"), F.first("__sides").alias("__sides")))
    members = whole.select(key, "__mark").join(kinds.select("__mark", "shape"), "__mark").select(key, "shape")
    return kinds.select(F.col("shape").alias(key), F.inline("__sides")), members


def interpolate(sources: DataFrame, values: DataFrame, targets: DataFrame, *, cell: float, columns: list[str]) -> DataFrame:
    """(id, columns) of every target polygon: the sources' values (id, columns), each by the share of its area that lies in the target; 0 where none does.

    Equal polygons are overlaid once, as in all that follows here.
    """
    (left, of_left), (right, of_right) = shapes(sources), shapes(targets)
    areas = overlay_areas(left.withColumnRenamed("id", "left_id"), right.withColumnRenamed("id", "right_id"), cell=cell)
    whole = measures(left).select(F.col("id").alias("left_id"), F.col("area").alias("whole"))
    given = values.select("id", *columns).join(of_left, "id").groupBy(F.col("shape").alias("left_id")).agg(*[F.sum(c).alias(c) for c in columns]).join(whole, "left_id")
    sums = areas.join(given, "left_id").groupBy(F.col("right_id").alias("shape")).agg(*[F.sum(F.col("area") / F.col("whole") * F.col(c)).alias(c) for c in columns])
    return of_right.join(sums, "shape", "left").fillna(0.0, columns).select("id", *columns)


def overlap_shares(zones: DataFrame, others: DataFrame, *, cell: float) -> DataFrame:
    """(id, share): how much of each zone's area the other polygons cover, each by itself; zones that none meets get 0."""
    (left, of_left), (right, of_right) = shapes(zones), shapes(others)
    areas = overlay_areas(left.withColumnRenamed("id", "left_id"), right.withColumnRenamed("id", "right_id"), cell=cell)
    copies = of_right.groupBy(F.col("shape").alias("right_id")).agg(F.count("*").alias("n"))
    sums = areas.join(copies, "right_id").groupBy(F.col("left_id").alias("id")).agg(F.sum(F.col("area") * F.col("n")).alias("covered"))
    shares = measures(left).select("id", F.col("area").alias("whole")).join(sums, "id", "left").select(F.col("id").alias("shape"), (F.coalesce("covered", F.lit(0.0)) / F.col("whole")).alias("share"))
    return of_left.join(shares, "shape").select("id", "share")


def polygon_means(zones: DataFrame, others: DataFrame, values: DataFrame, *, cell: float, columns: list[str]) -> DataFrame:
    """(id, columns): the plain mean of the values (id, columns) of the polygons that a zone has an area in common with; null where there is none."""
    (left, of_left), (right, of_right) = shapes(zones), shapes(others)
    areas = overlay_areas(left.withColumnRenamed("id", "left_id"), right.withColumnRenamed("id", "right_id"), cell=cell)
    known = values.select("id", *columns).join(of_right, "id").groupBy(F.col("shape").alias("right_id")).agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("sum", F.sum), ("n", F.count))])
    mean = lambda c: F.try_divide(F.sum(f"__sum_{c}").cast("double"), F.sum(f"__n_{c}"))
    means = areas.join(known, "right_id").groupBy(F.col("left_id").alias("shape")).agg(*[mean(c).alias(c) for c in columns])
    return of_left.join(means, "shape", "left").select("id", *columns)


def oriented(segs: DataFrame, key: str = "id") -> DataFrame:
    """segs with every polygon's area to the left of its segments, whichever way its rings ran."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    turned = F.sum(cross).over(Window.partitionBy(key)) < 0
    marked = segs.withColumn("__turned", turned)
    swap = {a: F.when(F.col("__turned"), F.col(b)).otherwise(F.col(a)) for a, b in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))}
    return marked.select(*[swap.get(c, F.col(f"`{c}`")).alias(c) for c in segs.columns])


def _rounds(state: DataFrame, again) -> DataFrame:
    """state after as many rounds of again, which returns the next state and the rows it changed, as it takes until none changes."""
    while True:
        state, changed = again(state)
        if not changed:
            return state


def dissolve(segs: DataFrame, *, key: str = "group", straight: bool = True) -> DataFrame:
    """The outlines (key, ring, seq, x1, y1, x2, y2) of all polygons of a group together.

    The polygons' area is to the left of their segments (see :func:`oriented`)
    and they touch along whole segments or not at all. Segments that two of
    them run through in opposite ways go; of the others each is followed by
    the one that bounds the same area, so parts that touch in a corner stay
    rings of their own and holes run the other way round. Rings are found by
    pointers that double their reach, so a ring of n segments takes log n
    rounds. A ring begins at its least corner; its number is that segment's
    place among all. ``straight`` leaves out corners within a straight side.
    """
    c = F.col
    forward = (c("x1") < c("x2")) | ((c("x1") == c("x2")) & (c("y1") < c("y2")))
    pick = lambda a, b: F.when(forward, c(a)).otherwise(c(b))
    both = segs.where("x1 <> x2 or y1 <> y2").select(key, pick("x1", "x2").alias("ax"), pick("y1", "y2").alias("ay"), pick("x2", "x1").alias("bx"), pick("y2", "y1").alias("by"), F.when(forward, 1).otherwise(-1).alias("way"))
    left = both.groupBy(key, "ax", "ay", "bx", "by").agg(F.sum("way").alias("way")).where("way <> 0")
    turn = lambda a, b: F.when(c("way") > 0, c(a)).otherwise(c(b))
    sides = left.select(key, turn("ax", "bx").alias("x1"), turn("ay", "by").alias("y1"), turn("bx", "ax").alias("x2"), turn("by", "ay").alias("y2"))
    sides = cut(with_places(sides, [c(key), c("x1"), c("y1"), c("x2"), c("y2")], "side"))
    # Of the sides that leave a corner, the one that comes first clockwise from where the other came.
    back, out = F.atan2(c("y1") - c("y2"), c("x1") - c("x2")), F.atan2(c("y2") - c("y1"), c("x2") - c("x1"))
    arriving = sides.select(key, c("x2").alias("x"), c("y2").alias("y"), "side", back.alias("back"))
    leaving = sides.select(key, c("x1").alias("x"), c("y1").alias("y"), c("side").alias("next"), out.alias("out"))
    angle = F.pmod(c("back") - c("out"), F.lit(2 * math.pi))
    link = arriving.join(leaving, [key, "x", "y"]).groupBy("side").agg(F.min_by("next", F.struct(F.when(angle == 0, 2 * math.pi).otherwise(angle).alias("a"), "next")).alias("next"))
    link = cut(link)

    def least(state: DataFrame) -> tuple[DataFrame, bool]:
        ahead = state.select(c("side").alias("to"), c("to").alias("further"), c("least").alias("there"))
        after = cut(state.join(ahead, "to").select("side", c("further").alias("to"), F.least("least", "there").alias("least"), (c("there") < c("least")).alias("moved")))
        return after, not after.where("moved").isEmpty()

    def count(state: DataFrame) -> tuple[DataFrame, bool]:
        behind = state.select(c("side").alias("to"), c("to").alias("further"), c("seq").alias("more"))
        after = cut(state.join(behind, "to", "left").select("side", c("further").alias("to"), (c("seq") + F.coalesce("more", F.lit(0))).alias("seq"), "ring"))
        return after, not after.where("to is not null").isEmpty()

    rings = _rounds(link.select("side", c("next").alias("to"), c("side").alias("least")), least).select("side", c("least").alias("ring"))
    before = link.select(c("next").alias("side"), c("side").alias("to")).join(rings, "side")
    head = c("side") == c("ring")
    places = _rounds(before.select("side", F.when(~head, c("to")).alias("to"), F.when(head, 0).otherwise(1).cast("long").alias("seq"), "ring"), count)
    found = sides.join(places.select("side", "ring", "seq"), "side").select(key, "ring", "seq", "x1", "y1", "x2", "y2")
    return straightened(found, key=key) if straight else found


def straightened(segs: DataFrame, *, key: str = "id") -> DataFrame:
    """segs without the corners at which a ring goes straight on; seq counts anew from the first that is left."""
    ring = Window.partitionBy(key, "ring").orderBy("seq")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = lambda v: F.coalesce(F.lag(v).over(ring), F.last(v).over(whole))
    seen = segs.withColumns({"__x": before("x1"), "__y": before("y1")})
    bend = (F.col("x1") - F.col("__x")) * (F.col("y2") - F.col("y1")) - (F.col("y1") - F.col("__y")) * (F.col("x2") - F.col("x1"))
    corners = seen.where(bend != 0).select(key, "ring", (F.row_number().over(ring) - 1).alias("seq"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    return segments(corners, key)


def merge_polygons(segs: DataFrame, attributes: DataFrame, merged: DataFrame, *, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(segments, attributes) with some polygons replaced by one that is all of them together.

    ``merged``: key, into (the key of the new polygon) and the new polygon's
    values in the columns of ``attributes``; the values of one row for each
    new polygon are taken, the least. Polygons that ``merged`` doesn't name
    stay as they are.
    """
    new = merged.select(F.col("into").alias("__into"), F.col(key)).where(F.col(key).isNotNull())
    parts = oriented(segs, key).join(new, key)
    outlines = dissolve(parts, key="__into").withColumnRenamed("__into", key)
    rest = [c for c in attributes.columns if c != key]
    values = merged.groupBy("into").agg(F.min(F.struct(*rest)).alias("v")).select(F.col("into").alias(key), *[F.col(f"v.`{c}`").alias(c) for c in rest])
    gone = new.select(key)
    kept = segs.join(gone, key, "left_anti").select(*outlines.columns)
    return kept.union(outlines), attributes.join(gone, key, "left_anti").unionByName(values)


def segment_box_distance() -> Column:
    """Distance of the segment (x1 y1 x2 y2) and the box (u0 v0 u1 v1) of a row; 0 if they touch."""
    c = F.col
    dx, dy = c("x2") - c("x1"), c("y2") - c("y1")
    enter, leave, possible = F.lit(0.0), F.lit(1.0), F.lit(True)
    for step, room in ((-dx, c("x1") - c("u0")), (dx, c("u1") - c("x1")), (-dy, c("y1") - c("v0")), (dy, c("v1") - c("y1"))):
        at = F.try_divide(room, step)
        enter = F.greatest(enter, F.when(step < 0, at))
        leave = F.least(leave, F.when(step > 0, at))
        possible = possible & ((step != 0) | (room >= 0))
    apart = lambda x, y: F.hypot(F.greatest(c("u0") - x, x - c("u1"), F.lit(0.0)), F.greatest(c("v0") - y, y - c("v1"), F.lit(0.0)))
    length = dx * dx + dy * dy

    def corner(u: str, v: str) -> Column:
        t = F.least(F.greatest(F.coalesce(F.try_divide((c(u) - c("x1")) * dx + (c(v) - c("y1")) * dy, length), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
        return F.hypot(c("x1") + t * dx - c(u), c("y1") + t * dy - c(v))

    return F.when(possible & (enter <= leave), 0.0).otherwise(F.least(apart(c("x1"), c("y1")), apart(c("x2"), c("y2")), *[corner(u, v) for u in ("u0", "u1") for v in ("v0", "v1")]))


def distances_to_boxes(segs: DataFrame, boxes: DataFrame, *, group: list[str], size: float, key: str = "id", cell: float | None = None) -> DataFrame:
    """(key, group, d) for every polygon and every group of boxes: the distance to the nearest box, 0 if one touches the polygon or lies in it.

    ``boxes``: the columns of ``group``, u0, v0, u1, v1; ``size`` is about a
    box's width. Boxes stand in blocks of 8 x 8 sizes, and these in blocks of
    8 x 8. From the large blocks on, a polygon keeps those of a group whose
    bounds can hold a box nearer than the nearest known one, and its segments
    by sixteens likewise; only what is left is measured. So of a group's boxes
    the near ones meet a polygon, not all. Equal polygons are measured once.
    """
    once, members = shapes(segs, key=key)
    found = shape_distances(once, boxes, group=group, size=size, key=key, cell=cell)
    return members.join(found.withColumnRenamed(key, "shape"), "shape").select(key, *[f"`{g}`" for g in group], "d")


def shape_distances(segs: DataFrame, boxes: DataFrame, *, group: list[str], size: float, key: str = "id", cell: float | None = None) -> DataFrame:
    """What :func:`distances_to_boxes` returns, for polygons that all differ (see :func:`shapes`)."""
    c = F.col
    names = [f"`{g}`" for g in group]
    bounds = lambda: [F.min("u0").alias("u0"), F.min("v0").alias("v0"), F.max("u1").alias("u1"), F.max("v1").alias("v1"), F.min(F.struct("u0", "v0", "u1", "v1")).alias("one")]
    at = lambda v, k: F.floor(c(v) / (size * k))
    tiled = boxes.withColumns({"bx": at("u0", 8), "by": at("v0", 8), "sx": at("u0", 64), "sy": at("v0", 64)})
    small = tiled.groupBy(*names, "sx", "sy", "bx", "by").agg(*bounds())
    large = tiled.groupBy(*names, "sx", "sy").agg(*bounds())
    runs = segs.withColumn("run", F.floor(c("seq") / 16)).select(key, "ring", "run", "x1", "y1", "x2", "y2")
    frame = [F.min(F.least("x1", "x2")).alias("x0"), F.min(F.least("y1", "y2")).alias("y0"), F.max(F.greatest("x1", "x2")).alias("x9"), F.max(F.greatest("y1", "y2")).alias("y9"), F.min(F.struct("x1", "y1")).alias("p")]
    spans = runs.groupBy(key, "ring", "run").agg(*frame)
    zones = runs.groupBy(key).agg(*frame)
    low = F.hypot(F.greatest(c("u0") - c("x9"), c("x0") - c("u1"), F.lit(0.0)), F.greatest(c("v0") - c("y9"), c("y0") - c("v1"), F.lit(0.0)))
    one = F.hypot(F.greatest(c("one.u0") - c("p.x1"), c("p.x1") - c("one.u1"), F.lit(0.0)), F.greatest(c("one.v0") - c("p.y1"), c("p.y1") - c("one.v1"), F.lit(0.0)))
    known = Window.partitionBy(key, *names)

    def nearest(pairs: DataFrame, keep: list[str]) -> DataFrame:
        """The pairs that may hold the nearest box; a hair more than the bound, for rounding."""
        return pairs.withColumns({"low": low, "high": F.min(one).over(known)}).where("low <= high * (1 + 1e-12)").select(*keep)

    first = nearest(zones.join(large), [key, *names, "sx", "sy"])
    second = nearest(first.join(small, [*group, "sx", "sy"]).join(zones, key), [key, *names, "bx", "by"])
    third = nearest(second.join(small.drop("sx", "sy"), [*group, "bx", "by"]).join(spans, key), [key, *names, "bx", "by", "ring", "run"])
    met = third.join(runs, [key, "ring", "run"]).join(tiled.drop("sx", "sy"), [*group, "bx", "by"])
    measured = met.select(key, *names, segment_box_distance().alias("d"))
    # A box within a polygon touches none of its segments.
    centres = boxes.select(*names, ((c("u0") + c("u1")) / 2).alias("__x"), ((c("v0") + c("v1")) / 2).alias("__y"))
    within = points_in_polygons(centres, segs, cell=cell or 8 * size, key=key, x="__x", y="__y").select(key, *names, F.lit(0.0).alias("d"))
    return measured.union(within).groupBy(key, *names).agg(F.min("d").alias("d"))
