"""Planar geometry on plain columns.

Points are two numbers, boxes four, and polygons a table of segments:
id, ring, seq, x1, y1, x2, y2, each ring closed and run through once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantiles
from .relate import with_places

# The Lambert conformal conic projection of EPSG:6372 (GRS80).
A, INVERSE_F = 6378137.0, 298.257222101
LAT1, LAT2, LAT0, LON0, X0, Y0 = 17.5, 29.5, 12.0, -102.0, 2500000.0, 0.0

_E = math.sqrt(2 / INVERSE_F - 1 / INVERSE_F**2)


def _m(lat: float) -> float:
    return math.cos(lat) / math.sqrt(1 - (_E * math.sin(lat)) ** 2)


def _t(lat: float) -> float:
    s = _E * math.sin(lat)
    return math.tan(math.pi / 4 - lat / 2) / ((1 - s) / (1 + s)) ** (_E / 2)


_R1, _R2, _R0 = (math.radians(v) for v in (LAT1, LAT2, LAT0))
_N = (math.log(_m(_R1)) - math.log(_m(_R2))) / (math.log(_t(_R1)) - math.log(_t(_R2)))
_F = _m(_R1) / (_N * _t(_R1) ** _N)
_RHO0 = A * _F * _t(_R0) ** _N


def to_planar(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees to metres."""
    phi = F.radians(lat)
    s = F.sin(phi) * _E
    t = F.tan(math.pi / 4 - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(_E / 2))
    rho = F.pow(t, F.lit(_N)) * (A * _F)
    theta = F.radians(lon - LON0) * _N
    return rho * F.sin(theta) + X0, F.lit(_RHO0 + Y0) - rho * F.cos(theta)


def to_geographic(x: Column, y: Column) -> tuple[Column, Column]:
    """Metres to longitude and latitude in degrees; five rounds of the latitude's series are exact to a double."""
    dx, dy = x - X0, F.lit(_RHO0 + Y0) - y
    rho = F.sqrt(dx * dx + dy * dy)
    t = F.pow(rho / (A * _F), F.lit(1 / _N))
    phi = F.lit(math.pi / 2) - F.atan(t) * 2
    for _ in range(5):
        s = F.sin(phi) * _E
        phi = F.lit(math.pi / 2) - F.atan(t * F.pow((1 - s) / (1 + s), F.lit(_E / 2))) * 2
    return F.degrees(F.atan2(dx, dy) / _N) + LON0, F.degrees(phi)


def segments(polygons: DataFrame, key: str = "id") -> DataFrame:
    """Segments of polygons given as rows (id, ring, seq, x, y) of vertices; the last vertex leads to the first."""
    by = Window.partitionBy(key, "ring").orderBy("seq")
    first = Window.partitionBy(key, "ring").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(by), F.first(c).over(first))
    return polygons.select(key, "ring", "seq", F.col("x").alias("x1"), F.col("y").alias("y1"), nxt("x").alias("x2"), nxt("y").alias("y2"))


def box_segments(boxes: DataFrame, key: str = "id") -> DataFrame:
    """Segments of boxes (id, x0, y0, x1, y1)."""
    corners = F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.col(c).alias("c"), F.col(d).alias("d")) for a, b, c, d in (("x0", "y0", "x1", "y0"), ("x1", "y0", "x1", "y1"), ("x1", "y1", "x0", "y1"), ("x0", "y1", "x0", "y0"))])
    return boxes.select(key, F.lit(0).alias("ring"), F.posexplode(corners).alias("seq", "s")).select(key, "ring", "seq", F.col("s.a").alias("x1"), F.col("s.b").alias("y1"), F.col("s.c").alias("x2"), F.col("s.d").alias("y2"))


def measures(segs: DataFrame, key: str = "id") -> DataFrame:
    """(id, area, cx, cy, x0, y0, x1, y1): area and centroid by the shoelace sums, and bounds. Holes run the other way round."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    s = segs.groupBy(key).agg(F.sum(cross).alias("a2"), F.sum((F.col("x1") + F.col("x2")) * cross).alias("sx"), F.sum((F.col("y1") + F.col("y2")) * cross).alias("sy"), F.min("x1").alias("bx0"), F.min("y1").alias("by0"), F.max("x1").alias("bx1"), F.max("y1").alias("by1"))
    return s.select(key, (F.abs("a2") / 2).alias("area"), (F.col("sx") / (3 * F.col("a2"))).alias("cx"), (F.col("sy") / (3 * F.col("a2"))).alias("cy"), F.col("bx0").alias("x0"), F.col("by0").alias("y0"), F.col("bx1").alias("x1"), F.col("by1").alias("y1"))


def interior_point(segs: DataFrame, key: str = "id") -> DataFrame:
    """(id, px, py): the middle of the widest stretch of a polygon at half its height; of equal ones the leftmost."""
    mid = segs.groupBy(key).agg(((F.min("y1") + F.max("y1")) / 2).alias("py"))
    hit = segs.join(mid, key).where((F.col("y1") <= F.col("py")) != (F.col("y2") <= F.col("py")))
    x = F.col("x1") + (F.col("py") - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    by = Window.partitionBy(key).orderBy("x", "ring", "seq")
    stops = hit.select(key, "py", x.alias("x"), "ring", "seq").withColumns({"n": F.row_number().over(by), "nx": F.lead("x").over(by)})
    spans = stops.where("n % 2 = 1 and nx is not null")
    best = spans.groupBy(key).agg(F.max(F.struct((F.col("nx") - F.col("x")).alias("w"), (-F.col("x")).alias("m"), F.col("nx"), F.col("py"))).alias("b"))
    return best.select(key, ((F.col("b.nx") - F.col("b.m")) / 2).alias("px"), F.col("b.py").alias("py"))


def candidate_cells(boxes: DataFrame, cell: float, key: str = "id") -> DataFrame:
    """boxes (id, x0, y0, x1, y1) with every cell (gx, gy) that they touch."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / cell).cast("long"), F.floor(F.col(b) / cell).cast("long"))
    return boxes.withColumn("gx", F.explode(span("x0", "x1"))).withColumn("gy", F.explode(span("y0", "y1")))


def box_overlaps(left: DataFrame, right: DataFrame, *, cell: float) -> DataFrame:
    """(left_id, right_id, area): the common area of boxes (id, x0, y0, x1, y1) that overlap, through a join on cells."""
    a = candidate_cells(left.select(F.col("id").alias("left_id"), "x0", "y0", "x1", "y1"), cell, "left_id")
    b = candidate_cells(right.select(F.col("id").alias("right_id"), F.col("x0").alias("u0"), F.col("y0").alias("v0"), F.col("x1").alias("u1"), F.col("y1").alias("v1")).withColumnsRenamed({"u0": "x0", "v0": "y0", "u1": "x1", "v1": "y1"}), cell, "right_id").withColumnsRenamed({"x0": "u0", "y0": "v0", "x1": "u1", "y1": "v1"})
    pairs = a.join(b, ["gx", "gy"])
    w = F.least("x1", "u1") - F.greatest("x0", "u0")
    h = F.least("y1", "v1") - F.greatest("y0", "v0")
    # A pair that shares several cells counts once: in the one that holds the corner of the common box.
    corner = (F.floor(F.greatest("x0", "u0") / cell).cast("long") == F.col("gx")) & (F.floor(F.greatest("y0", "v0") / cell).cast("long") == F.col("gy"))
    return pairs.where((w > 0) & (h > 0) & corner).select("left_id", "right_id", (w * h).alias("area"))


def interpolate(sources: DataFrame, cells: DataFrame, *, cell: float, value: str) -> DataFrame:
    """(id, value) of each target cell: every source's value by the share of its area that lies in the cell; cells without one get 0."""
    share = box_overlaps(sources, cells, cell=cell).join(sources.select(F.col("id").alias("left_id"), F.col(value).alias("__v"), ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("__a")), "left_id")
    sums = share.groupBy(F.col("right_id").alias("id")).agg(F.sum(F.col("area") / F.col("__a") * F.col("__v")).alias(value))
    return cells.select("id").join(sums, "id", "left").fillna({value: 0.0})


def cell_means(zones: DataFrame, cells: DataFrame, *, cell: float, value: str) -> DataFrame:
    """(id, value): mean value of the cells that a zone's box meets, not weighted by area."""
    pairs = box_overlaps(zones, cells, cell=cell).select(F.col("left_id").alias("id"), F.col("right_id").alias("__c"))
    return pairs.join(cells.select(F.col("id").alias("__c"), value), "__c").groupBy("id").agg(F.avg(value).alias(value))


def overlap_shares(zones: DataFrame, others: DataFrame, *, cell: float) -> DataFrame:
    """(id, share): how much of each zone's area the other boxes cover; zones that none meets get 0."""
    sums = box_overlaps(zones, others, cell=cell).groupBy(F.col("left_id").alias("id")).agg(F.sum("area").alias("a"))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return zones.select("id", area.alias("whole")).join(sums, "id", "left").select("id", (F.coalesce("a", F.lit(0.0)) / F.col("whole")).alias("share"))


def box_distance() -> Column:
    """Distance of the boxes (x0 y0 x1 y1) and (u0 v0 u1 v1) of a row; 0 if they touch."""
    dx = F.greatest(F.col("u0") - F.col("x1"), F.col("x0") - F.col("u1"), F.lit(0.0))
    dy = F.greatest(F.col("v0") - F.col("y1"), F.col("y0") - F.col("v1"), F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def centroid_controls(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """df with centroid_east_km and centroid_north_km: kilometres from the median point."""
    missing = [c for c in (x, y) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    sides = df.select(F.col(x).cast("double").alias("__mx"), F.col(y).cast("double").alias("__my")).unpivot([], ["__mx", "__my"], "feature", "value")
    middle = F.col("middle")
    mid = quantiles(sides, {"middle": 0.5}).agg(*[F.max(F.when(F.col("feature") == c, middle)).alias(c) for c in ("__mx", "__my")])
    return df.join(F.broadcast(mid)).withColumns({"centroid_east_km": (F.col(x) - F.col("__mx")) / 1000, "centroid_north_km": (F.col(y) - F.col("__my")) / 1000}).drop("__mx", "__my")


def _guard(df: DataFrame, outputs: list[str]) -> None:
    missing = [c for c in ("centroid_east_km", "centroid_north_km") if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    there = [c for c in outputs if c in df.columns]
    if there:
        raise ValueError(f"columns already exist: {there}")


def quadratic_terms(df: DataFrame) -> DataFrame:
    """df with the squares and the product of the centroid controls."""
    e, n = F.col("centroid_east_km"), F.col("centroid_north_km")
    new = {"centroid_east_km_sq": e * e, "centroid_north_km_sq": n * n, "centroid_east_north_km": e * n}
    _guard(df, list(new))
    return df.withColumns(new)


def tercile(value: str, tie: str) -> Column:
    """0, 1 or 2 by rank of first occurrence, cut like quantiles of the ranks."""
    n = F.count("*").over(Window.partitionBy())
    rn = F.row_number().over(Window.orderBy(value, tie))
    return F.when(rn <= F.ceil((n - 1) / 3), 0).when(rn <= F.ceil(2 * (n - 1) / 3), 1).otherwise(2)


def with_terciles(df: DataFrame, value: str, tie: str, name: str = "tercile") -> DataFrame:
    """df with the same terciles as :func:`tercile` gives, found by ranges for tables of any size; ``tie`` is unique."""
    placed = with_places(df, [F.col(value).asc(), F.col(tie).asc()], "__place")
    rows = F.broadcast(df.agg((F.count("*") - 1).alias("__last")))
    place, last = F.col("__place"), F.col("__last")
    return placed.join(rows).withColumn(name, F.when(place < F.ceil(last / 3), 0).when(place < F.ceil(2 * last / 3), 1).otherwise(2)).drop("__place", "__last")


def grid_zones(df: DataFrame, key: str = "alt_id") -> DataFrame:
    """df (a row per alternative) with its zone on a 3 x 3 grid of terciles, and eight dummies; central_central is the reference."""
    ew, ns = ("west", "central", "east"), ("south", "central", "north")
    names = [f"{b}_{a}" for b in ns for a in ew if (a, b) != ("central", "central")]
    _guard(df, ["grid_zone", *[f"grid_zone_{n}" for n in names]])
    label = lambda c, words: F.element_at(F.array(*[F.lit(w) for w in words]), c + 1)
    placed = with_terciles(with_terciles(df, "centroid_east_km", key, "__e"), "centroid_north_km", key, "__n")
    zoned = placed.withColumn("grid_zone", F.concat_ws("_", label(F.col("__n"), ns), label(F.col("__e"), ew))).drop("__e", "__n")
    return zoned.withColumns({f"grid_zone_{n}": (F.col("grid_zone") == n).cast("int") for n in names})


def zone_catalog(zoned: DataFrame) -> DataFrame:
    """(zone, n, is_reference) of all nine zones."""
    spark = zoned.sparkSession
    rows = [(f"{b}_{a}",) for b in ("south", "central", "north") for a in ("west", "central", "east")]
    counts = zoned.groupBy(F.col("grid_zone").alias("zone")).agg(F.count("*").alias("n"))
    return spark.createDataFrame(rows, "zone string").join(counts, "zone", "left").select("zone", F.coalesce("n", F.lit(0)).alias("n"), (F.col("zone") == "central_central").alias("is_reference"))
