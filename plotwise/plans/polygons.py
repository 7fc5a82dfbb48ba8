"""Polygon operators as queries: concave plots, plots with holes, and triangles, whose areas SQL can give.

Plots stand on the customers (or suppliers), so their number grows with the
tables. By the key modulo 3 a plot is an L, a frame or a right triangle; SQL
takes the first two as boxes side by side.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import exposure, geometry, grid, names, overlay
from .registry import R4, query, r4, table
from .spatial import COARSE, GRID, MESH_SQL, PIXELS_SQL, POINTS_SQL, _ROOT_SQL, coarse_clusters, mesh, points

# Corners of the three shapes, ring by ring; holes run the other way round.
SHAPES = (
    [[(0, 0), (1500, 0), (1500, 600), (500, 600), (500, 1200), (0, 1200)]],
    [[(0, 0), (1500, 0), (1500, 1200), (0, 1200)], [(400, 300), (400, 900), (1100, 900), (1100, 300)]],
    [[(0, 0), (1200.25, 0), (0, 1200.25)]],
)
PARTS = ((0, 0, 0, 1500, 600), (0, 0, 600, 500, 1200), (1, 0, 0, 1500, 300), (1, 0, 900, 1500, 1200), (1, 0, 300, 400, 900), (1, 1100, 300, 1500, 900))
LEG = 1200.25


def _plots_sql(key: str, source: str) -> str:
    return f"(SELECT {key} AS id, {key} % 3 AS kind, CAST(({key} * 37) % 180 * 100 + {key} % 7 AS DOUBLE) AS x0, CAST(({key} * 53) % 180 * 100 + {key} % 11 AS DOUBLE) AS y0 FROM {source})"


def _parts_sql(plots: str) -> str:
    return f"(SELECT id, x0 + a AS x0, y0 + b AS y0, x0 + c AS x1, y0 + d AS y1 FROM {plots} JOIN (VALUES {', '.join(map(str, PARTS))}) v(kind, a, b, c, d) USING (kind))"


def plots(spark, d, source="customer", key="c_custkey", kinds=(0, 1, 2)):
    """(id, ring, seq, x1, y1, x2, y2) of the plots."""
    k = F.col(key)
    corner = lambda r, s, x, y: F.struct(F.lit(r).alias("ring"), F.lit(s).alias("seq"), F.lit(float(x)).alias("dx"), F.lit(float(y)).alias("dy"))
    shape = [F.array(*[corner(r, s, x, y) for r, ring in enumerate(rings) for s, (x, y) in enumerate(ring)]) for rings in SHAPES]
    rows = table(spark, d, source).where((k % 3).isin(*kinds)).select(k.alias("id"), (k * 37 % 180 * 100 + k % 7).alias("x0"), (k * 53 % 180 * 100 + k % 11).alias("y0"), F.explode(F.when(k % 3 == 0, shape[0]).when(k % 3 == 1, shape[1]).otherwise(shape[2])).alias("c"))
    return geometry.segments(rows.select("id", "c.ring", "c.seq", (F.col("x0") + F.col("c.dx")).alias("x"), (F.col("y0") + F.col("c.dy")).alias("y")))


PLOTS_SQL = _plots_sql("c_custkey", "customer")
_PARTS_SQL = _parts_sql(PLOTS_SQL)


def _right(u: str, v: str) -> str:
    """The area of a triangle right of u and above v, both from its right angle."""
    return f"power(greatest({LEG} - greatest({u}, 0) - greatest({v}, 0), 0), 2) / 2"


#: The area of plots (p) within boxes (m): (id, mid, v, a).
_BOX_AREA = "greatest(0, least(p.x1, m.x1) - greatest(p.x0, m.x0)) * greatest(0, least(p.y1, m.y1) - greatest(p.y0, m.y0))"
_TRIANGLE_AREA = f"{_right('m.x0 - p.x0', 'm.y0 - p.y0')} - {_right('m.x1 - p.x0', 'm.y0 - p.y0')} - {_right('m.x0 - p.x0', 'm.y1 - p.y0')} + {_right('m.x1 - p.x0', 'm.y1 - p.y0')}"
COMMON_SQL = f"""(SELECT id, mid, any_value(v) AS v, sum(a) AS a FROM (SELECT p.id, m.id AS mid, m.v, {_BOX_AREA} AS a FROM {_PARTS_SQL} p JOIN {MESH_SQL} m ON {_BOX_AREA} > 0
 UNION ALL SELECT p.id, m.id, m.v, {_TRIANGLE_AREA} FROM {PLOTS_SQL} p JOIN {MESH_SQL} m ON p.kind = 2 AND m.x1 > p.x0 AND m.y1 > p.y0 AND m.x0 < p.x0 + {LEG} AND m.y0 < p.y0 + {LEG}) GROUP BY 1, 2 HAVING sum(a) > 1e-3)"""
_WHOLE_SQL = f"(SELECT id, CASE kind WHEN 0 THEN 1200000 WHEN 1 THEN 1380000 ELSE {LEG * LEG / 2} END AS whole FROM {PLOTS_SQL})"


@query("g3_plot_measures", f"SELECT id, whole AS area, x0, y0, x0 + CASE kind WHEN 2 THEN {LEG} ELSE 1500 END AS x1, y0 + CASE kind WHEN 2 THEN {LEG} ELSE 1200 END AS y1 FROM {PLOTS_SQL} JOIN {_WHOLE_SQL} USING (id)")
def g3_plots(spark, d):
    return geometry.measures(plots(spark, d)).select("id", "area", "x0", "y0", "x1", "y1")


@query("g21_plot_interior_point", f"SELECT id, true AS inside FROM {PLOTS_SQL}")
def g21_plots(spark, d):
    segs = plots(spark, d)
    own = overlay.points_in_polygons(geometry.interior_point(segs).withColumnRenamed("id", "of"), segs, cell=500.0, x="px", y="py").where("of = id")
    return segs.select("id").distinct().join(own.select("id", F.lit(True).alias("inside")), "id", "left").fillna(False, ["inside"])


@query("j12_polygon_overlap", f"SELECT id, {R4('coalesce(sum(a), 0) / any_value(whole)')} AS share FROM {_WHOLE_SQL} LEFT JOIN {COMMON_SQL} USING (id) GROUP BY 1")
def j12_polygons(spark, d):
    return overlay.overlap_shares(plots(spark, d), geometry.box_segments(mesh(spark, d)), cell=1000.0).withColumn("share", r4(F.col("share")))


@query("j11_polygon_interpolation", f"SELECT m.id, {R4('coalesce(v, 0)')} AS c_acctbal FROM {MESH_SQL} m LEFT JOIN (SELECT mid AS id, sum(a / whole * c_acctbal) AS v FROM {COMMON_SQL} JOIN {_WHOLE_SQL} USING (id) JOIN customer ON c_custkey = id GROUP BY 1) s ON s.id = m.id".replace("coalesce(v, 0)", "coalesce(s.v, 0)"))
def j11_polygons(spark, d):
    values = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    return overlay.interpolate(plots(spark, d), values, geometry.box_segments(mesh(spark, d)), cell=1000.0, columns=["c_acctbal"]).withColumn("c_acctbal", r4(F.col("c_acctbal")))


@query("j10_polygon_means", f"SELECT p.id, {R4('avg(c.v)')} AS v FROM {PLOTS_SQL} p LEFT JOIN {COMMON_SQL} c ON c.id = p.id GROUP BY 1")
def j10_polygons(spark, d):
    cells = mesh(spark, d)
    return overlay.polygon_means(plots(spark, d), geometry.box_segments(cells), cells.select("id", "v"), cell=1000.0, columns=["v"]).withColumn("v", r4(F.col("v")))


_IN_SQL = f"(SELECT p.id, s.x, s.y, s.year, s.v FROM px s JOIN {_PARTS_SQL} p ON s.x > p.x0 AND s.x < p.x1 AND s.y > p.y0 AND s.y < p.y1 UNION ALL SELECT p.id, s.x, s.y, s.year, s.v FROM px s JOIN {PLOTS_SQL} p ON p.kind = 2 AND s.x > p.x0 AND s.y > p.y0 AND s.x - p.x0 + s.y - p.y0 < {LEG})"


@query("g23_polygon_sums", f"WITH px AS MATERIALIZED (SELECT x, y, CAST(year(ts) AS INTEGER) AS year, avg(value) AS v FROM {PIXELS_SQL} GROUP BY 1, 2, 3) SELECT id, year, {R4('sum(v) * 40000')} AS total FROM {_IN_SQL} GROUP BY 1, 2")
def g23_polygons(spark, d):
    e = F.col("event_id") % 10000
    px = table(spark, d, "events").select((F.floor(e / 100) * 200 + 100.5).alias("x"), (e % 100 * 200 + 100.5).alias("y"), F.col("ts").alias("date"), "value")
    return overlay.zonal_sums(px, plots(spark, d), pixel_area=40000.0, cell=400.0).withColumn("total", r4(F.col("total")))


_FILLED_SQL = f"(SELECT DISTINCT sector, floor(x / 250) AS i, floor(y / 250) AS j FROM {POINTS_SQL})"


@query("g5_dissolve", f"SELECT c.sector, CAST(count(*) * 62500 AS DOUBLE) AS area, CAST(sum(4 - (SELECT count(*) FROM {_FILLED_SQL} o WHERE o.sector = c.sector AND abs(o.i - c.i) + abs(o.j - c.j) = 1)) * 250 AS DOUBLE) AS perimeter FROM {_FILLED_SQL} c GROUP BY 1")
def g5(spark, d):
    cells = grid.cell_of(points(spark, d), GRID).select("sector", "cell").distinct().join(GRID.cells(spark), "cell")
    outline = overlay.dissolve(geometry.box_segments(cells.select("sector", F.col("bx0").alias("x0"), F.col("by0").alias("y0"), F.col("bx1").alias("x1"), F.col("by1").alias("y1")), "sector"), key="sector")
    perimeter = outline.groupBy("sector").agg(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("perimeter"))
    return geometry.measures(outline, "sector").select("sector", "area").join(perimeter, "sector")


# A tiling of squares on the suppliers, 1 km each, 20 to a row; every second block of four in a row becomes one polygon.
_TILES_SQL = "(SELECT s_suppkey AS k, s_suppkey // 4 AS block, s_suppkey % 20 AS i, s_suppkey // 20 AS j, s_name AS name FROM supplier)"


@query("p29_merge_polygons", f"SELECT CASE WHEN block % 2 = 0 THEN 1000000000 + block ELSE k END AS id, min(name) AS name, CAST(count(*) * 1000000 AS DOUBLE) AS area, CAST(2 * count(*) * 1000 + 2000 AS DOUBLE) AS perimeter FROM {_TILES_SQL} GROUP BY 1")
def p29_polygons(spark, d):
    k = F.col("s_suppkey")
    tiles = table(spark, d, "supplier").select(k.alias("id"), F.floor(k / 4).alias("block"), (k % 20 * 1000).cast("double").alias("x0"), (F.floor(k / 20) * 1000).cast("double").alias("y0"), F.col("s_name").alias("name"))
    merged = tiles.where("block % 2 = 0").select("id", (F.lit(1_000_000_000) + F.col("block")).alias("into"), "name")
    outline, names = overlay.merge_polygons(geometry.box_segments(tiles.withColumns({"x1": F.col("x0") + 1000, "y1": F.col("y0") + 1000})), tiles.select("id", "name"), merged)
    perimeter = outline.groupBy("id").agg(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("perimeter"))
    return names.join(geometry.measures(outline).select("id", "area"), "id").join(perimeter, "id")


# The tiles under names of the older registry; tiles of one name become one plot.
_OLD_NAMES = (("FRACC. BALBUENA", None), ("Balbuena Condominios", None), ("La Condesa", "La Condesa Seccio0n Norte"), ("valle de puebla", "Valle de Puebla Quinta Etapa"), ("Fraccionamiento Corceles", None), ("La Condesa Seccion Fontalba", None))
_NEW_NAMES = ("colonia balbuena", "colonia balbuena", "privadas condesa (norte)", "valle de puebla 5ta secc.", "corceles residencial", "fontalba residencial")
_NAMED_SQL = "(SELECT i, j, CASE (k // 2) % 6 " + " ".join(f"WHEN {n} THEN '{name}'" for n, name in enumerate(_NEW_NAMES)) + f" END AS name FROM {_TILES_SQL})"


@query("p25_harmonized_plots", f"SELECT a.name, CAST(count(*) * 1000000 AS DOUBLE) AS area, CAST(sum(4 - (SELECT count(*) FROM {_NAMED_SQL} b WHERE b.name = a.name AND abs(a.i - b.i) + abs(a.j - b.j) = 1)) * 1000 AS DOUBLE) AS perimeter FROM {_NAMED_SQL} a GROUP BY 1")
def p25_plots(spark, d):
    k, name, section = F.col("s_suppkey"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for n, (old, part) in enumerate(_OLD_NAMES):
        here = F.floor(k / 2) % 6 == n
        name, section = F.when(here, F.lit(old)).otherwise(name), F.when(here, F.lit(part)).otherwise(section)
    tiles = table(spark, d, "supplier").select(name.alias("name"), section.alias("section"), (k % 20 * 1000).cast("double").alias("x0"), (F.floor(k / 20) * 1000).cast("double").alias("y0"))
    named = names.older_names(tiles, "name", "section").withColumns({"x1": F.col("x0") + 1000, "y1": F.col("y0") + 1000})
    outline = overlay.dissolve(geometry.box_segments(named.select("name", "x0", "y0", "x1", "y1"), "name"), key="name")
    perimeter = outline.groupBy("name").agg(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("perimeter"))
    return geometry.measures(outline, "name").select("name", "area").join(perimeter, "name")


# Distances are from the plots of the suppliers that are made of boxes.
_ZONE_PARTS_SQL = _parts_sql(_plots_sql("s_suppkey", "supplier"))
_GAP = "sqrt(power(greatest({u} - z.x1, z.x0 - {u} - {w}, 0), 2) + power(greatest({v} - z.y1, z.y0 - {v} - {w}, 0), 2))"


def zone_plots(spark, d):
    return plots(spark, d, "supplier", "s_suppkey", (0, 1)).withColumnRenamed("id", "alt_id")


@query("g22_polygon_distance", f"SELECT z.id AS alt_id, b.sector, {R4('min(' + _GAP.format(u='b.i * 250', v='b.j * 250', w=250) + ')')} AS d FROM {_ZONE_PARTS_SQL} z, {_FILLED_SQL} b GROUP BY 1, 2")
def g22_polygons(spark, d):
    cells = grid.cell_of(points(spark, d), GRID).select("sector", "cell").distinct().join(GRID.cells(spark), "cell")
    boxes = cells.select("sector", F.col("bx0").alias("u0"), F.col("by0").alias("v0"), F.col("bx1").alias("u1"), F.col("by1").alias("v1"))
    return overlay.distances_to_boxes(zone_plots(spark, d), boxes, group=["sector"], size=250.0, key="alt_id").withColumn("d", r4(F.col("d")))


_CHOSEN_SQL = f"(SELECT r.sector, c.root, c.jobs, (r.cell // 20) * 1000 AS u0, (r.cell % 20) * 1000 AS v0 FROM roots r JOIN (SELECT sector, root, sum(num_jobs) AS jobs, sum(num_businesses) AS b FROM roots GROUP BY 1, 2) c USING (sector, root) WHERE c.jobs >= 500 AND c.b >= 2)"
_NEAR_SQL = f"(SELECT z.id AS alt_id, b.sector, b.root, any_value(b.jobs) AS jobs, min({_GAP.format(u='b.u0', v='b.v0', w=1000)}) AS d FROM {_ZONE_PARTS_SQL} z, {_CHOSEN_SQL} b GROUP BY 1, 2, 3)"


@query("g13_polygon_exposure", f"WITH roots AS MATERIALIZED (SELECT * FROM {_ROOT_SQL}), near AS MATERIALIZED (SELECT * FROM {_NEAR_SQL}) SELECT z.alt_id, s.sector, {R4('min(n.d)')} AS distance_m, coalesce(min(n.d) = 0, FALSE) AS overlaps, coalesce(sum(CASE WHEN n.d <= 2000 THEN n.jobs END), 0) AS jobs_within_2km, count(*) FILTER (n.d <= 5000) AS clusters_within_5km, {R4('coalesce(sum(n.jobs / power(n.d / 1000 + 0.25, 2)), 0)')} AS gravity_inv_sq FROM (SELECT DISTINCT id AS alt_id FROM {_ZONE_PARTS_SQL}) z CROSS JOIN (SELECT DISTINCT sector FROM {POINTS_SQL}) s LEFT JOIN near n ON n.alt_id = z.alt_id AND n.sector = s.sector GROUP BY 1, 2")
def g13_polygons(spark, d):
    members, clusters = coarse_clusters(spark, d)
    chosen = clusters.where("cluster_rank is not null").select("sector", "cluster_id", "cluster_rank", "num_jobs", "num_businesses", "area_km2", "cx", "cy")
    boxes = members.select("sector", "cluster_id", F.col("bx0").alias("u0"), F.col("by0").alias("v0"), F.col("bx1").alias("u1"), F.col("by1").alias("v1")).join(chosen, ["sector", "cluster_id"])
    e = exposure.cluster_exposure(zone_plots(spark, d), boxes, points(spark, d).select("sector").distinct(), size=COARSE.size)
    return e.select("alt_id", "sector", r4(F.col("distance_m")).alias("distance_m"), "overlaps", "jobs_within_2km", "clusters_within_5km", r4(F.col("gravity_inv_sq")).alias("gravity_inv_sq"))
