"""Spatial, network, feature and contract operators as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean
from ..operators import contracts, exposure, features, geometry, grid, network, overlay, relate
from ..operators.graph import cut
from .registry import ALTERNATIVES_SQL, R4, alternatives, query, r4, table

# Establishments: customers dealt over 20 km x 20 km with dense corners, off the edges of cells.
POINTS_SQL = """(SELECT id, CASE WHEN id % 2 = 0 THEN a ELSE 19999 - a END + 0.5 AS x, CASE WHEN id % 3 = 0 THEN 19999 - b ELSE b END + 0.5 AS y, sector, jobs FROM
 (SELECT c_custkey AS id, ((c_custkey * 37) % 141) * ((c_custkey * 37) % 141) AS a, ((c_custkey * 53) % 139) * ((c_custkey * 53) % 139) AS b, c_mktsegment AS sector,
 CASE c_custkey % 5 WHEN 0 THEN 3 WHEN 1 THEN 20 WHEN 2 THEN 175 WHEN 3 THEN 500 END AS jobs FROM customer))"""


def points(spark, d):
    k = F.col("c_custkey")
    a, b = (k * 37) % 141 * ((k * 37) % 141), (k * 53) % 139 * ((k * 53) % 139)
    size = F.when(k % 5 == 0, "0 a 5 personas").when(k % 5 == 1, "11 a 30 personas").when(k % 5 == 2, "101 a 250 personas").when(k % 5 == 3, "251 y más personas").otherwise("unknown")
    return table(spark, d, "customer").select(k.alias("id"), (F.when(k % 2 == 0, a).otherwise(19999 - a) + 0.5).cast("double").alias("x"), (F.when(k % 3 == 0, 19999 - b).otherwise(b) + 0.5).cast("double").alias("y"), F.col("c_mktsegment").alias("sector"), clean.workers(size).alias("jobs"))


ZONES_SQL = "(SELECT n_nationkey AS id, CAST((n_nationkey % 5) * 4000 AS DOUBLE) AS x0, CAST((n_nationkey // 5) * 4000 AS DOUBLE) AS y0, CAST((n_nationkey % 5) * 4000 + 1500 AS DOUBLE) AS x1, CAST((n_nationkey // 5) * 4000 + 1500 AS DOUBLE) AS y1 FROM nation)"


def zones(spark, d, key="id"):
    n = F.col("n_nationkey")
    x0, y0 = (n % 5 * 4000).cast("double"), (F.floor(n / 5) * 4000).cast("double")
    return table(spark, d, "nation").select(n.alias(key), x0.alias("x0"), y0.alias("y0"), (x0 + 1500).alias("x1"), (y0 + 1500).alias("y1"))


GRID = grid.Grid(0.0, 0.0, 80, 80, 250.0)
COARSE = grid.Grid(0.0, 0.0, 20, 20, 1000.0)


@query("g1_buffered_extent", f"SELECT min(x) - 1000 AS x0, min(y) - 1000 AS y0, max(x) + 1000 AS x1, max(y) + 1000 AS y1 FROM {POINTS_SQL}")
def g1(spark, d):
    return spark.createDataFrame([grid.buffered_extent(points(spark, d), 1000.0)], "x0 double, y0 double, x1 double, y1 double")


# The Lambert conformal conic projection with two standard parallels on GRS80, as the textbooks have it, from its defining numbers alone.
_E_SQL = "sqrt(2 / 298.257222101 - 1 / power(298.257222101, 2))"
_M_SQL = "cos(radians({0})) / sqrt(1 - power(k.e * sin(radians({0})), 2))"
_T_SQL = "tan(pi() / 4 - radians({0}) / 2) / power((1 - k.e * sin(radians({0}))) / (1 + k.e * sin(radians({0}))), k.e / 2)"
PLANAR_SQL = f"""WITH k0 AS (SELECT {_E_SQL} AS e), k AS (SELECT e, (ln({_M_SQL.format(17.5)}) - ln({_M_SQL.format(29.5)})) / (ln({_T_SQL.format(17.5)}) - ln({_T_SQL.format(29.5)})) AS n FROM k0 k),
 f AS (SELECT e, n, {_M_SQL.format(17.5)} / (n * power({_T_SQL.format(17.5)}, n)) AS f FROM k), p AS (SELECT id, x / 4000 - 105 AS lon, y / 4000 + 17 AS lat FROM {POINTS_SQL})
 SELECT id, {R4(f"6378137 * k.f * power({_T_SQL.format('lat')}, k.n) * sin(radians(lon + 102) * k.n) + 2500000")} AS px, {R4(f"6378137 * k.f * power({_T_SQL.format(12.0)}, k.n) - 6378137 * k.f * power({_T_SQL.format('lat')}, k.n) * cos(radians(lon + 102) * k.n)")} AS py, TRUE AS round_trip FROM p, f k"""


@query("g2_reprojection", PLANAR_SQL)
def g2(spark, d):
    p = points(spark, d).select("id", (F.col("x") / 4000 - 105).alias("lon"), (F.col("y") / 4000 + 17).alias("lat"))
    x, y = geometry.to_planar(F.col("lon"), F.col("lat"))
    p = p.withColumns({"px": x, "py": y})
    lon, lat = geometry.to_geographic(F.col("px"), F.col("py"))
    return p.select("id", r4(F.col("px")).alias("px"), r4(F.col("py")).alias("py"), ((F.abs(lon - F.col("lon")) < 1e-9) & (F.abs(lat - F.col("lat")) < 1e-9)).alias("round_trip"))


@query("g3_polygon_measures", f"SELECT id, (x1 - x0) * (y1 - y0) AS area, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, x0, y0, x1, y1 FROM {ZONES_SQL}")
def g3(spark, d):
    return geometry.measures(geometry.box_segments(zones(spark, d)))


CELLS_SQL = "(SELECT i AS cell, i // 80 AS col, i % 80 AS row FROM range(6400) t(i))"


@query("g4_grid", "SELECT cell, col, row, CAST(col * 250 AS DOUBLE) AS bx0, CAST(row * 250 AS DOUBLE) AS by0, CAST(col * 250 + 250 AS DOUBLE) AS bx1, CAST(row * 250 + 250 AS DOUBLE) AS by1, coalesce(n, 0) AS n FROM " + CELLS_SQL + f" LEFT JOIN (SELECT CAST(floor(x / 250) * 80 + floor(y / 250) AS BIGINT) AS cell, count(*) AS n FROM {POINTS_SQL} GROUP BY 1) USING (cell)")
def g4(spark, d):
    n = grid.cell_of(points(spark, d), GRID).groupBy("cell").agg(F.count("*").alias("n"))
    return GRID.cells(spark).join(n, "cell", "left").fillna({"n": 0})


@query("j9_point_in_cell", f"SELECT id, CAST(floor(x / 250) * 80 + floor(y / 250) AS BIGINT) AS cell FROM {POINTS_SQL}")
def j9(spark, d):
    return grid.cell_of(points(spark, d), GRID).select("id", "cell")


CELL_JOBS_SQL = f"""(SELECT s.sector, c.i AS cell, CAST(coalesce(num_jobs, 0) AS DOUBLE) AS num_jobs, coalesce(num_businesses, 0) AS num_businesses FROM (SELECT DISTINCT sector FROM {POINTS_SQL}) s CROSS JOIN range(400) c(i)
 LEFT JOIN (SELECT sector, CAST(floor(x / 1000) * 20 + floor(y / 1000) AS BIGINT) AS cell, sum(jobs) AS num_jobs, count(jobs) AS num_businesses FROM {POINTS_SQL} GROUP BY 1, 2) p ON p.sector = s.sector AND p.cell = c.i)"""


def coarse_cells(spark, d):
    p = points(spark, d)
    return grid.cell_jobs(p, COARSE, p.select("sector").distinct())


@query("a8_cell_aggregation", f"SELECT sector, cell, num_jobs, num_businesses, num_jobs AS jobs_per_km2, {R4('ln(1 + num_jobs)')} AS log_jobs FROM {CELL_JOBS_SQL}")
def a8(spark, d):
    return coarse_cells(spark, d).select("sector", "cell", "num_jobs", "num_businesses", "jobs_per_km2", r4(F.col("log_jobs")).alias("log_jobs"))


EDGES_SQL = "(SELECT a.i AS src, b.i AS dst FROM range(400) a(i) JOIN range(400) b(i) ON a.i <> b.i AND abs(a.i // 20 - b.i // 20) <= 1 AND abs(a.i % 20 - b.i % 20) <= 1)"


@query("g6_queen_weights", f"SELECT src, dst, {R4('1.0 / count(*) OVER (PARTITION BY src)')} AS weight, n FROM {EDGES_SQL} JOIN (SELECT cell AS dst, sum(num_businesses)::BIGINT AS n FROM {CELL_JOBS_SQL} GROUP BY 1) USING (dst)")
def g6(spark, d):
    n = coarse_cells(spark, d).groupBy(F.col("cell").alias("dst")).agg(F.sum("num_businesses").alias("n"))
    return grid.queen_edges(COARSE, spark).join(n, "dst").select("src", "dst", r4(F.col("weight")).alias("weight"), "n")


# The statistics are of the number of jobs. For p, each cell keeps its value and its k neighbours get those of the first k other cells in
# the order of md5(seed:permutation:cell); p is the share of permutations, and the observation, on the nearer side.
STATS_SQL = f"""(WITH c AS (SELECT *, num_jobs AS v FROM {CELL_JOBS_SQL}), z AS (SELECT *, (v - avg(v) OVER (PARTITION BY sector)) / stddev_pop(v) OVER (PARTITION BY sector) AS z, count(*) OVER (PARTITION BY sector) AS n FROM c),
 l AS (SELECT z.sector, e.src AS cell, avg(z.z) AS lag_z, sum(z.z) AS around, sum(z.v) AS around_v, count(*) AS k FROM {EDGES_SQL} e JOIN z ON z.cell = e.dst GROUP BY 1, 2),
 q AS MATERIALIZED (SELECT * FROM (SELECT p, i AS cell, row_number() OVER (PARTITION BY p ORDER BY md5('{exposure.SEED}:' || p || ':' || i), i) AS pos FROM range(1, {exposure.PERMUTATIONS + 1}) a(p), range(400) b(i)) WHERE pos <= 9),
 k AS (SELECT src AS cell, count(*) AS k FROM {EDGES_SQL} GROUP BY 1),
 d AS (SELECT k.cell, q.p, q.cell AS other FROM k JOIN q ON q.cell <> k.cell LEFT JOIN q o ON o.p = q.p AND o.cell = k.cell WHERE q.pos - CASE WHEN o.pos < q.pos THEN 1 ELSE 0 END <= k.k),
 s AS (SELECT z.sector, d.cell, d.p, sum(z.v) AS sim FROM d JOIN z ON z.cell = d.other GROUP BY 1, 2, 3),
 m AS (SELECT sector, cell, count(*) FILTER (sign(z.z) * s.sim >= sign(z.z) * l.around_v) AS larger, count(*) FILTER (s.sim >= l.around_v) AS higher, count(*) AS r FROM s JOIN z USING (sector, cell) JOIN l USING (sector, cell) GROUP BY 1, 2)
 SELECT z.*, l.lag_z, (z.n - 1) * z.z * l.lag_z / z.n AS local_i, (l.around + z.z) / sqrt((z.n * (l.k + 1) - (l.k + 1) * (l.k + 1)) / (z.n - 1)) AS gi,
 (least(larger, r - larger) + 1) / (r + 1) AS local_p, (least(higher, r - higher) + 1) / (r + 1) AS gi_p FROM z JOIN l USING (sector, cell) JOIN m USING (sector, cell))"""
_HIGH_SQL, _GI_SQL = "(z > 0 AND lag_z > 0 AND local_p < 0.05)", "(gi > 1.96 AND gi_p < 0.05)"
_SPOT_SQL = f"({_GI_SQL} AND (num_jobs > 0 OR {_HIGH_SQL}))"


def coarse_stats(spark, d):
    edges = grid.queen_edges(COARSE, spark)
    return cut(grid.local_permutation_p(grid.spatial_statistics(coarse_cells(spark, d), edges), edges, permutations=exposure.PERMUTATIONS, seed=exposure.SEED))


@query("g7_global_moran", f"SELECT sector, count(*) AS n, {R4('sum(z * lag_z) / sum(z * z)')} AS moran_i, {R4('-1.0 / (count(*) - 1)')} AS expected_i FROM {STATS_SQL} GROUP BY 1")
def g7(spark, d):
    m = grid.global_moran(coarse_cells(spark, d), grid.queen_edges(COARSE, spark))
    return m.select("sector", "n", r4(F.col("moran_i")).alias("moran_i"), r4(F.col("expected_i")).alias("expected_i"))


@query("g7_moran_permutation")
def g7p(spark, d):
    p = points(spark, d)
    cells = grid.cell_jobs(p, GRID, p.select("sector").distinct())
    return grid.moran_p(cells, grid.queen_edges(GRID, spark), value="num_jobs", permutations=exposure.PERMUTATIONS, seed=exposure.SEED)


@query("g8_local_moran", f"SELECT sector, cell, {R4('local_i')} AS local_moran_i, {R4('local_p')} AS local_moran_p, CASE WHEN z > 0 AND lag_z > 0 THEN 1 WHEN z <= 0 AND lag_z > 0 THEN 2 WHEN z <= 0 AND lag_z <= 0 THEN 3 ELSE 4 END AS quadrant FROM {STATS_SQL}")
def g8(spark, d):
    return coarse_stats(spark, d).select("sector", "cell", r4(F.col("local_moran_i")).alias("local_moran_i"), r4(F.col("local_moran_p")).alias("local_moran_p"), "quadrant")


@query("g9_getis_ord", f"SELECT sector, cell, {R4('gi')} AS getis_ord_z, {R4('gi_p')} AS getis_ord_p FROM {STATS_SQL}")
def g9(spark, d):
    return coarse_stats(spark, d).select("sector", "cell", r4(F.col("getis_ord_z")).alias("getis_ord_z"), r4(F.col("getis_ord_p")).alias("getis_ord_p"))


@query("g10_hotspot_flags", f"SELECT sector, cell, {_HIGH_SQL} AS is_high_high, {_GI_SQL} AS is_getis_hotspot, {_SPOT_SQL} AS is_hotspot_candidate FROM {STATS_SQL}")
def g10(spark, d):
    return grid.hotspots(coarse_stats(spark, d)).select("sector", "cell", "is_high_high", "is_getis_hotspot", "is_hotspot_candidate")


_CAND_SQL = f"(SELECT sector, cell, num_jobs, num_businesses FROM {STATS_SQL} WHERE {_SPOT_SQL})"
_ROOT_SQL = f"""(WITH RECURSIVE h AS MATERIALIZED (SELECT * FROM {_CAND_SQL}), e AS MATERIALIZED (SELECT a.sector, a.cell AS src, b.cell AS dst FROM h a JOIN h b ON a.sector = b.sector AND abs(a.cell // 20 - b.cell // 20) <= 1 AND abs(a.cell % 20 - b.cell % 20) <= 1),
 r(sector, cell, node) AS (SELECT sector, cell, cell FROM h UNION SELECT r.sector, r.cell, e.dst FROM r JOIN e ON e.sector = r.sector AND e.src = r.node)
 SELECT h.sector, h.cell, h.num_jobs, h.num_businesses, m.root FROM h JOIN (SELECT sector, cell, min(node) AS root FROM r GROUP BY 1, 2) m USING (sector, cell))"""


def coarse_clusters(spark, d):
    return grid.hotspot_clusters(grid.hotspots(coarse_stats(spark, d)), grid.queen_edges(COARSE, spark), min_jobs=500, min_businesses=2)


@query("g11_components", f"SELECT sector, cell, CAST(dense_rank() OVER (PARTITION BY sector ORDER BY root) AS INTEGER) AS cluster_id FROM {_ROOT_SQL}")
def g11(spark, d):
    return coarse_clusters(spark, d)[0].select("sector", "cell", "cluster_id")


@query("g12_clusters", f"SELECT sector, cluster_id, n_cells, num_jobs, num_businesses, CAST(row_number() OVER (PARTITION BY sector ORDER BY num_jobs DESC, n_cells DESC, cluster_id) AS INTEGER) AS cluster_rank_all FROM (SELECT sector, CAST(dense_rank() OVER (PARTITION BY sector ORDER BY root) AS INTEGER) AS cluster_id, n_cells, num_jobs, num_businesses FROM (SELECT sector, root, count(*) AS n_cells, sum(num_jobs) AS num_jobs, CAST(sum(num_businesses) AS BIGINT) AS num_businesses FROM {_ROOT_SQL} GROUP BY 1, 2))")
def g12(spark, d):
    return coarse_clusters(spark, d)[1].select("sector", "cluster_id", "n_cells", "num_jobs", "num_businesses", "cluster_rank_all")


def analysis(spark, d):
    return exposure.sector_analysis(points(spark, d), zones(spark, d, "alt_id"), grid=COARSE)


# The cells of the sector analysis, 250 m. The queries on COARSE go by the same rule on cells of 1 km, where the recursive SQL ends in time.
def fine_analysis(spark, d):
    return exposure.sector_analysis(points(spark, d), zones(spark, d, "alt_id"), grid=GRID)


@query("g10_hotspot_flags_permutation")
def g10_fine(spark, d):
    c = fine_analysis(spark, d).cells
    return c.select("sector", "cell", "num_jobs", "num_businesses", "local_moran_i", "quadrant", "local_moran_p", "getis_ord_z", "getis_ord_p", "is_high_high", "is_getis_hotspot", "is_hotspot_candidate")


@query("g12_clusters_permutation")
def g12_fine(spark, d):
    return fine_analysis(spark, d).clusters


@query("g13_cluster_exposure_permutation")
def g13_fine(spark, d):
    return fine_analysis(spark, d).exposure


@query("g17_sector_pipeline_permutation")
def g17_fine(spark, d):
    return exposure.sector_summary(fine_analysis(spark, d))


_BOXES_SQL = f"""(SELECT r.sector, r.cell, c.root, c.jobs, (r.cell // 20) * 1000 AS u0, (r.cell % 20) * 1000 AS v0 FROM {_ROOT_SQL} r JOIN (SELECT sector, root, sum(num_jobs) AS jobs, sum(num_businesses) AS b FROM {_ROOT_SQL} GROUP BY 1, 2) c USING (sector, root) WHERE c.jobs >= 500 AND c.b >= 2)"""
_NEAR_SQL = f"(SELECT z.id AS alt_id, b.sector, b.root, any_value(b.jobs) AS jobs, min(sqrt(power(greatest(b.u0 - z.x1, z.x0 - b.u0 - 1000, 0), 2) + power(greatest(b.v0 - z.y1, z.y0 - b.v0 - 1000, 0), 2))) AS d FROM {ZONES_SQL} z CROSS JOIN {_BOXES_SQL} b GROUP BY 1, 2, 3)"


@query("g13_cluster_exposure", f"SELECT z.id AS alt_id, s.sector, {R4('min(n.d)')} AS distance_m, coalesce(min(n.d) <= 2000, FALSE) AS within_2000m, coalesce(sum(CASE WHEN n.d <= 2000 THEN n.jobs END), 0) AS jobs_within_2km, count(*) FILTER (n.d <= 5000) AS clusters_within_5km, {R4('coalesce(sum(n.jobs / power(n.d / 1000 + 0.25, 2)), 0)')} AS gravity_inv_sq, {R4('coalesce(sum(n.jobs * exp(-n.d / 2000)), 0)')} AS gravity_exp FROM {ZONES_SQL} z CROSS JOIN (SELECT DISTINCT sector FROM {POINTS_SQL}) s LEFT JOIN {_NEAR_SQL} n ON n.alt_id = z.id AND n.sector = s.sector GROUP BY 1, 2")
def g13(spark, d):
    e = analysis(spark, d).exposure
    return e.select("alt_id", "sector", r4(F.col("distance_m")).alias("distance_m"), "within_2000m", "jobs_within_2km", "clusters_within_5km", r4(F.col("gravity_inv_sq")).alias("gravity_inv_sq"), r4(F.col("gravity_exp")).alias("gravity_exp"))


@query("g15_exposure_summary", f"SELECT alt_id, sector, {R4('d')} AS distance_m, jobs AS nearest_cluster_jobs FROM (SELECT *, row_number() OVER (PARTITION BY alt_id, sector ORDER BY d, jobs DESC) AS rn FROM {_NEAR_SQL}) WHERE rn = 1")
def g15(spark, d):
    e = analysis(spark, d).exposure.where("distance_m is not null")
    return e.select("alt_id", "sector", r4(F.col("distance_m")).alias("distance_m"), F.col("nearest_jobs").alias("nearest_cluster_jobs")).orderBy("distance_m", "alt_id", "sector")


@query("g16_sector_configs", f"SELECT v.sector, count(*) AS n_codes, (SELECT count(*) FROM customer) AS n_points FROM (VALUES {', '.join(f'({chr(39)}{n}{chr(39)}, {chr(39)}{c}{chr(39)})' for n, _, cs in clean.SECTORS for c in cs)}) v(sector, code) GROUP BY 1")
def g16(spark, d):
    n = table(spark, d, "customer").agg(F.count("*").alias("n_points"))
    return exposure.sector_configs(spark).select("sector", F.size("code_prefixes").cast("long").alias("n_codes")).join(F.broadcast(n))


@query("g17_sector_pipeline", f"SELECT c.sector, c.n_cells, c.num_jobs, c.n_hotspots, coalesce(k.n, 0) AS n_clusters FROM (SELECT sector, count(*) AS n_cells, sum(num_jobs) AS num_jobs, count(*) FILTER {_SPOT_SQL} AS n_hotspots FROM {STATS_SQL} GROUP BY 1) c LEFT JOIN (SELECT sector, count(DISTINCT root) AS n FROM {_ROOT_SQL} GROUP BY 1) k USING (sector)")
def g17(spark, d):
    return exposure.sector_summary(analysis(spark, d)).select("sector", "n_cells", "num_jobs", "n_hotspots", "n_clusters")


CENTRED_SQL = f"(SELECT *, (x - median(x) OVER ()) / 1000 AS e, (y - median(y) OVER ()) / 1000 AS n FROM {ALTERNATIVES_SQL})"


@query("g18_centroid_controls", f"SELECT alt_id, {R4('e')} AS centroid_east_km, {R4('n')} AS centroid_north_km FROM {CENTRED_SQL}")
def g18(spark, d):
    return geometry.centroid_controls(alternatives(spark, d)).select("alt_id", *[r4(F.col(c)).alias(c) for c in ("centroid_east_km", "centroid_north_km")])


@query("g19_quadratic_terms", f"SELECT alt_id, {R4('e * e')} AS centroid_east_km_sq, {R4('n * n')} AS centroid_north_km_sq, {R4('e * n')} AS centroid_east_north_km FROM {CENTRED_SQL}")
def g19(spark, d):
    q = geometry.quadratic_terms(geometry.centroid_controls(alternatives(spark, d)))
    return q.select("alt_id", *[r4(F.col(c)).alias(c) for c in ("centroid_east_km_sq", "centroid_north_km_sq", "centroid_east_north_km")])


_T = "CASE WHEN {r} <= ceil((k - 1) / 3.0) THEN '{a}' WHEN {r} <= ceil(2 * (k - 1) / 3.0) THEN 'central' ELSE '{b}' END"


@query("g20_grid_zones", f"SELECT alt_id, {_T.format(r='rn', a='south', b='north')} || '_' || {_T.format(r='re', a='west', b='east')} AS grid_zone FROM (SELECT alt_id, row_number() OVER (ORDER BY e, alt_id) AS re, row_number() OVER (ORDER BY n, alt_id) AS rn, count(*) OVER () AS k FROM {CENTRED_SQL})")
def g20(spark, d):
    return geometry.grid_zones(geometry.centroid_controls(alternatives(spark, d))).select("alt_id", "grid_zone")


@query("g21_interior_point", f"SELECT id, (x0 + x1) / 2 AS px, (y0 + y1) / 2 AS py FROM {ZONES_SQL}")
def g21(spark, d):
    return geometry.interior_point(geometry.box_segments(zones(spark, d)))


@query("g22_box_distance", f"SELECT a.id AS left_id, b.id AS right_id, {R4('sqrt(power(greatest(b.x0 - a.x1, a.x0 - b.x1, 0), 2) + power(greatest(b.y0 - a.y1, a.y0 - b.y1, 0), 2))')} AS distance FROM {ZONES_SQL} a, {ZONES_SQL} b")
def g22(spark, d):
    a = zones(spark, d, "left_id")
    b = zones(spark, d, "right_id").withColumnsRenamed({"x0": "u0", "y0": "v0", "x1": "u1", "y1": "v1"})
    return a.join(F.broadcast(b)).select("left_id", "right_id", r4(geometry.box_distance()).alias("distance"))


PIXELS_SQL = "(SELECT (event_id % 10000) // 100 * 200 + 100.5 AS x, (event_id % 10000) % 100 * 200 + 100.5 AS y, ts, value FROM events)"


@query("g23_zonal_sums", f"WITH p AS (SELECT x, y, CAST(year(ts) AS INTEGER) AS year, avg(value) AS v FROM {PIXELS_SQL} GROUP BY 1, 2, 3) SELECT z.id, p.year, {R4('sum(p.v) * 40000')} AS total FROM p JOIN {ZONES_SQL} z ON p.x > z.x0 AND p.x < z.x1 AND p.y > z.y0 AND p.y < z.y1 GROUP BY 1, 2")
def g23(spark, d):
    e = F.col("event_id") % 10000
    px = table(spark, d, "events").select((F.floor(e / 100) * 200 + 100.5).alias("x"), (e % 100 * 200 + 100.5).alias("y"), F.col("ts").alias("date"), "value")
    return overlay.zonal_sums(px, geometry.box_segments(zones(spark, d)), pixel_area=40000.0, cell=1000.0).withColumn("total", r4(F.col("total")))


MESH_SQL = "(SELECT s_suppkey AS id, CAST((s_suppkey * 37) % 200 * 100 AS DOUBLE) AS x0, CAST((s_suppkey * 53) % 200 * 100 AS DOUBLE) AS y0, CAST((s_suppkey * 37) % 200 * 100 + 900 AS DOUBLE) AS x1, CAST((s_suppkey * 53) % 200 * 100 + 900 AS DOUBLE) AS y1, s_acctbal AS v FROM supplier)"
_OVER = "greatest(0, least(z.x1, m.x1) - greatest(z.x0, m.x0)) * greatest(0, least(z.y1, m.y1) - greatest(z.y0, m.y0))"


def mesh(spark, d):
    k = F.col("s_suppkey")
    x0, y0 = ((k * 37) % 200 * 100).cast("double"), ((k * 53) % 200 * 100).cast("double")
    return table(spark, d, "supplier").select(k.alias("id"), x0.alias("x0"), y0.alias("y0"), (x0 + 900).alias("x1"), (y0 + 900).alias("y1"), F.col("s_acctbal").alias("v"))


@query("j10_cell_means", f"SELECT z.id, {R4('avg(m.v)')} AS v FROM {ZONES_SQL} z JOIN {MESH_SQL} m ON {_OVER} > 0 GROUP BY 1")
def j10(spark, d):
    return geometry.cell_means(zones(spark, d), mesh(spark, d), cell=1000.0, value="v").withColumn("v", r4(F.col("v")))


@query("j11_areal_interpolation", f"SELECT z.id, {R4(f'coalesce(sum({_OVER} / 810000 * m.v), 0)')} AS v FROM {ZONES_SQL} z LEFT JOIN {MESH_SQL} m ON {_OVER} > 0 GROUP BY 1")
def j11(spark, d):
    return geometry.interpolate(mesh(spark, d), zones(spark, d), cell=1000.0, value="v").withColumn("v", r4(F.col("v")))


@query("j12_overlap_share", f"SELECT z.id, {R4(f'coalesce(sum(CASE WHEN m.id IS NOT NULL THEN {_OVER} END), 0) / 2250000')} AS share FROM {ZONES_SQL} z LEFT JOIN {MESH_SQL} m ON {_OVER} > 0 GROUP BY 1")
def j12(spark, d):
    return geometry.overlap_shares(zones(spark, d), mesh(spark, d), cell=1000.0).withColumn("share", r4(F.col("share")))


NODES_SQL = "(SELECT s_suppkey AS node_id, CAST((s_suppkey * 7919) % 19997 AS DOUBLE) AS nx, CAST((s_suppkey * 6271) % 19993 AS DOUBLE) AS ny FROM supplier)"


@query("j15_nearest_node", f"SELECT point_id, node_id, {R4('d')} AS distance FROM (SELECT p.id AS point_id, n.node_id, sqrt(power(p.x - n.nx, 2) + power(p.y - n.ny, 2)) AS d, row_number() OVER (PARTITION BY p.id ORDER BY sqrt(power(p.x - n.nx, 2) + power(p.y - n.ny, 2)), n.node_id) AS rn FROM {POINTS_SQL} p, {NODES_SQL} n) WHERE rn = 1")
def j15(spark, d):
    k = F.col("s_suppkey")
    nodes = table(spark, d, "supplier").select(k.alias("node_id"), ((k * 7919) % 19997).cast("double").alias("x"), ((k * 6271) % 19993).cast("double").alias("y"))
    return relate.nearest_node(points(spark, d).select(F.col("id").alias("point_id"), "x", "y"), nodes, cell=1000.0).withColumn("distance", r4(F.col("distance")))


@query("j16_zone_cluster_distance", f"SELECT z.id, s.s_suppkey, {R4('sqrt(power((z.x0 + z.x1) / 2 - (s.s_suppkey * 37) % 200 * 100, 2) + power((z.y0 + z.y1) / 2 - (s.s_suppkey * 53) % 200 * 100, 2))')} AS distance FROM {ZONES_SQL} z, supplier s")
def j16(spark, d):
    z, m = zones(spark, d), mesh(spark, d).select(F.col("id").alias("s_suppkey"), F.col("x0").alias("mx"), F.col("y0").alias("my"))
    dist = F.sqrt(F.pow((F.col("x0") + F.col("x1")) / 2 - F.col("mx"), F.lit(2)) + F.pow((F.col("y0") + F.col("y1")) / 2 - F.col("my"), F.lit(2)))
    return m.join(F.broadcast(z)).select("id", "s_suppkey", r4(dist).alias("distance"))


# A road network on the parts: k to k + 1 and to k + 40, both ways.
NET_SQL = "(SELECT p_partkey AS src, p_partkey + s AS dst, 1 + (p_partkey * 7) % 13 AS length FROM part, (VALUES (1), (40)) v(s) WHERE p_partkey + s <= (SELECT max(p_partkey) FROM part) UNION ALL SELECT p_partkey + s, p_partkey, 1 + (p_partkey * 7) % 13 FROM part, (VALUES (1), (40)) v(s) WHERE p_partkey + s <= (SELECT max(p_partkey) FROM part))"


def net(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("src"))
    last = parts.agg(F.max("src").alias("last"))
    out = parts.join(F.broadcast(last)).withColumn("s", F.explode(F.array(F.lit(1), F.lit(40)))).select("src", (F.col("src") + F.col("s")).alias("dst"), "last", (1 + F.col("src") * 7 % 13).alias("length")).where("dst <= last").drop("last")
    return out.union(out.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "length"))


@query("n1_travel_times", f"SELECT src, dst, {R4('length / (coalesce(speed, avg(speed) OVER (PARTITION BY cls)) / 3.6)')} AS travel_time FROM (SELECT *, src % 3 AS cls, CASE WHEN src % 5 <> 0 THEN 30.0 + src % 4 * 10 END AS speed FROM {NET_SQL})")
def n1(spark, d):
    e = net(spark, d).withColumns({"road_class": F.col("src") % 3, "speed_kmh": F.when(F.col("src") % 5 != 0, 30.0 + F.col("src") % 4 * 10)})
    return network.travel_times(e).select("src", "dst", r4(F.col("travel_time")).alias("travel_time"))


def _bounded_sql(starts: str, radius: int) -> str:
    return f"(WITH RECURSIVE n AS MATERIALIZED (SELECT * FROM {NET_SQL}), r(origin, node, cost) AS (SELECT origin, node, 0 FROM {starts} UNION SELECT r.origin, n.dst, r.cost + n.length FROM r JOIN n ON n.src = r.node WHERE r.cost + n.length <= {radius}) SELECT origin, node, min(cost) AS cost FROM r GROUP BY 1, 2)"


@query("n2_anchor_times")
def n2(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("node"))
    anchors = spark.createDataFrame([("center", 1), ("west", 7), ("east", 77)], "anchor string, node long")
    return network.anchor_times(net(spark, d), anchors, parts, weight="length")


@query("n3_decayed_sums", f"SELECT o.node, {R4('coalesce(sum(p.p_size * exp(-r.cost / 20.0)), 0)')} AS total FROM (SELECT p_partkey AS node FROM part) o LEFT JOIN {_bounded_sql('(SELECT p_partkey AS origin, p_partkey AS node FROM part)', 20)} r ON r.origin = o.node LEFT JOIN part p ON p.p_partkey = r.node GROUP BY 1")
def n3(spark, d):
    p = table(spark, d, "part")
    out = network.decayed_sums(net(spark, d), p.select(F.col("p_partkey").alias("node")), p.select(F.col("p_partkey").alias("node"), F.col("p_size").alias("value")), radius=20.0)
    return out.withColumn("total", r4(F.col("total")))


@query("n4_job_accessibility", f"WITH o AS (SELECT p_partkey AS node, p_brand AS zone FROM part), r AS MATERIALIZED (SELECT * FROM {_bounded_sql('(SELECT p_partkey AS origin, p_partkey AS node FROM part)', 20)}), j AS (SELECT p_type AS sector, p_partkey AS node, p_size AS v FROM part), k AS (SELECT DISTINCT sector, t FROM j, (VALUES (10), (20)) v(t)) SELECT zone, sector, CAST(t AS DOUBLE) AS threshold, {R4('avg(jobs)')} AS jobs FROM (SELECT o.node, o.zone, k.sector, k.t, coalesce(sum(j.v * exp(-r.cost / k.t)), 0) AS jobs FROM o CROSS JOIN k LEFT JOIN r ON r.origin = o.node AND r.cost <= k.t LEFT JOIN j ON j.node = r.node AND j.sector = k.sector GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3")
def n4(spark, d):
    p = table(spark, d, "part")
    origins = p.select(F.col("p_brand").alias("zone"), F.col("p_partkey").alias("node"))
    jobs = p.select(F.col("p_type").alias("sector"), F.col("p_partkey").alias("node"), F.col("p_size").alias("workers"))
    return network.job_accessibility(net(spark, d), origins, jobs, [10.0, 20.0], weight="length").withColumn("jobs", r4(F.col("jobs")))


@query("n5_service_accessibility", f"SELECT o.node, {R4('least(greatest(ln(1 + coalesce(sum(p.p_size * 20 / greatest(p.p_retailprice, 1) * exp(-r.cost / 20.0)), 0)) * 12.5, 0), 100) / 100')} AS accessibility_services FROM (SELECT p_partkey AS node FROM part) o LEFT JOIN {_bounded_sql('(SELECT p_partkey AS origin, p_partkey AS node FROM part)', 20)} r ON r.origin = o.node LEFT JOIN part p ON p.p_partkey = r.node GROUP BY 1")
def n5(spark, d):
    p = table(spark, d, "part")
    values = p.select(F.col("p_partkey").alias("node"), network.service_score(F.col("p_size") * 20, F.col("p_retailprice")).alias("value"))
    out = network.decayed_sums(net(spark, d), p.select(F.col("p_partkey").alias("node")), values, radius=20.0)
    return out.select("node", r4(network.service_index(F.col("total"))).alias("accessibility_services"))


_REACHED_SQL = _bounded_sql("(SELECT p_partkey AS origin, p_partkey AS node FROM part)", 20)


@query("n5_service_accessibility_by_zone", f"WITH r AS MATERIALIZED (SELECT * FROM {_REACHED_SQL}), people AS (SELECT origin AS node, sum(p_retailprice * exp(-cost / 20.0)) AS n FROM r JOIN part ON p_partkey = node GROUP BY 1), score AS (SELECT node, p_size * 20 / greatest(n, 1) AS s FROM people JOIN part ON p_partkey = node), total AS (SELECT origin AS node, sum(s * exp(-cost / 20.0)) AS t FROM r JOIN score USING (node) GROUP BY 1) SELECT p_brand AS zone, {R4('avg(least(greatest(ln(1 + t) * 12.5, 0), 100) / 100)')} AS accessibility_services FROM part JOIN total ON node = p_partkey GROUP BY 1")
def n5_zones(spark, d):
    p = table(spark, d, "part")
    node = F.col("p_partkey").alias("node")
    zones_, amenities, people = p.select(F.col("p_brand").alias("zone"), node), p.select(node, (F.col("p_size") * 20).alias("attraction")), p.select(node, F.col("p_retailprice").alias("value"))
    out = network.service_accessibility(net(spark, d), zones_, amenities, people, radius=20.0)
    return out.select("zone", r4(F.col("accessibility_services")).alias("accessibility_services"))


@query("n6_nearest_crossing", "SELECT p_partkey, coalesce(least(a, b), a, b) AS nearest FROM (SELECT p_partkey, nullif(p_size, 1) AS a, 30 AS b FROM part)")
def n6(spark, d):
    return table(spark, d, "part").select("p_partkey", network.nearest_crossing(F.nullif(F.col("p_size"), F.lit(1)), F.lit(30)).alias("nearest"))


RAW_SQL = f"(SELECT alt_id, name_detail, access, balance AS jobs_all_10_2025, 7 AS jobs_flat_10_2025, customers / 40 AS accessibility_services, x AS travel_time_city_center, x AS travel_time_crossing_west, y AS travel_time_crossing_east, y / 100 AS mfg_distance_nearest_cluster_km FROM {ALTERNATIVES_SQL})"


def raw_features(spark, d):
    c = F.col
    return alternatives(spark, d).select("alt_id", "name_detail", "access", c("balance").alias("jobs_all_10_2025"), F.lit(7).alias("jobs_flat_10_2025"), (c("customers") / 40).alias("accessibility_services"), c("x").alias("travel_time_city_center"), c("x").alias("travel_time_crossing_west"), c("y").alias("travel_time_crossing_east"), (c("y") / 100).alias("mfg_distance_nearest_cluster_km"))


def _nice_sql(column: str, frm: str) -> str:
    return f"(SELECT arg_min(c, [round(abs(ln(c / raw)), 12), c]) AS d FROM (SELECT raw, unnest([p * 0.5, p, p * 2, p * 5, p * 10]) AS c FROM (SELECT raw, power(10.0, floor(log10(raw))) AS p FROM (SELECT quantile_cont(abs({column}), 0.75) FILTER ({column} <> 0) / 5 AS raw FROM {frm}))))"


_NICE = ("jobs_all_10_2025", "accessibility_services", "travel_time_city_center", "mfg_distance_nearest_cluster_km")


@query("f1_nice_denominators", " UNION ALL ".join(f"SELECT '{c}' AS feature, {_nice_sql(c, RAW_SQL)} AS denominator" for c in _NICE))
def f1(spark, d):
    return features.nice_denominators(raw_features(spark, d), list(_NICE)).select("feature", "denominator")


@query("f2_feature_catalog")
def f2(spark, d):
    return features.feature_catalog(raw_features(spark, d))


@query("f3_prepared_features", f"SELECT alt_id, CASE access WHEN 'LIBRE' THEN 0 WHEN 'RESTRINGIDO' THEN 1 END AS access_is_restricted, {R4('jobs_all_10_2025 / ' + _nice_sql('jobs_all_10_2025', RAW_SQL))} AS jobs_all_10_2025_scaled, {R4('least(travel_time_crossing_west, travel_time_crossing_east) / ' + _nice_sql('least(travel_time_crossing_west, travel_time_crossing_east)', RAW_SQL))} AS travel_time_nearest_crossing_scaled FROM {RAW_SQL}")
def f3(spark, d):
    raw = raw_features(spark, d)
    out = features.prepare_features(raw, features.feature_catalog(raw))
    return out.select("alt_id", "access_is_restricted", *[r4(F.col(c)).alias(c) for c in ("jobs_all_10_2025_scaled", "travel_time_nearest_crossing_scaled")])


_AUDIT = "SELECT '{c}' AS feature, count(*) FILTER ({c} IS NULL) AS missing, count(DISTINCT {c}) AS n_unique, {mn} AS min, {q1} AS p25, {q2} AS median, {q3} AS p75, {mx} AS max, CASE WHEN count({c}) = 0 THEN 'all missing' WHEN count(*) FILTER ({c} NOT IN (0, 1)) = 0 THEN 'binary' WHEN quantile_cont(abs({c}), 0.75) > 10 THEN 'too large' WHEN coalesce(quantile_cont(abs({c}), 0.5) FILTER ({c} <> 0), 0) < 1 THEN 'too small' ELSE 'ok' END AS scale_warning FROM lineitem"


def _audit_sql(c: str) -> str:
    d = f"CAST({c} AS DOUBLE)"
    return _AUDIT.format(c=c, mn=R4(f"min({d})"), mx=R4(f"max({d})"), q1=R4(f"quantile_cont({d}, 0.25)"), q2=R4(f"quantile_cont({d}, 0.5)"), q3=R4(f"quantile_cont({d}, 0.75)"))


@query("f4_scale_audit", " UNION ALL ".join(map(_audit_sql, ("l_quantity", "l_discount", "l_linenumber"))))
def f4(spark, d):
    return features.scale_audit(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_linenumber"])


@query("f5_job_groups", f"SELECT alt_id, {R4('(balance + customers + suppliers) / 3')} AS jobs_group_industrial_10, CAST(suppliers AS DOUBLE) AS jobs_group_commerce_10 FROM {ALTERNATIVES_SQL}")
def f5(spark, d):
    specs = features.job_group_specs((10,))
    source = dict(zip(("manufacture", "logistics", "construction"), ("balance", "customers", "suppliers"), strict=True))
    a = alternatives(spark, d)
    a = a.withColumns({c: F.col(source.get(c.removeprefix("jobs_").removesuffix("_10_2025_scaled"), "suppliers")).cast("double") for cs in specs.values() for c in cs})
    out, _ = features.add_job_groups(a, specs)
    return out.select("alt_id", r4(F.col("jobs_group_industrial_10")).alias("jobs_group_industrial_10"), "jobs_group_commerce_10")


@query("f6_ring_metric", "SELECT p_partkey, p_size + 0.5 * (p_retailprice - p_size) AS metric FROM part")
def f6(spark, d):
    return table(spark, d, "part").select("p_partkey", features.ring_metric(F.col("p_size"), F.col("p_retailprice")).alias("metric"))


@query("f7_year_built_area", f"SELECT s.obs_id, {R4('ln(1 + b.area / 10000)')} AS log_built_area_ha FROM (SELECT o_orderkey AS obs_id, c_nationkey AS alt_id, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders JOIN customer ON o_custkey = c_custkey) s JOIN (SELECT c_nationkey AS alt_id, CAST(year(o_orderdate) AS INTEGER) AS year, floor(sum(o_totalprice) + 0.5) AS area FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) b USING (alt_id, year)")
def f7(spark, d):
    from ..operators.choice import built_area_long, log_hectares
    from .analytics import built
    from .registry import sales

    years = list(range(1995, 2003))
    wide = built(spark, d).groupBy("alt_id").agg(*[F.max(F.when(F.col("year") == y, F.col("area"))).alias(f"built_area_{y}") for y in years])
    long = built_area_long(wide).where("area is not null")
    return sales(spark, d).withColumn("year", F.year("purchase_date")).join(long, ["alt_id", "year"]).select("obs_id", r4(log_hectares(F.col("area"))).alias("log_built_area_ha"))


@query("f8_documentation_view")
def f8(spark, d):
    descriptions = spark.createDataFrame([("access", "open or gated"), ("accessibility_services", "services within reach")], "source_column string, description string")
    return features.documentation_view(features.feature_catalog(raw_features(spark, d)), {"jobs_": "jobs", "jobs_all": "all jobs"}, descriptions)


@query("v1_neighbourhood_contract", "SELECT * FROM (VALUES ('keys_unique', true, '0'), ('keys_known', true, '0'), ('boxes_not_empty', true, '0'), ('all_have_sales', (SELECT count(DISTINCT c_nationkey) FROM orders JOIN customer ON o_custkey = c_custkey) = 25, CAST(25 - (SELECT count(DISTINCT c_nationkey) FROM orders JOIN customer ON o_custkey = c_custkey) AS VARCHAR)), ('unmatched_sales', true, '0')) v(\"check\", passed, value)")
def v1(spark, d):
    from .registry import sales

    z = zones(spark, d, "alt_id")
    return contracts.neighbourhood_contract(z, sales(spark, d), key="alt_id")


@query("v2_exposure_contract", "SELECT * FROM (VALUES ('rows_unique', true, '0'), ('distances_not_negative', true, '0'), ('bands_monotone', true, '0'), ('flags_follow_distance', true, '0')) v(\"check\", passed, value)")
def v2(spark, d):
    return contracts.exposure_contract(analysis(spark, d).exposure, [exposure.band_suffix(b) for b in exposure.BANDS_KM])


@query("v3_final_contract", "SELECT * FROM (VALUES ('columns_present', true, '0'), ('keys_unique', true, '0'), ('all_zones', true, '0'), ('no_extra', true, '0')) v(\"check\", passed, value)")
def v3(spark, d):
    return contracts.final_contract(alternatives(spark, d), zones(spark, d, "alt_id"), ["name_detail", "access", "balance"])
