"""Accessibility of zones through nodes and mesh cells as queries.

The city stands on the parts: node k is at column k % 40 and row k // 40 of a
lattice of 100 m, mesh cells are 500 m wide, and workplaces and amenities are
the customers, each beside a node. All of it grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean
from ..operators import accessibility, geometry
from .cleaning import _AMENITY_SQL, _CODE_SQL, _FORMULA_SQL, establishments
from .registry import R4, query, r4, table
from .spatial import _REACHED_SQL, net

CENSUS = ("POBTOT", "P_0A2", "P_3A5", "P_6A11", "P_12A14", "P_15A17", "P_18A24", "POB15_64")
SECTORS = ("FURNITURE", "BUILDING")
UNIT = 250.0  # metres for each unit of length on the network
SIZE = 500.0

_CENSUS_SQL = ", ".join(f"sum(p_size * {i + 3} % 50) AS {c}" for i, c in enumerate(CENSUS))
_CELLS_SQL = f"(SELECT p_partkey // 40 // 5 * 8 + p_partkey % 40 // 5 AS id, {_CENSUS_SQL} FROM part GROUP BY 1)"
_CELL_NODES_SQL = "(SELECT p_partkey // 40 // 5 * 8 + p_partkey % 40 // 5 AS id, arg_min(p_partkey, power(p_partkey % 40 % 5 - 2, 2) + power(p_partkey // 40 % 5 - 2, 2) + p_partkey * 1e-9) AS node FROM part GROUP BY 1)"
_PLACES_SQL = "(SELECT *, c_custkey % (SELECT max(p_partkey) + 1 FROM part) AS node FROM customer)"
_WORKERS_SQL = "CAST(CASE c_custkey % 5 WHEN 0 THEN 3 WHEN 1 THEN 20 WHEN 2 THEN 175 WHEN 3 THEN 500 END AS DOUBLE)"
_STOCK_SQL = f"(SELECT node, amenity AS kind, sum({_FORMULA_SQL}) AS attraction FROM (SELECT node, area, num_workers, {_AMENITY_SQL} AS amenity FROM (SELECT node, c_acctbal AS area, {_CODE_SQL} AS code, {_WORKERS_SQL} AS num_workers FROM {_PLACES_SQL})) WHERE amenity IS NOT NULL GROUP BY 1, 2)"
_KINDS_SQL = "(VALUES " + ", ".join(f"('{k}', CAST({r} AS DOUBLE), CAST({w} AS DOUBLE))" for k, (_, r, w) in accessibility.service_kinds().items()) + ")"
_SERVED_SQL = "CASE s.kind " + " ".join(f"WHEN '{k}' THEN {e}" for k, e in clean.SERVED.items()) + " END"
_ZONES_SQL = "(SELECT s_suppkey AS id, s_suppkey * 37 % 34 * 100 + 20 AS x0, s_suppkey * 53 % 40 * 100 + 20 AS y0 FROM supplier)"
_MET_SQL = f"{_ZONES_SQL} z LEFT JOIN cell c ON c.id % 8 * 500 < z.x0 + 700 AND c.id % 8 * 500 + 500 > z.x0 AND c.id // 8 * 500 < z.y0 + 600 AND c.id // 8 * 500 + 500 > z.y0"


def city(spark, d):
    """(edges, nodes, cells, places, zones): places are establishments beside a node, zones boxes on the suppliers."""
    k = F.col("p_partkey")
    at = lambda node: {"x": (node % 40 * 100 + 50).cast("double"), "y": (F.floor(node / 40) * 100 + 50).cast("double")}
    parts = table(spark, d, "part")
    nodes = parts.select(k.alias("node_id")).withColumns(at(F.col("node_id")))
    column, row = F.floor(k % 40 / 5), F.floor(k / 40 / 5)
    cells = parts.groupBy((row * 8 + column).alias("id"), (column * SIZE).alias("x0"), (row * SIZE).alias("y0")).agg(*[F.sum(F.col("p_size") * (i + 3) % 50).alias(c) for i, c in enumerate(CENSUS)])
    last = parts.agg((F.max("p_partkey") + 1).alias("n"))
    places = establishments(spark, d).join(F.broadcast(last)).withColumns(at(F.col("id") % F.col("n"))).withColumn("x", F.col("x") + F.col("id") % 3)
    s = F.col("s_suppkey")
    boxes = table(spark, d, "supplier").select(s.alias("id"), (s * 37 % 34 * 100 + 20).cast("double").alias("x0"), (s * 53 % 40 * 100 + 20).cast("double").alias("y0")).withColumns({"x1": F.col("x0") + 700, "y1": F.col("y0") + 600})
    return net(spark, d), nodes, cells, places, geometry.box_segments(boxes)


@query("n5_services_through_mesh", f"""WITH r AS MATERIALIZED (SELECT origin, node, cost * {UNIT} AS cost FROM {_REACHED_SQL}), cell AS (SELECT * FROM {_CELLS_SQL} JOIN {_CELL_NODES_SQL} USING (id)),
 s AS (SELECT s.*, radius, weight FROM {_STOCK_SQL} s JOIN {_KINDS_SQL} k(kind, radius, weight) USING (kind) WHERE attraction IS NOT NULL),
 people AS (SELECT s.node, s.kind, sum({_SERVED_SQL} * exp(-r.cost / radius)) AS n FROM s JOIN r ON r.origin = s.node AND r.cost <= radius JOIN cell ON cell.node = r.node GROUP BY 1, 2),
 score AS (SELECT s.node, s.kind, radius, attraction / greatest(coalesce(n, 0), 1) * weight AS v FROM s LEFT JOIN people USING (node, kind)),
 total AS (SELECT r.origin AS node, sum(v * exp(-r.cost / radius)) AS t FROM r JOIN score ON score.node = r.node AND r.cost <= radius GROUP BY 1),
 c AS (SELECT id, least(greatest(ln(1 + coalesce(t, 0)) * 12.5, 0), 100) / 100 AS v FROM cell LEFT JOIN total USING (node))
 SELECT z.id, {R4('avg(v.v)')} AS accessibility_services FROM {_MET_SQL} LEFT JOIN c v ON v.id = c.id GROUP BY 1""")  # fmt: skip
def n5_mesh(spark, d):
    edges, nodes, cells, places, zones = city(spark, d)
    named = places.withColumns({"kind": clean.classify(F.col("code")), "num_workers": clean.workers(F.col("size_class")).cast("double")}).where("kind is not null")
    attraction = clean.formula_by_type(F.col("kind"), {k: v[0] for k, v in clean.ATTRACTION.items()}).cast("double")
    amenities = named.select(F.col("id").alias("amenity_id"), "x", "y", "kind", attraction.alias("attraction"))
    out = accessibility.zone_services(edges.withColumn("length", F.col("length") * UNIT), nodes, cells, amenities, zones, size=SIZE)
    return out.withColumn("accessibility_services", r4(F.col("accessibility_services")))


_JOBS_SQL = ", ".join(f"{R4(f'avg(coalesce(v.j_{s}_{t}, 0)) FILTER (c.id IS NOT NULL)')} AS jobs_{s}_{t}_2025" for s in SECTORS for t in (10, 20))
_JOB_SUMS_SQL = ", ".join(f"sum(w * exp(-r.cost / {t}.0)) FILTER (sector = '{s}' AND r.cost <= {t}) AS j_{s}_{t}" for s in SECTORS for t in (10, 20))


@query("n4_jobs_through_mesh", f"""WITH r AS MATERIALIZED (SELECT * FROM {_REACHED_SQL}), cell AS (SELECT * FROM {_CELL_NODES_SQL}), j AS (SELECT node, c_mktsegment AS sector, sum({_WORKERS_SQL}) AS w FROM {_PLACES_SQL} GROUP BY 1, 2),
 v AS (SELECT cell.id, {_JOB_SUMS_SQL} FROM cell JOIN r ON r.origin = cell.node JOIN j ON j.node = r.node GROUP BY 1)
 SELECT z.id, {_JOBS_SQL} FROM {_MET_SQL} LEFT JOIN v ON v.id = c.id GROUP BY 1""")  # fmt: skip
def n4_mesh(spark, d):
    edges, nodes, cells, places, zones = city(spark, d)
    sectors = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("sector"))
    jobs = places.join(sectors, "id").select(F.col("id").alias("job_id"), "x", "y", "sector", clean.workers(F.col("size_class")).alias("workers"))
    out = accessibility.zone_jobs(edges, nodes, cells, jobs, zones, list(SECTORS), [10.0, 20.0], size=SIZE, year=2025, weight="length")
    return out.select("id", *[r4(F.col(c)).alias(c) for c in out.columns if c != "id"])
