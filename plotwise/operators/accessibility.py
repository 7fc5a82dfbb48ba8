"""Accessibility from places to zones: points and mesh cells take their nodes of a network, sums are taken over it, and zones get the means of their cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import ATTRACTION, SERVED
from .geometry import box_segments
from .network import job_accessibility, service_index, service_score, shortest_times
from .overlay import polygon_means
from .relate import nearest_node

Kinds = dict[str, tuple[str, float, float]]


def service_kinds() -> Kinds:
    """For each type of amenity whom it serves (an expression over a mesh cell's columns), its radius and its weight, by the fixed values."""
    return {kind: (SERVED[kind], float(radius), weight) for kind, (_, radius, weight) in ATTRACTION.items()}


def uniform_kinds(radius: float = 1000.0) -> Kinds:
    """The same with one radius and without weights."""
    return {kind: (people, float(radius), 1.0) for kind, people in SERVED.items()}


def _by_kind(kind: Column, values: dict[str, Column]) -> Column:
    out = F.lit(None)
    for name, value in values.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def cell_nodes(cells: DataFrame, nodes: DataFrame, *, size: float) -> DataFrame:
    """(id, node): of the nodes inside each square cell the one nearest to its middle, of equal ones the smallest.

    ``cells``: id, x0, y0 (the lower left corner, on the lines of a grid of
    ``size``); ``nodes``: node_id, x, y. A node on a line is in the cell above
    or to the right. Cells without a node, and nodes without a cell or with a
    null, are in no row. Nodes are combined by cell before they meet the cells.
    """
    at = lambda c: F.floor(F.col(c) / F.lit(float(size)))
    middle = lambda c: (at(c) + 0.5) * F.lit(float(size))
    gap = F.hypot(F.col("x") - middle("x"), F.col("y") - middle("y"))
    placed = nodes.where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")) & F.col("node_id").isNotNull())
    best = placed.groupBy(at("x").alias("gx"), at("y").alias("gy")).agg(F.min(F.struct(gap.alias("gap"), "node_id")).alias("best"))
    return cells.select("id", at("x0").alias("gx"), at("y0").alias("gy")).join(best, ["gx", "gy"]).select("id", F.col("best.node_id").alias("node"))


def point_nodes(points: DataFrame, nodes: DataFrame, *, key: str, cell: float, reach: float | None = None) -> DataFrame:
    """points (key, x, y and more) with the nearest node as ``node``; points without a place, or whose node is farther than ``reach``, go. ``key`` is unique."""
    found = nearest_node(points.select(F.col(key).alias("point_id"), "x", "y"), nodes, cell=cell)
    if reach is not None:
        found = found.where(F.col("distance") <= reach)
    return points.join(found.select(F.col("point_id").alias(key), F.col("node_id").alias("node")), key)


def mesh_services(edges: DataFrame, mesh: DataFrame, amenities: DataFrame, kinds: Kinds | None = None, *, weight: str = "length") -> DataFrame:
    """(id, accessibility_services) of every mesh cell, from 0 to 1.

    ``mesh``: id, node (null for a cell off the network) and the census columns
    that ``kinds`` name; ``amenities``: node, kind, attraction. An amenity
    reaches the people of the cells within its type's radius, each cell times
    exp(-cost / radius); its attraction over these people, at least one, times
    the weight of its type, is what cells within the radius get, decayed in the
    same way. Types that ``kinds`` doesn't know, and amenities without a node
    or an attraction, count for nothing; cells that reach nothing, or have no
    node, get 0; null census columns count as no people.

    Two bounded searches, out from the amenities' nodes and back to them, serve
    all types: each node searches as far as the largest radius of the types
    that stand there, and no farther. Amenities are summed by node and type
    before they meet the cells, and cells by node, so no node gathers either.
    """
    kinds = service_kinds() if kinds is None else kinds
    radius = lambda kind: _by_kind(kind, {k: F.lit(float(r)) for k, (_, r, _) in kinds.items()})
    share = lambda kind: _by_kind(kind, {k: F.lit(float(w)) for k, (_, _, w) in kinds.items()})
    kind, node, cost = F.col("kind"), F.col("node"), F.col("cost")
    stock = amenities.where(node.isNotNull() & kind.isin(*kinds)).groupBy("node", "kind").agg(F.sum("attraction").alias("attraction")).where("attraction is not null").withColumn("radius", radius(kind))
    starts = stock.groupBy(node.alias("origin")).agg(F.max("radius").alias("limit")).withColumn("node", F.col("origin"))

    # One column of people for each different expression, by node.
    served = {expression: f"__p{i}" for i, expression in enumerate(dict.fromkeys(e for e, _, _ in kinds.values()))}
    people = mesh.where(node.isNotNull()).groupBy("node").agg(*[F.sum(F.expr(e)).cast("double").alias(name) for e, name in served.items()])
    out = shortest_times(edges, starts, weight=weight).join(people, "node")
    mine = stock.select(node.alias("origin"), "kind", "radius")
    count = _by_kind(kind, {k: F.col(served[e]) for k, (e, _, _) in kinds.items()})
    met = out.join(mine, "origin").where(cost <= F.col("radius"))
    reached = met.groupBy(F.col("origin").alias("node"), "kind").agg(F.sum(count * F.exp(-cost / F.col("radius"))).alias("people"))
    scores = stock.join(reached, ["node", "kind"], "left").select(node.alias("origin"), "kind", "radius", (service_score(F.col("attraction"), F.coalesce("people", F.lit(0.0))) * share(kind)).alias("score"))

    back = shortest_times(edges, starts, weight=weight, reverse=True).join(people.select("node"), "node", "left_semi")
    near = back.join(scores, "origin").where(cost <= F.col("radius"))
    totals = near.groupBy("node").agg(F.sum(F.col("score") * F.exp(-cost / F.col("radius"))).alias("total"))
    return mesh.select("id", "node").join(totals, "node", "left").select("id", service_index(F.coalesce("total", F.lit(0.0))).alias("accessibility_services"))


def zone_means(zones: DataFrame, cells: DataFrame, values: DataFrame, *, size: float, columns: list[str]) -> DataFrame:
    """(id, columns): for each zone (segments: id, ring, seq, x1, y1, x2, y2) the plain mean of the values (id, columns) of the mesh cells (id, x0, y0) that it has an area in common with."""
    boxes = cells.select("id", F.col("x0").cast("double").alias("x0"), F.col("y0").cast("double").alias("y0")).withColumns({"x1": F.col("x0") + float(size), "y1": F.col("y0") + float(size)})
    return polygon_means(zones, box_segments(boxes), values, cell=float(size), columns=columns)


def zone_services(edges: DataFrame, nodes: DataFrame, cells: DataFrame, amenities: DataFrame, zones: DataFrame, kinds: Kinds | None = None, *, size: float, weight: str = "length", reach: float | None = 1000.0) -> DataFrame:
    """(id, accessibility_services) of every zone: the whole way from amenities (amenity_id, x, y, kind, attraction) through the nodes (node_id, x, y) and the mesh cells (id, x0, y0, census columns) to zones of any shape (segments)."""
    mesh = cells.join(cell_nodes(cells, nodes, size=size), "id", "left")
    placed = point_nodes(amenities, nodes, key="amenity_id", cell=size, reach=reach)
    return zone_means(zones, cells, mesh_services(edges, mesh, placed, kinds, weight=weight), size=size, columns=["accessibility_services"])


def zone_jobs(edges: DataFrame, nodes: DataFrame, cells: DataFrame, jobs: DataFrame, zones: DataFrame, sectors: list[str], thresholds: list[float], *, size: float, year: int, weight: str = "travel_time", reach: float | None = 1000.0) -> DataFrame:
    """(id, jobs_<sector>_<threshold>_<year> ...) of every zone: the whole way from workplaces (job_id, x, y, sector, workers) through the nodes and mesh cells to zones of any shape. Cells off the network have no jobs."""
    placed = point_nodes(jobs, nodes, key="job_id", cell=size, reach=reach)
    origins = cell_nodes(cells, nodes, size=size).withColumnRenamed("id", "zone")
    long = job_accessibility(edges, origins, placed, thresholds, weight=weight)
    names = {f"jobs_{s}_{t:g}_{year}": (s, float(t)) for s in sectors for t in thresholds}
    wide = long.groupBy(F.col("zone").alias("id")).agg(*[F.max(F.when((F.col("sector") == s) & (F.col("threshold") == t), F.col("jobs"))).alias(n) for n, (s, t) in names.items()])
    values = cells.select("id").join(wide, "id", "left").fillna(0.0, list(names))
    return zone_means(zones, cells, values, size=size, columns=list(names))
