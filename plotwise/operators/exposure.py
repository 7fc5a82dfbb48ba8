"""How exposed neighbourhoods are to employment clusters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import SECTORS
from .geometry import box_segments, interior_point
from .graph import cut
from .grid import Grid, buffered_extent, cell_jobs, hotspot_clusters, hotspots, local_permutation_p, queen_edges, spatial_statistics
from .overlay import dissolve, shape_distances, shapes

# Fixed values of the sector analysis.
BUFFER_M, CELL_M, MIN_JOBS, MIN_BUSINESSES, PERMUTATIONS, SEED = 10_000.0, 250.0, 500.0, 2, 199, 42
BANDS_KM = (0.5, 1.0, 2.0, 5.0)
FLAGS_M = (0, 500, 1000, 2000)
GRAVITY_KM, DECAY_KM = 0.25, 2.0


def band_suffix(km: float) -> str:
    """500m below one kilometre, 2km from there on."""
    return f"{round(km * 1000)}m" if km < 1 else f"{km:g}km"


def sector_configs(spark) -> DataFrame:
    """One row for each sector: its name, column prefix, code prefixes and the settings of its analysis."""
    rows = [(name, prefix, list(codes), BUFFER_M, CELL_M, MIN_JOBS, MIN_BUSINESSES, PERMUTATIONS, SEED, list(BANDS_KM)) for name, prefix, codes in SECTORS]
    return spark.createDataFrame(rows, "sector string, prefix string, code_prefixes array<string>, buffer_m double, cell_m double, min_jobs double, min_businesses int, permutations int, seed int, bands_km array<double>")


def outlines(zones: DataFrame, key: str = "alt_id") -> DataFrame:
    """The segments of zones that are given by their segments already, or as boxes (key, x0, y0, x1, y1)."""
    return zones if "seq" in zones.columns else box_segments(zones, key)


def cluster_exposure(zones: DataFrame, boxes: DataFrame, sectors: DataFrame, bands: tuple[float, ...] = BANDS_KM, *, size: float = CELL_M) -> DataFrame:
    """A row for each zone and sector.

    ``zones``: alt_id and a box x0, y0, x1, y1, or the segments of polygons;
    ``boxes``: sector, cluster_rank, num_jobs, num_businesses, area_km2, cx, cy
    and the boxes u0, v0, u1, v1 of a cluster's cells, about ``size`` wide;
    ``sectors``: sector. The distance to a cluster is that from the polygon to
    its nearest cell, 0 if they touch or one holds the other; the distance of
    centres is that from a point within the zone. Of equally near clusters the
    better ranked counts. Without clusters, distances are null, flags false and
    sums 0. A zone meets every cluster, as the sums are over all of them, but
    of a cluster's cells only those that may be the nearest. Equal zones are
    worked out once.
    """
    (segs, members), boxes = shapes(outlines(zones), key="alt_id"), cut(boxes)
    facts = ["num_jobs", "num_businesses", "area_km2"]
    clusters = boxes.groupBy("sector", "cluster_rank").agg(*[F.first(k).alias(k) for k in (*facts, "cx", "cy")])
    near_by = shape_distances(segs, boxes, group=["sector", "cluster_rank"], size=size, key="alt_id")
    centre = F.hypot(F.col("px") - F.col("cx"), F.col("py") - F.col("cy"))
    each = near_by.join(clusters, ["sector", "cluster_rank"]).join(interior_point(segs, "alt_id"), "alt_id", "left").withColumn("c", centre)
    km = F.col("d") / 1000
    near: list[Column] = [F.min(F.struct("d", "cluster_rank", "c", "num_jobs", "num_businesses", "area_km2")).alias("near")]
    for b in bands:
        s, inside = band_suffix(b), F.col("d") <= b * 1000
        near += [F.count_if(inside).alias(f"clusters_within_{s}"), F.sum(F.when(inside, F.col("num_jobs")).otherwise(0.0)).alias(f"jobs_within_{s}"), F.max(F.when(inside, F.col("num_jobs")).otherwise(0.0)).alias(f"largest_within_{s}")]
    near += [F.sum(F.col("num_jobs") / F.pow(km + GRAVITY_KM, F.lit(2))).alias("gravity_inv_sq"), F.sum(F.col("num_jobs") * F.exp(-km / DECAY_KM)).alias("gravity_exp")]
    sums = each.groupBy("alt_id", "sector").agg(*near)
    full = segs.select("alt_id").distinct().join(sectors.select("sector")).join(sums, ["alt_id", "sector"], "left")
    out = {"nearest_rank": F.col("near.cluster_rank"), "distance_m": F.col("near.d"), "distance_km": F.col("near.d") / 1000, "centroid_distance_m": F.col("near.c"), "centroid_distance_km": F.col("near.c") / 1000}
    out |= {"nearest_jobs": F.col("near.num_jobs"), "nearest_businesses": F.col("near.num_businesses"), "nearest_area_km2": F.col("near.area_km2")}
    out |= {f"within_{m}m" if m else "overlaps": F.coalesce(F.col("near.d") <= m, F.lit(False)) for m in FLAGS_M}
    zero = [c for c in sums.columns if c not in ("alt_id", "sector", "near")]
    out |= {c: F.coalesce(F.col(c), F.lit(0).cast(dict(sums.dtypes)[c])) for c in zero}
    out |= {f"log_{c}": F.log1p(F.coalesce(F.col(c), F.lit(0.0))) for c in (*[f"jobs_within_{band_suffix(b)}" for b in bands], "gravity_inv_sq", "gravity_exp")}
    each_shape = full.select(F.col("alt_id").alias("shape"), "sector", *[v.alias(k) for k, v in out.items()])
    return members.join(each_shape, "shape").drop("shape")


def wide_exposure(long: DataFrame, prefixes: dict[str, str], columns: list[str]) -> DataFrame:
    """A row for each zone with columns <prefix>_<column> of every sector."""
    picks = [F.max(F.when(F.col("sector") == s, F.col(c))).alias(f"{p}_{c}") for s, p in prefixes.items() for c in columns]
    return long.groupBy("alt_id").agg(*picks)


@dataclass
class SectorAnalysis:
    """The tables of a sector analysis: grid cells with statistics, members and clusters, exposure."""

    grid: Grid
    cells: DataFrame
    members: DataFrame
    clusters: DataFrame
    exposure: DataFrame


def sector_analysis(points: DataFrame, zones: DataFrame, *, grid: Grid | None = None, cell: float = CELL_M, buffer: float = BUFFER_M, min_jobs: float = MIN_JOBS, min_businesses: int = MIN_BUSINESSES, value: str = "num_jobs", permutations: int = PERMUTATIONS, seed: int = SEED) -> SectorAnalysis:
    """From establishments (sector, x, y, jobs) and zones (alt_id, box or segments) to clusters and exposure, all sectors in one plan.

    Hotspots go by the p-values of ``permutations``; with 0 of them, by the
    normal tail of Gi* alone.
    """
    spark = points.sparkSession
    if grid is None:
        ends = outlines(zones).select(F.col("x1").alias("x"), F.col("y1").alias("y"))
        grid = Grid.over(buffered_extent(ends, buffer), cell)
    sectors = points.select("sector").distinct()
    stats = spatial_statistics(cell_jobs(points, grid, sectors), queen_edges(grid, spark), value)
    if permutations:
        stats = cut(local_permutation_p(stats, queen_edges(grid, spark), value=value, permutations=permutations, seed=seed))
    cells = hotspots(stats)
    members, clusters = hotspot_clusters(cells, queen_edges(grid, spark), min_jobs=min_jobs, min_businesses=min_businesses)
    chosen = clusters.where("cluster_rank is not null").select("sector", "cluster_id", "cluster_rank", "num_jobs", "num_businesses", "area_km2", "cx", "cy")
    boxes = members.select("sector", "cluster_id", F.col("bx0").alias("u0"), F.col("by0").alias("v0"), F.col("bx1").alias("u1"), F.col("by1").alias("v1")).join(chosen, ["sector", "cluster_id"])
    return SectorAnalysis(grid, cells, members, clusters, cluster_exposure(zones, boxes, sectors, size=grid.size))


def cluster_outlines(members: DataFrame) -> DataFrame:
    """(cluster, ring, seq, x1, y1, x2, y2): the outlines of each cluster's cells; cluster is a struct of sector and cluster_id."""
    cells = members.select(F.struct("sector", "cluster_id").alias("cluster"), F.col("bx0").alias("x0"), F.col("by0").alias("y0"), F.col("bx1").alias("x1"), F.col("by1").alias("y1"))
    return dissolve(box_segments(cells, "cluster"), key="cluster")


def sector_summary(analysis: SectorAnalysis) -> DataFrame:
    """One row for each sector: cells, jobs, hotspot cells, clusters found and chosen."""
    cells = analysis.cells.groupBy("sector").agg(F.count("*").alias("n_cells"), F.sum("num_jobs").alias("num_jobs"), F.count_if("is_hotspot_candidate").alias("n_hotspots"))
    clusters = analysis.clusters.groupBy("sector").agg(F.count("*").alias("n_clusters"), F.count("cluster_rank").alias("n_chosen"))
    return cells.join(clusters, "sector", "left").fillna({"n_clusters": 0, "n_chosen": 0})
