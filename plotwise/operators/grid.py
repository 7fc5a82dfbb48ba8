"""Grid hotspots: cells, neighbours, spatial statistics, clusters. All sectors in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import connected_components, cut

OFFSETS = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]


@dataclass(frozen=True)
class Grid:
    """A regular grid from (x0, y0): cells in columns, id = col * n_rows + row."""

    x0: float
    y0: float
    n_cols: int
    n_rows: int
    size: float

    @classmethod
    def over(cls, box: tuple[float, float, float, float], size: float) -> Grid:
        """int(span / size) + 1 cells in each direction."""
        x0, y0, x1, y1 = box
        return cls(x0, y0, int((x1 - x0) / size) + 1, int((y1 - y0) / size) + 1, size)

    def cells(self, spark) -> DataFrame:
        """cell, col, row and the box of each cell."""
        ids = spark.range(self.n_cols * self.n_rows).withColumnRenamed("id", "cell")
        col, row = F.floor(F.col("cell") / self.n_rows), F.col("cell") % self.n_rows
        left, low = F.lit(self.x0) + col * self.size, F.lit(self.y0) + row * self.size
        return ids.select("cell", col.alias("col"), row.alias("row"), left.alias("bx0"), low.alias("by0"), (left + self.size).alias("bx1"), (low + self.size).alias("by1"))


def buffered_extent(df: DataFrame, buffer: float, x: str = "x", y: str = "y") -> tuple[float, float, float, float]:
    """Bounds of all points, widened: four numbers from one aggregation. Without points, those of the origin."""
    r = [v or 0.0 for v in df.agg(F.min(x), F.min(y), F.max(x), F.max(y)).first()]
    return r[0] - buffer, r[1] - buffer, r[2] + buffer, r[3] + buffer


def cell_of(df: DataFrame, grid: Grid, x: str = "x", y: str = "y") -> DataFrame:
    """df with the cell that strictly contains each point; points on a cell's edge or outside the grid go."""
    px, py = (F.col(x) - grid.x0) / grid.size, (F.col(y) - grid.y0) / grid.size
    inside = (px > 0) & (py > 0) & (px < grid.n_cols) & (py < grid.n_rows) & (px != F.floor(px)) & (py != F.floor(py))
    return df.where(inside).withColumn("cell", F.floor(px).cast("long") * grid.n_rows + F.floor(py).cast("long"))


def cell_jobs(points: DataFrame, grid: Grid, sectors: DataFrame) -> DataFrame:
    """sector, cell, num_jobs, num_businesses (points with known jobs), jobs_per_km2, log_jobs: every cell of every sector, zero-filled.

    ``points``: sector, x, y, jobs; ``sectors``: sector, a short list.
    """
    sums = cell_of(points, grid).groupBy("sector", "cell").agg(F.sum("jobs").alias("num_jobs"), F.count("jobs").alias("num_businesses"))
    full = grid.cells(points.sparkSession).join(F.broadcast(sectors.select("sector"))).join(sums, ["sector", "cell"], "left")
    jobs = F.coalesce(F.col("num_jobs").cast("double"), F.lit(0.0))
    area = grid.size * grid.size / 1e6
    return full.withColumns({"num_jobs": jobs, "num_businesses": F.coalesce("num_businesses", F.lit(0))}).withColumns({"jobs_per_km2": F.col("num_jobs") / area, "log_jobs": F.log1p("num_jobs")})


def queen_edges(grid: Grid, spark) -> DataFrame:
    """(src, dst, weight): the up to eight neighbours of each cell; weight is 1 over their number."""
    cells = grid.cells(spark).select("cell", "col", "row")
    moves = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in OFFSETS]))
    out = cells.withColumn("m", moves).select("cell", (F.col("col") + F.col("m.i")).alias("c"), (F.col("row") + F.col("m.j")).alias("r"))
    out = out.where(F.col("c").between(0, grid.n_cols - 1) & F.col("r").between(0, grid.n_rows - 1))
    edges = out.select(F.col("cell").alias("src"), (F.col("c") * grid.n_rows + F.col("r")).alias("dst"))
    # The number of neighbours follows from the place alone.
    at = lambda c: (F.floor(F.col(c) / grid.n_rows), F.col(c) % grid.n_rows)
    col, row = at("src")
    side = lambda v, n: F.lit(1) + (v > 0).cast("int") + (v < n - 1).cast("int")
    return edges.withColumn("weight", F.lit(1.0) / (side(col, grid.n_cols) * side(row, grid.n_rows) - 1))


def _lags(cells: DataFrame, edges: DataFrame, value: str) -> DataFrame:
    """cells with the weighted (lag) and plain (around, n_around) sums of the neighbours' values.

    Cells may be permuted ones, of which there are far more than Spark guesses
    from before they were exploded; so no join here may broadcast a side.
    """
    seen = edges.hint("merge").join(cells.select("sector", F.col("cell").alias("dst"), F.col(value).alias("__v")), "dst")
    sums = seen.groupBy("sector", F.col("src").alias("cell")).agg(F.sum(F.col("weight") * F.col("__v")).alias("lag"), F.sum("__v").alias("around"), F.count("*").alias("n_around"))
    return cells.join(sums.hint("merge"), ["sector", "cell"], "left").fillna({"lag": 0.0, "around": 0.0, "n_around": 0})


def spatial_statistics(cells: DataFrame, edges: DataFrame, value: str = "num_jobs") -> DataFrame:
    """cells with z, lag_z, local_moran_i, quadrant (1 high-high, 2 low-high, 3 low-low, 4 high-low), getis_ord_z and getis_ord_p.

    Local I is (n - 1) z lag(z) / sum z2 with row-standardised weights; Gi* has
    binary weights with the cell itself, its p is one-sided from the normal
    distribution. Sectors without variation have z, I and Gi* of 0.
    """
    totals = cells.groupBy("sector").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    withz = cells.join(F.broadcast(totals), "sector").withColumn("z", F.when(F.col("sd") > 0, (F.col(value) - F.col("mean")) / F.col("sd")).otherwise(0.0))
    lagged = _lags(withz, edges, "z").withColumnRenamed("lag", "lag_z")
    n, w = F.col("n").cast("double"), F.col("n_around") + 1.0
    local = F.when(F.col("sd") > 0, (n - 1) * F.col("z") * F.col("lag_z") / n).otherwise(0.0)
    quadrant = F.when((F.col("z") > 0) & (F.col("lag_z") > 0), 1).when((F.col("z") <= 0) & (F.col("lag_z") > 0), 2).when((F.col("z") <= 0) & (F.col("lag_z") <= 0), 3).otherwise(4)
    # With z-scores the mean is 0 and the standard deviation 1.
    gi = F.when(F.col("sd") > 0, (F.col("around") + F.col("z")) / F.sqrt((n * w - w * w) / (n - 1))).otherwise(0.0)
    return lagged.withColumns({"local_moran_i": local, "quadrant": quadrant, "getis_ord_z": gi}).withColumn("getis_ord_p", upper_tail("getis_ord_z")).drop("n", "mean", "sd", "around", "n_around")


def upper_tail(z: str):
    """The normal probability of a larger value, by a rational approximation (absolute error below 1e-7)."""
    a = F.abs(F.col(z))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * a)
    poly = t * (F.lit(0.319381530) + t * (F.lit(-0.356563782) + t * (F.lit(1.781477937) + t * (F.lit(-1.821255978) + t * F.lit(1.330274429)))))
    tail = F.exp(-a * a / 2) / F.lit(2.5066282746310002) * poly
    return F.when(F.col(z) >= 0, tail).otherwise(1 - tail)


def global_moran(cells: DataFrame, edges: DataFrame, value: str = "num_jobs") -> DataFrame:
    """sector, n, moran_i, expected_i: with row-standardised weights, n / S0 = 1 unless a cell has no neighbour."""
    stats = spatial_statistics(cells, edges, value)
    has = edges.select(F.col("src").alias("cell")).distinct().agg(F.count("*").alias("s0"))
    sums = stats.groupBy("sector").agg(F.count("*").alias("n"), F.sum(F.col("z") * F.col("lag_z")).alias("a"), F.sum(F.col("z") * F.col("z")).alias("b"))
    return sums.join(F.broadcast(has)).select("sector", "n", F.when(F.col("b") > 0, F.col("n") / F.col("s0") * F.col("a") / F.col("b")).otherwise(0.0).alias("moran_i"), (F.lit(-1.0) / (F.col("n") - 1)).alias("expected_i"))


def permuted(cells: DataFrame, value: str, permutations: int, seed: int) -> DataFrame:
    """sector, permutation, cell, value: values dealt anew to the cells, in the order of md5(seed:permutation:cell)."""
    runs = cells.select("sector", "cell", value).withColumn("permutation", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("permutation").cast("string"), F.col("cell").cast("string")))
    by = Window.partitionBy("sector", "permutation")
    ranked = runs.withColumns({"to": F.row_number().over(by.orderBy(key, "cell")), "at": F.row_number().over(by.orderBy("cell"))})
    values = ranked.select("sector", "permutation", F.col("to").alias("at"), F.col(value))
    # Rows are many more than Spark guesses from the cells, so the values mustn't be broadcast.
    return ranked.select("sector", "permutation", "at", "cell").join(values.hint("merge"), ["sector", "permutation", "at"]).select("sector", "permutation", "cell", value)


def moran_p(cells: DataFrame, edges: DataFrame, *, value: str = "num_jobs", permutations: int = 199, seed: int = 42) -> DataFrame:
    """sector, moran_i, p: the share of permutations (and the observation) at least as extreme, on the nearer side."""
    cells = cut(cells.select("sector", "cell", value))
    dealt = cut(permuted(cells, value, permutations, seed).select(F.concat_ws("|", "sector", F.col("permutation").cast("string")).alias("sector"), "cell", value))
    simulated = global_moran(dealt, edges, value).withColumn("sector", F.regexp_replace("sector", r"\|[0-9]+$", "")).withColumnRenamed("moran_i", "sim")
    observed = global_moran(cells, edges, value).select("sector", "moran_i")
    larger = simulated.join(F.broadcast(observed), "sector").groupBy("sector").agg(F.first("moran_i").alias("moran_i"), F.count_if(F.col("sim") >= F.col("moran_i")).alias("larger"), F.count("*").alias("r"))
    return larger.select("sector", "moran_i", ((F.least(F.col("larger"), F.col("r") - F.col("larger")) + 1) / (F.col("r") + 1)).alias("p"))


def local_permutation_p(stats: DataFrame, edges: DataFrame, *, value: str = "num_jobs", permutations: int = 199, seed: int = 42) -> DataFrame:
    """stats with local_moran_p and getis_ord_p by conditional permutation, folded like :func:`moran_p`.

    A cell keeps its value; its m neighbours are dealt the values of the first
    m other cells in the order of md5(seed:permutation:cell). No more cells of
    that order are needed than the most neighbours a cell has, and one. Both
    statistics are monotone in the sum of the neighbours' values, so only sums
    are compared, which are exact where the values are whole numbers.
    """
    around = _lags(stats.select("sector", "cell", value), edges, value).select("sector", "cell", value, "around", "n_around")
    most = edges.groupBy("src").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("permutation").cast("string"), F.col("cell").cast("string")))
    runs = stats.select("cell").distinct().withColumn("permutation", F.explode(F.sequence(F.lit(1), F.lit(permutations)))).withColumn("key", key)
    firsts = runs.withColumn("at", F.row_number().over(Window.partitionBy("permutation").orderBy("key", "cell"))).where(F.col("at") <= most + 1)
    dealt = firsts.join(stats.select("sector", "cell", F.col(value).cast("double").alias("v")), "cell").groupBy("sector", "permutation").agg(F.array_sort(F.collect_list(F.struct("at", "cell", "v"))).alias("dealt"))
    dealt = cut(dealt)
    others = F.slice(F.filter("dealt", lambda s: s["cell"] != F.col("cell")), F.lit(1), F.col("n_around").cast("int"))
    total = F.aggregate(others, F.lit(0.0), lambda acc, s: acc + s["v"])
    each = around.join(F.broadcast(dealt), "sector").select("sector", "cell", value, "around", total.alias("sim"))
    mean = F.broadcast(stats.groupBy("sector").agg(F.avg(value).alias("mean")))
    side = F.signum(F.col(value) - F.col("mean"))
    counts = each.join(mean, "sector").groupBy("sector", "cell").agg(
        F.count_if(side * F.col("sim") >= side * F.col("around")).alias("moran"), F.count_if(F.col("sim") >= F.col("around")).alias("getis"), F.count("*").alias("r")
    )
    p = lambda larger: (F.least(F.col(larger), F.col("r") - F.col(larger)) + 1) / (F.col("r") + 1)
    return stats.drop("getis_ord_p").join(counts.select("sector", "cell", p("moran").alias("local_moran_p"), p("getis").alias("getis_ord_p")), ["sector", "cell"])


def hotspots(stats: DataFrame, *, z: float = 1.96, p: float = 0.05) -> DataFrame:
    """stats with is_high_high, is_getis_hotspot and is_hotspot_candidate.

    With the p-values of :func:`local_permutation_p`, that of local Moran
    decides which quadrant-1 cells are high-high; without them, Gi* does.
    """
    gi = (F.col("getis_ord_z") > z) & (F.col("getis_ord_p") < p)
    high = (F.col("quadrant") == 1) & (F.col("local_moran_p") < p if "local_moran_p" in stats.columns else (F.col("local_moran_i") > 0) & gi)
    return stats.withColumns({"is_high_high": high, "is_getis_hotspot": gi, "is_hotspot_candidate": gi & ((F.col("num_jobs") > 0) | high)})


def hotspot_clusters(cells: DataFrame, edges: DataFrame, *, min_jobs: float = 500, min_businesses: int = 2) -> tuple[DataFrame, DataFrame]:
    """(members, clusters): candidate cells by cluster_id, and a row per cluster.

    Clusters are connected candidate cells of a sector, numbered from 1 by
    their smallest cell. Each has n_cells, num_jobs, num_businesses, area_km2,
    jobs_per_km2, centroid, the largest z and smallest p, cluster_rank_all, and
    cluster_rank among those that reach both thresholds (null below).
    """
    picked = cells.where("is_hotspot_candidate")
    spots = picked.select("sector", F.col("cell").alias("src"))
    links = spots.join(edges, "src").join(picked.select("sector", F.col("cell").alias("dst")), ["sector", "dst"]).where("src < dst").select("sector", "src", "dst")
    loops = spots.select("sector", "src", F.col("src").alias("dst"))
    # The components of all sectors at once: a node is a sector with a cell.
    node = lambda c: F.concat_ws("|", F.col("sector"), F.lpad(F.col(c).cast("string"), 12, "0"))
    both = links.union(loops)
    found = connected_components(both.select(node("src").alias("src"), node("dst").alias("dst")))
    placed = found.select(F.regexp_extract("node", r"^(.*)\|[0-9]+$", 1).alias("sector"), F.regexp_extract("node", r"\|([0-9]+)$", 1).cast("long").alias("cell"), F.regexp_extract("component", r"\|([0-9]+)$", 1).cast("long").alias("root"))
    members = placed.join(picked, ["sector", "cell"]).withColumn("cluster_id", F.dense_rank().over(Window.partitionBy("sector").orderBy("root"))).drop("root")
    size = (F.col("bx1") - F.col("bx0")) * (F.col("by1") - F.col("by0")) / 1e6
    sums = members.groupBy("sector", "cluster_id").agg(
        F.count("*").alias("n_cells"), F.sum("num_jobs").alias("num_jobs"), F.sum("num_businesses").alias("num_businesses"), F.sum(size).alias("area_km2"),
        F.avg((F.col("bx0") + F.col("bx1")) / 2).alias("cx"), F.avg((F.col("by0") + F.col("by1")) / 2).alias("cy"), F.max("getis_ord_z").alias("max_getis_ord_z"), F.min("getis_ord_p").alias("min_getis_ord_p"), F.max("local_moran_i").alias("max_local_moran_i"),
    )
    order = [F.desc("num_jobs"), F.desc("area_km2"), "cluster_id"]
    good = (F.col("num_jobs") >= min_jobs) & (F.col("num_businesses") >= min_businesses)
    ranked = sums.withColumn("jobs_per_km2", F.col("num_jobs") / F.col("area_km2")).withColumn("cluster_rank_all", F.row_number().over(Window.partitionBy("sector").orderBy(*order)))
    return members, ranked.withColumn("cluster_rank", F.when(good, F.row_number().over(Window.partitionBy("sector", good).orderBy(*order))))
