"""One small test for each finding of the third round that was right."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plotwise.operators import choice, geometry, grid, mnl, network, overlay, relate


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_permuted_rows_are_never_broadcast(spark):
    """Spark guesses the size of exploded rows from before they were exploded."""
    g = grid.Grid(0.0, 0.0, 4, 4, 1.0)
    cells = g.cells(spark).selectExpr("'a' AS sector", "cell", "CAST(cell AS DOUBLE) AS v")
    edges = grid.queen_edges(g, spark)
    dealt = grid.permuted(cells, "v", 5, 1)
    assert "BroadcastHashJoin" not in _plan(dealt)
    assert "BroadcastHashJoin" not in _plan(grid._lags(dealt.select("sector", "cell", "v"), edges, "v"))
    assert sorted(r.v for r in dealt.where("permutation = 3").collect()) == [float(k) for k in range(16)]
    assert 0 < grid.moran_p(cells, edges, value="v", permutations=5, seed=1).first().p <= 1


def test_registry_sums_reach_a_half_in_any_order(spark, tmp_path):
    """0.1 + 0.2 + 2.3 + 0.9 is 3.5, and less as doubles."""
    from plotwise.plans.analytics import registry

    rows = [(1, f"1995-01-0{k + 1} 00:00:00", 1.0, v) for k, v in enumerate((0.1, 0.2, 2.3, 0.9))]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_shipdate string, l_quantity double, l_extendedprice double").withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp"))
    lines.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry(spark, str(tmp_path)).first()
    assert (got.area, got.amount) == (4, 4)


def test_equal_polygons_are_overlaid_once(spark, monkeypatch):
    """Copies of a polygon aren't expanded into pairs, and every copy counts."""
    boxes = lambda rows: geometry.box_segments(spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double"))
    zones = boxes([(1, 0.0, 0.0, 2.0, 2.0), (2, 0.0, 0.0, 2.0, 2.0), (3, 9.0, 9.0, 10.0, 10.0), (4, 0.0, 0.0, 2.0, 2.0)])
    others = boxes([(7, 1.0, 0.0, 3.0, 2.0), (8, 1.0, 0.0, 3.0, 2.0), (9, 0.0, 0.0, 0.5, 2.0)])
    values = spark.createDataFrame([(7, 1.0), (8, None), (9, 4.0)], "id long, v double")
    met = []
    plain = overlay.overlay_areas
    monkeypatch.setattr(overlay, "overlay_areas", lambda *a, **k: met.append(plain(*a, **k)) or met[-1])
    shares = {r.id: round(r.share, 9) for r in overlay.overlap_shares(zones, others, cell=1.0).collect()}
    assert shares == {1: 1.25, 2: 1.25, 3: 0.0, 4: 1.25}
    means = {r.id: r.v for r in overlay.polygon_means(zones, others, values, cell=1.0, columns=["v"]).collect()}
    assert means == {1: 2.5, 2: 2.5, 3: None, 4: 2.5}
    amounts = spark.createDataFrame([(1, 4.0), (2, 8.0), (3, 1.0), (4, None)], "id long, v double")
    spread = {r.id: round(r.v, 9) for r in overlay.interpolate(zones, amounts, others, cell=1.0, columns=["v"]).collect()}
    assert spread == {7: 6.0, 8: 6.0, 9: 3.0}
    assert [df.count() for df in met] == [2, 2, 2]


def test_alike_sales_are_fitted_once(spark):
    """A row per situation with its weight gives the fit of all sales."""
    rows = [(k, k % 2, f"1995-01-0{1 + k % 3}", 1.0) for k in range(24)] + [(24, 0, "1995-01-01", 1.0), (25, 0, "1995-01-02", 1.0)]
    sales = spark.createDataFrame(rows, "obs_id long, alt_id long, purchase_date string, price double").withColumn("purchase_date", F.col("purchase_date").cast("date"))
    alike = choice.situations(sales)
    assert alike.count() == 6 and alike.agg(F.sum("weight")).first()[0] == 26
    frame = lambda focal: choice.active_choice_set(sales, window_days=0, sparse=True, focal=focal).long.withColumn("a", F.log1p("active_sales"))
    each, once = frame(None), frame(alike).join(alike.select("obs_id", "weight"), "obs_id")
    assert once.count() == 12 and each.count() == 52
    a, b = mnl.fit_mnl(each, ["a"]), mnl.fit_mnl(once, ["a"], weight="weight")
    c = mnl.fit_specs(once, {"one": ["a"]}, weight="weight")["one"]
    for fit in (b, c):
        assert fit.n_obs == a.n_obs == 26 and fit.statistics["aic"] == pytest.approx(a.statistics["aic"])
        assert fit.parameters()[0][1:] == pytest.approx(a.parameters()[0][1:])
    alts = spark.createDataFrame([(0,), (1,)], "alt_id long")
    shares = lambda long, w: {r.alt_id: (round(r.predicted, 9), round(r.observed, 9)) for r in mnl.choice_shares(long, ["a"], a.beta, alts, w).collect()}
    assert shares(each, None) == shares(once, "weight")


def test_nearest_node_meets_few_nodes(spark, monkeypatch):
    """the cells follow how dense the nodes are, and points at one place are looked up once."""
    copies = spark.createDataFrame([(k + 1000 * c, float(k % 30), float(k // 30)) for k in range(900) for c in (0, 1)], "node_id long, x double, y double")
    points = spark.createDataFrame([(k, k % 20 + 0.25, 3.0) for k in range(400)] + [(999, -70.0, 3.0)], "point_id long, x double, y double")
    kept = []
    plain = relate.cut
    monkeypatch.setattr(relate, "cut", lambda df: kept.append(df) or plain(df))
    got = {r.point_id: (r.node_id, r.distance) for r in relate.nearest_node(points, copies, cell=1000.0).collect()}
    assert got == {k: (90 + k % 20, 0.25) for k in range(400)} | {999: (90, 70.0)}
    assert kept[0].count() == 21 and kept[1].count() == 900


@pytest.mark.parametrize("most", [50_000, 3])
def test_nearest_node_keeps_no_pairs(spark, monkeypatch, most):
    """what places and nodes meet in a ring is not sorted, nodes are not broadcast, and of equally near nodes the smallest counts."""
    rng = random.Random(13)
    nodes = [(k, float(rng.randrange(12)), float(rng.randrange(12))) for k in rng.sample(range(500), 60)]
    points = [(k, rng.randrange(24) / 2, rng.randrange(24) / 2) for k in range(80)] + [(90, -300.0, 5.5), (91, 4.0, 700.0)]
    gap = lambda p, n: math.sqrt((p[1] - n[1]) ** 2 + (p[2] - n[2]) ** 2)
    want = {p[0]: min((gap(p, n), n[0]) for n in nodes) for p in points}
    assert sum(sum(gap(p, n) == want[p[0]][0] for n in nodes) > 1 for p in points) > 9
    kept, plain = [], relate.cut
    monkeypatch.setattr(relate, "cut", lambda df: kept.append(_plan(df)) or plain(df))
    monkeypatch.setattr(relate, "PLACES", most, raising=False)
    found = relate.nearest_node(spark.createDataFrame(points, "point_id long, x double, y double"), spark.createDataFrame(nodes, "node_id long, x double, y double"), cell=1.0)
    assert {r.point_id: (r.distance, r.node_id) for r in found.collect()} == want
    pairs = [p for p in kept if "nx#" in p and "gx#" in p]
    assert pairs and not any("SortAggregate" in p for p in pairs)
    # The right side are the places, and these only where they are few.
    assert all("BuildLeft" not in p for p in pairs) and ("SortMergeJoin" if most == 3 else "BuildRight") in pairs[0]


def test_equal_zones_are_measured_once(spark, monkeypatch):
    """Distances of copies of a polygon are worked out for one of them."""
    zones = geometry.box_segments(spark.createDataFrame([(k, 0.0, 0.0, 2.0, 2.0) for k in (1, 2, 3)] + [(4, 8.0, 0.0, 9.0, 1.0)], "id long, x0 double, y0 double, x1 double, y1 double"))
    boxes = spark.createDataFrame([("a", 5.0, 0.0, 6.0, 1.0), ("b", 0.5, 0.5, 1.0, 1.0)], "c string, u0 double, v0 double, u1 double, v1 double")
    seen = []
    plain = overlay.points_in_polygons
    monkeypatch.setattr(overlay, "points_in_polygons", lambda points, segs, **k: seen.append(segs) or plain(points, segs, **k))
    got = {(r.id, r.c): round(r.d, 9) for r in overlay.distances_to_boxes(zones, boxes, group=["c"], size=1.0).collect()}
    assert got == {(k, "a"): 3.0 for k in (1, 2, 3)} | {(k, "b"): 0.0 for k in (1, 2, 3)} | {(4, "a"): 2.0, (4, "b"): 7.0}
    assert seen[0].select("id").distinct().count() == 2


def test_times_over_a_network_take_few_searches(spark, monkeypatch):
    """blocks are joined level by level, so rounds don't grow with the length of the network."""
    edges = spark.range(1, 1500).selectExpr("id AS src", "id + 1 AS dst", "1D + id % 3 AS w")
    both = edges.union(edges.selectExpr("dst", "src", "w"))
    starts = spark.createDataFrame([("a", 1), ("b", 700), ("b", 1100), ("off", 9999)], "origin string, node long")
    want = {("off", 9999): 0.0}
    at = [0.0]
    for k in range(1, 1500):
        at.append(at[-1] + 1 + k % 3)
    for n in range(1, 1501):
        gap = lambda k, n=n: abs(at[n - 1] - at[k - 1])
        want["a", n], want["b", n] = gap(1), min(gap(700), gap(1100))
    rounds, plain = [], network._by_rounds
    monkeypatch.setattr(network, "_by_rounds", lambda *a, **k: plain(*a, **k | {"max_rounds": rounds.append(1) or 2}))
    ranged = network.range_blocks
    monkeypatch.setattr(network, "range_blocks", lambda e: ranged(e, size=20))
    got = {(r.origin, r.node): r.cost for r in network.shortest_times(both, starts, weight="w", reverse=True).collect()}
    assert got == want and rounds == [1]
    assert network.shortest_times(both, starts, weight="w", blocks=ranged(both, size=100)).count() == len(want)


@pytest.mark.parametrize("wide", [8, 0])
def test_searches_within_limits_are_one_each(spark, monkeypatch, wide):
    """Origins search once each; only blocks, as one origin each, go by rounds."""
    edges = spark.range(1, 300).selectExpr("id AS src", "id + 1 AS dst", "1D + id % 3 AS w")
    both = edges.union(edges.selectExpr("dst", "src", "w"))
    at = [0.0]
    for k in range(1, 300):
        at.append(at[-1] + 1 + k % 3)
    table = [(k, k, 5.0 + k % 4) for k in range(1, 301)] + [(1, 250, 3.0), (9999, 9999, 1.0)]
    want = {(9999, 9999): 0.0}
    for origin, node, reach in table[:-1]:
        for n in range(1, 301):
            gap = abs(at[n - 1] - at[node - 1])
            if gap <= (6.0 if origin == 1 else reach):
                want[origin, n] = min(gap, want.get((origin, n), gap))
    searched, plain = [], network._by_rounds
    monkeypatch.setattr(network, "_by_rounds", lambda steps, first, *a, **k: searched.append(first.select("origin").distinct().count()) or plain(steps, first, *a, **k))
    monkeypatch.setattr(network, "WIDE", wide)
    got = {(r.origin, r.node): r.cost for r in network.shortest_times(both, spark.createDataFrame(table, "origin long, node long, limit double"), weight="w", blocks=network.range_blocks(both, size=40), per_task=16).collect()}
    assert got == want and searched == ([8] if wide else [8, 301])


def test_audit_of_alike_rows_is_that_of_all(spark, sf, monkeypatch):
    """percentiles and audits take rows with a weight, and the frame has a row per situation."""
    from plotwise import plans
    from plotwise.operators import features, quantiles

    rows = [("a", 1.0, 3), ("a", 4.0, 1), ("a", 2.5, 2), ("a", 1.0, 1), ("a", None, 5), ("a", float("nan"), 2), ("a", 99.0, 0), ("b", None, 2), (None, -0.0, 4), (None, 7.0, None)]
    once = spark.createDataFrame(rows, "feature string, value double, w long")
    each = once.where("w > 0").withColumn("w", F.explode(F.sequence(F.lit(1).cast("long"), "w")))
    marks = {"p25": 0.25, "median": 0.5, "p75": 0.75, "top": 1.0}
    known = lambda df: sorted(map(str, df.collect()))
    assert known(quantiles.quantiles(once, marks, weight="w")) == known(quantiles.quantiles(each, marks))
    frame = spark.createDataFrame([(1.0, 0.0, 3), (4.0, None, 2), (-30.0, 1.0, 6), (None, 2.0, 1), (float("inf"), 5.0, 0)], "x double, y double, w long")
    long = frame.where("w > 0").withColumn("w", F.explode(F.sequence(F.lit(1).cast("long"), "w")))
    assert known(features.scale_audit(frame, ["x", "y"], weight="w")) == known(features.scale_audit(long, ["x", "y"]))
    seen, plain = [], features.scale_audit
    monkeypatch.setattr(features, "scale_audit", lambda df, *a, **k: seen.append(df) or plain(df, *a, **k))
    plans.QUERIES["m27_masked_scale_audit"](spark, sf)
    assert seen[0].groupBy("alt_id", "obs_id").count().count() == seen[0].count() and "weight" in seen[0].columns


def test_pairs_within_bands_meet_once(spark):
    """all ordered pairs of a table, each once."""
    import random

    draw = random.Random(7)
    points = [(k, float(draw.randrange(-60, 60)) / 2, draw.choice([0.1, 0.7, 1.1]) * draw.randrange(-9, 9)) for k in range(150)] + [(900, None, 1.0), (901, 1.0, float("inf")), (902, 1.0, float("nan")), (903, 0.0, 1e300)]
    rows = spark.createDataFrame(points, "id long, x double, y double")
    got = sorted((r.a.id, r.b.id) for r in relate.band_pairs(rows, {"x": 3.0, "y": 0.7}, strict=("y",)).collect())
    known = [p for p in points if p[1] is not None and abs(p[2]) < float("inf")]
    assert got == sorted((a[0], b[0]) for a in known for b in known if abs(a[1] - b[1]) <= 3.0 and abs(a[2] - b[2]) < 0.7)
    dates = spark.createDataFrame([(k, f"1995-01-{1 + k % 28:02d}", float(k * 37 % 500)) for k in range(300)], "obs_id long, purchase_date string, price double").withColumn("purchase_date", F.col("purchase_date").cast("date"))
    sets = relate.interval_choice_set(dates, window_days=3, value_band=20)
    assert {c: t for c, t in sets.dtypes} == {"obs_main": "bigint", "obs_id": "bigint", "is_main": "boolean", "purchase_date": "date", "price": "double"}
    assert sum(r.purchase_date == s for r, s in ((r, dates.where(F.col("obs_id") == r.obs_id).first().purchase_date) for r in sets.limit(3).collect())) == 3
