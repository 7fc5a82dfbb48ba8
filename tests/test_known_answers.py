"""Hand-made inputs with answers worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotwise.operators import choice, exposure, features, geometry, grid, mnl, network, overlay, relate, specs
from plotwise.operators.graph import connected_components
from plotwise.sources import tables


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


SALES = "obs_id long, alt_id int, purchase_date string"


def sales(spark, data):
    from pyspark.sql import functions as F

    return spark.createDataFrame(data, SALES).withColumn("purchase_date", F.to_date("purchase_date"))


def test_active_choice_set(spark):
    s = sales(spark, [(0, 0, "2020-01-01"), (1, 0, "2020-01-05"), (2, 1, "2020-01-10"), (3, 2, "2022-01-01")])
    found = choice.active_choice_set(s, window_days=10)
    assert found.kept.count() == 3 and [r.obs_id for r in found.dropped.collect()] == [3]
    long = {(r.obs_id, r.alt_id): (r.active_sales, r.available) for r in found.long.collect()}
    assert [long[0, a][0] for a in range(3)] == [1, 1, 0]
    assert [long[2, a][0] for a in range(3)] == [2, 0, 0]
    assert [long[2, a][1] for a in range(3)] == [True, True, False]
    sparse = choice.active_choice_set(s, window_days=10, sparse=True)
    assert {(r.obs_id, r.alt_id) for r in sparse.long.collect()} == {k for k, v in long.items() if v[1]}
    summary = choice.availability_summary(found).first()
    assert (summary.n_obs, summary.n_dropped, summary.min_alternatives) == (4, 1, 2)
    for bad in ({"window_days": -1}, {"min_available": 0}):
        with pytest.raises(ValueError):
            choice.active_choice_set(s, **bad)
    with pytest.raises(ValueError, match="missing columns"):
        choice.active_choice_set(s.drop("alt_id"))


def test_prepare_transactions(spark):
    s = sales(spark, [(0, 0, "2020-01-01"), (1, 0, "2021-01-01"), (2, 1, "2021-06-01"), (3, 2, "2019-01-01"), (4, 9, "2020-02-02")])
    known = spark.createDataFrame([(0,), (1,), (2,)], "alt_id int")
    kept, counts = choice.prepare_transactions(s, known, min_year=2020, max_year=2021)
    assert counts.groupBy().sum("n").first()[0] == 3
    ids = choice.with_transaction_ids(kept)
    assert rows(ids.select("transaction_id", "obs_id"), "transaction_id") == [(0, 0), (1, 1), (2, 2)]
    assert choice.prepare_transactions(s, known, min_year=2020, max_year=2021, threshold=2)[0].count() == 2


def test_choice_frames(spark):
    s = sales(spark, [(0, 0, "2020-01-01"), (1, 0, "2021-01-01"), (2, 1, "2021-06-01")])
    f = spark.createDataFrame([(0, 1.0, 0.0, 10_000.0), (1, 2.0, 0.0, 0.0)], "alt_id int, x double, built_area_2020 double, built_area_2021 double")
    built = choice.built_area_long(f)
    frame = choice.choice_frame(s, f, ["x"], built=built)
    got = {(r.obs_id, r.alt_id): r.log_built_area_ha for r in frame.collect()}
    assert got[0, 0] == 0.0 and math.isclose(got[1, 0], math.log(2))
    assert all(r.passed for r in choice.validate_choice_frame(frame, ["x", "log_built_area_ha"]).collect())
    bad = choice.validate_choice_frame(frame.selectExpr("obs_id", "alt_id", "chosen", "available and not chosen as available", "99999D as x"), ["x"])
    failed = {r["check"] for r in bad.where("not passed").collect()}
    assert failed == {"no_sentinel", "chosen_available", "two_available"}
    wide = choice.wide_choice_frame(frame, ["x"], [0, 1])
    assert wide.columns == ["obs_id", "choice", "x_0", "x_1", "available_0", "available_1"] and wide.count() == 3
    for kwargs in ({"static": ["chosen"]}, {"static": ["nope"]}):
        with pytest.raises(ValueError):
            choice.choice_frame(s, f, **kwargs)
    with pytest.raises(ValueError):
        choice.built_area_long(f.select("alt_id", "x"))


def test_interval_choice_set_and_links(spark):
    s = sales(spark, [(0, 0, "2020-01-01"), (1, 0, "2020-01-16"), (2, 1, "2020-01-17"), (3, 1, None)]).selectExpr("obs_id", "purchase_date", "CAST(obs_id * 10 AS DOUBLE) AS price")
    assert rows(relate.interval_choice_set(s).select("obs_main", "obs_id"), "obs_main", "obs_id") == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2), (2, 1), (2, 2)]
    assert rows(relate.interval_choice_set(s, value_band=10).select("obs_main", "obs_id"), "obs_main") == [(0, 0), (1, 1), (2, 2)]
    pairs = spark.createDataFrame([(1, 10, 5), (1, 11, 5), (2, 10, 1), (3, 11, 9)], "l int, r int, d int")
    assert rows(relate.mutual_best(pairs, "l", "r", ["d"]), "l") == [(2, 10, 1)]
    spec = spark.createDataFrame([("s", ["a", "b"], ["x", "y"])], "spec_id string, families array<string>, candidates array<string>")
    coefficients = spark.createDataFrame([("s", "x", 1.5)], "spec_id string, feature string, coefficient double")
    assert rows(relate.matched_features(spec, coefficients), "feature") == [("s", "x", "a", 1.5), ("s", "y", "b", None)]


def test_components(spark):
    data = [(0, 1), (1, 4), (7, 7), (9, 8), (8, 5), (None, 3), (20, 19), (19, 18), (18, 17), (17, 16), (16, 15), (15, 14)]
    got = dict(rows(connected_components(spark.createDataFrame(data, "src long, dst long")), "node"))
    assert got == {0: 0, 1: 0, 4: 0, 7: 7, 5: 5, 8: 5, 9: 5} | {k: 14 for k in range(14, 21)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 150, (120, 2))]
    parent = list(range(150))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = dict(rows(connected_components(spark.createDataFrame(edges, "src long, dst long")), "node"))
    assert got == {n: find(n) for e in edges for n in e}


def test_scales(spark):
    df = spark.createDataFrame([(0, 100.0, 2.0), (1, 200.0, 4.0), (0, None, 6.0)], "binary int, large double, ok double")
    audit = {r.feature: (r.scale_warning, r.missing) for r in features.scale_audit(df, ["binary", "large", "ok"]).collect()}
    assert audit == {"binary": ("binary", 0), "large": ("too large", 1), "ok": ("ok", 0)}
    nice = {r.feature: r.denominator for r in features.nice_denominators(spark.createDataFrame([(0.0, 260.0), (0.0, 240.0)], "zero double, big double"), ["zero", "big"]).collect()}
    assert nice == {"zero": 1.0, "big": 50.0}


def test_job_groups(spark):
    group = {"manufacture": (2.0, 4.0), "logistics": (4.0, 8.0), "construction": (6.0, 12.0), "business_services": (10.0, 20.0), "care_education_health": (20.0, 40.0), "local_services": (30.0, 60.0), "commerce": (3.0, 6.0), "all": (9.0, 18.0)}
    names = [f"jobs_{g}_20_2025_scaled" for g in group]
    df = spark.createDataFrame([tuple(v[i] for v in group.values()) for i in range(2)], ", ".join(f"{n} double" for n in names))
    out, catalog = features.add_job_groups(df, features.job_group_specs((20,)))
    got = rows(out.select("jobs_group_industrial_20", "jobs_group_services_20", "jobs_group_commerce_20"), "jobs_group_commerce_20")
    assert got == [(4.0, 20.0, 3.0), (8.0, 40.0, 6.0)] and catalog.count() == 4
    with pytest.raises(ValueError, match="missing"):
        features.add_job_groups(df.drop(names[0]), features.job_group_specs((20,)))
    with pytest.raises(ValueError, match="exist"):
        features.add_job_groups(out, features.job_group_specs((20,)))


def test_catalog_and_prepared_features(spark):
    df = spark.createDataFrame(
        [("A", "LIBRE", 100.0, 0.2, 900.0, 500.0, 700.0, 1.0, 2.0, 0.4, 10.0), ("B", "RESTRINGIDO", 300.0, 0.3, 1100.0, 800.0, 300.0, 2.0, 3.0, 0.6, 11.0)],
        "name_detail string, access string, jobs_logistics_20_2025 double, accessibility_services double, travel_time_city_center double, travel_time_crossing_west double, travel_time_crossing_east double, built_area_2020 double, log_mfg_jobs_within_2km double, logistics_distance_nearest_cluster_km double, nearest_logistics_cluster_jobs double",
    )
    catalog = features.feature_catalog(df)
    roles = {r.model_column: r.role for r in catalog.where("model_column is not null").collect()}
    want = {"access_is_restricted": "control", "jobs_logistics_20_2025_scaled": "job_screen", "log_mfg_jobs_within_2km": "mfg_screen", "logistics_distance_nearest_cluster_km_scaled": "logistics_screen"}
    assert want.items() <= roles.items()
    found = {r.source_column: r for r in catalog.collect()}
    assert {c: (found[c].family, found[c].role, found[c].eligible) for c in ("name_detail", features.CROSSINGS[0], "built_area_2020", "nearest_logistics_cluster_jobs", features.NEAREST)} == {
        "name_detail": ("identifier", "exclude", False), features.CROSSINGS[0]: ("travel_time", "helper", False), "built_area_2020": ("built_area_history", "transaction_varying", True),
        "nearest_logistics_cluster_jobs": ("logistics_cluster", "available_not_screened", False), features.NEAREST: ("travel_time", "control", True),
    }
    assert found[features.NEAREST].model_column == "travel_time_nearest_crossing_scaled" and found["log_mfg_jobs_within_2km"].scale_denominator == 1.0
    flat = features.feature_catalog(df.withColumn("jobs_logistics_20_2025", F.lit(5.0))).where("source_column = 'jobs_logistics_20_2025'").first()
    assert (flat.family, flat.role, flat.model_column, flat.eligible) == ("job_accessibility", "exclude", "jobs_logistics_20_2025_scaled", False)
    out = features.prepare_features(df, catalog)
    assert "nearest_logistics_cluster_jobs" not in out.columns and "built_area_2020" in out.columns
    assert [r.access_is_restricted for r in out.orderBy("name_detail").collect()] == [0, 1]


def test_centroids_and_zones(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0), (1, 1000.0, 2000.0), (2, 3000.0, 4000.0)], "alt_id int, x double, y double")
    out = geometry.centroid_controls(df)
    assert rows(out.select("centroid_east_km", "centroid_north_km"), "centroid_east_km") == [(-1.0, -2.0), (0.0, 0.0), (2.0, 2.0)]
    km = spark.createDataFrame([(1.0, 3.0), (-2.0, 4.0)], "centroid_east_km double, centroid_north_km double")
    assert [tuple(r)[2:] for r in geometry.quadratic_terms(km).collect()] == [(1.0, 9.0, 3.0), (4.0, 16.0, -8.0)]
    with pytest.raises(ValueError):
        geometry.quadratic_terms(df)
    nine = spark.createDataFrame([(i, float(i % 3), float(i // 3)) for i in range(9)], "alt_id int, centroid_east_km double, centroid_north_km double")
    zoned = geometry.grid_zones(nine)
    dummies = [c for c in zoned.columns if c.startswith("grid_zone_")]
    assert len(dummies) == 8 and [sum(r[c] for c in dummies) for r in zoned.orderBy("alt_id").collect()] == [1, 1, 1, 1, 0, 1, 1, 1, 1]
    assert geometry.zone_catalog(zoned).where("n = 1").count() == 9


def test_polygons(spark):
    shape = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)]  # an L
    segs = geometry.segments(spark.createDataFrame([(1, 0, k, float(x), float(y)) for k, (x, y) in enumerate(shape)], "id int, ring int, seq int, x double, y double"))
    m = geometry.measures(segs).first()
    assert (m.area, m.x1, m.y1) == (7.0, 4.0, 4.0)
    p = geometry.interior_point(segs).first()
    assert (p.px, p.py) == (0.5, 2.0)
    points = spark.createDataFrame([(0.5, 3.0), (3.0, 0.5), (3.0, 3.0), (-1.0, 0.5)], "x double, y double")
    assert rows(overlay.points_in_polygons(points, segs, cell=1.0).select("x", "y"), "x") == [(0.5, 3.0), (3.0, 0.5)]


def test_clusters_and_exposure(spark):
    zones = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 100.0)], "alt_id int, x0 double, y0 double, x1 double, y1 double")
    schema = "sector string, cluster_rank int, num_jobs double, num_businesses int, area_km2 double, cx double, cy double, u0 double, v0 double, u1 double, v1 double"
    boxes = spark.createDataFrame([("logistics", 2, 100.0, 2, 0.01, 250.0, 50.0, 200.0, 0.0, 300.0, 100.0), ("logistics", 1, 400.0, 2, 0.01, 1550.0, 50.0, 1500.0, 0.0, 1600.0, 100.0)], schema)
    sectors = spark.createDataFrame([("logistics",), ("empty",)], "sector string")
    got = {r.sector: r for r in exposure.cluster_exposure(zones, boxes, sectors).collect()}
    one = got["logistics"]
    assert (one.jobs_within_500m, one.jobs_within_1km, one.jobs_within_2km, one.nearest_jobs, one.distance_m) == (100.0, 100.0, 500.0, 100.0, 100.0)
    none = got["empty"]
    assert (none.distance_m, none.within_500m, none.overlaps, none.jobs_within_5km, none.gravity_exp) == (None, False, False, 0.0, 0.0)
    assert [exposure.band_suffix(b) for b in (0.5, 2.0)] == ["500m", "2km"]
    assert exposure.sector_configs(spark).count() == 8
    cells = spark.createDataFrame([("s", 0, 300.0, 1, True, 2.5, 0.01, 1.0, 0.0, 0.0, 250.0, 250.0), ("s", 1, 300.0, 1, True, 2.0, 0.02, 1.0, 0.0, 250.0, 250.0, 500.0)], "sector string, cell long, num_jobs double, num_businesses int, is_hotspot_candidate boolean, getis_ord_z double, getis_ord_p double, local_moran_i double, bx0 double, by0 double, bx1 double, by1 double")
    members, clusters = grid.hotspot_clusters(cells, grid.queen_edges(grid.Grid(0, 0, 2, 2, 250.0), spark))
    c = clusters.first()
    assert (clusters.count(), c.num_jobs, c.cluster_rank, c.n_cells) == (1, 600.0, 1, 2)
    assert grid.hotspot_clusters(cells.where("false"), grid.queen_edges(grid.Grid(0, 0, 2, 2, 250.0), spark))[1].count() == 0


def test_network(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (4, 1, 2.0)], "src long, dst long, travel_time double")
    anchors = spark.createDataFrame([("c", 3)], "anchor string, node long")
    got = {r.node: r.cost for r in network.anchor_times(edges, anchors, spark.createDataFrame([(1,), (4,), (9,)], "node long")).collect()}
    assert got == {1: 2.0, 4: 4.0, 9: None}
    values = spark.createDataFrame([(1, 1.0), (2, 10.0), (3, 100.0)], "node long, value double")
    total = network.decayed_sums(edges, spark.createDataFrame([(1,)], "node long"), values, radius=1.0, weight="travel_time").first().total
    assert math.isclose(total, 1 + 10 * math.exp(-1))
    times = network.travel_times(spark.createDataFrame([(1, 2, 100.0, "a", 36.0), (2, 3, 100.0, "a", None), (3, 4, 100.0, "b", None)], "src long, dst long, length double, road_class string, speed_kmh double"))
    assert [r.travel_time for r in times.collect()] == [10.0, 10.0, 10.0]


def _frame(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3, 2))
    v = x @ np.array([0.8, -0.5]) + rng.gumbel(size=(n, 3))
    data = [(i, a, bool(v[i].argmax() == a), True, float(x[i, a, 0]), float(x[i, a, 1])) for i in range(n) for a in range(3)]
    return spark.createDataFrame(data, "obs_id long, alt_id int, chosen boolean, available boolean, x double, z double"), x, v.argmax(axis=1)


def test_logit_against_numpy(spark):
    long, x, chosen = _frame(spark)
    fit = mnl.fit_mnl(long, ["x", "z"])
    beta = np.zeros(2)
    for _ in range(20):
        e = np.exp(x @ beta)
        p = e / e.sum(axis=1, keepdims=True)
        mean = (p[:, :, None] * x).sum(axis=1)
        score = x[np.arange(len(x)), chosen] - mean
        info = np.einsum("na,nai,naj->ij", p, x, x) - mean.T @ mean
        beta = beta + np.linalg.solve(info, score.sum(axis=0))
    assert fit.converged and np.allclose(fit.beta, beta, atol=1e-6) and np.allclose(fit.scores, score.T @ score, rtol=1e-4)
    assert math.isclose(fit.null_log_likelihood, -len(x) * math.log(3))
    errors = mnl.check_derivatives(long, fit)
    assert errors["gradient_error"] < 1e-3 and errors["hessian_error"] < 1e-2
    specs = {"both": ["x", "z"], "turned": ["z", "x"], "x": ["x"], "z": ["z"]}
    together = mnl.fit_specs(long, specs)
    for name, features in specs.items():
        alone = mnl.fit_mnl(long, features)
        assert together[name].steps == alone.steps and together[name].converged and np.allclose(together[name].beta, alone.beta) and np.allclose(together[name].covariance(), alone.covariance())
        assert together[name].statistics == pytest.approx(alone.statistics)
    betas = [fit.beta * 0.5, fit.beta, fit.beta + 1]
    for one, many in zip([mnl.moments(long, ["x", "z"], b) for b in betas], mnl.moments_at(long, ["x", "z"], betas), strict=True):
        assert one["n"] == many["n"] and all(np.allclose(one[k], many[k]) for k in ("ll", "null_ll", "gradient", "information", "outer"))
    beside = mnl.check_derivatives(long, fit, at=fit.beta * 0.5)
    assert beside["gradient_relative"] < 1e-5 and beside["hessian_relative"] < 1e-5
    alternatives = spark.createDataFrame([(0,), (1,), (2,), (3,)], "alt_id int")
    shares = mnl.choice_shares(long, ["x", "z"], fit.beta, alternatives)
    total = mnl.share_fit(shares).first()
    assert math.isclose(total.predicted_sum, 1) and math.isclose(total.observed_sum, 1)
    assert mnl.residual_change(shares, shares).where("change <> 0").count() == 0
    stats = fit.statistics
    assert stats["aic"] == 4 - 2 * fit.log_likelihood and 0 < stats["rho_squared"] < 1
    with pytest.raises(ValueError):
        mnl.fit_mnl(long, ["x", "x"])


def test_specs(spark):
    groups = {"job": ["j1", "j2"], "mfg": ["m1"], "logistics": ["l1"]}
    single = specs.single_candidate_specs(spark, ["c"], groups)
    assert single.count() == 5 and single.where("spec_id = 'job__j1'").first()["columns"] == ["j1", "c"]
    combos = [r.spec_id for r in specs.combination_specs(spark, ["c"], groups).collect()]
    assert combos == ["j1__m1", "j2__m1", "j1__l1", "j2__l1", "m1__l1", "j1__m1__l1", "j2__m1__l1"]
    for bad in ({"min_candidates": 1}, {"min_candidates": 3, "max_candidates": 2}):
        with pytest.raises(ValueError):
            specs.combination_specs(spark, ["c"], groups, **bad)
    with pytest.raises(ValueError):
        specs.combination_specs(spark, ["j1"], groups)
    with pytest.raises(ValueError):
        specs.single_candidate_specs(spark, [], {"a": ["x"], "b": ["x"]})
    assert specs.extension_specs(spark, ["c"], {"more": ["d"]}).where("comparison = 'baseline'").count() == 1


def test_comparison_and_diagnostics(spark):
    summary = spark.createDataFrame([("baseline", 110.0), ("a", 100.0), ("b", 105.0)], "spec_id string, aic double")
    compared = specs.compare_models(summary)
    assert rows(compared.select("spec_id", "delta_aic", "rank", "delta_baseline"), "rank") == [("a", 0.0, 1, -10.0), ("b", 5.0, 2, -5.0), ("baseline", 10.0, 3, 0.0)]
    assert [r.spec_id for r in specs.finalists(compared, top=1).orderBy("role").collect()] == ["baseline", "a"]
    candidates = spark.createDataFrame([("a", "baseline", 100.0, 0.4, 0.05), ("b", "baseline", 109.0, 0.4, 0.05), ("c", "baseline", 90.0, -1.0, 0.01)], "spec_id string, comparison string, aic double, coefficient double, p double")
    assert rows(specs.continuation_flags(candidates, summary).select("spec_id", "continue"), "spec_id") == [("a", True), ("b", False), ("c", False)]
    rng = np.random.default_rng(0)
    data = rng.normal(size=(200, 2))
    df = spark.createDataFrame([(float(a), float(b), float(a + b), 1.0, float(2 * a)) for a, b in data], "a double, b double, s double, k double, twice double")
    vifs = {r.feature: r.vif for r in specs.feature_diagnostics(df, ["a", "b"])[0].collect()}
    r = np.corrcoef(data.T)[0, 1]
    assert math.isclose(vifs["a"], round(1 / (1 - r * r), 3))
    assert specs.feature_diagnostics(df, ["a"])[0].first().vif == 1.0
    assert specs.feature_diagnostics(df, ["a", "b", "s"])[0].first().vif == float("inf")
    assert dict(specs.filter_redundant(df, ["a", "twice", "k", "b", "s"])) == {"a": "kept", "twice": "correlated", "k": "invalid", "b": "kept", "s": "collinear"}


def test_sources(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    with open(path, "w") as f:
        f.write("Unnamed: 0,name,price\n0,A,10\n1,SIN DATOS,x\n")
    raw = tables.read_strings(spark, path, ["Unnamed: 0", "name", "price"])
    clean = tables.drop_placeholders(raw, "name", ["SIN DATOS"])
    assert [tuple(r) for r in clean.collect()] == [("A", "10")]
    tables.write(clean, str(tmp_path / "out"))
    tables.write(clean, str(tmp_path / "csv"), form="csv")
    tables.write_layers({"x": clean, "y": clean}, str(tmp_path / "layers"))
    assert spark.read.parquet(str(tmp_path / "layers" / "y")).count() == 1 == spark.read.parquet(str(tmp_path / "out")).count()
    tables.replace_table(clean, "cleaned")
    assert spark.sql("SELECT count(*) FROM cleaned").first()[0] == 1
    with open(tmp_path / "r.json", "w") as f:
        f.write('{"batchItems": [{"response": {"results": [{"type": "POI", "address": {"street": "s"}, "poi": {"name": "n"}, "position": {"lon": 1.5, "lat": 2.5}}, {"type": "Street"}]}}, {"error": {"code": "x"}}]}')
    schema = "batchItems array<struct<error:struct<code:string>,response:struct<results:array<struct<type:string,address:struct<street:string>,poi:struct<name:string>,position:struct<lon:double,lat:double>>>>>>"
    found = tables.flatten_responses(tables.read_json_batches(spark, str(tmp_path / "r.json"), schema))
    assert [tuple(r) for r in found.collect()] == [("s", "n", 1.5, 2.5)]


def test_places_of_hot_and_equal_values(spark):
    from plotwise.operators import geometry, relate

    data = [(i, None if i % 10 == 0 else 5.0 if i % 3 else float(i)) for i in range(500)]
    df = spark.createDataFrame(data, "id int, v double")
    want = [i for i, _ in sorted(data, key=lambda r: (r[1] is not None, r[1] or 0.0, r[0]))]
    placed = relate.with_places(df, [F.col("v").asc_nulls_first(), F.col("id").asc()], "at").collect()
    assert [r.id for r in sorted(placed, key=lambda r: r["at"])] == want and sorted(r["at"] for r in placed) == list(range(500))
    both = geometry.with_terciles(df, "v", "id", "t").withColumn("u", geometry.tercile("v", "id"))
    assert both.count() == 500 and both.where("t <> u").count() == 0
    empty = df.where("false")
    assert relate.with_places(empty, [F.col("id").asc()], "at").count() == geometry.with_terciles(empty, "v", "id").count() == 0
