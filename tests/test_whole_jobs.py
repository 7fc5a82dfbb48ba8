"""Queries over whole networks and grids against plain versions."""

import hashlib
import heapq
import math
from collections import defaultdict

import pytest

from plotwise import plans
from plotwise.operators import grid, network


@pytest.fixture(scope="module")
def parts(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").toPandas()


@pytest.fixture(scope="module")
def reached(parts):
    """From each part, the parts within 20 on the road network of the queries, by Dijkstra's algorithm."""
    keys, last = parts.p_partkey.tolist(), parts.p_partkey.max()
    roads = defaultdict(list)
    for k in keys:
        for to in (k + 1, k + 40):
            if to <= last:
                roads[k].append((to, 1 + k * 7 % 13)), roads[to].append((k, 1 + k * 7 % 13))

    def search(start):
        best, queue = {}, [(0, start)]
        while queue:
            cost, node = heapq.heappop(queue)
            if node not in best:
                best[node] = cost
                for to, length in roads[node]:
                    if cost + length <= 20:
                        heapq.heappush(queue, (cost + length, to))
        return best

    return {k: search(k) for k in keys}


def test_decayed_sums_of(spark, sf, parts, reached):
    size = dict(zip(parts.p_partkey, parts.p_size, strict=True))
    want = {k: sum(float(size[n]) * math.exp(-c / 20) for n, c in found.items()) for k, found in reached.items()}
    assert dict(plans.QUERIES["n3_decayed_sums"](spark, sf).collect()) == pytest.approx(want, abs=2e-4)


def test_job_accessibility_of(spark, sf, parts, reached):
    rows = {r.p_partkey: r for r in parts.itertuples()}
    want = {(z, s, t): 0.0 for z in set(parts.p_brand) for s in set(parts.p_type) for t in (10.0, 20.0)}
    nodes = parts.p_brand.value_counts()
    for k, found in reached.items():
        for n, c in found.items():
            for t in (10.0, 20.0):
                if c <= t:
                    want[rows[k].p_brand, rows[n].p_type, t] += float(rows[n].p_size) * math.exp(-c / t) / nodes[rows[k].p_brand]
    got = {(r.zone, r.sector, r.threshold): r.jobs for r in plans.QUERIES["n4_job_accessibility"](spark, sf).collect()}
    assert got == pytest.approx(want, abs=2e-4)


def test_service_accessibility_divides_by_the_people_reached(spark, sf, parts, reached):
    rows = {r.p_partkey: r for r in parts.itertuples()}
    people = {k: sum(float(rows[n].p_retailprice) * math.exp(-c / 20) for n, c in found.items()) for k, found in reached.items()}
    score = {k: float(r.p_size) * 20 / max(people[k], 1.0) for k, r in rows.items()}
    by_zone = defaultdict(list)
    for k, found in reached.items():
        total = sum(score[n] * math.exp(-c / 20) for n, c in found.items())
        by_zone[rows[k].p_brand].append(min(max(math.log1p(total) * 12.5, 0), 100) / 100)
    want = {z: sum(v) / len(v) for z, v in by_zone.items()}
    assert dict(plans.QUERIES["n5_service_accessibility_by_zone"](spark, sf).collect()) == pytest.approx(want, abs=2e-4)


def test_service_accessibility_by_hand(spark):
    edges = spark.createDataFrame([(1, 2, 10.0), (2, 1, 10.0)], "src long, dst long, length double")
    zones = spark.createDataFrame([("a", 1), ("b", 2)], "zone string, node long")
    people = spark.createDataFrame([(1, 4.0), (2, 0.5)], "node long, value double")
    # Two amenities at node 2 reach 0.5 + 4 / e people there; the one at node 9, off the network, reaches nobody and is nobody's.
    amenities = spark.createDataFrame([(2, 3.0), (2, 1.0), (9, 5.0)], "node long, attraction double")
    got = dict(network.service_accessibility(edges, zones, amenities, people, radius=10.0).collect())
    total = 4 / (0.5 + 4 / math.e)
    assert got == pytest.approx({"a": math.log1p(total / math.e) * 0.125, "b": math.log1p(total) * 0.125})


def test_shortest_times_never_stop_early(spark):
    edges = spark.createDataFrame([(k, k + 1, 1.0) for k in range(6)], "src long, dst long, travel_time double")
    start = spark.createDataFrame([(0, 0)], "origin long, node long")
    with pytest.raises(RuntimeError):
        network.shortest_times(edges, start, max_rounds=3)
    assert {r.node: r.cost for r in network.shortest_times(edges, start).collect()} == {k: float(k) for k in range(7)}


def test_local_permutation_p_and_flags(spark):
    n, runs = 6, 49
    g = grid.Grid(0.0, 0.0, n, n, 1.0)
    jobs = {"s": [float(k * 7919 % 11 if k % 4 else 0) for k in range(n * n)], "t": [900.0 if k in (7, 8, 13, 14) else float(k % 3) for k in range(n * n)]}
    cells = spark.createDataFrame([(s, k, v) for s, vs in jobs.items() for k, v in enumerate(vs)], "sector string, cell long, num_jobs double")
    edges = grid.queen_edges(g, spark)
    got = {(r.sector, r.cell): r for r in grid.hotspots(grid.local_permutation_p(grid.spatial_statistics(cells, edges, "num_jobs"), edges, permutations=runs)).collect()}
    order = [sorted(range(n * n), key=lambda k: (hashlib.md5(f"42:{r}:{k}".encode()).hexdigest(), k)) for r in range(1, runs + 1)]
    assert len(got) == 2 * n * n
    for (s, k), r in got.items():
        v = jobs[s]
        mean = sum(v) / len(v)
        near = [j for j in range(n * n) if j != k and abs(j // n - k // n) <= 1 and abs(j % n - k % n) <= 1]
        # Local Moran and Gi* themselves, up to factors that a permutation leaves as they are.
        seen, sims = sum(v[j] for j in near), [sum(v[j] for j in [j for j in o if j != k][: len(near)]) for o in order]
        moran = sum((v[k] - mean) * (x - len(near) * mean) >= (v[k] - mean) * (seen - len(near) * mean) - 1e-7 for x in sims)
        getis = sum(v[k] + x >= v[k] + seen for x in sims)
        fold = lambda larger: (min(larger, runs - larger) + 1) / (runs + 1)
        assert (r.local_moran_p, r.getis_ord_p) == pytest.approx((fold(moran), fold(getis)))
        assert r.is_high_high == (r.quadrant == 1 and r.local_moran_p < 0.05)
        assert r.is_hotspot_candidate == (r.getis_ord_z > 1.96 and r.getis_ord_p < 0.05 and (v[k] > 0 or r.is_high_high))
    assert {k for (s, k), r in got.items() if s == "t" and r.is_hotspot_candidate} and any(r.getis_ord_z > 1.96 and r.getis_ord_p >= 0.05 for r in got.values())


def test_global_permutation_runs_with_the_settings_of_the_analysis(spark, sf, monkeypatch):
    seen = {}
    monkeypatch.setattr(grid, "moran_p", lambda cells, edges, **kw: seen.update(kw) or cells.groupBy("sector").count())
    assert {r["count"] for r in plans.QUERIES["g7_moran_permutation"](spark, sf).collect()} == {6400}
    assert seen == {"value": "num_jobs", "permutations": 199, "seed": 42}


def test_nearest_node_of_odd_places(spark):
    nan, inf = float("nan"), float("inf")
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, nan, 0.0), (3, 0.0, inf), (4, None, 0.0), (5, 1e6, -1e6), (6, 1e300, 1e300), (7, -1e18, 3.0)], "point_id long, x double, y double")
    nodes = spark.createDataFrame([(1, 3.0, 4.0), (2, nan, nan), (3, -inf, 0.0), (4, 1e6, -1e6 + 2), (5, None, None)], "node_id long, x double, y double")
    got = {r.point_id: (r.node_id, r.distance) for r in relate.nearest_node(points, nodes, cell=1.0).collect()}
    assert set(got) == {1, 5, 6, 7} and got[1] == (1, 5.0) and got[5] == (4, 2.0) and got[7][0] == 1
    assert relate.nearest_node(points, nodes.where("node_id = 2"), cell=1.0).count() == 0
