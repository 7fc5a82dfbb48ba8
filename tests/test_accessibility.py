"""Accessibility through the mesh: a city by hand, and random ones against a plain version."""

import math
import random

import pytest
from pyspark.sql import functions as F
from test_network import dijkstra

from plotwise.functions import clean
from plotwise.operators import accessibility, geometry, network

CENSUS = sorted({w for e in clean.SERVED.values() for w in e.split(" + ")})


def test_cell_nodes(spark):
    cells = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0), (3, 0.0, 100.0)], "id int, x0 double, y0 double")
    nodes = spark.createDataFrame([(7, 40.0, 50.0), (8, 60.0, 50.0), (9, 1.0, 1.0), (5, 100.0, 0.0), (4, 500.0, 500.0), (3, float("nan"), 1.0), (None, 50.0, 50.0)], "node_id int, x double, y double")
    assert sorted(tuple(r) for r in accessibility.cell_nodes(cells, nodes, size=100.0).collect()) == [(1, 7), (2, 5)]
    assert accessibility.cell_nodes(cells, nodes.where("false"), size=100.0).count() == 0


def test_reach_of_each_origin(spark):
    edges = [(i, i + 1, 1.0) for i in range(30)] + [(i + 1, i, 2.0) for i in range(30)]
    df = spark.createDataFrame(edges, "src int, dst int, length double")
    starts = spark.createDataFrame([(5, 5, 3.0), (20, 20, 7.0), (20, 20, 1.0), (9, 9, None)], "origin int, node int, limit double")
    found = {(r.origin, r.node): r.cost for r in network.shortest_times(df, starts, weight="length", radius=12.0).collect()}
    want = {(o, n): c for o, reach in ((5, 3.0), (20, 7.0), (9, 12.0)) for n, c in dijkstra(edges, o, reach).items()}
    assert found == want


def test_city_by_hand(spark):
    # Three cells in a row, a node in the middle of each of the first two; 400 m between them, one way back is 1,500 m.
    nodes = spark.createDataFrame([(1, 250.0, 250.0), (2, 750.0, 250.0)], "node_id int, x double, y double")
    edges = spark.createDataFrame([(1, 2, 400.0), (2, 1, 1500.0)], "src int, dst int, length double")
    cells = spark.createDataFrame([(10, 0.0, 0.0, 1000, 90), (11, 500.0, 0.0, 300, None), (12, 1000.0, 0.0, 50, 5)], "id int, x0 double, y0 double, POBTOT int, P_3A5 int").select("*", *[F.lit(0).alias(c) for c in CENSUS if c not in ("POBTOT", "P_3A5")])
    amenities = spark.createDataFrame([(1, 700.0, 260.0, "Farmacia", 600.0), (2, 260.0, 250.0, "Educación preescolar", 40.0), (3, 250.0, 250.0, "Nada", 9.0), (4, 9e9, 0.0, "Cine", 9.0), (5, None, 0.0, "Cine", 9.0)], "amenity_id int, x double, y double, kind string, attraction double")
    pharmacy = 600.0 / 300.0 * 0.05  # node 1 is 1,500 m away, beyond 1,000
    school = 40.0 / 90.0 * 0.15  # the children of cell 10; those of cell 11 are unknown, those of 12 off the network
    index = lambda total: math.log1p(total) * 12.5 / 100
    first = index(pharmacy * math.exp(-0.4) + school)
    second = index(pharmacy + school * math.exp(-0.5))
    zones = geometry.box_segments(spark.createDataFrame([(1, 100.0, 100.0, 400.0, 400.0), (2, 100.0, 100.0, 600.0, 400.0), (3, 900.0, 0.0, 1100.0, 100.0)], "id int, x0 double, y0 double, x1 double, y1 double"))
    found = {r.id: r.accessibility_services for r in accessibility.zone_services(edges, nodes, cells, amenities, zones, size=500.0).collect()}
    assert found == pytest.approx({1: first, 2: (first + second) / 2, 3: second / 2})
    none = accessibility.zone_services(edges, nodes, cells, amenities.where("false"), zones, size=500.0)
    assert {r.accessibility_services for r in none.collect()} == {0.0}

    jobs = spark.createDataFrame([(1, 740.0, 250.0, "commerce", 30.0), (2, 250.0, 250.0, "commerce", 10.0)], "job_id int, x double, y double, sector string, workers double")
    row = {r.id: r for r in accessibility.zone_jobs(edges, nodes, cells, jobs, zones, ["commerce"], [500.0, 2000.0], size=500.0, year=2025, weight="length").collect()}
    assert row[1].jobs_commerce_500_2025 == pytest.approx(10 + 30 * math.exp(-0.8))
    assert row[3].jobs_commerce_2000_2025 == pytest.approx((30 + 10 * math.exp(-0.75)) / 2)


def test_services_against_plain(spark):
    rng = random.Random(11)
    edges = [(a, b, float(rng.randrange(200, 900))) for a in range(40) for b in rng.sample(range(40), 3)]
    mesh = [(i, rng.choice([None, *range(40)]), *[rng.randrange(200) for _ in CENSUS]) for i in range(60)]
    amenities = [(rng.randrange(40), rng.choice(list(clean.ATTRACTION)), float(rng.randrange(1, 500))) for _ in range(80)]
    kinds = accessibility.service_kinds()
    people = {e: {} for e, _, _ in kinds.values()}
    for row in mesh:
        values = dict(zip(CENSUS, row[2:], strict=True))
        for e in people:
            people[e][row[1]] = people[e].get(row[1], 0) + sum(values[w] for w in e.split(" + "))
    costs = {a: dijkstra(edges, a, 5000.0) for a in range(40)}
    total = dict.fromkeys(range(40), 0.0)
    stock = {}
    for node, kind, attraction in amenities:
        stock[node, kind] = stock.get((node, kind), 0.0) + attraction
    for (node, kind), attraction in stock.items():
        e, radius, weight = kinds[kind]
        served = sum(people[e].get(n, 0) * math.exp(-c / radius) for n, c in costs[node].items() if c <= radius)
        for n in range(40):
            if costs[n].get(node, math.inf) <= radius:
                total[n] += weight * attraction / max(served, 1.0) * math.exp(-costs[n][node] / radius)
    want = {i: min(max(math.log1p(total.get(node, 0.0)) * 12.5, 0), 100) / 100 for i, node, *_ in mesh}
    frame = spark.createDataFrame(mesh, "id int, node int, " + ", ".join(f"{c} int" for c in CENSUS))
    roads = spark.createDataFrame(edges, "src int, dst int, length double")
    found = accessibility.mesh_services(roads, frame, spark.createDataFrame(amenities, "node int, kind string, attraction double"))
    assert {r.id: r.accessibility_services for r in found.collect()} == pytest.approx(want)
