"""Shortest times over blocks of a network against Dijkstra's algorithm."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from plotwise.operators import network

DRAW = random.Random(23)


def dijkstra(edges, start, radius=math.inf):
    out = {}
    for a, b, w in edges:
        out.setdefault(a, []).append((b, w))
    best, queue = {}, [(0.0, start)]
    while queue:
        cost, node = heapq.heappop(queue)
        if node not in best:
            best[node] = cost
            for to, w in out.get(node, ()):
                if cost + w <= radius:
                    heapq.heappush(queue, (cost + w, to))
    return best


@pytest.fixture(scope="module")
def town():
    """A lattice with gaps and one-way streets; its ids say nothing of the place."""
    names = random.Random(2).sample(range(10_000), 144)
    edges = []
    for i in range(12):
        for j in range(12):
            for a, b in ((i + 1, j), (i, j + 1)):
                if a < 12 and b < 12 and DRAW.random() < 0.85:
                    edges.append((names[i * 12 + j], names[a * 12 + b], float(DRAW.randrange(1, 9))))
                    if DRAW.random() < 0.8:
                        edges.append((names[a * 12 + b], names[i * 12 + j], float(DRAW.randrange(1, 9))))
    return edges + edges[:30] + [(names[0], names[0], 1.0)]


@pytest.mark.parametrize("how,radius", [("ranges", 8.0), ("grown", None), ("one", None), ("one", 12.0)])
def test_against_dijkstra(spark, town, how, radius):
    edges = spark.createDataFrame([*town, (None, 3, 1.0), (3, None, 1.0), (5, 6, None)], "src long, dst long, w double")
    blocks = {"ranges": lambda: network.range_blocks(edges, size=50), "grown": lambda: network.grown_blocks(edges, size=40), "one": lambda: None}[how]()
    starts = [(f"o{k}", n) for k, n in enumerate(sorted({e[0] for e in town})[::40])]
    table = spark.createDataFrame([*starts, starts[0], ("two", starts[0][1]), ("two", starts[2][1]), ("off", 99_999), (None, 3)], "origin string, node long")
    got = {(r.origin, r.node): r.cost for r in network.shortest_times(edges, table, weight="w", radius=radius, blocks=blocks, per_task=20).collect()}
    want = {(o, n): c for o, s in starts for n, c in dijkstra(town, s, radius or math.inf).items()} | {("off", 99_999): 0.0}
    for n in {n for o, n in want if o in ("o0", "o2")}:
        want["two", n] = min(want.get(("o0", n), math.inf), want.get(("o2", n), math.inf))
    assert got == want


def test_reverse(spark, town):
    edges = spark.createDataFrame(town, "src long, dst long, w double")
    goal = town[7][0]
    got = {r.node: r.cost for r in network.shortest_times(edges, spark.createDataFrame([("x", goal)], "origin string, node long"), weight="w", reverse=True).collect()}
    assert got == dijkstra([(b, a, w) for a, b, w in town], goal)


def test_blocks(spark, town):
    edges = spark.createDataFrame(town, "src long, dst long, w double")
    grown = {r.node: r.block for r in network.grown_blocks(edges, size=30).collect()}
    assert set(grown) == {n for e in town for n in e[:2]}
    members = {}
    for n, b in grown.items():
        members.setdefault(b, set()).add(n)
    assert max(map(len, members.values())) > 1
    for nodes in members.values():  # connected within itself
        seen, todo = set(), [next(iter(nodes))]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += [b for a, b, _ in town if a == n and b in nodes] + [a for a, b, _ in town if b == n and a in nodes]
        assert seen == nodes
    ranged = [r["count"] for r in network.range_blocks(edges, size=50).groupBy("block").count().collect()]
    assert max(ranged) == 50 and sum(ranged) == len(grown)


def test_a_long_path_takes_few_rounds(spark):
    n = 100_000
    path = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("w"))
    got = network.shortest_times(path, spark.createDataFrame([(1, 0)], "origin int, node long"), weight="w", blocks=network.range_blocks(path, size=20_000), max_rounds=10)
    assert got.agg(F.count("*"), F.max("cost"), F.sum("cost")).first()[:] == (n + 1, float(n), n * (n + 1) / 2)


def test_negative_weights_are_refused(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 1, -2.0)], "src long, dst long, w double")
    with pytest.raises(ValueError, match="negative"):
        network.shortest_times(edges, spark.createDataFrame([(1, 1)], "origin int, node long"), weight="w")
    none = network.shortest_times(edges.where("w > 5"), spark.createDataFrame([(1, 1)], "origin int, node long"), weight="w")
    assert [tuple(r) for r in none.collect()] == [(1, 1, 0.0)]
