"""Travel times and decayed sums on a road network given as edges."""

from __future__ import annotations

import heapq
import itertools
import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut
from .relate import with_places

#: How many blocks of the network are one of the next level.
GROUP = 8
#: How many costs a search within limits holds at once.
CELLS = 2_000_000
#: How many times a block, or the network, what starts may reach can be for a search in one piece.
WIDE = 8


def travel_times(edges: DataFrame) -> DataFrame:
    """edges (src, dst, length, road_class, speed_kmh) with travel_time in seconds; a missing speed is the mean of its class, else of all."""
    by_class = F.avg("speed_kmh").over(Window.partitionBy("road_class"))
    known = edges.withColumn("__s", F.coalesce("speed_kmh", by_class))
    overall = edges.agg(F.avg("speed_kmh").alias("__all"))
    return known.join(F.broadcast(overall)).withColumn("travel_time", F.col("length") / (F.coalesce("__s", "__all") / 3.6)).drop("__s", "__all")


def range_blocks(edges: DataFrame, *, size: int = 4096) -> DataFrame:
    """(node, block): the nodes of an edge table dealt over blocks of about ``size`` by ranges of their ids, for networks whose ids follow the map."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).where("node is not null").distinct()
    return with_places(nodes, [F.col("node")], "place").select("node", F.floor(F.col("place") / size).alias("block"))


def grown_blocks(edges: DataFrame, *, size: int = 4096) -> DataFrame:
    """(node, block): connected blocks of about ``size`` nodes and more, whatever the ids are.

    Every block below that size joins the neighbour with the least hash of
    this round, if that is less than its own; chains of such choices are
    followed to their end by pointers that double their reach. A round leaves
    about a third of the blocks of a path and fewer of a denser network, so
    the number of rounds is logarithmic in ``size``.
    """
    c = F.col
    links = cut(edges.select("src", "dst").where("src <> dst").union(edges.select(c("dst").alias("src"), c("src").alias("dst")).where("src <> dst")).distinct())
    blocks = cut(edges.select(c("src").alias("node")).union(edges.select("dst")).where("node is not null").distinct().withColumn("block", c("node")))
    for turn in itertools.count():
        sizes = blocks.groupBy("block").agg(F.count("*").alias("n"))
        mark = lambda b, k=turn: F.struct(F.xxhash64(F.lit(k), b).alias("h"), b.alias("b"))
        own = blocks.withColumnsRenamed({"node": "src", "block": "own"})
        other = blocks.withColumnsRenamed({"node": "dst", "block": "other"})
        beside = links.join(own, "src").join(other, "dst").where("own <> other").groupBy("own").agg(F.min(mark(c("other"))).alias("least"))
        small = sizes.where(c("n") < size).select(c("block").alias("own"))
        joins = cut(beside.join(small, "own").where(c("least") < mark(c("own"))).select("own", c("least.b").alias("to")))
        if joins.isEmpty():
            # No block that is too small has a lesser neighbour by this round's hash; it is done when none has any neighbour that could take it.
            if beside.join(small, "own").isEmpty():
                return blocks
            continue
        while True:
            further = joins.select(c("own").alias("to"), c("to").alias("next"))
            joins = cut(joins.join(further, "to", "left").select("own", F.coalesce("next", "to").alias("to"), c("next").isNotNull().alias("moved")))
            if joins.where("moved").isEmpty():
                break
            joins = joins.select("own", "to")
        blocks = cut(blocks.join(joins.select(c("own").alias("block"), "to"), "block", "left").select("node", F.coalesce("to", "block").alias("block")))


def _settle(graph: dict, known: dict, arrived: list, radius: float) -> tuple[dict, dict]:
    """Dijkstra's algorithm within a block for one origin: (costs that improved, least costs at nodes of other blocks).

    ``graph``: node -> [(node, inside, weight)]; ``known``: costs from before;
    ``arrived``: (cost, node) that came in.
    """
    heapq.heapify(arrived)
    better: dict = {}
    out: dict = {}
    while arrived:
        cost, node = heapq.heappop(arrived)
        if cost >= known.get(node, math.inf):
            continue
        known[node] = better[node] = cost
        for to, inside, weight in graph.get(node, ()):
            value = cost + weight
            if value <= radius:
                if not inside:
                    if value < out.get(to, math.inf):
                        out[to] = value
                elif value < known.get(to, math.inf):
                    heapq.heappush(arrived, (value, to))
    return better, out


def _search(key: tuple, graph: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """Of a block's origins: costs that improved, with their block, and those at nodes of other blocks, without one."""
    out = {"origin": [], "node": [], "cost": [], "block": [], "limit": []}
    fresh = rows.fresh.to_numpy()
    if not fresh.any():
        return pd.DataFrame(out, dtype=object)
    near: dict = {}
    for node, to, inside, w in zip(graph.node.tolist(), graph.to.tolist(), graph.inside.tolist(), graph.w.tolist(), strict=True):
        near.setdefault(node, []).append((to, inside, w))
    known: dict = {}
    arrived: dict = {}
    limits: dict = {}
    for origin, node, cost, new, reach in zip(rows.origin.tolist(), rows.node.tolist(), rows.cost.tolist(), fresh.tolist(), rows.limit.tolist(), strict=True):
        if new:
            limits[origin] = reach
            arrived.setdefault(origin, []).append((cost, node))
        else:
            mine = known.setdefault(origin, {})
            mine[node] = min(cost, mine.get(node, math.inf))
    for origin, came in arrived.items():
        better, further = _settle(near, known.get(origin, {}), came, limits[origin])
        for found, block in ((better, key[0]), (further, None)):
            out["origin"].extend([origin] * len(found)), out["node"].extend(found), out["cost"].extend(found.values()), out["block"].extend([block] * len(found)), out["limit"].extend([limits[origin]] * len(found))
    return pd.DataFrame(out, dtype=object)


def _deal(steps: DataFrame, came: DataFrame, per_task: int) -> tuple[DataFrame, DataFrame]:
    """(copies of the blocks' steps: at, copy, node, to, ...; shares: block, share): how many tasks share the origins of a block; blocks that nothing came to are in neither."""
    shares = came.groupBy("block").agg(F.ceil(F.count("*") / per_task).alias("share"))
    copies = steps.join(shares, "block").withColumnRenamed("block", "at").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("share") - 1))).drop("share")
    return copies, shares


def _labels(starts: DataFrame, blocks: DataFrame) -> str:
    kinds = dict(starts.dtypes) | {"block": dict(blocks.dtypes)["block"]}
    return f"origin {kinds['origin']}, node {kinds['node']}, cost double, block {kinds['block']}, limit double"


def _scratch(df: DataFrame) -> str:
    """A folder of its own among the checkpoints, which all executors share."""
    return f"{df.sparkSession.sparkContext.getCheckpointDir()}/times-{uuid.uuid4().hex}"


def _by_rounds(steps: DataFrame, first: DataFrame, blocks: DataFrame, *, per_task: int, max_rounds: int | None = None) -> DataFrame:
    """Costs by rounds: each block that something has reached searches to the end within itself, and only the costs at nodes of other blocks go on.

    ``steps``: block, node, to, inside, w; ``first``: origin, node, cost, limit.
    """
    # Each round is a table of its own in the shared folder, so that no plan grows with the rounds.
    spark, folder, labels = steps.sparkSession, _scratch(steps), _labels(first, blocks)
    at_block = blocks.select("node", "block")
    first.write.parquet(f"{folder}/0")
    fresh = spark.read.parquet(f"{folder}/0").join(at_block, "node")
    rounds: list[str] = []
    for done in itertools.count(1):
        fresh.select("origin", "node", "cost", "block", "limit").write.parquet(f"{folder}/to-{done}")
        came = spark.read.parquet(f"{folder}/to-{done}")
        copies, shares = _deal(steps, came, per_task)
        rows = came.join(shares, "block").select("block", F.pmod(F.xxhash64("origin"), F.col("share")).alias("deal"), "origin", "node", "cost", F.lit(True).alias("fresh"), "limit")
        if rounds:
            known = spark.read.parquet(*rounds).where("block is not null")
            rows = rows.union(known.join(shares, "block").select("block", F.pmod(F.xxhash64("origin"), F.col("share")).alias("deal"), "origin", "node", "cost", F.lit(False).alias("fresh"), "limit"))
        copies.groupBy("at", "copy").cogroup(rows.groupBy("block", "deal")).applyInPandas(_search, labels).write.parquet(f"{folder}/{done}")
        rounds.append(f"{folder}/{done}")
        further = spark.read.parquet(rounds[-1]).where("block is null").groupBy("origin", "node").agg(F.min("cost").alias("cost"), F.max("limit").alias("limit"))
        if further.isEmpty():
            # Starts off the network reach themselves only.
            whole = spark.read.parquet(*rounds).where("block is not null").select("origin", "node", "cost").union(spark.read.parquet(f"{folder}/0").select("origin", "node", "cost"))
            return whole.groupBy("origin", "node").agg(F.min("cost").alias("cost"))
        if done == max_rounds:
            raise RuntimeError(f"costs still improve after {max_rounds} rounds")
        fresh = further.join(at_block, "node")


def _between(key: tuple, graph: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
    """(node, to, w): least costs within a block from those of its kept nodes that are this task's own to all kept ones."""
    near: dict = {}
    for node, to, w in zip(graph.node.tolist(), graph.to.tolist(), graph.w.tolist(), strict=True):
        near.setdefault(node, []).append((to, True, w))
    wanted = set(kept.node.tolist())
    out = {"node": [], "to": [], "w": []}
    for origin in kept.node[kept.own.to_numpy(dtype=bool)].tolist():
        better, _ = _settle(near, {}, [(0.0, origin)], math.inf)
        for node in wanted.intersection(better):
            if node != origin:
                out["node"].append(origin), out["to"].append(node), out["w"].append(better[node])
    return pd.DataFrame(out, dtype=object)


def _by_levels(steps: DataFrame, first: DataFrame, blocks: DataFrame, *, per_task: int, ranges: bool) -> DataFrame:
    """The same without a limit, in as many steps as there are levels of blocks.

    Upward, only the nodes at the edge of a block, and the starts, stay, with
    the least costs between them within the block as steps; :data:`GROUP`
    blocks are one of the next level, until no step leaves its block. Costs
    found there are those of the nodes that stayed, and downward each block
    searches once from these. Where blocks have so many nodes at their edge
    that a level would not be smaller, that level is searched by rounds.
    """
    c = F.col
    spark, number = steps.sparkSession, dict(first.dtypes)["node"]
    below: list[tuple[DataFrame, DataFrame]] = []
    while True:
        cross = steps.where(~c("inside"))
        if cross.isEmpty():
            break
        ends = cross.select("node", "block").union(cross.select(c("to").alias("node"), "other")).union(first.join(blocks, "node").select("node", "block"))
        kept = cut(ends.distinct())
        pairs = kept.groupBy("block").agg(F.count("*").alias("n")).agg(F.sum(c("n") * c("n"))).first()[0]
        if pairs > steps.count():
            break
        inner = steps.where("inside").select("block", "node", "to", "inside", "w")
        # A task has 32 of the kept nodes to start from, and all of them to reach.
        shares = kept.groupBy("block").agg(F.ceil(F.count("*") / 32).alias("share"))
        copy = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), c("share") - 1)).alias(name)
        mine = kept.join(shares, "block").select("block", "node", copy("part"), "share")
        mine = mine.select(c("block").alias("of"), "part", c("node").alias("node"), (F.pmod(F.xxhash64("node"), c("share")) == c("part")).alias("own"))
        graph = inner.join(shares, "block").select(c("block").alias("at"), copy("copy"), c("node").alias("node"), "to", "w")
        short = graph.groupBy("at", "copy").cogroup(mine.groupBy("of", "part")).applyInPandas(_between, f"node {number}, to {number}, w double")
        graph = cut(short.union(cross.select("node", "to", "w")).groupBy("node", "to").agg(F.min("w").alias("w")))
        if ranges:
            upper = kept.select("node", F.floor(c("block") / GROUP).alias("block"))
        else:
            groups = grown_blocks(cross.select(c("block").alias("src"), c("other").alias("dst")), size=GROUP).select(c("node").alias("block"), c("block").alias("group"))
            upper = kept.join(groups, "block", "left").select("node", F.coalesce("group", "block").alias("block"))
        below.append((inner, blocks))
        blocks = cut(upper)
        steps = _placed(graph, blocks)
    found = _by_rounds(steps, first, blocks, per_task=per_task)
    for inner, at in reversed(below):
        folder = _scratch(steps)
        found.withColumn("limit", F.lit(math.inf)).write.parquet(folder)
        rows = spark.read.parquet(folder)
        came = rows.join(at, "node")
        copies, shares = _deal(inner, came, per_task)
        dealt = came.join(shares, "block").select("block", F.pmod(F.xxhash64("origin"), F.col("share")).alias("deal"), "origin", "node", "cost", F.lit(True).alias("fresh"), "limit")
        inside = copies.groupBy("at", "copy").cogroup(dealt.groupBy("block", "deal")).applyInPandas(_search, _labels(first, at))
        # Starts off the network are in no block.
        found = inside.select("origin", "node", "cost").union(rows.join(at, "node", "left_anti").select("origin", "node", "cost"))
    return found


def _reach(_, graph: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """(origin, node, cost): every node within each origin's limit, on the part of the network that the block's origins reach; many origins advance by a step at once."""
    if rows.empty:
        return pd.DataFrame({"origin": [], "node": [], "cost": []}, dtype=object)
    codes, nodes = pd.factorize(pd.concat([rows.node, graph.node, graph.to], ignore_index=True))
    begin, source, target = np.split(codes, [len(rows), len(rows) + len(graph)])
    order = np.argsort(source, kind="stable")
    target, weight = target[order], graph.w.to_numpy(dtype=float)[order]
    offsets = np.searchsorted(source[order], np.arange(len(nodes) + 1))
    owner, origins = pd.factorize(rows.origin)
    limits = np.zeros(len(origins))
    limits[owner] = rows.limit.to_numpy(dtype=float)
    found: list = []
    batch = max(1, CELLS // len(nodes))
    for low in range(0, len(origins), batch):
        some = (owner >= low) & (owner < low + batch)
        best = np.full(min(batch, len(origins) - low) * len(nodes), np.inf)
        front = np.unique((owner[some] - low) * len(nodes) + begin[some])
        best[front] = 0.0
        while len(front):
            row, at = np.divmod(front, len(nodes))
            degree = offsets[at + 1] - offsets[at]
            which = np.repeat(np.arange(len(front)), degree)
            edge = np.arange(len(which)) + np.repeat(offsets[at] - (np.cumsum(degree) - degree), degree)
            cost = best[front][which] + weight[edge]
            place = row[which] * len(nodes) + target[edge]
            better = (cost <= limits[low + row[which]]) & (cost < best[place])
            np.minimum.at(best, place[better], cost[better])
            front = np.unique(place[better])
        near = np.flatnonzero(best < np.inf)
        found.append((low + near // len(nodes), near % len(nodes), best[near]))
    who, where, cost = (np.concatenate(parts) for parts in zip(*found, strict=True))
    return pd.DataFrame({"origin": origins.take(who), "node": nodes.take(where), "cost": cost})


def _within(steps: DataFrame, first: DataFrame, blocks: DataFrame, *, per_task: int) -> DataFrame:
    """Costs within limits by one search: each block is given the steps that its starts may take, in other blocks too.

    Which these are comes from a search by rounds with a block as one origin,
    and so with few rows. Where they are many times the network, reaches are
    wide, and the search goes by rounds as a whole.
    """
    c = F.col
    homes = cut(first.join(blocks, "node").select("block", "origin", "node", "limit"))
    widest = homes.groupBy("block").agg(F.max("limit").alias("limit"))
    areas = homes.select("block", "node").distinct().join(widest, "block").select(c("block").alias("origin"), "node", "limit", F.lit(0.0).alias("cost"))
    near = cut(_by_rounds(steps.drop("other"), areas, blocks, per_task=per_task))
    size, most = near.groupBy("origin").agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
    per_block, network = blocks.groupBy("block").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    if size and (size > WIDE * network or most > WIDE * per_block):
        return _by_rounds(steps.drop("other"), first, blocks, per_task=per_task)
    inner = near.select(c("origin").alias("at"), c("node").alias("node"), "cost").join(widest.withColumnRenamed("block", "at"), "at")
    graph = inner.join(steps.select("node", "to", "w"), "node").where(c("cost") + c("w") <= c("limit")).select(c("at").alias("block"), "node", "to", "w")
    copies, shares = _deal(graph, homes.select("block"), per_task)
    rows = homes.join(shares, "block").select(c("block").alias("of"), F.pmod(F.xxhash64("origin"), c("share")).alias("deal"), c("origin").alias("origin"), c("node").alias("node"), "limit")
    kinds = dict(first.dtypes)
    reached = copies.groupBy("at", "copy").cogroup(rows.groupBy("of", "deal")).applyInPandas(_reach, f"origin {kinds['origin']}, node {kinds['node']}, cost double")
    # Starts off the network reach themselves only; an origin with starts in several blocks takes the least of their costs.
    found = reached.union(first.join(blocks, "node", "left_anti").select("origin", "node", "cost"))
    if homes.groupBy("origin").agg(F.min("block").alias("a"), F.max("block").alias("b")).where("a < b").isEmpty():
        return found
    return found.groupBy("origin", "node").agg(F.min("cost").alias("cost"))


def _placed(steps: DataFrame, blocks: DataFrame) -> DataFrame:
    """Steps (node, to, w) with the blocks of both ends, and whether they are the same."""
    both = steps.join(blocks.select("node", "block"), "node").join(blocks.select(F.col("node").alias("to"), F.col("block").alias("other")), "to")
    return cut(both.select("block", "node", "to", (F.col("block") == F.col("other")).alias("inside"), "w", "other"))


def shortest_times(edges: DataFrame, starts: DataFrame, *, weight: str = "travel_time", radius: float | None = None, reverse: bool = False, max_rounds: int | None = None, blocks: DataFrame | None = None, per_task: int = 8192) -> DataFrame:
    """(origin, node, cost): least cost from each origin to every node it reaches, within ``radius`` if given.

    ``starts``: origin, node, and, if origins have reaches of their own, limit
    (the largest counts, null is none). The network is dealt over ``blocks`` (node,
    block; by default ranges of ids, :func:`grown_blocks` where ids say nothing
    of the place). In a round, each block that something has reached searches
    to the end within itself, and only the costs at nodes of other blocks go
    on; so there are as many rounds as blocks on the longest of the shortest
    paths, not hops, and costs of blocks that nothing reached stay where they
    are. What comes to a block is dealt by origin over tasks of about
    ``per_task`` costs, each with a copy of the block. Without any limit, blocks
    are joined to larger ones level by level, so that the rounds grow with the
    logarithm of the number of blocks. Where every origin has a limit, each
    block searches once, on the part of the network that its starts may reach.

    If ``max_rounds`` is given, the search goes by rounds, and if there is more
    to do after them, that is an error, as is a negative weight. Edges with a
    null end or weight don't count. reverse: costs from nodes to the origins.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    plain = edges.select(F.col("src"), F.col("dst"), F.col(weight).cast("double").alias("w")).where("src is not null and dst is not null and w is not null and not isnan(w)")
    steps = plain.groupBy(F.col(a).alias("node"), F.col(b).alias("to")).agg(F.min("w").alias("w"))
    ranges = blocks is None
    blocks = cut(range_blocks(plain) if ranges else blocks.select("node", "block"))
    steps = _placed(steps, blocks)
    if (steps.agg(F.min("w")).first()[0] or 0.0) < 0:
        raise ValueError("negative weights")
    limit = math.inf if radius is None else float(radius)
    own = F.coalesce(F.col("limit").cast("double"), F.lit(math.inf)) if "limit" in starts.columns else F.lit(math.inf)
    # The reach of an origin is that of all its starts.
    reaches = starts.groupBy("origin").agg(F.least(F.max(own), F.lit(limit)).alias("limit"))
    first = starts.select("origin", "node").where("origin is not null and node is not null").distinct().join(reaches, "origin").withColumn("cost", F.lit(0.0)).select("origin", "node", "limit", "cost")
    if max_rounds is None and radius is None and "limit" not in starts.columns:
        return _by_levels(steps, cut(first), blocks, per_task=per_task, ranges=ranges)
    first = cut(first)
    if max_rounds is None and first.agg(F.max("limit")).first()[0] not in (None, math.inf):
        return _within(steps, first, blocks, per_task=per_task)
    return _by_rounds(steps.drop("other"), first, blocks, per_task=per_task, max_rounds=max_rounds)


def anchor_times(edges: DataFrame, anchors: DataFrame, nodes: DataFrame, *, weight: str = "travel_time") -> DataFrame:
    """(node, anchor, cost) from each listed node to each anchor (anchor, node) along directed edges; null if it can't be reached."""
    found = shortest_times(edges, anchors.select(F.col("anchor").alias("origin"), "node"), weight=weight, reverse=True)
    pairs = nodes.select("node").join(anchors.select("anchor"))
    return pairs.join(found.withColumnRenamed("origin", "anchor"), ["node", "anchor"], "left")


def decayed_sums(edges: DataFrame, origins: DataFrame, values: DataFrame, *, radius: float, weight: str = "length", value: str = "value") -> DataFrame:
    """(node, total) for each origin: the sum of the values at nodes within the radius, each times exp(-cost / radius)."""
    at = values.groupBy("node").agg(F.sum(value).alias("v"))
    found = shortest_times(edges, origins.select(F.col("node").alias("origin"), "node"), weight=weight, radius=radius)
    sums = found.join(at, "node").groupBy("origin").agg(F.sum(F.col("v") * F.exp(-F.col("cost") / radius)).alias("total"))
    return origins.select("node").distinct().join(sums.withColumnRenamed("origin", "node"), "node", "left").fillna({"total": 0.0})


def job_accessibility(edges: DataFrame, origins: DataFrame, jobs: DataFrame, thresholds: list[float], *, weight: str = "travel_time") -> DataFrame:
    """(zone, sector, threshold, jobs): decayed jobs of each sector reached within each threshold, averaged over a zone's nodes.

    ``origins``: zone, node; ``jobs``: sector, node, workers. One bounded
    search, for the largest threshold, serves all sectors and thresholds.
    """
    found = shortest_times(edges, origins.select(F.col("node").alias("origin"), "node"), weight=weight, radius=max(thresholds))
    at = jobs.groupBy("sector", "node").agg(F.sum("workers").alias("v"))
    reached = found.join(at, "node").withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))).where("cost <= threshold")
    sums = reached.groupBy("origin", "sector", "threshold").agg(F.sum(F.col("v") * F.exp(-F.col("cost") / F.col("threshold"))).alias("jobs"))
    kinds = at.select("sector").distinct().withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    nodes = origins.select("zone", F.col("node").alias("origin"))
    # A node that reaches none of a sector's jobs adds 0 to the mean of its zone, so rows are made for zones only, not for nodes.
    totals = nodes.join(sums, "origin").groupBy("zone", "sector", "threshold").agg(F.sum("jobs").alias("total"))
    every = nodes.groupBy("zone").agg(F.count("*").alias("n")).join(F.broadcast(kinds))
    return every.join(totals, ["zone", "sector", "threshold"], "left").select("zone", "sector", "threshold", (F.coalesce("total", F.lit(0.0)) / F.col("n")).alias("jobs"))


def wide_accessibility(long: DataFrame, sectors: list[str], thresholds: list[float], year: int) -> DataFrame:
    """A row per zone with columns jobs_<sector>_<threshold>_<year>."""
    picks = [F.max(F.when((F.col("sector") == s) & (F.col("threshold") == float(t)), F.col("jobs"))).alias(f"jobs_{s}_{t:g}_{year}") for s in sectors for t in thresholds]
    return long.groupBy("zone").agg(*picks)


def service_score(attraction, population):
    """Attraction over the population it serves, at least one person."""
    return attraction / F.greatest(population, F.lit(1.0))


def service_accessibility(edges: DataFrame, zones: DataFrame, amenities: DataFrame, population: DataFrame, *, radius: float, weight: str = "length") -> DataFrame:
    """(zone, accessibility_services): the mean index of a zone's nodes.

    ``zones``: zone, node; ``amenities``: node, attraction; ``population``:
    node, value. The people that each amenity reaches divide its attraction;
    the quotients, summed by node, are what the zones' nodes reach.
    """
    reached = decayed_sums(edges, amenities.select("node").distinct(), population, radius=radius, weight=weight)
    scores = amenities.join(reached, "node").select("node", service_score(F.col("attraction"), F.col("total")).alias("value"))
    total = decayed_sums(edges, zones.select("node").distinct(), scores, radius=radius, weight=weight)
    return zones.join(total, "node").groupBy("zone").agg(F.avg(service_index(F.col("total"))).alias("accessibility_services"))


def service_index(total):
    """A decayed sum on a scale from 0 to 1: log(x + 1) * 12.5, clipped to 0..100, over 100."""
    return F.least(F.greatest(F.log1p(total) * 12.5, F.lit(0.0)), F.lit(100.0)) / 100


def nearest_crossing(west, east):
    """The shorter of two travel times; a missing one doesn't count."""
    return F.least(west, east)
