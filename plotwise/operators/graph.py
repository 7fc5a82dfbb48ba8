"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark) -> None:
    """Use the shared folder that the setting spark.checkpoint.dir names. Where none is set, a local session takes a temporary one; a cluster raises, as its machines share none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="plotwise-"))


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, without its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _contract(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one partition as stars: each node with the smallest node that it reaches there."""
    parent: dict = {}
    kind = None

    def root(x):
        top = x
        while (up := parent[top]) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    for part in parts:
        kind = part.schema.field(0).type
        for u, v in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            parent.setdefault(u, u), parent.setdefault(v, v)
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], ["u", "v"])


def connected_components(edges: DataFrame, *, src: str = "src", dst: str = "dst", per_task: int = 250_000, hot_share: float = 0.005) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable. Nodes are numbers or strings.

    The edges are dealt over tasks of about ``per_task``, and each task turns
    its own into stars. Then two star operations alternate (link every
    neighbour to the smallest one, first for larger and then for smaller
    neighbours) until the edges no longer change, which takes a number of
    rounds logarithmic in the size of a component; where one task holds all
    edges there is nothing left to do. Minima are combined before each shuffle.
    Nodes that have ``hot_share`` of all edges or more, of which there are at
    most 2 / hot_share, are broadcast instead of shuffled, so no node gathers
    its edges in one task. Edges with a null end and loops add nothing but
    their node; no edges, no rows.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    dealt = cut(pairs)
    tasks = dealt.count() // per_task + 1
    current = cut(dealt.repartition(tasks).mapInArrow(_contract, pairs.schema))
    mark = F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))
    before, now = None, current.agg(*mark).first() if tasks > 1 else None
    while before != now:
        both = current.where("u <> v").select("u", "v").union(current.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
        many = max(1000, int(hot_share * now[0]))
        hot = F.broadcast(least.where(F.col("n") > many).select("u", "m"))
        larger = both.where("v > u")
        large = larger.join(hot, "u").union(larger.join(hot.select("u"), "u", "left_anti").join(least.where(F.col("n") <= many).select("u", "m"), "u"))
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v"))
        loops = current.where("u = v")
        # Repeated edges do no harm here; the distinct() at the end of a round keeps their number bounded.
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower.select("u", F.col("m").alias("v")))
        current = cut(small.union(loops).distinct())
        before, now = now, current.agg(*mark).first()
    stars = current.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = current.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return stars.union(roots).groupBy("node").agg(F.min("component").alias("component"))
