"""Exact percentiles of many columns at once, by selection: no task gathers the values of a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut

#: Places at which the sketch is read; a bracket reaches two of them beyond its ranks, twenty times the sketch's error.
STEPS = 1_000
ACCURACY = 10_000


def _positions(p: float) -> tuple[Column, Column, Column]:
    """Of the rows' ``n``: the place of a fraction, from 0, and the ranks, from 1, of the values on both sides of it."""
    place = (F.col("n") - 1).cast("double") * F.lit(float(p))
    return place, F.floor(place) + 1, F.ceil(place) + 1


def quantiles(values: DataFrame, fractions: dict[str, float], *, by: str = "feature", value: str = "value", weight: str | None = None) -> DataFrame:
    """(by, n, one column for each of ``fractions``): exact percentiles of each group, between ranks as Spark's ``percentile`` has them.

    For a bounded number of groups, such as the columns of a table below each
    other; each may have any number of values, distinct or equal. Nulls count
    as no value; a group without values has n = 0 and nulls, a group that is
    null is one of its own; NaN is the greatest value. An empty table gives no
    row. Fractions are from 0 to 1.

    A sketch of bounded size, merged from the tasks, gives a bracket around
    each rank (a row per group reaches the driver). A second pass counts what
    lies below a bracket and how often each value in it occurs; tasks send
    these counts only. The values within brackets, about half a percent of all,
    are then placed by ranges and their running counts, so ties and hot values
    are single rows. ``weight``: a column of how many times (a whole number, null
    or below 1 is none) a row stands for its value; each distinct value is then
    placed, without a sketch. A rank that is in no bracket, which the sketch's error
    rules out, would raise an error rather than give another value.
    """
    bad = [p for p in fractions.values() if not 0 <= p <= 1]
    if bad:
        raise ValueError(f"not fractions: {bad}")
    times = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    rows = values.select(F.col(by).alias("__g"), F.col(value).cast("double").alias("v"), times.alias("w"))
    if weight is not None:
        rows = rows.groupBy("__g", "v").agg(F.coalesce(F.sum(F.when(F.col("w") > 0, F.col("w"))), F.lit(0)).alias("w")).withColumn("v", F.when(F.col("w") > 0, F.col("v")))
    number = F.when(~F.isnan("v"), F.col("v"))
    cuts = F.expr(f"percentile_approx(number, array({', '.join(f'{k / STEPS}D' for k in range(STEPS + 1))}), {ACCURACY})")
    sketch = rows.withColumn("number", number).groupBy("__g").agg(F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("w"))), F.lit(0)).alias("n"), F.count("number").alias("numbers"), cuts.alias("cuts"))
    # Brackets that reach an end of the sketch are open there, so NaN, which the sketch leaves out, is within those above it.
    at = lambda step, beyond: F.when((step <= 0) | (step >= STEPS), beyond).otherwise(F.get("cuts", step.cast("int")))
    size = F.greatest(F.col("numbers"), F.lit(1))
    brackets = []
    for mark, p in enumerate(fractions.values()):
        _, low, high = _positions(p)
        lo, hi = F.least(F.floor((low - 1) / size * STEPS) - 2, F.lit(STEPS - 1)), F.ceil(high / size * STEPS) + 2
        if weight is not None:  # the sketch knows nothing of weights
            lo, hi = F.lit(0), F.lit(STEPS)
        brackets.append(F.struct(F.lit(mark).alias("mark"), at(lo, F.lit(float("-inf"))).alias("lo"), at(hi, F.lit(float("nan"))).alias("hi")))
    known = sketch.select(F.col("__g").alias("__h"), "n", F.array(*brackets).alias("brackets"))
    bounds = F.broadcast(values.sparkSession.createDataFrame(known.collect(), known.schema))  # a row per group

    met = rows.where("v is not null").join(bounds, F.col("__g").eqNullSafe(F.col("__h"))).select("__g", "v", "w", F.explode(F.filter("brackets", lambda b: F.col("v") <= b["hi"])).alias("b"))
    counted = met.groupBy("__g", F.col("b.mark").alias("mark"), F.when(F.col("v") >= F.col("b.lo"), F.col("v")).alias("v")).agg(F.sum("w").alias("m"))

    order = [F.col("__g").asc_nulls_first(), F.col("mark").asc(), F.col("v").asc_nulls_first()]
    ranged = cut(counted.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    same = ["__g", "mark"]
    sums = ranged.groupBy(*same, "__range").agg(F.sum("m").alias("__m"))  # no more rows than ranges and brackets
    starts = sums.select(F.col("__g").alias("__h"), F.col("mark").alias("__k"), F.col("__range").alias("__r"), F.coalesce(F.sum("__m").over(Window.partitionBy(*same).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    running = F.sum("m").over(Window.partitionBy("__range", *same).orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn("last", running).join(F.broadcast(starts), F.col("__g").eqNullSafe(F.col("__h")) & (F.col("mark") == F.col("__k")) & (F.col("__range") == F.col("__r")))
    placed = placed.where("v is not null").select("__g", "mark", "v", (F.col("__start") + F.col("last") - F.col("m")).alias("before"), (F.col("__start") + F.col("last")).alias("last"))

    ends = placed.join(bounds.select("__h", "n"), F.col("__g").eqNullSafe(F.col("__h")))
    has = lambda rank: (F.col("before") < rank) & (F.col("last") >= rank)
    picks = []
    for mark, p in enumerate(fractions.values()):
        _, low, high = _positions(p)
        mine = F.col("mark") == mark
        picks += [F.max(F.when(mine & has(low), F.col("v"))).alias(f"__low{mark}"), F.max(F.when(mine & has(high), F.col("v"))).alias(f"__high{mark}")]
    found = ends.groupBy("__g").agg(*picks)
    out = bounds.join(found, F.col("__g").eqNullSafe(F.col("__h")), "left")
    columns = []
    for mark, (name, p) in enumerate(fractions.items()):
        place, low, high = _positions(p)
        a, b = F.col(f"__low{mark}"), F.col(f"__high{mark}")
        between = F.when(a == b, a).otherwise((high - 1 - place) * a + (place - low + 1) * b)
        lost = (F.col("n") > 0) & (a.isNull() | b.isNull())
        columns.append(F.when(lost, F.raise_error(F.lit("rank outside its bracket"))).otherwise(between).alias(name))
    return out.select(F.col("__h").alias(by), "n", *columns)
