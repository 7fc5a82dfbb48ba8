"""Percentiles by selection against Spark's own, on ties, hot values, nulls and odd numbers."""

import random

import pytest
from pyspark.sql import functions as F

from plotwise.operators import choice, features
from plotwise.operators.quantiles import quantiles

FRACTIONS = {"p00": 0.0, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p999": 0.999, "p100": 1.0}


def own(df):
    return {r[0]: tuple(r[1:]) for r in df.groupBy("feature").agg(F.count("value"), *[F.percentile("value", F.lit(p)) for p in FRACTIONS.values()]).collect()}


def found(df):
    return {r[0]: tuple(r[1:]) for r in quantiles(df, FRACTIONS).collect()}


def test_equal_to_percentile(spark):
    rng = random.Random(5)
    data = [("one", 7.0), ("none", None), (None, 3.0), (None, 4.0)]
    data += [("two", 1.0), ("two", 2.0), ("same", 5.0), ("same", 5.0), ("same", None)]
    data += [("zero", z) for z in (0.0, -0.0, 0.0, 1.0)]
    for name, n in (("small", 9), ("middle", 1_001), ("large", 30_000)):
        data += [(name, rng.gauss(0, 1)) for _ in range(n)]
        data += [(f"{name} ties", float(rng.randrange(6))) for _ in range(n)]
        data += [(f"{name} hot", 2.5 if rng.random() < 0.4 else rng.lognormvariate(0, 20)) for _ in range(n)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "feature string, value double").repartition(7)
    assert found(df) == own(df)


def test_odd_input(spark):
    empty = spark.createDataFrame([], "feature string, value double")
    assert found(empty) == {}
    odd = spark.createDataFrame([("a", v) for v in (float("nan"), 1.0, float("-inf"))], "feature string, value double")
    low, mid, high = quantiles(odd, {"a": 0.0, "b": 0.5, "c": 1.0}).select("a", "b", "c").first()
    assert (low, mid) == (float("-inf"), 1.0) and high != high
    # Columns of other names, and columns that clash with helpers.
    named = spark.createDataFrame([(1, 2.0, 9), (1, 4.0, 9)], "k int, v double, n int")
    assert [tuple(r) for r in quantiles(named, {"q": 0.5}, by="k", value="v").collect()] == [(1, 2, 3.0)]
    with pytest.raises(ValueError, match="not fractions"):
        quantiles(odd, {"x": 1.5})


def test_nothing_gathers_a_column(spark):
    df = spark.range(5_000).select((F.col("id") % 97).cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    for out in (choice.distribution(df, "x"), features.scale_audit(df, ["x", "y"]), features.nice_denominators(df, ["x", "y"])):
        assert " percentile(" not in out._jdf.queryExecution().optimizedPlan().toString()
    row = choice.distribution(df, "y").first()
    assert (row["count"], row.p05, row.p50, row.p95) == (5_000, pytest.approx(249.95), 2_499.5, pytest.approx(4_749.05))
    nothing = choice.distribution(df.where("x < 0"), "x").first()
    assert nothing["count"] == 0 and nothing.p50 is None
