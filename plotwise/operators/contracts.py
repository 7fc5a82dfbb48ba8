"""Checks of data contracts, each as rows (check, passed, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checks(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """One row for each test: an aggregate that counts failures, 0 being a pass. All tests share one pass."""
    names = list(tests)
    row = df.agg(*[F.coalesce(c.cast("long"), F.lit(0)).alias(n) for n, c in tests.items()])
    return row.unpivot([], names, "check", "n").select("check", (F.col("n") == 0).alias("passed"), F.col("n").cast("string").alias("value"))


def neighbourhood_contract(zones: DataFrame, sales: DataFrame, key: str = "name_detail") -> DataFrame:
    """Unique, known keys, boxes that aren't empty, sales in every zone and no sale outside."""
    n = sales.groupBy(key).agg(F.count("*").alias("__n"))
    joined = zones.join(n, key, "full_outer").withColumn("__zone", F.col("x0").isNotNull())
    tests = {
        "keys_unique": F.count_if("__zone") - F.count_distinct(F.when(F.col("__zone"), F.col(key))),
        "keys_known": F.count_if(F.col("__zone") & F.col(key).isNull()),
        "boxes_not_empty": F.count_if(F.col("__zone") & ~((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))),
        "all_have_sales": F.count_if(F.col("__zone") & F.col("__n").isNull()),
        "unmatched_sales": F.sum(F.when(~F.col("__zone"), F.col("__n"))),
    }
    return checks(joined, tests)


def exposure_contract(exposure: DataFrame, bands: list[str]) -> DataFrame:
    """One row for each zone and sector, distances of 0 or more, and sums that never fall from a band to the next larger."""
    falls = [F.col(f"jobs_within_{a}") > F.col(f"jobs_within_{b}") + 1e-9 for a, b in zip(bands, bands[1:], strict=False)]
    any_fall = F.lit(False)
    for f in falls:
        any_fall = any_fall | f
    tests = {
        "rows_unique": F.count("*") - F.count_distinct("alt_id", "sector"),
        "distances_not_negative": F.count_if((F.col("distance_m") < 0) | (F.col("centroid_distance_m") < 0)),
        "bands_monotone": F.count_if(any_fall),
        "flags_follow_distance": F.count_if((F.col("distance_m") <= 500) != F.col("within_500m")),
    }
    return checks(exposure, tests)


def final_contract(final: DataFrame, zones: DataFrame, required: list[str], key: str = "alt_id") -> DataFrame:
    """The final table has a row for each zone, unique keys, every required column, and no key of its own."""
    absent = [c for c in required if c not in final.columns]
    joined = final.select(F.col(key).alias("__f")).join(zones.select(F.col(key).alias("__z")), F.col("__f") == F.col("__z"), "full_outer")
    tests = {"columns_present": F.max(F.lit(len(absent))), "keys_unique": F.count("__f") - F.count_distinct("__f"), "all_zones": F.count_if(F.col("__f").isNull()), "no_extra": F.count_if(F.col("__z").isNull())}
    return checks(joined, tests)
