"""Which alternatives were active around each sale, and choice frames.

The long form, a row per (obs_id, alt_id), is the canonical one; wide frames
only come from :func:`wide_choice_frame`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantiles
from .relate import day_number, with_places


def prepare_transactions(sales: DataFrame, known: DataFrame, *, min_year: int, max_year: int, threshold: int = 1) -> tuple[DataFrame, DataFrame]:
    """(sales kept, counts per alternative): sales of the years, in known alternatives with at least ``threshold`` of them.

    ``sales``: obs_id, alt_id, purchase_date, ...; ``known``: alt_id. Counts
    cover all known alternatives that have a sale in these years.
    """
    dated = sales.withColumn("purchase_year", F.year("purchase_date")).where(F.col("purchase_year").between(min_year, max_year))
    dated = dated.join(known.select("alt_id").distinct(), "alt_id", "left_semi")
    counts = dated.groupBy("alt_id").agg(F.count("*").alias("n"))
    kept = dated.join(counts.where(F.col("n") >= threshold), "alt_id", "left_semi")
    return kept, counts


def with_transaction_ids(sales: DataFrame) -> DataFrame:
    """sales with transaction_id, from 0 by date (nulls first), alternative and obs_id; a day may hold any share of the sales."""
    return with_places(sales, [F.col("purchase_date").asc_nulls_first(), F.col("alt_id").asc(), F.col("obs_id").asc()], "transaction_id")


def rolling_sales(sales: DataFrame, *, window_days: int) -> DataFrame:
    """(alt_id, day, roll): sales of an alternative within ``window_days`` of each day on which anything was sold.

    Daily counts first, then a range frame over the days of one alternative:
    alternatives x days rows instead of sales x sales.
    """
    dated = sales.where("purchase_date is not null and alt_id is not null").select("alt_id", day_number(F.col("purchase_date")).alias("day"))
    daily = dated.groupBy("alt_id", "day").agg(F.count("*").alias("n"))
    # Both sides of the grid are distinct keys: the number of alternatives and that of days, whatever the number of sales.
    grid = daily.select("alt_id").distinct().join(daily.select("day").distinct())
    frame = Window.partitionBy("alt_id").orderBy("day").rangeBetween(-window_days, window_days)
    full = grid.join(daily, ["alt_id", "day"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.select("alt_id", "day", F.sum("n").over(frame).alias("roll"))


@dataclass
class ActiveChoiceSet:
    """long: obs_id, alt_id, chosen, active_sales, available (only rows that are available if sparse); kept, dropped: the sales; n_alternatives: (obs_id, n)."""

    long: DataFrame
    kept: DataFrame
    dropped: DataFrame
    n_alternatives: DataFrame


def active_choice_set(sales: DataFrame, *, window_days: int = 365, min_available: int = 2, sparse: bool = False, focal: DataFrame | None = None) -> ActiveChoiceSet:
    """For each sale the other sales of every alternative within the window, and whether it was available.

    The focal sale doesn't count for its own alternative. An alternative is
    available with any active sale, or if it was chosen. Sales with fewer than
    ``min_available`` alternatives are dropped. ``focal``: the sales whose sets
    are wanted, if not all; every sale is counted all the same.
    """
    if window_days < 0:
        raise ValueError("window_days must not be negative")
    if min_available < 1:
        raise ValueError("min_available must be positive")
    missing = {"obs_id", "alt_id", "purchase_date"} - set(sales.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    roll = rolling_sales(sales, window_days=window_days)
    sales = sales if focal is None else focal
    obs = sales.where("purchase_date is not null").select("obs_id", F.col("alt_id").alias("chosen_alt"), day_number(F.col("purchase_date")).alias("day"))
    if sparse:  # unavailable rows never enter the likelihood
        roll = roll.where("roll > 0")
    long = obs.join(roll, "day").withColumn("chosen", F.col("alt_id") == F.col("chosen_alt"))
    active = F.greatest(F.col("roll") - F.col("chosen").cast("int"), F.lit(0))
    long = long.select("obs_id", "alt_id", "chosen", active.alias("active_sales")).withColumn("available", (F.col("active_sales") > 0) | F.col("chosen"))
    if sparse:
        long = long.where("available")
    sizes = long.groupBy("obs_id").agg(F.count_if("available").alias("n"))
    good = sizes.where(F.col("n") >= min_available).select("obs_id")
    return ActiveChoiceSet(long.join(good, "obs_id", "left_semi"), sales.join(good, "obs_id", "left_semi"), sales.join(good, "obs_id", "left_anti"), sizes)


def situations(sales: DataFrame) -> DataFrame:
    """(obs_id, alt_id, purchase_date, weight): of the sales of an alternative on a day, which choose the same from the same, the least, and how many they are."""
    day = F.col("purchase_date").cast("date").alias("purchase_date")
    return sales.where("obs_id is not null").groupBy("alt_id", day).agg(F.min("obs_id").alias("obs_id"), F.count("*").alias("weight")).select("obs_id", "alt_id", "purchase_date", "weight")


def availability_summary(choice: ActiveChoiceSet, *, min_available: int = 2) -> DataFrame:
    """One row: n_obs, n_kept, n_dropped, drop_share, and the least, median and most alternatives of the sales kept."""
    n = F.col("n")
    kept = n >= min_available
    total, good = F.count("*"), F.count_if(kept)
    return choice.n_alternatives.agg(
        total.alias("n_obs"), good.alias("n_kept"), (total - good).alias("n_dropped"), ((total - good) / total).alias("drop_share"),
        F.min(F.when(kept, n)).alias("min_alternatives"), F.median(F.when(kept, n)).alias("median_alternatives"), F.max(F.when(kept, n)).alias("max_alternatives"),
    )


def distribution(df: DataFrame, column: str, percentiles: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95), *, exact: bool = True) -> DataFrame:
    """One row: count, mean, std (n - 1), min, percentiles (p05 ...), max; percentiles are exact by selection, or approximate with exact=False. Nulls count as no value; without values all but count are null."""
    names = {f"p{round(100 * p):02d}": p for p in percentiles}
    near = [] if exact else [F.percentile_approx(column, p, 10_000).alias(name) for name, p in names.items()]
    row = df.agg(F.count(column).alias("count"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"), *near)
    if exact:
        marks = quantiles(df.select(F.lit(0).alias("feature"), F.col(column).alias("value")), names).drop("feature", "n")
        row = row.join(F.broadcast(marks), how="left")
    return row.select("count", "mean", "std", "min", *names, "max")


def built_area_long(features: DataFrame, prefix: str = "built_area_") -> DataFrame:
    """(alt_id, year, area) from the columns built_area_YYYY."""
    years = [c for c in features.columns if c.startswith(prefix) and c[len(prefix) :].isdigit()]
    if not years:
        raise ValueError("no built area columns")
    return features.unpivot("alt_id", years, "__c", "area").select("alt_id", F.substring("__c", len(prefix) + 1, 4).cast("int").alias("year"), "area")


def log_hectares(area: Column) -> Column:
    return F.log1p(area / 10_000)


RESERVED = ("obs_id", "alt_id", "chosen", "available", "purchase_year")


def choice_frame(sales: DataFrame, features: DataFrame, static: list[str], *, built: DataFrame | None = None, long: DataFrame | None = None, dynamic: list[str] = ()) -> DataFrame:
    """The long choice frame: obs_id, alt_id, chosen, available, the static features, log_built_area_ha of the purchase year, and dynamic columns of ``long``.

    Without ``long`` every alternative of ``features`` is available for every
    sale (features hold a row per alternative and are the small side).
    """
    clash = [c for c in (*static, *dynamic) if c in RESERVED]
    if clash:
        raise ValueError(f"reserved names: {clash}")
    if set(static) & set(dynamic):
        raise ValueError("static and dynamic features overlap")
    missing = [c for c in static if c not in features.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    obs = sales.select("obs_id", F.col("alt_id").alias("chosen_alt"), F.year("purchase_date").alias("purchase_year"))
    if long is None:
        frame = obs.join(features.select("alt_id", *static)).withColumn("available", F.lit(True))
    else:
        frame = obs.join(long.select("obs_id", "alt_id", "available", *dynamic), "obs_id").join(features.select("alt_id", *static), "alt_id")
    frame = frame.withColumn("chosen", F.col("alt_id") == F.col("chosen_alt"))
    columns = ["obs_id", "alt_id", "chosen", "available", *static]
    if built is not None:
        area = built.select(F.col("alt_id"), F.col("year").alias("purchase_year"), log_hectares(F.col("area")).alias("log_built_area_ha"))
        frame = frame.join(area, ["alt_id", "purchase_year"], "left")
        columns.append("log_built_area_ha")
    return frame.select(*columns, *dynamic)


def wide_choice_frame(long: DataFrame, features: list[str], alternatives: list[int]) -> DataFrame:
    """A row per sale with a column feature_alt for each feature and alternative; the alternatives are listed, so no job looks for them."""
    picks = [F.max(F.when(F.col("alt_id") == a, F.col(f))).alias(f"{f}_{a}") for f in (*features, "available") for a in alternatives]
    return long.groupBy("obs_id").agg(F.max(F.when(F.col("chosen"), F.col("alt_id"))).alias("choice"), *picks)


def validate_choice_frame(long: DataFrame, features: list[str], *, sentinel: float = 99999.0) -> DataFrame:
    """(check, passed, value) of nine checks on a long frame, from one pass over it and one over its sales."""
    bad = lambda test: F.sum(F.greatest(*[F.when(test(F.col(f)), 1).otherwise(0) for f in features], F.lit(0)))
    per_obs = long.groupBy("obs_id").agg(
        F.count_if("chosen").alias("chosen"), F.count_if(F.col("chosen") & F.col("available")).alias("chosen_available"), F.count_if("available").alias("available"),
        F.count_if(F.col("available").isNull()).alias("unknown"), F.count_if(F.col("alt_id").isNull()).alias("no_alt"),
        bad(lambda c: c.isNull()).alias("nulls"), bad(lambda c: F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))).alias("infinite"), bad(lambda c: c == sentinel).alias("sentinels"),
    )
    one = per_obs.agg(
        F.sum("nulls").alias("no_nulls"), F.sum("infinite").alias("finite"), F.sum("sentinels").alias("no_sentinel"), F.sum("no_alt").alias("alternatives_valid"),
        F.sum(F.lit(0)).alias("has_features"), F.sum("unknown").alias("availability_known"), F.count_if(F.col("chosen") != 1).alias("one_choice"),
        F.count_if(F.col("chosen_available") != F.col("chosen")).alias("chosen_available"), F.count_if(F.col("available") < 2).alias("two_available"),
    )
    one = one.withColumn("has_features", F.lit(0 if features else 1))
    names = one.columns
    return one.select(*[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in names]).unpivot([], names, "check", "n").select("check", (F.col("n") == 0).alias("passed"), F.col("n").cast("string").alias("value"))
