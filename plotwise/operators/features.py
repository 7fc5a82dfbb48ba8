"""Feature scales, catalogs and audits. Values are read in one pass over the unpivoted columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut
from .quantiles import quantiles

CROSSINGS = ("travel_time_crossing_west", "travel_time_crossing_east")
NEAREST = "min(travel_time_crossing_west, travel_time_crossing_east)"
CATALOG = "source_column string, model_column string, family string, role string, transform string, scale_denominator double, eligible boolean, reason string"

# Members of the job groups.
JOB_GROUPS = {
    "industrial": ("manufacture", "logistics", "construction"),
    "services": ("business_services", "care_education_health", "local_services"),
    "commerce": ("commerce",),
    "all": ("all",),
}


def finite(value: Column) -> Column:
    """value as a number; null where it is missing, NaN or infinite."""
    number = value.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def long_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, value): the columns below each other, as finite numbers."""
    return df.select(*[finite(F.col(c)).alias(c) for c in columns]).unpivot([], columns, "feature", "value")


def snapped(raw: Column) -> Column:
    """The number of the form 1, 2, 5 or 10 times a power of ten that is nearest on a log scale; the smaller of two that are equally near."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    candidates = [power * m for m in (0.5, 1, 2, 5, 10)]
    return F.least(*[F.struct(F.round(F.abs(F.log(c / raw)), 12).alias("gap"), c.alias("v")) for c in candidates])["v"]


def nice_denominators(df: DataFrame, columns: list[str], *, target_p75: float = 5.0) -> DataFrame:
    """(feature, denominator, n_unique): a round number that brings the 75th percentile of the non-zero sizes near ``target_p75``; 1 without such values."""
    values = long_values(df, columns)
    n_unique = values.groupBy("feature").agg(F.count_distinct("value").alias("n_unique"))
    sizes = values.withColumn("value", F.when(F.col("value") != 0, F.abs("value")))
    stats = n_unique.join(F.broadcast(quantiles(sizes, {"p75": 0.75})), "feature")
    raw = F.col("p75") / target_p75
    return stats.select("feature", F.when(raw > 0, snapped(raw)).otherwise(1.0).alias("denominator"), "n_unique")


# Names of the contract. A family by the pattern of a column's name, and the cluster measures that models choose from.
FAMILIES = {
    "identifier": "name|name_detail|geometry|alt_id",
    "access": "access",
    "job_accessibility": "jobs_.*_2025",
    "service_accessibility": "accessibility_services",
    "travel_time": "travel_time_city_center|" + "|".join(map(re.escape, (*CROSSINGS, NEAREST))),
    "built_area_history": "built_area_.*",
    "manufacturing_cluster": "(log_|nearest_)?mfg_.*|.*_mfg_cluster.*",
    "logistics_cluster": "(log_|nearest_)?logistics_.*|.*_logistics_cluster.*",
}
SCREENS = {"manufacturing_cluster": "mfg", "logistics_cluster": "logistics"}
SCREENED = ("{}_distance_nearest_cluster_km", "log_{}_jobs_within_2km", "log_{}_cluster_gravity_inv_sq")

# What each role means for models; columns in the roles of the second table are in none.
USED = {
    "control": "in every model",
    "job_screen": "one of the job measures to choose from",
    "mfg_screen": "one of the manufacturing measures to choose from",
    "logistics_screen": "one of the logistics measures to choose from",
    "transaction_varying": "looked up by the year of each sale",
}
UNUSED = {
    "exclude": "says nothing that a model could use",
    "helper": "only goes into another column",
    "available_not_screened": "stays in the table for other uses",
}


def family_of(column: str) -> str:
    return next((f for f, pattern in FAMILIES.items() if re.fullmatch(pattern, column)), "other")


def role_of(column: str, family: str, *, varies: bool) -> str:
    """The role of a column by its family; ``varies``: whether it has two values at least."""
    if family in ("identifier", "other") or (family == "job_accessibility" and not varies):
        return "exclude"
    if family in SCREENS:
        sector = SCREENS[family]
        return f"{sector}_screen" if column in [name.format(sector) for name in SCREENED] else "available_not_screened"
    if column in CROSSINGS:
        return "helper"
    return {"job_accessibility": "job_screen", "built_area_history": "transaction_varying"}.get(family, "control")


def scaling_of(column: str, family: str, denominator: float) -> tuple[str, str, float | None]:
    """(model column, transform in words, denominator) of a column that models use."""
    if family == "access":
        return "access_is_restricted", "0 if open, 1 if gated", 1.0
    if family == "built_area_history":
        return "log_built_area_ha", "ln(1 + hectares) of the year of the sale", None
    if column.startswith("log_"):
        return column, "as it is, a logarithm", 1.0
    stem = "travel_time_nearest_crossing" if column == NEAREST else column
    return f"{stem}_scaled", f"value / {denominator:g}", denominator


def feature_catalog(df: DataFrame) -> DataFrame:
    """One row for each column of a neighbourhood table: what it is, whether and how it enters models.

    The family follows from the name, the role from the family, and whether a
    column is eligible from the role. Denominators, and which job columns vary
    at all, come from one pass over the values. A row for the nearest crossing
    is added.
    """
    source = df.withColumn(NEAREST, F.least(*[finite(F.col(c)) for c in CROSSINGS])) if set(CROSSINGS) <= set(df.columns) else df
    families = {c: family_of(c) for c in source.columns}
    numbers = [c for c, f in families.items() if f not in ("identifier", "access", "built_area_history", "other")]
    known = {r["feature"]: r for r in nice_denominators(source, numbers).collect()} if numbers else {}  # a row per column
    rows = []
    for c, family in families.items():
        role = role_of(c, family, varies=c in known and known[c]["n_unique"] > 1)
        if role in USED:
            model, transform, denominator = scaling_of(c, family, known[c]["denominator"] if c in known else 1.0)
            rows.append((c, model, family, role, transform, denominator, True, USED[role]))
        else:
            # A job column that doesn't vary keeps the name that it would have.
            rows.append((c, f"{c}_scaled" if family == "job_accessibility" else None, family, role, None, None, False, UNUSED[role]))
    return df.sparkSession.createDataFrame(rows, CATALOG)


def prepare_features(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """Identifiers, eligible features on their scale, and the built areas by year."""
    ids = [c for c in ("alt_id", "name", "name_detail", "geometry") if c in df.columns]
    out: dict[str, Column] = {}
    for r in catalog.where("eligible and model_column is not null and role <> 'transaction_varying'").collect():  # a row per column
        name, source = r["model_column"], r["source_column"]
        if name in out:
            continue
        if name == "access_is_restricted":
            out[name] = F.when(F.col("access") == "LIBRE", 0).when(F.col("access") == "RESTRINGIDO", 1)
            continue
        value = F.least(*[finite(F.col(c)) for c in CROSSINGS]) if source == NEAREST else F.col(source).try_cast("double") if dict(df.dtypes)[source] == "string" else F.col(source).cast("double")
        out[name] = value / float(r["scale_denominator"])
    built = [F.col(c).cast("double").alias(c) for c in df.columns if c.startswith("built_area_")]
    return df.select(*ids, *[v.alias(k) for k, v in out.items()], *built)


def scale_audit(df: DataFrame, columns: list[str], *, lower: float = 1.0, upper: float = 10.0, weight: str | None = None) -> DataFrame:
    """(feature, missing, n_unique, min, p25, median, p75, max, scale_warning); numbers to four places, percentiles exact by selection. ``weight``: a column of how many alike rows a row stands for; equal values are then one row."""
    v, size = F.col("value"), F.abs(F.col("value"))
    if weight is None:
        values, missing = long_values(df, columns), F.count_if(v.isNull())
    else:
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), finite(F.col(c)).alias("value")) for c in columns]))
        values = cut(df.where(F.col(weight) > 0).select(each.alias("e"), F.col(weight).cast("long").alias("w")).groupBy("e.feature", "e.value").agg(F.sum("w").alias("w")))
        missing = F.coalesce(F.sum(F.when(v.isNull(), F.col("w"))), F.lit(0))
    s = values.groupBy("feature").agg(
        missing.alias("missing"), F.count_distinct("value").alias("n_unique"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.count("value").alias("__n"), F.count_if((v != 0) & (v != 1)).alias("__other"),
    )
    # Percentiles of the values, of their sizes, and of the sizes above zero, in one selection.
    series = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), c.alias("v")) for k, c in (("value", v), ("size", size), ("some", F.when(size > 0, size)))]))
    own = [] if weight is None else ["w"]
    marks = quantiles(values.select("feature", *own, series.alias("s")).select(F.concat_ws(":", "s.k", "feature").alias("key"), F.col("s.v").alias("value"), *own), {"p25": 0.25, "median": 0.5, "p75": 0.75}, by="key", weight="w" if own else None)
    of = lambda k, names: marks.where(F.col("key").startswith(f"{k}:")).select(F.expr(f"substr(key, {len(k) + 2})").alias("feature"), *[F.col(a).alias(b) for a, b in names.items()])
    for part in (of("value", {c: c for c in ("p25", "median", "p75")}), of("size", {"p75": "__a75"}), of("some", {"median": "__mid"})):
        s = s.join(F.broadcast(part), "feature")
    warning = F.when(F.col("__n") == 0, "all missing").when(F.col("__other") == 0, "binary").when(F.col("__a75") > upper, "too large").when(F.col("__mid").isNull() | (F.col("__mid") < lower), "too small").otherwise("ok")
    places = [(F.floor(F.col(c) * 1e4 + 0.5) / 1e4).alias(c) for c in ("min", "p25", "median", "p75", "max")]
    return s.select("feature", "missing", "n_unique", *places, warning.alias("scale_warning"))


def row_mean(columns: list[str]) -> Column:
    """The mean of a row's columns that aren't null; null if all are."""
    n = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    total = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns), F.lit(0.0))
    return F.when(n > 0, total / n)


def job_group_specs(horizons: tuple[int, ...] = (10, 20), year: int = 2025) -> dict[str, list[str]]:
    """The scaled columns behind each group and horizon."""
    return {f"jobs_group_{g}_{h}": [f"jobs_{m}_{h}_{year}_scaled" for m in members] for h in horizons for g, members in JOB_GROUPS.items()}


def add_job_groups(df: DataFrame, specs: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """(df with the mean of each group's columns, catalog of the groups)."""
    missing = sorted({c for cs in specs.values() for c in cs} - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    there = [c for c in specs if c in df.columns]
    if there:
        raise ValueError(f"columns already exist: {there}")
    catalog = df.sparkSession.createDataFrame([(k, cs, len(cs)) for k, cs in specs.items()], "feature string, members array<string>, n_members int")
    return df.withColumns({k: row_mean(cs) for k, cs in specs.items()}), catalog


def ring_metric(near: Column, far: Column, *, tolerance: float = 1e-9) -> Column:
    """The nearer count plus half of the ring beyond it; a ring below zero, by more than rounding, raises an error."""
    ring = far - near
    return F.when(ring < -tolerance, F.raise_error(F.lit("negative ring"))).otherwise(near + F.greatest(ring, F.lit(0.0)) * 0.5)


def documentation_view(catalog: DataFrame, families: dict[str, str], descriptions: DataFrame) -> DataFrame:
    """The catalog with families overridden by the longest prefix that fits, descriptions (source_column, description), sorted."""
    family = F.col("family")
    for prefix in sorted(families, key=len):  # the longest is tested first
        family = F.when(F.col("source_column").startswith(prefix), families[prefix]).otherwise(family)
    return catalog.withColumn("family", family).join(descriptions, "source_column", "left").orderBy("family", "source_column")
