"""Model specs, screening, collinearity and model comparison."""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .mnl import fit_specs

SPEC_SCHEMA = "spec_id string, kind string, families array<string>, candidates array<string>, columns array<string>"


def _checked(columns: list[str]) -> list[str]:
    if len(set(columns)) != len(columns):
        raise ValueError(f"duplicate columns in spec: {columns}")
    return columns


def single_candidate_specs(spark, base: list[str], groups: dict[str, list[str]]) -> DataFrame:
    """A baseline spec and one spec for each candidate feature, its columns being the candidate and then the controls. Features must be unique over all groups."""
    features = [f for fs in groups.values() for f in fs]
    if len(set(features)) != len(features):
        raise ValueError("candidate features must be unique")
    if set(features) & set(base):
        raise ValueError("candidates overlap controls")
    rows = [("baseline", "baseline", [], [], list(base))]
    rows += [(f"{family}__{f}", "single", [family], [f], _checked([f, *base])) for family, fs in groups.items() for f in fs]
    return spark.createDataFrame(rows, SPEC_SCHEMA)


def combination_specs(spark, base: list[str], groups: dict[str, list[str]], *, min_candidates: int = 2, max_candidates: int = 3) -> DataFrame:
    """Specs with one feature from each of ``min_candidates`` to ``max_candidates`` families, in the order of the families."""
    if min_candidates < 2:
        raise ValueError("min_candidates must be at least 2")
    if max_candidates < min_candidates:
        raise ValueError("max_candidates must not be below min_candidates")
    for family, fs in groups.items():
        if len(set(fs)) != len(fs):
            raise ValueError(f"duplicate candidates in {family}")
    features = [f for fs in groups.values() for f in fs]
    if len(set(features)) != len(features):
        raise ValueError("a candidate is in more than one family")
    if set(features) & set(base):
        raise ValueError("candidates overlap controls")
    rows = []
    for size in range(min_candidates, max_candidates + 1):
        for families in combinations(groups, size):
            for picked in product(*(groups[f] for f in families)):
                rows.append(("__".join(picked), "combination", list(families), list(picked), _checked([*picked, *base])))
    return spark.createDataFrame(rows, SPEC_SCHEMA)


def extension_specs(spark, base: list[str], extensions: dict[str, list[str]]) -> DataFrame:
    """The baseline and hand-made extensions of it, each compared with the baseline."""
    rows = [("baseline", list(base), None)] + [(name, _checked([*base, *extra]), "baseline") for name, extra in extensions.items()]
    return spark.createDataFrame(rows, "spec_id string, columns array<string>, comparison string")


def screen_specs(long: DataFrame, specs: dict[str, list[str]], **options) -> tuple[DataFrame, DataFrame]:
    """(summary, coefficients) of all specs, fitted together: one job an iteration, whatever their number.

    Adds delta_aic and rank by AIC. Each fit's result is a few numbers.
    """
    spark = long.sparkSession
    fits = fit_specs(long, specs, **options)
    names = ["n_obs", "k", "log_likelihood", "null_log_likelihood", "aic", "bic", "rho_squared", "converged"]
    rows = [(name, *[f.statistics[n] for n in names]) for name, f in fits.items()]
    summary = spark.createDataFrame(rows, "spec_id string, n_obs long, k long, log_likelihood double, null_log_likelihood double, aic double, bic double, rho_squared double, converged boolean")
    coefficients = spark.createDataFrame([(name, *p) for name, f in fits.items() for p in f.parameters()], "spec_id string, feature string, coefficient double, std_error double, t double, p double")
    return compare_models(summary), coefficients


def compare_models(summary: DataFrame, baseline: str | None = "baseline") -> DataFrame:
    """summary with delta_aic (from the best), rank by AIC then spec_id, and delta_baseline. A row per spec."""
    every = Window.partitionBy()
    out = summary.withColumns({"delta_aic": F.col("aic") - F.min("aic").over(every), "rank": F.row_number().over(Window.orderBy("aic", "spec_id"))})
    if baseline is not None:
        out = out.withColumn("delta_baseline", F.col("aic") - F.max(F.when(F.col("spec_id") == baseline, F.col("aic"))).over(every))
    return out


def finalists(compared: DataFrame, *, top: int = 3, baseline: str = "baseline") -> DataFrame:
    """The baseline and the ``top`` other specs by AIC, with their role."""
    others = compared.where(F.col("spec_id") != baseline).orderBy("aic", "spec_id").limit(top).withColumn("role", F.lit("finalist"))
    return compared.where(F.col("spec_id") == baseline).withColumn("role", F.lit("baseline")).unionByName(others)


def continuation_flags(candidates: DataFrame, baseline: DataFrame) -> DataFrame:
    """candidates (spec_id, comparison, aic, coefficient, p) with aic_gain over their comparison, and whether to go on: gain of 2 or more, positive, p below 0.10."""
    joined = candidates.join(baseline.select(F.col("spec_id").alias("comparison"), F.col("aic").alias("__aic")), "comparison", "left").withColumn("aic_gain", F.col("__aic") - F.col("aic"))
    flags = {"gains": F.col("aic_gain") >= 2, "positive": F.col("coefficient") > 0, "significant": F.col("p") < 0.10}
    out = joined.withColumns(flags).drop("__aic")
    return out.withColumn("continue", F.coalesce(F.col("gains") & F.col("positive") & F.col("significant"), F.lit(False)))


def cross_moments(df: DataFrame, features: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, covariances) of rows without a null in the features, from one aggregation; only k x k numbers come to the driver."""
    rows = df.select(*[F.col(f).cast("double").alias(f) for f in features]).dropna()
    pairs = [(i, j) for i in range(len(features)) for j in range(i + 1)]
    row = rows.agg(F.count("*").alias("n"), *[F.avg(f).alias(f"m_{i}") for i, f in enumerate(features)], *[F.covar_pop(features[i], features[j]).alias(f"c_{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((len(features),) * 2)
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c_{i}_{j}"] if row[f"c_{i}_{j}"] is not None else np.nan
    return row["n"], np.array([row[f"m_{i}"] for i in range(len(features))], float), cov


def correlations(df: DataFrame, features: list[str]) -> DataFrame:
    """(a, b, correlation) of all pairs, from one aggregation; null where a feature is constant."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[: i + 1]]
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{k}") for k, (a, b) in enumerate(pairs)])
    items = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(str(k)).alias("correlation")) for k, (a, b) in enumerate(pairs)])
    half = row.select(F.explode(items).alias("r")).select("r.*")
    return half.union(half.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "correlation"))


def vif(cov: np.ndarray, features: list[str]) -> list[tuple[str, float, float]]:
    """(feature, vif, r_squared): how well the others explain each feature; largest first. A single feature has 1, a constant one R2 0, an exact combination infinity."""
    out = []
    for i, name in enumerate(features):
        others = [j for j in range(len(features)) if j != i]
        if not others or cov[i, i] <= 0:
            r2 = 0.0
        else:
            beta = np.linalg.pinv(cov[np.ix_(others, others)]) @ cov[others, i]
            r2 = float(np.clip(beta @ cov[others, i] / cov[i, i], 0, 1))
        out.append((name, float("inf") if r2 >= 1 - 1e-12 else 1 / (1 - r2), r2))
    return sorted(out, key=lambda r: (-r[1], r[0]))


def feature_diagnostics(df: DataFrame, features: list[str]) -> tuple[DataFrame, float]:
    """(feature, vif, r_squared rounded to 3), and the largest absolute correlation of two features."""
    _, _, cov = cross_moments(df, features)
    rows = vif(cov, features)
    sd = np.sqrt(np.diag(cov))
    with np.errstate(invalid="ignore", divide="ignore"):
        corr = np.abs(cov / np.outer(sd, sd)) - np.eye(len(features)) * 2
    top = float(np.nanmax(corr)) if len(features) > 1 else 0.0
    return df.sparkSession.createDataFrame([(n, round(v, 3), round(r, 3)) for n, v, r in rows], "feature string, vif double, r_squared double"), round(top, 3)


def filter_redundant(df: DataFrame, priority: list[str], *, max_correlation: float = 0.95, max_vif: float = 20.0) -> list[tuple[str, str]]:
    """(feature, verdict) for features in order of priority: 'invalid' (constant or empty), 'correlated' with a kept one, 'collinear' by VIF (worst priority first among ties), or 'kept'.

    The data are read once; the rest works on the k x k moments.
    """
    n, _, cov = cross_moments(df, priority)
    verdict = {f: "kept" for f in priority}
    at = {f: i for i, f in enumerate(priority)}
    for f in priority:
        if n == 0 or not np.isfinite(cov[at[f], at[f]]) or cov[at[f], at[f]] <= 0:
            verdict[f] = "invalid"
    kept: list[str] = []
    for f in priority:
        if verdict[f] != "kept":
            continue
        r = [abs(cov[at[f], at[g]]) / np.sqrt(cov[at[f], at[f]] * cov[at[g], at[g]]) for g in kept]
        if any(x >= max_correlation for x in r):
            verdict[f] = "correlated"
        else:
            kept.append(f)
    while len(kept) > 1:
        index = [at[f] for f in kept]
        rows = vif(cov[np.ix_(index, index)], kept)
        worst = rows[0][1]
        if worst <= max_vif:
            break
        gone = max((f for f, v, _ in rows if v == worst), key=lambda f: (at[f], f))
        verdict[gone] = "collinear"
        kept.remove(gone)
    return [(f, verdict[f]) for f in priority]


def weighted_built_area(sales: DataFrame, built: DataFrame) -> DataFrame:
    """(alt_id, log_built_area_ha): the log area of each year weighted by the share of sales in that year."""
    years = sales.groupBy(F.year("purchase_date").alias("year")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("alt_id"))
    joined = built.join(years, "year").withColumn("w", F.col("n") / total)
    return joined.groupBy("alt_id").agg(F.sum(F.col("w") * F.log1p(F.col("area") / 10_000)).alias("log_built_area_ha"))
