"""The structural baseline, assembled from raw features and sales, and further model queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import choice, features, geometry, mnl, specs
from .analytics import ACTIVE_SQL, FRAME_SQL, KEPT_SQL, weighted_frame
from .registry import ALTERNATIVES_SQL, R4, SALES_SQL, alternatives, query, r4, sales, table
from .spatial import raw_features

FEATURES = ["balance", "suppliers", "log_active_sales"]


@dataclass
class BaselineInputs:
    catalog: DataFrame
    features: DataFrame
    sales: DataFrame
    choice_set: choice.ActiveChoiceSet
    long: DataFrame
    summary: DataFrame


def baseline_inputs(raw: DataFrame, points: DataFrame, all_sales: DataFrame, *, min_year: int, max_year: int, window_days: int = 365, min_available: int = 2) -> BaselineInputs:
    """From raw neighbourhood columns, their points (alt_id, x, y) and sales to the long choice frame with log1p of the active sales."""
    catalog = features.feature_catalog(raw)
    prepared = geometry.centroid_controls(features.prepare_features(raw, catalog).join(points.select("alt_id", "x", "y"), "alt_id"))
    kept, _ = choice.prepare_transactions(all_sales, raw, min_year=min_year, max_year=max_year)
    found = choice.active_choice_set(kept, window_days=window_days, min_available=min_available, sparse=True)
    long = found.long.withColumn("log_active_sales", F.log1p("active_sales"))
    return BaselineInputs(catalog, prepared, kept, found, long, choice.availability_summary(found, min_available=min_available))


_KEPT_ACTIVE = ACTIVE_SQL.format(w=5).replace(SALES_SQL, KEPT_SQL)


@query("m28_baseline_assembly", f"SELECT count(*) AS n_obs, count(*) FILTER (n >= 2) AS n_kept, count(*) FILTER (n < 2) AS n_dropped, {R4('count(*) FILTER (n < 2) / count(*)')} AS drop_share, min(n) FILTER (n >= 2) AS min_alternatives, median(n) FILTER (n >= 2) AS median_alternatives, max(n) FILTER (n >= 2) AS max_alternatives FROM (SELECT obs_id, count(*) FILTER (active_sales > 0 OR chosen) AS n FROM {_KEPT_ACTIVE} GROUP BY 1)")
def m28(spark, d):
    inputs = baseline_inputs(raw_features(spark, d), alternatives(spark, d), sales(spark, d), min_year=1996, max_year=1999, window_days=5)
    return inputs.summary.withColumn("drop_share", r4(F.col("drop_share")))


@query("m27_masked_scale_audit", f"SELECT 'log_active_sales' AS feature, count(*) FILTER (f2 IS NULL) AS missing, count(DISTINCT f2) AS n_unique, {R4('min(f2)')} AS min, {R4('quantile_cont(f2, 0.25)')} AS p25, {R4('quantile_cont(f2, 0.5)')} AS median, {R4('quantile_cont(f2, 0.75)')} AS p75, {R4('max(f2)')} AS max, CASE WHEN quantile_cont(abs(f2), 0.75) > 10 THEN 'too large' WHEN quantile_cont(abs(f2), 0.5) FILTER (f2 <> 0) < 1 THEN 'too small' ELSE 'ok' END AS scale_warning FROM {FRAME_SQL}")
def m27(spark, d):
    return features.scale_audit(weighted_frame(spark, d).where("available"), ["log_active_sales"], weight="weight")


@query("m29_older_frame", f"SELECT s.obs_id, a.alt_id, a.balance, s.alt_id = a.alt_id AS chosen FROM {SALES_SQL} s, {ALTERNATIVES_SQL} a WHERE s.alt_id IN (SELECT alt_id FROM {SALES_SQL} GROUP BY alt_id HAVING count(*) >= 10) AND a.alt_id IN (SELECT alt_id FROM {SALES_SQL} GROUP BY alt_id HAVING count(*) >= 10)")
def m29(spark, d):
    counts = sales(spark, d).groupBy("alt_id").agg(F.count("*").alias("n")).where("n >= 10")
    kept = sales(spark, d).join(counts, "alt_id", "left_semi")
    frame = choice.choice_frame(kept, alternatives(spark, d).join(counts, "alt_id", "left_semi"), ["balance"])
    return frame.select("obs_id", "alt_id", "balance", "chosen")


@query("m11_derivative_check")
def m11(spark, d):
    frame = weighted_frame(spark, d)
    # At a point beside the maximum, where no derivative is 0; errors as parts of the largest entry.
    fit = mnl.fit_mnl(frame, FEATURES, weight="weight")
    errors = mnl.check_derivatives(frame, fit, at=fit.beta * 0.9, weight="weight")
    return spark.createDataFrame([(k, v, bool(v < 1e-3)) for k, v in errors.items() if k.endswith("relative")], "check string, value double, passed boolean")


@query("m14_residual_change")
def m14(spark, d):
    import numpy as np

    frame, alts = weighted_frame(spark, d), alternatives(spark, d)
    base = mnl.choice_shares(frame, FEATURES, np.zeros(3), alts, "weight")
    other = mnl.choice_shares(frame, FEATURES, np.array([0.0, 0.0, 1.0]), alts, "weight")
    return mnl.residual_change(other, base).orderBy("change", "alt_id").limit(15)


@query("m19_finalists")
def m19(spark, d):
    named = {"baseline": ["log_active_sales"], "balance": ["balance", "log_active_sales"], "suppliers": ["suppliers", "log_active_sales"]}
    return specs.finalists(specs.screen_specs(weighted_frame(spark, d), named, weight="weight")[0], top=1)


@query("m21_continuation_flags")
def m21(spark, d):
    named = {"baseline": ["log_active_sales"], "balance": ["balance", "log_active_sales"], "suppliers": ["suppliers", "log_active_sales"]}
    summary, coefficients = specs.screen_specs(weighted_frame(spark, d), named, weight="weight")
    own = coefficients.where("feature = spec_id").select("spec_id", "coefficient", "p")
    candidates = summary.join(own, "spec_id").select("spec_id", F.lit("baseline").alias("comparison"), "aic", "coefficient", "p")
    return specs.continuation_flags(candidates, summary)


@query("m25_spec_diagnostics")
def m25(spark, d):
    import numpy as np

    named = {"two": ["p_size", "p_retailprice"], "three": ["p_size", "p_retailprice", "p_partkey"]}
    every = list(dict.fromkeys(f for fs in named.values() for f in fs))
    _, _, cov = specs.cross_moments(table(spark, d, "part"), every)  # once for all specs
    rows = []
    for name, fs in named.items():
        at = [every.index(f) for f in fs]
        part = cov[np.ix_(at, at)]
        sd = np.sqrt(np.diag(part))
        corr = np.abs(part / np.outer(sd, sd)) - 2 * np.eye(len(fs))
        rows.append((name, round(float(corr.max()), 3), round(specs.vif(part, fs)[0][1], 3)))
    return spark.createDataFrame(rows, "spec_id string, max_correlation double, max_vif double")
