"""Multinomial logit by distributed Newton steps.

The long choice frame stays in Spark. Each step is one aggregation: per sale
the shifted softmax sums over its alternatives, then over all sales the
log-likelihood, its gradient (k numbers) and its information matrix (k x k).
Only these come to the driver, where the step is solved.

Sales that choose the same from the same are alike to the likelihood. A frame
may hold one of them with a column that says how many they are (``weight``);
it counts as so many sales in every sum.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class MnlFit:
    features: list[str]
    beta: np.ndarray
    log_likelihood: float
    null_log_likelihood: float
    n_obs: int
    converged: bool
    gradient: np.ndarray
    information: np.ndarray
    scores: np.ndarray | None = None  # sum over sales of score x score^T
    log_likelihood_start: float = 0.0
    steps: int = 0
    extra: dict = field(default_factory=dict)

    @property
    def statistics(self) -> dict[str, float]:
        """Fit statistics: information criteria, McFadden's and the adjusted rho-squared, gains and likelihood ratios."""
        k, ll, null = len(self.features), self.log_likelihood, self.null_log_likelihood
        return {
            "n_obs": self.n_obs, "k": k, "log_likelihood": ll, "null_log_likelihood": null, "aic": 2 * k - 2 * ll, "bic": math.log(max(self.n_obs, 1)) * k - 2 * ll,
            "rho_squared": 1 - ll / null if null else float("nan"), "rho_bar_squared": 1 - (ll - k) / null if null else float("nan"),
            "ll_gain": ll - null, "lr_null": 2 * (ll - null), "lr_start": 2 * (ll - self.log_likelihood_start), "converged": self.converged,
        }

    def covariance(self, robust: bool = True) -> np.ndarray:
        inverse = np.linalg.pinv(self.information)
        return inverse @ self.scores @ inverse if robust and self.scores is not None else inverse

    def parameters(self) -> list[tuple[str, float, float, float, float]]:
        """(feature, value, robust standard error, t, two-sided p) of each parameter."""
        errors = np.sqrt(np.maximum(np.diag(self.covariance()), 0))
        out = []
        for name, b, e in zip(self.features, self.beta, errors, strict=True):
            b, e = float(b), float(e)
            t = b / e if e > 0 else float("nan")
            out.append((name, b, e, t, math.erfc(abs(t) / math.sqrt(2)) if e > 0 else float("nan")))
        return out


def _utility(features: list[str], beta: np.ndarray) -> Column:
    out = F.lit(0.0)
    for name, b in zip(features, beta, strict=True):
        out = out + F.col(name).cast("double") * F.lit(float(b))
    return out


def _weight(weight: str | None) -> Column:
    return (F.col(weight) if weight else F.lit(1)).cast("long").alias("__w")


def per_obs(long: DataFrame, features: list[str], beta: np.ndarray) -> DataFrame:
    """A row per sale: ll, its score s_<i>, and the covariance of the features under the model h_<i>_<j>. Only available rows count."""
    rows = long.where("available").select("obs_id", "chosen", *features).withColumn("__v", _utility(features, beta))
    return _sums(rows, features, ["obs_id"])


def _sums(rows: DataFrame, features: list[str], by: list[str]) -> DataFrame:
    """What :func:`per_obs` returns, for each group of rows with utilities __v."""
    # One shuffle by sale; the largest utility of a sale keeps the exponentials in range.
    top = F.max("__v").over(Window.partitionBy(*by))
    rows = rows.withColumn("__e", F.exp(F.col("__v") - top)).withColumn("__d", F.col("__v") - top)
    pick = lambda c: F.sum(F.when(F.col("chosen"), c))
    sums = [F.sum("__e").alias("s"), pick(F.col("__d")).alias("chosen_v"), F.count("*").alias("n_available")]
    k = range(len(features))
    sums += [F.sum(F.col("__e") * F.col(features[i])).alias(f"x_{i}") for i in k] + [pick(F.col(features[i]).cast("double")).alias(f"c_{i}") for i in k]
    sums += [F.sum(F.col("__e") * F.col(features[i]) * F.col(features[j])).alias(f"xx_{i}_{j}") for i in k for j in range(i + 1)]
    o = rows.groupBy(*by).agg(*sums)
    return o.select(
        *by, "n_available", (F.col("chosen_v") - F.log("s")).alias("ll"), *[(F.col(f"c_{i}") - F.col(f"x_{i}") / F.col("s")).alias(f"s_{i}") for i in k],
        *[(F.col(f"xx_{i}_{j}") / F.col("s") - F.col(f"x_{i}") / F.col("s") * F.col(f"x_{j}") / F.col("s")).alias(f"h_{i}_{j}") for i in k for j in range(i + 1)],
    )


def _totals(k: int) -> list[Column]:
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    w = F.col("__w")
    return [
        F.sum(w).alias("n"), F.sum(w * F.col("ll")).alias("ll"), F.sum(w * -F.log(F.col("n_available").cast("double"))).alias("null_ll"), *[F.sum(w * F.col(f"s_{i}")).alias(f"g_{i}") for i in range(k)],
        *[F.sum(w * F.col(f"h_{i}_{j}")).alias(f"h_{i}_{j}") for i, j in pairs], *[F.sum(w * F.col(f"s_{i}") * F.col(f"s_{j}")).alias(f"b_{i}_{j}") for i, j in pairs],
    ]


def _moments(row: dict, k: int) -> dict:
    info, outer = np.zeros((k, k)), np.zeros((k, k))
    for i in range(k):
        for j in range(i + 1):
            info[i, j] = info[j, i] = row[f"h_{i}_{j}"] or 0.0
            outer[i, j] = outer[j, i] = row[f"b_{i}_{j}"] or 0.0
    return {"n": row["n"] or 0, "ll": row["ll"] or 0.0, "null_ll": row["null_ll"] or 0.0, "gradient": np.array([row[f"g_{i}"] or 0.0 for i in range(k)]), "information": info, "outer": outer}


def moments(long: DataFrame, features: list[str], beta: np.ndarray, weight: str | None = None) -> dict:
    """Log-likelihood, gradient, information and summed outer products of the scores at beta, from one job."""
    k = len(features)
    rows = long.where("available").select("obs_id", "chosen", *features, _weight(weight)).withColumn("__v", _utility(features, beta))
    return _moments(_sums(rows, features, ["obs_id", "__w"]).agg(*_totals(k)).first().asDict(), k)


def moments_at(long: DataFrame, features: list[str], betas: list[np.ndarray], weight: str | None = None) -> list[dict]:
    """The moments at each of several betas, from one job: every row is taken at all of them."""
    k = len(features)
    utilities = F.posexplode(F.array(*[_utility(features, b) for b in betas])).alias("point", "__v")
    rows = long.where("available").select("obs_id", "chosen", *features, _weight(weight), utilities)
    found = {r["point"]: _moments(r.asDict(), k) for r in _sums(rows, features, ["obs_id", "__w", "point"]).groupBy("point").agg(*_totals(k)).collect()}
    none = {"n": 0, "ll": 0.0, "null_ll": 0.0, "gradient": np.zeros(k), "information": np.zeros((k, k)), "outer": np.zeros((k, k))}
    return [found.get(i, none) for i in range(len(betas))]


def fit_mnl(long: DataFrame, features: list[str], *, max_steps: int = 25, tolerance: float = 1e-8, start: np.ndarray | None = None, weight: str | None = None) -> MnlFit:
    """Maximise the likelihood from zero by Newton steps, halved while they don't improve it; a singular information matrix ends it as not converged."""
    if len(set(features)) != len(features):
        raise ValueError("duplicate features")
    missing = [c for c in ("obs_id", "alt_id", "chosen", "available", *features, *([weight] if weight else [])) if c not in long.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    long = long.select("obs_id", "chosen", "available", *features, *([weight] if weight else [])).repartition("obs_id").cache()
    try:
        beta = np.zeros(len(features)) if start is None else np.asarray(start, float)
        at = moments(long, features, beta, weight)
        first, converged, steps = at["ll"], False, 0
        while steps < max_steps:
            steps += 1
            singular = np.linalg.matrix_rank(at["information"]) < len(features)
            move = np.linalg.pinv(at["information"]) @ at["gradient"]
            if abs(float(move @ at["gradient"])) < tolerance:
                converged = not singular
                break
            for _ in range(12):
                new = moments(long, features, beta + move, weight)
                if new["ll"] >= at["ll"] - 1e-12 * abs(at["ll"]):
                    beta, at = beta + move, new
                    break
                move = move / 2
            else:  # no step of this direction is better: the fit stays where it is, not converged
                break
        return MnlFit(list(features), beta, at["ll"], at["null_ll"], at["n"], converged, at["gradient"], at["information"], at["outer"], first, steps)
    finally:
        long.unpersist()


def fit_specs(long: DataFrame, specs: dict[str, list[str]], *, max_steps: int = 25, tolerance: float = 1e-8, weight: str | None = None) -> dict[str, MnlFit]:
    """The fit of every spec (name -> features), as :func:`fit_mnl` gives it, with one job for all of them an iteration.

    A row is taken once for each spec that isn't done, with that spec's
    features and utility; what is done drops out. So the number of jobs is
    that of the slowest spec, whatever the number of specs, and the data are
    shuffled by sale once.
    """
    every = list(dict.fromkeys(f for fs in specs.values() for f in fs))
    missing = [c for c in ("obs_id", "alt_id", "chosen", "available", *every, *([weight] if weight else [])) if c not in long.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if any(len(set(fs)) != len(fs) for fs in specs.values()):
        raise ValueError("duplicate features")
    width = max(map(len, specs.values()), default=0)
    names = [f"f_{i}" for i in range(width)]
    long = long.where("available").select("obs_id", "chosen", *every, _weight(weight)).repartition("obs_id").cache()

    def at_all(betas: dict[str, np.ndarray]) -> dict[str, dict]:
        point = lambda name, b: F.struct(F.lit(name).alias("spec"), _utility(specs[name], b).alias("__v"), *[(F.col(specs[name][i]).cast("double") if i < len(specs[name]) else F.lit(0.0)).alias(names[i]) for i in range(width)])
        rows = long.select("obs_id", "chosen", "__w", F.explode(F.array(*[point(n, b) for n, b in betas.items()])).alias("p")).select("obs_id", "chosen", "__w", "p.*")
        found = {r["spec"]: _moments(r.asDict(), width) for r in _sums(rows, names, ["obs_id", "__w", "spec"]).groupBy("spec").agg(*_totals(width)).collect()}
        none = {"n": 0, "ll": 0.0, "null_ll": 0.0, "gradient": np.zeros(width), "information": np.zeros((width, width)), "outer": np.zeros((width, width))}
        out = {}
        for n in betas:
            k, m = len(specs[n]), found.get(n, none)
            out[n] = m | {"gradient": m["gradient"][:k], "information": m["information"][:k, :k], "outer": m["outer"][:k, :k]}
        return out

    try:
        fits, moves, halved = {}, {}, {}
        for name, at in at_all({n: np.zeros(len(fs)) for n, fs in specs.items()}).items() if specs else ():
            fits[name] = MnlFit(list(specs[name]), np.zeros(len(specs[name])), at["ll"], at["null_ll"], at["n"], False, at["gradient"], at["information"], at["outer"], at["ll"])

        def turn(name: str) -> None:
            """The next move of a spec, unless it is done."""
            fit = fits[name]
            moves.pop(name, None)
            if fit.steps < max_steps:
                fit.steps += 1
                move = np.linalg.pinv(fit.information) @ fit.gradient
                if abs(float(move @ fit.gradient)) < tolerance:
                    fit.converged = bool(np.linalg.matrix_rank(fit.information) == len(fit.features))
                else:
                    moves[name], halved[name] = move, 0

        for name in fits:
            turn(name)
        while moves:
            for name, new in at_all({n: fits[n].beta + m for n, m in moves.items()}).items():
                fit = fits[name]
                if new["ll"] >= fit.log_likelihood - 1e-12 * abs(fit.log_likelihood):
                    fit.beta, fit.log_likelihood, fit.gradient, fit.information, fit.scores = fit.beta + moves[name], new["ll"], new["gradient"], new["information"], new["outer"]
                    turn(name)
                elif halved[name] == 11:  # no step of this direction is better: the fit stays where it is, not converged
                    moves.pop(name)
                else:
                    moves[name], halved[name] = moves[name] / 2, halved[name] + 1
        return fits
    finally:
        long.unpersist()


def check_derivatives(long: DataFrame, fit: MnlFit, step: float = 1e-4, at: np.ndarray | None = None, weight: str | None = None) -> dict[str, float]:
    """Largest differences between the analytic gradient and information and central differences, from one job however many parameters.

    They are taken at ``at``, by default at the fit. The relative ones are
    parts of the largest entry, of 1 at least.
    """
    beta = fit.beta if at is None else np.asarray(at, float)
    k = len(fit.features)
    moves = np.eye(k) * step
    here, *moved = moments_at(long, fit.features, [beta, *(beta + m for m in moves), *(beta - m for m in moves)], weight)
    up, down = moved[:k], moved[k:]
    gradient = np.array([(u["ll"] - d["ll"]) / (2 * step) for u, d in zip(up, down, strict=True)])
    hessian = np.array([-(u["gradient"] - d["gradient"]) / (2 * step) for u, d in zip(up, down, strict=True)])
    off = lambda a, b: float(np.abs(a - b).max())
    size = lambda a: max(1.0, float(np.abs(a).max()))
    g, h = off(gradient, here["gradient"]), off(hessian, here["information"])
    return {"gradient_error": g, "hessian_error": h, "gradient_relative": g / size(here["gradient"]), "hessian_relative": h / size(here["information"])}


def choice_probabilities(long: DataFrame, features: list[str], beta: np.ndarray) -> DataFrame:
    """Available rows with the probability of each under beta."""
    rows = long.where("available").withColumn("__v", _utility(features, beta))
    by = Window.partitionBy("obs_id")
    rows = rows.withColumn("__e", F.exp(F.col("__v") - F.max("__v").over(by)))
    return rows.withColumn("probability", F.col("__e") / F.sum("__e").over(by)).drop("__v", "__e")


def choice_shares(long: DataFrame, features: list[str], beta: np.ndarray, alternatives: DataFrame, weight: str | None = None) -> DataFrame:
    """(alt_id, predicted, observed, error, abs_error) for each alternative: mean probability over all sales beside the share of sales."""
    p = choice_probabilities(long.withColumn("__w", _weight(weight)), features, beta)
    n = p.select("obs_id", "__w").distinct().agg(F.sum("__w").alias("n"))
    by_alt = p.groupBy("alt_id").agg(F.sum(F.col("probability") * F.col("__w")).alias("p"), F.sum(F.when(F.col("chosen"), F.col("__w"))).alias("c"))
    joined = alternatives.select("alt_id").join(by_alt, "alt_id", "left").join(F.broadcast(n))
    rows = joined.select("alt_id", (F.coalesce("p", F.lit(0.0)) / F.col("n")).alias("predicted"), (F.coalesce("c", F.lit(0)) / F.col("n")).alias("observed"))
    return rows.withColumn("error", F.col("predicted") - F.col("observed")).withColumn("abs_error", F.abs("error"))


def share_fit(shares: DataFrame, by: list[str] = ()) -> DataFrame:
    """Mean absolute, root mean square and largest error, and the sums of both shares, for each spec."""
    return shares.groupBy(*by).agg(F.avg("abs_error").alias("mae"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"), F.max("abs_error").alias("max_error"), F.sum("predicted").alias("predicted_sum"), F.sum("observed").alias("observed_sum"))


def residual_change(shares: DataFrame, baseline: DataFrame) -> DataFrame:
    """(alt_id, change): how much a model's absolute share error differs from the baseline's; sort by it for the largest changes."""
    return shares.select("alt_id", "abs_error").join(baseline.select("alt_id", F.col("abs_error").alias("__b")), "alt_id").select("alt_id", (F.col("abs_error") - F.col("__b")).alias("change"))
