"""Fitting and reading a mixed model from its cross-products.

``fit`` is one estimator at every size: restricted maximum likelihood by ``reml``, whose
work per random level is Spark's, with Satterthwaite degrees of freedom. Members and groups (the random
intercepts) may be many. ``method`` "moments" takes the variances from quadratic
forms of the least-squares residuals instead; its tests use the normal distribution.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from dyadspark.operators import mixed, reml
from dyadspark.operators.mixed import GROUP, MEMBER, Model
from dyadspark.session import materialise, release


@dataclass
class Fit:
    model: Model
    beta: np.ndarray
    cov: np.ndarray
    variances: dict[str, float]
    n: int
    levels: int
    xx: np.ndarray
    method: str
    df_of: Callable[[np.ndarray], float] | None = None
    p_method: str = "normal"

    @property
    def means(self) -> np.ndarray:
        return self.xx[0] / self.xx[0, 0]


def _fixed_matrix(rows: DataFrame, model: Model) -> np.ndarray:
    """Symmetric cross-products of fixed columns and response: (p + 1) squared numbers."""
    labels = model.terms + [model.response]
    at = {name: i for i, name in enumerate(labels)}
    out = np.zeros((len(labels), len(labels)))
    for r in mixed.fixed_gram(rows, model).collect():
        i, j = at[r["i"]], at[r["j"]]
        out[i, j] = out[j, i] = float(r["value"] or 0.0)
    return out


def _independent(gram: np.ndarray) -> list[int]:
    """Columns that do not depend on the ones before them, by steps of a Cholesky factorisation of the scaled products."""
    scale = np.sqrt(np.diag(gram))
    scaled = gram / np.outer(np.where(scale > 0, scale, 1.0), np.where(scale > 0, scale, 1.0))
    kept: list[int] = []
    for i in range(len(gram)):
        own = scaled[i, i]
        if kept:
            cross = scaled[np.ix_(kept, [i])][:, 0]
            own -= cross @ np.linalg.solve(scaled[np.ix_(kept, kept)], cross)
        if own > 1e-10:
            kept.append(i)
    return kept


def _spread(kept: list[int], p: int, beta: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimates in their places among all p terms; a term that depends on earlier ones has none (NaN)."""
    whole, square = np.full(p, np.nan), np.full((p, p), np.nan)
    whole[kept] = beta
    square[np.ix_(kept, kept)] = cov
    return whole, square


def least_squares(rows: DataFrame, model: Model) -> Fit:
    g = _fixed_matrix(rows, model)
    p = len(model.terms)
    whole, yy, n = g[:p, :p], g[p, p], int(round(g[0, 0]))
    kept = _independent(whole)
    xx, xy, rest = whole[np.ix_(kept, kept)], g[kept, p], n - len(kept)
    beta = np.linalg.solve(xx, xy)
    sigma2 = max(yy - beta @ xy, 0.0) / rest
    beta, cov = _spread(kept, p, beta, sigma2 * np.linalg.inv(xx))
    return Fit(model, beta, cov, {"residual": sigma2}, n, 0, whole, "least squares", lambda c: rest, "residual")


def fit(df: DataFrame, model: Model, method: str = "reml") -> Fit:
    """Fit the model to a pair table; the complete design rows are written once and read a few times."""
    rows = mixed.design(df, model)
    if not model.members and not model.group:
        return least_squares(rows, model)
    rows = materialise(rows)
    g = _fixed_matrix(rows, model)
    by_fixed = materialise(mixed.random_by_fixed(rows, model))
    edges = materialise(mixed.random_gram(rows))
    release(rows)
    fitted = {"reml": fit_reml, "moments": fit_levels}[method](model, g, by_fixed, edges)
    release(by_fixed, edges)
    return fitted


def fit_reml(model: Model, g: np.ndarray, by_fixed: DataFrame, edges: DataFrame) -> Fit:
    """The fit from cross-products by restricted maximum likelihood."""
    n, terms = int(round(g[0, 0])), len(model.terms)
    whole, kept = g[:terms, :terms], _independent(g[:terms, :terms])
    p, main = len(kept), MEMBER if model.members else GROUP
    products = g[np.ix_([*kept, terms], [*kept, terms])]
    names = [f"x{k}" for k in kept] + ["y"]
    levels = materialise(by_fixed.select(
        F.concat_ws(":", "factor", "level").alias("node"), (F.col("factor") != main).alias("grouped"), "n", F.array(*names).alias("b")))
    met = edges.select(
        F.concat_ws(":", "factor", "level").alias("node"), F.concat_ws(":", "factor_b", "level_b").alias("node_b"), "w", "factor", "factor_b")
    # each row has one group: levels that are linked at all are linked through groups
    links = met.where(F.col("factor") != F.col("factor_b")) if model.members and model.group else met
    labels = reml.component_labels(levels.select("node"), links.select(F.col("node").alias("a"), F.col("node_b").alias("b")))
    met = met.drop("factor", "factor_b")
    components, rest = reml.whole_components(levels, met, labels)
    large = None
    if not rest.isEmpty():
        others = rest.select(F.col("node").alias("node_b"))  # no meeting leads from a component to another
        large = reml.Large(levels.join(rest, "node", "left_semi"), met.join(others, "node_b", "left_semi"), p + 1)
    criterion = reml.Criterion(products, p, n, components, large, (True, main == MEMBER and model.group is not None))
    theta = reml.estimate(criterion)
    beta = criterion.pieces(theta[0] / theta[2], theta[1] / theta[2])[0]
    df_kept = reml.satterthwaite(criterion, theta)
    beta, cov = _spread(kept, terms, beta, criterion.covariance(theta))
    variances = {main: float(theta[0])} | ({GROUP: float(theta[1])} if criterion.active[1] else {}) | {"residual": float(theta[2])}
    count = levels.count()
    release(levels, labels, components, rest)
    if large is not None:
        large.release()
    return Fit(
        model, beta, cov, variances, n, count, whole, "reml", lambda c: df_kept(np.asarray(c)[kept]), "satterthwaite")


def fit_levels(model, g, by_fixed, edges, variances: dict[str, float] | None = None) -> Fit:
    """The fit from cross-products; ``variances`` are estimated from residual moments unless they are given."""
    n, terms = int(round(g[0, 0])), len(model.terms)
    whole, kept = g[:terms, :terms], _independent(g[:terms, :terms])
    by_fixed = by_fixed.select(
        "factor", "level", "n", *[F.col(f"x{k}").alias(f"x{i}") for i, k in enumerate(kept)], "y")
    p = len(kept)
    xx, xy, yy = whole[np.ix_(kept, kept)], g[kept, terms], g[terms, terms]
    if variances is None:
        variances = mixed.moment_variances(by_fixed, edges, xx, xy, yy, n)
    sigma2 = variances["residual"]
    ridge = {f: sigma2 / v for f, v in variances.items() if f != "residual" and v > 1e-9 * sigma2}
    taken = np.zeros((p + 1, p + 1))
    if ridge:
        names = [f"x{i}" for i in range(p)] + ["y"]
        solved = mixed.solve_levels(by_fixed, edges, names, ridge)
        taken = mixed.absorbed_products(by_fixed, solved, names)
    xvx, xvy = xx - taken[:p, :p], xy - taken[:p, p]
    beta, cov = _spread(kept, terms, np.linalg.solve(xvx, xvy), sigma2 * np.linalg.inv(xvx))
    return Fit(model, beta, cov, variances, n, by_fixed.count(), whole, "moments")


# ---------------------------------------------------------------------------
# Reading a fit: a few numbers per term


class Tails:
    """Tail probabilities from the commons-math classes Spark ships with."""

    def __init__(self, spark: SparkSession):
        self._d = spark._jvm.org.apache.commons.math3.distribution

    def t_two_sided(self, t: float, df: float) -> float:
        if not math.isfinite(df):
            return math.erfc(abs(t) / math.sqrt(2))
        return min(1.0, 2.0 * self._d.TDistribution(float(df)).cumulativeProbability(-abs(float(t))))

    def t_quantile(self, p: float, df: float) -> float:
        if not math.isfinite(df):
            return self._d.NormalDistribution().inverseCumulativeProbability(p)
        return self._d.TDistribution(float(df)).inverseCumulativeProbability(p)

    def chi2_upper(self, x: float, df: int) -> float:
        return 1.0 - self._d.ChiSquaredDistribution(float(df)).cumulativeProbability(float(x))


def _erf(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.erf)(x)


def studentised_range_upper(q: float, k: int, df: float) -> float:
    """P(range of k standard normals / independent scale > q), by numeric integration."""
    z = np.linspace(-8.0, 8.0, 801)
    phi = np.exp(-(z**2) / 2) / math.sqrt(2 * math.pi)
    big = 0.5 * (1 + _erf(z / math.sqrt(2)))

    def below(w):
        inner = (big - 0.5 * (1 + _erf((z - w) / math.sqrt(2)))).clip(0)
        return k * np.trapezoid(phi * inner ** (k - 1), z)

    if not math.isfinite(df) or df > 1e5:
        return float(min(1.0, max(0.0, 1 - below(q))))
    spread = 8.0 / math.sqrt(2 * df)
    s = np.linspace(max(1e-4, 1 - spread), 1 + spread + 8.0 / df, 201)
    logw = (df / 2) * math.log(df / 2) - math.lgamma(df / 2) + math.log(2) + (df - 1) * np.log(s) - df * s**2 / 2
    weight = np.exp(logw)
    total = np.trapezoid(weight, s)
    return float(min(1.0, max(0.0, 1 - np.trapezoid(weight * np.array([below(q * v) for v in s]), s) / total)))


def adjust_p(ps: Sequence[float], method: str) -> list[float]:
    m = len(ps)
    if method == "none":
        return list(ps)
    if method == "bonferroni":
        return [min(1.0, p * m) for p in ps]
    if method == "holm":
        out, top = [0.0] * m, 0.0
        for rank, i in enumerate(sorted(range(m), key=lambda i: ps[i])):
            top = max(top, min(1.0, (m - rank) * ps[i]))
            out[i] = top
        return out
    raise ValueError(f"unknown adjustment {method!r}")


def _frame(spark, rows, schema) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def _test(fit: Fit, tails: Tails, c: np.ndarray):
    est, se = float(c @ fit.beta), float(np.sqrt(c @ fit.cov @ c))
    df = float(fit.df_of(c)) if fit.df_of else float("inf")
    return est, se, df, est / se, tails.t_two_sided(est / se, df)


def coefficients(spark: SparkSession, fit: Fit) -> DataFrame:
    tails, eye = Tails(spark), np.eye(len(fit.beta))
    rows = [(t, *_test(fit, tails, eye[i]), fit.n, fit.method, fit.p_method) for i, t in enumerate(fit.model.terms)]
    return _frame(spark, rows, "term string, estimate double, std_error double, df double, statistic double, "
                               "p_value double, nobs bigint, method string, p_method string")


def variance_table(spark: SparkSession, fit: Fit) -> DataFrame:
    rows = [(k, float(v), float(math.sqrt(v)), fit.levels, fit.method) for k, v in fit.variances.items()]
    return _frame(spark, rows, "component string, variance double, sd double, levels int, method string")


def inflation_factors(spark: SparkSession, fit: Fit) -> DataFrame:
    """(Generalised) variance inflation per term from the correlation of the coefficients."""
    v = fit.cov[1:, 1:]
    s = np.sqrt(np.diag(v))
    r = v / np.outer(s, s)
    groups = {f: [i - 1 for i in fit.model.columns_of(f)] for f in fit.model.factors}
    groups |= {c: [fit.model.terms.index(c) - 1] for c in fit.model.numeric}
    rows = []
    for term, own in groups.items():
        other = [i for i in range(len(r)) if i not in own]
        gvif = np.linalg.det(r[np.ix_(own, own)]) * np.linalg.det(r[np.ix_(other, other)]) / np.linalg.det(r)
        rows.append((term, float(gvif), len(own), float(gvif ** (1 / (2 * len(own)))), fit.method))
    return _frame(spark, rows, "term string, vif double, df int, scaled_vif double, method string")


def _level_rows(fit: Fit, factor: str, others: str) -> dict[str, np.ndarray]:
    """Linear combination per level: covariates at their means, other factors averaged or at baseline."""
    model = fit.model
    base = np.zeros(len(model.terms))
    base[0] = 1.0
    for c in model.numeric:
        i = model.terms.index(c)
        base[i] = fit.means[i]
    if others == "average":
        for f, levels in model.factors.items():
            if f != factor:
                base[model.columns_of(f)] = 1.0 / len(levels)
    out = {}
    for k, level in enumerate(model.factors[factor]):
        row = base.copy()
        if k:
            row[model.columns_of(factor)[k - 1]] = 1.0
        out[level] = row
    return out


def marginal_means(spark: SparkSession, fit: Fit, factor: str, level: float = 0.95, others: str = "average") -> DataFrame:
    tails, rows = Tails(spark), []
    for name, c in _level_rows(fit, factor, others).items():
        est, se, df, _, _ = _test(fit, tails, c)
        half = tails.t_quantile(0.5 + level / 2, df) * se
        rows.append((name, est, se, df, est - half, est + half, fit.method))
    return _frame(spark, rows, "level string, mean double, std_error double, df double, lower double, "
                               "upper double, method string")


def predictions(spark: SparkSession, fit: Fit, factor: str, level: float = 0.95) -> DataFrame:
    """Adjusted prediction per level: covariates at their means, other factors at baseline, normal limits."""
    tails, rows = Tails(spark), []
    z = tails.t_quantile(0.5 + level / 2, float("inf"))
    for name, c in _level_rows(fit, factor, "baseline").items():
        est, se = float(c @ fit.beta), float(np.sqrt(c @ fit.cov @ c))
        rows.append((name, est, se, est - z * se, est + z * se, fit.method))
    return _frame(spark, rows, "level string, predicted double, std_error double, conf_low double, "
                               "conf_high double, method string")


def contrasts(spark: SparkSession, fit: Fit, factor: str, adjust: str = "tukey") -> DataFrame:
    """All pairwise differences of the marginal means; ``adjust``: tukey, holm, bonferroni or none."""
    tails, means = Tails(spark), _level_rows(fit, factor, "average")
    names = list(means)
    tests = [
        (f"{a} - {b}", *_test(fit, tails, means[a] - means[b]))
        for i, a in enumerate(names) for b in names[i + 1 :]
    ]
    if adjust == "tukey":
        ps = [studentised_range_upper(abs(t[4]) * math.sqrt(2), len(names), t[3]) for t in tests]
    else:
        ps = adjust_p([t[5] for t in tests], adjust)
    rows = [(*t[:5], float(p), adjust, fit.method) for t, p in zip(tests, ps)]
    return _frame(spark, rows, "contrast string, estimate double, std_error double, df double, statistic double, "
                               "p_value double, adjust string, method string")


def term_tests(spark: SparkSession, fit: Fit) -> DataFrame:
    """Wald chi-square of each term given all others."""
    tails, rows = Tails(spark), []
    groups = {mixed.INTERCEPT: [0]} | {f: fit.model.columns_of(f) for f in fit.model.factors}
    groups |= {c: [fit.model.terms.index(c)] for c in fit.model.numeric}
    for term, own in groups.items():
        b = fit.beta[own]
        chi2 = float(b @ np.linalg.solve(fit.cov[np.ix_(own, own)], b))
        rows.append((term, chi2, len(own), tails.chi2_upper(chi2, len(own)), fit.method))
    return _frame(spark, rows, "term string, chi2 double, df int, p_value double, method string")
