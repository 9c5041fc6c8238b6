"""Cross-products for multi-membership mixed models, aggregated by Spark.

The model: response = fixed effects + effect of each of the two members + a
random intercept per group + error. Its data enter only through sums of
products. Those of the fixed part are one row; those of the random part have a
row per level and per pair of levels that occur together.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from dyadspark.session import materialise

INTERCEPT = "intercept"
MEMBER, GROUP = "member", "group"


@dataclass(frozen=True)
class Model:
    """What to fit. ``factors`` maps a column to its levels, the first being the baseline."""

    response: str
    numeric: Sequence[str] = ()
    factors: dict[str, Sequence[str]] = field(default_factory=dict)
    members: Sequence[str] = ()
    group: str | None = None

    @property
    def terms(self) -> list[str]:
        coded = [f"{c}={level}" for c, levels in self.factors.items() for level in list(levels)[1:]]
        return [INTERCEPT, *coded, *self.numeric]

    def columns_of(self, factor: str) -> list[int]:
        return [i for i, t in enumerate(self.terms) if t.startswith(f"{factor}=")]


def design(df: DataFrame, model: Model) -> DataFrame:
    """Complete rows as doubles ``x0..xk, y`` plus ``m0, m1, ..`` and ``g``.

    A value outside a factor's level list counts as missing.
    """
    xs = [F.lit(1.0)]
    for c, levels in model.factors.items():
        known = F.col(c).isin(list(levels))
        xs += [F.when(known, (F.col(c) == level).cast("double")) for level in list(levels)[1:]]
    xs += [F.col(c).cast("double") for c in model.numeric]
    out = [x.alias(f"x{i}") for i, x in enumerate(xs)]
    out.append(F.col(model.response).cast("double").alias("y"))
    out += [F.col(m).alias(f"m{i}") for i, m in enumerate(model.members)]
    if model.group:
        out.append(F.col(model.group).alias("g"))
    rows = df.select(*out)
    return rows.where(~F.exists(F.array(*[F.col(c).isNull() for c in rows.columns]), lambda b: b))


def design_terms(df: DataFrame, model: Model, ids: Sequence[str]) -> DataFrame:
    """Design rows in sparse form: per row an array of (term, value), zeros left out."""
    named = Model(model.response, model.numeric, model.factors)
    xs = design(df.withColumn("__ids", F.struct(*ids)), Model(named.response, named.numeric, named.factors, ["__ids"]))
    entries = F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"x{i}").alias("value")) for i, t in enumerate(model.terms)])
    return xs.select("m0.*", F.filter(entries, lambda e: e.getField("value") != 0).alias("terms"), "y")


def memberships(pairs: DataFrame, pair_ids: Sequence[str], members: Sequence[str]) -> DataFrame:
    """Each pair belongs to each of its members with weight 1."""
    entry = [F.struct(F.col(m).alias("member_id"), F.lit(1.0).alias("weight")) for m in members]
    return pairs.select(*pair_ids, F.inline(F.array(*entry)))


def _names(model: Model) -> list[str]:
    return [f"x{i}" for i in range(len(model.terms))] + ["y"]


def fixed_gram(rows: DataFrame, model: Model) -> DataFrame:
    """Sums of products of all fixed columns and the response, long: ``i, j, value`` with i <= j.

    One aggregation with a sum per product; nothing is exploded.
    """
    names = _names(model)
    labels = model.terms + [model.response]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = rows.agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s_{i}_{j}") for i, j in pairs])
    cells = F.array(
        *[F.struct(F.lit(labels[i]).alias("i"), F.lit(labels[j]).alias("j"), F.col(f"s_{i}_{j}").alias("value")) for i, j in pairs]
    )
    return sums.select(F.inline(cells))


def _levels(rows: DataFrame):
    entry = [
        F.struct(F.lit(MEMBER).alias("factor"), F.col(c).cast("string").alias("level"))
        for c in rows.columns if c.startswith("m")
    ]
    if "g" in rows.columns:
        entry.append(F.struct(F.lit(GROUP).alias("factor"), F.col("g").cast("string").alias("level")))
    return entry


def random_by_fixed(rows: DataFrame, model: Model) -> DataFrame:
    """Per random level: number of rows and sums of the fixed columns and the response."""
    names = _names(model)
    long = rows.select(F.explode(F.array(*_levels(rows))).alias("l"), *names)
    return long.groupBy("l.factor", "l.level").agg(
        F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(c).alias(c) for c in names]
    )


def random_gram(rows: DataFrame) -> DataFrame:
    """Pairs of different random levels and how often they meet, each pair both ways round."""
    levels = _levels(rows)
    met = [
        F.struct(levels[i].alias("a"), levels[j].alias("b"))
        for i in range(len(levels)) for j in range(len(levels)) if i != j
    ]
    counts = rows.select(F.explode(F.array(*met)).alias("e")).groupBy(
        F.col("e.a.factor").alias("factor"), F.col("e.a.level").alias("level"),
        F.col("e.b.factor").alias("factor_b"), F.col("e.b.level").alias("level_b"),
    ).agg(F.count(F.lit(1)).cast("double").alias("w"))
    return counts


def gram(rows: DataFrame, model: Model) -> DataFrame:
    """The whole cross-product table of fixed, random and response columns, i <= j by name order within parts."""
    rows = materialise(rows)  # three aggregations read it
    names = _names(model)
    labels = model.terms + [model.response]
    by_fixed = random_by_fixed(rows, model)
    label = F.concat_ws(":", "factor", "level")
    cells = [F.struct(F.lit(l).alias("i"), label.alias("j"), F.col(c).alias("value")) for l, c in zip(labels, names)]
    cells.append(F.struct(label.alias("i"), label.alias("j"), F.col("n").alias("value")))
    fixed_random = by_fixed.select(F.inline(F.array(*cells)))
    other = F.concat_ws(":", "factor_b", "level_b")
    random_random = random_gram(rows).select(label.alias("i"), other.alias("j"), F.col("w").alias("value"))
    return fixed_gram(rows, model).unionByName(fixed_random).unionByName(random_random.where(F.col("i") < F.col("j")))


# ---------------------------------------------------------------------------
# Everything per level stays on Spark


def _sums(df: DataFrame, products: dict[str, F.Column]) -> dict[str, float]:
    row = df.agg(*[F.sum(e).alias(n) for n, e in products.items()]).first()
    return {n: float(row[n] or 0.0) for n in products}


def _square(values: dict[str, float], p: int, prefix: str) -> np.ndarray:
    out = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            out[i, j] = out[j, i] = values[f"{prefix}_{i}_{j}"]
    return out


def moment_variances(
    by_fixed: DataFrame, edges: DataFrame, xx: np.ndarray, xy: np.ndarray, yy: float, n: float
) -> dict[str, float]:
    """Variance components from quadratic forms of least-squares residuals (MINQUE with zero prior).

    The expected values need traces of products of p x p matrices summed over
    levels and over meeting levels, all of them Spark aggregates. Only p x p
    sums come to the driver. Negative estimates are set to 0.
    """
    p = len(xx)
    inv = np.linalg.inv(xx)
    beta = inv @ xy
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    residual = F.col("y") - sum((F.col(f"x{i}") * float(b) for i, b in enumerate(beta)), F.lit(0.0))
    factors = [r[0] for r in by_fixed.select("factor").distinct().collect()]  # at most two
    quad, spread, total, self_ij = {}, {}, {}, {}
    for f in factors:
        own = by_fixed.where(F.col("factor") == f)
        v = _sums(own, {
            "q": residual * residual, "n": F.col("n"), "nn": F.col("n") * F.col("n"),
            **{f"s_{i}_{j}": F.col(f"x{i}") * F.col(f"x{j}") for i, j in upper},
            **{f"t_{i}_{j}": F.col("n") * F.col(f"x{i}") * F.col(f"x{j}") for i, j in upper},
        })
        quad[f], total[f] = v["q"], v["n"]
        spread[f] = _square(v, p, "s")
        self_ij[f] = (v["nn"], _square(v, p, "t"))
    cols = [f"x{i}" for i in range(p)]
    a = by_fixed.select("factor", "level", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = by_fixed.select(
        F.col("factor").alias("factor_b"), F.col("level").alias("level_b"), *[F.col(c).alias(f"b_{c}") for c in cols]
    )
    met = edges.join(a, ["factor", "level"]).join(b, ["factor_b", "level_b"])
    crossed = met.groupBy("factor", "factor_b").agg(
        F.sum(F.col("w") * F.col("w")).alias("ww"),
        *[
            F.sum(F.col("w") * (F.col(f"a_x{i}") * F.col(f"b_x{j}") + F.col(f"a_x{j}") * F.col(f"b_x{i}")) / 2).alias(f"t_{i}_{j}")
            for i, j in upper
        ],
    ).collect()  # at most four rows of p x p sums
    ww = {(f, g): 0.0 for f in factors for g in factors}
    tt = {k: np.zeros((p, p)) for k in ww}
    for f in factors:
        ww[f, f], tt[f, f] = self_ij[f]
    for row in crossed:
        key = (row["factor"], row["factor_b"])
        ww[key] += row["ww"]
        tt[key] = tt[key] + _square(row.asDict(), p, "t")
    k = len(factors)
    lhs, rhs = np.zeros((k + 1, k + 1)), np.zeros(k + 1)
    for i, f in enumerate(factors):
        rhs[i] = quad[f]
        for j, g in enumerate(factors):
            fit = inv @ spread[f] @ inv @ spread[g]
            lhs[i, j] = ww[f, g] - 2 * np.trace(inv @ tt[f, g]) + np.trace(fit)
        lhs[i, k] = lhs[k, i] = total[f] - np.trace(inv @ spread[f])
    lhs[k, k] = n - p
    rhs[k] = yy - xy @ beta
    solved = np.linalg.lstsq(lhs, rhs, rcond=None)[0]
    out = {f: max(0.0, float(v)) for f, v in zip(factors, solved)}
    out["residual"] = max(float(solved[k]), 1e-12 * max(yy / n, 1e-300))
    return out


def solve_levels(
    by_fixed: DataFrame,
    edges: DataFrame,
    names: Sequence[str],
    ridge: dict[str, float],
    tol: float = 1e-10,
    max_iter: int = 200,
) -> DataFrame:
    """Solve (Z'Z + ridge) U = Z'[columns] by preconditioned conjugate gradients.

    All right-hand sides advance together. An iteration is one join of the
    meeting levels with the search directions and one aggregation; the state is
    a row per level, written out each time. The driver sees two numbers per
    right-hand side and iteration.
    """
    names = list(names)
    penalty = None
    for f, value in ridge.items():
        cond = F.col("factor") == f
        penalty = F.when(cond, float(value)) if penalty is None else penalty.when(cond, float(value))
    key = ["factor", "level"]
    diag = F.col("n") + penalty
    state = by_fixed.where(F.col("factor").isin(list(ridge))).select(
        *key, diag.alias("d"),
        *[F.lit(0.0).alias(f"u_{c}") for c in names],
        *[F.col(c).alias(f"r_{c}") for c in names],
        *[(F.col(c) / diag).alias(f"p_{c}") for c in names],
    )
    state = materialise(state)
    live = edges.where(F.col("factor").isin(list(ridge)) & F.col("factor_b").isin(list(ridge)))
    live = materialise(live)

    def energy(df):
        return _sums(df, {c: F.col(f"r_{c}") * F.col(f"r_{c}") / F.col("d") for c in names})

    rz = start = energy(state)
    for _ in range(max_iter):
        if all(rz[c] <= tol * tol * max(start[c], 1e-300) for c in names):
            return state.select(*key, *[F.col(f"u_{c}") for c in names])
        direction = state.select(
            F.col("factor").alias("factor_b"), F.col("level").alias("level_b"), *[F.col(f"p_{c}") for c in names]
        )
        pushed = live.join(direction, ["factor_b", "level_b"]).groupBy(*key).agg(
            *[F.sum(F.col("w") * F.col(f"p_{c}")).alias(f"o_{c}") for c in names]
        )
        moved = state.join(pushed, key, "left").withColumns(
            {f"o_{c}": F.col("d") * F.col(f"p_{c}") + F.coalesce(F.col(f"o_{c}"), F.lit(0.0)) for c in names}
        )
        moved = materialise(moved)
        curve = _sums(moved, {c: F.col(f"p_{c}") * F.col(f"o_{c}") for c in names})
        step = {c: (rz[c] / curve[c] if curve[c] > 0 else 0.0) for c in names}
        moved = moved.withColumns(
            {
                **{f"u_{c}": F.col(f"u_{c}") + F.col(f"p_{c}") * step[c] for c in names},
                **{f"r_{c}": F.col(f"r_{c}") - F.col(f"o_{c}") * step[c] for c in names},
            }
        )
        fresh = energy(moved)
        turn = {c: (fresh[c] / rz[c] if rz[c] > 0 else 0.0) for c in names}
        state = moved.withColumns(
            {f"p_{c}": F.col(f"r_{c}") / F.col("d") + F.col(f"p_{c}") * turn[c] for c in names}
        ).select(state.columns)
        rz = fresh
    raise RuntimeError(f"no convergence in {max_iter} iterations")


def absorbed_products(by_fixed: DataFrame, solved: DataFrame, names: Sequence[str]) -> np.ndarray:
    """Z-side part of the generalised cross-products: columns' Z U, a p x p sum."""
    joined = by_fixed.join(solved, ["factor", "level"])
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    v = _sums(joined, {f"s_{i}_{j}": F.col(names[i]) * F.col(f"u_{names[j]}") for i, j in pairs})
    return _square(v, len(names), "s")
