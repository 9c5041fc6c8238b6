"""Mixed models: cross-products, fits, tail areas."""

import numpy as np
import pytest

from dyadspark.operators import mixed, mixed_fit, reml
from dyadspark.operators.mixed import Model

MODEL = Model("y", ["a"], {"kind": ["p", "q", "r"]}, ["b1", "b2"], "year")


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    birds, years = rng.normal(0, 1.0, 40), rng.normal(0, 0.7, 8)
    rows = []
    for _ in range(900):
        i, j = rng.choice(40, 2, replace=False)
        year, kind, a = int(rng.integers(8)), "pqr"[rng.integers(3)], float(rng.normal())
        y = 1 + 0.5 * a + {"p": 0, "q": 0.3, "r": -0.4}[kind] + birds[i] + birds[j] + years[year] + rng.normal()
        rows.append((int(i), int(j), year, kind, a, float(y)))
    rows.append((0, 1, 0, "p", None, 1.0))
    rows.append((0, 1, 0, "unlisted", 1.0, 1.0))
    return rows


@pytest.fixture(scope="module")
def df(spark, frame):
    return spark.createDataFrame(frame, "b1 bigint, b2 bigint, year int, kind string, a double, y double").cache()


def dense(frame):
    rows = [r for r in frame if r[4] is not None and r[3] in "pqr"]
    x = np.array([[1, r[3] == "q", r[3] == "r", r[4]] for r in rows], float)
    z = np.zeros((len(rows), 48))
    for k, r in enumerate(rows):
        z[k, r[0]] = z[k, r[1]] = z[k, 40 + r[2]] = 1
    return x, z, np.array([r[5] for r in rows])


def test_gram_is_complete(df, frame):
    x, z, y = dense(frame)
    g = {(r.i, r.j): r.value for r in mixed.gram(mixed.design(df, MODEL), MODEL).collect()}
    assert g[("intercept", "intercept")] == 900
    assert g[("kind=q", "a")] == pytest.approx(x[:, 1] @ x[:, 3])
    assert g[("a", "y")] == pytest.approx(x[:, 3] @ y)
    assert g[("y", "member:3")] == pytest.approx(z[:, 3] @ y)
    zz = z.T @ z
    name = [f"member:{i}" for i in range(40)] + [f"group:{i}" for i in range(8)]
    for i in range(48):
        for j in range(48):
            if name[i] <= name[j] and zz[i, j]:
                assert g[(name[i], name[j])] == zz[i, j]


def generalised(variances, frame):
    """Effects and their covariance at given variances, from dense matrices."""
    x, z, y = dense(frame)
    v = variances["residual"] * np.eye(len(y)) + variances["member"] * z[:, :40] @ z[:, :40].T
    v += variances["group"] * z[:, 40:] @ z[:, 40:].T
    vi = np.linalg.inv(v)
    cov = np.linalg.inv(x.T @ vi @ x)
    return cov @ x.T @ vi @ y, cov


def test_fit_is_generalised_least_squares_at_moment_variances(df, frame):
    fit = mixed_fit.fit(df, MODEL, "moments")
    x, z, y = dense(frame)
    inv = np.linalg.inv(x.T @ x)
    m = np.eye(900) - x @ inv @ x.T
    parts = [z[:, :40] @ z[:, :40].T, z[:, 40:] @ z[:, 40:].T, np.eye(900)]
    lhs = np.array([[np.trace(m @ a @ m @ b) for b in parts] for a in parts])
    want = np.linalg.solve(lhs, [(m @ y) @ a @ (m @ y) for a in parts])
    assert [fit.variances[k] for k in ("member", "group", "residual")] == pytest.approx(list(want), rel=1e-8)
    beta, cov = generalised(fit.variances, frame)
    assert fit.method == "moments" and fit.n == 900 and fit.levels == 48 and fit.df_of is None
    assert fit.beta == pytest.approx(beta, abs=1e-7) and fit.cov == pytest.approx(cov, rel=1e-6, abs=1e-9)


def dense_criterion(x, y, parts):
    """-2 restricted log likelihood of variances (a part each, then the residual), from dense matrices."""

    def deviance(theta):
        v = theta[-1] * np.eye(len(y)) + sum(t * m for t, m in zip(theta, parts))
        vi = np.linalg.inv(v)
        xvx = x.T @ vi @ x
        r = y - x @ np.linalg.solve(xvx, x.T @ vi @ y)
        return np.linalg.slogdet(v)[1] + np.linalg.slogdet(xvx)[1] + r @ vi @ r

    return deviance


def scoring(x, y, parts, theta):
    """Restricted likelihood estimates by Fisher scoring, and the inverse information."""
    matrices = [*parts, np.eye(len(y))]
    for _ in range(40):
        vi = np.linalg.inv(sum(t * m for t, m in zip(theta, matrices)))
        p = vi - vi @ x @ np.linalg.solve(x.T @ vi @ x, x.T @ vi)
        pm = [p @ m for m in matrices]
        score = np.array([0.5 * (y @ a @ p @ y - np.trace(a)) for a in pm])
        info = np.array([[0.5 * np.trace(a @ b) for b in pm] for a in pm])
        theta = np.maximum(theta + np.linalg.solve(info, score), 1e-8)
    return theta


def test_reml_equals_dense_reml(df, frame):
    fit = mixed_fit.fit(df, MODEL)
    x, z, y = dense(frame)
    parts = [z[:, :40] @ z[:, :40].T, z[:, 40:] @ z[:, 40:].T]
    theta = scoring(x, y, parts, np.array([1.0, 1.0, 1.0]))
    got = [fit.variances[k] for k in ("member", "group", "residual")]
    assert fit.method == "reml" and fit.n == 900 and fit.levels == 48
    assert got == pytest.approx(list(theta), rel=1e-4)
    beta, cov = generalised(dict(zip(("member", "group", "residual"), theta)), frame)
    assert fit.beta == pytest.approx(beta, abs=1e-4) and fit.cov == pytest.approx(cov, rel=1e-3, abs=1e-6)


def test_degrees_of_freedom_equal_dense_computation(df, frame):
    fit = mixed_fit.fit(df, MODEL)
    x, z, y = dense(frame)
    parts = [z[:, :40] @ z[:, :40].T, z[:, 40:] @ z[:, 40:].T]
    theta = np.array([fit.variances[k] for k in ("member", "group", "residual")])
    deviance, eye = dense_criterion(x, y, parts), np.eye(3)
    h = 1e-3 * theta
    hessian = np.array([[
        sum(s * t * deviance(theta + s * h * eye[i] + t * h * eye[j]) for s in (1, -1) for t in (1, -1)) / (4 * h[i] * h[j])
        for j in range(3)] for i in range(3)])

    def cov(th):
        return generalised(dict(zip(("member", "group", "residual"), th)), frame)[1]

    slopes = [(cov(theta + h * e) - cov(theta - h * e)) / (2 * h @ e) for e in eye]
    for c in (*np.eye(4), np.array([0, 1.0, -1.0, 0])):
        slope = np.array([c @ s @ c for s in slopes])
        want = 2 * (c @ cov(theta) @ c) ** 2 / (slope @ (2 * np.linalg.inv(hessian)) @ slope)
        assert fit.df_of(c) == pytest.approx(want, rel=1e-2)


def test_many_levels_beyond_the_basis(spark, monkeypatch):
    monkeypatch.setattr(mixed_fit.reml, "MAX_STEPS", 4)  # 4 steps of 26 columns for 300 levels
    rng = np.random.default_rng(11)
    birds, rows = rng.normal(0, 0.8, 300), []
    for _ in range(1500):
        i, j = rng.choice(300, 2, replace=False)
        a = float(rng.normal())
        rows.append((int(i), int(j), a, float(1 + 0.5 * a + birds[i] + birds[j] + rng.normal())))
    df = spark.createDataFrame(rows, "b1 bigint, b2 bigint, a double, y double")
    fit = mixed_fit.fit(df, Model("y", ["a"], {}, ["b1", "b2"]))
    x, z = np.array([[1, r[2]] for r in rows]), np.zeros((1500, 300))
    for k, r in enumerate(rows):
        z[k, r[0]] = z[k, r[1]] = 1
    theta = scoring(x, np.array([r[3] for r in rows]), [z @ z.T], np.array([1.0, 1.0]))
    assert [fit.variances["member"], fit.variances["residual"]] == pytest.approx(list(theta), rel=5e-3)


@pytest.fixture(scope="module")
def many_groups():
    """Sixty separate parts of seven birds and three years, and one large part: twelve years chained by the birds of both neighbours."""
    rng = np.random.default_rng(7)
    birds, years, rows = rng.normal(0, 0.9, 500), rng.normal(0, 0.6, 192), []
    for part in range(60):
        for _ in range(25):
            i, j = 7 * part + rng.choice(7, 2, replace=False)
            rows.append((int(i), int(j), int(3 * part + rng.integers(3))))
    for year in range(12):
        for _ in range(40):
            i, j = 420 + (6 * year + rng.choice(12, 2, replace=False)) % 80
            rows.append((int(i), int(j), 180 + year))
    a = rng.normal(size=len(rows))
    return [(i, j, g, float(x), float(1 + 0.5 * x + birds[i] + birds[j] + years[g] + rng.normal())) for (i, j, g), x in zip(rows, a)]


@pytest.mark.parametrize("whole, few", [(512, 32), (20, 32), (20, 0)])
def test_many_groups_are_no_dense_columns(spark, many_groups, monkeypatch, whole, few):
    # solved whole; the large part by one basis with its groups as columns; the large part by a basis for each ratio
    monkeypatch.setattr(reml, "WHOLE", whole)
    monkeypatch.setattr(reml, "FEW", few)
    widths, krylov = [], reml.krylov

    def watched(start, edges, columns, *rest, **more):
        widths.append(len(columns))
        return krylov(start, edges, columns, *rest, **more)

    monkeypatch.setattr(reml, "krylov", watched)
    df = spark.createDataFrame(many_groups, "b1 bigint, b2 bigint, year int, a double, y double")
    fit = mixed_fit.fit(df, Model("y", ["a"], {}, ["b1", "b2"], "year"))
    x, y = np.array([[1, r[3]] for r in many_groups]), np.array([r[4] for r in many_groups])
    z = np.zeros((len(y), 692))
    for k, r in enumerate(many_groups):
        z[k, r[0]] = z[k, r[1]] = z[k, 500 + r[2]] = 1
    theta = scoring(x, y, [z[:, :500] @ z[:, :500].T, z[:, 500:] @ z[:, 500:].T], np.array([1.0, 1.0, 1.0]))
    assert [fit.variances[k] for k in ("member", "group", "residual")] == pytest.approx(list(theta), rel=1e-4)
    assert fit.levels == (z.sum(axis=0) > 0).sum()
    assert max(widths, default=0) == {(512, 32): 0, (20, 32): 3 + 12, (20, 0): 3}[whole, few]


def test_labels_of_long_chains_stay_open(spark, monkeypatch):
    monkeypatch.setattr(reml, "LABEL_ROUNDS", 2)
    chain, pairs = [f"c{i:03}" for i in range(200)], [("p0", "p1"), ("q0", "q1")]
    met = [*zip(chain, chain[1:]), *pairs]
    links = spark.createDataFrame([*met, *[(b, a) for a, b in met]], "a string, b string")
    nodes = spark.createDataFrame([(n,) for n in [*chain, "p0", "p1", "q0", "q1", "r"]], "node string")
    labels = {r.node: (r.label, r.closed) for r in reml.component_labels(nodes, links).collect()}
    assert not any(labels[n][1] for n in chain)
    assert labels["p1"] == ("p0", True) and labels["q1"] == ("q0", True) and labels["r"] == ("r", True)


def test_a_level_may_meet_itself(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), int(j), float(i - j + rng.normal())) for i, j in rng.integers(0, 12, (300, 2))]
    fit = mixed_fit.fit(spark.createDataFrame(rows, "b1 bigint, b2 bigint, y double"), Model("y", [], {}, ["b1", "b2"]))
    z = np.zeros((300, 12))
    for k, r in enumerate(rows):
        z[k, r[0]] += 1
        z[k, r[1]] += 1
    y = np.array([r[2] for r in rows])
    theta = scoring(np.ones((300, 1)), y, [z @ z.T], np.array([1.0, 1.0]))
    assert fit.variances["residual"] == pytest.approx(theta[1], rel=1e-4)
    assert fit.variances["member"] == pytest.approx(theta[0], rel=1e-3, abs=1e-5)


def test_component_without_support_is_zero(spark):
    rng = np.random.default_rng(2)
    rows = [(k % 30, (k * 7 + 1) % 30, float(rng.normal()), float(rng.normal())) for k in range(600)]
    df = spark.createDataFrame(rows, "b1 bigint, b2 bigint, a double, y double").where("b1 <> b2")
    noise = df.withColumn("y", df.y - 0.0)
    fit = mixed_fit.fit(noise, Model("y", ["a"], {}, ["b1", "b2"]))
    assert fit.variances["member"] >= 0 and np.isfinite(fit.df_of(np.array([0.0, 1.0])))
    table = {r.term: r for r in mixed_fit.coefficients(spark, fit).collect()}
    assert table["a"].p_method == "satterthwaite" and table["a"].df > 100


def test_effects_at_given_variances(df, frame):
    rows = mixed.design(df, MODEL).cache()
    given = {"member": 1.2, "group": 0.0, "residual": 0.9}
    fit = mixed_fit.fit_levels(
        MODEL, mixed_fit._fixed_matrix(rows, MODEL), mixed.random_by_fixed(rows, MODEL).cache(),
        mixed.random_gram(rows).cache(), given)
    beta, cov = generalised(given, frame)
    assert fit.beta == pytest.approx(beta, abs=1e-7) and fit.cov == pytest.approx(cov, rel=1e-6, abs=1e-9)


def test_without_random_part_it_is_least_squares(df, frame):
    x, _, y = dense(frame)
    fit = mixed_fit.fit(df, Model("y", ["a"], {"kind": ["p", "q", "r"]}))
    assert fit.beta == pytest.approx(np.linalg.lstsq(x, y, rcond=None)[0])


def test_dependent_terms_have_no_estimate(df, frame):
    doubled = df.withColumn("twice", df.a * 2)
    whole = mixed_fit.fit(df, Model("y", ["a"], {"kind": ["p", "q", "r"]}))
    fit = mixed_fit.fit(doubled, Model("y", ["a", "twice"], {"kind": ["p", "q", "r", "absent"]}))
    have = dict(zip(fit.model.terms, fit.beta))
    assert np.isnan(have["kind=absent"]) and sum(map(np.isnan, have.values())) == 2
    assert have["kind=q"] == pytest.approx(dict(zip(whole.model.terms, whole.beta))["kind=q"])


def test_reading_a_fit(spark, df):
    fit = mixed_fit.fit(df, MODEL)
    table = {r.term: r for r in mixed_fit.coefficients(spark, fit).collect()}
    assert set(table) == set(MODEL.terms) and table["a"].p_value < 1e-10
    none = {r.contrast: r for r in mixed_fit.contrasts(spark, fit, "kind", "none").collect()}
    tukey = {r.contrast: r for r in mixed_fit.contrasts(spark, fit, "kind", "tukey").collect()}
    holm = {r.contrast: r for r in mixed_fit.contrasts(spark, fit, "kind", "holm").collect()}
    assert len(none) == 3
    assert none["p - q"].estimate == pytest.approx(-table["kind=q"].estimate)
    assert all(none[k].p_value <= tukey[k].p_value + 1e-12 and none[k].p_value <= holm[k].p_value + 1e-12 for k in none)
    means = {r.level: r.mean for r in mixed_fit.marginal_means(spark, fit, "kind").collect()}
    assert means["q"] - means["p"] == pytest.approx(table["kind=q"].estimate)
    tests = {r.term: r for r in mixed_fit.term_tests(spark, fit).collect()}
    assert tests["a"].chi2 == pytest.approx(table["a"].statistic ** 2) and tests["kind"].df == 2
    assert all(r.vif >= 1 - 1e-9 for r in mixed_fit.inflation_factors(spark, fit).collect())
    assert mixed_fit.predictions(spark, fit, "kind").count() == 3


def test_tail_areas(spark):
    # tabulated 5% points of the studentised range
    assert mixed_fit.studentised_range_upper(3.578, 3, 20) == pytest.approx(0.05, abs=2e-4)
    assert mixed_fit.studentised_range_upper(3.858, 5, float("inf")) == pytest.approx(0.05, abs=2e-4)
    assert mixed_fit.studentised_range_upper(4.602, 3, 5) == pytest.approx(0.05, abs=3e-4)
    tails = mixed_fit.Tails(spark)
    assert tails.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert tails.chi2_upper(5.991, 2) == pytest.approx(0.05, abs=1e-4)


def test_basis_of_dependent_columns(spark):
    # a column that is the sum of others and one of hardly any length: what is rounding in the sums must not become a direction
    rng = np.random.default_rng(3)
    z = np.zeros((400, 90))
    for k in range(400):  # two separate parts of 30 levels, and 30 levels that meet nobody
        part = 30 * (k % 2)
        z[k, part + rng.choice(30, 2, replace=False)] = 1
    z[:30, 60:] = np.eye(30)
    a = z.T @ z
    years = z.T @ np.eye(8)[rng.integers(8, size=400)]
    b = np.column_stack([years, years.sum(axis=1), years[:, 0] + 1e-11 * years[:, 1], z.T @ rng.normal(size=400)])
    names = [f"b{i}" for i in range(b.shape[1])]
    start = spark.createDataFrame(
        [(str(i), float(a[i, i]), *map(float, b[i])) for i in range(90)],
        "level string, n double, " + ", ".join(f"{n} double" for n in names)).repartition(7)
    edges = spark.createDataFrame(
        [(str(i), str(j), float(a[i, j])) for i in range(90) for j in range(90) if i != j and a[i, j]],
        "level string, level_b string, w double")
    last = list(reml.krylov(start, edges, names))[-1]
    assert len(last.values) == 90 and np.sort(last.values) == pytest.approx(np.linalg.eigvalsh(a), abs=1e-8)
    for g in (0.01, 1.0, 100.0):
        want = b.T @ np.linalg.solve(np.eye(90) + g * a, b) * g
        assert last.quadratic(lambda v: g / (1 + g * v)) == pytest.approx(want, rel=1e-7, abs=1e-7)
        assert last.trace(lambda v: np.log1p(g * v)) == pytest.approx(np.linalg.slogdet(np.eye(90) + g * a)[1], rel=1e-8)


def test_coefficients_query_has_finite_figures(spark, folder):
    import __spark_entry__

    rows = __spark_entry__.queries()["l5_coefficients"](spark, folder).collect()
    assert len(rows) == 7 and all(np.isfinite([r.estimate, r.df, r.p_value]).all() and r.std_error > 1e-6 for r in rows)
    assert all(1 < r.df < r.nobs for r in rows)
