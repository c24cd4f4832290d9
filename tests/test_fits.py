import math

import numpy as np
import pytest

from tests.one_cell import Stage2
from tidegauge.plans import cell_fit as K


def cell(rng, groups=12, rows=14):
    of = np.repeat(np.arange(groups), rows)
    x1 = np.abs(rng.normal(0.8, 0.3, len(of))) + 0.05 * of
    x2 = rng.normal(0.1, 0.2, len(of)) + 0.03 * of
    return np.abs(0.4 * x1 + 0.2 * x2 + rng.normal(0, 0.1, len(of))), x1, x2, of


def dense(y, x1, x2, of, w):
    """The k-class estimate by full matrices."""
    n = len(y)
    z = (of[:, None] == np.unique(of)[None, :]).astype(float)
    s = np.sqrt(w * n / w.sum())[:, None]
    y, x, z = y * s[:, 0], np.column_stack([x1, x2, np.ones(n)]) * s, z * s
    p = z @ np.linalg.solve(z.T @ z, z.T)
    a = np.column_stack([y, x[:, :2]])
    c = x[:, 2:]
    m1 = a.T @ a - (a.T @ c) @ np.linalg.solve(c.T @ c, c.T @ a)
    low = np.linalg.eigvals(np.linalg.solve(a.T @ a - a.T @ p @ a, m1)).real.min()
    kappa = low - 1 / (n - z.shape[1])
    left = (1 - kappa) * x.T @ x + kappa * x.T @ p @ x
    eta = np.linalg.solve(left, (1 - kappa) * x.T @ y + kappa * x.T @ p @ y)
    u = y - x @ eta
    inv = np.linalg.inv(left)
    return eta, kappa, inv @ (x.T * u**2 @ x) @ inv, u @ p @ u / (u @ u / n)


def test_group_sums_equal_dense_algebra():
    rng = np.random.default_rng(3)
    y, x1, x2, of = cell(rng)
    g = K.Groups(y, x1, x2, of)
    for w in (np.ones(g.l), rng.uniform(0.5, 2, g.l)):
        w = w * g.n.sum() / (w @ g.n)
        fit = K.fuller(g, w)
        eta, kappa, v, j = dense(y, x1, x2, of, w[of])
        assert np.allclose(fit["eta"], eta) and math.isclose(fit["kappa"], kappa) and np.allclose(fit["v"], v)
        q = np.r_[1.0, -fit["eta"]]
        assert math.isclose(q @ fit["b"] @ q / (q @ fit["t"] @ q) * len(y), j)


def test_closed_form_minimises_its_objective_and_sandwich_equals_dense():
    y, x1, x2, of = cell(np.random.default_rng(5))
    g = K.Groups(y, x1, x2, of)
    order = [0, 3, 1, 2]
    t = g.a.sum(0)[np.ix_(order, order)]
    b = (g.between - g.a / g.n[:, None, None]).sum(0)[np.ix_(order, order)]
    theta, alpha = K.hliml(t, b)
    q = lambda th: (np.r_[1, -th] @ b @ np.r_[1, -th]) / (np.r_[1, -th] @ t @ np.r_[1, -th])
    assert math.isclose(q(theta), alpha, rel_tol=1e-8)
    rng = np.random.default_rng(0)
    assert all(q(theta + rng.normal(0, 0.01, 3)) >= alpha - 1e-12 for _ in range(50))
    x = g.rows[:, [3, 1, 2]]
    e = y - x @ theta
    got, f, j = K.sandwich(x, e, g.of, g.n, t, b, alpha)
    z = (of[:, None] == np.unique(of)[None, :]).astype(float)
    p = z @ np.linalg.solve(z.T @ z, z.T)
    off = p - np.diag(np.diag(p))
    h = x.T @ (off - alpha * np.eye(len(y))) @ x
    xb = x - np.outer(e, e @ x / (e @ e))
    px = p @ xb
    cross = xb.T @ (np.diag(p) * e**2)[:, None].__mul__(px)
    m = e[:, None] * xb
    middle = px.T @ (e[:, None] ** 2 * px) - cross - cross.T + m.T @ (p * p) @ m
    assert np.allclose(got, np.linalg.inv(h) @ middle @ np.linalg.inv(h))
    assert math.isclose(f, g.l * (e @ off @ e) / (e**4).sum()) and math.isclose(j, e @ off @ e / math.sqrt(e**2 @ off**2 @ e**2 / g.l) + g.l)


def simulate(rng, sigma, omega, groups=25, years=30):
    """Demand and supply in differences against a reference: eps and delta with exporter-specific variances."""
    rho = omega * (sigma - 1) / (1 + sigma * omega)
    rows = []
    for g in range(groups - 1):
        a, b = rng.uniform(0.5, 2, 2)
        eps, dlt = rng.normal(0, a, years), rng.normal(0, b, years)
        p = (omega * eps + dlt) / (1 + omega * sigma)
        s = eps - (sigma - 1) * p
        rows += [(pp * pp, ss * ss, pp * ss, g) for pp, ss in zip(p, s, strict=True)]
    return (*np.array([r[:3] for r in rows]).T, np.array([r[3] for r in rows]), rho)


@pytest.mark.parametrize("sigma,omega", [(3.0, 0.5), (2.0, 1.0)])
def test_synthetic_recovery(sigma, omega):
    rng = np.random.default_rng(11)
    fits = [K.fit_cell(*simulate(rng, sigma, omega, years=60)[:4]) for _ in range(25)]
    ok = [f["sigma"] for f in fits if f["status"] == "ok" and f["final_source"] == "hliml"]
    assert len(ok) >= 15 and abs(np.median(ok) - sigma) < 0.35


def test_fit_is_invariant_to_labels_and_reports_thin_cells():
    y, x1, x2, of = cell(np.random.default_rng(8))
    a, b = K.fit_cell(y, x1, x2, of), K.fit_cell(y, x1, x2, 1000 - of)
    assert a["status"] == b["status"] and math.isclose(a["kappa"], b["kappa"], rel_tol=1e-9) and math.isclose(a["fstat_kp"], b["fstat_kp"], rel_tol=1e-9)
    assert K.fit_cell(y[:3], x1[:3], x2[:3], of[:3])["status"] == "fail_insufficient_obs"
    two = of < 2
    assert K.fit_cell(y[two], x1[two], x2[two], of[two])["status"] == "fail_too_few_exporters"


def test_degrees_of_freedom_and_rows_of_the_tables():
    y, x1, x2, of = cell(np.random.default_rng(9), groups=8)
    f = K.fit_cell(y, x1, x2, of, ref=999)
    assert (f["j_df"], f["sy_row"], f["gs_row"], f["gs_df"]) == (5, 7, 9, 6)
    f = K.fit_cell(y, x1, x2, of, ref=0)
    assert (f["j_df"], f["sy_row"], f["gs_row"], f["gs_df"]) == (5, 7, 8, 5)
    shifted = K.fit_cell(y, x1 + 3, x2 - 2, of, ref=999)
    assert math.isclose(shifted["fstat_kp"], f["fstat_kp"], rel_tol=0.2)


def problem(rng, j=6, m=5, lam=0.1, prior=math.log(0.7)):
    return Stage2(3.4, np.abs(rng.normal(0.3, 0.1, j)), rng.normal(0.2, 0.3, (j, 5)), rng.uniform(0.5, 2, j), np.abs(rng.normal(0.3, 0.1, m)), rng.normal(0.1, 0.2, (m, 9)), np.arange(m), np.full(m, 3.0), np.full(m, 0.9), prior, lam)


def test_derivatives_equal_differences():
    rng = np.random.default_rng(1)
    p = problem(rng)
    gk, gj, h = 0.8, rng.uniform(0.2, 1.5, 6), 1e-6
    r, dk, dj, re, de = p.parts(gk, gj)
    up, down = p.parts(gk + h, gj), p.parts(gk - h, gj)
    assert np.allclose((up[0] - down[0]) / (2 * h), dk, atol=1e-6) and np.allclose(up[3], down[3])
    up, down = p.parts(gk, gj + h), p.parts(gk, gj - h)
    assert np.allclose((up[0] - down[0]) / (2 * h), dj, atol=1e-6) and np.allclose((up[3] - down[3]) / (2 * h), de, atol=1e-6)


def test_arrow_equals_dense_inverse_and_fit_is_a_minimum():
    rng = np.random.default_rng(2)
    p = problem(rng)
    gk, gj, value, code = p.fit(0.69)
    assert code == 0
    for _ in range(200):
        assert p.value(gk * math.exp(rng.normal(0, 0.02)), gj * np.exp(rng.normal(0, 0.02, 6))) >= value - 1e-9
    a, b, d, pa, pd = p.curvature(gk, gj)
    full = np.zeros((7, 7))
    full[0, 0], full[0, 1:], full[1:, 0] = a + pa, b, b
    full[1:, 1:] = np.diag(d + pd)
    r, _, _, re, _ = p.parts(gk, gj)
    scale = (p.w @ r**2 + p.w[p.on] @ re**2) / (len(r) + len(re) - 7)
    se, status, exposure, shrink = p.errors(gk, gj)
    want = np.sqrt(np.diag(scale * np.linalg.inv(full)))
    ok = np.array(status) == "ok"
    assert np.allclose(se[ok], want[ok]) and exposure[0] == 6 and set(exposure[1:]) == {1, 2} and ((shrink >= 0) & (shrink <= 1)).all()
    x0, xs = p.solve(a + pa, b, d + pd, 1.0, np.ones(6))
    assert np.allclose(full @ np.r_[x0, xs], np.ones(7))


def test_no_export_rows_has_no_errors_but_a_fit():
    p = problem(np.random.default_rng(4), m=0)
    gk, gj, value, code = p.fit(0.69)
    assert math.isfinite(value) and p.errors(gk, gj)[1] == ["insufficient_df"] * 7


def test_no_prior_still_fits():
    p = problem(np.random.default_rng(6), prior=float("nan"))
    assert math.isfinite(p.fit(0.69)[2])


def test_import_equation_in_the_homogeneous_limit():
    """With all gammas equal, the equation reduces to the two-regressor form in x1 and x2."""
    rng = np.random.default_rng(7)
    s, g = rng.normal(size=8), 0.6
    p, ref_p = rng.normal(size=8), rng.normal(size=8)
    own = p + ref_p
    x = np.column_stack([s * s, s * p, s * own, s * ref_p, p * ref_p])
    sigma = 3.0
    r, _, _ = K.import_side(g, np.full(8, g), sigma, np.zeros(8), x)
    want = g / ((1 + g) * (sigma - 1)) * s * s + (g * (sigma - 2) - 1) / ((1 + g) * (sigma - 1)) * s * p
    assert np.allclose(-r, want)
