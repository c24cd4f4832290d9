"""The batch solver against its one-cell twin, and its second try."""

import math

import numpy as np
import pandas as pd
import pytest

from tests import one_cell
from tests.test_pipeline import synthetic
from tidegauge.functions import keep
from tidegauge.operators.panel import Config, prepare, raw_panel
from tidegauge.plans import stage2 as S2
from tidegauge.plans.batch_fit import Batch


def ragged(seed=0, cells=60, lam=0.1):
    """(one-cell problems, the same as one batch, starts): 1 to 9 rows, some with export rows, some without a prior."""
    rng = np.random.default_rng(seed)
    twins = []
    for c in range(cells):
        j = int(rng.integers(1, 10))
        on = np.sort(rng.choice(j, int(rng.integers(0, j + 1)), replace=False))
        m = len(on)
        prior = float("nan") if c % 7 == 3 else math.log(rng.uniform(0.3, 1.5))
        twins.append(one_cell.Stage2(
            rng.uniform(1.3, 6), np.abs(rng.normal(0.3, 0.1, j)), rng.normal(0.2, 0.3, (j, 5)), rng.uniform(0.5, 2, j), np.abs(rng.normal(0.3, 0.1, m)), rng.normal(0.1, 0.2, (m, 9)), on,
            rng.uniform(1.5, 4, m), rng.uniform(0.3, 1.5, m), prior, lam,
        ))
    sizes = [len(t.y) for t in twins]
    first = np.cumsum([0, *sizes[:-1]])
    join = lambda f: np.concatenate([f(t) for t in twins])
    batch = Batch(
        np.repeat(np.arange(cells), sizes), np.array([t.sigma for t in twins]), join(lambda t: t.y), join(lambda t: t.x), join(lambda t: t.w), np.concatenate([t.on + a for t, a in zip(twins, first, strict=True)]),
        join(lambda t: t.ey), join(lambda t: t.ex), join(lambda t: t.sv), join(lambda t: t.gv), np.array([t.prior for t in twins]), lam,
    )
    return twins, batch, rng.uniform(0.4, 1.2, cells)


@pytest.mark.parametrize("lam", (0.1, 0.0))
def test_batch_equals_cells_one_by_one(lam):
    twins, batch, starts = ragged(lam=lam)
    gk, gj, value, code = batch.fit(starts)
    (sk, how_k, ek, wk), (sj, how_j, ej, wj) = batch.errors(gk, gj)
    dk, dj = batch.slopes(gk, gj)
    close = lambda a, b: np.allclose(a, b, rtol=1e-6, atol=1e-9, equal_nan=True)
    for c, t in enumerate(twins):
        mine = batch.of == c
        k, j, v, how = t.fit(starts[c])
        assert how == code[c] and math.isclose(v, value[c], rel_tol=1e-7, abs_tol=1e-12)
        if lam and t.prior == t.prior:  # elsewhere flat directions leave the point open
            assert close(k, gk[c]) and close(j, gj[mine])
        se, status, exposure, shrink = t.errors(gk[c], gj[mine])
        assert close(se, np.r_[sk[c], sj[mine]]) and list(status) == [how_k[c], *how_j[mine]]
        assert list(exposure) == [ek[c], *ej[mine]] and close(shrink, np.r_[wk[c], wj[mine]])
        a, b, d, _, _ = t.arrow(gk[c], gj[mine])
        if lam and (d > 1e-12).all():
            assert close(t.slopes(gk[c], gj[mine]), np.r_[dk[c], dj[mine]])


def test_joint_equals_cells_one_by_one():
    twins, batch, starts = ragged(seed=5, cells=6, lam=0.0)
    sigma, gk, gj, value, code = batch.joint(starts)
    for c, t in enumerate(twins):
        want = one_cell.joint(t, starts[c])
        assert value[c] <= want[3] * (1 + 1e-6) + 1e-9


def test_search_finds_the_minimum_and_never_rises():
    _, batch, starts = ragged(seed=2)
    gk, gj, value, code = batch.fit(starts)
    k, j, v = batch.search()
    assert (v[code == 0] <= value[code == 0] * (1 + 1e-5) + 1e-7).all()  # a descent may end in a worse local minimum
    assert np.allclose(batch.value(k, j), v, rtol=1e-9)
    stuck = batch.take(np.arange(batch.cells) < 9)
    stuck.fit = lambda start, rows=None: (gk[:9] * 3, gj[batch.of < 9] * 3, stuck.value(gk[:9] * 3, gj[batch.of < 9] * 3), np.full(9, 52))
    worse = stuck.fit(None)[2]
    k, j, v, code = stuck.fit_or_search(starts[:9])
    assert (v <= worse).all() and (v < worse).any() and (code == 0).all() and np.allclose(stuck.value(k, j), v)


def test_cells_cut_into_batches_give_the_same_rows(spark, monkeypatch):
    cfg = Config()
    panel = keep.kept(prepare(raw_panel(synthetic(spark), cfg), cfg))
    none = panel.select("importer", "good").distinct().selectExpr("importer", "good", "3.0D AS sigma", "0.7D AS gamma")
    priors = panel.select("good").distinct().selectExpr("good", "-0.5D AS ln_gamma_prior")
    inputs = keep.kept(S2.cell_inputs(panel, cfg, none.select("importer", "good", "sigma"), 3.0, priors, none.select("importer", "good", "gamma"), 0.7, None, 0.7))
    key = ["importer", "good", "exporter"]
    whole = S2.solve_cells(inputs, 0.1).toPandas().sort_values(key, ignore_index=True)
    monkeypatch.setattr(S2, "BATCH_ROWS", 3)
    cut = S2.solve_cells(inputs.coalesce(1), 0.1).toPandas().sort_values(key, ignore_index=True)
    assert len(whole) > 10
    pd.testing.assert_frame_equal(whole, cut, rtol=1e-6)
    monkeypatch.undo()
    path = S2.solve_path(inputs, [0.02, 0.1, 0.5])
    for lam in (0.02, 0.1, 0.5):  # each as if fitted alone, from its own start
        alone = S2.solve_cells(inputs, lam).toPandas().sort_values(key, ignore_index=True)
        along = path.filter(f"lambda = {lam}").drop("lambda").toPandas().sort_values(key, ignore_index=True)
        pd.testing.assert_frame_equal(alone[["gamma", "obj_value", "convergence", "tier"]], along[["gamma", "obj_value", "convergence", "tier"]], rtol=1e-3)
    rows = {r["lambda"]: r for r in S2.lambda_sweep(inputs, [0.1, 0.5]).collect()}
    gammas = whole[whole.gamma > 0].gamma
    assert set(rows) == {0.1, 0.5} and rows[0.1].n_estimates == len(gammas) and math.isclose(rows[0.1].plateau_share, (gammas > 20).mean())
    assert S2.solve_cells(inputs.limit(0), 0.1).count() == 0


def exporter_moments(rng, sigma, sv, gv, gammas, years=20_000):
    """Export moments of flows simulated from the structural equations: supply and demand of each exporter here and at its
    reference destination, shocks apart."""
    share = lambda g: g / (1 + g)
    y, x = np.empty(len(gammas)), np.empty((len(gammas), 9))
    for k, g in enumerate(gammas):
        pv = rng.normal(0, 0.4, years)
        lv = 0.8 * pv + rng.normal(0, 0.5, years)
        demand, supply = rng.normal(0, 0.5, years), rng.normal(0, 0.4, years)
        here = ((1 + (sigma - 1) * share(gv)) * lv + (sv - sigma) * pv - (sigma - 1) * supply + demand) / (1 + (sigma - 1) * share(g))
        price = pv + share(g) * here - share(gv) * lv + supply
        pairs = ((here, here), (here, price), (lv, lv), (lv, price), (lv, pv), (here, pv), (here, lv), (pv, pv), (pv, price))
        y[k], x[k] = ((price - pv) ** 2).mean(), [(a * b).mean() for a, b in pairs]
    return y, x


def test_implied_signs_fit_the_moments_and_printed_ones_do_not():
    from tidegauge.plans.cell_fit import export_side

    gammas = np.array([0.4, 0.8, 1.5])
    y, x = exporter_moments(np.random.default_rng(5), 3.0, 4.5, 0.9, gammas)
    miss = {p: np.sqrt((export_side(gammas, 3.0, y, x, np.full(3, 4.5), np.full(3, 0.9), p)[0] ** 2).mean()) / y.mean() for p in (False, True)}
    assert miss[False] < 0.05 and miss[True] > 0.15 and miss[True] > 5 * miss[False]
    for printed in (False, True):
        at = lambda g: export_side(g, 3.0, y, x, np.full(3, 4.5), np.full(3, 0.9), printed)  # noqa: B023, E731
        assert np.allclose((at(gammas + 1e-6)[0] - at(gammas - 1e-6)[0]) / 2e-6, at(gammas)[1], atol=1e-6)


def test_printed_signs_reach_the_fits_and_defaults_follow_a_pass(spark):
    from tidegauge.plans.pipeline import next_defaults

    _, batch, starts = ragged(seed=3, cells=10)
    other = Batch(batch.of, batch.sigma, batch.y, batch.x, batch.w, batch.on, batch.ey, batch.ex, batch.sv, batch.gv, batch.prior, batch.lam, printed=True)
    assert not np.allclose(batch.fit(starts)[2], other.fit(starts)[2])
    assert np.allclose(other.take(np.arange(10) < 4).fit(starts[:4])[2], other.fit(starts)[2][:4])
    fits = spark.createDataFrame([(2.0, 0.5), (3.0, 0.7), (9.0, None)], "sigma double, gamma double")
    cfg = next_defaults(fits, Config())
    assert (cfg.sigma_start, cfg.gamma_start) == (3.0, 0.6) and next_defaults(fits.limit(0), Config()) == Config()
