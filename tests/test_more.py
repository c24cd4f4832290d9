"""Operators without SQL, against brute force on small inputs."""

import collections
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.one_cell import Stage2
from tests.test_fits import cell, simulate
from tests.test_pipeline import FLOW, synthetic
from tidegauge.functions import columns as X
from tidegauge.functions import keep
from tidegauge.operators import census as N
from tidegauge.operators import feenstra as H
from tidegauge.operators import moments as M
from tidegauge.operators import reports as R
from tidegauge.operators import summary as S
from tidegauge.operators.panel import Config, prepare, raw_panel
from tidegauge.plans import bootstrap as B
from tidegauge.plans import cell_fit as K
from tidegauge.plans import pipeline as P
from tidegauge.plans import stage1 as S1
from tidegauge.plans import stage2 as S2
from tidegauge.sources import trade as T


def test_quantiles_and_ranks_are_exact(spark):
    rng = random.Random(1)
    values = [rng.choice([rng.random(), float(rng.randint(0, 5))]) for _ in range(997)] + [None, None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(7)
    known = np.array([v for v in values if v is not None and v == v])
    shares = [0.0, 0.005, 0.25, 0.5, 0.9, 1.0]
    assert np.allclose(keep.quantiles(df, "x", shares), np.quantile(known, shares))
    assert keep.quantiles(df.filter("x is null"), "x", [0.5]) == [None]
    ranks = {r.x: r.k for r in keep.average_ranks(df, "x", "k").collect()}
    assert ranks == pd.Series(known, index=known).rank().groupby(level=0).first().to_dict()


def dense_value(c, gk, gj, sigma, lam, prior):
    """The objective of one cell written out term by term."""
    s, out = sigma - 1, 0.0
    for i, g in enumerate(gj):
        x = [c[f"imp_x{k}"][i] for k in range(1, 6)]
        fit = g / (1 + g) / s * x[0] + g / (1 + g) * x[1] - x[2] / s + g * (1 + gk) / (gk * (1 + g) * s) * x[3] + (g - gk) / ((1 + g) * gk) * x[4]
        out += c["weight"][i] * (c["imp_y"][i] - fit) ** 2
        if c["tier"][i] == 1 and c["exp_y"][i] == c["exp_y"][i]:
            e, sv, v = [c[f"exp_x{k}"][i] for k in range(1, 10)], c["sv"][i], c["gv"][i]
            fit = (
                g / ((1 + g) * s) * e[0] + (g * (sigma - 2) - 1) / ((1 + g) * s) * e[1] + v / ((1 + v) * s) * e[2] + (1 - v * (sigma - 2)) / ((1 + v) * s) * e[3] - (1 - v * (sv - 2)) / ((1 + v) * s) * e[4]
                - (g * (sv - 2) - 1) / ((1 + g) * s) * e[5] - (v * (1 + g) + g * (1 + v)) / ((1 + g) * (1 + v) * s) * e[6] + (sigma - sv) / s * (e[7] - e[8])
            )
            out += c["weight"][i] * (c["exp_y"][i] - fit) ** 2
    return out + lam * sum((math.log(g) - prior) ** 2 for g in [gk, *gj])


def stage2_inputs(spark, cfg):
    panel = prepare(raw_panel(synthetic(spark, exporters=6), cfg), cfg)
    keys = panel.select("importer", "good").distinct()
    sigma = keys.withColumn("sigma", F.lit(3.0))
    priors = keys.select("good").distinct().withColumn("ln_gamma_prior", F.lit(-0.5))
    return S2.cell_inputs(panel, cfg, sigma, 2.88, priors, keys.withColumn("gamma", F.lit(0.8)), 0.69, None, 0.69), panel


def test_fixed_sigma_and_joint_fits_are_minima(spark):
    cfg = Config(minyear=2003)
    inputs, _ = stage2_inputs(spark, cfg)
    rows = inputs.toPandas()
    for gradient in ("analytic", "numeric"):
        got = S2.solve_cells(inputs, 0.1, gradient).toPandas()
        for (imp, good), fit in got.groupby(["importer", "good"]):
            c = rows[(rows.importer == imp) & (rows.good == good) & (rows.tier < 3)].sort_values(["tier", "exporter"]).to_dict("list")
            gk = fit[fit.tier == 0].gamma.iloc[0]
            gj = [fit[fit.exporter == e].gamma.iloc[0] for e in c["exporter"]]
            value = dense_value(c, gk, gj, 3.0, 0.1, -0.5)
            assert math.isclose(value, fit.obj_value.iloc[0], rel_tol=1e-9) and (fit.convergence == 0).all()
            point = [gk, *gj]
            for i in range(len(point)):
                for step in (0.97, 1.03):
                    moved = [g * step if j == i else g for j, g in enumerate(point)]
                    assert dense_value(c, moved[0], moved[1:], 3.0, 0.1, -0.5) > value
    both = S2.solve_joint(inputs).toPandas()
    for (imp, good), fit in both.groupby(["importer", "good"]):
        c = rows[(rows.importer == imp) & (rows.good == good)].sort_values(["tier", "exporter"]).to_dict("list")
        c["weight"], c["tier"] = [1.0] * len(c["weight"]), [1] * len(c["weight"])
        ref = fit.ref_exporter.iloc[0]
        gk, gj, sigma = fit[fit.exporter == ref].gamma.iloc[0], [fit[fit.exporter == e].gamma.iloc[0] for e in c["exporter"]], fit.sigma.iloc[0]
        value = dense_value(c, gk, gj, sigma, 0.0, 0.0)
        assert math.isclose(value, fit.obj_value.iloc[0], rel_tol=1e-9)
        if 1.01 < sigma < 150:
            assert all(dense_value(c, gk, gj, 1 + (sigma - 1) * step, 0.0, 0.0) > value * (1 - 1e-7) for step in (0.97, 1.03))


def test_a_fit_that_cannot_go_on_is_not_called_converged():
    y = np.array([1.0, 2.0])
    p = Stage2(3.0, y, np.ones((2, 5)), np.ones(2), np.zeros(0), np.zeros((0, 9)), np.zeros(0, int), np.zeros(0), np.zeros(0), float("nan"), 0.0)
    p.value = lambda gk, gj, first=[]: first.append(1) or float(len(first))  # noqa: B006  every step looks worse
    assert p.fit(0.7)[3] == 52


def test_numeric_estimates_agree_with_the_closed_form_and_route():
    agreed = 0
    for seed in range(20):
        rng = np.random.default_rng(seed)
        rows = simulate(rng, rng.uniform(1.5, 5), rng.uniform(0.2, 2), groups=10, years=14)[:4]
        closed, both, bfgs = (K.fit_cell(*rows, method=m) for m in ("closed", "both", "bfgs"))
        if closed.get("hliml_cf_admissible") and both["hliml_status"] == "ok":
            agreed += 1
            assert math.isclose(closed["sigma"], both["sigma_hliml"], rel_tol=1e-3) and both["hliml_Q"] >= closed["hliml_Q"] - 1e-10
        assert both.get("sigma") == bfgs.get("sigma") and "sigma_hliml_cf" not in bfgs and both["hliml_method"] == "both"
        assert bfgs.get("final_source") != "hliml_boundary"
    assert agreed >= 12


def test_edges_are_the_best_of_a_fine_grid():
    y, x1, x2, of = cell(np.random.default_rng(5))
    g = K.Groups(y, x1, x2, of)
    order = [0, 3, 1, 2]
    t, b = g.a.sum(0)[np.ix_(order, order)], (g.between - g.a / g.n[:, None, None]).sum(0)[np.ix_(order, order)]
    best = K.boundary(t, b)
    line = np.linspace(1e-4, 10, 4001)
    for sigma, omega in ((1 + 1e-6 + 0 * line, line), (10 + 0 * line, line), (np.maximum(line, 1 + 1e-6), 1e-4 + 0 * line), (np.maximum(line, 1 + 1e-6), 10 + 0 * line)):
        assert best["Q"] <= K.profiled(t, b, sigma, omega).min() + 1e-9
    # the profile is the least over the constant
    s, o = np.array([2.5]), np.array([0.7])
    d = 1.7 * 1.5
    q = lambda c: (v := np.r_[1, -c, -0.7 / d, -(0.7 * 0.5 - 1) / d]) @ b @ v / (v @ t @ v)
    assert math.isclose(K.profiled(t, b, s, o)[0], min(q(c) for c in np.linspace(-5, 5, 200_001)), rel_tol=1e-6)


def test_stage2b_inputs_take_every_tier_and_slopes_need_an_error(spark):
    rows = [("R", "a", "0101", 0.5, 2.0, 1), ("R", "b", "0101", 4.0, 2.0, 3), ("R", "c", "0101", 1.0, 0.9, 3), ("R", "d", "0101", -1.0, 2.0, 1), ("R", "e", "0101", 9.0, None, 1)]
    df = spark.createDataFrame(rows, "importer string, exporter string, good string, gamma double, sigma double, tier int")
    assert S2.regional_gamma(df).first().gamma == 1.0 and S2.regional_starts(df).first().gamma == 2.25
    assert math.isclose(S2.regional_priors(df).first().ln_gamma_prior, 0.0, abs_tol=1e-12)
    fits = spark.createDataFrame([("1", "x", "g", 3.0, 1, 0.1, "ok", 0.4), ("2", "x", "g", 3.0, 1, 0.1, "ok", 0.4)], "importer string, exporter string, good string, sigma double, tier int, gamma_se double, gamma_se_status string, dgamma_dsigma double")
    se = spark.createDataFrame([("1", "g", 0.2, 0), ("2", "g", None, 0)], "importer string, good string, sigma_se double, adjust int")
    got = {r.importer: r for r in S2.with_sigma_errors(fits, se).collect()}
    assert got["1"].dgamma_dsigma == 0.4 and got["2"].dgamma_dsigma is None
    assert all(r.dgamma_dsigma is None for r in S2.with_sigma_errors(fits, None).collect())


def test_thin_cells_say_what_stopped_them_and_diagnostics_can_be_redone(spark):
    full = synthetic(spark, years=10, exporters=5)
    two = full.filter("importer = 840 and good = '850100' and exporter < 102 and year < 2007").withColumn("importer", F.lit(1))
    one = full.filter("importer = 840 and exporter = 100").withColumn("importer", F.lit(2))
    cfg = Config(minyear=2003)
    out = S1.run_stage1(raw_panel(full.union(two).union(one), cfg), cfg).persist()
    got = {(r.importer, r.good): r for r in out.collect()}
    assert got[1, "8501"].status == "prep_thin_n3" and got[1, "8501"].n_obs == 8 and got[1, "8501"].sigma is None
    assert got[2, "8501"].status == "thin_panel_e1_t10" and got[2, "8501"].n_exporters == 1
    again = {(r.importer, r.good): r for r in S1.recompute_diagnostics(out).collect()}
    assert again == got
    alone = S1.estimate_elasticities(full.filter("importer = 840 and good = '850100'").selectExpr("exporter as e", "year as y", "cusval as v", "quantity as q"), "e", "y", "v", "q").first()
    assert alone.status == got[840, "8501"].status and math.isclose(alone.kappa, got[840, "8501"].kappa)


def test_baseline_is_the_least_of_its_objective(spark):
    rng = np.random.default_rng(3)
    rows = []
    for imp in range(30):
        for e in range(8):
            x1, x2, extra = abs(rng.normal(1, 0.4)), rng.normal(0.2, 0.5), rng.normal(0, 0.3)
            a, g = rng.uniform(0.05, 2), rng.uniform(-0.2, 1.1)
            rows.append((str(imp), "0101", str(e), "r", a * g * x1 + (g - a) * x2 + rng.normal(0, 0.3), x1, x2, x2 + extra, extra, 0.0, float(rng.uniform(0.5, 2))))
    df = spark.createDataFrame(rows, "importer string, good string, exporter string, ref_exporter string, imp_y double, imp_x1 double, imp_x2 double, imp_x3 double, imp_x4 double, imp_x5 double, weight double")
    edges = collections.Counter()
    for r in H.fit(df).collect():
        x = np.array([t[4:] for t in rows if t[0] == r.importer])

        def value(a, g, x=x):
            return float((x[:, 6] * (x[:, 0] - a * g * x[:, 1] - g * x[:, 2] + a * x[:, 3] - a * x[:, 4]) ** 2).sum())

        a, g = 1 / (r.sigma - 1), r.gamma / (1 + r.gamma)
        assert math.isclose(value(a, g), r.obj_value, rel_tol=1e-6, abs_tol=1e-9)
        grid = min(value(p, q) for p in np.geomspace(1e-3, 50, 120) for q in np.linspace(1e-6, 1 - 1e-6, 60))
        assert r.obj_value <= grid * (1 + 1e-6)
        edges[r.edge] += 1
    assert edges["none"] and len(edges) >= 2
    cfg = Config(minyear=2003)
    assert H.baseline(prepare(raw_panel(synthetic(spark), cfg), cfg), cfg).filter("sigma > 1 and gamma > 0").count() == 8


def test_bootstrap_replicates_are_cells_of_their_own(spark):
    cfg = Config(minyear=2003)
    panel = raw_panel(synthetic(spark, years=10, exporters=7), cfg)
    cells = panel.select("importer", "good").distinct().filter("importer > 300")
    drawn = B.draws(panel, cells, 6).toPandas()
    assert (drawn.groupby(["importer", "good", "b"]).size() == 7).all() and drawn[drawn.b == 0].groupby(["importer", "good"]).exporter.nunique().eq(7).all()
    assert drawn[drawn.b > 0].groupby(["importer", "good", "b"]).exporter.nunique().lt(7).any()
    out = {(r.importer, r.good): r for r in B.bootstrap(panel, cells, 6, 3).collect()}
    fits = {(r.importer, r.good): r for r in S1.fit_cells(M.stage1_moments(panel)).collect()}
    for k, r in out.items():
        assert r.sigma_base is None if fits[k].status != "ok" else math.isclose(r.sigma_base, fits[k].sigma, rel_tol=1e-5), (k, r, fits[k])
        assert 0 <= r.boot_n_ok <= 6 and (r.boot_sd is None) == (r.boot_n_ok < 3) and r.boot_yield == r.boot_n_ok / 6
    again = {(r.importer, r.good): r for r in B.bootstrap(panel, cells, 6, 3).collect()}
    assert all(again[k].boot_med == r.boot_med or math.isclose(again[k].boot_med, r.boot_med, rel_tol=1e-5) for k, r in out.items())


def test_samples_by_stratum(spark):
    assert N.targets({"a": 100, "b": 5, "c": 1000}, 60) == {"a": 10, "b": 5, "c": 45}
    assert N.targets({}, 60) == {}
    cells = spark.createDataFrame([(i, "g", "abc"[i % 3]) for i in range(300)], "importer int, good string, stratum string")
    got = collections.Counter(r.stratum for r in N.stratified_sample(cells, 45).collect())
    assert got == {"a": 15, "b": 15, "c": 15}
    a, b = (sorted(map(tuple, N.stratified_sample(df, 45).collect())) for df in (cells, cells.repartition(5)))
    assert a == b and N.cell_subset(cells, 7).count() == 7 and N.stratified_sample(cells.limit(0), 5).count() == 0


def test_trade_sources(spark, tmp_path):
    folder = tmp_path / "HS92.v2"
    folder.mkdir()
    (folder / "BACI_HS92_Y2003_V2026.csv").write_text("t,i,j,k,v,q\n2003,1,2,010101,5.0,2.0\n")
    assert T.read_trade(spark, str(folder)).count() == 1
    (tmp_path / "x.xlsx").write_text("no")
    with pytest.raises(ValueError):
        T.read_trade(spark, str(tmp_path / "x.xlsx"))
    stata = pd.DataFrame({"t": [2003, 2004], "k": ["010101", "020202"], "v": [1.5, 2.5]})
    stata.to_stata(tmp_path / "x.dta", write_index=False)
    assert [tuple(r) for r in T.read_trade(spark, str(tmp_path / "x.dta")).orderBy("t").collect()] == [(2003.0, "010101", 1.5), (2004.0, "020202", 2.5)]
    (tmp_path / "regions.csv").write_text("cty_code,region\n1,ZZ\n2,B\n1,AA\n")
    assert {r.cty_code: r.region for r in T.region_map(spark, str(tmp_path / "regions.csv")).collect()} == {1: "ZZ", 2: "B"}
    named = spark.createDataFrame([(2003, "010101", 1, 2, 3.0, 4.0)], "yr int, hs6 string, iiso int, eiso int, value double, qty double")
    assert T.identify(named).columns == ["year", "good", "importer", "exporter", "cusval", "quantity"]
    with pytest.raises(ValueError):
        T.identify(named.drop("qty"))


def test_summary_files_hold_whole_tables(spark, tmp_path):
    est = spark.createDataFrame([(str(i % 1500), str(i), "0101", 2.0 + i % 7, 0.1 * (i % 9) - 0.2, i % 4, 0.5) for i in range(6000)], "importer string, exporter string, good string, sigma double, gamma double, tier int, opt_tariff double")
    tables = S.build(est, Config(), "x/HS92_V202601", before=est)
    S.write(tables, str(tmp_path / "run"))
    lines = [r.value for r in spark.read.text(f"{tmp_path}/run_summary_text").collect()]
    assert sum(x.startswith("importer=") for x in lines) == 1501
    assert spark.read.json(f"{tmp_path}/run_global_json").first().n_estimates == 6000
    assert tables["step_comparison"].first().n_matched == 6000 and '"n_estimates": 6000' in S.as_json(tables["global"])


def test_settings_are_part_of_a_stage_table(spark, tmp_path):
    trade = synthetic(spark, years=8, exporters=5)
    regions = T.region_map(spark, rows=[(840, "AM")])
    a = P.estimate(trade, regions, str(tmp_path), Config(minyear=2003, stage1_hliml="closed"), "1")["stage1"]
    b = P.estimate(trade, regions, str(tmp_path), Config(minyear=2003, stage1_hliml="both"), "1")["stage1"]
    assert {r.hliml_method for r in a.collect()} == {"closed"} and {r.hliml_method for r in b.collect()} == {"both"}
    o = P.parser().parse_args(["--data", "x", "--stage1-hliml", "bfgs", "--stage2-gradient", "numeric"])
    assert (o.stage1_hliml, o.stage2_gradient) == ("bfgs", "numeric")
    with pytest.raises(ValueError):
        Config(stage1_hliml="newton")
    assert R.pass_rates(b).first().n_ok >= 0 and X.pad_hs6 and FLOW
