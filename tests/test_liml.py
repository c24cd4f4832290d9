"""The k-class estimator in column expressions against the numpy one."""

import numpy as np
import pandas as pd
import pytest

from tests.test_fits import simulate
from tidegauge.operators import liml as L
from tidegauge.plans import cell_fit as K


@pytest.fixture(scope="module")
def cells(spark):
    parts = []
    for c in range(12):
        rng = np.random.default_rng(c)
        y, x1, x2, of = simulate(rng, rng.uniform(1.5, 5), rng.uniform(0.2, 2), groups=5 + c, years=12)[:4]
        parts.append(pd.DataFrame({"importer": c, "good": "g", "exporter": of, "t": np.arange(len(y)), "y": y, "x1": x1, "x2": x2}))
    two = parts[0][parts[0].exporter < 2].assign(importer=100)  # too few exporters
    few = parts[0].groupby("exporter").head(1).head(4).assign(importer=101)  # too few rows
    flat = parts[1].assign(importer=102, x2=parts[1].x1 * 2)  # collinear
    every = pd.concat([*parts, two, few, flat])
    return every, spark.createDataFrame(every.astype({"importer": int, "exporter": int}))


def weights(c, f, g):
    u2 = f["u"] ** 2
    spread = np.maximum(np.bincount(g.of, u2) / g.n, max(1e-10, 0.01 * u2[u2 > 0].min()))
    return (1 / spread) * len(c) / ((1 / spread) @ g.n)


def test_steps_equal_the_numpy_estimator(cells):
    rows, df = cells
    one, two = ({r.importer: r for r in f(df).collect()} for f in (L.step_one, L.step_two))
    for c in range(12):
        mine = rows[rows.importer == c]
        g = K.Groups(*(mine[x].to_numpy() for x in L.V), mine.exporter.to_numpy())
        f = K.fuller(g, np.ones(g.l))
        for found, w in ((one[c], np.ones(g.l)), (two[c], weights(mine, f, g))):
            f = K.fuller(g, w)
            q = np.r_[1, -f["eta"]]
            got = (found.lambda_min, found.kappa, found.eta1, found.eta2, found.eta0, found.fstat, found.jstat)
            want = (f["lambda"], f["kappa"], *f["eta"], K.weak_f(g, f["t"], f["b"]), q @ f["b"] @ q / (q @ f["t"] @ q) * len(mine))
            assert got == pytest.approx(want, rel=1e-8)
        assert (two[c].v11, two[c].v12, two[c].v22) == pytest.approx((f["v"][0, 0], f["v"][0, 1], f["v"][1, 1]), rel=1e-7)
        assert 0 <= two[c].jstat_pval <= 1


def test_cells_without_an_estimate_have_nulls(cells, spark):
    _, df = cells
    found = {r.importer: r for r in L.step_one(df).filter("kappa is null").collect()}
    assert set(found) == {100, 101, 102} and found[102].eta1 is None and found[102].fstat is None
    assert {r.importer for r in L.step_two(df).collect()} == set(range(12))
    assert L.step_one(df.limit(0)).count() == 0 and L.step_two(df.limit(0)).count() == 0


def test_least_root_near_a_double_root(spark):
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    pairs = [(a, b) for i, a in enumerate(L.V) for b in L.V[i:]]
    rows, want = [], []
    for gap in (0.0, 1e-9, 1e-6, 1e-2, 1.0):
        w = q @ np.diag([1.0, 2.0, 3.0]) @ q.T
        root = np.linalg.cholesky(w)
        a = root @ q @ np.diag([1.2, 1.2 + gap, 50.0]) @ q.T @ root.T
        rows.append([float(m[L.V.index(x), L.V.index(y)]) for m in (w, a) for x, y in pairs])
        want.append(1.2)
    df = spark.createDataFrame(rows, [f"{p}_{x}_{y}" for p in ("w", "a") for x, y in pairs]).coalesce(1)
    assert [r.low for r in L.least_root(df, "w", "a", "low").select("low").collect()] == pytest.approx(want, rel=1e-7)
