"""Logistic regression, propensity weights and filter tiers against dense numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.functions import logit
from tidegauge.operators import selection as L


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    data = []
    for _ in range(3000):
        f, g, x = rng.choice("abcd"), rng.choice(["u", "v", None] if rng.random() < 0.02 else ["u", "v"]), rng.gauss(2, 1.5)
        p = 1 / (1 + math.exp(-(-0.8 + {"a": 0, "b": 0.7, "c": -0.4, "d": 1.2}[f] + (0.5 if g == "v" else 0) + 0.3 * x)))
        data.append((rng.random() < p, f, g, x))
    return data, spark.createDataFrame(data, "y boolean, f string, g string, x double").repartition(5)


def dense(data):
    used = [r for r in data if r[2] is not None]
    x = np.array([[1, f == "b", f == "c", f == "d", g == "v", v] for _, f, g, v in used], float)
    y = np.array([r[0] for r in used], float)
    beta = np.zeros(6)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
    p = 1 / (1 + np.exp(-x @ beta))
    null = y.mean()
    return beta, p, y, 1 - (y * np.log(p) + (1 - y) * np.log(1 - p)).sum() / (y * np.log(null) + (1 - y) * np.log(1 - null)).sum()


def test_logit_equals_dense_fit(spark, rows):
    data, df = rows
    m = logit.fit(df, "y", ["f", "g"], ["x"])
    beta, p, _, r2 = dense(data)
    assert m.terms == [("intercept", None), ("f", "b"), ("f", "c"), ("f", "d"), ("g", "v"), ("x", None)]
    assert m.beta == pytest.approx(beta, abs=1e-7) and m.mcfadden == pytest.approx(r2, abs=1e-10) and m.n == len(p)
    total = df.filter("g is not null").agg(F.sum(m.probability())).first()[0]
    assert total == pytest.approx(p.sum(), rel=1e-7)


def test_logit_of_one_class_and_of_nothing(spark, rows):
    _, df = rows
    assert math.isfinite(logit.fit(df.filter("y"), "y", ["f"], [], rounds=5).beta[0])
    assert logit.fit(df.limit(0), "y", ["f"], ["x"]).n == 0


def test_weights_are_cut_and_scaled(spark, rows):
    data, df = rows
    out, _ = L.inverse_propensity(df, "y", ["f", "g"], ["x"], 0.9)
    _, p, y, _ = dense(data)
    w = 1 / p[y > 0]
    w = np.minimum(w, np.quantile(w, 0.9))
    got = np.sort([r.ipw for r in out.select("ipw").collect()])
    assert got == pytest.approx(np.sort(w * len(w) / w.sum()), rel=1e-6)


def test_ridge_analysis_removes_selection_on_what_is_seen(spark):
    """Sigma rises with trade, and so does the chance of the main estimator: weights bring its median back."""
    rng = random.Random(1)
    rows = []
    for i in range(4000):
        t = rng.gauss(0, 1)
        main = rng.random() < 1 / (1 + math.exp(-1.5 * t))
        rows.append((i % 40, i, rng.choice(["0101", "3903", "8501"]), 3 + t + rng.gauss(0, 0.1), 1 + rng.random(), 0.1, "ok", 6, "hliml" if main else "step2_weighted", 0 if main else 1, math.exp(t), rng.choice(["R1", "R2"])))
    df = spark.createDataFrame(rows, "importer int, exporter int, good string, sigma double, gamma double, gamma_se double, gamma_se_status string, gamma_exposure int, final_source string, adjust int, avg_trade double, region string")
    got = {r["sample"]: r for r in L.ridge_analysis(df, cap=1.0).collect()}
    assert got["strict"].n == 4000 and got["main"].n == got["main_weighted"].n == sum(r[8] == "hliml" for r in rows)
    assert got["main"].sigma_p50 - got["strict"].sigma_p50 > 0.25
    assert abs(got["main_weighted"].sigma_p50 - got["strict"].sigma_p50) < 0.15 and 0.1 < got["main"].mcfadden < 0.6


def test_sections_and_tiers(spark):
    df = spark.createDataFrame([("0101",), ("0600",), ("1500",), ("7100",), ("7700",), ("9701",), ("98",), ("xx",), (None,)], "good string")
    assert [r[0] for r in df.select(logit.hs_section(F.col("good"))).collect()] == [1, 2, 3, 14, 15, 21, None, None, None]
    est = spark.createDataFrame([(2.0, 1.0, 0.1, "ok", "hliml", 0, 7), (2.0, 1.0, 0.1, "ok", "hliml", 0, 2), (2.0, 1.0, 0.1, "ok", "step2_weighted", 1, 9), (2.0, 1.0, 0.6, "ok", "hliml", 0, 9), (2.0, 1.0, None, None, None, None, None)],
                                "sigma double, gamma double, gamma_se double, gamma_se_status string, final_source string, adjust int, gamma_exposure int")
    assert {r.cv_tier: r.n for r in L.cv_tiers(est).collect()} == {1: 5, 2: 3, 3: 2, 4: 1}


def test_ridge_analysis_tests_estimates_not_the_rows_they_are_made_of(spark, monkeypatch):
    """Estimates may be aggregates of trade: what they are filtered by is worked out once an estimate, after them."""
    trade = spark.range(400).select((F.col("id") % 40).cast("int").alias("importer"), (F.col("id") % 7).cast("int").alias("exporter"), (F.col("id") + 1.0).alias("cusval"))
    est = trade.groupBy("importer", "exporter").agg(F.avg("cusval").alias("avg_trade")).withColumns({
        "good": F.when(F.col("importer") % 2 == 0, "0101").otherwise("8501"), "sigma": 1 + F.col("importer") / 8, "gamma": 1 + F.col("exporter") / 4, "gamma_se": F.lit(0.1), "gamma_se_status": F.lit("ok"), "gamma_exposure": F.lit(6),
        "final_source": F.when((F.col("importer") + F.col("exporter")) % 3 == 0, "hliml").otherwise("step2_weighted"), "adjust": F.when((F.col("importer") + F.col("exporter")) % 3 == 0, 0).otherwise(1), "region": F.lit("R1"),
    })
    plans, kept = [], L.keep.kept
    monkeypatch.setattr(L.keep, "kept", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df))
    got = {r["sample"]: r.n for r in L.ridge_analysis(est).collect()}
    assert got["strict"] == est.count()
    made = [p for p in plans if "Range (0, 400" in p]
    assert len(made) == 1 and "Filter" not in made[0]
