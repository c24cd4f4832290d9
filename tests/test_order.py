"""Exact order statistics of groups against DuckDB and numpy."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.functions import order
from tidegauge.operators import census as N


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = []
    for i in range(20_000):
        hot = i % 10 > 0
        data.append(("hot" if hot else rng.choice([None, "a", "b", "c", "none"]), rng.choice([0.0, 1.5]) if i % 3 else rng.gauss(0, 1), rng.random() if i % 4 else None, float(rng.randint(0, 3))))
    data = [(k, None if k == "none" else x, float("nan") if i % 97 == 0 else y, w) for i, (k, x, y, w) in enumerate(data)]
    return data, spark.createDataFrame(data, "k string, x double, y double, w double").repartition(7)


def test_quantiles_by_group_equal_duckdb(spark, rows, monkeypatch):
    data, df = rows
    monkeypatch.setattr(order, "ROWS", 1000)
    got = {r.k: (r.x, r.y) for r in order.quantiles_by(df, ["k"], {"x": F.col("x"), "y": F.col("y")}, [0.25, 0.5, 0.9]).collect()}
    con = duckdb.connect()
    con.register("t", df.toPandas())
    want = con.execute("SELECT k, quantile_cont(x, [0.25, 0.5, 0.9]) FILTER (WHERE x IS NOT NULL AND NOT isnan(x)), quantile_cont(y, [0.25, 0.5, 0.9]) FILTER (WHERE y IS NOT NULL AND NOT isnan(y)) FROM t GROUP BY k").fetchall()
    assert {k for k, *_ in want} == set(got)
    for k, x, y in want:
        assert got[k][0] == (None if x is None else pytest.approx(x, abs=1e-12)) and got[k][1] == pytest.approx(y, abs=1e-12)


def test_hot_group_and_ties_are_split(spark, rows, monkeypatch):
    """Nine rows in ten are one group and a third of them one value; no partition holds much more than its share."""
    _, df = rows
    monkeypatch.setattr(order, "ROWS", 1000)
    dealt = order._dealt(df.filter("x is not null and not isnan(x)").select("k", F.col("x").alias("__v")), ["k"])
    sizes = [r["count"] for r in dealt.groupBy(F.shiftright("__at", 33)).count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 3 * sum(sizes) / len(sizes)


def test_quantiles_of_no_groups_and_no_rows(spark, rows):
    data, df = rows
    one = order.quantiles(df, [], {"m": (F.col("x"), 0.5), "q": (F.col("y"), 0.1)}).collect()
    x = [x for _, x, _, _ in data if x is not None]
    assert len(one) == 1 and one[0].m == pytest.approx(np.median(x))
    assert [tuple(r) for r in order.quantiles(df.limit(0), [], {"m": (F.col("x"), 0.5)}).collect()] == [(None,)]
    assert order.quantiles(df.limit(0), ["k"], {"m": (F.col("x"), 0.5)}).count() == 0
    away = {r.k: r.d for r in order.mads_by(df, ["k"], "x", "d").collect()}
    for k in ("hot", None, "a"):
        mine = np.array([x for g, x, _, _ in data if g == k])
        assert away[k] == pytest.approx(np.median(np.abs(mine - np.median(mine))))


def weighted_rank(x, w):
    return np.array([w[x < v].sum() + w[x == v].sum() / 2 for v in x])


def test_weighted_ranks_quantiles_and_correlation(spark, rows):
    data, df = rows
    some = df.filter("k in ('a', 'b')")
    kept = np.array([(x, y, w) for k, x, y, w in data if k in ("a", "b") and w > 0 and y is not None and not np.isnan(y)])
    ra, rb = weighted_rank(kept[:, 0], kept[:, 2]), weighted_rank(kept[:, 1], kept[:, 2])
    c = np.cov(ra, rb, aweights=kept[:, 2], bias=True)
    got = order.weighted_spearman(some, "x", "y", "w").first()
    assert got.n == len(kept) and got.spearman == pytest.approx(c[0, 1] / np.sqrt(c[0, 0] * c[1, 1]), abs=1e-12)
    ranks = {(r.x, r.y): r.r for r in order.weighted_ranks(some.filter("y is not null and not isnan(y)"), "x", "w", "r").collect()}
    assert all(ranks[a, b] == pytest.approx(r) for (a, b, _), r in zip(kept, ra, strict=True))
    byx = kept[np.argsort(kept[:, 0])]
    held = np.cumsum(byx[:, 2])
    want = [byx[np.searchsorted(held, p * held[-1] * (1 - 1e-12)), 0] for p in (0.25, 0.5)]
    assert order.weighted_quantiles(some.filter("y is not null and not isnan(y)"), "x", "w", [0.25, 0.5]) == want
    assert order.weighted_quantiles(some.limit(0), "x", "w", [0.5]) == [None]


def test_targets_equal_trimming_one_by_one():
    rng = random.Random(0)
    for _ in range(300):
        sizes = {f"s{i:02d}": rng.randint(0, 60) for i in range(rng.randint(1, 9))}
        total, floor = rng.randint(0, 120), rng.randint(0, 12)
        every = sum(sizes.values())
        want = {k: min(n, max(floor, round(total * n / every))) for k, n in sizes.items()} if every else {}
        while sum(want.values()) > total:
            top = max(want.values())
            want[min(k for k in want if want[k] == top)] -= 1
        assert N.targets(sizes, total, floor) == want
