import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions import columns as X
from tidegauge.operators import moments as M
from tidegauge.operators import panel as P
from tidegauge.plans.pipeline import parser
from tidegauge.sources import trade as S

FLOW = "year int, good string, importer int, exporter int, cusval double, quantity double"


def test_differences_skip_gaps(spark):
    flows = [(156, y, v, q) for y, v, q in ((2015, 100, 10), (2016, 110, 11), (2017, 120, 12))] + [(410, y, v, q) for y, v, q in ((2015, 200, 20), (2016, 190, 19), (2019, 170, 18), (2020, 180, 17))]
    df = spark.createDataFrame([(y, "850100", 840, e, float(v), float(q)) for e, y, v, q in flows], FLOW)
    out = P.prepare(P.raw_panel(df, P.Config(minyear=2015)), P.Config(minyear=2015, uv_outlier=None))
    kept = {(r.exporter, r.t) for r in out.collect()}
    assert kept == {("156", 2), ("156", 3), ("410", 2), ("410", 6)}
    assert {r.period_count for r in out.filter("exporter = '410'").collect()} == {4}


def test_calendar_and_positional_lag(spark):
    df = spark.createDataFrame([("a", t, float(10 * t)) for t in (2, 3, 5, 6)], "k string, t int, v double")
    rows = df.select("t", X.calendar_lag("v", ["k"]).alias("c"), X.positional_lag("v", ["k"]).alias("p")).orderBy("t").collect()
    assert [(r.c, r.p) for r in rows] == [(None, None), (20.0, 20.0), (None, 30.0), (50.0, 50.0)]


def test_bw_weight_without_lag_is_one(spark):
    w = lambda lag: spark.range(1).select(X.bw_weight(F.lit(700.0), F.lit(lag).cast("double"), F.lit(4)).alias("w")).first().w
    assert w(None) == 1.0
    assert math.isclose(w(600.0), 4**1.5 / math.sqrt(1 / 700 + 1 / 600))


def test_codes(spark):
    df = spark.createDataFrame([("101",), ("010121",), ("1234567",), ("x1",)], "k string")
    assert [r[0] for r in df.select(X.pad_hs6(F.col("k"))).collect()] == ["000101", "010121", "1234567", None]


def test_inversion(spark):
    def forward(sigma, rho):
        return rho / ((sigma - 1) ** 2 * (1 - rho)), (2 * rho - 1) / ((sigma - 1) * (1 - rho))

    cases = [(s, r) for s in (2.0, 3.0, 5.0, 8.0) for r in (0.1, 0.3, 0.4, 0.6, 0.7)]
    df = spark.createDataFrame([(i, *map(float, forward(s, r))) for i, (s, r) in enumerate(cases)], "i int, a double, b double")
    for row in X.invert_structural(df, "a", "b").collect():
        s, r = cases[row.i]
        assert math.isclose(row.sigma, s, rel_tol=1e-9) and math.isclose(row.rho, r, rel_tol=1e-9)
        assert row.status == ("ok" if r < (s - 1) / s else "constraint_violated")
    edge = spark.createDataFrame([(10.0, 100.0), (0.1154, -0.2692), (-1.0, 1.0), (1.0, 0.0), (None, 1.0), (float("nan"), 1.0)], "a double, b double")
    got = [(r.status, r.omega) for r in X.invert_structural(edge, "a", "b").collect()]
    assert got[0] == ("constraint_violated", 1e-4) and got[1][0] == "ok" and got[1][1] > 1e-4
    assert [g[0] for g in got[2:]] == ["eta1_nonpositive", "sigma_below_1", "non_finite_eta", "non_finite_eta"]


def test_chi2_tail(spark):
    known = [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (7.814727903251179, 3, 0.05), (18.307038053275146, 10, 0.05), (37.65248413348277, 25, 0.05)]
    df = spark.createDataFrame(known, "x double, d int, p double")
    assert all(abs(r.s - r.p) < 1e-6 for r in df.select("p", X.chi2_sf(F.col("x"), F.col("d")).alias("s")).collect())
    assert spark.range(1).select(X.chi2_sf(F.lit(1.0), F.lit(0)).alias("s")).first().s is None


def test_boundary_flags(spark):
    rows = [("sigma_cap", 10.0, 3.0), ("omega_cap", 3.0, 10.0), (None, 9.9995, 1.0), (None, 9.99, 10 - 1e-6), (None, None, None)]
    df = spark.createDataFrame(rows, "e string, s double, o double")
    a, b = X.boundary_flags(F.col("e"), F.col("s"), F.col("o"), 10.0, 10.0)
    assert [tuple(r) for r in df.select(a, b).collect()] == [(True, False), (False, True), (True, False), (False, True), (False, False)]


def test_reference_prefers_periods_then_value_then_code(spark):
    rows = [(1, "g", e, t, v) for e, t, v in ((5, 1, 9.0), (5, 2, 9.0), (3, 1, 9.0), (3, 2, 9.0), (7, 1, 99.0))]
    df = spark.createDataFrame(rows, "importer int, good string, exporter int, t int, cusval double")
    assert M.choose_reference(df).first().ref_exporter == 3
    assert {r.ref_exporter for r in M.with_reference(df).collect()} == {3}


def test_regions(spark):
    df = spark.createDataFrame([(2000, "0101", i, e, 1.0, 1.0) for i, e in ((1, 2), (1, 3), (2, 9))], FLOW)
    regions = S.region_map(spark, rows=[(1, "A"), (2, "B"), (3, "B"), (3, "C")])
    got = {(r.importer, r.exporter, r.cusval) for r in P.regional_panel(df, regions).collect()}
    assert got == {("A", "B", 2.0), ("B", "OTHER", 1.0)}


def test_yearly_files(spark, tmp_path):
    head = "t,i,j,k,v,q\n"
    (tmp_path / "BACI_HS92_Y2001_V202601.csv").write_text(head + "2001,1,2,010121,1.5,2\n")
    (tmp_path / "BACI_HS92_Y2002_V202601.csv").write_text(head + "2002,1,2,10121,2.5,2\n")
    (tmp_path / "country_codes_V202601.csv").write_text("a,b\n1,x\n")
    df = S.rename(S.read_trade(spark, str(tmp_path)))
    assert sorted(r.good for r in df.collect()) == ["010121", "10121"]
    assert dict(df.dtypes)["good"] == "string"
    with pytest.raises(ValueError):
        S.read_trade(spark, "x.xlsx")
    with pytest.raises(FileNotFoundError):
        S.read_trade(spark, str(tmp_path / "nowhere"))
    assert S.output_prefix("/data/HS92_V202601", "hs4", "country") == "HS92_V202601_hs4_country" and S.trade_source("/x") == "baci"
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "flows.csv").write_text(head + "2001,1,2,010121,1.5,2\n")
    with pytest.warns(UserWarning):
        assert S.read_trade(spark, str(tmp_path / "other")).count() == 1


def test_manifest_and_checksums(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    row = S.checksums(spark, str(tmp_path)).first()
    assert row.sha256 == "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881" and row.size_bytes == 1
    listed, present = (spark.createDataFrame([(x,) for x in v], "local_path string") for v in ("ab", "bc"))
    assert {tuple(r) for r in S.manifest_drift(listed, present).collect()} == {("a", "missing"), ("c", "unlisted")}


def test_config_and_command_line():
    o = parser().parse_args(["--data", "d"])
    assert (o.agg_level, o.minyear, o.shrinkage_lambda, o.bw_lag, o.stage) == ("hs4", 1995, 0.1, "calendar", "all")
    for bad in ({"agg_level": "hs2"}, {"bw_lag": "x"}, {"min_exporters": 1}, {"maxyear": 1990}, {"tail_trim": 0.6}, {"shrinkage": -1.0}, {"exporter_weight": "x"}):
        with pytest.raises(ValueError):
            P.Config(**bad)
    with pytest.raises(SystemExit):
        parser().parse_args(["--data", "d", "--stage", "3"])


def test_empty_panel(spark):
    empty = spark.createDataFrame([], FLOW)
    cfg = P.Config()
    panel = P.prepare(P.raw_panel(empty, cfg), cfg)
    assert panel.count() == 0 and M.export_moments(panel, cfg).count() == 0 and M.import_moments(panel, cfg).count() == 0
    assert M.stage1_moments(empty).count() == 0


def test_canonical_order(spark):
    df = spark.createDataFrame([("b", 1, 2), ("a", 2, 1), ("a", 1, 9)], T.StructType([T.StructField("good", T.StringType()), T.StructField("importer", T.IntegerType()), T.StructField("x", T.IntegerType())]))
    assert [tuple(r) for r in S.canonical_order(df).collect()] == [("a", 1, 9), ("a", 2, 1), ("b", 1, 2)]


def test_streaming_panel_equals_batch(spark, tmp_path):
    from tidegauge.streaming.rollup import stream_panel, stream_trade

    src = tmp_path / "in"
    src.mkdir()
    for y in (2001, 2002):
        (src / f"BACI_HS92_Y{y}_V202601.csv").write_text(f"t,i,j,k,v,q\n{y},1,2,010121,1.5,2\n{y},1,2,010122,2.5,3\n")
    q = stream_panel(stream_trade(spark, str(src)), P.Config()).writeStream.format("memory").queryName("panel_out").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.year, r.good, r.cusval) for r in spark.table("panel_out").collect()}
    assert got == {(2001, "0101", 4.0), (2002, "0101", 4.0)}
