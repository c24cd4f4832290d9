import math

import numpy as np
from pyspark.sql import functions as F

from tidegauge.operators.panel import Config, prepare, raw_panel
from tidegauge.plans import pipeline as P
from tidegauge.plans import stage2 as S2
from tidegauge.sources import trade as T

FLOW = "year int, good string, importer int, exporter int, cusval double, quantity double"


def synthetic(spark, years=12, exporters=9):
    rng = np.random.default_rng(42)
    rows = []
    for good in ("850100", "850400"):
        for imp in (840, 276, 392, 251):
            for exp in range(exporters):
                p, q = rng.normal(2, 0.5), rng.normal(5, 1)
                for y in range(2003, 2003 + years):
                    p, q = p + rng.normal(0, 0.2), q + rng.normal(0, 0.3)
                    rows.append((y, good, imp, 100 + exp, float(math.exp(p + q)), float(math.exp(q))))
    return spark.createDataFrame(rows, FLOW)


def test_three_stages_and_resume(spark, tmp_path):
    trade = synthetic(spark)
    regions = T.region_map(spark, rows=[(840, "AM"), (276, "EU"), (251, "EU"), (392, "AS"), *[(100 + e, "EU" if e % 2 else "AS") for e in range(9)]])
    cfg = Config(minyear=2003, tail_trim=None)
    found = P.estimate(trade, regions, str(tmp_path), cfg)
    s1, s2a, s2b = (found[k] for k in ("stage1", "stage2a", "stage2b"))
    assert s1.count() == 8 and s1.filter("status is null").isEmpty()
    for df in (s2a, s2b):
        assert tuple(df.columns) == S2.COLUMNS
        assert df.groupBy("importer", "exporter", "good").count().filter("count > 1").isEmpty()
        assert df.filter("gamma < 0 or gamma is null").isEmpty()
        assert df.filter("gamma_shrink_wt < 0 or gamma_shrink_wt > 1").isEmpty()
    assert s2b.count() == 8 * 9 and s2b.filter("tier = 0").count() == 8
    assert s2b.filter("gamma_se_status = 'ok' and gamma_se is null").isEmpty() and not s2b.filter("gamma_se > 0").isEmpty()
    again = P.estimate(trade, regions, str(tmp_path), cfg)
    assert sorted(again["stage2b"].inputFiles()) == sorted(s2b.inputFiles())


def test_legacy_and_calendar_lags_agree_without_gaps_and_differ_with(spark):
    from tidegauge.operators import moments as M

    full = synthetic(spark, years=8, exporters=4)
    holed = full.filter("not (importer = 840 and exporter = 101 and year in (2006, 2007))")
    for trade, same in ((full, True), (holed, False)):
        panel = prepare(raw_panel(trade, Config(minyear=2003)), Config(minyear=2003, uv_outlier=None))
        a, b = (M.import_moments(panel, Config(bw_lag=k)).select("importer", "good", "exporter", F.round("imp_y", 9).alias("y")) for k in ("calendar", "legacy"))
        assert a.exceptAll(b).isEmpty() == same
