"""The keyed panel: no exchange in the stage's moments, one file for one cell."""

import pandas as pd
import pytest

from tests.test_pipeline import synthetic
from tidegauge.functions import keep
from tidegauge.operators import moments as M
from tidegauge.operators.panel import Config, raw_panel
from tidegauge.plans import keyed as Y
from tidegauge.plans import stage1 as S1


@pytest.fixture(scope="module")
def panel(spark):
    raw = keep.kept(raw_panel(synthetic(spark), Config()))
    return raw, Y.write_keyed(raw, "keyed_raw", 8)


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_moments_of_a_keyed_panel_exchange_nothing(panel):
    raw, table = panel
    assert "Exchange" not in plan(M.stage1_moments(table, dealt=True)) and "Exchange" in plan(M.stage1_moments(raw))
    by = ["importer", "good"]
    a, b = (S1.run_stage1(df, Config(), dealt=d).toPandas().sort_values(by, ignore_index=True) for df, d in ((raw, False), (table, True)))
    pd.testing.assert_frame_equal(a, b, rtol=1e-6)


def test_one_cell_reads_one_file(spark, panel):
    raw, table = panel
    cell = raw.select("importer", "good").distinct().orderBy("importer", "good").first()
    rows = Y.cell_rows(spark, "keyed_raw", cell.importer, cell.good)
    assert sorted(map(str, rows.collect())) == sorted(map(str, raw.filter((raw.importer == cell.importer) & (raw.good == cell.good)).select(*rows.columns).collect()))
    scan = rows._jdf.queryExecution().executedPlan().collectLeaves().head()
    files = scan.metrics().get("numFiles").get().value()
    assert files == 1 < len(table.inputFiles())
    whole = S1.run_stage1(raw, Config()).filter((raw.importer == cell.importer) & (raw.good == cell.good)).toPandas()
    pd.testing.assert_frame_equal(Y.estimate_cell(spark, "keyed_raw", cell.importer, cell.good).toPandas()[whole.columns], whole, rtol=1e-6)
    assert Y.cell_rows(spark, "keyed_raw", 9999, "zzzz").count() == 0
    assert Y._buckets(spark, "keyed_raw") == 8
