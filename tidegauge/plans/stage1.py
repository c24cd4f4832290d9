"""Stage 1: sigma, omega and rho of every (importer, good) cell."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as X
from ..operators import moments as M
from ..operators.panel import Config
from .cell_fit import fit_cell

_FIT = (
    "importer int, good string, status string, sigma double, omega double, rho double, sigma_se double, omega_se double, rho_se double, adjust int, final_source string, "
    "omega_floored boolean, sigma_capped boolean, omega_capped boolean, fstat_kp double, fstat_het double, jstat double, jstat_h double, j_df int, gs_df int, sy_row int, gs_row int, "
    "hliml_status string, hliml_method string, hliml_boundary_edge string, hliml_Q double, sigma_hliml_cf double, omega_hliml_cf double, rho_hliml_cf double, hliml_cf_status string, "
    "hliml_cf_admissible boolean, hliml_cf_inversion string, hliml_Q_cf double, sigma_hliml_bd double, omega_hliml_bd double, hliml_bd_edge string, hliml_bd_usable boolean, hliml_Q_bd double, "
    "sigma_step2 double, omega_step2 double, rho_step2 double, sigma_hliml double, omega_hliml double, rho_hliml double, n_obs int, n_exporters int, kappa double, lambda_min double"
)
_NAMES = [c.split()[0] for c in _FIT.split(", ")]

#: Critical values of the weak-instrument test with two endogenous regressors, for 2 to 30 suppliers.
STOCK_YOGO = {
    0.10: (7.03, 5.44, 4.72, 4.32, 4.06, 3.90, 3.78, 3.70, 3.64, 3.60, 3.58, 3.56, 3.55, 3.54, 3.55, 3.55, 3.56, 3.57, 3.58, 3.59, 3.60, 3.62, 3.64, 3.65, 3.67, 3.74, 3.87, 4.02, 4.12),
    0.15: (4.58, 3.81, 3.39, 3.13, 2.95, 2.83, 2.73, 2.66, 2.60, 2.55, 2.52, 2.48, 2.46, 2.44, 2.42, 2.41, 2.40, 2.39, 2.38, 2.38, 2.37, 2.37, 2.37, 2.37, 2.38, 2.38, 2.38, 2.39, 2.39),
    0.20: (3.95, 3.32, 2.99, 2.78, 2.63, 2.52, 2.43, 2.36, 2.30, 2.25, 2.21, 2.17, 2.14, 2.11, 2.09, 2.07, 2.05, 2.03, 2.02, 2.01, 1.99, 1.98, 1.98, 1.97, 1.96, 1.96, 1.95, 1.95, 1.95),
    0.25: (3.63, 3.09, 2.79, 2.60, 2.46, 2.35, 2.27, 2.20, 2.14, 2.09, 2.05, 2.02, 1.99, 1.96, 1.93, 1.91, 1.89, 1.87, 1.86, 1.84, 1.83, 1.81, 1.80, 1.79, 1.78, 1.77, 1.77, 1.76, 1.75),
}


def stock_yogo(spark: SparkSession) -> DataFrame:
    rows = [(2 + i, *values) for i, values in enumerate(zip(*STOCK_YOGO.values(), strict=True))]
    return spark.createDataFrame(rows, "suppliers int, cv_10 double, cv_15 double, cv_20 double, cv_25 double")


def with_critical(df: DataFrame, suppliers: str, size: str, out: str) -> DataFrame:
    """Adds the critical value for a number of suppliers: null below 2 or unknown, the last row above 30."""
    table = stock_yogo(df.sparkSession).select(F.col("suppliers").alias("__n"), F.col(size).alias(out))
    return df.withColumn("__n", F.when(F.col(suppliers).isNotNull(), F.least(F.col(suppliers), F.lit(30)))).join(F.broadcast(table), "__n", "left").drop("__n")


_KINDS = {"int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def fit_cells(moments: DataFrame, method: str = "closed") -> DataFrame:
    """One row per cell of moment rows; a cell holds at most exporters x years rows. Moments come dealt by cell into a
    fixed number of partitions (stage1_moments), so the fits, which are heavy on few bytes, are not merged into one task."""
    kinds = [_KINDS[c.split()[1]] for c in _FIT.split(", ")]

    def one(key, rows):
        rows = rows.sort_by([("exporter", "ascending"), ("t", "ascending")])  # sums in one order, whatever order rows came in
        row = fit_cell(*(rows[c].to_numpy() for c in ("y", "x1", "x2")), rows["exporter"].to_numpy(), rows["ref_exporter"][0].as_py(), method=method)
        row = {"importer": key[0].as_py(), "good": key[1].as_py()} | row
        plain = lambda v: v.item() if hasattr(v, "item") else v
        return pa.table([pa.array([plain(row.get(n))], k) for n, k in zip(_NAMES, kinds, strict=True)], names=_NAMES)

    fitted = moments.groupBy("importer", "good").applyInArrow(one, _FIT)
    return fitted.select(*[F.nanvl(c, F.lit(None)).alias(c) if t == "double" else F.col(c) for c, t in fitted.dtypes])


def diagnostics(fits: DataFrame) -> DataFrame:
    """Tests from the fitted statistics: weak-instrument criticals at two rows, chi-squared tails, joint passes."""
    out = with_critical(with_critical(fits, "sy_row", "cv_10", "stockyogo_cv"), "gs_row", "cv_25", "stockyogo_cv_gs25")
    out = out.withColumns({
        "gamma_common": F.col("omega") / (1 + F.col("omega")), "stockyogo_pass": F.col("fstat_kp") > F.col("stockyogo_cv"), "stockyogo_pass_gs25": F.col("fstat_kp") > F.col("stockyogo_cv_gs25"),
        "jstat_pval": X.chi2_sf(F.col("jstat"), F.col("j_df")), "jstat_h_pval_gs": X.chi2_sf(F.col("jstat_h"), F.col("gs_df")),
    })
    out = out.withColumns({"sargan_pass": F.col("jstat_pval") > 0.2, "sargan_pass_gs": F.col("jstat_h_pval_gs") > 0.2})
    both = F.when(F.col("stockyogo_pass_gs25").isNotNull() & F.col("sargan_pass_gs").isNotNull(), F.col("stockyogo_pass_gs25") & F.col("sargan_pass_gs"))
    return out.withColumn("gs_pass_both", both).drop("j_df", "gs_df", "sy_row", "gs_row")


def recompute_diagnostics(stage1: DataFrame) -> DataFrame:
    """The test columns of a stored stage 1 table computed anew from its statistics and exporter counts."""
    n = F.when(F.col("status").startswith("thin_panel"), None).otherwise(F.col("n_exporters"))
    made = ("gamma_common", "stockyogo_cv", "stockyogo_cv_gs25", "stockyogo_pass", "stockyogo_pass_gs25", "jstat_pval", "jstat_h_pval_gs", "sargan_pass", "sargan_pass_gs", "gs_pass_both")
    rows = stage1.drop(*made).withColumns({"sy_row": n - 1, "j_df": n - 3, "gs_row": n + 1, "gs_df": n - 2})
    return diagnostics(rows).select(*stage1.columns)


def estimate_elasticities(trade: DataFrame, exporter: str = "exporter", t: str = "t", value: str = "value", quantity: str = "quantity", min_year: int | None = None, method: str = "closed") -> DataFrame:
    """The fit of a single cell, one row, from its trade rows of any column names (whole years in ``t``)."""
    rows = trade.filter(F.col(t) >= min_year) if min_year is not None else trade
    panel = rows.select(F.col(t).cast("int").alias("year"), F.lit("cell").alias("good"), F.lit(0).alias("importer"), F.col(exporter).alias("exporter"), F.col(value).cast("double").alias("cusval"), F.col(quantity).cast("double").alias("quantity"))
    return run_stage1(panel, Config(stage1_hliml=method, min_exporters=2, min_periods=2)).drop("importer", "good")


def run_stage1(panel: DataFrame, cfg: Config, dealt: bool = False) -> DataFrame:
    """panel: the raw panel (dealt: in buckets of cells). Every cell comes back, thin ones with the status that stopped them."""
    cells = panel.groupBy("importer", "good").agg(F.countDistinct("exporter").alias("__e"), F.countDistinct("year").alias("__t"), F.count("*").alias("__rows"))
    thin = (F.col("__e") < cfg.min_exporters) | (F.col("__t") < cfg.min_periods)
    cells = cells.withColumn("__thin", F.when(thin, F.format_string("thin_panel_e%d_t%d", "__e", "__t")))
    fits = diagnostics(fit_cells(M.stage1_moments(panel, dealt), cfg.stage1_hliml))
    joined = cells.join(fits, ["importer", "good"], "left")
    few = F.coalesce("n_obs", F.lit(0)) < 5
    joined = joined.withColumn("status", F.coalesce("__thin", F.when(few, F.format_string("prep_thin_n%d", F.coalesce("n_obs", F.lit(0)))), "status"))
    unfitted = F.col("__thin").isNotNull() | few
    given = {"n_obs": F.col("__rows").cast("int"), "n_exporters": F.when(F.col("__thin").isNotNull(), F.col("__e")).cast("int")}
    kept = [c for c in fits.columns if c not in ("importer", "good", "status")]
    out = joined.select("importer", "good", "status", *[F.when(~unfitted, F.col(c)).otherwise(given.get(c)).alias(c) for c in kept])
    return out.withColumns({"gamma": F.col("omega"), "convergence": F.when(F.col("status") == "ok", 0).otherwise(-99)})


def clean_sigma(stage1: DataFrame) -> DataFrame:
    return stage1.filter("sigma is not null and sigma > 1 and convergence = 0")


def good_priors(stage1: DataFrame) -> DataFrame:
    """(good, ln_gamma_prior): median log gamma of the cells whose omega is neither floored nor capped."""
    fit = clean_sigma(stage1).filter("gamma > 0 and adjust <> 5").filter(~F.coalesce("omega_floored", F.lit(False)) & ~F.coalesce("omega_capped", F.lit(False)))
    return fit.groupBy("good").agg(F.median(F.log("gamma")).alias("ln_gamma_prior"))
