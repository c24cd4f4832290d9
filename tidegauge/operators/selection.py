"""Which estimates to use: filter tiers by their errors, and whether the cells that the main estimator reaches differ."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as X
from ..functions import keep, logit, order


def cv_tier(exposure: int = 5, cv: float = 0.5) -> Column:
    """1 raw; 2 error known and below ``cv`` of gamma; 3 and sigma by the main estimator; 4 and gamma in ``exposure`` moments."""
    strict = F.coalesce((F.col("gamma_se_status") == "ok") & (F.col("gamma_se") < cv * F.col("gamma")), F.lit(False))
    main = strict & F.coalesce(X.sigma_provenance(F.col("final_source"), F.col("adjust")) == "interior", F.lit(False))
    return F.when(main & F.coalesce(F.col("gamma_exposure") >= exposure, F.lit(False)), 4).when(main, 3).when(strict, 2).otherwise(1)


def cv_tiers(est: DataFrame, exposure: int = 5, cv: float = 0.5) -> DataFrame:
    """(cv_tier, n, sigma_median, gamma_median): rows that pass each tier's filter; a tier holds those above it."""
    rows = keep.kept(est.select("sigma", "gamma", cv_tier(exposure, cv).alias("top")).withColumn("cv_tier", F.explode(F.sequence(F.lit(1), F.col("top")))))
    counts = rows.groupBy("cv_tier").agg(F.count("*").alias("n"))
    return order.same_keys(counts, order.quantiles(rows, ["cv_tier"], {"sigma_median": (F.col("sigma"), 0.5), "gamma_median": (F.col("gamma"), 0.5)}), ["cv_tier"])


def inverse_propensity(strict: DataFrame, chosen: str, factors: list[str], numbers: list[str], cap: float = 0.99) -> tuple[DataFrame, logit.Logit]:
    """(the chosen rows plus ``ipw``, the model): weights 1 / p, cut at their ``cap`` quantile and scaled to sum to the
    number of rows. Rows that the model can't judge have no weight and are left out."""
    model = logit.fit(strict, chosen, factors, numbers)
    rows = keep.kept(strict.filter(F.col(chosen)).dropna(subset=[*factors, *numbers]).withColumn("__w", 1 / model.probability()))
    top = order.quantiles(rows, [], {"top": (F.col("__w"), cap)})
    cut = keep.kept(rows.join(F.broadcast(top), F.lit(True)).withColumn("__w", F.least("__w", "top")).drop("top"))
    scale = cut.agg((F.count("*") / F.sum("__w")).alias("__s"))
    return cut.join(F.broadcast(scale), F.lit(True)).withColumn("ipw", F.col("__w") * F.col("__s")).drop("__w", "__s"), model


def ridge_analysis(est: DataFrame, region: str = "region", cap: float = 0.99) -> DataFrame:
    """(sample, n, sigma_p25, sigma_p50, sigma_p75, gamma_p50, spearman, mcfadden): rows with usable errors, those of the main
    estimator among them, and the latter weighted by their inverse propensity to be such given section, region and log
    trade. If the weighted sigma lies near the first row's, what is observed explains the selection.

    est: importer, exporter, good, sigma, gamma, gamma_se, gamma_se_status, gamma_exposure, final_source, adjust, avg_trade
    and the region. Rows without sigma, gamma, section, region or positive trade are left out."""
    log_trade = F.when(F.col("avg_trade") > 0, F.log("avg_trade"))
    # kept before it is filtered: a filter on tier and section would move below est's own aggregates and meet every trade row
    rows = keep.kept(est.select("sigma", "gamma", logit.hs_section(F.col("good")).alias("section"), F.col(region).alias("region"), log_trade.alias("log_trade"), cv_tier().alias("__t")))
    strict = rows.filter("__t >= 2").select("sigma", "gamma", "section", "region", "log_trade", (F.col("__t") >= 3).alias("main")).dropna()
    weighted, model = inverse_propensity(strict, "main", ["section", "region"], ["log_trade"], cap)
    samples = {"strict": strict.withColumn("w", F.lit(1.0)), "main": strict.filter("main").withColumn("w", F.lit(1.0)), "main_weighted": weighted.withColumnRenamed("ipw", "w")}
    out = []
    for name, df in samples.items():
        df = keep.kept(df.select("sigma", "gamma", "w"))
        sigma, gamma = order.weighted_quantiles(df, "sigma", "w", [0.25, 0.5, 0.75]), order.weighted_quantiles(df, "gamma", "w", [0.5])
        values = {"sigma_p25": sigma[0], "sigma_p50": sigma[1], "sigma_p75": sigma[2], "gamma_p50": gamma[0]}
        row = order.weighted_spearman(df, "sigma", "gamma", "w")
        out.append(row.select(F.lit(name).alias("sample"), "n", *[F.lit(v).cast("double").alias(k) for k, v in values.items()], "spearman", F.lit(model.mcfadden).alias("mcfadden")))
    return reduce(DataFrame.unionByName, out)
