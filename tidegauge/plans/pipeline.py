"""The whole run: raw trade to elasticities, stage by stage, each stage a Parquet table that a rerun picks up."""

from __future__ import annotations

import argparse
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import order
from ..operators import summary as S
from ..operators.panel import Config, prepare, quality_log, raw_panel, regional_panel
from ..sources import trade as T
from . import stage1 as S1
from . import stage2 as S2
from .resume import by_buckets

STAGES = ("1", "2a", "2b", "all")


def estimate(trade: DataFrame, regions: DataFrame, out: str, cfg: Config, stage: str = "all") -> dict[str, DataFrame]:
    """Runs the stages up to ``stage``. With "all", finished tables under ``out`` are reused if they were made with the same
    settings, region map and input files (paths, lengths, times); a named stage is computed anew and needs the tables before it.
    Inside a stage, fits are written by bucket: a run with "all" that was stopped goes on after its last finished buckets."""
    spark = trade.sparkSession
    mapped = regions.agg(F.bit_xor(F.xxhash64("cty_code", "region")), F.count("*")).first()
    made_of = hashlib.sha256(repr((cfg, tuple(mapped), trade.schema.simpleString(), T.files_fingerprint(trade))).encode()).hexdigest()[:12]

    def step(name: str, build, redo: bool) -> DataFrame:
        path = f"{out}/{name}-{made_of}"
        if not redo and T.stage_exists(spark, path):
            return spark.read.parquet(path)
        return T.write_stage(build(), path)

    fits_at = lambda name: f"{out}/{name}-fits-{made_of}"
    raw = step("raw_panel", lambda: raw_panel(trade, cfg), False)
    found = {"stage1": step("stage1", lambda: by_buckets(raw, lambda rows: S1.run_stage1(rows, cfg), fits_at("stage1"), anew=stage == "1"), stage == "1")}
    clean = S1.clean_sigma(found["stage1"])
    priors = S1.good_priors(found["stage1"])
    middle = order.quantiles(clean, [], {"s": (F.col("sigma"), 0.5), "g": (F.col("gamma"), 0.5)}).first()
    if stage == "1" or middle["s"] is None:
        return found

    def regional() -> DataFrame:
        panel = prepare(regional_panel(raw, regions), cfg)
        sigma = S2.regional_sigma(clean, regions)
        none = sigma.select("importer", "good", F.lit(None).cast("double").alias("gamma"))
        fits = S2.run_stage2(panel, cfg, cfg.shrinkage_regional, sigma, middle["s"], priors, none, middle["g"], resume=None if stage == "2a" else fits_at("stage2a"))
        return S2.plateau_fallback(fits, priors, cfg.plateau).select(*S2.COLUMNS)

    found["stage2a"] = step("stage2a", regional, stage == "2a")
    if stage == "2a":
        return found

    def country() -> DataFrame:
        panel = prepare(raw, cfg)
        texts = clean.withColumn("importer", F.col("importer").cast("string"))
        anchored = S2.regional_priors(found["stage2a"])
        centre = anchored.agg(F.exp(F.median("ln_gamma_prior"))).first()[0] or middle["g"]
        gamma_v, starts = (S2.by_country(f(found["stage2a"]), panel, regions) for f in (S2.regional_gamma, S2.regional_starts))
        return S2.run_stage2(panel, cfg, cfg.shrinkage, texts.select("importer", "good", "sigma"), middle["s"], anchored, gamma_v, centre, starts, centre, found["stage1"].withColumn("importer", F.col("importer").cast("string")), resume=None if stage == "2b" else fits_at("stage2b"))

    found["stage2b"] = step("stage2b", country, stage == "2b")
    return found


def next_defaults(fits: DataFrame, cfg: Config) -> Config:
    """Settings of another pass: it starts from the medians of a finished one; where there are none, from the same."""
    middle = order.quantiles(fits, [], {"s": (F.col("sigma"), 0.5), "g": (F.col("gamma"), 0.5)}).first()
    return cfg.with_(sigma_start=cfg.sigma_start if middle["s"] is None else middle["s"], gamma_start=cfg.gamma_start if middle["g"] is None else middle["g"])


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Estimate import-demand and export-supply elasticities from trade files.")
    p.add_argument("--data", required=True)
    p.add_argument("--out-dir", default="output")
    p.add_argument("--regions", help="CSV of cty_code, region")
    p.add_argument("--agg-level", choices=("hs4", "hs6"), default="hs4")
    p.add_argument("--minyear", type=int, default=1995)
    p.add_argument("--maxyear", type=int)
    p.add_argument("--shrinkage-lambda", type=float, default=0.1)
    p.add_argument("--bw-lag", choices=("calendar", "legacy"), default="calendar")
    p.add_argument("--stage1-hliml", choices=("closed", "bfgs", "both"), default="closed")
    p.add_argument("--stage2-gradient", choices=("analytic", "numeric"), default="analytic")
    p.add_argument("--printed-signs", action="store_true", help="signs of the export equation as published")
    p.add_argument("--stage", choices=STAGES, default="all")
    return p


def main(argv: list[str] | None = None) -> None:
    o = parser().parse_args(argv)
    cfg = Config(agg_level=o.agg_level, minyear=o.minyear, maxyear=o.maxyear, shrinkage=o.shrinkage_lambda, bw_lag=o.bw_lag, stage1_hliml=o.stage1_hliml, stage2_gradient=o.stage2_gradient, printed_signs=o.printed_signs)
    spark = SparkSession.builder.getOrCreate()
    regions = T.region_map(spark, o.regions) if o.regions else spark.createDataFrame([], "cty_code int, region string")
    trade = T.rename(T.read_trade(spark, o.data))
    prefix = f"{o.out_dir}/{T.output_prefix(o.data, cfg.agg_level, 'country')}"
    found = estimate(trade, regions, prefix, cfg, o.stage)
    report(found, trade, cfg, o.data, prefix)


def report(found: dict[str, DataFrame], trade: DataFrame, cfg: Config, source: str, prefix: str) -> None:
    """CSV files of the estimates in canonical order, and the summary's files for each scope."""
    for stage, scope in (("stage2a", "regional"), ("stage2b", "country")):
        if stage in found:
            T.write_csv(T.canonical_order(found[stage]), f"{prefix}/{stage}_csv")
            S.write(S.build(found[stage], cfg, source, scope, stage1=found["stage1"], quality=quality_log(trade, cfg)), f"{prefix}/{stage}_summary")


if __name__ == "__main__":
    main()
