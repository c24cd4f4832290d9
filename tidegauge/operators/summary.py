"""The summary of a run: its tables, and their files as Parquet, JSON and text."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keep, order
from ..sources import trade as T
from . import reports as R
from .panel import Config


def global_stats(est: DataFrame) -> DataFrame:
    """One row on all estimates that have sigma and gamma: counts, means, deviations and exact quantiles."""
    rows = keep.kept(est.filter("sigma is not null and gamma is not null"))
    plain = rows.agg(
        F.count("*").alias("n_estimates"), *[F.countDistinct(c).alias(f"n_{n}") for c, n in (("good", "products"), ("importer", "importers"), ("exporter", "exporters"))],
        F.countDistinct("importer", "good").alias("n_sigma"), F.count("*").alias("n_gamma"), *[f(c).alias(f"{c}_{n}") for c in ("sigma", "gamma") for f, n in ((F.avg, "mean"), (F.stddev, "sd"))], F.avg("opt_tariff").alias("opt_tariff_mean"),
    )
    wanted = R.quartiles("sigma") | R.quartiles("gamma") | {"opt_tariff_median": (F.col("opt_tariff"), 0.5)}
    return order.same_keys(order.same_keys(plain, order.quantiles(rows, [], wanted), []), order.mads_by(rows, [], "gamma", "gamma_mad"), [])


def step_comparison(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: medians of two steps, their shifts, and correlations over the flows that both have (more than 10)."""
    have = lambda df: df.filter("sigma is not null and gamma is not null")
    a, b = have(before), have(after)
    both_steps = a.select(F.lit(1).alias("step"), "sigma", "gamma").unionByName(b.select(F.lit(2).alias("step"), "sigma", "gamma"))
    middle = {r["step"]: r for r in order.quantiles(both_steps, ["step"], {c: (F.col(c), 0.5) for c in ("sigma", "gamma")}).collect()}
    med = {f"step{i}_{c}_median": middle[i][c] if i in middle else None for i in (1, 2) for c in ("sigma", "gamma")}
    side = lambda df, i: df.select("importer", "exporter", "good", F.col("sigma").alias(f"s{i}"), F.col("gamma").alias(f"g{i}"))
    both = side(a, 1).join(side(b, 2), ["importer", "exporter", "good"])
    out = both.agg(F.count("*").alias("n_matched"), F.corr("s1", "s2").alias("__s"), F.corr("g1", "g2").alias("__g")).withColumns({k: F.lit(v).cast("double") for k, v in med.items()})
    many = F.col("n_matched") > 10
    for c in ("sigma", "gamma"):
        shift = F.col(f"step2_{c}_median") - F.col(f"step1_{c}_median")
        out = out.withColumns({f"{c}_shift": shift, f"{c}_shift_pct": 100 * shift / F.col(f"step1_{c}_median"), f"cor_{c}": F.when(many, F.col(f"__{c[0]}"))})
    return out.drop("__s", "__g")


def build(est: DataFrame, cfg: Config, source: str = "", scope: str = "country", before: DataFrame | None = None, stage1: DataFrame | None = None, quality: DataFrame | None = None) -> dict[str, DataFrame]:
    """Name -> table: provenance (one row of settings), global, table2, within_het, var_decomp, and where their inputs are
    given step_comparison, failures and quality."""
    spark = est.sparkSession
    settings = {"source": T.trade_source(source), "path": source, "scope": scope} | {k: None if v is None else str(v) for k, v in asdict(cfg).items()}
    found = {
        "provenance": spark.createDataFrame([(k, v) for k, v in settings.items()], "setting string, value string"),
        "global": global_stats(est), "table2": R.country_table(est), "within_het": R.within_pair_summary(est), "var_decomp": R.variance_decomposition(est),
    }
    if before is not None:
        found["step_comparison"] = step_comparison(before, est)
    if stage1 is not None:
        found["failures"] = R.failure_counts(stage1)
        found["pass_rates"] = R.pass_rates(stage1)
    if quality is not None:
        found["quality"] = quality
    return found


def text(tables: dict[str, DataFrame]) -> DataFrame:
    """(value): the lines of a plain report, one per row of each table, in the order of the tables; whole tables, made and
    written by Spark."""
    out = None
    for i, (title, df) in enumerate(tables.items()):
        line = F.concat_ws("  ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-"))) for c in df.columns])
        head = df.sparkSession.range(1).select(F.lit(i).alias("i"), F.lit(0).alias("j"), F.lit(title).alias("value"))
        part = head.union(df.select(F.lit(i), F.lit(1), line))
        out = part if out is None else out.union(part)
    return out.orderBy("i", "j", "value").select("value")


def write(tables: dict[str, DataFrame], prefix: str) -> None:
    """<prefix>_<name> as Parquet and JSON lines (full precision) for each table, and <prefix>_summary_text as text."""
    saved = {}
    for name, df in tables.items():
        saved[name] = T.write_stage(df, f"{prefix}_{name}")
        T.write_json(saved[name], f"{prefix}_{name}_json")
    text(saved).coalesce(1).write.mode("overwrite").text(f"{prefix}_summary_text")


def as_json(table: DataFrame) -> str:
    """A table of one row as a JSON object."""
    row = table.first()
    return json.dumps(row.asDict(recursive=True) if row else {}, default=str)
