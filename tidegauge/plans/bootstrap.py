"""Exporter-cluster bootstrap of stage 1: replicates are cells of their own, fitted like all others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keep
from ..operators import moments as M
from .stage1 import fit_cells


def draws(panel: DataFrame, cells: DataFrame, replicates: int, seed: int = 20250511) -> DataFrame:
    """(importer, good, b, slot, exporter): for each replicate of a cell as many exporters as it has, drawn with
    replacement by a hash of seed, cell, replicate and slot; replicate 0 holds each exporter once."""
    lists = panel.join(cells.select("importer", "good"), ["importer", "good"], "left_semi").groupBy("importer", "good").agg(F.array_sort(F.collect_set("exporter")).alias("who"))
    slots = lists.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates)))).select("importer", "good", "b", "who", F.posexplode("who").alias("slot", "own"))
    at = F.pmod(F.xxhash64(F.lit(seed), "importer", "good", "b", "slot"), F.size("who")).cast("int")
    return slots.select("importer", "good", "b", "slot", F.when(F.col("b") == 0, F.col("own")).otherwise(F.get("who", at)).alias("exporter"))


def replicate_panel(panel: DataFrame, drawn: DataFrame) -> DataFrame:
    """The raw panel of every replicate: an exporter drawn twice enters as two, each slot is an exporter of its own, and
    the good's name carries the replicate."""
    rows = panel.join(drawn, ["importer", "good", "exporter"])
    return rows.select("year", F.concat_ws("#", "good", "b").alias("good"), "importer", F.col("slot").cast("int").alias("exporter"), "cusval", "quantity")


def bootstrap(panel: DataFrame, cells: DataFrame, replicates: int = 399, least_ok: int = 50, seed: int = 20250511) -> DataFrame:
    """(importer, good, sigma_base, boot_n_ok, boot_yield, boot_med, boot_sd, boot_mad_sd) of each cell of ``cells``.

    sigma_base is the fit of the cell itself; standard deviations need ``least_ok`` replicates that fit."""
    fits = fit_cells(M.stage1_moments(replicate_panel(panel, draws(panel, cells, replicates, seed))))
    named = keep.kept(fits.select("importer", F.substring_index("good", "#", 1).alias("good"), F.substring_index("good", "#", -1).cast("int").alias("b"), F.when(F.col("status") == "ok", F.col("sigma")).alias("sigma")))
    base = named.filter("b = 0").select("importer", "good", F.col("sigma").alias("sigma_base"))
    drawn = named.filter("b > 0 and sigma is not null")
    middle = drawn.groupBy("importer", "good").agg(F.count("*").alias("boot_n_ok"), F.median("sigma").alias("boot_med"), F.stddev("sigma").alias("__sd"))
    away = drawn.join(middle, ["importer", "good"]).groupBy("importer", "good").agg((1.4826 * F.median(F.abs(F.col("sigma") - F.col("boot_med")))).alias("__mad"))
    out = cells.select("importer", "good").join(base, ["importer", "good"], "left").join(middle, ["importer", "good"], "left").join(away, ["importer", "good"], "left")
    enough = F.col("boot_n_ok") >= least_ok
    return out.withColumn("boot_n_ok", F.coalesce("boot_n_ok", F.lit(0))).select(
        "importer", "good", "sigma_base", "boot_n_ok", (F.col("boot_n_ok") / replicates).alias("boot_yield"), "boot_med", F.when(enough, F.col("__sd")).alias("boot_sd"), F.when(enough, F.col("__mad")).alias("boot_mad_sd"),
    )
