"""The homogeneous baseline: one sigma and one gamma per cell by weighted least squares, all in column expressions.

With a common gamma the import equation has two regressors, y = a g x1 + (g - a) x2 for a = 1 / (sigma - 1) and
g = gamma / (1 + gamma), because x3 - x4 = x2. The objective is quadratic in (a g, g - a), so its minimum follows from six
weighted sums of a cell; a g > 0 gives a single admissible (a, g). Where that point lies outside, the best point of the
edges gamma = 1e-6, gamma = 1e6, sigma = 1 + 1e-6 and sigma = 1e9 is taken, each again by sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import moments as M
from .panel import Config, viable_rows

LOW, HIGH = 1e-6, 1e6


def _sums(rows: DataFrame) -> DataFrame:
    v = {"y": F.col("imp_y"), "a": F.col("imp_x1"), "b": F.col("imp_x3") - F.col("imp_x4"), "c": F.col("imp_x2")}
    pairs = [(p, q) for i, p in enumerate(v) for q in list(v)[i:]]
    return rows.groupBy(*M.CELL).agg(F.count("*").alias("n_exporters"), F.first("ref_exporter").alias("ref_exporter"), *[F.sum(F.col("weight") * v[p] * v[q]).alias(f"s_{p}{q}") for p, q in pairs])


def _value(inv: Column, g: Column) -> Column:
    """The objective at inv = 1 / (sigma - 1), g: residual y - inv g x1 - g x2 + inv (x3 - x4)."""
    c = {"y": F.lit(1.0), "a": -inv * g, "b": inv, "c": -g}
    names = list(c)
    out = F.lit(0.0)
    for i, p in enumerate(names):
        for q in names[i:]:
            out = out + (1 if p == q else 2) * c[p] * c[q] * F.col(f"s_{p}{q}")
    return out


def fit(rows: DataFrame) -> DataFrame:
    """(importer, good, ref_exporter, n_exporters, sigma, gamma, edge, convergence, obj_value) from import moments with a
    weight. edge: none, gamma_floor, gamma_cap, sigma_floor or sigma_cap; a cell without variation has no sigma and convergence 1."""
    s = _sums(rows)
    col = F.col
    det = col("s_aa") * col("s_cc") - col("s_ac") * col("s_ac")
    s = s.withColumns({"t1": F.try_divide(col("s_ya") * col("s_cc") - col("s_yc") * col("s_ac"), det), "t2": F.try_divide(col("s_yc") * col("s_aa") - col("s_ya") * col("s_ac"), det)})
    inner = (F.sqrt(col("t2") * col("t2") + 4 * col("t1")) - col("t2")) / 2
    s = s.withColumn("i0", F.when(col("t1") > 0, inner)).withColumn("g0", col("i0") + col("t2"))
    points = [F.struct(F.lit("none").alias("edge"), col("i0").alias("inv"), col("g0").alias("g"), ((col("i0") > 0) & (col("i0") <= HIGH) & (col("g0") >= LOW / (1 + LOW)) & (col("g0") <= HIGH / (1 + HIGH))).alias("ok"))]
    for name, gamma in (("gamma_floor", LOW), ("gamma_cap", HIGH)):
        g = gamma / (1 + gamma)
        # r = y - g x2 against z = g x1 - (x3 - x4)
        rz = g * col("s_ya") - col("s_yb") - g * g * col("s_ac") + g * col("s_bc")
        zz = g * g * col("s_aa") - 2 * g * col("s_ab") + col("s_bb")
        inv = F.try_divide(rz, zz)
        points.append(F.struct(F.lit(name).alias("edge"), F.least(F.greatest(inv, F.lit(1e-9)), F.lit(HIGH)).alias("inv"), F.lit(g).alias("g"), inv.isNotNull().alias("ok")))
    for name, inv in (("sigma_cap", LOW * 1e-3), ("sigma_floor", HIGH)):
        # r = y + inv (x3 - x4) against z = inv x1 + x2
        rz = inv * col("s_ya") + col("s_yc") + inv * inv * col("s_ab") + inv * col("s_bc")
        g = F.try_divide(rz, inv * inv * col("s_aa") + 2 * inv * col("s_ac") + col("s_cc"))
        points.append(F.struct(F.lit(name).alias("edge"), F.lit(inv).alias("inv"), F.least(F.greatest(g, F.lit(LOW / (1 + LOW))), F.lit(HIGH / (1 + HIGH))).alias("g"), g.isNotNull().alias("ok")))
    valued = F.transform(F.filter(F.array(*points), lambda p: F.coalesce(p["ok"], F.lit(False))), lambda p: F.struct(_value(p["inv"], p["g"]).alias("obj"), p["edge"].alias("edge"), p["inv"].alias("inv"), p["g"].alias("g")))
    inside = F.filter(valued, lambda p: p["edge"] == "none")
    best = s.withColumn("best", F.when(F.size(inside) > 0, F.element_at(inside, 1)).otherwise(F.array_min(valued)))
    return best.select(
        *M.CELL, "ref_exporter", "n_exporters", (1 + 1 / col("best.inv")).alias("sigma"), (col("best.g") / (1 - col("best.g"))).alias("gamma"),
        col("best.edge").alias("edge"), F.when(col("best").isNull(), 1).otherwise(0).alias("convergence"), F.greatest(col("best.obj"), F.lit(0.0)).alias("obj_value"),
    )


def baseline(panel: DataFrame, cfg: Config) -> DataFrame:
    """The baseline for every viable cell of a prepared panel, exporters weighted as the settings say."""
    every = M.import_moments(viable_rows(panel, cfg), cfg).withColumn("tier", F.lit(1))
    return fit(M.exporter_weights(every, cfg))
