"""Reference selection and second moments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import columns as X
from ..functions import keep
from .panel import Config

CELL = ["importer", "good"]
IMPORT_MOMENTS = ["imp_y", *[f"imp_x{i}" for i in range(1, 6)]]
EXPORT_MOMENTS = ["exp_y", *[f"exp_x{i}" for i in range(1, 10)]]


def with_reference(rows: DataFrame, value: str = "cusval") -> DataFrame:
    """rows plus ref_exporter: of the cell's exporters with most periods the one with the largest value, then the
    smallest code. Windows over (importer, good) and finer keys share one shuffle."""
    cell, series = W.partitionBy(*CELL), W.partitionBy(*CELL, "exporter")
    ranked = rows.withColumns({"__n": F.count("*").over(series), "__v": F.sum(value).over(series)})
    best = F.min(F.struct((-F.col("__n")).alias("n"), (-F.col("__v")).alias("v"), "exporter")).over(cell)["exporter"]
    return ranked.withColumn("ref_exporter", best).drop("__n", "__v")


def choose_reference(panel: DataFrame, value: str = "cusval") -> DataFrame:
    """(importer, good, ref_exporter, n_periods, total_value)."""
    stats = panel.groupBy(*CELL, "exporter").agg(F.countDistinct("t").alias("n_periods"), F.sum(value).alias("total_value"))
    best = F.min_by(F.struct("exporter", "n_periods", "total_value"), F.struct(-F.col("n_periods"), -F.col("total_value"), "exporter"))
    return stats.groupBy(*CELL).agg(best.alias("b")).select(*CELL, F.col("b.exporter").alias("ref_exporter"), "b.n_periods", "b.total_value")


def _of_reference(c: str):
    return F.max(F.when(F.col("exporter") == F.col("ref_exporter"), F.col(c))).over(W.partitionBy(*CELL, "t"))


def stage1_moments(panel: DataFrame, dealt: bool = False) -> DataFrame:
    """(importer, good, exporter, ref_exporter, t, y, x1, x2) from the raw panel (year, good, importer, exporter,
    cusval, quantity): squares and products of log unit value and log share, differenced over successive years and
    against the cell's reference exporter. Rows without a partner and all-zero rows go. dealt: the panel is a table in
    buckets of cells, so nothing is exchanged."""
    rows = panel.filter(X.finite_positive(F.col("cusval")) & X.finite_positive(F.col("quantity")))
    rows = rows.groupBy(*CELL, "exporter", F.col("year").alias("t")).agg(F.sum("cusval").alias("cusval"), F.sum("quantity").alias("quantity"))
    rows = rows if dealt else rows.repartition(keep.width(panel.sparkSession), *CELL)
    rows = rows.withColumns({"lp": X.log_ratio(F.col("cusval"), F.col("quantity")), "ls": X.log_ratio(F.col("cusval"), F.sum("cusval").over(W.partitionBy(*CELL, "t")))})
    series = [*CELL, "exporter"]
    rows = with_reference(rows).withColumns({f"{c}_dif": X.consecutive_diff(c, series) for c in ("lp", "ls")})
    rows = rows.withColumns({"p": F.col("lp_dif") - _of_reference("lp_dif"), "s": F.col("ls_dif") - _of_reference("ls_dif")})
    rows = rows.select(*CELL, "exporter", "ref_exporter", "t", (F.col("p") * F.col("p")).alias("y"), (F.col("s") * F.col("s")).alias("x1"), (F.col("p") * F.col("s")).alias("x2"))
    return rows.filter("y is not null and x1 is not null and x2 is not null and not (y = 0 and x1 = 0 and x2 = 0)")


def group_sums(moments: DataFrame) -> DataFrame:
    """Per (cell, exporter): n and first and second sums of y, x1, x2. All that projections on exporter dummies need."""
    v = ("y", "x1", "x2")
    firsts = [F.sum(a).alias(f"s_{a}") for a in v]
    seconds = [F.sum(F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for i, a in enumerate(v) for b in v[i:]]
    return moments.groupBy(*CELL, "exporter").agg(F.count("*").alias("n"), *firsts, *seconds)


def cell_sums(sums: DataFrame) -> DataFrame:
    """Per cell: totals t_ab, between-exporter parts b_ab = sum of s_a s_b / n, and within parts w_ab = sum of s_ab / n."""
    v = ("y", "x1", "x2")
    out = [F.sum("n").alias("n"), F.count("*").alias("n_exporters"), *[F.sum(f"s_{a}").alias(f"t_{a}") for a in v]]
    for i, a in enumerate(v):
        for b in v[i:]:
            out += [F.sum(f"s_{a}_{b}").alias(f"t_{a}_{b}"), F.sum(F.col(f"s_{a}") * F.col(f"s_{b}") / F.col("n")).alias(f"b_{a}_{b}"), F.sum(F.col(f"s_{a}_{b}") / F.col("n")).alias(f"w_{a}_{b}")]
    return sums.groupBy(*CELL).agg(*out)


def cragg_donald(sums: DataFrame) -> DataFrame:
    """(importer, good, n, n_exporters, f): least-eigenvalue F of the exporter dummies for x1 and x2, the constant
    partialled out, unweighted."""
    c = cell_sums(sums)
    part = lambda a, b: F.col(f"b_{a}_{b}") - F.col(f"t_{a}") * F.col(f"t_{b}") / F.col("n")
    rest = lambda a, b: F.try_divide(F.col(f"t_{a}_{b}") - F.col(f"b_{a}_{b}"), F.col("n") - F.col("n_exporters"))
    pairs = (("x1", "x1"), ("x1", "x2"), ("x2", "x2"))
    low = X.min_eigen_2x2(*[part(*p) for p in pairs], *[rest(*p) for p in pairs])
    return c.select(*CELL, "n", "n_exporters", F.try_divide(low, F.col("n_exporters") - 1).alias("f"))


def with_lag(panel: DataFrame, cfg: Config) -> DataFrame:
    """The calendar lag of value, taken on the whole prepared panel before any matching drops rows."""
    return panel.withColumn("cusval_lag", X.calendar_lag("cusval", ["importer", "good", "exporter"])) if cfg.bw_lag == "calendar" else panel


def matched_rows(panel: DataFrame, cfg: Config) -> DataFrame:
    """Import-side moment rows of the non-reference exporters with their weights bw."""
    rows = with_lag(with_reference(panel.repartition(keep.width(panel.sparkSession), *CELL)), cfg)
    rows = rows.withColumns({"ref_ls": _of_reference("ls_imp_dif"), "ref_lp": _of_reference("lp_dif")}).filter("ref_ls is not null and ref_lp is not null")
    p, s = F.col("lp_dif") - F.col("ref_lp"), F.col("ls_imp_dif") - F.col("ref_ls")
    rows = rows.withColumns({"imp_y": p * p, "imp_x1": s * s, "imp_x2": s * p, "imp_x3": s * F.col("lp_dif"), "imp_x4": s * F.col("ref_lp"), "imp_x5": p * F.col("ref_lp")})
    rows = rows.filter(F.col("exporter") != F.col("ref_exporter"))
    if cfg.bw_lag == "legacy":
        rows = rows.withColumn("cusval_lag", X.positional_lag("cusval", ["importer", "good", "exporter"]))
    return rows.withColumn("bw", X.bw_weight(F.col("cusval"), F.col("cusval_lag"), F.col("period_count")))


def import_moments(panel: DataFrame, cfg: Config) -> DataFrame:
    """Per (importer, good, exporter): weighted import moments, n_periods, matched value, and ref_exporter."""
    means = [X.weighted_mean(F.col(c), F.col("bw")).alias(c) for c in IMPORT_MOMENTS]
    return matched_rows(panel, cfg).groupBy(*CELL, "exporter", "ref_exporter").agg(*means, F.countDistinct("t").alias("n_periods"), F.sum("cusval").alias("value"))


def destination_counts(panel: DataFrame) -> DataFrame:
    """(good, exporter, n_dests_total): importers an exporter serves."""
    return panel.groupBy("good", "exporter").agg(F.countDistinct("importer").alias("n_dests_total"))


def exporter_tiers(moments: DataFrame, dests: DataFrame, cfg: Config) -> DataFrame:
    """moments plus n_dests (others than this importer) and tier: 1 or 2 are estimated, 3 takes the prior."""
    joined = moments.join(dests, ["good", "exporter"], "left").withColumn("n_dests", F.greatest(F.coalesce("n_dests_total", F.lit(0)) - 1, F.lit(0)))
    one = (F.col("n_periods") >= cfg.tier1_min_periods) & (F.col("n_dests") >= cfg.tier1_min_dests)
    return joined.withColumn("tier", F.when(one, 1).when(F.col("n_periods") >= cfg.tier2_min_periods, 2).otherwise(3)).drop("n_dests_total")


def exporter_weights(moments: DataFrame, cfg: Config) -> DataFrame:
    """moments plus weight: value, less for short series, with mean 1 over the cell's estimated exporters."""
    if cfg.exporter_weight != "trade_value":
        return moments.withColumn("weight", F.lit(1.0))
    floor = cfg.weight_period_floor
    adjusted = F.col("value") * (F.least(F.col("n_periods"), F.lit(floor)) / floor if floor > 0 else F.lit(1.0))
    cell, used = W.partitionBy(*CELL), F.col("tier") < 3
    w = F.try_divide(adjusted * F.count_if(used).over(cell), F.sum(F.when(used, adjusted)).over(cell))
    return moments.withColumn("weight", F.when(used, F.when(w > 0, w).otherwise(1.0)))


def reference_destinations(panel: DataFrame) -> DataFrame:
    """(good, exporter, first_dest, second_dest): the two importers that take most of an exporter's good; the reference
    destination of an importer is the first that is not itself. Ties: the smaller code."""
    totals = panel.groupBy("good", "exporter", "importer").agg(F.sum("cusval").alias("v"))
    ranked = totals.withColumn("r", F.row_number().over(W.partitionBy("good", "exporter").orderBy(F.col("v").desc(), "importer"))).filter("r <= 2")
    return ranked.groupBy("good", "exporter").agg(F.max(F.when(F.col("r") == 1, F.col("importer"))).alias("first_dest"), F.max(F.when(F.col("r") == 2, F.col("importer"))).alias("second_dest"))


def export_moments(panel: DataFrame, cfg: Config) -> DataFrame:
    """Per (importer, good, exporter): weighted moments against the exporter's reference destination, and ref_dest.

    The two candidate destinations' differences come by windows over (good, exporter, t): one shuffle on (good,
    exporter) and no join of flows with flows."""
    flow, market, year = W.partitionBy("good", "exporter", "importer"), W.partitionBy("good", "exporter"), W.partitionBy("good", "exporter", "t")
    rows = panel.repartition("good", "exporter").withColumns({"__v": F.sum("cusval").over(flow), "__one": (F.row_number().over(flow.orderBy("t")) == 1).cast("int")})
    order = F.struct((-F.col("__v")).alias("v"), "importer")
    rows = rows.withColumns({"__first": F.min(order).over(market)["importer"], "__n": F.sum("__one").over(market)})
    rows = rows.withColumn("__second", F.min(F.when(F.col("importer") != F.col("__first"), order)).over(market)["importer"])
    if cfg.bw_lag == "calendar":
        rows = rows.withColumn("cusval_lag", X.calendar_lag("cusval", ["good", "exporter", "importer"]))
    own = F.col("importer") == F.col("__first")
    at = lambda who, c: F.max(F.when(F.col("importer") == F.col(who), F.col(c))).over(year)
    rows = rows.withColumns({"ref_dest": F.when(own, F.col("__second")).otherwise(F.col("__first")), **{f"ref_{n}": F.when(own, at("__second", c)).otherwise(at("__first", c)) for n, c in (("lp", "lp_dif"), ("ls", "ls_exp_dif"))}})
    rows = rows.filter(F.col("__n") >= cfg.min_destinations).filter("ref_lp is not null and ref_ls is not null and ls_exp_dif is not null")
    if cfg.bw_lag == "legacy":
        rows = rows.withColumn("cusval_lag", X.positional_lag("cusval", ["good", "exporter", "importer"]))
    rows = rows.withColumn("bw", X.bw_weight(F.col("cusval"), F.col("cusval_lag"), F.count("*").over(flow)))
    p, s, rp, rs = (F.col(c) for c in ("lp_dif", "ls_exp_dif", "ref_lp", "ref_ls"))
    products = [(p - rp) * (p - rp), s * s, s * p, rs * rs, rs * p, rs * rp, s * rp, s * rs, rp * rp, rp * p]
    means = [X.weighted_mean(x, F.col("bw")).alias(n) for n, x in zip(EXPORT_MOMENTS, products, strict=True)]
    return rows.groupBy(*CELL, "exporter", "ref_dest").agg(*means)
