"""From trade rows to the estimation panel."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import columns as X
from ..functions import keep, order

SERIES = ["importer", "exporter", "good"]


@dataclass(frozen=True)
class Config:
    """Settings of a run; the defaults are those of a production run."""

    agg_level: str = "hs4"
    minyear: int = 1995
    maxyear: int | None = None
    min_exporters: int = 2
    min_destinations: int = 2
    min_periods: int = 3
    uv_outlier: float | None = 2.0
    sigma_start: float = 2.88
    gamma_start: float = 0.69
    exporter_weight: str = "trade_value"
    weight_period_floor: int = 10
    bw_lag: str = "calendar"
    tier1_min_periods: int = 3
    tier1_min_dests: int = 2
    tier2_min_periods: int = 3
    tail_trim: float | None = 0.005
    shrinkage: float = 0.1
    shrinkage_regional: float = 0.05
    plateau: float = 20.0
    stage1_hliml: str = "closed"
    stage2_gradient: str = "analytic"
    printed_signs: bool = False

    def with_(self, **changes) -> Config:
        return replace(self, **changes)

    def __post_init__(self):
        if self.agg_level not in ("hs4", "hs6"):
            raise ValueError("agg_level is hs4 or hs6")
        if self.bw_lag not in ("calendar", "legacy"):
            raise ValueError("bw_lag is calendar or legacy")
        if self.stage1_hliml not in ("closed", "bfgs", "both"):
            raise ValueError("stage1_hliml is closed, bfgs or both")
        if self.stage2_gradient not in ("analytic", "numeric"):
            raise ValueError("stage2_gradient is analytic or numeric")
        if self.exporter_weight not in ("trade_value", "uniform"):
            raise ValueError("exporter_weight is trade_value or uniform")
        if self.min_exporters < 2 or self.min_periods < 2:
            raise ValueError("a cell needs two exporters and two periods at least")
        if self.maxyear is not None and self.maxyear < self.minyear:
            raise ValueError("maxyear is before minyear")
        if self.shrinkage < 0 or self.shrinkage_regional < 0:
            raise ValueError("shrinkage is not negative")
        if self.tail_trim is not None and not 0 <= self.tail_trim < 0.5:
            raise ValueError("tail_trim is in [0, 0.5)")


def clean(trade: DataFrame, cfg: Config) -> DataFrame:
    """Positive value and quantity, years in range, six-digit codes."""
    years = F.col("year") >= cfg.minyear
    if cfg.maxyear is not None:
        years = years & (F.col("year") <= cfg.maxyear)
    return trade.filter((F.col("cusval") > 0) & (F.col("quantity") > 0) & years).withColumn("good", X.pad_hs6(F.col("good"))).filter(F.length("good") == 6)


def roll_up(panel: DataFrame) -> DataFrame:
    """Sums over (year, good, importer, exporter), after any of them was recoded."""
    return panel.groupBy("year", "good", "importer", "exporter").agg(F.sum("cusval").alias("cusval"), F.sum("quantity").alias("quantity"))


def raw_panel(trade: DataFrame, cfg: Config) -> DataFrame:
    """Cleaned trade at the level of the run; one row per key at hs4."""
    panel = clean(trade, cfg)
    return roll_up(panel.withColumn("good", X.hs6_to_hs4(F.col("good")))) if cfg.agg_level == "hs4" else panel


def assign_regions(df: DataFrame, regions: DataFrame, *cols: str) -> DataFrame:
    """Country codes replaced by their region, OTHER where the map has none. The map is a dimension table; Spark
    broadcasts it while it is small, by its own measure."""
    for c in cols:
        side = regions.select(F.col("cty_code").alias(c), F.col("region").alias("__region"))
        df = df.join(side, c, "left").withColumn(c, F.coalesce("__region", F.lit("OTHER"))).drop("__region")
    return df


def regional_panel(panel: DataFrame, regions: DataFrame) -> DataFrame:
    return roll_up(assign_regions(panel, regions, "importer", "exporter"))


def shares(panel: DataFrame, cfg: Config) -> DataFrame:
    """t, log unit value, and value shares of the import and the export market of the year."""
    out = panel.withColumns({"t": (F.col("year") - cfg.minyear + 1).cast("int"), "lp": X.log_ratio(F.col("cusval"), F.col("quantity"))})
    for side, key in (("imp", "importer"), ("exp", "exporter")):
        total = F.sum("cusval").over(W.partitionBy(key, "good", "t"))
        out = out.withColumn(f"{side}_total", total)
        out = out.withColumns({f"s_{side}": F.try_divide("cusval", f"{side}_total"), f"ls_{side}": X.log_ratio(F.col("cusval"), F.col(f"{side}_total"))})
    return out


def differences(shared: DataFrame) -> DataFrame:
    """First differences between successive years of a series; period_count counts its rows before any goes."""
    named = {f"{c}_dif": X.consecutive_diff(c, SERIES) for c in ("lp", "ls_imp", "ls_exp")}
    return shared.withColumns(named | {"period_count": F.count("*").over(W.partitionBy(*SERIES)).cast("int")})


def prepare(panel: DataFrame, cfg: Config) -> DataFrame:
    """The estimation panel: differences that exist and, unless switched off, move unit values by less than the limit."""
    texts = panel.withColumns({c: F.col(c).cast("string") for c in ("importer", "exporter")})
    out = differences(shares(texts, cfg)).filter("lp_dif is not null")
    return out.filter(F.abs("lp_dif") < cfg.uv_outlier) if cfg.uv_outlier else out


def cell_viability(panel: DataFrame, cfg: Config) -> DataFrame:
    """(importer, good, n_exporters, max_periods, viable)."""
    cells = panel.groupBy("importer", "good").agg(F.countDistinct("exporter").alias("n_exporters"), F.max("period_count").alias("max_periods"))
    return cells.withColumn("viable", (F.col("n_exporters") >= cfg.min_exporters) & (F.col("max_periods") >= cfg.min_periods))


def viable_rows(panel: DataFrame, cfg: Config) -> DataFrame:
    """Rows of viable cells; one shuffle on the cell, which later windows by cell share."""
    cell = W.partitionBy("importer", "good")
    one = (F.row_number().over(W.partitionBy("importer", "good", "exporter").orderBy("t")) == 1).cast("int")
    marked = panel.repartition(keep.width(panel.sparkSession), "importer", "good").withColumn("__one", one)
    marked = marked.withColumns({"__n": F.sum("__one").over(cell), "__p": F.max("period_count").over(cell)})
    return marked.filter((F.col("__n") >= cfg.min_exporters) & (F.col("__p") >= cfg.min_periods)).drop("__n", "__p", "__one")


def cell_stats(panel: DataFrame) -> DataFrame:
    cells = panel.groupBy("importer", "good").agg(F.countDistinct("exporter").alias("n_exp"), F.countDistinct("t").alias("n_per"))
    cells = keep.kept(cells)
    plain = cells.agg(F.count("*").alias("cells"), F.avg("n_exp").alias("mean_exporters"), F.avg("n_per").alias("mean_periods"))
    return order.same_keys(plain, order.quantiles(cells, [], {"median_exporters": (F.col("n_exp"), 0.5), "median_periods": (F.col("n_per"), 0.5)}), [])


def quality_log(trade: DataFrame, cfg: Config) -> DataFrame:
    """(step, stage, n_obs, n_dropped, trade_value): what each preparation step leaves, in one pass per shape of row.

    Row filters are counted as flags of one aggregate over the trade rows; the roll-up and the differences are counted
    over the panel."""
    x = trade.withColumn("good", X.pad_hs6(F.col("good")))
    positive = F.coalesce((F.col("cusval") > 0) & (F.col("quantity") > 0), F.lit(False))
    years = positive & (F.col("year") >= cfg.minyear) & (F.col("year") <= (cfg.maxyear or 1 << 30))
    digits = years & F.coalesce(F.length("good") == 6, F.lit(False))
    steps = [("raw", F.lit(True)), ("positive", positive), ("years", years), ("codes", digits)]
    flags = x.agg(*[a for name, ok in steps for a in (F.count_if(ok).alias(f"n_{name}"), F.sum(F.when(ok, F.col("cusval"))).alias(f"v_{name}"))])
    panel = raw_panel(trade, cfg)
    diffs = differences(shares(panel.withColumns({c: F.col(c).cast("string") for c in ("importer", "exporter")}), cfg))
    moved = F.coalesce(F.abs("lp_dif") < (cfg.uv_outlier or float("inf")), F.lit(False))
    more = [("rolled_up", F.lit(True)), ("differenced", F.col("lp_dif").isNotNull()), ("outliers", moved)]
    later = diffs.agg(*[a for name, ok in more for a in (F.count_if(ok).alias(f"n_{name}"), F.sum(F.when(ok, F.col("cusval"))).alias(f"v_{name}"))])
    long = lambda df, names, at: df.select(F.explode(F.array(*[F.struct(F.lit(at + i).alias("step"), F.lit(n).alias("stage"), F.col(f"n_{n}").alias("n_obs"), F.col(f"v_{n}").alias("trade_value")) for i, n in enumerate(names)])).alias("s")).select("s.*")
    log = long(flags, [n for n, _ in steps], 1).unionByName(long(later, [n for n, _ in more], len(steps) + 1))
    before = F.lag("n_obs").over(W.partitionBy(F.lit(1)).orderBy("step"))  # seven rows
    return log.select("step", "stage", "n_obs", F.coalesce(before - F.col("n_obs"), F.lit(0)).alias("n_dropped"), "trade_value")
