"""Summaries, censuses and comparisons of stage tables. Estimates have (importer, exporter, good, sigma, gamma, tier, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import columns as X
from ..functions import keep, order

CELL = ["importer", "good"]


def quartiles(name: str, col: Column | None = None) -> dict[str, tuple[Column, float]]:
    """Median and quartiles of a column, by name, for ``order.quantiles``."""
    c = F.col(name) if col is None else col
    return {f"{name}_median": (c, 0.5), f"{name}_q25": (c, 0.25), f"{name}_q75": (c, 0.75)}


def country_table(est: DataFrame) -> DataFrame:
    """Per importer and for the world: estimates, goods, medians and quartiles. Every row counts for its importer and for
    the world in one pass over the estimates (grouping sets); quantiles are exact, the world's like any other group's."""
    rows = keep.kept(est.select(F.col("importer").cast("string").alias("importer"), "good", F.col("sigma").cast("double").alias("sigma"), F.col("gamma").cast("double").alias("gamma")))
    table = rows.groupingSets([["importer"], []], "importer").agg(F.grouping("importer").alias("__all"), F.count("*").alias("n"), F.countDistinct("good").alias("goods"))
    table = table.select(F.when(F.col("__all") == 1, "World").otherwise(F.col("importer")).alias("importer"), "n", "goods")
    twice = rows.select(F.explode(F.array("importer", F.lit("World"))).alias("importer"), "sigma", "gamma")
    g = F.col("gamma")
    return order.same_keys(table, order.quantiles(twice, ["importer"], {"sigma_median": (F.col("sigma"), 0.5), "gamma_median": (g, 0.5), "gamma_q25": (g, 0.25), "gamma_q75": (g, 0.75)}), ["importer"])


def pair_stats(est: DataFrame) -> DataFrame:
    """(importer, good, n_exporters, within_med, within_sd, within_mad) of cells with two positive gammas or more."""
    ok = est.filter("gamma > 0").withColumn("__m", F.median("gamma").over(W.partitionBy(*CELL)))
    stats = ok.groupBy(*CELL).agg(F.count("*").alias("n_exporters"), F.median("gamma").alias("within_med"), F.stddev("gamma").alias("within_sd"), F.median(F.abs(F.col("gamma") - F.col("__m"))).alias("within_mad"))
    return stats.filter("n_exporters >= 2")


def within_pair_summary(est: DataFrame) -> DataFrame:
    """One row: pairs, and median and quartiles of their medians, deviations and median distances, all in one shuffle."""
    stats = keep.kept(pair_stats(est))
    wanted = {f"{n}_{c}": (F.col(c), p) for c in ("within_med", "within_sd", "within_mad") for n, p in (("median", 0.5), ("q25", 0.25), ("q75", 0.75))}
    return order.same_keys(stats.agg(F.count("*").alias("n_pairs")), order.quantiles(stats, [], wanted), [])


def variance_decomposition(est: DataFrame, least: int = 10) -> DataFrame:
    """(r_squared, n_obs, n_groups): share of the variance of log gamma between cells; no row with fewer than ``least``
    cells of several exporters. Sums of squares come from one aggregate per cell."""
    cells = est.filter("gamma > 0").withColumn("lg", F.log("gamma")).groupBy(*CELL).agg(F.count("*").alias("n"), F.sum("lg").alias("s"), F.avg("lg").alias("m"), F.var_pop("lg").alias("v"))
    t = cells.agg(F.sum("n").alias("n_obs"), F.count("*").alias("n_groups"), F.count_if(F.col("n") > 1).alias("multi"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum("s").alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("b"))
    between = F.col("b") - F.col("s") * F.col("s") / F.col("n_obs")
    return t.filter(F.col("multi") >= least).select((1 - F.try_divide(F.col("within"), F.col("within") + between)).alias("r_squared"), "n_obs", "n_groups")


def calibration(est: DataFrame, lam: float, cutoff: float = 20.0) -> DataFrame:
    """One row of diagnostics for a shrinkage strength."""
    ok = keep.kept(est.filter("gamma > 0").select(*CELL, "gamma", "tier"))
    of = lambda k: F.when(F.col("tier") == k, F.col("gamma"))
    main = ok.agg(F.count("*").alias("n_estimates"), F.avg((F.col("gamma") > cutoff).cast("double")).alias("plateau_share"), *[F.count(of(k)).alias(f"__n{k}") for k in (1, 3)])
    main = order.same_keys(main, order.quantiles(ok, [], {f"__m{k}": (of(k), 0.5) for k in (1, 3)}), [])
    main = main.select("n_estimates", "plateau_share", *[F.when(F.col(f"__n{k}") > 10, F.col(f"__m{k}")).alias(f"tier{k}_gamma_median") for k in (1, 3)])
    stats = keep.kept(pair_stats(ok))
    pairs = order.same_keys(stats.agg(F.count("*").alias("n_pairs")), order.quantiles(stats, [], {"within_pair_mad": (F.col("within_mad"), 0.5)}), [])
    one = F.broadcast  # single rows
    joined = main.join(one(pairs), F.lit(True)).join(one(variance_decomposition(ok).select("r_squared")), F.lit(True), "left")
    return joined.select(F.lit(lam).alias("lambda"), "*", F.abs(F.log("tier1_gamma_median") - F.log("tier3_gamma_median")).alias("tier_distinctness"))


def shares(df: DataFrame, *keys: str, within: tuple[str, ...] = ()) -> DataFrame:
    """Counts by key with their percentage of all rows, or of the rows that agree on ``within``."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy(*within) if within else W.partitionBy(F.lit(0)))  # a window over the counts
    return counts.withColumn("pct", 100 * F.col("n") / total)


def chapter_gamma(est: DataFrame) -> DataFrame:
    """By two-digit chapter: n, median and quartiles of gamma, and median and upper quartile over its cells of the spread
    within a cell."""
    rows = keep.kept(est.filter("gamma > 0").select(*CELL, "gamma").withColumn("chapter", F.substring("good", 1, 2)))
    spread = F.col("within_mad")
    within = order.quantiles(pair_stats(rows).withColumn("chapter", F.substring("good", 1, 2)), ["chapter"], {"within_pair_mad": (spread, 0.5), "within_pair_mad_q75": (spread, 0.75)})
    table = order.same_keys(rows.groupBy("chapter").agg(F.count("*").alias("n")), order.quantiles(rows, ["chapter"], quartiles("gamma")), ["chapter"])
    return order.same_keys(table, within, ["chapter"])


def gap_rows(panel: DataFrame) -> DataFrame:
    """Rows whose previous calendar year is absent: first of its series, or stale (a positional lag would be older)."""
    series = ["importer", "exporter", "good"]
    w = W.partitionBy(*series).orderBy("t")
    first, before = F.min("t").over(W.partitionBy(*series)), F.count("*").over(w.rangeBetween(-1, -1))
    return panel.withColumns({"is_fallback": before == 0, "is_stale": (before == 0) & (F.col("t") != first)})


def gap_census(panel: DataFrame) -> DataFrame:
    """Per cell: series, series with holes, rows, stale rows, fallback rows."""
    flags = gap_rows(panel)
    series = flags.groupBy("importer", "exporter", "good").agg(F.count("*").alias("n_t"), F.count_if("is_stale").alias("n_stale"), F.count_if("is_fallback").alias("n_fallback"))
    holed = F.col("n_stale") > 0
    return series.groupBy(*CELL).agg(F.count("*").alias("n_series"), F.count_if(holed).alias("n_series_holed"), F.avg(holed.cast("double")).alias("share_holed"), F.sum("n_t").alias("n_rows"), F.sum("n_stale").alias("n_stale_rows"), F.sum("n_fallback").alias("n_fallback_rows"))


def gap_totals(census: DataFrame) -> DataFrame:
    """The census of the whole panel, one row: cells, those with a hole, sums and shares."""
    total = lambda c: F.sum(c).alias(c)
    out = census.agg(F.count("*").alias("n_cells"), F.count_if(F.col("n_stale_rows") > 0).alias("n_cells_holed"), *[total(c) for c in ("n_series", "n_series_holed", "n_rows", "n_stale_rows", "n_fallback_rows")])
    share = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return out.withColumns({"share_cells_holed": share("n_cells_holed", "n_cells"), "share_series_holed": share("n_series_holed", "n_series"), "share_rows_stale": share("n_stale_rows", "n_rows")})


def survivorship_census(trade: DataFrame, min_exporters: list[int], min_pairs: list[int]) -> DataFrame:
    """Shares of cells, routes and value that stay estimable, for each level of codes and pair of guards."""
    coded = trade.withColumn("good6", X.pad_hs6(F.col("good")))
    levels = F.array(F.struct(F.lit("HS4").alias("hs_level"), X.hs6_to_hs4(F.col("good6")).alias("g")), F.struct(F.lit("HS6").alias("hs_level"), F.col("good6").alias("g")))
    years = coded.select("year", "importer", "exporter", "cusval", F.inline(levels)).groupBy("hs_level", "importer", "g", "exporter", "year").agg(F.sum("cusval").alias("v"))
    route = W.partitionBy("hs_level", "importer", "g", "exporter").orderBy("year")
    years = years.withColumn("pair", (F.col("year") - F.lag("year").over(route) == 1).cast("int"))
    routes = years.groupBy("hs_level", "importer", "g", "exporter").agg(F.coalesce(F.sum("pair"), F.lit(0)).alias("pairs"), F.sum("v").alias("v"))
    pairs = F.explode(F.array(*[F.lit(x) for x in min_pairs]))
    cells = routes.withColumn("min_pairs", pairs).groupBy("hs_level", "min_pairs", "importer", "g").agg(F.count_if(F.col("pairs") >= F.col("min_pairs")).alias("q"), F.count("*").alias("r"), F.sum("v").alias("v"))
    guarded = cells.withColumn("min_exporters", F.explode(F.array(*[F.lit(x) for x in min_exporters])))
    ok = F.col("q") >= F.col("min_exporters")
    return guarded.groupBy("hs_level", "min_exporters", "min_pairs").agg(
        F.count("*").alias("cells_total"), F.count_if(ok).alias("cells_estimable"), F.avg(ok.cast("double")).alias("share_cells"),
        (F.sum(F.when(ok, F.col("r")).otherwise(0)) / F.sum("r")).alias("share_routes"), (F.sum(F.when(ok, F.col("v")).otherwise(0.0)) / F.sum("v")).alias("share_value"),
    )


def inflation() -> Column:
    carried = F.abs("dgamma_dsigma") * F.col("sigma_se")
    return F.when((F.col("gamma_se") > 0) & carried.isNotNull(), F.sqrt(F.col("gamma_se") * F.col("gamma_se") + carried * carried) / F.col("gamma_se"))


def sensitivity(est: DataFrame, poles: list[float], limits: list[float]) -> DataFrame:
    """Percent of estimated rows in cells that count as robust, by pole distance (rows) and inflation limit (columns)."""
    cells = est.filter("tier < 3").withColumn("i", inflation()).groupBy(*CELL).agg(F.count("*").alias("n"), F.max("sigma").alias("sigma"), F.max("sigma_se").alias("sigma_se"), F.max("i").alias("worst"))
    grid = cells.withColumn("k_pole", F.explode(F.array(*[F.lit(x) for x in poles]))).withColumn("limit", F.explode(F.array(*[F.lit(x) for x in limits])))
    bad = (F.col("sigma") >= 9.999) | F.col("sigma_se").isNull() | (F.col("k_pole") * F.col("sigma_se") >= F.col("sigma") - 1 - 1e-6) | (F.coalesce("worst", F.lit(0.0)) > F.col("limit"))
    long = grid.groupBy("k_pole", "limit").agg((100 * F.sum(F.when(bad, 0).otherwise(F.col("n"))) / F.sum("n")).alias("p"))
    named = long.withColumn("name", F.concat(F.lit("infl_"), F.replace(F.col("limit").cast("string"), F.lit("."), F.lit("_"))))
    return named.groupBy("k_pole").pivot("name", [f"infl_{str(x).replace('.', '_')}" for x in limits]).agg(F.first("p"))


def composition(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Counts of each level in two tables, side by side; a level that one lacks counts 0."""
    a, b = (df.groupBy(key).agg(F.count("*").alias(n)) for df, n in ((old, "n_old"), (new, "n_new")))
    return a.join(b, key, "full_outer").select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_old", "n_new")])


def pairing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """How two sets of gammas agree on their common keys: n, median absolute difference, squared correlation."""
    both = keep.kept(a.select(*keys, F.col("gamma").alias("ga")).join(b.select(*keys, F.col("gamma").alias("gb")), keys).select("ga", "gb"))
    plain = both.agg(F.count("*").alias("n"), F.pow(F.corr("ga", "gb"), 2).alias("r_squared"))
    return order.same_keys(plain, order.quantiles(both, [], {"mad": (F.abs(F.col("ga") - F.col("gb")), 0.5)}), [])


def _metrics(df: DataFrame, plain: dict, quantiles: dict, value: str) -> DataFrame:
    """(metric, value) of one table: plain aggregates, and quantiles of all columns by one shuffle."""
    rows = keep.kept(df)
    row = order.same_keys(rows.agg(*[f().alias(m) for m, f in plain.items()]), order.quantiles(rows, [], quantiles), [])
    return row.unpivot([], [*plain, *quantiles], "metric", value)


_METRICS = {"n": lambda: F.count("*").cast("double"), "goods": lambda: F.countDistinct("good").cast("double"), "plateau": lambda: F.avg((F.col("gamma") > 20).cast("double"))}


def run_comparison(old: DataFrame, new: DataFrame) -> DataFrame:
    """(metric, old, new, delta) in long form."""
    long = lambda df, n: _metrics(df.select("good", "sigma", "gamma"), _METRICS, {"sigma_median": (F.col("sigma"), 0.5)} | quartiles("gamma"), n)
    return long(old, "old").join(long(new, "new"), "metric").withColumn("delta", F.col("new") - F.col("old"))


def structural_ratios(est: DataFrame, *keys: str) -> DataFrame:
    """Medians by key of gamma / (1 + gamma), 1 / (sigma - 1) and gamma / ((1 + gamma)(sigma - 1))."""
    g, s = F.col("gamma"), F.col("sigma")
    ratios = {"pass_through": (g / (1 + g), 0.5), "markup": (F.try_divide(F.lit(1.0), s - 1), 0.5), "joint": (F.try_divide(g, (1 + g) * (s - 1)), 0.5)}
    rows = keep.kept(est.select(*keys, "gamma", "sigma"))
    return order.same_keys(rows.select(*keys).distinct(), order.quantiles(rows, list(keys), ratios), list(keys))


_RUN = {
    "rows": lambda: F.count("*").cast("double"), "gamma_max": lambda: F.max("gamma"), "share_gamma_above_1": lambda: F.avg((F.col("gamma") > 1).cast("double")),
    "share_sigma_at_cap": lambda: F.avg((F.col("sigma") >= 9.999).cast("double")), "share_gamma_se": lambda: F.avg(F.col("gamma_se").isNotNull().cast("double")),
    "share_sigma_robust": lambda: F.avg(F.coalesce("sigma_robust", F.lit(False)).cast("double")),
}
_RUN_COLUMNS = {"gamma": "double", "sigma": "double", "gamma_se": "double", "gamma_se_total": "double", "sigma_se": "double", "sigma_robust": "boolean"}


def compare_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """(metric, old, new, change) of two stage 2b tables; a column that a table lacks counts as null."""
    g = F.col("gamma")
    middle = {"gamma_median": (g, 0.5), "gamma_p25": (g, 0.25), "gamma_p75": (g, 0.75), "gamma_p95": (g, 0.95), "supply_elasticity_median": (F.try_divide(F.lit(1.0), g), 0.5)}
    middle |= {f"{c}_median": (F.col(c), 0.5) for c in ("sigma", "gamma_se", "gamma_se_total", "sigma_se")}

    def long(df, n):
        return _metrics(df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in _RUN_COLUMNS.items()]), _RUN, middle, n)

    return long(old, "old").join(long(new, "new"), "metric").withColumn("change", F.col("new") - F.col("old"))


def distributions(old: DataFrame, new: DataFrame, *cols: str) -> DataFrame:
    """(column, level, old, new, change): shares of every level that either table has, sorted; a table that lacks the
    column or any row with a value has null shares, one that lacks the level 0."""
    def side(df, n):
        out = None
        for c in cols:
            has = df.filter(F.col(c).isNotNull()) if c in df.columns else df.withColumn(c, F.lit(None).cast("string")).limit(0)
            part = has.groupBy(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")).agg(F.count("*").alias("__n")).withColumn(n, F.col("__n") / F.sum("__n").over(W.partitionBy("column"))).drop("__n")
            out = part if out is None else out.unionByName(part)
        return out.withColumn(f"__has_{n}", F.lit(True))

    a, b = side(old, "old"), side(new, "new")
    both = a.join(b, ["column", "level"], "full_outer")
    known = lambda n: F.max(f"__has_{n}").over(W.partitionBy("column"))
    both = both.withColumns({n: F.when(known(n), F.coalesce(n, F.lit(0.0))) for n in ("old", "new")})
    return both.select("column", "level", "old", "new", (F.col("new") - F.col("old")).alias("change")).orderBy("column", "level")


def patch_flags(stage1: DataFrame, cap: float = 10.0) -> DataFrame:
    """Stage 1 with its cap flags of boundary cells set from the edge and the caps (boundary_flags); others as they are."""
    hit = F.col("final_source") == "hliml_boundary"
    s, o = X.boundary_flags(F.col("hliml_boundary_edge"), F.col("sigma"), F.col("omega"), cap, cap)
    return stage1.withColumns({"sigma_capped": F.when(hit, s).otherwise(F.col("sigma_capped")), "omega_capped": F.when(hit, o).otherwise(F.col("omega_capped"))})


def transitions(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Counts of (old, new) values of a column over common cells."""
    side = lambda df, n: df.select(*CELL, F.col(key).alias(n))
    return side(before, "old").join(side(after, "new"), CELL).groupBy("old", "new").agg(F.count("*").alias("n"))


def failure_counts(stage1: DataFrame) -> DataFrame:
    """The statuses that stopped cells, the most frequent first."""
    return stage1.filter("status <> 'ok'").groupBy("status").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "status")


def spike(est: DataFrame, cap: float = 10.0) -> DataFrame:
    """The most frequent sigma below the cap (ties: the smaller) and its count."""
    return est.filter(F.col("sigma") < cap).groupBy("sigma").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "sigma").limit(1)


def provenance_medians(stage1: DataFrame) -> DataFrame:
    """n, median and quartiles of sigma by how it was found."""
    named = keep.kept(stage1.select(X.sigma_provenance(F.col("final_source"), F.col("adjust")).alias("provenance"), "sigma"))
    return order.same_keys(named.groupBy("provenance").agg(F.count("*").alias("n")), order.quantiles(named, ["provenance"], quartiles("sigma")), ["provenance"])


def pass_rates(stage1: DataFrame) -> DataFrame:
    """Counts and pass rates of the tests, each over the cells where the test is defined."""
    tests = [c for c in ("stockyogo_pass", "stockyogo_pass_gs25", "sargan_pass", "sargan_pass_gs", "gs_pass_both") if c in stage1.columns]
    return stage1.filter("status = 'ok'").agg(F.count("*").alias("n_ok"), *[a for c in tests for a in (F.count(c).alias(f"n_{c}"), F.avg(F.col(c).cast("double")).alias(f"rate_{c}"))])


#: Codes of ``adjust`` by how a cell was routed; every cell has exactly one of them or none.
ROUTES = {
    0: "hliml_interior", 1: "step2_clean", 2: "step2_omega_only", 3: "omega_negative_floor", 4: "clamped_at_sigma_cap", 5: "clamped_at_omega_cap",
    6: "boundary_omega_floor", 7: "boundary_sigma_cap", 8: "boundary_omega_cap",
}
#: Statuses that are counted by themselves, and prefixes that are counted together.
STATUSES = ("ok", "all_inversions_failed", "fail_too_few_exporters", "step1_fail_singular_QWW", "step2_fail_singular_QWW_fellback_to_step1")
STATUS_PREFIXES = {"prep_thin_total": "prep_thin_n", "thin_panel_total": "thin_panel_"}


def stage1_report(stage1: DataFrame) -> DataFrame:
    """(section, metric, n, denominator) of a stage 1 table in one pass: sizes, tests passed of those evaluated, routing by
    adjust, statuses (single ones, prefixes and the rest), omega at its floor, and the shares that reports quote. Routes
    and statuses each add up to the number of cells: what has no name is counted as other."""
    adjust, status = F.col("adjust"), F.coalesce("status", F.lit(""))
    has = lambda c: c in stage1.columns
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    cells = F.count("*")
    codes = list(ROUTES)
    entries: list[tuple[str, str, Column, Column]] = [("size", "cells", cells, cells), ("size", "products", F.countDistinct("good"), cells), ("size", "importers", F.countDistinct("importer"), cells)]
    entries += [("tests", c, yes(F.col(c)), F.count(c)) for c in ("stockyogo_pass", "stockyogo_pass_gs25", "sargan_pass", "sargan_pass_gs", "gs_pass_both") if has(c)]
    entries += [("routing", name, yes(adjust == code), cells) for code, name in ROUTES.items()]
    entries += [("routing", "pre_discard", F.count_if(adjust.isNull()), cells), ("routing", "other", yes(~adjust.isin(codes)), cells)]
    entries += [("routing_total", name, yes(adjust.isin(which)), cells) for name, which in (("boundary_total", [6, 7, 8]), ("step2_total", [1, 2, 3, 4, 5]), ("clamped_total", [4, 5]))]
    named = status.isin(*STATUSES)
    for prefix in STATUS_PREFIXES.values():
        named = named | status.startswith(prefix)
    entries += [("status", x, F.count_if(status == x), cells) for x in STATUSES]
    entries += [("status", name, F.count_if(status.startswith(prefix)), cells) for name, prefix in STATUS_PREFIXES.items()] + [("status", "other", F.count_if(~named), cells)]
    entries += [("floor", "omega_floor", yes(F.col("omega") <= 1e-4), cells)] if has("omega") else []
    ok = F.count_if(status == "ok")
    interior, step2 = yes(adjust == 0), yes(adjust.isin(1, 4, 5))
    entries += [("rates", "interior_full_universe", interior, cells), ("rates", "interior_conditional_on_ok", interior, ok), ("rates", "step2_full_universe", step2, cells)]
    one = stage1.agg(*[x.cast("long").alias(f"{k}{i}") for i, (_, _, n, d) in enumerate(entries) for k, x in (("n", n), ("d", d))])
    long = F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(m).alias("metric"), F.col(f"n{i}").alias("n"), F.col(f"d{i}").alias("denominator")) for i, (s, m, _, _) in enumerate(entries)]))
    return one.select(long.alias("e")).select("e.*")


def adjust_by_source(stage1: DataFrame) -> DataFrame:
    """(adjust, final_source, n): the routing cross table; null on both sides is a cell dropped before estimation."""
    return stage1.groupBy("adjust", "final_source").agg(F.count("*").alias("n"))


def stage2b_report(est: DataFrame, cap: float = 10.0) -> DataFrame:
    """(section, metric, value) of a stage 2b table, over rows that have sigma and gamma: sizes, quartiles, where sigma comes
    from (the cap, and the commonest other value, which is the fallback), gamma at its floor, error statuses, the
    robustness of sigma, and the median export-supply elasticity 1 / gamma."""
    rows = keep.kept(est.filter("sigma is not null and gamma is not null").select("importer", "exporter", "good", "sigma", "gamma", "gamma_se_status", "sigma_robust"))
    g, status, robust = F.col("gamma"), F.col("gamma_se_status"), F.col("sigma_robust")
    plain = {
        ("size", "rows"): F.count("*"), ("size", "importers"): F.countDistinct("importer"), ("size", "exporters"): F.countDistinct("exporter"), ("size", "sigmas"): F.countDistinct("importer", "good"),
        ("sigma_source", "n_cap"): F.count_if(F.col("sigma") == cap), ("gamma_floor", "n_floor"): F.count_if(g <= 0),
        ("se_status", "ok"): F.count_if(status == "ok"), ("se_status", "tier3_prior"): F.count_if(status == "tier3_prior"), ("se_status", "other"): F.count_if(~F.coalesce(status.isin("ok", "tier3_prior"), F.lit(False))),
        ("sigma_robust", "robust"): F.count_if(robust), ("sigma_robust", "not_robust"): F.count_if(~robust), ("sigma_robust", "unscreened"): F.count_if(robust.isNull()),
    }
    one = rows.agg(*[c.cast("double").alias("|".join(k)) for k, c in plain.items()])
    middle = {f"quantiles|{c}_{n}": (F.col(c), p) for c in ("sigma", "gamma") for n, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))}
    middle["quantiles|elasticity_median"] = (F.when(g > 0, 1 / g), 0.5)
    common = spike(rows, cap).agg(F.max("sigma").cast("double").alias("sigma_source|fallback_value"), F.max("n").cast("double").alias("sigma_source|n_fallback"))
    wide = order.same_keys(order.same_keys(one, order.quantiles(rows, [], middle), []), common, [])
    long = wide.unpivot([], [f"`{c}`" for c in wide.columns], "name", "value")
    return long.select(F.substring_index("name", "|", 1).alias("section"), F.substring_index("name", "|", -1).alias("metric"), "value")


def bootstrap_summary(cells: DataFrame) -> DataFrame:
    """(stratum, n_cells, n_ratio, med_yield, ratio_p25, ratio_med, ratio_p75, ratio_mad_med, share_within_25pct): how the
    bootstrap's spread compares with the reported error, by stratum and overall. cells: stratum, sigma_se, boot_sd,
    boot_mad_sd, boot_yield. Quantiles are over cells with a finite ratio, the yield over all."""
    ratio = F.try_divide(F.col("boot_sd"), F.col("sigma_se"))
    known = ratio.isNotNull() & ~F.isnan(ratio) & (F.abs(ratio) < float("inf"))
    rows = cells.select(
        F.explode(F.array(F.lit("OVERALL"), "stratum")).alias("stratum"), "boot_yield", F.when(known, ratio).alias("ratio"), F.when(known, F.try_divide(F.col("boot_mad_sd"), F.col("sigma_se"))).alias("mad_ratio"),
    )
    rows = keep.kept(rows)
    within = F.avg(F.when(F.col("ratio") > 0, (F.abs(F.log("ratio")) <= F.log(F.lit(1.25))).cast("double")).otherwise(F.when(F.col("ratio").isNotNull(), 0.0)))
    plain = rows.groupBy("stratum").agg(F.count("*").alias("n_cells"), F.count("ratio").alias("n_ratio"), within.alias("share_within_25pct"))
    middle = {"med_yield": (F.col("boot_yield"), 0.5), "ratio_p25": (F.col("ratio"), 0.25), "ratio_med": (F.col("ratio"), 0.5), "ratio_p75": (F.col("ratio"), 0.75), "ratio_mad_med": (F.col("mad_ratio"), 0.5)}
    return order.same_keys(plain, order.quantiles(rows, ["stratum"], middle), ["stratum"])
