"""Stage 2: gamma of every (importer, exporter, good) at given sigmas, first by region, then by country."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import columns as X
from ..functions import keep
from ..operators import moments as M
from ..operators import reports as R
from ..operators.panel import Config, assign_regions, viable_rows
from .batch_fit import Batch
from .resume import by_buckets

COLUMNS = (
    "importer", "exporter", "good", "sigma", "gamma", "gamma_se", "gamma_se_status", "gamma_exposure", "gamma_shrink_wt", "gamma_se_total", "sigma_robust", "sigma_se",
    "dgamma_dsigma", "ref_exporter", "opt_tariff", "opt_tariff_all", "convergence", "obj_value", "tier", "avg_trade",
)
_FIT = (
    "importer string, good string, exporter string, ref_exporter string, tier int, sigma double, gamma double, gamma_se double, gamma_se_status string, gamma_exposure int, "
    "gamma_shrink_wt double, dgamma_dsigma double, convergence int, obj_value double"
)


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], value: str, out: str, default: float) -> DataFrame:
    """rows plus ``out``: the table's value by keys, else the default. An equi-join that adaptive execution broadcasts
    while the table is small."""
    side = table.select(*keys, F.col(value).alias("__v"))
    return rows.join(side, keys, "left").withColumn(out, F.coalesce("__v", F.lit(default))).drop("__v")


def cell_inputs(panel: DataFrame, cfg: Config, sigma: DataFrame, sigma_default: float, priors: DataFrame, gamma_v: DataFrame, gamma_v_default: float, starts: DataFrame | None, start: float) -> DataFrame:
    """A row per (importer, good, exporter) with import moments, tier, weight, export moments of tier 1, and lookups.

    sigma: (importer, good, sigma); priors: (good, ln_gamma_prior); gamma_v: (importer, good, gamma); starts: (importer,
    good, gamma). Lookups are equi-joins; adaptive execution broadcasts those that are small."""
    rows = viable_rows(panel, cfg)
    base = M.exporter_weights(M.exporter_tiers(M.import_moments(rows, cfg), M.destination_counts(panel), cfg), cfg)
    exports = M.export_moments(panel, cfg)
    good_sigma = sigma.filter("sigma > 1")
    at_dest = lambda df: df.withColumnRenamed("importer", "ref_dest")
    side = looked_up(exports, at_dest(good_sigma), ["ref_dest", "good"], "sigma", "sv", sigma_default)
    side = looked_up(side, at_dest(gamma_v.filter("gamma > 0")), ["ref_dest", "good"], "gamma", "gv", gamma_v_default)
    out = looked_up(base.join(side, ["importer", "good", "exporter"], "left"), good_sigma, M.CELL, "sigma", "sigma", sigma_default)
    out = out.join(priors, "good", "left")
    return looked_up(out, starts, M.CELL, "gamma", "start", start) if starts is not None else out.withColumn("start", F.lit(start))


_KINDS = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
#: Rows of whole cells that are solved together.
BATCH_ROWS = 20_000


def _in_batches(inputs: DataFrame, solve, schema: str) -> DataFrame:
    """``solve(columns, of) -> columns`` for batches of whole cells; of: the cell number of each row. Cells are dealt by key,
    sorted and streamed; a task holds one batch, and a cell at least. Their number of partitions is fixed, so that
    adaptive execution does not merge fits by their few bytes."""
    fields = [c.split() for c in schema.split(", ")]

    def solved(table):
        columns = {c: table[c].to_numpy(zero_copy_only=False) for c in table.column_names}
        change = (columns["importer"][1:] != columns["importer"][:-1]) | (columns["good"][1:] != columns["good"][:-1])
        out = solve(columns, np.r_[0, np.cumsum(change)])
        return pa.RecordBatch.from_arrays([pa.array(out[n], _KINDS[k], from_pandas=True) for n, k in fields], names=[n for n, _ in fields])

    def part(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BATCH_ROWS:
                table = pa.Table.from_batches(held).combine_chunks()
                last = (table["importer"].to_numpy() == table["importer"][-1].as_py()) & (table["good"].to_numpy() == table["good"][-1].as_py())
                cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
                if cut:
                    yield solved(table.slice(0, cut))
                held, rows = table.slice(cut).to_batches(), table.num_rows - cut
        if rows:
            yield solved(pa.Table.from_batches(held).combine_chunks())

    dealt = inputs.repartition(keep.width(inputs.sparkSession), "importer", "good").sortWithinPartitions("importer", "good", "tier", "exporter")
    return dealt.mapInArrow(part, schema)


def _problem(cols: dict, rows: np.ndarray, of: np.ndarray, side: np.ndarray, weight: np.ndarray, heads: np.ndarray, prior: np.ndarray, lam, numeric: bool = False, printed: bool = False) -> Batch:
    """The second-stage problems over these rows, ``of`` their cell; side: those of them with an export side; heads: a row
    of each cell."""
    col = lambda c: cols[c][rows].astype(float)
    many = lambda cs: np.column_stack([col(c) for c in cs])
    return Batch(of, cols["sigma"][heads].astype(float), col("imp_y"), many(M.IMPORT_MOMENTS[1:]), weight, side, col("exp_y")[side], many(M.EXPORT_MOMENTS[1:])[side], col("sv")[side], col("gv")[side], prior, lam, numeric, printed)


def solve_cells(inputs: DataFrame, lam: float, gradient: str = "analytic", printed: bool = False) -> DataFrame:
    """solve_path for one shrinkage strength."""
    return solve_path(inputs, [lam], gradient, printed).drop("lambda")


def solve_path(inputs: DataFrame, lams: list[float], gradient: str = "analytic", printed: bool = False) -> DataFrame:
    """Fits every cell for every strength (column lambda), in one pass: the strongest shrinkage first, each weaker one from
    the solution of the one before, which lies near. The reference exporter is returned with tier 0, exporters of tier 3 with the prior (else the
    median of the cell's estimates), a cell with only tier 3 with the prior throughout, or nothing without one. Cells that
    a descent can't finish get a second try without derivatives. printed: signs of the export equation as published."""

    def solve(cols, of):
        heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        tiers, prior = cols["tier"].astype(int), cols["ln_gamma_prior"][heads].astype(float)
        est, rest = np.flatnonzero(tiers < 3), np.flatnonzero(tiers == 3)
        fitted = np.unique(of[est])
        mine = np.searchsorted(fitted, of[est])
        heads_f = heads[fitted]
        side = np.flatnonzero((tiers[est] == 1) & ~np.isnan(cols["exp_y"].astype(float)[est]))
        known, has = ~np.isnan(prior), np.isin(np.arange(len(heads)), fitted)
        rest = rest[has[of[rest]] | known[of[rest]]]  # a cell without estimates and prior has no rows
        at, found = (cols["start"][heads_f].astype(float), None), []
        for lam in sorted(set(lams), reverse=True):
            p = _problem(cols, est, mine, side, cols["weight"][est].astype(float), heads_f, prior[fitted], lam, gradient == "numeric", printed)
            solved = p.fit_or_search(*at)
            at = solved[:2]
            found.append(rows_of(cols, of, heads, tiers, prior, est, rest, fitted, mine, known, has, p, *solved) | {"lambda": np.full(len(heads_f) + len(est) + len(rest) + (~has & known).sum(), lam)})
        return {c: np.concatenate([f[c] for f in found]) for c in found[0]}

    def rows_of(cols, of, heads, tiers, prior, est, rest, fitted, mine, known, has, p, gk, gj, value, code):
        heads_f = heads[fitted]
        middle = np.full(len(heads), np.nan)
        middle[fitted] = [np.median(x) for x in np.split(gj, np.flatnonzero(np.diff(mine)) + 1)] if len(est) else []
        (sk, how_k, ek, wk), (sj, how_j, ej, wj) = p.errors(gk, gj)
        dk, dj = p.slopes(gk, gj)
        fill = np.where(known, np.exp(prior), middle)
        lone = np.flatnonzero(~has & known)
        good, goods = code == 0, (code == 0)[mine]

        def of_kind(k, j, r, one):
            """A column over references of fitted cells, estimates, rows left to the prior, references of other cells."""
            return np.concatenate([np.asarray(x, object) for x in (k, j, r, one)])

        null = lambda at: np.full(len(at), None, object)
        when = lambda ok, x, other=None: np.where(ok, np.asarray(x, object), other)
        number = lambda x: when(~np.isnan(x), x)
        where = np.r_[heads_f, est, rest, heads[lone]]
        return {c: cols[c][where] for c in ("importer", "good", "ref_exporter")} | {
            "exporter": of_kind(cols["ref_exporter"][heads_f], cols["exporter"][est], cols["exporter"][rest], cols["ref_exporter"][heads[lone]]),
            "tier": of_kind(np.zeros(len(fitted), int), tiers[est], np.full(len(rest), 3), np.zeros(len(lone), int)),
            "sigma": number(cols["sigma"][where].astype(float)), "gamma": of_kind(number(gk), number(gj), number(fill[of[rest]]), number(fill[lone])),
            "gamma_se": of_kind(when(good, number(sk)), when(goods, number(sj)), null(rest), null(lone)),
            "gamma_se_status": of_kind(when(good, how_k, "non_converged"), when(goods, how_j, "non_converged"), when(has[of[rest]], np.full(len(rest), "tier3_prior", object)), null(lone)),
            "gamma_exposure": of_kind(when(good, ek), when(goods, ej), null(rest), null(lone)), "gamma_shrink_wt": of_kind(when(good, number(wk)), when(goods, number(wj)), null(rest), null(lone)),
            "dgamma_dsigma": of_kind(when(good, number(dk)), when(goods, number(dj)), null(rest), null(lone)),
            "convergence": of_kind(code, code[mine], np.full(len(rest), -1), np.full(len(lone), -1)), "obj_value": of_kind(value, value[mine], null(rest), null(lone)),
        }

    return _in_batches(inputs, solve, f"{_FIT}, lambda double")


def lambda_sweep(inputs: DataFrame, lams: list[float], cutoff: float = 20.0) -> DataFrame:
    """One row of diagnostics (reports.calibration) for each shrinkage strength. inputs as for solve_cells; all strengths
    come from one pass over the cells."""
    fits = keep.kept(solve_path(inputs, lams))
    rows = [R.calibration(fits.filter(F.col("lambda") == lam), lam, cutoff) for lam in lams]
    return reduce(DataFrame.unionByName, rows)


def solve_joint(inputs: DataFrame) -> DataFrame:
    """(importer, exporter, good, sigma, gamma, ref_exporter, convergence, obj_value): sigma and all gammas of a cell in one
    problem, every exporter with its export side, unweighted and without a prior. inputs as for solve_cells."""

    def solve(cols, of):
        heads, rows = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), np.arange(len(of))
        p = _problem(cols, rows, of, np.flatnonzero(~np.isnan(cols["exp_y"].astype(float))), np.ones(len(of)), heads, np.full(len(heads), np.nan), 0.0)
        sigma, gk, gj, value, code = p.joint(cols["start"][heads].astype(float))
        where, cell = np.r_[rows, heads], np.r_[of, np.arange(len(heads))]
        return {c: cols[c][where] for c in ("importer", "good", "ref_exporter")} | {
            "exporter": np.r_[cols["exporter"], cols["ref_exporter"][heads]], "sigma": sigma[cell], "gamma": np.r_[gj, gk], "convergence": code[cell], "obj_value": value[cell],
        }

    return _in_batches(inputs, solve, "importer string, exporter string, good string, sigma double, gamma double, ref_exporter string, convergence int, obj_value double")


def with_sigma_errors(fits: DataFrame, sigma_se: DataFrame | None) -> DataFrame:
    """sigma_se, sigma_robust and gamma_se_total: sigma's own error carried into gamma where the cell allows it.

    sigma_se: (importer, good, sigma_se, adjust). Rows of tier 3 have none of the three; a slope without an error of sigma
    to carry is not reported."""
    if sigma_se is None:
        fits = fits.withColumns({"sigma_se": F.lit(None).cast("double"), "adjust": F.lit(None).cast("int")})
    else:
        fits = fits.join(sigma_se.select("importer", "good", "sigma_se", "adjust"), ["importer", "good"], "left")
    used = F.col("tier") < 3
    fits = fits.withColumn("dgamma_dsigma", F.when(F.abs("sigma_se") < float("inf"), F.col("dgamma_dsigma")))
    carried = F.abs("dgamma_dsigma") * F.col("sigma_se")
    inflation = F.sqrt(F.pow("gamma_se", 2) + carried * carried) / F.col("gamma_se")
    worst = F.max(F.when(used & (F.col("gamma_se") > 0) & carried.isNotNull(), inflation)).over(W.partitionBy("importer", "good"))
    fits = fits.withColumn("sigma_robust", F.when(used & F.col("gamma_se_status").isNotNull(), X.sigma_robust(F.col("sigma"), F.col("sigma_se"), F.col("adjust"), worst)))
    return fits.withColumns({
        "gamma_se_total": F.when(F.coalesce("sigma_robust", F.lit(False)), F.sqrt(F.pow("gamma_se", 2) + carried * carried)), "sigma_se": F.when(F.col("sigma_robust").isNotNull(), F.col("sigma_se")),
    }).drop("adjust")


def with_tariffs(fits: DataFrame, panel: DataFrame) -> DataFrame:
    """avg_trade of each flow, and the cell's optimal tariff over estimated and over all exporters."""
    trade = panel.groupBy("importer", "good", "exporter").agg(F.avg("cusval").alias("avg_trade"))
    return cell_tariffs(fits.join(trade, ["importer", "good", "exporter"], "left"))


def cell_tariffs(fits: DataFrame) -> DataFrame:
    cell = W.partitionBy("importer", "good")
    ok = (F.col("gamma") > 0) & (F.col("avg_trade") > 0)
    scale = F.col("avg_trade") / (1 + F.col("gamma") * F.col("sigma"))
    tariff = lambda where: F.try_divide(F.sum(F.when(where, scale * F.col("gamma"))).over(cell), F.sum(F.when(where, scale)).over(cell))
    return fits.withColumns({"opt_tariff": tariff(ok & (F.col("tier") < 3)), "opt_tariff_all": tariff(ok)})


def trim_bounds(fits: DataFrame, share: float, least: int = 100) -> dict[str, list[float | None]]:
    """Quantiles of sigma and gamma over rows below tier 3, or over all rows if these are fewer than least; exact, by range
    partitions, whatever the number of rows."""
    used = fits.filter("coalesce(tier < 3, true)")
    base = used if used.limit(least).count() >= least else fits
    return {c: keep.quantiles(base, c, [share, 1 - share]) for c in ("sigma", "gamma")}


def tail_trim(fits: DataFrame, share: float | None) -> DataFrame:
    """Rows within the bounds of both sigma and gamma. The bounds, four numbers, need all estimates: a barrier."""
    if not share:
        return fits
    have = keep.kept(fits.filter("sigma is not null and gamma is not null"))
    for c, (lo, hi) in trim_bounds(have, share).items():
        have = have.filter(F.col(c).between(lo, hi))
    return have


def plateau_fallback(fits: DataFrame, priors: DataFrame, threshold: float) -> DataFrame:
    """Estimated gammas above the threshold take the good's prior if there is one, and the cell's tariffs follow."""
    joined = fits.join(priors, "good", "left")
    hit = (F.col("gamma") > threshold) & (F.col("tier") != 3) & F.col("ln_gamma_prior").isNotNull()
    touched = F.max(F.coalesce(hit, F.lit(False))).over(W.partitionBy("importer", "good"))
    out = joined.withColumns({"__hit": F.coalesce(hit, F.lit(False)), "__touched": touched, "__o": F.col("opt_tariff"), "__a": F.col("opt_tariff_all")})
    out = out.withColumns({"gamma": F.when(F.col("__hit"), F.exp("ln_gamma_prior")).otherwise(F.col("gamma")), **{c: F.when(~F.col("__hit"), F.col(c)) for c in ("gamma_se", "gamma_se_total")}, "gamma_se_status": F.when(F.col("__hit"), "plateau_fallback").otherwise(F.col("gamma_se_status"))})
    out = cell_tariffs(out)
    return out.withColumns({c: F.when(F.col("__touched"), F.col(c)).otherwise(F.col(o)) for c, o in (("opt_tariff", "__o"), ("opt_tariff_all", "__a"))}).drop("__hit", "__touched", "__o", "__a", "ln_gamma_prior")


def run_stage2(panel: DataFrame, cfg: Config, lam: float, sigma: DataFrame, sigma_default: float, priors: DataFrame, gamma_v: DataFrame, gamma_v_default: float, starts: DataFrame | None = None, start: float | None = None, sigma_se: DataFrame | None = None, resume: str | None = None) -> DataFrame:
    """panel: prepared; it is written once, as several branches read it. The published columns, one row per (importer,
    exporter, good). resume: a path for fits by bucket, from which a run that was stopped goes on."""
    panel = keep.kept(panel)
    inputs = cell_inputs(panel, cfg, sigma, sigma_default, priors, gamma_v, gamma_v_default, starts, gamma_v_default if start is None else start)
    solve = lambda rows: solve_cells(rows, lam, cfg.stage2_gradient, cfg.printed_signs)
    solved = by_buckets(keep.kept(inputs), solve, resume) if resume else solve(inputs)
    fits = with_tariffs(with_sigma_errors(solved, sigma_se), panel)
    return tail_trim(fits.select(*COLUMNS), cfg.tail_trim)


def run_joint(panel: DataFrame, cfg: Config, sigma: DataFrame, sigma_default: float, gamma_v: DataFrame, gamma_v_default: float, start: float | None = None) -> DataFrame:
    """The joint path: sigma is estimated with the gammas; the lookups only serve the reference destinations."""
    panel = keep.kept(panel)
    none = panel.select("good").distinct().withColumn("ln_gamma_prior", F.lit(None).cast("double"))
    return solve_joint(cell_inputs(panel, cfg, sigma, sigma_default, none, gamma_v, gamma_v_default, None, gamma_v_default if start is None else start))


def regional_sigma(clean: DataFrame, regions: DataFrame) -> DataFrame:
    return assign_regions(clean, regions, "importer").groupBy("importer", "good").agg(F.median("sigma").alias("sigma"))


def regional_gamma(regional: DataFrame) -> DataFrame:
    """Median gamma by (importer region, good), of rows of every tier that have a sigma and a positive gamma."""
    return regional.filter("sigma is not null and gamma > 0").groupBy("importer", "good").agg(F.median("gamma").alias("gamma"))


def regional_starts(regional: DataFrame) -> DataFrame:
    """Starting gammas by (importer region, good): the same over rows whose sigma is above 1."""
    return regional_gamma(regional.filter("sigma > 1"))


def regional_priors(regional: DataFrame) -> DataFrame:
    """(good, ln_gamma_prior): median log gamma over rows of every tier that have a sigma and a positive gamma."""
    return regional.filter("sigma is not null and gamma > 0").groupBy("good").agg(F.median(F.log("gamma")).alias("ln_gamma_prior"))


def by_country(regional: DataFrame, countries: DataFrame, regions: DataFrame) -> DataFrame:
    """Values by (region, good) handed to each country of the region."""
    named = assign_regions(countries.select(F.col("importer").alias("country"), F.col("importer").cast("int").alias("importer")).distinct(), regions, "importer")
    return named.join(regional, "importer").select(F.col("country").alias("importer"), *[c for c in regional.columns if c != "importer"])
