"""Named queries over the test tables, with the SQL that gives the same rows.

Trade comes from the order tables (sources.trade.from_orders). Queries about estimates run on ``estimates``: values by
plain arithmetic on the keys, so that both sides agree on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as X
from .functions import keep, order
from .operators import census as N
from .operators import feenstra as H
from .operators import liml as I
from .operators import moments as M
from .operators import panel as P
from .operators import reports as R
from .operators import selection as L
from .operators import summary as S
from .plans import bootstrap as B
from .plans import stage1 as S1
from .plans import stage2 as S2
from .sources import trade as T

CFG = P.Config()
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def trade(spark: SparkSession, d: str) -> DataFrame:
    return T.rename(T.from_orders(spark, d))


def raw(spark, d):
    return P.raw_panel(trade(spark, d), CFG)


def prepared(spark, d):
    return P.prepare(raw(spark, d), CFG)


def regions(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    return n.filter("n_nationkey < 20").select(F.col("n_nationkey").cast("int").alias("cty_code"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("region"))


def estimates(spark, d) -> DataFrame:
    flows = raw(spark, d).groupBy("importer", "exporter", "good").agg(F.avg("cusval").alias("avg_trade"))
    g = F.substring("good", 4, 1).cast("int")
    out = flows.withColumns({
        "sigma": 1.2 + ((F.col("importer") * 11 + g * 3) % 40) / 8, "gamma": 0.2 + ((F.col("importer") * 7 + F.col("exporter") * 13 + g * 5) % 97) / 4, "tier": (F.col("importer") + F.col("exporter")) % 4,
        "gamma_se": 0.05 + ((F.col("exporter") * 3 + F.col("importer")) % 11) / 16, "sigma_se": F.when(F.col("importer") % 7 != 0, 0.0625 + (F.col("importer") % 9) / 64),
        "dgamma_dsigma": ((F.col("exporter") * 5 + F.col("importer")) % 13 - 6) / 8, "adjust": (F.col("importer") + g) % 6,
    })
    status = F.when(F.col("tier") == 3, "tier3_prior").when(F.col("gamma") > 20, "plateau").when(F.col("gamma") < 1, "boundary").otherwise("ok")
    source = F.when(F.col("adjust") == 0, "hliml").when(F.col("adjust") < 4, "hliml_boundary").otherwise("step2_weighted")
    return out.withColumns({"gamma_se_status": status, "final_source": source, "status": F.when(F.col("adjust") == 3, "all_inversions_failed").when(F.col("adjust") == 5, "thin_panel_e1_t2").otherwise("ok")})


def estimate_cells(spark, d) -> DataFrame:
    return estimates(spark, d).groupBy("importer", "good").agg(*[F.min(c).alias(c) for c in ("sigma", "adjust", "final_source", "status", "sigma_se")], F.lit(1.0).alias("gamma"))


_TRADE = """trade AS (SELECT year(l_shipdate)::INT AS year, s_nationkey::INT AS exporter, c_nationkey::INT AS importer,
  '10' || list_position(['ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD'], p_type) || lpad(p_size::VARCHAR, 2, '0') AS good, l_extendedprice::DOUBLE AS cusval, l_quantity::DOUBLE AS quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE c_nationkey <> s_nationkey)"""
_RAW = _TRADE + """,
raw AS (SELECT year, substr(lpad(good, 6, '0'), 1, 4) AS good, importer, exporter, sum(cusval) AS cusval, sum(quantity) AS quantity FROM trade WHERE cusval > 0 AND quantity > 0 AND year >= 1995 GROUP BY ALL)"""
_SH = _RAW + """,
sh AS (SELECT year, good, importer, exporter, cusval, quantity, year - 1994 AS t, ln(cusval / quantity) AS lp,
  sum(cusval) OVER (PARTITION BY importer, good, year) AS imp_total, sum(cusval) OVER (PARTITION BY exporter, good, year) AS exp_total FROM raw),
sl AS (SELECT *, cusval / imp_total AS s_imp, ln(cusval / imp_total) AS ls_imp, cusval / exp_total AS s_exp, ln(cusval / exp_total) AS ls_exp FROM sh)"""
_DIF = _SH + """,
dif AS (SELECT *, CASE WHEN t - lag(t) OVER w = 1 THEN lp - lag(lp) OVER w END AS lp_dif, CASE WHEN t - lag(t) OVER w = 1 THEN ls_imp - lag(ls_imp) OVER w END AS ls_imp_dif,
  CASE WHEN t - lag(t) OVER w = 1 THEN ls_exp - lag(ls_exp) OVER w END AS ls_exp_dif, count(*) OVER (PARTITION BY importer, exporter, good) AS period_count
  FROM sl WINDOW w AS (PARTITION BY importer, exporter, good ORDER BY t)),
prep AS (SELECT * REPLACE (importer::VARCHAR AS importer, exporter::VARCHAR AS exporter) FROM dif WHERE abs(lp_dif) < 2.0)"""
_REF = """,
rs AS (SELECT importer, good, exporter, count(DISTINCT t) AS n_periods, sum(cusval) AS total_value FROM prep GROUP BY ALL),
ref AS (SELECT importer, good, exporter AS ref_exporter, n_periods, total_value FROM rs QUALIFY row_number() OVER (PARTITION BY importer, good ORDER BY n_periods DESC, total_value DESC, exporter) = 1)"""
_LAG = """,
lagged AS (SELECT p.*, q.cusval AS cusval_lag FROM prep p LEFT JOIN prep q ON q.importer = p.importer AND q.exporter = p.exporter AND q.good = p.good AND q.t = p.t - 1)"""
_BW = "CASE WHEN cusval_lag IS NULL THEN 1.0 ELSE pow({n}, 1.5) / sqrt(1 / cusval + 1 / cusval_lag) END"
_IMP = _DIF + _REF + _LAG + """,
im AS (SELECT l.*, ref.ref_exporter, r.lp_dif AS rp, r.ls_imp_dif AS rl, """ + _BW.format(n="l.period_count").replace("cusval", "l.cusval") + """ AS bw FROM lagged l JOIN ref USING (importer, good)
  JOIN prep r ON r.importer = l.importer AND r.good = l.good AND r.exporter = ref.ref_exporter AND r.t = l.t WHERE l.exporter <> ref.ref_exporter),
imom AS (SELECT importer, good, exporter, ref_exporter, sum(bw * (lp_dif - rp) ** 2) / sum(bw) AS imp_y, sum(bw * (ls_imp_dif - rl) ** 2) / sum(bw) AS imp_x1,
  sum(bw * (ls_imp_dif - rl) * (lp_dif - rp)) / sum(bw) AS imp_x2, sum(bw * (ls_imp_dif - rl) * lp_dif) / sum(bw) AS imp_x3, sum(bw * (ls_imp_dif - rl) * rp) / sum(bw) AS imp_x4,
  sum(bw * (lp_dif - rp) * rp) / sum(bw) AS imp_x5, count(DISTINCT t) AS n_periods, sum(cusval) AS value FROM im GROUP BY ALL),
dests AS (SELECT good, exporter, count(DISTINCT importer) AS n_dests_total FROM prep GROUP BY ALL),
tiers AS (SELECT imom.*, greatest(coalesce(n_dests_total, 0) - 1, 0) AS n_dests,
  CASE WHEN n_periods >= 3 AND greatest(coalesce(n_dests_total, 0) - 1, 0) >= 2 THEN 1 WHEN n_periods >= 3 THEN 2 ELSE 3 END AS tier FROM imom LEFT JOIN dests USING (good, exporter))"""
_EXP = _DIF + _LAG + """,
dv AS (SELECT good, exporter, importer, sum(cusval) AS v FROM prep GROUP BY ALL),
pick AS (SELECT f.good, f.exporter, f.importer, d.importer AS ref_dest FROM dv f JOIN dv d ON d.good = f.good AND d.exporter = f.exporter AND d.importer <> f.importer
  QUALIFY row_number() OVER (PARTITION BY f.good, f.exporter, f.importer ORDER BY d.v DESC, d.importer) = 1),
ex AS (SELECT l.*, pick.ref_dest, r.lp_dif AS rp, r.ls_exp_dif AS rl, count(*) OVER (PARTITION BY l.good, l.exporter, l.importer) AS pd FROM lagged l JOIN pick USING (good, exporter, importer)
  JOIN prep r ON r.importer = pick.ref_dest AND r.good = l.good AND r.exporter = l.exporter AND r.t = l.t),
ew AS (SELECT *, """ + _BW.format(n="pd") + """ AS bw FROM ex),
emom AS (SELECT importer, good, exporter, ref_dest, sum(bw * (lp_dif - rp) ** 2) / sum(bw) AS exp_y, sum(bw * ls_exp_dif ** 2) / sum(bw) AS exp_x1, sum(bw * ls_exp_dif * lp_dif) / sum(bw) AS exp_x2,
  sum(bw * rl ** 2) / sum(bw) AS exp_x3, sum(bw * rl * lp_dif) / sum(bw) AS exp_x4, sum(bw * rl * rp) / sum(bw) AS exp_x5, sum(bw * ls_exp_dif * rp) / sum(bw) AS exp_x6,
  sum(bw * ls_exp_dif * rl) / sum(bw) AS exp_x7, sum(bw * rp ** 2) / sum(bw) AS exp_x8, sum(bw * rp * lp_dif) / sum(bw) AS exp_x9 FROM ew GROUP BY ALL)"""
_M1 = _RAW + """,
c AS (SELECT importer, good, exporter, year AS t, cusval, ln(cusval / quantity) AS lp, ln(cusval / sum(cusval) OVER (PARTITION BY importer, good, year)) AS ls FROM raw),
cd AS (SELECT *, CASE WHEN t - lag(t) OVER w = 1 THEN lp - lag(lp) OVER w END AS p, CASE WHEN t - lag(t) OVER w = 1 THEN ls - lag(ls) OVER w END AS s FROM c WINDOW w AS (PARTITION BY importer, good, exporter ORDER BY t)),
cr AS (SELECT importer, good, exporter AS ref_exporter FROM (SELECT importer, good, exporter, count(*) AS n, sum(cusval) AS v FROM c GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY importer, good ORDER BY n DESC, v DESC, exporter) = 1),
mo AS (SELECT a.importer, a.good, a.exporter, cr.ref_exporter, a.t, (a.p - b.p) ** 2 AS y, (a.s - b.s) ** 2 AS x1, (a.p - b.p) * (a.s - b.s) AS x2 FROM cd a JOIN cr USING (importer, good)
  JOIN cd b ON b.importer = a.importer AND b.good = a.good AND b.exporter = cr.ref_exporter AND b.t = a.t),
m1 AS (SELECT * FROM mo WHERE y IS NOT NULL AND x1 IS NOT NULL AND NOT (y = 0 AND x1 = 0 AND x2 = 0)),
gs AS (SELECT importer, good, exporter, count(*) AS n, sum(y) AS s_y, sum(x1) AS s_x1, sum(x2) AS s_x2, sum(y * y) AS s_y_y, sum(y * x1) AS s_y_x1, sum(y * x2) AS s_y_x2, sum(x1 * x1) AS s_x1_x1, sum(x1 * x2) AS s_x1_x2, sum(x2 * x2) AS s_x2_x2 FROM m1 GROUP BY ALL)"""
_EST = _RAW + """,
e0 AS (SELECT importer, exporter, good, avg(cusval) AS avg_trade, substr(good, 4, 1)::INT AS g FROM raw GROUP BY ALL),
e1 AS (SELECT importer, exporter, good, avg_trade, 1.2::DOUBLE + ((importer * 11 + g * 3) % 40) / 8::DOUBLE AS sigma, 0.2::DOUBLE + ((importer * 7 + exporter * 13 + g * 5) % 97) / 4::DOUBLE AS gamma, (importer + exporter) % 4 AS tier,
  0.05::DOUBLE + ((exporter * 3 + importer) % 11) / 16::DOUBLE AS gamma_se, CASE WHEN importer % 7 <> 0 THEN 0.0625::DOUBLE + (importer % 9) / 64::DOUBLE END AS sigma_se,
  ((exporter * 5 + importer) % 13 - 6) / 8::DOUBLE AS dgamma_dsigma, (importer + g) % 6 AS adjust FROM e0),
est AS (SELECT *, CASE WHEN tier = 3 THEN 'tier3_prior' WHEN gamma > 20 THEN 'plateau' WHEN gamma < 1 THEN 'boundary' ELSE 'ok' END AS gamma_se_status,
  CASE WHEN adjust = 0 THEN 'hliml' WHEN adjust < 4 THEN 'hliml_boundary' ELSE 'step2_weighted' END AS final_source,
  CASE WHEN adjust = 3 THEN 'all_inversions_failed' WHEN adjust = 5 THEN 'thin_panel_e1_t2' ELSE 'ok' END AS status FROM e1),
ecell AS (SELECT importer, good, min(sigma) AS sigma, min(adjust) AS adjust, min(final_source) AS final_source, min(status) AS status, min(sigma_se) AS sigma_se FROM est GROUP BY ALL)"""


def query(name: str, sql: str | None = None, places: int = 6, money: tuple[str, ...] = ()):
    """Registers a query; doubles are rounded on both sides (money to 2 places)."""

    def add(f):
        def run(spark, d):
            df = f(spark, d)
            return df.select(*[F.round(c, 2 if c in money else places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def r(*cols: str, places: int = 6) -> str:
    return ", ".join(f"round({c}, {places}) + 0.0::DOUBLE AS {c.split('.')[-1]}" for c in cols)


@query("panel_scan_project", f"WITH {_TRADE} SELECT year, good, importer, exporter, count(*) AS n, round(sum(cusval), 2) AS cusval FROM trade GROUP BY ALL", money=("cusval",))
def _(s, d):
    return trade(s, d).groupBy("year", "good", "importer", "exporter").agg(F.count("*").alias("n"), F.sum("cusval").alias("cusval"))


@query("hs6_pad_rollup", f"WITH {_RAW} SELECT year, good, importer, exporter, round(cusval, 2) AS cusval, round(quantity, 2) AS quantity FROM raw", money=("cusval", "quantity"))
def _(s, d):
    return raw(s, d)


@query("clean_filter", f"WITH {_TRADE} SELECT year, count(*) AS n, round(sum(cusval), 2) AS cusval FROM trade WHERE cusval > 1000 AND quantity > 0 AND year BETWEEN 1996 AND 1998 AND length(lpad(good, 6, '0')) = 6 GROUP BY year", money=("cusval",))
def _(s, d):
    return P.clean(trade(s, d), CFG.with_(minyear=1996, maxyear=1998)).filter("cusval > 1000").groupBy("year").agg(F.count("*").alias("n"), F.sum("cusval").alias("cusval"))


_RMAP = "rm AS (SELECT n_nationkey::INT AS c, 'R' || n_regionkey AS region FROM nation WHERE n_nationkey < 20)"


@query("region_rollup", f"WITH {_RAW}, {_RMAP} SELECT year, good, coalesce(a.region, 'OTHER') AS importer, coalesce(b.region, 'OTHER') AS exporter, round(sum(cusval), 2) AS cusval, round(sum(quantity), 2) AS quantity FROM raw LEFT JOIN rm a ON importer = a.c LEFT JOIN rm b ON exporter = b.c GROUP BY ALL", money=("cusval", "quantity"))
def _(s, d):
    return P.regional_panel(raw(s, d), regions(s, d))


@query("unit_values_shares", f"WITH {_SH} SELECT year, good, importer, exporter, t, {r('lp', 's_imp', 'ls_imp', 's_exp', 'ls_exp')} FROM sl")
def _(s, d):
    return P.shares(raw(s, d), CFG).select("year", "good", "importer", "exporter", "t", "lp", "s_imp", "ls_imp", "s_exp", "ls_exp")


@query("first_diff_guarded", f"WITH {_DIF} SELECT good, importer, exporter, t, period_count::INT AS period_count, {r('lp_dif', 'ls_imp_dif', 'ls_exp_dif')} FROM dif WHERE lp_dif IS NOT NULL")
def _(s, d):
    return P.differences(P.shares(raw(s, d), CFG)).filter("lp_dif is not null").select("good", "importer", "exporter", "t", "period_count", "lp_dif", "ls_imp_dif", "ls_exp_dif")


@query("uv_outlier", f"WITH {_DIF} SELECT importer, good, count(*) AS n, round(max(abs(lp_dif)), 6) AS largest FROM prep GROUP BY ALL")
def _(s, d):
    return prepared(s, d).groupBy("importer", "good").agg(F.count("*").alias("n"), F.max(F.abs("lp_dif")).alias("largest"))


@query("cell_viability", f"WITH {_DIF} SELECT importer, good, count(DISTINCT exporter) AS n_exporters, max(period_count)::INT AS max_periods, count(DISTINCT exporter) >= 2 AND max(period_count) >= 3 AS viable FROM prep GROUP BY ALL")
def _(s, d):
    return P.cell_viability(prepared(s, d), CFG)


@query("cell_stats", f"WITH {_DIF}, k AS (SELECT count(DISTINCT exporter) AS e, count(DISTINCT t) AS p FROM prep GROUP BY importer, good) SELECT count(*) AS cells, median(e::DOUBLE) AS median_exporters, round(avg(e), 6) AS mean_exporters, median(p::DOUBLE) AS median_periods, round(avg(p), 6) AS mean_periods FROM k")
def _(s, d):
    return P.cell_stats(prepared(s, d))


@query("choose_reference", f"WITH {_DIF}{_REF} SELECT importer, good, ref_exporter, n_periods, round(total_value, 2) AS total_value FROM ref", money=("total_value",))
def _(s, d):
    return M.choose_reference(prepared(s, d))


@query("stage1_moments", f"WITH {_M1} SELECT importer, good, exporter, ref_exporter, t, {r('y', 'x1', 'x2')} FROM m1")
def _(s, d):
    return M.stage1_moments(raw(s, d))


@query("stage1_group_sums", f"WITH {_M1} SELECT importer, good, exporter, n, {r('s_y', 's_x1', 's_x2', 's_y_y', 's_y_x1', 's_y_x2', 's_x1_x1', 's_x1_x2', 's_x2_x2', places=5)} FROM gs", places=5)
def _(s, d):
    return M.group_sums(M.stage1_moments(raw(s, d)))


_CD = _M1 + """,
cs AS (SELECT importer, good, sum(n) AS n, count(*) AS k, sum(s_x1) AS t1, sum(s_x2) AS t2, sum(s_x1_x1) AS t11, sum(s_x1_x2) AS t12, sum(s_x2_x2) AS t22, sum(s_x1 * s_x1 / n) AS b11, sum(s_x1 * s_x2 / n) AS b12, sum(s_x2 * s_x2 / n) AS b22 FROM gs GROUP BY ALL),
cm AS (SELECT *, b11 - t1 * t1 / n AS a11, b12 - t1 * t2 / n AS a12, b22 - t2 * t2 / n AS a22, (t11 - b11) / nullif(n - k, 0) AS c11, (t12 - b12) / nullif(n - k, 0) AS c12, (t22 - b22) / nullif(n - k, 0) AS c22 FROM cs),
cz AS (SELECT *, (a11 * c22 + a22 * c11 - 2 * a12 * c12) / nullif(c11 * c22 - c12 * c12, 0) AS tr, (a11 * a22 - a12 * a12) / nullif(c11 * c22 - c12 * c12, 0) AS dt FROM cm)"""


@query("cragg_donald_2x2", f"WITH {_CD} SELECT importer, good, n::BIGINT AS n, k AS n_exporters, round((tr / 2 - sqrt(greatest(tr * tr / 4 - dt, 0.0))) / nullif(k - 1, 0), 4) AS f FROM cz WHERE n > k + 3", places=4)
def _(s, d):
    return M.cragg_donald(M.group_sums(M.stage1_moments(raw(s, d)))).filter("n > n_exporters + 3")


_ETA = "eta AS (SELECT importer, exporter, good, ((importer * 3 + exporter * 5 + g) % 31 - 3) / 8::DOUBLE AS eta1, ((importer * 7 + exporter + g * 2) % 29 - 14) / 16::DOUBLE AS eta2 FROM e0)"


def _etas(s, d):
    g = F.substring("good", 4, 1).cast("int")
    return estimates(s, d).select("importer", "exporter", "good", (((F.col("importer") * 3 + F.col("exporter") * 5 + g) % 31 - 3) / 8).alias("eta1"), (((F.col("importer") * 7 + F.col("exporter") + g * 2) % 29 - 14) / 16).alias("eta2"))


_INV = _EST + f""", {_ETA},
i1 AS (SELECT *, CASE WHEN eta1 > 0 THEN 0.25 - 1 / (4 + eta2 * eta2 / eta1) END AS disc FROM eta),
i2 AS (SELECT *, CASE WHEN disc >= 0 THEN least(greatest(CASE WHEN eta2 > 0 THEN 0.5 + sqrt(disc) ELSE 0.5 - sqrt(disc) END, 1e-4::DOUBLE), 0.999::DOUBLE) END AS rho0 FROM i1),
i3 AS (SELECT *, CASE WHEN rho0 IS NOT NULL AND eta2 <> 0 THEN 1 + (2 * rho0 - 1) / ((1 - rho0) * eta2) END AS s0 FROM i2),
i4 AS (SELECT *, CASE WHEN s0 > 1 THEN least(s0, 1000.0::DOUBLE) END AS s1 FROM i3),
i5 AS (SELECT *, s1 - 1 - s1 * rho0 AS den FROM i4),
i6 AS (SELECT *, CASE WHEN eta1 <= 0 THEN 'eta1_nonpositive' WHEN disc < 0 THEN 'neg_discriminant' WHEN s1 IS NULL THEN 'sigma_below_1' WHEN abs(den) < 1e-12 THEN 'omega_div_zero' WHEN rho0 < (s1 - 1) / s1 THEN 'ok' ELSE 'constraint_violated' END AS status FROM i5),
inv AS (SELECT importer, exporter, good, s1 AS sigma, rho0 AS rho, CASE WHEN status IN ('ok', 'constraint_violated') THEN least(greatest(rho0 / den, 1e-4::DOUBLE), 1000.0::DOUBLE) END AS omega, status FROM i6)"""


@query("invert_structural", f"WITH {_INV} SELECT importer, exporter, good, {r('sigma', 'rho', 'omega', places=5)}, status FROM inv", places=5)
def _(s, d):
    return X.invert_structural(_etas(s, d), "eta1", "eta2").drop("eta1", "eta2")


@query("delta_method", f"""WITH {_INV}, v AS (SELECT *, 0.01::DOUBLE AS v11, 0.002::DOUBLE AS v12, 0.03::DOUBLE AS v22, -pow(sigma - 1, 3) * (1 - rho) AS a, pow(sigma - 1, 2) * (1 - rho) AS b, (1 - 2 * rho) * pow(sigma - 1, 2) * pow(1 - rho, 2) AS c,
 2 * rho * (sigma - 1) * pow(1 - rho, 2) AS e FROM inv), w AS (SELECT *, greatest(a * a * v11 + 2 * a * b * v12 + b * b * v22, 0.0) AS vs, greatest(c * c * v11 + 2 * c * e * v12 + e * e * v22, 0.0) AS vr,
 a * c * v11 + (a * e + b * c) * v12 + b * e * v22 AS cov, pow(sigma * (rho - 1) + 1, 4) AS d4 FROM v), z AS (SELECT *, (pow(rho, 2) * pow(1 - rho, 2) * vs + pow(sigma - 1, 2) * vr - 2 * (sigma - 1) * rho * (1 - rho) * cov) / nullif(d4, 0) AS vo FROM w)
 SELECT importer, exporter, good, CASE WHEN status = 'ok' AND sigma < 50 AND d4 >= 1e-3 THEN round(sqrt(vs), 4) END AS sigma_se, CASE WHEN status = 'ok' AND sigma < 50 AND d4 >= 1e-3 THEN round(sqrt(vr), 4) END AS rho_se, CASE WHEN status = 'ok' AND sigma < 50 AND d4 >= 1e-3 AND vo >= 0 THEN round(sqrt(vo), 4) END AS omega_se FROM z""", places=4)
def _(s, d):
    se = X.delta_ses(X.invert_structural(_etas(s, d), "eta1", "eta2"), "sigma", "rho", F.lit(0.01), F.lit(0.002), F.lit(0.03))
    ok = (F.col("status") == "ok") & (F.col("sigma") < 50) & (F.pow(F.col("sigma") * (F.col("rho") - 1) + 1, F.lit(4)) >= 1e-3)
    return se.select("importer", "exporter", "good", *[F.when(ok, F.col(c)).alias(c) for c in ("sigma_se", "rho_se", "omega_se")])


_SY = ", ".join(f"({i + 2}, {v}::DOUBLE)" for i, v in enumerate(S1.STOCK_YOGO[0.10]))


@query("stock_yogo_lookup", f"WITH {_RAW}, sy(n, cv) AS (VALUES {_SY}), k AS (SELECT importer, good, count(DISTINCT exporter) + any_value(importer) AS suppliers FROM raw GROUP BY ALL) SELECT importer, good, suppliers, cv FROM k LEFT JOIN sy ON n = least(suppliers, 30)")
def _(s, d):
    k = raw(s, d).groupBy("importer", "good").agg(F.countDistinct("exporter").alias("n")).withColumn("suppliers", F.col("n") + F.col("importer")).drop("n")
    return S1.with_critical(k, "suppliers", "cv_10", "cv")


@query("calendar_lag", f"WITH {_DIF}{_LAG} SELECT importer, good, exporter, t, round(cusval_lag, 2) AS cusval_lag FROM lagged", money=("cusval_lag",))
def _(s, d):
    return M.with_lag(prepared(s, d), CFG).select("importer", "good", "exporter", "t", "cusval_lag")


@query("positional_lag", f"WITH {_DIF} SELECT importer, good, exporter, t, round(lag(cusval) OVER (PARTITION BY importer, good, exporter ORDER BY t), 2) AS cusval_lag FROM prep", money=("cusval_lag",))
def _(s, d):
    return prepared(s, d).select("importer", "good", "exporter", "t", X.positional_lag("cusval", ["importer", "good", "exporter"]).alias("cusval_lag"))


@query("bw_weights", f"WITH {_DIF}{_LAG} SELECT importer, good, exporter, t, round({_BW.format(n='period_count')}, 4) AS bw FROM lagged", places=4)
def _(s, d):
    return M.with_lag(prepared(s, d), CFG).select("importer", "good", "exporter", "t", X.bw_weight(F.col("cusval"), F.col("cusval_lag"), F.col("period_count")).alias("bw"))


@query("import_moments", f"WITH {_IMP} SELECT importer, good, exporter, ref_exporter, n_periods, round(value, 2) AS value, {r(*M.IMPORT_MOMENTS)} FROM imom", money=("value",))
def _(s, d):
    return M.import_moments(prepared(s, d), CFG)


@query("ref_destination_top2", f"WITH {_EXP}, rk AS (SELECT *, row_number() OVER (PARTITION BY good, exporter ORDER BY v DESC, importer) AS k FROM dv) SELECT good, exporter, max(importer) FILTER (WHERE k = 1) AS first_dest, max(importer) FILTER (WHERE k = 2) AS second_dest FROM rk WHERE k <= 2 GROUP BY ALL")
def _(s, d):
    return M.reference_destinations(prepared(s, d))


@query("export_moments", f"WITH {_EXP} SELECT importer, good, exporter, ref_dest, {r(*M.EXPORT_MOMENTS)} FROM emom")
def _(s, d):
    return M.export_moments(prepared(s, d), CFG)


@query("dest_counts", f"WITH {_IMP} SELECT * FROM dests")
def _(s, d):
    return M.destination_counts(prepared(s, d))


def _tiers(s, d):
    panel = prepared(s, d)
    return M.exporter_tiers(M.import_moments(panel, CFG), M.destination_counts(panel), CFG)


@query("exporter_tiers", f"WITH {_IMP} SELECT importer, good, exporter, n_periods, n_dests, tier FROM tiers")
def _(s, d):
    return _tiers(s, d).select("importer", "good", "exporter", "n_periods", "n_dests", "tier")


@query("exporter_weights", f"""WITH {_IMP}, w AS (SELECT *, value * least(n_periods, 10) / 10::DOUBLE AS adj FROM tiers), z AS (SELECT *, adj * count(*) FILTER (WHERE tier < 3) OVER (PARTITION BY importer, good) / sum(adj) FILTER (WHERE tier < 3) OVER (PARTITION BY importer, good) AS u FROM w)
 SELECT importer, good, exporter, tier, round(CASE WHEN tier < 3 THEN CASE WHEN u > 0 THEN u ELSE 1.0 END END, 6) AS weight FROM z""")
def _(s, d):
    return M.exporter_weights(_tiers(s, d), CFG).select("importer", "good", "exporter", "tier", "weight")


@query("lookup_fallback", f"""WITH {_EST}, lk AS (SELECT importer, good, sigma FROM ecell WHERE importer % 3 <> 0), fb AS (SELECT median(sigma) AS m FROM lk)
 SELECT e.importer, e.good, round(coalesce(lk.sigma, (SELECT m FROM fb)), 6) AS sigma, count(*) AS n FROM est e LEFT JOIN lk ON lk.importer = e.importer AND lk.good = e.good GROUP BY ALL""")
def _(s, d):
    known = estimate_cells(s, d).filter("importer % 3 <> 0").select("importer", "good", "sigma")
    flows = S2.looked_up(estimates(s, d).select("importer", "good"), known, ["importer", "good"], "sigma", "sigma", keep.quantiles(known, "sigma", [0.5])[0])
    return flows.groupBy("importer", "good", "sigma").agg(F.count("*").alias("n"))


@query("good_priors", f"WITH {_EST} SELECT good, round(median(ln(gamma)), 6) AS ln_gamma_prior FROM est WHERE gamma > 0 AND adjust NOT IN (3, 5) AND importer % 4 <> 0 AND gamma < 20 AND sigma > 1 GROUP BY good")
def _(s, d):
    flags = {"convergence": F.when(F.col("status") == "all_inversions_failed", -99).otherwise(0), "omega_floored": F.when(F.col("importer") % 4 == 0, True), "omega_capped": F.col("gamma") >= 20}
    return S1.good_priors(estimates(s, d).withColumns(flags))


@query("regional_priors", f"WITH {_EST} SELECT good, round(median(ln(gamma)), 6) AS ln_gamma_prior FROM est WHERE gamma > 0 AND sigma IS NOT NULL GROUP BY good")
def _(s, d):
    return S2.regional_priors(estimates(s, d))


@query("regional_sigma", f"WITH {_EST}, {_RMAP} SELECT coalesce(region, 'OTHER') AS importer, good, round(median(sigma), 6) AS sigma FROM ecell LEFT JOIN rm ON importer = c GROUP BY ALL")
def _(s, d):
    return S2.regional_sigma(estimate_cells(s, d), regions(s, d))


@query("gamma_v_fanout", f"WITH {_EST}, {_RMAP}, rg AS (SELECT coalesce(region, 'OTHER') AS region, good, median(gamma) AS gamma FROM est LEFT JOIN rm ON importer = c WHERE gamma > 0 GROUP BY ALL), ct AS (SELECT DISTINCT importer, coalesce(region, 'OTHER') AS region FROM est LEFT JOIN rm ON importer = c) SELECT importer::VARCHAR AS importer, good, round(gamma, 6) AS gamma FROM ct JOIN rg USING (region)")
def _(s, d):
    est = estimates(s, d)
    regional = S2.regional_gamma(P.assign_regions(est, regions(s, d), "importer"))
    return S2.by_country(regional, est.select(F.col("importer").cast("string").alias("importer")), regions(s, d))


@query("optimal_tariff", f"""WITH {_EST} SELECT importer, good, round(sum(avg_trade * gamma / (1 + gamma * sigma)) FILTER (WHERE gamma > 0 AND avg_trade > 0 AND tier < 3) / sum(avg_trade / (1 + gamma * sigma)) FILTER (WHERE gamma > 0 AND avg_trade > 0 AND tier < 3), 6) AS opt_tariff,
 round(sum(avg_trade * gamma / (1 + gamma * sigma)) / sum(avg_trade / (1 + gamma * sigma)), 6) AS opt_tariff_all FROM est GROUP BY ALL""")
def _(s, d):
    args = [F.col(c) for c in ("gamma", "sigma", "avg_trade")]
    return estimates(s, d).groupBy("importer", "good").agg(X.optimal_tariff(*args, F.col("tier") < 3).alias("opt_tariff"), X.optimal_tariff(*args).alias("opt_tariff_all"))


@query("tail_trim", f"""WITH {_EST}, b AS (SELECT quantile_cont(sigma, 0.05) AS sl, quantile_cont(sigma, 0.95) AS sh, quantile_cont(gamma, 0.05) AS gl, quantile_cont(gamma, 0.95) AS gh FROM est WHERE tier < 3)
 SELECT importer, exporter, good, round(sigma, 6) AS sigma, round(gamma, 6) AS gamma FROM est, b WHERE sigma BETWEEN sl AND sh AND gamma BETWEEN gl AND gh""")
def _(s, d):
    return S2.tail_trim(estimates(s, d), 0.05).select("importer", "exporter", "good", "sigma", "gamma")


@query("plateau_replace", f"""WITH {_EST}, pr AS (SELECT good, median(ln(gamma)) AS p FROM est WHERE tier < 3 AND good <> '0103' GROUP BY good), h AS (SELECT est.*, p, coalesce(gamma > 20 AND tier <> 3 AND p IS NOT NULL, false) AS hit FROM est LEFT JOIN pr USING (good)),
 n AS (SELECT *, CASE WHEN hit THEN exp(p) ELSE gamma END AS ng FROM h), z AS (SELECT importer, exporter, good, ng, hit, CASE WHEN max(hit::INT) OVER w = 1 THEN sum(avg_trade * ng / (1 + ng * sigma)) OVER w / sum(avg_trade / (1 + ng * sigma)) OVER w END AS ot FROM n WINDOW w AS (PARTITION BY importer, good))
 SELECT importer, exporter, good, round(ng, 6) AS gamma, round(ot, 6) AS opt_tariff_all FROM z""")
def _(s, d):
    est = estimates(s, d).withColumns({c: F.lit(None).cast("double") for c in ("gamma_se_total", "opt_tariff", "opt_tariff_all")})
    priors = est.filter("tier < 3 and good <> '0103'").groupBy("good").agg(F.median(F.log("gamma")).alias("ln_gamma_prior"))
    return S2.plateau_fallback(est, priors, 20.0).select("importer", "exporter", "good", "gamma", "opt_tariff_all")


@query("boundary_flags", f"WITH {_EST}, e AS (SELECT *, CASE importer % 3 WHEN 0 THEN 'sigma_cap' WHEN 1 THEN 'omega_cap' END AS edge FROM est) SELECT importer, exporter, good, coalesce(edge = 'sigma_cap', false) OR sigma >= 6 - 1e-3 AS sigma_capped, coalesce(edge = 'omega_cap', false) OR gamma >= 20 - 1e-3 AS omega_capped FROM e")
def _(s, d):
    edge = F.when(F.col("importer") % 3 == 0, "sigma_cap").when(F.col("importer") % 3 == 1, "omega_cap")
    a, b = X.boundary_flags(edge, F.col("sigma"), F.col("gamma"), 6.0, 20.0)
    return estimates(s, d).select("importer", "exporter", "good", a.alias("sigma_capped"), b.alias("omega_capped"))


@query("sigma_robust", f"""WITH {_EST}, w AS (SELECT importer, good, max(sigma) AS sigma, max(sigma_se) AS sigma_se, max(adjust) AS adjust, max(CASE WHEN gamma_se > 0 THEN sqrt(gamma_se * gamma_se + (abs(dgamma_dsigma) * sigma_se) * (abs(dgamma_dsigma) * sigma_se)) / gamma_se END) AS worst FROM est WHERE tier < 3 GROUP BY ALL)
 SELECT importer, good, adjust <> 4 AND sigma_se IS NOT NULL AND coalesce(sigma - 2.5 * sigma_se > 1 + 1e-6, false) AND coalesce(worst <= 2, true) AS sigma_robust FROM w""")
def _(s, d):
    c = estimates(s, d).filter("tier < 3").withColumn("i", R.inflation()).groupBy("importer", "good").agg(F.max("sigma").alias("sigma"), F.max("sigma_se").alias("sigma_se"), F.max("adjust").alias("adjust"), F.max("i").alias("worst"))
    return c.select("importer", "good", X.sigma_robust(F.col("sigma"), F.col("sigma_se"), F.col("adjust"), F.col("worst")).alias("sigma_robust"))


@query("structural_ratios", f"WITH {_EST} SELECT good, round(median(gamma / (1 + gamma)), 6) AS pass_through, round(median(1 / (sigma - 1)), 6) AS markup, round(median(gamma / ((1 + gamma) * (sigma - 1))), 6) AS joint FROM est GROUP BY good")
def _(s, d):
    return R.structural_ratios(estimates(s, d), "good")


_T2 = "count(*) AS n, count(DISTINCT good) AS goods, round(median(sigma), 6) AS sigma_median, round(median(gamma), 6) AS gamma_median, round(quantile_cont(gamma, 0.25), 6) AS gamma_q25, round(quantile_cont(gamma, 0.75), 6) AS gamma_q75"


@query("table2_grouping_sets", f"WITH {_EST} SELECT importer::VARCHAR AS importer, {_T2} FROM est GROUP BY importer UNION ALL SELECT 'World', {_T2} FROM est")
def _(s, d):
    return R.country_table(estimates(s, d))


_PS = "ps AS (SELECT importer, good, count(*) AS n_exporters, median(gamma) AS within_med, stddev_samp(gamma) AS within_sd, mad(gamma) AS within_mad FROM est WHERE gamma > 0 GROUP BY ALL HAVING count(*) >= 2)"


@query("within_pair_stats", f"WITH {_EST}, {_PS} SELECT count(*) AS n_pairs, " + ", ".join(f"round(median({c}), 6) AS median_{c}, round(quantile_cont({c}, 0.25), 6) AS q25_{c}, round(quantile_cont({c}, 0.75), 6) AS q75_{c}" for c in ("within_med", "within_sd", "within_mad")) + " FROM ps")
def _(s, d):
    return R.within_pair_summary(estimates(s, d))


_VD = "vg AS (SELECT ln(gamma) AS l, avg(ln(gamma)) OVER (PARTITION BY importer, good) AS m, avg(ln(gamma)) OVER () AS a, importer, good FROM est WHERE gamma > 0), vd AS (SELECT 1 - sum((l - m) ** 2) / sum((l - a) ** 2) AS r_squared, count(*) AS n_obs, count(DISTINCT importer || '-' || good) AS n_groups FROM vg)"


@query("variance_decomposition", f"WITH {_EST}, {_VD} SELECT round(r_squared, 6) AS r_squared, n_obs, n_groups FROM vd")
def _(s, d):
    return R.variance_decomposition(estimates(s, d))


@query("lambda_calibration", f"""WITH {_EST}, {_PS}, {_VD}, a AS (SELECT count(*) AS n_estimates, avg((gamma > 20)::INT) AS plateau_share, median(gamma) FILTER (WHERE tier = 1) AS t1, median(gamma) FILTER (WHERE tier = 3) AS t3 FROM est)
 SELECT 0.1::DOUBLE AS lambda, n_estimates, round(plateau_share, 6) AS plateau_share, round(t1, 6) AS tier1_gamma_median, round(t3, 6) AS tier3_gamma_median, (SELECT count(*) FROM ps) AS n_pairs, round((SELECT median(within_mad) FROM ps), 6) AS within_pair_mad, round((SELECT r_squared FROM vd), 6) AS r_squared, round(abs(ln(t1) - ln(t3)), 6) AS tier_distinctness FROM a""")
def _(s, d):
    return R.calibration(estimates(s, d), 0.1)


_PROV = "CASE WHEN final_source = 'hliml' THEN 'interior' WHEN final_source = 'hliml_boundary' THEN 'boundary' WHEN adjust = 4 THEN 'sigma_capped' WHEN adjust = 5 THEN 'omega_capped' WHEN final_source = 'step2_weighted' THEN 'second_step' ELSE 'failed' END"


@query("provenance_share", f"WITH {_EST}, p AS (SELECT {_PROV} AS provenance FROM ecell) SELECT provenance, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS pct FROM p GROUP BY provenance")
def _(s, d):
    return R.shares(estimate_cells(s, d).select(X.sigma_provenance(F.col("final_source"), F.col("adjust")).alias("provenance")), "provenance")


@query("provenance_medians", f"WITH {_EST} SELECT {_PROV} AS provenance, count(*) AS n, round(median(sigma), 6) AS sigma_median, round(quantile_cont(sigma, 0.25), 6) AS sigma_q25, round(quantile_cont(sigma, 0.75), 6) AS sigma_q75 FROM ecell GROUP BY 1")
def _(s, d):
    return R.provenance_medians(estimate_cells(s, d))


@query("se_status_crosstab", f"WITH {_EST} SELECT tier, gamma_se_status, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY tier), 6)::DOUBLE AS pct FROM est GROUP BY tier, gamma_se_status")
def _(s, d):
    return R.shares(estimates(s, d), "tier", "gamma_se_status", within=("tier",))


@query("hs_chapter_gamma", f"WITH {_EST}, {_PS} SELECT substr(good, 1, 2) AS chapter, count(*) AS n, round(median(gamma), 6) AS gamma_median, round(quantile_cont(gamma, 0.25), 6) AS gamma_q25, round(quantile_cont(gamma, 0.75), 6) AS gamma_q75, any_value(w) AS within_pair_mad, any_value(u) AS within_pair_mad_q75 FROM est, (SELECT round(median(within_mad), 6) AS w, round(quantile_cont(within_mad, 0.75), 6) AS u FROM ps) WHERE gamma > 0 GROUP BY 1")
def _(s, d):
    return R.chapter_gamma(estimates(s, d))


@query("gap_census", f"""WITH {_DIF}, g AS (SELECT p.*, q.t IS NULL AS fb, q.t IS NULL AND p.t <> min(p.t) OVER (PARTITION BY p.importer, p.exporter, p.good) AS st FROM prep p LEFT JOIN prep q ON q.importer = p.importer AND q.exporter = p.exporter AND q.good = p.good AND q.t = p.t - 1),
 s AS (SELECT importer, exporter, good, count(*) AS n, count(*) FILTER (WHERE st) AS st, count(*) FILTER (WHERE fb) AS fb FROM g GROUP BY ALL)
 SELECT importer, good, count(*) AS n_series, count(*) FILTER (WHERE st > 0) AS n_series_holed, round(avg((st > 0)::INT), 6) AS share_holed, sum(n)::BIGINT AS n_rows, sum(st)::BIGINT AS n_stale_rows, sum(fb)::BIGINT AS n_fallback_rows FROM s GROUP BY ALL""")
def _(s, d):
    return R.gap_census(prepared(s, d))


@query("survivorship_census", f"""WITH {_TRADE}, lv AS (SELECT 'HS6' AS hs_level, lpad(good, 6, '0') AS g, * FROM trade UNION ALL SELECT 'HS4', substr(lpad(good, 6, '0'), 1, 4), * FROM trade),
 y AS (SELECT hs_level, importer, g, exporter, year, sum(cusval) AS v FROM lv GROUP BY ALL), l AS (SELECT *, (year - lag(year) OVER (PARTITION BY hs_level, importer, g, exporter ORDER BY year) = 1)::INT AS pr FROM y),
 rt AS (SELECT hs_level, importer, g, exporter, coalesce(sum(pr), 0) AS pairs, sum(v) AS v FROM l GROUP BY ALL), gr AS (SELECT * FROM (VALUES (2), (4)) a(min_exporters), (VALUES (1), (3)) b(min_pairs)),
 c AS (SELECT hs_level, min_exporters, min_pairs, importer, g, count(*) FILTER (WHERE pairs >= min_pairs) >= min_exporters AS ok, count(*) AS r, sum(v) AS v FROM rt, gr GROUP BY hs_level, min_exporters, min_pairs, importer, g)
 SELECT hs_level, min_exporters, min_pairs, count(*) AS cells_total, count(*) FILTER (WHERE ok) AS cells_estimable, round(avg(ok::INT), 6) AS share_cells, round(coalesce(sum(r) FILTER (WHERE ok), 0)::DOUBLE / sum(r)::DOUBLE, 6) AS share_routes, round(coalesce(sum(v) FILTER (WHERE ok), 0) / sum(v), 6) AS share_value FROM c GROUP BY ALL""")
def _(s, d):
    return R.survivorship_census(trade(s, d), [2, 4], [1, 3])


@query("sensitivity_pivot", f"""WITH {_EST}, c AS (SELECT importer, good, count(*) AS n, max(sigma) AS sigma, max(sigma_se) AS sigma_se, max(CASE WHEN gamma_se > 0 THEN sqrt(gamma_se * gamma_se + (abs(dgamma_dsigma) * sigma_se) * (abs(dgamma_dsigma) * sigma_se)) / gamma_se END) AS worst FROM est WHERE tier < 3 GROUP BY ALL),
 g AS (SELECT c.*, k::DOUBLE AS k_pole, i::DOUBLE AS lim FROM c, (VALUES (1.5), (2.5), (3.0)) a(k), (VALUES (1.5), (2.0), (5.0)) b(i)),
 z AS (SELECT k_pole, lim, 100.0 * sum(CASE WHEN sigma >= 9.999 OR sigma_se IS NULL OR k_pole * sigma_se >= sigma - 1 - 1e-6 OR coalesce(worst, 0) > lim THEN 0 ELSE n END) / sum(n) AS p FROM g GROUP BY ALL)
 SELECT k_pole, round(max(p) FILTER (WHERE lim = 1.5), 6)::DOUBLE AS infl_1_5, round(max(p) FILTER (WHERE lim = 2), 6)::DOUBLE AS infl_2_0, round(max(p) FILTER (WHERE lim = 5), 6)::DOUBLE AS infl_5_0 FROM z GROUP BY k_pole""")
def _(s, d):
    return R.sensitivity(estimates(s, d), [1.5, 2.5, 3.0], [1.5, 2.0, 5.0])


@query("composition_full_outer", f"WITH {_EST}, a AS (SELECT gamma_se_status, count(*) AS n FROM est WHERE gamma <= 20 GROUP BY 1), b AS (SELECT gamma_se_status, count(*) AS n FROM est WHERE gamma >= 1 GROUP BY 1) SELECT coalesce(a.gamma_se_status, b.gamma_se_status) AS gamma_se_status, coalesce(a.n, 0) AS n_old, coalesce(b.n, 0) AS n_new FROM a FULL JOIN b USING (gamma_se_status)")
def _(s, d):
    est = estimates(s, d)
    return R.composition(est.filter("gamma <= 20"), est.filter("gamma >= 1"), "gamma_se_status")


@query("pairing_diagnostic", f"WITH {_EST}, a AS (SELECT importer, good, median(gamma) AS g FROM est WHERE tier < 3 GROUP BY ALL), b AS (SELECT importer, good, avg(gamma) AS g FROM est GROUP BY ALL) SELECT count(*) AS n, round(median(abs(a.g - b.g)), 6) AS mad, round(corr(a.g, b.g) ** 2, 6) AS r_squared FROM a JOIN b USING (importer, good)")
def _(s, d):
    est = estimates(s, d)
    return R.pairing(est.filter("tier < 3").groupBy("importer", "good").agg(F.median("gamma").alias("gamma")), est.groupBy("importer", "good").agg(F.avg("gamma").alias("gamma")), ["importer", "good"])


_MET = "count(*)::DOUBLE AS n, count(DISTINCT good)::DOUBLE AS goods, median(sigma) AS sigma_median, median(gamma) AS gamma_median, quantile_cont(gamma, 0.25) AS gamma_q25, quantile_cont(gamma, 0.75) AS gamma_q75, avg((gamma > 20)::INT) AS plateau"


@query("run_comparison", f"WITH {_EST}, o AS (SELECT {_MET} FROM est), w AS (SELECT {_MET} FROM est WHERE tier < 3), ol AS (UNPIVOT o ON COLUMNS(*) INTO NAME metric VALUE v), wl AS (UNPIVOT w ON COLUMNS(*) INTO NAME metric VALUE v) SELECT metric, round(ol.v, 6) AS old, round(wl.v, 6) AS new, round(wl.v - ol.v, 6) AS delta FROM ol JOIN wl USING (metric)")
def _(s, d):
    est = estimates(s, d)
    return R.run_comparison(est, est.filter("tier < 3"))


@query("flag_transitions", f"WITH {_EST} SELECT sigma >= 4 AS old, sigma >= 3 AS new, count(*) AS n FROM ecell GROUP BY ALL")
def _(s, d):
    c = estimate_cells(s, d)
    return R.transitions(c.withColumn("f", F.col("sigma") >= 4), c.withColumn("f", F.col("sigma") >= 3), "f")


@query("failure_counts", f"WITH {_EST} SELECT status, count(*) AS n FROM ecell WHERE status <> 'ok' GROUP BY status")
def _(s, d):
    return R.failure_counts(estimate_cells(s, d))


@query("mode_spike", f"WITH {_EST} SELECT round(sigma, 6) AS sigma, count(*) AS n FROM est WHERE sigma < 10 GROUP BY sigma ORDER BY n DESC, sigma LIMIT 1")
def _(s, d):
    return R.spike(estimates(s, d))


@query("quality_log", f"""WITH {_DIF}, q AS (SELECT 1 AS step, 'raw' AS stage, count(*) AS n_obs, sum(cusval) AS v FROM trade UNION ALL SELECT 2, 'positive', count(*), sum(cusval) FROM trade WHERE cusval > 0 AND quantity > 0 UNION ALL SELECT 3, 'years', count(*), sum(cusval) FROM trade WHERE cusval > 0 AND quantity > 0 AND year >= 1995
 UNION ALL SELECT 4, 'codes', count(*), sum(cusval) FROM trade WHERE cusval > 0 AND quantity > 0 AND year >= 1995 UNION ALL SELECT 5, 'rolled_up', count(*), sum(cusval) FROM dif UNION ALL SELECT 6, 'differenced', count(*), sum(cusval) FROM dif WHERE lp_dif IS NOT NULL UNION ALL SELECT 7, 'outliers', count(*), sum(cusval) FROM prep)
 SELECT step, stage, n_obs, coalesce(lag(n_obs) OVER (ORDER BY step) - n_obs, 0) AS n_dropped, round(v, 2) AS trade_value FROM q""", money=("trade_value",))
def _(s, d):
    return P.quality_log(trade(s, d), CFG)


@query("manifest_anti_join", f"WITH {_EST}, l AS (SELECT DISTINCT good || '-' || importer AS local_path FROM est WHERE importer < 20), p AS (SELECT DISTINCT good || '-' || importer AS local_path FROM est WHERE importer > 3) SELECT local_path, 'missing' AS problem FROM l ANTI JOIN p USING (local_path) UNION ALL SELECT local_path, 'unlisted' FROM p ANTI JOIN l USING (local_path)")
def _(s, d):
    paths = lambda cond: estimates(s, d).filter(cond).select(F.concat_ws("-", "good", F.col("importer").cast("string")).alias("local_path")).distinct()
    return T.manifest_drift(paths("importer < 20"), paths("importer > 3"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return S1.run_stage1(raw(spark, d), CFG)


@query("stage1_liml")
def _(s, d):
    return flagship(s, d)


def _stage2_inputs(s, d):
    panel = prepared(s, d)
    cells = estimate_cells(s, d).select(F.col("importer").cast("string").alias("importer"), "good", (1.5 + F.col("sigma") / 2).alias("sigma"), F.lit(0.7).alias("gamma"))
    priors = cells.groupBy("good").agg(F.log(F.median("gamma")).alias("ln_gamma_prior"))
    return panel, cells.select("importer", "good", "sigma"), priors, cells.select("importer", "good", "gamma")


@query("stage2_fixed_sigma")
def _(s, d):
    panel, sigma, priors, gamma = _stage2_inputs(s, d)
    return S2.run_stage2(panel, CFG, CFG.shrinkage, sigma, 2.88, priors, gamma, 0.69)


@query("lambda_sweep")
def _(s, d):
    panel, sigma, priors, gamma = _stage2_inputs(s, d)
    inputs = keep.kept(S2.cell_inputs(keep.kept(panel), CFG, sigma, 2.88, priors, gamma, 0.69, None, 0.69))
    return S2.lambda_sweep(inputs, [0.05, 0.1, 0.5])


@query("stage1_both")
def _(s, d):
    return S1.run_stage1(raw(s, d), CFG.with_(stage1_hliml="both"))


@query("stage2_joint")
def _(s, d):
    panel, sigma, _, gamma = _stage2_inputs(s, d)
    return S2.run_joint(panel, CFG, sigma, 2.88, gamma, 0.69)


@query("bootstrap_sigma")
def _(s, d):
    panel = keep.kept(raw(s, d))
    cells = N.stratified_sample(N.strata(keep.kept(S1.run_stage1(panel, CFG))), 8, 1)  # a sample is the feature
    return B.bootstrap(panel, cells, replicates=20, least_ok=5)


@query("one_cell")
def _(s, d):
    return S1.estimate_elasticities(raw(s, d).filter("importer = 3 and good = '0102'"), t="year", value="cusval")


_FEEN = _IMP + """,
vi AS (SELECT importer, good FROM prep GROUP BY ALL HAVING count(DISTINCT exporter) >= 2 AND max(period_count) >= 3),
fa AS (SELECT imom.*, value * least(n_periods, 10) / 10::DOUBLE AS adj FROM imom JOIN vi USING (importer, good)),
fw AS (SELECT *, adj * count(*) OVER (PARTITION BY importer, good) / sum(adj) OVER (PARTITION BY importer, good) AS w, imp_x3 - imp_x4 AS z FROM fa),
fs AS (SELECT importer, good, count(*) AS n_exporters, sum(w * imp_y * imp_x1) AS ya, sum(w * imp_y * imp_x2) AS yc, sum(w * imp_x1 * imp_x1) AS aa, sum(w * imp_x1 * imp_x2) AS ac, sum(w * imp_x2 * imp_x2) AS cc FROM fw GROUP BY ALL),
ft AS (SELECT *, (ya * cc - yc * ac) / (aa * cc - ac * ac) AS t1, (yc * aa - ya * ac) / (aa * cc - ac * ac) AS t2 FROM fs WHERE n_exporters > 2),
fi AS (SELECT *, (sqrt(t2 * t2 + 4 * t1) - t2) / 2 AS inv FROM ft WHERE t1 > 0),
fo AS (SELECT *, inv + t2 AS g FROM fi)"""


@query("feenstra_baseline", f"WITH {_FEEN} SELECT importer, good, n_exporters, round(inv, 5) AS inv, round(g, 5) AS g FROM fo WHERE g BETWEEN 0.001 AND 0.999", places=5)
def _(s, d):
    fits = H.baseline(prepared(s, d), CFG).withColumns({"inv": 1 / (F.col("sigma") - 1), "g": F.col("gamma") / (1 + F.col("gamma"))})
    return fits.filter("edge = 'none' and n_exporters > 2 and g between 0.001 and 0.999").select("importer", "good", "n_exporters", "inv", "g")


def both_cells(spark, d) -> DataFrame:
    """A stage 1 table of a "both" run by arithmetic on the keys."""
    i, e = F.col("importer"), F.col("exporter")
    c = estimates(spark, d).select("importer", "exporter", "good", "sigma", "gamma", "adjust", "status", "final_source", "sigma_se")
    return c.withColumns({
        "hliml_status": F.when((i + e) % 7 < 4, "ok").when((i + e) % 7 < 6, "hliml_fail_no_convergence").when(e % 3 > 0, "step1_fail"), "hliml_cf_status": F.when(e % 11 > 0, F.when(i % 10 > 0, "ok").otherwise("cf_fail_degenerate_b1")),
        "hliml_cf_admissible": (i * 3 + e) % 5 > 1, "sigma_hliml": F.col("sigma"), "sigma_hliml_cf": F.col("sigma") * (1 + ((i + e * 2) % 9) / 64), "hliml_Q": ((i + e) % 13) / 16, "hliml_Q_cf": ((i * 5 + e) % 13) / 16,
        "hliml_bd_edge": F.when(e % 4 == 0, "omega_floor").when(e % 4 == 1, "sigma_cap").when(e % 4 == 2, "omega_cap"), "hliml_bd_usable": F.when(e % 4 < 3, i % 3 > 0), "sigma_hliml_bd": F.col("sigma") + 1,
        "n_exporters": (i * 5 + e * 3) % 60, "fstat_kp": F.when(e % 6 > 0, ((i * 7 + e) % 40) / 4), "sigma_capped": F.when(i % 5 == 0, e % 2 == 0), "omega": F.col("gamma"), "omega_capped": F.lit(False), "hliml_boundary_edge": F.when(e % 4 == 1, "sigma_cap"),
    })


_BOTH = _EST + """,
bc AS (SELECT importer, exporter, good, sigma, gamma, adjust, status, final_source, sigma_se, CASE WHEN (importer + exporter) % 7 < 4 THEN 'ok' WHEN (importer + exporter) % 7 < 6 THEN 'hliml_fail_no_convergence' WHEN exporter % 3 > 0 THEN 'step1_fail' END AS hliml_status,
  CASE WHEN exporter % 11 > 0 THEN CASE WHEN importer % 10 > 0 THEN 'ok' ELSE 'cf_fail_degenerate_b1' END END AS cfs, (importer * 3 + exporter) % 5 > 1 AS adm, sigma AS sh, sigma * (1 + ((importer + exporter * 2) % 9) / 64::DOUBLE) AS sc,
  ((importer + exporter) % 13) / 16::DOUBLE AS q, ((importer * 5 + exporter) % 13) / 16::DOUBLE AS qc, CASE exporter % 4 WHEN 0 THEN 'omega_floor' WHEN 1 THEN 'sigma_cap' WHEN 2 THEN 'omega_cap' END AS edge, exporter % 4 < 3 AND importer % 3 > 0 AS usable, sigma + 1 AS sb,
  (importer * 5 + exporter * 3) % 60 AS nx, CASE WHEN exporter % 6 > 0 THEN ((importer * 7 + exporter) % 40) / 4::DOUBLE END AS f, importer % 5 = 0 AND exporter % 2 = 0 AS sigma_capped FROM est),
cl AS (SELECT *, CASE WHEN hliml_status = 'ok' THEN 'bfgs_ok' WHEN hliml_status = 'hliml_fail_no_convergence' THEN 'bfgs_noconv' ELSE 'bfgs_other_fail' END AS bfgs_class,
  CASE WHEN cfs IS NULL THEN 'cf_NA' WHEN cfs <> 'ok' THEN 'cf_fail' WHEN adm THEN 'cf_admissible' ELSE 'cf_inadmissible' END AS cf_class,
  CASE WHEN status <> 'ok' THEN status WHEN adjust = 0 THEN 'hliml_interior' WHEN adjust = 1 THEN 'step2_clean' WHEN adjust IN (4, 5) THEN 'capped' WHEN adjust IN (2, 3) THEN 'omega_floored_or_fallback' ELSE 'adjust_' || adjust END AS shipped FROM bc WHERE hliml_status IS NOT NULL)"""


@query("census_crosstab", f"WITH {_BOTH} SELECT bfgs_class, cf_class, count(*) AS n FROM cl GROUP BY ALL")
def _(s, d):
    return N.crosstab(N.classes(both_cells(s, d)))


@query("census_reroutes", f"WITH {_BOTH} SELECT 'in' AS direction, shipped AS key, count(*) AS n FROM cl WHERE bfgs_class <> 'bfgs_ok' AND cf_class = 'cf_admissible' GROUP BY ALL UNION ALL SELECT 'out', cf_class, count(*) FROM cl WHERE bfgs_class = 'bfgs_ok' AND cf_class <> 'cf_admissible' GROUP BY ALL")
def _(s, d):
    return N.reroutes(N.classes(both_cells(s, d)))


@query("census_agreement", f"""WITH {_BOTH}, b AS (SELECT *, abs(sh - sc) AS gap FROM cl WHERE bfgs_class = 'bfgs_ok' AND cf_class = 'cf_admissible') SELECT count(*) AS n_both, round(median(gap), 6) AS median_abs_delta_sigma, round(avg((gap / sc <= 0.01)::INT), 6) AS share_within_1pct,
 round(avg((gap / sc <= 0.1)::INT), 6) AS share_within_10pct, round(avg((qc <= q + 1e-12)::INT), 6) AS "share_Qcf_le_Qbfgs", round(median(sh), 6) AS median_sigma_bfgs, round(median(sc), 6) AS median_sigma_cf FROM b""")
def _(s, d):
    return N.agreement(N.classes(both_cells(s, d)))


@query("census_composition", f"WITH {_BOTH}, p AS (SELECT shipped AS dest, 1 AS s, 0 AS p FROM cl UNION ALL SELECT CASE WHEN cf_class = 'cf_admissible' THEN 'hliml_interior' ELSE shipped END, 0, 1 FROM cl) SELECT dest, sum(s)::BIGINT AS shipped, sum(p)::BIGINT AS projected FROM p GROUP BY dest")
def _(s, d):
    return N.projected_composition(N.classes(both_cells(s, d)))


@query("census_boundary", f"WITH {_BOTH} SELECT coalesce(edge, 'bd_NA') AS edge, usable, shipped AS shipped_dest, count(*) AS n, round(median(sb), 6) AS sigma_median FROM cl WHERE cf_class IN ('cf_inadmissible', 'cf_fail') GROUP BY ALL")
def _(s, d):
    return N.boundary_rescue(N.classes(both_cells(s, d)))


_BINS = "CASE WHEN nx > 3 AND nx <= 9 THEN '4-9' WHEN nx > 9 AND nx <= 19 THEN '10-19' WHEN nx > 19 AND nx <= 49 THEN '20-49' WHEN nx > 49 THEN '50+' ELSE 'nexp_NA' END AS nexp_bin, CASE WHEN f <= 2 THEN 'F<2' WHEN f > 2 AND f <= 7 THEN 'F2-7' WHEN f > 7 THEN 'F>=7' ELSE 'F_NA' END AS f_bin"


@query("strata_bins", f"WITH {_BOTH}, z AS (SELECT *, {_BINS} FROM bc WHERE status = 'ok' AND sigma_se IS NOT NULL AND NOT sigma_capped) SELECT nexp_bin || ' | ' || f_bin || ' | ' || final_source AS stratum, count(*) AS n FROM z GROUP BY ALL")
def _(s, d):
    return N.counts(N.strata(both_cells(s, d)), "stratum")


@query("stratified_sample")
def _(s, d):
    return N.stratified_sample(N.strata(both_cells(s, d)), 200).select("importer", "exporter", "good", "stratum")


@query("patched_flags", f"WITH {_BOTH} SELECT importer, exporter, good, CASE WHEN final_source = 'hliml_boundary' THEN coalesce(exporter % 4 = 1, false) OR sigma >= 5 - 1e-3 WHEN importer % 5 = 0 THEN exporter % 2 = 0 END AS sigma_capped, CASE WHEN final_source = 'hliml_boundary' THEN gamma >= 5 - 1e-3 ELSE false END AS omega_capped FROM bc")
def _(s, d):
    return R.patch_flags(both_cells(s, d), 5.0).select("importer", "exporter", "good", "sigma_capped", "omega_capped")


@query("spearman_external", f"WITH {_EST}, x AS (SELECT importer || '-' || exporter || '-' || good AS cell_id, sigma AS a FROM est WHERE importer < 20), y AS (SELECT importer || '-' || exporter || '-' || good AS cell_id, gamma AS b FROM est WHERE exporter > 2), z AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM x JOIN y USING (cell_id)) SELECT count(*) AS n, round(corr(ra, rb), 6) AS spearman, round(corr(a, b), 6) AS pearson FROM z")
def _(s, d):
    cells = estimates(s, d).withColumn("cell_id", F.concat_ws("-", F.col("importer").cast("string"), F.col("exporter").cast("string"), "good"))
    return N.spearman(N.external(cells.filter("importer < 20"), cells.filter("exporter > 2"), published_col="gamma"), "ours", "published")


_GLOBAL = """count(*) AS n_estimates, count(DISTINCT good) AS n_products, count(DISTINCT importer) AS n_importers, count(DISTINCT exporter) AS n_exporters, count(DISTINCT good || '-' || importer) AS n_sigma, count(*) AS n_gamma,
 round(median(sigma), 6) AS sigma_median, round(avg(sigma), 6) AS sigma_mean, round(stddev_samp(sigma), 6) AS sigma_sd, round(quantile_cont(sigma, 0.25), 6) AS sigma_q25, round(quantile_cont(sigma, 0.75), 6) AS sigma_q75, round(median(gamma), 6) AS gamma_median,
 round(avg(gamma), 6) AS gamma_mean, round(stddev_samp(gamma), 6) AS gamma_sd, round(mad(gamma), 6) AS gamma_mad, round(quantile_cont(gamma, 0.25), 6) AS gamma_q25, round(quantile_cont(gamma, 0.75), 6) AS gamma_q75, round(median(gamma / 4), 6) AS opt_tariff_median, round(avg(gamma / 4), 6) AS opt_tariff_mean"""


@query("summary_global", f"WITH {_EST} SELECT {_GLOBAL} FROM est")
def _(s, d):
    return S.global_stats(estimates(s, d).withColumn("opt_tariff", F.col("gamma") / 4))


@query("summary_steps", f"""WITH {_EST}, a AS (SELECT * FROM est WHERE importer < 20), b AS (SELECT *, gamma * 1.5 + tier AS g2, sigma + adjust AS s2 FROM est WHERE exporter > 2), j AS (SELECT a.sigma AS s1, a.gamma AS g1, b.s2, b.g2 FROM a JOIN b USING (importer, exporter, good)),
 m AS (SELECT (SELECT median(sigma) FROM a) AS sa, (SELECT median(gamma) FROM a) AS ga, (SELECT median(s2) FROM b) AS sb, (SELECT median(g2) FROM b) AS gb)
 SELECT count(*) AS n_matched, round(any_value(sa), 6) AS step1_sigma_median, round(any_value(ga), 6) AS step1_gamma_median, round(any_value(sb), 6) AS step2_sigma_median, round(any_value(gb), 6) AS step2_gamma_median, round(any_value(sb - sa), 6) AS sigma_shift,
 round(any_value(gb - ga), 6) AS gamma_shift, round(any_value(100 * (sb - sa) / sa), 6) AS sigma_shift_pct, round(any_value(100 * (gb - ga) / ga), 6) AS gamma_shift_pct, round(corr(s1, s2), 6) AS cor_sigma, round(corr(g1, g2), 6) AS cor_gamma FROM j, m""")
def _(s, d):
    est = estimates(s, d)
    later = est.filter("exporter > 2").withColumns({"gamma": F.col("gamma") * 1.5 + F.col("tier"), "sigma": F.col("sigma") + F.col("adjust")})
    return S.step_comparison(est.filter("importer < 20"), later)


_RUNS = """count(*)::DOUBLE AS rows, median(gamma) AS gamma_median, quantile_cont(gamma, 0.25) AS gamma_p25, quantile_cont(gamma, 0.75) AS gamma_p75, quantile_cont(gamma, 0.95) AS gamma_p95, max(gamma) AS gamma_max, avg((gamma > 1)::INT) AS share_gamma_above_1, median(1 / gamma) AS supply_elasticity_median,
 median(sigma) AS sigma_median, avg((sigma >= 9.999)::INT) AS share_sigma_at_cap, median(gamma_se) AS gamma_se_median, avg((gamma_se IS NOT NULL)::INT) AS share_gamma_se, median(CASE WHEN tier < 3 THEN gamma_se * 2 END) AS gamma_se_total_median, median(sigma_se) AS sigma_se_median, avg((tier = 1)::INT) AS share_sigma_robust"""


@query("compare_runs", f"WITH {_EST}, o AS (SELECT {_RUNS} FROM est), w AS (SELECT {_RUNS} FROM est WHERE importer > 5), ol AS (UNPIVOT o ON COLUMNS(*) INTO NAME metric VALUE v), wl AS (UNPIVOT w ON COLUMNS(*) INTO NAME metric VALUE v) SELECT metric, round(ol.v, 6) AS old, round(wl.v, 6) AS new, round(wl.v - ol.v, 6) AS change FROM ol JOIN wl USING (metric)")
def _(s, d):
    est = estimates(s, d).withColumns({"gamma_se_total": F.when(F.col("tier") < 3, F.col("gamma_se") * 2), "sigma_robust": F.col("tier") == 1})
    return R.compare_runs(est, est.filter("importer > 5"))


@query("distribution_union", f"WITH {_EST}, l AS (SELECT 'gamma_se_status' AS k, gamma_se_status AS level, gamma <= 20 AS o, gamma >= 1 AS w FROM est UNION ALL SELECT 'tier', tier::VARCHAR, gamma <= 20, gamma >= 1 FROM est), c AS (SELECT k, level, count(*) FILTER (WHERE o) AS a, count(*) FILTER (WHERE w) AS b FROM l GROUP BY ALL), t AS (SELECT *, a / sum(a) OVER (PARTITION BY k) AS x, b / sum(b) OVER (PARTITION BY k) AS y FROM c) SELECT k AS \"column\", level, round(x, 6)::DOUBLE AS old, round(y, 6)::DOUBLE AS new, round(y - x, 6)::DOUBLE AS change FROM t")
def _(s, d):
    est = estimates(s, d)
    return R.distributions(est.filter("gamma <= 20"), est.filter("gamma >= 1"), "gamma_se_status", "tier")


@query("gap_totals", f"""WITH {_DIF}, g AS (SELECT p.*, q.t IS NULL AS fb, q.t IS NULL AND p.t <> min(p.t) OVER (PARTITION BY p.importer, p.exporter, p.good) AS st FROM prep p LEFT JOIN prep q ON q.importer = p.importer AND q.exporter = p.exporter AND q.good = p.good AND q.t = p.t - 1),
 x AS (SELECT importer, exporter, good, count(*) AS n, count(*) FILTER (WHERE st) AS st, count(*) FILTER (WHERE fb) AS fb FROM g GROUP BY ALL), c AS (SELECT importer, good, count(*) AS ns, count(*) FILTER (WHERE st > 0) AS nh, sum(n) AS n, sum(st) AS st, sum(fb) AS fb FROM x GROUP BY ALL)
 SELECT count(*) AS n_cells, count(*) FILTER (WHERE st > 0) AS n_cells_holed, sum(ns)::BIGINT AS n_series, sum(nh)::BIGINT AS n_series_holed, sum(n)::BIGINT AS n_rows, sum(st)::BIGINT AS n_stale_rows, sum(fb)::BIGINT AS n_fallback_rows,
 round(count(*) FILTER (WHERE st > 0) / count(*), 6)::DOUBLE AS share_cells_holed, round(sum(nh) / sum(ns), 6)::DOUBLE AS share_series_holed, round(sum(st) / sum(n), 6)::DOUBLE AS share_rows_stale FROM c""")
def _(s, d):
    return R.gap_totals(R.gap_census(prepared(s, d)))


_MAN = "f AS (SELECT DISTINCT good || '-' || importer AS local_path, importer, md5(good || importer) AS h, importer * 100 AS z FROM est)"


@query("manifest_check", f"WITH {_EST}, {_MAN}, l AS (SELECT local_path, CASE WHEN importer % 6 = 0 THEN 'PLACEHOLDER' WHEN importer % 6 = 1 THEN upper(h) || ' ' ELSE h END AS h, CASE WHEN importer % 6 = 2 THEN z + 1 ELSE z END AS z FROM f WHERE importer < 20), p AS (SELECT local_path, CASE WHEN importer % 6 = 3 THEN 'x' ELSE h END AS h, z FROM f WHERE importer > 3), j AS (SELECT coalesce(l.local_path, p.local_path) AS local_path, CASE WHEN p.local_path IS NULL THEN 'missing' WHEN l.local_path IS NULL THEN 'unlisted' WHEN l.h = 'PLACEHOLDER' THEN 'no_checksum' WHEN l.z <> p.z THEN 'size' WHEN lower(trim(l.h)) <> p.h THEN 'checksum' END AS problem FROM l FULL JOIN p ON l.local_path = p.local_path) SELECT * FROM j WHERE problem IS NOT NULL")
def _(s, d):
    i = F.col("importer")
    f = estimates(s, d).select("importer", F.concat_ws("-", "good", i.cast("string")).alias("local_path"), F.md5(F.concat("good", i.cast("string"))).alias("sha256"), (i * 100).alias("size_bytes")).distinct()
    listed = f.filter("importer < 20").withColumns({"sha256": F.when(i % 6 == 0, "PLACEHOLDER").when(i % 6 == 1, F.concat(F.upper("sha256"), F.lit(" "))).otherwise(F.col("sha256")), "size_bytes": F.when(i % 6 == 2, F.col("size_bytes") + 1).otherwise(F.col("size_bytes"))})
    present = f.filter("importer > 3").withColumn("sha256", F.when(i % 6 == 3, "x").otherwise(F.col("sha256")))
    return T.verify_manifest(listed, present)


_MAIN = "gamma_se_status = 'ok' AND gamma_se < 0.5 * gamma"


@query("cv_filter_tiers", f"""WITH {_EST}, x AS (SELECT sigma, gamma, CASE WHEN {_MAIN} AND final_source = 'hliml' AND (importer + exporter) % 9 >= 5 THEN 4 WHEN {_MAIN} AND final_source = 'hliml' THEN 3 WHEN {_MAIN} THEN 2 ELSE 1 END AS top FROM est)
 SELECT k::INT AS cv_tier, count(*) AS n, round(median(sigma), 6) AS sigma_median, round(median(gamma), 6) AS gamma_median FROM x, range(1, 5) AS r(k) WHERE k <= top GROUP BY k""")
def _(s, d):
    return L.cv_tiers(estimates(s, d).withColumn("gamma_exposure", (F.col("importer") + F.col("exporter")) % 9))


@query("weighted_spearman", f"""WITH {_EST}, x AS (SELECT sigma AS a, gamma AS b, (1 + importer % 5)::DOUBLE AS w FROM est WHERE exporter > 2),
 y AS (SELECT w, sum(w) OVER (ORDER BY a) - sum(w) OVER (PARTITION BY a) / 2 AS ra, sum(w) OVER (ORDER BY b) - sum(w) OVER (PARTITION BY b) / 2 AS rb FROM x),
 m AS (SELECT sum(w * ra) / sum(w) AS ma, sum(w * rb) / sum(w) AS mb FROM y)
 SELECT count(*) AS n, round(sum(w * (ra - ma) * (rb - mb)) / sqrt(sum(w * (ra - ma) ** 2) * sum(w * (rb - mb) ** 2)), 6) AS spearman FROM y, m""")
def _(s, d):
    return order.weighted_spearman(estimates(s, d).filter("exporter > 2").withColumn("w", (1 + F.col("importer") % 5).cast("double")), "sigma", "gamma", "w")


@query("ridge_analysis")
def _(s, d):
    est = estimates(s, d).withColumns({"gamma_exposure": F.lit(5), "good": F.concat(F.lpad(((F.col("importer") * 3 + F.col("exporter")) % 4 * 25 + 3).cast("string"), 2, "0"), F.substring("good", 3, 2)), "region": F.concat(F.lit("R"), (F.col("exporter") % 3).cast("string"))})
    return L.ridge_analysis(est)


_ROUTE_SQL = " UNION ALL ".join(f"SELECT 'routing', '{name}', count(*) FILTER (WHERE adjust = {code}), count(*) FROM z" for code, name in R.ROUTES.items())
_STATUS_SQL = " UNION ALL ".join(f"SELECT 'status', '{x}', count(*) FILTER (WHERE status = '{x}'), count(*) FROM z" for x in R.STATUSES)


@query("stage1_report", f"""WITH {_BOTH}, z AS (SELECT importer, good, status, CASE WHEN status = 'ok' THEN adjust END AS adjust, gamma / 1000 - 0.0012::DOUBLE AS omega, f > 4 AS stockyogo_pass, CASE WHEN nx % 3 > 0 THEN f > 6 END AS sargan_pass FROM bc)
 SELECT 'size' AS section, 'cells' AS metric, count(*) AS n, count(*) AS denominator FROM z UNION ALL SELECT 'size', 'products', count(DISTINCT good), count(*) FROM z UNION ALL SELECT 'size', 'importers', count(DISTINCT importer), count(*) FROM z
 UNION ALL SELECT 'tests', 'stockyogo_pass', count(*) FILTER (WHERE stockyogo_pass), count(stockyogo_pass) FROM z UNION ALL SELECT 'tests', 'sargan_pass', count(*) FILTER (WHERE sargan_pass), count(sargan_pass) FROM z
 UNION ALL {_ROUTE_SQL} UNION ALL SELECT 'routing', 'pre_discard', count(*) FILTER (WHERE adjust IS NULL), count(*) FROM z UNION ALL SELECT 'routing', 'other', count(*) FILTER (WHERE adjust > 8), count(*) FROM z
 UNION ALL SELECT 'routing_total', 'boundary_total', count(*) FILTER (WHERE adjust IN (6, 7, 8)), count(*) FROM z UNION ALL SELECT 'routing_total', 'step2_total', count(*) FILTER (WHERE adjust BETWEEN 1 AND 5), count(*) FROM z UNION ALL SELECT 'routing_total', 'clamped_total', count(*) FILTER (WHERE adjust IN (4, 5)), count(*) FROM z
 UNION ALL {_STATUS_SQL} UNION ALL SELECT 'status', 'prep_thin_total', count(*) FILTER (WHERE starts_with(status, 'prep_thin_n')), count(*) FROM z UNION ALL SELECT 'status', 'thin_panel_total', count(*) FILTER (WHERE starts_with(status, 'thin_panel_')), count(*) FROM z
 UNION ALL SELECT 'status', 'other', count(*) FILTER (WHERE status NOT IN ('ok', 'all_inversions_failed') AND NOT starts_with(status, 'thin_panel_')), count(*) FROM z UNION ALL SELECT 'floor', 'omega_floor', count(*) FILTER (WHERE omega <= 1e-4), count(*) FROM z
 UNION ALL SELECT 'rates', 'interior_full_universe', count(*) FILTER (WHERE adjust = 0), count(*) FROM z UNION ALL SELECT 'rates', 'interior_conditional_on_ok', count(*) FILTER (WHERE adjust = 0), count(*) FILTER (WHERE status = 'ok') FROM z UNION ALL SELECT 'rates', 'step2_full_universe', count(*) FILTER (WHERE adjust IN (1, 4, 5)), count(*) FROM z""")
def _(s, d):
    f = F.col("fstat_kp")
    cells = both_cells(s, d).withColumns({"adjust": F.when(F.col("status") == "ok", F.col("adjust")), "omega": F.col("gamma") / 1000 - 0.0012, "stockyogo_pass": f > 4, "sargan_pass": F.when(F.col("n_exporters") % 3 > 0, f > 6)})
    return R.stage1_report(cells)


@query("adjust_by_source", f"WITH {_EST} SELECT adjust, final_source, count(*) AS n FROM ecell GROUP BY ALL")
def _(s, d):
    return R.adjust_by_source(estimate_cells(s, d))


@query("stage2b_report", f"""WITH {_EST}, z AS (SELECT *, CASE WHEN tier < 3 THEN tier = 1 END AS robust, CASE WHEN importer % 4 = 0 THEN 10.0::DOUBLE ELSE sigma END AS s, gamma - 0.45 AS g FROM est), k AS (SELECT s, count(*) AS n FROM z WHERE s < 10 GROUP BY s ORDER BY n DESC, s LIMIT 1),
 w AS (SELECT count(*)::DOUBLE AS "size|rows", count(DISTINCT importer)::DOUBLE AS "size|importers", count(DISTINCT exporter)::DOUBLE AS "size|exporters", count(DISTINCT importer || '-' || good)::DOUBLE AS "size|sigmas",
  count(*) FILTER (WHERE s = 10)::DOUBLE AS "sigma_source|n_cap", count(*) FILTER (WHERE g <= 0)::DOUBLE AS "gamma_floor|n_floor", count(*) FILTER (WHERE gamma_se_status = 'ok')::DOUBLE AS "se_status|ok",
  count(*) FILTER (WHERE gamma_se_status = 'tier3_prior')::DOUBLE AS "se_status|tier3_prior", count(*) FILTER (WHERE gamma_se_status NOT IN ('ok', 'tier3_prior'))::DOUBLE AS "se_status|other",
  count(*) FILTER (WHERE robust)::DOUBLE AS "sigma_robust|robust", count(*) FILTER (WHERE NOT robust)::DOUBLE AS "sigma_robust|not_robust", count(*) FILTER (WHERE robust IS NULL)::DOUBLE AS "sigma_robust|unscreened",
  quantile_cont(s, 0.25) AS "quantiles|sigma_q25", median(s) AS "quantiles|sigma_median", quantile_cont(s, 0.75) AS "quantiles|sigma_q75", quantile_cont(g, 0.25) AS "quantiles|gamma_q25", median(g) AS "quantiles|gamma_median",
  quantile_cont(g, 0.75) AS "quantiles|gamma_q75", median(CASE WHEN g > 0 THEN 1 / g END) AS "quantiles|elasticity_median", (SELECT s FROM k) AS "sigma_source|fallback_value", (SELECT n FROM k)::DOUBLE AS "sigma_source|n_fallback" FROM z),
 l AS (UNPIVOT w ON COLUMNS(*) INTO NAME name VALUE v) SELECT split_part(name, '|', 1) AS section, split_part(name, '|', 2) AS metric, round(v, 6) AS value FROM l""")
def _(s, d):
    est = estimates(s, d).withColumns({"sigma_robust": F.when(F.col("tier") < 3, F.col("tier") == 1), "sigma": F.when(F.col("importer") % 4 == 0, 10.0).otherwise(F.col("sigma")), "gamma": F.col("gamma") - 0.45})
    return R.stage2b_report(est)


@query("bootstrap_summary", f"""WITH {_EST}, b AS (SELECT unnest(['OVERALL', final_source]) AS stratum, ((exporter * 7 + importer) % 20) / 20::DOUBLE AS y, CASE WHEN exporter % 5 > 0 THEN sigma_se * (0.5::DOUBLE + ((importer + exporter * 3) % 16) / 16::DOUBLE) END / sigma_se AS r,
  sigma_se * (0.25::DOUBLE + ((importer * 3 + exporter) % 16) / 16::DOUBLE) / sigma_se AS m FROM est)
 SELECT stratum, count(*) AS n_cells, count(r) AS n_ratio, round(avg((abs(ln(r)) <= ln(1.25))::INT), 6) AS share_within_25pct, round(median(y), 6) AS med_yield, round(quantile_cont(r, 0.25), 6) AS ratio_p25, round(median(r), 6) AS ratio_med, round(quantile_cont(r, 0.75), 6) AS ratio_p75,
  round(median(CASE WHEN r IS NOT NULL THEN m END), 6) AS ratio_mad_med FROM b GROUP BY stratum""")
def _(s, d):
    i, e, se = F.col("importer"), F.col("exporter"), F.col("sigma_se")
    cells = estimates(s, d).select(F.col("final_source").alias("stratum"), "sigma_se", ((e * 7 + i) % 20 / 20).alias("boot_yield"), F.when(e % 5 > 0, se * (0.5 + (i + e * 3) % 16 / 16)).alias("boot_sd"), (se * (0.25 + (i * 3 + e) % 16 / 16)).alias("boot_mad_sd"))
    return R.bootstrap_summary(cells)


_VARS = ("y", "x1", "x2")
_SYM = [(a, b) for i, a in enumerate(_VARS) for b in _VARS[i:]]
_T = ", ".join(f"sum(s_{a}_{b}) AS t_{a}_{b}, sum(s_{a} * s_{b} / n) AS b_{a}_{b}" for a, b in _SYM)
_WA = ", ".join(f"t_{a}_{b} - b_{a}_{b} AS w_{a}_{b}, t_{a}_{b} - c_{a} * c_{b} / n AS a_{a}_{b}" for a, b in _SYM)
_LIML = f"""{_M1}, lc AS (SELECT importer, good, sum(n)::DOUBLE AS n, count(*) AS l, sum(s_y) AS c_y, sum(s_x1) AS c_x1, sum(s_x2) AS c_x2, {_T} FROM gs GROUP BY importer, good HAVING sum(n) >= 5 AND count(*) >= 3),
 lw AS (SELECT *, {_WA} FROM lc),
 lp AS (SELECT *, w_x1_x1 - w_y_x1 ** 2 / w_y_y AS p2, w_x1_x2 - w_y_x2 * w_y_x1 / w_y_y AS p23, a_x1_x1 * a_x2_x2 - a_x1_x2 ** 2 AS f00, a_y_x2 * a_x1_x2 - a_y_x1 * a_x2_x2 AS f01, a_y_x1 * a_x1_x2 - a_y_x2 * a_x1_x1 AS f02,
  a_y_y * a_x2_x2 - a_y_x2 ** 2 AS f11, a_y_x1 * a_y_x2 - a_y_y * a_x1_x2 AS f12, a_y_y * a_x1_x1 - a_y_x1 ** 2 AS f22 FROM lw WHERE w_y_y > 0),
 lq AS (SELECT *, a_y_y * f00 + a_y_x1 * f01 + a_y_x2 * f02 AS da FROM lp WHERE p2 > 1e-11 * w_x1_x1 AND w_x2_x2 - w_y_x2 ** 2 / w_y_y - p23 ** 2 / p2 > 1e-11 * w_x2_x2),
 ln AS (SELECT *, (f00 * w_y_y + f01 * w_y_x1 + f02 * w_y_x2) / da AS n00, (f00 * w_y_x1 + f01 * w_x1_x1 + f02 * w_x1_x2) / da AS n01, (f00 * w_y_x2 + f01 * w_x1_x2 + f02 * w_x2_x2) / da AS n02,
  (f01 * w_y_y + f11 * w_y_x1 + f12 * w_y_x2) / da AS n10, (f01 * w_y_x1 + f11 * w_x1_x1 + f12 * w_x1_x2) / da AS n11, (f01 * w_y_x2 + f11 * w_x1_x2 + f12 * w_x2_x2) / da AS n12,
  (f02 * w_y_y + f12 * w_y_x1 + f22 * w_y_x2) / da AS n20, (f02 * w_y_x1 + f12 * w_x1_x1 + f22 * w_x1_x2) / da AS n21, (f02 * w_y_x2 + f12 * w_x1_x2 + f22 * w_x2_x2) / da AS n22 FROM lq),
 lm AS (SELECT *, (n00 + n11 + n22) / 3 AS m FROM ln),
 lr AS (SELECT *, ((n00 - m) ** 2 + (n11 - m) ** 2 + (n22 - m) ** 2 + 2 * (n01 * n10 + n02 * n20 + n12 * n21)) / 6 AS p, ((n00 - m) * ((n11 - m) * (n22 - m) - n12 * n21) - n01 * (n10 * (n22 - m) - n12 * n20) + n02 * (n10 * n21 - (n11 - m) * n20)) / 2 AS h FROM lm),
 ll AS (SELECT *, 1 / (m + 2 * sqrt(p) * cos(acos(greatest(-1, least(1, h / p ** 1.5))) / 3)) AS low FROM lr),
 lk AS (SELECT *, low - 1 / (n - l) AS kappa FROM ll),
 lv AS (SELECT *, t_x1_x1 - kappa * w_x1_x1 AS k11, t_x1_x2 - kappa * w_x1_x2 AS k12, t_x2_x2 - kappa * w_x2_x2 AS k22, t_y_x1 - kappa * w_y_x1 AS r1, t_y_x2 - kappa * w_y_x2 AS r2 FROM lk),
 lx AS (SELECT *, k11 - c_x1 ** 2 / n AS d11, k12 - c_x1 * c_x2 / n AS d12, k22 - c_x2 ** 2 / n AS d22, r1 - c_x1 * c_y / n AS e1, r2 - c_x2 * c_y / n AS e2 FROM lv),
 ly AS (SELECT *, (e1 * d22 - e2 * d12) / (d11 * d22 - d12 ** 2) AS eta1, (e2 * d11 - e1 * d12) / (d11 * d22 - d12 ** 2) AS eta2 FROM lx),
 lz AS (SELECT *, (c_y - eta1 * c_x1 - eta2 * c_x2) / n AS eta0 FROM ly),
 lf AS (SELECT *, b_x1_x1 - c_x1 ** 2 / n AS g11, b_x1_x2 - c_x1 * c_x2 / n AS g12, b_x2_x2 - c_x2 ** 2 / n AS g22, w_x1_x1 / (n - l) AS h11, w_x1_x2 / (n - l) AS h12, w_x2_x2 / (n - l) AS h22,
  t_y_y + eta1 ** 2 * t_x1_x1 + eta2 ** 2 * t_x2_x2 + eta0 ** 2 * n - 2 * eta1 * t_y_x1 - 2 * eta2 * t_y_x2 - 2 * eta0 * c_y + 2 * eta1 * eta2 * t_x1_x2 + 2 * eta0 * eta1 * c_x1 + 2 * eta0 * eta2 * c_x2 AS qt,
  b_y_y + eta1 ** 2 * b_x1_x1 + eta2 ** 2 * b_x2_x2 + eta0 ** 2 * n - 2 * eta1 * b_y_x1 - 2 * eta2 * b_y_x2 - 2 * eta0 * c_y + 2 * eta1 * eta2 * b_x1_x2 + 2 * eta0 * eta1 * c_x1 + 2 * eta0 * eta2 * c_x2 AS qb FROM lz),
 lo AS (SELECT *, (g11 * h22 + g22 * h11 - 2 * g12 * h12) / (h11 * h22 - h12 ** 2) AS tr, (g11 * g22 - g12 ** 2) / (h11 * h22 - h12 ** 2) AS de FROM lf)"""


@query("liml_step1", f"WITH {_LIML} SELECT importer, good, n::BIGINT AS n, l AS n_exporters, round(kappa, 5) AS kappa, round(eta1, 5) AS eta1, round(eta2, 5) AS eta2, round((tr - sqrt(greatest(tr ** 2 / 4 - de, 0)) * 2) / 2 / (l - 1), 5) AS fstat, round(qb / qt * n, 5) AS jstat FROM lo WHERE n - l >= 8", places=5)
def _(s, d):
    found = I.step_one(M.stage1_moments(raw(s, d)))
    return found.filter("kappa is not null and n - n_exporters >= 8").select("importer", "good", "n", "n_exporters", "kappa", "eta1", "eta2", "fstat", "jstat")


@query("liml_step2")
def _(s, d):
    return I.step_two(keep.kept(M.stage1_moments(raw(s, d))))
