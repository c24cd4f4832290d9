"""Column expressions of the trade panel: codes, weights, structural inversion, robust statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def pad_hs6(code: Column) -> Column:
    """Numeric product codes shorter than six digits get their leading zeros back; anything longer stays."""
    return F.when(F.length(code) < 6, F.when(code.rlike("^[0-9]+$"), F.lpad(code, 6, "0"))).otherwise(code)


def hs6_to_hs4(code: Column) -> Column:
    return F.substring(code, 1, 4)


def finite_positive(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (x > 0) & (x < float("inf"))


def log_ratio(a: Column, b: Column) -> Column:
    return F.log(F.try_divide(a, b))


def calendar_lag(value: str, by: list[str], t: str = "t") -> Column:
    """The value at exactly t - 1 of the same series; null across a gap."""
    return F.max(value).over(W.partitionBy(*by).orderBy(t).rangeBetween(-1, -1))


def positional_lag(value: str, by: list[str], t: str = "t") -> Column:
    """The value of the previous row of the series, however long ago."""
    return F.lag(value).over(W.partitionBy(*by).orderBy(t))


def consecutive_diff(value: str, by: list[str], t: str = "t") -> Column:
    """First difference where the previous row is the previous year, else null."""
    w = W.partitionBy(*by).orderBy(t)
    return F.when(F.col(t) - F.lag(t).over(w) == 1, F.col(value) - F.lag(value).over(w))


def bw_weight(value: Column, lagged: Column, periods: Column) -> Column:
    """Weight of a moment row, T^1.5 (1/x_t + 1/x_{t-1})^-0.5; 1 where the lag is missing or the result not finite."""
    w = F.pow(periods.cast("double"), F.lit(1.5)) * F.try_divide(F.lit(1.0), F.sqrt(F.try_divide(F.lit(1.0), value) + F.try_divide(F.lit(1.0), lagged)))
    return F.when(w.isNull() | F.isnan(w) | (F.abs(w) == float("inf")), 1.0).otherwise(w)


def weighted_mean(x: Column, w: Column) -> Column:
    return F.try_divide(F.sum(F.when(x.isNotNull(), w * x)), F.sum(F.when(x.isNotNull(), w)))


def optimal_tariff(gamma: Column, sigma: Column, weight: Column, where: Column | None = None) -> Column:
    """Aggregate: sum(w g / (1 + g s)) / sum(w / (1 + g s)) over g > 0, w > 0; null if there is none."""
    ok = (gamma > 0) & (weight > 0)
    ok = ok & where if where is not None else ok
    return F.try_divide(F.sum(F.when(ok, weight * gamma / (1 + gamma * sigma))), F.sum(F.when(ok, weight / (1 + gamma * sigma))))


def boundary_flags(edge: Column, sigma: Column, omega: Column, sigma_cap: float, omega_cap: float, tol: float = 1e-3) -> tuple[Column, Column]:
    def flag(name, x, cap):
        return F.coalesce(edge == name, F.lit(False)) | F.coalesce(x >= cap - tol, F.lit(False))

    return flag("sigma_cap", sigma, sigma_cap), flag("omega_cap", omega, omega_cap)


def sigma_provenance(source: Column, adjust: Column) -> Column:
    return (
        F.when(source == "hliml", "interior")
        .when(source == "hliml_boundary", "boundary")
        .when(adjust == 4, "sigma_capped")
        .when(adjust == 5, "omega_capped")
        .when(source == "step2_weighted", "second_step")
        .otherwise("failed")
    )


def invert_structural(df: DataFrame, eta1: str, eta2: str, rho_floor=1e-4, rho_ceil=0.999, sigma_ceil=1000.0, omega_floor=1e-4, omega_ceil=1000.0) -> DataFrame:
    """df plus sigma, rho, omega, status from two columns of reduced-form coefficients.

    The quadratic's root on the side of eta2's sign gives rho, then sigma and omega follow; each is clamped, and the
    status names the first step that fails (constraint_violated keeps its values). One projection per step keeps each
    intermediate value from being written out again wherever it is used."""
    e1, e2 = F.col(eta1), F.col(eta2)
    ok_eta = e1.isNotNull() & e2.isNotNull() & ~F.isnan(e1) & ~F.isnan(e2) & (F.abs(e1) < float("inf")) & (F.abs(e2) < float("inf"))
    out = df.withColumn("__disc", F.when(ok_eta & (e1 > 0), 0.25 - F.try_divide(F.lit(1.0), 4 + e2 * e2 / e1)))
    out = out.withColumn("__root", F.sqrt(F.greatest("__disc", F.lit(0.0))))
    out = out.withColumn("rho", F.when(F.col("__disc") >= 0, F.least(F.greatest(F.when(e2 > 0, 0.5 + F.col("__root")).otherwise(0.5 - F.col("__root")), F.lit(rho_floor)), F.lit(rho_ceil))))
    out = out.withColumn("__raw", 1 + F.try_divide(2 * F.col("rho") - 1, (1 - F.col("rho")) * e2))
    out = out.withColumn("sigma", F.when(F.col("__raw") > 1, F.when(F.col("__raw") > sigma_ceil, sigma_ceil).otherwise(F.col("__raw"))))
    out = out.withColumn("__denom", F.col("sigma") - 1 - F.col("sigma") * F.col("rho"))
    out = out.withColumn("omega", F.when(F.abs("__denom") >= 1e-12, F.least(F.greatest(F.col("rho") / F.nullif("__denom", F.lit(0.0)), F.lit(omega_floor)), F.lit(omega_ceil))))
    status = (
        F.when(~ok_eta, "non_finite_eta").when(e1 <= 0, "eta1_nonpositive").when(F.col("__disc") < 0, "neg_discriminant").when(F.col("sigma").isNull(), "sigma_below_1")
        .when(F.col("omega").isNull(), "omega_div_zero").when(F.col("rho") < (F.col("sigma") - 1) / F.col("sigma"), "ok").otherwise("constraint_violated")
    )
    return out.withColumn("status", status).drop("__disc", "__root", "__raw", "__denom")


def delta_ses(df: DataFrame, sigma: str, rho: str, v11: Column, v12: Column, v22: Column) -> DataFrame:
    """df plus sigma_se, rho_se, omega_se: delta-method standard errors from the coefficients' covariance."""
    out = df.withColumns({"__s": F.col(sigma) - 1, "__r": 1 - F.col(rho), "__p": F.col(rho), "__v11": v11, "__v12": v12, "__v22": v22})
    s, r, p = F.col("__s"), F.col("__r"), F.col("__p")
    out = out.withColumns({"__a": -s * s * s * r, "__b": s * s * r, "__c": (1 - 2 * p) * s * s * r * r, "__e": 2 * p * s * r * r})
    a, b, c, e, v1, v2, v3 = (F.col(f"__{x}") for x in ("a", "b", "c", "e", "v11", "v12", "v22"))
    out = out.withColumns({
        "__vs": F.greatest(a * a * v1 + 2 * a * b * v2 + b * b * v3, F.lit(0.0)), "__vr": F.greatest(c * c * v1 + 2 * c * e * v2 + e * e * v3, F.lit(0.0)),
        "__cov": a * c * v1 + (a * e + b * c) * v2 + b * e * v3, "__d4": F.pow((s + 1) * (p - 1) + 1, F.lit(4)),
    })
    vs, vr = F.col("__vs"), F.col("__vr")
    out = out.withColumn("__vo", F.try_divide(p * p * r * r * vs + s * s * vr - 2 * s * p * r * F.col("__cov"), F.col("__d4")))
    done = out.withColumns({"sigma_se": F.sqrt(vs), "rho_se": F.sqrt(vr), "omega_se": F.when((F.col("__d4") >= 1e-20) & (F.col("__vo") >= 0), F.sqrt("__vo"))})
    return done.drop(*[x for x in done.columns if x.startswith("__")])


def min_eigen_2x2(a11: Column, a12: Column, a22: Column, b11: Column, b12: Column, b22: Column) -> Column:
    """Least eigenvalue of B^-1 A for symmetric 2x2 matrices, B positive definite (null if singular)."""
    det_b = b11 * b22 - b12 * b12
    trace = F.try_divide(a11 * b22 + a22 * b11 - 2 * a12 * b12, det_b)
    det = F.try_divide(a11 * a22 - a12 * a12, det_b)
    return trace / 2 - F.sqrt(F.greatest(trace * trace / 4 - det, F.lit(0.0)))


def sigma_robust(sigma: Column, sigma_se: Column, adjust: Column, worst_inflation: Column, k_pole: float = 2.5, limit: float = 2.0, eps: float = 1e-6) -> Column:
    """False for a capped sigma, one without a standard error or too near its pole, and where a gamma of the cell has
    its standard error inflated beyond the limit (worst_inflation: their maximum, null if there is none)."""
    return (
        F.coalesce(adjust != 4, F.lit(True)) & sigma_se.isNotNull() & ~F.isnan(sigma_se) & (F.abs(sigma_se) < float("inf"))
        & F.coalesce(sigma - k_pole * sigma_se > 1 + eps, F.lit(False)) & F.coalesce(worst_inflation <= limit, F.lit(True))
    )


def chi2_sf(x: Column, df: Column) -> Column:
    """Upper tail of chi-squared for a whole number of degrees of freedom, as a finite sum; null for df < 1.

    Even df: exp(-x/2) sum_{i < df/2} (x/2)^i / i!. Odd df: erfc(sqrt(x/2)) plus the same sum over half-integers; erfc by
    its continued rational approximation, absolute error below 1.2e-7."""
    h = F.greatest(x, F.lit(0.0)) / 2
    even = F.exp(-h) * F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), (df / 2).cast("int"))), F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda s, i: F.struct((s["term"] * h / i).alias("term"), (s["sum"] + s["term"]).alias("sum")), lambda s: s["sum"],
    )
    z = F.sqrt(h)
    u = 1 / (1 + 0.5 * z)
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = poly * u + c
    erfc = u * F.exp(-z * z + poly)
    odd = erfc + F.when(df >= 3, F.exp(-h) * F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), ((df - 1) / 2).cast("int"))), F.struct((2 * F.sqrt(h / F.lit(3.141592653589793))).alias("term"), F.lit(0.0).alias("sum")),
        lambda s, i: F.struct((s["term"] * h / (i + 0.5)).alias("term"), (s["sum"] + s["term"]).alias("sum")), lambda s: s["sum"],
    )).otherwise(0.0)
    return F.when(df >= 1, F.least(F.greatest(F.when(df % 2 == 0, even).otherwise(odd), F.lit(0.0)), F.lit(1.0)))
