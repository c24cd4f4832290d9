"""Logistic regression on sparse rows: one aggregate of normal equations a round, nothing collected but sums by term."""

from __future__ import annotations

import math
from itertools import pairwise

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import keep

#: The last two-digit chapter of each of the 21 sections of the Harmonized System.
SECTION_ENDS = (5, 14, 15, 24, 27, 38, 40, 43, 46, 49, 63, 67, 70, 71, 83, 85, 89, 92, 93, 96, 97)


def hs_section(good: Column) -> Column:
    """Section 1 to 21 of a code by its first two digits; null beyond."""
    chapter = F.substring(good, 1, 2).try_cast("int")
    out = None
    for k, (a, b) in enumerate(pairwise((0, *SECTION_ENDS)), 1):
        hit = (chapter > a) & (chapter <= b)
        out = F.when(hit, k) if out is None else out.when(hit, k)
    return out


class Logit:
    """Terms and coefficients of a fit: intercept, a dummy per level but the first of each factor, numbers as they are."""

    def __init__(self, terms: list[tuple[str, str | None]], beta: np.ndarray, log_lik: float, null_log_lik: float, n: int):
        self.terms, self.beta, self.n = terms, beta, n
        self.mcfadden = 1 - log_lik / null_log_lik if null_log_lik else float("nan")

    def eta(self) -> Column:
        """The linear predictor; a level that the fit did not see counts as the factor's first."""
        out = F.lit(float(self.beta[0]))
        for (name, level), b in zip(self.terms[1:], self.beta[1:], strict=True):
            out = out + (F.col(name).cast("double") if level is None else F.when(F.col(name).cast("string") == level, 1.0).otherwise(0.0)) * float(b)
        return out

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.eta()))


def fit(df: DataFrame, label: str, factors: list[str], numbers: list[str], rounds: int = 50, tol: float = 1e-10) -> Logit:
    """Maximum likelihood by Newton steps (reweighted normal equations). Rows with a null label, factor or number are left
    out. A row has one nonzero term per factor and number, so it adds (factors + numbers + 1)^2 / 2 products, summed by pair
    of terms inside each task first. The driver gets one number per pair, and the levels of the factors: give factors with
    few levels."""
    used = df.select(F.col(label).cast("double").alias("__y"), *[F.col(c).cast("string").alias(c) for c in factors], *[F.col(c).cast("double").alias(c) for c in numbers]).dropna()
    used = keep.kept(used)
    levels = {c: sorted(r[0] for r in used.select(c).distinct().collect()) for c in factors}
    terms: list[tuple[str, str | None]] = [("intercept", None)] + [(c, x) for c in factors for x in levels[c][1:]] + [(c, None) for c in numbers]
    at = {t: i for i, t in enumerate(terms)}
    one = lambda i, v: F.struct(i.cast("int").alias("i"), v.cast("double").alias("v"))
    cells = [one(F.lit(0), F.lit(1.0))]
    for c in factors:
        place = F.create_map(*[F.lit(x) for level in levels[c][1:] for x in (level, at[c, level])])[F.col(c)] if len(levels[c]) > 1 else F.lit(None).cast("int")
        cells.append(one(place, F.lit(1.0)))
    cells += [one(F.lit(at[c, None]), F.col(c)) for c in numbers]
    rows = used.select("__y", F.filter(F.array(*cells), lambda x: x["i"].isNotNull()).alias("__x"))
    k = len(terms)
    beta, value = np.zeros(k), -math.inf

    def sums(beta):
        b = F.array(*[F.lit(float(x)) for x in beta])
        eta = F.aggregate("__x", F.lit(0.0), lambda s, x: s + F.get(b, x["i"]) * x["v"])
        p = rows.withColumn("__e", eta).withColumn("__p", 1 / (1 + F.exp(-F.col("__e"))))
        pair = lambda a: F.transform(F.filter("__x", lambda c: c["i"] >= a["i"]), lambda c: F.struct(a["i"].alias("i"), c["i"].alias("j"), (F.col("__p") * (1 - F.col("__p")) * a["v"] * c["v"]).alias("v")))
        slope = F.transform("__x", lambda a: F.struct(a["i"].alias("i"), F.lit(-1).alias("j"), ((F.col("__y") - F.col("__p")) * a["v"]).alias("v")))
        soft = F.when(F.col("__e") > 0, F.col("__e") + F.log1p(F.exp(-F.col("__e")))).otherwise(F.log1p(F.exp("__e")))
        fit_of = F.array(F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j"), (F.col("__y") * F.col("__e") - soft).alias("v")))
        long = p.select(F.explode(F.concat(F.flatten(F.transform("__x", pair)), slope, fit_of)).alias("s"))
        h, g, log_lik = np.zeros((k, k)), np.zeros(k), 0.0
        for r in long.groupBy("s.i", "s.j").agg(F.sum("s.v").alias("v")).collect():
            if r["i"] < 0:
                log_lik = r["v"]
            elif r["j"] < 0:
                g[r["i"]] = r["v"]
            else:
                h[r["i"], r["j"]] = h[r["j"], r["i"]] = r["v"]
        return h, g, log_lik

    n, ones = used.agg(F.count("*"), F.sum("__y")).first()
    null = 0.0 if not n or not 0 < ones < n else ones * math.log(ones / n) + (n - ones) * math.log(1 - ones / n)
    h, g, value = sums(beta) if n else (np.eye(k), np.zeros(k), 0.0)
    for _ in range(rounds):
        step = np.linalg.lstsq(h, g, rcond=1e-12)[0]
        size = 1.0
        while True:
            ahead = sums(beta + size * step) if n else (h, g, value)
            if ahead[2] >= value - 1e-12 * abs(value) or size < 1e-6:
                break
            size /= 2
        beta = beta + size * step
        h, g, value = ahead
        if np.abs(size * step).max(initial=0.0) < tol or np.abs(step).max(initial=0.0) > 1e3:
            break
    return Logit(terms, beta, value, null, n)
