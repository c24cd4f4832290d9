"""Steps 1 and 2 of the import-demand estimate from sums by exporter: Fuller's k-class with exporter dummies as instruments,
its weak-instrument and overidentification statistics, all in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import columns as X
from ..functions import keep
from . import moments as M

CELL = ["importer", "good"]
V = ("y", "x1", "x2")
#: A pivot below this share of its diagonal is rounding: the matrix is singular.
SINGULAR = 1e-11
_PAIRS = [(a, b) for i, a in enumerate(V) for b in V[i:]]


def _sym(prefix: str, a: str, b: str) -> Column:
    return F.col(f"{prefix}_{a}_{b}" if V.index(a) <= V.index(b) else f"{prefix}_{b}_{a}")


def least_root(df: DataFrame, low: str, high: str, out: str) -> DataFrame:
    """df plus ``out``, the least eigenvalue of low^-1 high for symmetric 3 x 3 columns <name>_<a>_<b>; null where either is
    not positive definite (a pivot is none below SINGULAR of its diagonal). It is the inverse of the largest eigenvalue of high^-1 low, which lies in (0, 1] where high exceeds
    low: the well-conditioned end of the pencil. high is factored, the other brought to its base, and the largest root of the
    cubic follows from an arc cosine."""
    root = lambda c: F.when(c > 0, F.sqrt(c))
    h, w = (lambda a, b: _sym(high, a, b)), (lambda a, b: _sym(low, a, b))
    c = F.col
    df = df.withColumn("__l11", root(h("y", "y")))
    df = df.withColumns({"__l21": h("x1", "y") / c("__l11"), "__l31": h("x2", "y") / c("__l11")})
    df = df.withColumn("__l22", root(h("x1", "x1") - c("__l21") * c("__l21")))
    df = df.withColumn("__l32", (h("x2", "x1") - c("__l31") * c("__l21")) / c("__l22"))
    df = df.withColumn("__l33", root(h("x2", "x2") - c("__l31") * c("__l31") - c("__l32") * c("__l32")))

    def forward(df, of, name):
        """Columns name1..3<j> that solve L name = of for each j."""
        for i in (1, 2, 3):
            df = df.withColumns({f"{name}{i}{j}": (of(i, j) - sum((c(f"__l{i}{k}") * c(f"{name}{k}{j}") for k in range(1, i)), F.lit(0.0))) / c(f"__l{i}{i}") for j in (1, 2, 3)})
        return df

    df = forward(df, lambda i, j: w(V[i - 1], V[j - 1]), "__x")
    df = forward(df, lambda i, j: c(f"__x{j}{i}"), "__n")
    df = df.withColumn("__m", (c("__n11") + c("__n22") + c("__n33")) / 3)
    df = df.withColumns({f"__k{i}": c(f"__n{i}{i}") - c("__m") for i in (1, 2, 3)})
    off = c("__n12") * c("__n12") + c("__n13") * c("__n13") + c("__n23") * c("__n23")
    df = df.withColumn("__p", (c("__k1") * c("__k1") + c("__k2") * c("__k2") + c("__k3") * c("__k3") + 2 * off) / 6)
    det = (
        c("__k1") * (c("__k2") * c("__k3") - c("__n23") * c("__n23")) - c("__n12") * (c("__n12") * c("__k3") - c("__n23") * c("__n13"))
        + c("__n13") * (c("__n12") * c("__n23") - c("__k2") * c("__n13"))
    )
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(det / 2, F.pow("__p", 1.5))))) / 3
    df = df.withColumn("__t", c("__m") + F.when(c("__p") > 0, 2 * F.sqrt("__p") * F.cos(angle)).otherwise(0.0))
    # a Newton step on det(N - t) takes out what the arc cosine loses near double roots
    df = df.withColumns({f"__k{i}": c(f"__n{i}{i}") - c("__t") for i in (1, 2, 3)})
    slope = -(c("__k1") * c("__k2") + c("__k1") * c("__k3") + c("__k2") * c("__k3") - off)
    df = df.withColumns({"__d": det, "__s": slope})
    better = c("__t") - F.try_divide(c("__d"), c("__s"))
    df = df.withColumn("__t", F.when(F.abs(better - c("__t")) < 1e-6 * F.abs("__t"), better).otherwise(c("__t")))
    ratio = lambda a, b, d: F.try_divide(a * b, d)
    second = w("x1", "x1") - ratio(w("x1", "y"), w("x1", "y"), w("y", "y"))
    df = df.withColumns({"__a": second, "__b": w("x2", "x1") - ratio(w("x2", "y"), w("x1", "y"), w("y", "y"))})
    third = w("x2", "x2") - ratio(w("x2", "y"), w("x2", "y"), w("y", "y")) - ratio(c("__b"), c("__b"), c("__a"))
    definite = (w("y", "y") > 0) & (c("__a") > SINGULAR * w("x1", "x1")) & (third > SINGULAR * w("x2", "x2"))
    return df.withColumn(out, F.when(definite & (c("__t") > 0) & c("__l33").isNotNull(), 1 / c("__t"))).drop(*[x for x in df.columns if x.startswith("__")])


def _inverse3(m: dict[tuple[int, int], Column], i: int, j: int) -> Column:
    """Cofactor of a symmetric 3 x 3 matrix, the inverse's entry but for the determinant."""
    a, b = [k for k in range(3) if k != i], [k for k in range(3) if k != j]
    minor = m[a[0], b[0]] * m[a[1], b[1]] - m[a[0], b[1]] * m[a[1], b[0]]
    return minor if (i + j) % 2 == 0 else -minor


def k_class(sums: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(importer, good, n, n_exporters, lambda_min, kappa, eta1, eta2, eta0, fstat, jstat) from sums by exporter with a weight
    ``w`` each: moments.group_sums plus w. eta0 is the constant. Cells of fewer than five rows, of fewer than three
    exporters, or whose moments within exporters are singular have nulls."""
    w = F.col("w")
    firsts = [F.sum("n").alias("n"), F.count("*").alias("n_exporters"), F.sum(w * F.col("n")).alias("c"), *[F.sum(w * F.col(f"s_{a}")).alias(f"c_{a}") for a in V]]
    seconds = [x for a, b in _PAIRS for x in (F.sum(w * F.col(f"s_{a}_{b}")).alias(f"t_{a}_{b}"), F.sum(w * F.col(f"s_{a}") * F.col(f"s_{b}") / F.col("n")).alias(f"b_{a}_{b}"))]
    cell = sums.groupBy(*CELL).agg(*firsts, *seconds)
    cell = cell.withColumns({f"in_{a}_{b}": F.col(f"t_{a}_{b}") - F.col(f"b_{a}_{b}") for a, b in _PAIRS} | {f"all_{a}_{b}": F.col(f"t_{a}_{b}") - F.col(f"c_{a}") * F.col(f"c_{b}") / F.col("c") for a, b in _PAIRS})
    cell = least_root(cell, "in", "all", "lambda_min")
    enough = (F.col("n") >= 5) & (F.col("n_exporters") >= 3)
    cell = cell.withColumn("lambda_min", F.when(enough, F.col("lambda_min")))
    cell = cell.withColumn("kappa", F.col("lambda_min") - F.try_divide(F.lit(alpha), F.col("n") - F.col("n_exporters")))
    mixed = {f"k_{a}_{b}": F.col(f"t_{a}_{b}") - F.col("kappa") * F.col(f"in_{a}_{b}") for a, b in _PAIRS}
    cell = cell.withColumns(mixed)
    names = ("x1", "x2", None)
    entry = lambda a, b: F.col("c") if a is None and b is None else F.col(f"c_{a or b}") if a is None or b is None else _sym("k", a, b)
    m = {(i, j): entry(a, b) for i, a in enumerate(names) for j, b in enumerate(names)}
    cell = cell.withColumns({f"i{i}{j}": _inverse3(m, i, j) for i in range(3) for j in range(i, 3)})
    inv = lambda i, j: F.col(f"i{min(i, j)}{max(i, j)}")
    cell = cell.withColumn("det", m[0, 0] * inv(0, 0) + m[0, 1] * inv(0, 1) + m[0, 2] * inv(0, 2))
    right = [_sym("k", "x1", "y"), _sym("k", "x2", "y"), F.col("c_y")]
    cell = cell.withColumns({e: F.try_divide(sum((inv(i, j) * right[j] for j in range(3)), F.lit(0.0)), F.col("det")) for i, e in enumerate(("eta1", "eta2", "eta0"))})
    q = {"y": F.lit(1.0), "x1": -F.col("eta1"), "x2": -F.col("eta2"), None: -F.col("eta0")}

    def form(p):
        out = q[None] * q[None] * F.col("c")
        for a in V:
            out = out + 2 * q[a] * q[None] * F.col(f"c_{a}")
            for b in V:
                out = out + q[a] * q[b] * _sym(p, a, b)
        return out

    part = lambda a, b: _sym("b", a, b) - F.col(f"c_{a}") * F.col(f"c_{b}") / F.col("c")
    rest = lambda a, b: F.try_divide(_sym("in", a, b), F.col("n") - F.col("n_exporters"))
    pairs = (("x1", "x1"), ("x1", "x2"), ("x2", "x2"))
    least = X.min_eigen_2x2(*[part(*p) for p in pairs], *[rest(*p) for p in pairs])
    known = F.col("kappa").isNotNull()
    out = cell.select(
        *CELL, "n", "n_exporters", "lambda_min", "kappa", "eta1", "eta2", "eta0", F.when(known, F.try_divide(least, F.col("n_exporters") - 1)).alias("fstat"), F.try_divide(form("b"), form("t")).alias("__j"),
        *[F.try_divide(inv(i, j), F.col("det")).alias(f"v{i}{j}") for i in range(3) for j in range(i, 3)],
    )
    # kept, because a filter on a result would be pushed down with all its terms written out
    return keep.kept(out.withColumn("jstat", F.col("__j") * F.col("n")).drop("__j"))


def step_one(moments: DataFrame) -> DataFrame:
    """k_class of every cell with all weights 1."""
    return k_class(M.group_sums(moments).withColumn("w", F.lit(1.0)))


def step_two(moments: DataFrame) -> DataFrame:
    """k_class with rows weighted by the inverse mean squared residual of step 1 of their exporter, plus jstat_pval, and
    v11, v12, v22: the covariance of eta1 and eta2, robust to heteroskedasticity.

    A mean is held above a hundredth of the cell's least positive squared residual, and weights average 1 over a cell's
    rows. Moments come dealt by cell, so that sums, residuals and joins by cell need no exchange of their own."""
    sums, first = M.group_sums(moments), step_one(moments).select(*CELL, "eta1", "eta2", "eta0")
    u = lambda: F.col("y") - F.col("eta1") * F.col("x1") - F.col("eta2") * F.col("x2") - F.col("eta0")
    known = moments.join(first.filter("eta0 is not null"), CELL).withColumn("u2", u() * u())
    spread = known.groupBy(*CELL, "exporter").agg(F.avg("u2").alias("mean"), F.min(F.when(F.col("u2") > 0, F.col("u2"))).alias("least"))
    cell = W.partitionBy(*CELL)
    floor = F.greatest(F.lit(1e-10), F.coalesce(0.01 * F.min("least").over(cell), F.lit(1e-10)))
    weights = spread.withColumn("w", 1 / F.greatest("mean", floor)).select(*CELL, "exporter", "w")
    both = sums.join(weights, [*CELL, "exporter"])
    both = both.withColumn("w", F.col("w") * F.sum("n").over(cell) / F.sum(F.col("w") * F.col("n")).over(cell))
    both = keep.kept(both)
    second = k_class(both)
    rows = moments.join(both.select(*CELL, "exporter", "w"), [*CELL, "exporter"]).join(second.select(*CELL, "eta1", "eta2", "eta0"), CELL).withColumn("e", F.col("w") * F.col("w") * u() * u())
    terms = ("x1", "x2", "1.0D")
    meat = rows.groupBy(*CELL).agg(*[F.sum(F.col("e") * F.expr(terms[i]) * F.expr(terms[j])).alias(f"m{i}{j}") for i in range(3) for j in range(i, 3)])
    out = second.join(meat, CELL)
    s = lambda p, i, j: F.col(f"{p}{min(i, j)}{max(i, j)}")
    cov = lambda i, j: sum((s("v", i, k) * s("m", k, l) * s("v", l, j) for k in range(3) for l in range(3)), F.lit(0.0))  # noqa: E731, E741
    plain = [c for c in second.columns if c[0] != "v"]
    return out.select(*plain, X.chi2_sf(F.col("jstat"), F.col("n_exporters") - 3).alias("jstat_pval"), cov(0, 0).alias("v11"), cov(0, 1).alias("v12"), cov(1, 1).alias("v22"))
