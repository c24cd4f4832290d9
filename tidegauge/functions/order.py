"""Order statistics of many groups at once: exact quantiles, deviations and weighted ranks by range partitions, so that no
group, however large or full of ties, is one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import keep

#: Rows per range partition at most, roughly, beyond the session's number of shuffle partitions.
ROWS = 2_000_000


def _clear(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v)


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """a with b's columns by keys, of which nulls are keys as well; rows of a that b lacks stay."""
    if not keys:
        return a.join(F.broadcast(b), F.lit(True), "left")  # b is one row
    other = b.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = reduce(lambda x, y: x & y, [a[k].eqNullSafe(other[f"__{k}"]) for k in keys])
    return a.join(other, on, "left").drop(*[f"__{k}" for k in keys])


def _dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, __v) plus ``__at``, a number that rises along (keys, __v), by 1 within a partition. Ranges are cut by
    (keys, value, number of the row), so a value that many rows hold is split too; both tables are kept, because numbers
    given twice would differ."""
    numbered = keep.kept(rows.withColumn("__row", F.monotonically_increasing_id()))
    parts = max(keep.width(rows.sparkSession), -(-numbered.count() // ROWS))
    order = [*keys, "__v", "__row"]
    placed = numbered.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return keep.kept(placed.select(*keys, "__v", F.monotonically_increasing_id().alias("__at")))


def quantiles_by(df: DataFrame, keys: list[str], cols: dict[str, Column], shares: list[float]) -> DataFrame:
    """One row per group: the keys and, for each name of ``cols``, an array of its quantiles in the order of ``shares``,
    interpolated between neighbours; null where a group has no value. Nulls and NaN are no values; a null key is a key;
    no keys give one row. All columns share one range shuffle.

    Partitions tell how many values of each group they hold. From these counts follow partition and place of every
    order statistic that is asked for, and only those rows are read again."""
    names = list(cols)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("__c"), c.cast("double").alias("__v")) for i, c in enumerate(cols.values())])).alias("__e")
    rows = df.select(*keys, each).select(*keys, "__e.__c", "__e.__v").filter(_clear(F.col("__v")))
    group = [*keys, "__c"]
    dealt = _dealt(rows, group)
    counts = dealt.groupBy(*group, F.shiftright("__at", 33).alias("__p")).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    whole = W.partitionBy(*group)
    before = F.coalesce(F.sum("__n").over(whole.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumns({"__before": before, "__total": F.sum("__n").over(whole)})
    asked = []
    for i, p in enumerate(shares):
        h = (F.col("__total") - 1) * p
        asked += [F.struct(F.lit(i).alias("i"), F.lit(up).alias("up"), F.when(F.lit(up), F.ceil(h)).otherwise(F.floor(h)).alias("rank"), (h - F.floor(h)).alias("part")) for up in (False, True)]
    wanted = placed.select(*group, "__before", "__n", "__first", F.explode(F.array(*asked)).alias("q"))
    wanted = wanted.filter((F.col("q.rank") >= F.col("__before")) & (F.col("q.rank") < F.col("__before") + F.col("__n")))
    wanted = wanted.select(*group, "q.i", "q.up", "q.part", (F.col("__first") + F.col("q.rank") - F.col("__before")).alias("__at"))
    found = wanted.join(dealt.select("__at", "__v"), "__at")
    low, high = (F.max(F.when(F.col("up") == F.lit(up), F.col("__v"))) for up in (False, True))
    values = found.groupBy(*group, "i").agg((low + F.max("part") * (high - low)).alias("__q"))
    listed = [F.transform(F.array_sort(F.collect_list(F.when(F.col("__c") == k, F.struct("i", "__q")))), lambda x: x["__q"]) for k in range(len(names))]
    return values.groupBy(*keys).agg(*[F.when(F.size(v) > 0, v).alias(n) for n, v in zip(names, listed, strict=True)])


def quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """One row per group: the keys and each named quantile (column, share)."""
    shares = sorted({p for _, p in wanted.values()})
    columns: dict[str, Column] = {}
    place: dict[str, str] = {}
    for c, _ in wanted.values():
        place.setdefault(str(c), f"__q{len(place)}")
        columns[place[str(c)]] = c
    found = quantiles_by(df, keys, columns, shares)
    return found.select(*keys, *[F.get(place[str(c)], F.lit(shares.index(p))).alias(n) for n, (c, p) in wanted.items()])


def mads_by(df: DataFrame, keys: list[str], col: str, out: str) -> DataFrame:
    """Per group the median distance from the group's median."""
    rows = keep.kept(df.select(*keys, col).filter(_clear(F.col(col))))
    away = same_keys(rows, quantiles(rows, keys, {"__m": (F.col(col), 0.5)}), keys)
    return quantiles(away, keys, {out: (F.abs(F.col(col) - F.col("__m")), 0.5)})


def weighted_ranks(df: DataFrame, col: str, weight: str, out: str) -> DataFrame:
    """df's rows that have a value and a positive weight, plus ``out``: the weight of all smaller values and half of the
    value's own. Equal weights of 1 give the usual mean ranks less a half.

    Weights are first added up by value. Range partitions of values tell their sums, one number each; adding those of
    the partitions before and those within the partition gives every value's place."""
    rows = keep.kept(df.filter(_clear(F.col(col)) & (F.col(weight) > 0)))
    values = rows.groupBy(F.col(col).alias("__v")).agg(F.sum(weight).alias("__w"))
    numbered = keep.kept(values)
    parts = max(keep.width(df.sparkSession), -(-numbered.count() // ROWS))
    dealt = keep.kept(numbered.repartitionByRange(parts, "__v").withColumn("__p", F.spark_partition_id()))
    sums = sorted((r["__p"], r["s"]) for r in dealt.groupBy("__p").agg(F.sum("__w").alias("s")).collect())
    before, total = {}, 0.0
    for p, s in sums:
        before[p] = total
        total += s
    start = F.create_map(*[F.lit(x) for p, s in before.items() for x in (p, s)])[F.col("__p")] if before else F.lit(0.0)
    upto = F.sum("__w").over(W.partitionBy("__p").orderBy("__v"))
    ranks = dealt.select("__v", (start + upto - F.col("__w") / 2).alias(out))
    return rows.join(ranks, F.col(col) == F.col("__v")).drop("__v")


def weighted_quantiles(df: DataFrame, col: str, weight: str, shares: list[float]) -> list[float | None]:
    """The least value that, with all smaller ones, holds each share of the weight; none of an empty column."""
    ranks = keep.kept(weighted_ranks(df.select(col, weight), col, weight, "__r").groupBy(col).agg(F.max("__r").alias("__r"), F.sum(weight).alias("__w")))
    total = ranks.agg(F.sum("__w")).first()[0]
    if total is None:
        return [None] * len(shares)
    held = F.col("__r") + F.col("__w") / 2
    row = ranks.agg(*[F.min(F.when(held >= p * total * (1 - 1e-12), F.col(col))).alias(f"q{i}") for i, p in enumerate(shares)]).first()
    return [row[i] for i in range(len(shares))]


def weighted_spearman(df: DataFrame, a: str, b: str, weight: str) -> DataFrame:
    """(n, spearman): the weighted correlation of the weighted mid-ranks, over rows with both values and a positive weight."""
    both = df.filter(_clear(F.col(a)) & _clear(F.col(b)) & (F.col(weight) > 0)).select(a, b, weight)
    ranked = keep.kept(weighted_ranks(weighted_ranks(both, a, weight, "__a"), b, weight, "__b").select(F.col(weight).alias("w"), "__a", "__b"))
    mean = {c: f"__m{c}" for c in ("__a", "__b")}
    centre = ranked.agg(*[(F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(m) for c, m in mean.items()])
    away = ranked.join(F.broadcast(centre), F.lit(True)).select("w", *[(F.col(c) - F.col(m)).alias(c) for c, m in mean.items()])
    s = lambda x, y: F.sum(F.col("w") * F.col(x) * F.col(y))
    return away.agg(F.count("*").alias("n"), F.try_divide(s("__a", "__b"), F.sqrt(s("__a", "__a") * s("__b", "__b"))).alias("spearman"))
