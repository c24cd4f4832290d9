"""Tables kept in the shared folder, and exact quantiles of whole columns without a single task."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def width(spark: SparkSession) -> int:
    """Partitions for work that is heavy on the processor but small in bytes, which adaptive execution would merge."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def kept(df: DataFrame) -> DataFrame:
    """Rows checkpointed in the cluster's shared folder (spark.checkpoint.dir), computed once however often they are read.
    Only a local master without the setting gets a folder of its own."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def ranked(df: DataFrame, col: str) -> tuple[DataFrame, int]:
    """(rows whose ``col`` is not null plus ``__rank`` from 0 in its order, their number): range partitions are sorted, and
    each adds up what the partitions before it hold, one number per partition."""
    rows = df.filter(F.col(col).isNotNull() & ~F.isnan(col))
    dealt = kept(rows.repartitionByRange(width(df.sparkSession), col).sortWithinPartitions(col).withColumn("__at", F.monotonically_increasing_id()))
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["p"]: r["n"] for r in dealt.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    if not total:
        return dealt.withColumn("__rank", F.lit(0).cast("long")).drop("__at"), 0
    offsets = F.create_map(*[F.lit(x).cast("long") for pair in before.items() for x in pair])
    return dealt.withColumn("__rank", offsets[part] + place).drop("__at"), total


def quantiles(df: DataFrame, col: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles of a column, interpolated between neighbours; nulls are left out, and none are left of an empty one."""
    rows, n = ranked(df.select(col), col)
    if not n:
        return [None] * len(shares)
    at = [(n - 1) * p for p in shares]
    wanted = sorted({x for h in at for x in (math.floor(h), math.ceil(h))})
    found = {r["__rank"]: r[col] for r in rows.filter(F.col("__rank").isin(wanted)).collect()}
    return [float(found[math.floor(h)] + (h - math.floor(h)) * (found[math.ceil(h)] - found[math.floor(h)])) for h in at]


def average_ranks(df: DataFrame, col: str, out: str) -> DataFrame:
    """Ranks from 1, the mean of their places for ties; one row per input row with a value."""
    rows, _ = ranked(df, col)
    rows = kept(rows)
    ties = rows.groupBy(F.col(col).alias("__v")).agg((F.avg("__rank") + 1).alias(out))
    return rows.join(ties, F.col(col) == F.col("__v")).drop("__v", "__rank")
