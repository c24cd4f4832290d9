"""Stages that go on where they were stopped: fits are written by hash bucket of their cell, finished buckets are left out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import trade as T

CELL = ["importer", "good"]


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def by_buckets(inputs: DataFrame, fit: Callable[[DataFrame], DataFrame], path: str, keys: list[str] = CELL, buckets: int = 64, at_once: int = 16, anew: bool = False) -> DataFrame:
    """fit(inputs), made and written ``at_once`` buckets of cells at a time under ``path``, which names what the fits are made
    of. fit must work cell by cell and return the keys as they are.

    A round of buckets is one job that overwrites just their partitions, after which the round's buckets are noted in a
    table beside it. A run that was stopped, at any point, is repeated by the same call: noted buckets are left out by an
    anti join, and those written but not noted are overwritten, so no row is lost or doubled. ``anew`` forgets the notes.
    inputs are read once a round: give a kept table."""
    spark, notes = inputs.sparkSession, f"{path}-finished"
    kind = "bucket int"
    if anew or not T.stage_exists(spark, notes):
        spark.createDataFrame([], kind).write.mode("overwrite").parquet(notes)
    marked = inputs.withColumn("bucket", bucket_of(keys, buckets))
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    for first in range(0, buckets, at_once):
        due = every.filter(F.col("bucket").between(first, first + at_once - 1)).join(spark.read.schema(kind).parquet(notes), "bucket", "left_anti")
        due = [r["bucket"] for r in due.collect()]  # at most at_once numbers
        if not due:
            continue
        made = fit(marked.filter(F.col("bucket").isin(due)).drop("bucket")).withColumn("bucket", bucket_of(keys, buckets))
        made.write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
        spark.createDataFrame([(b,) for b in due], kind).write.mode("append").parquet(notes)
    shape = fit(inputs.limit(0)).schema
    return (spark.read.schema(shape).parquet(path) if T.stage_exists(spark, path) else spark.createDataFrame([], shape)).select(shape.names)
