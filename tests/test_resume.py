"""A stage that is stopped goes on after its finished buckets, and gives the same rows."""

import os

import pytest
from pyspark.sql import functions as F

from tidegauge.plans.resume import bucket_of, by_buckets


def files(path):
    return {f: os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_stopped_stage_goes_on(spark, tmp_path):
    inputs = spark.range(5000).select((F.col("id") % 37).cast("int").alias("importer"), (F.col("id") % 11).cast("string").alias("good"), "id")
    calls = []

    def fit(rows, stop_at=None):
        calls.append(1)
        if stop_at is not None and len(calls) > stop_at:
            raise RuntimeError("stopped")
        return rows.groupBy("importer", "good").agg(F.sum("id").alias("s"), F.count("*").alias("n"))

    want = sorted(map(tuple, fit(inputs).collect()))
    path = str(tmp_path / "fits")
    calls.clear()
    with pytest.raises(RuntimeError):
        by_buckets(inputs, lambda r: fit(r, 2), path, buckets=12, at_once=3)
    before = files(path)
    assert len(calls) == 3 and before
    spark.range(1).select(F.lit(1).alias("importer"), F.lit("x").alias("good"), F.lit(0).alias("s"), F.lit(0).alias("n"), F.lit(7).alias("bucket")).write.partitionBy("bucket").mode("append").parquet(path)  # half a round that was written but not noted
    calls.clear()
    got = by_buckets(inputs, fit, path, buckets=12, at_once=3)
    assert sorted(map(tuple, got.collect())) == want
    assert len(calls) == 3  # two rounds that were left, and one for the schema
    after = files(path)
    assert all(after[f] == t for f, t in before.items())  # finished buckets were not touched
    calls.clear()
    assert by_buckets(inputs, fit, path, buckets=12, at_once=3).count() == len(want) and len(calls) == 1
    more = inputs.union(inputs)
    assert sum(r.n for r in by_buckets(more, fit, path, buckets=12, at_once=3, anew=True).collect()) == 10_000
    assert by_buckets(inputs.limit(0), fit, str(tmp_path / "none"), buckets=3).count() == 0
    assert inputs.select(bucket_of(["importer", "good"], 12)).distinct().count() == 12
