"""The raw panel as a bucketed table: a stage over it needs no exchange by cell, and one cell reads one bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.panel import Config
from . import stage1 as S1

CELL = ("importer", "good")


def write_keyed(panel: DataFrame, name: str, buckets: int) -> DataFrame:
    """Writes a raw panel as table ``name``, in buckets of whole cells, sorted by cell. Rows are dealt by the bucket hash
    first, so that each bucket is one file."""
    panel.repartition(buckets, *CELL).write.bucketBy(buckets, *CELL).sortBy(*CELL).mode("overwrite").saveAsTable(name)
    return panel.sparkSession.table(name)


def _buckets(spark: SparkSession, name: str) -> int:
    for r in spark.sql(f"DESCRIBE FORMATTED {name}").collect():
        if r["col_name"] == "Num Buckets":
            return int(r["data_type"])
    raise ValueError(f"{name} is not bucketed")


def cell_rows(spark: SparkSession, name: str, importer: int, good: str) -> DataFrame:
    """The rows of one cell of a keyed panel. The cell's bucket follows from the hash that wrote it and is part of the
    names of its files, by which Spark leaves out all others; no row for a cell that the panel lacks."""
    table = spark.table(name)
    kind = table.schema["importer"].dataType
    bucket = spark.range(1).select(F.pmod(F.hash(F.lit(importer).cast(kind), F.lit(good)), F.lit(_buckets(spark, name)))).first()[0]
    mine = F.col("_metadata.file_name").contains(f"_{bucket:05d}.c")
    return table.filter(mine & (F.col("importer") == importer) & (F.col("good") == good))


def estimate_cell(spark: SparkSession, name: str, importer: int, good: str, cfg: Config | None = None) -> DataFrame:
    """Stage 1 of one cell of a keyed panel."""
    return S1.run_stage1(cell_rows(spark, name, importer, good), cfg or Config())
