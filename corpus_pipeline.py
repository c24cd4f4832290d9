"""Corpus pipeline over documents: quality rules, line dedup, near-dedup, benchmark decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and works on all documents that the stages before it kept; all but the last
return the columns of documents. Nulls, empty texts and empty tables follow the operators' own rules. Rows that share a
doc_id, or have none, are told apart by their texts in the quality, near-dedup and decontamination stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import decontaminate, line_dedup, mixing, near_dedup, quality_rules
from tidegauge.llm import common as C

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(df: DataFrame, text) -> DataFrame:
    return df.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def _version() -> Column:
    """Tells rows apart that share an id: a hash of the text."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject, by themselves or by their host, go. Verdicts are computed per row and
    joined back by id and text hash."""
    version = _version()
    marked = quality_rules.judge(docs.withColumn("doc_id", F.struct("doc_id", version.alias("v")))).filter("not kept").select(F.col("doc_id.doc_id").alias("__id"), F.col("doc_id.v").alias("__v")).distinct()
    joined = docs.withColumn("__v2", version)
    gone = joined["doc_id"].eqNullSafe(marked["__id"]) & (joined["__v2"] == marked["__v"])
    return joined.join(marked.hint("shuffle_hash"), gone, "left_anti").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in several documents stay only in the first; documents that have nothing left go."""
    done = line_dedup.dedup_lines(docs)
    left = F.regexp_like("kept_text", F.lit(C.WORD))
    return _with_text(done.filter((F.col("n_dropped") == 0) | left), F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(F.col("kept_text")))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the one with the smallest id (null first). Rows are documents
    of their own by id and text, so a shared or null id links no texts; of rows equal in both one stays."""
    nodes = docs.withColumn("__node", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit(""))))
    classes = C.checkpointed(near_dedup.near_duplicates(nodes.select("__node", "text"), "__node"))
    ids = nodes.select("__node", "doc_id").distinct().join(classes.select(F.col("doc_id").alias("__node"), "class_id").distinct().hint("shuffle_hash"), "__node")
    stay = ids.groupBy("class_id").agg(F.min(F.struct("doc_id", "__node")).alias("least")).select(F.col("least.__node").alias("__node"))
    kept = nodes.join(C.checkpointed(stay).hint("shuffle_hash"), "__node", "left_semi")
    repeated = not classes.groupBy("doc_id").count().filter("count > 1").isEmpty()
    return (kept.dropDuplicates(["__node"]) if repeated else kept).select(*COLUMNS)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; rows that share an id are judged by their own texts."""
    leaks = decontaminate.find_leaks(docs.withColumn("doc_id", F.struct("doc_id", _version().alias("v"))), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    marked = leaks.select(F.col("doc_id.doc_id").alias("__id"), F.col("doc_id.v").alias("__v")).distinct()
    joined = docs.withColumn("__v2", _version())
    gone = joined["doc_id"].eqNullSafe(marked["__id"]) & (joined["__v2"] == marked["__v"])
    return joined.join(marked.hint("shuffle_hash"), gone, "left_anti").select(*COLUMNS)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken", "shard", "quota")


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontaminate", leak_stage),
    ("mix_sources", mix_stage),
]

#: Weighted sampling and verified components can't be said in SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; between stages a Parquet table in the shared folder cuts the lineage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = C.kept_table(docs)
    return docs
