"""Shared pieces: words, lines, shared-folder checkpoints, blocks of documents."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Words of a text as an array; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is (``lower`` would fold all of Unicode)."""
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster names its shared folder in spark.checkpoint.dir. Where that is unset, a local master (tests) gets a
    folder of its own; on a cluster, whose executors would each write to their own disks, it is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries planned and run inside go as soon as each ends, not when the driver happens to collect
    garbage: rows that were kept in the shared folder need them no more."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Rows kept in the shared folder: later readers neither recompute them nor need the executors that made them."""
    ensure_checkpoint_dir(df.sparkSession)
    with released(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # planned anew, as a plan made before would keep its shuffles


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts (one number)."""
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def block_count(docs: DataFrame, text_col: str = "text", block_bytes: int = 8 << 20) -> int:
    """Blocks of about block_bytes of text, so that one block fits a task at any size of the corpus."""
    return max(shuffle_width(docs.sparkSession), -(-text_bytes(docs, text_col) // block_bytes))


def bucket_count(docs: DataFrame, text_col: str = "text", bucket_bytes: int = 16 << 20) -> int:
    """Buckets of keys that grow with the corpus, so that what one bucket holds does not."""
    return max(shuffle_width(docs.sparkSession), -(-text_bytes(docs, text_col) // bucket_bytes))


def numbered(docs: DataFrame, id_col: str, text_col: str, null_id: int) -> tuple[DataFrame, DataFrame | None]:
    """((node, text), ids): a node for each document. While ids are unique, a node is an id (null: ``null_id``) and ids
    is None. Else rows that share an id are documents of their own by text (rows equal in both are one): nodes are numbers
    in the order of id and a hash of the text, and ids has (id, v, node), v being xxhash64 of the text."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(null_id)).alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if rows.groupBy("node").count().filter("count > 1").isEmpty():
        return rows, None
    known = rows.select(F.col("node").alias("id"), F.xxhash64("text").alias("v"), "text")
    ids = checkpointed(known.select("id", "v").distinct().sort("id", "v").withColumn("node", F.monotonically_increasing_id()))
    return kept_table(known.join(ids, ["id", "v"]).groupBy("node").agg(F.first("text").alias("text"))), ids


def kept_table(df: DataFrame) -> DataFrame:
    """Like checkpointed, for wide rows: a Parquet table in the shared folder, so that later readers prune columns."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    with released(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
