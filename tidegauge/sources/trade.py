"""Readers and writers of trade tables."""

from __future__ import annotations

import os
import re
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a yearly trade file: year, exporter, importer, six-digit product, value, quantity. Products stay text.
TRADE_SCHEMA = "t int, i int, j int, k string, v double, q double"
YEARLY = "BACI_HS*_Y*_V*.csv"
RENAMES = {"t": "year", "i": "exporter", "j": "importer", "k": "good", "v": "cusval", "q": "quantity"}
KEYS = ["good", "importer", "exporter"]


def read_trade(spark: SparkSession, path: str, yearly: str = YEARLY) -> DataFrame:
    """A folder of yearly CSV files (else of any CSV files, with a warning), one CSV, Parquet, or a Stata file.

    Files are listed and opened by Spark, so any store it reads will do. A name with an unknown ending that holds no CSV
    file is refused."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind == ".csv":
        return spark.read.schema(TRADE_SCHEMA).option("header", True).csv(path)
    if kind == ".parquet":
        return spark.read.parquet(path)
    if kind == ".dta":
        return read_stata(spark, path)
    for pattern in (yearly, "*.csv"):
        if _holds_files(spark, path, pattern):
            if pattern != yearly:
                warnings.warn(f"no file in {path} is named {yearly}; reading all CSV files", stacklevel=2)
            return spark.read.schema(TRADE_SCHEMA).option("header", True).option("pathGlobFilter", pattern).csv(path)
    if kind:  # not a folder with a dot in its name
        raise ValueError(f"unsupported trade file: {path}")
    raise FileNotFoundError(f"no CSV file in {path}")


def _missing(e: Exception) -> bool:
    """Whether Spark says that a path is not there (it has no exception class of its own for that)."""
    return "PATH_NOT_FOUND" in str(e)


def _holds_files(spark: SparkSession, path: str, pattern: str) -> bool:
    try:
        return not spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path").isEmpty()
    except Exception as e:
        if _missing(e):
            return False
        raise


def files_fingerprint(df: DataFrame) -> tuple[int, int]:
    """(hash, number) of the files that a table reads: their paths, lengths and modification times. No file is opened."""
    paths = df.inputFiles()
    if not paths:
        return (0, 0)
    listed = df.sparkSession.read.format("binaryFile").load(paths).select("path", "length", "modificationTime").distinct()
    return tuple(listed.agg(F.coalesce(F.bit_xor(F.xxhash64("path", "length", "modificationTime")), F.lit(0)), F.count("*")).first())


def read_stata(spark: SparkSession, path: str) -> DataFrame:
    """One or more Stata files of one layout, each read inside a task in chunks; text stays text, numbers become double."""
    import io

    import pandas as pd

    files = spark.read.format("binaryFile").load(path).select("content")

    def layout(batches):
        for pdf in batches:
            for content in pdf["content"]:
                with pd.read_stata(io.BytesIO(content), chunksize=1) as chunks:
                    head = next(chunks)
                yield pd.DataFrame({"at": range(len(head.columns)), "name": head.columns, "number": [pd.api.types.is_numeric_dtype(t) for t in head.dtypes]})

    columns = [(r["name"], r["number"]) for r in files.limit(1).mapInPandas(layout, "at int, name string, number boolean").orderBy("at").collect()]

    def rows(batches):
        for pdf in batches:
            for content in pdf["content"]:
                with pd.read_stata(io.BytesIO(content), chunksize=100_000) as chunks:
                    for chunk in chunks:
                        yield chunk.astype({n: "float64" if number else str for n, number in columns})

    return files.mapInPandas(rows, ", ".join(f"`{n}` {'double' if number else 'string'}" for n, number in columns))


def rename(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Canonical names; absent columns are skipped."""
    return df.withColumnsRenamed({a: b for a, b in (names or RENAMES).items() if a in df.columns})


#: Names that published tables give to the columns of trade.
CANDIDATES = {
    "year": ("year", "t", "yr"), "good": ("hs", "hs6", "k", "product"), "importer": ("importer", "iiso", "i", "i_iso"), "exporter": ("exporter", "eiso", "j", "j_iso"),
    "cusval": ("value", "v", "value_kUSD"), "quantity": ("quantity", "q", "qty"),
}


def identify(df: DataFrame) -> DataFrame:
    """The canonical columns of a table that names them in one of the usual ways; a missing one is an error."""
    missing = [n for n, names in CANDIDATES.items() if not set(names) & set(df.columns)]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)} among {', '.join(df.columns)}")
    return df.select(*[F.col(first_of(df, *names)).alias(n) for n, names in CANDIDATES.items()])


def first_of(df: DataFrame, *candidates: str) -> str:
    """The first of the names that the table has."""
    return next(c for c in candidates if c in df.columns)


def from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's order tables seen as yearly trade files: supplier nation exports to customer nation.

    The six part types are headings 0101 to 0106, the part's size makes six digits; the leading zero is dropped, as
    files that keep codes as numbers do."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    kinds = F.array(*[F.lit(x) for x in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")])
    return (
        t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
        .filter("c_nationkey <> s_nationkey")
        .select(
            F.year("l_shipdate").alias("t"), F.col("s_nationkey").cast("int").alias("i"), F.col("c_nationkey").cast("int").alias("j"),
            F.concat(F.lit("10"), F.array_position(kinds, F.col("p_type")).cast("string"), F.lpad(F.col("p_size").cast("string"), 2, "0")).alias("k"),
            F.col("l_extendedprice").alias("v"), F.col("l_quantity").cast("double").alias("q"),
        )
    )


def region_map(spark: SparkSession, path: str | None = None, rows: list[tuple[int, str]] | None = None) -> DataFrame:
    """(cty_code, region): a dimension table from a CSV with these columns, or from rows; the first of repeats counts."""
    if path:
        df = spark.read.schema("cty_code int, region string").option("header", True).csv(path)
        placed = df.withColumn("__at", F.monotonically_increasing_id())  # in the order of the file's lines
        return placed.groupBy("cty_code").agg(F.min_by("region", "__at").alias("region"))
    seen: dict[int, str] = {}
    for code, region in rows or []:
        seen.setdefault(code, region)
    return spark.createDataFrame(list(seen.items()), "cty_code int, region string")


def canonical_order(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sorted by good, importer, exporter, as far as they are there."""
    present = [c for c in (keys or KEYS) if c in df.columns]
    return df.orderBy(*present) if present else df


def write_stage(df: DataFrame, path: str) -> DataFrame:
    """Writes a stage's table and reads it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def stage_exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished stage table is there, in whatever store Spark reads."""
    try:
        return bool(spark.read.parquet(path).columns)
    except Exception as e:
        if _missing(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return False
        raise


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, nulls kept, doubles in full precision."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def trade_source(path: str) -> str:
    """Name of the data set in a path, such as HS92_V202601; baci if there is none."""
    found = re.search(r"(HS\d{2})[_-]?(V\d{6}\w?)", path)
    return f"{found[1]}_{found[2]}" if found else "baci"


def output_prefix(path: str, level: str, scope: str) -> str:
    return f"{trade_source(path)}_{level}_{scope}"


def manifest_drift(listed: DataFrame, present: DataFrame, key: str = "local_path") -> DataFrame:
    """(key, problem): files of a manifest that are missing, and files that no manifest lists."""
    missing = listed.join(present, key, "left_anti").select(key, F.lit("missing").alias("problem"))
    return missing.unionByName(present.join(listed, key, "left_anti").select(key, F.lit("unlisted").alias("problem")))


def verify_manifest(listed: DataFrame, present: DataFrame) -> DataFrame:
    """(local_path, problem): files that are missing, unlisted, of another size or of another hash than the manifest says,
    or listed without a real hash (empty or PLACEHOLDER). listed and present have local_path, sha256, size_bytes."""
    tidy = lambda c: F.lower(F.trim(c))
    a = listed.select("local_path", tidy(F.col("sha256")).alias("want"), F.col("size_bytes").cast("long").alias("want_size"), F.lit(True).alias("listed"))
    b = present.select("local_path", tidy(F.col("sha256")).alias("have"), F.col("size_bytes").cast("long").alias("have_size"), F.lit(True).alias("present"))
    problem = (
        F.when(F.col("present").isNull(), "missing").when(F.col("listed").isNull(), "unlisted").when(F.coalesce("want", F.lit("")).isin("", "placeholder"), "no_checksum")
        .when(F.col("want_size") != F.col("have_size"), "size").when(F.col("want") != F.col("have"), "checksum")
    )
    return a.join(b, "local_path", "full_outer").select("local_path", problem.alias("problem")).filter("problem is not null")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, size_bytes) of every file under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))
