"""Line dedup: keep each repeated line only in the first document that holds it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common as C

_LAST = (1 << 63) - 1


def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc, version, pos, h1, h2): a row for each line whose key is long enough; 128 bits of hash stand for the key."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        docs.select(F.coalesce(F.col(id_col), F.lit(_LAST)).alias("doc"), F.xxhash64(text).alias("version"), C.ascii_lower(text).alias("low"))
        .select("doc", "version", F.posexplode(F.split("low", "\n")).alias("pos", "line"))
        .select("doc", "version", "pos", F.trim("line", F.lit(C.SPACE)).alias("key"))
        .filter(F.length("key") >= min_chars)
        .select("doc", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )


def _hot_keys(lines: DataFrame, share: int = 2000, least: int = 20) -> DataFrame:
    """Keys common enough to fill a partition alone: at most ``share`` of them, from the lines of one document in 64.

    The sample only decides which way a key is resolved (here or in the range exchange); both ways are exact, so it
    never changes a result."""
    sample = C.checkpointed(lines.filter(F.pmod(F.xxhash64("doc"), F.lit(64)) == 0).groupBy("h1", "h2").agg(F.count("*").alias("n")).filter(F.col("n") >= least))
    total = sample.agg(F.sum("n")).first()[0] or 0
    return sample.filter(F.col("n") >= max(least, total / share)).select("h1", "h2")


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(doc, version, dropped): for each document that loses lines, the run-length compressed bitmap of dropped lines.

    A line's key is the line stripped of ASCII white space at both ends, A-Z lower-cased. Keys of at least
    ``min_chars`` code points found in two or more documents stay only in the smallest id that holds them (with all
    their repeats there). ``dropped`` is a list of (start, stop) runs of line numbers from 0, stop exclusive; ``version``
    is the hash of the text, so that several rows with one id and different texts keep bitmaps of their own.

    Plan: line hashes are written once to the shared folder, range-partitioned by hash and sorted by document and
    position inside a partition; a window streams over each key and compares every line with the key's first document. No text enters that exchange. Keys
    hot enough to outgrow a partition are found beforehand and resolved by a map-side-combined minimum instead.

    Null ids count as one document after all others, null texts as one empty line; an empty table gives no rows."""
    lines = C.kept_table(_lines(docs, id_col, text_col, min_chars))
    hot = C.checkpointed(
        lines.join(F.broadcast(_hot_keys(lines)), ["h1", "h2"]).groupBy("h1", "h2").agg(F.min("doc").alias("first"))
    )  # at most 2000 rows, see _hot_keys
    marked = lines.join(F.broadcast(hot), ["h1", "h2"], "left")
    key = W.partitionBy("h1", "h2").orderBy("doc", "pos")
    streamed = (
        lines.join(F.broadcast(hot), ["h1", "h2"], "left_anti")
        .repartitionByRange(C.shuffle_width(docs.sparkSession), "h1", "h2")
        .sortWithinPartitions("h1", "h2", "doc", "pos")
        .withColumn("first", F.first("doc").over(key))
    )
    later = marked.filter(F.col("doc") > F.col("first")).select("doc", "version", "pos").unionByName(
        streamed.filter(F.col("doc") > F.col("first")).select("doc", "version", "pos")
    )
    at = F.col("at")
    runs = later.groupBy("doc", "version").agg(F.sort_array(F.collect_set("pos")).alias("at")).select(
        "doc",
        "version",
        F.size("at").cast("long").alias("n_dropped"),
        F.filter(at, lambda p, i: (i == 0) | (F.try_element_at(at, i) != p - 1)).alias("starts"),
        F.filter(at, lambda p, i: (i == F.size(at) - 1) | (F.try_element_at(at, i + 2) != p + 1)).alias("ends"),
    )
    return runs.select("doc", "version", "n_dropped", F.zip_with("starts", "ends", lambda a, b: F.struct(a.alias("start"), (b + 1).alias("stop"))).alias("dropped"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with ``kept_text``, ``n_lines`` and ``n_dropped``, which replace columns of these names; others stay."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumns({"__doc": F.coalesce(F.col(id_col), F.lit(_LAST)), "__version": F.xxhash64(text)})
    marks = bitmaps.select(F.col("doc").alias("__doc"), F.col("version").alias("__version"), F.col("n_dropped").alias("__n"), F.col("dropped").alias("__runs"))
    joined = keyed.join(marks.hint("shuffle_hash"), ["__doc", "__version"], "left").withColumn("__lines", F.split(text, "\n"))
    gone = F.flatten(F.transform("__runs", lambda r: F.sequence(r["start"], r["stop"] - 1)))
    rest = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), gone)
    kept = F.when(F.col("__runs").isNull(), text).otherwise(F.array_join(F.transform(rest, lambda i: F.get(F.col("__lines"), i)), "\n"))
    return joined.withColumns({"n_lines": F.size("__lines").cast("long"), "n_dropped": F.coalesce("__n", F.lit(0).cast("long")), "kept_text": kept}).drop("__doc", "__version", "__n", "__runs", "__lines")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """docs without their repeated lines, see keep_bitmaps; adds kept_text, n_lines, n_dropped."""
    return apply_bitmaps(docs, keep_bitmaps(docs, id_col, text_col, min_chars), id_col, text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir).select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = f"""
WITH s AS (SELECT doc_id AS id, coalesce(doc_id, 9223372036854775807) AS doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, hash(coalesce(text, '')) AS v FROM documents),
l AS (SELECT DISTINCT doc_id, v, pos, ls[pos] AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS pos FROM s)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{C.UPPER}', '{C.LOWER}') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.v, k.pos, k.line, (f.first IS NOT NULL AND k.doc_id > f.first) AS gone FROM k LEFT JOIN f USING (key)),
d AS (SELECT doc_id, v, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id, v)
SELECT s.id AS doc_id, d.n_lines, d.n_dropped, d.kept_sha256 FROM s JOIN d ON s.doc_id = d.doc_id AND s.v = d.v
"""
