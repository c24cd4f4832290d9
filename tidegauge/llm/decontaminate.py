"""Benchmark decontamination with spaced seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Fixed masks over SPAN tokens; the positions not listed may differ.
SPAN = 11
MASKS = ((0, 1, 2, 4, 7, 9, 10), (0, 1, 3, 5, 6, 9, 10), (0, 2, 3, 4, 6, 8, 10))
#: A token: ASCII letters and digits and anything outside ASCII.
TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW, WINDOW_HITS, SHARE = 20, 16, 75


def _hashes(text) -> F.Column:
    """Hash of each token of the lower-cased text."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.transform(tokens, lambda t: F.xxhash64(t))


def _seed(pos, mask) -> F.Column:
    """The seed of a mask (its number) at a position of hs."""
    hashes = [F.xxhash64(*[F.get("hs", pos + o) for o in m]) for m in MASKS]
    return F.when(mask == 0, hashes[0]).when(mask == 1, hashes[1]).otherwise(hashes[2])


def _seeds(rows: DataFrame, *keep: str) -> DataFrame:
    """A row for each mask at each position: keep, pos, mask, seed. rows has the tokens' hashes, hs."""
    at = rows.select("*", F.posexplode("hs").alias("pos", "__x")).filter(F.col("pos") <= F.size("hs") - SPAN)
    seeds = [_seed(F.col("pos"), F.lit(m)) for m in range(len(MASKS))]
    return at.select(*keep, "pos", F.posexplode(F.array(*seeds)).alias("mask", "seed"))


def _before(pos: str) -> F.Column:
    """The same mask's seed one position earlier; null at the first position."""
    return F.when(F.col(pos) > 0, _seed(F.col(pos) - 1, F.col("mask")))


def _stretches(rows: DataFrame, seeds: DataFrame, narrow: bool) -> DataFrame:
    """(doc_id, version, item, start, near): each place where a seed puts an item, once, and the document's tokens there.

    A hit one position after another hit of the same mask and place is dropped inside the join, so tokens that come over
    and over don't give a row for each pair of positions. narrow: the seeds are broadcast and a hit takes its tokens
    along from the row that it is found in. Else seeds meet in a shuffle of numbers only, and the tokens come back by a
    join for the places that are left."""
    start = F.col("pos") - F.col("item_pos")  # of the item's first token in the document
    near = F.slice("hs", F.greatest("start", F.lit(0)) + 1, F.col("item_tokens"))
    place = ["doc_id", "version", "item", "start"]
    first = lambda before: F.coalesce(before != F.col("item_before"), F.lit(True))
    if narrow:
        hits = _seeds(rows, "doc_id", "version", "hs").join(F.broadcast(seeds), ["mask", "seed"]).filter(first(_before("pos")))
        return hits.withColumn("start", start).groupBy(*place).agg(F.first(near).alias("near"))
    hits = _seeds(rows, "doc_id", "version", "hs").withColumn("before", _before("pos")).drop("hs").join(seeds, ["mask", "seed"]).filter(first(F.col("before")))
    places = hits.select("doc_id", "version", "item", "item_tokens", start.alias("start")).distinct()
    named = places.withColumnsRenamed({"doc_id": "__id", "version": "__v"})
    return rows.join(named, (F.col("version") == F.col("__v")) & F.col("doc_id").eqNullSafe(F.col("__id"))).select(*place, near.alias("near"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_seeds: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, matched, item_tokens, aligned, start): documents that hold a benchmark item, maybe altered.

    Each of three masks hashes 7 of 11 successive tokens; equal hashes of benchmark and document align the item with
    the document. Each such place is verified once: the aligned tokens are compared one by one, and the item is held when
    75 % of all its tokens agree, or 16 of 20 successive ones (a part of a longer item). Of several places in a document
    the best is returned (most matches, then the earliest). Substituted tokens are tolerated as long as one of the masks
    sees none of them (nearly always from 30 tokens on); insertions split a match into parts.

    The benchmark's seeds and tokens are broadcast if the seeds are at most ``broadcast_seeds`` (counted); else both
    sides are shuffled by seed, as numbers. Items and documents under 11 tokens, null or empty texts can't match; a null
    item id is an id like others, repeated items match each by its id and text; repeated documents give one row; null
    document ids are returned as null (all rows without an id as one document; the pipeline names its rows by text)."""
    items = C.checkpointed(benchmark.select(F.col(item_col).alias("item_id"), _hashes(F.col(item_text_col)).alias("hs")).filter(F.size("hs") >= SPAN).distinct().withColumn("item", F.monotonically_increasing_id()))
    narrow = len(MASKS) * (items.agg(F.sum(F.size("hs"))).first()[0] or 0) <= broadcast_seeds
    seeds = _seeds(items.withColumn("item_tokens", F.size("hs")), "item", "item_tokens", "hs").withColumn("item_before", _before("pos")).drop("hs").withColumnRenamed("pos", "item_pos")
    rows = docs.select(F.col(id_col).alias("doc_id"), _hashes(F.col(text_col)).alias("hs")).withColumn("version", F.xxhash64("hs"))
    found = _stretches(rows, seeds, narrow)
    items = items.select("item", "item_id", F.col("hs").alias("item_hs"))
    near = found.join(F.broadcast(items) if narrow else items, "item").withColumn("skip", F.greatest(-F.col("start"), F.lit(0)))
    length = F.least(F.size("near"), F.size("item_hs") - F.col("skip"))
    equal = F.zip_with(F.slice("near", 1, length), F.slice("item_hs", F.col("skip") + 1, length), lambda a, b: F.when(a == b, 1).otherwise(0))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    near = near.withColumn("eq", equal)
    near = near.select("doc_id", "item_id", "start", F.size("item_hs").alias("item_tokens"), F.size("eq").alias("aligned"), total(F.col("eq")).alias("matched"), "eq")
    windows = F.transform(F.sequence(F.lit(1), F.size("eq") - WINDOW + 1), lambda i: total(F.slice("eq", i, WINDOW)))
    whole = 100 * F.col("matched") >= SHARE * F.col("item_tokens")
    part = (F.size("eq") >= WINDOW) & (F.col("matched") >= WINDOW_HITS) & F.exists(F.when(F.size("eq") >= WINDOW, windows).otherwise(F.array().cast("array<int>")), lambda n: n >= WINDOW_HITS)
    best = near.filter(whole | part).groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", (-F.col("start")).alias("before"), "aligned", "item_tokens")).alias("m"))
    return best.select("doc_id", "item_id", *[F.col(f"m.{c}").cast("long").alias(c) for c in ("matched", "item_tokens", "aligned")], (-F.col("m.before")).cast("long").alias("start"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _sql() -> str:
    token = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    keys = lambda a: "[" + ", ".join("[" + ", ".join(f"{a}[p + {o}]" for o in m) + f", '{i}']" for i, m in enumerate(MASKS)) + "]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '{token}') AS w FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all(lower(coalesce(text, '')), '{token}') AS v FROM benchmark),
ds AS (SELECT r, p, unnest({keys('w')}) AS k FROM (SELECT r, w, unnest(range(1, len(w) - {SPAN} + 2)) AS p FROM d)),
bs AS (SELECT item_id, v, p, unnest({keys('v')}) AS k FROM (SELECT item_id, v, unnest(range(1, len(v) - {SPAN} + 2)) AS p FROM b)),
h AS (SELECT DISTINCT ds.r, bs.item_id, bs.v, ds.p - bs.p AS s FROM ds JOIN bs ON ds.k = bs.k),
e AS (SELECT h.*, d.doc_id, d.w, unnest(range(greatest(0, -s) + 1, least(len(v), len(w) - s) + 1)) AS i FROM h JOIN d ON h.r = d.r),
q AS (SELECT r, doc_id, item_id, v, s, i, (w[i + s] = v[i])::INT AS eq FROM e),
x AS (SELECT *, sum(eq) OVER (PARTITION BY r, item_id, v, s ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS n,
  count(*) OVER (PARTITION BY r, item_id, v, s ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS c FROM q),
m AS (SELECT r, doc_id, item_id, s, len(v)::BIGINT AS item_tokens, count(*)::BIGINT AS aligned, sum(eq)::BIGINT AS matched,
  coalesce(max(n) FILTER (WHERE c = {WINDOW}), 0) AS best FROM x GROUP BY r, doc_id, item_id, v, s),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, s, aligned DESC, item_tokens DESC) AS o
  FROM m WHERE 100 * matched >= {SHARE} * item_tokens OR best >= {WINDOW_HITS})
SELECT doc_id, item_id, matched, item_tokens, aligned, s::BIGINT AS start FROM k WHERE o = 1
"""


SQL = _sql()
