"""Mixing sources to target weights with Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common as C


def water_fill(sources: DataFrame, total: int, repeats: int) -> DataFrame:
    """Targets by ``weight`` that stop at ``repeats`` times ``source_size``; the excess goes to the others by weight.

    Sorted by cap / weight, a source is capped when its share of what the earlier caps leave is above its own cap.
    One row per source; the single-partition window sorts the source table, never documents."""
    order = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    onward = order.rowsBetween(0, W.unboundedFollowing)
    filled = sources.withColumn("cap", F.col("source_size") * repeats).withColumns(
        {"left": F.lit(total) - F.coalesce(F.sum("cap").over(before), F.lit(0)), "open": F.sum("weight").over(onward)}
    ).withColumn("capped", F.col("left") * F.col("weight") > F.col("cap") * F.col("open"))
    everyone = W.partitionBy()
    rest = F.lit(total) - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everyone), F.lit(0))
    weights = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everyone)
    share = (F.col("weight") * rest).cast("double") / weights
    return filled.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share)).drop("cap", "left", "open", "capped")


def sainte_lague(df: DataFrame, group: list[str], weight: str, seats: Column, order: list[str], out: str) -> DataFrame:
    """Adds ``out``: seats of each row when the group's seats go one by one to the highest quotient weight / (2k + 1).

    All quotients from the threshold of the mean price on are granted at once (rounding weight / price); then the few
    seats missing go to the next highest quotients, or those too many are taken from the lowest. Of n rows with a weight
    these are at most n / 2, and the price that settles them moves a row's seats by at most n w / 2 W + 1, so a row offers
    no more quotients than that and all rows together at most 3 n. Ties: ``order``. Weightless groups get no seats; rows
    must be unique on group + order."""
    all_of = W.partitionBy(*group)
    w = F.col(weight).cast("double")
    start = df.withColumn("__seats", seats.cast("long")).withColumn("__w", F.sum(w).over(all_of)).withColumn(
        "__base", F.when(F.col("__w") > 0, F.floor(w * F.col("__seats") / F.nullif("__w", F.lit(0.0)) + 0.5)).otherwise(0).cast("long")
    ).withColumn("__diff", F.when(F.col("__w") > 0, F.col("__seats") - F.sum("__base").over(all_of)).otherwise(0).cast("long"))
    rows = F.count_if(w > 0).over(all_of)
    start = start.withColumn("__most", F.least(F.abs("__diff"), F.ceil(rows * w / F.nullif(2 * F.col("__w"), F.lit(0.0))).cast("long") + 2))
    more, fewer = F.col("__diff") > 0, F.col("__diff") < 0
    ks = F.when(more, F.sequence(F.col("__base"), F.col("__base") + F.col("__most") - 1)).when(
        fewer & (F.col("__base") > 0), F.sequence(F.greatest(F.col("__base") - F.col("__most"), F.lit(0)), F.col("__base") - 1)
    )
    quotient = w / (2 * F.col("__k") + 1)
    keys = [*group, *order]
    moved = start.select(*keys, weight, "__diff", F.explode(ks).alias("__k")).withColumn("__q", quotient)
    best = W.partitionBy(*group).orderBy(F.col("__q").desc(), *order, "__k")
    worst = W.partitionBy(*group).orderBy(F.col("__q"), *[F.col(c).desc() for c in order], F.col("__k").desc())
    moved = moved.withColumn("__r", F.when(more, F.row_number().over(best)).otherwise(F.row_number().over(worst))).filter(F.col("__r") <= F.abs("__diff")).groupBy(*keys).agg(F.sum(F.signum("__diff")).cast("long").alias("__move"))
    return start.join(moved, keys, "left").withColumn(out, F.col("__base") + F.coalesce("__move", F.lit(0))).drop("__seats", "__w", "__base", "__diff", "__most", "__move")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = 64,
    repeats: int = 3, shard_words: int = 500_000, seed: str = "mix-1",
) -> DataFrame:
    """(id, source, size, source_size, target, taken, shard, quota): how many words of each document the mix takes.

    Size counts words (runs without ASCII white space; null texts: 0). Sources sorted by code point, null last, weigh
    1, 2, 3, 1, ...; together they get as many words as there are, each at most ``repeats`` times its size
    (water_fill). Blocks of ``block_words`` go to sources by Sainte-Lague on the targets, then to each source's shards
    by Sainte-Lague on the shard sizes. A shard's documents, in the order of a seeded hash, form a stream of blocks that
    is taken from its start, once around after the other, until the shard's quota is full; so no document is taken
    more than ``repeats`` times, and reruns agree. A source has a shard per ``shard_words`` of its own words, so a hot source
    is spread over many tasks and a small one is not cut to pieces; words of a quota beyond what its shard can give go to
    the source's shards that have room, in their order. Null ids (drawn by their texts) and repeated rows are documents of their own; an empty table gives
    no rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = C.checkpointed(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(C.WORD)).cast("long").alias("size"),
        F.when(F.col(source_col).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source_col))).alias("skey"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.md5(text)))).alias("draw"),
    ))
    total = sized.agg(F.sum("size")).first()[0] or 0
    many = C.kept_table(sized.groupBy("skey").agg(F.greatest(F.lit(1), F.ceil(F.sum("size") / shard_words)).alias("shards")))
    sized = sized.join(many, "skey").withColumn("shard", F.conv(F.substring("draw", 1, 8), 16, 10).cast("long") % F.col("shards"))
    cells = C.checkpointed(sized.groupBy("skey", "shard").agg(F.first("source").alias("source"), F.sum("size").alias("shard_size")))
    sources = cells.groupBy("skey").agg(F.first("source").alias("source"), F.sum("shard_size").alias("source_size"))
    sources = sources.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", (F.col("rank") - 1) % 3 + 1)
    targets = water_fill(sources, total, repeats).withColumn("all", F.lit(0))
    targets = sainte_lague(targets, ["all"], "target", F.lit((2 * total + block_words) // (2 * block_words)), ["rank"], "blocks")
    targets = C.checkpointed(targets.select("skey", "source_size", "target", "blocks"))
    quotas = sainte_lague(cells.drop("source").join(targets, "skey"), ["skey"], "shard_size", F.col("blocks"), ["shard"], "quota").withColumn("wanted", F.col("quota") * block_words)
    room = repeats * F.col("shard_size") - F.col("wanted")
    over, spare = F.greatest(-room, F.lit(0)), F.greatest(room, F.lit(0))
    whole = W.partitionBy("skey")
    ahead = F.coalesce(F.sum(spare).over(whole.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    quotas = quotas.withColumn("wanted", F.col("wanted") - over + F.greatest(F.lit(0), F.least(spare, F.sum(over).over(whole) - ahead)))
    quotas = quotas.withColumn("rounds", F.when(F.col("shard_size") > 0, F.least(F.floor(F.col("wanted") / F.nullif("shard_size", F.lit(0))), F.lit(repeats))).otherwise(0).cast("long"))
    quotas = quotas.withColumn("rest", F.when(F.col("rounds") >= repeats, 0).otherwise(F.col("wanted") - F.col("rounds") * F.col("shard_size")).cast("long"))
    stream = W.partitionBy("skey", "shard").orderBy("draw", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(W.unboundedPreceding, -1)
    placed = sized.withColumn("at", F.coalesce(F.sum("size").over(stream), F.lit(0))).join(quotas.select("skey", "shard", "source_size", "target", "quota", "rounds", "rest"), ["skey", "shard"])
    taken = F.col("rounds") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("at")))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "shard", "quota")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(C.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "shard", "quota")


def sql(docs: str = "documents", block: int = 64, repeats: int = 3, shard_words: int = 500_000, seed: str = "mix-1") -> str:
    return f"""
WITH RECURSIVE z AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0b\\f\\r]+'))::BIGINT AS size,
  md5('{seed}:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS draw FROM {docs}),
tot AS (SELECT coalesce(sum(size), 0)::BIGINT AS t FROM z),
ds AS (SELECT z.*, coalesce('s' || source, 'n') AS skey, greatest(1, ceil(sum(size) OVER (PARTITION BY source) / {shard_words}.0))::BIGINT AS shards FROM z),
d AS (SELECT *, (('0x' || substr(draw, 1, 8))::BIGINT) % shards AS shard FROM ds),
s0 AS (SELECT skey, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM d GROUP BY skey),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s0),
s2 AS (SELECT *, (rank - 1) % 3 + 1 AS weight, {repeats} * source_size AS cap FROM s1),
fill AS (
  SELECT 0 AS step, rank, weight, cap, false AS capped FROM s2
  UNION ALL
  SELECT step + 1, rank, weight, cap,
    capped OR ((SELECT t FROM tot) - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) * weight > cap * sum(CASE WHEN capped THEN 0 ELSE weight END) OVER ()
  FROM fill WHERE step < 200),
done AS (SELECT * FROM fill WHERE step = 200),
tg AS (SELECT s2.*, CASE WHEN done.capped THEN done.cap::DOUBLE
  ELSE (done.weight * ((SELECT t FROM tot) - (SELECT coalesce(sum(cap), 0) FROM done WHERE capped)))::BIGINT::DOUBLE / (SELECT sum(weight) FROM done WHERE NOT capped)::BIGINT::DOUBLE END AS target
  FROM s2 JOIN done USING (rank)),
n AS (SELECT (2 * t + {block}) // (2 * {block}) AS seats FROM tot),
q AS (SELECT rank, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, rank, k) AS r FROM tg, range((SELECT seats FROM n) + 1) AS g(k) WHERE target > 0),
b AS (SELECT tg.*, (SELECT count(*) FROM q WHERE q.rank = tg.rank AND q.r <= (SELECT seats FROM n)) AS blocks FROM tg),
c AS (SELECT skey, shard, sum(size)::BIGINT AS shard_size FROM d GROUP BY skey, shard),
cb AS (SELECT c.*, b.source_size, b.target, b.blocks FROM c JOIN b USING (skey)),
cq AS (SELECT skey, shard, row_number() OVER (PARTITION BY skey ORDER BY shard_size::DOUBLE / (2 * k + 1) DESC, shard, k) AS r, blocks
  FROM (SELECT *, unnest(range(blocks + 1)) AS k FROM cb WHERE shard_size > 0)),
u AS (SELECT cb.*, (SELECT count(*) FROM cq WHERE cq.skey = cb.skey AND cq.shard = cb.shard AND cq.r <= cq.blocks) AS quota FROM cb),
o AS (SELECT *, greatest(0, quota * {block} - {repeats} * shard_size) AS over, greatest(0, {repeats} * shard_size - quota * {block}) AS spare FROM u),
x AS (SELECT *, quota * {block} - over + greatest(0, least(spare, sum(over) OVER (PARTITION BY skey)
  - coalesce(sum(spare) OVER (PARTITION BY skey ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS wanted FROM o),
v AS (SELECT *, CASE WHEN shard_size > 0 THEN least(wanted // shard_size, {repeats}) ELSE 0 END AS rounds FROM x),
p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY skey, shard ORDER BY draw, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM d)
SELECT p.doc_id, p.size, v.source_size, v.target,
  (v.rounds * p.size + greatest(0, least(p.size, CASE WHEN v.rounds >= {repeats} THEN 0 ELSE v.wanted - v.rounds * v.shard_size END - p.at)))::BIGINT AS taken,
  p.shard, v.quota::BIGINT AS quota
FROM p JOIN v USING (skey, shard)
"""


SQL = sql()
