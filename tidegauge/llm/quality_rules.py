"""Quality rules: per-document rules, and host-level verdicts from shrunk failure rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

_SYMBOLS = "#*$%&|<>"
_FEW = 24


def _covered(starts):
    """Words inside 3-word windows that begin at these sorted positions."""
    gaps = F.zip_with(starts, F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    return F.aggregate(gaps, F.lit(0), lambda s, g: s + g)


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long); a null text has none of each.

    n_repeat_words counts the words in 3-word windows that occur at least twice in the text. Windows are compared by
    64-bit hashes of the word hashes. Everything is computed inside the row: no shuffle, no Python. Texts whose windows
    are all distinct stop there; few repeated hashes are looked up directly, many by sorting (hash, position)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    flat = F.translate(text, C.SPACE, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, C.SPACE, "")) > 0)
    first = docs.withColumns({
        "__h": F.transform(C.words(F.col(text_col)), lambda w: F.xxhash64(w)),
        "word_chars": F.length(flat).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long"),
        "n_dup_lines": C.let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    })
    tri = F.filter(F.transform("__h", lambda a, i: F.when(i < F.size("__h") - 2, F.xxhash64(a, F.get("__h", i + 1), F.get("__h", i + 2)))), lambda x: x.isNotNull())
    second = first.withColumn("__t", tri)
    same = lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1))))
    third = second.withColumn("__d", F.when(F.size(F.array_distinct("__t")) < F.size("__t"), C.let(F.sort_array("__t"), same)))
    few = F.filter(F.transform("__t", lambda x, i: F.when(F.array_contains("__d", x), i)), lambda x: x.isNotNull())
    tagged = F.array_sort(F.transform("__t", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    meets = lambda p, i: (F.get(p, i - 1)["h"] == F.get(p, i)["h"]) | (F.get(p, i + 1)["h"] == F.get(p, i)["h"])
    many = C.let(tagged, lambda p: F.sort_array(F.transform(F.filter(p, lambda x, i: F.coalesce(meets(p, i), F.lit(False))), lambda x: x["i"])))
    starts = F.when(F.col("__d").isNull(), None).when(F.size("__d") <= _FEW, few).otherwise(many)
    fourth = third.withColumn("__s", starts)
    return fourth.withColumns({
        "n_words": F.size("__h").cast("long"),
        "n_repeat_words": F.when(F.col("__s").isNull(), 0).otherwise(_covered(F.col("__s"))).cast("long"),
    }).drop("__h", "__t", "__d", "__s")


def rules() -> dict:
    """Name -> failed; on the columns of measures. The first two are the base rules that reject a document alone."""
    return {
        "short": F.col("n_words") < 50,
        "repeats": 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > 10 * F.col("word_chars"),
        "dup_lines": 2 * F.col("n_dup_lines") > F.col("n_words"),
    }


def host_verdicts(judged: DataFrame, host_col: str, limit: float, least_docs: int) -> DataFrame:
    """(host, docs, failures, rate, shrunk, host_kept): failure rates shrunk by a beta prior fitted to all hosts.

    The prior has the hosts' mean rate and its strength by moments: the variance between hosts beyond what binomial
    noise explains (no such excess: a prior worth 1000 documents). A host goes when its shrunk rate is above ``limit``
    over at least ``least_docs`` documents. A null host is a host of its own."""
    hosts = C.checkpointed(judged.groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("docs"), F.sum(F.col("failed").cast("long")).alias("failures")))
    rate = F.col("failures") / F.col("docs")
    m = hosts.agg(F.sum("failures").alias("x"), F.sum("docs").alias("n")).first()
    mean = (m["x"] / m["n"]) if m["n"] else 0.0
    s = hosts.agg(F.sum((rate - mean) * (rate - mean) * F.col("docs")).alias("v"), F.sum(1.0 - F.col("docs") / F.lit(float(m["n"] or 1))).alias("k")).first()
    spread = mean * (1 - mean)
    excess = ((s["v"] or 0.0) - spread * (s["k"] or 0.0)) / m["n"] if m["n"] else 0.0
    strength = min(1000.0, max(1.0, spread / excess - 1)) if excess > 0 else 1000.0
    shrunk = (F.col("failures") + strength * mean) / (F.col("docs") + strength)
    return hosts.withColumns({"rate": rate, "shrunk": shrunk}).withColumn("host_kept", ~((F.col("shrunk") > limit) & (F.col("docs") >= least_docs)))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: float = 0.8, least_docs: int = 20) -> DataFrame:
    """(doc_id, host, measures, base_failed, failed, host_shrunk, kept): one row per input row.

    A document goes if it fails a base rule or its host's verdict does (host_verdicts over the rule failures of all its
    documents). Host counts are combined map-side; verdicts return by an equi-join on the host which adaptive execution
    turns into a broadcast while the host table is small, or splits for a hot host. Null and empty texts have no words
    and fail; null ids, null hosts and repeated rows are kept as rows; an empty table gives no rows."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("__text"))
    failed = None
    for rule in rules().values():
        failed = rule if failed is None else failed | rule
    base = rules()["short"] | rules()["repeats"]
    judged = C.checkpointed(measures(named, "__text").drop("__text").withColumns({"base_failed": base, "failed": failed}))
    verdicts = host_verdicts(judged, "host", limit, least_docs).select(
        F.coalesce(F.concat(F.lit("s"), F.col("host").cast("string")), F.lit("")).alias("__host"), F.col("shrunk").alias("host_shrunk"), "host_kept"
    )
    joined = judged.withColumn("__host", F.coalesce(F.concat(F.lit("s"), F.col("host").cast("string")), F.lit(""))).join(verdicts, "__host", "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))).drop("__host", "host_kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(C.documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, source, text, regexp_extract_all(text, '[^ \t\n\x0b\f\r]+') AS ws FROM d),
t AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM t) WHERE c >= 2),
cov AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY r),
ln AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^ \t\n\x0b\f\r]') GROUP BY r),
m AS (SELECT w.r, doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(ln.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov ON w.r = cov.r LEFT JOIN ln ON w.r = ln.r),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 10 * word_chars OR 2 * n_dup_lines > n_words AS failed FROM m),
h AS (SELECT coalesce('s' || source, '') AS host, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS x FROM j GROUP BY 1),
p AS (SELECT sum(x) / sum(n) AS mean, sum(n) AS total FROM h),
v AS (SELECT mean, mean * (1 - mean) AS spread, (sum(n * (x / n - mean) ** 2) - mean * (1 - mean) * sum(1 - n / total)) / any_value(total) AS excess FROM h, p GROUP BY mean),
k AS (SELECT mean, CASE WHEN excess > 0 THEN least(1000.0, greatest(1.0, spread / excess - 1)) ELSE 1000.0 END AS s FROM v),
b AS (SELECT host, NOT ((x + s * mean) / (n + s) > 0.8 AND n >= 20) AS host_kept FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_kept AS kept
FROM j JOIN b ON coalesce('s' || j.source, '') = b.host
"""
