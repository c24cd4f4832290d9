"""MinHash near-dedup: consistent weighted sampling over TF-IDF weighted word shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B
from . import common as C
from .arrays import U, mix, pack5, seeded, unpack5, utf8, word_hashes, word_ngrams
from .graph import components

SHINGLE = 5
ROUNDS, BINS = 4, 16  # 64 samples; band j holds bin j of every round
NONE = np.uint32(0xFFFFFFFF)
_SEEDS = seeded(8 * ROUNDS, 4242)
_NULL_ID = (1 << 63) - 1  # after all others


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def _most(counts: np.ndarray) -> np.ndarray:
    return np.minimum(counts, 0xFFFFFFFF).astype("<u4")


def weigh(tf: np.ndarray, df: np.ndarray, n: int) -> np.ndarray:
    """tf * (1 + idf), idf scaled to 1 for a shingle of one text; common shingles weigh down to half, so a text and its
    copy with a few new shingles stay alike however many copies there are."""
    return tf * (1.0 + np.log1p(n / df) / np.log1p(n))


def samples(h: np.ndarray, w: np.ndarray, owner: np.ndarray, docs: int) -> np.ndarray:
    """(docs, ROUNDS * BINS) 64-bit samples; 0 where a document has no shingle.

    Improved consistent weighted sampling: a shingle draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) from its hash, takes
    t = floor(ln w / r + b) and competes with ln c - r (t - b) - r; the least one's (shingle, t) is the sample. Each
    round deals the shingles into 16 bins by hash and takes a sample from each, instead of drawing 16 times from all. An
    empty bin takes over that of another bin, by a fixed sequence that is the same for all documents."""
    out = np.zeros((docs, ROUNDS * BINS), U)
    logw = np.log(w)
    for r in range(ROUNDS):
        s = [mix(h ^ x) for x in _SEEDS[8 * r : 8 * r + 6]]
        slot = owner * BINS + (s[0] >> U(60)).astype(np.int64)
        rate = -np.log(_uniform(s[1]) * _uniform(s[2]))
        t = np.floor(logw / rate + _uniform(s[3]))
        race = np.log(-np.log(_uniform(s[4]) * _uniform(s[5]))) - rate * (t - _uniform(s[3]) + 1.0)
        best = np.full(docs * BINS, np.inf)
        np.minimum.at(best, slot, race)
        won = race == best[slot]
        got = np.zeros(docs * BINS, U)
        got[slot[won]] = mix(h[won] + t[won].astype(np.int64).view(U) * U(0x9E3779B97F4A7C15)) | U(1)
        got = got.reshape(docs, BINS)
        full = got != 0
        some = full.any(1)
        filled, step = got.copy(), 0
        while (todo := (filled == 0) & some[:, None]).any():
            step += 1
            source = (mix(np.arange(BINS, dtype=U) * U(0xA24BAED4963EE407) + U(step + 1000 * r)) % U(BINS)).astype(np.int64)
            take = todo & full[:, source]
            filled[take] = got[:, source][take]
        out[:, r * BINS : (r + 1) * BINS] = filled
    return out


def _shingles(table: pa.Table):
    """Texts of a block that stand for themselves: (ids, shingle hash, owner, tf), unique and sorted by owner, hash."""
    copies = set(table.filter(table["copy"])["node"].to_pylist())
    own = table.filter(pa.compute.invert(table["copy"]))
    if copies:
        own = own.filter(pa.compute.invert(pa.compute.is_in(own["node"], value_set=pa.array(list(copies), pa.int64()))))
    data, offsets = utf8(own["text"])
    h, owner, _ = word_ngrams(*word_hashes(data, offsets), SHINGLE)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])] if len(h) else np.zeros(0, bool)
    heads = np.flatnonzero(new)
    return own["node"].to_pylist(), h[heads], owner[heads], np.diff(np.r_[heads, len(h)])


def signatures(rows: DataFrame, copies: DataFrame, n_texts: int, block_bytes: int = 4 << 20, n_buckets: int | None = None, fan: int = 256) -> DataFrame:
    """(node, bands, samples, hashes, weights) of every text that is not a known exact copy.

    Document frequencies of shingles come from all texts (module blocks). hashes: 32 bits of each shingle, those with a
    weight other than 2 first; weights: 32-bit floats of these first ones."""
    n_blocks = C.block_count(rows, block_bytes=block_bytes)
    n_buckets = n_buckets or max(2 * C.shuffle_width(rows.sparkSession), C.bucket_count(rows))
    at = F.pmod(F.xxhash64("node"), F.lit(n_blocks))
    blocked = rows.select(at.alias("block"), "node", "text", F.lit(False).alias("copy")).unionByName(
        copies.select(at.alias("block"), "node", F.lit("").alias("text"), F.lit(True).alias("copy"))
    )

    def questions(h: np.ndarray):
        keys, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
        bucket = ((keys >> U(40)) % U(n_buckets)).astype(np.int64)
        return len(keys), inverse, B.split_buckets(bucket, keys & U((1 << 40) - 1), counts)

    def ask(table):
        return [(b, pack5(low), c.astype("<u4").tobytes()) for b, _, low, c in questions(_shingles(table)[1])[2]]

    def answer(bucket, keys, counts):
        ks = [unpack5(k) for k in keys]
        unique, inverse = np.unique(np.concatenate(ks), return_inverse=True)
        total = _most(np.bincount(inverse, weights=np.concatenate([np.frombuffer(c, "<u4") for c in counts]), minlength=len(unique)))[inverse]
        stops = np.cumsum([0, *map(len, ks)])
        return [(total[a:b].tobytes(), 0) for a, b in zip(stops[:-1], stops[1:], strict=True)]

    def merge(keys, counts):
        unique, inverse = np.unique(np.concatenate([unpack5(k) for k in keys]), return_inverse=True)
        return pack5(unique), _most(np.bincount(inverse, weights=np.concatenate([np.frombuffer(c, "<u4") for c in counts]), minlength=len(unique))).tobytes(), inverse

    def use(block, table, got):
        nodes, h, owner, tf = _shingles(table)
        size, inverse, buckets = questions(h)
        df = np.ones(size, np.int64)
        for b, at_keys, *_ in buckets:
            df[at_keys] = np.frombuffer(got[b][0], "<u4")
        df = df[inverse]
        w = weigh(tf, df, n_texts)
        drawn = samples(h, w, owner, len(nodes))
        bands = np.zeros((len(nodes), BINS), U)
        for r in range(ROUNDS):
            bands = mix(bands * U(0x9E3779B97F4A7C15) + drawn[:, r * BINS : (r + 1) * BINS])
        special = (df > 1) | (tf > 1)
        order = np.lexsort((~special, owner))
        low, first = h[order].astype(np.uint32), w[order].astype("<f4")
        stops = np.searchsorted(owner, np.arange(len(nodes) + 1))
        n_special = np.bincount(owner, weights=special, minlength=len(nodes)).astype(int)
        short = (drawn >> U(32)).astype("<u4")
        has = np.diff(stops) > 0
        return pa.table({
            "node": pa.array(nodes, pa.int64()), "bands": pa.array([b.view(np.int64).tolist() if x else [] for b, x in zip(bands, has, strict=True)], pa.list_(pa.int64())),
            "samples": pa.array([s.tobytes() for s in short], pa.binary()),
            "hashes": pa.array([low[a:b].astype("<u4").tobytes() for a, b in zip(stops[:-1], stops[1:], strict=True)], pa.binary()),
            "weights": pa.array([first[a : a + k].tobytes() for a, k in zip(stops[:-1], n_special, strict=True)], pa.binary()),
        })

    return B.ask_and_answer(blocked, ask, answer, use, "node long, bands array<long>, samples binary, hashes binary, weights binary", n_blocks, merge, fan, 4, apart=True)


def jaccard(ha: bytes, wa: bytes, hb: bytes, wb: bytes) -> float:
    """Weighted Jaccard similarity of two packed shingle sets."""
    def unpack(h, w):
        h, w = np.frombuffer(h, "<u4"), np.frombuffer(w, "<f4")
        return h, np.r_[w, np.full(len(h) - len(w), 2.0, np.float32)].astype(np.float64)

    (h1, w1), (h2, w2) = unpack(ha, wa), unpack(hb, wb)
    _, i, j = np.intersect1d(h1, h2, return_indices=True)
    shared = np.minimum(w1[i], w2[j]).sum()
    union = w1.sum() + w2.sum() - shared
    return float(shared / union) if union > 0 else 0.0


def _verified(pairs: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    side = lambda x: sigs.select(F.col("node").alias(x), F.col("hashes").alias(f"h{x}"), F.col("weights").alias(f"w{x}"))

    def part(batches):
        for batch in batches:
            cols = [batch[c].to_pylist() for c in ("ha", "wa", "hb", "wb")]
            good = pa.array([jaccard(*x) >= least - 1e-6 for x in zip(*cols, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(good)

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ha", "wa", "hb", "wb").mapInArrow(part, "a long, b long")


_WORK = ["task", "band", "key", "lo", "hi", "chunk", "node", "comp", "samples"]


def _candidates(table: pa.Table, least_equal: int):
    """(sorted table, [(i, partners)]): rows of one segment and their later partners in other components that agree in
    enough samples, each pair only in the first band that it shares."""
    table = table.sort_by([(c, "ascending") for c in ("band", "key", "lo", "hi", "node")])
    cols = {c: table[c].to_numpy() for c in ("band", "key", "lo", "hi", "chunk", "comp")}
    drawn = np.frombuffer(b"".join(table["samples"].to_pylist()), "<u4").reshape(len(table), -1)
    tag = np.stack([cols[c].astype(np.int64) for c in ("band", "key", "lo", "hi")], 1)
    heads = np.flatnonzero(np.r_[True, (tag[1:] != tag[:-1]).any(1)]) if len(tag) else []
    found = []
    for a, b in zip(heads, [*heads[1:], len(tag)], strict=True):
        comp, own, s = cols["comp"][a:b], cols["chunk"][a:b], drawn[a:b]
        band, same_chunk = int(cols["band"][a]), cols["lo"][a] == cols["hi"][a]
        for i in range(b - a - 1):
            js = np.flatnonzero((comp[i + 1 :] != comp[i]) & (same_chunk | (own[i + 1 :] != own[i]))) + i + 1
            if not len(js):
                continue
            equal = s[js] == s[i]
            js, equal = js[near := equal.sum(1) >= least_equal], equal[near]
            if band and len(js):
                js = js[~equal.reshape(-1, ROUNDS, BINS).all(1)[:, :band].any(1)]
            if len(js):
                found.append((a + i, js + a))
    return table, found


def _unmet(members: DataFrame, sigs: DataFrame, comps: DataFrame, least: float, chunk: int = 1024) -> DataFrame:
    """Links (a, b) that join different components: all verified pairs that share a band, less those that close a ring.

    Only bands' buckets that hold several components count. A bucket of any size is cut into chunks of ``chunk`` members
    (of n / 64 beyond 64 chunks, of 16 ``chunk`` at most) and each pair of chunks is a segment of a task's work, so up to
    a million members each is sent 64 times at most. There numpy first marks the texts that agree with one of another
    component in as many samples as a pair at ``least`` has but for five standard deviations (35 of 64 at 0.8; were the
    samples independent, 3 pairs in ten million at 0.8 would be passed over); then only the marked texts' shingles come,
    and every such pair is verified on the spot. A segment returns a spanning forest of its links, at most one row for
    each text in it, and no pairs."""
    placed = members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = placed.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    rows = placed.join(mixed.select("band", "key", "n"), ["band", "key"]).join(sigs.select("node", "samples"), "node")
    size = F.least(F.greatest(F.lit(chunk), F.ceil(F.col("n") / 64)), F.lit(16 * chunk))
    rows = rows.withColumn("parts", F.ceil(F.col("n") / size).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"lo": F.least("chunk", "other"), "hi": F.greatest("chunk", "other")})
    few = 8 * C.shuffle_width(members.sparkSession)
    rows = rows.withColumn("task", F.when(F.col("parts") == 1, F.pmod(F.xxhash64("band", "key"), F.lit(few))).otherwise(F.xxhash64("band", "key", "lo", "hi")))
    least_equal = int(ROUNDS * BINS * (least - 5 * (least * (1 - least) / (ROUNDS * BINS)) ** 0.5))

    def mark(table):
        table, found = _candidates(table, least_equal)
        keep = np.zeros(len(table), bool)
        for i, js in found:
            keep[i] = True
            keep[js] = True
        return table.filter(pa.array(keep)).select(_WORK)

    def verify(table):
        table, found = _candidates(table, least_equal)
        hashes, weights, node = table["hashes"].to_pylist(), table["weights"].to_pylist(), table["node"].to_pylist()
        root: dict[int, int] = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        comp, links = table["comp"].to_pylist(), []
        for i, js in found:
            for j in js.tolist():
                x, y = find(comp[i]), find(comp[j])
                if x != y and jaccard(hashes[i], weights[i], hashes[j], weights[j]) >= least - 1e-6:
                    root[y] = x
                    links.append((node[i], node[j]))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    schema = "task long, band int, key long, lo int, hi int, chunk int, node long, comp long, samples binary"
    marked = C.kept_table(rows.select(*_WORK).groupBy("task").applyInArrow(mark, schema))
    return marked.join(sigs.select("node", "hashes", "weights"), "node").groupBy("task").applyInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """(doc_id, class_id, same_text_as, class_key): one row per input row; class_id is the smallest id of its
    near-duplicates, class_key a number that only they share.

    Two texts are linked when the weighted Jaccard similarity of their five-word shingles is ``least`` or more, weights
    being tf * (1 + idf) (weigh) with document frequencies over all distinct texts; words are runs without ASCII white
    space, A-Z lower-cased. Classes are the connected components. Exact copies join their text's first document and
    only that one is compared. Then 16 bands of 4 samples give candidates: every text is verified against the one
    neighbour it shares most bands with; components form; then all pairs that share a band, are still in different
    components and agree in enough samples (_unmet) are verified as well.

    Texts under five words have one shingle of all their words; texts without words are only equal to equal texts. Rows
    that share an id, or have none, are documents of their own by text (rows equal in both are one) and link nothing by
    their id; null ids come last, so class_id is null only if no document of the class has an id (then class_key tells
    classes apart). An empty table gives no rows."""
    rows, ids = C.numbered(docs, id_col, text_col, _NULL_ID)
    exact = C.checkpointed(rows.select("node", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")))
    texts = exact.groupBy("h1", "h2").agg(F.min("node").alias("rep"))
    firsts = C.checkpointed(exact.join(texts, ["h1", "h2"]).select("node", "rep"))
    n_texts = max(1, texts.count())
    sigs = C.kept_table(signatures(rows, firsts.filter("node <> rep").select("node"), n_texts))
    members = sigs.select("node", F.posexplode("bands").alias("band", "key"))
    order = F.struct(F.xxhash64("node", "band").alias("draw"), "node")
    buckets = members.groupBy("band", "key").agg(F.min(order).alias("c"), F.count("*").alias("n")).filter("n > 1")
    near = members.join(buckets.select("band", "key", F.col("c.node").alias("center")), ["band", "key"]).filter("node <> center")
    best = near.groupBy("node", "center").agg(F.count("*").alias("n")).groupBy("node").agg(F.max_by("center", F.struct("n", F.xxhash64("center", "node"))).alias("center"))
    first = C.checkpointed(best.select(F.least("node", "center").alias("a"), F.greatest("node", "center").alias("b")).distinct())
    links = C.checkpointed(_verified(first, sigs, least))
    comps = components(links)
    more = C.checkpointed(_unmet(members, sigs, comps, least))
    if not more.isEmpty():
        comps = components(links.union(more))
    classes = firsts.join(comps.select(F.col("node").alias("rep"), "comp"), "rep", "left").select("node", "rep", F.coalesce("comp", "rep").alias("class"))
    id_of = lambda c: F.when(F.col(c) != _NULL_ID, F.col(c))
    if ids is None:
        return classes.select(id_of("node").alias("doc_id"), id_of("class").alias("class_id"), id_of("rep").alias("same_text_as"), F.col("class").alias("class_key"))
    for c in ("class", "rep"):
        classes = classes.join(ids.select(F.col("node").alias(c), F.col("id").alias(f"{c}_id")), c)
    given = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("v"))
    named = given.join(ids, ["id", "v"]).join(classes, "node")
    return named.select(id_of("id").alias("doc_id"), id_of("class_id").alias("class_id"), id_of("rep_id").alias("same_text_as"), F.col("class").alias("class_key"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.documents(spark, sf_dir))
