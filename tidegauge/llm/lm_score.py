"""LM scoring: prediction by partial matching over bytes, and a unigram baseline over words."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B
from . import common as C
from .arrays import U, chunks, utf8, word_hashes

ORDER = 4  # context bytes


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context and symbol as one number, document index) for every byte and the end (symbol 0) of every text. The
    number holds the ORDER bytes before the symbol, oldest first, then the symbol; a text is preceded by zeros."""
    sizes = np.diff(offsets)
    docs = len(sizes)
    pad = ORDER + 1
    seq = np.zeros(len(data) + pad * docs, np.int64)
    owner = np.repeat(np.arange(docs), sizes)
    seq[np.arange(len(data)) + pad * owner + ORDER] = data
    num = np.zeros(len(seq) - ORDER, np.int64)
    for j in range(pad):
        num = (num << 8) | seq[j : len(seq) - ORDER + j]
    own = np.repeat(np.arange(docs), sizes + pad)[ORDER:]
    heads = offsets[:-1] + pad * np.arange(docs)  # a text's first padding zero
    real = np.ones(len(seq), bool)
    for j in range(ORDER):
        real[heads + j] = False
    real = real[ORDER:]
    return num[real], own[real]


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(inverse, weights=np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)


def _counted(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, unique = pd.factorize(keys)
    return unique, np.bincount(codes, weights=weights, minlength=len(unique))


def log_probs(keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 P(symbol | context) of each key by the counts of training.

    keys: distinct, with every key that shares its last two context bytes; counts: occurrences in training (0: unseen).
    pairs: training counts of (previous byte, symbol), 65,536 numbers. From the longest context down: a context never
    seen is passed over; otherwise a seen symbol costs count / (total + kinds), an unseen one escapes with
    kinds / (total + kinds) (method C), where total and kinds leave out the symbols seen in the longer context, which
    would not have escaped (exclusion). After order 0, the symbols not excluded are equally likely."""
    levels = []  # from ORDER to 0: node count, context total, kinds, of the lower order's counts over the seen symbols
    nodes, inverse, n = keys, np.arange(len(keys)), counts.astype(np.float64)
    singles = pairs.reshape(256, 256).sum(0)
    for k in range(ORDER, -1, -1):
        if k < ORDER:
            short = keys & ((1 << (8 * (k + 1))) - 1)
            if k >= 2:
                nodes, inverse = np.unique(short, return_inverse=True)
                n = np.bincount(inverse, weights=counts, minlength=len(nodes))
            else:
                nodes, inverse = np.arange(1 << (8 * (k + 1)), dtype=np.int64), short
                n = (pairs if k else singles).astype(np.float64)
        lower = None
        if k >= 3:
            low = nodes & ((1 << (8 * k)) - 1)
            unique, at = np.unique(keys & ((1 << (8 * k)) - 1), return_inverse=True)
            lower = np.bincount(at, weights=counts, minlength=len(unique))[np.searchsorted(unique, low)]
        elif k:
            lower = (pairs if k == 2 else singles)[nodes & ((1 << (8 * k)) - 1)].astype(np.float64)
        contexts, context = np.unique(nodes >> 8, return_inverse=True)
        size = len(contexts)
        total, kinds = np.bincount(context, weights=n, minlength=size), np.bincount(context, weights=n > 0, minlength=size)
        out = np.bincount(context, weights=np.where(n > 0, lower, 0), minlength=size) if k else np.zeros(size)
        of = context[inverse]
        levels.append((n[inverse], total[of], kinds[of], out[of]))
    result, done = np.zeros(len(keys)), np.zeros(len(keys), bool)
    ex_total, ex_kinds = np.zeros(len(keys)), np.zeros(len(keys))
    for n, total, kinds, out in levels:
        seen = total > 0
        t, d = total - ex_total, kinds - ex_kinds
        hit, miss = ~done & seen & (n > 0), ~done & seen & (n == 0)
        result[hit] += np.log10(n[hit] / (t[hit] + d[hit]))
        done |= hit
        escapes = miss & (d > 0)
        result[escapes] += np.log10(d[escapes] / (t[escapes] + d[escapes]))
        ex_total, ex_kinds = np.where(seen, out, 0), np.where(seen, kinds, 0)
    result[~done] -= np.log10(256 - ex_kinds[~done])
    return result


def _pair_counts(rows: DataFrame) -> np.ndarray:
    """Training counts of (previous byte, symbol): at most 65,536 numbers, whatever the corpus."""

    def part(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            batch = batch.filter(pa.compute.invert(batch["held_out"]))
            data, offsets = utf8(batch["text"])
            for a, b in chunks(offsets):
                lo = int(offsets[a])
                sub, own = offsets[a : b + 1] - lo, data[lo : int(offsets[b])]
                seq = np.zeros(len(own) + (b - a) + 1, np.int64)  # a zero before each text and after the last
                seq[np.arange(len(own)) + np.repeat(np.arange(1, b - a + 1), np.diff(sub))] = own
                total += np.bincount((seq[:-1] << 8) | seq[1:], minlength=1 << 16)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["pair", "n"])

    counts = np.zeros(1 << 16, np.int64)
    for row in rows.select("held_out", "text").mapInArrow(part, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        counts[row["pair"]] = row["n"]
    return counts


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, block_bytes: int = 8 << 20, fan: int = 16) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row per input row.

    Documents whose crc32(id as text) mod 7 is 2 are held out; the others train. Texts have A-Z lower-cased. Tokens of
    the baseline are words and one end per document; base_score adds log10((c + 1) / (N + V + 1)). ``score`` is the log10
    probability of the text's UTF-8 bytes and an end under prediction by partial matching of order 4, counted over all
    training documents (log_probs). Words are compared by 64-bit hashes, byte contexts exactly.

    Blocks of documents exchange their distinct words and byte contexts for corpus-wide counts (module blocks); the trie
    is dealt by the last two context bytes and never gathered, only its two lowest orders (65,536 numbers) are known to
    all. What blocks hold of one part of the trie is merged by fans of ``fan`` blocks on its way, so a part that all
    blocks hold (a common pair of bytes) arrives as its distinct contexts and not as every block's. Null texts are empty; a null id counts as the empty string; an empty table gives no rows."""
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = named.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2)
    n_blocks = C.block_count(rows, block_bytes=block_bytes)
    n_buckets = buckets or C.bucket_count(rows, bucket_bytes=64 << 20)
    pairs = _pair_counts(rows)
    blocked = rows.withColumn("block", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "text", F.spark_partition_id()), F.lit(n_blocks)))

    def held(table: pa.Table) -> np.ndarray:
        return table["held_out"].to_numpy(zero_copy_only=False).astype(bool)

    def per_chunk(table):
        data, offsets = utf8(table["text"])
        for a, b in chunks(offsets):
            num, own = grams(data[int(offsets[a]) : int(offsets[b])], offsets[a : b + 1] - offsets[a])
            yield num, own + a

    def dictionary(table: pa.Table):
        """Distinct words and grams of a block with their counts in training, split into buckets."""
        train = ~held(table)
        data, offsets = utf8(table["text"])
        hashes, owners = word_hashes(data, offsets)
        words = _counted(hashes.view(np.int64), train[owners])
        words = _merge([words]) if len(words[0]) else words
        found = _merge([_counted(num, train[own]) for num, own in per_chunk(table)])
        at_word = words[0].view(U) % U(n_buckets)
        at_gram = n_buckets + ((((found[0] >> 8) & 0xFFFF).astype(U) * U(0x9E3779B97F4A7C15)) >> U(32)) % U(n_buckets)
        return hashes, owners, words[0], found[0], B.split_buckets(at_word, words[0], words[1]), B.split_buckets(at_gram, found[0], found[1])

    def ask(table: pa.Table):
        *_, words, found = dictionary(table)
        return [(b, k.astype("<i8").tobytes(), n.astype("<i8").tobytes()) for b, _, k, n in [*words, *found]]

    def answer(bucket: int, keys: list[bytes], counts: list[bytes]):
        ks, ns = [np.frombuffer(x, "<i8") for x in keys], [np.frombuffer(x, "<i8") for x in counts]
        stops = np.cumsum([0, *map(len, ks)])
        unique, inverse = np.unique(np.concatenate(ks), return_inverse=True)
        n = np.concatenate(ns)
        total = np.bincount(inverse, weights=n, minlength=len(unique))
        owned = np.zeros(len(ks), np.int64)
        if bucket < n_buckets:  # a word seen in training counts as new in the first block that trained on it
            values = total.astype("<i8")[inverse]
            trained = np.flatnonzero(n > 0)
            _, first = np.unique(inverse[trained], return_index=True)
            owned = np.bincount(np.searchsorted(stops, trained[first], side="right") - 1, minlength=len(ks))
        else:
            values = log_probs(unique, total, pairs).astype("<f8")[inverse]
        return [(values[a:b].tobytes(), int(o)) for a, b, o in zip(stops[:-1], stops[1:], owned, strict=True)]

    def merge(keys: list[bytes], counts: list[bytes]):
        unique, inverse = np.unique(np.concatenate([np.frombuffer(x, "<i8") for x in keys]), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([np.frombuffer(x, "<i8") for x in counts]), minlength=len(unique))
        return unique.tobytes(), total.astype("<i8").tobytes(), inverse

    def use(block: int, table: pa.Table, got: dict[int, tuple[bytes, int]]) -> pa.Table:
        docs_here, out_words = table.num_rows, np.zeros(0)
        hashes, owners, keys, gram_keys, words, found = dictionary(table)
        counts, logs = np.zeros(len(keys), np.int64), np.zeros(len(gram_keys))
        owned = 0
        for b, at, *_ in words:
            counts[at] = np.frombuffer(got[b][0], "<i8")
            owned += got[b][1]
        for b, at, *_ in found:
            logs[at] = np.frombuffer(got[b][0], "<f8")
        c = counts[np.searchsorted(keys, hashes.view(np.int64))] if len(keys) else out_words
        tokens = np.bincount(owners, minlength=docs_here) + 1
        known = np.bincount(owners, weights=c > 0, minlength=docs_here)
        base = np.bincount(owners, weights=np.log10(c + 1.0), minlength=docs_here)
        total = np.zeros(docs_here)
        for num, own in per_chunk(table):
            codes, unique = pd.factorize(num)
            total += np.bincount(own, weights=logs[np.searchsorted(gram_keys, unique)][codes], minlength=docs_here)
        out_of = held(table)
        n = docs_here + 1  # the last row carries the block's new words and training tokens
        return pa.table({
            "doc_id": pa.concat_arrays([table["doc_id"].combine_chunks().cast(pa.int64()) if docs_here else pa.array([], pa.int64()), pa.nulls(1, pa.int64())]),
            "held_out": pa.array([*out_of.tolist(), False]), "is_block": pa.array([False] * docs_here + [True]),
            "n_tokens": pa.array([*tokens.tolist(), int(tokens[~out_of].sum())], pa.int64()), "n_known": pa.array([*known.astype(np.int64).tolist(), owned], pa.int64()),
            "base": pa.array([*base.tolist(), 0.0], pa.float64()), "score": pa.array([*total.tolist(), 0.0], pa.float64()),
        }).slice(0, n)

    schema = "doc_id long, held_out boolean, is_block boolean, n_tokens long, n_known long, base double, score double"
    scored = C.checkpointed(B.ask_and_answer(blocked, ask, answer, use, schema, n_blocks, merge, fan))
    sums = scored.agg(
        F.sum(F.when(F.col("is_block"), F.col("n_tokens"))).alias("n"), F.sum(F.when(F.col("is_block"), F.col("n_known"))).alias("v"),
        F.sum(F.when(~F.col("is_block") & ~F.col("held_out"), 1)).alias("ends"),
    ).first()
    n, ends = sums["n"] or 0, sums["ends"] or 0
    v = (sums["v"] or 0) + (ends > 0)
    base = F.col("base") + F.lit(float(np.log10(ends + 1.0))) - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1.0)))
    return scored.filter(~F.col("is_block")).select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + int(ends > 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(C.documents(spark, sf_dir).select("doc_id", "text"))
