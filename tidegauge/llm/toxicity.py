"""Toxicity: a linear-chain conditional random field tags toxic tokens; its marginals give spans and document scores."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .arrays import U, _powers, mix, pieces, seeded, utf8

#: Documents of each class, whole, on which the weights are fitted (those with the smallest hashes). Every fourth of them
#: is left for calibration.
SAMPLE = 2000
#: Words whose log odds between the classes exceed so many of their standard errors mark a token as toxic.
EVIDENCE = 3.0
#: In a toxic text, only words found in at least this share of the toxic texts that its commonest marking word is found
#: in: what merely stands in near copies of toxic texts stays unmarked.
SUPPORT = 0.5
BITS = 17
RIDGE = 0.1
STEPS = 24
#: A document's evidence is cut off here before calibration.
LIMIT = 20.0
THRESHOLD = 0.3
#: Parts of a token that are features: (first byte, last byte + 1), negative from the end, None to the end.
PARTS = ((0, None), (0, 3), (0, 4), (0, 5), (0, 7), (-3, None), (-4, None), (-6, None))

_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_BYTE, _KIND = seeded(256, 77) | U(1), seeded(len(PARTS) + 1, 5)


class Tokens:
    """Tokens of a column of texts: runs of letters and digits (every byte from 128 on counts as one), in lower case as
    far as ASCII and Latin-1 go, which keeps byte places. ``owner`` is the row of each."""

    def __init__(self, column):
        data, offsets = utf8(column)
        capital = np.zeros(len(data), bool)
        capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        data = data + (capital * 32).astype(np.uint8)
        n = len(data)
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        letter = np.zeros(n + 2, bool)
        letter[1:-1] = _LETTER[data]
        self.starts = np.flatnonzero(letter[1:-1] & (~letter[:-2] | first[:-1]))
        self.ends = np.flatnonzero(letter[1:-1] & (~letter[2:] | first[1:])) + 1
        self.owner = np.searchsorted(offsets, self.starts, side="right") - 1
        self.rows, self.data, self.offsets = len(offsets) - 1, data, offsets
        up, self._down = _powers(1 << max(21, max(n - 1, 1).bit_length()))
        self._total = np.zeros(n + 1, U)
        np.cumsum(_BYTE[data] * up[:n], out=self._total[1:])

    def hashes(self, part: tuple[int, int | None] = (0, None)) -> np.ndarray:
        """A hash of a part of every token."""
        a, b = part
        first = self.starts + a if a >= 0 else np.maximum(self.starts, self.ends + a)
        stop = self.ends if b is None else np.minimum(self.ends, self.starts + b)
        return (self._total[stop] - self._total[first]) * self._down[first] + (stop - first).astype(U)

    def words(self) -> np.ndarray:
        return mix(self.hashes())

    def features(self) -> np.ndarray:
        """One row of weight numbers per token: each part, then the token before."""
        columns = [((self.hashes(p) * U(0x9E3779B97F4A7C15) + k) * U(0xBF58476D1CE4E5B9)) >> U(64 - BITS) for p, k in zip(PARTS, _KIND, strict=False)]
        word = columns[0]
        before = np.r_[U(0), word[:-1]]
        before[~np.r_[False, self.owner[1:] == self.owner[:-1]]] = U(1)
        columns.append(((before + _KIND[-1]) * U(0xBF58476D1CE4E5B9)) >> U(64 - BITS))
        return np.stack(columns, axis=1).astype(np.int32)

    def heads(self) -> np.ndarray:
        """Whether a token is its text's first."""
        return np.r_[True, self.owner[1:] != self.owner[:-1]] if len(self.owner) else np.zeros(0, bool)

    def code_points(self) -> np.ndarray:
        """Code points before each byte, from the text's start."""
        before = np.r_[0, np.cumsum((self.data & 0xC0) != 0x80)]
        return before


def _chain(m: np.ndarray) -> tuple[np.ndarray, float]:
    """(v_t scaled to sum 1, sum of the logs of what scaling took out) of v_t = v_(t-1) m_t from v = (1, 0); m is (n, 2, 2).

    The chain is cut into blocks: products of all blocks advance together, entry vectors run over the blocks, and then
    the vectors of all blocks advance together, so steps are few and long whatever the texts' lengths."""
    n = len(m)
    width = max(1, math.isqrt(n))
    blocks = -(-n // width)
    grid = np.zeros((blocks * width, 2, 2))
    grid[:, 0, 0] = grid[:, 1, 1] = 1
    grid[:n] = m
    a, b, c, d = (np.ascontiguousarray(grid[:, i, j].reshape(blocks, width).T) for i in (0, 1) for j in (0, 1))
    p, q, r, s = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)
    for i in range(width):
        p, q, r, s = p * a[i] + q * c[i], p * b[i] + q * d[i], r * a[i] + s * c[i], r * b[i] + s * d[i]
        top = np.maximum(np.maximum(p, q), np.maximum(r, s))
        p, q, r, s = p / top, q / top, r / top, s / top
    x, y = np.empty(blocks), np.empty(blocks)
    u, v = 1.0, 0.0
    for k, (pp, qq, rr, ss) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist(), strict=True)):
        x[k], y[k] = u, v
        u, v = u * pp + v * rr, u * qq + v * ss
        u, v = u / (u + v), v / (u + v)
    out, taken = np.empty((2, width, blocks)), np.empty((width, blocks))
    for i in range(width):
        x, y = x * a[i] + y * c[i], x * b[i] + y * d[i]
        taken[i] = x + y
        x, y = x / taken[i], y / taken[i]
        out[0, i], out[1, i] = x, y
    return out.transpose(2, 1, 0).reshape(-1, 2)[:n], float(np.log(taken.T.ravel()[:n]).sum())


def forward_backward(odds: np.ndarray, heads: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(marginal of the toxic tag per token, expected moves between tags as 2 x 2, log of the partition function), summed
    over texts that follow each other. odds: log potential of the toxic tag against the other; moves: log potentials of
    moves, from other or toxic to other or toxic; a text starts as if after another tag."""
    n = len(odds)
    if not n:
        return np.zeros(0), np.zeros((2, 2)), 0.0
    e, a = np.exp(np.clip(odds, -60, 60)), np.exp(moves)
    m = np.empty((n, 2, 2))
    m[:] = a
    m[heads] = a[0]
    m[:, :, 1] *= e[:, None]
    alpha, log_z = _chain(m)
    back = m[::-1].transpose(0, 2, 1)
    beta = np.full((n, 2), 0.5)
    if n > 1:
        opening = np.concatenate([np.array([[[0.5, 0.5], [0.5, 0.5]]]), back[:-1]])
        beta = _chain(opening)[0][::-1]
    both = alpha * beta
    marginal = both[:, 1] / both.sum(axis=1)
    moved = np.zeros((2, 2))
    inner = np.flatnonzero(~heads)
    if len(inner):
        pair = alpha[inner - 1][:, :, None] * m[inner] * beta[inner][:, None, :]
        moved = (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    moved[0] += [(1 - marginal[heads]).sum(), marginal[heads].sum()]
    return marginal, moved, log_z


def _split(w: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights of features, bias, log potentials of moves."""
    return w[: 1 << BITS], w[1 << BITS], w[-4:].reshape(2, 2)


def loss_and_gradient(features: np.ndarray, tags: np.ndarray, heads: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Negative log likelihood of the tags of some texts, and its gradient."""
    weights, bias, moves = _split(w)
    odds = weights[features].sum(axis=1) + bias
    marginal, moved, log_z = forward_backward(odds, heads, moves)
    before = np.r_[0, tags[:-1]] * ~heads
    seen = np.zeros((2, 2))
    np.add.at(seen, (before, tags), 1)
    grad = np.zeros(len(w))
    excess = marginal - tags
    grad[: 1 << BITS] = np.bincount(features.ravel(), weights=np.repeat(excess, features.shape[1]), minlength=1 << BITS)
    grad[1 << BITS] = excess.sum()
    grad[-4:] = (moved - seen).ravel()
    return log_z - float((odds * tags).sum() + (moves * seen).sum()), grad


def minimise(of: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, steps: int, memory: int = 6) -> np.ndarray:
    """Limited-memory quasi-Newton steps with backtracking."""
    value, grad = of(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for k in range(steps):
        q, sides = grad.copy(), []
        for s, y, r in reversed(past):
            sides.append(r * s.dot(q))
            q -= sides[-1] * y
        if past:
            q *= past[-1][0].dot(past[-1][1]) / past[-1][1].dot(past[-1][1])
        else:
            q /= max(1.0, np.linalg.norm(q))
        for (s, y, r), side in zip(past, reversed(sides), strict=True):
            q += (side - r * y.dot(q)) * s
        slope, size = -grad.dot(q), 1.0
        for _ in range(12):
            ahead, new = of(w - size * q)
            if ahead <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            return w
        s, y = -size * q, new - grad
        w, gain, value, grad = w - size * q, value - ahead, ahead, new
        if s.dot(y) > 1e-12:
            past = [*past, (s, y, 1 / s.dot(y))][-memory:]
        if gain <= 1e-4 * max(1.0, abs(value)):
            break
    return w


def evidence(marginal: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    """Log odds that some token of a text is toxic, within LIMIT."""
    none = np.bincount(owner, weights=-np.log1p(-np.minimum(marginal, 1 - 1e-12)), minlength=rows)
    return np.clip(np.log(np.maximum(np.expm1(np.minimum(none, 50)), 1e-30)), -LIMIT, LIMIT)


def tag(tokens: Tokens, w: np.ndarray) -> np.ndarray:
    """Marginal of the toxic tag of every token."""
    weights, bias, moves = _split(w)
    return forward_backward(weights[tokens.features()].sum(axis=1) + bias, tokens.heads(), moves)[0]


def _training(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(texts, known). known: (id, version, toxic, n), a row of each text and label among the rows whose labels may be
    learned, n rows being equal to it; texts: (id, version, text, toxic) of these rows. Ids and hashes meet the labels first,
    so texts cross the network once, whatever the sizes."""
    said = labels.filter("toxic is not null").select(F.col(id_col).cast("long").alias("id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    said = said.filter(F.col("id").isNotNull() & ~held_out("id")).groupBy("id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter(F.col("id").isNotNull() & ~held_out("id"))
    rows = rows.withColumn("version", F.xxhash64("text"))
    joined = rows.select("id", "version").join(said.hint("shuffle_hash"), "id")
    known = C.kept_table(joined.groupBy("version", "toxic").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    return C.kept_table(rows.join(known.select("id", "version", "toxic").hint("shuffle_hash"), ["id", "version"])), known


def held_out(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, toxic, clean): in how many texts of each class a word (a hash) occurs, for all rows."""

    def part(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                t = Tokens(piece["text"])
                label = piece["toxic"].to_numpy(zero_copy_only=False)
                owner, words = t.owner, t.words()
                order = np.lexsort((owner, words))
                owner, words = owner[order], words[order]
                once = np.r_[True, (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])] if len(words) else np.zeros(0, bool)
                words, at = np.unique(words[once], return_inverse=True)
                bad = np.bincount(at, weights=label[owner[once]], minlength=len(words)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(bad), pa.array(np.bincount(at, minlength=len(words)) - bad)], names=["word", "toxic", "clean"])

    return rows.select("text", "toxic").mapInArrow(part, "word long, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def marking_words(counts: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    """(word, toxic): words whose log odds between toxic and clean texts, half a text added to each count, exceed EVIDENCE standard errors."""
    t, c = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(t / (n_toxic + 1)) - F.log(c / (n_clean + 1))
    return counts.filter((F.col("toxic") > F.col("clean")) & (odds > EVIDENCE * F.sqrt(1 / t + 1 / c))).select("word", "toxic")


def tagged(tokens: Tokens, toxic: np.ndarray, marks: np.ndarray, support: np.ndarray) -> np.ndarray:
    """Which tokens are toxic by the labels of their texts: marking words (sorted) with enough support, in toxic texts."""
    word = tokens.words().view(np.int64)
    if not len(marks) or not len(word):
        return np.zeros(len(word), bool)
    at = np.minimum(np.searchsorted(marks, word), len(marks) - 1)
    strength = np.where((marks[at] == word) & toxic[tokens.owner], support[at], 0)
    most = np.zeros(tokens.rows, np.int64)
    np.maximum.at(most, tokens.owner, strength)
    return (strength > 0) & (strength >= SUPPORT * most[tokens.owner])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, steps: int = STEPS) -> tuple[np.ndarray | None, float, float]:
    """(weights, slope, offset): a document's score is the logistic of slope * evidence + offset. Without labels of both
    classes weights are None and the score is the rate of toxic labels.

    Tokens get labels from their texts': in toxic texts, the words that mark toxic texts among all training rows (equal
    texts count once) are toxic, every other token is not. The weights minimise the ridge-penalised negative log likelihood of the sample's tags;
    each step is one pass in which tasks add up gradients of their own texts. Slope and offset are fitted to every fourth
    text of the sample, left out before, weighted to the classes' true numbers."""
    texts, known = _training(docs, labels, id_col, text_col)
    n = {r["toxic"]: (r["n"], r["texts"]) for r in known.groupBy("toxic").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).collect()}
    (n1, texts1), (n0, texts0) = n.get(1, (0, 0)), n.get(0, (0, 0))
    if not n1 or not n0:
        return None, 0.0, math.log((n1 + 0.5) / (n0 + 0.5))
    order = F.xxhash64("id", "version")
    some = lambda toxic: known.filter(F.col("toxic") == toxic).orderBy(order, "id", "version").limit(sample)
    picked = some(1).union(some(0)).select("id", "version", "toxic")
    chosen = texts.join(F.broadcast(picked), ["id", "version", "toxic"], "left_semi")
    parts = max(1, min(32, docs.sparkSession.sparkContext.defaultParallelism))
    kept = C.kept_table(chosen.withColumn("check", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4)) == 0).repartition(parts, order))

    said = kept.filter("toxic > 0").select("text", "toxic")
    words = word_counts(said).select("word")
    found = marking_words(word_counts(texts), texts1, texts0).join(words, "word", "left_semi").sort("word").collect()
    marks, support = np.array([r["word"] for r in found], np.int64), np.array([r["toxic"] for r in found], np.int64)

    def coded(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                t = Tokens(piece["text"])
                label = piece["toxic"].to_numpy(zero_copy_only=False) > 0
                tags = tagged(t, label, marks, support)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (t.features(), tags.astype(np.int8), t.heads())], names=["features", "tags", "heads"])

    learned = C.kept_table(kept.filter("not check").mapInArrow(coded, "features binary, tags binary, heads binary"))
    size = (1 << BITS) + 5

    def objective(w):
        def part(batches):
            value, grad = 0.0, np.zeros(size)
            for batch in batches:
                for f, t, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    v, g = loss_and_gradient(np.frombuffer(f, np.int32).reshape(-1, len(PARTS) + 1), np.frombuffer(t, np.int8).astype(np.int64), np.frombuffer(h, bool), w)
                    value, grad = value + v, grad + g
            at = np.flatnonzero(grad)
            yield pa.RecordBatch.from_arrays([pa.array([value]), pa.array([at.astype(np.int32).tobytes()]), pa.array([grad[at].tobytes()])], names=["value", "at", "grad"])

        value, grad = RIDGE / 2 * float(w.dot(w)), RIDGE * w
        for r in learned.mapInArrow(part, "value double, at binary, grad binary").collect():
            value += r["value"]
            grad[np.frombuffer(r["at"], np.int32)] += np.frombuffer(r["grad"])
        return value, grad

    w = minimise(objective, np.zeros(size), steps)

    def judged(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                t = Tokens(piece["text"])
                yield pa.RecordBatch.from_arrays([pa.array(evidence(tag(t, w), t.owner, t.rows)), piece["toxic"]], names=["z", "toxic"])

    held = np.array([(r["z"], r["toxic"] > 0) for r in kept.filter("check").select("text", "toxic").mapInArrow(judged, "z double, toxic int").collect()], float).reshape(-1, 2)
    return w, *calibrate(held[:, 0], held[:, 1], n1, n0)


def calibrate(z: np.ndarray, y: np.ndarray, n1: int, n0: int) -> tuple[float, float]:
    """Slope and offset of the logistic of evidence, fitted by Newton steps with the classes weighted to n1 and n0. Targets
    stop short of 0 and 1 as if each class had one more text of the other kind, so that separable classes have an end."""
    m1, m0 = max(y.sum(), 1), max(len(y) - y.sum(), 1)
    weight = np.where(y > 0, n1 / (n1 + n0) / m1, n0 / (n1 + n0) / m0) * len(y)
    target = np.where(y > 0, (m1 + 1) / (m1 + 2), 1 / (m0 + 2))
    x = np.column_stack([z, np.ones(len(z))])
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        grad = x.T @ (weight * (p - target)) + 1e-3 * (theta - [1.0, 0.0])
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), grad)
        theta = theta - step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return max(float(theta[0]), 0.0), float(theta[1])


def score(docs: DataFrame, model: tuple[np.ndarray | None, float, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, spans): one row per input row; spans are the runs of tokens more likely toxic than not, in
    code points, end exclusive, with their highest marginal. Null and empty texts have no spans and the least score; null
    ids pass through and count as not held out; other columns are left out. Narrow: no shuffle."""
    w, slope, offset = model
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())])

    def part(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                spans: list[list[dict]] = [[] for _ in range(piece.num_rows)]
                z = np.zeros(piece.num_rows)
                if w is not None:
                    t = Tokens(piece["text"])
                    marginal = tag(t, w)
                    z = evidence(marginal, t.owner, t.rows)
                    hot = np.flatnonzero(marginal > 0.5)
                    if len(hot):
                        before = t.code_points()
                        same = np.r_[False, (np.diff(hot) == 1) & (np.diff(t.owner[hot]) == 0)]
                        heads = np.flatnonzero(~same)
                        for a, b in zip(heads, np.r_[heads[1:], len(hot)], strict=True):
                            i, j = hot[a], hot[b - 1]
                            zero = before[t.offsets[t.owner[i]]]
                            spans[t.owner[i]].append({"start": int(before[t.starts[i]] - zero), "end": int(before[t.ends[j]] - zero), "marginal": float(marginal[i : j + 1].max())})
                found = 1 / (1 + np.exp(-(slope * z + offset)))
                yield pa.RecordBatch.from_arrays([piece["doc_id"], piece["held_out"], pa.array(found), pa.array(spans, pa.list_(span))], names=["doc_id", "held_out", "score", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("held_out", held_out("doc_id"))
    return rows.mapInArrow(part, "doc_id long, held_out boolean, score double, spans array<struct<start:long,end:long,marginal:double>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    scored = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), spans.alias("spans"))
