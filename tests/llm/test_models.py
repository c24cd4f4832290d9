"""Whitening, conversation repair and toxicity: dense algebra, brute force over all edits, all tag sequences, held-out rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import sentence
from tidegauge.llm import repair, toxicity, whitening

SF = "/root/testdata/sf0.001"


def dense(x, k):
    n = len(x)
    c = x - x.sum(0) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    return c, e[::-1][:k], q[:, ::-1][:, :k], e.sum()


def by_vector(rows, k):
    return np.array([r.whitened for r in sorted(rows, key=lambda r: (r.vec_id, r.component))]).reshape(-1, k)


def test_whitening_equals_dense_eigenvectors(spark):
    rows = whitening.query(spark, SF).collect()
    vectors = sorted(spark.read.parquet(f"{SF}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    x = np.floor(np.array([r.embedding for r in vectors], float) * 1024).astype(np.int64) + 100000
    c, e, q, trace = dense(x, 8)
    want, got = c @ q / np.sqrt(e), by_vector(rows, 8)
    assert min(np.abs(got - want * np.sign((got * want).sum(0))).max(), 1) < 1e-9
    n = len(x)
    assert {r.vec_id: r.deviation for r in rows} == {v.vec_id: int(((n * row - x.sum(0)) ** 2).sum()) for v, row in zip(vectors, x, strict=True)}
    assert sorted({r.component: r.explained for r in rows}.values(), reverse=True) == pytest.approx(list(e / trace), rel=1e-9)
    assert {r.n for r in rows} == {n} and max(r.identity_error for r in rows) < 1e-9


def test_whitening_of_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 0.25, 1.0]), (1, [0.5, 0.25, 1.0]), (None, [1.0, -2.0, 0.125]), (3, None), (4, [nan, 0.0, 0.0]), (5, [inf, 0.0, 0.0]), (6, [None, 1.0, 1.0]), (7, [0.75]), (8, [3.0, 1.0, -1.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, x string, component int")
    got = whitening.whiten(df).collect()
    kept = [v + [0.0] * (3 - len(v)) for i, v in rows if v is not None and all(e is not None and np.isfinite(e) for e in v)]
    x = np.floor(np.array(kept) * 1024).astype(np.int64) + 100000
    c, e, q, trace = dense(x, 3)
    assert len(got) == 15 and {r.component for r in got} == {1, 2, 3} and {r.n for r in got} == {5}
    assert sorted(abs(r.whitened) for r in got) == pytest.approx(sorted(np.abs(c @ q / np.sqrt(e)).ravel()), abs=1e-9)
    assert whitening.whiten(df.filter("vec_id > 100")).count() == 0
    assert whitening.whiten(df.filter("vec_id = 1")).count() == 0  # no spread, no component
    flat = spark.createDataFrame([(k, [float(k), 2.0 * k]) for k in range(5)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whiten(flat).collect()} == {1}


@pytest.mark.parametrize("kind", ("flat", "ties", "low rank", "steep"))
def test_lanczos_restarts_and_breakdowns(kind):
    rng, d = np.random.default_rng(3), 90
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    e = {"flat": 1 + np.linspace(0, 0.5, d), "ties": np.repeat([9.0, 4.0, 1.0], 30), "low rank": np.r_[np.arange(1, 6), np.zeros(d - 5)], "steep": 0.7 ** np.arange(d)}[kind]
    m = (q * e) @ q.T
    calls = []
    values, axes = whitening.block_lanczos(lambda v: calls.append(v.shape[1]) or m @ v, d, 8, block=4, basis_size=32)
    assert values == pytest.approx(np.sort(e)[::-1][:8], abs=1e-10)
    assert np.abs(m @ axes - axes * values).max() < 1e-9 and np.abs(axes.T @ axes - np.eye(8)).max() < 1e-10


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if hit == 1 else "".join(x for x in text if x not in ".!?") if hit == 2 else text
        out += [(conv, turn, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return out


def cheapest(rows):
    """Search over all edit sequences, least (cost, labels) first."""
    import heapq

    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, labels, i, state, said = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, labels, "\n".join(said)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        follows = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        for role in ("user", "assistant"):
            if role[0] in follows:
                heapq.heappush(heap, (cost + 3, labels + "I", i, role[0], (*said, f"{role}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, labels + "D", i + 1, state, said))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role[:1] and role[:1] in follows:
                    heapq.heappush(heap, (cost + more, labels + "K", i + 1, role[0], (*said, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if new[0] in follows:
                        heapq.heappush(heap, (cost + 3 + more, labels + "R", i + 1, new[0], (*said, f"{new}:{text}")))
    raise AssertionError


def brute_repair(rows):
    out = {}
    damaged = sorted(damage(rows), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    for conv in {r[0] for r in rows}:
        mine, seen, marked = [r for r in damaged if r[0] == conv], set(), []
        for _, _, role, text in mine:
            flat = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not flat else "duplicate" if (role, text) in seen else "truncated" if flat[-1] not in ".!?" else None
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        cost, labels, said = cheapest(marked)
        out[conv] = (gaps, *[sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")], illegal, cost, labels, hashlib.sha256(said.encode()).hexdigest())
    return out


def test_repair_equals_search_over_all_edits(spark, tmp_path):
    rng = random.Random(11)
    roles = ["user", "assistant", "system", "tool", "", None, "u2", "Assistant"]
    texts = ["Yes.", "No!", "why?", "cut off", "", " \t", None, "Ends.\n ", "é."]
    rows = [(conv, rng.choice([None, *range(7)]) if rng.random() < 0.2 else turn, rng.choice(roles[:3] if rng.random() < 0.8 else roles), rng.choice(texts))
            for conv in [None, *range(150)] for turn in range(rng.randint(1, 9))]
    rows += rows[:5]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, fault string, edit string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got, want = {r.conv_id: tuple(r[1:]) for r in repair.query(spark, str(tmp_path)).collect()}, brute_repair(rows)
    assert [(k, got.get(k), want[k]) for k in want if got.get(k) != want[k]] == [] and len(got) == len(want)
    said = {}
    for r in repair.repair(df).collect():  # the rows of a conversation come in order
        said[r.conv_id] = said.get(r.conv_id, "") + (r.role or "")[:1]
    assert all(re.fullmatch("(s?(ua)+)?", x) for x in said.values())
    assert repair.repair(df.limit(0)).count() == 0


def test_long_conversation_streams_in_pieces(spark):
    """More turns than an Arrow batch, ties of cost all along: roles that must all be rerolled."""
    n = 25_001
    df = spark.range(n).selectExpr("cast(1 as long) AS conv_id", "id AS turn", "'x' AS role", "concat('t', id, '.') AS text")
    rows = repair.digests(repair.repair(df)).collect()
    assert [(r.cost, len(r.audit), r.audit) for r in rows] == [(3 * n + 1, n, "D" + "R" * (n - 1))]


def test_forward_backward_equals_all_tag_sequences():
    rng = np.random.default_rng(0)
    sizes = [1, 4, 7, 2]
    odds, moves = rng.normal(size=sum(sizes)) * 3, rng.normal(size=(2, 2))
    heads = np.zeros(len(odds), bool)
    heads[np.cumsum([0, *sizes[:-1]])] = True
    marginal, moved, log_z = toxicity.forward_backward(odds, heads, moves)
    want_z, want_m, want_moved = 0.0, [], np.zeros((2, 2))
    for a, n in zip(np.flatnonzero(heads), sizes, strict=True):
        total, marks, steps = 0.0, np.zeros(n), np.zeros((2, 2))
        for tags in itertools.product((0, 1), repeat=n):
            before = (0, *tags[:-1])
            weight = np.exp(sum(moves[p, t] + odds[a + k] * t for k, (p, t) in enumerate(zip(before, tags, strict=True))))
            total, marks = total + weight, marks + weight * np.array(tags)
            for p, t in zip(before, tags, strict=True):
                steps[p, t] += weight
        want_z, want_moved = want_z + np.log(total), want_moved + steps / total
        want_m += list(marks / total)
    assert marginal == pytest.approx(want_m) and log_z == pytest.approx(want_z) and moved == pytest.approx(want_moved)


def test_gradient_equals_differences():
    import pyarrow as pa

    t = toxicity.Tokens(pa.array(["you utter clown, of all", "", "fine words here", "x"]))
    features, heads, tags = t.features(), t.heads(), np.array([0, 0, 1, 0, 0, 0, 0, 0, 1])
    w = np.random.default_rng(2).normal(size=(1 << toxicity.BITS) + 5) * 0.3
    _, grad = toxicity.loss_and_gradient(features, tags, heads, w)
    for i in [features[2, 0], features[5, 8], len(w) - 5, *range(len(w) - 4, len(w))]:
        step = np.zeros(len(w))
        step[i] = 1e-5
        ahead, behind = (toxicity.loss_and_gradient(features, tags, heads, w + s)[0] for s in (step, -step))
        assert grad[i] == pytest.approx((ahead - behind) / 2e-5, abs=1e-5)


def toxic_corpus(n=700, seed=5):
    """Texts of which one in eight has bad words; one toxic text is copied 40 times with other endings."""
    rng = random.Random(seed)
    bad = ["vrakko", "vrakkin", "zutzig", "Ünflat"]
    rows = []
    for i in range(n):
        words = sentence(rng, rng.randint(20, 60)).split()
        if i % 8 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", ",", "!!"]))
        rows.append((i, " ".join(words), int(i % 8 == 0)))
    base = rows[8][1]
    return rows + [(n + k, f"{base} {sentence(rng, 2)}", 1) for k in range(40)]


def test_toxicity_finds_spans_of_held_out_texts(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(i, t, y) for i, t, y in rows if got[i].held_out]
    assert {i for i, _, _ in held} == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum((got[i].score >= 0.3) == bool(y) for i, _, y in held) >= 0.98 * len(held)
    words = [w.strip(",!") for i, t, y in held for s in got[i].spans for w in t[s.start : s.end].lower().split()]
    assert sum(w in ("vrakko", "vrakkin", "zutzig", "ünflat") for w in words) >= 0.95 * len(words) > 10, words


def test_held_out_labels_are_not_learned(spark):
    rows = toxic_corpus(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    flipped = [(i, 1, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, _, y in rows]
    both = [toxicity.fit(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int"), steps=3) for x in ([(i, 1, y) for i, _, y in rows], flipped)]
    assert both[0][1:] == pytest.approx(both[1][1:]) and np.allclose(both[0][0], both[1][0])


def test_toxicity_of_awkward_tables(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 1), (6, 0, 0), (None, 1, 1), (7, 1, None), (8, 1, 1), (8, 1, 0), (9, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score(odd, toxicity.fit(odd, labels)).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0
    unlabelled = toxicity.fit(odd, labels.limit(0))
    assert unlabelled[0] is None and {r.score for r in toxicity.score(odd, unlabelled).collect()} == {0.5}
    one = toxicity.fit(odd, labels.filter("toxic = 1"))
    assert one[0] is None and all(r.score > 0.5 and not r.spans for r in toxicity.score(odd, one).collect())
