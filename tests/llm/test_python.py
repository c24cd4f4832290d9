"""Operators that SQL can't express: brute force, exact round trips, held-out accuracy."""

import collections
import math
import os
import random
import re
import time
import zlib

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import sentence
from tidegauge.llm import common, graph, lm_score, near_dedup, secrets, substring_dedup, token_counts
from tidegauge.llm.arrays import pack5, unpack5, utf8, word_hashes, word_ngrams

SF = "/root/testdata/sf0.001"


# --- arrays


def test_word_hashes_split_like_the_pattern():
    import pyarrow as pa

    rng = random.Random(1)
    texts = ["".join(rng.choice("abAB \t\n\x0b\x0c\r\x1c\x85 é漢") for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", " "]
    h, owner = word_hashes(*utf8(pa.array(texts)))
    want = [(i, w.encode().lower()) for i, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    assert owner.tolist() == [i for i, _ in want]
    names = {}
    for x, (_, w) in zip(h.tolist(), want, strict=True):
        assert names.setdefault(x, w) == w
    assert len(names) == len({w for _, w in want})
    g, o, at = word_ngrams(h, owner, 3)
    counts = collections.Counter(owner.tolist())
    assert len(g) == sum(max(1, c - 2) for c in counts.values())


def test_pack5():
    x = np.array([0, 1, (1 << 40) - 1, 123456789012], np.uint64)
    assert unpack5(pack5(x)).tolist() == x.tolist()


# --- token counts


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_edited_counts_equal_whole_counts(data):
    pattern, count = token_counts.counter(token_counts.VOCABULARY)
    bit = st.sampled_from(["a", "b", " ", "  ", "\n", "\t", "'", "s", "'ll", "1", "23", "!", "é", " x", "\n\n", "don't", "word " * 9])
    text = "".join(data.draw(st.lists(bit, max_size=150)))
    leaf, token_counts.LEAF = token_counts.LEAF, data.draw(st.sampled_from([1, 2, 4, 32]))
    try:
        tree = token_counts.TokenTree(text, pattern, count)
        for _ in range(data.draw(st.integers(1, 5))):
            a = data.draw(st.integers(0, len(text) + 2))
            b = a + data.draw(st.integers(-1, 30))
            new = "".join(data.draw(st.lists(bit, max_size=6)))
            tree.edit(a, b, new)
            s = min(a, len(text))
            text = text[:s] + new + text[max(s, min(b, len(text))) :]
            assert tree.text() == text and tree.total == sum(map(count, pattern.findall(text))) and tree.chars[1] == len(text)
    finally:
        token_counts.LEAF = leaf


def test_token_query_equals_brute_force(spark, odd, none):
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(token_counts.VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    edits = token_counts.sample_edits(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    after = dict(texts)
    for e in sorted(edits.collect(), key=lambda e: (e.doc_id, e.seq)):
        t = after[e.doc_id]
        after[e.doc_id] = t[: e.start] + e.new + t[max(e.start, e.stop) :]
    rows = token_counts.query(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_tokens, r.edited_tokens, r.n_edits, r.edited_chars) == (len(enc.encode_ordinary(texts[r.doc_id])), len(enc.encode_ordinary(after[r.doc_id])), 3, len(after[r.doc_id]))
    assert sum(r.encoded_chars for r in rows) < 0.8 * 3 * sum(r.edited_chars for r in rows)
    changes = spark.createDataFrame([(5, 1, 0, 2, "xy"), (None, 1, 0, 2, "z"), (1, None, None, None, None), (777, 1, 0, 0, "q")], "doc_id long, seq long, start long, stop long, new string")
    got = token_counts.count_with_edits(odd, changes).collect()
    assert len(got) == odd.count() and sum(r.n_edits for r in got) == 2
    assert token_counts.count_with_edits(none, changes).count() == 0


# --- secrets


def brute_spans(text):
    out = []
    for m in re.finditer(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        out += [(m.start(), m.end(), 0)] if len(m[1]) >= 6 else []
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), 2) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_base_spans_equal_brute_force(spark, odd, none):
    rng = random.Random(2)
    bits = ["password", "PassWd", "api_key", "apikey", "ſecret", "secret", "toKen", "toKen", ": ", "=", '"', "'", " ", "\n", "AKIA", "ABCDEF0123456789", "deadbeef", "0123456789abcdef", "abc", "x1Y2z3", "漢", "short"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert [s for s in secrets.scan(text) if s[2] < 3] == brute_spans(text)
    assert secrets.find_secrets(odd).count() == odd.count() and secrets.find_secrets(none).count() == 0


def test_entropy_counts_are_incremental_and_allow_list_suppresses():
    rng = random.Random(3)
    for _ in range(300):
        s = "".join(rng.choice("abcdef0123456789ABCXYZ"[: rng.randint(2, 22)]) for _ in range(rng.randint(20, 60)))
        h = [-sum(c / 20 * math.log2(c / 20) for c in collections.Counter(s[i : i + 20]).values()) for i in range(len(s) - 19)]
        hot = [i for i, x in enumerate(h) if x >= 3.5 - 1e-9]
        assert secrets.hot_span(s, 3.5) == ((hot[0], hot[-1] + 20) if hot else None)
    key = "wJalrXUtnFEMIK7MDENGbPxRfiCYzQ3v8sT1"
    assert [k for *_, k in secrets.scan(f"key {key} end")] == [3]
    assert secrets.scan("id 123e4567-e89b-12d3-a456-426614174000 path/of/many/words/in/a/row/here zzzzzzzzzzzzzzzzzzzzzzzzzzzz") == []
    assert secrets.scan(f"{key}EXAMPLE") == [] and secrets.scan("an internationalizationalismsword and 12345678901234567890123") == []


def brute_entropy(text):
    """Spans of entropy with nothing counted incrementally and no regular expressions."""
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    only = lambda s, chars: all(c in chars for c in s)

    def limit(s):
        if only(s, dig):
            return 99
        if only(s, dig + "abcdefABCDEF-"):
            return 3.2
        if only(s, low + up + "_-"):
            return 3.75 if sum(c in up for c in s) >= 4 and sum(c in low for c in s) >= 4 else 3.65
        return 3.75

    def hot(s):
        h = [-sum(c / 20 * math.log2(c / 20) for c in collections.Counter(s[i : i + 20]).values()) for i in range(len(s) - 19)]
        at = [i for i, x in enumerate(h) if x >= limit(s) - 1e-9]
        return (at[0], at[-1] + 20) if at else None

    def allowed(s):
        bits = s.split("-")
        if [len(b) for b in bits] == [8, 4, 4, 4, 12] and only(s, dig + "abcdefABCDEF-"):
            return True
        if any(w in s for w in ("EXAMPLE", "example", "PLACEHOLDER", "placeholder", "CHANGEME", "changeme", "0123456789", "abcdefghij", "ABCDEFGHIJ")):
            return True
        return only(s, low + up + "_/=+-") and s[0] in low + up and any(c in "_/=+-" for c in s) or len(set(s)) == 1

    out, i = [], 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] in low + up + dig + "+/_=-":
            j += 1
        s = text[i:j]
        if len(s) >= 20 and (span := hot(s)):
            for c in "/+=_":
                parts = s.replace(c, "-") if c == "/" else parts.replace(c, "-")
            parts = [p for p in parts.split("-") if 20 <= len(p) < len(s)]
            if not allowed(s) or any(hot(p) and not allowed(p) for p in parts):
                out.append((i + span[0], i + span[1], 3))
        i = max(j, i + 1)
    return out


def test_secret_query_equals_brute_force(spark, tables):
    import hashlib

    for d, docs in ((SF, None), (tables, None)):
        docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
        want = collections.Counter()
        name = lambda spans: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, b, k in spans)
        for r in docs:
            base = brute_spans(r.text or "")
            every = sorted(base + brute_entropy(r.text or ""), key=lambda x: (x[0], x[2], x[1]))
            want[(r.doc_id, *(sum(k == x for *_, x in base) for k in range(3)), hashlib.sha256(name(base).encode()).hexdigest(), name(every))] += 1
        got = secrets.query(spark, d).collect()
        assert collections.Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in got) == want


def test_entropy_spans_equal_brute_force_on_random_candidates():
    rng = random.Random(21)
    bits = ["example", "_", "-", "=", "/", "+", "key", "0123456789", "wJalrXUtnFEMIK7MDENG", "bPxRfiCYzQ3v8sT1kLm9", "QwErTyUiOpAsDfGhJkLzXcVb", "deadbeefcafe", "AAAA", " ", "12345678-9abc-def0-1234-56789abcdef0", "Kraftfahrzeughaftpflicht"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 6)))
        assert [s for s in secrets.scan(text) if s[2] == 3] == brute_entropy(text), text


def test_entropy_finds_random_strings_of_each_class():
    import string

    rng = random.Random(22)
    for chars, n, least in (("0123456789abcdef", 32, 0.97), (string.ascii_letters + string.digits, 32, 0.99), (string.ascii_letters + string.digits, 20, 0.93), (string.ascii_letters, 32, 0.99), (string.ascii_letters, 24, 0.93), (string.ascii_lowercase, 32, 0.88), (string.ascii_lowercase, 24, 0.68)):
        drawn = ["".join(rng.choice(chars) for _ in range(n)) for _ in range(1000)]
        assert sum(bool(secrets.scan(f"see {s} end")) for s in drawn) >= 1000 * least, (chars, n)


# --- language model


def brute_ppm(train):
    top = lm_score.ORDER
    seen = [collections.defaultdict(collections.Counter) for _ in range(top + 1)]
    for b in train:
        s = b"\0" * top + b + b"\0"
        for i in range(top, len(s)):
            for k in range(top + 1):
                seen[k][s[i - k : i]][s[i]] += 1

    def score(b):
        s, total = b"\0" * top + b + b"\0", 0.0
        for i in range(top, len(s)):
            out = set()
            for k in range(top, -1, -1):
                counts = seen[k].get(s[i - k : i])
                if not counts:
                    continue
                rest = {x: n for x, n in counts.items() if x not in out}
                n, d = sum(rest.values()), len(rest)
                if s[i] in rest:
                    total += math.log10(rest[s[i]] / (n + d))
                    break
                total += math.log10(d / (n + d)) if d else 0.0
                out |= set(counts)
            else:
                total -= math.log10(256 - len(out))
        return total

    return score


@pytest.mark.parametrize("which", ["odd", "table"])
def test_scores_equal_brute_force(spark, odd, which):
    docs = odd if which == "odd" else spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 3000")
    rows = [(r.doc_id, (r.text or "").encode().lower()) for r in docs.select("doc_id", "text").collect()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    train = [b for i, b in rows if not held(i)]
    score = brute_ppm(train)
    counts = collections.Counter(w for b in train for w in [*b.split(), None])
    n, v = sum(counts.values()), len(counts)
    want = collections.Counter()
    for i, b in rows:
        words = [*b.split(), None]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        want[(i, held(i), len(words), sum(counts[w] > 0 for w in words), n, round(base, 5), round(score(b), 5))] += 1
    got = collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in lm_score.score(docs).collect())
    assert got == want


def test_context_helps_on_held_out_texts(spark, none):
    rows = lm_score.query(spark, "/root/testdata/sf0.001").filter("held_out").collect()
    size = sum(len(r.text.encode()) + 1 for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.doc_id in {x.doc_id for x in rows})
    assert -sum(r.score for r in rows) / math.log10(2) / size < 3.0  # bits a byte; order 0 needs over 4
    assert lm_score.score(none).count() == 0


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    text = rng.integers(97, 101, 400).astype(np.uint8)
    num, _ = lm_score.grams(text, np.array([0, 400]))
    keys, n = np.unique(num, return_counts=True)
    pairs = np.bincount(num & 0xFFFF, minlength=1 << 16)
    for context in (int(keys[7]) >> 8, int.from_bytes(b"zzzz", "big"), int.from_bytes(b"zabc", "big"), int.from_bytes(b"zzza", "big")):
        ask = (context << 8) + np.arange(256)
        every = np.union1d(keys[((keys >> 8) & 0xFFFF) == (context & 0xFFFF)], ask)
        have = np.zeros(len(every))
        have[np.isin(every, keys)] = n[np.searchsorted(keys, every[np.isin(every, keys)])]
        p = 10 ** lm_score.log_probs(every, have, pairs)[np.isin(every, ask)]
        assert math.isclose(p.sum(), 1.0, rel_tol=1e-9)


# --- near duplicates


def brute_classes(rows, least=0.8):
    texts, order = {}, lambda i: (i is None, i or 0)
    for i, t in rows:
        texts.setdefault(t or "", []).append(i)
    bags = {t: collections.Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4)) if w) for t in texts for w in [t.encode().lower().split()]}
    df = collections.Counter(s for b in bags.values() for s in b)
    n = len(texts)
    weight = {s: 1 + math.log1p(n / d) / math.log1p(n) for s, d in df.items()}
    at = collections.defaultdict(list)
    for t, b in bags.items():
        for s in b:
            at[s].append(t)
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for a, b in {(x, y) for ts in at.values() for x in ts for y in ts if x < y}:
        both = sum(min(bags[a][s], bags[b][s]) * weight[s] for s in bags[a].keys() & bags[b].keys())
        every = sum(c * weight[s] for x in (a, b) for s, c in bags[x].items()) - both
        if both / every >= least:
            root[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for t, ids in texts.items():
        groups[find(t)] += ids
    return {(i, t): min(groups[find(t)], key=order) for t, ids in texts.items() for i in ids}


def edited(rng, text, n):
    w = text.split()
    for k in rng.sample(range(len(w)), n):
        w[k] = "edit" + str(rng.randint(0, 9**9))
    return " ".join(w)


def test_near_classes_equal_brute_force(spark, odd, none):
    rng = random.Random(4)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for g in range(12):
        base = sentence(rng, rng.choice([6, 30, 150, 400]))
        rows += [(100 + 20 * g + k, edited(rng, base, min(k % 6, len(base.split())))) for k in range(15)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(rows)
    got = near_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    want = collections.Counter((i, want[i, t or ""]) for i, t in rows)
    wrong = collections.Counter((r.doc_id, r.class_id) for r in got) - want
    assert wrong.total() <= 2, wrong  # a pair just at 0.8 may share no band
    assert near_dedup.near_duplicates(none).count() == 0
    assert near_dedup.near_duplicates(odd).count() == odd.count()


def test_rows_that_share_an_id_link_nothing_by_it(spark):
    rng = random.Random(5)
    a, b, c, d = (sentence(rng, 50) for _ in range(4))
    rows = [(5, a), (9, b), (7, a), (7, b), (8, c), (None, a), (None, b), (None, d), (None, d + " x"), (None, c.upper() + " x"), (8, c)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter((r.doc_id, r.class_id) for r in got) == collections.Counter([(5, 5), (7, 5), (None, 5), (9, 7), (7, 7), (None, 7), (8, 8), (8, 8), (None, 8), (None, None), (None, None)])
    assert len({r.class_key for r in got}) == 4 and len({r.class_key for r in got if r.class_id is None}) == 1


def test_merged_regions_give_the_same_signatures_and_scores(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = docs.select(near_dedup.F.col("doc_id").alias("node"), near_dedup.F.coalesce("text", near_dedup.F.lit("")).alias("text"))
    none = rows.select("node").limit(0)
    plain, tree = (near_dedup.signatures(rows, none, 200, block_bytes=20_000, fan=n).toPandas().sort_values("node", ignore_index=True) for n in (10**6, 3))
    assert len(plain) == len(tree) and all((plain[c].map(str) == tree[c].map(str)).all() for c in plain)
    plain, tree = (sorted(map(tuple, lm_score.score(docs, block_bytes=20_000, fan=n).collect())) for n in (10**6, 3))
    assert len(plain) == len(tree) and all(x[:5] == y[:5] and all(math.isclose(p, q, rel_tol=1e-9) for p, q in zip(x[5:], y[5:], strict=True)) for x, y in zip(plain, tree, strict=True))


def shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {name: os.path.getsize(f"{d}/{name}") for top in folders for d, _, names in os.walk(top.getPath()) for name in names if re.match(r"shuffle_.*\.data$", name) and os.path.exists(f"{d}/{name}")}


def test_kept_rows_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    counted = spark.range(10_000).groupBy((F.col("id") % 7).alias("k")).count()
    kept = [common.checkpointed(counted), common.kept_table(counted), common.checkpointed(counted)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    found = near_dedup.signatures(docs, docs.select("node").limit(0), 1000, fan=3, block_bytes=20_000)
    assert "FlatMapGroupsInArrow" not in found._jdf.queryExecution().toString()  # the questions have been answered by now
    kept.append(common.kept_table(found))
    for _ in range(50):  # they go in the background
        left = sum(n for name, n in shuffle_files(spark).items() if name not in before)
        if left < 1000:
            break
        time.sleep(0.1)
    assert left < 1000  # that of sums which were collected
    assert all({tuple(r) for r in x.collect()} == {(k, 1429 - (k > 3)) for k in range(7)} for x in kept[:3])
    assert kept[3].count() == docs.count()


def test_samples_agree_as_often_as_the_similarity():
    rng = np.random.default_rng(1)
    hits, total = 0.0, 0
    for _ in range(30):
        shared, a, b = (rng.integers(0, 1 << 63, k).astype(np.uint64) for k in (240, 30, 30))
        h, owner = np.concatenate([shared, a, shared, b]), np.repeat([0, 1], 270)
        s = near_dedup.samples(h, np.full(540, 2.0), owner, 2)
        hits, total = hits + (s[0] == s[1]).sum(), total + s.shape[1]
    assert abs(hits / total - 240 / 300) < 0.03
    one = near_dedup.samples(np.array([7], np.uint64), np.array([2.0]), np.array([1]), 3)
    assert (one[1] != 0).all() and (one[[0, 2]] == 0).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (102, 102), (200, 150), (200, 175)]
    got = {r.node: r.comp for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 150: 150, 175: 150, 200: 150}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- substring dedup


def brute_covered(rows, least=50):
    seen, want = {}, {}
    for i, t in rows:
        w = t.encode().lower().split()
        held = set()
        for j in range(len(w) - least + 1):
            k = tuple(w[j : j + least])
            if seen.setdefault(k, i) != i:
                held |= set(range(j, j + least))
        want[i] = held
    return want


def test_exact_passages_are_covered(spark):
    rng = random.Random(6)
    shared = [sentence(rng, n) for n in (55, 70, 300)]
    rows = []
    for i in range(60):
        parts = [sentence(rng, rng.randint(0, 120))]
        for p in rng.sample(shared, rng.randint(0, 2)):
            parts += [p, sentence(rng, rng.randint(0, 60))]
        rows.append((i, " ".join(parts)))
    rows.append((60, ("line again and again " * 5 + "\n") * 30))
    rows.append((61, ("line again and again " * 5 + "\n") * 25))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    covered = collections.defaultdict(set)
    for r in substring_dedup.repeated_passages(df).collect():
        covered[r.doc_id] |= set(range(r.start, r.stop))
        assert r.stop - r.start >= 50 and r.first_doc_id < r.doc_id
    want = brute_covered(rows)
    for i, held in want.items():
        assert held <= covered[i]
        if not held:
            assert not covered[i]


def test_fuzzy_passages_and_awkward_rows(spark, odd, none):
    rng = random.Random(7)
    base = sentence(rng, 90)
    w = edited(rng, base, 6).split()
    del w[40]
    w[70:70] = ["two", "more"]
    df = spark.createDataFrame([(1, sentence(rng, 50) + " " + base), (2, sentence(rng, 80) + " " + " ".join(w) + " " + sentence(rng, 30)), (3, sentence(rng, 300))], "doc_id long, text string")
    got = substring_dedup.repeated_passages(df).collect()
    assert {(r.doc_id, r.first_doc_id) for r in got} == {(2, 1)} and max(r.stop - r.start for r in got) >= 70
    got = {(r.doc_id, r.first_doc_id) for r in substring_dedup.repeated_passages(odd).collect()}
    assert got == {(4, None), (5, None), (9, None)}
    assert substring_dedup.repeated_passages(none).count() == 0


def test_long_shifted_documents_align():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 60, 6000).astype(np.uint64)
    b = np.concatenate([a[:2000], a[2003:4000], rng.integers(0, 1 << 60, 5).astype(np.uint64), a[4000:]])
    found = substring_dedup.passages(b, a, 0, 0, 1, 50)
    assert sum(e - s for s, e, *_ in found) >= 0.98 * len(b)
    same = np.tile(np.arange(3, dtype=np.uint64), 2000)
    assert sum(e - s for s, e, *_ in substring_dedup.passages(same[:5990], same, 0, 0, 1, 50)) >= 5900


def test_minimizers_of_shared_runs_meet():
    rng = np.random.default_rng(3)
    for _ in range(50):
        run = rng.integers(0, 1 << 60, substring_dedup.K + substring_dedup.WINDOW - 1).astype(np.uint64)
        kept = []
        for _ in range(2):
            h = np.concatenate([rng.integers(0, 1 << 60, rng.integers(0, 60)).astype(np.uint64), run, rng.integers(0, 1 << 60, rng.integers(0, 60)).astype(np.uint64)])
            g, o, at = word_ngrams(h, np.zeros(len(h), np.int64), substring_dedup.K, short=False)
            kept.append(set(g[substring_dedup.minimizers(g, o, at)].tolist()))
        assert kept[0] & kept[1]


def test_short_equal_line_beside_a_longer_fuzzy_passage():
    rng = np.random.default_rng(4)
    draw = lambda n: rng.integers(0, 1 << 60, n).astype(np.uint64)
    line, fuzzy = draw(45), draw(60)
    changed = fuzzy.copy()
    changed[[5, 15, 25, 35, 45, 55]] = draw(6)
    a, b = np.concatenate([line, draw(16), fuzzy]), np.concatenate([line, draw(16), changed])
    assert substring_dedup.passages(b, a, 100, 200, 0, 50) == [(161, 221, 261, 54)]
    tail = fuzzy.copy()
    tail[42:58] = np.where(np.arange(42, 58) % 4 < 3, draw(16), fuzzy[42:58])  # 48 of 60 the same
    assert (tail == fuzzy).mean() == 0.8
    assert substring_dedup.passages(tail, fuzzy, 0, 0, 0, 50) == [(0, 60, 0, 48)]


def test_rows_that_share_an_id_are_searched_by_their_own_texts(spark):
    rng = random.Random(11)
    x, y = sentence(rng, 70), sentence(rng, 70)
    df = spark.createDataFrame([(None, x), (None, y), (5, x), (9, y), (7, sentence(rng, 60)), (7, y)], "doc_id long, text string")
    got = {(r.doc_id, r.first_doc_id, r.start, r.stop) for r in substring_dedup.repeated_passages(df).collect()}
    assert got == {(5, None, 0, 70), (9, None, 0, 70), (7, None, 0, 70)}


def test_whole_copies_meet_though_their_pieces_lie_in_earlier_documents(spark):
    rng = random.Random(13)
    early, late, want = [], [], {}
    for n, parts in [(60, 2), (60, 3), (100, 5)] * 12:
        words = sentence(rng, n).split()
        k = n // parts
        early += [sentence(rng, 40) + " " + " ".join(words[i : i + k]) + " " + sentence(rng, 40) for i in range(0, n, k)]
        for _ in range(2):
            late.append((sentence(rng, 30) + " " + " ".join(words) + " " + sentence(rng, 30), n))
    rows = list(enumerate(early + [t for t, _ in late]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    covered = collections.defaultdict(set)
    for r in substring_dedup.repeated_passages(df).collect():
        covered[r.doc_id] |= set(range(r.start, r.stop))
    for j, (_, n) in enumerate(late):
        assert len(covered[len(early) + j]) == (n if j % 2 else 0), (j, n)


@pytest.mark.parametrize("share", [0.1, 0.15, 0.2])
def test_substituted_passages_are_found(spark, share):
    rng = random.Random(14)
    rows = []
    for i in range(40):
        base = sentence(rng, 60)
        at = (lambda w: [w[k] if (k + 1) % 5 else f"edit{k}" for k in range(60)])(base.split()) if share == 0.2 and i % 2 else edited(rng, base, int(60 * share)).split()
        rows += [(i, sentence(rng, 70) + " " + base + " " + sentence(rng, 70)), (100 + i, sentence(rng, 80) + " " + " ".join(at) + " " + sentence(rng, 20))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id - 100 for r in substring_dedup.repeated_passages(df).collect() if r.first_doc_id == r.doc_id - 100 and r.start <= 95 and r.stop >= 125}
    assert len(found) >= (38 if share == 0.2 else 40)


def mosaic(rng, piece, share, gaps, n, words=60):
    """[(early, whole, again, copy)] of n passages: documents with its pieces, one with all of it, documents with its
    pieces again, and one with a copy in which a share of words is replaced and another one is left out or put in."""
    out = []
    for _ in range(n):
        base = sentence(rng, words)
        w = base.split()
        parts = lambda: [f"{sentence(rng, 40)} {' '.join(w[k : k + piece])} {sentence(rng, 40)}" for k in range(0, words, piece)]  # noqa: B023, E731
        e = edited(rng, base, round(share * words)).split()
        for k in sorted(rng.sample(range(words), round(gaps * words)), reverse=True):
            e[k : k + rng.randint(0, 1)] = [] if rng.random() < 0.5 else [sentence(rng, 1), e[k]][:2]
        out.append((parts(), f"{sentence(rng, 50)} {base} {sentence(rng, 50)}", parts(), f"{sentence(rng, 30)} {' '.join(e)} {sentence(rng, 30)}"))
    return out


def test_fuzzy_copies_meet_the_whole_though_its_pieces_lie_before_and_after(spark):
    rng = random.Random(15)
    kinds = [(p, s, g) for p in (10, 20, 30) for s, g in ((0.1, 0), (0.15, 0), (0.2, 0), (0, 0.05), (0, 0.1))]
    each = {k: mosaic(rng, *k, n=40) for k in kinds}
    rows = [(1_000_000 * t + 1000 * j + 10 * i + c, text) for j, k in enumerate(kinds) for i, one in enumerate(each[k]) for t, part in enumerate(one) for c, text in enumerate([part] if isinstance(part, str) else part)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.first_doc_id) for r in substring_dedup.repeated_passages(df).collect()}
    for j, k in enumerate(kinds):
        got = sum((3_000_000 + 1000 * j + 10 * i, 1_000_000 + 1000 * j + 10 * i) in found for i in range(40))
        assert got >= 36, (k, got)


def local_scores(b, others):
    """Best local alignment (match 1, else -1) of the words b with each of the padded rows of others."""
    cols = np.arange(others.shape[1] + 1)
    row, best = np.zeros((len(others), len(cols)), int), np.zeros(len(others), int)
    for w in b:
        new = np.maximum(row - 1, 0)
        new[:, 1:] = np.maximum(new[:, 1:], row[:, :-1] + np.where(others == w, 1, -1))
        row = np.maximum.accumulate(new + cols, 1) - cols
        best = np.maximum(best, row.max(1))
    return best


def test_partners_equal_brute_force_local_alignment(spark):
    rng = random.Random(16)
    texts = [t for k in ((15, 0.1, 0), (20, 0.1, 0.05), (30, 0.15, 0)) for early, whole, again, copy in mosaic(rng, *k, n=9) for t in (*early, whole, *again, copy)]
    texts += [sentence(rng, rng.randint(1, 140)) for _ in range(300 - len(texts))]
    rng.shuffle(texts)
    number = {}
    coded = [[number.setdefault(w, len(number)) for w in t.split()] for t in texts]
    width = max(map(len, coded))
    padded = np.array([c + [-1] * (width - len(c)) for c in coded])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = collections.defaultdict(set)
    for r in substring_dedup.repeated_passages(df).collect():
        found[r.doc_id].add(r.first_doc_id)
    wanted = missed = 0
    for i in range(1, len(texts)):
        score = local_scores(coded[i], padded[:i])
        assert all(score[j] >= 25 for j in found[i])
        wanted += (score >= 36).any()  # a piece of 30 words, too short for a passage, scores little more than 30
        missed += (score >= 36).any() and not any(score[j] >= 36 for j in found[i])
    assert wanted >= 20 and missed <= wanted // 10


def test_seeds_of_a_short_line_stay_apart_and_those_of_a_fuzzy_passage_meet():
    """A line of ten words can't be a passage of fifty; with one bit a word nearly half of its seeds met by chance."""
    rng = np.random.default_rng(17)
    draw = lambda n: rng.integers(0, 1 << 60, n).astype(np.uint64)

    def met_share(shared, changed, inner):
        near = []
        for _ in range(300):
            line = draw(shared)
            copy = np.where(np.arange(shared) % 5 == 4, draw(shared), line) if changed else line
            x, y = (np.concatenate([draw(40), t, draw(40)]) for t in (line, copy))
            at = np.array([40 + k for k in range(inner[0], inner[1]) if (x[40 + k : 44 + k] == y[40 + k : 44 + k]).all()])
            near.append(substring_dedup.alike(substring_dedup.surroundings(x)[at], substring_dedup.surroundings(y)[at]).mean())
        return np.mean(near)

    assert met_share(10, False, (0, 7)) < 0.2
    assert met_share(60, True, (0, 57)) > 0.97


def test_exact_way_meets_every_pair_of_occurrences(spark, monkeypatch):
    rng = np.random.default_rng(18)
    key, node, pos = rng.integers(0, 9, 200), rng.integers(0, 30, 200), np.arange(200)
    want = sorted((node[i], node[j], pos[i], pos[j]) for i in range(200) for j in range(200) if key[i] == key[j] and node[j] < node[i])
    monkeypatch.setattr(substring_dedup, "PAIRS", 50)
    batches = list(substring_dedup.all_met(key, node, pos))
    assert sorted(x for batch in batches for x in zip(*batch[:4], strict=True)) == want
    assert len(batches) > 3 and max(len(x[0]) for x in batches) <= 200
    text = random.Random(19)
    shared = sentence(text, 55)
    df = spark.createDataFrame([(i, f"{sentence(text, 20 + 3 * i)} {shared} {sentence(text, 90 - 5 * i)}") for i in range(10)], "doc_id long, text string")
    every = {(r.doc_id, r.first_doc_id) for r in substring_dedup.repeated_passages(df, exact=True).collect()}
    assert every == {(i, j) for i in range(10) for j in range(i)}
    assert {(r.doc_id, r.first_doc_id) for r in substring_dedup.repeated_passages(df).collect()} <= every
