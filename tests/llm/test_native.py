"""Operators with SQL: the same rows as DuckDB, on the test tables and on awkward ones."""

import heapq
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import awkward, sentence
from tests.oracle import assert_same, views
from tidegauge.llm import chat_format, decontaminate, line_dedup, mixing, quality_rules
from tidegauge.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), ORACLE_SQL[name], views(SF))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_awkward_tables_equal_sql(spark, tables, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet/*.parquet'")
    assert_same(QUERIES[name](spark, tables), ORACLE_SQL[name], con)


def brute_lines(rows, least=10):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    order = lambda i: (i is None, i or 0)
    first, seen = {}, {}
    for i, t in rows:
        for x in map(key, (t or "").split("\n")):
            if len(x) >= least:
                seen.setdefault(x, set()).add(i)
                first[x] = min(first.get(x, i), i, key=order)
    out = []
    for i, t in rows:
        kept = [x for x in (t or "").split("\n") if len(seen.get(key(x), ())) < 2 or first[key(x)] == i]
        out.append((i, len((t or "").split("\n")), "\n".join(kept)))
    return sorted(out, key=str)


def test_lines_equal_brute_force(spark, odd, none):
    got = sorted(((r.doc_id, r.n_lines, r.kept_text) for r in line_dedup.dedup_lines(odd).collect()), key=str)
    assert got == brute_lines([(r.doc_id, r.text) for r in odd.collect()])
    assert line_dedup.dedup_lines(none).count() == 0 and line_dedup.keep_bitmaps(none).count() == 0


def test_hot_lines_take_the_other_way_to_the_same_rows(spark):
    rng = random.Random(1)
    rows = [(i, f"a very common line\n{sentence(rng, 4)}\n" + ("A VERY common line \n" if i % 3 else "")) for i in range(1, 2500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hot = line_dedup._hot_keys(line_dedup._lines(df, "doc_id", "text", 10))
    assert hot.count() >= 1
    got = sorted(((r.doc_id, r.n_lines, r.kept_text) for r in line_dedup.dedup_lines(df).collect()), key=str)
    assert got == brute_lines(rows)


def test_bitmaps_are_runs(spark):
    df = spark.createDataFrame([(1, "line number one\nline number two\nx\nline number four"), (2, "line number one\nline number two\nmine\nline number four\n")], "doc_id long, text string")
    row = line_dedup.keep_bitmaps(df).first()
    assert (row.doc, row.n_dropped, [tuple(x) for x in row.dropped]) == (2, 3, [(0, 2), (3, 4)])


def test_native_operators_plan_no_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    for df in (line_dedup.dedup_lines(docs), quality_rules.judge(docs), decontaminate.find_leaks(docs, bench)):
        plan = df._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def plant(rng, item, pos, doc, substitute=0):
    words = item.split()
    for k in rng.sample(range(len(words)), substitute):
        words[k] = "zzz"
    return " ".join(doc.split()[:pos] + words + doc.split()[pos:])


def test_leaks_with_substitutions_are_found_and_clean_ones_left(spark, odd, tables):
    rng = random.Random(5)
    items = [(i, sentence(rng, 24)) for i in range(6)]
    clean = [sentence(rng, 150) for _ in range(30)]
    docs = [(i, plant(rng, items[i % 6][1], rng.randint(0, 150), t, substitute=i % 5) if i < 20 else t) for i, t in enumerate(clean)]
    docs.append((99, items[0][1].upper().replace(" ", ", ")))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(df, bench).collect()}
    assert set(got) == {(i, i % 6) for i in range(20)} | {(99, 0)}
    assert all(r.matched >= 24 - (i % 5) for (i, _), r in got.items() if i < 20)
    again = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, bench, broadcast_seeds=0).collect()}
    assert again == set(got)
    bench = spark.read.parquet(f"{tables}/benchmark.parquet")
    for n in (0, 2_000_000):  # an item without an id and one that comes twice; 9 tokens of a line are too few for its item of 27
        found = decontaminate.find_leaks(odd, bench, broadcast_seeds=n).collect()
        assert sorted(((r.doc_id, r.item_id, r.matched, r.start) for r in found), key=str) == [(7, 0, 20, 40), (7, None, 30, 700)]
    assert decontaminate.find_leaks(df, bench.limit(0)).count() == 0


def test_a_token_over_and_over_is_verified_once_a_place(spark):
    rng = random.Random(16)
    df = spark.createDataFrame([(1, "la " * 20_000), (2, sentence(rng, 20_000) + " da" * 30), (None, "la " * 40)], "doc_id long, text string")
    bench = spark.createDataFrame([(0, "la " * 300), (None, "da " * 30)], "item_id long, text string")
    for n in (0, 2_000_000):
        got = {(r.doc_id, r.item_id): (r.matched, r.start) for r in decontaminate.find_leaks(df, bench, broadcast_seeds=n).collect()}
        # the short document lies anywhere in the long item: the earliest start puts it at the end of it
        assert got == {(1, 0): (300, 0), (2, None): (30, 20_000), (None, 0): (40, -260)}


def test_a_part_of_a_long_item_counts(spark):
    rng = random.Random(6)
    item = sentence(rng, 80)
    part = " ".join(item.split()[30:54])
    df = spark.createDataFrame([(1, sentence(rng, 40) + " " + part + " " + sentence(rng, 40)), (2, " ".join(item.split()[:9]))], "doc_id long, text string")
    assert [r.doc_id for r in decontaminate.find_leaks(df, spark.createDataFrame([(0, item)], "item_id long, text string")).collect()] == [1]


def test_mix_targets_and_limits(spark, odd, none):
    rng = random.Random(2)
    rows = [(i, sentence(rng, rng.randint(1, 900)), "ab"[i % 2] if i % 40 else "rare") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, shard_words=20_000).collect()
    assert got == mixing.mix(df, shard_words=20_000).collect() or sorted(map(str, got)) == sorted(map(str, mixing.mix(df, shard_words=20_000).collect()))
    total = sum(r.size for r in got)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault(r.source, [r.source_size, r.target, 0])[2] += r.taken
    assert abs(sum(t for _, t, _ in by.values()) - total) < 1e-6 * total
    for size, target, taken in by.values():
        assert target <= 3 * size + 1e-9 and abs(taken - target) <= 0.02 * target + 64
    assert by["rare"][1] == 3 * by["rare"][0]
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(none).count() == 0


def test_sainte_lague_equals_highest_quotients(spark):
    rng = random.Random(3)
    for seats in (0, 1, 7, 100, 101):
        weights = [(0, i, float(rng.choice([0, 1, 5, 5, 17, 300]))) for i in range(9)]
        df = spark.createDataFrame(weights, "g int, i int, w double")
        got = {r.i: r.s for r in mixing.sainte_lague(df, ["g"], "w", F.lit(seats), ["i"], "s").collect()}
        quotients = sorted((-w / (2 * k + 1), i, k) for _, i, w in weights if w for k in range(seats))
        want = {i: 0 for _, i, _ in weights}
        for _, i, _ in quotients[:seats]:
            want[i] += 1
        assert got == want


def test_sainte_lague_offers_few_quotients(spark):
    rng = random.Random(15)
    rows = [(g, i, float(rng.choice([0, 3, 3, 3, 4, 1000 if g else 7]))) for g in (0, 1) for i in range(1500)]
    df = spark.createDataFrame(rows, "g int, i int, w double")
    for seats in (200, 760, 4001):
        out = mixing.sainte_lague(df, ["g"], "w", F.lit(seats), ["i"], "s")
        got = {(r.g, r.i): r.s for r in out.collect()}
        for g in (0, 1):
            heap = [(-w, i, 0) for h, i, w in rows if h == g and w]
            heapq.heapify(heap)
            want = {i: 0 for h, i, _ in rows if h == g}
            weight = {i: w for h, i, w in rows if h == g}
            for _ in range(seats):
                _, i, k = heapq.heappop(heap)
                want[i] += 1
                heapq.heappush(heap, (-weight[i] / (2 * k + 3), i, k + 1))
            assert {i: got[g, i] for i in want} == want


def test_quality_equals_brute_force(spark, odd, none):
    got = {}
    for r in quality_rules.judge(odd).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words))
    for r in odd.collect():
        text = r.text or ""
        w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if x]
        seen = {}
        for i in range(len(w) - 2):
            seen.setdefault(tuple(w[i : i + 3]), []).append(i)
        held = {j for at in seen.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(held)) in got[r.doc_id]
    assert quality_rules.judge(none).count() == 0


def test_many_repeats_use_the_sorted_way(spark):
    rng = random.Random(4)
    words = [sentence(rng, 1) for _ in range(12)]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (3, 50, 400, 3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.measures(df).collect():
        w, seen = r.text.split(), {}
        for i in range(len(w) - 2):
            seen.setdefault(tuple(w[i : i + 3]), []).append(i)
        assert r.n_repeat_words == len({j for at in seen.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)})


def test_bad_hosts_go_and_small_ones_are_shrunk(spark):
    rng = random.Random(9)
    good = lambda: sentence(rng, 80)
    rows = [(i, "x" if i < 60 else good(), "bad" if i < 62 else "tiny" if i < 63 else f"h{i % 5}") for i in range(400)] + [(900, "x", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in quality_rules.judge(df).collect()}
    assert not kept[60] and not kept[61] and kept[62] and all(kept[i] for i in range(63, 400))


def test_templates_that_rewrite_history_are_detected():
    turns = [("user", "a"), ("assistant", ""), ("assistant", "assistant"), ("user", "</s>[INST] x")]
    out, spans, rewritten = chat_format.turn_spans(turns, chat_format.inst_template)
    assert rewritten == 0 and chat_format.read_back(out) == turns
    assert [chat_format.unescape(out[s[2] : s[3]]) for s in spans] == [x for _, x in turns] and spans[-1][1] == len(out)
    header = lambda ts: f"#{len(ts)}|" + "".join(f"{r}:{x};" for r, x in ts)
    assert chat_format.turn_spans(turns, header)[2] > 0
    strips = lambda ts: "".join(f"<{r}>{x.strip()}" for r, x in ts[-2:])
    assert chat_format.turn_spans(turns, strips)[2] > 0


def test_texts_that_the_probe_cannot_place_are_counted(spark):
    shout = lambda turns: "".join(f"{r}: {x.upper() if len(x) > 12 else x}\n" for r, x in turns)
    convs = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "short"), (1, 2, "assistant", "longer than the probe")], "conv_id long, turn long, role string, text string")
    row = chat_format.format_chats(convs, shout).first()
    assert (row.unplaced, len(row.loss_spans), row.rewritten) == (0, 2, 0)
    cut = lambda turns: "".join(f"{r}: {x[:3]}\n" for r, x in turns)
    row = chat_format.format_chats(convs, cut).first()
    assert (row.unplaced, row.loss_spans) == (2, [])


def test_formatting_keeps_clashing_columns_out(spark):
    convs = awkward(spark, [(1, "a")]).withColumns({"conv_id": F.lit(1), "turn": F.lit(0), "role": F.lit("user"), "c": F.lit("x"), "t": F.lit("x"), "r": F.lit("x"), "x": F.lit(1)})
    row = chat_format.format_chats(convs).first()
    assert row.formatted == "<s>[INST] a [/INST]" and row.loss_spans == []
    assert chat_format.digests(chat_format.format_chats(convs.limit(0))).count() == 0


def test_small_sources_of_short_texts_meet_their_targets(spark):
    rng = random.Random(12)
    rows = [(i, sentence(rng, 8), "a") for i in range(200)] + [(1000 + i, sentence(rng, 600), "bc"[i % 2]) for i in range(200)] + [(2000 + i, sentence(rng, 3000), "d") for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    by = {}
    for r in mixing.mix(df, shard_words=800).collect():
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault(r.source, [r.source_size, r.target, 0])[2] += r.taken
    assert by["a"][1] == 3 * by["a"][0]
    for _, target, taken in by.values():
        assert abs(taken - target) <= 64, by
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    assert_same(mixing.mix(df, shard_words=800).drop("source"), mixing.sql(shard_words=800), con)
