import collections
import random

import corpus_pipeline as P
from tests.llm.conftest import SCHEMA, sentence
from tests.llm.test_native import brute_lines, plant
from tests.llm.test_python import brute_classes, edited
from tidegauge.llm.queries import QUERIES


def test_run_equals_brute_force_and_decisions_take_effect(spark, tmp_path):
    rng = random.Random(8)
    items = [(i, sentence(rng, 26)) for i in range(4)]
    rows = {}
    for i in range(80):
        rows[i] = sentence(rng, 15 if i % 20 == 3 else 90) + "\n" + sentence(rng, 30)
    for i in range(80, 90):
        rows[i] = edited(rng, rows[i - 80], 2).replace("edit", "\nedit", 1)
    rows[90] = "word word word " * 40
    for i in range(91, 95):
        rows[i] = plant(rng, items[i % 4][1], 20, sentence(rng, 80), 2)
    for i in (95, 96):
        rows[i] = "a line that comes twice in all\n" + sentence(rng, 70)
    rows[97], rows[98] = None, ""
    d = str(tmp_path)
    full = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in rows.items()]
    spark.createDataFrame(full, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")

    kept = {}
    for i, t in rows.items():
        w = (t or "").split()
        seen = collections.defaultdict(list)
        for j in range(len(w) - 2):
            seen[tuple(w[j : j + 3])].append(j)
        held = {k for at in seen.values() if len(at) > 1 for j in at for k in (j, j + 1, j + 2)}
        if len(w) >= 50 and 2 * len(held) <= len(w):
            kept[i] = t
    kept = {i: t for i, _, t in brute_lines(list(kept.items())) if t.strip()}
    classes = brute_classes(list(kept.items()))
    kept = {i: t for i, t in kept.items() if classes[i, t] == i}
    kept = {i: t for i, t in kept.items() if not 91 <= i < 95}

    out = P.run(spark, d).collect()
    assert {r.doc_id: r.size for r in out} == {i: len(t.split()) for i, t in kept.items()}
    assert not {3, 23, 90, 91, 97, 98} & {r.doc_id for r in out}
    total = sum(r.size for r in out)
    assert abs(sum(r.taken for r in out) - total) <= 64 * 3


def test_stages_return_the_columns_of_documents_and_take_awkward_rows(spark, tables, odd):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, tables)
        assert tuple(docs.columns) == P.COLUMNS, name
        assert stage(spark, docs.limit(0), tables).count() == 0
    kept = {r.doc_id: r for r in docs.collect()}
    assert set(kept) <= {None, 4, 5, 8, 9, 10} and 8 in kept and 10 in kept  # document 7 holds benchmark items
    assert sum(r.doc_id == 5 for r in docs.collect()) <= 1
    assert P.mix_stage(spark, docs, tables).count() == docs.count()


def test_every_query_takes_awkward_tables(spark, tables):
    for name, query in QUERIES.items():
        assert query(spark, tables).count() >= 0, name


def test_rows_that_share_an_id_stay_for_their_own_texts(spark, tmp_path):
    rng = random.Random(9)
    x, y, z, leak = (sentence(rng, 80) for _ in range(4))
    rows = [(None, x), (None, y), (5, x), (9, y), (7, z), (7, leak), (7, z), (None, leak + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    spark.createDataFrame([(1, " ".join(leak.split()[20:60]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    near = sorted(((r.doc_id, r.text) for r in P.near_stage(spark, docs, str(tmp_path)).collect()), key=str)
    assert near == sorted([(None, x), (None, y), (7, z), (None, leak + " more")], key=str)
    left = collections.Counter((r.doc_id, r.text) for r in P.leak_stage(spark, docs, str(tmp_path)).collect())
    assert left == collections.Counter([(None, x), (None, y), (5, x), (9, y), (7, z), (7, z)])
