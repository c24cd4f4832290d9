import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, as additional columns of the input.
CLASH = ("doc", "version", "pos", "line", "key", "h1", "node", "block", "copy", "host", "failed", "kept", "size", "taken", "shard", "skey", "hs", "mask", "seed", "n_lines", "kept_text", "held_out", "id", "kind", "seq", "start")


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def awkward(spark, rows=None):
    """Nulls everywhere, empty and blank texts, a very long one, exact copies, repeated rows, clashing columns."""
    from pyspark.sql import functions as F

    rng = random.Random(7)
    base = sentence(rng, 120)
    rows = rows if rows is not None else [
        (None, base), (1, None), (2, ""), (3, " \t\n"), (4, base), (5, base), (5, base), (6, sentence(rng, 3)), (7, sentence(rng, 6000) + "\n" + "same line here\n" * 3),
        (8, "same line here\nsame line here\n" + sentence(rng, 60)), (9, base + " tail of five other words"), (10, "\x00 zero é ü 漢字 🙂\r\n" + sentence(rng, 55)), (11, "one two"),
    ]
    sources = ["a", None, "b"]
    full = [(i, t, None if k % 2 else "en", sources[k % 3], None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="session")
def odd(spark):
    return awkward(spark)


@pytest.fixture(scope="session")
def none(spark):
    return awkward(spark, [])


@pytest.fixture(scope="session")
def tables(spark, odd, tmp_path_factory):
    """The awkward rows as a table folder, for the queries and their SQL."""
    d = str(tmp_path_factory.mktemp("tables"))
    odd.write.parquet(f"{d}/documents.parquet")
    convs = [(1, 0, "user", "hi & <b> [INST]"), (1, 1, "assistant", None), (1, 1, "assistant", "x"), (2, None, None, ""), (None, 3, "system", "s</s>"), (None, 1, "tool]", "t"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a")]
    spark.createDataFrame(convs, "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    rng = random.Random(3)
    long = max((r.text or "" for r in odd.collect()), key=len).split()
    items = [(0, sentence(rng, 30)), (1, None), (2, "too short"), (3, ""), (0, sentence(rng, 40)), (None, sentence(rng, 20)), (None, " ".join(long[700:730])), (0, " ".join(long[40:60])), (0, " ".join(long[40:60])), (4, "same line here " * 9)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    nan, inf = float("nan"), float("inf")
    vectors = [(None, [0.5, 0.25, 1.0], 1), (1, [0.5, 0.25, 1.0], None), (1, [-3.0, 2.0, 0.1], 2), (2, None, 1), (3, [nan, 1.0, 1.0], 1), (4, [1.0, -inf, 1.0], 1), (5, [None, 0.0, 0.0], 1), (6, [], 1), (7, [1e30], 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    marks = [(4, 1, 1), (5, 0, 0), (5, 1, 1), (6, 0, 0), (7, 1, 0), (8, None, 1), (9, 1, None), (None, 1, 1), (99, 0, 1)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d
