"""Blocks of documents that look up corpus-wide statistics of what they hold.

Documents are dealt into blocks of a few MB. Each block sends the distinct keys it holds (words, shingles, byte
contexts) to buckets by key, a bucket sees all blocks' counts of its keys and answers each block in the order of its
question, and the block meets its answers again. Keys cross the network once per block and not once per occurrence, as
packed arrays and not as rows; a key in every document costs one number per block. Texts are dealt once: both reads of
the blocks share one exchange. With ``apart`` they are dealt twice, and the answers are kept in between, so that the disk
never holds the questions together with what the blocks make of the answers.

Beyond a fan of blocks, the questions to a bucket are merged by region (a fan of blocks), those of regions by regions of
regions, and so on; answers take the same way back. A task then holds the questions of one fan only, however many blocks
there are, and a key that many blocks hold reaches its bucket once per region."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

_ASKED = "bucket int, block long, keys binary, counts binary"
_ANSWERED = "block long, bucket int, answers binary, extra long"


def ask_and_answer(
    blocked: DataFrame,
    ask: Callable[[pa.Table], list[tuple[int, bytes, bytes]]],
    answer: Callable[[int, list[bytes], list[bytes]], list[tuple[bytes, int]]],
    use: Callable[[int, pa.Table, dict[int, tuple[bytes, int]]], pa.Table],
    schema: str,
    n_blocks: int,
    merge: Callable[[list[bytes], list[bytes]], tuple[bytes, bytes, np.ndarray]],
    fan: int = 64,
    answer_bytes: int = 8,
    apart: bool = False,
) -> DataFrame:
    """blocked has a long column ``block``, below n_blocks. ask(block rows) -> (bucket, keys, counts) each; answer(bucket,
    keys of each block, counts of each block) -> (answers, extra) for each block, answer_bytes per key; use(block, rows,
    bucket -> answers) -> result. merge(keys, counts) of several questions -> (keys, counts, place of each asked key among
    them); extras are only ever summed up."""

    def asking(key, rows):
        block, found = key[0].as_py(), ask(rows)
        return pa.table({
            "bucket": pa.array([x[0] for x in found], pa.int32()), "block": pa.array([block] * len(found), pa.int64()),
            "keys": pa.array([x[1] for x in found], pa.binary()), "counts": pa.array([x[2] for x in found], pa.binary()),
        })

    def answering(key, rows):
        rows = rows.sort_by("block")
        found = answer(key[0].as_py(), rows["keys"].to_pylist(), rows["counts"].to_pylist())
        return _answers(rows, found)

    def _answers(rows, found):
        return pa.table({
            "block": rows["block"].cast(pa.int64()), "bucket": rows["bucket"].cast(pa.int32()),
            "answers": pa.array([x[0] for x in found], pa.binary()), "extra": pa.array([x[1] for x in found], pa.int64()),
        })

    def merging(key, rows):
        rows = rows.sort_by("block")
        keys, counts, _ = merge(rows["keys"].to_pylist(), rows["counts"].to_pylist())
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int64()), "keys": pa.array([keys], pa.binary()), "counts": pa.array([counts], pa.binary())})

    def handing(key, rows, answers):
        rows = rows.sort_by("block")
        keys = rows["keys"].to_pylist()
        *_, places = merge(keys, rows["counts"].to_pylist())
        values = np.frombuffer(answers["answers"][0].as_py(), f"V{answer_bytes}")[places]
        width = len(places) and sum(map(len, keys)) // len(places)
        stops = np.cumsum([0, *(len(k) // width if width else 0 for k in keys)])
        extra = [answers["extra"][0].as_py()] + [0] * (len(keys) - 1)
        return _answers(rows, [(values[a:b].tobytes(), x) for a, b, x in zip(stops[:-1], stops[1:], extra, strict=True)])

    def answers_to(asked: DataFrame, n: int) -> DataFrame:
        if n <= fan:
            return asked.groupBy("bucket").applyInArrow(answering, _ANSWERED)
        regions = -(-n // fan)
        placed = asked.withColumn("region", F.col("block") % regions)
        above = answers_to(placed.groupBy("bucket", "region").applyInArrow(merging, _ASKED), regions)
        return placed.groupBy("bucket", "region").cogroup(above.groupBy("bucket", "block")).applyInArrow(handing, _ANSWERED)

    def using(key, rows, answers):
        got = dict(zip(answers["bucket"].to_pylist(), zip(answers["answers"].to_pylist(), answers["extra"].to_pylist(), strict=True), strict=True))
        return use(key[0].as_py(), rows, got)

    answers = answers_to(blocked.groupBy("block").applyInArrow(asking, _ASKED), n_blocks)
    if apart:
        answers = C.kept_table(answers)
    return blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(using, schema)


def split_buckets(bucket: np.ndarray, *arrays: np.ndarray) -> list[tuple]:
    """(bucket, slices of arrays...) for each bucket that occurs; order inside a bucket is kept."""
    if not len(bucket):
        return []
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    heads = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    stops = np.r_[heads[1:], len(bucket)]
    return [(int(bucket[a]), order[a:b], *[x[order[a:b]] for x in arrays]) for a, b in zip(heads, stops, strict=True)]
