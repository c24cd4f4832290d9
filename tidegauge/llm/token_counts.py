"""Edit-aware token counts: a segment tree over the pre-tokens of each document."""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import islice

import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed pattern of the vocabulary's pre-tokens.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 32  # pre-tokens in a leaf


@lru_cache(maxsize=2)
def counter(path: str):
    """(pre-token pattern, function from pre-token to its number of tokens); once per Python worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    count = lru_cache(maxsize=1 << 18)(lambda piece: len(encoding.encode_ordinary(piece)))
    return regex.compile(PATTERN), count


class TokenTree:
    """Token counts and lengths of a text's leaves (32 pre-tokens each), summed up in a binary tree."""

    def __init__(self, text: str, pattern, count):
        self.pattern, self.count, self.encoded = pattern, count, 0
        self._build(pattern.findall(text))

    def _build(self, pieces: list[str]) -> None:
        leaves = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        self.size = 1 << (len(leaves) - 1).bit_length()
        self.texts = ["".join(x) for x in leaves] + [""] * (self.size - len(leaves))
        self.tokens, self.chars = [0] * (2 * self.size), [0] * (2 * self.size)
        count = self.count
        for i, x in enumerate(leaves):
            self.tokens[self.size + i], self.chars[self.size + i] = sum(map(count, x)), len(self.texts[i])
        for i in range(self.size - 1, 0, -1):
            self.tokens[i], self.chars[i] = self.tokens[2 * i] + self.tokens[2 * i + 1], self.chars[2 * i] + self.chars[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.texts)

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds offset ``at`` (the last one at the end) and where it begins."""
        i, before = 1, 0
        while i < self.size:
            i *= 2
            if at - before >= self.chars[i] and self.chars[i + 1]:
                before += self.chars[i]
                i += 1
        return i - self.size, before

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces [start, end) by ``new``; offsets are clipped to the text. Only leaves around it are encoded again."""
        start = max(0, min(start, self.chars[1]))
        end = max(start, min(end, self.chars[1]))
        first, at = self._leaf(start)
        # left context: back to a leaf start with a non-space between it and the edit, so no earlier pre-token can change
        while first and not self.texts[first][: start - at].strip():
            first -= 1
            at -= len(self.texts[first])
        if first:
            first -= 1
            at -= len(self.texts[first])
        last, begin = self._leaf(end)
        stop = begin + len(self.texts[last])
        while True:
            # right context: on until a pre-token ends with a leaf, judged with what follows in view
            ahead, i = "", last + 1
            while i < self.size and not ahead.strip():
                ahead += self.texts[i]
                i += 1
            region = "".join(self.texts[first : last + 1])
            region = region[: start - at] + new + region[end - at :]
            pieces, done = [], 0
            for m in self.pattern.finditer(region + ahead):
                if done >= len(region):
                    break
                pieces.append(m[0])
                done = m.end()
            if done == len(region) or last + 1 >= self.size:
                break
            last += 1
            stop += len(self.texts[last])
        self.encoded += len(region)
        slots = last - first + 1
        if len(pieces) > 4 * LEAF * slots:  # outgrown: new leaves for the whole text
            self._build([*self._pieces(0, first), *pieces, *self._pieces(last + 1, self.size)])
            return
        share, pieces = -(-len(pieces) // slots), iter(pieces)
        for i in range(first, last + 1):
            own = list(islice(pieces, share))
            self.texts[i] = "".join(own)
            self.tokens[self.size + i], self.chars[self.size + i] = sum(map(self.count, own)), len(self.texts[i])
        low, high = (self.size + first) // 2, (self.size + last) // 2
        while low:
            for i in range(low, high + 1):
                self.tokens[i], self.chars[i] = self.tokens[2 * i] + self.tokens[2 * i + 1], self.chars[2 * i] + self.chars[2 * i + 1]
            low, high = low // 2, high // 2

    def _pieces(self, a: int, b: int) -> list[str]:
        """Pre-tokens of whole leaves, cut as they are in the whole text."""
        text, ahead = "".join(self.texts[a:b]), "".join(self.texts[b:])
        out, done = [], 0
        for m in self.pattern.finditer(text + ahead):
            if done >= len(text):
                break
            out.append(m[0])
            done = m.end()
        return out


def count_with_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, n_edits, edited_tokens, n_chars, edited_chars, encoded_chars): one row per input document.

    ``edits`` has (doc_id, seq, start, stop, new): each replaces code points [start, stop) of the text as the edits of a
    lower seq left it (ties by start, stop, new; null offsets are 0, null new is empty). ``encoded_chars`` is what the
    edits had to encode again. Documents and edits are dealt by id and sorted, each document first, then its edits in
    order; a task streams over them with one document's tree in memory, however many edits follow it. Of several rows
    with one id, all are counted and the edits apply to the last text in sort order. Null texts are empty; edits of a
    null id or of no document do nothing; the vocabulary's path must exist on each executor."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("stop"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    changes = edits.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.lit(1).alias("kind"), *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("seq", "start", "stop")], F.coalesce(F.col("new"), F.lit("")).alias("text")
    )
    dealt = rows.unionByName(changes).repartition(C.shuffle_width(docs.sparkSession), "id").sortWithinPartitions("id", "kind", "seq", "start", "stop", "text")
    names = ["doc_id", "n_tokens", "n_edits", "edited_tokens", "n_chars", "edited_chars", "encoded_chars"]

    def part(batches):
        pattern, count = counter(vocabulary)
        tree, ident, state = None, None, None

        def finished():
            return (ident, state[0], state[1], tree.total, state[2], tree.chars[1], tree.encoded)

        for pdf in batches:
            out = []
            ids, missing = pdf["id"].tolist(), pdf["id"].isna().tolist()
            for i, none, kind, start, stop, text in zip(ids, missing, pdf["kind"].tolist(), pdf["start"].tolist(), pdf["stop"].tolist(), pdf["text"].tolist(), strict=True):
                if kind == 0:
                    if tree is not None:
                        out.append(finished())
                    tree, ident = TokenTree(text, pattern, count), None if none else int(i)
                    state = [tree.total, 0, tree.chars[1]]
                elif tree is not None and ident == i:
                    tree.edit(start, stop, text)
                    state[1] += 1
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})
        if tree is not None:
            yield pd.DataFrame([finished()], columns=names).astype({"doc_id": "Int64"})

    return dealt.mapInPandas(part, ", ".join(f"{n} long" for n in names))


def sample_edits(docs: DataFrame, per_doc: int = 3) -> DataFrame:
    """Reproducible edits of every document: replacements, insertions and deletions at hashed places."""
    new = F.array(*[F.lit(x) for x in ("", " and so on", "\n\n", "it's 2024!", "  ", "é", "un", "\t1,000.5")])
    drawn = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"), F.explode(F.sequence(F.lit(1), F.lit(per_doc))).alias("seq")).withColumns({
        "start": F.pmod(F.xxhash64("doc_id", "seq", F.lit("at")), F.col("n") + 1), "more": F.pmod(F.xxhash64("doc_id", "seq", F.lit("stop")), F.lit(12)),
        "new": F.get(new, F.pmod(F.xxhash64("doc_id", "seq", F.lit("new")), F.lit(8)).cast("int")),
    })
    return drawn.select("doc_id", "seq", "start", (F.col("start") + F.col("more")).alias("stop"), "new")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir).select("doc_id", "text")
    return count_with_edits(docs, sample_edits(docs))
