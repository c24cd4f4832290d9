"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_HINT = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
#: Character classes from narrow to wide, with the least bits per character of a hot window. A window of 20 has 4.32 at most.
CLASSES = (
    ("digits", re.compile(r"[0-9]+"), math.inf),  # numbers of any kind
    ("hex", re.compile(r"[0-9a-fA-F-]+"), 3.2),
    ("mixed", re.compile(r"(?=(?:[^A-Z]*[A-Z]){4})(?=(?:[^a-z]*[a-z]){4})[A-Za-z_-]+"), 3.75),  # four letters of each case
    ("letters", re.compile(r"[A-Za-z_-]+"), 3.65),  # identifiers and long words stay below
    ("alnum", re.compile(r"[A-Za-z0-9]+"), 3.75),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 3.75),
)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW)
#: Candidates that look random but are no secrets, unless a part of one between / + = _ - is hot by itself and not allowed.
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),  # UUID
    re.compile(r".*(EXAMPLE|example|PLACEHOLDER|placeholder|CHANGEME|changeme|0123456789|abcdefghij|ABCDEFGHIJ).*"),
    re.compile(r"(?:[A-Za-z]+[_/=+-]+)+[A-Za-z]*"),  # paths and compound identifiers
    re.compile(r"(.)\1+"),
)
_SEPARATOR = re.compile(r"[/+=_-]+")
_BITS = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 2)]  # one more while a window moves on


def hot_span(s: str, limit: float) -> tuple[int, int] | None:
    """From the first to the last window whose entropy reaches the limit; counts change by one character a step."""
    window, counts = WINDOW, {}
    total, first, last = 0.0, None, 0  # total: sum of c * log2(c)
    for i, ch in enumerate(s):
        c = counts.get(ch, 0)
        total += _BITS[c + 1] - _BITS[c]
        counts[ch] = c + 1
        if i >= window:
            old = counts[out := s[i - window]]
            total += _BITS[old - 1] - _BITS[old]
            counts[out] = old - 1
        if i >= window - 1 and math.log2(window) - total / window >= limit - 1e-9:
            first = i - window + 1 if first is None else first
            last = i + 1
    return None if first is None else (first, last)


def _limit(s: str) -> float:
    return next((limit for _, pattern, limit in CLASSES if pattern.fullmatch(s)), math.inf)


def _suppressed(s: str, allowed: tuple[re.Pattern, ...]) -> bool:
    """Whether the allow list lets a hot candidate pass: my_example_key=<random> has a hot part that it does not name."""
    if not any(p.fullmatch(s) for p in allowed):
        return False
    parts = [x for x in _SEPARATOR.split(s) if WINDOW <= len(x) < len(s)]
    return not any((limit := _limit(x)) < math.inf and hot_span(x, limit) and not any(p.fullmatch(x) for p in allowed) for x in parts)


def scan(text: str, allowed: tuple[re.Pattern, ...] = ALLOWED) -> list[tuple[int, int, int]]:
    """(start, end, kind index) of all spans, by start, then kind; code points, end exclusive."""
    found = []
    low = text.lower()
    if any(x in low for x in _HINT):
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    for m in _CANDIDATE.finditer(text):
        s = m[0]
        limit = _limit(s)
        if limit < math.inf and (hot := hot_span(s, limit)) and not _suppressed(s, allowed):
            found.append((m.start() + hot[0], m.start() + hot[1], 3))
    return sorted(found, key=lambda x: (x[0], x[2], x[1]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): spans is an array of (kind, start, end), one row per input row, in the text's code points.

    Kinds: assign, access and hex are fixed patterns (leftmost, non-overlapping within a kind). entropy: runs of 20 or
    more of [A-Za-z0-9+/_=-] are candidates; each is assigned its narrowest character class, a window of 20 characters
    slides over it with incrementally kept counts, and the hot windows' union is a span unless the candidate is on the
    allow list. Found of random strings: over 0.97 of 32 hex digits, 0.99 of 32 letters of both cases or letters and
    digits, 0.93 of 20 letters and digits or 24 letters of both cases; of one case 0.9 of 32 letters, but 0.7 of 24, which
    long words resemble too much. Null texts are empty; null ids and repeated rows pass through; narrow plan, no shuffle."""

    def part(batches):
        for pdf in batches:
            spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, b, k in scan(t or "")] for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "spans": spans})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(part, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(C.documents(spark, sf_dir))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
