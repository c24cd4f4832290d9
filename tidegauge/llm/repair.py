"""Conversation structure repair: each conversation is an input acceptor, composed with an edit transducer and a role
grammar; the shortest path over (cost, labels) tells which turns to keep, rerole, delete or insert."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

#: Grammar acceptor of (s?(ua)+)?: state -> role initial -> next state. It starts in 0 and may end in 0 and 3.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FINAL = (0, 3)
#: Roles that the transducer may write, by initial.
ROLES = {"u": "user", "a": "assistant"}
#: Weights of the edit transducer.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: An arc of the composed machine: (cost, labels, roles written before the turn, role of the turn ("" as it is, None
#: deleted), next state). Labels are some I, then one of D, K, R.
Arc = tuple[int, str, tuple[str, ...], str | None, int]


@lru_cache(maxsize=None)
def inserts(state: int) -> tuple[tuple[tuple[str, ...], int], ...]:
    """(roles written, state reached) for every state that insertions reach, by the fewest of them."""
    found, left = {state: ()}, [state]
    for at in left:
        for initial, to in GRAMMAR[at].items():
            if initial in ROLES and to not in found:
                found[to] = (*found[at], ROLES[initial])
                left.append(to)
    return tuple((roles, to) for to, roles in found.items())


@lru_cache(maxsize=4096)
def arcs(initial: str, fault: str | None, state: int) -> tuple[Arc, ...]:
    """Arcs that leave a grammar state over one turn; made when a walk first meets them."""
    late = TRUNCATED if fault == "truncated" else 0
    found = []
    for roles, at in inserts(state):
        before, cost = "I" * len(roles), INSERT * len(roles)
        found.append((cost + DELETE, before + "D", roles, None, at))
        if fault in ("blank", "duplicate"):
            continue
        if initial in GRAMMAR[at]:
            found.append((cost + KEEP + late, before + "K", roles, "", GRAMMAR[at][initial]))
        found += [(cost + REROLE + late, before + "R", roles, ROLES[x], to) for x, to in GRAMMAR[at].items() if x in ROLES]
    return tuple(found)


#: Cost from each state to the end when no turn is left.
END = tuple(min(INSERT * len(roles) for roles, to in inserts(q) if to in FINAL) for q in GRAMMAR)


@lru_cache(maxsize=1 << 16)
def backward(initial: str, fault: str | None, ahead: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """(best arc of each state over this turn, costs from each state to the end less their minimum), given the costs
    ahead. An arc of labels leads to one state only, and of two arcs' labels none begins the other, so the least labels
    here among the cheapest arcs begin the least labels to the end."""
    best, costs = [], []
    for q in GRAMMAR:
        ways = arcs(initial, fault, q)
        k = min(range(len(ways)), key=lambda i: (ways[i][0] + ahead[ways[i][4]], ways[i][1]))
        best.append(k)
        costs.append(ways[k][0] + ahead[ways[k][4]])
    return tuple(best), tuple(c - min(costs) for c in costs)


def faults(convs: DataFrame) -> DataFrame:
    """convs (conv_id, turn, role, text) plus ``fault`` (blank, duplicate, truncated or null, the first that applies) and
    ``nth``, which tells equal turns apart. One exchange, by conversation."""
    flat, last = F.translate("text", C.SPACE, ""), F.right(F.rtrim("text", F.lit(C.SPACE)), F.lit(1))
    nth = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("turn"))
    fault = F.when(flat == "", "blank").when(F.col("nth") > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    return convs.repartition("conv_id").withColumn("nth", nth).withColumn("fault", fault)


_KEYS = ("turn", "role", "text", "nth")
_REPAIRED = "conv_id long, turn long, role_before string, fault string, edit string, role string, text string, cost long"


def repair(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role_before, fault, edit, role, text, cost): every turn of every conversation, and the inserted
    ones, with the cheapest edits that make the conversation's role initials match (s?(ua)+)?, of equally cheap ones
    those whose initials are least in ASCII. edit is K (keep), R (rerole), D (delete: role is null) or I (insert: turn,
    role_before and fault are null, text is empty).

    Turns go by turn (null first), role, text. Null roles and texts are one space, so a null text is blank; rows
    without a conversation id are one conversation; equal rows are duplicates; an empty table gives no rows; other columns
    are left out. A role counts by its first character, so one without any can't be kept.

    Conversations are dealt by id once. Sorted backwards, each turn gets the best arc of each grammar state at once; sorted
    forwards, a walk takes the arcs of its states. Both are streams that hold one turn and four costs, so a conversation
    of any length takes no memory; it is one task's stream, as its order demands."""
    rows = convs.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
    )
    marked = faults(rows)
    columns = [*marked.columns, "best"]
    back = marked.sortWithinPartitions("conv_id", *[F.desc_nulls_last(c) for c in _KEYS])
    chosen = back.mapInArrow(_choose, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in marked.schema)}, best binary").select(columns)
    return chosen.sortWithinPartitions("conv_id", *[F.asc_nulls_first(c) for c in _KEYS]).mapInArrow(_walk, _REPAIRED)


def _choose(batches):
    """Adds the best arc of each state; turns come last to first."""
    conv, ahead = (), END
    for batch in batches:
        best = []
        for c, role, fault in zip(*(batch[n].to_pylist() for n in ("conv_id", "role", "fault")), strict=True):
            if (c,) != conv:
                conv, ahead = (c,), END
            now, ahead = backward(role[:1], fault, ahead)
            best.append(bytes(now))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.binary())], names=[*batch.schema.names, "best"])


def _walk(batches):
    """Takes the arcs from the first turn to the last, then the insertions that end a conversation."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
    names = [part.split()[0] for part in _REPAIRED.split(", ")]

    def table(rows):
        cols = zip(*rows, strict=True) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    def inserted(conv, roles):
        return [(conv, None, None, None, "I", r, "", INSERT) for r in roles]

    def ended(conv, state):
        least = min((len(roles), roles) for roles, to in inserts(state) if to in FINAL)
        return inserted(conv, least[1])

    conv, state = (), 0
    for batch in batches:
        rows = []
        for c, turn, role, text, fault, best in zip(*(batch[n].to_pylist() for n in ("conv_id", "turn", "role", "text", "fault", "best")), strict=True):
            if (c,) != conv:
                if conv:
                    rows += ended(conv[0], state)
                conv, state = (c,), 0
            cost, labels, before, new, to = arcs(role[:1], fault, state)[best[state]]
            rows += inserted(c, before)
            rows.append((c, turn, role, fault, labels[-1], role if new == "" else new, text, cost - INSERT * len(before)))
            state = to
        yield table(rows)
    if conv:
        yield table(ended(conv[0], state))


def digests(repaired: DataFrame) -> DataFrame:
    """One row per conversation of repair's rows, read in its order without another exchange: counts of faults and of
    adjacent role initials that aren't su, ua or au, gaps in turn numbers, cost, audit and a hash of the repaired text."""
    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

    def part(batches):
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        conv, now = (), None

        def fresh():
            return {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": bytearray(), "hash": hashlib.sha256(), "first": None, "last": None, "kinds": 0, "before": None, "any": False}

        def done():
            gaps = 0 if now["first"] is None else now["last"] - now["first"] + 1 - now["kinds"]
            return (conv[0], gaps, *(now[k] for k in ("blank", "duplicate", "truncated", "illegal", "cost")), now["audit"].decode(), now["hash"].hexdigest())

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 9, kinds, strict=True)], names=names)

        for batch in batches:
            rows = []
            for c, turn, before, fault, edit, role, text, cost in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (c,) != conv:
                    if conv:
                        rows.append(done())
                    conv, now = (c,), fresh()
                now["cost"] += cost
                now["audit"] += edit.encode()
                if fault:
                    now[fault] += 1
                if edit != "I":
                    now["illegal"] += now["before"] is not None and now["before"] + before[:1] not in ("su", "ua", "au")
                    now["before"] = before[:1]
                    if turn is not None:
                        now["first"] = turn if now["first"] is None else now["first"]
                        now["kinds"] += turn != now["last"]
                        now["last"] = turn
                if edit != "D":
                    now["hash"].update(f"{chr(10) if now['any'] else ''}{role}:{text}".encode())
                    now["any"] = True
            yield table(rows)
        if conv:
            yield table([done()])

    return repaired.mapInArrow(part, schema)


def damaged(convs: DataFrame) -> DataFrame:
    """The query's damage: by crc32 of conv_id:turn modulo 20, rows are dropped (0), emptied (1), robbed of their sentence
    ends (2), repeated (3) or given to the user (4). Nulls are one space."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = convs.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), (F.crc32(F.concat_ws(":", word("conv_id"), word("turn"))) % 20).alias("hit"))
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("hit") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.filter("hit <> 0").select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times)).drop("col")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = digests(repair(damaged(convs))).withColumnRenamed("conv_id", "__conv")
    ids = convs.select("conv_id").distinct()
    joined = ids.join(found.hint("shuffle_hash"), ids["conv_id"].eqNullSafe(found["__conv"]), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hit AS (
  SELECT conv_id, turn, role, text, xor(4294967295::UBIGINT, list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::UBIGINT)),
    lambda h, b: list_reduce(list_prepend(xor(h, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1::UBIGINT))))) % 20 AS hit FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role,
    CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hit, LATERAL (SELECT unnest(range(CASE hit WHEN 3 THEN 2 ELSE 1 END)))
  WHERE hit <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS seq FROM damaged),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY seq) AS nth,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS flat FROM placed),
marked AS (
  SELECT *, CASE WHEN flat = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(flat, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY seq) AS previous FROM numbered),
ins(q, q1, labels, said) AS (VALUES (0, 0, '', ''), (1, 1, '', ''), (2, 2, '', ''), (3, 3, '', ''),
  (0, 2, 'I', chr(10) || 'user:'), (1, 2, 'I', chr(10) || 'user:'), (3, 2, 'I', chr(10) || 'user:'), (2, 3, 'I', chr(10) || 'assistant:'),
  (0, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
gram(q1, i, q2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
arc AS (
  SELECT q, q1 AS q2, labels || 'D' AS labels, said, 'D' AS kind, NULL AS i, 3 * length(labels) + 4 AS cost FROM ins
  UNION ALL SELECT q, q2, labels || 'K', said, 'K', i, 3 * length(labels) FROM ins JOIN gram USING (q1)
  UNION ALL SELECT q, q2, labels || 'R', said, 'R', i, 3 * length(labels) + 3 FROM ins JOIN gram USING (q1) WHERE i <> 's'),
walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS seq, 0 AS q, {'c': 0::BIGINT, 'l': ''} AS best, '' AS said FROM marked
  UNION ALL
  SELECT conv_id, seq, q2, min(best), arg_min(said, best) FROM (
    SELECT w.conv_id, m.seq, a.q2,
      {'c': (w.best.c + a.cost + CASE WHEN m.fault = 'truncated' AND a.kind <> 'D' THEN 3 ELSE 0 END)::BIGINT, 'l': w.best.l || a.labels} AS best,
      w.said || a.said || CASE a.kind WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || m.role || ':' || m.text
        ELSE chr(10) || CASE a.i WHEN 'u' THEN 'user:' ELSE 'assistant:' END || m.text END AS said
    FROM walk w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.seq = w.seq + 1 JOIN arc a ON a.q = w.q
      AND (a.kind = 'D' OR m.fault NOT IN ('blank', 'duplicate') AND (a.kind = 'R' OR a.i = m.initial)))
  GROUP BY conv_id, seq, q2),
last AS (SELECT conv_id, max(seq) AS seq FROM marked GROUP BY conv_id),
ended AS (
  SELECT w.conv_id, min({'c': w.best.c + 3 * length(ins.labels), 'l': w.best.l || ins.labels}) AS best,
    arg_min(w.said || ins.said, {'c': w.best.c + 3 * length(ins.labels), 'l': w.best.l || ins.labels}) AS said
  FROM walk w JOIN last ON last.conv_id IS NOT DISTINCT FROM w.conv_id AND last.seq = w.seq JOIN ins ON ins.q = w.q AND ins.q1 IN (0, 3)
  GROUP BY w.conv_id),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE previous IS NOT NULL AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(e.best.c, 0)::BIGINT AS cost,
  coalesce(e.best.l, '') AS audit, sha256(coalesce(substr(e.said, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM ids.conv_id
"""
