"""Conversation structure repair by Hirschberg's divide and conquer.

A repair reads a conversation's rows in order and writes role initials that
follow ``(s?(ua)+)?``.  What has been written is one of four states: nothing, the
system row, a user row last, an assistant row last.  A row is kept, given
another role, or deleted; empty turns are inserted before rows.  From a state
each letter of the audit (Delete, Insert, Keep, Rerole) has one effect, so an
audit is one path.

A segment of rows is a four-by-four table: the least cost from one state to
another, and for each first state the order of the least audits to the others.
Audits of one segment end at its last row, so none is a prefix of another, and
two segments' tables combine without the audits.  ``_crossings`` finds a path in
linear space: four-state cost vectors run forward from the start and backward
from the end, meet in the middle at the audit-least optimal state, and both
halves are solved the same way.

Rows are range-partitioned by (conversation, turn, role, text), equal rows
folded first, so that a conversation of any length is spread over tasks.  Each
task cuts its rows into pieces of ``PIECE_ROWS`` and summarises them as tables;
a conversation's tables (one a piece) give the states where pieces meet, and
every piece is then solved alone.  Only the digest of the repaired text reads a
conversation in one stream, one piece at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linearspark.llm.common import ASCII_SPACE, map_partition, read_table
from linearspark.session import materialize

PIECE_ROWS = 2048
PIECE_CHARS = 1 << 18     # a piece also ends here: bounds its memory for long texts
FAULTS = 20               # crc32 of "conv_id:turn" modulo this chooses the damage

RETAG, DROP, ADD, CUT_SHORT = 2, 3, 2, 1      # costs of Rerole, Delete, Insert and an undeleted truncated row
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (NOTHING, ASSISTANT)
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}   # the state after one more turn
ROLE = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 60

# Row types: must go; else 2 * (initial) + truncated, initial 0 other, 1 s, 2 u, 3 a, from type 2 on; END closes.
GONE, END = 0, 1
_INITIAL = {"s": 1, "u": 2, "a": 3}


def row_type(initial: str, gone: bool, truncated: bool) -> int:
    return GONE if gone else 2 + 2 * _INITIAL.get(initial, 0) + truncated


@cache
def _row_table(kind: int) -> tuple[tuple, tuple]:
    """For one row: ``costs[p][q]`` and ``audits[p][q]`` from state p to q."""
    costs, audits = [[FAR] * 4 for _ in range(4)], [[""] * 4 for _ in range(4)]
    for p in range(4):
        state, before = p, ""
        for added in range(3):                       # a third insert comes back to the first one's state
            steps = []
            if kind == END:
                steps.append((state, 0, "")) if state in FINAL else None
            else:
                steps.append((state, DROP, "D"))
                if kind != GONE:
                    initial, late = divmod(kind - 2, 2)
                    if initial == SYSTEM and state == NOTHING:
                        steps.append((SYSTEM, late * CUT_SHORT, "K"))
                    after = NEXT[state]
                    steps.append((after, late * CUT_SHORT, "K") if initial == after else (after, RETAG + late * CUT_SHORT, "R"))
            for q, cost, letter in steps:
                new = (cost + added * ADD, before + letter)
                if new < (costs[p][q], audits[p][q]):
                    costs[p][q], audits[p][q] = new
            state, before = NEXT[state], before + "I"
    return tuple(map(tuple, costs)), tuple(map(tuple, audits))


@cache
def _ranked(kind: int) -> tuple[tuple, tuple]:
    """``_row_table`` with the order of the audits of each first state instead of them."""
    costs, audits = _row_table(kind)
    return costs, tuple(tuple(sorted(set(a)).index(x) for x in a) for a in audits)


def _forward(tables: list, start: int) -> tuple[list[int], list[int]]:
    """Costs from ``start`` to each state, and the order of their least audits."""
    costs, order = [FAR] * 4, [0] * 4
    costs[start] = 0
    for step, rank in tables:
        best = [(FAR, 0, 0)] * 4
        for p in range(4):
            if costs[p] < FAR:
                own, mine, at, row = costs[p], rank[p], order[p], step[p]
                for q in range(4):
                    new = (own + row[q], at, mine[q])
                    if new < best[q]:
                        best[q] = new
        costs = [min(b[0], FAR) for b in best]
        place = {b: i for i, b in enumerate(sorted({b[1:] for b in best if b[0] < FAR}))}
        order = [place[b[1:]] if b[0] < FAR else 0 for b in best]
    return costs, order


def _backward(tables: list, end: int) -> list[int]:
    """Costs from each state to ``end``."""
    costs = [FAR] * 4
    costs[end] = 0
    for step, _ in reversed(tables):
        costs = [min(min(map(sum, zip(row, costs))), FAR) for row in step]
    return costs


def _crossings(tables: list, start: int, end: int) -> list[int]:
    """The states after each of ``tables`` on the audit-least cheapest path from
    ``start`` to ``end``."""
    states = [end] * len(tables)
    todo = [(0, len(tables), start, end)]
    while todo:
        lo, hi, p, q = todo.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        ahead, order = _forward(tables[lo:mid], p)
        behind = _backward(tables[mid:hi], q)
        least = min((ahead[s] + behind[s], order[s], s) for s in range(4))[2]
        states[mid - 1] = least
        todo += [(lo, mid, p, least), (mid, hi, least, q)]
    return states


def summary(kinds: bytes) -> tuple[list[int], list[int]]:
    """A piece's table, flat: costs and orders from each of the four states."""
    tables = [_ranked(k) for k in kinds]
    rows = [_forward(tables, p) for p in range(4)]
    return [c for r in rows for c in r[0]], [o for r in rows for o in r[1]]


def audit_path(kinds: bytes, start: int, end: int) -> tuple[list[str], list[int]]:
    """The letters for each row (inserts before it, then its own), and the states
    before each row."""
    states = _crossings([_ranked(k) for k in kinds], start, end)
    before = [start, *states[:-1]]
    return [_row_table(k)[1][p][q] for k, p, q in zip(kinds, before, states)], before


def repaired_lines(roles: list[str], texts: list[str], letters: list[str], before: list[int]) -> Iterator[str]:
    """The ``role:text`` lines that a piece's edits leave."""
    for role, text, edits, state in zip(roles, texts, letters, before):
        for letter in edits:
            if letter == "D":
                continue
            if letter == "K":
                state = SYSTEM if state == NOTHING and role[:1] == "s" else NEXT[state]
                yield f"{role}:{text}"
                continue
            state = NEXT[state]
            yield f"{ROLE[state]}:{text if letter == 'R' else ''}"


# ------------------------------------------------------------------ Spark

def _filled(name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damage(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, copies)``: the rows after the damage that
    crc32 of ``conv_id:turn`` chooses, equal ones folded (nulls: one space)."""
    fault = F.pmod(F.crc32(F.concat(_filled("conv_id"), F.lit(":"), _filled("turn")).cast("binary")), F.lit(FAULTS))
    rows = turns.select("conv_id", "turn", _filled("role").alias("role"), _filled("text").alias("text"), fault.alias("fault"))
    rows = rows.filter("fault <> 0").select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fault") == 3, 2).otherwise(1).alias("copies"))
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` with ``seen`` (role and text occur in an earlier turn), ``blank``
    and ``cut`` (the last character that is no white space ends no sentence)."""
    key = [F.col("conv_id").alias("c"), F.col("role").alias("r"),
           F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")     # null turns come first
    first = rows.groupBy(*key).agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    same = (F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r"))
            & (F.xxhash64("text") == F.col("h1")) & (F.xxhash64(F.lit(1), "text") == F.col("h2")))
    bare = F.rtrim("text", F.lit(ASCII_SPACE))
    return rows.join(first, same, "left").select(
        *rows.columns, F.coalesce(at > F.col("first"), F.lit(False)).alias("seen"),
        (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names))


_ROW = ["conv_id", "role", "text", "copies", "seen", "blank", "cut"]
_PIECE = ("part int, no int, kinds binary, roles array<string>, texts array<string>, costs array<long>, orders array<long>, "
          "first string, last string, blank long, duplicate long, truncated long, illegal long")


def _legal(a: str, b: str) -> bool:
    return a[:1] + b[:1] in ("su", "ua", "au")


def pieces(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Pieces of conversations with their tables, one row each; ``(part, no)``
    puts those of a conversation in order."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*_ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = pa.int64()

        def typed():
            nonlocal ids
            for batch in batches:
                ids = batch.schema.field("conv_id").type
                yield batch

        part = TaskContext.get().partitionId()
        done: list[tuple] = []

        def emit() -> pa.RecordBatch:
            cols = list(zip(*done))
            types = [ids, pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()),
                     pa.list_(pa.int64()), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            names = ["conv_id", *(f.split()[0] for f in _PIECE.split(", "))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        def close(conv, no, own):
            kinds, roles, texts, counts = bytearray(), [], [], [0, 0, 0, 0]
            for role, text, copies, seen, blank, cut in own:
                if roles and not _legal(roles[-1], role):
                    counts[3] += 1
                counts[3] += copies - 1               # copies repeat the initial
                counts[0] += copies * blank
                counts[1] += 0 if blank else copies - (not seen)
                counts[2] += not blank and not seen and cut
                kinds += bytes([row_type(role[:1], blank or seen, cut)]) + bytes([GONE]) * (copies - 1)
                roles += [role] * copies              # the list holds one string object
                texts += [text if i == 0 else "" for i in range(copies)]
            costs, orders = summary(bytes(kinds))
            done.append((conv, part, no, bytes(kinds), roles, texts, costs, orders, roles[0], roles[-1], *counts))

        def segments(rows):
            """Rows of at most ``piece_rows`` copies; what is split off is seen already."""
            for _, role, text, copies, seen, blank, cut in rows:
                for at in range(0, copies, piece_rows):
                    yield role, text, min(copies - at, piece_rows), seen or at > 0, blank, cut

        chars = 0
        for conv, rows in groupby(_rows(typed(), _ROW), key=lambda r: r[0]):
            no, own, n, size = 0, [], 0, 0
            for row in segments(rows):
                own.append(row)
                n, size = n + row[2], size + len(row[1])
                if n >= piece_rows or size >= PIECE_CHARS:
                    close(conv, no, own)
                    no, own, n, size, chars = no + 1, [], 0, 0, chars + size
            if own:
                close(conv, no, own)
                chars += size
            if len(done) >= 500 or chars >= PIECE_CHARS:
                yield emit()
                done.clear()
                chars = 0
        if done:
            yield emit()

    return map_partition(placed, run, f"conv_id {kind}, {_PIECE}")


def meetings(cut: DataFrame) -> DataFrame:
    """``(conv_id, part, no, start, end)`` of every piece on the cheapest path, and
    in the first piece's row the cost and the pairs of rows that meet illegally."""
    kind = cut.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "part", "no", "costs", "orders", "first", "last"]
    placed = cut.select(*names).repartition("conv_id").sortWithinPartitions("conv_id", "part", "no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = pa.int64()

        def typed():
            nonlocal ids
            for batch in batches:
                ids = batch.schema.field("conv_id").type
                yield batch

        def emit(out: list[tuple]) -> pa.RecordBatch:
            types = [ids, *[pa.int32()] * 4, pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                              ["conv_id", "part", "no", "start", "end", "cost", "meet"])

        out: list[tuple] = []
        square = lambda flat: [flat[i:i + 4] for i in range(0, 16, 4)]
        for conv, own in groupby(_rows(typed(), names), key=lambda r: r[0]):
            own = list(own)                          # a table a piece
            tables = [(square(r[3]), square(r[4])) for r in own] + [_ranked(END)]
            costs, order = _forward(tables, NOTHING)
            end = min((costs[s], order[s], s) for s in FINAL)[2]
            states = _crossings(tables, NOTHING, end)
            meet = sum(not _legal(a[6], b[5]) for a, b in zip(own, own[1:]))
            for i, r in enumerate(own):
                out.append((*r[:3], states[i - 1] if i else NOTHING, states[i], *((costs[end], meet) if not i else (0, 0))))
            if len(out) >= 5000:
                yield emit(out)
                out = []
        if out:
            yield emit(out)

    return map_partition(placed, run, f"conv_id {kind}, part int, no int, start int, end int, cost long, meet long")


def _solved(joined: DataFrame) -> DataFrame:
    """Pieces with their audit, final state and repaired lines."""
    kind = joined.schema["conv_id"].dataType.simpleString()
    keep = ["conv_id", "part", "no", "cost", "meet", "blank", "duplicate", "truncated", "illegal", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            audits, lines = [], []
            for kinds, roles, texts, start, end in _rows(iter([batch]), ["kinds", "roles", "texts", "start", "end"]):
                letters, before = audit_path(kinds, start, end)
                audits.append("".join(letters))
                lines.append("\n".join(repaired_lines(roles, texts, letters, before)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), pa.array(audits, pa.string()), pa.array(lines, pa.string())],
                [*keep, "audit", "lines"])

    return map_partition(joined, run, f"conv_id {kind}, part int, no int, cost long, meet long, blank long, duplicate long, "
                         "truncated long, illegal long, end int, audit string, lines string")


def _folded(solved: DataFrame) -> DataFrame:
    """One row per conversation, from a stream over its pieces in order."""
    kind = solved.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "cost", "meet", "blank", "duplicate", "truncated", "illegal", "end", "audit", "lines"]
    placed = solved.repartition("conv_id").sortWithinPartitions("conv_id", "part", "no").select(*names)
    out_names = ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = pa.int64()

        def typed():
            nonlocal ids
            for batch in batches:
                ids = batch.schema.field("conv_id").type
                yield batch

        def emit(out: list[tuple]) -> pa.RecordBatch:
            types = [ids, *[pa.int64()] * 5, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], out_names)

        out: list[tuple] = []
        for conv, own in groupby(_rows(typed(), names), key=lambda r: r[0]):
            digest, audit, sums, state, begun = hashlib.sha256(), [], np.zeros(5, dtype=np.int64), NOTHING, False
            for _, cost, meet, blank, duplicate, truncated, illegal, state, letters, lines in own:
                sums += (blank, duplicate, truncated, illegal + meet, cost)
                audit.append(letters)
                if lines:                            # a line has a colon at least
                    digest.update((("\n" if begun else "") + lines).encode())
                    begun = True
            while state not in FINAL:                # turns inserted at the end
                audit.append("I")
                state = NEXT[state]
                digest.update((("\n" if begun else "") + ROLE[state] + ":").encode())
                begun = True
            out.append((conv, *sums.tolist(), "".join(audit), digest.hexdigest()))
            if len(out) >= 500:
                yield emit(out)
                out = []
        if out:
            yield emit(out)

    return map_partition(placed, run, f"conv_id {kind}, blank long, duplicate long, truncated long, illegal long, cost long, "
                         "audit string, repaired_sha256 string")


def repair(turns: DataFrame, rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row per ``conv_id`` of ``turns``: faults and cheapest repair of its
    ``rows (conv_id, turn, role, text, copies)``.

    Rows are in the order of turn (nulls first), ties in the order of role and
    text; equal rows are one row with ``copies``.  Null ids are one conversation.
    A conversation without rows has zeros, an empty audit and the digest of the
    empty text; an empty table gives none; other columns are ignored.
    """
    rows = materialize(rows, "damaged")
    cut = materialize(pieces(faults(rows), piece_rows), "pieces")
    met = materialize(meetings(cut), "meetings")
    joined = cut.drop("costs", "orders", "first", "last").withColumnRenamed("conv_id", "c").join(
        met, F.col("c").eqNullSafe(F.col("conv_id")) & (cut["part"] == met["part"]) & (cut["no"] == met["no"])).select(
        met["conv_id"], met["part"], met["no"], "kinds", "roles", "texts", "start", "end", "cost", "meet",
        "blank", "duplicate", "truncated", "illegal")
    found = _folded(_solved(joined)).withColumnRenamed("conv_id", "f")
    wide = lambda c: c.cast("decimal(20,0)")
    gaps = rows.groupBy(F.col("conv_id").alias("g")).agg(
        (wide(F.max("turn")) - wide(F.min("turn")) + 1 - F.count_distinct("turn")).try_cast("long").alias("gaps"),
        F.count("turn").alias("known"))
    convs = turns.select("conv_id").distinct()
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    return convs.join(found, F.col("conv_id").eqNullSafe(F.col("f")), "left").join(
        gaps, F.col("conv_id").eqNullSafe(F.col("g")), "left").select(
        "conv_id", F.when(F.coalesce("known", F.lit(0)) == 0, 0).otherwise(F.col("gaps")).cast("long").alias("gaps"),
        *(zero(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_repair(spark, sf_dir) -> DataFrame:
    """Contract query: all of ``conversations``, damaged and repaired."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair(turns, damage(turns))


_CRC = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({s}, ''), lambda ch: CAST(ord(ch) AS BIGINT))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
        lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"""
_ID = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
_SQL = """
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor({crc}, 4294967295) % 20 AS fault FROM conversations),
dam AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM raw),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn,
         regexp_extract(text, '[^\x20\x09-\x0D]?[\x20\x09-\x0D]*$') AS tail FROM dam),
typed AS (
  SELECT *, left(role, 1) AS ini, regexp_full_match(text, '[\x20\x09-\x0D]*') AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 AS seen,
         left(tail, 1) NOT IN ('.', '!', '?') AS cut,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY rn) AS prev FROM placed),
marked AS (SELECT *, blank OR seen AS gone, NOT blank AND NOT seen AND cut AS late FROM typed),
ins(p, q, cost, audit, lines) AS (VALUES
  (0, 0, 0, '', ''), (0, 2, 2, 'I', E'user:\n'), (0, 3, 4, 'II', E'user:\nassistant:\n'),
  (1, 1, 0, '', ''), (1, 2, 2, 'I', E'user:\n'), (1, 3, 4, 'II', E'user:\nassistant:\n'),
  (2, 2, 0, '', ''), (2, 3, 2, 'I', E'assistant:\n'), (2, 2, 4, 'II', E'assistant:\nuser:\n'),
  (3, 3, 0, '', ''), (3, 2, 2, 'I', E'user:\n'), (3, 3, 4, 'II', E'user:\nassistant:\n')),
act(p, q, ini, retag) AS (VALUES (0, 1, 's', false), (0, 2, 'u', true), (1, 2, 'u', true), (2, 3, 'a', true), (3, 2, 'u', true)),
it AS (
  SELECT c.conv_id, CAST(0 AS BIGINT) AS rn, 0 AS p, {{'cost': 0, 'audit': '', 'lines': ''}} AS best
  FROM (SELECT DISTINCT conv_id FROM conversations) c
  UNION ALL
  SELECT conv_id, rn, p, min(best) AS best FROM (
    SELECT it.conv_id, m.rn, ins.q AS p, {{'cost': it.best.cost + ins.cost + 3, 'audit': it.best.audit || ins.audit || 'D',
           'lines': it.best.lines || ins.lines}} AS best
    FROM it JOIN ins ON ins.p = it.p JOIN marked m ON m.conv_id IS NOT DISTINCT FROM it.conv_id AND m.rn = it.rn + 1
    UNION ALL
    SELECT it.conv_id, m.rn, act.q, {{'cost': it.best.cost + ins.cost + CASE WHEN act.ini = m.ini THEN 0 ELSE 2 END + CAST(m.late AS INTEGER),
           'audit': it.best.audit || ins.audit || CASE WHEN act.ini = m.ini THEN 'K' ELSE 'R' END,
           'lines': it.best.lines || ins.lines || CASE WHEN act.ini = m.ini THEN m.role WHEN act.ini = 'u' THEN 'user' ELSE 'assistant' END
               || ':' || m.text || E'\n'}}
    FROM it JOIN ins ON ins.p = it.p JOIN marked m ON m.conv_id IS NOT DISTINCT FROM it.conv_id AND m.rn = it.rn + 1
    JOIN act ON act.p = ins.q WHERE NOT m.gone AND (act.retag OR act.ini = m.ini)) GROUP BY conv_id, rn, p),
last AS (SELECT conv_id, max(rn) AS n FROM it GROUP BY conv_id),
final AS (
  SELECT it.conv_id, min({{'cost': it.best.cost + ins.cost, 'audit': it.best.audit || ins.audit, 'lines': it.best.lines || ins.lines}}) AS best
  FROM it JOIN last ON last.conv_id IS NOT DISTINCT FROM it.conv_id AND last.n = it.rn JOIN ins ON ins.p = it.p WHERE ins.q IN (0, 3)
  GROUP BY it.conv_id),
stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
         count_if(seen AND NOT blank) AS duplicate, count_if(late) AS truncated,
         count_if(prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id)
SELECT f.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(best.cost AS BIGINT) AS cost, best.audit AS audit,
       sha256(CASE WHEN best.lines = '' THEN '' ELSE left(best.lines, length(best.lines) - 1) END) AS repaired_sha256
FROM final f LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM f.conv_id"""
OP13_SQL = _SQL.format(crc=_CRC.format(s=_ID))
