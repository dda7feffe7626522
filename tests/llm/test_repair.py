"""Conversation repair against plain versions: every path, and the SQL."""

import itertools
import random

import duckdb
import pytest

from linearspark.llm import repair as R

from .conftest import assert_same_rows


def plain(rows):
    """Cheapest, then least audit of ``rows (initial, gone, truncated)``: every path
    with up to two inserts before a row."""
    paths = [(0, "", R.NOTHING)]
    for initial, gone, late in rows:
        new = []
        for cost, audit, state in paths:
            for _ in range(3):
                new.append((cost + R.DROP, audit + "D", state))
                if not gone:
                    if initial == "s" and state == R.NOTHING:
                        new.append((cost + late, audit + "K", R.SYSTEM))
                    after = R.NEXT[state]
                    same = initial == R.ROLE[after][0]
                    new.append((cost + late + (0 if same else R.RETAG), audit + ("K" if same else "R"), after))
                cost, audit, state = cost + R.ADD, audit + "I", R.NEXT[state]
        paths = new
    ends = [(cost + n * R.ADD, audit + "I" * n) for cost, audit, state in paths for n in range(3)
            if (state if n == 0 else R.NEXT[state] if n == 1 else R.NEXT[R.NEXT[state]]) in R.FINAL]
    return min(ends)


def whole(rows, sizes):
    """The operator's way: tables of pieces, meetings, then each piece alone."""
    kinds = [R.row_type(i, g, t) for i, g, t in rows]
    parts, at = [], 0
    for n in sizes:
        if kinds[at:at + n]:
            parts.append(bytes(kinds[at:at + n]))
        at += n
    square = lambda flat: [flat[i:i + 4] for i in range(0, 16, 4)]
    tables = [tuple(map(square, R.summary(p))) for p in parts] + [R._ranked(R.END)]
    costs, order = R._forward(tables, R.NOTHING)
    end = min((costs[s], order[s], s) for s in R.FINAL)[2]
    states = R._crossings(tables, R.NOTHING, end)
    audit = "".join("".join(R.audit_path(p, states[i - 1] if i else R.NOTHING, states[i])[0]) for i, p in enumerate(parts))
    state = states[-2] if parts else R.NOTHING
    while state not in R.FINAL:
        audit, state = audit + "I", R.NEXT[state]
    return costs[end], audit


def test_every_short_conversation():
    kinds = [("s", False, False), ("u", False, True), ("u", False, False), ("a", False, False), ("x", False, False), ("u", True, False)]
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            assert whole(rows, [n]) == plain(rows), rows


def test_pieces_of_any_size():
    dice = random.Random(3)
    for _ in range(150):
        rows = [(dice.choice("suax"), dice.random() < 0.2, dice.random() < 0.4) for _ in range(dice.randint(4, 6))]
        assert whole(rows, [dice.randint(1, 3) for _ in range(6)]) == plain(rows), rows


ROWS = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hello."), (1, 2, "assistant", "Hi!"), (1, 2, "assistant", "Hi!"),
        (1, 3, "user", "and then"), (1, 4, "assistant", "  "), (1, 5, "tool", "x?"), (1, 9, "user", "Hello."),
        (None, None, None, None), (None, None, "user", "no id."), (None, 2, "assistant", None), (None, 7, "user", "a\nb."),
        (2, 5, "", ""), (3, 1, "assistant", "first."), (3, 1, "assistant", "first"), (3, 1, "user", "É. \t\n"), (3, None, "system", "S."),
        *[(4, t % 13, ("user", "assistant", "system", "user")[t % 4], f"t{t % 17}" + ".!? x"[t % 5]) for t in range(90)],
        *[(5, 3, "user", "same.")] * 25, *[(c, t, "u", "one.") for c in range(10, 40) for t in range(2)]]


@pytest.mark.parametrize("piece_rows", [3, R.PIECE_ROWS])
def test_odd_tables_match_sql(spark, tmp_path, piece_rows):
    schema = "conv_id long, turn long, role string, text string, cost string, audit string, c string, part int"
    turns = spark.createDataFrame([(*r, "x", "y", "z", 1) for r in ROWS], schema)
    turns.write.parquet(str(tmp_path / "c"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/c/*.parquet')")
    assert_same_rows(R.repair(turns, R.damage(turns), piece_rows), con, R.OP13_SQL)


def test_empty_table(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert R.repair(turns, R.damage(turns)).count() == 0


def test_hot_conversation_is_cut(spark):
    """One long conversation with texts of its own meets in no single piece."""
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(500)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    folded = turns.selectExpr("*", "1L AS copies")
    cut = R.pieces(R.faults(folded), 16)
    assert cut.count() >= 500 // 16
    got = R.repair(turns, folded, 16).first()
    assert (got["cost"], got["audit"]) == (0, "K" * 500)
