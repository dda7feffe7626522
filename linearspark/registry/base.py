"""Registry of named queries and their DuckDB oracle SQL.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the driver's tables;
its oracle (when SQL can express it) is an independent SQL text over the same
tables.  Both round reported doubles to 6 places.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
SMALL_ORACLE: dict[str, str] = {}   # SQL too slow for whole tables: run by the tests on the smallest ones

# The queries compare margins with 0 and 1 at this many places, like their SQL:
# the fixed weights make margins of exactly 0 or 1 common, and two engines sum
# in different orders.  The operators themselves use the raw margin by default.
MARGIN_DIGITS = 9


def query(name: str, sql: str | None = None, small_sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        if small_sql is not None:
            SMALL_ORACLE[name] = small_sql
        return fn
    return deco


# ------------------------------------------------------------------ SQL parts
# Derived datasets, written independently of the Spark code.

EX_ORDERS = """ex AS (SELECT o_orderkey AS id,
    CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END AS INTEGER) AS y FROM orders)"""

FEAT_ORDERS = """fo AS (
    SELECT l_orderkey AS id, l_suppkey + 1 AS k, sum(l_quantity) / 50.0 AS v
    FROM lineitem GROUP BY l_orderkey, l_suppkey + 1
    UNION ALL
    SELECT o_orderkey AS id, CAST(0 AS BIGINT) AS k, CAST(1 AS DOUBLE) AS v FROM orders)"""

EX_DOCS = """exd AS (SELECT doc_id AS id,
    CAST(CASE WHEN quality = 1 THEN 1 ELSE -1 END AS INTEGER) AS y FROM labels)"""

FEAT_DOCS = r"""toks0 AS (
    SELECT doc_id AS id, unnest(regexp_split_to_array(text, '[ \t\n\r]+')) AS tok FROM documents),
toks AS (SELECT id, tok, count(*) OVER (PARTITION BY id) AS n FROM toks0 WHERE tok <> ''),
fd AS (
    SELECT id, k, c / n AS v FROM (
        SELECT id, CAST(('0x' || substr(md5(tok), 1, 12))::UBIGINT AS BIGINT) + 1 AS k, n,
               count(*) AS c
        FROM toks GROUP BY ALL)
    UNION ALL
    SELECT doc_id AS id, CAST(0 AS BIGINT) AS k, CAST(1 AS DOUBLE) AS v FROM documents)"""

TOPICS = """tp AS (SELECT event_type AS topic, CAST(floor(event_id / 4) AS BIGINT) AS doc_id FROM events)"""

POINTS = """pt AS (SELECT vec_id AS id,
    CASE WHEN label < 5 THEN CAST(1 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END AS y,
    CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"""

LOSS_EVENTS = """le AS (SELECT CAST(user_id % 4 AS INTEGER) AS worker_idx, event_id, value AS loss, ts FROM events)"""

DELTAS = """dl AS (SELECT l_linenumber AS worker, l_suppkey + 1 AS k, l_discount - l_tax AS d FROM lineitem)"""

RUNS = """runs AS (
    SELECT o_custkey AS run_id,
        CASE WHEN 2 * sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) >= count(*)
             THEN 'synchronous' ELSE 'asynchronous' END AS running_mode,
        CAST(o_custkey % 15 + 1 AS INTEGER) AS n_workers,
        sum(CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END) / count(*) AS accuracy_test,
        sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) / count(*) AS accuracy_train,
        min(o_orderdate) AS start_time, max(o_orderdate) AS end_time
    FROM orders GROUP BY o_custkey)"""


def fixed_w(k: str) -> str:
    return f"(CAST((({k}) * 37) % 11 - 5 AS DOUBLE) / 10)"


def h(seed, *parts: str) -> str:
    """md5 of 'seed:part:...' (parts are SQL expressions)."""
    items = [f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts]
    return "md5(" + " || ':' || ".join(items) + ")"


def _rhu(x: str, digits: int) -> str:
    scale = f"CAST({float(10 ** digits)!r} AS DOUBLE)"
    v = f"({x})"
    return (f"(CASE WHEN isnan({v}) OR abs({v}) = CAST('inf' AS DOUBLE) THEN {v} "
            f"ELSE CAST(floor({v} * {scale} + 0.5) AS DOUBLE) / {scale} END)")


def r6(x: str) -> str:
    """Same IEEE rounding as ``functions.out``."""
    return f"({_rhu(x, 6)} + 0.0)"


def r9(x: str) -> str:
    return _rhu(x, MARGIN_DIGITS)


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
