"""Registry of named questions: a function over ``Tables`` and, where SQL can say the same, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ravelin.sources.tables import Tables

QUESTIONS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def question(name: str, sql: str | None = None):
    def register(f: Callable[[Tables], DataFrame]):
        if name in QUESTIONS:
            raise ValueError(f"{name} is registered twice")
        QUESTIONS[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            SQL[name] = sql
        return f

    return register


#: SQL of the views in ``Tables``.
RECORDS = """(SELECT l.*, o.*, date_trunc('month', l_shipdate)::DATE AS period, date_trunc('month', o_orderdate)::DATE AS cohort,
 ((year(l_shipdate) - year(o_orderdate)) * 12 + month(l_shipdate) - month(o_orderdate))::INT AS age FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey)"""
TREE = "(SELECT 'r:' || n_regionkey AS parent, 'n:' || n_nationkey AS child FROM nation UNION ALL SELECT 'n:' || c_nationkey, 'c:' || c_custkey FROM customer)"
BOM = "(SELECT p_partkey // 3 AS parent, p_partkey AS child, (1 + p_size % 4)::BIGINT AS qty FROM part WHERE p_partkey > 0)"
DAG = f"(SELECT parent, child FROM {BOM} UNION SELECT p_partkey // 5, p_partkey FROM part WHERE p_partkey % 7 = 0 AND p_partkey > 0)"
#: The ordered three-letter pieces of a text's words, and the similarity of every name with every text by the larger of both measures.
GRAMS = "flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: ('  ' || w || ' ')[i:i + 2])))".format
_RUN = "len(list_intersect(list_distinct({0}), q)) / (len(q) + len(list_distinct({0})) - len(list_intersect(list_distinct({0}), q)))".format


def near_names_sql(asked: str, names: str, name: str, floor: float) -> str:
    best = f"list_max(list_transform(range(1, len(o) + 1), lambda a: list_max(list_transform(range(a, len(o) + 1), lambda b: {_RUN('o[a:b]')}))))"
    return f"(SELECT * FROM (SELECT id, {name}, greatest({_RUN('o')}, {best}) AS similarity FROM (SELECT id, list_distinct({GRAMS('asked')}) AS q FROM {asked}), (SELECT DISTINCT {name}, {GRAMS(name)} AS o FROM {names})) WHERE similarity >= {floor})"


def _written(cases: list[str], key: str) -> str:
    return f"CASE {key} % {len(cases)} " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(cases)) + " END"


_Y, _M, _D = (f"cast({f}(o_orderdate) AS string)" for f in ("year", "month", "day"))
_M2, _D2 = f"lpad({_M}, 2, '0')", f"lpad({_D}, 2, '0')"
_ISO = f"{_Y} || '-' || {_M2} || '-' || {_D2}"
#: The dates of orders as people write them, some of them wrong (an expression for both engines), and numbers of parts likewise.
ODD_DATES = _written([_ISO, f"{_Y} || {_M2} || {_D2}", f"{_Y} || '-' || {_M} || '-' || {_D}", "''", "NULL", f"{_ISO} || 'T12:00'", f"'x' || {_Y}", f"{_Y} || '.' || {_M} || '.' || {_D}", f"{_Y} || '/' || {_M2}", f"{_Y} || '.' || {_M} || '.' || {_D} || ' 13:05'", f"' ' || {_ISO} || ' '", f"{_Y} || '-13-01'", f"{_ISO} || ' 25:00'", f"{_ISO} || 'T12:00:07Z'", f"{_Y} || '-02-30'"], "o_orderkey")
_SIZE = "cast(p_size AS string)"
ODD_VALUES = _written([_SIZE, f"'-' || {_SIZE} || '.50'", f"{_SIZE} || 'e5'", "''", "NULL", "substr(p_name, 1, 1)", f"{_SIZE} || '.'", "'yes'", "'TRUE'", "'null'", f"'AB-' || {_SIZE}", "' ' || upper(p_name) || '  x '", f"'Ｆｕｌｌ　Ｗｉｄｅ' || {_SIZE}", "'１２'"], "p_partkey")
DATES, VALUES = f"(SELECT o_orderkey AS id, {ODD_DATES} AS v FROM orders) AS d", f"(SELECT p_partkey AS id, {ODD_VALUES} AS v FROM part) AS d"
