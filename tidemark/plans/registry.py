"""A registry of named queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating columns rounded, and -0 made 0, for comparison between engines."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


#: Data points of the events table, for SQL.
POINTS = """points AS (
  SELECT event_id AS id, epoch_us(ts) AS us, event_type AS measurement_id,
    CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS DOUBLE) AS value, value AS price,
    CAST(user_id % 8 AS DOUBLE) AS atr, CAST(user_id AS DOUBLE) AS ctx_user
  FROM events
)"""
#: Movements of the line items, for SQL.
MOVES = """moves AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id, epoch_us(l_shipdate) AS us,
    l_quantity AS value, (l_extendedprice - 52500) / 30000 + (l_quantity - 25) / 25 AS move, l_returnflag AS flag
  FROM lineitem
)"""


def asof(horizon_us: int, by: str = "", source: str = "points", name: str = "mv") -> str:
    """Movements of ``source`` by DuckDB's own as-of join; ``by`` names the series column."""
    first = f"(SELECT *, row_number() OVER (PARTITION BY us{', ' + by if by else ''} ORDER BY id) AS k FROM {source})"
    return f"""{name} AS (
  SELECT p.*, {horizon_us} AS horizon, f.us AS next_us, f.id AS next_id, (f.price - p.price) / p.atr AS move
  FROM {source} p ASOF JOIN (SELECT * FROM {first} WHERE k = 1) f
    ON {f'p.{by} = f.{by} AND ' if by else ''}p.us + {horizon_us} <= f.us
  WHERE p.atr <> 0
)"""


#: r, 0 where a side is constant.
R = "coalesce(covar_pop(value, move) / nullif(stddev_pop(value) * stddev_pop(move), 0), 0)"


def p_value(r: str, n: str) -> str:
    """SQL of the stepwise p of a correlation."""
    from ..functions.stats import ERF, ERF_P, T_CRITICAL

    t = f"(abs({r}) / sqrt((1 - {r} * {r}) / greatest({n} - 2, 1)))"
    e = f"(1 / (1 + {ERF_P} * {t} / sqrt(2.0)))"
    poly = " + ".join(f"({c}) * pow({e}, {i + 1})" for i, c in enumerate(ERF))
    normal = f"({poly}) * exp(-{t} * {t} / 2)"
    keys = sorted(T_CRITICAL)
    crit = "CASE " + " ".join(
        f"WHEN ({n} - 2) * 2 <= {a + b} THEN {T_CRITICAL[a]}" for a, b in zip(keys, keys[1:], strict=False)
    ) + f" ELSE {T_CRITICAL[keys[-1]]} END"
    c = f"({crit})"
    return f"""CASE WHEN {n} < 3 THEN 1.0 WHEN abs({r}) >= 0.99999 THEN 0.0001 WHEN {n} - 2 >= 100 THEN {normal}
      WHEN {t} >= {c} * 2 THEN 0.001 WHEN {t} >= {c} * 1.5 THEN 0.01 WHEN {t} >= {c} THEN 0.05
      WHEN {t} >= {c} * 0.8 THEN 0.10 WHEN {t} >= {c} * 0.6 THEN 0.20
      ELSE least(1.0, 0.20 + 0.80 * (1 - {t} / ({c} * 0.6))) END"""
