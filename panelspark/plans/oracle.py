"""Oracle SQL building blocks (DuckDB): the panels as WITH clauses."""

from __future__ import annotations

BARS = """
bars_{p} AS (
  SELECT l_suppkey AS entity, CAST({trunc} AS DATE) AS date,
         first(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber,
               l_extendedprice / l_quantity) AS open,
         max(l_extendedprice / l_quantity) AS high,
         min(l_extendedprice / l_quantity) AS low,
         last(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber,
              l_extendedprice / l_quantity) AS close,
         sum(l_quantity) AS volume, round(sum(l_extendedprice), 2) AS dollar_volume,
         count(*) AS n_trades
  FROM lineitem GROUP BY 1, 2)"""

WEEK_BARS = BARS.format(p="w", trunc="date_trunc('week', l_shipdate)")
DAY_BARS = BARS.format(p="d", trunc="date_trunc('day', l_shipdate)")

CLASSES = """
classes AS (
  SELECT s_suppkey AS entity,
         CASE WHEN s_suppkey % 17 <> 0 THEN s_nationkey END AS industry,
         CASE WHEN s_suppkey % 17 <> 0 THEN n_regionkey END AS sector
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

PANEL_BODY = """
panel AS (
  SELECT *, CASE WHEN (entity + week(date)) % 11 <> 0 THEN ret END AS sig
  FROM (SELECT b.*, c.industry, c.sector,
               ln(close) - ln(lag(close) OVER (PARTITION BY b.entity ORDER BY date)) AS ret
        FROM bars_w b JOIN classes c ON b.entity = c.entity))"""

MARKET = """
market AS (
  SELECT date, sum(ret * dollar_volume) / sum(dollar_volume) AS mkt
  FROM panel WHERE ret IS NOT NULL GROUP BY date),
mpanel AS (SELECT p.*, m.mkt FROM panel p LEFT JOIN market m ON p.date = m.date)"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts)


PANEL = with_(WEEK_BARS, CLASSES, PANEL_BODY)
MPANEL = with_(WEEK_BARS, CLASSES, PANEL_BODY, MARKET)
DAILY = with_(DAY_BARS, CLASSES)


def more(prefix: str, *ctes: str) -> str:
    """``prefix`` with further common table expressions."""
    return ",".join((prefix, *ctes))
