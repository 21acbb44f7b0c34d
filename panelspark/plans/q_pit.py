"""Point-in-time joins and quarterly fundamentals, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pit
from ..operators import rolling as ts
from ..operators.crosssection import CrossSection
from ..operators.splits import calendar
from ..operators.universe import month_anchors
from ..sources import companies as co
from ..sources.tables import (
    daily_bars, market_panel, market_series, names_bound, table, weekly_bars, weekly_panel,
)
from .oracle import CLASSES, DAY_BARS, MPANEL, PANEL, WEEK_BARS, more, with_
from .registry import query

KEY = "date entity# "
FACTS = "facts AS (SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS d, year(l_shipdate) AS y, quarter(l_shipdate) AS qt, * FROM lineitem)"
LINKS = """links AS (SELECT entity, printf('%06d', CAST(entity + l_linenumber * 13 AS BIGINT)) AS gvkey, min(d) AS link_from, max(d) AS link_thru,
  CASE WHEN l_linenumber % 4 = 3 THEN 'NR' ELSE 'LC' END AS link_type, CASE WHEN y % 3 = 0 THEN 'J' ELSE 'P' END AS link_prim
  FROM facts WHERE (entity + l_linenumber * 3 + y) % 5 < 2 GROUP BY entity, l_linenumber, y),
vlinks AS (SELECT * FROM links WHERE link_type IN ('LC', 'LU') AND link_prim IN ('P'))"""
SECTORS = """sectors AS (SELECT printf('%06d', CAST(entity + l_linenumber * 13 AS BIGINT)) AS gvkey,
  CASE WHEN entity % 10 <> 0 THEN 10 + 5 * (entity % 11) END AS sector, entity, min(d) AS ind_from, max(d) AS ind_thru
  FROM facts WHERE y % 2 = entity % 2 GROUP BY 1, 2, 3, y)"""
SPELLS = """spells AS (SELECT entity, min(date) AS spell_start, max(date) AS spell_end FROM (
  SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY date) AS g FROM (
    SELECT entity, date, CASE WHEN date - lag(date) OVER (PARTITION BY entity ORDER BY date) <= 28 THEN 0 ELSE 1 END AS new
    FROM bars_w WHERE n_trades >= 2)) GROUP BY entity, g)"""
INFO = """info AS (SELECT entity, info_start, info_end, CAST(floor(entity / 2) AS BIGINT) AS company, 'T' || entity || 'Y' || (y % 100) AS ticker FROM (
  SELECT entity, year(date) AS y, min(date) AS info_start, max(date) AS info_end FROM bars_w WHERE entity % 13 <> 5 GROUP BY 1, 2) WHERE (entity + y) % 6 <> 0)"""
QUARTERS = """income AS (SELECT gvkey, fyearq, fqtr, saleq, CASE WHEN gvkey % 9 <> 0 THEN cogsq END AS cogsq, ibq,
    CASE WHEN (gvkey + fyearq + fqtr) % 8 <> 0 THEN round(sum(ocf) OVER (PARTITION BY gvkey, fyearq ORDER BY fqtr), 4) END AS oancfy FROM (
  SELECT entity AS gvkey, y AS fyearq, qt AS fqtr, round(sum(l_extendedprice), 2) AS saleq, round(sum(l_extendedprice * l_discount), 4) AS cogsq,
    round(sum(l_extendedprice * (l_tax - 0.035)), 5) AS ibq, round(sum(l_extendedprice * (l_tax - l_discount)), 4) AS ocf FROM facts GROUP BY 1, 2, 3)),
balance AS (SELECT * REPLACE (CASE WHEN k % 4 <> 0 THEN seqq END AS seqq, CASE WHEN k % 8 <> 0 THEN ceqq END AS ceqq,
    CASE WHEN k % 3 <> 0 THEN txditcq END AS txditcq, CASE WHEN k % 5 <> 0 THEN ivaoq END AS ivaoq, CASE WHEN k % 6 <> 0 THEN mibq END AS mibq) FROM (
  SELECT entity AS gvkey, y AS fyearq, qt AS fqtr, entity + y * 4 + qt AS k, sum(l_quantity) * 1000 AS atq, """ + ", ".join(
    f"sum(CASE WHEN {c} THEN l_quantity ELSE 0 END) * {s} AS {n}" for n, c, s in (
        ("actq", "l_linenumber <= 4", 900), ("cheq", "l_linenumber = 1", 500), ("lctq", "l_returnflag = 'R'", 600),
        ("dlcq", "l_linenumber = 2", 100), ("dlttq", "l_returnflag = 'A'", 300), ("ltq", "l_returnflag <> 'N'", 700),
        ("ceqq", "l_returnflag = 'N'", 800), ("seqq", "l_linenumber >= 3", 700), ("pstkq", "l_linenumber = 7", 50),
        ("txditcq", "l_linenumber = 6", 40), ("ivaoq", "l_linenumber = 5", 30), ("ivstq", "l_linenumber = 4", 20),
        ("mibq", "l_linenumber = 3", 10))) + """ FROM facts GROUP BY 1, 2, 3)),
filings AS (SELECT gvkey, period_end, source_type, CAST(period_end + CAST(20 + (gvkey * 5 + month(period_end) * 11 + ascii(source_type) * 3) % 80 AS INT) AS DATE) AS filed
  FROM (SELECT DISTINCT entity AS gvkey, last_day(make_date(y, qt * 3, 1)) AS period_end, l_returnflag AS source_type FROM facts)
  WHERE (gvkey + month(period_end) * 2) % 7 <> 0),
first_filings AS (SELECT gvkey, period_end, min(filed) AS first_filing FROM filings WHERE source_type IN ('A', 'R') GROUP BY 1, 2),
quarters AS (SELECT i.*, b.* EXCLUDE (gvkey, fyearq, fqtr, k), p.period_end, p.rdq_date, f.first_filing, i.fyearq * 4 + i.fqtr - 1 AS fq_index,
    CASE WHEN i.fqtr = 1 THEN oancfy WHEN lag(i.fqtr) OVER w = i.fqtr - 1 THEN oancfy - lag(oancfy) OVER w END AS oancfq
  FROM income i JOIN balance b ON b.gvkey = i.gvkey AND b.fyearq = i.fyearq AND b.fqtr = i.fqtr
  JOIN (SELECT *, CASE WHEN (gvkey + fyearq + fqtr) % 9 <> 0 THEN CAST(period_end + CAST(15 + (gvkey * 7 + fqtr * 13 + fyearq) % 60 AS INT) AS DATE) END AS rdq_date
        FROM (SELECT gvkey, fyearq, fqtr, last_day(make_date(fyearq, fqtr * 3, 1)) AS period_end FROM income)) p
    ON p.gvkey = i.gvkey AND p.fyearq = i.fyearq AND p.fqtr = i.fqtr
  LEFT JOIN first_filings f ON f.gvkey = i.gvkey AND f.period_end = p.period_end
  WINDOW w AS (PARTITION BY i.gvkey, i.fyearq ORDER BY i.fqtr)),
cal AS (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT date FROM bars_d)),
avails AS (SELECT q.*, anchor, rule AS anchor_rule, (SELECT min(date) FROM cal WHERE date > anchor) AS avail,
    CASE WHEN rdq_date IS NOT NULL THEN (SELECT min(date) FROM cal WHERE date > rdq_date) ELSE (SELECT min(date) FROM cal WHERE date > anchor) END AS avail_rdq
  FROM (SELECT *, coalesce(greatest(rdq_date, first_filing), CAST(period_end + 90 AS DATE)) AS anchor,
     CASE WHEN rdq_date IS NOT NULL AND first_filing IS NOT NULL THEN 'later_of_rdq_and_filing' WHEN rdq_date IS NOT NULL THEN 'rdq_only'
          WHEN first_filing IS NOT NULL THEN 'filing_only' ELSE 'period_end_plus_lag' END AS rule FROM quarters) q)"""

W_LINKS = with_(WEEK_BARS, CLASSES, FACTS, LINKS, SECTORS, SPELLS, INFO)
W_QUARTERS = with_(WEEK_BARS, DAY_BARS, FACTS, QUARTERS)
TYPES, PRIMS = ("LC", "LU"), ("P",)


def vlinks(spark, sf):
    return pit.valid_links(co.link_history(spark, sf), "link_type", TYPES, "link_prim", PRIMS, "entity")


def weeks(spark, sf):
    return weekly_bars(spark, sf).select("date", "entity", "close", "volume", "n_trades")


def quarters(spark, sf):
    q = pit.assemble_quarters(co.period_descriptor(spark, sf), [co.income_statement(spark, sf), co.balance_sheet(spark, sf)],
                              co.filings(spark, sf), ("A", "R"))
    return pit.ytd_to_quarterly(q, "oancfy", "oancfq")


def day_calendar(spark, sf):
    return calendar(table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date")))


def available(spark, sf):
    return pit.availability(quarters(spark, sf), day_calendar(spark, sf))


@query("calendar_densify", KEY + "present close~", """
SELECT c.date, b.entity, w.entity IS NOT NULL AS present, w.close
FROM (SELECT entity, min(date) AS lo, max(date) AS hi FROM bars_w GROUP BY 1) b
JOIN (SELECT DISTINCT date FROM bars_w) c ON c.date BETWEEN b.lo AND b.hi LEFT JOIN bars_w w ON w.entity = b.entity AND w.date = c.date""", with_(WEEK_BARS))
def _(spark, sf):
    w = weeks(spark, sf)
    return pit.densify(w, calendar(w))


@query("market_context_join", KEY + "mkt~ rel~", "SELECT date, entity, mkt, ret - mkt AS rel FROM mpanel", MPANEL)
def _(spark, sf):
    p = market_panel(spark, sf)
    return p.withColumn("rel", F.col("ret") - F.col("mkt"))


@query("spell_membership", KEY + "close~", """
SELECT date, entity, close FROM bars_w b WHERE EXISTS (SELECT 1 FROM spells s WHERE s.entity = b.entity AND b.date BETWEEN spell_start AND spell_end)""", W_LINKS)
def _(spark, sf):
    return pit.in_spell(weeks(spark, sf), co.membership_spells(spark, sf))


@query("members_per_date", "date members# available#", """
SELECT date, count(*) FILTER (WHERE m) AS members, count(*) AS available FROM (
  SELECT date, EXISTS (SELECT 1 FROM spells s WHERE s.entity = b.entity AND b.date BETWEEN spell_start AND spell_end) AS m FROM bars_w b) GROUP BY date""", W_LINKS)
def _(spark, sf):
    f = pit.membership_flag(weeks(spark, sf), co.membership_spells(spark, sf))
    return f.groupBy("date").agg(F.sum(F.col("member").cast("int")).alias("members"), F.count(F.lit(1)).alias("available"))


@query("members_union", "entity#", """
SELECT DISTINCT entity FROM spells WHERE spell_start <= DATE '1996-03-31' AND spell_end >= DATE '1996-01-01'""", W_LINKS)
def _(spark, sf):
    return pit.members_union(co.membership_spells(spark, sf), "1996-01-01", "1996-03-31")


@query("filter_point_in_time", KEY + "r~", """
SELECT date, entity, (row_number() OVER (PARTITION BY date ORDER BY close, entity) - 1) / (CAST(count(*) OVER (PARTITION BY date) AS DOUBLE) - 1) - 0.5 AS r
FROM bars_w b WHERE EXISTS (SELECT 1 FROM spells s WHERE s.entity = b.entity AND b.date BETWEEN spell_start AND spell_end)""", W_LINKS)
def _(spark, sf):
    xs = CrossSection(("date",), names_bound(spark, sf))
    return pit.filter_point_in_time(xs, weeks(spark, sf), co.membership_spells(spark, sf), "close", "r", "universe")


CHANGES = """changes AS (SELECT entity, spell_start AS date, 'added' AS kind FROM spells WHERE spell_start > DATE '1995-03-01'
  UNION ALL SELECT entity, CAST(spell_end + 1 AS DATE), 'removed' FROM spells WHERE spell_end < DATE '2001-08-01'),
current_set AS (SELECT DISTINCT entity FROM spells WHERE spell_end >= DATE '2001-08-01'),
anchors AS (SELECT date_trunc('month', date) AS month, min(date) AS anchor FROM bars_w GROUP BY 1)"""


def rollback(spark, sf):
    s = co.membership_spells(spark, sf)
    added = s.where("spell_start > '1995-03-01'").select("entity", F.col("spell_start").alias("date"), F.lit("added").alias("kind"))
    gone = s.where("spell_end < '2001-08-01'").select("entity", F.date_add("spell_end", 1).alias("date"), F.lit("removed").alias("kind"))
    current = s.where("spell_end >= '2001-08-01'").select("entity")
    return pit.rollback_intervals(current, added.unionByName(gone))


@query("membership_rollback", "entity# month", """
SELECT e.entity, CAST(a.month AS DATE) AS month FROM (SELECT entity FROM current_set UNION SELECT entity FROM changes) e
JOIN anchors a ON coalesce((SELECT arg_min(kind, date) FROM changes c WHERE c.entity = e.entity AND c.date > a.anchor) = 'removed',
  e.entity IN (SELECT entity FROM current_set))""", more(W_LINKS, CHANGES))
def _(spark, sf):
    return pit.monthly_members(rollback(spark, sf), month_anchors(weekly_bars(spark, sf)))


ONDATE = """ondate AS (SELECT b.date, b.entity, CASE WHEN count(DISTINCT l.gvkey) = 1 THEN min(l.gvkey) END AS gvkey
  FROM bars_w b LEFT JOIN vlinks l ON l.entity = b.entity AND b.date BETWEEN link_from AND link_thru GROUP BY 1, 2)"""


@query("link_on_date", KEY + "gvkey", "SELECT * FROM ondate", more(W_LINKS, ONDATE))
def _(spark, sf):
    return pit.unique_on_date(weeks(spark, sf), vlinks(spark, sf), ["entity"], "gvkey", "link_from", "link_thru", "gvkey")


@query("link_ambiguities", "entity# overlap_from overlap_to a b", """
SELECT x.entity, greatest(x.link_from, y.link_from) AS overlap_from, least(x.link_thru, y.link_thru) AS overlap_to, x.gvkey AS a, y.gvkey AS b
FROM vlinks x JOIN vlinks y ON x.entity = y.entity AND x.gvkey < y.gvkey AND greatest(x.link_from, y.link_from) <= least(x.link_thru, y.link_thru)""", W_LINKS)
def _(spark, sf):
    return pit.link_ambiguities(vlinks(spark, sf))


@query("sector_on_date", KEY + "gvkey sector#", """
SELECT o.date, o.entity, o.gvkey, CASE WHEN count(DISTINCT s.sector) = 1 THEN min(s.sector) END AS sector
FROM ondate o LEFT JOIN sectors s ON s.gvkey = o.gvkey AND o.date BETWEEN ind_from AND ind_thru GROUP BY 1, 2, 3""", more(W_LINKS, ONDATE))
def _(spark, sf):
    w = pit.unique_on_date(weeks(spark, sf), vlinks(spark, sf), ["entity"], "gvkey", "link_from", "link_thru", "gvkey")
    s = co.sector_history(spark, sf).drop("entity")
    return pit.unique_on_date(w, s, ["gvkey"], "sector", "ind_from", "ind_thru", "sector")


@query("link_check", "gvkey bad#", """
SELECT gvkey, count(*) AS bad FROM sectors s WHERE NOT EXISTS (SELECT 1 FROM vlinks l WHERE l.gvkey = s.gvkey AND l.entity = s.entity
  AND s.ind_from BETWEEN link_from AND link_thru) GROUP BY 1""", W_LINKS)
def _(spark, sf):
    bad = pit.unlinked_rows(co.sector_history(spark, sf), vlinks(spark, sf))
    return bad.groupBy("gvkey").agg(F.count(F.lit(1)).alias("bad"))


COMPANY = """comp AS (SELECT b.date, b.entity, CASE WHEN b.entity % 7 <> 0 OR b.n_trades > 1 THEN b.volume END AS cap,
   CASE WHEN i.company IS NOT NULL AND b.date <= i.info_end THEN i.company ELSE -b.entity END AS company
  FROM bars_w b ASOF LEFT JOIN info i ON b.entity = i.entity AND b.date >= i.info_start)"""


def with_company(spark, sf):
    w = weeks(spark, sf).withColumn("cap", F.when((F.col("entity") % 7 != 0) | (F.col("n_trades") > 1), F.col("volume")))
    return pit.asof_company(w, co.security_info(spark, sf))


@query("asof_with_validity", KEY + "company#", "SELECT date, entity, company FROM comp", more(W_LINKS, COMPANY))
def _(spark, sf):
    return with_company(spark, sf)


@query("company_market_equity", "company# date me~2", """
SELECT company, date, CASE WHEN count(cap) = count(*) THEN sum(cap) END AS me FROM comp GROUP BY 1, 2""", more(W_LINKS, COMPANY))
def _(spark, sf):
    return pit.company_equity(with_company(spark, sf), "cap")


@query("label_on_date", KEY + "ticker", """
SELECT b.date, b.entity, arg_max(i.ticker, i.info_start) AS ticker FROM bars_w b LEFT JOIN info i ON i.entity = b.entity AND b.date BETWEEN info_start AND info_end
GROUP BY 1, 2""", W_LINKS)
def _(spark, sf):
    return pit.label_on_date(weeks(spark, sf), co.security_info(spark, sf), "ticker", "ticker")


@query("company_siblings", "entity#", """
SELECT DISTINCT entity FROM info WHERE company IN (SELECT company FROM info WHERE entity IN (SELECT entity FROM spells WHERE spell_start > DATE '1996-06-01'))""", W_LINKS)
def _(spark, sf):
    members = co.membership_spells(spark, sf).where("spell_start > '1996-06-01'").select("entity")
    return pit.company_siblings(co.security_info(spark, sf), members)


@query("parse_dates", "gvkey# fyearq# fqtr# rdq_date open_end", """
SELECT gvkey, fyearq, fqtr, rdq_date, CASE WHEN fqtr = 4 THEN DATE '9999-12-31' ELSE make_date(fyearq, fqtr, 1) END AS open_end FROM quarters""", W_QUARTERS)
def _(spark, sf):
    p = co.period_descriptor(spark, sf)
    text = F.when(F.col("fqtr") == 4, "9999-12-31").otherwise(F.date_format(F.make_date("fyearq", "fqtr", F.lit(1)), "yyyy-MM-dd"))
    return p.select("gvkey", "fyearq", "fqtr", pit.parse_date("rdq", "yyyyMMdd").alias("rdq_date"), pit.parse_date(text).alias("open_end"))


@query("first_filing", "gvkey# period_end first_filing", "SELECT * FROM first_filings", W_QUARTERS)
def _(spark, sf):
    return pit.first_filing(co.filings(spark, sf), ("A", "R"))


@query("quarter_assembly", "gvkey# fq_index# saleq~2 ibq~5 atq~2 seqq~2 period_end rdq_date first_filing", "SELECT * FROM quarters", W_QUARTERS)
def _(spark, sf):
    return quarters(spark, sf)


@query("ytd_to_quarterly", "gvkey# fyearq# fqtr# oancfy~4 oancfq~4", "SELECT * FROM quarters", W_QUARTERS)
def _(spark, sf):
    return quarters(spark, sf)


@query("nth_trading_day_after", "gvkey# period_end third", """
SELECT gvkey, period_end, c.date AS third FROM quarters q LEFT JOIN cal c ON c.pos = (SELECT min(pos) FROM cal WHERE date > q.period_end) + 2""", W_QUARTERS)
def _(spark, sf):
    return pit.nth_trading_day_after(quarters(spark, sf), day_calendar(spark, sf), "period_end", 3, "third")


@query("availability_dates", "gvkey# fq_index# anchor anchor_rule avail avail_rdq", "SELECT * FROM avails", W_QUARTERS)
def _(spark, sf):
    return available(spark, sf)


@query("forward_asof_report_dates", KEY + "rdq_date", """
SELECT date, gvkey AS entity, max(rdq_date) AS rdq_date FROM (
  SELECT gvkey, rdq_date, (SELECT min(date) FROM cal WHERE date >= rdq_date) AS date FROM quarters WHERE rdq_date IS NOT NULL)
WHERE date IS NOT NULL GROUP BY 1, 2""", W_QUARTERS)
def _(spark, sf):
    from ..operators.features import report_days

    return report_days(quarters(spark, sf), day_calendar(spark, sf))


PIT_VALUES = """g AS (SELECT e.gvkey, e.event, max(q.fq_index) AS latest FROM (SELECT DISTINCT gvkey, avail AS event FROM avails WHERE avail IS NOT NULL) e
  JOIN avails q ON q.gvkey = e.gvkey AND q.avail <= e.event GROUP BY 1, 2),
k AS (SELECT g.gvkey, g.event, g.latest - q.fq_index AS lag, q.* EXCLUDE (gvkey) FROM g JOIN avails q ON q.gvkey = g.gvkey AND q.avail <= g.event),
piv AS (SELECT gvkey, event, max(avail) FILTER (WHERE lag = 0) AS asof_avail, """ + ", ".join(
    f"max({c}) FILTER (WHERE lag = {lag}) AS {c}{lag}" for c, lags in (
        ("atq", (0, 1, 4)), ("actq", (0, 4)), ("cheq", (0, 4)), ("lctq", (0, 4)), ("dlcq", (0, 4, 12)), ("dlttq", (0, 4, 12)), ("ltq", (0, 1, 4)),
        ("ceqq", (0, 1)), ("seqq", (0, 1)), ("pstkq", (0, 1, 4)), ("txditcq", (0, 1)), ("ivaoq", (0, 4)), ("ivstq", (0, 4)), ("mibq", (0, 4)),
        ("ibq", range(12)), ("saleq", range(12)), ("cogsq", range(4)), ("oancfq", range(4))) for lag in lags) + ", " + ", ".join(
    f"count(*) FILTER (WHERE lag = {x}) AS has{x}" for x in (0, 4)) + """ FROM k GROUP BY 1, 2),
vals AS (SELECT gvkey, event, asof_avail, be0 AS be, ni AS ni_ttm, dlttq0 + dlcq0 - cheq0 AS netdebt, CASE WHEN be1 > 0 THEN ibq0 / be1 END AS niq_be,
  ocf / atq0 AS ocf_at, gp / atq0 AS gp_at,
  CASE WHEN ibq0 IS NOT NULL AND ibq4 IS NOT NULL THEN list_sum(list_transform([1, 2, 3, 4, 5, 6, 7, 8], lambda n:
     CASE WHEN list_min(list_transform(list_slice(rises, 1, n), lambda r: CAST(coalesce(r, false) AS INT))) = 1 THEN 1 ELSE 0 END)) END AS ni_inc8q,
  atq0 / atq4 - 1 AS at_gr1, CASE WHEN sb > 0 THEN sa / sb - 1 END AS sale_gr1, (ni - ocf) / atq0 AS oaccruals_at,
  (acc0 - acc4) / ((atq0 + atq4) / 2) AS taccruals_at, CASE WHEN dlttq12 + dlcq12 > 0 THEN (dlttq0 + dlcq0) / (dlttq12 + dlcq12) - 1 END AS debt_gr3,
  CASE WHEN atq4 > 0 THEN ((atq0 - cheq0) - (atq0 - dlcq0 - dlttq0 - coalesce(mibq0, 0) - coalesce(pstkq0, 0) - ceqq0)) / atq4 END AS noa_at, cheq0 / atq0 AS cash_at
 FROM (SELECT *, """ + ", ".join(
    f"coalesce(seqq{j}, ceqq{j} + pstkq{j}, atq{j} - ltq{j}) + coalesce(txditcq{j}, 0) - coalesce(pstkq{j}, 0) AS be{j}" for j in (0, 1)) + ", " + ", ".join(
    f"CASE WHEN has{j} > 0 THEN (actq{j} - cheq{j} - lctq{j} + dlcq{j}) + (atq{j} - actq{j} - coalesce(ivaoq{j}, 0)) - (ltq{j} - lctq{j} - dlttq{j}) "
    f"+ coalesce(ivstq{j}, 0) + coalesce(ivaoq{j}, 0) - dlttq{j} - dlcq{j} - coalesce(pstkq{j}, 0) END AS acc{j}" for j in (0, 4)) + """,
   ibq0 + ibq1 + ibq2 + ibq3 AS ni, oancfq0 + oancfq1 + oancfq2 + oancfq3 AS ocf, saleq0 + saleq1 + saleq2 + saleq3 AS sa, saleq4 + saleq5 + saleq6 + saleq7 AS sb,
   saleq0 - cogsq0 + saleq1 - cogsq1 + saleq2 - cogsq2 + saleq3 - cogsq3 AS gp, [""" + ", ".join(f"ibq{j} > ibq{j + 4}" for j in range(8)) + """] AS rises FROM piv))"""
W_PIT = more(W_QUARTERS, PIT_VALUES)
FUND = "be~2 ni_ttm~5 netdebt~2 niq_be~6 ocf_at~6 gp_at~6 ni_inc8q~ at_gr1~6 sale_gr1~6 oaccruals_at~6 taccruals_at~6 debt_gr3~6 noa_at~6 cash_at~6"


def fundamentals(spark, sf):
    return pit.fundamental_values(pit.known_quarters(available(spark, sf), [*co.ITEMS, "oancfq"]))


@query("pit_fundamentals", "gvkey# event asof_avail " + FUND, "SELECT * FROM vals", W_PIT)
def _(spark, sf):
    return fundamentals(spark, sf)


SURPRISE = """gr AS (SELECT e.gvkey, e.event, max(q.fq_index) AS latest FROM (SELECT DISTINCT gvkey, avail_rdq AS event FROM avails WHERE avail_rdq IS NOT NULL) e
  JOIN avails q ON q.gvkey = e.gvkey AND q.avail_rdq <= e.event GROUP BY 1, 2),
dif AS (SELECT gr.gvkey, gr.event, gr.latest - a.fq_index AS lag, a.ibq - b.ibq AS di, a.saleq - b.saleq AS ds FROM gr
  JOIN avails a ON a.gvkey = gr.gvkey AND a.avail_rdq <= gr.event AND a.fq_index BETWEEN gr.latest - 7 AND gr.latest
  JOIN avails b ON b.gvkey = gr.gvkey AND b.avail_rdq <= gr.event AND b.fq_index = a.fq_index - 4)"""


@query("earnings_surprise", "gvkey# event niq_su~ saleq_su~", """
SELECT gr.gvkey, gr.event, CASE WHEN count(di) >= 6 THEN max(di) FILTER (WHERE lag = 0) / nullif(stddev_samp(di), 0) END AS niq_su,
  CASE WHEN count(ds) >= 6 THEN max(ds) FILTER (WHERE lag = 0) / nullif(stddev_samp(ds), 0) END AS saleq_su
FROM gr LEFT JOIN dif ON dif.gvkey = gr.gvkey AND dif.event = gr.event GROUP BY 1, 2""", more(W_QUARTERS, SURPRISE))
def _(spark, sf):
    return pit.surprise_values(pit.known_quarters(available(spark, sf), ["ibq", "saleq"], "avail_rdq"))


@query("carry_forward_staleness", KEY + "be~2 at_gr1~", """
SELECT b.date, b.entity, CASE WHEN b.date - v.asof_avail <= 100 THEN v.be END AS be, CASE WHEN b.date - v.asof_avail <= 100 THEN v.at_gr1 END AS at_gr1
FROM bars_w b ASOF LEFT JOIN vals v ON v.gvkey = b.entity AND b.date >= v.event""", W_PIT)
def _(spark, sf):
    w = weeks(spark, sf).select("date", "entity")
    ev = fundamentals(spark, sf).withColumnRenamed("gvkey", "entity")
    return pit.carry_forward(w, ev, "entity", ["be", "at_gr1"], 100)


@query("member_firm_quarters", "gvkey fyearq# fqtr#", """
SELECT DISTINCT printf('%06d', CAST(q.gvkey AS BIGINT)) AS gvkey, q.fyearq, q.fqtr FROM quarters q
JOIN vlinks l ON l.gvkey = printf('%06d', CAST(q.gvkey AS BIGINT)) AND q.period_end BETWEEN link_from AND link_thru
JOIN spells s ON s.entity = l.entity AND q.period_end BETWEEN spell_start AND spell_end""", more(W_QUARTERS, LINKS, SPELLS))
def _(spark, sf):
    q = quarters(spark, sf).select(co.company_key(F.col("gvkey")).alias("gvkey"), "fyearq", "fqtr", "period_end")
    return pit.member_firm_quarters(q, vlinks(spark, sf), co.membership_spells(spark, sf))


DELISTS = """delists AS (SELECT entity, max(date) AS delist_date, CASE WHEN arg_max(n_trades, date) > 1 THEN 'MERGER' ELSE 'LIQUID' END AS action,
  CASE WHEN entity % 4 <> 0 THEN -0.35 END AS delist_ret FROM bars_d WHERE entity % 3 = 0 AND year(date) < 1998 + entity % 4 GROUP BY entity)"""
W_DEL = with_(WEEK_BARS, DAY_BARS, DELISTS, SPELLS)


@query("delisting_in_spell", "action delistings# without_return#", """
SELECT action, count(*) AS delistings, count(*) FILTER (WHERE delist_ret IS NULL) AS without_return FROM delists d
WHERE EXISTS (SELECT 1 FROM spells s WHERE s.entity = d.entity AND delist_date BETWEEN spell_start AND CAST(spell_end + 6 AS DATE)) GROUP BY 1""", W_DEL)
def _(spark, sf):
    # weekly spells end on a Monday; the delisting day lies inside that week
    s = co.membership_spells(spark, sf).withColumn("spell_end", F.date_add("spell_end", 6))
    return pit.delisting_in_spell(co.delistings(spark, sf), s)


@query("post_delisting_fill", KEY + "cash_ret~ market_ret~", """
SELECT c.date, d.entity, 0.0 AS cash_ret, m.mkt AS market_ret FROM delists d JOIN calw c0 ON c0.date = date_trunc('week', d.delist_date)
JOIN calw c ON c.pos BETWEEN c0.pos + 1 AND c0.pos + 5 LEFT JOIN market m ON m.date = c.date""",
       more(MPANEL, DAY_BARS, DELISTS, "calw AS (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT date FROM bars_w))"))
def _(spark, sf):
    p = weekly_panel(spark, sf)
    d = co.delistings(spark, sf).withColumn("delist_date", F.to_date(F.date_trunc("week", "delist_date")))
    cal = calendar(p)
    cash = pit.post_delisting_fill(d, cal, 5).withColumnRenamed("fill_ret", "cash_ret")
    market = pit.post_delisting_fill(d, cal, 5, market_series(p)).withColumnRenamed("fill_ret", "market_ret")
    return cash.join(market, ["entity", "date"])


@query("target_returns", KEY + "r~ y~ post_fill", """
SELECT date, entity, r, CASE WHEN count(r) OVER f = 3 THEN sum(r) OVER f END AS y, coalesce(max(fill) OVER f = 1, false) AS post_fill FROM (
  SELECT p.date, p.entity, ret AS r, 0 AS fill FROM panel p LEFT JOIN delists d ON d.entity = p.entity WHERE d.entity IS NULL OR p.date <= d.delist_date UNION ALL
  SELECT c.date, d.entity, 0.0, 1 FROM delists d JOIN calw c0 ON c0.date = date_trunc('week', d.delist_date) JOIN calw c ON c.pos BETWEEN c0.pos + 1 AND c0.pos + 3)
WINDOW f AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)""",
       more(PANEL, DAY_BARS, DELISTS, "calw AS (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT date FROM bars_w))"))
def _(spark, sf):
    p = weekly_panel(spark, sf).select("date", "entity", "ret")
    d = co.delistings(spark, sf).withColumn("delist_date", F.to_date(F.date_trunc("week", "delist_date")))
    alive = p.join(d.select("entity", "delist_date"), "entity", "left").where("delist_date is null or date <= delist_date")
    rows = alive.select("date", "entity", "ret").unionByName(pit.post_delisting_fill(d, calendar(p), 3), allowMissingColumns=True)
    rows = rows.withColumn("r", F.coalesce("ret", "fill_ret"))
    return rows.select("date", "entity", "r", ts.forward_sum("r", 3).alias("y"),
                       ts.forward_any(F.col("fill_ret").isNotNull(), 3).alias("post_fill"))


@query("execution_lagged_label", KEY + "lag# label~", """
SELECT date, entity, lag, y - avg(y) OVER (PARTITION BY date, lag) AS label FROM (
""" + " UNION ALL ".join(f"""SELECT date, entity, {lag} AS lag, CASE WHEN count(ret) OVER f = 3 THEN sum(ret) OVER f END AS y FROM panel
WINDOW f AS (PARTITION BY entity ORDER BY date ROWS BETWEEN {1 + lag} FOLLOWING AND {3 + lag} FOLLOWING)""" for lag in (0, 1, 2)) + ")", PANEL)
def _(spark, sf):
    from ..operators.features import lagged_labels

    return lagged_labels(weekly_panel(spark, sf), "ret", 3, (0, 1, 2), names_bound(spark, sf))


FACTORS = "factors AS (SELECT DISTINCT l_suppkey AS entity, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, 2.0 AS f FROM lineitem WHERE l_linenumber = 7)"


@query("adjustment_factor_join", KEY + "adjusted~6", """
SELECT b.date, b.entity, b.volume * coalesce(f.f, 1) AS adjusted FROM bars_w b LEFT JOIN factors f ON f.entity = b.entity AND f.date = b.date""", with_(WEEK_BARS, FACTORS))
def _(spark, sf):
    from ..operators.features import adjust_volume

    li = table(spark, sf, "lineitem").where("l_linenumber = 7")
    f = li.select(F.col("l_suppkey").alias("entity"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("date")).distinct()
    return adjust_volume(weeks(spark, sf), f.withColumn("f", F.lit(2.0)), "f", "adjusted")


@query("context_outer_join", "date mkt~ abs_mkt~ vol~ vix~", """
SELECT coalesce(m.date, v.date) AS date, mkt, abs(mkt) AS abs_mkt, m.vol, v.vix FROM (
  SELECT *, CASE WHEN count(mkt) OVER w = 20 THEN stddev_samp(mkt) OVER w * sqrt(52) END AS vol FROM market
  WINDOW w AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) m
FULL OUTER JOIN (SELECT date, stddev_samp(close) AS vix FROM panel WHERE date >= DATE '1996-01-01' GROUP BY 1) v ON v.date = m.date""", MPANEL)
def _(spark, sf):
    from ..operators.features import build_context

    p = weekly_panel(spark, sf)
    vix = p.where("date >= '1996-01-01'").groupBy("date").agg(F.stddev_samp("close").alias("vix"))
    return build_context(market_series(p), vix, 52)


@query("pair_agreement", "rows# missing# agree# disagree# found# not_found#", """
SELECT count(*) AS rows, count(*) FILTER (WHERE datadate IS NULL) AS missing, count(*) FILTER (WHERE datadate = computed) AS agree,
  count(*) FILTER (WHERE datadate <> computed) AS disagree,
  count(*) FILTER (WHERE datadate IS NOT NULL AND EXISTS (SELECT 1 FROM first_filings r WHERE r.gvkey = x.gvkey AND r.period_end = x.datadate)) AS found,
  count(*) FILTER (WHERE datadate IS NOT NULL AND NOT EXISTS (SELECT 1 FROM first_filings r WHERE r.gvkey = x.gvkey AND r.period_end = x.datadate)) AS not_found
FROM (SELECT gvkey, period_end AS computed, CASE WHEN gvkey % 11 = 0 THEN NULL WHEN gvkey % 5 = 0 THEN CAST(period_end - 1 AS DATE) ELSE period_end END AS datadate FROM quarters) x""", W_QUARTERS)
def _(spark, sf):
    p = co.period_descriptor(spark, sf)
    end = F.last_day(F.make_date("fyearq", F.col("fqtr") * 3, F.lit(1)))
    p = p.withColumn("datadate", F.when(F.col("gvkey") % 11 != 0, F.when(F.col("gvkey") % 5 == 0, F.date_sub(end, 1)).otherwise(end)))
    return pit.pair_agreement(p, pit.first_filing(co.filings(spark, sf), ("A", "R")))


@query("month_anchors", "month anchor", "SELECT CAST(date_trunc('month', date) AS DATE) AS month, min(date) AS anchor FROM bars_d GROUP BY 1", with_(DAY_BARS))
def _(spark, sf):
    return month_anchors(daily_bars(spark, sf))


@query("scoring_returns", KEY + "r~", """
SELECT date, entity, r FROM (SELECT p.date, p.entity, ret AS r FROM panel p LEFT JOIN delists d ON d.entity = p.entity WHERE d.entity IS NULL OR p.date <= d.delist_date UNION ALL
  SELECT c.date, d.entity, 0.0 FROM delists d JOIN calw c0 ON c0.date = date_trunc('week', d.delist_date) JOIN calw c ON c.pos BETWEEN c0.pos + 1 AND c0.pos + 3)
WHERE date IN (SELECT date FROM calw WHERE pos <= (SELECT max(pos) FROM calw WHERE date <= DATE '2000-06-30') + 3)""",
       more(PANEL, DAY_BARS, DELISTS, "calw AS (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT date FROM bars_w))"))
def _(spark, sf):
    from ..operators.features import scoring_returns

    p = weekly_panel(spark, sf).select("date", "entity", "ret")
    d = co.delistings(spark, sf).withColumn("delist_date", F.to_date(F.date_trunc("week", "delist_date")))
    cal = calendar(p)
    alive = p.join(d.select("entity", "delist_date"), "entity", "left").where("delist_date is null or date <= delist_date")
    rows = alive.select("date", "entity", "ret").unionByName(pit.post_delisting_fill(d, cal, 3), allowMissingColumns=True)
    return scoring_returns(rows, cal, "2000-06-30", 3)
