"""Coverage, quality and aggregate reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import pit
from ..operators import quality as ql
from ..operators import rolling as ts
from ..operators.crosssection import CrossSection
from ..operators.universe import top_n_mask
from ..sources import companies as co
from ..sources.tables import names_bound, weekly_panel
from .oracle import PANEL, more
from .q_evaluate import SCORED, ic_sql, scored, summary_sql
from .q_pit import COMPANY, W_LINKS, W_QUARTERS, quarters, weeks, with_company
from .registry import query


@query("coverage_by_year", "year# members# with_rows# without_rows# coverage~", """
SELECT y AS year, count(DISTINCT m.entity) AS members, count(DISTINCT h.entity) AS with_rows, count(DISTINCT m.entity) - count(DISTINCT h.entity) AS without_rows,
  count(DISTINCT h.entity) / count(DISTINCT m.entity) AS coverage
FROM (SELECT year(date) AS y, min(date) AS a, max(date) AS b FROM bars_w GROUP BY 1) c JOIN spells m ON spell_start <= b AND spell_end >= a
LEFT JOIN (SELECT DISTINCT year(date) AS hy, entity FROM bars_w WHERE n_trades >= 6) h ON hy = y AND h.entity = m.entity GROUP BY 1""", W_LINKS)
def _(spark, sf):
    w = weeks(spark, sf)
    return ql.coverage_by_year(co.membership_spells(spark, sf), w.where("n_trades >= 6"), w.select("date").distinct())


@query("universe_coverage", "date members# available# share~", """
SELECT date, count(*) FILTER (WHERE m) AS members, count(*) FILTER (WHERE m AND n_trades >= 2) AS available,
  count(*) FILTER (WHERE m AND n_trades >= 2) / nullif(count(*) FILTER (WHERE m), 0) AS share FROM (
  SELECT b.*, EXISTS (SELECT 1 FROM spells s WHERE s.entity = b.entity AND b.date BETWEEN spell_start AND spell_end) AS m FROM bars_w b) GROUP BY date""", W_LINKS)
def _(spark, sf):
    f = pit.membership_flag(weeks(spark, sf), co.membership_spells(spark, sf))
    return ql.universe_coverage(f.withColumn("present", F.col("n_trades") >= 2))


@query("present_share", "year# rows# ret~ sig~ sector~ price_flag~", """
SELECT year(date) AS year, count(*) AS rows, avg(CAST(ret IS NOT NULL AS INT)) AS ret, avg(CAST(sig IS NOT NULL AS INT)) AS sig, avg(CAST(sector IS NOT NULL AS INT)) AS sector,
  avg(CAST(ret IS NULL OR sig IS NULL AS INT)) AS price_flag FROM panel GROUP BY GROUPING SETS ((), (year(date)))""", PANEL)
def _(spark, sf):
    return ql.present_share(weekly_panel(spark, sf), ["ret", "sig", "sector"], {"price_flag": F.col("ret").isNull() | F.col("sig").isNull()})


@query("rdq_coverage_by_fiscal_year", "fyearq# firm_quarters# rdq_share~ filing_share~", """
SELECT fyearq, count(*) AS firm_quarters, avg(CAST(rdq_date IS NOT NULL AS INT)) AS rdq_share, avg(CAST(first_filing IS NOT NULL AS INT)) AS filing_share
FROM quarters GROUP BY 1""", W_QUARTERS)
def _(spark, sf):
    return ql.rdq_coverage(quarters(spark, sf))


@query("early_years_table", "year# rows# sig~ flag~ firm_quarters# rdq_share~", """
SELECT y AS year, p.rows, p.sig, p.flag, q.firm_quarters, q.rdq_share FROM range(1994, 1998) AS r(y)
LEFT JOIN (SELECT year(date) AS yy, count(*) AS rows, avg(CAST(close > 0 AND n_trades > 1 AS INT)) AS flag, avg(CAST(n_trades IS NOT NULL AS INT)) AS sig FROM bars_w GROUP BY 1) p ON yy = y
LEFT JOIN (SELECT fyearq, count(*) AS firm_quarters, avg(CAST(rdq_date IS NOT NULL AS INT)) AS rdq_share FROM quarters GROUP BY 1) q ON fyearq = y""", W_QUARTERS)
def _(spark, sf):
    w = weeks(spark, sf).withColumnRenamed("n_trades", "sig")
    return ql.early_years(w, ["sig"], {"flag": (F.col("close") > 0) & (F.col("sig") > 1)}, quarters(spark, sf), 1994, 1997)


@query("build_report", "rows# dates# entities# min_names# median_names~ max_names# missing_returns# non_positive_prices# extreme_returns#", """
SELECT count(*) AS rows, count(DISTINCT date) AS dates, count(DISTINCT entity) AS entities, (SELECT min(n) FROM c) AS min_names, (SELECT quantile_cont(n, 0.5) FROM c) AS median_names,
  (SELECT max(n) FROM c) AS max_names, count(*) FILTER (WHERE ret IS NULL) AS missing_returns, count(*) FILTER (WHERE close <= 0) AS non_positive_prices,
  count(*) FILTER (WHERE abs(ret) > 3) AS extreme_returns FROM panel""", more(PANEL, "c AS (SELECT date, count(*) AS n FROM panel GROUP BY 1)"))
def _(spark, sf):
    return ql.build_report(weekly_panel(spark, sf))


@query("missing_return_split", "year# category rows#", """
SELECT year(date) AS year, CASE WHEN br < 10 OR fr < 3 THEN 'other_invalid' WHEN bc < br AND fc < fr THEN 'c_both' WHEN bc < br THEN 'a_backward_only'
  WHEN fc < fr THEN 'b_forward_only' ELSE 'panel_rows' END AS category, count(*) AS rows FROM (
  SELECT date, n_trades, count(*) OVER b AS br, count(sig) OVER b AS bc, count(*) OVER f AS fr, count(sig) OVER f AS fc FROM panel
  WINDOW b AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), f AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))
WHERE n_trades >= 2 GROUP BY 1, 2""", PANEL)
def _(spark, sf):
    return ql.missing_return_split(weekly_panel(spark, sf), "sig", F.col("n_trades") >= 2, 10, 3)


@query("dual_class_companies", "date companies#", """
SELECT date, count(*) AS companies FROM (SELECT date, company FROM comp GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1""", more(W_LINKS, COMPANY))
def _(spark, sf):
    return ql.dual_class_per_date(with_company(spark, sf))


@query("keyset_count", "keyset# firm_quarters#", "SELECT 1 AS keyset, count(*) AS firm_quarters FROM (SELECT DISTINCT gvkey, fyearq, fqtr FROM quarters)", W_QUARTERS)
def _(spark, sf):
    return ql.keyset_count(co.period_descriptor(spark, sf))


SECROWS = """srows AS (SELECT * FROM (SELECT *, exp(sig / 10) - 1 AS sr, lag(dollar_volume) OVER (PARTITION BY entity ORDER BY date) AS cap_prev FROM panel)
  WHERE sr IS NOT NULL AND cap_prev IS NOT NULL AND sector IS NOT NULL)"""


def sec_rows(spark, sf):
    p = weekly_panel(spark, sf).withColumn("sr", F.expm1(F.col("sig") / 10))
    return ql.sector_rows(p, "sr", "dollar_volume")


@query("sector_rows", "date entity# sector# sr~ cap_prev~2", "SELECT * FROM srows", more(PANEL, SECROWS))
def _(spark, sf):
    return sec_rows(spark, sf)


@query("weighted_sector_returns", "weighting date sector# ret~ names#", """
SELECT 'value' AS weighting, date, sector, CASE WHEN count(*) >= 12 THEN ln(1 + sum(sr * cap_prev) / sum(cap_prev)) END AS ret, count(*) AS names FROM srows GROUP BY 2, 3
UNION ALL SELECT 'equal', date, sector, CASE WHEN count(*) >= 12 THEN ln(1 + avg(sr)) END, count(*) FROM srows GROUP BY 2, 3""", more(PANEL, SECROWS))
def _(spark, sf):
    r = sec_rows(spark, sf)
    a, b = (ql.sector_returns(r, "sr", k, 12).withColumn("weighting", F.lit(k)) for k in ("value", "equal"))
    return a.unionByName(b)


@query("thin_sectors", "sector thin_dates# median_names~ least_names# fitted", """
SELECT CAST(s AS VARCHAR) AS sector, count(*) FILTER (WHERE k < 12) AS thin_dates, quantile_cont(k, 0.5) AS median_names, min(k) AS least_names, min(k) >= 12 AS fitted FROM (
  SELECT d.date, s, count(r.entity) AS k FROM (SELECT DISTINCT date FROM srows) d, range(6) AS x(s) LEFT JOIN srows r ON r.date = d.date AND r.sector = s GROUP BY 1, 2) GROUP BY s""", more(PANEL, SECROWS))
def _(spark, sf):
    counts = ql.sector_returns(sec_rows(spark, sf), "sr", "equal", 12)
    return ql.thin_sectors(counts, range(6), 12)


@query("outlier_report", "entity# extreme_bars# price_span~6 zero_adv# excluded", """
SELECT *, extreme_bars >= 2 OR price_span > 1000 AS excluded FROM (SELECT entity, count(*) FILTER (WHERE abs(ret) > 4.5) AS extreme_bars, max(close) / min(close) AS price_span,
  count(*) FILTER (WHERE n_trades >= 2 AND (adv IS NULL OR adv = 0)) AS zero_adv FROM (SELECT *, CASE WHEN count(*) OVER w >= 5 THEN avg(dollar_volume) OVER w END AS adv FROM panel
    WINDOW w AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) GROUP BY 1)
WHERE extreme_bars > 0 OR price_span > 1000 OR zero_adv > 0""", PANEL)
def _(spark, sf):
    p = weekly_panel(spark, sf).withColumn("adv", ts.mean("dollar_volume", 10))
    return ql.outlier_report(p, "ret", F.col("n_trades") >= 2, 4.5, 1000)


VALID = """v AS (SELECT *, close / lag(close) OVER e - 1 AS r1, close / lag(close, 5) OVER e - 1 AS r5, lag(date) OVER e AS prev FROM panel WINDOW e AS (PARTITION BY entity ORDER BY date)),
checks AS (SELECT [""" + ", ".join("{'k': '" + k + "', 'x': CAST(" + x + " AS DOUBLE), 'ok': " + ok + ", 'w': " + w + "}" for k, x, ok, w in (
    ("rows_without_core_field", "count(*) FILTER (WHERE open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL)", "true", "false"),
    ("duplicate_keys", "count(*) FILTER (WHERE date = prev)", "true", "false"),
    ("non_positive_prices", "count(*) FILTER (WHERE least(open, high, low, close) <= 0)", "true", "false"),
    ("high_below_low", "count(*) FILTER (WHERE high < low)", "true", "false"),
    ("close_outside_range", "count(*) FILTER (WHERE close > high + 1e-4 OR close < low - 1e-4)", "true", "true"),
    ("open_inside_range_share", "avg(CAST(open BETWEEN low - 1e-4 AND high + 1e-4 AS INT))", "true", "false"),
    ("extreme_returns", "count(*) FILTER (WHERE abs(r1) > 0.9)", "false", "true"),
    ("ret5_max_gap", "0", "true", "false"),
    ("weekday_outside_range", "count(*) FILTER (WHERE isodow(date) > 5)", "true", "false"),
    ("sector_fill_share", "avg(CAST(sector IS NOT NULL AS INT))", "true", "false"),
    ("industry_fill_share", "avg(CAST(industry IS NOT NULL AS INT))", "true", "false"),
    ("sector_changes", "0", "true", "false"))) + "] AS c FROM v)"


@query("panel_validation", "check_name value~6 status", """
SELECT x['k'] AS check_name, x['x'] AS value, CASE WHEN x['ok'] THEN 'pass' WHEN x['w'] THEN 'warn' ELSE 'fail' END AS status FROM (SELECT unnest(c) AS x FROM checks)""", more(PANEL, VALID))
def _(spark, sf):
    return ql.panel_validation(weekly_panel(spark, sf)).withColumnRenamed("check", "check_name")


@query("universe_changes", "additions# on_anchor# removals#", """
SELECT count(*) FILTER (WHERE NOT prev AND inu) AS additions, count(*) FILTER (WHERE NOT prev AND inu AND date IN (SELECT min(date) FROM panel GROUP BY date_trunc('month', date))) AS on_anchor,
  count(*) FILTER (WHERE prev AND NOT inu) AS removals FROM (SELECT *, lag(inu) OVER (PARTITION BY entity ORDER BY date) AS prev FROM (
  SELECT p.date, p.entity, t.entity IS NOT NULL AS inu FROM panel p LEFT JOIN (SELECT entity, date_trunc('month', date) AS m FROM panel WHERE date IN (SELECT min(date) FROM panel GROUP BY date_trunc('month', date))
     QUALIFY row_number() OVER (PARTITION BY date ORDER BY dollar_volume DESC, entity) <= 30) t ON t.entity = p.entity AND t.m = date_trunc('month', p.date)))""", PANEL)
def _(spark, sf):
    xs = CrossSection(("date",), names_bound(spark, sf))
    return ql.universe_changes(top_n_mask(xs, weekly_panel(spark, sf), "dollar_volume", 30, "in_universe"))


@query("quantile_thresholds", "level~ threshold~", " UNION ALL ".join(f"""
SELECT {p} AS level, (abs(quantile_cont(y3, {p})) + abs(quantile_cont(y3, {1 - p}))) / 2 AS threshold FROM scored""" for p in (0.01, 0.05, 0.25)), SCORED)
def _(spark, sf):
    return ql.symmetric_thresholds(scored(spark, sf), "y3", (0.01, 0.05, 0.25), None)


@query("prediction_distribution", "mean~ std~ q0_01~ q0_1~ q0_9~ q0_99~", """
SELECT avg(s1) AS mean, stddev_samp(s1) AS std, quantile_cont(s1, 0.01) AS q0_01, quantile_cont(s1, 0.1) AS q0_1, quantile_cont(s1, 0.9) AS q0_9, quantile_cont(s1, 0.99) AS q0_99 FROM scored""", SCORED)
def _(spark, sf):
    return ql.prediction_distribution(scored(spark, sf), "s1", (0.01, 0.1, 0.9, 0.99), None)


ARMS = f"""arms AS (SELECT 'base' AS arm, * FROM ({ic_sql('s1', 'y3')})
  UNION ALL SELECT 'alt', * FROM ({ic_sql('s2', 'y3')}))"""


@query("pooled_fold_results", "arm mean~ t~ n#", summary_sql("arms", "ic", 2, by="arm"), more(SCORED, ARMS))
def _(spark, sf):
    d = scored(spark, sf).withColumn("fold", F.year("date"))
    pooled = ql.pooled_folds(d, {"base": "s1", "alt": "s2"}, ["date", "entity", "fold", "y3"])
    ics = ev.rank_ic(pooled, "pred", "y3", by=("arm", "date"), bound=names_bound(spark, sf))
    return ev.series_summary(ics, "ic", 2, by=("arm",))


@query("monthly_compounded_return", "entity# month ret~6", """
SELECT entity, CAST(date_trunc('month', date) AS DATE) AS month, CASE WHEN count(sig) >= ceil(0.8 * count(*) - 1e-9) THEN exp(sum(ln(1 + (exp(sig / 10) - 1)))) - 1 END AS ret FROM panel GROUP BY 1, 2""", PANEL)
def _(spark, sf):
    p = weekly_panel(spark, sf).withColumn("sr", F.expm1(F.col("sig") / 10))
    return ql.monthly_compounded(p, "sr")


RIDGE = """rg AS (SELECT *, CASE WHEN year(date) >= 1998 THEN 2.0 ELSE 1.0 END AS w FROM scored WHERE y3 IS NOT NULL AND s1 IS NOT NULL AND s2 IS NOT NULL),
sums AS (SELECT sum(w * s1 * s1) + 5 AS a, sum(w * s1 * s2) AS b, sum(w * s1) AS c, sum(w * s2 * s2) + 5 AS d, sum(w * s2) AS e, sum(w) AS f,
  sum(w * s1 * y3) AS g, sum(w * s2 * y3) AS h, sum(w * y3) AS i FROM rg),
sol AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM sums)"""
COEF = """SELECT 's1' AS term, (g * (d * f - e * e) - b * (h * f - e * i) + c * (h * e - d * i)) / det AS coef FROM sol
UNION ALL SELECT 's2', (a * (h * f - e * i) - g * (b * f - c * e) + c * (b * i - h * c)) / det FROM sol
UNION ALL SELECT 'intercept', (a * (d * i - h * e) - b * (b * i - h * c) + g * (b * e - d * c)) / det FROM sol"""


def ridge_rows(spark, sf):
    return scored(spark, sf).withColumn("w", F.when(F.year("date") >= 1998, 2.0).otherwise(1.0))


@query("weighted_ridge", "term coef~7", COEF, more(SCORED, RIDGE))
def _(spark, sf):
    return ql.ridge(ridge_rows(spark, sf), "y3", ["s1", "s2"], "w", 5.0)


@query("ridge_predictions", "date entity# fit~6", f"""
SELECT date, entity, (SELECT coef FROM co WHERE term = 'intercept') + (SELECT coef FROM co WHERE term = 's1') * s1 + (SELECT coef FROM co WHERE term = 's2') * s2 AS fit FROM scored""",
       more(SCORED, RIDGE, f"co AS ({COEF})"))
def _(spark, sf):
    d = ridge_rows(spark, sf)
    return ql.ridge_predict(d, ql.ridge(d, "y3", ["s1", "s2"], "w", 5.0), ["s1", "s2"], "fit")
