"""Rank IC, books, fitness and inference over the weekly panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import portfolio as pf
from ..operators import rolling as ts
from ..operators.crosssection import CrossSection
from ..operators.splits import calendar
from ..sources.tables import by_entity, names_bound, weekly_panel
from .oracle import PANEL, more
from .registry import query

SCORED_SQL = """
scored AS (
  SELECT date, entity, sector, industry, volume, dollar_volume, ret / 100 AS r,
         CASE WHEN count(sig) OVER w10 >= 5 THEN sum(sig) OVER w10 END AS s1,
         CASE WHEN count(volume) OVER w5 >= 2 THEN avg(volume) OVER w5 END AS s2,
         lead(ret) OVER e / 100 AS y1, CASE WHEN count(ret) OVER f3 = 3 THEN sum(ret) OVER f3 / 100 END AS y3,
         lead(ret, 2) OVER e / 100 AS y1b, lead(ret, 3) OVER e / 100 AS y1c
  FROM panel
  WINDOW e AS (PARTITION BY entity ORDER BY date),
         w10 AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW),
         w5 AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
         f3 AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))"""
SCORED = more(PANEL, SCORED_SQL)


def scored(spark, sf):
    """Weekly panel with two signals, forward targets (scaled to percent) and daily pieces."""
    p = weekly_panel(spark, sf)
    return p.select(
        "date", "entity", "sector", "industry", "volume", "dollar_volume", (F.col("ret") / 100).alias("r"),
        ts.sum_("sig", 10).alias("s1"), ts.mean("volume", 5).alias("s2"),
        (F.lead("ret", 1).over(by_entity()) / 100).alias("y1"), (ts.forward_sum("ret", 3) / 100).alias("y3"),
        F.transform(ts.forward_returns("ret", 3), lambda v: v / 100).alias("yd"),
    )


def avg_rank(x, by):
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0)"


def ic_sql(x, y, by="date", src="scored", least=3):
    return f"""SELECT {by}, corr(rx, ry) AS ic, count(*) AS n FROM (
  SELECT *, {avg_rank(x, by)} AS rx, {avg_rank(y, by)} AS ry FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL)
GROUP BY {by} HAVING count(*) >= {least} AND max(rx) > min(rx) AND max(ry) > min(ry)"""


def hac_sql(src, value, lags, by="series", order="date", kernel="uniform"):
    """One row per series: n, mean, sd, lrv, kernel, gamma0 by a self-join on the row number."""
    kern = [(1.0 if kernel == "uniform" else 1 - k / (lags + 1.0)) for k in range(1, lags + 1)]
    bart = [1 - k / (lags + 1.0) for k in range(1, lags + 1)]
    uni = " + ".join(["g0", *[f"2 * {w!r} * g{k}" for k, w in enumerate(kern, 1)]])
    alt = " + ".join(["g0", *[f"2 * {w!r} * g{k}" for k, w in enumerate(bart, 1)]])
    gs = "".join(f", coalesce(sum(xc * x{k}), 0) AS g{k}" for k in range(1, lags + 1))
    lagged = "".join(f", lag(xc, {k}) OVER (PARTITION BY {by} ORDER BY {order}) AS x{k}" for k in range(1, lags + 1))
    fall = f"({uni}) <= 0" if kernel == "uniform" and lags else "false"
    return f"""SELECT {by}, n, mean, sd, CASE WHEN {fall} THEN {alt} ELSE {uni} END / (n - 1) AS lrv,
  CASE WHEN {fall} THEN 'bartlett' ELSE '{kernel}' END AS kernel, g0 / (n - 1) AS gamma0
FROM (SELECT {by}, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS sd, sum(xc * xc) AS g0{gs}
      FROM (SELECT *{lagged} FROM (SELECT {by}, {order}, {value} AS v, {value} - avg({value}) OVER (PARTITION BY {by}) AS xc
                    FROM {src} WHERE {value} IS NOT NULL)) GROUP BY {by})"""


def summary_sql(src, value, lags, by="series", order="date", kernel="uniform"):
    return f"""SELECT {by}, mean, CASE WHEN lrv > 0 THEN sqrt(lrv / n) END AS se,
  mean / nullif(CASE WHEN lrv > 0 THEN sqrt(lrv / n) END, 0) AS t, sd, mean / nullif(sd, 0) AS icir, n, {lags} AS lags, kernel
FROM ({hac_sql(src, value, lags, by, order, kernel)})"""


@query("momentum_ic_summary", "mean_ic~ sd~ icir~ t~ n# kernel", f"""
SELECT mean AS mean_ic, sd, icir, t, n, kernel FROM (
  {summary_sql(f"(SELECT 'mom' AS series, * FROM ({ic_sql('s1', 'yn')}))", 'ic', 2)})""".replace(
    "FROM scored WHERE", "FROM (SELECT *, y3 - avg(y3) OVER (PARTITION BY date) AS yn FROM scored) WHERE"), SCORED)
def momentum_ic(spark, sf, min_names=3):
    """Flagship: mean rank IC of momentum against the market-neutral forward return."""
    b = names_bound(spark, sf)
    p = CrossSection(("date",), b).demean(scored(spark, sf), "y3", "yn")
    ics = ev.rank_ic(p, "s1", "yn", min_names, bound=b).withColumn("series", F.lit("mom"))
    return ev.series_summary(ics, "ic", 2).withColumnRenamed("mean", "mean_ic")


@query("rank_ic_by_date", "date ic~ n#", ic_sql("s1", "y3"), SCORED)
def _(spark, sf):
    return ev.rank_ic(scored(spark, sf), "s1", "y3", bound=names_bound(spark, sf))


@query("rank_ic_ordinal_ties", "date ic~ n#", """
SELECT date, corr(rx, ry) AS ic, count(*) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY date ORDER BY s2, entity) AS rx,
         row_number() OVER (PARTITION BY date ORDER BY y3, entity) AS ry
  FROM scored WHERE s2 IS NOT NULL AND y3 IS NOT NULL) GROUP BY date HAVING count(*) >= 5""", SCORED)
def _(spark, sf):
    return ev.rank_ic(scored(spark, sf), "s2", "y3", 5, "ordinal", bound=names_bound(spark, sf))


@query("prediction_metrics", "n# rmse~ ic~ rank_ic~ hit_rate~", f"""
SELECT count(*) AS n, sqrt(avg((y3 - s1) * (y3 - s1))) AS rmse, corr(y3, s1) AS ic, corr(ry, rs) AS rank_ic,
       avg(CASE WHEN y3 <> 0 AND s1 <> 0 THEN CAST(sign(y3) = sign(s1) AS DOUBLE) END) AS hit_rate
FROM (SELECT *, {avg_rank('y3', 'one')} AS ry, {avg_rank('s1', 'one')} AS rs
      FROM (SELECT *, 1 AS one FROM scored WHERE y3 IS NOT NULL AND s1 IS NOT NULL))""", SCORED)
def _(spark, sf):
    # weeks are calendar-bounded, so names x weeks bounds the one global group
    return ev.prediction_metrics(scored(spark, sf), "y3", "s1", bound=None)


IC2 = f"""ics AS (SELECT 's1' AS series, * FROM ({ic_sql('s1', 'y3')}) UNION ALL SELECT 's2', * FROM ({ic_sql('s2', 'y3')}))"""


def ics(spark, sf):
    long = ev.stack_signals(scored(spark, sf), ["date", "entity", "y3"], ["s1", "s2"], "series")
    return ev.rank_ic(long, "s", "y3", by=("series", "date"), bound=names_bound(spark, sf))


@query("ic_summary", "series mean~ se~ t~ sd~ icir~ n# lags# kernel", summary_sql("ics", "ic", 2), more(SCORED, IC2))
def _(spark, sf):
    return ev.series_summary(ics(spark, sf), "ic", 2)


@query("long_run_variance", "series kernel_set n# lrv~ gamma0~ kernel",
       f"SELECT 'hansen_hodrick' AS kernel_set, * FROM ({hac_sql('ics', 'ic', 2)}) UNION ALL "
       f"SELECT 'newey_west', * FROM ({hac_sql('ics', 'ic', 8, kernel='bartlett')})", more(SCORED, IC2))
def _(spark, sf):
    i = ics(spark, sf)
    out = [ev.long_run_variance(i, "ic", *ev.overlap_kernels(3, 8)[c]).withColumn("kernel_set", F.lit(c))
           for c in ("hansen_hodrick", "newey_west")]
    return out[0].unionByName(out[1])


DECAY = " UNION ALL ".join(
    f"SELECT {h} AS h, * FROM ({summary_sql(f'(SELECT * FROM ({u}))', 'ic', h - 1, by='signal')})"
    for h, u in ((h, " UNION ALL ".join(f"SELECT '{s}' AS signal, * FROM ({ic_sql(s, y)})" for s in ("s1", "s2")))
                 for h, y in ((1, "y1"), (3, "y3"))))


@query("ic_decay", "signal h# mean~ t~ n# lags# kernel", DECAY, SCORED)
def _(spark, sf):
    return ev.ic_decay(scored(spark, sf), ["s1", "s2"], {1: "y1", 3: "y3"}, bound=names_bound(spark, sf))


LEGS = """legs AS (SELECT *, CASE WHEN o <= nn // 5 THEN -1 WHEN o > nn - nn // 5 THEN 1 ELSE 0 END AS leg, nn // 5 AS k,
  dense_rank() OVER (ORDER BY date) - 1 AS pos
  FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY s1, entity) AS o, count(*) OVER (PARTITION BY date) AS nn
        FROM scored WHERE s1 IS NOT NULL AND y3 IS NOT NULL AND y1c IS NOT NULL))"""
BOOK_LEGS = LEGS.replace("AND y1c IS NOT NULL))", "AND y1c IS NOT NULL) WHERE nn >= 5)")
HALF = LEGS.replace("// 5", "// 2").replace("AND y1c IS NOT NULL", "")
BOOK = "date gross~ long~ short~ turnover~"


def tradeable(spark, sf):
    return scored(spark, sf).where("s1 is not null and y3 is not null and yd[2] is not null")


@query("half_sample_ics", "half date ic~ n#", """
SELECT half, date, corr(rx, ry) AS ic, count(*) AS n FROM (
  SELECT date, CASE WHEN leg = 1 THEN 'upper' ELSE 'lower' END AS half,
         row_number() OVER (PARTITION BY date, leg ORDER BY s1, entity) AS rx,
         row_number() OVER (PARTITION BY date, leg ORDER BY y3, entity) AS ry FROM legs WHERE leg <> 0)
GROUP BY half, date HAVING count(*) >= 3""", more(SCORED, HALF))
def _(spark, sf):
    return ev.half_sample_ics(scored(spark, sf), "s1", "y3", bound=names_bound(spark, sf))


@query("quantile_legs", "date entity leg# leg_size#", "SELECT date, entity, leg, k AS leg_size FROM legs", more(SCORED, LEGS))
def _(spark, sf):
    return ev.quantile_legs(tradeable(spark, sf), "s1", 5, bound=names_bound(spark, sf))


def turnover_sql(src, pos="pos"):
    """Full outer join of consecutive books."""
    return f"""SELECT coalesce(a.{pos}, b.{pos} + 1) AS {pos}, 0.5 * sum(abs(coalesce(a.w, 0) - coalesce(b.w, 0))) AS turnover
FROM {src} a FULL OUTER JOIN {src} b ON a.entity = b.entity AND a.{pos} = b.{pos} + 1
GROUP BY 1"""


@query("long_short_by_date", BOOK, f"""
SELECT l.date, l.long + l.short AS gross, long, short, t.turnover
FROM (SELECT date, pos, avg(y1) FILTER (WHERE leg = 1) AS long, -avg(y1) FILTER (WHERE leg = -1) AS short FROM legs WHERE leg <> 0 GROUP BY 1, 2) l
JOIN ({turnover_sql('(SELECT pos, entity, leg / k AS w FROM legs WHERE leg <> 0)')}) t ON t.pos = l.pos""", more(SCORED, BOOK_LEGS))
def _(spark, sf):
    return pf.long_short_book(tradeable(spark, sf), "s1", "y1", 5, bound=names_bound(spark, sf))


NONOVER = """reb AS (SELECT *, pos // 3 AS q FROM legs WHERE leg <> 0 AND pos % 3 = 0)"""


@query("book_nonoverlapping", BOOK, f"""
SELECT l.date, l.long + l.short AS gross, long, short, t.turnover
FROM (SELECT date, q, avg(y3) FILTER (WHERE leg = 1) AS long, -avg(y3) FILTER (WHERE leg = -1) AS short FROM reb GROUP BY 1, 2) l
JOIN ({turnover_sql('(SELECT q AS pos, entity, leg / k AS w FROM reb)')}) t ON t.pos = l.q""", more(SCORED, BOOK_LEGS, NONOVER))
def _(spark, sf):
    return pf.long_short_book(tradeable(spark, sf), "s1", "y3", 5, 3, bound=names_bound(spark, sf))


STAG = """stag AS (SELECT l.pos + m AS pos, entity, sum(leg / k / 3.0) AS w FROM legs l, range(3) AS r(m) WHERE leg <> 0
  AND l.pos + m <= (SELECT max(pos) FROM legs) GROUP BY 1, 2),
cohort AS (SELECT pos, leg, avg(y1) AS c0, avg(y1b) AS c1, avg(y1c) AS c2 FROM legs WHERE leg <> 0 GROUP BY 1, 2),
stag_legs AS (SELECT pos, sum(v) FILTER (WHERE leg = 1) / 3 AS long, -sum(v) FILTER (WHERE leg = -1) / 3 AS short
  FROM (SELECT pos, leg, c0 AS v FROM cohort UNION ALL SELECT pos + 1, leg, c1 FROM cohort UNION ALL SELECT pos + 2, leg, c2 FROM cohort)
  GROUP BY pos)"""


@query("book_staggered", BOOK, f"""
SELECT d.date, l.long + l.short AS gross, long, short, t.turnover
FROM (SELECT DISTINCT date, pos FROM legs) d JOIN stag_legs l ON l.pos = d.pos
JOIN ({turnover_sql('stag')}) t ON t.pos = d.pos""", more(SCORED, BOOK_LEGS, STAG))
def _(spark, sf):
    return pf.long_short_book(tradeable(spark, sf), "s1", "y3", 5, 3, "staggered", "yd", names_bound(spark, sf))


@query("leg_returns", "date long~ short~ gross~", """
SELECT date, avg(y3) FILTER (WHERE leg = 1) AS long, -avg(y3) FILTER (WHERE leg = -1) AS short,
       avg(y3) FILTER (WHERE leg = 1) - avg(y3) FILTER (WHERE leg = -1) AS gross
FROM legs WHERE leg <> 0 GROUP BY date""", more(SCORED, BOOK_LEGS))
def _(spark, sf):
    return pf.long_short_book(tradeable(spark, sf), "s1", "y3", 5, bound=names_bound(spark, sf))


@query("portfolio_summary", "mean_gross~ mean_net~ gross_std~ ir_gross~ ir_net~ mean_turnover~ n_periods#", f"""
SELECT avg(gross) AS mean_gross, avg(net) AS mean_net, stddev_samp(gross) AS gross_std, avg(gross) / stddev_samp(gross) AS ir_gross,
       avg(net) / stddev_samp(net) AS ir_net, avg(turnover) AS mean_turnover, count(*) AS n_periods
FROM (SELECT l.gross, l.gross - 2 * 0.001 * t.turnover AS net, t.turnover
  FROM (SELECT q, avg(y3) FILTER (WHERE leg = 1) - avg(y3) FILTER (WHERE leg = -1) AS gross FROM reb GROUP BY 1) l
  JOIN ({turnover_sql('(SELECT q AS pos, entity, leg / k AS w FROM reb)')}) t ON t.pos = l.q)""", more(SCORED, BOOK_LEGS, NONOVER))
def _(spark, sf):
    book = pf.long_short_book(tradeable(spark, sf), "s1", "y3", 5, 3, bound=names_bound(spark, sf))
    return pf.portfolio_summary(book, 0.001)


DECILE = """dec AS (SELECT *, CASE WHEN nn < 10 THEN 0 WHEN o <= nn / 10.0 THEN -1.0 / floor(nn / 10.0)
    WHEN o > nn - nn / 10.0 THEN 1.0 / count(*) FILTER (WHERE o > nn - nn / 10.0) OVER (PARTITION BY date) ELSE 0 END AS w,
  dense_rank() OVER (ORDER BY date) - 1 AS pos
  FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY s1, entity) AS o, count(*) OVER (PARTITION BY date) AS nn
        FROM scored WHERE s1 IS NOT NULL AND y1 IS NOT NULL)),
bt AS (SELECT d.date, d.gross, 2 * coalesce(t.turnover, 0) AS turnover, d.gross - 2 * coalesce(t.turnover, 0) * 10 / 10000 AS pnl
  FROM (SELECT date, pos, sum(w * y1) AS gross FROM dec GROUP BY 1, 2) d
  LEFT JOIN (""" + turnover_sql("(SELECT pos, entity, w FROM dec WHERE w <> 0)") + """) t ON t.pos = d.pos)"""


@query("decile_backtest", "date gross~ turnover~ pnl~ equity~7",
       "SELECT *, product(1 + pnl) OVER (ORDER BY date) AS equity FROM bt", more(SCORED, DECILE))
def _(spark, sf):
    return pf.decile_backtest(scored(spark, sf), "s1", "y1", 10, 10.0, names_bound(spark, sf))


@query("decile_backtest_summary", "days# ann_return~ ann_vol~ sharpe~ avg_daily_turnover~ ann_cost_drag~ final_equity~7", """
SELECT count(*) AS days, avg(pnl) * 52 AS ann_return, stddev_samp(pnl) * sqrt(52) AS ann_vol,
       avg(pnl) * 52 / (stddev_samp(pnl) * sqrt(52)) AS sharpe, avg(turnover) AS avg_daily_turnover,
       avg(turnover) * 0.001 * 52 AS ann_cost_drag, product(1 + pnl) AS final_equity FROM bt""", more(SCORED, DECILE))
def _(spark, sf):
    bt = pf.decile_backtest(scored(spark, sf), "s1", "y1", 10, 10.0, names_bound(spark, sf))
    return pf.backtest_summary(bt, 10.0, 52)


def positions_sql(winsor: bool, sign: str = "") -> str:
    clip = "greatest(least(a, hi), lo)" if winsor else "a"
    return f"""pos AS (SELECT *, c / nullif(sum(abs(c)) OVER (PARTITION BY date), 0) AS position, dense_rank() OVER (ORDER BY date) AS dp
  FROM (SELECT *, b - quantile_cont(b, 0.5) OVER (PARTITION BY date) AS c
  FROM (SELECT *, CASE WHEN a IS NOT NULL THEN {clip} END AS b
  FROM (SELECT *, quantile_cont(a, 0.01) OVER (PARTITION BY date) AS lo, quantile_cont(a, 0.99) OVER (PARTITION BY date) AS hi
  FROM (SELECT *, CASE WHEN industry IS NOT NULL THEN u - avg(u) OVER (PARTITION BY date, industry) END AS a
  FROM (SELECT *, CASE WHEN volume >= 10 THEN {sign}s1 END AS u FROM scored)))))),
daily AS (SELECT x.date, sum(p.position * x.r) AS pnl, sum(abs(x.position - p.position)) AS tvr, count(x.position) AS n_pos,
  1 / nullif(sum(x.position * x.position), 0) AS eff_n
  FROM pos x LEFT JOIN pos p ON p.entity = x.entity AND p.dp = x.dp - 1 GROUP BY x.date)"""


def UNIVERSE():
    return F.col("volume") >= 10


@query("alpha_pnl_series", "date pnl~ tvr~ n_pos# eff_n~", "SELECT * FROM daily", more(SCORED, positions_sql(True)))
def _(spark, sf):
    b = names_bound(spark, sf)
    return pf.alpha_series(pf.alpha_positions(scored(spark, sf), "s1", UNIVERSE(), "industry", 0.01, b), "r")


@query("alpha_report", "ir~ ret~ tvr~ net_ir~ max_dd~ numstk~ days# ir_over_sqrt_tvr~ ir_daily~", """
SELECT *, ir / sqrt(greatest(tvr, 0.05)) AS ir_over_sqrt_tvr, ir / sqrt(52) AS ir_daily FROM (
SELECT sqrt(52) * avg(pnl) / stddev_samp(pnl) AS ir, 52 * avg(pnl) AS ret, avg(tvr) AS tvr,
       sqrt(52) * avg(net) / stddev_samp(net) AS net_ir, -min(nav / top - 1) AS max_dd, avg(n_pos) AS numstk, count(pnl) AS days
FROM (SELECT *, max(nav) OVER (ORDER BY date) AS top FROM (
  SELECT *, CASE WHEN pnl IS NOT NULL THEN pnl - 0.5 * 0.0005 * coalesce(tvr, 0) END AS net,
         product(1 + pnl) OVER (ORDER BY date) AS nav FROM daily)))""", more(SCORED, positions_sql(False)))
def _(spark, sf):
    b = names_bound(spark, sf)
    pos = pf.alpha_positions(scored(spark, sf), "s1", UNIVERSE(), "industry", None, b)
    return pf.alpha_report(pf.alpha_series(pos, "r"), 52)


@query("alpha_fitness", "ir~ tvr~ numstk~ eff_n~ days# dispersion~ cells# fitness~", """
SELECT *, CASE WHEN cells < 100 OR dispersion < 1e-4 OR eff_n < 5 OR days < 100 OR numstk < 20 OR tvr < 0.01 THEN -1
  ELSE ir / sqrt(greatest(tvr, 0.05)) * CASE WHEN ir / sqrt(52) < 0.07 THEN pow(greatest(ir / sqrt(52), 0) / 0.07, 2) ELSE 1 END END AS fitness
FROM (SELECT sqrt(52) * avg(pnl) / stddev_samp(pnl) AS ir, avg(tvr) AS tvr, avg(n_pos) AS numstk, avg(eff_n) AS eff_n, count(pnl) AS days FROM daily),
(SELECT quantile_cont(coalesce(sd / nullif(sc, 0), 0), 0.5) AS dispersion, sum(c) AS cells FROM (
  SELECT date, stddev_samp(u) AS sd, quantile_cont(abs(u), 0.5) AS sc, count(u) AS c
  FROM (SELECT date, CASE WHEN volume >= 10 THEN -s1 END AS u FROM scored) GROUP BY date))""", more(SCORED, positions_sql(True, "-")))
def _(spark, sf):
    return pf.alpha_fitness(scored(spark, sf).withColumn("alpha", -F.col("s1")), "alpha", "r", UNIVERSE(), "industry", min_numstk=20,
                            min_effective_n=5, trading_days=52, bound=names_bound(spark, sf))


GROUPS = """grp AS (SELECT date, ntile(5) OVER (PARTITION BY date ORDER BY s1, entity) AS g, y3 FROM scored WHERE s1 IS NOT NULL AND y3 IS NOT NULL),
gret AS (SELECT date, """ + ", ".join(f"avg(y3) FILTER (WHERE g = {k}) AS g{k}" for k in range(1, 6)) + " FROM grp GROUP BY date)"
GS = [f"g{k}" for k in range(1, 6)]


@query("sort_group_returns", "date " + " ".join(f"{g}~" for g in GS), "SELECT * FROM gret", more(SCORED, GROUPS))
def _(spark, sf):
    return ev.sort_group_returns(scored(spark, sf), "s1", "y3", 5, names_bound(spark, sf))


BOOT = """r AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS t, count(*) OVER () AS n FROM gret
  WHERE g1 IS NOT NULL AND g2 IS NOT NULL AND g3 IS NOT NULL AND g4 IS NOT NULL AND g5 IS NOT NULL),
u AS (SELECT t, n, rep, ('0x' || substr(md5('7|new|' || rep || '|' || t), 1, 7))::BIGINT / 268435456.0 AS u1,
  ('0x' || substr(md5('7|start|' || rep || '|' || t), 1, 7))::BIGINT / 268435456.0 AS u2 FROM r, range(1, 51) AS g(rep)),
blocks AS (SELECT *, CASE WHEN t = 0 OR u1 < 0.1 THEN t END AS t0, CASE WHEN t = 0 OR u1 < 0.1 THEN floor(u2 * n) END AS s0 FROM u),
idx AS (SELECT rep, t, CAST(last_value(s0 IGNORE NULLS) OVER w + t - last_value(t0 IGNORE NULLS) OVER w AS BIGINT) % n AS idx
  FROM blocks WINDOW w AS (PARTITION BY rep ORDER BY t))"""


@query("stationary_bootstrap", "rep# t# idx#", "SELECT * FROM idx", more(SCORED, GROUPS, BOOT))
def _(spark, sf):
    g = ev.sort_group_returns(scored(spark, sf), "s1", "y3", 5, names_bound(spark, sf)).dropna()
    cal = calendar(g).select((F.col("pos") - 1).alias("t"), F.col("n_dates").alias("n"))
    return ev.stationary_bootstrap(cal, 50, 10.0, 7)


@query("monotonic_relation_test", "statistic~ dates# p~ reps#", """
SELECT any_value(o.st) AS statistic, any_value(o.n) AS dates, count(*) AS reps,
  avg(CAST(least(b2 - b1 - d1, b3 - b2 - d2, b4 - b3 - d3, b5 - b4 - d4) > st AS DOUBLE)) AS p
FROM (SELECT rep, avg(g1) AS b1, avg(g2) AS b2, avg(g3) AS b3, avg(g4) AS b4, avg(g5) AS b5 FROM idx JOIN r ON r.t = idx.idx GROUP BY rep) b,
 (SELECT *, least(d1, d2, d3, d4) AS st FROM (SELECT count(*) AS n, avg(g2) - avg(g1) AS d1, avg(g3) - avg(g2) AS d2,
    avg(g4) - avg(g3) AS d3, avg(g5) - avg(g4) AS d4 FROM r)) o""", more(SCORED, GROUPS, BOOT))
def _(spark, sf):
    g = ev.sort_group_returns(scored(spark, sf), "s1", "y3", 5, names_bound(spark, sf))
    return ev.monotonic_relation(g, GS, 50, 10.0, 7)


@query("shape_spearman", "shape~", """
SELECT corr(k, rk) AS shape FROM (SELECT k, rank() OVER (ORDER BY m) AS rk FROM (SELECT g AS k, avg(m) AS m FROM (
  SELECT date, g, avg(y3) AS m FROM grp GROUP BY 1, 2) GROUP BY g))""", more(SCORED, GROUPS))
def _(spark, sf):
    return ev.shape_spearman(ev.sort_group_returns(scored(spark, sf), "s1", "y3", 5, names_bound(spark, sf)), GS)


@query("series_summary", "series mean~ se~ t~ sd~ n# lags# kernel", summary_sql(
    "(SELECT 'spread' AS series, date, g5 - g1 AS v0 FROM gret)", "v0", 2), more(SCORED, GROUPS))
def _(spark, sf):
    g = ev.sort_group_returns(scored(spark, sf), "s1", "y3", 5, names_bound(spark, sf))
    g = g.select(F.lit("spread").alias("series"), "date", (F.col("g5") - F.col("g1")).alias("v0"))
    return ev.series_summary(g, "v0", 2)


SLICES = (("first_half_1996", "1996-01-01", "1996-06-30"), ("year_1998", "1998-01-01", "1998-12-31"),
          ("overlap", "1998-07-01", "1999-06-30"))
SLICE_SQL = "slices(slice, a, b) AS (VALUES " + ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in SLICES) + ")"


@query("ic_slices", "slice mean~ se~ t~ n#", f"""
{summary_sql("(SELECT slice, date, ic FROM slices JOIN ics ON date BETWEEN a AND b WHERE series = 's1' UNION ALL "
             "SELECT 'calendar_' || year(date), date, ic FROM ics WHERE series = 's1')", "ic", 2, by="slice")}""",
       more(SCORED, IC2, SLICE_SQL))
def _(spark, sf):
    i = ics(spark, sf).where("series = 's1'")
    named = F.concat(ev.slice_label("date", SLICES), F.array(F.concat(F.lit("calendar_"), F.year("date"))))
    return ev.series_summary(i.withColumn("slice", F.explode(named)), "ic", 2, by=("slice",))


@query("episode_windows", "date entity episodes", """
SELECT p.date, p.entity, coalesce(string_agg(slice, ',' ORDER BY slice), '') AS episodes
FROM panel p LEFT JOIN slices ON date BETWEEN a AND b GROUP BY 1, 2""", more(PANEL, SLICE_SQL))
def _(spark, sf):
    p = weekly_panel(spark, sf).select("date", "entity")
    return p.withColumn("episodes", F.concat_ws(",", F.sort_array(ev.slice_label("date", SLICES))))


@query("calendar_decay_weights", "date weight~", """
SELECT date, pow(2, -(max(p) OVER () - p) / 50.0) AS weight FROM (SELECT date, row_number() OVER (ORDER BY date) AS p
FROM (SELECT DISTINCT date FROM panel))""", PANEL)
def _(spark, sf):
    return ev.decay_weights(calendar(weekly_panel(spark, sf)), 50.0)


@query("kish_ess_and_mass", "year# ess_dates~ ess_rows~ mass~", """
SELECT year, ess_dates, ess_rows, mass / sum(mass) OVER () AS mass FROM (
SELECT year(date) AS year, pow(sum(w), 2) / sum(w * w) AS ess_dates, pow(sum(w * c), 2) / sum(w * w * c) AS ess_rows, sum(w * c) AS mass
FROM (SELECT date, c, pow(2, -(max(p) OVER () - p) / 50.0) AS w FROM (SELECT date, count(*) AS c, row_number() OVER (ORDER BY date) AS p
  FROM panel GROUP BY date)) GROUP BY 1)""", PANEL)
def _(spark, sf):
    from ..operators.quality import weight_mass

    p = weekly_panel(spark, sf)
    return weight_mass(p, ev.decay_weights(calendar(p), 50.0))


@query("reliability_bins", "bin# confidence~ outcome~ weight~", f"""
SELECT bin, avg(c) AS confidence, avg(o) AS outcome, count(*) / sum(count(*)) OVER () AS weight FROM (
  SELECT c, o, greatest(least(ceil(c * 10) - 1, 9), 0) AS bin FROM (
  SELECT {avg_rank('s1', 'date')} / count(*) OVER (PARTITION BY date) AS c, CAST(y3 > 0 AS DOUBLE) AS o
  FROM scored WHERE s1 IS NOT NULL AND y3 IS NOT NULL)) GROUP BY bin""", SCORED)
def _(spark, sf):
    return ev.reliability(claims(spark, sf), "c", "o", 10)


def claims(spark, sf):
    d = scored(spark, sf).where("s1 is not null and y3 is not null")
    d = CrossSection(("date",), names_bound(spark, sf)).rank_pct(d, "s1", "c")
    return d.withColumn("o", (F.col("y3") > 0).cast("double"))


@query("expected_calibration_error", "ece~", f"""
SELECT sum(weight * abs(confidence - outcome)) AS ece FROM (
SELECT bin, avg(c) AS confidence, avg(o) AS outcome, count(*) / sum(count(*)) OVER () AS weight FROM (
  SELECT c, o, greatest(least(ceil(c * 10) - 1, 9), 0) AS bin FROM (
  SELECT {avg_rank('s1', 'date')} / count(*) OVER (PARTITION BY date) AS c, CAST(y3 > 0 AS DOUBLE) AS o
  FROM scored WHERE s1 IS NOT NULL AND y3 IS NOT NULL)) GROUP BY bin)""", SCORED)
def _(spark, sf):
    return ev.ece(ev.reliability(claims(spark, sf), "c", "o", 10))


@query("binary_auc", "auc~ recovery~", f"""
SELECT auc, greatest(auc, 1 - auc) AS recovery FROM (
SELECT (sum(rk) FILTER (WHERE l) - count(*) FILTER (WHERE l) * (count(*) FILTER (WHERE l) + 1) / 2.0)
       / (CAST(count(*) FILTER (WHERE l) AS DOUBLE) * count(*) FILTER (WHERE NOT l)) AS auc
FROM (SELECT {avg_rank('s1', 'one')} AS rk, y3 > 0 AS l FROM (SELECT *, 1 AS one FROM scored WHERE s1 IS NOT NULL AND y3 IS NOT NULL)))""", SCORED)
def _(spark, sf):
    return ev.binary_auc(scored(spark, sf), "s1", F.col("y3") > 0, bound=None)


def _report_sql():
    parts = []
    for s in ("s1", "s2"):
        for lag in (0, 1):
            src = f"(SELECT *, y_{lag} - avg(y_{lag}) OVER (PARTITION BY date) AS label FROM lagged)"
            ic = f"(SELECT 'x' AS series, * FROM ({ic_sql(s, 'label', src=src)}))"
            legs = f"""(SELECT 'x' AS series, date, avg(label) FILTER (WHERE o > n - n // 5) - avg(label) FILTER (WHERE o <= n // 5) AS spread FROM (
              SELECT *, row_number() OVER (PARTITION BY date ORDER BY {s}, entity) AS o, count(*) OVER (PARTITION BY date) AS n FROM {src} WHERE {s} IS NOT NULL AND label IS NOT NULL)
              GROUP BY date HAVING max(n) >= 5)"""
            parts.append(f"""SELECT '{s}' AS predictor, {lag} AS lag, a.mean AS mean_ic, a.t AS ic_t, a.n AS n_dates, b.mean AS mean_spread, b.t AS spread_t
              FROM ({summary_sql(ic, 'ic', 2)}) a, ({summary_sql(legs, 'spread', 2)}) b""")
    return " UNION ALL ".join(parts)


LAGGED = "lagged AS (SELECT *, " + ", ".join(
    f"CASE WHEN count(r) OVER f{k} = 3 THEN sum(r) OVER f{k} END AS y_{k}" for k in (0, 1)) + " FROM scored WINDOW " + ", ".join(
    f"f{k} AS (PARTITION BY entity ORDER BY date ROWS BETWEEN {1 + k} FOLLOWING AND {3 + k} FOLLOWING)" for k in (0, 1)) + ")"


@query("run_report", "predictor lag# mean_ic~ ic_t~6 n_dates# mean_spread~ spread_t~6", _report_sql(), more(SCORED, LAGGED))
def _(spark, sf):
    return ev.run_report(scored(spark, sf), ["s1", "s2"], "r", 3, (0, 1), 5, bound=names_bound(spark, sf))
