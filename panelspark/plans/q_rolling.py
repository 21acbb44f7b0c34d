"""Per-entity operators on the weekly panel, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import elementwise as e
from ..operators import rolling as ts
from ..sources.tables import by_entity, market_panel, names_bound, weekly_panel, with_market
from .oracle import MPANEL, PANEL, more
from .registry import query

KEY = "date entity "


def over(w: int, first: int | None = None) -> str:
    lo = w - 1 if first is None else first
    return f"(PARTITION BY entity ORDER BY date ROWS BETWEEN {lo} PRECEDING AND CURRENT ROW)"


E = "(PARTITION BY entity ORDER BY date)"
W20, W10, W5 = over(20), over(10), over(5)


NUMBERED = """numbered AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date) AS rn
 FROM panel)"""


def guard(agg: str, x: str, w: int, need: int | None = None) -> str:
    need = max(2, w // 2) if need is None else need
    return f"CASE WHEN count({x}) OVER {over(w)} >= {need} THEN {agg} OVER {over(w)} END"


def ts_query(name: str, outs: str, sql_cols: str, market: bool = False):
    """Register fn(panel) -> DataFrame for a query whose oracle is one select over the panel."""

    def wrap(fn):
        @query(name, KEY + outs, f"SELECT date, entity, {sql_cols} FROM {'m' if market else ''}panel",
               MPANEL if market else PANEL)
        def _(spark, sf):
            p = weekly_panel(spark, sf)
            return fn(with_market(p, names_bound(spark, sf)) if market else p)

        return fn

    return wrap


@ts_query("ts_mean_sum_max_min", "a~ b~ c~ d~",
          f"{guard('avg(sig)', 'sig', 20)} AS a, {guard('sum(sig)', 'sig', 20)} AS b, "
          f"{guard('max(sig)', 'sig', 20)} AS c, {guard('min(sig)', 'sig', 5)} AS d")
def _(p):
    return p.select("date", "entity", ts.mean("sig", 20).alias("a"), ts.sum_("sig", 20).alias("b"),
                    ts.max_("sig", 20).alias("c"), ts.min_("sig", 5).alias("d"))


@ts_query("ts_std_var", "a~ b~", f"{guard('stddev_samp(sig)', 'sig', 20)} AS a, "
          f"{guard('var_samp(sig)', 'sig', 10)} AS b")
def _(p):
    return p.select("date", "entity", ts.std("sig", 20).alias("a"), ts.var("sig", 10).alias("b"))


@ts_query("ts_median", "a~", f"{guard('quantile_cont(sig, 0.5)', 'sig', 20)} AS a")
def _(p):
    return p.select("date", "entity", ts.median("sig", 20).alias("a"))


@ts_query("ts_skew", "a~", f"{guard('skewness(sig)', 'sig', 20)} AS a")
def _(p):
    return p.select("date", "entity", ts.skew("sig", 20).alias("a"))


@ts_query("ts_delay_delta", "a~ b~", f"lag(close, 5) OVER {E} AS a, sig - lag(sig, 3) OVER {E} AS b")
def _(p):
    return p.select("date", "entity", ts.delay("close", 5).alias("a"), ts.delta("sig", 3).alias("b"))


@ts_query("ts_diff", "a~ b~",
          f"ret - 2 * lag(ret) OVER {E} + lag(ret, 2) OVER {E} AS a, "
          f"ret - 3 * lag(ret) OVER {E} + 3 * lag(ret, 2) OVER {E} - lag(ret, 3) OVER {E} AS b")
def _(p):
    return p.select("date", "entity", ts.diff("ret", 2).alias("a"), ts.diff("ret", 3).alias("b"))


@ts_query("ts_fill", "a~ b~",
          "last_value(sig IGNORE NULLS) OVER (PARTITION BY entity ORDER BY date "
          "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a, "
          "first_value(sig IGNORE NULLS) OVER (PARTITION BY entity ORDER BY date "
          "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b")
def _(p):
    return p.select("date", "entity", ts.fill("sig").alias("a"), ts.back_fill("sig").alias("b"))


@ts_query("ts_zscore_norm_std_normalized", "a~ b~ c~",
          f"(sig - {guard('avg(sig)', 'sig', 20)}) / nullif({guard('stddev_samp(sig)', 'sig', 20)}, 0) AS a, "
          f"sig - {guard('avg(sig)', 'sig', 10)} AS b, "
          f"sig / nullif({guard('stddev_samp(sig)', 'sig', 10)}, 0) AS c")
def _(p):
    return p.select("date", "entity", ts.zscore("sig", 20).alias("a"), ts.norm("sig", 10).alias("b"),
                    ts.std_normalized("sig", 10).alias("c"))


@query("ts_rank", KEY + "a~ b~", """
SELECT date, entity,
       CASE WHEN x IS NOT NULL AND n >= 10 THEN lo + (eq + 1) / 2.0 END AS a,
       CASE WHEN x IS NOT NULL AND n >= 10 THEN (lo + (eq + 1) / 2.0) / n END AS b
FROM (SELECT t.date, t.entity, any_value(t.sig) AS x, count(s.sig) AS n,
             count(*) FILTER (WHERE s.sig < t.sig) AS lo, count(*) FILTER (WHERE s.sig = t.sig) AS eq
      FROM numbered t JOIN numbered s ON s.entity = t.entity AND s.rn BETWEEN t.rn - 19 AND t.rn
      GROUP BY t.date, t.entity)""",
       more(PANEL, NUMBERED))
def _(spark, sf):
    p = weekly_panel(spark, sf)
    return p.select("date", "entity", ts.rank("sig", 20).alias("a"), ts.rank("sig", 20, pct=True).alias("b"))


@query("ts_decay_ewm", KEY + "a~", """
SELECT t.date, t.entity,
       CASE WHEN count(s.sig) >= 5
            THEN sum(s.sig * pow(1 - 2 / 11.0, t.rn - s.rn))
                 / sum(CASE WHEN s.sig IS NOT NULL THEN pow(1 - 2 / 11.0, t.rn - s.rn) END) END AS a
FROM numbered t JOIN numbered s ON s.entity = t.entity AND s.rn <= t.rn
GROUP BY t.date, t.entity""",
       more(PANEL, NUMBERED))
def _(spark, sf):
    p = weekly_panel(spark, sf).select("date", "entity", "sig")
    return ts.ewm_mean(p, "sig", 10, "a")


CORR = f"""CASE WHEN count(x) OVER {W20} >= 10 AND max(x) OVER {W20} > min(x) OVER {W20}
 AND max(y) OVER {W20} > min(y) OVER {W20} THEN corr(x, y) OVER {W20} END"""
PAIRS = """pairs AS (SELECT *, CASE WHEN mkt IS NOT NULL THEN sig END AS x,
 CASE WHEN sig IS NOT NULL THEN mkt END AS y FROM mpanel)"""


@query("ts_corr", KEY + "a~", f"SELECT date, entity, {CORR} AS a FROM pairs", more(MPANEL, PAIRS))
def _(spark, sf):
    p = market_panel(spark, sf)
    return p.select("date", "entity", ts.corr("sig", "mkt", 20).alias("a"))


@query("rolling_beta", KEY + "a~",
       f"SELECT date, entity, CASE WHEN count(x) OVER {W20} >= 10 "
       f"THEN regr_slope(x, y) OVER {W20} END AS a FROM pairs", more(MPANEL, PAIRS))
def _(spark, sf):
    p = market_panel(spark, sf)
    return p.select("date", "entity", ts.beta("sig", "mkt", 20, 10).alias("a"))


@query("rolling_moments", KEY + "n# mean_x~ mean_y~ sxx~ syy~ sxy~",
       f"""SELECT date, entity, CASE WHEN count(x) OVER {W20} >= 10 THEN count(x) OVER {W20} END AS n,
 avg(x) OVER {W20} AS mean_x, avg(y) OVER {W20} AS mean_y,
 CASE WHEN count(x) OVER {W20} >= 10 THEN regr_sxx(x, x) OVER {W20} END AS sxx,
 CASE WHEN count(x) OVER {W20} >= 10 THEN regr_sxx(y, y) OVER {W20} END AS syy,
 CASE WHEN count(x) OVER {W20} >= 10 THEN regr_sxy(x, y) OVER {W20} END AS sxy FROM pairs""",
       more(MPANEL, PAIRS))
def _(spark, sf):
    p = market_panel(spark, sf)
    m = ts.moments("sig", "mkt", 20, 10)
    return p.select("date", "entity", *[c.alias(k) for k, c in m.items()])


@ts_query("ts_harmonic_mean", "a~", f"CASE WHEN count(1 / nullif(close, 0)) OVER {W10} >= 5 "
          f"THEN count(close) OVER {W10} / sum(1 / close) OVER {W10} END AS a")
def _(p):
    return p.select("date", "entity", ts.harmonic_mean("close", 10).alias("a"))


@query("ts_argmax", KEY + "a#", f"""
SELECT date, entity, rn - arg_max(rn, sig) OVER {W20} AS a FROM numbered""", more(PANEL, NUMBERED))
def _(spark, sf):
    p = weekly_panel(spark, sf).withColumn("pos", F.row_number().over(by_entity()))
    return p.select("date", "entity", ts.argmax("sig", 20).alias("a"))


@ts_query("wma_linear_weights", "a~",
          f"(4 * close + 3 * lag(close) OVER {E} + 2 * lag(close, 2) OVER {E} + lag(close, 3) OVER {E}) / 10 AS a")
def _(p):
    return p.select("date", "entity", ts.weighted_lags("close", ts.linear_weights(4)).alias("a"))


@query("window_drawdown", KEY + "a~", """
SELECT t.date, t.entity,
       CASE WHEN count(s.ret) = 10
            THEN exp(least(min(t.cum - s.cum), min(CASE WHEN s.rn = t.rn - 9 THEN t.cum - s.before END))) - 1
       END AS a
FROM cums t JOIN cums s ON s.entity = t.entity AND s.rn BETWEEN t.rn - 9 AND t.rn
GROUP BY t.date, t.entity""",
       more(PANEL, """cums AS (SELECT *, cum - coalesce(ret, 0) AS before FROM (
 SELECT *, sum(coalesce(ret, 0)) OVER (PARTITION BY entity ORDER BY date) AS cum,
        row_number() OVER (PARTITION BY entity ORDER BY date) AS rn FROM panel))"""))
def _(spark, sf):
    p = weekly_panel(spark, sf)
    return p.select("date", "entity", ts.drawdown("ret", 10).alias("a"))


SPLIT_FACTOR = "CASE WHEN week(date) < 20 THEN 1.0 ELSE 2.0 END"


@query("volume_z_split_invariant", KEY + "a~", f"""
SELECT t.date, t.entity, CASE WHEN count(s.volume) >= 10
       THEN (any_value(t.volume) - avg(s.volume * s.f / t.f)) / nullif(stddev_samp(s.volume * s.f / t.f), 0) END AS a
FROM numbered t JOIN numbered s ON s.entity = t.entity AND s.rn BETWEEN t.rn - 19 AND t.rn
GROUP BY t.date, t.entity""",
       more(PANEL, f"""numbered AS (SELECT *, {SPLIT_FACTOR} AS f,
 row_number() OVER (PARTITION BY entity ORDER BY date) AS rn FROM panel)"""))
def _(spark, sf):
    p = weekly_panel(spark, sf).withColumn("f", F.when(F.weekofyear("date") < 20, 1.0).otherwise(2.0))
    return p.select("date", "entity", ts.volume_z("volume", "f", 20).alias("a"))


FWD5 = "(PARTITION BY entity ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"


@ts_query("forward_sum_and_log_return", "a~ b~",
          f"CASE WHEN count(sig) OVER {FWD5} = 5 THEN sum(sig) OVER {FWD5} END AS a, "
          f"ln(lead(close, 5) OVER {E}) - ln(close) AS b")
def _(p):
    return p.select("date", "entity", ts.forward_sum("sig", 5).alias("a"),
                    ts.forward_log_return("close", 5).alias("b"))


@ts_query("forward_daily_returns", "k# v~",
          f"unnest([1, 2, 3]) AS k, unnest([lead(sig) OVER {E}, lead(sig, 2) OVER {E}, lead(sig, 3) OVER {E}]) AS v")
def _(p):
    a = p.select("date", "entity", ts.forward_returns("sig", 3).alias("y"))
    return a.select("date", "entity", F.posexplode("y").alias("i", "v")).withColumn("k", F.col("i") + 1)


@ts_query("post_fill_used", "a", f"coalesce(max(CAST(n_trades >= 4 AS INT)) OVER {FWD5} = 1, false) AS a")
def _(p):
    return p.select("date", "entity", ts.forward_any(F.col("n_trades") >= 4, 5).alias("a"))


@ts_query("price_index", "log_index~",
          "CASE WHEN sig IS NOT NULL THEN sum(coalesce(ln(1 + (exp(sig) - 1)), 0)) OVER "
          "(PARTITION BY entity ORDER BY date) END AS log_index")
def _(p):
    return p.select("date", "entity", F.log(ts.price_index(F.expm1("sig"))).alias("log_index"))


@ts_query("sequence_window", "first_a~ last_b~ size#",
          f"CASE WHEN count(*) OVER {W5} = 5 THEN lag(close, 4) OVER {E} END AS first_a, "
          f"CASE WHEN count(*) OVER {W5} = 5 THEN volume END AS last_b, "
          f"CASE WHEN count(*) OVER {W5} = 5 THEN 5 END AS size")
def _(p):
    s = p.select("date", "entity", ts.sequence_window(["close", "volume"], 5).alias("s"))
    return s.select("date", "entity", F.col("s")[0][0].alias("first_a"), F.col("s")[4][1].alias("last_b"),
                    F.when(F.col("s").isNotNull(), F.size("s")).alias("size"))


@ts_query("sequence_window_padded", "first_a~ size#",
          "coalesce(lag(close, 4) OVER (PARTITION BY entity ORDER BY date), "
          "first_value(close) OVER (PARTITION BY entity ORDER BY date)) AS first_a, 5 AS size")
def _(p):
    s = p.select("date", "entity", ts.sequence_window(["close"], 5, pad=True).alias("s"))
    return s.select("date", "entity", F.col("s")[0][0].alias("first_a"), F.size("s").alias("size"))


@query("rolling_ic", KEY + "a~", f"""
SELECT date, entity, {CORR} AS a
FROM (SELECT *, CASE WHEN sig IS NOT NULL THEN l END AS x, CASE WHEN l IS NOT NULL THEN sig END AS y
      FROM (SELECT *, lag(volume) OVER {E} AS l FROM panel))""", PANEL)
def _(spark, sf):
    p = weekly_panel(spark, sf).withColumn("l", ts.delay("volume", 1))
    return p.select("date", "entity", ts.corr("l", "sig", 20).alias("a"))


@ts_query("sequence_block_statistics", "a~ b~ c~ d~ r~",
          f"avg(sig) OVER {W10} AS a, stddev_samp(sig) OVER {W10} AS b, min(sig) OVER {W10} AS c, "
          f"max(sig) OVER {W10} AS d, sig - avg(sig) OVER {W10} AS r")
def _(p):
    return p.select("date", "entity", ts.mean("sig", 10, 1).alias("a"), ts.std("sig", 10, 1).alias("b"),
                    ts.min_("sig", 10, 1).alias("c"), ts.max_("sig", 10, 1).alias("d"),
                    ts.norm("sig", 10, 1).alias("r"))


@ts_query("rate_divide_mean_residual", "a~ b~ c~ d~",
          f"close / nullif(lag(close, 3) OVER {E}, 0) AS a, "
          "coalesce(CASE WHEN isfinite(sig / nullif(ret, 0)) THEN sig / nullif(ret, 0) END, 0) AS b, "
          "sig - avg(sig) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS c, "
          f"CASE WHEN count(close) OVER {W20} >= 20 AND max(volume) OVER {W20} > min(volume) OVER {W20} "
          f"THEN corr(close, volume) OVER {W20} END AS d")
def _(p):
    return p.select("date", "entity", ts.rate("close", 3).alias("a"),
                    e.null_to_zero(e.div("sig", "ret")).alias("b"), ts.mean_residual("sig", 5).alias("c"),
                    ts.corr("close", "volume", 20, 20).alias("d"))


@ts_query("nav_drawdown", "a~",
          "close / max(close) OVER (PARTITION BY entity ORDER BY date) - 1 AS a")
def _(p):
    return p.select("date", "entity", ts.nav_drawdown("close").alias("a"))
