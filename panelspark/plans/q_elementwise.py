"""Element-wise expressions and filters on the weekly panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import elementwise as e
from ..operators import rolling as ts
from ..sources.tables import by_entity, table, weekly_panel
from .oracle import PANEL
from .q_regimes import NORM
from .q_rolling import KEY, ts_query
from .registry import query

E = "(PARTITION BY entity ORDER BY date)"


@ts_query("simple_and_log_returns", "r1~ r5~ r10~ r20~ l1~",
          ", ".join(f"close / nullif(lag(close, {n}) OVER {E}, 0) - 1 AS r{n}" for n in (1, 5, 10, 20))
          + f", ln(close / lag(close) OVER {E}) AS l1")
def _(p):
    return p.select("date", "entity", *[ts.simple_return("close", n).alias(f"r{n}") for n in (1, 5, 10, 20)],
                    ts.log_return("close").alias("l1"))


@ts_query("dollar_volume", "log_dv~ log_dv_fallback~", "ln(abs(close) * volume) AS log_dv, "
          "ln(abs(coalesce(CASE WHEN n_trades > 1 THEN open END, close)) * volume) AS log_dv_fallback")
def _(p):
    p = p.withColumn("raw", F.when(F.col("n_trades") > 1, F.col("open")))
    return p.select("date", "entity", F.log(e.dollar_volume("close", "volume")).alias("log_dv"),
                    F.log(e.dollar_volume("raw", "volume", "close")).alias("log_dv_fallback"))


@ts_query("sanitize_and_safe_division", "a~ b~ c~ d~",
          "CASE WHEN abs(ret * 1e15) < 1e15 THEN ret END AS a, 1 / nullif(n_trades - 1.0, 0) AS b, "
          "coalesce(sig, 0) AS c, nullif(n_trades - 1.0, 0) AS d")
def _(p):
    n = F.col("n_trades") - 1.0
    return p.select("date", "entity", (e.sanitize(F.col("ret") * 1e15) / 1e15).alias("a"),
                    e.div(F.lit(1.0), n).alias("b"), e.null_to_zero("sig").alias("c"),
                    e.zero_to_null(n).alias("d"))


@ts_query("arithmetic", "a~ b~ c~ d~ n~", "sig + ret AS a, sig - close / 1000 AS b, sig * ret AS c, "
          "sig / nullif(ret, 0) AS d, -sig AS n")
def _(p):
    return p.select("date", "entity", e.add("sig", "ret").alias("a"),
                    e.sub("sig", F.col("close") / 1000).alias("b"), e.mul("sig", "ret").alias("c"),
                    e.div("sig", "ret").alias("d"), e.neg("sig").alias("n"))


@ts_query("signed_log_and_sqrt", "a~ b~", "sign(sig) * ln(1 + abs(sig)) AS a, sign(sig) * sqrt(abs(sig) + 1) AS b")
def _(p):
    return p.select("date", "entity", e.signlog("sig").alias("a"), e.signsqrt("sig").alias("b"))


@ts_query("math_functions", "a~ b~ c~ d~ g~",
          "(exp(sig) - exp(-sig)) / (exp(sig) + exp(-sig)) AS a, abs(sig) AS b, "
          "CASE WHEN sig > 0 THEN ln(sig) END AS c, CASE WHEN sig > 0.1 THEN close ELSE volume END AS d, "
          "CASE WHEN sig >= 0 THEN sqrt(sig) END AS g")
def _(p):
    return p.select("date", "entity", F.tanh("sig").alias("a"), F.abs("sig").alias("b"), e.log("sig").alias("c"),
                    F.when(F.col("sig") > 0.1, F.col("close")).otherwise(F.col("volume")).alias("d"),
                    e.sqrt("sig").alias("g"))


@ts_query("signed_bucket", "k#", "CAST(sign(sig) AS INT) * (CAST(abs(sig) >= 0.2 AS INT) + CAST(abs(sig) >= 0.5 AS INT) "
          "+ CAST(abs(sig) >= 1.0 AS INT)) AS k")
def _(p):
    return p.select("date", "entity", e.signed_bucket("sig", (0.2, 0.5, 1.0)).alias("k"))


@query("drop_extreme_labels", KEY + "sig~", "SELECT date, entity, sig FROM panel WHERE abs(sig) < 0.2", PANEL)
def _(spark, sf):
    p = weekly_panel(spark, sf)
    return p.where(F.abs("sig") < 0.2).select("date", "entity", "sig")


@ts_query("universe_mask", "a~", "CASE WHEN n_trades >= 2 THEN sig END AS a")
def _(p):
    return p.select("date", "entity", e.masked("sig", F.col("n_trades") >= 2).alias("a"))


@ts_query("tradable_flag", "tradable", f"lead(date) OVER {E} IS NOT NULL OR n_trades > 1 AS tradable")
def _(p):
    # the last row of a name that traded once plays the delisting row
    last = F.lead("date").over(by_entity()).isNull()
    return p.select("date", "entity", (~(last & (F.col("n_trades") == 1))).alias("tradable"))


@query("valid_rows", KEY + "y~", f"""
SELECT date, entity, y FROM (
  SELECT date, entity, sum(sig) OVER f AS y, count(sig) OVER f AS nf,
         count(ret) OVER b AS nb, close, volume
  FROM panel WINDOW f AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING),
                    b AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
WHERE nf = 3 AND nb = 5 AND close IS NOT NULL AND volume IS NOT NULL""", PANEL)
def _(spark, sf):
    p = weekly_panel(spark, sf)
    p = p.withColumn("y", ts.forward_sum("sig", 3)).withColumn("have", F.count("ret").over(ts.frame(5)))
    return p.where((F.col("have") == 5)).dropna(subset=["y", "close", "volume"]).select("date", "entity", "y")


@ts_query("sector_dummies", " ".join(f"sector_{k}~" for k in range(5)),
          ", ".join(f"CASE WHEN sector = {k} THEN 1.0 ELSE 0.0 END AS sector_{k}" for k in range(5)))
def _(p):
    return p.select("date", "entity", *e.sector_dummies("sector", range(5)))


@query("feature_columns", "feature n#", """
SELECT feature, count(v) AS n FROM (UNPIVOT (SELECT CAST(n_trades AS DOUBLE) AS n_trades, CAST(industry AS DOUBLE) AS industry,
 CAST(sector AS DOUBLE) AS sector, dollar_volume, ret, sig FROM panel)
 ON n_trades, industry, sector, dollar_volume, ret, sig INTO NAME feature VALUE v) GROUP BY feature""", PANEL)
def _(spark, sf):
    from ..operators.features import feature_columns

    p = weekly_panel(spark, sf)
    names = feature_columns(p)
    counts = p.agg(*[F.count(c).alias(c) for c in names])
    return counts.unpivot([], names, "feature", "n")


@query("clip_window", KEY + "a~", """
SELECT date, entity, a FROM (
  SELECT date, entity, CASE WHEN count(sig) OVER w >= 10 THEN avg(sig) OVER w END AS a
  FROM panel WINDOW w AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'""", PANEL)
def _(spark, sf):
    # the filter comes after the window, so earlier rows still feed it
    p = weekly_panel(spark, sf).select("date", "entity", ts.mean("sig", 20).alias("a"))
    return p.where(F.col("date").between("1997-01-01", "1998-12-31"))


@query("valid_links", "supplier# customer_part# quarter n#", """
SELECT l_suppkey AS supplier, l_partkey AS customer_part, l_returnflag || l_linestatus AS quarter, count(*) AS n
FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linestatus IN ('F') AND l_partkey IS NOT NULL
GROUP BY ALL""")
def _(spark, sf):
    from ..operators.pit import valid_links

    li = table(spark, sf, "lineitem")
    kept = valid_links(li, "l_returnflag", ("A", "R"), "l_linestatus", ("F",), "l_partkey")
    return kept.groupBy(
        F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("customer_part"),
        F.concat("l_returnflag", "l_linestatus").alias("quarter"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("normalize_ticker", "p_partkey# ticker", r"""
SELECT p_partkey, CASE WHEN regexp_full_match(t, '[A-Z][A-Z0-9-]{0,6}') THEN t END AS ticker
FROM (SELECT p_partkey, replace(upper(trim(' ' || substr(p_name, 1 + p_partkey % 6) || '.A ')), '.', '-') AS t FROM part)""")
def _(spark, sf):
    raw = F.concat(F.lit(" "), F.expr("substr(p_name, 1 + p_partkey % 6)"), F.lit(".A "))
    return table(spark, sf, "part").select("p_partkey", e.normalize_ticker(raw).alias("ticker"))


@query("computed_period_end", "o_orderkey# period_end", """
SELECT o_orderkey, last_day(make_date(CAST(floor(i / 12) AS INT), CAST(i % 12 + 1 AS INT), 1)) AS period_end
FROM (SELECT o_orderkey, (y + CASE WHEN m <= 5 THEN 1 ELSE 0 END) * 12 + (m - 1) - 3 * (4 - q) AS i
      FROM (SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, o_custkey % 12 + 1 AS m FROM orders))""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", e.period_end(
        F.year("o_orderdate"), F.quarter("o_orderdate"), F.col("o_custkey") % 12 + 1).alias("period_end"))


@ts_query("hard_split", "calm~ stress~", "1 - CAST(sig > 0.3 AS INT) AS calm, CAST(sig > 0.3 AS INT) AS stress")
def _(p):
    calm, stress = e.hard_split("sig", 0.3)
    return p.select("date", "entity", calm.alias("calm"), stress.alias("stress"))


@query("p_value", KEY + "p_less~7 p_two~7", f"""
SELECT date, entity, cdf AS p_less, 2 * least(cdf, 1 - cdf) AS p_two FROM (
  SELECT date, entity, {NORM} AS cdf FROM (SELECT date, entity, sig * 2 AS t FROM panel))""", PANEL)
def _(spark, sf):
    p = weekly_panel(spark, sf).withColumn("t", F.col("sig") * 2)
    return p.select("date", "entity", e.p_value("t", "less").alias("p_less"), e.p_value("t").alias("p_two"))


@ts_query("window_gates", "near far between", "day(last_day(date)) - day(date) <= 5 AS near, "
          "day(date) >= 20 AS far, day(date) BETWEEN 10 AND 15 AS between")
def _(p):
    until = F.dayofmonth(F.last_day("date")) - F.dayofmonth("date")
    return p.select("date", "entity", e.gate_within(until, hi=5).alias("near"),
                    e.gate_within(F.dayofmonth("date"), lo=20).alias("far"),
                    e.gate_within(F.dayofmonth("date"), 10, 15).alias("between"))


@ts_query("sign_of_return", "a~", "ret / nullif(abs(ret), 0) AS a")
def _(p):
    return p.select("date", "entity", e.sign_of("ret").alias("a"))


@query("cut_at_end", KEY + "y~", """
SELECT date, entity, CASE WHEN lead(close, 4) OVER (PARTITION BY entity ORDER BY date) IS NOT NULL
  THEN ln(lead(close, 4) OVER (PARTITION BY entity ORDER BY date)) - ln(close) END AS y
FROM panel WHERE date <= DATE '1999-12-31'""", PANEL)
def _(spark, sf):
    from ..operators.splits import cut_at

    p = cut_at(weekly_panel(spark, sf), "1999-12-31", allowed_end="2001-12-31")
    return p.select("date", "entity", ts.forward_log_return("close", 4).alias("y"))


@query("required_history", "need_back# have_back# need_forward# have_forward# ok", """
SELECT 20 AS need_back, count(*) FILTER (WHERE date < DATE '1996-01-01') AS have_back, 5 AS need_forward,
       count(*) FILTER (WHERE date > DATE '2001-06-01') AS have_forward,
       count(*) FILTER (WHERE date < DATE '1996-01-01') >= 20
         AND count(*) FILTER (WHERE date > DATE '2001-06-01') >= 5 AS ok
FROM (SELECT DISTINCT date FROM panel)""", PANEL)
def _(spark, sf):
    from ..operators.splits import history_check

    return history_check(weekly_panel(spark, sf), "1996-01-01", "2001-06-01", windows=(5, 10, 20), horizon=5)
