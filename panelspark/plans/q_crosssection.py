"""Cross-sectional operators: per date over the weekly panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crosssection as xsec
from ..operators import rolling as ts
from ..operators import universe as uni
from ..sources.tables import names_bound, weekly_panel
from .oracle import PANEL, more
from .registry import query

KEY = "date entity "
AVG_RANK = ("CASE WHEN sig IS NOT NULL THEN rank() OVER (PARTITION BY {by} ORDER BY sig NULLS LAST) "
            "+ (count(*) OVER (PARTITION BY {by}, sig) - 1) / 2.0 END")
R = AVG_RANK.format(by="date")
N = "count(sig) OVER (PARTITION BY date)"


def xs(spark, sf, *by):
    """Cross-section of one date, bounded by the entity dimension's row count."""
    return xsec.CrossSection(by or ("date",), names_bound(spark, sf))


def cs_query(name, outs, sql_cols, prefix=PANEL, source="panel"):
    """Register fn(cross section, panel) with a one-select oracle."""

    def wrap(fn):
        @query(name, KEY + outs, f"SELECT date, entity, {sql_cols} FROM {source}", prefix)
        def _(spark, sf):
            return fn(xs(spark, sf), weekly_panel(spark, sf))

        return fn

    return wrap


@cs_query("cs_rank_pct", "a~", f"{R} / {N} AS a")
def _(c, p):
    return c.rank_pct(p, "sig", "a")


@cs_query("cs_rank_dense", "a~", "CASE WHEN sig IS NOT NULL THEN 1 + (d - 1.0) / nullif(max(d) FILTER (WHERE sig IS NOT NULL) "
          "OVER (PARTITION BY date) - 1, 0) END AS a",
          source="(SELECT *, dense_rank() OVER (PARTITION BY date ORDER BY sig NULLS LAST) AS d FROM panel)")
def _(c, p):
    return c.rank_dense12(p, "sig", "a")


@cs_query("cs_rank_centered", "a~", f"{R} / {N} - 0.5 AS a")
def _(c, p):
    return c.rank_centered(p, "sig", "a")


@cs_query("cs_rank_ordinal", "a~", "CASE WHEN sig IS NOT NULL THEN (row_number() OVER (PARTITION BY date ORDER BY sig NULLS LAST, entity) - 1) "
          f"/ (CAST({N} AS DOUBLE) - 1) - 0.5 END AS a")
def _(c, p):
    return c.rank_ordinal(p, "sig", "a")


@query("rank_to_unit", KEY + "a~ b~", f"""
SELECT date, entity, 2 * ({R} - 1) / ({N} - 1) - 1 AS a,
       CASE WHEN sig IS NULL THEN NULL WHEN nn = 1 THEN 0 ELSE 2 * (ri - 1) / (nn - 1) - 1 END AS b
FROM (SELECT *, {AVG_RANK.format(by='date, sector')} AS ri, count(sig) OVER (PARTITION BY date, sector) AS nn FROM panel)""",
       PANEL)
def _(spark, sf):
    p = xs(spark, sf).rank_to_unit(weekly_panel(spark, sf), "sig", "a")
    return xs(spark, sf, "date", "sector").rank_to_unit(p, "sig", "b")


@cs_query("cs_zscore", "a~", "(sig - avg(sig) OVER (PARTITION BY date)) / nullif(stddev_samp(sig) OVER (PARTITION BY date), 0) AS a")
def _(c, p):
    return c.zscore(p, "sig", "a")


@cs_query("cs_scale", "a~", "1 + (sig - min(sig) OVER (PARTITION BY date)) / nullif(max(sig) OVER (PARTITION BY date) "
          "- min(sig) OVER (PARTITION BY date), 0) AS a")
def _(c, p):
    return c.scale12(p, "sig", "a")


QS = ("(SELECT *, quantile_cont(sig, 0.05) OVER (PARTITION BY date) AS lo, "
      "quantile_cont(sig, 0.95) OVER (PARTITION BY date) AS hi, quantile_cont(sig, 0.5) OVER (PARTITION BY date) AS med FROM panel)")


@cs_query("cs_winsor", "a~ b~", "CASE WHEN sig IS NOT NULL THEN greatest(least(sig, hi), lo) END AS a, "
          "CASE WHEN sig IS NULL THEN NULL WHEN sig < lo OR sig > hi THEN 0 ELSE sig END AS b", source=QS)
def _(c, p):
    return c.winsor(c.winsor(p, "sig", "a", 0.05), "sig", "b", 0.05, remove_extreme=True)


@cs_query("cs_remove_middle", "a~", "CASE WHEN pr <= 0.1 OR pr > 0.9 THEN sig END AS a",
          source=f"(SELECT *, {R} / {N} AS pr FROM panel)")
def _(c, p):
    return c.remove_middle(p, "sig", "a", 0.8)


@cs_query("cs_indneut", "a~", "CASE WHEN sector IS NOT NULL THEN sig - avg(sig) OVER (PARTITION BY date, sector) END AS a")
def _(c, p):
    return c.demean(p, "sig", "a", "sector")


@query("cs_factorneut", KEY + "a~6 b~6", """
SELECT p.date, p.entity, sig - f.b0 - f.b1 * ldv AS a,
       CASE WHEN sig IS NOT NULL AND lv IS NOT NULL THEN
         (sig - my) - ((sy1 * s22 - sy2 * s12) * (ldv - m1) + (sy2 * s11 - sy1 * s12) * (lv - m2)) / nullif(s11 * s22 - s12 * s12, 0) END AS b
FROM logs p
LEFT JOIN (SELECT date, regr_slope(sig, ldv) AS b1, regr_intercept(sig, ldv) AS b0, avg(sig) AS my, avg(ldv) AS m1, avg(lv) AS m2,
             var_pop(ldv) AS s11, var_pop(lv) AS s22, covar_pop(ldv, lv) AS s12,
             covar_pop(sig, ldv) AS sy1, covar_pop(sig, lv) AS sy2
      FROM logs WHERE sig IS NOT NULL GROUP BY date) f ON f.date = p.date""",
       more(PANEL, "logs AS (SELECT *, ln(dollar_volume) AS ldv, ln(volume) AS lv FROM panel)"))
def _(spark, sf):
    p = weekly_panel(spark, sf)
    p = p.withColumn("ldv", F.log("dollar_volume")).withColumn("lv", F.log("volume"))
    c = xs(spark, sf)
    return c.factor_neutral(c.factor_neutral(p, "sig", ["ldv"], "a"), "sig", ["ldv", "lv"], "b")


BOOKS = ("(SELECT *, sum(sig) FILTER (WHERE sig > 0) OVER (PARTITION BY date) AS lb, "
         "-sum(sig) FILTER (WHERE sig < 0) OVER (PARTITION BY date) AS sb FROM panel)")


@cs_query("cs_booksize", "a~", "CASE WHEN sig > 0 THEN sig * 100 / lb WHEN sig < 0 THEN sig * 100 / sb ELSE sig END AS a", source=BOOKS)
def _(c, p):
    return c.booksize(p, "sig", "a", 100.0)


@cs_query("cs_shrink_balance", "a~", "CASE WHEN sig > 0 THEN sig * least(coalesce(lb, 0), coalesce(sb, 0)) / lb "
          "WHEN sig < 0 THEN sig * least(coalesce(lb, 0), coalesce(sb, 0)) / sb ELSE sig END AS a", source=BOOKS)
def _(c, p):
    return c.shrink_balance(p, "sig", "a")


@cs_query("cs_poslimit", "a~", "CASE WHEN sig > 0 THEN least(sig, 0.05 * lb) WHEN sig < 0 THEN -least(-sig, 0.05 * sb) "
          "ELSE sig END AS a", source=BOOKS)
def _(c, p):
    return c.poslimit(p, "sig", "a", 0.05)


@cs_query("cs_harmonic_mean", "a~", "count(close) OVER (PARTITION BY date) / sum(1 / close) OVER (PARTITION BY date) AS a")
def _(c, p):
    return c.harmonic_mean(p, "close", "a")


FWD = "CASE WHEN count(sig) OVER f = 3 THEN sum(sig) OVER f END AS y"
FWD_WIN = "WINDOW f AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)"


@query("market_neutral_target", KEY + "a~", f"""
SELECT date, entity, y - avg(CASE WHEN n_trades >= 2 AND y IS NOT NULL THEN y END) OVER (PARTITION BY date) AS a
FROM (SELECT *, {FWD} FROM panel {FWD_WIN})""", PANEL)
def _(spark, sf):
    p = weekly_panel(spark, sf).withColumn("y", ts.forward_sum("sig", 3))
    return xs(spark, sf).eligible_demean(p, "y", F.col("n_trades") >= 2, "a")


@cs_query("sector_mean_weighted", "a~", "CASE WHEN sector IS NOT NULL AND sum(CASE WHEN sig IS NOT NULL THEN volume END) OVER s > 0 "
          "THEN sum(sig * volume) OVER s / sum(CASE WHEN sig IS NOT NULL THEN volume END) OVER s END AS a",
          source="panel WINDOW s AS (PARTITION BY date, sector)")
def _(c, p):
    return xsec.CrossSection(("date", "sector"), c.bound).weighted_mean(p, "sig", "volume", "a")


MOM = "CASE WHEN count(sig) OVER {w} >= 5 THEN sum(sig) OVER {w} END".format(
    w="(PARTITION BY entity ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")


@query("industry_signals", KEY + "mom~ rel~", f"""
SELECT date, entity, CASE WHEN sector IS NOT NULL THEN sum(m * volume) OVER s / sum(CASE WHEN m IS NOT NULL THEN volume END) OVER s END AS mom,
       CASE WHEN sector IS NOT NULL THEN sig - sum(sig * volume) OVER s / sum(CASE WHEN sig IS NOT NULL THEN volume END) OVER s END AS rel
FROM (SELECT *, {MOM} AS m FROM panel) WINDOW s AS (PARTITION BY date, sector)""", PANEL)
def _(spark, sf):
    p = weekly_panel(spark, sf).withColumn("m", ts.sum_("sig", 10))
    s = xs(spark, sf, "date", "sector")
    p = s.weighted_mean(s.weighted_mean(p, "m", "volume", "mom"), "sig", "volume", "_s")
    return p.withColumn("rel", F.col("sig") - F.col("_s"))


@query("within_sector_rank", KEY + "a~", f"""
SELECT date, entity, CASE WHEN sig IS NULL THEN NULL
   WHEN sector IS NOT NULL AND nn >= 15 THEN 2 * (ri - 1) / (nn - 1) - 1
   ELSE 2 * ({R} - 1) / ({N} - 1) - 1 END AS a
FROM (SELECT *, {AVG_RANK.format(by='date, sector')} AS ri, count(sig) OVER (PARTITION BY date, sector) AS nn FROM panel)""", PANEL)
def _(spark, sf):
    return xs(spark, sf).within_or_all(weekly_panel(spark, sf), "sig", "sector", "a", 15)


@cs_query("zero_fill_flags", "sig~ ret~ sig_missing ret_missing",
          "coalesce(sig, 0) AS sig, coalesce(ret, 0) AS ret, sig IS NULL AS sig_missing, (ret IS NULL) OR (sector IS NULL) AS ret_missing")
def _(c, p):
    return uni.zero_fill(p, ["sig", "ret"], {"sig_missing": ["sig"], "ret_missing": ["ret", "sector"]})


@cs_query("thin_date_filter", "sig~", "sig", source="(SELECT * FROM panel QUALIFY count(*) OVER (PARTITION BY date) >= 80)")
def _(c, p):
    return c.at_least(p, 80)


@cs_query("universe_split", "small volatile cheap", "pv <= 0.5 AS small, "
          "CASE WHEN s IS NOT NULL THEN ps > 0.5 END AS volatile, pc <= 0.5 AS cheap",
          source="""(SELECT *, (rank() OVER (PARTITION BY date ORDER BY dollar_volume) + (count(*) OVER (PARTITION BY date, dollar_volume) - 1) / 2.0)
   / count(*) OVER (PARTITION BY date) AS pv,
  (rank() OVER (PARTITION BY date ORDER BY close) + (count(*) OVER (PARTITION BY date, close) - 1) / 2.0) / count(*) OVER (PARTITION BY date) AS pc,
  (rank() OVER (PARTITION BY date ORDER BY s NULLS LAST) + (count(*) OVER (PARTITION BY date, s) - 1) / 2.0) / count(s) OVER (PARTITION BY date) AS ps
  FROM (SELECT *, CASE WHEN count(sig) OVER w >= 10 THEN stddev_samp(sig) OVER w END AS s FROM panel
        WINDOW w AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)))""")
def _(c, p):
    p = p.withColumn("s", ts.std("sig", 20))
    return uni.universe_halves(c, p, {"small": ("dollar_volume", "low"), "volatile": ("s", "high"), "cheap": ("close", "low")})


@query("top_n_mask", KEY + "in_universe", """
SELECT p.date, p.entity, t.entity IS NOT NULL AND p.date BETWEEN s.lo AND s.hi AS in_universe
FROM panel p JOIN (SELECT entity, min(date) AS lo, max(date) AS hi FROM panel GROUP BY 1) s ON s.entity = p.entity
LEFT JOIN (SELECT entity, date_trunc('month', date) AS m FROM panel WHERE adv IS NOT NULL AND
             date IN (SELECT min(date) FROM panel GROUP BY date_trunc('month', date))
           QUALIFY row_number() OVER (PARTITION BY date ORDER BY adv DESC, entity) <= 30) t
  ON t.entity = p.entity AND t.m = date_trunc('month', p.date)""",
       more(PANEL.replace("panel AS (", "panel0 AS ("), """panel AS (SELECT *, CASE WHEN count(dollar_volume) OVER w >= 5
  THEN avg(dollar_volume) OVER w END AS adv FROM panel0 WINDOW w AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))"""))
def _(spark, sf):
    p = weekly_panel(spark, sf).withColumn("adv", ts.mean("dollar_volume", 10))
    return uni.top_n_mask(xs(spark, sf), p, "adv", 30, "in_universe")


@cs_query("median_neutral_unit_gross", "a~", "(sig - med) / nullif(sum(abs(sig - med)) OVER (PARTITION BY date), 0) AS a", source=QS)
def _(c, p):
    return c.unit_gross(p, "sig", "a")


@cs_query("tent_score", "a~", f"1 - 2 * abs({R} / {N} - 0.5) AS a")
def _(c, p):
    return c.tent(p, "sig", "a")


@query("utilisation_by_date", "date u0~ u1~ u2~", """
SELECT date, avg(volume / (volume + n_trades + 1)) AS u0, avg(n_trades / (volume + n_trades + 1)) AS u1,
       avg(1 / (volume + n_trades + 1)) AS u2 FROM panel GROUP BY date""", PANEL)
def _(spark, sf):
    p = weekly_panel(spark, sf)
    total = F.col("volume") + F.col("n_trades") + 1
    p = p.withColumns({"u0": F.col("volume") / total, "u1": F.col("n_trades") / total, "u2": 1 / total})
    return uni.utilisation_by_date(p, ["u0", "u1", "u2"])
