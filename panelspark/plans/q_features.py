"""Named feature sets over the weekly panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as ft
from ..operators import pit
from ..operators import quality as ql
from ..operators import rolling as ts
from ..operators import tradingcal as tc
from ..operators.crosssection import CrossSection
from ..operators.sampling import balanced_sample
from ..operators.splits import calendar, purge_overlap
from ..sources.tables import (
    market_panel, market_series, names_bound, table, user_hours, weekly_bars, weekly_panel, with_market,
)
from .chain import Chain, lag, mean, rows, skew, std, tmax, tmin, tsum, var
from .oracle import MPANEL, PANEL, WEEK_BARS, more, with_
from .q_pit import DAY_BARS, FACTS, PIT_VALUES, QUARTERS, fundamentals, quarters
from .q_splits import BUSY, busy_days
from .registry import query

KEY = "date entity# "


def xs(spark, sf):
    return CrossSection(("date",), names_bound(spark, sf))


def feat(name, c: Chain, outs, market=True, where=""):
    def wrap(fn):
        cols = ", ".join(t.rstrip("#").split("~")[0] for t in outs.split())

        @query(name, KEY + outs, f"SELECT date, entity, {cols} FROM {c.source}{where}", c.prefix)
        def _(spark, sf):
            p = weekly_panel(spark, sf)
            return fn(spark, sf, with_market(p, names_bound(spark, sf)) if market else p)

        return fn

    return wrap


LONG = Chain(PANEL, "panel").add(lv="ln(1 + volume)")
LONG.add(**{f"{n}_{w}": e for w in (5, 10) for n, e in (
    ("ret_1d_mean", mean("ret", w)), ("ret_1d_std", std("ret", w)), ("ret_1d_min", tmin("ret", w)), ("ret_1d_max", tmax("ret", w)),
    ("log_vol_mean", mean("lv", w)), ("log_vol_std", std("lv", w)), ("ret_resid", f"ret - ({mean('ret', w)})"))})


@feat("features_long", LONG, " ".join(f"{n}_{w}~" for w in (5, 10) for n in (
    "ret_1d_mean", "ret_1d_std", "ret_1d_min", "ret_1d_max", "log_vol_mean", "log_vol_std", "ret_resid")), market=False)
def _(spark, sf, p):
    return ft.features_long(p, (5, 10))


TERM = Chain(MPANEL, "mpanel").add(ret1=f"close / nullif({lag('close')}, 0) - 1", ret5=f"close / nullif({lag('close', 5)}, 0) - 1",
                                   ret20=f"close / nullif({lag('close', 20)}, 0) - 1", adv=mean("dollar_volume", 60, 20), hi=tmax("high", 20), lo=tmin("low", 20))
TERM.add(c_ma20_=f"close / nullif({mean('close', 20)}, 0)", c_ma60_=f"close / nullif({mean('close', 60)}, 0)", hl_="high / nullif(low, 0)",
         co_="(close - open) / nullif(open, 0)", gap_=f"(open - {lag('close')}) / nullif({lag('close')}, 0)", stoch_="(close - lo) / nullif(hi - lo, 0)",
         ret1_="ret1", ret5_="ret5", ret20_="ret20", v_ma20_=f"volume / nullif({mean('volume', 20)}, 0)", dv_adv_="dollar_volume / nullif(adv, 0)",
         vol20_=std("ret1", 20), amihud_="abs(ret1) / nullif(dollar_volume, 0) * 1e9", hi52_=f"close / nullif({tmax('close', 100, 50)}, 0)",
         idio_="CASE WHEN industry IS NOT NULL THEN ret1 - avg(ret1) OVER (PARTITION BY date, industry) ELSE ret1 END")
TERM.corr("beta60_", "ret1", "mkt", 60).pct("size_", "adv")
for _t in ft.TERMINALS:
    TERM.winsor(f"w_{_t}", f"{_t}_", 0.01)


@query("terminals", KEY + " ".join(f"{t}~6" for t in ft.TERMINALS),
       f"SELECT date, entity, {', '.join(f'w_{t} AS {t}' for t in ft.TERMINALS)} FROM {TERM.source}", TERM.prefix)
def _(spark, sf):
    reads = ["date", "entity", "industry", "open", "high", "low", "close", "volume", "dollar_volume"]
    return ft.terminals(xs(spark, sf), market_panel(spark, sf, columns=reads), year=100)


SNAP_COLS = ("ret_1d", "ret_5d", "ret_20d", "ret_60d", "mom_120d", "vol_5d", "vol_20d", "vol_60d", "downside_vol_20d", "drawdown_60d",
             "dollar_vol_20d", "volume_z_20d", "rel_ret_1d", "rel_ret_20d", "rel_vol_20d")
SNAP = Chain(MPANEL + """,
mf AS (SELECT date, mkt AS m1, CASE WHEN count(mkt) OVER w = 20 THEN sum(mkt) OVER w END AS m20, CASE WHEN count(mkt) OVER w = 20 THEN stddev_samp(mkt) OVER w END AS mv
  FROM market WINDOW w AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
sn AS (SELECT p.*, m1, m20, mv, row_number() OVER (PARTITION BY entity ORDER BY p.date) AS rn, CASE WHEN week(p.date) < 20 THEN 1.0 ELSE 2.0 END AS sf,
  sum(coalesce(ret, 0)) OVER (PARTITION BY entity ORDER BY p.date) AS cum FROM panel p LEFT JOIN mf ON mf.date = p.date),
dd AS (SELECT t.date, t.entity, CASE WHEN count(s.ret) = 59 THEN exp(least(min(t.cum - s.cum), min(CASE WHEN s.rn = t.rn - 58 THEN t.cum - s.cum + s.ret END))) - 1 END AS drawdown_60d
  FROM sn t JOIN sn s ON s.entity = t.entity AND s.rn BETWEEN t.rn - 58 AND t.rn GROUP BY 1, 2)""", "(SELECT sn.*, dd.drawdown_60d FROM sn JOIN dd ON dd.date = sn.date AND dd.entity = sn.entity)")
SNAP.add(ret_1d="ret", ret_5d=tsum("ret", 5, 5), ret_20d=tsum("ret", 20, 20), ret_60d=tsum("ret", 60, 60), mom_120d=tsum("ret", 120, 120),
         vol_5d=std("ret", 5, 5), vol_20d=std("ret", 20, 20), vol_60d=std("ret", 60, 60), dn="CASE WHEN ret IS NOT NULL THEN least(ret, 0) END", va="volume * sf",
         dollar_vol_20d=f"ln({mean('dollar_volume', 20, 20)})")
SNAP.add(downside_vol_20d=std("dn", 20, 20), volume_z_20d=f"(va - ({mean('va', 20, 20)})) / nullif({std('va', 20, 20)}, 0)", rel_ret_1d="ret - m1",
         rel_ret_20d="ret_20d - m20", rel_vol_20d="vol_20d / nullif(mv, 0)")


@query("snapshot_and_sequence", KEY + " ".join(f"{c}~" for c in SNAP_COLS), f"SELECT date, entity, {', '.join(SNAP_COLS)} FROM {SNAP.source}", SNAP.prefix)
def _(spark, sf):
    p = weekly_panel(spark, sf).withColumn("share_factor", F.when(F.weekofyear("date") < 20, 1.0).otherwise(2.0))
    m = ft.market_frame(market_series(p), 5)
    return ft.snapshot_and_sequence(p.select("date", "entity", "ret", "volume", "dollar_volume", "share_factor"), m)


MOM = Chain(MPANEL, "mpanel").add(
    ret_5d=tsum("sig", 5, 4), ret_20d=tsum("sig", 20, 16),
    mom_12_1="CASE WHEN count(sig) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN 51 PRECEDING AND 5 PRECEDING) >= 38 "
             "THEN sum(sig) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN 51 PRECEDING AND 5 PRECEDING) END",
    lp="CASE WHEN sig IS NOT NULL THEN sum(coalesce(sig, 0)) OVER (PARTITION BY entity ORDER BY date) END").add(
    high_ratio=f"exp(lp - ({tmax('lp', 52, 42)}))")


@feat("momentum_and_high", MOM, "ret_5d~ ret_20d~ mom_12_1~ high_ratio~")
def _(spark, sf, p):
    p = p.withColumn("index", ts.price_index(F.expm1("sig")))
    m = ft.momentum("sig", (5, 20), 51, 5)
    return p.select("date", "entity", *[c.alias(k) for k, c in m.items()], ft.high_ratio("index", 52).alias("high_ratio"))


BAB = Chain(MPANEL, "mpanel").add(rvol=std("sig", 21, 17), r3=tsum("sig", 3, 3), m3=tsum("mkt", 3, 3)).corr("cc", "r3", "m3", 120, 60).add(
    beta_bab=f"cc * ({std('sig', 52, 42)}) / nullif({std('mkt', 52, 42)}, 0)")


@feat("rvol_and_beta_bab", BAB, "rvol~ beta_bab~")
def _(spark, sf, p):
    p = p.select("date", "entity", "sig", "mkt").withColumn("rvol", ts.std("sig", 21, ft.need(21)))
    return ft.beta_bab(p, "beta_bab", "sig", "mkt", 3, 120, 60, 52)


AMI = Chain(MPANEL, "mpanel").add(il="CASE WHEN volume > 0 AND dollar_volume > 0 THEN abs(exp(sig) - 1) / (dollar_volume / 1e6) END").add(
    ami=f"ln({mean('il', 26, 21)})", log_me="CASE WHEN dollar_volume > 0 THEN ln(dollar_volume) END")


@feat("log_equity_and_amihud", AMI, "log_me~ ami~")
def _(spark, sf, p):
    p = p.withColumns({"rs": F.expm1("sig"), "dm": F.col("dollar_volume") / 1e6, "log_me": F.when(F.col("dollar_volume") > 0, F.log("dollar_volume"))})
    return ft.amihud(p, "ami", "rs", "dm", 26).withColumn("ami", F.log("ami"))


SEAS = """mon AS (SELECT entity, CAST(date_trunc('month', date) AS DATE) AS month, CASE WHEN count(sig) >= ceil(0.8 * count(*) - 1e-9) THEN exp(sum(ln(1 + (exp(sig / 10) - 1)))) - 1 END AS r FROM panel GROUP BY 1, 2),
tgt AS (SELECT date, entity, CAST(date_trunc('month', date + 1) AS DATE) AS m FROM panel)"""


@query("seasonality_2_5", KEY + "seas~6", """
SELECT t.date, t.entity, CASE WHEN count(r) = 4 THEN avg(r) END AS seas FROM tgt t LEFT JOIN mon ON mon.entity = t.entity
  AND mon.month IN (CAST(m - INTERVAL 24 MONTH AS DATE), CAST(m - INTERVAL 36 MONTH AS DATE), CAST(m - INTERVAL 48 MONTH AS DATE), CAST(m - INTERVAL 60 MONTH AS DATE))
GROUP BY 1, 2""", more(PANEL, SEAS))
def _(spark, sf):
    p = weekly_panel(spark, sf).withColumn("sr", F.expm1(F.col("sig") / 10))
    return ft.seasonality(p, ql.monthly_compounded(p, "sr"), "seas")


@query("coskewness", KEY + "coskew~6", """
SELECT t.date, t.entity, CASE WHEN count(*) FILTER (WHERE s.x IS NOT NULL) >= 17 THEN avg((s.x - t.mx) * pow(s.y - t.my, 2)) / nullif(any_value(t.sx) * any_value(t.vy), 0) END AS coskew
FROM stats t JOIN stats s ON s.entity = t.entity AND s.rn BETWEEN t.rn - 20 AND t.rn GROUP BY 1, 2""",
       more(MPANEL, f"""prs AS (SELECT date, entity, CASE WHEN mkt IS NOT NULL THEN sig END AS x, CASE WHEN sig IS NOT NULL THEN mkt END AS y,
  row_number() OVER (PARTITION BY entity ORDER BY date) AS rn FROM mpanel),
stats AS (SELECT *, avg(x) OVER {rows(21)} AS mx, avg(y) OVER {rows(21)} AS my, stddev_pop(x) OVER {rows(21)} AS sx, var_pop(y) OVER {rows(21)} AS vy FROM prs)"""))
def _(spark, sf):
    return ft.coskew(market_panel(spark, sf), "coskew", "sig", "mkt", 21)


IVOL = Chain(MPANEL, "mpanel").add(x="CASE WHEN mkt IS NOT NULL THEN sig END", y="CASE WHEN sig IS NOT NULL THEN mkt END").add(
    ivol=f"CASE WHEN count(x) OVER {rows(21)} >= 17 THEN sqrt(greatest(regr_syy(x, y) OVER {rows(21)} - pow(regr_sxy(x, y) OVER {rows(21)}, 2) / nullif(regr_sxx(x, y) OVER {rows(21)}, 0), 0) "
         f"/ (count(x) OVER {rows(21)} - 1)) END")


@feat("ivol_capm", IVOL, "ivol~")
def _(spark, sf, p):
    return p.select("date", "entity", ft.ivol_capm("sig", "mkt", 21).alias("ivol"))


SHORT = Chain(MPANEL, "mpanel").add(s_="exp(sig) - 1", sp="CASE WHEN low > 0 AND low <= high THEN (high - low) / ((high + low) / 2) END", on_="sig - ln(close / open)",
                                    rq=tsum("sig", 5, 5), lp="CASE WHEN sig IS NOT NULL THEN sum(coalesce(sig, 0)) OVER (PARTITION BY entity ORDER BY date) END",
                                    lv="CASE WHEN volume > 0 THEN ln(volume) END")
SHORT.add(p_="exp(lp)").corr("ret_vol_corr", "sig", "lv", 60, 48).add(
    vol_shock=f"({std('sig', 5, 4)}) / nullif({std('sig', 60, 48)}, 0)", rskew=skew("sig", 21, 17), rmax1=f"ln({tmax('s_', 21, 17)})", qspread=mean("sp", 21, 17),
    overnight=tsum("on_", 20, 16), ma_gap=f"ln(p_ / nullif({mean('p_', 50, 40)}, 0))", var_ratio=f"({var('rq', 60, 48)}) / nullif(5 * ({var('sig', 60, 48)}), 0)")


@feat("short_horizon_block", SHORT, "vol_shock~6 rskew~ rmax1~ qspread~ overnight~ ma_gap~6 var_ratio~ ret_vol_corr~")
def _(spark, sf, p):
    d = ft.short_block(p.withColumns({"bid": F.col("low"), "ask": F.col("high")}), "sig")
    return d.withColumns({"rmax1": F.log("rmax1"), "ma_gap": F.log(F.col("ma_gap") + 1)})


EARN = """wk AS (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT date FROM bars_w)),
rep AS (SELECT gvkey AS entity, rdq_date AS d, (SELECT min(date) FROM wk WHERE date >= rdq_date) AS known, (SELECT min(pos) FROM wk WHERE date > rdq_date) AS ev FROM quarters WHERE rdq_date IS NOT NULL)"""


@query("earnings_timing", KEY + "days_since_earn# earn_next5~", """
SELECT b.date, b.entity, any_value(wk.pos) - max(CASE WHEN r.ev <= wk.pos THEN r.ev END) AS days_since_earn,
  CASE WHEN min(r.known) <= b.date THEN CASE WHEN min(CASE WHEN r.known <= b.date AND r.d + 364 > b.date THEN r.d + 364 END) <= b.date + 7 THEN 1.0 ELSE 0.0 END END AS earn_next5
FROM bars_w b JOIN wk ON wk.date = b.date LEFT JOIN rep r ON r.entity = b.entity GROUP BY b.date, b.entity""", more(with_(WEEK_BARS, DAY_BARS, FACTS, QUARTERS), EARN))
def _(spark, sf):
    w = weekly_bars(spark, sf).select("date", "entity")
    reports = quarters(spark, sf).where("rdq_date is not null").select(F.col("gvkey").alias("entity"), "rdq_date")
    return ft.earnings_timing(w, calendar(w), reports)


@query("valuation_ratios", KEY + "be_me~6 ni_me~6 netdebt_me~6", """
SELECT b.date, b.entity, CASE WHEN be > 0 AND me > 0 THEN be / me END AS be_me, CASE WHEN me > 0 THEN ni_ttm / me END AS ni_me, CASE WHEN me > 0 THEN netdebt / me END AS netdebt_me
FROM (SELECT w.date, w.entity, w.dollar_volume AS me, CASE WHEN w.date - v.asof_avail <= 365 THEN v.be END AS be, CASE WHEN w.date - v.asof_avail <= 365 THEN v.ni_ttm END AS ni_ttm,
  CASE WHEN w.date - v.asof_avail <= 365 THEN v.netdebt END AS netdebt FROM bars_w w ASOF LEFT JOIN vals v ON v.gvkey = w.entity AND w.date >= v.event) b""",
       more(with_(WEEK_BARS, DAY_BARS, FACTS, QUARTERS), PIT_VALUES))
def _(spark, sf):
    return ft.valuation_ratios(with_fundamentals(spark, sf), "dollar_volume")


def with_fundamentals(spark, sf, cols=("be", "ni_ttm", "netdebt")):
    w = weekly_bars(spark, sf).select("date", "entity", "dollar_volume")
    ev = fundamentals(spark, sf).withColumnRenamed("gvkey", "entity")
    return pit.carry_forward(w, ev, "entity", list(cols), 365)


XSEC = Chain(MPANEL, "mpanel").add(mom_12_1=tsum("sig", 20, 10), ret_20d=tsum("sig", 5, 4), rvol=std("sig", 10, 8), log_me="ln(dollar_volume)", me="dollar_volume",
                                   be_me="sig / nullif(volume, 0)")
XSEC.add(im="CASE WHEN sector IS NOT NULL THEN sum(mom_12_1 * me) OVER (PARTITION BY date, sector) / nullif(sum(CASE WHEN mom_12_1 IS NOT NULL THEN me END) OVER (PARTITION BY date, sector), 0) END",
         ir="CASE WHEN sector IS NOT NULL THEN ret_20d - sum(ret_20d * me) OVER (PARTITION BY date, sector) / nullif(sum(CASE WHEN ret_20d IS NOT NULL THEN me END) OVER (PARTITION BY date, sector), 0) END",
         nb="count(be_me) OVER (PARTITION BY date, sector)")
XSEC.unit("u_mom", "mom_12_1").unit("u_ret", "ret_20d").unit("u_vol", "rvol").unit("u_me", "log_me").unit("u_be", "be_me").unit("u_im", "im").unit("u_ir", "ir").unit("s_be", "be_me", "date, sector")
XSEC.add(be_s="CASE WHEN sector IS NOT NULL AND nb >= 5 THEN s_be ELSE u_be END", fp="CASE WHEN u_mom IS NULL OR u_ret IS NULL OR u_vol IS NULL OR u_me IS NULL THEN 1.0 ELSE 0.0 END",
         ff="CASE WHEN u_be IS NULL THEN 1.0 ELSE 0.0 END")
XCOLS = (("mom_12_1", "u_mom"), ("ret_20d", "u_ret"), ("rvol", "u_vol"), ("log_me", "u_me"), ("be_me", "u_be"), ("ind_mom_12_1", "u_im"), ("ret_20d_ind_rel", "u_ir"), ("be_me_sector", "be_s"))


@query("cross_section_inputs", KEY + " ".join(f"{a}~" for a, _ in XCOLS) + " " + " ".join(f"sector_{k}~" for k in range(5)) + " flag_price_missing~ flag_fund_missing~",
       f"SELECT date, entity, {', '.join(f'coalesce({b}, 0) AS {a}' for a, b in XCOLS)}, "
       + ", ".join(f"CASE WHEN sector = {k} THEN 1.0 ELSE 0.0 END AS sector_{k}" for k in range(5)) + f", fp AS flag_price_missing, ff AS flag_fund_missing FROM {XSEC.source}", XSEC.prefix)
def _(spark, sf):
    p = weekly_panel(spark, sf).withColumns({
        "mom_12_1": ts.sum_("sig", 20), "ret_20d": ts.sum_("sig", 5, 4), "rvol": ts.std("sig", 10, 8), "log_me": F.log("dollar_volume"),
        "me": F.col("dollar_volume"), "be_me": F.col("sig") / F.col("volume")})
    return ft.cross_section_inputs(xs(spark, sf), p, ["mom_12_1", "ret_20d", "rvol", "log_me", "be_me"], [], ["mom_12_1", "ret_20d", "rvol", "log_me"], ["be_me"],
                                   ["be_me"], "sector", "me", range(5), 5)


# the busy shipping days moved sixteen years ahead play the trading calendar
TDAYS = BUSY + """,
tdays AS (SELECT date, row_number() OVER (ORDER BY date) AS p FROM (SELECT DISTINCT CAST(date + INTERVAL 192 MONTH AS DATE) AS date FROM busy) WHERE isodow(date) <= 5),
mon AS (SELECT DISTINCT date_trunc('month', date) AS m FROM tdays),
opex AS (SELECT CAST(m + to_days(CAST((5 - isodow(m) + 7) % 7 + 14 AS INT)) AS DATE) AS date, month(m) AS mm FROM mon),
hol AS (SELECT CAST(d AS DATE) AS date FROM (SELECT unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM tdays) WHERE isodow(d) <= 5 AND CAST(d AS DATE) NOT IN (SELECT date FROM tdays)),
fomc AS (SELECT CAST(unnest([""" + ", ".join(f"'{d}'" for d in tc.FOMC) + "]) AS DATE) AS date)"


def _su(src, cond="true"):
    return (f"p - (SELECT max(b.p) FROM tdays b JOIN {src} o ON o.date = b.date WHERE b.p <= t.p AND {cond})",
            f"(SELECT min(b.p) FROM tdays b JOIN {src} o ON o.date = b.date WHERE b.p >= t.p AND {cond}) - p")


_m, _q, _f = _su("opex"), _su("opex", "mm % 3 = 0"), _su("fomc")
CAL_COLS = {
    "day_of_the_week": "isodow(date)", "month_of_the_year": "month(date)", "quarter_of_year": "quarter(date)",
    **{f"days_since_first_trading_day_of_{n}": f"row_number() OVER (PARTITION BY {k} ORDER BY date) - 1" for n, k in (
        ("month", "year(date), month(date)"), ("quarter", "year(date), quarter(date)"), ("year", "year(date)"))},
    **{f"days_until_last_trading_day_of_{n}": f"count(*) OVER (PARTITION BY {k}) - row_number() OVER (PARTITION BY {k} ORDER BY date)" for n, k in (
        ("month", "year(date), month(date)"), ("quarter", "year(date), quarter(date)"), ("year", "year(date)"))},
    "days_since_last_monthly_options_expiration": _m[0], "days_until_next_monthly_options_expiration": _m[1],
    "days_since_last_quarterly_options_expiration": _q[0], "days_until_next_quarterly_options_expiration": _q[1],
    "days_since_last_trading_holiday": "date - (SELECT max(h.date) FROM hol h WHERE h.date < t.date)",
    "days_until_next_trading_holiday": "(SELECT min(h.date) FROM hol h WHERE h.date > t.date) - date",
    "days_since_last_fomc_meeting": _f[0], "days_until_next_fomc_meeting": _f[1]}
CALSQL = "calf AS (SELECT date, " + ", ".join(f"{e} AS {c}" for c, e in CAL_COLS.items()) + " FROM tdays t)"
W_CAL = "WITH " + TDAYS + ",\n" + CALSQL


def trading_days(spark, sf):
    days = busy_days(spark, sf).select(F.add_months("date", 192).alias("date")).distinct()
    return days.where(F.weekday("date") < 5)


@query("calendar_features", "date " + " ".join(f"{c}#" for c in CAL_COLS), "SELECT * FROM calf", W_CAL)
def _(spark, sf):
    return tc.calendar_features(trading_days(spark, sf))


# another bank's meetings on the calendar's own dates: the busy Wednesdays with an order of an eleventh customer
OWN = W_CAL.replace("INTERVAL 192 MONTH", "INTERVAL 0 MONTH").replace("fomc AS (SELECT CAST(unnest([" + ", ".join(f"'{d}'" for d in tc.FOMC) + "]) AS DATE) AS date)",
    "fomc AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_custkey % 11 = 0 AND isodow(o_orderdate) = 3)")


def own_calendar(spark, sf):
    days = busy_days(spark, sf).select("date").distinct().where(F.weekday("date") < 5)
    met = table(spark, sf, "orders").where("o_custkey % 11 = 0").select(F.to_date("o_orderdate").alias("date")).where(F.weekday("date") == 2)
    return tc.calendar_features(days, met)


@query("calendar_features_own_meetings", "date " + " ".join(f"{c}#" for c in CAL_COLS), "SELECT * FROM calf", OWN)
def _(spark, sf):
    return own_calendar(spark, sf)


STRESS_SQL = " + ".join(f"CASE WHEN {c} {'<=' if op == 'le' else '>='} {k} THEN 1 ELSE 0 END" for c, op, k in tc.STRESS_GATES)


@query("event_stress_weight", "date stress# weight~ training_weight~", f"""
SELECT date, stress, CASE WHEN stress > 0 THEN 1.0 + stress ELSE 0 END AS weight, 1 + 3.0 * CAST(stress > 0 AS INT) AS training_weight FROM (SELECT date, {STRESS_SQL} AS stress FROM calf)""", W_CAL)
def _(spark, sf):
    d = tc.calendar_features(trading_days(spark, sf)).withColumn("stress", tc.event_stress())
    return d.withColumns({"weight": tc.event_weight("stress"), "training_weight": tc.training_weight("stress")})


@query("event_stress_own_meetings", "date stress# weight~ training_weight~", f"""
SELECT date, stress, CASE WHEN stress > 0 THEN 1.0 + stress ELSE 0 END AS weight, 1 + 3.0 * CAST(stress > 0 AS INT) AS training_weight FROM (SELECT date, {STRESS_SQL} AS stress FROM calf)""", OWN)
def _(spark, sf):
    d = own_calendar(spark, sf).withColumn("stress", tc.event_stress())
    return d.withColumns({"weight": tc.event_weight("stress"), "training_weight": tc.training_weight("stress")})


def _o(agg, x, w):
    f = f"(ORDER BY date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {f} >= {max(2, w // 2)} THEN {agg}({x}) OVER {f} END"


MACRO = f"""mc AS (SELECT date, stddev_samp(ret) AS vix, avg(ret) AS spx FROM panel WHERE ret IS NOT NULL GROUP BY 1),
mc1 AS (SELECT *, {_o('stddev_samp', 'spx', 10)} AS mv, vix / lag(vix) OVER (ORDER BY date) - 1 AS ri FROM mc),
mc2 AS (SELECT *, coalesce(CAST(vix > ({_o('avg', 'vix', 30)}) AS INT), 0) AS r1, coalesce(CAST((vix - ({_o('avg', 'vix', 10)})) / nullif({_o('stddev_samp', 'vix', 10)}, 0) > 1 AS INT), 0) AS r2,
  coalesce(CAST(mv > ({_o('avg', 'mv', 40)}) AS INT), 0) AS r3, coalesce(CAST(({_o('sum', 'spx', 10)}) < 0 AS INT), 0) AS r4, coalesce(CAST(({_o('sum', 'ri', 5)}) > 0 AS INT), 0) AS r5 FROM mc1)"""


@query("macro_regime_gate", "date r1# r2# r3# r4# r5# regime# weight~ calm~", """
SELECT *, CASE WHEN regime > 0 THEN 1.0 + regime ELSE 0 END AS weight, CAST(regime = 0 AS INT) AS calm FROM (SELECT *, r1 + r2 + r3 + r4 + r5 AS regime FROM mc2)""", more(PANEL, MACRO))
def _(spark, sf):
    p = weekly_panel(spark, sf).where("ret is not null")
    ctx = p.groupBy("date").agg(F.stddev_samp("ret").alias("vix"), F.avg("ret").alias("spx"))
    return tc.macro_gate(ctx, "vix", "spx", 10, 30, 40, 5)


@query("first_and_last_hour", "entity# date ret_first~6 ret_last~6 volume_share~ trade_size_last~6", """
WITH h AS (SELECT user_id AS entity, CAST(ts AS DATE) AS date, hour(ts) AS hour, arg_min(value, (ts, event_id)) AS o, arg_max(value, (ts, event_id)) AS c, sum(value) AS v, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2, 3)
SELECT entity, date, arg_min(c / o - 1, hour) AS ret_first, arg_max(c / o - 1, hour) AS ret_last, arg_max(v, hour) / (arg_min(v, hour) + arg_max(v, hour)) AS volume_share, arg_max(v / n, hour) AS trade_size_last
FROM h GROUP BY 1, 2""")
def _(spark, sf):
    h = user_hours(spark, sf).withColumns({"r": F.col("close") / F.nullif(F.col("open"), F.lit(0.0)) - 1, "size": F.col("volume") / F.col("trades")})
    return h.groupBy("entity", "date").agg(
        F.min_by("r", "hour").alias("ret_first"), F.max_by("r", "hour").alias("ret_last"),
        (F.max_by("volume", "hour") / F.nullif(F.min_by("volume", "hour") + F.max_by("volume", "hour"), F.lit(0.0))).alias("volume_share"),
        F.max_by("size", "hour").alias("trade_size_last"))


RESID = Chain(MPANEL + """,
mfw AS (SELECT date, CASE WHEN count(mkt) OVER w = 3 THEN sum(mkt) OVER w END AS mf FROM market WINDOW w AS (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))""",
              "(SELECT p.*, mf FROM mpanel p LEFT JOIN mfw ON mfw.date = p.date)").add(
    fs="CASE WHEN count(ret) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) = 3 THEN sum(ret) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) END",
    x="CASE WHEN mkt IS NOT NULL THEN ret END", y="CASE WHEN ret IS NOT NULL THEN mkt END").add(
    fwd_resid=f"fs - CASE WHEN count(x) OVER {rows(30)} >= 30 THEN regr_slope(x, y) OVER {rows(30)} END * mf")


@feat("residual_target", RESID, "fwd_resid~")
def _(spark, sf, p):
    m = ft.market_frame(market_series(p), 3).select("date", F.col("fwd").alias("mf"))
    return ft.residual_target(p.join(F.broadcast(m), "date", "left"), "mf", "ret", "mkt", 30, 3)


@query("market_cap_from_shares", KEY + "log_cap~", """
SELECT date, entity, ln(close * coalesce(last_value(sh IGNORE NULLS) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(sh IGNORE NULLS) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))) AS log_cap
FROM (SELECT *, CASE WHEN n_trades >= 4 THEN volume END AS sh FROM bars_w)""", with_(WEEK_BARS))
def _(spark, sf):
    w = weekly_bars(spark, sf).withColumn("sh", F.when(F.col("n_trades") >= 4, F.col("volume")))
    return ft.market_cap(w, "sh", "close").withColumn("log_cap", F.log("mktcap"))


TRAIN = Chain(PANEL, "panel").add(u="n_trades >= 2", nr="lead(ret) OVER (PARTITION BY entity ORDER BY date)", vol=std("sig", 10), mom=tsum("sig", 10), stress="CAST(month(date) % 3 = 0 AS INT)").add(
    y_="CASE WHEN u THEN nr END", v_="CASE WHEN u THEN vol END", m_="CASE WHEN u THEN mom END").add(
    yn="CASE WHEN industry IS NOT NULL THEN y_ - avg(y_) OVER (PARTITION BY date, industry) END").pct("py", "yn").pct("pv", "v_").pct("pm", "m_")


@query("training_table", KEY + "vol~ mom~ y~ weight~", f"""
SELECT date, entity, pv - 0.5 AS vol, pm - 0.5 AS mom, py - 0.5 AS y, 1 + 3.0 * stress AS weight FROM (SELECT date, entity, pv, pm, py, stress FROM {TRAIN.source})
WHERE pv IS NOT NULL AND pm IS NOT NULL AND py IS NOT NULL""", TRAIN.prefix)
def _(spark, sf):
    p = weekly_panel(spark, sf).withColumns({
        "nr": F.lead("ret").over(ts._w(None)), "vol": ts.std("sig", 10), "mom": ts.sum_("sig", 10), "stress": (F.month("date") % 3 == 0).cast("int")})
    return ft.training_table(xs(spark, sf), p, ["vol", "mom"], F.col("n_trades") >= 2, "industry", "nr", "stress")


PREP = Chain(PANEL, "panel").add(f1=mean("ret", 5), f2=std("ret", 10), y_ret="ln(lead(close, 3) OVER (PARTITION BY entity ORDER BY date)) - ln(close)")


@query("score_table", KEY + "y_pred~ y_ret~", f"SELECT date, entity, 0.1 + 0.5 * f1 - 0.2 * f2 AS y_pred, y_ret FROM {PREP.source}", PREP.prefix)
def _(spark, sf):
    p = weekly_panel(spark, sf).withColumns({
        "f1": ts.mean("ret", 5), "f2": ts.std("ret", 10), "y_ret": ts.forward_log_return("close", 3)})
    pred = ft.dot_prediction(p, {"intercept": 0.1, "f1": 0.5, "f2": -0.2}).where("y_pred is not null")
    return ft.score_table(p, pred, "y_ret")


@query("feature_label_preparation", KEY + "y_bucket#", f"""
SELECT date, entity, k AS y_bucket FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY md5(CAST(date AS VARCHAR) || '|' || entity)) AS rn,
   count(*) FILTER (WHERE k <> 0) OVER () AS nz, count(*) FILTER (WHERE k > 0) OVER (PARTITION BY abs(k)) AS np, count(*) FILTER (WHERE k < 0) OVER (PARTITION BY abs(k)) AS nn FROM (
  SELECT date, entity, CAST(sign(y_ret) AS INT) * (CAST(abs(y_ret / 10) >= 0.05 AS INT) + CAST(abs(y_ret / 10) >= 0.1 AS INT)) AS k FROM {PREP.source}
  WHERE abs(y_ret / 10) < 0.2 AND f1 IS NOT NULL AND f2 IS NOT NULL AND date <= DATE '1999-12-27' - 7))
WHERE CASE WHEN k = 0 THEN rn <= floor(nz * 0.5) ELSE rn <= least(np, nn) END""", PREP.prefix)
def _(spark, sf):
    p = weekly_panel(spark, sf).withColumns({
        "f1": ts.mean("ret", 5), "f2": ts.std("ret", 10), "y": ts.forward_log_return("close", 3) / 10})
    p = p.select("date", "entity", "f1", "f2", "y")  # rows are stored before they are put in order, so columns that nothing reads go first
    train = purge_overlap(p.where("date <= '1999-12-27'"), 5).dropna(subset=["f1", "f2", "y"])
    return balanced_sample(train, "y", (0.05, 0.1), 0.5, bound=None)
