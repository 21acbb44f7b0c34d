"""Named alpha expressions over the weekly panel with hourly, calendar and report fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.elementwise import signlog
from ..operators import alphas as al
from ..operators import rolling as ts
from ..operators import tradingcal as tc
from ..operators.crosssection import CrossSection
from ..sources.tables import market_panel, names_bound
from .chain import Chain, lag, mean, med, skew, std, tmax, tmin, tsum, zs
from .oracle import MPANEL, more
from .registry import query

KEY = "date entity# "
GATES = (("days_until_last_trading_day_of_quarter", "le", 2), ("days_until_last_trading_day_of_month", "le", 1),
         ("days_since_first_trading_day_of_month", "le", 0))
CYCLE = GATES + (("days_until_next_earnings", "le", 15), ("days_until_next_earnings", "ge", 55))

FIELDS = """hours AS (SELECT l_suppkey AS entity, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, l_extendedprice / l_quantity AS price, * FROM lineitem),
hf AS (SELECT entity, date, sum(l_extendedprice) FILTER (WHERE l_linenumber >= 4) / sum(l_quantity) FILTER (WHERE l_linenumber >= 4) AS vwap_last,
  sum(l_quantity) FILTER (WHERE l_linenumber <= 4) AS vol_first, sum(l_quantity) FILTER (WHERE l_linenumber >= 4) AS vol_last,
  count(*) FILTER (WHERE l_linenumber <= 4) AS trades_first, count(*) FILTER (WHERE l_linenumber >= 4) AS trades_last,
  first(price ORDER BY l_shipdate, l_orderkey, l_linenumber, price) FILTER (WHERE l_linenumber <= 4) AS of_,
  last(price ORDER BY l_shipdate, l_orderkey, l_linenumber, price) FILTER (WHERE l_linenumber <= 4) AS close_first,
  first(price ORDER BY l_shipdate, l_orderkey, l_linenumber, price) FILTER (WHERE l_linenumber >= 4) AS open_last,
  last(price ORDER BY l_shipdate, l_orderkey, l_linenumber, price) FILTER (WHERE l_linenumber >= 4) AS cl_,
  max(price) FILTER (WHERE l_linenumber >= 4) + min(price) FILTER (WHERE l_linenumber >= 4) - 2 * avg(price) FILTER (WHERE l_linenumber >= 4) AS sk_
  FROM hours GROUP BY 1, 2),
wcal AS (SELECT date, count(*) OVER (PARTITION BY year(date), month(date)) - row_number() OVER (PARTITION BY year(date), month(date) ORDER BY date) AS dum,
  row_number() OVER (PARTITION BY year(date), month(date) ORDER BY date) - 1 AS dsm,
  count(*) OVER (PARTITION BY year(date), quarter(date)) - row_number() OVER (PARTITION BY year(date), quarter(date) ORDER BY date) AS duq
  FROM (SELECT DISTINCT date FROM panel)),
af AS (SELECT p.*, h.* EXCLUDE (entity, date, of_, cl_, sk_), h.close_first / h.of_ - 1 AS ret_first, h.cl_ / h.open_last - 1 AS ret_last,
  round(h.sk_ / h.vwap_last, 9) AS skew_last, c.dum, c.dsm, c.duq, 62 - ((p.date - DATE '1995-01-02') // 7 + p.entity * 5) % 63 AS du,
  close / nullif(lag(close) OVER e, 0) - 1 AS ret1, close / nullif(lag(close, 5) OVER e, 0) - 1 AS ret5, close / nullif(lag(close, 20) OVER e, 0) - 1 AS ret20
  FROM mpanel p LEFT JOIN hf h ON h.entity = p.entity AND h.date = p.date JOIN wcal c ON c.date = p.date WINDOW e AS (PARTITION BY p.entity ORDER BY p.date)),
af2 AS (SELECT *, CAST(duq <= 2 AS INT) + CAST(dum <= 1 AS INT) + CAST(dsm <= 0 AS INT) AS stress,
  CAST(duq <= 2 AS INT) + CAST(dum <= 1 AS INT) + CAST(dsm <= 0 AS INT) + CAST(du <= 15 AS INT) + CAST(du >= 55 AS INT) AS stress5 FROM af)"""
BASE = more(MPANEL, FIELDS)
WT, WT5 = "CASE WHEN stress > 0 THEN 1.0 + stress ELSE 0 END", "CASE WHEN stress5 > 0 THEN 1.0 + stress5 ELSE 0 END"


def fields(spark, sf):
    """Panel with simulator fields: returns, hourly fields, report countdown and calendar columns."""
    p = market_panel(spark, sf, hours=True)
    cal = tc.calendar_features(p.select("date")).select(
        "date", "days_until_last_trading_day_of_quarter", "days_until_last_trading_day_of_month", "days_since_first_trading_day_of_month")
    p = p.join(F.broadcast(cal), "date")  # one row per date
    weeks = F.floor(F.datediff("date", F.lit("1995-01-02").cast("date")) / 7)
    return p.withColumns({
        "days_until_next_earnings": 62 - (weeks + F.col("entity") * 5) % 63,
        **{f"ret{n}": ts.simple_return("close", n) for n in (1, 5, 20)}})


def chain() -> Chain:
    return Chain(BASE, "af2")


#: What the operators with trailing windows of whole batches read: only these columns travel.
GATE_FIELDS = " ".join(g for g, _, _ in GATES)
BARS = "date entity open high low close volume ret1 ret5 ret20 days_until_next_earnings " + GATE_FIELDS
SKEWS = "date entity skew_last mkt ret1 ret5 " + GATE_FIELDS


def alpha_query(name, c: Chain, outs="log_alpha~", reads=None):
    def wrap(fn):
        cols = ", ".join(t.rstrip("#").split("~")[0] for t in outs.split())

        # products of ranks are exact short decimals; the signed log keeps them off rounding ties
        exact = cols == "log_alpha"
        src = c.add(log_alpha="sign(alpha) * ln(1 + abs(alpha))").source if exact else c.source

        @query(name, KEY + outs, f"SELECT date, entity, {cols} FROM {src}", c.prefix)
        def _(spark, sf):
            d = fields(spark, sf)
            out = fn(CrossSection(("date",), names_bound(spark, sf)), d if reads is None else d.select(*reads.split()))
            return out.withColumn("log_alpha", signlog("alpha")) if exact else out

        return fn

    return wrap


def stoch(w):
    return f"(close - {tmin('low', w)}) / nullif({tmax('high', w)} - {tmin('low', w)}, 0)"


def reversal(c: Chain, sw, z, m) -> Chain:
    c.add(st=stoch(sw), rv=f"volume / nullif({mean('volume', 20)}, 0)", vr=f"{std('ret1', 20)} / nullif(ret20, 0)")
    c.winsor("vw", "vr", 0.02).add(rz="(rv - avg(rv) OVER (PARTITION BY date)) / nullif(stddev_samp(rv) OVER (PARTITION BY date), 0)")
    c.add(rd=f"rv - {lag('rv', 3)}", vm=med("vw", 3)).add(inn="-st - vm")
    return c.add(core=f"-({zs('st', z)}) - ((({med('rz', m)}) - ({mean('ret20', 20)}) + ({skew('rd', 33)})) - ({mean('inn', 15)}))")


def lovol(c: Chain, w) -> Chain:
    return c.add(v_=std("ret1", w)).rank01("vl", "v_").add(lovol="CAST(vl <= 0.5 AS INT)")


@alpha_query("alpha_auction_displacement", chain().add(push="(close - vwap_last) / nullif(vwap_last, 0)").add(
    z=f"push / nullif({std('push', 20)}, 0)").add(alpha="nullif(-tanh(z) * CAST(du > 10 AS INT), 0)"))
def _(xs, d):
    return al.auction_displacement(xs, d)


@alpha_query("alpha_reversal_earnings_gated", reversal(chain(), 20, 10, 20).final("core", 0.01, "CAST(du BETWEEN 0 AND 12 AS INT)"), reads=BARS)
def _(xs, d):
    return al.reversal_earnings_gated(xs, d)


SMALL = al.RANK25 | {"w_size": 60, "w_skew": 40}


def rank25(c: Chain, p, rank) -> Chain:
    c.add(st=stoch(p["w_stoch"]), dv="close * volume", vs=std("ret1", p["w_volstd"]), co="(close - open) / nullif(open, 0)")
    c.add(ds=mean("dv", p["w_size"]))
    getattr(c, rank)("sz", "ds")
    getattr(c, rank)("vk", "vs")
    c.add(d1=mean("vk", p["w_vrmean"]), ss="st + sz", q1=mean("sz", p["w_s1"]), md=med("co", p["w_med"]))
    c.add(i1=mean("ss", p["w_in1"]), q2=mean("q1", p["w_s2"]), sk=skew("md", p["w_skew"]))
    c.add(i2=mean("i1", p["w_in2"]), q3=mean("q2", p["w_s3"])).add(cc="(-st / nullif(d1, 0)) / nullif(i2, 0)")
    c.add(a_=f"{zs('cc', p['w_zs'])} - sz", b_=f"st + ((sk + (sz + ret5)) + ({tmin('q3', p['w_min'])}))").add(h_=mean("a_", p["w_out"]))
    getattr(c, rank)("br", "b_")
    return c.add(core="h_ - br")


@alpha_query("alpha_rank25_event_gated", rank25(chain(), SMALL, "rank01").final("core", SMALL["winsor"], WT), "log_alpha~6", reads=BARS)
def _(xs, d):
    return al.rank25_gated(xs, d, SMALL, GATES)


BASE25 = al.RANK25_BASE | {"w_size": 40, "w_skew": 30}


@alpha_query("rank25_parameterised_core", rank25(chain(), BASE25, "pct").winsor("core_w", "core", BASE25["winsor"]).add(
    alpha="CASE WHEN du BETWEEN 0 AND 12 THEN core_w END"), "log_alpha~6", reads=BARS)
def _(xs, d):
    return al.rank25_window_gated(xs, d, BASE25)


def coupling(c: Chain) -> Chain:
    c.add(v_=std("ret1", 20)).add(x_=f"{mean('v_', 20)} - {zs('v_', 10)}").corr("k_", "x_", "ret20", 60)
    c.add(m_=tmax("k_", 10)).add(n_=mean("m_", 20))
    return c.add(core=f"({tmax('n_', 5)}) - close / nullif({mean('close', 20)}, 0)")


@alpha_query("alpha_vol_regime_coupling", coupling(chain()).final("core", 0.01, WT), reads=BARS)
def _(xs, d):
    return al.vol_regime_coupling(xs, d, GATES)


@alpha_query("alpha_closing_skew", chain().rank01("score", "skew_last").final("score", 0.01, WT))
def _(xs, d):
    return al.closing_skew(xs, d, GATES)


@alpha_query("alpha_reversal_low_vol", lovol(reversal(chain(), 10, 80, 10), 20).final("core", 0.01, f"({WT}) * lovol"), reads=BARS)
def _(xs, d):
    return al.reversal_low_vol(xs, d, GATES)


@alpha_query("alpha_earnings_cycle", lovol(chain().rank01("r_", "du").add(score="-r_"), 60).final("score", 0.01, f"({WT5}) * lovol"))
def _(xs, d):
    return al.earnings_cycle(xs, d, CYCLE)


def tsrank(c: Chain, x, w) -> Chain:
    a = f"list({x}) FILTER (WHERE {x} IS NOT NULL) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    c.add(vals=a)
    c.add(t_=f"CASE WHEN {x} IS NOT NULL AND len(vals) >= {w // 2} THEN len(list_filter(vals, lambda v: v < {x})) "
             f"+ (len(list_filter(vals, lambda v: v = {x})) + 1) / 2.0 END")
    return c


@alpha_query("alpha_ranked_closing_skew", lovol(tsrank(chain(), "skew_last", 60).rank01("score", "t_"), 60).final("score", 0.01, f"({WT5}) * lovol"))
def _(xs, d):
    return al.ranked_closing_skew(xs, d, CYCLE)


def residual(c: Chain) -> Chain:
    c.corr("be", "ret1", "mkt", 60).add(ms=tsum("mkt", 5), sd=std("ret1", 20))
    return c.add(res="-(ret5 - be * ms) / nullif(sd, 0)").rank01("b", "res")


def eff(c: Chain, out, sig, w=60) -> Chain:
    return c.add(**{f"{out}_l": lag(sig)}).corr(out, f"{out}_l", "ret1", w)


def blend(c: Chain) -> Chain:
    residual(c.rank01("a", "skew_last"))
    return eff(eff(c, "ea", "a"), "eb", "b")


@alpha_query("alpha_adaptive_blend_gated", blend(chain()).rank01("ra", "ea").rank01("rb", "eb").add(score="a * ra + b * rb").final("score", 0.01, WT), reads=SKEWS)
def _(xs, d):
    return al.adaptive(xs, d, "gated", gates=GATES)


@alpha_query("adaptive_blend", blend(chain()).rank01("ra", "ea").rank01("rb", "eb").add(score="a * ra + b * rb").final("score", 0.01), reads=SKEWS)
def _(xs, d):
    return al.adaptive(xs, d, "blend")


@alpha_query("adaptive_switch", blend(chain()).add(score="CASE WHEN coalesce(ea > eb, false) THEN a + b * 0 ELSE b + a * 0 END").final("score", 0.01), reads=SKEWS)
def _(xs, d):
    return al.adaptive(xs, d, "switch")


@alpha_query("adaptive_single", eff(chain().rank01("a", "skew_last"), "ea", "a").rank01("er", "ea").add(score="a * er").final("score", 0.01), reads=SKEWS)
def _(xs, d):
    return al.adaptive(xs, d, "single")


@alpha_query("signal_decay", eff(eff(chain().rank01("a", "skew_last"), "ef", "a", 20), "eg", "a", 120).add(dd="ef - eg").rank01("er", "dd").add(
    score="a * er").final("score", 0.01), reads=SKEWS)
def _(xs, d):
    return al.adaptive(xs, d, "decay")


@alpha_query("predictability_rank", eff(chain().add(rev=f"-ret1 / nullif({std('ret1', 20)}, 0)"), "er", "rev").rank01("score", "er").final("score", 0.01), reads=SKEWS)
def _(xs, d):
    return al.adaptive(xs, d, "pure")


EVC = chain().add(vs="volume * stress", as_="abs(ret1) * stress", vq="volume * CAST(stress < 1 AS INT)", aq="abs(ret1) * CAST(stress < 1 AS INT)", s_="stress * 1.0").add(
    flow_share=f"{tsum('vs', 100)} / nullif({tsum('volume', 100)}, 0)", depth_event=f"{tsum('vs', 100)} / nullif({tsum('as_', 100)}, 0)",
    depth_quiet=f"{tsum('vq', 100)} / nullif({tsum('aq', 100)}, 0)",
    flow_multiple=f"({tsum('vs', 100)}) / nullif({tsum('s_', 100)}, 0) / nullif({mean('volume', 100)}, 0)",
    flow_trend=f"({tsum('vs', 30)}) / nullif({tsum('volume', 30)}, 0) - ({tsum('vs', 100)}) / nullif({tsum('volume', 100)}, 0)").add(
    resilience="depth_event / nullif(depth_quiet, 0)")


@alpha_query("event_conditional_aggregates", EVC, "flow_share~ flow_multiple~ depth_event~6 depth_quiet~6 flow_trend~ resilience~6")
def _(xs, d):
    return al.event_conditional(al.with_stress(d, GATES), "stress", 100, 30)


CHAR = chain().add(l_=lag("ret1"), up="ret1 * (ret1 / nullif(abs(ret1), 0) + 1) * 0.5", dn="ret1 * (1 - ret1 / nullif(abs(ret1), 0)) * 0.5",
                   j_=f"du - {lag('du')}").add(ann="(j_ / nullif(abs(j_), 0) + 1) * 0.5").add(ra="ret1 * ann")
CHAR.corr("autocorr", "ret1", "l_", 40).corr("ret_volume", "ret1", "volume", 40).add(
    var_ratio=f"{std('ret5', 40)} / nullif({std('ret1', 40)} * sqrt(5), 0)", vol_term=f"{std('ret1', 5)} / nullif({std('ret1', 40)}, 0)",
    semivol=f"{std('up', 40)} / nullif({std('dn', 40)}, 0)", announcement=f"{tsum('ra', 160)} / nullif({tsum('ann', 160)}, 0)")


@alpha_query("stock_characteristics", CHAR, "autocorr~ var_ratio~ vol_term~6 ret_volume~ semivol~6 announcement~", reads="date entity ret1 ret5 volume days_until_next_earnings")
def _(xs, d):
    return al.characteristics(d, 40)


REL = chain().corr("beta", "ret1", "mkt", 100).corr("bf", "ret1", "mkt", 30).add(sgn="ret1 / nullif(abs(ret1), 0)", ls=lag("ret20", 100)).add(
    beta_instability=std("bf", 30), beta_term="bf - beta", idio_share="1 - bf * bf", momentum=f"({lag('close', 8)}) / nullif({lag('close', 100)}, 0)",
    high_proximity=f"close / nullif({tmax('high', 100)}, 0)", consistency=mean("sgn", 100), seasonal=mean("ls", 5))


@alpha_query("relational_features", REL, "beta~ beta_instability~ beta_term~ idio_share~ momentum~ high_proximity~ consistency~ seasonal~", reads="date entity close high mkt ret1 ret20")
def _(xs, d):
    return al.relational(d, fast=30, slow=100, skip=8)


GEO = chain().add(ph=lag("high"), pl=lag("low"), pc=lag("close"), tp="(high + low + close) / 3").add(
    c_="((ph - high) + (low - pl)) / nullif(ph - pl, 0)", t_="(close - tp) / nullif(tp, 0)", g_="abs(open - pc) / nullif(pc, 0)",
    a_="abs(open - pc)", b_="abs(open - pc) + abs(close - open)").add(
    containment=mean("c_", 20), typical_gap=mean("t_", 5), gap_size=mean("g_", 60), gap_share=f"{tsum('a_', 60)} / nullif({tsum('b_', 60)}, 0)")


@alpha_query("range_geometry_and_gaps", GEO, "containment~6 typical_gap~ gap_size~ gap_share~")
def _(xs, d):
    return al.range_geometry(d)


INTRA = chain().add(sl="ret_last / nullif(abs(ret_last), 0)", sfirst="ret_first / nullif(abs(ret_first), 0)").add(
    ol="sl * vol_last", of_="sfirst * vol_first", im="abs(ret_last) / nullif(vol_last, 0)", vsh="vol_last / nullif(vol_first + vol_last, 0)",
    ats="vol_last / nullif(trades_last, 0)", mid="(open_last - close_first) / nullif(close_first, 0)", sp="ret_last - ret_first").add(
    imbalance_last=f"{tsum('ol', 5)} / nullif({tsum('vol_last', 5)}, 0)",
    imbalance_gap=f"({tsum('ol', 5)}) / nullif({tsum('vol_last', 5)}, 0) - ({tsum('of_', 5)}) / nullif({tsum('vol_first', 5)}, 0)",
    imbalance_persistence=mean("sl", 20), impact_shock=f"im / nullif({mean('im', 20)}, 0)", volume_share=mean("vsh", 20), trade_size="ats",
    size_stability=f"{std('ats', 20)} / nullif({mean('ats', 20)}, 0)", midday=mean("mid", 5), periodicity=mean("ret_last", 20), periodicity_spread=mean("sp", 20))


@alpha_query("intraday_signals", INTRA, "imbalance_last~ imbalance_gap~ imbalance_persistence~ impact_shock~6 volume_share~ trade_size~ "
             "size_stability~ midday~ periodicity~ periodicity_spread~")
def _(xs, d):
    return al.intraday(d)


FUND = chain().add(ey="sig / nullif(close, 0)", roa="sig / nullif(volume, 0)", cr="dollar_volume / nullif(volume, 0)",
                   d_=f"sig - {lag('sig')}").add(chg="CASE WHEN d_ <> 0 THEN 1.0 END").add(
    earnings_yield="ey", roa_change=f"roa - {lag('roa', 12)}", cash_build=f"ln(cr / nullif({lag('cr', 12)}, 0))",
    growth=f"(sig - {lag('sig', 12)}) / nullif(abs({lag('sig', 12)}), 0)", freshness=tsum("chg", 12, 1))


@alpha_query("fundamental_levels_and_changes", FUND, "earnings_yield~ roa~ roa_change~ cash_build~ growth~6 freshness~")
def _(xs, d):
    out = al.fundamental_changes(d.withColumn("cash", F.col("dollar_volume")), "sig", "volume", "cash", "close", 12)
    before = F.col("cash_ratio") - F.col("cash_build")
    return out.withColumn("cash_build", F.log(F.col("cash_ratio") / before))
