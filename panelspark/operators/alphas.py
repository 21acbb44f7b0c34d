"""Named alpha expressions as compositions of per-entity and per-date operators.

Every builder takes a cross-section and a panel with the simulator's fields (close, open, high, low,
volume, ret1, ret5, ret20, market, plus the hourly fields it reads) and adds ``alpha``. Steps are staged
columns because a window may not contain a window. Windows are parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.elementwise import div, zero_to_null
from . import rolling as ts
from .rolled import roll, rolled
from .tradingcal import EARNINGS_GATES, STRESS_GATES, event_stress, event_weight

#: Tuned windows and winsor level of the rank-25 core.
RANK25 = {"w_stoch": 10, "w_size": 175, "w_volstd": 12, "w_vrmean": 10, "w_in1": 20, "w_in2": 17, "w_zs": 10,
          "w_out": 10, "w_med": 20, "w_skew": 60, "w_min": 20, "w_s1": 10, "w_s2": 20, "w_s3": 20, "winsor": 0.005}
#: Untuned windows of the same core.
RANK25_BASE = RANK25 | {"w_stoch": 20, "w_size": 60, "w_volstd": 20, "w_vrmean": 20, "w_in1": 10, "w_in2": 20, "winsor": 0.01}


def _gates(bounds) -> tuple:
    """The eight event gates with their tuned bounds, in declaration order."""
    return tuple((c, op, k) for (c, op, _), k in zip(STRESS_GATES, bounds, strict=True))


# Tuned gate bounds per alpha, in the order of STRESS_GATES.
GATES_CORE = _gates((1, 0, 1, 1, 7, 2, 0, 7))
GATES_WIDE = _gates((0, 0, 10, 1, 10, 15, 0, 1))
GATES_SPLIT = _gates((2, 12, 10, 1, 10, 13, 0, 5))
GATES_CYCLE = _gates((2, 15, 10, 1, 10, 13, 0, 5)) + (
    ("days_until_next_earnings", "le", 15), ("days_until_next_earnings", "ge", 12))
GATES_BLEND = _gates((2, 12, 10, 1, 10, 15, 0, 1))
GATES_LONG = STRESS_GATES + EARNINGS_GATES


def rank01(xs, df: DataFrame, x: str, out: str) -> DataFrame:
    """Dense rank in [0, 1]."""
    return xs.rank_dense12(df, x, "_d").withColumn(out, F.col("_d") - 1.0).drop("_d")


def finish_alpha(xs, df: DataFrame, core: str, p: float, weight=None) -> DataFrame:
    """Winsorise, multiply by the weight, zeros become missing."""
    d = xs.winsor(df, core, "_c", p)
    v = F.col("_c") if weight is None else F.col("_c") * weight
    return d.withColumn("alpha", zero_to_null(v)).drop("_c")


def with_stress(df: DataFrame, gates) -> DataFrame:
    return df.withColumn("stress", event_stress(gates)).withColumn("w", event_weight("stress"))


def low_vol_half(xs, df: DataFrame, w: int = 20, out: str = "lovol") -> DataFrame:
    d = rank01(xs, df.withColumn("_v", ts.std("ret1", w)), "_v", "_vr")
    return d.withColumn(out, (F.col("_vr") <= 0.5).cast("double")).drop("_v", "_vr")


def stochastic(w: int):
    lo, hi = ts.min_("low", w), ts.max_("high", w)
    return (F.col("close") - lo) / zero_to_null(hi - lo)


def auction_displacement(xs, df: DataFrame, w: int = 20, quiet: int = 10) -> DataFrame:
    """Close against the last hour's average price, scaled by its own deviation, away from reports."""
    d = df.withColumn("push", div(F.col("close") - F.col("vwap_last"), "vwap_last"))
    z = F.col("push") / zero_to_null(ts.std("push", w))
    far = F.coalesce((F.col("days_until_next_earnings") > quiet).cast("double"), F.lit(0.0))
    return d.withColumn("alpha", zero_to_null(-F.tanh(z) * far)).drop("push")


def reversal_core(xs, df: DataFrame, out: str, stoch_w: int = 20, zs: int = 10, med: int = 20) -> DataFrame:
    """Range position and relative volume against volatility-scaled returns."""
    d = df.withColumns({
        "_st": stochastic(stoch_w), "_rv": div("volume", ts.mean("volume", 20)),
        "_vr": ts.std("ret1", 20) / zero_to_null("ret20")})
    d = xs.winsor(d, "_vr", "_vw", 0.02)
    d = xs.zscore(d, "_rv", "_rz")
    d = rolled(
        d.withColumn("_ms", -F.col("_st")), _r3=roll("delay", "_rv", 3), _rd=roll("less", ("_rv", "_r3")), _vm=roll("median", "_vw", 3),
        _in=roll("less", ("_ms", "_vm")), _mean=roll("mean", "_st", zs), _std=roll("std", "_st", zs), _med=roll("median", "_rz", med),
        _mr=roll("mean", "ret20", 20), _sk=roll("skew", "_rd", 33), _mi=roll("mean", "_in", 15))
    z = (F.col("_st") - F.col("_mean")) / zero_to_null("_std")
    core = -z - (((F.col("_med") - F.col("_mr")) + F.col("_sk")) - F.col("_mi"))
    return d.withColumn(out, core).drop(
        "_st", "_rv", "_vr", "_vw", "_rz", "_rd", "_vm", "_in", "_ms", "_r3", "_mean", "_std", "_med", "_mr", "_sk", "_mi")


def reversal_earnings_gated(xs, df: DataFrame, lo: int = 0, hi: int = 12) -> DataFrame:
    du = F.col("days_until_next_earnings")
    gate = F.coalesce(du.between(lo, hi).cast("double"), F.lit(0.0))
    return finish_alpha(xs, reversal_core(xs, df, "core"), "core", 0.01, gate).drop("core")


def rank25_core(xs, df: DataFrame, out: str, p: dict = RANK25, rank=rank01) -> DataFrame:
    """The parameterised core: smoothed range position over size and volatility ranks.

    ``rank`` is the simulator's dense rank, or ``xs.rank_pct`` for the search's percentile rank.
    """
    d = df.withColumns({
        "_st": stochastic(p["w_stoch"]), "_dv": F.col("close") * F.col("volume"),
        "_vs": ts.std("ret1", p["w_volstd"]), "_co": div(F.col("close") - F.col("open"), "open")})
    d = d.withColumn("_ds", ts.mean("_dv", p["w_size"]))
    d = rank(xs, rank(xs, d, "_ds", "_sz"), "_vs", "_vk")
    d = rolled(
        d.withColumns({"_ss": F.col("_st") + F.col("_sz"), "_ms": -F.col("_st")}).drop("_dv", "_vs", "_ds"),
        _d1=roll("mean", "_vk", p["w_vrmean"]), _s1=roll("mean", "_sz", p["w_s1"]), _md=roll("median", "_co", p["w_med"]),
        _i1=roll("mean", "_ss", p["w_in1"]), _s2=roll("mean", "_s1", p["w_s2"]), _sk=roll("skew", "_md", p["w_skew"]),
        _i2=roll("mean", "_i1", p["w_in2"]), _s3=roll("mean", "_s2", p["w_s3"]), _mn=roll("min", "_s3", p["w_min"]),
        _q=roll("ratio", ("_ms", "_d1")), _c=roll("ratio", ("_q", "_i2")),
        _cm=roll("mean", "_c", p["w_zs"]), _cs=roll("std", "_c", p["w_zs"]), _cd=roll("less", ("_c", "_cm")),
        _z=roll("ratio", ("_cd", "_cs")), _a=roll("less", ("_z", "_sz")), _h=roll("mean", "_a", p["w_out"]))
    d = d.withColumn("_b", F.col("_st") + ((F.col("_sk") + (F.col("_sz") + F.col("ret5"))) + F.col("_mn")))
    d = rank(xs, d, "_b", "_br")
    return d.withColumn(out, F.col("_h") - F.col("_br")).drop(
        "_st", "_co", "_sz", "_vk", "_d1", "_ss", "_ms", "_s1", "_md", "_i1", "_s2", "_sk", "_i2", "_s3", "_mn",
        "_q", "_c", "_cm", "_cs", "_cd", "_z", "_a", "_b", "_h", "_br")


def rank25_gated(xs, df: DataFrame, p: dict = RANK25, gates=GATES_CORE) -> DataFrame:
    d = with_stress(rank25_core(xs, df, "core", p), gates)
    return finish_alpha(xs, d, "core", p["winsor"], F.col("w")).drop("core")


def rank25_window_gated(xs, df: DataFrame, p: dict = RANK25_BASE, lo: int = 0, hi: int = 12,
                        counter: str = "days_until_next_earnings") -> DataFrame:
    """The same core on percentile ranks, winsorised and kept only inside a counter window."""
    d = rank25_core(xs, df, "core", p, rank=lambda x, t, a, b: x.rank_pct(t, a, b))
    d = xs.winsor(d, "core", "_c", p["winsor"])
    return d.withColumn("alpha", F.when(F.col(counter).between(lo, hi), F.col("_c"))).drop("_c", "core")


def vol_regime_coupling(xs, df: DataFrame, gates=GATES_WIDE, vol: int = 20, corr_w: int = 60) -> DataFrame:
    """Smoothed correlation of volatility level minus surprise with returns, against the price trend."""
    d = df.withColumn("_v", ts.std("ret1", vol))
    d = d.withColumn("_x", ts.mean("_v", 20) - ts.zscore("_v", 10))
    d = rolled(
        d, _k=roll("corr", ("_x", "ret20"), corr_w), _m=roll("max", "_k", 10), _n=roll("mean", "_m", 20), _top=roll("max", "_n", 5), _ma=roll("mean", "close", 20))
    d = d.withColumn("core", F.col("_top") - div("close", "_ma"))
    return finish_alpha(xs, with_stress(d, gates), "core", 0.01, F.col("w")).drop("_v", "_x", "_k", "_m", "_n", "_top", "_ma", "core")


def closing_skew(xs, df: DataFrame, gates=GATES_WIDE, w: int = 1) -> DataFrame:
    d = rank01(xs, df.withColumn("_s", ts.mean("skew_last", w, 1)), "_s", "score")
    return finish_alpha(xs, with_stress(d, gates), "score", 0.01, F.col("w")).drop("_s", "score")


def reversal_low_vol(xs, df: DataFrame, gates=GATES_SPLIT) -> DataFrame:
    d = reversal_core(xs, df, "core", stoch_w=10, zs=80, med=10)
    d = with_stress(low_vol_half(xs, d, 20), gates)
    return finish_alpha(xs, d, "core", 0.01, F.col("w") * F.col("lovol")).drop("core")


def earnings_cycle(xs, df: DataFrame, gates=GATES_CYCLE, vol: int = 60) -> DataFrame:
    d = rank01(xs, df.withColumn("_du", F.col("days_until_next_earnings").cast("double")), "_du", "_r")
    d = with_stress(low_vol_half(xs, d.withColumn("score", -F.col("_r")), vol), gates)
    return finish_alpha(xs, d, "score", 0.01, F.col("w") * F.col("lovol")).drop("_du", "_r", "score")


def ranked_closing_skew(xs, df: DataFrame, gates=GATES_CYCLE, w: int = 60) -> DataFrame:
    d = rank01(xs, df.withColumn("_t", ts.rank("skew_last", w)), "_t", "score")
    d = with_stress(low_vol_half(xs, d, w), gates)
    return finish_alpha(xs, d, "score", 0.01, F.col("w") * F.col("lovol")).drop("_t", "score")


def residual_reversal(xs, df: DataFrame, out: str, market: str = "mkt", beta_w: int = 60, vol: int = 20) -> DataFrame:
    d = rolled(df, _be=roll("corr", ("ret1", market), beta_w), _sm=roll("sum", market, 5), _sd=roll("std", "ret1", vol))
    res = F.col("ret5") - F.col("_be") * F.col("_sm")
    d = d.withColumn("_res", -res / zero_to_null("_sd")).drop("_be", "_sm", "_sd")
    return rank01(xs, d, "_res", out).drop("_res")


def efficacy(df: DataFrame, ret: str = "ret1", **signals: tuple[str, int]) -> DataFrame:
    """Per-entity rolling correlations of previous signals with the return, one pass for all (output: signal and window)."""
    lagged = {f"_l_{s}": roll("delay", s, 1) for s, _ in signals.values()}
    return rolled(df, **lagged, **{out: roll("corr", (f"_l_{s}", ret), w) for out, (s, w) in signals.items()}).drop(*lagged)


def adaptive(xs, df: DataFrame, mode: str, w: int = 60, gates=GATES_BLEND, fast: int = 20, slow: int = 120) -> DataFrame:
    """Signals weighted by their own rolling efficacy.

    ``single``: signal x rank(efficacy); ``blend``: two signals, each by its ranked efficacy;
    ``switch``: hold the better one; ``decay``: signal x rank(fast minus slow efficacy); ``pure``: rank
    of the efficacy of scaled reversal; ``gated``: the blend under the event gate.
    """
    d = rank01(xs, df.withColumn("_s", ts.mean("skew_last", 1, 1)), "_s", "a")
    if mode == "single":
        d = rank01(xs, efficacy(d, _e=("a", w)), "_e", "_er").withColumn("score", F.col("a") * F.col("_er"))
    elif mode == "decay":
        d = efficacy(d, _f=("a", fast), _g=("a", slow)).withColumn("_e", F.col("_f") - F.col("_g"))
        d = rank01(xs, d, "_e", "_er").withColumn("score", F.col("a") * F.col("_er"))
    elif mode == "pure":
        d = d.withColumn("_rev", -F.col("ret1") / zero_to_null(ts.std("ret1", 20)))
        d = rank01(xs, efficacy(d, _e=("_rev", w)), "_e", "score")
    elif mode in ("blend", "switch", "gated"):
        d = residual_reversal(xs, d, "b", beta_w=w)
        d = efficacy(d, _ea=("a", w), _eb=("b", w))
        if mode == "switch":
            pick = F.coalesce((F.col("_ea") > F.col("_eb")).cast("double"), F.lit(0.0))
            d = d.withColumn("score", F.col("a") * pick + F.col("b") * (1.0 - pick))
        else:
            d = rank01(xs, rank01(xs, d, "_ea", "_ra"), "_eb", "_rb")
            d = d.withColumn("score", F.col("a") * F.col("_ra") + F.col("b") * F.col("_rb"))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    weight = None
    if mode == "gated":
        d = with_stress(d, gates)
        weight = F.col("w")
    return finish_alpha(xs, d, "score", 0.01, weight)


def event_conditional(df: DataFrame, stress: str, w: int = 250, fast: int = 60) -> DataFrame:
    """Share, multiple and depth of volume on event rows over a trailing window."""
    s = F.col(stress).cast("double")
    quiet = F.when(s < 1, 1.0).otherwise(0.0)
    d = df.withColumns({
        "_vs": F.col("volume") * s, "_s": s, "_as": F.abs("ret1") * s, "_vq": F.col("volume") * quiet, "_aq": F.abs("ret1") * quiet})
    share = lambda k: ts.sum_("_vs", k) / zero_to_null(ts.sum_("volume", k))
    d = d.withColumns({
        "flow_share": share(w), "_ev": ts.sum_("_vs", w) / zero_to_null(ts.sum_("_s", w)),
        "depth_event": ts.sum_("_vs", w) / zero_to_null(ts.sum_("_as", w)),
        "depth_quiet": ts.sum_("_vq", w) / zero_to_null(ts.sum_("_aq", w)), "flow_trend": share(fast) - share(w)})
    return d.withColumns({
        "flow_multiple": F.col("_ev") / zero_to_null(ts.mean("volume", w)),
        "resilience": div("depth_event", "depth_quiet")}).drop("_vs", "_s", "_as", "_vq", "_aq", "_ev")


def characteristics(df: DataFrame, w: int = 60) -> DataFrame:
    """Autocorrelation, variance ratio, vol term structure, return-volume correlation, semivolatility
    ratio and announcement return."""
    sgn = F.col("ret1") / zero_to_null(F.abs("ret1"))
    d = df.withColumns({
        "_l": ts.delay("ret1", 1), "_up": F.col("ret1") * (sgn + 1.0) * 0.5, "_dn": F.col("ret1") * (1.0 - sgn) * 0.5,
        "_j": F.col("days_until_next_earnings") - ts.delay("days_until_next_earnings", 1)})
    d = d.withColumn("_ann", (F.col("_j") / zero_to_null(F.abs("_j").cast("double")) + 1.0) * 0.5)
    d = rolled(
        d.withColumn("_ra", F.col("ret1") * F.col("_ann")).drop("_j"), autocorr=roll("corr", ("ret1", "_l"), w), ret_volume=roll("corr", ("ret1", "volume"), w),
        _s5=roll("std", "ret5", w), _s1=roll("std", "ret1", w), _sf=roll("std", "ret1", 5), _su=roll("std", "_up", w), _sd=roll("std", "_dn", w),
        _tr=roll("sum", "_ra", 4 * w), _ta=roll("sum", "_ann", 4 * w))
    return d.withColumns({
        "var_ratio": F.col("_s5") / zero_to_null(F.col("_s1") * 5.0 ** 0.5), "vol_term": div("_sf", "_s1"),
        "semivol": div("_su", "_sd"), "announcement": div("_tr", "_ta")}).drop(
        "_l", "_up", "_dn", "_ann", "_ra", "_s5", "_s1", "_sf", "_su", "_sd", "_tr", "_ta")


def relational(df: DataFrame, market: str = "mkt", fast: int = 60, slow: int = 250, skip: int = 20) -> DataFrame:
    """Betas, their instability and term structure, idiosyncratic share, momentum, path, seasonality."""
    d = rolled(
        df.withColumn("_sgn", F.col("ret1") / zero_to_null(F.abs("ret1"))), beta=roll("corr", ("ret1", market), slow), _bf=roll("corr", ("ret1", market), fast),
        _ls=roll("delay", "ret20", slow), beta_instability=roll("std", "_bf", fast), _near=roll("delay", "close", skip), _far=roll("delay", "close", slow),
        momentum=roll("ratio", ("_near", "_far")), _top=roll("max", "high", slow), consistency=roll("mean", "_sgn", slow), seasonal=roll("mean", "_ls", 5))
    return d.withColumns({
        "beta_term": F.col("_bf") - F.col("beta"), "idio_share": 1.0 - F.col("_bf") * F.col("_bf"),
        "high_proximity": div("close", "_top")}).drop("_bf", "_sgn", "_ls", "_near", "_far", "_top")


def range_geometry(df: DataFrame, w: int = 20, slow: int = 60) -> DataFrame:
    """Range containment, close against the typical price, gap size and gap share."""
    ph, pl, pc = ts.delay("high", 1), ts.delay("low", 1), ts.delay("close", 1)
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    gap = F.abs(F.col("open") - pc)
    d = df.withColumns({
        "_c": ((ph - F.col("high")) + (F.col("low") - pl)) / zero_to_null(ph - pl), "_t": (F.col("close") - tp) / zero_to_null(tp),
        "_g": gap / zero_to_null(pc), "_a": gap, "_b": gap + F.abs(F.col("close") - F.col("open"))})
    return d.withColumns({
        "containment": ts.mean("_c", w), "typical_gap": ts.mean("_t", 5), "gap_size": ts.mean("_g", slow),
        "gap_share": ts.sum_("_a", slow) / zero_to_null(ts.sum_("_b", slow))}).drop("_c", "_t", "_g", "_a", "_b")


def fundamental_changes(df: DataFrame, income: str, assets: str, cash: str, price: str, back: int = 90) -> DataFrame:
    """Yield, return on assets, cash ratio, their changes over ``back`` rows and reporting freshness."""
    d = df.withColumns({
        "earnings_yield": div(income, price), "roa": div(income, assets), "cash_ratio": div(cash, assets),
        "_d": ts.delta(income, 1)})
    d = d.withColumn("_c", F.when(F.col("_d") != 0, 1.0))
    return d.withColumns({
        "roa_change": ts.delta("roa", back), "cash_build": ts.delta("cash_ratio", back),
        "growth": div(F.col(income) - ts.delay(income, back), F.abs(ts.delay(income, back))),
        "freshness": ts.sum_("_c", back, 1)}).drop("_d", "_c")


def intraday(df: DataFrame, w: int = 5, slow: int = 20) -> DataFrame:
    """Signals of the first and last hour: order imbalance, impact shock, volume share, trade size,
    regularity, midday return, periodicity."""
    sl = F.col("ret_last") / zero_to_null(F.abs("ret_last"))
    sf = F.col("ret_first") / zero_to_null(F.abs("ret_first"))
    d = df.withColumns({
        "_ol": sl * F.col("vol_last"), "_of": sf * F.col("vol_first"), "_sl": sl, "_im": div(F.abs("ret_last"), "vol_last"),
        "_vs": F.col("vol_last") / zero_to_null(F.col("vol_first") + F.col("vol_last")),
        "_ats": div("vol_last", "trades_last"), "_mid": div(F.col("open_last") - F.col("close_first"), "close_first"),
        "_sp": F.col("ret_last") - F.col("ret_first")})
    il, fl = ts.sum_("_ol", w) / zero_to_null(ts.sum_("vol_last", w)), ts.sum_("_of", w) / zero_to_null(ts.sum_("vol_first", w))
    return d.withColumns({
        "imbalance_last": il, "imbalance_gap": il - fl, "imbalance_persistence": ts.mean("_sl", slow),
        "impact_shock": F.col("_im") / zero_to_null(ts.mean("_im", slow)), "volume_share": ts.mean("_vs", slow),
        "trade_size": F.col("_ats"), "size_stability": ts.std("_ats", slow) / zero_to_null(ts.mean("_ats", slow)),
        "midday": ts.mean("_mid", w), "periodicity": ts.mean("ret_last", slow), "periodicity_spread": ts.mean("_sp", slow),
    }).drop("_ol", "_of", "_sl", "_im", "_vs", "_ats", "_mid", "_sp")
