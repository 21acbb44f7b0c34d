"""Regime filters at given parameters and everything scored against them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import regimes as rg
from ..operators.splits import calendar, calendar_year_folds
from ..session import materialize
from ..sources.tables import market_series, names_bound, table, weekly_panel
from .oracle import MPANEL, more
from .q_evaluate import IC2, SCORED_SQL, hac_sql, ic_sql, ics, scored
from .registry import query

MEANS, VARS = (0.0, 0.0), (0.04, 0.16)
TRANS, INIT = ((0.95, 0.05), (0.10, 0.90)), (2 / 3, 1 / 3)

SERIES_SQL = """series AS (
  SELECT 'market' AS series, date, mkt AS value FROM market
  UNION ALL SELECT 'sector_' || sector, date, avg(ret) FROM panel WHERE sector IS NOT NULL AND ret IS NOT NULL GROUP BY 1, 2),
numbered_series AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) AS t FROM series WHERE value IS NOT NULL),
eta AS (SELECT series, date, t, value,
  -0.5 * (ln(2 * pi()) + ln(0.04) + value * value / 0.04) AS l0, -0.5 * (ln(2 * pi()) + ln(0.16) + value * value / 0.16) AS l1
  FROM numbered_series),
filt AS (
  SELECT series, date, t, 2 / 3.0 * exp(l0 - greatest(l0, l1)) / (2 / 3.0 * exp(l0 - greatest(l0, l1)) + 1 / 3.0 * exp(l1 - greatest(l0, l1))) AS calm,
         ln(2 / 3.0 * exp(l0 - greatest(l0, l1)) + 1 / 3.0 * exp(l1 - greatest(l0, l1))) + greatest(l0, l1) AS log_c FROM eta WHERE t = 1
  UNION ALL
  SELECT e.series, e.date, e.t, p0 * exp(l0 - m) / (p0 * exp(l0 - m) + (1 - p0) * exp(l1 - m)),
         ln(p0 * exp(l0 - m) + (1 - p0) * exp(l1 - m)) + m
  FROM (SELECT e.*, f.calm * 0.95 + (1 - f.calm) * 0.10 AS p0, greatest(l0, l1) AS m
        FROM filt f JOIN eta e ON e.series = f.series AND e.t = f.t + 1) e),
probs AS (SELECT series, date, calm, 1 - calm AS stress, log_c FROM filt)"""
PROBS = more(MPANEL.replace("WITH", "WITH RECURSIVE", 1), SERIES_SQL)
PROBS_IC = more(PROBS, SCORED_SQL, IC2)


def all_series(spark, sf):
    """Market and sector return series in one (series, date, value) table.

    The panel is reduced once to (date, sector) cells; both kinds of series come from the cells.
    """
    p = weekly_panel(spark, sf).where("ret is not null")
    cells = materialize(p.groupBy("date", "sector").agg(
        F.sum(F.col("ret") * F.col("dollar_volume")).alias("num"), F.sum("dollar_volume").alias("den"), F.avg("ret").alias("value")))
    m = cells.groupBy("date").agg((F.sum("num") / F.sum("den")).alias("value")).withColumn("series", F.lit("market"))
    s = cells.where("sector is not null").withColumn("series", F.concat(F.lit("sector_"), F.col("sector").cast("string")))
    return m.select("series", "date", "value").unionByName(s.select("series", "date", "value"))


def probs(spark, sf):
    return materialize(rg.regime_filter(all_series(spark, sf), MEANS, VARS, TRANS, INIT))


@query("regime_filter", "series date calm~7 stress~7 log_c~7", "SELECT series, date, calm, stress, log_c FROM probs", PROBS)
def _(spark, sf):
    return probs(spark, sf)


#: The filter for a target known five dates later: five chains, each through every fifth date, five steps of the matrix at a time.
H = 5
STAY, LEAVE = 2 / 3 + 0.85**H / 3, 2 / 3 - 0.85**H * 2 / 3
HORIZON_SQL = f"""hfilt AS (
  SELECT series, date, t, 2 / 3.0 * exp(l0 - greatest(l0, l1)) / (2 / 3.0 * exp(l0 - greatest(l0, l1)) + 1 / 3.0 * exp(l1 - greatest(l0, l1))) AS calm,
         ln(2 / 3.0 * exp(l0 - greatest(l0, l1)) + 1 / 3.0 * exp(l1 - greatest(l0, l1))) + greatest(l0, l1) AS log_c FROM eta WHERE t <= {H}
  UNION ALL
  SELECT e.series, e.date, e.t, p0 * exp(l0 - m) / (p0 * exp(l0 - m) + (1 - p0) * exp(l1 - m)),
         ln(p0 * exp(l0 - m) + (1 - p0) * exp(l1 - m)) + m
  FROM (SELECT e.*, f.calm * {STAY!r} + (1 - f.calm) * {LEAVE!r} AS p0, greatest(l0, l1) AS m
        FROM hfilt f JOIN eta e ON e.series = f.series AND e.t = f.t + {H}) e),
hprobs5 AS (SELECT series, date, calm, 1 - calm AS stress, log_c FROM hfilt)"""
PROBS_H5 = more(PROBS, HORIZON_SQL)


@query("regime_filter_horizon", "series date calm~7 stress~7 log_c~7", "SELECT series, date, calm, stress, log_c FROM hprobs5", PROBS_H5)
def _(spark, sf):
    return rg.regime_filter(all_series(spark, sf), MEANS, VARS, TRANS, INIT, horizon=H)


def window_sql(h):
    """P(calm) after j steps has the closed form pi + (xi - pi) * 0.85^j for this chain."""
    terms = " + ".join(f"(2 / 3.0 + (calm - 2 / 3.0) * pow(0.85, {j}))" for j in range(1, h + 1))
    return f"({terms}) / {h}"


@query("gate_weights", "kind series date calm~7 stress~7", f"""
SELECT 'filtered' AS kind, series, date, calm, stress FROM probs
UNION ALL SELECT 'predicted', series, date, {window_sql(1)}, 1 - {window_sql(1)} FROM probs
UNION ALL SELECT 'window', series, date, {window_sql(5)}, 1 - {window_sql(5)} FROM probs""", PROBS)
def _(spark, sf):
    p = probs(spark, sf)
    out = None
    for kind in ("filtered", "predicted", "window"):
        one = rg.gate_weights(p, TRANS, kind, 5).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


@query("regime_summary", "series dates# first_date last_date share_calm~ share_stress~ mean_calm~6 mean_stress~6 stress_share~", """
SELECT series, count(*) AS dates, min(date) AS first_date, max(date) AS last_date, avg(CAST(calm >= stress AS DOUBLE)) AS share_calm,
  avg(CAST(calm < stress AS DOUBLE)) AS share_stress, avg(calm) AS mean_calm, avg(stress) AS mean_stress,
  avg(CAST(stress > 0.5 AS DOUBLE)) AS stress_share FROM probs GROUP BY series""", PROBS)
def _(spark, sf):
    return rg.regime_summary(probs(spark, sf))


@query("predictive_score_by_fold", "series test_year# score~6 worst~6 dates#", """
SELECT series, test_year, sum(log_c) AS score, sum(log_c) FILTER (WHERE k <= 5) AS worst, count(*) AS dates FROM (
  SELECT series, year(date) AS test_year, log_c, row_number() OVER (PARTITION BY series, year(date) ORDER BY log_c, date) AS k
  FROM probs WHERE year(date) >= 1996) GROUP BY 1, 2""", PROBS)
def _(spark, sf):
    from ..operators.infer import predictive_scores

    p = probs(spark, sf)
    folds = calendar_year_folds(calendar(p), 1996, 2001, 2).where("role = 'test'")
    return predictive_scores(p, folds, worst=5)


@query("trailing_vol_state", "series date vol~ threshold~ state#", """
SELECT *, CASE WHEN vol IS NOT NULL THEN CAST(vol > threshold AS INT) END AS state FROM (
  SELECT series, date, vol, quantile_cont(vol, 0.5) OVER (PARTITION BY series) AS threshold FROM (
    SELECT *, CASE WHEN count(value) OVER w = 12 THEN stddev_samp(value) OVER w END AS vol FROM series
    WINDOW w AS (PARTITION BY series ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)))""", PROBS)
def _(spark, sf):
    return rg.trailing_vol_state(all_series(spark, sf), 12)


@query("causal_vol_assignment", "series date regime#", """
SELECT series, date, CASE WHEN vol IS NULL OR count(vol) OVER x < 30 THEN -1
  ELSE CAST(vol > quantile_cont(vol, 0.5) OVER x AS INT) + CAST(vol > quantile_cont(vol, 0.75) OVER x AS INT) END AS regime FROM (
    SELECT *, CASE WHEN count(value) OVER w = 12 THEN stddev_samp(value) OVER w END AS vol FROM series
    WINDOW w AS (PARTITION BY series ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
WINDOW x AS (PARTITION BY series ORDER BY date)""", PROBS)
def _(spark, sf):
    return rg.causal_vol_assignment(all_series(spark, sf), 12, 0.5, 3, 30)


EPISODES = """eps AS (SELECT series, count(*) FILTER (WHERE k >= 3) AS episodes FROM (
  SELECT series, g, count(*) AS k FROM (SELECT *, t - row_number() OVER (PARTITION BY series ORDER BY date) AS g
    FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) AS t FROM probs) WHERE stress > 0.5) GROUP BY 1, 2) GROUP BY 1)"""


@query("stress_episodes", "series episodes#", """
SELECT s.series, coalesce(episodes, 0) AS episodes FROM (SELECT DISTINCT series FROM probs) s LEFT JOIN eps ON eps.series = s.series""",
       more(PROBS, EPISODES))
def _(spark, sf):
    return rg.stress_episodes(probs(spark, sf), "stress", 0.5, 3)


@query("missing_gaps", "entity# first_missing last_missing length# next_value~", """
SELECT entity, min(date) AS first_missing, max(date) AS last_missing, count(*) AS length, arg_max(nx, date) AS next_value FROM (
  SELECT *, t - row_number() OVER (PARTITION BY entity ORDER BY date) AS g FROM (
    SELECT entity, date, sig, lead(sig) OVER (PARTITION BY entity ORDER BY date) AS nx, row_number() OVER (PARTITION BY entity ORDER BY date) AS t
    FROM panel) WHERE sig IS NULL) GROUP BY entity, g""", MPANEL)
def _(spark, sf):
    return rg.missing_gaps(weekly_panel(spark, sf), "sig")


@query("market_frame", "date ret_1d~ ret_20d~ vol_20d~ fwd~", """
SELECT date, mkt AS ret_1d, CASE WHEN count(mkt) OVER w = 20 THEN sum(mkt) OVER w END AS ret_20d,
  CASE WHEN count(mkt) OVER w = 20 THEN stddev_samp(mkt) OVER w END AS vol_20d,
  CASE WHEN count(mkt) OVER f = 3 THEN sum(mkt) OVER f END AS fwd FROM market
WINDOW w AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), f AS (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)""", MPANEL)
def _(spark, sf):
    from ..operators.features import market_frame

    return market_frame(market_series(weekly_panel(spark, sf)), 3)


@query("date_level_series", "date value~", "SELECT date, avg(close / open - 1) AS value FROM panel GROUP BY date", MPANEL)
def _(spark, sf):
    p = weekly_panel(spark, sf)
    return rg.date_level_series(p, F.col("close") / F.col("open") - 1, calendar(p))


STATES = "states AS (SELECT series, date, CAST(stress > 0.5 AS INT) AS state FROM probs)"


@query("transition_counts", "series src# dst# n# rate~", """
SELECT series, src, dst, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY series, src) AS rate FROM (
  SELECT series, state AS src, lead(state) OVER (PARTITION BY series ORDER BY date) AS dst FROM states)
WHERE dst IS NOT NULL GROUP BY 1, 2, 3""", more(PROBS, STATES))
def _(spark, sf):
    s = probs(spark, sf).withColumn("state", (F.col("stress") > 0.5).cast("int"))
    return rg.transition_counts(s, "state")


TRANSITIONS = """tr AS (SELECT series, src, dst, count(*) / sum(count(*)) OVER (PARTITION BY series, src) AS rate FROM (
  SELECT series, state AS src, lead(state) OVER (PARTITION BY series ORDER BY date) AS dst FROM states) WHERE dst IS NOT NULL GROUP BY 1, 2, 3)"""


@query("expected_durations", "series src# stay_prob~ expected_duration~ p0~", """
SELECT a.*, q.p0 FROM (SELECT series, src, coalesce(sum(rate) FILTER (WHERE src = dst), 0) AS stay_prob,
   1 / nullif(1 - coalesce(sum(rate) FILTER (WHERE src = dst), 0), 0) AS expected_duration FROM tr GROUP BY 1, 2) a
JOIN (SELECT series, coalesce(sum(rate) FILTER (WHERE src = 1 AND dst = 0), 0) / nullif(coalesce(sum(rate) FILTER (WHERE src = 1 AND dst = 0), 0)
   + coalesce(sum(rate) FILTER (WHERE src = 0 AND dst = 1), 0), 0) AS p0 FROM tr GROUP BY 1) q ON q.series = a.series""",
       more(PROBS, STATES, TRANSITIONS))
def _(spark, sf):
    s = probs(spark, sf).withColumn("state", (F.col("stress") > 0.5).cast("int"))
    t = rg.transition_counts(s, "state")
    return rg.persistence(t).join(rg.stationary_two_state(t), "series")


def market_probs(spark, sf):
    return probs(spark, sf).where("series = 'market'").select("date", "calm", "stress")


JOINED = "joined AS (SELECT i.series, i.date, i.ic, p.calm, p.stress FROM ics i JOIN probs p ON p.date = i.date AND p.series = 'market')"


@query("weighted_regime_ic", "series regime weighted_ic~7 eff_dates~4", """
SELECT series, 'calm' AS regime, sum(calm * ic) / sum(calm) AS weighted_ic, pow(sum(calm), 2) / sum(calm * calm) AS eff_dates FROM joined GROUP BY 1
UNION ALL SELECT series, 'stress', sum(stress * ic) / sum(stress), pow(sum(stress), 2) / sum(stress * stress) FROM joined GROUP BY 1""",
       more(PROBS_IC, JOINED))
def _(spark, sf):
    return rg.weighted_regime_ic(ics(spark, sf).join(F.broadcast(market_probs(spark, sf)), "date"), "ic")


def regression_ctes(src: str, tag: str) -> str:
    """Two-regressor normal equations and the z series of every term, over a (series, date, ic, calm, stress) source."""
    return f"""n{tag} AS (SELECT *, sum(calm * calm) OVER s AS s00, sum(calm * stress) OVER s AS s01, sum(stress * stress) OVER s AS s11,
   sum(calm * ic) OVER s AS t0, sum(stress * ic) OVER s AS t1 FROM {src} WINDOW s AS (PARTITION BY series)),
c{tag} AS (SELECT *, (s11 * t0 - s01 * t1) / det AS c0, (s00 * t1 - s01 * t0) / det AS c1 FROM (SELECT *, s00 * s11 - s01 * s01 AS det FROM n{tag})),
z{tag} AS (SELECT series, date, term, est, (calm * (s11 * a0 - s01 * a1) + stress * (s00 * a1 - s01 * a0)) / det * (ic - c0 * calm - c1 * stress) AS z
  FROM (SELECT *, CASE term WHEN 'calm' THEN 1 WHEN 'contrast' THEN -1 ELSE 0 END AS a0, CASE term WHEN 'calm' THEN 0 ELSE 1 END AS a1,
        CASE term WHEN 'calm' THEN c0 WHEN 'stress' THEN c1 ELSE c1 - c0 END AS est
        FROM c{tag}, (VALUES ('calm'), ('stress'), ('contrast')) AS terms(term)))"""


def regression_sql(tag: str, lags: int, kernel: str) -> str:
    return f"""SELECT h.series, h.term, est AS estimate, sqrt(n * lrv) AS se, est / nullif(sqrt(n * lrv), 0) AS t, kernel, n
FROM ({hac_sql(f'z{tag}', 'z', lags, by='series, term', kernel=kernel)}) h
JOIN (SELECT series, term, max(est) AS est FROM z{tag} GROUP BY 1, 2) e ON e.series = h.series AND e.term = h.term"""


@query("regime_regression", "series term estimate~7 se~7 t~6 kernel n#", regression_sql("r", 2, "uniform"),
       more(PROBS_IC, JOINED, regression_ctes("joined", "r")))
def _(spark, sf):
    d = ics(spark, sf).join(F.broadcast(market_probs(spark, sf)), "date")
    return rg.regime_regression(d, "ic", 2, "uniform")


# three regimes: stress is divided by the sign of the market's return of the date
THREE = ("calm", "stress_up", "stress_down")
JOINED3 = """joined3 AS (SELECT i.series, i.date, i.ic, p.calm AS w0, CASE WHEN m.mkt >= 0 THEN p.stress ELSE 0 END AS w1, CASE WHEN m.mkt >= 0 THEN 0 ELSE p.stress END AS w2
  FROM ics i JOIN probs p ON p.date = i.date AND p.series = 'market' JOIN market m ON m.date = i.date)"""
_CELLS = [(i, j) for i in range(3) for j in range(i, 3)]


def _cofactor(i: int, j: int) -> str:
    """The cofactor of a symmetric 3 x 3 matrix of sums."""
    g = lambda a, b: f"s{min(a, b)}{max(a, b)}"
    r, c = [x for x in range(3) if x != i], [x for x in range(3) if x != j]
    sign = "" if (i + j) % 2 == 0 else "-"
    return f"{sign}({g(r[0], c[0])} * {g(r[1], c[1])} - {g(r[0], c[1])} * {g(r[1], c[0])})"


REGRESS3 = f"""n3 AS (SELECT series, count(*) AS dates, {", ".join(f"sum(w{i} * w{j}) AS s{i}{j}" for i, j in _CELLS)}, {", ".join(f"sum(w{i} * ic) AS t{i}" for i in range(3))} FROM joined3 GROUP BY 1),
i3 AS (SELECT series, {", ".join(f"{_cofactor(i, j)} / det AS v{i}{j}" for i in range(3) for j in range(3))}, t0, t1, t2
  FROM (SELECT *, s00 * {_cofactor(0, 0)} + s01 * {_cofactor(0, 1)} + s02 * {_cofactor(0, 2)} AS det FROM n3)),
c3 AS (SELECT *, {", ".join(f"v{i}0 * t0 + v{i}1 * t1 + v{i}2 * t2 AS c{i}" for i in range(3))} FROM i3),
zr AS (SELECT j.series, date, term, CASE term WHEN 'calm' THEN c0 WHEN 'stress_up' THEN c1 WHEN 'stress_down' THEN c2 ELSE c2 - c0 END AS est,
  ({" + ".join(f"w{i} * (v{i}0 * a0 + v{i}1 * a1 + v{i}2 * a2)" for i in range(3))}) * (ic - c0 * w0 - c1 * w1 - c2 * w2) AS z
  FROM joined3 j JOIN c3 ON c3.series = j.series, (VALUES ('calm', 1, 0, 0), ('stress_up', 0, 1, 0), ('stress_down', 0, 0, 1), ('contrast', -1, 0, 1)) AS terms(term, a0, a1, a2))"""


@query("regime_regression_three", "series term estimate~7 se~7 t~6 kernel n#", regression_sql("r", 2, "uniform"), more(PROBS_IC, JOINED3, REGRESS3))
def _(spark, sf):
    series = all_series(spark, sf)
    weights = market_probs(spark, sf).join(series.where("series = 'market'").select("date", "value"), "date").select(
        "date", "calm", F.when(F.col("value") >= 0, F.col("stress")).otherwise(0.0).alias("stress_up"), F.when(F.col("value") >= 0, 0.0).otherwise(F.col("stress")).alias("stress_down"))
    return rg.regime_regression(ics(spark, sf).join(weights, "date"), "ic", 2, "uniform", states=THREE)


WINDOWED = f"""wprobs AS (SELECT date, {window_sql(3)} AS calm, 1 - {window_sql(3)} AS stress FROM probs WHERE series = 'market'),
hprobs AS (SELECT date, 1.0 - CAST(stress > 0.5 AS INT) AS calm, CAST(stress > 0.5 AS INT) * 1.0 AS stress FROM wprobs),
fprobs AS (SELECT date, calm, stress FROM probs WHERE series = 'market')""" + "".join(
    f", j{t} AS (SELECT i.series, i.date, i.ic, p.calm, p.stress FROM ics i JOIN {t}probs p ON p.date = i.date)" for t in "whf")
SPLITS = {"w": ("soft", "window"), "h": ("hard", "window"), "f": ("soft", "filtered")}
SPLIT_SQL = " UNION ALL ".join(
    f"""SELECT '{s}' AS split, '{k}' AS kind, 3 AS h, a.*, b.se AS se_nw, b.t AS t_nw FROM ({regression_sql(t, 2, 'uniform')}) a
    JOIN ({regression_sql(t, 6, 'bartlett')}) b ON b.series = a.series AND b.term = a.term""" for t, (s, k) in SPLITS.items())
SPLIT_PREFIX = more(PROBS_IC, WINDOWED, *[regression_ctes(f"j{t}", t) for t in SPLITS])


def split_weights(spark, sf):
    p = market_probs(spark, sf)
    w = rg.gate_weights(p, TRANS, "window", 3)
    return {("soft", "window"): w, ("hard", "window"): rg.probs_hard_weights(w), ("soft", "filtered"): p}


@query("split_table", "split kind h# series term estimate~7 se~7 t~6 se_nw~7 t_nw~6 kernel n#", SPLIT_SQL, SPLIT_PREFIX)
def _(spark, sf):
    return rg.split_table(ics(spark, sf), split_weights(spark, sf), 3, 6)


def _fraction(depth: int = 24) -> str:
    """The continued fraction a + 1 / (a + 2 / (a + ...)) of the normal tail, for a = abs(t)."""
    text = "abs(t)"
    for k in range(depth, 0, -1):
        text = f"(abs(t) + {k} / {text})"
    return text


# the distribution function: a power series near zero, the tail's continued fraction from 4 on
NORM = f"""(CASE WHEN abs(t) < 4 THEN 0.5 + sign(t) / sqrt(2 * pi()) * (SELECT sum(pow(-1, k) * pow(abs(t), 2 * k + 1) / (pow(2, k) * gamma(k + 1) * (2 * k + 1)))
  FROM range(70) AS g(k)) WHEN t IS NOT NULL THEN (1 + sign(t)) / 2 - sign(t) * exp(-t * t / 2) / sqrt(2 * pi()) / {_fraction()} END)"""


@query("assign_families", "family split kind series p~6 adjusted~6 reject", f"""
SELECT family, split, kind, series, p,
  CASE family WHEN 'primary' THEN least(1, p * fam) WHEN 'exploratory' THEN least(1, p * fam) END AS adjusted,
  CASE family WHEN 'primary' THEN p * fam <= 0.05 WHEN 'exploratory' THEN p <= 0.1 / fam END AS reject
FROM (SELECT *, count(*) OVER (PARTITION BY family) AS fam FROM (
  SELECT *, CASE family WHEN 'primary' THEN cdf ELSE 2 * least(cdf, 1 - cdf) END AS p FROM (
  SELECT *, {NORM} AS cdf, CASE WHEN split = 'soft' AND kind = 'window' AND series = 's1' THEN 'primary'
     WHEN split = 'soft' AND kind = 'window' THEN 'exploratory' ELSE 'robustness' END AS family
  FROM ({SPLIT_SQL}) WHERE term = 'contrast')))""", SPLIT_PREFIX)
def _(spark, sf):
    # one primary and one exploratory test, so both corrections reduce to p times the family size
    t = rg.split_table(ics(spark, sf), split_weights(spark, sf), 3, 6)
    return rg.assign_families(t, ["s1"], "window")


# ten series, each signal inside each sector: a primary family of three and an exploratory one of seven
SECTOR_ICS = "stacked AS (SELECT 's1_' || sector AS series, date, s1 AS pred, y3 FROM scored WHERE sector IS NOT NULL UNION ALL SELECT 's2_' || sector, date, s2, y3 FROM scored WHERE sector IS NOT NULL)," \
    "\nics AS (" + ic_sql("pred", "y3", by="series, date", src="stacked") + ")"
FAMILY_SQL = " UNION ALL ".join(f"SELECT '{s}' AS split, '{k}' AS kind, a.* FROM ({regression_sql(t, 2, 'uniform')}) a" for t, (s, k) in SPLITS.items() if t != "f")
PRIMARY = ("s1_0", "s1_1", "s1_2")
FAMILY_PREFIX = more(PROBS, SCORED_SQL, SECTOR_ICS, WINDOWED, *[regression_ctes(f"j{t}", t) for t in "wh"], f"""
ft AS (SELECT *, CASE family WHEN 'primary' THEN cdf ELSE 2 * least(cdf, 1 - cdf) END AS p FROM (
  SELECT *, {NORM} AS cdf, CASE WHEN split = 'soft' AND series IN {PRIMARY} THEN 'primary' WHEN split = 'soft' THEN 'exploratory' ELSE 'robustness' END AS family
  FROM ({FAMILY_SQL}) WHERE term = 'contrast')),
fo AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, split, kind, series) AS i, count(*) OVER (PARTITION BY family) AS m FROM ft WHERE p IS NOT NULL)""")


@query("assign_families_of_several", "family split kind series p~6 adjusted~6 reject", """
SELECT a.family, a.split, a.kind, a.series, any_value(a.p) AS p,
  CASE a.family WHEN 'primary' THEN least(1, max((a.m - b.i + 1) * b.p) FILTER (WHERE b.i <= a.i)) WHEN 'exploratory' THEN least(1, min(b.p * b.m / b.i) FILTER (WHERE b.i >= a.i)) END AS adjusted,
  CASE a.family WHEN 'primary' THEN least(1, max((a.m - b.i + 1) * b.p) FILTER (WHERE b.i <= a.i)) <= 0.05
    WHEN 'exploratory' THEN min(a.i) <= coalesce(max(b.i) FILTER (WHERE b.p <= b.i / b.m * 0.1), 0) END AS reject
FROM fo a JOIN fo b ON a.family = b.family GROUP BY 1, 2, 3, 4""", FAMILY_PREFIX)
def _(spark, sf):
    from ..operators import evaluate as ev
    from ..operators.quality import pooled_folds

    d = scored(spark, sf).where("sector is not null")
    stacked = pooled_folds(d, {"s1": "s1", "s2": "s2"}, ["date", "entity", "sector", "y3"])
    stacked = stacked.withColumn("series", F.concat_ws("_", "arm", F.col("sector").cast("string")))
    found = ev.rank_ic(stacked, "pred", "y3", by=("series", "date"), bound=names_bound(spark, sf))
    weights = {k: w for k, w in split_weights(spark, sf).items() if k[1] == "window"}
    return rg.assign_families(rg.split_table(found, weights, 3, 6), PRIMARY, "window")


@query("sector_measures", "series dates# share_stressed~ share_stressed_while_calm~ p_stress_given_calm~ corr_with_market~6 episodes#", """
SELECT s.series, count(*) AS dates, avg(CAST(s.stress > 0.5 AS DOUBLE)) AS share_stressed,
  avg(CAST(s.stress > 0.5 AND m.stress <= 0.5 AS DOUBLE)) AS share_stressed_while_calm,
  avg(CAST(s.stress > 0.5 AS DOUBLE)) FILTER (WHERE m.stress <= 0.5) AS p_stress_given_calm,
  corr(s.stress, m.stress) AS corr_with_market, coalesce(any_value(eps.episodes), 0) AS episodes
FROM probs s JOIN probs m ON m.series = 'market' AND m.date = s.date LEFT JOIN eps ON eps.series = s.series
WHERE s.series <> 'market' GROUP BY s.series""", more(PROBS, EPISODES))
def _(spark, sf):
    p = probs(spark, sf)
    return rg.sector_measures(p.where("series <> 'market'"), p.where("series = 'market'"), "stress", 0.5, 3)


@query("co_stress", "a b share~", """
SELECT x.series AS a, y.series AS b, avg(CAST(x.stress > 0.5 AND y.stress > 0.5 AS DOUBLE)) AS share
FROM probs x JOIN probs y ON x.date = y.date
WHERE x.series <> 'market' AND y.series <> 'market'
  AND x.date IN (SELECT date FROM probs WHERE series <> 'market' GROUP BY date HAVING count(*) = (SELECT count(DISTINCT series) FROM probs WHERE series <> 'market')) GROUP BY 1, 2""", PROBS)
def _(spark, sf):
    sectors = probs(spark, sf).where("series <> 'market'")
    names = [r.series for r in sectors.select("series").distinct().orderBy("series").collect()]  # one for each sector
    return rg.co_stress(sectors, "stress", 0.5, names)


UTIL = """util AS (SELECT date, avg(volume / (volume + n_trades + 1)) AS u0, avg(n_trades / (volume + n_trades + 1)) AS u1 FROM panel GROUP BY date),
ctx AS (SELECT date, mkt, abs(mkt) AS vix FROM market)"""


@query("regime_alignment", "share corr_mkt~ corr_vix~ high~ low~", " UNION ALL ".join(f"""
SELECT 'u{k}' AS share, corr(u{k}, mkt) AS corr_mkt, corr(u{k}, vix) AS corr_vix, avg(u{k}) FILTER (WHERE vix >= hi) AS high, avg(u{k}) FILTER (WHERE vix <= lo) AS low
FROM (SELECT u.*, c.mkt, c.vix, quantile_cont(vix, 1 / 3.0) OVER () AS lo, quantile_cont(vix, 2 / 3.0) OVER () AS hi FROM util u LEFT JOIN ctx c ON c.date = u.date)"""
                                                                                 for k in (0, 1)), more(MPANEL, UTIL))
def _(spark, sf):
    from ..operators.universe import utilisation_by_date

    p = weekly_panel(spark, sf)
    total = F.col("volume") + F.col("n_trades") + 1
    util = utilisation_by_date(p.withColumns({"u0": F.col("volume") / total, "u1": F.col("n_trades") / total}), ["u0", "u1"])
    ctx = market_series(p).withColumn("vix", F.abs("mkt"))
    return rg.regime_alignment(util, ctx, ["u0", "u1"], ["mkt", "vix"], "vix")


@query("regime_clock_weights", "series date w_calm~7 w_stress~7 weight~7", """
SELECT series, date, w0 AS w_calm, w1 AS w_stress, w0 + w1 AS weight FROM (
  SELECT series, date, calm * pow(2, -coalesce(sum(calm) OVER l, 0) / 30) AS w0, stress * pow(2, -coalesce(sum(stress) OVER l, 0) / 30) AS w1
  FROM probs WINDOW l AS (PARTITION BY series ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))""", PROBS)
def _(spark, sf):
    return ev.regime_clock_weights(probs(spark, sf), ["calm", "stress"], 30.0)


MIX = """mix AS (SELECT *, a - m AS d0, b - m AS d1, m + ln(exp(a - m) + exp(b - m)) AS lse FROM (SELECT *, greatest(a, b) AS m FROM (
  SELECT s.date, s.entity, s.y3, s.s1, p.calm, p.stress, s.s1 / 1000 AS mu0, -s.s1 / 1000 AS mu1,
    ln(p.calm) - 0.5 * ln(2 * pi()) - ln(0.02) - 0.5 * pow((y3 - s1 / 1000) / 0.02, 2) AS a,
    ln(p.stress) - 0.5 * ln(2 * pi()) - ln(0.05) - 0.5 * pow((y3 + s1 / 1000) / 0.05, 2) AS b
  FROM scored s JOIN probs p ON p.date = s.date AND p.series = 'market' WHERE y3 IS NOT NULL AND s1 IS NOT NULL))),
mixed AS (SELECT *, -lse AS nll, exp(a - lse) AS r0, exp(b - lse) AS r1 FROM mix)"""
MIXED = more(PROBS, SCORED_SQL, MIX)


def mixed(spark, sf):
    d = scored(spark, sf).where("y3 is not null and s1 is not null").join(F.broadcast(market_probs(spark, sf)), "date")
    d = d.withColumns({"mu0": F.col("s1") / 1000, "mu1": -F.col("s1") / 1000})
    return rg.mixture_scores(d, "y3", ["mu0", "mu1"], [0.02, 0.05], ["calm", "stress"])


@query("mixture_responsibilities", "date entity nll~6 r0~6 r1~6", "SELECT date, entity, nll, r0, r1 FROM mixed", MIXED)
def _(spark, sf):
    return mixed(spark, sf)


@query("weight_diagnostics", "entropy~6 util_r0~6 util_r1~6 sharpness~6", """
SELECT avg(-(CASE WHEN r0 > 0 THEN r0 * ln(r0) ELSE 0 END) - (CASE WHEN r1 > 0 THEN r1 * ln(r1) ELSE 0 END)) AS entropy, avg(r0) AS util_r0, avg(r1) AS util_r1,
  avg(greatest(r0, r1)) AS sharpness FROM mixed""", MIXED)
def _(spark, sf):
    return rg.weight_diagnostics(mixed(spark, sf), ["r0", "r1"])


@query("output_pairs", "a b corr~ rms_distance~", """
SELECT 'y3' AS a, 's1' AS b, corr(y3, s1) AS corr, sqrt(avg(pow(y3 - s1, 2))) AS rms_distance FROM mixed
UNION ALL SELECT 'y3', 'mu0', corr(y3, mu0), sqrt(avg(pow(y3 - mu0, 2))) FROM mixed
UNION ALL SELECT 's1', 'mu0', corr(s1, mu0), sqrt(avg(pow(s1 - mu0, 2))) FROM mixed""", MIXED)
def _(spark, sf):
    return rg.output_pairs(mixed(spark, sf), ["y3", "s1", "mu0"])


@query("weight_quantile_bins", "bin# mean_r~6", """
SELECT CAST(s1 > q[1] AS INT) + CAST(s1 > q[2] AS INT) + CAST(s1 > q[3] AS INT) + CAST(s1 > q[4] AS INT) AS bin, avg(r0) AS mean_r
FROM mixed, (SELECT quantile_cont(s1, [0.2, 0.4, 0.6, 0.8]) AS q FROM mixed) GROUP BY 1""", MIXED)
def _(spark, sf):
    return rg.quantile_bin_means(mixed(spark, sf), "r0", "s1", (0.2, 0.4, 0.6, 0.8), None)


@query("regime_balanced_loss", "balanced_loss~6", """
SELECT sum(v * nll) / sum(v) AS balanced_loss FROM (SELECT nll, calm / avg(calm) OVER () + stress / avg(stress) OVER () AS v FROM mixed)""", MIXED)
def _(spark, sf):
    return rg.regime_balanced_loss(mixed(spark, sf), "nll", ["calm", "stress"])


@query("fold_nll_gains", "fold# nll_full~6 nll_base~6 nll_single~6 rows# nll_improvement~6 nll_variance_gain~6 nll_total_gain~6", """
SELECT *, nll_base - nll_full AS nll_improvement, nll_single - nll_base AS nll_variance_gain, nll_single - nll_full AS nll_total_gain FROM (
SELECT year(date) - 1996 AS fold, avg(nll) AS nll_full, avg(0.5 * ln(2 * pi()) + ln(0.04) + 0.5 * pow(y3 / 0.04, 2)) AS nll_base,
  avg(0.5 * ln(2 * pi()) + ln(0.03) + 0.5 * pow(y3 / 0.03, 2)) AS nll_single, count(*) AS rows FROM mixed GROUP BY 1)""", MIXED)
def _(spark, sf):
    d = mixed(spark, sf).withColumn("zero", F.lit(0.0)).withColumn("one", F.lit(1.0))
    d = d.withColumnRenamed("nll", "nll_full")
    for name, s in (("nll_base", 0.04), ("nll_single", 0.03)):
        d = rg.mixture_scores(d.drop("r0", "r1"), "y3", ["zero"], [s], ["one"]).withColumnRenamed("nll", name)
    return rg.fold_gains(d.withColumn("fold", F.year("date") - 1996))
