"""Multiple testing, Sharpe inference, trial log and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.elementwise import p_value
from ..operators import evaluate as ev
from ..operators import infer as inf
from ..operators import quality as ql
from ..sources.tables import names_bound, table, weekly_panel
from .oracle import PANEL, more, with_
from .q_regimes import NORM
from .q_splits import CANDS, PNL, candidate_pnl
from .q_evaluate import SCORED, hac_sql
from .registry import query

# one family per region: each supplier's mean weekly return against zero is one test
TESTS = f"""raw AS (SELECT CAST(sector AS VARCHAR) AS family, entity, avg(sig) / (stddev_samp(sig) / sqrt(count(sig))) * 4 AS t
  FROM panel WHERE sector IS NOT NULL GROUP BY 1, 2),
tests AS (SELECT family, entity, 2 * least(cdf, 1 - cdf) AS p FROM (SELECT *, {NORM} AS cdf FROM raw))"""
W_TESTS = more(PANEL, TESTS)


def tests(spark, sf):
    p = weekly_panel(spark, sf).where("sector is not null")
    g = p.groupBy(F.col("sector").cast("string").alias("family"), "entity").agg(
        (F.avg("sig") / (F.stddev_samp("sig") / F.sqrt(F.count("sig"))) * 4).alias("t"))
    return g.withColumn("p", p_value("t"))


@query("bonferroni", "family entity# p~6 adjusted~6 reject", """
SELECT *, adjusted <= 0.05 AS reject FROM (SELECT family, entity, p, least(1, p * count(*) OVER (PARTITION BY family)) AS adjusted FROM tests)""", W_TESTS)
def _(spark, sf):
    return inf.bonferroni(tests(spark, sf), "p", ("family",), bound=names_bound(spark, sf))


@query("holm", "family entity# p~6 adjusted~6 reject", """
SELECT a.family, a.entity, any_value(a.p) AS p, least(1, max((a.n - b.i + 1) * b.p)) AS adjusted, least(1, max((a.n - b.i + 1) * b.p)) <= 0.05 AS reject
FROM o a JOIN o b ON a.family = b.family AND b.i <= a.i GROUP BY 1, 2""",
       more(W_TESTS, "o AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, entity) AS i, count(*) OVER (PARTITION BY family) AS n FROM tests)"))
def _(spark, sf):
    return inf.holm(tests(spark, sf), "p", ("family",), ["entity"], bound=names_bound(spark, sf))


@query("benjamini_hochberg", "family entity# p~6 adjusted~6 reject", """
SELECT a.family, a.entity, any_value(a.p) AS p, least(1, min(b.p * b.n / b.i)) AS adjusted, any_value(a.i) <= any_value(k.last) AS reject
FROM o a JOIN o b ON a.family = b.family AND b.i >= a.i
JOIN (SELECT family, coalesce(max(i) FILTER (WHERE p <= i / n * 0.1), 0) AS last FROM o GROUP BY 1) k ON k.family = a.family GROUP BY 1, 2""",
       more(W_TESTS, "o AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, entity) AS i, count(*) OVER (PARTITION BY family) AS n FROM tests)"))
def _(spark, sf):
    return inf.benjamini_hochberg(tests(spark, sf), "p", ("family",), ["entity"], bound=names_bound(spark, sf))


RETS = "rets AS (SELECT c.series, p.date, CASE c.series " + " ".join(f"WHEN '{c}' THEN {c}" for c in CANDS) + \
    " END AS v FROM pnl p, (VALUES " + ", ".join(f"('{c}')" for c in CANDS) + ") AS c(series))"
W_RETS = more(SCORED, PNL, RETS)


def rets(spark, sf):
    return candidate_pnl(spark, sf).unpivot(["date"], list(CANDS), "series", "v")


SHARPE = f"""SELECT m.*, h.n, sharpe, CASE WHEN lrv > 0 THEN least(n, n * gamma0 / lrv) ELSE n END AS ess
FROM (SELECT series, avg(v) AS mean, stddev_pop(v) AS sd, avg(v) / stddev_pop(v) AS sharpe, avg(pow(v - mu, 3)) / pow(stddev_pop(v), 3) AS skew,
   avg(pow(v - mu, 4)) / pow(stddev_pop(v), 4) AS kurt FROM (SELECT *, avg(v) OVER (PARTITION BY series) AS mu FROM rets WHERE v IS NOT NULL) GROUP BY 1) m
JOIN ({hac_sql('rets', 'v', 2)}) h ON h.series = m.series"""
Z = "greatest(least((sharpe - {b}) * sqrt(ess - 1) / sqrt(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe), 5), -5)"


@query("sharpe_and_psr", "series sharpe~ skew~ kurt~ n# ess~6 psr~6", f"""
SELECT *, {NORM} AS psr FROM (SELECT *, {Z.format(b='0')} AS t FROM ({SHARPE}))""", W_RETS)
def _(spark, sf):
    return inf.sharpe_table(rets(spark, sf), "v", 2)


# the oracle's inverse normal is a fine grid search on the series CDF (four trials)

@query("expected_max_sharpe_and_dsr", "series sharpe~ n_trials# sr_variance~ hurdle~5 dsr~4", f"""
SELECT series, sharpe, n_trials, sr_variance, hurdle, {NORM} AS dsr FROM (SELECT *, {Z.format(b='hurdle')} AS t FROM (
  SELECT *, sqrt(sr_variance) * ((1 - 0.5772156649015329) * q1 + 0.5772156649015329 * q2) AS hurdle FROM (
    SELECT *, count(*) OVER () AS n_trials, var_pop(sharpe) OVER () AS sr_variance FROM ({SHARPE})),
    (SELECT max(x) FILTER (WHERE p <= 1 - 1 / 4.0) AS q1, max(x) FILTER (WHERE p <= 1 - 1 / (4 * exp(1))) AS q2 FROM (
      SELECT t AS x, {NORM} AS p FROM (SELECT i / 1000000.0 AS t FROM range(600000, 1400000) AS r(i))))))""", W_RETS)
def _(spark, sf):
    return inf.deflated_sharpe(inf.sharpe_table(rets(spark, sf), "v", 2))


TRIALS = """trials AS (SELECT o_orderkey AS trial_id, o_orderpriority AS tag, o_totalprice / 1000 AS ir, o_custkey % 7 AS seed, year(o_orderdate) AS fold,
  o_orderstatus AS status FROM orders)"""


def trials(spark, sf):
    """Trial rows from the orders: tag, metrics map, config map, seed."""
    o = table(spark, sf, "orders")
    t = o.select(
        F.col("o_orderkey").alias("trial_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("tag"),
        F.create_map(F.lit("ir"), F.when(F.col("o_orderkey") % 50 != 0, F.col("o_totalprice") / 1000)).alias("metrics"),
        F.create_map(F.lit("status"), F.col("o_orderstatus")).alias("config"), (F.col("o_custkey") % 7).alias("seed"),
        F.year("o_orderdate").alias("fold"))
    return inf.with_provenance(t, target_kind="raw", feature_set="weekly", fold_scheme="calendar_year", sample_window="1995-2001")


@query("trial_log_validation", "problem n#", "SELECT 'non-finite metric' AS problem, count(*) AS n FROM orders WHERE o_orderkey % 50 = 0")
def _(spark, sf):
    return inf.trial_problems(trials(spark, sf)).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("trial_selection", "tag selected_trial_id# metric~6 n_candidates# status", """
SELECT tag || '#selection' AS tag, arg_max(trial_id, (ir, -trial_id)) AS selected_trial_id, max(ir) AS metric, count(*) AS n_candidates,
  arg_max(status, (ir, -trial_id)) AS status FROM trials WHERE trial_id % 50 <> 0 GROUP BY tag""", with_(TRIALS))
def _(spark, sf):
    best = inf.select_best(inf.valid_trials(trials(spark, sf)), "ir")
    return best.withColumn("status", F.col("config")["status"])


@query("provenance_columns", "key n#", """
SELECT unnest(['target_kind', 'feature_set', 'fold_scheme', 'sample_window', 'status']) AS key, count(*) AS n FROM orders""")
def _(spark, sf):
    return trials(spark, sf).select(F.explode(F.map_keys("config")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("across_seeds", "tag seed# mean~4 sd~4 n#", """
SELECT tag, seed, avg(ir) AS mean, coalesce(stddev_samp(ir), 0) AS sd, count(ir) AS n FROM trials WHERE trial_id % 50 <> 0 GROUP BY 1, 2""", with_(TRIALS))
def _(spark, sf):
    t = trials(spark, sf).withColumn("ir", F.col("metrics")["ir"]).where("ir is not null")
    return inf.across_seeds(t, ("tag", "seed"), "ir")


@query("candidate_winner", "tag mean~4 sd~4 n# winner n_candidates#", """
SELECT *, row_number() OVER (ORDER BY mean DESC, tag) = 1 AS winner, count(*) OVER () AS n_candidates FROM (
  SELECT tag, avg(ir) AS mean, stddev_samp(ir) AS sd, count(ir) AS n FROM trials WHERE trial_id % 50 <> 0 GROUP BY 1)""", with_(TRIALS))
def _(spark, sf):
    t = trials(spark, sf).withColumn("ir", F.col("metrics")["ir"]).where("ir is not null")
    return inf.candidate_winner(t, "tag", "ir")


@query("pilot_selection_summary", "tag mean_loss~4 sd_loss~4 runs# se~4 within_one_se", """
SELECT *, mean_loss <= min(mean_loss) OVER () + (SELECT arg_min(s / sqrt(c), m) FROM (SELECT avg(ir) AS m, stddev_samp(ir) AS s, count(*) AS c FROM trials GROUP BY tag)) AS within_one_se
FROM (SELECT tag, avg(ir) AS mean_loss, stddev_samp(ir) AS sd_loss, count(*) AS runs, stddev_samp(ir) / sqrt(count(*)) AS se FROM trials GROUP BY tag)""", with_(TRIALS))
def _(spark, sf):
    o = table(spark, sf, "orders")
    t = o.select(F.col("o_orderpriority").alias("tag"), F.year("o_orderdate").alias("fold"), (F.col("o_totalprice") / 1000).alias("loss"))
    return inf.selection_table(t, "tag", "fold", "loss")


@query("selection_deviations", "field chosen# given#", """
SELECT CAST(o_custkey AS VARCHAR) AS field, max(o_orderkey) AS chosen, max(o_orderkey) FILTER (WHERE o_orderstatus <> 'P') AS given
FROM orders GROUP BY o_custkey HAVING max(o_orderkey) IS DISTINCT FROM max(o_orderkey) FILTER (WHERE o_orderstatus <> 'P')""")
def _(spark, sf):
    o = table(spark, sf, "orders").withColumn("field", F.col("o_custkey").cast("string"))
    chosen = o.groupBy("field").agg(F.max("o_orderkey").alias("chosen"))
    given = o.where("o_orderstatus <> 'P'").groupBy("field").agg(F.max("o_orderkey").alias("given"))
    return inf.selection_deviations(chosen, given)


@query("aggregate_only_check", "report violations#", """
SELECT 'by_sector' AS report, count(*) AS violations FROM (SELECT CAST(sector AS VARCHAR) AS k FROM panel GROUP BY 1) WHERE k IN (SELECT s_name FROM supplier)
UNION ALL SELECT 'by_supplier', count(*) FROM (SELECT s_name AS k FROM panel JOIN supplier ON s_suppkey = entity GROUP BY 1) WHERE k IN (SELECT s_name FROM supplier)""", PANEL)
def _(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity"), "s_name")
    p = weekly_panel(spark, sf)
    safe = p.select(F.col("sector").cast("string").alias("k")).distinct()
    leaky = p.join(s, "entity").select(F.col("s_name").alias("k")).distinct()
    out = None
    for name, report in (("by_sector", safe), ("by_supplier", leaky)):
        one = ql.identifier_violations(report, ["k"], s.select(F.col("s_name").alias("id"))).agg(F.count(F.lit(1)).alias("violations"))
        one = one.withColumn("report", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("data_fingerprint", "rows# dates# entities# first_date last_date checksum", """
SELECT count(*) AS rows, count(DISTINCT date) AS dates, count(DISTINCT entity) AS entities, min(date) AS first_date, max(date) AS last_date,
  CAST(sum(('0x' || substr(md5(CAST(date AS VARCHAR) || '|' || entity || coalesce('|' || CAST(round(ret * 1e6) AS BIGINT), '')), 1, 12))::BIGINT) AS VARCHAR) AS checksum FROM panel""", PANEL)
def _(spark, sf):
    return inf.fingerprint(weekly_panel(spark, sf))


@query("ic_p_values", "series t~6 p~6", f"""
SELECT series, t, 2 * least(cdf, 1 - cdf) AS p FROM (SELECT series, t, {NORM} AS cdf FROM (SELECT series, mean / sqrt(lrv / n) AS t FROM ({hac_sql('rets', 'v', 2)})))""", W_RETS)
def _(spark, sf):
    s = ev.series_summary(rets(spark, sf), "v", 2)
    return s.withColumn("p", p_value("t"))
