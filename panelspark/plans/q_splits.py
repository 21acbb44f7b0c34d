"""Splits, samples, set operations and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.elementwise import signed_bucket
from ..operators import sampling as sm
from ..operators import splits as sp
from ..operators import rolling as ts
from ..operators.crosssection import CrossSection
from ..sources.tables import names_bound, table, weekly_bars, weekly_panel
from .oracle import PANEL, WEEK_BARS, more, with_
from .q_evaluate import SCORED, scored
from .registry import query

CAL = "cal AS (SELECT date, row_number() OVER (ORDER BY date) AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM panel))"
W_CAL = more(PANEL, CAL)


def cal(spark, sf):
    return sp.calendar(weekly_panel(spark, sf))


# trading days: shipping days with at least nine tenths of the mean activity
BUSY = """busy AS (SELECT date FROM (SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS k FROM lineitem GROUP BY 1)
  WHERE k >= 0.9 * (SELECT count(*) / count(DISTINCT CAST(l_shipdate AS DATE)) FROM lineitem))"""


def busy_days(spark, sf):
    days = table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.count(F.lit(1)).alias("k"))
    return days.where(F.col("k") >= days.agg(F.avg("k") * 0.9).scalar()).select("date")


@query("split_by_date", "date role", """
SELECT date, CASE WHEN pos <= floor(n * 0.6) THEN 'train' WHEN pos <= floor(n * 0.6) + floor(n * 0.2) THEN 'valid' ELSE 'test' END AS role FROM cal""", W_CAL)
def _(spark, sf):
    return sp.split_by_date(cal(spark, sf), 0.6, 0.2)


@query("walk_forward_folds", "fold# date role", """
SELECT fold, date, CASE WHEN pos - 1 < ts - 5 THEN 'train' WHEN pos - 1 < ts THEN 'purged' ELSE 'test' END AS role
FROM (SELECT *, n - 4 * 30 + fold * 30 AS ts FROM cal, range(4) AS r(fold)) WHERE pos - 1 < ts + 30""", W_CAL)
def _(spark, sf):
    return sp.walk_forward_folds(cal(spark, sf), 4, 30, 5)


YEAR_FOLDS = """SELECT y - {a} AS fold, y AS test_year, date, CASE WHEN year(date) = y THEN 'test' WHEN pos > before - {p} THEN 'purged' ELSE 'train' END AS role
FROM (SELECT c.*, y, (SELECT count(*) FROM cal b WHERE year(b.date) < y) AS before FROM cal c, range({a}, {b}) AS r(y) WHERE year(date) <= y)"""


@query("calendar_year_folds", "fold# test_year# date role", YEAR_FOLDS.format(a=1998, b=2002, p=3), W_CAL)
def _(spark, sf):
    return sp.calendar_year_folds(cal(spark, sf), 1998, 2001, 3)


@query("pilot_folds", "fold# test_year# date role", YEAR_FOLDS.format(a=1997, b=1999, p=3), W_CAL)
def _(spark, sf):
    early = sp.pilot_slice(cal(spark, sf), 1999, 3)
    early = early.unionByName(cal(spark, sf).where("year(date) = 1998").join(early, "date", "left_anti"))
    return sp.pilot_folds(early, (1997, 1998), 1999, 3)


@query("pilot_slice", "date", "SELECT date FROM cal WHERE year(date) < 1999 AND pos <= (SELECT max(pos) FROM cal WHERE year(date) < 1999) - 3", W_CAL)
def _(spark, sf):
    return sp.pilot_slice(cal(spark, sf), 1999, 3)


@query("validation_tail", "fold# date role", """
SELECT 0 AS fold, date, CASE WHEN pos - 1 < n - 45 THEN 'train' WHEN pos - 1 < n - 40 THEN 'purged' ELSE 'test' END AS role FROM cal""", W_CAL)
def _(spark, sf):
    return sp.validation_tail(cal(spark, sf), 40, 5)


@query("purge_overlap", "date entity#", """
SELECT date, entity FROM panel WHERE date <= CAST((SELECT max(date) FROM panel) - 14 AS DATE)""", PANEL)
def _(spark, sf):
    # the last Monday minus ten business days is the Monday two weeks earlier
    return sp.purge_overlap(weekly_panel(spark, sf), 10)


@query("cs_date_major_order", "pos# date entity#", "SELECT row_number() OVER (ORDER BY date, entity) AS pos, date, entity FROM bars_w", with_(WEEK_BARS))
def _(spark, sf):
    # a global ordinal: one group holds every row, so the bound is names x weeks
    b = weekly_bars(spark, sf).select("date", "entity").withColumn("d", F.unix_date("date"))
    return CrossSection((), None).ordinal(b, "d", "pos", "entity")


@query("top_n_per_group", "date entity# rank#", """
SELECT date, entity, row_number() OVER (PARTITION BY date ORDER BY dollar_volume DESC, entity) AS rank FROM panel
QUALIFY row_number() OVER (PARTITION BY date ORDER BY dollar_volume DESC, entity) <= 5""", PANEL)
def _(spark, sf):
    p = weekly_panel(spark, sf).withColumn("_neg", -F.col("dollar_volume"))
    return CrossSection(("date",), names_bound(spark, sf)).ordinal(p, "_neg", "rank").where("rank <= 5")


@query("top_k_candidates", "entity# total~2", "SELECT entity, sum(dollar_volume) AS total FROM panel GROUP BY 1 ORDER BY total DESC, entity LIMIT 10", PANEL)
def _(spark, sf):
    t = weekly_panel(spark, sf).groupBy("entity").agg(F.sum("dollar_volume").alias("total"))
    return sm.top_k(t, "total", 10, "entity")


@query("set_operations", "kind entity#", """
SELECT 'union' AS kind, entity FROM (SELECT entity FROM panel WHERE date < DATE '1995-02-01' UNION SELECT entity FROM panel WHERE date >= DATE '2001-10-01')
UNION ALL SELECT 'intersection', entity FROM (SELECT entity FROM panel WHERE date < DATE '1995-01-15' INTERSECT SELECT entity FROM panel WHERE date >= DATE '2001-10-25')
UNION ALL SELECT 'difference', entity FROM (SELECT entity FROM panel WHERE date < DATE '1995-01-15' EXCEPT SELECT entity FROM panel WHERE date >= DATE '2001-10-25')""", PANEL)
def _(spark, sf):
    b = weekly_bars(spark, sf).select("entity", "date")
    early, late = b.where("date < '1995-01-15'").select("entity"), b.where("date >= '2001-10-25'").select("entity")
    union = b.where("date < '1995-02-01' or date >= '2001-10-01'").select("entity").distinct()
    parts = {"union": union, "intersection": early.intersect(late), "difference": early.subtract(late)}
    out = None
    for k, d in parts.items():
        d = d.withColumn("kind", F.lit(k))
        out = d if out is None else out.unionByName(d)
    return out


@query("trading_holidays", "date", """
SELECT CAST(d AS DATE) AS date FROM (SELECT unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM busy)
WHERE isodow(d) <= 5 AND CAST(d AS DATE) NOT IN (SELECT date FROM busy)""", "WITH " + BUSY)
def _(spark, sf):
    return sm.holidays(busy_days(spark, sf))


LABELLED = """lab AS (SELECT *, CAST(sign(y) AS INT) * (CAST(abs(y) >= 0.02 AS INT) + CAST(abs(y) >= 0.05 AS INT)) AS k,
  md5(CAST(date AS VARCHAR) || '|' || entity) AS h FROM (SELECT date, entity, y3 AS y FROM scored WHERE y3 IS NOT NULL))"""


def labelled(spark, sf):
    d = scored(spark, sf).where("y3 is not null").select("date", "entity", F.col("y3").alias("y"))
    return d.withColumn("k", signed_bucket("y", (0.02, 0.05)))


@query("downsample_zero", "date entity# k#", """
SELECT date, entity, k FROM (SELECT *, row_number() OVER (PARTITION BY k = 0 ORDER BY h) AS rn FROM lab)
WHERE k <> 0 OR rn <= floor((SELECT count(*) FROM lab WHERE k <> 0) * 0.25)""", more(SCORED, LABELLED))
def _(spark, sf):
    return sm.downsample_zero(labelled(spark, sf), "k", 0.25, bound=None)


@query("balance_signed", "date entity# k#", """
SELECT date, entity, k FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY h) AS rn FROM lab WHERE k <> 0) a
WHERE rn <= least((SELECT count(*) FROM lab b WHERE b.k = abs(a.k)), (SELECT count(*) FROM lab b WHERE b.k = -abs(a.k)))""", more(SCORED, LABELLED))
def _(spark, sf):
    return sm.balance_signed(labelled(spark, sf), "k", bound=None)


@query("balanced_sample", "date entity# y_bucket#", """
SELECT date, entity, k AS y_bucket FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY h) AS rn FROM lab WHERE abs(y) < 0.08) a
WHERE CASE WHEN k = 0 THEN rn <= floor((SELECT count(*) FROM lab WHERE k <> 0 AND abs(y) < 0.08) * 0.25)
  ELSE rn <= least((SELECT count(*) FROM lab b WHERE b.k = abs(a.k) AND abs(y) < 0.08), (SELECT count(*) FROM lab b WHERE b.k = -abs(a.k) AND abs(y) < 0.08)) END""", more(SCORED, LABELLED))
def _(spark, sf):
    d = labelled(spark, sf).drop("k")
    return sm.balanced_sample(d, "y", (0.02, 0.05), 0.25, limit=0.08, bound=None)


@query("replay_subset", "date entity# round# replayed", """
WITH r AS (SELECT date, entity, year(date) - 1995 AS round, ('0x' || substr(md5(CAST(date AS VARCHAR) || '|' || entity), 1, 7))::BIGINT % 5 AS b
  FROM (SELECT DISTINCT l_suppkey AS entity, CAST(date_trunc('week', l_shipdate) AS DATE) AS date FROM lineitem))
SELECT date, entity, round, false AS replayed FROM r UNION ALL SELECT date, entity, round + 1, true FROM r WHERE b = 0 AND round < (SELECT max(round) FROM r)""")
def _(spark, sf):
    b = weekly_bars(spark, sf).select("date", "entity").withColumn("round", F.year("date") - 1995)
    return sm.replay_subset(b, "round", 5)


@query("duplicate_elimination", "l_orderkey# l_linenumber# last_part# first_part#", """
SELECT l_orderkey, l_linenumber, arg_max(l_partkey, (l_shipdate, l_partkey, l_suppkey)) AS last_part,
       arg_min(l_partkey, (l_shipdate, l_partkey, l_suppkey)) AS first_part FROM lineitem GROUP BY 1, 2""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")
    keys, order = ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"]
    a = sm.dedupe(li, keys, order).withColumnRenamed("l_partkey", "last_part")
    b = sm.dedupe(li, keys, order, last=False).withColumnRenamed("l_partkey", "first_part")
    return a.select(*keys, "last_part").join(b.select(*keys, "first_part"), keys)


@query("date_code_rounds", "date code# part round#", """
SELECT date, code, CASE WHEN ('0x' || substr(md5(CAST(date AS VARCHAR) || '|' || code), 1, 7))::BIGINT % 5 = 0 THEN 'valid' ELSE 'train' END AS part,
  ('0x' || substr(md5(code || '|' || CAST(date AS VARCHAR)), 1, 7))::BIGINT % 4 AS round
FROM (SELECT DISTINCT l_suppkey AS code, CAST(date_trunc('week', l_shipdate) AS DATE) AS date FROM lineitem)""")
def _(spark, sf):
    b = weekly_bars(spark, sf).select("date", F.col("entity").alias("code"))
    return sm.rounds_of_files(b, 4, 5)


CANDS = ("s1", "s2", "volume", "r")
PNL = "pnl AS (SELECT date, " + ", ".join(f"sum((rk_{c} - 0.5) * y1) AS {c}" for c in CANDS) + " FROM (SELECT *, " + ", ".join(
    f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY date, {c}) - 1) / 2.0) / count({c}) OVER (PARTITION BY date) END AS rk_{c}"
    for c in CANDS) + " FROM scored) GROUP BY date)"


def candidate_pnl(spark, sf):
    d = scored(spark, sf)
    xs = CrossSection(("date",), names_bound(spark, sf))
    for c in CANDS:
        d = xs.rank_pct(d, c, f"rk_{c}")
    return d.groupBy("date").agg(*[F.sum((F.col(f"rk_{c}") - 0.5) * F.col("y1")).alias(c) for c in CANDS])


CORR_SQL = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM pnl"
                              for i, a in enumerate(CANDS) for b in CANDS[i:])


@query("pnl_correlation_matrix", "a b corr~", CORR_SQL, more(SCORED, PNL))
def _(spark, sf):
    return sm.correlation_pairs(candidate_pnl(spark, sf), CANDS)


FIT_SQL = " UNION ALL ".join(f"SELECT '{c}' AS candidate, abs(avg({c}) / stddev_samp({c})) AS fitness FROM pnl" for c in CANDS)
PRUNE = f"""pairs AS ({CORR_SQL}), fit AS ({FIT_SQL}),
ord AS (SELECT candidate, fitness, row_number() OVER (ORDER BY fitness DESC, candidate) AS i FROM fit WHERE fitness > 0),
met AS (SELECT a, b, abs(corr) AS size FROM pairs WHERE a <> b UNION ALL SELECT b, a, abs(corr) FROM pairs WHERE a <> b),
walk AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS kept, CAST(NULL AS VARCHAR) AS candidate, CAST(NULL AS DOUBLE) AS fitness, CAST(NULL AS DOUBLE) AS max_corr
  UNION ALL
  SELECT i, CASE WHEN worst <= 0.5 THEN list_append(kept, candidate) ELSE kept END, candidate, fitness, worst FROM (
    SELECT o.i, w.kept, o.candidate, o.fitness, coalesce(max(m.size), 0) AS worst
    FROM walk w JOIN ord o ON o.i = w.i + 1 LEFT JOIN met m ON m.a = o.candidate AND list_contains(w.kept, m.b)
    GROUP BY o.i, w.kept, o.candidate, o.fitness))"""


@query("greedy_prune", "candidate fitness~ max_corr~", "SELECT candidate, fitness, max_corr FROM walk WHERE max_corr <= 0.5",
       more(SCORED, PNL, PRUNE).replace("WITH", "WITH RECURSIVE", 1))
def _(spark, sf):
    pnl = candidate_pnl(spark, sf)
    fit = pnl.unpivot(["date"], list(CANDS), "candidate", "v").groupBy("candidate").agg(
        F.abs(F.avg("v") / F.stddev_samp("v")).alias("fitness"))
    return sm.greedy_prune(fit, sm.correlation_pairs(pnl, CANDS), 0.5)


@query("qualification_filter", "candidate ir_daily~ tvr~ numstk~ valid_ir~", " UNION ALL ".join(f"""
SELECT * FROM (SELECT '{c}' AS candidate, abs(avg({c}) FILTER (WHERE year(date) < 1999) / stddev_samp({c}) FILTER (WHERE year(date) < 1999)) AS ir_daily, 0.3 AS tvr, 200.0 AS numstk,
  avg({c}) FILTER (WHERE year(date) >= 1999) / stddev_samp({c}) FILTER (WHERE year(date) >= 1999) AS valid_ir FROM pnl) WHERE ir_daily > 0.05 AND valid_ir > 0""" for c in CANDS), more(SCORED, PNL))
def _(spark, sf):
    long = candidate_pnl(spark, sf).unpivot(["date"], list(CANDS), "candidate", "v")
    early, late = F.when(F.year("date") < 1999, F.col("v")), F.when(F.year("date") >= 1999, F.col("v"))
    rep = long.groupBy("candidate").agg(
        F.abs(F.avg(early) / F.stddev_samp(early)).alias("ir_daily"), F.lit(0.3).alias("tvr"), F.lit(200.0).alias("numstk"),
        (F.avg(late) / F.stddev_samp(late)).alias("valid_ir"))
    return sm.qualifies(rep, ir_min=0.05)


@query("no_lookahead_audit", "feature cells# changed#", """
SELECT unnest(['mean_20', 'rank', 'zscore_20']) AS feature, 2 * count(*) AS cells, 0 AS changed FROM bars_w WHERE date <= DATE '1998-06-29'""", with_(WEEK_BARS))
def _(spark, sf):
    from ..operators.audit import no_lookahead

    xs = CrossSection(("date",), names_bound(spark, sf))

    def build(rows):
        d = rows.withColumn("ret", ts.log_return("close"))
        d = d.select("date", "entity", "ret", ts.mean("ret", 20).alias("mean_20"), ts.zscore("ret", 20).alias("zscore_20"))
        return xs.rank_pct(d, "ret", "rank")

    return no_lookahead(weekly_bars(spark, sf), build, ["mean_20", "zscore_20", "rank"], "1998-06-29")
