"""Trading-calendar features: one row per date, so every ordered window is bounded by the calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# End dates of the scheduled policy meetings, of the years that the default table covers.
FOMC = """
2011-01-26 2011-03-15 2011-04-27 2011-06-22 2011-08-09 2011-09-21 2011-11-02 2011-12-13
2012-01-25 2012-03-13 2012-04-25 2012-06-20 2012-08-01 2012-09-13 2012-10-24 2012-12-12
2013-01-30 2013-03-20 2013-05-01 2013-06-19 2013-07-31 2013-09-18 2013-10-30 2013-12-18
2014-01-29 2014-03-19 2014-04-30 2014-06-18 2014-07-30 2014-09-17 2014-10-29 2014-12-17
2015-01-28 2015-03-18 2015-04-29 2015-06-17 2015-07-29 2015-09-17 2015-10-28 2015-12-16
2016-01-27 2016-03-16 2016-04-27 2016-06-15 2016-07-27 2016-09-21 2016-11-02 2016-12-14
2017-02-01 2017-03-15 2017-05-03 2017-06-14 2017-07-26 2017-09-20 2017-11-01 2017-12-13
2018-01-31 2018-03-21 2018-05-02 2018-06-13 2018-08-01 2018-09-26 2018-11-08 2018-12-19
2019-01-30 2019-03-20 2019-05-01 2019-06-19 2019-07-31 2019-09-18 2019-10-30 2019-12-11
2020-01-29 2020-03-15 2020-04-29 2020-06-10 2020-07-29 2020-09-16 2020-11-05 2020-12-16
2021-01-27 2021-03-17 2021-04-28 2021-06-16 2021-07-28 2021-09-22 2021-11-03 2021-12-15
2022-01-26 2022-03-16 2022-05-04 2022-06-15 2022-07-27 2022-09-21 2022-11-02 2022-12-14
2023-02-01 2023-03-22 2023-05-03 2023-06-14 2023-07-26 2023-09-20 2023-11-01 2023-12-13
2024-01-31 2024-03-20 2024-05-01 2024-06-12 2024-07-31 2024-09-18 2024-11-07 2024-12-18
2025-01-29 2025-03-19 2025-05-07 2025-06-18 2025-07-30 2025-09-17 2025-10-29 2025-12-10
2026-01-28 2026-03-18 2026-04-29 2026-06-17 2026-07-29 2026-09-16 2026-11-04 2026-12-16
""".split()


def third_friday(date) -> Column:
    """The third Friday of the date's month."""
    first = F.date_sub(F.trunc(date, "month"), 1)
    return F.date_add(F.next_day(first, "Fri"), 14)


def _one():
    return W.partitionBy(F.lit(0)).orderBy("date")


def since_until(d: DataFrame, event: Column, since: str, until: str) -> DataFrame:
    """Trading days since the last and until the next date carrying the event (0 on the date)."""
    pos = F.col("_pos")
    back = _one().rowsBetween(W.unboundedPreceding, 0)
    ahead = _one().rowsBetween(0, W.unboundedFollowing)
    return d.withColumn("_e", F.when(event, pos)).withColumns({
        since: pos - F.max("_e").over(back), until: F.min("_e").over(ahead) - pos}).drop("_e")


def _position(d: DataFrame, name: str, keys) -> DataFrame:
    w = W.partitionBy(*keys)
    n = F.row_number().over(w.orderBy("date"))
    return d.withColumns({
        f"days_since_first_trading_day_of_{name}": n - 1,
        f"days_until_last_trading_day_of_{name}": F.count(F.lit(1)).over(w) - n})


def published_meetings(spark: SparkSession) -> DataFrame:
    """(date) of the listed meetings; other years, or another bank's meetings, come as a table of the caller's."""
    return spark.createDataFrame([(x,) for x in FOMC], "date string").select(F.col("date").cast("date").alias("date"))


def calendar_features(dates: DataFrame, meetings: DataFrame | None = None) -> DataFrame:
    """17 calendar columns per trading date.

    ``meetings`` (date) are the policy meetings that the two meeting counters count from and to; without it the published ones. A
    meeting on a day without trading counts for no date, a date before the first or after the last meeting has no counter.
    """
    if meetings is None:
        meetings = published_meetings(dates.sparkSession)
    d = dates.select("date").distinct().withColumn("_pos", F.row_number().over(_one()))
    d = d.withColumns({
        "day_of_the_week": F.weekday("date") + 1, "month_of_the_year": F.month("date"), "quarter_of_year": F.quarter("date"),
        "_y": F.year("date")})
    d = _position(d, "month", ["_y", "month_of_the_year"])
    d = _position(d, "quarter", ["_y", "quarter_of_year"])
    d = _position(d, "year", ["_y"])
    expiry = F.col("date") == third_friday("date")
    d = since_until(d, expiry, "days_since_last_monthly_options_expiration", "days_until_next_monthly_options_expiration")
    d = since_until(d, expiry & (F.col("month_of_the_year") % 3 == 0),
                    "days_since_last_quarterly_options_expiration", "days_until_next_quarterly_options_expiration")
    d = _holidays(d)
    met = meetings.select("date").where("date is not null").distinct().withColumn("_met", F.lit(True))
    d = since_until(d.join(met, "date", "left"), F.col("_met"), "days_since_last_fomc_meeting", "days_until_next_fomc_meeting")
    return d.drop("_pos", "_y", "_met")


def _holidays(d: DataFrame) -> DataFrame:
    """Calendar days since the last / until the next weekday missing from the calendar.

    The last missing weekday before a date is the latest gap day between consecutive dates; it is
    found inside each gap and carried along.
    """
    prev = F.lag("date").over(_one())
    days = F.filter(F.sequence(F.date_add("_prev", 1), F.date_sub("date", 1)), lambda x: F.weekday(x) < 5)
    gap = F.when(F.datediff("date", "_prev") > 1, days)
    d = d.withColumn("_prev", prev).withColumn("_gap", F.when(F.size(gap) > 0, gap))
    last = F.last(F.when(F.col("_gap").isNotNull(), F.element_at("_gap", -1)), ignorenulls=True)
    nxt = F.first(F.when(F.col("_gap").isNotNull(), F.element_at("_gap", 1)), ignorenulls=True)
    back = _one().rowsBetween(W.unboundedPreceding, 0)
    ahead = _one().rowsBetween(1, W.unboundedFollowing)
    return d.withColumns({
        "days_since_last_trading_holiday": F.datediff("date", last.over(back)),
        "days_until_next_trading_holiday": F.datediff(nxt.over(ahead), "date")}).drop("_prev", "_gap")


# The event gates (column, comparison, bound); the extended set adds two earnings gates.
STRESS_GATES = (
    ("days_until_next_fomc_meeting", "le", 10), ("days_since_last_fomc_meeting", "le", 12),
    ("days_until_next_monthly_options_expiration", "le", 10), ("days_until_next_quarterly_options_expiration", "le", 1),
    ("days_until_last_trading_day_of_quarter", "le", 10), ("days_until_last_trading_day_of_month", "le", 13),
    ("days_since_first_trading_day_of_month", "le", 0), ("days_until_next_trading_holiday", "le", 5),
)
EARNINGS_GATES = (("days_until_next_earnings", "le", 12), ("days_until_next_earnings", "ge", 55))


def event_stress(gates=STRESS_GATES) -> Column:
    """Number of gates that are open; a missing counter keeps its gate closed."""
    total = F.lit(0)
    for c, op, k in gates:
        hit = F.col(c) <= k if op == "le" else F.col(c) >= k
        total = total + F.when(hit, 1).otherwise(0)
    return total


def event_weight(stress) -> Column:
    s = F.col(stress) if isinstance(stress, str) else stress
    return F.when(s > 0, 1.0 + s).otherwise(0.0)


#: Fixed value: weight of event days in a training table (ordinary days weigh 1).
EVENT_WEIGHT = 3.0


def training_weight(stress: str) -> Column:
    return 1.0 + EVENT_WEIGHT * (F.coalesce(F.col(stress), F.lit(0)) > 0).cast("double")


def macro_gate(context: DataFrame, index: str, ret: str, vol_w: int = 20, slow: int = 60, long: int = 120,
               week: int = 5) -> DataFrame:
    """Per date: five stress conditions on an index level and a return series, their sum, the weight
    and the calm complement."""
    from ..functions.elementwise import zero_to_null
    from . import rolling as ts

    o = _one()
    d = context.withColumn("_i", zero_to_null(index)).withColumns({
        "_mv": ts.std(ret, vol_w, over=o), "_ri": F.col("_i") / zero_to_null(F.lag("_i").over(o)) - 1.0})
    conds = {
        "r1": F.col("_i") > ts.mean("_i", slow, over=o), "r2": ts.zscore("_i", vol_w, over=o) > 1.0,
        "r3": F.col("_mv") > ts.mean("_mv", long, over=o), "r4": ts.sum_(ret, vol_w, over=o) < 0,
        "r5": ts.sum_("_ri", week, over=o) > 0}
    d = d.withColumns({k: F.when(c, 1).otherwise(0) for k, c in conds.items()})
    d = d.withColumn("regime", F.col("r1") + F.col("r2") + F.col("r3") + F.col("r4") + F.col("r5"))
    return d.withColumns({"weight": event_weight("regime"), "calm": (F.col("regime") == 0).cast("double")}).drop("_i", "_mv", "_ri")
