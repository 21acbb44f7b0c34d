"""Date cuts, walk-forward folds and purging. A fold table has one row per (fold, date, role)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class PreTestViolation(ValueError):
    """A date at or after the first test year reached a pre-test step."""


def cut_at(df: DataFrame, end: str, allowed_end: str | None = None, date: str = "date") -> DataFrame:
    """Drop every source row after ``end`` before any forward window is built."""
    if allowed_end is not None and end > allowed_end:
        raise ValueError(f"end {end} is past the allowed end {allowed_end}")
    return df.where(F.col(date) <= F.lit(end).cast("date"))


def history_check(df: DataFrame, start: str, end: str, windows, horizon: int, date: str = "date") -> DataFrame:
    """One row: calendar rows needed and present before ``start`` and after ``end``."""
    need = max(windows)
    dates = df.select(date).distinct()
    return dates.agg(
        F.lit(need).alias("need_back"),
        F.sum((F.col(date) < F.lit(start).cast("date")).cast("int")).alias("have_back"),
        F.lit(horizon).alias("need_forward"),
        F.sum((F.col(date) > F.lit(end).cast("date")).cast("int")).alias("have_forward"),
    ).withColumn(
        "ok", (F.col("have_back") >= F.col("need_back")) & (F.col("have_forward") >= F.col("need_forward"))
    )


def require_history(df: DataFrame, start: str, end: str, windows, horizon: int, date: str = "date") -> None:
    """Refuse a source with too few dates before ``start`` or after ``end``."""
    row = history_check(df, start, end, windows, horizon, date).first()
    if not row["ok"]:
        raise ValueError(f"history too short: {row.asDict()}")


def calendar(df: DataFrame, date: str = "date") -> DataFrame:
    """(date, pos, n_dates): the distinct dates with their 1-based ordinal.

    One row per calendar date whatever the panel holds, so the single ordered window is bounded by
    the calendar.
    """
    dates = df.select(F.col(date).alias("date")).distinct()
    one = W.partitionBy(F.lit(0))
    return dates.select(
        "date",
        F.row_number().over(one.orderBy("date")).alias("pos"),
        F.count(F.lit(1)).over(one).alias("n_dates"),
    )


def split_by_date(cal: DataFrame, train: float, valid: float) -> DataFrame:
    """(date, role) by fractions of the unique dates."""
    n = F.col("n_dates")
    a = F.floor(n * train)
    b = a + F.floor(n * valid)
    role = F.when(F.col("pos") <= a, "train").when(F.col("pos") <= b, "valid").otherwise("test")
    return cal.select("date", role.alias("role"))


def walk_forward_folds(cal: DataFrame, n_folds: int, block: int, purge: int) -> DataFrame:
    """(fold, date, role): the last n_folds * block dates are consecutive test blocks.

    Each fold trains on every earlier date minus the ``purge`` dates right before its block.
    """
    if n_folds < 1 or block < 1 or purge < 0:
        raise ValueError(f"invalid split: n_folds={n_folds}, block={block}, purge={purge}")
    first = F.col("n_dates") - n_folds * block
    rows = cal.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    ts = first + F.col("fold") * block
    p = F.col("pos") - 1
    role = (
        F.when(p < ts - purge, "train").when(p < ts, "purged").when(p < ts + block, "test")
    )
    return rows.select("fold", "date", role.alias("role")).where("role is not null")


def calendar_year_folds(cal: DataFrame, first_year: int, last_year: int, purge: int) -> DataFrame:
    """(fold, test_year, date, role): test on each calendar year, train on everything before it.

    The last ``purge`` dates before the year are purged. The number of earlier dates is the ordinal
    of the year's first date, found with one aggregate per year.
    """
    if purge < 0 or last_year < first_year:
        raise ValueError(f"invalid folds: {first_year}..{last_year}, purge {purge}")
    starts = cal.groupBy(F.year("date").alias("test_year")).agg(F.min("pos").alias("ts"), F.max("pos").alias("te"))
    years = F.sequence(F.lit(first_year), F.lit(last_year))
    rows = cal.withColumn("test_year", F.explode(years)).join(F.broadcast(starts), "test_year")
    pos = F.col("pos")
    role = (
        F.when(pos < F.col("ts") - purge, "train").when(pos < F.col("ts"), "purged")
        .when(pos <= F.col("te"), "test")
    )
    return rows.select(
        (F.col("test_year") - first_year).alias("fold"), "test_year", "date", role.alias("role")
    ).where("role is not null")


def pilot_slice(cal: DataFrame, first_test_year: int, purge: int) -> DataFrame:
    """Dates before the first test year minus the last ``purge`` of them."""
    early = cal.where(F.year("date") < first_test_year)
    last = early.agg(F.max("pos").alias("last_pos"))
    return early.where(F.col("pos") <= last.select(F.col("last_pos") - purge).scalar())


def assert_pre_test(df: DataFrame, first_test_year: int, date: str = "date") -> None:
    late = df.where(F.year(date) >= first_test_year).agg(
        F.count(F.lit(1)).alias("n"), F.min(date).alias("first")).first()
    if late["n"]:
        raise PreTestViolation(f"{late['n']} row(s) at or after {first_test_year}, from {late['first']}")


def pilot_folds(cal: DataFrame, validation_years, first_test_year: int, purge: int) -> DataFrame:
    """Calendar-year folds over the validation years; refuses any test-period date."""
    if any(v >= first_test_year for v in validation_years):
        raise PreTestViolation(f"validation years {validation_years} reach {first_test_year}")
    assert_pre_test(cal, first_test_year)
    lo, hi = min(validation_years), max(validation_years)
    folds = calendar_year_folds(cal, lo, hi, purge)
    return folds.where(F.col("test_year").isin(list(validation_years)))


def validation_tail(cal: DataFrame, val_dates: int, purge: int) -> DataFrame:
    """(fold, date, role): the last ``val_dates`` dates as the test role of one purged fold."""
    return walk_forward_folds(cal, 1, val_dates, purge)


def business_days_before(date, n: int):
    """The date ``n`` business days earlier (Monday to Friday), as a Column."""
    d = F.col(date) if isinstance(date, str) else date
    dow = F.weekday(d)
    # a weekend date counts from the Friday before it, as business-day offsets do
    base = F.when(dow > 4, F.date_sub(d, dow - 4)).otherwise(d)
    wd = F.least(dow, F.lit(4))
    extra = F.when(dow > 4, 1).otherwise(0)
    steps = F.lit(n) - extra
    weeks = F.floor(steps / 5).cast("int")
    rest = (steps - weeks * 5).cast("int")
    back = weeks * 7 + rest + F.when(rest > wd, 2).otherwise(0)
    return F.date_sub(base, back.cast("int"))


def purge_overlap(df: DataFrame, horizon: int, date: str = "date") -> DataFrame:
    """Training rows whose forward window ends inside the training block: drops the last business days."""
    last = df.agg(F.max(date).alias("last_date"))
    cutoff = last.select(business_days_before("last_date", horizon)).scalar()
    return df.where(F.col(date) <= cutoff)
