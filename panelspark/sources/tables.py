"""Panels derived from the star-schema tables.

The weekly supplier panel is the reduced form every windowed operator works on: the fact table is
pre-aggregated (map-side) to one row per (entity, week), so a later window over one entity holds at
most one row per calendar week however many fact rows that entity has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.crosssection import CrossSection


def by_entity():
    """The window spec of every per-entity operator: one shuffle and one sort serve all of them."""
    return W.partitionBy("entity").orderBy("date")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def names_bound(spark: SparkSession, sf_dir: str) -> int | None:
    """Upper bound on the names of one date: the rows of the entity dimension, counted (from footers) for each plan.

    With the session setting ``panelspark.crosssection.plan`` = ``split`` no bound is given, so that every cross-section
    takes the split plan.
    """
    if spark.conf.get("panelspark.crosssection.plan", None) == "split":
        return None
    return table(spark, sf_dir, "supplier").count()


#: Bits of a bar key for the order and the line; three more for the weekday fill a BIGINT.
_ORDER_BITS, _LINE_BITS = 48, 12


def _trade_order() -> tuple[Column, Column]:
    """Order of the facts inside one bar: weekday, then order, then line, as a BIGINT, and as a DECIMAL(38) for keys that don't fit one.

    Plain keys keep the first/last aggregates in hash aggregation with map-side combining; a struct would force
    sort-based aggregation. A fact has one of the two keys, the other is NULL: orders below 2^48 and lines below 2^12 take the
    integer, and only others pay for a decimal, in which orders take 19 digits and lines 10.
    """
    day, order, line = F.weekday("l_shipdate").cast("bigint"), F.col("l_orderkey").cast("bigint"), F.col("l_linenumber").cast("bigint")
    fits = order.between(0, (1 << _ORDER_BITS) - 1) & line.between(0, (1 << _LINE_BITS) - 1)
    short = F.shiftleft(day, _ORDER_BITS + _LINE_BITS) + F.shiftleft(order, _LINE_BITS) + line
    return F.when(fits, short), F.when(~fits, _wide_key(day, order, line))


def _wide_key(day: Column, order: Column, line: Column) -> Column:
    """The same order for any BIGINT: ten digits above the line, nineteen above the order; negative ones come before."""
    ten, nineteen = (F.lit(f"1{'0' * n}").cast("decimal(38,0)") for n in (10, 19))
    d = lambda c: c.cast("decimal(38,0)")
    return ((d(day) * ten * nineteen + d(order) * ten).cast("decimal(38,0)") + d(line)).cast("decimal(38,0)")


def _first_and_last(price: str, cond: Column | None = None) -> tuple[Column, Column]:
    """The price of the first and of the last fact of a group, over both kinds of keys."""
    def on(c):
        return F.col(c) if cond is None else F.when(cond, F.col(c))

    short, wide, value = on("seq"), on("seq_wide"), on(price)

    def pick(extreme, by, before):
        as_wide = _wide_key(F.shiftright(extreme(short), _ORDER_BITS + _LINE_BITS),
                            F.shiftright(extreme(short), _LINE_BITS).bitwiseAND((1 << _ORDER_BITS) - 1), extreme(short).bitwiseAND((1 << _LINE_BITS) - 1))
        wide_first = extreme(wide).isNotNull() & (extreme(short).isNull() | before(extreme(wide), as_wide))
        return F.when(wide_first, by(value, wide)).otherwise(by(value, short))

    return (pick(F.min, F.min_by, lambda a, b: a < b), pick(F.max, F.max_by, lambda a, b: a > b))


def _bars(spark: SparkSession, sf_dir: str, period, hours: bool = False) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    seq, wide = _trade_order()
    facts = li.select(
        F.col("l_suppkey").alias("entity"), period.alias("date"), price.alias("price"),
        seq.alias("seq"), wide.alias("seq_wide"), "l_quantity", "l_extendedprice", "l_linenumber",
    )
    first, last = _first_and_last("price")
    return facts.groupBy("entity", "date").agg(
        first.alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        last.alias("close"),
        F.sum("l_quantity").alias("volume"),
        F.round(F.sum("l_extendedprice"), 2).alias("dollar_volume"),
        F.count(F.lit(1)).alias("n_trades"),
        *(_hour_aggregates() if hours else []),
    )


def weekly_bars(spark: SparkSession, sf_dir: str, hours: bool = False) -> DataFrame:
    return _bars(spark, sf_dir, F.to_date(F.date_trunc("week", "l_shipdate")), hours)


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bars(spark, sf_dir, F.to_date("l_shipdate"))


def classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, industry, sector): nation and region of the supplier; every 17th is unclassified."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity"), "s_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    known = F.col("entity") % 17 != 0
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "entity",
        F.when(known, F.col("s_nationkey")).alias("industry"),
        F.when(known, F.col("n_regionkey")).alias("sector"),
    )


def weekly_panel(spark: SparkSession, sf_dir: str, hours: bool = False) -> DataFrame:
    """Bars plus ``ret`` (log return), ``sig`` (ret with holes), industry and sector.

    ``sig`` is missing where (entity + ISO week number) is a multiple of 11, so every operator meets
    missing cells inside its windows.
    """
    bars = weekly_bars(spark, sf_dir, hours)
    ret = F.log(F.col("close")) - F.log(F.lag("close").over(by_entity()))
    hole = (F.col("entity") + F.weekofyear("date")) % 11 == 0
    return (
        bars.join(classification(spark, sf_dir), "entity")
        .withColumn("ret", ret)
        .withColumn("sig", F.when(~hole, F.col("ret")))
    )


def market_series(panel: DataFrame) -> DataFrame:
    """(date, mkt): dollar-volume weighted mean return of each date."""
    ok = F.col("ret").isNotNull()
    return panel.where(ok).groupBy("date").agg(
        (F.sum(F.col("ret") * F.col("dollar_volume")) / F.sum("dollar_volume")).alias("mkt")
    )


def with_market(panel: DataFrame, bound: int | None = None) -> DataFrame:
    """Attach ``mkt`` to every row; the panel itself is evaluated once."""
    ok, xs = F.col("ret").isNotNull(), CrossSection(("date",), bound)
    d = xs.attach(
        panel if xs.windowed else xs.store(panel), stored=True,
        _n=F.sum(F.col("ret") * F.col("dollar_volume")), _d=F.sum(F.when(ok, F.col("dollar_volume"))))
    return d.withColumn("mkt", F.col("_n") / F.col("_d")).drop("_n", "_d")


def market_panel(spark: SparkSession, sf_dir: str, hours: bool = False, columns=None) -> DataFrame:
    """``columns``: those of the panel that the caller reads; a stored panel then has no others."""
    panel = weekly_panel(spark, sf_dir, hours)
    if columns is not None:
        panel = panel.select(*dict.fromkeys([*columns, "date", "ret", "dollar_volume"]))
    return with_market(panel, names_bound(spark, sf_dir))


def _hour_aggregates() -> list:
    """First and last block of a bar: low and high line numbers play the session's two ends."""
    first, last = F.col("l_linenumber") <= 4, F.col("l_linenumber") >= 4

    def on(cond, c):
        return F.when(cond, F.col(c))

    vwap = F.sum(on(last, "l_extendedprice")) / F.sum(on(last, "l_quantity"))
    (o1, c1), (o2, c2) = _first_and_last("price", first), _first_and_last("price", last)
    tilt = F.max(on(last, "price")) + F.min(on(last, "price")) - 2 * F.avg(on(last, "price"))
    return [
        vwap.alias("vwap_last"),
        F.sum(on(first, "l_quantity")).alias("vol_first"), F.sum(on(last, "l_quantity")).alias("vol_last"),
        F.count(on(first, "price")).cast("double").alias("trades_first"),
        F.count(on(last, "price")).cast("double").alias("trades_last"),
        c1.alias("close_first"), o2.alias("open_last"), (c1 / o1 - 1).alias("ret_first"), (c2 / o2 - 1).alias("ret_last"),
        F.round(tilt / vwap, 9).alias("skew_last"),
    ]


def user_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, date, hour, bar fields) from the events: one row per user, day and hour."""
    e = table(spark, sf_dir, "events").where("value is not null")
    seq = F.struct("ts", "event_id")
    return e.groupBy(F.col("user_id").alias("entity"), F.to_date("ts").alias("date"), F.hour("ts").alias("hour")).agg(
        F.min_by("value", seq).alias("open"), F.max_by("value", seq).alias("close"), F.sum("value").alias("volume"),
        F.count(F.lit(1)).alias("trades"))
