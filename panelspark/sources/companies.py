"""Company-level tables derived from the star schema: links, sectors, quarters, filings, spells.

They give the point-in-time operators the same cases a research database has: overlapping links,
restated sectors, quarters without a report date, several share classes, late filings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import by_entity, daily_bars, table, weekly_bars


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("entity"), F.to_date("l_shipdate").alias("d"), "l_linenumber",
                     "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_partkey")


def gvkey(entity, line):
    """Six digits (or more) with leading zeros, as company keys have; a key is shared by few entities, keys grow with them."""
    return company_key(F.col(entity) + F.col(line) * 13)


def company_key(number):
    return F.format_string("%06d", number.cast("bigint"))


def link_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, gvkey, link_from, link_thru, link_type, link_prim): yearly links with overlaps."""
    f = _facts(spark, sf_dir).withColumn("y", F.year("d"))
    f = f.where((F.col("entity") + F.col("l_linenumber") * 3 + F.col("y")) % 5 < 2)
    g = f.groupBy("entity", "l_linenumber", "y").agg(F.min("d").alias("link_from"), F.max("d").alias("link_thru"))
    return g.select(
        "entity", gvkey("entity", "l_linenumber").alias("gvkey"), "link_from", "link_thru",
        F.when(F.col("l_linenumber") % 4 == 3, "NR").otherwise("LC").alias("link_type"),
        F.when(F.col("y") % 3 == 0, "J").otherwise("P").alias("link_prim"),
    )


def sector_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gvkey, ind_from, ind_thru, sector, entity): sector intervals per company, some overlapping."""
    f = _facts(spark, sf_dir).withColumn("gvkey", gvkey("entity", "l_linenumber"))
    f = f.withColumn("sector", F.when(F.col("entity") % 10 != 0, 10 + 5 * (F.col("entity") % 11)))
    half = F.col("entity") % 2
    f = f.where(F.year("d") % 2 == half)
    return f.groupBy("gvkey", "sector", "entity", F.year("d").alias("y")).agg(
        F.min("d").alias("ind_from"), F.max("d").alias("ind_thru")).drop("y")


def membership_spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, spell_start, spell_end), both inclusive: runs of weeks with at least two trades.

    A gap of more than four weeks starts a new spell.
    """
    b = weekly_bars(spark, sf_dir).where("n_trades >= 2").select("entity", "date")
    gap = F.datediff("date", F.lag("date").over(by_entity()))
    b = b.withColumn("new", F.coalesce((gap > 28).cast("int"), F.lit(1)))
    b = b.withColumn("g", F.sum("new").over(by_entity().rowsBetween(W.unboundedPreceding, 0)))
    return b.groupBy("entity", "g").agg(F.min("date").alias("spell_start"), F.max("date").alias("spell_end")).drop("g")


def security_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, info_start, info_end, company, ticker): yearly records; two entities share a company."""
    b = weekly_bars(spark, sf_dir).where("entity % 13 <> 5")
    g = b.groupBy("entity", F.year("date").alias("y")).agg(F.min("date").alias("info_start"), F.max("date").alias("info_end"))
    return g.where("(entity + y) % 6 <> 0").select(
        "entity", "info_start", "info_end", F.floor(F.col("entity") / 2).alias("company"),
        F.concat(F.lit("T"), F.col("entity").cast("string"), F.lit("Y"), (F.col("y") % 100).cast("string")).alias("ticker"))


ITEMS = ("saleq", "cogsq", "ibq", "atq", "actq", "cheq", "lctq", "dlcq", "dlttq", "ltq", "ceqq", "seqq", "pstkq",
         "txditcq", "ivaoq", "ivstq", "mibq")


def income_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gvkey, keyset, fyearq, fqtr, saleq, cogsq, ibq, oancfy): flows, cash flow year to date."""
    f = _facts(spark, sf_dir).withColumns({"fyearq": F.year("d"), "fqtr": F.quarter("d")})
    price = F.col("l_extendedprice")
    g = f.groupBy(F.col("entity").alias("gvkey"), "fyearq", "fqtr").agg(
        F.round(F.sum(price), 2).alias("saleq"),
        F.round(F.sum(price * F.col("l_discount")), 4).alias("cogsq"),
        F.round(F.sum(price * (F.col("l_tax") - 0.035)), 5).alias("ibq"),
        F.round(F.sum(price * (F.col("l_tax") - F.col("l_discount"))), 4).alias("_ocf"),
    )
    year = W.partitionBy("gvkey", "fyearq").orderBy("fqtr").rowsBetween(W.unboundedPreceding, 0)
    ytd = F.when((F.col("gvkey") + F.col("fyearq") + F.col("fqtr")) % 8 != 0, F.round(F.sum("_ocf").over(year), 4))
    cogs = F.when(F.col("gvkey") % 9 != 0, F.col("cogsq"))
    return g.select("gvkey", F.lit(1).alias("keyset"), "fyearq", "fqtr", "saleq", cogs.alias("cogsq"), "ibq",
                    ytd.alias("oancfy"))


def balance_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gvkey, keyset, fyearq, fqtr, balance items): stocks scaled from quantities, with holes."""
    f = _facts(spark, sf_dir).withColumns({"fyearq": F.year("d"), "fqtr": F.quarter("d")})
    q = F.col("l_quantity")

    def part(name, cond, scale, hole=None):
        v = F.sum(F.when(cond, q).otherwise(0.0)) * scale
        return (v if hole is None else F.when(hole, v)).alias(name)

    g = f.groupBy(F.col("entity").alias("gvkey"), "fyearq", "fqtr").agg(
        (F.sum(q) * 1000.0).alias("atq"), part("actq", F.col("l_linenumber") <= 4, 900.0),
        part("cheq", F.col("l_linenumber") == 1, 500.0), part("lctq", F.col("l_returnflag") == "R", 600.0),
        part("dlcq", F.col("l_linenumber") == 2, 100.0), part("dlttq", F.col("l_returnflag") == "A", 300.0),
        part("ltq", F.col("l_returnflag") != "N", 700.0), part("ceqq", F.col("l_returnflag") == "N", 800.0),
        part("seqq", F.col("l_linenumber") >= 3, 700.0), part("pstkq", F.col("l_linenumber") == 7, 50.0),
        part("txditcq", F.col("l_linenumber") == 6, 40.0), part("ivaoq", F.col("l_linenumber") == 5, 30.0),
        part("ivstq", F.col("l_linenumber") == 4, 20.0), part("mibq", F.col("l_linenumber") == 3, 10.0),
    )
    k = F.col("gvkey") + F.col("fyearq") * 4 + F.col("fqtr")
    holes = {"seqq": k % 4 != 0, "ceqq": k % 8 != 0, "txditcq": k % 3 != 0, "ivaoq": k % 5 != 0, "mibq": k % 6 != 0}
    return g.select("gvkey", F.lit(1).alias("keyset"), "fyearq", "fqtr", *[
        (F.when(holes[c], F.col(c)) if c in holes else F.col(c)).alias(c) for c in g.columns[3:]])


def period_descriptor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gvkey, keyset, fyearq, fqtr, fyr, rdq): one row per fiscal quarter; rdq as yyyymmdd, 0 missing."""
    f = _facts(spark, sf_dir)
    g = f.groupBy(F.col("entity").alias("gvkey"), F.year("d").alias("fyearq"), F.quarter("d").alias("fqtr")).agg(
        F.count(F.lit(1)).alias("facts"))
    end = F.last_day(F.make_date("fyearq", F.col("fqtr") * 3, F.lit(1)))
    lag = 15 + (F.col("gvkey") * 7 + F.col("fqtr") * 13 + F.col("fyearq")) % 60
    rdq = F.when((F.col("gvkey") + F.col("fyearq") + F.col("fqtr")) % 9 == 0, "0").otherwise(
        F.date_format(F.date_add(end, lag.cast("int")), "yyyyMMdd"))
    return g.select("gvkey", F.lit(1).alias("keyset"), "fyearq", "fqtr", F.lit(12).alias("fyr"), rdq.alias("rdq"), "facts")


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gvkey, period_end, source_type, filed): filings of several types per quarter."""
    f = _facts(spark, sf_dir)
    g = f.groupBy(F.col("entity").alias("gvkey"), F.last_day(F.add_months(F.trunc("d", "quarter"), 2)).alias("period_end"),
                  F.col("l_returnflag").alias("source_type")).agg(F.min("l_linenumber").alias("k"))
    lag = 20 + (F.col("gvkey") * 5 + F.month("period_end") * 11 + F.ascii("source_type") * 3) % 80
    return g.where((F.col("gvkey") + F.month("period_end") * 2) % 7 != 0).select(
        "gvkey", "period_end", "source_type", F.date_add("period_end", lag.cast("int")).alias("filed"))


def delistings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, delist_date, action, delist_ret): every third entity stops at a year of its own."""
    b = daily_bars(spark, sf_dir).where("entity % 3 = 0 and year(date) < 1998 + entity % 4")
    g = b.groupBy("entity").agg(F.max("date").alias("delist_date"), F.max_by("n_trades", "date").alias("k"))
    return g.select("entity", "delist_date", F.when(F.col("k") > 1, "MERGER").otherwise("LIQUID").alias("action"),
                    F.when(F.col("entity") % 4 != 0, F.lit(-0.35)).alias("delist_ret"))


__all__ = ["link_history", "sector_history", "membership_spells", "security_info", "income_statement", "balance_sheet",
           "period_descriptor", "filings", "delistings"]
