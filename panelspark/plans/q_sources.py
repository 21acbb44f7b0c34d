"""Sources, sinks and streaming jobs: tables are written out in the source's format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import infer as inf
from ..session import materialize, scratch_dir
from ..sources import companies as co
from ..sources import files as fl
from ..sources.tables import daily_bars, market_series, table, weekly_bars, weekly_panel
from ..streaming import jobs
from .oracle import DAY_BARS, MPANEL, PANEL, WEEK_BARS, with_
from .q_infer import TRIALS, trials
from .q_pit import FUND, W_PIT, W_LINKS, available
from .q_regimes import INIT, MEANS, PROBS, PROBS_H5, TRANS, VARS, all_series
from .registry import query


@query("read_delimited", "l_orderkey# l_linenumber# l_quantity~2 l_shipdate", """
SELECT l_orderkey, l_linenumber, l_quantity, CAST(l_shipdate AS DATE) AS l_shipdate FROM lineitem""")
def _(spark, sf):
    path = scratch_dir(spark, "delimited")
    li = table(spark, sf, "lineitem").withColumn("l_shipdate", F.to_date("l_shipdate"))
    li.toDF(*[c.upper() for c in li.columns]).write.option("header", True).option("sep", "|").csv(path)
    return fl.read_delimited(spark, path, {"l_orderkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_shipdate": "date"})


@query("extract_filtered", "entity# date close~", """
SELECT entity, date, close FROM bars_d WHERE entity IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) AND date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'""", with_(DAY_BARS))
def _(spark, sf):
    keys = table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("entity"))
    return fl.extract_filtered(daily_bars(spark, sf), keys, "entity", "date", "1996-01-01", "1998-12-31")


IDENTITY = {"source": "lineitem", "lookback": "365", "lo": "1995-01-01", "hi": "2001-12-31"}


@query("extract_bundle", "name n#", """
SELECT 'spells' AS name, count(*) AS n FROM spells UNION ALL SELECT 'stock', count(*) FROM bars_w WHERE entity IN (SELECT entity FROM spells)
UNION ALL SELECT 'info', count(*) FROM info""", W_LINKS)
def _(spark, sf):
    out = scratch_dir(spark, "bundle")
    spells = co.membership_spells(spark, sf)
    tables = {"spells": spells, "info": co.security_info(spark, sf),
              "stock": weekly_bars(spark, sf).join(spells, "entity", "left_semi")}
    fl.extract_bundle(tables, out, IDENTITY)
    rows = [fl.load_extract(spark, out, n, IDENTITY).agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit(n)) for n in tables]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("identity_check", "field stored requested", """
SELECT 'lookback' AS field, '365' AS stored, CAST(count(*) AS VARCHAR) AS requested FROM bars_w""", with_(WEEK_BARS))
def _(spark, sf):
    out = scratch_dir(spark, "identity")
    fl.extract_bundle({"stock": weekly_bars(spark, sf)}, out, IDENTITY)
    rows = spark.read.parquet(f"{out}/stock").count()
    return fl.identity_differences(spark, out, IDENTITY | {"lookback": str(rows)})


@query("extract_return_flags", "entity# date flag", """
SELECT entity, date, CASE WHEN ret IS NULL THEN 'MV' ELSE 'NM' END AS flag FROM panel WHERE entity IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) AND date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'""", PANEL)
def _(spark, sf):
    keys = table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("entity"))
    p = weekly_panel(spark, sf).select("entity", "date", F.when(F.col("ret").isNull(), "MV").otherwise("NM").alias("flag"))
    return fl.extract_filtered(p, keys, "entity", "date", "1996-01-01", "1998-12-31")


@query("read_partitioned_training", "date code f1~ y~ time#", """
SELECT CAST(year(date) AS VARCHAR) AS date, CAST(coalesce(industry, 99) AS VARCHAR) AS code, close AS f1, coalesce(CASE WHEN day(date) % 5 <> 0 THEN ret / 10 END, 0) AS y,
  entity * 400 + dayofyear(date) AS time FROM panel WHERE coalesce(CASE WHEN day(date) % 5 <> 0 THEN abs(ret / 10) END, 0) < 0.2""", PANEL)
def _(spark, sf):
    # years play the dates and industries the codes, so files grow with the data and not their number
    base = scratch_dir(spark, "training")
    d = weekly_panel(spark, sf).select(
        F.year("date").cast("string").alias("date"), F.coalesce("industry", F.lit(99)).cast("string").alias("code"),
        (F.col("entity") * 400 + F.dayofyear("date")).alias("t"), F.dayofmonth("date").alias("k"),
        F.col("close").alias("f1"), (F.col("ret") / 10).alias("y"))
    write_by_file(d.select("date", "code", "f1", F.col("t").alias("close_time")), f"{base}/factor")
    write_by_file(d.where("k % 5 <> 0").select("date", "code", F.col("t").alias("Time"), "y"), f"{base}/label")
    return fl.read_partitioned_training(spark, f"{base}/factor", f"{base}/label", ["f1"], "y")


def write_by_file(df, path):
    """One file per (date, code), in the partitioned folder form."""
    df.repartition("date", "code").write.partitionBy("date", "code").parquet(path)


@query("read_columns", "l_suppkey# n# q~2", "SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_suppkey", "l_quantity").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))


@query("list_data_files", "entity files# with_bytes#", """
SELECT CAST(entity AS VARCHAR) AS entity, 1 AS files, 1 AS with_bytes FROM (SELECT DISTINCT entity FROM bars_w)""", with_(WEEK_BARS))
def _(spark, sf):
    path = scratch_dir(spark, "tree")
    # one file per entity folder
    weekly_bars(spark, sf).repartition("entity").write.partitionBy("entity").parquet(path)
    d = fl.list_data_files(spark, path, "*.parquet")
    entity = F.regexp_extract("path", r"entity=(\d+)/", 1)
    return d.groupBy(entity.alias("entity")).agg(
        F.count(F.lit(1)).alias("files"), F.sum((F.col("bytes") > 0).cast("int")).alias("with_bytes"))


@query("read_symbol_cache", "symbol date close~", """
SELECT CAST(entity AS VARCHAR) AS symbol, date, CASE WHEN day(date) % 3 = 0 THEN close + 1 ELSE close END AS close FROM bars_w""", with_(WEEK_BARS))
def _(spark, sf):
    path = scratch_dir(spark, "symbols")
    w = weekly_bars(spark, sf).select(F.col("entity").cast("string").alias("symbol"), "date", "close")
    # every third day has a second line
    w = w.withColumn("k", F.explode(F.when(F.dayofmonth("date") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    w = w.withColumn("close", F.when(F.col("k") == 1, F.col("close") + 1).otherwise(F.col("close")))
    folders = fl.write_symbol_cache(w, path, ["date", "close"], ["date", "k"])
    return fl.read_symbol_cache(spark, folders, "date date, close double")


@query("save_and_load_panel", "date entity# close~ volume~2", "SELECT date, entity, close, volume FROM bars_w WHERE entity % 10 <> 3", with_(WEEK_BARS))
def _(spark, sf):
    path = scratch_dir(spark, "panel")
    fl.save_panel(weekly_bars(spark, sf), path, ["close", "volume"])
    bad = table(spark, sf, "supplier").where("s_suppkey % 10 = 3").select(F.col("s_suppkey").alias("entity"))
    return fl.load_panel(spark, path, ["close", "volume"], bad)


@query("index_history", "date value~", "SELECT date, mkt AS value FROM market", MPANEL)
def _(spark, sf):
    path = scratch_dir(spark, "vix")
    m = market_series(weekly_panel(spark, sf))
    m.select(F.date_format("date", "MM/dd/yyyy").alias(" DATE "), F.col("mkt").alias("CLOSE"), F.lit(0.0).alias("OPEN")).write.option("header", True).csv(path)
    return fl.load_index_history(spark, path)


@query("factor_text", "date mkt_rf~ smb~", """
SELECT date, CASE WHEN mkt * 100 > -99 THEN round(mkt * 100, 6) / 100 END AS mkt_rf, CASE WHEN day(date) % 7 <> 0 AND mkt * 50 > -99 THEN round(mkt * 50, 6) / 100 END AS smb FROM market""", MPANEL)
def _(spark, sf):
    path = scratch_dir(spark, "factors")
    m = market_series(weekly_panel(spark, sf))
    body = m.select("date", F.concat_ws(",", F.date_format("date", "yyyyMMdd"), F.round(F.col("mkt") * 100, 6).cast("decimal(18,6)").cast("string"),
                                        F.when(F.dayofmonth("date") % 7 != 0, F.round(F.col("mkt") * 50, 6).cast("decimal(18,6)").cast("string")).otherwise("-99.99")).alias("line"))
    # one text file by format: a row per calendar date, so a single task writes it
    lines = body.agg(F.array_sort(F.collect_list("line")).alias("l")).select(
        F.concat(F.lit("Daily factors\n\n,Mkt-RF,SMB,\n"), F.concat_ws("\n", "l"), F.lit("\n\nCopyright\n")).alias("value"))
    lines.coalesce(1).write.text(path)
    return fl.load_factor_text(spark, path)


@query("membership_and_flags", "entity# flag_text n#", """
SELECT l_suppkey AS entity, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' END AS flag_text, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_suppkey, l_returnflag""")
def _(spark, sf):
    li = fl.rows_of(table(spark, sf, "lineitem"), "l_linestatus", "F")
    codes = spark.createDataFrame([("A", "accepted"), ("R", "returned")], "code string, text string")
    g = li.groupBy(F.col("l_suppkey").alias("entity"), "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    return fl.flag_meanings(g, codes, "l_returnflag", "flag_text")


@query("metadata_lines", "n#", "SELECT count(*) AS n FROM part WHERE regexp_matches(p_type, '\\b(ECONOMY|PROMO)\\b')")
def _(spark, sf):
    path = scratch_dir(spark, "items")
    table(spark, sf, "part").select(F.concat_ws(" ", F.col("p_partkey").cast("string"), "p_type").alias("value")).write.text(path)
    return fl.metadata_lines(spark, path, ["ECONOMY", "PROMO"]).agg(F.count(F.lit(1)).alias("n"))


@query("write_metrics", "entity# mean~ sd~ source", """
SELECT entity, avg(ret) AS mean, stddev_samp(ret) AS sd, unnest(['csv', 'json']) AS source FROM panel GROUP BY entity""", PANEL)
def _(spark, sf):
    path = scratch_dir(spark, "metrics")
    m = weekly_panel(spark, sf).groupBy("entity").agg(F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"))
    fl.write_metrics(m, path)
    schema = "entity bigint, mean double, sd double"
    a = spark.read.schema(schema).option("header", True).csv(f"{path}/csv").withColumn("source", F.lit("csv"))
    return a.unionByName(spark.read.schema(schema).json(f"{path}/json").withColumn("source", F.lit("json")))


@query("fold_predictions", "fold# n# pred~", "SELECT year(date) AS fold, count(*) AS n, avg(close / open) AS pred FROM bars_w GROUP BY 1", with_(WEEK_BARS))
def _(spark, sf):
    path = scratch_dir(spark, "folds")
    w = weekly_bars(spark, sf).select("date", "entity", F.year("date").alias("fold"), (F.col("close") / F.col("open")).alias("pred"))
    fl.save_fold_predictions(w, path)
    return spark.read.parquet(path).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg("pred").alias("pred"))


@query("trial_log_append", "tag n# best~6", """
SELECT tag, count(*) AS n, max(ir) AS best FROM trials WHERE trial_id % 50 <> 0 GROUP BY tag""", with_(TRIALS))
def _(spark, sf):
    path = scratch_dir(spark, "trials")
    t = inf.valid_trials(trials(spark, sf))
    inf.append_trials(t.where("fold < 1999"), path)
    inf.append_trials(t.where("fold >= 1999"), path)
    return spark.read.parquet(path).groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("metrics")["ir"]).alias("best"))


@query("write_feature_coverage", "sector n#", "SELECT 'sector_' || sector AS sector, count(*) AS n FROM panel WHERE sector IS NOT NULL GROUP BY 1", PANEL)
def _(spark, sf):
    path = scratch_dir(spark, "coverage")
    p = weekly_panel(spark, sf).where("sector is not null")
    report = p.groupBy(F.concat(F.lit("sector_"), F.col("sector").cast("string")).alias("sector")).agg(F.count(F.lit(1)).alias("n"))
    ids = table(spark, sf, "supplier").select(F.col("s_name").alias("id"))
    fl.write_coverage(report, ["sector"], ids, path)
    return spark.read.schema("sector string, n bigint").json(f"{path}/json")


@query("stream_incremental_extract", "user_id# n# total~4", """
SELECT user_id, count(*) AS n, sum(value) AS total FROM events WHERE user_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 3000)
  AND CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' GROUP BY 1""")
def _(spark, sf):
    base = scratch_dir(spark, "extract")
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    stream = stream.withColumn("date", F.to_date("ts"))
    keys = table(spark, sf, "supplier").where("s_acctbal > 3000").select(F.col("s_suppkey").alias("user_id"))
    jobs.incremental_extract(stream, keys, "user_id", "date", "2024-01-05", "2024-01-25", f"{base}/out", f"{base}/ckpt")
    return spark.read.parquet(f"{base}/out").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def filter_stream(spark, sf, horizon):
    base = scratch_dir(spark, "filter")
    rows = materialize(all_series(spark, sf).where("value is not null"))
    # two drops of files, the second after the first has been filtered: the second run continues from the state store
    stream = lambda: spark.readStream.schema("series string, date date, value double").parquet(f"{base}/in")
    with jobs.rocksdb_state(spark):
        for drop in (rows.where("year(date) < 1997"), rows.where("year(date) >= 1997")):
            drop.write.mode("append").parquet(f"{base}/in")
            jobs.online_regime_filter(stream(), MEANS, VARS, TRANS, INIT, f"{base}/out", f"{base}/ckpt", horizon)
    d = spark.read.parquet(f"{base}/out").where("not late")
    return d.withColumnsRenamed({"f0": "calm", "f1": "stress"})


@query("stream_regime_filter", "series date calm~7 stress~7 log_c~7", "SELECT series, date, calm, stress, log_c FROM probs", PROBS)
def _(spark, sf):
    return filter_stream(spark, sf, 1)


@query("stream_regime_filter_horizon", "series date calm~7 stress~7 log_c~7", "SELECT series, date, calm, stress, log_c FROM hprobs5", PROBS_H5)
def _(spark, sf):
    return filter_stream(spark, sf, 5)


@query("stream_late_quarters", "gvkey# event asof_avail " + FUND, "SELECT * FROM vals", W_PIT)
def _(spark, sf):
    base = scratch_dir(spark, "quarters")
    q = available(spark, sf).where("avail is not null")
    items = [*co.ITEMS, "oancfq"]
    # every seventh quarter arrives after its successors
    q = materialize(q.select("gvkey", "fq_index", "avail", *items))
    late = (F.col("gvkey") + F.col("fq_index")) % 7 == 0
    stream = lambda: spark.readStream.schema(q.schema).parquet(f"{base}/in")
    with jobs.rocksdb_state(spark):
        for drop in (q.where(~late), q.where(late)):
            drop.write.mode("append").parquet(f"{base}/in")
            jobs.late_quarters(stream(), items, f"{base}/out", f"{base}/ckpt")
    return jobs.latest_values(spark, f"{base}/out")
