"""Structured Streaming jobs: incremental extract, online regime filter, late-arriving quarters."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def incremental_extract(stream: DataFrame, keys: DataFrame, key: str, date: str, lo: str, hi: str,
                        out: str, checkpoint: str):
    """Filter new files once each and append them as parquet; returns the finished query.

    ``availableNow`` processes what is there and stops; the checkpoint remembers the files, so a
    rerun resumes where the last one ended.
    """
    kept = stream.where(F.col(date).between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))
    kept = kept.join(keys.select(key).distinct(), key, "left_semi")
    q = (kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


@contextmanager
def rocksdb_state(spark: SparkSession):
    """The session names the RocksDB state store, which processors with list and map state need, for the time of a job only."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _state_store_named(spark: SparkSession) -> None:
    if not spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider"):
        raise RuntimeError("set spark.sql.streaming.stateStore.providerClass to the RocksDB provider")


class RegimeFilter(StatefulProcessor):
    """Filtered regime probabilities of one series, carried from date to date, for a target that is known ``horizon`` dates later.

    On a date only the targets of ``horizon`` dates back and earlier are known, so its prior is the posterior from ``horizon`` of the series'
    dates back, taken as many steps ahead; a series with fewer dates starts from the initial distribution. State: the last
    date, and a list of the last ``horizon`` posteriors, oldest first. Rows are taken in date order; a date at or
    before the last one changes nothing that is published and is reported as a ``late`` row without probabilities.
    """

    def __init__(self, means, variances, transition, initial, horizon: int = 1):
        if horizon < 1:
            raise ValueError(f"the filter needs a horizon >= 1, got {horizon}")
        self.means, self.variances, self.initial = [np.asarray(v, dtype=float) for v in (means, variances, initial)]
        self.ahead, self.horizon = np.linalg.matrix_power(np.asarray(transition, dtype=float), horizon), horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "date string")
        self.posteriors = handle.getListState("posteriors", ", ".join(f"p{i} double" for i in range(len(self.initial))))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("date")  # the new dates of one series
        k = len(self.initial)
        last = self.last.get()[0] if self.last.exists() else ""
        ring = deque((np.asarray(p, dtype=float) for p in self.posteriors.get()), maxlen=self.horizon)
        values = frame["value"].to_numpy(dtype=float)
        logs = -0.5 * (np.log(2 * np.pi * self.variances) + (values[:, None] - self.means) ** 2 / self.variances)
        out = []
        for date, log in zip(frame["date"], logs, strict=True):
            stamp = str(date)
            if stamp <= last:
                out.append((key[0], date, *[None] * k, None, True))
                continue
            prior = ring[0] @ self.ahead if len(ring) == self.horizon else self.initial
            peak = log.max()
            joint = prior * np.exp(log - peak)
            ring.append(joint / joint.sum())
            last = stamp
            out.append((key[0], date, *ring[-1].tolist(), float(np.log(joint.sum()) + peak), False))
        self.last.update((last,))
        self.posteriors.put([tuple(p.tolist()) for p in ring])
        yield pd.DataFrame(out, columns=["series", "date", *[f"f{i}" for i in range(k)], "log_c", "late"])

    def close(self) -> None:
        pass


def online_regime_filter(stream: DataFrame, means, variances, transition, initial, out: str, checkpoint: str, horizon: int = 1):
    """Run the filter over a (series, date, value) stream and append the filtered rows, and those that come late, as parquet.

    The session has to name the RocksDB state store (``rocksdb_state``). A later run continues from the checkpoint with the list of
    each series' last ``horizon`` posteriors, as if it had never stopped.
    """
    _state_store_named(stream.sparkSession)
    k = len(initial)
    schema = "series string, date date, " + ", ".join(f"f{i} double" for i in range(k)) + ", log_c double, late boolean"
    filtered = stream.groupBy("series").transformWithStateInPandas(
        RegimeFilter(means, variances, transition, initial, horizon), schema, "append", "None")
    return _append(filtered, out, checkpoint)


def _append(rows: DataFrame, out: str, checkpoint: str):
    """Append what is there to the parquet folder, each batch once, and stop."""
    q = (rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return q


class QuarterBook(StatefulProcessor):
    """The quarters of one company as a map from fiscal quarter to (availability, items), and what was known at each availability date.

    A batch adds its quarters to the map and publishes, under the company's next version, the availability dates that the new quarters
    touch: their own and all later ones, each with the quarters known by then, up to ``lags`` - 1 behind the latest. A quarter that
    comes again changes nothing. Nothing but the company's own map is read.
    """

    def __init__(self, items, lags: int):
        self.items, self.lags = list(items), lags

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.quarters = handle.getMapState("quarters", "fq_index long", "avail date, " + ", ".join(f"`{i}` double" for i in self.items))
        self.version = handle.getValueState("version", "version long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = {k[0]: v for k, v in self.quarters.iterator()}
        first = None
        for frame in rows:
            cells = frame[self.items].astype(object).where(frame[self.items].notna(), None)
            for fq, avail, *values in zip(frame["fq_index"], frame["avail"], *[cells[i] for i in self.items], strict=True):
                if pd.isna(fq) or pd.isna(avail) or int(fq) in known:
                    continue
                known[int(fq)] = (avail, *values)
                self.quarters.updateValue((int(fq),), known[int(fq)])
                first = avail if first is None else min(first, avail)
        if first is None:
            return
        version = self.version.get()[0] + 1 if self.version.exists() else 1
        self.version.update((version,))
        arrived = sorted((v[0], fq) for fq, v in known.items())
        out, latest = [], None
        for at, (event, fq) in enumerate(arrived):
            latest = fq if latest is None else max(latest, fq)
            if event < first or (at + 1 < len(arrived) and arrived[at + 1][0] == event):
                continue
            there = [lag for lag in range(self.lags) if latest - lag in known and known[latest - lag][0] <= event]
            cells = [c for lag in there for c in known[latest - lag][1:]]
            out.append((key[0], event, known[latest][0], version, there, cells))
        yield pd.DataFrame(out, columns=["gvkey", "event", "asof_avail", "version", "lags", "cells"])

    def close(self) -> None:
        pass


def late_quarters(stream: DataFrame, items, out: str, checkpoint: str):
    """Quarters (gvkey, fq_index, avail, items) arriving in any order: each batch appends the values of the events that it touches.

    The quarters live in the state store, one map for each company; a batch reads its own rows and its companies' maps and writes only
    events at or after its earliest new availability date, so that the work of all batches grows with what arrives, not with what is stored. A
    restart continues from the checkpoint. Readers take the newest version of each event (``latest_values``).
    """
    from ..operators.pit import MAX_LAG, fundamental_values

    _state_store_named(stream.sparkSession)
    items = list(items)
    plain = stream.where("gvkey is not null").select("gvkey", F.col("fq_index").cast("long").alias("fq_index"), "avail", *[F.col(i).cast("double").alias(i) for i in items])
    key = plain.schema["gvkey"].dataType.simpleString()
    touched = plain.groupBy("gvkey").transformWithStateInPandas(
        QuarterBook(items, MAX_LAG + 1), f"gvkey {key}, event date, asof_avail date, version long, lags array<int>, cells array<double>", "append", "None")
    quarter = lambda i: F.struct(*[F.get("cells", i * len(items) + j).alias(c) for j, c in enumerate(items)])
    known = touched.withColumn("known", F.map_from_arrays("lags", F.transform("lags", lambda _, i: quarter(i))))
    versions = known.select("gvkey", "event", "asof_avail", "known", "version")
    return _append(fundamental_values(versions, "version"), out, checkpoint)


def latest_values(spark: SparkSession, out: str) -> DataFrame:
    """The newest version of each event of each company."""
    d = spark.read.parquet(out)
    rest = [c for c in d.columns if c not in ("gvkey", "event", "version")]
    newest = d.groupBy("gvkey", "event").agg(F.max_by(F.struct(*rest), "version").alias("v"))
    return newest.select("gvkey", "event", "v.*")
